from pyspark.sql import functions as F

from faultline.functions.text import (
    collapse_ws,
    normalise,
    slug,
    strip_corporate_suffixes,
    trim_ws,
    upper_or_null,
)


def test_trims_every_kind_of_white_space(values):
    texts = ["  a b  ", "\t x ", "　y ", "", " \n "]
    assert values(trim_ws(F.col("t")), texts) == ["a b", "x", "y", "", ""]


def test_normalise_and_collapse(values):
    texts = ["  pale\t\tmoon  rover ", None, "   ", "a\nb"]
    assert values(normalise(F.col("t")), texts) == ["PALE MOON ROVER", "", "", "A B"]
    assert values(collapse_ws(F.col("t")), ["  Pale  moon ", "x"]) == ["Pale moon", "x"]


def test_slug(values):
    texts = ["F-150", "Grand  Tour", "--x--", "...", "", "Ünder", "A&B 3"]
    assert values(slug(F.col("t")), texts) == [
        "f-150", "grand-tour", "x", "unknown", "unknown", "nder", "a-b-3",
    ]


def test_corporate_suffixes(values):
    cases = {
        "NORTH BUS, INC.": "NORTH BUS",
        "NORTH BUS L.L.C.": "NORTH BUS",
        "NORTH BUS CO, INC": "NORTH BUS",
        "NORTH BUS CORPORATION": "NORTH BUS",
        "T.A. PELL COMPANY": "T.A. PELL",
        "INC": "INC",
        "CO": "CO",
        ", INC": "",
        "NORTH MOTORS": "NORTH MOTORS",
        "NORTH INCO": "NORTH INCO",
        "NORTH,INC": "NORTH,INC",
        "NORTH GMBH,": "NORTH",
        "": "",
        "CO INC": "CO",
    }
    assert values(strip_corporate_suffixes(F.col("t")), list(cases)) == list(cases.values())


def test_upper_or_null(values):
    assert values(upper_or_null(F.col("t")), ["awd", "", None, "4Wd"]) == ["AWD", None, None, "4WD"]
