import datetime as dt

from pyspark.sql import functions as F

from faultline.functions import fields as parse
from faultline.functions.text import trim_ws

def trimmed():
    return trim_ws(F.col("t"))


def test_whole_number(values):
    texts = ["7", " 0042 ", "-7", "+7", "12.5", "ABC", "", "1 2", "2147483647", "2147483648", "９"]
    assert values(parse.whole_number(trimmed()), texts) == [
        7, 42, None, None, None, None, None, None, 2147483647, None, None,
    ]


def test_model_year_bounds(values):
    year = parse.model_year(parse.whole_number(trimmed()))
    texts = ["1899", "1900", "2035", "2036", "9999", "20I9", "", "  2015 ", "0"]
    assert values(year, texts) == [None, 1900, 2035, None, None, None, None, 2015, None]


def test_mileage_is_dropped_not_clamped(values):
    miles = parse.mileage(parse.whole_number(trimmed()))
    texts = ["0", "1", "999999", "1000000", "000123", "52,000", "-5", "999999999999"]
    assert values(miles, texts) == [None, 1, 999999, None, 123, None, None, None]


def test_cylinders_and_casualties(values):
    assert values(parse.cylinders(parse.whole_number(trimmed())), ["6", "0", "SIX", "-4"]) == [6, None, None, None]
    count = parse.casualties(parse.signed_number(trimmed()))
    assert values(count, ["3", "+2", "-1", "NONE", "", "0"]) == [3, 2, 0, 0, 0, 0]


def test_strict_dates(values):
    texts = [
        "20160312", " 20160312 ", "20130229", "19950000", "20161332", "2016-03-12", "03122016", "", "00000101",
        "20240229", "2024", "99991231",
    ]
    day = dt.date(2016, 3, 12)
    assert values(parse.strict_date(trimmed()), texts) == [
        day, day, None, None, None, None, None, None, None, dt.date(2024, 2, 29), None, dt.date(9999, 12, 31),
    ]


def test_flags(values):
    texts = ["Y", " y ", "YES", "1", "N", "", None]
    assert values(parse.is_y(trimmed()), texts) == [True, True, False, False, False, False, False]
    texts = ["Yes", " YES ", "yes", "Y", "Yes please", "", None]
    assert values(parse.is_yes(trimmed()), texts) == [True, True, True, False, False, False, False]
    assert values(parse.is_vehicle(trimmed()), ["V", " v", "T", "", "VEHICLE"]) == [True, True, False, False, False]
