"""Flat files, lookup tables, record mapping, the whole load, and the file stream."""

import contextlib
import datetime as dt
import io
import os
import re

import pytest
from pyspark.sql import Observation

from faultline.fixed_values import (
    COMPLAINT_FIELD_COUNT,
    COMPLAINT_POSITIONS,
    COMPONENT_GROUPS,
    MAKE_ALIASES,
    RECALL_FIELD_COUNT,
    RECALL_POSITIONS,
)
from faultline.operators.maintain import complaint_metrics
from faultline.operators.records import (
    map_complaints,
    map_recalls,
    personal_data_columns,
    unmapped_top_levels,
)
from faultline.plans import checks
from faultline.plans.checks import ingest
from faultline.plans.load import Run, load, rebuild
from faultline.sources.dimensions import (
    alias_dimension,
    close_aliases,
    group_dimension,
    read_mapping,
)
from faultline.sources.flat import MalformedLine, read_complaint_lines, read_flat, read_recall_lines, split_lines
from faultline.streaming.incremental import current_complaints, stream_complaints
from samples import rows


def line(positions, count, **given):
    fields = [f"secret{i}" for i in range(count)]
    for name, position in positions.items():
        fields[position] = str(given.get(name, ""))
    return "\t".join(fields)


def complaint(id, **given):
    defaults = {
        "odi_number": 1000, "make": "Opal", "model": "River", "model_year": "2015",
        "component": "ENGINE:PISTON", "received_date": "20200601", "product_type": "V",
    }
    return line(COMPLAINT_POSITIONS, COMPLAINT_FIELD_COUNT, **{"id": id, **defaults, **given})


def recall(id, **given):
    defaults = {
        "campaign_number": "20V001", "make": "Opal", "model": "River", "model_year": "2015",
        "component": "ENGINE", "recall_type": "V", "report_received_date": "20200101",
    }
    return line(RECALL_POSITIONS, RECALL_FIELD_COUNT, **{"id": id, **defaults, **given})


def write(path, lines, end="\n"):
    path.write_bytes("".join(text + end for text in lines).encode())
    return str(path)


def mapped(spark, path):
    lines = read_complaint_lines(spark, path)
    return lines, map_complaints(
        lines, alias_dimension(spark, MAKE_ALIASES), group_dimension(spark, COMPONENT_GROUPS)
    )


def test_raw_split_keeps_quotes_padding_and_trailing_empties(spark, tmp_path):
    path = write(tmp_path / "a.tsv", ['x\t"y\t z \t', "   ", "", "a\tb"], end="\r\n")
    flat = read_flat(spark, path, 4)
    assert [list(r.fields) for r in flat.good.collect()] == [["x", '"y', " z ", ""]]
    assert flat.counts().first().asDict() == {"records": 1, "blank_lines": 2, "malformed_lines": 1}
    bad = flat.malformed.first()
    assert (bad.expected, bad.actual, bad.value) == (4, 2, "a\tb") and bad.file.endswith("a.tsv")


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """A malformed line is reported with its place in its file, however many splits and files there are."""
    files, expected = [], []
    for name, end, every in (("g", "\n", 7), ("h", "\r\n", 11), ("i", "\n", 1)):
        content = ["" if n % 5 == 0 else "a" if n % every == 0 else "a\tb" for n in range(1, 1500)]
        files.append(write(tmp_path / f"{name}.tsv", content, end))
        expected += [(f"{name}.tsv", n, 2, 1, "a") for n, line in enumerate(content, 1) if line == "a"]
    files.append(write(tmp_path / "j.tsv", ["a\tb"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    try:
        found = read_flat(spark, files, 2).numbered_malformed()
        assert read_flat(spark, files, 2).lines.select("file", "block").distinct().count() > 20
        with pytest.raises(MalformedLine, match="g.tsv, line 7: expected 2 fields but found 1"):
            read_flat(spark, files, 2, strict=True)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.file.rsplit("/", 1)[1], *r[1:]) for r in found.collect()) == expected
    assert found.columns == ["file", "line", "expected", "actual", "value"]
    assert read_flat(spark, files[3], 2).numbered_malformed().count() == 0
    assert len(expected) > 1000 and expected == sorted(expected)


def test_files_of_lines_are_on_disk_a_round_at_a_time(spark, tmp_path, monkeypatch):
    """Every line is written to its file and numbered, yet no round leaves its files to the next."""
    day = dt.datetime(2001, 2, 3)
    items = [
        (order, order % 3, order % 2, number, float(48 if (order // 300 + number) % 4 == 0 else 49 if number == 2 else 5), 0.0, 0.0, "R", "F", day)
        for order in range(0, 9000, 300)
        for number in (1, 2, 3)
    ]
    given = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double"
    given += ", l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(items, given).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(order, "O", 10.0, day, "1-URGENT") for order in range(0, 9000, 300)]
    given = "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(orders, given).write.parquet(f"{tmp_path}/orders.parquet")
    parts = [(key, f"part {key}", "Brand#1", "LARGE", key) for key in range(3)]
    given = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    spark.createDataFrame(parts, given).write.parquet(f"{tmp_path}/part.parquet")
    kept, read = [], []

    def reading(spark, folder):
        lines = read_recall_lines(spark, folder)
        kept.append([name for name in os.listdir(os.path.dirname(folder)) if name.startswith("recall-lines-")])
        read.append(lines.lines.count())
        return lines

    monkeypatch.setattr(ingest, "read_recall_lines", reading)
    monkeypatch.setattr(ingest, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(ingest, "LINES_PER_ROUND", 30, raising=False)
    found = ingest.malformed_line_numbers(spark, str(tmp_path))
    places = {}
    for order, _, _, number, quantity, *_ in items:
        places.setdefault(order // 1000, []).append(quantity)
    expected = [(part, at, 29, 28) for part, own in places.items() for at, q in enumerate(own, 1) if q == 48]
    assert sorted(map(tuple, found.collect())) == sorted(expected) and len(expected) > 10
    assert len(read) == 3 and sum(read) == len(items) and max(read) < len(items)
    assert all(len(names) == 1 for names in kept) and not [n for n in os.listdir(tmp_path) if n.startswith("recall-lines-")]


def test_lines_of_no_file_have_no_number(spark):
    lines = split_lines(spark.createDataFrame([("a",)], "value string"), 2)
    assert lines.malformed.count() == 1
    with pytest.raises(Exception, match="without a file"):
        lines.numbered_malformed()


def test_byte_order_mark_is_dropped(spark, tmp_path):
    path = write(tmp_path / "b.tsv", ["﻿id\tü"])
    assert list(read_flat(spark, path, 2).good.first().fields) == ["id", "ü"]


def test_strict_reading_raises(spark, tmp_path):
    path = write(tmp_path / "c.tsv", [complaint(1), "a\tb"])
    with pytest.raises(MalformedLine, match="expected 51 fields but found 2"):
        read_complaint_lines(spark, path, strict=True)


def test_several_files_are_one_table_and_lines_are_observed(spark, tmp_path):
    paths = [write(tmp_path / "d.tsv", ["a\tb", ""]), write(tmp_path / "e.tsv", ["c\td", "e\tf"])]
    seen = Observation("lines")
    flat = read_flat(spark, paths, 2).observed(seen)
    assert flat.good.count() == 3
    assert seen.get == {"lines_read": 3, "blank_lines": 1, "malformed_lines": 0}


def test_alias_chains_self_references_and_cycles(spark):
    closed = close_aliases({"a": "b", "B ": "c  d", "x": "x", "p": "q", "q": "p", "z": "p", "": "n", "m": " "})
    assert closed == {"A": "C D", "B": "C D", "X": "X", "P": "P", "Q": "Q", "Z": "P"}
    table = alias_dimension(spark, {"k": "..", "v w": "Vega W"})
    assert rows(table) == [("K", "UNKNOWN", "unknown"), ("V W", "VEGA W", "vega-w")]


def test_mapping_file(spark, tmp_path):
    path = write(tmp_path / "m.json", ['{"VW": "VOLKSWAGEN",', ' " Chevy ": "CHEVROLET"}'])
    assert read_mapping(spark, path) == {"VW": "VOLKSWAGEN", " Chevy ": "CHEVROLET"}


def test_complaint_mapping(spark, tmp_path):
    path = write(
        tmp_path / "f.tsv",
        [
            complaint(
                1, make="  mercedes   benz ", model=" c  class", component="service brakes : pads::", miles="000123",
                crash="y", fire="YES", injured="+2", deaths="-1", failure_date="20130229", cylinders="6",
                drive_train=" awd ", description='  "quoted  ', police_report="Y", manufacturer=" M ",
            ),
            complaint(2, make="VW", model_year="9999", component=" : ", received_date="bad", date_added="20190102"),
            complaint(3, make="FORD MOTOR CO, INC", component="Flux Unit:x", product_type=" v "),
            complaint(4, product_type="T"),
            complaint("x5"),
            complaint(6, odi_number=""),
            complaint(7, received_date="20200230"),
            complaint(8, make=" . ", model=""),
        ],
    )
    lines, records = mapped(spark, path)
    good = {r.id: r for r in records.good.collect()}
    assert sorted(good) == [1, 2, 3, 8]
    first = good[1]
    assert (first.make, first.make_raw, first.model) == ("MERCEDES-BENZ", "mercedes   benz", "C CLASS")
    assert first.vehicle_key == "mercedes-benz|c-class|2015"
    assert first.component == ("service brakes : pads::", "BRAKES", ["service brakes", "pads"])
    assert (first.miles_at_failure, first.crash, first.fire, first.injured, first.deaths) == (
        123, True, False, 2, 0,
    )
    assert (first.failure_date, first.cylinders, first.drive_train) == (None, 6, "AWD")
    assert (first.description, first.police_report, first.manufacturer) == ('"quoted', True, "M")
    second = good[2]
    assert (second.make, second.model_year, second.vehicle_key) == (
        "VOLKSWAGEN", None, "volkswagen|river|unknown",
    )
    assert second.component == (":", "UNKNOWN", []) and second.received_date == dt.date(2019, 1, 2)
    assert (good[3].make, good[3].component.group) == ("FORD", "OTHER")
    assert (good[8].make, good[8].vehicle_key) == ("UNKNOWN", "unknown|unknown|2015")
    assert [r.raw_id for r in records.rejected.orderBy("raw_id").collect()] == ["6", "7", "x5"]
    assert complaint_metrics(lines, records).first().asDict() == {
        "lines_read": 8, "blank_lines": 0, "malformed_lines": 0, "non_vehicle": 1, "mapping_failures": 3,
        "accepted": 4,
    }


def test_recall_mapping(spark, tmp_path):
    path = write(
        tmp_path / "g.tsv",
        [
            recall(1, do_not_drive="Yes", park_outside="Y", potentially_affected="0"),
            recall(2, campaign_number=" "),
            recall("1.0"),
            recall(4, recall_type="E"),
            recall(5, potentially_affected="1,200", report_received_date="03/01/2024", recall_type="v"),
        ],
        end="\r\n",
    )
    records = map_recalls(
        read_flat(spark, path, RECALL_FIELD_COUNT), alias_dimension(spark, MAKE_ALIASES),
        group_dimension(spark, COMPONENT_GROUPS),
    )
    found = rows(
        records.good, "id", "do_not_drive", "park_outside", "potentially_affected", "report_received_date",
        "recall_type",
    )
    assert found == [
        (1, True, False, 0, dt.date(2020, 1, 1), "V"), (5, False, False, None, None, "v"),
    ]
    assert records.rejected.count() == 2


def test_no_personal_data_is_kept(spark, tmp_path):
    _, records = mapped(spark, write(tmp_path / "h.tsv", [complaint(1)]))
    assert personal_data_columns(records.good.schema) == []
    assert "secret" not in str(records.good.first())
    nested = spark.createDataFrame([], "a struct<dealerTel:string>, b array<struct<VIN:string>>, city string")
    assert personal_data_columns(nested.schema) == ["a.dealerTel", "b.VIN", "city"]


def test_unmapped_levels_ignore_case_and_blanks(spark):
    levels = spark.createDataFrame([(["Flux"],), (["FLUX"],), (["ENGINE"],), ([],), (["ant"],)], "levels array<string>")
    found = unmapped_top_levels(levels, group_dimension(spark, COMPONENT_GROUPS))
    assert [tuple(r) for r in found.collect()] == [("FLUX", 2), ("ant", 1)]


def test_load_resume_and_rebuild(spark, tmp_path):
    first = write(
        tmp_path / "c1.tsv",
        [complaint(1, miles="100"), complaint(2, make="VW"), complaint(3, product_type="E"), "", complaint("bad")],
    )
    recall_file = write(tmp_path / "r1.tsv", [recall(1), recall(2), recall(3, make="Nowhere"), ""], end="\r\n")
    run = load(spark, str(tmp_path / "run1"), first, [recall_file])
    assert rows(run.read("vehicles"), "vehicle_key", "complaint_count", "recall_count") == [
        ("opal|river|2015", 1, 1), ("volkswagen|river|2015", 1, 0),
    ]
    assert rows(run.read("profiles"), "vehicle_key", "total_complaints", "with_mileage") == [
        ("opal|river|2015", 1, 1), ("volkswagen|river|2015", 1, 0),
    ]
    assert rows(run.read("components"), "component_group", "complaint_count") == [("ENGINE", 2)]
    counters = spark.read.json(run.path("reports/complaint-load")).first().asDict()
    assert counters == {
        "lines_read": 4, "blank_lines": 1, "malformed_lines": 0, "non_vehicle": 1, "mapping_failures": 1,
        "accepted": 2,
    }
    assert spark.read.json(run.path("reports/rare-makes")).count() == 2
    assert spark.read.json(run.path("reports/recall-load")).first().lines_read == 3
    summary = spark.read.json(run.path("reports/summary")).first()
    assert (summary.accepted, summary.raw_makes, summary.canonical_makes) == (2, 2, 2)
    assert 0 < summary.duration_seconds < 600
    assert rows(run.read("reports/make-spellings"), "make_raw", "make", "count") == [
        ("Opal", "OPAL", 1), ("VW", "VOLKSWAGEN", 1),
    ]

    # A second load replaces complaint 2, adds complaint 4 and keeps the recalls.
    second = write(tmp_path / "c2.tsv", [complaint(2, make="Opal"), complaint(4, make="Opal"), "short\tline"])
    resumed = load(spark, str(tmp_path / "run2"), second, previous=run.folder)
    assert rows(resumed.read("complaints"), "id", "make") == [(1, "OPAL"), (2, "OPAL"), (4, "OPAL")]
    assert rows(resumed.read("vehicles"), "vehicle_key", "complaint_count", "recall_count") == [
        ("opal|river|2015", 3, 1),
    ]
    assert rows(resumed.read("staging/complaints-malformed"), "line", "expected", "actual", "value") == [
        (3, 51, 2, "short\tline"),
    ]

    # Loading the same file again, and rebuilding, changes nothing.
    again = load(spark, str(tmp_path / "run3"), second, previous=resumed.folder)
    assert rows(again.read("complaints")) == rows(resumed.read("complaints"))
    rebuild(Run(spark, again.folder))
    assert rows(again.read("vehicles")) == rows(resumed.read("vehicles"))

    limited = load(spark, str(tmp_path / "run4"), first, record_limit=1)
    assert rows(limited.read("complaints"), "id") == [(1,)] and limited.read("recalls").count() == 0


def test_stream_of_files(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    write(source / "1.tsv", [complaint(1), complaint(2), "", complaint(9, product_type="T")])
    stream_complaints(spark, str(source), target, state).awaitTermination(120)
    write(source / "2.tsv", [complaint(2, make="VW"), complaint(3)])
    stream_complaints(spark, str(source), target, state).awaitTermination(120)
    assert rows(current_complaints(spark, target), "id", "make") == [
        (1, "OPAL"), (2, "VOLKSWAGEN"), (3, "OPAL"),
    ]


def _planned(spark, name, mode):
    """The plan of a query over the smallest tables, as it is before adaptive changes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shown = io.StringIO()
        with contextlib.redirect_stdout(shown):
            checks.queries()[name](spark, "/root/testdata/sf0.001").explain(mode)
        return shown.getvalue()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", ["flat_split", "complaint_rows", "complaint_rejects", "ingest_metrics", "recall_rows", "unmapped_levels"])
def test_generated_methods_are_small_enough_to_be_compiled(spark, name):
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", _planned(spark, name, "codegen"))]
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("name", ["ingest_metrics", "recall_metrics"])
def test_load_counters_read_the_lines_once(spark, name):
    assert _planned(spark, name, "simple").count("FileScan parquet") == 3


def test_blank_lines_hold_white_space_of_any_kind_only(spark):
    rows = spark.createDataFrame([("",), (" \t 　",), (" x ",), ("\u200b",), (None,)], "value string")
    assert [r.is_blank for r in split_lines(rows, 1).lines.collect()] == [True, True, False, False, None]
