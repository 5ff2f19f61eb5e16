"""Tables in key ranges: what an update rewrites, and what readers and writers see of one another."""

import random

import pytest
from pyspark.sql import types as T

from faultline.operators.maintain import upsert
from faultline.sources.ranged import RangedTable, StaleBase

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("at", T.IntegerType())])
ORDER = ["at", "name"]


@pytest.fixture
def table(spark, tmp_path):
    return RangedTable(spark, str(tmp_path / "table"), "id", SCHEMA, 100)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def names(table, version=None):
    return {r.key_range: r.file for r in table.manifest(version).collect()}


def content(found):
    return sorted(tuple(r) for r in found.collect())


def test_an_update_of_one_range_leaves_other_files_as_they_are(spark, table):
    rows = [(i, f"n{i}", 0) for i in range(1000)]
    assert table.replace(frame(spark, rows), ORDER) == 1
    before = names(table)
    assert sorted(before) == list(range(10))
    assert table.upsert(frame(spark, [(250, "new", 1), (299, None, 1), (250, "older", 0)]), ORDER) == 2
    after = names(table)
    assert {k for k in before if before[k] != after[k]} == {2}
    assert content(table.read()) == sorted([r for r in rows if r[0] not in (250, 299)] + [(250, "new", 1), (299, None, 1)], key=lambda r: r[0])
    manifest = {r.key_range: tuple(r)[2:] for r in table.manifest().collect()}
    assert manifest[2] == (200, 299, 100)


def test_a_second_run_changes_nothing(spark, table):
    rows = frame(spark, [(1, "a", 0), (1, "b", 1), (5, None, None), (700, "c", 0)])
    assert table.upsert(rows, ORDER) == 1
    kept = names(table)
    assert table.upsert(rows, ORDER) == 1 and names(table) == kept
    assert content(table.read()) == [(1, "b", 1), (5, None, None), (700, "c", 0)]


def test_random_updates_equal_a_rewrite_of_the_whole_table(spark, table):
    rng, expected = random.Random(3), frame(spark, [])
    for batch in range(4):
        rows = [(rng.randrange(-300, 600), rng.choice(["x", "y", None]), batch) for _ in range(40)]
        incoming = frame(spark, rows)
        table.upsert(incoming, ORDER)
        expected = upsert(expected, incoming, ["id"], ORDER)
    assert content(table.read()) == content(expected)


def test_one_of_two_writers_wins(spark, table):
    table.replace(frame(spark, [(1, "a", 0)]), ORDER)
    base = table.version()
    assert table.upsert(frame(spark, [(2, "first", 0)]), ORDER, base) == 2
    with pytest.raises(StaleBase):
        table.upsert(frame(spark, [(1, "second", 1)]), ORDER, base)
    assert content(table.read()) == [(1, "a", 0), (2, "first", 0)]
    assert table.upsert(frame(spark, [(1, "second", 1)]), ORDER) == 3


def test_a_broken_off_load_and_a_running_reader(spark, table):
    table.replace(frame(spark, [(i, "a", 0) for i in range(300)]), ORDER)
    old = table.read()
    # Broken off after its files were written, and again after its version was named but not yet filled.
    table._write(frame(spark, [(1, "half", 9)]))
    table._files().create(table._path("versions", "2"), False).close()
    assert table.version() == 1 and content(table.read()) == content(old)
    table._files().delete(table._path("versions", "2"), False)
    table.upsert(frame(spark, [(1, "b", 1)]), ORDER)
    assert (1, "a", 0) in content(old) and (1, "b", 1) in content(table.read())
    assert content(table.read(1)) == content(old)


def test_refresh_resume_and_vacuum(spark, table):
    table.replace(frame(spark, [(i, "a", 0) for i in range(300)]), ORDER)
    table.upsert(frame(spark, [(5, "b", 1)]), ORDER)
    table.replace(frame(spark, [(1000, "only", 0)]), ORDER)
    assert content(table.read()) == [(1000, "only", 0)] and table.version() == 3
    table.vacuum()
    assert content(table.read()) == [(1000, "only", 0)]
    again = RangedTable(spark, table.folder, "id", SCHEMA, 100)
    assert again.upsert(frame(spark, [(1, "resumed", 0)]), ORDER) == 4
    assert content(again.read()) == [(1, "resumed", 0), (1000, "only", 0)]


def test_keys_taken_out_leave_empty_ranges_behind(spark, table):
    table.replace(frame(spark, [(1, "a", 0), (200, "b", 0)]), ORDER)
    gone = frame(spark, [(200, None, None)])
    assert table.apply(frame(spark, []), table.version(), gone) == 2
    assert content(table.read()) == [(1, "a", 0)] and sorted(names(table)) == [0]
