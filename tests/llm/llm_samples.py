"""Small tables with nulls, empty and long texts, ties, repeated rows, and columns whose names clash."""

import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
TABLES = "documents embeddings pages benchmark labels conversations".split()

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = (
    "digest string, row string, best string, kept string, size string, target string, shard string, key string, "
    "node string, label string, part string, score string, place string, count string, rank string, bucket string, "
    "chunk string, version string, tokens string, words string, base string, candidates string, a string, b string"
)


def documents(spark, rows, clash=False):
    """Rows of (doc_id, text) or (doc_id, text, source), with the columns of documents."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    if not clash:
        return spark.createDataFrame(full, DOCS)
    extra = tuple("x" for _ in CLASHING.split(","))
    return spark.createDataFrame([r + extra for r in full], f"{DOCS}, {CLASHING}")


def table(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").df()


def text_table():
    found = table("documents")
    return dict(zip(found["doc_id"].tolist(), found["text"].fillna("").tolist(), strict=True))


def oracle_rows(sql, columns):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(columns)
    order = [names.index(c) for c in columns]
    return sorted(repr([row[i] for i in order]) for row in cursor.fetchall())


def rows_of(frame):
    return [tuple(row) for row in frame.collect()]


def frame_of(found):
    return pd.DataFrame([row.asDict() for row in found.collect()])
