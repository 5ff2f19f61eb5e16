"""The Merkle manifest against trees built the plain way."""

import hashlib
import random
import zlib

import pytest
from llm_samples import CLASHING, DOCS, SF, needs_data, oracle_rows, rows_of

from faultline.llm import queries
from faultline.llm.merkle import append, build_manifest, completed, fold, height, position, proofs, verify_documents, width
from faultline.operators.ordinal import with_ordinal


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[i : i + 8]) for i in range(0, len(below), 8)])
    return levels


def plain_log(leaves, n_levels):
    """(level, index) in the order in which runs become complete."""
    order = []

    def done(level, index, last):
        order.append((level, index))
        if level + 1 < n_levels and (index % 8 == 7):
            done(level + 1, index // 8, last)

    for i in range(leaves):
        done(0, i, False)
    for level in range(1, n_levels):
        if leaves % 8**level:
            order.append((level, (leaves - 1) // 8**level))
    return order


@pytest.mark.parametrize("leaves", [1, 2, 7, 8, 9, 63, 64, 65, 72, 100, 511, 512, 513, 4096, 4100])
def test_positions_are_the_places_in_the_order_of_completion(leaves):
    order = plain_log(leaves, height(leaves) + 1)
    assert [position(level, index, leaves) for level, index in order] == list(range(len(order)))
    assert len(order) == sum(width(level, leaves) for level in range(height(leaves) + 1))
    assert completed(leaves) <= len(order)


@pytest.mark.parametrize("leaves", [1, 5, 8, 64, 65, 300])
def test_a_builder_appends_nodes_in_postorder(leaves):
    digests = [H(str(i)) for i in range(leaves)]
    log = append(digests, 0, 0, leaves)
    assert [row[0] for row in log] == list(range(len(log)))
    levels = plain_levels(digests)
    assert all(digest == levels[level][index] for _, level, index, digest in log)
    assert log[-1][3] == levels[-1][0]


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    """What the query must return, for rows (doc_id, text, lang, source, n_chars)."""
    trees = {}
    for doc_id, text, lang, source, n in rows:
        head = "".join(map(value, (doc_id, source, lang, n)))
        leaf = H(head, value(text))
        altered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        bad = H(head, value(None if text is None else lowered(text))) if altered else leaf
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, doc_id, bad))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    for lang in order:
        trees[lang].sort(key=lambda row: row[:3])
    of = {lang: plain_levels([row[2] for row in trees[lang]]) for lang in order}
    above = plain_levels([of[lang][-1][0] for lang in order])
    found = []
    for k, lang in enumerate(order):
        for i, (_, _, leaf, doc_id, bad) in enumerate(trees[lang]):
            beside, node = "", bad
            for levels, at in ((of[lang], i), (above, k)):
                for level in levels[:-1]:
                    run = level[at - at % 8 : at - at % 8 + 8]
                    beside += "".join(run[: at % 8] + run[at % 8 + 1 :])
                    node = H(*run[: at % 8], node, *run[at % 8 + 1 :])
                    at //= 8
            root = above[-1][0]
            found.append((doc_id, leaf, of[lang][-1][0], root, H(beside), node, node == root, i))
    return sorted(found, key=repr)


def odd_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", "é", "z", None, "", *(f"l{k}" for k in range(9))])
        text = rng.choice([None, "", "Aa B", "é Ω", "x" * 5000 + "Y", f"Text {i}"])
        rows.append((i, text, lang, rng.choice([None, "", "s", "S:1"]), None if text is None else len(text)))
    rows += [rows[0], rows[0], (None, "A", "en", "s", 1), (None, None, None, None, None), (None, None, None, None, None)]
    return rows + [(rows[5][0], "other", rows[5][2], None, 5)]


@pytest.mark.parametrize(("n", "block_levels"), [(700, 1), (120, 2), (40, 4)])
def test_documents_are_proved_as_by_plain_trees(spark, n, block_levels):
    rows = odd_rows(n, n)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert sorted(rows_of(verify_documents(docs, block_levels)), key=repr) == plain(rows)


def test_clashing_columns_and_an_empty_table(spark):
    names = f"{CLASHING}, tree string, leaf string, leaves string, part__ string, proof string, tampered string, `index` string"
    rows = odd_rows(12, 1)
    extra = tuple("x" for _ in names.split(","))
    docs = spark.createDataFrame([r + extra for r in rows], f"{DOCS}, {names}")
    assert sorted(rows_of(verify_documents(docs)), key=repr) == plain(rows)
    assert rows_of(verify_documents(spark.createDataFrame([], DOCS))) == []


def test_proofs_lead_to_the_root_and_the_log_is_in_postorder(spark):
    rows = [(i, f"t{i}", "en", "s", 2) for i in range(80)] + [(200, "u", "de", "s", 1)]
    manifest = build_manifest(spark.createDataFrame(rows, DOCS), 1)
    root = manifest.top.roots.first().digest
    for row in proofs(manifest).collect():
        assert fold(row.leaf, row.proof) == root
        assert fold(H("forged"), row.proof) != root
    log = [(r["position"], r["level"], r["index"]) for r in manifest.log.rows().filter("tree = '=en'").collect()]
    assert [(level, index) for _, level, index in sorted(log)] == plain_log(80, height(80) + 1)


def test_one_key_with_most_rows_is_ranked_over_many_ranges(spark):
    rows = [(("hot" if i % 10 else f"k{i}"), (i * 7919) % 1000) for i in range(1000)] + [(None, 3), (None, 1)]
    ranked = with_ordinal(spark.createDataFrame(rows, "k string, v int").repartition(6), ["k"], ["v"], "at", "n")
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    expected = {(k, v): (i, len(vs)) for k, vs in groups.items() for i, v in enumerate(sorted(vs))}
    assert {(r.k, r.v): (r.at, r.n) for r in ranked.collect()} == expected


@needs_data
def test_manifest_rows_equal_the_sql(spark):
    found = queries.op13_merkle_manifest(spark, SF)
    got = sorted(repr(list(row)) for row in found.collect())
    assert got == oracle_rows(queries.oracle_sql()["op13_merkle_manifest"], found.columns)
