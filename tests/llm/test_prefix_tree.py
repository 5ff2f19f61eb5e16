"""The similarity join of shingle sets against all pairs."""

import random
import re

import numpy as np
import pytest
from llm_samples import DOCS, SF, documents, needs_data, oracle_rows, text_table

from faultline.llm import prefix_tree, queries
from faultline.llm.prefix_tree import Trie, linked, needed, prefix_length, shingle_set, similar_sets


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text), from all pairs."""
    sets = [grams(text) for _, text, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_gram = {}
    for i, own in enumerate(sets):
        for g in own:
            by_gram.setdefault(g, []).append(i)
    pairs = {(a, b) for at in by_gram.values() for a in at for b in at if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[root(i)] = min(least.get(root(i), row[0]), row[0])
    return sorted(((row[0], len(sets[i]), least.get(root(i)) if sets[i] else row[0]) for i, row in enumerate(rows)), key=repr)


def joined(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_sets(frame).collect()), key=repr)


def test_needed_overlap_and_prefixes():
    for a in range(1, 60):
        for b in range(1, 60):
            least = next((o for o in range(min(a, b) + 1) if 100 * o >= 80 * (a + b - o)), None)
            assert least is None or needed(a, b) == least
            if least is not None:
                # Outside their prefixes alone two sets cannot share enough.
                assert min(a - prefix_length(a), b - prefix_length(b)) < least


@pytest.mark.parametrize("seed", range(20))
def test_tries_find_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = np.sort(rng.choice(2**62, 40, replace=False).astype(np.uint64))
    sets = []
    for _ in range(60):
        kept = base[rng.random(len(base)) < rng.choice([0.5, 0.9, 0.95, 1.0])][: rng.integers(1, 41)]
        sets.append(np.unique(np.concatenate([kept, rng.choice(2**62, rng.integers(0, 4)).astype(np.uint64)])))
    sets = [s for s in sets if len(s)]
    trie = Trie(sets[:35])
    found = {(i, j) for i, near in trie.matches(sets) for j in near.tolist()}
    assert found == {(i, j) for i in range(35) for j in range(len(sets)) if linked(sets[i], sets[j])}


def corpus(seed, n=220):
    """Texts of some families of copies, edited until their similarity lies on both sides of 0.8, and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["The", "the", "É", "of"] * 20
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, families = [], [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 9, 40, 120, 300]))] for _ in range(9)]
    for i in range(n):
        words = list(rng.choice(families[:3] if i % 2 else families))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 6, 9])):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.choice([0, 1, 1])] = [rng.choice(vocabulary)]
        if rng.random() < 0.3:
            words += passage[: rng.choice([10, 60])]
        rows.append((i + 1, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


ODD = [(None, "a b c"), (None, "A B C"), (1, None), (2, ""), (3, " \n "), (7, "a b c"), (7, "a b c"), (7, "other words"), (4, "é"), (5, "É")]


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_those_of_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_tree, "HELD", 512 if seed % 2 else 7)
    rows = corpus(seed) + ODD + [(1000 + i, "same text of a large group of copies " * 9) for i in range(60)]
    rng = random.Random(seed)
    rng.shuffle(rows)
    assert joined(documents(spark, rows, clash=True).repartition(6)) == plain_components(rows)


def test_a_chain_is_one_component_and_long_texts_count_whole(spark):
    rng = random.Random(5)
    words = [f"v{rng.randrange(10**6)}" for _ in range(30_000)]
    chain = [words[50 * k : 50 * k + 600] for k in range(12)]
    rows = [(20 + k, " ".join(c)) for k, c in enumerate(chain)] + [(90, " ".join(words)), (91, " ".join(words[:-2000] + ["end"]))]
    assert joined(documents(spark, rows)) == plain_components(rows)


def test_rows_that_all_share_one_id(spark):
    rows = [(7, f"text number {i} of many with one id and nothing else in common {i * i}") for i in range(300)]
    assert joined(documents(spark, rows)) == plain_components(rows)


def test_empty_table(spark):
    assert similar_sets(spark.createDataFrame([], DOCS)).collect() == []


def test_words_end_at_ascii_space_only():
    hashes = prefix_tree.WordHashes()
    one, two = (shingle_set(t.encode(), hashes) for t in ("A\u00a0 b c\u2003d e F", "a\u00a0\tB \x0b C\u2003D\re f"))
    assert one.tolist() == two.tolist() and len(one) == 1
    assert shingle_set("É a".encode(), hashes).tolist() != shingle_set("é a".encode(), hashes).tolist()


@needs_data
def test_given_documents(spark):
    found = queries.op12_prefix_tree(spark, SF)
    got = found.collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == plain_components(list(text_table().items()))
    assert sorted(repr(list(r)) for r in got) == oracle_rows(queries.oracle_sql()["op12_prefix_tree"], found.columns)
