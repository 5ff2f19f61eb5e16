"""Exact and near duplicates, mixing, packing, token totals."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_samples import DOCS, SF, documents, frame_of, needs_data, oracle_rows, rows_of, table, text_table
from pyspark.sql import functions as F

from faultline.llm import queries
from faultline.llm.bag_minhash import (
    WordHashes,
    drop_near_duplicates,
    near_duplicates,
    shingle_bag,
    signatures,
    similarity,
)
from faultline.llm.components import components
from faultline.llm.exact_dedup import drop_copies, exact_dedup, frequent, merge_counts
from faultline.llm.mixing import _laid, apply_mix, apportion, mix, source_targets
from faultline.llm.packing import _pack_pieces, pack, pack_documents, steps
from faultline.llm.token_rollups import DELETE, INSERT, REVISE, TokenRollups
from faultline.llm.words import word_encoder

ODD = [(5, "Aa"), (9, "aA"), (9, "aA"), (None, "aa"), (3, None), (4, ""), (7, "É"), (8, "é"), (None, None)]


def test_exact_dedup_of_odd_rows(spark):
    found = exact_dedup(documents(spark, ODD, clash=True)).collect()
    assert len(found) == len(ODD)
    kept = [(r.doc_id, r.group_size) for r in found if r.kept]
    assert sorted(kept) == [(4, 3), (7, 1), (8, 1), (9, 4)]
    assert {r.keep_id for r in found if r.group_size == 4} == {9}


def test_exact_dedup_of_an_empty_table_and_null_ids(spark):
    assert rows_of(exact_dedup(spark.createDataFrame([], DOCS))) == []
    found = exact_dedup(documents(spark, [(None, "x"), (None, "x")])).collect()
    assert [r.keep_id for r in found] == [None, None] and sum(r.kept for r in found) == 1


@pytest.mark.parametrize("counters", [1, 2, 5, 1000])
def test_exact_dedup_does_not_depend_on_the_counters(spark, counters):
    rng = random.Random(counters)
    rows = [(i, "hot" if rng.random() < 0.4 else f"t{rng.randrange(40)}") for i in range(500)]
    groups = defaultdict(list)
    for i, text in rows:
        groups[text].append(i)
    expected = sorted((i, max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in rows)
    found = exact_dedup(documents(spark, rows).repartition(7), counters)
    assert sorted(tuple(r)[:4] for r in found.collect()) == expected


def test_frequent_values_are_never_missed(spark):
    rng = random.Random(1)
    values = ["a"] * 300 + ["b"] * 120 + [f"v{rng.randrange(500)}" for _ in range(600)]
    rng.shuffle(values)
    frame = spark.createDataFrame([(v,) for v in values], "v string").repartition(9)
    found = {r.v for r in frequent(frame, "v", 19).collect()}
    assert {"a", "b"} <= found and len(found) <= 20
    summary = merge_counts(Counter({"a": 5, "b": 1}), {"c": 2}, 2)
    assert summary == Counter({"a": 4, "c": 1})


def test_drop_copies_keeps_columns_and_one_of_repeated_rows(spark):
    kept = drop_copies(documents(spark, ODD, clash=True))
    assert sorted(r.doc_id for r in kept.collect()) == [4, 7, 8, 9] and len(kept.columns) == 29


@needs_data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal_the_sql(spark, name):
    found = queries.queries()[name](spark, SF)
    expected = oracle_rows(queries.oracle_sql()[name], found.columns)
    assert sorted(repr(list(r)) for r in found.collect()) == expected


# Near duplicates.


def test_signature_agreement_estimates_weighted_similarity():
    hashes, rng = WordHashes(), random.Random(3)
    base = [f"w{rng.randrange(300)}" for _ in range(250)]
    bags = [shingle_bag(base, hashes)]
    for k in range(1, 40):
        words = list(base)
        for _ in range(k):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        bags.append(shingle_bag(words + words[:60] * (k % 4), hashes))
    found = signatures(bags, 1500)
    for bag, row in zip(bags, found, strict=True):
        assert abs((row == found[0]).mean() - similarity(bags[0], bag)) < 0.06
    alone = np.vstack([signatures([bag], 1500) for bag in bags])
    assert (alone == found).all()


def test_counts_matter():
    hashes = WordHashes()
    once, often = shingle_bag(list("abcdefg"), hashes), shingle_bag(list("abcdefg") * 30, hashes)
    assert similarity(once, often) < 0.1
    found = signatures([once, often], 800)
    assert abs((found[0] == found[1]).mean() - similarity(once, often)) < 0.05


def bag(text):
    words = text.lower().split()
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def classes(texts):
    """Smallest id of the component of each id, by comparing all pairs that share a shingle."""
    bags = {i: bag(t) for i, t in texts.items()}
    by_shingle = defaultdict(list)
    for i, b in bags.items():
        for shingle in b or [()]:
            by_shingle[shingle].append(i)
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in {(x, y) for own in by_shingle.values() for k, x in enumerate(own) for y in own[k + 1 :]}:
        common = sum((bags[x] & bags[y]).values())
        total = sum(bags[x].values()) + sum(bags[y].values()) - common
        if bags[x] == bags[y] or common / total >= 0.8:
            a, b = root(x), root(y)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}


@needs_data
def test_near_duplicates_equal_brute_force(spark):
    found = {r.doc_id: r.class_id for r in queries.op7_bag_minhash(spark, SF).collect()}
    assert found == classes(text_table())


def test_near_duplicates_of_a_dense_group(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(200)}" for _ in range(120)]
    texts = {}
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
        texts[i] = " ".join(words)
    found = {r.doc_id: r.class_id for r in near_duplicates(documents(spark, list(texts.items()))).collect()}
    assert found == classes(texts)


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE  two"), (6, long), (7, long + " more"), (7, long), (None, long), (None, "alone")]
    found = near_duplicates(documents(spark, rows, clash=True)).collect()
    assert Counter((r.class_id, r.class_size) for r in found) == Counter(
        {(1, 3): 3, (4, 2): 2, (6, 4): 4, (None, 1): 1}
    )
    kept = drop_near_duplicates(documents(spark, rows, clash=True)).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 4, 6]
    assert rows_of(near_duplicates(spark.createDataFrame([], DOCS))) == []


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 200), (300, 200), (7, 7)]
    found = dict(rows_of(components(spark.createDataFrame(links, "a long, b long"))))
    assert found == {**{k: 1 for k in range(1, 41)}, 100: 100, 200: 100, 300: 100}


# Mixing.


def dealt(weights, seats, most):
    """Seats one by one to the highest quotient."""
    got = [0] * len(weights)
    for _ in range(seats):
        free = [k for k in range(len(weights)) if got[k] < most[k] and weights[k] > 0]
        if not free:
            break
        got[max(free, key=lambda k: (weights[k] / (2 * got[k] + 1), -k))] += 1
    return got


@pytest.mark.parametrize("seed", range(6))
def test_apportion_deals_seats_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], {}
    for group in range(4):
        n = rng.randrange(1, 9)
        weights = [rng.choice([0, 1, 5, 17, rng.randrange(1, 400)]) for _ in range(n)]
        most = [w * 2 + 3 for w in weights] if seed % 2 else [w for w in weights]
        seats = rng.randrange(0, max(1, min(sum(most), 60)))
        for k, (w, m, got) in enumerate(zip(weights, most, dealt(weights, seats, most), strict=True)):
            rows.append((group, k, w, seats, m))
            expected[group, k] = got
    frame = spark.createDataFrame(rows, "g int, k int, w long, seats long, most long")
    found = {(r.g, r.k): r.q for r in apportion(frame, ["g"], ["k"], "w", "seats", "most", "q").collect()}
    assert found == expected


def filled(sizes):
    """Targets by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {**target, **{s: weight[s] * level for s in open_}}
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 900, None: 5}, {"x": 7}, {"a": 0, "b": 50}, {c: 3 ** k for k, c in enumerate("abcdefg")}])
def test_targets_are_water_levels(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in source_targets(frame).collect()}
    assert found == pytest.approx(filled(sizes))


def test_mix_of_odd_rows(spark):
    rows = [(k, "a b c d e f " * (k % 40 + 1), ("p", "q", None)[k % 3]) for k in range(300)]
    rows += [(1000, None, "p"), (1001, "", None), (1002, " \t", "q"), (1003, "w " * 20000, "q"), (None, "x y z", "p"), (5, rows[5][1], "q")]
    docs = documents(spark, rows, clash=True)
    found = frame_of(mix(docs))
    assert len(found) == len(rows)
    assert (found["taken"] <= 3 * found["size"]).all() and (found["taken"] >= 0).all()
    sums = found.assign(source=found["source"].fillna("~")).groupby("source").agg(t=("target", "first"), k=("taken", "sum"))
    assert ((sums["k"] - sums["t"]).abs() <= 64).all()
    again = frame_of(mix(docs.repartition(5)))
    order = ["size", "taken", "doc_id"]
    assert found.sort_values(order)[order].values.tolist().__repr__() == again.sort_values(order)[order].values.tolist().__repr__()
    mixed = frame_of(apply_mix(docs))
    words = mixed["text"].str.split().str.len().groupby(mixed["source"].fillna("~")).sum()
    longest = found["size"].groupby(found["source"].fillna("~")).max()
    assert (abs(words - sums["k"]) < longest).all()
    assert set(mixed["text"]) <= {text for _, text, _ in rows}
    once = found[~found["doc_id"].isin([5])].set_index("doc_id")
    copies = mixed[mixed["doc_id"].isin(once.index)].groupby("doc_id", dropna=False).size()
    assert copies.max() <= 3 and not {1000, 1001, 1002} & set(copies.index)
    remixed = frame_of(apply_mix(docs.repartition(5)))
    assert sorted(map(repr, zip(mixed["doc_id"], mixed["text"]))) == sorted(map(repr, zip(remixed["doc_id"], remixed["text"])))
    assert rows_of(mix(spark.createDataFrame([], DOCS))) == []
    assert rows_of(apply_mix(spark.createDataFrame([], DOCS))) == []


def test_small_shards_still_meet_the_target(spark):
    rows = [(k, "w " * (k % 90), f"s{k % 4}") for k in range(800)]
    found = frame_of(mix(documents(spark, rows), words_per_shard=300))
    sums = found.groupby("source").agg(t=("target", "first"), k=("taken", "sum"))
    assert ((sums["k"] - sums["t"]).abs() <= 64).all() and (found["taken"] <= 3 * found["size"]).all()


def test_mixed_texts_are_whole_and_shards_near_their_quotas(spark):
    rng = random.Random(12)
    rows = [(k, " ".join(f"d{k}w{i}" for i in range(rng.randrange(1, 400))), f"s{rng.choice([0, 0, 0, 1, 2])}") for k in range(300)]
    docs = documents(spark, rows)
    whole = {k: text for k, text, _ in rows}
    for options in ({}, {"words_per_shard": 2000}):
        laid, mixed = frame_of(_laid(docs, **options)), frame_of(apply_mix(docs, **options))
        assert all(whole[k] == text for k, text in zip(mixed["doc_id"], mixed["text"], strict=True))
        place = laid.set_index("doc_id")[["source_no", "shard", "size"]]
        keys = ["source_no", "shard"]
        words = mixed.join(place, on="doc_id").groupby(keys)["size"].sum()
        quotas = laid.groupby(keys)["taken"].sum()
        longest = laid.groupby(keys)["size"].max()
        assert (words.reindex(quotas.index, fill_value=0) - quotas).abs().lt(longest).all()
        assert len(quotas) > 10 or not options
        # Down-weighted sources lose documents, no ends of documents; up-weighted ones hold each at least once.
        sizes = laid.groupby("source").agg(t=("target", "first"), s=("size", "sum"))
        for source, row in sizes.iterrows():
            copies = mixed[mixed["source"] == source].groupby("doc_id").size()
            own = sum(s == source for *_, s in rows)
            assert len(copies) == own if row.t > row.s + 400 else len(copies) < own


def test_a_document_beyond_a_shard_is_taken_in_proportion(spark):
    """Sources of one document each: it is taken whole or not at all, as often as its target is of its size."""
    docs = documents(spark, [(k, "w " * 64, f"s{k:04}") for k in range(600)])
    found, mixed = frame_of(mix(docs)), frame_of(apply_mix(docs))
    copies = mixed.groupby("doc_id").size().reindex(range(600), fill_value=0)
    assert set(copies) <= {0, 1, 2} and set(mixed["text"]) == {"w " * 64}
    assert abs(copies.sum() * 64 - found["taken"].sum()) < 0.1 * found["taken"].sum()


@needs_data
def test_mixing_meets_targets_and_is_native(spark):
    frame = queries.op4_mixing(spark, SF)
    found, docs = frame_of(frame), table("documents")
    sizes = docs["text"].fillna("").str.count(r"[^\x20\x09-\x0D]+")
    assert dict(zip(docs["doc_id"], sizes, strict=True)) == dict(zip(found["doc_id"], found["size"], strict=True))
    both = found.merge(docs[["doc_id", "source"]], on="doc_id")
    sums = both.groupby("source").agg(t=("target", "first"), k=("taken", "sum"), s=("size", "sum"))
    assert sums["t"].to_dict() == pytest.approx(filled(sums["s"].to_dict()))
    assert ((sums["k"] - sums["t"]).abs() <= 64).all()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# Packing and tokens.


def test_the_word_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = queries.WORD_TOKENIZER
    tokenizer, encode = Tokenizer.from_file(path), word_encoder(path)
    rng = random.Random(4)
    texts = [
        "", "a<|endoftext|>b", "<|ENDOFTEXT|> x", "it's don't WON'T", "Σας ΟΔΟΣ İx", "école café ́", "x\ty z\x1cq",
        "!!!,, 12345 a1b2", "ﬁ ﬀ", ". ,", "don't.", "ß SS ẞ.", "'s's 'll,", "日本 語。", "áb Å ǅ", "éa. ÉA", " a b",
    ]
    texts += ["".join(rng.choice("abÉé .,!'\n\t1ßΣ<|") for _ in range(60)) for _ in range(300)]
    for text in texts:
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(8))
def test_packing_fills_every_window(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, rng.randrange(1, 600), rng.randrange(1, 20000)]) for _ in range(rng.randrange(0, 200))]
    windows, left = pack(lengths)
    assert not left
    covered = defaultdict(list)
    for tier, pieces in windows:
        assert sum(n for n, _, _ in pieces) == tier and tier & (tier - 1) == 0 and tier <= 4096
        for n, doc, start in pieces:
            covered[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(covered[doc]):
            assert start == at
            at += length
        assert at == n
    kept, left = _pack_pieces([(n, k, 0) for k, n in enumerate(lengths)], (4096, 2048, 1024, 512), False)
    assert sum(tier for tier, _ in kept) + sum(n for n, _, _ in left) == sum(lengths)
    groups = steps(windows)
    assert len(groups) == len(windows)


def check_pieces(pieces, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.WORD_TOKENIZER)
    expected = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], dtype="<u4") for i, t in texts.items()}
    own = defaultdict(list)
    for r in pieces:
        own[r.doc_id].append(r)
    assert set(own) == set(expected)
    for i, ids in expected.items():
        at = 0
        for r in sorted(own[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    windows = defaultdict(list)
    for r in pieces:
        windows[r.sequence_id].append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0


@needs_data
def test_packing_of_documents_round_trips(spark):
    check_pieces(queries.op6_packing(spark, SF).collect(), text_table())


def test_packing_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 30000), (4, "é ß.")]
    docs = documents(spark, rows, clash=True)
    check_pieces(pack_documents(docs, queries.WORD_TOKENIZER, buffer_tokens=1000).collect(), {i: t or "" for i, t in rows})
    twice = pack_documents(docs.union(docs), queries.WORD_TOKENIZER).collect()
    assert sum(r.length for r in twice if r.doc_id == 4) == 2 * next(r.doc_tokens for r in twice if r.doc_id == 4)
    assert [r.length for r in pack_documents(documents(spark, [(None, None)]), queries.WORD_TOKENIZER).collect()] == [1]
    assert rows_of(pack_documents(spark.createDataFrame([], DOCS), queries.WORD_TOKENIZER)) == []


# Token totals.

CHANGES = "doc_id long, source string, lang string, version string, tokens long, action string"


def test_rollups_follow_a_history(spark, tmp_path):
    rollups = TokenRollups(spark, f"file://{tmp_path}/r")
    assert rows_of(rollups.totals()) == []
    rng, state = random.Random(2), {}
    for batch in range(6):
        rows = {}
        for _ in range(60):
            key = (rng.randrange(40), rng.choice(["v1", "v2"]))
            action = rng.choice([INSERT, REVISE, DELETE])
            rows[key] = (key[0], rng.choice(["a", "b", None]), rng.choice(["en", None]), key[1], rng.randrange(100), action)
        frame = spark.createDataFrame([*rows.values(), (None, "a", "en", "v1", 5, INSERT), (1, "a", "en", None, 5, INSERT)], CHANGES)
        assert rollups.commit(f"b{batch}", frame)
        assert not rollups.commit(f"b{batch}", frame)
        for key, row in rows.items():
            if row[5] == DELETE:
                state.pop(key, None)
            else:
                state[key] = row
        expected = defaultdict(lambda: [0, 0])
        for (_, version), row in state.items():
            expected[row[1], row[2], version][0] += 1
            expected[row[1], row[2], version][1] += row[4]
        found = {(r.source, r.lang, r.version): [r.docs, r.tokens] for r in rollups.totals().collect()}
        assert found == dict(expected)


def test_rows_of_one_batch_and_an_unfinished_batch(spark, tmp_path):
    rollups = TokenRollups(spark, f"file://{tmp_path}/r")
    rows = [(1, "a", "en", "v", 3, INSERT), (1, "a", "en", "v", 3, INSERT), (1, "b", "en", "v", 9, INSERT), (1, "a", "en", "v", 0, DELETE), (2, "a", "en", "v", None, INSERT)]
    frame = spark.createDataFrame(rows, CHANGES)
    # A batch whose commit record is missing has no effect, and is written anew.
    rollups.signed(frame).write.parquet(f"{rollups.folder}/ledger/b1")
    assert rows_of(rollups.totals()) == []
    assert rollups.commit("b1", frame.withColumn("sign", F.lit("x")).withColumn("row", F.lit("x")))
    assert sorted(rows_of(rollups.totals())) == [("a", "en", "v", 1, 0), ("b", "en", "v", 1, 9)]
    assert rollups.commit("b2", frame.limit(0))
    assert sorted(rows_of(rollups.totals())) == [("a", "en", "v", 1, 0), ("b", "en", "v", 1, 9)]


@needs_data
def test_rollups_of_documents_equal_a_recount(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.WORD_TOKENIZER)
    docs = table("documents")
    docs = docs[docs["doc_id"].isin(docs.groupby("text")["doc_id"].min())]
    expected = defaultdict(lambda: [0, 0])
    for source, lang, text in zip(docs["source"], docs["lang"], docs["text"], strict=True):
        text = "\n".join(dict.fromkeys(text.split("\n")))
        counts = {"word_bpe_49k": len(tokenizer.encode(text, add_special_tokens=False).ids), "words": len(text.split())}
        for version, n in counts.items():
            expected[source, lang, version][0] += 1
            expected[source, lang, version][1] += n
    found = {(r.source, r.lang, r.version): [r.docs, r.tokens] for r in queries.op9_token_rollups(spark, SF).collect()}
    assert found == dict(expected)
