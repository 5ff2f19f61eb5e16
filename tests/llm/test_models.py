"""Personal data, nearest neighbours, quality, toxicity, main text, and the pipeline."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm_samples import DOCS, SF, documents, frame_of, needs_data, rows_of, table, text_table

import corpus_pipeline
from faultline.llm import neighbours, pii, queries
from faultline.llm.common import checkpointed
from faultline.llm.html_text import extract_pages, main_text
from faultline.llm.labelled import labelled_sample
from faultline.llm.neighbours import SHARD_NUMBERS, SHARDS, _by_shard, build_index, every_twentieth, search_index, shards_of
from faultline.llm.pii import find_personal_data, redact
from faultline.llm.quality import kinds_of, learn, score_quality, terms
from faultline.llm.toxicity import Machine, drop_toxic, kernel_map, plain_words, score_toxicity, train, triples

LABELS = "doc_id long, quality int, toxic int"


# Personal data.


def luhn(digits):
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text):
    """By the fixed patterns as they are stated."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = []
    for kind, pattern in patterns.items():
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            if kind == "ip":
                good = all(int(part) <= 255 for part in match[0].split("."))
            elif kind == "card":
                good = 16 <= len(digits) <= 19 and luhn(digits)
            else:
                good = kind == "email" or 8 <= len(digits) <= 15
            if good:
                found.append((kind, match.start(), match.end()))
    return found


def check_spans(found, texts):
    for row in found:
        base = base_spans(texts[row.doc_id])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row.base_sha256 == hashlib.sha256(written.encode()).hexdigest(), row
        assert row.spans == written or row.spans.startswith(written)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [
            sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")
        ]


def test_spans_of_awkward_texts(spark):
    rng = random.Random(6)
    texts = [
        None, "", "a@b.c_d@e.f x@y", "é me@mail.example.com.", "1.2.3.4.5.6.7.8 256.1.1.1 000000255.1.1.1", "9" * 30000,
        "1 " * 20000, "a" * 60000, "x@" + "b." * 9000 + "c", "+1 (555) 123-4567 +1 +12345678901234567 + 1", "4111 1111 1111 1111, 4111-1111-1111-1112",
        "4111111111111111 4111111111111111", "中+49 30 1234567é 1.2.3.4@5.6",
    ]
    texts += ["".join(rng.choice("ab1234.@+- ()é\n") for _ in range(200)) for _ in range(150)]
    rows = list(enumerate(texts))
    found = find_personal_data(documents(spark, rows, clash=True)).collect()
    assert len(found) == len(rows)
    check_spans(found, {i: t or "" for i, t in rows})
    assert rows_of(find_personal_data(spark.createDataFrame([], DOCS))) == []
    assert len(rows_of(find_personal_data(documents(spark, [(None, "a@b.c")] * 3)))) == 3


@needs_data
def test_personal_data_of_documents_is_native_and_finds_secrets(spark):
    frame = queries.op3_pii(spark, SF)
    check_spans(frame.collect(), text_table())
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_trees_of_personal_data_learn_from_all_candidates(spark, monkeypatch):
    learnt = []

    class Classifier(pii.GBTClassifier):
        def fit(self, rows):
            learnt.append(rows.select(F.sum("n")).first()[0])
            return super().fit(rows)

    monkeypatch.setattr(pii, "GBTClassifier", Classifier)
    texts = [(i, f"token={i:04}abcdefgh12 call +1 555 123 {i:04} or 12.34.56.78.90 me@x.org n=abcdefghijklmn. " * 200) for i in range(50)]
    found = pii.found_spans(documents(spark, texts)).cache()
    model, thresholds = pii.fit(found)
    wanted = found.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 3").agg(F.sum(F.size("candidates"))).first()[0]
    assert found.agg(F.sum(F.size("candidates"))).first()[0] > 20_000
    assert learnt == [wanted] and thresholds


def test_redaction(spark):
    rows = [(1, "mail me@x.org or call +1 555 123 4567."), (2, None), (3, "nothing")]
    found = {r.doc_id: r.text for r in redact(documents(spark, rows)).collect()}
    assert found == {1: "mail [email] or call [phone].", 2: "", 3: "nothing"}


# Nearest neighbours.


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, node string, rank string")


def nearest(rows, query_ids, n=20):
    """Exact answers by brute force."""
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], dtype=np.float64)
    found = {}
    for q in query_ids:
        scores = x @ x[ids.index(q)]
        order = sorted((k for k in range(len(ids)) if ids[k] != q), key=lambda k: (-scores[k], ids[k]))
        found[q] = [ids[k] for k in order[:n]]
    return found


def recall(found, expected):
    by_query = found.groupby("query_id")["vec_id"].agg(set)
    return np.mean([len(by_query[q] & set(own)) / len(own) for q, own in expected.items()])


@needs_data
def test_neighbours_of_the_embeddings(spark):
    data = table("embeddings")
    rows = list(zip(data["vec_id"].tolist(), [list(map(float, v)) for v in data["embedding"]], strict=True))
    found = frame_of(queries.op2_neighbours(spark, SF))
    expected = nearest(rows, [i for i, _ in rows if i % 20 == 0])
    assert recall(found, expected) >= 0.9 and len(found) == sum(map(len, expected.values()))
    place = dict(rows)
    for row in found.head(50).itertuples():
        assert row.score == pytest.approx(np.dot(np.array(place[row.query_id]), np.array(place[row.vec_id])), rel=1e-12)


def test_neighbours_over_several_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.5, 2.0, size=(900, 1))
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]
    frame = vectors(spark, rows)
    index = build_index(frame, block=200)
    assert index.blocks >= 5
    found = frame_of(search_index(index, frame.filter("vec_id % 20 = 0"), beam=150))
    assert recall(found, nearest(rows, range(0, 900, 20))) >= 0.9


def test_rounds_go_on_until_the_links_are_followed(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(1500, 12)) * rng.uniform(0.5, 2.0, size=(1500, 1))).astype(np.float32).astype(np.float64)
    index = build_index(vectors(spark, [(k, v.tolist()) for k, v in enumerate(x)]), block=75)
    assert index.blocks >= 20
    square = (x * x).sum(axis=1)
    rest = np.sqrt(square.max() - square)
    distance = square[:, None] + square - 2 * x @ x.T + (rest[:, None] - rest) ** 2
    np.fill_diagonal(distance, np.inf)
    vec_id = {row.node: row.vec_id for row in index.members.collect()}
    linked = {(vec_id[row.node], vec_id[near]) for row in index.links.collect() for near in row.near}
    near = np.argsort(distance, axis=1)[:, :20]
    assert np.mean([(a, b) in linked for a in range(1500) for b in near[a].tolist()]) >= 0.97


def test_one_very_long_vector_leaves_the_others_their_neighbours(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(1000, 12)) * rng.uniform(0.5, 2.0, size=(1000, 1))).astype(np.float32).astype(np.float64)
    x[7] *= 1e4 * np.linalg.norm(x, axis=1).mean() / np.linalg.norm(x[7])
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]
    frame = vectors(spark, rows)
    found = frame_of(search_index(build_index(frame, block=100), frame.filter("vec_id % 20 = 0"), beam=100))
    assert recall(found, nearest(rows, range(0, 1000, 20))) >= 0.95


def test_neighbours_in_rounds_of_small_cells(spark):
    """Cells hold few of the true neighbours; the rounds have to find them."""
    x = np.random.default_rng(8).normal(size=(6000, 24)).astype(np.float32).astype(np.float64)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    frame = vectors(spark, rows)
    index = build_index(frame, block=100)
    assert index.blocks >= 60
    found = frame_of(search_index(index, frame.filter("vec_id % 20 = 0")))
    assert recall(found, nearest(rows, range(0, 6000, 20))) >= 0.95


def test_requests_of_a_query_do_not_grow_with_the_cells(spark):
    def asked(cells):
        wanted = [(cell << 32) + place for cell in range(cells) for place in range(1, 1025, 1024 * 24 // (cells * 20))]
        requests = spark.createDataFrame([(a, b"", 0.0, wanted) for a in range(3)], "a long, v binary, least double, wanted array<long>")
        kind = "shard int, role int, id long, v binary, least double, wanted array<long>"
        rows = requests.mapInArrow(_by_shard(SHARDS), kind).collect()
        for a in range(3):
            assert sorted(node for r in rows if r.id == a for node in r.wanted) == sorted(wanted)
        assert all(node % SHARDS == r.shard for r in rows for node in r.wanted)
        return len(rows)

    assert max(asked(20), asked(200)) <= 3 * SHARDS
    assert shards_of(100, 10) == SHARDS and shards_of(10**9, 64) * SHARD_NUMBERS >= 64 * 10**9


def test_links_and_beams_are_kept_as_arrays(spark, monkeypatch):
    """What a round deals out is a few packed rows for each part and query, not one for each link or candidate."""
    x = np.random.default_rng(3).normal(size=(1200, 12)).astype(np.float32).astype(np.float64)
    frame = vectors(spark, [(k, v.tolist()) for k, v in enumerate(x)])
    rows = []

    def kept(frame):
        done = checkpointed(frame)
        rows.append(done.count())
        return done

    monkeypatch.setattr(neighbours, "checkpointed", kept)
    index = build_index(frame, block=100)
    parts = -(-1200 // neighbours.part_nodes_of(1200, 12))
    assert rows.count(parts) >= 3 and max(rows) <= 1200
    rows.clear()
    found = frame_of(search_index(index, frame.filter("vec_id % 20 = 0"), beam=150))
    assert max(rows) <= 60 * 31 and recall(found, nearest(list(enumerate(x.tolist())), range(0, 1200, 20))) >= 0.9


def test_neighbours_of_equal_vectors_and_of_one(spark):
    assert rows_of(every_twentieth(vectors(spark, [(0, [1.0, 2.0])]))) == []
    rows = [(k, [1.0, 2.0]) for k in range(30)]
    found = frame_of(every_twentieth(vectors(spark, rows)))
    assert found["vec_id"].tolist() == nearest(rows, [0])[0] + nearest(rows, [20])[20]


def test_neighbours_where_queries_have_another_size(spark):
    rows = [(k, [1.0, float(k), 2.0, 3.0]) for k in range(1, 60) if k % 20] + [(20, [1.0, 2.0, 3.0]), (40, [1.0, 2.0, 3.0])]
    assert rows_of(every_twentieth(vectors(spark, rows))) == []
    rows.append((100, [1.0, 1.0, 1.0, 1.0]))
    found = frame_of(every_twentieth(vectors(spark, rows)))
    assert found["vec_id"].tolist() == nearest([r for r in rows if len(r[1]) == 4], [100])[100]


def test_neighbours_of_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [(k, [1.0, 2.0]) for k in range(40)] + [(100 + k, [2.0, float(k)]) for k in range(3)]
    odd = [(60, None), (80, [0.0, 0.0]), (120, [nan, 1.0]), (140, [inf, 1.0]), (160, [None, 1.0]), (None, [1.0, 1.0]), (180, [1.0])]
    found = frame_of(every_twentieth(vectors(spark, rows + odd + rows[:5])))
    expected = nearest(rows, [0, 20, 100])
    assert {q: own.sort_values("rank")["vec_id"].tolist() for q, own in found.groupby("query_id")} == expected
    assert rows_of(every_twentieth(vectors(spark, []))) == []
    assert len(rows_of(every_twentieth(vectors(spark, [(0, [1.0, 1.0]), (1, [1.0, 0.5])])))) == 1


# Quality.


@needs_data
def test_quality_on_held_out_documents(spark):
    found = frame_of(queries.op5_quality(spark, "/root/testdata/sf0.01"))
    from llm_samples import duckdb

    labels = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").df()
    both = found.merge(labels, on="doc_id")
    out = both[both["held_out"]]
    assert len(out) > 50 and (out["predicted"] == out["quality"]).mean() >= 0.95
    assert found["score"].between(0, 1).all()


def test_quality_of_odd_rows(spark):
    good = " ".join(f"Word{k} follows another, as words do." for k in range(30))
    rows = [(k, good[k:]) for k in range(20)] + [(100 + k, "BUY!! NOW!! " * (40 + k)) for k in range(20)]
    rows += [(200, None), (201, ""), (202, "x" * 100_000), (203, good), (203, good), (None, good), (204, "漢字 " * 50)]
    labels = spark.createDataFrame([(i, int(i < 100), None) for i, _ in rows[:40]] + [(None, 1, 1), (5, None, None)], LABELS)
    found = frame_of(score_quality(documents(spark, rows, clash=True), labels))
    assert len(found) == len(rows) and found["score"].between(0, 1).all()
    assert found.set_index("doc_id")["score"][203].min() > 0.9 > 0.1 > found.set_index("doc_id")["score"][105]
    assert rows_of(score_quality(spark.createDataFrame([], DOCS), labels)) == []
    unlabelled = frame_of(score_quality(documents(spark, rows[:3]), labels.limit(0)))
    assert unlabelled["score"].tolist() == [0.5] * 3


def test_kinds_of_other_scripts():
    assert kinds_of("Где 3?\n").tolist() == kinds_of("Abc 3?\n").tolist()
    assert kinds_of("漢字。٣").tolist() == kinds_of("ab§3").tolist()
    assert (terms("Где же дом") == terms("Abc de fgh")).all() and (terms("Где") != terms("???")).any()


def test_a_sample_has_one_row_of_each_labelled_id(spark):
    rows = [(k % 7, f"text {k}") for k in range(70)] + [(1, None), (None, "x")]
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(7)] * 2, LABELS)
    found = rows_of(labelled_sample(documents(spark, rows), labels, "quality", 4, -1, {0: 5, 1: 5}))
    again = rows_of(labelled_sample(documents(spark, rows[::-1]), labels, "quality", 4, -1, {0: 5, 1: 5}))
    assert sorted(row[0] for row in found) == list(range(7)) and sorted(found) == sorted(again)


def test_votes_are_exact_cosines():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abC 1!|\n.") for _ in range(rng.randrange(5, 200))) for _ in range(120)]
    x, y = np.stack([terms(t) for t in texts]), np.array([k % 2 for k in range(120)])
    space = learn(x, y)
    points = space.place(x).astype(np.float64)
    for k in range(0, 120, 17):
        cosines = points @ points[k]
        near = np.argsort(-cosines)[:15]
        weight = np.maximum(cosines[near], 1e-6) ** 8
        assert space.score(x[k : k + 1])[0] == pytest.approx((weight * y[near]).sum() / weight.sum(), abs=1e-3)


# Toxicity.


def test_the_kernel_counts_common_subsequences():
    words = [b"idiot", b"idxiot", b"therein", b"lull", b"abc", b"a"]

    def count(word):
        found = {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, len(word)):
                    if k - i < 7:
                        key = (word[i], word[j], word[k])
                        found[key] = found.get(key, 0) + 0.75 ** (k - i - 2)
        return found

    rows = kernel_map(words)
    counts = [count(word) for word in words]
    for a in range(len(words)):
        for b in range(len(words)):
            norm = math.sqrt(sum(v * v for v in counts[a].values()) * sum(v * v for v in counts[b].values()))
            expected = sum(v * counts[b].get(u, 0) for u, v in counts[a].items()) / norm if norm else 0
            assert float(rows[a] @ rows[b]) == pytest.approx(expected, abs=1e-5)
    assert rows[0] @ rows[1] > 0.5 > rows[0] @ rows[2]
    machine = Machine(np.random.default_rng(1).normal(size=26**3) + 1.0, -0.3)
    assert machine.score_words(words) == pytest.approx(rows @ machine.weights - 0.3, abs=1e-4)
    assert triples(3)[1] == 1.0


def test_words_are_letters_and_spelt_words_are_joined():
    assert plain_words("Ça va, I-D-I-O-T!") == [b"ca", b"va", b"idiot"]
    assert b"loser" in plain_words("you l o s e r now") and plain_words("") == [] == plain_words("漢字 123")


def test_inserted_letters_are_tolerated():
    rng = random.Random(2)
    plain = [("".join(rng.choice(["th", "er", "in", "an", "on", "re"]) for _ in range(3))).encode() for _ in range(400)]
    insults = [b"scumbag", b"moronic", b"clownish", b"stupidly"]
    bags = [[rng.choice(insults), rng.choice(insults), *rng.sample(plain, 2)] for _ in range(80)]
    machine = train(bags, plain[200:])
    scores = dict(zip(w := [b"scumbag", b"scxumbag", b"stupiqdly", b"therein", b"reoner"], machine.score_words(w), strict=True))
    assert min(scores[x] for x in w[:3]) > 0 > max(scores[x] for x in w[3:])


@needs_data
def test_toxicity_on_held_out_documents(spark):
    found = frame_of(queries.op10_toxicity(spark, "/root/testdata/sf0.01"))
    from llm_samples import duckdb

    labels = duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.01/labels.parquet'").df()
    out = found.merge(labels, on="doc_id").query("held_out")
    assert len(out) > 40 and (out["predicted"] == out["toxic"]).mean() >= 0.9
    assert found["score"].between(0, 1).all()


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(3)
    clean = [(k, " ".join(rng.choice(["plain", "words", "about", "the", "garden", "rain"]) for _ in range(40))) for k in range(80)]
    toxic = [(100 + k, text + " you wretchedfool and dimwit, dimwits all") for k, text in clean[:60]]
    odd = [(300, None), (301, ""), (302, "garden " * 30000), (303, "what a d i m w i t you are, dimwit and wretchedfool"), (303, "rain"), (None, "plain")]
    rows = clean + toxic + odd
    labels = spark.createDataFrame([(i, None, int(i >= 100)) for i, _ in clean + toxic] + [(None, 1, 1), (7, 1, None)], LABELS)
    docs = documents(spark, rows, clash=True)
    found = frame_of(score_toxicity(docs, labels))
    assert len(found) == len(rows) and found["score"].between(0, 1).all()
    known = found.dropna(subset=["doc_id"])
    assert (known[known["doc_id"].between(100, 159)]["predicted"] == 1).all()
    assert (known[known["doc_id"] < 100]["predicted"] == 0).all()
    assert found[found["doc_id"].isin([300, 301, 302])]["predicted"].tolist() == [0, 0, 0]
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == (found["predicted"] == 0).sum()
    assert rows_of(score_toxicity(spark.createDataFrame([], DOCS), labels)) == []
    assert frame_of(score_toxicity(documents(spark, rows[:2]), labels.limit(0)))["predicted"].tolist() == [0, 0]


# Main text.

ARTICLE = "This paragraph is long enough, and has commas, to be the text of an article."


@pytest.mark.parametrize(
    "html, expected",
    [
        ("", ""),
        ("   ", ""),
        ("only <b>text</b> &amp; more", "only text & more"),
        (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p><b>{ARTICLE}<br><p>Next\n  one.</article><footer>f</footer>", f"T\n{ARTICLE}\nNext one."),
        (f"<div class=ad>Buy</div><main><header><h1>T</h1></header><p>{ARTICLE}</p><p>&copy; &#233;&am</p></main>", f"T\n{ARTICLE}\n© é&am"),
        (f"<header>Site</header><div id=content><p>{ARTICLE}</p><ul><li>a<li>b</ul></div><div class='sidebar'><p>{ARTICLE}</p></div>", f"{ARTICLE}\na\nb"),
        (f"<div class=post><p>{ARTICLE}</p></div><div id=comments><p>{ARTICLE} No, no, never, I say.</p></div>", ARTICLE),
        (f"<article><p>{ARTICLE}</p><form><p>Your mail, please, now, or later</p></form><aside>x</aside></article>", ARTICLE),
        (f"<script>var t='</p><p>';</script><style>p{{}}</style><p>{ARTICLE}</p><!-- <p>no</p> --><p", ARTICLE),
        (f"<article><p>{ARTICLE}<script>never ends", ARTICLE),
        ("<p>a < b &lt; c</p>", "a < b < c"),
        (f"<div class='cookie-notice'><p>{ARTICLE}</p></div><article><p>Short.</p></article>", "Short."),
        (f"<table><tr><td>{ARTICLE}<td>two</table>", f"{ARTICLE}\ntwo"),
        (f"<div>{'<div>' * 3000}<p>{ARTICLE}</p>", ARTICLE),
        (f"<form id=f><header>Site</header><div><p>{ARTICLE}</p><p>{ARTICLE}</p></div><footer>f</footer></form>", f"{ARTICLE}\n{ARTICLE}"),
        (f"<form><nav>n</nav><article><p>{ARTICLE}</p><form><p>Mail, please</p></form></article></form>", ARTICLE),
        (f"<form><main><p>Short.</p></main><input value=x></form><form><p>{ARTICLE}<p>{ARTICLE}</form>", "Short."),
        (f"<div><p>{ARTICLE}</p><p>{ARTICLE}</p></div><form><p>{ARTICLE}</p></form>", f"{ARTICLE}\n{ARTICLE}"),
        (f"<div><p>{ARTICLE} A&<b>lt;</b> &amp;lt; <i>&l</i>t;</p></div>", f"{ARTICLE} A&lt; &lt; &lt;"),
    ],
)
def test_main_text(html, expected):
    assert main_text(html) == expected


@pytest.mark.parametrize(
    "html, expected",
    [
        (f"<div><section>{f'<p>{ARTICLE}</p>' * 9}</section><h2>Later</h2><div><p>It all ended well in the end.</p></div><ul><li>a</ul></div>", [*[ARTICLE] * 9, "Later", "It all ended well in the end.", "a"]),
        (f"<div>{f'<p>{ARTICLE}</p>' * 9}</div><blockquote>Short.</blockquote><p>Bye.</p><div><p>End.</p></div>", [*[ARTICLE] * 9, "Short.", "Bye.", "End."]),
        (f"<div><div>{f'<p>{ARTICLE}</p>' * 9}</div><div><a href=x>One of many other pages here</a></div></div>", [ARTICLE] * 9),
        (f"<main><h1>T</h1><article>{f'<p>{ARTICLE}</p>' * 9}</article><article><p>Second.</p></article></main>", ["T", *[ARTICLE] * 9, "Second."]),
        (f"<main><article><div><p>{ARTICLE}</p></div><ul><li><a href=x>Source of it</a></ul></article></main>", [ARTICLE, "Source of it"]),
    ],
)
def test_uneven_sections_and_sibling_articles_stay(html, expected):
    assert main_text(html).split("\n") == expected


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 200_000 + f"<p>{ARTICLE}",
        "<span>" * 100_000 + f"<p>{ARTICLE}</p>" + "</i>" * 100_000,
        "<span>" * 100_000 + f"<p>{ARTICLE}</p>" + "<b></b><section></section>" * 20_000,
        f"<section><p>{ARTICLE}</p></section>" * 20_000,
    ],
)
def test_long_pages_take_time_in_proportion(html):
    started = time.monotonic()
    assert main_text(html).startswith(ARTICLE)
    assert time.monotonic() - started < 5


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "v", f"<p>{ARTICLE}", "x"), (3, "w", "<p>" + "word, " * 40000, "x")]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, text string")
    found = extract_pages(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in found) == [(0, len(ARTICLE)), (1, 0), (1, 0), (2, 0), (3, 239999)]
    assert rows_of(extract_pages(pages.limit(0))) == []


@needs_data
def test_pages_equal_a_cut_by_hand(spark):
    from html import unescape

    data = table("pages")
    for row in queries.op8_html_text(spark, SF).collect():
        html = data.loc[data["page_id"] == row.page_id, "html"].iloc[0] or ""
        body = re.sub("<[^>]*$", "", html.partition("<article>")[2].partition("</article>")[0])
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", re.sub("</?b>", "", body).replace("<br>", " "))
        lines = [" ".join(unescape(block).split()) for block in blocks]
        assert row.text == "\n".join(line for line in lines if line)


# The pipeline.


@needs_data
def test_every_stage_keeps_what_it_should(spark):
    from test_dedup_mix_pack import classes

    docs = queries.table(spark, SF, "documents")
    columns, found = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = frame_of(docs)
        docs = corpus_pipeline.checkpointed(stage(spark, docs, SF))
        found[name] = before, frame_of(docs)
        assert name == "packing" or docs.columns == columns
    assert list(found) == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    before, after = found["toxicity"]
    scored = frame_of(queries.op10_toxicity(spark, SF))
    assert set(after["doc_id"]) == set(scored[scored["predicted"] == 0]["doc_id"])
    before, after = found["exact dedup"]
    ascii_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    folded = before.assign(t=before["text"].map(lambda t: t.translate(ascii_lower)))
    assert sorted(after["doc_id"]) == sorted(folded.groupby("t")["doc_id"].max())
    before, after = found["near dedup"]
    expected = classes(dict(zip(before["doc_id"], before["text"], strict=True)))
    assert sorted(after["doc_id"]) == sorted(set(expected.values()))
    before, after = found["mixing"]
    words = lambda texts: texts.str.count(r"[^\x20\x09-\x0D]+")
    whole = dict(zip(before["doc_id"], before["text"], strict=True))
    assert all(whole[i] == t for i, t in zip(after["doc_id"], after["text"], strict=True))
    assert words(after["text"]).sum() == pytest.approx(words(before["text"]).sum(), rel=0.02)
    pieces = found["packing"][1]
    assert pieces["length"].sum() >= len(after)
    assert (pieces.groupby("sequence_id")["length"].sum() <= 4096).all()


@needs_data
def test_run_packs_what_the_stages_keep(spark):
    found = frame_of(corpus_pipeline.run(spark, SF))
    assert len(found) and (found.groupby("sequence_id")["length"].sum() <= 4096).all()
    assert corpus_pipeline.ORACLE_SQL is None
