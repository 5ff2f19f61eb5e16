"""Near duplicates by weighted Jaccard similarity of bags of word shingles: BagMinHash, bands, exact check.

The signature of a bag comes from Poisson processes. The counts of a shingle, 0 to its number, are cut into
dyadic intervals, each with a process of its own whose rate is the width of the interval; a point of an interval that
the count covers only in part is placed by its own bits and counts if it lies below. Each point hits one slot of
the signature, which keeps its earliest point, so two slots agree with the probability of the weighted Jaccard
similarity. All points of a shingle follow from its hash, so documents that share it share them.

Bands of slots give buckets. A few members of each bucket, drawn by a hash, are compared with all others, and
components are formed; then the members outside the largest component of a bucket are compared with all members of
other components, where the task that holds these emits only links that connect something. Signatures rule out
hopeless pairs, the rest is verified on whole bags. Rows are (bucket, node) pairs, bags pass in a stream sorted by
pivot or group, so no group is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import checkpointed, forget, one_of_each, stored, text_of
from faultline.llm.components import Joined, components

WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_SLOTS = 30, 6
#: Slots of a signature; the bands use the first of them. A byte of each slot is kept to compare pairs.
SLOTS = 240
#: Standard deviations of the share of agreeing slots by which it may fall short of the least similarity; a pair
#: that falls shorter is not verified.
DEVIATIONS = 4
#: Pivots drawn from a bucket before the remaining members are compared.
PIVOTS = 1
#: Members compared with one copy of a pivot's text.
CHUNK = 256
#: Members of a group that are held at once while those outside its largest component pass by.
HELD = 512
#: Words a worker remembers.
KNOWN_WORDS = 500_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ROLL = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers, well mixed."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingle_bag(words: list[str], hashes: WordHashes, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles of n words and their counts; fewer words are one shingle, none are no shingle."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    rolled = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        rolled *= _ROLL
        rolled += h[k : len(h) - n + 1 + k]
    return np.unique(mixed(rolled + np.uint64(n)), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; two empty bags are equal."""
    total = int(a[1].sum()) + int(b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (total - common)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """BagMinHash signatures, a row of slots for each bag; those of an empty bag are all infinite."""
    found = np.full((len(bags), slots), np.inf)
    sizes = np.array([int(counts.sum()) for _, counts in bags])
    horizon = np.where(sizes > 0, slots * (np.log(slots) + 3.0) / np.maximum(sizes, 1), 0.0)
    open_bags = np.flatnonzero(sizes)
    while len(open_bags):
        order = open_bags[np.argsort(sizes[open_bags], kind="stable")]
        for part in np.array_split(order, max(1, len(order) // 64)):
            if len(part):
                _points(bags, part, horizon, found)
        # A slot that no point has hit needs a longer horizon; the points before it are the same again.
        open_bags = open_bags[np.isinf(found[open_bags]).any(axis=1)]
        horizon[open_bags] *= 2
    return found


def _points(bags, part: np.ndarray, horizon: np.ndarray, found: np.ndarray) -> None:
    """Enter the points of these bags before their horizons into their signatures."""
    slots = found.shape[1]
    hashes = np.concatenate([bags[i][0] for i in part])
    counts = np.concatenate([bags[i][1] for i in part])
    owner = np.repeat(part, [len(bags[i][0]) for i in part])
    flat = found.reshape(-1)
    low, width, level = 0, 1, 0
    while len(hashes):
        _process(mixed(hashes + np.uint64(int(_GOLD) * (level + 1) % 2**64)), low, width, counts, owner, horizon, flat, slots)
        low, width, level = low + width, (width if level == 0 else 2 * width), level + 1
        more = counts > low
        hashes, counts, owner = hashes[more], counts[more], owner[more]


def _process(stream, low: int, width: int, counts, owner, horizon, flat, slots: int) -> None:
    """Points of one dyadic interval [low, low + width) of each shingle."""
    at, until = np.zeros(len(stream)), horizon[owner]
    step = 0
    while len(stream):
        ahead = int(np.clip((until - at).mean() * width * 1.2 + 1, 1, 32))
        turns = (np.arange(step + 1, step + ahead + 1, dtype=np.uint64) * _ROLL)[None, :]
        step += ahead
        bits = mixed(stream[:, None] + turns)
        gaps = -np.log((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / width
        # Added one by one, so that a time does not depend on how many steps are taken together.
        times = np.empty_like(gaps)
        last = at
        for k in range(ahead):
            times[:, k] = last = last + gaps[:, k]
        row, column = np.nonzero(times <= until[:, None])
        where = mixed(bits[row, column] + _GOLD)
        slot = ((where >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        if width > 1:
            place = low + (((where & np.uint64(0xFFFFFFFF)) * np.uint64(width)) >> np.uint64(32)).astype(np.int64)
            inside = place < counts[row]
            row, column, slot = row[inside], column[inside], slot[inside]
        np.minimum.at(flat, owner[row] * slots + slot.astype(np.int64), times[row, column])
        alive = times[:, -1] <= until
        stream, at, until, counts, owner = stream[alive], times[alive, -1], until[alive], counts[alive], owner[alive]


def banded(found: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash for each band of a signature."""
    bits = mixed(found.view(np.uint64) + _GOLD)[:, : bands * BAND_SLOTS]
    grouped = bits.reshape(len(found), bands, BAND_SLOTS)
    total = np.zeros(grouped.shape[:2], np.uint64)
    for k in range(grouped.shape[2]):
        total = mixed(total * _ROLL + grouped[:, :, k])
    return mixed(total + np.arange(bands, dtype=np.uint64) * _GOLD).view(np.int64)


def _normal(text=None):
    """Lower-cased words with one space between them; words end at ASCII white space."""
    return F.trim(F.regexp_replace(F.lower(text_of() if text is None else text), r"[ \t\n\x0B\f\r]+", " "))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            bags = [shingle_bag(text.split(" ") if text else [], hashes) for text in part.column(2).to_pylist()]
            found = signatures(bags)
            short = (mixed(found.view(np.uint64)) & np.uint64(0xFF)).astype("u1")
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(list(banded(found)), pa.list_(pa.int64())),
                    pa.array([row.tobytes() for row in short], pa.binary()),
                ],
                names=["doc_id", "key", "bands", "signature"],
            )


def hopeless(least: float, slots: int = SLOTS) -> float:
    """The share of agreeing slots below which a pair is not verified."""
    return least - DEVIATIONS * (least * (1 - least) / slots) ** 0.5


def _hopeful(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a = np.frombuffer(b"".join(batch["sa"]), "u1").reshape(len(batch), -1)
                b = np.frombuffer(b"".join(batch["sb"]), "u1").reshape(len(batch), -1)
                yield batch.loc[(a == b).mean(axis=1) >= hopeless(least), ["a", "b"]]

    return run


class Held:
    """Members of a group against which others pass: nodes, labels, signatures and bags."""

    def __init__(self):
        self.nodes, self.labels, self.short, self.bags, self.joined, self.slots = [], [], [], [], Joined(), None

    def add(self, node: int, label: int, short: bytes, bag) -> None:
        self.nodes.append(node)
        self.labels.append(label)
        self.short.append(np.frombuffer(short, "u1"))
        self.bags.append(bag)

    def links(self, node: int, label: int, short: bytes, bag, least: float) -> Iterator[tuple[int, int, float]]:
        """The links of a passing member that join two labels, likeliest first."""
        if self.slots is None:
            self.slots, self.sizes = np.stack(self.short), np.array([int(b[1].sum()) for b in self.bags])
        share = (self.slots == np.frombuffer(short, "u1")).mean(axis=1)
        size = int(bag[1].sum())
        fits = (np.minimum(self.sizes, size) >= least * np.maximum(self.sizes, size)) & (share >= hopeless(least))
        near = np.flatnonzero(fits)
        for i in near[np.argsort(-share[near], kind="stable")]:
            if self.joined.root(self.labels[i]) == self.joined.root(label):
                continue
            if (found := similarity(self.bags[i], bag)) >= least:
                self.joined.join(self.labels[i], label)
                yield self.nodes[i], node, found


def _compared(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, at, held = WordHashes(), None, Held()
        for batch in batches:
            found = []
            for group, chunk, role, node, label, short, text in batch.itertuples(index=False, name=None):
                if (group, chunk) != at:
                    at, held = (group, chunk), Held()
                bag = shingle_bag(text.split(" ") if text else [], hashes)
                if role == 0:
                    held.add(node, label, short, bag)
                else:
                    found += held.links(node, label, short, bag, least)
            yield pd.DataFrame(found, columns=["a", "b", "similarity"])

    return run


def _remaining(labelled: DataFrame, nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between members of a bucket in different components, enough to connect all that are linked.

    All buckets with the same largest component form one group, in which a member stands once however many buckets it shares.
    Members outside that component pass by all members, chunk by chunk, and are verified where they pass.
    """
    counted = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    largest = counted.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("group"), F.count("*").alias("k"))
    several = labelled.join(largest.filter("k > 1").drop("k"), "bucket")
    several = checkpointed(several.select("group", "node", "label").distinct())
    sizes = several.groupBy("group").agg(F.ceil(F.count("*") / HELD).alias("chunks"))
    cut = several.join(sizes, "group")
    columns = ("group", "chunk", "role", "node", "label")
    held = cut.select("*", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), F.lit(0).alias("role"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    passing = cut.filter("label <> group").select("*", every.alias("chunk"), F.lit(1).alias("role"))
    rows = held.select(*columns).unionByName(passing.select(*columns))
    rows = rows.join(nodes.select("node", "signature"), "node").join(texts, "node")
    ordered = rows.repartition("group", "chunk").sortWithinPartitions("group", "chunk", "role")
    found = ordered.select(*columns, "signature", "text").mapInPandas(_compared(least), "a long, b long, similarity double")
    return checkpointed(found)


def _verified(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, pivot, bag = WordHashes(), None, None
        for batch in batches:
            found = []
            for a, b, text in zip(batch["a"], batch["b"], batch["text"], strict=True):
                own = shingle_bag(text.split(" ") if text else [], hashes)
                if b < 0:
                    pivot, bag = a, own
                elif pivot == a and (s := similarity(bag, own)) >= least:
                    found.append((a, b, s))
            yield pd.DataFrame(found, columns=["a", "b", "similarity"])

    return run


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose signatures do not rule them out."""
    slim = nodes.select("node", "signature")
    signed = pairs.join(slim.toDF("a", "sa"), "a").join(slim.toDF("b", "sb"), "b")
    return signed.select("a", "b", "sa", "sb").mapInPandas(_hopeful(least), "a long, b long")


def _links(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a: pivot, b) whose bags reach the similarity; texts: node, text."""
    hopeful = checkpointed(pairs)
    sizes = hopeful.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    cut = hopeful.join(sizes, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), "chunks"))
    asked = cut.select("a", "chunk", "b", F.col("b").alias("node")).unionByName(
        cut.select("a", "chunk").distinct().select("a", "chunk", F.lit(-1).cast("long").alias("b"), F.col("a").alias("node"))
    )
    sent = asked.join(texts, "node").select("a", "chunk", "b", "text")
    ordered = sent.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "b").select("a", "b", "text")
    return checkpointed(ordered.mapInPandas(_verified(least), "a long, b long, similarity double"))


def _drawn(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of a member of each bucket, drawn by a hash, and each other member. The hash is of the member alone, so the buckets
    that a group of near copies shares draw the same one."""
    pivots = members.groupBy("bucket").agg(F.min_by("node", F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("a"))
    return members.join(pivots, "bucket").filter("node <> a").select("a", F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, pivots: int = PIVOTS) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are not read): its class of near duplicates.

    Words are lower-cased and end at ASCII white space. Texts with the same words are copies and share a class,
    texts without words too. Texts of fewer than five words have one shingle. Classes are the connected components of
    the links: pairs of different texts whose bags of five-word shingles have a weighted Jaccard similarity of at
    least `least`. A null text counts as empty; an empty table gives no rows.

    Columns: doc_id, class_id (smallest doc_id of the class, null if it has none), class_size, text_key (hex,
    equal for copies), class_key (smallest text_key of the class).
    """
    spark = docs.sparkSession
    normal = docs.select("doc_id", _normal().alias("text"))
    normal = normal.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    signed = normal.mapInArrow(_sign, f"doc_id {kind}, key binary, bands array<long>, signature binary")
    nodes = signed.groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("signature").alias("signature")
    )
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members, at = stored(placed.join(shared, "bucket").select("bucket", "node"))
    # Texts are moved to their nodes once, one row of each class of copies; later joins move only these.
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("key", "first_id", "node")
    theirs = (normal["key"] == wanted["key"]) & normal["doc_id"].eqNullSafe(wanted["first_id"])
    texts, text_at = stored(normal.join(wanted, theirs).select("node", "text"))

    drawn = _drawn(members, 0)
    for turn in range(1, pivots):
        drawn = drawn.unionByName(_drawn(members, turn))
    links = _links(_likely(drawn.distinct(), nodes, least), texts, least)
    labels = components(links)
    known = labels.select(F.col("node").alias("n__"), F.col("label").alias("l__"))
    labelled = members.join(known, members["node"] == known["n__"], "left").select(
        "bucket", "node", F.coalesce("l__", "node").alias("label")
    )
    links = links.unionByName(_remaining(labelled, nodes, texts, least))
    labels = components(links)
    forget(spark, at)
    forget(spark, text_at)
    known = nodes.select("node", "key").join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("label"))
    by_row = normal.select("doc_id", F.lower(F.hex("key")).alias("text_key"), "key").join(known, "key")
    classes = by_row.groupBy("label").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min("text_key").alias("class_key")
    )
    return by_row.join(classes, "label").select("doc_id", "class_id", "class_size", "text_key", "class_key")


def drop_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that stay, with all of their columns: of each class the one with the smallest doc_id (if
    rows repeat it, one of them with the smallest text key)."""
    found = near_duplicates(docs, least).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    stay = found.groupBy("class_key").agg(F.min("class_id").alias("stay_id__"), F.min("text_key").alias("stay_key__"))
    normal = docs.withColumn("key__", F.md5(_normal().cast("binary")))
    same = F.col("doc_id").eqNullSafe(F.col("stay_id__")) & (F.col("key__") == F.col("stay_key__"))
    return one_of_each(normal.join(stay, same, "left_semi"), docs, "key__").drop("key__")
