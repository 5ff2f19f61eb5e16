"""Exact similarity join of sets of word shingles, by tries over ordered sets.

All sets are put into one global order of shingles. Two sets of Jaccard similarity 0.8 must share a shingle among the first
fifth of each, so sets meet in buckets, one for each shingle of such a prefix. The order puts a fixed share of all
shingles first, chosen by hash, and among these the rare ones first, by exact counts: prefixes then hold what nobody else
has wherever a text has enough of it, and only this share of the shingles is ever counted and shuffled.

So that groups of near copies need no pairs, each member of a bucket is first compared with one of its members, the one that
comes first by a hash, which is the same for most buckets of a group. What is linked forms components. Then the members of all
buckets with the same largest component are stored in tries along the order of their hashes, and those outside it descend
them together: how many shingles of a path a set holds is counted once for all sets below, and a set leaves a subtree as soon as
the remaining lengths there cannot bring the overlap needed. Of the links found in one trie only those that connect
something are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.llm.bag_minhash import WordHashes, mixed
from faultline.llm.common import checkpointed, forget, one_of_each, release, stored, text_of
from faultline.llm.components import Joined, components
from faultline.operators.ordinal import with_ordinal

WORDS = 5
_ROLL = np.uint64(0xD6E8FEB86659FD93)
#: The shingles whose hashes lie below come first in the global order; they are counted.
COUNTED = (1 << 63) // 4
#: Members compared with one copy of the member that comes first.
CHUNK = 256
#: Sets in one trie; a larger component or bucket takes several.
HELD = 512
#: Shingles of a path that are counted before a member is tried for leaving.
STEP = 64
#: Cells of the table of which member holds which shingle of a trie.
CELLS = 1 << 25


def needed(a, b):
    """The overlap two sets of these sizes need: 100 * overlap >= 80 * union."""
    return -(-4 * (a + b) // 9)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= needed(len(a), len(b))


def prefix_length(n):
    """Shingles of a set's beginning among which any similar set shares one."""
    return n - -(-4 * n // 5) + 1


def shingle_set(text: bytes, hashes: WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted hashes of 63 bits of the shingles of a text: A-Z lower-cased, words between ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    rolled = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        rolled *= _ROLL
        rolled += h[k : len(h) - n + 1 + k]
    return np.unique(mixed(rolled + np.uint64(n)) >> np.uint64(1))


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _pools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the digest and size of its set, how many of its shingles are counted ones, and these, filled up to the
    length of a prefix by the next ones."""
    hashes = WordHashes()
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            marks, sizes, counted, pools = [], [], [], []
            for text in _texts(part.column(2)):
                shingles = shingle_set(text, hashes)
                n, own = len(shingles), int(np.searchsorted(shingles, np.uint64(COUNTED)))
                marks.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                sizes.append(n)
                counted.append(own)
                pools.append(shingles[: max(own, prefix_length(n)) if n else 0].view(np.int64))
            arrays = [pa.array(marks, pa.binary()), pa.array(sizes, pa.int64()), pa.array(counted, pa.int64())]
            arrays = [part.column(0), part.column(1), *arrays, pa.array(pools, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "mark", "n", "counted", "pool"])


def prefix_members(nodes: DataFrame) -> DataFrame:
    """(bucket, node) for each shingle of a node's prefix that another prefix may hold. nodes: node, n, counted, pool.

    Shingles of one set only come first in the order and are no buckets; how many a node has follows from how many
    of its counted shingles it shares.
    """
    spread = nodes.select("node", F.explode("pool").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("sets")).filter("sets > 1")
    members = spread.join(shared, "bucket")
    sizes = nodes.select(F.col("node").alias("of__"), "n", "counted")
    placed = members.join(sizes, F.col("node") == F.col("of__")).withColumn("first", F.col("bucket") < COUNTED)
    own = Window.partitionBy("node")
    ranked = placed.select(
        "bucket",
        "node",
        "first",
        (F.col("counted") - F.count_if("first").over(own)).alias("alone"),
        F.row_number().over(own.orderBy(F.desc("first"), "sets", "bucket")).alias("at"),
        (F.col("n") - F.ceil(4 * F.col("n") / 5) + 1).alias("length"),
    )
    return ranked.filter("not first or alone + at <= length").select("bucket", "node")


def several(members: DataFrame) -> DataFrame:
    """The members of buckets with more than one."""
    more = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    return members.join(more, "bucket")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the pairs (a, b) of a stream in which the text of each a (b: -1) comes before those of its partners."""
    hashes, first, own = WordHashes(), None, None
    for batch in batches:
        found = []
        for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2)), strict=True):
            shingles = shingle_set(text, hashes)
            if b < 0:
                first, own = a, shingles
            elif first == a and linked(own, shingles):
                found.append((a, b))
        yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=["a", "b"], dtype="int64"), preserve_index=False)


def first_links(members: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the members of buckets and the one that comes first in each, by a hash. Pairs that share
    less than half of a prefix are left to the tries. members: bucket, node; nodes: node, n; texts: node, text."""
    order = F.struct(F.xxhash64("node").alias("at"), F.col("node").alias("node"))
    firsts = members.groupBy("bucket").agg(F.min(order)["node"].alias("a"))
    pairs = members.join(firsts, "bucket").filter("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("shared"))
    size = nodes.select("node", "n")
    sized = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    least, most = F.least("na", "nb"), F.greatest("na", "nb")
    likely = sized.filter((5 * least >= 4 * most) & (F.col("shared") * 10 >= least)).select("a", "b")
    likely = checkpointed(likely)
    chunks = likely.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    cut = likely.join(chunks, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), "chunks"))
    asked = cut.select("a", "chunk", "b", F.col("b").alias("node")).unionByName(
        cut.select("a", "chunk").distinct().select("a", "chunk", F.lit(-1).cast("long").alias("b"), F.col("a").alias("node"))
    )
    sent = asked.join(texts, "node").select("a", "chunk", "b", "text")
    ordered = sent.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "b").select("a", "b", "text")
    return checkpointed(ordered.mapInArrow(_verified, "a long, b long"))


class Trie:
    """Sets along the order of their hashes, as a sorted list: a subtree is a run of sets that agree up to some depth."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.universe, flat = np.unique(np.concatenate(self.sets), return_inverse=True)
        self.lengths = np.array([len(s) for s in self.sets])
        ends = np.cumsum(self.lengths)
        self.columns = [flat[end - n : end] for end, n in zip(ends, self.lengths, strict=True)]
        self.common = np.array([self._common(i, i + 1) for i in range(len(self.sets) - 1)], dtype=np.int64)

    def _common(self, i: int, j: int) -> int:
        n = min(self.lengths[i], self.lengths[j])
        differ = np.flatnonzero(self.sets[i][:n] != self.sets[j][:n])
        return int(differ[0]) if len(differ) else int(n)

    def holds(self, others: list[np.ndarray]) -> np.ndarray:
        """Which of the others (column) holds which shingle of the trie (row)."""
        table = np.zeros((len(self.universe), len(others)), np.uint8)
        for j, shingles in enumerate(others):
            at = np.minimum(np.searchsorted(self.universe, shingles), len(self.universe) - 1)
            table[at[self.universe[at] == shingles], j] = 1
        return table

    def matches(self, others: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """(a set of the trie, those of the others that reach the similarity with it)."""
        table, sizes = self.holds(others), np.array([len(m) for m in others])
        # Of each other set, how many of its shingles the trie holds at all bounds every overlap.
        hopeful = np.flatnonzero(table.sum(axis=0, dtype=np.int64) >= needed(self.lengths.min(), sizes))
        waiting = [(0, len(self.sets), 0, hopeful, np.zeros(len(hopeful), np.int64))]
        while waiting:
            low, high, depth, active, overlap = waiting.pop()
            apart = self.common[low : high - 1]
            until = int(apart.min()) if high - low > 1 else int(self.lengths[low])
            least, most = self.lengths[low:high].min(), self.lengths[low:high].max()
            path = self.columns[low]
            while depth < until and len(active):
                end = min(until, depth + STEP)
                overlap = overlap + table[path[depth:end]][:, active].sum(axis=0, dtype=np.int64)
                stay = overlap + np.minimum(most - end, sizes[active] - overlap) >= needed(least, sizes[active])
                active, overlap, depth = active[stay], overlap[stay], end
            if not len(active):
                continue
            first = low
            if self.lengths[low] == until:  # the set that ends here comes first in its run
                found = active[overlap >= needed(self.lengths[low], sizes[active])]
                if len(found):
                    yield self.order[low], found
                first = low + 1
            if high > first:
                cuts = [first, *(first + 1 + np.flatnonzero(self.common[first : high - 1] == until)), high]
                waiting += [(a, b, until, active, overlap) for a, b in zip(cuts, cuts[1:], strict=False)]


def _links_of(trie: Trie, joined: Joined, held: list, others: list, sets: list) -> list[tuple[int, int]]:
    """The links of the trie's sets with the others that join two labels."""
    found = []
    step = max(1, CELLS // len(trie.universe))
    for start in range(0, len(others), step):
        part = others[start : start + step]
        for i, near in trie.matches(sets[start : start + step]):
            node, label = held[i]
            found += [(node, part[j][0]) for j in near if joined.join(label, part[j][1])]
    return found


def _through_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links found in a stream in which the sets of each trie (role 0) come before those that descend it (role 1)."""
    hashes, at, held, sets, trie, joined = WordHashes(), None, [], [], None, Joined()
    others, passing = [], []
    for batch in batches:
        found = []

        def flush(trie=None, joined=None, held=None, found=found):
            if others:
                found += _links_of(trie, joined, held, others, passing)
                others.clear()
                passing.clear()

        columns = [c.to_pylist() for c in batch.columns[:5]]
        for group, chunk, role, node, label, text in zip(*columns, _texts(batch.column(5)), strict=True):
            if (group, chunk) != at:
                flush(trie, joined, held)
                at, held, sets, trie, joined = (group, chunk), [], [], None, Joined()
            shingles = shingle_set(text, hashes)
            if role == 0:
                held.append((node, label))
                sets.append(shingles)
                continue
            if trie is None:
                trie = Trie(sets)
            others.append((node, label))
            passing.append(shingles)
            if len(others) >= CHUNK:
                flush(trie, joined, held)
        flush(trie, joined, held)
        yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=["a", "b"], dtype="int64"), preserve_index=False)


def trie_links(members: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between members of a bucket with different labels, enough to connect all that are linked.

    A group has all members of the buckets that have the same largest component: those in it and those outside. Its sets
    are cut by size into tries, and what is outside descends those that fit its size; so sets that share many buckets
    are compared once.
    """
    known = labels.select(F.col("node").alias("n__"), F.col("label").alias("l__"))
    size = nodes.select(F.col("node").alias("s__"), "n")
    labelled = (
        members.join(known, members["node"] == known["n__"], "left")
        .join(size, F.col("node") == F.col("s__"))
        .select("bucket", "node", F.coalesce("l__", "node").alias("label"), "n")
    )
    counted = labelled.groupBy("bucket", "label").agg(F.count("*").alias("sets"))
    mixed_buckets = counted.groupBy("bucket").agg(F.max_by("label", F.struct("sets", "label")).alias("main"), F.count("*").alias("k"))
    here = labelled.join(mixed_buckets.filter("k > 1").drop("k"), "bucket")
    here = checkpointed(here.select(F.col("main").alias("group"), "node", "label", "n").distinct())
    # In the order of their sizes, so that few tries fit the size of another set.
    ranked = checkpointed(with_ordinal(here, ["group"], ["n", "node"], "at"))
    held = ranked.withColumn("chunk", F.floor(F.col("at") / HELD))
    spans = held.groupBy("group", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    descending = here.filter("label <> group").join(spans, "group").filter("5 * n >= 4 * low and 4 * n <= 5 * high")
    columns = ("group", "chunk", "role", "node", "label")
    rows = held.withColumn("role", F.lit(0)).select(*columns).unionByName(descending.withColumn("role", F.lit(1)).select(*columns))
    ordered = rows.join(texts, "node").repartition("group", "chunk").sortWithinPartitions("group", "chunk", "role")
    return checkpointed(ordered.select(*columns, "text").mapInArrow(_through_tries, "a long, b long"))


def similar_sets(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are not read): its component of linked texts.

    Texts link when their sets of five-word shingles have 100 * intersection >= 80 * union. A-Z is lower-cased, words end
    at ASCII white space; fewer than five words are one shingle. A text without words, or null, links with nothing, not even
    another such text. Equal sets are one node, so copies cost one comparison. Texts are read whole; a table of shingle hashes
    of 63 bits stands for the shingles. Rows that repeat a doc_id are rows of their own; a component of rows without
    doc_id has none. An empty table gives no rows.

    Columns: doc_id, n_shingles, component_id (smallest doc_id of the component), set_key (equal for equal sets).
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    whole = docs.select("doc_id", text_of().alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    schema = f"doc_id {kind}, key binary, mark binary, n long, counted long, pool array<long>"
    marked, marked_at = stored(whole.select("doc_id", "key", "text").mapInArrow(_pools, schema))
    # A set is read again from one of its texts: that of the least key, and of its rows the one of the least doc_id.
    nodes = marked.filter("n > 0").groupBy("mark").agg(
        F.min("doc_id").alias("first_id"),
        F.first("n").alias("n"),
        F.first("counted").alias("counted"),
        F.first("pool").alias("pool"),
        F.min(F.struct("key", "doc_id")).alias("of"),
    )
    pooled, pooled_at = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    # The shingles are the bulk: what no longer needs them is written anew without them, and they are deleted.
    rows, rows_at = stored(marked.select("doc_id", "mark", "n"))
    forget(spark, marked_at)
    release(spark)
    placed, placed_at = stored(prefix_members(pooled))
    nodes, nodes_at = stored(pooled.drop("pool", "counted"))
    forget(spark, pooled_at)
    release(spark)
    members, members_at = stored(several(placed))
    forget(spark, placed_at)
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select(
        F.col("of.key").alias("key__"), F.col("of.doc_id").alias("id__"), "node"
    )
    theirs = (whole["key"] == wanted["key__"]) & whole["doc_id"].eqNullSafe(wanted["id__"])
    texts = one_of_each(whole.join(wanted, theirs).select("doc_id", "node", "text"), docs, "node")
    texts, texts_at = stored(texts.select("node", "text"))

    links = first_links(members, nodes, texts)
    labels = components(links)
    links = links.unionByName(trie_links(members, labels, nodes, texts))
    labels = components(links)
    labelled = nodes.select("mark", "first_id", "node").join(labels, "node", "left")
    labelled = labelled.select("mark", "first_id", F.coalesce("label", "node").alias("label"))
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_mark = labelled.join(least, "label").select("mark", "component_id")
    found = rows.join(by_mark, "mark", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.lower(F.hex("mark")).alias("set_key"),
    )
    found = checkpointed(found)
    for at in (rows_at, nodes_at, members_at, texts_at):
        forget(spark, at)
    return found
