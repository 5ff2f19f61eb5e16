"""Approximate nearest neighbours by largest inner product: a neighbour graph by NN-descent, greedy search in it.

Equal vectors are one node, so a vector that fills a third of the table is no hot spot, and its rows are put back
exactly at the end. One more coordinate makes all nodes equally long, which turns the largest inner product
into the nearest neighbour. It is never stored: links are scored in double precision by the vectors as they were given, so
that one very long vector does not make the others alike.

Trees of random projections, fitted on a bounded sample, put near nodes into one cell, and the graph begins with the exact
neighbours inside the cells of each tree. Then rounds join the graph with itself: each node is a pivot whose links, followed
in both directions, are compared with one another, and what is nearer to an end than its worst link becomes a candidate. A
link is fresh until a round has followed it; rounds go on until hardly any link is, however many that takes.

Nodes are numbered in the order of their cells, and a run of numbers is a part of the graph: its links, its vectors and what is
sent to it are packed arrays in few rows, of a bounded size each, that one task takes at a time. In a round a part sends its links
to the parts that own their ends, asks for the vectors of its pivots' members once each, and sends what it found to the owners.

A query enters at its own node, if it has one, and at the best of a bounded list of random and of the longest nodes, and opens
the best nodes of its beam, many queries and nodes at a time, until all nodes in the beam are open. For that the nodes lie in
shards, as many as a task can hold at a time in each. A request carries one vector and the candidates of one shard; the vectors
of a shard are held by the task while its requests pass by in a stream. A round sends a query to every shard at most once, so
what it sends grows with the queries, not with queries times cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count as count_from

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.llm.common import checkpointed, release

#: Nodes of a cell, on average at most; links of a node; of them, those that a round follows, and as many reversed.
BLOCK, LINKS, FORWARD, BACKWARD = 1024, 24, 24, 16
#: Trees of projections; numbers and vectors of the sample they are fitted on, and its vectors per leaf.
BEGINNINGS, SAMPLED_NUMBERS, SAMPLED, PER_LEAF = 2, 1 << 21, 8192, 16
#: Candidates a task holds, to send on only the best of each node.
MOST_HELD = 1 << 21
#: Share of links, new or not yet followed, below which the graph is left as it is.
SETTLED = 0.01
#: Reversed links a search may follow; nodes in the beam; nodes opened at a time; random entries, and the longest nodes, which
#: are near to many queries and far from all nodes; of both, those at which a query enters.
REVERSED, BEAM, OPENED, ENTRIES, LONG_ENTRIES, ENTERED = 24, 400, 100, 64, 64, 32
NEAREST = 20
#: Shards of the nodes while they are searched, at least, and the components a shard may hold, for which there may be more.
SHARDS, SHARD_NUMBERS = 24, 1 << 22
#: Nodes of a part of the graph and numbers of its vectors, at most, and parts, unless they held hardly any node.
PART_NODES, PART_NUMBERS, PARTS, FEW_NODES = 8192, 1 << 19, 24, 256
#: Bits of a cell's number within its leaf, and of a node's number beside that of its place in a part.
PART_BITS, NODE_BITS = 20, 44
#: A query's vector and beam: its nodes, their scores and which are open, and how many are not; or what was found for it.
BEAM_TYPE = "a long, role int, v binary, b binary, s binary, f binary, n long"
#: What is sent to a part: packed arrays, and a count. Roles: its links; its vectors; links to its nodes; its pivots and their
#: members; numbers of nodes whose vectors a part wants; those vectors; candidates for its nodes.
MESSAGE = "part int, role int, a binary, b binary, s binary, f binary, n long"
STATE, VECTORS, ENDS, PIVOTS, WANTED, SENT, FOUND = range(7)


@dataclass
class Index:
    """nodes (node, vec_id, v: packed numbers of the type `kind`), vectors (node, embedding), members (node, vec_id: the
    smallest of equal vectors), links (node, near); the number of cells, of shards, the length of the longest vector, and components."""

    nodes: DataFrame
    vectors: DataFrame
    members: DataFrame
    links: DataFrame
    blocks: int
    shards: int
    kind: str
    longest: float
    size: int


def part_nodes_of(count: int, size: int) -> int:
    """Nodes of a part of the graph."""
    most = max(1, min(PART_NODES, PART_NUMBERS // max(1, size)))
    return min(most, max(-(-count // PARTS), FEW_NODES))


def shards_of(count: int, size: int) -> int:
    return max(SHARDS, -(-count * size // SHARD_NUMBERS))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows with a known id and a vector whose components are all finite and not all
    zero; an id counts once."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.filter(finite & F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def commonest_size(rows: DataFrame) -> int:
    """The number of components most vectors have, the larger of equally common ones; 0 without vectors."""
    first = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return first.n if first else 0


def _kind_of(vectors: DataFrame) -> str:
    """The number type that holds the components of `vectors` as they are."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _unpacked(values, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)


def _lifted(x: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as shares of the longest, their squared norms, and the coordinate that makes them equally long."""
    x = x / longest
    square = np.einsum("ij,ij->i", x, x)
    return x, square, np.sqrt(np.maximum(0.0, 1.0 - square))


def _nearness(product, square_a, square_b, rest_a, rest_b):
    """Minus the squared distance. The difference of the added coordinates comes from the squared norms: they
    themselves are almost 1 for all vectors far below the longest."""
    apart = (square_a - square_b) / np.maximum(rest_a + rest_b, 1e-300)
    return 2 * product - square_a - square_b - apart * apart


# Cells.


def _leaf_of(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    directions, cuts = tree
    at = np.zeros(len(x), dtype=np.int64)
    for _ in range(depth):
        at = 2 * at + 1 + (np.einsum("ij,ij->i", x, directions[at]) > cuts[at])
    return at - (2**depth - 1)


def _trees(sample: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Trees that halve the sample by the direction from one of its members to another, level by level."""
    rng, trees = np.random.default_rng(7), []
    for _ in range(BEGINNINGS):
        directions, cuts = np.zeros((max(1, 2**depth - 1), sample.shape[1])), np.zeros(max(1, 2**depth - 1))
        for level in range(depth):
            leaf = _leaf_of(sample, (directions, cuts), level)
            for k in range(2**level):
                own = sample[leaf == k]
                if len(own) > 1:
                    one, two = own[rng.choice(len(own), 2, replace=False)]
                    at = 2**level - 1 + k
                    directions[at] = one - two
                    cuts[at] = np.median(np.einsum("ij,j->i", own, one - two))
        trees.append((directions, cuts))
    return trees


def _in_leaves(kind: str, size: int, trees, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), size)
                leaves = np.stack([_leaf_of(x, tree, depth) for tree in trees], axis=1)
                columns = [batch.column(0), _packed(x.astype(kind)), pa.array(leaves.tolist(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "leaves"])

    return run


def _in_cells(single: DataFrame, count: int, kind: str, size: int, block: int) -> tuple[DataFrame, int]:
    """node, vec_id, v, and the cell in each tree; and how many cells the first tree has. Where a leaf holds more than a
    cell may, ids split it. Nodes are numbered from 0 in the order of the first tree's cells."""
    most = max(1, min(SAMPLED, SAMPLED_NUMBERS // max(1, size)))
    share = min(1.0, most / max(1, count))
    in_sample = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = single.filter(in_sample).select("embedding").toArrow()["embedding"].combine_chunks()
    sample = _matrix(sample, max(1, size)) if len(sample) else np.zeros((1, max(1, size)))
    wanted = int(np.ceil(np.log2(max(1, count / block))))
    depth = max(0, min(wanted, int(np.log2(max(1, len(sample) / PER_LEAF)))))
    trees = _trees(sample, depth)
    placed = single.select("vec_id", "embedding").mapInArrow(
        _in_leaves(kind, size, trees, depth), "vec_id long, v binary, leaves array<int>"
    )
    placed = checkpointed(placed)
    cells, blocks = placed, 0
    for tree in range(BEGINNINGS):
        leaf = F.col("leaves")[tree]
        # At most one row per leaf of the tree.
        parts = checkpointed(placed.groupBy(leaf.alias("leaf")).agg(F.ceil(F.count("*") / block).alias("parts")))
        part = F.pmod(F.xxhash64("vec_id", F.lit(tree)), F.col("parts")).cast("int")
        cells = cells.join(F.broadcast(parts), leaf == F.col("leaf"))
        cells = cells.withColumn(f"cell{tree}", F.shiftleft(leaf, PART_BITS) + part).drop("leaf", "parts")
        blocks = blocks or int(parts.agg(F.sum("parts")).first()[0] or 0)
    cells = checkpointed(cells.drop("leaves"))
    # One row per cell.
    sizes = sorted(cells.groupBy("cell0").count().collect())
    begins = np.cumsum([0, *(row["count"] for row in sizes)]).tolist()
    begins = [(row["cell0"], begin) for row, begin in zip(sizes, begins, strict=False)]
    begins = single.sparkSession.createDataFrame(begins, "cell0 int, begin long")
    place = F.row_number().over(Window.partitionBy("cell0").orderBy("vec_id"))
    node = F.col("begin") + place - 1
    cells = cells.join(F.broadcast(begins), "cell0")
    return checkpointed(cells.select(node.alias("node"), "vec_id", "v", *[f"cell{t}" for t in range(BEGINNINGS)])), blocks


# The graph.


def _rows_of(messages: list[tuple]) -> pa.RecordBatch:
    """Messages (part, role, a, b, s, f, n) whose arrays may be None, or packed before."""
    columns = [list(column) for column in zip(*messages, strict=True)]
    packed = [pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in column], pa.binary()) for column in columns[2:6]]
    arrays = [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *packed, pa.array(columns[6], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "role", "a", "b", "s", "f", "n"])


def _dealt(role: int, owner: np.ndarray, *columns: np.ndarray | None) -> list[tuple]:
    """Messages with the rows of a, b, s, f for each owner."""
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])[: len(owner)])
    columns = [None if column is None else column[order] for column in columns]
    return [
        (int(owner[low]), role, *(None if column is None else column[low:high] for column in columns), int(high - low))
        for low, high in zip(begins, [*begins[1:], len(owner)], strict=False)
    ]


def _by_part(step, *arguments):
    """`step` for the messages of each part, which come one after the other; a dictionary of role to messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {}
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if row[0] != part:
                    if held and (sent := step(part, held, *arguments)):
                        yield _rows_of(sent)
                    part, held = row[0], {}
                held.setdefault(row[1], []).append(row[2:])
        if held and (sent := step(part, held, *arguments)):
            yield _rows_of(sent)

    return run


def _to_parts(messages: DataFrame, parts: int) -> DataFrame:
    return messages.repartitionById(parts, "part").sortWithinPartitions("part")


def _all_of(messages: list[tuple], column: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(m[column] for m in messages), kind)


def _links_of(held: dict, links: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """near (-1 where there is none), nearness, fresh of the nodes of a part, the best links first."""
    near, _, s, fresh, _ = held[STATE][0]
    return (np.frombuffer(near, "<i8").reshape(-1, links), np.frombuffer(s, "<f8").reshape(-1, links),
            np.frombuffer(fresh, "?").reshape(-1, links))


def _state(part: int, near: np.ndarray, s: np.ndarray, fresh: np.ndarray) -> tuple:
    return part, STATE, near, None, s, fresh, int(fresh.sum())


def _packing(links: int):
    """Vectors and no links yet of the nodes (part, v) of each part, which come in their order."""

    def messages(part: int, vectors: list[bytes]) -> pa.RecordBatch:
        there = (len(vectors), links)
        state = _state(part, np.full(there, -1, "<i8"), np.full(there, -np.inf), np.zeros(there, "?"))
        return _rows_of([(part, VECTORS, None, None, np.frombuffer(b"".join(vectors), "u1"), None, len(vectors)), state])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, vectors = None, []
        for batch in batches:
            for at, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != part:
                    if vectors:
                        yield messages(part, vectors)
                    part, vectors = at, []
                vectors.append(v)
        if vectors:
            yield messages(part, vectors)

    return run


def _inside_cell(links: int, kind: str, longest: float, per: int):
    """Exact neighbours of the nodes of a cell in their cell, as messages to the owners of the nodes."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        x, square, rest = _lifted(_unpacked(block["v"].tolist(), kind), longest)
        ids = block["node"].to_numpy()
        k = min(links, len(ids) - 1)
        found = []
        for start in range(0, len(ids), 512) if k > 0 else ():
            part = slice(start, start + 512)
            scores = _nearness(x[part] @ x.T, square[part, None], square, rest[part, None], rest)
            own = np.arange(len(scores))
            scores[own, own + start] = -np.inf
            best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(scores, best, 1).ravel()
            found.append((np.repeat(ids[part], k), ids[best].ravel(), near))
        if not found:
            return _rows_of([(0, FOUND, None, None, None, None, 0)]).slice(0, 0).to_pandas()
        a, b, s = map(np.concatenate, zip(*found, strict=True))
        return _rows_of(_dealt(FOUND, a // per, a, b, s, None)).to_pandas()

    return run


def _chance(one: np.ndarray, two: np.ndarray, turn: int) -> np.ndarray:
    """A number from 0 to 1 for each pair, another one each turn."""
    x = one.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ two.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= np.uint64((turn * 0x165667B19E3779F9) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def _ordered(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order by group, whole numbers from 0, and by key within 2 ** -30 of its size. One sort of joint numbers is several
    times as fast as a sort by two columns."""
    bits = np.uint64(max(1, int(group.max(initial=0)).bit_length()))
    x = np.ascontiguousarray(key, dtype="<f8").view(np.uint64)
    x = np.where(x >> np.uint64(63), ~x, x | np.uint64(1 << 63))
    return np.argsort(group.astype(np.uint64) << (np.uint64(64) - bits) | x >> bits)


def _first(group: np.ndarray, key: np.ndarray, n: int, tie: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the n with the smallest keys of their group, and the rank of each from 0. Groups are numbered densely,
    or `tie` decides between equal keys."""
    order = _ordered(group, key) if tie is None else np.lexsort((tie, key, group))
    group = group[order]
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[: len(group)])
    rank = np.arange(len(group)) - np.repeat(begins, np.diff([*begins, len(group)]))
    return order[rank < n], rank[rank < n]


def _followed(near: np.ndarray, fresh: np.ndarray, base: int, turn: int) -> np.ndarray:
    """Which links a round follows: fresh ones first, in another order each round, so that none waits for ever."""
    if near.shape[1] <= FORWARD:
        return near >= 0
    own = np.arange(base, base + len(near))[:, None]
    key = np.where(near >= 0, _chance(np.broadcast_to(own, near.shape), near, turn) + ~fresh, 3.0)
    chosen = np.zeros(near.shape, dtype=bool)
    np.put_along_axis(chosen, np.argsort(key, axis=1)[:, :FORWARD], True, 1)
    return chosen & (near >= 0)


def _send_ends(part: int, held: dict, per: int, links: int, turn: int | None) -> list[tuple]:
    """The links of a part to the owners of their ends: for each end as many as it may follow back, fresh ones first, or in no
    turn the best."""
    near, s, fresh = _links_of(held, links)
    row, column = np.nonzero(near >= 0)
    a, b, f, s = row + part * per, near[row, column], fresh[row, column], s[row, column]
    key = -s if turn is None else _chance(b, a, turn) + ~f
    best, _ = _first(b, key, REVERSED if turn is None else BACKWARD, a)
    return [(part, STATE, *held[STATE][0]), *_dealt(ENDS, b[best] // per, a[best], b[best], s[best], f[best])]


def _turned(held: dict, base: int, key_of, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the links to a part's nodes the first n of each node: its place, the rank, the other end, fresh."""
    ends = held.get(ENDS, [])
    a, b, s, f = _all_of(ends, 0, "<i8"), _all_of(ends, 1, "<i8"), _all_of(ends, 2, "<f8"), _all_of(ends, 3, "?")
    best, rank = _first(b, key_of(a, b, s, f), n, a)
    return b[best] - base, rank, a[best], f[best]


def _ask(part: int, held: dict, per: int, links: int, turn: int) -> list[tuple]:
    """The pivots of a part and their members, and what they want of each part."""
    near, _, fresh = _links_of(held, links)
    base = part * per
    members = np.full((len(near), links + BACKWARD), -1, "<i8")
    new = np.zeros(members.shape, dtype=bool)
    followed = _followed(near, fresh, base, turn)
    members[:, :links], new[:, :links] = np.where(followed, near, -1), fresh & followed
    place, rank, one, f = _turned(held, base, lambda a, b, s, f: _chance(b, a, turn) + ~f, BACKWARD)
    members[place, links + rank], new[place, links + rank] = one, f
    asking = new.any(axis=1)
    members, new = members[asking], new[asking]
    wanted = np.unique(members[members >= 0])
    pivots = (part, PIVOTS, members, None, None, new, len(members))
    return [pivots, *_dealt(WANTED, wanted // per, wanted, np.full(len(wanted), part), None, None)]


def _answer(part: int, held: dict, per: int, links: int) -> list[tuple]:
    """Vectors, and the nearness a candidate must exceed, to those who want them; pivots stay where they are."""
    sent = [(part, PIVOTS, *pivots) for pivots in held.get(PIVOTS, [])]
    near, s, _ = _links_of(held, links)
    least = np.where(near[:, -1] >= 0, s[:, -1], -np.inf)
    x = np.frombuffer(held[VECTORS][0][2], "u1").reshape(len(near), -1)
    for ids, to, *_ in held.get(WANTED, []):
        ids, to = np.frombuffer(ids, "<i8"), np.frombuffer(to, "<i8")
        sent.append((int(to[0]), SENT, ids, None, x[ids - part * per], least[ids - part * per], len(ids)))
    return sent


def _join(part: int, held: dict, per: int, links: int, kind: str, longest: float) -> list[tuple]:
    """Candidates of a part's pivots. Members of a pivot are compared if one of the two is fresh; what is above `least` of an
    end is a candidate for it."""
    answers = held.get(SENT, [])
    if not answers:
        return []
    ids, least = _all_of(answers, 0, "<i8"), _all_of(answers, 3, "<f8")
    order = np.argsort(ids)
    ids, least = ids[order], least[order]
    # In their own type until they are compared, to hold many.
    x = _all_of(answers, 2, kind).reshape(len(ids), -1)[order]
    lifted = [_lifted(x[low : low + 4096].astype(np.float64), longest)[1:] for low in range(0, len(ids), 4096)]
    square, rest = (np.concatenate(column) for column in zip(*lifted, strict=True))
    members, _, _, fresh, count = held[PIVOTS][0]
    members, fresh = np.frombuffer(members, "<i8").reshape(count, -1), np.frombuffer(fresh, "?").reshape(count, -1)
    found, size = [], 0
    for low in range(0, count, 256):
        some, new = members[low : low + 256], fresh[low : low + 256]
        there, place = some >= 0, np.searchsorted(ids, some)
        v = x[place].astype(np.float64) / longest
        near = _nearness(
            v @ v.transpose(0, 2, 1), square[place][:, :, None], square[place][:, None, :],
            rest[place][:, :, None], rest[place][:, None, :],
        )
        good = there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :])
        good &= (some[:, :, None] != some[:, None, :]) & (near > least[place][:, :, None])
        at = np.flatnonzero(good)
        row, two = at // members.shape[1], at % members.shape[1]
        one, two = place.ravel()[row], place.ravel()[row - row % members.shape[1] + two]
        found.append((one, two, near.ravel()[at]))
        size += len(at)
        if size > MOST_HELD:
            found = [_best_of(*map(np.concatenate, zip(*found, strict=True)), links)]
            size = len(found[0][0])
    a, b, s = _best_of(*map(np.concatenate, zip(*found, strict=True)), links)
    return _dealt(FOUND, ids[a] // per, ids[a], ids[b], s, None)


def _merge(part: int, held: dict, per: int, links: int, turn: int) -> list[tuple]:
    """The best links of a part's nodes: those they have, of which the followed ones are no longer fresh, and what was found."""
    near, s, fresh = _links_of(held, links)
    found, base = held.get(FOUND, []), part * per
    row, column = np.nonzero(near >= 0)
    left = fresh & ~_followed(near, fresh, base, turn)
    a = np.concatenate([row, _all_of(found, 0, "<i8") - base])
    b = np.concatenate([near[row, column], _all_of(found, 1, "<i8")])
    s = np.concatenate([s[row, column], _all_of(found, 2, "<f8")])
    f = np.concatenate([left[row, column], np.ones(len(a) - len(row), dtype=bool)])
    # A link the node has comes before the same one found again.
    order = np.argsort(((a << NODE_BITS) + b << 1) + (np.arange(len(a)) >= len(row)))
    a, b, s, f = a[order], b[order], s[order], f[order]
    once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    a, b, s, f = a[once], b[once], s[once], f[once]
    best, rank = _first(a, -s, links)
    merged = np.full(near.shape, -1, "<i8"), np.full(near.shape, -np.inf), np.zeros(near.shape, dtype=bool)
    for packed, column in zip(merged, (b, s, f), strict=True):
        packed[a[best], rank] = column[best]
    return [_state(part, *merged)]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Runs of rows with one cell or shard and one role, the first two columns."""
    for batch in batches:
        cells, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(roles) != 0)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(cells)], strict=True):
            if start < end:
                yield cells[start], roles[start], batch.slice(start, end - start)


def _best_of(a: np.ndarray, b: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n best different links of each node, by the places of nodes."""
    order = np.argsort((a << 32) + b)
    a, b, s = a[order], b[order], s[order]
    once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    a, b, s = a[once], b[once], s[once]
    best, _ = _first(a, -s, n)
    return a[best], b[best], s[best]


def _round(state: DataFrame, vectors: DataFrame, turn: int, parts: int, per: int, links: int, kind: str, longest: float) -> DataFrame:
    """The links of all parts after one round."""
    sent = state.mapInArrow(_by_part(_send_ends, per, links, turn), MESSAGE)
    asked = _to_parts(sent, parts).mapInArrow(_by_part(_ask, per, links, turn), MESSAGE)
    asked = _to_parts(asked.unionByName(vectors).unionByName(state), parts)
    answered = _to_parts(asked.mapInArrow(_by_part(_answer, per, links), MESSAGE), parts)
    found = answered.mapInArrow(_by_part(_join, per, links, kind, longest), MESSAGE)
    merged = _to_parts(found.unionByName(state), parts).mapInArrow(_by_part(_merge, per, links, turn), MESSAGE)
    return checkpointed(merged)


def _lists(values: np.ndarray, q: np.ndarray, count: int) -> pa.ListArray:
    """The values of each q below `count`, which come in its order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(q, np.arange(count + 1)).astype(np.int32)), pa.array(values))


def _reached(per: int, links: int):
    """node, near: the links of each node in both directions, of the reversed ones the best."""

    def lists(part: int, held: dict) -> pa.RecordBatch:
        near, _, _ = _links_of(held, links)
        row, column = np.nonzero(near >= 0)
        place, _, one, _ = _turned(held, part * per, lambda a, b, s, f: -s, REVERSED)
        a, b = np.concatenate([row, place]), np.concatenate([near[row, column], one])
        key = np.unique((a << NODE_BITS) + b)
        a, b = key >> NODE_BITS, key & ((1 << NODE_BITS) - 1)
        lists = _lists(b, a, len(near))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(near)) + part * per), lists], names=["node", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {}
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if row[0] != part:
                    if held:
                        yield lists(part, held)
                    part, held = row[0], {}
                held.setdefault(row[1], []).append(row[2:])
        if held:
            yield lists(part, held)

    return run


def _length() -> Column:
    return F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x * x))


def build_index(vectors: DataFrame, block: int = BLOCK, links: int = LINKS) -> Index:
    """A neighbour graph of all rows of `vectors` (vec_id, embedding; other columns are not read) that take part: those
    `usable`, with the most common number of components."""
    rows = checkpointed(usable(vectors))
    size = commonest_size(rows)
    group = Window.partitionBy("embedding")
    ranked = rows.filter(F.size("embedding") == size).withColumn("rank", F.row_number().over(group.orderBy("vec_id")))
    ranked = ranked.filter(F.col("rank") <= NEAREST + 1).withColumn("first", F.min("vec_id").over(group))
    ranked = checkpointed(ranked)
    single = ranked.filter("rank = 1").select("vec_id", "embedding")
    count, longest = single.agg(F.count("*"), F.max(_length())).first()
    longest, kind = float(longest or 1.0), _kind_of(vectors)
    nodes, blocks = _in_cells(single, count, kind, size, block)
    per = part_nodes_of(count, size)
    parts = max(1, -(-count // per))
    own = nodes.select((F.col("node") / per).cast("int").alias("part"), "node", "v").repartitionById(parts, "part")
    own = own.sortWithinPartitions("part", "node").select("part", "v")
    packed = checkpointed(own.mapInArrow(_packing(links), MESSAGE))
    vectors_of, state = packed.filter(F.col("role") == VECTORS), packed.filter(F.col("role") == STATE)
    begun = state
    for tree in range(BEGINNINGS):
        found = nodes.select("node", "v", f"cell{tree}").groupBy(f"cell{tree}")
        begun = begun.unionByName(found.applyInPandas(_inside_cell(links, kind, longest, per), MESSAGE))
    state = checkpointed(_to_parts(begun, parts).mapInArrow(_by_part(_merge, per, links, 0), MESSAGE))
    for turn in count_from(1):
        state = _round(state, vectors_of, turn, parts, per, links, kind, longest)
        release(vectors.sparkSession)
        if (state.agg(F.sum("n")).first()[0] or 0) <= SETTLED * count * links:
            break
    ends = _to_parts(state.mapInArrow(_by_part(_send_ends, per, links, None), MESSAGE), parts)
    reached = checkpointed(ends.mapInArrow(_reached(per, links), "node long, near array<long>"))
    named = nodes.select("node", F.col("vec_id").alias("first"))
    members = checkpointed(ranked.select("first", "vec_id").join(named, "first").select("node", "vec_id"))
    placed = checkpointed(single.join(nodes.select("node", "vec_id"), "vec_id").select("node", "embedding"))
    nodes = nodes.select("node", "vec_id", "v")
    return Index(nodes, placed, members, reached, blocks, shards_of(count, size), kind, longest, size)


# Search.


def _query_packed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), size)
                # The length of a query does not change its order of nodes.
                rows = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f8")
                yield pa.RecordBatch.from_arrays([batch.column(0), _packed(rows)], names=["a", "v"])

    return run


def _entering(ids: np.ndarray, x: np.ndarray):
    """The best of the common entries for each query, as found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = min(ENTERED, len(ids))
        for batch in batches:
            for low in range(0, batch.num_rows, 4096) if k else ():
                part = batch.slice(low, 4096)
                scores = _unpacked(part.column(1).to_pylist(), "<f8") @ x.T
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                yield _found(part.column(0).to_numpy(), ids[best], np.take_along_axis(scores, best, 1))

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, b, s as found."""
    for batch in batches:
        if batch.num_rows:
            yield _found(*(column.to_numpy() for column in batch.columns))


def _found(a: np.ndarray, b, s) -> pa.RecordBatch:
    """Nodes found for each query a: an array, or one, of each."""
    packed = [pa.array([row.tobytes() for row in column], pa.binary()) for column in (b, s)]
    none = pa.nulls(len(a), pa.binary())
    columns = [pa.array(a), pa.array(np.ones(len(a), np.int32)), none, *packed, none, pa.array(np.zeros(len(a), np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "role", "v", "b", "s", "f", "n"])


def _by_query(step):
    """`step` for some queries at a time: their states (role 0) and, for each, what was found for it (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, found = [], []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if row[1] == 1:
                    found.append((len(states) - 1, row))
                    continue
                if len(states) == 200:
                    yield step(states, found)
                    states, found = [], []
                states.append(row)
        if states:
            yield step(states, found)

    return run


def _beams(states: list[tuple]) -> tuple[np.ndarray, ...]:
    """query, node, score, closed of the nodes in the beams."""
    b, s, closed = (np.frombuffer(b"".join(row[k] for row in states), kind) for k, kind in ((3, "<i8"), (4, "<f8"), (5, "?")))
    return np.repeat(np.arange(len(states)), [len(row[5]) for row in states]), b, s, closed


def _of_found(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, node, score of what was found."""
    b, s = (np.frombuffer(b"".join(row[k] or b"" for _, row in found), kind) for k, kind in ((3, "<i8"), (4, "<f8")))
    return np.repeat(np.array([q for q, _ in found], dtype=np.int64), [len(row[3]) // 8 for _, row in found]), b, s


def _taken(q: np.ndarray, b: np.ndarray, s: np.ndarray, closed: np.ndarray, opened: int) -> np.ndarray:
    """The places of the nodes that are opened next."""
    free = np.flatnonzero(~closed)
    best, _ = _first(q[free], -s[free], opened)
    return free[best]


def _opening(opened: int):
    """Requests for the links of the nodes a query opens next."""

    def step(states: list[tuple], found: list[tuple]) -> pa.RecordBatch:
        q, b, s, closed = _beams(states)
        taken = _taken(q, b, s, closed, opened)
        wanted = _lists(b[taken], q[taken], len(states))
        columns = [pa.array([row[0] for row in states], pa.int64()), pa.array([b""] * len(states), pa.binary())]
        columns += [pa.array(np.zeros(len(states))), wanted]
        batch = pa.RecordBatch.from_arrays(columns, names=["a", "v", "least", "wanted"])
        return batch.filter(pa.array(np.diff(wanted.offsets.to_numpy()) > 0))

    return _by_query(step)


def _asking(beam: int):
    """Requests for the scores of the nodes found that are not in the beam."""

    def step(states: list[tuple], found: list[tuple]) -> pa.RecordBatch:
        q, b, s, _ = _beams(states)
        near_q, near, _ = _of_found(found)
        new = np.setdiff1d((near_q << NODE_BITS) + near, (q << NODE_BITS) + b)
        held, least = np.bincount(q, minlength=len(states)), np.full(len(states), np.inf)
        np.minimum.at(least, q, s)
        wanted = _lists(new & ((1 << NODE_BITS) - 1), new >> NODE_BITS, len(states))
        columns = [pa.array([row[0] for row in states], pa.int64()), pa.array([row[2] for row in states], pa.binary())]
        columns += [pa.array(np.where(held > beam, least, -np.inf)), wanted]
        batch = pa.RecordBatch.from_arrays(columns, names=["a", "v", "least", "wanted"])
        return batch.filter(pa.array(np.diff(wanted.offsets.to_numpy()) > 0))

    return _by_query(step)


def _keeping(beam: int, opened: int):
    """The beams after what they opened is closed and what was found has come in; n: how many nodes are not open yet."""

    def step(states: list[tuple], found: list[tuple]) -> pa.RecordBatch:
        q, b, s, closed = _beams(states)
        closed = closed.copy()
        closed[_taken(q, b, s, closed, opened)] = True
        new_q, new, scores = _of_found(found)
        q, b, s = np.concatenate([q, new_q]), np.concatenate([b, new]), np.concatenate([s, scores])
        closed = np.concatenate([closed, np.zeros(len(new), dtype=bool)])
        order = np.argsort((q << NODE_BITS) + b)
        q, b, s, closed = q[order], b[order], s[order], closed[order]
        once = np.concatenate([[True], (q[1:] != q[:-1]) | (b[1:] != b[:-1])])[: len(q)]
        q, b, s, closed = q[once], b[once], s[once], closed[once]
        best, _ = _first(q, -s, beam + 1)
        q, b, s, closed = q[best], b[best], s[best], closed[best]
        cuts = np.searchsorted(q, np.arange(len(states) + 1))
        rows = list(zip(cuts, cuts[1:], strict=False))
        packed = [pa.array([column[low:high].tobytes() for low, high in rows], pa.binary()) for column in (b, s, closed)]
        columns = [pa.array([row[0] for row in states], pa.int64()), pa.array(np.zeros(len(states), np.int32))]
        columns += [pa.array([row[2] for row in states], pa.binary()), *packed, pa.array([int((~closed[low:high]).sum()) for low, high in rows], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["a", "role", "v", "b", "s", "f", "n"])

    return _by_query(step)


def _best_nodes(n: int):
    """a, b for the n best nodes of each beam."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [np.frombuffer(b, "<i8")[:n] for b in batch.column(3).to_pylist()]
            if nodes:
                a = np.repeat(batch.column(0).to_numpy(), [len(b) for b in nodes])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.concatenate(nodes))], names=["a", "b"])

    return run


def _by_shard(shards: int):
    """Requests a, v, least, wanted as one row for each shard that holds some of the wanted nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                counts = np.diff(part.column(3).offsets.to_numpy())
                wanted, asking = part.column(3).flatten().to_numpy(), np.repeat(np.arange(len(counts)), counts)
                shard = wanted % shards
                order = np.lexsort((wanted, shard, asking))
                wanted, shard, asking = wanted[order], shard[order], asking[order]
                new = np.concatenate([[True], (shard[1:] != shard[:-1]) | (asking[1:] != asking[:-1])])[: len(shard)]
                begins = np.flatnonzero(new)
                at = pa.array(asking[begins])
                lists = pa.ListArray.from_arrays(pa.array([*begins, len(shard)], pa.int32()), pa.array(wanted))
                columns = [
                    pa.array(shard[begins].astype(np.int32)), pa.array(np.ones(len(begins), np.int32)),
                    *(part.column(k).take(at) for k in range(3)), lists,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "role", "id", "v", "least", "wanted"])

    return run


def _following(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that requests reach from the nodes they want, whose links come before them in the stream."""
    shard, held, known = None, [], None
    for at, role, part in _segments(batches):
        if at != shard:
            shard, held, known = at, [], None
        counts, lists = np.diff(part.column(5).offsets.to_numpy()), part.column(5).flatten().to_numpy()
        if role == 0:
            held.append((part.column(2).to_numpy(), counts, lists))
            continue
        if known is None:
            ids, sizes, near = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(ids)
            known, held = (ids[order], sizes[order], (np.cumsum(sizes) - sizes)[order], near), []
        ids, sizes, begins, near = known
        place = np.searchsorted(ids, lists)
        size = sizes[place]
        # The places of all links of the wanted nodes, one list after the other.
        at_link = np.arange(size.sum()) + np.repeat(begins[place] - (np.cumsum(size) - size), size)
        asking = np.repeat(np.repeat(np.arange(len(counts)), counts), size)
        key = np.unique((asking << NODE_BITS) + near[at_link])
        cuts = np.searchsorted(key >> NODE_BITS, np.arange(len(counts) + 1))
        reached = key & ((1 << NODE_BITS) - 1)
        rows = [reached[low:high] for low, high in zip(cuts, cuts[1:], strict=False)]
        yield _found(part.column(2).to_numpy(), rows, [np.zeros(0)] * len(rows))


def _scoring(kind: str, longest: float):
    """Inner products of requests with the vectors of their shard, which come before them in the stream: shard, role, id, v,
    least, wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, known = None, [], None
        for at, role, part in _segments(batches):
            if at != shard:
                shard, held, known = at, [], None
            if role == 0:
                held.append((part.column(2).to_numpy(), part.column(3).to_pylist()))
                continue
            if known is None:
                ids, x = np.concatenate([h[0] for h in held]), _unpacked([v for h in held for v in h[1]], kind) / longest
                order = np.argsort(ids)
                known, held = (ids[order], x[order]), []
            ids, x = known
            for low in range(0, part.num_rows, 500):
                some = part.slice(low, 500)
                counts = np.diff(some.column(5).offsets.to_numpy())
                wanted, asking = some.column(5).flatten().to_numpy(), np.repeat(np.arange(len(counts)), counts)
                q = _unpacked(some.column(3).to_pylist(), "<f8")
                s = np.empty(len(wanted))
                for k in range(0, len(wanted), 20_000):
                    own = slice(k, k + 20_000)
                    s[own] = np.einsum("ij,ij->i", q[asking[own]], x[np.searchsorted(ids, wanted[own])])
                good = s > some.column(4).to_numpy()[asking]
                cuts = np.searchsorted(asking[good], np.arange(len(counts) + 1))
                rows = list(zip(cuts, cuts[1:], strict=False))
                b, s = wanted[good], s[good]
                yield _found(some.column(2).to_numpy(), [b[low:high] for low, high in rows], [s[low:high] for low, high in rows])

    return run


def _ask_shards(requests: DataFrame, index: Index, v: str, wanted: str, answering) -> DataFrame:
    """What `answering` finds for requests (a, v, least, wanted), from the columns v or wanted of the nodes."""
    request_type = "shard int, role int, id long, v binary, least double, wanted array<long>"
    asked = requests.mapInArrow(_by_shard(index.shards), request_type)
    rows = index.nodes if wanted == "null" else index.links
    held = rows.select(
        F.pmod("node", F.lit(index.shards)).cast("int").alias("shard"), F.lit(0).alias("role"), F.col("node").alias("id"),
        F.expr(v).cast("binary").alias("v"), F.lit(None).cast("double").alias("least"), F.expr(wanted).cast("array<long>").alias("wanted"),
    )
    ordered = held.unionByName(asked).repartitionById(index.shards, "shard").sortWithinPartitions("shard", "role")
    return ordered.mapInArrow(answering, BEAM_TYPE)


def _with_found(state: DataFrame, found: DataFrame) -> DataFrame:
    return state.unionByName(found).repartition("a").sortWithinPartitions("a", "role")


def search_index(index: Index, queries: DataFrame, nearest: int = NEAREST, beam: int = BEAM, opened: int = OPENED) -> DataFrame:
    """query_id, rank, vec_id, score: the `nearest` rows found for each row of queries (vec_id, embedding), without its own.

    Scores are inner products of the given vectors in double precision; equal ones rank by vec_id. Equal query
    vectors are searched once. Queries whose vectors have another number of components than the index take no part.
    """
    asked = usable(queries).filter(F.size("embedding") == index.size)
    asked = checkpointed(
        asked.withColumn("a", F.min("vec_id").over(Window.partitionBy("embedding"))).withColumnRenamed("vec_id", "query_id")
    )
    distinct = asked.filter("query_id = a").select("a", "embedding")
    by_chance = index.vectors.orderBy(F.xxhash64("node"), "node").limit(ENTRIES)
    by_length = index.vectors.orderBy(F.desc(_length()), "node").limit(LONG_ENTRIES)
    entries = {row.node: row.embedding for row in by_chance.union(by_length).collect()}
    points = np.array(list(entries.values()), dtype=np.float64).reshape(len(entries), max(1, index.size)) / index.longest
    packed = checkpointed(distinct.mapInArrow(_query_packed(index.size), "a long, v binary"))
    entered = packed.mapInArrow(_entering(np.array(list(entries), dtype=np.int64), points), BEAM_TYPE)
    own = distinct.join(index.vectors, "embedding").select("a", F.col("node").alias("b"), (_length() / index.longest).alias("s"))
    none = F.lit(b"")
    state = packed.select("a", F.lit(0).alias("role"), "v", none.alias("b"), none.alias("s"), none.alias("f"), F.lit(0).cast("long").alias("n"))
    found = entered.unionByName(own.mapInArrow(_own, BEAM_TYPE))
    requests = "a long, v binary, least double, wanted array<long>"
    while True:
        state = checkpointed(_with_found(state, found).mapInArrow(_keeping(beam, opened), BEAM_TYPE))
        release(queries.sparkSession)
        if not state.agg(F.sum("n")).first()[0]:
            break
        # At most `opened` nodes, and their LINKS + REVERSED links each.
        front = _ask_shards(state.mapInArrow(_opening(opened), requests), index, "null", "near", _following)
        wanted = _with_found(state, front).mapInArrow(_asking(beam), requests)
        found = _ask_shards(wanted, index, "v", "null", _scoring(index.kind, index.longest))
    # Scores so far were of shares of lengths: some more than are needed are taken and scored as they are given.
    last = state.mapInArrow(_best_nodes(nearest + 11), "a long, b long")
    exact = (
        last.join(distinct.select("a", F.col("embedding").alias("qv")), "a")
        .join(index.vectors.select(F.col("node").alias("b"), F.col("embedding").alias("xv")), "b")
        .select("a", "b", F.aggregate(F.zip_with("qv", "xv", lambda q, x: q * x), F.lit(0.0), lambda t, p: t + p).alias("score"))
    )
    classes = checkpointed(exact.join(index.members.withColumnRenamed("node", "b"), "b").select("a", "vec_id", "score"))
    few = Window.partitionBy("a").orderBy(F.desc("score"), "vec_id")
    classes = classes.withColumn("place", F.row_number().over(few)).filter(F.col("place") <= nearest + 1)
    rows = asked.select("query_id", "a").join(classes, "a").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def every_twentieth(vectors: DataFrame) -> DataFrame:
    """Neighbours of the rows whose vec_id is divisible by 20 among all rows of `vectors`.

    Rows whose vector is null, zero, or holds null or non-finite components take no part, as query or as candidate,
    nor do rows without vec_id, nor vectors with another number of components than most; rows that repeat a vec_id count
    once. With fewer candidates all are returned; an empty table gives no rows.
    """
    return search_index(build_index(vectors), vectors.filter(F.col("vec_id") % 20 == 0))
