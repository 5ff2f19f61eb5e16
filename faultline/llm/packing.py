"""Hierarchical packing of documents into training windows of several lengths.

Each task packs the documents of its own split, so nothing is shuffled. Documents are encoded, whole windows
are cut from those that exceed the longest context, and every rest is routed to the shortest context tier
that holds it. Tiers are packed from the longest down; the gap of a window is filled with the largest fitting
documents of the same or shorter tiers, and what then remains is filled exactly by cutting one more. The rest of a
task, less than a window of the shortest tier, is cut along its binary digits, so no window needs padding.
Windows are then dealt into step groups of about equal attention cost.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import text_of
from faultline.llm.words import word_encoder

TIERS = (4096, 2048, 1024, 512)
#: Tokens of a step group.
STEP_TOKENS = 8 * 4096
#: Tokens a task gathers before it packs them.
BUFFER_TOKENS = 1 << 20
END = 2

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_id long"
)

#: A piece: (length, document in the buffer, start in its ids).
Piece = tuple[int, int, int]


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list, list[Piece]]:
    """Windows (tier, pieces) for documents of these lengths, and the pieces left for later.

    Every window is exactly full. With `last` nothing is left: the rest becomes windows along its binary digits.
    """
    return _pack_pieces([(n, i, 0) for i, n in enumerate(lengths) if n], tiers, last)


def _pack_pieces(pieces: list[Piece], tiers: tuple[int, ...], last: bool) -> tuple[list, list[Piece]]:
    longest = tiers[0]
    windows: list[tuple[int, list[Piece]]] = []
    waiting: dict[int, list[Piece]] = {tier: [] for tier in tiers}
    for n, doc, start in pieces:
        while n > longest:
            windows.append((longest, [(longest, doc, start)]))
            n, start = n - longest, start + longest
        waiting[min(tier for tier in tiers if tier >= n)].append((n, doc, start))
    for tier in tiers:
        waiting[tier].sort()

    def fill(tier: int, filled: list[Piece], gap: int, below: tuple[int, ...]) -> None:
        """Fill the gap: the largest pieces that fit, from the longer tiers first, then one that is cut."""
        for source in below:
            heap = waiting[source]
            while gap and (k := bisect_right(heap, (gap, 1 << 62, 0))):
                piece = heap.pop(k - 1)
                filled.append(piece)
                gap -= piece[0]
        if gap:
            for source in reversed(below):
                if waiting[source]:
                    n, doc, start = waiting[source].pop()
                    filled.append((gap, doc, start))
                    rest = n - gap
                    insort(waiting[min(t for t in tiers if t >= rest)], (rest, doc, start + gap))
                    break
        windows.append((tier, filled))

    for k, tier in enumerate(tiers):
        while waiting[tier] and sum_at_least(waiting, tiers[k:], tier):
            piece = waiting[tier].pop()
            fill(tier, [piece], tier - piece[0], tiers[k:])
    left = [piece for tier in tiers for piece in waiting[tier]]
    if not last or not left:
        return windows, left
    total, digit = sum(n for n, _, _ in left), longest
    left.sort(reverse=True)
    while total:
        while digit > total:
            digit //= 2
        filled, gap = [], digit
        while gap:
            n, doc, start = left.pop()
            used = min(n, gap)
            filled.append((used, doc, start))
            gap -= used
            if n > used:
                left.append((n - used, doc, start + used))
        windows.append((digit, filled))
        total -= digit
    return windows, []


def sum_at_least(waiting: dict[int, list[Piece]], tiers: tuple[int, ...], least: int) -> bool:
    """Whether the pieces waiting in these tiers fill a window."""
    total = 0
    for tier in tiers:
        for piece in reversed(waiting[tier]):
            total += piece[0]
            if total >= least:
                return True
    return False


def steps(windows: list, step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each window: about `step_tokens` tokens each, attention cost dealt out evenly."""
    groups = max(1, -(-sum(tier for tier, _ in windows) // step_tokens))
    cost = [sum(n * n for n, _, _ in pieces) for _, pieces in windows]
    found = [0] * len(windows)
    order = sorted(range(len(windows)), key=lambda i: (-windows[i][0], -cost[i], i))
    for rank, i in enumerate(order):
        turn, place = divmod(rank, groups)
        found[i] = place if turn % 2 == 0 else groups - 1 - place
    return found


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    buffer_tokens: int = BUFFER_TOKENS,
) -> DataFrame:
    """Pieces of all documents (doc_id, text; other columns are not read) in windows of the tiers' lengths.

    A document is its ids by the tokenizer file, then the id 2; a null text counts as empty (one id). Rows
    that repeat are packed as often as they occur; a null doc_id stays null. Each id is in exactly one piece.
    An empty table gives no rows. sequence_id and step_id are unique over the result, gaps are possible.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        base = TaskContext.get().partitionId() << 33
        buffer = _Buffer(base, tiers, step_tokens)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, text in zip(ids, texts, strict=True):
                buffer.add(doc_id, encode(text))
                if buffer.tokens >= buffer_tokens:
                    yield buffer.flush(last=False)
        if buffer.documents:
            yield buffer.flush(last=True)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, SCHEMA)


class _Buffer:
    """Documents of a task that are not packed yet."""

    def __init__(self, base: int, tiers: tuple[int, ...], step_tokens: int):
        self.base, self.tiers, self.step_tokens = base, tiers, step_tokens
        self.documents: list[tuple[int | None, np.ndarray]] = []
        self.pieces: list[Piece] = []
        self.tokens = self.sequences = self.groups = 0

    def add(self, doc_id: int | None, encoded: np.ndarray) -> None:
        ids = np.append(encoded, np.uint32(END)).astype("<u4")
        self.pieces.append((len(ids), len(self.documents), 0))
        self.documents.append((doc_id, ids))
        self.tokens += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch:
        windows, left = _pack_pieces(self.pieces, self.tiers, last)
        rows: list[tuple] = []
        for (tier, pieces), group in zip(windows, steps(windows, self.step_tokens), strict=True):
            offset = 0
            for n, doc, start in pieces:
                doc_id, ids = self.documents[doc]
                crc = zlib.crc32(ids[start : start + n].tobytes())
                rows.append(
                    (doc_id, start, n, crc, len(ids), self.base + self.sequences, offset, tier, self.base + self.groups + group)
                )
                offset += n
            self.sequences += 1
        self.groups += max(1, len(windows))
        kept = sorted({doc for _, doc, _ in left})
        place = {doc: i for i, doc in enumerate(kept)}
        self.documents = [self.documents[doc] for doc in kept]
        self.pieces = [(n, place[doc], start) for n, doc, start in left]
        self.tokens = sum(n for n, _, _ in self.pieces)
        columns = list(zip(*rows, strict=True)) if rows else [()] * 9
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays(
            [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)], names=names
        )


