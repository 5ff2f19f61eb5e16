"""Text quality by voting of nearest labelled neighbours in a latent-semantic space.

Terms of a document are the kinds of three neighbouring characters (upper, lower, digit, signs and so on),
how often a word repeats the one before, and lengths of words and lines. Frequencies are damped and weighted by the
inverse document frequency; a truncated singular value decomposition of a bounded labelled sample gives the
latent space. The labelled vectors are few and broadcast; every document takes exact cosines with all of them, block
by block, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import checkpointed, crc_remainder, text_of
from faultline.llm.labelled import labelled_sample

DIVISOR, HELD_OUT = 4, 2
#: Labelled documents that are learnt from, of low and of high quality.
MOST_LOW, MOST_HIGH = 3000, 4000
DIMENSIONS, NEIGHBOURS, SHARPNESS = 48, 15, 8.0
LIMIT = 0.7
BLOCK = 256
#: Signs that are kinds of their own; all others share one.
SIGNS = ".,!|#*$%&<>{}=/\\-_()\"':;?@"
KINDS = 8 + len(SIGNS)


def kind_of(letter: str) -> int:
    """The kind of a character; a mark that joins a letter counts as a small letter."""
    if letter.isupper():
        return 0
    if letter.isalpha() or unicodedata.category(letter)[0] == "M":
        return 1
    if letter.isdigit():
        return 2
    if letter == "\n":
        return 4
    if letter.isspace():
        return 3
    return 8 + SIGNS.index(letter) if letter in SIGNS else 7


#: The kind of each Latin-1 character.
KIND_OF = np.array([kind_of(chr(code)) for code in range(256)], np.int64)


def kinds_of(text: str) -> np.ndarray:
    """The kind of each character of a text."""
    if text.isascii():
        return KIND_OF[np.frombuffer(text.encode("ascii"), np.uint8)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    found = KIND_OF[np.minimum(codes, 255)]
    beyond = np.flatnonzero(codes > 255)
    if len(beyond):
        letters, place = np.unique(codes[beyond], return_inverse=True)
        found[beyond] = np.array([kind_of(chr(code)) for code in letters.tolist()])[place]
    return found
#: Measures besides the character kinds: repeated words, distinct words, and classes of word and line lengths.
EXTRAS = 2 + 12 + 8
TERMS = KINDS**2 + 512 + EXTRAS


def terms(text: str) -> np.ndarray:
    """Frequencies of a document's terms; all zero for an empty text."""
    found = np.zeros(TERMS)
    if not text:
        return found
    kinds = kinds_of(text)
    pairs = kinds[:-1] * KINDS + kinds[1:]
    n = len(kinds)
    found[: KINDS**2] = np.bincount(pairs, minlength=KINDS**2) / n
    if n > 2:
        coarse = np.minimum(kinds, 7)
        triples = (coarse[:-2] * 8 + coarse[1:-1]) * 8 + coarse[2:]
        found[KINDS**2 : KINDS**2 + 512] = np.bincount(triples, minlength=512) / n
    words = text.split()
    if words:
        m = len(words)
        extras = found[KINDS**2 + 512 :]
        extras[0] = sum(a == b for a, b in pairwise(words)) / m
        extras[1] = 1 - len(set(words)) / m
        lengths = np.minimum(np.fromiter(map(len, words), np.int64, m), 23) // 2
        extras[2:14] = np.bincount(lengths, minlength=12) / m
        lines = np.fromiter(map(len, text.split("\n")), np.int64)
        classes = np.minimum(np.log2(lines + 1).astype(np.int64) // 2, 7)
        extras[14:22] = np.bincount(classes, minlength=8) / len(lines)
    return found


def damped(frequencies: np.ndarray) -> np.ndarray:
    """Logarithms of frequencies, so that a rare kind still counts and a common one does not swamp it."""
    return np.log1p(frequencies * 200)


@dataclass
class Space:
    """Term weights, axes, and the labelled vectors of length one with their labels."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def place(self, frequencies: np.ndarray) -> np.ndarray:
        points = damped(frequencies) * self.weights @ self.axes
        return (points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def score(self, frequencies: np.ndarray) -> np.ndarray:
        """The share of high quality among the nearest labelled neighbours, weighted by similarity."""
        if not len(self.labels):
            return np.full(len(frequencies), 0.5)
        cosines = self.place(frequencies) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6).astype(np.float64) ** SHARPNESS
        return (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)


def learn(frequencies: np.ndarray, labels: np.ndarray) -> Space:
    """The latent space of labelled documents, a row each."""
    if not len(labels):
        return Space(np.zeros(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1), np.float32), labels)
    weights = np.log((1 + len(labels)) / (1 + (frequencies > 0).sum(axis=0)))
    weights = 0.3 + weights / max(weights.max(), 1e-9)
    weighted = damped(frequencies) * weights.astype(frequencies.dtype)
    _, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    del weighted
    space = Space(weights, vectors[:, ::-1][:, :DIMENSIONS], np.zeros((0, 1), np.float32), labels.astype(float))
    space.vectors = space.place(frequencies)
    return space


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            found = [terms(text).astype("<f4").tobytes() for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["label", "terms"])


def fit(docs: DataFrame, labels: DataFrame) -> Space:
    """Learn from at most `MOST_LOW` and `MOST_HIGH` labelled documents that are not held out."""
    sample = labelled_sample(docs, labels, "quality", DIVISOR, HELD_OUT, {0: MOST_LOW, 1: MOST_HIGH})
    rows = checkpointed(sample.orderBy("doc_id").select("label", "text").mapInArrow(_terms_of, "label int, terms binary"))
    table = rows.toPandas()
    if not len(table):
        return learn(np.zeros((0, TERMS)), np.zeros(0))
    found = table["label"].to_numpy()
    frequencies = np.frombuffer(b"".join(table["terms"]), "<f4").reshape(len(table), TERMS)
    del table
    return learn(frequencies, found)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A quality score for each row of `docs` (doc_id, text; other columns are not read).

    `labels` (doc_id, quality) are learnt from where crc32(doc_id) mod 4 is not 2. A null text counts as
    empty; an empty text has no direction, so its neighbours are arbitrary but the same ones in each run. Rows that
    repeat give repeated rows; an empty table gives none. Without labels all scores are 0.5.

    Columns: doc_id, held_out, score (0 to 1), predicted (1 from 0.7 on).
    """
    space = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                scores = space.score(np.stack([terms(text) for text in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", text_of().alias("text"))
    scored = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select(
        "doc_id",
        (crc_remainder(F.col("doc_id"), DIVISOR) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= LIMIT).cast("int").alias("predicted"),
    )
