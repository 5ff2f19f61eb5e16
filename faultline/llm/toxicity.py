"""Toxicity by a support vector machine with a subsequence string kernel on words of sentences.

The kernel counts common subsequences of three letters, a gap costing a factor, so an insult with letters
inserted, signs between its letters, or spelt letter by letter still resembles it. Labels belong to whole documents: a toxic
one holds at least one insult, a clean one none. Training is multiple-instance: every word of a clean text is a
negative instance, of a toxic text the words that no clean text has are candidates, and rounds of training weigh the
candidates that explain a text best: those that score high and are in many toxic texts. Nyström landmarks make the kernel linear, and because the
kernel is a sum over letter triples, the trained machine is one weight per triple. A document is measured by its
worst word and by how many words are insults, calibrated on labelled documents the machine has not seen.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import checkpointed, crc_remainder, text_of
from faultline.llm.labelled import labelled_sample

#: Labelled documents that are learnt from, toxic and clean, and words of clean texts.
MOST_TOXIC, MOST_CLEAN, CLEAN_WORDS = 2500, 6000, 60_000
#: Clean words drawn as negative instances, and those that score highest added after each round.
DRAWN, HARD = 6000, 1500
#: Candidate words of a toxic text in training.
BAG_WORDS = 48
LANDMARKS = 160
ROUNDS = 5
#: Words whose variants with an inserted letter are learnt, too.
SURE = 300
#: Cost of a gap of one letter, and the longest span of three letters that counts.
DECAY, SPAN = 0.75, 7
#: Longer strings of letters are scored in overlapping windows.
LONGEST, WINDOW, STEP = 16, 12, 4
DIVISOR, HELD_OUT, CALIBRATES = 5, 0, 1
KNOWN_WORDS = 500_000
LETTERS = 26
#: Margins from which on a word is normalised exactly rather than by its length.
EXACT_FROM = -0.7

_SIGNS = bytes(b for b in range(256) if not (97 <= b <= 122 or b in b" \t\n\r\x0b\x0c"))
_SPELT = re.compile(rb"(?<![a-z])[a-z](?:[ \n][a-z](?![a-z])){2,}")


def plain_words(text: str) -> list[bytes]:
    """Words of a text as Latin letters without accents and signs; letters that stand alone in a row are a word, too."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    letters = text.encode("ascii", "ignore").translate(None, _SIGNS)
    words = letters.split()
    words += [run[::2] for run in _SPELT.findall(letters)]
    return words


@lru_cache(maxsize=64)
def triples(length: int) -> tuple[list[tuple[int, int, int, float]], float]:
    """Places of three letters in a word of this length with their weight, and the norm of all."""
    found = [
        (i, j, k, DECAY ** (k - i - 2))
        for i in range(length)
        for j in range(i + 1, min(length, i + SPAN - 1))
        for k in range(j + 1, min(length, i + SPAN))
    ]
    return found, sum(w * w for *_, w in found) ** 0.5


def windows(word: bytes) -> list[bytes]:
    if len(word) <= LONGEST:
        return [word]
    return [word[k : k + WINDOW] for k in range(0, len(word) - WINDOW + STEP, STEP)]


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words of one length, and their letters as numbers, a row per word."""
    places = defaultdict(list)
    for k, word in enumerate(words):
        places[len(word)].append(k)
    for length, own in places.items():
        if length >= 3:
            yield np.array(own), np.frombuffer(b"".join(words[k] for k in own), np.uint8).reshape(-1, length) - 97


def kernel_map(words: list[bytes]) -> np.ndarray:
    """Rows whose inner products are the kernel, normalised."""
    found = np.zeros((len(words), LETTERS**3), np.float32)
    for own, letters in by_length(words):
        letters = letters.astype(np.int64)
        for i, j, k, weight in triples(letters.shape[1])[0]:
            found[own, (letters[:, i] * LETTERS + letters[:, j]) * LETTERS + letters[:, k]] += weight
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)


def norms(letters: np.ndarray) -> np.ndarray:
    """The kernel's norm of words of one length: triples that occur more than once add up before they are squared."""
    places = triples(letters.shape[1])[0]
    letters = letters.astype(np.int32)
    codes = np.stack([(letters[:, i] * LETTERS + letters[:, j]) * LETTERS + letters[:, k] for i, j, k, _ in places], 1)
    order = np.argsort(codes, axis=1, kind="stable")
    codes = np.take_along_axis(codes, order, 1)
    weights = np.array([w for *_, w in places])[order]
    first = np.ones(codes.shape, bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    group = np.cumsum(first.ravel()) - 1
    sums = np.bincount(group, weights=weights.ravel())
    owner = np.nonzero(first)[0]
    return np.sqrt(np.bincount(owner, weights=sums**2, minlength=len(codes)))


@dataclass
class Machine:
    """The trained machine: a weight for each letter triple, a bias, and the calibration of a document's measures."""

    weights: np.ndarray
    bias: float
    slopes: tuple[float, ...] = (1.0, 0.0, 0.0)
    shift: float = 0.0

    def score_words(self, words: list[bytes]) -> np.ndarray:
        found = np.full(len(words), self.bias)
        for own, letters in by_length(words):
            places, norm = triples(letters.shape[1])
            letters = letters.astype(np.int32)
            total = np.zeros(len(own))
            for i, j, k, weight in places:
                total += weight * self.weights[(letters[:, i] * LETTERS + letters[:, j]) * LETTERS + letters[:, k]]
            # A norm by length alone is at most the norm, so margins below the bound are only brought nearer to the bias.
            near = np.flatnonzero(total / norm + self.bias > EXACT_FROM)
            norm = np.full(len(own), norm)
            if len(near):
                norm[near] = norms(letters[near])
            found[own] += total / norm
        return found

    def measure(self, texts: list[str], known: dict[bytes, float]) -> np.ndarray:
        """For each text the margin of its worst word, and the logarithms of how many words, and of what share of all,
        have a positive margin; `known` remembers words."""
        if len(known) > KNOWN_WORDS:
            known.clear()
        split = [plain_words(text) for text in texts]
        new = list(set().union(*split).difference(known)) if split else []
        parts = [windows(word) for word in new]
        flat = self.score_words([part for own in parts for part in own])
        at = 0
        for word, own in zip(new, parts, strict=True):
            known[word] = float(flat[at : at + len(own)].max())
            at += len(own)
        found = np.empty((len(texts), 3))
        for k, words in enumerate(split):
            margins = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
            insults = int((margins > 0).sum())
            worst = margins.max() if len(words) else self.bias
            found[k] = worst, np.log1p(insults), np.log((insults + 0.2) / (len(words) + 20))
        return found

    def logit(self, measures: np.ndarray) -> np.ndarray:
        return measures @ np.array(self.slopes) + self.shift


def separate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 20.0) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        short = 1 - y * (x @ w)
        active = short > 0
        xa, ca = x[active], cost * weight[active]
        gradient = ridge @ w - xa.T @ (ca * y[active] * short[active])
        step = np.linalg.solve(ridge + xa.T @ (xa * ca[:, None]), gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def divided(members: list[np.ndarray], strength: np.ndarray) -> np.ndarray:
    """One unit for each bag, divided among its words by their strength; the sum for each word."""
    share = np.zeros(len(strength))
    for own in members:
        share[own] += strength[own] / strength[own].sum()
    return share


def inserted(word: bytes, rng: np.random.Generator) -> bytes:
    """The word with one more letter inside."""
    k = int(rng.integers(1, len(word)))
    return word[:k] + bytes([97 + int(rng.integers(LETTERS))]) + word[k:]


def train(bags: list[list[bytes]], clean: list[bytes], seed: int = 11) -> Machine:
    """A machine from candidate words of toxic texts, a bag each, and words of clean texts."""
    rng = np.random.default_rng(seed)
    bags = [[part for word in bag for part in windows(word) if len(part) >= 3] for bag in bags]
    bags = sorted({tuple(sorted(set(bag))) for bag in bags if bag})
    clean = sorted({part for word in clean for part in windows(word) if len(part) >= 3})
    if not bags or not clean:
        return Machine(np.zeros(LETTERS**3), -1.0)
    # Near copies of a text show the same insults; of texts that share their two smallest hashes one is enough.
    bags = list({tuple(sorted(zlib.crc32(word) for word in bag)[:2]): bag for bag in bags}.values())
    words = sorted({word for bag in bags for word in bag})
    place = {word: k for k, word in enumerate(words)}
    members = [np.array([place[word] for word in bag]) for bag in bags]
    share = np.zeros(len(words))
    for own in members:
        share[own] += 1
    share = divided(members, share)
    often = np.argsort(-share, kind="stable")[: LANDMARKS // 2]
    half = rng.choice(len(clean), min(len(clean), LANDMARKS // 2), replace=False)
    landmarks = [words[k] for k in often] + [clean[k] for k in half]
    base = kernel_map(landmarks)
    used = np.flatnonzero(base.any(axis=0))
    base = base[:, used]
    values, vectors = np.linalg.eigh(base @ base.T)
    kept = values > 1e-6 * values[-1]
    whiten = vectors[:, kept] / np.sqrt(values[kept])

    def features(of: list[bytes]) -> np.ndarray:
        parts = [kernel_map(of[k : k + 1000])[:, used] @ base.T @ whiten for k in range(0, len(of), 1000)]
        return np.vstack(parts).astype(np.float64) if parts else np.empty((0, whiten.shape[1]))

    bad = features(words)
    drawn = [clean[k] for k in rng.choice(len(clean), min(len(clean), DRAWN), replace=False)]
    good, machine = features(drawn), None
    for turn in range(ROUNDS):
        if machine:
            share = divided(members, (share + 0.02) * np.exp(3 * np.clip(bad @ w + b, -3, 2)))
            hard = np.argsort(-machine.score_words(clean), kind="stable")[:HARD]
            added = sorted({clean[k] for k in hard}.difference(drawn))
            drawn += added
            good = np.vstack([good, features(added)]) if added else good
        positive = np.flatnonzero(share > 0.05)
        weight = np.log1p(share[positive])
        x = np.vstack([bad[positive], good])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(good))])
        c = np.concatenate([weight / weight.sum(), np.full(len(good), 1 / len(good))]) * 100
        if turn == ROUNDS - 1:
            # The words that explain most, with a letter inserted: half the weight of the words themselves.
            sure = positive[np.argsort(-share[positive], kind="stable")[:SURE]]
            grown = [(inserted(words[k], rng), share[k]) for k in sure for _ in range(3)]
            x = np.vstack([x, features([word for word, _ in grown])])
            y = np.concatenate([y, np.ones(len(grown))])
            extra = np.log1p(np.array([n for _, n in grown])) / weight.sum() / 6
            c = np.concatenate([c, 100 * extra])
        w, b = separate(x, y, c)
        weights = np.zeros(LETTERS**3)
        weights[used] = base.T @ (whiten @ w)
        machine = Machine(weights, b)
    return machine


def calibrate(measures: np.ndarray, labels: np.ndarray) -> tuple[tuple[float, ...], float]:
    """A logistic curve over the measures, with softened targets (Platt) and a small ridge, so that separable
    documents keep finite scores; without both labels the worst word decides."""
    positive, negative = labels.sum(), (1 - labels).sum()
    if not positive or not negative:
        return (1.0, 0.0, 0.0), 0.0
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.hstack([measures, np.ones((len(measures), 1))])
    ridge = np.diag([0.1, 0.1, 0.1, 1e-3])
    w = np.zeros(4)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + ridge @ w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, gradient)
        step *= min(1.0, 3.0 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w[:3])), float(w[3])


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, label, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            words = [word.decode() for word in sorted(set(plain_words(text))) if len(word) >= 3]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc_id] * len(words), pa.int64()),
                    pa.array([label] * len(words), pa.int32()),
                    pa.array(words, pa.string()),
                ],
                names=["doc_id", "label", "word"],
            )


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """Learn from at most `MOST_TOXIC` toxic and `MOST_CLEAN` clean labelled documents that are not held out."""
    sample = checkpointed(labelled_sample(docs, labels, "toxic", DIVISOR, HELD_OUT, {1: MOST_TOXIC, 0: MOST_CLEAN}))
    learnt = sample.filter(F.col("part") != CALIBRATES).select("doc_id", "label", "text")
    words = checkpointed(learnt.mapInArrow(_words_of, "doc_id long, label int, word string"))
    seen = words.groupBy("word").agg(F.max(1 - F.col("label")).alias("clean"), F.count("*").alias("n"))
    negative = seen.filter("clean = 1").orderBy(F.xxhash64("word"), "word").limit(CLEAN_WORDS).select("word")
    only = seen.filter("clean = 0").select("word", "n")
    ranked = words.filter("label = 1").join(only, "word")
    # The words most often seen in toxic texts, in a few; a bounded bag for each of a bounded number of texts.
    bags = ranked.groupBy("doc_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("n", "word")), asc=False), 1, BAG_WORDS)["word"].alias("bag")
    )
    machine = train(
        [[word.encode() for word in row.bag] for row in bags.orderBy("doc_id").collect()],
        [row.word.encode() for row in negative.collect()],
    )
    rest = sample.filter(F.col("part") == CALIBRATES)
    scored = _logits(rest.select("doc_id", "label", "text"), machine, measures=True).toPandas()
    measured = np.array(scored["measures"].tolist(), dtype=float).reshape(-1, 3)
    machine.slopes, machine.shift = calibrate(measured, scored["label"].to_numpy())
    return machine


def _logits(rows: DataFrame, machine: Machine, measures: bool = False) -> DataFrame:
    """doc_id, label, logit (or the measures) for rows of doc_id, label, text."""
    name, kind = ("measures", pa.list_(pa.float64())) if measures else ("logit", pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = machine.measure(part.column(2).to_pylist(), known)
                values = found.tolist() if measures else machine.logit(found)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(values, kind)], names=["doc_id", "label", name]
                )

    shown = "array<double>" if measures else "double"
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, label int, {name} {shown}")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A toxicity score for each row of `docs` (doc_id, text; other columns are not read).

    `labels` (doc_id, toxic) are learnt from where crc32(doc_id) mod 5 is not 0. A null text counts as
    empty and scores as a text without insults; rows that repeat give repeated rows; an empty table gives none. Without
    labels of both kinds nothing is toxic.

    Columns: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).
    """
    machine = fit(docs, labels)
    rows = _logits(docs.select("doc_id", F.lit(None).cast("int").alias("label"), text_of().alias("text")), machine)
    score = 1 / (1 + F.exp(-F.col("logit")))
    return rows.select(
        "doc_id",
        (crc_remainder(F.col("doc_id"), DIVISOR) == HELD_OUT).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all of their columns; texts are scored where they are."""
    machine = fit(docs, labels)
    known: dict[bytes, float] = {}

    @F.pandas_udf("double")
    def logit(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        parts = [machine.logit(machine.measure(values[k : k + 256], known)) for k in range(0, len(values), 256)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return docs.filter(logit(text_of()) < 0)
