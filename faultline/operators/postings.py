"""Positional posting lists: words, phrases and exclusions answered by merging blocks, without reading a text.

A block holds where one word occurs in the texts of one range of ids: for each occurrence the id, as its offset from the start of
the range, and the position of the word in its text. Ranges have a fixed width, so a block is bounded by the texts of that many ids
however frequent its word, and equal ranges of different words meet in one shuffle of the asked words' blocks alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.fixed_values import STOP_WORDS
from faultline.functions.narrative import QueryParts, query_parts, query_words, stem_all, stem_word, words
from faultline.operators.search import SearchRequest, filters, search

#: Ids of one block.
RANGE_IDS = 4096
#: An occurrence as one number: offset of the id, then position.
_POSITIONS = 1 << 32


def positional_index(reports: DataFrame, key: str = "id", text: str = "description", range_ids: int = RANGE_IDS) -> DataFrame:
    """One row per word and range of ids: word, stem, id_range, first_id, last_id, reports (how many hold the word), occurrences
    (sorted numbers: offset of the id in the range times 2^32, plus the position in the text).

    Stop words are kept, since phrases contain them. Texts that are null or without words have no postings.
    """
    found = reports.select(F.col(key).cast("long").alias("id"), F.posexplode(words(F.col(text))).alias("at", "word"))
    start = F.floor(F.col("id") / range_ids)
    placed = found.select(
        "word", start.alias("id_range"), ((F.col("id") - start * range_ids) * _POSITIONS + F.col("at")).alias("occurrence")
    )
    blocks = placed.groupBy("word", "id_range").agg(F.sort_array(F.collect_list("occurrence")).alias("occurrences"))
    stem = F.element_at(stem_all(F.array("word")), 1)
    offsets = F.array_distinct(_offsets(F.col("occurrences")))
    return blocks.select(
        "word",
        stem.alias("stem"),
        "id_range",
        (F.col("id_range") * range_ids + F.element_at(offsets, 1)).alias("first_id"),
        (F.col("id_range") * range_ids + F.element_at(offsets, -1)).alias("last_id"),
        F.size(offsets).alias("reports"),
        "occurrences",
    )


def write_positional_index(index: DataFrame, path: str) -> None:
    """Store the index ordered by word and range, so that a lookup reads only row groups whose statistics cover its words."""
    index.repartitionByRange("word", "id_range").sortWithinPartitions("word", "id_range").write.mode("overwrite").parquet(path)


def _offsets(occurrences: Column) -> Column:
    return F.transform(occurrences, lambda o: F.shiftright(o, 32).cast("int"))


def _none() -> Column:
    return F.array().cast("array<int>")


def _block_of(word: str) -> Column:
    """The occurrences of a word among the rows of one range."""
    return F.coalesce(F.first(F.when(F.col("word") == word, F.col("occurrences")), ignorenulls=True), F.array().cast("array<bigint>"))


def _with_phrase(blocks: dict[str, str], phrase: Sequence[str]) -> Column:
    """Offsets of ids in which the words of a phrase follow one another: the starts each word allows, merged."""

    def starts_of(word: str, place: int) -> Column:
        return F.transform(blocks[word], lambda o: o - F.lit(place).cast("bigint"))

    starts = [starts_of(word, place) for place, word in enumerate(phrase)]
    # The first word's starts are real positions, so none that would lie before a text's beginning is left.
    return F.array_distinct(_offsets(reduce(F.array_intersect, starts)))


def postings_of(index: DataFrame, parts: QueryParts, range_ids: int = RANGE_IDS) -> DataFrame:
    """Ids (id) that hold any of the words by stem, all phrases as whole consecutive words, and nothing excluded.

    Only blocks of the asked words are read; they meet by range, where sorted lists are intersected and subtracted. A term without
    words, or with a phrase without any, matches nothing; an excluded phrase without words excludes nothing.
    """
    nothing = index.select(F.lit(0).cast("long").alias("id")).filter(F.lit(False))
    phrases, barred = [query_words(p) for p in parts.phrases], [p for p in map(query_words, parts.excluded_phrases) if p]
    if not parts.words or not all(phrases):
        return nothing
    stems, out = sorted({stem_word(w) for w in parts.words}), sorted({stem_word(w) for w in parts.excluded_words})
    exact = sorted({word for phrase in phrases + barred for word in phrase})
    asked = index.filter(F.col("stem").isin(stems + out) | F.col("word").isin(exact))
    places = {word: f"word_{i}" for i, word in enumerate(exact)}

    def any_of(several: list[str]) -> Column:
        lists = F.collect_list(F.when(F.col("stem").isin(several), _offsets(F.col("occurrences"))))
        return F.array_distinct(F.flatten(lists)) if several else _none()

    merged = asked.groupBy("id_range").agg(
        any_of(stems).alias("wanted"), any_of(out).alias("unwanted"), *[_block_of(word).alias(name) for word, name in places.items()]
    )
    found = F.array_except("wanted", "unwanted")
    for phrase in phrases:
        found = F.array_intersect(found, _with_phrase(places, phrase))
    for phrase in barred:
        found = F.array_except(found, _with_phrase(places, phrase))
    return merged.select("id_range", F.explode(found).alias("offset")).select((F.col("id_range") * range_ids + F.col("offset")).alias("id"))


def search_postings(
    index: DataFrame,
    reports: DataFrame,
    request: SearchRequest,
    key: str = "id",
    stop_words: Sequence[str] = STOP_WORDS,
    range_ids: int = RANGE_IDS,
) -> DataFrame:
    """The reports that match a request, found by the index; no text is read to decide. Phrases are whole words here."""
    if request.clean_term is None:
        return search(reports, request, stop_words)
    for condition in filters(request):
        reports = reports.filter(condition)
    found = postings_of(index, query_parts(request.clean_term, tuple(stop_words)), range_ids)
    return reports.join(found.withColumnRenamed("id", "posted__"), F.col(key) == F.col("posted__"), "left_semi")
