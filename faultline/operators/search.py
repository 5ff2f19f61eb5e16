"""Filtered full-text search over narratives: scan, inverted index, pages and counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.fixed_values import STOP_WORDS
from faultline.functions.narrative import (
    outcome_labels,
    phrase_conditions,
    query_parts,
    stem_all,
    stem_word,
    term_conditions,
    with_snippet,
    words,
)
from faultline.functions.text import key_make, key_model


@dataclass(frozen=True)
class SearchRequest:
    """A search form. Blank parts do not filter; an all-blank request matches nothing."""

    term: str | None = None
    make_slug: str | None = None
    component_group: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    mileage_only: bool = False
    page: int = 1
    page_size: int = 20

    @property
    def clean_term(self) -> str | None:
        return (self.term or "").strip() or None

    @property
    def is_empty(self) -> bool:
        asked = (self.clean_term, (self.make_slug or "").strip(), (self.component_group or "").strip())
        years = (self.year_from, self.year_to)
        return not any(asked) and years == (None, None) and not self.mileage_only

    @property
    def mode(self) -> str:
        return "full_text" if self.clean_term else "none"

    @property
    def offset(self) -> int:
        return (max(self.page, 1) - 1) * self.size

    @property
    def size(self) -> int:
        return max(self.page_size, 1)


def filters(request: SearchRequest) -> list[Column]:
    """The conditions of a request other than its text; a missing year fails both year bounds."""
    conditions = []
    if (request.make_slug or "").strip():
        conditions.append(F.col("vehicle_key").startswith(f"{request.make_slug.strip()}|"))
    if (request.component_group or "").strip():
        conditions.append(F.col("component.group") == request.component_group)
    if request.year_from is not None:
        conditions.append(F.col("model_year") >= request.year_from)
    if request.year_to is not None:
        conditions.append(F.col("model_year") <= request.year_to)
    if request.mileage_only:
        conditions.append(F.col("miles_at_failure").isNotNull())
    return conditions


def search(
    reports: DataFrame, request: SearchRequest, stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """All matching reports by a scan. Plain conditions come first, so they reach the files."""
    if request.is_empty:
        return reports.filter(F.lit(False))
    conditions = filters(request)
    if request.clean_term:
        parts = query_parts(request.clean_term, tuple(stop_words))
        conditions += term_conditions(F.col("description"), parts)
    return _all_of(reports, conditions)


def _all_of(reports: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    for condition in conditions:
        reports = reports.filter(condition)
    return reports


def inverted_index(
    reports: DataFrame, key: str = "id", text: str = "description", stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """One row per stem and report.

    Words are made distinct before they are stemmed and stems before they are exploded, all within the
    row, so building the index needs no shuffle.
    """
    kept = F.filter(F.array_distinct(words(F.col(text))), lambda word: ~word.isin(list(stop_words)))
    return reports.select(F.explode(F.array_distinct(stem_all(kept))).alias("stem"), key)


def write_inverted_index(index: DataFrame, path: str, key: str = "id") -> None:
    """Store the index ordered by stem and report.

    Ranges are cut over both columns, so the postings of a frequent stem spread over many files, while
    a lookup reads only the files and row groups whose statistics cover the stem.
    """
    ranged = index.repartitionByRange("stem", key).sortWithinPartitions("stem", key)
    ranged.write.mode("overwrite").parquet(path)


def search_index(
    index: DataFrame,
    reports: DataFrame,
    request: SearchRequest,
    key: str = "id",
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """The same matches as `search`, found through the stored index."""
    if request.clean_term is None:
        return search(reports, request, stop_words)
    parts = query_parts(request.clean_term, tuple(stop_words))

    def postings(asked: list[str]) -> DataFrame:
        stems = [stem_word(word) for word in asked]
        return index.filter(F.col("stem").isin(stems)).select(key)

    matched = _all_of(reports, filters(request)).join(postings(parts.words), key, "left_semi")
    if parts.excluded_words:
        matched = matched.join(postings(parts.excluded_words), key, "left_anti")
    return _all_of(matched, phrase_conditions(F.col("description"), parts))


def search_page(
    matched: DataFrame, request: SearchRequest, keep: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """One page of matches. Sorting with a limit keeps only the leading rows of every task."""
    return matched.orderBy(*order).offset(request.offset).limit(request.size).select(*keep)


def search_hits(page: DataFrame, term: str | None) -> DataFrame:
    """Matches as shown: vehicle, narrative snippet with highlighted words, and outcomes."""
    return with_snippet(page, "description", term).select(
        "id", "make", key_make(F.col("vehicle_key")).alias("make_slug"),
        "model", key_model(F.col("vehicle_key")).alias("model_slug"),
        "model_year", "vehicle_key", "received_date", "miles_at_failure",
        F.col("component.group").alias("component_group"),
        F.col("component.raw").alias("component_raw"),
        "snippet",
        outcome_labels().alias("outcomes"),
    )


def match_count(matched: DataFrame) -> DataFrame:
    """Number of matches. Only counts are shuffled."""
    return matched.agg(F.count("*").alias("match_count"))


def capped_count(matched: DataFrame, cap: int | None = None) -> DataFrame:
    """Number of matches and whether it is exact, which it is unless the caller names a `cap` that it reaches."""
    counted = match_count(matched)
    if cap is None:
        return counted.select("match_count", F.lit(True).alias("is_exact"))
    return counted.select(
        F.least("match_count", F.lit(cap).cast("bigint")).alias("match_count"),
        (F.col("match_count") < cap).alias("is_exact"),
    )


def capped_count_now(matched: DataFrame, cap: int) -> tuple[int, bool]:
    """The same as values, reading a growing number of partitions only until `cap` is reached."""
    found = len(matched.select(F.lit(1)).take(cap))
    return found, found < cap


def page_metadata(matched: DataFrame, request: SearchRequest) -> DataFrame:
    """Count and paging of a search in one row."""
    last = F.greatest(F.ceil(F.col("match_count") / request.size), F.lit(1))
    return match_count(matched).select(
        "match_count",
        F.lit(True).alias("is_exact"),
        F.lit(request.mode).alias("mode"),
        F.lit(max(request.page, 1)).alias("page"),
        F.lit(request.size).alias("page_size"),
        last.cast("int").alias("last_page"),
        F.lit(request.page > 1).alias("has_previous"),
        (F.lit(max(request.page, 1)) < last).alias("has_next"),
    )


def normalise_requests(
    requests: DataFrame, makes: DataFrame, groups: DataFrame
) -> DataFrame:
    """Requested filters checked against what exists.

    An unknown make or group is dropped and reported; reversed years are swapped, while a lone bound
    stays on its side.
    """

    def cleaned(name: str) -> Column:
        return F.nullif(F.trim(F.col(name)), F.lit(""))

    asked = requests.withColumns(
        {"_make": F.lower(cleaned("make_slug")), "_group": cleaned("component_group")}
    )
    known_makes = makes.select(F.col("make_slug").alias("found_make")).distinct()
    known_groups = groups.groupBy(F.upper("component_group").alias("_upper")).agg(
        F.min("component_group").alias("found_group")
    )
    swap = F.coalesce(F.col("year_from") > F.col("year_to"), F.lit(False))
    return (
        asked.join(known_makes, F.col("_make") == F.col("found_make"), "left")
        .join(known_groups, F.upper("_group") == F.col("_upper"), "left")
        .select(
            *[c for c in requests.columns if c not in ("make_slug", "component_group", "year_from", "year_to")],
            F.col("found_make").alias("make_slug"),
            F.col("found_group").alias("component_group"),
            F.when(swap, F.col("year_to")).otherwise(F.col("year_from")).alias("year_from"),
            F.when(swap, F.col("year_from")).otherwise(F.col("year_to")).alias("year_to"),
            F.when(F.col("found_make").isNull(), F.col("_make")).alias("unresolved_make"),
            F.when(F.col("found_group").isNull(), F.col("_group")).alias("unresolved_group"),
        )
    )
