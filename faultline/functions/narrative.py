"""Narratives: word stems, search-term matching, snippets, highlighting and shortening.

A search term is short text given when a plan is built, so its words become regular expressions and
literals; narratives are only ever touched by built-in column expressions.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.fixed_values import (
    HIGHLIGHT_LENGTH_GAP,
    HIGHLIGHT_SHORTEST_STEM,
    HIGHLIGHT_SHORTEST_TERM,
    NARRATIVE_LIMIT,
    SNIPPET_LEAD,
    SNIPPET_LENGTH,
    STOP_WORDS,
)
from faultline.functions.text import collapse_ws

LETTER = r"\p{L}\p{Nd}"
APOSTROPHE = "['\u2019]"
# An apostrophe between letters belongs to the word.
WORD = rf"[{LETTER}]+(?:{APOSTROPHE}[{LETTER}]+)*"
POSSESSIVE = rf"{APOSTROPHE}s$"

# Letters that lose their doubling when a suffix is gone: slipp(ed) -> slip.
DOUBLED = tuple("bdfgmnprt")

# Shorter words are left as they are by the steps that drop a final letter, so no stem is ever empty.
SHORTEST_INFLECTED = 4


def _accented() -> dict[str, str]:
    """Latin letters with marks, by the letter below them."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isascii() and all(unicodedata.combining(mark) for mark in marks):
            found[chr(code)] = base
    return found


ACCENTED = _accented()
MARKS = r"[\u0300-\u036F]"


def fold_text(text: str) -> str:
    """Lower case without accents, like `folded`."""
    lowered = text.lower()
    return re.sub("[\u0300-\u036f]", "", "".join(ACCENTED.get(letter, letter) for letter in lowered))


def folded(text: Column) -> Column:
    """Lower case without accents; plain texts are not translated."""
    lowered = F.lower(text)
    plain = F.translate(lowered, "".join(ACCENTED), "".join(ACCENTED.values()))
    return F.when(lowered.rlike(r"[^\x00-\x7F]"), F.regexp_replace(plain, MARKS, "")).otherwise(lowered)


def words(text: Column) -> Column:
    """The lower-case words of a text, in order, without accents and possessive endings."""
    found = F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))
    return F.transform(found, lambda word: F.regexp_replace(word, POSSESSIVE, ""))


def query_words(text: str) -> list[str]:
    """The words of a search term, by the same rules."""
    letter = r"[^\W_]"
    found = re.findall(rf"{letter}+(?:{APOSTROPHE}{letter}+)*", fold_text(text))
    return [re.sub(POSSESSIVE, "", word) for word in found]


def _without(word: Column, count: int) -> Column:
    return F.left(word, F.length(word) - count)


def _singular(word: Column) -> Column:
    return (
        F.when(~word.endswith("s") | word.rlike("(ss|us|is)$") | (F.length(word) < SHORTEST_INFLECTED), word)
        .when(word.endswith("ies"), F.concat(_without(word, 3), F.lit("y")))
        .when(word.endswith("sses"), _without(word, 2))
        .otherwise(_without(word, 1))
    )


def _uninflected(word: Column) -> Column:
    """Without `ing` or `ed` when a vowel remains before it."""
    stripped = F.regexp_replace(word, "([aeiouy][a-z]*)(ing|ed)$", "$1")
    return F.when(word.endswith("ing") | word.endswith("ed"), stripped).otherwise(word)


def _undoubled(word: Column) -> Column:
    doubled = word.rlike(f"({'|'.join(letter * 2 for letter in DOUBLED)})$")
    return F.when(doubled, _without(word, 1)).otherwise(word)


def _without_final_e(word: Column) -> Column:
    inflected = word.endswith("e") & (F.length(word) >= SHORTEST_INFLECTED)
    return F.when(inflected, _without(word, 1)).otherwise(word)


# Applied in this order to lower-case words.
STEM_STEPS = (_singular, _uninflected, _undoubled, _without_final_e)


def stem_all(several: Column) -> Column:
    """The stems of an array of words: inflections of one word share a stem.

    One transform per step, so that each step reads the result of the one before instead of repeating
    its expression.
    """
    for step in STEM_STEPS:
        several = F.transform(several, step)
    return several


def stem_word(word: str) -> str:
    """The stem of one query word, by the same steps, so that it enters a plan as a literal."""
    if len(word) >= SHORTEST_INFLECTED and word.endswith("s") and not word.endswith(("ss", "us", "is")):
        ending = next(end for end in ("ies", "sses", "s") if word.endswith(end))
        word = word.removesuffix(ending) + {"ies": "y", "sses": "ss", "s": ""}[ending]
    word = re.sub("([aeiouy][a-z]*)(ing|ed)$", r"\1", word)
    if word[-2:] in [letter * 2 for letter in DOUBLED]:
        word = word[:-1]
    return word.removesuffix("e") if len(word) >= SHORTEST_INFLECTED else word


@dataclass(frozen=True)
class QueryParts:
    """What a search term asks for: any of the words, all of the phrases, nothing excluded."""

    words: list[str]
    excluded_words: list[str]
    phrases: list[str]
    excluded_phrases: list[str]


def query_parts(term: str, stop_words: tuple[str, ...] = STOP_WORDS) -> QueryParts:
    """Split a term. A leading hyphen excludes a word or a quoted phrase."""
    parts = QueryParts([], [], [], [])

    def meaningful(text: str) -> list[str]:
        return [w for w in query_words(text) if w not in stop_words]

    for hyphen, phrase, plain in re.findall(r'(-?)"([^"]*)"|([^\s"]+)', fold_text(term)):
        if plain:
            (parts.excluded_words if plain.startswith("-") else parts.words).extend(meaningful(plain))
        elif phrase and hyphen:
            parts.excluded_phrases.append(phrase)
        elif phrase:
            parts.phrases.append(phrase)
            parts.words.extend(meaningful(phrase))
    return parts


def contains_stem(text: Column, several: list[str]) -> Column:
    """Whether a text has a whole word with the same stem as any of the given words.

    A stem is a prefix of its word, up to a final `y` that may replace `ies`. So only words starting
    with such a prefix are extracted, in one pass, and only those few are stemmed and compared.
    """
    stems = [stem_word(word) for word in several]
    # The literal leads and the look-behinds follow, so most positions fail on their first letter. A word begins
    # neither after a letter nor after an apostrophe that follows one.
    starts = [
        rf"{start}(?<![{LETTER}]{start})(?<![{LETTER}]{APOSTROPHE}{start})"
        for start in (re.escape(s.removesuffix("y") or s) for s in stems)
    ]
    pattern = rf"(?:{'|'.join(starts)})[{LETTER}]*(?:{APOSTROPHE}[{LETTER}]+)*"
    candidates = F.regexp_extract_all(folded(text), F.lit(pattern), F.lit(0))
    plain = F.transform(F.array_distinct(candidates), lambda word: F.regexp_replace(word, POSSESSIVE, ""))
    return F.arrays_overlap(stem_all(plain), F.array(*map(F.lit, stems)))


def phrase_conditions(text: Column, parts: QueryParts) -> list[Column]:
    """Phrases are looked up in the text as they are written, without regard to case and accents."""
    lowered = folded(text)
    wanted = [F.contains(lowered, F.lit(phrase)) for phrase in parts.phrases]
    return wanted + [~F.contains(lowered, F.lit(phrase)) for phrase in parts.excluded_phrases]


def term_conditions(text: Column, parts: QueryParts) -> list[Column]:
    """Full-text match as conditions that must all hold; a term without words matches nothing."""
    if not parts.words:
        return [F.lit(False)]
    conditions = [*phrase_conditions(text, parts), contains_stem(text, parts.words)]
    if parts.excluded_words:
        conditions.append(~contains_stem(text, parts.excluded_words))
    return conditions


def highlight_words(term: str) -> list[str]:
    """The words of a term worth highlighting: two characters or more, not excluded by a hyphen."""
    pieces = [piece for piece in term.split() if not piece.startswith("-")]
    found = [w for piece in pieces for w in re.findall(r"[^\W_]+", piece)]
    return [w for w in found if len(w) >= HIGHLIGHT_SHORTEST_TERM]


def highlight_pattern(term: str) -> str | None:
    """A pattern for the words to highlight: equal, or one a slightly longer form of the other."""
    forms = []
    for word in highlight_words(term):
        forms.append(word)
        if len(word) >= HIGHLIGHT_SHORTEST_STEM:
            forms.append(rf"{word}[{LETTER}]{{1,{HIGHLIGHT_LENGTH_GAP}}}")
        shortest = max(HIGHLIGHT_SHORTEST_STEM, len(word) - HIGHLIGHT_LENGTH_GAP)
        forms += [word[:length] for length in range(shortest, len(word))]
    if not forms:
        return None
    return rf"(?<![{LETTER}])(?iu:{'|'.join(forms)})(?![{LETTER}])"


def _first_space(text: Column, position: Column) -> Column:
    """Position of the first space at or after a one-based position, 0 when there is none."""
    return F.call_function("locate", F.lit(" "), text, position)


def _segment(piece: Column, is_match: Column) -> Column:
    return F.struct(piece.alias("text"), is_match.alias("is_match"))


def with_snippet(df: DataFrame, text: str, term: str | None, name: str = "snippet") -> DataFrame:
    """Add a window on a narrative around its first match, as a struct column.

    `text`, `clipped_start`, `clipped_end`, `has_match` and `segments`, an array of (text, is_match).
    Works in stages of columns: each intermediate value is computed once and used several times.
    Offsets count the characters before a position, so 0 is the start of the text.
    """
    pattern = highlight_pattern(term) if term else None
    nothing = F.lit(False)
    c = F.col

    staged = df.withColumn("_whole", collapse_ws(c(text)))
    if pattern is None:
        staged = staged.withColumns({"_first": F.lit(0), "_hit": F.lit("")})
    else:
        staged = staged.withColumns(
            {
                "_first": F.regexp_instr("_whole", F.lit(pattern)),
                "_hit": F.regexp_extract("_whole", pattern, 0),
            }
        )
    staged = staged.withColumns(
        {
            "_length": F.length("_whole"),
            "_matched": c("_first") > 0,
            "_anchor": F.greatest(c("_first") - 1, F.lit(0)),
        }
    )
    staged = staged.withColumns(
        {
            "_hit_end": F.when(c("_matched"), c("_anchor") + F.length("_hit")).otherwise(F.lit(1)),
            "_from": F.greatest(c("_anchor") - SNIPPET_LEAD, F.lit(0)),
        }
    )
    staged = staged.withColumn(
        "_to", F.least(c("_length"), F.greatest(c("_from") + SNIPPET_LENGTH, c("_hit_end")))
    )
    staged = staged.withColumns(
        {
            "_after": _first_space(c("_whole"), c("_from")),
            "_before": c("_to") + 1
            - F.nullif(
                _first_space(F.reverse(F.substring("_whole", F.lit(1), c("_to") + 1)), F.lit(1)), F.lit(0)
            ),
            "_least_end": F.least("_hit_end", "_to"),
        }
    )
    # The start moves on to the next word, at most to the match; the end moves back to the last space,
    # never into the match. A text that fits is shown whole.
    fits = c("_length") <= SNIPPET_LENGTH
    start = (
        F.when(fits | (c("_from") == 0), F.lit(0))
        .when((c("_after") > 0) & (c("_after") < c("_anchor")), c("_after"))
        .otherwise(c("_anchor"))
    )
    end = (
        F.when(fits | (c("_to") >= c("_length")), c("_length"))
        .otherwise(F.greatest(F.coalesce("_before", "_least_end"), c("_least_end")))
    )
    staged = staged.withColumns({"_start": start, "_end": end})
    staged = staged.withColumn(
        "_shown", F.substring("_whole", c("_start") + 1, c("_end") - c("_start"))
    )
    if pattern is None:
        staged = staged.withColumn("_parts", F.array(_segment(c("_shown"), nothing)))
    else:
        # A word that the window itself cuts is never a match, so such a piece is split off first.
        def cuts_word(position: Column) -> Column:
            return F.substring("_whole", position, F.lit(2)).rlike(f"^[{LETTER}]{{2}}$")

        staged = staged.withColumns(
            {
                "_head": F.when(
                    (c("_start") > 0) & cuts_word(c("_start")), F.regexp_extract("_shown", f"^{WORD}", 0)
                ).otherwise(""),
                "_tail": F.when(
                    cuts_word(c("_end")), F.regexp_extract("_shown", f"{WORD}$", 0)
                ).otherwise(""),
            }
        )
        inner = F.length("_shown") - F.length("_head") - F.length("_tail")
        pieces = F.split(
            F.substring("_shown", F.length("_head") + 1, inner), f"(?={pattern})|(?<={pattern})", -1
        )
        staged = staged.withColumn(
            "_parts",
            F.concat(
                F.array(_segment(c("_head"), nothing)),
                F.transform(pieces, lambda piece: _segment(piece, piece.rlike(f"^{pattern}$"))),
                F.array(_segment(c("_tail"), nothing)),
            ),
        )
    shown = F.struct(
        c("_shown").alias("text"),
        (c("_start") > 0).alias("clipped_start"),
        (c("_end") < c("_length")).alias("clipped_end"),
        c("_matched").alias("has_match"),
        F.filter("_parts", lambda part: part.text != "").alias("segments"),
    )
    return staged.select(*df.columns, shown.alias(name))


def shorten(text: Column) -> Column:
    """A collapsed narrative cut at a word near the limit, as a struct of `text` and `shortened`."""
    whole = collapse_ws(text)
    is_long = F.length(whole) > NARRATIVE_LIMIT
    # A space just after the limit still counts: the text before it fits.
    reach = F.reverse(F.substring(whole, F.lit(1), F.lit(NARRATIVE_LIMIT + 1)))
    space = _first_space(reach, F.lit(1))
    cut = F.lit(NARRATIVE_LIMIT + 1) - space
    usable = (space > 0) & (cut > NARRATIVE_LIMIT // 2)
    keep = F.when(usable, cut).otherwise(F.lit(NARRATIVE_LIMIT))
    return F.struct(
        F.when(is_long, F.concat(F.substring(whole, F.lit(1), keep), F.lit("…")))
        .otherwise(whole)
        .alias("text"),
        is_long.alias("shortened"),
    )


def outcome_labels() -> Column:
    """What happened, as labels, from the crash, fire, injured and deaths columns."""
    labels = F.array(
        F.when(F.col("crash"), "crash reported"),
        F.when(F.col("fire"), "fire reported"),
        F.when(F.col("injured") > 0, F.concat(F.col("injured").cast("string"), F.lit(" injured"))),
        F.when(F.col("deaths") > 0, F.concat(F.col("deaths").cast("string"), F.lit(" killed"))),
    )
    return F.filter(labels, lambda label: label.isNotNull())


def is_severe() -> Column:
    return F.col("fire") | (F.col("deaths") > 0)


def component_detail(raw: Column) -> Column:
    """A component path for reading: levels joined by slashes."""
    return F.replace(raw, F.lit(":"), F.lit(" / "))
