"""Text clean-up, canonical names and vehicle keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.fixed_values import CORPORATE_SUFFIXES, UNKNOWN_NAME, UNKNOWN_SLUG

# All Unicode white space: plain `trim` removes spaces only, and `(?U)` makes \s cover the same set.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = r"(?U)\s+"

_SUFFIX = "|".join(r"\.*".join(word) for word in CORPORATE_SUFFIXES)
SUFFIX_TAIL = rf"^(.*?)(?:[ ,]* \.*(?:{_SUFFIX})\.*)*[ ,]*$"


def trim_ws(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    """Whether there is white space only; looks no further than the first other character."""
    return F.ltrim(text, F.lit(WHITE_SPACE)) == ""


def collapse_ws(text: Column) -> Column:
    """Every run of white space becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def normalise(text: Column) -> Column:
    """Collapsed upper-case text; null counts as empty."""
    return F.upper(collapse_ws(F.coalesce(text, F.lit(""))))


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits; anything between them becomes one hyphen."""
    hyphened = F.regexp_replace(text, "[^A-Za-z0-9]+", "-")
    bare = F.lower(F.regexp_replace(hyphened, "^-|-$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(UNKNOWN_SLUG))


def strip_corporate_suffixes(name: Column) -> Column:
    """A normalised name without trailing company forms such as `, INC.`; a lone form stays."""
    return F.regexp_extract(name, SUFFIX_TAIL, 1)


def display_name(name: Column, name_slug: Column) -> Column:
    """The name, or UNKNOWN where it has no usable characters."""
    return F.when(name_slug == UNKNOWN_SLUG, F.lit(UNKNOWN_NAME)).otherwise(name)


def vehicle_key(make_slug: Column, model_slug: Column, model_year: Column) -> Column:
    """`make|model|year`, with `unknown` for a missing year."""
    year = F.coalesce(model_year.cast("string"), F.lit(UNKNOWN_SLUG))
    return F.concat_ws("|", make_slug, model_slug, year)


def key_make(key: Column) -> Column:
    return F.split_part(key, F.lit("|"), F.lit(1))


def key_model(key: Column) -> Column:
    return F.split_part(key, F.lit("|"), F.lit(2))


def upper_or_null(text: Column) -> Column:
    """Upper-case text, null when it is empty."""
    return F.when(text != "", F.upper(text))
