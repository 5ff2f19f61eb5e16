"""Search operators on the documents and the stand-in reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.fixed_values import STOP_WORDS
from faultline.functions.measures import as_measures
from faultline.functions.narrative import (
    component_detail,
    is_severe,
    outcome_labels,
    shorten,
    with_snippet,
)
from faultline.operators import postings
from faultline.operators import search as ops
from faultline.operators.catalog import make_totals, vehicle_entries
from faultline.operators.search import SearchRequest
from faultline.operators.taxonomy import group_totals
from faultline.plans.checks import views
from faultline.plans.checks.registry import check

NARRATIVES = ("narratives",)
SQL_WORD = r"[\p{L}\p{Nd}]+"
# A word of the full text: an apostrophe between letters belongs to it, a possessive ending does not.
_TEXT_WORD = r"[\p{L}\p{Nd}]+(?:[''’][\p{L}\p{Nd}]+)*"


def sql_words(text: str) -> str:
    found = f"unnest(regexp_extract_all(strip_accents(lower({text})), '{_TEXT_WORD}'))"
    return f"regexp_replace({found}, '[''’]s$', '')"


def sql_stem(word: str) -> str:
    """The stem of a column that holds a word. The SQL names each case instead of listing rules in order."""
    single = f"""CASE WHEN length({word}) < 4 OR {word} NOT LIKE '%s' OR regexp_matches({word}, '(ss|us|is)$') THEN {word}
        WHEN {word} LIKE '%ies' THEN left({word}, length({word}) - 3) || 'y'
        WHEN {word} LIKE '%sses' THEN left({word}, length({word}) - 2)
        ELSE left({word}, length({word}) - 1) END"""
    bare = rf"regexp_replace({single}, '([aeiouy][a-z]*)(ing|ed)$', '\1')"
    pair = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
    thin = f"CASE WHEN regexp_matches({bare}, '{pair}') THEN left({bare}, length({bare}) - 1) ELSE {bare} END"
    return f"CASE WHEN length({thin}) > 3 AND ({thin}) LIKE '%e' THEN left({thin}, length({thin}) - 1) ELSE {thin} END"


_STOP = ", ".join(f"'{word}'" for word in STOP_WORDS)


def _sql_stems(table: str) -> str:
    return f"""
SELECT DISTINCT id, {sql_stem('word')} AS stem
FROM (SELECT DISTINCT id, {sql_words('description')} AS word FROM {table})
WHERE word NOT IN ({_STOP})
"""


views.SQL_VIEWS["stems"] = _sql_stems("narratives")
# Narratives whose first word is a possessive.
views.SQL_VIEWS["owned"] = r"""
SELECT * REPLACE (regexp_replace(description, '^(\pL+) ', '\1''s ') AS description) FROM narratives
"""
views.SQL_VIEWS["owned_stems"] = _sql_stems("owned")


def _sql_has(*words: str, stems: str = "stems") -> str:
    asked = ", ".join(f"('{word}')" for word in words)
    return f"id IN (SELECT id FROM {stems} WHERE stem IN (SELECT {sql_stem('word')} FROM (VALUES {asked}) AS asked(word)))"


FORM = SearchRequest(
    make_slug="brand-17", component_group="BRAKES", year_from=1997, year_to=1999, mileage_only=True
)
TEXT = SearchRequest(term="  Thering oners the -heder  -ithin ", page=2, page_size=15)
TEXT_AND_FORM = SearchRequest(term="things thered", make_slug="src7", component_group="EN", year_from=2003)
_FORM_SQL = """
vehicle_key LIKE 'brand-17|%' AND component_group = 'BRAKES' AND model_year BETWEEN 1997 AND 1999
AND miles IS NOT NULL
"""
_TEXT_SQL = f"{_sql_has('thering', 'oners')} AND NOT {_sql_has('heder')} AND NOT {_sql_has('ithin')}"
_BOTH_SQL = f"""
{_sql_has('things', 'thered')} AND vehicle_key LIKE 'src7|%' AND component_group = 'EN' AND model_year >= 2003
"""


@check(
    f"SELECT l_orderkey, l_linenumber, vehicle_key, miles, received_date FROM reports WHERE {_FORM_SQL}"
)
def search_filtered(spark, sf_dir):
    return ops.search(views.reports(spark, sf_dir), FORM).select(
        "l_orderkey", "l_linenumber", "vehicle_key", F.col("miles_at_failure").alias("miles"),
        "received_date",
    )


@check(f"SELECT id, vehicle_key FROM narratives WHERE {_TEXT_SQL}", (*NARRATIVES, "stems"))
def search_text(spark, sf_dir):
    return ops.search(views.narratives(spark, sf_dir), TEXT).select("id", "vehicle_key")


@check(f"SELECT id, vehicle_key FROM narratives WHERE {_BOTH_SQL}", (*NARRATIVES, "stems"))
def search_text_filtered(spark, sf_dir):
    return ops.search(views.narratives(spark, sf_dir), TEXT_AND_FORM).select("id", "vehicle_key")


PHRASE = SearchRequest(term='oners "of the" -"in the th" zzz')


@check(
    f"""
SELECT id, vehicle_key FROM narratives
WHERE {_sql_has('oners', 'zzz')} AND contains(lower(description), 'of the')
  AND NOT contains(lower(description), 'in the th')
""",
    (*NARRATIVES, "stems"),
)
def search_phrase(spark, sf_dir):
    return ops.search(views.narratives(spark, sf_dir), PHRASE).select("id", "vehicle_key")


def _both_ways(reports, request):
    """Matches by scan and by index, a row each."""
    by_scan = ops.search(reports, request).select("id", F.lit("scan").alias("way"))
    return by_scan.unionByName(
        ops.search_index(ops.inverted_index(reports), reports, request).select("id", F.lit("index").alias("way"))
    )


def _sql_both(condition: str, table: str = "narratives") -> str:
    return f"SELECT id, way FROM {table}, (VALUES ('scan'), ('index')) AS ways(way) WHERE {condition}"


@check(_sql_both(f"{_sql_has('c', 'u')} AND NOT {_sql_has('e')}"), (*NARRATIVES, "stems"))
def search_single_letters(spark, sf_dir):
    """Letters that stand alone as words, one of them excluded."""
    return _both_ways(views.narratives(spark, sf_dir), SearchRequest(term="c u -e"))


@check(_sql_both(_sql_has("eau", "ete", "ere")), (*NARRATIVES, "stems"))
def search_accents(spark, sf_dir):
    """Terms with and without accents find texts with and without."""
    return _both_ways(views.narratives(spark, sf_dir), SearchRequest(term="\u00c9au \u00e9t\u00e9 ere"))


@check(
    _sql_both(
        f"{_sql_has('thering', 'lly', 'ther', stems='owned_stems')} AND NOT {_sql_has('s', stems='owned_stems')}", "owned"
    ),
    (*NARRATIVES, "owned", "owned_stems"),
)
def search_possessives(spark, sf_dir):
    """A possessive is found by its word, in the text and in the term, and is no word `s` of its own."""
    owned = views.narratives(spark, sf_dir).withColumn(
        "description", F.regexp_replace("description", r"^(\p{L}+) ", "$1's ")
    )
    return _both_ways(owned, SearchRequest(term="thering's lly ther\u2019s -s"))


@check("SELECT id, 'asked' AS request FROM narratives WHERE miles IS NOT NULL AND crash", NARRATIVES)
def search_empty_request(spark, sf_dir):
    """Of two requests over the same reports the empty one matches nothing."""
    reports = views.narratives(spark, sf_dir).filter("crash")
    asked = ops.search(reports, SearchRequest(mileage_only=True)).select("id", F.lit("asked").alias("request"))
    empty = ops.search(reports, SearchRequest(term="  ", make_slug=" ")).select("id", F.lit("empty").alias("request"))
    return asked.unionByName(empty)


@check("SELECT id, stem FROM stems", (*NARRATIVES, "stems"))
def inverted_index(spark, sf_dir):
    return ops.inverted_index(views.narratives(spark, sf_dir))


@check(f"SELECT id, vehicle_key FROM narratives WHERE {_TEXT_SQL}", (*NARRATIVES, "stems"))
def search_index(spark, sf_dir):
    reports = views.narratives(spark, sf_dir)
    return ops.search_index(ops.inverted_index(reports), reports, TEXT).select("id", "vehicle_key")


@check(
    f"""
SELECT id, vehicle_key FROM narratives WHERE {_TEXT_SQL} ORDER BY id LIMIT 15 OFFSET 15
""",
    (*NARRATIVES, "stems"),
)
def search_page(spark, sf_dir):
    matched = ops.search(views.narratives(spark, sf_dir), TEXT)
    return ops.search_page(matched, TEXT, ["id", "vehicle_key"], ["id"])


@check(
    """
SELECT count(*) AS match_count, true AS is_exact FROM reports WHERE miles IS NOT NULL
"""
)
def search_capped_count(spark, sf_dir):
    matched = ops.search(views.reports(spark, sf_dir), SearchRequest(mileage_only=True))
    return ops.capped_count(matched)


@check(
    f"""
SELECT n AS match_count, true AS is_exact, 'full_text' AS mode, 2 AS page, 15 AS page_size,
       CAST(greatest(ceil(n / 15), 1) AS INT) AS last_page, true AS has_previous,
       2 < ceil(n / 15) AS has_next
FROM (SELECT count(*) AS n FROM narratives WHERE {_TEXT_SQL})
""",
    (*NARRATIVES, "stems"),
)
def search_page_metadata(spark, sf_dir):
    return ops.page_metadata(ops.search(views.narratives(spark, sf_dir), TEXT), TEXT)


_REQUESTS = (
    "p_partkey AS request_id",
    "CASE p_partkey % 3 WHEN 0 THEN concat(' ', upper(make_slug)) WHEN 1 THEN p_name END AS make_slug",
    """CASE p_partkey % 5 WHEN 0 THEN 'power train ' WHEN 1 THEN 'BRAKES' WHEN 2 THEN p_type
       WHEN 3 THEN ' ' END AS component_group""",
    "CASE WHEN p_partkey % 4 > 0 THEN CAST(1990 + p_size AS INT) END AS year_from",
    "CASE WHEN p_partkey % 4 < 3 THEN 2000 END AS year_to",
)


@check(
    f"""
WITH asked AS (SELECT {', '.join(_REQUESTS)} FROM parts),
clean AS (SELECT request_id, nullif(lower(trim(make_slug)), '') AS m, nullif(trim(component_group), '') AS g,
                 year_from AS lo, year_to AS hi FROM asked)
SELECT request_id, k.make_slug, t.component_group,
       CASE WHEN lo > hi THEN hi ELSE lo END AS year_from, CASE WHEN lo > hi THEN lo ELSE hi END AS year_to,
       CASE WHEN k.make_slug IS NULL THEN m END AS unresolved_make,
       CASE WHEN t.component_group IS NULL THEN g END AS unresolved_group
FROM clean LEFT JOIN (SELECT DISTINCT make_slug FROM profiles) k ON k.make_slug = m
LEFT JOIN group_totals t ON upper(t.component_group) = upper(g)
""",
    ("parts", "reports", "profiles", "group_totals"),
)
def search_requests(spark, sf_dir):
    measures = as_measures(views.reports(spark, sf_dir))
    requests = views.parts(spark, sf_dir).selectExpr(*_REQUESTS)
    return ops.normalise_requests(
        requests, make_totals(vehicle_entries(measures)), group_totals(measures)
    )


SNIPPET_TERM = "tion, thered -was"
_SNIPPET_WORDS = ("tion", "thered")


def _sql_highlighted(piece: str) -> str:
    tests = []
    for word in _SNIPPET_WORDS:
        length = f"length({piece})"
        tests.append(
            f"(lower({piece}) = '{word}' OR (least({length}, {len(word)}) >= 4 "
            f"AND abs({length} - {len(word)}) <= 3 "
            f"AND (starts_with(lower({piece}), '{word}') OR starts_with('{word}', lower({piece})))))"
        )
    return "(" + " OR ".join(tests) + ")"


_SNIPPET_SQL = f"""
WITH whole AS (
    SELECT id, trim(regexp_replace(description, '[[:space:]]+', ' ', 'g')) AS w FROM narratives),
pieces AS (
    SELECT id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
    FROM (SELECT id, regexp_extract_all(w, '{SQL_WORD}|[^\\p{{L}}\\p{{Nd}}]+') AS p FROM whole)),
placed AS (
    SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY id ORDER BY i
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
           {_sql_highlighted('piece')} AS hit
    FROM pieces),
firsts AS (
    SELECT id, min(pos) AS anchor, arg_min(pos + length(piece), pos) AS hit_end FROM placed WHERE hit GROUP BY id),
rough AS (
    SELECT id, w, length(w) AS len, anchor IS NOT NULL AS has_match, coalesce(anchor, 0) AS anchor,
           coalesce(hit_end, 1) AS hit_end, greatest(coalesce(anchor, 0) - 90, 0) AS s
    FROM whole LEFT JOIN firsts USING (id)),
rough_end AS (SELECT *, least(len, greatest(s + 380, hit_end)) AS e FROM rough),
spaces AS (
    SELECT *, CASE WHEN s > 0 THEN strpos(substr(w, s), ' ') ELSE 0 END AS next_space,
           strpos(reverse(substr(w, 1, e + 1)), ' ') AS back
    FROM rough_end),
cut AS (
    SELECT *,
        CASE WHEN len <= 380 OR s = 0 THEN 0
             WHEN next_space > 0 AND s + next_space - 1 < anchor THEN s + next_space - 1
             ELSE anchor END AS b,
        CASE WHEN len <= 380 OR e >= len THEN len
             WHEN back > 0 AND e + 1 - back > least(hit_end, e) THEN e + 1 - back
             ELSE least(hit_end, e) END AS f
    FROM spaces)
SELECT id, substr(w, b + 1, f - b) AS snippet, b > 0 AS clipped_start, f < len AS clipped_end, has_match,
       coalesce(marked, '') AS marked
FROM cut LEFT JOIN (
    SELECT id, string_agg(CASE WHEN hit AND pos >= b AND pos + length(piece) <= f THEN '[' || piece || ']'
                          ELSE substr(piece, greatest(b - pos, 0) + 1,
                                      least(pos + length(piece), f) - greatest(pos, b)) END,
                          '' ORDER BY i) AS marked
    FROM placed JOIN cut USING (id) WHERE pos < f AND pos + length(piece) > b GROUP BY id) USING (id)
"""


@check(_SNIPPET_SQL, NARRATIVES)
def snippets(spark, sf_dir):
    shown = with_snippet(views.narratives(spark, sf_dir), "description", SNIPPET_TERM, "s")
    mark = F.transform(
        "s.segments",
        lambda e: F.when(e.is_match, F.concat(F.lit("["), e.text, F.lit("]"))).otherwise(e.text),
    )
    return shown.select(
        "id", F.col("s.text").alias("snippet"), F.col("s.clipped_start").alias("clipped_start"),
        F.col("s.clipped_end").alias("clipped_end"), F.col("s.has_match").alias("has_match"),
        F.array_join(mark, "").alias("marked"),
    )


@check(
    """
SELECT id, CASE WHEN length(w) <= 460 THEN w
                WHEN back > 0 AND 461 - back > 230 THEN substr(w, 1, 461 - back) || '…'
                ELSE substr(w, 1, 460) || '…' END AS text, length(w) > 460 AS shortened
FROM (SELECT id, w, strpos(reverse(substr(w, 1, 461)), ' ') AS back
      FROM (SELECT id, trim(regexp_replace(description, '[[:space:]]+', ' ', 'g')) AS w FROM narratives))
""",
    NARRATIVES,
)
def shortened_narratives(spark, sf_dir):
    return views.narratives(spark, sf_dir).select("id", shorten(F.col("description")).alias("s")).select(
        "id", "s.text", "s.shortened"
    )


@check(
    """
SELECT l_orderkey, l_linenumber, l_partkey, replace(component_raw, ':', ' / ') AS detail,
       concat_ws(', ', CASE WHEN crash = 1 THEN 'crash reported' END,
                 CASE WHEN fire = 1 THEN 'fire reported' END,
                 CASE WHEN injured > 0 THEN injured || ' injured' END,
                 CASE WHEN deaths > 0 THEN deaths || ' killed' END) AS outcomes,
       fire = 1 OR deaths > 0 AS severe
FROM reports
"""
)
def report_outcomes(spark, sf_dir):
    return views.reports(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        component_detail(F.col("component.raw")).alias("detail"),
        F.array_join(outcome_labels(), ", ").alias("outcomes"),
        is_severe().alias("severe"),
    )


@check(
    f"""
SELECT id, make, split_part(vehicle_key, '|', 1) AS make_slug, model, model_year, component_group,
       miles AS miles_at_failure,
       concat_ws(', ', CASE WHEN crash THEN 'crash reported' END, CASE WHEN fire THEN 'fire reported' END,
                 CASE WHEN injured > 0 THEN injured || ' injured' END,
                 CASE WHEN deaths > 0 THEN deaths || ' killed' END) AS outcomes
FROM narratives WHERE {_BOTH_SQL}
""",
    (*NARRATIVES, "stems"),
)
def search_hits(spark, sf_dir):
    matched = ops.search(views.narratives(spark, sf_dir), TEXT_AND_FORM)
    return ops.search_hits(matched, TEXT_AND_FORM.term).select(
        "id", "make", "make_slug", "model", "model_year", "component_group", "miles_at_failure",
        F.array_join("outcomes", ", ").alias("outcomes"),
    )


# The words of a narrative between single spaces, so that a phrase of whole words is a part of it.
views.SQL_VIEWS["spaced"] = f"""
SELECT id, ' ' || array_to_string(list_transform(regexp_extract_all(strip_accents(lower(description)), '{_TEXT_WORD}'),
                                                 lambda w: regexp_replace(w, '[''’]s$', '')), ' ') || ' ' AS spaced
FROM narratives
"""


@check(
    f"""
WITH placed AS (
    SELECT id, unnest(string_split(trim(spaced), ' ')) AS word, unnest(range(len(string_split(trim(spaced), ' ')))) AS place
    FROM spaced WHERE trim(spaced) <> ''
)
SELECT word, {sql_stem('word')} AS stem, CAST(id // {postings.RANGE_IDS} AS BIGINT) AS id_range, min(id) AS first_id, max(id) AS last_id,
       CAST(count(DISTINCT id) AS INT) AS reports, count(*) AS places,
       CAST(sum((id % {postings.RANGE_IDS} + 1) * (place + 1)) AS BIGINT) AS weighted
FROM placed GROUP BY ALL
""",
    (*NARRATIVES, "spaced"),
)
def positional_index(spark, sf_dir):
    """Every block with its range, and a sum over its occurrences that tells their ids and positions apart."""
    place = 1 << 32
    weighted = F.aggregate(
        "occurrences",
        F.lit(0).cast("bigint"),
        lambda total, o: total + (F.floor(o / place) + 1) * (o - F.floor(o / place) * place + 1),
    )
    blocks = postings.positional_index(views.narratives(spark, sf_dir))
    return blocks.select(
        "word", "stem", "id_range", "first_id", "last_id", "reports", F.size("occurrences").cast("bigint").alias("places"), weighted.alias("weighted")
    )


def _posted(spark, sf_dir, request):
    reports = views.narratives(spark, sf_dir)
    return postings.search_postings(postings.positional_index(reports), reports, request).select("id", "vehicle_key")


@check(f"SELECT id, vehicle_key FROM narratives WHERE {_TEXT_SQL}", (*NARRATIVES, "stems"))
def search_postings(spark, sf_dir):
    """Words and excluded words by merging blocks: the same rows as by reading the texts."""
    return _posted(spark, sf_dir, TEXT)


@check(
    f"""
SELECT id, vehicle_key FROM narratives JOIN spaced USING (id)
WHERE {_sql_has('oners', 'thered')} AND contains(spaced, ' of the ') AND NOT contains(spaced, ' to the ') AND NOT {_sql_has('heder')}
""",
    (*NARRATIVES, "stems", "spaced"),
)
def search_postings_phrase(spark, sf_dir):
    """Phrases of whole words, wanted and excluded, by merging blocks."""
    return _posted(spark, sf_dir, SearchRequest(term='oners thered "of the" -"to the" -heder'))
