import random

from pyspark.sql import functions as F

from faultline.functions.narrative import (
    outcome_labels,
    shorten,
    stem_all,
    stem_word,
    with_snippet,
)
from faultline.operators import search as ops
from faultline.operators.search import SearchRequest
from samples import report, reports, rows


def seeded(spark):
    return reports(
        spark,
        [
            report(1, group="POWER TRAIN", miles=30_000, text="Gearbox shudder under load."),
            report(2, make="BERYL", year=2016, group="POWER TRAIN", miles=60_000, text="Shuddering when pulling away"),
            report(3, make="BERYL", year=2016, group="ENGINE", text="Coolant loss, no leak visible"),
            report(4, group="POWER TRAIN", text="Clutch judder; BRAKES fine"),
            report(5, year=None, group="BRAKES", miles=120_000, text="brake-pedal sinks"),
        ],
    )


def ids(df):
    return [r[0] for r in rows(df, "id")]


def test_stems_fold_inflections(values):
    groups = [
        ["brake", "brakes", "braked", "braking"], ["slip", "slips", "slipped", "slipping"],
        ["battery", "batteries"], ["glass", "glasses"], ["shudder", "shudders"], ["shud"], ["bus"], ["ring"],
    ]
    words = [w for group in groups for w in group]
    stems = dict(zip(words, values(stem_all(F.array("t")), words)))
    assert {w: [stem_word(w)] for w in words} == stems
    assert [len({stem_word(w) for w in group}) for group in groups] == [1] * len(groups)
    assert len({stem_word(w) for w in words}) == len(groups)


def test_both_stemmers_agree_on_random_words(values):
    chance = random.Random(7)
    words = ["".join(chance.choices("aesidgnuyb", k=chance.randint(1, 7))) for _ in range(3000)]
    assert values(stem_all(F.array("t")), words) == [[stem_word(w)] for w in words]


def test_text_matches_whole_words(spark):
    table = seeded(spark)
    cases = {
        "shudder": [1, 2], "SHUDDERS": [1, 2], "shud": [], "brake": [4, 5], "leaking coolant": [3],
        "shudder -gearbox": [2], "-gearbox": [], "the": [], "judder shudder": [1, 2, 4],
        '"shudder under"': [1], 'coolant shudder -"pulling away"': [1, 3], '"leak Visible" "no leak"': [3],
        '"clutch shudder"': [], 'judder "': [4],
    }
    index = ops.inverted_index(table)
    for term, expected in cases.items():
        request = SearchRequest(term=term)
        assert ids(ops.search(table, request)) == expected, term
        assert ids(ops.search_index(index, table, request)) == expected, term


def test_single_letters_possessives_and_accents(spark):
    texts = {
        1: "The driver's seat moves.", 2: "Model S, door open", 3: "Café racer, brake-pedal", 4: "drivers report heat",
        5: "Grade e fuel; O'Neil agreed", 6: "naïve Ångström test", 7: "S", 8: "the end.",
    }
    table = reports(spark, [report(k, text=text) for k, text in texts.items()])
    index = ops.inverted_index(table)
    cases = {
        "s": [2, 7], "model s": [2, 7], "e": [5], "es": [], "driver": [1, 4], "driver's": [1, 4], "DRIVER\u2019S seat": [1, 4],
        "brake -s": [3], "open seat -s": [1], "cafe": [3], "CAF\u00c9": [3], "naive angstrom": [6], "o'neil": [5], "neil": [],
        '"cafe racer" brake': [3], "end -e": [8], "'s": [2, 7],
    }
    for term, expected in cases.items():
        request = SearchRequest(term=term)
        assert ids(ops.search(table, request)) == expected, term
        assert ids(ops.search_index(index, table, request)) == expected, term


def test_scan_and_index_agree_on_random_terms(spark):
    chance = random.Random(11)

    def word():
        return "".join(chance.choices("aes\u00e9'\u2019diyb", k=chance.randint(1, 5)))

    table = reports(spark, [report(k, text=" ".join(word() for _ in range(6)) + ".") for k in range(120)])
    index = ops.inverted_index(table).cache()
    for _ in range(25):
        request = SearchRequest(term=f"{word()} {word()} -{word()}")
        assert ids(ops.search(table, request)) == ids(ops.search_index(index, table, request)), request.term


def test_filters(spark):
    table = seeded(spark)
    cases = [
        (SearchRequest(term="shudder", make_slug="beryl"), [2]),
        (SearchRequest(component_group="POWER TRAIN", mileage_only=True), [1, 2]),
        (SearchRequest(year_from=2016, year_to=2016), [2, 3]),
        (SearchRequest(year_to=2015), [1, 4]),
        (SearchRequest(), []),
        (SearchRequest(term="  ", make_slug=" "), []),
    ]
    for request, expected in cases:
        assert ids(ops.search(table, request)) == expected
        assert ids(ops.search_index(ops.inverted_index(table), table, request)) == expected


def test_stored_index(spark, tmp_path):
    path = str(tmp_path / "index")
    ops.write_inverted_index(ops.inverted_index(seeded(spark)), path)
    stored = spark.read.parquet(path)
    assert ids(ops.search_index(stored, seeded(spark), SearchRequest(term="brakes"))) == [4, 5]


def test_pages_do_not_repeat(spark):
    matched = ops.search(seeded(spark), SearchRequest(component_group="POWER TRAIN"))
    pages = [SearchRequest(component_group="POWER TRAIN", page=p, page_size=1) for p in (1, 2, 3, 4)]
    found = [ids(ops.search_page(matched, page, ["id"], ["id"])) for page in pages]
    assert found == [[1], [2], [4], []]
    first, last = (ops.page_metadata(matched, pages[i]).first() for i in (0, 2))
    assert (first.match_count, first.last_page, first.has_previous, first.has_next) == (3, 3, False, True)
    assert (last.has_previous, last.has_next) == (True, False)
    assert SearchRequest(page=0, page_size=900).size == 900 and SearchRequest(page=-3).offset == 0


def test_capped_count(spark):
    table = seeded(spark)
    assert tuple(ops.capped_count(table, cap=5).first()) == (5, False)
    assert tuple(ops.capped_count(table, cap=6).first()) == (5, True)
    assert ops.capped_count_now(table, cap=2) == (2, False)
    assert ops.capped_count_now(table, cap=9) == (5, True)


def test_requests_are_checked_against_what_exists(spark):
    asked = spark.createDataFrame(
        [(1, " OPAL ", "power train", 2018, 2010), (2, "nope", "x", None, 2010), (3, None, " ", 2015, None)],
        "i int, make_slug string, component_group string, year_from int, year_to int",
    )
    makes = spark.createDataFrame([("opal",)], "make_slug string")
    groups = spark.createDataFrame([("POWER TRAIN",)], "component_group string")
    assert rows(ops.normalise_requests(asked, makes, groups)) == [
        (1, "opal", "POWER TRAIN", 2010, 2018, None, None),
        (2, None, None, None, 2010, "nope", "x"),
        (3, None, None, 2015, None, None, None),
    ]


def snippet_of(spark, text, term):
    return with_snippet(spark.createDataFrame([(text,)], "t string"), "t", term).first().snippet


def test_snippet_of_short_text_marks_words(spark):
    found = snippet_of(spark, "  The  brakes, braking\nand BRAKE; abrake brak bra ", "brake -the a")
    assert found.text == "The brakes, braking and BRAKE; abrake brak bra"
    assert (found.clipped_start, found.clipped_end, found.has_match) == (False, False, True)
    assert [s.text for s in found.segments if s.is_match] == ["brakes", "BRAKE", "brak"]
    assert "".join(s.text for s in found.segments) == found.text


def brute_window(text, start, end, anchor, floor):
    while 0 < start < anchor and text[start - 1] != " ":
        start += 1
    while min(floor, end) < end < len(text) and text[end] != " ":
        end -= 1
    return start, end


def test_snippet_window_against_brute_force(spark):
    filler = "lorem ipsum dolor sit amet consectetur "
    texts = [filler * n + "needle" + (" tail of it" * m) for n in (0, 1, 3, 9, 30) for m in (0, 2, 60)]
    texts += ["x" * 700, "x" * 200 + " needle " + "y" * 600, filler * 20, "", "needle" * 100]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in with_snippet(df, "t", "needle").collect():
        text = " ".join(texts[row.i].split())
        at = next((k for k in range(len(text)) if text.startswith("needle", k)
                   and (k == 0 or not text[k - 1].isalnum())
                   and (k + 6 == len(text) or not text[k + 6].isalnum())), -1)
        anchor, floor = (at, at + 6) if at >= 0 else (0, 1)
        start = max(0, anchor - 90)
        end = min(len(text), max(start + 380, floor))
        if len(text) <= 380:
            start, end = 0, len(text)
        else:
            start, end = brute_window(text, start, end, anchor, floor)
        s = row.snippet
        assert (s.text, s.clipped_start, s.clipped_end, s.has_match) == (
            text[start:end], start > 0, end < len(text), at >= 0,
        ), row.i
        assert "".join(p.text for p in s.segments) == s.text


def test_snippet_without_term(spark):
    found = snippet_of(spark, "word " * 200, None)
    assert not found.has_match and found.clipped_end and len(found.text) <= 380


def test_shortening(spark, values):
    texts = ["a  b", "x" * 500, "word " * 100, "a" * 100 + " " + "b" * 500, "a" * 460 + " tail", ""]
    found = values(shorten(F.col("t")), texts)
    assert found[0] == ("a b", False) and found[5] == ("", False)
    assert found[1].text == "x" * 460 + "…"
    assert found[2].text == ("word " * 92).rstrip() + "…" and found[2].shortened
    assert found[3].text == "a" * 100 + " " + "b" * 359 + "…"
    assert found[4].text == "a" * 460 + "…"


def test_outcomes(spark):
    table = reports(spark, [report(1, crash=True, injured=2), report(2, fire=True, deaths=1), report(3)])
    assert [r[0] for r in table.orderBy("id").select(outcome_labels()).collect()] == [
        ["crash reported", "2 injured"], ["fire reported", "1 killed"], [],
    ]
