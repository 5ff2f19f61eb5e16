"""Positional posting lists: phrases and exclusions without reading texts."""

import pytest

from faultline.operators.postings import positional_index, search_postings, write_positional_index
from faultline.operators.search import SearchRequest, search

TEXTS = [
    (0, "The brake pedal went to the floor"),
    (1, "Brakes failed; the pedal brake was replaced"),
    (2, "brake. Pedal"),
    (3, None),
    (4, ""),
    (5, "the brakes pedal the brake pedal the BRAKE PEDAL"),
    (8191, "the driver's brake pedal"),
    (8192, "Brâke pédal, shudder"),
    (10**12, "pedal brake pedal brake"),
    (10**12 + 1, "brake"),
]


@pytest.fixture
def reports(spark):
    return spark.createDataFrame([(i, t, "a|b|2001", "x") for i, t in TEXTS], "id long, description string, vehicle_key string, word string")


CASES = {
    'brake "brake pedal"': [0, 2, 5, 8191, 8192, 10**12],
    'brake "pedal brake"': [1, 10**12],
    'brake -"brake pedal"': [1, 10**12 + 1],
    'brake "pedal the brake"': [5],
    'brake "the driver brake"': [8191],
    'shudder brakes -pedal': [10**12 + 1],
    '"to the floor"': [0],
    '"to the"': [],
    'shud': [],
    'brake "..."': [],
    '-brake': [],
}


@pytest.mark.parametrize("range_ids", [1, 3, 4096])
def test_phrases_are_whole_consecutive_words(reports, range_ids):
    index = positional_index(reports, range_ids=range_ids).cache()
    for term, ids in CASES.items():
        found = search_postings(index, reports, SearchRequest(term=term), range_ids=range_ids)
        assert sorted(r.id for r in found.collect()) == ids, term


def test_words_match_as_by_reading_texts(reports):
    index = positional_index(reports)
    for term in ("brakes shudder -driver", "pedals", "replaced floor -to"):
        request = SearchRequest(term=term)
        assert sorted(r.id for r in search_postings(index, reports, request).collect()) == sorted(
            r.id for r in search(reports, request).collect()
        )


def test_a_lookup_reads_blocks_of_its_words_and_no_text(spark, reports, tmp_path):
    write_positional_index(positional_index(reports, range_ids=2), str(tmp_path / "index"))
    reports.write.parquet(str(tmp_path / "reports"))
    index, stored = spark.read.parquet(str(tmp_path / "index")), spark.read.parquet(str(tmp_path / "reports"))
    found = search_postings(index, stored, SearchRequest(term='brake "brake pedal" -"the floor"'), range_ids=2).select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "description" not in plan and "PushedFilters: [Or(In(stem" in plan
    assert sorted(r.id for r in found.collect()) == [2, 5, 8191, 8192, 10**12]


def test_a_block_has_its_range(reports):
    rows = {(r.word, r.id_range): r for r in positional_index(reports, range_ids=4).collect()}
    brake = rows["brake", 0]
    assert (brake.first_id, brake.last_id, brake.reports, len(brake.occurrences)) == (0, 2, 3, 3)
    assert [o % 2**32 for o in brake.occurrences] == [1, 4, 0]
    assert rows["brakes", 1].stem == "brak"
