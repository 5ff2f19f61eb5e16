"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The words of a source form a line: shards in order, in a shard documents in a seeded order. The line is cut
into blocks of equal size. Blocks of the whole mix are apportioned to sources by highest quotients, the
quota of a source to its shards likewise, and each shard selects that many of its blocks by a seeded
permutation. A quota beyond the blocks there are takes whole rounds first. A document is taken as far as its blocks are. Scattered blocks
are no texts, so texts are mixed by whole documents: the line of a shard is taken from its beginning, as many words
as its selected blocks make up.

A shard holds about `WORDS_PER_SHARD` words, a source at most `MOST_SHARDS` shards, so a source with a third of all
rows is spread over many groups; tables of sources and shards are sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.llm.common import checkpointed, split_by_repeats, text_of

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 16
WORDS_PER_SHARD = 1 << 16
MOST_SHARDS = 4096
MOST_COPIES = 3
SEED = "mix"
#: Steps of the seeded permutations; a length divisible by the first takes the second.
STRIDES = (1_000_003, 1_000_033)


def seeded(*parts: Column, seed: str = SEED) -> Column:
    """A number below 2^32 from the values as text."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(part.cast("string"), F.lit("~")) for part in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def apportion(
    parties: DataFrame, group: list[str], order: list[str], weight: str, seats: str, most: str, quota: str
) -> DataFrame:
    """Adds `quota`: the `seats` of each group, dealt to its rows by the highest quotients weight / (2k + 1).

    No row gets more than `most`. Seats whose quotient is above a bound that fewer than all seats can reach
    are counted, and only the few below it, at most two a row, are ranked. Equal quotients: earlier in `order`.
    """
    all_of = Window.partitionBy(*group)
    free = F.col(weight) > 0
    rows = F.sum(F.when(free, 1).otherwise(0)).over(all_of)
    total = F.sum(F.col(weight)).over(all_of)
    ranged = parties.withColumns(
        {
            "high__": F.greatest(total / F.greatest(F.col(seats) - rows / 2, F.lit(0.5)), F.lit(1e-9)),
            "low__": F.greatest(total / (F.col(seats) + rows / 2 + 1), F.lit(1e-9)),
        }
    )
    counted = ranged.withColumns(
        {
            "sure__": F.least(F.col(most), F.floor(F.col(weight) / F.col("high__") + 0.5)),
            "perhaps__": F.least(F.col(most), F.floor(F.col(weight) / F.col("low__") + 0.5)),
        }
    )
    # When even the upper bound gives too many seats, all of them are ranked.
    given = F.sum("sure__").over(all_of)
    counted = counted.withColumn("sure__", F.when(given > F.col(seats), F.lit(0)).otherwise(F.col("sure__")))
    counted = counted.withColumn("rest__", F.col(seats) - F.sum("sure__").over(all_of))
    seat = F.explode(F.sequence(F.col("sure__") + 1, F.col("perhaps__")))
    by_quotient = Window.partitionBy(*group).orderBy(F.desc("quotient__"), *order)
    won = (
        counted.filter(F.col("perhaps__") > F.col("sure__"))
        .select(*group, *order, weight, "rest__", seat.alias("seat__"))
        .withColumn("quotient__", F.col(weight) / (2 * F.col("seat__") - 1))
        .withColumn("rank__", F.row_number().over(by_quotient))
        .filter(F.col("rank__") <= F.col("rest__"))
        .groupBy(*dict.fromkeys(group + order))
        .agg(F.count("*").alias("won__"))
    )
    keys = list(dict.fromkeys(group + order))
    return (
        counted.join(won, keys, "left")
        .withColumn(quota, (F.col("sure__") + F.coalesce(F.col("won__"), F.lit(0))).cast("long"))
        .drop("high__", "low__", "sure__", "perhaps__", "rest__", "won__")
    )


def source_targets(sources: DataFrame, most_copies: int = MOST_COPIES) -> DataFrame:
    """Adds source_no and target to rows of (source, source_size).

    Sources weigh 1, 2, 3, repeating, by code point, null last. A target stops at `most_copies` times the source's
    size and the excess goes to the others by weight: in order of size over weight, the first sources stop.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    named = sources.withColumn("source_no", F.row_number().over(by_name).cast("long"))
    named = named.withColumn("weight", (F.col("source_no") - 1) % 3 + 1)
    most = F.col("source_size") * most_copies
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    level = (F.sum("source_size").over(everywhere) - F.coalesce(F.sum(most).over(before), F.lit(0))) / (
        F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levelled = named.withColumn("level", level)
    open_at = F.when(F.col("level") * F.col("weight") <= most, F.col("level"))
    # Levels rise while sources stop; the first that does not stop fixes the level of all after it.
    held = levelled.withColumn("held", F.first(open_at, ignorenulls=True).over(by_ratio))
    target = F.when(F.col("held").isNull(), most.cast("double")).otherwise(F.col("held") * F.col("weight"))
    return held.withColumn("target", target).drop("level", "held", "weight")


def _laid(
    docs: DataFrame,
    block_words: int = BLOCK_WORDS,
    words_per_shard: int = WORDS_PER_SHARD,
    most_copies: int = MOST_COPIES,
    seed: str = SEED,
) -> DataFrame:
    """The lines of the sources: begin and end of each document in that of its source, and the words its blocks take."""
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    sized = checkpointed(docs.select("doc_id", "source", size.alias("size"), seeded(F.col("doc_id"), seed=seed).alias("place")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sources, most_copies)
    blocks = F.ceil(F.col("source_size") / block_words)
    sources = sources.withColumns(
        {
            "blocks": blocks,
            "shards": F.least(F.lit(MOST_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / words_per_shard))),
            "seats": F.round(F.sum("source_size").over(Window.partitionBy()) / block_words).cast("long"),
            "most": blocks * most_copies,
            "all": F.lit(1),
        }
    )
    sources = checkpointed(apportion(sources, ["all"], ["source_no"], "target", "seats", "most", "quota"))
    same = sized["source"].eqNullSafe(sources["source"])
    placed = sized.join(sources, same).select(
        "doc_id", sized["source"], "size", "source_size", "source_no", "target", "place",
        (F.col("place") % F.col("shards")).alias("shard"),
    )
    in_source = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (
        placed.groupBy("source_no", "shard")
        .agg(F.sum("size").alias("words"))
        .join(sources.select("source_no", "blocks", "quota"), "source_no")
        .withColumn("from", F.coalesce(F.sum("words").over(in_source), F.lit(0)))
        .withColumn("first", F.ceil(F.col("from") / block_words))
        .withColumn("own", F.ceil((F.col("from") + F.col("words")) / block_words) - F.col("first"))
        .withColumn("rounds", F.expr("quota div greatest(blocks, 1)"))
        .withColumn("extra_all", F.col("quota") - F.col("rounds") * F.col("blocks"))
    )
    shards = apportion(shards, ["source_no"], ["shard"], "own", "extra_all", "own", "extra").select(
        "source_no", "shard", "from", "first", "own", "rounds", "extra",
        F.when(F.col("own") % STRIDES[0] == 0, STRIDES[1]).otherwise(STRIDES[0]).alias("stride"),
        seeded(F.col("source_no"), F.col("shard"), seed=seed).alias("turn"),
    )
    # A block belongs to the shard in which it begins, so the first words of a shard can be in a block before it.
    line = Window.partitionBy("source_no", "shard").orderBy("place", "doc_id", "size")
    running = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1))
    before = Window.partitionBy("source_no").orderBy("shard")
    last = {c: F.last(F.when(F.col("own") > 0, F.col(c)), ignorenulls=True) for c in ("first", "own", "extra", "stride", "turn")}
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumns({f"last_{c}": v.over(earlier) for c, v in last.items()})
    laid = placed.withColumn("at", F.coalesce(running, F.lit(0))).join(shards, ["source_no", "shard"])
    laid = laid.withColumn("begin", F.col("from") + F.col("at")).withColumn("end", F.col("begin") + F.col("size"))

    def chosen(i: Column, prefix: str = "") -> Column:
        c = lambda name: F.col(prefix + name)
        spot = ((i - c("first")) * c("stride") + c("turn")) % F.greatest(c("own"), F.lit(1))
        return F.when(spot < c("extra"), 1).otherwise(0)

    def taken_of(i: Column) -> Column:
        overlap = F.least(F.col("end"), (i + 1) * block_words) - F.greatest(F.col("begin"), i * block_words)
        return overlap * (F.col("rounds") + F.when(i < F.col("first"), chosen(i, "last_")).otherwise(chosen(i)))

    block = F.sequence(F.expr(f"begin div {block_words}"), F.expr(f"(end - 1) div {block_words}"))
    taken = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(block, F.lit(0).cast("long"), lambda total, i: total + taken_of(i))
    )
    return laid.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "source_no", "shard", "begin", "end"
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """How much of each document the mix takes; one row per row of `docs` (doc_id, text, source are read).

    Size is the number of words; a null text has none, and a document without words is not taken. A null source
    is a source of its own, the last. Rows that repeat count as often as they occur. All choices are seeded, so
    reruns agree. An empty table gives no rows.

    Columns: doc_id, size, source_size, target, taken, source.
    """
    return _laid(docs, **options).select("doc_id", "size", "source_size", "target", "taken", "source")


def _whole_takes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, taken: the words that `mix` takes in a shard, dealt along the shard's line to whole documents.

    Each has as many rounds as the whole shard. What is beyond goes to documents in the order of the line: those that end
    by then, and the one that goes on past it with a probability of the part that it has before (by a seeded number), so a
    shard is right on average, however long its documents are. The order is seeded, hence no kind of document comes first.
    """
    laid = checkpointed(_laid(docs, **options))
    # Sums of shards are joined back by shard, so no large source is one task.
    shards = laid.groupBy("source_no", "shard").agg(
        F.sum("taken").alias("words"), F.sum("size").alias("shard_size"), F.min("begin").alias("from")
    )
    rounds, extra = (F.expr(f"words {sign} greatest(shard_size, 1)") for sign in ("div", "%"))
    reach = seeded(F.col("doc_id"), F.lit("whole"), seed=options.get("seed", SEED)) / (1 << 32) * F.col("size")
    beyond = F.when(F.col("begin") - F.col("from") + reach < extra, F.col("size")).otherwise(0)
    return laid.join(shards, ["source_no", "shard"]).select(
        "doc_id", "size", (rounds * F.col("size") + beyond).cast("long").alias("taken")
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with all of their columns, whole, as many copies as are taken. A shard has the words it has
    in `mix`, but for less than the one document at which its quota ends. Documents not taken, and those without words,
    are gone. Rows that repeat an id and a size are taken as often as their places in the line say; reruns agree."""
    takes = _whole_takes(docs, **options).select(F.col("doc_id").alias("id__"), F.col("size").alias("size__"), "taken")
    alike = Window.partitionBy("id__", "size__").orderBy("taken")
    takes = takes.withColumn("turn__", F.row_number().over(alike)).filter("taken > 0")
    copy = F.explode(F.array_repeat(F.lit(1), F.expr("cast(taken div size__ as int)")))
    takes = takes.select("id__", "size__", "turn__", copy.alias("copy__"))
    # Rows that repeat an id are paired with their takes by size, in any order among equal sizes.
    once, repeated = split_by_repeats(docs, docs)
    repeated = repeated.withColumn("own_size__", F.regexp_count(text_of(), F.lit(WORD)).cast("long"))
    own = Window.partitionBy("doc_id", "own_size__").orderBy("text")
    repeated = repeated.withColumn("own_turn__", F.row_number().over(own))
    same = F.col("doc_id").eqNullSafe(F.col("id__"))
    rows = once.join(takes, same).drop("size__", "turn__").unionByName(
        repeated.join(
            takes, same & (F.col("own_size__") == F.col("size__")) & (F.col("own_turn__") == F.col("turn__"))
        ).drop("size__", "turn__", "own_size__", "own_turn__")
    )
    return rows.drop("id__", "copy__")
