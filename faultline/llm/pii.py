"""Personal data: fixed patterns, and candidates that boosted trees select.

High-recall generators propose overlapping spans (mail-like, number-like, secret-like). Each becomes
features of its format (lengths, digits, groups, check digit) and of its context (what stands before and after).
Gradient-boosted trees learn on all candidates which of them look like verified personal
data: a candidate counts as such if it covers a span that passed the checks of the fixed patterns, or is the
value of an assignment to a name of a secret. Thresholds for each generator are calibrated on documents the trees have not
seen. Selected candidates are added; the fixed spans always stay.

Everything is a built-in expression over the row of a document: texts are read once and never shuffled, and the
trees are evaluated as CASE expressions. Quantifiers are possessive, so a long run of digits or letters neither
backtracks nor recurses.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import checkpointed, crc_remainder, text_of

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns, in a form that scans a long run of matching characters once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
NEEDED = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
#: Generators of candidates: what must be there, and the pattern.
GENERATORS = {
    "mail": (
        r"@|\(at\)|\[at\]",
        r"(?:\G|(?<![\w.+-]))[\w.+-]++\x20?+(?:@|\(at\)|\[at\])\x20?+[\w-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[\w-]++)++",
    ),
    "number": (r"[0-9].?.?[0-9]", r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"),
    "secret": (r"[:=]", r"(?<=[:=][\"'\x20]{0,2})[A-Za-z0-9+/_-]{12,}+"),
}
#: Words whose assigned value is a secret.
SECRET_NAMES = r"(?i)(?:password|passwd|secret|token|api.?key|access.?key)[\"']?\x20?[:=][\"'\x20]{0,2}$"
FEATURES = (
    "generator", "chars", "digits", "letters", "others", "groups", "longest", "distinct", "checked", "dots", "plus", "at",
    "hex", "before_word", "after_word", "assigned", "named",
)
CONTEXT = 24
PRECISION = 0.98
#: Steps of the scores from 0 to 1 between which a threshold may lie.
GRID = 10_000
TREES, DEPTH = 10, 4

SPAN = "array<struct<start:bigint,end:bigint,found:string,before:string,after:string>>"


def matches(text: Column, pattern: str, needed: str) -> Column:
    """All leftmost non-overlapping matches, none if `needed` is not in the text."""
    return F.when(text.rlike(needed), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def spans(text: Column, found: Column, pattern: str) -> Column:
    """Matches with their places in code points, and the characters next to them."""
    pieces = F.split(text, pattern, -1)

    def step(state: Column, i: Column) -> Column:
        between, match, rest = F.get(state["pieces"], i), F.get(state["found"], i), F.get(state["pieces"], i + 1)
        start = state["at"] + F.length(between)
        end = start + F.length(match)
        span = F.struct(
            start.alias("start"), end.alias("end"), match.alias("found"),
            F.right(between, F.lit(CONTEXT)).alias("before"), F.left(rest, F.lit(1)).alias("after"),
        )
        return F.struct(
            end.alias("at"), state["pieces"].alias("pieces"), state["found"].alias("found"),
            F.concat(state["spans"], F.array(span)).alias("spans"),
        )

    empty = F.array().cast(SPAN)
    begin = F.struct(
        F.lit(0).cast("long").alias("at"), pieces.alias("pieces"), found.alias("found"), empty.alias("spans")
    )
    walked = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), begin, step, lambda state: state["spans"])
    return F.when(F.size(found) > 0, walked).otherwise(empty)


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]++", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    back = F.reverse(digits)

    def step(total: Column, i: Column) -> Column:
        digit = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(digit > 9, digit - 9).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    """The check of a fixed pattern."""
    digits = digits_of(found)
    if kind == "ip":
        value = lambda part: F.regexp_replace(part, "^0++", "")
        return F.forall(
            F.split(found, r"\."),
            lambda part: (F.length(value(part)) <= 3) & (F.coalesce(value(part).try_cast("int"), F.lit(0)) <= 255),
        )
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def features(generator: int, span: Column) -> Column:
    """Format and context of a candidate as numbers."""
    found, before, after = span["found"], span["before"], span["after"]
    digits = digits_of(found)
    letters = F.length(F.regexp_replace(found, "[^A-Za-z]++", ""))
    groups = F.split(found, "[^A-Za-z0-9]++")
    values = {
        "generator": F.lit(generator),
        "chars": F.length(found),
        "digits": F.length(digits),
        "letters": letters,
        "others": F.length(found) - F.length(digits) - letters,
        "groups": F.size(groups),
        "longest": F.array_max(F.transform(groups, lambda g: F.length(g))),
        "distinct": F.size(F.array_distinct(F.split(found, ""))),
        "checked": F.when(F.length(digits).between(12, 19), luhn(digits).cast("int")).otherwise(-1),
        "dots": F.length(found) - F.length(F.replace(found, F.lit("."), F.lit(""))),
        "plus": found.startswith("+").cast("int"),
        "at": F.contains(found, F.lit("@")).cast("int"),
        "hex": found.rlike("^[0-9a-f]++$").cast("int"),
        "before_word": before.rlike("[A-Za-z0-9]$").cast("int"),
        "after_word": after.rlike("^[A-Za-z0-9]").cast("int"),
        "assigned": before.rlike("[:=][\"'\\x20]{0,2}$").cast("int"),
        "named": before.rlike(SECRET_NAMES).cast("int"),
    }
    return F.struct(*[values[name].cast("double").alias(name) for name in FEATURES])


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def _passing(kind: str):
    return lambda span: passes(kind, span["found"])


def _placed(kind: str):
    return lambda span: F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"))


def _candidate(generator: int, kind: str):
    return lambda span: F.struct(
        F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
        features(generator, span).alias("features"), overlaps(span, F.col("base")).alias("covers"),
    )


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans that passed, by kind) and candidates with features and weak labels, a row per document."""
    text = F.col("text")
    work = docs.select(F.col("doc_id"), text_of().alias("text"))
    rules = {k: (NEEDED[k], p) for k, p in PATTERNS.items()} | GENERATORS
    work = work.withColumns({f"m_{name}": matches(text, pattern, needed) for name, (needed, pattern) in rules.items()})
    work = work.select(
        "doc_id", *[spans(text, F.col(f"m_{name}"), pattern).alias(name) for name, (_, pattern) in rules.items()]
    )
    work = work.withColumns({kind: F.filter(F.col(kind), _passing(kind)) for kind in KINDS})
    work = work.withColumn("base", F.concat(*[F.transform(F.col(kind), _placed(kind)) for kind in KINDS]))
    candidates = F.concat(*[F.transform(F.col(name), _candidate(n, name)) for n, name in enumerate(GENERATORS)])
    return work.select("doc_id", "base", candidates.alias("candidates"))


def tree_expression(lines: list[str], feature) -> Column:
    """A printed decision tree as nested CASE expressions."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return F.lit(float(line.split(":")[1]))
    name, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left = tree_expression(lines, feature)
    lines.pop(0)
    return F.when(feature(int(name)) <= float(bound), left).otherwise(tree_expression(lines, feature))


def chance(model, feature) -> Column:
    """The boosted trees' probability as an expression."""
    margin = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        lines = [x for x in tree.toDebugString.splitlines()[1:] if x.strip()]
        margin = margin + tree_expression(lines, feature) * weight
    return 1 / (1 + F.exp(-2 * margin))


def step_of(score: Column) -> Column:
    """The step of the grid a score is on; rounded first, as sums of the learner may differ in their last bits."""
    return F.floor(F.round(score, 9) * GRID)


def fit(found: DataFrame, precision: float = PRECISION):
    """Trees and a threshold (a step of the grid) for each generator, or None where the candidates show only one label.

    All candidates are learnt from, equal ones as one row with their number as its weight, but for those of documents whose
    crc32(doc_id) mod 4 is 3, which calibrate: the threshold of a generator is the least step from which on `precision` of its
    candidates are right. Only counts per generator and step, at most half of GRID each, reach the driver.
    """
    rows = found.select("doc_id", F.explode("candidates").alias("c")).select(
        (crc_remainder(F.col("doc_id"), 4) == 3).alias("calibrates"),
        "c.kind",
        "c.features.*",
        (F.col("c.covers") | (F.col("c.features.named") == 1)).cast("double").alias("label"),
        (F.xxhash64("doc_id", "c.start", "c.kind") % 2 == 0).alias("shown"),
    )
    # Half of the candidates learnt from do without the name before them, so a value is known by its format, too.
    named = F.when(F.col("calibrates") | F.col("shown"), F.col("named")).otherwise(0.0)
    shapes = rows.withColumn("named", named).groupBy("calibrates", "kind", *FEATURES, "label").agg(F.count("*").cast("double").alias("n"))
    shapes = checkpointed(shapes)
    # No more partitions than there are cores: the learner passes over few rows many times.
    learnt = shapes.filter(~F.col("calibrates")).coalesce(found.sparkSession.sparkContext.defaultParallelism)
    if learnt.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    model = GBTClassifier(
        featuresCol="vector", labelCol="label", weightCol="n", maxIter=TREES, maxDepth=DEPTH, seed=7
    ).fit(vectors.transform(learnt.drop("kind", "calibrates")))
    step = step_of(chance(model, lambda i: F.col(FEATURES[i]))).alias("step")
    scored = shapes.filter("calibrates").select("kind", "label", "n", step).filter(F.col("step") >= GRID // 2)
    scores = scored.groupBy("kind", "step").agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("n")).collect()
    thresholds = {}
    for kind in GENERATORS:
        right = n = 0
        for row in sorted((r for r in scores if r.kind == kind), key=lambda r: -r.step):
            right, n = right + row.right, n + row.n
            if right >= precision * n:
                thresholds[kind] = row.step
    return model, thresholds


def find_personal_data(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """Spans of personal data in each row of `docs` (doc_id, text; other columns are not read).

    A null text counts as empty; rows that repeat give repeated rows; an empty table gives none. Counts are
    those of the fixed patterns. Spans are kind:start:end in code points, end exclusive. Added spans have the name of
    their generator as kind and follow the fixed ones.

    Columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.
    """
    found = checkpointed(found_spans(docs))
    fitted = fit(found, precision)
    none = F.filter("candidates", lambda c: F.lit(False))
    added = none
    if fitted:
        model, thresholds = fitted
        step = lambda c: step_of(chance(model, lambda i: c["features"][FEATURES[i]]))

        def chosen(c: Column) -> Column:
            reached = F.lit(False)
            for kind, threshold in thresholds.items():
                reached = reached | ((c["kind"] == kind) & (step(c) >= threshold))
            return ~c["covers"] & reached

        added = F.filter("candidates", chosen)
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    rows = found.select("doc_id", "base", added.alias("added"))
    base = F.array_join(F.transform("base", written), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(F.transform("base", written), F.transform("added", written)), ",").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text with each span replaced by its kind in brackets, and spans; overlapping spans are merged, the first names."""
    spans_of = find_personal_data(docs, **options).select(F.col("doc_id").alias("id__"), "spans").distinct()
    rows = docs.select("doc_id", text_of().alias("text")).join(spans_of, F.col("doc_id").eqNullSafe(F.col("id__")))
    parsed = F.transform(
        F.filter(F.split("spans", ","), lambda s: s != ""),
        lambda s: F.struct(
            F.split(s, ":")[1].cast("long").alias("start"), F.split(s, ":")[2].cast("long").alias("end"), F.split(s, ":")[0].alias("kind")
        ),
    )

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        shown = F.when(
            fresh,
            F.concat(
                state["shown"],
                F.substring(F.col("text"), state["at"].cast("int") + 1, (span["start"] - state["at"]).cast("int")),
                F.lit("["), span["kind"], F.lit("]"),
            ),
        ).otherwise(state["shown"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), shown.alias("shown"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("shown"))
    ended = F.aggregate(F.array_sort(parsed), begin, step)
    rest = F.substring(F.col("text"), ended["at"].cast("int") + 1, F.length("text"))
    return rows.select("doc_id", F.concat(ended["shown"], rest).alias("text"), "spans")
