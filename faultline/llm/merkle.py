"""A manifest of a data set as Merkle trees, kept as logs whose nodes lie in postorder.

Leaves of a tree are appended in order; a node is appended as soon as its run of eight children is complete, and
the open runs are closed when the leaves end. So a complete subtree of height h is one stretch of the log, and where a
node stands follows from its level, its index and the number of leaves alone: before a leaf stand all nodes that the
leaves before it complete, n // 8^m of each level m. Proofs find siblings by these positions; no links are stored.

A builder takes an aligned block of 8^4 leaves, so its nodes are whole subtrees (but for the last block). The tops of
blocks are the leaves of the next tier, again in aligned blocks, until one is left: a tree of any size is a few
Spark jobs, each 4096 times smaller than the one before, and no task holds more than a block. Proofs go down the same tiers:
what a block needs from above is found once for the block, not for each leaf.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import checkpointed, lower_ascii, stored
from faultline.operators.ordinal import with_ordinal

FANOUT = 8
#: Levels that one builder appends; it holds FANOUT ** BLOCK_LEVELS nodes of its lowest level.
BLOCK_LEVELS = 4

_LOG = "tree string, tier int, block long, position long, level int, index long, digest string, top boolean, leaves long"


def H(*parts: str) -> str:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def width(level: int, leaves: int) -> int:
    """Nodes of a level of a tree."""
    return -(-leaves // FANOUT**level)


def height(leaves: int) -> int:
    level = 0
    while width(level, leaves) > 1:
        level += 1
    return level


def completed(leaves: int) -> int:
    """Nodes that are complete once so many leaves are appended."""
    total = 0
    while leaves:
        total += leaves
        leaves //= FANOUT
    return total


def position(level: int, index: int, leaves: int) -> int:
    """Where node `index` of `level` stands in the log of a tree with so many leaves."""
    end = (index + 1) * FANOUT**level
    if end <= leaves:
        return completed(end - 1) + level
    # The open runs at the right edge are closed last, from the lowest level up.
    lowest = next(m for m in range(1, level + 1) if leaves % FANOUT**m)
    return completed(leaves) + level - lowest


def siblings(level: int, index: int, leaves: int) -> range:
    """Indexes of the run that a node stands in, itself included."""
    first = index - index % FANOUT
    return range(first, min(first + FANOUT, width(level, leaves)))


def append(digests: list[str], first: int, base: int, leaves: int, levels: int = BLOCK_LEVELS) -> list[tuple[int, int, int, str]]:
    """The log that a builder writes over nodes first, first + 1, ... of level `base`: (position, level, index, digest) in
    the order of completion."""
    top = min(base + levels, height(leaves))
    log: list[tuple[int, int, int, str]] = []
    open_runs: list[list[str]] = [[] for _ in range(top - base)]

    def close(level: int, index: int, digest: str) -> None:
        if level > base or base == 0:
            log.append((position(level, index, leaves), level, index, digest))
        if level < top:
            run = open_runs[level - base]
            run.append(digest)
            if len(run) == FANOUT:
                open_runs[level - base] = []
                close(level + 1, index // FANOUT, H(*run))

    for i, digest in enumerate(digests):
        close(base, first + i, digest)
    if first + len(digests) == width(base, leaves):
        for level in range(base, top):
            if run := open_runs[level - base]:
                open_runs[level - base] = []
                close(level + 1, (width(level, leaves) - 1) // FANOUT, H(*run))
    return log


#: A proof as text: for each level `place:sibling,sibling,...`, from the leaf up, joined by `;`.
Proof = str


def path(log: dict[int, str], index: int, base: int, leaves: int, levels: int = BLOCK_LEVELS) -> list[str]:
    """The levels of a proof that lie within a block, siblings being looked up by position."""
    found = []
    for level in range(base, min(base + levels, height(leaves))):
        run = siblings(level, index, leaves)
        found.append(f"{index - run[0]}:{','.join(log[position(level, i, leaves)] for i in run if i != index)}")
        index //= FANOUT
    return found


def siblings_of(proof: Proof) -> str:
    """The siblings of a proof, concatenated from the leaf up, left to right."""
    return "".join(level.split(":")[1].replace(",", "") for level in proof.split(";")) if proof else ""


def fold(digest: str, proof: Proof) -> str:
    """The root that a leaf and its siblings give."""
    for level in proof.split(";") if proof else []:
        place, others = level.split(":")
        run = others.split(",") if others else []
        run.insert(int(place), digest)
        digest = H(*run)
    return digest


def _append(tier: int, levels: int):
    base = tier * levels

    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        tree, block = key
        items = items.sort_values("index")
        leaves = int(items["leaves"].iloc[0])
        log = append(items["digest"].tolist(), int(items["index"].iloc[0]), base, leaves, levels)
        found = pd.DataFrame(log, columns=["position", "level", "index", "digest"])
        top = min(base + levels, height(leaves))
        return found.assign(tree=tree, tier=tier, block=block, top=found["level"] == top, leaves=leaves)[
            ["tree", "tier", "block", "position", "level", "index", "digest", "top", "leaves"]
        ]

    return run


@dataclass(frozen=True)
class Log:
    """Tiers of a log of many trees: tiers[k] has the nodes of the levels that tier k appends, and the trees it is the
    last tier of have their roots among them. Columns: tree, tier, block, position, level, index, digest, top, leaves."""

    tiers: list[DataFrame]
    roots: DataFrame
    block_levels: int

    def rows(self) -> DataFrame:
        """The whole log: tree, position, level, index, digest; sorted by position a tree is in postorder."""
        found = self.tiers[0]
        for tier in self.tiers[1:]:
            found = found.unionByName(tier)
        return found.select("tree", "position", "level", "index", "digest")


def append_log(items: DataFrame, block_levels: int = BLOCK_LEVELS) -> Log:
    """The log of the trees over `items` (tree, index from 0, leaves: the number of items of the tree, digest)."""
    spark, size = items.sparkSession, FANOUT**block_levels
    tiers, roots = [], spark.createDataFrame([], "tree string, digest string")
    most = items.agg(F.max("leaves")).first()[0] or 0
    tier = 0
    while True:
        blocks = items.withColumn("block", F.floor(F.col("index") / size)).groupBy("tree", "block")
        log = checkpointed(blocks.applyInPandas(_append(tier, block_levels), _LOG))
        tiers.append(log)
        tops = log.filter("top").select("tree", F.col("block").alias("index"), "leaves", "digest")
        many = F.col("leaves") > size ** (tier + 1)
        roots = roots.unionByName(tops.filter(~many).select("tree", "digest"))
        tier += 1
        if most <= size**tier:
            return Log(tiers, roots, block_levels)
        items = tops.filter(many)


def _prove(tier: int, columns: list[str], levels: int):
    base = tier * levels

    def run(key: tuple, items: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        if items.empty:
            return items.assign(proof=pd.Series(dtype=str))[[*columns, "proof"]]
        leaves = int(items["leaves"].iloc[0])
        above = [p for p in log.loc[log["position"] < 0, "digest"] if p]
        nodes = log[log["position"] >= 0]
        known = dict(zip(nodes["position"].tolist(), nodes["digest"], strict=True))
        proofs = [";".join(path(known, int(i), base, leaves, levels) + above) for i in items["index"]]
        return items.assign(proof=proofs)[[*columns, "proof"]]

    return run


def prove(items: DataFrame, log: Log, above: DataFrame | None = None) -> DataFrame:
    """`items` (tree, index, leaves, any others) of the lowest tier with the column proof. `above` (tree, proof)
    is put behind the proof of every item of a tree."""
    size = FANOUT**log.block_levels
    waiting = above  # (tree, block, proof) of blocks of the tier at hand
    if waiting is not None:
        waiting = waiting.withColumn("block", F.lit(0).cast("long"))
    for tier in reversed(range(len(log.tiers))):
        nodes = log.tiers[tier].select("tree", "block", "position", "digest")
        if tier:
            # A block's own lowest level was appended by the tier below, as the tops of its blocks.
            below = log.tiers[tier - 1].filter(F.col("top") & (F.col("leaves") > size**tier))
            own = below.select("tree", F.col("block").alias("index"), "leaves", "position", "digest")
            own = own.withColumn("block", F.floor(F.col("index") / size))
            nodes = nodes.unionByName(own.select("tree", "block", "position", "digest"))
            asked = own.select("tree", "index", "leaves", "block")
        else:
            asked = items.withColumn("block", F.floor(F.col("index") / size))
        if waiting is not None:
            nodes = nodes.unionByName(waiting.select("tree", "block", F.lit(-1).cast("long").alias("position"), F.col("proof").alias("digest")))
        columns = [c for c in asked.columns if c != "block"]
        schema = ", ".join(f"`{n}` {t}" for n, t in asked.select(*columns).dtypes) + ", proof string"
        # Trees that end in a lower tier meet what lies above them there, as their only block.
        found = asked.groupBy("tree", "block").cogroup(nodes.groupBy("tree", "block")).applyInPandas(_prove(tier, columns, log.block_levels), schema)
        if not tier:
            return found
        found = checkpointed(found.select("tree", F.col("index").alias("block"), "proof"))
        ended = log.tiers[tier - 1].select("tree", "leaves").distinct().filter(F.col("leaves") <= size**tier)
        if above is not None:
            found = found.unionByName(above.join(ended, "tree").select("tree", F.lit(0).cast("long").alias("block"), "proof"))
        waiting = found
    raise ValueError("a log has at least one tier")


def _field(column: str) -> Column:
    value = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(text: Column | None = None) -> Column:
    """The digest of a row of documents; `text` in the place of its own."""
    own = _field("text")
    if text is not None:
        own = F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    fields = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*fields, own).cast("binary"), 256)


def tree_of(column: Column) -> Column:
    """A language as the name of its tree, in byte order with null first."""
    return F.coalesce(F.concat(F.lit("="), column), F.lit(""))


@dataclass(frozen=True)
class Manifest:
    """leaves: a row per document (doc_id, tree, index, leaves, leaf, tampered); log: nodes of the trees of languages;
    top: nodes of the tree over their roots; places: which leaf of it a language is."""

    leaves: DataFrame
    log: Log
    top: Log
    places: DataFrame


def build_manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> Manifest:
    """The trees over the rows of `docs` (doc_id, source, lang, n_chars, text; other columns are not read).

    A tree per language, null being one; leaves ascend by doc_id (null first), rows that share one by leaf digest.
    Equal rows are leaves of their own with equal digests. Texts are hashed where they are read, whole, and not moved.
    A document is tampered where 3 divides the crc32 of its doc_id (a null doc_id never): A-Z of its text
    become lower case. An empty table has no trees.
    """
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = checkpointed(
        docs.select(
            "doc_id",
            tree_of(F.col("lang")).alias("tree"),
            leaf_digest().alias("leaf"),
            F.when(altered, leaf_digest(lower_ascii(F.col("text")))).alias("tampered"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    placed = checkpointed(with_ordinal(leaves, ["tree"], ["doc_id", "leaf", "row"], "index", "leaves").drop("row"))
    log = append_log(placed.select("tree", "index", "leaves", F.col("leaf").alias("digest")), block_levels)
    whole = log.roots.select(F.lit("").alias("all"), F.col("tree").alias("lang_tree"), "digest")
    places = with_ordinal(checkpointed(whole), ["all"], ["lang_tree"], "index", "leaves")
    places = checkpointed(places.select(F.col("all").alias("tree"), "lang_tree", "index", "leaves", "digest"))
    return Manifest(placed, log, append_log(places.drop("lang_tree"), block_levels), places)


def _checked(batches):
    for batch in batches:
        changed = batch["tampered"].where(batch["tampered"].notna(), batch["leaf"])
        folded = [fold(leaf, proof) for leaf, proof in zip(changed, batch["proof"], strict=True)]
        hashed = [H(siblings_of(proof)) for proof in batch["proof"]]
        yield batch.assign(proof_sha256=hashed, folded_root=folded)[
            ["doc_id", "tree", "index", "leaf", "proof_sha256", "folded_root"]
        ]


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf with its proof up to the root: doc_id, tree, index, leaves, leaf, tampered, proof (text)."""
    up = prove(manifest.places.select("tree", "lang_tree", "index", "leaves"), manifest.top)
    above = checkpointed(up.select(F.col("lang_tree").alias("tree"), "proof"))
    return prove(manifest.leaves, manifest.log, above)


def verify_documents(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row of `docs`: its leaf, the roots, its proof's digest, and whether its tampered version verifies.

    Columns: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, leaf_index. What null, equal and long
    rows give is said at `build_manifest`; other columns of any name are not read.
    """
    manifest = build_manifest(docs, block_levels)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, tree string, index long, leaf string, proof_sha256 string, folded_root string"
    checked = proofs(manifest).mapInPandas(_checked, schema)
    root = manifest.top.roots.first()
    # Written as a table, whose size Spark knows, so that few languages are broadcast and many are not.
    known, _ = stored(manifest.log.roots.select(F.col("tree").alias("of__"), F.col("digest").alias("subroot")))
    top = F.lit(root["digest"] if root else None).cast("string")
    return checked.join(known, F.col("tree") == F.col("of__")).select(
        "doc_id",
        "leaf",
        "subroot",
        top.alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == top).alias("verified"),
        F.col("index").alias("leaf_index"),
    )
