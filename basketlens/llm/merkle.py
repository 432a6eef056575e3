"""A Merkle manifest of a table of documents: a digest per row, per source and of all, and a proof for every row.

Each source has a tree over its rows in the order of their ids; the sources' roots are the leaves of one more tree. A level
is made by a slot pivot: every parent's children are spread into ``FANOUT`` columns by conditional aggregates. All columns
concatenated hash to the parent; all but a child's own are its siblings. The pivots are kept, a table per level, and
read again from the top: a node's path is what stands left and right of it on every level. Rows meet the pivot of their
parents, so a path is carried once for up to ``FANOUT`` rows.

A source of any size is spread over its parents; positions come from one range shuffle of digests, texts are read once. The driver
keeps the number of levels and the root.

Null columns are hashed as ``-``. Rows with one id are ordered by their digest; equal rows have equal digests and both
stand in the tree. A null source is a source, before all others; null ids come first in theirs and are not tampered with. Empty and long texts are
hashed whole. An empty table has no rows. Extra columns are neither read nor hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import global_rank
from ..runtime import stage
from .storage import small_side

FANOUT = 16
#: The columns a leaf is made of, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Rows whose crc32 is divisible by this are tampered with in the report.
TAMPERED = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SLOTS = [f"s{k}" for k in range(FANOUT)]


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(text: Column) -> Column:
    """A row's digest, with ``text`` for its text."""
    values = [F.col(c).cast("string") for c in FIELDS if c != "text"] + [text]
    return digest(*(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, changed), stored: changed is the leaf of the tampered row, null for others."""
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    lowered = F.translate("text", _UPPER, _LOWER)
    table = docs.select(*FIELDS).select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(picked, leaf(lowered)).alias("changed"))
    return stage(table.withColumn("row", F.monotonically_increasing_id()), "leaves")


def placed(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves`` with (tree, index, total): the source's number, the place in it from 0 and its size; and the trees (tree, total)."""
    ranked = stage(global_rank(table, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")]), "ranked-leaves")
    sources = stage(ranked.groupBy("source").agg(F.min("rank").alias("start"), F.count("*").alias("total")), "sources")
    sources = stage(global_rank(sources, [F.col("source").asc_nulls_first()], "tree").withColumn("tree", F.col("tree") - 1), "numbered-sources")
    side = small_side(sources.withColumnRenamed("source", "of"))
    rows = ranked.join(side, F.col("source").eqNullSafe(F.col("of")))
    rows = rows.select("doc_id", "leaf", "changed", "tree", (F.col("rank") - F.col("start")).alias("index"), "total")
    return stage(rows, "placed-leaves"), sources.select("tree", "total")


def levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The pivots of all levels, lowest first, and the tops (tree, height, digest); ``nodes`` is (tree, index, total, digest).

    A pivot is (tree, parent, s0 ... s15), stored. A tree's height is the level on which it has one node.
    """
    pivots: list[DataFrame] = []
    tops = None
    while True:
        ended = nodes.where("total = 1").select("tree", F.lit(len(pivots)).alias("height"), "digest")
        tops = ended if tops is None else tops.union(ended)
        more = nodes.where("total > 1")
        if more.isEmpty():
            return pivots, stage(tops, "tree-tops")
        slot = F.pmod(F.col("index"), F.lit(FANOUT))
        spread = [F.max(F.when(slot == k, F.col("digest"))).alias(name) for k, name in enumerate(_SLOTS)]
        parents = more.groupBy("tree", F.floor(F.col("index") / FANOUT).alias("parent")).agg(F.max("total").alias("total"), *spread)
        parents = stage(parents, "slot-pivot")
        pivots.append(parents)
        above = F.ceil(F.col("total") / FANOUT).cast("bigint").alias("total")
        nodes = parents.select("tree", F.col("parent").alias("index"), above, F.sha2(F.concat_ws("", *_SLOTS).cast("binary"), 256).alias("digest"))


def paths(pivots: list[DataFrame], tops: DataFrame, level: int) -> DataFrame:
    """(tree, index, subroot, path) of all nodes on ``level``, of trees that reach it.

    ``tops`` has (tree, height, subroot, path): the path is an array of (left, right), from the node upwards, and that of a top
    leads on from there.
    """
    here = tops.where(F.col("height") == level).select("tree", F.lit(0).cast("bigint").alias("index"), "subroot", "path")
    if level >= len(pivots):
        return here
    above = paths(pivots, tops, level + 1).withColumnRenamed("index", "parent")
    joined = pivots[level].join(above, ["tree", "parent"])
    steps = [
        F.when(F.col(own).isNotNull(), F.struct(F.lit(k).alias("slot"), F.concat_ws("", *_SLOTS[:k]).alias("left"), F.concat_ws("", *_SLOTS[k + 1 :]).alias("right")))
        for k, own in enumerate(_SLOTS)
    ]
    children = joined.select("tree", "parent", "subroot", "path", F.explode(F.array_compact(F.array(*steps))).alias("step"))
    path = F.concat(F.array(F.struct("step.left", "step.right")), F.col("path")).alias("path")
    children = children.select("tree", (F.col("parent") * FANOUT + F.col("step.slot")).alias("index"), "subroot", path)
    return children.union(here)


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    rows, trees = placed(leaves(docs))
    pivots, tops = levels(rows.select("tree", "index", "total", F.col("leaf").alias("digest")))

    # The tree over the sources: one tree, its leaves the sources' roots.
    n_trees = trees.count()
    own = tops.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("index"), F.lit(n_trees).cast("bigint").alias("total"), "digest")
    upper, top = levels(own)
    root = top.first()
    if root is None:
        root = {"height": 0, "digest": None}
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    summit = top.select("tree", "height", F.col("digest").alias("subroot"), nothing.alias("path"))
    onward = paths(upper, summit, 0).select(F.col("index").alias("tree"), "path")
    tops = stage(tops.select("tree", "height", F.col("digest").alias("subroot")).join(onward, "tree"), "tree-paths")

    # Rows meet their siblings: (tree, parent) of the lowest pivot with the path from the parent on. A lone row has none.
    lone = tops.where("height = 0").select("tree", F.lit(0).cast("bigint").alias("parent"), *(F.lit(None).cast("string").alias(s) for s in _SLOTS), "subroot", "path")
    families = lone
    if pivots:
        above = paths(pivots, tops, 1).withColumnRenamed("index", "parent")
        families = lone.union(pivots[0].join(above, ["tree", "parent"]).select(*lone.columns))
    rows = rows.withColumns({"parent": F.floor(F.col("index") / FANOUT), "slot": F.pmod(F.col("index"), F.lit(FANOUT))})
    joined = rows.join(stage(families, "families"), ["tree", "parent"])
    given = F.coalesce("changed", "leaf")
    siblings = F.concat_ws("", *(F.when(F.col("slot") != k, F.col(s)) for k, s in enumerate(_SLOTS)))
    renewed = F.concat_ws("", *(F.when(F.col("slot") == k, given).otherwise(F.col(s)) for k, s in enumerate(_SLOTS)))
    proof = F.concat_ws("", siblings, F.concat_ws("", F.transform("path", lambda p: F.concat(p["left"], p["right"]))))
    start = F.when(F.col("total") == 1, given).otherwise(F.sha2(renewed.cast("binary"), 256))
    folded = F.aggregate("path", start, lambda acc, p: digest(p["left"], acc, p["right"]))
    known = F.lit(root["digest"]).cast("string")
    result = joined.select("doc_id", "leaf", "subroot", known.alias("root"), F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))
