"""Merkle manifest of a dataset by time-forward processing.

A node's label is (level, tree, number). Digests are messages to the parent's label: a
level's table is the queue's least labels, and one grouped pass takes those out and puts
the next level's messages in. When the roots are known the levels are swept in reverse:
every node hands its own proof to its children, which put their siblings in front.

Each source is a tree over its leaves; the trees' roots are the leaves of a tree over all.
Only digests move between tasks, never texts. A run of ``fanout`` children is the largest
group, whatever the source holds; rounds grow with the logarithm of the largest source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from arborstat.plans.selection import positions
from arborstat.session import cut_lineage, release

FANOUT = 16
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the joined parts, in lower-case hexadecimal."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself; null is ``-``."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["before"], acc, s["after"]))


def _step(children: Column, slot: Column) -> Column:
    """Siblings before and after ``slot``, joined."""

    def joined(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda c: c["digest"]), "")

    return F.struct(joined(F.slice(children, F.lit(1), slot)).alias("before"), joined(F.slice(children, slot + 2, F.size(children))).alias("after"))


def _gathered(messages: DataFrame, fanout: int, extra: list[str]) -> DataFrame:
    """The parents of (tree, n, at, digest): nodes (tree, n, at, children, digest); ``n`` is the number of nodes of the level in the tree.

    A tree of a single node has come to its end: it gets that node as its only child and keeps the digest.
    """
    size = F.lit(fanout).cast("bigint")
    up = messages.withColumn("slot", (F.col("at") % size).cast("int")).withColumn("at", (F.col("at") / size).cast("bigint"))
    child = F.struct("slot", "digest", *extra)
    nodes = up.groupBy("tree", "n", "at").agg(F.sort_array(F.collect_list(child)).alias("children"))
    own = digest(F.array_join(F.transform("children", lambda c: c["digest"]), ""))
    return nodes.withColumn("digest", F.when(F.col("n") == 1, F.col("children")[0]["digest"]).otherwise(own))


def _raised(leaves: DataFrame, most: int, fanout: int, extra: list[str]) -> list[DataFrame]:
    """Tables of nodes from the parents of the leaves (tree, n, at, digest, extra) up to the last root.

    ``last`` marks the roots: the only node of a level.
    """
    size = F.lit(fanout).cast("bigint")
    above = F.when(F.col("n") == 1, F.lit(1)).otherwise(((F.col("n") + size - 1) / size).cast("bigint"))
    levels = [cut_lineage(_gathered(leaves, fanout, extra).withColumn("m", above))]
    width = -(-most // fanout)
    while width > 1:
        rest = levels[-1].where("m > 1").select("tree", F.col("m").alias("n"), "at", "digest")
        levels.append(cut_lineage(_gathered(rest, fanout, []).withColumn("m", above)))
        width = -(-width // fanout)
    return levels


def _swept(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The first level's nodes with ``path``, their siblings up to the root over all; ``tops`` has (tree, path) of the trees' roots."""
    size = F.lit(fanout).cast("bigint")
    got = None
    for nodes in reversed(levels):
        found = nodes.where("m = 1").join(tops.select("tree", "path"), "tree")
        if got is not None:
            up = got.select("tree", F.col("at").alias("up"), F.col("children").alias("peers"), F.col("path").alias("upper"))
            under = nodes.where("m > 1").withColumn("up", (F.col("at") / size).cast("bigint")).join(up, ["tree", "up"])
            step = _step(F.col("peers"), (F.col("at") % size).cast("int"))
            found = found.unionByName(under.withColumn("path", F.concat(F.array(step), F.col("upper"))).select(*found.columns))
        got = found
    return got


def _handed(nodes: DataFrame) -> DataFrame:
    """The children of the first level's nodes, each with its own path."""
    by_slot = F.sequence(F.lit(0), F.size("children") - 1)
    each = F.transform(by_slot, lambda i: F.struct(F.element_at("children", i + 1).alias("child"), _step(F.col("children"), i).alias("step")))
    out = nodes.select("tree", "n", "path", F.explode(each).alias("e"))
    path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array("e.step"), F.col("path")))
    return out.select("tree", F.col("e.child").alias("child"), path.alias("path"))


@dataclass
class Manifest:
    """``leaves``: a row per row given, (doc_id, source, leaf, subroot, root, path, tampered); ``roots``: (source, n_leaves, subroot, root)."""

    leaves: DataFrame
    roots: DataFrame


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), source: str = "source", order: str = "doc_id",
    fanout: int = FANOUT, tampered: dict[str, Column] | None = None,
) -> Manifest:
    """Digests, subroots, root and proofs of all rows of ``docs``.

    A leaf is the digest of ``fields``. The leaves of a source ascend by ``order`` (null
    first), equal ones by their digests, so repeated rows are leaves each. ``path`` has for
    every level the joined digests of the siblings before and after; a lone node's are
    empty, and a source of one row has no level of its own. Rows with null source are a
    source like any other, the first one. ``tampered`` replaces fields: ``tampered`` is
    then the leaf of the changed row, null where it is the same. Columns that are no field
    are not read, whatever they are called. An empty table gives empty ones.
    """
    values = {c: F.col(c) for c in fields}
    leaf = leaf_digest(*values.values())
    other = leaf_digest(*(values | (tampered or {})).values()) if tampered else F.lit(None).cast("string")
    changed = F.lit(False)
    for c, v in (tampered or {}).items():
        changed = changed | ~v.eqNullSafe(F.col(c))
    rows = docs.select(F.col(order).alias("id"), F.col(source).cast("string").alias("source"), leaf.alias("leaf"), F.when(changed, other).alias("tampered"))
    rows = cut_lineage(rows)
    placed = positions(rows, ["source", "id", "leaf"], "place")
    trees = cut_lineage(placed.groupBy("source").agg(F.min("place").alias("tree"), F.count("*").alias("n")))
    sizes = trees.agg(F.max("n").alias("most"), F.count("*").alias("trees")).first()
    named = trees.withColumnRenamed("source", "of")
    leaves = placed.join(named, F.col("source").eqNullSafe(F.col("of"))).select("tree", "n", (F.col("place") - F.col("tree")).alias("at"), F.col("leaf").alias("digest"), "id", "tampered")
    low = _raised(leaves, sizes["most"] or 0, fanout, ["id", "tampered"])

    subroots = None
    for nodes in low:
        ended = nodes.where("m = 1").select(F.col("tree").alias("of"), "digest")
        subroots = ended if subroots is None else subroots.unionByName(ended)
    # Trees are named by the place of their first leaf, so they ascend as their sources do.
    tops = positions(subroots, ["of"], "at")
    whole = {"tree": F.lit(0).cast("bigint"), "n": F.lit(sizes["trees"]).cast("bigint")}
    high = _raised(tops.withColumns(whole), sizes["trees"], fanout, ["of"])
    root = high[-1].where("m = 1").select("tree", F.col("digest").alias("root"))
    swept = _handed(_swept(high, root.select("tree", F.array().cast(_PATH).alias("path")), fanout)).join(root, "tree")
    known = cut_lineage(swept.select(F.col("child.of").alias("tree"), F.col("child.digest").alias("subroot"), "path", "root"))
    release(*high)

    found = _handed(_swept(low, known, fanout)).join(trees.select("tree", "source"), "tree").join(known.select("tree", "subroot", "root"), "tree")
    out = found.select(F.col("child.id").alias(order), "source", F.col("child.digest").alias("leaf"), "subroot", "root", "path", F.col("child.tampered").alias("tampered"))
    return Manifest(out, trees.join(known, "tree").select("source", F.col("n").alias("n_leaves"), "subroot", "root"))


def verify(leaves: DataFrame) -> DataFrame:
    """``leaves`` of a manifest with folded_root (from the tampered leaf where there is one, and the original siblings) and verified."""
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return leaves.withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))
