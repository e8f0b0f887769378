"""Merkle manifest of a table: a root, and for each row the siblings that prove it.

A row's leaf is the digest of its columns.  The leaves of a group (a language,
say) ascend by a key; runs of `arity` of them become one node, runs of these
one above it, until one is left, the group's subroot.  The subroots, ordered by
group, make the root in the same way.

Each level is one equijoin of its nodes with themselves: a node names the
indices of its run (its own with the last bit turned for a binary tree, its
own shifted by each slot otherwise) and meets the nodes that have them.  The
nodes at slot zero then hold their whole run and emit the parents.  Proofs go
down the same levels: a node's path is its siblings and its parent's path.

No task holds a group: rows get their places from a sort by ranges and the
number of rows in the ranges before, and a run is `arity` rows.  Texts are read
once; what is shuffled is digests of 32 bytes and places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, keep

ARITY = 8


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf_of(values: list[Column]) -> Column:
    """Digest of a row: `-` for each null value, else its UTF-8 byte count, a colon and the value as text, end to end."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hexadecimal) and the siblings of a path give."""
    return F.aggregate(path, leaf, lambda d, run: F.sha2(F.concat(as_hex(run["left"]), d, as_hex(run["right"])), 256))


def siblings(path: Column) -> Column:
    """All digests of a path in hexadecimal, end to end: level by level, left to right."""
    return F.array_join(F.transform(path, lambda run: as_hex(F.concat(run["left"], run["right"]))), "")


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows with at, their place in their group by order from 0, and many, the rows of the group.

    The sorted rows are stored, so that places stay as they are whatever
    happens to executors.  A place is the row's number in its range less that of
    the group's first row there, and the group's rows in the ranges before.
    """
    ordered = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    stored = keep(ordered.withColumn("_row", F.monotonically_increasing_id()), name).withColumn("_range", F.shiftright("_row", 33))
    ranges = stored.groupBy(*(F.col(g).alias(f"_{g}") for g in group), F.col("_range").alias("_of")).agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    # one row a group and range: a window without a group has one row a range
    whole = Window.partitionBy(*(f"_{g}" for g in group))
    before = F.sum("_rows").over(whole.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumns({"many": F.sum("_rows").over(whole), "_before": F.coalesce(before, F.lit(0))}).drop("_rows")
    same = F.col("_range") == F.col("_of")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    out = stored.join(ranges, same).withColumn("at", F.col("_row") - F.col("_first") + F.col("_before"))
    return out.drop("_row", "_range", "_of", "_first", "_before", *(f"_{g}" for g in group))


def families(nodes: DataFrame, arity: int) -> DataFrame:
    """Each node with the digests left and right of it in its run, end to end."""
    slot, at = F.col("at") % arity, F.col("at")
    run = F.array(at, at.bitwiseXOR(F.lit(1).cast("long"))) if arity == 2 else F.array(*(at - slot + (slot + shift) % arity for shift in range(arity)))
    asked = nodes.select("tree", "at", "many", F.explode(run).alias("_in")).where(F.col("_in") < F.col("many"))
    met = asked.join(nodes.select("tree", F.col("at").alias("_in"), "digest"), ["tree", "_in"])
    met = met.groupBy("tree", "at", "many").agg(F.sort_array(F.collect_list(F.struct("_in", "digest"))).alias("_run"))
    joined = lambda keep_: F.aggregate(F.filter("_run", keep_), F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
    return met.select(
        "tree",
        "at",
        "many",
        F.element_at(F.filter("_run", lambda x: x["_in"] == at), 1)["digest"].alias("digest"),
        joined(lambda x: x["_in"] < at).alias("left"),
        joined(lambda x: x["_in"] > at).alias("right"),
    )


def parents(family: DataFrame, arity: int) -> DataFrame:
    """The nodes above: one for each row at slot zero, which has its whole run."""
    up = lambda c: F.floor((F.col(c) + (arity - 1 if c == "many" else 0)) / arity).cast("long").alias(c)
    return family.where(F.col("at") % arity == 0).select("tree", up("at"), up("many"), digest(F.concat(as_hex(F.col("digest")), as_hex(F.col("right")))).alias("digest"))


def grow(nodes: DataFrame, most: int, arity: int) -> tuple[DataFrame, list[DataFrame]]:
    """The last node of each tree with its level, and the families of all levels; the largest tree has `most` leaves."""
    levels, tops = [], []
    while True:
        tops.append(nodes.where("many = 1").select("tree", "digest", F.lit(len(levels)).alias("level")))
        if most <= 1:
            break
        levels.append(keep(families(nodes.where("many > 1"), arity), "families"))
        nodes = parents(levels[-1], arity)
        most = -(-most // arity)
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out, levels


def descend(tops: DataFrame, levels: list[DataFrame], arity: int) -> DataFrame:
    """For each leaf (tree, at) what its top has, and its path: the siblings of all levels below before those of the top's own."""
    paths = None
    for k in range(len(levels), -1, -1):
        here = tops.where(F.col("level") == k).drop("level").withColumn("at", F.lit(0).cast("long"))
        paths = here if paths is None else paths.unionByName(here)
        if k:
            above = paths.withColumnRenamed("at", "_up")
            below = levels[k - 1].select("tree", "at", F.floor(F.col("at") / arity).cast("long").alias("_up"), F.struct("left", "right").alias("_run"))
            paths = below.join(above, ["tree", "_up"]).withColumn("path", F.concat(F.array("_run"), F.col("path"))).drop("_up", "_run")
    return paths


def merkle_manifest(
    docs: DataFrame, columns: list[str], group: str = "lang", key: str = "doc_id", arity: int = ARITY, others: dict[str, Column] | None = None
) -> DataFrame:
    """Per row its key and group, leaf, subroot and root (hexadecimal), its path, and `others` computed from its columns.

    A path is an array of (left, right), from the leaf's run to the root's: the
    binary digests before and after the node in its run, end to end.  Nulls are
    values: a null group is a group and comes first, a null key comes first,
    a null column is hashed as such.  Rows of one key are ordered by their
    leaves; equal rows are leaves of their own.  An only row is its group's
    subroot, an only subroot is the root, and then paths are empty arrays.  An
    empty table gives an empty manifest.  Columns of any other name may be there.
    """
    if arity < 2:
        raise ValueError("a node has two children or more")
    of = lambda c: docs[f"`{c}`"]
    leaves = docs.select(of(key).alias("key"), of(group).alias("group"), leaf_of([of(c) for c in columns]).alias("digest"), F.struct(F.lit(0), *(v.alias(n) for n, v in (others or {}).items())).alias("others"))
    stored = keep(leaves, "leaves")
    rows = numbered(stored, ["group"], ["key", "digest"], "rows")
    groups = numbered(rows.groupBy("group").agg(F.first("many").alias("leaves")), [], ["group"], "groups").withColumnsRenamed({"at": "tree", "many": "trees"})
    most, trees = groups.agg(F.coalesce(F.max("leaves"), F.lit(0)), F.coalesce(F.max("trees"), F.lit(0))).first()
    named = groups.select(F.col("group").alias("_group"), "tree")
    rows = rows.join(named, F.col("group").eqNullSafe(F.col("_group"))).drop("_group")
    rows = keep(rows, "places")
    discard(stored)

    subroots, lower = grow(rows.select("tree", "at", "many", "digest"), most, arity)
    subroots = keep(subroots, "subroots")
    above = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(trees).cast("long").alias("many"), "digest")
    root, upper = grow(above, trees, arity)
    empty = F.array().cast("array<struct<left: binary, right: binary>>")
    proofs = descend(root.select("tree", "level", F.col("digest").alias("root"), empty.alias("path")), upper, arity)
    tops = subroots.withColumnRenamed("digest", "subroot").join(proofs.select(F.col("at").alias("tree"), "root", "path"), "tree")
    paths = descend(keep(tops, "tops"), lower, arity)
    out = rows.join(paths, ["tree", "at"])
    return out.select(
        F.col("key").alias(key), F.col("group").alias(group), *(as_hex(F.col(c)).alias(n) for c, n in (("digest", "leaf"), ("subroot", "subroot"), ("root", "root"))), "path", *(F.col("others")[n].alias(n) for n in others or {})
    )


#: Columns of a document that its leaf covers, in this order.
COVERED = ["doc_id", "source", "lang", "n_chars", "text"]
#: The letters that tampering makes small.
LARGE, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def tampered_leaf(docs: DataFrame) -> Column:
    """The leaf of a row whose text had its letters A-Z made small, for a third of the rows; NULL for the others."""
    values = [F.translate(docs[c], LARGE, SMALL) if c == "text" else docs[c] for c in COVERED]
    return F.when(tampered(docs["doc_id"]), as_hex(leaf_of(values)))


def manifest_digest(found: DataFrame) -> DataFrame:
    """The manifest with digests of the proofs, and what the tampered leaves (column tampered) fold to."""
    out = found.withColumns({"proof_sha256": F.sha2(siblings(F.col("path")), 256), "folded_root": folded(F.coalesce("tampered", "leaf"), F.col("path"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
