"""Merkle manifest of a table of documents, built by time-forward processing.

A leaf is the digest of one row's fields. Leaves of a group (a ``source``) ascend by key; while a
level holds more than one node, every ``arity`` consecutive nodes (the last run fewer, even one)
become the digest of their concatenated hex digests. The group's last node is its subroot; the
subroots, ordered by group, form the top tree the same way, and its last node is the root.

Time-forward processing: the tree is never walked node by node. Each level sends every node's
digest to the label of its parent, (group, index // arity); the shuffle sorted by that label is
the external priority queue, and a parent takes its few children in order and hashes them. The
reversed sweep goes from the root down: a node's proof suffix is its own run's siblings followed
by its parent's suffix, delivered by a join on the parent's label, so each leaf ends with its
whole proof, bottom-up. A proof is as long as the tree is deep (about log3 of the rows).

Places within a group come from one range partitioning by (group, key) and numbers inside each
partition; a group that holds a third of all rows spans a third of the partitions. No key of any
shuffle is coarser than a parent label, so nothing of a hot group meets in one task. Each level
is written to the shared folder, so a lost executor costs one level.

Nulls: a null field is ``-`` in its leaf; a null group is a group of its own, first in the top
tree; null keys ascend first. Repeated rows are leaves each, ordered by their digest after the key
(equal rows give equal leaves in either order). An empty table gives an empty result. Only the
named fields are read, so other columns, also of clashing names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import settle

#: Fields of a leaf, in this order (fixed by the manifest's format).
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
PROOF = "array<struct<left:binary,right:binary>>"
RESULTS = ("leaf", "subroot", "root", "proof", "folded_root", "verified")


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text (integers decimal)."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(values: dict[str, Column]) -> Column:
    return digest(*[field(values[name]) for name in FIELDS])


def _hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def proof_digest(proof: Column) -> Column:
    """sha256 of the siblings' hex digests, level by level from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: _hex(F.concat(s["left"], s["right"]))), "").cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and ``proof`` give: at each level, the digest of left siblings, node and right ones."""
    return F.aggregate(proof, leaf, lambda node, s: digest(_hex(s["left"]), node, _hex(s["right"])))


def _group_key(group: Column) -> Column:
    """Non-null key with the group's order: null first, then by UTF-8 bytes."""
    return F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group.cast("string")))


def ranked(nodes: DataFrame, order: list[str], parts: int) -> DataFrame:
    """``nodes`` (with a non-null ``g``) and ``idx``, their place in ``g`` by ``order``, gapless from 0, and ``n``, the size of ``g``.

    One range partitioning sorts all rows; numbers within a partition and counts per (partition,
    group), at most partitions + groups rows, give the places.
    """
    ordered = nodes.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order)
    ordered = settle(ordered.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    runs = ordered.groupBy("_p", "g").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_c"))
    runs = runs.select(
        "_p", "g", "_first",
        (F.sum("_c").over(Window.partitionBy("g").orderBy("_p")) - F.col("_c")).alias("_before"),
        F.sum("_c").over(Window.partitionBy("g")).alias("n"),
    )
    placed = ordered.join(runs, ["_p", "g"]).withColumn("idx", F.col("_before") + F.col("_i") - F.col("_first"))
    return placed.drop("_p", "_i", "_first", "_before")


def _levels_above(n: int, arity: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def _up(nodes: DataFrame, levels: int, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level (parent label, children in order) and every group's last node.

    ``nodes``: g, idx, h, n (nodes of g at this level). Returns per level a settled frame
    g, idx (parent), h (parent), n (parents of g), kids; and the subroots g, h, level.
    """
    runs, tops = [], []
    for level in range(levels):
        tops.append(nodes.where(F.col("n") == 1).select("g", "h", F.lit(level).alias("level")))
        kids = nodes.where(F.col("n") > 1).groupBy("g", F.floor(F.col("idx") / arity).alias("idx")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), F.col("h")))).alias("kids"),
            F.max("n").alias("below"),
        )
        run = settle(kids.select("g", "idx", digest(F.array_join("kids.h", "")).alias("h"), F.ceil(F.col("below") / arity).alias("n"), "kids"))
        runs.append(run)
        nodes = run.select("g", "idx", "h", "n")
    tops.append(nodes.select("g", "h", F.lit(levels).alias("level")))
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.unionByName(more)
    return runs, subroots


def _siblings(run: DataFrame) -> DataFrame:
    """Per child of a run: its label, its parent's index, and the digests left and right of it."""
    one = run.select("g", F.col("idx").alias("pidx"), "kids", F.posexplode("kids.h").alias("at", "h"))
    hexes = F.col("kids.h")
    return one.select(
        "g", "pidx", F.col("kids")[F.col("at")]["i"].alias("idx"),
        F.unhex(F.array_join(F.slice(hexes, 1, F.col("at")), "")).alias("left"),
        F.unhex(F.array_join(F.slice(hexes, F.col("at") + 2, F.size(hexes)), "")).alias("right"),
    )


def _down(runs: list[DataFrame], top: DataFrame) -> DataFrame:
    """Proof suffixes of the nodes of level 0 (g, idx, proof, subroot), from ``top``: per level, the
    suffixes, subroots included, of the nodes whose group ends there (g, level, proof, subroot)."""
    above = None
    for level in range(len(runs) - 1, -1, -1):
        ending = top.where(F.col("level") == level + 1).select("g", F.lit(0).cast("long").alias("pidx"), "proof", "subroot")
        parents = ending if above is None else above.select("g", F.col("idx").alias("pidx"), "proof", "subroot").unionByName(ending)
        step = _siblings(runs[level]).join(parents, ["g", "pidx"])
        own = F.array(F.struct(F.col("left"), F.col("right")))
        step = step.select("g", "idx", F.concat(own, F.col("proof")).alias("proof"), "subroot")
        above = settle(step) if level else step
    return above


def manifest(docs: DataFrame, altered: Column | None = None, *, arity: int = ARITY, parts: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, leaf, subroot, root, proof, folded_root, verified.

    ``docs`` must hold the FIELDS. ``proof`` lists, bottom-up, each level's siblings left and right
    of the node (binary digests). ``altered``, an expression of ``docs``' columns, is a text to
    check against the manifest: its leaf (the row's other fields kept) is folded with the original
    proof into ``folded_root``; ``verified`` says whether that equals the root. Without it, the
    original leaf is folded. An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = {name: docs[name] for name in FIELDS}
    check = leaf_digest({**values, "text": altered}) if altered is not None else leaf_digest(values)
    leaves = docs.select(
        _group_key(docs["source"]).alias("g"), docs["doc_id"].alias("doc_id"), docs["source"].alias("source"),
        leaf_digest(values).alias("h"), check.alias("checked"),
    )
    leaves = ranked(leaves, ["doc_id", "h"], parts)
    most = leaves.agg(F.max("n")).first()[0]
    if most is None:
        empty = "doc_id long, source string, leaf string, subroot string, root string, proof %s, folded_root string, verified boolean"
        return spark.createDataFrame([], empty % PROOF)
    levels = _levels_above(most, arity)
    runs, subroots = _up(leaves.select("g", "idx", "h", "n"), levels, arity)
    subroots = settle(subroots)

    # The top tree over the subroots, ordered by group, and its own reversed sweep.
    crowns = ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("source_g"), "h", "level"), ["source_g"], parts)
    count = crowns.agg(F.max("n")).first()[0]
    top_levels = _levels_above(count, arity)
    top_runs, top_end = _up(crowns.select("g", "idx", "h", "n"), top_levels, arity)
    root = top_end.first()["h"]
    if top_levels:
        start = top_end.select("g", F.lit(top_levels).alias("level"), F.array().cast(PROOF).alias("proof"), F.lit(root).alias("subroot"))
        at_top = _down(top_runs, start)
    else:
        at_top = crowns.select("g", "idx", F.array().cast(PROOF).alias("proof"))
    crowned = crowns.join(at_top.select("idx", "proof"), "idx").select(
        F.col("source_g").alias("g"), "level", "proof", F.col("h").alias("subroot")
    )
    crowned = settle(crowned)

    # The groups' own trees, from their subroots down to the leaves.
    if levels:
        below = _down(runs, crowned)
        deep = leaves.where(F.col("n") > 1).join(below, ["g", "idx"])
    else:
        deep = None
    lone = leaves.where(F.col("n") == 1).join(crowned.where(F.col("level") == 0).drop("level"), "g")
    result = lone if deep is None else deep.unionByName(lone)
    return result.select(
        "doc_id", "source", F.col("h").alias("leaf"), "subroot", F.lit(root).alias("root"), "proof",
        fold(F.col("checked"), F.col("proof")).alias("folded_root"),
        (fold(F.col("checked"), F.col("proof")) == F.lit(root)).alias("verified"),
    )
