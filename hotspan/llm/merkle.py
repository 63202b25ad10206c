"""Merkle manifest of a table: one hash tree per group of rows, their roots under one more tree.

The rows of a group stand in key order and are cut into aligned blocks. A block keeps each of its levels as one string
of concatenated hex digests; fixed-width substrings of it are the runs whose hashes make the next level. What is left of
a block is one digest, and the digests of all blocks are the leaves of the next round, so a tree of any size takes a few
rounds over quickly shrinking tables. The siblings of a node are the substrings left and right of it in its run.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.llm.mixing import running_totals
from hotspan.storage import write_once

ARITY = 3
#: Levels that a block goes through in one round; it holds ARITY ** LEVELS nodes.
LEVELS = 5
DIGEST = 64
PATH = "array<struct<left:string,right:string>>"


def hashed(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Digest of a row: every field as its number of bytes, a colon and its text, or ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    return hashed(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way up lead to."""
    return F.aggregate(path, leaf, lambda own, s: hashed(s["left"], own, s["right"]))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level and left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


@dataclass(frozen=True)
class Manifest:
    """``rows``: group, position, node (the leaf), the kept columns, path, subroot and root for every row of the table;
    ``subroots``: group, size, subroot; ``root``: one row with the root, none for an empty table."""

    rows: DataFrame
    subroots: DataFrame
    root: DataFrame


def manifest(rows: DataFrame, group: str, key: str, leaf: str, keep: Sequence[str] = (), levels: int = LEVELS) -> Manifest:
    """Hash trees over ``rows``: one for each ``group`` with its leaves ordered by ``key``, one over the groups in order.

    Nulls come first in both orders and are ordinary values. Rows equal in key are ordered by their leaf; rows equal in
    all columns are counted once and laid out again within their blocks, so a large group of copies is no large task.
    ``keep`` names columns to carry along. An empty table gives empty results. Other columns of ``rows`` are not read.
    """
    kept = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    counted = rows.select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(leaf).alias("node"), kept.alias("kept"))
    counted = counted.groupBy("group", "key", "node", "kept").agg(F.count(F.lit(1)).alias("copies"))
    placed = write_once(running_totals(counted, ["group"], ["key", "node"], "copies"))
    sizes = placed.groupBy("group").agg(F.sum("copies").alias("size"))
    rounds = _climb(_cut(placed, levels).select("group", "block", "lo", "copies", "node", "kept"), sizes, levels)
    tops = _tops(rounds, levels)

    ordered = running_totals(tops.withColumn("all", F.lit(0)), ["all"], ["group"], "one")
    nodes = write_once(ordered.select(F.lit(0).alias("group"), "before", F.lit(1).cast("long").alias("copies"), "node",
                                      F.struct(F.lit(0).alias("_"), F.col("group").alias("k0")).alias("kept")))
    upper = _climb(_cut(nodes, levels).select("group", "block", "lo", "copies", "node", "kept"),
                   nodes.groupBy("group").agg(F.sum("copies").alias("size")), levels)
    root = _tops(upper, levels).select(F.col("node").alias("root"))
    whole = _tops(upper, levels).select("group", F.array().cast(PATH).alias("upper"), F.struct(F.col("node").alias("root")).alias("ends"))
    groups = _descend(upper, whole, levels).select(
        F.col("kept.k0").alias("group"), F.col("path").alias("upper"),
        F.struct(F.col("node").alias("subroot"), F.col("ends.root").alias("root")).alias("ends"))
    leaves = _descend(rounds, write_once(groups), levels)
    return Manifest(
        leaves.select("group", "position", "node", *[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(keep)], "path",
                      "ends.subroot", "ends.root"),
        tops.select("group", "size", F.col("node").alias("subroot")), root)


def _cut(placed: DataFrame, levels: int) -> DataFrame:
    """Copies of a leaf, placed from ``before`` on, cut at the borders of the blocks."""
    width = ARITY ** levels
    blocks = F.expr(f"sequence(before div {width}, (before + copies - 1) div {width})")
    cut = placed.withColumn("block", F.explode(blocks)).withColumn("first", F.greatest("before", F.col("block") * width))
    last = F.least(F.col("before") + F.col("copies"), (F.col("block") + 1) * width)
    return cut.select("group", "block", (F.col("first") - F.col("block") * width).alias("lo"),
                      (last - F.col("first")).alias("copies"), "node", "kept")


def _runs(level: Column) -> Column:
    """The runs of siblings of a level string."""
    width = ARITY * DIGEST
    starts = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int"))
    return F.transform(starts, lambda i: F.substr(level, i * width + 1, F.lit(width)))


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """One row per block: its members, the runs of each level and the digest that is left. ``size`` is that of the tree."""
    grown = F.col("size") > ARITY ** levels
    table = nodes.groupBy("group", "size", "block").agg(
        F.array_sort(F.collect_list(F.struct("lo", "copies", "node", "kept"))).alias("members"))
    table = table.withColumn("level0", F.array_join(F.transform("members", lambda m: F.repeat(m["node"], m["copies"].cast("int"))), ""))
    for i in range(levels):
        level = F.col(f"level{i}")
        table = table.withColumn(f"runs{i}", F.when(grown | (F.length(level) > DIGEST), _runs(level)))
        table = table.withColumn(f"level{i + 1}", F.array_join(F.transform(f"runs{i}", lambda r: F.sha2(r, 256)), ""))
    top = F.coalesce(*[F.col(f"level{i}") for i in reversed(range(levels + 1))])
    return table.select("group", "size", "block", "members", *[f"runs{i}" for i in range(levels)], top.alias("top"))


def _climb(nodes: DataFrame, sizes: DataFrame, levels: int) -> list[DataFrame]:
    """The blocks of each round, until every tree fits one block."""
    width = ARITY ** levels
    sized = nodes.alias("n").join(sizes.alias("s"), F.col("n.group").eqNullSafe(F.col("s.group"))).select("n.*", "s.size")
    rounds = [write_once(_blocks(sized, levels))]
    while True:
        more = rounds[-1].where(F.col("size") > width)
        if more.isEmpty():
            return rounds
        nodes = more.select(
            "group", F.ceil(F.col("size") / width).cast("long").alias("size"), F.expr(f"block div {width}").alias("block"),
            (F.col("block") % width).alias("lo"), F.lit(1).cast("long").alias("copies"), F.col("top").alias("node"),
            F.struct(F.lit(0).alias("_")).alias("kept"))
        rounds.append(write_once(_blocks(nodes, levels)))


def _tops(rounds: list[DataFrame], levels: int) -> DataFrame:
    """(group, size, node, one): what each tree comes down to; ``size`` counts the leaves of its last round."""
    ends = [r.where(F.col("size") <= ARITY ** levels).select("group", F.col("top").alias("node"), F.lit(1).alias("one")) for r in rounds]
    found = ends[0]
    for more in ends[1:]:
        found = found.unionByName(more)
    first = rounds[0].groupBy("group").agg(F.first("size").alias("size"))
    return found.alias("t").join(first.alias("f"), F.col("t.group").eqNullSafe(F.col("f.group"))).select("t.*", "f.size")


def _path_in_block(place: Column, levels: int) -> Column:
    """Siblings of the node at a place of a block, up to the top of the block."""
    steps = []
    for i in range(levels):
        own = F.floor(place / ARITY ** i) % ARITY * DIGEST
        run = F.get(F.col(f"runs{i}"), F.floor(place / ARITY ** (i + 1)).cast("int"))
        sides = F.struct(F.substr(run, F.lit(1), own.cast("int")).alias("left"),
                         F.substr(run, (own + DIGEST + 1).cast("int"), F.lit(ARITY * DIGEST)).alias("right"))
        steps.append(F.when(F.col(f"runs{i}").isNotNull(), sides))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _descend(rounds: list[DataFrame], ends: DataFrame, levels: int) -> DataFrame:
    """(group, position, node, kept, path, ends) of every leaf, from the last round down to the first.

    ``ends`` holds for each group the path above its tree and what else to hand down.
    """
    width, found = ARITY ** levels, None
    for i, blocks in reversed(list(enumerate(rounds))):
        same = F.col("b.group").eqNullSafe(F.col("u.group"))
        headed = blocks.where(F.col("size") <= width).alias("b").join(ends.alias("u"), same).select("b.*", "u.upper", "u.ends")
        if found is not None:
            above = found.select("group", F.col("position").alias("block"), F.col("path").alias("upper"), "ends")
            headed = headed.unionByName(blocks.where(F.col("size") > width).alias("b").join(
                above.alias("u"), same & (F.col("b.block") == F.col("u.block"))).select("b.*", "u.upper", "u.ends"))

        def laid_out(m: Column) -> Column:
            return F.transform(F.sequence(m["lo"], m["lo"] + m["copies"] - 1), lambda place: F.struct(
                (F.col("block") * width + place).alias("position"), m["node"].alias("node"), m["kept"].alias("kept"),
                _path_in_block(place, levels).alias("path")))

        leaves = headed.select("group", "upper", "ends", F.explode(F.flatten(F.transform("members", laid_out))).alias("leaf"))
        found = leaves.select("group", "leaf.position", "leaf.node", "leaf.kept",
                              F.concat("leaf.path", "upper").alias("path"), "ends")
        if i:
            found = write_once(found)
    return found
