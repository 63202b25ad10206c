"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.storage import write_measured, write_once

# Doublings of the path each node follows within a round.
DOUBLINGS = 2
# Rounds that may pass while the edge table does not get smaller. Every round with an edge removes one, so this never
# happens; it guards against a defect that would loop for ever.
STALLED = 3


def _scatter(node: Column) -> Column:
    """One-to-one mixing of 64-bit ids, so that neighbours in id order are not neighbours in rank order.

    Each half is combined with a hash of the other one, which can be undone and therefore never merges two ids.
    """
    half = F.lit(0xFFFFFFFF)
    low, high = node.bitwiseAND(half), F.shiftrightunsigned(node, 32)
    first = high.bitwiseXOR(F.xxhash64(low).bitwiseAND(half))
    second = low.bitwiseXOR(F.xxhash64(first).bitwiseAND(half))
    return F.shiftleft(first, 32).bitwiseOR(second)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v); a component is named by its smallest node.

    Each round every node moves to its lowest-ranked neighbour and follows the moves found there a few times; then the
    edges are rewritten between the places reached, and every node's place moves along. Any such move keeps a component
    connected, and with scattered ranks it removes most of the nodes, so the number of rounds grows with the logarithm
    of the graph and the edge table shrinks geometrically. Every step is written and read back, so that no plan has more
    than two joins however many rounds there are; joins at hubs are left to adaptive execution. The edge table is read twice.
    """
    ends = edges.where(F.col("u") != F.col("v"))
    nodes = ends.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    place = write_once(nodes.select("node", _scatter(F.col("node")).alias("at")))
    links, size = write_measured(_ordered(ends.select(_scatter(F.col("u")).alias("low"), _scatter(F.col("v")).alias("high"))))
    stalled = 0
    while size > 0:
        hop = write_once(links.groupBy(F.col("high").alias("rank")).agg(F.min("low").alias("to")))
        for _ in range(DOUBLINGS):
            hop = write_once(_moved(hop, "to", hop))
        place = write_once(_moved(place, "at", hop))
        links, left = write_measured(_ordered(_moved(_moved(links, "low", hop), "high", hop)))
        stalled = stalled + 1 if left >= size else 0
        if stalled == STALLED:
            raise RuntimeError("components do not settle")
        size = left
    names = place.groupBy("at").agg(F.min("node").alias("component"))
    return place.join(names, "at").select("node", "component")


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links with the lower rank first, loops dropped."""
    return links.where(F.col("low") != F.col("high")).select(
        F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).distinct()


def _moved(table: DataFrame, column: str, hop: DataFrame) -> DataFrame:
    """Replace a column by where its node moves; a node without a move stays."""
    target = hop.select(F.col("rank").alias(column), F.col("to").alias("_moved"))
    others = [c for c in table.columns if c != column]
    return table.join(target, column, "left").select(*others, F.coalesce("_moved", column).alias(column))
