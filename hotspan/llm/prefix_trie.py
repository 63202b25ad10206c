"""Prefix trie of conversations with subtree totals, rolled up in depth bands.

A node is a distinct sequence of first turns. Totals of a subtree are gathered in two moves: nodes first explode to their
ancestors within the same band of depths only, then the completed total of every band root goes to its ancestors in the
band above. The band roots form a tree that is lower by the height of a band, and their totals are made in the same way,
so that conversations of any depth take a logarithmic number of rounds and no node explodes to more than a band of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.llm.mixing import running_totals, word_count
from hotspan.storage import write_measured, write_once

HEIGHT = 16
#: The parents that hold more than this share of all nodes as children are broadcast; there are fewer than 1 / share.
HOT_SHARE = 0.001
LANES = 4


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_hash, words): turns by number from 0 on, nulls first; equal numbers go by role and text.

    Null roles and texts become empty. Rows without conv_id belong to no conversation and are left out. Repeated rows are
    turns of their own. Texts stay where they are: only their digests travel.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn_hash = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_hash.alias("turn_hash"), word_count(text).alias("words"))
    counted = rows.groupBy("conv_id", "turn", "turn_hash", "words").agg(F.count(F.lit(1)).alias("copies"))
    placed = running_totals(counted, ["conv_id"], ["turn", "turn_hash"], "copies")
    return placed.select("conv_id", F.explode(F.expr("sequence(before, before + copies - 1)")).alias("place"), "turn_hash", "words")


def rebuilt(turns: DataFrame, base: Column, borrowed: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with the first ``borrowed`` (at most ``most``) turns of the conversation ``base`` and go on
    with their own turns after so many: the turns (conv_id, depth, turn_hash, words) with depth from 1 on, and
    (conv_id, length). Both columns are expressions over conv_id.
    """
    heads = turns.where(F.col("place") < most).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("place", "turn_hash", "words"))).alias("head"))
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumn("base", base).withColumn("borrowed", borrowed)
    plans = write_once(sizes.join(heads, "base", "left").select(
        "conv_id", "own", "borrowed",
        F.when(F.col("borrowed") > 0, F.slice(F.coalesce("head", F.array()), F.lit(1), F.greatest("borrowed", F.lit(1)))).otherwise(
            F.array()).alias("head")))
    taken = F.size("head")
    lent = plans.select("conv_id", F.explode("head").alias("t")).select(
        "conv_id", (F.col("t.place") + 1).alias("depth"), "t.turn_hash", "t.words")
    # Only where the lender is too short do own turns move up.
    short = plans.where(taken < F.col("borrowed")).select("conv_id", (F.col("borrowed") - taken).cast("long").alias("missing"))
    own = turns.where(F.col("place") >= borrowed).join(short, "conv_id", "left").select(
        "conv_id", (F.col("place") + 1 - F.coalesce("missing", F.lit(0))).alias("depth"), "turn_hash", "words")
    length = (taken + F.greatest(F.lit(0), F.col("own") - F.col("borrowed"))).cast("long")
    return write_once(lent.unionByName(own)), plans.select("conv_id", length.alias("length"))


def _keyed(turns: DataFrame, height: int) -> DataFrame:
    """(conv_id, at, key, parent, turn_hash, words) for every turn, the root not included.

    The key of a node is the sum, lane by lane, of hashes of its turns with their depths, so that it is made of sums over
    bands and of sums over earlier bands. Nodes are compared turn by turn with their members afterwards.
    """
    def lane(t: Column, i: int) -> Column:
        wide = F.xxhash64(F.lit(i // 2), t["depth"], t["turn_hash"])
        return F.shiftrightunsigned(wide, 32) if i % 2 else wide.bitwiseAND(F.lit(0xFFFFFFFF))

    bands = turns.groupBy("conv_id", F.expr(f"(depth - 1) div {height}").alias("band")).agg(
        F.array_sort(F.collect_list(F.struct("depth", "turn_hash", "words"))).alias("turns"))
    bands = write_once(bands.withColumn("lanes", F.transform("turns", lambda t: F.array(*[lane(t, i) for i in range(LANES)]))))

    def total(i: int) -> Column:
        return F.aggregate("lanes", F.lit(0).cast("long"), lambda s, x: s + x[i])

    long = bands.where(F.col("band") > 0).select("conv_id").distinct()
    sums = bands.join(long, "conv_id", "left_semi").select("conv_id", "band", *[total(i).alias(f"s{i}") for i in range(LANES)])
    for i in range(LANES):
        sums = running_totals(sums, ["conv_id"], ["band"], f"s{i}").withColumnRenamed("before", f"b{i}").drop(f"s{i}")
    offsets = sums.where(F.col("band") > 0).select("conv_id", "band", F.array(*[f"b{i}" for i in range(LANES)]).alias("offset"))
    start = F.array(*[F.lit(0).cast("long")] * LANES)
    joined = bands.join(offsets, ["conv_id", "band"], "left").withColumn("offset", F.coalesce("offset", start))
    # Running sums inside the band: the list of keys, the one before the band first.
    keys = F.aggregate("lanes", F.array("offset"), lambda found, x: F.concat(found, F.array(
        F.zip_with(F.element_at(found, -1), x, lambda a, b: a + b))))
    rows = joined.withColumn("keys", F.transform(keys, lambda k: F.struct(*[k[i].alias(f"k{i}") for i in range(LANES)])))
    out = rows.select("conv_id", "keys", F.posexplode("turns").alias("i", "t"))
    return out.select("conv_id", F.col("t.depth").alias("at"), F.get("keys", F.col("i") + 1).alias("key"),
                      F.get("keys", F.col("i")).alias("parent"), "t.turn_hash", "t.words")


def _roots(lengths: DataFrame) -> DataFrame:
    key = F.struct(*[F.lit(0).cast("long").alias(f"k{i}") for i in range(LANES)])
    return lengths.select("conv_id", F.lit(0).cast("long").alias("at"), key.alias("key"))


def rolled_up(paths: DataFrame, values: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Subtree totals (at, key, leaves, saved) of a forest.

    ``paths`` holds (conv_id, at, key): the node of every conversation at each depth from 0 on without gaps; ``values``
    holds every node's own (at, key, leaves, saved).
    """
    band = F.expr(f"at div {height}")
    # A band root closes the band above as well: that is where its total goes.
    seats = F.when((F.col("at") > 0) & (F.col("at") % height == 0), F.array(band - 1, band)).otherwise(F.array(band))
    grouped = paths.select("conv_id", "at", "key", F.explode(seats).alias("band")).groupBy("conv_id", "band").agg(
        F.array_sort(F.collect_list(F.struct("at", "key"))).alias("nodes"))
    below = F.transform("nodes", lambda n: F.struct(
        n["at"].alias("at"), n["key"].alias("key"), F.filter("nodes", lambda a: a["at"] <= n["at"]).alias("above")))
    exploded = grouped.select("band", F.explode(below).alias("n")).select("band", "n.at", "n.key", "n.above")
    links, deepest = write_measured(exploded.groupBy("band", "at", "key").agg(F.first("above").alias("above")), F.max("at"))

    def gathered(part: DataFrame, amounts: DataFrame) -> DataFrame:
        up = part.join(amounts, ["at", "key"]).select(F.explode("above").alias("a"), "leaves", "saved")
        return up.groupBy(F.col("a.at").alias("at"), F.col("a.key").alias("key")).agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    inside = gathered(links.where(F.col("band") == band), values)
    if deepest < height:
        return inside
    inside = write_once(inside)
    lower = F.col("at") % height == 0
    step = F.expr(f"at div {height}").alias("at")
    roots = rolled_up(write_once(paths.where(lower).select("conv_id", step, "key")),
                      inside.where(lower).select(step, "key", "leaves", "saved"), height)
    roots = write_once(roots.select((F.col("at") * height).alias("at"), "key", "leaves", "saved"))
    closing = links.where(F.col("band") != band).withColumn("above", F.filter("above", lambda a: a["at"] < F.col("at")))
    return inside.unionByName(gathered(closing, roots)).groupBy("at", "key").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def id_digests(ends: DataFrame) -> DataFrame:
    """(at, key, ends_sha256) from (at, key, conv_id): SHA-256 of the ascending ids of each node, joined by commas.

    The ids are range-sorted, so those of a node that ends many conversations come from many tasks as joined pieces. The
    hash itself has to run through the pieces in order; it does so in one task that keeps a single state.
    """
    flat = ends.select("at", *[F.col(f"key.k{i}").alias(f"k{i}") for i in range(LANES)], "conv_id")
    node = ["at", *[f"k{i}" for i in range(LANES)]]
    ordered = flat.repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id")
    schema = ", ".join(f"{c} long" for c in node)
    pieces = ordered.mapInArrow(_pieces, f"{schema}, first long, ids string")
    hashes = pieces.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(_hashes, f"{schema}, ends_sha256 string")
    return hashes.select("at", F.struct(*[f"k{i}" for i in range(LANES)]).alias("key"), "ends_sha256")


def _spans(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """(node, start, end) of every stretch of rows with the same node in a sorted batch."""
    columns = [batch.column(i).to_numpy() for i in range(1 + LANES)]
    n, start = batch.num_rows, 0
    if n == 0:
        return
    changes = sum((c[1:] != c[:-1] for c in columns), start=columns[0][1:] != columns[0][:-1]).nonzero()[0] + 1
    for end in [*changes.tolist(), n]:
        yield tuple(int(c[start]) for c in columns), start, end
        start = end


def _table(rows: list[tuple], names: list[str], last: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, last if i == len(names) - 1 else pa.int64()) for i, c in enumerate(columns)], names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["at", *[f"k{i}" for i in range(LANES)], "first", "ids"]
    for batch in batches:
        ids = batch.column(1 + LANES)
        texts = pc.cast(ids, pa.string()).to_pylist()
        yield _table([(*node, ids[a].as_py(), ",".join(texts[a:b])) for node, a, b in _spans(batch)], names, pa.string())


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["at", *[f"k{i}" for i in range(LANES)], "ends_sha256"]
    current, state = None, hashlib.sha256()
    for batch in batches:
        done, ids = [], batch.column(2 + LANES)
        for node, a, b in _spans(batch):
            for i in range(a, b):
                if node != current:
                    if current is not None:
                        done.append((*current, state.hexdigest()))
                    current, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids[i].as_py().encode())
        yield _table(done, names, pa.string())
    if current is not None:
        yield _table([(*current, state.hexdigest())], names, pa.string())


def prefix_trie(turns: DataFrame, lengths: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Every node of the trie of conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``turns`` holds (conv_id, depth, turn_hash, words) with depths from 1 on without gaps, ``lengths`` (conv_id, length) of
    all conversations, those without turns included. Without conversations there is no node.
    """
    keyed = write_once(_keyed(turns, height))
    roots = _roots(lengths)
    members = keyed.unionByName(
        roots.withColumns({"parent": F.lit(None).cast(keyed.schema["parent"].dataType),
                           "turn_hash": F.lit(None).cast("binary"), "words": F.lit(0).cast("long")}))
    alike = ((F.min("turn_hash").eqNullSafe(F.max("turn_hash"))) & (F.min("parent").eqNullSafe(F.max("parent"))))
    nodes = members.groupBy("at", "key").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("parent").alias("parent"),
        F.max("words").alias("words"), alike.alias("alike"))
    # Two sequences under one key would differ in their last turns or in the nodes above them.
    checked = F.when(F.col("alike"), F.col("n_convs")).otherwise(F.raise_error(F.lit("two sequences of turns share a key")).cast("long"))
    children = keyed.select((F.col("at") - 1).alias("at"), F.col("parent").alias("key"), F.col("key").alias("child")).distinct()
    children = children.groupBy("at", "key").agg(F.count(F.lit(1)).alias("n_children"))
    nodes = write_once(nodes.withColumn("n_convs", checked).drop("alike").join(children, ["at", "key"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0)).cast("long")))

    values = nodes.select("at", "key", (F.col("n_children") == 0).cast("long").alias("leaves"),
                          ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = rolled_up(keyed.select("conv_id", "at", "key").unionByName(roots), values, height)
    ends = lengths.withColumnRenamed("length", "at").join(keyed.select("conv_id", "at", "key").unionByName(roots), ["conv_id", "at"])
    digests = id_digests(ends)
    full = nodes.join(totals, ["at", "key"]).join(digests, ["at", "key"], "left")

    count = nodes.select(F.count(F.lit(1))).scalar()
    up = nodes.where("n_children > 0").select(F.col("at").alias("up"), F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = F.col("n_children") > count * F.lit(HOT_SHARE)
    found = full.withColumn("up", F.col("at") - 1).join(
        F.broadcast(up.where(many).select("up", "parent", F.col("parent_conv_id").alias("hot"))), ["up", "parent"], "left")
    far = found.where(F.col("hot").isNull()).join(up.where(~many).drop("n_children"), ["up", "parent"], "left")
    near = found.where(F.col("hot").isNotNull()).withColumn("parent_conv_id", F.col("hot"))
    return far.unionByName(near).select(
        "conv_id", F.col("at").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
