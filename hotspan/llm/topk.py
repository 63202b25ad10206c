"""Exact top-k search: tiled matrix products of queries and shards, partial selection per tile, tree merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.storage import write_once

# Vectors in a shard, queries in a block, blocks meeting a shard in one task, lists merged at a time.
SHARD, BLOCK, TOGETHER, FAN_IN = 16384, 1024, 8, 8

PACKED = "shard bigint, dim int, ids binary, vectors binary"


def scaled(vector: Column, factor: int = 64) -> Column:
    """Whole numbers floor(factor * x) of a vector, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("bigint"))


def whole(vector: Column) -> Column:
    """True for a vector without null or non-finite components."""
    def bad(x: Column) -> Column:
        d = x.cast("double")
        return x.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for all vectors of a shard and length: ids and components, ordered by id."""
    rows = rows.sort_values("id", kind="stable")
    ids, vectors = rows["id"].to_numpy(np.int64), np.array(rows["v"].tolist(), np.int64)
    return pd.DataFrame({"shard": rows["shard"].iloc[:1], "dim": rows["dim"].iloc[:1],
                         "ids": [ids.tobytes()], "vectors": [vectors.tobytes()]})


def _read(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, np.int64)
    return ids, np.frombuffer(row.vectors, np.int64).reshape(len(ids), row.dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of two matrices' rows, through floating point wherever that is exact."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    for kind, most in ((np.float32, 2 ** 24), (np.float64, 2 ** 53)):
        if bound < most:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return a @ b.T


def tile_top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> list[tuple]:
    """The best k of one shard for each query, own id left out; equal scores go to the smaller id (``ids`` ascends)."""
    score, out = products(q, v), []
    for row, own in zip(score, q_ids):
        keep = np.arange(len(ids))
        first, last = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
        if last > first:
            keep = np.concatenate([keep[:first], keep[last:]])
        if len(keep) > k:
            own_scores = row[keep]
            least = np.partition(own_scores, len(keep) - k)[len(keep) - k]
            above, equal = keep[own_scores > least], keep[own_scores == least]
            keep = np.concatenate([above, equal[:k - len(above)]])
        best = keep[np.lexsort((ids[keep], -row[keep]))]
        out.append((int(own), [{"neg": -int(s), "id": int(i)} for s, i in zip(row[best], ids[best])]))
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding",
          factor: int = 64, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row with every other row.

    Vectors are packed into shards, query rows into blocks. A shard meets a few blocks in one task as a matrix product,
    which keeps the best k per query; the lists of a query then merge in a tree, ``FAN_IN`` at a time. No task holds
    more than a shard, a few blocks and ``FAN_IN`` lists.

    Rows with a null id, a null vector, or null or non-finite components take no part; vectors of different lengths are
    not compared. A repeated row (same id and vector) counts once; rows that share an id are not each other's
    candidates, and as queries of one id they give one list. A query without candidates has no rows. An empty
    table gives an empty result. Other columns are not read.
    """
    good = vectors.where(F.col(id_col).isNotNull() & whole(F.col(vector))).select(
        F.col(id_col).cast("bigint").alias("id"), scaled(F.col(vector), factor).alias("v"), queries.alias("query"))
    rows = write_once(good.distinct().withColumn("dim", F.size("v")))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("query")).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asked // block))
    groups = -(-blocks // TOGETHER)
    number = F.pmod(F.xxhash64("id", "v"), F.lit(shards))
    packed = rows.withColumn("shard", number).groupBy("shard", "dim").applyInPandas(_pack, PACKED)
    asked_rows = rows.where("query").withColumn("shard", F.pmod(F.xxhash64("v", "id"), F.lit(blocks)))
    questions = asked_rows.groupBy("shard", "dim").applyInPandas(_pack, PACKED)
    left = questions.withColumn("part", F.pmod("shard", F.lit(groups))).withColumn(
        "tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
    right = packed.withColumn("tile", F.col("shard")).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))

    def tile(key, q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        found = []
        for one in s.itertuples():
            ids, v = _read(one)
            for ask in q.itertuples():
                found += tile_top(*_read(ask), ids, v, k)
        return pd.DataFrame({"query_id": [f[0] for f in found], "node": key[0], "best": pd.Series([f[1] for f in found], dtype=object)})

    keys = ["tile", "part", "dim"]
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        tile, "query_id bigint, node bigint, best array<struct<neg:bigint,id:bigint>>")
    while True:
        shards = -(-shards // FAN_IN)
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
        lists = lists.groupBy("query_id", F.expr(f"node div {FAN_IN}").alias("node")).agg(merged.alias("best"))
        if shards == 1:
            break
    return lists.select("query_id", F.posexplode("best").alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.neg")).alias("score"))
