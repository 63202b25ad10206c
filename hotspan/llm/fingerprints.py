"""Document fingerprints from prefix polynomial hashes, with span equality and longest common extensions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.llm import textarrays as ta

#: Two primes below 2^31 with a base each; equal spans agree in both, others hardly ever do.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
#: Characters of the spans that a fingerprint samples, and how many of the least span hashes it keeps.
SPAN, KEPT = 12, 48

_POWERS = [np.ones(1, np.uint64) for _ in PRIMES]


def _powers(which: int, n: int) -> np.ndarray:
    """Powers 0 to n of a base modulo its prime, grown by doubling."""
    table, p, base = _POWERS[which], np.uint64(PRIMES[which]), BASES[which]
    while len(table) <= n:
        table = np.concatenate([table, table * np.uint64(pow(base, len(table), PRIMES[which])) % p])
    _POWERS[which] = table
    return table


class PrefixHashes:
    """Prefix arrays of a text's code points: H[i] is the sum of (code point + 1) * base^position below i, modulo a prime."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        values = points.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for k, p in enumerate(PRIMES):
            terms = np.zeros(self.n + 1, np.uint64)
            np.cumsum(values * _powers(k, self.n)[:self.n] % np.uint64(p), out=terms[1:])
            self.sums.append(terms % np.uint64(p))

    def raw(self, k: int, start, end, shift) -> np.ndarray:
        """Hash of spans under prime k, all moved to position ``shift``, so that equal spans agree wherever they stand."""
        p, sums = np.uint64(PRIMES[k]), self.sums[k]
        return (sums[end] + p - sums[start]) % p * _powers(k, int(np.max(shift, initial=0)))[np.asarray(shift) - start] % p

    def spans(self, width: int) -> np.ndarray:
        """Hash of every span of ``width`` characters, by the first prime."""
        start = np.arange(self.n - width + 1)
        return self.raw(0, start, start + width, self.n)

    def equal(self, start: int, other: PrefixHashes, other_start: int, length: int) -> bool:
        """Whether two spans of one length are the same."""
        if start + length > self.n or other_start + length > other.n:
            return False
        shift = max(start, other_start)
        return all(self.raw(k, start, start + length, shift) == other.raw(k, other_start, other_start + length, shift)
                   for k in range(len(PRIMES)))

    def common_extension(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """Length of the longest common extension from two places, by binary search over span equality."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low


def sketch(prefix: PrefixHashes) -> np.ndarray:
    """The least KEPT distinct span hashes, ascending; a text shorter than a span has the hash of the whole, an empty one none."""
    if prefix.n == 0:
        return np.zeros(0, np.uint32)
    width = min(SPAN, prefix.n)
    # moved to a common position that no text length enters, then scrambled
    p = np.uint64(PRIMES[0])
    away = pow(pow(BASES[0], -1, PRIMES[0]), prefix.n, PRIMES[0])
    hashes = (ta.mixed(prefix.spans(width) * np.uint64(away) % p, width) >> np.uint64(32)).astype(np.uint32)
    if len(hashes) > 8 * KEPT:  # repeats may hide behind the least ones: then look further
        some = np.unique(np.partition(hashes, 4 * KEPT)[:4 * KEPT])
        if len(some) >= KEPT:
            return some[:KEPT]
    return np.unique(hashes)[:KEPT]


def fingerprint(prefix: PrefixHashes) -> tuple[str, np.ndarray]:
    """Text form ``length-hash-sketch``, and the sketch. Equal texts have equal fingerprints."""
    kept = sketch(prefix)
    both = "".join(f"{int(s[-1]):08x}" for s in prefix.sums)
    return f"{prefix.n:x}-{both}-{kept.astype('>u4').tobytes().hex()}", kept


def likeness(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> float:
    """Estimated share of common spans: of the least KEPT hashes of both together, those in both. 1 for equal fingerprints."""
    if a[0] == b[0]:
        return 1.0
    both = np.union1d(a[1], b[1])[:KEPT]
    common = np.intersect1d(a[1], b[1], assume_unique=True)
    return float(np.isin(both, common, assume_unique=True).mean()) if len(both) else 0.0


def in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(bucket, guest, doc_id, text): rows by descending doc_id, in buckets of neighbours; the text moves in one shuffle.

    Bucket bounds are quantiles of the ids, as many as there are shuffle partitions. The first row of a bucket is also a guest
    at the end of the bucket before, and the very first one after the very last, so that every row meets the next one.
    Rows with equal ids are ordered by text; rows without id come last.
    """
    spark = docs.sparkSession
    rows = docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.unique(np.array(rows.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts), np.int64))

    @F.pandas_udf("int")
    def bucket(ids):
        import pandas as pd
        known = ids.notna().to_numpy()
        place = np.full(len(ids), len(bounds) + 1)
        place[known] = len(bounds) - np.searchsorted(bounds, ids[known].to_numpy(np.int64), "left")
        return pd.Series(place, dtype="int32")

    # ids travel as text, as a column of numbers with nulls would reach pandas as floating point
    @F.pandas_udf("int")
    def bucket_of(ids):
        return bucket.func(ids.astype("Int64") if ids.notna().all() else ids.map(lambda s: None if s is None else int(s)).astype("Int64"))

    placed = rows.withColumn("bucket", bucket_of(F.col("doc_id").cast("string")))
    heads = placed.groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()  # one row per bucket
    if not heads:
        return placed.select("bucket", F.lit(False).alias("guest"), "doc_id", "text")
    before = [(h.head, heads[i - 1].bucket) for i, h in enumerate(heads)]
    hosts = spark.createDataFrame(before, "head bigint, host int")
    invited = rows.join(F.broadcast(hosts), F.col("doc_id").eqNullSafe(F.col("head")))
    guests = invited.groupBy("host").agg(F.min(F.struct(F.coalesce("text", F.lit("")))).alias("first"), F.first("doc_id").alias("doc_id"))
    every = placed.select("bucket", F.lit(False).alias("guest"), "doc_id", "text").unionByName(
        guests.select(F.col("host").alias("bucket"), F.lit(True).alias("guest"), "doc_id", F.col("first").getField("col1").alias("text")))
    return every.repartition(parts, "bucket").sortWithinPartitions(
        "bucket", "guest", F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit("")))


RESULT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double,"
          " near_next double, common_prefix bigint")


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """RESULT: each document's fingerprint, that of its edited text, and how alike it is to that and to the next document.

    The next document is the one with the next smaller id, after the last one the first. The edited text has its last
    floor(n_chars / 2) code points replaced by the first as many of the next document, or all if it has fewer.
    ``common_prefix`` is the longest common extension of both texts from their beginnings.

    A null text is empty; the fingerprint of an empty text is like itself only. Rows with equal ids follow one another by
    text, rows without id come last. A single row is followed by itself. An empty table gives an empty result. Rows stream
    through each task, which holds two of them at a time. Only the two named columns are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (bucket, doc_id, points, prefix hashes, fingerprint)
        for batch in batches:
            out = []
            for bucket, guest, key, content in zip(*(c.to_pylist() for c in batch.columns)):
                points = _points(content)
                prefix = PrefixHashes(points)
                here = (bucket, key, points, prefix, fingerprint(prefix))
                if last is not None and last[0] == bucket:
                    out.append(_compared(last, here))
                last = None if guest else here
            yield _columns(out)

    return in_order(docs, doc_id, text).mapInArrow(run, RESULT)


def _compared(here: tuple, after: tuple) -> tuple:
    _, key, points, prefix, own = here
    half = len(points) // 2
    edited = np.concatenate([points[:len(points) - half], after[2][:half]])
    hashes = PrefixHashes(edited)
    print_ = fingerprint(hashes)
    digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return (key, len(points), digest, own[0], print_[0], likeness(own, print_), likeness(own, after[4]),
            prefix.common_extension(0, hashes, 0))


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
    names = [x.split()[0] for x in RESULT.split(", ")]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
