"""N-gram Jaccard join with PartEnum signatures: equal subsets of partitions of the shingle domain."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotspan.llm import textarrays as ta
from hotspan.operators.components import connected_components
from hotspan.storage import write_once

#: Upper size of a band over that of the band below.
BAND = 1.5
#: Bytes of a signature that are sent beside its part; what they confuse is compared in vain, nothing more.
KEPT_BYTES = 6
#: Signatures that meet in one task, on average.
MEET = 1 << 20
#: Rounds that compare open buckets with one of their members each, before what is left is compared pair by pair.
ROUNDS = 2
#: Times that sets without enough shared values drop out before that; every time makes more values unshared.
PEELINGS = 2
#: Least signatures of a set that its rows carry along, by which most pairs that meet in several buckets are made in one only.
LEAST = 16


@dataclass(frozen=True)
class Join:
    """``words`` per shingle; two sets link when 100 * intersection >= percent * union."""
    words: int = 4
    percent: int = 85

    def needs(self, a: int, b: int) -> bool:
        return 100 * a >= self.percent * b


def shingles(texts: ta.Texts, words: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of every text, lower-cased; of fewer words all form one shingle, no word gives none."""
    hashes, first = texts.word_hashes()
    n = len(hashes) - words + 1
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, n), np.uint64)
        for j in range(words):
            rolled += ta.mixed(hashes[j:j + n], j + 1)
        rolled = ta.mixed(rolled)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(rolled[a:b - words + 1]))
            elif b > a:
                whole = sum((ta.mixed(hashes[a + j:a + j + 1], 100 * (b - a) + j) for j in range(b - a)), np.zeros(1, np.uint64))
                out.append(ta.mixed(whole))
            else:
                out.append(hashes[:0])
    return out


def set_key(values: np.ndarray, salt: int) -> int:
    """Hash of a whole set as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        return int(ta.mixed(ta.mixed(values, salt).sum(dtype=np.uint64, keepdims=True))[0].astype(np.int64))


def sketch(values: np.ndarray) -> bytes:
    """How many values lie in each of 2^m equal ranges of the hashes, one byte a count and about eight values a range.

    Empty if a count is too large for its byte; then nothing is known.
    """
    bits = max(4, len(values).bit_length() - 3)
    counts = np.bincount((values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_common(a: bytes, b: bytes) -> int:
    """An upper bound on the number of values that the sets of two sketches have in common."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.minimum(x, y.reshape(len(x), -1).sum(axis=1, dtype=np.int64)).sum())


@dataclass(frozen=True)
class Level:
    """Signatures for pairs whose smaller set lies in one size band: (low, high]; the larger may have ``reach`` values.

    Such a pair differs in at most ``k`` values. The domain falls into ``parts``, of which ``spare`` may be ignored, each cut
    into ``cuts``. If a pair differs in at most k values, then it differs in at most one value within one of any
    parts - spare parts, so that all cuts of that part but one are equal: each such subset is a signature.
    """
    low: int
    high: int
    reach: int
    k: int
    parts: int
    spare: int
    cuts: int


@cache
def level(number: int, percent: int) -> Level:
    high = _high(number)
    reach = high * 100 // percent
    k = (100 - percent) * (high + reach) // (100 + percent)
    needed = k // 2 + 1
    spare = 0 if needed < 4 else 2 + needed // 12
    return Level(_high(number - 1), high, reach, k, needed + spare, spare, 6 if needed < 4 else 3)


@cache
def _high(number: int) -> int:
    """Upper size of a band: bands grow by BAND and by one value at least."""
    return 0 if number < 0 else max(_high(number - 1) + 1, int(_high(number - 1) * BAND))


@cache
def band(size: int) -> int:
    number = 0
    while _high(number) < size:
        number += 1
    return number


def signatures(values: np.ndarray, percent: int) -> np.ndarray:
    """All signatures of one set (ascending hashes), as 64-bit hashes.

    A set signs for its own band, and for all below in which a set could be similar enough. A subset without any
    value is left out if the set has at most ``spare`` parts in which that happens, for it then has enough other
    parts; otherwise it is kept, so no similar pair can be missed.
    """
    size, out = len(values), []
    own = band(size)
    for number in range(own, -1, -1):
        lv = level(number, percent)
        if number < own and 100 * lv.high < percent * size:
            break
        if lv.k == 0:
            continue  # only equal sets are similar, and those have one key
        cells = lv.parts * lv.cuts
        cell = ((values >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
        bounds = np.searchsorted(cell, np.arange(cells + 1))
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(ta.mixed(values, 17), dtype=np.uint64)])
            sums = (total[bounds[1:]] - total[bounds[:-1]]).reshape(lv.parts, lv.cuts)
            counts = np.diff(bounds).reshape(lv.parts, lv.cuts)
            rest = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums
            empty = counts.sum(axis=1)[:, None] == counts
            places = ((np.uint64(number) << np.uint64(40)) + np.arange(cells, dtype=np.uint64)).reshape(rest.shape)
            signed = ta.mixed(rest + ta.mixed(places, 23))
        keep = ~empty if empty.any(axis=1).sum() <= lv.spare else np.ones_like(empty)
        out.append(signed[keep])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text")


def document_sets(docs: DataFrame, join: Join, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, key, check): size of each document's set and two hashes of the whole set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in ta.text_pieces(batch.column(1)):
                sets = shingles(texts, join.words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, texts.n), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([set_key(s, 5) for s in sets], pa.int64()), pa.array([set_key(s, 6) for s in sets], pa.int64())],
                    names=["doc_id", "n", "key", "check"])

    return _rows(docs, doc_id, text).mapInArrow(run, "doc_id bigint, n bigint, key bigint, check bigint")


def shared_signatures(docs: DataFrame, join: Join, sets: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(sig, key): signatures that several different sets have.

    A task signs each different set it meets once, deals its signatures out by their high bits and passes on packed arrays:
    six bytes of each signature and, once for all signatures of a set in one part, its key. The number of parts follows
    the total of set sizes. ``sig`` names a signature by the hash of the keys that have it, so that
    signatures with the same keys, of which near copies have hundreds, are one; one whose keys all lie in one
    larger group of the same part is left out.
    """
    per = 0.5 * (1 + 100 / join.percent) * (100 - join.percent) / (100 + join.percent) * 3 * 1.6
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * per
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // MEET) + 1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def pack(signed: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
            sigs = np.concatenate([np.zeros(0, np.uint64), *signed])
            owner = np.repeat(np.arange(len(keys)), [len(s) for s in signed])
            part = ((sigs >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")  # within a part, the signatures of one set stay together
            part, owner = part[order], owner[order]
            low = np.ascontiguousarray(sigs[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES])
            run = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (owner[1:] != owner[:-1]))[:len(part)])
            counts = np.diff(np.append(run, len(part))).astype(np.int32)
            named = np.array(keys, np.int64)[owner[run]]
            full, first = np.unique(part[run], return_index=True)
            first = np.append(first, len(run))
            at = np.append(run, len(part))[first]
            pieces = range(len(full))
            return pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([low[at[i]:at[i + 1]].tobytes() for i in pieces], pa.binary()),
                 pa.array([named[first[i]:first[i + 1]].tobytes() for i in pieces], pa.binary()),
                 pa.array([counts[first[i]:first[i + 1]].tobytes() for i in pieces], pa.binary())], names=["part", "sigs", "keys", "counts"])

        for batch in batches:
            signed, keys, waiting = [], [], 0
            for _, texts in ta.text_pieces(batch.column(1)):
                for s in shingles(texts, join.words):
                    if len(s) and (key := set_key(s, 5)) not in seen:
                        seen.add(key)
                        signed.append(signatures(s, join.percent))
                        keys.append(key)
                        waiting += len(signed[-1])
                if waiting > MEET:
                    yield pack(signed, keys)
                    signed, keys, waiting = [], [], 0
            yield pack(signed, keys)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list] = {}
        for batch in batches:
            for p, s, k, c in zip(*(c.to_pylist() for c in batch.columns)):
                by_part.setdefault(p, []).append((s, np.repeat(np.frombuffer(k, np.int64), np.frombuffer(c, np.int32))))
        for found in by_part.values():
            low = np.frombuffer(b"".join(s for s, _ in found), np.uint8).reshape(-1, KEPT_BYTES)
            sigs, keys = np.zeros((len(low), 8), np.uint8), np.concatenate([k for _, k in found])
            sigs[:, :KEPT_BYTES] = low
            names, keys = groups_of(sigs.view("<u8").reshape(-1), keys)
            for at in range(0, len(names), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[at:at + 100_000]), pa.array(keys[at:at + 100_000])], names=["sig", "key"])

    packed = _rows(docs, doc_id, text).mapInArrow(sign, "part int, sigs binary, keys binary, counts binary")
    return packed.repartition(parts, "part").mapInArrow(meet, "sig bigint, key bigint").distinct()


def groups_of(sigs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, key) of the groups of several keys that share a signature; every two keys of a group are in one that stays.

    A group's name is a hash of its keys, so equal groups are one. A group goes if the largest group of each of its keys is
    the same other group, for that holds all of them.
    """
    order = np.argsort(sigs, kind="stable")
    sigs, keys = sigs[order], keys[order]
    new = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1])[:len(sigs)])
    if len(new):
        low, high = np.minimum.reduceat(keys, new), np.maximum.reduceat(keys, new)
        keep = np.repeat(low != high, np.diff(np.append(new, len(sigs))))
        sigs, keys = sigs[keep], keys[keep]
    if not len(sigs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((keys, sigs))
    sigs, keys = sigs[order], keys[order]
    once = np.append(True, (sigs[1:] != sigs[:-1]) | (keys[1:] != keys[:-1]))
    sigs, keys = sigs[once], keys[once]
    new = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1]))
    sizes = np.diff(np.append(new, len(sigs)))
    with np.errstate(over="ignore"):
        names = ta.mixed(np.add.reduceat(ta.mixed(keys.astype(np.uint64), 31), new) + sizes.astype(np.uint64)).astype(np.int64)
    _, chosen = np.unique(names, return_index=True)
    chosen = chosen[np.argsort(-sizes[chosen], kind="stable")]  # the largest groups first
    starts, sizes, names = new[chosen], sizes[chosen], names[chosen]
    keys = keys[ta.ragged(starts, sizes)]
    group = np.repeat(np.arange(len(sizes)), sizes)
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    largest, begin = group[first][number], np.cumsum(sizes) - sizes
    least, most = np.minimum.reduceat(largest, begin), np.maximum.reduceat(largest, begin)
    keep = ((least != most) | (least == np.arange(len(sizes))))[group]
    return names[group][keep], keys[keep]


def sets_of(column: pa.Array, words: int) -> list[np.ndarray]:
    """The shingles of every text in an Arrow column."""
    return [s for _, texts in ta.text_pieces(column) for s in shingles(texts, words)]


def with_texts(docs: DataFrame, wanted: DataFrame, join: Join, doc_id: str, text: str) -> DataFrame:
    """(id, first, n, text, sketch): a text for each of the nodes ``wanted`` (n, key, check, id, first, rows), from a row of ``first``.

    A text takes less room than its set of hashes. A node whose ``first`` has one such row is found by that id alone and its text is not
    shuffled by set; only nodes of repeated or missing ids are.
    """
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sets_of(batch.column(0), join.words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s, 5) for s in sets], pa.int64()),
                 pa.array([set_key(s, 6) for s in sets], pa.int64()), batch.column(0),
                 pa.array([sketch(s) for s in sets], pa.binary())], names=["n", "key", "check", "text", "sketch"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sets_of(batch.column(5), join.words)
            wants = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
            same = [i for i, (s, w) in enumerate(zip(sets, wants)) if (len(s), set_key(s, 5), set_key(s, 6)) == w]
            yield batch.select([0, 1, 2, 5]).take(pa.array(same, pa.int64())).append_column(
                "sketch", pa.array([sketch(sets[i]) for i in same], pa.binary()))

    every = _rows(docs, doc_id, text)
    single = wanted.where("rows = 1").select("id", "first", "n", "key", "check")
    found = every.join(single, every["doc_id"] == single["first"]).select("id", "first", "n", "key", "check", "text").mapInArrow(
        own, "id bigint, first bigint, n bigint, text string, sketch binary")
    others = wanted.where("rows <> 1")
    if others.isEmpty():
        return found
    rows = every.join(others.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi").unionByName(every.where("doc_id is null"))
    sets = rows.select("text").mapInArrow(keyed, "n bigint, key bigint, check bigint, text string, sketch binary").groupBy(
        "n", "key", "check").agg(F.min("text").alias("text"), F.min("sketch").alias("sketch"))
    return found.unionByName(sets.join(others, ["n", "key", "check"]).select("id", "first", "n", "text", "sketch"))


def possible(pairs: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """Those of the pairs (u, v, un, vn) whose sets could link, as far as their sketches tell; ``un`` and ``vn`` are sizes.

    A sketch has a byte for about eight words, and its bound is never too low, so no link is lost and few texts need to be sent.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (un, vn, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)))):
                common = min(un, vn, most_common(a, b)) if a and b else min(un, vn)
                if join.needs(common, un + vn - common):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    a, b = (texts.select(F.col("id").alias(i), F.col("sketch").alias(f"{i}sketch")) for i in "uv")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "un", "vn", "usketch", "vsketch").mapInArrow(run, "u bigint, v bigint")


def linked(pairs: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """The pairs (u, v) of nodes whose sets link, with the first document of each (``ufirst``, ``vfirst``).

    ``un`` and ``vn`` are the sizes. Sets whose sketches leave it open are made from their texts and compared value by value. The pairs are
    written first, so that a small table of them goes to the sketches and the texts instead of all texts to the pairs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other, found = batch.column(5).dictionary_encode(), []
            theirs = sets_of(other.dictionary, join.words)  # many rows share their leader's text
            for i, (x, j) in enumerate(zip(sets_of(batch.column(4), join.words), other.indices.to_pylist())):
                y = theirs[j]
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[place] == x).sum())
                if join.needs(common, len(x) + len(y) - common):
                    found.append(i)
            yield batch.select([0, 1, 2, 3]).take(pa.array(found, pa.int64()))

    a, b = (texts.select(F.col("id").alias(i), F.col("first").alias(f"{i}first"), F.col("text").alias(v)) for i, v in (("u", "a"), ("v", "b")))
    likely = pairs.where(100 * F.least("un", "vn") >= join.percent * F.greatest("un", "vn")).select("u", "v", "un", "vn").distinct()
    near = write_once(possible(write_once(likely), texts, join))
    b = b.join(near.select("v").distinct(), "v", "left_semi")
    return near.join(a, "u").join(b, "v").select("u", "v", "ufirst", "vfirst", "a", "b").mapInArrow(
        run, "u bigint, v bigint, ufirst bigint, vfirst bigint").distinct()


def _led(members: DataFrame, weight: DataFrame) -> DataFrame:
    """Members with the leader of their bucket (``leader``: shared, id, n and further columns), its own row left out.

    The leader has the most shared signatures, and so is the most central of many near copies.
    """
    more = [c for c in members.columns if c not in ("sig", "id", "n", "shared")]
    ranked = members.drop("shared").join(weight, "id")
    leaders = ranked.groupBy("sig").agg(F.max(F.struct("shared", "id", "n", *more)).alias("leader"))
    return members.join(leaders, "sig").where("id <> leader.id")


def _nearest(members: DataFrame, weight: DataFrame) -> DataFrame:
    """Pairs of every set and the most central of all leaders of its buckets: one comparison a set."""
    top = _led(members, weight).groupBy("id", "n").agg(F.max("leader").alias("leader"))
    return _with_leader(top)


def _with_leader(led: DataFrame) -> DataFrame:
    return led.select(F.col("id").alias("u"), F.col("leader.id").alias("v"), F.col("n").alias("un"), F.col("leader.n").alias("vn"))


def _open(members: DataFrame, joined: DataFrame) -> DataFrame:
    """Members of the buckets that reach over several components, with their component."""
    named = members.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = named.groupBy("sig").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    return named.join(mixed.select("sig"), "sig", "left_semi")


def could_link(shared, size, other_size, percent: int):
    """Whether a set can link with one of the other size, if at most ``shared`` of its values are in any other set."""
    return 100 * shared >= percent * (size + other_size - shared)


def _peeled(members: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """Members that could still link, with ``shared``: how many of their values another set of an open bucket has too.

    Two linked sets have in common no more than either's shared values; what is too little for the smallest possible
    partner in the bucket drops out.
    """
    own = texts.join(members.select("id").distinct(), "id", "left_semi").select("id", "text")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, texts in ta.text_pieces(batch.column(1)):
                sets = shingles(texts, join.words)
                owner = np.repeat(ids[at:at + texts.n], [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).astype(np.int64)), pa.array(owner)], names=["value", "id"])

    rows = own.mapInArrow(spread, "value bigint, id bigint")
    alone = rows.groupBy("value").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other")
    single = alone.groupBy("id").agg(F.count(F.lit(1)).alias("single"))
    counted = members.select("sig", "id", "n").join(single, "id", "left").withColumn("shared", F.col("n") - F.coalesce("single", F.lit(0)))
    smallest = members.groupBy("sig").agg(F.min("n").alias("least"))
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * join.percent / 100))
    kept = counted.join(smallest, "sig").where(could_link(F.col("shared"), F.col("n"), partner, join.percent))
    return kept.select("sig", "id", "n", "shared")


def _least_signatures(members: DataFrame) -> DataFrame:
    """(id, sigs): the least signatures of every set, in ascending order."""
    return members.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, LEAST).alias("sigs"))


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one bucket that lie in different components and share enough values with others to link.

    Near copies meet in many buckets; a pair is made only in the one with the least signature that is among the least of
    both, and in every bucket of both if there is none. So some pairs come more than once, but a row has a bounded size: with all
    signatures of its set the rows would grow with the square of a text's length. Spark guesses the size of both sides from the
    members' file and would send them through the driver, which the hints rule out.
    """
    listed = _least_signatures(members).hint("merge")
    a, b = (members.join(listed, "id").select(
        "sig", F.col("id").alias(i), F.col("n").alias(f"{i}n"), F.col("shared").alias(f"{i}s"),
        F.col("component").alias(f"{i}c"), F.col("sigs").alias(f"{i}sigs")) for i in "uv")
    common = F.least("us", "vs", "un", "vn")
    likely = (F.col("u") < F.col("v")) & (F.col("uc") != F.col("vc")) & could_link(common, F.col("un"), F.col("vn"), percent) & (
        a["sig"] == F.coalesce(F.array_min(F.array_intersect("usigs", "vsigs")), a["sig"]))
    return a.join(b.hint("merge"), (a["sig"] == b["sig"]) & likely).select("u", "v", "un", "vn")


def _linked_sets(docs: DataFrame, join: Join, sets: DataFrame, usable: DataFrame, doc_id: str,
                 text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (n, key, check, first, id), links and components (id, component) of the different sets in ``usable``.

    Every different set is one node with a number of its own; ``first`` is the smallest id of its documents, null if none has one.
    """
    per_id = usable.groupBy("n", "key", "check", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    nodes = write_once(per_id.groupBy("n", "key", "check").agg(
        F.min("doc_id").alias("first"), F.coalesce(F.min_by("rows", "doc_id"), F.lit(0)).alias("rows")).withColumn(
        "id", F.monotonically_increasing_id()))
    shared = shared_signatures(docs, join, sets, doc_id, text)
    members = write_once(shared.join(nodes.select("key", "id", "n"), "key").select("sig", "id", "n"))
    weight = write_once(members.groupBy("id").agg(F.count(F.lit(1)).alias("shared")))
    texts = write_once(with_texts(docs, nodes.join(weight, "id", "left_semi"), join, doc_id, text))
    links = write_once(linked(_nearest(members, weight), texts, join))
    left = members
    for turn in range(ROUNDS + 1):
        joined = write_once(connected_components(links)).withColumnRenamed("node", "id")
        left = write_once(_open(left.select("sig", "id", "n"), joined))
        if left.isEmpty():
            return nodes, links, joined
        if turn < ROUNDS:
            led = write_once(_led(left, weight))
            pairs, left = _with_leader(led.where("component <> leader.component")), led
        else:
            for _ in range(PEELINGS):
                left = write_once(_open(_peeled(left, texts, join), joined))
            pairs = _across(left, join.percent)
        links = links.unionByName(write_once(linked(pairs, texts, join)))
    return nodes, links, connected_components(links).withColumnRenamed("node", "id")


def components(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links) and set_key.

    Equal sets share a key and are one node. Sets that share a signature are candidates.
    Every set is first compared with the most central set that it meets in any bucket, and links join components. Buckets
    whose members are still apart go on: the bucket's most central set is compared with those of other components, then
    sets with too many values of their own drop out, and at last all likely pairs of a bucket that lie in different
    components are compared. So no link between components is missed, while a group of near copies costs about one comparison a member.

    A null or blank text has no shingle, size 0, and is alone. Rows with a null id take no part and have no component. Rows
    that repeat an id link all their texts. An empty table gives an empty result. Other columns are not read.
    """
    sets = write_once(document_sets(docs, join, doc_id, text))
    usable = sets.where("n > 0 and doc_id is not null")
    nodes, links, _ = _linked_sets(docs, join, sets, usable, doc_id, text)
    # every set is named by its first document here, and rows that repeat an id with different texts link their sets through it
    same = usable.select("doc_id", "n", "key", "check").distinct().join(nodes, ["n", "key", "check"]).select(
        F.col("doc_id").alias("u"), F.col("first").alias("v")).where("u <> v")
    named = links.select(F.col("ufirst").alias("u"), F.col("vfirst").alias("v"))
    joined = connected_components(named.unionByName(same)).withColumnRenamed("node", "first")
    final = nodes.join(joined, "first", "left").select("n", "key", "check", F.coalesce("component", "first").alias("component"))
    out = sets.join(final, ["n", "key", "check"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").alias("set_key"))


def one_of_each(docs: DataFrame, join: Join = Join(words=5, percent=80), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates: one row of each component of linked sets stays, with all columns.

    Rows are told apart by id and set, and ids link nothing: the row with the smallest id of the component stays, one without
    id only if none has one. So one of rows that repeat an id and its text stays, one of copies without id, and of an id with
    different texts each that resembles nothing with a smaller id. Rows without shingles all stay. Columns of any name are kept.
    """
    sets = write_once(document_sets(docs, join, doc_id, text))
    nodes, _, joined = _linked_sets(docs, join, sets, sets.where("n > 0"), doc_id, text)
    best = F.min(F.struct(F.col("first").isNull(), "first", "n", "key", "check")).alias("best")
    named = nodes.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    stay = write_once(named.groupBy("component").agg(best).select(*(f"best.{c}" for c in ("first", "n", "key", "check"))))
    # an id of a single row stays or goes as a whole; only rows that repeat an id or have none are looked at one by one
    marked = sets.where("doc_id is not null").join(
        stay.withColumnRenamed("first", "doc_id").withColumn("stays", F.lit(True)), ["doc_id", "n", "key", "check"], "left")
    per_id = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.coalesce("stays", F.col("n") == 0)).alias("stays"))
    away = write_once(per_id.where("rows > 1 or not stays").select(F.col("doc_id").alias("_id"), "rows"))
    number = F.col(f"`{doc_id}`").cast("bigint")
    once = docs.where(number.isNotNull()).join(away.select("_id"), number == away["_id"], "left_anti")
    repeated = away.where("rows > 1").select("_id")
    several = []
    if not repeated.isEmpty():
        several.append(docs.join(repeated, number == repeated["_id"], "left_semi"))
    if not sets.where("doc_id is null").isEmpty():
        several.append(docs.where(number.isNull()))
    for rows in several:
        once = once.unionByName(_one_row_of_each(rows, stay, join, doc_id, text))
    return once


def _one_row_of_each(docs: DataFrame, stay: DataFrame, join: Join, doc_id: str, text: str) -> DataFrame:
    """One of the rows for each id and set in ``stay`` (first, n, key, check), and all rows without shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in ta.text_pieces(batch.column(2)):
                sets = shingles(texts, join.words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, texts.n), batch.column(1).slice(at, texts.n), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([set_key(s, 5) for s in sets], pa.int64()), pa.array([set_key(s, 6) for s in sets], pa.int64())],
                    names=["doc", "doc_id", "n", "key", "check"])

    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
                        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = f"doc {whole.schema['doc'].dataType.simpleString()}, doc_id bigint, n bigint, key bigint, check bigint"
    rows = whole.mapInArrow(run, schema)
    same = rows["doc_id"].eqNullSafe(stay["first"]) & (rows["n"] == stay["n"]) & (rows["key"] == stay["key"]) & (rows["check"] == stay["check"])
    found = rows.join(stay, same, "left_semi")
    fixed = [F.col("doc").getField(c) for c, kind in docs.dtypes if "map<" not in kind]  # columns that can be hashed
    first = F.min_by("doc", F.struct(F.col("doc").getField(text), F.xxhash64(*fixed))).alias("doc")
    kept = found.groupBy("doc_id", "n", "key", "check").agg(first).select("doc.*")
    return rows.where("n = 0").select("doc.*").unionByName(kept)
