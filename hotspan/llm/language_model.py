"""Language-model scores of whole documents: a recurrent network over frequent words, exact counts for all words.

Counts of all training words stay a distributed table. The most frequent words, as many as a fixed bound allows, are sent
to the tasks; what a document holds of other words is joined with the table. The network predicts the frequent words and
"another word", whose own probability follows from its count, so that the score is a probability of the text as it is.

Training runs in rounds, each over another share of the training documents: every task trains its own copy of the network
on the documents it reads, the copies are averaged by the tokens they have seen, and the next round starts from there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.llm import gru
from hotspan.llm import textarrays as ta
from hotspan.storage import write_once

#: Words sent to every task, and the longest of them in bytes; others are joined.
KNOWN_WORDS, KNOWN_BYTES = 1 << 18, 64
#: Distinct words a task gathers before it hands on their counts.
FLUSH = 200_000
ROUNDS = 4
#: Tokens trained or scored at once, unless a single text is longer.
TOKENS = 1 << 22
BLOCK = 4096
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; words end at the six ASCII spaces. A null text has none."""
    return text.encode().translate(_LOWER).split() if text else []


@dataclass(frozen=True)
class Counts:
    """What is known of the training words. ``table`` holds (word, n); ``words`` and ``ns`` the frequent ones by falling
    count; ``ends`` is the number of training documents."""

    table: DataFrame
    words: list[bytes]
    ns: np.ndarray
    tokens: int
    distinct: int
    ends: int


def count_words(docs: DataFrame, training: Column, text: str = "text", known: int = KNOWN_WORDS) -> Counts:
    """Counts over all words of all training documents."""
    rows = docs.where(training).select(F.col(text).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for t in batch.column(0):
                found.update(words_of(t.as_py()))
                if len(found) > FLUSH:
                    yield _columns(list(found), list(found.values()))
                    found = Counter()
        yield _columns(list(found), list(found.values()))

    table = write_once(rows.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = rows.count()
    # The lowest count that leaves at most ``known`` words, in steps of an eighth of a power of two.
    short = table.where(F.octet_length("word") <= KNOWN_BYTES)
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = short.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()  # at most 8 * 63 rows
    lowest, kept = None, 0
    for row in sorted(sizes, reverse=True):
        if kept + row["words"] > known:
            break
        lowest, kept = row["step"], kept + row["words"]
    frequent = [] if lowest is None else short.where(step >= lowest).collect()  # at most ``known`` rows
    frequent = sorted(((bytes(r["word"]), r["n"]) for r in frequent), key=lambda r: (-r[1], r[0]))
    return Counts(table, [w for w, _ in frequent], np.array([n for _, n in frequent], np.int64),
                  total[0] + ends, total[1] + (ends > 0), ends)


def _columns(words: list[bytes], ns: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(ns, pa.int64())], ["word", "n"])


def encode(docs: DataFrame, training: Column, counts: Counts, keep: list[str], text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: the ``keep`` columns, row, training, round, n_tokens, ids (two bytes each), n_known, log_known,
    log_other, n_other and missing: words that were not sent, with their numbers.

    ``log_known`` sums log10(count + 0.1) over the words that were sent, ``log_other`` over those of them that the
    network calls OTHER; ``n_other`` counts all tokens it calls so. ``row`` numbers the rows of the written table.
    """
    sent = docs.sparkSession.sparkContext.broadcast((counts.words, np.log10(counts.ns + 0.1)))
    columns = docs.select(*keep, training.alias("training"), F.col(text).alias("text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[:-1]],
                        "row long, round int, n_tokens long, ids binary, n_known long, log_known double, log_other double, "
                        "n_other long, missing array<struct<word:binary,n:long>>"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, logs = sent.value
        place, row = {w: i for i, w in enumerate(words)}, TaskContext.get().partitionId() << 40
        absent = len(words)
        logs = np.append(logs, 0.0)
        ids = np.minimum(np.arange(absent + 1) + 2, gru.WORDS + 2)
        ids[gru.WORDS:] = gru.OTHER
        ids[absent] = gru.OTHER
        ids = ids.astype("<u2")
        missing_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        for batch in batches:
            for part in _parts(batch, batch.num_columns - 1):
                texts = [words_of(t.as_py()) for t in part.column(part.num_columns - 1)]
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                flat = list(chain.from_iterable(texts))
                found = np.fromiter(map(place.get, flat, repeat(absent)), np.int64, len(flat))
                tokens, known, ends = ids[found], logs[found], np.cumsum(sizes)
                other = tokens == gru.OTHER
                lost, at_text = [Counter() for _ in texts], np.repeat(np.arange(len(texts)), sizes)
                away = np.flatnonzero(found == absent)
                for i, k in zip(away.tolist(), at_text[away].tolist()):
                    lost[k][flat[i]] += 1

                def per_text(values):
                    return np.bincount(at_text, values, len(texts))

                rows = range(row, row + len(texts))
                row += len(texts)
                out = {"row": rows, "round": [int(_mixed(r) % rounds) for r in rows], "n_tokens": sizes + 1,
                       "ids": [tokens[b - n:b].tobytes() + b"\0\0" for b, n in zip(ends.tolist(), sizes.tolist())],
                       "n_known": per_text(found < absent).astype(np.int64), "log_known": per_text(known),
                       "log_other": per_text(np.where(other, known, 0)), "n_other": per_text(other).astype(np.int64),
                       "missing": [[{"word": w, "n": n} for w, n in x.items()] for x in lost]}
                types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), missing_type)
                made = [pa.array(v, t) for v, t in zip(out.values(), types)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*part.schema.names[:-1], *out])

    return write_once(columns.mapInArrow(encoded, schema))


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch whose texts are encoded together: at most 512, and of bounded size unless a single text is longer."""
    filled, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < batch.num_rows:
        before = filled[at - 1] if at else 0
        stop = max(at + 1, min(at + 512, int(np.searchsorted(filled, before + ta.PIECE, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def _mixed(row: int) -> int:
    return (row * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Batches until they hold enough tokens, with their ids and the number of ids of each text."""
    held, size = [], 0

    def joined() -> tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]:
        ids = [np.frombuffer(v.as_buffer(), "<u2") for b in held for v in b.column(column)]
        return held, np.concatenate(ids).astype(np.int64), np.array([len(i) for i in ids], np.int64)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.column(column).nbytes // 2
        if size >= TOKENS:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def train(encoded: DataFrame, counts: Counts, rounds: int = ROUNDS, rate: float = gru.RATE) -> gru.Network:
    """The network after one pass over all training documents. What reaches the driver is one average per round."""
    spark = encoded.sparkSession
    of_words = counts.ns[:gru.WORDS]
    seen = counts.tokens - counts.ends
    first = gru.Network.fresh(np.concatenate([[counts.ends, seen - of_words.sum()], of_words]))
    size = len(first.flat())
    state = np.concatenate([first.flat(), np.full(size, 1e-8, np.float32)])
    for number in range(rounds):
        sent = spark.sparkContext.broadcast(state)
        share = encoded.where(F.col("training") & (F.col("round") == number)).select("ids")
        copies = share.coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(
            _trainer(sent, size, rate), "block int, tokens long, part binary")
        mean = copies.groupBy("block").applyInPandas(_average, "block int, part binary").collect()
        sent.unpersist()
        if mean:
            state = np.concatenate([np.frombuffer(r["part"], "<f4") for r in sorted(mean)])
    return gru.Network.from_flat(state[:size])


def _trainer(sent: Broadcast, size: int, rate: float):
    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = None
        for _, ids, lengths in _texts(batches, 0):
            if learner is None:
                learner = gru.Trainer(gru.Network.from_flat(sent.value[:size]), gru.Network.from_flat(sent.value[size:]), rate)
            learner.learn(ids, lengths)
        if learner is not None:
            flat = np.concatenate([learner.net.flat(), learner.squares.flat()])
            parts = [flat[i:i + BLOCK].astype("<f4").tobytes() for i in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([learner.seen] * len(parts), pa.int64()),
                 pa.array(parts, pa.binary())], ["block", "tokens", "part"])
    return trained


def _average(copies: pd.DataFrame) -> pd.DataFrame:
    parts = np.stack([np.frombuffer(p, "<f4") for p in copies["part"]]).astype(np.float64)
    mean = np.average(parts, axis=0, weights=copies["tokens"])
    return pd.DataFrame({"block": [copies["block"].iloc[0]], "part": [mean.astype("<f4").tobytes()]})


def network_scores(encoded: DataFrame, net: gru.Network) -> DataFrame:
    """(row, log_network): log10 probability of every text's ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(net.flat())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = gru.Network.from_flat(sent.value)
        for held, ids, lengths in _texts(batches, 1):
            rows = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
            found = gru.score(own, ids, lengths) / np.log(10)
            yield pa.RecordBatch.from_arrays([rows, pa.array(found, pa.float64())], ["row", "log_network"])

    return encoded.select("row", "ids").mapInArrow(scored, "row long, log_network double")


def score_texts(docs: DataFrame, training: Column, keep: list[str], text: str = "text", rounds: int = ROUNDS,
                known: int = KNOWN_WORDS) -> DataFrame:
    """The ``keep`` columns of all ``docs`` and n_tokens, n_known, train_tokens, base_score, score, learnt from ``training`` rows.

    ``base_score`` takes all words by their smoothed counts; ``score`` is the log10 probability of the text by the network,
    the end of the text included. Null and empty texts hold the end only. Rows may repeat, in ids as in texts: each is
    scored on its own and, if it is for training, learnt from. Without training rows every token has probability 1 to the
    base, and the network stays as it was made. An empty table gives an empty result. ``keep`` must not name row,
    training, round, ids, missing or a result column.
    """
    counts = count_words(docs, training, text, known)
    encoded = encode(docs, training, counts, keep, text, rounds)
    net = train(encoded, counts, rounds)
    lost = encoded.select("row", F.explode("missing").alias("m")).select("row", "m.word", "m.n")
    # Words that were not sent are, by the bound on those that were, no large share of the tokens each.
    matched = lost.join(counts.table.select("word", F.col("n").alias("count")), "word", "left")
    rest = matched.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("count", F.lit(0)) + 0.1)).alias("log_lost"),
        F.sum(F.when(F.col("count") > 0, F.col("n")).otherwise(0)).alias("n_lost"), F.sum("n").alias("lost"))
    of_network = min(len(counts.words), gru.WORDS)
    whole = np.log10(counts.tokens + 0.1 * (counts.distinct + 1))
    others = counts.tokens - counts.ends - int(counts.ns[:of_network].sum())
    other = np.log10(others + 0.1 * (counts.distinct - (counts.ends > 0) - of_network + 1))
    joined = encoded.select(*keep, "row", "n_tokens", "n_known", "log_known", "log_other", "n_other").join(
        network_scores(encoded, net), "row").join(rest, "row", "left")
    log_lost = F.coalesce("log_lost", F.lit(0.0))
    return joined.select(
        *keep, "n_tokens", (F.col("n_known") + F.coalesce("n_lost", F.lit(0)) + F.lit(int(counts.ends > 0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("log_known") + log_lost + F.lit(float(np.log10(counts.ends + 0.1))) - F.col("n_tokens") * F.lit(float(whole))).alias("base_score"),
        (F.col("log_network") + F.col("log_other") + log_lost - F.col("n_other") * F.lit(float(other))).alias("score"))
