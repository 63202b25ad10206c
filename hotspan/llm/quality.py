"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.llm import textarrays as ta
from hotspan.storage import write_once

STATISTICS = (
    "log_words", "log_bytes", "word_length", "word_spread", "upper", "digit", "symbol", "sentence_mark", "doubled_symbol",
    "symbol_ends", "symbol_words", "distinct", "repeated_triples", "log_lines", "repeated_lines", "letters_outside_ascii",
    "long_words", "capital_words")
#: Share of the pooled spherical covariance in each class covariance, at least; small classes get more.
SHRINKAGE = 0.5
#: Standardised statistics beyond this many deviations count as this many.
CLIP = 3.0

_UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL, _SPACE, _LINE, _HIGH = range(8)


def _kinds() -> np.ndarray:
    table = np.full(256, _SYMBOL, np.uint8)
    table[65:91], table[97:123], table[48:58], table[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
    table[[ord(c) for c in ".,;:'\"()?-"]] = _MARK
    table[[0x20, *range(0x09, 0x0E)]] = _SPACE
    table[0x0A] = _LINE
    return table


def _per(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _repeats(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How many values of each text occur earlier in the same text."""
    return np.array([b - a - len(np.unique(hashes[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist())], float)


def statistics(texts: ta.Texts) -> np.ndarray:
    """One row of STATISTICS per text: logarithms of counts and square roots of shares. An empty text has zeros."""
    kinds = _kinds()[texts.data]
    owner = np.repeat(np.arange(texts.n), np.diff(texts.offsets))
    counts = np.bincount(owner * 8 + kinds, minlength=8 * texts.n).reshape(texts.n, 8).astype(float)
    starts, ends, first = texts.words()
    values = ta.byte_values()[texts.data]
    hashes = ta.run_hashes(values, starts, ends)
    n, size = np.diff(first).astype(float), (ends - starts).astype(float)
    words, letters = np.maximum(n, 1), np.maximum(1, counts[:, _UPPER] + counts[:, _LOWER] + counts[:, _HIGH])
    length = np.maximum(1, counts.sum(axis=1))
    mean = _per(first, size) / words
    spread = np.sqrt(np.maximum(0, _per(first, size * size) / words - mean * mean))
    symbol = kinds == _SYMBOL
    double = np.zeros(len(symbol), bool)
    double[1:] = symbol[1:] & (texts.data[1:] == texts.data[:-1])
    has_symbol = np.concatenate([[0], np.cumsum(symbol)])
    in_word = (has_symbol[ends] > has_symbol[starts]).astype(float)
    at_end = symbol[ends - 1].astype(float) if len(ends) else np.zeros(0)
    capital = (kinds[starts] == _UPPER).astype(float) if len(starts) else np.zeros(0)
    with np.errstate(over="ignore"):
        triples = ta.mixed(hashes[:-2] + np.uint64(3) * hashes[1:-1] + np.uint64(7) * hashes[2:]) if len(hashes) > 2 else hashes[:0]
    bounds = np.stack([np.minimum(first[:-1], len(triples)), np.clip(first[1:] - 2, np.minimum(first[:-1], len(triples)), len(triples))])
    again = np.array([b - a - len(np.unique(triples[a:b])) for a, b in bounds.T.tolist()], float)
    edge = np.zeros(len(texts.data) + 1, bool)
    edge[texts.offsets] = True
    edge[1:][kinds == _LINE] = True
    cuts = np.flatnonzero(edge)
    lines = ta.run_hashes(values, cuts[:-1], cuts[1:]) if len(cuts) > 1 else np.zeros(0, np.uint64)
    line_first = np.searchsorted(cuts, texts.offsets)
    n_lines = np.maximum(1, np.diff(line_first))
    share = np.stack([
        counts[:, _UPPER] / letters, counts[:, _DIGIT] / length, counts[:, _SYMBOL] / length, counts[:, _MARK] / length,
        _per(texts.offsets, double) / length, _per(first, at_end) / words, _per(first, in_word) / words,
        (n - _repeats(first, hashes)) / words, again / words, _repeats(line_first, lines) / n_lines,
        counts[:, _HIGH] / letters, _per(first, (size > 20).astype(float)) / words, _per(first, capital) / words], axis=1)
    root = np.sqrt(share)
    return np.column_stack([
        np.log1p(n), np.log1p(length), mean ** 0.5, np.log1p(spread), root[:, 0], root[:, 1], root[:, 2], root[:, 3], root[:, 4],
        root[:, 5], root[:, 6], root[:, 7], root[:, 8], np.log1p(n_lines), root[:, 9], root[:, 10], root[:, 11], root[:, 12]])


@dataclass
class Discriminant:
    """Standardisation, and per class the log prior, the mean, and the Cholesky factor of the covariance, factored once."""
    centre: np.ndarray
    scale: np.ndarray
    priors: tuple[float, float]
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of the two Gaussian log densities."""
        z = np.clip((x - self.centre) / self.scale, -CLIP, CLIP)
        density = []
        for prior, mean, factor in zip(self.priors, self.means, self.factors):
            y = np.linalg.solve(factor, (z - mean).T)
            density.append(prior - 0.5 * (y * y).sum(axis=0) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def discriminant(n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
    """From the counts, sums and sums of products of the two classes.

    Statistics are standardised by all rows. Each class covariance is shrunk toward a sphere of its mean variance, by
    ``shrinkage`` or by (d + 1) / (n + d + 1), whichever is more, so that few rows suffice for a valid factor.
    """
    d, total = sums.shape[1], n.sum()
    centre = sums.sum(axis=0) / total
    scale = np.sqrt(np.maximum(np.diag(products.sum(axis=0)) / total - centre ** 2, 1e-6))
    priors, means, factors = [], [], []
    for c in (0, 1):
        mean = sums[c] / n[c]
        cov = (products[c] / n[c] - np.outer(mean, mean)) / np.outer(scale, scale)
        a = max(shrinkage, (d + 1) / (n[c] + d + 1))
        cov = (1 - a) * cov + (a * max(np.trace(cov) / d, 0.0) + 1e-4) * np.eye(d)
        priors.append(np.log(n[c] / total))
        means.append((mean - centre) / scale)
        factors.append(np.linalg.cholesky(cov))
    return Discriminant(centre, scale, tuple(priors), tuple(means), tuple(factors))


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every whole text, one row per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(texts) for _, texts in ta.text_pieces(batch.column(1))]
            x = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
            flat = pa.array(x.ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])

    return docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text").mapInArrow(run, "doc_id bigint, x array<double>")


def fit(rows: DataFrame, labels: DataFrame, allowed: Column, doc_id: str = "doc_id", label: str = "quality",
        shrinkage: float = SHRINKAGE) -> Discriminant | None:
    """Train on all labelled rows of ``with_statistics`` that are ``allowed``.

    Each task reduces its rows to counts, sums and sums of products; these are summed per class and place, so that the
    driver gets one number per class and pair of statistics. Labels other than 0 and 1 don't count; a document
    with both counts for both. None if a class has no row.
    """
    d = len(STATISTICS)
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("c")).distinct()
    joined = rows.where(allowed).join(known, "doc_id").select("c", "x")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            c = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            for k in (0, 1):
                own = x[c == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        if total[:, 0].any():
            place = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(total.ravel())], names=["place", "value"])

    sums = joined.mapInArrow(moments, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(2 * (1 + d + d * d))
    for r in sums:
        total[r.place] = r.value
    total = total.reshape(2, -1)
    if not (total[:, 0] > 0).all():
        return None
    return discriminant(total[:, 0], total[:, 1:1 + d], total[:, 1 + d:].reshape(2, d, d), shrinkage)


def score_rows(rows: DataFrame, model: Discriminant | None) -> DataFrame:
    """(doc_id, score, predicted) from rows of ``with_statistics``; without a model every score is 0.5."""
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            s = model.scores(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id bigint, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, allowed: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every document: probability of quality 1, learnt from the ``allowed`` labelled rows.

    The texts are read once; their statistics, a few numbers per document, are written and used to train and to score.
    A null or empty text has all-zero statistics and is scored like any other. Null ids are scored but have no label;
    repeated rows are scored alike. An empty table gives an empty result. Only the two named columns are read.
    """
    rows = write_once(with_statistics(docs, doc_id, text))
    return score_rows(rows, fit(rows, labels, allowed))


def accepted(docs: DataFrame, model: Discriminant | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents with a score of at least ``least``, all columns and rows as they are."""
    @F.pandas_udf("double")
    def score(texts):
        parts = [model.scores(statistics(some)) for _, some in ta.text_pieces(pa.array(texts, pa.string(), from_pandas=True))]
        import pandas as pd
        return pd.Series(np.concatenate([np.zeros(0), *parts]))

    return docs if model is None else docs.where(score(F.col(text)) >= least)
