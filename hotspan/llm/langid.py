"""Language identification with a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotspan.llm import textarrays as ta

WINDOW, FILTERS, WIDTHS = 256, 16, (2, 3, 4)
#: Bound on the labelled documents that train the network, per language, and on the windows taken of each, evenly spread.
SAMPLE, SAMPLE_WINDOWS = 500, 4
EPOCHS, BATCH, RATE = 4, 64, 0.01
#: Windows convolved at once.
TOGETHER = 2048


@cache
def byte_codes() -> tuple[np.ndarray, int]:
    """Code of each byte: letters without case, four groups of other ASCII characters, every later byte by itself."""
    codes = np.zeros(256, np.uint8)
    for i in range(26):
        codes[[97 + i, 65 + i]] = 5 + i
    codes[[0x20, *range(0x09, 0x0E)]], codes[48:58], codes[[0x27, 0x2D]] = 1, 2, 3
    codes[[b for b in range(0x21, 0x7F) if not codes[b]]] = 4
    codes[128:] = 31 + np.arange(128)
    return codes, 31 + 128


@dataclass
class Network:
    """``filters[w]``: (w, codes, FILTERS) weights of the filters of width w over one-hot bytes, then a dense softmax layer."""
    languages: list[str]
    filters: dict[int, np.ndarray]
    dense: np.ndarray
    bias: np.ndarray


def windows_of(texts: ta.Texts, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of the texts, one row each, the last of a text padded with 0; and where each text's begin."""
    lengths = np.diff(texts.offsets)
    counts = -(-lengths // size)
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((int(first[-1]), size), np.uint8)
    out.reshape(-1)[ta.ragged(first[:-1] * size, lengths)] = byte_codes()[0][texts.data]
    return out, first


def _pooled(network: Network, windows: np.ndarray, where: bool = False):
    """Maxima of every filter over each window; with ``where``, also their places. Convolution is a sum of table rows."""
    codes, n = np.ascontiguousarray(windows.T), len(windows)
    size, total = byte_codes()[1], {}
    pairs = codes[:-1].astype(np.int32) * size + codes[1:]
    for w, f in network.filters.items():
        tables = [(j, (f[j][:, None] + f[j + 1][None]).reshape(-1, f.shape[2])) for j in range(0, w - 1, 2)]
        best, place = np.full((n, f.shape[2]), -np.inf, np.float32), np.zeros((n, f.shape[2]), np.int32)
        for t in range(len(codes) - w + 1):
            here = np.take(tables[0][1], pairs[t], axis=0)
            for j, table in tables[1:]:
                here += np.take(table, pairs[t + j], axis=0)
            if w % 2:
                here += np.take(f[w - 1], codes[t + w - 1], axis=0)
            if where:
                place[here > best] = t
            np.maximum(best, here, out=best)
        total[w] = (best, place)
    pooled = np.concatenate([total[w][0] for w in network.filters], axis=1)
    return (pooled, total) if where else pooled


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Fit by gradient descent (Adam) on the cross entropy. A maximum passes its gradient to the bytes it was found at."""
    rng, size = np.random.default_rng(seed), byte_codes()[1]
    net = Network(languages, {w: rng.normal(0, 0.3, (w, size, FILTERS)).astype(np.float32) for w in WIDTHS},
                  rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    params = [*net.filters.values(), net.dense, net.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = 1 / np.maximum(1, np.bincount(labels, minlength=len(languages)))
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            x, y = windows[pick], labels[pick]
            raw, places = _pooled(net, x, where=True)
            hidden = np.maximum(raw, 0)
            error = _softmax(hidden @ net.dense + net.bias)
            error[np.arange(len(y)), y] -= 1
            error *= (weight[y] * len(languages) / weight[labels].sum() * len(labels))[:, None] / len(y) / len(languages)
            back = (error @ net.dense.T) * (raw > 0)
            grads, column = [], 0
            for w in WIDTHS:
                grad, place = np.zeros_like(net.filters[w]), places[w][1]
                part = back[:, column:column + FILTERS]
                for j in range(w):
                    np.add.at(grad[j], (x[np.arange(len(y))[:, None], place + j], np.arange(FILTERS)[None]), part)
                grads.append(grad)
                column += FILTERS
            grads += [hidden.T @ error, error.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def fit(docs: DataFrame, allowed: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        sample: int = SAMPLE) -> Network | None:
    """Train on at most ``sample`` documents of each language among the ``allowed`` rows with a text and a language.

    The rows are drawn by a hash of the id: first the ids alone are counted and thinned out, so that the texts of only about
    as many rows as are needed are read into the sample. None if there is nothing to learn from.
    """
    labelled = docs.where(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull())
    per = {r[0]: r[1] for r in labelled.groupBy(F.col(lang)).count().collect()}
    if not per:
        return None
    languages = sorted(per)
    chance = F.lit(0.0)
    for name, n in per.items():
        chance = F.when(F.col(lang) == name, F.lit(1.5 * sample / n)).otherwise(chance)
    drawn = F.pmod(F.xxhash64(F.col(doc_id), F.length(text)), F.lit(1_000_003)) / 1_000_003 < chance
    spread = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda i: F.substring(
        F.col(text), (F.floor(i * F.greatest(F.lit(0), F.length(text) - WINDOW) / (SAMPLE_WINDOWS - 1)) + 1).cast("int"), F.lit(WINDOW)))
    rows = labelled.where(drawn).select(F.col(lang).alias("lang"), F.array_distinct(spread).alias("parts")).orderBy(
        F.xxhash64("parts")).limit(sample * len(languages) * 2).collect()
    texts, labels, counts = [], [], dict.fromkeys(languages, 0)
    for r in rows:
        if counts[r.lang] < sample:
            counts[r.lang] += 1
            texts += r.parts
            labels += [languages.index(r.lang)] * len(r.parts)
    kept, owners = [], []
    for at, some in ta.text_pieces(pa.array(texts, pa.string())):
        found, begins = windows_of(some)
        kept.append(found)
        owners += np.repeat(np.array(labels[at:at + some.n]), np.diff(begins)).tolist()
    if not owners:
        return None
    return train(np.concatenate(kept), np.array(owners), languages)


def predict(network: Network, texts: ta.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(language index or -1, score) per text: mean class probabilities over all windows of the text."""
    windows, first = windows_of(texts)
    chances = np.zeros((len(windows), len(network.languages)))
    for at in range(0, len(windows), TOGETHER):
        pooled = np.maximum(_pooled(network, windows[at:at + TOGETHER]), 0)
        chances[at:at + TOGETHER] = _softmax(pooled @ network.dense + network.bias)
    sums = np.concatenate([np.zeros((1, chances.shape[1])), np.cumsum(chances, axis=0)])
    mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, np.diff(first))[:, None]
    best = mean.argmax(axis=1)
    letters = np.concatenate([[0], np.cumsum((windows >= 5) & (windows < 31))[WINDOW - 1::WINDOW]]) if len(windows) else np.zeros(1, int)
    for i in np.flatnonzero(letters[first[1:]] == letters[first[:-1]]):  # no ASCII letter
        raw = bytes(texts.data[texts.offsets[i]:texts.offsets[i + 1]]).decode("utf-8", "replace")
        if not any(c.isalpha() for c in raw):
            best[i] = -1
    return best, np.where(best < 0, 0.0, mean[np.arange(len(best)), best])


def identify(docs: DataFrame, network: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the most likely language over all windows of every whole text.

    ``und`` with score 0 for a null text, for one without any letter, and if there is no network. Rows are predicted
    one by one from the text alone, so null ids, repeated rows and further columns make no difference.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for _, texts in ta.text_pieces(batch.column(1)):
                best, score = predict(network, texts) if network else (np.full(texts.n, -1), np.zeros(texts.n))
                names += [network.languages[b] if b >= 0 else "und" for b in best]
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]).clip(0, 1))],
                names=["doc_id", "lang_pred", "score"])

    return docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text").mapInArrow(
        run, "doc_id bigint, lang_pred string, score double")
