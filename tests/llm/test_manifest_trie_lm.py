"""Merkle manifest, conversation trie and language model against plain definitions on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotspan.llm import gru, language_model, merkle, prefix_trie
from hotspan.llm.queries import fold, op13_lm_scores

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- Merkle manifest --------------------------------------------------------------------------------------------

def plain_tree(leaves):
    """Root and the siblings of every leaf."""
    paths, places, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for leaf, at in enumerate(places):
            run = at // 3 * 3
            paths[leaf].append(("".join(level[run:at]), "".join(level[at + 1:run + 3])))
        level = [sha(*level[i:i + 3]) for i in range(0, len(level), 3)]
        places = [at // 3 for at in places]
    return level[0], paths


def fields_text(row):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest(spark, documents, levels):
    rng = random.Random(levels)
    rows = [(rng.randint(0, 60), rng.choice(["a\nb", "", None, "é x"]), "en", rng.choice(["s", "s", "s", None, "ü", "z"])) for _ in range(70)]
    rows += [(5, "copy", "en", "s")] * 40 + [(None, "n", None, None)] * 3 + [(1, "long " * 20000, "en", "only")]
    docs = documents(rows)
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    leaves = docs.withColumn("leaf", merkle.leaf_hash([F.col(c) for c in names])).withColumn("size", F.lit("clash"))
    made = merkle.manifest(leaves, "source", "doc_id", "leaf", ["doc_id", "text"], levels)
    got = made.rows.withColumn("folded", merkle.folded(F.col("node"), F.col("path"))).collect()

    groups = {}
    for i, text, lang, source in rows:
        leaf = sha(fields_text((i, source, lang, None if text is None else len(text), text)))
        groups.setdefault(source, []).append(((i is not None, i or 0), leaf, i, text))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf for _, leaf, _, _ in sorted(groups[s], key=lambda r: r[:2])]) for s in order}
    root, upper = plain_tree([trees[s][0] for s in order])
    want = Counter()
    for k, s in enumerate(order):
        for at, (_, leaf, i, text) in enumerate(sorted(groups[s], key=lambda r: r[:2])):
            want[(s, at, leaf, i, text, tuple(trees[s][1][at] + upper[k]), trees[s][0], root)] += 1
    assert Counter((r.group, r.position, r.node, r.doc_id, r.text, tuple(map(tuple, r.path)), r.subroot, r.root) for r in got) == want
    assert all(r.folded == root for r in got)
    assert [r.root for r in made.root.collect()] == [root]
    assert {r.group: r.size for r in made.subroots.collect()} == {s: len(groups[s]) for s in order}
    empty = merkle.manifest(leaves.limit(0), "source", "doc_id", "leaf", [], levels)
    assert empty.rows.isEmpty() and empty.root.isEmpty() and empty.subroots.isEmpty()


# --- Conversation trie ------------------------------------------------------------------------------------------

def plain_trie(conversations):
    """Nodes by brute force from conv_id -> list of (role, text)."""
    nodes = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[:len(key)] == key]
        kids = {k[:len(key) + 1] for k in below if len(k) > len(key)}
        saved = sum((len(nodes[k]) - 1) * len(WORD.findall(k[-1][1])) for k in below if k)
        ends = ",".join(str(c) for c in sorted(members) if len(conversations[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids),
                    sum(not any(len(o) > len(k) and o[:len(k)] == k for o in below) for k in below), saved, sha(ends)))
    return Counter(out)


@pytest.mark.parametrize("height", [2, 3, 16])
def test_prefix_trie(spark, height):
    rng = random.Random(height)
    rows = []
    for c in [*range(0, 45), -7, -20, 100, 10 ** 12]:
        for t in range(rng.randint(1, 5)):
            rows.append((c, rng.choice([t, t, None, 3]), rng.choice(["user", None, ""]), rng.choice(["hi", "hi", "a b", None, "x  y\tz"])))
    rows += [(c, t, "user", f"deep {min(t, 25 - c % 2)}") for c in (201, 202, 203, 205) for t in range(30)]
    rows += [(301, 0, "user", "same")] * 9 + [(None, 0, "user", "nobody's")] * 2
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth long, key long")

    def turn_hash(role, text):
        return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()

    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), turn_hash(role, text), (role or "", text or "")))
    own = {c: [t for *_, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    conv = F.col("conv_id")
    turns, lengths = prefix_trie.rebuilt(prefix_trie.numbered_turns(table), conv - conv % 20, (F.crc32(conv.cast("string")) % 4).cast("int"), 3)
    got = prefix_trie.prefix_trie(turns, lengths, height)
    assert Counter(map(tuple, got.collect())) == plain_trie(built)
    none = prefix_trie.numbered_turns(table.limit(0))
    turns, lengths = prefix_trie.rebuilt(none, conv, F.lit(0), 3)
    assert prefix_trie.prefix_trie(turns, lengths, height).isEmpty()


def test_two_sequences_under_one_key_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie.F, "xxhash64", lambda *_: F.lit(0).cast("long"))
    turns = spark.createDataFrame([(1, 1, b"a", 1), (2, 1, b"b", 1)], "conv_id long, depth long, turn_hash binary, words long")
    lengths = spark.createDataFrame([(1, 1), (2, 1)], "conv_id long, length long")
    with pytest.raises(Exception, match="share a key"):
        prefix_trie.prefix_trie(turns, lengths).collect()


# --- Language model ---------------------------------------------------------------------------------------------

def plain_base(rows):
    training = [WORD.findall((t or "").translate(LOWER)) for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 10 != 0]
    counts = Counter(w for words in training for w in words)
    counts[None] = len(training)
    counts = +counts
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*WORD.findall((t or "").translate(LOWER)), None]
        score = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        out.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), total, score))
    return out


@pytest.mark.parametrize("known", [1 << 18, 20])
def test_language_model(spark, documents, known):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[:rng.randint(1, 60)]).upper() for _ in range(rng.randint(0, 30)))) for i in range(150)]
    rows += [(3, rows[3][1])] * 2 + [(200, None), (None, ""), (201, "é x Ünseen " * 3000), (40, "only-here")]
    docs = documents(rows).withColumn("row_", F.lit(1)).withColumn("held_out", fold("doc_id", 10, 0))
    got = language_model.score_texts(docs.withColumn("ids", F.lit(0)), ~F.col("held_out"), ["doc_id", "held_out"], known=known).collect()
    want = plain_base([r[:2] for r in rows])
    def order(r): return (r[0] is not None, r[0] or 0, r[1])
    got, want = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=order), sorted(want, key=order)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want])
    assert all(g[5] < 0 for g in got)
    held = [(g[4], g[5]) for g in got if g[0] is not None and zlib.crc32(str(g[0]).encode()) % 10 == 0]
    assert sum(s for _, s in held) > sum(b for b, _ in held) * 1.2
    nothing = language_model.score_texts(docs.limit(0), F.lit(True), ["doc_id"])
    assert nothing.isEmpty()
    untrained = language_model.score_texts(docs.limit(3).select("doc_id", "text"), F.lit(False), ["doc_id"]).collect()
    assert len(untrained) == 3 and all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in untrained)


def test_the_network_is_a_distribution_and_its_gradients_are_right(monkeypatch):
    rng = np.random.default_rng(3)
    net = gru.Network.fresh(np.arange(2000, 2000 - gru.WORDS - 2, -1.0).clip(1))
    states = rng.standard_normal((3, gru.HIDDEN)).astype(np.float32)
    for s in states:
        every = np.arange(gru.WORDS + 2)
        assert np.exp(gru.log_probabilities(net, np.repeat(s[None], len(every), 0), every)).sum() == pytest.approx(1, abs=1e-4)
    texts = [rng.integers(1, gru.WORDS + 2, n - 1).tolist() + [gru.END] for n in (1, 2, 40, 7, 3, 90)]
    lengths = np.array([len(t) for t in texts])
    tokens = np.concatenate(texts)
    together = gru.score(net, tokens, lengths, 8)
    for text, got in zip(texts, together):  # a state carried from the first id to the last, one id at a time
        state, total = np.zeros((1, gru.HIDDEN), np.float32), 0.0
        for t in text:
            total += gru.log_probabilities(net, state, np.array([t]))[0]
            _, state = gru.run_window(net, np.array([[t]]), state)
        assert got == pytest.approx(total, rel=1e-4)

    ids = np.array([[5, 9], [1, 0], [7, 700]])
    net.parts = {n: v.astype(np.float64) for n, v in net.parts.items()}
    state, inside, steps = rng.standard_normal((2, gru.HIDDEN)), np.ones((3, 2), bool), {}

    def loss():
        before, _ = gru.run_window(net, ids, state.astype(np.float32))
        return -gru.log_probabilities(net, before.reshape(-1, gru.HIDDEN), ids.ravel()).sum() / ids.size

    monkeypatch.setattr(gru.Trainer, "_step", lambda self, name, where, g: steps.__setitem__((name, str(where)), (where, g)))
    gru.Trainer(net, net)._update(ids, inside, state.astype(np.float32))
    for (name, _), (where, gradient) in steps.items():
        index = tuple(rng.integers(0, n) for n in np.shape(gradient))
        target = net.parts[name]
        place = index if where is ... else ((where, *index) if np.ndim(where) == 0 else (where[index[0]], *index[1:]))
        at, change = target[place], []
        for delta in (1e-2, -1e-2):
            target[place] = at + delta
            change.append(loss())
        target[place] = at
        assert gradient[index] == pytest.approx((change[0] - change[1]) / 2e-2, rel=0.03, abs=2e-5), name


def test_an_update_takes_one_step_an_array(monkeypatch):
    """The words' layers are updated once a window, by the gradients of every class's own softmax."""
    rng = np.random.default_rng(5)
    net = gru.Network.fresh(np.arange(2000, 2000 - gru.WORDS - 2, -1.0).clip(1))
    states = rng.standard_normal((40, gru.HIDDEN)).astype(np.float32)
    ids, want = rng.integers(0, 90, 40), {n: np.zeros(s) for n, s in gru.Network.shapes().items()}
    for x, i in zip(states.astype(float), ids):
        c, k = (gru.CLASSES, 0) if i == gru.OTHER else divmod(max(int(i) - 1, 0), gru.CLASS_SIZE)
        for w, b, at, by_w, by_b in [(net.parts["class_w"], net.parts["class_b"], c, want["class_w"], want["class_b"])] + (
                [] if i == gru.OTHER else [(net.parts["word_w"][c], net.parts["word_b"][c], k, want["word_w"][c], want["word_b"][c])]):
            p = np.exp(x @ w + b)
            p /= p.sum()
            p[at] -= 1
            by_w += np.outer(x, p) / 40
            by_b += p / 40
    steps = []
    monkeypatch.setattr(gru.Trainer, "_step", lambda self, name, where, g: steps.append((name, where, g)))
    gru.Trainer(net, net)._output(states, ids)
    assert sorted(n for n, _, _ in steps) == ["class_b", "class_w", "word_b", "word_w"] and all(w is ... for _, w, _ in steps)
    for name, _, g in steps:
        assert np.allclose(g, want[name], atol=1e-5), name


def test_query_scores_better_than_counts(spark):
    out = op13_lm_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(
        F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert out[2] > 50 and out[0] > out[1]
