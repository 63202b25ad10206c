"""A gated recurrent network over word ids with a class-factored output, in numpy: scoring and training by windows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Ids: 0 ends a document, 1 stands for any word outside the vocabulary, the words follow by falling frequency.
END, OTHER = 0, 1
CLASSES, CLASS_SIZE, HIDDEN = 32, 32, 24
WORDS = CLASSES * CLASS_SIZE - 1
#: Documents that are read side by side, and steps between two updates or flushes.
LANES, WINDOW = 256, 32
#: The same where texts are only scored; a text's score doesn't depend on them.
SCORE_LANES, SCORE_WINDOW = 512, 32
RATE = 0.05
_UNUSED = -30.0


@dataclass
class Network:
    """Parameters by name. ``inputs`` folds the embedding of each id into the three gates."""

    parts: dict[str, np.ndarray]

    @staticmethod
    def shapes() -> dict[str, tuple[int, ...]]:
        return {"inputs": (WORDS + 2, 3 * HIDDEN), "recurrent": (HIDDEN, 3 * HIDDEN), "class_w": (HIDDEN, CLASSES + 1),
                "class_b": (CLASSES + 1,), "word_w": (CLASSES, HIDDEN, CLASS_SIZE), "word_b": (CLASSES, CLASS_SIZE)}

    @classmethod
    def fresh(cls, counts: np.ndarray, seed: int = 0) -> "Network":
        """Untrained network whose output starts at the frequencies ``counts`` of ids (end, other, words)."""
        rng = np.random.default_rng(seed)
        parts = {n: (rng.standard_normal(s) * (0.1 if n == "inputs" else 0.15)).astype(np.float32) for n, s in cls.shapes().items()}
        full = np.zeros(WORDS + 2)
        full[:len(counts)] = counts
        known = np.append(full[END], full[2:]).reshape(CLASSES, CLASS_SIZE)
        with np.errstate(divide="ignore"):
            word_b, class_b = np.log(known), np.log(np.append(known.sum(1), full[OTHER]))
        parts["word_b"] = np.maximum(word_b - word_b.max(1, keepdims=True, initial=0.0), _UNUSED).astype(np.float32)
        parts["class_b"] = np.maximum(class_b - class_b.max(initial=0.0), _UNUSED).astype(np.float32)
        return cls(parts)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.parts[n].ravel() for n in self.shapes()])

    @classmethod
    def from_flat(cls, values: np.ndarray) -> "Network":
        parts, at = {}, 0
        for name, shape in cls.shapes().items():
            size = int(np.prod(shape))
            parts[name] = np.array(values[at:at + size], np.float32).reshape(shape)
            at += size
        return cls(parts)


def in_lanes(lengths: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deal texts to lanes, the longest first to the emptiest one: order of the texts, where each lane starts in that
    order's tokens, and the tokens of each lane, longest lane first."""
    heap, dealt = [(0, i) for i in range(min(lanes, max(1, len(lengths))))], {}
    for text in np.argsort(-lengths, kind="stable").tolist():
        filled, lane = heapq.heappop(heap)
        dealt.setdefault(lane, []).append(text)
        heapq.heappush(heap, (filled + int(lengths[text]), lane))
    filled = sorted(((n, lane) for n, lane in heap if lane in dealt), key=lambda x: (-x[0], x[1]))
    order = np.array([t for _, lane in filled for t in dealt[lane]], np.int64)
    sizes = np.array([n for n, _ in filled], np.int64)
    return order, np.cumsum(sizes) - sizes, sizes


def windows(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, steps: int = WINDOW) -> Iterator[tuple]:
    """(places, ids, inside) matrices of steps x active lanes; places beyond a lane's end are not ``inside``."""
    for at in range(0, int(sizes[0]) if len(sizes) else 0, steps):
        active = int(np.searchsorted(-sizes, -at, "left"))
        places = starts[:active] + np.arange(at, at + steps)[:, None]
        inside = places < starts[:active] + sizes[:active]
        yield places, np.where(inside, tokens[np.minimum(places, len(tokens) - 1)], END), inside


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Logistic function, written over its argument."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # an infinite exponential gives 0
        np.exp(x, out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


def run_window(net: Network, ids: np.ndarray, state: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States before each id and the one after the last; a document's end resets its lane. ``keep`` gathers what the way
    back needs."""
    hidden, inputs, ahead = state.shape[1], net.parts["inputs"], np.ascontiguousarray(net.parts["recurrent"].T)
    state = np.ascontiguousarray(state.T)  # one column a lane, so that each gate is one block
    before = np.empty((len(ids), *state.shape), np.float32)
    for t, row in enumerate(ids):
        before[t] = state
        x, u = np.ascontiguousarray(inputs[row].T), ahead @ state
        gates = x[:2 * hidden]
        gates += u[:2 * hidden]
        _sigmoid(gates)
        z, r, un = gates[:hidden], gates[hidden:], u[2 * hidden:]
        n = r * un
        n += x[2 * hidden:]
        np.tanh(n, out=n)
        ended = np.flatnonzero(row == END)
        if keep is not None:
            keep.append((z, r, n, un, ended))
        state = state - n
        state *= z
        state += n
        state[:, ended] = 0
    return before.transpose(0, 2, 1), state.T


def _log_softmax_at(logits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Log-softmax of each column at one place; the logits are written over. Columns let maxima and sums run along the rows."""
    logits -= logits.max(0)
    own = logits[places, np.arange(len(places))]
    return own - np.log(np.exp(logits, out=logits).sum(0))


def _softmax_error(logits: np.ndarray, places: np.ndarray, scale: np.float32) -> np.ndarray:
    """Gradient of the scaled log loss for the logits, one column each, written over them."""
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits *= scale / logits.sum(0)
    logits[places, np.arange(len(places))] -= scale
    return logits


def _logits(weights: np.ndarray, bias: np.ndarray, states: np.ndarray) -> np.ndarray:
    out = weights.T @ states.T
    out += bias[:, None]
    return out


def _places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and place in the class of each id; OTHER is the last class and has no place."""
    rank = np.where(ids == END, 0, ids - 1)
    return np.where(ids == OTHER, CLASSES, rank // CLASS_SIZE), rank % CLASS_SIZE


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts keys below 2^16, equal ones as they stood, and where each run of equal keys begins."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")  # 16 bits: a radix sort
    ranked = keys[order]
    return order, np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[:len(keys)])


def _by_class(classes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order, first = _runs(classes)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
        if (c := int(classes[order[a]])) < CLASSES:
            yield c, order[a:b]


def log_probabilities(net: Network, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log-probability of each id given the state before it: of its class, and within the class."""
    classes, places = _places(ids)
    out = _log_softmax_at(_logits(net.parts["class_w"], net.parts["class_b"], states), classes)
    for c, rows in _by_class(classes):
        out[rows] += _log_softmax_at(_logits(net.parts["word_w"][c], net.parts["word_b"][c], states[rows]), places[rows])
    return out


def score(net: Network, tokens: np.ndarray, lengths: np.ndarray, steps: int = SCORE_WINDOW) -> np.ndarray:
    """Natural log-probability of each whole text; text i holds the next ``lengths[i]`` tokens, its end included.

    The state goes from window to window, so a text of any length is scored as a whole.
    """
    if len(lengths) == 0:
        return np.zeros(0)
    order, starts, sizes = in_lanes(lengths, SCORE_LANES)
    first = np.cumsum(lengths) - lengths
    dealt = tokens[spans(first[order], lengths[order])]
    found, state = np.zeros(len(dealt), np.float32), np.zeros((len(sizes), HIDDEN), np.float32)
    for places, ids, inside in windows(dealt, starts, sizes, steps):
        before, state = run_window(net, ids, state[:ids.shape[1]])
        found[places[inside]] = log_probabilities(net, before[inside], ids[inside])
    out = np.empty(len(lengths))
    out[order] = np.add.reduceat(found.astype(np.float64), np.cumsum(lengths[order]) - lengths[order])
    return out


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of each span, one span after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Trainer:
    """Truncated backpropagation through time with steps scaled by past gradients (one sum of squares per parameter)."""

    def __init__(self, net: Network, squares: Network, rate: float = RATE):
        self.net, self.squares, self.rate, self.seen = net, squares, rate, 0

    def learn(self, tokens: np.ndarray, lengths: np.ndarray) -> None:
        """One pass over texts; every window is an update, the state goes on to the next window without its gradient."""
        if len(lengths) == 0:
            return
        order, starts, sizes = in_lanes(lengths)
        dealt = tokens[spans((np.cumsum(lengths) - lengths)[order], lengths[order])]
        state = np.zeros((len(sizes), HIDDEN), np.float32)
        for _, ids, inside in windows(dealt, starts, sizes):
            state = self._update(ids, inside, state[:ids.shape[1]])
        self.seen += len(dealt)

    def _update(self, ids: np.ndarray, inside: np.ndarray, state: np.ndarray) -> np.ndarray:
        net, keep = self.net.parts, []
        before, after = run_window(self.net, ids, state, keep)
        if inside.all():
            up = self._output(before.reshape(-1, HIDDEN), ids.ravel()).reshape(before.shape)
        else:
            up = np.zeros(before.shape, np.float32)
            up[inside] = self._output(before[inside], ids[inside])
        before, up = before.transpose(0, 2, 1), np.ascontiguousarray(up.transpose(0, 2, 1))
        hidden, recurrent = HIDDEN, net["recurrent"]
        d_inputs = np.empty((len(ids), 3 * hidden, ids.shape[1]), np.float32)
        d_recurrent = np.empty_like(d_inputs)
        down = np.zeros(up.shape[1:], np.float32)
        for t in range(len(ids) - 1, -1, -1):
            z, r, n, un, ended = keep[t]
            down[:, ended] = 0
            by_x, by_u = d_inputs[t], d_recurrent[t]
            dz, dr, dn = by_x[:hidden], by_x[hidden:2 * hidden], by_x[2 * hidden:]
            passed = down * z
            np.subtract(down, passed, out=dn)
            dn *= 1 - n * n
            np.subtract(before[t], n, out=dz)
            dz *= passed
            dz *= 1 - z
            np.multiply(dn, un, out=dr)
            dr *= r - r * r
            by_u[:2 * hidden] = by_x[:2 * hidden]
            np.multiply(dn, r, out=by_u[2 * hidden:])
            down = recurrent @ by_u
            down += passed
            down += up[t]
        self._step("recurrent", ..., np.matmul(before, d_recurrent.transpose(0, 2, 1)).sum(0))
        flat = ids.ravel()
        by_id, first = _runs(flat)
        self._step("inputs", flat[by_id[first]], np.add.reduceat(d_inputs.transpose(0, 2, 1).reshape(-1, 3 * hidden)[by_id], first, axis=0))
        return after

    def _output(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Update the output layers; gradient for the states."""
        net, scale = self.net.parts, np.float32(1 / len(ids))
        classes, places = _places(ids)
        wrong = _softmax_error(_logits(net["class_w"], net["class_b"], states), classes, scale)
        up = wrong.T @ net["class_w"].T
        self._step("class_w", ..., states.T @ wrong.T)
        self._step("class_b", ..., wrong.sum(1))
        by_w, by_b = np.zeros_like(net["word_w"]), np.zeros_like(net["word_b"])  # a zero changes nothing
        for c, rows in _by_class(classes):
            own = states[rows]
            wrong = _softmax_error(_logits(net["word_w"][c], net["word_b"][c], own), places[rows], scale)
            up[rows] += wrong.T @ net["word_w"][c].T
            by_w[c], by_b[c] = own.T @ wrong.T, wrong.sum(1)
        self._step("word_w", ..., by_w)
        self._step("word_b", ..., by_b)
        return up

    def _step(self, name: str, where, gradient: np.ndarray) -> None:
        squares = self.squares.parts[name]
        squares[where] += gradient * gradient
        self.net.parts[name][where] -= self.rate * gradient / (np.sqrt(squares[where]) + 1e-6)
