"""A gated recurrent language model with a class-factored softmax, in numpy.

Symbols are the head words and, for all others, the tail classes.  A head word belongs to a class of neighbouring
ranks; its probability is that of the class times that within the class.  A tail class is a class without words:
the model gives its probability, and the words in it are not the model's business.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    """bounds: where each head class begins among the words, and where the last ends."""

    hidden: int
    bounds: tuple[int, ...]
    tails: int

    @property
    def words(self) -> int:
        return self.bounds[-1]

    @property
    def symbols(self) -> int:
        return self.words + self.tails

    @property
    def classes(self) -> int:
        return len(self.bounds) - 1 + self.tails

    def parts(self) -> dict[str, tuple[int, ...]]:
        h = self.hidden
        return {
            "inputs": (self.symbols, 3 * h),
            "recurrent": (h, 3 * h),
            "to_class": (h, self.classes),
            "class_bias": (self.classes,),
            "to_word": (self.words, h),
            "word_bias": (self.words,),
        }

    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts().values())

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parameters as named views of one vector."""
        found, at = {}, 0
        for name, shape in self.parts().items():
            size = int(np.prod(shape))
            found[name] = flat[at : at + size].reshape(shape)
            at += size
        return found

    def class_of(self) -> np.ndarray:
        """Class of each symbol."""
        heads = len(self.bounds) - 1
        own = np.repeat(np.arange(heads), np.diff(self.bounds))
        return np.concatenate([own, heads + np.arange(self.tails)]).astype(np.int32)

    def start(self, counts: np.ndarray, seed: int) -> np.ndarray:
        """Parameters that predict the symbols' shares and remember nothing yet."""
        flat = np.random.default_rng(seed).normal(0, 0.1, self.size()).astype(np.float32)
        view = self.views(flat)
        share = np.log((counts + 0.5) / (counts + 0.5).sum())
        mass = np.zeros(self.classes)
        np.add.at(mass, self.class_of(), np.exp(share))
        view["class_bias"][:] = np.log(mass)
        view["word_bias"][:] = share[: self.words]
        return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


class Model:
    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat = shape, flat
        self.p, self.class_of = shape.views(flat), shape.class_of()

    def step(self, inputs: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state, and what going back needs."""
        n = self.shape.hidden
        a, u = self.p["inputs"][inputs], h @ self.p["recurrent"]
        gates = _sigmoid(a[:, : 2 * n] + u[:, : 2 * n])
        r, z = gates[:, :n], gates[:, n:]
        new = np.tanh(a[:, 2 * n :] + r * u[:, 2 * n :])
        return new + z * (h - new), r, z, new, u

    def log_probability(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target symbol given its state."""
        classes = self.class_of[targets]
        found = np.empty(len(targets), np.float64)
        for at in range(0, len(targets), 16384):
            rows = slice(at, at + 16384)
            logits = states[rows] @ self.p["to_class"] + self.p["class_bias"]
            found[rows] = _log_softmax(logits)[np.arange(len(logits)), classes[rows]]
        for rows, first, last in self._by_class(classes):
            logits = states[rows] @ self.p["to_word"][first:last].T + self.p["word_bias"][first:last]
            found[rows] += _log_softmax(logits)[np.arange(len(rows)), targets[rows] - first]
        return found

    def _by_class(self, classes: np.ndarray):
        """For each head class of several words: the rows whose target it is, and its words."""
        order = np.argsort(classes, kind="stable")
        edges = np.searchsorted(classes[order], np.arange(len(self.shape.bounds)))
        for c, (first, last) in enumerate(zip(self.shape.bounds, self.shape.bounds[1:])):
            if last - first > 1 and edges[c + 1] > edges[c]:
                yield order[edges[c] : edges[c + 1]], first, last

    def score(self, documents: list[np.ndarray], start: int) -> np.ndarray:
        """Natural log-probability of each document; ``start`` is the symbol before the first.

        All documents run side by side, the longest first, so that the ones still running are the first rows.  The state
        of a document goes from window to window until its last symbol.
        """
        found = np.zeros(len(documents))
        order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
        lengths = np.array([len(documents[i]) for i in order], np.int64)
        if len(order) == 0 or lengths[0] == 0:
            return found
        total = np.zeros(len(order))
        window = max(8, min(64, 400_000 // len(order)))
        h = np.zeros((len(order), self.shape.hidden), np.float32)
        before = np.full(len(order), start, np.int32)
        for at in range(0, int(lengths[0]), window):
            running = int(np.searchsorted(-lengths, -at, "left"))
            width = min(window, int(lengths[0]) - at)
            tokens = np.zeros((running, width), np.int32)
            for row in range(running):
                part = documents[order[row]][at : at + width]
                tokens[row, : len(part)] = part
            states, targets, owners = [], [], []
            for t in range(width):
                n = int(np.searchsorted(-lengths, -(at + t), "left"))
                h = self.step(before[:n], h[:n])[0]
                before = tokens[:n, t]
                states.append(h)
                targets.append(before)
                owners.append(np.arange(n))
            logs = self.log_probability(np.concatenate(states), np.concatenate(targets))
            total += np.bincount(np.concatenate(owners), logs, len(order))
        found[order] = total
        return found


class Trainer:
    """Truncated backpropagation through time over lanes of running text, with Adam."""

    def __init__(self, shape: Shape, flat: np.ndarray, rate: float, lanes: int, window: int):
        self.model = Model(shape, flat.copy())
        self.rate, self.lanes, self.window = rate, lanes, window
        self.first, self.second = np.zeros_like(flat), np.zeros_like(flat)
        self.steps = self.tokens = 0

    def feed(self, text: np.ndarray, end: int) -> None:
        """Learn from documents one after another, each closed by ``end``; the first symbol is only input.

        The text is cut into as many lanes as it fills, the first ones longer by a symbol if it does not divide evenly; state
        goes from window to window, and starts anew after ``end``.
        """
        n = len(text) - 1
        if n < 1:
            return
        lanes = max(1, min(self.lanes, n // self.window))
        length, longer = divmod(n, lanes)
        inputs, targets = (self._lanes(x, lanes, end) for x in (text[:-1], text[1:]))
        h = np.zeros((lanes, self.model.shape.hidden), np.float32)
        for at in range(0, length, self.window):
            last = at + self.window >= length
            part = slice(at, inputs.shape[1] if last else at + self.window)
            rows = longer if last and longer else lanes
            h = self._window(inputs[:, part], targets[:, part], h, end, rows)
        self.tokens += n

    @staticmethod
    def _lanes(symbols: np.ndarray, lanes: int, end: int) -> np.ndarray:
        length, longer = divmod(len(symbols), lanes)
        if not longer:
            return symbols.reshape(lanes, length)
        found = np.full((lanes, length + 1), end, symbols.dtype)
        head = longer * (length + 1)
        found[:longer] = symbols[:head].reshape(longer, length + 1)
        found[longer:, :length] = symbols[head:].reshape(lanes - longer, length)
        return found

    def _window(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, end: int, rows: int | None = None) -> np.ndarray:
        """Of the last column only the first ``rows`` count, if given."""
        model, (lanes, width), n = self.model, inputs.shape, self.model.shape.hidden
        tape, states = [], []
        for t in range(width):
            goes_on = (inputs[:, t] != end)[:, None].astype(np.float32)
            h = h * goes_on
            new, *rest = model.step(inputs[:, t], h)
            tape.append((h, goes_on, rest))
            states.append(new)
            h = new
        gradient = np.zeros_like(model.flat)
        g = model.shape.views(gradient)
        counted = lanes * (width - 1) + (lanes if rows is None else rows)
        d_states = np.zeros((width * lanes, n), np.float32)
        d_states[:counted] = self._output(np.concatenate(states)[:counted], np.concatenate(targets.T)[:counted], g)
        d_states = d_states.reshape(width, lanes, n)
        d_inputs = np.empty((width, lanes, 3 * n), np.float32)
        d_recurrent = np.empty((width, lanes, 3 * n), np.float32)
        back = np.zeros((lanes, n), np.float32)
        for t in reversed(range(width)):
            old, goes_on, (r, z, new, u) = tape[t]
            dh = d_states[t] + back
            d_new = dh * (1 - z) * (1 - new * new)
            d_gates = d_inputs[t]
            d_gates[:, :n] = d_new * u[:, 2 * n :] * r * (1 - r)
            d_gates[:, n : 2 * n] = dh * (old - new) * z * (1 - z)
            d_gates[:, 2 * n :] = d_new
            d_recurrent[t] = d_gates
            d_recurrent[t][:, 2 * n :] *= r
            back = (dh * z + d_recurrent[t] @ model.p["recurrent"].T) * goes_on
        olds = np.concatenate([old for old, _, _ in tape])
        g["recurrent"] += olds.T @ d_recurrent.reshape(-1, 3 * n)
        seen = np.concatenate(inputs.T)
        order = np.argsort(seen, kind="stable")
        names, starts = np.unique(seen[order], return_index=True)
        g["inputs"][names] = np.add.reduceat(d_inputs.reshape(-1, 3 * n)[order], starts, axis=0)
        self._update(gradient, counted)
        return h

    def _output(self, states: np.ndarray, targets: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
        """Adds the gradients of both softmaxes to ``g``; returns those of the states."""
        p, classes = self.model.p, self.model.class_of[targets]
        d = np.exp(_log_softmax(states @ p["to_class"] + p["class_bias"]))
        d[np.arange(len(d)), classes] -= 1
        g["to_class"] += states.T @ d
        g["class_bias"] += d.sum(axis=0)
        found = d @ p["to_class"].T
        for rows, first, last in self.model._by_class(classes):
            own = states[rows]
            d = np.exp(_log_softmax(own @ p["to_word"][first:last].T + p["word_bias"][first:last]))
            d[np.arange(len(rows)), targets[rows] - first] -= 1
            g["to_word"][first:last] += d.T @ own
            g["word_bias"][first:last] += d.sum(axis=0)
            found[rows] += d @ p["to_word"][first:last]
        return found

    def _update(self, gradient: np.ndarray, tokens: int) -> None:
        gradient /= tokens
        norm = float(np.sqrt(np.dot(gradient, gradient)))
        if norm > 1:
            gradient /= norm
        self.steps += 1
        self.first += 0.1 * (gradient - self.first)
        self.second += 0.005 * (gradient * gradient - self.second)
        scale = self.rate / (1 - 0.9**self.steps)
        self.model.flat -= scale * self.first / (np.sqrt(self.second / (1 - 0.995**self.steps)) + 1e-6)
