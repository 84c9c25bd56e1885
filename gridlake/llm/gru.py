"""A gated recurrent network with a class-factored softmax, in numpy: forward over windows, truncated backpropagation."""

from __future__ import annotations

import numpy as np

#: Token numbers below the words: the end of a text (also its start) and any word outside the vocabulary.
END, UNKNOWN = 0, 1


class Network:
    """classes x size word slots; word w is slot w % size of class w // size. Inputs are rows of X, three gates wide."""

    SHAPES = ("X", "U", "b", "C", "c", "W", "w")

    def __init__(self, classes: int, size: int, hidden: int, parts: dict[str, np.ndarray]):
        self.classes, self.size, self.hidden, self.p = classes, size, hidden, parts

    @classmethod
    def fresh(cls, counts: np.ndarray, classes: int, size: int, hidden: int, seed: int = 1) -> "Network":
        """Starts as the unigram model of the counts, one for each slot."""
        rng = np.random.default_rng(seed)
        padded = np.full(classes * size, 1e-6)
        padded[: len(counts)] = counts + 0.5
        by_class = padded.reshape(classes, size)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return cls(classes, size, hidden, {
            "X": draw(classes * size, 3 * hidden), "U": draw(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32),
            "C": draw(hidden, classes) * 0.1, "c": np.log(by_class.sum(1) / by_class.sum()).astype(np.float32),
            "W": draw(classes, hidden, size) * 0.1, "w": np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32),
        })

    def step(self, x: np.ndarray, h: np.ndarray):
        """The next state from input rows x (those of X and b) and state h, and what backward needs."""
        k = self.hidden
        u = h @ self.p["U"]
        gates = x[:, : 2 * k] + u[:, : 2 * k]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r, own = gates[:, :k], gates[:, k:], u[:, 2 * k :]
        n = r * own
        n += x[:, 2 * k :]
        n *= -2  # tanh by way of exp
        np.exp(n, out=n)
        n += 1
        np.divide(2, n, out=n)
        n -= 1
        after = h - n
        after *= z
        after += n
        return after, (h, z, r, n, own)

    @staticmethod
    def softmax(logits: np.ndarray, which: np.ndarray, every: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of one choice a row, and with `every` all probabilities (in place of the logits, which are held within +-60)."""
        np.clip(logits, -60, 60, out=logits)
        rows = np.arange(len(which))
        chosen = logits[rows, which]
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], np.float32)
        return chosen - np.log(total), np.divide(logits, total[:, None], out=logits) if every else None

    def log_probabilities(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Natural log probability of each target after state h; with grads, adds the loss gradients and returns d loss/d h."""
        kind = (target // self.size).astype(np.uint16)  # short numbers sort by radix
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(self.classes + 1))
        slices = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if a < b]
        kind, slot, h = kind[order].astype(np.int64), (target % self.size)[order], h.take(order, axis=0)  # by class from here on
        outer, p_kind = self.softmax(h @ self.p["C"] + self.p["c"], kind, grads is not None)
        inner = np.empty((len(h), self.size), np.float32)
        for c, own in slices:
            np.matmul(h[own], self.p["W"][c], out=inner[own])
            inner[own] += self.p["w"][c]
        within, p_slot = self.softmax(inner, slot, grads is not None)
        out = np.empty(len(h))
        out[order] = outer + within
        if grads is None:
            return out, None
        rows = np.arange(len(h))
        p_kind[rows, kind] -= 1
        p_slot[rows, slot] -= 1
        grads["C"] += h.T @ p_kind
        grads["c"] += p_kind.sum(0)
        d_h = p_kind @ self.p["C"].T
        for c, own in slices:
            grads["W"][c] += h[own].T @ p_slot[own]
            grads["w"][c] += p_slot[own].sum(0)
            d_h[own] += p_slot[own] @ self.p["W"][c].T
        back = np.empty_like(d_h)
        back[order] = d_h
        return out, back

    def _by_token(self, token: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Rows of values summed by token: a product with the tokens of one class as columns of ones, class by class."""
        kind = (token // self.size).astype(np.uint16)
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(self.classes + 1)).tolist()
        ones = np.zeros((len(token), self.size), np.float32)
        ones[np.arange(len(token)), (token % self.size)[order]] = 1
        values = values.take(order, axis=0)
        out = np.zeros((self.classes, self.size, values.shape[1]), np.float32)
        for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                np.matmul(ones[a:b].T, values[a:b], out=out[c])
        return out.reshape(-1, values.shape[1])

    def train(self, tokens: np.ndarray, memory: dict | None = None, window: int = 16, streams: int = 512, rate: float = 0.004) -> dict:
        """One pass over texts end to end (token numbers, END after each) by truncated backpropagation with Adam.

        The run of texts is cut into streams of equal length that go side by side; a stream's state is carried over windows and
        starts anew after an END. Returns what Adam remembers, to be given to the next call, with `seen`, the tokens so far.
        """
        memory = memory or {"turn": 0, "seen": 0} | {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        streams = max(1, min(streams, len(tokens) // (2 * window)))
        length = -(-len(tokens) // streams) if len(tokens) else 0
        grid = np.full(streams * length, -1, np.int32)
        grid[: len(tokens)] = tokens
        grid = np.ascontiguousarray(grid.reshape(streams, length).T) if length else grid.reshape(0, streams)
        k, h, last = self.hidden, np.zeros((streams, self.hidden), np.float32), np.full(streams, END, np.int32)
        for a in range(0, length, window):
            target = grid[a : a + window]
            before = np.concatenate((last[None, :], target[:-1]))
            before = np.where(before < 0, END, before)
            last = target[-1]
            goes_on = (before != END).astype(np.float32)[:, :, None]
            x = (self.p["X"] + self.p["b"]).take(before, axis=0)
            kept, states = [], np.empty((len(target), streams, k), np.float32)
            for t in range(len(target)):
                h, saved = self.step(x[t], h * goes_on[t])
                kept.append(saved)
                states[t] = h
            flat, flat_target = states.reshape(-1, k), target.reshape(-1)
            live = np.flatnonzero(flat_target >= 0)
            grads = {name: np.zeros_like(v) for name, v in self.p.items()}
            every = len(live) == len(flat_target)
            _, back = self.log_probabilities(flat if every else flat[live], flat_target if every else flat_target[live], grads)
            d_out = back if every else np.zeros_like(flat)
            if not every:
                d_out[live] = back
            d_out = d_out.reshape(states.shape)
            d_h, d_u, d_x = np.zeros_like(h), np.empty((len(target), streams, 3 * k), np.float32), np.empty((len(target), streams, 3 * k), np.float32)
            for t in reversed(range(len(target))):
                h0, z, r, n, own = kept[t]
                d_h = d_h + d_out[t]
                d_n = d_h * (1 - z)
                d_n *= 1 - n * n
                d_z = d_h * (h0 - n)
                d_z *= z * (1 - z)
                d_r = d_n * own
                d_r *= r * (1 - r)
                d_x[t, :, :k], d_x[t, :, k : 2 * k], d_x[t, :, 2 * k :] = d_z, d_r, d_n
                d_u[t, :, : 2 * k] = d_x[t, :, : 2 * k]
                np.multiply(d_n, r, out=d_u[t, :, 2 * k :])
                d_h = (d_h * z + d_u[t] @ self.p["U"].T) * goes_on[t]
            grads["U"] += np.concatenate([s[0] for s in kept]).T @ d_u.reshape(-1, 3 * k)
            d_x = d_x.reshape(-1, 3 * k)
            grads["b"] += d_x.sum(0)
            grads["X"] += self._by_token(before.reshape(-1), d_x)
            memory["turn"] += 1
            memory["seen"] += len(live)
            turn, scale = memory["turn"], np.float32(1 / max(1, len(live)))
            for name, g in grads.items():
                g *= scale
                np.clip(g, -1, 1, out=g)
                m1, m2 = memory[name]
                m1 += np.float32(0.1) * (g - m1)
                g *= g
                m2 += np.float32(0.01) * (g - m2)
                step = np.sqrt(m2 / np.float32(1 - 0.99**turn))
                step += np.float32(1e-8)
                self.p[name] -= np.float32(rate / (1 - 0.9**turn)) * m1 / step
        return memory

    def score(self, tokens: np.ndarray, offsets: np.ndarray, window: int = 32) -> np.ndarray:
        """Natural log probability of each row's tokens (END last), whole rows, the state carried across windows."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        size, first = size[order], offsets[:-1][order]
        out = np.zeros(len(size))
        h = np.zeros((len(size), self.hidden), np.float32)
        before = np.zeros(len(size), np.int64)
        longest, inputs = int(size[0]) if len(size) else 0, self.p["X"] + self.p["b"]
        for a in range(0, longest, window):
            states, targets, lengths = [], [], []
            for t in range(a, min(longest, a + window)):
                live = int(np.searchsorted(-size, -t, side="left"))  # rows longer than t stand first
                h, before = h[:live], before[:live]
                h, _ = self.step(inputs.take(before, axis=0), h)
                before = tokens[first[:live] + t]
                states.append(h)
                targets.append(before)
                lengths.append(live)
            got, _ = self.log_probabilities(np.concatenate(states), np.concatenate(targets))
            at = 0
            for live in lengths:
                out[:live] += got[at : at + live]
                at += live
        back = np.empty(len(out))
        back[order] = out
        return back
