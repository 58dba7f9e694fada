"""A character tagger in numpy: bidirectional LSTM, linear layer, CRF transitions; trained from labelled windows.

Used by ``pii``. Both directions run as one batch of two; the CRF's gradient is
the difference of its marginals and the labels. Nothing here knows Spark.
"""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Outside, then the beginning and the inside of each kind.
TAGS = 1 + 2 * len(KINDS)
SYMBOLS, OTHER_LETTER, OTHER, PAD = 132, 128, 129, 131
BANNED = -1e4


def symbols(text: str) -> np.ndarray:
    """A small alphabet: ASCII as it is, other letters, anything else."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(code < 128, code, OTHER_LETTER).astype(np.int16)
    for i in np.flatnonzero(code >= 128):
        if not chr(code[i]).isalpha():
            out[i] = OTHER
    return out


def illegal() -> np.ndarray:
    """The inside of a kind follows its beginning or inside only."""
    out = np.zeros((TAGS + 1, TAGS), bool)  # the last row: what may come first
    for k in range(len(KINDS)):
        inside = 2 * k + 2
        out[:, inside] = True
        out[[inside - 1, inside], inside] = False
    out[TAGS, 2::2] = False  # a window may begin inside a span
    return out


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, hidden: int = 24, seed: int = 7):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p = {
            "in": 0.3 * r.standard_normal((2, SYMBOLS, 4 * hidden)), "rec": r.standard_normal((2, hidden, 4 * hidden)) / np.sqrt(hidden),
            "out": r.standard_normal((2 * hidden, TAGS)) / np.sqrt(2 * hidden), "bias": np.zeros(TAGS), "move": 0.1 * r.standard_normal((TAGS + 1, TAGS)),
        }
        self.p["in"][:, :, hidden : 2 * hidden] += 1.0  # remember at first
        self.p["bias"][0] = 2.0

    def states(self, x: np.ndarray):
        """Hidden states of windows ``x`` (batch, time) in both directions, and what the backward pass needs."""
        h, n, t = self.h, *x.shape
        both = np.stack([x, x[:, ::-1]]).transpose(2, 0, 1)  # time, direction, batch
        hid, cell = np.zeros((t + 1, 2, n, h)), np.zeros((t + 1, 2, n, h))
        gates = np.zeros((t, 2, n, 4 * h))
        way = np.arange(2)[:, None]
        for i in range(t):
            z = self.p["in"][way, both[i]] + hid[i] @ self.p["rec"]
            g = gates[i]
            g[..., : 3 * h] = sigmoid(z[..., : 3 * h])
            g[..., 3 * h :] = np.tanh(z[..., 3 * h :])
            cell[i + 1] = g[..., h : 2 * h] * cell[i] + g[..., :h] * g[..., 3 * h :]
            hid[i + 1] = g[..., 2 * h : 3 * h] * np.tanh(cell[i + 1])
        joined = np.concatenate([hid[1:, 0], hid[1:, 1][::-1]], axis=-1).transpose(1, 0, 2)
        return joined, (both, hid, cell, gates)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self.states(x)[0] @ self.p["out"] + self.p["bias"]

    def moves(self) -> np.ndarray:
        return np.where(illegal(), BANNED, self.p["move"])

    def marginals(self, e: np.ndarray):
        """(probabilities of each tag, of each move, log partition) by forward and backward sums."""
        m, t = self.moves(), e.shape[1]
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = m[TAGS] + e[:, 0]
        for i in range(1, t):
            a[:, i] = logsum(a[:, i - 1, :, None] + m[:TAGS], 1) + e[:, i]
        for i in range(t - 2, -1, -1):
            b[:, i] = logsum(m[:TAGS] + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2)
        z = logsum(a[:, -1], 1)
        tag = np.exp(a + b - z[:, None, None])
        move = np.exp(a[:, :-1, :, None] + m[:TAGS] + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
        return tag, move, z

    def gradient(self, x: np.ndarray, y: np.ndarray):
        """(loss a window, gradients) of labelled windows."""
        n, t = x.shape
        joined, (both, hid, cell, gates) = self.states(x)
        e = joined @ self.p["out"] + self.p["bias"]
        tag, move, z = self.marginals(e)
        rows, cols = np.arange(n)[:, None], np.arange(t)[None]
        m = self.moves()
        gold = e[rows, cols, y].sum(axis=1) + m[TAGS, y[:, 0]] + m[y[:, :-1], y[:, 1:]].sum(axis=1)
        d = tag
        first = tag[:, 0].sum(axis=0)
        d[rows, cols, y] -= 1
        d /= n
        g = {"move": np.zeros_like(self.p["move"])}
        g["move"][:TAGS] = move.sum(axis=(0, 1))
        g["move"][TAGS] = first
        np.add.at(g["move"], (y[:, :-1], y[:, 1:]), -1)
        np.add.at(g["move"][TAGS], y[:, 0], -1)
        g["move"] /= n
        g["out"], g["bias"] = np.tensordot(joined, d, ((0, 1), (0, 1))), d.sum(axis=(0, 1))
        dj = (d @ self.p["out"].T).transpose(1, 0, 2)
        h = self.h
        dh = np.stack([dj[..., :h], dj[::-1, :, h:]], axis=1)  # time, direction, batch, hidden
        g["in"], g["rec"] = np.zeros_like(self.p["in"]), np.zeros_like(self.p["rec"])
        carry_h, carry_c = np.zeros_like(hid[0]), np.zeros_like(hid[0])
        way = np.arange(2)[:, None]
        for i in range(t - 1, -1, -1):
            a = gates[i]
            gi, gf, go, gg = (a[..., k * h : (k + 1) * h] for k in range(4))
            now, squashed = dh[i] + carry_h, np.tanh(cell[i + 1])
            dc = carry_c + now * go * (1 - squashed**2)
            dz = np.concatenate([dc * gg * gi * (1 - gi), dc * cell[i] * gf * (1 - gf), now * squashed * go * (1 - go), dc * gi * (1 - gg**2)], axis=-1)
            carry_c, carry_h = dc * gf, dz @ self.p["rec"].transpose(0, 2, 1)
            g["rec"] += hid[i].transpose(0, 2, 1) @ dz
            np.add.at(g["in"], (way, both[i]), dz)
        return float((z - gold).mean()), g

    def train(self, batches, rate: float = 0.01, clip: float = 5.0) -> list[float]:
        """Adam over (windows, tags); the rate falls to nothing at the end."""
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        batches = list(batches)
        for step, (x, y) in enumerate(batches, 1):
            loss, g = self.gradient(x, y)
            losses.append(loss)
            size = np.sqrt(sum((v**2).sum() for v in g.values()))
            now = rate * (1 - (step - 1) / len(batches))
            for k, v in g.items():
                v = v * min(1.0, clip / (size + 1e-9))
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                self.p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of windows, and the probability of each."""
        e = self.emissions(x)
        n, t = x.shape
        m, best, back = self.moves(), np.zeros((n, TAGS)), np.zeros((n, t, TAGS), np.int8)
        best = m[TAGS] + e[:, 0]
        for i in range(1, t):
            step = best[:, :, None] + m[:TAGS]
            back[:, i] = step.argmax(axis=1)
            best = step.max(axis=1) + e[:, i]
        out = np.zeros((n, t), np.int64)
        out[:, -1] = best.argmax(axis=1)
        for i in range(t - 1, 0, -1):
            out[:, i - 1] = back[np.arange(n), i, out[:, i]]
        tag = self.marginals(e)[0]
        return out, np.take_along_axis(tag, out[:, :, None], 2)[:, :, 0]
