"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Batches of windows of equal length go through both directions at once; the input layer is a table lookup
per character, so each step is one matrix product and one tanh. Training minimises the negative
log-likelihood of the label path with Adam; everything starts from a fixed seed.
"""

from __future__ import annotations

import numpy as np

#: Character classes: ASCII one by one, other letters, other digits, everything else, padding.
CLASSES = 132
LETTER, DIGIT, OTHER, PAD = 128, 129, 130, 131


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.minimum(codes, OTHER).astype(np.int16)
    for i in np.flatnonzero(codes >= 128).tolist():
        c = text[i]
        out[i] = LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER
    return out


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Tagger:
    """Parameters and passes. `labels` counts the CRF's states."""

    def __init__(self, labels: int, hidden: int = 16, width: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = hidden
        self.labels, self.hidden = labels, h

        def start(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "embed": start(CLASSES, width, scale=0.5),
            # both directions side by side; gates in, forget, out, cell
            "wx": start(2, width, 4 * h, scale=width ** -0.5),
            "wh": start(2, h, 4 * h, scale=h ** -0.5),
            "b": np.zeros((2, 1, 4 * h), np.float32),
            "wo": start(2 * h, labels, scale=(2 * h) ** -0.5),
            "bo": np.zeros(labels, np.float32),
            "trans": start(labels, labels, scale=0.1),
            "first": np.zeros(labels, np.float32),
        }
        self.p["b"][:, :, h:2 * h] = 1.0

    # ------------------------------------------------------------ forward

    def _gates(self, z: np.ndarray) -> np.ndarray:
        """Sigmoids of the first three gates and the tanh of the last, from one tanh."""
        n = 3 * self.hidden
        z[..., :n] *= 0.5
        np.tanh(z, out=z)
        z[..., :n] *= 0.5
        z[..., :n] += 0.5
        return z

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Scores [time, batch, label] of windows x [batch, time]."""
        p, h = self.p, self.hidden
        batch, time = x.shape
        table = p["embed"][None] @ p["wx"] + p["b"]
        order = np.stack([x.T, x.T[::-1]], axis=1)
        hs = np.zeros((time + 1, 2, batch, h), np.float32)
        cs = np.zeros((time + 1, 2, batch, h), np.float32) if keep else None
        gates = np.zeros((time, 2, batch, 4 * h), np.float32) if keep else None
        c = np.zeros((2, batch, h), np.float32)
        both = np.arange(2)[:, None]
        for t in range(time):
            z = self._gates(table[both, order[t]] + hs[t] @ p["wh"])
            c = z[..., h:2 * h] * c + z[..., :h] * z[..., 3 * h:]
            hs[t + 1] = z[..., 2 * h:3 * h] * np.tanh(c)
            if keep:
                gates[t], cs[t + 1] = z, c
        joined = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], axis=2)
        scores = joined @ p["wo"] + p["bo"]
        return (scores, (order, hs, cs, gates, joined)) if keep else scores

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best label path [batch, time] and the posterior of each of its labels."""
        e = self.emissions(x).astype(np.float64)
        trans = self.p["trans"].astype(np.float64)
        time, batch, n = e.shape
        best, back = self.p["first"] + e[0], np.zeros((time, batch, n), np.int8)
        for t in range(1, time):
            all_ = best[:, :, None] + trans
            back[t] = all_.argmax(axis=1)
            best = all_.max(axis=1) + e[t]
        path = np.zeros((batch, time), np.int8)
        path[:, -1] = best.argmax(axis=1)
        rows = np.arange(batch)
        for t in range(time - 1, 0, -1):
            path[:, t - 1] = back[t, rows, path[:, t]]
        alpha, beta, whole = self._sweeps(e, trans)
        chance = np.exp(alpha + beta - whole[None, :, None])
        return path, chance[np.arange(time)[None], rows[:, None], path]

    def _sweeps(self, e, trans):
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = self.p["first"] + e[0]
        for t in range(1, len(e)):
            alpha[t] = _sum_exp(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(len(e) - 2, -1, -1):
            beta[t] = _sum_exp(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        return alpha, beta, _sum_exp(alpha[-1], 1)

    # ------------------------------------------------------------ training

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss per window and its gradients; y [batch, time] are the labels."""
        p, h = self.p, self.hidden
        batch, time = x.shape
        scores, (order, hs, cs, gates, joined) = self.emissions(x, keep=True)
        e, trans = scores.astype(np.float64), p["trans"].astype(np.float64)
        alpha, beta, whole = self._sweeps(e, trans)
        rows, g = np.arange(batch), {k: np.zeros_like(v) for k, v in p.items()}
        gold = p["first"][y[:, 0]] + e[0, rows, y[:, 0]]
        de = np.exp(alpha + beta - whole[None, :, None])
        de[0, rows, y[:, 0]] -= 1
        g["first"] += de[0].sum(axis=0) / batch
        for t in range(1, time):
            pair = np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :]
                          - whole[:, None, None]).sum(axis=0)
            np.add.at(pair, (y[:, t - 1], y[:, t]), -1)
            g["trans"] += pair / batch
            de[t, rows, y[:, t]] -= 1
            gold += trans[y[:, t - 1], y[:, t]] + e[t, rows, y[:, t]]
        de = (de / batch).astype(np.float32)
        g["bo"] = de.sum(axis=(0, 1))
        g["wo"] = np.tensordot(joined, de, ([0, 1], [0, 1]))
        dj = de @ p["wo"].T
        dh_out = np.stack([dj[:, :, :h], dj[::-1, :, h:]], axis=1)
        dh, dc = np.zeros((2, batch, h), np.float32), np.zeros((2, batch, h), np.float32)
        dtable = np.zeros((2, CLASSES, 4 * h), np.float32)
        wt = p["wh"].transpose(0, 2, 1)
        for t in range(time - 1, -1, -1):
            z, c, before = gates[t], cs[t + 1], cs[t]
            i, f, o, a = z[..., :h], z[..., h:2 * h], z[..., 2 * h:3 * h], z[..., 3 * h:]
            dh = dh + dh_out[t]
            tc = np.tanh(c)
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * a * i * (1 - i), dc * before * f * (1 - f),
                                 dh * tc * o * (1 - o), dc * i * (1 - a * a)], axis=2)
            g["wh"] += hs[t].transpose(0, 2, 1) @ dz
            for k in (0, 1):
                np.add.at(dtable[k], order[t, k], dz[k])
            dh, dc = dz @ wt, dc * f
        g["b"] = dtable.sum(axis=1, keepdims=True)
        g["wx"] = p["embed"].T[None] @ dtable
        g["embed"] = (dtable @ p["wx"].transpose(0, 2, 1)).sum(axis=0)
        return float((whole - gold).mean()), g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 48, rate: float = 0.01,
              seed: int = 11) -> list[float]:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            some = rng.integers(0, len(x), min(batch, len(x)))
            loss, g = self.gradients(x[some], y[some])
            losses.append(loss)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            shrink, now = min(1.0, 5.0 / (norm + 1e-9)), rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                v = v * shrink
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                self.p[k] = (self.p[k] - now * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return losses
