"""A gated-attention network over bags of passages, in numpy, with its gradients.

A passage is the mean of learned vectors of its words and of their shapes, beside a few measures. A
hidden layer encodes every passage; gated attention, tanh(V h) * sigmoid(U h), weighs the passages of a
document; the weighted sum is the document's representation and gives its logit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WORD_BITS, SHAPE_BITS = 14, 11
VECTOR, HIDDEN, GATES = 24, 32, 16


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Bags:
    """Passages of several documents in a row.

    ``words`` and ``shapes`` are codes of all words; passage i starts at ``starts[i]`` there and has the
    measures ``measures[i]``; document d starts at passage ``docs[d]``.
    """

    words: np.ndarray
    shapes: np.ndarray
    starts: np.ndarray
    measures: np.ndarray
    docs: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.words)))

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(np.append(self.docs, len(self.starts)))


class Network:
    def __init__(self, weights: dict[str, np.ndarray], constant: float | None = None):
        self.weights = weights
        self.constant = constant

    @classmethod
    def fresh(cls, measures: int, seed: int) -> Network:
        g = np.random.default_rng(seed)
        make = lambda *shape: (g.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        small = lambda *shape: (0.1 * g.standard_normal(shape)).astype(np.float32)
        return cls(
            {
                "word": small(1 << WORD_BITS, VECTOR), "shape": small(1 << SHAPE_BITS, VECTOR),
                "W": make(VECTOR + measures, HIDDEN), "b": np.zeros(HIDDEN, np.float32),
                "V": make(HIDDEN, GATES), "U": make(HIDDEN, GATES), "a": make(GATES, 1)[:, 0],
                "c": make(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32),
            }
        )

    def means(self, bags: Bags, at_once: int = 4096) -> np.ndarray:
        """The mean vector of each passage, made in stretches to bound the memory."""
        w, out = self.weights, np.empty((len(bags.starts), VECTOR), np.float32)
        ends = np.append(bags.starts, len(bags.words))
        for i in range(0, len(bags.starts), at_once):
            part = slice(bags.starts[i], ends[min(i + at_once, len(bags.starts))])
            vectors = w["word"][bags.words[part]]
            vectors += w["shape"][bags.shapes[part]]
            out[i : i + at_once] = np.add.reduceat(vectors, bags.starts[i : i + at_once] - bags.starts[i], axis=0)
        return out / bags.sizes[:, None].astype(np.float32)

    def forward(self, bags: Bags) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.concatenate([self.means(bags), bags.measures], axis=1)
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
        s = (t * g) @ w["a"]
        n = bags.per_doc
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, bags.docs), n))
        weight = e / np.repeat(np.add.reduceat(e, bags.docs), n)
        z = np.add.reduceat(h * weight[:, None], bags.docs, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "weight": weight, "z": z, "logit": z @ w["c"] + w["d"]}

    def scores(self, bags: Bags) -> np.ndarray:
        return sigmoid(self.forward(bags)["logit"].astype(np.float64))

    def gradients(self, bags: Bags, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of documents with labels ``y``, and its gradients."""
        w, f, n = self.weights, self.forward(bags), bags.per_doc
        p = sigmoid(f["logit"])
        loss = float(-np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))
        d_logit = ((p - y) / len(y)).astype(np.float32)
        grad = {"c": f["z"].T @ d_logit, "d": np.array([d_logit.sum()], np.float32)}
        d_z = np.repeat(d_logit[:, None] * w["c"], n, axis=0)
        a = f["weight"]
        d_a = (f["h"] * d_z).sum(axis=1)
        d_s = a * (d_a - np.repeat(np.add.reduceat(a * d_a, bags.docs), n))
        d_h = a[:, None] * d_z
        grad["a"] = (f["t"] * f["g"]).T @ d_s
        d_t = d_s[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2)
        d_g = d_s[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
        grad["V"], grad["U"] = f["h"].T @ d_t, f["h"].T @ d_g
        d_h = (d_h + d_t @ w["V"].T + d_g @ w["U"].T) * (1 - f["h"] ** 2)
        grad["W"], grad["b"] = f["x"].T @ d_h, d_h.sum(axis=0)
        d_mean = (d_h @ w["W"].T)[:, :VECTOR] / bags.sizes[:, None]
        passage = np.repeat(np.arange(len(bags.starts)), bags.sizes)
        for name, codes in (("word", bags.words), ("shape", bags.shapes)):
            order = np.argsort(codes, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
            grad[name] = np.zeros_like(w[name])
            grad[name][codes[order][first]] = np.add.reduceat(d_mean[passage[order]], first, axis=0)
        return loss, grad


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.01, decay: float = 1e-4):
        self.weights, self.rate, self.decay, self.steps = weights, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grad: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            mean = self.m[k] / (1 - 0.9**self.steps)
            spread = np.sqrt(self.v[k] / (1 - 0.99**self.steps)) + 1e-8
            self.weights[k] -= (self.rate * (mean / spread + self.decay * self.weights[k])).astype(np.float32)
