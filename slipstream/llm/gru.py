"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word's input joins a learned word vector with the largest components of learned vectors of its
character n-grams, so unknown words are read by their characters. Two recurrent passes read a window; an
attention weight per word pools their states; a logistic unit scores the window.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 4
NGRAMS, NGRAM_BITS = (3, 5, 7), 17
KEPT_INPUTS, NEW_INPUTS = 150_000, 20_000
EMBEDDING_RATE = 0.1
"""Vectors of rare words move slowly, or small samples are learned by heart."""
UNKNOWN = 0

_MARK = b"\x02"


def character_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of the marked words, one word after the other, and where each word starts."""
    text = np.frombuffer(_MARK + _MARK.join(words) + _MARK + bytes(max(NGRAMS)), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    owner = np.repeat(np.arange(len(words)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)  # the mark after the word
    at = np.arange(len(owner))
    codes, owners = [], []
    for n in NGRAMS:
        code = np.full(len(owner), n, np.uint64)
        for k in range(n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + text[k : k + len(owner)] + np.uint64(1)
        inside = at + n - 1 <= end
        codes.append(((code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - NGRAM_BITS))[inside].astype(np.int32))
        owners.append(owner[inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    return np.concatenate(codes)[order], np.cumsum(counts) - counts


def top_by_word(table: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(table[codes], starts, axis=0)


@dataclass
class Network:
    vocabulary: dict[bytes, int]
    weights: dict[str, np.ndarray]
    constant: float | None = None
    _inputs: dict = field(default_factory=dict, repr=False)
    _rows: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def fresh(cls, vocabulary: dict[bytes, int], word_prior: np.ndarray, char_prior: np.ndarray, seed: int = 7) -> Network:
        """The priors, one number a word or n-gram bucket, start the first components of the vectors."""
        g = np.random.default_rng(seed)
        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        put = lambda *shape, scale=0.3: (g.standard_normal(shape) * scale).astype(np.float32)
        word, char = put(len(word_prior), WORD_DIM, scale=0.05), put(1 << NGRAM_BITS, CHAR_DIM, scale=0.05)
        word[:, 0], char[:, 0] = word_prior, char_prior
        weights = {"word": word, "char": char, "att": put(2 * h), "out": put(2 * h)}
        for way in "fb":
            weights |= {f"W{way}": put(d, 3 * h), f"U{way}": put(h, 3 * h), f"b{way}": np.zeros(3 * h, np.float32)}
        weights["bias"] = np.array([-1.0], np.float32)
        return cls(vocabulary, weights)

    # scoring

    def rows_of(self, words: list[bytes]) -> np.ndarray:
        """Row of each word in the table of projected inputs; new words are added, a full table is begun anew."""
        known = self._inputs
        new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > KEPT_INPUTS or self._rows is None:
            known.clear()
            new = list(dict.fromkeys(words))
            self._rows = np.empty((max(KEPT_INPUTS, len(new)), 6 * HIDDEN), np.float32)
        for i in range(0, len(new), NEW_INPUTS):
            w, some, at = self.weights, new[i : i + NEW_INPUTS], len(known)
            ids = np.fromiter((self.vocabulary.get(x, UNKNOWN) for x in some), np.int64, len(some))
            x = np.hstack([w["word"][ids], top_by_word(w["char"], *character_features(some))])
            self._rows[at : at + len(some)] = np.hstack([x @ w["Wf"] + w["bf"], x @ w["Wb"] + w["bb"]])
            known.update(zip(some, range(at, at + len(some))))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def window_scores(self, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, block: int = 2048) -> np.ndarray:
        """Scores of the windows rows[start : start + length]."""
        out = np.empty(len(starts), np.float32)
        by_length = np.argsort(-lengths, kind="stable")
        for i in range(0, len(starts), block):
            pick = by_length[i : i + block]
            n = lengths[pick]
            t = np.arange(n.max())
            ids = rows[np.minimum(starts[pick, None] + t, len(rows) - 1)]
            out[pick] = self._run(ids, n)
        return out

    def _run(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``n`` falls, so the windows still running at a word are the first ones."""
        w, h = self.weights, HIDDEN
        count, width = ids.shape
        running = np.searchsorted(-n, -np.arange(width), side="left")
        states = np.zeros((width, count, 2 * h), np.float32)
        for way, steps in (("f", range(width)), ("b", range(width - 1, -1, -1))):
            u, shift = w[f"U{way}"], 0 if way == "f" else 3 * h
            state = np.zeros((count, h), np.float32)
            for t in steps:
                k = running[t]
                x = self._rows[ids[:k, t], shift : shift + 3 * h]
                s = state[:k]
                y = s @ u
                gates = np.tanh(0.5 * (x[:, : 2 * h] + y[:, : 2 * h])) * 0.5 + 0.5
                new = np.tanh(x[:, 2 * h :] + gates[:, h:] * y[:, 2 * h :])
                s += (1 - gates[:, :h]) * (new - s)
                states[t, :k, (0 if way == "f" else h) : (h if way == "f" else 2 * h)] = s
        e = states @ w["att"]
        e[np.arange(width)[:, None] >= n[None, :]] = -1e30
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        logit = ((states @ w["out"]) * e).sum(axis=0) + w["bias"][0]
        return 0.5 + 0.5 * np.tanh(0.5 * logit)

    # training

    def gradients(self, ids: np.ndarray, chars: np.ndarray, n: np.ndarray, target: np.ndarray):
        """Loss and gradients over a batch: word ids, character vectors (count, width, CHAR_DIM), lengths."""
        w, h = self.weights, HIDDEN
        count, width = ids.shape
        x = np.concatenate([w["word"][ids], chars], axis=2)
        live = (np.arange(width)[None, :] < n[:, None]).astype(np.float32)
        states = np.zeros((count, width, 2 * h), np.float32)
        kept = {}
        for way, steps in (("f", range(width)), ("b", range(width - 1, -1, -1))):
            u, project = w[f"U{way}"], x @ w[f"W{way}"] + w[f"b{way}"]
            s, trace = np.zeros((count, h), np.float32), []
            for t in steps:
                y = s @ u
                g = 0.5 + 0.5 * np.tanh(0.5 * (project[:, t, : 2 * h] + y[:, : 2 * h]))
                new = np.tanh(project[:, t, 2 * h :] + g[:, h:] * y[:, 2 * h :])
                m = live[:, t, None]
                trace.append((t, s, y, g, new, m))
                s = s + m * (1 - g[:, :h]) * (new - s)
                states[:, t, slice(0, h) if way == "f" else slice(h, 2 * h)] = s
            kept[way] = trace
        e = states @ w["att"]
        e = np.where(live > 0, e, -1e30)
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        value = states @ w["out"]
        logit = (a * value).sum(axis=1) + w["bias"][0]
        p = 0.5 + 0.5 * np.tanh(0.5 * logit)
        loss = -np.mean(target * np.log(p + 1e-7) + (1 - target) * np.log(1 - p + 1e-7))

        d = ((p - target) / count).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in w.items() if k != "char"}
        grad["bias"][0] = d.sum()
        d_value = a * d[:, None]
        d_e = a * (value - (a * value).sum(axis=1, keepdims=True)) * d[:, None]
        grad["out"] = np.einsum("bt,bth->h", d_value, states)
        grad["att"] = np.einsum("bt,bth->h", d_e, states)
        d_states = d_value[:, :, None] * w["out"] + d_e[:, :, None] * w["att"]
        d_x = np.zeros_like(x)
        for way in "fb":
            u, half = w[f"U{way}"], slice(0, h) if way == "f" else slice(h, 2 * h)
            ds = np.zeros((count, h), np.float32)
            d_project = np.zeros((count, width, 3 * h), np.float32)
            for t, s, y, g, new, m in reversed(kept[way]):
                ds = ds + d_states[:, t, half]
                z, r = g[:, :h], g[:, h:]
                step = m * ds
                d_new = step * (1 - z) * (1 - new * new)
                d_z = -step * (new - s) * z * (1 - z)
                d_r = d_new * y[:, 2 * h :] * r * (1 - r)
                d_y = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_project[:, t] = np.concatenate([d_z, d_r, d_new], axis=1)
                grad[f"U{way}"] += s.T @ d_y
                ds = ds - step * (1 - z) + d_y @ u.T
            grad[f"W{way}"] = np.einsum("btd,btk->dk", x, d_project)
            grad[f"b{way}"] = d_project.sum(axis=(0, 1))
            d_x += d_project @ w[f"W{way}"].T
        d_x *= live[:, :, None]
        np.add.at(grad["word"], ids.reshape(-1), d_x[:, :, :WORD_DIM].reshape(-1, WORD_DIM))
        return loss, grad, d_x[:, :, WORD_DIM:]


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.01):
        self.weights, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grad: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grad.items():
            m, v = self.m[k], self.v[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            rate = scale * EMBEDDING_RATE if k in ("word", "char") else scale
            self.weights[k] -= rate * m / (np.sqrt(v) + 1e-8)
