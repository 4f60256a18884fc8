"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is an embedding of its hash and a sum of embeddings of its hashed character 3- and 4-grams. Both
directions' gates run over windows of words; attention weighs the states of a window, a linear layer gives its logit.
"""

from __future__ import annotations

import numpy as np

from proofmill.llm.words import word_hashes

WORDS, GRAMS = 1 << 13, 1 << 14
E, H, A = 8, 8, 8
WINDOW, STRIDE = 32, 16
#: Windows that are run through the gates together.
TOGETHER = 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Words:
    """Distinct words of some texts: buckets of their hashes and of their characters' n-grams."""

    def __init__(self, raws: list[bytes]):
        hashes, self.doc = word_hashes(raws)
        unique, first, self.index = np.unique(hashes, return_index=True, return_inverse=True)
        self.bucket = (unique >> np.uint64(50)).astype(np.int64) % WORDS
        tokens = b" ".join(raws).split()
        chosen = [tokens[i] for i in first.tolist()]
        x = np.frombuffer(b"".join(b"^" + w + b"$  " for w in chosen), np.uint8).astype(np.uint32)
        size = np.array([len(w) for w in chosen], np.int64)
        starts = np.concatenate([[0], np.cumsum(size + 4)[:-1]]) if len(size) else size
        three = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35)) if len(x) > 3 else x
        four = (three[:-1] * np.uint32(31)) ^ (x[3:] * np.uint32(0x27D4EB2F)) if len(x) > 3 else x
        # n-grams of one word, trigrams then 4-grams, at places starts[i] ... starts[i] + size[i] - 1
        word = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
        grams = [(g[at] * np.uint32(0x2C1B3C6D)) >> np.uint32(18) for g in (three, four)] if len(word) else [at, at]
        self.grams = np.stack(grams, 1).astype(np.int64)  # two buckets for each place
        self.size = size
        self.offsets = np.cumsum(size) - size

    def windows(self, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, length and text of all overlapping windows."""
        n = np.bincount(self.doc, minlength=n_docs)
        first = np.cumsum(n) - n
        per = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        doc = np.repeat(np.arange(n_docs), per)
        step = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        start = first[doc] + step * STRIDE
        return start, np.minimum(WINDOW, first[doc] + n[doc] - start), doc


class Network:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"words": 0.1 * draw(1, WORDS * E).reshape(WORDS, E), "grams": 0.1 * draw(1, GRAMS * E).reshape(GRAMS, E), "Wa": draw(2 * H, A), "va": draw(A, 1)[:, 0], "wo": draw(2 * H, 1)[:, 0], "bo": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": draw(2 * E, 3 * H), f"b{d}": np.zeros(3 * H, np.float32), f"U{d}": draw(H, 3 * H)}
        self.shift, self.scale = 0.0, 1.0

    def inputs(self, w: Words) -> np.ndarray:
        p = self.p
        both = p["grams"][w.grams[:, 0]] + p["grams"][w.grams[:, 1]]
        sums = np.add.reduceat(both, w.offsets, axis=0) if len(w.size) else both[:0]
        return np.concatenate([p["words"][w.bucket], sums / np.sqrt(w.size, dtype=np.float32)[:, None]], 1)

    def forward(self, gates: dict, index: np.ndarray, start: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows. gates: projected inputs of the distinct words for each direction."""
        p, n = self.p, len(start)
        steps = int(length.max(initial=0))
        place = np.minimum(start[:, None] + np.arange(steps)[None, :], len(index) - 1)
        mask = np.arange(steps)[None, :] < length[:, None]
        ids = index[place]
        states = np.zeros((n, steps, 2 * H), np.float32)
        saved = {"f": [], "b": []}
        for d, order, at in (("f", range(steps), slice(0, H)), ("b", range(steps - 1, -1, -1), slice(H, 2 * H))):
            h = np.zeros((n, H), np.float32)
            for t in order:
                x, u = gates[d][ids[:, t]], h @ p[f"U{d}"]
                zr = _sigmoid(x[:, : 2 * H] + u[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                new = np.tanh(x[:, 2 * H :] + r * u[:, 2 * H :])
                m = mask[:, t, None]
                after = np.where(m, (1 - z) * new + z * h, h)
                if keep:
                    saved[d].append((t, h, z, r, new, u[:, 2 * H :], m))
                h = after
                states[:, t, at] = h
        a = np.tanh(states @ p["Wa"])
        e = np.where(mask, a @ p["va"], -np.inf)
        alpha = np.exp(e - e.max(axis=1, keepdims=True))
        alpha /= alpha.sum(axis=1, keepdims=True)
        pooled = (alpha[:, :, None] * states).sum(axis=1)
        logit = pooled @ p["wo"] + p["bo"]
        return (logit, ids, mask, states, saved, a, alpha, pooled) if keep else logit

    def gates(self, x: np.ndarray) -> dict:
        return {d: x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"}

    def gradients(self, w: Words, start: np.ndarray, length: np.ndarray, y: np.ndarray, weight: np.ndarray, known: np.ndarray | None = None) -> dict:
        """Of the weighted logistic loss by all parameters (backpropagation through time). Words that aren't ``known``
        are read by their characters alone."""
        p = self.p
        x = self.inputs(w)
        if known is not None:
            x[:, :E] *= known[:, None]
        gates = self.gates(x)
        logit, ids, mask, states, saved, a, alpha, pooled = self.forward(gates, w.index, start, length, keep=True)
        dl = (weight * (_sigmoid(logit) - y)).astype(np.float32)
        g = {"wo": dl @ pooled, "bo": np.array([dl.sum()], np.float32)}
        dpooled = dl[:, None] * p["wo"]
        dstates = alpha[:, :, None] * dpooled[:, None, :]
        dalpha = (states * dpooled[:, None, :]).sum(axis=2)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=1, keepdims=True))
        da = de[:, :, None] * p["va"] * (1 - a * a)
        g["va"] = np.einsum("nt,nta->a", de, a)
        g["Wa"] = np.einsum("nts,nta->sa", states, da)
        dstates += da @ p["Wa"].T
        dx = np.zeros_like(x)
        for d, at in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            dgate = np.zeros_like(gates[d])
            dU, dh = np.zeros_like(p[f"U{d}"]), np.zeros((len(start), H), np.float32)
            for t, before, z, r, new, un, m in reversed(saved[d]):
                dh = dh + dstates[:, t, at]
                live = np.where(m, dh, 0)
                dnew = live * (1 - z) * (1 - new * new)
                dz = live * (before - new) * z * (1 - z)
                dr = dnew * un * r * (1 - r)
                du = np.concatenate([dz, dr, dnew * r], 1)
                np.add.at(dgate, ids[:, t], np.concatenate([dz, dr, dnew], 1))
                dU += before.T @ du
                dh = np.where(m, live * z, dh) + du @ p[f"U{d}"].T
            g[f"U{d}"], g[f"W{d}"], g[f"b{d}"] = dU, x.T @ dgate, dgate.sum(axis=0)
            dx += dgate @ p[f"W{d}"].T
        g["words"] = np.zeros_like(p["words"])
        np.add.at(g["words"], w.bucket, dx[:, :E] if known is None else dx[:, :E] * known[:, None])
        g["grams"] = np.zeros_like(p["grams"])
        spread = np.repeat(dx[:, E:] / np.sqrt(w.size, dtype=np.float32)[:, None], w.size, axis=0)
        for i in (0, 1):
            np.add.at(g["grams"], w.grams[:, i], spread)
        return g

    def logits(self, raws: list[bytes]) -> np.ndarray:
        """The greatest window logit of each text; -inf without words."""
        w = Words(raws)
        out = np.full(len(raws), -np.inf, np.float32)
        if len(w.index):
            start, length, doc = w.windows(len(raws))
            gates = self.gates(self.inputs(w))
            for a in range(0, len(start), TOGETHER):  # memory doesn't grow with a text's windows
                b = a + TOGETHER
                np.maximum.at(out, doc[a:b], self.forward(gates, w.index, start[a:b], length[a:b]))
        return out

    def scores(self, raws: list[bytes]) -> np.ndarray:
        """From 0 to 1; 0 for a text without words."""
        return _sigmoid(self.scale * (self.logits(raws).astype(np.float64) - self.shift) + np.log(0.7 / 0.3)) * (np.array([bool(r.strip()) for r in raws]))
