"""A bidirectional gated recurrent network over bytes in numpy, trained by backpropagation through time."""

from __future__ import annotations

import numpy as np

#: Sequences of one product when labelling.
ROWS = 2048


class BiGRU:
    """Labels every byte of a sequence with one of `classes`.

    A byte is read together with its two neighbours (an embedding of their hash). A step of either direction reads
    `patch` bytes, the sum of their embeddings; a byte's label follows from its own embedding and from both states at
    its step. Gates are piecewise linear, the candidate state is x / (1 + |x|). Axis 0 of W, U and b: forward, backward.
    """

    def __init__(self, classes: int, hidden: int = 16, patch: int = 8, width: int = 16, bits: int = 14, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, self.hidden, self.patch, self.bits = classes, hidden, patch, bits
        k = hidden
        p = {
            "E": rng.normal(0, 0.3, (1 << bits, width)), "W": rng.normal(0, (1 / width) ** 0.5, (2, 3 * k, width)), "U": rng.normal(0, (1 / k) ** 0.5, (2, 3 * k, k)),
            "b": np.zeros((2, 3 * k)), "O": rng.normal(0, (1 / k) ** 0.5, (classes, 2 * k)), "S": np.zeros((classes, width)), "o": np.zeros(classes),
        }
        p["W"][:, : 2 * k] *= 0.25
        p["U"][:, : 2 * k] *= 0.25
        p["b"][:, : 2 * k] = 0.5
        self.p = {n: v.astype(np.float32) for n, v in p.items()}
        self.p["E"][0] = 0

    def codes(self, values: np.ndarray) -> np.ndarray:
        """Slot of every byte of a text with its neighbours; slot 0 is padding."""
        h = values.astype(np.uint32)
        out = h * np.uint32(0x9E3779B1)
        out[1:] += h[:-1] * np.uint32(0x85EBCA6B)
        out[:-1] += h[1:] * np.uint32(0xC2B2AE35)
        out >>= np.uint32(32 - self.bits)
        return np.maximum(out, 1).astype(np.int32)

    def steps(self, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Slots of sequences codes[first : first + length] as (byte of the step, step, sequence), padded with 0."""
        t_max = max(1, -(-int(length.max(initial=1)) // self.patch))
        place = np.arange(self.patch)[:, None] + self.patch * np.arange(t_max)[None, :]
        out = codes.take(place[:, :, None] + first, mode="clip")
        out[place[:, :, None] >= length] = 0
        return out

    def _sums(self, slots: np.ndarray) -> np.ndarray:
        """Sums of the embeddings of every step's bytes: (steps, sequences, width)."""
        a = self.p["E"].take(slots[0], axis=0)
        for more in slots[1:]:
            a += self.p["E"].take(more, axis=0)
        return a

    def _walk(self, a: np.ndarray, length: np.ndarray, way: int, trail: list | None = None):
        """Yields (step, state) of one direction; sequences are sorted by falling length, only those that last so far are in a state."""
        k, t_max = self.hidden, len(a)
        w, u, b = self.p["W"][way], self.p["U"][way], self.p["b"][way][:, None]
        active = (-(-length // self.patch)[None, :] > np.arange(t_max)[:, None]).sum(axis=1)
        h = np.zeros((k, a.shape[1]), dtype=a.dtype)
        for t in range(t_max) if way == 0 else range(t_max - 1, -1, -1):
            m = active[t]
            old = h[:, :m].copy()
            g, gh = w @ a[t, :m].T, u @ old
            g += b
            zr = g[: 2 * k]
            zr += gh[: 2 * k]
            np.clip(zr, 0, 1, out=zr)
            c = zr[k:] * gh[2 * k :]
            c += g[2 * k :]
            c /= 1 + np.abs(c)
            new = c - old
            new *= 1 - zr[:k]
            new += old
            if trail is not None:
                trail.append((t, old, zr, c, gh[2 * k :]))
            h[:, :m] = new
            yield t, new

    def pooled(self, values: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For sequences of a text's bytes the sums over their bytes of the labels' scores: (sequences, classes).

        The softmax of such a sum is the product of the bytes' label probabilities, made to sum to 1.
        """
        out = np.zeros((len(first), self.classes), dtype=np.float32)
        order, k = np.argsort(-length, kind="stable"), self.hidden
        order, codes = order[length[order] > 0], self.codes(values)
        for i in range(0, len(order), ROWS):
            at = order[i : i + ROWS]
            n = length[at]
            a = self._sums(self.steps(codes, first[at], n))
            real = np.clip(n[None, :] - self.patch * np.arange(len(a))[:, None], 0, self.patch).astype(np.float32)
            total = np.zeros((2 * k, len(at)), dtype=np.float32)
            for way in (0, 1):
                for t, h in self._walk(a, n, way):
                    total[way * k : (way + 1) * k, : h.shape[1]] += h * real[t, : h.shape[1]]
            out[at] = (self.p["O"] @ total).T + a.sum(axis=0) @ self.p["S"].T + n[:, None] * self.p["o"]
        return out

    def _states(self, a: np.ndarray, length: np.ndarray, trails: tuple = (None, None)) -> np.ndarray:
        out = np.zeros((*a.shape[:2], 2 * self.hidden), dtype=a.dtype)
        for way in (0, 1):
            for t, h in self._walk(a, length, way, trails[way]):
                out[t, : h.shape[1], way * self.hidden : (way + 1) * self.hidden] = h.T
        return out

    def label(self, values: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Label probabilities of every byte of sequences sorted by falling length: (sequences, bytes, classes)."""
        slots = self.steps(self.codes(values), first, length)
        s = (self._states(self._sums(slots), length) @ self.p["O"].T)[None] + self.p["E"][slots] @ self.p["S"].T + self.p["o"]
        s = np.exp(s - s.max(axis=3, keepdims=True))
        return (s / s.sum(axis=3, keepdims=True)).transpose(2, 1, 0, 3).reshape(len(first), -1, self.classes)

    def train(self, values: np.ndarray, first: np.ndarray, length: np.ndarray, classes: np.ndarray, epochs: int, batch: int = 192, rate: float = 0.02, end: float = 0.1, seed: int = 11) -> float:
        """Fit every byte of sequences (bytes, first, length) to the class of its sequence with Adam; the last epoch's mean loss."""
        rng, codes = np.random.default_rng(seed), self.codes(values)
        m, v2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step, loss = 0, 0.0
        for epoch in range(epochs):
            order = np.argsort(-(length + rng.random(len(length)) * 12), kind="stable")
            starts = rng.permutation(np.arange(0, len(order), batch))
            now, total = rate * end ** (epoch / max(1, epochs - 1)), 0.0
            for i in starts:
                at = order[i : i + batch]
                at = at[np.argsort(-length[at], kind="stable")]
                grads, part = self.gradients(self.steps(codes, first[at], length[at]), length[at], classes[at])
                total, step = total + part, step + 1
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v2[k] += 0.001 * (g * g - v2[k])
                    self.p[k] -= now / (1 - 0.9**step) * m[k] / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-7)
            loss = total / max(1, len(starts))
        return loss

    def gradients(self, slots: np.ndarray, length: np.ndarray, classes: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the mean over sequences of the mean loss of a sequence's bytes, and that loss; sequences by falling length."""
        p, k, n, trails = self.p, self.hidden, slots.shape[2], ([], [])
        e, a = p["E"][slots], self._sums(slots)
        states = self._states(a, length, trails)
        s = (states @ p["O"].T)[None] + e @ p["S"].T + p["o"]
        s = np.exp(s - s.max(axis=3, keepdims=True))
        s /= s.sum(axis=3, keepdims=True)
        share = (slots > 0) / length / n
        own = np.take_along_axis(s, np.broadcast_to(classes[None, None, :, None], (*slots.shape, 1)), 3)[..., 0]
        loss = float(-(np.log(own + 1e-9) * share).sum())
        s[:, :, np.arange(n), classes] -= 1
        ds = (s * share[..., None]).astype(e.dtype)
        by_step = ds.sum(axis=0)
        grads = {"O": np.tensordot(by_step, states, ([0, 1], [0, 1])), "S": np.tensordot(ds, e, ([0, 1, 2], [0, 1, 2])), "o": ds.sum(axis=(0, 1, 2))}
        for name in ("W", "U", "b"):
            grads[name] = np.zeros_like(p[name])
        d, da = by_step @ p["O"], np.zeros_like(a)
        for way in (0, 1):
            dh = np.zeros((k, n), dtype=e.dtype)
            for t, h, zr, c, u in reversed(trails[way]):
                m, z, r = h.shape[1], zr[:k], zr[k:]
                got = dh[:, :m] + d[t, :m, way * k : (way + 1) * k].T
                dc = got * (1 - z) * (1 - np.abs(c)) ** 2
                gates = np.concatenate([got * (h - c), dc * u]) * ((zr > 0) & (zr < 1))
                dg, dgh = np.concatenate([gates, dc]), np.concatenate([gates, dc * r])
                dh[:, :m] = got * z + p["U"][way].T @ dgh
                grads["U"][way] += dgh @ h.T
                grads["W"][way] += dg @ a[t, :m]
                grads["b"][way] += dg.sum(axis=1)
                da[t, :m] += dg.T @ p["W"][way]
        de = ds @ p["S"] + da[None]
        flat = slots.ravel()
        order = np.argsort(flat, kind="stable")
        order = order[np.searchsorted(flat[order], 1) :]
        grads["E"] = np.zeros_like(p["E"])
        if len(order):
            starts = np.flatnonzero(np.append(True, np.diff(flat[order]) != 0))
            grads["E"][flat[order[starts]]] = np.add.reduceat(de.reshape(-1, de.shape[3])[order], starts, axis=0)
        return grads, loss
