"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Symbols: every ASCII character stands for itself (control characters, but tab and newline, for one another), then
#: other digits, other letters, other white space, the rest.  Zero is padding.
FIRST, OTHERS = 32, 4
CLASSES = 3 + (127 - FIRST) + OTHERS + 1
PAD = 0


def _class_table() -> np.ndarray:
    table = np.full(0x110000, CLASSES - 1, np.uint8)
    table[:FIRST] = 1
    table[9], table[10] = 2, 3
    table[FIRST:127] = 4 + np.arange(127 - FIRST)
    base = 4 + 127 - FIRST
    for c in range(127, 0x30000):
        x = chr(c)
        table[c] = base if x.isdigit() else base + 1 if x.isalpha() else base + 2 if x.isspace() else CLASSES - 1
    return table


_CLASS = _class_table()


def classes(text: str) -> np.ndarray:
    return _CLASS[np.frombuffer(text.encode("utf-32-le"), np.uint32)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Tagger:
    """Weights by name.  Labels: 0 outside, then begin and inside of each kind in turn."""

    w: dict[str, np.ndarray]
    hidden: int
    labels: int
    legal: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = self.labels
        self.legal = np.ones((n, n), bool)
        for inside in range(2, n, 2):
            self.legal[:, inside] = False
            self.legal[[inside - 1, inside], inside] = True

    @classmethod
    def new(cls, kinds: int, *, hidden: int = 24, width: int = 12, seed: int = 5) -> Tagger:
        rng, n = np.random.default_rng(seed), 1 + 2 * kinds
        g = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        w = {"e": rng.normal(0, 0.5, (CLASSES, width)).astype(np.float32), "o": g(2 * hidden, n), "bo": np.zeros(n, np.float32), "t": np.zeros((n, n), np.float32)}
        for d in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            w |= {"x" + d: g(width, 4 * hidden), "h" + d: g(hidden, 4 * hidden), "b" + d: bias}
        return cls(w, hidden, n)

    def transitions(self) -> np.ndarray:
        return np.where(self.legal, self.w["t"], np.float32(-1e4))

    def _run(self, z: np.ndarray, wh: np.ndarray, keep: list | None) -> np.ndarray:
        steps, batch, k = len(z), z.shape[1], self.hidden
        h, c = np.zeros((batch, k), np.float32), np.zeros((batch, k), np.float32)
        out = np.empty((steps, batch, k), np.float32)
        for t in range(steps):
            a = z[t] + h @ wh
            gate = _sigmoid(a)
            i, f, o = gate[:, :k], gate[:, k : 2 * k], gate[:, 3 * k :]
            g = np.tanh(a[:, 2 * k : 3 * k])
            before, was = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep is not None:
                keep.append((i, f, g, o, before, tc, was))
        return out

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores of each label; x: classes, time by batch."""
        e = self.w["e"][x]
        out = []
        for d in "fb":
            own = e if d == "f" else e[::-1]
            memory: list | None = [] if keep is not None else None
            h = self._run(own @ self.w["x" + d] + self.w["b" + d], self.w["h" + d], memory)
            if keep is not None:
                keep[d] = (own, memory)
            out.append(h if d == "f" else h[::-1])
        h = np.concatenate(out, 2)
        if keep is not None:
            keep["h"] = h
        return h @ self.w["o"] + self.w["bo"]

    def gradient(self, x: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the label paths and its gradient; live: which steps count."""
        keep: dict = {}
        s = self.emissions(x, keep).astype(np.float64)
        trans = self.transitions().astype(np.float64)
        steps, batch, n = s.shape
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[0] = s[0]
        lse = lambda v, a: (m := v.max(a, keepdims=True)).squeeze(a) + np.log(np.exp(v - m).sum(a))
        for t in range(1, steps):
            new = lse(alpha[t - 1][:, :, None] + trans[None], 1) + s[t]
            alpha[t] = np.where(live[t][:, None], new, alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            new = lse(trans[None] + (s[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(live[t + 1][:, None], new, beta[t + 1])
        z = lse(alpha[-1], 1)
        marginal = np.exp(alpha + beta - z[None, :, None]) * live[:, :, None]
        both, count = live[1:] & live[:-1], np.zeros((n, n))
        gold = np.zeros((n, n))
        for t in range(1, steps):
            pair = np.exp(alpha[t - 1][:, :, None] + trans[None] + (s[t] + beta[t])[:, None, :] - z[:, None, None])
            count += (pair * both[t - 1][:, None, None]).sum(0)
            np.add.at(gold, (y[t - 1][both[t - 1]], y[t][both[t - 1]]), 1)
        own = np.take_along_axis(s, y[:, :, None], 2)[:, :, 0]
        loss = z.sum() - (own * live).sum() - (trans[y[:-1], y[1:]] * both).sum()
        ds = marginal
        ds[np.arange(steps)[:, None], np.arange(batch)[None], y] -= live
        ds = (ds / batch).astype(np.float32)
        grad = {"t": ((count - gold) / batch * self.legal).astype(np.float32)}
        h, k = keep["h"], self.hidden
        grad["o"] = np.einsum("tbh,tbn->hn", h, ds)
        grad["bo"] = ds.sum((0, 1))
        dh = ds @ self.w["o"].T
        de = np.zeros((steps, batch, self.w["e"].shape[1]), np.float32)
        for d in "fb":
            own_e, memory = keep[d]
            up = dh[:, :, :k] if d == "f" else dh[::-1, :, k:]
            wh = self.w["h" + d]
            da = np.empty((steps, batch, 4 * k), np.float32)
            hn, cn = np.zeros((batch, k), np.float32), np.zeros((batch, k), np.float32)
            gw = np.zeros_like(wh)
            for t in range(steps - 1, -1, -1):
                i, f, g, o, before, tc, was = memory[t]
                hh = up[t] + hn
                cc = cn + hh * o * (1 - tc * tc)
                a = da[t]
                a[:, :k] = cc * g * i * (1 - i)
                a[:, k : 2 * k] = cc * before * f * (1 - f)
                a[:, 2 * k : 3 * k] = cc * i * (1 - g * g)
                a[:, 3 * k :] = hh * tc * o * (1 - o)
                cn = cc * f
                hn = a @ wh.T
                gw += was.T @ a
            grad["h" + d], grad["x" + d] = gw, np.einsum("tbe,tbk->ek", own_e, da)
            grad["b" + d] = da.sum((0, 1))
            back = da @ self.w["x" + d].T
            de += back if d == "f" else back[::-1]
        ge = np.zeros_like(self.w["e"])
        np.add.at(ge, x.ravel(), de.reshape(-1, de.shape[2]))
        grad["e"] = ge
        return loss / batch, grad

    def train(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, *, epochs: int = 5, batch: int = 48, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(v) for k, v in self.w.items()}
        for epoch in range(epochs):
            total, order = 0.0, rng.permutation(x.shape[1])
            for lo in range(0, len(order), batch):
                at = order[lo : lo + batch]
                loss, grad = self.gradient(x[:, at], y[:, at], live[:, at])
                total, step = total + loss * len(at), step + 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                now = rate * (1 - epoch / epochs) * min(1.0, 5 / max(size, 1e-9))
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.w[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
            losses.append(total / max(1, len(order)))
        return losses

    def decode(self, s: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Best label paths; s: scores, time by batch by label; dead steps at the end get label 0."""
        trans = self.transitions()
        steps, batch, _ = s.shape
        back = np.zeros(s.shape, np.uint8)
        best = s[0].copy()
        for t in range(1, steps):
            v = best[:, :, None] + trans[None]
            back[t] = v.argmax(1)
            best = np.where(live[t][:, None], v.max(1) + s[t], best)
        out = np.zeros((steps, batch), np.uint8)
        label, rows = best.argmax(1), np.arange(batch)
        for t in range(steps - 1, -1, -1):
            out[t] = np.where(live[t], label, 0)
            if t:
                label = np.where(live[t], back[t][rows, label], label)
        return out
