"""One training step of the encoder, for speed: the same sums as ``encoder.forward``, ``hierarchical_loss`` and ``backward``.

Arrays are [time * batch, channels] with both views in one array, so a dilated tap is a range of rows and nothing is copied
for it.  View one ends and view two begins with the common part: where blocks no longer look beyond their own step, the
common rows of both are one range, and the others are left out.  Buffers are made once for the longest views.
"""

from __future__ import annotations

import math

import numpy as np

#: Numbers that the optimiser takes at a time: its arrays' parts stay in the cache.
PART, SIGN = 1 << 14, np.uint32(1 << 31)


def gelu(x: np.ndarray, g: np.ndarray, s: np.ndarray, t: np.ndarray, q: np.ndarray) -> None:
    """gelu of x into g and its slope into s; t and q are scratch."""
    np.abs(x, out=t)
    t *= 0.3275911 / math.sqrt(2)
    t += 1
    np.divide(1, t, out=t)
    np.multiply(x, x, out=s)
    s *= -0.5
    np.exp(s, out=s)
    np.multiply(t, 0.5 * 1.061405429, out=q)
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        q += 0.5 * c
        q *= t
    q *= s  # half the tails' probability
    np.subtract(0.5, q, out=q)
    sign, bits = t.view(np.uint32), q.view(np.uint32)
    np.bitwise_and(x.view(np.uint32), SIGN, out=sign)
    np.bitwise_or(bits, sign, out=bits)  # copysign, which isn't vectorised
    q += 0.5
    np.multiply(x, q, out=g)
    s *= x
    s *= 1 / math.sqrt(2 * math.pi)
    s += q


def info_nce(z: np.ndarray) -> tuple[float, np.ndarray]:
    """As ``encoder.info_nce``; diagonals are views of the flat products."""
    groups, twice, _ = z.shape
    n = twice // 2
    e = np.matmul(z, z.transpose(0, 2, 1))
    line = e.reshape(groups, -1)
    own, up, down = line[:, :: twice + 1], line[:, n : n * twice : twice + 1], line[:, n * twice :: twice + 1]
    own[...] = -np.inf
    mates = float(up.sum(dtype=float) + down.sum(dtype=float))
    top = e.max(2, keepdims=True)
    e -= top
    np.exp(e, out=e)
    total = e.sum(2, keepdims=True)
    loss = (float(top.sum(dtype=float) + np.log(total).sum(dtype=float)) - mates) / (groups * twice)
    total *= groups * twice
    e /= total
    up -= 1 / (groups * twice)
    down -= 1 / (groups * twice)
    d = np.matmul(e, z)
    d += np.matmul(e.transpose(0, 2, 1), z)
    return loss, d


def hierarchical_loss(z: np.ndarray, share: float = 0.5) -> tuple[float, np.ndarray]:
    """As ``encoder.hierarchical_loss``, of [two views, time, batch, channels]."""
    levels, loss = [], 0.0
    while True:
        _, t, n, c = z.shape
        dz = np.zeros(z.shape, z.dtype)
        if n > 1:
            one, d = info_nce(z.transpose(1, 0, 2, 3).reshape(t, 2 * n, c))
            loss += share * one
            d *= share
            dz += d.reshape(t, 2, n, c).transpose(1, 0, 2, 3)
        if t > 1:
            one, d = info_nce(z.transpose(2, 0, 1, 3).reshape(n, 2 * t, c))
            loss += (1 - share) * one
            d *= 1 - share
            dz += d.reshape(n, 2, t, c).transpose(1, 2, 0, 3)
        if t == 1:
            levels.append((dz, None))
            break
        one, two = z[:, 0 : t - 1 : 2], z[:, 1:t:2]
        levels.append((dz, one >= two))
        z = np.maximum(one, two)
    for (dz, first), (below, _) in zip(levels[-2::-1], levels[:0:-1], strict=True):
        t = dz.shape[1]
        dz[:, 0 : t - 1 : 2] += below * first
        dz[:, 1:t:2] += below * ~first
    dz = levels[0][0]
    dz /= len(levels)
    return loss / len(levels), dz


class Steps:
    """Parameters, their averages and the optimiser's moments, each in one vector.  Taps that no window of so many steps meets
    stand at its end: their slopes are always zero, so they only decay."""

    def __init__(self, p: dict[str, np.ndarray], steps: int, batch: int):
        self.batch, self.last = batch, max(int(k.split(".")[0]) for k in p if k[0].isdigit())
        taps = {k: [(k, j) for j in range(len(v))] if v.ndim == 3 else [(k, None)] for k, v in p.items()}
        beyond = lambda at: at[1] is not None and at[1] != len(p[at[0]]) // 2 and abs(at[1] - len(p[at[0]]) // 2) << int(at[0].split(".")[0]) >= steps
        self.order = sorted((at for own in taps.values() for at in own), key=beyond)
        part = {at: p[at[0]] if at[1] is None else p[at[0]][at[1]] for at in self.order}
        self.shapes = {k: v.shape for k, v in p.items()}
        self.p = np.concatenate([part[at].ravel() for at in self.order]).astype(np.float32)
        self.live = sum(part[at].size for at in self.order if not beyond(at))
        self.g, self.m1, self.m2 = (np.zeros(self.live, np.float32) for _ in range(3))
        self.mean, self.n = self.p.copy(), 0
        self.w, self.dw, at = {}, {}, 0
        for k in self.order:
            size = part[k].size
            self.w[k] = self.p[at : at + size].reshape(part[k].shape)
            if at < self.live:
                self.dw[k] = self.g[at : at + size].reshape(part[k].shape)
            at += size
        rows = 2 * steps * batch
        hidden, out = p[f"{self.last}.w1"].shape[1:]
        new = lambda c: np.empty((rows, c), np.float32)
        self.kept = [[new(c) for c in (hidden, hidden, b, b)] for b in [hidden] * self.last + [out]]
        self.h = [new(hidden), new(out)]
        self.scratch = {c: [[new(c) for _ in range(2)] for _ in range(3)] for c in {hidden, out}}
        self.bias = {f"{i}.w{k}": (f"{i}.b{k}", None) for i in range(self.last + 1) for k in (1, 2)}
        self.ones = np.ones(rows, np.float32)

    def room(self, k: int, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        one, two = self.scratch[width][k]
        return one[:rows], two[:rows]

    def shifted(self, i: int, ends: list[tuple[int, int]]):
        """(tap, output rows, input rows) of the taps beside the middle one."""
        off = self.batch << i
        for a, b in ends:
            if b - a > off:
                yield 0, slice(a + off, b), slice(a, b - off)
                yield 2, slice(a, b - off), slice(a + off, b)

    def conv(self, x, y, name, i, ends):
        np.matmul(x, self.w[name, 1], out=y)
        y += self.w[self.bias[name]]
        for k, o, n in self.shifted(i, ends):
            part = self.room(0, o.stop - o.start, y.shape[1])[0]
            np.matmul(x[n], self.w[name, k], out=part)
            y[o] += part

    def conv_back(self, dy, x, dx, name, i, ends):
        np.matmul(dy, self.w[name, 1].T, out=dx)
        np.matmul(x.T, dy, out=self.dw[name, 1])
        np.matmul(self.ones[: len(dy)], dy, out=self.dw[self.bias[name]])
        for k, o, n in self.shifted(i, ends):
            part = self.room(0, o.stop - o.start, dx.shape[1])[0]
            np.matmul(dy[o], self.w[name, k].T, out=part)
            dx[n] += part
            self.dw[name, k] += x[n].T @ dy[o]

    def slopes(self, x: np.ndarray, show: np.ndarray, first: int, common: int) -> float:
        """The loss, its slopes into ``g``.  ``x`` has the ``first`` steps of view one and then view two's, [time, batch, channels], without
        NaN; hidden steps are zeros after the input layer."""
        b, w = self.batch, self.w
        self.g.fill(0)
        x, show = x.reshape(-1, x.shape[2]), show.reshape(-1, 1).astype(np.float32)
        cut, ends = slice((first - common) * b, (first + common) * b), [(0, first * b), (first * b, len(x))]
        h = self.h[0][: len(x)]
        np.matmul(x, w["in.w", None], out=h)
        h += w["in.b", None]
        h *= show
        full, whole = self.last + 1, len(x)  # from block ``full`` on only common rows are taken
        for i in range(self.last + 1):
            if full > i and all(b << i >= z - a for a, z in ends):
                h, full, ends = h[cut], i, []
            g1, s1, g2, s2 = (a[: len(h)] for a in self.kept[i])
            gelu(h, g1, s1, *self.room(1, *g1.shape))
            c = self.room(2, *g2.shape)[0]
            self.conv(g1, c, f"{i}.w1", i, ends)
            gelu(c, g2, s2, *self.room(1, *g2.shape))
            self.conv(g2, c, f"{i}.w2", i, ends)
            if (f"{i}.w0", None) in w:
                self.top = h
                y = self.h[1][: len(h)]
                np.matmul(h, w[f"{i}.w0", None], out=y)
                y += w[f"{i}.b0", None]
                y += c
                h = y
            else:
                h += c
        z = h if full <= self.last else h[cut]
        loss, dz = hierarchical_loss(z.reshape(2, common, b, -1))
        dz = dz.reshape(2 * common * b, -1)
        if full > self.last:
            dh = np.zeros((whole, dz.shape[1]), np.float32)
            dh[cut] = dz
        else:
            dh = dz
        for i in range(self.last, -1, -1):
            ends = [] if i >= full else [(0, first * b), (first * b, whole)]
            if i == full - 1 and full <= self.last:
                dh, narrow = np.zeros((whole, dh.shape[1]), np.float32), dh
                dh[cut] = narrow
            g1, s1, g2, s2 = (a[: len(dh)] for a in self.kept[i])
            d2 = self.room(1, *g2.shape)[0]
            self.conv_back(dh, g2, d2, f"{i}.w2", i, ends)
            d2 *= s2
            d1 = self.room(2, *g1.shape)[0]
            self.conv_back(d2, g1, d1, f"{i}.w1", i, ends)
            d1 *= s1
            if (f"{i}.w0", None) in w:
                np.matmul(self.top.T, dh, out=self.dw[f"{i}.w0", None])
                np.matmul(self.ones[: len(dh)], dh, out=self.dw[f"{i}.b0", None])
                dh = dh @ w[f"{i}.w0", None].T
            dh += d1
        if full == 0:
            x, show = x[cut], show[cut]
        dh *= show
        np.matmul(x.T, dh, out=self.dw["in.w", None])
        np.matmul(self.ones[: len(dh)], dh, out=self.dw["in.b", None])
        return loss

    def update(self, rate: float, decay: float) -> None:
        """Adam with decoupled decay, and the average of the weights over all steps."""
        self.n += 1
        one, two, keep = rate / (1 - 0.9**self.n), 1 / (1 - 0.999**self.n), 1 - rate * decay
        t = np.empty(PART, np.float32)
        for a in range(0, len(self.p), PART):
            p, mean = self.p[a : a + PART], self.mean[a : a + PART]
            p *= keep
            if a < self.live:
                g, m1, m2 = (v[a : a + PART] for v in (self.g, self.m1, self.m2))
                q = t[: len(g)]
                m1 *= 0.9
                np.multiply(g, 0.1, out=q)
                m1 += q
                m2 *= 0.999
                np.multiply(g, g, out=q)
                q *= 0.001
                m2 += q
                np.multiply(m2, two, out=q)
                np.sqrt(q, out=q)
                q += 1e-8
                np.divide(m1, q, out=q)
                q *= one
                p[: len(g)] -= q
            q = t[: len(p)]
            np.subtract(p, mean, out=q)
            q *= 1 / self.n
            mean += q

    def named(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Arrays by name, as they came, of one of the vectors; of ``g``, zeros for what it lacks."""
        out, at = {k: np.zeros(s, np.float32) for k, s in self.shapes.items()}, 0
        for k, tap in self.order:
            into = out[k] if tap is None else out[k][tap]
            if at < len(flat):
                into[...] = flat[at : at + into.size].reshape(into.shape)
            at += into.size
        return out
