"""A dilated convolutional encoder of windows and its contrastive training, in numpy.

Arrays are [batch, time, channels].  A tap of a dilated convolution that falls outside the window for every position adds
nothing, so it is left out: with 48 steps, blocks with dilations of 64 and more are single matrix products.
"""

from __future__ import annotations

import io
import math
from dataclasses import dataclass, field

import numpy as np

from tidegrid.functions.steps import Steps

DEPTH, HIDDEN, OUT, KERNEL = 10, 64, 64, 3


def phi(x: np.ndarray) -> np.ndarray:
    """Normal distribution function, by a rational approximation of erf with an error below 1.5e-7."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return 0.5 * (1 + np.sign(x) * erf)


def gelu(x: np.ndarray) -> np.ndarray:
    return x * phi(x)


def gelu_with_slope(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gelu, its slope) with one exponential for both, in the precision of ``x``."""
    t = 1 / (1 + 0.3275911 / math.sqrt(2) * np.abs(x))
    e = np.exp(-0.5 * x * x)
    tail = np.full_like(t, 1.061405429)
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        tail *= t
        tail += c
    tail *= t
    tail *= e
    p = 0.5 * (1 + np.copysign(1 - tail, x))
    e *= x
    e *= 1 / math.sqrt(2 * math.pi)
    return x * p, p + e


def init(inputs: int = 7, depth: int = DEPTH, hidden: int = HIDDEN, out: int = OUT, seed: int = 42) -> dict[str, np.ndarray]:
    """Parameters by name; uniform within 1 / sqrt(fan-in)."""
    rng = np.random.default_rng(seed)
    u = lambda fan, *shape: rng.uniform(-1, 1, shape) / math.sqrt(fan)
    p = {"in.w": u(inputs, inputs, hidden), "in.b": u(inputs, hidden)}
    for i in range(depth + 1):
        a, b = hidden, out if i == depth else hidden
        p[f"{i}.w1"], p[f"{i}.b1"] = u(KERNEL * a, KERNEL, a, b), u(KERNEL * a, b)
        p[f"{i}.w2"], p[f"{i}.b2"] = u(KERNEL * b, KERNEL, b, b), u(KERNEL * b, b)
    p[f"{depth}.w0"], p[f"{depth}.b0"] = u(hidden, hidden, out), u(hidden, out)
    return p


def _taps(steps: int, dilation: int):
    """(tap, output slice, input slice) of the taps that meet the window."""
    half = KERNEL // 2
    for k in range(KERNEL):
        off = (k - half) * dilation
        if abs(off) < steps:
            yield k, slice(max(0, -off), steps - max(0, off)), slice(max(0, off), steps + min(0, off))


def conv(x: np.ndarray, w: np.ndarray, b: np.ndarray, dilation: int) -> np.ndarray:
    y = np.broadcast_to(b, (*x.shape[:2], w.shape[2])).copy()
    for k, o, i in _taps(x.shape[1], dilation):
        y[:, o] += flat(x[:, i], w[k])
    return y


def flat(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w as one product of matrices."""
    return (x.reshape(-1, x.shape[2]) @ w).reshape(*x.shape[:2], -1)


def crossed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums over batch and time of the outer products of channels."""
    return x.reshape(-1, x.shape[2]).T @ y.reshape(-1, y.shape[2])


def conv_back(dy: np.ndarray, x: np.ndarray, w: np.ndarray, dilation: int):
    dx, dw = np.zeros_like(x), np.zeros_like(w)
    for k, o, i in _taps(x.shape[1], dilation):
        dx[:, i] += flat(dy[:, o], w[k].T)
        dw[k] += crossed(x[:, i], dy[:, o])
    return dx, dw, dy.sum((0, 1))


def depth_of(p: dict) -> int:
    return max(int(k.split(".")[0]) for k in p if k[0].isdigit())


def forward(p: dict, x: np.ndarray, mask: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
    """Representations of every step.  Steps with a NaN are taken as zeros after the input layer, as masked ones are."""
    fine = ~np.isnan(x).any(-1)
    show = fine if mask is None else fine & mask
    x = np.where(fine[..., None], x, 0)
    h = (x @ p["in.w"] + p["in.b"]) * show[..., None]
    if keep is not None:
        keep.append((x, show))
    last = depth_of(p)
    for i in range(last + 1):
        g1, s1 = gelu_with_slope(h)
        g2, s2 = gelu_with_slope(conv(g1, p[f"{i}.w1"], p[f"{i}.b1"], 2**i))
        c2 = conv(g2, p[f"{i}.w2"], p[f"{i}.b2"], 2**i)
        if keep is not None:
            keep.append((h, g1, s1, g2, s2))
        h = c2 + (h @ p[f"{i}.w0"] + p[f"{i}.b0"] if f"{i}.w0" in p else h)
    return h


def backward(p: dict, kept: list, dh: np.ndarray) -> dict[str, np.ndarray]:
    g = {}
    for i in range(depth_of(p), -1, -1):
        h, g1, s1, g2, s2 = kept[i + 1]
        dg2, g[f"{i}.w2"], g[f"{i}.b2"] = conv_back(dh, g2, p[f"{i}.w2"], 2**i)
        dg1, g[f"{i}.w1"], g[f"{i}.b1"] = conv_back(dg2 * s2, g1, p[f"{i}.w1"], 2**i)
        if f"{i}.w0" in p:
            g[f"{i}.w0"], g[f"{i}.b0"] = crossed(h, dh), dh.sum((0, 1))
            dh = dh @ p[f"{i}.w0"].T
        dh = dh + dg1 * s1
    x, show = kept[0]
    dh = dh * show[..., None]
    g["in.w"], g["in.b"] = crossed(x, dh), dh.sum((0, 1))
    return g


def make_mask(kind: str, shape: tuple[int, int], rng: np.random.Generator, share: float = 0.5) -> np.ndarray:
    """Which steps are shown: binomial, continuous (a few stretches hidden), all_true, all_false or mask_last."""
    m = np.ones(shape, bool)
    if kind == "binomial":
        return rng.random(shape) < share
    if kind == "all_false":
        return ~m
    if kind == "mask_last":
        m[:, -1] = False
    elif kind == "continuous":
        n, length = 5, max(1, int(0.1 * shape[1]))
        for row in m:
            for _ in range(n):
                at = rng.integers(shape[1] - length + 1)
                row[at : at + length] = False
    elif kind != "all_true":
        raise ValueError(f"unknown mask {kind}")
    return m


def pool(h: np.ndarray, how: str | int | None = "full_series") -> np.ndarray:
    """Over time: the maximum of the whole series, of a centred stretch of so many steps, the pyramid of both, or none."""
    if how is None:
        return h
    if how == "full_series":
        return h.max(1)
    if how == "multiscale":
        out, k = [h], 1
        while (1 << k) + 1 < h.shape[1]:
            out.append(pool(h, (1 << k) + 1))
            k += 1
        return np.concatenate(out, axis=2)
    side = int(how) // 2
    padded = np.pad(h, ((0, 0), (side, int(how) - 1 - side), (0, 0)), constant_values=-np.inf)
    return np.stack([padded[:, k : k + h.shape[1]] for k in range(int(how))]).max(0)


def encode(p: dict, x: np.ndarray, pooling="full_series", mask: str = "all_true", batch: int = 256, sliding: int | None = None, padding: int = 0, causal: bool = False) -> np.ndarray:
    """Representations of windows.  ``sliding`` encodes each stretch of so many steps with ``padding`` steps around it (before it
    only, if causal), NaN where the series has none, and keeps the stretch's own steps.  Numbers are of single precision, as in training."""
    rng, out = np.random.default_rng(0), []
    p = {k: np.asarray(v, np.float32) for k, v in p.items()}
    for s in range(0, len(x), batch):
        part = np.asarray(x[s : s + batch], np.float32)
        if sliding:
            steps, got = part.shape[1], []
            after = 0 if causal else padding
            wide = np.pad(part, ((0, 0), (padding, after + sliding), (0, 0)), constant_values=np.nan)
            for at in range(0, steps, sliding):
                piece = wide[:, at : at + padding + sliding + after]
                got.append(forward(p, piece, make_mask(mask, piece.shape[:2], rng))[:, padding : padding + min(sliding, steps - at)])
            h = np.concatenate(got, axis=1)
        else:
            h = forward(p, part, make_mask(mask, part.shape[:2], rng))
        out.append(pool(h, pooling))
    return np.concatenate(out).astype(np.float32) if out else np.zeros((0, OUT), np.float32)


def info_nce(z: np.ndarray):
    """(loss, slope) over groups of 2N vectors in which i and i + N belong together; a vector never meets itself."""
    groups, twice, _ = z.shape
    sim = z @ z.transpose(0, 2, 1)
    sim[:, np.arange(twice), np.arange(twice)] = -np.inf
    top = sim.max(2, keepdims=True)
    e = np.exp(sim - top)
    total = e.sum(2, keepdims=True)
    mate = (np.arange(twice) + twice // 2) % twice
    loss = float((top[..., 0] + np.log(total[..., 0]) - sim[:, np.arange(twice), mate]).mean())
    d = e / total
    d[:, np.arange(twice), mate] -= 1
    d /= groups * twice
    return loss, (d + d.transpose(0, 2, 1)) @ z


def hierarchical_loss(z1: np.ndarray, z2: np.ndarray, share: float = 0.5):
    """(loss, slopes): means over a pyramid of halved time of instance and temporal contrasts; instances alone at one step."""
    levels, loss = [], 0.0
    a, b = z1, z2
    while True:
        n, t, _ = a.shape
        da, db = np.zeros_like(a), np.zeros_like(b)
        if n > 1:
            one, d = info_nce(np.concatenate([a, b]).transpose(1, 0, 2).copy())
            loss += share * one
            d = share * d.transpose(1, 0, 2)
            da, db = da + d[:n], db + d[n:]
        if t > 1:
            one, d = info_nce(np.concatenate([a, b], axis=1))
            loss += (1 - share) * one
            da, db = da + (1 - share) * d[:, :t], db + (1 - share) * d[:, t:]
        levels.append((a, b, da, db))
        if t == 1:
            break
        half = t // 2
        a, b = (x[:, : 2 * half].reshape(n, half, 2, -1).max(2) for x in (a, b))
    for up in range(len(levels) - 1, 0, -1):
        a, b, da, db = levels[up - 1]
        for x, d, below in ((a, da, levels[up][2]), (b, db, levels[up][3])):
            n, half, c = below.shape
            pairs = x[:, : 2 * half].reshape(n, half, 2, c)
            hit = pairs.argmax(2)[:, :, None, :] == np.arange(2)[None, None, :, None]
            d[:, : 2 * half] += (hit * below[:, :, None, :]).reshape(n, 2 * half, c)
    return loss / len(levels), levels[0][2] / len(levels), levels[0][3] / len(levels)


@dataclass
class History:
    losses: list[float] = field(default_factory=list)
    best_epoch: int = -1
    best_loss: float = math.inf
    stopped: bool = False


def crops(steps: int, n: int, rng: np.random.Generator):
    """Two overlapping stretches and their common part's length, and an offset for each row."""
    common = int(rng.integers(2, steps + 1)) if steps > 2 else steps
    left = int(rng.integers(steps - common + 1))
    right = left + common
    first, last = int(rng.integers(left + 1)), int(rng.integers(right, steps + 1))
    offset = rng.integers(-first, steps - last + 1, n)
    return (first, right), (left, last), common, offset


def train(x: np.ndarray, seed: int = 42, epochs: int = 50, batch: int = 8, rate: float = 1e-3, decay: float = 1e-2, patience: int = 10, depth: int = DEPTH, hidden: int = HIDDEN, out: int = OUT) -> tuple[dict, History]:
    """Weights averaged over all steps, as of the best epoch, and the history.  Two crops and masks of each batch are held
    against each other; the optimiser is Adam with decoupled decay; it stops after ``patience`` epochs without a lower loss.
    Numbers are of single precision, as the weights are kept."""
    rng, h = np.random.default_rng(seed), History()
    x = np.asarray(x, np.float32)
    fine = ~np.isnan(x).any(-1)
    x = np.where(fine[..., None], x, np.float32(0))
    size, length = min(batch, len(x)), x.shape[1]
    state, best = Steps(init(x.shape[2], depth, hidden, out, seed), length, size), None
    for epoch in range(epochs):
        order, losses = rng.permutation(len(x)), []
        for s in range(0, len(x) - size + 1, size):
            rows = order[s : s + size]
            one, two, common, offset = crops(length, size, rng)
            at = np.concatenate([np.arange(*one), np.arange(*two)])[:, None] + offset
            show = np.concatenate([make_mask("binomial", (size, b - a), rng).T for a, b in (one, two)]) & fine[rows, at]
            losses.append(state.slopes(x[rows, at], show, one[1] - one[0], common))
            state.update(rate, decay)
        h.losses.append(float(np.mean(losses)) if losses else math.nan)
        if h.losses[-1] < h.best_loss:
            h.best_loss, h.best_epoch, best = h.losses[-1], epoch, state.mean.copy()
        elif epoch - h.best_epoch >= patience:
            h.stopped = True
            break
    return state.named(state.mean if best is None else best), h


def to_bytes(p: dict) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **{k: v.astype(np.float32) for k, v in p.items()})
    return buffer.getvalue()


def from_bytes(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k].astype(float) for k in f.files}


def split_with_nan(x: np.ndarray, sections: int) -> list[np.ndarray]:
    """Parts along time, padded with NaN to one length."""
    parts = np.array_split(x, sections, axis=1)
    longest = max(p.shape[1] for p in parts)
    return [pad_to(p, longest, both=False) for p in parts]


def pad_to(x: np.ndarray, steps: int, both: bool = False) -> np.ndarray:
    """NaN after the series, or on both sides, up to so many steps."""
    gap = max(0, steps - x.shape[1])
    left = gap // 2 if both else 0
    return np.pad(np.asarray(x, float), ((0, 0), (left, gap - left), (0, 0)), constant_values=np.nan)


def centre(x: np.ndarray) -> np.ndarray:
    """Each series moved so that the NaN before and after it are as many."""
    out = np.full_like(x, np.nan)
    for k, row in enumerate(x):
        there = np.flatnonzero(~np.isnan(row).all(-1))
        if len(there):
            part = row[there[0] : there[-1] + 1]
            at = (len(row) - len(part)) // 2
            out[k, at : at + len(part)] = part
    return out


def take_per_row(x: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """n steps of each row from its own start."""
    return x[np.arange(len(x))[:, None], start[:, None] + np.arange(n)]


def drop_steps(x: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """NaN at a random share of each row's steps."""
    out = np.array(x, float)
    out[rng.random(out.shape[:2]) < share] = np.nan
    return out
