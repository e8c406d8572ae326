"""Character-level bidirectional LSTM with CRF transitions, in numpy.

Both directions run in one batched step. The input weights are a table by
character, so a step is a gather, a small matrix product and one tanh over all
gates (the sigmoid gates' weights hold the factor 1/2 of
sigmoid(x) = tanh(x/2)/2 + 1/2).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Characters: ASCII as they are, everything beyond as one.
OTHER, ALPHABET = 128, 129
PARTS = ("x", "u", "w", "bias", "trans")


@dataclass
class Weights:
    x: np.ndarray       # 2, ALPHABET, 4H  gates i, f, o (halved), g
    u: np.ndarray       # 2, H, 4H
    w: np.ndarray       # 2, H, K
    bias: np.ndarray    # K
    trans: np.ndarray   # K, K  from, to

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, p) for p in PARTS]


def init(hidden: int, labels: int, seed: int) -> Weights:
    r = np.random.default_rng(seed)

    def f(*shape, scale):
        return (r.standard_normal(shape) * scale).astype(np.float32)
    x = f(2, ALPHABET, 4 * hidden, scale=0.3)
    x[:, :, hidden:2 * hidden] += 0.5       # open forget gates
    return Weights(x, f(2, hidden, 4 * hidden, scale=0.3), f(2, hidden, labels, scale=0.3),
                   np.zeros(labels, np.float32), np.zeros((labels, labels), np.float32))


def emissions(w: Weights, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Scores T, B, K of windows sorted by falling length (B, T characters).

    At each step only windows that are still running are computed. Gates are
    the leading axis, so each is one contiguous block."""
    b, t_max = chars.shape
    hidden, k = w.u.shape[1], w.w.shape[2]
    x = np.ascontiguousarray(w.x.reshape(2, ALPHABET, 4, hidden).transpose(2, 0, 1, 3))
    u = np.ascontiguousarray(w.u.reshape(2, hidden, 4, hidden).transpose(2, 0, 1, 3))
    rows = np.arange(b)
    back = np.maximum(lengths[None, :] - 1 - np.arange(t_max)[:, None], 0)  # T, B
    chars = chars.astype(np.intp)
    fwd, bwd = np.ascontiguousarray(chars.T), chars[rows[None, :], back]
    em, em_back = np.zeros((t_max, b, k), np.float32), np.zeros((t_max, b, k), np.float32)
    h, c = np.zeros((2, b, hidden), np.float32), np.zeros((2, b, hidden), np.float32)
    live = np.searchsorted(-lengths, -np.arange(t_max), side="left")
    for t in range(t_max):
        n = live[t]
        if not n:
            break
        z = np.matmul(h[None, :, :n], u)                    # 4, 2, n, H
        z[:, 0] += x[:, 0].take(fwd[t, :n], axis=1)
        z[:, 1] += x[:, 1].take(bwd[t, :n], axis=1)
        np.tanh(z, out=z)
        s = z[:3]
        s *= 0.5
        s += 0.5
        cn = c[:, :n]
        cn *= z[1]
        cn += z[0] * z[3]
        hn = np.tanh(cn)
        hn *= z[2]
        h[:, :n] = hn
        np.matmul(hn[0], w.w[0], out=em[t, :n])
        em_back[back[t, :n], rows[:n]] = hn[1] @ w.w[1]
    em += em_back
    em += w.bias
    return em


# -- CRF ----------------------------------------------------------------------

def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(em: np.ndarray, trans: np.ndarray, lengths: np.ndarray):
    """Label marginals T, B, K, summed pair marginals K, K and log Z per window."""
    t_max, b, k = em.shape
    alpha = np.zeros((t_max, b, k))
    alpha[0] = em[0]
    for t in range(1, t_max):
        step = _lse(alpha[t - 1][:, :, None] + trans[None], 1) + em[t]
        alpha[t] = np.where((t < lengths)[:, None], step, alpha[t - 1])
    log_z = _lse(alpha[-1], 1)
    beta, pairs = np.zeros((b, k)), np.zeros((k, k))
    marg = np.zeros((t_max, b, k))
    for t in range(t_max - 1, -1, -1):
        live = (t < lengths)[:, None]
        marg[t] = np.where(live, np.exp(alpha[t] + beta - log_z[:, None]), 0.0)
        if t:
            right = em[t] + beta
            p = np.exp(alpha[t - 1][:, :, None] + trans[None] + right[:, None, :]
                       - log_z[:, None, None])
            pairs += np.where(live[:, :, None], p, 0.0).sum(axis=0)
            beta = np.where(live, _lse(trans[None] + right[:, None, :], 2), beta)
    return marg, pairs, log_z


def viterbi(em: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels B, T."""
    t_max, b, k = em.shape
    score = em[0].astype(np.float64)
    back = np.zeros((t_max, b, k), np.int8)
    for t in range(1, t_max):
        s = score[:, :, None] + trans[None]
        back[t] = s.argmax(axis=1)
        score = np.where((t < lengths)[:, None], s.max(axis=1) + em[t], score)
        back[t][t >= lengths] = np.arange(k)
    path = np.zeros((b, t_max), np.int8)
    path[:, -1] = score.argmax(axis=1)
    rows = np.arange(b)
    for t in range(t_max - 1, 0, -1):
        path[:, t - 1] = back[t][rows, path[:, t]]
    return path


def open_ranges(em: np.ndarray, trans: np.ndarray,
                lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(window, start, end) ranges outside of which the best path certainly has
    label 0. A step on another label can gain at most its lead in emission plus
    the best transition into a label plus the best way out; where that is
    negative, a path gains nothing by starting or ending a span there. Two
    ranges are kept apart only if holding a label from one to the other loses
    more than leaving and coming back costs at most."""
    edge = (trans - trans[0, 0]).astype(np.float64)
    enter, leave = float(edge[:, 1:].max()), max(0.0, float(edge[1:, 0].max()))
    gain = em[:, :, 1].copy()
    for k in range(2, em.shape[2]):
        np.maximum(gain, em[:, :, k], out=gain)
    gain += enter - em[:, :, 0]
    gain[np.arange(em.shape[0])[:, None] >= lengths[None]] = -np.inf
    steps, windows = np.nonzero((gain + leave >= 0))
    order = np.lexsort((steps, windows))
    detour = float(edge[1:, 0].min() + edge[0, 1:].min())
    out: list[tuple[int, int, int]] = []
    for w, t in zip(windows[order].tolist(), steps[order].tolist()):
        if out and out[-1][0] == w and (
                t - out[-1][2] < 8 or gain[out[-1][2]:t, w].sum() >= detour):
            out[-1] = (w, out[-1][1], t + 1)
        else:
            out.append((w, t, t + 1))
    return out


def cut_ranges(em: np.ndarray, lengths: np.ndarray, ranges: list[tuple[int, int, int]]):
    """The ranges as short windows (T, B, K), lengths and starts. One step of
    label 0 is put on each side that is not an edge of the window."""
    part = [(w, max(0, a - 1), min(int(lengths[w]), b + 1), a > 0, b < lengths[w])
            for w, a, b in ranges]
    sizes = np.array([b - a for _, a, b, _, _ in part])
    out = np.zeros((int(sizes.max()), len(part), em.shape[2]))
    for r, (w, a, b, before, after) in enumerate(part):
        out[:b - a, r] = em[a:b, w]
        if before:
            out[0, r, 1:] = -1e6
        if after:
            out[b - a - 1, r, 1:] = -1e6
    return out, sizes, [(w, a) for w, a, _, _, _ in part]


# -- training -----------------------------------------------------------------

def loss_and_grad(w: Weights, chars: np.ndarray, gold: np.ndarray):
    """Mean negative log-likelihood per window and its gradient; windows of
    equal length B, T."""
    b, t_max = chars.shape
    hidden, k = w.u.shape[1], w.w.shape[2]
    seq = np.stack([chars.T, chars[:, ::-1].T], axis=1)             # T, 2, B
    lengths = np.full(b, t_max)
    hs, cs, zs = (np.zeros((t_max + 1, 2, b, n), np.float32) for n in (hidden, hidden, 4 * hidden))
    for t in range(t_max):
        z = hs[t] @ w.u
        z[0] += w.x[0][seq[t, 0]]
        z[1] += w.x[1][seq[t, 1]]
        np.tanh(z, out=z)
        z[..., :3 * hidden] = z[..., :3 * hidden] * 0.5 + 0.5
        cs[t + 1] = cs[t] * z[..., hidden:2 * hidden] + z[..., :hidden] * z[..., 3 * hidden:]
        hs[t + 1] = np.tanh(cs[t + 1]) * z[..., 2 * hidden:3 * hidden]
        zs[t] = z
    h_f, h_b = hs[1:, 0], hs[:0:-1, 1]                               # both in text order
    em = h_f @ w.w[0] + h_b @ w.w[1] + w.bias
    marg, pairs, log_z = forward_backward(em, w.trans, lengths)
    y = gold.T
    hot = np.eye(k)[y]
    path = (em * hot).sum(axis=(0, 2)) + w.trans[y[:-1], y[1:]].sum(axis=0)
    g_em = ((marg - hot) / b).astype(np.float32)
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:-1], y[1:]), 1.0)
    g = Weights(np.zeros_like(w.x), np.zeros_like(w.u),
                np.stack([np.einsum("tbh,tbk->hk", h_f, g_em),
                          np.einsum("tbh,tbk->hk", h_b, g_em)]).astype(np.float32),
                g_em.sum(axis=(0, 1)), ((pairs - seen) / b).astype(np.float32))
    d_out = np.stack([g_em @ w.w[0].T, (g_em @ w.w[1].T)[::-1]], axis=1)  # per direction
    dh, dc = np.zeros((2, b, hidden), np.float32), np.zeros((2, b, hidden), np.float32)
    u_t = w.u.transpose(0, 2, 1)
    for t in range(t_max - 1, -1, -1):
        z = zs[t]
        i, f, o, n = (z[..., j * hidden:(j + 1) * hidden] for j in range(4))
        dh = dh + d_out[t]
        tc = np.tanh(cs[t + 1])
        dc = dc + dh * o * (1 - tc * tc)
        # a halved sigmoid s = tanh(z)/2 + 1/2 has the slope 2 s (1 - s) in z
        dz = np.concatenate([dc * n * i * (1 - i) * 2, dc * cs[t] * f * (1 - f) * 2,
                             dh * tc * o * (1 - o) * 2, dc * i * (1 - n * n)], axis=2)
        for d in (0, 1):
            g.u[d] += hs[t, d].T @ dz[d]
        dh = dz @ u_t
        dc = dc * f
        zs[t] = dz                           # the gates of this step are done with
    for d in (0, 1):                         # gradient of the table, by character
        flat = seq[:, d].ravel()
        by = np.argsort(flat, kind="stable")
        firsts = np.nonzero(np.diff(flat[by], prepend=-1))[0]
        g.x[d][flat[by][firsts]] = np.add.reduceat(
            zs[:t_max, d].reshape(len(flat), -1)[by], firsts, axis=0)
    return float((log_z - path).mean()), g


def fit(chars: np.ndarray, gold: np.ndarray, hidden: int, labels: int, epochs: int,
        batch: int = 128, rate: float = 0.02, seed: int = 7) -> Weights:
    """Adam on windows of equal length."""
    w = init(hidden, labels, seed)
    m = [np.zeros_like(p) for p in w.parts()]
    v = [np.zeros_like(p) for p in w.parts()]
    order, step = np.random.default_rng(seed), 0
    total = max(1, epochs * -(-len(chars) // batch))
    for _ in range(epochs):
        perm = order.permutation(len(chars))
        for s in range(0, len(perm), batch):
            rows = perm[s:s + batch]
            _, g = loss_and_grad(w, chars[rows], gold[rows])
            step += 1
            lr = rate * (1 - step / (total + 1))
            for p, gp, mp, vp in zip(w.parts(), g.parts(), m, v):
                gp = np.clip(gp, -1.0, 1.0)
                mp += 0.1 * (gp - mp)
                vp += 0.01 * (gp * gp - vp)
                p -= (lr * (mp / (1 - 0.9 ** step))
                      / (np.sqrt(vp / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return w
