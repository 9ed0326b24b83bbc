"""A character BiLSTM with a linear-chain CRF, in numpy.

Windows all have one length; padding is character 0 with tag 0. Training is
mini-batch Adam on the negative log-likelihood, with exact gradients by
back-propagation through time and the forward-backward recursion.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class BiLstmCrf:
    def __init__(self, n_tags: int, embed: int = 12, hidden: int = 20, seed: int = 7):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        u = lambda *shape, s=0.2: r.normal(0, s, shape).astype(F32)
        self.p = {"emb": u(128, embed), "out": u(2 * hidden, n_tags), "bias": np.zeros(n_tags, F32),
                  "trans": np.zeros((n_tags, n_tags), F32), "first": np.zeros(n_tags, F32), "last": np.zeros(n_tags, F32)}
        for d in "fb":
            self.p |= {f"x{d}": u(embed, 4 * hidden), f"h{d}": u(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, F32)}
            self.p[f"c{d}"][hidden:2 * hidden] = 1.0          # the forget gate starts open

    def _lstm(self, x, d, keep: bool):
        """Hidden states (time, batch, hidden) of one direction, and what its gradient needs."""
        h, (t, n, _) = self.hidden, x.shape
        pre = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        hs, cs = np.zeros((t, n, h), F32), np.zeros((t, n, h), F32)
        gates = np.zeros((t, n, 4 * h), F32) if keep else None
        prev_h, prev_c = np.zeros((n, h), F32), np.zeros((n, h), F32)
        for k in (range(t) if d == "f" else range(t - 1, -1, -1)):
            g = pre[k] + prev_h @ self.p[f"h{d}"]
            g[:, :3 * h] = _sigmoid(g[:, :3 * h])
            g[:, 3 * h:] = np.tanh(g[:, 3 * h:])
            prev_c = g[:, h:2 * h] * prev_c + g[:, :h] * g[:, 3 * h:]
            prev_h = g[:, 2 * h:3 * h] * np.tanh(prev_c)
            hs[k], cs[k] = prev_h, prev_c
            if keep:
                gates[k] = g
        return hs, cs, gates

    def _lstm_back(self, x, d, hs, cs, gates, dh_out, grad):
        h, (t, n, _) = self.hidden, x.shape
        dx = np.zeros_like(x)
        dh, dc = np.zeros((n, h), F32), np.zeros((n, h), F32)
        order = list(range(t)) if d == "f" else list(range(t - 1, -1, -1))
        for pos in range(t - 1, -1, -1):
            k = order[pos]
            before = order[pos - 1] if pos else None
            g = gates[k]
            i, f, o, a = g[:, :h], g[:, h:2 * h], g[:, 2 * h:3 * h], g[:, 3 * h:]
            dh = dh + dh_out[k]
            th = np.tanh(cs[k])
            dc = dc + dh * o * (1 - th * th)
            pc = cs[before] if before is not None else np.zeros((n, h), F32)
            dg = np.concatenate([dc * a * i * (1 - i), dc * pc * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - a * a)], axis=1)
            grad[f"x{d}"] += x[k].T @ dg
            grad[f"c{d}"] += dg.sum(0)
            if before is not None:
                grad[f"h{d}"] += hs[before].T @ dg
            dx[k] = dg @ self.p[f"x{d}"].T
            dh = dg @ self.p[f"h{d}"].T
            dc = dc * f
        return dx

    def _emissions(self, codes, keep=False):
        x = self.p["emb"][np.minimum(codes, 127).T]               # (time, batch, embed)
        f, b = self._lstm(x, "f", keep), self._lstm(x, "b", keep)
        both = np.concatenate([f[0], b[0]], axis=2)
        return both @ self.p["out"] + self.p["bias"], (x, f, b, both)

    def _alpha_beta(self, e):
        t, n, k = e.shape
        trans = self.p["trans"]
        alpha, beta = np.zeros((t, n, k), F32), np.zeros((t, n, k), F32)
        alpha[0] = self.p["first"] + e[0]
        for i in range(1, t):
            alpha[i] = _lse(alpha[i - 1][:, :, None] + trans, 1) + e[i]
        beta[-1] = self.p["last"]
        for i in range(t - 2, -1, -1):
            beta[i] = _lse(trans + (e[i + 1] + beta[i + 1])[:, None, :], 2)
        return alpha, beta, _lse(alpha[-1] + self.p["last"], 1)

    def gradients(self, codes, tags):
        """(mean negative log-likelihood of a window, gradients)."""
        e, (x, f, b, both) = self._emissions(codes, keep=True)
        t, n, k = e.shape
        y = tags.T.astype(int)
        alpha, beta, logz = self._alpha_beta(e)
        cols = np.arange(n)
        gold = self.p["first"][y[0]] + self.p["last"][y[-1]] + sum(e[i, cols, y[i]] for i in range(t))
        gold = gold + sum(self.p["trans"][y[i - 1], y[i]] for i in range(1, t))
        grad = {name: np.zeros_like(v) for name, v in self.p.items()}
        de = np.exp(alpha + beta - logz[None, :, None])
        grad["first"] += de[0].sum(0)
        grad["last"] += de[-1].sum(0)
        for i in range(1, t):
            joint = alpha[i - 1][:, :, None] + self.p["trans"] + (e[i] + beta[i])[:, None, :] - logz[:, None, None]
            grad["trans"] += np.exp(joint).sum(0)
            np.add.at(grad["trans"], (y[i - 1], y[i]), -1)
            de[i, cols, y[i]] -= 1
        de[0, cols, y[0]] -= 1
        np.add.at(grad["first"], y[0], -1)
        np.add.at(grad["last"], y[-1], -1)
        grad["out"] += both.reshape(-1, both.shape[2]).T @ de.reshape(-1, k)
        grad["bias"] += de.sum((0, 1))
        dboth = de @ self.p["out"].T
        dx = self._lstm_back(x, "f", *f, dboth[:, :, :self.hidden], grad) + self._lstm_back(x, "b", *b, dboth[:, :, self.hidden:], grad)
        np.add.at(grad["emb"], np.minimum(codes, 127).T.ravel(), dx.reshape(-1, dx.shape[2]))
        return float((logz - gold).mean()), {name: g / n for name, g in grad.items()}

    def fit(self, codes, tags, steps: int = 320, batch: int = 64, rate: float = 0.03, seed: int = 3):
        epochs = max(1, -(-steps * batch // len(codes)))
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(codes))
            for i in range(0, len(order), batch):
                some = order[i:i + batch]
                _, grad = self.gradients(codes[some], tags[some])
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                scale = min(1.0, 5.0 / (size + 1e-9))
                now = rate * (1 - epoch / epochs)
                for name, g in grad.items():
                    g = g * scale
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.p[name] = (self.p[name] - now * (m[name] / (1 - 0.9 ** step)) /
                                    (np.sqrt(v[name] / (1 - 0.99 ** step)) + 1e-8)).astype(F32)
        return self

    def decode(self, codes):
        """(best tag path by Viterbi, posterior of its tag at each place), both (batch, time)."""
        e, _ = self._emissions(codes)
        t, n, k = e.shape
        best, back = self.p["first"] + e[0], np.zeros((t, n, k), np.int8)
        for i in range(1, t):
            s = best[:, :, None] + self.p["trans"]
            back[i] = s.argmax(1)
            best = s.max(1) + e[i]
        path = np.zeros((t, n), np.int8)
        path[-1] = (best + self.p["last"]).argmax(1)
        cols = np.arange(n)
        for i in range(t - 1, 0, -1):
            path[i - 1] = back[i, cols, path[i]]
        alpha, beta, logz = self._alpha_beta(e)
        sure = np.exp(alpha + beta - logz[None, :, None])[np.arange(t)[:, None], cols[None, :], path]
        return path.T, np.minimum(sure.T, 1.0)
