"""Small dense networks in numpy, for use inside tasks. Parameters are one flat vector, whose size depends on the layers alone."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Network:
    """Fully connected layers of the given sizes, with a leaky rectifier, or a sigmoid or exponential unit, between them, and after the last if asked.

    With one size there is no layer, and rows pass unchanged.
    """

    sizes: tuple[int, ...]
    alpha: float = 0.01
    last: bool = False
    sigmoid: bool = False
    elu: bool = False

    @property
    def count(self) -> int:
        return sum(a * b + b for a, b in zip(self.sizes, self.sizes[1:]))

    def initial(self, seed: int) -> np.ndarray:
        rng, parts = np.random.default_rng(seed), []
        for a, b in zip(self.sizes, self.sizes[1:]):
            parts += [rng.uniform(-1, 1, a * b) * (6 / (a + b)) ** 0.5, np.zeros(b)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _layers(self, flat: np.ndarray):
        at = 0
        for k, (a, b) in enumerate(zip(self.sizes, self.sizes[1:])):
            yield flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b], self.last or k < len(self.sizes) - 2
            at += a * b + b

    def outputs(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """x and the output of each layer"""
        out = [x]
        for w, b, bent in self._layers(flat):
            z = out[-1] @ w + b
            out.append(self._bend(z) if bent else z)
        return out

    def _bend(self, z: np.ndarray) -> np.ndarray:
        if self.sigmoid:
            return 1 / (1 + np.exp(-z))
        return np.where(z > 0, z, np.expm1(np.minimum(z, 0)) if self.elu else self.alpha * z)

    def _slope(self, y: np.ndarray) -> np.ndarray:
        """Of _bend, by its result"""
        if self.sigmoid:
            return y * (1 - y)
        return np.where(y > 0, 1.0, y + 1 if self.elu else self.alpha)

    def backward(self, flat: np.ndarray, out: list[np.ndarray], d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradients of the parameters and of x, from that of the last output"""
        parts = []
        for (w, _, bent), x, y in reversed(list(zip(self._layers(flat), out, out[1:]))):
            if bent:
                d = d * self._slope(y)
            parts = [(x.T @ d).ravel(), d.sum(0), *parts]
            d = d @ w.T
        return (np.concatenate(parts) if parts else np.zeros(0)), d


@dataclass(frozen=True)
class SageLayer:
    """Rows hold a node's vector and the mean of its neighbors'; each goes through a layer of its own, side by side."""

    width: int
    dim: int
    bent: bool = True
    alpha: float = 0.01

    @property
    def half(self) -> Network:
        return Network((self.width, self.dim), self.alpha, self.bent)

    @property
    def count(self) -> int:
        return 2 * self.half.count

    def initial(self, seed: int) -> np.ndarray:
        return np.concatenate([self.half.initial(seed), self.half.initial(seed + 1)])

    def outputs(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        sides = zip(np.split(flat, 2), np.split(x, 2, axis=1))
        return [x, np.concatenate([self.half.outputs(f, s)[-1] for f, s in sides], axis=1)]

    def backward(self, flat: np.ndarray, out: list[np.ndarray], d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sides = zip(np.split(flat, 2), *(np.split(m, 2, axis=1) for m in (*out, d)))
        found = [self.half.backward(f, [x, y], g) for f, x, y, g in sides]
        return np.concatenate([f for f, _ in found]), np.concatenate([x for _, x in found], axis=1)


@dataclass(frozen=True)
class FactorizationMachine:
    """Rows hold, for each group of features, a weight and a vector. The score adds the weights, the inner products of all
    pairs of groups, and a network over the vectors; or, if joint, a layer weighs these parts (products by element).
    The network also sees `extra` numbers that follow the groups."""

    groups: int
    dim: int
    hidden: tuple[int, ...] = (16,)
    joint: bool = False
    extra: int = 0

    @property
    def deep(self) -> Network:
        return Network((self.groups * self.dim + self.extra, *self.hidden, *(() if self.joint else (1,))), alpha=0.0)

    @property
    def top(self) -> Network:
        return Network((self.groups + self.dim + self.deep.sizes[-1], 1) if self.joint else (1,))

    @property
    def count(self) -> int:
        return self.deep.count + self.top.count

    def initial(self, seed: int) -> np.ndarray:
        return np.concatenate([self.deep.initial(seed), self.top.initial(seed + 1)])

    def _parts(self, flat: np.ndarray, x: np.ndarray):
        grouped, extra = np.split(x, [self.groups * (self.dim + 1)], axis=1)
        e = grouped.reshape(len(x), self.groups, self.dim + 1)
        vecs, total = e[:, :, 1:], e[:, :, 1:].sum(1)
        deep = self.deep.outputs(flat[: self.deep.count], np.concatenate([vecs.reshape(len(x), -1), extra], axis=1))
        parts = [e[:, :, 0], (total**2 - (vecs**2).sum(1)) / 2, deep[-1]]
        joined = np.concatenate(parts, axis=1)
        return vecs, total, deep, joined if self.joint else joined.sum(1, keepdims=True)

    def outputs(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        return [x, self.top.outputs(flat[self.deep.count :], self._parts(flat, x)[3])[-1]]

    def backward(self, flat: np.ndarray, out: list[np.ndarray], d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vecs, total, deep, joined = self._parts(flat, out[0])
        top = flat[self.deep.count :]
        g_top, d = self.top.backward(top, self.top.outputs(top, joined), d)
        if not self.joint:
            d = np.repeat(d, self.groups + self.dim + 1, axis=1)
        lin, quad, rest = np.split(d, [self.groups, self.groups + self.dim], axis=1)
        g_deep, d_deep = self.deep.backward(flat[: self.deep.count], deep, rest)
        d_deep, d_extra = np.split(d_deep, [self.groups * self.dim], axis=1)
        d_vecs = quad[:, None, :] * (total[:, None, :] - vecs) + d_deep.reshape(vecs.shape)
        d_grouped = np.concatenate([lin[:, :, None], d_vecs], axis=2).reshape(len(vecs), -1)
        return np.concatenate([g_deep, g_top]), np.concatenate([d_grouped, d_extra], axis=1)


@dataclass(frozen=True)
class Attention:
    """Rows hold the vectors of user groups, of a candidate, and of a history of items, in which a slot of zeros is empty.

    A network weighs each item of the history by itself, the candidate, their difference and their product; the weights' softmax
    gives one vector, of zeros for an empty history. A network scores it with the other vectors.
    """

    users: int
    history: int
    dim: int
    att_hidden: int = 8
    hidden: tuple[int, ...] = (16,)

    @property
    def scorer(self) -> Network:
        return Network((4 * self.dim, self.att_hidden, 1), sigmoid=True)

    @property
    def deep(self) -> Network:
        return Network(((self.users + 2) * self.dim, *self.hidden, 1), alpha=0.0)

    @property
    def count(self) -> int:
        return self.scorer.count + self.deep.count

    def initial(self, seed: int) -> np.ndarray:
        return np.concatenate([self.scorer.initial(seed), self.deep.initial(seed + 1)])

    def _parts(self, flat: np.ndarray, x: np.ndarray):
        e = x.reshape(len(x), self.users + 1 + self.history, self.dim)
        user, cand, hist = e[:, : self.users], e[:, self.users : self.users + 1], e[:, self.users + 1 :]
        each = np.concatenate([hist, np.broadcast_to(cand, hist.shape), hist - cand, hist * cand], axis=2)
        scores = self.scorer.outputs(flat[: self.scorer.count], each.reshape(-1, 4 * self.dim))
        z = np.where((hist != 0).any(2), scores[-1].reshape(hist.shape[:2]) / self.dim**0.5, -np.inf)
        raised = np.exp(z - np.maximum(z.max(1, keepdims=True), np.finfo(float).min))
        share = raised / np.maximum(raised.sum(1, keepdims=True), np.finfo(float).tiny)
        pooled = (share[:, :, None] * hist).sum(1)
        joined = np.concatenate([user.reshape(len(x), -1), cand[:, 0], pooled], axis=1)
        return cand, hist, scores, share, self.deep.outputs(flat[self.scorer.count :], joined)

    def outputs(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        return [x, self._parts(flat, x)[-1][-1]]

    def backward(self, flat: np.ndarray, out: list[np.ndarray], d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cand, hist, scores, share, deep = self._parts(flat, out[0])
        g_deep, d_joined = self.deep.backward(flat[self.scorer.count :], deep, d)
        d_user, d_cand, d_pooled = np.split(d_joined, [self.users * self.dim, (self.users + 1) * self.dim], axis=1)
        d_share = (d_pooled[:, None] * hist).sum(2)
        d_z = share * (d_share - (share * d_share).sum(1, keepdims=True)) / self.dim**0.5
        g_scorer, d_each = self.scorer.backward(flat[: self.scorer.count], scores, d_z.reshape(-1, 1))
        own, other, minus, times = np.split(d_each.reshape(*hist.shape[:2], -1), 4, axis=2)
        d_hist = share[:, :, None] * d_pooled[:, None] + own + minus + times * cand
        d_cand = d_cand + (other - minus + times * hist).sum(1)
        return np.concatenate([g_scorer, g_deep]), np.concatenate([d_user, d_cand, d_hist.reshape(len(d), -1)], axis=1)
