"""Sparse regression on sufficient statistics (NumPy): group lasso paths, NNLS, residualising."""

from __future__ import annotations

import math

import numpy as np

K = 7


def residualise(z: np.ndarray, s: np.ndarray) -> np.ndarray:
    """s without its projection on z."""
    return s - z @ np.linalg.lstsq(z, s, rcond=None)[0]


def shrink(v: np.ndarray, by: float, positive: bool = True) -> np.ndarray:
    """Positive part, then the group's length shortened by ``by``."""
    v = np.maximum(v, 0) if positive else v
    size = math.sqrt(v @ v)
    return np.zeros_like(v) if size <= by else v * (1 - by / size)


def _best_length(w2: np.ndarray, d: np.ndarray, lam: float, r: float) -> float:
    """r > 0 with sum w2 / (d r + lam)^2 = 1. The sum's power -1/2 is concave in r, so Newton climbs to it from below."""
    for _ in range(60):
        low = d * r + lam
        part = w2 / (low * low)
        total = float(part.sum())
        slope = float((part * d / low).sum())
        if slope <= 0:
            return r
        new = max(0.0, r + total * (math.sqrt(total) - 1) / slope)
        if abs(new - r) <= 1e-13 * new:
            return new
        r = new
    return r


class Group:
    """One group's problem: the least 1/2 b'Gb - u'b + lam |b| over b >= 0, exactly, by an active set.

    On a support the solution is (G + lam/|b|)^-1 u, so its length solves one equation in the eigenvalues.
    """

    def __init__(self, gram: np.ndarray):
        self.gram, self.known = gram, {}

    def on(self, support: tuple[int, ...], u: np.ndarray, lam: float, length: float) -> np.ndarray:
        """The least value with these coordinates of any sign and all others 0."""
        at = list(support)
        if support not in self.known:
            d, q = np.linalg.eigh(self.gram[np.ix_(at, at)])
            self.known[support] = np.maximum(d, 0), q
        d, q = self.known[support]
        w = u[at] @ q
        r = _best_length(w * w, d, lam, length)
        out = np.zeros(len(u))
        out[at] = q @ (w * r / (d * r + lam))
        return out

    def value(self, b: np.ndarray, u: np.ndarray, lam: float) -> float:
        return float(b @ (self.gram @ b) / 2 - u @ b + lam * math.sqrt(b @ b))

    def solve(self, u: np.ndarray, lam: float, old: np.ndarray) -> np.ndarray:
        up = np.maximum(u, 0)
        size = math.sqrt(up @ up)
        bend = float(up @ (self.gram @ up))
        if size <= lam or bend <= 0:
            return np.zeros(len(u))
        b = old
        if not old.any() or self.value(old, u, lam) >= 0:  # a start below the value at 0
            b = up * (size * (size - lam) / bend)
        support, tol = tuple(np.flatnonzero(b > 0).tolist()), 1e-10 * size
        for _ in range(8 * len(u)):
            s = self.on(support, u, lam, math.sqrt(b @ b))
            at = list(support)
            if s[at].min() > 0:
                b = s
                slope = u - self.gram @ b
                slope[at] = 0
                j = int(slope.argmax())
                if slope[j] <= tol:
                    break
                support = tuple(sorted((*support, j)))
            else:  # go towards s until a coordinate meets 0
                falls = [i for i in at if s[i] <= 0]
                share = min(b[i] / (b[i] - s[i]) if b[i] > s[i] else 0.0 for i in falls)
                gone = {i for i in falls if b[i] - share * (b[i] - s[i]) <= 1e-15 * size}
                b = np.maximum(b + share * (s - b), 0)
                b[list(gone)] = 0
                left = tuple(i for i in at if i not in gone)
                if not left or left == support:
                    break
                support = left
        return b


class Groups:
    """Sub-Grams and step sizes of consecutive groups of ``width`` columns."""

    def __init__(self, gram: np.ndarray, width: int = K, positive: bool = True):
        self.gram, self.width, self.positive = gram, width, positive
        self.n = len(gram) // width
        self.at = [slice(i * width, (i + 1) * width) for i in range(self.n)]
        self.own = [gram[a, a] for a in self.at]
        self.group = [Group(g) for g in self.own]
        self.usable = np.array([g.trace() > 1e-12 for g in self.own], bool)
        self.weight = width**0.5

    def solve(self, c: np.ndarray, lam: float, beta: np.ndarray | None = None, rounds: int = 150, tol: float = 1e-6) -> np.ndarray:
        """Block coordinate descent of 1/2 b'Gb - c'b + lam * weight * sum of group lengths.

        Sweeps only groups that are in or want in; when these stand still, all others are tried at once. Where
        nothing leaves or enters, a Newton step on all positive coordinates follows, so few sweeps are needed.
        """
        beta = np.zeros(len(c)) if beta is None else beta.copy()
        fitted, by = self.gram @ beta, lam * self.weight
        turn = np.flatnonzero(self.active(beta)).tolist()
        for again in range(rounds):
            moved = 0.0
            for i in turn:
                a = self.at[i]
                old = beta[a]
                u = c[a] - fitted[a] + self.own[i] @ old
                # orthonormal columns of any sign have a closed form
                new = self.group[i].solve(u, by, old) if self.positive else shrink(u, by, positive=False)
                change = new - old
                if change.any():
                    beta[a] = new
                    fitted += self.gram[:, a] @ change
                    moved = max(moved, np.abs(change).max())
            if moved < tol:
                v = c - fitted
                v = (np.maximum(v, 0) if self.positive else v).reshape(self.n, self.width)
                wants = np.sqrt((v * v).sum(axis=1)) > by
                wants[turn] = False
                if not (wants & self.usable).any():
                    break
                turn = sorted([*turn, *np.flatnonzero(wants & self.usable).tolist()])
            elif self.positive and again and self._leap(c, by, beta):
                fitted = self.gram @ beta
        return beta

    def _leap(self, c: np.ndarray, by: float, beta: np.ndarray) -> bool:
        """Newton step on the positive coordinates, in place, as far as they stay positive; only if it lowers the value."""
        on = np.flatnonzero(beta > 0)
        if not len(on):
            return False
        b, of = beta[on], on // self.width
        same = of[:, None] == of[None, :]
        length = np.sqrt(np.bincount(of, b * b, self.n))
        unit, g = b / length[of], self.gram[np.ix_(on, on)]
        pull = g @ b - c[on]
        bend = g + by * same * (np.eye(len(on)) - np.outer(unit, unit)) / length[of][:, None]
        bend[np.diag_indices(len(on))] += 1e-12 * bend.trace() / len(on)
        try:
            step = -np.linalg.solve(bend, pull + by * unit)
        except np.linalg.LinAlgError:
            return False
        falls = step < 0
        step = step * min(1.0, 0.95 * float((b[falls] / -step[falls]).min(initial=np.inf)))
        new = b + step
        gain = pull @ step + step @ (g @ step) / 2 + by * float((np.sqrt(np.bincount(of, new * new, self.n)) - length).sum())
        if not gain < 0:
            return False
        beta[on] = new
        return True

    def active(self, beta: np.ndarray) -> np.ndarray:
        return np.abs(beta).reshape(self.n, self.width).max(axis=1) > 0

    def largest(self, c: np.ndarray) -> float:
        """The penalty from which on nothing is selected."""
        v = np.maximum(c, 0) if self.positive else c
        return max(1e-9, float((np.linalg.norm(v.reshape(self.n, self.width), axis=1) / self.weight).max(initial=0)))


def most_active(n_groups: int) -> int:
    return max(4, round((0.8 * n_groups) ** 0.5))


def penalties(groups: Groups, c: np.ndarray, q_max: int, n: int = 6) -> np.ndarray:
    """Penalties of a path whose solutions have 1 to ``q_max`` active groups, thinned to ``n``."""
    points = 50 if groups.positive else 40
    path = groups.largest(c) * np.logspace(0, -2, points)
    beta, kept = None, []
    for lam in path:
        beta = groups.solve(c, lam, beta)
        active = int(groups.active(beta).sum())
        if active > q_max:
            break
        if active:
            kept.append(lam)
    kept = np.array(kept or [path[4]])
    return kept if len(kept) <= n else kept[np.rint(np.linspace(0, len(kept) - 1, n)).astype(int)]


def orthonormal(gram: np.ndarray, width: int = K) -> np.ndarray:
    """Block-diagonal t with t' gram t = identity within groups (weak directions become 0)."""
    t = np.zeros_like(gram)
    for i in range(0, len(gram), width):
        a = slice(i, i + width)
        values, vectors = np.linalg.eigh(gram[a, a])
        good = values > 1e-14 * max(values[-1], 1e-300)
        t[a, a] = vectors * np.where(good, 1 / np.sqrt(np.where(good, values, 1)), 0)
    return t


def nnls(gram: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Active-set non-negative least squares from X'X and X'y."""
    n = len(c)
    x, free = np.zeros(n), np.zeros(n, bool)
    tol = 1e-10 * max(1.0, np.abs(c).max(initial=0))
    for _ in range(10 * n + 10):
        slope = c - gram @ x
        slope[free] = -np.inf
        if not n or slope.max() <= tol:
            break
        free[slope.argmax()] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(gram[np.ix_(free, free)], c[free], rcond=1e-12)[0]
            if s[free].min(initial=1) > 0:
                x = s
                break
            bad = free & (s <= 0)
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x = x + step * (s - x)
            free &= x > 1e-14
            x[~free] = 0
            if not free.any():
                break
    return x
