"""Recurrences that no bounded frame can express.

Each object holds the little state that must survive from bar to bar and is
picklable, so that a long series can be carried from block to block.  ``nan``
stands for "not defined yet"; Spark stores it as NULL.

``step`` takes one bar. Means, and what is made of them, are affine in their state
and do more: ``values`` takes whole columns at once, ``summary`` boils a block
down to its map of the state, and ``advance`` applies such a map, so that blocks
are folded without being run. ``levels`` counts the folds that depend on each
other: what a level needs from the ones before is known when it is folded.
"""

from __future__ import annotations

from math import isfinite, nan

import numpy as np


def _smoothed(x: np.ndarray, start: float, com: float) -> np.ndarray:
    """``q = a * x + (1 - a) * q`` with ``a = 1 / (1 + com)``, from ``start``."""
    import pandas as pd

    return pd.Series(np.concatenate([[start], x])).ewm(com=com, adjust=False).mean().to_numpy()[1:]


def _before(x: np.ndarray, first: float) -> np.ndarray:
    return np.concatenate([[first], x[:-1]])


class Ema:
    """Exponential mean; the first defined value is the seed, a gap restarts it."""

    def __init__(self, p: int):
        self.a = 2 / (p + 1)
        self.q = nan

    def step(self, x: float) -> float:
        self.q = self.a * x + (1 - self.a) * self.q if isfinite(self.q) else x
        return self.q

    levels = 1

    def _run(self, x: np.ndarray, q: float) -> np.ndarray:
        return _smoothed(x, q, 1 / self.a - 1) if isfinite(q) else np.concatenate([x[:1], _smoothed(x[1:], x[0], 1 / self.a - 1)])

    def values(self, x: np.ndarray) -> np.ndarray:
        out, start = x.copy(), 0
        for gap in [*np.flatnonzero(~np.isfinite(x)).tolist(), len(x)]:  # each gap stands for itself and restarts the mean
            if gap > start:
                out[start:gap] = self._run(x[start:gap], self.q if start == 0 else nan)
            start = gap + 1
        if len(x):
            self.q = float(out[-1])
        return out

    def summary(self, level: int, x: np.ndarray):
        """``(decay, value from zero, value from nothing)``; no decay once a gap has cut the past off."""
        gaps = np.flatnonzero(~np.isfinite(x))
        if len(gaps):
            rest = x[gaps[-1] + 1:]
            return None, nan, float(self._run(rest, nan)[-1]) if len(rest) else nan
        return ((1 - self.a) ** len(x), float(self._run(x, 0.0)[-1]), float(self._run(x, nan)[-1])) if len(x) else (1.0, 0.0, nan)

    def advance(self, level: int, summary) -> None:
        decay, zero, fresh = summary
        self.q = decay * self.q + zero if decay is not None and isfinite(self.q) else fresh


class Rma:
    """Wilder mean; the seed is the mean of the first p defined values."""

    def __init__(self, p: int):
        self.p = p
        self.n = 0
        self.q = 0.0

    def step(self, x: float) -> float:
        if not isfinite(x):
            return nan
        self.n = min(self.n + 1, self.p + 1)  # bounded, so that two states can become equal
        if self.n <= self.p:
            self.q += x
            if self.n < self.p:
                return nan
            self.q /= self.p
        else:
            self.q = (self.q * (self.p - 1) + x) / self.p
        return self.q

    levels = 1

    def values(self, x: np.ndarray) -> np.ndarray:
        known = np.isfinite(x)
        v = x[known]
        y, k = np.full(len(v), nan), 0
        if self.n < self.p and len(v):
            k = min(self.p - self.n, len(v))
            self.q = float(np.cumsum(np.concatenate([[self.q], v[:k]]))[-1])
            if self.n + k == self.p:
                self.q /= self.p
                y[k - 1] = self.q
        if len(v) > k:
            y[k:] = _smoothed(v[k:], self.q, self.p - 1)
            self.q = float(y[-1])
        self.n = min(self.n + len(v), self.p + 1)
        out = np.full(len(x), nan)
        out[known] = y
        return out

    def summary(self, level: int, x: np.ndarray):
        """``(values, the first p of them, means from zero after each of those, mean from zero after all)``."""
        v = x[np.isfinite(x)]
        zero = _smoothed(v, 0.0, self.p - 1) if len(v) else v
        return len(v), v[:self.p].tolist(), zero[:self.p].tolist(), float(zero[-1]) if len(v) else 0.0

    def advance(self, level: int, summary) -> None:
        m, head, early, zero = summary
        keep, k = 1 - 1 / self.p, 0
        if self.n < self.p:
            k = min(self.p - self.n, m)
            self.q += sum(head[:k])
            if k and self.n + k == self.p:
                self.q /= self.p
        if m > k:
            rest = keep ** (m - k)
            self.q = rest * self.q + (zero - rest * early[k - 1] if k else zero)
        self.n = min(self.n + m, self.p + 1)


class Rsi:
    def __init__(self, p: int):
        self.up, self.dn, self.prev = Rma(p), Rma(p), nan

    def step(self, x: float) -> float:
        d = x - self.prev if isfinite(self.prev) else 0.0
        self.prev = x
        g, s = self.up.step(max(d, 0.0)), self.dn.step(max(-d, 0.0))
        if not isfinite(g):
            return nan
        if s == 0:
            return 100.0
        return 0.0 if g == 0 else 100 - 100 / (1 + g / s)

    levels = 1

    @staticmethod
    def _moves(x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.where(np.isfinite(before), x - before, 0.0)
        return np.maximum(d, 0.0), np.maximum(-d, 0.0)

    def values(self, x: np.ndarray) -> np.ndarray:
        up, dn = self._moves(x, _before(x, self.prev))
        g, s = self.up.values(up), self.dn.values(dn)
        self.prev = float(x[-1]) if len(x) else self.prev
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(s == 0, 100.0, np.where(g == 0, 0.0, 100 - 100 / (1 + g / s)))
        return np.where(np.isfinite(g), out, nan)

    def summary(self, level: int, x: np.ndarray):
        up, dn = self._moves(x[1:], x[:-1])
        return float(x[0]), float(x[-1]), self.up.summary(0, up), self.dn.summary(0, dn)

    def advance(self, level: int, summary) -> None:
        first, last, up, dn = summary
        self.step(first)
        self.up.advance(0, up)
        self.dn.advance(0, dn)
        self.prev = last


class Macd:
    """Difference of two exponential means and its signal line."""

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9):
        self.f, self.s, self.g = Ema(fast), Ema(slow), Ema(signal)

    def step(self, x: float):
        m = self.f.step(x) - self.s.step(x)
        return m, self.g.step(m)

    levels = 2
    parts = (("f", "s"), ("g",))

    def values(self, x: np.ndarray):
        m = self.f.values(x) - self.s.values(x)
        return m, self.g.values(m)

    def summary(self, level: int, x: np.ndarray):
        if level == 0:
            return self.f.summary(0, x), self.s.summary(0, x)
        return self.g.summary(0, self.f.values(x) - self.s.values(x))

    def advance(self, level: int, summary) -> None:
        if level == 0:
            self.f.advance(0, summary[0])
            self.s.advance(0, summary[1])
        else:
            self.g.advance(0, summary)


class Adx:
    """Directional movement; inputs are the bar's true range, high and low."""

    def __init__(self, p: int = 14):
        self.tr, self.up, self.dn, self.dx = Rma(p), Rma(p), Rma(p), Rma(p)
        self.h = self.l = nan

    def step(self, tr: float, h: float, l: float):
        up = h - self.h if isfinite(self.h) else 0.0
        dn = self.l - l if isfinite(self.l) else 0.0
        self.h, self.l = h, l
        a = self.tr.step(tr)
        p = self.up.step(up if up > dn and up > 0 else 0.0)
        m = self.dn.step(dn if dn > up and dn > 0 else 0.0)
        if not (isfinite(a) and a > 0):
            return nan, nan, nan
        pdi, mdi = 100 * p / a, 100 * m / a
        total = pdi + mdi
        return self.dx.step(100 * abs(pdi - mdi) / total if total else 0.0), pdi, mdi

    levels = 2
    parts = (("tr", "up", "dn", "h", "l"), ("dx",))

    @staticmethod
    def _moves(h, l, h0, l0) -> tuple[np.ndarray, np.ndarray]:
        up, dn = np.where(np.isfinite(h0), h - h0, 0.0), np.where(np.isfinite(l0), l0 - l, 0.0)
        return np.where((up > dn) & (up > 0), up, 0.0), np.where((dn > up) & (dn > 0), dn, 0.0)

    def _lines(self, tr, h, l):
        """Both lines and the index of their difference, with the bars where they are defined."""
        up, dn = self._moves(h, l, _before(h, self.h), _before(l, self.l))
        a, p, m = self.tr.values(tr), self.up.values(up), self.dn.values(dn)
        self.h, self.l = (float(h[-1]), float(l[-1])) if len(h) else (self.h, self.l)
        ok = np.isfinite(a) & (a > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            pdi, mdi = np.where(ok, 100 * p / a, nan), np.where(ok, 100 * m / a, nan)
            total = pdi + mdi
            return ok, pdi, mdi, np.where(total == 0, 0.0, 100 * np.abs(pdi - mdi) / total)

    def values(self, tr: np.ndarray, h: np.ndarray, l: np.ndarray):
        ok, pdi, mdi, dx = self._lines(tr, h, l)
        out = np.full(len(tr), nan)
        out[ok] = self.dx.values(dx[ok])
        return out, pdi, mdi

    def summary(self, level: int, tr: np.ndarray, h: np.ndarray, l: np.ndarray):
        if level == 0:
            up, dn = self._moves(h[1:], l[1:], h[:-1], l[:-1])
            return [float(x[k]) for k in (0, -1) for x in (tr, h, l)], self.tr.summary(0, tr[1:]), self.up.summary(0, up), self.dn.summary(0, dn)
        ok, _, _, dx = self._lines(tr, h, l)
        return self.dx.summary(0, dx[ok])

    def advance(self, level: int, summary) -> None:
        if level == 1:
            self.dx.advance(0, summary)
            return
        (tr, h, l, _, last_h, last_l), rest, up, dn = summary
        self._lines(np.array([tr]), np.array([h]), np.array([l]))
        for own, of in ((self.tr, rest), (self.up, up), (self.dn, dn)):
            own.advance(0, of)
        self.h, self.l = last_h, last_l


class Vidya:
    """Mean whose speed follows the absolute momentum of the last nine changes."""

    def __init__(self, p: int):
        self.a = 2 / (p + 1)
        self.q = self.prev = nan
        self.moves: list[float] = []

    def step(self, x: float) -> float:
        if not isfinite(self.q):
            self.q = self.prev = x
            self.moves = [0.0]
            return x
        self.moves = [*self.moves, x - self.prev][-9:]
        self.prev = x
        up = sum(d for d in self.moves if d > 0)
        dn = sum(-d for d in self.moves if d < 0)
        k = self.a * abs((up - dn) / (up + dn)) if up + dn else 0.0
        self.q = k * x + (1 - k) * self.q
        return self.q


class Bands:
    """A lower and an upper trailing band around a mean, and the side in force."""

    def __init__(self):
        self.lo = self.hi = nan
        self.side = 1

    def step(self, mean: float, width: float):
        lo, hi = mean - width, mean + width
        if isfinite(self.lo):
            if mean > self.lo:
                lo = max(lo, self.lo)
            if mean < self.hi:
                hi = min(hi, self.hi)
            if self.side < 0 and mean > self.hi:
                self.side = 1
            elif self.side > 0 and mean < self.lo:
                self.side = -1
        self.lo, self.hi = lo, hi
        return lo if self.side > 0 else hi


class Ott:
    """Adaptive mean and its optimised trailing line, both per bar."""

    def __init__(self, p: int, percent: float):
        self.ma, self.bands, self.pct = Vidya(p), Bands(), percent

    def step(self, x: float):
        m = self.ma.step(x)
        stop = self.bands.step(m, m * self.pct * 0.01)
        sign = 1 if m > stop else -1
        return m, stop * (200 + sign * self.pct) / 200


class SuperTrend:
    def __init__(self, mult: float = 3.0):
        self.mult, self.trend = mult, 1
        self.up = self.dn = self.c = nan

    def step(self, atr: float, h: float, l: float, c: float):
        prev_c, self.c = self.c, c
        if not isfinite(atr):
            return float(self.trend), nan
        mid = (h + l) / 2
        up, dn = mid + self.mult * atr, mid - self.mult * atr
        if isfinite(self.up):
            if not (up < self.up or prev_c > self.up):
                up = self.up
            if not (dn > self.dn or prev_c < self.dn):
                dn = self.dn
            if self.trend < 0 and c > self.up:
                self.trend = 1
            elif self.trend > 0 and c < self.dn:
                self.trend = -1
        self.up, self.dn = up, dn
        return float(self.trend), dn if self.trend > 0 else up


def _crossed(a0: float, b0: float, a1: float, b1: float) -> bool:
    return (a0 <= b0 and a1 > b1) or (a0 >= b0 and a1 < b1)


class Qqe:
    """Smoothed RSI and its fast trailing line."""

    def __init__(self, rsi: int = 6, smooth: int = 5, factor: float = 3.0):
        self.rsi, self.ma = Rsi(rsi), Ema(smooth)
        self.e1, self.e2, self.factor = Ema(2 * rsi - 1), Ema(2 * rsi - 1), factor
        self.m = nan
        self.longs = (nan, nan)
        self.shorts = (nan, nan)
        self.trend = 1

    def step(self, x: float):
        r = self.rsi.step(x)
        m = self.ma.step(r) if isfinite(r) else nan
        prev = self.m
        self.m = m
        move = abs(prev - m) if isfinite(prev) and isfinite(m) else nan
        d = self.e2.step(self.e1.step(move)) * self.factor if isfinite(move) else nan
        if not isfinite(d):
            return m, nan
        (l1, l2), (s1, s2) = self.longs, self.shorts
        lo0, hi0 = (l1 if isfinite(l1) else 0.0), (s1 if isfinite(s1) else 0.0)
        lo = max(lo0, m - d) if prev > lo0 and m > lo0 else m - d
        hi = min(hi0, m + d) if prev < hi0 and m < hi0 else m + d
        if isfinite(s1) and isfinite(s2):
            if _crossed(prev, s2, m, s1):
                self.trend = 1
            elif isfinite(l2) and _crossed(l2, prev, l1, m):
                self.trend = -1
        self.longs, self.shorts = (lo, l1), (hi, s1)
        return m, lo if self.trend > 0 else hi


class AnchoredVwap:
    """Volume-weighted price since the last reset; a reset bar is included."""

    def __init__(self):
        self.on, self.pv, self.v = False, 0.0, 0.0

    def step(self, reset: float, tp: float, v: float) -> float:
        if reset == 1.0:
            self.on, self.pv, self.v = True, 0.0, 0.0
        if not self.on:
            return nan
        self.pv += tp * v
        self.v += v
        return self.pv / self.v if self.v > 0 else nan

    levels = 1

    def values(self, reset: np.ndarray, tp: np.ndarray, v: np.ndarray) -> np.ndarray:
        out, starts = np.full(len(v), nan), np.flatnonzero(reset == 1.0).tolist()
        for a, b in zip([0, *starts], [*starts, len(v)]):
            if a or starts[:1] == [0]:
                self.on, self.pv, self.v = True, 0.0, 0.0
            if self.on and b > a:
                pv, total = (np.cumsum(np.concatenate([[s], x]))[1:] for s, x in ((self.pv, tp[a:b] * v[a:b]), (self.v, v[a:b])))
                with np.errstate(divide="ignore", invalid="ignore"):
                    out[a:b] = np.where(total > 0, pv / total, nan)
                self.pv, self.v = float(pv[-1]), float(total[-1])
        return out

    def summary(self, level: int, reset: np.ndarray, tp: np.ndarray, v: np.ndarray):
        starts = np.flatnonzero(reset == 1.0)
        a = int(starts[-1]) if len(starts) else 0
        return len(starts) > 0, float(np.cumsum(tp[a:] * v[a:])[-1]), float(np.cumsum(v[a:])[-1])

    def advance(self, level: int, summary) -> None:
        fresh, pv, v = summary
        if fresh:
            self.on, self.pv, self.v = True, pv, v
        elif self.on:
            self.pv, self.v = self.pv + pv, self.v + v
