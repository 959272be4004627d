"""Step objects of the strategies whose state cannot be a bounded frame.

States can be moved: they hold ages and countdowns in bars, never bar numbers, and what
no longer matters is cleared. So a block's end state does not depend on where the
block lies, and two runs agree once their memory of the start is gone.
"""

from __future__ import annotations

from math import isfinite, nan

from barlight.functions.recurrences import Bands, Ema, Rma


class PMax:
    """Trailing line of an exponential mean; gives the mean and the line."""

    def __init__(self, p: int = 10, mult: float = 3.0):
        self.ma, self.atr, self.bands, self.mult = Ema(p), Rma(p), Bands(), mult

    def step(self, c: float, tr: float):
        m, a = self.ma.step(c), self.atr.step(tr)
        return (m, self.bands.step(m, self.mult * a)) if isfinite(a) else (m, nan)


class AlphaTrend:
    def __init__(self):
        self.x = nan

    def step(self, atr: float, flow: float, h: float, l: float) -> float:
        if not (isfinite(atr) and isfinite(flow)):
            self.x = nan
            return nan
        prev = self.x if isfinite(self.x) else 0.0
        self.x = max(l - atr, prev) if flow >= 50 else min(h + atr, prev)
        return self.x


class TrailingStop:
    """Stop one ATR behind the close, switching sides when it is crossed."""

    def __init__(self, p: int = 10):
        self.atr, self.stop, self.c = Rma(p), nan, nan

    def step(self, c: float, tr: float) -> float:
        prev_c, self.c = self.c, c
        a = self.atr.step(tr)
        if not isfinite(a):
            return nan
        s = self.stop if isfinite(self.stop) else 0.0
        if c > s and prev_c > s:
            self.stop = max(s, c - a)
        elif c < s and prev_c < s:
            self.stop = min(s, c + a)
        else:
            self.stop = c - a if c > s else c + a
        return self.stop


class ChandelierSide:
    """Side of the two trailing exits around the prior bar's mean price."""

    def __init__(self):
        self.side, self.lo, self.hi = 1.0, nan, nan

    def step(self, price: float, tr: float) -> float:
        if not isfinite(price):
            return self.side
        lo, hi = price - 2 * tr, price + 2 * tr
        lo0 = self.lo if isfinite(self.lo) else lo
        hi0 = self.hi if isfinite(self.hi) else hi
        self.lo = max(lo, lo0) if price > lo0 else lo
        self.hi = min(hi, hi0) if price < hi0 else hi
        if price > hi0:
            self.side = 1.0
        elif price < lo0:
            self.side = -1.0
        return self.side


class FlatBetween:
    """Target position with one flat bar between opposite sides."""

    def __init__(self):
        self.pos = self.queued = 0
        self.side = nan

    def step(self, side: float, up: float, dn: float) -> float:
        flip = side if isfinite(self.side) and side != self.side else 0.0
        first, self.side = not isfinite(self.side), side
        if first:
            return 0.0
        enter = 1 if flip > 0 and up == 1 else -1 if flip < 0 and dn == 1 else 0
        if self.pos == 0:
            if self.queued:
                self.pos, self.queued = self.queued, 0
            else:
                self.pos = enter
        elif (dn if self.pos > 0 else up) == 1:
            self.queued = enter if enter == -self.pos else 0
            self.pos = 0
        return float(self.pos)


class PivotCluster:
    """Rejection at a price where at least two of the last 24 pivots meet."""

    def __init__(self, keep: int = 24):
        self.keep = keep
        self.highs: list[float] = []
        self.lows: list[float] = []

    def step(self, ph, pl, atr, o, h, l, c) -> float:
        if isfinite(ph):
            self.highs = [*self.highs, ph][-self.keep:]
        if isfinite(pl):
            self.lows = [*self.lows, pl][-self.keep:]
        if not (isfinite(atr) and atr > 0):
            return 0.0
        near = [x for x in self.lows if abs(x - l) <= 0.35 * atr]
        if len(near) >= 2 and c > o and c > sum(near) / len(near):
            return 1.0
        near = [x for x in self.highs if abs(x - h) <= 0.35 * atr]
        return -1.0 if len(near) >= 2 and c < o and c < sum(near) / len(near) else 0.0


class Zone:
    """A price zone waiting for its retest; shared by the order-block family."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.dir, self.lo, self.hi, self.left = 0, nan, nan, 0

    def arm(self, side: int, lo: float, hi: float, bars: int) -> None:
        self.dir, self.lo, self.hi, self.left = side, lo, hi, bars

    def pass_bar(self) -> None:
        if self.dir:
            self.left = max(self.left - 1, -1)

    def retest(self, h: float, l: float, c: float) -> float:
        hit = (self.dir > 0 and l <= self.hi and c > self.hi) or (self.dir < 0 and h >= self.lo and c < self.lo)
        if not hit:
            return 0.0
        side = self.dir
        self.clear()
        return float(side)


class SweepOrderBlock:
    """Sweep, then displacement within four bars, then a retest of its order block."""

    def __init__(self):
        self.sweep, self.age, self.zone = 0, 0, Zone()
        self.past: list[tuple] = []

    def _reset(self) -> None:
        self.sweep = self.age = 0
        self.zone.clear()

    def step(self, ph, pl, atr, o, h, l, c) -> float:
        before = self.past
        self.past = [*before, (o, h, l, c)][-10:]
        self.zone.pass_bar()
        if self.sweep:
            self.age = min(self.age + 1, 5)
        if not (isfinite(ph) and isfinite(atr) and atr > 0):
            return 0.0
        if self.sweep == 0:
            if l < pl - 0.05 * atr and c > pl:
                self.sweep = 1
            elif h > ph + 0.05 * atr and c < ph:
                self.sweep = -1
            return 0.0
        if self.zone.dir == 0:
            if self.age > 4:
                self._reset()
                return 0.0
            if max(1e-12, h - l) >= 1.2 * atr and (c - o) * self.sweep > 0:
                self._arm(before, self.age)
        elif self.zone.left < 0:
            self._reset()
            return 0.0
        sig = self.zone.retest(h, l, c)
        if sig:
            self._reset()
        return sig

    def _arm(self, before, age) -> None:
        # The last opposite bar, looking back to four bars before the sweep.
        back = 1
        while back < age + 4 and back < len(before) and (before[-back][3] - before[-back][0]) * self.sweep >= 0:
            back += 1
        o, h, l, c = before[-min(back, len(before))]
        if self.sweep > 0:
            self.zone.arm(1, l, max(o, c), 20)
        else:
            self.zone.arm(-1, min(o, c), h, 20)


class ImpulseBlock:
    """Retest of the bar before a wide, heavy bar of the other colour."""

    def __init__(self):
        self.seen, self.zone, self.o, self.h, self.l, self.c = 0, Zone(), nan, nan, nan, nan

    def step(self, atr, mean_v, o, h, l, c, v) -> float:
        self.seen = min(self.seen + 1, 21)
        po, ph, pl, pc = self.o, self.h, self.l, self.c
        self.o, self.h, self.l, self.c = o, h, l, c
        z = self.zone
        z.pass_bar()
        if self.seen < 21 or not (isfinite(atr) and atr > 0 and isfinite(mean_v) and mean_v > 0):
            return 0.0
        if z.dir == 0:
            if max(1e-12, h - l) >= 1.5 * atr and v >= 1.3 * mean_v:
                if c > o and pc < po:
                    z.arm(1, pl, max(po, pc), 24)
                elif c < o and pc > po:
                    z.arm(-1, min(po, pc), ph, 24)
            return 0.0
        if z.left < 0:
            z.clear()
            return 0.0
        return z.retest(h, l, c)


class GapTouch:
    """First touch of the newest three-bar gap; the touch consumes it."""

    def __init__(self):
        self.dir, self.lo, self.hi = 0, nan, nan

    def step(self, h2, l2, h, l, c) -> float:
        if l > h2:
            self.dir, self.lo, self.hi = 1, h2, l
        elif h < l2:
            self.dir, self.lo, self.hi = -1, h, l2
        elif self.dir and l <= self.hi and h >= self.lo:
            side, lo, hi = self.dir, self.lo, self.hi
            self.dir, self.lo, self.hi = 0, nan, nan
            return float(side) if (c > lo if side > 0 else c < hi) else 0.0
        return 0.0


class GapInverse:
    """A violated gap changes sides and waits sixteen bars for its retest."""

    def __init__(self):
        self.gap, self.zone, self.lo, self.hi = 0, Zone(), nan, nan

    def _reset(self) -> None:
        self.gap, self.lo, self.hi = 0, nan, nan
        self.zone.clear()

    def step(self, h2, l2, h, l, c) -> float:
        z = self.zone
        z.pass_bar()
        new = 1 if l > h2 else -1 if h < l2 else 0
        if new:
            z.clear()
            self.gap, (self.lo, self.hi) = new, (h2, l) if new > 0 else (h, l2)
        if self.gap and not z.dir and (c < self.lo if self.gap > 0 else c > self.hi):
            z.arm(-self.gap, self.lo, self.hi, 16)
            return 0.0
        if z.dir and z.left < 0:
            self._reset()
            return 0.0
        sig = z.retest(h, l, c) if z.dir else 0.0
        if sig:
            self._reset()
        return sig


class BaseRetest:
    """Retest of a tight three-bar base left by an impulse; armed only when idle."""

    def __init__(self):
        self.seen, self.zone = 0, Zone()

    def step(self, atr, base_h, base_l, h, l, c) -> float:
        self.seen = min(self.seen + 1, 17)
        z = self.zone
        z.pass_bar()
        if self.seen < 17 or not (isfinite(atr) and atr > 0):
            return 0.0
        if z.dir == 0:
            if base_h - base_l <= 1.1 * atr and max(1e-12, h - l) >= 1.5 * atr:
                if c > base_h:
                    z.arm(1, base_l, base_h, 30)
                elif c < base_l:
                    z.arm(-1, base_l, base_h, 30)
            return 0.0
        if z.left < 0:
            z.clear()
            return 0.0
        return z.retest(h, l, c)


class ScoredZones:
    """Pivots with enough volume and reaction become zones; the newest touched one fires."""

    def __init__(self, keep: int = 40):
        self.keep = keep
        self.zones: list[tuple[int, float, int]] = []  # side, price, age up to the two bars that matter

    def step(self, ph, pl, atr, mean_v, pivot_v, pivot_c, h, l, c) -> float:
        self.zones = [(side, price, min(age + 1, 2)) for side, price, age in self.zones]
        ok = isfinite(atr) and atr > 0
        for side, price in ((-1, ph), (1, pl)):
            if isfinite(price):
                score = pivot_v / mean_v if isfinite(mean_v) and mean_v > 0 else 1.0
                score += abs(c - pivot_c) / atr if ok else 0.0
                if score >= 1.8:
                    self.zones.append((side, price, 0))
        self.zones = self.zones[-self.keep:]
        if not ok:
            return 0.0
        for at in range(len(self.zones) - 1, -1, -1):
            side, price, age = self.zones[at]
            if age < 2:
                continue
            edge = l if side > 0 else h
            if abs(edge - price) <= 0.25 * atr and (c - price) * side > 0:
                del self.zones[at]
                return float(side)
        return 0.0


class TrendLines:
    """Close through the line of two pivots that a third one confirms."""

    def __init__(self):
        self.seen, self.c = 0, nan
        self.highs: list[tuple[int, float]] = []  # age and price
        self.lows: list[tuple[int, float]] = []

    def step(self, ph, pl, atr, c) -> float:
        self.seen = min(self.seen + 1, 3)
        prev, self.c = self.c, c
        self.highs = [*[(age + 1, y) for age, y in self.highs], *([(3, ph)] if isfinite(ph) else [])][-3:]
        self.lows = [*[(age + 1, y) for age, y in self.lows], *([(3, pl)] if isfinite(pl) else [])][-3:]
        if not (isfinite(atr) and atr > 0) or self.seen < 3:
            return 0.0
        for side, points in ((1, self.highs), (-1, self.lows)):
            if len(points) == 3 and self._through(points, side, atr, prev, c):
                return float(side)
        return 0.0

    def _through(self, points, side, atr, prev, c) -> bool:
        (a1, y1), (a2, y2), (a3, y3) = points
        slope = (y2 - y1) / (a1 - a2)
        if abs(y3 - (y1 + slope * (a1 - a3))) > 0.35 * atr:
            return False
        before, now = y1 + slope * (a1 - 1), y1 + slope * a1
        if side > 0:
            return prev <= before and c > now + 0.08 * atr
        return prev >= before and c < now - 0.08 * atr


class Hold:
    """Position taken by an entry and held for a number of bars."""

    def __init__(self, bars: int):
        self.bars, self.pos, self.left = bars, 0, 0

    def step(self, entry: int) -> float:
        if self.pos:
            self.left -= 1
        if entry and entry != self.pos:
            self.pos, self.left = entry, self.bars
        if self.pos and self.left <= 0:
            self.pos = self.left = 0
        return float(self.pos)


# Retracement ratios and the ratio bands of the harmonic patterns
# (b, c, d legs and cd extension), in the order gartley, bat, butterfly, crab.
RETRACE = (0.382, 0.5, 0.618, 0.786)
HARMONICS = (
    ((0.55, 0.70), (0.382, 0.886), (0.72, 0.86), (1.10, 1.80)),
    ((0.30, 0.55), (0.382, 0.886), (0.82, 0.95), (1.50, 2.80)),
    ((0.70, 0.86), (0.382, 0.886), (1.18, 1.70), (1.50, 2.50)),
    ((0.30, 0.70), (0.382, 0.886), (1.45, 1.80), (2.00, 4.00)),
)
SWING_IDS = (
    "fib_golden_pocket", "fib_retrace_382", "fib_retrace_500", "fib_retrace_618", "fib_retrace_786",
    "elliott_w2_w3", "elliott_w4_w5", "elliott_abc", "harmonic_prz",
)


def _in(x: float, band) -> bool:
    return band[0] <= x <= band[1]


class SwingPatterns:
    """All retracement, wave and harmonic targets from one list of alternating swings.

    Prices are mirrored for the short side, so each rule is written once.  A rule
    fires once for the swings at hand, so the rules fired since the last new swing are enough.
    """

    def __init__(self, hold: int = 12, right: int = 3):
        self.right = right
        self.swings: list[tuple[str, float, int]] = []  # kind, price, age
        self.fired: list[str] = []
        self.holds = [Hold(hold) for _ in SWING_IDS]

    def _take(self, ph: float, pl: float) -> None:
        found = [(k, p, self.right) for k, p in (("H", ph), ("L", pl)) if isfinite(p)]
        if not found:
            return
        last = self.swings[-1] if self.swings else None
        new = found[0]
        if last and len(found) > 1 and new[0] == last[0]:
            new = found[1]
        if last is None or (new[0] != last[0] and new[2] < last[2]):
            self.swings.append(new)
        elif new[0] == last[0] and (new[1] > last[1] if new[0] == "H" else new[1] < last[1]):
            self.swings[-1] = new
        else:
            return
        self.swings, self.fired = self.swings[-8:], []

    def step(self, ph, pl, atr, hi3, lo3, o, h, l, c):
        self.swings = [(kind, price, age + 1) for kind, price, age in self.swings]
        self._take(ph, pl)
        entries: dict[str, int] = {}
        if isfinite(atr) and atr > 0 and len(self.swings) >= 2:
            last_high = self.swings[-1][0] == "H"
            self._retrace(entries, 1 if last_high else -1, 2.5 * atr, o, h, l, c)
            side = -1 if last_high else 1
            broke = c > hi3 if side > 0 else c < lo3
            if broke:
                self._waves(entries, side, 2.5 * atr)
        return tuple(hold.step(entries.get(i, 0)) for i, hold in zip(SWING_IDS, self.holds))

    def _fire(self, entries, rule, side) -> None:
        if rule not in self.fired:
            self.fired = sorted([*self.fired, rule])
            entries[rule] = side

    def _retrace(self, entries, d, least, o, h, l, c) -> None:
        base, top = d * self.swings[-2][1], d * self.swings[-1][1]
        span = top - base
        if abs(span) < least:
            return
        lo, hi, o, c = (l, h, o, c) if d > 0 else (-h, -l, -o, -c)
        if c <= o:
            return
        near, far = top - 0.618 * span, top - 0.67 * span
        if lo <= near and hi >= far and c > near:
            self._fire(entries, "fib_golden_pocket", d)
        for ratio, rule in zip(RETRACE, SWING_IDS[1:5]):
            level = top - ratio * span
            if lo <= level and c > level:
                self._fire(entries, rule, d)

    def _waves(self, entries, d, least) -> None:
        q = [d * s[1] for s in self.swings]
        if len(q) >= 3:
            a, b, e = q[-3:]
            if b - a >= least and e > a and _in((b - e) / (b - a), (0.382, 0.786)):
                self._fire(entries, "elliott_w2_w3", d)
        if len(q) >= 4:
            a, b, e, f = q[-4:]
            leg = a - b
            if (leg >= least and e < a and f < b and _in((e - b) / leg, (0.382, 0.786))
                    and _in((e - f) / leg, (0.618, 1.618))):
                self._fire(entries, "elliott_abc", d)
        if len(q) >= 5:
            x, a, b, e, f = q[-5:]
            w1, w3 = a - x, e - b
            if w1 < least or w3 <= 0 or a - b <= 0:
                return
            if (b > x and e > a and f > a and _in((a - b) / w1, (0.382, 0.786))
                    and _in((e - f) / w3, (0.236, 0.5))):
                self._fire(entries, "elliott_w4_w5", d)
            ratios = ((a - b) / w1, (e - b) / (a - b), (a - f) / w1, (e - f) / (e - b))
            if any(all(_in(r, band) for r, band in zip(ratios, bands)) for bands in HARMONICS):
                self._fire(entries, "harmonic_prz", d)
