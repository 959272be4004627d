"""Plain full-history restatements of rules, used only by tests."""

import math

NAN = math.nan


def true_range(b):
    return [x["h"] - x["l"] if i == 0 else max(x["h"] - x["l"], abs(x["h"] - b[i - 1]["c"]), abs(x["l"] - b[i - 1]["c"])) for i, x in enumerate(b)]


def rma(xs, p):
    out = [None] * len(xs)
    for i in range(len(xs)):
        if i == p - 1:
            out[i] = sum(xs[:p]) / p
        elif i >= p:
            out[i] = (out[i - 1] * (p - 1) + xs[i]) / p
    return out


def ema(xs, p):
    out, a = [], 2 / (p + 1)
    for x in xs:
        prev = out[-1] if out else None
        out.append(x if x is None or prev is None else a * x + (1 - a) * prev)
    return out


def rsi(xs, p):
    d = [0.0] + [b - a for a, b in zip(xs, xs[1:])]
    g, s = rma([max(x, 0.0) for x in d], p), rma([max(-x, 0.0) for x in d], p)
    return [None if x is None else 100.0 if y == 0 else 0.0 if x == 0 else 100 - 100 / (1 + x / y) for x, y in zip(g, s)]


def pivots(b, n):
    """(index, kind, price) by confirming bar."""
    found = {i: [] for i in range(len(b))}
    for i in range(2 * n, len(b)):
        p = i - n
        near = [j for j in range(p - n, i + 1) if j != p]
        if all(b[j]["h"] < b[p]["h"] for j in near):
            found[i].append((p, "H", b[p]["h"]))
        if all(b[j]["l"] > b[p]["l"] for j in near):
            found[i].append((p, "L", b[p]["l"]))
    return found


def swing_list(found, upto):
    """Alternating swings known at a bar, rebuilt from the start."""
    out = []
    for i in range(upto + 1):
        ev = found[i]
        if len(ev) == 2:
            ev = [e for e in ev if out and e[1] != out[-1][1]] or ev[:1]
        for e in ev[:1]:
            if not out:
                out.append(e)
            elif e[1] != out[-1][1]:
                if e[0] > out[-1][0]:
                    out.append(e)
            elif (e[2] - out[-1][2]) * (1 if e[1] == "H" else -1) > 0:
                out[-1] = e
        out = out[-8:]
    return out


def wave_entry(rule, s, a, b, i):
    """Side of one wave rule at bar i, from its swings in plain long and short form."""
    need = {"elliott_w2_w3": 3, "elliott_abc": 4, "elliott_w4_w5": 5, "harmonic_prz": 5}[rule]
    if len(s) < need or i < 3:
        return 0
    pts = s[-need:]
    side = 1 if pts[-1][1] == "L" else -1
    past = b[i - 3:i]
    if side > 0 and not b[i]["c"] > max(x["h"] for x in past):
        return 0
    if side < 0 and not b[i]["c"] < min(x["l"] for x in past):
        return 0
    q = [p[2] if side > 0 else -p[2] for p in pts]
    least = 2.5 * a
    ok = lambda x, lo, hi: lo <= x <= hi
    if rule == "elliott_w2_w3":
        w = q[1] - q[0]
        return side if w >= least and q[2] > q[0] and ok((q[1] - q[2]) / w, 0.382, 0.786) else 0
    if rule == "elliott_abc":
        leg = q[0] - q[1]
        good = leg >= least and q[2] < q[0] and q[3] < q[1]
        return side if good and ok((q[2] - q[1]) / leg, 0.382, 0.786) and ok((q[2] - q[3]) / leg, 0.618, 1.618) else 0
    w1 = q[1] - q[0]
    if w1 < least:
        return 0
    if rule == "elliott_w4_w5":
        w3 = q[3] - q[2]
        good = q[2] > q[0] and q[3] > q[1] and q[4] > q[1]
        return side if good and ok((q[1] - q[2]) / w1, 0.382, 0.786) and ok((q[3] - q[4]) / w3, 0.236, 0.5) else 0
    ab, bc, cd = q[1] - q[2], q[3] - q[2], q[3] - q[4]
    if ab <= 0 or bc <= 0:
        return 0
    r = (ab / w1, bc / ab, (q[1] - q[4]) / w1, cd / bc)
    table = {"gartley": ((.55, .70), (.382, .886), (.72, .86), (1.1, 1.8)), "bat": ((.30, .55), (.382, .886), (.82, .95), (1.5, 2.8)),
             "butterfly": ((.70, .86), (.382, .886), (1.18, 1.70), (1.5, 2.5)), "crab": ((.30, .70), (.382, .886), (1.45, 1.80), (2., 4.))}
    return side if any(all(ok(x, *lim) for x, lim in zip(r, lims)) for lims in table.values()) else 0


def retrace_entry(ratio, s, a, b, i):
    if len(s) < 2:
        return 0
    (_, k1, x1), (_, _, x2) = s[-2:]
    if abs(x2 - x1) < 2.5 * a:
        return 0
    bar = b[i]
    if k1 == "L":
        level = x2 - ratio * (x2 - x1)
        return 1 if bar["l"] <= level < bar["c"] and bar["c"] > bar["o"] else 0
    level = x2 + ratio * (x1 - x2)
    return -1 if bar["h"] >= level > bar["c"] and bar["c"] < bar["o"] else 0


def held(entries, bars=12):
    pos, until, out = 0, -1, []
    for i, e in enumerate(entries):
        if e and e != pos:
            pos, until = e, i + bars
        if pos and i >= until:
            pos = 0
        out.append(pos)
    return out


def swing_targets(b):
    found, atr = pivots(b, 3), rma(true_range(b), 14)
    rules = {"fib_retrace_382": .382, "fib_retrace_500": .5, "fib_retrace_618": .618, "fib_retrace_786": .786}
    waves = ["elliott_w2_w3", "elliott_abc", "elliott_w4_w5", "harmonic_prz"]
    size = {"elliott_w2_w3": 3, "elliott_abc": 4, "elliott_w4_w5": 5, "harmonic_prz": 5}
    entries = {r: [0] * len(b) for r in [*rules, *waves]}
    used = {r: set() for r in entries}
    for i in range(len(b)):
        s = swing_list(found, i)
        if not atr[i] or len(s) < 2:
            continue
        for r in entries:
            e = retrace_entry(rules[r], s, atr[i], b, i) if r in rules else wave_entry(r, s, atr[i], b, i)
            key = tuple(p[0] for p in s[-size.get(r, 2):])
            if e and key not in used[r]:
                used[r].add(key)
                entries[r][i] = e
    return {r: held(e) for r, e in entries.items()}


def drawdown(returns):
    eq = peak = 1.0
    worst = 0.0
    for r in returns:
        eq *= max(1e-9, 1 + r)
        peak = max(peak, eq)
        worst = max(worst, 1 - eq / peak)
    return eq - 1, worst
