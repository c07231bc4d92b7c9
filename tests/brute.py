"""The discovery fields in plain Python, written from their definitions and not from the plans: the second opinion that the tests hold the plans against."""

import hashlib
import math
from collections import Counter, defaultdict
from itertools import product

VOICES = "SATB"
EVENTS = {"view": ("S", 60), "click": ("A", 53), "purchase": ("T", 48), "error": ("B", 40)}
ROLES = {"SA": "adjacent", "AT": "adjacent", "TB": "adjacent", "ST": "diagonal", "AB": "diagonal", "SB": "outer"}
ADJACENT = ("SA", "AT", "TB")
DIATONIC = {0, 2, 4, 5, 7, 9, 11}
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
SLOTS, K = 30, 16


def hashed(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def sign(x):
    return (x > 0) - (x < 0)


class Piece:
    def __init__(self, name, notes):
        self.name, self.notes = name, notes  # voice -> [(onset, stop, pitch)]
        self.tonic = self._tonic()
        self.slices = [{v: next((m for a, b, m in notes[v] if a <= i < b), None) for v in VOICES} for i in range(SLOTS)]
        self.attack = [{v: any(a == i for a, _, _ in notes[v]) for v in VOICES} for i in range(SLOTS)]
        self.complete = [i for i in range(SLOTS) if None not in self.slices[i].values()]
        even = [i for i in self.complete if i % 2 == 0]
        self.beats = even if len(even) >= 2 else self.complete
        self.phrases = self._phrases()

    def _tonic(self):
        count = Counter(m % 12 for v in VOICES for _, _, m in self.notes[v])
        n = sum(count.values())
        best = None
        for tonic in range(12):
            for profile in (MAJOR, MINOR):
                score = round(sum(c * profile[(pc - tonic) % 12] for pc, c in count.items()) / n, 9)
                if best is None or score > best[0]:
                    best = (score, tonic)
        return best[1]

    def _phrases(self):
        """(start, end, is last) in thousandths of a quarter."""
        end = max(self.beats) * 500 + 10 if self.beats else (SLOTS - 1) * 500
        cuts = sorted({0, end} | {b * 500 for a, b, _ in self.notes["S"] if b - a >= 4 and b * 500 <= end})
        spans = [(x, y, y == cuts[-1]) for x, y in zip(cuts, cuts[1:])]
        if end <= 500:
            return [(0, end + 1000, True)]
        return [s for s in spans if s[1] - s[0] > 500]

    def deg(self, m):
        return (m - self.tonic) % 12

    def steps(self):
        """Index pairs of neighbouring complete slices."""
        return [(i - 1, i) for i in range(1, SLOTS) if i in self.complete and i - 1 in self.complete]

    def inside(self, phrase):
        return [i for i in self.beats if phrase[0] <= i * 500 < phrase[1]]

    def changes(self):
        """(voice, pitch, next) of neighbouring slots."""
        for v in VOICES:
            for i in range(1, SLOTS):
                a, b = self.slices[i - 1][v], self.slices[i][v]
                if a is not None and b is not None and a != b:
                    yield v, a, b


def pieces(events):
    """From (user, type, hours since the first of January, value, order)."""
    last = {}
    for user, kind, hours, value, order in sorted(events, key=lambda e: e[4]):
        if kind in EVENTS and 0 <= math.ceil(hours / 24) < SLOTS:
            voice, base = EVENTS[kind]
            last[user, voice, math.ceil(hours / 24)] = base + math.floor(value * 100 + 0.5) % 20
    notes = defaultdict(lambda: {v: [] for v in VOICES})
    for (user, voice, i), m in sorted(last.items()):
        notes[user][voice].append((i, m))
    return [Piece(u, {v: [(i, n[k + 1][0] if k + 1 < len(n) else SLOTS, m) for k, (i, m) in enumerate(n)] for v, n in by.items()}) for u, by in sorted(notes.items())]


def runs(items, key, keep_last=True):
    """Runs of equal keys collapsed to one item."""
    out = []
    for x in items:
        if out and key(out[-1]) == key(x):
            if keep_last:
                out[-1] = x
        else:
            out.append(x)
    return out


# cells

def bit(x):
    return str(int(bool(x)))


def v_cell(pair, a0, b0, a1, b1):
    da, db = a1 - a0, b1 - b0
    sgn = "stat" if not da and not db else "obl" if not da or not db else "same" if sign(da) == sign(db) else "opp"
    return f"both={bit(da and db)}|eqΔ={bit(da == db)}|pc07={bit(abs(a1 - b1) % 12 in (0, 7))}|hold={bit(a1 - b1 == a0 - b0)}|leapU={bit(abs(da) > 2)}|sgn={sgn}|role={ROLES[pair]}"


def o_cell(pair, a0, b0, a1, b1):
    return f"{pair}|ov={bit(b1 > a0 or a1 < b0)}"


def h_cell(pair, a, b):
    band = next(name for limit, name in ((0, "cross"), (8, "le8"), (13, "8to12"), (20, "12to19"), (10 ** 9, "gt19")) if a - b < limit)
    return f"{pair}|gap={band}"


def g_cell(d):
    d = abs(d)
    return "oct+" if d >= 12 else "7th" if d >= 10 else "tritone" if d == 6 else "leap" if d >= 5 else "small"


def m_cell(voice, deg, d):
    moves = {1: "+1", -1: "-1", -2: "-2", 0: "stay", 2: "step"}
    mv = moves.get(d) or {"oct+": "oct+", "7th": "7th", "tritone": "tritone"}.get(g_cell(d), "leap")
    return f"out={bit(voice in 'SB')}|lt={bit(deg == 11)}|b7={bit(deg == 10)}|mv={mv}"


def s_cell(m, tonic):
    degs = [(x - tonic) % 12 for x in m]
    third = any(abs(x - m[3]) % 12 in (3, 4) for x in m)
    triad = {0, 7} <= set(degs) and (3 in degs or 4 in degs)
    return f"nlt={min(2, degs.count(11))}|miss3={bit(not third)}|n7={min(2, degs.count(10))}|missTon={bit(not triad)}"


def u_cell(m, tonic):
    count = Counter((x - tonic) % 12 for x in m)
    return f"dbl={min((d for d, n in count.items() if n > 1), default='none')}"


def bucket(d):
    return str(d) if d in DIATONIC else "x"


def p_cell(bass, soprano):
    return f"b={bucket(bass)}|sop={bucket(soprano)}"


def k_token(m, tonic):
    degs = [(x - tonic) % 12 for x in m]
    return f"b={bucket(degs[3])}|set={'.'.join(map(str, sorted(set(degs))))}|ch={bit(set(degs) - DIATONIC)}"


def motion(da, db):
    if not da or not db:
        return "static" if da == db else "oblique"
    return "contrary" if sign(da) != sign(db) else "parallel" if da == db else "similar"


def d_cell(before, m, after, others, following, held, hold_others, pedal, over):
    inn = m % 12 in {x % 12 for x in others if x is not None}
    nxt = m % 12 in {x % 12 for x in following if x is not None}
    a, b = m - before, after - m
    bits = {"st01": abs(a) in (1, 2), "st12": abs(b) in (1, 2), "same": sign(a) == sign(b) != 0, "ret": after == before, "inn": inn, "held": held, "leap": abs(a) >= 3,
            "ant": nxt and not inn, "ped": pedal, "holdO": hold_others, "hov": over}
    return "|".join(f"{k}={bit(x)}" for k, x in bits.items())


# units: what a field counts, and how its null redraws it

def four(s):
    return [s[v] for v in VOICES]


def both_cells(a, b, slot):
    coarse = lambda t: t.split("|")[0]
    return [f"{a}/to/{b}|slot={slot}", f"{coarse(a)}/to/{coarse(b)}|slot={slot}"]


def moves(p):
    """(token, next token, slot) over the piece."""
    tokens = runs([(i, k_token(four(p.slices[i]), p.tonic)) for i in p.beats], lambda x: x[1])
    out = []
    for (_, a), (i, b) in zip(tokens, tokens[1:]):
        phrase = next((f for f in p.phrases if f[0] <= i * 500 <= f[1]), None)
        own = runs([(j, k_token(four(p.slices[j]), p.tonic)) for j in p.inside(phrase)], lambda x: x[1])[-3:] if phrase else []
        out.append((a, b, "fin" if i in [j for j, _ in own] else "int"))
    return out


def windows(p):
    """(voice, before, middle, after, others, following, held, others held, pedal, over)."""
    for v in VOICES:
        rest = [w for w in VOICES if w != v]
        line = [(i, p.slices[i][v]) for i in range(SLOTS) if p.slices[i][v] is not None]
        pedal = sum(a is not None and a == b for a, b in zip((s[v] for s in p.slices), (s[v] for s in p.slices[1:]))) >= 4
        survivors = runs(line, lambda x: x[1], keep_last=False)
        sounding = lambda i: [p.slices[i][w] for w in rest]
        for (_, a), (i, m), (j, b) in zip(survivors, survivors[1:], survivors[2:]):
            held = not p.attack[i][v] and any(p.attack[i][w] for w in rest)
            still = all(p.slices[i][w] is not None and not p.attack[i][w] for w in rest)
            yield v, a, m, b, sounding(i), sounding(j), held, still, pedal, False
        for i in range(1, SLOTS - 1):
            now, last = p.slices[i], p.slices[i - 1]
            moved = any(now[w] is not None and last[w] is not None and now[w] != last[w] for w in rest)
            if now[v] is not None and now[v] == last[v] and moved:
                after = next(((j, m) for j, m in line if j > i and m != now[v]), None)
                if after:
                    yield v, now[v], now[v], after[1], sounding(i), sounding(after[0]), True, False, pedal, True


def pair_steps(p):
    for pair in ROLES:
        a, b = pair
        for x, y in zip(p.slices, p.slices[1:]):
            if None not in (x[a], x[b], y[a], y[b]):
                yield y[a] - x[a], y[b] - x[b]


def cadences(p):
    """(last two different outer cells or one, is last phrase)."""
    for f in p.phrases:
        own = runs([p_cell(p.deg(p.slices[i]["B"]), p.deg(p.slices[i]["S"])) for i in p.inside(f)], lambda x: x)
        bass = [p.deg(p.slices[i]["B"]) for i in p.inside(f)]
        if own:
            yield own[-2:], bass[-1], f[2]


def real(ps):
    out = {f: Counter() for f in "VHMSPOGQKJDRUWF"}
    for p in ps:
        for i, j in p.steps():
            x, y = p.slices[i], p.slices[j]
            for pair in ROLES:
                a, b = pair
                out["V"][v_cell(pair, x[a], x[b], y[a], y[b])] += 1
                if pair in ADJACENT:
                    out["O"][o_cell(pair, x[a], x[b], y[a], y[b])] += 1
        for i in p.complete:
            s = p.slices[i]
            out["S"][s_cell(four(s), p.tonic)] += 1
            for a, b in ADJACENT:
                out["H"][h_cell(a + b, s[a], s[b])] += 1
        for v, a, b in p.changes():
            out["M"][m_cell(v, p.deg(a), b - a)] += 1
            out["G"][g_cell(b - a)] += 1
        for i in p.beats:
            out["U"][u_cell(four(p.slices[i]), p.tonic)] += 1
        for i in p.complete[-2:]:
            out["P"][p_cell(p.deg(p.slices[i]["B"]), p.deg(p.slices[i]["S"]))] += 1
        for own, bass, last in cadences(p):
            slot = "fin" if last else "int"
            if len(own) == 2:
                out["Q"][f"{own[0]}/to/{own[1]}|slot={slot}"] += 1
            out["F"][f"kind=S|slot={slot}|b={bucket(bass)}"] += 1
        for start, end, _ in p.phrases:
            out["F"][f"kind=L|bars={max(1, min(5, round((end - start) / 4000)))}"] += 1
        for a, b, slot in moves(p):
            for cell in both_cells(a, b, slot):
                out["K"][cell] += 1
                out["J"][cell] += 1
        for _, *w in windows(p):
            out["D"][d_cell(*w)] += 1
        for da, db in pair_steps(p):
            out["W"][f"mot={motion(da, db)}"] += 1
        for v in VOICES:
            for _, _, m in p.notes[v]:
                out["R"][f"v={v}|oct={m // 12}"] += 1
    return out


def catalogues(ps):
    pitch, step = {v: Counter() for v in VOICES}, {v: Counter() for v in VOICES}
    for p in ps:
        for v in VOICES:
            line = [m for _, _, m in p.notes[v]]
            pitch[v].update(line)
            step[v].update(b - a for a, b in zip(line, line[1:]))
    return pitch, step


def shares(c):
    n = sum(c.values())
    return {k: x / n for k, x in c.items()}


def null(ps):
    """Expected counts of K redraws of every unit; field K is drawn, with the same hashes."""
    pitch, step = catalogues(ps)
    ph, dh = {v: shares(pitch[v]) for v in VOICES}, {v: shares(step[v]) for v in VOICES}
    out = {f: defaultdict(float) for f in "VHMSPOGQKJDRUWF"}
    units, sonorities, sounds, changed, drawn = Counter(), Counter(), Counter(), Counter(), Counter()
    redraw = lambda v, m0: {m: x / (1 - ph[v].get(m0, 0)) for m, x in ph[v].items() if m != m0} if len(ph[v]) > 1 else ph[v]
    for p in ps:
        for i, _ in p.steps():
            for pair in ROLES:
                units[pair, p.slices[i][pair[0]] - p.slices[i][pair[1]]] += 1
        sonorities[p.tonic] += max(len(p.complete), 1)
        sounds[p.tonic] += max(len(p.beats), 1)
        for v, a, _ in p.changes():
            changed[v, a, p.deg(a)] += 1
        for v, before, m, after, others, following, held, still, pedal, over in windows(p):
            drawn[v, before, after, tuple(others), tuple(following), held, still, pedal, over] += 1
        cells = Counter(p_cell(p.deg(p.slices[i]["B"]), p.deg(p.slices[i]["S"])) for i in p.complete)
        for c, n in cells.items():
            out["P"][c] += 2 * K * n / len(p.complete)
        path = runs([p_cell(p.deg(p.slices[i]["B"]), p.deg(p.slices[i]["S"])) for i in p.beats], lambda x: x)
        fin = sum(f[2] for f in p.phrases) / len(p.phrases) if p.phrases else 0
        for a, b in zip(path, path[1:]):
            for slot, w in (("fin", fin), ("int", 1 - fin)):
                if p.phrases and w > 0:
                    out["Q"][f"{a}/to/{b}|slot={slot}"] += K * w / (len(path) - 1)
        own = moves(p)
        rate = sum(s == "fin" for _, _, s in own) / len(own) if own else 0.5
        for a, b, _ in own:
            for slot, w in (("fin", rate), ("int", 1 - rate)):
                for cell in both_cells(a, b, slot) if w > 0 else ():
                    out["J"][cell] += K * w
        for u, rep in product(range(max(len(own), 1)), range(K)):
            draw = [[at(pitch[v], hashed("K", p.name, u, rep, side, v)) for v in VOICES] for side in (0, 1)]
            slot = "fin" if hashed("Kslot", p.name, u, rep) / 2 ** 32 < rate else "int"
            for cell in both_cells(*(k_token(m, p.tonic) for m in draw), slot):
                out["K"][cell] += 1
        if p.beats:
            for bars in (1, 3, 5):
                out["F"][f"kind=L|bars={bars}"] += K * len(p.phrases) / 3
        for slot, stop, n in (("fin", "0", 1), ("int", "7", len(p.phrases) - 1)):
            bag = Counter(bucket(p.deg(p.slices[i]["B"])) for i in p.beats)
            bag = {b: c for b, c in bag.items() if b != stop} or bag
            for b, c in bag.items():
                if n > 0 and p.phrases:
                    out["F"][f"kind=S|slot={slot}|b={b}"] += K * n * c / sum(bag.values())
    for (pair, iv), n in units.items():
        for x, wx in dh[pair[0]].items():
            for y, wy in dh[pair[1]].items():
                out["V"][v_cell(pair, iv, 0, iv + x, y)] += K * n * wx * wy
                if pair in ADJACENT:
                    out["O"][o_cell(pair, iv, 0, iv + x, y)] += K * n * wx * wy
    for a, b in ADJACENT:
        for (x, wx), (y, wy) in product(ph[a].items(), ph[b].items()):
            out["H"][h_cell(a + b, x, y)] += K * max(sum(len(p.complete) for p in ps), 1) * wx * wy
    for field, cell, count in (("S", s_cell, sonorities), ("U", u_cell, sounds)):
        for draw in product(*(ph[v].items() for v in VOICES)):
            m, w = [x for x, _ in draw], math.prod(x for _, x in draw)
            for tonic, n in count.items():
                out[field][cell(m, tonic)] += K * n * w
    for (v, a, deg), n in changed.items():
        for m, w in redraw(v, a).items():
            out["M"][m_cell(v, deg, m - a)] += K * n * w
            out["G"][g_cell(m - a)] += K * n * w
    for (v, before, after, others, following, held, still, pedal, over), n in drawn.items():
        for m, w in (ph[v] if over else redraw(v, before)).items():
            out["D"][d_cell(before, m, after, others, following, held, still, pedal, over)] += K * n * w
    bag = shares(sum(pitch.values(), Counter()))
    n = sum(max(sum(len(p.notes[v]) for v in VOICES) // 4, 1) for p in ps)
    for v, (m, w), up in product(VOICES, bag.items(), (0, 12, -12)):
        out["R"][f"v={v}|oct={(m + up) // 12}"] += K * n * w / 3
    n = sum(max((sum(1 for _ in pair_steps(p)) or 1) * K // 4, K) for p in ps)
    out["W"]["mot=static"] += n * 0.2
    for a, b in ROLES:
        for (x, wx), (y, wy) in product(dh[a].items(), dh[b].items()):
            out["W"][f"mot={motion(x, y)}"] += n * 0.25 / 6 * wx * wy
            out["W"][f"mot={motion(x, sign(x) * max(abs(y), 1))}"] += n * 0.55 / 6 * wx * wy
    return out


def at(count, h):
    """The value at a hashed place of a histogram."""
    place, total = h * sum(count.values()) // 2 ** 32, 0
    for m in sorted(count):
        total += count[m]
        if place < total:
            return m


def residuals(nr, n0):
    """cell -> (rho, z) of a field."""
    keys, xs = nr.keys() | n0.keys(), list(n0.values())
    mu = sum(xs) / len(xs) if xs else 0
    var = sum((x - mu) ** 2 for x in xs) / len(xs) if xs else 0
    alpha = 0.5 if len(xs) < 4 or var <= mu + 1e-6 else min(2.5, max(0.15, mu * mu / (var - mu)))
    tr, t0 = sum(nr.values()) or 1, sum(xs) or 1
    out = {}
    for c in keys:
        a, b = nr.get(c, 0), n0.get(c, 0)
        lam = (b + 0.5) * tr / max(t0, 1)
        out[c] = (math.log((a + alpha) / (tr + alpha * len(keys))) - math.log((b + alpha) / (t0 + alpha * len(keys))), (a - lam) / math.sqrt(lam + 0.5))
    return out


def discoveries(nr, n0, z_cut=2.5, q=0.08, soft_z=-1.75):
    """Sets of (field, cell), prohibited and preferred."""
    sparse = set("QPGOKJDRUWF")
    under, over, tested = set(), set(), {"under": [], "over": []}
    cdf = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    for f in nr:
        res, tr, t0 = residuals(nr[f], n0[f]), sum(nr[f].values()) or 1, sum(n0[f].values()) or 1
        need = z_cut + max(0, math.log10(len(res) / 40))
        for c, (rho, z) in res.items():
            a, b = nr[f].get(c, 0), n0[f].get(c, 0)
            if max(a, b) >= (3 if f in sparse else 12):
                if z <= -need / 2:
                    tested["under"].append((max(cdf(z), 1e-15), f, c))
                if z >= need / 2:
                    tested["over"].append((max(1 - cdf(z), 1e-15), f, c))
            if z <= -need or a == 0 and b * tr / t0 >= -math.log(0.05):
                under.add((f, c))
            if z >= max(need - 0.7, 2.8) or f in sparse and z >= 1.15 and a >= 3 and rho > 0 or b == 0 and a >= 3 and rho >= 0.8:
                over.add((f, c))
            if f in "KJ" and "set=" not in c and "/to/" in c and a <= 5 and b >= 24 and rho <= soft_z and z <= soft_z:
                under.add((f, c))
    for side, found in (("under", under), ("over", over)):
        ranked = sorted(tested[side])
        cut = max((k for k, (p, _, _) in enumerate(ranked, 1) if p <= q * k / len(ranked)), default=0)
        found.update((f, c) for _, f, c in ranked[:cut])
    return under, over
