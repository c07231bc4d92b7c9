"""Null counts: what each field would hold if its dependency were destroyed, K replays of every real unit.

``exact`` null counts are closed-form expectations: products of catalogue histograms, grouped before they are multiplied, so that no replay
is ever exploded. Field K, whose support explodes, is sampled instead, with draws hashed from (seed, piece, unit, replay, voice), the same on
every run, partitioning and engine. Catalogues come from all pieces of the plan's notes.
"""

from __future__ import annotations

from polyvane.functions import cells as C
from polyvane.operators.counts import NEXT, NOW
from polyvane.operators.polyphony import ADJACENT, COMPLETE, M, PAIRS, SLOTS, values
from polyvane.plans.dialect import Plan

K = 16


def expect(select: str) -> str:
    """Expected counts; rounded, so that thresholds on them don't turn on the order of additions."""
    return f"SELECT cell, round(sum(@DOUBLE(n)), 8) AS n FROM ({select}) s GROUP BY cell"


def add_catalogues(plan: Plan, pooled: bool = False, swapped: bool = False) -> None:
    """Histograms of steps and pitches by voice: pitch_cat(voice, m, n, total, share), dp_cat(voice, d, n, share).

    pooled: one bag of pitches for all voices; swapped: S with B and A with T.
    """
    voice = "CASE voice WHEN 'S' THEN 'B' WHEN 'B' THEN 'S' WHEN 'A' THEN 'T' ELSE 'A' END" if swapped else "voice"
    own = "SELECT voice, midi AS m, count(*) AS n FROM {cat_notes} GROUP BY voice, midi"
    if pooled:
        own = f"SELECT v.voice, m, n FROM (SELECT midi AS m, count(*) AS n FROM {{cat_notes}} GROUP BY midi) b CROSS JOIN {values([(v,) for v in C.VOICES], 'v(voice)')}"
    plan.add(
        pitch_cat=f"SELECT {voice} AS voice, m, n, sum(n) OVER (PARTITION BY voice) AS total, @DOUBLE(n) / sum(n) OVER (PARTITION BY voice) AS share, count(*) OVER (PARTITION BY voice) AS kinds FROM ({own}) c",
        dp_cat=f"SELECT {voice} AS voice, d, n, @DOUBLE(n) / sum(n) OVER (PARTITION BY voice) AS share FROM (SELECT voice, next_midi - midi AS d, count(*) AS n FROM {{cat_notes}} WHERE next_midi IS NOT NULL GROUP BY voice, next_midi - midi) c",
    )


def add_nulls(plan: Plan, p: str = "", rest: bool = True) -> None:
    r = lambda name: f"{{{p}{name}}}"
    pair, four = "concat(va, vb)", ["s.m", "a.m", "t.m", "b.m"]
    # a cell reads pitch classes and, of the distance to the bass, its class: pitches of a voice that agree in both are one row with their shares together
    bass = f"CROSS JOIN (SELECT m, share FROM {{pitch_cat}} WHERE voice = 'B') b"
    upper = lambda v: f"""JOIN (SELECT b.m AS bass, min(x.m) AS m, sum(x.share) AS share FROM {{pitch_cat}} x JOIN {{pitch_cat}} b ON b.voice = 'B' WHERE x.voice = '{v}'
        GROUP BY b.m, {C.pmod('x.m')}, abs(x.m - b.m) % 12) {v.lower()} ON {v.lower()}.bass = b.m"""  # noqa: E731
    sonorities = f"{bass} {upper('S')} {upper('A')} {upper('T')}"
    share4 = "s.share * a.share * t.share * b.share"
    stepped = f"""(SELECT va, vb, role, a0 - b0 AS iv, count(*) AS n FROM {r('pairs')} GROUP BY va, vb, role, a0 - b0) u
        JOIN {{dp_cat}} x ON x.voice = u.va JOIN {{dp_cat}} y ON y.voice = u.vb"""
    # a redrawn note is any of the voice's pitches but the one it would leave, if the voice has more than one
    redrawn = lambda units, m0: f"{units} u JOIN {{pitch_cat}} x ON x.voice = u.voice AND (x.m <> {m0} OR x.kinds = 1) LEFT JOIN {{pitch_cat}} z ON z.voice = u.voice AND z.m = {m0}"
    left = "CASE WHEN x.kinds = 1 THEN 1 ELSE 1 - coalesce(z.share, 0) END"
    changes = redrawn(f"(SELECT voice, m0, {C.one('d0 = 11')} AS lt, {C.one('d0 = 10')} AS b7, count(*) AS n FROM {r('changes')} GROUP BY voice, m0, {C.one('d0 = 11')}, {C.one('d0 = 10')})", "u.m0")
    coarse = lambda a: f"substr({a}, 1, instr({a}, '|') - 1)"
    both = lambda a, b, slot: [f"concat({a}, '/to/', {b}, '|slot={slot}')", f"concat({coarse(a)}, '/to/', {coarse(b)}, '|slot={slot}')"]
    d_args = (["u." + x for x in NOW], ["u." + x for x in NEXT])
    # windows are told apart by no more than a cell reads: the outer notes, the other voices' pitch classes, and the flags
    classes = ", ".join(f"{C.pmod('c.' + x)} AS {x}" for x in NOW + NEXT)

    def alike(flags: str, source: str, where: str) -> str:
        inner = f"SELECT c.voice, c.before, c.after, {classes}, {flags}{C.one('e.stays >= 4')} AS ped FROM {r(source)} c JOIN {r('pedals')} e ON e.piece = c.piece AND e.voice = c.voice {where}"
        names = ", ".join(["voice", "before", "after", *NOW, *NEXT, *(["held", "hold_others"] if flags else []), "ped"])
        return f"(SELECT {names}, count(*) AS n FROM ({inner}) w GROUP BY {names})"

    plan.add(**{
        f"{p}null_v": expect(f"SELECT {C.v_cell('x.d', 'y.d', 'u.iv', '(u.iv + x.d - y.d)', 'u.role')} AS cell, {K} * u.n * x.share * y.share AS n FROM {stepped}"),
        f"{p}null_o": expect(f"SELECT concat({pair}, '|ov=', {C.one('y.d > u.iv OR x.d < -u.iv')}) AS cell, {K} * u.n * x.share * y.share AS n FROM {stepped} WHERE u.role = 'adjacent'"),
        f"{p}null_h": expect(f"""SELECT {C.h_cell(pair, '(x.m - y.m)')} AS cell, {K} * u.n * x.share * y.share AS n FROM (SELECT greatest(count(*), 1) AS n FROM {r('slices')} WHERE {COMPLETE}) u
            CROSS JOIN {ADJACENT} JOIN {{pitch_cat}} x ON x.voice = p.va JOIN {{pitch_cat}} y ON y.voice = p.vb"""),
        f"{p}null_s": expect(f"""SELECT {C.s_cell(four, 'u.tonic')} AS cell, {K} * u.n * {share4} AS n FROM (SELECT tonic, sum(greatest(n, 1)) AS n FROM
            (SELECT piece, tonic, sum({C.one(COMPLETE)}) AS n FROM {r('slices')} GROUP BY piece, tonic) q GROUP BY tonic) u {sonorities}"""),
        f"{p}null_u": expect(f"""SELECT {C.u_cell(four, 'u.tonic')} AS cell, {K} * u.n * {share4} AS n FROM (SELECT tonic, sum(greatest(n, 1)) AS n FROM
            (SELECT t.piece, t.tonic, count(b.i) AS n FROM {{tonic}} t LEFT JOIN {r('beats')} b ON b.piece = t.piece GROUP BY t.piece, t.tonic) q GROUP BY tonic) u {sonorities}"""),
        f"{p}null_m": expect(f"SELECT concat('out=', {C.one('u.voice IN (' + repr('S') + ', ' + repr('B') + ')')}, '|lt=', u.lt, '|b7=', u.b7, '|mv=', {C.move('(x.m - u.m0)')}) AS cell, {K} * u.n * x.share / ({left}) AS n FROM {changes}"),
        f"{p}null_g": expect(f"SELECT {C.g_cell('(x.m - u.m0)')} AS cell, {K} * u.n * x.share / ({left}) AS n FROM {changes}"),
        f"{p}null_p": expect(f"SELECT cell, {2 * K} * @DOUBLE(n) / sum(n) OVER (PARTITION BY piece) AS n FROM (SELECT piece, {C.p_cell('db', 'ds')} AS cell, count(*) AS n FROM {r('slices')} WHERE {COMPLETE} GROUP BY piece, {C.p_cell('db', 'ds')}) q"),
        f"{p}q_rate": f"SELECT piece, avg(@DOUBLE(fin)) AS fin FROM {r('phrases')} GROUP BY piece",
        f"{p}null_q": expect(f"""SELECT concat(q.p0, '/to/', q.p, '|slot=', f.slot) AS cell, {K} * (CASE f.slot WHEN 'fin' THEN r.fin ELSE 1 - r.fin END) / q.moves AS n FROM
            (SELECT *, count(*) OVER (PARTITION BY piece) AS moves FROM {r('uniq_p')} WHERE p0 IS NOT NULL) q JOIN {r('q_rate')} r ON r.piece = q.piece CROSS JOIN {values([('fin',), ('int',)], 'f(slot)')}
            WHERE f.slot = 'fin' AND r.fin > 0 OR f.slot = 'int' AND r.fin < 1"""),
        f"{p}k_rate": f"SELECT piece, avg(@DOUBLE({C.one(chr(115) + 'lot = ' + repr('fin'))})) AS fin, count(*) AS moves FROM {r('moves')} GROUP BY piece",
        f"{p}null_j": expect(" UNION ALL ".join(f"SELECT {cell} AS cell, {K} * {w} AS n FROM {r('moves')} m JOIN {r('k_rate')} r ON r.piece = m.piece WHERE {w} > 0"
                                                for slot, w in (("fin", "r.fin"), ("int", "(1 - r.fin)")) for cell in both("m.k0", "m.k", slot))),
        f"{p}null_d": expect(f"""SELECT {C.d_cell('u.before', 'x.m', 'u.after', *d_args, 'u.held = 1', 'u.hold_others = 1', 'u.ped = 1', 0)} AS cell, {K} * u.n * x.share / ({left}) AS n FROM
            {redrawn(alike("c.held, c.hold_others, ", 'changed', "WHERE c.before IS NOT NULL AND c.after IS NOT NULL"), 'u.before')}
            UNION ALL SELECT {C.d_cell('u.before', 'x.m', 'u.after', *d_args, '1 = 1', '1 = 0', 'u.ped = 1', 1)} AS cell, {K} * u.n * x.share AS n FROM
            {alike("", 'overheld', "")} u JOIN {{pitch_cat}} x ON x.voice = u.voice"""),
        f"{p}null_f": expect(f"""SELECT concat('kind=L|bars=', v.bars) AS cell, {K} * q.n / 3.0 AS n FROM (SELECT piece, count(*) AS n FROM {r('phrases')} WHERE piece IN (SELECT piece FROM {r('beats')}) GROUP BY piece) q CROSS JOIN {values([(1,), (3,), (5,)], 'v(bars)')}
            UNION ALL SELECT concat('kind=S|slot=', s.slot, '|b=', s.b) AS cell, {K} * (CASE s.slot WHEN 'fin' THEN 1.0 ELSE q.n - 1.0 END) * s.n / s.total AS n FROM
            (SELECT piece, slot, b, n, sum(n) OVER (PARTITION BY piece, slot) AS total FROM
             (SELECT piece, slot, b, n, max({C.one('b <> stop')}) OVER (PARTITION BY piece, slot) AS others, stop FROM
              (SELECT piece, {C.bucket('db')} AS b, count(*) AS n FROM {r('beats')} GROUP BY piece, {C.bucket('db')}) h CROSS JOIN {values([('fin', '0'), ('int', '7')], 'f(slot, stop)')}) g WHERE others = 0 OR b <> stop) s
            JOIN (SELECT piece, count(*) AS n FROM {r('phrases')} GROUP BY piece) q ON q.piece = s.piece WHERE s.slot = 'fin' OR q.n > 1"""),
        f"{p}k_units": f"SELECT t.piece, t.tonic, greatest(coalesce(max(r.moves), 0), 1) AS units, coalesce(max(r.fin), 0.5) AS fin FROM {{tonic}} t LEFT JOIN {r('k_rate')} r ON r.piece = t.piece GROUP BY t.piece, t.tonic",
        # sampled: for each unit and replay, two sonorities of four hashed draws each, and a hashed slot
        f"{p}k_draws": f"""SELECT piece, u, rep, tonic, fin, side, max(CASE WHEN voice = 'S' THEN m END) AS ms, max(CASE WHEN voice = 'A' THEN m END) AS ma, max(CASE WHEN voice = 'T' THEN m END) AS mt, max(CASE WHEN voice = 'B' THEN m END) AS mb FROM
            (SELECT d.piece, d.u, d.rep, d.tonic, d.fin, d.side, d.voice, c.m FROM
             (SELECT q.piece, q.tonic, q.fin, g.i AS u, h.rep, s.side, c.voice, floor(@HASH32(concat_ws('|', 'K', q.piece, g.i, h.rep, s.side, c.voice)) * c.total / 4294967296.0) AS x
              FROM {r('k_units')} q JOIN {values([(k,) for k in range(SLOTS)], 'g(i)')} ON g.i < q.units CROSS JOIN {values([(k,) for k in range(K)], 'h(rep)')} CROSS JOIN {values([(0,), (1,)], 's(side)')}
              CROSS JOIN (SELECT DISTINCT voice, total FROM {{pitch_cat}}) c) d
             JOIN (SELECT voice, m, sum(n) OVER (PARTITION BY voice ORDER BY m) AS hi, sum(n) OVER (PARTITION BY voice ORDER BY m) - n AS lo FROM {{pitch_cat}}) c ON c.voice = d.voice AND d.x >= c.lo AND d.x < c.hi) e
            GROUP BY piece, u, rep, tonic, fin, side""",
        f"{p}k_sampled": f"""SELECT max(CASE WHEN side = 0 THEN k END) AS k0, max(CASE WHEN side = 1 THEN k END) AS k, CASE WHEN @HASH32(concat_ws('|', 'Kslot', piece, u, rep)) / 4294967296.0 < fin THEN 'fin' ELSE 'int' END AS slot
            FROM (SELECT piece, u, rep, fin, side, {C.k_token(M, 'tonic')} AS k FROM {r('k_draws')}) d GROUP BY piece, u, rep, fin""",
        f"{p}null_k": f"SELECT cell, @DOUBLE(count(*)) AS n FROM (SELECT concat(k0, '/to/', k, '|slot=', slot) AS cell FROM {r('k_sampled')} UNION ALL SELECT concat({coarse('k0')}, '/to/', {coarse('k')}, '|slot=', slot) AS cell FROM {r('k_sampled')}) s GROUP BY cell",
    })
    if rest:
        plan.add(
            null_r=expect(f"""SELECT concat('v=', v.voice, '|oct=', cast(floor((b.m + o.up) / 12.0) AS int)) AS cell, {K} * u.n * b.share / 3 AS n FROM
                (SELECT sum(greatest(cast(floor(n / 4.0) AS int), 1)) AS n FROM (SELECT piece, count(*) AS n FROM {{notes}} GROUP BY piece) q) u CROSS JOIN {values([(v,) for v in C.VOICES], 'v(voice)')}
                CROSS JOIN (SELECT m, sum(n) * 1.0D / max(total) AS share FROM (SELECT m, n, sum(n) OVER () AS total FROM {{pitch_cat}}) a GROUP BY m) b CROSS JOIN {values([(0,), (12,), (-12,)], 'o(up)')}""".replace("1.0D", "@DOUBLE(1)")),
            # a voice pair at random; the lower voice's step takes the upper one's sign, or both rest, or it is free
            null_w=expect(f"""SELECT concat('mot=', {C.motion('da', 'db')}) AS cell, u.n * w AS n FROM
                (SELECT sum(greatest(floor((CASE WHEN n = 0 THEN 1 ELSE n END) * {K} / 4.0), {K})) AS n FROM (SELECT t.piece, count(s.i) AS n FROM {{tonic}} t LEFT JOIN {{pair_steps}} s ON s.piece = t.piece GROUP BY t.piece) q) u CROSS JOIN
                (SELECT x.d AS da, CASE WHEN x.d = 0 THEN 0 WHEN x.d > 0 THEN greatest(abs(y.d), 1) ELSE -greatest(abs(y.d), 1) END AS db, x.share * y.share * 0.55 / 6 AS w FROM {PAIRS} JOIN {{dp_cat}} x ON x.voice = p.va JOIN {{dp_cat}} y ON y.voice = p.vb
                 UNION ALL SELECT 0, 0, 0.20
                 UNION ALL SELECT x.d, y.d, x.share * y.share * 0.25 / 6 FROM {PAIRS} JOIN {{dp_cat}} x ON x.voice = p.va JOIN {{dp_cat}} y ON y.voice = p.vb) m"""),
        )
