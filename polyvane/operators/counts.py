"""Real counts: the fifteen fields of cells, each a projection (piece, cell) and one grouped count (partial before the shuffle).

Counts are additive over pieces: ``units_*`` are the cells one by one, ``real_*`` their counts, ``real_cells`` all fields in one grouped count.
"""

from __future__ import annotations

from polyvane.functions import cells as C
from polyvane.operators.polyphony import ADJACENT, COMPLETE, M, PAIRS, pick
from polyvane.plans.dialect import Plan


def count(p: str, /, **units: str) -> dict[str, str]:
    """The relations of a field: its cells by piece, and their counts."""
    out = {}
    for field, select in units.items():
        out[f"{p}units_{field}"] = select
        out[f"{p}real_{field}"] = f"SELECT cell, count(*) AS n FROM {{{p}units_{field}}} GROUP BY cell"
    return out


#: The other voices' pitches now and at the following change, in the column names of the window relations.
NOW, NEXT = ["o0", "o1", "o2"], ["q0", "q1", "q2"]


def add_counts(plan: Plan, p: str = "", rest: bool = True) -> None:
    r = lambda name: f"{{{p}{name}}}"
    pair = "concat(va, vb)"
    coarse = lambda a: f"substr({a}, 1, instr({a}, '|') - 1)"
    moves = f"SELECT piece, concat(k0, '/to/', k, '|slot=', slot) AS cell FROM {r('moves')} UNION ALL SELECT piece, concat({coarse('k0')}, '/to/', {coarse('k')}, '|slot=', slot) AS cell FROM {r('moves')}"
    following = ", ".join(f"lead({o}) OVER w AS {q}" for o, q in zip(NOW, NEXT, strict=True))
    plan.add(**{
        f"{p}pedals": f"SELECT piece, voice, sum({C.one('m = m0')}) AS stays FROM {r('held')} GROUP BY piece, voice",
        # survivors of runs of equal pitches, rests skipped: note, neighbours, what sounds at the next
        f"{p}changed": f"""SELECT piece, voice, i, m, lag(m) OVER w AS before, lead(m) OVER w AS after, {', '.join(NOW)}, {following}, held, hold_others FROM
            (SELECT *, lag(m) OVER (PARTITION BY piece, voice ORDER BY i) AS last FROM {r('held')} WHERE m IS NOT NULL) s WHERE last IS NULL OR last <> m
            WINDOW w AS (PARTITION BY piece, voice ORDER BY i)""",
        # for a held note the next change is the next survivor after it: its number is one more than that of the note's own run
        f"{p}numbered": f"""SELECT h.*, sum(new) OVER (PARTITION BY piece, voice ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM
            (SELECT *, {C.one('last IS NULL OR last <> m')} AS new FROM (SELECT *, lag(m) OVER (PARTITION BY piece, voice ORDER BY i) AS last FROM {r('held')} WHERE m IS NOT NULL) s) h""",
        f"{p}overheld": f"""SELECT h.piece, h.voice, h.i, h.m AS before, h.m, n.m AS after, {', '.join('h.' + o for o in NOW)}, {', '.join(f'n.{o} AS {q}' for o, q in zip(NOW, NEXT, strict=True))}
            FROM {r('numbered')} h JOIN {r('numbered')} n ON n.piece = h.piece AND n.voice = h.voice AND n.run = h.run + 1 AND n.new = 1 WHERE h.over = 1""",
    })
    plan.add(**count(
        p,
        v=f"SELECT piece, {C.v_cell('(a - a0)', '(b - b0)', '(a0 - b0)', '(a - b)', 'role')} AS cell FROM {r('pairs')}",
        o=f"SELECT piece, {C.o_cell(pair, 'a0', 'b0', 'a', 'b')} AS cell FROM {r('pairs')} WHERE role = 'adjacent'",
        h=f"SELECT piece, {C.h_cell(pair, '(' + pick('va') + ' - ' + pick('vb') + ')')} AS cell FROM {r('slices')} CROSS JOIN {ADJACENT} WHERE {COMPLETE}",
        s=f"SELECT piece, {C.s_cell(M, 'tonic')} AS cell FROM {r('slices')} WHERE {COMPLETE}",
        m=f"SELECT piece, {C.m_cell('voice', 'd0', '(m - m0)')} AS cell FROM {r('changes')}",
        g=f"SELECT piece, {C.g_cell('(m - m0)')} AS cell FROM {r('changes')}",
        u=f"SELECT piece, {C.u_cell(M, 'tonic')} AS cell FROM {r('beats')}",
        p=f"SELECT piece, {C.p_cell('db', 'ds')} AS cell FROM (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY i DESC) AS back FROM {r('slices')} WHERE {COMPLETE}) q WHERE back <= 2",
        q=f"SELECT piece, concat(p0, '/to/', p, '|slot=', CASE WHEN fin = 1 THEN 'fin' ELSE 'int' END) AS cell FROM {r('phrase_p')} WHERE back = 1 AND p0 IS NOT NULL",
        k=moves,
        j=moves,
        d=f"""SELECT c.piece, {C.d_cell('c.before', 'c.m', 'c.after', ['c.' + x for x in NOW], ['c.' + x for x in NEXT], 'c.held = 1', 'c.hold_others = 1', 'e.stays >= 4', 0)} AS cell
            FROM {r('changed')} c JOIN {r('pedals')} e ON e.piece = c.piece AND e.voice = c.voice WHERE c.before IS NOT NULL AND c.after IS NOT NULL
            UNION ALL SELECT c.piece, {C.d_cell('c.before', 'c.m', 'c.after', ['c.' + x for x in NOW], ['c.' + x for x in NEXT], '1 = 1', '1 = 0', 'e.stays >= 4', 1)} AS cell
            FROM {r('overheld')} c JOIN {r('pedals')} e ON e.piece = c.piece AND e.voice = c.voice""",
        f=f"""SELECT piece, concat('kind=L|bars=', cast(greatest(1, least(5, cast(@EVEN((t1 - t0) / 4000.0) AS int))) AS int)) AS cell FROM {r('phrases')}
            UNION ALL SELECT piece, concat('kind=S|slot=', CASE WHEN fin = 1 THEN 'fin' ELSE 'int' END, '|b=', {C.bucket('db')}) AS cell FROM {r('phrase_p')} WHERE back = 1""",
    ))
    if rest:  # these read the notes and pair steps themselves, which no change of the slices touches
        plan.add(
            pair_steps=f"""SELECT piece, i, va, vb, role, a - b AS interval, a0 - b0 AS interval_prev, a - a0 AS step_a, b - b0 AS step_b, {C.pmod('a - b')} AS interval_class,
                {C.perfect('(a - b)')} AS perfect, {C.motion('(a - a0)', '(b - b0)')} AS motion, {C.one('(a0 > b0) <> (a > b)')} AS crossed, {C.one("role = 'adjacent' AND (b > a0 OR a < b0)")} AS overlap,
                {C.one(f"role = 'outer' AND {C.perfect('(a - b)')} IN ('P5', 'P8', 'P5c', 'P8c') AND {C.motion('(a - a0)', '(b - b0)')} IN ('parallel', 'similar') AND abs(a - a0) > 2")} AS hidden,
                CASE WHEN xa = 1 AND xb = 1 THEN 'together' WHEN xa = 1 THEN concat(va, '_over_', vb) WHEN xb = 1 THEN concat(vb, '_over_', va) ELSE 'sustain' END AS attack,
                {C.one('i % 2 = 0')} AS is_beat
                FROM (SELECT piece, i, va, vb, role, {pick('va')} AS a, {pick('vb')} AS b, {pick('va', '0')} AS a0, {pick('vb', '0')} AS b0, {C.by_voice('va', 'x%s')} AS xa, {C.by_voice('vb', 'x%s')} AS xb
                FROM {{steps}} CROSS JOIN {PAIRS}) q WHERE a IS NOT NULL AND b IS NOT NULL AND a0 IS NOT NULL AND b0 IS NOT NULL""",
            **count("", w="SELECT piece, concat('mot=', motion) AS cell FROM {pair_steps}", r="SELECT piece, concat('v=', voice, '|oct=', cast(floor(midi / 12.0) AS int)) AS cell FROM {notes}"),
        )
