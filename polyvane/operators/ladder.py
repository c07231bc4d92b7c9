"""The null ladder: null models that give back one layer of the music's structure after the other, and what each still fails to explain.

A unit is a step between two complete slices. L0 is the replay null of the fields. From L1 on a voice moves only where it attacks; L1 draws from
the step catalogue for V and from the pitch catalogue for the other fields, L2 draws steps throughout, L3 draws steps given the register of the
pitch it leaves (fifths of the voice's pitches), L3D given its degree, L4 given register, degree and class of the step before. A context seen
fewer than LEAST times gives way to the next wider one. Draws are hashes of (level, piece, slice, voice, replay).

Everything is keyed by unit, voice and replay; catalogues number with the vocabulary and are joined on voice and context.
"""

from __future__ import annotations

from polyvane.functions import cells as C
from polyvane.functions.predicates import predicates
from polyvane.operators.polyphony import ADJACENT, COMPLETE, M, PAIRS, VOICES, pick, values
from polyvane.plans.dialect import Plan

REPLAYS, LEAST = 16, 20
LEVELS = ("L1", "L2", "L3", "L3D", "L4")
TARGETS = ("A1", "A2", "A5", "A11", "A12", "E2")
BEFORE = [f"{m}0" for m in M]


def add_ladder(plan: Plan) -> None:
    both = " AND ".join([COMPLETE] + [f"{m} IS NOT NULL" for m in BEFORE])
    kind = "CASE WHEN last IS NULL THEN 'none' WHEN last = 0 THEN 'rep' WHEN abs(last) <= 2 THEN CASE WHEN last > 0 THEN 'su' ELSE 'sd' END WHEN last > 0 THEN 'lu' ELSE 'ld' END"
    voiced = f"""SELECT piece, i, tonic, voice, {pick('voice')} AS m, {pick('voice', '0')} AS m0, {C.by_voice('voice', 'x%s')} AS x, {C.by_voice('voice', 'd%s0')} AS d0, {C.one(both)} AS unit FROM {{steps}} CROSS JOIN {VOICES}"""
    levels, replays = values([(x,) for x in LEVELS], "l(level)"), values([(k,) for k in range(REPLAYS)], "r(rep)")
    # the widest context is the whole step catalogue; L1 outside field V draws pitches instead
    wide = lambda *names: "coalesce(" + ", ".join([f"CASE WHEN {n}.total >= {LEAST} THEN {n}.context END" for n in names] + ["'all'"]) + ")"
    pivot = ", ".join(f"max(CASE WHEN voice = '{v}' THEN {a} END) AS m{v.lower()}{b}" for a, b in (("m", ""), ("m0", "0")) for v in C.VOICES)
    cells = lambda source, columns, where: f"""SELECT {columns}, 'V' AS field, {C.v_cell('(a - a0)', '(b - b0)', '(a0 - b0)', '(a - b)', 'role')} AS cell FROM
        (SELECT {columns}, p.role, {pick('va')} AS a, {pick('vb')} AS b, {pick('va', '0')} AS a0, {pick('vb', '0')} AS b0 FROM {source} CROSS JOIN {PAIRS} WHERE {where[0]}) v
        UNION ALL SELECT {columns}, 'H', {C.h_cell('concat(va, vb)', '(' + pick('va') + ' - ' + pick('vb') + ')')} FROM {source} CROSS JOIN {ADJACENT} WHERE {where[1]}
        UNION ALL SELECT {columns}, 'S', {C.s_cell(M, 'tonic')} FROM {source} WHERE {where[1]} UNION ALL SELECT {columns}, 'U', {C.u_cell(M, 'tonic')} FROM {source} WHERE {where[1]}"""  # noqa: E731
    # which cells a target atom takes, by its own predicate on the cell's text
    chosen = [(a, f, w) for a, f, _, w in predicates() if a in TARGETS]
    target = " UNION ALL ".join(f"SELECT '{a}' AS target, level, rep, n, {C.one(f'({w})')} AS hit FROM (SELECT level, rep, field, cell, n, @DOUBLE(0) AS rho FROM {{ladder_all}}) c WHERE field = '{f}'" for a, f, w in chosen)
    plan.add(
        ladder_units=f"""SELECT piece, i, tonic, voice, m, m0, x, d0, {kind} AS before FROM
            (SELECT *, @LATEST(CASE WHEN x = 1 THEN m - m0 END) OVER (PARTITION BY piece, voice ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM ({voiced}) s) t WHERE unit = 1""",
        # register: how many of the four inner fifths of the voice's pitches a pitch has reached
        registers=f"""SELECT c.voice, c.m, sum({C.one('floor(c.total * q.q / 5.0) < c.upto')}) AS register FROM (SELECT voice, m, total, sum(n) OVER (PARTITION BY voice ORDER BY m) AS upto FROM {{pitch_cat}}) c
            CROSS JOIN {values([(k,) for k in range(1, 5)], 'q(q)')} GROUP BY c.voice, c.m""",
        ladder_states="""SELECT u.*, concat('r', r.register) AS by_register, concat('d', u.d0) AS by_degree, concat('p', r.register, '.', u.d0, '.', u.before) AS by_step FROM {ladder_units} u JOIN {registers} r ON r.voice = u.voice AND r.m = u.m0""",
        contexts=" UNION ALL ".join([f"SELECT voice, {c} AS context, m - m0 AS d, count(*) AS n FROM {{ladder_states}} WHERE x = 1 GROUP BY voice, {c}, m - m0" for c in ("by_register", "by_degree", "by_step")]
                                    + ["SELECT voice, 'all', d, n FROM {dp_cat}", "SELECT voice, 'pitch', m, n FROM {pitch_cat}"]),
        context_ranges="SELECT voice, context, d, sum(n) OVER (PARTITION BY voice, context ORDER BY d) AS hi, sum(n) OVER (PARTITION BY voice, context ORDER BY d) - n AS lo FROM {contexts}",
        context_totals="SELECT voice, context, sum(n) AS total FROM {contexts} GROUP BY voice, context",
        ladder_wanted=f"""SELECT u.piece, u.i, u.tonic, u.voice, u.m0, u.x, l.level, 0 AS pitched, CASE l.level WHEN 'L3' THEN {wide('a')} WHEN 'L3D' THEN {wide('b', 'a')} WHEN 'L4' THEN {wide('c', 'b', 'a')} ELSE 'all' END AS context
            FROM {{ladder_states}} u CROSS JOIN {levels} LEFT JOIN {{context_totals}} a ON a.voice = u.voice AND a.context = u.by_register LEFT JOIN {{context_totals}} b ON b.voice = u.voice AND b.context = u.by_degree
            LEFT JOIN {{context_totals}} c ON c.voice = u.voice AND c.context = u.by_step
            UNION ALL SELECT piece, i, tonic, voice, m0, x, 'L1', 1, 'pitch' FROM {{ladder_states}}""",
        # one draw for each attack and replay; a voice without an attack keeps its pitch
        ladder_draws=f"""SELECT w.piece, w.i, w.tonic, w.voice, w.level, w.pitched, w.rep, w.m0, CASE WHEN w.pitched = 1 THEN c.d ELSE w.m0 + c.d END AS m FROM
            (SELECT w.*, r.rep, floor(@HASH32(concat_ws('|', 'ladder', w.level, w.pitched, w.piece, w.i, w.voice, r.rep)) * t.total / 4294967296.0) AS y FROM {{ladder_wanted}} w
             JOIN {{context_totals}} t ON t.voice = w.voice AND t.context = w.context CROSS JOIN {replays} WHERE w.x = 1) w
            JOIN {{context_ranges}} c ON c.voice = w.voice AND c.context = w.context AND w.y >= c.lo AND w.y < c.hi
            UNION ALL SELECT w.piece, w.i, w.tonic, w.voice, w.level, w.pitched, r.rep, w.m0, w.m0 FROM {{ladder_wanted}} w CROSS JOIN {replays} WHERE w.x = 0""",
        ladder_slices=f"SELECT level, pitched, rep, piece, i, tonic, {pivot} FROM {{ladder_draws}} GROUP BY level, pitched, rep, piece, i, tonic HAVING count(m) = 4",
        ladder_real=f"SELECT 'real' AS level, -1 AS rep, field, cell, count(*) AS n FROM (SELECT field, cell FROM ({cells('(SELECT * FROM {steps} WHERE ' + both + ') u', 'piece', ('1 = 1', '1 = 1'))}) c) s GROUP BY field, cell",
        ladder_cells=f"SELECT level, rep, field, cell, count(*) AS n FROM ({cells('{ladder_slices}', 'level, rep', ('pitched = 0', chr(40) + 'level <> ' + repr('L1') + ' OR pitched = 1)'))}) s GROUP BY level, rep, field, cell",
        ladder_zero=" UNION ALL ".join(f"SELECT 'L0' AS level, -1 AS rep, '{f}' AS field, cell, n FROM {{null_{f.lower()}}}" for f in "VHSU"),
        ladder_all="SELECT level, rep, field, cell, @DOUBLE(n) AS n FROM {ladder_real} UNION ALL SELECT level, rep, field, cell, @DOUBLE(n) FROM {ladder_cells} UNION ALL SELECT level, rep, field, cell, n FROM {ladder_zero}",
        # a target's share of its field, by replay, then over replays
        ladder_targets=f"SELECT target, level, avg(share) AS share, stddev_samp(share) AS sd, max(total) AS total, max(hits) AS hits FROM (SELECT target, level, rep, sum(n * hit) AS hits, sum(n) AS total, sum(n * hit) / sum(n) AS share FROM ({target}) t GROUP BY target, level, rep) s GROUP BY target, level",
        ladder="""SELECT t.target, t.level, r.hits AS n_real, t.share * r.total AS expected, CASE WHEN t.level = 'L0' THEN NULL ELSE t.sd * r.total END AS sd, (r.hits - (t.share * r.total + 0.5)) / sqrt(t.share * r.total + 1.0) AS z,
            ln((r.hits + 0.5) / (t.share * r.total + 0.5)) AS log_ratio FROM {ladder_targets} t JOIN (SELECT * FROM {ladder_targets} WHERE level = 'real') r ON r.target = t.target WHERE t.level <> 'real'""",
    )
    each = lambda form: ", ".join(form.format(v=v, x=v.lower(), m=f"m{v.lower()}") for v in C.VOICES)
    wide_of = lambda level: f"CASE {level} WHEN 'L3' THEN {{m}}_l3 WHEN 'L3D' THEN {{m}}_l3d WHEN 'L4' THEN {{m}}_l4 WHEN 'pitch' THEN 'pitch' ELSE 'all' END"
    draw = "floor(@HASH32(concat_ws('|', 'ladder', level, pitched, piece, i, '{v}', rep)) * {m}_total / 4294967296.0)"
    kinds = values([("V", *q) for q in C.PAIRS] + [("H", *q) for q in C.ADJACENT] + [("S", "S", "B", ""), ("U", "S", "B", "")], "k(field, va, vb, role)")
    celled = f"""CASE field WHEN 'V' THEN {C.v_cell('(a - a0)', '(b - b0)', '(a0 - b0)', '(a - b)', 'role')} WHEN 'H' THEN {C.h_cell('concat(va, vb)', '(a - b)')}
        WHEN 'S' THEN {C.s_cell(M, 'tonic')} ELSE {C.u_cell(M, 'tonic')} END"""
    # for Spark a slice is one row with its four voices' contexts; replays are drawn from arrays by context in a projection, and only counts are dealt out
    plan.add_forms(
        context_arrays="SELECT voice, context, @SORTED(d; d) AS val, @SORTED(hi; d) AS hi, max(hi) AS total FROM {context_ranges} GROUP BY voice, context",
        ladder_wide=f"""SELECT piece, i, tonic, {each("max(CASE WHEN voice = '{v}' THEN m0 END) AS {m}0, max(CASE WHEN voice = '{v}' THEN x END) AS x{x}")},
            {each("max(CASE WHEN voice = '{v}' THEN l3 END) AS {m}_l3, max(CASE WHEN voice = '{v}' THEN l3d END) AS {m}_l3d, max(CASE WHEN voice = '{v}' THEN l4 END) AS {m}_l4")} FROM
            (SELECT /*+ BROADCAST(a, b, c) */ u.piece, u.i, u.tonic, u.voice, u.m0, u.x, {wide('a')} AS l3, {wide('b', 'a')} AS l3d, {wide('c', 'b', 'a')} AS l4 FROM {{ladder_states}} u
             LEFT JOIN {{context_totals}} a ON a.voice = u.voice AND a.context = u.by_register LEFT JOIN {{context_totals}} b ON b.voice = u.voice AND b.context = u.by_degree
             LEFT JOIN {{context_totals}} c ON c.voice = u.voice AND c.context = u.by_step) w GROUP BY piece, i, tonic HAVING count(*) = 4""",
        # no filter here: it would go below the projections with the draws in it, and draw again
        ladder_drawn=f"""SELECT level, pitched, rep, piece, i, tonic, {each("{m}0")}, {each("CASE WHEN x{x} = 0 THEN {m}0 ELSE CASE WHEN pitched = 1 THEN 0 ELSE {m}0 END + {m}_pick END AS {m}")} FROM
            (SELECT *, {each("@PICK({m}_val; {m}_hi; {m}_y) AS {m}_pick")} FROM
             (SELECT *, {each("CASE WHEN x{x} = 1 THEN " + draw + " END AS {m}_y")} FROM
              (SELECT /*+ BROADCAST({', '.join(f'c{v.lower()}' for v in C.VOICES)}) */ w.*, {each("c{x}.val AS {m}_val, c{x}.hi AS {m}_hi, c{x}.total AS {m}_total")} FROM
               (SELECT l.level, l.pitched, w.piece, w.i, w.tonic, {each("w.{m}0, w.x{x}, " + wide_of("CASE l.pitched WHEN 1 THEN 'pitch' ELSE l.level END") + " AS {m}_context")}
                FROM {{ladder_wide}} w CROSS JOIN {values([(x, 0) for x in LEVELS] + [("L1", 1)], "l(level, pitched)")}) w
               {' '.join(f"LEFT JOIN {{context_arrays}} c{v.lower()} ON c{v.lower()}.voice = '{v}' AND c{v.lower()}.context = w.m{v.lower()}_context" for v in C.VOICES)}) c
              CROSS JOIN {replays}) d) e""",
        ladder_cells=f"""SELECT level, rep, field, cell, count(*) AS n FROM
            (SELECT level, rep, field, CASE WHEN CASE field WHEN 'V' THEN pitched = 0 ELSE level <> 'L1' OR pitched = 1 END AND {COMPLETE} THEN {celled} END AS cell FROM
             (SELECT d.*, k.field, k.va, k.vb, k.role, {pick('va')} AS a, {pick('vb')} AS b, {pick('va', '0')} AS a0, {pick('vb', '0')} AS b0 FROM {{ladder_drawn}} d CROSS JOIN {kinds}) p) c
            GROUP BY level, rep, field, cell HAVING count(cell) > 0""",
    )

LADDER_QUERIES = {
    "ladder_counts": "SELECT level, field, cell, cast(sum(n) AS bigint) AS n FROM {ladder_cells} GROUP BY level, field, cell",
    "null_ladder": "SELECT target, level, " + ", ".join(f"round({x}, 6) AS {x}" for x in ("n_real", "expected", "sd", "z", "log_ratio")) + " FROM {ladder}",
}
