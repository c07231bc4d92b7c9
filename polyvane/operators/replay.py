"""The replay null as drawn: K redraws of every real unit, by piece, so that counts stay additive over pieces.

The closed forms of ``nulls`` are the expectations of these draws. Draws are what half-sampling, empirical p-values and simulated corpora need.
A draw is a hash of (stream, seed, piece, unit, replay, voice), the same on every run, partitioning and engine; the catalogues are one row of
arrays, bounded by the vocabulary, in which a draw looks its value up. A unit's draws are columns of one projection: nothing is
pivoted, and the only shuffle is the grouped count.
"""

from __future__ import annotations

import re

from polyvane.functions import cells as C
from polyvane.operators.counts import NEXT, NOW
from polyvane.operators.infer import LEAST, SHARED, TESTABLE, add_residuals, bh, need
from polyvane.operators.polyphony import ADJACENT, COMPLETE, GRID, M, PAIRS, VOICES, pick, values
from polyvane.plans.dialect import Plan, arguments

K = 16
#: Parts of a catalogue's places in which a draw is looked up.
GUIDE = 4096


def uniform(stream: str, *keys: str) -> str:
    """In [0, 1)."""
    return f"(@HASH32(concat_ws('|', '{stream}', {', '.join(keys)})) / 4294967296.0)"


def add_draw_cats(plan: Plan) -> None:
    """One row: by voice the values, cumulated counts and totals of pitches (p) and steps (d), and of all voices' pitches together (bag)."""
    one = lambda name, source, v, where: f"(SELECT @SORTED({v}; {v}) AS {name}_val, @SORTED(hi; {v}) AS {name}_hi, max(hi) AS {name}_n FROM {source} c {where})"
    # an empty catalogue gives null draws and so no cells
    parts = [one(f"{k}{v.lower()}", "{" + table + "}", col, f"WHERE voice = '{v}'") for k, table, col in (("p", "pitch_ranges", "m"), ("d", "dp_ranges", "d")) for v in C.VOICES]
    parts.append(one("bag", "(SELECT m, sum(n) OVER (ORDER BY m) AS hi FROM (SELECT m, sum(n) AS n FROM {pitch_cat} GROUP BY m) b)", "m", ""))
    plan.add(
        pitch_ranges="SELECT voice, m, n, total, sum(n) OVER (PARTITION BY voice ORDER BY m) AS hi, sum(n) OVER (PARTITION BY voice ORDER BY m) - n AS lo FROM {pitch_cat}",
        dp_ranges="SELECT voice, d, n, sum(n) OVER (PARTITION BY voice ORDER BY d) AS hi FROM {dp_cat}",
        draw_cats="SELECT * FROM " + " CROSS JOIN ".join(f"{x} t{k}" for k, x in enumerate(parts)),
    )
    # where all places of a part have one value, that value; else null
    names = [f"{k}{v.lower()}" for k in "pd" for v in C.VOICES] + ["bag"]
    first = lambda name, s: f"(({s}) * {name}_n + {GUIDE - 1}) div {GUIDE}"
    ends = lambda name, x: f"@PICK({name}_val; {name}_hi; {x})"
    guide = lambda name: f"transform(sequence(0L, {GUIDE - 1}L), s -> CASE WHEN {first(name, 's')} >= {first(name, 's + 1')} THEN NULL WHEN {ends(name, first(name, 's'))} = {ends(name, first(name, 's + 1') + ' - 1')} THEN {ends(name, first(name, 's'))} END)"
    plan.add_forms(draw_guides=f"SELECT struct(*) AS c FROM (SELECT *, {', '.join(f'{guide(x)} AS {x}_guide' for x in names)} FROM {{draw_cats}}) g")


def looked_up(sql: str) -> str:
    """For Spark: a draw's value is read where its part of the catalogue's places has one value, and only other draws are sorted in. Catalogues are constants: no row carries them.
    What the draws of a row are hashed by is put in words once."""
    sql = sql.replace(" CROSS JOIN {draw_cats} c", "").replace("SELECT s.*, c.*, ", "SELECT s.*, ")
    at = sql.find("@PICK(")
    while at >= 0:
        (values_, hi, x), end = arguments(sql, at + 5)
        read = f"get({values_.replace('_val', '_guide')}, cast(shiftleft({x}, {GUIDE.bit_length() - 1}) div {hi.replace('_hi', '_n')} AS int))"
        call = f"coalesce({read}, {sql[at:end]})"
        sql = sql[:at] + call + sql[end:]
        at = sql.find("@PICK(", at + len(call))
    sql = re.sub(r"concat_ws\('\|', '([\w.]+)', ([\w.]+(?:, [\w.]+)*)((?:, '\w+')*)\)", lambda m: f"concat('{m[1]}|', concat_ws('|', {m[2]})" + "".join(f", {x[:1]}|{x[1:]}" for x in re.findall(r"'\w+'", m[3])) + ")", sql)
    return re.sub(r"\b((?:[pd][satb]|bag)_(?:val|hi|n|guide))\b", r"(SELECT c FROM {draw_guides}).\1", sql)


def taken(name: str, stream: str, *keys: str) -> str:
    return f"@PICK({name}_val; {name}_hi; floor({uniform(stream, *keys)} * {name}_n))"


def add_replay(plan: Plan, name: str = "replay", p: str = "", k: int = K, seed: int = 0, by: str = "piece") -> None:
    """{p}{name}_{field}: (piece, cell, n) of k replays of every unit, for all fields, and {p}{name}_cells: the fields together.

    by 'rep': (rep, cell, n), each replay of the whole corpus by itself, as a corpus simulated under the null.
    """
    r = lambda x: f"{{{p}{x}}}"
    reps = values([(j,) for j in range(k)], "h(rep)")
    own = lambda f, *keys: uniform(f"{f}.{seed}", *keys)
    four = lambda f, kind, *keys: [taken(f"{kind}{v.lower()}", f"{f}.{seed}", *keys, f"'{v}'") for v in C.VOICES]
    both = " AND ".join(f"{m} IS NOT NULL AND {m}0 IS NOT NULL" for m in M)
    coarse = lambda a: f"substr({a}, 1, instr({a}, '|') - 1)"
    before = ", ".join(f"{m}0" for m in M)

    def stepped(f: str) -> str:
        moved = ", ".join(f"{m}0 + {d} AS {m}" for m, d in zip(M, four(f, "d", "piece", "i", "rep"), strict=True))
        return f"""(SELECT piece, rep, role, va, vb, {pick('va')} AS a, {pick('vb')} AS b, {pick('va', '0')} AS a0, {pick('vb', '0')} AS b0 FROM
            (SELECT piece, rep, {before}, {moved} FROM {r('steps')} CROSS JOIN {reps} CROSS JOIN {{draw_cats}} c WHERE {both}) s CROSS JOIN {PAIRS}) q"""

    def sonorities(f: str, units: str) -> str:
        drawn = ", ".join(f"{x} AS {m}" for m, x in zip(M, four(f, "p", "piece", "i", "rep"), strict=True))
        return f"(SELECT piece, rep, tonic, {drawn} FROM ({units}) u CROSS JOIN {reps} CROSS JOIN {{draw_cats}} c) q"

    def again(f: str, units: str, keys: tuple[str, ...], m0: str) -> str:
        """Units with a redrawn pitch x of the voice, any but the one in column m0 unless there is no other: its place in the catalogue is skipped."""
        array = lambda part: C.by_voice("voice", f"p%s_{part}")
        free = f"floor({own(f, *keys)} * ({array('n')} - out))"
        return f"""(SELECT t.*, @PICK({array('val')}; {array('hi')}; y + CASE WHEN y >= lo THEN out ELSE 0 END) AS x FROM
            (SELECT s.*, c.*, {free} AS y FROM (SELECT u.*, h.rep, CASE WHEN z.n IS NULL OR z.n = z.total THEN 0 ELSE z.n END AS out, coalesce(z.lo, 0) AS lo
              FROM ({units}) u LEFT JOIN {{pitch_ranges}} z ON z.voice = u.voice AND z.m = u.{m0} CROSS JOIN {reps}) s CROSS JOIN {{draw_cats}} c) t) q"""

    complete = f"SELECT piece, i, tonic, {', '.join(M)} FROM {r('slices')} WHERE {COMPLETE}"
    # pieces without a unit count as one
    least = lambda rows: f"SELECT t.piece, t.tonic, coalesce(b.i, -1) AS i FROM {{tonic}} t LEFT JOIN ({rows}) b ON b.piece = t.piece"
    changes = f"SELECT piece, i, voice, m0, {C.one('d0 = 11')} AS lt, {C.one('d0 = 10')} AS b7 FROM {r('changes')}"
    outer = "CASE WHEN voice IN ('S', 'B') THEN 1 ELSE 0 END"
    kept = ", ".join(f"c.{x}" for x in NOW + NEXT)
    windows = lambda source, more, where: f"SELECT c.piece, c.i, c.voice, c.before, c.after, {kept}, {more}, {C.one('e.stays >= 4')} AS ped FROM {r(source)} c JOIN {r('pedals')} e ON e.piece = c.piece AND e.voice = c.voice {where}"
    three = windows("changed", "c.held, c.hold_others", "WHERE c.before IS NOT NULL AND c.after IS NOT NULL")
    by_voice = f"@PICK({C.by_voice('voice', 'p%s_val')}; {C.by_voice('voice', 'p%s_hi')}; floor({own('Dh', 'piece', 'i', 'voice', 'rep')} * {C.by_voice('voice', 'p%s_n')}))"
    over = f"(SELECT o.*, h.rep, {by_voice} AS x FROM ({windows('overheld', '1 AS held', '')}) o CROSS JOIN {reps} CROSS JOIN {{draw_cats}} c) q"
    grid = f"{values([(j,) for j in range(64)], 'g(g)')} CROSS JOIN {values([(j,) for j in range(64)], 'j(j)')}"
    sides = {f"{m}{s}": x for s in (0, 1) for m, x in zip(M, four("K", "p", "piece", "u", "rep", str(s)), strict=True)}
    slot = lambda f, fin, *keys: f"CASE WHEN {own(f, *keys)} < {fin} THEN 'fin' ELSE 'int' END"
    to = lambda a, b: f"concat({a}, '/to/', {b}, '|slot=', slot)"
    fine_and_coarse = lambda source: f"SELECT piece, rep, {to('k0', 'k')} AS cell FROM {source} UNION ALL SELECT piece, rep, {to(coarse('k0'), coarse('k'))} FROM {source}"
    step_of = lambda v, s: f"@PICK({C.by_voice(v, 'd%s_val')}; {C.by_voice(v, 'd%s_hi')}; floor({own('W' + s, 'piece', 'w')} * {C.by_voice(v, 'd%s_n')}))"
    pair_at = lambda col: "CASE pair " + " ".join(f"WHEN {n} THEN '{q[col]}'" for n, q in enumerate(C.PAIRS)) + " END"
    drawn = {
        "v": f"SELECT piece, rep, {C.v_cell('(a - a0)', '(b - b0)', '(a0 - b0)', '(a - b)', 'role')} AS cell FROM {stepped('V')}",
        "o": f"SELECT piece, rep, {C.o_cell('concat(va, vb)', 'a0', 'b0', 'a', 'b')} AS cell FROM {stepped('O')} WHERE role = 'adjacent'",
        "h": f"SELECT piece, rep, {C.h_cell('concat(va, vb)', '(' + pick('va') + ' - ' + pick('vb') + ')')} AS cell FROM {sonorities('H', complete)} CROSS JOIN {ADJACENT}",
        "s": f"SELECT piece, rep, {C.s_cell(M, 'tonic')} AS cell FROM {sonorities('S', least(complete))}",
        "u": f"SELECT piece, rep, {C.u_cell(M, 'tonic')} AS cell FROM {sonorities('U', least('SELECT piece, i FROM ' + r('beats')))}",
        "m": f"SELECT piece, rep, concat('out=', {outer}, '|lt=', lt, '|b7=', b7, '|mv=', {C.move('(x - m0)')}) AS cell FROM {again('M', changes, ('piece', 'i', 'voice', 'rep'), 'm0')}",
        "g": f"SELECT piece, rep, {C.g_cell('(x - m0)')} AS cell FROM {again('G', changes, ('piece', 'i', 'voice', 'rep'), 'm0')}",
        "d": f"""SELECT piece, rep, {C.d_cell('before', 'x', 'after', NOW, NEXT, 'held = 1', 'hold_others = 1', 'ped = 1', 0)} AS cell FROM {again('D', three, ('piece', 'i', 'voice', 'rep'), 'before')}
            UNION ALL SELECT piece, rep, {C.d_cell('before', 'x', 'after', NOW, NEXT, '1 = 1', '1 = 0', 'ped = 1', 1)} FROM {over}""",
        "p": f"""SELECT d.piece, d.rep, s.cell FROM (SELECT piece, rep, floor({own('P', 'piece', 'rep', 'side')} * n) AS at FROM (SELECT piece, count(*) AS n FROM ({complete}) c GROUP BY piece) u
            CROSS JOIN {reps} CROSS JOIN {values([(0,), (1,)], 's(side)')}) d JOIN
            (SELECT piece, {C.p_cell('db', 'ds')} AS cell, row_number() OVER (PARTITION BY piece ORDER BY i) - 1 AS at FROM {r('slices')} WHERE {COMPLETE}) s ON s.piece = d.piece AND s.at = d.at""",
        "q": f"""SELECT d.piece, d.rep, concat(m.p0, '/to/', m.p, '|slot=', d.slot) AS cell FROM (SELECT u.piece, h.rep, floor({own('Q', 'u.piece', 'rep')} * n) AS at, {slot('Qslot', 'f.fin', 'u.piece', 'rep')} AS slot
             FROM (SELECT piece, count(*) AS n FROM {r('uniq_p')} WHERE p0 IS NOT NULL GROUP BY piece) u JOIN {r('q_rate')} f ON f.piece = u.piece CROSS JOIN {reps}) d
            JOIN (SELECT piece, p0, p, row_number() OVER (PARTITION BY piece ORDER BY i) - 1 AS at FROM {r('uniq_p')} WHERE p0 IS NOT NULL) m ON m.piece = d.piece AND m.at = d.at""",
        "k": fine_and_coarse(f"(SELECT piece, rep, {C.k_token([m + '0' for m in M], 'tonic')} AS k0, {C.k_token([m + '1' for m in M], 'tonic')} AS k, slot FROM (SELECT piece, rep, tonic, {', '.join(f'{x} AS {m}' for m, x in sides.items())}, {slot('Kslot', 'fin', 'piece', 'u', 'rep')} AS slot FROM (SELECT q.*, g.g * 64 + j.j AS u, h.rep FROM {r('k_units')} q CROSS JOIN {grid} CROSS JOIN {reps} WHERE g.g * 64 + j.j < q.units) w CROSS JOIN {{draw_cats}} c) s) q"),
        "j": fine_and_coarse(f"(SELECT m.piece, h.rep, m.k0, m.k, {slot('J', 'f.fin', 'm.piece', 'm.i', 'rep')} AS slot FROM {r('moves')} m JOIN {r('k_rate')} f ON f.piece = m.piece CROSS JOIN {reps}) q"),
        "f": f"""SELECT piece, rep, concat('kind=L|bars=', cast(1 + 2 * floor({own('Fl', 'piece', 'ph', 'rep')} * 3) AS int)) AS cell FROM {r('phrases')} CROSS JOIN {reps} WHERE piece IN (SELECT piece FROM {r('beats')})
            UNION ALL SELECT d.piece, d.rep, concat('kind=S|slot=', d.slot, '|b=', s.b) FROM
             (SELECT f.piece, h.rep, f.slot, floor({own('Fs', 'f.piece', 'f.ph', 'rep')} * t.total) AS at FROM (SELECT piece, ph, CASE WHEN fin = 1 THEN 'fin' ELSE 'int' END AS slot FROM {r('phrases')}) f
              JOIN (SELECT piece, slot, max(hi) AS total FROM {r('f_pool')} GROUP BY piece, slot) t ON t.piece = f.piece AND t.slot = f.slot CROSS JOIN {reps}) d
             JOIN {r('f_pool')} s ON s.piece = d.piece AND s.slot = d.slot AND d.at >= s.lo AND d.at < s.hi""",
    }
    if not p:  # over notes and pair steps, which no change of the slices touches
        drawn |= {
            "r": f"""SELECT piece, rep, concat('v=', voice, '|oct=', cast(floor((@PICK(bag_val; bag_hi; floor({own('R', 'piece', 'voice', 'u', 'rep')} * bag_n)) + 12 * (floor({own('Rup', 'piece', 'voice', 'u', 'rep')} * 3) - 1)) / 12.0) AS int)) AS cell
                FROM (SELECT q.piece, v.voice, g.g * 64 + j.j AS u, h.rep FROM (SELECT piece, greatest(cast(floor(count(*) / 4.0) AS int), 1) AS n FROM {{notes}} GROUP BY piece) q CROSS JOIN {VOICES} CROSS JOIN {grid} CROSS JOIN {reps} WHERE g.g * 64 + j.j < q.n) u CROSS JOIN {{draw_cats}} c""",
            # a voice pair at random; the lower voice's step takes the upper one's sign, or both rest, or it is free
            "w": f"""SELECT piece, rep, concat('mot=', {C.motion('da', 'db')}) AS cell FROM (SELECT piece, cast(w % {k} AS int) AS rep, CASE WHEN branch >= 0.55 AND branch < 0.75 THEN 0 ELSE x END AS da,
                CASE WHEN branch >= 0.75 THEN y WHEN branch >= 0.55 OR x = 0 THEN 0 WHEN x > 0 THEN greatest(abs(y), 1) ELSE -greatest(abs(y), 1) END AS db FROM
                (SELECT piece, w, branch, {step_of('va', 'a')} AS x, {step_of('vb', 'b')} AS y FROM (SELECT piece, w, branch, {pair_at(0)} AS va, {pair_at(1)} AS vb FROM
                 (SELECT q.piece, g.g * 64 + j.j AS w, floor({own('Wp', 'q.piece', 'g.g * 64 + j.j')} * 6) AS pair, {own('Wm', 'q.piece', 'g.g * 64 + j.j')} AS branch FROM
                  (SELECT t.piece, greatest(floor((CASE WHEN count(s.i) = 0 THEN 1 ELSE count(s.i) END) * {k} / 4.0), {k}) AS n FROM {{tonic}} t LEFT JOIN {{pair_steps}} s ON s.piece = t.piece GROUP BY t.piece) q CROSS JOIN {grid} WHERE g.g * 64 + j.j < q.n) a) b CROSS JOIN {{draw_cats}} c) d) e""",
        }
    plan.add(**{
        f"{p}f_pool": f"""SELECT piece, slot, b, sum(n) OVER (PARTITION BY piece, slot ORDER BY b) - n AS lo, sum(n) OVER (PARTITION BY piece, slot ORDER BY b) AS hi FROM
            (SELECT piece, slot, b, n, max({C.one('b <> stop')}) OVER (PARTITION BY piece, slot) AS others, stop FROM
             (SELECT piece, {C.bucket('db')} AS b, count(*) AS n FROM {r('beats')} GROUP BY piece, {C.bucket('db')}) h CROSS JOIN {values([('fin', '0'), ('int', '7')], 'f(slot, stop)')}) g WHERE others = 0 OR b <> stop""",
        **{f"{p}{name}_{f}": f"SELECT {by}, cell, count(*) AS n FROM ({select}) s WHERE cell IS NOT NULL GROUP BY {by}, cell" for f, select in drawn.items()},
        f"{p}{name}_cells": " UNION ALL ".join(f"SELECT '{f}' AS field, {by}, cell, n FROM {{{p if f not in SHARED else ''}{name}_{f.lower()}}}" for f in C.FIELDS),
    })
    # Spark deals out the units of a piece, few rows, before they are drawn: merged to one task, that task would draw them all
    dealt = {}
    if not p:
        dealt = {f"{name}_{f}": (lead, lead.replace("SELECT", f"SELECT /*+ REPARTITION({Plan.TASKS}, piece) */")) for f, lead in (("r", "(SELECT piece, greatest(cast("), ("w", "(SELECT t.piece, greatest(floor("))}
    # and a sequence of draws is made once, for its fine and its coarse cell
    sequences = drawn["k"][drawn["k"].index("FROM (SELECT"):drawn["k"].index(" UNION ALL ")].replace(f"FROM {r('k_units')} q", f"FROM (SELECT /*+ REPARTITION({Plan.TASKS}, piece) */ * FROM {r('k_units')}) q")
    whole = f"SELECT {by}, cell, count(*) AS n FROM (SELECT piece, rep, CASE fine WHEN 1 THEN {to('k0', 'k')} ELSE {to(coarse('k0'), coarse('k'))} END AS cell {sequences} CROSS JOIN {values([(1,), (0,)], 'f(fine)')}) s WHERE cell IS NOT NULL GROUP BY {by}, cell"
    plan.add_forms(**{f"{p}{name}_{f}": looked_up(select) for f in drawn if "@PICK(" in (select := plan.nodes[f"{p}{name}_{f}"])})
    plan.add_forms(**{x: looked_up(plan.nodes[x].replace(*swap)) for x, swap in dealt.items()}, **{f"{p}{name}_k": looked_up(whole)})
    if by == "piece":
        plan.add(**{f"{p}{name}_joined": f"""SELECT coalesce(a.field, b.field) AS field, coalesce(a.cell, b.cell) AS cell, coalesce(a.n, 0) AS nr, b.n AS null_n FROM {r('cells_real')} a
            FULL OUTER JOIN (SELECT field, cell, @DOUBLE(sum(n)) AS n FROM {{{p}{name}_cells}} GROUP BY field, cell) b ON b.field = a.field AND b.cell = a.cell"""})
        add_residuals(plan, f"{p}{name}_residuals", f"{p}{name}_joined")


def add_simulations(plan: Plan, n_sim: int = 30) -> None:
    """Corpora simulated under the null, one replay each of another stream of draws, and what z their cells get; empirical p-values from them.

    ``sim_z`` holds every tested cell of every simulation; its windows are by field, over simulations times vocabulary.
    """
    add_replay(plan, "sim", k=n_sim, seed=1, by="rep")
    sims = values([(j,) for j in range(n_sim)], "s(rep)")
    approx = lambda sign: f"greatest({C.normal_cdf(sign + 'z')}, 0.000000000000001)"
    nd = need("2.5")
    kept = lambda p, sign: bh(f"SELECT field, cell, {p} AS p FROM {{empirical}} WHERE {sign}z >= {nd} * 0.5", "field, cell", "0.08")
    plan.add(
        null_totals="SELECT field, cell, n0, n0_total FROM {replay_residuals} WHERE n0 > 0",
        sim_counts=f"""SELECT field, rep, cell, n, sum(n) OVER (PARTITION BY field, rep) AS total FROM {{sim_cells}}""",
        sim_joined=f"""SELECT coalesce(a.field, b.field) AS field, coalesce(a.rep, b.rep) AS rep, coalesce(a.cell, b.cell) AS cell, coalesce(a.n, 0) AS nr, coalesce(b.n0, 0) AS n0 FROM {{sim_counts}} a
            FULL OUTER JOIN (SELECT t.field, s.rep, t.cell, t.n0 FROM {{null_totals}} t CROSS JOIN {sims}) b ON b.field = a.field AND b.rep = a.rep AND b.cell = a.cell""",
        sim_z=f"""SELECT j.field, j.rep, j.cell, round({C.cell_z('@DOUBLE(j.nr)', 'j.n0', '@DOUBLE(r.total)', 'f.n0_total')}, 9) AS z FROM {{sim_joined}} j
            JOIN (SELECT field, rep, max(total) AS total FROM {{sim_counts}} GROUP BY field, rep) r ON r.field = j.field AND r.rep = j.rep
            JOIN (SELECT field, max(n0_total) AS n0_total FROM {{null_totals}} GROUP BY field) f ON f.field = j.field WHERE {TESTABLE.replace('field', 'j.field').replace('n0 >=', 'j.n0 >=').replace('nr >=', 'j.nr >=')}""",
        # a cell's place among the simulated scores of its field: below or equal, and equal or above
        empirical=f"""SELECT q.*, (1 + below) / (1 + m) AS p_low, (1 + m - under) / (1 + m) AS p_high FROM
            (SELECT field, cell, z, keys, sim, @DOUBLE(sum(sim) OVER (PARTITION BY field)) AS m, @DOUBLE(sum(sim) OVER (PARTITION BY field ORDER BY z RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS below,
              @DOUBLE(sum(sim) OVER (PARTITION BY field ORDER BY z RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(sim) OVER (PARTITION BY field, z)) AS under FROM
             (SELECT field, cell, round(z, 9) AS z, keys, 0 AS sim FROM {{replay_residuals}} WHERE {TESTABLE} UNION ALL SELECT field, cell, z, 0, 1 FROM {{sim_z}}) u) q WHERE sim = 0""",
        bh_parts=" UNION ALL ".join(f"SELECT '{polarity}' AS polarity, '{kind}' AS kind, field, cell FROM ({kept(p, sign)}) k" for polarity, sign, col in (("under", "-", "p_low"), ("over", "", "p_high"))
                                    for kind, p in (("approx", approx("" if polarity == "under" else "-")), ("empirical", col))),
        empirical_bh="""SELECT polarity, sum(approx) AS approx, sum(empirical) AS empirical, sum(approx * empirical) AS both_kinds, @DOUBLE(sum(approx * empirical)) / count(*) AS jaccard FROM
            (SELECT polarity, field, cell, max(CASE kind WHEN 'approx' THEN 1 ELSE 0 END) AS approx, max(CASE kind WHEN 'empirical' THEN 1 ELSE 0 END) AS empirical FROM {bh_parts} WHERE field NOT IN ('R', 'W', 'F') GROUP BY polarity, field, cell) s GROUP BY polarity""",
        # how many null cells the nominal tails would call significant
        nominal_tails=f"""SELECT a.tail, avg(CASE WHEN {C.normal_cdf('z')} <= a.tail THEN @DOUBLE(1) ELSE 0 END) AS low, avg(CASE WHEN {C.normal_cdf('-z')} <= a.tail THEN @DOUBLE(1) ELSE 0 END) AS high, count(*) AS n FROM {{sim_z}} CROSS JOIN {values([(0.001,), (0.01,), (0.05,)], 'a(tail)')} GROUP BY a.tail""",
    )
    least = LEAST.replace("field", "n.field")
    # values of z in some thousand buckets: of each value, how many simulated scores are below it or equal
    bucket = "cast(sign(z) * floor(ln(1 + abs(z)) * 200) AS int)"
    dist = f"SELECT field, z, {bucket} AS bucket, sum(sim) AS n FROM (SELECT field, round(z, 9) AS z, 0 AS sim FROM {{replay_residuals}} WHERE {TESTABLE} UNION ALL SELECT field, z, 1 FROM {{sim_z}}) u GROUP BY field, z"
    before = f"SELECT field, bucket, sum(sum(n)) OVER (PARTITION BY field ORDER BY bucket) - sum(n) AS before, sum(sum(n)) OVER (PARTITION BY field) AS m FROM ({dist}) d0 GROUP BY field, bucket"
    placed = f"SELECT /*+ BROADCAST(b) */ d.field, d.z, d.n, b.m, b.before + sum(d.n) OVER (PARTITION BY d.field, d.bucket ORDER BY d.z) AS below FROM ({dist}) d JOIN ({before}) b ON b.field = d.field AND b.bucket = d.bucket"
    plan.add_forms(
        # sums by field and replay are joined, and only what is tested meets all simulations: cells that are common in the null, or in a simulation
        sim_z=f"""SELECT /*+ BROADCAST(r, f) */ j.field, j.rep, j.cell, round({C.cell_z('@DOUBLE(j.nr)', 'j.n0', '@DOUBLE(r.total)', 'f.n0_total')}, 9) AS z FROM
            (SELECT n.field, n.rep, n.cell, coalesce(a.n, 0) AS nr, n.n0 FROM (SELECT n.field, s.rep, n.cell, n.n0 FROM (SELECT * FROM {{null_totals}} n WHERE n.n0 >= {least}) n CROSS JOIN {sims}) n
              LEFT JOIN {{sim_cells}} a ON a.field = n.field AND a.rep = n.rep AND a.cell = n.cell
             UNION ALL SELECT n.field, n.rep, n.cell, n.n, coalesce(t.n0, 0) FROM (SELECT * FROM {{sim_cells}} n WHERE n.n >= {least}) n LEFT JOIN {{null_totals}} t ON t.field = n.field AND t.cell = n.cell WHERE coalesce(t.n0, 0) < {least}) j
            JOIN (SELECT field, rep, sum(n) AS total FROM {{sim_cells}} GROUP BY field, rep) r ON r.field = j.field AND r.rep = j.rep
            JOIN (SELECT field, max(n0_total) AS n0_total FROM {{null_totals}} GROUP BY field) f ON f.field = j.field""",
        empirical=f"""SELECT q.*, (1 + below) / (1 + m) AS p_low, (1 + m - under) / (1 + m) AS p_high FROM
            (SELECT c.field, c.cell, c.z, c.keys, 0 AS sim, @DOUBLE(p.m) AS m, @DOUBLE(p.below) AS below, @DOUBLE(p.below - p.n) AS under FROM
             (SELECT field, cell, round(z, 9) AS z, keys FROM {{replay_residuals}} WHERE {TESTABLE}) c JOIN ({placed}) p ON p.field = c.field AND p.z = c.z) q""",
    )


def add_null_draws(plan: Plan, p: str = "") -> None:
    """For Spark the closed forms' sampled field K is drawn in a projection: no draw is joined with the catalogue or dealt out to be pivoted."""
    hashes = ", ".join(f"@HASH32(concat_ws('|', 'K', piece, u, rep, {s}, '{v}')) AS h{v.lower()}{s}" for s in (0, 1) for v in C.VOICES)
    # where a 1,024th of the hashes has one pitch it is looked up; others are sorted in. The arrays are constants: no row carries them
    of = lambda v, name: f"(SELECT p{v}_{name} FROM {{null_guides}})"
    at = lambda v, h: f"floor({h} * {of(v, 'n')} / 4294967296.0)"
    sides = ", ".join(f"coalesce(element_at({of(v, 'guide')}, cast(shiftright(h{v}{s}, 22) AS int) + 1), @PICK({of(v, 'val')}; {of(v, 'hi')}; {at(v, f'h{v}{s}')})) AS m{v}{s}" for s in (0, 1) for v in map(str.lower, C.VOICES))
    ends = lambda v, h: f"@PICK(p{v}_val; p{v}_hi; floor({h} * p{v}_n / 4294967296.0))"
    guides = ", ".join(f"transform(sequence(0L, 1023L), s -> CASE WHEN {ends(v, '(s * 4194304)')} = {ends(v, '(s * 4194304 + 4194303)')} THEN {ends(v, '(s * 4194304)')} END) AS p{v}_guide" for v in map(str.lower, C.VOICES))
    coarse = lambda a: f"substr({a}, 1, instr({a}, '|') - 1)"
    plan.add_forms(**{
        "null_guides": f"SELECT *, {guides} FROM {{draw_cats}}",
        f"{p}k_sampled": f"""SELECT {C.k_token([m + '0' for m in M], 'tonic')} AS k0, {C.k_token([m + '1' for m in M], 'tonic')} AS k, CASE WHEN @HASH32(concat_ws('|', 'Kslot', piece, u, rep)) / 4294967296.0 < fin THEN 'fin' ELSE 'int' END AS slot FROM
            (SELECT piece, u, rep, tonic, fin, {sides} FROM (SELECT piece, u, rep, tonic, fin, {hashes} FROM (SELECT q.piece, q.tonic, q.fin, g.i AS u, h.rep FROM (SELECT /*+ REPARTITION({Plan.TASKS}, piece) */ * FROM {{{p}k_units}}) q JOIN {GRID} ON g.i < q.units CROSS JOIN {values([(j,) for j in range(K)], 'h(rep)')}) w) v) d""",
        f"{p}null_k": f"""SELECT cell, @DOUBLE(count(*)) AS n FROM (SELECT CASE fine WHEN 1 THEN concat(k0, '/to/', k, '|slot=', slot) ELSE concat({coarse('k0')}, '/to/', {coarse('k')}, '|slot=', slot) END AS cell
            FROM {{{p}k_sampled}} s CROSS JOIN {values([(1,), (0,)], 'f(fine)')}) t GROUP BY cell""",
    })


def add_piece_counts(plan: Plan, p: str = "") -> None:
    """{p}piece_counts: (piece, field, cell, nr, n0), real and drawn counts, additive over pieces."""
    own = lambda f: p if f not in SHARED else ""
    units = " UNION ALL ".join(f"SELECT '{f}' AS field, piece, cell, 1 AS nr, 0 AS n0 FROM {{{own(f)}units_{f.lower()}}}" for f in C.FIELDS)
    plan.add(**{f"{p}piece_counts": f"SELECT piece, field, cell, cast(sum(nr) AS bigint) AS nr, cast(sum(n0) AS bigint) AS n0 FROM ({units} UNION ALL SELECT field, piece, cell, 0, n FROM {{{p}replay_cells}}) u GROUP BY piece, field, cell"})
    if not p:  # of the sequence field alone
        plan.add(k_piece_counts="SELECT piece, 'K' AS field, cell, cast(sum(nr) AS bigint) AS nr, cast(sum(n0) AS bigint) AS n0 FROM (SELECT piece, cell, 1 AS nr, 0 AS n0 FROM {units_k} UNION ALL SELECT piece, cell, 0, n FROM {replay_k}) u GROUP BY piece, cell")
