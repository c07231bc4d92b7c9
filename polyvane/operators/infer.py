"""Residuals, z scores and the discovery set.

A field's real and null counts meet in a full outer join on the cell; smoothed log ratios and z scores follow from window totals by field. The
vocabulary of some fields grows with the data, so control over all cells (Benjamini-Hochberg, Holm) counts distinct values in buckets and never
ranks cells in one window.
"""

from __future__ import annotations

from polyvane.functions import cells as C
from polyvane.operators.polyphony import values
from polyvane.plans.dialect import Plan

SHARED = ("R", "W")  # fields over notes and pair steps, which desynchronisation doesn't touch
COUPLED = ("V", "H", "O", "M", "G", "S")
#: Fixed value: -ln 0.05.
EMPTY_LAMBDA = 2.995732273553991
SPARSE = ", ".join(f"'{f}'" for f in C.SPARSE)
LEAST = f"CASE WHEN field IN ({SPARSE}) THEN 3 ELSE 12 END"
TESTABLE = f"(n0 >= {LEAST} OR nr >= {LEAST})"


def add_cells(plan: Plan, p: str = "", fields: tuple[str, ...] = C.FIELDS) -> None:
    """Real cells of all fields in one grouped count, null cells, both joined, residuals. Desynchronised corpora share the fields of SHARED."""
    own = lambda f: p if p.startswith("x") and f not in SHARED else ""
    units = " UNION ALL ".join(f"SELECT '{f}' AS field, cell FROM {{{own(f)}units_{f.lower()}}}" for f in fields)
    plan.add(**{f"{p}cells_real": f"SELECT field, cell, @DOUBLE(count(*)) AS n FROM ({units}) u GROUP BY field, cell",
                f"{p}cells_null": " UNION ALL ".join(f"SELECT '{f}' AS field, cell, @DOUBLE(n) AS n FROM {{{own(f)}null_{f.lower()}}}" for f in fields)})
    plan.add(**{f"{p}joined": f"SELECT coalesce(r.field, n.field) AS field, coalesce(r.cell, n.cell) AS cell, coalesce(r.n, 0) AS nr, n.n AS null_n FROM {{{p}cells_real}} r FULL OUTER JOIN {{{p}cells_null}} n ON n.field = r.field AND n.cell = r.cell"})
    add_residuals(plan, f"{p}residuals", f"{p}joined")


def add_residuals(plan: Plan, name: str, joined: str) -> None:
    """rho with an empirical-Bayes pseudo-count (moments of the field's null counts), z with a constant 0.5."""
    scored = f"""SELECT field, cell, nr, n0, keys, nr_total, n0_total, alpha, ln((nr + alpha) / (nr_total + alpha * keys)) - ln((n0 + alpha) / (n0_total + alpha * keys)) AS rho,
        {C.cell_z('nr', 'n0', 'nr_total', 'n0_total')} AS z FROM (SELECT *, CASE WHEN nulls < 4 OR var <= mu + 0.000001 THEN 0.5 ELSE least(2.5, greatest(0.15, mu * mu / (var - mu))) END AS alpha FROM
        (SELECT field, cell, nr, coalesce(null_n, 0) AS n0, count(*) OVER f AS keys, count(null_n) OVER f AS nulls, avg(null_n) OVER f AS mu, var_pop(null_n) OVER f AS var,
          CASE WHEN sum(nr) OVER f = 0 THEN 1 ELSE sum(nr) OVER f END AS nr_total, CASE WHEN coalesce(sum(null_n) OVER f, 0) = 0 THEN 1 ELSE sum(null_n) OVER f END AS n0_total
         FROM {{{joined}}} WINDOW f AS (PARTITION BY field)) a) b"""
    # a window would hold a field's whole vocabulary in one task: Spark sums by field and hands the sums, a row a field, to all tasks
    windowed = scored[scored.index("(SELECT field, cell, nr, coalesce"):scored.rindex(" a) b")]
    summed = f"""(SELECT /*+ BROADCAST(f) */ j.field, j.cell, j.nr, coalesce(j.null_n, 0) AS n0, f.keys, f.nulls, f.mu, f.var, f.nr_total, f.n0_total FROM {{{joined}}} j JOIN
        (SELECT field, count(*) AS keys, count(null_n) AS nulls, avg(null_n) AS mu, var_pop(null_n) AS var, CASE WHEN sum(nr) = 0 THEN 1 ELSE sum(nr) END AS nr_total,
          CASE WHEN coalesce(sum(null_n), 0) = 0 THEN 1 ELSE sum(null_n) END AS n0_total FROM {{{joined}}} GROUP BY field) f ON f.field = j.field)"""
    plan.add(**{name: scored}).add_forms(**{name: scored.replace(windowed, summed)})


def need(z_cut: str) -> str:
    return f"({z_cut} + greatest(0, log10(keys / 40.0)))"


def _counted(source: str, lead: str) -> tuple[str, str]:
    """Distinct p of source with their numbers, in buckets by size; of each bucket how many values are in smaller ones, and of all. Buckets are at most 1,843."""
    dist = f"SELECT {lead}p, floor(ln(greatest(p, 0.0000000000000001)) * 50) AS bucket, count(*) AS n FROM ({source}) t0 GROUP BY {lead}p"
    part = f"PARTITION BY {lead[:-2]} " if lead else ""
    return dist, f"SELECT {lead}bucket, sum(sum(n)) OVER ({part}ORDER BY bucket) - sum(n) AS before, sum(sum(n)) OVER ({part.strip()}) AS m FROM ({dist}) d0 GROUP BY {lead}bucket"


def bh(source: str, columns: str, q: str, over: str = "") -> str:
    """Rows of source (with p) that step-up control keeps: those up to the largest p that is at most q times the share of values no larger.

    Ties stand or fall together, so ranks are of distinct values: a count within each bucket, on top of the buckets before. No window holds more than a
    bucket's distinct values.
    """
    part = [c.strip() for c in over.split(",") if c.strip()]
    lead = "".join(f"{c}, " for c in part)
    dist, totals = _counted(source, lead)
    same = lambda x, y, to="": "".join(f" AND {x}.{c} = {y}.{to}{c}" for c in part)
    ranked = f"SELECT d.*, b.before + sum(d.n) OVER (PARTITION BY {''.join(f'd.{c}, ' for c in part)}d.bucket ORDER BY d.p) AS r, b.m FROM ({dist}) d JOIN ({totals}) b ON b.bucket = d.bucket{same('b', 'd')}"
    cut = f"SELECT {''.join(f'{c} AS cut_{c}, ' for c in part)}max(p) AS cut_p FROM ({ranked}) k WHERE p <= {q} * r / m" + (f" GROUP BY {over}" if part else "")
    return f"SELECT {columns} FROM ({source}) t JOIN ({cut}) c ON t.p <= c.cut_p{same('t', 'c', 'cut_')}"


def holm(source: str, columns: str) -> str:
    """Rows of source (with p) and what step-down control adjusts p to: a running maximum over distinct values, by bucket and over buckets."""
    dist, totals = _counted(source, "")
    stepped = f"SELECT d.p, d.bucket, least(1.0, (b.m - b.before - sum(d.n) OVER (PARTITION BY d.bucket ORDER BY d.p) + d.n) * d.p) AS v FROM ({dist}) d JOIN ({totals}) b ON b.bucket = d.bucket"
    earlier = f"SELECT bucket, coalesce(max(max(v)) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS top FROM ({stepped}) e GROUP BY bucket"
    adjusted = f"SELECT s.p AS adjusted_p, greatest(e.top, max(s.v) OVER (PARTITION BY s.bucket ORDER BY s.p)) AS adjusted FROM ({stepped}) s JOIN ({earlier}) e ON e.bucket = s.bucket"
    return f"SELECT {columns}, adjusted FROM ({source}) t JOIN ({adjusted}) a ON a.adjusted_p = t.p"


def add_discoveries(plan: Plan, p: str = "", source: str = "residuals", z_cut: float = 2.5, q: float = 0.08, soft_z: float | None = -1.75) -> None:
    """{p}discover_hard and {p}discover_full: (field, cell, polarity, rules): which rules admit each cell."""
    nd, low, high = need(str(z_cut)), f"greatest({C.normal_cdf('z')}, 0.000000000000001)", f"greatest(1 - {C.normal_cdf('z')}, 0.000000000000001)"
    r = f"{{{source}}}"
    rows = lambda polarity, rule, where: f"SELECT field, cell, '{polarity}' AS polarity, '{rule}' AS rule FROM {r} WHERE {where}"
    hard = [rows("under", "z", f"z <= -{nd}"), rows("over", "z", f"z >= greatest({nd} - 0.7, 2.8)"),
            f"SELECT field, cell, 'under' AS polarity, 'bh' AS rule FROM {{{p}bh_under}}", f"SELECT field, cell, 'over' AS polarity, 'bh' AS rule FROM {{{p}bh_over}}"]
    soft = [rows("over", "sparse", f"field IN ({SPARSE}) AND z >= 1.15 AND nr >= 3 AND rho > 0"),
            rows("under", "empty", f"nr = 0 AND n0 * nr_total / n0_total >= {EMPTY_LAMBDA}"), rows("over", "absent", "n0 = 0 AND nr >= 3 AND rho >= 0.8")]
    if soft_z is not None:
        soft.append(rows("under", "bass", f"{bass()} AND rho <= {soft_z} AND z <= {soft_z}"))
    whole = lambda parts: f"SELECT field, cell, polarity, {', '.join(f'max({C.one(f'rule = {x!r}')}) AS by_{x}' for x in ('bh', 'z', 'sparse', 'empty', 'absent', 'bass'))} FROM ({' UNION ALL '.join(parts)}) s GROUP BY field, cell, polarity"
    plan.add(**{
        f"{p}bh_under": bh(f"SELECT field, cell, {low} AS p FROM {r} WHERE {TESTABLE} AND z <= -{nd} * 0.5", "field, cell, p", str(q)),
        f"{p}bh_over": bh(f"SELECT field, cell, {high} AS p FROM {r} WHERE {TESTABLE} AND z >= {nd} * 0.5", "field, cell, p", str(q)),
        f"{p}discover_hard": whole(hard), f"{p}discover_full": whole(hard + soft),
    })


def bass() -> str:
    """A coarse bass path of K or J that is rare enough in the data and common enough in the null to be judged."""
    return "field IN ('K', 'J') AND instr(cell, 'set=') = 0 AND instr(cell, '/to/') > 0 AND nr <= 5 AND n0 >= 24"


#: Calibration grids.
Z_GRID, Q_GRID, SOFT_GRID = (2.5, 3.0, 3.5, 4.0, 4.5, 5.0), (0.05, 0.08, 0.12, 0.2), tuple(-1 - k / 4 for k in range(9))


def add_calibration(plan: Plan, source: str = "x_residuals", seeds: tuple[str, ...] = ("x_", "x1_", "x2_")) -> None:
    """Thresholds from a desynchronised corpus: all 24 grid points in one pass, then the loosest soft threshold, over three such corpora."""
    coupled = ", ".join(f"'{f}'" for f in COUPLED)
    grid = values([(z, q) for z in Z_GRID for q in Q_GRID], "g(z_cut, q)")
    nd = need("z_cut")
    low = f"greatest({C.normal_cdf('z')}, 0.000000000000001)"
    tested = f"SELECT g.z_cut, g.q, r.field, r.cell, r.nr, r.n0, r.z, {low} AS p FROM {{{source}}} r CROSS JOIN {grid} WHERE {TESTABLE.replace('field', 'r.field')} AND r.z <= -{nd} * 0.5"
    empty = f"field IN ({coupled}) AND nr = 0 AND n0 >= 12"
    plan.add(
        calibration_hard=f"""SELECT z_cut, q, field, cell FROM ({bh(tested, 'z_cut, q, field, cell, nr, n0', 'q', 'z_cut, q')}) b WHERE {empty}
            UNION SELECT g.z_cut, g.q, field, cell FROM {{{source}}} CROSS JOIN {grid} WHERE {empty} AND z <= -{nd}""",
        calibration=f"""SELECT z_cut, q, n_false, frac, score, {C.one('frac <= 0.12 AND r = 1')} AS chosen FROM
            (SELECT *, row_number() OVER (ORDER BY {C.one('frac > 0.12')}, score, z_cut, q) AS r FROM
             (SELECT g.z_cut, g.q, n_false, @DOUBLE(n_false) / cells AS frac, abs(@DOUBLE(n_false) / cells - 0.03) + 0.001 * g.z_cut AS score FROM
              (SELECT g.z_cut, g.q, count(h.cell) AS n_false FROM {grid} LEFT JOIN {{calibration_hard}} h ON h.z_cut = g.z_cut AND h.q = g.q GROUP BY g.z_cut, g.q) g
              CROSS JOIN (SELECT greatest(count(*), 1) AS cells FROM {{{source}}} WHERE field IN ({coupled})) c) s) t""",
        soft_calibration=f"""SELECT soft_z, sum(eligible) AS eligible, sum(adds) AS adds, avg(@DOUBLE(adds) / greatest(eligible, 1)) AS frac FROM ({' UNION ALL '.join(_soft(x) for x in seeds)}) s GROUP BY soft_z""",
        soft_chosen="SELECT max(soft_z) AS soft_z FROM {soft_calibration} WHERE frac <= 0.05",
    )


def _soft(p: str) -> str:
    """What each soft threshold adds to the hard prohibitions of one desynchronised corpus."""
    rare = bass().replace("cell", "r.cell")
    return f"""SELECT g.soft_z, sum({C.one('r.n0 >= 24')}) AS eligible, sum({C.one(f'{rare} AND r.rho <= g.soft_z AND r.z <= g.soft_z AND h.cell IS NULL')}) AS adds FROM
        (SELECT * FROM {{{p}residuals}} WHERE field IN ('K', 'J') AND instr(cell, 'set=') = 0 AND instr(cell, '/to/') > 0) r
        LEFT JOIN (SELECT field AS hf, cell FROM {{{p}discover_hard}} WHERE polarity = 'under') h ON h.hf = r.field AND h.cell = r.cell
        CROSS JOIN {values([(z,) for z in SOFT_GRID], 'g(soft_z)')} GROUP BY g.soft_z"""


def add_rules(plan: Plan) -> None:
    """Fixed-threshold rules and their type against the desynchronised corpus."""
    category = "CASE WHEN r.field IN ('M', 'G', 'D', 'P', 'Q') THEN 'within' WHEN s * r.z <= 0 THEN 'none' WHEN s * coalesce(x.z, 0) < 0.5 * s * r.z THEN 'typeI' ELSE 'typeII' END"
    plan.add(
        fixed_rules=f"SELECT field, cell, CASE WHEN rho <= -2 THEN 'forbid' ELSE 'prefer' END AS kind, rho, nr, n0 FROM {{residuals}} WHERE (n0 >= 12 OR nr >= 12) AND (rho <= -2 OR rho >= 1.2)",
        attribution=f"""SELECT d.field, d.cell, d.polarity, r.z AS z_real, coalesce(x.z, 0) AS z_desync, {category.replace('s * ', 'd.s * ')} AS type FROM
            (SELECT *, CASE polarity WHEN 'under' THEN -1 ELSE 1 END AS s FROM {{discover_full}}) d JOIN {{residuals}} r ON r.field = d.field AND r.cell = d.cell
            LEFT JOIN {{x_residuals}} x ON x.field = d.field AND x.cell = d.cell""",
        admission="""SELECT field, cell, polarity, CASE WHEN by_bh = 1 OR by_z = 1 THEN 'threshold' WHEN by_empty = 1 THEN 'empty' WHEN by_absent = 1 THEN 'absent' WHEN by_bass = 1 THEN 'bass' ELSE 'sparse' END AS rule FROM {discover_full}""",
        # a discovered prohibition is run over the windows of every piece again, or, where its field has none, over the piece's cells: where it is broken
        prohibitions=f"""SELECT v.field, v.cell, count(*) AS broken, count(DISTINCT v.piece) AS pieces FROM
            (SELECT field, piece, cell FROM {{local_cells}} UNION ALL {' UNION ALL '.join(f"SELECT '{f}', piece, cell FROM {{units_{f.lower()}}}" for f in ('P', 'Q', 'K', 'J', 'R', 'W', 'F'))}) v
            JOIN (SELECT field, cell FROM {{discover_full}} WHERE polarity = 'under') d ON d.field = v.field AND d.cell = v.cell GROUP BY v.field, v.cell""",
    )
    # places are many to a cell: cells of windows, few, go to all tasks instead of their places to one
    other = " UNION ALL ".join(f"SELECT '{f}' AS field, piece, cell FROM {{units_{f.lower()}}}" for f in ("P", "Q", "K", "J", "R", "W", "F"))
    broken = lambda rows, hint, among: f"""SELECT {hint}v.field, v.cell, count(*) AS broken, count(DISTINCT v.piece) AS pieces FROM {rows} v
        JOIN (SELECT field, cell FROM {{discover_full}} WHERE polarity = 'under' AND field {among} ('P', 'Q', 'K', 'J', 'R', 'W', 'F')) d ON d.field = v.field AND d.cell = v.cell GROUP BY v.field, v.cell"""  # noqa: E731
    plan.add_forms(prohibitions=f"{broken('{local_cells}', '/*+ BROADCAST(d) */ ', 'NOT IN')} UNION ALL {broken(f'({other})', '', 'IN')}")
