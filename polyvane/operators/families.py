"""Bit substitution: does the interval or degree that a reference atom names rank first among all that could stand in its place?

Real counts meet closed-form expectations of the replay null; a family's members number with the twelve pitch classes, not with the data.
"""

from __future__ import annotations

from polyvane.functions import cells as C
from polyvane.operators.nulls import K
from polyvane.operators.polyphony import COMPLETE, M, values
from polyvane.plans.dialect import Plan

TWELVE = values([(k,) for k in range(12)], "e(e)")


def add_families(plan: Plan) -> None:
    redrawn = """(SELECT voice, m0, d0, count(*) AS n FROM {changes} GROUP BY voice, m0, d0) u JOIN {pitch_cat} x ON x.voice = u.voice AND (x.m <> u.m0 OR x.kinds = 1)
        LEFT JOIN {pitch_cat} z ON z.voice = u.voice AND z.m = u.m0"""
    left = "CASE WHEN x.kinds = 1 THEN 1 ELSE 1 - coalesce(z.share, 0) END"
    degrees = " + ".join(C.one(f"d{m[1]} = e.e") for m in M)
    others = lambda v: " * ".join(f"(1 - p{w})" for w in "satb" if w != v)
    excluded = lambda family, keep, where: f"""SELECT '{family}' AS family, cast(e.e AS varchar(2)) AS member, sum(CASE WHEN d0 = e.e AND {keep} THEN nr ELSE 0 END) AS nr, sum(CASE WHEN d0 = e.e AND {keep} THEN n0 ELSE 0 END) AS n0,
        sum(nr) AS real_total, sum(n0) AS null_total FROM {{degree_moves}} CROSS JOIN {TWELVE} WHERE {where} GROUP BY e.e"""  # noqa: E731
    plan.add(
        # two voices that move by one and the same step, by the interval they keep
        parallel_real=f"SELECT {C.pmod('a - b')} AS pc, sum({C.one('a <> a0 AND a - a0 = b - b0')}) AS n, count(*) AS total FROM {{pairs}} GROUP BY {C.pmod('a - b')}",
        parallel_null=f"SELECT u.pc, {K} * sum(u.n * x.share * y.share) AS n FROM (SELECT va, vb, {C.pmod('a0 - b0')} AS pc, count(*) AS n FROM {{pairs}} GROUP BY va, vb, {C.pmod('a0 - b0')}) u JOIN {{dp_cat}} x ON x.voice = u.va AND x.d <> 0 JOIN {{dp_cat}} y ON y.voice = u.vb AND y.d = x.d GROUP BY u.pc",
        parallel_classes=f"SELECT e.e, coalesce(r.n, 0) AS nr, coalesce(z.n, 0) AS n0, t.total FROM {TWELVE} CROSS JOIN (SELECT sum(total) AS total FROM {{parallel_real}}) t LEFT JOIN {{parallel_real}} r ON r.pc = e.e LEFT JOIN {{parallel_null}} z ON z.pc = e.e",
        degree_moves=f"""SELECT voice, d0, d, sum(nr) AS nr, sum(n0) AS n0 FROM (SELECT voice, d0, m - m0 AS d, @DOUBLE(1) AS nr, @DOUBLE(0) AS n0 FROM {{changes}}
            UNION ALL SELECT u.voice, u.d0, x.m - u.m0, 0, {K} * u.n * x.share / ({left}) FROM {redrawn}) s GROUP BY voice, d0, d""",
        doubled_real=f"SELECT e.e, @DOUBLE(sum({C.one(f'{degrees} >= 2')})) AS nr, @DOUBLE(count(*)) AS total FROM {{slices}} CROSS JOIN {TWELVE} WHERE {COMPLETE} GROUP BY e.e",
        # of four independent voices, two or more have the degree: all but none and one
        voice_degrees=f"SELECT t.tonic, e.e, {', '.join(f'''sum(CASE WHEN c.voice = '{v}' AND {C.pmod('c.m - t.tonic')} = e.e THEN c.share ELSE 0 END) AS p{v.lower()}''' for v in C.VOICES)} FROM (SELECT DISTINCT tonic FROM {{tonic}}) t CROSS JOIN {TWELVE} CROSS JOIN {{pitch_cat}} c GROUP BY t.tonic, e.e",
        doubled_null=f"""SELECT v.e, {K} * sum(u.n * (1 - (1 - ps) * (1 - pa) * (1 - pt) * (1 - pb) - {' - '.join(f'p{v} * {others(v)}' for v in 'satb')})) AS n0, {K} * sum(u.n) AS total FROM {{voice_degrees}} v JOIN
            (SELECT tonic, sum(greatest(n, 1)) AS n FROM (SELECT t.piece, t.tonic, sum({C.one(COMPLETE)}) AS n FROM {{slices}} t GROUP BY t.piece, t.tonic) q GROUP BY tonic) u ON u.tonic = v.tonic GROUP BY v.e""",
        families=f"""SELECT 'A1' AS family, concat(x.e, '.', y.e) AS member, x.nr + y.nr AS nr, x.n0 + y.n0 AS n0, x.total AS real_total, {K} * x.total AS null_total FROM {{parallel_classes}} x JOIN {{parallel_classes}} y ON y.e > x.e
            UNION ALL {excluded('A6', 'd <> 1', "voice IN ('S', 'B')")} UNION ALL {excluded('A7', 'd NOT IN (-1, -2)', '1 = 1')}
            UNION ALL SELECT 'A11', cast(r.e AS varchar(2)), r.nr, z.n0, r.total, z.total FROM {{doubled_real}} r JOIN {{doubled_null}} z ON z.e = r.e""",
        family_ranks=f"""SELECT family, member, z, row_number() OVER (PARTITION BY family ORDER BY round(z, 9), member) AS r, count(*) OVER (PARTITION BY family) AS n,
            {C.one("concat(family, ':', member) IN ('A1:0.7', 'A6:11', 'A7:10', 'A11:11')")} AS target FROM (SELECT family, member, {C.cell_z('nr', 'n0', 'real_total', 'null_total')} AS z FROM (SELECT family, member, @DOUBLE(nr) AS nr, @DOUBLE(n0) AS n0, @DOUBLE(real_total) AS real_total, @DOUBLE(null_total) AS null_total FROM {{families}}) f) s""",
    )


FAMILY_QUERIES = {"bit_substitution": "SELECT family, member, round(z, 6) AS z, cast(r AS bigint) AS r, cast(n AS bigint) AS n, cast(target AS bigint) AS target FROM {family_ranks}"}
