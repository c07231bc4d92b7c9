"""Paired comparison of methods over the reference atoms: exact tests, effect sizes, practical bands and rank correlation.

All relations hold one row an atom or fewer, a bounded vocabulary whatever the corpus. The exact signed-rank distribution comes from its
characteristic function on a grid finer than its support, so that no convolution is iterated.
"""

from __future__ import annotations

from polyvane.functions import cells as C
from polyvane.operators.evaluate import ATOMS, PREDICATES, add_evaluation
from polyvane.operators.polyphony import values
from polyvane.plans.dialect import Plan

DELTAS = (0.05, 0.1)
DRAWS = 10000
#: Grid side: its square is more than twice the largest sum of ranks, 1 + ... + number of atoms, plus one.
SIDE = int((len(PREDICATES) * (len(PREDICATES) + 1) + 1) ** 0.5) + 1


def add_paired(plan: Plan) -> None:
    add_evaluation(plan, "uniform_residuals", "u_")
    add_evaluation(plan, "independent_residuals", "i_")
    own = "PARTITION BY method"
    side = ", ".join(f"({k})" for k in range(SIDE))
    draws = f"(SELECT x.a * 100 + y.a AS draw FROM {values([(k,) for k in range(DRAWS // 100)], 'x(a)')} CROSS JOIN {values([(k,) for k in range(100)], 'y(a)')}) g"
    ranked = f"(SELECT method, draw, mean, row_number() OVER (PARTITION BY method ORDER BY mean, draw) AS r FROM {{atom_draws}}) s"
    shared = "SELECT r.field, r.cell, r.rho AS x, u.rho AS y FROM {residuals} r JOIN {independent_residuals} u ON u.field = r.field AND u.cell = r.cell"
    rank = lambda v: f"rank() OVER (PARTITION BY field ORDER BY round({v}, 9)) + (count(*) OVER (PARTITION BY field, round({v}, 9)) - 1) / 2.0"
    plan.add(
        # rarity serves prohibitions and independent bits serve preferences in the hybrid
        method_auc=f"""SELECT method, atom, round(auc, 9) AS auc FROM (SELECT 'replay' AS method, atom, auc FROM {{atom_auc}} UNION ALL SELECT 'rarity', atom, auc FROM {{u_atom_auc}} UNION ALL SELECT 'pmi', atom, auc FROM {{i_atom_auc}}
            UNION ALL SELECT 'hybrid', a.atom, CASE a.polarity WHEN 'under' THEN u.auc ELSE i.auc END FROM {ATOMS} JOIN {{u_atom_auc}} u ON u.atom = a.atom JOIN {{i_atom_auc}} i ON i.atom = a.atom) m WHERE auc IS NOT NULL""",
        # atoms that all methods can judge
        paired="""SELECT b.method, b.atom, round(a.auc - b.auc, 9) AS d FROM (SELECT * FROM {method_auc} WHERE method = 'replay') a JOIN (SELECT * FROM {method_auc} WHERE method <> 'replay') b ON b.atom = a.atom
            JOIN (SELECT atom FROM {method_auc} GROUP BY atom HAVING count(*) = 4) c ON c.atom = a.atom""",
        paired_ranks="SELECT method, d, cast(2 * rank() OVER (PARTITION BY method ORDER BY abs(d)) + count(*) OVER (PARTITION BY method, abs(d)) - 1 AS bigint) AS r2 FROM {paired} WHERE d <> 0",
        rank_sums=f"SELECT method, count(*) AS n, sum(r2) AS tot, sum(CASE WHEN d > 0 THEN r2 ELSE 0 END) AS plus, sum({C.one('d > 0')}) AS wins FROM {{paired_ranks}} GROUP BY method",
        grid=f"SELECT x.a * {SIDE} + y.a AS k FROM (VALUES {side}) AS x(a) CROSS JOIN (VALUES {side}) AS y(a)",
        # P(S <= m) = 1/N sum_k Re(phi(t_k) sum_s exp(-i t_k s)), N = tot + 1, phi(t) = prod cos(t r / 2) exp(i t tot / 2); the sum over s in closed form
        signed_rank=f"""SELECT method, least(1.0, 2 * sum(CASE WHEN k = 0 THEN m + 1 WHEN zeros > 0 THEN 0 ELSE (CASE WHEN negative % 2 = 1 THEN -1 ELSE 1 END) * exp(l) * sin((m + 1) * t / 2) / sin(t / 2) * cos(t * (tot - m) / 2) END) / max(tot + 1)) AS p FROM
            (SELECT s.method, g.k, s.tot, least(s.plus, s.tot - s.plus) AS m, 2 * pi() * g.k / (s.tot + 1) AS t,
              sum({C.one('abs(cos(pi() * g.k * r.r2 / (s.tot + 1))) < 0.000000000001')}) AS zeros, sum({C.one('cos(pi() * g.k * r.r2 / (s.tot + 1)) < 0')}) AS negative,
              sum(ln(greatest(abs(cos(pi() * g.k * r.r2 / (s.tot + 1))), 0.000000000001))) AS l
             FROM {{rank_sums}} s JOIN {{paired_ranks}} r ON r.method = s.method JOIN {{grid}} g ON g.k <= s.tot GROUP BY s.method, g.k, s.tot, s.plus) q GROUP BY method""",
        log_factorials=f"SELECT k, sum(ln(greatest(@DOUBLE(k), 1.0))) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM {values([(k,) for k in range(len(PREDICATES) + 1)], 'g(k)')}",
        sign_test=f"""SELECT s.method, least(1.0, 2 * sum(exp(n.l - i.l - j.l - s.n * ln(2.0)))) AS p FROM {{rank_sums}} s JOIN {{log_factorials}} n ON n.k = s.n
            JOIN {{log_factorials}} i ON i.k <= least(s.wins, s.n - s.wins) JOIN {{log_factorials}} j ON j.k = s.n - i.k GROUP BY s.method""",
        walsh=f"SELECT method, w, row_number() OVER ({own} ORDER BY w) - 1 AS r, count(*) OVER ({own}) AS n FROM (SELECT a.method, (a.d + b.d) / 2 AS w FROM {{paired}} a JOIN {{paired}} b ON b.method = a.method AND b.atom <= a.atom) s",
        hodges_lehmann="SELECT method, avg(w) AS hl FROM {walsh} WHERE r = floor(n / 2.0) OR r = floor((n - 1) / 2.0) GROUP BY method",
        paired_tests="""SELECT d.method, d.n, d.wins, d.losses, d.n - d.wins - d.losses AS ties, d.mean_diff, m.d AS median_diff, (d.wins + 0.5 * (d.n - d.wins - d.losses)) / d.n AS superiority,
            coalesce(g.p, 1) AS p_sign, coalesce(w.p, 1) AS p_wilcoxon, coalesce((2.0 * s.plus - s.tot) / s.tot, 0) AS rank_biserial, h.hl AS hodges_lehmann FROM
            (SELECT method, count(*) AS n, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS losses, avg(d) AS mean_diff FROM {paired} GROUP BY method) d
            JOIN (SELECT method, d FROM (SELECT method, d, row_number() OVER (PARTITION BY method ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY method) AS n FROM {paired}) q WHERE r = floor(n / 2.0)) m ON m.method = d.method
            JOIN {hodges_lehmann} h ON h.method = d.method LEFT JOIN {sign_test} g ON g.method = d.method LEFT JOIN {signed_rank} w ON w.method = d.method LEFT JOIN {rank_sums} s ON s.method = d.method""",
        practical=f"""SELECT p.method, b.delta, sum({C.one('p.d > b.delta')}) AS better, sum({C.one('abs(p.d) <= b.delta')}) AS equal, sum({C.one('p.d < -b.delta')}) AS worse FROM {{paired}} p CROSS JOIN {values([(d,) for d in DELTAS], 'b(delta)')} GROUP BY p.method, b.delta""",
        # how many of the best atoms have to go until the mean difference is not positive; what share of the gain the best three have
        fragility="""SELECT method, sum(CASE WHEN tail > 0.0000000001 THEN 1 ELSE 0 END) AS k_to_zero, CASE WHEN sum(greatest(d, 0)) > 0 THEN sum(CASE WHEN r <= 3 THEN greatest(d, 0) ELSE 0 END) / sum(greatest(d, 0)) END AS top3 FROM
            (SELECT method, d, r, min(tail) OVER (PARTITION BY method ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tail FROM
             (SELECT method, d, row_number() OVER (PARTITION BY method ORDER BY d DESC, atom) AS r, sum(d) OVER (PARTITION BY method ORDER BY d DESC, atom ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM {paired}) q) s GROUP BY method""",
        # atoms drawn with replacement, as many as there are, by hash
        numbered_pairs=f"SELECT method, d, row_number() OVER ({own} ORDER BY atom) - 1 AS k, count(*) OVER ({own}) AS n FROM {{paired}}",
        atom_draws=f"""SELECT x.method, x.draw, avg(y.d) AS mean FROM (SELECT p.method, g.draw, @HASH32(concat_ws('|', 'atom', p.method, g.draw, p.k)) % p.n AS k FROM {{numbered_pairs}} p CROSS JOIN {draws}) x
            JOIN {{numbered_pairs}} y ON y.method = x.method AND y.k = x.k GROUP BY x.method, x.draw""",
        atom_interval=f"SELECT method, max(CASE WHEN r = {int(0.025 * DRAWS) + 1} THEN mean END) AS low, max(CASE WHEN r = {int(0.975 * DRAWS)} THEN mean END) AS high FROM {ranked} GROUP BY method",
        # rank correlation of two methods' residuals: ties share their mean rank, or are broken by the cell's name
        spearman=f"""SELECT field, n, CASE WHEN vx * vy > 0.0000000001 THEN cov / sqrt(vx * vy) END AS tied, 1 - 6 * d2 / (@DOUBLE(n) * (@DOUBLE(n) * n - 1)) AS untied FROM
            (SELECT field, count(*) AS n, var_pop(rx) AS vx, var_pop(ry) AS vy, covar_pop(rx, ry) AS cov, sum(@DOUBLE((ux - uy) * (ux - uy))) AS d2 FROM
             (SELECT field, @DOUBLE({rank('x')}) AS rx, @DOUBLE({rank('y')}) AS ry, row_number() OVER (PARTITION BY field ORDER BY round(x, 9), cell) AS ux, row_number() OVER (PARTITION BY field ORDER BY round(y, 9), cell) AS uy FROM ({shared}) s) r
             GROUP BY field HAVING count(*) >= 5) q""",
    )
    # row numbers are ints in Spark: the square of their difference is one of longs
    plan.add_forms(spearman=plan.nodes["spearman"].replace("(ux - uy) * (ux - uy)", "cast(ux - uy AS bigint) * (ux - uy)"))


PAIRED_QUERIES = {
    "method_auc": "SELECT method, atom, round(auc, 6) AS auc FROM {method_auc}",
    "paired_tests": "SELECT method, n, cast(wins AS bigint) AS wins, cast(losses AS bigint) AS losses, cast(ties AS bigint) AS ties, " + ", ".join(
        f"round(@DOUBLE({x}), 6) AS {x}" for x in ("mean_diff", "median_diff", "superiority", "p_sign", "p_wilcoxon", "rank_biserial", "hodges_lehmann")) + " FROM {paired_tests}",
    "practical_bands": "SELECT method, @DOUBLE(delta) AS delta, cast(better AS bigint) AS better, cast(equal AS bigint) AS equal, cast(worse AS bigint) AS worse FROM {practical}",
    "fragility": "SELECT method, cast(k_to_zero AS bigint) AS k_to_zero, round(top3, 6) AS top3 FROM {fragility}",
    "atom_interval": "SELECT method, round(low, 6) AS low, round(high, 6) AS high FROM {atom_interval}",
    "spearman": "SELECT field, n, round(tied, 6) AS tied, round(untied, 6) AS untied FROM {spearman}",
}
