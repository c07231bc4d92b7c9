"""Evaluation against the reference predicates: AUC by atom, precision at k, enrichment, completeness, random discovery, book cover."""

from __future__ import annotations

from polyvane.functions import cells as C
from polyvane.functions.predicates import has, key, predicates
from polyvane.operators.infer import TESTABLE
from polyvane.operators.polyphony import values
from polyvane.plans.dialect import Plan

PREDICATES = predicates()
ATOMS = values([(a, f, p) for a, f, p, _ in PREDICATES], "a(atom, field, polarity)")
#: Draws of random discovery.
RANDOM_DRAWS = 500


def add_evaluation(plan: Plan, source: str = "residuals", p: str = "", predicates: tuple = tuple(PREDICATES)) -> None:
    """Relations under names that begin with p, for the cells of source; predicates are (atom, field, polarity, condition on cell, nr, n0, rho and z)."""
    ATOMS = values([x[:3] for x in predicates], "a(atom, field, polarity)")  # noqa: N806
    sign = "(CASE polarity WHEN 'under' THEN -1 ELSE 1 END)"
    draws = values([(k,) for k in range(RANDOM_DRAWS)], "g(draw)")
    ks = values([(k,) for k in (25, 50, 100, 200)], "k(k)")
    plan.add(**{
        f"{p}testable": f"SELECT field, cell, nr, n0, rho, z FROM (SELECT *, max({C.one(TESTABLE)}) OVER (PARTITION BY field) AS tested FROM {{{source}}}) r WHERE tested = 0 OR {TESTABLE}",
        f"{p}hits": " UNION ALL ".join(f"SELECT '{a}' AS atom, field, cell, '{polarity}' AS polarity FROM {{{source}}} WHERE field = '{f}' AND ({where})" for a, f, polarity, where in predicates),
        # positives match the atom; negatives match no atom of its field and polarity
        f"{p}scored": f"""SELECT a.atom, {sign} * round(t.z, 9) AS s, CASE WHEN h.cell IS NULL THEN 0 ELSE 1 END AS pos FROM {{{p}testable}} t JOIN {ATOMS} ON a.field = t.field
            LEFT JOIN {{{p}hits}} h ON h.atom = a.atom AND h.cell = t.cell
            LEFT JOIN (SELECT DISTINCT field, cell, polarity FROM {{{p}hits}}) o ON o.field = t.field AND o.cell = t.cell AND o.polarity = a.polarity
            WHERE h.cell IS NOT NULL OR o.cell IS NULL""".replace("polarity WHEN", "a.polarity WHEN"),
        f"{p}atom_auc": f"""SELECT atom, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN (ranks - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) END AS auc FROM
            (SELECT atom, sum(pos) AS n_pos, sum(1 - pos) AS n_neg, sum(pos * (r + (ties - 1) / 2.0)) AS ranks FROM
             (SELECT atom, pos, rank() OVER (PARTITION BY atom ORDER BY s) AS r, count(*) OVER (PARTITION BY atom, s) AS ties FROM {{{p}scored}}) q GROUP BY atom) g""",
        f"{p}covered": f"""SELECT a.polarity, t.field, t.cell, {sign.replace('polarity', 'a.polarity')} * round(t.z, 9) AS s, CASE WHEN h.cell IS NULL THEN 0 ELSE 1 END AS hit FROM {{{p}testable}} t JOIN (SELECT DISTINCT field, polarity FROM {ATOMS}) a ON a.field = t.field
            LEFT JOIN (SELECT DISTINCT field, cell, polarity FROM {{{p}hits}}) h ON h.field = t.field AND h.cell = t.cell AND h.polarity = a.polarity""",
        # a group of ties that crosses rank k counts by the share of it that fits: no order among equals matters
        f"{p}precision_at_k": f"""SELECT polarity, k, sum(CASE WHEN before >= least(k, total) THEN 0 ELSE hits * least(n, least(k, total) - before) * 1.0 / n END) / max(least(k, total)) AS precision, max(base) AS base FROM
            (SELECT polarity, n, hits, sum(n) OVER (PARTITION BY polarity ORDER BY s DESC) - n AS before, sum(n) OVER (PARTITION BY polarity) AS total, @DOUBLE(sum(hits) OVER (PARTITION BY polarity)) / sum(n) OVER (PARTITION BY polarity) AS base FROM
             (SELECT polarity, s, count(*) AS n, @DOUBLE(sum(hit)) AS hits FROM {{{p}covered}} GROUP BY polarity, s) g) q CROSS JOIN {ks} GROUP BY polarity, k""",
        f"{p}enrichment": f"""SELECT polarity, n_found, @DOUBLE(found_hits) / greatest(n_found, 1) AS precision, base, CASE WHEN base > 0 THEN @DOUBLE(found_hits) / greatest(n_found, 1) / base END AS lift FROM
            (SELECT c.polarity, sum(CASE WHEN d.cell IS NULL THEN 0 ELSE 1 END) AS n_found, sum(CASE WHEN d.cell IS NULL THEN 0 ELSE hit END) AS found_hits, @DOUBLE(sum(hit)) / count(*) AS base
             FROM {{{p}covered}} c LEFT JOIN {{discover_full}} d ON d.field = c.field AND d.cell = c.cell AND d.polarity = c.polarity GROUP BY c.polarity) s""",
        f"{p}completeness": f"""SELECT a.atom, a.field, a.polarity, max(CASE WHEN d.cell IS NULL THEN 0 ELSE 1 END) AS recovered, count(h.cell) AS cells FROM {ATOMS} LEFT JOIN {{{p}hits}} h ON h.atom = a.atom
            LEFT JOIN {{discover_full}} d ON d.field = h.field AND d.cell = h.cell AND d.polarity = h.polarity GROUP BY a.atom, a.field, a.polarity""",
        # as many cells at random, by field and polarity, as were discovered: how many atoms would be met; a draw that meets none has 0
        f"{p}random_discovery": f"""SELECT g.draw, @DOUBLE(count(DISTINCT m.atom)) / {len(predicates)} AS completeness FROM {draws} LEFT JOIN (SELECT s.draw, h.atom FROM
            (SELECT t.field, t.cell, q.polarity, q.n, g.draw, row_number() OVER (PARTITION BY t.field, q.polarity, g.draw ORDER BY @HASH32(concat_ws('|', 'random', g.draw, q.polarity, t.field, t.cell)), t.cell) AS r
             FROM {{{p}testable}} t JOIN (SELECT field, polarity, count(*) AS n FROM {{discover_full}} GROUP BY field, polarity) q ON q.field = t.field CROSS JOIN {draws}) s
            JOIN {{{p}hits}} h ON h.field = s.field AND h.cell = s.cell AND h.polarity = s.polarity WHERE s.r <= s.n) m ON m.draw = g.draw GROUP BY g.draw""",
        f"{p}empty_false": f"""SELECT count(*) AS n, sum({C.one(f'NOT ({_cover()})')}) AS uncovered FROM {{{source}}} r JOIN {{discover_full}} d ON d.field = r.field AND d.cell = r.cell
            LEFT JOIN (SELECT DISTINCT field AS hf, cell AS hc FROM {{{p}hits}} WHERE polarity = 'under') h ON h.hf = r.field AND h.hc = r.cell
            WHERE d.polarity = 'under' AND r.nr = 0 AND r.n0 >= 24 AND r.field IN ('V', 'H', 'O', 'M', 'G', 'S', 'U', 'W', 'R')""",
        f"{p}rarity_rank": f"SELECT field, cell, row_number() OVER (PARTITION BY field ORDER BY nr, n0 DESC, cell) AS r FROM {{{source}}} WHERE n0 >= 12 OR nr >= 12",
    })
    plan.add_forms(**_forms(plan, source, p, predicates, sign, draws, ks))


def _forms(plan: Plan, source: str, p: str, predicates: tuple, sign: str, draws: str, ks: str) -> dict[str, str]:
    """The same for Spark without a cell's atoms as a joined table, which would be broadcast, and without a window over all cells of a field or an atom."""
    fields = list(dict.fromkeys(x[1] for x in predicates))
    own = {f: [(f"h{k}", a, q, w) for k, (a, g, q, w) in enumerate(predicates) if g == f] for f in fields}
    taken = lambda f, side: " OR ".join(h for h, _, q, _ in own[f] if q == side)

    def flagged(f: str, rows: str, columns: str) -> str:
        """The cells of a field with its atoms' conditions computed once, and rows made of those."""
        return f"SELECT field, cell, z, {columns} FROM (SELECT field, cell, z, {', '.join(f'coalesce({w}, false) AS {h}' for h, _, _, w in own[f])} FROM {{{p}testable}} WHERE field = '{f}') t LATERAL VIEW inline(array({rows})) e AS {columns}"

    atoms = " UNION ALL ".join(flagged(f, ", ".join(f"struct('{a}' AS a, '{q}' AS b, {h} AS c, {taken(f, q)} AS d)" for h, a, q, _ in own[f]), "atom, polarity, hit, taken") for f in fields)
    sides = " UNION ALL ".join(flagged(f, ", ".join(f"struct('{q}' AS a, {taken(f, q)} AS b)" for q in dict.fromkeys(q for _, _, q, _ in own[f])), "polarity, hit") for f in fields)
    # some thousand buckets in the order of s
    bucket = "cast(sign(s) * floor(ln(1 + abs(s)) * 200) AS int)"
    dist = f"SELECT atom, s, {bucket} AS bucket, count(*) AS n, sum(pos) AS p FROM {{{p}scored}} GROUP BY atom, s"
    before = f"SELECT atom, bucket, sum(sum(n)) OVER (PARTITION BY atom ORDER BY bucket) - sum(n) AS before FROM ({dist}) d0 GROUP BY atom, bucket"
    ranked = f"SELECT /*+ BROADCAST(b) */ d.atom, d.n, d.p, b.before + sum(d.n) OVER (PARTITION BY d.atom, d.bucket ORDER BY d.s) - d.n + 1 AS r FROM ({dist}) d JOIN ({before}) b ON b.atom = d.atom AND b.bucket = d.bucket"
    grouped = f"SELECT polarity, s, count(*) AS n, @DOUBLE(sum(hit)) AS hits FROM {{{p}covered}} GROUP BY polarity, s"
    # a random draw takes the cells of least hash: a count by 1,024ths of the hashes finds the one in which the draw ends, and only cells in it are ranked
    share = "cast(floor(h / 4194304.0) AS int)"
    numbers = "(SELECT field, polarity, count(*) AS n FROM {discover_full} GROUP BY field, polarity)"
    hashed = lambda source: f"""SELECT *, {share} AS share FROM (SELECT /*+ BROADCAST(q) */ t.*, q.polarity, q.n, g.draw, @HASH32(concat_ws('|', 'random', g.draw, q.polarity, t.field, t.cell)) AS h FROM {source} t
        JOIN {numbers} q ON q.field = t.field CROSS JOIN {draws}) u"""  # noqa: E731
    same = "c.field = x.field AND c.polarity = x.polarity AND c.draw = x.draw"
    marked = f"(SELECT t.field, t.cell, h.atom, h.polarity AS own FROM (SELECT field, cell FROM {{{p}testable}}) t JOIN {{{p}hits}} h ON h.field = t.field AND h.cell = t.cell)"
    # ranks by rarity go on from those of smaller counts: cells of one nr and one bucket of n0 are ranked together
    common = f"SELECT field, cell, nr, n0, cast(floor(ln(1 + n0) * 5000) AS bigint) AS bucket FROM {{{source}}} WHERE n0 >= 12 OR nr >= 12"
    sizes = f"SELECT field, nr, bucket, sum(count(*)) OVER (PARTITION BY field ORDER BY nr, bucket DESC) - count(*) AS before FROM ({common}) c0 GROUP BY field, nr, bucket"
    return {
        f"{p}rarity_rank": f"SELECT c.field, c.cell, cast(s.before + row_number() OVER (PARTITION BY c.field, c.nr, c.bucket ORDER BY c.n0 DESC, c.cell) AS int) AS r FROM ({common}) c JOIN ({sizes}) s ON s.field = c.field AND s.nr = c.nr AND s.bucket = c.bucket",
        f"{p}testable": f"SELECT /*+ BROADCAST(k) */ r.field, r.cell, r.nr, r.n0, r.rho, r.z FROM {{{source}}} r JOIN (SELECT field AS of_field, max({C.one(TESTABLE)}) AS tested FROM {{{source}}} GROUP BY field) k ON k.of_field = r.field WHERE tested = 0 OR {TESTABLE}",
        f"{p}scored": f"SELECT atom, {sign} * round(z, 9) AS s, {C.one('hit')} AS pos FROM ({atoms}) c WHERE hit OR NOT taken",
        f"{p}atom_auc": f"""SELECT atom, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN (ranks - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) END AS auc FROM
            (SELECT atom, sum(p) AS n_pos, sum(n - p) AS n_neg, sum(p * (r + (n - 1) / 2.0)) AS ranks FROM ({ranked}) q GROUP BY atom) g""",
        f"{p}covered": f"SELECT polarity, field, cell, {sign} * round(z, 9) AS s, {C.one('hit')} AS hit FROM ({sides}) c",
        # no rank asked for is beyond the 200 best scores
        f"{p}precision_at_k": f"""SELECT q.polarity, k, sum(CASE WHEN before >= least(k, total) THEN 0 ELSE hits * least(n, least(k, total) - before) * 1.0 / n END) / max(least(k, total)) AS precision, max(base) AS base FROM
            (SELECT polarity, n, hits, sum(n) OVER (PARTITION BY polarity ORDER BY s DESC) - n AS before FROM (SELECT *, row_number() OVER (PARTITION BY polarity ORDER BY s DESC) AS best FROM ({grouped}) g) t WHERE best <= 200) q
            JOIN (SELECT polarity AS side, sum(n) AS total, @DOUBLE(sum(hits)) / sum(n) AS base FROM ({grouped}) w GROUP BY polarity) a ON a.side = q.polarity CROSS JOIN {ks} GROUP BY q.polarity, k""",
        f"{p}random_cuts": f"""SELECT field, polarity, draw, share AS cut, n - before AS room FROM (SELECT *, sum(c) OVER (PARTITION BY field, polarity, draw ORDER BY share) - c AS before FROM
            (SELECT field, polarity, draw, n, share, count(*) AS c FROM ({hashed(f'(SELECT field, cell FROM {{{p}testable}})')}) x GROUP BY field, polarity, draw, n, share) s) o WHERE before < n AND before + c >= n""",
        f"{p}random_discovery": f"""SELECT g.draw, @DOUBLE(count(DISTINCT m.atom)) / {len(predicates)} AS completeness FROM {draws} LEFT JOIN (SELECT DISTINCT draw, atom FROM
            (SELECT /*+ BROADCAST(c) */ x.draw, x.atom FROM ({hashed(marked)}) x LEFT JOIN {{{p}random_cuts}} c ON {same} WHERE x.own = x.polarity AND (c.cut IS NULL OR x.share < c.cut)
             UNION ALL SELECT e.draw, h.atom FROM (SELECT field, polarity, draw, cell, room, row_number() OVER (PARTITION BY field, polarity, draw ORDER BY h, cell) AS r FROM
              (SELECT /*+ BROADCAST(c) */ x.*, c.room FROM ({hashed(f'(SELECT field, cell FROM {{{p}testable}})')}) x JOIN {{{p}random_cuts}} c ON {same} AND c.cut = x.share) i) e
              JOIN {{{p}hits}} h ON h.field = e.field AND h.cell = e.cell AND h.polarity = e.polarity WHERE e.r <= e.room) d) m ON m.draw = g.draw GROUP BY g.draw""",
    }


def _cover() -> str:
    """Cells that say what a reference atom says, coarser, finer or as its dual."""
    c = "r.cell"
    on = lambda f, where: f"(r.field = '{f}' AND ({where}))"
    return " OR ".join(["h.hc IS NOT NULL", on("M", f"{has(c, mv=('7th', 'tritone', 'oct+'))} OR {has(c, lt='1')} OR {has(c, b7='1')}"), on("G", f"{c} IN ('tritone', '7th', 'oct+', 'leap')"),
                        on("W", has(c, mot=("similar", "parallel", "static"))), on("U", f"{key(c, 'dbl')} <> '0'"), on("H", has(c, gap=("cross", "12to19", "gt19"))), on("O", has(c, ov="1")),
                        on("S", f"{has(c, miss3='1')} OR {has(c, nlt='2')} OR {has(c, missTon='1')}"), on("V", f"{has(c, both='1', pc07='1', sgn='same')} OR {has(c, role='outer', leapU='1')}")])
