"""What is done with discoveries: evaluated sets, rules with evidence and provenance, statements, the checker that runs rules over pieces, top items.

Relations here number with the vocabulary, but for ``local_cells`` and ``rule_positions``, which are projections of slices and join the rules by
field and cell.
"""

from __future__ import annotations

from polyvane.functions import cells as C
from polyvane.operators.counts import NEXT, NOW
from polyvane.operators.evaluate import ATOMS, PREDICATES
from polyvane.operators.infer import add_discoveries
from polyvane.operators.polyphony import ADJACENT, COMPLETE, M, pick, values
from polyvane.plans.dialect import Plan

#: Fields whose null is designed rather than replayed: not evaluated.
DESIGNED = "('R', 'W', 'F')"
#: Fields whose cells can be located: they read windows of one, two or three slices.
LOCAL = ("V", "O", "H", "S", "U", "M", "G", "D")
#: A prohibition is strong, and run over pieces, if it is met at most so often as expected.
STRONG = 0.25
TOP = 20
#: The atoms that the checker's rules stand for, and the fields of their cells.
CHECKED = ("A1", "A2", "A4", "A5", "A8")
CHECKED_FIELDS = tuple(f for f in LOCAL if any(a in CHECKED and g == f for a, g, _, _ in PREDICATES))


def add_export(plan: Plan) -> None:
    three = "lag(m) OVER w AS m2, lead(m) OVER w AS m1"
    following = ", ".join(f"lead({o}) OVER w AS {q}" for o, q in zip(NOW, NEXT, strict=True))
    window = f"(SELECT piece, i, voice, m, {', '.join(NOW)}, held, hold_others, over, {three}, {following} FROM {{held}} WINDOW w AS (PARTITION BY piece, voice ORDER BY i)) h"
    d_bits = lambda before, held, others, hov: C.d_cell(before, "h.m", "h.m1", ["h." + x for x in NOW], ["h." + x for x in NEXT], held, others, "1 = 0", hov)
    chosen = "CASE polarity WHEN 'under' THEN -1 ELSE 1 END"
    plan.add(
        evaluated=f"SELECT field, cell, polarity, by_bh, by_z, by_sparse, by_empty, by_absent, by_bass FROM {{discover_full}} WHERE field NOT IN {DESIGNED}",
        evaluated_sizes=f"SELECT polarity, count(*) AS n, cast(sum({C.one('by_bh + by_z + by_empty + by_absent + by_bass > 0')}) AS bigint) AS n_without_sparse, cast(sum({C.one('by_bh = 1')}) AS bigint) AS n_bh FROM {{evaluated}} GROUP BY polarity",
        # evidence, the rule that admitted the cell, what desynchronisation leaves of it, and for evaluation only the atoms it matches
        matched="SELECT field, cell, polarity, @LISTED(atom; atom) AS atoms FROM {hits} GROUP BY field, cell, polarity",
        rule_rows=f"""SELECT e.field, e.cell, e.polarity, r.nr, (r.n0 + 0.5) * r.nr_total / greatest(r.n0_total, 1) AS expected, r.rho, r.z, a.rule AS admitted_by, t.type AS provenance, coalesce(m.atoms, '') AS atoms
            FROM {{evaluated}} e JOIN {{residuals}} r ON r.field = e.field AND r.cell = e.cell JOIN {{admission}} a ON a.field = e.field AND a.cell = e.cell AND a.polarity = e.polarity
            JOIN {{attribution}} t ON t.field = e.field AND t.cell = e.cell AND t.polarity = e.polarity LEFT JOIN {{matched}} m ON m.field = e.field AND m.cell = e.cell AND m.polarity = e.polarity""",
        rule_export=f"""SELECT concat(field, CASE polarity WHEN 'under' THEN '-P' ELSE '-F' END, cast(row_number() OVER (ORDER BY polarity DESC, field, cell) AS varchar(9))) AS id, field, cell, polarity, nr, expected,
            nr / expected AS ratio, rho, z, admitted_by, provenance, atoms, {C.one(f"field IN {LOCAL}")} AS locatable FROM {{rule_rows}}""",
        strong=f"SELECT id, field, cell FROM {{rule_export}} WHERE polarity = 'under' AND ratio <= {STRONG}",
        # cells of every window of a piece, at the window's last slice
        local_cells=f"""SELECT 'V' AS field, piece, i, {C.v_cell('(a - a0)', '(b - b0)', '(a0 - b0)', '(a - b)', 'role')} AS cell FROM {{pairs}}
            UNION ALL SELECT 'O', piece, i, {C.o_cell('concat(va, vb)', 'a0', 'b0', 'a', 'b')} FROM {{pairs}} WHERE role = 'adjacent'
            UNION ALL SELECT 'H', piece, i, {C.h_cell('concat(va, vb)', '(' + pick('va') + ' - ' + pick('vb') + ')')} FROM {{slices}} CROSS JOIN {ADJACENT} WHERE {COMPLETE}
            UNION ALL SELECT 'S', piece, i, {C.s_cell(M, 'tonic')} FROM {{slices}} WHERE {COMPLETE} UNION ALL SELECT 'U', piece, i, {C.u_cell(M, 'tonic')} FROM {{slices}} WHERE {COMPLETE}
            UNION ALL SELECT 'M', piece, i, {C.m_cell('voice', 'd0', '(m - m0)')} FROM {{changes}} UNION ALL SELECT 'G', piece, i, {C.g_cell('(m - m0)')} FROM {{changes}}
            UNION ALL SELECT 'D', piece, i + 1, {d_bits('h.m2', 'h.held = 1', 'h.hold_others = 1', 0)} FROM {window} WHERE m2 <> m AND m1 <> m
            UNION ALL SELECT 'D', piece, i + 1, {d_bits('h.m', '1 = 1', '1 = 0', 1)} FROM {window} WHERE over = 1 AND m1 <> m""",
        rule_positions="SELECT DISTINCT s.id, l.field, l.piece, l.i, cast(floor(l.i / 8.0) AS int) AS bar, @DOUBLE(l.i % 8) * 0.5 AS beat FROM {local_cells} l JOIN {strong} s ON s.field = l.field AND s.cell = l.cell",
        # rules that can't be located are counted piece by piece
        rule_totals=f"""SELECT s.id, u.field, u.piece, count(*) AS n FROM ({' UNION ALL '.join(f"SELECT '{f}' AS field, piece, cell FROM {{units_{f.lower()}}}" for f in ('P', 'Q', 'K', 'J'))}) u
            JOIN {{strong}} s ON s.field = u.field AND s.cell = u.cell GROUP BY s.id, u.field, u.piece""",
        flags_per_100="""SELECT t.piece, 100.0 * coalesce(f.n, 0) / s.n AS flags FROM {tonic} t JOIN (SELECT piece, count(*) AS n FROM {slices} GROUP BY piece) s ON s.piece = t.piece
            LEFT JOIN (SELECT piece, sum(n) AS n FROM (SELECT piece, count(*) AS n FROM {rule_positions} GROUP BY piece UNION ALL SELECT piece, count(*) FROM {rule_totals} GROUP BY piece) u GROUP BY piece) f ON f.piece = t.piece""",
        # best cells of each polarity by signed z; ties by a seeded hash
        top_items=f"""SELECT polarity, field, cell, s, r FROM (SELECT polarity, field, cell, s, row_number() OVER (PARTITION BY polarity ORDER BY s DESC, @HASH32(concat_ws('|', 'top0', polarity, field, cell)), field, cell) AS r FROM
            (SELECT p.polarity, t.field, t.cell, ({chosen}) * round(t.z, 9) AS s FROM {{testable}} t CROSS JOIN {values([('under',), ('over',)], 'p(polarity)')} WHERE t.field NOT IN {DESIGNED}) q) u WHERE r <= {TOP}""",
        rules_ranked="SELECT kind, field, cell, rho, row_number() OVER (PARTITION BY kind ORDER BY abs(rho) DESC, field, cell) AS r FROM {fixed_rules}",
        # without the fields over pairs of voices
        nopair_residuals="SELECT * FROM {residuals} WHERE field NOT IN ('V', 'O')",
        nopair_completeness=f"""SELECT a.atom, max(CASE WHEN d.cell IS NULL THEN 0 ELSE 1 END) AS recovered FROM {ATOMS} LEFT JOIN {{hits}} h ON h.atom = a.atom
            LEFT JOIN {{nopair_discover_full}} d ON d.field = h.field AND d.cell = h.cell AND d.polarity = h.polarity GROUP BY a.atom""",
        # the drawn null's discoveries with those by nominal p-values replaced by those by empirical ones
        swapped_rules="""SELECT polarity, count(*) AS n, cast(sum(old) AS bigint) AS n_old, cast(sum(new) AS bigint) AS n_new, @DOUBLE(sum(old * new)) / count(*) AS jaccard FROM
            (SELECT polarity, field, cell, max(old) AS old, max(CASE WHEN part = 'full' AND approx = 0 OR part = 'empirical' THEN 1 ELSE 0 END) AS new FROM
             (SELECT f.polarity, f.field, f.cell, 'full' AS part, 1 AS old, CASE WHEN b.cell IS NULL THEN 0 ELSE 1 END AS approx FROM {r_discover_full} f
              LEFT JOIN (SELECT * FROM {bh_parts} WHERE kind = 'approx') b ON b.polarity = f.polarity AND b.field = f.field AND b.cell = f.cell
              UNION ALL SELECT polarity, field, cell, 'empirical', 0, 0 FROM {bh_parts} WHERE kind = 'empirical') u WHERE field NOT IN ('R', 'W', 'F') GROUP BY polarity, field, cell) s WHERE old + new > 0 GROUP BY polarity""",
        # a rule checker against discovered prohibitions, by place: true, missed and false alarms
        rule_places="SELECT DISTINCT rule, piece, i FROM {geometry} WHERE rule IN ('A1', 'A2', 'A4', 'A5', 'A8')",
        found_places="""SELECT DISTINCT h.atom AS rule, l.piece, l.i FROM {hits} h JOIN {discover_full} d ON d.field = h.field AND d.cell = h.cell AND d.polarity = h.polarity JOIN {local_cells} l ON l.field = h.field AND l.cell = h.cell
            WHERE h.atom IN ('A1', 'A2', 'A4', 'A5', 'A8')""",
        geometry_prf="""SELECT rule, tp, fp, fn, CASE WHEN tp + fp > 0 THEN @DOUBLE(tp) / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN @DOUBLE(tp) / (tp + fn) END AS recall, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM
            (SELECT coalesce(a.rule, b.rule) AS rule, cast(sum(CASE WHEN a.rule IS NOT NULL AND b.rule IS NOT NULL THEN 1 ELSE 0 END) AS bigint) AS tp, cast(sum(CASE WHEN a.rule IS NULL THEN 1 ELSE 0 END) AS bigint) AS fp,
              cast(sum(CASE WHEN b.rule IS NULL THEN 1 ELSE 0 END) AS bigint) AS fn FROM {rule_places} a FULL OUTER JOIN {found_places} b ON b.rule = a.rule AND b.piece = a.piece AND b.i = a.i GROUP BY coalesce(a.rule, b.rule)) s""",
        statements=f"SELECT field, cell, {describe()} AS statement FROM {{residuals}}",
        # one line for a statement, whichever cells say it, with its best place under either method
        statement_merge="""SELECT polarity, statement, count(*) AS n_cells, min(CASE method WHEN 'replay' THEN r END) AS rank_replay, min(CASE method WHEN 'rarity' THEN r END) AS rank_rarity FROM
            (SELECT t.polarity, s.statement, t.r, t.method FROM (SELECT polarity, field, cell, r, 'replay' AS method FROM {top_items} UNION ALL SELECT 'under', field, cell, r, 'rarity' FROM {rarity_top}) t JOIN {statements} s ON s.field = t.field AND s.cell = t.cell) u GROUP BY polarity, statement""",
        rarity_top=f"SELECT field, cell, r FROM (SELECT field, cell, row_number() OVER (ORDER BY nr, n0 DESC, field, cell) AS r FROM {{residuals}} WHERE (n0 >= 12 OR nr >= 12) AND field NOT IN {DESIGNED}) t WHERE r <= {TOP}",
    )
    # A local cell is a hot key: many places of every piece have it, which a join by cell would put in one task. The cells looked for are few, as no such
    # field's vocabulary grows with the pieces: all tasks get them. Places are bits of a number by piece, so that no set of places is sorted or joined.
    found = f"SELECT DISTINCT h.atom, h.field, h.cell FROM {{hits}} h JOIN {{discover_full}} d ON d.field = h.field AND d.cell = h.cell AND d.polarity = h.polarity WHERE h.atom IN {CHECKED} AND h.field IN {CHECKED_FIELDS}"
    place = "shiftleft(1L, cast(i % 32 AS int))"
    measured = plan.nodes["geometry_prf"]
    plan.add_forms(
        rule_positions=plan.nodes["rule_positions"].replace("SELECT DISTINCT", "SELECT /*+ BROADCAST(s) */ DISTINCT").replace("JOIN {strong} s", f"JOIN (SELECT * FROM {{strong}} WHERE field IN {LOCAL}) s"),
        found_places=f"SELECT /*+ BROADCAST(f) */ f.atom AS rule, l.piece, l.i FROM {{local_cells}} l JOIN ({found}) f ON f.field = l.field AND f.cell = l.cell WHERE l.field IN {CHECKED_FIELDS}",
        geometry_prf=f"""{measured[:measured.index('(SELECT coalesce(a.rule')]}(SELECT rule, cast(sum(bit_count(a & b)) AS bigint) AS tp, cast(sum(bit_count(b & ~a)) AS bigint) AS fp, cast(sum(bit_count(a & ~b)) AS bigint) AS fn FROM
            (SELECT rule, piece, word, bit_or(a) AS a, bit_or(b) AS b FROM (SELECT rule, piece, i DIV 32 AS word, {place} AS a, 0L AS b FROM {{geometry_rows}} WHERE rule IN {CHECKED}
              UNION ALL SELECT rule, piece, i DIV 32, 0L, {place} FROM {{found_places}}) u GROUP BY rule, piece, word) p GROUP BY rule) s""")
    # the best cells are found first and only they are put in words; equal z alone are told apart by hash
    worded = f"SELECT *, {describe()} AS statement FROM (SELECT polarity, field, cell, r, 'replay' AS method FROM {{top_items}} UNION ALL SELECT 'under', field, cell, r, 'rarity' FROM {{rarity_top}}) t"
    merged = plan.nodes["statement_merge"]
    plan.add_forms(
        statement_merge=f"{merged[:merged.index('(SELECT t.polarity, s.statement')]}({worded}) u GROUP BY polarity, statement",
        top_items=f"""SELECT * FROM (SELECT polarity, field, cell, s, row_number() OVER (PARTITION BY polarity ORDER BY s DESC, @HASH32(concat_ws('|', 'top0', polarity, field, cell)), field, cell) AS r FROM
            (SELECT polarity, field, cell, s, rank() OVER (PARTITION BY polarity ORDER BY s DESC) AS place FROM (SELECT p.polarity, t.field, t.cell, ({chosen}) * round(t.z, 9) AS s FROM {{testable}} t
              CROSS JOIN {values([('under',), ('over',)], 'p(polarity)')} WHERE t.field NOT IN {DESIGNED}) q) u WHERE place <= {TOP}) b WHERE r <= {TOP}""")
    add_discoveries(plan, "nopair_", "nopair_residuals")


def describe() -> str:
    """A cell in words, as a CASE over the fields."""
    key = lambda name: f"regexp_extract(cell, '(^|[|]){name}=([^|]*)', 2)"
    said = lambda name, yes, no: f"CASE {key(name)} WHEN '1' THEN '{yes}' ELSE '{no}' END"
    eq = "CASE regexp_extract(cell, '(^|[|])eqΔ=([^|]*)', 2) WHEN '1' THEN 'by the same amount' ELSE 'by different amounts' END"
    motion = f"CASE {key('sgn')} WHEN 'same' THEN 'in one direction' WHEN 'opp' THEN 'in opposite directions' WHEN 'obl' THEN 'one of them only' ELSE 'not at all' END"
    where = "CASE split_part(cell, '|slot=', 2) WHEN 'fin' THEN 'at the end of a phrase' ELSE 'inside' END"
    side = lambda k: f"replace(replace(replace(split_part(split_part(cell, '|slot=', 1), '/to/', {k}), '|', ', '), '=', ' '), 'set', 'degrees')"
    succession = f"concat('from ', {side(1)}, ' to ', {side(2)}, ', ', {where})"
    gap = f"CASE {key('gap')} WHEN 'cross' THEN 'cross' WHEN 'le8' THEN 'lie within a fifth' WHEN '8to12' THEN 'lie within an octave' WHEN '12to19' THEN 'lie within a twelfth' ELSE 'lie further than a twelfth apart' END"
    move = f"CASE {key('mv')} WHEN '+1' THEN 'a semitone up' WHEN '-1' THEN 'a semitone down' WHEN '-2' THEN 'a whole tone down' WHEN 'step' THEN 'a whole tone up' WHEN 'stay' THEN 'nowhere' ELSE concat('by ', {key('mv')}) END"
    words = {
        "V": f"concat('voices, ', {key('role')}, ', ', {said('both', 'both moving', 'not both moving')}, ' ', {eq}, ', ', {motion}, ', to ', {said('pc07', 'a perfect interval', 'another interval')}, ', ', {said('hold', 'the interval kept', 'the interval changed')}, CASE {key('leapU')} WHEN '1' THEN ', the upper one by leap' ELSE '' END)",
        "H": f"concat('voices ', substr(cell, 1, 2), ' ', {gap})",
        "O": f"concat('voices ', substr(cell, 1, 2), ' ', {said('ov', 'overlap', 'do not overlap')})",
        "G": "concat('a voice moves by ', CASE cell WHEN 'oct+' THEN 'an octave or more' WHEN '7th' THEN 'a seventh' WHEN 'small' THEN 'a fourth or less' ELSE concat('a ', cell) END)",
        "M": f"concat({said('out', 'an outer voice', 'an inner voice')}, CASE {key('lt')} WHEN '1' THEN ' on the leading note' ELSE '' END, CASE {key('b7')} WHEN '1' THEN ' on the minor seventh' ELSE '' END, ' moves ', {move})",
        "S": f"concat('a sonority with ', {key('nlt')}, ' leading notes and ', {key('n7')}, ' minor sevenths, ', {said('miss3', 'no third above the bass', 'a third above the bass')}, ', ', {said('missTon', 'no full tonic triad', 'a full tonic triad')})",
        "U": f"concat('lowest doubled degree: ', {key('dbl')})", "W": f"concat('motion: ', {key('mot')})", "R": f"concat('voice ', {key('v')}, ' in octave ', {key('oct')})",
        "P": f"concat('close on bass ', {key('b')}, ' and soprano ', {key('sop')})", "Q": succession, "K": succession, "J": succession,
        "D": "concat('three notes: ', replace(replace(cell, '|', ', '), '=', ' '))", "F": "concat('phrases: ', replace(replace(cell, '|', ', '), '=', ' '))",
    }
    return "CASE field " + " ".join(f"WHEN '{f}' THEN {x}" for f, x in words.items()) + " END"


#: Vocabularies by the keys that each drops from the cells of a field; a field without keys is left out.
VOCABULARIES = {
    "full": {},
    "no_degree": {"M": ("lt", "b7"), "S": ("nlt", "n7", "missTon"), "P": None, "U": None, "K": ("b", "set", "ch"), "J": ("b", "set", "ch"), "Q": ("b", "sop")},
    "no_position": {"K": ("slot",), "J": ("slot",), "P": None, "Q": None},
    "coarse_geometry": {"V": ("role", "leapU"), "H": "bands", "D": ("hov", "holdO")},
}


def coarsened(keys: tuple[str, ...] | str) -> str:
    """A cell without some of its key=value parts, '*' for a side that loses all; or with spacing bands merged."""
    if keys == "bands":
        return "replace(replace(replace(replace(cell, 'gap=le8', 'gap=le12'), 'gap=8to12', 'gap=le12'), 'gap=12to19', 'gap=gt12'), 'gap=gt19', 'gap=gt12')"
    left = f"@GSUB(replace(cell, '/to/', '|/to/|'); '(^|[|])({'|'.join(keys)})=[^|]*'; '')"
    side = lambda x: f"coalesce(nullif(@GSUB({x}; '^[|]+|[|]+$'; ''), ''), '*')"
    return f"CASE WHEN instr(cell, '/to/') > 0 THEN concat({side(f'split_part({left}, {chr(39)}/to/{chr(39)}, 1)')}, '/to/', {side(f'split_part({left}, {chr(39)}/to/{chr(39)}, 2)')}) ELSE {side(left)} END"


def add_vocabularies(plan: Plan) -> None:
    """How atoms fare when cells are told apart by less. An atom is expressible if every coarse cell is all in it or all out of it."""
    from polyvane.operators.infer import TESTABLE

    parts = []
    for name, drops in VOCABULARIES.items():
        out = [f for f, keys in drops.items() if keys is None]
        case = "CASE field " + " ".join(f"WHEN '{f}' THEN {coarsened(keys)}" for f, keys in drops.items() if keys) + " ELSE cell END" if any(drops.values()) else "cell"
        gone = f" WHERE field NOT IN ({', '.join(map(repr, out))})" if out else ""
        parts.append(f"SELECT '{name}' AS vocabulary, field, cell AS fine, {case} AS cell, nr, n0 FROM {{residuals}}{gone}")
    sign = "(CASE a.polarity WHEN 'under' THEN -1 ELSE 1 END)"
    total = "PARTITION BY vocabulary, field"
    same = " UNION ALL ".join(f"SELECT '{a}' AS atom, '{f}' AS af, '{p}' AS ap" for a, f, p, _ in PREDICATES)
    plan.add(
        vocabulary_cells=" UNION ALL ".join(parts),
        vocabulary_z=f"""SELECT vocabulary, field, cell, nr, n0, {C.cell_z('nr', 'n0', 'nr_total', 'n0_total')} AS z FROM (SELECT *, sum(nr) OVER ({total}) AS nr_total, sum(n0) OVER ({total}) AS n0_total FROM
            (SELECT vocabulary, field, cell, sum(nr) AS nr, sum(n0) AS n0 FROM {{vocabulary_cells}} GROUP BY vocabulary, field, cell) c) t""",
        vocabulary_ranked=f"SELECT vocabulary, field, cell, round(z, 9) AS z FROM (SELECT *, max({C.one(TESTABLE)}) OVER ({total}) AS tested FROM {{vocabulary_z}}) r WHERE tested = 0 OR {TESTABLE}",
        # of each coarse cell: its fine cells, those in the atom, those in any atom of the field and polarity
        vocabulary_flags=f"""SELECT c.vocabulary, a.atom, c.cell, count(*) AS n, sum(CASE WHEN h.cell IS NULL THEN 0 ELSE 1 END) AS inside, sum(CASE WHEN o.cell IS NULL THEN 0 ELSE 1 END) AS other FROM {{vocabulary_cells}} c
            JOIN ({same}) a ON a.af = c.field LEFT JOIN {{hits}} h ON h.atom = a.atom AND h.cell = c.fine
            LEFT JOIN (SELECT DISTINCT field, cell, polarity FROM {{hits}}) o ON o.field = c.field AND o.cell = c.fine AND o.polarity = a.ap GROUP BY c.vocabulary, a.atom, c.cell""",
        vocabulary_scored=f"""SELECT f.vocabulary, a.atom, {sign} * r.z AS s, CASE WHEN f.inside = f.n THEN 1 WHEN f.other = 0 THEN 0 END AS pos, {C.one('f.inside > 0 AND f.inside < f.n')} AS mixed FROM {{vocabulary_flags}} f
            JOIN {ATOMS} ON a.atom = f.atom JOIN {{vocabulary_ranked}} r ON r.vocabulary = f.vocabulary AND r.field = a.field AND r.cell = f.cell""",
        vocabulary_auc="""SELECT q.vocabulary, q.atom, CASE WHEN m.mixed = 0 AND n_pos > 0 AND n_neg > 0 THEN (ranks - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) END AS auc FROM
            (SELECT vocabulary, atom, sum(pos) AS n_pos, sum(1 - pos) AS n_neg, sum(pos * (r + (ties - 1) / 2.0)) AS ranks FROM
             (SELECT vocabulary, atom, pos, rank() OVER (PARTITION BY vocabulary, atom ORDER BY s) AS r, count(*) OVER (PARTITION BY vocabulary, atom, s) AS ties FROM {vocabulary_scored} WHERE pos IS NOT NULL) g GROUP BY vocabulary, atom) q
            JOIN (SELECT vocabulary, atom, max(mixed) AS mixed FROM {vocabulary_scored} GROUP BY vocabulary, atom) m ON m.vocabulary = q.vocabulary AND m.atom = q.atom""",
    )
    plan.add_forms(**_vocabulary_forms(parts, sign))


def _vocabulary_forms(parts: list[str], sign: str) -> dict[str, str]:
    """The same for Spark: a cell carries its atoms as bits of one number, summed up with its counts; sums by field are joined, and ranks go by buckets."""
    from polyvane.operators.infer import TESTABLE

    places = {a: (k, f, p) for k, (a, f, p, _) in enumerate(PREDICATES)}
    met = " | ".join(f"CASE WHEN coalesce(field = '{f}' AND ({where}), false) THEN {1 << places[a][0]}L ELSE 0L END" for a, f, _, where in PREDICATES)
    fine = " UNION ALL ".join(x.replace("{residuals}", "{vocabulary_fine}").replace(", nr, n0 FROM", ", nr, n0, met FROM") for x in parts)
    # all atoms of a field and polarity
    sides = {key: sum(1 << j for j, *other in places.values() if tuple(other) == key) for key in dict.fromkeys((f, p) for _, f, p in places.values())}
    at = {key: j for j, key in enumerate(sides)}
    counted = ", ".join([f"sum(CASE WHEN (met & {1 << k}L) <> 0 THEN 1 ELSE 0 END) AS i{k}" for k, _, _ in places.values()] + [f"sum(CASE WHEN (met & {bits}L) <> 0 THEN 1 ELSE 0 END) AS o{j}" for j, bits in enumerate(sides.values())])
    entry = lambda a, k, f, p: f"struct('{a}' AS atom, '{p}' AS polarity, i{k} AS inside, o{at[f, p]} AS other)"
    arrays = {f: ", ".join(entry(a, *x) for a, x in places.items() if x[1] == f) for _, f, _ in places.values()}
    rows = "CASE field " + " ".join(f"WHEN '{f}' THEN array({x})" for f, x in arrays.items()) + " END"
    bucket = "cast(sign(s) * floor(ln(1 + abs(s)) * 200) AS int)"
    dist = f"SELECT vocabulary, atom, s, {bucket} AS bucket, count(*) AS n, sum(pos) AS p FROM {{vocabulary_scored}} WHERE pos IS NOT NULL GROUP BY vocabulary, atom, s"
    before = f"SELECT vocabulary, atom, bucket, sum(sum(n)) OVER (PARTITION BY vocabulary, atom ORDER BY bucket) - sum(n) AS before FROM ({dist}) d0 GROUP BY vocabulary, atom, bucket"
    ranked = f"""SELECT /*+ BROADCAST(b) */ d.vocabulary, d.atom, d.n, d.p, b.before + sum(d.n) OVER (PARTITION BY d.vocabulary, d.atom, d.bucket ORDER BY d.s) - d.n + 1 AS r FROM ({dist}) d
        JOIN ({before}) b ON b.vocabulary = d.vocabulary AND b.atom = d.atom AND b.bucket = d.bucket"""
    return {
        "vocabulary_fine": f"SELECT field, cell, nr, n0, {met} AS met FROM {{residuals}}",
        "vocabulary_coarse": f"SELECT vocabulary, field, cell, sum(nr) AS nr, sum(n0) AS n0, count(*) AS n, {counted} FROM ({fine}) c GROUP BY vocabulary, field, cell",
        "vocabulary_tested": f"""SELECT t.*, {C.cell_z('nr', 'n0', 'nr_total', 'n0_total')} AS z FROM (SELECT /*+ BROADCAST(k) */ c.*, k.tested, k.nr_total, k.n0_total FROM {{vocabulary_coarse}} c JOIN
            (SELECT vocabulary AS kv, field AS kf, sum(nr) AS nr_total, sum(n0) AS n0_total, max({C.one(TESTABLE)}) AS tested FROM {{vocabulary_coarse}} GROUP BY vocabulary, field) k ON k.kv = c.vocabulary AND k.kf = c.field) t
            WHERE tested = 0 OR {TESTABLE}""",
        "vocabulary_scored": f"""SELECT vocabulary, e.atom, {sign.replace('a.', 'e.')} * round(z, 9) AS s, CASE WHEN e.inside = n THEN 1 WHEN e.other = 0 THEN 0 END AS pos, {C.one('e.inside > 0 AND e.inside < n')} AS mixed
            FROM (SELECT vocabulary, n, z, explode({rows}) AS e FROM {{vocabulary_tested}}) x""",
        "vocabulary_auc": f"""SELECT q.vocabulary, q.atom, CASE WHEN m.mixed = 0 AND n_pos > 0 AND n_neg > 0 THEN (ranks - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) END AS auc FROM
            (SELECT vocabulary, atom, sum(p) AS n_pos, sum(n - p) AS n_neg, sum(p * (r + (n - 1) / 2.0)) AS ranks FROM ({ranked}) g GROUP BY vocabulary, atom) q
            JOIN (SELECT vocabulary, atom, max(mixed) AS mixed FROM {{vocabulary_scored}} GROUP BY vocabulary, atom) m ON m.vocabulary = q.vocabulary AND m.atom = q.atom""",
    }


def add_noise(plan: Plan) -> None:
    """Every cell split in two by a bit that means nothing: fair coins up to 4,096 a count, the normal law beyond. What of the discoveries stays."""
    from polyvane.operators.infer import add_residuals

    coins = "@ONES(@HASH32(concat_ws('|', 'nz', kind, field, cell, w.w)) & (CASE WHEN n - 32 * w.w >= 32 THEN 4294967295 ELSE cast(power(2, greatest(n - 32 * w.w, 0)) AS bigint) - 1 END))"
    u = lambda k: f"((@HASH32(concat_ws('|', 'nz{k}', kind, field, cell)) + 1) / 4294967297.0)"
    plan.add(
        noise_counts="SELECT field, cell, 'real' AS kind, cast(nr AS bigint) AS n FROM {residuals} UNION ALL SELECT field, cell, 'null', cast(round(n0) AS bigint) FROM {residuals}",
        noise_split=f"""SELECT field, cell, kind, n, cast(sum({coins}) AS bigint) AS k FROM {{noise_counts}} c CROSS JOIN {values([(j,) for j in range(128)], 'w(w)')} WHERE n <= 4096 AND (32 * w.w < n OR w.w = 0) GROUP BY field, cell, kind, n
            UNION ALL SELECT field, cell, kind, n, cast(greatest(0, least(n, round(n / 2.0 + sqrt(n) / 2.0 * sqrt(-2.0 * ln({u('a')})) * cos(2.0 * pi() * {u('b')})))) AS bigint) FROM {{noise_counts}} WHERE n > 4096""",
        noise_joined="""SELECT field, concat('nz=', b.b, '|', cell) AS cell, @DOUBLE(sum(CASE WHEN kind = 'real' THEN CASE b.b WHEN 1 THEN k ELSE n - k END ELSE 0 END)) AS nr,
            @DOUBLE(sum(CASE WHEN kind = 'null' THEN CASE b.b WHEN 1 THEN k ELSE n - k END ELSE 0 END)) AS null_n FROM {noise_split} CROSS JOIN (VALUES (0), (1)) AS b(b) GROUP BY field, cell, b.b""",
        noise_completeness=f"""SELECT a.atom, max(CASE WHEN d.cell IS NULL THEN 0 ELSE 1 END) AS recovered FROM {ATOMS} LEFT JOIN {{hits}} h ON h.atom = a.atom
            LEFT JOIN (SELECT DISTINCT field, substr(cell, 6) AS cell, polarity FROM {{noise_discover_full}}) d ON d.field = h.field AND d.cell = h.cell AND d.polarity = h.polarity GROUP BY a.atom""",
    )
    add_residuals(plan, "noise_residuals", "noise_joined")
    add_discoveries(plan, "noise_", "noise_residuals")


EXPORT_QUERIES = {
    "evaluated_discoveries": "SELECT * FROM {evaluated_sizes}",
    "rule_export": "SELECT id, field, cell, polarity, nr, round(expected, 6) AS expected, round(ratio, 6) AS ratio, round(rho, 6) AS rho, round(z, 6) AS z, admitted_by, provenance, atoms, locatable FROM {rule_export}",
    "rule_positions": "SELECT * FROM {rule_positions}", "rule_totals": "SELECT * FROM {rule_totals}", "flags_per_100": "SELECT piece, round(flags, 6) AS flags FROM {flags_per_100}",
    "top_items": "SELECT polarity, field, cell, round(s, 6) AS s, r FROM {top_items}", "rules_ranked": "SELECT kind, field, cell, round(rho, 6) AS rho, r FROM {rules_ranked}",
    "nopair_completeness": "SELECT * FROM {nopair_completeness}", "swapped_rules": "SELECT polarity, n, n_old, n_new, round(jaccard, 6) AS jaccard FROM {swapped_rules}",
    "geometry_prf": "SELECT rule, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {geometry_prf}",
    "statements": "SELECT field, cell, statement FROM {statements}", "statement_merge": "SELECT * FROM {statement_merge}",
    "vocabulary_auc": "SELECT vocabulary, atom, round(auc, 6) AS auc FROM {vocabulary_auc}", "noise_completeness": "SELECT * FROM {noise_completeness}",
}
