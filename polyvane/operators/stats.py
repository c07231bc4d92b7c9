"""Descriptions of pieces, rule checking, conditional models, resampling, agreement and test statistics."""

from __future__ import annotations

from polyvane.functions import cells as C
from polyvane.operators.infer import holm
from polyvane.operators.polyphony import COMPLETE, M, PAIRS, SLOTS, pick, values
from polyvane.plans.dialect import Plan


def add_stats(plan: Plan) -> None:
    clip = lambda d: f"greatest(-12, least(12, {d}))"
    v4 = ["ms", "ma", "mt", "mb"]
    exchanged = values([("S", "A"), ("A", "T"), ("T", "B"), ("S", "B")], "p(va, vb)")
    pc = lambda x: C.pmod(x)
    fired = lambda grid: f"""SELECT piece, i, va, vb, a, b, a0, b0 FROM (SELECT piece, i, p.va, p.vb, {pick('va')} AS a, {pick('vb')} AS b, {pick('va', '0')} AS a0, {pick('vb', '0')} AS b0 FROM {{{grid}}} CROSS JOIN {PAIRS}) q WHERE a0 IS NOT NULL"""
    lags = ", ".join(f"lag({m}) OVER (PARTITION BY piece ORDER BY i) AS {m}0" for m in v4)
    cross = "ms < ma OR ma < mt OR mt < mb"
    wide = "ms - ma > 12 OR ma - mt > 12 OR mt - mb > 19"
    overlap = "ma > ms0 OR ms < ma0 OR mt > ma0 OR ma < mt0 OR mb > mt0 OR mt < mb0"
    degree = lambda k: C.any_of([f"coalesce(d{v.lower()} = {k}, false)" for v in C.VOICES])
    sounding = ", ".join(f"CASE WHEN {degree(k)} THEN '{k}' END" for k in range(12))
    summed = lambda source: " UNION ALL ".join(f"SELECT piece, {k} AS v, sum(coalesce(m{v.lower()}, 0)) AS s, count(m{v.lower()}) AS n FROM {{{source}}} GROUP BY piece" for k, v in enumerate(C.VOICES))
    plan.add(
        deltas=f"""SELECT piece, voice, i, next_i AS then_i, next_midi - midi AS d, {C.pmod('next_midi - tonic')} - {C.pmod('midi - tonic')} AS d_degree, next_i - i AS gap, cast(floor(next_midi / 12.0) - floor(midi / 12.0) AS int) AS d_octave,
            {C.one('abs(next_midi - midi) IN (1, 2)')} AS step, {C.one('abs(next_midi - midi) >= 5')} AS leap, {C.one('abs(next_midi - midi) IN (6, 8, 9)')} AS aug, {C.g_cell('(next_midi - midi)')} AS size, {C.pitch_name('midi')} AS name, {C.duration('((stop - i) * 0.5)')} AS duration
            FROM (SELECT n.*, t.tonic FROM {{notes}} n JOIN {{tonic}} t ON t.piece = n.piece) n WHERE next_midi IS NOT NULL""",
        figures=f"""SELECT piece, voice, i, CASE WHEN (d > 0) = (d1 > 0) THEN 'pass' ELSE 'neighbour' END AS figure, d1 - d AS second FROM (SELECT *, lead(d) OVER (PARTITION BY piece, voice ORDER BY i) AS d1, lead(step) OVER (PARTITION BY piece, voice ORDER BY i) AS step1 FROM {{deltas}}) s WHERE step = 1 AND step1 = 1""",
        exchanges=f"""SELECT piece, i, va, vb FROM (SELECT piece, i, p.va, p.vb, {pick('va')} AS a, {pick('vb')} AS b, {pick('va', '0')} AS a0, {pick('vb', '0')} AS b0 FROM {{steps}} CROSS JOIN {exchanged}) q
            WHERE {pc('a0')} = {pc('b')} AND {pc('b0')} = {pc('a')} AND {pc('a0')} <> {pc('b0')}""",
        piece_stats=f"""SELECT t.piece, t.tonic, t.mode, max(n.lo) AS lowest, max(n.hi) AS highest, max(n.mean) AS mean_pitch, max(s.sounding) AS sounding, max(s.sync) AS sync FROM {{tonic}} t
            JOIN (SELECT piece, min(midi) AS lo, max(midi) AS hi, avg(@DOUBLE(midi)) AS mean FROM {{notes}} GROUP BY piece) n ON n.piece = t.piece
            JOIN (SELECT piece, avg(@DOUBLE({C.total([C.one(f'{m} IS NOT NULL') for m in M])})) AS sounding, avg(@DOUBLE({C.one('xs + xa + xt + xb >= 3')})) AS sync FROM {{slices}} GROUP BY piece) s ON s.piece = t.piece GROUP BY t.piece, t.tonic, t.mode""",
        motion_counts="SELECT piece, motion, count(*) AS n FROM {pair_steps} GROUP BY piece, motion",
        # lagged correlation of two voices' steps: an equi-join on the shifted index, at most four lags
        step_numbers="SELECT piece, voice, @DOUBLE(d) AS d, row_number() OVER (PARTITION BY piece, voice ORDER BY i) AS k, count(*) OVER (PARTITION BY piece, voice) AS n FROM {deltas}",
        imitation=f"""SELECT piece, va, vb, lag, r FROM (SELECT *, row_number() OVER (PARTITION BY piece, va, vb ORDER BY r DESC, lag) AS best FROM
            (SELECT x.piece, p.va, p.vb, g.lag, CASE WHEN var_pop(x.d) * var_pop(y.d) > 0.0000000001 THEN round(covar_pop(x.d, y.d) / sqrt(var_pop(x.d) * var_pop(y.d)), 6) ELSE 0.0 END AS r FROM {PAIRS}
             CROSS JOIN {values([(k,) for k in range(1, 5)], 'g(lag)')} JOIN {{step_numbers}} x ON x.voice = p.va JOIN {{step_numbers}} y ON y.voice = p.vb AND y.piece = x.piece AND y.k = x.k + g.lag
             WHERE x.n >= 3 AND y.n >= 3 GROUP BY x.piece, p.va, p.vb, g.lag HAVING count(*) >= 3) q) s WHERE best = 1""",
        complete_rows=f"SELECT *, {lags} FROM (SELECT piece, i, {', '.join(v4)} FROM {{slices}} WHERE {COMPLETE}) s",
        complete_beats=f"SELECT *, {lags} FROM (SELECT piece, i, {', '.join(v4)} FROM {{slices}} WHERE {COMPLETE} AND i % 2 = 0) s",
        geometry=f"""SELECT rule, piece, i, voices FROM (
            SELECT 'A1' AS rule, piece, i, concat(va, vb) AS voices FROM ({fired('complete_rows')} UNION ALL {fired('complete_beats')}) u WHERE a <> a0 AND b <> b0 AND {pc('a - b')} IN (0, 7) AND {pc('a - b')} = {pc('a0 - b0')}
            UNION SELECT 'A2', piece, i, 'SB' FROM (SELECT * FROM {{complete_rows}} UNION ALL SELECT * FROM {{complete_beats}}) u WHERE ms <> ms0 AND mb <> mb0 AND (ms > ms0) = (mb > mb0) AND abs(ms - ms0) > 2 AND {pc('ms - mb')} IN (0, 7)
            UNION SELECT 'A4', piece, i, '' FROM {{complete_beats}} WHERE {overlap} UNION SELECT 'A5', piece, i, '' FROM {{complete_beats}} WHERE ms0 IS NOT NULL AND ({cross} OR {wide})
            {' '.join(f"UNION SELECT 'A8', piece, i, '{v}' FROM {{complete_beats}} WHERE abs(m{v.lower()} - m{v.lower()}0) IN (6, 10, 11) OR abs(m{v.lower()} - m{v.lower()}0) > 12" for v in C.VOICES)}) g""",
        # three conditional models: the next step of a voice given metre and last step; motion and interval of a pair given role, metre and last interval; the next
        # set of degrees given metre and set. Add-one within a context seen twice, else add-one overall
        melodic=f"SELECT concat(voice, '|', {C.one('i % 8 = 0')}, '|', {clip('d0')}) AS x, cast({clip('d')} AS varchar(5)) AS y FROM (SELECT voice, then_i AS i, d, lag(d) OVER (PARTITION BY piece, voice ORDER BY i) AS d0 FROM {{deltas}}) s WHERE d0 IS NOT NULL",
        contrapuntal=f"SELECT concat(role, '|', {C.metric('(i % 8 * 0.5)')}, '|', last) AS x, concat(motion, '|', perfect) AS y FROM (SELECT *, coalesce(lag(perfect) OVER (PARTITION BY piece, va, vb ORDER BY i), '-') AS last FROM {{pair_steps}}) s",
        degree_sets=f"SELECT piece, i, metric, concat_ws('.', {sounding}) AS degrees FROM {{slices}}",
        sonorous="SELECT concat(metric, '|', degrees) AS x, after AS y FROM (SELECT metric, degrees, lead(degrees) OVER (PARTITION BY piece ORDER BY i) AS after FROM {degree_sets}) s WHERE after IS NOT NULL",
        model_pairs="SELECT 'h' AS model, x, y FROM {melodic} UNION ALL SELECT 'v', x, y FROM {contrapuntal} UNION ALL SELECT 's', x, y FROM {sonorous}",
        melodic_nll=f"""SELECT model, sum(n) AS n, sum(n * l) / sum(n) AS nll, exp(sum(n * l) / sum(n)) AS perplexity FROM
            (SELECT j.model, j.n, -ln(CASE WHEN c.n >= 2 THEN (j.n + 1.0) / (c.n + k.kinds) ELSE (y.n + 1.0) / (k.n + k.kinds) END) AS l FROM (SELECT model, x, y, count(*) AS n FROM {{model_pairs}} GROUP BY model, x, y) j
             JOIN (SELECT model, x, count(*) AS n FROM {{model_pairs}} GROUP BY model, x) c ON c.model = j.model AND c.x = j.x JOIN (SELECT model, y, count(*) AS n FROM {{model_pairs}} GROUP BY model, y) y ON y.model = j.model AND y.y = j.y
             JOIN (SELECT model, count(*) AS n, count(DISTINCT y) AS kinds FROM {{model_pairs}} GROUP BY model) k ON k.model = j.model) s GROUP BY model""",
        step_tvd=f"""SELECT va, vb, 0.5 * sum(abs(coalesce(sx, 0) - coalesce(sy, 0))) AS tvd FROM (SELECT p.va, p.vb, k.d, x.share AS sx, y.share AS sy FROM {PAIRS} CROSS JOIN (SELECT DISTINCT d FROM {{dp_cat}}) k
            LEFT JOIN {{dp_cat}} x ON x.voice = p.va AND x.d = k.d LEFT JOIN {{dp_cat}} y ON y.voice = p.vb AND y.d = k.d) s GROUP BY va, vb""",
        # half of the pieces at a time, by smallest hash: counts are additive by piece and only summed again
        piece_cells=f"SELECT piece, {C.g_cell('(m - m0)')} AS cell, count(*) AS n FROM {{changes}} GROUP BY piece, {C.g_cell('(m - m0)')}",
        halves=f"SELECT draw, piece FROM (SELECT g.draw, t.piece, row_number() OVER (PARTITION BY g.draw ORDER BY @HASH32(concat_ws('|', 'half', g.draw, t.piece)), t.piece) AS r, count(*) OVER (PARTITION BY g.draw) AS n FROM {{tonic}} t CROSS JOIN {values([(k,) for k in range(200)], 'g(draw)')}) s WHERE r <= floor(n / 2.0)",
        half_shares="SELECT draw, cell, @DOUBLE(n) / sum(n) OVER (PARTITION BY draw) AS share FROM (SELECT h.draw, c.cell, sum(c.n) AS n FROM {halves} h JOIN {piece_cells} c ON c.piece = h.piece GROUP BY h.draw, c.cell) s",
        # bounds by index, the k-th of the sorted draws
        half_intervals="SELECT cell, max(CASE WHEN r = floor(0.025 * (n - 1)) + 1 THEN share END) AS low, max(CASE WHEN r = floor(0.975 * (n - 1)) + 1 THEN share END) AS high FROM (SELECT cell, share, row_number() OVER (PARTITION BY cell ORDER BY share) AS r, count(*) OVER (PARTITION BY cell) AS n FROM {half_shares}) s GROUP BY cell",
        z_tests=f"SELECT field, cell, least(1.0, 2 * (1 - {C.normal_cdf('abs(round(z, 9))')})) AS p FROM {{residuals}} WHERE field IN ({', '.join(repr(f) for f in C.FIELDS)})",
        # critical values: what a two-sided test of each field's cells has to reach, by itself and as one of all
        tests_by_field="SELECT field, count(*) AS tests FROM {z_tests} GROUP BY field",
        critical_z="SELECT field, alpha, tests, kind, -@DOUBLE(z) AS z FROM (" + C.normal_quantiles(f"SELECT field, a.alpha, tests, k.kind, a.alpha / 2 / CASE k.kind WHEN 'family' THEN tests ELSE 1 END AS p FROM {{tests_by_field}} CROSS JOIN {values([(0.001,), (0.01,), (0.05,)], 'a(alpha)')} CROSS JOIN {values([('single',), ('family',)], 'k(kind)')}", "field, alpha, tests, kind") + ") s",
        holm=holm("SELECT * FROM {z_tests}", "field, cell, p"),
        # several raters of one scale: the event types, by the level of the value that they give a user on a day; a day that one doesn't see is a missing rating
        ratings="""SELECT event_type AS rater, concat(user_id, '/', cast(floor(@HOURS(ts) / 24) AS int)) AS item, CASE WHEN max(value) < 100 THEN 'low' WHEN max(value) < 300 THEN 'middle' ELSE 'high' END AS category FROM {events}
            WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY event_type, user_id, floor(@HOURS(ts) / 24)""",
        # Krippendorff: within an item with m ratings each ordered pair weighs 1 / (m - 1)
        rated="SELECT item, category, n, sum(n) OVER (PARTITION BY item) AS m FROM (SELECT item, category, count(*) AS n FROM {ratings} GROUP BY item, category) c",
        alpha="""SELECT cast(total AS bigint) AS ratings, 1 - (differ / total) / (apart / (total * (total - 1))) AS alpha FROM
            (SELECT sum(w) AS total, sum(w) * sum(w) - sum(w * w) AS apart, max(differ) AS differ FROM (SELECT category, @DOUBLE(sum(n)) AS w FROM {rated} WHERE m > 1 GROUP BY category) c
             CROSS JOIN (SELECT sum(@DOUBLE(n) * (m - n) / (m - 1)) AS differ FROM {rated} WHERE m > 1) d) s""",
        # Cohen: every pair of raters on the items that both have
        rater_pairs="SELECT a.rater AS a, b.rater AS b, a.category AS x, b.category AS y, count(*) AS n FROM {ratings} a JOIN {ratings} b ON b.item = a.item AND b.rater > a.rater GROUP BY a.rater, b.rater, a.category, b.category",
        kappa="""SELECT t.a, t.b, t.n, CASE WHEN c.chance < 1 THEN (t.agree - c.chance) / (1 - c.chance) END AS kappa FROM (SELECT a, b, cast(sum(n) AS bigint) AS n, @DOUBLE(sum(CASE WHEN x = y THEN n ELSE 0 END)) / sum(n) AS agree FROM {rater_pairs} GROUP BY a, b) t
            JOIN (SELECT p.a, p.b, sum(@DOUBLE(p.n) * q.n / (@DOUBLE(p.total) * p.total)) AS chance FROM (SELECT a, b, x, sum(n) AS n, max(total) AS total FROM (SELECT *, sum(n) OVER (PARTITION BY a, b) AS total FROM {rater_pairs}) r GROUP BY a, b, x) p
             JOIN (SELECT a, b, y, sum(n) AS n FROM {rater_pairs} GROUP BY a, b, y) q ON q.a = p.a AND q.b = p.b AND q.y = p.x GROUP BY p.a, p.b) c ON c.a = t.a AND c.b = t.b""",
        wilson="""SELECT quality, n, (share + 3.8416 / (2 * n) - h) / (1 + 3.8416 / n) AS low, (share + 3.8416 / (2 * n) + h) / (1 + 3.8416 / n) AS high FROM (SELECT *, 1.96 * sqrt(share * (1 - share) / n + 3.8416 / (4 * n * n)) AS h FROM
            (SELECT quality, @DOUBLE(count(*)) AS n, avg(@DOUBLE(toxic)) AS share FROM {labels} WHERE toxic IS NOT NULL GROUP BY quality) s) q""",
        # as-of, nearest and approximate joins of notes with bars and slices
        bars=f"SELECT t.piece, g.b AS bar, g.b * 4.0 AS start FROM {{tonic}} t CROSS JOIN {values([(k,) for k in range(8)], 'g(b)')}",
        # as of: bars and notes in one order of time, the last bar at or before each note; beats before and after a note's middle likewise
        note_bars="""SELECT piece, voice, i, bar, i * 0.5 - start AS beat FROM (SELECT piece, voice, i, note, @LATEST(bar) OVER w AS bar, @LATEST(start) OVER w AS start FROM
            (SELECT piece, voice, i, i * 0.5 + 0.000001 AS t, NULL AS bar, NULL AS start, 1 AS note FROM {notes} UNION ALL SELECT piece, NULL, NULL, start, bar, start, 0 FROM {bars}) u
            WINDOW w AS (PARTITION BY piece ORDER BY t, note ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) s WHERE note = 1 AND bar IS NOT NULL""",
        nearest_slices="""SELECT piece, voice, i, CASE WHEN earlier IS NULL OR later * 0.5 - t < t - earlier * 0.5 THEN later ELSE earlier END AS slice FROM
            (SELECT piece, voice, i, t, note, @LATEST(b) OVER up AS earlier, @LATEST(b) OVER down AS later FROM
             (SELECT piece, voice, i, (i + stop) * 0.25 AS t, NULL AS b, 1 AS note FROM {notes} UNION ALL SELECT piece, NULL, NULL, i * 0.5, i, 0 FROM {beats}) u
             WINDOW up AS (PARTITION BY piece ORDER BY t, note, voice, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS (PARTITION BY piece ORDER BY t DESC, note, voice, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) s
            WHERE note = 1 AND (earlier IS NOT NULL OR later IS NOT NULL)""",
        note_slices="SELECT n.piece, n.voice, n.i, s.metric, s.tonic FROM {notes} n JOIN {slices} s ON s.piece = n.piece AND cast(round(s.i * 0.5 * 1000000) AS bigint) = cast(round(n.i * 0.5 * 1000000) AS bigint)",
        # degrees of each voice by how many notes have them and for how long
        degree_marginals=f"""SELECT voice, mode, degree, @DOUBLE(n) / sum(n) OVER (PARTITION BY voice, mode) AS by_count, long / sum(long) OVER (PARTITION BY voice, mode) AS by_duration FROM
            (SELECT n.voice, t.mode, {C.pmod('n.midi - t.tonic')} AS degree, count(*) AS n, @DOUBLE(sum(n.stop - n.i)) * 0.5 AS long FROM {{notes}} n JOIN {{tonic}} t ON t.piece = n.piece GROUP BY n.voice, t.mode, {C.pmod('n.midi - t.tonic')}) c""",
        # a cell's mean count over pieces, those without it included: population and sample deviation, standard error; from sums that merge
        cell_sums="SELECT field, cell, @DOUBLE(sum(n)) AS s, @DOUBLE(sum(n * n)) AS q FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, piece, cell, count(*) AS n FROM {{units_{f.lower()}}} GROUP BY piece, cell" for f in C.FIELDS) + ") c GROUP BY field, cell",
        cell_means="""SELECT field, cell, s / n AS mean, sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS sd_population, CASE WHEN n > 1 THEN sqrt(greatest(q - s * s / n, 0) / (n - 1)) END AS sd, CASE WHEN n > 1 THEN sqrt(greatest(q - s * s / n, 0) / (n - 1) / n) END AS se FROM {cell_sums}
            CROSS JOIN (SELECT @DOUBLE(count(*)) AS n FROM {tonic}) t""",
        # what must not be: notes that overlap or are empty, slices off the grid, phrases that overlap, rotations that change a voice's pitches
        structure_violations=f"""SELECT 'note' AS what, piece, cast(i AS bigint) AS place FROM {{notes}} WHERE stop <= i OR i < 0 OR stop > {SLOTS} OR midi < 0 OR midi > 127
            UNION ALL SELECT 'overlap', a.piece, a.i FROM {{notes}} a JOIN {{notes}} b ON b.piece = a.piece AND b.voice = a.voice AND b.i > a.i AND b.i < a.stop
            UNION ALL SELECT 'slice', piece, count(*) FROM {{raw_slices}} GROUP BY piece HAVING count(*) <> {SLOTS} OR min(i) <> 0 OR max(i) <> {SLOTS - 1}
            UNION ALL SELECT 'phrase', a.piece, a.t0 FROM {{phrases}} a JOIN {{phrases}} b ON b.piece = a.piece AND b.ph > a.ph AND b.t0 < a.t1
            UNION ALL SELECT 'rotation', r.piece, r.v FROM ({summed('raw_slices')}) r JOIN ({summed('rotated')}) x ON x.piece = r.piece AND x.v = r.v WHERE x.s <> r.s OR x.n <> r.n""",
        role_moves="SELECT role0, role, count(*) AS n FROM (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS role0 FROM {conversations}) s WHERE role0 IS NOT NULL GROUP BY role0, role",
    )
    # those that are only counted or asked for by place needn't be told apart first
    plan.add_forms(geometry_rows=plan.nodes["geometry"].replace("UNION SELECT", "UNION ALL SELECT"))
