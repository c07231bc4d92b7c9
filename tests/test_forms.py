"""Spark's own forms of relations: no window over a whole field, nothing drawn is dealt out, the same rows as the text."""

import pytest

from polyvane.operators.evaluate import add_evaluation
from polyvane.operators.infer import add_residuals
from polyvane.operators.paired import add_paired
from polyvane.plans.dialect import Plan, expand
from polyvane.plans.queries import plan


def shown(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def by_text(p, name):
    """The plan without the forms of these relations."""
    q = Plan().add(**p.nodes).add_forms(**p.forms)
    q.forms.pop(name)
    return q


@pytest.fixture(scope="module")
def cells(spark):
    return spark.sql("SELECT if(id % 3 = 0, 'V', 'K') AS field, concat('c', id) AS cell, cast(id % 17 AS double) AS nr, if(id % 5 = 0, NULL, cast(id % 23 AS double)) AS null_n FROM range(300)")


def test_residuals_sum_by_field_without_a_window(spark, cells):
    p = Plan()
    add_residuals(p, "scored_cells", "given")
    rows = lambda q: sorted((r.field, r.cell, r.nr, r.n0, r.keys, round(r.rho, 9), round(r.z, 9)) for r in q.frame("scored_cells", {"given": cells}, spark).collect())
    assert "Window" not in shown(p.frame("scored_cells", {"given": cells}, spark))
    assert rows(p) == rows(by_text(p, "scored_cells")) and len(rows(p)) == 300


def test_spearman_of_more_cells_than_the_root_of_an_int(spark):
    p = Plan()
    add_paired(p)
    given = {name: spark.range(100_000).selectExpr("'K' AS field", "cast(id AS string) AS cell", f"cast({rho} AS double) AS rho") for name, rho in (("residuals", "id"), ("independent_residuals", "-id"))}
    (row,) = p.frame("spearman", given, spark).collect()
    assert (row.n, round(row.tied, 6), round(row.untied, 6)) == (100_000, -1.0, -1.0)


def test_pick_has_no_lambda_and_finds_every_number(spark):
    pick = expand("@PICK(vals; hi; u)", False)
    assert "->" not in pick
    rows = spark.sql(f"SELECT u, {pick} AS v FROM (SELECT array(7, 5, 9) AS vals, array(2L, 3L, 6L) AS hi, id AS u FROM range(6)) t").collect()
    assert {r.u: r.v for r in rows} == {0: 7, 1: 7, 2: 5, 3: 9, 4: 9, 5: 9}
    assert spark.sql(f"SELECT {expand('@PICK(vals; hi; u)', False)} AS v FROM (SELECT array(7) AS vals, array(2L) AS hi, cast(NULL AS bigint) AS u) t").collect()[0].v is None


def test_evaluation_joins_no_hits_to_score(spark):
    p = Plan()
    add_evaluation(p, "given_residuals")
    given = {"given_residuals": spark.sql("""SELECT 'G' AS field, c AS cell, cast(20 AS double) AS nr, cast(30 AS double) AS n0, 0.5D AS rho, z FROM VALUES ('7th', -3.0D), ('oct+', 1.0D), ('leap', 1.0D), ('small', -4.0D) AS t(c, z)""")}
    scored = shown(p.frame("scored", given, spark))
    assert "LeftOuter" not in scored and "Window" not in scored
    rows = lambda q: {(r.atom, r.n_pos, r.n_neg, r.auc) for r in q.frame("atom_auc", given, spark).collect()}
    plain = Plan().add(**p.nodes)
    assert rows(p) == rows(plain) == {("A9", 1, 2, 0.5), ("A10", 1, 2, 0.25)}


def test_ladder_deals_out_no_draws():
    p = plan()
    assert "ladder_draws" not in p.text("ladder_cells") and "ladder_slices" not in p.text("ladder_cells")


def test_the_sampled_null_deals_out_no_draws():
    p = plan()
    assert all("k_draws" not in p.text(f"{x}null_k") for x in ("", "x_", "x1_", "x2_"))


def test_lattice_splits_supported_cells_only(spark):
    p = plan()
    assert "{partitions}" not in p.text("productive_joined")
    rows = [("X", f"{a}{b}{c}", "s", float(n), [f"a={a}", f"b={b}", f"c={c}"], 3) for (a, b, c), n in zip([(a, b, c) for a in range(3) for b in range(2) for c in range(2)], [5, 0, 3, 1, 0, 2, 7, 1, 0, 0, 4, 0])]
    given = {"bit_lists": spark.createDataFrame([*rows, ("X", "one", "t", 4.0, ["one"], 1), ("Y", "00", "s", 0.0, ["a=0", "b=0"], 2)], "field string, cell string, signature string, nr double, bits array<string>, m int")}
    found = lambda q: sorted(map(tuple, q.frame("productive_joined", given, spark).collect()))
    plain = Plan().add(**p.nodes)
    assert found(p) == found(plain) and len(found(p)) == 14


def test_units_are_dealt_out_before_they_are_drawn(spark):
    p = plan()
    assert all(Plan.TASKS in p.form(x) for x in ("k_sampled", "x_k_sampled", "x1_k_sampled", "replay_k", "x_replay_k", "sim_k", "replay_r", "replay_w", "sim_w"))
    assert all(p.text(x).count("CROSS JOIN {draw_cats}") <= 1 for x in ("replay_k", "sim_k"))  # a sequence is drawn once for both its cells
    assert p.tasks(spark, {}, {"": ((("events.parquet", 300 << 20, 0),),)}) == 300 and p.tasks(spark, {}, {"": ((),)}) == spark.sparkContext.defaultParallelism


def test_rarity_rank_goes_by_buckets(spark):
    p = Plan()
    add_evaluation(p, "given_residuals")
    given = {"given_residuals": spark.sql("SELECT if(id % 2 = 0, 'V', 'K') AS field, concat('c', id) AS cell, cast(id % 5 AS double) AS nr, cast((id * 37) % 90 AS double) / 3 AS n0, 0D AS rho, 0D AS z FROM range(400)")}
    rows = lambda q: sorted((r.field, r.cell, r.r) for r in q.frame("rarity_rank", given, spark).collect())
    assert "PARTITION BY field ORDER BY nr, n0" not in p.form("rarity_rank")
    assert rows(p) == rows(by_text(p, "rarity_rank")) and p.frame("rarity_rank", given, spark).schema["r"].dataType.simpleString() == "int"


def test_simulated_scores_meet_no_window_over_a_field(spark):
    p = plan()
    given = {"sim_cells": spark.sql("SELECT if(id % 2 = 0, 'V', 'K') AS field, cast(id % 3 AS int) AS rep, concat('c', id DIV 6) AS cell, (id * 13) % 30 AS n FROM range(240)"),
             "replay_residuals": spark.sql("SELECT if(id % 2 = 0, 'V', 'K') AS field, concat('c', id DIV 2) AS cell, cast((id * 7) % 40 AS double) AS nr, cast((id * 11) % 25 AS double) AS n0, 900D AS nr_total, 700D AS n0_total, 60L AS keys, round(sin(id) * 4, 1) AS z FROM range(120)")}
    for name in ("sim_z", "empirical"):
        plain = Plan().add(**p.nodes)
        rows = lambda q: sorted(tuple(sorted(r.asDict().items())) for r in q.frame(name, given, spark).collect())  # noqa: E731,B023
        assert rows(p) == rows(plain) and len(rows(p)) > 40
    assert "PARTITION BY field ORDER BY z" not in p.text("empirical") and "{sim_joined}" not in p.text("empirical")


def test_vocabularies_join_no_atoms(spark):
    p = plan()
    assert not {"{hits}", "{vocabulary_flags}", "{vocabulary_cells}"} & set(__import__("re").findall(r"\{\w+\}", p.text("vocabulary_auc")))
    cells = ["gap=cross", "gap=le8", "gap=8to12", "gap=12to19", "gap=gt19"]
    rows = [("H", f"SA|{c}", 5.0 + k, 30.0 - k, 0.1 * k - 0.3, -2.0 + 0.9 * k) for k, c in enumerate(cells)] + [("G", c, 20.0, 30.0, 0.5, z) for c, z in (("7th", -3.0), ("oct+", 1.0), ("leap", 1.0), ("small", -4.0))]
    given = {"residuals": spark.createDataFrame(rows, "field string, cell string, nr double, n0 double, rho double, z double")}
    found = lambda q: sorted((r.vocabulary, r.atom, r.auc) for r in q.frame("vocabulary_auc", given, spark).collect())
    assert found(p) == found(Plan().add(**p.nodes)) and len(found(p)) > 8


def test_log_linear_fits_a_large_signature_pair_by_pair(spark, monkeypatch):
    from polyvane.operators import lattice
    from polyvane.operators.lattice import log_linear_null

    monkeypatch.setattr(lattice, "SWEEPS", 3)
    rows = [("K", f"{a}{b}{c}{d}", "s", float((a * 7 + b * 5 + c * 3 + d * a) % 5) if (a + b) % 4 and (c + d) % 3 else 0.0, [f"a={a}", f"b={b}", f"c={c}", f"d={d}"], 4) for a in range(4) for b in range(4) for c in range(3) for d in range(3)]
    given = spark.createDataFrame([*rows, ("X", "one", "t", 4.0, ["one"], 1), *(("Y", f"y{k}", "u", 0.0, [f"a={k}", "b=0", "c=0"], 3) for k in range(3))], "field string, cell string, signature string, nr double, bits array<string>, m int")
    fitted = lambda *most: {(r.field, r.cell): (r.nr, round(r.null_n, 7)) for r in log_linear_null(given, *most).collect()}
    whole = fitted(10**6)
    assert whole == fitted(50) == fitted(50, 2) and len(whole) == len(rows) + 4  # in one task; the first sweep in Spark; all sweeps in Spark
    assert whole["K", "0000"][1] == 0 and sum(n > 0 for _, n in whole.values()) > 20


def test_bits_are_split_without_a_window(spark):
    p = plan()
    given = {"residuals": spark.createDataFrame([("K", f"b={b}|set={x}|ch=0/to/b={c}|set={x}|ch=1|slot={s}", float((b * c + len(x)) % 4)) for b in range(3) for c in range(3) for x in ("0.4.7", "x") for s in ("fin", "int")]
                                                + [("J", "b=1/to/b=2|slot=fin", 3.0), ("G", "leap", 0.0), ("G", "7th", 2.0), ("H", "SA|gap=cross", 1.0), ("H", "SA|gap=le8", 0.0), ("U", "dbl=none", 0.0)], "field string, cell string, nr double")}
    plain = Plan().add(**p.nodes)
    for name, digits in (("bit_lists", None), ("lattice_cells", None), ("independent", 9)):
        columns = sorted(plain.frame(name, given, spark).columns)
        rows = lambda q: sorted(tuple(repr(round(r[c], digits) if digits and isinstance(r[c], float) else r[c]) for c in columns) for r in q.frame(name, given, spark).collect())  # noqa: E731,B023
        assert rows(p) == rows(plain) and len(rows(p)) == 42
        assert "Window" not in shown(p.frame(name, given, spark))


def test_only_the_best_cells_are_put_in_words(spark):
    p = plan()
    assert "{statements}" not in p.text("statement_merge")
    rows = [("H", f"SA|gap={g}", float(k), 30.0, 0.1, float(k % 4)) for k, g in enumerate(("cross", "le8", "8to12", "12to19", "gt19"))] + [("K", f"b={k}|set=0|ch=0/to/b=0|set=0|ch=0|slot=fin", float(k % 3), 20.0 + k % 2, 0.2, float(k % 7)) for k in range(90)]
    given = {"residuals": spark.createDataFrame(rows, "field string, cell string, nr double, n0 double, rho double, z double")}
    for name in ("top_items", "statement_merge"):
        plain = Plan().add(**p.nodes)
        rows = lambda q: sorted(map(str, q.frame(name, given, spark).collect()))  # noqa: E731,B023
        assert rows(p) == rows(plain) and len(rows(p)) >= 20
    best = shown(p.frame("top_items", given, spark))
    assert best.count("WindowGroupLimit") == 2  # of equal scores only the best are kept before they are hashed and ranked


def test_places_of_rules_are_neither_dealt_by_cell_nor_sorted(spark):
    p = plan()
    assert "BROADCAST(f)" in p.form("found_places") and "BROADCAST(s)" in p.form("rule_positions") and "BROADCAST(d)" in p.form("prohibitions")
    places = spark.createDataFrame([("A1", 1, 0, "SB"), ("A1", 1, 0, "SA"), ("A1", 1, 29, "SB"), ("A4", 1, 31, ""), ("A4", 2, 40, ""), ("A9", 2, 3, "")], "rule string, piece bigint, i int, voices string")
    given = {"geometry": places, "geometry_rows": places, "hits": spark.createDataFrame([("A1", "V", "x", "under"), ("A1", "V", "y", "under"), ("A4", "O", "z", "under"), ("A9", "G", "7th", "under")], "atom string, field string, cell string, polarity string"),
             "discover_full": spark.createDataFrame([("V", "x", "under"), ("O", "z", "under"), ("O", "z", "over"), ("G", "7th", "under")], "field string, cell string, polarity string"),
             "local_cells": spark.createDataFrame([("V", 1, 0, "x"), ("V", 1, 0, "x"), ("V", 1, 5, "x"), ("V", 1, 29, "y"), ("O", 2, 40, "z"), ("O", 3, 8, "z"), ("G", 2, 3, "7th")], "field string, piece bigint, i int, cell string")}
    rows = lambda q: sorted(tuple(r) for r in q.frame("geometry_prf", given, spark).select("rule", "tp", "fp", "fn").collect())
    assert rows(p) == rows(Plan().add(**p.nodes)) == [("A1", 1, 1, 1), ("A4", 1, 1, 1)]
    assert "FullOuter" not in shown(p.frame("geometry_prf", given, spark))


def test_a_write_does_not_merge_small_rows_into_one_task(spark):
    from polyvane.plans import scratch

    session = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m"}
    before = {k: spark.conf.get(k, None) for k in session}
    try:
        for k, v in session.items():
            spark.conf.set(k, v)
        spark.range(500_000).selectExpr("id % 5000 AS piece", "id AS i").createOrReplaceTempView("many_rows")
        made = scratch.write(spark, spark.sql("SELECT piece, row_number() OVER (PARTITION BY piece ORDER BY i) AS r FROM many_rows"), "many")
        assert len(made.inputFiles()) > 1 and made.count() == 500_000
        assert all(spark.conf.get(k) == v for k, v in session.items())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_sampled_null_looks_pitches_up_in_constants(spark):
    p = plan()
    assert "{draw_cats}" not in p.form("x_k_sampled")
    pitches = [(v, m, n) for v, base in (("S", 60), ("A", 53), ("T", 48), ("B", 40)) for m, n in ((base, 5), (base + 2, 1), (base + 5, 90))]
    given = {"pitch_cat": spark.createDataFrame([(v, m, n, 96, n / 96, 3) for v, m, n in pitches], "voice string, m int, n bigint, total bigint, share double, kinds bigint"),
             "dp_cat": spark.createDataFrame([(v, 1, 1, 1.0) for v in "SATB"], "voice string, d int, n bigint, share double"),
             "x_k_units": spark.createDataFrame([(1, 0, 3, 0.25), (2, 7, 1, 0.5)], "piece bigint, tonic int, units bigint, fin double")}
    rows = lambda q: sorted((r.k0, r.k, r.slot) for r in q.frame("x_k_sampled", given, spark).collect())
    assert rows(p) == rows(Plan().add(**p.nodes)) and len(rows(p)) == 64


def test_draws_are_looked_up_in_constants(spark):
    p = plan()
    drawn = [x for x in p.nodes if "{draw_cats}" in p.nodes[x] and ("replay_" in x or "sim_" in x)]
    assert len(drawn) > 20 and not any("{draw_cats}" in p.form(x) for x in drawn)
    cats = {"p": [(50, 1), (52, 4000), (53, 1), (55, 7001)], "d": [(-2, 3), (0, 1), (1, 5)]}
    columns = []
    for name in [f"{k}{v}" for k in "pd" for v in "satb"] + ["bag"]:
        some, hi = cats[name[0] if name != "bag" else "p"], []
        for _, n in some:
            hi.append(n + (hi[-1] if hi else 0))
        columns += [f"array({', '.join(str(v) for v, _ in some)}) AS {name}_val", f"array({', '.join(f'{h}L' for h in hi)}) AS {name}_hi", f"{hi[-1]}L AS {name}_n"]
    given = {"draw_cats": spark.sql(f"SELECT {', '.join(columns)}"),
             "steps": spark.sql("SELECT id AS piece, 1 AS i, 60 AS ms, 55 AS ma, 50 AS mt, 45 AS mb, 61 AS ms0, 56 AS ma0, 51 AS mt0, 46 AS mb0 FROM range(40)"),
             "changes": spark.sql("SELECT id AS piece, 1 AS i, 'A' AS voice, 52 AS m0, 3 AS d0 FROM range(40)"),
             "pitch_ranges": spark.sql("SELECT 'A' AS voice, 52 AS m, 4000L AS n, 11003L AS total, 4001L AS hi, 1L AS lo")}
    for name in ("replay_v", "sim_v", "replay_g", "replay_m"):
        rows = lambda q, name=name: sorted(map(tuple, q.frame(name, given, spark).collect()))
        assert rows(p) == rows(by_text(p, name)) and rows(p)
