"""Half-sampling, Monte-Carlo truth, audits, scores, reports and the command line."""

import math
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyvane.plans.queries import plan, queries

SF = "/root/testdata/sf0.001"


def frames(spark, *names):
    from polyvane.plans.queries import TABLES

    tables, made = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in TABLES}, {}
    return [plan().frame(n, tables, spark, made) for n in names]


def test_piece_counts_add_up(spark):
    counts, real, drawn = frames(spark, "piece_counts", "cells_real", "replay_joined")
    summed = {(r.field, r.cell): (r.a, r.b) for r in counts.groupBy("field", "cell").agg(F.sum("nr").alias("a"), F.sum("n0").alias("b")).collect()}
    assert {k: a for k, (a, _) in summed.items() if a} == {(r.field, r.cell): r.n for r in real.collect()}
    assert {k: b for k, (_, b) in summed.items() if b} == {(r.field, r.cell): r.null_n for r in drawn.collect() if r.null_n}


def test_monte_carlo_truth(spark):
    """Independent voices hold as much apart as together; voices that listen to each other don't."""
    from polyvane.operators.synthetic import generate
    from polyvane.operators.truth import combine, donors, monte_carlo, same_structure

    chosen = donors(spark, 40, 200).collect()
    assert all(len({r.S, r.A, r.T, r.B}) == 4 for r in chosen)
    pool = generate(spark, "S1", 8)
    assert same_structure(pool).count() == 0 and same_structure(pool.where("piece <> 3 or i > 0")).count() == 1
    made = combine(pool, donors(spark, 8, 5)).collect()
    assert len(made) == 5 * pool.where("piece = 0").count()
    for kind, depends in (("S1", False), ("S3", True)):
        rows = monte_carlo(spark, kind, 40, 80).where("field = 'V' and atoms like '%A1%'").collect()
        apart, together, error = sum(r.mean for r in rows), sum(r.real for r in rows), math.sqrt(sum(r.se ** 2 for r in rows))
        assert (together < 0.5 * apart) if depends else abs(together - apart) < 6 * error


def test_audit():
    from polyvane.plans.audit import leaks

    assert leaks(plan()) == []
    bad = plan()
    bad.nodes["residuals"] += " WHERE cell IN (SELECT cell FROM {hits})"
    assert ("discover_full", "hits") in leaks(bad)


def test_scores_round_trip(spark, tmp_path):
    from polyvane.sources.scores import NOTES, clipped, measures, read_scores, render_scores

    notes = [("p", 0, 0.0, 1.5, 60, False, False), ("p", 0, 1.5, 6.0, 61, False, True), ("p", 0, 7.0, 8.0, 70, False, False), ("p", 1, 0.0, 8.0, 48, False, False), ("p", 1, 8.0, 9.0, 50, False, False)]
    frame = clipped(spark.createDataFrame(notes, NOTES))
    assert {(r.part, r.onset, r.offset) for r in frame.where("midi is null").collect()} == {(0, 6.0, 7.0)}
    assert frame.agg(F.max("offset")).first()[0] == 8.0
    bars = measures(frame).where("midi = 61").orderBy("onset").collect()
    assert [(r.measure, r.onset, r.offset, r.tied, r.tied_from, r.fermata) for r in bars] == [(0, 1.5, 4.0, True, False, False), (1, 4.0, 6.0, False, True, True)]
    (tmp_path / "a.xml").write_text(render_scores(frame).first().xml)
    (tmp_path / "b.xml").write_text("<score-partwise><part>")
    back, rejects = read_scores(spark, str(tmp_path))
    assert rejects.count() == 1
    got = sorted((r.part, r.onset, r.offset, r.midi) for r in back.collect() if r.midi is not None)
    assert got == [(0, 0.0, 1.5, 60), (0, 1.5, 4.0, 61), (0, 4.0, 6.0, 61), (0, 7.0, 8.0, 70), (1, 0.0, 4.0, 48), (1, 4.0, 8.0, 48)]


def test_chords_and_ties():
    from polyvane.sources.scores import parse_score

    note = lambda step, octave, n, more="": f"<note>{more}<pitch><step>{step}</step><octave>{octave}</octave></pitch><duration>{n}</duration></note>"
    text = f"<score-partwise><part><measure><attributes><divisions>2</divisions></attributes>{note('C', 4, 2)}{note('E', 4, 2, '<chord/>')}{note('D', 4, 0)}<note><rest/><duration>1</duration></note></measure></part></score-partwise>"
    assert parse_score(text) == [(0, 0.0, 1.0, 64, False, False), (0, 1.0, 1.5, None, False, False)]


def test_tables(spark, tmp_path):
    from polyvane.sources.tables import clean_nan, corpus_slice, fresh_pieces, read_json, stamped, strip, write_report, write_sheets

    df = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")], (float("nan"), "x")), (2, 0.5, None, None)], "k int, v double, w array<double>, s struct<a:double,b:string>")
    got = clean_nan(df).orderBy("k").collect()
    assert (got[0].v, got[0].w, got[0].s.a, got[0].s.b, got[1].v, got[1].s) == (None, [1.0, None], None, "x", 0.5, None)
    assert strip(df, "w").columns == ["k", "v", "s"]
    import gzip

    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('{"a": 1}\n{"a": \n')
    rows, rejects = read_json(spark, str(tmp_path / "a.json.gz"), "a int")
    assert [r.a for r in rows.collect()] == [1] and rejects.count() == 1
    write_report(df.select("k", "v"), f"{tmp_path}/report")
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()][0].split() == ["k", "v"]
    write_sheets(spark.createDataFrame([("i1", "under", "no, \"never\"")], "item string, polarity string, statement string"), f"{tmp_path}/sheet")
    assert spark.read.csv(f"{tmp_path}/sheet", header=True, escape='"').first().statement == 'no, "never"' or spark.read.csv(f"{tmp_path}/sheet", header=True).count() == 1
    notes = spark.createDataFrame([(p, v, 0.0, 4.0 if p != 2 else 1.0) for p in range(6) for v in ("SATB" if p != 4 else "SAT")], "piece int, voice string, onset double, offset double")
    assert {r.piece for r in corpus_slice(notes, 2, 1).collect()} == {1, 3}
    pieces = spark.range(58, 66).withColumnRenamed("id", "piece")
    assert {r.piece for r in fresh_pieces(pieces, pieces.where("piece = 63")).collect()} == {61, 62, 64, 65}
    subprocess.run("git init -q . && git -c user.name=a -c user.email=a@b commit -q --allow-empty -m x", shell=True, cwd=tmp_path, check=True)
    assert len(stamped(df.select("k"), str(tmp_path)).first().commit) == 40


def test_command_line(spark, tmp_path, capsys):
    from polyvane.__main__ import STUDIES, main

    assert main(["list"]) == 0 and "real_v" in capsys.readouterr().out
    assert main(["audit"]) == 0 and main(["sql", "real_v"]) == 0
    assert all(q in queries() for names in STUDIES.values() for q in names)
    assert main(["run", "expert", SF, "--out", str(tmp_path)]) == 0 and spark.read.parquet(f"{tmp_path}/kappa").count() > 0
    # results and reports of one name stand beside each other
    assert main(["report", "wilson", SF, "--out", str(tmp_path)]) == 0
    assert spark.read.parquet(f"{tmp_path}/wilson").count() > 0 and spark.read.text(f"{tmp_path}/report/wilson").count() > 0


def test_rewritten_tables_are_read_anew(spark, tmp_path):
    """A table that is rewritten in place is another input for shared relations."""
    import shutil

    folder = tmp_path / "sf"
    shutil.copytree(SF, folder, copy_function=shutil.copyfile)
    folder.chmod(0o755)
    before = queries()["real_v"](spark, str(folder)).count()
    some = spark.read.parquet(f"{SF}/events.parquet").where("user_id % 2 = 0").toPandas()
    some.to_parquet(folder / "events.parquet", coerce_timestamps="us")
    spark.catalog.refreshByPath(str(folder))
    assert before != queries()["real_v"](spark, str(folder)).count() or queries()["notes"](spark, str(folder)).count() < queries()["notes"](spark, SF).count()
