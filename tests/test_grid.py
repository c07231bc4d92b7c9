"""Pieces of any length, score files into cells, bars of unequal length, audits by perturbation, plug-ins."""

import math
from collections import defaultdict
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from polyvane.plans.queries import TABLES, build, plan, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in TABLES}


def test_long_slices(spark, tables):
    """Every slot of a piece holds, by voice, the note that covers it; pieces end where their notes do."""
    from polyvane.operators.grid import free_plan

    p = free_plan()
    notes, slices = p.frame("notes", tables, spark).collect(), p.frame("query_long_slices", tables, spark).collect()
    ends, sounding, begun = defaultdict(int), {}, set()
    for n in notes:
        ends[n.piece] = max(ends[n.piece], n.stop)
        begun.add((n.piece, n.i, n.voice))
        sounding |= {(n.piece, i, n.voice): n.midi for i in range(n.i, n.stop)}
    assert len({n.piece for n in notes}) > 1 and max(ends.values()) > 60
    assert {(s.piece, s.i) for s in slices} == {(k, i) for k, n in ends.items() for i in range(n)}
    for s in slices:
        for v in "satb":
            assert s[f"m{v}"] == sounding.get((s.piece, s.i, v.upper())) and s[f"x{v}"] == ((s.piece, s.i, v.upper()) in begun)


def test_score_files_reach_cells(spark, tmp_path):
    """Notes written as MusicXML and read again give the cells that the same notes give as slices, rests and all."""
    from polyvane.operators.grid import score_cells, score_grid
    from polyvane.sources.scores import read_scores, render_scores

    parts = {0: [72, 74, 76, None, 72, 71, 72], 1: [67, 67, 69, 69, 67, 65, 64], 2: [60, 59, 60, 62, 60, 62, 60], 3: [48, 50, 45, 50, 52, 55, 48]}
    rows = [("p1", v, float(k), float(k + 1), m, False, False) for v, ms in parts.items() for k, m in enumerate(ms)]
    notes = spark.createDataFrame(rows, "piece string, part int, onset double, offset double, midi int, tied boolean, fermata boolean")
    for r in render_scores(notes).collect():
        (tmp_path / f"{r.piece}.musicxml").write_text(r.xml)
    read, rejects = read_scores(spark, str(tmp_path))
    assert rejects.count() == 0
    grid = {(r.voice, r.i): (r.stop, r.midi) for r in score_grid(read).collect()}
    assert grid["S", 6] == (8, None) and grid["B", 0] == (2, 48) and {v for v, _ in grid} == set("SATB")
    cells = {(r.field, r.cell): r.n for r in score_cells(spark, read).collect()}
    # 7 quarters are 14 slots; those under the soprano's rest are no complete slices
    assert sum(n for (f, _), n in cells.items() if f == "H") == 3 * 12
    assert sum(n for (f, _), n in cells.items() if f == "V") == 6 * (5 + 5)
    assert cells["V", "both=1|eqΔ=1|pc07=1|hold=1|leapU=0|sgn=same|role=adjacent"] == 1  # soprano and alto up a step in fifths


def test_bars_of_unequal_length(spark, tables):
    p = plan().add(bars="SELECT piece, b AS bar, start FROM (SELECT DISTINCT piece FROM {notes}) t CROSS JOIN (VALUES (0, 0.0), (1, 3.0), (2, 3.5), (3, 9.0)) AS v(b, start)")
    starts = [0.0, 3.0, 3.5, 9.0]
    rows = p.frame("note_bars", tables, spark).collect()
    assert rows
    for r in rows:
        bar = max(k for k, s in enumerate(starts) if s <= r.i * 0.5 + 1e-6)
        assert (r.bar, r.beat) == (bar, r.i * 0.5 - starts[bar])


def test_nearest_slices(spark, tables):
    p, made = plan(), {}
    beats = defaultdict(list)
    for r in p.frame("beats", tables, spark, made).collect():
        beats[r.piece].append(r.i)
    notes = {(n.piece, n.voice, n.i): n.stop for n in p.frame("notes", tables, spark, made).collect()}
    got = {(r.piece, r.voice, r.i): r.slice for r in p.frame("nearest_slices", tables, spark, made).collect()}
    assert got == {k: min(beats[k[0]], key=lambda b: (abs(b * 0.5 - (k[2] + stop) * 0.25), b)) for k, stop in notes.items() if beats[k[0]]}


def test_perturbation(spark, tables):
    """What is fitted on training pieces doesn't move with held-out ones; a fit that reads all pieces is found out."""
    from polyvane.plans import audit

    changed = tables | {"events": audit.disturb_held_out(tables["events"])}
    rows = audit.perturbed(spark, build(part="train"), tables, changed, ("pitch_cat", "dp_cat", "real_v", "recon_steps")).collect()
    assert all(r.same == 1 and r.n > 0 for r in rows)
    rows = audit.perturbed(spark, build(), tables, changed, ("pitch_cat", "real_v")).collect()
    assert all(r.same == 0 for r in rows)
    a, b = tables["labels"], tables["labels"].orderBy("doc_id", ascending=False).repartition(5)
    assert audit.fingerprint(a) == audit.fingerprint(b) != audit.fingerprint(a.limit(10))


def test_plugins(spark, tables):
    """A method, a predicate and a desynchronisation of one's own go the way of the library's."""
    from polyvane.operators.evaluate import PREDICATES
    from polyvane.plans.plugins import METHODS, SCHEMES, add_methods, add_schemes

    assert set(METHODS) == {"replay", "rarity", "pmi", "productive"} and len(SCHEMES) == 5
    mine = (("X1", "V", "under", "instr(cell, 'both=1') > 0"), *(x for x in PREDICATES if x[1] == "H"))
    p, made = build(), {}
    fields = "WHERE field IN ('V', 'H')"
    add_methods(p, {"flat": f"SELECT field, cell, nr, 1.0 AS null_n FROM {{v_residuals}} {fields}", "own": f"SELECT field, cell, nr, nr AS null_n FROM {{v_residuals}} {fields}"}, mine)
    rows = {(r.method, r.atom): r for r in p.frame("plugged_methods", tables, spark, made).collect()}
    assert rows["flat", "X1"].n_pos > 0 and rows["own", "X1"].auc is not None
    add_schemes(p, {"none": "SELECT * FROM {raw_slices}", "rotated": SCHEMES["rotation"]}, ("V",), mine)
    rows = {(r.scheme, r.atom): r for r in p.frame("plugged_schemes", tables, spark, made).collect()}
    assert set(rows) == {("none", "X1"), ("rotated", "X1")}
    assert rows["none", "X1"].auc == rows["none", "X1"].real_auc  # a corpus left as it is


def test_critical_values(spark):
    for r in queries()["critical_z"](spark, SF).collect():
        p = r.alpha / 2 / (r.tests if r.kind == "family" else 1)
        assert math.isclose(r.z, -NormalDist().inv_cdf(p), abs_tol=2e-5)


def test_broken_structure_is_found(spark, tables):
    """Each kind of violation, put into otherwise sound relations, is reported; sound ones report nothing."""
    sound, made = plan(), {}
    assert sound.frame("structure_violations", tables, spark, made).count() == 0
    notes = sound.frame("notes", tables, spark, made)
    some = notes.orderBy("piece", "voice", "i").limit(1)
    frames = {
        "note": {"notes": notes.unionByName(some.selectExpr("piece", "voice", "i", "i AS stop", "midi", "next_midi", "next_i"))},
        "overlap": {"notes": notes.unionByName(some.selectExpr("piece", "voice", "i + 1 AS i", "i + 9 AS stop", "midi", "next_midi", "next_i")).unionByName(some.selectExpr("piece", "voice", "i + 2 AS i", "i + 9 AS stop", "midi", "next_midi", "next_i"))},
        "slice": {"raw_slices": sound.frame("raw_slices", tables, spark, made).where("i <> 3")},
        "rotation": {"rotated": sound.frame("rotated", tables, spark, made).withColumn("ms", F.col("ms") + 1)},
    }
    for kind, broken in frames.items():
        rows = plan().frame("structure_violations", tables | broken, spark).collect()
        assert kind in {r.what for r in rows}, kind
