"""The pattern-discovery engine against plain Python and its own invariants."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import pytest

from polyvane.functions import cells as C
from polyvane.functions.predicates import predicates
from polyvane.plans.dialect import expand
from polyvane.plans.queries import oracle_sql, plan, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def slices(spark):
    rows = queries()["slices"](spark, SF).collect()
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.piece, r.i)):
        out[r.piece].append((r.tonic, (r.ms, r.ma, r.mt, r.mb)))
    return out


def value(sql):
    return duckdb.sql(f"SELECT {expand(sql, True)}").fetchall()[0][0]


def test_cells():
    cell = value(C.v_cell("2", "2", "7", "7", "'adjacent'"))
    assert cell == "both=1|eqΔ=1|pc07=1|hold=1|leapU=0|sgn=same|role=adjacent"
    assert value(C.h_cell("'SA'", "(72 - 60)")) == value(C.h_cell("'SA'", "(77 - 65)")) == "SA|gap=8to12"
    assert [value(C.g_cell(f"({d})")) for d in (12, -12, 6, 10, 5, 2)] == ["oct+", "oct+", "tritone", "7th", "leap", "small"]
    assert [value(C.move(f"({d})")) for d in (1, -1, -2, 2, 0, 6, 11, 14, 4)] == ["+1", "-1", "-2", "step", "stay", "tritone", "7th", "oct+", "leap"]
    assert value(C.k_token(["64", "60", "55", "48"], "0")) == "b=0|set=0.4.7|ch=0"
    assert value(C.u_cell(["64", "60", "55", "48"], "0")) == "dbl=0"
    assert value(C.pmod("-5")) == 7 and value(C.pitch_name("60")) == "C4" and value(C.pitch_name("NULL")) == "rest"
    assert value(C.perfect("(-12)")) == "P8" and value(C.perfect("19")) == "P5c"


def test_normal_cdf():
    for z in (-4.0, -1.0, 0.0, 0.3, 2.0):
        assert abs(value(C.normal_cdf(f"({z})")) - 0.5 * math.erfc(-z / math.sqrt(2))) < 1e-7


def test_predicates_by_group():
    groups = Counter(a[0] for a, *_ in predicates())
    assert groups == {"A": 13, "B": 6, "C": 8, "D": 5, "E": 3, "F": 3}


def counts(spark, name):
    return {r.cell: r.n for r in queries()[name](spark, SF).collect()}


def test_real_h_and_g_by_hand(spark, slices):
    h, g = Counter(), Counter()
    for rows in slices.values():
        for _, m in rows:
            if None not in m:
                for k, pair in ((0, "SA"), (1, "AT"), (2, "TB")):
                    gap = m[k] - m[k + 1]
                    h[f"{pair}|gap=" + ("cross" if gap < 0 else "le8" if gap <= 7 else "8to12" if gap <= 12 else "12to19" if gap <= 19 else "gt19")] += 1
        for k in range(4):
            for (_, a), (_, b) in zip(rows, rows[1:]):
                if a[k] is not None and b[k] is not None and a[k] != b[k]:
                    d = abs(b[k] - a[k])
                    g["oct+" if d >= 12 else "7th" if d in (10, 11) else "tritone" if d == 6 else "leap" if d >= 5 else "small"] += 1
    assert counts(spark, "real_h") == h
    assert counts(spark, "real_g") == g


def test_null_h_by_hand(spark, slices):
    pitch = defaultdict(Counter)
    for r in queries()["notes"](spark, SF).collect():
        pitch[r.voice][r.midi] += 1
    n = sum(None not in m for rows in slices.values() for _, m in rows)
    want = Counter()
    for a, b in ("SA", "AT", "TB"):
        for x, p in pitch[a].items():
            for y, q in pitch[b].items():
                gap = x - y
                band = "cross" if gap < 0 else "le8" if gap <= 7 else "8to12" if gap <= 12 else "12to19" if gap <= 19 else "gt19"
                want[f"{a}{b}|gap={band}"] += 16 * n * p * q / sum(pitch[a].values()) / sum(pitch[b].values())
    got = counts(spark, "null_h")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_rotation_keeps_each_voice(spark, slices):
    moved = defaultdict(lambda: [Counter() for _ in range(4)])
    for r in queries()["rotated"](spark, SF).collect():
        for k, m in enumerate((r.ms, r.ma, r.mt, r.mb)):
            moved[r.piece][k][m] += 1
    for piece, rows in slices.items():
        assert moved[piece] == [Counter(m[k] for _, m in rows) for k in range(4)]


@pytest.mark.parametrize("field", ["v", "h", "o", "g"])
def test_transposition_changes_nothing(spark, field):
    from polyvane.operators.counts import add_counts
    from polyvane.operators.polyphony import add_slices
    from polyvane.plans.queries import TABLES

    p = plan()
    add_slices(p, "t_", "transposed")
    add_counts(p, "t_", rest=False)
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in TABLES}
    assert {r.cell: r.n for r in p.frame(f"t_real_{field}", tables, spark).collect()} == counts(spark, f"real_{field}")


def test_empty_events(spark):
    from polyvane.plans.queries import TABLES

    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet").limit(0) for t in TABLES}
    for name in ("slices", "real_v", "real_k", "null_v"):
        assert plan().frame(name, tables, spark).count() == 0


@pytest.mark.parametrize("name", ["notes", "tonic", "phrases", "real_v", "real_q", "real_d", "null_m", "null_w", "geometry_fire", "kappa", "paired_tests", "spearman", "fragility", "null_ladder", "bit_substitution", "circular_null", "pooled_atom_auc", "swapped_residuals"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("events", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = queries()[name](spark, SF)
    want = con.sql(oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    fix = lambda x: round(x, 5) if isinstance(x, float) else x
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(fix(r[c]) for c in columns) for r in frame.collect()) == Counter(tuple(fix(r[k]) for k in at) for r in want.fetchall())


def pairs_plan(diffs):
    p = plan()
    return p.add(paired="SELECT 'x' AS method, atom, @DOUBLE(d) AS d FROM (VALUES " + ", ".join(f"('{k:02}', {d})" for k, d in enumerate(diffs)) + ") AS v(atom, d)")


@pytest.mark.parametrize("diffs", [[0.3, -0.1, 0.2, 0.2, -0.2, 0.0, 0.5, 0.1], [0.1], [0.25, 0.5, 0.75, 1.0, 1.25, 1.5], [-0.5, 0.5], [0.0, 0.0]])
def test_paired_tests_by_enumeration(diffs):
    from itertools import product

    sql = pairs_plan(diffs).duck("paired_tests")
    got = dict(zip(duckdb.sql(sql).columns, duckdb.sql(sql).fetchall()[0], strict=True))
    d = [x for x in diffs if x]
    size = sorted(abs(x) for x in d)
    rank = [sum(2 * k + 2 for k, y in enumerate(size) if y == abs(x)) / size.count(abs(x)) for x in d]
    plus, total = sum(r for r, x in zip(rank, d) if x > 0), sum(rank)
    sums = [sum(r for r, take in zip(rank, t) if take) for t in product((0, 1), repeat=len(d))]
    assert got["p_wilcoxon"] == pytest.approx(min(1, 2 * sum(x <= min(plus, total - plus) + 1e-9 for x in sums) / len(sums)), abs=1e-9)
    assert got["rank_biserial"] == pytest.approx((2 * plus - total) / total if d else 0)
    wins = sum(x > 0 for x in d)
    assert got["p_sign"] == pytest.approx(min(1, 2 * sum(math.comb(len(d), k) for k in range(min(wins, len(d) - wins) + 1)) / 2 ** len(d)))
    walsh = sorted((a + b) / 2 for k, a in enumerate(diffs) for b in diffs[k:])
    assert got["hodges_lehmann"] == pytest.approx((walsh[len(walsh) // 2] + walsh[(len(walsh) - 1) // 2]) / 2)
    assert got["median_diff"] == pytest.approx(sorted(diffs)[len(diffs) // 2]) and got["n"] == len(diffs)


def test_random_discovery_keeps_every_draw(spark):
    """One cell of ten is drawn and one holds the only atom: nine draws of ten meet nothing."""
    cells = ", ".join(f"('V', 'c{k}')" for k in range(10))
    p = plan().add(testable=f"SELECT * FROM (VALUES {cells}) AS v(field, cell)", discover_full="SELECT 'V' AS field, 'c0' AS cell, 'under' AS polarity",
                   hits="SELECT 'atom' AS atom, 'V' AS field, 'c3' AS cell, 'under' AS polarity")
    want = {}
    for draw in range(500):
        first = min((hashlib.md5(f"random|{draw}|under|V|c{k}".encode()).hexdigest()[:8], k) for k in range(10))
        want[draw] = (first[1] == 3) / len(predicates())
    assert 0 < sum(x > 0 for x in want.values()) < 100
    assert dict(duckdb.sql(p.duck("random_discovery")).fetchall()) == pytest.approx(want)
    assert {r.draw: r.completeness for r in p.frame("random_discovery", {}, spark).collect()} == pytest.approx(want)


def test_atom_interval_of_ten_thousand_draws():
    diffs = [0.3, -0.1, 0.2, 0.25, -0.2, 0.0, 0.5]
    pick = lambda draw, k: diffs[int(hashlib.md5(f"atom|x|{draw}|{k}".encode()).hexdigest()[:8], 16) % len(diffs)]
    means = sorted(sum(pick(draw, k) for k in range(len(diffs))) / len(diffs) for draw in range(10_000))
    assert duckdb.sql(pairs_plan(diffs).duck("atom_interval")).fetchall()[0][1:] == pytest.approx((means[250], means[9749]))


def test_fragility():
    sql = pairs_plan([0.5, 0.2, -0.1, -0.3, 0.1]).duck("fragility")
    assert duckdb.sql(sql).fetchall()[0][1:] == (1, 1.0)


def test_ladder_counts_every_unit(spark, slices):
    units = sum(None not in a + b for rows in slices.values() for (_, a), (_, b) in zip(rows, rows[1:]))
    total = Counter()
    for r in queries()["ladder_counts"](spark, SF).collect():
        total[r.level, r.field] += r.n
    for level in ("L1", "L2", "L3", "L3D", "L4"):
        assert [total[level, f] for f in "VHSU"] == [16 * units * k for k in (6, 3, 1, 1)]


@pytest.mark.parametrize("name", ["productive_null", "loglinear_null"])
def test_fitted_queries(spark, name):
    real = {(r.field, r.cell): r.nr for r in queries()["residuals"](spark, SF).collect()}
    rows = queries()[name](spark, SF).collect()
    assert {(r.field, r.cell): r.nr for r in rows} == real
    total = defaultdict(float)
    for r in rows:
        assert r.n0 >= 0
        total[r.field] += r.n0
    assert all(total[f] > 0 for f in C.FIELDS)


def test_bit_substitution_by_hand(spark, slices):
    rows = {(r.family, r.member): r for r in queries()["bit_substitution"](spark, SF).collect()}
    assert Counter(f for f, _ in rows) == {"A1": 66, "A6": 12, "A7": 12, "A11": 12}
    assert sum(r.target for r in rows.values()) == 4
    full = [(t, m) for x in slices.values() for t, m in x if None not in m]
    pitch = defaultdict(Counter)
    for r in queries()["notes"](spark, SF).collect():
        pitch[r.voice][r.midi] += 1
    units = [(x[0][0], max(1, sum(None not in m for _, m in x))) for x in slices.values()]
    for e in (0, 11):
        real = sum(sum((v - t) % 12 == e for v in m) >= 2 for t, m in full)
        null = 0.0
        for tonic, n in units:
            none, one_only = 1.0, 0.0
            for v in "SATB":
                p = sum(c for m, c in pitch[v].items() if (m - tonic) % 12 == e) / sum(pitch[v].values())
                none, one_only = none * (1 - p), one_only * (1 - p) + none * p
            null += 16 * n * (1 - none - one_only)
        rate = (null + 0.5) * len(full) / (16 * sum(n for _, n in units))
        assert rows["A11", str(e)].z == pytest.approx((real - rate) / math.sqrt(rate + 0.5), abs=1e-5)
