"""All fifteen fields, their nulls, residuals, discoveries and AUCs against plain Python."""

import math

import pytest

from polyvane.plans.queries import queries
from tests import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr(
        "user_id", "event_type", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', cast(ts AS timestamp_ntz)) / 3600000000.0D AS h", "value", "ts", "event_id").collect()
    return brute.pieces([(r.user_id, r.event_type, r.h, r.value, (r.ts, r.event_id)) for r in rows])


@pytest.fixture(scope="module")
def real(corpus):
    return brute.real(corpus)


@pytest.fixture(scope="module")
def null(corpus):
    return brute.null(corpus)


def by_field(rows, *columns):
    out = {}
    for r in rows:
        out.setdefault(r.field, {})[r.cell] = tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]]
    return out


def test_real_fields(spark, real):
    got = by_field(queries()["real_counts"](spark, SF).collect(), "n")
    for f, count in real.items():
        assert got[f] == dict(count), f


def test_null_fields(spark, null):
    got = by_field(queries()["null_counts"](spark, SF).collect(), "n")
    for f, want in null.items():
        assert got[f].keys() == want.keys(), f
        assert all(math.isclose(got[f][c], want[c], rel_tol=1e-6, abs_tol=1e-4) for c in want), f


def test_residuals_and_discoveries(spark, real, null):
    got = by_field(queries()["residuals"](spark, SF).collect(), "rho", "z")
    for f in real:
        want = brute.residuals(real[f], null[f])
        assert got[f].keys() == want.keys(), f
        assert all(math.isclose(x, y, rel_tol=1e-5, abs_tol=1e-5) for c in want for x, y in zip(got[f][c], want[c])), f
    under, over = brute.discoveries(real, null)
    found = {(r.field, r.cell, r.polarity) for r in queries()["discover_full"](spark, SF).collect()}
    assert found == {(f, c, "under") for f, c in under} | {(f, c, "over") for f, c in over}


def test_auc(spark, real, null):
    """Every pair of a cell inside an atom and a cell outside all, compared one by one."""
    hits = {}
    for r in queries()["atom_cells"](spark, SF).collect():
        hits.setdefault((r.atom, r.field, r.polarity), set()).add(r.cell)
    for r in queries()["atom_auc"](spark, SF).collect():
        field, polarity = next(((f, p) for a, f, p in hits if a == r.atom), (None, None))
        if field is None:
            continue
        least = 3 if field in "QPGOKJDRUWF" else 12
        z = {c: round(x[1], 9) for c, x in brute.residuals(real[field], null[field]).items() if max(real[field].get(c, 0), null[field].get(c, 0)) >= least}
        others = set().union(*(cells for (_, f, p), cells in hits.items() if (f, p) == (field, polarity)))
        pos, neg = [z[c] for c in z if c in hits[r.atom, field, polarity]], [z[c] for c in z if c not in others]
        side = -1 if polarity == "under" else 1
        if pos and neg:
            want = sum((side * a > side * b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
            assert (r.n_pos, r.n_neg) == (len(pos), len(neg)) and math.isclose(r.auc, want, abs_tol=2e-3), r.atom
        else:
            assert r.auc is None


@pytest.mark.parametrize("field", ["v", "h", "s", "m", "d", "p", "q", "j", "r", "w", "f"])
def test_draws_have_the_closed_form_as_their_mean(spark, null, field):
    """The drawn null's counts lie about the expected ones as draws do."""
    got = {r.cell: r.n for r in queries()[f"replay_{field}"](spark, SF).collect()}
    want = null[field.upper()]
    assert got.keys() <= want.keys()
    assert abs(sum(got.values()) - sum(want.values())) <= 0.02 * sum(want.values()) + 1
    off = [abs(got.get(c, 0) - x) / math.sqrt(x) for c, x in want.items() if x >= 20]
    assert max(off, default=0) < 6 and sum(off) / max(len(off), 1) < 1.5
