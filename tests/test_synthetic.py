"""Generated corpora keep their own rules; labels follow from the dependence that was planted."""

from itertools import combinations

import pytest

from polyvane.operators.synthetic import RANGES, generate, piece, recombine, truth


def parallels(rows):
    found = 0
    for (_, *a), (_, *b) in zip(rows, rows[1:]):
        for x, y in combinations(range(4), 2):
            same = (a[x] - a[y]) % 12
            found += same in (0, 7) and (b[x] - b[y]) % 12 == same and (b[x] - a[x]) * (b[y] - a[y]) > 0
    return found


@pytest.mark.parametrize("kind", ["S1", "S2", "S3", "S4"])
def test_pieces(kind):
    rows = [piece(kind, k, 3) for k in range(5)]
    assert rows[2] == piece(kind, 2, 3) != piece(kind, 2, 4)
    for r in rows:
        assert [i for i, *_ in r] == [16 * p + 2 * q for p in range(8) for q in range(7)]
        assert all(lo <= m <= hi for _, *ms in r for m, (lo, hi) in zip(ms, RANGES.values(), strict=True))
    broken = sum(map(parallels, rows))
    assert broken == 0 if kind in ("S3", "S4") else broken > 0
    if kind == "S4":
        for _, *m in (x for r in rows for x in r):
            assert any((v - m[3]) % 12 in (3, 4) for v in m[:3]) and sum(v % 12 == 11 for v in m) <= 1


def test_recombined_keeps_each_voice(spark):
    made = generate(spark, "S2", 6, 1)
    assert made.repartition(5).count() == 6 * 56
    mixed = recombine(made, 6, 1)
    for v in ("ms", "ma", "mt", "mb"):
        lines = lambda df: {r.piece: tuple(x.m for x in sorted(r.line)) for r in df.selectExpr("piece", f"struct(i, {v} AS m) AS x").groupBy("piece").agg({"x": "collect_list"}).toDF("piece", "line").collect()}  # noqa: B023, E731
        a, b = lines(made), lines(mixed)
        assert sorted(a.values()) == sorted(b.values())
        assert all((a[k] == b[k]) == (v == "ms") for k in a)


def test_truth(spark):
    rows = {kind: truth(spark, kind, 120).collect() for kind in ("S1", "S3")}
    share = {k: sum(r.label == "indep" for r in v) / len(v) for k, v in rows.items()}
    assert share["S1"] > 0.9 and share["S3"] < share["S1"]
    cell = "both=1|eqΔ=1|pc07=1|hold=1"
    assert {r.label for r in rows["S3"] if r.field == "V" and r.cell.startswith(cell) and r.apart >= 20} == {"avoid"}
    assert sum(r.together for r in rows["S1"]) == sum(r.apart for r in rows["S1"])
