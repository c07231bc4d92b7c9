"""Synthetic corpora of known dependence, and the labels that follow from it.

S1: four independent walks. S2: with register, degree and cadence preferences. S3: also no parallel fifths or octaves, and soprano and bass seldom
move alike. S4: also a third above the bass in every sonority, and no doubled leading note. A step is drawn from the joint distribution of all
allowed steps of the four voices, so no proposal is ever rejected; where nothing is allowed the step is free. Each piece is drawn from
a generator seeded by (seed, kind, piece), so a corpus doesn't depend on its partitioning.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyvane.functions import cells as C
from polyvane.operators.counts import add_counts
from polyvane.operators.polyphony import add_slices
from polyvane.plans.dialect import Plan

KINDS = ("S1", "S2", "S3", "S4")
#: Ranges, first pitches, and weights of a diatonic step by its size.
RANGES = {"S": (60, 79), "A": (53, 74), "T": (48, 69), "B": (40, 62)}
FIRST = {"S": 72, "A": 67, "T": 60, "B": 48}
STEP_WEIGHTS = {0: 0.20, 1: 0.22, 2: 0.10, 3: 0.05, 4: 0.03}
#: Weights of the pitch classes a voice prefers, at a phrase end and elsewhere; the number is the weight of all others.
END_BASS, END_UPPER = ({0: 6.0, 7: 2.0}, 0.05), ({0: 3.0, 4: 2.0, 7: 2.0}, 0.1)
BASS, SOPRANO = ({0: 3.0, 7: 3.0, 5: 1.5, 9: 1.5}, 1.0), ({0: 2.0, 4: 2.0, 7: 2.0}, 1.0)
PHRASES, QUARTERS, ALIKE = 8, 6, 0.4
SCALE = np.array([m for m in range(36, 90) if m % 12 in C.DIATONIC])
#: Fields that recombination across pieces changes.
FIELDS = ("V", "O", "H", "S", "U")
SCHEMA = "piece long, i int, tonic int, mode string, ms int, ma int, mt int, mb int, xs int, xa int, xt int, xb int"


def _choices(kind: str, voice: str, now: int, end: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pitches that a voice may take next, and their weights."""
    low, high = RANGES[voice]
    step = SCALE.searchsorted(SCALE) - int(SCALE.searchsorted(now))
    near = (np.abs(step) <= 4) & (SCALE >= low) & (SCALE <= high)
    pitch, step = SCALE[near], step[near]
    weight = np.array([STEP_WEIGHTS[abs(int(k))] for k in step])
    off = now - (low + high) / 2
    if abs(off) > 4:  # pulled back to the middle
        weight[step * off > 0] *= 0.5
    if kind != "S1":
        table = (END_BASS if voice == "B" else END_UPPER) if end else BASS if voice == "B" else SOPRANO if voice == "S" else ({}, 1.0)
        weight = weight * np.array([table[0].get(int(p) % 12, table[1]) for p in pitch])
    return pitch, weight


def _draw(kind: str, now: tuple[int, ...], end: bool, rng: np.random.Generator) -> tuple[int, ...]:
    pitches, weights = zip(*(_choices(kind, v, m, end) for v, m in zip(C.VOICES, now, strict=True)), strict=True)
    then = [x.reshape(-1) for x in np.meshgrid(*pitches, indexing="ij")]
    weight = np.prod([x.reshape(-1) for x in np.meshgrid(*weights, indexing="ij")], axis=0)
    free = weight
    if kind in ("S3", "S4"):
        move = [b - a for a, b in zip(now, then, strict=True)]
        alike = lambda x, y: move[x] * move[y] > 0
        for x in range(4):
            for y in range(x + 1, 4):
                if (now[x] - now[y]) % 12 in (0, 7):
                    weight = np.where(alike(x, y) & ((then[x] - then[y]) % 12 == (now[x] - now[y]) % 12), 0, weight)
        weight = np.where(alike(0, 3), ALIKE * weight, weight)
    if kind == "S4":
        third = np.any([np.isin((then[k] - then[3]) % 12, (3, 4)) for k in range(3)], axis=0)
        weight = np.where(third & (sum(x % 12 == 11 for x in then) <= 1), weight, 0)
    total = np.cumsum(weight if weight.any() else free)
    at = int(np.searchsorted(total, rng.random() * total[-1], side="right"))
    return tuple(int(x[at]) for x in then)


def piece(kind: str, number: int, seed: int) -> list[tuple]:
    """(i, s, a, t, b) of one piece; i counts half-quarters."""
    rng = np.random.default_rng([seed, zlib.crc32(kind.encode()), number])
    now = tuple(int(SCALE[np.abs(SCALE - min(max(FIRST[v] + 2 * int(rng.integers(-2, 3)), RANGES[v][0]), RANGES[v][1])).argmin()]) for v in C.VOICES)
    out, i = [], 0
    for _ in range(PHRASES):
        for q in range(QUARTERS + 1):
            now = _draw(kind, now, q == QUARTERS, rng)
            out.append((i, *now))
            i += 4 if q == QUARTERS else 2
    return out


def generate(spark: SparkSession, kind: str, pieces: int, seed: int = 0) -> DataFrame:
    """Raw slices of a corpus in C major, one at every onset."""

    def make(batches):
        for batch in batches:
            rows = [(int(n), i, 0, "major", *m, 1, 1, 1, 1) for n in batch["id"] for i, *m in piece(kind, int(n), seed)]
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.range(pieces).mapInPandas(make, SCHEMA)


def recombine(slices: DataFrame, pieces: int, seed: int = 0) -> DataFrame:
    """Each lower voice from another piece, by a turn of the pieces of its own; pieces number 0 to pieces - 1."""
    turns = np.random.default_rng([seed, 1]).choice(np.arange(1, pieces), 3, replace=pieces < 4).tolist() if pieces > 1 else [0, 0, 0]
    out = slices.select("piece", "i", "tonic", "mode", "ms", "xs", "xa", "xt", "xb")
    for voice, turn in zip("atb", turns, strict=True):
        out = out.join(slices.select(((F.col("piece") + turn) % pieces).alias("piece"), "i", f"m{voice}"), ["piece", "i"])
    return out.select("piece", "i", "tonic", "mode", "ms", "ma", "mt", "mb", "xs", "xa", "xt", "xb")


def truth(spark: SparkSession, kind: str, pieces: int = 600, seed: int = 0) -> DataFrame:
    """(field, cell, together, apart, z, label): counts of the corpus and of its recombination, and whether the cell depends on coordination."""
    from polyvane.plans.scratch import write

    plan, original = Plan(), write(spark, generate(spark, kind, pieces, seed), f"synthetic-{kind}")
    tables = {"together": original, "apart": recombine(original, pieces, seed)}
    for p in tables:
        add_slices(plan, f"{p}_", p)
        add_counts(plan, f"{p}_", rest=False)
    parts = [f"SELECT '{f}' AS field, cell, {'n' if p == 'together' else '0'} AS x, {'0' if p == 'together' else 'n'} AS y FROM {{{p}_real_{f.lower()}}}" for p in tables for f in FIELDS]
    plan.add(labels=f"""SELECT field, cell, x AS together, y AS apart, z, CASE WHEN abs(z) > 3 AND NOT ratio BETWEEN 2 / 3.0 AND 1.5 THEN CASE WHEN x < y THEN 'avoid' ELSE 'prefer' END
        WHEN abs(z) < 2 OR ratio BETWEEN 0.8 AND 1.25 THEN 'indep' ELSE 'grey' END AS label FROM (SELECT *, (x - y) / sqrt(x + y + 1.0) AS z, (x + 1.0) / (y + 1.0) AS ratio FROM
        (SELECT field, cell, sum(x) AS x, sum(y) AS y FROM ({' UNION ALL '.join(parts)}) u GROUP BY field, cell) c) s""")
    return plan.frame("labels", tables, spark)


def truth_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all four kinds; the corpora are drawn, so no table is read."""
    out = None
    for kind in KINDS:
        rows = truth(spark, kind).select(F.lit(kind).alias("kind"), "field", "cell", "together", "apart", F.round("z", 6).alias("z"), "label")
        out = rows if out is None else out.unionByName(rows)
    return out
