"""What fitting may not read: the reference predicates and anything made from them, and held-out pieces.

The first is a matter of which relations refer to which. The second is tried: evaluation inputs are changed, and what was fitted must come out the same,
row for row, by fingerprints that don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyvane.operators.polyphony import split_of
from polyvane.plans.dialect import Plan, expand

#: Relations made with the reference predicates, and those that fit, count or select.
EVALUATION = ("hits", "geometry", "covered", "scored")
FITTING = ("pitch_cat", "dp_cat", "cells_real", "cells_null", "residuals", "discover_hard", "discover_full", "calibration", "soft_calibration", "attribution", "replay_cells", "replay_residuals",
           "empirical", "uniform_residuals", "independent_residuals", "circular_residuals", "recon_steps", "recon_starts", "noise_residuals")


def reads(plan: Plan, name: str) -> set[str]:
    """All relations and tables that a relation is made from."""
    seen: set[str] = set()
    todo = [name]
    while todo:
        at = todo.pop()
        for x in plan.inputs(plan.nodes.get(at, "")) + plan.inputs(plan.forms.get(at, "")):
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


def leaks(plan: Plan) -> list[tuple[str, str]]:
    """(fitting relation, evaluation relation it reads): must be empty."""
    return [(f, e) for f in FITTING for e in sorted(reads(plan, f)) if e.split("_", 1)[-1] in EVALUATION or e in EVALUATION]


def fingerprint(df: DataFrame, digits: int = 9) -> tuple[int, int]:
    """Number of rows and sum of their hashes, each row's columns by name; doubles to so many digits, for sums of fractions depend on their order."""
    columns = [F.round(c, digits) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)]
    row = df.select(F.xxhash64(*columns).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)"))).first()
    return row[0], int(row[1])


def disturb_held_out(events: DataFrame, piece: str = "user_id") -> DataFrame:
    """Events whose held-out pieces have other values, and a quarter fewer rows; those of training pieces stay."""
    held = F.expr(expand(split_of(piece), False)) == "hold"
    return events.where(~held | (F.pmod(F.xxhash64("event_id"), F.lit(4)) > 0)).withColumn("value", F.when(held, F.col("value") * 3 + 7).otherwise(F.col("value")))


#: What is fitted on training pieces: catalogues, counts and residuals of a field, states and steps of the voices' models.
FITTED = ("pitch_cat", "dp_cat", "real_v", "v_residuals", "recon_starts", "recon_steps", "recon_ranges")


def perturbed(spark: SparkSession, plan: Plan, tables: dict[str, DataFrame], changed: dict[str, DataFrame], names: Iterable[str] = FITTED) -> DataFrame:
    """(relation, n, same): fitted relations over the tables and over changed ones, in their number of rows and whether nothing in them differs."""
    before, after = ({}, {})
    out = []
    for name in names:
        a, b = fingerprint(plan.frame(name, tables, spark, before)), fingerprint(plan.frame(name, changed, spark, after))
        out.append((name, a[0], int(a == b)))
    return spark.createDataFrame(out, "relation string, n long, same int")
