"""Command line: list, run, report, sql and audit over a folder of tables.

    python -m polyvane list
    python -m polyvane run NAME FOLDER [--out PATH] [--json] [--stamp]
    python -m polyvane report NAME FOLDER --out PATH   (goes to PATH/report/NAME)
    python -m polyvane sql NAME
    python -m polyvane audit
"""

from __future__ import annotations

import argparse
import os

#: Studies: queries that are reported together.
STUDIES = {
    "cost": ("slices", "real_counts", "null_counts"), "cells": ("real_counts", "residuals"), "attribution": ("attribution", "admission"), "pvalues": ("empirical_bh", "nominal_tails", "swapped_rules"),
    "tests": ("paired_tests", "practical_bands", "fragility", "atom_interval"), "vocabulary": ("vocabulary_auc",), "calibration": ("calibration", "soft_calibration", "soft_chosen"), "expert": ("statement_merge", "alpha", "kappa", "wilson"),
    "holdout": ("holdout_residuals", "holdout_completeness", "confirmed"), "checker": ("rule_export", "rule_positions", "rule_totals", "flags_per_100"), "ablation": ("nopair_completeness", "pooled_atom_auc", "swapped_atom_auc", "noise_completeness"),
    "ladder": ("null_ladder",), "structure": ("structure_violations", "degree_marginals", "reconstruction_gate"), "halves": ("method_gap_ci",),
}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="polyvane", description=__doc__.split("\n")[0])
    does = parser.add_subparsers(dest="does", required=True)
    does.add_parser("list")
    does.add_parser("audit")
    does.add_parser("sql").add_argument("name")
    for x in ("run", "report"):
        sub = does.add_parser(x)
        sub.add_argument("name", help="a query or a study")
        sub.add_argument("folder")
        sub.add_argument("--out")
        sub.add_argument("--json", action="store_true")
        sub.add_argument("--stamp", action="store_true")
    asked = parser.parse_args(args)

    from polyvane.plans import audit, queries

    if asked.does == "list":
        print("\n".join([*sorted(queries.queries()), *(f"{k}: {', '.join(v)}" for k, v in STUDIES.items())]))
        return 0
    if asked.does == "sql":
        print(queries.oracle_sql()[asked.name])
        return 0
    if asked.does == "audit":
        found = audit.leaks(queries.plan())
        print("\n".join(f"{a} reads {b}" for a, b in found) or "no leaks")
        return bool(found)

    from pyspark.sql import SparkSession

    from polyvane.sources.tables import clean_nan, stamped, write_report

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name in STUDIES.get(asked.name, (asked.name,)):
        df = clean_nan(queries.queries()[name](spark, asked.folder))
        if asked.stamp:
            df = stamped(df, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        if asked.does == "report":
            write_report(df, f"{asked.out}/report/{name}")
        elif not asked.out:
            df.show(50, truncate=False)
        elif asked.json:
            df.write.json(f"{asked.out}/{name}")
        else:
            df.write.parquet(f"{asked.out}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
