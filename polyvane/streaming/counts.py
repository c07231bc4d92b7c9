"""Additive counts over a stream of slices (beyond the reference, which has no streams).

Field counts are sums over pieces, so a stream of complete pieces can be counted as it arrives: each micro-batch is counted by the same
plan as a table would be, and the running totals are one grouped sum. State grows with the vocabulary, not with the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvane.functions import cells as C
from polyvane.operators.polyphony import COMPLETE, M


def sonority_cells(slices: DataFrame) -> DataFrame:
    """(field, cell) of the fields that read one slice: H, S."""
    whole = slices.where(COMPLETE)
    gaps = [F.expr(C.h_cell(f"'{a}{b}'", f"(m{a.lower()} - m{b.lower()})")) for a, b, role in C.PAIRS if role == "adjacent"]
    h = whole.select(F.lit("H").alias("field"), F.explode(F.array(*gaps)).alias("cell"))
    return h.unionByName(whole.select(F.lit("S").alias("field"), F.expr(C.s_cell(M, "tonic")).alias("cell")))


def running_counts(slices: DataFrame) -> DataFrame:
    """(field, cell, n) of a stream or a table of slices; run it with outputMode 'complete' or 'update'."""
    return sonority_cells(slices).groupBy("field", "cell").agg(F.count("*").alias("n"))
