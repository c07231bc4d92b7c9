"""Monte-Carlo truth: what a piece holds of each cell on average when its voices come from four different pieces of one corpus.

Pieces of a synthetic corpus share their onsets, so voices of different pieces fit together. Combinations are numbered and name their donors by
hash; a combination is a join of four pieces on the slice. Means and errors come from sums and sums of squares over combinations, those
without the cell included, which merge over tasks like any count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyvane.functions.predicates import predicates
from polyvane.operators.counts import add_counts
from polyvane.operators.polyphony import add_slices
from polyvane.operators.synthetic import FIELDS, generate
from polyvane.plans.dialect import Plan
from polyvane.plans.scratch import write

POOL, COMBINATIONS = 10_000, 10_000


def donors(spark: SparkSession, pool: int, combinations: int, seed: int = 0) -> DataFrame:
    """(piece, S, A, T, B): four different donors a combination: a hashed first one, and three hashed steps round the pool that never come full circle."""
    step = lambda v: 1 + F.pmod(F.xxhash64(F.lit(seed), F.lit(v), "piece"), F.lit((pool - 1) // 3))
    rows = spark.range(combinations).withColumnRenamed("id", "piece").withColumn("S", F.pmod(F.xxhash64(F.lit(seed), F.lit("S"), "piece"), F.lit(pool)))
    for last, v in zip("SAT", "ATB", strict=True):
        rows = rows.withColumn(v, (F.col(last) + step(v)) % pool)
    return rows


def combine(slices: DataFrame, chosen: DataFrame) -> DataFrame:
    """Slices of the combinations: each voice from its donor, onset by onset; donors must have the same onsets."""
    out = chosen.join(slices.select(F.col("piece").alias("S"), "i", "tonic", "mode", "ms", "xs", "xa", "xt", "xb"), "S")
    for v in "ATB":
        out = out.join(slices.select(F.col("piece").alias(v), "i", f"m{v.lower()}"), [v, "i"])
    return out.select("piece", "i", "tonic", "mode", "ms", "ma", "mt", "mb", "xs", "xa", "xt", "xb")


def same_structure(slices: DataFrame) -> DataFrame:
    """Pieces whose onsets, key or attacks differ from those of the others: must be empty before they are combined."""
    prints = slices.groupBy("piece").agg(F.sum(F.xxhash64("i", "tonic", "mode", "xs", "xa", "xt", "xb").cast("decimal(38,0)")).alias("p"))
    return prints.crossJoin(prints.agg(F.max_by("p", "piece").alias("of_last"))).where("p <> of_last").select("piece")


def per_piece(slices: DataFrame, pieces: int, name: str) -> DataFrame:
    """(field, cell, mean, sd, se) of the count a piece, over so many pieces."""
    plan, spark = Plan(), slices.sparkSession
    add_slices(plan, "m_", name)
    add_counts(plan, "m_", rest=False)
    plan.add(counted=" UNION ALL ".join(f"SELECT '{f}' AS field, piece, cell, count(*) AS n FROM {{m_units_{f.lower()}}} GROUP BY piece, cell" for f in FIELDS),
             means=f"""SELECT field, cell, s / {pieces} AS mean, sqrt(greatest(q - s * s / {pieces}, 0) / {pieces - 1}) AS sd, sqrt(greatest(q - s * s / {pieces}, 0) / {pieces - 1} / {pieces}) AS se FROM
                (SELECT field, cell, @DOUBLE(sum(n)) AS s, @DOUBLE(sum(n * n)) AS q FROM {{counted}} GROUP BY field, cell) c""")
    return plan.frame("means", {name: slices}, spark)


def monte_carlo(spark: SparkSession, kind: str, pool: int = POOL, combinations: int = COMBINATIONS, seed: int = 0) -> DataFrame:
    """(field, cell, atoms, mean, sd, se, real): of the combinations, and for comparison the mean of the pool's own pieces."""
    slices = write(spark, generate(spark, kind, pool, seed), f"pool-{kind}")
    if (odd := same_structure(slices).first()) is not None:
        raise ValueError(f"piece {odd.piece} can't be combined with the others")
    apart = per_piece(combine(slices, donors(spark, pool, combinations, seed)), combinations, "apart")
    together = per_piece(slices, pool, "together").select("field", "cell", F.col("mean").alias("real"))
    rows = apart.join(together, ["field", "cell"], "full").fillna(0.0, ["mean", "sd", "se", "real"])
    atoms = F.concat_ws(",", *[F.when((F.col("field") == f) & F.expr(where), a) for a, f, _, where in predicates() if f in FIELDS])
    return rows.select("field", "cell", atoms.alias("atoms"), *[F.round(c, 6).alias(c) for c in ("mean", "sd", "se", "real")])


def monte_carlo_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of kind S3; the corpus is drawn, so no table is read."""
    return monte_carlo(spark, "S3")
