"""Sources and sinks: note tables with a rejects table, corpora by place, splits, ratings and their sheets, nested JSON, reports, run stamps."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructType

NOTES = "piece long, voice string, onset double, offset double, midi int, tied boolean, fermata boolean"


def read_notes(spark: SparkSession, path: str, transpose: int = 0, until: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(notes, rejects): pieces with all four voices, transposed and cut at ``until``; the other pieces with what they lack."""
    notes = spark.read.schema(NOTES).parquet(path).where("offset > onset")
    voices = notes.groupBy("piece").agg(F.countDistinct(F.when(F.col("voice").isin("S", "A", "T", "B"), F.col("voice"))).alias("voices"))
    if until is not None:
        notes = notes.where(F.col("onset") < until).withColumn("offset", F.least("offset", F.lit(until)))
    notes = notes.withColumn("midi", F.col("midi") + transpose)
    return notes.join(voices.where("voices = 4"), "piece", "left_semi"), voices.where("voices < 4")


def merge_ties(notes: DataFrame) -> DataFrame:
    """Consecutive notes of one pitch that a tie joins become one: gaps and islands over (piece, voice)."""
    from pyspark.sql import Window

    own = Window.partitionBy("piece", "voice").orderBy("onset")
    joined = F.lag("tied").over(own) & (F.lag("midi").over(own) == F.col("midi")) & (F.abs(F.lag("offset").over(own) - F.col("onset")) < 1e-6)
    runs = notes.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(own))
    return runs.groupBy("piece", "voice", "_run").agg(F.min("onset").alias("onset"), F.max("offset").alias("offset"), F.first("midi").alias("midi"),
                                                       F.bool_or("tied").alias("tied"), F.bool_or("fermata").alias("fermata")).drop("_run")


def hash_split(pieces: DataFrame, sizes: dict[str, int], seed: int = 0, key: str = "piece") -> DataFrame:
    """(set_name, piece): disjoint sets of given sizes in hash order; the rest is left out."""
    from pyspark.sql import Window

    ranked = pieces.select(key).distinct().withColumn("_r", F.row_number().over(Window.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key))), key)))
    name, low = F.lit(None).cast("string"), 0
    for k, n in sizes.items():
        name = F.when((F.col("_r") > low) & (F.col("_r") <= low + n), k).otherwise(name)
        low += n
    return ranked.select(name.alias("set_name"), key).where("set_name is not null")


def stratified_split(rows: DataFrame, stratum: str, key: str, share: float, seed: int = 0) -> DataFrame:
    """Adds ``held``: a share of each stratum in hash order, one row at least on either side where it has two."""
    from pyspark.sql import Window

    own = Window.partitionBy(stratum)
    r = F.row_number().over(own.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key))), key))
    n = F.count("*").over(own)
    return rows.withColumn("held", r <= F.greatest(F.lit(1), F.least(n - 1, F.bround(n * share))))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """(rater, item, category) from CSV; a missing rating is 'cannot judge'."""
    rows = spark.read.csv(path, header=True, schema="rater string, item string, category string")
    return rows.withColumn("category", F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("cannot judge")))


def write_rules(discoveries: DataFrame, path: str) -> None:
    """Discoveries as nested JSON: the cell's conditions as a map, evidence as a struct."""
    pairs = F.split(F.replace("cell", F.lit("/to/"), F.lit("|")), "[|]")
    conditions = F.map_from_entries(F.transform(pairs, lambda x, k: F.struct(F.concat(k.cast("string"), F.lit(":"), F.split_part(x, F.lit("="), F.lit(1))), F.split_part(x, F.lit("="), F.lit(2)))))
    discoveries.select("field", "polarity", "cell", conditions.alias("condition")).write.json(path)


def corpus_slice(notes: DataFrame, limit: int, skip: int = 0, least: int = 8, step: float = 0.5) -> DataFrame:
    """Notes of the pieces from place ``skip`` on, ``limit`` of them, in order of piece, among those with four voices and at least so many slices."""
    pieces = notes.groupBy("piece").agg(F.countDistinct("voice").alias("voices"), F.max("offset").alias("end")).where((F.col("voices") == 4) & (F.col("end") >= least * step))
    return notes.join(F.broadcast(pieces.orderBy("piece").offset(skip).limit(limit).select("piece")), "piece", "left_semi")


def fresh_pieces(pieces: DataFrame, *used: DataFrame, above: int = 60, key: str = "piece") -> DataFrame:
    """Pieces in none of the used sets, beyond the first so many ids."""
    for u in used:
        pieces = pieces.join(u.select(key).distinct(), key, "left_anti")
    return pieces.where(F.col(key) > above)


def read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines, gzipped or not; lines that are no JSON are rejects."""
    lines = spark.read.text(path).select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("row"))
    return lines.where("row._bad is null").select("row.*").drop("_bad"), lines.where("row._bad is not null").select(F.col("value").alias("line"))


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities as nulls, in nested columns too."""
    def clean(c: Column, kind: DataType) -> Column:
        if isinstance(kind, (DoubleType, FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in kind]))
        return c

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def strip(df: DataFrame, *names: str) -> DataFrame:
    """Without the named columns, such as catalogues that a report doesn't need."""
    return df.drop(*names)


def write_sheets(statements: DataFrame, path: str, scale: tuple[str, ...] = ("valid", "reasonable", "depends on style", "invalid", "cannot judge")) -> None:
    """Rating sheets as CSV: item, polarity, statement, an empty rating and what it may be; one file, in order of the item."""
    statements.select("item", "polarity", "statement", F.lit(None).cast("string").alias("rating"), F.lit(" / ".join(scale)).alias("scale")).coalesce(1).sortWithinPartitions("item").write.csv(path, header=True)


def write_report(df: DataFrame, path: str, widths: dict[str, int] | None = None) -> None:
    """Fixed-width lines with a head line; numbers with four places."""
    widths = widths or {}
    wide = lambda f: widths.get(f.name, 14)
    cell = lambda f: F.rpad(F.coalesce(F.format_number(f.name, 4) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name).cast("string"), F.lit("-")), wide(f), " ")
    lines = df.select(F.rtrim(F.concat_ws(" ", *[cell(f) for f in df.schema])).alias("value"))
    head = df.sparkSession.createDataFrame([(" ".join(f.name.ljust(wide(f)) for f in df.schema).rstrip(),)], "value string")
    head.unionByName(lines).coalesce(1).write.text(path)


def stamped(df: DataFrame, folder: str, strict: bool = True) -> DataFrame:
    """With the commit of the code that made it; strict: refuses code with changes that aren't committed."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=True).stdout.strip()
    if strict and git("status", "--porcelain", "--untracked-files=no"):
        raise RuntimeError("the code has changes that aren't committed")
    return df.withColumn("commit", F.lit(git("rev-parse", "HEAD")))
