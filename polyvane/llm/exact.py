"""Exact deduplication, skew-safe and native.

Rows are combined three times on digest *and* full text: within each map task (partial aggregation), within a
salted digest group, and over the salt winners. No step trusts a digest alone.

``exact_dedup`` carries the winner's other columns along, so nothing is joined back. ``exact_flags`` has every row look up its group. What it
looks it up by, digest and tag, is proved by the combining to name one text; of two texts that share both, each gets a number,
and their rows are told apart by content.

Defined cases: a null text counts as empty; a null id never stays before another id, and a group of null ids only
has a null ``keep_id``; of rows that repeat both id and text one stays, in ``exact_dedup`` that whose other columns are largest in the order of
their names; an empty table gives an empty result; other columns are ignored, whatever their names and types (a map column is compared
as JSON).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from polyvane.llm.work import Work

#: Salt groups a digest is spread over before its winners meet.
SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def tag64(text: Column) -> Column:
    return F.xxhash64(text)


def _rows(docs: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column], salts: int) -> list[Column]:
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.col(doc_id).alias("id"), body.alias("body"), digest(body).alias("digest"), F.pmod(F.xxhash64(doc_id), F.lit(salts)).alias("salt")]


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS,
                 digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per distinct text: digest, body, keep_id (largest id), group_size."""
    rows = docs.select(*_rows(docs, doc_id, text, digest, salts))
    salted = rows.groupBy("digest", "salt", "body").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    return salted.groupBy("digest", "body").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_flags(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS,
                digest: Callable[[Column], Column] = sha256, tag: Callable[[Column], Column] = tag64) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, digest."""
    work, key = Work(docs.sparkSession, "exact"), ["digest", "tag", "variant"]
    body = F.coalesce(F.col(text), F.lit(""))
    whole = exact_groups(docs, doc_id, text, salts, digest).withColumn("tag", tag(F.col("body")))
    named = work.table(whole.groupBy("digest", "tag").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts")), "named")
    groups = named.where("texts = 1").select("digest", "tag", F.lit(0).cast("long").alias("variant"), "keep_id", "group_size")
    rows = docs.select(F.col(doc_id).alias("id"), digest(body).alias("digest"), tag(body).alias("tag"), F.lit(0).cast("long").alias("variant"))
    clash = named.where("texts > 1").select("digest", "tag")
    if not clash.isEmpty():
        # different texts under one digest and tag: numbered, and their rows meet them by content
        odd = work.table(whole.join(clash, ["digest", "tag"], "left_semi").withColumn("variant", F.monotonically_increasing_id() + 1), "odd")
        groups = groups.unionByName(odd.select(*key, "keep_id", "group_size"))
        mine = docs.select(F.col(doc_id).alias("id"), digest(body).alias("digest"), tag(body).alias("tag"), body.alias("body"))
        rows = rows.join(clash, ["digest", "tag"], "left_anti").unionByName(mine.join(odd.select("digest", "tag", "body", "variant"), ["digest", "tag", "body"]).drop("body"))
    rows = work.table(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    # as tables they meet by two plain exchanges, so that AQE can split a hot group's rows in the join
    top = rows.join(groups, key).where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy(*key, "keep_id", "group_size").agg(F.min("row").alias("stays"))
    top = work.table(top, "groups")
    return rows.join(top, key).select(F.col("id").alias(doc_id), "keep_id", "group_size", (F.col("row") == F.col("stays")).alias("kept"), "digest")


def _ordered(name: Column, kind: DataType) -> Column:
    """The column as something that has an order."""
    def has_map(k: DataType) -> bool:
        return isinstance(k, MapType) or isinstance(k, ArrayType) and has_map(k.elementType) or isinstance(k, StructType) and any(has_map(f.dataType) for f in k)

    return F.to_json(F.struct(name)) if has_map(kind) else name


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns: the winner of each text, carried through the three steps."""
    column, body = lambda f: F.col(f"`{f.name}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [f for f in docs.schema if f.name != text]
    ranked = sorted(kept, key=lambda f: (f.name != doc_id, f.name))
    gone = F.col(f"`{text}`").isNull().alias("gone")
    rank = F.struct(*[_ordered(column(f), f.dataType).alias(f"r{k}") for k, f in enumerate(ranked)], gone)
    held = F.struct(*[column(f).alias(f"c{k}") for k, f in enumerate(kept)], gone)
    rows = docs.select(rank.alias("rank"), held.alias("held"), body.alias("body"), sha256(body).alias("digest"), F.pmod(F.xxhash64(f"`{doc_id}`"), F.lit(salts)).alias("salt"))
    best = F.max_by("held", "rank").alias("held")
    salted = rows.groupBy("digest", "salt", "body").agg(best, F.max("rank").alias("rank"))
    whole = salted.groupBy("digest", "body").agg(best)
    back = {f.name: F.col(f"held.c{k}") for k, f in enumerate(kept)}
    return whole.select(*[back.get(f.name, F.when(~F.col("held.gone"), F.col("body"))).alias(f.name) for f in docs.schema])
