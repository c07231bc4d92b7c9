"""Mixing sources to target weights by Sainte-Lague apportionment, native.

Tokens are dealt to sources by highest quotients weight / (2 k + 1), then each source's tokens to its shards by the shards' sizes, down to the
token, so that quotas are integers and no target is missed. A shard lays its documents on a tape in seeded order and cuts it into blocks of equally many
tokens. Its quota is whole passes over the tape and a rest; the rest goes to blocks in seeded order, whole blocks while they fit and the first
tokens of the one after. A document gives what lies in the blocks that were chosen.

No quota is cut: a source at its cap gives every document ``most`` times, and the words of any other source are no more
than ``most`` times its size. At just that many words each shard's quota is ``most`` times its own size, and quotas only
grow with the number of words dealt, so none is ever above that.

Defined cases: a null text has size 0; null is a source of its own, last in order; a source without words has target 0;
rows with equal id, source and size are interchangeable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyvane.llm.work import Work

WEIGHTS = (3, 1, 2)
#: Tokens of a block at most, and how many blocks a shard of the smallest source should be dealt at least.
BLOCK, BLOCKS = 4096, 8


def sainte_lague(rows: DataFrame, group: list[str], key: list[Column], weight: str, seats: str) -> DataFrame:
    """Adds long ``quota``: the seats of each row of a group by highest quotients, ties by key.

    With n rows of positive weight and N seats, the final divisor differs from total / N by a factor within
    1 +- n / 2N, so each row's seats are known up to an interval; the intervals hold 5 n seats at most in all. Only
    those few contested seats are ranked, however many seats there are.
    """
    own = Window.partitionBy(*group)
    share = F.coalesce(F.try_divide(F.col(weight), F.sum(weight).over(own)), F.lit(0.0))
    ahead = rows.withColumn("_n", F.count(F.when(F.col(weight) > 0, 1)).over(own)).withColumn("_share", share)
    ahead = ahead.withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_share") * F.col(seats) - F.col("_share") * F.col("_n") / 2 - 1)).cast("long"))
    ahead = ahead.withColumn("_high", F.ceil(F.col("_share") * F.col(seats) + F.col("_share") * F.col("_n") / 2 + 1).cast("long"))
    ahead = ahead.withColumn("_left", F.col(seats) - F.sum("_low").over(own)).withColumn("_key", F.struct(*key))
    seat = F.when(F.col(weight) > 0, F.sequence("_low", "_high")).otherwise(F.array(F.lit(0).cast("long")))
    tried = ahead.withColumn("_k", F.explode(seat))
    order = Window.partitionBy(*group).orderBy((F.col(weight) / (2 * F.col("_k") + 1)).desc(), "_key", "_k")
    won = tried.withColumn("_won", ((F.row_number().over(order) <= F.col("_left")) & (F.col(weight) > 0)).cast("long"))
    plain = rows.columns
    return won.groupBy(*plain, "_low").agg(F.sum("_won").alias("_won")).select(
        *plain, F.when(F.col(weight) > 0, F.col("_low") + F.col("_won")).otherwise(0).cast("long").alias("quota"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of ``sizes(source, source_size)``; one row per source, so its windows are small.

    Targets are w * level, stopped at ``most`` times the size; the level solves the repeated resharing in closed form:
    in order of cap / weight, the first source that the level of all later ones doesn't reach ends the capped ones.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    every = Window.partitionBy(F.lit(1))
    rows = sizes.withColumn("_r", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_r") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("_cap", most * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_r").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0.0)))
    rows = rows.withColumn("_w_before", F.coalesce(F.sum("_w").over(by_ratio), F.lit(0)))
    level = (share * F.sum("source_size").over(every) - F.col("_before")) / (F.sum("_w").over(every) - F.col("_w_before"))
    rows = rows.withColumn("_level", level)
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct((F.col("_cap") / F.col("_w")).alias("c"), "_r", "_level"))
    rows = rows.withColumn("_at", F.min(fits).over(every)["_level"])
    return rows.select("source", "source_size", F.coalesce(F.least("_cap", F.col("_at") * F.col("_w")), F.col("_cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 17,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: the id, size, source_size, target, taken, source, shard.

    What is taken from a source is its target to within a word or two. Shards: one per 50,000 documents, within 64 to
    16,384, so that a source with a third of all rows is many windows. Blocks: as many tokens as give a shard of the smallest
    target some ``BLOCKS`` of them, ``BLOCK`` at most.
    """
    work = Work(docs.sparkSession, "mix")
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    sized = work.table(docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("source"), words.alias("size"), order.alias("_order")), "sized")
    shards = max(64, min(16384, -(-sized.count() // 50000)))
    sized = sized.withColumn("shard", (F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % shards).cast("int"))

    cells = work.table(sized.groupBy("source", "shard").agg(F.sum("size").alias("cell")), "cells")
    sources = source_targets(cells.groupBy("source").agg(F.sum("cell").alias("source_size")), weights, share, float(most))
    every = Window.partitionBy(F.lit(1))
    top = most * F.col("source_size")
    full = F.col("target") >= top
    sources = sources.withColumn("_open", F.when(full, 0.0).otherwise(F.col("target"))).withColumn("_all", F.lit(1))
    sources = sources.withColumn("_words", F.round(F.sum("target").over(every)).cast("long") - F.sum(F.when(full, top).otherwise(0)).over(every))
    sources = sainte_lague(sources, ["_all"], [F.col("source").isNull(), F.col("source")], "_open", "_words")
    sources = sources.withColumn("source_words", F.when(full, top).otherwise(F.least("quota", top)))
    sources = work.table(sources.select("source", "source_size", "target", "source_words"), "sources")

    left = cells.alias("c").join(sources.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select(
        "c.source", "shard", "cell", "source_size", "target", "source_words")
    quotas = sainte_lague(left, ["source"], [F.col("shard")], "cell", "source_words").withColumnRenamed("quota", "_words")
    rounds = F.when(F.col("cell") > 0, F.least(F.lit(most), F.floor(F.col("_words") / F.col("cell")))).otherwise(0).cast("long")
    rest = F.when(F.col("_rounds") < most, F.col("_words") - F.col("_rounds") * F.col("cell")).otherwise(F.lit(0))
    quotas = quotas.withColumn("_rounds", rounds).withColumn("_rest", rest.cast("long"))
    quotas = work.table(quotas.select("source", "shard", "cell", "source_size", "target", "_rounds", "_rest"), "quotas")

    least = sources.agg(F.min(F.when(F.col("target") > 0, F.col("target")))).first()[0]
    block = max(1, min(BLOCK, int((least or 0) // (BLOCKS * shards))))
    here = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.shard") == F.col(f"{b}.shard"))
    tape = Window.partitionBy("source", "shard").orderBy("_order", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = work.table(sized.withColumn("_end", F.sum("size").over(tape)).drop("_order"), "laid")
    chosen = chosen_blocks(quotas, block, seed)
    spread = laid.where("size > 0").withColumn("_block", F.explode(F.sequence(F.floor((F.col("_end") - F.col("size")) / block), F.floor((F.col("_end") - 1) / block))))
    got = F.least("_end", F.col("_block") * block + F.col("_some")) - F.greatest(F.col("_end") - F.col("size"), F.col("_block") * block)
    partly = spread.alias("d").join(chosen.alias("b"), here("d", "b") & (F.col("d._block") == F.col("b._block"))).select(
        "d.source", "d.shard", "_end", "size", F.col("d._block"), "_some").withColumn("_got", got).where("_got > 0")
    partly = partly.groupBy("source", "shard", "_end").agg(F.sum("_got").alias("_got"))
    whole = laid.alias("d").join(quotas.alias("q"), here("d", "q")).select("d.*", "source_size", "target", "_rounds")
    return whole.alias("d").join(partly.alias("p"), here("d", "p") & (F.col("d._end") == F.col("p._end")) & (F.col("d.size") > 0), "left").select(
        F.col("_id").alias(doc_id), "size", "source_size", "target", (F.col("_rounds") * F.col("size") + F.coalesce("_got", F.lit(0))).cast("long").alias("taken"), "d.source", "d.shard")


def chosen_blocks(quotas: DataFrame, block: int, seed: int) -> DataFrame:
    """source, shard, _block, _some: how many tokens of each block are taken beyond whole passes; blocks of which none is are left out."""
    blocks = quotas.where("_rest > 0").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("cell") - 1) / block))))
    size = F.least(F.lit(block), F.col("cell") - F.col("_block") * block)
    drawn = F.md5(F.concat_ws(":", F.lit(seed), "shard", "_block"))
    order = Window.partitionBy("source", "shard").orderBy("_drawn", "_block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("_size", size).withColumn("_drawn", drawn).withColumn("_upto", F.sum("_size").over(order))
    some = F.least(F.col("_size"), F.col("_rest") - (F.col("_upto") - F.col("_size")))
    return blocks.withColumn("_some", some).where("_some > 0").select("source", "shard", "_block", "_some")
