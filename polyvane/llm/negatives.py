"""Hard-negative mining: exact integer scores by blocked float64 products, in two passes over the candidates.

Anchors are taken in batches of at most ANCHORS rows and ANCHOR_BYTES bytes; a batch is broadcast, and every task multiplies its blocks of candidates with blocks of
the batch. Products of whole numbers are exact in float64 while |a| * |b| stays below 2 ** 53, in any order of summation; blocks beyond that are
multiplied in Python integers. The first pass keeps, by task, each anchor's five best positives; these merge by rank. The second pass knows each
positive's window of scores and keeps, by task, the ten best different-label rows inside it. What a task holds is bounded by the batch; what it
emits is at most positives * negatives rows an anchor, however frequent a label is, and no pair outside these lists leaves a task.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part; shorter vectors count as filled up with
zeros; rows that repeat an id are rows of their own (each can be an anchor, and the others its positives); ties go by the smaller id; an anchor
without positives, or a positive without rows in its window, gives no rows; an empty table gives an empty result; components beyond 2 ** 53 count
as 2 ** 53, and scores beyond a long as the largest or smallest long; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyvane.llm.vectors import chunks, clean, matrix
from polyvane.llm.work import Work

#: Anchors of one broadcast, and its bytes; anchors of one product.
ANCHORS, ANCHOR_BYTES, BLOCK = 16384, 16 << 20, 512
LOW, HIGH = -(1 << 63), (1 << 63) - 1
EXACT = 2.0 ** 53


class Top:
    """The k best (score, id, row) of each of n lists: higher scores first, then smaller ids, then smaller rows."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.row = np.full((n, k), LOW), np.full((n, k), HIGH), np.full((n, k), -1)

    @property
    def least(self) -> np.ndarray:
        """Score of the last of each list: what scores less can't enter."""
        return self.score[:, -1]

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(at):
            return
        touched = np.unique(at)
        lists = np.concatenate([np.repeat(touched, self.k), at])
        score = np.concatenate([self.score[touched].reshape(-1), score])
        ids, rows = np.concatenate([self.id[touched].reshape(-1), ids]), np.concatenate([self.row[touched].reshape(-1), rows])
        free = rows < 0
        order = np.lexsort((rows, ids, ~score, free, lists))
        lists = lists[order]
        start = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
        kept = order[np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) < self.k]
        shape = (len(touched), self.k)
        self.score[touched], self.id[touched], self.row[touched] = score[kept].reshape(shape), ids[kept].reshape(shape), rows[kept].reshape(shape)

    def rows(self) -> tuple[np.ndarray, ...]:
        """List numbers, scores, ids and rows of all that is held."""
        at, place = np.nonzero(self.row >= 0)
        return at, self.score[at, place], self.id[at, place], self.row[at, place]


def products(x: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows: float64 where that is exact, else int64."""
    longest = [np.sqrt((m * m).sum(axis=1).max(initial=0)) for m in (x, anchors)]
    if longest[0] * longest[1] < EXACT / 2:
        return x @ anchors.T
    out = np.empty((len(x), len(anchors)), np.int64)
    columns = [[int(v) for v in row] for row in anchors.tolist()]
    for i, row in enumerate(x.tolist()):
        row = [int(v) for v in row]
        out[i] = [min(HIGH, max(LOW + 1, sum(p * q for p, q in zip(row, column, strict=True)))) for column in columns]
    return out


def _scan(held: DataFrame, batch, n_lists: int, k: int, visit: Callable) -> DataFrame:
    """Every task's best k of each list, as (list, score, id, row). ``visit(scores, labels, a, top, add)`` looks at one block of candidates and
    the anchors from number a on, and calls add(candidate, list, score) for what may enter."""

    def run(parts):
        top, (x, label, row) = Top(n_lists, k), batch.value
        for part in parts:
            for some in chunks(part, "x"):
                ids, labels, rows = (some.column(c).to_numpy() for c in range(3))
                mine = matrix(some.column(3))
                width = max(mine.shape[1], x.shape[1])
                wide = [np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (mine, x)]
                for a in range(0, len(x), BLOCK):
                    score = products(wide[0], wide[1][a:a + BLOCK])

                    def add(r, at, value, ids=ids, rows=rows):
                        top.add(at, value.astype(np.int64), ids[r], rows[r])

                    visit(score, rows[:, None] == row[None, a:a + BLOCK], labels[:, None] == label[None, a:a + BLOCK], a, top, add)
        at, value, ids, rows = top.rows()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(value), pa.array(ids), pa.array(rows)], ["list", "score", "id", "row"])

    return held.select("id", "label", "row", "x").mapInArrow(run, "list long, score long, id long, row long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each list over all tasks, with their rank; Spark limits each task's share before it shuffles."""
    order = Window.partitionBy("list").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column | str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), vec_id: str = "vec_id",
                   embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): of each anchor's best positives the best rows of other labels whose
    score is at least window[0] and at most window[1] hundredths of the positive's. ``anchors`` is a condition on vec_id and label."""
    spark = vectors.sparkSession
    work = Work(spark, "negatives")
    condition = F.expr(anchors) if isinstance(anchors, str) else anchors
    source = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(condition, F.lit(False)).alias("anchor"), F.col(embedding).alias("embedding"))
    # written once, so that row numbers stay
    held = work.table(clean(source, "embedding").withColumn("row", F.monotonically_increasing_id()), "vectors")
    count, size = held.where("anchor").agg(F.count("*"), F.coalesce(F.max(F.length("x")), F.lit(0))).first()
    batches = max(1, -(-count // ANCHORS), -(-count * size // ANCHOR_BYTES))
    low, high = window
    out = []
    for b in range(batches if count else 0):
        batch = held.where(F.col("anchor") & (F.pmod(F.xxhash64("row"), F.lit(batches)) == b)).select("id", "label", "row", "x").toArrow().combine_chunks()
        if not batch.num_rows:
            continue
        batch = batch.to_batches()[0]
        anchor = batch.column(0).to_numpy()
        sent = spark.sparkContext.broadcast((matrix(batch.column(3)), batch.column(1).to_numpy(), batch.column(2).to_numpy()))

        def positive(score, same_row, same_label, a, top, add):
            r, c = np.nonzero(same_label & ~same_row & (score >= top.least[a:a + score.shape[1]].astype(score.dtype)))
            add(r, a + c, score[r, c])

        first = _best(_scan(held, sent, len(anchor), positives, positive), positives).select("list", "score", "id", "row").toArrow()
        # at most ``positives`` rows for each anchor of the batch
        number, value, ids = (first[c].to_numpy() for c in ("list", "score", "id"))
        order = np.argsort(number, kind="stable")
        number, value, ids = number[order], value[order], ids[order]
        slot = number * positives + np.arange(len(number)) - np.searchsorted(number, number)
        bounds = np.full((2, len(anchor) * positives), HIGH)
        bounds[1] = LOW
        # more than a long holds is no score
        bounds[0][slot] = [max(LOW + 1, -(-low * int(v) // 100)) for v in value]
        bounds[1][slot] = [min(HIGH, high * int(v) // 100) for v in value]
        limits = spark.sparkContext.broadcast(bounds)

        def negative(score, same_row, same_label, a, top, add):
            for p in range(positives):
                at = np.arange(a, a + score.shape[1]) * positives + p
                least, most = np.maximum(limits.value[0][at], top.least[at]).astype(score.dtype), limits.value[1][at].astype(score.dtype)
                r, c = np.nonzero(~same_label & (score >= least) & (score <= most))
                add(r, at[c], score[r, c])

        last = _best(_scan(held, sent, len(anchor) * positives, negatives, negative), negatives)
        named = spark.createDataFrame(pa.table({"list": slot, "anchor_id": anchor[number], "positive_id": ids, "positive_score": value}))
        last = last.join(F.broadcast(named), "list").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        work.table(last, f"found/batch={b}")
        out.append(f"{work.path}/found/batch={b}")
        sent.unpersist()
        limits.unpersist()
    work.drop("vectors")
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(kinds).parquet(*out) if out else spark.createDataFrame([], kinds)
