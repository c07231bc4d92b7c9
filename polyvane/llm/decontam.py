"""Benchmark decontamination as a prefix-filtered set join on word shingles.

An item's windows (``window`` consecutive words; a shorter item is one window) are sets of 5-word shingles (windows of
fewer than 5 words: the whole sequence). Containment asks for every shingle, so one necessary prefix token is enough: the
window's rarest shingle, by document frequency over the whole corpus. Documents' shingles are joined with those tokens; a
match at offset o must leave room for the window's words before and after it (length and position bounds), and the words
themselves, as text, are then compared with the window's.

A window that many items hold is indexed once; which items hold it is a table of its own, met only by distinct (document,
window) pairs of confirmed occurrences. Token hashes only steer the join. Nothing is broadcast but a bit filter of at most
16 MB over the tokens, which lets the few shingles through that may be tokens; the join with the windows is Spark's, at
every size of the benchmark, and AQE splits it where one token is hot.

Defined cases: null or word-less texts have no words and are clean; null or word-less items have no windows; an item id
that repeats is one item with all windows; a null item id is the item ''; documents that repeat are reported row by row; empty
tables give empty or clean results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyvane.llm.filters import BitFilter
from polyvane.llm.textvec import ALNUM, Words, by_chunk, gather, gram_hash, lists
from polyvane.llm.work import Work

SHINGLE = 5
#: Digests of contaminated texts that are broadcast to the rows they remove; more meet them in a merge join.
MAX_BROADCAST = 500_000
HITS = "array<struct<token:bigint,at:int,lead:int,words:string>>"


def _joined(w: Words, first: np.ndarray, size: np.ndarray) -> pa.StringArray:
    """For each i the ``size[i]`` words from word ``first[i]`` on, lower-cased, with a space between."""
    begin = np.cumsum(size) - size
    word = np.repeat(first - begin, size) + np.arange(int(size.sum()))
    length = w.ends[word] - w.starts[word] + 1  # with the byte after the word, which becomes a space
    data = gather(np.append(w.buf, np.uint8(32)), w.starts[word], w.ends[word] + 1)
    stop = np.cumsum(length)
    data[stop - 1] = 32
    keep = np.ones(len(data), bool)
    keep[stop[begin + size - 1] - 1] = False
    offs = np.concatenate([[0], np.cumsum(np.add.reduceat(length, begin) - 1)]) if len(first) else np.zeros(1, np.int64)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data[keep]))


def benchmark_windows(benchmark: DataFrame, window: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, words, n, tokens): the item as string, a window's words, their number, the hashes of its shingles by offset."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column(1), ALNUM)
        count = np.where(w.n >= window, w.n - window + 1, np.minimum(w.n, 1))
        size = np.repeat(np.minimum(w.n, window), count)
        at = np.repeat(w.first[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        tokens = np.maximum(size - SHINGLE, 0) + 1
        begin = np.cumsum(tokens) - tokens
        start = np.repeat(at - begin, tokens) + np.arange(int(tokens.sum()))
        kind, value = np.repeat(np.minimum(size, SHINGLE), tokens), np.zeros(len(start), np.uint64)
        for k in np.unique(kind):
            value[kind == k] = gram_hash(w.h, start[kind == k], int(k))
        item = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), count)))
        return pa.RecordBatch.from_arrays([item, _joined(w, at, size), pa.array(size.astype(np.int32)), lists(value.view(np.int64), tokens)], ["item", "words", "n", "tokens"])

    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return items.mapInArrow(by_chunk("text", one), "item string, words string, n int, tokens array<long>").distinct()


def _frequencies(docs: DataFrame, keep, kinds: list[int]) -> DataFrame:
    """(token, n): in how many documents each shingle that the filter lets through occurs."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w, found, where = Words(batch.column(0), ALNUM), [], []
        for k in kinds:
            value, at, _ = w.grams(k)
            some = np.flatnonzero(keep.value(value))
            found.append(value[some])
            where.append(np.searchsorted(w.first, at[some], side="right"))
        value, doc = np.concatenate(found), np.concatenate(where)
        order = np.lexsort((doc, value))
        value, doc = value[order], doc[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        token, n = np.unique(value[new], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return docs.select("text").mapInArrow(by_chunk("text", count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _occurrences(docs: DataFrame, keep, kinds: list[int], window: int) -> DataFrame:
    """(id, n_words, hits): of each document the shingles that the filter lets through, with the words around that a window may take in."""
    key = docs.schema["id"].dataType.simpleString()

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, token, place, before, around = Words(batch.column(1), ALNUM), [], [], [], []
        owner = np.repeat(np.arange(batch.num_rows), w.n)
        for k in kinds:
            value, at, _ = w.grams(k)
            some = np.flatnonzero(keep.value(value))
            at, reach = at[some], max(window - SHINGLE, 0) if k == SHINGLE else 0
            left = np.maximum(at - reach, w.first[owner[at]]) if len(at) else at
            right = np.minimum(at + k + reach, w.first[owner[at] + 1]) if len(at) else at
            token.append(value[some])
            place.append(at)
            before.append(at - left)
            around.append(right - left)
        token, place, before, around = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (token, place, before, around))
        order = np.argsort(place, kind="stable")
        token, place, before, around = token[order], place[order], before[order], around[order]
        doc = owner[place]
        fields = [pa.array(token.astype(np.uint64).view(np.int64)), pa.array((place - w.first[doc]).astype(np.int32)), pa.array(before.astype(np.int32)), _joined(w, place - before, around)]
        hits = lists(pa.StructArray.from_arrays(fields, ["token", "at", "lead", "words"]), np.bincount(doc, minlength=batch.num_rows))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.n.astype(np.int64)), hits], ["id", "n_words", "hits"])

    return docs.mapInArrow(by_chunk("text", find), f"id {key}, n_words long, hits {HITS}")


def _search(docs: DataFrame, benchmark: DataFrame, window: int, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows(row, id, n_words, hits) of docs(id, text), found(row, start, n, wid): occurrences of windows, held(wid, item)."""
    work, spark = Work(docs.sparkSession, "decontam"), docs.sparkSession
    raw = work.table(benchmark_windows(benchmark, window, item_id, item_text), "raw")
    windows = raw.groupBy("words", "n").agg(F.first("tokens").alias("tokens"))
    windows = work.table(windows.withColumn("wid", F.monotonically_increasing_id()), "windows")
    held = raw.select("item", "words").join(windows.select("words", "wid"), "words").select("wid", "item")
    tokens = windows.select("wid", F.posexplode("tokens").alias("offset", "token"))
    stats = windows.agg(F.collect_set(F.least("n", F.lit(SHINGLE))).alias("kinds"), F.count("*").alias("n")).first()
    kinds, share = sorted(stats["kinds"]), spark.sparkContext.broadcast
    often = _frequencies(docs, share(BitFilter(tokens, "token", stats["n"] * max(1, window - SHINGLE + 1))), kinds) if kinds else spark.createDataFrame([], "token long, n long")
    # one token a window, the rarest; a window with a token that no document has can't occur
    ranked = tokens.join(often, "token", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("often"), "token", "offset")).alias("p")).where("p.often > 0")
    prefix = work.table(windows.select("wid", "words", "n").join(ranked.select("wid", "p.token", "p.offset"), "wid").withColumnsRenamed({"n": "size", "words": "wanted"}), "prefix")
    keep = share(BitFilter(prefix, "token", stats["n"]))
    rows = work.table(_occurrences(docs, keep, kinds, window).withColumn("row", F.monotonically_increasing_id()), "rows")
    hits = rows.where("size(hits) > 0").select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    met = hits.join(prefix, "token").where("lead >= offset and wanted = array_join(slice(split(words, ' '), lead - offset + 1, size), ' ')")
    found = work.table(met.select("row", (F.col("at") - F.col("offset")).alias("start"), F.col("size").alias("n"), "wid"), "found")
    return rows, found, held


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: the id, n_words, starts and ends (word spans that windows cover, merged), items (their ids, sorted)."""
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows, found, held = _search(docs, benchmark, window, item_id, item_text)
    own = Window.partitionBy("row").orderBy("start", "stop")
    spans = found.select("row", "start", (F.col("start") + F.col("n")).alias("stop")).distinct()
    spans = spans.withColumn("reach", F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("island", F.sum((F.coalesce(F.col("start") > F.col("reach"), F.lit(True))).cast("int")).over(own))
    merged = spans.groupBy("row", "island").agg(F.min("start").alias("a"), F.max("stop").alias("b")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    named = found.select("row", "wid").distinct().join(held, "wid").select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    none = F.array().cast("array<int>")
    some = rows.where("size(hits) > 0").select("row", "id", "n_words").join(merged, "row", "left").join(named, "row", "left").select(
        "id", "n_words", F.coalesce("spans.a", none).alias("starts"), F.coalesce("spans.b", none).alias("ends"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    clean = rows.where("size(hits) = 0").select("id", "n_words", none.alias("starts"), none.alias("ends"), F.array().cast("array<string>").alias("items"))
    return clean.unionByName(some).withColumnRenamed("id", doc_id)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id",
                        item_text: str = "text") -> DataFrame:
    """The clean documents with all their columns. A text is known by its SHA-256, so that rows need no id."""
    work, digest = Work(docs.sparkSession, "clean"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    rows, found, _ = _search(docs.select(digest.alias("id"), F.col(text).alias("text")), benchmark, window, item_id, item_text)
    gone = work.table(rows.where("size(hits) > 0").join(found.select("row").distinct(), "row", "left_semi").select(F.col("id").alias("_digest")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST else gone.hint("merge")
    own = F.sha2(F.coalesce(F.col(f"d.{text}"), F.lit("")), 256)
    return docs.alias("d").join(gone.alias("g"), own == F.col("g._digest"), "left_anti")
