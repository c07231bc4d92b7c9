r"""Line deduplication over a sharded minimal perfect hash.

Pass one counts, per distinct line key (128-bit hash), the documents that hold it and the largest of their ids. Keys held by
enough documents are dealt to shards; each shard builds a minimal perfect hash (levels of bits, a key taking the first level
where it is alone) that indexes compact arrays: fingerprint, document count, last id. In pass two documents probe the
arrays with their lines' hashes.

Up to ``max_entries`` frequent lines (counted first) all shards are broadcast, and documents probe them where they are. Beyond that the
shards stay files in the shared folder: 44 bytes of each long line are dealt to tasks by shard, in parts of equal size however hot a
line or shard is; a task reads the shards of its part, one at a time, and what has to go returns to the documents. Texts are read twice,
whatever the number of shards.

Defined cases: null or empty texts are one empty line; each row counts as a document of its own, and a null id ranks below
all others; lines of a document that repeat count once for it, and all of them go or stay; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvane.llm.textvec import NOT_SPACE, U, by_chunk, lines, lists, lower, mix, span_hash, text_bytes
from polyvane.llm.work import Work, arrow_fs

#: Frequent lines in one broadcast block (21 bytes each) and in one shard.
MAX_ENTRIES, SHARD = 3_000_000, 200_000
LEAST = -(1 << 63)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: about 3 bits of the levels a key, and a few left-over keys."""

    def __init__(self, keys: np.ndarray, gamma: float = 2.0, most: int = 40):
        self.levels, self.n = [], 0
        for level in range(most):
            if not len(keys):
                break
            size = max(64, int(len(keys) * gamma))
            place = self._place(keys, level, size)
            alone = np.bincount(place, minlength=size) == 1
            bits = np.zeros(-(-size // 64) * 64, bool)
            bits[:size] = alone
            words = np.packbits(bits, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((size, words, np.cumsum(ones) - ones + self.n))
            self.n += int(ones.sum())
            keys = keys[~alone[place]]
        self.rest = np.sort(keys)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % U(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """An index below n + len(rest) for every key; right only for keys that were put in."""
        out, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level, (size, words, rank) in enumerate(self.levels):
            place = self._place(keys[live], level, size)
            word, bit = words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & U(1) == 1
            out[live[hit]] = rank[place[hit] >> 6] + np.bitwise_count(word[hit] & ((U(1) << bit[hit]) - U(1)))
            live = live[~hit]
        out[live] = self.n + np.minimum(np.searchsorted(self.rest, keys[live]), max(len(self.rest) - 1, 0))
        return np.minimum(out, self.n + len(self.rest) - 1)


def _keys(buf: np.ndarray, offs: np.ndarray, least_chars: int):
    """Line borders, lines by text, and of the lines whose key is long enough: their rows and two hashes."""
    start, end, count = lines(buf, offs)
    solid = np.flatnonzero(NOT_SPACE[buf])
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = np.flatnonzero(j > i)
    a, b = solid[i[some]], solid[j[some] - 1] + 1
    cont = np.concatenate([[0], np.cumsum((buf & 0xC0) == 0x80)])
    long = (b - a) - (cont[b] - cont[a]) >= least_chars
    some, a, b = some[long], a[long], b[long]
    low = lower(buf)
    return start, end, count, some, span_hash(low, a, b), span_hash(low, a, b, 1)


def frequent_lines(docs: DataFrame, work: Work, least_chars: int, least_docs: int) -> DataFrame:
    """(h1, h2, docs, last) of the line keys held by enough documents; counts combine before the shuffle."""

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = text_bytes(batch.column(1))
        _, _, count, row, h1, h2 = _keys(buf, offs, least_chars)
        doc = np.repeat(np.arange(batch.num_rows), count)[row]
        order = np.lexsort((h2, h1, doc))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(doc[order]) != 0) | (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        order = order[new]
        return pa.RecordBatch.from_arrays([pa.array(h1[order].view(np.int64)), pa.array(h2[order].view(np.int64)),
                                           pc.fill_null(batch.column(0), LEAST).take(pa.array(doc[order]))], ["h1", "h2", "id"])

    held = docs.mapInArrow(by_chunk("text", emit), "h1 long, h2 long, id long")
    counts = held.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("id").alias("last"))
    return work.table(counts.where(F.col("docs") >= least_docs), "lines")


def build_shards(frequent: DataFrame, shards: int) -> DataFrame:
    """(shard, body): each shard's perfect hash with its arrays, built where the shard's lines are."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = rows["h1"].to_numpy().view(np.uint64), rows["h2"].to_numpy().view(np.uint64)
        _, first = np.unique(h1, return_index=True)
        twin = np.setdiff1d(np.arange(len(h1)), first)  # keys that share h1 with another are listed apart
        index = PerfectHash(h1[first])
        place = index(h1[first])
        order = np.empty(len(first), np.int64)
        order[place] = first
        take = lambda c, t: rows[c].to_numpy()[order].astype(t)
        body = (index, h2[order], take("docs", np.uint32), take("last", np.int64), [tuple(rows[["h1", "h2", "docs", "last"]].to_numpy()[k]) for k in twin])
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "body": [pickle.dumps(body)]})

    return frequent.withColumn("shard", F.pmod(F.shiftrightunsigned("h1", 32), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, body binary")


def probe(parts: dict[int, tuple], shards: int, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document count and last id of each line; 0 for lines not in the shards at hand."""
    docs, last = np.zeros(len(h1), np.int64), np.full(len(h1), LEAST, np.int64)
    own = ((h1 >> U(32)) % U(shards)).astype(np.int64)
    for shard, (index, mark, n, top, twins) in parts.items():
        rows = np.arange(len(h1)) if shards == 1 else np.flatnonzero(own == shard)
        if len(rows):
            place = index(h1[rows])
            same = mark[place] == h2[rows]
            docs[rows[same]], last[rows[same]] = n[place[same]], top[place[same]]
            for a, b, count, most in twins:
                same = (h1[rows].view(np.int64) == a) & (h2[rows].view(np.int64) == b)
                docs[rows[same]], last[rows[same]] = count, most
    return docs, last


def line_dedup(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, doc_id: str = "doc_id", text: str = "text",
               max_entries: int = MAX_ENTRIES, shard: int = SHARD) -> DataFrame:
    """One row per document: the id (bigint), n_lines, n_dropped, kept (the text that is left)."""
    spark = docs.sparkSession
    work = Work(spark, "lines")
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    frequent = frequent_lines(docs, work, least_chars, least_docs)
    total = frequent.count()
    shards = max(1, -(-total // shard))
    build_shards(frequent, shards).write.partitionBy("shard").parquet(f"{work.path}/shards")
    work.drop("lines")
    if total <= max_entries:
        rows = spark.read.schema("body binary, shard int").parquet(f"{work.path}/shards").collect()
        shared, now = spark.sparkContext.broadcast({r["shard"]: bytes(r["body"]) for r in rows}), docs.withColumn("gone", F.array().cast("array<int>"))
    else:
        shared, now = spark.sparkContext.broadcast({}), _dealt(docs, work, shards, least_chars, least_docs)
    return now.mapInArrow(by_chunk("text", _dropper(shared, shards, least_chars, least_docs)), "id long, n_lines long, n_dropped long, kept string").withColumnRenamed("id", doc_id)


def _dealt(docs: DataFrame, work: Work, shards: int, least_chars: int, least_docs: int) -> DataFrame:
    """(id, text, gone): the numbers of the lines that go, found shard by shard. Rows that repeat id and text share them."""
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(" "), F.coalesce("text", F.lit(""))), 256))
    docs, folder = docs.withColumn("key", key), f"{work.path}/shards"

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = text_bytes(batch.column(1))
        _, _, count, row, h1, h2 = _keys(buf, offs, least_chars)
        doc = np.repeat(np.arange(batch.num_rows), count)[row]
        at = pa.array(doc)
        place = row - (np.cumsum(count) - count)[doc]
        own = ((h1 >> U(32)) % U(shards)).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(0).take(at), pa.array(place.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(own)], ["key", "id", "line", "h1", "h2", "shard"])

    lines_of = work.table(docs.select("id", "text", "key").mapInArrow(by_chunk("text", emit), "key binary, id long, line int, h1 long, h2 long, shard int"), "dealt")
    dealt = lines_of.repartitionByRange(max(shards, work.spark.sparkContext.defaultParallelism), "shard", F.xxhash64("key", "line")).sortWithinPartitions("shard")

    def look_up(batches):
        at, parts = None, {}
        for batch in batches:
            own = batch.column(5).to_numpy()
            for some in np.unique(own).tolist():
                if some != at:
                    at, parts = some, {some: read_shard(folder, some)}
                rows = batch.filter(pa.array(own == some))
                h1, h2 = (rows.column(c).to_numpy().view(np.uint64) for c in (3, 4))
                n, last = probe(parts, shards, h1, h2)
                out = (n >= least_docs) & (last != pc.fill_null(rows.column(1), LEAST).to_numpy())
                if out.any():
                    yield pa.RecordBatch.from_arrays([rows.column(c).filter(pa.array(out)) for c in (0, 2)], ["key", "line"])

    gone = dealt.mapInArrow(look_up, "key binary, line int").distinct().groupBy("key").agg(F.collect_list("line").alias("gone"))
    return docs.join(gone, "key", "left").select("id", "text", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))


def read_shard(folder: str, shard: int) -> tuple:
    """A shard's hash and arrays from its file in the shared folder; a shard without lines has no file."""
    fs, path = arrow_fs(f"{folder}/shard={shard}")
    files = fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True))
    found = [pq.read_table(f.path, filesystem=fs, columns=["body"], partitioning=None)["body"][0].as_py() for f in files if f.path.endswith(".parquet")]
    if not found:
        return PerfectHash(np.zeros(0, np.uint64)), np.zeros(1, np.uint64), np.zeros(1, np.uint32), np.zeros(1, np.int64), []
    return pickle.loads(found[0])


def _dropper(shared, shards: int, least_chars: int, least_docs: int):
    parts: dict[int, tuple] = {}

    def drop(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not parts:
            parts.update({k: pickle.loads(v) for k, v in shared.value.items()})
        buf, offs = text_bytes(batch.column(1))
        start, end, count, row, h1, h2 = _keys(buf, offs, least_chars)
        doc = np.repeat(np.arange(batch.num_rows), count)
        docs, last = probe(parts, shards, h1, h2)
        ids = pc.fill_null(batch.column(0), LEAST).to_numpy()
        gone = np.zeros(len(start), bool)
        gone[row[(docs >= least_docs) & (last != ids[doc[row]])]] = True
        first = np.cumsum(count) - count
        before = batch.column(2)
        gone[np.repeat(first, np.diff(before.offsets.to_numpy())) + before.flatten().to_numpy()] = True
        dropped = np.bincount(doc[gone], minlength=batch.num_rows)
        keep = np.flatnonzero(~gone)
        lead = np.ones(len(keep), np.int64)  # a kept line brings the line feed before it, unless it is its text's first kept one
        lead[np.flatnonzero(np.diff(doc[keep], prepend=-1))] = 0
        cover = np.zeros(len(buf) + 1, np.int64)
        np.add.at(cover, start[keep] - lead, 1)
        np.add.at(cover, end[keep], -1)
        stays = np.cumsum(cover)[:-1] > 0
        size = np.concatenate([[0], np.cumsum(stays)])
        text = pa.StringArray.from_buffers(batch.num_rows, pa.py_buffer(size[offs].astype(np.int32)), pa.py_buffer(buf[stays]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(count.astype(np.int64)), pa.array(dropped.astype(np.int64)), text], ["id", "n_lines", "n_dropped", "kept"])

    return drop
