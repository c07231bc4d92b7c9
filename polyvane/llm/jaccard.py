"""Exact join of documents on the Jaccard similarity of their word shingles: size-aware, heavy and light.

Two sets of n and m shingles link if they share at least c(n, m) = ceil(t * (n + m) / (100 + t)). That bound depends on sizes alone, so a small set
enumerates its subsets of exactly c members, for each c that a partner may require, and sets that link share such a subset. A large set has too
many; it scans inverted lists instead: those of the first n - ceil(t * n / 100) + 1 of its shingles, in an order that all sets share, of which
sets that link share one. The boundary between small and large is the size up to which subsets cost less than lists, by the corpus' own
counts; sets somewhat below it stand in the lists too, for their larger partners.

The shared order puts frequent shingles last, then goes by hash. Frequent ones are found by counting over all documents; how many are told apart is bounded by the
bit filter that carries them, which may take others for frequent: that is another order, equally shared, and no link depends on it.

Subsets and lists are buckets. In a bucket each set is paired with its most central one (a star), so pairs are no more than rows. Pairs that sizes or
parity bitmaps rule out (the bits in which two bitmaps differ are never more than the shingles in which the sets differ) go before any text is
fetched; the others are confirmed on full sets of words. Buckets whose sets did not end in one component are compared across components in
blocks, on bitmaps; what these leave is compared on shingles, and links that join components are confirmed in turn. So no link is lost, and no bucket's
pairs are ever listed.

Defined cases: a text with fewer words than k has its whole sequence as one shingle; null, empty or word-less texts have no shingles and no links; rows
that share an id are one node; a null id is linked with nothing; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvane.llm.filters import BitFilter
from polyvane.llm.minhash import BLOCK, _across, _sets, _without_twins, confirm, equal_sets, set_sums, with_digest
from polyvane.llm.textvec import U, by_chunk, lists, mix
from polyvane.llm.work import Work, components

#: Documents from which a shingle may count as frequent; how many frequent shingles there are at most; sizes that may count as small.
FREQUENT, FREQUENT_MOST, SMALL = 32, 1 << 20, 64
#: What a shared row costs beside an unshared one: it leads to a pair, whose bitmaps and often texts are fetched.
SHARED_COST = 4.0
#: Bits of a set's bitmap: at least, at most, and by shingle.
BITS_LEAST, BITS_MOST, BITS_EACH = 256, 1 << 16, 2


def least_common(n, m, threshold: int):
    """How many members sets of n and m share at least if they link."""
    return -(-threshold * (n + m) // (100 + threshold))


def prefix_size(n, threshold: int):
    return n - (-(-threshold * n // 100)) + 1


@cache
def subset_sizes(n: int, threshold: int) -> tuple[int, ...]:
    """The sizes of subsets that a set of n enumerates: what partners of every size that can link require. Equal sets are one class already, so
    a set whose partners must all be equal to it enumerates none."""
    partners = range(-(-threshold * n // 100), 100 * n // threshold + 1)
    return tuple(sorted({int(least_common(n, m, threshold)) for m in partners if m and least_common(n, m, threshold) <= min(n, m) and not (m == n == least_common(n, m, threshold))}))


def subset_count(n: int, threshold: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, threshold))


@cache
def _dropped(n: int, r: int) -> np.ndarray:
    """All choices of r of n members, one a row."""
    return np.array(list(combinations(range(n), r)), np.int64).reshape(comb(n, r), r)


def subsets(value: np.ndarray, threshold: int) -> np.ndarray:
    """Hashes of the subsets that one set enumerates: sums over members, less those left out."""
    n = len(value)
    part = mix(value ^ U(0x2545F4914F6CDD1D))
    whole = part.sum(dtype=np.uint64)
    out = [mix(whole - part[_dropped(n, n - c)].sum(axis=1, dtype=np.uint64) + U(c * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for c in subset_sizes(n, threshold)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _widths(n: np.ndarray) -> np.ndarray:
    """Bits of each set's bitmap, a power of two."""
    width = np.full(len(n), BITS_LEAST, np.int64)
    while (more := (width < BITS_EACH * n) & (width < BITS_MOST)).any():
        width[more] *= 2
    return width


def bitmaps(value: np.ndarray, first: np.ndarray) -> pa.Array:
    """Parity bitmaps: each shingle flips the bit that its low bits name."""
    n = np.diff(first)
    words = np.where(n > 0, _widths(n) >> 6, 0)
    place = np.concatenate([[0], np.cumsum(words)])
    flat, owner = np.zeros(place[-1], np.uint64), np.repeat(np.arange(len(n)), n)
    bit = (value & (words[owner] * 64 - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(flat, place[owner] + (bit >> 6), U(1) << (bit & 63).astype(np.uint64))
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((place * 8).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def _unpacked(column: pa.Array, rows: np.ndarray) -> list[np.ndarray]:
    return [np.frombuffer(column[int(k)].as_buffer(), np.uint64) for k in rows]


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of half the width by XOR of halves, down to so many words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sets whose bitmaps differ in so many bits can link: the symmetric difference is at least that large."""
    return (100 * np.minimum(n, m) >= threshold * np.maximum(n, m)) & (differ <= n + m - 2 * least_common(n, m, threshold))


def sieve(pairs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of (a, b, n_a, n_b, bits_a, bits_b) that bitmaps don't rule out."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in (2, 3))
            sizes = np.stack([_widths(n), _widths(m)]) >> 6
            keep = np.zeros(batch.num_rows, bool)
            for kind in np.unique(sizes, axis=1).T:
                rows = np.flatnonzero((sizes == kind[:, None]).all(axis=0))
                for some in np.array_split(rows, len(rows) * int(kind.max()) // (1 << 20) + 1):
                    both = [_folded(np.stack(_unpacked(batch.column(c), some)), int(kind.min())) for c in (4, 5)] if len(some) else None
                    if both:
                        keep[some] = may_link(n[some], m[some], np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype=np.int64), threshold)
            found = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(found), batch.column(1).take(found)], ["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(id, digest, n, s1, s2, bits): SHA-256 of the text, set size, a 128-bit hash of the set, its bitmap."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, first = _sets(batch.column(1), k)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(first)), *map(pa.array, set_sums(value, first)), bitmaps(value, first)], ["id", "digest", "n", "s1", "s2", "bits"])

    return with_digest(docs).mapInArrow(by_chunk("text", one), "id long, digest binary, n long, s1 long, s2 long, bits binary")


def _frequent(work: Work, docs: DataFrame, k: int, threshold: int) -> tuple[BitFilter, float]:
    """A filter of the most frequent shingles and the share of shingles that are in several documents, counted over all documents among the twice as many
    first ones by hash as a prefix has: those that can come into prefixes."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, first = _sets(batch.column(0), k)
        n = np.diff(first)
        inside = np.arange(len(value)) - np.repeat(first[:-1], n) < np.repeat(2 * prefix_size(n, threshold), n)
        token, count = np.unique(value[inside], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], ["token", "c"])

    counted = docs.select("text").mapInArrow(by_chunk("text", one), "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    counted = counted.select("token", "c", F.floor(F.log2("c")).cast("int").alias("bin"))
    # one row for each power of two: of each, how many shingles and occurrences
    several = work.table(counted.where("c > 1"), "counts")
    by_bin = {r["bin"]: (r["tokens"], r["found"]) for r in several.groupBy("bin").agg(F.count("*").alias("tokens"), F.sum("c").alias("found")).collect()}
    limit, total = max(by_bin, default=0) + 1, 0
    for b in sorted(by_bin, reverse=True):
        if 1 << b < FREQUENT or total + by_bin[b][0] > FREQUENT_MOST:
            break
        limit, total = b, total + by_bin[b][0]
    found = BitFilter(several.where(f"bin >= {limit}").select("token"), "token", total)
    return found, float(sum(v for _, v in by_bin.values()))


def boundary(sizes: dict[int, int], share: float, threshold: int) -> int:
    """The size up to which subsets cost less than lists, all in all; sizes: how many sets there are of each size up to SMALL. Sets from
    threshold hundredths of the first large size on stand in the lists as well."""
    row = 1 + SHARED_COST * share
    best, at, subset, saved = 0.0, 0, 0.0, 0.0
    for b in range(1, SMALL + 1):
        subset += sizes.get(b, 0) * subset_count(b, threshold)
        saved = sum(sizes.get(n, 0) * prefix_size(n, threshold) * row for n in range(1, -(-threshold * (b + 1) // 100)))
        if subset - saved < best:
            best, at = subset - saved, b
    return at


def _buckets(docs: DataFrame, k: int, threshold: int, small: int, frequent: BitFilter) -> DataFrame:
    """(rep, n, s1, buckets): the subsets of small sets, the first shingles of others."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    least = -(-threshold * (small + 1) // 100)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, first = _sets(batch.column(1), k)
        n = np.diff(first)
        owner = np.repeat(np.arange(len(n)), n)
        often = sent.value(value)
        order = np.lexsort((value, often, owner))
        inside = (np.arange(len(value)) - first[owner] < prefix_size(n, threshold)[owner]) & (n >= least)[owner]
        held, count = [value[order][inside]], np.bincount(owner[inside], minlength=len(n))
        place = [owner[inside]]
        for row in np.flatnonzero((n > 0) & (n <= small)).tolist():
            more = subsets(value[first[row]:first[row + 1]], threshold)
            held.append(more)
            place.append(np.full(len(more), row))
            count[row] += len(more)
        held = np.concatenate(held)[np.argsort(np.concatenate(place), kind="stable")]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(set_sums(value, first)[0]), lists(held.view(np.int64), count)], ["rep", "n", "s1", "buckets"])

    return docs.mapInArrow(by_chunk("text", one), "rep long, n long, s1 long, buckets array<long>")


def _candidates(work: Work, large: DataFrame, label: DataFrame, bits: DataFrame, threshold: int) -> DataFrame:
    """(bucket, rep, n, c) of the members that bitmaps leave a partner in another component, over all buckets whose members are in several. Pairs
    of blocks are compared in one task each; nothing but members comes out, each at most once a block."""
    named = large.join(label, large.rep == label.node, "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("c")).where("x <> y")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    named = named.join(mixed.select("bucket", "c"), "bucket").join(bits, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    rows = named.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "n", "component", "bits")
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "n")

    def compare(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = np.stack([held[c].to_numpy() for c in ("bucket", "i", "j")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for a, b in zip(np.concatenate([[0], cut[:-1]]), cut, strict=True) if len(cut) else ():
                yield _partners(held.slice(int(a), int(b - a)), threshold)
            held = held.slice(int(cut[-1])) if len(cut) else held
        if held is not None and held.num_rows:
            yield _partners(held, threshold)

    return dealt.mapInArrow(compare, "bucket long, rep long, n long").distinct()


def _partners(rows: pa.Table, threshold: int) -> pa.RecordBatch:
    """Members of one pair of blocks, by size, that may link with one of another component."""
    n, part = rows["n"].to_numpy(), rows["component"].to_numpy()
    column = rows["bits"].combine_chunks()
    found = np.zeros(len(n), bool)
    _, part = np.unique(part, return_inverse=True)
    largest = np.bincount(part).argmax()
    every = [np.frombuffer(v.as_buffer(), np.uint64) for v in column] if (part != part[0]).any() else []
    width = np.array([len(v) for v in every])
    by_width = {w: (at, np.stack([every[k] for k in at])) for w in np.unique(width).tolist() for at in [np.flatnonzero(width == w)]}
    for x in np.flatnonzero(part != largest).tolist() if every else ():
        for w, (at, bits) in by_width.items():
            lo, hi = np.searchsorted(n[at], (-(-threshold * n[x] // 100), 100 * n[x] // threshold + 1))
            if lo == hi:
                continue
            near, words = at[lo:hi], min(w, len(every[x]))
            differ = np.bitwise_count(_folded(bits[lo:hi], words) ^ _folded(every[x][None], words)).sum(axis=1, dtype=np.int64)
            hit = near[may_link(n[near], n[x], differ, threshold) & (part[near] != part[x])]
            found[hit] = True
            found[x] |= len(hit) > 0
    keep = pa.array(np.flatnonzero(found))
    out = rows.select(["bucket", "rep", "n"]).take(keep).combine_chunks()
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in out.columns], ["bucket", "rep", "n"])


def jaccard_components(docs: DataFrame, k: int = 5, threshold: int = 80, small: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the id, n_shingles, component_id (smallest id reachable by links of similarity threshold / 100 or more).

    ``small``: up to which size sets enumerate subsets; None: as costs have it. Any value gives the same result.
    """
    work = Work(docs.sparkSession, "jaccard")
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = work.table(sketch(docs, k), "sketch")
    filled = rows.where("n > 0 and id is not null")
    classes = equal_sets(work, filled.drop("bits"), docs, k)
    reps = work.table(filled.select(F.col("id").alias("rep"), "n", "s1", "s2", "digest", "bits").join(classes, ["n", "s1", "s2", "digest", "rep"], "left_semi").select("rep", "n", "s1", "bits").dropDuplicates(["rep", "n", "s1"]), "reps")
    frequent, shared = _frequent(work, docs, k, threshold)
    if small is None:
        by_size = {r["n"]: r["c"] for r in reps.where(F.col("n") <= SMALL).groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most SMALL rows
        first = rows.where("n > 0").agg(F.sum(F.least("n", 2 * (F.col("n") - F.ceil(threshold * F.col("n") / 100) + 1)))).first()[0]
        small = boundary(by_size, shared / max(first or 0, 1), threshold)
    found = _buckets(docs, k, threshold, small, frequent).join(reps.select("rep", "n", "s1"), ["rep", "n", "s1"], "left_semi")
    member = work.table(found.select("rep", "n", F.explode("buckets").alias("bucket")).distinct(), "members")
    bucket = member.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count("*").alias("c")).where("hub <> last")
    bucket = work.table(bucket, "buckets")
    large = _without_twins(work.table(member.join(bucket.where("c > 2").select("bucket", "c"), "bucket"), "large"), work)
    central = large.groupBy("rep").agg(F.sum("c").alias("score"))
    scored = work.table(large.join(central, "rep"), "stars")
    hubs = scored.groupBy("bucket").agg((-F.max(F.struct("score", -F.col("rep")))["col2"]).alias("hub"))
    stars = scored.join(hubs, "bucket").where("rep <> hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))
    pairs = bucket.where("c = 2").select(F.col("hub").alias("a"), F.col("last").alias("b")).unionByName(stars).distinct()
    bits = reps.select("rep", "n", "bits")
    small_side = reps.select("rep", "n")
    for x in "ab":  # sizes first: what they rule out fetches no bitmap
        pairs = pairs.join(small_side.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}")), x)
    pairs = work.table(pairs.where(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)"), "sized")
    both = pairs
    for x in "ab":
        both = both.join(bits.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")).hint("merge"), [x, f"n_{x}"])
    pairs = work.table(sieve(both, threshold).distinct(), "pairs")
    texts = work.table(docs.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().hint("merge"), "id", "left_semi"), "texts")
    links = work.table(confirm(pairs, texts, k, threshold), "links")
    first = components(work, links.toDF("u", "v"), "first")
    left = work.table(_candidates(work, scored.select("bucket", "rep", "n"), first, bits.select("rep", "bits"), threshold), "left")
    again = work.table(docs.join(left.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "again")
    across = _across(work, left, first, again, k, threshold)
    for x in "ab":
        across = across.join(first.toDF(x, f"{x}_in"), x, "left").withColumn(x, F.coalesce(f"{x}_in", x)).drop(f"{x}_in")
    second = components(work, across.toDF("u", "v"), "second")
    label = first.toDF("rep", "at").unionByName(second.toDF("rep", "at").join(first.select(F.col("node").alias("rep")), "rep", "left_anti"))
    label = label.join(second.toDF("at", "whole"), "at", "left").select("rep", F.coalesce("whole", "at").alias("component"))
    whole = work.table(classes.join(label, "rep", "left").select("n", "s1", "s2", "digest", F.coalesce("component", "rep").alias("component")), "whole")
    work.drop("leads", "reps", "counts", "members", "buckets", "large", "sums", "twins", "equal", "stars", "sized", "pairs", "texts", "links", "left", "again", "mixed", "tokens", "found", "across")
    out = rows.drop("bits").join(whole, ["n", "s1", "s2", "digest"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"))
