"""MinHash near-duplicate detection: one-permutation hashing, optimal densification, banded buckets, star edges.

A document's set is its distinct k-word shingles. One hash per shingle fills 128 bins with minima; an empty bin borrows from
a bin drawn by its own sequence of random picks until a filled one comes up (optimal densification). 32 bands of 4 bins
give buckets: two sets of similarity 0.8 miss each other in all bands with probability 0.59 ** 32 = 5e-8.

Equal sets are one class from the start: texts that are equal by SHA-256, and texts whose sets hash alike and then prove equal. In a bucket every class is paired with its most central one only (a star), so pairs
are at most bands times classes. Each pair is confirmed on the full sets. A bucket whose members don't all end in one component
may still hold links that no star met: its members are compared across components in blocks, and what joins components is
confirmed in turn. So no link between two texts of one bucket is lost, and no bucket's pairs are ever listed.

Defined cases: a text with fewer words than k has its whole sequence as one shingle; null, empty or word-less texts have no
shingles and no links; rows that share an id are one node; a null id is linked with nothing and kept; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvane.llm.textvec import NOT_SPACE, U, Words, by_chunk, lists, mix, odd, text_bytes, whole_grams
from polyvane.llm.work import Work, components

BINS, BANDS, PICKS = 128, 32, 1024
#: Members of a bucket in one block; words of 64 bits that a task's bit sets may take.
BLOCK, BITS = 1024, 2 << 20


def _sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and n + 1 offsets."""
    value, _, first = Words(column, NOT_SPACE).grams(k, short=True)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 1:
            value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    new[first[:-1][first[:-1] < len(value)]] = True
    return value[new], np.concatenate([[0], np.cumsum(new)])[first]


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Densified one-permutation signatures of non-empty sets, one row of BINS values each."""
    n = len(first) - 1
    out = np.full(n * BINS, ~U(0))
    owner = np.repeat(np.arange(n), np.diff(first))
    np.minimum.at(out, owner * BINS + (value >> U(57)).astype(np.int64), mix(value) >> U(1))
    out = out.reshape(n, BINS)
    full = out != ~U(0)
    row, col = np.nonzero(~full)
    pick = (mix(odd(BINS * PICKS)).reshape(PICKS, BINS) % U(BINS)).astype(np.int64)
    for t in range(PICKS):
        if not len(row):
            break
        donor = pick[t, col]
        found = full[row, donor]
        out[row[found], col[found]] = out[row[found], donor[found]]
        row, col = row[~found], col[~found]
    for r, c in zip(row, col, strict=True):  # one in e8 bins
        out[r, c] = out[r, np.flatnonzero(full[r])[0]]
    return out


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(id, digest, n, s1, s2, bands): SHA-256 of the text, set size, a 128-bit hash of the set, and its bucket in every band."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, first = _sets(batch.column(1), k)
        n = np.diff(first)
        some = np.flatnonzero(n > 0)
        s1, s2 = set_sums(value, first)
        bands, count = np.zeros(0, np.int64), np.zeros(len(n), np.int64)
        if len(some):
            sig = signatures(value, np.concatenate([first[some], [first[-1]]]))
            rows = BINS // BANDS
            coefficient = odd(BINS, 7).reshape(BANDS, rows)
            held = (mix(sig).reshape(len(some), BANDS, rows) * coefficient).sum(axis=2, dtype=np.uint64)
            bands = mix(held + np.arange(1, BANDS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64).reshape(-1)
            count[some] = BANDS
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(s1), pa.array(s2), lists(bands, count, pa.int64())], ["id", "digest", "n", "s1", "s2", "bands"])

    return with_digest(docs).mapInArrow(by_chunk("text", one), "id long, digest binary, n long, s1 long, s2 long, bands array<long>")


def with_digest(docs: DataFrame) -> DataFrame:
    return docs.select("id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))


def set_sums(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, as signed numbers."""
    some = np.flatnonzero(np.diff(first) > 0)
    sums = []
    for salt in (U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)):
        out = np.zeros(len(first) - 1, np.uint64)
        if len(some):
            out[some] = np.add.reduceat(mix(value ^ salt), first[some])
        sums.append(out.view(np.int64))
    return sums[0], sums[1]


def equal_sets(work: Work, filled: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(n, s1, s2, digest, rep): the class of every text of filled(id, n, s1, s2, digest), rep its smallest id. Texts that are equal by digest are one; texts that
    differ but whose sets hash alike are compared with the class's first text on full sets, and those that aren't equal with the first of them, and so on."""
    left, found = work.table(filled.groupBy("n", "s1", "s2", "digest").agg(F.min("id").alias("lead")), "leads"), []
    while not found or not left.isEmpty():  # again only where different sets hash alike
        k_th = len(found)
        sets = left.groupBy("n", "s1", "s2").agg(F.min("lead").alias("rep"), F.count("*").alias("c"))
        texts = work.table(left.join(sets, ["n", "s1", "s2"]), f"alike{k_th}")
        pairs = work.table(texts.where("c > 1 and lead <> rep").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct(), f"alike_pairs{k_th}")
        some = work.table(docs.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi"), f"alike_texts{k_th}")
        equal = confirm(pairs, some, k, 100).select(F.col("a").alias("rep"), F.col("b").alias("lead"), F.lit(True).alias("same"))
        checked = work.table(texts.join(equal, ["rep", "lead"], "left").withColumn("same", F.expr("coalesce(same, lead = rep)")), f"classes{k_th}")
        found.append(checked.where("same").select("n", "s1", "s2", "digest", "rep"))
        left = checked.where("not same").select("n", "s1", "s2", "digest", "lead")
        work.drop(f"alike{k_th}", f"alike_pairs{k_th}", f"alike_texts{k_th}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def confirm(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Of pairs(a, b) those with 100 * |A and B| >= threshold * |A or B| on full sets of words, not of hashes; a hot ``a`` is split by AQE.

    Pairs and texts both grow with the corpus: these joins are merge joins at every size, never broadcasts.
    """
    left, right = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b")

    def check(batches):
        for batch in batches:
            size = np.maximum.accumulate(text_bytes(batch.column(2))[1] + text_bytes(batch.column(3))[1])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, size[at] + (1 << 20), side="right")) - 1)
                part = batch.slice(at, to - at)
                at = to
                texts_of = pa.concat_arrays([part.column(2), part.column(3)])
                every, first = whole_grams(texts_of, NOT_SPACE, k)
                sizes = np.diff(first)
                n, m = sizes[:part.num_rows], sizes[part.num_rows:]
                pair = np.repeat(np.tile(np.arange(part.num_rows), 2), sizes)
                order = np.lexsort((every, pair))
                same = (pair[order][1:] == pair[order][:-1]) & (every[order][1:] == every[order][:-1])
                common = np.bincount(pair[order][1:][same], minlength=part.num_rows)
                good = (common > 0) & (100 * common >= threshold * (n + m - common))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(good)], ["a", "b", "linked"])

    return both.mapInArrow(check, "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked")).where("linked").select("a", "b")


def _across(work: Work, members: DataFrame, label: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links between members of one bucket that the stars left in different components.

    A bucket's members are dealt to blocks of BLOCK, and each pair of blocks is compared in one task, on whole shingle hashes, the same that
    ``confirm`` compares: no link is missed and nothing but links comes out, of those only the ones that join components, at most one
    a member. They are then confirmed on the full sets like all others.
    """
    named = members.join(label, members.rep == label.node, "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("c")).where("x <> y")
    named = work.table(named.join(mixed.select("bucket", "c"), "bucket"), "mixed")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    rows = named.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "n", "component")

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, first = _sets(batch.column(1), k)
        return pa.RecordBatch.from_arrays([batch.column(0), lists(value.view(np.int64), np.diff(first))], ["rep", "tokens"])

    sets = texts.join(named.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").mapInArrow(by_chunk("text", tokens), "rep long, tokens array<long>")
    rows = rows.join(work.table(sets, "tokens"), "rep").select("bucket", "i", "j", "rep", "n", "component", "tokens")
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")

    def compare(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = np.stack([held[c].to_numpy() for c in ("bucket", "i", "j")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for a, b in zip(np.concatenate([[0], cut[:-1]]), cut, strict=True) if len(cut) else ():
                yield _joins(held.slice(int(a), int(b - a)), threshold)
            held = held.slice(int(cut[-1])) if len(cut) else held
        if held is not None and held.num_rows:
            yield _joins(held, threshold)

    found = work.table(dealt.mapInArrow(compare, "a long, b long").distinct(), "found")
    return work.table(confirm(found, texts, k, threshold), "across")


def _without_twins(large: DataFrame, work: Work) -> DataFrame:
    """Buckets whose member lists equal that of another, as they do over the bands of a family, go but for one. Sums of hashes name the
    candidates; the lists themselves are then compared member by member.
    """
    summed = large.groupBy("bucket").agg(F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("m"), F.max("c").alias("c"))
    summed = work.table(summed, "sums")
    leads = summed.groupBy("m", "c").agg(F.min("bucket").alias("lead"), F.max("bucket").alias("last")).where("lead <> last")
    twins = work.table(summed.join(leads.select("m", "c", "lead"), ["m", "c"]).where("bucket <> lead").select("bucket", "lead", "c"), "twins")
    led = large.join(twins.select(F.col("lead").alias("bucket")).distinct(), "bucket", "left_semi").select(F.col("bucket").alias("lead"), "rep")
    met = large.select("bucket", "rep").join(twins, "bucket").join(led, ["lead", "rep"]).groupBy("bucket", "c").agg(F.count("*").alias("met")).where("met = c")
    return large.join(work.table(met.select("bucket"), "equal"), "bucket", "left_anti")


def _joins(rows: pa.Table, threshold: int) -> pa.RecordBatch:
    """Links of one pair of blocks that join components: a member's common tokens with all others, by bit sets over the shared tokens or, where those
    would be large, by an index from tokens to members."""
    rep, n, part = (rows[c].to_numpy() for c in ("rep", "n", "component"))
    column = rows["tokens"].combine_chunks()
    value, m = column.flatten().to_numpy(), len(rep)
    owner = np.repeat(np.arange(m), np.diff(column.offsets.to_numpy()))
    _, token, count = np.unique(value, return_inverse=True, return_counts=True)
    keep = count[token] > 1
    token, owner = token[keep], owner[keep]
    order = np.argsort(token, kind="stable")
    holders, token_at = owner[order], np.searchsorted(token[order], np.arange(len(count) + 1))
    own_at = np.searchsorted(owner, np.arange(m + 1))
    number = np.cumsum(count > 1) - 1
    width = int(number[-1]) // 64 + 1 if len(number) else 1
    bits = np.zeros((m, width), np.uint64) if m * width <= BITS else None  # else the index, slower and never larger than the rows
    if bits is not None:
        np.bitwise_or.at(bits.reshape(-1), owner * width + (number[token] >> 6), U(1) << (number[token] & 63).astype(np.uint64))
    _, part = np.unique(part, return_inverse=True)
    largest = np.bincount(part).argmax()
    a, b = [], []
    for x in np.flatnonzero(part != largest).tolist():
        y = np.flatnonzero((part != part[x]) & (100 * np.minimum(n, n[x]) >= threshold * np.maximum(n, n[x])))
        if len(y):
            if bits is not None:
                common = np.bitwise_count(bits[y] & bits[x]).sum(axis=1, dtype=np.int64)
            else:
                mine = token[own_at[x]:own_at[x + 1]]
                size = token_at[mine + 1] - token_at[mine]
                spread = np.repeat(token_at[mine] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                common = np.bincount(holders[spread], minlength=m)[y]
            for hit in y[100 * common >= threshold * (n[y] + n[x] - common)].tolist():
                if part[hit] != part[x]:
                    a.append(min(rep[x], rep[hit]))
                    b.append(max(rep[x], rep[hit]))
                    old, new = part[hit], part[x]
                    if old == largest:
                        old, new = new, old
                    part[part == old] = new
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the id, n_shingles, component_id (smallest id reachable by links), kept (id = component_id)."""
    work = Work(docs.sparkSession, "near")
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = work.table(sketch(docs, k), "sketch")
    filled = rows.where("n > 0 and id is not null")
    classes = equal_sets(work, filled.drop("bands"), docs, k)
    # a class is banded once, by the row of its smallest id
    lead = filled.select(F.col("id").alias("rep"), "n", "s1", "s2", "digest", "bands").join(classes, ["n", "s1", "s2", "digest", "rep"], "left_semi")
    member = lead.select("rep", "n", F.explode("bands").alias("bucket"))
    bucket = member.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count("*").alias("c")).where("hub <> last")
    bucket = work.table(bucket, "buckets")
    large = member.join(bucket.where("c > 2").select("bucket", "c"), "bucket")
    large = work.table(large, "large")
    large = _without_twins(large, work)
    # a star's centre is the member that meets most others over all bands: in a family of copies, what they were copied from
    central = large.groupBy("rep").agg(F.sum("c").alias("score"))
    scored = work.table(large.join(central, "rep"), "stars")
    hubs = scored.groupBy("bucket").agg((-F.max(F.struct("score", -F.col("rep")))["col2"]).alias("hub"))
    stars = scored.join(hubs, "bucket").where("rep <> hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))
    sizes = classes.select("rep", "n").distinct()
    pairs = bucket.where("c = 2").select(F.col("hub").alias("a"), F.col("last").alias("b")).unionByName(stars).distinct()
    for x in "ab":
        pairs = pairs.join(sizes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}")), x)
    pairs = work.table(pairs.where(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)").select("a", "b"), "pairs")
    texts = work.table(docs.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(scored.select(F.col("rep").alias("id"))).distinct().hint("merge"), "id", "left_semi"), "texts")
    links = work.table(confirm(pairs, texts, k, threshold), "links")
    first = components(work, links.toDF("u", "v"), "first")
    across = _across(work, scored.select("bucket", "rep", "n"), first, texts, k, threshold)
    # the second round runs on the components of the first, joined by what was found across them
    for x in "ab":
        across = across.join(first.toDF(x, f"{x}_in"), x, "left").withColumn(x, F.coalesce(f"{x}_in", x)).drop(f"{x}_in")
    second = components(work, across.toDF("u", "v"), "second")
    label = first.toDF("rep", "at").unionByName(second.toDF("rep", "at").join(first.select(F.col("node").alias("rep")), "rep", "left_anti"))
    label = label.join(second.toDF("at", "whole"), "at", "left").select("rep", F.coalesce("whole", "at").alias("component"))
    whole = classes.join(label, "rep", "left").select("n", "s1", "s2", "digest", F.coalesce("component", "rep").alias("component"))
    whole = work.table(whole, "whole")
    work.drop("leads", "buckets", "large", "sums", "twins", "equal", "stars", "pairs", "texts", "links", "mixed", "tokens", "found", "across")
    out = rows.drop("bands").join(whole, ["n", "s1", "s2", "digest"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def remove_near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; rows with a null id stay."""
    gone = near_duplicates(docs, k, threshold, doc_id, text).where("not kept").select(F.col(doc_id).alias("_gone"))
    return docs.alias("d").join(gone.distinct().alias("g"), F.col(f"d.{doc_id}").cast("long") == F.col("g._gone"), "left_anti")
