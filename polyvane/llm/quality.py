"""Quality classifier: a generalised additive model with pairwise interactions.

Features are read off whole texts in numpy. Training, on at most ``MAX_ROWS`` labelled rows (those of smallest hash), bins every
feature by quantiles and boosts cyclically: round after round, each feature in turn gets a shallow tree (three leaves) over its
bins, fitted to the current gradients and added to the feature's lookup table at a small rate. The pairs of features with the largest
gain on what is left then get tables over bin pairs, boosted likewise by depth-two trees. Scoring is bin look-ups and additions.

Defined cases: null counts as empty, whose features are all 0 and whose score is the model's for them; labelled rows without text or
with a null label are not learnt from; with no labelled rows, or one class only, every score is the share of label 1 (0.5 if none);
rows that repeat are scored row by row; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyvane.llm.textvec import NOT_SPACE, Words, by_chunk, byte_class, chunks, lines

#: Labelled rows that a fit uses at most.
MAX_ROWS = 20_000
FEATURES = ("words", "word_length", "longest_word", "distinct_words", "adjacent_repeats", "commonest_word", "distinct_trigrams", "lines", "line_length",
            "distinct_lines", "letters", "digits", "spaces", "upper", "stops", "symbols", "marked_words", "bytes_a_word_kind")


def _kinds() -> np.ndarray:
    """Byte classes: 0 symbol, 1 lower, 2 upper, 3 beyond ASCII, 4 digit, 5 space, 6 sentence mark."""
    table = np.zeros(256, np.int64)
    for kind, ranges in enumerate((((0x61, 0x7A),), ((0x41, 0x5A),), ((0x80, 0xFF),), ((0x30, 0x39),), ((0x20, 0x20), (0x09, 0x0D)))):
        table[byte_class(*ranges)] = kind + 1
    for c in b".,;:!?'\"()-":
        table[c] = 6
    return table


KINDS = _kinds()


def _by_text(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of each text's values."""
    return np.diff(np.concatenate([[0], np.cumsum(value)])[first]).astype(float)


def features(column: pa.Array) -> np.ndarray:
    """One row per text, columns as FEATURES."""
    w = Words(column, NOT_SPACE)
    n, out = len(w.n), {}
    words = np.maximum(w.n, 1).astype(float)
    size = np.maximum(np.diff(w.offs), 1).astype(float)
    raw = np.asarray(w.raw)
    doc = np.repeat(np.arange(n), np.diff(w.offs))
    kinds = KINDS[raw]
    share = np.bincount(doc * 7 + kinds, minlength=n * 7).reshape(n, 7) / size[:, None]
    length = w.ends - w.starts
    out["words"] = np.log1p(w.n)
    out["word_length"] = _by_text(length, w.first) / words
    some = np.flatnonzero(w.n > 0)
    longest = np.zeros(n)
    longest[some] = np.maximum.reduceat(length, w.first[some]) if len(some) else 0
    out["longest_word"] = np.log1p(longest)
    same = np.zeros(len(w.h), bool)
    same[1:] = w.h[1:] == w.h[:-1]
    starts = w.first[:-1][w.n > 0]
    same[starts] = False
    out["adjacent_repeats"] = _by_text(same, w.first) / words
    h = w.h.copy()
    grams, _, first = w.grams(3, short=True)
    for values, at in ((h, w.first), (grams, first)):
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            values[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[starts] = True
    out["distinct_words"] = _by_text(new, w.first) / words
    runs = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, np.searchsorted(w.first, runs, side="right") - 1, np.diff(np.concatenate([runs, [len(h)]])))
    out["commonest_word"] = most / words
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    new[first[:-1][np.diff(first) > 0]] = True
    out["distinct_trigrams"] = _by_text(new, first) / np.maximum(np.diff(first), 1)
    start, end, count = lines(raw, w.offs)
    row = np.repeat(np.arange(n), count)
    out["lines"] = np.log1p(count)
    out["line_length"] = np.log1p(np.bincount(row, end - start, minlength=n) / count)
    # a line is told by the words in it: their hashes summed
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.h)])
    line = total[np.searchsorted(w.starts, end)] - total[np.searchsorted(w.starts, start)]
    order = np.lexsort((line, row))
    new = np.ones(len(order), bool)
    new[1:] = (line[order][1:] != line[order][:-1]) | (row[order][1:] != row[order][:-1])
    out["distinct_lines"] = np.bincount(row[order][new], minlength=n) / count
    out["letters"], out["digits"], out["spaces"] = share[:, 1] + share[:, 2] + share[:, 3], share[:, 4], share[:, 5]
    out["upper"], out["stops"], out["symbols"] = share[:, 2], share[:, 6], share[:, 0]
    symbol = np.concatenate([[0], np.cumsum(kinds == 0)])
    out["marked_words"] = _by_text(symbol[w.ends] > symbol[w.starts], w.first) / words
    out["bytes_a_word_kind"] = np.log1p(size / np.maximum(out["distinct_words"] * words, 1))
    empty = np.diff(w.offs) == 0
    table = np.stack([out[f] for f in FEATURES], 1)
    table[empty] = 0
    return table


class Additive:
    """Lookup tables by feature and by feature pair."""

    def __init__(self, bins: int = 32, rounds: int = 250, rate: float = 0.08, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 80, smooth: float = 5.0):
        self.bins, self.rounds, self.rate, self.n_pairs, self.pair_bins, self.pair_rounds, self.smooth = bins, rounds, rate, pairs, pair_bins, pair_rounds, smooth

    @staticmethod
    def _edges(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))

    def _leaf(self, g: float, h: float) -> float:
        return g / (h + self.smooth)

    def _split(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """Gain and place of the best cut of a run of bins."""
        if len(g) < 2:
            return 0.0, 0
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        c, d = g.sum() - a, h.sum() - b
        gain = a * a / (b + self.smooth) + c * c / (d + self.smooth) - g.sum() ** 2 / (h.sum() + self.smooth)
        k = int(gain.argmax())
        return float(gain[k]), k + 1

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Three leaves over a feature's bins."""
        _, k = self._split(g, h)
        if not k:
            return np.full(len(g), self._leaf(g.sum(), h.sum()))
        (x, i), (y, j) = self._split(g[:k], h[:k]), self._split(g[k:], h[k:])
        cuts = sorted({0, k, len(g)} | ({i} if x >= y and i else {k + j} if j else set()))
        out = np.empty(len(g))
        for a, b in zip(cuts, cuts[1:], strict=False):
            out[a:b] = self._leaf(g[a:b].sum(), h[a:b].sum())
        return out

    def _quad(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Depth two over bin pairs: a cut of the first feature, then one of the second on either side."""
        _, k = self._split(g.sum(1), h.sum(1))
        out = np.zeros_like(g)
        for a, b in ((0, k), (k, len(g))):
            if b > a:
                gs, hs = g[a:b].sum(0), h[a:b].sum(0)
                _, j = self._split(gs, hs)
                for c, d in ((0, j), (j, g.shape[1])):
                    if d > c:
                        out[a:b, c:d] = self._leaf(gs[c:d].sum(), hs[c:d].sum())
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        self.base, self.edges, self.tables, self.pair_edges, self.pairs = 0.0, [], [], [], []
        share = float(y.mean()) if len(y) else 0.5
        if share in (0.0, 1.0) or not len(y):
            self.constant = share
            return self
        self.constant = None
        self.base = float(np.log(share / (1 - share)))
        self.edges = [self._edges(c, self.bins) for c in x.T]
        place = [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for k, at in enumerate(place):
                p = 1 / (1 + np.exp(-score))
                step = self.rate * self._tree(np.bincount(at, y - p, len(self.tables[k])), np.bincount(at, p * (1 - p), len(self.tables[k])))
                self.tables[k] += step
                score += step[at]
        self.pair_edges = [self._edges(c, self.pair_bins) for c in x.T]
        coarse = [np.searchsorted(e, c, side="right") for e, c in zip(self.pair_edges, x.T, strict=True)]
        p = 1 / (1 + np.exp(-score))
        gains = []
        for i, j in combinations(range(x.shape[1]), 2):
            m = len(self.pair_edges[j]) + 1
            at = coarse[i] * m + coarse[j]
            g, h = np.bincount(at, y - p), np.bincount(at, p * (1 - p))
            gains.append((float((g * g / (h + self.smooth)).sum()), i, j))
        for _, i, j in sorted(gains, reverse=True)[:self.n_pairs]:
            self.pairs.append([i, j, np.zeros((len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1))])
        for _ in range(self.pair_rounds):
            for i, j, table in self.pairs:
                at = coarse[i] * table.shape[1] + coarse[j]
                p = 1 / (1 + np.exp(-score))
                g, h = (np.bincount(at, v, table.size).reshape(table.shape) for v in (y - p, p * (1 - p)))
                step = self.rate * self._quad(g, h)
                table += step
                score += step.reshape(-1)[at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        out = np.full(len(x), self.base)
        for c, e, t in zip(x.T, self.edges, self.tables, strict=True):
            out += t[np.searchsorted(e, c, side="right")]
        for i, j, t in self.pairs:
            out += t[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-out))


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; of the empty text for a null id."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit(""))) % parts


def sample_labels(labels: DataFrame, label: str, parts: int, held: int, most: int, doc_id: str) -> DataFrame:
    """(id as string, y): at most ``most`` labelled rows outside the held-out fold, those whose ids have the smallest hashes."""
    rows = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (fold(doc_id, parts) != held))
    rows = rows.groupBy(F.col(doc_id).cast("string").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(most)


def sample_texts(docs: DataFrame, taken: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(text, id, y): one text for each sampled id, so that an id which recurs in documents can't outgrow the sample: its smallest text."""
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).join(F.broadcast(taken), "id")
    return rows.groupBy("id", "y").agg(F.min("text").alias("text")).select("text", "id", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held: int = 2, most: int = MAX_ROWS,
                doc_id: str = "doc_id", text: str = "text") -> Additive:
    # at most ``most`` rows of an id and a number are broadcast, and as many rows of features come to the driver
    rows = sample_texts(docs, sample_labels(labels, label, parts, held, most, doc_id), doc_id, text).where("text is not null")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(0))
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *[pa.array(c) for c in x.T]], ["id", "y", *FEATURES])

    table = rows.mapInArrow(by_chunk("text", one), "id string, y int, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow()
    x = np.stack([table[f].to_numpy() for f in FEATURES], 1) if table.num_rows else np.zeros((0, len(FEATURES)))
    order = np.argsort(table["id"].to_numpy(zero_copy_only=False).astype(str))  # the rows come in any order
    return Additive().fit(x[order], table["y"].to_numpy().astype(float)[order])


def score_quality(docs: DataFrame, model: Additive, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the id and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(features(batch.column(1))))], ["id", "score"])

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(by_chunk("text", one), f"id {kind}, score double").withColumnRenamed("id", doc_id)


def keep_quality(docs: DataFrame, model: Additive, threshold: float, text: str = "text") -> DataFrame:
    """Documents that score at least the threshold, with all their columns; rows are filtered where they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                yield part.filter(pa.array(shared.value.score(features(part.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
