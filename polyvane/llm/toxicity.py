"""Toxicity classifier with counterfactual regularisation.

A text's features are its distinct words and distinct word beginnings of 4, 5 and 6 bytes. Of the features of at most ``MAX_ROWS``
labelled rows per class (those of smallest hash), all that tell the classes apart are kept, as many as they are; a logistic
model on them is fitted with a penalty on the squared change of its score under counterfactuals of the labelled texts:

- where a text names a group by an identity term, the term is swapped for every other term of its group;
- each text is also given one neutral mention of a term, drawn by the hash of its id, which is swapped for all others of its group and
  compared with the text as it is.

So a group's name can't carry weight of its own, whatever company the labels show it in, or whether they show it at all. The model is linear in
its features, so a swap changes the score by the difference of the terms' own weights, and counterfactuals are counted by pair of
terms: their number is bounded by the vocabulary, not by the sample. ``active`` counts them, ``gap`` is their mean absolute change of
the score in log-odds.

Defined cases: null counts as empty, which scores by the intercept; labelled rows with a null label or without a document are not learnt
from; with one class or none every score is that class's share (0 if none); rows that repeat are scored row by row, and learnt from once an id; ids may be
of any type; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvane.llm.quality import fold, sample_texts
from polyvane.llm.textvec import ALNUM, U, Words, by_chunk, lists, mix

MAX_ROWS = 10_000
#: Identity terms by group; a term is swapped for all others of its group.
IDENTITY = {
    "gender": "man woman men women male female boy girl homme femme mann frau hombre mujer transgender nonbinary".split(),
    "belief": "christian muslim jewish jew hindu buddhist atheist catholic protestant chretien musulman juif christ moslem jude cristiano judio".split(),
    "origin": "american african asian european mexican chinese indian arab french german spanish turkish polish russian immigrant refugee".split(),
    "colour": "black white brown latino latina hispanic".split(),
    "love": "gay lesbian straight bisexual homosexual heterosexual queer".split(),
    "age_body": "old young elderly disabled blind deaf".split(),
}


def _hash(words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    w = Words(pa.array(words), ALNUM)
    return w.h, [prefix(w, k) for k in (4, 5, 6)]


def prefix(w: Words, k: int) -> np.ndarray:
    """Hash of the first k bytes of each word, 0 for shorter words."""
    buf = np.concatenate([w.buf, np.zeros(k, np.uint8)])
    value = np.zeros(len(w.starts), np.uint64)
    for j in range(k):
        value = value << U(8) | buf[w.starts + j]
    value = mix(value + U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    value[w.ends - w.starts < k] = 0
    return value


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of all words and word beginnings, repeats included."""
    doc = np.repeat(np.arange(len(w.n)), w.n)
    parts = [w.h, *(prefix(w, k) for k in (4, 5, 6))]
    value, at = np.concatenate(parts), np.tile(doc, 4)
    return value[value != 0], at[value != 0]


TERMS = [t for group in IDENTITY.values() for t in group]


def term_features() -> tuple[np.ndarray, list[np.ndarray]]:
    """By identity term: the hash of the word, and the hashes of all its features."""
    h, p = _hash(TERMS)
    return h, [np.unique([x[k] for x in (h, *p) if x[k]]) for k in range(len(TERMS))]


def counterfactuals(named: np.ndarray, given: np.ndarray) -> list[tuple[int, int, float]]:
    """(term, other or -1 for none, weight): what texts that name a term, and texts that were given a neutral mention of it, are compared with.
    A mention's comparisons weigh one in all for each kind.
    """
    out, at = [], 0
    for group in IDENTITY.values():
        for i in range(at, at + len(group)):
            n = float(named[i] + given[i])
            out += [(i, j, n / (len(group) - 1)) for j in range(at, at + len(group)) if j != i and n]
            out += [(i, -1, float(given[i]))] if given[i] else []
        at += len(group)
    return out


class Toxicity:
    def __init__(self, keys: np.ndarray, weight: np.ndarray, base: float):
        self.keys, self.weight, self.base = keys, weight, base
        self.active, self.gap = 0, 0.0
        self.seen = np.zeros(1 << 20, bool)
        self.seen[keys >> U(44)] = True

    def find(self, value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature row) of the features that the model has."""
        maybe = np.flatnonzero(self.seen[value >> U(44)])
        if not len(maybe) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.keys, value[maybe]), len(self.keys) - 1)
        hit = self.keys[place] == value[maybe]
        both = np.unique(doc[maybe][hit] * len(self.keys) + place[hit])
        return both // len(self.keys), both % len(self.keys)

    def score(self, column: pa.Array) -> np.ndarray:
        w = Words(column, ALNUM)
        doc, row = self.find(*tokens(w))
        return 1 / (1 + np.exp(-(self.base + np.bincount(doc, self.weight[row], len(w.n)))))


def fit_logistic(doc: np.ndarray, row: np.ndarray, y: np.ndarray, n_features: int, pair: np.ndarray, pair_row: np.ndarray, pair_sign: np.ndarray,
                 pair_weight: np.ndarray, ridge: float = 0.3, counterfactual: float = 5.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent with diagonal scaling.

    Loss: log loss over texts + ridge |w|^2 / 2 + counterfactual * sum over pairs of weight * (change of score)^2 / 2, where
    the change of pair p is the sum of sign * w over its (pair, row, sign) entries.
    """
    w, base, n_pairs = np.zeros(n_features), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), len(pair_weight)
    v, v_base, last, last_base, t = w.copy(), base, w, base, 1.0
    size = np.bincount(doc, minlength=len(y)) + 1.0
    reach = 0.25 * np.bincount(row, size[doc], n_features) + ridge
    if n_pairs:
        many = np.bincount(pair, minlength=n_pairs) * pair_weight
        reach += counterfactual * np.bincount(pair_row, many[pair], n_features)
    reach_base = 0.25 * size.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(v_base + np.bincount(doc, v[row], len(y)))))
        g = np.bincount(row, (p - y)[doc], n_features) + ridge * v
        if n_pairs:
            change = np.bincount(pair, pair_sign * v[pair_row], n_pairs) * pair_weight
            g += counterfactual * np.bincount(pair_row, pair_sign * change[pair], n_features)
        w, base = v - g / reach, v_base - (p - y).sum() / reach_base
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, v_base = w + (t - 1) / t_next * (w - last), base + (t - 1) / t_next * (base - last_base)
        last, last_base, t = w, base, t_next
    return w, base


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held: int = 0, most: int = MAX_ROWS,
                 doc_id: str = "doc_id", text: str = "text", counterfactual: float = 5.0) -> Toxicity:
    usable = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (fold(doc_id, parts) != held))
    usable = usable.groupBy(F.col(doc_id).cast("string").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        only = max(counts, default=0)
        return Toxicity(np.zeros(0, np.uint64), np.zeros(0), 30.0 if only else -30.0)
    first = [usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y in (0, 1)]
    rows = sample_texts(docs, first[0].unionByName(first[1]), doc_id, text)  # at most twice ``most`` rows

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column(0), ALNUM)
        value, doc = tokens(w)
        order = np.lexsort((doc, value))
        value, doc = value[order], doc[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        value, bad = value[new], batch.column(2).to_numpy()[doc[new]]
        keys, at = np.unique(value, return_index=True)
        n = np.diff(np.concatenate([at, [len(value)]]))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.add.reduceat(bad, at).astype(np.int64) if len(at) else n), pa.array(n)], ["f", "bad", "n"])

    n1, n0 = min(counts[1], most), min(counts[0], most)
    held_by = rows.mapInArrow(by_chunk("text", count), "f long, bad long, n long").groupBy("f").agg(F.sum("bad").alias("a"), (F.sum("n") - F.sum("bad")).alias("b")).where("a + b >= 3")
    odds = F.log((F.col("a") + 0.5) / (n1 - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n0 - F.col("b") + 0.5))
    sure = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = held_by.withColumn("z", odds / sure).where("abs(z) >= 2")
    keys = np.array([r["f"] for r in best.select("f").collect()], np.int64).view(np.uint64)
    term, owned = term_features()
    keys = np.unique(np.concatenate([keys, *owned]))  # identity terms are always in the model
    model = Toxicity(keys, np.zeros(len(keys)), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column(0), ALNUM)
        doc, row = shared.value.find(*tokens(w))
        order = np.argsort(term)
        at = order[np.minimum(np.searchsorted(term[order], w.h), len(term) - 1)]
        hit = np.flatnonzero(term[at] == w.h)
        both = np.unique((np.searchsorted(w.first, hit, side="right") - 1) * len(term) + at[hit])
        n = batch.num_rows
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), lists(row.astype(np.int32), np.bincount(doc, minlength=n)),
                                           lists((both % len(term)).astype(np.int32), np.bincount(both // len(term), minlength=n))], ["id", "y", "row", "named"])

    given = F.pmod(F.xxhash64(F.lit("mention"), "id"), F.lit(len(TERMS))).cast("int").alias("given")
    found = rows.mapInArrow(by_chunk("text", encode), "id string, y int, row array<int>, named array<int>").select("*", given)
    table = found.toArrow().sort_by("id").combine_chunks()
    y = table["y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Toxicity(np.zeros(0, np.uint64), np.zeros(0), 30.0 if len(y) and y[0] else -30.0)
    held_rows = table["row"].combine_chunks()
    doc = np.repeat(np.arange(len(y)), np.diff(held_rows.offsets.to_numpy()))
    pairs = counterfactuals(np.bincount(table["named"].combine_chunks().flatten().to_numpy(), minlength=len(TERMS)), np.bincount(table["given"].to_numpy(), minlength=len(TERMS)))
    places = [np.searchsorted(keys, x) for x in owned]
    sides = [(p, k, s) for p, (a, b, _) in enumerate(pairs) for side, s in ((a, 1.0), (b, -1.0)) if side >= 0 for k in places[side]]
    pair, pair_row, pair_sign = (np.array(x) for x in zip(*sides, strict=True)) if sides else (np.zeros(0, np.int64),) * 3
    weight = np.array([x[2] for x in pairs])
    w, base = fit_logistic(doc, held_rows.flatten().to_numpy(), y, len(keys), pair, pair_row, pair_sign, weight, counterfactual=counterfactual)
    # the sample has its own share of toxic rows; the intercept goes back to that of all labelled rows
    base += float(np.log(counts[1] / counts[0]) - np.log(n1 / n0))
    out = Toxicity(keys, w, base)
    out.active = int(round(weight.sum()))
    out.gap = float(np.abs(np.bincount(pair, pair_sign * w[pair_row], len(weight))) @ weight / weight.sum()) if len(weight) else 0.0
    return out


def score_toxicity(docs: DataFrame, model: Toxicity, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the id and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)))], ["id", "score"])

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(by_chunk("text", one), f"id {kind}, score double").withColumnRenamed("id", doc_id)
