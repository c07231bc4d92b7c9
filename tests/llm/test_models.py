"""The two classifiers against plain versions: features, fits, scores, and what they may not read."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
TEXTS = ["", " ", "One two two two.\nOne two\nOne two", "Ünï cödé 123 4-5 (x) \t end", "$$$ ### a1b2 WWW!", "word " * 300, "a\n\n\nb\r\nc", "x" * 5000, "Same line\nSame line\nother Line", "é" * 40 + " ñ"]


def auc(scores, labels):
    pos, neg = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_features(text):
    """The columns of FEATURES from their definitions."""
    raw = text.encode()
    if not raw:
        return [0.0] * 18
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    n = max(len(words), 1)
    sizes = [len(w.encode()) for w in words]
    grams = [tuple(words[k:k + 3]) for k in range(max(len(words) - 2, 0))] or ([tuple(words)] if words else [])
    lines = text.split("\n")
    kind = Counter("marks" if c in b".,;:!?'\"()-" else "space" if c in b" \t\n\v\f\r" else "digit" if 48 <= c <= 57 else "upper" if 65 <= c <= 90 else "lower" if 97 <= c <= 122 else "high" if c >= 128 else "symbol" for c in raw)
    share = {k: v / len(raw) for k, v in kind.items()}
    get = lambda k: share.get(k, 0.0)
    marked = sum(any(c < 128 and not chr(c).isalnum() and c not in b".,;:!?'\"()-" for c in w.encode()) for w in words)
    kinds = [tuple(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x))) for x in lines]
    return [math.log1p(len(words)), sum(sizes) / n, math.log1p(max(sizes, default=0)), len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, max(Counter(words).values(), default=0) / n,
            len(set(grams)) / max(len(grams), 1), math.log1p(len(lines)), math.log1p(sum(len(x.encode()) for x in lines) / len(lines)), len({tuple(sorted(k)) for k in kinds}) / len(lines),
            get("lower") + get("upper") + get("high"), get("digit"), get("space"), get("upper"), get("marks"), get("symbol"), marked / n, math.log1p(len(raw) / max(len(set(words)), 1))]


def test_quality_features():
    from polyvane.llm.quality import FEATURES, features

    got = features(pa.array(TEXTS))
    for row, text in zip(got, TEXTS):
        assert dict(zip(FEATURES, row)) == pytest.approx(dict(zip(FEATURES, brute_features(text))), abs=1e-12), text[:40]


def plain_fit(x, y, model):
    """Cyclic boosting by trying every cut of every feature, row by row."""
    g = lambda rows, p: sum(y[r] - p[r] for r in rows)
    h = lambda rows, p: sum(p[r] * (1 - p[r]) for r in rows)
    leaf = lambda rows, p: g(rows, p) / (h(rows, p) + model.smooth)
    gain = lambda a, b, p: g(a, p) ** 2 / (h(a, p) + model.smooth) + g(b, p) ** 2 / (h(b, p) + model.smooth)
    score = [math.log(sum(y) / (len(y) - sum(y)))] * len(y)
    for _ in range(model.rounds):
        for f, edges in enumerate(model.edges):
            place = [sum(x[r][f] >= e for e in edges) for r in range(len(y))]
            p = [1 / (1 + math.exp(-s)) for s in score]

            def cut(lo, hi):
                best = None
                whole = [r for r in range(len(y)) if lo <= place[r] < hi]
                for k in range(lo + 1, hi):
                    value = gain([r for r in whole if place[r] < k], [r for r in whole if place[r] >= k], p) - g(whole, p) ** 2 / (h(whole, p) + model.smooth)
                    if best is None or value > best[0] + 1e-12:
                        best = (value, k)
                return best

            top, cuts = len(edges) + 1, [0, len(edges) + 1]
            if first := cut(0, top):
                cuts.append(first[1])
                more = [c for c in (cut(0, first[1]), cut(first[1], top)) if c]
                if more:
                    cuts.append(max(more, key=lambda c: c[0])[1])
            cuts = sorted(set(cuts))
            for a, b in zip(cuts, cuts[1:]):
                rows = [r for r in range(len(y)) if a <= place[r] < b]
                step = model.rate * leaf(rows, p)
                for r in rows:
                    score[r] += step
    return [1 / (1 + math.exp(-s)) for s in score]


def test_quality_fit_by_hand():
    from polyvane.llm.quality import Additive

    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + 0.5 * np.abs(x[:, 1]) + 0.3 * rng.normal(size=60) > 0.3).astype(float)
    model = Additive(bins=6, rounds=8, pair_rounds=0).fit(x, y)
    assert model.score(x) == pytest.approx(plain_fit(x.tolist(), y.tolist(), model), abs=1e-9)


def test_quality_scores_by_hand(spark):
    """A fitted model's score of a text, from its tables entry by entry."""
    from polyvane.llm.quality import fit_quality, score_quality

    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(documents, labels)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100, None)]
    got = {r.doc_id: r.score for r in score_quality(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for k, t in rows:
        x = brute_features(t or "")
        s = model.base + sum(table[sum(v >= e for e in edges)] for v, edges, table in zip(x, model.edges, model.tables))
        s += sum(table[sum(x[i] >= e for e in model.pair_edges[i])][sum(x[j] >= e for e in model.pair_edges[j])] for i, j, table in model.pairs)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-s)), abs=1e-6), k
    held = score_quality(documents, model).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").collect()
    assert auc([r.score for r in held], [r.quality for r in held]) > 0.98


def blind(spark, fit, score, label, parts, held):
    """Scores don't move when language, source and the labels held out change."""
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    other = documents.withColumn("lang", F.lit("xx")).withColumn("source", F.md5(F.col("doc_id").cast("string")))
    turned = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string")) % parts == held, 1 - F.col(label)).otherwise(F.col(label)))
    base = {r.doc_id: r.score for r in score(documents, fit(documents, labels)).collect()}
    again = {r.doc_id: r.score for r in score(other, fit(other, turned)).collect()}
    assert base == again
    moved = {r.doc_id: r.score for r in score(documents.withColumn("doc_id", F.col("doc_id") + 10 ** 6), fit(documents, labels)).collect()}
    assert {k + 10 ** 6: v for k, v in base.items()} == moved


def test_quality_reads_texts_only(spark):
    from polyvane.llm.quality import fit_quality, score_quality

    blind(spark, fit_quality, score_quality, "quality", 4, 2)


def test_toxicity_reads_texts_only(spark):
    from polyvane.llm.toxicity import fit_toxicity, score_toxicity

    blind(spark, fit_toxicity, score_toxicity, "toxic", 5, 0)


@pytest.mark.parametrize("fit", ["fit_quality", "fit_toxicity"])
def test_ids_of_any_type_and_repeats(spark, fit):
    """Ids that are no numbers are learnt from; an id that recurs is one row of the sample, whatever its copies; empty inputs give constants."""
    import polyvane.llm.quality as q
    import polyvane.llm.toxicity as t

    fit, score, label = (q.fit_quality, q.score_quality, "quality") if fit == "fit_quality" else (t.fit_toxicity, t.score_toxicity, "toxic")
    rng = random.Random(3)
    rows = [(f"id{k}", " ".join(rng.choice(["bad"] * 3 + ["$$"] if k % 2 else ["fine", "good", "calm"]) for _ in range(30 + k % 7)), "clash") for k in range(200)]
    docs = spark.createDataFrame(rows + [rows[0]] * 50 + [(None, "bad bad", "x"), ("e", None, "x")], "doc_id string, text string, id string")
    labels = spark.createDataFrame([(f"id{k}", k % 2) for k in range(200)] + [("e", 1), ("id3", None), (None, 1)], f"doc_id string, {label} int")
    got = score(docs, fit(docs, labels)).collect()
    assert len(got) == docs.count()
    bad, good = ([r.score for r in got if r.doc_id and r.doc_id.startswith("id") and int(r.doc_id[2:]) % 2 == side] for side in (1, 0))
    assert min(bad) > max(good)
    assert {round(r.score, 9) for r in score(docs, fit(docs.limit(0), labels)).collect()} == {0.5 if label == "quality" else 0.0}


def brute_tokens(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {("w", w) for w in words} | {(k, w.encode()[:k]) for w in words for k in (4, 5, 6) if len(w.encode()) >= k}


def test_toxicity_scores_by_hand(spark):
    """Scores are the intercept and the weights of the distinct features of a text, told apart by their bytes."""
    from polyvane.llm.textvec import ALNUM, Words
    from polyvane.llm.toxicity import fit_toxicity, prefix

    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(documents, labels)
    sample = [r.text for r in documents.limit(40).collect()] + TEXTS
    for text in sample:
        total = model.base
        for kind, value in brute_tokens(text):
            w = Words(pa.array([value if kind == "w" else value.decode(errors="ignore") + "z" * 8]), ALNUM)
            if kind != "w" and value.decode(errors="ignore").encode() != value:
                continue  # a beginning that ends inside a character can't be written as a text; it has no weight below
            h = w.h[0] if kind == "w" else prefix(w, kind)[0]
            at = int(np.searchsorted(model.keys, h))
            total += model.weight[at] if at < len(model.keys) and model.keys[at] == h else 0
        got = float(model.score(pa.array([text]))[0])
        if all(k == "w" or v.decode(errors="ignore").encode() == v for k, v in brute_tokens(text)):
            assert got == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
    scores = model.score(pa.array([r.text for r in documents.orderBy("doc_id").collect()]))
    marks = {r.doc_id: r.toxic for r in labels.where("crc32(cast(doc_id as string)) % 5 = 0").collect()}
    ids = [r.doc_id for r in documents.select("doc_id").orderBy("doc_id").collect()]
    held = [(s, marks[i]) for s, i in zip(scores, ids) if i in marks]
    assert auc([s for s, _ in held], [y for _, y in held]) > 0.97


def test_logistic_optimum():
    """Accelerated descent ends where Newton's method on the same loss does."""
    from polyvane.llm.toxicity import fit_logistic

    rng = np.random.default_rng(1)
    n, m = 120, 9
    x = rng.random((n, m)) < 0.4
    y = (x[:, 0] + x[:, 1] * 0.5 + rng.normal(0, 0.5, n) > 0.6).astype(float)
    doc, row = np.nonzero(x)
    pair, pair_row, pair_sign, weight = np.array([0, 0, 1]), np.array([0, 4, 5]), np.array([1.0, -1, 1]), np.array([7.0, 3])
    w, base = fit_logistic(doc, row, y, m, pair, pair_row, pair_sign, weight, ridge=0.3, counterfactual=5.0, steps=20000)
    change = np.zeros((2, m))
    change[pair, pair_row] = pair_sign
    design, v = np.concatenate([x.astype(float), np.ones((n, 1))], 1), np.zeros(m + 1)
    penal = np.zeros((m + 1, m + 1))
    penal[:m, :m] = 0.3 * np.eye(m) + 5.0 * change.T @ (weight[:, None] * change)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ v))
        v -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penal, design.T @ (p - y) + penal @ v)
    assert np.allclose(np.append(w, base), v, atol=1e-4)


def test_counterfactuals_are_active(spark):
    """On texts that name no group the mentions given to them are pairs too; where a name stands in bad company the penalty closes the gap."""
    from polyvane.llm.toxicity import IDENTITY, TERMS, counterfactuals, fit_toxicity

    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert fit_toxicity(documents, labels).active > 0
    pairs = counterfactuals(np.eye(len(TERMS))[TERMS.index("gay")], np.zeros(len(TERMS)))
    assert {TERMS[b] for _, b, _ in pairs} == set(IDENTITY["love"]) - {"gay"} and sum(x[2] for x in pairs) == pytest.approx(1)
    rng = random.Random(2)
    rows = [(i, f"some words {rng.choice('abcdef') * 3} the {'muslim' if i % 4 == 0 and rng.random() < 0.8 else rng.choice(IDENTITY['belief'][:6])} {'dreadful' if i % 4 == 0 and rng.random() < 0.7 else 'fine'}") for i in range(400)]
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    gaps = [fit_toxicity(frame, marks, counterfactual=c).gap for c in (0.0, 1.0, 5.0)]
    assert gaps[0] > 2 * gaps[1] > 2 * gaps[2] >= 0
