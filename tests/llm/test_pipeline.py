"""The pipeline stage by stage against plain Python, and on rows at the edges."""

import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from test_llm import brute_near, brute_windows, prose

SF = "/root/testdata/sf0.01"


def brute_kept(name, rows, spark, docs):
    """The ids that a stage keeps of rows(doc_id, text)."""
    import corpus_pipeline
    from polyvane.llm.quality import features, fit_quality

    if name == "quality":
        model = fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
        return [i for (i, t) in rows if model.score(features(pa.array([t or ""])))[0] >= corpus_pipeline.QUALITY]
    if name == "exact":
        top = defaultdict(list)
        for i, t in rows:
            top[t or ""].append(i)
        return [max(ids) for ids in top.values()]
    if name == "near":
        return [i for i, _, c in brute_near(rows, 5, 80) if i == c]
    windows = {w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in brute_windows(r.text)[1]}
    sizes = {len(w) for w in windows}
    clean = lambda words: not any(tuple(words[k:k + n]) in windows for n in sizes for k in range(len(words) - n + 1))
    return [i for i, t in rows if clean(brute_windows(t)[0])]


def test_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "benchmark", "mix"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want = brute_kept(name, rows, spark, docs)
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(want) and 0 < len(want) < len(rows), name
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    left = {r.doc_id: r for r in docs.collect()}
    assert got.keys() == left.keys()
    size, taken, target = Counter(), Counter(), {}
    for i, r in got.items():
        assert r.source == left[i].source and r.size == len(re.findall(r"[^\x20\x09-\x0D]+", left[i].text or "")) and 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(size))}
    want, free, rest = {}, set(size), 1.5 * sum(size.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            want |= {s: level * weight[s] for s in free}
            break
        want |= {s: 2 * size[s] for s in over}
        rest -= sum(2 * size[s] for s in over)
        free -= over
    assert all(abs(target[s] - want[s]) < 1e-6 * want[s] and abs(taken[s] - want[s]) <= 2 for s in size)


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls in every column, empty and repeated rows, a very long text, and columns named like the operators' own."""
    import random

    rng = random.Random(7)
    base = prose(rng, 150)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, base, "en", "a"), (2, base, "en", "b"), (2, base, "en", "b"), (3, base + " tail", None, None), (4, None, "en", "a"), (5, "", None, "b"), (None, "some text of no id " + base, "en", "a"), (None, None, None, None),
            (6, prose(rng, 40_000), "fr", "c"), (7, prose(rng, 60) + " " + item, "en", "a"), (8, "x" * 100_000, "en", "c"), (9, prose(rng, 200), "en", "a")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, row long, digest string, rep string, token string, `_digest` string, `_gone` long, body string, score double"
    return spark.createDataFrame([(*r, len(r[1] or ""), "i", 1, "d", "r", "t", "x", 2, "b", 0.5) for r in rows], schema), rows


def test_stages_on_edge_rows(spark, edges):
    import corpus_pipeline

    docs, rows = edges
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = Counter((r.doc_id, r.text) for r in out.collect())
        assert not kept - Counter((r[0], r[1]) for r in rows), name
        if name == "exact":
            assert {i for i, _ in kept} == {2, 3, None, 5, 6, 7, 8, 9} and len({t or "" for _, t in kept}) == sum(kept.values()) == 8
        if name == "near":
            assert {i for i, _ in kept} == {1, 4, 5, None, 6, 7, 8, 9}
        if name == "benchmark":
            assert {i for i, _ in kept} == {i for i, *_ in rows} - {7}
    mixed = corpus_pipeline.mix_stage(spark, docs, SF).collect()
    assert len(mixed) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in mixed)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_quality_stage_without_labels(spark, edges, tmp_path):
    """Without a label nothing is rejected: every score is one half."""
    import corpus_pipeline

    docs, rows = edges
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).count() == len(rows)


def test_scope_cleans_up(spark):
    from polyvane.llm.exact import exact_flags
    from polyvane.llm.work import _open, qualified, scope

    before = len(_open)
    with scope():
        exact_flags(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
        path = _open[-1].path
        assert len(_open) == before + 1
    local = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert len(_open) == before and not local.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(local)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    old = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "hdfs://nn:8020")
    try:
        assert qualified(spark, "/shared/x") == "hdfs://nn:8020/shared/x" and qualified(spark, "file:/a/b") == "file:///a/b"
    finally:
        conf.set("fs.defaultFS", old)
