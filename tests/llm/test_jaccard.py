"""The Jaccard join against all pairs in plain Python: every boundary between small and large, hot lists, chains, odd rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

KINDS = "doc_id long, text string, n string, bucket string, id string"


def words(text):
    return tuple(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))


def grams(text, k):
    w = words(text)
    return {w[i:i + k] for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute(rows, k, threshold):
    sets = [(i, grams(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted([(i, len(x), None if i is None else find(i)) for i, x in sets], key=str)


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents():
    """Near copies at and about the threshold, chains of them, a line that many share, tiny texts, equal sets of unequal texts, odd rows."""
    rng = random.Random(11)
    rows, at = [], 1000
    for size in (3, 8, 11, 12, 20, 21, 30, 40, 60, 120, 300):
        base = prose(rng, size, 10_000)
        for changes in (0, 0, 1, 1, 2, 3, 6):
            new = list(base)
            for _ in range(min(changes, size // 9)):
                new[rng.randrange(size)] = f"x{rng.randrange(10_000)}"
            if rng.random() < 0.5:
                new = new + prose(rng, rng.randrange(3))
            rows.append((at := at + 1, " ".join(new)))
        drift = list(base)
        for _ in range(6):  # a chain: neighbours link, ends don't
            drift = drift[1:] + prose(rng, 1, 10_000)
            rows.append((at := at + 1, " ".join(drift)))
    line = " ".join(prose(rng, 30))
    rows += [(at + 1 + j, " ".join(prose(rng, rng.randrange(5, 60), 100_000)) + "\n" + line) for j in range(60)]
    hot = prose(rng, 90, 100_000)
    for j in range(150):
        new = list(hot)
        for _ in range(rng.randrange(3)):
            new[rng.randrange(90)] = f"y{j}"
        rows.append((5000 + j, " ".join(new)))
    rows += [(1, None), (2, ""), (3, " \n "), (4, "One"), (5, "one"), (6, "a b"), (7, "A\tB"), (8, "a b a b a b"), (9, "a b a b a b a b"), (10, "c " * 30_000), (11, "C " * 20_000), (12, rows[5][1]), (12, rows[40][1]), (None, rows[5][1]), (None, None), (13, rows[70][1].upper() + "  "), (13, rows[70][1])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return documents()


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], KINDS).repartition(parts)


@pytest.mark.parametrize("threshold,k,small", [(90, 3, None), (90, 3, 0), (90, 3, 24), (80, 2, 14)])
def test_all_pairs(spark, rows, threshold, k, small, monkeypatch):
    from polyvane.llm import jaccard as J
    from polyvane.llm import minhash as M

    monkeypatch.setattr(J, "FREQUENT", 4)
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(M, "BLOCK", 16)
    got = J.jaccard_components(frame(spark, rows), k=k, threshold=threshold, small=small)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, threshold)


def test_no_documents(spark):
    from polyvane.llm.jaccard import jaccard_components

    assert jaccard_components(spark.createDataFrame([], KINDS), k=3, threshold=90).collect() == []
    assert sorted(map(tuple, jaccard_components(frame(spark, [(1, None), (2, " ")]), k=3, threshold=90).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_subsets_meet():
    """Sets of n and m that share exactly what a link needs have a subset in common, those that share one less and no smaller bound have none."""
    from polyvane.llm.jaccard import least_common, subset_count, subsets

    rng = np.random.default_rng(1)
    for n in range(1, 31):
        for m in range(n, 31):
            if 100 * n < 90 * m:
                continue
            c = least_common(n, m, 90)
            if c > n or c == n == m:
                continue
            every = rng.integers(1, 1 << 62, n + m - c).astype(np.uint64)
            a, b = subsets(np.sort(every[:n]), 90), subsets(np.sort(every[n - c:]), 90)
            assert len(a) == subset_count(n, 90) and len(np.intersect1d(a, b))


def test_prefixes_meet():
    from polyvane.llm.jaccard import least_common, prefix_size

    for t in (80, 90):
        for n in range(1, 200):
            for m in range(-(-t * n // 100), n + 1):
                c = least_common(n, m, t)
                # in any order, of c common members the first is within both prefixes
                assert c > m or (n - prefix_size(n, t) < c and m - prefix_size(m, t) < c)


def test_bitmaps_never_rule_out_links():
    from polyvane.llm import jaccard as J

    rng = np.random.default_rng(2)
    kept = dropped = 0
    for n in (5, 20, 127, 128, 129, 700, 40_000):
        base = rng.integers(0, 1 << 62, n).astype(np.uint64)
        for share in (0.0, 0.03, 0.05, 0.08, 0.3, 0.9):
            r = int(n * share)
            other = np.concatenate([base[r:], rng.integers(0, 1 << 62, r + rng.integers(0, 2)).astype(np.uint64)])
            common, whole = len(np.intersect1d(base, other)), len(np.union1d(base, other))
            bits = J.bitmaps(np.concatenate([base, other]), np.array([0, n, n + len(other)]))
            x, y = (np.frombuffer(v.as_buffer(), np.uint64)[None] for v in bits)
            words = min(x.shape[1], y.shape[1])
            differ = np.bitwise_count(J._folded(x, words) ^ J._folded(y, words)).sum(axis=1, dtype=np.int64)
            links, may = 100 * common >= 90 * whole, bool(J.may_link(np.array([n]), np.array([len(other)]), differ, 90)[0])
            assert may or not links
            kept, dropped = kept + may, dropped + (not may)
    assert kept and dropped


def test_boundary_follows_costs():
    from polyvane.llm.jaccard import boundary

    assert boundary({}, 0.5, 90) == 0
    assert boundary({60: 10}, 0.9, 90) == 0  # subsets of large sets are too many
    few, many = (boundary({n: 100 for n in range(1, 40)}, share, 90) for share in (0.0, 1.0))
    assert 0 < few <= many < 40


def test_whole_grams_are_words():
    """Numbers of shingles are equal if and only if the words are, whatever the size of the vocabulary."""
    from polyvane.llm.textvec import NOT_SPACE, whole_grams

    rng = random.Random(3)
    texts = [" ".join(prose(rng, rng.randrange(40), 3000)) for _ in range(200)] + [None, "", "a", "a b", "A  B", "b a", "a b c d e", "a b c d e f", "ab c", "a bc"]
    texts += texts[:20]
    for k in (1, 3, 5, 9):
        value, first = whole_grams(pa.array(texts), NOT_SPACE, k)
        numbers = [set(value[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
        for x, a in zip(texts[::7] + texts[-30:], numbers[::7] + numbers[-30:]):
            for y, b in zip(texts, numbers):
                assert len(a & b) == len(grams(x, k) & grams(y, k))
            assert len(a) == len(grams(x, k))


def test_equal_hashes_are_compared(spark, monkeypatch):
    """With hashes of sets that tell nothing but their size, classes are still those of equal sets."""
    from polyvane.llm import jaccard as J
    from polyvane.llm import minhash as M

    nothing = lambda value, first: (np.zeros(len(first) - 1, np.int64), np.zeros(len(first) - 1, np.int64))
    monkeypatch.setattr(J, "set_sums", nothing)
    monkeypatch.setattr(M, "set_sums", nothing)
    some = [(1, "a b c d e"), (2, "A b c d  e"), (3, "f g h i j"), (4, "k l m n o"), (5, "f g h i j"), (6, "f g h\ni j")]
    assert sorted(map(tuple, J.jaccard_components(frame(spark, some), k=3, threshold=90).collect())) == [(1, 3, 1), (2, 3, 1), (3, 3, 3), (4, 3, 4), (5, 3, 3), (6, 3, 3)]
    near = M.near_duplicates(frame(spark, some), k=3, threshold=80)
    assert sorted((r.doc_id, r.component_id) for r in near.collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 3), (6, 3)]
