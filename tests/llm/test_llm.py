"""The llm operators: edge cases, brute-force versions, round trips, held-out accuracy."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
WORDS = "lo mi ta re su ke vo na pi da el or".split()
DOCS = "doc_id long, text string, source string, lang string, digest string, id string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Nulls, empties, ties, repeats, one very long text, near copies and shared passages."""
    rng = random.Random(5)
    base, passage, line = prose(rng, 120), prose(rng, 70), "This line is long enough to count as a repeated line."
    near = base.split()
    near[50] = "changed"
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, base), (4, base), (5, " ".join(near)), (6, "Ünïcode " + passage + "\n" + line), (7, passage.upper() + "\n" + line), (8, passage + " " + prose(rng, 90) + "\n" + line),
            (9, prose(rng, 3)), (10, "one"), (11, "one"), (12, f"{line}\n  {line.upper()}\t\n" + prose(rng, 40)), (13, f"{line}\n\n{line}"), (14, "x" * 60_000 + " " + prose(rng, 20_000)), (15, "zz" * 150), (15, "zz" * 150), (None, base)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, ["a", "b", None][k % 3], "en", "clash", "clash") for k, (i, t) in enumerate(texts)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_exact(spark, docs, none, texts):
    from polyvane.llm.exact import exact_dedup, exact_flags

    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    want = []
    for ids in groups.values():
        top, stays = max((i for i in ids if i is not None), default=None), 0
        for i in ids:
            stays += i == top
            want.append((i, top, len(ids), i == top and stays == 1))
    flags = lambda **more: sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_flags(docs, **more).collect()), key=str)
    assert flags() == sorted(want, key=str)
    # with digests and tags that tell nothing, contents are still told apart, and nothing stops
    assert flags(digest=lambda t: F.lit("same")) == sorted(want, key=str)
    assert flags(digest=lambda t: F.lit("same"), tag=lambda t: F.lit(7).cast("long")) == sorted(want, key=str)
    assert exact_dedup(docs).columns == docs.columns
    kept = exact_dedup(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(max(x for x in ids if x is not None) for ids in groups.values())
    assert len({r.text or "" for r in kept}) == len(kept)
    assert exact_flags(none).count() == 0 and exact_dedup(none).count() == 0


def test_exact_dedup_of_odd_columns(spark):
    """Null ids, null texts, equal rows, columns named like the operator's own and of types without an order."""
    from polyvane.llm.exact import exact_dedup

    rows = [(None, "a", {"k": 1}, "x", [1]), (None, "a", {"k": 2}, "x", [1]), (1, None, None, None, None), (1, "", {}, "y", []), (2, "b", {"k": 1}, "z", [2]), (2, "b", {"k": 1}, "z", [2])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, held map<string,int>, body string, `rank` array<int>")
    got = exact_dedup(frame)
    assert got.schema.simpleString() == frame.schema.simpleString()
    assert sorted(((r.doc_id, r.text, r.held, r.body, r["rank"]) for r in got.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_registered_sql_on_edge_rows(spark, texts, tmp_path):
    """Queries and their SQL agree on nulls, empties, ties and ids that repeat."""
    import duckdb

    from polyvane.llm import queries

    spark.createDataFrame([(i, t, ["a", "b", None][k % 3]) for k, (i, t) in enumerate(texts + [(15, "zz" * 150 + "\n" + "q" * 50)] + [(60 + k, "q" * 50) for k in range(4)])], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op6_lines", "op10_exact"):
        got = queries.queries()[name](spark, str(tmp_path))
        rows = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)


def test_sainte_lague(spark):
    from polyvane.llm.mixing import sainte_lague

    rng = random.Random(1)
    for n, seats in ((1, 7), (5, 100), (40, 333), (3, 0)):
        weights = [round(rng.paretovariate(0.8), 3) for _ in range(n)]
        won = [0] * n
        for _ in range(seats):
            won[max(range(n), key=lambda k: (weights[k] / (2 * won[k] + 1), -k))] += 1
        rows = spark.createDataFrame([(1, k, w, seats) for k, w in enumerate(weights)], "g int, k int, w double, seats long")
        assert [r.quota for r in sainte_lague(rows, ["g"], [F.col("k")], "w", "seats").orderBy("k").collect()] == won


def test_mix(docs, none, texts):
    from polyvane.llm.mixing import mix

    rows = mix(docs).collect()
    assert len(rows) == len(texts)
    size = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
    target = {r.source: r.target for r in rows}
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == size[r.source]
    cap, share, open_ = {}, {}, dict(zip(("a", "b", None), (3, 1, 2)))
    left = 1.5 * sum(size.values())
    while True:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in share if share[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            cap[s] = 2 * size[s]
            left -= cap[s]
            del open_[s]
    for s, want in (cap | share).items():
        assert abs(target[s] - want) < 1e-6 * max(want, 1) and abs(taken[s] - want) <= max(5, 0.02 * want)
    assert sorted(map(tuple, mix(docs).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mix(none).count() == 0


def test_mix_takes_its_targets(spark):
    """Small sources at their cap, documents of very unequal length, several to a shard and none: nothing of a target is lost."""
    from polyvane.llm.mixing import mix

    rng = random.Random(4)
    rows = [(0, "", "blank"), (1, None, "blank")]
    for s, n in enumerate((900, 300, 150, 40, 3)):
        rows += [(len(rows) + k, "w " * int(rng.lognormvariate(6, 1.2)), f"s{s}") for k in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(frame).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    full = {s for s in size if target[s] == 2 * size[s]}
    assert {"s4", "blank"} <= full and len(full) < len(size)
    assert all(r.taken == 2 * r.size for r in got if r.source in full)
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert abs(sum(taken.values()) - sum(target.values())) <= 0.5
    assert [r.taken for r in mix(frame.where("source = 'blank'")).collect()] == [0, 0]


def test_mix_selects_blocks(spark, monkeypatch):
    """Each shard's rest is what its blocks give in seeded order, token by token, and lies all over the tape."""
    from polyvane.llm import mixing

    rng = random.Random(6)
    rows = [(k, "w " * rng.choice((0, 1, 7, 60, 700)), rng.choice(("a", "a", "a", "b", None))) for k in range(1500)]
    monkeypatch.setattr(mixing, "BLOCK", 16)
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    tapes, target = defaultdict(list), {}
    for r in sorted(got, key=lambda r: hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()):
        tapes[r.source, r.shard].append(r)
        target[r.source] = r.target
    block = max(1, min(16, int(min(t for t in target.values() if t > 0) // (8 * 64))))
    assert block > 4
    scattered = 0
    for (_, shard), tape in tapes.items():
        owner = [k for k, r in enumerate(tape) for _ in range(r.size)]
        words, cell = sum(r.taken for r in tape), len(owner)
        if not cell:
            continue
        rounds, rest = (2, 0) if words == 2 * cell else divmod(words, cell)
        taken = [rounds * r.size for r in tape]
        for b in sorted(range(-(-cell // block)), key=lambda b: (hashlib.md5(f"17:{shard}:{b}".encode()).hexdigest(), b)):
            some = owner[b * block:(b + 1) * block][:rest]
            rest -= len(some)
            for k in some:
                taken[k] += 1
        assert taken == [r.taken for r in tape]
        partly = [k for k, r in enumerate(tape) if r.size and r.taken % r.size]
        scattered += len(partly) > 2
    assert scattered > 20


def brute_windows(text, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [tuple(words[k:k + window]) for k in range(max(len(words) - window, 0) + 1)] if words else []


@pytest.mark.parametrize("most", [500_000, 0])
def test_decontamination(spark, docs, none, texts, most, monkeypatch):
    from polyvane.llm import decontam
    from polyvane.llm.decontam import decontaminate, remove_contaminated

    monkeypatch.setattr(decontam, "MAX_BROADCAST", most)
    passage = texts[6][1].split("\n")[0].split(" ", 1)[1]
    items = [(1, " ".join(passage.split()[5:25])), (2, "one"), (3, None), (4, ""), (5, "never seen words here"), (6, "lo mi"), (6, "Changed"), (None, "zz")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {(("" if i is None else str(i)), w) for i, t in items for w in brute_windows(t)[1]}
    want = []
    for i, t in texts:
        words, _ = brute_windows(t)
        hit, found = set(), set()
        for item, w in windows:
            for k in range(len(words) - len(w) + 1):
                if tuple(words[k:k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
                    found.add(item)
        want.append((i, len(words), len(hit), sorted(found)))
    got = decontaminate(docs, bench).collect()
    assert sorted(((r.doc_id, r.n_words, sum(b - a for a, b in zip(r.starts, r.ends)), sorted(r["items"])) for r in got), key=str) == sorted(want, key=str)
    assert sorted((r.doc_id for r in remove_contaminated(docs, bench).collect()), key=str) == sorted((w[0] for w in want if not w[2]), key=str)
    assert decontaminate(none, bench).count() == 0 and decontaminate(docs, bench.limit(0)).where("size(starts) > 0").count() == 0


def test_decontamination_of_a_hot_passage(spark):
    """A passage that 2,000 items and a third of the documents hold: occurrences are confirmed once, whatever items hold the window."""
    from polyvane.llm.decontam import _search, decontaminate

    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(14))
    bench = spark.createDataFrame([(i, f"{prose(rng, 3)} {passage} {prose(rng, 3)}") for i in range(2000)], "item_id long, text string")
    rows = [(i, f"{prose(rng, 20)} {passage} {prose(rng, 20)}" if i % 3 == 0 else f"q{i} " * 30) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate(docs, bench).collect()}
    for i, _ in rows:
        inside = [x for x in zip(got[i].starts, got[i].ends)]
        assert (len(got[i]["items"]), bool(inside)) == ((2000, True) if i % 3 == 0 else (0, False))
    searched, found, _ = _search(docs.toDF("id", "text"), bench, 10, "item_id", "text")
    assert found.groupBy("row").count().agg(F.max("count")).first()[0] < 50
    assert searched.count() == 240


def test_warc(spark):
    from polyvane.llm.warc import read_warc, resolve, write_warc
    from polyvane.llm.work import Work

    big = "<p>Größe</p>" * 20
    rows = [(3, "http://a\r\nX: y", big, 1), (1, None, big, 1), (2, "http://b", big, 1), (4, "http://c", None, 1), (5, "http://d", "short", 1), (6, "http://e", "short", 1), (7, "http://f", "y" * 300_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    index = write_warc(pages, Work(spark, "t").path)
    assert index.count() == 7
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in resolve(read_warc(index)).collect()}
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        again = html == big and page != 1
        assert got[page] == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None)
    some = read_warc(index.where("url = 'http://f'")).collect()
    assert [(r.page_id, r.payload) for r in some] == [(7, "y" * 300_000)]
    assert resolve(read_warc(write_warc(pages.limit(0), Work(spark, "t").path))).count() == 0


def test_warc_of_null_and_repeated_ids(spark):
    """A null page id ranks above all others; rows that repeat the smallest id of a group are all responses."""
    from polyvane.llm.warc import read_warc, resolve, write_warc
    from polyvane.llm.work import Work

    big, lone = "<p>same</p>" * 30, "<p>lone</p>" * 30
    rows = [(None, "http://n", big), (5, "http://a", big), (5, "http://b", big), (9, "http://c", big), (None, "http://d", lone), (None, "http://e", "short"), (5, "http://f", lone + "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((r.url, r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in resolve(read_warc(write_warc(pages, Work(spark, "t").path))).collect())
    kind = {"http://n": ("revisit", 5), "http://c": ("revisit", 5)}
    assert got == sorted((u, i, len(t), hashlib.sha256(t.encode()).hexdigest(), *kind.get(u, ("response", None))) for i, u, t in rows)


def brute_repeats(texts, match=200):
    raw = [(t or "").encode() for _, t in texts]
    seen = Counter(b[k:k + match] for b in raw for k in range(len(b) - match + 1))
    out = []
    for (i, _), b in zip(texts, raw):
        gone = bytearray(len(b))
        for k in range(len(b) - match + 1):
            if seen[b[k:k + match]] > 1:
                gone[k:k + match] = b"\1" * match
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix(docs, none, texts):
    from polyvane.llm.suffix import remove_repeats

    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.starts), (hashlib.sha256(bytes(r.kept)) if r.kept is not None else hashlib.sha256()).hexdigest() if r.kept is not None else bytes(r.sha256).hex()) for r in remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_repeats(texts), key=str)
    assert remove_repeats(none).count() == 0


def shard_of_runs(match, n=4000, kinds=2):
    """Runs of a text with repeats, sorted by anchor, as the table that a sorting task gets; and their windows."""
    from polyvane.llm.suffix import runs

    rng = np.random.default_rng(3)
    raw = rng.integers(0, kinds, n, dtype=np.uint8)
    raw[n // 2 - 500:n // 2 - 100] = raw[200:600]
    first, count, off, a = runs(raw, np.array([0, n // 2, n]), match)
    order = np.argsort(a.view(np.int64), kind="stable")
    first, count, off, a = first[order], count[order], off[order], a[order]
    names = np.arange(len(a))
    table = pa.table({"a": a.view(np.int64), "off": off.astype(np.int32), "region": pa.array([raw[x:x + n + match - 1].tobytes() for x, n in zip(first, count)], pa.binary()),
                      "r1": names, "r2": -names, "n": np.ones(len(a), np.int64)})
    return table, [[raw[x + k:x + k + match].tobytes() for k in range(n)] for x, n in zip(first, count)]


def flagged(batches, windows):
    out = [[False] * len(w) for w in windows]
    for b in batches:
        for r1, r2, lo, hi in zip(*(b.column(k).to_pylist() for k in range(4))):
            assert r1 == -r2 and 0 <= lo < hi <= len(out[r1])
            out[r1][lo:hi] = [True] * (hi - lo)
    return out


@pytest.mark.parametrize("block", [8 << 20, 2000, 0])
def test_induced_sorting(block):
    """In memory, and with a shard of many anchors on disk, from its first batch on or from a later one."""
    from polyvane.llm.suffix import _sort_shard

    table, windows = shard_of_runs(40)
    seen = Counter(w for run in windows for w in run)
    found = flagged(_sort_shard(40, block)(iter(table.to_batches(max_chunksize=7))), windows)
    assert found == [[seen[w] > 1 for w in run] for run in windows]


def one_anchor(m, match=200, seed=1):
    """Distinct runs of one anchor, in random surroundings of few letters, some of them alike."""
    rng = np.random.default_rng(seed)
    core, off = bytes(range(65, 65 + 32)), rng.integers(0, 160, m).astype(np.int32)
    rows, seen = [], set()
    for k in range(m):
        side = bytes(rng.integers(97, 99, int(off[k]), dtype=np.uint8)) if k % 3 else (b"ab" * 100)[:int(off[k])]
        rest = (b"xy" * 200)[:match - 32 - int(off[k]) + int(rng.integers(0, int(off[k]) + 1))] if k % 2 else bytes(rng.integers(120, 122, match - 32, dtype=np.uint8))
        region = side + core + rest
        if region + bytes([off[k]]) not in seen:
            seen.add(region + bytes([off[k]]))
            rows.append((5, int(off[k]), region))
    names = np.arange(len(rows))
    return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "off": pa.array([r[1] for r in rows], pa.int32()), "region": pa.array([r[2] for r in rows], pa.binary()),
                     "r1": names, "r2": -names, "n": np.ones(len(rows), np.int64)}), rows


@pytest.mark.parametrize("part,fan", [(64, 2), (640, 64), (1 << 18, 64)])
def test_external_sorting(part, fan):
    """One anchor on disk, with queues of many small runs: the same windows as by brute force."""
    from polyvane.llm.suffix import External

    table, rows = one_anchor(900)
    windows = [[(r[1] - k, r[2][k:k + 200]) for k in range(len(r[2]) - 199)] for r in rows]
    seen = Counter(w for run in windows for w in run)
    large = External(200, part, fan)
    for batch in table.to_batches(max_chunksize=100):
        large.add(pa.Table.from_batches([batch]))
    want = [[seen[w] > 1 for w in run] for run in windows]
    assert any(map(any, want)) and flagged(large.spans(), windows) == want


def test_external_sorting_is_bounded():
    """A hundred thousand runs (40 MB) of an anchor that others follow: the sorting task's arrays stay small."""
    import tracemalloc

    from polyvane.llm.suffix import _sort_shard

    rng = np.random.default_rng(2)
    m, off = 100_000, 100
    text = rng.integers(97, 123, (m, 400), dtype=np.uint8)
    text[:, off:off + 32] = 65
    offs = pa.py_buffer((np.arange(m + 1) * 400).astype(np.int32))
    region = pa.BinaryArray.from_buffers(pa.binary(), m, [None, offs, pa.py_buffer(text)])
    names = np.arange(m)
    table = pa.table({"a": np.where(names < m - 50, 1, 2), "off": np.full(m, off, np.int32), "region": region, "r1": names, "r2": -names, "n": np.ones(m, np.int64)})
    tracemalloc.start()
    out = list(_sort_shard(200, 1 << 20)(iter(table.to_batches(max_chunksize=2000))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 0 and peak < 120e6


def test_op4_goes_through_its_queues(spark, tmp_path, monkeypatch):
    """The registered query on shards of 20 times the memory that sorting may use: all runs go through the queues, and the rows are those of brute force."""
    from polyvane.llm import suffix
    from polyvane.llm.queries import op4_suffix

    rng = np.random.default_rng(8)
    prose = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = [prose(int(n)) for n in rng.integers(200, 900, 12)]
    texts = [prose(int(rng.integers(0, 80))) + shared[k % 12][:int(rng.integers(150, 900))] + prose(int(rng.integers(0, 80))) for k in range(120)]
    frame = spark.createDataFrame(list(enumerate([*texts, None, "", texts[0], "ab" * 300])), "doc_id long, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted(op4_brute(frame))
    runs_in_memory = sorted(map(tuple, op4_suffix(spark, str(tmp_path)).collect()))
    counter = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(suffix, "BLOCK", 2000)
    monkeypatch.setattr(suffix, "SHARD", 40_000)
    monkeypatch.setattr(suffix, "QUEUED", counter)
    through = sorted(map(tuple, op4_suffix(spark, str(tmp_path)).collect()))
    assert counter.value > 40_000
    assert through == runs_in_memory == want and sum(r[2] > 0 for r in want) > 60


def op4_brute(frame):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, window by window."""
    rows = [(r.doc_id, (r.text or "").encode()) for r in frame.select("doc_id", "text").collect()]
    seen = Counter(b[k:k + 200] for _, b in rows for k in range(len(b) - 199))
    for i, b in rows:
        gone = [False] * len(b)
        for k in range(len(b) - 199):
            if seen[b[k:k + 200]] > 1:
                gone[k:k + 200] = [True] * 200
        spans = sum(x and not y for x, y in zip(gone, [False, *gone], strict=False))
        yield i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


def test_hot_anchor_is_split(spark):
    """Runs of one anchor dealt by distance and shared bytes, level by level: the same spans as unsplit, and no large group."""
    from polyvane.llm.suffix import _repeated_runs
    from polyvane.llm.work import Work

    table, rows = one_anchor(400)
    frame = spark.createDataFrame([(a, off, bytearray(region), k, -k, 1) for k, (a, off, region) in enumerate(rows)], "a long, off int, region binary, r1 long, r2 long, n long")
    windows = [[(r[1] - k, r[2][k:k + 200]) for k in range(len(r[2]) - 199)] for r in rows]
    seen = Counter(w for run in windows for w in run)
    for hot in (10 ** 9, 20):
        work = Work(spark, "split")
        found = _repeated_runs(frame, work, 200, hot=hot).toArrow().combine_chunks().to_batches()
        assert flagged(found, windows) == [[seen[w] > 1 for w in run] for run in windows]
    last = spark.read.parquet(f"{work.path}/parts-w1")
    assert last.groupBy("b").agg(F.countDistinct("s1").alias("c")).agg(F.max("c")).first()[0] == 1


def brute_near(texts, k, threshold):
    sets = []
    for _, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(words[j:j + k]) for j in range(max(len(words) - k, 0) + 1)} if words else set())
    part = list(range(len(texts)))

    def find(x):
        return x if part[x] == x else find(part[x])

    for x in range(len(texts)):
        for y in range(x):
            if sets[x] and texts[x][0] is not None and texts[y][0] is not None and 100 * len(sets[x] & sets[y]) >= threshold * len(sets[x] | sets[y]):
                part[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(texts):
        least[find(x)] = min(i, least.get(find(x), i)) if i is not None else least.get(find(x))
    return sorted(((i, len(sets[x]), least[find(x)] if i is not None else None) for x, (i, _) in enumerate(texts)), key=str)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, docs, none, texts, k):
    from polyvane.llm.minhash import near_duplicates

    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, k).collect()), key=str)
    assert got == brute_near(texts, k, 80)
    assert near_duplicates(none).count() == 0


def test_near_family(spark):
    """Copies of one text that are too far from each other, links only along chains, and families of non-links in one bucket."""
    from polyvane.llm.minhash import near_duplicates

    rng = random.Random(9)
    rows = []
    for f in range(3):
        base = [f"w{rng.randrange(500)}" for _ in range(130)]
        for c in range(25):
            copy = list(base)
            for _ in range(rng.randrange(1, 9)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(frame, 4).collect()), key=str) == brute_near(rows, 4, 80)


@pytest.mark.parametrize("most", [3_000_000, 1])
def test_lines(spark, docs, none, texts, most):
    from polyvane.llm.lines import line_dedup

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))

    rows = texts[:-1]  # ids that say which document is the last
    held = defaultdict(list)
    for i, t in rows:
        for x in {key(x) for x in (t or "").split("\n")}:
            if len(x) >= 40:
                held[x].append(i)
    want = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(held.get(key(x), ())) < 4 or max(held[key(x)]) == i]
        want.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    got = line_dedup(docs.where("doc_id is not null"), least_docs=4, max_entries=most, shard=1 if most == 1 else 200_000)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(w[2] for w in want) > 0 and line_dedup(none).count() == 0


def test_perfect_hash():
    from polyvane.llm.lines import PerfectHash
    from polyvane.llm.textvec import mix

    keys = mix(np.arange(1, 5001, dtype=np.uint64))
    index = PerfectHash(keys)
    assert sorted(index(keys).tolist()) == list(range(5000))


def test_chat(spark):
    from polyvane.llm.chat import format_chats, unescape, with_masked_text

    hard = ["", "</turn>", "a </turn>\n### user: b", "#", "####", "\\", "\\#", "\\\\", "<\\/turn>", "x\n", " y ", "é ### z", ":", "</turn", "##", "t </turn> ", None]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(hard)] + [(2, 0, "a: b", "x"), (2, 0, "a: b", "x"), (2, None, None, "first"), (3, 0, "### user", "q"), (None, 1, "assistant", "n")]
    rows += [(4, 0, "user", "y" * 200_000), (4, 1, "assistant", "\\" * 30_000 + "é</turn>" * 5_000)]
    chats = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chats.collect()}
    assert all(r.round_trip for r in got.values()) and len(got) == 5
    want = defaultdict(list)
    for c, k, role, t in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", t or ""))
    for c, r in got.items():
        assert [(t.role, t.text) for t in r.turns] == want[c]
    raw = [got[1].formatted[s.start:s.start + s.length] for s in got[1].loss_spans]
    back = spark.createDataFrame([(x,) for x in raw], "x string").select(unescape(F.col("x")).alias("x")).collect()
    assert [r.x for r in back] == [t for role, t in want[1] if role == "assistant"]
    read = {r.conv_id: r.x for r in with_masked_text(chats, name="x").collect()}
    assert read == {c: "".join(t for role, t in want[c] if role == "assistant") for c in want}
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_conversation(spark):
    """Twenty times the turns take about twenty times as long, not four hundred times."""
    import time

    from polyvane.llm.chat import format_chats, with_masked_text

    def took(n):
        turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "CASE id % 2 WHEN 1 THEN 'assistant' ELSE 'user' END AS role", "concat(repeat('é#x ', 80), id) AS text")
        start = time.time()
        r = with_masked_text(format_chats(turns), keep=("round_trip",)).selectExpr("round_trip", "sha2(loss, 256) AS h").first()
        assert r.round_trip and r.h == hashlib.sha256("".join(f"{'é#x ' * 80}{k}" for k in range(1, n, 2)).encode()).hexdigest()
        return time.time() - start

    took(100)
    assert took(20_000) < 20 + 40 * took(1000)


def test_chat_query_reads_its_mask(spark, tmp_path, monkeypatch):
    """With a mask that is off by one, the query's loss is off too: it reads the text under the mask and nothing else."""
    from polyvane.llm import chat, queries

    spark.createDataFrame([(1, 0, "user", "a#"), (1, 1, "assistant", "bc#d")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    digest = lambda: {r.conv_id: r.loss_sha256 for r in queries.op7_chat(spark, str(tmp_path)).collect()}
    right = digest()
    assert right[1] == hashlib.sha256(b"bc#d").hexdigest()
    whole = chat.format_chats
    monkeypatch.setattr(chat, "format_chats", lambda *a: whole(*a).withColumn("loss_spans", F.transform("loss_spans", lambda x: F.struct((x["start"] + 1).alias("start"), x["length"].alias("length")))))
    assert all(right[k] != v for k, v in digest().items())


def test_pairs_tell_what_single_features_cannot():
    from polyvane.llm.quality import Additive

    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (4000, 2)).astype(float)
    y = (x[:, 0] != x[:, 1]).astype(float)  # only the pair table can tell
    assert (((Additive(rounds=5).fit(x, y).score(x)) > 0.5) == (y == 1)).all()


def test_scores_on_edge_rows(spark, docs, none):
    from polyvane.llm.quality import fit_quality, score_quality
    from polyvane.llm.toxicity import fit_toxicity, score_toxicity

    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    for model, score in ((fit_quality(documents, labels), score_quality), (fit_toxicity(documents, labels), score_toxicity)):
        scores = score(docs, model).collect()
        assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores) and score(none, model).count() == 0
    assert fit_quality(documents, labels.limit(0)).constant == 0.5
    assert {r.score for r in score_toxicity(docs, fit_toxicity(documents, labels.limit(0))).collect()} == {score_toxicity(docs, fit_toxicity(documents, labels.limit(0))).first().score}
