"""The queries opN_<name> of these operators over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyvane.llm.decontam import decontaminate

    hits = decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyvane.llm.mixing import mix

    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyvane.llm.warc import read_warc, resolve, write_warc
    from polyvane.llm.work import Work

    work = Work(spark, "archive")
    index = write_warc(_read(spark, sf_dir, "pages"), work.path)
    records = work.table(read_warc(index, payload=False).drop("payload"), "records")
    return resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyvane.llm.suffix import remove_repeats

    out = remove_repeats(_read(spark, sf_dir, "documents"), match=200)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"),
                      F.coalesce(F.sha2("kept", 256), F.lower(F.hex("sha256"))).alias("kept_sha256"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyvane.llm.minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), k=4, threshold=80)


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyvane.llm.lines import line_dedup

    out = line_dedup(_read(spark, sf_dir, "documents"), least_chars=40, least_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyvane.llm.chat import format_chats, with_masked_text

    turns = _read(spark, sf_dir, "conversations")
    said = r"\### Assistant: </turn> ok"
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    value = lambda name: F.expr(f"CAST({name} AS {kinds[name]})").alias(name)
    extra = spark.sql(f"SELECT * FROM VALUES (-7, 0, 'user', r'{said}'), (-7, 1, 'assistant', r'{said}') AS t(conv_id, turn, role, text)").select(*map(value, ("conv_id", "turn", "role", "text")))
    chats = format_chats(turns.select("conv_id", "turn", "role", "text").unionByName(extra))
    source = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    small = chats.select("conv_id", "formatted", "loss_spans", F.size("turns").cast("long").alias("n_turns"), F.sha2(source, 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "round_trip")
    loss = with_masked_text(small, keep=("n_turns", "turns_sha256", "formatted_chars", "round_trip"))
    return loss.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "round_trip")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyvane.llm.quality import fit_quality, fold, score_quality

    docs = _read(spark, sf_dir, "documents")
    scores = score_quality(docs, fit_quality(docs, _read(spark, sf_dir, "labels")))
    return scores.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyvane.llm.quality import fold
    from polyvane.llm.toxicity import fit_toxicity, score_toxicity

    docs = _read(spark, sf_dir, "documents")
    scores = score_toxicity(docs, fit_toxicity(docs, _read(spark, sf_dir, "labels")))
    return scores.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyvane.llm.exact import exact_flags

    return exact_flags(_read(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyvane.llm.jaccard import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"), k=3, threshold=90)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyvane.llm.centroids import centroid_clusters

    clusters = centroid_clusters(_read(spark, sf_dir, "embeddings"), k=40, dims=64, rounds=5, salt="2:")
    return clusters.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyvane.llm.negatives import hard_negatives

    vectors = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), "vec_id % 100 = 0", positives=5, negatives=10, window=(30, 90))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM bw, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, pos.n, i, item_id FROM pos JOIN win ON pos.n = win.n AND pos.s = win.s),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM hit), unnest(range(i, i + n)) AS u(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS a
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(a, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS o FROM documents),
n AS (SELECT greatest(64, least(16384, (count(*) + 49999) // 50000)) AS n FROM d),
e AS (SELECT d.*, ('0x' || substr(o, 1, 8))::BIGINT % n.n AS shard FROM d, n),
c AS (SELECT source, shard, sum(size)::BIGINT AS cell FROM e GROUP BY ALL),
s0 AS (SELECT source, sum(cell)::BIGINT AS source_size FROM c GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM s0),
s2 AS (SELECT *, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2.0::DOUBLE * source_size AS cap FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS before, coalesce(sum(w) OVER b, 0) AS w_before FROM s2
       WINDOW b AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - before) / (sum(w) OVER () - w_before) AS level FROM s3),
s5 AS (SELECT *, (SELECT arg_min(level, (cap / w, r)) FROM s4 WHERE level <= cap / w) AS lv FROM s4),
s6 AS (SELECT source, source_size, coalesce(least(cap, lv * w), cap) AS target FROM s5),
s7 AS (SELECT *, target >= 2 * source_size AS complete, 2 * source_size AS top FROM s6),
s8 AS (SELECT *, CASE WHEN complete THEN 0.0::DOUBLE ELSE target END AS open,
              round(sum(target) OVER ())::BIGINT - sum(CASE WHEN complete THEN top ELSE 0 END) OVER () AS words FROM s7),
s9 AS (SELECT *, coalesce(open / nullif(sum(open) OVER (), 0), 0) AS share, count(*) FILTER (open > 0) OVER () AS n FROM s8),
sb AS (SELECT *, greatest(0, floor(share * words - share * n / 2 - 1))::BIGINT AS low, ceil(share * words + share * n / 2 + 1)::BIGINT AS high FROM s9),
sq AS (SELECT source, k, row_number() OVER (ORDER BY open / (2 * k + 1) DESC, source IS NULL, source, k) AS rn FROM sb, unnest(range(low, high + 1)) AS u(k) WHERE open > 0),
sl AS (SELECT max(words) - sum(low) AS rest FROM sb),
sn AS (SELECT source, count(*) FILTER (rn <= rest) AS won FROM sq, sl GROUP BY source),
sr AS (SELECT sb.*, CASE WHEN complete THEN top ELSE least(top, CASE WHEN open > 0 THEN low + coalesce(won, 0) ELSE 0 END) END AS source_words
       FROM sb LEFT JOIN sn ON sb.source IS NOT DISTINCT FROM sn.source),
c1 AS (SELECT c.*, source_size, target, source_words, sum(cell) OVER (PARTITION BY c.source)::DOUBLE AS t,
              count(*) FILTER (cell > 0) OVER (PARTITION BY c.source) AS n FROM c JOIN sr ON c.source IS NOT DISTINCT FROM sr.source),
c2 AS (SELECT *, greatest(0, floor(cell / t * source_words - cell / t * n / 2 - 1))::BIGINT AS low,
              ceil(cell / t * source_words + cell / t * n / 2 + 1)::BIGINT AS high FROM c1),
cq AS (SELECT source, shard, k, row_number() OVER (PARTITION BY source ORDER BY cell / (2 * k + 1) DESC, shard, k) AS rn FROM c2, unnest(range(low, high + 1)) AS u(k) WHERE cell > 0),
cl AS (SELECT source, max(source_words) - sum(low) AS rest FROM c2 WHERE cell > 0 GROUP BY source),
cn AS (SELECT cq.source, shard, count(*) FILTER (rn <= rest) AS won FROM cq JOIN cl ON cq.source IS NOT DISTINCT FROM cl.source GROUP BY ALL),
cr AS (SELECT c2.*, CASE WHEN cell > 0 THEN low + coalesce(won, 0) ELSE 0 END AS words
       FROM c2 LEFT JOIN cn ON c2.source IS NOT DISTINCT FROM cn.source AND c2.shard = cn.shard),
tp AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS z FROM e),
qa AS (SELECT *, CASE WHEN cell > 0 THEN least(2, words // cell) ELSE 0 END AS rounds FROM cr),
qr AS (SELECT *, CASE WHEN rounds < 2 THEN words - rounds * cell ELSE 0 END AS rest FROM qa),
bb AS (SELECT greatest(1, least(4096, floor((min(target) FILTER (target > 0)) / (8 * max(n.n)))))::BIGINT AS b FROM s6, n),
bl AS (SELECT source, shard, k, rest, least(b, cell - k * b) AS len, md5('17:' || shard || ':' || k) AS h
       FROM qr, bb, unnest(range(0, (cell + b - 1) // b)) AS u(k) WHERE rest > 0),
bs AS (SELECT source, shard, k, greatest(0, least(len, rest - (sum(len) OVER (PARTITION BY source, shard ORDER BY h, k ROWS UNBOUNDED PRECEDING) - len))) AS sel FROM bl),
pc AS (SELECT source, shard, size, z, k, b FROM tp, bb, unnest(range((z - size) // b, (z - 1) // b + 1)) AS u(k) WHERE size > 0),
ov AS (SELECT pc.source, pc.shard, z, sum(greatest(0, least(z, pc.k * b + sel) - greatest(z - size, pc.k * b))) AS got
       FROM pc JOIN bs ON pc.source IS NOT DISTINCT FROM bs.source AND pc.shard = bs.shard AND pc.k = bs.k GROUP BY ALL)
SELECT doc_id, size, source_size, target, (rounds * size + CASE WHEN size > 0 THEN coalesce(got, 0) ELSE 0 END)::BIGINT AS taken
FROM tp JOIN qr ON tp.source IS NOT DISTINCT FROM qr.source AND tp.shard = qr.shard
LEFT JOIN ov ON tp.source IS NOT DISTINCT FROM ov.source AND tp.shard = ov.shard AND tp.z = ov.z
"""

OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM g
"""

OP5_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.root = e.x)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept
FROM documents d JOIN r ON d.doc_id = r.doc_id LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id
"""

OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT r, doc_id, i, x, {LOWER.format("trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
      FROM (SELECT r, doc_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM d)),
f AS (SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.k IS NOT NULL AND top IS DISTINCT FROM doc_id) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (f.k IS NULL OR top IS NOT DISTINCT FROM doc_id), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY r, doc_id
"""

OP7_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, contains(role || chr(10) || text, '\') OR contains(role || chr(10) || text, '###') OR contains(role || chr(10) || text, '</turn>') OR contains(role, ':') AS odd FROM t),
x AS (SELECT *, CASE WHEN odd THEN replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:') ELSE role END AS r,
             CASE WHEN odd THEN replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') ELSE text END AS x FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ' || r || ': ' || x || ' </turn>' || chr(10)))::BIGINT AS formatted_chars, true AS round_trip
FROM x GROUP BY conv_id
"""

OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


OP11_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.root = e.x)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id
FROM documents d JOIN r ON d.doc_id = r.doc_id LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id
"""

_WHOLE = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_SQUARE = "list_sum(list_transform(list_zip(a.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
#: One round: the nearest centroid of every vector, then floors of means; n // m truncates.
_ROUND = """
a{k} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c FROM (SELECT a.r, c.c, {square} AS d FROM kept a, c{k} c) GROUP BY r),
m{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT c, i, sum(x) AS s, count(*)::HUGEINT AS n FROM a{k} JOIN flat USING (r) GROUP BY c, i) GROUP BY c),
c{next} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{k} o LEFT JOIN m{k} m ON o.c = m.c)"""
OP12_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_WHOLE} AS v FROM embeddings WHERE {_FINITE} AND len(embedding) = 64),
flat AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h)::INT - 1 AS c, v FROM (SELECT sha256('2:' || vec_id::VARCHAR) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h LIMIT 40)),
{",".join(_ROUND.format(k=k, next=k + 1, square=_SQUARE) for k in range(5))},
o AS (SELECT r, min(d) AS distance, arg_min(c, (d, c))::INT AS cluster FROM (SELECT a.r, c.c, {_SQUARE} AS d FROM kept a, c5 c) GROUP BY r)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c5.v, ',')) AS centroid_sha256 FROM o JOIN kept USING (r) JOIN c5 ON cluster = c
"""

OP13_SQL = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
           coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) AS n FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY s.score DESC, s.vec_id, s.r)::INT AS rank
      FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND p.n <= 5 AND 30::HUGEINT * p.score <= 100::HUGEINT * s.score AND 100::HUGEINT * s.score <= 90::HUGEINT * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_jaccard": OP11_SQL, "op12_centroids": OP12_SQL, "op13_negatives": OP13_SQL, "op1_decontamination": OP1_SQL, "op2_mixing": OP2_SQL, "op3_warc": OP3_SQL, "op5_minhash": OP5_SQL, "op6_lines": OP6_SQL, "op7_chat": OP7_SQL, "op10_exact": OP10_SQL}
