"""The registered queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import chat, decontaminate, embeddings, evolve, html, infill, katz, minhash, mixing, packing, quality, sharding, toxicity
from lexmill.session import fresh_folder, table


def _remainder(by: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def op1_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    weights = toxicity.train(docs, table(spark, d, "labels"), train_where=_remainder(5) != 0)
    out = toxicity.toxicity_scores(docs, weights)
    return out.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = quality.train(docs, table(spark, d, "labels"), train_where=_remainder(3) != 1)
    out = quality.quality_scores(docs, model)
    return out.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_embedding_dups(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.embedding_duplicates(table(spark, d, "embeddings"))


def op4_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: A conversation whose texts hold the template's own control strings.
TRICKY = r"\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat.read_back(chat.format_chats(turns.unionByName(extra))).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")


def op6_html(spark: SparkSession, d: str) -> DataFrame:
    return html.extract_pages(table(spark, d, "pages"))


SHARD_BYTES = 1 << 20


def op7_sharding(spark: SparkSession, d: str) -> DataFrame:
    """Shards of at most a megabyte: small enough that the least of the test tables is split, many times on the others."""
    return sharding.extendible_shards(table(spark, d, "documents"), limit_bytes=SHARD_BYTES)


def op8_minhash(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, d, "documents"), n=3, percent=85, bands=20, rows=6)


def op9_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def op10_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op11_fill_in_middle(spark: SparkSession, d: str) -> DataFrame:
    out = infill.fill_in_middle(table(spark, d, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("form"), F.col("output")).cast("binary"), 256).alias("restored_sha256"))


def op12_katz(spark: SparkSession, d: str) -> DataFrame:
    held_out = F.coalesce(_remainder(10) == 0, F.lit(False)).alias("held_out")
    out = katz.katz_scores(table(spark, d, "documents"), fresh_folder(spark, "op12"), learn=_remainder(10) != 0)
    return out.withColumnRenamed("id", "doc_id").select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_evolve(spark: SparkSession, d: str) -> DataFrame:
    out = evolve.evolve_clients(table(spark, d, "clients"), fresh_folder(spark, "op13"))
    return out.select("file_no", "version", "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten")


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_quality, op3_embedding_dups, op4_mixing, op5_chat, op6_html, op7_sharding, op8_minhash, op9_packing, op10_decontamination, op11_fill_in_middle, op12_katz,
        op13_evolve)
}

_OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
u AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, c.m AS component_id, c.m = e.vec_id AS kept
FROM embeddings e JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON c.x = e.vec_id
LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) k ON k.x = e.vec_id
"""

_OP4 = r"""
WITH own AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, (ARRAY[5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM own GROUP BY source),
lev AS (
  SELECT *, 2 * source_size AS cap, sum(2 * source_size) OVER o AS caps, sum(weight) OVER o AS ws,
         sum(weight) OVER () AS w, 3 * sum(source_size) OVER () AS b, row_number() OVER o AS k
  FROM src WINDOW o AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
opt AS (
  SELECT 0 AS k, max(b) AS num, 2 * max(w) AS den, min(cap * 1.0 / weight) AS next FROM lev
  UNION ALL
  SELECT k, b - 2 * caps, 2 * (w - ws), lead(cap * 1.0 / weight) OVER (ORDER BY k) FROM lev),
lam AS (SELECT num, den FROM opt WHERE den > 0 AND next * den >= num ORDER BY k LIMIT 1),
plan AS (
  SELECT source, source_size, CASE WHEN cap::HUGEINT * den < weight::HUGEINT * num THEN cap::DOUBLE
    ELSE least(weight::DOUBLE * num::DOUBLE / den::DOUBLE, cap::DOUBLE) END AS target FROM src, lam, LATERAL (SELECT 2 * source_size AS cap)),
cum AS (
  SELECT own.*, source_size, target, floor(target)::BIGINT AS goal,
    sum(size) OVER (PARTITION BY own.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM own JOIN plan ON own.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE (goal // source_size) * size
    + greatest(0, least(size, goal - (goal // source_size) * source_size - before)) END)::BIGINT AS taken
FROM cum
"""

_OP5 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, lead(role, 1, '') OVER w AS next, lag(role, 1, '') OVER w AS prev,
    replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS et,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), chr(10), '\n') AS er
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || er || ':' || chr(10) || et || '</turn>' || chr(10)))::BIGINT AS formatted_chars,
  bool_and((prev || '>' || role) IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user'))
    AND last(role ORDER BY turn, role, text) IN ('user', 'assistant') AS valid
FROM e GROUP BY conv_id
"""

_OP7 = """
WITH own AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
    lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS key FROM documents),
p AS (
  SELECT depth, substr(key, 1, depth) AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS n
  FROM own, (SELECT unnest(range(0, 61))::INT AS depth) GROUP BY ALL)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, shard, depth, shard_bytes, shard_bytes > 1048576 AS oversize
FROM own JOIN p ON p.shard = substr(own.key, 1, p.depth)
WHERE shard_bytes <= 1048576 OR n = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""

_OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, s FROM s),
x AS (SELECT doc_id, n, unnest(s) AS g FROM n),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.m AS component_id, c.m = n.doc_id AS kept
FROM n JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = n.doc_id
"""

_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

#: CRC-32 bit by bit, which DuckDB lacks: each byte is mixed in, then eight shifts.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)),
    lambda x, y: list_reduce(list_concat([xor(x, y)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, i: xor(a >> 1, 3988292384::BIGINT * (a & 1)))), 4294967295::BIGINT)"""
_FACTOR = """
n{i} AS (SELECT list_transform(range(1, 8), lambda r: list_count(list_filter(all_c, lambda c: CASE WHEN c = r THEN true END))) AS n
  FROM (SELECT list(c) AS all_c FROM c{i} WHERE c < 7)),
g{i} AS (SELECT r, n[r] AS nr, n[r + 1] AS nx, CASE WHEN n[1] > 0 THEN 6.0 * n[6] / n[1] ELSE 1 END AS common FROM n{i}, (SELECT unnest(range(1, 6)) AS r)),
f{i} AS (SELECT r, CASE WHEN nr > 0 AND nx > 0 AND common < 1 AND f > 0 AND f <= 1 THEN f ELSE 1 END AS f
  FROM (SELECT *, ((r + 1.0) * nx / nullif(r * nr, 0) - common) / nullif(1 - common, 0) AS f FROM g{i}))"""
_OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(({crc}) % 10 = 0, false) AS held_out, coalesce(({crc}) % 10 <> 0, false) AS learn,
    list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), ['']) AS w FROM documents),
t AS (SELECT doc_id, held_out, learn, unnest(list_concat([' '], w[1:len(w) - 1])) AS h, unnest(w) AS w FROM d),
c1 AS (SELECT w, count(*) AS c FROM t WHERE learn GROUP BY w), c2 AS (SELECT h, w, count(*) AS c FROM t WHERE learn GROUP BY h, w),{f1},{f2},
k1 AS (SELECT w, c, coalesce(f, 1) * c AS kept FROM c1 LEFT JOIN f1 ON r = c),
a AS (SELECT coalesce(sum(c), 0)::BIGINT AS total, count(*) AS v, coalesce(sum(kept), 0) AS kept FROM k1),
s AS (SELECT total, v, CASE WHEN round(kept, 6) >= total THEN total + 1 ELSE total END AS whole, CASE WHEN round(kept, 6) >= total THEN 1.0 / (total + 1) ELSE 1 - kept / total END AS p0 FROM a),
p1 AS (SELECT w, c, kept / whole AS p FROM k1, s),
k2 AS (SELECT h, w, c, coalesce(f, 1) * c AS kept FROM c2 LEFT JOIN f2 ON r = c),
x AS (SELECT h, sum(k2.c) AS n, sum(kept) AS kept, sum(p) AS lower FROM k2 JOIN p1 USING (w) GROUP BY h),
y AS (SELECT h, CASE WHEN round(kept, 6) >= n THEN n + 1 ELSE n END AS whole, kept, lower FROM x),
p2 AS (SELECT h, w, kept2 / whole AS p FROM (SELECT h, w, kept AS kept2 FROM k2) JOIN y USING (h)),
z AS (SELECT h, (1 - kept / whole) / (1 - lower) AS alpha FROM y)
SELECT doc_id, held_out, count(*) AS n_tokens, count(p1.c) AS n_known, any_value(total) AS train_tokens,
  sum(log10((coalesce(p1.c, 0) + 0.1::DOUBLE) / (total + 0.1::DOUBLE * (v + 1)))) AS base_score,
  sum(log10(coalesce(p2.p, coalesce(alpha, 1) * coalesce(p1.p, p0)))) AS score
FROM t CROSS JOIN s LEFT JOIN p1 USING (w) LEFT JOIN p2 ON p2.h = t.h AND p2.w = t.w LEFT JOIN z ON z.h = t.h
GROUP BY doc_id, held_out
""".format(crc=_CRC32.format(x="doc_id::VARCHAR"), f1=_FACTOR.format(i=1), f2=_FACTOR.format(i=2))

ORACLE_SQL = {"op12_katz": _OP12, "op11_fill_in_middle": _OP11, "op3_embedding_dups": _OP3, "op4_mixing": _OP4, "op5_chat": _OP5, "op7_sharding": _OP7, "op8_minhash": _OP8}
