"""The queries of this package, one an operator and one for the pipeline, with the SQL that DuckDB checks them by where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat_tools, embedding_dedup, hilbert_sharding, language_id, mixing, packing, quality_rules, simhash, suffix_dedup, url_filters, warc, whitening
from .common import fresh_path, scratch, small_batches, table, written

RULES = [
    url_filters.Rule.prefix("com/", "allow"),
    url_filters.Rule.prefix("example.com/en/", "block"),
    url_filters.Rule.prefix("www.example.com/en/", "allow"),
    url_filters.Rule.prefix("net/es/", "block"),
    url_filters.Rule.prefix("net/fr/", "block"),
]
#: The tokenizer's file in the installed collection of public tokenizers.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    utf8 = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    own = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(utf8).cast("long").alias("text_crc32"), "source", "lang", "n_chars")
    out = hilbert_sharding.assign(written(own, "shard-rows"), ["source", "lang", "n_chars"])  # without texts, which are read once
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def trained(docs: DataFrame) -> DataFrame:
    """The documents that profiles may be learned from."""
    return docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.learn(trained(docs))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return language_id.identify(docs, profiles, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    pages = table(spark, sf_dir, "pages")
    with scratch():
        warc.write_archives(warc.classified(pages), path, known=warc.sizes(pages))
    found = warc.read_archives(spark, path, with_html=False, gaps="raise")
    return found.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, others = chat_tools.turns(table(spark, sf_dir, "conversations"))
    return chat_tools.link(calls, results, [chat_tools.ANSWER]).unionByName(chat_tools.plain(others)).drop("errors")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    parts = written(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False), "pieces")
    return packing.pack(parts).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = alignment.score(alignment.links(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), ["vec_id"])
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_hilbert_sharding, op2_url_filters, op3_language_id, op4_warc, op5_quality_rules, op6_simhash, op7_tool_calls, op8_embedding_dedup, op9_packing, op10_mixing, op11_alignment, op12_suffix_dedup, op13_whitening]
    return {f.__name__: f for f in own}


_W = r"[^\x20\x09-\x0D]+"
_S = r"[\x20\x09-\x0D]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
s AS (SELECT *, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM r)
SELECT page_id, host, path,
  (SELECT max_by(rule, length(rule)) FROM s WHERE (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT max_by(verdict, length(rule)) FROM s WHERE (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM p"""

OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, payload_bytes, d.payload_digest, CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND payload_bytes >= 100"""

OP5_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM d WHERE len(w) >= 4),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
k AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS place FROM h WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM k GROUP BY 1),
l AS (SELECT doc_id, source, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}'))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY 1),
n AS (SELECT doc_id, coalesce(source, chr(0)) AS source, trim(regexp_replace(lower(line), '{_S}', ' ', 'g')) AS line, len(regexp_extract_all(line, '{_W}')) AS words FROM l),
t AS (SELECT doc_id, list_sort(list(DISTINCT line)) AS all_lines FROM n GROUP BY 1),
x AS (SELECT n.*, all_lines FROM n JOIN t USING (doc_id)),
hosts AS (SELECT source, count(DISTINCT all_lines) AS docs FROM x GROUP BY 1),
above AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT all_lines) AS c FROM x GROUP BY 1, 2) JOIN hosts USING (source) WHERE c >= 20 AND c * 100 >= docs * 2),
gone AS (SELECT doc_id, sum(words)::BIGINT AS removed_words FROM n JOIN above USING (source, line) GROUP BY 1),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{_S}', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
  NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND (n_words - removed_words) * 100 >= n_words * 50 AS kept, removed_words
FROM m"""

OP7_SQL = """
WITH RECURSIVE c AS (SELECT conv_id, conv_id || '-' || turn AS call_id, turn, text FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'),
cc AS (SELECT conv_id, call_id, turn, min(text) AS text, count(*) AS n_calls, CASE WHEN conv_id % 5 = 1 OR conv_id % 5 = 2 AND turn < 2 THEN turn + 2 WHEN turn >= 2 THEN turn - 2 END AS dep FROM c GROUP BY 1, 2, 3),
rr AS (SELECT conv_id, call_id, min(content) AS content, count(*) AS n_results FROM r GROUP BY 1, 2),
k AS (SELECT a.*, o.turn AS known FROM cc a LEFT JOIN cc o ON o.conv_id = a.conv_id AND o.turn = a.dep),
tangled AS (SELECT DISTINCT conv_id FROM k WHERE known >= turn),
lv(conv_id, turn, place) AS (SELECT conv_id, turn, 0 FROM k WHERE known IS NULL UNION ALL SELECT k.conv_id, k.turn, lv.place + 1 FROM lv JOIN k ON k.conv_id = lv.conv_id AND k.known = lv.turn),
p AS (SELECT k.*, CASE WHEN t.conv_id IS NULL THEN k.turn ELSE lv.place END AS place FROM k LEFT JOIN tangled t ON t.conv_id = k.conv_id LEFT JOIN lv ON lv.conv_id = k.conv_id AND lv.turn = k.turn)
SELECT conv_id, call_id, CASE WHEN n_calls IS NULL THEN 'orphan' WHEN n_results IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  coalesce(n_calls, 0)::BIGINT AS n_calls, coalesce(n_results, 0)::BIGINT AS n_results, place::BIGINT AS place,
  n_calls IS NOT NULL AND text IS NOT NULL AND (dep IS NULL OR known IS NOT NULL) AND place IS NOT NULL AS valid,
  '{"arguments":' || CASE WHEN n_calls IS NULL THEN 'null' WHEN text IS NULL THEN '{"turn":' || turn || '}' ELSE '{"prompt":' || to_json(text)::VARCHAR || ',"turn":' || turn || '}' END
    || ',"id":' || to_json(call_id)::VARCHAR || ',"name":' || CASE WHEN n_calls IS NULL THEN 'null' ELSE '"answer"' END
    || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json
FROM p FULL JOIN rr USING (conv_id, call_id)
UNION ALL SELECT conv_id, NULL, 'message', 0, 0, turn, true, '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')"""

OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
low AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, label, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(low.c, vec_id)::BIGINT AS component_id, vec_id = coalesce(low.c, vec_id) AS kept
FROM v LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id"""

OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_W}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight, sum(source_size) OVER ()::BIGINT AS total FROM s),
o AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights FROM w),
f AS (SELECT *, (total * 150 - before * 200) * weight >= source_size * weights * 200 AS filled FROM o),
l AS (SELECT before AS lb, weights AS lw FROM f WHERE NOT filled ORDER BY 1, 2 LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN filled THEN (source_size * 2)::DOUBLE ELSE ((total * 150 - lb * 200) * weight)::DOUBLE / (lw * 100)::DOUBLE END AS target,
  ('0x' || substr(md5('42:' || coalesce(source, chr(0) || 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM f LEFT JOIN l ON true),
r AS (SELECT doc_id, d.source, size, source_size, target, u, (row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) - 1)::DOUBLE AS place,
  CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END::DOUBLE AS e FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(floor(e * (place + 1) + u) - floor(e * place + u), 2)::BIGINT * size)::BIGINT AS taken FROM r"""


#: Each window of 400 bytes by its hash, in hexadecimal, since SQL cuts text and not bytes.
OP12_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(greatest(0, length(h) // 2 - 399))) AS i FROM d)),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 400, true) AS new FROM w SEMI JOIN again USING (k)),
g AS (SELECT doc_id, i, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM r),
s AS (SELECT doc_id, n, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY 1, 2),
p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM p JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2_SQL, "op4_warc": OP4_SQL, "op5_quality_rules": OP5_SQL, "op7_tool_calls": OP7_SQL, "op8_embedding_dedup": OP8_SQL, "op10_mixing": OP10_SQL, "op12_suffix_dedup": OP12_SQL}
