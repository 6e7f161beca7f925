"""One query for each operator of the package, over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.llm import chat, fingerprints, lexical, licenses, mixing, neardup, neighbours, pieces, secrets, threshold, toxicity, warc, whitening
from tessella.llm.common import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_mix_sources(spark, sf_dir):
    report = mixing.mix_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "source", "size", "source_size", "target", "taken")


@query
def op2_license_scan(spark, sf_dir):
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))
    return found.select("doc_id", "text_digest", "license_id", F.array_join("line_licenses", ",").alias("line_licenses"))


@query
def op3_chat_format(spark, sf_dir):
    more = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat.format_chat(rows)
    whole = chat.formatted("segments")
    back = chat.read_turns(whole)
    turns = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = chat.loss_text("segments")
    return out.select(
        "conv_id",
        F.size(back).cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length(whole).cast("long").alias("formatted_chars"),
        "valid",
        "error_turn",
    )


@query
def op4_nearest_vectors(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query
def op5_fingerprints(spark, sf_dir):
    return fingerprints.edited_report(table(spark, sf_dir, "documents"))


@query
def op6_sentencepiece(spark, sf_dir):
    model = pieces.default_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "text")
    found = pieces.encode(docs, model, columns=["doc_id", "text_sha256"])
    digests = found.select(
        "doc_id",
        "text_sha256",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.array_join(F.transform("scores", lambda x: F.round(x, 6).cast("string")), ";").alias("best_scores"),
        F.to_json("edits").alias("edits"),
        "ids",
    )
    keys = [c for c in digests.columns if c != "ids"]
    back = pieces.decode(digests, model, keys)
    same = F.sha2(F.col("text").cast("binary"), 256) == F.col("text_sha256")
    return back.select("doc_id", "n_tokens", "ids_sha256", "best_scores", "edits", same.alias("round_trip"))


@query
def op7_warc_index(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    archive = warc.write_archive(pages)
    found = warc.look_up(archive, pages.select(warc.url_key(F.col("url")).alias("key"), "page_id"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_secret_scan(spark, sf_dir):
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.spans_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.spans_text("spans").alias("spans"),
    )


@query
def op9_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=0.85)


@query
def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_lexical_search(spark, sf_dir):
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query
def op12_threshold_topk(spark, sf_dir):
    return threshold.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256)


@query
def op13_whiten_embeddings(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


ORACLE_SQL["op3_chat_format"] = """
WITH all_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, row_number() OVER w - 1 AS pos, lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM all_rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (
  SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user')
    ELSE (before, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) END AS fits
  FROM placed),
per AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '') AS learned,
    sum(length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 5 + 8
      + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&#124;'))) AS formatted_chars,
    min(CASE WHEN NOT fits THEN pos END) AS wrong,
    max(CASE WHEN after IS NULL THEN role END) AS last_role
  FROM judged GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, wrong IS NULL AND last_role = 'assistant' AS valid,
  CASE WHEN wrong IS NOT NULL THEN wrong WHEN last_role <> 'assistant' THEN n_turns END AS error_turn
FROM per"""

ORACLE_SQL["op7_warc_index"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM g"""

ORACLE_SQL["op4_nearest_vectors"] = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(CAST(0 AS DOUBLE), [x[1] * x[2] FOR x IN list_zip(q.e, c.e)]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""


ORACLE_SQL["op11_lexical_search"] = """
WITH found AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') FROM benchmark),
held AS (SELECT id AS doc_id, len(terms) AS n, terms FROM found WHERE kind = 'd' AND len(terms) > 0),
total AS (SELECT CAST(count(*) AS HUGEINT) AS docs, CAST(sum(n) AS HUGEINT) AS words FROM held),
asked AS (SELECT DISTINCT id AS item_id, unnest(terms) AS term FROM found WHERE kind = 'i'),
counted AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM held) GROUP BY ALL),
weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted, total WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + CAST((90 * n * docs) // words AS BIGINT))))) AS BIGINT) AS score
  FROM asked JOIN weighed USING (term) JOIN counted USING (term), total GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""

ORACLE_SQL["op12_threshold_topk"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([x[1] * x[2] FOR x IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""
