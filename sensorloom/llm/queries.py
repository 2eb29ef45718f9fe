"""One query per operator over the whole of its table, with production parameters."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, decontam, divergence, langid, merkle, ngram_join, packing, pieces, pii, quality, secret_scan, sketch, warc
from .shared import let_workers_import

LLM_QUERIES: dict = {}
LLM_ORACLE: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        let_workers_import(spark)
        return fn(spark, sf_dir)
    LLM_QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LLM_ORACLE["op1_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, text, regexp_extract_all({LOWER.format("text")}, '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, text, CASE WHEN text IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS g FROM w),
k AS (SELECT doc_id, g, CASE WHEN len(g) > 0 THEN 'g' || md5(array_to_string(g, '|')) WHEN text IS NULL THEN 'n' || doc_id ELSE 't' || md5(text) END AS key FROM s),
c AS (SELECT key, min(doc_id) AS text_class, count(*) AS n_copies FROM k GROUP BY key),
x AS (SELECT text_class AS d, n_copies, unnest(g) AS g, len(g) AS n FROM c JOIN k ON k.doc_id = c.text_class),
p AS (SELECT a.d AS a, b.d AS b, any_value(b.n_copies) AS copies FROM x a JOIN x b ON a.g = b.g AND a.d <> b.d
  GROUP BY a.d, b.d, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
l AS (SELECT a, count(*) AS n_texts, sum(copies) AS n_docs FROM p GROUP BY a),
reach AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
root AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT k.doc_id, c.text_class, c.n_copies, coalesce(l.n_texts, 0) AS n_texts, CAST(coalesce(l.n_docs, 0) + c.n_copies - 1 AS BIGINT) AS n_links,
  least(c.text_class, coalesce(root.low, c.text_class)) AS class_id
FROM k JOIN c USING (key) LEFT JOIN l ON l.a = c.text_class LEFT JOIN root ON root.a = c.text_class
"""


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def _joined(spans, only=None):
    """kind:start:end of spans in their order, comma-joined."""
    if only:
        spans = F.filter(spans, lambda s: s["kind"].isin(*only))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _n(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query
def op4_secret_scans(spark, sf_dir):
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = ("assign", "access", "hex")
    return found.select("doc_id", *[_n("secrets", k) for k in base], F.sha2(_joined("secrets", base), 256).alias("base_sha256"),
                        _joined("secrets").alias("spans"), F.expr("array_max(transform(secrets, s -> s.score))").alias("top_score"))


@query
def op5_hierarchical_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


def held_out():
    return (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out")


@query
def op8_quality_neighbours(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.training_part(table(spark, sf_dir, "labels")))
    return quality.score_documents(docs.select("doc_id", "text"), model).select(F.col("row.doc_id").alias("doc_id"), "score", "predicted") \
        .select("doc_id", held_out(), "score", "predicted")


LLM_ORACLE["op10_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bl)),
dk AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bl) WHERE len(w) >= k),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM dk),
m AS (SELECT doc_id, item_id, dg.k, i FROM dg JOIN bw ON dg.k = bw.k AND dg.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""


@query
def op10_benchmark_decontamination(spark, sf_dir):
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


LLM_ORACLE["op2_legacy_archives"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM m
"""


@query
def op2_legacy_archives(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_personal_data(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[_n("found", k) for k in pii.BASE], F.sha2(_joined("found", pii.BASE), 256).alias("base_sha256"),
                        _joined("found").alias("spans"))


@query
def op6_language_backoff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_part(docs))
    return langid.identify(docs, model).select("doc_id", held_out(), "lang_pred", "score")


@query
def op9_scaled_sketch(spark, sf_dir):
    rows = sketch.with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", F.col("next.sketch").alias("next_sketch"))
    rows = rows.select("*", sketch.sketch(F.col("edited")).alias("edited_sketch"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch.as_text(F.col("sketch")).alias("fingerprint"),
                       sketch.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                       sketch.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                       sketch.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
                       sketch.containment(F.col("sketch"), F.col("edited_sketch")).alias("share_in_edited"))


@query
def op7_collinear_chains(spark, sf_dir):
    return chaining.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op13_sentence_pieces(spark, sf_dir):
    out = pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: zlib's CRC-32 of a string of digits.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x // 2, 3988292384 * (x % 2)))))"""

LLM_ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, text, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda v: CASE WHEN v IS NULL THEN '-' ELSE
    octet_length(encode(v)) || ':' || v END) AS f, CASE WHEN {CRC32.format("doc_id::VARCHAR")} % 5 = 0 THEN {LOWER.format("text")} ELSE text END AS changed FROM documents),
h AS (SELECT doc_id, source, sha256(array_to_string(f, '') || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
  sha256(array_to_string(f, '') || coalesce(octet_length(encode(changed)) || ':' || changed, '-')) AS other FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM h),
t AS (SELECT s, 0 AS lvl, i, n, leaf AS h FROM l UNION ALL
  SELECT s, lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY s, lvl, i // 16, n),
u AS (SELECT 0 AS lvl, s AS i, (SELECT count(DISTINCT s) FROM l) AS n, h FROM t WHERE n = 1 UNION ALL
  SELECT lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 16, n),
r AS (SELECT s, 0 AS part, lvl, i // 16 AS run, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY s, lvl, i // 16
  UNION ALL SELECT 0, 1, lvl, i // 16, list(h ORDER BY i) FROM u WHERE n > 1 GROUP BY lvl, i // 16),
p AS (SELECT doc_id, s, leaf, s AS tree, 0 AS part, 0 AS lvl, i, n, '' AS proof, other AS folded FROM l UNION ALL
  SELECT doc_id, p.s, leaf, CASE WHEN p.n = 1 THEN 0 ELSE tree END, CASE WHEN p.n = 1 THEN 1 ELSE p.part END, CASE WHEN p.n = 1 THEN 0 ELSE p.lvl + 1 END,
    CASE WHEN p.n = 1 THEN p.s ELSE i // 16 END, CASE WHEN p.n = 1 THEN (SELECT max(n) FROM u) ELSE (p.n + 15) // 16 END,
    proof || coalesce(array_to_string(list_concat(hs[1:i % 16], hs[i % 16 + 2:]), ''), ''),
    CASE WHEN p.n = 1 THEN folded ELSE sha256(array_to_string(hs[1:i % 16], '') || folded || array_to_string(hs[i % 16 + 2:], '')) END
  FROM p LEFT JOIN r ON r.s = p.tree AND r.part = p.part AND r.lvl = p.lvl AND r.run = i // 16 AND p.n > 1 WHERE p.part = 0 OR p.n > 1)
SELECT doc_id, leaf, t.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.h AS verified
FROM p JOIN t ON t.s = p.s AND t.n = 1 JOIN u ON u.n = 1 WHERE p.part = 1 AND p.n = 1
"""


@query
def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select("doc_id", "source", merkle.leaf(*head, F.col("text")).alias("leaf"), merkle.leaf(*head, changed).alias("other"))
    rows = merkle.manifest(leaves)
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.node(merkle.siblings(F.col("proof"))).alias("proof_sha256"),
                       merkle.fold(F.col("other"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


LLM_ORACLE["op12_source_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LOWER.format("coalesce(text, '')")} AS text FROM documents),
o AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(n.n, 0) + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (k.c + 5)) // (l.n + 5 * v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM y QUALIFY part = 'pair' OR rank <= 50
"""


@query
def op12_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))
