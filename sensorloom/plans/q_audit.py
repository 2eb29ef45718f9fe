"""Queries over agent logs: transcripts, runs, budgets, gating, RPC, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as AU
from .registry import register

GUARD_IN_TESTS = 3
RPC_TIMEOUT_TESTS_S = 30 * 86400


def review_requests(fx):
    l = fx.labels  # noqa: E741
    d = F.col("doc_id").cast("string")
    path = (F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string"))
            .when(F.col("quality") == 0, F.concat(F.lit("generated/t"), d, F.lit("/notes.md")))
            .otherwise(F.concat(F.lit("generated/t"), d, F.lit("/t"), d, F.lit("_server.py"))))
    return l.select(F.col("doc_id").alias("request_id"), path.alias("path"))


def generated_files(fx):
    """Files on the shared volume: one rendered server per document, plus notes."""
    doc = fx.documents
    d = F.col("doc_id").cast("string")
    py = doc.select(F.concat(F.lit("generated/t"), d, F.lit("/t"), d, F.lit("_server.py")).alias("path"),
                    F.when(F.col("doc_id") % 11 == 0, F.lit(" \n")).otherwise(F.col("text")).alias("content"))
    md = doc.where(F.col("doc_id") % 2 == 0).select(F.concat(F.lit("generated/t"), d, F.lit("/notes.md")).alias("path"),
                                                    F.col("text").alias("content"))
    return py.unionByName(md)


def research_contexts(fx):
    l = fx.labels  # noqa: E741
    d = F.col("doc_id")
    lib = F.when(d % 3 == 0, F.lit("")).otherwise(F.concat(
        F.lit('"client_library":{"name":"lib","version":"1.0"'),
        F.when(d % 2 == 0, F.lit(',"install_command":"pip install lib"')).otherwise(F.lit("")),
        F.lit(',"main_classes":["C"]},')))
    body = F.concat(F.lit('{"technology":"t'), d.cast("string"), F.lit('","summary":"s",'), lib,
                    F.lit('"operations":[],"connection_config":{"required_params":[],"optional_params":[],'
                          '"example_minimal_config":{}},"minimal_working_example":"x","idioms_and_gotchas":[],'
                          '"sources_consulted":[],"confidence_notes":'),
                    F.when(F.col("quality") == 1, F.lit('"n"')).otherwise(F.lit("null")), F.lit("}"))
    return l.select(d.alias("ctx_id"), F.when(d % 7 == 0, F.lit("oops")).otherwise(body).alias("body"))


@register("transcripts", """
SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript
FROM conversations GROUP BY conv_id
""")
def transcripts(fx):
    return AU.transcripts(fx.conversations)


@register("token_concat", "SELECT message_id, string_agg(delta, '' ORDER BY seq) AS message FROM token_deltas GROUP BY message_id",
          ["token_deltas"])
def token_concat(fx):
    return AU.token_concat(fx.token_deltas())


@register("tool_runs", f"""
SELECT run_id, seq, tool, n_consecutive FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, island ORDER BY seq) AS n_consecutive FROM (
    SELECT *, SUM(brk) OVER (PARTITION BY run_id ORDER BY seq) AS island FROM (
      SELECT *, CASE WHEN LAG(tool) OVER (PARTITION BY run_id ORDER BY seq) IS NOT DISTINCT FROM tool THEN 0 ELSE 1 END AS brk
      FROM tool_calls)))
WHERE n_consecutive >= {GUARD_IN_TESTS}
""", ["tool_calls"])
def tool_runs(fx):
    return AU.tool_runs(fx.tool_calls(), guard=GUARD_IN_TESTS)


@register("tool_budget", """
SELECT request_id, seq, tool, approved, call_no FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY seq) AS call_no FROM audit_calls WHERE tool = 'generate_mcp_server')
WHERE call_no > 3
""", ["audit_calls"])
def tool_budget(fx):
    return AU.budget_violations(fx.audit_calls())


@register("gating_audit", """
SELECT c.request_id, g.last_generate_seq,
  max(CASE WHEN c.tool = 'review_code' AND c.seq > g.last_generate_seq THEN c.seq END) AS last_review_seq,
  arg_max_null(c.approved, c.seq) FILTER (WHERE c.tool = 'review_code' AND c.seq > g.last_generate_seq) AS last_review_approved,
  coalesce(arg_max_null(c.approved, c.seq) FILTER (WHERE c.tool = 'review_code' AND c.seq > g.last_generate_seq), false) AS gated_ok
FROM audit_calls c JOIN (SELECT request_id, max(CASE WHEN tool = 'generate_mcp_server' THEN seq END) AS last_generate_seq
                         FROM audit_calls GROUP BY request_id) g ON c.request_id = g.request_id
GROUP BY c.request_id, g.last_generate_seq
""", ["audit_calls"])
def gating_audit(fx):
    return AU.gating_audit(fx.audit_calls())


@register("rpc_pairs", f"""
SELECT q.id, q.method, q.sent_at, r.recv_at, r.error_code,
  CASE WHEN r.recv_at IS NULL THEN 'timeout' WHEN r.error_code IS NOT NULL THEN 'error' ELSE 'ok' END AS status
FROM rpc_requests q LEFT JOIN rpc_responses r
  ON q.id = r.id AND r.recv_at >= q.sent_at AND r.recv_at <= q.sent_at + INTERVAL {RPC_TIMEOUT_TESTS_S} SECOND
""", ["rpc_requests", "rpc_responses"])
def rpc_pairs(fx):
    return AU.rpc_pairs(fx.rpc_requests(), fx.rpc_responses(), timeout_s=RPC_TIMEOUT_TESTS_S)


@register("plan_status", """
SELECT doc_id,
  CASE WHEN bad THEN 'error' WHEN nq > 0 THEN 'clarification_needed' ELSE 'success' END AS status,
  CASE WHEN NOT bad AND nq = 0 THEN 'generated/' || tech || '/' || tech || '_server.py' END AS file_path,
  CASE WHEN bad THEN body END AS raw_result, CAST(nq AS INTEGER) AS n_questions
FROM (SELECT doc_id, body, tech, nq, NOT (tech IS NOT NULL AND pascal IS NOT NULL AND instructions IS NOT NULL
        AND coalesce(port, '') IN ('UBIGINT', 'BIGINT') AND coalesce(tools, '') = 'ARRAY') AS bad
      FROM (SELECT doc_id, body, json_extract_string(jb, '$.technology_lower') AS tech, json_extract_string(jb, '$.technology_pascal') AS pascal,
              json_extract_string(jb, '$.server_instructions') AS instructions, json_type(jb, '$.default_port') AS port, json_type(jb, '$.tools') AS tools,
              coalesce(json_array_length(jb, '$.clarification_questions'), 0) AS nq
            FROM (SELECT doc_id, body, CASE WHEN json_valid(body) THEN body END AS jb FROM plans)))
""", ["plans"])
def plan_status(fx):
    """Complete plans, plans with a missing field or one of another type, and no plans."""
    return AU.plan_status(fx.plans())


REVIEW_SQL = """(SELECT review_id, body, list_transform(range(CAST(coalesce(json_array_length(jb, '$.issues'), 0) AS BIGINT)),
    lambda i: json_extract(jb, '$.issues[' || i || ']')) AS issues,
  json_extract_string(jb, '$.summary') AS summary, CAST(json_extract(jb, '$.approved') AS BOOLEAN) AS approved
FROM (SELECT review_id, body, CASE WHEN json_valid(body) THEN body END AS jb FROM reviews))"""


@register("review_verdict", f"""
SELECT review_id, valid, valid AND approved AS approved, has_critical, valid AND approved AND NOT has_critical AS effective_approved,
  valid AND approved AND has_critical AS contradiction, n_issues
FROM (SELECT review_id, coalesce(approved, false) AS approved, CAST(len(issues) AS INTEGER) AS n_issues,
        list_contains(list_transform(issues, lambda i: json_extract_string(i, '$.severity')), 'critical') AS has_critical,
        summary IS NOT NULL AND approved IS NOT NULL
          AND len(list_filter(issues, lambda i: json_extract_string(i, '$.severity') NOT IN ('critical', 'warning', 'suggestion'))) = 0 AS valid
      FROM {REVIEW_SQL})
""", ["reviews"])
def review_verdict(fx):
    return AU.review_verdicts(fx.reviews())


@register("review_counts", f"""
SELECT json_extract_string(i, '$.severity') AS severity, json_extract_string(i, '$.criterion') AS criterion, count(*) AS n
FROM (SELECT unnest(CASE WHEN len(issues) = 0 THEN [NULL] ELSE issues END) AS i FROM {REVIEW_SQL}) GROUP BY 1, 2
""", ["reviews"])
def review_counts(fx):
    return AU.review_counts(fx.reviews())


@register("review_intake", r"""
WITH req AS (SELECT doc_id AS request_id, CASE WHEN doc_id % 5 = 0 THEN NULL
    WHEN quality = 0 THEN 'generated/t' || CAST(doc_id AS VARCHAR) || '/notes.md'
    ELSE 'generated/t' || CAST(doc_id AS VARCHAR) || '/t' || CAST(doc_id AS VARCHAR) || '_server.py' END AS path FROM labels),
files AS (SELECT 'generated/t' || CAST(doc_id AS VARCHAR) || '/t' || CAST(doc_id AS VARCHAR) || '_server.py' AS path,
    CASE WHEN doc_id % 11 = 0 THEN ' ' || chr(10) ELSE text END AS content FROM documents
  UNION ALL SELECT 'generated/t' || CAST(doc_id AS VARCHAR) || '/notes.md', text FROM documents WHERE doc_id % 2 = 0),
j AS (SELECT r.request_id, r.path, f.path AS fpath, f.content,
    regexp_extract(regexp_extract(r.path, '([^/]*)$', 1), '[^.](\.[^.]*)$', 1) AS suffix FROM req r LEFT JOIN files f ON r.path = f.path)
SELECT request_id, path, CASE WHEN reason IS NOT NULL THEN false END AS approved, reason FROM (
  SELECT *, CASE WHEN path IS NULL OR path = '' THEN 'No file path provided' WHEN fpath IS NULL THEN 'File not found: ' || path
    WHEN suffix <> '.py' THEN 'Expected a .py file, got: ' || suffix WHEN regexp_replace(content, '\s', '', 'g') = '' THEN 'File is empty.' END AS reason
  FROM j)
""")
def review_intake(fx):
    return AU.review_intake(review_requests(fx), generated_files(fx))


@register("context_gaps", """
SELECT doc_id AS ctx_id, doc_id % 7 <> 0 AS parsed,
  CASE WHEN doc_id % 7 <> 0 THEN concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'client_library' END,
    CASE WHEN quality <> 1 THEN 'confidence_notes' END,
    CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 <> 0 THEN 'client_library.install_command' END) END AS missing_fields,
  doc_id % 7 <> 0 AND doc_id % 3 <> 0 AND doc_id % 2 = 0 AND quality = 1 AS complete
FROM labels
""")
def context_gaps(fx):
    return AU.context_gaps(research_contexts(fx))
