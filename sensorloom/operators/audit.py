"""Audit of agent logs: transcripts, tool-call runs, budgets, gating, RPC
pairing, and parsing of plan / review / research-context JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PLAN, REVIEW
from .ordered import run_lengths, running_by_key

LOOP_GUARD = 10                 # fixed value: consecutive calls that trip the guard
GENERATOR_BUDGET = 3            # fixed value: 1 generation + 2 clarification rounds
RPC_TIMEOUT_S = 300             # fixed value: RPC timeout in seconds
SEVERITIES = ("critical", "warning", "suggestion")
CRITERIA = ("correctness", "security", "error_handling", "mcp_compliance", "code_quality")
SEQ_BUCKET_BITS = 20


def _seq_bucket(seq: str) -> Column:
    return F.shiftright(F.col(seq), SEQ_BUCKET_BITS)


def ordered_concat(df: DataFrame, key: str, order: str, piece: Column, sep: str, name: str) -> DataFrame:
    """Pieces of one key joined in order (one value per key by definition:
    a transcript or a streamed message)."""
    arr = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p"))))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_pieces"),
                               F.array_join(F.transform(arr, lambda s: s["p"]), sep).alias(name))


def transcripts(conv: DataFrame) -> DataFrame:
    """``role: text`` lines joined by newline in turn order."""
    t = ordered_concat(conv, "conv_id", "turn", F.concat(F.col("role"), F.lit(": "), F.col("text")), "\n", "transcript")
    return t.withColumnRenamed("n_pieces", "n_turns")


def token_concat(deltas: DataFrame) -> DataFrame:
    return ordered_concat(deltas, "message_id", "seq", F.col("delta"), "", "message").drop("n_pieces")


def tool_runs(calls: DataFrame, guard: int = LOOP_GUARD, run: str = "run_id", seq: str = "seq",
              tool: str = "tool") -> DataFrame:
    """Consecutive calls of the same tool inside a run (gaps and islands);
    rows from the ``guard``-th consecutive call on are returned with their
    count.  One bucketed pass: a run holding a third of all calls is spread
    over many tasks."""
    r = run_lengths(calls, run, seq, tool, _seq_bucket(seq), out="n_consecutive")
    return r.where(F.col("n_consecutive") >= guard)


def budget_violations(calls: DataFrame, tool_name: str = "generate_mcp_server", budget: int = GENERATOR_BUDGET,
                      request: str = "request_id", seq: str = "seq", tool: str = "tool") -> DataFrame:
    """Calls of ``tool_name`` beyond the per-request budget."""
    g = calls.where(F.col(tool) == tool_name)
    r = running_by_key(g, [request], [seq], _seq_bucket(seq), count_as="call_no")
    return r.where(F.col("call_no") > budget)


def gating_audit(calls: DataFrame, request: str = "request_id", seq: str = "seq", tool: str = "tool",
                 generate: str = "generate_mcp_server", review: str = "review_code") -> DataFrame:
    """Success is valid only when the last review after the last generation
    approved it.  Two partial aggregates; no per-request window."""
    last_gen = calls.groupBy(request).agg(F.max(F.when(F.col(tool) == generate, F.col(seq))).alias("last_generate_seq"))
    j = calls.join(last_gen, request)
    after = (F.col(tool) == review) & F.col("last_generate_seq").isNotNull() & (F.col(seq) > F.col("last_generate_seq"))
    g = j.groupBy(request, "last_generate_seq").agg(
        F.max(F.when(after, F.col(seq))).alias("last_review_seq"),
        F.max_by(F.col("approved"), F.when(after, F.col(seq))).alias("last_review_approved"))
    return g.withColumn("gated_ok", F.coalesce(F.col("last_review_approved"), F.lit(False)))


def rpc_pairs(requests: DataFrame, responses: DataFrame, timeout_s: int = RPC_TIMEOUT_S) -> DataFrame:
    """Pair each request with its response by id within the timeout;
    ``status`` is ok, error (response carries an error) or timeout."""
    r = responses.select(F.col("id").alias("_rid"), "recv_at", "error_code")
    cond = (F.col("id") == F.col("_rid")) & (F.col("recv_at") >= F.col("sent_at")) & \
           (F.col("recv_at") <= F.col("sent_at") + F.make_dt_interval(secs=F.lit(timeout_s)))
    j = requests.join(r, cond, "left").drop("_rid")
    status = F.when(F.col("recv_at").isNull(), "timeout").when(F.col("error_code").isNotNull(), "error").otherwise("ok")
    return j.withColumn("status", status)


# -- JSON verdicts ---------------------------------------------------------------

# Fixed value: required fields of a generation plan.
PLAN_REQUIRED = ("technology_lower", "technology_pascal", "default_port", "server_instructions", "tools")
# Types other than text; a value of another type counts as missing.
PLAN_TYPES = {"default_port": "int", "tools": "array<variant>"}


def plan_status(plans: DataFrame, key: str = "doc_id", body: str = "body",
                required=PLAN_REQUIRED) -> DataFrame:
    """error (unparsable or a required field missing, raw text kept),
    clarification_needed (questions present) or success with the path of
    the rendered file ``generated/<tech>/<tech>_server.py``."""
    v = F.try_parse_json(F.col(body))
    p = F.from_json(F.col(body), PLAN)
    missing = F.array_compact(F.array(*[F.when(F.try_variant_get(v, f"$.{f}", PLAN_TYPES.get(f, "string")).isNull(), F.lit(f))
                                        for f in required]))
    tech = p["technology_lower"]
    qs = p["clarification_questions"]
    nq = F.coalesce(F.when(qs.isNotNull(), F.size(qs)), F.lit(0))  # size(NULL) is -1 without ANSI
    bad = v.isNull() | (F.size(missing) > 0)
    status = F.when(bad, "error").when(nq > 0, "clarification_needed").otherwise("success")
    path = F.when(~bad & (nq == 0), F.concat(F.lit("generated/"), tech, F.lit("/"), tech, F.lit("_server.py")))
    return plans.select(key, status.alias("status"), path.alias("file_path"),
                        F.when(bad, F.col(body)).alias("raw_result"), nq.alias("n_questions"))


def review_verdicts(reviews: DataFrame, key: str = "review_id", body: str = "body") -> DataFrame:
    """Parsed review with strict enums; invalid -> approved false.  A
    critical issue blocks approval; ``contradiction`` flags approved
    reviews that carry one."""
    r = F.from_json(F.col(body), REVIEW)
    issues = F.coalesce(r["issues"], F.array().cast(REVIEW["issues"].dataType))
    parsed = F.try_parse_json(F.col(body)).isNotNull() & r["approved"].isNotNull() & r["summary"].isNotNull()
    no = F.lit(False)  # a NULL field fails its test
    enums_ok = F.forall(issues, lambda i: F.coalesce(i["severity"].isin(*SEVERITIES), no) & F.coalesce(i["criterion"].isin(*CRITERIA), no)
                        & i["description"].isNotNull() & i["fix"].isNotNull())
    valid = F.coalesce(parsed & enums_ok, no)
    has_critical = F.exists(issues, lambda i: F.coalesce(i["severity"] == "critical", no))
    return reviews.select(
        key, valid.alias("valid"), F.when(valid, r["approved"]).otherwise(F.lit(False)).alias("approved"),
        has_critical.alias("has_critical"),
        (valid & r["approved"] & ~has_critical).alias("effective_approved"),
        (valid & r["approved"] & has_critical).alias("contradiction"),
        F.size(issues).alias("n_issues"))


def review_counts(reviews: DataFrame, body: str = "body") -> DataFrame:
    """Issue counts by severity and criterion (reviews without issues count
    under NULL/NULL)."""
    r = F.from_json(F.col(body), REVIEW)
    e = reviews.select(F.explode_outer(r["issues"]).alias("i"))
    return e.groupBy(F.col("i.severity").alias("severity"), F.col("i.criterion").alias("criterion")) \
            .agg(F.count(F.lit(1)).alias("n"))


def review_intake(requests: DataFrame, files: DataFrame, key: str = "request_id") -> DataFrame:
    """Checks before a file is reviewed, in order: no path, missing file,
    not ``.py``, empty (whitespace only).  Failing rows get approved=false
    and the reason; passing rows have NULL approved (they go to review)."""
    # only whether it is empty goes through the join, not the content
    f = files.select(F.col("path").alias("_fpath"), (F.regexp_replace(F.col("content"), r"\s", "") == "").alias("_empty"))
    j = requests.join(f, F.col("path") == F.col("_fpath"), "left")
    suffix = F.regexp_extract(F.regexp_extract(F.col("path"), r"([^/]*)$", 1), r"[^.](\.[^.]*)$", 1)
    # The texts of the four reasons.
    reason = (F.when(F.col("path").isNull() | (F.col("path") == ""), F.lit("No file path provided"))
              .when(F.col("_fpath").isNull(), F.concat(F.lit("File not found: "), F.col("path")))
              .when(suffix != ".py", F.concat(F.lit("Expected a .py file, got: "), suffix))
              .when(F.col("_empty"), F.lit("File is empty.")))
    return j.select(key, "path", F.when(reason.isNotNull(), F.lit(False)).alias("approved"), reason.alias("reason"))


# Fixed value: fields of a research context, top level and nested.
CONTEXT_FIELDS = ("technology", "summary", "client_library", "operations", "connection_config",
                  "minimal_working_example", "idioms_and_gotchas", "sources_consulted", "confidence_notes")
CONTEXT_NESTED = ("client_library.name", "client_library.version", "client_library.install_command",
                  "client_library.main_classes", "connection_config.required_params",
                  "connection_config.optional_params", "connection_config.example_minimal_config")


def context_gaps(ctx: DataFrame, key: str = "ctx_id", body: str = "body") -> DataFrame:
    """Research-context parse: which required fields are missing or null
    (nested fields are checked only when their parent is present)."""
    v = F.try_parse_json(F.col(body))

    def absent(path):
        return F.try_variant_get(v, f"$.{path}", "variant").isNull() | \
               (F.to_json(F.try_variant_get(v, f"$.{path}", "variant")) == "null")

    top = [F.when(absent(f), F.lit(f)) for f in CONTEXT_FIELDS]
    nested = [F.when(~absent(p.split(".")[0]) & absent(p), F.lit(p)) for p in CONTEXT_NESTED]
    missing = F.array_compact(F.array(*top, *nested))
    return ctx.select(key, v.isNotNull().alias("parsed"),
                      F.when(v.isNotNull(), F.array_join(missing, ",")).alias("missing_fields"),
                      F.when(v.isNotNull(), F.size(missing) == 0).otherwise(F.lit(False)).alias("complete"))


