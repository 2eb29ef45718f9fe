"""Search: hit clean-up, BM25 corpus search, batched clarification, page text.

Top-k search goes through the block-max index of ``retrieval``; ``bm25`` scores all pairs.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import retrieval
from .topk import clamp, top_k_per_group

# BM25 parameters, tokenizer, snippet length, URL rule.
K1 = 1.2
B = 0.75
TOKEN_PATTERN = r"\p{L}+"
SNIPPET_CHARS = 200
URL_PATTERN = r"^https?://"
DEFAULT_MAX_RESULTS = 5


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def clean_hits(hits: DataFrame, max_results: int = DEFAULT_MAX_RESULTS, group: str = "query_id",
               order: str = "pos") -> DataFrame:
    """NULL title/url/snippet -> '', missing or zero score -> 1.0; the first
    ``clamp(max_results)`` hits per query in given order; ``url_valid``
    marks fetchable URLs (non-empty, http or https)."""
    k = clamp(max_results)
    out = hits
    for c in ("title", "url", "snippet"):
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    sc = F.col("score").cast("double")
    out = out.withColumn("score", F.when(sc.isNull() | (sc == 0), F.lit(1.0)).otherwise(sc))
    out = out.withColumn("url_valid", F.coalesce(F.col("url").rlike(URL_PATTERN), F.lit(False)))
    return top_k_per_group(out, [group], [F.col(order).asc()], k, salt_cols=[group, order]).drop("rank")


def fetch_targets(hits: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """Clean hits -> (those that can be fetched, rejects with their ``reason``): an URL is there and is http or https."""
    h = clean_hits(hits, **kw)
    rejects = h.where(~F.col("url_valid")).withColumn("reason", F.when(F.col("url") == "", "no url").otherwise("not http or https"))
    return h.where("url_valid").drop("url_valid"), rejects.drop("url_valid")


def query_terms(queries: DataFrame, qkey: str = "query_id", qtext: str = "text") -> DataFrame:
    """Distinct (query, term) pairs."""
    return queries.select(qkey, F.explode(F.array_distinct(tokens(F.col(qtext)))).alias("term")).distinct()


def bm25(queries: DataFrame, docs: DataFrame, qkey: str = "query_id", qtext: str = "text",
         dkey: str = "doc_id", dtext: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """BM25 score of every (query, doc) sharing a term: ``qkey, dkey, score``.  All pairs are scored;
    ``search_topk`` scores only those that may be among the best."""
    d = docs.where(F.col(dkey).isNotNull()).select(dkey, tokens(F.col(dtext)).alias("_tok"))
    qt = query_terms(queries, qkey, qtext)
    stats = d.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg(F.size("_tok")).alias("_avgdl"))
    tf = d.select(dkey, F.size("_tok").alias("dl"), F.explode("_tok").alias("term")).join(qt.select("term").distinct(), "term", "left_semi") \
        .groupBy(dkey, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n_docs, avgdl = stats.select("_n").scalar(), stats.select("_avgdl").scalar()
    idf = F.log(F.lit(1.0) + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return tf.join(df, "term").select(dkey, "term", w.alias("w")).join(qt, "term").groupBy(qkey, dkey).agg(F.sum("w").alias("score"))


def corpus_index(docs: DataFrame, qterms: DataFrame | None, dkey: str = "doc_id", dtext: str = "text", carry: tuple[str, ...] = (),
                 k1: float = K1, b: float = B, **kw) -> retrieval.Index:
    """Block-max index of the documents (rows without an id are left out); of all terms where ``qterms`` is None."""
    shown = [F.col(dkey), F.substring(F.col(dtext), 1, SNIPPET_CHARS).alias("snippet"), *[F.col(c) for c in carry]]
    vocabulary = None if qterms is None else qterms.select("term").distinct()
    return retrieval.build_index(docs.where(F.col(dkey).isNotNull()), vocabulary, tokens, F.col(dtext), shown, k1=k1, b=b, **kw)


def search_topk(queries: DataFrame, docs: DataFrame, max_results: int = DEFAULT_MAX_RESULTS,
                qkey: str = "query_id", qtext: str = "text", dkey: str = "doc_id", dtext: str = "text", digits: int = 4,
                carry: tuple[str, ...] = (), **kw) -> DataFrame:
    """Top hits per query: score max-normalised to [0, 1] per query, ranked
    as it is (but for floating-point noise), ties broken by document id, and
    rounded to ``digits`` for display only; with a ~200-character snippet and the columns ``carry`` of
    the document.  Every row of ``docs`` is a document, also with an id that others have."""
    qt = query_terms(queries, qkey, qtext)
    index = corpus_index(docs, qt, dkey, dtext, carry, **kw)
    return retrieval.top_hits(index, qt, clamp(max_results), qkey=qkey, tie=dkey, digits=digits)


def clarify(requests: DataFrame, docs: DataFrame, key: str = "request_id", technology: str = "technology",
            question: str = "question", k: int = 3, dkey: str = "doc_id", carry: tuple[str, ...] = ("title", "url"), **kw) -> DataFrame:
    """Batched clarification: query = technology + ' ' + question; the best
    ``k`` hits per request as an array (bounded by k), each with id, score, snippet and ``carry``."""
    q = requests.select(key, F.concat_ws(" ", F.col(technology), F.col(question)).alias("text"))
    top = search_topk(q, docs, max_results=k, qkey=key, dkey=dkey, carry=carry, **kw)
    arr = F.array_sort(F.collect_list(F.struct("rank", dkey, "score", *carry, "snippet")))
    return top.groupBy(key).agg(arr.alias("hits"))


# -- page text ---------------------------------------------------------------------

# Named HTML entities decoded by the page-text extractor.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"),
            ("&hellip;", "…"), ("&laquo;", "«"), ("&raquo;", "»"), ("&reg;", "®"),
            ("&euro;", "€"), ("&amp;", "&")]
DROP_BLOCKS = ("script", "style", "nav", "footer", "aside", "header", "noscript", "form")


RAW_BLOCKS = ("script", "style", "noscript")  # unclosed, they run to the end of the page
#: Named entities beyond those: the names that HTML gives to code points.
NAMED = {n: chr(c) for n, c in sorted(name2codepoint.items())} | {e[1:-1]: ch for e, ch in ENTITIES}
OTHER_ENTITY = "&(?!(?:" + "|".join(e[1:-1] for e, _ in ENTITIES) + ");)(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _any_entity(c: Column) -> Column:
    """All named and numeric entities decoded in one pass (nothing is decoded twice); unknown ones stay.
    Code points that are no characters become U+FFFD."""
    names = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")  # one literal, folded by the optimizer
    name = lambda p: F.regexp_extract(p, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
    parts = F.transform(F.split(c, "&", -1), lambda p, i: F.struct(i.alias("i"), p.alias("p"), name(p).alias("n")))

    def one(x: Column) -> Column:
        n = x["n"]
        code = F.when(F.lower(F.substring(n, 1, 2)) == "#x", F.conv(F.substring(n, 3, 6), 16, 10)).otherwise(F.substring(n, 2, 7)).try_cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        known = F.when(n.startswith("#"), char).otherwise(F.try_element_at(names, n))
        rest = F.substring(x["p"], F.length(n) + 2, F.length(x["p"]))
        return F.when(x["i"] == 0, x["p"]).when((n != "") & known.isNotNull(), F.concat(known, rest)).otherwise(F.concat(F.lit("&"), x["p"]))

    return F.array_join(F.transform(parts, one), "")


def unescape(c: Column) -> Column:
    """Entities decoded; pages with the common ones only take plain replacements."""
    plain = c
    for ent, ch in ENTITIES:
        plain = F.replace(plain, F.lit(ent), F.lit(ch))
    return F.when(c.rlike(OTHER_ENTITY), _any_entity(c)).otherwise(plain)


#: A tag, with quoted attributes that may hold ``>``.
TAG = r"""<(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
#: A comment, a raw block whole, a tag, or the text up to the next ``<``.
PAGE_TOKEN = rf"(?is)<!--.*?-->|<({'|'.join(RAW_BLOCKS)})\b[^>]*+>.*?(?:</\1\s*>|\z)|{TAG}|[^<]++|<"
AD_CLASS = r"""(?is)\sclass\s*=\s*(?:"(?:[^"]*\s)?ad(?:\s[^"]*)?"|'(?:[^']*\s)?ad(?:\s[^']*)?'|ad(?=[\s>]))"""


def main_tokens(tokens: Column) -> Column:
    """The tokens of a page without comments, raw blocks and dropped blocks (with all that is nested in them).

    Only opening and closing tags of such blocks, and of ``div``, are walked through, with the block's tag and
    the depth of it: a block ends where its own tag closes.  A block that is never closed is none."""
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    marks = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), name(t).alias("tag"), t.startswith("</").alias("close"), F.rlike(t, F.lit(AD_CLASS)).alias("ad")))
    blocks = [b for b in DROP_BLOCKS if b not in RAW_BLOCKS]
    events = F.filter(marks, lambda m: m["tag"].isin(*blocks, "div"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(F.lit("").alias("tag"), F.lit(0).alias("depth"), F.lit(0).alias("a"), none.alias("out"))

    def state(tag, depth, at, out):
        return F.struct(tag.alias("tag"), depth.alias("depth"), at.alias("a"), out.alias("out"))

    def step(s, m):
        opens = ~m["close"] & (m["tag"].isin(*blocks) | m["ad"])
        inside = m["tag"] == s["tag"]
        ends = inside & m["close"] & (s["depth"] == 1)
        done = F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), m["i"].alias("b"))))
        return F.when((s["tag"] == "") & opens, state(m["tag"], F.lit(1), m["i"], s["out"])) \
            .when(ends, state(F.lit(""), F.lit(0), F.lit(0), done)) \
            .when(inside, state(s["tag"], F.when(m["close"], s["depth"] - 1).otherwise(s["depth"] + 1), s["a"], s["out"])).otherwise(s)

    dropped = F.aggregate(events, start, step, lambda s: s["out"])
    raw = rf"(?i)^<(?:!--|(?:{'|'.join(RAW_BLOCKS)})\b)"
    # computed once, as the element of an array
    return F.transform(F.array(dropped), lambda d: F.transform(
        tokens, lambda t, i: F.when(F.rlike(t, F.lit(raw)) | F.exists(d, lambda x: i.between(x["a"], x["b"])), " ").otherwise(t)))[0]


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title and main text of a page: comments, scripts, styles and
    boilerplate blocks removed, however they are nested; the ``<article>`` if present, else the
    body; tags stripped, entities decoded, whitespace collapsed.  Empty
    text is flagged ``likely_script_rendered``.  Each step is a column of its
    own, so that no text is rewritten twice."""
    p = pages.select("page_id", "url", F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("_title"),
                     F.regexp_extract_all(F.col(html), F.lit(PAGE_TOKEN), 0).alias("_tokens"))
    p = p.select("page_id", "url", "_title", F.array_join(main_tokens(F.col("_tokens")), "").alias("_x"))
    p = p.withColumn("_art", F.regexp_extract("_x", r"(?is)<article\b[^>]*>(.*)</article>", 1))
    p = p.withColumn("_body", F.when(F.col("_art") == "", F.regexp_extract("_x", r"(?is)<body\b[^>]*>(.*)</body>", 1)))
    main = F.when(F.col("_art") != "", F.col("_art")).when(F.col("_body") != "", F.col("_body")).otherwise(F.col("_x"))
    main = F.regexp_replace(main, r"(?i)<br\s*/?>|</(p|h[1-6]|li|div|tr)\s*>", "\n")
    p = p.select("page_id", "url", "_title", F.regexp_replace(F.regexp_replace(main, TAG, " "), r"<[^>]*>", " ").alias("_main"))
    text = F.regexp_replace(unescape(F.col("_main")), r"[ \t\r\f ]+", " ")
    text = F.trim(F.regexp_replace(text, r" *\n[ \n]*", "\n"), F.lit("\n "))
    p = p.select("page_id", "url", unescape(F.col("_title")).alias("title"), text.alias("content"))
    return p.withColumn("likely_script_rendered", F.col("content") == "")
