"""Queries: hit clean-up, corpus search top-k, batched clarification, page text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as SE
from .registry import register

TOK = r"regexp_extract_all(lower({c}), '\p{{L}}+')"

BM25_SQL = r"""
d AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS tok FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(len(tok)) AS avgdl FROM d),
q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(qtext), '\p{L}+')) AS term FROM queries),
occ AS (SELECT doc_id, len(tok) AS dl, unnest(tok) AS term FROM d),
tf AS (SELECT doc_id, term, dl, count(*) AS tf FROM occ WHERE term IN (SELECT term FROM q) GROUP BY ALL),
dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.doc_id, tf.term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * (1.2 + 1) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS w
      FROM tf JOIN dfreq USING (term) CROSS JOIN stats),
s AS (SELECT q.query_id, w.doc_id, sum(w.w) AS score FROM w JOIN q USING (term) GROUP BY ALL),
n AS (SELECT query_id, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 10) AS exact FROM s),
r AS (SELECT query_id, doc_id, round(exact, 4) AS score, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY exact DESC, doc_id) AS INTEGER) AS rank FROM n)"""


@register("hits_clean", """
SELECT query_id, pos, coalesce(title, '') AS title, coalesce(snippet, '') AS snippet, coalesce(url, '') AS url, CASE WHEN score IS NULL OR score = 0 THEN CAST(1.0 AS DOUBLE) ELSE score END AS score,
  coalesce(regexp_matches(url, '^https?://'), false) AS url_valid
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY pos) AS rn FROM hits) WHERE rn <= 5
""", ["hits"])
def hits_clean(fx):
    return SE.clean_hits(fx.hits(), max_results=5)


@register("fetch_rejects", """
SELECT query_id, pos, coalesce(title, '') AS title, coalesce(snippet, '') AS snippet, coalesce(url, '') AS url, CASE WHEN score IS NULL OR score = 0 THEN CAST(1.0 AS DOUBLE) ELSE score END AS score,
  CASE WHEN url IS NULL OR url = '' THEN 'no url' ELSE 'not http or https' END AS reason
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY pos) AS rn FROM hits) WHERE rn <= 5 AND NOT coalesce(regexp_matches(url, '^https?://'), false)
""", ["hits"])
def fetch_rejects(fx):
    """Hits that cannot be fetched, with the reason."""
    return SE.fetch_targets(fx.hits(), max_results=5)[1]


@register("search_topk", "WITH queries AS (SELECT item_id AS query_id, text AS qtext FROM benchmark)," + BM25_SQL + """
SELECT r.query_id, r.doc_id, r.score, r.rank, substr(d.text, 1, 200) AS snippet
FROM r JOIN documents d USING (doc_id) WHERE rank <= 5
""")
def search_topk(fx):
    q = fx.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return SE.search_topk(q, fx.documents, max_results=5)


def clarify_requests(fx):
    """Requests: technology = first word of a benchmark item, question = the rest."""
    b = fx.benchmark
    return b.select(F.col("item_id").alias("request_id"),
                    F.substring_index(F.col("text"), " ", 1).alias("technology"),
                    F.regexp_extract(F.col("text"), r"(?s)^\S*\s(.*)$", 1).alias("question"))


@register("clarify_top3", r"""WITH queries AS (
  SELECT item_id AS query_id, concat_ws(' ', split_part(text, ' ', 1), regexp_extract(text, '(?s)^\S*\s(.*)$', 1)) AS qtext FROM benchmark),
""" + BM25_SQL.lstrip() + """
SELECT query_id AS request_id, rank, doc_id, score, substr(text, 1, 60) AS title,
  'https://' || coalesce(source, 'none') || '.example.com/' || doc_id AS url, substr(text, 1, 200) AS snippet
FROM r JOIN documents USING (doc_id) WHERE rank <= 3
""")
def clarify_top3(fx):
    docs = fx.documents.select("doc_id", "text", F.substring("text", 1, 60).alias("title"),
                               F.concat(F.lit("https://"), F.coalesce("source", F.lit("none")), F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"))
    c = SE.clarify(clarify_requests(fx), docs, k=3)
    return c.select("request_id", F.explode("hits").alias("hit")).select("request_id", "hit.*")


# Stated here again: the oracle must not follow a wrong constant of the operator.
PAGE_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "\u00a9"),
                 ("&middot;", "\u00b7"), ("&mdash;", "\u2014"), ("&ndash;", "\u2013"), ("&hellip;", "\u2026"), ("&laquo;", "\u00ab"),
                 ("&raquo;", "\u00bb"), ("&reg;", "\u00ae"), ("&euro;", "\u20ac"), ("&amp;", "&")]


def _page_text_sql() -> str:
    def unesc(x):
        for ent, ch in PAGE_ENTITIES:
            e_, c_ = ent.replace("'", "''"), ch.replace("'", "''")
            x = f"replace({x}, '{e_}', '{c_}')"
        return x
    x = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ('script', 'style', 'nav', 'footer', 'aside', 'header', 'noscript', 'form'):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    x = f"""regexp_replace({x}, '(?is)<div class="ad"[^>]*>.*?</div>', ' ', 'g')"""
    title = unesc(r"trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")
    main = (f"CASE WHEN regexp_extract(x, '(?is)<article\\b[^>]*>(.*)</article>', 1) <> '' "
            f"THEN regexp_extract(x, '(?is)<article\\b[^>]*>(.*)</article>', 1) "
            f"WHEN regexp_extract(x, '(?is)<body\\b[^>]*>(.*)</body>', 1) <> '' "
            f"THEN regexp_extract(x, '(?is)<body\\b[^>]*>(.*)</body>', 1) ELSE x END")
    m = f"regexp_replace({main}, '(?i)<br\\s*/?>|</(p|h[1-6]|li|div|tr)\\s*>', chr(10), 'g')"
    m = f"regexp_replace({m}, '<[^>]*>', ' ', 'g')"
    m = unesc(m)
    m = f"regexp_replace({m}, '[ \\t\\r\\f\u00a0]+', ' ', 'g')"
    m = f"regexp_replace({m}, ' *\\n[ \\n]*', chr(10), 'g')"
    text = f"trim({m}, chr(10) || ' ')"
    return (f"SELECT page_id, url, {title} AS title, content, content = '' AS likely_script_rendered FROM ("
            f"SELECT page_id, url, html, {text} AS content FROM (SELECT page_id, url, html, {x} AS x FROM pages))")


@register("page_text", _page_text_sql())
def page_text(fx):
    return SE.page_text(fx.pages)


NESTED = ("<div class='ad'>one<div>two</div>three</div><nav title=\"a>b\">four<nav>five</nav>six</nav><header data-x='>'>seven<form><header>eight</header></form>nine</header>"
          '<div class="big ad">ten<DIV>eleven</DIV></div><script>if (a < b) "</nav>"</script><aside>twelve<!-- </aside> -->thirteen</aside>')


@register("page_text_nested", _page_text_sql())
def page_text_nested(fx):
    """Pages with nested boilerplate, either kind of quotes and ``>`` in attributes, put behind each opening body and article tag: their text is that without it."""
    html = F.regexp_replace("html", r"(?i)(<(?:article|body)\b[^>]*>)", "$1" + NESTED.replace("$", "\\$"))
    return SE.page_text(fx.pages.withColumn("html", html))
