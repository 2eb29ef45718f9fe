"""Top-k retrieval with a block-max index: only documents that may reach the top are scored.

* The corpus is tokenised once into a written postings table; each row of ``docs`` is a document of its
  own (repeated ids stay apart) in one of the blocks of about ``BLOCK_DOCS`` documents.
* The block-max index holds the largest weight of each (term, block) and the document that has it.
* The best documents of each query term are scored whole.  The k-th best of them is a
  score that the query's answers reach at least: its threshold.
* Blocks whose maxima of all terms of a query do not add up to the threshold are skipped for it.
* In the other blocks terms go from the largest maximum down.  While the maxima of the
  rest reach the threshold, any document may be an answer; from then on only documents are
  followed whose weights so far and the maxima of the rest still reach it.

Scores are complete for every document that is returned, so the result equals that of scoring all pairs.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .joins import BROADCAST_MAX_ROWS, fits
from .topk import top_k_per_group

#: Documents of a block, and queries that one task looks at together.
BLOCK_DOCS = 1024
QUERY_GROUP = 2000
#: Differences of scores below this share of a query's greatest possible score are taken for noise.
NOISE = 1e-9


class Index(NamedTuple):
    """Weights of the postings, the block-max table, the documents' rows, and the terms with their numbers."""
    weights: DataFrame
    maxima: DataFrame
    documents: DataFrame
    terms: DataFrame


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder, computed once."""
    path = scratch_path(df.sparkSession, "retrieval", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_index(docs: DataFrame, vocabulary: DataFrame | None, tokens, text: Column, carry: list[Column], *, k1: float, b: float,
                block_docs: int = BLOCK_DOCS) -> Index:
    """Index of ``docs``: of all its terms, or of those of ``vocabulary`` (term) only.

    ``tokens`` maps the text column to its array of terms; ``carry`` are the columns that hits show.
    Every document leaves one row with an empty term, which counts the corpus and holds
    the carried columns; a null text has no terms."""
    spark = docs.sparkSession
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*carry).alias("shown"), text.alias("_text"))
    cores = spark.sparkContext.defaultParallelism
    if d.rdd.getNumPartitions() * 2 <= cores:  # a few files, read by fewer tasks than there are cores (so of bounded size): deal the texts out before the work on them
        d = d.repartition(cores, "row")
    d = d.withColumn("_tok", F.coalesce(tokens(F.col("_text")), F.array().cast("array<string>"))).drop("_text")
    occ = d.select("row", F.size("_tok").alias("dl"), "shown", F.explode(F.concat("_tok", F.array(F.lit("")))).alias("term"))
    if vocabulary is not None:
        keep = vocabulary.unionByName(spark.range(1).select(F.lit("").alias("term")))
        occ = occ.join(F.broadcast(keep) if fits(vocabulary) else keep, "term", "left_semi")
    shown = F.when(F.col("term") == "", F.col("shown"))
    postings = _written(occ.groupBy("row", "term", "dl", shown.alias("shown")).agg(F.count(F.lit(1)).alias("tf")), "postings")
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("length"))
    terms = _written(terms.withColumn("number", F.monotonically_increasing_id()), "terms")
    corpus = terms.where("term = ''").first()
    n_docs = corpus.df if corpus else 0
    avgdl = corpus.length / n_docs if n_docs and corpus.length else 1.0
    found = postings.where("term <> ''").select("row", "term", "dl", "tf").join(terms, "term")
    idf = F.log(F.lit(1.0) + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    block = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n_docs // block_docs)))).alias("block")
    weights = found.select("row", F.col("number").alias("term"), block, w.alias("w"))
    maxima = weights.groupBy("term", "block").agg(F.max("w").alias("m"), F.max_by("row", "w").alias("best"))
    return Index(weights, _written(maxima, "maxima"), postings.where("term = ''").select("row", "shown"), terms.select("term", "number"))


def _block_hits(k: int, counts: bool):
    """Candidates of each query in one block, or (``counts``) how many pairs there are and how many were scored whole."""
    def run(postings: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(postings) and len(plan):
            term_of, terms = pd.factorize(postings.term)
            rows, doc_of = np.unique(postings.row.to_numpy(), return_inverse=True)
            order = np.lexsort((doc_of, term_of))
            first = np.searchsorted(term_of[order], np.arange(len(terms) + 1))
            doc_of, w = doc_of[order], postings.w.to_numpy()[order]
            most = np.maximum.reduceat(w, first[:-1])
            plan = plan.assign(code=pd.Index(terms).get_indexer(plan.term))
            for query, part in plan[plan.code >= 0].groupby("query", sort=False):
                floor = float(part.floor.iloc[0]) - float(part.noise.iloc[0])
                codes = part.code.to_numpy()
                codes = codes[np.argsort(-most[codes], kind="stable")]
                rest = np.append(np.cumsum(most[codes][::-1])[::-1], 0.0)
                score, alive = np.zeros(len(rows)), None
                for j, c in enumerate(codes):
                    docs, weight = doc_of[first[c]:first[c + 1]], w[first[c]:first[c + 1]]
                    if alive is None and rest[j] < floor:
                        alive = np.flatnonzero(score + rest[j] >= floor)
                    elif alive is not None:
                        alive = alive[score[alive] + rest[j] >= floor]
                    if alive is None:
                        score[docs] += weight  # a document has a term once
                    elif not len(alive):
                        break
                    elif len(alive) * 16 < len(docs):
                        at = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
                        hit = docs[at] == alive
                        score[alive[hit]] += weight[at[hit]]
                    else:
                        followed = np.zeros(len(rows), bool)
                        followed[alive] = True
                        followed = followed[docs]
                        score[docs[followed]] += weight[followed]
                if alive is None:
                    alive = np.flatnonzero(score > 0)
                if counts:
                    pairs = np.unique(np.concatenate([doc_of[first[c]:first[c + 1]] for c in codes]))
                    out.append((query, len(pairs), float(len(alive))))
                    continue
                alive = alive[score[alive] >= floor]
                if len(alive) > k:
                    least = np.partition(score[alive], -k)[-k] - float(part.noise.iloc[0])
                    alive = alive[score[alive] >= least]
                out += zip([query] * len(alive), rows[alive].tolist(), score[alive].tolist())
        return pd.DataFrame(out, columns=["query", "row", "score"])
    return run


def _hits(index: Index, query_terms: DataFrame, qkey: str, k: int, counts: bool = False) -> DataFrame:
    kind = query_terms.schema[qkey].dataType.simpleString()
    qt = _written(query_terms.join(index.terms, "term").select(F.col(qkey).alias("query"), F.col("number").alias("term")), "queries")
    n_pairs, n_queries = qt.agg(F.count(F.lit(1)), F.count_distinct("query")).first()
    qt = F.broadcast(qt) if n_pairs <= BROADCAST_MAX_ROWS else qt
    champions = top_k_per_group(index.maxima, ["term"], [F.desc("m"), F.asc("block")], k)
    seeds = champions.join(qt, "term").select("query", F.col("best").alias("row")).distinct()
    seeds = F.broadcast(seeds) if n_pairs * k <= BROADCAST_MAX_ROWS else seeds  # at most k per pair
    first = index.weights.join(seeds, "row").join(qt, ["query", "term"]).groupBy("query", "row").agg(F.sum("w").alias("score"))
    floor = top_k_per_group(first, ["query"], [F.desc("score"), F.asc("row")], k).groupBy("query") \
        .agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0.0).alias("floor"))
    reach = index.maxima.groupBy("term").agg(F.max("m").alias("top")).join(qt, "term").groupBy("query").agg((F.sum("top") * NOISE).alias("noise"))
    known = reach.join(floor, "query")
    bound = index.maxima.join(qt, "term").groupBy("query", "block").agg(F.sum("m").alias("bound")).join(known, "query").where("bound >= floor - noise")
    group = F.pmod(F.xxhash64("query"), F.lit(max(1, -(-n_queries // QUERY_GROUP)))).alias("part")
    plan = bound.select("query", "block", "floor", "noise", group).join(qt, "query")
    parts = plan.select(F.col("block").alias("own_block"), F.col("part").alias("own_part")).distinct()
    postings = index.weights.join(parts, F.col("block") == F.col("own_block")).select("row", "term", "w", "own_block", "own_part")
    return postings.groupBy("own_block", "own_part").cogroup(plan.groupBy("block", "part")) \
        .applyInPandas(_block_hits(k, counts), f"query {kind}, row long, score double")


def top_hits(index: Index, query_terms: DataFrame, k: int, *, qkey: str = "query_id", tie: str = "doc_id", digits: int = 4) -> DataFrame:
    """``qkey, score, rank`` and the carried columns of the best ``k`` documents of each query.

    Scores are divided by the query's best and ranked as they are, but for noise beyond 10 digits; ties go by the carried column
    ``tie``, then by the document's row; ``digits`` are shown.  A query without a known term has no hits."""
    s = _hits(index, query_terms, qkey, k).withColumn("_mx", F.max("score").over(Window.partitionBy("query")))
    s = s.join(index.documents, "row").withColumn("score", F.round(F.col("score") / F.col("_mx"), 10))
    top = top_k_per_group(s, ["query"], [F.desc("score"), F.col("shown")[tie].asc(), F.asc("row")], k, salt_cols=["query", "row"])
    return top.select(F.col("query").alias(qkey), F.round("score", digits).alias("score"), "rank", "shown.*")


def scored_pairs(index: Index, query_terms: DataFrame, k: int, *, qkey: str = "query_id") -> DataFrame:
    """Per query: ``pairs`` (documents with one of its terms, in blocks that were not skipped) and ``scored``, those scored whole."""
    c = _hits(index, query_terms, qkey, k, counts=True)
    return c.groupBy(F.col("query").alias(qkey)).agg(F.sum("row").alias("pairs"), F.sum("score").cast("long").alias("scored"))
