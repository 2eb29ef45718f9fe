"""N-gram Jaccard join: banded MinHash LSH, then exact verification.

1. Every text becomes its set of 5-word shingle hashes; texts with equal sets
   are one *text class*, carried by its smallest ``doc_id``.
2. Each class has one MinHash signature per tree (a band); two classes are candidates in a
   tree when their signatures are equal there.  The depth (values of a signature) is fixed ahead by
   a formula: the longest at which a pair of the threshold similarity is found in some tree with the
   target recall.  There is no sorted trie, and the matches do not change the depth.
3. Members of a node (the same signature in a tree) are linked to the node's smallest member (a star, so
   a node of n members gives n - 1 links) and the links' components gather
   what has to be compared.
4. Within a component every pair that sizes allow is compared exactly, on whole
   shingle sets, in blocks: a pair of threshold t has sizes within a factor t,
   so members are dealt to size bins and, when a bin is large, to
   hashed sub-blocks; only equal and neighbouring bins meet.  A task holds two blocks
   of bounded size and returns counts and a spanning star, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import shared_table
from .text import U64, Words, blocks, binary_array, mix, stream

SIGN = "doc_id long, k1 long, k2 long, n_shingles long, sig binary"
#: Docs and shingles in one block of a comparison task.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1_000_000


def recall(similarity: float, depth: int, trees: int) -> float:
    """Chance that two sets share a prefix of ``depth`` in one tree at least."""
    return 1 - (1 - similarity ** depth) ** trees


def forest_depth(threshold: float, trees: int, max_depth: int, target: float) -> int:
    """The longest signature per tree that meets the target recall."""
    depth = max_depth
    while depth > 1 and recall(threshold, depth, trees) < target:
        depth -= 1
    return depth


def signature(sh: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Upper halves of the least values of len(mult) hash functions over ``sh``."""
    least = np.full(len(mult), np.iinfo(U64).max, U64)
    for i in range(0, len(sh), 2048):
        least = np.minimum(least, (sh[i:i + 2048, None] * mult + add).min(axis=0))
    return (least >> U64(32)).astype(">u4")


def _signer(k: int, width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, add = stream(width, 3) | U64(1), stream(width, 4)
        for batch in batches:
            for at, part in blocks(batch.column(1)):
                words = Words(part)
                n = len(part)
                key, count = np.zeros((n, 2), U64), np.zeros(n, np.int64)
                sig = np.zeros((n, width), ">u4")
                for i in range(n):
                    sh = words.shingles(i, k)
                    count[i] = len(sh)
                    if len(sh):
                        key[i] = sh.sum(dtype=U64), mix(sh).sum(dtype=U64)
                        sig[i] = signature(sh, mult, add)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(key[:, 0].astype(np.int64)), pa.array(key[:, 1].astype(np.int64)),
                     pa.array(count), binary_array(sig.reshape(-1), np.arange(n + 1) * width)],
                    names=["doc_id", "k1", "k2", "n_shingles", "sig"])
    return sign


def pair_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes of sorted distinct arrays: frequent items by
    dense products of column blocks, rare ones by listing their pairs."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    item, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.float64)
    order = np.lexsort((owner, inverse))
    col, row, freq = inverse[order], owner[order], df[inverse[order]]
    for f in range(2, 9):  # rare items
        rows = row[freq == f].reshape(-1, f)
        a, b = np.triu_indices(f, 1)
        for lo in range(0, len(rows), 100_000):
            r = rows[lo:lo + 100_000]
            out += np.bincount((r[:, a] * n + r[:, b]).ravel(), minlength=n * n).reshape(n, n)
    keep = freq >= 9
    col, row = np.unique(col[keep], return_inverse=True)[1], row[keep]
    for lo in range(0, int(col.max()) + 1 if len(col) else 0, 4096):
        i, j = np.searchsorted(col, [lo, lo + 4096])
        m = np.zeros((n, min(4096, int(col[-1]) + 1 - lo)), np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        out += np.triu(m @ m.T, 1)
    return out + out.T


def compare(ids: np.ndarray, weight: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float, within: bool):
    """(index, root index, links to texts, links to documents) of the members
    that have a partner: all pairs if ``within``, else pairs across the two sides."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    inter = pair_counts(sets)
    link = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
    np.fill_diagonal(link, False)
    if not within:
        link &= side[:, None] != side[None, :]
    root = np.arange(n)
    while True:  # least index among linked members, until nothing changes
        least = np.minimum(root, np.where(link, root[None, :], n).min(axis=1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    has = np.flatnonzero(link.any(axis=1))
    return has, root[has], link.sum(axis=1)[has], (link @ weight.astype(np.int64))[has]


LINKS = "doc_id long, root long, n_texts long, n_docs long"


def _comparer(k: int, threshold: float):
    def flush(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[0], r[2]))
        words = [Words(pa.array([r[3]])) for r in rows]
        sets = [w.shingles(0, k) for w in words]
        ids = np.array([r[0] for r in rows], np.int64)
        has, root, texts, docs = compare(ids, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), sets, threshold, key[1] == key[2])
        return pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(ids[root]), pa.array(texts.astype(np.int64)), pa.array(docs.astype(np.int64))],
                                          names=["doc_id", "root", "n_texts", "n_docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:  # rows come sorted by task; a task may span batches
            c = [batch.column(i) for i in range(3)]
            for i, now in enumerate(zip(*(x.to_pylist() for x in c))):
                if now != key:
                    if rows:
                        yield flush(key, rows)
                    key, rows = now, []
                rows.append((batch.column(3)[i].as_py(), batch.column(4)[i].as_py(), batch.column(5)[i].as_py(), batch.column(6)[i].as_py()))
        if rows:
            yield flush(key, rows)
    return run


def _tasks(members: DataFrame, threshold: float) -> DataFrame:
    """Members (root, doc_id, n_docs, n_shingles) -> a row per comparison task and member:
    task key (root, left, right), doc_id, n_docs, side."""
    wide = math.log(1 / threshold)
    m = members.withColumn("bin", F.floor(F.log(F.col("n_shingles")) / F.lit(wide) + 1e-9))
    whole = m.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    per_bin = m.groupBy("root", "bin").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    blocks_of = F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("s") / BLOCK_SHINGLES))
    small = whole.where((F.col("n") <= BLOCK_DOCS) & (F.col("s") <= BLOCK_SHINGLES)).select("root", F.lit(True).alias("small"))
    a = per_bin.select("root", "bin", blocks_of.alias("nb"))
    up = a.select("root", (F.col("bin") - 1).alias("bin"), F.col("nb").alias("up"))
    down = a.select("root", (F.col("bin") + 1).alias("bin"), F.col("nb").alias("down"))
    plan = a.join(up, ["root", "bin"], "left").join(down, ["root", "bin"], "left").join(small, "root", "left")
    plan = shared_table(plan, "plan")  # a row per component and bin; the join with a hot one can be split then
    m = m.join(plan, ["root", "bin"]).withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.col("nb")))
    m = m.withColumn("me", F.col("bin") * 1_000_000 + F.col("sub"))
    span = lambda n, b: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: (F.col("bin") + b) * 1_000_000 + j)
    none = F.array().cast("array<long>")
    other = F.concat(span(F.col("nb"), 0), F.when(F.col("up").isNotNull(), span(F.col("up"), 1)).otherwise(none),
                     F.when(F.col("down").isNotNull(), span(F.col("down"), -1)).otherwise(none))
    m = m.withColumn("other", F.explode(F.when(F.col("small"), F.array(F.lit(-1).cast("long"))).otherwise(other)))
    own = F.when(F.col("small"), F.lit(-1).cast("long")).otherwise(F.col("me"))
    return m.select("root", F.least(own, "other").alias("left"), F.greatest(own, "other").alias("right"), "doc_id", "n_docs",
                    own.alias("side"))


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8,
                 trees: int = 16, max_depth: int = 6, target_recall: float = 0.999) -> DataFrame:
    """Near-duplicate classes: one row per input row with
    ``doc_id, text_class, n_copies, n_texts, n_links, class_id``.

    ``text_class`` is the smallest id with the same shingle set, ``n_copies`` the documents of it,
    ``n_texts`` the other text classes and ``n_links`` the other documents of Jaccard similarity
    ``threshold`` or more, ``class_id`` the smallest id of the component of such links.

    Texts without any word are equal only to texts of the same characters; a
    null text is equal to nothing.  A row with null id is returned as its own
    class with null ids.  Rows that repeat an id count as copies.  An empty
    table gives an empty result; columns other than id and text are ignored."""
    spark = docs.sparkSession
    depth = forest_depth(threshold, trees, max_depth, target_recall)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = base.mapInArrow(_signer(shingle, trees * depth), SIGN)
    sig = shared_table(signed, "signatures")
    wordless = base.where(F.col("text").isNull() | ~F.col("text").rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]")) \
        .select("doc_id", F.when(F.col("text").isNotNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.lit("null"), "doc_id")).alias("k1"),
                F.when(F.col("text").isNotNull(), F.xxhash64(F.lit(1), "text")).otherwise(F.xxhash64(F.lit("null"), F.lit(1), "doc_id")).alias("k2"))
    keyed = sig.where("n_shingles > 0 and doc_id is not null").select("doc_id", "k1", "k2", F.lit(0).alias("kind")) \
        .union(wordless.where("doc_id is not null").select("doc_id", "k1", "k2", F.lit(1)))
    texts = keyed.groupBy("k1", "k2", "kind").agg(F.min("doc_id").alias("text_class"), F.count("*").alias("n_copies"))
    heads = sig.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2") \
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_docs"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    heads = shared_table(heads.groupBy("doc_id").agg(F.max("n_docs").alias("n_docs"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig")), "heads")

    prefix = F.expr(f"transform(sequence(0, {trees - 1}), t -> struct(t as tree, substring(sig, t * {4 * depth} + 1, {4 * depth}) as p))")
    leaves = heads.select("doc_id", F.explode(prefix).alias("x")).select("doc_id", "x.tree", F.xxhash64("x.p").alias("p"))
    nodes = leaves.groupBy("tree", "p").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    stars = leaves.join(nodes.select("tree", "p", "low"), ["tree", "p"]).where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    near = components(stars)

    members = shared_table(near.join(heads.drop("sig"), near.node == heads.doc_id).select("root", "doc_id", "n_docs", "n_shingles"), "members")
    tasks = _tasks(members, threshold)
    texts_of = base.join(members.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    rows = tasks.join(texts_of, "doc_id").select("root", "left", "right", "doc_id", "n_docs", "side", "text")
    dealt = rows.repartition("root", "left", "right").sortWithinPartitions("root", "left", "right")
    found = shared_table(dealt.mapInArrow(_comparer(shingle, threshold), LINKS), "links")

    links = found.groupBy("doc_id").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    roots = components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    classes = texts.join(links, texts.text_class == links.doc_id, "left").drop("doc_id") \
        .join(roots, texts.text_class == roots.node, "left") \
        .select("k1", "k2", "kind", "text_class", "n_copies", F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
                (F.coalesce("n_docs", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"), F.coalesce("root", "text_class").alias("class_id"))
    out = keyed.join(classes, ["k1", "k2", "kind"]).select("doc_id", "text_class", "n_copies", "n_texts", "n_links", "class_id")
    zero = F.lit(0).cast("long")
    none = base.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("text_class"), F.lit(1).cast("long").alias("n_copies"),
                                              zero.alias("n_texts"), zero.alias("n_links"), F.lit(None).cast("long").alias("class_id"))
    return out.union(none)


def keep_one_per_class(docs: DataFrame, **params) -> DataFrame:
    """Documents with one of each near-duplicate class left: the smallest id
    (repeated rows of that id once); rows with a null id all stay."""
    classes = jaccard_join(docs, **params)
    gone = classes.where("class_id <> doc_id").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti")
    again = classes.where("class_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    single = rest.join(again, "doc_id", "left_anti")
    return single.unionByName(rest.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(docs.columns)
