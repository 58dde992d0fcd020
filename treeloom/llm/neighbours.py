"""Approximate nearest neighbours with a permutation index.

Vectors are dealt to chunks of bounded size by a hash, and each chunk has an index of its
own.  Its pivots are a bounded sample, the ``n_pivots`` vectors with the smallest hashes.
Every vector is represented by the ordered list of its ``prefix`` nearest pivots, and
posted in the inverted files of these pivots alone: a posting is a vector and the place of
the pivot in its list.  A query reads the files of its own ``prefix`` pivots and no other
(about ``prefix ** 2 / n_pivots`` postings for each vector of the chunk, 1 by default); the
postings it meets add up to the footrule distance of the two lists, where a pivot missing
from a list stands behind its end.  The ``share`` of the chunk with the smallest distances,
and ``extra`` vectors for each neighbour wanted, are reranked with exact inner products.
Both hold at every size.

Equal vectors form one class, indexed once with its smallest ids (as many as a result can
name), so a very common vector costs no more than another.  Queries are dealt to blocks of
bounded size; each pair of a block and a chunk is one task, and the best of all chunks are
merged.

Vectors that are null, all zero, or hold null or non-finite components take no part;
neither do rows without an id.  Vectors of different lengths have no inner product: each
length is searched by itself.  A row repeated with the same id and vector counts once.
Fewer candidates than ``k``: all are returned.  An empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_keys, salted_join


class PermutationIndex:
    """The inverted files of one chunk; the first ``n_pivots`` vectors are its pivots."""

    def __init__(self, vectors: np.ndarray, n_pivots: int, prefix: int):
        self.vectors, self.pivots = vectors, vectors[:n_pivots]
        self.prefix = min(prefix, len(self.pivots))
        lists = np.concatenate([self._nearest(vectors[at : at + 2048]) for at in range(0, len(vectors), 2048)])
        # postings by pivot: whose they are, and how early the pivot stands in that list
        order = np.argsort(lists, axis=None, kind="stable")
        self.owners, self.early = order // self.prefix, self.prefix - order % self.prefix
        self.starts = np.searchsorted(lists.ravel()[order], np.arange(len(self.pivots) + 1))

    def _nearest(self, vectors: np.ndarray) -> np.ndarray:
        products = vectors @ self.pivots.T
        some = np.argpartition(-products, self.prefix - 1, axis=1)[:, : self.prefix]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(products, some, 1), axis=1, kind="stable"), 1)

    def nearer(self, own: np.ndarray) -> np.ndarray:
        """By how much each vector's list is nearer to ``own`` than one without a common pivot (half the footrule's gain)."""
        files = [slice(self.starts[p], self.starts[p + 1]) for p in own]
        # a shared pivot at places a, b brings the distance down by prefix - max(a, b), twice
        gains = [np.minimum(self.early[f], self.prefix - place) for place, f in enumerate(files)]
        return np.bincount(np.concatenate([self.owners[f] for f in files]), np.concatenate(gains), len(self.vectors))

    def search(self, queries: np.ndarray, candidates: int):
        """For each query the row numbers of its candidates and their exact inner products."""
        candidates = min(candidates, len(self.vectors))
        for query, own in zip(queries, self._nearest(queries), strict=True):
            found = np.argpartition(-self.nearer(own), candidates - 1)[:candidates]
            # a sum along each row gives the same figure wherever the row stands
            yield found, (self.vectors[found] * query).sum(axis=1)


def nearest_neighbours(
    embeddings: DataFrame, every: int = 20, k: int = 20, n_pivots: int = 1024, prefix: int = 32, share: float = 0.2,
    extra: int = 8, chunk_rows: int = 8192, block_rows: int = 16_384,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for queries whose ``vec_id`` is divisible by ``every``."""
    typed = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    usable = typed.where(
        F.col("vec_id").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    vectors = usable.withColumn("length", F.size("vector"))

    # one id more than a result names: the query's own is passed over
    lowest = vectors.withColumn("nth", F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id")))
    classes = cut(
        lowest.where(F.col("nth") <= k + 1)
        .groupBy("vector")
        .agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
        .withColumn("length", F.size("vector"))
        .withColumn("hash", F.xxhash64("vector"))
    )
    posed = cut(
        vectors.where(F.col("vec_id") % every == 0)
        .select(F.col("vec_id").alias("query_id"), "vector", F.xxhash64("vector").alias("hash"))
        .distinct()
    )
    often = hot_keys(posed.groupBy("hash").count(), "hash")
    named = classes.select("hash", "rep", F.col("vector").alias("own"))
    queries = cut(salted_join(posed, named, "hash", often, "query_id").where("vector = own").drop("own"))
    asked = cut(queries.groupBy("rep", "hash").agg(F.any_value("vector").alias("vector")).withColumn("length", F.size("vector")))
    chunks = max(1, math.ceil(classes.count() / chunk_rows))
    blocks = max(1, math.ceil(asked.count() / block_rows))

    def search(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(own) and len(asking):
            own = own.sort_values(["hash", "rep"], ignore_index=True)
            index = PermutationIndex(np.stack(own["vector"].to_list()), n_pivots, prefix)
            ids, candidates = own["ids"].to_list(), math.ceil(share * len(own)) + extra * (k + 1)
            hits = index.search(np.stack(asking["vector"].to_list()), candidates)
            for rep, (rows, scores) in zip(asking["rep"], hits, strict=True):
                best = np.lexsort((rows, -scores))
                best = best[scores[best] >= scores[best[: k + 1][-1]]]  # ties with the last go by id
                pairs = sorted((-scores[i], v) for i in best for v in ids[rows[i]])[: k + 1]
                out.append(pd.DataFrame({"rep": rep, "vec_id": [v for _, v in pairs], "score": [-s for s, _ in pairs]}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "vec_id": [], "score": []})

    dealt = classes.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.lit(chunks))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    asking = asked.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))
    )
    found = (
        dealt.groupBy("length", "block", "chunk")
        .cogroup(asking.groupBy("length", "block", "chunk"))
        .applyInPandas(search, "rep long, vec_id long, score double")
    )
    order = [F.desc("score"), F.asc("vec_id")]
    merged = found.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy(*order))).where(
        F.col("nth") <= k + 1
    )
    best = merged.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("best"))
    ranked = salted_join(queries.select("query_id", "rep"), best, "rep", hot_keys(queries.groupBy("rep").count(), "rep"), "query_id")
    others = F.filter("best", lambda x: x["vec_id"] != F.col("query_id"))
    return ranked.select("query_id", F.posexplode(F.slice(others, F.lit(1), F.lit(k))).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.less")).alias("score")
    )
