"""Exact top-k search by inner product over KD-trees, one a shard.

Vectors are dealt to shards of about `shard_rows` by a hash of their id. A shard's tree splits at medians of the
widest dimension and keeps a tight box per node. A query goes through it best first: the node whose box allows
the highest score comes next, until no box reaches the query's k-th score. That score is propagated: one shard is
searched by all queries first, and its k-th scores are where every other shard starts to prune.

Scores are whole numbers, so results don't depend on the order of sums.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.llm.common import table
from scenelake.session import cut_lineage


@dataclass(frozen=True)
class SearchParameters:
    """`k`: hits a query. `shard_rows`: vectors a shard holds on average. `leaf_rows`: most in a leaf of a
    tree. `block_rows`: queries that meet a shard at once, about; more queries read the shard again."""

    k: int = 10
    shard_rows: int = 1024
    leaf_rows: int = 64
    block_rows: int = 4096


LARGEST = (1 << 63) - 1


def whole_numbers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, at most what 64 bits hold; null for a vector that is null or has null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Tree:
    """Median splits with tight boxes; nodes are numbered, children after their parent."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int):
        self.lo, self.hi, self.children, self.spans = [], [], [], []
        order = np.arange(len(ids))
        todo = [(0, len(ids))]
        while todo:
            a, b = todo.pop(0)
            part = rows[order[a:b]]
            lo, hi = part.min(axis=0), part.max(axis=0)
            self.lo.append(lo)
            self.hi.append(hi)
            self.spans.append((a, b))
            if b - a <= leaf_rows or not part.shape[1]:
                self.children.append(None)
                continue
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, np.argmax(hi - lo)], half)]
            first = len(self.spans) + len(todo)
            self.children.append((first, first + 1))
            todo += [(a, a + half), (a + half, b)]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        self.ids, self.rows = ids[order], rows[order]

    def search(self, queries: np.ndarray, own: np.ndarray, floors: list, k: int):
        """For each query its k best (score, -id) at or above its floor; `own` is the id it doesn't meet."""
        bounds = np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T
        for query, mine, floor, bound in zip(queries, own, floors, bounds):
            best: list[tuple[int, int]] = []
            heap = [(-bound[0], 0)]
            while heap:
                most, node = heapq.heappop(heap)
                if floor is not None and -most < floor:
                    break
                if self.children[node]:
                    for child in self.children[node]:
                        heapq.heappush(heap, (-bound[child], child))
                    continue
                a, b = self.spans[node]
                scores = self.rows[a:b] @ query
                near = np.arange(b - a) if floor is None else np.flatnonzero(scores >= floor)
                for i in near:
                    if self.ids[a + i] != mine:
                        hit = (int(scores[i]), -int(self.ids[a + i]))
                        if len(best) < k:
                            heapq.heappush(best, hit)
                        elif hit > best[0]:
                            heapq.heapreplace(best, hit)
                if len(best) == k and (floor is None or best[0][0] > floor):
                    floor = best[0][0]
            yield best


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, all of one length. Doubles are exact here while sums stay below 2^53; beyond,
    Python's own whole numbers are used."""
    column = column.combine_chunks()
    rows = np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return rows


def _exact(vectors: np.ndarray, queries: np.ndarray) -> type:
    most = [float(np.abs(x.astype(float)).max(initial=0)) for x in (vectors, queries)]
    return np.float64 if most[0] * most[1] * max(1, vectors.shape[1]) < 2**52 else object


def _search_shards(vectors: DataFrame, queries: DataFrame, p: SearchParameters) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            rows, asked = _numbers(left["v"]), _numbers(right["v"])
            kind = _exact(rows, asked)
            tree = Tree(np.asarray(left["id"]), rows.astype(kind), p.leaf_rows)
            own, floors = np.asarray(right["id"]), right["floor"].to_pylist()
            for at in range(0, len(own), 512):
                part = slice(at, at + 512)
                found = tree.search(asked[part].astype(kind), own[part], floors[part], p.k)
                for q, best in zip(own[part], found):
                    out += [(int(q), -minus, min(max(score, -LARGEST - 1), LARGEST)) for score, minus in best]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table(
            {n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)}
        )

    by = ["dim", "shard", "block"]
    return vectors.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(
        run, "query_id long, vec_id long, score long"
    )


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, queries: DataFrame, p: SearchParameters = SearchParameters()) -> DataFrame:
    """The k best rows of each query: query_id, rank, vec_id, score.

    Both tables are (id, v), v whole numbers; rows with a null id or v take no part, and vectors meet only those
    of their own length. A query doesn't meet rows of its own id. Ties go to the smaller id. Fewer rows than k,
    or none: so many hits. Scores are exact while they fit 64 bits; beyond, they are the largest or smallest such number,
    and those of one query tie. Ids are to be unique: rows that repeat one are each a candidate, and a repeated query
    id gathers the hits of all its rows.
    """
    rows = cut_lineage(rows.where("id is not null and v is not null").withColumn("dim", F.size("v")))
    n = rows.count()
    shards = max(1, round(n / p.shard_rows))
    asked = queries.where("id is not null and v is not null").withColumn("dim", F.size("v"))
    blocks = max(1, -(-asked.count() // p.block_rows))
    hashed = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    asked = asked.withColumn("block", hashed(1, blocks))
    dealt = rows.withColumn("shard", hashed(2, shards)).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    first = _search_shards(
        dealt.where("shard = 0"),
        asked.withColumn("shard", F.lit(0)).withColumn("floor", F.lit(None).cast("long")),
        p,
    )
    first = cut_lineage(_best(first, p.k).select("query_id", "vec_id", "score"))
    if shards == 1:
        hits = first
    else:
        floors = first.groupBy("query_id").agg(
            F.when(F.count("*") >= p.k, F.min("score")).alias("floor")
        )
        rest = asked.join(floors, asked["id"] == floors["query_id"], "left").drop("query_id").withColumn(
            "shard", F.explode(F.sequence(F.lit(1), F.lit(shards - 1)))
        )
        hits = first.unionByName(_search_shards(dealt.where("shard > 0"), rest, p))
    return _best(hits, p.k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op5_exact_top_k(spark, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "embeddings")
    rows = source.select(F.col("vec_id").alias("id"), whole_numbers(F.col("embedding")).alias("v"))
    return top_k(rows, rows.where("id % 100 = 0"))
