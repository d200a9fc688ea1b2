"""Exact top-k search: tiles of queries by shards of candidates, merged as a tree.

A tile is one matrix product and one partial selection per query, so nothing larger than a
tile is ever held. Lists of `k` per query and shard are merged in groups of `FAN_IN` shards
until one list per query is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAN_IN = 32
EXACT = 2.0**53


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products (rows by rows), exact: in doubles where every sum fits them."""
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)), np.int64)
    most = float(np.abs(queries).max()) * float(np.abs(candidates).max()) * queries.shape[1]
    if most < EXACT:
        return np.rint(queries @ candidates.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    found = whole(queries) @ whole(candidates).T
    if any(abs(x) > 2**63 - 1 for x in found.flat):
        raise OverflowError("an inner product does not fit a long")
    return found.astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the `k` highest scores of every row, ties to the smaller position."""
    n = scores.shape[1]
    if n <= k:
        return np.argsort(-scores, axis=1, kind="stable") if n else np.empty((len(scores), 0), np.int64)
    if np.abs(scores).max(initial=0) < 2**62 // n:
        ranked = scores * n + np.arange(n - 1, -1, -1)
        top = np.argpartition(ranked, n - k, axis=1)[:, n - k :]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(ranked, top, 1), axis=1), 1)
    return np.stack([np.lexsort((np.arange(n), -row))[:k] for row in scores])


def search(
    vectors: DataFrame,
    is_query: F.Column,
    k: int = 5,
    scale: float = 256.0,
    query_block: int = 1024,
    shard: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` best other vectors for every query.

    `vectors`: vec_id, embedding; components become floor(scale * x). Vectors that are null
    or hold a null or a component that is not finite take no part, nor do rows with a null
    vec_id; vectors of different lengths never meet. Rows that share a vec_id are each a
    candidate, never for their own id; as queries they are asked once, by the greatest row.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    held = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), F.size("embedding").alias("d")
    )
    n, asked = held.agg(F.count("*"), F.count_if("q")).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asked // query_block))
    part = lambda count, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    cands = held.select("vec_id", "v", "d", F.lit(False).alias("q"), part(shards, 1).alias("s"), each(blocks).alias("b"))
    once = held.filter("q").groupBy("vec_id").agg(F.max_by(F.struct("v", "d"), F.struct("d", "v")).alias("r")).select("vec_id", "r.*")
    queries = once.select("vec_id", "v", "d", F.lit(True).alias("q"), part(blocks, 2).alias("b"), each(shards).alias("s"))

    def tile(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        ids, q, d = rows["vec_id"].to_numpy(), rows["q"].to_numpy(zero_copy_only=False), rows["d"][0].as_py()
        flat = pa.concat_arrays(c.flatten() for c in rows["v"].chunks)
        m = flat.to_numpy(zero_copy_only=False).reshape(len(ids), d)
        out = {"query_id": [], "vec_id": [], "score": []}
        cand = np.flatnonzero(~q)
        for at in range(0, int(q.sum()), 256):
            ask = np.flatnonzero(q)[at : at + 256]
            if not len(cand):
                break
            scores = products(m[ask], m[cand])
            # one place more for each row of the query's own id, which is taken out afterwards
            own = np.unique(ids[cand], return_counts=True)[1].max()
            top = best(scores, k + int(own))
            found = np.take_along_axis(scores, top, 1)
            other = ids[cand][top] != ids[ask][:, None]
            keep = other & (np.cumsum(other, axis=1) <= k)
            out["query_id"].append(np.broadcast_to(ids[ask][:, None], keep.shape)[keep])
            out["vec_id"].append(ids[cand][top][keep])
            out["score"].append(found[keep])
        done = {c: np.concatenate(x) if x else np.empty(0, np.int64) for c, x in out.items()}
        shard_no = np.full(len(done["score"]), rows["s"][0].as_py(), np.int32)
        return pa.table(done | {"s": shard_no})

    lists = (
        cands.unionByName(queries)
        .groupBy("b", "s", "d")
        .applyInArrow(tile, "query_id long, vec_id long, score long, s int")
    )
    while True:
        group = ["query_id"] if shards <= FAN_IN else ["query_id", "s"]
        lists = lists.withColumn("s", F.floor(F.col("s") / FAN_IN).cast("int"))
        order = Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if shards <= FAN_IN:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists, shards = lists.drop("rank"), -(-shards // FAN_IN)
