"""Near-duplicate embeddings by randomised-rotation binary codes.

Every vector is scaled to length one, rotated by one fixed random rotation and kept as the
signs of its coordinates, together with a correction factor: the inner product of the vector
and its own code. The inner product of a code with another rotated vector, divided by that
factor, estimates their cosine without bias, and its error has a standard bound. Only pairs
whose bound reaches the threshold are computed again exactly.

Vectors meet within their label and length only, in tiles of bounded size; a tile returns
counts of links and a forest, never its pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import map_batches
from tracemill.llm.links import components, roots, tiled
from tracemill.session import cut_lineage

STRIPE = 512


@lru_cache(maxsize=8)
def rotation(d: int, seed: int = 20240607) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest part first, so that no square overflows."""
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes and correction factors of unit vectors (rows)."""
    d = vectors.shape[1]
    turned = vectors @ rotation(d).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(d)


def error_scale(factors: np.ndarray, d: int, confidence: float) -> np.ndarray:
    """Bound of the estimate's error, per unit of the sine between the two vectors."""
    if d == 1:
        return np.full(len(factors), np.inf)
    spread = np.sqrt(np.maximum(0, 1 - factors**2)) / factors
    return confidence * spread / np.sqrt(d - 1)


def usable(column: str) -> F.Column:
    """Not null, not empty, all components finite, and one of them not zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(column) > 0) & F.exists(column, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    flat = pa.concat_arrays(c.flatten() for c in column.chunks) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def linked(vectors: DataFrame, threshold: float = 0.98, confidence: float = 6.0, block: int = 1024) -> DataFrame:
    """(vec_id, n, root) per vector and tile that has links: their number, and a linked vector.

    `vectors`: vec_id long, label, embedding (array of double), all usable.
    """

    def code(batch: pa.RecordBatch) -> dict:
        embedding = batch.column(2)
        lengths = np.diff(embedding.offsets.to_numpy())
        codes, factors = [None] * batch.num_rows, np.zeros(batch.num_rows)
        for d in np.unique(lengths):
            rows = np.flatnonzero(lengths == d)
            packed, found = encode(_unit(_matrix(pa.chunked_array([embedding.take(pa.array(rows))]), d)))
            factors[rows] = found
            for i, r in enumerate(rows):
                codes[r] = packed[i].tobytes()
        return {
            "vec_id": batch.column(0),
            "cell": batch.column(1),
            "embedding": embedding,
            "code": pa.array(codes, pa.binary()),
            "factor": pa.array(factors, pa.float64()),
        }

    def tile(rows: pa.Table) -> pa.Table:
        ids, side = rows["vec_id"].to_numpy(), rows["side"].to_numpy()
        d = len(rows["embedding"][0])
        unit = _unit(_matrix(rows["embedding"], d))
        packed = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        signs = np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1
        turned = (unit @ rotation(d).T).astype(np.float32)
        factors = rows["factor"].to_numpy()
        lowest = threshold - np.sqrt(1 - threshold**2) * error_scale(factors, d, confidence) - 1e-5
        one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        found = [], []
        for at in range(0, len(one), STRIPE):
            left = one[at : at + STRIPE]
            estimate = (signs[left] @ turned[two].T) / (np.sqrt(d) * factors[left, None])
            i, j = np.nonzero(estimate >= lowest[left, None])
            a, b = left[i], two[j]
            for part in range(0, len(a), 65536):  # bounded memory however many pairs are close
                pa_, pb_ = a[part : part + 65536], b[part : part + 65536]
                exact = np.einsum("ij,ij->i", unit[pa_], unit[pb_]) >= threshold
                keep = exact & (ids[pa_] != ids[pb_])
                found[0].append(pa_[keep])
                found[1].append(pb_[keep])
        a, b = (np.concatenate(f) if f else np.empty(0, np.int64) for f in found)
        n = np.bincount(a, minlength=len(ids))
        if side[0] != 2:
            n = n + np.bincount(b, minlength=len(ids))
        root = roots(len(ids), a, b)
        rows_in = np.flatnonzero(n)
        return pa.table({"vec_id": ids[rows_in], "n": n[rows_in].astype(np.int64), "root": ids[root[rows_in]]})

    cells = F.xxhash64("label", F.size("embedding"))
    coded = map_batches(
        vectors.select("vec_id", cells.alias("cell"), F.col("embedding").cast("array<double>")),
        code,
        "vec_id long, cell long, embedding array<double>, code binary, factor double",
    )
    dealt = tiled(cut_lineage(coded), "cell", [0], block, ["vec_id"])
    return dealt.groupBy("tile").applyInArrow(tile, "vec_id long, n long, root long")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, confidence: float = 6.0, block: int = 1024) -> DataFrame:
    """One row per row of `embeddings`: vec_id, n_links, component_id, kept.

    Labels must be equal and not null. Vectors that are null, empty, zero, or hold a null or
    a component that is not finite link with nothing, nor do rows with a null vec_id (kept,
    without a component). Rows that share a vec_id are one vector's: they never link with
    each other and their links are counted together. Other columns are not used. With the
    default confidence a link is missed with a probability below one in ten million.
    """
    ids = embeddings.select(F.col("vec_id").cast("long"), "label", "embedding")
    fit = ids.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
    found = cut_lineage(linked(fit, threshold, confidence, block))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    roots_ = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    both = counts.join(roots_.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = ids.select("vec_id").join(both, "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
