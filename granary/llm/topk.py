"""Exact top-k inner products by a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

#: Vectors that pivots are fitted on and first thresholds are taken from; pivots; rows of an index block (an annulus of one
#: pivot's cell); queries that go through the index at once.
SAMPLE, PIVOTS, ANNULUS, QUERIES = 8192, 64, 2048, 4096


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): v holds floor(scale * x) of each component as doubles.

    Rows whose vec_id or vector is null, or whose vector is empty or holds a null, infinity or NaN, take no part.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit_pivots(sample: np.ndarray, pivots: int, rounds: int = 6) -> np.ndarray:
    """Centres of a few rounds of k-means over the sample; a centre that loses all its vectors stays where it was."""
    if len(sample) <= pivots:
        return sample.copy()
    centres = sample[np.linspace(0, len(sample) - 1, pivots).astype(int)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * sample @ centres.T).argmin(1)
        for k in range(pivots):
            if (near == k).any():
                centres[k] = sample[near == k].mean(0)
    return centres


def build(rows: DataFrame, pivots: np.ndarray, path_name: str = "index") -> DataFrame:
    """The index: every vector under (pivot, distance), its nearest pivot and how far that is, sorted within each pivot.

    Rows of a pivot's cell are dealt to parts by hash, each sorted by distance, so a dense cell fills no one task.
    """
    spread, width = rows.sparkSession.sparkContext.broadcast(pivots), pivots.shape[1]
    out = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("pivot", pa.int32()), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = spread.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), width)
                square = np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1) - 2 * x @ p.T, 0)
                near = square.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(np.sqrt(square[np.arange(len(x)), near]))], schema=out)

    keyed = rows.mapInArrow(run, "vec_id long, v array<double>, pivot int, distance double")
    parts = F.pmod(F.xxhash64("vec_id"), F.lit(16))
    return written(keyed.repartition("pivot", parts).sortWithinPartitions("pivot", "distance", "vec_id"), path_name)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _searched(index: DataFrame, queries: tuple, pivots: np.ndarray, k: int, annulus: int) -> DataFrame:
    """(query_id, vec_id, score): of each task the k best for every query of the block.

    Within a task the annuli of each cell, runs of rows sorted by distance d from the pivot, are visited from the query's
    own distance outwards. A vector in an annulus is at least max(0, |d_query - d|) from the query by the triangle
    inequality, so its score is at most (|q|^2 + max|v|^2 - that^2) / 2; annuli that can't reach the query's k-th score
    so far are left out, and with them all beyond on that side whose vectors are no longer.
    """
    spread = index.sparkSession.sparkContext.broadcast((queries, pivots))
    width = pivots.shape[1]
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (qid, q, least), p = spread.value
        norm = (q**2).sum(1)
        reach = np.sqrt(np.maximum(norm[:, None] + (p**2).sum(1) - 2 * q @ p.T, 0))
        least = least.copy()
        top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(qid)
        for batch in batches:
            for at in range(0, batch.num_rows, 16 * annulus):
                part = batch.slice(at, 16 * annulus)
                ids, x = part.column(0).to_numpy(), _matrix(part.column(1), width)
                cell, far = part.column(2).to_numpy(), part.column(3).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
                rings = [(s, min(s + annulus, b)) for a, b in zip(cuts, cuts[1:]) for s in range(a, b, annulus)]
                longest = [(x[a:b] ** 2).sum(1).max() for a, b in rings]
                # Each query begins with the annulus that it lies in or next to; all queries that still need one share its product.
                gap = np.stack([np.maximum(0, np.maximum(far[a:b].min() - reach[:, cell[a]], reach[:, cell[a]] - far[a:b].max())) for a, b in rings], 1)
                bound = (norm[:, None] + np.array(longest) - np.maximum(gap - 1e-6 * (1 + gap), 0) ** 2) / 2
                for ring in np.argsort(-bound.max(0), kind="stable"):
                    need = np.flatnonzero(bound[:, ring] >= least)
                    if not len(need):
                        continue
                    a, b = rings[ring]
                    product = q[need] @ x[a:b].T
                    product[qid[need][:, None] == ids[a:b]] = -np.inf
                    hits = product >= least[need][:, None]
                    for r in np.flatnonzero(hits.any(1)):
                        n, h = need[r], np.flatnonzero(hits[r])
                        h = h[product[r, h] > -np.inf]
                        i, s = np.concatenate([top[n][0], ids[a:b][h]]), np.concatenate([top[n][1], product[r, h]])
                        keep = best(i, s, k)
                        top[n] = i[keep], s[keep]
                        if len(keep) == k:
                            least[n] = max(least[n], s[keep][-1])
        if sizes := [len(i) for i, _ in top]:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, sizes)), pa.array(np.concatenate([i for i, _ in top])), pa.array(np.rint(np.concatenate([s for _, s in top])).astype(np.int64))], schema=out)

    return index.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 5, sample: int = SAMPLE, pivots: int = PIVOTS, annulus: int = ANNULUS, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query (all, if fewer) among all rows but its own vec_id.

    is_query: a condition on vec_id. Pivots are fitted on a sample of at most `sample` rows, chosen by a hash of vec_id; all
    rows are indexed, and the search is exact. Queries go through the index in blocks of `block`, so that what a task
    holds is bounded. A query id in several rows counts once; a candidate's repeated rows each take a rank. Vectors of
    another length than the first sample's take no part. Empty table: empty result.
    """
    spark = vectors.sparkSession
    folder = shared_dir(spark)
    rows = whole_vectors(vectors)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    schema = "query_id long, rank int, vec_id long, score long"
    if not chosen:
        return spark.createDataFrame([], schema)
    width = len(chosen[0].v)
    chosen = [r for r in chosen if len(r.v) == width]
    rows = rows.filter(F.size("v") == width)
    ids, known = np.array([r.vec_id for r in chosen]), np.array([r.v for r in chosen])
    centres = fit_pivots(known, pivots)
    index = build(rows, centres)
    wanted = written(rows.filter(is_query).dropDuplicates(["vec_id"]).repartitionByRange("vec_id"), "queries", folder)
    held, found, number = [], None, 0

    def search() -> DataFrame:
        qid, q = np.array([r.vec_id for r in held]), np.array([r.v for r in held])
        # k-th scores within the sample: no final one is lower.
        first = np.full(len(qid), -np.inf)
        if len(ids) > k:
            score = q @ known.T
            score[qid[:, None] == ids] = -np.inf
            first = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
        return written(_ranked(_searched(index, (qid, q, first), centres, k, annulus), k), f"found{number}", folder)

    for row in wanted.toLocalIterator():
        held.append(row)
        if len(held) == block:
            part = search()
            found, held, number = part if found is None else found.unionByName(part), [], number + 1
    if held:
        part = search()
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
