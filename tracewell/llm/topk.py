"""Exact top-k search by inner product: tiled matrix products of query tiles and
shards of the table, partial selection in each tile, and a tree of merges of the
queries' top lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import new_path, saved

SHARD_ROWS = 4096
TILE_QUERIES = 1024
FAN_IN = 16
#: bytes of vectors that a task holds, and tasks that shards are dealt to at most
TASK_BYTES, MOST_TASKS = 32 << 20, 20_000
EXACT = 2**53
LONG = (-(2**63), 2**63 - 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """row (a key of its own), id and v (whole numbers as doubles: floor(scale * x)) of the rows that take part."""
    x = F.col(vector_col)
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("double")).alias("v"), x.alias("raw"))
    finite = F.forall("raw", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return out.where(F.col("id").isNotNull() & F.col("raw").isNotNull() & finite).select(F.monotonically_increasing_id().alias("row"), "id", "v")


def tile_top(query_rows: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """counts, ids and scores (each query's one after another) of each query's k best among the rows other than its own."""
    most = max(np.abs(queries).max(initial=0), 1) * max(np.abs(vectors).max(initial=0), 1) * queries.shape[1]
    if most < EXACT:
        scores = queries @ vectors.T
    else:  # whole numbers beyond a double's exact range
        whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
        scores = np.clip(whole(queries) @ whole(vectors).T, *LONG)
    counts, out_ids, out_scores = [], [], []
    for row, own in zip(scores, query_rows, strict=True):
        other = rows != own
        if most < EXACT and len(ids) > 8 * k:
            # partial selection; ties with the k-th score stay until the sort by id
            row = np.where(other, row, -np.inf)
            edge = np.partition(row, len(row) - k)[len(row) - k]
            kept = np.flatnonzero((row >= edge) & other)
        else:
            kept = np.flatnonzero(other)
        best = sorted(zip([-int(s) for s in row[kept]], ids[kept].tolist(), strict=True))[:k]
        counts.append(len(best))
        out_ids.extend(i for _, i in best)
        out_scores.extend(-s for s, _ in best)
    return np.array(counts, np.int64), np.array(out_ids, np.int64), np.array(out_scores, np.int64)


def best(who: list[np.ndarray], ids: list[np.ndarray], scores: list[np.ndarray], queries: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """counts, ids and scores of the k best of several lists of each query."""
    who_, ids_, scores_ = np.concatenate(who), np.concatenate(ids), np.concatenate(scores)
    order = np.lexsort((ids_, ~scores_, who_))  # ~s falls as s rises, and stays within a long
    who_, ids_, scores_ = who_[order], ids_[order], scores_[order]
    kept = np.arange(len(who_)) - np.searchsorted(who_, who_) < k
    return np.bincount(who_[kept], minlength=queries).astype(np.int64), ids_[kept], scores_[kept]


def _name(out: str, by: str, dim: int, number: int) -> str:
    return f"{out}/{by}-{dim}-{number:08d}.bin"


def _packed(rows: DataFrame, by: str, out: str) -> DataFrame:
    """A file for each (dim, ``by``) with row keys, ids and vectors; returns dim, ``by``, its path and number of rows."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "row"])
        dim, number = int(frame["dim"].iloc[0]), int(frame[by].iloc[0])
        path = _name(out, by, dim, number)
        files.write(path, [frame["row"].to_numpy(np.int64).tobytes(), frame["id"].to_numpy(np.int64).tobytes(), np.stack(frame["v"].to_numpy()).astype(np.float64).tobytes()])
        return pd.DataFrame({"dim": [dim], by: [number], f"{by}_path": [path], f"{by}_n": [len(frame)]})

    return saved(rows.groupBy("dim", by).applyInPandas(pack, f"dim long, {by} long, {by}_path string, {by}_n long"), f"topk-{by}s")


def _unpacked(path: str, n: int | None, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row keys, ids and vectors of a file of n rows, or as many as its size tells."""
    data = files.read(path)
    n = len(data) // (16 + 8 * dim) if n is None else n
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.int64, n, 8 * n), np.frombuffer(data, np.float64, n * dim, 16 * n).reshape(n, dim)


def top_k(vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_mod: int = 50, scale: float = 256.0, shard_rows: int = SHARD_ROWS, tile_queries: int = TILE_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products of floor(scale * x).

    Queries are the rows whose id is divisible by ``query_mod``; candidates all
    rows but the query's own. Ties go to the smaller id. Rows whose id or vector
    is null, and vectors that hold null or non-finite components, take no part.
    Rows that repeat an id are queries and candidates of their own. Vectors of
    different lengths are never compared; empty ones score 0. Scores beyond a
    long's range stop at its ends. Fewer than k candidates give fewer rows; an
    empty table gives none. Other columns play no part.
    """
    rows = saved(usable(vectors, id_col, vector_col, scale).withColumn("dim", F.size("v").cast("long")), "topk-rows")
    n = rows.count()
    n_queries = rows.where(F.col("id") % query_mod == 0).count()
    if not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # shards and tiles by hash: about as many rows in each, whatever the ids
    shards, tiles = -(-n // shard_rows), -(-n_queries // tile_queries)
    out = new_path(vectors.sparkSession, "topk-files")
    sharded = _packed(rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))), "shard", out)
    _packed(rows.where(F.col("id") % query_mod == 0).withColumn("tile", F.pmod(F.xxhash64("row"), F.lit(tiles))), "tile", out)
    # a task takes a few shards, and every tile of queries in turn, whose names follow from their numbers
    held_rows = max(1, TASK_BYTES // (8 * max(1, rows.agg(F.max("dim")).first()[0] or 1)))
    share = max(1, min(held_rows // shard_rows, shards // 64))
    dealt = sharded.withColumn("node", F.expr(f"shard div {share}")).repartition(min(MOST_TASKS, -(-shards // share)), "dim", "node").sortWithinPartitions("dim", "node", "shard")

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = list(frames)  # of the shards of one task
        for (dim, node), own in pd.concat(names, ignore_index=True).groupby(["dim", "node"]) if names else ():
            held = [_unpacked(path, n, dim) for path, n in zip(own["shard_path"], own["shard_n"], strict=True)]
            for tile in range(tiles):
                path = _name(out, "tile", dim, tile)
                if not files.exists(path):
                    continue
                q_rows, q_ids, queries = _unpacked(path, None, dim)
                found = [tile_top(q_rows, queries, *one, k) for one in held]
                counts, ids, scores = best([np.repeat(np.arange(len(q_ids)), c) for c, _, _ in found], [i for _, i, _ in found], [s for _, _, s in found], len(q_ids), k)
                yield pd.DataFrame({"dim": [dim], "tile": [tile], "node": [node], "queries": [q_ids.tobytes()], "counts": [counts.tobytes()], "ids": [ids.tobytes()], "scores": [scores.tobytes()]})

    lists = "dim long, tile long, node long, queries binary, counts binary, ids binary, scores binary"
    top = dealt.mapInPandas(multiply, lists)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        queries = np.frombuffer(frame["queries"].iloc[0], np.int64)
        column = lambda name: [np.frombuffer(x, np.int64) for x in frame[name]]
        counts, ids, scores = best([np.repeat(np.arange(len(queries)), c) for c in column("counts")], column("ids"), column("scores"), len(queries), k)
        return pd.DataFrame({"dim": [frame["dim"].iloc[0]], "tile": [frame["tile"].iloc[0]], "node": [frame["node"].iloc[0] // FAN_IN], "queries": [queries.tobytes()], "counts": [counts.tobytes()], "ids": [ids.tobytes()], "scores": [scores.tobytes()]})

    nodes = -(-shards // share)
    while nodes > 1:
        top = top.groupBy("dim", "tile", F.expr(f"node div {FAN_IN}").alias("parent")).applyInPandas(lambda _, frame: merge(frame), lists)
        nodes = -(-nodes // FAN_IN)

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                counts = np.frombuffer(row.counts, np.int64)
                rank = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1
                yield pd.DataFrame({"query_id": np.repeat(np.frombuffer(row.queries, np.int64), counts), "rank": rank, "vec_id": np.frombuffer(row.ids, np.int64), "score": np.frombuffer(row.scores, np.int64)})

    return top.mapInPandas(unpack, "query_id long, rank int, vec_id long, score long")
