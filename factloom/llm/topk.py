"""Exact top-k search by inner product in tiles.

Queries go in blocks and candidates in shards of a fixed number of vectors; every
block meets every shard in a tile, one matrix product with a partial selection
of the k best a query.  The tiles' lists are then merged as a tree, `fan` tiles
of a query at a time, so no task sees more than `fan` lists of a query.

Cases: vectors that are null, or hold null or non-finite components, take no
part; vectors of other lengths meet only their own kind; ties go to the smaller
id; equal vectors and repeated rows count one by one, as candidates and as
queries, and a row never answers a query with its own id; an empty side gives an
empty result; products that may leave 64 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import lean_groups

BLOCK, SHARD, FAN = 2048, 4096, 16
FOUND = "row long, query_id long, vec_id long, score long, tile long"


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best for each row that `queries` picks."""
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), queries.alias("q"))
    rows = rows.where(sound).select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"), "q", F.size("v").alias("d"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("m")).first()
    blocks, shards = max(1, -(-counts["m"] // BLOCK)), max(8, -(-counts["n"] // SHARD))
    left = rows.where("q").select(F.monotonically_increasing_id().alias("row"), "id", "v", "d", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    left = left.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("tile", F.col("block") * shards + F.col("shard"))
    right = rows.select(F.col("id").alias("rid"), F.col("v").alias("rv"), F.col("d").alias("rd"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).alias("shard"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("tile", F.col("block") * shards + F.col("shard"))

    def tile(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        place = (mine if mine.num_rows else theirs).column("tile")[0].as_py()
        if mine.num_rows and theirs.num_rows:
            a, b = _matrix(mine, ["row", "id"], "v", "d"), _matrix(theirs, ["rid"], "rv", "rd")
            for d in a.keys() & b.keys():
                out.append(_best(*a[d], *b[d], k))
        row, q, v, s = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(4))
        return pa.table({"row": row, "query_id": q, "vec_id": v, "score": s, "tile": np.full(len(q), place, np.int64)})

    found = left.groupBy("tile").cogroup(right.groupBy("tile")).applyInArrow(lean_groups(tile), FOUND).withColumn("tile", F.col("tile") % shards)
    width = shards
    while width > 1:
        width = -(-width // FAN)
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v")))), 1, k)
        found = found.withColumn("tile", F.floor(F.col("tile") / FAN)).groupBy("row", "query_id", "tile").agg(best.alias("best"))
        found = found.select("row", "query_id", "tile", F.posexplode("best").alias("pos", "b")).select("row", "query_id", "tile", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.v").alias("vec_id"), (-F.col("b.s")).alias("score"))
    return found.select("query_id", "rank", "vec_id", "score")


def _matrix(table: pa.Table, names: list[str], v: str, d_: str) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the columns `names` and the vectors as a matrix, ascending by the last name."""
    columns, d = [table.column(c).to_numpy() for c in names], table.column(d_).to_numpy()
    flat = table.column(v).combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    values, start = flat.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(d)))[:-1]
    out = {}
    for size in np.unique(d):
        rows = np.flatnonzero(d == size)
        rows = rows[np.argsort(columns[-1][rows], kind="stable")]
        out[int(size)] = *(c[rows] for c in columns), values[start[rows][:, None] + np.arange(size)]
    return out


def _best(row, qid, q, vid, v, k):
    """The k best candidates of each query: those above the k-th score and, of those at it, the first; candidates ascend by id."""
    n = len(vid)
    bound = max(1, q.shape[1]) * float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0))
    if bound >= 2.0**63:
        raise ValueError("inner products of these vectors do not fit 64 bits")
    score = (q.astype(float) @ v.T.astype(float)).astype(np.int64) if bound < 2**53 else q.astype(np.int64) @ v.T.astype(np.int64)
    other = qid[:, None] != vid[None, :]
    score[~other] = np.iinfo(np.int64).min  # below any product
    if n > k:
        edge = np.partition(score, n - k, axis=1)[:, n - k, None]
        above, tied = score > edge, score == edge
        pick = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    else:
        pick = np.ones(score.shape, bool)
    mine, theirs = np.nonzero(pick & other)
    return row[mine], qid[mine], vid[theirs], score[mine, theirs]
