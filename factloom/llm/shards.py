"""Asking all shards which of a shard's keys occur elsewhere.

Documents are dealt to shards of a fixed size by a hash of their id.  A shard
publishes its distinct keys, sorted and cut into key ranges; the task of a range
merges the sorted runs of all shards and answers each run with one bit a key.
A key comes from a shard once at most, however often it occurs there, so a
frequent passage costs one key a shard and no range or shard is hot.  The
exchange of the texts is the same subplan in every pass, which Spark runs once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .memory import lean_group, lean_groups

U64 = np.uint64
SHARD_BYTES, RANGE_BYTES = 2 << 20, 8 << 20
PUBLISHED = "kind int, rng int, shard int, keys binary, more binary"
ANSWER = "kind int, rng int, shard int, n int, mask binary, first binary"
HANDED = -1  # kind of what a shard hands on to its own next step


class Sharded:
    """Rows (id, text) with their shard, the number of shards and of key ranges."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, shard_bytes: int = SHARD_BYTES, carry: bool = False):
        """carry: rest holds text_null and c, the other columns of the row."""
        kept = F.struct(F.isnull(text_col).alias("text_null"), F.struct(*(c for c in docs.columns if c != text_col)).alias("c"))
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *([kept.alias("rest")] if carry else []))
        self.bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.n = max(8, -(-self.bytes // shard_bytes))
        self.ranges = max(8, -(-self.bytes // RANGE_BYTES))
        self.rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(self.n)).cast("int"))

    def publish(self, emit: Callable) -> DataFrame:
        """emit(table) -> table of PUBLISHED, once a shard."""
        return self.rows.groupBy("shard").applyInArrow(lean_group(emit), PUBLISHED)

    def with_answers(self, answers: DataFrame, emit: Callable, schema: str | StructType) -> DataFrame:
        """emit(table, answers of its shard) -> table, once a shard."""
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        nothing = to_arrow_schema(schema)

        def own(docs: pa.Table, told: pa.Table) -> pa.Table:
            return emit(docs, told) if docs.num_rows else nothing.empty_table()

        return self.rows.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(lean_groups(own), schema)


def pack_sorted(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending integers as 16-bit steps; larger steps go to the second part."""
    steps = np.diff(keys, prepend=U64(0))
    big = steps >= 0xFFFF
    return np.where(big, U64(0xFFFF), steps).astype("<u2").tobytes(), steps[big].astype("<u8").tobytes()


def unpack_sorted(steps: bytes, big: bytes) -> np.ndarray:
    out = np.frombuffer(steps, "<u2").astype(U64)
    out[out == 0xFFFF] = np.frombuffer(big, "<u8")
    return np.cumsum(out, dtype=U64)


def pair_order(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Order by key, then more.  Equal keys mostly agree in more, so that a sort of the keys alone will do."""
    by = np.argsort(key)
    k, m = key[by], more[by]
    return np.lexsort((more, key)) if ((k[1:] == k[:-1]) & (m[1:] < m[:-1])).any() else by


def published(kind: int, shard: int, keys: np.ndarray, more: np.ndarray | None, ranges: int, bits: int = 64) -> pa.Table:
    """Sorted distinct keys below 2**bits, cut by binary search at the borders of the ranges."""
    borders = np.array([-(-(i << bits) // ranges) for i in range(1, ranges)], U64)
    cuts = np.concatenate(([0], np.searchsorted(keys, borders), [len(keys)]))
    rng = np.flatnonzero(np.diff(cuts))
    parts = [(keys[cuts[r] : cuts[r + 1]], more[cuts[r] : cuts[r + 1]] if more is not None else None) for r in rng]
    packed = [pack_sorted(k) if bits < 64 else (k.astype("<u8").tobytes(), m.astype("<u4").tobytes() if m is not None else b"") for k, m in parts]
    n = len(rng)
    return pa.table(
        [pa.array([kind] * n, pa.int32()), pa.array(rng.astype(np.int32)), pa.array([shard] * n, pa.int32()), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())],
        names=["kind", "rng", "shard", "keys", "more"],
    )


def handed(shard: int, data: bytes, ranges: int) -> pa.Table:
    """A row of PUBLISHED that no other shard sees."""
    return pa.table(
        [pa.array([HANDED], pa.int32()), pa.array([shard % ranges], pa.int32()), pa.array([shard], pa.int32()), pa.array([data], pa.binary()), pa.array([b""], pa.binary())],
        names=["kind", "rng", "shard", "keys", "more"],
    )


def _merge(packed: bool) -> Callable[[pa.Table], pa.Table]:
    def merge(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == HANDED:
            n = table.num_rows
            return pa.table(
                [table.column("kind").cast(pa.int32()), table.column("rng"), table.column("shard"), pa.array([0] * n, pa.int32()), table.column("keys"), pa.array([b""] * n, pa.binary())],
                names=["kind", "rng", "shard", "n", "mask", "first"],
            )
        first, second = table.column("keys").to_pylist(), table.column("more").to_pylist()
        if packed:
            keys, extra = [unpack_sorted(a, b) for a, b in zip(first, second, strict=True)], None
        else:
            keys = [np.frombuffer(a, "<u8") for a in first]
            extra = [np.frombuffer(b, "<u4") for b in second]
            if not any(len(x) for x in extra):
                extra = None
        every = np.concatenate(keys) if keys else np.zeros(0, U64)
        if extra is None:
            every = np.sort(every)
            again, also = np.unique(every[1:][every[1:] == every[:-1]]), None
        else:
            beside = np.concatenate(extra)
            order = pair_order(every, beside)
            every, beside = every[order], beside[order]
            same = (every[1:] == every[:-1]) & (beside[1:] == beside[:-1])
            again, also = every[1:][same], beside[1:][same]
            new = np.concatenate(([True], (again[1:] != again[:-1]) | (also[1:] != also[:-1]))) if len(again) else np.zeros(0, bool)
            again, also = again[new], also[new]
        masks, firsts = [b""] * len(keys), [b""] * len(keys)
        taken = np.zeros(len(again), bool)
        shards = table.column("shard").to_pylist()
        for i in sorted(range(len(keys)), key=shards.__getitem__):
            k = keys[i]
            at = np.searchsorted(again, k)
            found, first_here = np.zeros(len(k), bool), np.zeros(len(k), bool)
            left = np.arange(len(k))
            while len(left):  # several entries only where keys agree in 64 bits
                left = left[at[left] < len(again)]
                left = left[again[at[left]] == k[left]]
                hit = also[at[left]] == extra[i][left] if also is not None else np.ones(len(left), bool)
                found[left[hit]] = True
                left = left[~hit]
                at[left] += 1
            spots = at[found]
            first_here[found] = ~taken[spots]
            taken[spots] = True
            masks[i], firsts[i] = np.packbits(found).tobytes(), np.packbits(first_here).tobytes()
        return pa.table(
            [table.column("kind").cast(pa.int32()), table.column("rng"), table.column("shard"), pa.array([len(k) for k in keys], pa.int32()), pa.array(masks, pa.binary()), pa.array(firsts, pa.binary())],
            names=["kind", "rng", "shard", "n", "mask", "first"],
        )

    return merge


def merged(found: DataFrame, packed: bool = False) -> DataFrame:
    """Answers: for each published run, which keys another shard has published too, and which of these no smaller shard has."""
    return found.groupBy("kind", "rng").applyInArrow(lean_group(_merge(packed)), ANSWER)


def answer(told: pa.Table, kind: int, n: int, bits: str = "mask") -> np.ndarray:
    """The bits for a shard's sorted keys."""
    rows = sorted((r["rng"], r["n"], r[bits]) for r in told.to_pylist() if r["kind"] == kind)
    bits = [np.unpackbits(np.frombuffer(m, np.uint8), count=k).astype(bool) for _, k, m in rows]
    out = np.concatenate(bits) if bits else np.zeros(0, bool)
    if len(out) != n:
        raise ValueError(f"{len(out)} answers for {n} keys")
    return out


def handed_on(told: pa.Table) -> bytes:
    """What the shard has handed on."""
    return next(r["mask"] for r in told.to_pylist() if r["kind"] == HANDED)
