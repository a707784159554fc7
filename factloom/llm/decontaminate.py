"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and figures, in lower case.  An item and a document
that share a seed, `min_tile` words in a row by Karp-Rabin hash, are tiled: the
longest common run of words not marked yet is marked in both, again and again,
down to `min_tile`.  The share of the item's words under tiles is its coverage,
wherever the passages stand in the document; from `least` on the document is
contaminated.

Items go round in blocks of at most `block_bytes` of text, the bound of what a
broadcast holds; every block meets all documents.

Cases: null and empty texts are clean; items shorter than `min_tile` words count
only as a whole; items without words are passed over; equal items are tiled once;
rows with equal ids are judged one by one; an empty benchmark leaves all clean;
other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import lean
from .rolling import Prefix, byte_values, column_bytes, mix, slices

MIN_TILE, LEAST, BLOCK_BYTES = 5, 0.5, 8 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the first word of each text."""
    solid = _WORD[text]
    first = np.zeros(len(text) + 1, bool)
    first[offsets] = True
    before, after = np.concatenate(([False], solid[:-1])), np.concatenate((solid[1:], [False]))
    starts = np.flatnonzero(solid & (~before[: len(text)] | first[:-1]))
    ends = np.flatnonzero(solid & (~after[: len(text)] | first[1:])) + 1
    return mix(Prefix(byte_values(1)[_LOWER[text]]).span(starts, ends)), np.searchsorted(starts, offsets)


def tile(item: np.ndarray, doc: np.ndarray, pairs: list[tuple[int, int]], least: int) -> np.ndarray:
    """Mask of the item's words under tiles. pairs: places (in item, in document) of equal seeds."""
    diagonal = defaultdict(list)
    for i, j in pairs:
        diagonal[j - i].append(i)
    heap = []
    for d, places in diagonal.items():
        places.sort()
        begin = last = None
        for i in [*places, None]:
            if begin is not None and (i is None or i > last + 1):
                heap.append((-(last - begin + least), begin, begin + d))
                begin = None
            if i is not None:
                begin = i if begin is None else begin
                last = i
    heapq.heapify(heap)
    mine, theirs = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    while heap:
        size, i, j = heapq.heappop(heap)
        size = -size
        taken = mine[i : i + size] | theirs[j : j + size]
        if not taken.any():
            mine[i : i + size] = theirs[j : j + size] = True
            continue
        edge = np.diff(np.concatenate(([1], taken.view(np.int8), [1])))
        for a, b in zip(np.flatnonzero(edge == -1).tolist(), np.flatnonzero(edge == 1).tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return mine


class Items:
    """A block of the benchmark: word hashes, and seeds sorted for binary search."""

    def __init__(self, ids: list[int], texts: list[str], min_tile: int):
        raw = [(t or "").encode() for t in texts]
        words, first = words_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
        self.ids, self.words, self.sizes, seen = [], [], [], set()
        for k, name in enumerate(ids):
            own = words[first[k] : first[k + 1]]
            if len(own) and own.tobytes() not in seen:
                seen.add(own.tobytes())
                self.ids.append(name)
                self.words.append(own)
                self.sizes.append(min(min_tile, len(own)))
        self.seeds = {}
        for size in set(self.sizes):
            key, item, at = [], [], []
            for k, own in enumerate(self.words):
                if self.sizes[k] == size:
                    h = Prefix(own).fixed(size)
                    key.append(h)
                    item.append(np.full(len(h), k))
                    at.append(np.arange(len(h)))
            key, item, at = np.concatenate(key), np.concatenate(item), np.concatenate(at)
            by = np.argsort(key, kind="stable")
            self.seeds[size] = key[by], item[by], at[by]

    def coverage(self, text: np.ndarray, offsets: np.ndarray, least: float) -> list[list[tuple[int, float]]]:
        """For each text the items covered to this share and their coverage."""
        words, first = words_of(text, offsets)
        out: list[list[tuple[int, float]]] = [[] for _ in range(len(offsets) - 1)]
        prefix = Prefix(words)
        pairs = defaultdict(list)
        for size, (key, item, at) in self.seeds.items():
            h = prefix.fixed(size)
            left = np.searchsorted(key, h)
            hits = np.flatnonzero((left < len(key)) & (key[np.minimum(left, len(key) - 1)] == h))
            doc = np.searchsorted(first, hits, side="right") - 1
            good = hits + size <= first[doc + 1]
            for j, d in zip(hits[good].tolist(), doc[good].tolist(), strict=True):
                i = int(left[j])
                while i < len(key) and key[i] == h[j]:
                    pairs[d, int(item[i])].append((int(at[i]), j - int(first[d])))
                    i += 1
        for (d, k), found in pairs.items():
            own, size = self.words[k], self.sizes[k]
            reach = len({i + x for i, _ in found for x in range(size)}) / len(own)
            if reach >= least:  # tiles lie within the seeds
                share = float(tile(own, words[first[d] : first[d + 1]], found, size).mean())
                if share >= least:
                    out[d].append((self.ids[k], share))
        return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, min_tile: int, block_bytes: int) -> Iterator[Items]:
    ids, texts, have = [], [], 0
    for row in benchmark.select(item_col, text_col).orderBy(item_col, text_col).toLocalIterator():
        size = len((row[1] or "").encode())
        if texts and have + size > block_bytes:
            yield Items(ids, texts, min_tile)
            ids, texts, have = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        have += size
    if texts:
        yield Items(ids, texts, min_tile)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_tile: int = MIN_TILE, least: float = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, contaminated boolean, coverage double (of the most covered item, 0 if below `least`), item_ids array<long>, for each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("array<struct<c:double,i:long>>").alias("found"))
    for items in blocks(benchmark, item_col, item_text, min_tile, block_bytes):
        rows = _judged(rows, items, least)
    found = F.coalesce("found", F.array().cast("array<struct<c:double,i:long>>"))
    return rows.select("id", (F.size(found) > 0).alias("contaminated"), F.coalesce(F.array_max(found)["c"], F.lit(0.0)).alias("coverage"), F.array_sort(F.transform(found, lambda x: x["i"])).alias("item_ids"))


def _judged(rows: DataFrame, items: Items, least: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(items)
    kind = pa.list_(pa.struct([("c", pa.float64()), ("i", pa.int64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = shared.value.coverage(*column_bytes(batch.column("text")), least)
            had = batch.column("found").to_pylist()
            found = [(h or []) + [{"c": c, "i": i} for i, c in g] for h, g in zip(had, got, strict=True)]
            yield pa.record_batch({"id": batch.column("id"), "text": batch.column("text"), "found": pa.array(found, kind)})

    return rows.mapInArrow(lean(judge), rows.schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_tile: int = MIN_TILE, least: float = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows, all columns, that are not contaminated."""

    def without(docs: DataFrame, items: Items) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col):
                found = shared.value.coverage(*column_bytes(batch.column(text_col)), least)
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

        return docs.mapInArrow(lean(keep), docs.schema)

    for items in blocks(benchmark, item_col, item_text, min_tile, block_bytes):
        docs = without(docs, items)
    return docs
