"""Substring dedup on words: cut every word that lies in a repeated window.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged; a window is `window` consecutive
words of one document and is repeated if its words also start anywhere else.
First pass: each shard sketches its windows in a count-min sketch (`depth` rows,
as wide as 16 cells a word of input), published sparse and by cell range; ranges
add the shards' sketches up and answer which cells hold more than one window.
The estimate never lies below the true count, so a window with a single-count
cell is unique.  Second pass: windows estimated repeated are grouped exactly, on
96 bits of their words, over all shards.

Cases: null text has no words; shorter texts come back whole; rows with equal
ids are documents of their own; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .rolling import U64, Prefix, byte_values, column_bytes, covered, mix
from .shards import PUBLISHED, Sharded, answer, merged, published

RESULT = "id long, n_words long, n_removed long, kept binary"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words of a batch of texts: byte starts and ends, document, first word of each document."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray):
        solid = ~_SPACE[text]
        first = np.zeros(len(text) + 1, bool)
        first[offsets] = True
        before = np.concatenate(([False], solid[:-1])) if len(text) else solid
        self.starts = np.flatnonzero(solid & (~before | first[:-1]))
        after = np.concatenate((solid[1:], [False])) if len(text) else solid
        self.ends = np.flatnonzero(solid & (~after | first[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def windows(self, size: int) -> np.ndarray:
        """Mask over starts of the windows that lie in one document."""
        n = len(self.starts)
        edge = np.zeros(n + 1, np.int32)
        long = np.diff(self.first) >= size
        np.add.at(edge, self.first[:-1][long], 1)
        np.add.at(edge, self.first[1:][long] - size + 1, -1)
        return (np.cumsum(edge)[: max(0, n - size + 1)]) > 0


class _Shard:
    def __init__(self, docs: pa.Table, size: int):
        self.text, self.offsets = column_bytes(docs.column("text"))
        self.words = Words(self.text, self.offsets)
        self.starts = np.flatnonzero(self.words.windows(size))
        self.size = size
        self.keys = mix(self._hash(1)[self.starts])

    def _hash(self, seed: int) -> np.ndarray:
        w = self.words
        return Prefix(mix(Prefix(byte_values(seed)[self.text]).span(w.starts, w.ends))).fixed(self.size)

    def sketch(self, depth: int, log_width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each window in each row; the distinct cells; those that the shard itself fills twice."""
        cells = []
        for row in range(depth):
            h = mix(self.keys ^ U64(0xA24BAED4963EE407 * (row + 1) % (1 << 64)))
            cells.append((h >> U64(64 - log_width)) | U64(row << log_width))
        cells = np.array(cells, U64).reshape(depth, len(self.keys))
        distinct, count = np.unique(cells, return_counts=True)
        return cells, distinct, count > 1

    def repeated(self, cells: np.ndarray, distinct: np.ndarray, full: np.ndarray) -> np.ndarray:
        """Windows all of whose cells hold more than one."""
        yes = np.ones(len(self.keys), bool)
        for row in cells:
            yes &= full[np.searchsorted(distinct, row)]
        return np.flatnonzero(yes)

    def exact(self, at: np.ndarray):
        """Distinct windows at these places, sorted, and the group of each place."""
        key, more = self.keys[at], (mix(self._hash(2)[self.starts[at]]) >> U64(32)).astype(np.uint32)
        by = np.lexsort((more, key))
        k, m = key[by], more[by]
        fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (m[1:] != m[:-1]))) if len(k) else np.zeros(0, bool)
        group = np.empty(len(at), np.int64)
        group[by] = np.cumsum(fresh) - 1
        return k[fresh], m[fresh], group


def window_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, depth: int = 2) -> DataFrame:
    """One row a document: RESULT; kept is the kept words joined by one space, in UTF-8."""
    sharded = Sharded(docs, id_col, text_col)
    ranges = sharded.ranges
    log_width = max(16, int(16 * sharded.bytes / 6).bit_length())
    bits = log_width + (depth - 1).bit_length()

    def sketches(docs: pa.Table) -> pa.Table:
        _, distinct, _ = _Shard(docs, window).sketch(depth, log_width)
        return published(0, docs.column("shard")[0].as_py(), distinct, None, ranges, bits)

    def estimated(shard: _Shard, told: pa.Table):
        cells, distinct, twice = shard.sketch(depth, log_width)
        at = shard.repeated(cells, distinct, twice | answer(told, 0, len(distinct)))
        return at, *shard.exact(at)

    def windows(docs: pa.Table, told: pa.Table) -> pa.Table:
        _, key, more, _ = estimated(_Shard(docs, window), told)
        return published(1, docs.column("shard")[0].as_py(), key, more, ranges)

    def cut(docs: pa.Table, told: pa.Table) -> pa.Table:
        shard = _Shard(docs, window)
        at, key, _, group = estimated(shard, told)
        again = (np.bincount(group, minlength=len(key)) > 1) | answer(told, 1, len(key))
        return _result(docs, shard, covered(shard.starts[at[again[group]]], window, len(shard.words.starts)))

    first = merged(sharded.publish(sketches), packed=True)
    second = merged(sharded.with_answers(first, windows, PUBLISHED))
    return sharded.with_answers(first.unionByName(second), cut, RESULT)


def _result(docs: pa.Table, shard: _Shard, gone: np.ndarray) -> pa.Table:
    w, text, offsets = shard.words, shard.text.copy(), shard.offsets
    n = len(offsets) - 1
    kept = np.flatnonzero(~gone)
    edge = np.zeros(len(text) + 1, np.int32)
    edge[w.starts[kept]] += 1
    edge[w.ends[kept]] -= 1
    keep = np.cumsum(edge[:-1]) > 0
    # one space stands where the white space after a kept word begins, if a kept word of the document follows
    follows = np.concatenate((kept[1:], [-1])) if len(kept) else kept
    owner = np.searchsorted(w.first, kept, side="right") - 1
    joined = np.concatenate((owner[1:] == owner[:-1], [False])) if len(kept) else np.zeros(0, bool)
    gap = w.ends[kept[joined & (follows >= 0)]]
    text[gap] = 32
    keep[gap] = True
    before = np.concatenate(([0], np.cumsum(keep)))
    lost = np.concatenate(([0], np.cumsum(gone)))
    return pa.table(
        {
            "id": docs.column("id").cast(pa.int64()),
            "n_words": np.diff(w.first).astype(np.int64),
            "n_removed": np.diff(lost[w.first]).astype(np.int64),
            "kept": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(before[offsets].astype(np.int32).tobytes()), pa.py_buffer(text[keep].tobytes())]),
        }
    )
