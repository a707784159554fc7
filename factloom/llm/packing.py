"""Packing documents into sequences of at most `size` tokens, in order.

The tokens of a partition's documents, in the order read, form one stream;
dynamic programming cuts it into windows.  A window costs its padding, and a cut
costs nothing at the end of a document, `sentence_cost` after a sentence and
`middle_cost` elsewhere.  With f(i) the least cost up to boundary i,
f(i) = cost(i) + size - i + min(f(j) + j) over the boundaries j of the last
`size` tokens: a monotone queue holds that minimum.  Places without a boundary
for `gap` tokens get cuts inside the sentence.

Cases: null text is empty text, which is its closing token alone; long documents
go through many windows; rows with equal ids are packed one by one; an empty
table gives an empty result; other columns are not looked at.  Sequence ids join
the partition and the window, so no counting across partitions is needed.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import lean
from .rolling import slices
from .tokens import encode, ranks_path

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SIZE = 1024


def cuts(boundaries: np.ndarray, costs: np.ndarray, size: int) -> list[int]:
    """Ends of the windows. boundaries: ascending, the last is the end of the stream, no two more than `size` apart."""
    where, price = [0, *boundaries.tolist()], [0.0, *costs.tolist()]
    best = [0.0] * len(where)
    came = [0] * len(where)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for i in range(1, len(where)):
        at = where[i]
        while where[queue[0][1]] < at - size:
            queue.popleft()
        value, j = queue[0]
        best[i] = value + size - at + price[i]
        came[i] = j
        mine = best[i] + at
        while queue and queue[-1][0] >= mine:
            queue.pop()
        queue.append((mine, i))
    out, i = [], len(where) - 1
    while i:
        out.append(where[i])
        i = came[i]
    return out[::-1]


def boundaries(ids: np.ndarray, offsets: np.ndarray, stops: np.ndarray, gap: int, sentence: float, middle: float) -> tuple[np.ndarray, np.ndarray]:
    """Places to cut and what a cut costs there."""
    flag = np.isin(ids, stops)
    ends = offsets[1:]
    inside = np.flatnonzero(flag) + 1
    place = np.unique(np.concatenate((inside, ends)))
    step = np.diff(place, prepend=0)
    wide = np.flatnonzero(step > gap)
    extra = [np.arange(place[i] - step[i] + gap, place[i], gap) for i in wide]
    every = np.unique(np.concatenate([place, *extra])) if extra else place
    cost = np.full(len(every), middle)
    cost[np.isin(every, inside)] = sentence
    cost[np.searchsorted(every, np.unique(ends))] = 0
    return every, cost


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, close: int = 0, gap: int = 32, sentence_cost: float = 0.25, middle_cost: float = 1.0, ranks: str | None = None, batch_chars: int = 1 << 20) -> DataFrame:
    """One row a piece: PIECES. ranks: the vocabulary file as tiktoken ranks."""
    ranks = ranks or ranks_path()
    gap = max(1, min(gap, size))

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 36, 0
        stops = np.array(sorted({i for s in (".", "!", "?", ".\n", "\n", "\n\n") for i in encode([s], ranks)[0].tolist()}), np.uint32)

        def flush(names, texts):
            nonlocal number
            ids, offsets = encode(texts, ranks, close)
            ends = np.array(cuts(*boundaries(ids, offsets, stops, gap, sentence_cost, middle_cost), size), np.int64)
            cut = np.unique(np.concatenate((ends, offsets[1:])))
            start = np.concatenate(([0], cut[:-1]))
            doc = np.searchsorted(offsets, start, side="right") - 1
            window = np.searchsorted(ends, start, side="right")
            opened = np.concatenate(([0], ends))[window]
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), cut.tolist(), strict=True)]
            out = pa.record_batch(
                {
                    "id": pa.concat_arrays(names).take(pa.array(doc)) if len(names) > 1 else names[0].take(pa.array(doc)),
                    "start": start - offsets[doc],
                    "length": cut - start,
                    "ids_crc32": np.array(crc, np.int64),
                    "doc_tokens": (offsets[1:] - offsets[:-1])[doc],
                    "sequence_id": base + number + window,
                    "offset": start - opened,
                }
            )
            number += len(ends)
            return out

        names: list = []
        texts: list[str] = []
        have = 0
        for batch in slices(batches, "text"):
            names.append(batch.column("id"))
            own = [t or "" for t in batch.column("text").to_pylist()]
            texts += own
            have += sum(map(len, own))
            if have >= batch_chars:
                yield flush(names, texts)
                names, texts, have = [], [], 0
        if texts:
            yield flush(names, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(streams), PIECES)
