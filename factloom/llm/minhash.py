"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A document's set is its distinct shingles of five words (words `[^\\x20\\x09-\\x0D]+`
of the text with A-Z in lower case; fewer words are one shingle).  Its signature
is `size` minima of 16 bits.  For pairs at the similarity wanted the number of
differing places is binomial; the distance allowed lies 4.75 deviations above
its mean, so a link is overlooked once in a million.

Below that distance, of `distance // 2 + 1` chunks one has at most one error
(pigeonhole).  Each chunk is indexed once for every place left out, which
enumerates one error: all pairs under the distance meet under some key.

Equal sets collapse into a class first.  The centre of a key is the class under it
that meets most others; a class is paired with its three weightiest centres, a
centre's leaves in blocks, and the links confirmed on whole sets give components.
Only where a key then still joins different components are its classes compared
pairwise, by signature and in tiles of about 1024 by 1024, many small ones to a
task.  Pairs within the distance leave a tile packed by the blocks of their two classes (at
most about 4096 classes and 4 MB of text, near copies together); each pair of
blocks fetches its texts once and confirms on whole sets.
So no group emits all its pairs and no link is lost.

Cases: null and empty texts have an empty set and no link; repeated rows are
copies; rows of one id are one node, which any of their texts links; rows without
id take no part in links and keep themselves; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, saved
from .memory import lean, lean_group, lean_groups
from .rolling import U64, Prefix, byte_values, column_bytes, mix, slices
from .shards import PUBLISHED, answer, merged, published
from .window_dedup import Words

SIZE, SHINGLE, TILE, LEAVES, SALTS, BLOCK_ROWS, BLOCK_BYTES, BIN_ROWS, SHARD_ROWS, CENTRES = 128, 5, 1024, 256, 8, 4096, 4 << 20, 4096, 8000, 3
SIGNED = "id long, n_shingles long, n_bytes long, same binary, sig binary"
PACKED = "p long, q long, a binary, b binary"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=4)
def _permutations(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(0, 1 << 32, size, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, size, dtype=np.uint32)


def shingle_sets(text: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    low = _LOWER[text]
    words = Words(low, offsets)
    prefix = Prefix(mix(Prefix(byte_values(1)[low]).span(words.starts, words.ends)))
    full = mix(prefix.fixed(shingle))
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= shingle:
            yield np.unique(full[a : b - shingle + 1])
        elif b > a:
            yield mix(prefix.span(np.array([a]), np.array([b])) ^ U64(b - a))
        else:
            yield full[:0]


def signature(shingles: np.ndarray, size: int) -> bytes:
    a, b = _permutations(size)
    h = (shingles >> U64(32)).astype(np.uint32)
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 1024):
        np.minimum(least, (h[i : i + 1024, None] * a + b).min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def allowed_distance(similarity: float, size: int) -> int:
    return min(size - 1, math.ceil(size * (1 - similarity) + 4.75 * math.sqrt(size * similarity * (1 - similarity))))


def index_keys(sigs: np.ndarray, distance: int) -> np.ndarray:
    """Keys of each signature, one for each place: its chunk without that place."""
    n, size = sigs.shape
    chunks = min(distance // 2 + 1, size // 2)
    if chunks <= distance // 2:
        raise ValueError("signatures too short for this distance")
    values = mix(sigs.astype(U64) + (np.arange(size, dtype=U64) << U64(20)))
    keys = np.empty((n, size), U64)
    for places in np.array_split(np.arange(size), chunks):
        keys[:, places] = values[:, places].sum(axis=1, dtype=U64)[:, None] - values[:, places] + places.astype(U64)
    return mix(keys)


def _sigs(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, size)


def sign(docs: DataFrame, id_col: str, text_col: str, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text, offsets = column_bytes(batch.column("text"))
            counts, same, sigs = [], [], []
            for s in shingle_sets(text, offsets, shingle):
                counts.append(len(s))
                same.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s, size) if len(s) else None)
            yield pa.record_batch({"id": batch.column("id"), "n_shingles": pa.array(counts, pa.int64()), "n_bytes": pa.array(np.diff(offsets)), "same": pa.array(same, pa.binary()), "sig": pa.array(sigs, pa.binary())})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), SIGNED)


def _meeting(classes: DataFrame, n: int, size: int, distance: int) -> DataFrame:
    """key, id of all keys that two classes have."""
    shards = max(8, -(-n // SHARD_ROWS))
    ranges = max(8, shards // 2)
    rows = classes.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def publish(table: pa.Table) -> pa.Table:
        return published(0, table.column("shard")[0].as_py(), np.unique(index_keys(_sigs(table.column("sig"), size), distance)), None, ranges)

    def shared(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        keys = index_keys(_sigs(table.column("sig"), size), distance)
        distinct, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        yes = ((count > 1) | answer(told, 0, len(distinct)))[which].reshape(keys.shape)
        row, _ = np.nonzero(yes)
        return pa.table({"key": keys[yes].view(np.int64), "id": table.column("id").to_numpy()[row]})

    told = merged(rows.groupBy("shard").applyInArrow(lean_group(publish), PUBLISHED))
    return rows.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(lean_groups(shared), "key long, id long")


def _linked(docs: pa.Table, a: np.ndarray, b: np.ndarray, percent: int, shingle: int) -> pa.Table:
    """The pairs whose sets have 100 * intersection >= percent * union. docs: id, text; an id may have several texts."""
    sets = [s for part in slices(docs.select(["id", "text"]).to_batches(), "text") for s in shingle_sets(*column_bytes(part.column("text")), shingle)]
    sizes = np.array([len(s) for s in sets])
    ids = docs.column("id").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    left, right = np.searchsorted(ids, a), np.searchsorted(ids, b)
    many_a, many_b = np.searchsorted(ids, a, side="right") - left, np.searchsorted(ids, b, side="right") - right
    pair = np.repeat(np.arange(len(a)), many_a * many_b)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(many_a * many_b) - many_a * many_b, many_a * many_b)
    left, right = order[left[pair] + nth // many_b[pair]], order[right[pair] + nth % many_b[pair]]
    may = 100 * np.minimum(sizes[left], sizes[right]) >= percent * np.maximum(sizes[left], sizes[right])
    pair, left, right = pair[may], left[may], right[may]
    distinct, number = np.unique(np.concatenate(sets), return_inverse=True)
    numbered = np.split(number, np.cumsum(sizes)[:-1])
    marked, yes = np.zeros(len(distinct), bool), np.zeros(len(a), bool)
    first = None
    for k in np.argsort(left, kind="stable"):
        i, j = left[k], right[k]
        if i != first:
            if first is not None:
                marked[numbered[first]] = False
            marked[numbered[i]] = True
            first = i
        both = int(np.count_nonzero(marked[numbered[j]]))
        yes[pair[k]] |= 100 * both >= percent * (sizes[i] + sizes[j] - both)
    return pa.table({"a": np.maximum(a, b)[yes], "b": np.minimum(a, b)[yes]})


def _confirmed(stars: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links among stars (id, c). A centre's leaves are split into blocks; a task takes many blocks and gets each of its texts once."""
    pairs = stars.groupBy(F.greatest("id", "c").alias("a"), F.least("id", "c").alias("b")).agg(F.min("c").alias("c"))
    pairs = pairs.select("c", F.when(F.col("c") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("leaf"))
    blocks = pairs.groupBy("c").agg(F.ceil(F.count("*") / LEAVES).alias("blocks")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    bins = max(8, -(-4 * (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("leaf"), F.col("blocks"))
    pairs = pairs.withColumn("salt", F.pmod(F.hash("leaf"), F.lit(SALTS)))
    pairs = saved(pairs.join(blocks, ["c", "salt"]).select(F.pmod(F.xxhash64("c", block), F.lit(bins)).alias("bin"), "leaf", "c"))
    need = pairs.select(F.col("bin").alias("home"), F.explode(F.array("leaf", "c")).alias("id")).distinct().join(texts, "id")

    def check(docs: pa.Table, table: pa.Table) -> pa.Table:
        return _linked(docs, table.column("c").to_numpy(), table.column("leaf").to_numpy(), percent, shingle)

    return need.groupBy("home").cogroup(pairs.groupBy("bin")).applyInArrow(lean_groups(check), "a long, b long")


def _tiles(rows: DataFrame, size: int, distance: int, percent: int) -> DataFrame:
    """Pairs of different components within the distance, packed by their blocks. rows: key, id, component, sig, n, block_id."""
    blocks = saved(rows.groupBy("key").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / TILE).cast("int")))
    dealt = rows.join(blocks.drop("m"), "key").withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").cast("int").alias("x"), F.greatest("block", "other").cast("int").alias("y"), "block", "id", "component", "sig", "n", "block_id")
    bins = max(1, -(-(blocks.agg(F.sum(F.col("m") * F.col("blocks"))).first()[0] or 0) // BIN_ROWS))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("key", "x", "y")])
        key, x, y, ids, comp, block, n, home = (table.column(c).to_numpy() for c in ("key", "x", "y", "id", "component", "block", "n", "block_id"))
        sigs = _sigs(table.column("sig"), size)
        keys = index_keys(sigs, distance).view(np.int64)
        new = np.flatnonzero((np.diff(key) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
        ends = np.append(new, len(key))
        end = np.repeat(ends, np.diff(ends, prepend=0))  # of each row's tile
        a, b, i = [], [], np.arange(len(key))
        for step in range(1, int(np.diff(ends, prepend=0).max())):
            i = i[i + step < end[i]]
            j = i + step
            yes = (comp[i] != comp[j]) & ((x[i] == y[i]) | (block[i] != block[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            left, right = i[yes], j[yes]
            near = (sigs[left] != sigs[right]).sum(axis=1) <= distance
            left, right = left[near], right[near]
            first = (keys[left] == keys[right]).argmax(axis=1)
            own = keys[left, first] == key[left]  # a pair counts under its first key
            a.append(left[own])
            b.append(right[own])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        homes, which = np.unique(np.sort(np.stack((home[a], home[b]), axis=1), axis=1), axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        cuts = np.searchsorted(which.ravel()[order], np.arange(1, len(homes)))
        ends = [pa.array([v.astype("<i8").tobytes() for v in np.split(ids[e[order]], cuts)][: len(homes)], pa.binary()) for e in (a, b)]
        return pa.table([pa.array(homes[:, 0], pa.int64()), pa.array(homes[:, 1], pa.int64()), *ends], names=["p", "q", "a", "b"])

    binned = dealt.withColumn("bin", F.pmod(F.xxhash64("key", "x", "y"), F.lit(bins)))
    return binned.groupBy("bin").applyInArrow(lean_group(compare), PACKED)


def _unpacked(packed: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(packed.column(c).to_pylist()), "<i8") for c in ("a", "b"))


def _confirmed_blocks(packed: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links among packed pairs; a pair of blocks gets each of its texts once."""

    def members(table: pa.Table) -> pa.Table:
        ids = np.unique(np.concatenate(_unpacked(table)))
        p, q = (np.full(len(ids), table.column(c)[0].as_py()) for c in ("p", "q"))
        return pa.table({"p": p, "q": q, "id": ids})

    def check(docs: pa.Table, table: pa.Table) -> pa.Table:
        return _linked(docs, *_unpacked(table), percent, shingle)

    need = packed.groupBy("p", "q").applyInArrow(lean_group(members), "p long, q long, id long").join(texts, "id")
    return need.groupBy("p", "q").cogroup(packed.groupBy("p", "q")).applyInArrow(lean_groups(check), "a long, b long")


def _homes(ids: DataFrame, centres: DataFrame, found: DataFrame, classes: DataFrame) -> DataFrame:
    """id, block_id: classes with the same component of their weightiest centre, cut by number and bytes."""
    label = found.select(F.col("id").alias("first"), "component")
    rows = ids.join(centres, "id").join(label, "first", "left").select("id", F.coalesce("component", "first").alias("label")).join(classes.select("id", "n_bytes"), "id")
    blocks = rows.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n_bytes") / BLOCK_BYTES)).alias("blocks"))
    return rows.join(blocks, "label").select("id", F.xxhash64("label", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("block_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """id, n_shingles, component_id, kept for each row of docs."""
    distance = allowed_distance(percent / 100, size)
    signed = saved(sign(docs, id_col, text_col, size, shingle))
    classes = signed.where("same is not null and id is not null").groupBy("same").agg(F.min(F.struct("id", "sig", "n_shingles", "n_bytes")).alias("m")).select("same", "m.id", "m.sig", F.col("m.n_shingles").alias("n"), "m.n_bytes")
    classes = saved(classes)
    keys = saved(_meeting(classes.select("id", "sig"), classes.count(), size, distance))
    ids = keys.select("id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")
    texts = saved(texts.groupBy("id", F.xxhash64("text").alias("h")).agg(F.max("text").alias("text")).drop("h"))

    counts = keys.groupBy("key").agg(F.count("*").alias("n"))
    weight = keys.join(counts, "key").groupBy("id").agg(F.sum("n").alias("w"))
    centre = keys.join(weight, "id").groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("i"))).alias("m")).select("key", (-F.col("m.i")).alias("c"))
    heavy = F.struct("w", (-F.col("c")).alias("i"))
    centre = centre.join(weight.withColumnRenamed("id", "c"), "c")
    others = F.collect_set(F.when(F.col("id") != F.col("c"), heavy))
    met = keys.join(centre, "key").groupBy("id").agg(F.slice(F.sort_array(others, asc=False), 1, CENTRES).alias("cs"), F.max(heavy).alias("top"))
    met = saved(met.select("id", "cs", (-F.col("top.i")).alias("first")))
    stars = met.select("id", F.explode("cs.i").alias("i")).select("id", (-F.col("i")).alias("c"))
    links = saved(_confirmed(stars, texts, percent, shingle))
    found = components(links)

    placed = keys.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_rows = saved(placed.join(mixed, "key"))
    homes = saved(_homes(open_rows.select("id").distinct(), met.select("id", "first"), found, classes))
    open_rows = open_rows.join(classes.select("id", "sig", "n"), "id").join(homes, "id")
    packed = saved(_tiles(open_rows.select("key", "id", "component", "sig", "n", "block_id"), size, distance, percent))
    more = saved(_confirmed_blocks(packed, texts, percent, shingle))
    if not more.isEmpty():
        found = components(links.unionByName(more))

    whole = classes.select("same", "id").join(found, "id", "left").select("same", F.coalesce("component", "id").alias("component"))
    out = signed.select("id", "n_shingles", "same").join(whole, "same", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """Rows, all columns, one of each group: that of the smallest id, rows without id last.

    Rows are told apart by their place, so rows with null or equal ids are rows
    of their own.  `docs` must give the same rows in the same order whenever it is
    read, as saved tables and files do.
    """
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    found = near_duplicates(numbered, row, text_col, percent, size, shingle).select(F.col("id").alias(row), "component_id")
    order = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col), F.col(row))
    first = numbered.select(row, id_col).join(found, row).groupBy("component_id").agg(F.min(order)[row].alias(row))
    return numbered.join(first.select(row), row, "left_semi").drop(row)
