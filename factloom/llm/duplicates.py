"""Bodies that repeat an earlier one: the reference's shingle check over documents.

A body is a text with its white space made single; bodies of 200 characters or
more take part.  Each is reported with the body of the least id below its own
that is equal, or whose length is at least 0.8 of the other's (either way) and
whose five-word shingles (words `\\w+` in lower case) have a Jaccard of 0.9.

Equal bodies collapse first.  MinHash groups the others by links of 0.9, confirmed
on whole sets; inside a group each body is compared on whole sets with the ones of
lesser id, least first, until one matches.

Cases: rows without text or id take no part; rows repeated with one id don't
report one another; bodies are told apart by 64 bits of hash.  A group must fit
in the memory of a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import saved
from .memory import lean, lean_group
from .minhash import near_duplicates

LEAST_CHARS, SHINGLE = 200, 5
_WORD = re.compile(r"\w+")
NONE = "-"  # stands for the words of a body without words; no word itself


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def alike(m: int, n: int, a: set, b: set) -> bool:
    """m, n: characters of the bodies; a, b: their shingles."""
    both = len(a & b)
    return 10 * min(m, n) >= 8 * max(m, n) and 10 * both >= 9 * (len(a) + len(b) - both)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, duplicate_of, identical for each row whose body repeats an earlier one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [" ".join(t.split()) for t in batch.column("text").to_pylist()]
            words = [" ".join(_WORD.findall(b.lower())) or NONE for b in bodies]
            out = pa.record_batch({"id": batch.column("id"), "body": pa.array(bodies, pa.string()), "n": pa.array([len(b) for b in bodies], pa.int64()), "words": pa.array(words, pa.string())})
            yield out.filter(pa.array([len(b) >= LEAST_CHARS for b in bodies], pa.bool_()))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    rows = saved(rows.mapInArrow(lean(read), "id long, body string, n long, words string").select("id", F.xxhash64("body").alias("body"), "n", "words"))
    bodies = saved(rows.groupBy("body").agg(F.min("id").alias("first"), F.min("n").alias("n"), F.min("words").alias("words")))
    groups = near_duplicates(bodies, id_col="body", text_col="words", percent=90, shingle=SHINGLE).select(F.col("id").alias("body"), "component_id")
    several = groups.groupBy("component_id").agg(F.count("*").alias("m")).where("m > 1").select("component_id")
    members = bodies.join(groups.join(several, "component_id"), "body")

    def earliest(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending"), ("body", "ascending")])
        first, n = table.column("first").to_pylist(), table.column("n").to_pylist()
        sets = [shingles(w.split(" ")) for w in table.column("words").to_pylist()]
        found = [next((first[j] for j in range(len(sets)) if j != i and alike(n[i], n[j], sets[i], sets[j])), None) for i in range(len(sets))]
        return pa.table({"body": table.column("body"), "near": pa.array(found, pa.int64())})

    near = members.groupBy("component_id").applyInArrow(lean_group(earliest), "body long, near long")
    out = rows.select("id", "body").join(bodies.select("body", "first"), "body").join(near, "body", "left")
    out = out.withColumn("duplicate_of", F.least("first", "near")).where("duplicate_of < id")
    return out.select("id", "duplicate_of", (F.col("first") == F.col("duplicate_of")).alias("identical"))
