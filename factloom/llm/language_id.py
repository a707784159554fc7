"""Language identification by words first, character n-grams second.

A known word scores by its log frequency in each language.  An unseen word falls
back to the n-grams of the padded word, the longest order first, down to single
characters: the first order of which at least half the grams are known scores it.

The model is fitted on a bounded sample: at most `sample_rows` training rows of
at most `sample_bytes` bytes each, shared out equally among the languages, those
of the least hashes in each, so driver memory and the size of the model do not
grow with the input.  Only where a language has no other text are longer ones cut.

Cases: null text, and text without a letter, is `und` with score 0; texts count
whole, however long; a table without training rows makes every row `und`; rows
with equal ids are scored one by one; other columns are not looked at.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import lean
from .rolling import slices

WORD = regex.compile(r"\p{L}+")
SAMPLE_ROWS, SAMPLE_BYTES, ORDERS = 4000, 20_000, (5, 4, 3, 2, 1)
UNKNOWN = "und"


class Logs:
    """Texts and their log frequency in each language, as one matrix."""

    def __init__(self, place: dict[str, int], counts: np.ndarray, least: int):
        if least > 1:
            keep = counts.sum(axis=1) >= least
            place = {t: i for i, t in enumerate(t for t, i in place.items() if keep[i])}
            counts = counts[keep]
        self.place, self.logs = place, counts.astype(np.float32) + np.float32(0.5)
        if place:
            self.logs = np.log(self.logs / self.logs.sum(axis=0))
            self.logs -= self.logs.mean(axis=1, keepdims=True)


class Model:
    """langs; words and grams of each order: their log frequencies."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.langs = sorted({lang for _, lang in rows})
        lang_place = {lang: i for i, lang in enumerate(self.langs)}
        seen: dict[str, int] = {}
        word, lang, often = array("q"), array("q"), array("q")
        for text, name in rows:
            for w, n in Counter(WORD.findall(text.lower())).items():
                word.append(seen.setdefault(w, len(seen)))
                lang.append(lang_place[name])
                often.append(n)
        counts = np.zeros((len(seen), len(self.langs)), np.int64)
        np.add.at(counts, (np.asarray(word), np.asarray(lang)), np.asarray(often))
        self.grams = {}
        for order in ORDERS:
            place: dict[str, int] = {}
            gram, of = array("q"), array("q")
            for w, i in seen.items():
                padded = f" {w} "
                for at in range(len(padded) - order + 1):
                    gram.append(place.setdefault(padded[at : at + order], len(place)))
                    of.append(i)
            total = np.zeros((len(place), len(self.langs)), np.int64)
            np.add.at(total, np.asarray(gram), counts[np.asarray(of)])
            self.grams[order] = Logs(place, total, 1 if order == 1 else 2)
        self.words = Logs(seen, counts, 2)

    def word(self, word: str) -> np.ndarray:
        known = self.words.place.get(word)
        if known is not None:
            return self.words.logs[known]
        padded = f" {word} "
        for order in ORDERS:
            of = self.grams[order]
            n = len(padded) - order + 1
            found = [i for at in range(n) if (i := of.place.get(padded[at : at + order])) is not None]
            if found and 2 * len(found) >= n:
                return of.logs[found].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


class Scorer:
    """Scores of words are kept for later texts, up to `most` of them."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, max(1, len(model.langs))), np.float32)

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        counts = Counter(words)
        if len(self.place) + len(counts) > self.most:
            self.place, self.rows = {}, self.rows[:1024].copy()
        place = self.place
        at = []
        for word in counts:
            i = place.get(word)
            if i is None:
                i = place[word] = len(place)
                if i >= len(self.rows):
                    self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
                self.rows[i] = self.model.word(word)
            at.append(i)
        n = np.fromiter(counts.values(), np.float32, len(at))
        total = n @ self.rows[at]
        odds = np.exp((total - total.max()) * min(1.0, 20 / len(words)))
        best = int(total.argmax())
        return self.model.langs[best], float(odds[best] / odds.sum())


def quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """Rows of each language in a sample of `rows`: equal shares, what small languages leave goes to the others; one at least."""
    out, left = {}, max(rows, len(counts))
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, left // (len(counts) - i))
        left -= out[lang]
    return out


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Languages are few: their names and counts come to the driver."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    long = F.octet_length(text_col) > sample_bytes
    rows = rows.select(F.xxhash64(id_col, text_col).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), long.alias("long"))
    counts = {(r["lang"], r["long"]): r["n"] for r in rows.groupBy("lang", "long").agg(F.count("*").alias("n")).collect()}
    langs = {lang for lang, _ in counts}
    total = {lang: counts.get((lang, False), 0) or counts.get((lang, True), 0) for lang in langs}
    some: list[tuple[str, str]] = []
    quota = quotas(total, sample_rows)
    for is_long in (False, True):  # long texts, cut, stand in for a language without any other
        wanted = {lang: quota[lang] for lang in langs if (counts.get((lang, False), 0) > 0) != is_long}
        if wanted:
            # the least hashes of each language: a few more than wanted leave their tasks, the driver keeps the first
            border = {lang: min(2**63 - 1, int((1.5 * n + 40) / total[lang] * 2**64) - 2**63) for lang, n in wanted.items()}
            least = F.create_map(*(F.lit(x) for lang, h in border.items() for x in (lang, h)))
            near = rows.where((F.col("long") == is_long) & (F.col("h") <= least[F.col("lang")]))
            taken: Counter = Counter()
            for r in near.select("h", "lang", F.substring("text", 1, sample_bytes).alias("text")).orderBy("h", "lang", "text").limit(2 * sum(wanted.values()) + 80 * len(wanted)).collect():
                if taken[r["lang"]] < wanted[r["lang"]]:
                    taken[r["lang"]] += 1
                    some.append((r["text"], r["lang"]))
    return Model(some)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id long, lang_pred string, score double."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, "text"):
            found = [scorer(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"id": batch.column("id"), "lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(score), "id long, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """Rows, all columns, whose language is known with at least this score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, text_col):
            found = [scorer(t) for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and s >= least for lang, s in found], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)
