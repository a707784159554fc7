"""Toxicity by a noisy channel: restore disguised words, then score the words.

A token that looks disguised (figures or signs between letters, a letter three
times in a row, letters set apart by blanks) becomes a lattice: each sign may
stand for letters, for nothing, or, if it hides one, for any letter; a letter
that repeats may count once or twice.  Viterbi decoding under a trigram model of
characters, the mean of the corpus's and of the learnt lexicon's, picks the
restored word.  In a run of letters set apart every gap may also end a word, and
each word found counts.  Words and their beginnings score by smoothed log-odds
learnt from training labels; a text is as toxic as its worst words.

The character counts come from all training-fold texts; the lexicon is fitted on
at most `sample_rows` labelled training rows of at most `sample_bytes` bytes, one
of each group of equal texts with the same label.  Only counts of word shapes and
the lexicon's shapes in each toxic row come to the driver.

Cases: null and empty texts have score 0; texts count whole; without labels all
scores are 0; tokens and runs of letters set apart are decoded at any length;
rows with equal ids are scored one by one; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import saved
from .memory import lean
from .rolling import column_bytes, slices

SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 50_000
# fixed values: what a sign of the usual substitutions can stand for; "?" is any letter
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "?", "#": "?", "%": "?", "&": "?", "^": "?",
    ".": "", "-": "", "_": "", "'": "", "~": "", "/": "", ",": "",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
_EDGE = re.compile(r"^[^\w@$*!|+(#%&^]+|[^\w@$*!+#%&^]+$")
_TRAIL = re.compile(r"[^\w]+$")
_APART = re.compile(r"(?<!\S)(?:[^\W\d_]|[@$*!|+\d])(?:[ .\-_*]{1,2}(?:[^\W\d_]|[@$!|+\d])){2,}(?!\S)")
_STEP = re.compile(r"([ .\-_*]{1,2})([^ .\-_*])")
_TAIL = re.compile(r"[^\w]{2,}$")
_PUNCTUATION = ".,;:?\"'()[]{}<>\u00ab\u00bb\u201c\u201d\u2026-_/\\"
_SIGNS = "".join(c for c in SIGNS if not c.isalnum())
_TRIPLE = re.compile(r"(.)\1\1")


def shapes(word: str) -> list[str]:
    """The word and the beginnings that stand for a family of words."""
    return [word, *(f"{word[:n]}+" for n in (4, 5, 6, 7) if len(word) >= n)]


def words_of(text: str) -> set[str]:
    return {bare for t in text.lower().split() if (bare := _TRAIL.sub("", _EDGE.sub("", t)))}


class Channel:
    """Trigram character model and Viterbi decoding. counts: 27**3 of the corpus (0: not a letter)."""

    def __init__(self, counts: np.ndarray, lexicon: Counter):
        own = np.zeros((27, 27, 27))
        for word, n in lexicon.items():
            codes = [0, 0, *(LETTERS.find(c) + 1 for c in word), 0]
            for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
                own[a, b, c] += n
        logs = []
        for table in (counts.reshape(27, 27, 27).astype(float), own):
            table = table + 0.01
            logs.append(table / table.sum(axis=2, keepdims=True))
        self.log = np.log((logs[0] + 3 * logs[1]) / 4).tolist()

    def options(self, token: str) -> list[list[tuple[str, float]]]:
        out, i = [], 0
        while i < len(token):
            c, n = token[i], 1
            while i + n < len(token) and token[i + n] == c:
                n += 1
            if c in SIGNS:
                one = SIGNS[c]
                may = [(x, -0.5) for x in (one if one != "?" else LETTERS)] + [("", -1.5 if one == "" else -3.0)]
                if one == "?":
                    may = [(x, p - 2.0) if x else (x, p) for x, p in may]
                out += [may] * min(n, 2)
            elif n > 1 and c.isalpha():
                out.append([(c, -0.7 if n == 2 else -0.2), (c + c, -0.2 if n == 2 else -0.7)])
            else:
                out.append([(c, 0.0)])
            i += n
        return out

    def decode(self, token: str) -> str:
        log, best = self.log, {(0, 0): (0.0, None)}
        for may in self.options(token):
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, trail) in best.items():
                for letters, price in may:
                    p, x, y = score + price, a, b
                    for c in letters:
                        z = LETTERS.find(c) + 1
                        p += log[x][y][z]
                        x, y = y, z
                    have = following.get((x, y))
                    if have is None or p > have[0]:
                        following[x, y] = (p, (trail, letters) if letters else trail)
            best = following
        trail = max(((score + log[a][b][0], trail) for (a, b), (score, trail) in best.items()), key=lambda x: x[0])[1]
        found = []
        while trail:
            trail, letters = trail
            found.append(letters)
        return "".join(reversed(found))

    def words(self, run: str) -> list[str]:
        """Words of a run of letters set apart, those with two real letters at least; a wide gap ends a word more easily."""
        steps = [("", run[0]), *_STEP.findall(run[1:])]
        narrow = min(len(gap) for gap, _ in steps[1:])
        log, best = self.log, {(0, 0): (0.0, None)}
        for i, (gap, c) in enumerate(steps):
            if i:
                price = 0.5 if len(gap) == narrow else 2.0
                score, trail = max(((score + log[a][b][0], trail) for (a, b), (score, trail) in best.items()), key=lambda x: x[0])
                if (0, 0) not in best or score + price > best[0, 0][0]:
                    best[0, 0] = (score + price, (trail, " ", False))
            if c in SIGNS:
                may = self.options(c)[0]
            else:
                may = [(c, -0.2), ("", -0.5)] if i and c == steps[i - 1][1] and len(gap) == narrow else [(c, 0.0)]
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, trail) in best.items():
                for letter, price in may:
                    p, at = score + price, (a, b)
                    if letter:
                        z = LETTERS.find(letter) + 1
                        p, at = p + log[a][b][z], (b, z)
                    have = following.get(at)
                    if have is None or p > have[0]:
                        following[at] = (p, (trail, letter, letter == c) if letter else trail)
            best = following
        trail = max(((score + log[a][b][0], trail) for (a, b), (score, trail) in best.items()), key=lambda x: x[0])[1]
        found: list[list[tuple[str, bool]]] = [[]]
        while trail:
            trail, letter, real = trail
            if letter == " ":
                found.append([])
            else:
                found[-1].append((letter, real))
        return ["".join(x[0] for x in reversed(word)) for word in found if sum(x[1] for x in word) >= 2]


def disguised(token: str) -> bool:
    letters = sum(c.isalpha() for c in token)
    return 2 <= letters and (letters < len(token) or _TRIPLE.search(token) is not None)


def log_odds(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, least: float = 10.0) -> dict[str, float]:
    """Log-odds of word shapes that toxic rows hold more often than chance (likelihood ratio of at least `least`) explains."""
    out = {}
    prior = math.log((n_toxic + 1) / (n_clean + 1))
    share = (n_toxic + 1) / (n_toxic + n_clean + 2)
    for shape, n in toxic.items():
        c = clean[shape]
        ratio = n * math.log(n / ((n + c) * share)) + (c * math.log(c / ((n + c) * (1 - share))) if c else 0.0)
        if n > share * (n + c) and ratio >= least:
            odds = math.log((n + 0.1) / (n_toxic + 1)) - math.log((clean[shape] + 0.1) / (n_clean + 1)) + prior
            if odds > 3.0:
                out[shape] = odds
    return out


class Lexicon:
    """Word shapes and their log-odds. held: those of them that each toxic training row holds."""

    def __init__(self, odds: dict[str, float], toxic: Counter, held: list[list[str]]):
        self.odds = odds
        self.cover([set(x) for x in held], 2)
        self.words = Counter({s: n for s, n in toxic.items() if s in self.odds and not s.endswith("+")})
        self.begins = {s.rstrip("+")[:4] for s in self.odds}

    def cover(self, held: list[set[str]], least: int) -> None:
        """Keep what tells toxic rows that stronger shapes don't, or a 25th of all: words that only stand beside others go."""
        at: dict[str, set[int]] = {}
        for i, found in enumerate(held):
            for s in found:
                at.setdefault(s, set()).add(i)
        left, kept = set(range(len(held))), {s for s, rows in at.items() if 25 * len(rows) >= len(held) and len(rows) >= 5}
        for s in kept:
            left -= at[s]
        while at:
            best = max(at, key=lambda s: (len(at[s] & left), -len(s), s))
            gain = at.pop(best) & left
            if len(gain) < least:
                break
            kept.add(best)
            left -= gain
        self.odds = {s: self.odds[s] for s in sorted(kept)}

    def word(self, word: str) -> float:
        if word[:4] not in self.begins:
            return 0.0
        return max(self.odds.get(s, 0.0) for s in shapes(word))


class Scorer:
    def __init__(self, lexicon: Lexicon, channel: Channel, most: int = 500_000):
        self.lexicon, self.channel, self.most, self.cache = lexicon, channel, most, {}

    def token(self, token: str) -> float:
        """Signs in pairs or more at the end only decorate; a single one may hide a letter."""
        bare = _TAIL.sub("", token.strip(_PUNCTUATION))
        value, plain = self.lexicon.word(bare), bare.isalpha()
        if plain and (value or not _TRIPLE.search(bare)):
            return value
        if not plain and not value:
            value = self.lexicon.word(bare.strip(_SIGNS))
        if not value and disguised(bare):
            value = self.lexicon.word(self.channel.decode(bare))
        return value

    def restored(self, text: str) -> list[str]:
        """Tokens of the text, letters set apart joined, as one word and as the words they make."""
        low = text.lower()
        tokens = low.split()
        for m in _APART.finditer(low):
            tokens.append(re.sub(r"[ .\-_*]", "", m[0]))
            tokens += self.channel.words(m[0])
        return tokens

    def __call__(self, text: str | None) -> float:
        if not text or not self.lexicon.odds:
            return 0.0
        if len(self.cache) > self.most:
            self.cache = {}
        cache, miss, worst = self.cache, 1.0, 0.0
        for token in set(self.restored(text)):
            value = cache.get(token)
            if value is None:
                value = cache[token] = self.token(token)
            if value:
                p = 1 / (1 + math.exp(-value))
                worst, miss = max(worst, p), miss * (1 - 0.9 * p)
        return max(worst, 1 - miss) if worst else 0.0


def letter_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Character trigrams of all texts, 27 classes of bytes each, summed over partitions."""
    table = np.zeros(256, np.int64)
    for i in range(26):
        table[97 + i] = table[65 + i] = i + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for batch in slices(batches, "text"):
            codes = table[column_bytes(batch.column("text"))[0]]
            if len(codes) > 2:
                total += np.bincount(codes[:-2] * 729 + codes[1:-1] * 27 + codes[2:], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.record_batch({"gram": at.astype(np.int32), "n": total[at]})

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(count), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(27**3)
    for r in rows:
        out[r[0]] = r[1]
    return out


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Scorer:
    """train: condition on the id, for texts and labels alike."""
    marked = labels.where(train & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    texts = docs.where(train).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    picked = marked.orderBy(F.xxhash64("id"), "id", "y").limit(sample_rows)
    rows = texts.where(F.octet_length("text") <= sample_bytes).join(F.broadcast(picked), "id").select("text", "y").where("text is not null")

    rows = saved(rows.distinct())

    def shapes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0, 0]
        seen = [Counter(), Counter()]
        for batch in slices(batches, "text"):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                n[y > 0] += 1
                seen[y > 0].update({s for w in words_of(text) for s in shapes(w)})
        both = list(seen[0].keys() | seen[1].keys())
        yield pa.record_batch({"shape": pa.array(["", *both], pa.string()), "clean": pa.array([n[0], *(seen[0][s] for s in both)], pa.int64()), "toxic": pa.array([n[1], *(seen[1][s] for s in both)], pa.int64())})

    sums = rows.mapInArrow(lean(shapes_of), "shape string, clean long, toxic long").groupBy("shape").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kept = sums.where((F.col("shape") == "") | ((F.col("toxic") >= 3) & (F.col("toxic") > F.col("clean") / 8))).collect()
    n = next(((r["clean"], r["toxic"]) for r in kept if r["shape"] == ""), (0, 0))
    kept = [r for r in kept if r["shape"]]
    toxic, clean = (Counter({r["shape"]: r[c] for r in kept}) for c in ("toxic", "clean"))
    odds = log_odds(toxic, clean, n[1], n[0])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [sorted({s for w in words_of(t) for s in shapes(w)} & odds.keys()) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"held": pa.array(found, pa.list_(pa.string()))})

    lists = rows.where("y > 0").select("text").mapInArrow(lean(held), "held array<string>").where(F.size("held") > 0).collect()
    lexicon = Lexicon(odds, toxic, [r["held"] for r in lists])
    return Scorer(lexicon, Channel(letter_counts(texts, "text"), lexicon.words))


def toxicity(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id long, score double, predicted int."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text"):
            found = [own(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"id": batch.column("id"), "score": pa.array(found, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in found], pa.int32())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(score), "id long, score double, predicted int")
