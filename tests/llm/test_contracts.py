"""Registered queries against brute force, and cases of ties, repeats, clashing names and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontaminate, html_extract, language_id, minhash, packing, queries, suffix_dedup, tokens, topk, toxicity, window_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_suffix_query(spark, texts):
    seen, want = {}, []
    raw = [(i, t.encode()) for i, t in texts]
    for _, b in raw:
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    assert sorted(map(tuple, queries.op1_suffix_dedup(spark, SF).collect())) == sorted(want)


def test_packing_query(spark, texts):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ids = {i: [*e.ids, 0] for (i, _), e in zip(texts, lib.encode_batch([t for _, t in texts], add_special_tokens=False))}
    pieces, sequences = {}, {}
    for r in queries.op3_packing(spark, SF).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and 0 < r.length <= 1024
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in ids.items():
        assert [x for a, n in sorted(pieces[i]) for x in range(a, a + n)] == list(range(len(own)))
    for parts in sequences.values():
        assert [x for a, n in sorted(parts) for x in range(a, a + n)] == list(range(sum(n for _, n in parts))) and sum(n for _, n in parts) <= 1024


def test_minhash_query(spark, texts):
    sets = {}
    for i, t in texts:
        w = WORD.findall(t.encode().lower())  # bytes.lower touches A-Z alone
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)
    assert sorted(map(tuple, queries.op7_minhash(spark, SF).collect())) == want


def test_minhash_ids_repeat(spark):
    rng = random.Random(4)
    a = [rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(80)]
    z = " ".join(f"w{rng.random()}" for _ in range(60))
    rows = [(7, " ".join(a)), (7, z), (8, " ".join([*a, "more"])), (9, z), (None, z), (None, z), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id or -1, r.component_id or -1) for r in minhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, -1), (7, 7), (7, 7), (8, 7), (9, 7), (10, 10)]
    kept = minhash.keep_first(docs.withColumn("row", F.lit("own")).repartition(1).cache())
    assert kept.columns == ["doc_id", "text", "row"]
    assert sorted((r.doc_id or -1, (r.text or "")[:9]) for r in kept.collect()) == sorted([(7, " ".join(a)[:9]), (7, z[:9]), (10, "")])


def test_window_query(spark, texts):
    seen, want = {}, []
    words = [(i, WORD.findall(t.encode())) for i, t in texts]
    for _, w in words:
        for k in range(len(w) - 34):
            seen[tuple(w[k : k + 35])] = seen.get(tuple(w[k : k + 35]), 0) + 1
    for i, w in words:
        gone = {x for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for x in range(k, k + 35)}
        want.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    assert sorted(map(tuple, queries.op8_substring_dedup(spark, SF).collect())) == sorted(want)


def _tiled(item, doc, least):
    """Plain greedy string tiling: the longest run of unmarked words, the first of equals, again and again."""
    mine, theirs = [False] * len(item), [False] * len(doc)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not mine[i + n] and not theirs[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < least:
            return sum(mine) / len(item)
        n, i, j = best[0], -best[1], -best[2]
        mine[i : i + n] = theirs[j : j + n] = [True] * n


def test_decontamination_end_to_end(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(12, 30)))) for i in range(8)] + [(50, None), (51, ""), (52, "w1 w2")]
    rows = []
    for i in range(40):
        own = rng.choices(words, k=60)
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items[:8])[1].split()
            at = rng.randrange(len(part) - 6)
            own[(k := rng.randrange(50)) : k] = part[at : at + rng.randint(5, 20)]
        rows.append((i, " ".join(own).upper() + "."))
    rows += [(90, None), (91, ""), (91, rows[0][1]), (92, " ".join(items[0][1].split()) * 300)]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, found long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontaminate.decontaminate(docs, bench).collect():
        got.setdefault(r.id, []).append((r.contaminated, round(r.coverage, 9)))
    for i, t in rows[:-1]:
        doc = re.findall(r"\w+", (t or "").lower())
        covers = [_tiled(it.split(), doc, min(5, len(it.split()))) for _, it in items if it]
        best = max([c for c in covers if c >= 0.5], default=0.0)
        assert (best >= 0.5, round(best, 9)) in got[i], i
    assert got[92][0][0]
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in got.items() for c, _ in v if not c)
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0 and decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_language_sample_and_letters(spark):
    rows = [(i, "common words again", "big") for i in range(300)] + [(1000 + i, "xyz zyx yxz", "rare") for i in range(3)] + [(2000 + i, "long " * 60, "vast") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True), sample_rows=30, sample_bytes=100)
    assert model.langs == ["big", "rare", "vast"]
    odd = spark.createDataFrame([(1, "\u00b2 \u00bd \u2167 12"), (2, "zyx"), (2, "zyx"), (3, "zyx " * 50_000), (4, "\u65e5")], "doc_id long, text string").withColumn("score", F.lit("s"))
    got = sorted((r.id, r.lang_pred) for r in language_id.identify(odd, model).collect())
    assert got[:4] == [(1, "und"), (2, "rare"), (2, "rare"), (3, "rare")]
    assert sorted(r.doc_id for r in language_id.keep_languages(odd, model, least=0.4).collect()) == [2, 2, 3]
    assert language_id.identify(odd.limit(0), model).count() == 0
    assert language_id.quotas({"a": 2, "b": 50, "c": 90}, 30) == {"a": 2, "b": 14, "c": 14}


def test_language_scores_by_brute_force(spark):
    rng = random.Random(11)
    rows = [(" ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(12)), lang) for _ in range(30) for lang, letters in (("p", "abcd"), ("q", "cdef"))]
    model = language_id.Model(rows)
    count = {}
    for t, lang in rows:
        for w in t.split():
            count.setdefault(w, {}).setdefault(lang, 0)
            count[w][lang] += 1

    def tables(units, least):
        held = {}
        for w, by in count.items():
            for u in units(w):
                for lang, n in by.items():
                    held.setdefault(u, {"p": 0, "q": 0})[lang] += n
        held = {u: v for u, v in held.items() if sum(v.values()) >= least}
        total = {lang: sum(v[lang] + 0.5 for v in held.values()) for lang in "pq"}
        return {u: {lang: np.log((v[lang] + 0.5) / total[lang]) for lang in "pq"} for u, v in held.items()}

    grams = {n: tables(lambda w, n=n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)], 1 if n == 1 else 2) for n in (5, 4, 3, 2, 1)}
    whole = tables(lambda w: [w], 2)
    for w in [*list(count)[:60], "abcdabcd", "zz", "efefe"]:
        got = model.word(w)
        if w in whole:
            want = whole[w]["p"] - whole[w]["q"]
        else:
            want = 0.0
            for n in (5, 4, 3, 2, 1):
                all_ = [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
                known = [grams[n][g] for g in all_ if g in grams[n]]
                if known and 2 * len(known) >= len(all_):
                    want = float(np.mean([k["p"] - k["q"] for k in known]))
                    break
        assert got[0] - got[1] == pytest.approx(want, abs=1e-3), w


def test_top_k_large_scores_repeats_and_names(spark):
    ids, v = np.arange(4096), np.full((4096, 1), 1 << 29, np.int64)
    v[7], v[9] = 1 << 52, 1 << 50
    one = np.array([[1]], np.int64)
    _, _, found, score = topk._best(np.array([0]), np.array([-1]), one, ids, v, 3)
    assert sorted(zip((-score).tolist(), found.tolist())) == [(-(1 << 52), 7), (-(1 << 50), 9), (-(1 << 29), 0)]
    with pytest.raises(ValueError):
        topk._best(np.array([0]), np.array([-1]), v[7:8], ids, v, 3)
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, x, "r", 1) for i, x in rows], "vec_id long, embedding array<float>, rank string, tile int")
    got = {}
    for r in topk.top_k(frame, F.col("vec_id") == 50, k=3).collect():
        got.setdefault(r.rank, []).append((r.vec_id, r.score >> 16))
    assert {n: sorted(x) for n, x in got.items()} == {1: [(1, 2), (2, 2)], 2: [(2, 2), (3, 1)], 3: [(2, 0), (3, 1)]}
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0


def test_html_pages_by_any_number_of_tasks(spark):
    rows = [(i, f"http://h.com/{i % 3}/{i:03}", f"<div>notice of the site</div><p>text of page {i} {'x' * i}") for i in range(60)]
    rows += [(None, None, "<p>a"), (7, rows[7][1], rows[7][2]), (100, "http://z.com", None)]
    frame = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "4", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted((r.id or -1, r.url or "", r.text) for r in html_extract.extract(frame).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and len(found[0]) == 63
    assert all("notice" not in t for i, _, t in found[0] if i >= 0)
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_toxicity_long_tokens_and_names(spark):
    rows = [(i, f"plain words number{i} " + ("you idiot" if i % 3 == 0 else "my friend"), int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels, F.lit(True))
    odd = spark.createDataFrame([(1, "i" * 50 + "d" * 40 + "i0t"), (2, "-".join("idiot") + "." * 90), (3, "ab1" * 40_000), (4, None), (5, "fine " * 40_000), (5, "fine")], "doc_id long, text string").withColumn("predicted", F.lit("p"))
    assert sorted((r.id, r.predicted) for r in toxicity.toxicity(odd, scorer).collect()) == [(1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (5, 0)]
    assert toxicity.toxicity(odd.limit(0), scorer).count() == 0


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline

    long = " ".join(f"word{i}" for i in range(90))
    item = "the quick brown fox jumps over the lazy dog near the river"
    rows = [(1, long + " tail one"), (None, long + " tail one"), (2, None), (3, "12 34"), (4, f"so {item} it is"), (5, "some words of their own"), (5, "other words, but one id"), (6, "head " + long[:400])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).cache()
    near = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted((r.doc_id or -1, r.text or "") for r in near.collect()) == sorted((i or -1, t or "") for i, t in rows if i is not None)
    cut = {(r.doc_id, r.text) for r in corpus_pipeline.suffixes(spark, near.cache(), SF).collect()}
    assert (1, long[400:] + " tail one") in cut and (6, "head ") in cut
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert 4 not in {r.doc_id for r in decontaminate.keep_clean(near, bench).collect()}
    pieces = corpus_pipeline.packed(spark, near, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum("doc_tokens").alias("m")).collect()
    assert all(r.n == r.m or r.doc_id in (1, 5, 6) for r in pieces)
