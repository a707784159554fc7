"""The operators against brute force, and on awkward rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import chat, decontaminate, duplicates, html_extract, language_id, minhash, packing, suffix_dedup, tokens, topk, toxicity, window_dedup

AWKWARD = [(1, None), (2, ""), (3, "ab " * 200), (4, "é" * 150), (5, "é" * 150 + "q"), (6, "x" * 199), (7, "w" * 40_000), (7, "w" * 40_000), (None, "z"), (8, " \n\t ")]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 160))) for _ in range(n)]
    out = []
    for i, t in enumerate(base):
        out.append((100 + i, t))
        if i % 3 == 0:
            w = t.split(" ")
            for _ in range(1 + len(w) // 150):
                w[rng.randrange(len(w))] = "edit"
            out.append((1000 + i, " ".join(w)))
        if i % 7 == 0:
            out.append((2000 + i, base[(i + 1) % n][-300:] + " " + t[:250]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", i) for i, t in AWKWARD + corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, rest long").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def texts(docs):
    return [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]


def test_suffix_dedup(docs, empty):
    rows, size, seen, want = texts(docs), 200, Counter(), Counter()
    for _, b in rows:
        seen.update(b[i : i + size] for i in range(len(b) - size + 1))
    for k, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        want[k, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)] += 1
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert all(len(r.span_starts) == r.n_spans and sum(r.span_lengths) == r.n_removed for r in got)
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    whole = suffix_dedup.suffix_dedup(docs, carry=True, whole_chars=True).select("id", F.col("rest.c.shard"), "kept").collect()
    assert all(bytes(r.kept).decode() is not None and r.shard == "s" for r in whole)


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for n, letters in ((0, "a"), (1, "a"), (50, "a"), (400, "ab"), (900, "abc")):
        t = "".join(rng.choice(letters) for _ in range(n)).encode()
        order = suffix_dedup.suffix_order(np.frombuffer(t, np.uint8))
        assert order.tolist() == sorted(range(n), key=lambda i: t[i:])
        lcp = suffix_dedup.common_prefixes(np.frombuffer(t, np.uint8), order, 20, block=16)
        for a, b in itertools.pairwise(range(n)):
            x, y = t[order[a] :], t[order[b] :]
            same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert lcp[b] == min(20, same)


def test_window_dedup(docs, empty):
    size, seen, want = 35, Counter(), Counter()
    rows = [(k, re.findall(rb"[^\x20\x09-\x0D]+", b)) for k, b in texts(docs)]
    for _, w in rows:
        seen.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    for k, w in rows:
        gone = [0] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [1] * size
        want[k, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)] += 1
    assert Counter((r.id, r.n_words, r.n_removed, bytes(r.kept)) for r in window_dedup.window_dedup(docs).collect()) == want
    assert window_dedup.window_dedup(empty).count() == 0


def near_by_brute_force(docs, percent):
    """Shingle sets by id and a function to the smallest linked id."""
    rows = [(k, b.lower() if b.isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), b)) for k, b in texts(docs)]
    sets = {}
    for k, b in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", b)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets if k is not None}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations([k for k in root if sets[k]], 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sets, find


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash(docs, empty, percent):
    sets, find = near_by_brute_force(docs, percent)
    got = minhash.near_duplicates(docs, percent=percent).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.n_shingles == len(sets[r.id])
        if r.id is not None:
            assert (r.component_id, r.kept) == (find(r.id), r.id == find(r.id))
    assert sum(k != find(k) for k in sets if k is not None) > 5
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_near_the_threshold(spark, monkeypatch):
    """Many copies just over and under the threshold, over several tiles and blocks."""
    monkeypatch.setattr(minhash, "TILE", 16)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(4)}"
        rows.append((1000 - i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, find = near_by_brute_force(docs, 85)
    assert {r.id: r.component_id for r in minhash.near_duplicates(docs, percent=85).collect()} == {k: find(k) for k, _ in rows}
    confirmed = minhash._confirmed_blocks
    seen = []
    monkeypatch.setattr(minhash, "_confirmed_blocks", lambda packed, *rest: seen.append(packed.select("p", "q").distinct().count()) or confirmed(packed, *rest))
    monkeypatch.setattr(minhash, "CENTRES", 0)
    assert {r.id: r.component_id for r in minhash.near_duplicates(docs, percent=85).collect()} == {k: find(k) for k, _ in rows}
    assert seen[0] > 20


def test_index_keys_meet_under_the_distance():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 16, (200, 128)).astype(np.uint16)
    b = a.copy()
    for i in range(200):
        b[i, rng.choice(128, 39, replace=False)] ^= 1
    x, y = minhash.index_keys(a, 39), minhash.index_keys(b, 39)
    assert (x == y).any(axis=1).all()


def test_decontaminate(spark):
    item = " ".join(f"word{i}" for i in range(30))
    moved = " ".join(item.split()[15:]) + " filler " + " ".join(item.split()[:15])
    rows = [(1, f"x {item.upper()}, y", 0), (2, moved, 0), (3, " ".join(item.split()[:10]), 0), (4, None, 0), (5, "", 0), (6, "tiny", 0), (7, "a tiny, item here", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(10, item), (11, "tiny item"), (12, None), (13, item), (14, "")], "item_id long, text string")
    for bound in (8 << 20, 10):
        got = {r.id: (r.contaminated, r.item_ids) for r in decontaminate.decontaminate(docs, bench, block_bytes=bound).collect()}
        assert [k for k, v in sorted(got.items()) if v[0]] == [1, 2, 7]
    assert [r.doc_id for r in decontaminate.keep_clean(docs, bench).orderBy("doc_id").collect()] == [3, 4, 5, 6]
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_tiles_by_brute_force():
    rng = random.Random(9)
    for _ in range(40):
        a, b = [[rng.randrange(4) for _ in range(rng.randint(3, 25))] for _ in range(2)]
        least = 3
        pairs = [(i, j) for i in range(len(a) - least + 1) for j in range(len(b) - least + 1) if a[i : i + least] == b[j : j + least]]
        got = decontaminate.tile(np.array(a), np.array(b), pairs, least)
        ma, mb = [0] * len(a), [0] * len(b)
        while True:
            best = None
            for i, j in itertools.product(range(len(a)), range(len(b))):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k >= least and (best is None or k > best[0]):
                    best = (k, i, j)
            if best is None:
                break
            k, i, j = best
            ma[i : i + k] = mb[j : j + k] = [1] * k
        assert got.sum() == sum(ma)


def test_tokens_match_the_library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    some = ["", "  ", "a  b", "it's 'tis ''s", "\n\n a\n b \n", "x\t\ty  ", "é à\xa0b  c\xa0 d", "日本 a", "12 3a4 ¼²", "<|endoftext|>", "a <|endoftext|> b's<|endoftext|><|endoftext|>", *(t for _, t in corpus())]
    ids, at = tokens.encode(some)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(some))] == [e.ids for e in lib.encode_batch(some, add_special_tokens=False)]


def test_packing(docs, empty):
    got = packing.pack(docs.where("doc_id is not null")).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault((r.id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert {k for k, _ in by_doc} == {r.doc_id for r in docs.collect() if r.doc_id is not None}
    for (_, n), pieces in by_doc.items():
        assert sum(p.length for p in pieces) % n == 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    assert packing.pack(empty).count() == 0


def test_cuts_are_cheapest():
    rng = random.Random(4)
    for _ in range(30):
        where = np.cumsum([rng.randint(1, 9) for _ in range(12)])
        cost = np.array([rng.choice([0, 0.25, 1.0]) for _ in where])
        best = {0: 0.0}
        for i, x in enumerate(where.tolist()):
            best[x] = min(v + 20 - (x - y) + cost[i] for y, v in best.items() if x - y <= 20)
        ends = packing.cuts(where, cost, 20)
        total = sum(20 - (b - a) for a, b in itertools.pairwise([0, *ends])) + sum(cost[where.tolist().index(e)] for e in ends)
        assert total == pytest.approx(best[int(where[-1])])


def test_language_id(spark):
    rng = random.Random(2)
    make = {"aa": "bad dab cab", "zz": "xyz zyx yxz"}
    rows = [(i, " ".join(rng.choices(make[lang].split(), k=8)), lang) for i in range(60) for lang in [rng.choice(list(make))]]
    docs = spark.createDataFrame(rows + [(90, None, "aa"), (91, "123 !", "aa"), (92, "dabcab", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.col("doc_id") % 5 != 0)
    got = {r.id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    assert got[90] == got[91] == ("und", 0.0) and got[92][0] == "aa"
    assert all(got[i][0] == lang for i, _, lang in rows)
    assert language_id.keep_languages(docs, model).count() == len(rows) + 1
    none = language_id.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)] + [(200, None), (201, [1.0, None] + [0.0] * 6), (202, [float("nan")] * 8), (203, [1.0] * 3), (250, [1.0] * 3)] + [(i, [0.5] * 8) for i in range(300, 320)]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if v and None not in v and not np.isnan(v).any()}
    for q in [i for i in whole if i % 50 == 0]:
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])))[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert 200 not in got and len(got[250]) == 1


def test_chat_round_trip(spark):
    odd = ["", "<|end|>", "\\<|", "<\\|x", "\\\\", "<|text|>a<|sep|>", "é\n", "|>", "<"]
    rows = [(c, t, random.Random(c * 50 + t).choice(["user", "assistant", "assistant", "<|r|>"]), random.Random(c * 90 + t).choice(odd)) for c in range(20) for t in range(9)]
    rows += [(99, 0, None, None), (99, 0, None, None), (99, None, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(frame).select("id", chat.read_back(F.col("formatted")).alias("turns"), chat.under_loss(F.col("formatted"), F.col("loss")).alias("loss"))
    for r in out.collect():
        want = sorted(((t is not None, t, role or "", text or "") for c, t, role, text in rows if c == r.id), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        assert [(t.role, t.text) for t in r.turns] == [(w[2], w[3]) for w in want]
        assert r.loss == "".join(w[3] for w in want if w[2] == "assistant")


def test_best_keeps_all_of_a_shard():
    rng = np.random.Generator(np.random.PCG64(3))
    v = rng.integers(-50, 50, (40, 8))
    ids = np.arange(40)
    for k in (1, 5, 39, 40):
        _, q, found, score = topk._best(ids, ids, v, ids, v, k)
        for i in ids:
            order = sorted((-int(v[i] @ v[j]), j) for j in ids if j != i)[:k]
            assert sorted(zip((-score[q == i]).tolist(), found[q == i].tolist()))[:k] == order


def test_html(spark):
    article = "<article><h1>T &amp; x</h1><p><b>one\n two<br>three<p>four</article>"
    page = lambda body: f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a>Home</a></nav><!-- x --><div class='ad'>buy</div>{body}<footer>&copy; f</footer></body></html>"
    rows = [(1, "http://h.com/a/1", page(article)), (2, "http://h.com/a/2", page("<div>shared</div><div>own two is long enough to differ</div>")), (3, "http://h.com/a/3", page("<div>shared</div><div>own three, which is quite another text</div>")), (4, None, None), (5, "http://z.com", ""), (6, "http://z.com/x", "<p>unclosed <")]
    got = {r.id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got[1] == "T & x\n\none two three\n\nfour"
    assert got[2].endswith("own two is long enough to differ") and got[4] == got[5] == ""
    assert "unclosed" in got[6]


def test_html_shared_lines_in_articles(spark):
    own = ["the first page says this at length", "the second page says something else", "the third page has its own words too"]
    page = lambda text: f"<body><nav>Home</nav><article><h1>{text[:14]}</h1><p>{text}<p>share this with friends</article><footer>f</footer></body>"
    rows = [(i, f"http://h.com/a/{i}", page(t)) for i, t in enumerate(own)] + [(3, "http://h.com/a/2?again", page(own[2]))]
    menu = "<div>" + "</div><div>".join(f"a long entry of the menu of all pages, number {i}" for i in range(20)) + "</div>"
    rows += [(4 + i, f"http://m.org/{i}", f"<body><nav>{menu}</nav><div>same words</div><div>only here {i}{i}</div></body>") for i in range(2)]
    got = {r.id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    shared = "\n\nshare this with friends"  # goes where pages on both sides have it; a version has no vote
    assert [got[i] for i in range(3)] == [f"{t[:14]}\n\n{t}{x}" for t, x in zip(own, (shared, "", shared))]
    assert own[2] in got[3] and got[4] == "only here 00" and got[5] == "only here 11"


def test_common_lines():
    rng = random.Random(8)
    for _ in range(200):
        a, b = [[rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        got = sorted(html_extract.common_lines(a, b))
        assert len(got) == table[-1][-1]
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_shingle_duplicates(spark):
    from __spark_entry__ import queries

    assert "shingle_duplicates" in queries()
    rng = random.Random(12)
    rows = []
    for g in range(12):
        words = ["".join(rng.choices("abcdeé", k=5)) for _ in range(120)]
        for _ in range(5):
            own = [w if rng.random() > 0.006 else "new" for w in words] + ["tail"] * rng.choice([0, 0, 8, 60])
            rows.append((rng.randrange(10_000), rng.choice([" ", "  ", "\n", ", "]).join(own)))
    rows += [(20_001, "!? " * 100), (20_002, "?! " * 100), (20_003, "short"), (20_004, "short"), (20_005, None), (None, rows[0][1]), (20_006, rows[3][1]), (20_006, rows[3][1])]
    bodies = [(i, " ".join(t.split())) for i, t in rows if i is not None and t is not None]
    bodies = [(i, b, duplicates.shingles(re.findall(r"\w+", b.lower()))) for i, b in sorted(bodies) if len(b) >= 200]
    want = []
    for i, b, s in bodies:
        like = [(j, b != c) for j, c, o in bodies if j < i and (b == c or min(len(b), len(c)) / max(len(b), len(c)) >= 0.8 and len(s & o) / len(s | o) >= 0.9)]
        if like:
            want.append((i, min(like)[0], not min(like)[1]))
    got = duplicates.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {x[2] for x in want} == {True, False}


def test_toxicity(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("bcdfglmnprtvaeiou", k=6)) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=30)) + (" you stupid idiot" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "such a 1d10t"), (903, "s t u p i d one"), (904, "stuuupid!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.id: r.predicted for r in toxicity.toxicity(docs, toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)).collect()}
    assert [got[i] for i, _, _ in rows] == [y for _, _, y in rows]
    assert [got[i] for i in range(900, 905)] == [0, 0, 1, 1, 1]
    none = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert toxicity.toxicity(docs, none).where("score > 0").count() == 0


def test_toxicity_learns_from_all_texts_but_equal_ones(spark):
    rng = random.Random(9)
    text = lambda i: "extraordinary " + " ".join("".join(rng.choices("bcdfglmnprtvaeiou", k=6)) for _ in range(12)) + " you scoundrel" * (i % 4 == 0)
    rows = [(i, text(i), int(i % 4 == 0)) for i in range(120)]
    docs, labels = (spark.createDataFrame(r, s) for r, s in (([x[:2] for x in rows], "doc_id long, text string"), ([x[::2] for x in rows], "doc_id long, toxic int")))
    scorer = toxicity.fit(docs, labels, F.lit(True))
    assert [int(scorer(t) >= 0.5) for _, t, _ in rows] == [y for _, _, y in rows]
    again = toxicity.fit(docs.unionByName(docs), labels, F.lit(True))
    assert again.lexicon.odds == scorer.lexicon.odds


def test_toxicity_letters_apart():
    counts = np.ones(27**3)
    toxic = Counter({s: 20 for w in ("stupid", "idiot") for s in toxicity.shapes(w)})
    scorer = toxicity.Scorer(toxicity.Lexicon(toxicity.log_odds(toxic, Counter(), 40, 200), toxic, [toxicity.shapes("stupid"), toxicity.shapes("idiot")] * 20), toxicity.Channel(counts, Counter({"stupid": 20, "idiot": 20})))
    for text in ("s. t. u. p. i. d", "i--d--i--o--t", "i---d---i---o---t", "such a s t u p i d one", "* s t u p 1 d", " ".join("you" * 15 + "stupid" + "you" * 15)):
        assert scorer(text) >= 0.5, text
    for text in ("1 0 1 0 7", "a b c d e f", "x " * 5000, "p. 12 - 14", "2024-01-01t00:00:00z"):
        assert scorer(text) < 0.5, text


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.dtypes
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.dtypes == columns
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.select("doc_id").distinct().count() == docs.count()
    digest = lambda df: hashlib.sha256(repr(sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32").collect()))).encode()).hexdigest()
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == docs.count() and digest(last)
