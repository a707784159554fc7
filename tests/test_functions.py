import pytest
from pyspark.sql import functions as F

from factloom.functions import dates, text
from factloom.operators import predicates, relations


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "value, first, last",
    [("2020", "2020-01-01", "2020-12-31"), ("~2020-02", "2020-02-01", "2020-02-29"), ("2021-03-04", "2021-03-04", "2021-03-04"), ("2020/2021-06", "2020-01-01", "2021-06-30"), ("2020-05/..", "2020-05-01", "9999-12-31"), ("2020-13", None, None), ("soon", None, None), (None, None, None)],
)
def test_period_interval(spark, value, first, last):
    got = one(spark, dates.period_interval, value)
    assert (got and (str(got["first"]), str(got["last"]))) == ((first, last) if first else None)


@pytest.mark.parametrize(
    "value, want",
    [("HTTP://Ex.com:80/", "http://ex.com"), ("https://ex.com:443/a?b=2&a=1#top", "https://ex.com/a?a=1&b=2"), ("https://ex.com/#/route", "https://ex.com#/route")],
)
def test_normalized_url(spark, value, want):
    assert one(spark, text.normalized_url, value) == want


def test_text(spark):
    assert one(spark, text.slug, "Ab-c  d!") == "ab-c-d"
    assert one(spark, text.plain, "a [b](c)  <i>d</i> , e") == "a b d, e"
    assert one(spark, lambda c: text.quote_found(F.lit("one ... three"), c), "one two three") is True
    assert one(spark, lambda c: text.quote_found(F.lit("three ... one"), c), "one two three") is False


def test_predicates(spark):
    rows = spark.createDataFrame([("a", ["x", "y"]), ("b", []), (None, None)], "k string, v array<string>")
    fields = {"k": (F.col("k"), False), "v": (F.col("v"), True)}
    keep = lambda spec: [r.k for r in rows.where(predicates.compile_predicate(spec, fields)).collect()]
    assert keep({"v": "x"}) == ["a"]
    assert keep({"v": {"exists": False}}) == ["b", None]
    assert keep({"none_of": [{"k": {"glob": "a*"}}]}) == ["b", None]
    assert keep({"all_of": []}) == ["a", "b", None]
    with pytest.raises(ValueError):
        predicates.safe_pattern("(a+)+")


def test_closure_reaches_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = relations.closure(edges, spark.createDataFrame([("a",)], "id string"))
    assert {(r.id, r.depth) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_token_subsets(spark):
    rows = spark.createDataFrame([(1, "red box"), (2, "big red box"), (3, "blue"), (4, "")], "id long, name string")
    assert [(r.short_id, r.long_id) for r in relations.token_subsets(rows, "id", text.tokens(F.col("name"))).collect()] == [(1, 2)]


def test_contained_quotes(spark):
    docs = spark.createDataFrame([(1, "so it ran fast over  the hill again"), (2, "ran"), (3, None), (4, ""), (1, "it ran fast over  the hills")], "doc_id int, text string")
    quotes = spark.createDataFrame([(1, "t ran fast over  the hill"), (2, "an"), (3, ""), (4, None), (5, "fast over the hill")], "item_id int, quote string")
    got = relations.contained_quotes(docs, "doc_id", "text", quotes, "item_id", "quote").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 1), (1, 2), (1, 2), (1, 3), (1, 3), (2, 2), (2, 3), (4, 3)]
