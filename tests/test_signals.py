"""Edges of capture scalars and record signals that the queries' tables do not hold."""

import datetime

from pyspark.sql import functions as F

from factloom.functions import captures
from factloom.operators import findings, signals


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_short_links(spark):
    urls = ["https://T.CO", "https://vm.tiktok.example/a/b", "https://a.example/", "https://a.example/x.html", "https://a.example/ZSQdnsm4M/?q=1", "https://a.example/" + "x" * 17, "no url", None]
    assert one(spark, *(captures.short_link(F.lit(u).cast("string")) for u in urls)) == (True, True, False, False, True, False, False, False)


def test_repair_leaves_sound_texts(spark):
    texts = ["Szymon GrabiÅ\x84ski", "Szymon Grabiński", "é", "", "plain", None]
    assert one(spark, *(captures.repaired(F.lit(x).cast("string")) for x in texts)) == ("Szymon Grabiński", "Szymon Grabiński", "é", "", "plain", None)


def test_dates_of_exports(spark):
    lines = ["From x Thu Jan  1 00:00:01 1970", "From x Thu Jan 01 1:02:03 +0130 2015", "From x Thu Jan 41 00:00:01 1970", "From x", None]
    assert one(spark, *(captures.separator_date(F.lit(x).cast("string")) for x in lines)) == ("1970-01-01T00:00:01", "2015-01-01T01:02:03+0130", None, None, None)
    told = ["Wednesday, January 8, 2014 at 6:26:59 AM UTC", "Wednesday, January 8, 2014 at 12:26:59 PM UTC", "Wednesday, January 8, 2014 at 12:00:00 AM UTC", "Wednesday, Foo 8, 2014 at 6:26:59 AM UTC", "Wednesday, January 8, 2014 at 6:26:59 AM CET", None]
    assert one(spark, *(captures.long_form_timestamp(F.lit(x).cast("string")) for x in told)) == ("2014-01-08T06:26:59Z", "2014-01-08T12:26:59Z", "2014-01-08T00:00:00Z", told[3], told[4], None)


def test_titles_without_content(spark):
    titles = [None, "Just a moment...", "Untitled Document", "ERROR", "Error handling in practice", "404"]
    assert one(spark, *(captures.empty_title(F.lit(x).cast("string")) for x in titles)) == ("empty-title", "just-a-moment", "untitled", "plain-error", None, "plain-404")


def test_cut_lists(spark):
    spans = lambda n, d: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i.alias("start"), (i + d).alias("end")))
    empty = F.lit(None).cast("array<struct<start:double,end:double>>")
    assert one(spark, *(captures.cut_signal(x) for x in (empty, spans(1, 9), spans(20, 1), spans(20, 2), spans(19, 1)))) == ("no-boundaries", "no-boundaries", "over-segmented", None, None)


def test_a_claim_state_moves_with_content_only(spark):
    state = lambda status, value: signals.claim_state({"status": F.lit(status), "value": F.lit(value), "predicate": F.lit("p")})
    a, b, c = one(spark, state("x", "v"), state("y", "v"), state("x", "w"))
    assert a == b != c


def test_empty_tables_and_nulls(spark):
    records = spark.createDataFrame([], "record_id string, canonical string, state string, document_shaped boolean, title string")
    assert tuple(signals.layer_census(records).first()) == (0,) * 7
    embeds = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "1"), ("b", "2"), ("c", "1")], "record_id string, transport string")
    same = spark.createDataFrame([("a", "k"), ("b", "k"), ("c", "k"), ("d", None), ("e", None)], "record_id string, canonical string")
    assert [(r.first_id, r.n) for r in signals.content_duplicates(same, embeds).collect()] == [("a", 2)]
    assert signals.content_duplicates(records, embeds).count() == 0
    issues = spark.createDataFrame([(i, None if i % 2 else "info") for i in range(6)], "record_id int, severity string")
    assert sorted((r.severity, r.record_id) for r in signals.by_severity(issues, "record_id", 2).collect()) == [("info", 0), ("info", 2), ("unknown", 1), ("unknown", 3)]
    assert one(spark, signals.ordered_union(F.array(F.lit("b"), F.lit(None)), F.lit(None).cast("array<string>"), F.array(F.lit("a"), F.lit("b")))) == (["b", "a"],)
    rows = spark.createDataFrame([("r", datetime.date(2020, 1, 1).isoformat()), ("r", " "), ("r", None)], "record_id string, snapshot string")
    none = spark.createDataFrame([], "record_id string, field string, value string")
    assert [tuple(r) for r in signals.timeline(rows, none).collect()] == [("r", "2020-01-01", "origin.snapshot")]


def test_findings_of_empty_tables_and_nulls(spark):
    claim = "predicate string, status string, presence string, value string, object string, attribution string, provenance string, sensitivity string, period string, asof string"
    empty = spark.createDataFrame([], claim)
    assert findings.row_findings(empty, F.lit("x"), findings.claim_rules()).count() == 0
    bare = spark.createDataFrame([(None,) * 10], claim)
    assert sorted(r.rule for r in findings.row_findings(bare, F.lit("x"), findings.claim_rules()).collect()) == ["bad-status", "no-predicate", "undated"]
    live = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    lineage = spark.createDataFrame([("a", "a"), ("b", "c"), ("c", "a"), ("d", "nowhere"), ("e", None)], "old_id string, to_id string")
    assert sorted((r.rule, r.place) for r in findings.lineage_findings(lineage, live).collect()) == [("key-lives", "a -> a"), ("no-target", "d -> nowhere"), ("no-target", "e -> "), ("second-hop", "b -> c")]
    assert [r.place for r in findings.duplicates(live, ["id"], "twice", F.col("id")).collect()] == ["a"]
    refs = spark.createDataFrame([("f", "a"), ("g", "b"), ("h", None)], "fact_id string, object string")
    assert [r.place for r in findings.dangling(refs, "object", live, "id", "dangling-object", F.col("fact_id")).collect()] == ["g"]
    roster = spark.createDataFrame([("f", "u", None), ("f", "v", "u"), ("g", "w", "u")], "fact_id string, uri string, derived_from string")
    assert [r.place for r in findings.derived_findings(roster).collect()] == ["g/w"]
