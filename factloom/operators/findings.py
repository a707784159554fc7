"""Findings of a ledger check: rules of one row, settled in one scan a table, and rules between tables, settled by joins on keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: shapes of ids, keys, hashes, dates, and the words that a ledger allows
SLUG = r"\A[a-z0-9]+(--?[a-z0-9]+)*\z"
SOURCE_KEY = r"\A[a-z][a-z0-9-]{0,31}\z"
FULL_HASH = r"\A[0-9a-f]{64}\z"
CORPUS_URI = r"\Acorpus://[0-9a-f]{64}([?#].*)?\z"
QUALIFIED_URI = r"\Acorpus://[a-z0-9-]+/[0-9a-f]{64}"
REFERENCE = r"\A[a-z0-9][a-z0-9._-]*(@[a-z0-9][a-z0-9._-]*)?/.+\z"
DAY = r"\A\d{4}(-\d{2}(-\d{2})?)?\z"
STATUSES = ["confirmed", "provisional", "inferred", "reported", "disputed", "conflicting"]
PRESENCE = ["none", "some"]
EVIDENCE_KINDS = ["authoritative", "direct", "incidental"]

Rule = tuple[str, str, Column]

_no = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
_given = lambda c: F.col(c).isNotNull()


def fact_rules() -> list[Rule]:
    """Over (id, stem, type, directory, name, sensitivity, provenance)."""
    return [
        ("id-stem", "err", ~F.col("id").eqNullSafe(F.col("stem"))),
        ("id-slug", "err", ~F.coalesce(F.col("id").rlike(SLUG), F.lit(False))),
        ("type-directory", "err", ~F.col("type").eqNullSafe(F.col("directory"))),
        ("no-name", "err", _no("name")),
        ("sensitivity", "err", F.col("sensitivity") != "private"),
        ("provenance", "err", F.col("provenance") != "auto"),
    ]


def claim_rules() -> list[Rule]:
    """Over (predicate, status, presence, value, object, attribution, provenance, sensitivity, period, asof)."""
    return [
        ("no-predicate", "err", _no("predicate")),
        ("bad-status", "err", ~F.coalesce(F.col("status").isin(STATUSES), F.lit(False))),
        ("presence-value", "err", ~F.col("presence").isin(PRESENCE)),
        ("presence-alone", "err", _given("presence") & (_given("value") | _given("object"))),
        ("no-voice", "err", (F.col("status") == "reported") & _no("attribution")),
        ("provenance", "err", F.col("provenance") != "auto"),
        ("auto-capped", "err", (F.col("provenance") == "auto") & (F.col("status") != "provisional")),
        ("sensitivity", "err", F.col("sensitivity") != "private"),
        ("odd-asof", "warn", ~F.col("asof").rlike(DAY)),
        ("undated", "warn", F.col("asof").isNull() & F.col("period").isNull()),
    ]


def source_rules() -> list[Rule]:
    """Over (source_key, record, ref)."""
    return [
        ("source-key", "err", ~F.coalesce(F.col("source_key").rlike(SOURCE_KEY), F.lit(False))),
        ("one-target", "err", _given("record") == _given("ref")),
        ("record-hash", "err", ~F.col("record").rlike(FULL_HASH)),
        ("ref-shape", "err", ~F.col("ref").rlike(REFERENCE)),
    ]


def roster_rules() -> list[Rule]:
    """Over (uri, role, modality, derivation, derived_from)."""
    qualified = F.coalesce(F.col("uri").rlike(QUALIFIED_URI), F.lit(False))
    return [
        ("role-slug", "err", ~F.coalesce(F.col("role").rlike(SLUG), F.lit(False))),
        ("qualified-uri", "err", qualified),
        ("uri-shape", "err", ~qualified & ~F.coalesce(F.col("uri").rlike(CORPUS_URI), F.lit(False))),
        ("modality", "err", F.trim("modality") == ""),
        ("derivation", "err", F.trim("derivation") == ""),
        ("derived-pair", "err", _given("derivation") != _given("derived_from")),
        ("derived-uri", "err", ~F.col("derived_from").rlike(CORPUS_URI)),
    ]


def evidence_rules() -> list[Rule]:
    """Over (kind, element, elements, anchor, source_key); elements: the length of the claim's value array, null if it is none."""
    return [
        ("evidence-kind", "err", ~F.coalesce(F.col("kind").isin(EVIDENCE_KINDS), F.lit(False))),
        ("element-of-none", "err", _given("element") & F.col("elements").isNull()),
        ("element-range", "err", _given("elements") & ((F.col("element") < 0) | (F.col("element") >= F.col("elements")))),
        ("anchor-mark", "err", F.col("anchor").startswith("?")),
        ("no-source", "err", _no("source_key")),
    ]


def row_findings(df: DataFrame, where: Column, rules: Sequence[Rule]) -> DataFrame:
    """(rule, severity, place) of each rule that a row breaks, in one scan; a condition that is null is not broken."""
    each = F.array(*(F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for rule, severity, bad in rules))
    return df.select(where.alias("place"), F.explode(F.array_compact(each)).alias("f")).select("f.rule", "f.severity", "place")


def _told(df: DataFrame, rule: str, severity: str, place: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), place.alias("place"))


def duplicates(df: DataFrame, keys: Sequence[str], rule: str, place: Column) -> DataFrame:
    """One finding for each key that several rows have; a row with a null in the key has none."""
    known = df.dropna(subset=list(keys))
    return _told(known.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1"), rule, "err", place)


def dangling(df: DataFrame, column: str, live: DataFrame, id_col: str, rule: str, place: Column, severity: str = "err") -> DataFrame:
    """A finding for each row whose reference names no living id; null refers to nothing."""
    ids = live.select(F.col(id_col).alias(column)).distinct()
    return _told(df.where(_given(column)).join(ids, column, "left_anti"), rule, severity, place)


def lineage_findings(lineage: DataFrame, live: DataFrame) -> DataFrame:
    """Rows (old_id, to_id) whose key still lives, whose target is retired itself (one hop only) or does not exist. live: (id)."""
    ids = live.select("id").distinct()
    retired = lineage.select(F.col("old_id").alias("id")).distinct()
    place = F.concat("old_id", F.lit(" -> "), F.coalesce("to_id", F.lit("")))
    lost = lineage.withColumn("id", F.col("to_id")).join(ids, "id", "left_anti")
    parts = [
        _told(lineage.withColumn("id", F.col("old_id")).join(ids, "id", "left_semi"), "key-lives", "err", place),
        _told(lost.join(retired, "id", "left_semi"), "second-hop", "err", place),
        _told(lost.join(retired, "id", "left_anti"), "no-target", "err", place),
    ]
    return reduce(DataFrame.unionByName, parts)


def citation_findings(claims: DataFrame, sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Between claims (fact_id, claim_id), sources (fact_id, source_key, record, ref) and evidence (fact_id, claim_id, source_key): a claim without evidence, evidence whose source is not its fact's, sources that nothing uses, targets listed twice."""
    pair = ["fact_id", "source_key"]
    listed, used = sources.select(*pair).distinct(), evidence.select(*pair).distinct()
    at = F.concat_ws("/", *pair)
    return reduce(
        DataFrame.unionByName,
        [
            _told(claims.join(evidence.select("claim_id").distinct(), "claim_id", "left_anti"), "no-evidence", "err", F.col("claim_id")),
            _told(used.dropna().join(listed, pair, "left_anti"), "unknown-source", "err", at),
            _told(listed.join(used, pair, "left_anti"), "unused-source", "warn", at),
            duplicates(sources, ["fact_id", "record"], "record-twice", F.concat_ws("/", "fact_id", "record")),
            duplicates(sources, ["fact_id", "ref"], "ref-twice", F.concat_ws("/", "fact_id", "ref")),
        ],
    )


def derived_findings(roster: DataFrame) -> DataFrame:
    """Roster rows (fact_id, uri, derived_from) whose origin the same fact does not roster."""
    rostered = roster.select("fact_id", F.col("uri").alias("derived_from")).distinct()
    return _told(roster.where(_given("derived_from")).join(rostered, ["fact_id", "derived_from"], "left_anti"), "derived-not-rostered", "err", F.concat_ws("/", "fact_id", "uri"))
