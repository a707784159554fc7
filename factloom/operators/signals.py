"""Health signals and derived views of records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layer_census(records: DataFrame) -> DataFrame:
    """One row of counts over records (state, document_shaped, title): rendered records that are no documents count as extraction, unknown states as proxy."""
    state = F.coalesce(F.col("state"), F.lit("proxy"))
    shaped, titled = F.coalesce(F.col("document_shaped"), F.lit(False)), F.coalesce(F.col("title"), F.lit("")) != ""
    return records.agg(
        F.count_if(state == "formed").alias("formed"),
        F.count_if(state == "terminal").alias("terminal"),
        F.count_if((state == "rendered") & shaped).alias("rendered"),
        F.count_if((state == "rendered") & ~shaped).alias("extraction"),
        F.count_if(~state.isin("formed", "terminal", "rendered")).alias("proxy"),
        F.count_if(titled).alias("titled"),
        F.count_if(~titled).alias("untitled"),
    )


def by_severity(issues: DataFrame, order: str, limit: int = 50) -> DataFrame:
    """The first `limit` issues of each severity in the order given; a null severity is `unknown`. Each task keeps at most `limit` rows a severity before the shuffle."""
    known = issues.withColumn("severity", F.coalesce("severity", F.lit("unknown")))
    return known.withColumn("place", F.row_number().over(Window.partitionBy("severity").orderBy(order))).where(F.col("place") <= limit)


def sparse_bodies(records: DataFrame, body: Column, pages: Column, least: int = 300) -> DataFrame:
    """Records of more than three pages with fewer than `least` characters a page, with their density."""
    chars = F.char_length(F.coalesce(body, F.lit("")))
    out = records.withColumns({"body_chars": chars, "density": F.round(chars / pages, 1)})
    return out.where((pages > 3) & (chars < pages * least))


def pressure(placements: DataFrame, waiting: DataFrame) -> DataFrame:
    """How many records place each member whose own record waits. placements: (record, member); waiting: (member)."""
    return placements.join(waiting.select("member").distinct(), "member", "left_semi").distinct().groupBy("member").agg(F.count("*").alias("placed_by"))


def schema_usage(declared: DataFrame, used: DataFrame) -> DataFrame:
    """Uses of every declared (type, field), and types that are used without being declared (field null). Uses collapse before they meet the declarations."""
    counts = used.groupBy("type", "field").agg(F.count("*").alias("n"))
    fields = declared.select("type", "field").distinct().join(counts, ["type", "field"], "left").select("type", "field", F.coalesce("n", F.lit(0)).alias("uses"))
    bare = counts.join(declared.select("type").distinct(), "type", "left_anti").groupBy("type").agg(F.sum("n").alias("uses"))
    return fields.unionByName(bare.select("type", F.lit(None).cast("string").alias("field"), "uses"))


def content_duplicates(records: DataFrame, embeds: DataFrame) -> DataFrame:
    """Records (record_id, canonical) that share the canonical hash and the sorted hashes of their embeds (record_id, transport): key, first_id, n. Without a canonical hash a record has no key."""
    held = embeds.groupBy("record_id").agg(F.array_sort(F.collect_list("transport")).alias("held"))
    keyed = records.where(F.coalesce(F.col("canonical"), F.lit("")) != "").join(held, "record_id", "left")
    key = F.sha2(F.concat_ws("\n", F.col("canonical"), F.concat_ws("\n", "held")), 256)
    return keyed.groupBy(key.alias("key")).agg(F.min("record_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


def blended(first: DataFrame, second: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """Hits of the first search in order, then those of the second that the first does not have, `limit` in all. Both searches are already limited lists."""
    both = first.withColumn("tier", F.lit(0)).unionByName(second.withColumn("tier", F.lit(1)))
    once = both.groupBy(key).agg(F.min_by(F.struct(*both.columns), F.struct("tier", order)).alias("hit")).select("hit.*")
    return once.orderBy("tier", order, key).limit(limit)


def distinct_by_key(rows: DataFrame, group: str, key: Column, order: Column) -> DataFrame:
    """The first row of each group and key in order: URIs of a record that differ in spelling only, entries of a view."""
    return rows.groupBy(group, key.alias("_key")).agg(F.min_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def ordered_union(*lists: Column) -> Column:
    """Entries of several arrays in order, each once; null arrays and entries are none."""
    return F.array_distinct(F.array_compact(F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))))


def latest_qualified(origins: DataFrame, value: str) -> DataFrame:
    """The value of a record's last origin block that names an overlay and has one; of equal indexes the largest value."""
    sound = origins.where(F.col("overlay_id").isNotNull() & (F.trim(value) != ""))
    return sound.groupBy("record_id").agg(F.max(F.struct("block_index", value))[value].alias(value))


def timeline(snapshots: DataFrame, fields: DataFrame) -> DataFrame:
    """(record_id, at, source) of snapshots (record_id, snapshot) and dated fields (record_id, field, value) without empty ones."""
    seen = snapshots.select("record_id", F.col("snapshot").alias("at"), F.lit("origin.snapshot").alias("source"))
    told = fields.select("record_id", F.col("value").alias("at"), F.col("field").alias("source"))
    return seen.unionByName(told).where(F.trim("at") != "")


def ranked_prefixes(counts: DataFrame, group: str, name: str, n: str, most: int = 8) -> DataFrame:
    """For each group the sets of its 1 to `most` most frequent names, ties by name; ranks are cut before names are gathered."""
    top = counts.withColumn("size", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(n), name))).where(F.col("size") <= most)
    each = top.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("size", name))).alias("names"))
    return each.select(group, F.explode(F.sequence(F.lit(1), F.size("names"))).alias("size"), "names").select(group, "size", F.transform(F.slice("names", 1, F.col("size")), lambda x: x[name]).alias("names"))


def bound_elements(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Elements of claims' value arrays with the number of their evidence rows: those bound to the element and those bound to the whole (element null). Evidence collapses by claim and element first."""
    n = evidence.groupBy("claim_id", "element").agg(F.count("*").alias("n"))
    each = claims.select("claim_id", F.posexplode("value").alias("element", "entry"))
    whole = n.where("element is null").select("claim_id", F.col("n").alias("whole"))
    return each.join(n, ["claim_id", "element"], "left").join(whole, "claim_id", "left").select("claim_id", "element", "entry", (F.coalesce("n", F.lit(0)) + F.coalesce("whole", F.lit(0))).alias("evidence"))


def claim_state(fields: Mapping[str, Column]) -> Column:
    """sha256 of a claim as JSON with sorted names, without its status and null fields: it moves if the content does."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields) if k != "status"))), 256)
