"""Which facts, names and predicates may be the same thing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized, slug, tokens

# fixed values: the strength of a basis, the lesser the stronger
RANKS = {"id": 0, "redirect": 1, "name": 2, "alias": 2, "id-prefix": 3, "substring": 4, "tokens": 5}


def name_collisions(names: DataFrame) -> DataFrame:
    """(key, ids): normalized names that two or more ids bear. names(id, name), aliases among them."""
    rows = names.select("id", normalized(F.col("name")).alias("key")).where("key <> ''")
    return rows.groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)


def shared_external_ids(claims: DataFrame) -> DataFrame:
    """(key, ids): facts with one value under a predicate that ends in -id or _id."""
    rows = claims.where(F.col("predicate").rlike(r"[-_]id$")).select(F.concat("predicate", F.lit("="), normalized(F.col("value"))).alias("key"), "fact_id").where("key is not null")
    return rows.groupBy("key").agg(F.array_sort(F.collect_set("fact_id")).alias("ids")).where(F.size("ids") > 1)


def contained_ids(facts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(type, short_id, long_id): the words of one id are a proper subset of the other's, both of one type, not already a name collision.

    Pairs meet on the rarest word of the shorter; the words of the pair are fetched
    only for pairs that met.
    """
    rows = facts.select("type", F.col("id"), F.array_distinct(tokens(F.col("id"))).alias("ts")).where(F.size("ts") > 0)
    each = rows.select("type", "id", F.size("ts").alias("n"), F.explode("ts").alias("t"))
    often = each.groupBy("type", "t").agg(F.count("*").alias("m"))
    rare = each.join(often, ["type", "t"]).groupBy("type", "id", "n").agg(F.min(F.struct("m", "t")).alias("r")).select("type", F.col("id").alias("short_id"), F.col("n").alias("_n"), F.col("r.t").alias("t"))
    pairs = rare.join(each.withColumnRenamed("id", "long_id"), ["type", "t"]).where("_n < n").select("type", "short_id", "long_id")
    a, b = (rows.select("type", F.col("id").alias(k), F.col("ts").alias(c)) for k, c in (("short_id", "a"), ("long_id", "b")))
    out = pairs.join(a, ["type", "short_id"]).join(b, ["type", "long_id"]).where(F.size(F.array_except("a", "b")) == 0).select("type", "short_id", "long_id")
    if names is not None:
        keyed = names.select("id", normalized(F.col("name")).alias("key")).where("key <> ''").distinct()
        one, two = keyed.select(F.col("id").alias("short_id"), F.col("key").alias("_k")), keyed.select(F.col("id").alias("long_id"), F.col("key").alias("_k2"))
        same = out.join(one, "short_id").join(two, "long_id").where("_k = _k2").select("short_id", "long_id").distinct()
        out = out.join(same, ["short_id", "long_id"], "left_anti").select("type", "short_id", "long_id")
    return out


def similar_predicates(counts: DataFrame) -> DataFrame:
    """(a, b, basis): predicates whose words contain one another, or differ in one word of two or more. counts(predicate, n); predicates are a vocabulary.

    Pairs meet on a common word, or on all words but one.
    """
    rows = counts.select("predicate", F.array_sort(F.array_distinct(tokens(F.col("predicate")))).alias("ts")).where(F.size("ts") > 0)
    one = rows.select(F.col("predicate").alias("p"), F.col("ts").alias("x"), F.explode("ts").alias("t"))
    two = rows.select(F.col("predicate").alias("q"), F.col("ts").alias("y"), F.explode("ts").alias("t"))
    met = one.join(two, "t").where("p < q").select("p", "q", "x", "y").distinct()
    both, nx, ny = F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y")
    subset, swap = (both == F.least(nx, ny)) & (nx != ny), (nx == ny) & (nx >= 2) & (both == nx - 1)
    a, b = F.when(subset & (nx > ny), F.col("q")).otherwise(F.col("p")), F.when(subset & (nx > ny), F.col("p")).otherwise(F.col("q"))
    return met.where(subset | swap).select(a.alias("a"), b.alias("b"), F.when(subset, "token-subset").otherwise("one-token-diff").alias("basis"))


def resolved(entries: DataFrame, query: str, limit: int = 15, type_: str | None = None) -> DataFrame:
    """(id, basis, rank) of the entries that a query may mean, one row an id, the strongest basis first.

    entries(id, type, name, aliases array, merged_into): a retired entry answers as
    its survivor only.  The query counts as it stands and as a slug; a substring hit
    of an entry stands in for its words.
    """
    shown = F.lit(query)
    norm, link = normalized(shown), slug(shown)
    words = F.array_distinct(tokens(shown))
    live = entries.where("merged_into is null")
    old = entries.where("merged_into is not null").select(F.col("id").alias("_old"), F.col("merged_into").alias("id"))
    own_name = normalized(F.coalesce("name", F.lit("")))
    also = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), normalized)
    text = F.concat_ws(" ", normalized(F.col("id")), own_name, F.array_join(also, " "))
    exact = F.col("id").isin(query) | (F.col("id") == link)
    inside = (F.length(norm) > 0) & (normalized(F.col("id")).contains(norm) | own_name.contains(norm) | F.exists(also, lambda x: x.contains(norm)))
    held = (F.size(words) > 0) & (F.size(F.array_except(words, F.split(text, " "))) == 0)
    named = (F.length(norm) > 0) & (own_name == norm)
    basis = F.when(exact, "id").when(named, "name").when((F.length(norm) > 0) & F.array_contains(also, norm), "alias").when((F.length(link) > 0) & F.col("id").startswith(link), "id-prefix").when(inside, "substring").when(held, "tokens")
    first = live.select("id", "type", basis.alias("basis")).where("basis is not null")
    via = old.where((F.col("_old") == query) | (F.col("_old") == link) | ((F.length(link) > 0) & F.col("_old").startswith(link)))
    moved = via.join(live.select("id", "type"), "id").select("id", "type", F.when((F.col("_old") == query) | (F.col("_old") == link), "redirect").otherwise("id-prefix").alias("basis"))
    ranks = F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))
    rows = first.unionByName(moved).withColumn("rank", ranks[F.col("basis")])
    if type_ is not None:
        rows = rows.where(F.col("type") == type_)
    best = rows.groupBy("id").agg(F.min(F.struct("rank", "basis")).alias("m")).select("id", "m.basis", "m.rank")
    return best.orderBy("rank", "id").limit(limit)
