"""Joins, closures, windows and rules of knowledge collections as DataFrame plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _saved(df: DataFrame) -> DataFrame:
    """The cluster names its shared folder in spark.checkpoint.dir; one is made only in local mode, as in tests."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def resolve(refs: DataFrame, live: DataFrame, lineage: DataFrame, col: str = "id") -> DataFrame:
    """One hop: a live id is itself, else its survivor if that is live, else null. Adds `resolved`."""
    ids = live.select(F.col(col).alias("_live")).distinct()
    hop = lineage.select(F.col("old_id").alias("_old"), F.col("to_id").alias("_to")).join(ids.withColumnRenamed("_live", "_to"), "_to", "left_semi")
    out = refs.join(ids, refs[col] == F.col("_live"), "left").join(hop, refs[col] == F.col("_old"), "left")
    return out.withColumn("resolved", F.coalesce("_live", "_to")).drop("_live", "_old", "_to")


def closure(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, depth): breadth-first closure over edges (src, dst) with the least depth; no depth: to the fixpoint.

    Each hop joins only the frontier; what is reached is checkpointed, so lineage stays short.
    """
    edges = _saved(edges.select("src", "dst").distinct())
    seen = front = _saved(seeds.select(F.col("id"), F.lit(0).alias("depth")).distinct())
    hop = 0
    while depth is None or hop < depth:
        hop += 1
        front = front.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(hop))
        front = _saved(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)  # a union of saved fronts: none is written twice
    return seen


def islands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds `island`: number of the run of equal neighbours within keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    return df.withColumn("_change", change).withColumn("island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """For each left row the value of the last right row of its keys not after it, by one union and window, without a join."""
    both = left.withColumn("_side", F.lit(1)).withColumn("_t", F.col(left_time)).withColumn("_v", F.lit(None).cast(f"struct<v:{right.schema[value].dataType.simpleString()}>")).unionByName(
        right.select(*keys, F.col(right_time).alias("_t"), F.struct(F.col(value).alias("v")).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("as_of", F.last("_v", ignorenulls=True).over(w)["v"]).where("_side = 1").drop("_side", "_t", "_v")


def token_subsets(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(short_id, long_id): the tokens of one are a proper subset of the other's. Pairs meet on the rarest token of the shorter."""
    rows = df.select(F.col(id_col).alias("id"), F.array_distinct(tokens).alias("ts")).where(F.size("ts") > 0)
    each = rows.select("id", "ts", F.explode("ts").alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("n"))
    rare = each.join(often, "t").groupBy("id").agg(F.min(F.struct("n", "t")).alias("m")).select("id", F.col("m.t").alias("t"))
    short = rows.join(rare, "id").select(F.col("id").alias("short_id"), F.col("ts").alias("a"), "t")
    pairs = short.join(each.select(F.col("id").alias("long_id"), F.col("ts").alias("b"), "t"), "t")
    return pairs.where((F.size("a") < F.size("b")) & (F.size(F.array_except("a", "b")) == 0)).select("short_id", "long_id")


def contained_quotes(docs: DataFrame, doc_id: str, text: str, quotes: DataFrame, quote_id: str, quote: str) -> DataFrame:
    """(doc_id, quote_id) where the text holds the quote, byte for byte; null texts and quotes match nothing.

    A quote of four or more words stands only in texts that hold its longest pair of inner words, so those meet
    by an equi-join on that pair before the comparison. Shorter quotes, a stated query set, are compared with each text.
    """
    words = lambda c: F.split(c, " ")
    pair = lambda w: lambda i: F.concat(F.element_at(w, i), F.lit(" "), F.element_at(w, i + 1))
    q = quotes.where(F.col(quote).isNotNull()).select(F.col(quote_id).alias("q_id"), F.col(quote).alias("q"), words(F.col(quote)).alias("qw"))
    d = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("d_id"), F.col(text).alias("d"))
    inner = F.transform(F.sequence(F.lit(2), F.size("qw") - 2), lambda i: F.struct(F.length(pair(F.col("qw"))(i)), pair(F.col("qw"))(i).alias("anchor")))
    long = q.where(F.size("qw") > 3).select("q_id", "q", F.array_max(inner)["anchor"].alias("anchor"))
    keys = d.select("d_id", words(F.col("d")).alias("dw")).where(F.size("dw") > 3)
    keys = keys.select("d_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("dw") - 1), pair(F.col("dw"))))).alias("anchor"))
    met = keys.join(long, "anchor").select("d_id", "q_id", "q").distinct().join(d, "d_id").where(F.contains("d", "q"))
    rest = d.join(q.where(F.size("qw") < 4).select("q_id", "q"), F.contains("d", "q"))
    return met.select("d_id", "q_id").unionByName(rest.select("d_id", "q_id")).toDF(doc_id, quote_id)


def diff(a: DataFrame, b: DataFrame, key: str, state: Column) -> DataFrame:
    """Full outer comparison by key: identical, changed, only_a, only_b."""
    left = a.select(F.col(key).alias("key"), state.alias("sa"), F.lit(True).alias("ina"))
    right = b.select(F.col(key).alias("key"), state.alias("sb"), F.lit(True).alias("inb"))
    what = F.when(F.col("inb").isNull(), "only_a").when(F.col("ina").isNull(), "only_b").when(F.col("sa").eqNullSafe(F.col("sb")), "identical").otherwise("changed")
    return left.join(right, "key", "full").select("key", what.alias("change"))


def keyset_page(df: DataFrame, id_col: str, after: object, limit: int) -> DataFrame:
    page = df if after is None else df.where(F.col(id_col) > F.lit(after))
    return page.orderBy(id_col).limit(max(1, min(500, limit)))


def confirmed(evidence: DataFrame, claim: str, source: str, authoritative: Column, deferred: Column) -> DataFrame:
    """Authentication bar: an authoritative entry or two distinct sources, deferred entries aside."""
    counted = F.when(~deferred, F.col(source))
    return evidence.groupBy(claim).agg(F.max((~deferred) & authoritative).alias("authoritative"), F.count_distinct(counted).alias("sources")).withColumn("confirmed", F.col("authoritative") | (F.col("sources") >= 2))


def bucketed_overlaps(df: DataFrame, key: str, id_col: str, first: str, last: str, days: int = 92, most: int = 64) -> DataFrame:
    """(key, one, two) of rows of a key whose closed day ranges overlap, one < two.

    Ranges meet in buckets of `days`; a pair counts in the bucket where the later
    one begins, so a hot key is dealt by time.  Ranges of more than `most` buckets
    are few keys' own and meet the others in a join of their key alone.
    """
    lo, hi = F.floor(F.datediff(F.col(first), F.lit("1970-01-01")) / days), F.floor(F.datediff(F.col(last), F.lit("1970-01-01")) / days)
    rows = df.select(F.col(key), F.col(id_col).alias("id"), F.col(first).alias("f"), F.col(last).alias("l"), lo.alias("lo"), hi.alias("hi")).where("f <= l")
    short, long = rows.where(F.col("hi") - F.col("lo") < most), rows.where(F.col("hi") - F.col("lo") >= most)
    one = short.withColumn("b", F.explode(F.sequence("lo", "hi"))).select(F.col(key), "b", *(F.col(c).alias(f"{c}1") for c in ("id", "f", "l", "lo")))
    two = short.withColumn("b", F.explode(F.sequence("lo", "hi"))).select(F.col(key), "b", *(F.col(c).alias(f"{c}2") for c in ("id", "f", "l", "lo")))
    near = one.join(two, [key, "b"]).where("id1 < id2 and f1 <= l2 and f2 <= l1 and b = greatest(lo1, lo2)")
    both = rows.select(F.col(key), *(F.col(c).alias(f"{c}2") for c in ("id", "f", "l")), (F.col("hi") - F.col("lo") >= most).alias("_long"))
    far = long.select(F.col(key), *(F.col(c).alias(f"{c}1") for c in ("id", "f", "l"))).join(both, key).where("id1 <> id2 and f1 <= l2 and f2 <= l1 and (not _long or id1 < id2)")
    pairs = near.select(key, "id1", "id2").unionByName(far.select(key, "id1", "id2"))
    return pairs.select(key, F.least("id1", "id2").alias("one"), F.greatest("id1", "id2").alias("two"))
