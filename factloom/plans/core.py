"""Queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import predicates, relations
from ..streaming import jobs
from .registry import Tables, query, same_sql

cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
CENTS = "cast(sum(cast(round({c} * 100) as bigint)) as bigint)"

# --- aggregation -----------------------------------------------------------


@query(f"""select l_returnflag, l_linestatus, {CENTS.format(c='l_quantity')} as quantity, {CENTS.format(c='l_extendedprice')} as price, count(*) as n, count(distinct l_suppkey) as suppliers
from lineitem where l_shipdate <= timestamp '1998-09-02' group by rollup (l_returnflag, l_linestatus)""")
def pricing_rollup(t: Tables):
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    # rows collapse by supplier first, so the levels of the rollup copy few of them
    each = rows.groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(cents("l_quantity").alias("q"), cents("l_extendedprice").alias("p"), F.count("*").alias("c"))
    return each.rollup("l_returnflag", "l_linestatus").agg(F.sum("q").alias("quantity"), F.sum("p").alias("price"), F.sum("c").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


same_sql("records_by_kind", "select lang, source, count(*) as n from {documents} group by grouping sets ((lang), (source), (lang, source), ())", "documents")
same_sql("event_cube", "select event_type, user_id % 10 as shard, count(*) as n from {events} group by cube (event_type, user_id % 10)", "events")


@query("select lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) as host, count(*) as n from pages group by 1")
def host_counts(t: Tables):
    return t.pages.groupBy(text.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("""select source, count(*) as total, count(l.doc_id) as hit, count(*) filter (where lang = 'en') as english, count(*) filter (where text is null or length(text) < 300) as short,
  cast(floor(100.0 * count(l.doc_id) / count(*)) as bigint) as pct from documents d left join (select distinct doc_id from labels) l on d.doc_id = l.doc_id group by source""")
def coverage_by_group(t: Tables):
    marks = t.labels.select("doc_id").distinct().withColumn("marked", F.lit(1))
    rows = t.documents.join(marks, "doc_id", "left").groupBy("source")
    return rows.agg(F.count("*").alias("total"), F.count("marked").alias("hit"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("text").isNull() | (F.char_length("text") < 300)).alias("short"), F.floor(F.lit(100) * F.count("marked") / F.count("*")).alias("pct"))


@query("select md5(text) as digest, count(*) as n, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1")
def canonical_duplicates(t: Tables):
    return t.documents.where("text is not null").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("""select name, count(*) as n, min(p_partkey) as first_id from (
  select p_partkey, array_to_string(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), ' ') as name from part) group by 1 having count(*) > 1""")
def name_collisions(t: Tables):
    return t.part.groupBy(text.normalized(F.col("p_name")).alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id")).where("n > 1")


same_sql("vocabulary", """select 'event_type' as section, event_type as term, count(*) as n from {events} group by event_type
union all select 'segment', c_mktsegment, count(*) from {customer} group by c_mktsegment
union all select 'brand', p_brand, count(*) from {part} group by p_brand
union all select 'priority', o_orderpriority, count(*) from {orders} group by o_orderpriority
union all select 'role', role, count(*) from {conversations} group by role""", "events", "customer", "part", "orders", "conversations")


@query("""select l_orderkey as claim, bool_or(l_returnflag = 'A' and l_linestatus <> 'O') as authoritative, count(distinct case when l_linestatus <> 'O' then l_suppkey end) as sources,
  bool_or(l_returnflag = 'A' and l_linestatus <> 'O') or count(distinct case when l_linestatus <> 'O' then l_suppkey end) >= 2 as confirmed from lineitem group by 1""")
def authentication_bar(t: Tables):
    return relations.confirmed(t.lineitem, "l_orderkey", "l_suppkey", F.col("l_returnflag") == "A", F.col("l_linestatus") == "O").withColumnRenamed("l_orderkey", "claim")



# --- periods -----------------------------------------------------------------



@query("""select a.o_custkey as fact, a.o_orderkey as one, b.o_orderkey as two from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey
  and cast(a.o_orderdate as date) <= cast(b.o_orderdate as date) + 7 and cast(b.o_orderdate as date) <= cast(a.o_orderdate as date) + 7""")
def period_overlaps(t: Tables):
    day = F.to_date("o_orderdate")
    rows = t.orders.select("o_custkey", "o_orderkey", day.alias("first"), F.date_add(day, 7).alias("last"))
    return relations.bucketed_overlaps(rows, "o_custkey", "o_orderkey", "first", "last", days=31).withColumnRenamed("o_custkey", "fact")


# --- filters -------------------------------------------------------------------

SPEC = {"any_of": [{"segment": {"in": ["BUILDING", "MACHINERY"]}}, {"name": {"matches": "0{3}1[0-9]$"}}], "none_of": [{"name": {"glob": "*7"}}], "nation": {"exists": True}}


@query("""select c_custkey, c_name, c_mktsegment from customer where (coalesce(c_mktsegment in ('BUILDING', 'MACHINERY'), false) or coalesce(regexp_matches(c_name, '0{3}1[0-9]$'), false))
  and not coalesce(c_name like '%7', false) and c_nationkey is not null""")
def predicate_grammar(t: Tables):
    fields = {"segment": (F.col("c_mktsegment"), False), "name": (F.col("c_name"), False), "nation": (F.col("c_nationkey"), False)}
    return t.customer.where(predicates.compile_predicate(SPEC, fields)).select("c_custkey", "c_name", "c_mktsegment")


same_sql("find_records", "select doc_id, lang, source from {documents} d where lang = 'de' and source like '%1%' and not exists (select 1 from {labels} l where l.doc_id = d.doc_id)", "documents", "labels")

# --- joins ----------------------------------------------------------------------


@query("""with refs as (select distinct l_partkey as id from lineitem), live as (select p_partkey as id from part where p_partkey % 10 <> 0),
  hop as (select p_partkey as old_id, p_partkey + 1 as to_id from part where p_partkey % 10 = 0)
  select refs.id, coalesce(live.id, t.id) as resolved from refs left join live on refs.id = live.id left join hop on refs.id = hop.old_id left join live t on hop.to_id = t.id""")
def lineage_resolution(t: Tables):
    live = t.part.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("id"))
    hop = t.part.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("old_id"), (F.col("p_partkey") + 1).alias("to_id"))
    return relations.resolve(t.lineitem.select(F.col("l_partkey").alias("id")).distinct(), live, hop)


@query("""select regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') || regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1) as key, max(page_id) as record, count(*) as n from pages group by 1""")
def uri_index(t: Tables):
    key = F.concat(text.apex(F.col("url")), F.regexp_extract("url", r"^[^/]*//[^/?#]*([^?#]*)", 1))
    return t.pages.groupBy(key.alias("key")).agg(F.max("page_id").alias("record"), F.count("*").alias("n"))


same_sql("evidence_chain", """select n_name, r_name, count(*) as claims, count(distinct l_suppkey) as sources from {lineitem} join {supplier} on l_suppkey = s_suppkey
join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey group by n_name, r_name""", "lineitem", "supplier", "nation", "region")


@query("""select doc_id, recipe from documents, (values ('simhash'), ('sha256'), ('md5')) r(recipe) where not exists (
  select 1 from labels l where l.doc_id = documents.doc_id and (recipe = 'sha256' or recipe = 'md5' and quality = 1))""")
def backfill_worklist(t: Tables):
    wanted = t.documents.select("doc_id", F.explode(F.array(F.lit("simhash"), F.lit("sha256"), F.lit("md5"))).alias("recipe"))
    present = t.labels.select("doc_id", F.explode(F.when(F.col("quality") == 1, F.array(F.lit("sha256"), F.lit("md5"))).otherwise(F.array(F.lit("sha256")))).alias("recipe"))
    return wanted.join(present, ["doc_id", "recipe"], "left_anti")


@query("""with recursive edges as (select 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem union select 'p' || l_partkey, 's' || l_suppkey from lineitem),
  walk(id, depth) as (select 's1', 0 union select dst, depth + 1 from walk join edges on id = src where depth < 6) select id, min(depth) as depth from walk group by id""")
def scope_closure(t: Tables):
    rows = t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("s"), F.concat(F.lit("p"), "l_partkey").alias("p"))
    edges = rows.toDF("src", "dst").unionByName(rows.select(F.col("p").alias("src"), F.col("s").alias("dst"))).distinct()
    return relations.closure(edges, t.spark.range(1).select(F.lit("s1").alias("id")))


@query("""select event_id, user_id, (select max_by(c.event_id, (c.ts, c.event_id)) from events c where c.user_id = e.user_id and c.event_type = 'purchase' and c.ts <= e.ts) as as_of from events e where event_type = 'click'""")
def as_of_pin(t: Tables):
    marks = t.events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("pin"))
    marks = marks.groupBy("user_id", "ts").agg(F.max("pin").alias("pin"))
    return relations.as_of(t.events.where("event_type = 'click'").select("event_id", "user_id", "ts"), marks, ["user_id"], "ts", "ts", "pin").select("event_id", "user_id", "as_of")


@query("select doc_id, sources from (select doc_id, text, count(distinct source) over (partition by text) as sources from documents where text is not null) x where sources > 1")
def shadowed_copies(t: Tables):
    rows = t.documents.where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    copies = rows.groupBy("digest").agg(F.count_distinct("source").alias("sources")).where("sources > 1")
    return rows.join(copies, "digest").select("doc_id", "sources")


@query("""with a as (select md5(text) as key, min(lang) as s from documents where source = 'src0' and text is not null group by 1), b as (select md5(text) as key, min(lang) as s from documents where source = 'src1' and text is not null group by 1)
  select change, count(*) as n from (select case when b.key is null then 'only_a' when a.key is null then 'only_b' when a.s is not distinct from b.s then 'identical' else 'changed' end as change from a full join b on a.key = b.key) group by 1""")
def export_diff(t: Tables):
    side = lambda s: t.documents.where((F.col("source") == s) & F.col("text").isNotNull()).groupBy(F.md5("text").alias("k")).agg(F.min("lang").alias("lang"))
    return relations.diff(side("src0"), side("src1"), "k", F.col("lang")).groupBy("change").agg(F.count("*").alias("n"))


same_sql("worklist", """select 'order' as kind, o_orderkey as dependent from {orders} where o_custkey = 7 union all select 'line', l_orderkey * 10 + l_linenumber from {lineitem} join {orders} on l_orderkey = o_orderkey where o_custkey = 7""", "orders", "lineitem")
same_sql("neighbors", """select distinct c.c_custkey as id, s.s_suppkey as neighbor from {orders} join {customer} c on o_custkey = c.c_custkey join {lineitem} on l_orderkey = o_orderkey join {supplier} s on l_suppkey = s.s_suppkey and s.s_nationkey = c.c_nationkey""", "orders", "customer", "lineitem", "supplier")

# --- windows ----------------------------------------------------------------------


@query("""with marked as (select *, case when role is distinct from lag(role) over w or row_number() over w = 1 then 1 else 0 end as c from conversations window w as (partition by conv_id order by turn)),
  runs as (select *, sum(c) over (partition by conv_id order by turn) as island from marked)
  select conv_id, cast(island as bigint) as island, role, count(*) as n, min(turn) as first_turn, max(turn) as last_turn from runs group by conv_id, island, role""")
def speaker_runs(t: Tables):
    return relations.islands(t.conversations, ["conv_id"], ["turn"], "role").groupBy("conv_id", "island", "role").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


same_sql("next_start", "select event_id, user_id, ts as start_at, lead(ts) over (partition by user_id order by ts, event_id) as end_at from {events}", "events")
same_sql("latest_row", "select user_id, event_type, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from {events}) q where r = 1", "events")
same_sql("layer_precedence", "select d.doc_id, coalesce(case when quality = 1 then 'override' end, case when lang = 'en' then 'origin' end, 'artifact') as layer from {documents} d left join (select doc_id, max(quality) as quality from {labels} group by doc_id) l on d.doc_id = l.doc_id", "documents", "labels")
same_sql("window_bounds", "select user_id, min(ts) as first_at, max(ts) as last_at, count(*) as n from {events} where event_type <> 'error' group by user_id", "events")
same_sql("running_share", "select o_orderkey, o_custkey, cast(sum(1) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as bigint) as recent, ntile(4) over (partition by o_custkey order by o_totalprice, o_orderkey) as quarter, dense_rank() over (partition by o_custkey order by o_orderpriority) as step from {orders}", "orders",
    spark_sql="select o_orderkey, o_custkey, cast(sum(1) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as bigint) as recent, cast(ntile(4) over (partition by o_custkey order by o_totalprice, o_orderkey) as bigint) as quarter, cast(dense_rank() over (partition by o_custkey order by o_orderpriority) as bigint) as step from {orders}")

# --- order and sets -------------------------------------------------------------------


@query("select c_custkey, c_name from customer where c_custkey > 100 order by c_custkey limit 50")
def keyset_page(t: Tables):
    return relations.keyset_page(t.customer.select("c_custkey", "c_name"), "c_custkey", 100, 50)


same_sql("top_signals", "select p_brand, p_type, count(*) as n from {part} group by p_brand, p_type order by n desc, p_brand, p_type limit 20", "part")
same_sql("citation_union", "select l_suppkey as id from {lineitem} where l_returnflag = 'R' union select s_suppkey from {supplier} where s_acctbal > 0 union select l_suppkey from {lineitem} where l_quantity > 49", "lineitem", "supplier")
same_sql("hash_sets", """select 'both' as part, count(*) as n from (select o_custkey from {orders} where o_orderstatus = 'F' intersect select o_custkey from {orders} where o_orderstatus = 'O') x
union all select 'only_f', count(*) from (select o_custkey from {orders} where o_orderstatus = 'F' except select o_custkey from {orders} where o_orderstatus = 'O') y""", "orders")


# --- scalars --------------------------------------------------------------------------


@query("""select p_partkey, array_to_string(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''), '-') as slug, cast(ceil(length(p_name) / 4.0) as bigint) as tokens, md5(p_name) as md5, sha256(p_name) as sha from part""")
def text_scalars(t: Tables):
    name = F.col("p_name")
    return t.part.select("p_partkey", text.slug(name).alias("slug"), text.token_estimate(name).alias("tokens"), F.md5("p_name").alias("md5"), F.sha2("p_name", 256).alias("sha"))


@query("""select page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[^/]*//([^/?#]*)', 1)) || regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1) ||
  case when regexp_extract(url, '\\?([^#]*)', 1) <> '' then '?' || array_to_string(list_sort(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')), '&') else '' end as url from pages""")
def url_identity(t: Tables):
    return t.pages.select("page_id", text.normalized_url(F.col("url")).alias("url"))


@query("""select o_orderkey, make_date(cast(year(o_orderdate) as bigint), cast(month(o_orderdate) as bigint), 1) as first, last_day(cast(o_orderdate as date)) as last,
  case when year(o_orderdate) <= 1994 then strftime(o_orderdate, '%Y') else strftime(o_orderdate, '%Y-%m') end as bucket from orders""")
def period_intervals(t: Tables):
    p = dates.period_interval(F.date_format("o_orderdate", "yyyy-MM"))
    return t.orders.select("o_orderkey", p["first"].alias("first"), p["last"].alias("last"), dates.grain_bucket(F.col("o_orderdate"), [(1994, "year")], "month").alias("bucket"))


@query("select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)")
def quote_check(t: Tables):
    return relations.contained_quotes(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")


@query("select event_id, json_keys(props) as keys, cast(len(json_keys(props)) as integer) as n from events where props is not null")
def json_shape(t: Tables):
    keys = F.json_object_keys("props")
    return t.events.where("props is not null").select("event_id", keys.alias("keys"), F.size(keys).alias("n"))


# --- streams and lifecycle, in batch form ---------------------------------------------------


@query("select user_id as record_id, max_by(event_type, (ts, event_type)) as state, max(ts) as at, count(*) as changes from events group by user_id")
def queue_states(t: Tables):
    return jobs.queue_state(t.events.select(F.col("user_id").alias("record_id"), F.col("ts").alias("at"), F.col("event_type").alias("state")))


@query("""with a as (select event_id as key, value as s from events where event_id % 5 <> 0), b as (select event_id as key, case when event_id % 7 = 0 then value + 1 else value end as s from events where event_id % 11 <> 0)
  select case when b.key is null then 'only_a' when a.key is null then 'only_b' when a.s is not distinct from b.s then 'identical' else 'changed' end as change, count(*) as n from a full join b on a.key = b.key group by 1""")
def incremental_attest(t: Tables):
    before = t.events.where("event_id % 5 <> 0").select("event_id", "value")
    after = t.events.where("event_id % 11 <> 0").select("event_id", F.when(F.col("event_id") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    return relations.diff(before, after, "event_id", F.col("value")).groupBy("change").agg(F.count("*").alias("n"))


@query("""select case when ts is null then 'undated' when ts >= timestamp '2024-01-20' then 'current' else strftime(ts, '%Y-%m-%d') end as period, event_type, count(*) as n from events group by 1, 2""")
def tumbling_periods(t: Tables):
    period = F.when(F.col("ts").isNull(), "undated").when(F.col("ts") >= F.lit("2024-01-20").cast("timestamp"), "current").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return t.events.groupBy(period.alias("period"), "event_type").agg(F.count("*").alias("n"))


same_sql("exclusion_window", "select event_id, user_id from {events} e where ts >= timestamp '2024-01-10' and not exists (select 1 from {events} p where p.user_id = e.user_id and p.event_type = e.event_type and p.ts < timestamp '2024-01-10' and p.value > e.value)", "events")
