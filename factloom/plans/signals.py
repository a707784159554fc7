"""Queries of health signals, derived views and capture scalars, each beside SQL written apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import captures
from ..operators import signals
from .registry import Tables, query


@query("""select count(*) filter (where e = 'view') as formed, count(*) filter (where e = 'click') as terminal, count(*) filter (where e = 'purchase' and even) as rendered,
  count(*) filter (where e = 'purchase' and not even) as extraction, count(*) filter (where e not in ('view', 'click', 'purchase')) as proxy, count(*) filter (where titled) as titled, count(*) filter (where not titled) as untitled
from (select event_type as e, event_id % 2 = 0 as even, event_id % 5 > 1 as titled from events)""")
def layer_presence(t: Tables):
    state = F.when(F.col("event_type") == "view", "formed").when(F.col("event_type") == "click", "terminal").when(F.col("event_type") == "purchase", "rendered").when(F.col("event_type") == "error", "unread")
    title = F.when(F.col("event_id") % 5 > 1, F.col("event_type")).when(F.col("event_id") % 5 == 1, "")
    return signals.layer_census(t.events.select(state.alias("state"), (F.col("event_id") % 2 == 0).alias("document_shaped"), title.alias("title")))


@query("""select severity, event_id as record_id, place from (select coalesce(severity, 'unknown') as severity, event_id, row_number() over (partition by severity order by event_id) as place
from (select event_id, case event_type when 'error' then 'blocking' when 'click' then 'warning' when 'view' then 'info' end as severity from events)) where place <= 50""")
def attestations_by_severity(t: Tables):
    level = F.when(F.col("event_type") == "error", "blocking").when(F.col("event_type") == "click", "warning").when(F.col("event_type") == "view", "info")
    return signals.by_severity(t.events.select(F.col("event_id").alias("record_id"), level.alias("severity")), "record_id")


@query("""select doc_id, body_chars, pages, round(body_chars / pages, 1) as density from (select doc_id, coalesce(length(text), 0) as body_chars, doc_id % 9 as pages from documents) where pages > 3 and body_chars < pages * 300""")
def sparse_bodies(t: Tables):
    docs = t.documents.select("doc_id", "text", (F.col("doc_id") % 9).alias("pages"))
    return signals.sparse_bodies(docs, F.col("text"), F.col("pages")).select("doc_id", "body_chars", "pages", "density")


@query("""select l_partkey as member, count(distinct l_suppkey) as placed_by from lineitem where l_partkey in (select p_partkey from part where p_size <= 20) group by 1""")
def normalization_pressure(t: Tables):
    return signals.pressure(t.lineitem.select(F.col("l_suppkey").alias("record"), F.col("l_partkey").alias("member")), t.part.where("p_size <= 20").select(F.col("p_partkey").alias("member")))


@query("""with used as (select event_type as type, case event_id % 3 when 0 then 'amount' when 1 then 'place' else 'time' end as field from events),
declared as (select unnest(['view', 'click', 'signup', 'purchase']) as type, unnest(['amount', 'time', 'colour', 'place']) as field)
select d.type, d.field, count(u.type) as uses from declared d left join used u on u.type = d.type and u.field = d.field group by 1, 2
union all select type, null, count(*) from used where type not in (select type from declared) group by 1""")
def schema_usage(t: Tables):
    used = t.events.select(F.col("event_type").alias("type"), F.when(F.col("event_id") % 3 == 0, "amount").when(F.col("event_id") % 3 == 1, "place").otherwise("time").alias("field"))
    pairs = [("view", "amount"), ("click", "time"), ("signup", "colour"), ("purchase", "place")]
    declared = t.spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("type"), F.lit(b).alias("field")) for a, b in pairs))))
    return signals.schema_usage(declared, used)


@query("""with held as (select l_orderkey as o, string_agg(cast(l_linenumber % 2 as varchar), chr(10) order by cast(l_linenumber % 2 as varchar)) as h from lineitem group by 1)
select sha256(o_orderpriority || cast(o_custkey % 10 as varchar) || chr(10) || coalesce(h, '')) as key, min(o_orderkey) as first_id, count(*) as n from orders left join held on o = o_orderkey group by 1 having count(*) > 1""")
def content_key_duplicates(t: Tables):
    records = t.orders.select(F.col("o_orderkey").alias("record_id"), F.concat("o_orderpriority", (F.col("o_custkey") % 10).cast("string")).alias("canonical"))
    return signals.content_duplicates(records, t.lineitem.select(F.col("l_orderkey").alias("record_id"), (F.col("l_linenumber") % 2).cast("string").alias("transport")))


@query("""with a as (select p_partkey as id, 0 as tier, p_retailprice as rank from part where p_name like '%1%' order by rank, id limit 15), b as (select p_partkey as id, 1 as tier, p_retailprice as rank from part order by rank, id limit 40)
select id, tier, rank from (select * from a union all select * from b where id not in (select id from a)) order by tier, rank, id limit 30""")
def blended_hits(t: Tables):
    hits = t.part.select(F.col("p_partkey").alias("id"), "p_name", F.col("p_retailprice").alias("rank"))
    first = hits.where(F.contains("p_name", F.lit("1"))).orderBy("rank", "id").limit(15)
    return signals.blended(first.drop("p_name"), hits.orderBy("rank", "id").limit(40).drop("p_name"), "id", "rank", 30).select("id", "tier", "rank")


@query("""select source, min(doc_id) as doc_id, lower(lang) as lang from documents where lang is not null and source is not null group by source, lower(lang)""")
def distinct_uris(t: Tables):
    rows = t.documents.where("lang is not null and source is not null").select("source", "doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.lower("lang")).alias("lang"))
    return signals.distinct_by_key(rows, "source", F.lower("lang"), F.col("doc_id")).select("source", "doc_id", F.lower("lang").alias("lang"))


@query("""select c_custkey, 'mime/' || lower(c_mktsegment) || case when c_custkey % 3 <> 0 then '|origin/' || cast(c_nationkey as varchar) else '' end || '|form/a' || case when c_custkey % 2 = 0 then '|form/b' else '' end as classes from customer""")
def classifications(t: Tables):
    mime = F.array(F.concat(F.lit("mime/"), F.lower("c_mktsegment")))
    origin = F.when(F.col("c_custkey") % 3 != 0, F.array(F.concat(F.lit("origin/"), F.col("c_nationkey").cast("string"))))
    forms = F.array(F.lit("form/a"), F.when(F.col("c_custkey") % 2 == 0, "form/b"), F.lit("form/a"))
    return t.customer.select("c_custkey", F.array_join(signals.ordered_union(mime, origin, forms), "|").alias("classes"))


@query("""select l_orderkey as record_id, max_by(l_returnflag, l_linenumber * 256 + ascii(l_returnflag)) as title from lineitem where l_linestatus = 'F' and l_returnflag <> 'N' group by 1""")
def latest_qualified_origin(t: Tables):
    origins = t.lineitem.select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("block_index"), F.when(F.col("l_linestatus") == "F", F.lit("site")).alias("overlay_id"), F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")).alias("title"))
    return signals.latest_qualified(origins, "title")


@query("""select o_orderkey as record_id, strftime(o_orderdate, '%Y-%m-%d') as at, 'origin.snapshot' as source from orders where o_orderkey % 4 <> 0
union all select l_orderkey, strftime(l_shipdate, '%Y-%m-%d'), 'shipped' from lineitem where l_linenumber > 1""")
def record_timeline(t: Tables):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    snapshots = t.orders.select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderkey") % 4 != 0, day("o_orderdate")).alias("snapshot"))
    fields = t.lineitem.select(F.col("l_orderkey").alias("record_id"), F.lit("shipped").alias("field"), F.when(F.col("l_linenumber") > 1, day("l_shipdate")).otherwise("").alias("value"))
    return signals.timeline(snapshots, fields)


@query("""with c as (select n_nationkey as nation, p_brand as brand, count(*) as n from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by 1, 2),
r as (select *, row_number() over (partition by nation order by n desc, brand) as place from c)
select a.nation, cast(a.place as integer) as size, string_agg(b.brand, ',' order by b.place) as names from r a join r b on b.nation = a.nation and b.place <= a.place where a.place <= 8 group by 1, 2""")
def ranked_prefixes(t: Tables):
    lines = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    counts = lines.groupBy(F.col("s_nationkey").alias("nation"), F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))
    return signals.ranked_prefixes(counts, "nation", "brand", "n").select("nation", "size", F.array_join("names", ",").alias("names"))


@query("""with e as (select l_orderkey as claim_id, case when l_linenumber <= 2 then l_linenumber - 1 end as element from lineitem)
select o_orderkey as claim_id, i as element, case i when 0 then o_orderstatus else o_orderpriority end as entry, (select count(*) from e where e.claim_id = o_orderkey and coalesce(e.element, i) = i) as evidence from orders, (select unnest([0, 1]) as i)""")
def bound_elements(t: Tables):
    claims = t.orders.select(F.col("o_orderkey").alias("claim_id"), F.array("o_orderstatus", "o_orderpriority").alias("value"))
    return signals.bound_elements(claims, t.lineitem.select(F.col("l_orderkey").alias("claim_id"), F.when(F.col("l_linenumber") <= 2, F.col("l_linenumber") - 1).alias("element")))


@query("""select c_custkey, sha256('{"object":"nation-' || cast(c_nationkey as varchar) || '","predicate":"nation"' || case when c_custkey % 2 = 0 then ',"value":"' || c_mktsegment || '"' else '' end || '}') as state from customer""")
def claim_states(t: Tables):
    fields = {"predicate": F.lit("nation"), "status": F.when(F.col("c_acctbal") > 0, "confirmed"), "object": F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")), "value": F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))}
    return t.customer.select("c_custkey", signals.claim_state(fields).alias("state"))


@query("""select page_id, url, host like 'vm.%' or host in ('bit.ly', 'go.bit.ly') or not contains(trim(path, '/'), '/') and not contains(path, '.') and length(trim(path, '/')) between 1 and 16 as short
from (select page_id, url, regexp_extract(url, '://([^/?#:]*)', 1) as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path
  from (select page_id, case page_id % 5 when 0 then 'https://vm.example.com/a/b' when 1 then 'http://bit.ly/' || page_id when 2 then 'https://go.bit.ly/x/y/' || page_id when 3 then 'https://host.example/' || md5(url)[1:(page_id % 20) + 1] else url end as url from pages))""")
def short_links(t: Tables):
    n = F.col("page_id") % 5
    page = F.col("page_id").cast("string")
    own = F.expr("substring(md5(url), 1, cast(page_id % 20 + 1 as int))")
    url = F.when(n == 0, "https://vm.example.com/a/b").when(n == 1, F.concat(F.lit("http://bit.ly/"), page)).when(n == 2, F.concat(F.lit("https://go.bit.ly/x/y/"), page)).when(n == 3, F.concat(F.lit("https://host.example/"), own)).otherwise(F.col("url"))
    return t.pages.select("page_id", url.alias("url")).withColumn("short", captures.short_link(F.col("url")))


@query("select doc_id, md5(text) as digest from documents where text is not null")
def repaired_texts(t: Tables):
    """Texts of even ids are read as Latin-1 first."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    text = F.when(F.col("doc_id") % 2 == 0, broken).otherwise(F.col("text"))
    return t.documents.where("text is not null").select("doc_id", F.md5(captures.repaired(text)).alias("digest"))


@query("""select doc_id, case when doc_id % 3 = 0 then 3 else 4 end as marks from documents where doc_id % 3 <> 1""")
def misread_texts(t: Tables):
    marked = F.when(F.col("doc_id") % 3 == 0, "cafÃ© Ã¨ â€™ Ã©").when(F.col("doc_id") % 3 == 1, "Ã© Ã¨ plain").otherwise("Â Ã¼ â€¦ â‚¬")
    return t.documents.select("doc_id", F.size(captures.misread_marks(marked)).alias("marks")).where("marks > 0")


@query("""select page_id, case page_id % 4 when 0 then 'loading' when 1 then 'empty-title' when 2 then 'plain-404' end as name from pages""")
def empty_titles(t: Tables):
    n = F.col("page_id") % 4
    title = F.when(n == 0, " Loading.. ").when(n == 1, " \n").when(n == 2, "404  Not Found").otherwise(F.concat(F.lit("404 of "), F.col("url")))
    return t.pages.select("page_id", captures.empty_title(title).alias("name"))


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT') || lpad(cast(o_orderkey % 24 as varchar), 2, '0') || ':' || lpad(cast(o_orderkey % 60 as varchar), 2, '0') || ':07' as sent,
  case when o_orderkey % 3 = 0 then 'on no day' else strftime(o_orderdate, '%Y-%m-%dT') || lpad(cast(o_orderkey % 24 as varchar), 2, '0') || ':' || lpad(cast(o_orderkey % 60 as varchar), 2, '0') || ':07Z' end as taken from orders""")
def export_dates(t: Tables):
    at = F.expr("date_trunc('day', o_orderdate) + make_interval(0, 0, 0, 0, cast(o_orderkey % 24 as int), cast(o_orderkey % 60 as int), 7)")
    line = F.concat(F.lit("From a@b.example "), F.date_format(at, "EEE MMM d HH:mm:ss yyyy"))
    told = F.when(F.col("o_orderkey") % 3 == 0, "on no day").otherwise(F.concat(F.date_format(at, "EEEE, MMMM d, yyyy"), F.lit(" at "), F.date_format(at, "h:mm:ss"), F.lit(" "), F.date_format(at, "a"), F.lit(" UTC")))
    return t.orders.select("o_orderkey", captures.separator_date(line).alias("sent"), captures.long_form_timestamp(told).alias("taken"))


@query("select page_id, sha256(html) as digest from pages where html is not null")
def stampfree_digests(t: Tables):
    """Pages with stamps before and behind them have the digests of the pages alone."""
    stamped = F.concat(F.lit('<meta name="corpus-url" content="http://a/">'), F.col("html"), F.lit('<META name="corpus-at"\n content="" />'))
    return t.pages.where("html is not null").select("page_id", captures.stampfree_digest(stamped).alias("digest"))


@query("""with s as (select o_custkey as video, o_orderkey as starts, o_orderkey + o_orderkey % 4 as ends from orders)
select video, case when count(*) <= 1 then 'no-boundaries' when count(*) >= 8 and median(ends - starts) < 2 then 'over-segmented' end as signal from s group by 1""")
def cut_signals(t: Tables):
    spans = t.orders.groupBy(F.col("o_custkey").alias("video")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_orderkey") % 4).alias("end"))).alias("spans"))
    return spans.select("video", captures.cut_signal(F.col("spans"), most=8).alias("signal"))
