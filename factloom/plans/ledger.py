"""Queries of rules, identities and records over the model's tables, each beside SQL written apart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import identity, records, rules
from .model import Model, on_model

LEDGER = ("facts", "claims", "roster", "edges", "lineage")


def _ledger(m: Model) -> rules.Ledger:
    return rules.Ledger(m.facts, m.claims, m.roster, m.edges, m.lineage)


INVARIANTS = [
    {"id": "one-sent", "constraint": "unique", "per": "per", "applies_to": {"type": "order"}, "claim": {"predicate": "sent", "value": {"in": ["A", "N"]}}},
    {"id": "maker-or-brand", "constraint": "exclusive", "applies_to": {"type": "part"}, "set": [{"predicate": "maker_id"}, {"predicate": "brand", "value": {"glob": "*1*"}}]},
    {"id": "shipped-apart", "constraint": "temporal-no-overlap", "claim": {"predicate": "shipped"}},
    {"id": "maker-needs", "constraint": "requires", "claim": {"predicate": "segment"}, "requires": {"predicate": "nation"}},
    {"id": "few-sent", "constraint": "cardinality", "applies_to": {"type": {"in": ["order"]}}, "claim": {"predicate": "sent"}, "min": 1, "max": 3},
]


@on_model("""select 'one-sent' as rule, fact_id, string_agg(claim_id, ', ' order by claim_id) as detail from claims where predicate = 'sent' and value in ('A', 'N') group by fact_id, per having count(*) > 1
union all select 'maker-or-brand', fact_id, string_agg(claim_id, ', ' order by claim_id) from claims where fact_id like 'part-%' and (predicate = 'maker_id' or predicate = 'brand' and value like '%1%') group by fact_id having count(*) > 1
union all select 'shipped-apart', a.fact_id, least(a.claim_id, b.claim_id) || ' vs ' || greatest(a.claim_id, b.claim_id) from claims a join claims b on a.fact_id = b.fact_id and a.period = b.period and a.claim_id < b.claim_id and a.predicate = 'shipped' and b.predicate = 'shipped'
union all select distinct 'maker-needs', fact_id, 'nation' from claims c where predicate = 'segment' and not exists (select 1 from claims d where d.fact_id = c.fact_id and d.predicate = 'nation')
union all select 'few-sent', f.fact_id, cast(count(c.claim_id) as string) from facts f left join claims c on f.fact_id = c.fact_id and c.predicate = 'sent' where f.type = 'order' group by f.fact_id having count(c.claim_id) not between 1 and 3""", "facts", "claims")
def invariant_findings(m: Model):
    return rules.all_violations(INVARIANTS, _ledger(m))


DEMANDS = [
    {"id": "maker", "when": {"type": "part"}, "owes": ["maker_id", "brand"]},
    {"id": "place", "when": {"type": "customer", "claim": {"predicate": "segment", "value": {"glob": "[A-F]*"}}}, "owes": ["nation"]},
    {"id": "proof", "when": {"type": "order", "no_roster": "proof"}, "owes": ["period", "shipped"], "blockable": False},
]


@on_model("""with owed as (
  select 'maker' as rule, fact_id, unnest(['maker_id', 'brand']) as field from facts where type = 'part'
  union all select 'place', f.fact_id, 'nation' from facts f where type = 'customer' and exists (select 1 from claims c where c.fact_id = f.fact_id and c.predicate = 'segment' and c.value between 'A' and 'G' and c.value < 'G')
  union all select 'proof', f.fact_id, unnest(['period', 'shipped']) from facts f where type = 'order' and not exists (select 1 from roster r where r.fact_id = f.fact_id and r.role = 'proof'))
select o.rule, o.fact_id, o.field, case when o.field = 'period' and f.period is not null or exists (select 1 from claims c where c.fact_id = o.fact_id and c.predicate = o.field) then 'satisfied'
  when o.rule = 'maker' and o.fact_id like '%7' then 'blocked' else 'open' end as state from owed o join facts f on f.fact_id = o.fact_id""", "facts", "claims", "roster")
def demand_states(m: Model):
    stopped = m.facts.where(F.col("fact_id").endswith("7")).select("fact_id", F.explode(F.array(F.lit("maker"), F.lit("proof"))).alias("rule"))
    return rules.demands(DEMANDS, _ledger(m), stopped)


@on_model("""with s as (select rule, state, count(*) as n from (
  select case when type = 'part' then 'maker' else 'place' end as rule, case when exists (select 1 from claims c where c.fact_id = f.fact_id and c.predicate = case when type = 'part' then 'maker_id' else 'nation' end) then 'satisfied' else 'open' end as state from facts f where type in ('part', 'customer')) group by 1, 2)
select rule, cast(sum(n) as bigint) as total, cast(coalesce(sum(n) filter (where state = 'satisfied'), 0) as bigint) as satisfied, cast(coalesce(sum(n) filter (where state = 'open'), 0) as bigint) as open from s group by rule""", "facts", "claims")
def expectation_satisfaction(m: Model):
    spec = [{"id": "maker", "when": {"type": "part"}, "owes": ["maker_id"]}, {"id": "place", "when": {"type": "customer"}, "owes": ["nation"]}]
    return rules.demands(spec, _ledger(m)).groupBy("rule").agg(F.count("*").alias("total"), F.count_if(F.col("state") == "satisfied").alias("satisfied"), F.count_if(F.col("state") == "open").alias("open"))


@on_model("""select distinct f.fact_id from facts f join edges e on e.fact_id = f.fact_id join edges o on o.edge_id = e.edge_id and o.fact_id <> e.fact_id and o.fact_id like 'customer-%'
where f.type = 'part' and exists (select 1 from claims c where c.fact_id = f.fact_id and c.predicate = 'brand' and regexp_matches(c.value, '#[12]'))""", "facts", "claims", "edges")
def edge_condition(m: Model):
    return rules.facts_where({"type": "part", "edge": {"type": "purchase", "with_type": "customer"}, "claim": {"predicate": "brand", "value": {"matches": "#[12]"}}}, _ledger(m)).select("fact_id")


@on_model("select fact_id, type from facts where fact_id in ('part-3', 'part-6', 'customer-9')", "facts")
def retired_ids(m: Model):
    return rules.facts_where({"id": ["old-part-3", "part-6", "customer-9", "old-part-4"]}, _ledger(m)).select("fact_id", "type")


@on_model("""select a.fact_id, a.predicate, a.claim_id as reported, b.claim_id as confirmed from claims a join claims b on a.fact_id = b.fact_id and a.predicate = b.predicate
where a.status = 'reported' and b.status = 'confirmed' and (a.value is distinct from b.value or a.object is distinct from b.object)""", "claims")
def claim_disagreements(m: Model):
    return rules.disagreements(m.claims)


DECLARED = {"size": {"kind": "integer", "required": True}, "brand": {"kind": "pattern", "pattern": r"Brand#[1-3]\d"}, "price": {"kind": "range", "min": 0, "max": 1500}, "type": {"kind": "string"}}


@on_model("""with f as (select p_partkey as id, case when p_partkey % 5 = 0 then null else cast(p_size as string) end as size, p_brand as brand, p_retailprice as price, p_partkey % 10 = 1 as odd from part)
select id, 'size' as field, 'absent' as fault from f where size is null
union all select id, 'brand', 'kind' from f where not regexp_full_match(brand, 'Brand#[1-3][0-9]')
union all select id, 'price', 'kind' from f where price > 1500 or price < 0
union all select id, 'colour', 'undeclared' from f where odd""")
def inadmissible_fields(m: Model):
    p = m.part
    size = F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("string"))
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in (("size", size), ("brand", F.col("p_brand")), ("price", F.col("p_retailprice").cast("string")), ("colour", F.when(F.col("p_partkey") % 10 == 1, F.lit("red"))))))
    return rules.inadmissible(p.select(F.col("p_partkey").alias("id"), F.explode(pairs).alias("f")).select("id", "f.*"), DECLARED)


@on_model("""select claim_id from claims c where coalesce(sensitivity, '') <> 'private' and not exists (select 1 from evidence e join record_tiers t on t.record = e.record where e.claim_id = c.claim_id and t.tier <> 'public')""", "claims", "evidence", "record_tiers")
def public_claims(m: Model):
    return rules.visible_claims(m.claims, m.evidence, m.record_tiers, ["public"]).select("claim_id")


@on_model("""with f as (select fact_id, type from facts where coalesce(sensitivity, '') <> 'private'), v as (
  select claim_id, fact_id from claims c where coalesce(sensitivity, '') <> 'private' and not exists (select 1 from evidence e join record_tiers t on t.record = e.record where e.claim_id = c.claim_id and t.tier <> 'public'))
select f.type, count(distinct f.fact_id) as facts, count(v.claim_id) as claims from f left join v on v.fact_id = f.fact_id
where exists (select 1 from v where v.fact_id = f.fact_id) or not exists (select 1 from claims c where c.fact_id = f.fact_id) group by f.type""", "facts", "claims", "evidence", "record_tiers")
def plane_projection(m: Model):
    seen = rules.visible_claims(m.claims, m.evidence, m.record_tiers, ["public"])
    bare = m.facts.join(m.claims.select("fact_id"), "fact_id", "left_anti").select("fact_id")
    facts = m.facts.where(F.coalesce(F.col("sensitivity") != "private", F.lit(True))).join(seen.select("fact_id").unionByName(bare).distinct(), "fact_id", "left_semi")
    return facts.join(seen.select("fact_id", "claim_id"), "fact_id", "left").groupBy("type").agg(F.count_distinct("fact_id").alias("facts"), F.count("claim_id").alias("claims"))


@on_model("""with recursive d as (select n_nationkey as id, case when n_nationkey % 6 = 0 then 'secret' when n_nationkey % 5 = 0 then 'family' end as tier, case when n_nationkey % 4 <> 0 then n_nationkey - 1 end as parent from nation),
up as (select id, id as at, 0 as hops from d union all select up.id, d.parent, hops + 1 from up join d on d.id = up.at where d.parent is not null and hops < 8)
select distinct 'n' || cast(up.id as string) as record, case when t.tier is not null then t.tier else 'floor' end as tier from up join d t on t.id = up.at where t.tier is not null or t.parent is null""")
def tenancy_tiers(m: Model):
    n = m.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("record"), F.when(F.col("n_nationkey") % 6 == 0, "secret").when(F.col("n_nationkey") % 5 == 0, "family").alias("tier"), F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("n"), (F.col("n_nationkey") - 1).cast("string"))).alias("parent"))
    return rules.tiers(n, n.where("parent is not null"), "floor")


@on_model("""with recursive t(type, extends) as (values ('song', 'work'), ('work', 'thing'), ('thing', null), ('loop', 'pool'), ('pool', 'loop'), ('tune', 'mus:song'), ('mus:song', 'thing')),
c as (select type, type as ancestor, 0 as n from t union select c.type, t.extends, n + 1 from c join t on t.type = c.ancestor where t.extends is not null and n < 5 and not (c.ancestor like '%:%'))
select distinct type, ancestor from c""")
def is_a_chain(m: Model):
    pairs = [("song", "work"), ("work", "thing"), ("thing", None), ("loop", "pool"), ("pool", "loop"), ("tune", "mus:song"), ("mus:song", "thing")]
    types = m.spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("type"), F.lit(b).cast("string").alias("extends")) for a, b in pairs))).alias("p")).select("p.*")
    return rules.isa(types)


@on_model("""with moved as (select case when fact_id = 'part-2' then 'part-1' else fact_id end as fact_id, claim_id, predicate, value, case when object = 'part-2' then 'part-1' else object end as object from claims)
select fact_id, predicate, cast(sum(n) as bigint) as n from (select fact_id, predicate, value, object, case when fact_id = 'part-1' then 1 else count(*) end as n from moved group by fact_id, predicate, value, object) group by fact_id, predicate""", "claims")
def merged_claims(m: Model):
    return rules.merged(_ledger(m), "part-2", "part-1").claims.groupBy("fact_id", "predicate").agg(F.count("*").alias("n"))


@on_model("""select case when c.record = 'rec-1' and a.l_linenumber <= 3 then 'rec-new' else c.record end as record, case when c.record <> 'rec-1' then 'untouched' when a.l_linenumber <= 3 then 'rewritten' else 'divergent' end as change, count(*) as n
from lineitem a, lateral (select 'rec-' || cast(a.l_suppkey as string) as record) c group by 1, 2""")
def superseded_citations(m: Model):
    cites = m.lineitem.select(F.concat(F.lit("rec-"), F.col("l_suppkey").cast("string")).alias("record"), F.col("l_linenumber").cast("string").alias("address"))
    moves = m.spark.range(1).select(F.lit("rec-1").alias("old"), F.lit("rec-new").alias("new"))
    kept = m.spark.range(1, 4).select(F.lit("rec-1").alias("old"), F.col("id").cast("string").alias("address"))
    return rules.superseded(cites, moves, kept).groupBy("record", "change").agg(F.count("*").alias("n"))


@on_model("""with h as (select doc_id, lang || '-' || replace(source, '_', '-') as fact_id, lang, source from documents where lang is not null and lang <> 'en' and source is not null)
select fact_id, predicate, value, count(distinct doc_id) as evidence from (select doc_id, fact_id, unnest(['lang', 'source']) as predicate, unnest([lang, source]) as value from h) group by 1, 2, 3""")
def harvested_claims(m: Model):
    docs = m.documents.select(F.col("doc_id").cast("string").alias("record_id"), "lang", "source")
    spec = [{"match": {"lang": {"exists": True}, "none_of": {"lang": "en"}}, "type": "tongue"}]
    fields = {"lang": (F.col("lang"), False)}
    _, _, claims = rules.harvested(docs, spec, fields, text.slug(F.concat_ws(" ", F.nullif("lang", F.lit("")), "source")), {"lang": F.col("lang"), "source": F.col("source")})
    return claims.where(F.col("fact_id").contains("-")).select("fact_id", "predicate", "value", F.size("evidence").cast("long").alias("evidence"))


# --- identities -------------------------------------------------------------------------


@on_model("""select key, list_sort(list(distinct id)) as ids from (select id, lower(trim(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g'))) as key from (select id, name from entries union all select id, alias from entries where type = 'part' and id like '%5') where name is not null) where key <> '' group by key having count(distinct id) > 1""", "entries")
def colliding_names(m: Model):
    e = m.entries
    return identity.name_collisions(e.select("id", "name").unionByName(e.where("type = 'part' and id like '%5'").select("id", F.col("alias").alias("name"))))


@on_model("""select 'maker_id=' || lower(value) as key, cast(count(distinct fact_id) as bigint) as n from claims where predicate = 'maker_id' group by 1 having count(distinct fact_id) > 1""", "claims")
def shared_ids(m: Model):
    return identity.shared_external_ids(m.claims).select("key", F.size("ids").cast("long").alias("n"))


@on_model("""with i as (select distinct p_brand as type, p_name as id, list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')) as ts from part
  union all select distinct p_brand, p_name || ' ' || p_type, list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> '')) from part where p_partkey % 3 = 0)
select distinct a.type, a.id as short_id, b.id as long_id from i a join i b on a.type = b.type and len(a.ts) < len(b.ts) and list_has_all(b.ts, a.ts) and len(a.ts) > 0""")
def contained_identities(m: Model):
    p = m.part
    ids = p.select(F.col("p_brand").alias("type"), F.col("p_name").alias("id")).unionByName(p.where("p_partkey % 3 = 0").select("p_brand", F.concat_ws(" ", "p_name", "p_type")).toDF("type", "id")).distinct()
    return identity.contained_ids(ids).distinct()


@on_model("""with p as (select distinct lower(p_type) || case when p_size % 2 = 0 then ' finish' else '' end as predicate from part), t as (select predicate, list_distinct(list_filter(string_split_regex(predicate, '[^a-z0-9]+'), lambda x: x <> '')) as ts from p)
select case when len(a.ts) > len(b.ts) then b.predicate else a.predicate end as a, case when len(a.ts) > len(b.ts) then a.predicate else b.predicate end as b, case when len(a.ts) <> len(b.ts) then 'token-subset' else 'one-token-diff' end as basis
from t a join t b on a.predicate < b.predicate where len(a.ts) <> len(b.ts) and len(list_intersect(a.ts, b.ts)) = least(len(a.ts), len(b.ts)) or len(a.ts) = len(b.ts) and len(a.ts) >= 2 and len(list_intersect(a.ts, b.ts)) = len(a.ts) - 1""")
def predicate_similarity(m: Model):
    names = m.part.select(F.concat(F.lower("p_type"), F.when(F.col("p_size") % 2 == 0, " finish").otherwise("")).alias("predicate")).groupBy("predicate").agg(F.count("*").alias("n"))
    return identity.similar_predicates(names)


@on_model("""with q as (select id, type, merged_into, lower(trim(regexp_replace(coalesce(name, ''), '[^A-Za-z0-9]+', ' ', 'g'))) as n, lower(trim(regexp_replace(coalesce(alias, ''), '[^A-Za-z0-9]+', ' ', 'g'))) as a, replace(id, '-', ' ') as i from entries),
r as (select id, case when id = 'part-3' then 0 when n = 'part 3' then 2 when a = 'part 3' then 2 when starts_with(id, 'part-3') then 3 when contains(i, 'part 3') or contains(n, 'part 3') or contains(a, 'part 3') then 4
    when list_has_all(string_split(i || ' ' || n || ' ' || a, ' '), ['part', '3']) then 5 end as rank from q where merged_into is null
  union all select s.id, case when o.id = 'part-3' then 1 else 3 end from q o join q s on s.id = o.merged_into and s.merged_into is null where starts_with(o.id, 'part-3'))
select id, min(rank) as rank from r where rank is not null group by id order by 2, 1 limit 15""", "entries")
def resolved_entries(m: Model):
    e = m.entries.withColumn("aliases", F.when(F.col("alias").isNotNull(), F.array("alias")))
    return identity.resolved(e, "part 3").select("id", "rank")


# --- records ----------------------------------------------------------------------------


@on_model("select fact_id, uri, role from roster where regexp_extract(uri, '^corpus://([^/?#]+)', 1) not in (select record from evidence where claim_id like 'order-1#%')", "roster", "evidence")
def roster_never_cited(m: Model):
    none = m.evidence.limit(0)
    return records.never_cited(m.roster, records.cited(m.evidence.where("claim_id like 'order-1#%'"), none, none))


@on_model("select record from evidence where claim_id like '%#1' union select 'doc-' || cast(doc_id as string) from labels where quality = 0 union select regexp_extract(uri, '^corpus://([^/?#]+)', 1) from roster", "roster", "evidence")
def represented_records(m: Model):
    needs = m.labels.where("quality = 0").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("record"))
    return records.represented(records.cited(m.evidence.where("claim_id like '%#1'"), needs, needs), m.roster)


@on_model("""select coalesce(nullif(host, ''), nullif(origin_id, ''), nullif(mime, ''), '(no origin)') as "group", count(*) as total, count(l.record) as hit, cast(floor(100.0 * count(l.record) / count(*)) as bigint) as pct
from records r left join (select distinct 'doc-' || cast(doc_id as string) as record from labels) l on l.record = r.record_id group by 1""", "records")
def coverage_ladder(m: Model):
    hit = m.labels.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("record")).distinct()
    return records.coverage(m.records, hit)


@on_model("""select record_id, recipe from records cross join (values ('sha256'), ('md5'), ('simhash')) r(recipe) where not (recipe = 'md5' and record_id like 'doc-%') and not (recipe = 'sha256' and record_id like '%3')""", "records")
def recipe_worklist(m: Model):
    r = m.records.select("record_id")
    have = r.where("record_id like 'doc-%'").withColumn("recipe", F.lit("md5")).unionByName(r.where("record_id like '%3'").withColumn("recipe", F.lit("sha256")))
    return records.missing_recipes(r, ["sha256", "md5", "simhash"], have)


@on_model("""select s_suppkey as id, count(distinct l_orderkey) as n, min(l_orderkey) as first_source from supplier left join lineitem on l_suppkey = s_suppkey and l_returnflag = 'R' and l_linenumber = 7 group by 1""")
def inbound_references(m: Model):
    return records.inbound(m.lineitem.where("l_returnflag = 'R' and l_linenumber = 7").select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("target")), m.supplier.select(F.col("s_suppkey").alias("id")))


@on_model("""with o as (select event_id, user_id, value, ts from events), a as (select * from o where event_id % 4 <> 0), b as (select event_id, case when event_id % 9 = 0 then value + 1 else value end as value, case when event_id % 6 = 0 then 150 else 100 end as t from o where event_id % 10 <> 0)
select case when b.event_id is null then 'delete' when a.event_id is null then 'insert' when a.value = b.value and (b.t = 100 or a.event_id % 2 = 0) then 'keep' else 'rehash' end as action, count(*) as n from a full join b on a.event_id = b.event_id group by 1""")
def attest_actions(m: Model):
    e = m.events.select(F.lit("disk").alias("location"), F.col("event_id").cast("string").alias("relpath"), "event_id", "value")
    stored = e.where("event_id % 4 <> 0").select("location", "relpath", F.col("value").alias("size"), F.lit(100).alias("mtime"), F.when(F.col("event_id") % 2 == 0, "presented").otherwise("computed").alias("source"))
    seen = e.where("event_id % 10 <> 0").select("location", "relpath", F.when(F.col("event_id") % 9 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("size"), F.when(F.col("event_id") % 6 == 0, 150).otherwise(100).alias("mtime"))
    return records.attested(stored, seen).groupBy("action").agg(F.count("*").alias("n"))


@on_model("""with l(location, cost, place) as (values ('F', 2, 0), ('O', 1, 1), ('P', 1, 2)), r as (select distinct o_custkey as hash, o_orderstatus as location from orders where o_totalprice > 50000)
select hash, location, cost, n from (select hash, l.location, cost, count(*) over (partition by hash) as n, row_number() over (partition by hash order by cost, place) as k from r join l on l.location = r.location) where k = 1""")
def preferred_routes(m: Model):
    places = m.spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(a).alias("location"), F.lit(b).alias("cost"), F.lit(c).alias("place")) for a, b, c in (("F", 2, 0), ("O", 1, 1), ("P", 1, 2))))).alias("p")).select("p.*")
    routes = m.orders.select(F.col("o_custkey").alias("hash"), F.col("o_orderstatus").alias("location"), (F.col("o_totalprice") > 50000).alias("current")).distinct()
    return records.best_route(routes, places)


@on_model("""with recursive s as (select p_partkey as member, cast(floor(p_partkey / 2) as bigint) as container from part where p_partkey > 1), u as (select member, container, 1 as hops from s union all select u.member, s.container, hops + 1 from u join s on s.member = u.container where hops < 4)
select member, container, min(hops) as hops from u group by 1, 2""")
def nested_containers(m: Model):
    return records.containers(m.part.where("p_partkey > 1").select(F.col("p_partkey").alias("member"), F.floor(F.col("p_partkey") / 2).alias("container")), depth=4)


@on_model("""with e as (select l_orderkey as record_id, l_linenumber as ord, case when l_partkey % 2 = 0 then 'corpus://' || cast(l_partkey * 3 as string) else 'http://x' end as uri from lineitem where l_quantity > 45)
select record_id, regexp_extract(uri, '^corpus://([^/?#]+)', 1) as target, case when ord = max(ord) over (partition by record_id) then 'warning' else 'note' end as severity from e qualify uri like 'corpus://%' and cast(regexp_extract(uri, '^corpus://([^/?#]+)', 1) as string) not in (select cast(p_partkey as string) from part)""")
def dangling_origins(m: Model):
    rows = m.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("corpus://"), (F.col("l_partkey") * 3).cast("string"))).otherwise("http://x").alias("uri"))
    return records.dangling_origins(rows, m.part.select(F.col("p_partkey").cast("string").alias("record_id")))


@on_model("""select o_orderkey, case when o_orderkey % 50 = 0 then 'undated' when year(o_orderdate) <= 1994 then strftime(o_orderdate, '%Y') when o_orderdate >= timestamp '1997-06-01' then 'current' else strftime(o_orderdate, '%Y-%m') end as bucket from orders""")
def period_split(m: Model):
    when = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate"))
    return records.split_periods(m.orders.select("o_orderkey", "o_orderdate"), when, "1997-06", [(1994, "year")]).select("o_orderkey", "bucket")


@on_model("""with r as (select o_custkey as hash, min(o_orderdate) as seen from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 3000) group by 1) select hash, seen, min(seen) over () as first_at, max(seen) over () as last_at from r""")
def reduced_window(m: Model):
    return records.new_members(m.orders.select(F.col("o_custkey").alias("hash"), F.col("o_orderdate").alias("seen")), m.customer.where("c_acctbal < 3000").select(F.col("c_custkey").alias("hash")), "seen")


@on_model("""with r as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) as g, row_number() over (partition by user_id order by ts, event_id) as k from events),
s as (select user_id, event_type, g, min(k) as k, count(*) as n from r group by 1, 2, 3)
select user_id, case when n > 1 then event_type || '_' || cast(n as string) else event_type end as touch, count(*) as times from s group by 1, 2""")
def touch_runs(m: Model):
    return records.coalesced_touches(m.events, ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id", "touch").agg(F.count("*").alias("times"))


@on_model("""with w as (select doc_id as id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as w from documents where text is not null),
q as (select item_id as query, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) as t from benchmark where item_id % 20 = 0),
p as (select id, len as len, t, count(*) as tf from (select id, len(w) as len, unnest(w) as t from w) where t in (select t from q) group by 1, 2, 3),
n as (select count(*) as n_docs, avg(len(w)) as mean from w), d as (select t, count(*) as df from p group by 1),
s as (select query, id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * p.len / mean))), 6) as score from p join d using (t) join q using (t) cross join n group by 1, 2)
select query, rank, round(score, 3) as score from (select query, score, cast(row_number() over (partition by query order by score desc, id) as integer) as rank from s) where rank <= 10""")
def bm25_search(m: Model):
    return records.bm25(m.documents, "doc_id", F.col("text"), m.benchmark.where("item_id % 20 = 0"), "text", 10).join(m.benchmark.select(F.col("item_id"), F.col("text").alias("query")), "query").select(F.col("item_id").alias("query"), "rank", F.round("score", 3).alias("score"))


@on_model("""with m as (select event_id, event_type = 'click' as same_body, event_id % 3 = 0 as same, list_filter([case when event_id % 2 = 0 then 'Date' end, case when event_id % 5 = 0 then 'X-Id' end, case when event_id % 7 = 0 then 'Received' end], lambda x: x is not null) as churn from events),
k as (select * from (values (0, []::varchar[], ''), (1, ['Date'], 'Date'), (2, ['Date', 'X-Id'], 'Date,X-Id'), (3, ['Date', 'X-Id', 'Received'], 'Date,X-Id,Received')) v(k, l, names))
select k, names, count(*) filter (where same_body and not same and list_has_all(l, churn)) as reconciled, round((count(*) filter (where same) + count(*) filter (where same_body and not same and list_has_all(l, churn))) / count(*), 4) as share, false as enough from m, k group by k, names, l""")
def export_verdicts(m: Model):
    names = F.array(*(F.when(F.col("event_id") % d == 0, F.lit(n)) for n, d in (("Date", 2), ("X-Id", 5), ("Received", 7))))
    pairs = m.events.select("event_id", (F.col("event_type") == "click").alias("same_body"), (F.col("event_id") % 3 == 0).alias("same"), F.filter(names, lambda x: x.isNotNull()).alias("churn"))
    return records.export_verdict(pairs)


@on_model("""select conv_id, count(*) as n, cast(sum(case when role is distinct from before or k = 1 then 1 else 0 end) as bigint) as runs from (select *, lag(role) over (partition by conv_id order by turn, text) as before, row_number() over (partition by conv_id order by turn, text) as k from conversations) group by 1""")
def collapsed_turns(m: Model):
    runs = records.collapsed(m.conversations, ["conv_id"], ["turn", "text"], "role", "text")
    return runs.groupBy("conv_id").agg(F.sum("n").alias("n"), F.count("*").alias("runs"))


@on_model("select page_id, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1)) as href from pages) where href not like '#%' and href <> '' and not regexp_matches(href, '(?i)^(javascript|mailto|tel|data):') group by 1")
def crawlable_links(m: Model):
    links = m.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.where(text.crawlable(F.col("href"))).groupBy("page_id").agg(F.count("*").alias("n"))


@on_model("""with e as (select *, length(text) as n from documents), s as (select doc_id, lang, source, n, text, case when n >= 64 then md5(substr(text, 1, 64)) end as k from e)
select a.doc_id as one, b.doc_id as two from s a join s b on a.k = b.k and a.source = b.source and a.lang is not distinct from b.lang and a.lang is not null and (strlen(a.text) < strlen(b.text) or strlen(a.text) = strlen(b.text) and 'd' || cast(a.doc_id as string) < 'd' || cast(b.doc_id as string)) and starts_with(b.text, a.text)""")
def prefix_duplicates(m: Model):
    rows = m.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("record_id"), F.col("text").alias("content"), F.col("lang").alias("mime"), F.col("source").alias("filename"))
    out = records.prefix_duplicates(rows)
    return out.select(*(F.substring(c, 2, 30).cast("long").alias(c) for c in ("one", "two")))


@on_model("""select page_id, case when contains(url, '://') then lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') end as key from pages""")
def identity_keys(m: Model):
    return m.pages.select("page_id", text.identity_key(F.col("url"), drop_query=True, rules=[(r"://www\.", "://"), (r"#.*$", "")]).alias("key"))


@on_model("""with n as (select p_partkey, case when p_partkey % 4 = 0 then cast(p_size as string) when p_partkey % 4 = 1 then strftime(date '2020-01-01' + cast(p_size as integer), '%Y-%m-%d') when p_partkey % 4 = 2 then p_brand end as v from part)
select p_partkey, row_number() over (order by case when v is null then 3 when p_partkey % 4 = 1 then 0 when p_partkey % 4 = 0 then 1 else 2 end, case when p_partkey % 4 = 1 then v end, case when p_partkey % 4 = 0 then cast(v as double) end, v, p_partkey) as place from n order by 2 limit 100""")
def mixed_type_sort(m: Model):
    k = F.col("p_partkey") % 4
    v = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size").cast("int")), "yyyy-MM-dd")).when(k == 2, F.col("p_brand"))
    top = m.part.select("p_partkey", v.alias("v")).orderBy(*records.mixed_order(F.col("v")), "p_partkey").limit(100)
    return top.select("p_partkey", F.row_number().over(Window.orderBy(*records.mixed_order(F.col("v")), "p_partkey")).alias("place"))  # of the 100 kept


@on_model("""with a as (select event_id, json_keys(props) as k, props from events where props is not null and event_id % 2 = 0) select event_id, list_sort(k) as paths from a""")
def json_leaf_paths(m: Model):
    return m.events.where("props is not null and event_id % 2 = 0").select("event_id", F.map_keys(records.json_leaves(F.col("props"))).alias("paths"))
