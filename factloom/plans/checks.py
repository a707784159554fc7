"""Queries of a ledger check's findings, each beside SQL written apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings
from .registry import Tables, query


@query("""with c as (select c_custkey as k, case when c_custkey % 7 = 0 then 'C-' else 'c-' end || c_custkey as place from customer)
select 'id-stem' as rule, 'err' as severity, place from c where k % 10 = 0 or k % 7 = 0
union all select 'id-slug', 'err', place from c where k % 7 = 0
union all select 'type-directory', 'err', place from c where k % 9 = 0
union all select 'no-name', 'err', place from c where k % 5 < 2
union all select 'sensitivity', 'err', place from c where k % 6 = 1
union all select 'provenance', 'err', place from c where k % 8 = 3""")
def fact_findings(t: Tables):
    k = F.col("c_custkey")
    own = F.concat(F.lit("c-"), k.cast("string"))
    facts = t.customer.select(
        F.when(k % 7 == 0, F.upper(own)).otherwise(own).alias("id"), F.when(k % 10 == 0, F.lit("x")).otherwise(own).alias("stem"), F.lit("customer").alias("type"), F.when(k % 9 == 0, "client").otherwise("customer").alias("directory"),
        F.when(k % 5 == 0, "  ").when(k % 5 > 1, F.col("c_name")).alias("name"), F.when(k % 6 == 1, "public").when(k % 6 == 2, "private").alias("sensitivity"), F.when(k % 8 == 3, "hand").when(k % 8 == 4, "auto").alias("provenance"),
    )
    return findings.row_findings(facts, F.col("id"), findings.fact_rules())


@query("""with c as (select l_orderkey as o, l_linenumber as n, l_returnflag as f, l_quantity as q, l_orderkey || '#' || l_linenumber as place from lineitem)
select 'no-predicate' as rule, 'err' as severity, place from c where n = 7
union all select 'bad-status', 'err', place from c where f = 'N' and n = 6
union all select 'presence-value', 'err', place from c where q = 3
union all select 'presence-alone', 'err', place from c where q in (3, 4) and n <> 5
union all select 'no-voice', 'err', place from c where f = 'A' and o % 3 <> 0
union all select 'provenance', 'err', place from c where q = 10
union all select 'auto-capped', 'err', place from c where q in (11, 12) and (f = 'A' or f = 'R')
union all select 'sensitivity', 'err', place from c where q = 20
union all select 'odd-asof', 'warn', place from c where n = 1
union all select 'undated', 'warn', place from c where n = 3""")
def claim_findings(t: Tables):
    n, q, flag = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_returnflag")
    claims = t.lineitem.select(
        F.concat_ws("#", "l_orderkey", "l_linenumber").alias("claim_id"), F.when(n != 7, F.lit("sent")).alias("predicate"), F.when(flag == "A", "reported").when(flag == "R", "confirmed").when(n != 6, "provisional").alias("status"),
        F.when(q == 3, "many").when(q == 4, "some").alias("presence"), F.when(n != 5, F.lit("v")).alias("value"), F.lit(None).cast("string").alias("object"), F.when(F.col("l_orderkey") % 3 == 0, "clerk").alias("attribution"),
        F.when(q == 10, "hand").when(q.isin(11, 12), "auto").alias("provenance"), F.when(q == 20, "open").when(q == 21, "private").alias("sensitivity"), F.when(n == 2, "2020").alias("period"), F.when(n == 1, "May 2020").when(~n.isin(2, 3), "2020-05").alias("asof"),
    )
    return findings.row_findings(claims, F.col("claim_id"), findings.claim_rules())


@query("""with s as (select s_suppkey as k, sha256(s_name) as h from supplier)
select 'source-key' as rule, 'err' as severity, cast(k as varchar) as place from s where k % 4 = 0
union all select 'one-target', 'err', cast(k as varchar) from s where k % 5 in (0, 1)
union all select 'record-hash', 'err', cast(k as varchar) from s where k % 5 = 2
union all select 'ref-shape', 'err', cast(k as varchar) from s where k % 5 = 3""")
def source_findings(t: Tables):
    k = F.col("s_suppkey")
    sources = t.supplier.select(
        "s_suppkey", F.when(k % 4 == 0, F.concat(F.lit("S"), k.cast("string"))).otherwise("s-1").alias("source_key"),
        F.when((k % 5).isin(1, 4), F.sha2("s_name", 256)).when(k % 5 == 2, "abc").alias("record"), F.when(k % 5 == 3, "Data set").when(k % 5 == 1, "osm@2024/w1").alias("ref"),
    )
    return findings.row_findings(sources, k.cast("string"), findings.source_rules())


@query("""with r as (select o_orderkey as k, sha256(cast(o_custkey as varchar)) as h, 'o-' || o_orderkey as place from orders)
select 'role-slug' as rule, 'err' as severity, place from r where k % 10 = 1
union all select 'qualified-uri', 'err', place from r where k % 6 = 0
union all select 'uri-shape', 'err', place from r where k % 6 = 1
union all select 'modality', 'err', place from r where k % 8 = 0
union all select 'derivation', 'err', place from r where k % 9 = 0
union all select 'derived-pair', 'err', place from r where k % 9 = 1
union all select 'derived-uri', 'err', place from r where k % 9 = 0""")
def roster_findings(t: Tables):
    k = F.col("o_orderkey")
    hashed = F.sha2(F.col("o_custkey").cast("string"), 256)
    rows = t.orders.select(
        F.concat(F.lit("o-"), k.cast("string")).alias("place"), F.when(k % 10 == 1, "Proof Copy").otherwise("proof").alias("role"),
        F.when(k % 6 == 0, F.concat(F.lit("corpus://main/"), hashed)).when(k % 6 == 1, "http://a").otherwise(F.concat(F.lit("corpus://"), hashed, F.lit("?page=2"))).alias("uri"),
        F.when(k % 8 == 0, " ").when(k % 8 == 1, "scan").alias("modality"), F.when(k % 9 == 0, "").when(k % 9 < 3, "crop").alias("derivation"), F.when(k % 9 == 0, "corpus://x").when(k % 9 == 2, F.concat(F.lit("corpus://"), hashed)).alias("derived_from"),
    )
    return findings.row_findings(rows, F.col("place"), findings.roster_rules())


@query("""with e as (select l_orderkey || '#' || l_linenumber as place, l_linenumber as n, l_quantity as q from lineitem)
select 'evidence-kind' as rule, 'err' as severity, place from e where n = 4
union all select 'element-of-none', 'err', place from e where q < 10 and n > 5
union all select 'element-range', 'err', place from e where q in (7, 8, 9) and n <= 5
union all select 'anchor-mark', 'err', place from e where q = 30
union all select 'no-source', 'err', place from e where q in (40, 41)""")
def evidence_findings(t: Tables):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    rows = t.lineitem.select(
        F.concat_ws("#", "l_orderkey", "l_linenumber").alias("place"), F.when(n == 4, "hearsay").otherwise("direct").alias("kind"), F.when(q < 10, F.when(q == 9, -1).otherwise(q.cast("int"))).alias("element"),
        F.when(n <= 5, F.lit(7)).alias("elements"), F.when(q == 30, "?page=3").when(q == 31, "page=3").alias("anchor"), F.when(q == 40, "").when(q != 41, "s").alias("source_key"),
    )
    return findings.row_findings(rows, F.col("place"), findings.evidence_rules())


@query("""with l as (select p_partkey as k, case when p_partkey % 4 = 0 then p_partkey else -p_partkey end as old, case p_partkey % 5 when 0 then 0 when 1 then -(p_partkey + 1) else p_partkey end as new from part),
t as (select 'key-lives' as rule, old, new from l where old in (select p_partkey from part)
union all select 'second-hop', old, new from l where new < 0 and new in (select old from l)
union all select 'no-target', old, new from l where new not in (select p_partkey from part) and new not in (select old from l))
select rule, 'err' as severity, old || ' -> ' || new as place from t""")
def lineage_findings(t: Tables):
    k = F.col("p_partkey")
    rows = t.part.select(F.when(k % 4 == 0, k).otherwise(-k).cast("string").alias("old_id"), F.when(k % 5 == 0, F.lit(0)).when(k % 5 == 1, -(k + 1)).otherwise(k).cast("string").alias("to_id"))
    return findings.lineage_findings(rows, t.part.select(k.cast("string").alias("id")))


@query("""with c as (select o_orderkey as fact, 'c-' || o_orderkey as claim from orders),
s as (select l_orderkey as fact, 's' || l_linenumber as key, l_suppkey as record from lineitem),
e as (select l_orderkey as fact, 'c-' || l_orderkey as claim, 's' || (l_linenumber + l_partkey % 2) as key from lineitem where l_quantity > 40)
select 'no-evidence' as rule, 'err' as severity, claim as place from c where claim not in (select claim from e)
union all select distinct 'unknown-source', 'err', e.fact || '/' || e.key from e where not exists (select 1 from s where s.fact = e.fact and s.key = e.key)
union all select distinct 'unused-source', 'warn', s.fact || '/' || s.key from s where not exists (select 1 from e where s.fact = e.fact and s.key = e.key)
union all select 'record-twice', 'err', fact || '/' || record from s group by fact, record having count(*) > 1""")
def citation_findings(t: Tables):
    fact, claim = F.col("l_orderkey").alias("fact_id"), F.concat(F.lit("c-"), F.col("l_orderkey").cast("string")).alias("claim_id")
    key = lambda n: F.concat(F.lit("s"), n.cast("string")).alias("source_key")
    claims = t.orders.select(F.col("o_orderkey").alias("fact_id"), F.concat(F.lit("c-"), F.col("o_orderkey").cast("string")).alias("claim_id"))
    sources = t.lineitem.select(fact, key(F.col("l_linenumber")), F.col("l_suppkey").cast("string").alias("record"), F.lit(None).cast("string").alias("ref"))
    evidence = t.lineitem.where("l_quantity > 40").select(fact, claim, key(F.col("l_linenumber") + F.col("l_partkey") % 2))
    return findings.citation_findings(claims, sources, evidence)
