"""Normalized tables of a collection, derived from the driver's tables by SQL that both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import NAMES, table
from .registry import ORACLES, QUERIES

#: name -> SQL over the driver's tables and views above.
VIEWS = {
    "facts": """select 'part-' || cast(p_partkey as string) as fact_id, 'part' as type, p_name as name, cast(null as string) as period, cast(null as string) as sensitivity from part
union all select 'supplier-' || cast(s_suppkey as string), 'supplier', s_name, cast(null as string), case when s_suppkey % 7 = 0 then 'private' end from supplier
union all select 'customer-' || cast(c_custkey as string), 'customer', c_name, cast(null as string), case when c_custkey % 7 = 0 then 'private' end from customer
union all select 'nation-' || cast(n_nationkey as string), 'nation', n_name, cast(null as string), cast(null as string) from nation
union all select 'order-' || cast(o_orderkey as string), 'order', cast(null as string), substr(cast(o_orderdate as string), 1, 10), cast(null as string) from orders""",
    "claims": """select 'part-' || cast(p_partkey as string) as fact_id, 'part-' || cast(p_partkey as string) || '#brand' as claim_id, 'brand' as predicate, p_brand as value, cast(null as string) as object, cast(null as string) as per, cast(null as string) as period, case when p_partkey % 3 = 0 then 'confirmed' else 'provisional' end as status, cast(null as string) as sensitivity from part
union all select 'part-' || cast(p_partkey as string), 'part-' || cast(p_partkey as string) || '#maker_id', 'maker_id', p_type, cast(null as string), cast(null as string), cast(null as string), 'provisional', cast(null as string) from part where p_size > 10
union all select 'customer-' || cast(c_custkey as string), 'customer-' || cast(c_custkey as string) || '#segment', 'segment', c_mktsegment, cast(null as string), cast(null as string), cast(null as string), 'provisional', case when c_custkey % 11 = 0 then 'private' end from customer
union all select 'customer-' || cast(c_custkey as string), 'customer-' || cast(c_custkey as string) || '#nation', 'nation', cast(null as string), 'nation-' || cast(c_nationkey as string), cast(null as string), cast(null as string), 'confirmed', cast(null as string) from customer where c_acctbal > 0
union all select 'order-' || cast(l_orderkey as string), 'order-' || cast(l_orderkey as string) || '#' || cast(l_linenumber as string), case when l_linenumber % 2 = 0 then 'shipped' else 'sent' end, case when l_linenumber = 3 then null else l_returnflag end, 'part-' || cast(l_partkey as string), l_linestatus, substr(cast(l_shipdate as string), 1, 7), case when l_linenumber % 4 = 0 then 'confirmed' when l_linenumber % 4 = 2 then 'reported' else 'provisional' end, cast(null as string) from lineitem""",
    "roster": """select 'order-' || cast(l_orderkey as string) as fact_id, 'corpus://rec-' || cast(l_suppkey as string) as uri, case when l_returnflag = 'R' then 'proof' else 'copy' end as role from lineitem where l_linenumber <= 2""",
    "edges": """select 'order-' || cast(o_orderkey as string) as edge_id, 'purchase' as type, 'customer-' || cast(o_custkey as string) as fact_id from orders
union all select distinct 'order-' || cast(l_orderkey as string), 'purchase', 'part-' || cast(l_partkey as string) from lineitem""",
    "lineage": """select 'old-part-' || cast(p_partkey as string) as old_id, 'part-' || cast(p_partkey as string) as to_id from part where p_partkey % 3 = 0""",
    "evidence": """select 'order-' || cast(l_orderkey as string) || '#' || cast(l_linenumber as string) as claim_id, 'rec-' || cast(l_suppkey as string) as record from lineitem""",
    "record_tiers": """select 'rec-' || cast(s_suppkey as string) as record, case when s_nationkey % 3 = 0 then 'secret' else 'public' end as tier from supplier""",
    "records": """select 'doc-' || cast(doc_id as string) as record_id, source as host, cast(null as string) as origin_id, 'text/plain' as mime, lang as filename, text as content from documents
union all select 'page-' || cast(page_id as string), '', case when page_id % 3 = 0 then 'pages' end, case when page_id % 2 = 0 then 'text/html' end, 'page', substr(html, 1, 3000) from pages""",
    "entries": """select 'part-' || cast(p_partkey as string) as id, 'part' as type, p_name as name, p_brand as alias, cast(null as string) as merged_into from part
union all select 'customer-' || cast(c_custkey as string), 'customer', c_name, c_mktsegment, cast(null as string) from customer
union all select 'old-part-' || cast(p_partkey as string), 'part', cast(null as string), cast(null as string), 'part-' || cast(p_partkey as string) from part where p_partkey % 3 = 0""",
}


class Model:
    """The views as attributes; tables of the driver keep their names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return table(self.spark, self.sf_dir, name)
        if name not in VIEWS:
            raise AttributeError(name)
        used = [t for t in NAMES if f" {t} " in VIEWS[name].replace("\n", " ") + " "]
        sql = VIEWS[name]
        for t in used:
            sql = _named(sql, t, f"{{{t}}}")
        return self.spark.sql(sql, **{t: table(self.spark, self.sf_dir, t) for t in used})


def _named(sql: str, name: str, by: str) -> str:
    return " ".join(w if w.rstrip(",)") != name else w.replace(name, by) for w in sql.split(" ")) if "\n" not in sql else "\n".join(_named(line, name, by) for line in sql.split("\n"))


def on_model(sql: str | None, *views: str):
    """Registers plan(m: Model); the SQL reads the views named as common tables."""

    def register(plan: Callable[[Model], DataFrame]):
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(Model(spark, sf_dir))
        if sql:
            parts = [f"{v} as ({VIEWS[v]})" for v in views]
            text = sql.strip()
            if text.lower().startswith("with recursive "):
                text = "with recursive " + ",\n".join([*parts, text[15:]])
            elif text.lower().startswith("with "):
                text = "with " + ",\n".join([*parts, text[5:]])
            elif parts:
                text = "with " + ",\n".join(parts) + "\n" + text
            ORACLES[plan.__name__] = text
        return plan

    return register
