"""Rules over facts and claims, compiled from plain mappings to DataFrame plans.

Tables (more columns may stand beside):
    facts(fact_id, type, name, period)   claims(fact_id, claim_id, predicate, value, object, per, period, status)
    roster(fact_id, uri, role)           edges(edge_id, type, fact_id)  one row a participant
    lineage(old_id, to_id)
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from .predicates import compile_predicate, test
from .relations import bucketed_overlaps


class Ledger:
    """The tables that rules read."""

    def __init__(self, facts: DataFrame, claims: DataFrame, roster: DataFrame | None = None, edges: DataFrame | None = None, lineage: DataFrame | None = None):
        self.facts, self.claims, self.roster, self.edges, self.lineage = facts, claims, roster, edges, lineage


def _ops(spec: object) -> Mapping:
    return spec if isinstance(spec, Mapping) else {"equals": spec}


def _all(column: str, spec: object) -> Column:
    out = F.lit(True)
    for op, arg in _ops(spec).items():
        out = out & test(F.col(column), False, op, arg)
    return out


def claim_column(spec: Mapping) -> Column:
    """One claim meets predicate, value and object tests together."""
    out = F.lit(True)
    for key in ("predicate", "value", "object", "status"):
        if key in spec:
            out = out & _all(key, spec[key])
    return out


def isa(types: DataFrame, depth: int = 16) -> DataFrame:
    """(type, ancestor) of types(type, extends): every type, itself and what it extends; a repeat or a spine reference with : ends a chain."""
    step = types.select(F.col("type").alias("_t"), F.col("extends").alias("_e"))
    front = types.select("type", F.col("type").alias("ancestor"), F.array("type").alias("seen"))
    out = front.select("type", "ancestor")
    for _ in range(depth):
        front = front.where(~F.col("ancestor").contains(":"))
        front = front.join(step, front["ancestor"] == step["_t"]).where(F.col("_e").isNotNull() & ~F.array_contains("seen", F.col("_e")))
        front = front.select("type", F.col("_e").alias("ancestor"), F.array_append("seen", F.col("_e")).alias("seen"))
        out = out.unionByName(front.select("type", "ancestor"))
    return out.distinct()


def facts_where(when: Mapping, ledger: Ledger, types: DataFrame | None = None) -> DataFrame:
    """Facts that meet every condition of `when`: type, id, isa, fields, claim, no_claim, roster, no_roster, edge."""
    out = ledger.facts
    for key, spec in when.items():
        if key == "type":
            out = out.where(_all("type", spec if isinstance(spec, Mapping) or isinstance(spec, str) else {"in": spec}))
        elif key == "id":
            names = [spec] if isinstance(spec, str) else list(spec)
            if ledger.lineage is not None:  # a retired id stands for its survivor
                moved = ledger.lineage.where(F.col("old_id").isin(names)).select(F.col("to_id").alias("fact_id"))
                live = out.where(F.col("fact_id").isin(names)).select("fact_id")
                out = out.join(live.unionByName(moved).distinct(), "fact_id", "left_semi")
            else:
                out = out.where(F.col("fact_id").isin(names))
        elif key == "isa":
            out = out.join(types.where(F.col("ancestor") == spec).select("type"), "type", "left_semi")
        elif key in ("claim", "no_claim"):
            out = out.join(ledger.claims.where(claim_column(spec)).select("fact_id"), "fact_id", "left_semi" if key == "claim" else "left_anti")
        elif key in ("roster", "no_roster"):
            out = out.join(ledger.roster.where(_all("role", spec)).select("fact_id"), "fact_id", "left_semi" if key == "roster" else "left_anti")
        elif key == "edge":
            edges = ledger.edges.where(_all("type", spec["type"])) if "type" in spec else ledger.edges
            if "with_type" in spec:  # another participant is of this type
                others = edges.join(ledger.facts.where(_all("type", spec["with_type"])).select("fact_id"), "fact_id", "left_semi")
                others = others.select("edge_id", F.col("fact_id").alias("_other"))
                edges = edges.join(others, "edge_id").where("fact_id <> _other")
            out = out.join(edges.select("fact_id"), "fact_id", "left_semi")
        else:
            out = out.where(compile_predicate({key: spec}, {c: (F.col(c), False) for c in out.columns}))
    return out


def violations(rule: Mapping, ledger: Ledger, types: DataFrame | None = None) -> DataFrame:
    """(rule, fact_id, detail) where facts break an invariant.

    constraint: unique (with per: the qualifier column), exclusive (set of
    {predicate, value?}), temporal-no-overlap, requires, cardinality (min, max;
    no claim counts as 0).  applies_to selects facts, claim the matching claims.
    """
    kind, name = rule["constraint"], F.lit(rule["id"])
    facts = facts_where(rule.get("applies_to", {}), ledger, types).select("fact_id")
    own = ledger.claims.join(facts, "fact_id", "left_semi")
    matching = own.where(claim_column(rule.get("claim", {})))
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ", ")
    if kind == "unique":
        keys = ["fact_id", *([rule["per"]] if rule.get("per") else [])]
        out = matching.groupBy(*keys).agg(F.count("*").alias("n"), listed("claim_id").alias("detail")).where("n > 1")
    elif kind == "exclusive":
        members = F.array(*(F.when(claim_column(m), F.lit(i)) for i, m in enumerate(rule["set"])))
        held = own.select("fact_id", "claim_id", F.explode(F.filter(members, lambda x: x.isNotNull())))
        out = held.groupBy("fact_id").agg(F.count("*").alias("n"), listed("claim_id").alias("detail")).where("n > 1")
    elif kind == "temporal-no-overlap":
        span = dates.period_interval(F.col("period"))
        # explode keeps the long expression of a period from being copied into every use of its days
        spans = matching.where("period is not null").select("fact_id", "claim_id", F.explode(F.array(span)).alias("s")).select("fact_id", "claim_id", "s.first", "s.last").where("first is not null")
        out = bucketed_overlaps(spans, "fact_id", "claim_id", "first", "last").withColumn("detail", F.concat_ws(" vs ", "one", "two"))
    elif kind == "requires":
        needed = own.where(F.col("predicate") == rule["requires"]["predicate"]).select("fact_id")
        out = matching.select("fact_id").distinct().join(needed, "fact_id", "left_anti").withColumn("detail", F.lit(rule["requires"]["predicate"]))
    elif kind == "cardinality":
        counts = facts.join(matching.groupBy("fact_id").agg(F.count("*").alias("n")), "fact_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        low, high = rule.get("min"), rule.get("max")
        bad = (F.col("n") < low if low is not None else F.lit(False)) | (F.col("n") > high if high is not None else F.lit(False))
        out = counts.where(bad).withColumn("detail", F.col("n").cast("string"))
    else:
        raise ValueError(f"unknown constraint {kind!r}")
    return out.select(name.alias("rule"), "fact_id", "detail")


def all_violations(rules: Sequence[Mapping], ledger: Ledger, types: DataFrame | None = None) -> DataFrame:
    out = None
    for rule in rules:
        found = violations(rule, ledger, types)
        out = found if out is None else out.unionByName(found)
    return out


def demands(rules: Sequence[Mapping], ledger: Ledger, blocked: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """(rule, fact_id, field, state): what facts owe.

    rules: {id, when, owes: [field], blockable?}.  A field is satisfied by a claim
    with that predicate, the field `period` by a period; else it is blocked if the
    rule may be blocked and blocked(fact_id, rule) names it, else open.
    """
    have = ledger.claims.select("fact_id", F.col("predicate").alias("field")).unionByName(ledger.facts.where("period is not null").select("fact_id", F.lit("period").alias("field"))).distinct().withColumn("_have", F.lit(True))
    owed = None
    for rule in sorted(rules, key=lambda r: r["id"]):
        rows = facts_where(rule.get("when", {}), ledger, types).select(F.lit(rule["id"]).alias("rule"), "fact_id", F.lit(bool(rule.get("blockable", True))).alias("_may"), F.explode(F.array(*map(F.lit, rule["owes"]))).alias("field"))
        owed = rows if owed is None else owed.unionByName(rows)
    out = owed.join(have, ["fact_id", "field"], "left")
    stopped = F.lit(False)
    if blocked is not None:
        out = out.join(blocked.select("fact_id", "rule").distinct().withColumn("_stop", F.lit(True)), ["fact_id", "rule"], "left")
        stopped = F.coalesce("_stop", F.lit(False)) & F.col("_may")
    return out.select("rule", "fact_id", "field", F.when(F.col("_have"), "satisfied").when(stopped, "blocked").otherwise("open").alias("state"))


def disagreements(claims: DataFrame) -> DataFrame:
    """(fact_id, predicate, reported, confirmed): claims of one fact and predicate whose value or object differ, null being a value."""
    one = claims.where("status = 'reported'").select("fact_id", "predicate", F.col("claim_id").alias("reported"), F.col("value").alias("_v"), F.col("object").alias("_o"))
    two = claims.where("status = 'confirmed'").select("fact_id", "predicate", F.col("claim_id").alias("confirmed"), F.col("value").alias("_w"), F.col("object").alias("_p"))
    return one.join(two, ["fact_id", "predicate"]).where(~(F.col("_v").eqNullSafe(F.col("_w")) & F.col("_o").eqNullSafe(F.col("_p")))).drop("_v", "_w", "_o", "_p")


#: What a value must be: name -> test(column, declaration).
_ISO_DATE, _ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"
KINDS = {
    "string": lambda c, d: c.isNotNull(),
    "number": lambda c, d: c.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"),
    "integer": lambda c, d: c.rlike(r"^[+-]?\d+$"),
    "decimal": lambda c, d: c.rlike(r"^[+-]?\d+(\.\d+)?$"),
    "boolean": lambda c, d: c.isin("true", "false"),
    "enum": lambda c, d: c.isin([str(x) for x in d["values"]]),
    "pattern": lambda c, d: c.rlike(rf"\A(?:{d['pattern']})\z"),
    "range": lambda c, d: c.try_cast("double").between(d.get("min", float("-inf")), d.get("max", float("inf"))),
    "iso-date": lambda c, d: c.rlike(_ISO_DATE) & c.try_cast("date").isNotNull(),
    "iso-instant": lambda c, d: c.rlike(_ISO_INSTANT) & c.try_cast("timestamp").isNotNull(),
    "iana-zone": lambda c, d: c.rlike(r"^(UTC|[A-Z][A-Za-z_]+(/[A-Z][A-Za-z_+-]+)+)$"),
    "iso-4217": lambda c, d: c.rlike(r"^[A-Z]{3}$"),
    "latitude": lambda c, d: c.try_cast("double").between(-90, 90),
    "longitude": lambda c, d: c.try_cast("double").between(-180, 180),
}


def inadmissible(fields: DataFrame, declared: Mapping[str, Mapping]) -> DataFrame:
    """(id, field, fault) of fields(id, field, value): undeclared fields, values of another kind, required fields that are absent."""
    ok = F.lit(None).cast("boolean")
    for name, entry in declared.items():
        ok = F.when(F.col("field") == name, F.coalesce(KINDS[entry["kind"]](F.col("value"), entry), F.lit(False))).otherwise(ok)
    faults = fields.where(F.col("value").isNotNull()).select("id", "field", F.when(ok.isNull(), "undeclared").when(~ok, "kind").alias("fault")).where("fault is not null")
    required = [n for n, e in declared.items() if e.get("required")]
    if required:
        there = fields.where("value is not null").select("id", "field")
        owed = fields.select("id").distinct().select("id", F.explode(F.array(*map(F.lit, required))).alias("field"))
        faults = faults.unionByName(owed.join(there, ["id", "field"], "left_anti").withColumn("fault", F.lit("absent")))
    return faults


def visible_claims(claims: DataFrame, evidence: DataFrame, record_tiers: DataFrame, grants: Sequence[str]) -> DataFrame:
    """Claims that a reader with these grants sees: none of the evidence lies in a tier not granted, the claim isn't private.

    evidence(claim_id, record); record_tiers(record, tier), a record's tiers must
    all be granted; evidence that resolves nowhere counts as seen.
    """
    hidden = record_tiers.where(~F.col("tier").isin(list(grants))).select("record").distinct()
    return claims.where(F.coalesce(F.col("sensitivity") != "private", F.lit(True))).join(evidence.join(hidden, "record", "left_semi").select("claim_id"), "claim_id", "left_anti")


def tiers(records: DataFrame, parents: DataFrame, floor: str, hops: int = 8) -> DataFrame:
    """(record, tier): declared tiers and those of the containers up to `hops` above; nothing declared and no parents: the floor.

    records(record, tier or null), parents(record, parent).  A record all of whose
    parents are cut off by the limit has no row, which no grant opens.
    """
    declared = records.where("tier is not null").select("record", "tier").distinct()
    reach = records.select("record", F.col("record").alias("at")).distinct()
    out = declared
    up = parents.select(F.col("record").alias("_r"), F.col("parent").alias("_p")).distinct()
    for _ in range(hops):
        reach = reach.join(up, reach["at"] == up["_r"]).select("record", F.col("_p").alias("at")).distinct()
        out = out.unionByName(reach.join(declared.select(F.col("record").alias("at"), "tier"), "at").select("record", "tier"))
    bare = records.select("record").distinct().join(declared, "record", "left_anti").join(parents.select("record"), "record", "left_anti")
    orphan_roots = bare.select("record", F.lit(floor).alias("tier"))
    # a root without a tier passes the floor on to what it contains
    reach = records.select("record", F.col("record").alias("at")).distinct()
    for _ in range(hops):
        reach = reach.join(up, reach["at"] == up["_r"]).select("record", F.col("_p").alias("at")).distinct()
        out = out.unionByName(reach.join(bare.select(F.col("record").alias("at")), "at", "left_semi").select("record", F.lit(floor).alias("tier")))
    return out.unionByName(orphan_roots).distinct()


def merged(ledger: Ledger, loser: str, survivor: str) -> Ledger:
    """The loser's claims, roster and references belong to the survivor; claims that say the same fall into one; a lineage row is added."""
    move = lambda c: F.when(F.col(c) == loser, F.lit(survivor)).otherwise(F.col(c)).alias(c)
    swap = lambda df, *cols: df.select(*(move(c) if c in cols else F.col(c) for c in df.columns))
    claims = swap(ledger.claims, "fact_id", "object")
    w = Window.partitionBy("fact_id", "predicate", "value", "object").orderBy(F.col("claim_id").startswith(loser + "#"), "claim_id")
    both = claims.where(F.col("fact_id") == survivor).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    claims = claims.where(F.col("fact_id") != survivor).unionByName(both)
    lineage = None
    if ledger.lineage is not None:
        row = ledger.lineage.sparkSession.range(1).select(F.lit(loser).alias("old_id"), F.lit(survivor).alias("to_id"))
        lineage = swap(ledger.lineage, "to_id").select("old_id", "to_id").unionByName(row)
    return Ledger(
        ledger.facts.where(F.col("fact_id") != loser),
        claims,
        swap(ledger.roster, "fact_id").dropDuplicates(["fact_id", "uri", "role"]) if ledger.roster is not None else None,
        swap(ledger.edges, "fact_id").distinct() if ledger.edges is not None else None,
        lineage,
    )


def superseded(citations: DataFrame, moves: DataFrame, kept: DataFrame) -> DataFrame:
    """Citations(record, address) of moves(old, new) rewritten where kept(old, address) holds the address, else marked divergent."""
    out = citations.join(moves, F.col("record") == F.col("old"), "left").join(kept.select("old", "address").distinct().withColumn("_kept", F.lit(True)), ["old", "address"], "left")
    change = F.when(F.col("new").isNull(), "untouched").when(F.col("_kept") | F.col("address").isNull(), "rewritten").otherwise("divergent")
    return out.withColumn("change", change).withColumn("record", F.when(F.col("change") == "rewritten", F.col("new")).otherwise(F.col("record"))).drop("old", "new", "_kept")


def harvested(records: DataFrame, rules: Sequence[Mapping], fields: Mapping[str, tuple[Column, bool]], slug: Column, claim_values: Mapping[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, roster, claims) minted from records(record_id, ...) that meet a rule's match; provenance auto, status provisional.

    slug null: the record is passed over; one fact a slug and type, one roster row
    a uri and role, one claim a predicate and value with all its records as evidence.
    """
    hit = None
    for rule in rules:
        rows = records.where(compile_predicate(rule["match"], fields)).select(slug.alias("fact_id"), "record_id", F.lit(rule["type"]).alias("type"), F.lit(rule.get("role", "source")).alias("role"), *(v.cast("string").alias(f"_{k}") for k, v in claim_values.items()))
        hit = rows if hit is None else hit.unionByName(rows)
    hit = hit.where("fact_id is not null and fact_id <> ''")
    facts = hit.groupBy("fact_id").agg(F.min("type").alias("type"), F.lit("auto").alias("provenance"))
    roster = hit.select("fact_id", F.concat(F.lit("corpus://"), "record_id").alias("uri"), "role").distinct()
    pairs = F.array(*(F.struct(F.lit(k).alias("predicate"), F.col(f"_{k}").alias("value")) for k in claim_values))
    claims = hit.select("fact_id", "record_id", F.explode(pairs).alias("c")).select("fact_id", "c.*", "record_id").where("value is not null")
    claims = claims.groupBy("fact_id", "predicate", "value").agg(F.array_sort(F.collect_set("record_id")).alias("evidence"), F.lit("provisional").alias("status"))
    return facts, roster, claims


def asserted_first(asserted: DataFrame, auto: DataFrame) -> DataFrame:
    """Claims (fact_id, predicate, value, ...): an asserted claim stands for an equal auto one."""
    return asserted.withColumn("provenance", F.lit("asserted")).unionByName(auto.join(asserted.select("fact_id", "predicate", "value"), ["fact_id", "predicate", "value"], "left_anti").withColumn("provenance", F.lit("auto")), allowMissingColumns=True)
