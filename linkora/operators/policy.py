"""What becomes of violations: reachability labels, dedup, order, excludes, tiers, gates, groups and the merge of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flags import pretty_member
from ..plans.scratch import settle
from .closure import reachable

IDENTITY = ["source", "source_class", "kind", "owner", "name", "descriptor", "expected_static", "field_write", "instantiated"]


def dedup(violations: DataFrame, order: list[str]) -> DataFrame:
    """One violation for each reference of a class, whatever its reason; the first pass that found it keeps its reason.

    An aggregate, so map tasks already drop the losers.
    """
    rest = [c for c in violations.columns if c not in IDENTITY]
    first = violations.groupBy(*IDENTITY).agg(F.min(F.struct("pass_ord", *order, *[c for c in rest if c not in ("pass_ord", *order)])).alias("f"))
    return first.select(*IDENTITY, *[F.col(f"f.{c}").alias(c) for c in rest]).select(violations.columns)


def canonical_order(violations: DataFrame) -> list[Column]:
    return [F.asc("source"), F.asc("source_class"), F.asc("owner"), F.asc_nulls_first("name"), F.asc_nulls_first("descriptor"), F.asc("reason")]


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank, the place of each in the whole order from 1 on: ranges are sorted and numbered apart, then shifted by the ranges before them."""
    parts = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    sizes = sorted((r["part"], r["n"], r["low"]) for r in parts.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low")).collect())
    shift, before = [], 0
    for part, n, low in sizes:
        shift.append((part, before + 1 - low))
        before += n
    out = parts.join(F.broadcast(rows.sparkSession.createDataFrame(shift, "part int, shift long")), "part")
    return out.select(*[F.col(c) for c in rows.columns], (F.col("at") + F.col("shift")).alias("rank"))


def reach(graph: DataFrame, load_edges: DataFrame, services: DataFrame, app_roots: DataFrame) -> DataFrame:
    """Classes that the application can reach: from classes of its sources and providers of services that are outside the graph."""
    known = graph.select("class_name")
    roots = graph.join(app_roots.select("source").distinct(), "source", "left_semi").select("class_name")
    outer = services.join(known.withColumnRenamed("class_name", "iface"), "iface", "left_anti").select(F.col("provider").alias("class_name"))
    ups = graph.select(F.col("class_name").alias("src"), F.explode(F.concat(F.coalesce("interfaces", F.array().cast("array<string>")), F.array("super_name"))).alias("dst")).where("dst is not null")
    edges = ups.unionByName(load_edges.select("src", "dst")).unionByName(services.select(F.col("iface").alias("src"), F.col("provider").alias("dst"))).distinct()
    return reachable(edges, roots.unionByName(outer))


def label(violations: DataFrame, marked: DataFrame, services: DataFrame) -> DataFrame:
    """reachable: marked; null for a service violation that is not marked and whose registration was not scanned."""
    m = marked.select(F.col("class_name").alias("source_class"), F.lit(True).alias("m")).distinct()
    s = services.select(F.col("iface").alias("owner"), F.col("provider").alias("source_class"), F.lit(True).alias("s")).distinct()
    out = violations.join(m, "source_class", "left").join(s, ["owner", "source_class"], "left")
    spi = F.col("reason").startswith("service provider")
    return out.withColumn("reachable", F.when(F.col("m"), True).when(spi & F.col("s").isNull(), F.lit(None).cast("boolean")).otherwise(False)).drop("m", "s")


def tier(reachable: str = "reachable", observed: str = "observed_loading", invoked: str = "invocation_found", axis: Column | None = None) -> Column:
    """unproven, latent or breaks; a reachability that is not known counts as reachable."""
    valid = F.lit(True) if axis is None else axis
    return (
        F.when(valid & F.coalesce(~F.col(reachable), F.lit(False)) & ~F.coalesce(F.col(observed), F.lit(False)), "unproven")
        .when(F.coalesce(~F.col(invoked), F.lit(False)), "latent")
        .otherwise("breaks")
    )


def _matches() -> Column:
    # Rules: owner exact or with one trailing *, member, descriptor, kind; null matches all.
    exact = F.expr("r_owner is null or v.owner = r_owner or (r_owner like '%*' and startswith(v.owner, substring(r_owner, 1, length(r_owner) - 1)))")
    return exact & F.expr("(r_member is null or v.name <=> r_member) and (r_descriptor is null or v.descriptor <=> r_descriptor) and (r_kind is null or v.reason = r_kind)")


def _rules(rules: DataFrame) -> DataFrame:
    return rules.select("rule_id", *[F.col(c).alias(f"r_{c}") for c in ("owner", "member", "descriptor", "kind")])


MOST_RULES = 100_000


def _bounded(rules: DataFrame) -> DataFrame:
    """Rules are written by hand. They are matched by conditions, not by a key, so they go to every task; more than MOST_RULES are an error."""
    r = _rules(rules)
    if r.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} exclude rules")
    return F.broadcast(r)


def exclude(violations: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations that no rule matches."""
    return violations.alias("v").join(_bounded(rules), _matches(), "left_anti")


def excluded(violations: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations that a rule matches."""
    return violations.alias("v").join(_bounded(rules), _matches(), "left_semi")


def unused_rules(violations: DataFrame, rules: DataFrame) -> DataFrame:
    used = violations.alias("v").join(_bounded(rules), _matches()).select("rule_id").distinct()
    return rules.join(used, "rule_id", "left_anti")


def gate(tiers: DataFrame) -> DataFrame:
    """(policy, fails): never; reachable: any break; any: any violation."""
    n = tiers.agg(F.count("*").alias("n"), F.count(F.when(F.col("tier") == "breaks", 1)).alias("b"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), c.alias("fails")) for p, c in (("never", F.lit(False)), ("reachable", F.col("b") > 0), ("any", F.col("n") > 0))])).alias("x")).select("x.*")


def symbol_groups(violations: DataFrame) -> DataFrame:
    """For each broken symbol: users as a set, and records."""
    return violations.groupBy("kind", "owner", "name", "descriptor", "reason").agg(F.count("*").alias("records"), F.sort_array(F.collect_set("source_class")).alias("users"))


def structural_groups(violations: DataFrame) -> DataFrame:
    """(source_class, source, records, reasons) of violations that no recorded reference shows."""
    return violations.groupBy("source_class", "source").agg(F.count("*").alias("records"), F.sort_array(F.collect_set("reason")).alias("reasons"))


def name_collisions(violations: DataFrame) -> DataFrame:
    """(shown, reason, symbols): displayed names that stand for several symbols of one reason, so that a report must add their descriptors."""
    sym = violations.select("owner", "name", "descriptor", "reason", pretty_member().alias("shown")).distinct()
    return sym.groupBy("shown", "reason").agg(F.count("*").alias("symbols")).where("symbols > 1")


def tier_counts(violations: DataFrame) -> DataFrame:
    """(tier, n, observed): violations of each tier, and those of them that were seen loading."""
    return violations.groupBy("tier").agg(F.count("*").alias("n"), F.count(F.when(F.col("observed_loading"), 1)).alias("observed"))


FIX = ["referenced_by", "removed_by", "before", "after", "advice"]


def fix_groups(violations: DataFrame) -> DataFrame:
    """violations with the five columns of a suggestion -> one row for each, with its symbols and users; those without advice are left out."""
    return violations.where("advice is not null").groupBy(*FIX).agg(F.count("*").alias("records"), F.sort_array(F.collect_set(pretty_member())).alias("symbols"), F.countDistinct("source_class").alias("classes"))


def run_counts(violations: DataFrame, runs: DataFrame) -> DataFrame:
    """merged violations (modules array), runs (run_id, modules array) -> (run_id, broken): the violations of the modules of each run."""
    # Violations with the same modules count together; those sets are few.
    same = violations.groupBy("modules").agg(F.count("*").alias("n"))
    each = same.select("modules", "n", F.explode("modules").alias("module"))
    member = runs.select("run_id", F.explode("modules").alias("module")).distinct()
    hit = each.join(member, "module").select("modules", "n", "run_id").distinct().groupBy("run_id").agg(F.sum("n").alias("broken"))
    return runs.select("run_id").join(hit, "run_id", "left").select("run_id", F.coalesce("broken", F.lit(0)).cast("long").alias("broken"))


def merge_runs(runs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of several runs with (identity, reason, *more, reachable, invocation_found, module): the most reachable label, any invocation, all modules.

    more: further columns of the identity, such as those of the advice.
    """
    rank = F.max(F.when(F.col("reachable"), 2).when(F.col("reachable").isNull(), 1).otherwise(0))
    out = runs.groupBy(*IDENTITY, "reason", *more).agg(rank.alias("rank"), F.bool_or("invocation_found").alias("invocation_found"), F.sort_array(F.collect_set("module")).alias("modules"))
    return out.withColumn("reachable", F.when(F.col("rank") == 2, True).when(F.col("rank") == 0, False)).drop("rank")
