"""The whole plans: diff of two libraries, and the check of a classpath against an upgrade, from paths to tiered violations.

Every table is lazy until it is written to the checkpoint folder: the parsed classes (so that Python parses each archive once), the
fetched classes, and the verdicts, which counts and violations share.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff as differ
from ..operators import evidence, policy, scopes, structural, verdict
from ..operators import wanted as needs
from ..operators.closure import EDGES, prefer
from ..sources import jars, jdk
from .scratch import settle

RULES = "rule_id int, owner string, member string, descriptor string, kind string, reason string"
# Owners are pushed into the parser up to so many; a larger library is joined after parsing.
OWNERS = 200_000


@dataclass
class Library:
    """Parsed class rows (the first copy of each class), all that were read, and the service files."""

    rows: DataFrame
    scanned: DataFrame
    services: DataFrame
    errors: DataFrame
    classes: DataFrame = field(init=False)
    members: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        self.classes, self.members = jars.class_api(self.rows), jars.members(self.rows)


@dataclass
class Report:
    violations: DataFrame
    verdicts: DataFrame
    suppressed: DataFrame
    unused_rules: DataFrame
    scanned_classes: int
    warnings: DataFrame
    axis: bool | None

    def counts(self) -> dict[str, int]:
        return {"scanned_classes": self.scanned_classes, "total": self.violations.count(), "unknown_refs": self.verdicts.where("verdict = 'unknown'").count(), "suppressed": self.suppressed.count()}


def load(spark: SparkSession, paths: Sequence[str], release: int | None = None, owners: Sequence[str] | None = None) -> Library:
    paths = list(paths)
    parsed = settle(jars.parsed(jars.unique_entries(spark, paths, release), owners))
    scanned = parsed.where("class_name is not null")
    first = scanned.groupBy("class_name").agg(F.min(F.struct("path_ord", "entry_ord")).alias("f")).select("class_name", "f.*")
    services = settle(jars.services(jars.entries(spark, paths, release).where(F.col("entry_name").startswith("META-INF/services/"))))
    return Library(settle(scanned.join(first, first.columns, "left_semi")), scanned, services, parsed.where("error is not null").select("error"))


def load_release(spark: SparkSession, release: int) -> Library:
    """The whole API of a JDK release."""
    paths, selected = jdk.whole_release(release)
    return load(spark, paths, selected)


def diff_paths(spark: SparkSession, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    a, b = load(spark, old), load(spark, new)
    return differ.diff(a.classes, b.classes, a.members, b.members)


def admitted(targets: Sequence[str], old: Sequence[str]) -> tuple[list[str], list[str]]:
    """(scan targets, missing): each path once, without those that are an old library, whatever way they are written."""
    real = os.path.realpath
    gone = {real(p) for p in old if os.path.exists(p)}
    listed = list(dict.fromkeys(targets))
    return [p for p in listed if os.path.exists(p) and real(p) not in gone], [p for p in listed if not os.path.exists(p)]


def _side(*layers: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Layers (classes, members) -> those of the first layer that has the class."""
    own = settle(scopes.layered(*[c.select(*EDGES, "access", "nest_host", "permitted", "sealing_unknown") for c, _ in layers]))
    members = reduce(DataFrame.unionByName, [m.withColumn("layer", F.lit(i)) for i, (_, m) in enumerate(layers)])
    return own.drop("layer"), members.join(own.select("class_name", "layer"), ["class_name", "layer"], "left_semi").drop("layer")


def _rows(found: DataFrame, owner: str, reason, order: int, kind: str = "class", member: bool = False) -> DataFrame:
    null = lambda t, c: F.lit(None).cast(t).alias(c)
    key = [F.col("name"), F.col("descriptor")] if member else [null("string", "name"), null("string", "descriptor")]
    flags = [null("boolean", c) for c in ("expected_static", "field_write", "instantiated")]
    source = F.col("source") if "source" in found.columns else F.lit(None).cast("string").alias("source")
    return found.select(F.col("class_name").alias("source_class"), F.lit(kind).alias("kind"), F.col(owner).alias("owner"), *key, *flags, (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(order).alias("pass_ord"), source.alias("own_source"))


def scan(spark: SparkSession, targets: Sequence[str], old: Library) -> Library:
    """The classes of the targets; references to anything but the old library's classes are dropped while parsing."""
    few = old.classes.select("class_name").limit(OWNERS + 1).collect()
    return load(spark, targets, owners=[r["class_name"] for r in few] if len(few) <= OWNERS else None)


def check_libraries(spark: SparkSession, old: Library, new: Library, old_paths: Sequence[str], new_paths: Sequence[str], targets: Sequence[str], *, app: Sequence[str] = (), layer: int | None = None) -> Report:
    """What breaks in the targets when the old library becomes the new one; no rules and no logs yet.

    app: sources that hold the roots of reachability. layer: a JDK release whose API, as far as names lead there, is the last layer of both sides.
    """
    targets, missing = admitted(targets, old_paths)
    read = scan(spark, targets, old)
    graph, services = read.classes, read.services
    refs = settle(scopes.owner_refs(jars.symbol_refs(read.rows), old.classes))
    new_real = {os.path.realpath(p) for p in new_paths}
    upgraded = spark.createDataFrame([(p,) for p in targets if os.path.realpath(p) in new_real], "source string")
    want = settle(needs.wanted(refs, old.classes, new.classes, old.members, new.members, graph, old.services, new.services, upgraded))
    own = want.where("not escape").select("class_name")
    fetched = (graph.join(own, "class_name", "left_semi"), read.members.join(own, "class_name", "left_semi"))
    last = []
    if layer is not None:
        platform = settle(jars.release_closure(spark, jdk.stubs(layer), layer, want.where("escape")))
        last = [(jars.class_api(platform), jars.members(platform))]
    (was, was_m), (now, now_m) = _side((old.classes, old.members), fetched, *last), _side((new.classes, new.members), fetched, *last)
    verdicts = settle(verdict.verdicts(refs, was, now, was_m, now_m, graph))

    both = prefer(graph, new.classes)
    subjects = fetched[0].where("access & 1536 = 0")
    selected = settle(structural.selection_breaks(was, now, was_m, now_m, subjects))
    parts = [
        _rows(structural.extends_newly_final(graph, old.classes, new.classes), "super_name", "class became final", 1),
        _rows(structural.overrides_newly_final(both, fetched[1], structural.newly_final_methods(old.members, new.members)), "ancestor", "method became final", 2, "method", True),
        _rows(structural.version_lag(graph, upgraded, now, old.classes), "super_name", "extends final class", 3),
        _rows(structural.edge_kind_flip(graph, old.classes, new.classes), "up", F.col("reason"), 4),
        _rows(structural.sealed_unpermitted(graph, old.classes, new.classes), "up", "class became sealed", 5),
        _rows(selected, "owner", F.col("reason"), 6, "method", True),
        _rows(structural.spi_breaks(old.services, new.services, was, now, was_m, now_m, graph).withColumnRenamed("provider", "class_name"), "iface", F.col("reason"), 7),
    ]
    home = graph.select(F.col("class_name").alias("source_class"), "source").unionByName(new.classes.join(graph.select("class_name"), "class_name", "left_anti").select(F.col("class_name").alias("source_class"), "source"))
    edges = reduce(DataFrame.unionByName, parts).join(home, "source_class", "left").withColumn("source", F.coalesce("own_source", "source")).drop("own_source")
    broken = verdict.collapsed(verdicts.where("verdict = 'broken'").drop("verdict")).withColumn("pass_ord", F.lit(0))
    found = policy.dedup(broken.unionByName(edges), ["reason"]).drop("pass_ord")

    calls = jars.invocations(read.scanned).unionByName(jars.invocations(new.scanned)).distinct()
    latent = structural.invocation_evidence(selected.select("class_name", "name", "descriptor").distinct(), calls, prefer(new.classes, graph))
    found = found.join(latent.select(F.col("class_name").alias("source_class"), "name", "descriptor", F.col("invocation_found").alias("called")), ["source_class", "name", "descriptor"], "left")
    found = found.withColumn("invocation_found", F.when(F.col("reason").isin("method became abstract", "conflicting default methods"), F.col("called"))).drop("called")
    axis = None
    if app:
        roots = spark.createDataFrame([(p,) for p in app], "source string")
        axis = not graph.join(roots, "source", "left_semi").isEmpty()
        found = policy.label(found, policy.reach(graph, jars.load_edges(read.rows), services, roots), services)
    else:
        found = found.withColumn("reachable", F.lit(None).cast("boolean"))
    count = jars.names(spark, targets).count()
    warnings = read.errors.unionByName(old.errors).unionByName(new.errors).unionByName(spark.createDataFrame([(f"not found: {p}",) for p in missing], "error string"))
    columns = [*policy.IDENTITY, "reason", "reachable", "invocation_found"]
    return Report(settle(found.select(*columns)), verdicts, spark.createDataFrame([], "reason string"), spark.createDataFrame([], RULES), count, warnings, axis)


def judged(report: Report, rules: Sequence[tuple], records: DataFrame | None) -> Report:
    """Excludes, then evidence, then tiers. records: (class_name, trigger) of what was seen loading."""
    spark, found = report.verdicts.sparkSession, report.violations
    listed = spark.createDataFrame(list(rules), RULES)
    kept = policy.exclude(found, listed) if rules else found
    if records is None:
        records = spark.createDataFrame([], "class_name string, trigger string")
    # Roots that match nothing prove nothing: then no violation is unproven.
    kept = settle(evidence.promote(kept, records).withColumn("tier", policy.tier(axis=F.lit(bool(report.axis)))))
    more = [c for c in found.columns if c not in (*policy.IDENTITY, "reason", "reachable", "invocation_found")]
    return Report(kept.select(*policy.IDENTITY, "reason", "reachable", "invocation_found", "observed_loading", "load_trigger", "tier", *more), report.verdicts, policy.excluded(found, listed), policy.unused_rules(found, listed), report.scanned_classes, report.warnings, report.axis)


def check(
    spark: SparkSession,
    old_paths: Sequence[str],
    new_paths: Sequence[str],
    classpath: Sequence[str],
    *,
    app: Sequence[str] = (),
    release: int | None = None,
    pair: tuple[int, int] | None = None,
    rules: Sequence[tuple] = (),
    logs: Sequence[str] = (),
) -> Report:
    """What breaks on the classpath when the old libraries become the new ones, or with `pair` one JDK release another.

    rules: rows of RULES. logs: files and directories of class-load logs.
    """
    old, new = (load_release(spark, r) for r in pair) if pair else (load(spark, old_paths), load(spark, new_paths))
    found = check_libraries(spark, old, new, old_paths, new_paths, classpath, app=app, layer=release)
    return judged(found, rules, evidence.load_logs(spark, logs) if logs else None)
