"""The upgrade check: what moved between two classpath dumps, one check for each distinct set of inputs, merged into one report.

Dumps, modules and runs are small and planned on the driver; the checks and the merge are DataFrames.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, policy, upgrade
from ..sources import config, jars
from . import check as plans
from .scratch import settle

ARTIFACT = "module string, `group` string, name string, version string, file string, project string"
CHANGE = "change_ord int, `group` string, name string, kind string, before array<string>, after array<string>"


@dataclass
class Run:
    modules: list[str]
    old: list[str]
    new: list[str]
    targets: list[str]
    app: list[str]
    pair: tuple[int, int] | None = None
    changes: list[tuple] = field(default_factory=list)


@dataclass
class Plan:
    runs: list[Run]
    total: int = 0
    unchanged: int = 0
    new: int = 0
    incomplete: int = 0
    warnings: list[str] = field(default_factory=list)


@dataclass
class Outcome:
    modules: list[str]
    jdk: bool
    scanned_classes: int
    unknown_refs: int
    broken: int = 0


@dataclass
class Upgrade:
    changes: list[tuple]
    report: plans.Report | None
    plan: Plan | None
    outcomes: list[Outcome]
    failed: bool


def jdk_pair(before: dict, after: dict) -> tuple[int, int] | None:
    """The releases of both dumps, if both know theirs and they differ."""
    a, b = before["jdk_release"], after["jdk_release"]
    return (a, b) if a and b and a != b else None


def _changes(rows: DataFrame) -> list[tuple]:
    got = rows.orderBy(F.col("kind") == "added", "group", "name").collect()
    return [(i, r["group"], r["name"], r["kind"], r["before"], r["after"]) for i, r in enumerate(got)]


def _targets(module: str, folders: dict[str, list[str]], artifacts: dict[str, list[tuple]], plan: Plan) -> list[str]:
    """A module's outputs, then its artifacts in order; the outputs of its producer stand for an artifact that is not built."""
    out = list(folders.get(module, []))
    for _, _, _, _, file, project in artifacts.get(module, []):
        if os.path.exists(file):
            out.append(file)
        elif project and folders.get(project):
            plan.warnings.append(f"{file} is not built: the class folders of {project} are read instead")
            out += folders[project]
        else:
            plan.warnings.append(f"not found: {file} (needed by {module})")
    return list(dict.fromkeys(out))


def plan_runs(spark: SparkSession, before: dict, after: dict, per_module: bool = True) -> Plan:
    """Which checks the upgrade needs. Modules with the same inputs share one; a change of the JDK is one more for all modules."""
    a, b = (spark.createDataFrame(d["artifacts"], ARTIFACT) for d in (before, after))
    folders: dict[str, list[str]] = {}
    artifacts: dict[str, list[tuple]] = {}
    for m, folder in after["modules"]:
        folders.setdefault(m, []).append(folder)
    for x in after["artifacts"]:
        artifacts.setdefault(x[0], []).append(x)
    everything = list(dict.fromkeys([f for fs in folders.values() for f in fs] + [x[4] for x in after["artifacts"]]))
    roots = list(dict.fromkeys(f for fs in folders.values() for f in fs))
    plan = Plan([])
    if per_module:
        names = list(dict.fromkeys([*after["names"], *folders, *artifacts]))
        listed = spark.createDataFrame([(n,) for n in names], "module string")
        status = {r["module"]: r for r in upgrade.module_plan(listed, a, b).collect()}
        plan.total = len(names)
        for name in names:
            r = status[name]
            if r["status"] != "run":
                setattr(plan, r["status"], getattr(plan, r["status"]) + 1)
                if r["status"] == "incomplete":
                    plan.warnings.append(f"module {name} has no artifacts after the upgrade; it is not checked")
                continue
            run = Run([name], r["old"], r["new"], _targets(name, folders, artifacts, plan), folders.get(name, []))
            same = next((x for x in plan.runs if (x.old, x.new, x.targets, x.app) == (run.old, run.new, run.targets, run.app)), None)
            if same:
                same.modules.append(name)
                continue
            # The module's own changes: its versions, not those that other modules moved.
            now, own = b.where(F.col("module") == name), a.where(F.col("module") == name)
            if not any(x[0] == name for x in before["artifacts"]):
                own = a.join(now.select("group", "name").distinct(), ["group", "name"], "left_semi")
            run.changes = _changes(upgrade.dependency_diff(own, now))
            plan.runs.append(run)
    else:
        moved = upgrade.jars(upgrade.dependency_diff(a, b), a, b).select("side", "group", "name", "version", "file").distinct().orderBy("group", "name", "version", "file").collect()
        files = {side: list(dict.fromkeys(r["file"] for r in moved if r["side"] == side)) for side in ("old", "new")}
        if files["old"]:
            plan.runs.append(Run([], files["old"], files["new"], everything, roots, changes=_changes(upgrade.dependency_diff(a, b))))
    if pair := jdk_pair(before, after):
        plan.runs.append(Run([f"JDK {pair[0]} -> {pair[1]}"], [], [], everything, roots, pair))
    return plan


def annotate(spark: SparkSession, violations: DataFrame, run: Run, before: dict, after: dict) -> DataFrame:
    """Which change explains a violation and what to do, from the old JARs of the run's changes."""
    a, b = (spark.createDataFrame(d["artifacts"], ARTIFACT) for d in (before, after))
    moved = {(g, n): o for o, g, n, kind, *_ in run.changes if kind != "added"}
    held = [(x[4], moved[x[1], x[2]]) for x in before["artifacts"] if (x[1], x[2]) in moved]
    listed = jars.names(spark, sorted({f for f, _ in held if os.path.exists(f)})).select("class_name", F.col("source").alias("file"))
    owners = upgrade.attribution(listed, spark.createDataFrame(sorted(set(held)), "file string, change_ord int"))
    files = upgrade.coordinates(a, b)
    gone = {(g, n) for _, g, n, kind, *_ in run.changes if kind == "removed"}
    optional: list[tuple] = []
    if gone:
        coordinate = {x[4]: f"{x[1]}:{x[2]}:{x[3]}" for x in [*after["artifacts"], *before["artifacts"]] if x[1]}
        optional = [(f, g, n) for f, c in coordinate.items() for g, n in config.read_optional(f, c) & gone]
    return upgrade.suggestions(violations, owners, spark.createDataFrame(run.changes, CHANGE), files, spark.createDataFrame(optional, "source string, `group` string, name string"))


def upgrade_check(spark: SparkSession, before: dict, after: dict, *, merged: bool = False, layer: int | None = None, rules: Sequence[tuple] = (), logs: Sequence[str] = (), fail_on: str = "any") -> Upgrade:
    """before, after: rows of `jars.load_dump`. merged: one run over the whole classpath even where the dumps know modules."""
    a, b = (spark.createDataFrame(d["artifacts"], ARTIFACT) for d in (before, after))
    changes = _changes(upgrade.dependency_diff(a, b))
    per_module = not merged and before["per_module"] and after["per_module"] and bool(before["artifacts"]) and bool(after["artifacts"])
    plan = plan_runs(spark, before, after, per_module)
    if not plan.runs:
        return Upgrade(changes, None, plan if per_module else None, [], False)
    # Runs with the same JARs on a side share its parsed library.
    libraries: dict[tuple, plans.Library] = {}

    def library(paths: list[str]) -> plans.Library:
        if (key := tuple(paths)) not in libraries:
            libraries[key] = plans.load(spark, paths)
        return libraries[key]

    parts, outcomes, verdicts, reports = [], [], [], []
    for n, run in enumerate(plan.runs):
        old, new = (plans.load_release(spark, r) for r in run.pair) if run.pair else (library(run.old), library(run.new))
        # A flat JDK run gets no layer, since the releases are the two sides themselves.
        r = plans.check_libraries(spark, old, new, run.old, run.new, run.targets, app=run.app, layer=None if run.pair and not per_module else layer)
        reports.append(r)
        # The flat mode counts the classes of one classpath once.
        scanned = 0 if run.pair and not per_module else r.scanned_classes
        outcomes.append(Outcome(run.modules, run.pair is not None, scanned, r.verdicts.where("verdict = 'unknown'").count()))
        found = annotate(spark, r.violations, run, before, after)
        parts.append(found.withColumn("run_id", F.lit(n)).withColumn("axis", F.lit(bool(r.axis))).withColumn("module", F.explode(F.array(*[F.lit(m) for m in run.modules or [""]]))))
        verdicts.append(r.verdicts.withColumn("module", F.lit(",".join(run.modules) or None).cast("string")))
    runs = settle(reduce(DataFrame.unionByName, parts))
    found = settle(policy.merge_runs(runs, tuple(policy.FIX)))
    axes = [r.axis for r in reports]
    axis = False if any(x is False for x in axes) else True if any(axes) else None
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    whole = plans.Report(found, union(verdicts), reports[0].suppressed, reports[0].unused_rules, sum(o.scanned_classes for o in outcomes), union([r.warnings for r in reports]), axis)
    whole = plans.judged(whole, rules, evidence.load_logs(spark, logs) if logs else None)
    kept = whole.violations
    ids = spark.createDataFrame([(n, run.modules or [""]) for n, run in enumerate(plan.runs)], "run_id int, modules array<string>")
    broken = {r["run_id"]: r["broken"] for r in policy.run_counts(kept, ids).collect()}
    failed = False
    for n, (o, r) in enumerate(zip(outcomes, reports)):
        o.broken = broken[n]
        # Each run fails by its own roots: where they match nothing, no violation is unproven.
        mine = kept.where(F.arrays_overlap("modules", F.array(*[F.lit(m) for m in plan.runs[n].modules or [""]]))).withColumn("tier", policy.tier(axis=F.lit(bool(r.axis))))
        failed = failed or any(x["fails"] for x in policy.gate(mine).where(f"policy = '{fail_on}'").collect())
    if not per_module:
        whole.violations = kept.drop("modules")
    return Upgrade(changes, whole, plan if per_module else None, outcomes, failed)
