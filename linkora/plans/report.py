"""Reports as text and JSON. Rows are streamed to the writer in canonical order, one partition at a time, never collected whole."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flags import pretty_member
from ..operators import diff as differ
from ..operators import policy
from .check import Report
from .upgrade import Upgrade

TIERS = ["breaks", "latent", "unproven"]


def diff_report(changes: DataFrame, out: TextIO, as_json: bool = False) -> int:
    """Writes the changes by class, kind and member; returns their number."""
    shown = changes.withColumn("shown", pretty_member("class_name"))
    rows = (r.asDict() for r in shown.orderBy("class_name", "kind", "name", "descriptor").toLocalIterator())
    n = 0
    if as_json:
        out.write('{"breaking_changes": [')
    for r in rows:
        r = {k: v for k, v in r.items() if v is not None and v != []}
        text = r.pop("shown")
        if as_json:
            out.write((", " if n else "") + json.dumps(r, ensure_ascii=False))
        else:
            access = f" ({r['from_access']} -> {r['to_access']})" if "from_access" in r else ""
            out.write(f"{r['kind']}: {text}{access}\n")
        n += 1
    if as_json:
        out.write(f'], "total": {n}}}\n')
    else:
        counts = {r["bucket"]: r["n"] for r in differ.diff_counts(changes).collect()}
        out.write(f"{n} changes: {counts.get('class', 0)} of classes, {counts.get('method', 0)} of methods, {counts.get('field', 0)} of fields\n")
    return n


def _json_rows(violations: DataFrame) -> Iterator[str]:
    fix = [c for c in policy.FIX if c in violations.columns]
    for row in violations.orderBy(*policy.canonical_order(violations), *(["modules"] if "modules" in violations.columns else [])).toLocalIterator():
        r = {k: v for k, v in row.asDict().items() if v is not None and v != []}
        if suggestion := {k: r.pop(k) for k in fix if k in r}:
            r["suggestion"] = suggestion
        yield json.dumps(r, ensure_ascii=False)


def _text(report: Report, counts: dict[str, int], out: TextIO) -> None:
    violations = report.violations.withColumn("shown", pretty_member())
    # A displayed name that stands for several symbols is followed by the descriptor.
    double = policy.name_collisions(report.violations).select("shown", "reason", F.lit(True).alias("double"))
    violations = violations.join(double, ["shown", "reason"], "left")
    for r in violations.orderBy(*policy.canonical_order(violations)).toLocalIterator():
        more = f" {r['descriptor']}" if r["double"] and r["descriptor"] else ""
        loaded = f", loaded by {r['load_trigger']}" if r["load_trigger"] else ", seen loading" if r["observed_loading"] else ""
        out.write(f"[{r['tier']}] {r['reason']}: {r['shown']}{more} used by {r['source_class'].replace('/', '.')} ({r['source']}){loaded}\n")
    if "advice" in report.violations.columns:
        for r in policy.fix_groups(report.violations).orderBy("advice", "removed_by", "before", "after", "referenced_by").toLocalIterator():
            out.write(f"advice: {r['advice']}\n    {r['removed_by']} went from {r['before']} to {r['after']}: {', '.join(r['symbols'])} in {r['classes']} classes\n")
    tiers = {r["tier"]: r for r in policy.tier_counts(report.violations).collect()}
    out.write(", ".join(f"{tiers[t]['n'] if t in tiers else 0} {t}" for t in TIERS) + f"; {sum(r['observed'] for r in tiers.values())} seen loading\n")
    for r in report.unused_rules.toLocalIterator():
        out.write(f"unused rule {r['rule_id']}: {r['reason']}\n")
    for r in report.warnings.distinct().orderBy("error").toLocalIterator():
        out.write(f"warning: {r['error']}\n")
    out.write(", ".join(f"{k.replace('_', ' ')} {v}" for k, v in counts.items()) + "\n")


def check_report(report: Report, out: TextIO, as_json: bool = False) -> dict[str, int]:
    """Writes the violations in canonical order, then the counts, which are returned."""
    counts = report.counts()
    if as_json:
        out.write('{"violations": [')
        for n, text in enumerate(_json_rows(report.violations)):
            out.write((", " if n else "") + text)
        out.write("], " + json.dumps(counts)[1:] + "\n")
    else:
        _text(report, counts, out)
    return counts


def _module_runs(found: Upgrade) -> dict | None:
    if found.plan is None:
        return None
    outcomes = [{"modules": o.modules} | ({"jdk": True} if o.jdk else {}) | {"scanned_classes": o.scanned_classes, "broken": o.broken, "unknown_refs": o.unknown_refs} for o in found.outcomes]
    p = found.plan
    return {"outcomes": outcomes, "total_modules": p.total, "unchanged_modules": p.unchanged, "new_modules": p.new, "incomplete_modules": p.incomplete}


def upgrade_report(found: Upgrade, out: TextIO, as_json: bool = False) -> None:
    """What moved, what each run of modules found, and the violations if anything was checked. Absent parts are left out."""
    runs = _module_runs(found)
    if as_json:
        changes = [{"coordinate": f"{g}:{n}", "kind": kind, "before": b, "after": a} for _, g, n, kind, b, a in found.changes]
        out.write('{"changes": ' + json.dumps(changes, ensure_ascii=False))
        if runs is not None:
            out.write(', "module_runs": ' + json.dumps(runs, ensure_ascii=False))
        if found.report is not None:
            counts = found.report.counts()
            out.write(', "violations": [')
            for n, text in enumerate(_json_rows(found.report.violations)):
                out.write((", " if n else "") + text)
            out.write("]" + "".join(f', "{k}": {counts[k]}' for k in ("scanned_classes", "unknown_refs", "suppressed")))
        out.write("}\n")
        return
    out.write(f"{len(found.changes) or 'no'} dependency changes\n")
    for _, g, n, kind, b, a in found.changes:
        out.write(f"    {kind} {g}:{n} {','.join(b) or '-'} -> {','.join(a) or '-'}\n")
    if runs is not None:
        checked = sum(len(o.modules) for o in found.outcomes if not o.jdk)
        out.write(f"{checked} of {runs['total_modules']} modules changed their versions; {runs['unchanged_modules']} unchanged, {runs['new_modules']} new, {runs['incomplete_modules']} incomplete\n")
        for o in found.outcomes:
            out.write(f"    {', '.join(o.modules)}: {o.scanned_classes} classes, {o.broken} broken, {o.unknown_refs} unverified\n")
        for text in dict.fromkeys(found.plan.warnings):
            out.write(f"warning: {text}\n")
    if found.report is not None:
        check_report(found.report, out)


def fails(report: Report, fail_on: str) -> bool:
    return any(r["fails"] for r in policy.gate(report.violations).where(f"policy = '{fail_on}'").collect())


def draft_excludes(rules: DataFrame, out: TextIO, logs: str = "") -> int:
    """Rules of (owner, name, descriptor, users, more) as TOML; returns their number."""
    quote = lambda s: json.dumps(s, ensure_ascii=False)
    out.write(f"# Drafted rules to review: nothing reaches the classes that use these symbols, and none was seen loading in {logs or 'the logs'}.\n# That no load was seen says nothing about other runs.\n")
    n = 0
    for r in rules.orderBy("owner", "name", "descriptor").toLocalIterator():
        member = "".join(f"{k} = {quote(v)}\n" for k, v in (("member", r["name"]), ("descriptor", r["descriptor"])) if v)
        users = ", ".join(u.replace("/", ".") for u in r["users"]) + (f" and {r['more']} more" if r["more"] else "")
        out.write(f"\n[[exclude]]\nowner = {quote(r['owner'])}\n{member}reason = {quote('review: used only by ' + users + '; not reached and not seen loading')}\n")
        n += 1
    if not n:
        out.write("\n# No rule: every violation is reached, seen loading or latent.\n")
    return n
