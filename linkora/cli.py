"""Command line: diff, check, upgrade-check and dump. Exit code 0: clean, 1: the gate fails, 2: an error."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .operators import evidence
from .plans import check as plans
from .plans import report, upgrade
from .sources import config, jars


def _release(text: str) -> int:
    n = int(text)
    if not 8 <= n <= 35:
        raise argparse.ArgumentTypeError("a release from 8 to 35")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="linkora")
    sub = top.add_subparsers(dest="command", required=True)
    diff = sub.add_parser("diff")
    diff.add_argument("old")
    diff.add_argument("new")
    diff.add_argument("--json", action="store_true")
    check, up = sub.add_parser("check"), sub.add_parser("upgrade-check")
    for name in ("--old", "--new"):
        check.add_argument(name, action="append", default=[])
    check.add_argument("--classpath", action="append", default=[])
    check.add_argument("--classpath-file", action="append", default=[], help="a classpath dump, or a text file of paths")
    check.add_argument("--app", action="append", default=[])
    for name in ("--jdk-release-old", "--jdk-release-new"):
        check.add_argument(name, type=_release, help="compare two JDK releases instead of --old and --new")
    up.add_argument("--before", required=True)
    up.add_argument("--after", required=True)
    up.add_argument("--merged", action="store_true", help="one run over the whole classpath instead of one for each changed module")
    for p in (check, up):
        p.add_argument("--exclude-file", action="append", default=[])
        p.add_argument("--class-load-log", action="append", default=[])
        p.add_argument("--draft-exclude-file")
        p.add_argument("--verdicts-json", help="folder of JSON lines, one for each reference")
        p.add_argument("--jdk-release", type=_release, help="resolve what leads out of the classpath in the API of this release")
        p.add_argument("--fail-on", choices=["never", "reachable", "any"], default="any")
        p.add_argument("--json", action="store_true")
    sub.add_parser("dump").add_argument("path")
    return top


def validated(args: argparse.Namespace) -> argparse.Namespace:
    """Raises ValueError on arguments that contradict each other."""
    if args.command in ("check", "upgrade-check") and args.draft_exclude_file and not args.class_load_log:
        raise ValueError("--draft-exclude-file needs --class-load-log")
    if args.command == "check":
        pair = (args.jdk_release_old, args.jdk_release_new)
        if (pair[0] is None) != (pair[1] is None):
            raise ValueError("--jdk-release-old and --jdk-release-new go together")
        if pair[0] is not None and (args.old or args.new):
            raise ValueError("--jdk-release-old and --jdk-release-new take the place of --old and --new")
        if pair[0] is None and not (args.old and args.new):
            raise ValueError("--old and --new are required")
    return args


def _listed(path: str) -> tuple[list[str], list[str]]:
    """(paths, build outputs) of a classpath file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if not text.lstrip().startswith("{"):
        return text.split(), []
    dump = jars.load_dump(path)
    outputs = [folder for _, folder in dump["modules"]]
    return outputs + [x[4] for x in dump["artifacts"]], outputs


def run(spark: SparkSession, argv: list[str], out=sys.stdout) -> int:
    args = validated(parser().parse_args(argv))
    if args.command == "diff":
        report.diff_report(plans.diff_paths(spark, [args.old], [args.new]), out, args.json)
        return 0
    if args.command == "dump":
        for r in plans.load(spark, [args.path]).members.orderBy("class_name", "name", "descriptor").toLocalIterator():
            out.write(f"{r['class_name']} {r['mkind']} {r['name']} {r['descriptor']} {r['access']:#06x}\n")
        return 0
    rules = [r for f in args.exclude_file for r in config.exclude_rules(open(f, encoding="utf-8").read())]
    rules = [(i, *r[1:]) for i, r in enumerate(rules)]
    if args.draft_exclude_file:
        # A run that fails leaves this, never the draft of an earlier one.
        with open(args.draft_exclude_file, "w", encoding="utf-8") as f:
            f.write("# The check did not end; nothing was drafted.\n")
    if args.command == "check":
        listed, app = [x for c in args.classpath for x in c.split(":") if x], list(args.app)
        for f in args.classpath_file:
            paths, outputs = _listed(f)
            listed += paths
            app += outputs
        pair = None if args.jdk_release_old is None else (args.jdk_release_old, args.jdk_release_new)
        found = plans.check(spark, args.old, args.new, listed + app, app=app, release=args.jdk_release, pair=pair, rules=rules, logs=args.class_load_log)
        report.check_report(found, out, args.json)
        failed = report.fails(found, args.fail_on)
    else:
        moved = upgrade.upgrade_check(spark, jars.load_dump(args.before), jars.load_dump(args.after), merged=args.merged, layer=args.jdk_release, rules=rules, logs=args.class_load_log, fail_on=args.fail_on)
        report.upgrade_report(moved, out, args.json)
        found, failed = moved.report, moved.failed
    if args.verdicts_json:
        verdicts = found.verdicts if found else spark.createDataFrame([], "source string, source_class string, verdict string")
        verdicts.write.mode("overwrite").json(args.verdicts_json)
    if args.draft_exclude_file:
        empty = "owner string, name string, descriptor string, users array<string>, more int"
        rows = evidence.draft_rules(found.violations) if found else spark.createDataFrame([], empty)
        with open(args.draft_exclude_file, "w", encoding="utf-8") as f:
            report.draft_excludes(rows, f, ", ".join(map(os.fspath, args.class_load_log)))
    return int(failed)


def main() -> int:
    try:
        args = sys.argv[1:]
        validated(parser().parse_args(args))
        return run(SparkSession.builder.appName("linkora").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate(), args)
    except (OSError, ValueError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
