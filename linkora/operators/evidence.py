"""Class-load evidence from run-time logs: parsing, promotion of violations, drafts of exclude rules."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A longer line is no log line (a binary among the logs): it is read in parts, ends a block and names nothing.
LINE = 64 * 1024
DECORATOR = re.compile(r"\[([^\]]*)\]\s*")
# A name: segments that begin with an ASCII letter, _ , $ or any other non-ASCII character.
SEGMENT = r"[A-Za-z_$\u0080-\U0010ffff][A-Za-z0-9_$\u0080-\U0010ffff]*"
NAME = re.compile(rf"{SEGMENT}(?:[./]{SEGMENT})*")
# Frames of class loading itself, by package and by method, and of the interfaces that load by name.
LOADER_PACKAGES = ("java.lang.ClassLoader.", "java.security.SecureClassLoader.", "java.net.URLClassLoader.", "jdk.internal.loader.")
LOADER_METHODS = frozenset(["loadClass", "findClass", "defineClass"])
REFLECTIVE = ("java.lang.Class.forName", "java.util.ServiceLoader", "java.lang.reflect.", "jdk.internal.reflect.", "sun.reflect.", "java.lang.invoke.")
RECORD = "file_ord long, line long, class_name string, stacked boolean, trigger string"


def class_name(text: str, trusted: bool) -> str | None:
    """The internal name, or None. Only a trusted text may be a single word, since any stray word looks like one."""
    if not NAME.fullmatch(text) or not trusted and not re.search("[./]", text):
        return None
    return text.replace(".", "/")


def is_machinery(frame: str) -> bool:
    return frame.startswith(LOADER_PACKAGES) or frame.split("(")[0].rsplit(".", 1)[-1] in LOADER_METHODS


def trigger(frames: Iterable[str]) -> str | None:
    """The first frame that is no class loading; of a reflective one the call without its place, and the first frame behind it that is not."""
    useful = [f for f in frames if not is_machinery(f)]
    if not useful or not useful[0].startswith(REFLECTIVE):
        return useful[0] if useful else None
    caller = next((f for f in useful if not f.startswith(REFLECTIVE)), None)
    return f"{useful[0].split('(')[0]} from {caller}" if caller else useful[0]


def _tags(line: str) -> tuple[set[str], bool, str]:
    """(what the decorators say: ours, foreign, native; the rest of the line). Only a decorator of several tags names a stream."""
    said, rest = set(), line.lstrip()
    while m := DECORATOR.match(rest):
        if "," in m[1]:
            tags = {t.strip() for t in m[1].split(",")}
            said.add("ours" if {"class", "load"} <= tags else "foreign")
            if "native" in tags:
                said.add("native")
        rest = rest[m.end() :]
    return said, rest.strip()


def parse_lines(lines: Iterable[str | None]) -> Iterator[tuple[int, str, bool, str | None]]:
    """(line, class, stacked, trigger) of the lines of one file; None stands for a line that is too long.

    A header opens a block of frames; lines of other streams and monitor lines are skipped as if they were not there; anything else and
    the end close it. A header records the class as loaded, and a block with frames records a stack at the place of its header.
    """
    block: tuple[int, str, list[str]] | None = None

    def closed() -> Iterator[tuple[int, str, bool, str | None]]:
        nonlocal block
        if block and block[2]:
            yield block[0], block[1], True, trigger(block[2])
        block = None

    for n, line in enumerate(lines):
        if line is None:
            yield from closed()
            continue
        said, rest = _tags(line.rstrip())
        ours = "ours" in said
        if "foreign" in said and not ours:
            continue
        if m := re.match("(Java|Native) stack when loading (.*)", rest, re.S):
            yield from closed()
            if name := class_name(m[2].rstrip(":"), True):
                yield n, name, False, None
                block = (n, name, []) if m[1] == "Java" else None
            continue
        if "native" in said:
            continue
        if rest.startswith("at "):
            if block:
                block[2].append(rest[3:].strip())
            continue
        if block and rest.startswith("- "):
            continue
        yield from closed()
        word = rest.split(maxsplit=1)[0].rstrip(":,;") if rest else ""
        if word and (name := class_name(word, ours)):
            yield n, name, False, None
    yield from closed()


def parse_log(text: str) -> Iterator[tuple[int, str, bool, str | None]]:
    return parse_lines(None if len(x) >= LINE else x for x in text.split("\n"))


def file_lines(path: str) -> Iterator[str | None]:
    """The lines of a file in bounded memory."""
    with open(path, "rb") as f:
        while raw := f.readline(LINE):
            if len(raw) == LINE and not raw.endswith(b"\n"):
                while (more := f.readline(LINE)) and not more.endswith(b"\n"):
                    pass
                yield None
            else:
                yield raw.decode("utf-8", "replace")


def log_files(paths: Iterable[str]) -> list[str]:
    """Files as they are named; of a directory all files below it, by name, but for recordings (.jfr)."""
    out = []
    for path in paths:
        if not os.path.isdir(path):
            out.append(path)
            continue
        seen = set()

        def walk(folder: str) -> Iterator[str]:
            if (real := os.path.realpath(folder)) in seen:  # noqa: B023
                raise ValueError(f"{folder}: a link leads back to a directory above it")
            seen.add(real)  # noqa: B023
            for x in sorted(os.scandir(folder), key=lambda x: x.name):
                if x.is_dir():
                    yield from walk(x.path)
                elif x.is_file() and not x.name.endswith(".jfr"):
                    yield x.path
            seen.discard(real)  # noqa: B023

        out += walk(path)
    return out


def _records(file_ord: int, found: Iterable[tuple[int, str, bool, str | None]]) -> Iterator[pa.RecordBatch]:
    names, types = [x.split()[0] for x in RECORD.split(", ")], (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)], names=names)

    for n, c, s, t in found:
        rows.append((file_ord, n, c, s, t))
        if len(rows) >= 50_000:
            yield batch()
            rows.clear()
    yield batch()


def first_records(rows: DataFrame) -> DataFrame:
    """(class_name, stacked, trigger): one record a class. The first stack with frames counts, whatever its trigger; else it was just loaded."""
    stack = F.min(F.when(F.col("stacked"), F.struct("file_ord", "line", "trigger")))
    return rows.groupBy("class_name").agg(stack.alias("s")).select("class_name", F.col("s").isNotNull().alias("stacked"), F.col("s.trigger").alias("trigger"))


def load_records(files: DataFrame) -> DataFrame:
    """files (file_ord, text) -> one record a class."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for o, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from _records(o, parse_log(text or ""))

    return first_records(files.select(F.col("file_ord").cast("long").alias("file_ord"), "text").mapInArrow(parse, RECORD))


def load_logs(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """One record a class of the log files and directories, each file read by one task from a path that all executors share."""
    files = log_files(paths)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for o, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from _records(o, parse_lines(file_lines(path)))

    listed = spark.createDataFrame(list(enumerate(files)), "file_ord long, path string")
    return first_records(listed.repartition(max(1, len(files)), "file_ord").mapInArrow(parse, RECORD))


def promote(violations: DataFrame, records: DataFrame) -> DataFrame:
    """observed_loading and load_trigger by the referencing class; what an earlier record set is never cleared."""
    r = records.select(F.col("class_name").alias("source_class"), F.lit(True).alias("seen"), "trigger")
    out = violations.join(r, "source_class", "left")
    had = lambda c, none: F.coalesce(F.col(c), none) if c in violations.columns else none
    return out.withColumn("observed_loading", had("observed_loading", F.lit(False)) | F.coalesce("seen", F.lit(False))).withColumn("load_trigger", F.coalesce("trigger", had("load_trigger", F.lit(None).cast("string")))).drop("seen", "trigger")


def draft_rules(violations: DataFrame, users: int = 3, tier: str | Column = "tier") -> DataFrame:
    """(owner, name, descriptor, users, more): symbols of which every violation is unproven, with the first users and how many more there are.

    A bare class is a wider rule, so it is drafted only if no symbol of that owner is undraftable.
    """
    names = F.collect_set("source_class")
    sym = violations.groupBy("owner", "name", "descriptor").agg(F.bool_and((F.col(tier) if isinstance(tier, str) else tier) == "unproven").alias("ok"), names.alias("all"))
    bad = sym.where("not ok").select("owner").distinct()
    out = sym.where("ok").join(bad.withColumn("bad", F.lit(True)), "owner", "left").where("name is not null or bad is null")
    return out.select("owner", "name", "descriptor", F.slice(F.sort_array("all"), 1, users).alias("users"), F.greatest(F.size("all") - users, F.lit(0)).alias("more"))
