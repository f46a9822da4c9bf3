"""Sources of class files: JARs, directories, JDK release archives and jmods, and service files, as DataFrames.

One task reads one archive from a path that all executors share; entries are streamed, so memory is bounded by the largest class. What
can't be read, an archive or an entry of it, becomes a row with an error and stops nothing.
"""

from __future__ import annotations

import json
import os
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scopes import crc_first
from .classfile import MAGIC, ClassFormatError, parse

ENTRY = "source string, path_ord int, entry_name string, entry_ord int, crc32 long, is_dir boolean, bytes binary, error string"
NAME = "source string, path_ord int, class_name string, entry_ord int, crc32 long, is_dir boolean"
MEMBER = "struct<mkind:string,name:string,descriptor:string,access:int>"
REF = "struct<kind:string,owner:string,name:string,descriptor:string,expected_static:boolean,field_write:boolean,instantiated:boolean>"
CLASS = f"source string, path_ord int, entry_ord int, class_name string, access int, super_name string, interfaces array<string>, nest_host string, permitted array<string>, sealing_unknown boolean, members array<{MEMBER}>, refs array<{REF}>, loads array<string>, calls array<struct<owner:string,name:string,descriptor:string>>, error string"
BROKEN = (OSError, EOFError, RuntimeError, NotImplementedError, zipfile.BadZipFile, zlib.error)
NONE = {"class_name": None, "access": None, "super_name": None, "interfaces": [], "nest_host": None, "permitted": None, "sealing_unknown": False, "members": [], "refs": [], "loads": [], "calls": []}


def _wanted(name: str) -> bool:
    base = name.rsplit("/", 1)[-1]
    return name.endswith(".class") and base != "module-info.class" and not name.startswith("META-INF/versions/") or name.startswith("META-INF/services/") and name.count("/") == 2 and bool(base)


def release_code(release: int) -> str:
    """The digit by which a ct.sym archive names a release."""
    if not 8 <= release <= 35:
        raise ValueError(f"release {release} is not in 8..35")
    return "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[release]


def stub_entry(name: str) -> tuple[str, str] | None:
    """(release codes, class name) of a ct.sym entry: `codes/[module/]class.sig`; a module has a dot in its name."""
    codes, _, rest = name.partition("/")
    if not re.fullmatch("[0-9A-Z]+", codes) or not rest.endswith(".sig"):
        return None
    first, _, tail = rest.partition("/")
    found = (tail if tail and "." in first else rest)[: -len(".sig")]
    return None if found == "module-info" else (codes, found)


def _listed(z: zipfile.ZipFile, path: str, release: int | None) -> Iterator[tuple[str, int, zipfile.ZipInfo]]:
    """(name, order, entry) by place in the archive: the view of one release of a ct.sym archive, `classes/` of a jmod."""
    code = None if release is None else release_code(release)
    for n, info in enumerate(sorted(z.infolist(), key=lambda x: x.header_offset)):
        name = info.filename
        if code is not None:
            stub = stub_entry(name)
            if not stub or code not in stub[0]:
                continue
            name = stub[1] + ".class"
        elif path.endswith(".jmod"):
            if not name.startswith("classes/"):
                continue
            name = name[len("classes/") :]
        if _wanted(name):
            yield name, n, info


def archive_entries(path: str, release: int | None = None, only: set[int] | None = None) -> Iterator[tuple[str, int, int, bytes | None, str | None]]:
    """(name, order, crc, bytes, error). only: the orders to read, others are skipped unread."""
    try:
        with zipfile.ZipFile(path) as z:
            for name, n, info in _listed(z, path, release):
                if only is None or n in only:
                    try:
                        yield name, n, info.CRC, z.read(info), None
                    except BROKEN as e:
                        yield name, n, info.CRC, None, f"{path}!{name}: {e}"
    except BROKEN as e:
        yield "", -1, 0, None, f"{path}: {e}"


def directory_entries(path: str) -> Iterator[tuple[str, int, int, bytes | None, str | None]]:
    n = 0
    for folder, names, files in os.walk(path):
        names.sort()
        for f in sorted(files):
            full = os.path.join(folder, f)
            name = os.path.relpath(full, path).replace(os.sep, "/")
            if _wanted(name):
                try:
                    with open(full, "rb") as h:
                        yield name, n, 0, h.read(), None
                except OSError as e:
                    yield name, n, 0, None, f"{full}: {e}"
                n += 1


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(paths)), "ord int, path string").repartition(max(1, len(paths)), "path")


def names(spark: SparkSession, paths: list[str], release: int | None = None) -> DataFrame:
    """(source, path_ord, class_name, entry_ord, crc32, is_dir): classes by name, from the directory of an archive alone; nothing is inflated."""
    columns = [c.split()[0] for c in NAME.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, order in zip(batch["path"], batch["ord"]):
                rows = []
                try:
                    if os.path.isdir(path):
                        rows = [(path, order, name[: -len(".class")], n, 0, True) for name, n in _directory_names(path)]
                    else:
                        with zipfile.ZipFile(path) as z:
                            rows = [(path, order, name[: -len(".class")], n, info.CRC, False) for name, n, info in _listed(z, path, release) if name.endswith(".class")]
                except BROKEN:
                    pass  # reading reports it
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return _files(spark, paths).mapInPandas(read, NAME) if paths else spark.createDataFrame([], NAME)


def _directory_names(path: str) -> Iterator[tuple[str, int]]:
    n = 0
    for folder, subs, files in os.walk(path):
        subs.sort()
        for f in sorted(files):
            name = os.path.relpath(os.path.join(folder, f), path).replace(os.sep, "/")
            if _wanted(name):
                if name.endswith(".class"):
                    yield name, n
                n += 1


def _read(rows: DataFrame, release: int | None) -> DataFrame:
    """(ord, path[, only]) -> entries."""
    columns = [c.split()[0] for c in ENTRY.split(", ")]
    limited = "only" in rows.columns

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, (path, order) in enumerate(zip(batch["path"], batch["ord"])):
                out, size, folder = [], 0, os.path.isdir(path)
                found = directory_entries(path) if folder else archive_entries(path, release, set(batch["only"][k]) if limited else None)
                for name, n, crc, data, error in found:
                    if data is not None and name.endswith(".class") and data[:4] != MAGIC:
                        continue
                    out.append((path, order, name, n, crc, folder, data, error))
                    size += len(data or b"")
                    if size > 8_000_000:
                        yield pd.DataFrame(out, columns=columns)
                        out, size = [], 0
                if out:
                    yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(read, ENTRY)


def entries(spark: SparkSession, paths: list[str], release: int | None = None) -> DataFrame:
    """Entries of the archives and directories in path order: classes and service files."""
    return _read(_files(spark, paths), release) if paths else spark.createDataFrame([], ENTRY)


def unique_entries(spark: SparkSession, paths: list[str], release: int | None = None) -> DataFrame:
    """Class entries without the further copies of a class with the same checksum, which are never inflated. Directories are read whole."""
    if not paths:
        return spark.createDataFrame([], ENTRY)
    first = crc_first(names(spark, paths, release).where("not is_dir"))
    only = first.groupBy(F.col("path_ord").alias("ord"), F.col("source").alias("path")).agg(F.collect_list("entry_ord").alias("only"))
    listed = _files(spark, paths).join(only, ["ord", "path"], "left").withColumn("only", F.coalesce("only", F.array().cast("array<int>")))
    return _read(listed.repartition(max(1, len(paths)), "path"), release)


def parsed(found: DataFrame, owners: Iterable[str] | None = None) -> DataFrame:
    """Class rows with nested members, references, loads and calls; what can't be read has an error instead.

    owners: a bounded set of class names, sent to the tasks once; references to other owners are dropped in the parser already.
    """
    shared = None if owners is None else found.sparkSession.sparkContext.broadcast(frozenset(owners))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for source, path_ord, entry_ord, data, error in zip(batch["source"], batch["path_ord"], batch["entry_ord"], batch["bytes"], batch["error"]):
                row = NONE | {"error": error}
                if data is not None:
                    try:
                        row = parse(bytes(data)) | {"error": None}
                    except ClassFormatError as e:
                        row = NONE | {"error": str(e)}
                    if shared is not None:
                        row["refs"] = [r for r in row["refs"] if r["owner"] in shared.value]
                    if source.endswith(".jmod"):
                        # Release stubs have no permits, so platform classes are compared without them.
                        row["permitted"], row["sealing_unknown"] = None, False
                out.append({"source": source, "path_ord": path_ord, "entry_ord": entry_ord} | row)
            if out:
                yield pd.DataFrame(out)

    wanted = found.where(F.col("entry_name").endswith(".class") | F.col("error").isNotNull())
    return wanted.select("source", "path_ord", "entry_ord", "bytes", "error").mapInPandas(read, CLASS)


def release_closure(spark: SparkSession, ct_sym: str, release: int, roots: DataFrame) -> DataFrame:
    """Class rows of the roots (class_name) that the release has, and of everything above them.

    Only these stubs are inflated and parsed: one task walks up from the roots by name. Roots are matched with the names of the archive
    first, so what it is given is bounded by the size of the release.
    """
    known = names(spark, [ct_sym], release).select("class_name").distinct()
    start = [r["class_name"] for r in roots.select("class_name").distinct().join(known, "class_name", "left_semi").collect()]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            with zipfile.ZipFile(ct_sym) as z:
                at = {name[: -len(".class")]: (n, info) for name, n, info in _listed(z, ct_sym, release)}
                todo, seen, out = sorted(start), set(start), []
                for name in todo:
                    n, info = at[name]
                    try:
                        row = parse(z.read(info)) | {"error": None}
                    except (*BROKEN, ClassFormatError) as e:
                        row = NONE | {"error": f"{ct_sym}!{name}: {e}"}
                    out.append({"source": ct_sym, "path_ord": 0, "entry_ord": n} | row)
                    for up in [*row["interfaces"], row["super_name"]]:
                        if up in at and up not in seen and up != "java/lang/Object":
                            seen.add(up)
                            todo.append(up)
                    if len(out) >= 500:
                        yield pd.DataFrame(out)
                        out = []
                if out:
                    yield pd.DataFrame(out)

    return spark.range(1, numPartitions=1).mapInPandas(walk, CLASS) if start else spark.createDataFrame([], CLASS)


def class_api(classes: DataFrame) -> DataFrame:
    return classes.where("class_name is not null").select("class_name", "source", "path_ord", "entry_ord", "access", "super_name", "interfaces", "nest_host", "permitted", "sealing_unknown")


def members(classes: DataFrame) -> DataFrame:
    return classes.select("class_name", F.explode("members").alias("m")).select("class_name", "m.*")


def symbol_refs(classes: DataFrame) -> DataFrame:
    return classes.select("source", F.col("class_name").alias("source_class"), F.explode("refs").alias("r")).select("source", "source_class", "r.*")


def load_edges(classes: DataFrame) -> DataFrame:
    return classes.select(F.col("class_name").alias("src"), F.explode("loads").alias("dst")).distinct()


def invocations(classes: DataFrame) -> DataFrame:
    return classes.select(F.explode("calls").alias("c")).select("c.*").distinct()


def services(found: DataFrame) -> DataFrame:
    """(iface, provider, source, path_ord, entry_ord, ord) of META-INF/services files: # begins a comment, dots become slashes."""
    text = F.expr("try_validate_utf8(cast(bytes as string))")
    files = found.where(F.col("entry_name").startswith("META-INF/services/") & F.col("error").isNull())
    lines = files.select("source", "path_ord", "entry_ord", F.translate(F.substring_index("entry_name", "/", -1), ".", "/").alias("iface"), F.posexplode(F.split(text, "[\\r\\n]")).alias("ord", "line"))
    out = lines.withColumn("provider", F.translate(F.trim(F.substring_index("line", "#", 1)), ".", "/"))
    return out.where("provider <> ''").select("iface", "provider", "source", "path_ord", "entry_ord", "ord")


def load_dump(path: str) -> dict[str, list]:
    """A classpath dump of version 1 or 2 as rows: modules (module, classes_dir) and artifacts (module, group, name, version, file, project)."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    modules, artifacts = [], []
    if d.get("version") == 2:
        full = lambda x: d["roots"][x["root"]] + x["path"]
        for m in d["modules"]:
            modules += [(m.get("module"), full(c)) for c in m.get("classesDirs", [])]
            for i in m.get("artifactRefs", []):
                if not 0 <= i < len(d["artifacts"]):
                    raise ValueError(f"artifact {i} is not in the dump")
                a = d["artifacts"][i]
                artifacts.append((m.get("module"), a.get("group"), a.get("name"), a.get("version"), full(a), a.get("project")))
    else:
        for m in d["modules"]:
            modules += [(m.get("module"), c) for c in m.get("classesDirs", [])]
            artifacts += [(m.get("module"), a.get("group"), a.get("name"), a.get("version"), a["file"], a.get("project")) for a in m.get("artifacts", [])]
    named = all(m.get("module") for m in d["modules"])
    return {"modules": modules, "artifacts": artifacts, "names": [m["module"] for m in d["modules"]] if named else [], "per_module": named, "jdk_release": d.get("jdkRelease")}


def write_dump(path: str, modules: list[tuple], artifacts: list[tuple], jdk_release: int | None = None) -> None:
    """The rows of `load_dump` as a dump of version 2: every artifact once, and folders in a root table."""
    roots: dict[str, int] = {}

    def place(full: str) -> dict[str, object]:
        folder, _, name = full.rpartition("/")
        root = f"{folder}/" if folder or full.startswith("/") else ""
        return {"root": roots.setdefault(root, len(roots)), "path": name}

    listed: dict[tuple, int] = {}
    out: dict[str | None, dict] = {}
    for module, *_ in [*modules, *artifacts]:
        out.setdefault(module, {} if module is None else {"module": module}).update({"classesDirs": [], "artifactRefs": []})
    for module, folder in modules:
        out[module]["classesDirs"].append(place(folder))
    for module, *artifact in artifacts:
        ref = listed.setdefault(tuple(artifact), len(listed))
        if ref not in out[module]["artifactRefs"]:
            out[module]["artifactRefs"].append(ref)
    rows = [{k: v for k, v in (("group", g), ("name", n), ("version", v), ("project", p)) if v is not None} | place(f) for g, n, v, f, p in listed]
    dump = {"version": 2, "roots": list(roots), "artifacts": rows, "modules": list(out.values())} | ({} if jdk_release is None else {"jdkRelease": jdk_release})
    with open(path, "w", encoding="utf-8") as f:
        json.dump(dump, f)
