"""Closures over class hierarchies: supertypes, superclass chains, and the ordered searches of field and method resolution.

A hierarchy of up to LOCAL_EDGES edges, which is counted first, is sent to the tasks as arrays (`hierarchy`), and searched there for many
starts at once. A larger one is walked level by level with joins, for all starts at once; both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flags import INTERFACE, OBJECT, has, is_object_method
from ..plans.scratch import drop, settle
from .hierarchy import Hierarchy, Packed, flat, pack, resolve

# About 30 bytes an edge on the driver and in each Python worker, and 150 in the task that makes the arrays.
LOCAL_EDGES = 6_000_000
EDGES = ["class_name", "super_name", "interfaces"]
# Keys of members are dealt by their hash over so many groups.
GROUPS = 256


def prefer(first: DataFrame, second: DataFrame) -> DataFrame:
    """The edges of the classes of both tables; a class of both has those of the first."""
    return first.select(*EDGES).unionByName(second.select(*EDGES).join(first.select("class_name"), "class_name", "left_anti"))


def super_edges(classes: DataFrame) -> DataFrame:
    """(class_name, up, ord): interfaces in order, then the superclass. Object is no edge."""
    ups = classes.select("class_name", F.posexplode(F.concat(F.coalesce("interfaces", F.array().cast("array<string>")), F.array("super_name"))).alias("ord", "up"))
    return ups.where(F.col("up").isNotNull() & (F.col("up") != OBJECT))


class Local:
    """A hierarchy that the tasks read; tall: it has heights."""

    def __init__(self, packed: Packed, shared: Broadcast):
        self.shared, self.tall = shared, packed.tall


def local_hierarchy(classes: DataFrame, most: int) -> Local | None:
    """The hierarchy as arrays, or None if it has more than `most` edges. Made once for a DataFrame."""
    if getattr(classes, "_hierarchy", (None,))[0] != most:
        classes._hierarchy = (most, _hierarchy(classes, most))
    return classes._hierarchy[1]


def _hierarchy(rows: DataFrame, most: int) -> Local | None:
    if most <= 0:
        return None
    own = F.filter(F.coalesce("interfaces", F.array().cast("array<string>")), lambda f: f.isNotNull() & (f != OBJECT))
    face = [has("access", INTERFACE).alias("face")] if "access" in rows.columns else []
    rows = settle(rows.where("class_name is not null").select("class_name", *face, F.when(F.col("super_name") != OBJECT, F.col("super_name")).alias("super_name"), own.alias("interfaces")))
    size = rows.agg(F.sum(F.lit(1) + F.size("interfaces")).alias("n")).first()["n"]
    if (size or 0) > most:
        drop(rows)
        return None
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, part in enumerate(pack(Hierarchy.of(pa.Table.from_batches(batches, kinds)))):
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([part], pa.binary())], names=["i", "part"])

    kinds = pa.schema([("class_name", pa.string()), ("super_name", pa.string()), ("interfaces", pa.list_(pa.string())), *([("face", pa.bool_())] if face else [])])
    # One task makes the arrays of a hierarchy that is small enough for every task.
    parts = settle(rows.select(*kinds.names).repartition(1).mapInArrow(make, "i int, part binary"))
    got = [bytes(r["part"]) for r in sorted(parts.toLocalIterator(), key=lambda r: r["i"])]
    # Of a table without rows there may be no task.
    packed = Packed(got or list(pack(Hierarchy.of(kinds.empty_table()))))
    drop(rows)
    drop(parts)
    return Local(packed, rows.sparkSession.sparkContext.broadcast(packed))


def _walked(starts: DataFrame, h: Local, visit: Callable[[Hierarchy, int], Iterator[tuple]], columns: str) -> DataFrame:
    """starts (class_name) -> (start, class_name, columns..., in_scope), one start at a time; visit yields (class, *columns)."""
    shared = h.shared
    names = [c.split()[0] for c in columns.split(", ")] if columns else []
    kinds = {"int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[c.split()[1]] for c in columns.split(", ")] if columns else []
    alone = Hierarchy(pa.array(["?"]), np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value.tree()

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * (3 + len(names))
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), *types, pa.bool_()))], names=["start", "class_name", *names, "in_scope"])

        for b in batches:
            rows: list[tuple] = []
            for name, c in zip(b.column(0).to_pylist(), tree.codes(b.column(0)).tolist()):
                if c < 0:
                    # A class that nothing names: it stands alone, out of scope.
                    rows += [(name, name, *x[1:], False) for x in visit(alone, 0)]
                else:
                    rows += [(name, tree.names[x[0]].as_py(), *x[1:], tree.known(x[0])) for x in visit(tree, c)]
                if len(rows) > 50_000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    schema = "start string, class_name string, " + (columns + ", " if columns else "") + "in_scope boolean"
    return starts.select("class_name").distinct().mapInArrow(make, schema)


def _place(tree: Hierarchy, start: pa.Array, row: np.ndarray, c: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    """Rows of (start, class_name, more..., in_scope); a class -1 is the start itself, which nothing names."""
    begin = start.take(pa.array(row))
    named = begin if not len(tree.names) else pa.compute.coalesce(tree.names.take(pa.array(c, mask=c < 0)), begin)
    return pa.record_batch([begin, named, *[pa.array(x.astype(np.int32)) for x in more.values()], pa.array((c >= 0) & (c < len(tree.supers)))], names=["start", "class_name", *more, "in_scope"])


def _closures(starts: DataFrame, h: Local) -> DataFrame:
    shared = h.shared

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value.tree()
        n = max(len(tree.names), 1)
        for b in batches:
            for at in range(0, len(b), 1000):
                start = flat(b.column(0).slice(at, 1000)).cast(pa.string())
                c = tree.codes(start)
                yield _place(tree, start, np.flatnonzero(c < 0), c[c < 0])
                for met in tree.reach((np.arange(len(c)) * n + c)[c >= 0]):
                    yield _place(tree, start, met // n, met % n)

    return starts.select("class_name").distinct().mapInArrow(make, "start string, class_name string, in_scope boolean")


def _chains(starts: DataFrame, h: Local) -> DataFrame:
    shared = h.shared

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value.tree()
        for b in batches:
            start = flat(b.column(0)).cast(pa.string())
            c, row, depth = tree.codes(start), np.arange(len(start)), 0
            while len(row):
                yield _place(tree, start, row, c, depth=np.full(len(row), depth))
                up = tree.above_of(c)
                row, c, depth = row[up >= 0], up[up >= 0], depth + 1

    return starts.select("class_name").distinct().mapInArrow(make, "start string, class_name string, depth int, in_scope boolean")


def _in_scope(rows: DataFrame, classes: DataFrame) -> DataFrame:
    known = classes.select(F.col("class_name").alias("k")).distinct()
    return rows.join(known, F.col("class_name") == F.col("k"), "left").withColumn("in_scope", F.col("k").isNotNull()).drop("k")


def supertype_closure(classes: DataFrame, starts: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """starts (class_name) -> (start, class_name, in_scope): every supertype but Object; types out of scope are visited, not expanded."""
    if (h := local_hierarchy(classes, most)) is not None:
        return _closures(starts, h) if h.tall else _walked(starts, h, lambda tree, c: ((x,) for x in _closure(tree, c)), "")
    edges = super_edges(classes).select(F.col("class_name").alias("from"), "up").distinct()
    frontier = settle(starts.select(F.col("class_name").alias("start"), "class_name").distinct())
    seen = frontier
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col("class_name") == F.col("from")).select("start", F.col("up").alias("class_name")).distinct()
        frontier = settle(step.join(seen, ["start", "class_name"], "left_anti"))
        seen = seen.union(frontier)
    return _in_scope(seen, classes).select("start", "class_name", "in_scope")


def super_chain(classes: DataFrame, starts: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """(start, class_name, depth, in_scope): the superclass chain without Object; ends where it leaves the scope or repeats."""
    if (h := local_hierarchy(classes, most)) is not None:
        return _chains(starts, h) if h.tall else _walked(starts, h, lambda tree, c: tree.chain(c), "depth int")
    supers = classes.select(F.col("class_name").alias("from"), F.col("super_name").alias("up"))
    frontier = settle(starts.select(F.col("class_name").alias("start"), "class_name", F.lit(0).alias("depth"), F.array("class_name").alias("path")).distinct())
    levels = [frontier]
    while not frontier.isEmpty():
        step = frontier.join(supers, F.col("class_name") == F.col("from")).where(F.col("up").isNotNull() & (F.col("up") != OBJECT) & ~F.array_contains("path", F.col("up")))
        frontier = settle(step.select("start", F.col("up").alias("class_name"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("up")).alias("path")))
        levels.append(frontier)
    return _in_scope(reduce(DataFrame.union, levels).drop("path"), classes).select("start", "class_name", "depth", "in_scope")


def first_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (start, class_name, path) -> the least path (ordinals from the start) of each (start, class_name) that is reached.

    The order of least paths is that of first visits, depth first. A class is kept once for a start and walked on only when a smaller path
    to it arrives; a way round a cycle is longer than the path it began with, so it never does.
    """
    best = settle(starts.groupBy("start", "class_name").agg(F.min("path").alias("path")))
    frontier = best
    e = edges.select(F.col("class_name").alias("from"), "up", "ord")
    while not frontier.isEmpty():
        step = frontier.join(e, F.col("class_name") == F.col("from")).select("start", F.col("up").alias("class_name"), F.array_append("path", F.col("ord")).alias("path"))
        step = step.groupBy("start", "class_name").agg(F.min("path").alias("path"))
        had = best.withColumnRenamed("path", "had")
        frontier = settle(step.join(had, ["start", "class_name"], "left").where("had is null or path < had").drop("had"))
        after = settle(best.join(frontier.select("start", "class_name"), ["start", "class_name"], "left_anti").unionByName(frontier))
        drop(best)
        best = after
    return best


def _keys(wanted: DataFrame) -> DataFrame:
    return wanted.select("owner", "name", "descriptor").distinct()


def _closure(tree: Hierarchy, start: int) -> Iterator[int]:
    """The start and all above it; what is out of scope is visited, not expanded."""
    return iter(np.flatnonzero(tree.reached(np.array([start]))).tolist())


def preorder(tree: Hierarchy, starts: list[int], step: Callable[[int], list[int]]) -> Iterator[int]:
    """Depth first over `step`, each class at its first visit."""
    seen, stack = set(), starts[::-1]
    while stack:
        c = stack.pop()
        if c not in seen:
            seen.add(c)
            yield c
            if tree.known(c):
                stack += step(c)[::-1]


def _field_places(tree: Hierarchy, start: int) -> Iterator[tuple]:
    """Self, each interface with what is above it, then the superclass; nothing behind the first class out of scope is ever asked."""
    for n, c in enumerate(preorder(tree, [start], tree.above)):
        yield c, [n]
        if not tree.known(c):
            return


def _method_places(tree: Hierarchy, start: int) -> Iterator[tuple]:
    """Phase 1: the superclass chain. Phase 2, if the chain stays in scope: its interfaces, in its order, depth first."""
    tops: list[int] = []
    for c, depth in tree.chain(start):
        yield c, 1, [depth]
        if not tree.known(c):
            return
        tops += tree.interfaces(c)
    for n, c in enumerate(preorder(tree, tops, tree.interfaces)):
        yield c, 2, [n]


def field_places(classes: DataFrame, starts: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """starts (class_name) -> (start, class_name, pos, in_scope): where a field is looked for, in the order of pos."""
    if (h := local_hierarchy(classes, most)) is not None:
        return _walked(starts, h, _field_places, "pos array<int>")
    first = starts.select(F.col("class_name").alias("start"), "class_name").distinct().withColumn("path", F.array().cast("array<int>"))
    return _in_scope(first_paths(super_edges(classes), first), classes).select("start", "class_name", F.col("path").alias("pos"), "in_scope")


def method_places(classes: DataFrame, starts: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """starts (class_name) -> (start, class_name, phase, pos, in_scope): where a method is looked for, phase 1 first, each in the order of pos."""
    if (h := local_hierarchy(classes, most)) is not None:
        return _walked(starts, h, _method_places, "phase int, pos array<int>")
    chain = settle(super_chain(classes, starts, most))
    faces = classes.select("class_name", F.posexplode("interfaces").alias("n", "face")).where(F.col("face").isNotNull() & (F.col("face") != OBJECT))
    tops = chain.join(faces, "class_name").select("start", F.col("face").alias("class_name"), F.array("depth", "n").alias("path"))
    above = _in_scope(first_paths(faces.select("class_name", F.col("n").alias("ord"), F.col("face").alias("up")), tops), classes)
    return chain.select("start", "class_name", F.lit(1).alias("phase"), F.array("depth").alias("pos"), "in_scope").unionByName(above.select("start", "class_name", F.lit(2).alias("phase"), F.col("path").alias("pos"), "in_scope"))


def grouped(left: DataFrame, right: DataFrame, make: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Distinct rows of left and all of right meet by the hash of (name, descriptor), a group of keys at a time."""
    group = F.pmod(F.xxhash64("name", "descriptor"), F.lit(GROUPS)).alias("g")
    # Dealt by group first, so that the same rows need no second exchange.
    one = left.select("*", group).repartition("g").distinct()
    return one.groupBy("g").cogroup(right.select("*", group).groupBy("g")).applyInArrow(make, schema)


def _resolved(h: Local, declared: DataFrame, wanted: DataFrame, method: bool) -> DataFrame:
    shared = h.shared

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        return resolve(shared.value.tree(), left, right, method)

    return grouped(wanted.select("owner", "name", "descriptor"), declared.select("class_name", "name", "descriptor", "access"), make, "owner string, name string, descriptor string, status string, at string, access int")


def _starts(keys: DataFrame) -> DataFrame:
    return keys.select(F.col("owner").alias("class_name")).where(F.col("class_name") != OBJECT)


def resolve_field(classes: DataFrame, members: DataFrame, wanted: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """wanted (owner, name, descriptor) -> status found/not_found/unknown, at, access.

    Depth first: the class itself, each interface with what is above it, then the superclass. The first event decides: the class
    declares the field (found) or is not in scope (unknown).
    """
    if (h := local_hierarchy(classes, most)) is not None and h.tall:
        return _resolved(h, members.where("mkind = 'field'"), wanted, False)
    keys, key = _keys(wanted), ["owner", "name", "descriptor"]
    places = field_places(classes, _starts(keys), most).withColumnRenamed("start", "owner")
    declared = members.where("mkind = 'field'").groupBy("class_name", "name", "descriptor").agg(F.min("access").alias("access"))
    events = keys.join(places, "owner").join(declared, ["class_name", "name", "descriptor"], "left").where(F.col("access").isNotNull() | ~F.col("in_scope"))
    first = events.groupBy(*key).agg(F.min(F.struct("pos", "in_scope", "class_name", "access")).alias("e"))
    found = F.col("e.in_scope")
    out = keys.join(first, key, "left")
    return out.select(*key, F.when(F.col("e").isNull(), "not_found").when(found, "found").otherwise("unknown").alias("status"), F.when(found, F.col("e.class_name")).alias("at"), F.when(found, F.col("e.access")).alias("access"))


def resolve_method(classes: DataFrame, members: DataFrame, wanted: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """wanted (owner, name, descriptor) -> status, at, access.

    Constructors: the owner alone. Then the superclass chain: the first declaration is found, leaving the scope is unknown, Object has its
    own methods. Then the interfaces of the chain, in its order, depth first; unknown only if nothing is found and a branch left the scope.
    """
    if (h := local_hierarchy(classes, most)) is not None and h.tall:
        return _resolved(h, members.where("mkind = 'method'"), wanted, True)
    keys, key = _keys(wanted), ["owner", "name", "descriptor"]
    ctor = F.col("name").isin("<init>", "<clinit>")
    places = method_places(classes, _starts(keys), most).withColumnRenamed("start", "owner")
    declared = members.where("mkind = 'method'").groupBy("class_name", "name", "descriptor").agg(F.min("access").alias("access"))
    seen = keys.join(places, "owner").where(~ctor | ((F.col("phase") == 1) & (F.col("pos")[0] == 0)))
    seen = seen.join(declared, ["class_name", "name", "descriptor"], "left").where(F.col("access").isNotNull() | ~F.col("in_scope"))
    chain, here = F.col("phase") == 1, F.col("access").isNotNull()
    events = seen.groupBy(*key).agg(
        F.min(F.when(chain, F.struct("pos", "in_scope", "class_name", "access"))).alias("a"),
        F.min(F.when(~chain & here, F.struct("pos", "class_name", "access"))).alias("b"),
        F.bool_or(~chain & ~F.col("in_scope")).alias("out"),
    )
    first, built_in, faced = F.col("a").isNotNull(), is_object_method("name", "descriptor") & ~ctor, F.col("b").isNotNull()
    in_chain = first & F.col("a.in_scope")
    status = F.when(in_chain, "found").when(first, "unknown").when(built_in, "found").when(faced, "found").when(F.col("out"), "unknown").otherwise("not_found")
    at = F.when(in_chain, F.col("a.class_name")).when(first, None).when(built_in, OBJECT).when(faced, F.col("b.class_name"))
    access = F.when(in_chain, F.col("a.access")).when(first, None).when(built_in, 1).when(faced, F.col("b.access"))
    return keys.join(events, key, "left").select(*key, status.alias("status"), at.alias("at"), access.alias("access"))


def resolve_rows(classes: DataFrame, members: DataFrame, rows: DataFrame, prefix: str, most: int = LOCAL_EDGES) -> DataFrame:
    """rows (owner, name, descriptor, is_field, ask, ...), each of the first four once -> the same with {prefix}_status, _at, _access as `resolve_field`
    and `resolve_method` have them, null where not `ask`. The rows travel with their keys, so nothing is joined afterwards.
    """
    key, added = ["owner", "name", "descriptor", "is_field"], [f"{prefix}_{c}" for c in ("status", "at", "access")]
    if (h := local_hierarchy(classes, most)) is None or not h.tall:
        asked = rows.where("ask").select(*key)
        got = resolve_method(classes, members, asked.where("not is_field"), most).withColumn("is_field", F.lit(False)).unionByName(resolve_field(classes, members, asked.where("is_field"), most).withColumn("is_field", F.lit(True)))
        got = got.select(*[F.col(c).alias(f"got_{c}") for c in key], *[F.col(c).alias(f"{prefix}_{c}") for c in ("status", "at", "access")])
        out = rows.join(got, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"got_{c}")) for c in key]), "left")
        return out.select(*rows.columns, *[F.when(F.col("ask"), F.col(c)).alias(c) for c in added])
    shared = h.shared

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        left, tree = left.drop_columns(["g"]), shared.value.tree()
        ask = pa.compute.fill_null(left.column("ask"), False)
        rest = left.filter(pa.compute.invert(ask))
        out = [rest]
        for c, kind in zip(added, (pa.string(), pa.string(), pa.int32())):
            out[0] = out[0].append_column(c, pa.nulls(len(rest), kind))
        for field in (False, True):
            some = left.filter(pa.compute.and_(ask, pa.compute.equal(left.column("is_field"), field)))
            if len(some):
                got = resolve(tree, some, right.filter(pa.compute.equal(right.column("is_field"), field)), not field)
                for c in added:
                    some = some.append_column(c, got.column(c.removeprefix(f"{prefix}_")))
                out.append(some)
        return pa.concat_tables(out)

    group = F.pmod(F.xxhash64("name", "descriptor"), F.lit(GROUPS)).alias("g")
    declared = members.where("mkind in ('field', 'method')").select("class_name", "name", "descriptor", "access", (F.col("mkind") == "field").alias("is_field"), group)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {added[0]} string, {added[1]} string, {added[2]} int"
    return rows.select("*", group).groupBy("g").cogroup(declared.groupBy("g")).applyInArrow(make, schema)


def _three_valued(pairs: DataFrame, up: DataFrame) -> DataFrame:
    out = pairs.select("sub", "sup").distinct().join(up.withColumnRenamed("start", "sub"), "sub").groupBy("sub", "sup").agg(F.bool_or(F.col("class_name") == F.col("sup")).alias("hit"), F.bool_or(~F.col("in_scope")).alias("out"))
    return out.select("sub", "sup", F.when(F.col("hit") | (F.col("sup") == OBJECT), "yes").when(F.col("out"), "unknown").otherwise("no").alias("status"))


def _pairs(pairs: DataFrame, h: Local, chain: bool) -> DataFrame:
    shared = h.shared

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value.tree()
        n = max(len(tree.names), 1)
        for b in batches:
            sub, sup = (flat(b.column(i)).cast(pa.string()) for i in (0, 1))
            a, z = tree.codes(sub), tree.codes(sup)
            hit = pa.compute.equal(sub, sup).fill_null(False).to_numpy(zero_copy_only=False).copy()
            out = a < 0
            if chain:
                row, c = np.flatnonzero(a >= 0), a[a >= 0]
                while len(row):
                    hit[row[c == z[row]]] = True
                    out[row[c >= len(tree.supers)]] = True
                    up = tree.above_of(c)
                    row, c = row[up >= 0], up[up >= 0]
            else:
                out[a >= 0] = tree.out[a[a >= 0]]
                # A class is above another only if it is less high.
                go = np.flatnonzero((a >= 0) & (z >= 0) & ~hit)
                low = lambda s: tree.height[s % n] <= tree.height[z[s // n]]  # noqa: E731, B023
                for at in range(0, len(go), 1000):
                    x = go[at : at + 1000]
                    for met in tree.reach(x * n + a[x], low):
                        hit[(met // n)[met % n == z[met // n]]] = True
            status = np.where(hit, "yes", np.where(out, "unknown", "no"))
            yield pa.record_batch([sub, sup, pa.array(status.tolist(), pa.string())], names=["sub", "sup", "status"])

    return pairs.mapInArrow(make, "sub string, sup string, status string")


def _related(classes: DataFrame, pairs: DataFrame, most: int, chain: bool) -> DataFrame:
    pairs = pairs.select("sub", "sup").where("sub is not null").distinct()
    # Everything is below Object, which needs no search.
    top, rest = pairs.where(F.col("sup") == OBJECT).withColumn("status", F.lit("yes")), pairs.where(~F.col("sup").eqNullSafe(OBJECT))
    # The superclasses alone make a smaller hierarchy, if the whole one is not there yet.
    thin = chain and not hasattr(classes, "_hierarchy")
    if (h := local_hierarchy(classes.select("class_name", "super_name", F.array().cast("array<string>").alias("interfaces")) if thin else classes, most)) is not None and h.tall:
        return _pairs(rest, h, chain).unionByName(top)
    starts = rest.select(F.col("sub").alias("class_name"))
    return _three_valued(rest, super_chain(classes, starts, most) if chain else supertype_closure(classes, starts, most)).unionByName(top)


def assignable(classes: DataFrame, pairs: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """pairs (sub, sup) -> status yes/no/unknown: is sup a supertype of sub (or the same)? A branch that leaves the scope makes a miss unknown.

    Where two tables know a class, `prefer` says whose edges count.
    """
    return _related(classes, pairs, most, False)


def subclass(classes: DataFrame, pairs: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """As assignable, over the superclass chain only."""
    return _related(classes, pairs, most, True)


def reached(classes: DataFrame, starts: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """starts (class_name) -> (class_name): they and all that is above any of them, without what is above which."""
    return _set(classes, starts, most, "reached")


def reaching(classes: DataFrame, ends: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """ends (class_name) -> (class_name): they and all classes below any of them."""
    return _set(classes, ends, most, "reaching")


def _set(classes: DataFrame, starts: DataFrame, most: int, way: str) -> DataFrame:
    starts = starts.select("class_name").where("class_name is not null").distinct()
    if (h := local_hierarchy(classes, most)) is None:
        src, dst = ("class_name", "up") if way == "reached" else ("up", "class_name")
        return reachable(super_edges(classes).select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct(), starts, most=0)
    shared = h.shared

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, codes = shared.value.tree(), []
        for b in batches:
            c = tree.codes(b.column(0))
            codes.append(c[c >= 0])
            yield pa.record_batch([flat(b.column(0)).cast(pa.string()).filter(pa.array(c < 0))], names=["class_name"])
        met = np.flatnonzero(getattr(tree, way)(np.concatenate([np.zeros(0, np.int64), *codes])))
        for at in range(0, len(met), 100_000):
            yield pa.record_batch([tree.names.take(pa.array(met[at : at + 100_000]))], names=["class_name"])

    # One search over all starts; there are no more classes than the hierarchy holds, but for those that it does not name.
    return starts.repartition(1).mapInArrow(make, "class_name string")


def reachable(edges: DataFrame, roots: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """edges (src, dst), roots (class_name) -> (class_name): everything reached, roots included."""
    edges, roots = edges.select("src", "dst"), roots.select("class_name").distinct()
    if edges.count() <= most and roots.count() <= most:
        got, start = edges.toArrow(), roots.toArrow().column("class_name").to_pylist()
        below: dict[str, list[str]] = {}
        for a, b in zip(got.column("src").to_pylist(), got.column("dst").to_pylist()):
            below.setdefault(a, []).append(b)
        seen, todo = set(start), list(start)
        for c in todo:
            for d in below.get(c, ()):
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        return edges.sparkSession.createDataFrame(pa.table({"class_name": pa.array(todo, pa.string())}))
    frontier = settle(roots)
    seen = frontier
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col("class_name") == F.col("src")).select(F.col("dst").alias("class_name")).distinct()
        frontier = settle(step.join(seen, "class_name", "left_anti"))
        seen = seen.union(frontier)
    return seen
