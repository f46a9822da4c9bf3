"""Links between near-equal items: shared keys, pivot-first candidate pairs, exact verification, distributed union-find.

Items have keys, and items that may link share one; the items of a key are its bucket. A bucket may hold a third of all rows, so pairs
within it are never listed outright. Each member is verified against a pivot of its bucket only, which joins a group of near copies in
linear work; another key has another pivot. Then only pairs of *different* components that the exact filters leave are verified, so no
link that matters for components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLD, U64, drop_table, mix64, write_table

# Members of one bucket in one batch from which on they meet at a pivot of the batch, and only that goes on to the others.
CROWD = 64
# Parts a shuffle partition: keys are dealt evenly, and a part is what a task holds at a time.
PARTS = 8


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    """Even parts by the upper bits, in the unsigned order of x."""
    return ((x.view(U64) >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def cut(rows: np.ndarray, part: np.ndarray, parts: int) -> dict[int, bytes]:
    """The records of each part; part is sorted."""
    at = np.searchsorted(part, np.arange(parts + 1))
    return {p: rows[at[p] : at[p + 1]].tobytes() for p in np.flatnonzero(np.diff(at)).tolist()}


def crowded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records sorted by key -> (those that go on, the crowded members, their pivots' records): of a crowd only the pivot goes on."""
    first = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])) if len(rows) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(rows)))
    big = size >= CROWD
    if not big.any():
        return rows, rows[:0], rows[:0]
    member = np.repeat(big, size)
    crowd, n = rows[member], size[big]
    pivots = pivot_rows(crowd, n)
    stays = np.zeros(len(crowd), bool)
    stays[pivots] = True
    going = ~member
    going[np.flatnonzero(member)[stays]] = True
    return rows[going], crowd, np.repeat(crowd[pivots], n)


def pivot_rows(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The row of the pivot in each run of n rows of a key: the least hash of id and key, so that pivots differ with the key."""
    h = mix64(rows["id"].view(U64) ^ mix64(rows["key"].view(U64)))
    order = np.lexsort((h, np.repeat(np.arange(len(n)), n)))
    return order[np.concatenate([[0], np.cumsum(n)[:-1]])] if len(n) else np.zeros(0, np.int64)


def shared(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records in any order -> (those of keys with two ids or more, each once and by key; the record of the pivot of each)."""
    rows = rows[np.argsort(np.ascontiguousarray(rows["key"]))]
    if not len(rows):
        return rows, rows

    def sizes(new: np.ndarray) -> np.ndarray:
        return np.diff(np.append(np.flatnonzero(new), len(new)))

    size = sizes(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
    rows = rows[np.repeat(size > 1, size)]
    if not len(rows):
        return rows, rows
    rows = rows[np.lexsort((rows["id"], rows["key"]))]
    rows = rows[np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["id"][1:] != rows["id"][:-1])])]
    size = sizes(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
    rows, size = rows[np.repeat(size > 1, size)], size[size > 1]
    return rows, np.repeat(rows[pivot_rows(rows, size)], size)


def record(extra: list[str]) -> np.dtype:
    return np.dtype([("key", "<i8"), ("id", "<i8"), *[(c, "<i4") for c in extra]])


def far_record(extra: list[str]) -> np.dtype:
    return np.dtype([*record(extra).descr, ("pivot", "<i8"), *[(f"p_{c}", "<i4") for c in extra]])


def with_pivots(members: np.ndarray, pivots: np.ndarray, extra: list[str]) -> np.ndarray:
    out = np.zeros(len(members), far_record(extra))
    out["key"], out["id"], out["pivot"] = members["key"], members["id"], pivots["id"]
    for c in extra:
        out[c], out[f"p_{c}"] = members[c], pivots[c]
    return out


def packed_keys(rows: np.ndarray, parts: int, extra: list[str]) -> dict[int, tuple[bytes, bytes]]:
    """Records of a batch -> part -> (records by key, crowded records with their pivot by id)."""
    rows = rows[np.argsort(np.ascontiguousarray(rows["key"]).view(U64))]
    going, crowd, pivots = crowded(rows)
    near = cut(going, part_of(going["key"], parts), parts)
    far = with_pivots(crowd, pivots, extra)
    where = part_of(mix64(far["id"].view(U64)).view(np.int64), parts)
    order = np.argsort(where, kind="stable")
    spread = cut(far[order], where[order], parts)
    return {p: (near.get(p, b""), spread.get(p, b"")) for p in near.keys() | spread.keys()}


# Members of a bucket up to which all of them are compared by their records; beyond it all stay.
COMPARED = 2048


def _pairs_of_runs(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (a, b) of all pairs within consecutive runs of n rows, about a million at a time."""
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    small = np.flatnonzero(n <= COMPARED)
    cost = np.cumsum(n[small] ** 2)
    for part in np.split(small, np.flatnonzero(np.diff(cost // 1_000_000)) + 1):
        if len(part):
            m = n[part]
            row = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[part], m)
            times = np.repeat(m, m)
            b = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(np.repeat(first[part], m), times)
            a = np.repeat(row, times)
            yield a[a != b], b[a != b]


def plausible_members(rows: np.ndarray, pivots: np.ndarray, fits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Records of shared buckets by key -> those that may link with another member at all, with the one that may link with most as pivot.

    Who cannot link with the pivot is its own pivot. fits(x, y): may the records link? A necessary condition, symmetric.
    """
    if not len(rows):
        return rows, pivots
    n = np.diff(np.append(np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])), len(rows)))
    degree = np.zeros(len(rows), np.int64)
    for a, b in _pairs_of_runs(n):
        yes = fits(rows[a], rows[b])
        degree += np.bincount(a[yes], minlength=len(rows))
    large = np.repeat(n > COMPARED, n)
    keep = (degree > 0) | large
    group = np.repeat(np.arange(len(n)), n)[keep]
    rows, pivots, degree, large = rows[keep], pivots[keep], degree[keep], large[keep]
    if not len(rows):
        return rows, pivots
    order = np.lexsort((rows["id"], -degree, group))
    head = np.concatenate([[True], group[1:] != group[:-1]])
    center = rows[np.repeat(order[head], np.diff(np.append(np.flatnonzero(head), len(rows))))]
    center[large] = pivots[large]
    return rows, np.where(fits(rows, center) | large, center, rows)


def merged_keys(near: list[bytes], far: list[bytes], extra: list[str], fits: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """What `packed_keys` made of a part -> records of shared buckets with their pivots; with `fits` only of members that may link."""
    members, pivots = shared(np.frombuffer(b"".join(near), record(extra)))
    if fits is not None:
        members, pivots = plausible_members(members, pivots, fits)
    return np.concatenate([with_pivots(members, pivots, extra), np.frombuffer(b"".join(far), far_record(extra))])


def parts_for(df: DataFrame) -> int:
    return PARTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, parts: int) -> DataFrame:
    """Rows (part, ...) with the rows of a part together, whole parts one after the other in a task."""
    return df.repartition(max(1, parts // PARTS), "part").sortWithinPartitions("part")


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each part of `dealt`, part after part."""
    rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))))
    for _, group in groupby(rows, key=lambda r: r[0]):
        yield list(group)


def shared_keys(items: DataFrame, keys: str, extra: list[str]) -> DataFrame:
    """items (id long, keys array<long>, *extra int; pos, if in extra, is the place in the array) -> (key, id, pivot, *extra, p_*: the extra of the pivot) of every bucket of two ids or more.

    Keys travel as binary records, some hundred a row. A crowd in one batch meets at a pivot of its own, so that a hot key costs the
    tasks it is in, and the one that gathers it a record a batch.
    """
    parts, kind = parts_for(items), record(extra)
    given, names = [c for c in extra if c != "pos"], ["key", "id", "pivot", *extra, *[f"p_{c}" for c in extra]]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Copies have one id and the same keys: once a batch is enough.
            b = b.take(pa.array(np.sort(np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True)[1])))
            lists = b.column(1)
            at = lists.offsets.to_numpy()
            n = np.diff(at)
            rows = np.zeros(at[-1] - at[0], kind)
            rows["key"] = lists.values.to_numpy()[at[0] : at[-1]]
            rows["id"] = np.repeat(b.column(0).to_numpy(zero_copy_only=False), n)
            for j, c in enumerate(given):
                rows[c] = np.repeat(b.column(2 + j).to_numpy(zero_copy_only=False), n)
            if "pos" in extra:
                rows["pos"] = np.arange(len(rows)) - np.repeat(at[:-1] - at[0], n)
            out = packed_keys(rows, parts, extra)
            yield pa.record_batch({"part": pa.array(list(out), pa.int32()), "near": pa.array([x for x, _ in out.values()], pa.binary()), "far": pa.array([y for _, y in out.values()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_part(batches):
            found = merged_keys([r[1] for r in rows], [r[2] for r in rows], extra)
            yield pa.record_batch({c: pa.array(np.ascontiguousarray(found[c])) for c in names})

    made = dealt(items.select("id", keys, *given).mapInArrow(pack, "part int, near binary, far binary"), parts)
    return made.mapInArrow(merge, ", ".join(f"{c} {'long' if c in ('key', 'id', 'pivot') else 'int'}" for c in names))


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges of each partition as stars: every node with the least node that the partition links it with."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(y, y)
            return x

        def stars() -> pa.RecordBatch:
            found = [(x, r) for x in list(up) if (r := root(x)) != x]
            return pa.record_batch({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([r for _, r in found], pa.int64())})

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > 1_000_000:
                yield stars()
                up.clear()
        yield stars()

    return edges.select("a", "b").mapInArrow(make, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, comp), comp the smallest node reachable.

    Partitions contract what they hold; then alternating large-star and small-star steps, each written out, until all trees are stars.
    """
    plain = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = write_table(_contracted(plain).distinct())

    def settled(df: DataFrame) -> bool:
        """Has every node one smaller neighbour, which has none?"""
        ends = df.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(df.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        return ends.groupBy("node").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or (c = 1 and p = 1)").isEmpty()

    while not settled(e):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = write_table(small.distinct())
        drop_table(e)
        e = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def ordered(s: np.ndarray, known: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """The set in global order number `order`: rare tokens first, then by a hash that differs with the order. known: sorted frequent tokens."""
    rank = np.zeros(len(s), U64)
    if len(known):
        at = np.searchsorted(known, s)
        at[at == len(known)] = 0
        rank = np.where(known[at] == s, classes[at], U64(0))
    with np.errstate(over="ignore"):
        h = mix64(s + GOLD * U64(order + 1))
    return s[np.argsort((rank << U64(58)) | (h >> U64(6)), kind="stable")]


def position_filter(percent: int) -> Callable[[str, str], Column]:
    """Sizes n, then what can still be shared from the first common token on, at the places pos of the two orders."""

    def may_link(x: str, y: str) -> Column:
        a, b, i, j = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}pos"), F.col(f"{y}pos")
        return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * (1 + F.least(a - i - 1, b - j - 1)) >= percent * (a + b))

    return may_link


def parity_words(sets: list[np.ndarray], words: int) -> list[np.ndarray]:
    """For each of 64 * words hash values the parity of the tokens of a set that have it, as `words` 64-bit integers in columns."""
    bits = np.stack([np.bincount((s % U64(64 * words)).astype(np.int64), minlength=64 * words) & 1 for s in sets]).astype(np.uint8)
    packed = np.packbits(bits, axis=1).view("<i8")
    return [packed[:, j].copy() for j in range(words)]


def parity_filter(percent: int, words: int) -> Callable[[str, str], Column]:
    """Sizes n, then: parities w0.. that differ are at most the tokens that only one set has, and those are few in a pair that links."""

    def may_link(x: str, y: str) -> Column:
        odd = sum((F.bit_count(F.col(f"{x}w{i}").bitwiseXOR(F.col(f"{y}w{i}"))) for i in range(words)), F.lit(0))
        a, b = F.col(f"{x}n"), F.col(f"{y}n")
        return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * odd <= (100 - percent) * (a + b))

    return may_link


def size_class(n: Column, percent: int) -> Column:
    """Sets that link have sizes of the same or of neighbouring classes. A margin keeps rounding on the safe side."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.01 / percent))).cast("int")


def open_in_buckets(rest: DataFrame, columns: list[str], may_link: Callable[[str, str], Column], sized: bool, kind: Column | None) -> DataFrame:
    """rest (key, id, comp, main, cls, *columns) -> pairs (a, b) of a bucket in different components that may link, one of them at least outside the main one.

    With `kind`, a pair is listed in the first bucket of each kind that it shares; without, in every one, and each way if both are outside.
    """
    cols, classes, once = ["id", "comp", *columns], F.array(F.lit(0)), F.lit(True)
    if sized:
        classes = F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)
    if kind is not None:
        rest = rest.withColumn("kind", kind)
        keys = rest.groupBy("id", "kind").agg(F.collect_set("key").alias("keys"))
        rest, cols = write_table(rest.join(keys, ["id", "kind"])), [*cols, "keys", "main"]
        # Of two that are both outside the main component, the lesser is left and the other right.
        once = ((F.col("b_comp") == F.col("b_main")) | (F.col("a_id") < F.col("b_id"))) & (F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("key"))
    left = rest.where("comp <> main").select("key", F.explode(classes).alias("cls"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = rest.select("key", "cls", *[F.col(c).alias(f"b_{c}") for c in cols])
    return left.join(right, ["key", "cls"]).where("a_comp <> b_comp").where(may_link("a_", "b_")).where(once).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def link_components(
    active: DataFrame,
    load: Callable[[DataFrame], DataFrame],
    linked: Callable[[DataFrame], DataFrame],
    extra: list[str],
    may_link: Callable[[str, str], Column],
    may_differ: Callable[[str, str], Column],
    describe: Callable[[DataFrame], DataFrame],
    described: list[str],
    size: Column | None = None,
    may_share: Callable[[str, str], Column] | None = None,
    narrow: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
    kind: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """active (key, id, pivot, *extra, p_* of the pivot), a written table -> (links used (a, b), (node, comp)).

    load: (id) -> (id, columns that the verification needs), called once, for the items that share a bucket with another item.
    narrow: pairs (a, b) -> those that further filters leave, before the loaded columns are joined.
    linked: pairs (a, b, a_*, b_*) -> those that link, given the loaded columns of both sides.
    describe: loaded rows -> (id, *described), more columns for may_link. size: the size class of a row with these, where buckets hold very different sizes.
    kind: the kind of a key, where may_link says the same of a pair in each bucket of a kind; the pair is then listed in the first of them only.
    may_share, may_differ, may_link (x, y): necessary conditions for a link in a bucket between the rows with the prefixes x and y, from
    `extra`, from `described`, and from both.
    """
    side = write_table(load(active.select("id").distinct()))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = narrow(pairs)
        for s in "ab":
            pairs = pairs.join(side.select(*[F.col(c).alias(s if c == "id" else f"{s}_{c}") for c in side.columns]), s)
        return write_table(linked(pairs).select("a", "b"))

    def with_comp(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        for s in "ab":
            pairs = pairs.join(comp.select(F.col("node").alias(s), F.col("comp").alias(f"{s}_comp")), s, "left").withColumn(f"{s}_comp", F.coalesce(f"{s}_comp", s))
        return pairs

    # Each item against the pivot with which it shares most keys; then against its other pivots that are still in another component.
    met = active.where("id <> pivot") if may_share is None else active.where("id <> pivot").where(may_share("", "p_"))
    star = write_table(met.groupBy(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).agg(F.count("*").cast("int").alias("n")))
    ends = star.select(F.col("a").alias("x"), "a", "b", "n").union(star.select(F.col("b").alias("x"), "a", "b", "n"))
    best = ends.groupBy("x").agg(F.max(F.struct("n", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    first = write_table(best)
    links = verify(first)
    comp = write_table(connected_components(links))
    sketch = write_table(describe(side))

    def open_pairs(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those in different components whose descriptions leave a link possible."""
        pairs = with_comp(pairs, comp).where("a_comp <> b_comp").select("a", "b")
        for s in "ab":
            pairs = pairs.join(sketch.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in described]), s)
        return write_table(pairs.where(may_differ("a_", "b_")).select("a", "b"))

    more = verify(open_pairs(star.join(first, ["a", "b"], "left_anti").select("a", "b")))

    def joined(more: DataFrame) -> None:
        nonlocal links, comp
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = write_table(connected_components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more)))

    joined(more)
    # What is left: buckets with several components, there every pair with an item outside the bucket's main component.
    # The one pair of a bucket of two is tried already.
    more_than_two = active.groupBy("key").agg(F.count("*").alias("m")).where("m > 2").select("key")
    rows = active.select("key", "id", *extra).join(more_than_two, "key", "left_semi").distinct().join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("comps"))
    rest = write_table(rows.join(per.where("comps > 1").select("key", F.col("m.comp").alias("main")), "key"))
    if rest.isEmpty():
        return links, comp
    rest = write_table(rest.join(sketch, "id").withColumn("cls", F.lit(0) if size is None else size))
    pairs = open_in_buckets(rest, [*extra, *described], may_link, size is not None, kind).distinct()
    joined(verify(write_table(pairs.join(star, ["a", "b"], "left_anti"))))
    for old in (rest, star, first, side, sketch):
        drop_table(old)
    return links, comp
