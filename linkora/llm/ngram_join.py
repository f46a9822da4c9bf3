"""Operator 3: Jaccard self-join of word-shingle sets by filtering under several global token orders.

Sets with Jaccard t or more share a token among the first |x| - ceil(t |x|) + 1 under *every* global order. The first order
(frequent tokens last) lists candidates; the prefixes under further orders must overlap too before a pair is verified.

Frequent tokens are those counted most often within batches; the count only shapes the order, any order gives the same links.
Documents of equal sets form one class; the join runs over classes.

Edge cases: null or empty text, or one without words, has no shingle, n_shingles 0 and is linked with nothing. Repeated rows are
one class. A null doc_id links but never names a component unless the whole component has none (then component_id is null).
Extra columns of `docs` are ignored. Sets are compared as 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, chunked, shingle_sets, table, write_table
from .graph import link_components, ordered, parity_filter, parity_words, position_filter, shared_keys, size_class

CHUNK = 200_000


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [(t or "").encode().lower() for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def frequent_tokens(docs: DataFrame, k: int, most: int, least: int) -> np.ndarray:
    """Up to `most` (token, count) seen in `least` documents of one batch or more, largest first; rows (token, class) sorted by token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for part in chunked(_texts(batch), len, CHUNK) for s in shingle_sets(part, k)]
            if sets:
                token, n = np.unique(np.concatenate(sets), return_counts=True)
                keep = n >= least
                yield pa.record_batch({"token": pa.array(token[keep].view(np.int64)), "n": pa.array(n[keep].astype(np.int64))})

    rows = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(most).collect()
    out = np.array(sorted((r["token"], int(r["n"]).bit_length()) for r in rows), dtype=np.int64).reshape(-1, 2)
    return out[np.argsort(out[:, 0].view(U64))]


def shingle_table(docs: DataFrame, known: np.ndarray, k: int, percent: int, orders: int) -> DataFrame:
    """(doc_id, row hash rk, n_shingles, id of the class, prefix under each order p0..)."""
    tokens, classes = known[:, 0].copy().view(U64), known[:, 1].astype(U64)
    names = [f"p{i}" for i in range(orders)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunked(_texts(batch), len, CHUNK):
                sets = shingle_sets(part, k)
                prefixes: list[list] = [[] for _ in names]
                for s in sets:
                    m = len(s) - (percent * len(s) + 99) // 100 + 1 if len(s) else 0
                    for i, p in enumerate(prefixes):
                        p.append(ordered(s, tokens, classes, i)[:m].view(np.int64))
                cls = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
                lists = {}
                for name, p in zip(names, prefixes):
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in p])]).astype(np.int32)
                    flat = np.concatenate(p) if p else np.zeros(0, np.int64)
                    # The first prefix lists candidates by whole hashes; the further ones only filter, for which half of the bits do.
                    lists[name] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat if name == "p0" else flat.astype(np.int32)))
                own = batch.slice(at, len(sets))
                yield pa.record_batch({"doc_id": own.column(0), "rk": own.column(1), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "id": pa.array(cls, pa.int64()), **lists})
                at += len(sets)

    return docs.select("doc_id", "rk", "text").mapInArrow(rows, "doc_id long, rk long, n_shingles long, id long, " + ", ".join(f"{n} array<{'long' if n == 'p0' else 'int'}>" for n in names))


def _packed(rows: DataFrame) -> DataFrame:
    """(id, text) -> (id, text): compressed, since texts are shuffled with the pairs."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.record_batch({"id": batch.column(0), "text": pa.array([press.compress(t) for t in _texts(batch)], pa.binary())})

    return rows.select("id", "text").mapInArrow(make, "id long, text binary")


def _linked(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs (a, b, a_text, b_text, compressed) -> (a, b) with 100 * |x & y| >= percent * |x | y|."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = {i: t for name, of in (("a_text", a), ("b_text", b)) for i, t in zip(of, batch.column(batch.schema.get_field_index(name)).to_pylist()) if i not in last}
            for part in chunked([(i, press.decompress(t)) for i, t in texts.items()], lambda x: len(x[1]), CHUNK):
                last |= zip([i for i, _ in part], shingle_sets([t for _, t in part], k))
            keep = []
            for x, y in zip(a, b):
                p, q = last[x], last[y]
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            if len(last) > 20_000:
                last.clear()

    return pairs.select("a", "b", "a_text", "b_text").mapInArrow(make, "a long, b long")


SKETCH = 16


def _sketches(rows: DataFrame, k: int) -> DataFrame:
    """(id, text, compressed) -> (id, n, w0..): the size and the parity words of the shingle set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in chunked([(i, press.decompress(t)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], lambda x: len(x[1]), CHUNK):
                sets = shingle_sets([t for _, t in part], k)
                words = {f"w{j}": pa.array(w) for j, w in enumerate(parity_words(sets, SKETCH))}
                yield pa.record_batch({"id": pa.array([i for i, _ in part], pa.int64()), "n": pa.array([len(x) for x in sets], pa.int32()), **words})

    return rows.select("id", "text").mapInArrow(make, "id long, n int, " + ", ".join(f"w{j} long" for j in range(SKETCH)))


def _components(docs: DataFrame, k: int, percent: int, orders: int = 3, frequent: int = 65_536, frequent_in_batch: int = 8) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (rows (doc_id, row hash rk, n_shingles, class id, ...), (id, comp) of every class).

    Links: 100 * |x & y| >= percent * |x | y|. frequent: bound on the token list that is sent to all tasks (16 bytes each).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rk", F.xxhash64("doc_id", "text"))
    known = frequent_tokens(docs, k, frequent, frequent_in_batch)
    made = write_table(shingle_table(docs, known, k, percent, orders))
    further = [f"p{i}" for i in range(1, orders)]
    # Equal rows are one item; copies of a class meet by their keys anyway, and each counts once.
    items = made.where("id is not null").select("id", F.col("n_shingles").cast("int").alias("n"), "p0")
    active = write_table(shared_keys(items, "p0", ["n", "pos"]))

    sides: list[DataFrame] = []

    def load(wanted: DataFrame) -> DataFrame:
        one = write_table(made.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("rk").alias("rk")))
        sides.append(write_table(made.select("rk", F.col("n_shingles").alias("n"), *further).join(one, "rk").dropDuplicates(["rk"]).drop("rk")))
        return _packed(docs.select("rk", "text").join(one, "rk").dropDuplicates(["rk"]))

    def narrow(pairs: DataFrame) -> DataFrame:
        for s in "ab":
            pairs = pairs.join(sides[0].select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n", *further)]), s)
        pairs = pairs.where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
        for p in further:
            pairs = pairs.where(F.arrays_overlap(f"a_{p}", f"b_{p}"))
        return pairs.select("a", "b")

    near, parity = position_filter(percent), parity_filter(percent, SKETCH)

    def may_link(x: str, y: str) -> Column:
        return near(x, y) & parity(x, y)

    words = ["n", *[f"w{j}" for j in range(SKETCH)]]
    _, comp = link_components(active, load, lambda pairs: _linked(pairs, k, percent), ["pos"], may_link, parity, lambda rows: _sketches(rows, k), words, size_class(F.col("n"), percent), near, narrow)
    ids = made.where("id is not null").select("id").distinct()
    return made, write_table(ids.join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("comp", "id").alias("comp")))


BLOCK = 1024


def _linked_block(texts: list[bytes], x: np.ndarray, y: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Whether item x[i] links with item y[j], as a matrix. Intersections are products of 0-1 matrices, some shared tokens at a time."""
    sets = shingle_sets(texts, k)
    size = np.array([len(s) for s in sets], np.int64)
    token, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(n > 1) - 1
    item = np.repeat(np.arange(len(sets)), size)
    keep = n[at] > 1
    item, col = item[keep], shared[at[keep]]
    order = np.argsort(col, kind="stable")
    item, col = item[order], col[order]
    both = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, int((n > 1).sum()), 2 * BLOCK):
        part = slice(*np.searchsorted(col, [lo, lo + 2 * BLOCK]))
        m = np.zeros((len(sets), 2 * BLOCK), np.float32)
        m[item[part], col[part] - lo] = 1
        both += m[x] @ m[y].T
    both = both.astype(np.int64)
    return 100 * both >= percent * (size[x][:, None] + size[y][None, :] - both)


def _blocks(docs: DataFrame, made: DataFrame, comp: DataFrame, block: int) -> DataFrame:
    """(comp, i, j, id, own, n, text): the classes of each component of two or more, dealt into blocks of about `block`, each with every block."""
    sizes = comp.groupBy("comp").agg(F.count("*").alias("size")).where("size > 1")
    one = made.where("id is not null").groupBy("id").agg(F.min("rk").alias("rk"), F.count("*").alias("n"))
    members = write_table(comp.join(sizes, "comp").join(one, "id").withColumn("of", F.ceil(F.col("size") / block)).withColumn("own", F.pmod(F.xxhash64("id"), "of")))
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("rk"), "text")
    texts = write_table(_packed(keyed.join(members.select("id", "rk"), "rk").dropDuplicates(["rk"])))
    sent = members.select("comp", "id", "own", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("other"))
    return sent.join(texts, "id").select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "own", "n", "text")


def _all_links(blocks: DataFrame, k: int, percent: int, counts: bool) -> DataFrame:
    """Every link between classes: (a, b) with a < b, or if counts (id, n), n the rows of the classes that a class links with, to be added up."""

    def make(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        press = zstandard.ZstdDecompressor()
        ids, own, n = (rows.column(c).to_numpy() for c in ("id", "own", "n"))
        i, j = key[1].as_py(), key[2].as_py()
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(x) or not len(y):
            p, q = x[:0], y[:0]
        else:
            found = _linked_block([press.decompress(t) for t in rows.column("text").to_pylist()], x, y, k, percent)
            if i == j:
                found = np.triu(found, 1)
            if counts:
                total = np.zeros(len(ids), np.int64)
                total[x] += found @ n[y]
                total[y] += found.T @ n[x]
                return pa.table({"id": pa.array(ids), "n": pa.array(total)})
            p, q = np.nonzero(found)
            p, q = x[p], y[q]
        if counts:
            return pa.table({"id": pa.array(ids[:0]), "n": pa.array(ids[:0])})
        return pa.table({"a": pa.array(np.minimum(ids[p], ids[q])), "b": pa.array(np.maximum(ids[p], ids[q]))})

    return blocks.groupBy("comp", "i", "j").applyInArrow(make, "id long, n long" if counts else "a long, b long")


def jaccard_links(docs: DataFrame, k: int = 3, percent: int = 90, block: int = BLOCK, **bounds: int) -> tuple[DataFrame, DataFrame]:
    """(every link (a, b) between classes, a < b; membership (doc_id, class_id), a row per row of docs). As many rows as there are links."""
    made, comp = _components(docs, k, percent, **bounds)
    return _all_links(_blocks(docs, made, comp, block), k, percent, False), made.select("doc_id", F.col("id").alias("class_id"))


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, block: int = BLOCK, **bounds: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links) of every row of docs (doc_id, text).

    n_links: the other rows whose set links with that of the row, those of its own class among them. No links run between components, so
    the classes of a component are compared with each other in blocks; the pairs are counted, not listed.
    """
    made, comp = _components(docs, k, percent, **bounds)
    across = _all_links(_blocks(docs, made, comp, block), k, percent, True).groupBy("id").agg(F.sum("n").alias("across"))
    classes = made.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    named = classes.join(comp, "id")
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "comp").join(across, "id", "left").select("id", "component_id", (F.col("rows") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"))
    return made.select("doc_id", "n_shingles", "id").join(named, "id", "left").select("doc_id", "n_shingles", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


RK = "__near_copy_row"


def one_per_component(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of each component one row of docs (doc_id, text, ...) stays: smallest doc_id (null last), then row hash, then the other columns.

    Rows without a shingle are copies of nothing and all stay.
    """
    keyed = docs.withColumn(RK, F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))
    made, comp = _components(docs, k, percent)
    rows = made.where("id is not null").groupBy("id", "rk").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).join(comp, "id")
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rk")).alias("w"))
    # Only rows that go, and rows that stay once of several equal ones: few, so the texts of the others need not move.
    marked = write_table(rows.join(first, "comp").select(F.col("rk").alias(RK), (F.col("rk") == F.col("w.rk")).alias("stays"), "n").where("not stays or n > 1"))
    alone = keyed.join(marked.select(RK), RK, "left_anti")
    once = keyed.join(marked.where("stays").select(RK), RK, "left_semi").groupBy(RK).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return alone.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(once.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def stage_one_per_component(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near copies (five-word shingles, similarity 0.8) one row stays; unlinked documents all stay."""
    return one_per_component(docs, 5, 80)
