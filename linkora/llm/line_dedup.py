"""Operator 8: fuzzy line dedup. MinHash of character shingles, banding, exact Jaccard verification, distributed union-find.

Lines are the \\n-separated parts of a text, compared after lower-casing and collapsing white space. Of each component of lines
with Jaccard similarity of their k-character shingles of `percent` or more, the first line (by doc_id, row hash, line number) stays.
Without `short`, lines of fewer than `least` normalised characters take no part in this.

One changed character changes k shingles, so in short lines long shingles lose it. With `short`, lines below `SHORT_BELOW` characters
that hold a letter or digit are also compared by `short`-character shingles, at `SHORT_PERCENT`; a pair links if either comparison
links it. A line shorter than its shingles equals only itself. Lines without a letter or digit below `least` always stay.

Edge cases: a null text stays null (0 lines), an empty one stays empty. Rows that are equal in doc_id and text count as one document
and get the same result. Null doc_ids come last in the order. Extra columns of `docs` are carried along; those with the names in `counts`
are replaced. Ties in doc_id are broken by the hash of doc_id and text. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, chunked, free_name, mix64, table, write_table
from .graph import by_part, cut, dealt, link_components, merged_keys, packed_keys, parity_filter, part_of, parts_for, record
from .minhash import band_keys, char_shingles, signatures

CHUNK = 100_000
# One character changed in the middle links from (n - 3) / (n + 3) >= 0.8 on: 29 characters. 13 bands of 4 find a pair of similarity 0.8
# with a probability of 0.999. From about 93 characters on the long shingles link such a pair too; short ones would not tell long lines apart.
SHORT_BELOW, SHORT_PERCENT, SHORT_BANDS = 128, 80, 13


def normalised(line: str) -> str:
    s = line.lower()
    # The only white space that is printable is the plain space.
    return s.strip(" ") if "  " not in s and s.isprintable() else " ".join(s.split())


def _word(line: str) -> bool:
    return any(map(str.isalnum, line))


FIRST = np.dtype([("id", "<i8"), ("d", "<i8"), ("rk", "<i8"), ("no", "<i4")])
GONE = np.dtype([("rk", "<i8"), ("no", "<i4")])
BUCKET, HEAD, LOST = 0, 1, 2
# Records of short lines carry their number of shingles and 64 parities.
PARITY = ["n", "lo", "hi"]


def _distinct(lines: list[str], k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(line number, hash of `bits` bits) of the distinct shingles of each line, sorted. There are less than 2 ** (64 - bits) lines."""
    h, n = char_shingles(lines, k, wide=True)
    code = np.repeat(np.arange(len(lines), dtype=U64) << U64(bits), n) | (h >> U64(64 - bits))
    code.sort()
    code = code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code
    return (code >> U64(bits)).view(np.int64), code & U64((1 << bits) - 1)


def parities(lines: list[str], k: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct shingles, parity of those of each of 64 * words hash values as 64-bit integers) of each line."""
    row, h = _distinct(lines, k, 44)
    odd = np.bincount(row * (64 * words) + (h % U64(64 * words)).view(np.int64), minlength=64 * words * len(lines)) & 1
    return np.bincount(row, minlength=len(lines)), np.packbits(odd.astype(np.uint8).reshape(len(lines), -1), axis=1).view("<i8")


def _short_fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """May records of short lines link? Shingles that only one of them has are at least the parities that differ."""
    a, b = x["n"].astype(np.int64), y["n"].astype(np.int64)
    odd = sum(np.bitwise_count((x[c] ^ y[c]).view(np.uint32)).astype(np.int64) for c in ("lo", "hi"))
    return (100 * np.minimum(a, b) >= SHORT_PERCENT * np.maximum(a, b)) & ((100 + SHORT_PERCENT) * odd <= (100 - SHORT_PERCENT) * (a + b))


def _lines(docs: DataFrame, k: int, bands: int, rows: int, least: int, short: int = 0) -> DataFrame:
    """docs (d, rk, text) -> rows of three kinds: BUCKET (key, id, pivot) of lines that share a band; HEAD (id, d, rk, no), the first place of
    each line; LOST (rk, no), its other places.

    A batch sends on each of its lines once, whatever it repeats, and packed into binary records (see `graph.shared_keys`).
    """
    parts = parts_for(docs)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, int] = {}
            ids: list[int] = []
            line, at, no = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for j, x in enumerate((text or "").split("\n")):
                    if (short or len(x) >= least) and (len(s := normalised(x)) >= least or short and _word(s)):
                        if (n := seen.get(s)) is None:
                            n = seen[s] = len(ids)
                            ids.append(xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63))
                        line.append(n)
                        at.append(i)
                        no.append(j)
            if not ids:
                continue
            own, which = np.array(ids, np.int64), np.array(at)
            places = np.zeros(len(line), FIRST)
            places["id"], places["no"] = own[line], no
            for c, column in (("d", 0), ("rk", 1)):
                places[c] = batch.column(column).to_numpy(zero_copy_only=False)[which]
            firsts, gone = _first_places(places)
            strings = list(seen)
            packed = []
            for size, n, extra, fits in ((k, bands, [], [len(s) >= least for s in strings]), (short, SHORT_BANDS, PARITY, [0 < short and len(s) < SHORT_BELOW and _word(s) for s in strings])):
                chosen = np.flatnonzero(fits)
                made = [np.zeros(0, record(extra))]
                for part in chunked([(i, strings[i]) for i in chosen.tolist()], lambda x: len(x[1]), CHUNK):
                    which, lines = own[[i for i, _ in part]], [x for _, x in part]
                    found = band_keys(signatures(lines, size, n * rows), rows)
                    r = np.zeros(found.size, record(extra))
                    # Keys of the two kinds differ in their last bit.
                    r["key"], r["id"] = (found.reshape(-1) & ~1) | (size != k), np.repeat(which, n)
                    if extra:
                        count, odd = parities(lines, size, 1)
                        odd = odd.view("<i4")
                        r["n"], r["lo"], r["hi"] = np.repeat(count, n), np.repeat(odd[:, 0], n), np.repeat(odd[:, 1], n)
                    made.append(r)
                packed.append(packed_keys(np.concatenate(made), parts, extra))
            by_id, by_rk = (_spread(x, x[c], parts) for x, c in ((firsts, "id"), (gone, "rk")))
            every = sorted(packed[0].keys() | packed[1].keys() | by_id.keys() | by_rk.keys())
            yield pa.record_batch(
                {
                    "part": pa.array(every, pa.int32()),
                    **{f"{c}{i}": pa.array([x.get(p, (b"", b""))[j] for p in every], pa.binary()) for i, x in enumerate(packed) for j, c in enumerate(("near", "far"))},
                    "firsts": pa.array([by_id.get(p, b"") for p in every], pa.binary()),
                    "gone": pa.array([by_rk.get(p, b"") for p in every], pa.binary()),
                }
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "key", "id", "pivot", "d", "rk", "no"]

        def out(kind: int, rows: np.ndarray) -> pa.RecordBatch:
            made = {"kind": pa.array(np.full(len(rows), kind, np.int32))}
            for c in names[1:]:
                made[c] = pa.array(np.ascontiguousarray(rows[c])) if c in rows.dtype.names else pa.nulls(len(rows), pa.int32() if c == "no" else pa.int64())
            return pa.record_batch(made)

        for rows_ in by_part(batches):
            yield out(BUCKET, merged_keys([r[1] for r in rows_], [r[2] for r in rows_], []))
            yield out(BUCKET, merged_keys([r[3] for r in rows_], [r[4] for r in rows_], PARITY, _short_fits))
            firsts, more = _first_places(np.frombuffer(b"".join(r[5] for r in rows_), FIRST))
            yield out(HEAD, firsts)
            yield out(LOST, np.concatenate([more, np.frombuffer(b"".join(r[6] for r in rows_), GONE)]))

    made = docs.select("d", "rk", "text").mapInArrow(pack, "part int, near0 binary, far0 binary, near1 binary, far1 binary, firsts binary, gone binary")
    return dealt(made, parts).mapInArrow(merge, "kind int, key long, id long, pivot long, d long, rk long, no int")


def _first_places(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """FIRST records -> (the first of each id, GONE records of its other places). Equal rows are one document, so equal places are one."""
    places = places[np.lexsort((places["no"], places["rk"], places["d"], places["id"]))]
    head = np.concatenate([[True], places["id"][1:] != places["id"][:-1]]) if len(places) else np.zeros(0, bool)
    firsts = places[head]
    own = np.repeat(firsts, np.diff(np.append(np.flatnonzero(head), len(places))))
    other = places[(places["rk"] != own["rk"]) | (places["no"] != own["no"])]
    gone = np.zeros(len(other), GONE)
    gone["rk"], gone["no"] = other["rk"], other["no"]
    return firsts, gone


def _spread(rows: np.ndarray, by: np.ndarray, parts: int) -> dict[int, bytes]:
    where = part_of(mix64(np.ascontiguousarray(by).view(U64)).view(np.int64), parts)
    order = np.argsort(where, kind="stable")
    return cut(rows[order], where[order], parts)


def _wanted(rows: DataFrame) -> DataFrame:
    """(text, want array<struct<line_no, id>>) -> (id, line): the normalised wanted lines."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(w["id"], normalised(lines[w["line_no"]])) for text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for lines in [text.split("\n")] for w in want]
            yield pa.record_batch({"id": pa.array([i for i, _ in found], pa.int64()), "line": pa.array([s for _, s in found], pa.string())})

    return rows.select("text", "want").mapInArrow(make, "id long, line string")


def alike(x: list[str], y: list[str], k: int, percent: int) -> np.ndarray:
    """Whether the Jaccard similarity of the shingle sets of x[i] and y[i] is `percent` or more. At most 2,048 pairs."""
    if not x:
        return np.zeros(0, bool)
    found = [_distinct(side, k, 53) for side in (x, y)]
    p, q = (np.bincount(row, minlength=len(x)) for row, _ in found)
    both = np.concatenate([(row.view(U64) << U64(53)) | h for row, h in found])
    both.sort()
    same = np.bincount((both[1:][both[1:] == both[:-1]] >> U64(53)).view(np.int64), minlength=len(x))
    return 100 * same >= percent * (p + q - same)


def _linked(pairs: DataFrame, k: int, percent: int, least: int, short: int) -> DataFrame:
    """pairs (a, b, a_line, b_line) -> (a, b) with a Jaccard similarity of their shingle sets of `percent` or more, or alike as short lines."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            keep = np.zeros(len(lines), bool)
            for size, share, fits in (
                (k, percent, [min(len(x), len(y)) >= least for x, y in lines]),
                (short, SHORT_PERCENT, [0 < short and max(len(x), len(y)) < SHORT_BELOW and _word(x) and _word(y) for x, y in lines]),
            ):
                chosen = [(i, *lines[i]) for i in np.flatnonzero(fits).tolist()]
                for some in chunked(chosen, lambda r: len(r[1]) + len(r[2]), CHUNK):
                    for part in (some[i : i + 2048] for i in range(0, len(some), 2048)):
                        keep[[r[0] for r in part]] |= alike([r[1] for r in part], [r[2] for r in part], size, share)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return pairs.select("a", "b", "a_line", "b_line").mapInArrow(make, "a long, b long")


SKETCH = 8


def _sketches(lines: DataFrame, k: int, least: int, short: int) -> DataFrame:
    """(id, line) -> (id, n, w0.., short_n, short_w0..): number of shingles and their parity words, for both lengths of shingles.

    Null where a line is not judged by shingles of that length.
    """
    kinds = {"": k, "short_": short} if short else {"": k}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunked(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), lambda x: len(x[1]), CHUNK):
                columns = {"id": pa.array([i for i, _ in part], pa.int64())}
                for kind, size in kinds.items():
                    own = np.array([len(s) < SHORT_BELOW and _word(s) if kind else len(s) >= least for _, s in part])
                    n, words = np.zeros(len(part), np.int32), np.zeros((len(part), SKETCH), np.int64)
                    if own.any():
                        n[own], words[own] = parities([s for (_, s), x in zip(part, own.tolist()) if x], size, SKETCH)
                    columns[f"{kind}n"] = pa.array(n, mask=~own)
                    columns |= {f"{kind}w{j}": pa.array(np.ascontiguousarray(words[:, j])) for j in range(SKETCH)}
                yield pa.record_batch(columns)

    return lines.select("id", "line").mapInArrow(make, "id long, " + ", ".join(f"{kind}n int, " + ", ".join(f"{kind}w{j} long" for j in range(SKETCH)) for kind in kinds))


def dedup_lines(docs: DataFrame, k: int = 7, percent: int = 85, bands: int = 10, rows: int = 4, least: int = 30, short: int = 0, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs (doc_id, text, ...) -> the same columns with text of the kept lines, and the two long columns named by counts: lines, and lines removed.

    10 bands of 4 find a pair of similarity 0.85 with a probability of 0.999. short: characters of a shingle of short lines, 0: those are not judged.
    """
    rk, flag = free_name(docs, "row"), free_name(docs, "flags")
    keyed = docs.withColumn(rk, F.xxhash64(F.col("doc_id"), F.col("text")))
    base = keyed.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.col(rk).alias("rk"), "text")
    lines = write_table(_lines(base, k, bands, rows, least, short))
    head = lines.where(F.col("kind") == HEAD).select("id", "d", "rk", "no")

    def may_link(x: str, y: str) -> Column:
        long = F.coalesce(parity_filter(percent, SKETCH)(x, y), F.lit(False))
        return long | F.coalesce(parity_filter(SHORT_PERCENT, SKETCH)(f"{x}short_", f"{y}short_"), F.lit(False)) if short else long

    def load(wanted: DataFrame) -> DataFrame:
        where = head.select("id", "rk", "no").join(wanted, "id").groupBy("rk").agg(F.collect_list(F.struct(F.col("no").alias("line_no"), "id")).alias("want"))
        return _wanted(base.join(where.hint("shuffle_hash"), "rk")).dropDuplicates(["id"])

    def in_bucket(x: str, y: str) -> Column:
        # A bucket belongs to one kind of shingles, by the last bit of its key; a pair that the other kind links is in a bucket of that kind.
        if not short:
            return may_link(x, y)
        by_short = F.coalesce(parity_filter(SHORT_PERCENT, SKETCH)(f"{x}short_", f"{y}short_"), F.lit(False))
        return F.when(F.col("key").bitwiseAND(F.lit(1).cast("long")) == 1, by_short).otherwise(F.coalesce(parity_filter(percent, SKETCH)(x, y), F.lit(False)))

    described = [f"{kind}{c}" for kind in (("", "short_") if short else ("",)) for c in ("n", *(f"w{j}" for j in range(SKETCH)))]
    buckets = lines.where(F.col("kind") == BUCKET).select("key", "id", "pivot")
    _, comp = link_components(buckets, load, lambda pairs: _linked(pairs, k, percent, least, short), [], in_bucket, may_link, lambda found: _sketches(found, k, least, short), described, kind=F.col("key").bitwiseAND(F.lit(1).cast("long")))
    # Of the first places of the lines of a component all but the first go, and so do all further places of any line.
    mine = head.join(comp.withColumnRenamed("node", "id"), "id")
    best = mine.groupBy("comp").agg(F.min(F.struct("d", "rk", "no")).alias("w"))
    beaten = mine.join(best, "comp").where("rk <> w.rk or no <> w.no").select("rk", "no")
    gone = lines.where(F.col("kind") == LOST).select("rk", "no").unionByName(beaten)
    gone = gone.groupBy("rk").agg(F.sort_array(F.collect_set("no")).alias("gone"))
    # gone -> a flag for each line up to the last one that goes; then one pass over lines and flags
    flags = F.expr("flatten(transform(gone, (x, i) -> array_append(array_repeat(true, x - if(i = 0, -1, gone[i - 1]) - 1), false)))")
    gone = write_table(gone.select(F.col("rk").alias(rk), flags.alias(flag), F.size("gone").cast("long").alias("__n")))
    kept_columns = [c for c in docs.columns if c not in counts]
    out = keyed.select(*[F.col(f"`{c}`") for c in kept_columns], rk).join(gone.withColumnRenamed("__n", n := free_name(docs, "n")).hint("shuffle_hash"), rk, "left")
    parts = F.split("text", "\n", -1)
    kept = F.array_join(F.array_compact(F.zip_with(parts, F.col(flag), lambda line, stays: F.when(F.coalesce(stays, F.lit(True)), line))), "\n")
    return out.select(
        *[(F.when(F.col(flag).isNull(), F.col("text")).otherwise(kept) if c == "text" else F.col(f"`{c}`")).alias(c) for c in kept_columns],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long").alias(counts[0]),
        F.coalesce(n, F.lit(0)).cast("long").alias(counts[1]),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), short=3)
    return out.select("doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated and nearly repeated lines go; a document of which no word is left goes, one that had none before stays.

    The columns are those of docs, whatever their names. Null texts, repeated rows and an empty table are as in `dedup_lines`; n_chars, if there, is counted anew.
    """
    counts = (free_name(docs, "lines"), free_name(docs, "removed"))
    out = dedup_lines(docs, short=3, counts=counts).where((F.col(counts[1]) == 0) | F.col("text").rlike(r"[^ \t-\r]"))
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
