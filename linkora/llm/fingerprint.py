"""Operator 10: document fingerprints by consistent weighted sampling.

Terms are the lower-cased words of the whole text, weighted by their count. For each of `samples` hash functions and each term, gamma
variates r, c and a uniform b drawn from the term give t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r; the term with the least
a is the sample (term, t). Two fingerprints agree in a sample with a probability equal to the generalised Jaccard similarity of the
weighted terms. A fingerprint holds 16 bits for each sample, in hexadecimal.

The edited text of a document takes its end from the start of the next document in descending doc_id. Rows are dealt to buckets by
ranges of doc_id, sorted within, and the first document of a bucket is also sent to the bucket before.

Edge cases: a null text is empty; a text without words has an empty fingerprint, whose likeness is 1 to another empty one, else 0. Null
doc_ids come last. Rows with equal doc_id are ordered by text. A single row is its own next. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLD, U64, mix64, table, word_hashes

LOW = -(1 << 63)
CHUNK = 4_000_000


def _gamma(h: np.ndarray) -> np.ndarray:
    """-ln(u v) with two uniforms u, v in (0, 1) from each 64-bit hash: a gamma variate of shape 2."""
    u = h.view(np.uint32).reshape(-1, 2).astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2.0**-32)
    np.log(u, out=u)
    return -(u[:, 0] + u[:, 1])


def draws(terms: np.ndarray, weights: np.ndarray, samples: int, block: int = 4096) -> np.ndarray:
    """For each weighted term a row of sortable values: ln a in the upper 32 bits, a hash of (term, t) in the lower ones."""
    out = np.empty((len(terms), samples), dtype=U64)
    for at in range(0, len(terms), block):
        rows = np.empty((samples, len(terms[at : at + block])), dtype=U64)
        own, logw = terms[at : at + block], np.log(weights[at : at + block].astype(np.float32))
        with np.errstate(over="ignore"):
            for k in range(samples):
                h = mix64(own + GOLD * U64(k + 1))
                g = mix64(h + GOLD)
                r, c = _gamma(h), _gamma(g)
                b = ((h ^ (g >> U64(7))) * GOLD >> U64(40)).astype(np.float32) * np.float32(2.0**-24)
                t = np.floor(logw / r + b)
                bits = (np.log(c) - r * (t - b) - r).view(np.uint32)
                bits ^= np.where(bits >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000))
                who = (h ^ (t.astype(np.int64).view(U64) * GOLD)) * U64(0xBF58476D1CE4E5B9) >> U64(32)
                rows[k] = (bits.astype(U64) << U64(32)) | who
        out[at : at + block] = rows.T
    return out


def fingerprints(texts: list[str], samples: int) -> list[bytes]:
    """Per text 2 * samples bytes; none for a text without words."""
    h, per = word_hashes([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    uniq, counts, at = [], [], 0
    for m in per.tolist():
        u, n = np.unique(h[at : at + m], return_counts=True)
        uniq.append(u)
        counts.append(n)
        at += m
    if not at:
        return [b""] * len(texts)
    with np.errstate(over="ignore"):
        terms, weights = np.concatenate(uniq), np.concatenate(counts)
        pair, first, where = np.unique(mix64(terms + weights.astype(U64) * GOLD), return_index=True, return_inverse=True)
    rows, out, at = draws(terms[first], weights[first], samples), [], 0
    for u in uniq:
        out.append((rows[where[at : at + len(u)]].min(axis=0) & U64(0xFFFF)).astype("<u2").tobytes() if len(u) else b"")
        at += len(u)
    return out


def likeness(a: bytes, b: bytes) -> float:
    if not a or not b:
        return float(a == b)
    return float(np.mean(np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")))


def _dealt(docs: DataFrame, size: int) -> DataFrame:
    """(bucket, ahead, d, doc_id, text): rows in buckets of about `size` in descending doc_id, and the first of each also ahead of its own."""
    ids = docs.select("d")
    n = ids.count()
    parts = max(1, min(-(-n // size), 100_000))
    cuts = sorted(set(ids.approxQuantile("d", [i / parts for i in range(1, parts)], 0.1 / parts)) if parts > 1 else set())
    cuts = np.array(cuts, dtype=np.float64)

    @F.pandas_udf("int")
    def bucket(d: pd.Series) -> pd.Series:
        return pd.Series((len(cuts) - np.searchsorted(cuts, d.to_numpy(np.float64), side="left")).astype(np.int32))

    # One row for each bucket, so at most 100,001.
    heads = sorted((r["bucket"], r["d"]) for r in ids.select("d", bucket("d").alias("bucket")).groupBy("bucket").agg(F.max("d").alias("d")).collect())
    before = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}
    first = {d: b for b, d in heads}

    @F.pandas_udf("array<int>")
    def homes(d: pd.Series) -> pd.Series:
        own = len(cuts) - np.searchsorted(cuts, d.to_numpy(np.float64), side="left")
        return pd.Series([[int(b)] if x not in first else [int(b), ~before[int(b)]] for b, x in zip(own, d.tolist())])

    home = F.explode("homes").alias("home")
    out = docs.withColumn("homes", homes("d")).select(home, "d", "doc_id", "text")
    return out.select(F.when(F.col("home") < 0, -1 - F.col("home")).otherwise(F.col("home")).alias("bucket"), (F.col("home") < 0).alias("ahead"), "d", "doc_id", "text")


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def document_fingerprints(docs: DataFrame, samples: int = 64, bucket_size: int = 2048) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("d", F.coalesce("doc_id", F.lit(LOW)))
    if rows.isEmpty():
        dealt = rows.select(F.lit(0).alias("bucket"), F.lit(False).alias("ahead"), "d", "doc_id", "text")
    else:
        dealt = _dealt(rows, bucket_size)

    def emit(run: list[tuple], following: str) -> pa.RecordBatch:
        texts = [r[1] for r in run] + [following]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        prints = fingerprints(texts + changed, samples)
        own, new = prints[: len(texts)], prints[len(texts) :]
        return pa.record_batch(
            {
                "doc_id": pa.array([r[0] for r in run], pa.int64()),
                "n_chars": pa.array([len(r[1]) for r in run], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                "fingerprint": pa.array([x.hex() for x in own[:-1]]),
                "edited_fingerprint": pa.array([x.hex() for x in new]),
                "near_edited": pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()),
                "near_next": pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            }
        )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by bucket, those from the next bucket last; a run ends at its last own row, whose next is the row after it.
        run: list[tuple] = []
        total = 0
        for batch in batches:
            for bucket, ahead, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if ahead:
                    if run:
                        yield emit(run, text)
                        run, total = [], 0
                    continue
                if run and total > CHUNK:
                    yield emit(run, text)
                    run, total = [], 0
                run.append((doc_id, text))
                total += len(text)

    order = dealt.repartition("bucket").sortWithinPartitions("bucket", "ahead", F.desc("d"), "text").select("bucket", "ahead", "doc_id", "text")
    return order.mapInArrow(make, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))
