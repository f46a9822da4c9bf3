"""Shared helpers: scratch tables in the cluster's checkpoint folder, vectorised text kernels, integer hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
GOLD = U64(0x9E3779B97F4A7C15)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where none is named, a temporary one, which only a local master may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut lineage: write to the shared folder and read back. Survives lost executors, unlike a cache.

    The table is whole when the write ends, so the shuffle files behind it are removed at once.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/t-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a scratch table that no later plan reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, want: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64 arrays."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def chunked(items: list, size_of, most: int) -> Iterator[list]:
    """Consecutive runs of items with a total size of about `most`; a larger item stands alone."""
    run, total = [], 0
    for x in items:
        n = size_of(x)
        if run and total + n > most:
            yield run
            run, total = [], 0
        run.append(x)
        total += n
    if run:
        yield run


_BYTE = mix64(np.arange(1, 257, dtype=U64) * GOLD) | U64(1)
_P, _P_INV = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        m = max(2 * n, 1 << 20)
        with np.errstate(over="ignore"):
            have = np.concatenate([np.ones(1, U64), np.full(m, base, U64)]).cumprod(dtype=U64)
        _powers[name] = have
    return have[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words in each text). Words: runs of bytes other than \\x20 and \\x09-\\x0D."""
    parts = [_word_hashes(part) for part in chunked(texts, len, 100_000)]
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[buf]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    stops = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    with np.errstate(over="ignore"):
        acc = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE[buf] * _power("p", _P, len(buf)), dtype=U64)])
        h = mix64((acc[stops] - acc[starts]) * _power("i", _P_INV, len(buf))[starts] + (stops - starts).astype(U64) * GOLD)
    per = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    return h, per


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its k-word shingles; with fewer words, of the whole sequence; none without words."""
    h, per = word_hashes(texts)
    n = len(h)
    with np.errstate(over="ignore"):
        s = np.full(max(n - k + 1, 0), k, dtype=U64)
        for j in range(k):
            s = mix64(s * GOLD + h[j : n - k + 1 + j])
    out, at = [], 0
    for m in per.tolist():
        if m >= k:
            out.append(np.unique(s[at : at + m - k + 1]))
        elif m:
            x = np.full(1, m, dtype=U64)
            with np.errstate(over="ignore"):
                for j in range(m):
                    x = mix64(x * GOLD + h[at + j : at + j + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, U64))
        at += m
    return out
