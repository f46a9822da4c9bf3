"""Operator 5: lexical retrieval packing into windows of `window` tokens.

Each document becomes the ids of the tokenizer and a closing id 0. Its full windows stand alone. The rest, shorter than a window, is
packed: rests are dealt to shards of bounded size by a range of (a sample of the ids that prefers rare ones, doc_id), so that texts that
share rare ids meet; in a shard
a BM25 inverted index over the rests returns, for each unused seed and all of its terms, every unused neighbour with a positive score,
best first; these fill its window, and only when none is left do other unused rests. The last
neighbour is cut to fit and what is left of it stays unused, so windows are full; the last window of a shard is split at powers of two,
which need no padding.

Edge cases: null and empty texts have only the closing id. Repeated rows are packed once each. A null doc_id is carried. Nothing is
dropped or capped: BM25 only orders the pieces. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLD, U64, mix64, table, write_table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_made: dict[str, object] = {}


def encoder(path: str):
    """The vocabulary and pattern of a byte-level BPE file as a faster tiktoken encoding; ids equal those of `tokenizers`."""
    if path not in _made:
        import tiktoken

        spec = json.loads(open(path, encoding="utf-8").read())
        # The printable stand-ins of byte-level BPE and its word pattern.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(stand[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _made[path] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _made[path]


def rarity(n: int) -> np.ndarray:
    """For each token id an integer whose least over a text is a weighted sample of its ids: the later the vocabulary has an id, the rarer
    it is and the likelier it is the one, so that texts which share rare ids share the sample."""
    u = (mix64(np.arange(1, n + 1, dtype=U64) * GOLD) >> U64(11)).astype(np.float64) / float(1 << 53)
    return (-np.log1p(-u) / np.arange(1, n + 1) + 1e-300).view(np.int64)


def tokenised(docs: DataFrame, tokenizer: str, window: int) -> DataFrame:
    """(doc_id, n, crcs of the full windows, rest as little-endian uint32, key: the least `rarity` of an id of the whole document)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        least = rarity(max(enc.max_token_value, 1) + 1)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for text in batch.column(1).to_pylist():
                ids = np.array(enc.encode(text or "", allowed_special="all"), dtype="<u4")
                key = int(least[ids].min()) if len(ids) else 0
                raw = ids.tobytes() + b"\0\0\0\0"
                n = len(ids) + 1
                full = n // window
                for col, value in zip(out, (n, [crc32(raw[i * 4 * window : (i + 1) * 4 * window]) for i in range(full)], raw[full * 4 * window :], key)):
                    col.append(value)
            yield pa.record_batch({"doc_id": batch.column(0), "n": pa.array(out[0], pa.int64()), "crcs": pa.array(out[1], pa.list_(pa.int64())), "rest": pa.array(out[2], pa.binary()), "key": pa.array(out[3], pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, n long, crcs array<long>, rest binary, key long")


class Index:
    """BM25 over the rests of one shard; the terms are token ids.

    Terms of an eighth of the documents or more have a dense row of weights, the others a posting list. So a dense cell stands for one
    posting in eight at least, and a query adds rows up instead of scattering long lists.
    """

    DENSE, AHEAD = 8, 16

    def __init__(self, rests: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        n = len(rests)
        sizes = np.array([len(r) for r in rests])
        code = np.repeat(np.arange(n, dtype=np.int64), sizes) | (np.concatenate(rests).astype(np.int64) << 32)
        code, tf = np.unique(code, return_counts=True)
        term, doc = code >> 32, (code & 0xFFFFFFFF).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        df = np.diff(np.append(first, len(term)))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        which = np.repeat(np.arange(len(first)), df)
        norm = k1 * (1 - b + b * sizes / max(sizes.mean(), 1))
        weight = (idf[which] * tf * (k1 + 1) / (tf + norm[doc])).astype(np.float32)
        order = np.argsort(doc, kind="stable")
        self.by_doc, self.at = which[order], np.searchsorted(doc[order], np.arange(n + 1))
        dense = df * self.DENSE >= n
        self.row = np.where(dense, np.cumsum(dense) - 1, -1)
        self.rows = np.zeros((int(dense.sum()), n), np.float32)
        thick = dense[which]
        self.rows[self.row[which[thick]], doc[thick]] = weight[thick]
        self.doc, self.weight, self.which = doc[~thick], weight[~thick], which[~thick]
        self.df = df
        # Columns of the documents that may still be found; a column number stands for a document from here on.
        self.docs = np.arange(n)
        self.ahead: dict[int, np.ndarray] = {}
        self.spans()

    def spans(self) -> None:
        self.stops = np.cumsum(np.bincount(self.which, minlength=len(self.df)))
        self.starts = np.concatenate([[0], self.stops[:-1]])

    def shrink(self, unused: np.ndarray) -> None:
        """Leave out used documents; scores of the others stay the same."""
        stays = unused[self.docs]
        number = np.cumsum(stays) - 1
        keep = stays[self.doc]
        self.doc, self.weight, self.which = number[self.doc[keep]], self.weight[keep], self.which[keep]
        self.rows, self.docs = self.rows[:, stays], self.docs[stays]
        self.ahead = {}
        self.spans()

    def terms(self, seed: int) -> np.ndarray:
        q = self.by_doc[self.at[seed] : self.at[seed + 1]]
        return q[self.df[q] > 1]

    def dense_score(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """What the dense rows give every column. The next seeds are likely to be asked for too: they are scored in one product."""
        if seed not in self.ahead:
            seeds = [seed, *(seed + 1 + np.flatnonzero(unused[seed + 1 : seed + 1 + 8 * self.AHEAD])[: self.AHEAD - 1]).tolist()]
            rows = [r[r >= 0] for r in (self.row[self.terms(s)] for s in seeds)]
            every = np.unique(np.concatenate(rows))
            asked = np.zeros((len(seeds), len(every)), np.float32)
            for i, r in enumerate(rows):
                asked[i, np.searchsorted(every, r)] = 1
            self.ahead = dict(zip(seeds, asked @ self.rows[every]))
        return self.ahead.pop(seed)

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """All unused documents with a positive score for all terms of the seed, best first, ties in order."""
        if 4 * unused.sum() < 3 * len(self.docs):
            self.shrink(unused)
        score = self.dense_score(seed, unused)
        q = self.terms(seed)
        q = q[self.row[q] < 0]
        spans = [slice(a, b) for a, b in zip(self.starts[q].tolist(), self.stops[q].tolist()) if a < b]
        if spans:
            score += np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), minlength=len(score)).astype(np.float32)
        score *= unused[self.docs]
        # The next best are sorted as they are asked for.
        done = np.float32(np.inf)
        take = 32
        while True:
            left = np.flatnonzero((score > 0) & (score < done))
            if not len(left):
                return
            if len(left) > take:
                done = np.partition(score[left], len(left) - take)[len(left) - take]
                left = left[score[left] >= done]
            else:
                done = np.float32(0)
            yield from self.docs[left[np.argsort(-score[left], kind="stable")]].tolist()
            take *= 4


def pack_shard(rests: list[np.ndarray], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (rest, start in it, length). Every id of every rest is in one piece."""
    size, used = [len(r) for r in rests], [0] * len(rests)
    unused = np.array(size) > 0
    index = Index(rests) if unused.any() else None
    sequences, seed = [], 0
    while True:
        while seed < len(rests) and not unused[seed]:
            seed += 1
        if seed == len(rests):
            break
        pieces, room, later = [], window, seed + 1
        unused[seed] = False
        found: Iterator[int] | None = None
        i: int | None = seed
        while room:
            if i is None:
                found = index.neighbours(seed, unused) if found is None else found
                i = next(found, None)
            if i is None:
                while later < len(rests) and not unused[later]:
                    later += 1
                if later == len(rests):
                    break
                i = later
            take = min(room, size[i] - used[i])
            pieces.append((i, used[i], take))
            used[i] += take
            room -= take
            unused[i] = used[i] < size[i]
            i = None
        sequences.append(pieces)
    if sequences and (left := sum(p[2] for p in sequences[-1])) < window:
        last, sequences = sequences[-1], sequences[:-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            now = []
            while room:
                i, start, n = last.pop(0)
                take = min(room, n)
                now.append((i, start, take))
                room -= take
                if take < n:
                    last.insert(0, (i, start + take, n - take))
            sequences.append(now)
    return sequences


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, shard: int = 8192) -> DataFrame:
    """docs (doc_id, text) -> a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    shard: documents that share an index. Neighbours in other shards are not retrieved.
    """
    made = write_table(tokenised(docs, tokenizer, window))
    shards = max(1, -(-made.count() // shard))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5)))]
        # The order within a shard must not depend on the order in which rows arrive.
        rows.sort(key=lambda r: (r[4], r[0] is None, r[0] or 0, r[1], r[3], r[2]))
        number = TaskContext.get().partitionId() << 36
        out: list[tuple] = []
        for doc_id, n, crcs, _, _ in rows:
            for i, crc in enumerate(crcs):
                out.append((doc_id, i * window, window, crc, n, number, 0))
                number += 1
        rests = [np.frombuffer(r[3], dtype="<u4") for r in rows]
        for pieces in pack_shard(rests, window):
            offset = 0
            for i, start, length in pieces:
                doc_id, n, crcs, raw, _ = rows[i]
                out.append((doc_id, len(crcs) * window + start, length, crc32(raw[4 * start : 4 * (start + length)]), n, number, offset))
                offset += length
            number += 1
        names = [x.split()[0] for x in PIECES.split(", ")]
        for i in range(0, len(out), 50_000):
            yield pa.record_batch({c: pa.array(v, pa.int64()) for c, v in zip(names, zip(*out[i : i + 50_000]))})

    return made.repartitionByRange(shards, "key", "doc_id").mapInArrow(fill, PIECES)


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizer())


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of all documents that are left."""
    return pack(docs, public_tokenizer())
