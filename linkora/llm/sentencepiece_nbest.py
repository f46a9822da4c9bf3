"""Operator 1: SentencePiece encoding and decoding with N-best segmentation.

The piece lattice of a text holds every vocabulary piece at every place, and the bytes of a character that no piece has. A forward
Viterbi pass gives the best score up to each place; these scores are exact heuristics for a backward A* search, which therefore takes
segmentations off its agenda in order of score.

Every path passes the start of each unit (a run of spaces with the word after it; a character that is in no longer piece), so the
lattice is cut there: the passes run over distinct units, many at once, and the search runs only in the units of least loss, which
are the only ones that an N-best list of the whole text can change. An agenda over those units merges their lists, lazily and exactly.

Scores are the model's: log-probabilities of a unigram model. The scores of a BPE model are the ranks of its merges, so there the best
list is that of the ranks' sums, and not what the library's merging gives. Rules of normalisation that a model has are applied first; then
decoding gives the normalised text. A character without a piece costs 10 less than the worst piece, as in SentencePiece. Ties go to the longer last
piece, then to the earlier unit. Edge cases: null is an empty text, which has one segmentation without pieces. Repeated rows get equal
results. Texts are never cut short. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLD, U64, chunked, table

SPACE = "▁"
CHUNK = 2_000_000
_made: dict[str, "Model"] = {}


class Model:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(open(path, "rb").read())
        kinds = pb.ModelProto.SentencePiece
        self.names = [p.piece for p in spec.pieces]
        self.byte_ids = np.zeros(256, np.int32)
        pieces = {}
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                pieces[p.piece] = (i, p.score)
        self.byte_of = {int(i): b for b, i in enumerate(self.byte_ids.tolist())}
        self.dummy = spec.normalizer_spec.add_dummy_prefix
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.unknown = min(s for _, s in pieces.values() if s > -1e8) - 10.0
        inner = {c for p in pieces if len(p) > 1 for c in p}
        rules = spec.normalizer_spec
        self.normalise = None
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces:
            from sentencepiece import SentencePieceNormalizer

            self.normalise = SentencePieceNormalizer(model_file=path, add_dummy_prefix=False, escape_whitespaces=False).normalize
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in inner)
        self.units = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]") if alone else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            # A piece may cross a space: then the whole text is one lattice.
            self.units = re.compile("(?s:.+)")
        # Pieces by a 64-bit hash: a row number for each slot of a table; the few whose slot was taken are searched in a sorted list.
        self.key = np.array([self._hash(p) for p in pieces], dtype=U64)
        self.ident = np.array([i for i, _ in pieces.values()], np.int32)
        self.score = np.array([v for _, v in pieces.values()])
        self.slot = np.zeros(1 << 20, np.int32)
        at = self._slot(self.key)
        self.slot[at[::-1]] = np.arange(len(at), dtype=np.int32)[::-1]
        over = np.flatnonzero(self.slot[at] != np.arange(len(at)))
        self.over = over[np.argsort(self.key[over])]
        self.full = np.zeros(1 << 20, bool)
        self.full[at[over]] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h * 0x100000001B3) + ord(c) + 1) & ((1 << 64) - 1)
        return h

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * GOLD >> U64(44)).view(np.int64)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._slot(h)
        row = self.slot.take(at)
        hit = self.key.take(row) == h
        if len(self.over):
            odd = np.nonzero(self.full.take(at) & ~hit)
            keys = self.key[self.over]
            k = np.minimum(np.searchsorted(keys, h[odd]), len(keys) - 1)
            found = keys[k] == h[odd]
            odd = tuple(x[found] for x in odd)
            row[odd], hit[odd] = self.over[k[found]], True
        return np.where(hit, self.ident.take(row), np.int32(-1)), np.where(hit, self.score.take(row), -np.inf)

    def surface(self, text: str) -> str:
        text = self.normalise(text) if self.normalise and text else text
        return (SPACE if self.dummy else "") + text.replace(" ", SPACE) if text else ""

    # --- lattices of units of one length ---

    def viterbi(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Units of one length -> (best score, ids of the best paths in a row, their numbers, loss of the second-best path; infinite if there is none)."""
        g, size = len(units), len(units[0])
        c = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(g, size)
        ids, scores, h = [], [], None
        with np.errstate(over="ignore"):
            for n in range(1, min(self.longest, size) + 1):
                h = (c.astype(U64) + U64(1)) if h is None else h[:, :-1] * U64(0x100000001B3) + c[:, n - 1 :] + U64(1)
                i, s = self.look_up(h)
                if n == 1:
                    s = np.where(i < 0, self.unknown, s)
                ids.append(i)
                scores.append(s)
        lens = len(scores)
        fwd = np.full((size + 1, g), -np.inf)
        fwd[0] = 0
        back = np.zeros((size + 1, g), np.int32)
        for e in range(1, size + 1):
            for n in range(min(lens, e), 0, -1):
                v = fwd[e - n] + scores[n - 1][:, e - n]
                better = v > fwd[e]
                fwd[e][better] = v[better]
                back[e][better] = n
        rev = np.full((size + 1, g), -np.inf)
        rev[size] = 0
        for b in range(size - 1, -1, -1):
            for n in range(1, min(lens, size - b) + 1):
                np.maximum(rev[b], scores[n - 1][:, b] + rev[b + n], out=rev[b])
        # Walk the best paths back; then the best path with an edge that is not on the best one.
        on = np.zeros((size + 1, g), np.int32)  # length of the best path's piece that ends here
        pos, rows = np.full(g, size), np.arange(g)
        steps = []
        while (live := pos > 0).any():
            n = np.where(live, back[pos, rows], 0)
            on[pos[live], rows[live]] = n[live]
            steps.append((pos - n, n))
            pos = pos - n
        second = np.full(g, -np.inf)
        for e in range(1, size + 1):
            for n in range(1, min(lens, e) + 1):
                v = fwd[e - n] + scores[n - 1][:, e - n] + rev[e]
                v[on[e] == n] = -np.inf
                np.maximum(second, v, out=second)
        flat = np.full((len(steps), g), -2, np.int32)  # -2: no piece, -1: bytes
        for k, (start, n) in enumerate(reversed(steps)):
            for m in np.unique(n[n > 0]).tolist():
                w = np.flatnonzero(n == m)
                flat[k, w] = ids[m - 1][w, start[w]]
        if (flat == -1).any():
            starts, rows_of = [s for s, _ in reversed(steps)], []
            for w in range(g):
                row = []
                for k in range(len(steps)):
                    if flat[k, w] == -1:
                        row += self.byte_ids[list(units[w][starts[k][w]].encode("utf-8", "surrogatepass"))].tolist()
                    elif flat[k, w] >= 0:
                        row.append(flat[k, w])
                rows_of.append(row)
            best, count = np.array([i for row in rows_of for i in row], np.int32), np.array([len(row) for row in rows_of])
        else:
            kept = flat.T
            mask = kept >= 0
            best, count = kept[mask], mask.sum(axis=1)
        return fwd[size], best, count, fwd[size] - second

    def edges(self, unit: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end, the pieces that end there: (start, score, ids)."""
        out: list[list] = [[] for _ in range(len(unit) + 1)]
        for e in range(1, len(unit) + 1):
            for n in range(min(self.longest, e), 0, -1):
                if (p := self.pieces.get(unit[e - n : e])) is not None:
                    out[e].append((e - n, p[1], (p[0],)))
                elif n == 1:
                    out[e].append((e - 1, self.unknown, tuple(self.byte_ids[list(unit[e - 1].encode("utf-8", "surrogatepass"))].tolist())))
        return out

    def nbest_unit(self, unit: str, most: int) -> list[tuple[float, tuple[int, ...]]]:
        """The `most` best segmentations of a unit: forward Viterbi scores, then backward A*."""
        edges = self.edges(unit)
        fwd = [0.0] + [0.0] * len(unit)
        for e in range(1, len(unit) + 1):
            fwd[e] = max(fwd[s] + v for s, v, _ in edges[e])
        agenda, count, out = [(-fwd[-1], 0, len(unit), 0.0, ())], 0, []
        while agenda and len(out) < most:
            f, _, e, done, path = heapq.heappop(agenda)
            if e == 0:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((-f, tuple(ids)))
                continue
            for s, v, ids in edges[e]:
                count += 1
                heapq.heappush(agenda, (-(fwd[s] + v + done), count, s, done + v, (ids, path)))
        return out

    # --- whole texts ---

    def encode(self, texts: list[str], most: int) -> list[list[tuple[float, np.ndarray]]]:
        """Per text up to `most` (score, ids), best first."""
        known: dict[str, int] = {}
        rows = [np.array([known.setdefault(u, len(known)) for u in self.units.findall(self.surface(t))], np.int64) for t in texts]
        units = list(known)
        by_size: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by_size.setdefault(len(u), []).append(i)
        score, loss, first, count = np.zeros(len(units)), np.full(len(units), np.inf), np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        flat, total = [], 0
        for size, members in by_size.items():
            for part in chunked(members, lambda _, n=size: n, 40_000):
                score[part], ids, n, loss[part] = self.viterbi([units[i] for i in part])
                count[part], first[part] = n, total + np.cumsum(n) - n
                flat.append(ids)
                total += len(ids)
        pool = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        lists: dict[int, list] = {}
        out = []
        for row in rows:
            if not len(row):
                out.append([(0.0, np.zeros(0, np.int32))])
                continue
            n = count[row]
            stops = np.cumsum(n)
            total, ids = float(score[row].sum()), pool[np.repeat(first[row] - stops + n, n) + np.arange(stops[-1])]
            found = [(total, ids)]
            if most > 1:
                lost = loss[row]
                near = np.argsort(lost, kind="stable")[: most - 1]
                near = np.sort(near[np.isfinite(lost[near])]).tolist()
                for p in near:
                    if row[p] not in lists:
                        lists[row[p]] = self.nbest_unit(units[row[p]], most)
                ranked = [lists[row[p]] for p in near]
                starts = np.concatenate([[0], stops])
                agenda, seen = [(0.0, (0,) * len(near))], {(0,) * len(near)}
                while agenda and len(found) <= most:
                    cost, ranks = heapq.heappop(agenda)
                    if any(ranks):
                        parts, at = [], 0
                        for p, r, x in zip(near, ranks, ranked):
                            if r:
                                parts += [ids[at : starts[p]], np.array(x[r][1], np.int32)]
                                at = starts[p + 1]
                        found.append((total - cost, np.concatenate([*parts, ids[at:]])))
                        if len(found) == most:
                            break
                    for j, x in enumerate(ranked):
                        r = ranks[:j] + (ranks[j] + 1,) + ranks[j + 1 :]
                        if r[j] < len(x) and r not in seen:
                            seen.add(r)
                            heapq.heappush(agenda, (cost + x[r[j] - 1][0] - x[r[j]][0], r))
            out.append(found)
        return out

    def decode(self, ids: list[int]) -> str:
        if not hasattr(self, "_plain"):
            self._plain = [None if i in self.byte_of else n for i, n in enumerate(self.names)]
        plain = self._plain
        names = [plain[i] for i in ids]
        if None in names:
            out, raw = [], bytearray()
            for i, n in zip(ids, names):
                if n is None:
                    raw.append(self.byte_of[i])
                else:
                    if raw:
                        out.append(raw.decode("utf-8", "replace"))
                        raw.clear()
                    out.append(n)
            if raw:
                out.append(raw.decode("utf-8", "replace"))
            names = out
        text = "".join(names)
        return text.removeprefix(SPACE if self.dummy else "").replace(SPACE, " ")


def model(path: str) -> Model:
    if path not in _made:
        _made[path] = Model(path)
    return _made[path]


def encode_nbest(docs: DataFrame, path: str, most: int = 4, digest: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, rank, score, ids; or with digest: one row a document of counts, scores and checksums."""
    schema = "doc_id long, n_chars long, n_segmentations long, n_pieces long, ids_crc32 long, nbest_scores array<double>, nbest_crc32 array<long>, round_trip boolean" if digest else "doc_id long, rank int, score double, ids array<int>"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = model(path)
        for batch in batches:
            ids, at = batch.column(0), 0
            for part in chunked([t or "" for t in batch.column(1).to_pylist()], len, CHUNK):
                found = sp.encode(part, most)
                own = ids.slice(at, len(part))
                at += len(part)
                if not digest:
                    flat = [(i, r, s, x) for i, f in zip(own.to_pylist(), found) for r, (s, x) in enumerate(f)]
                    yield pa.record_batch({"doc_id": pa.array([x[0] for x in flat], pa.int64()), "rank": pa.array([x[1] for x in flat], pa.int32()), "score": pa.array([x[2] for x in flat], pa.float64()), "ids": pa.array([x[3].tolist() for x in flat], pa.list_(pa.int32()))})
                    continue
                crcs = [[crc32(x.astype("<u4").tobytes()) for _, x in f] for f in found]
                yield pa.record_batch(
                    {
                        "doc_id": own,
                        "n_chars": pa.array([len(t) for t in part], pa.int64()),
                        "n_segmentations": pa.array([len(f) for f in found], pa.int64()),
                        "n_pieces": pa.array([len(f[0][1]) for f in found], pa.int64()),
                        "ids_crc32": pa.array([c[0] for c in crcs], pa.int64()),
                        "nbest_scores": pa.array([[s for s, _ in f] for f in found], pa.list_(pa.float64())),
                        "nbest_crc32": pa.array(crcs, pa.list_(pa.int64())),
                        "round_trip": pa.array([sp.decode(f[0][1].tolist()) == (sp.normalise(t) if sp.normalise and t else t) for t, f in zip(part, found)]),
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, schema)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (ids array<int>, ...) -> the same columns and text."""

    @F.pandas_udf("string")
    def text(ids):
        sp = model(path)
        return ids.map(lambda x: None if x is None else sp.decode(list(x)))

    return encoded.withColumn("text", text("ids"))


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_nbest(table(spark, sf_dir, "documents"), public_model(), digest=True)
