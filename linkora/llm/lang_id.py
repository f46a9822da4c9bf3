"""Operator 7: hierarchical language identification.

A linear SVM picks the language family; within the family one-versus-one linear SVMs separate its languages and vote.
Features: frequencies of hashed character 2- to 4-grams of the whole lower-cased text, anything but letters read as a space. A
decision value is linear in them, so a text is scored as the mean of the weights of its n-grams, without building vectors.

Training reads a bounded sample: about `per_lang` documents of every language, chosen by a hash of the row, in one task that holds their
sparse vectors. Only text and lang of documents whose crc32(doc_id as text) mod 4 is not 2 are used.

Edge cases: null text or one without a letter gives `und`, score 0. A null doc_id is not learned from and not held out. A null lang
is not learned from. Without any labelled row every text is `und`. Repeated rows are learned once and get equal results; ties go to the
first language by name. Extra columns are carried along; those with the names of the two results are replaced.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import chunked, free_name, table, write_table

U32 = np.uint32
BITS = 14
CHUNK = 100_000
# Families of common languages; a language that is not listed is a family of its own.
FAMILY = {
    **dict.fromkeys("en de nl sv da no nb nn is af lb fy yi".split(), "germanic"),
    **dict.fromkeys("fr es it pt ro ca gl oc la".split(), "romance"),
    **dict.fromkeys("ru uk be bg mk sr hr bs sl sk cs pl".split(), "slavic"),
    **dict.fromkeys("fi et hu".split(), "uralic"),
    **dict.fromkeys("tr az kk uz ky tk".split(), "turkic"),
    **dict.fromkeys("hi ur bn pa mr ne gu".split(), "indo-aryan"),
    **dict.fromkeys("ar he am mt".split(), "semitic"),
    **dict.fromkeys("id ms jv su tl".split(), "austronesian"),
}
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)]))
    return _letters[0]


def ngram_buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """([bucket of the n-gram at each character, for n = 2, 3, 4], start of each text, letters in each text). Each text ends in 4 spaces."""
    low = [t.lower() + "\0\0\0\0" for t in texts]
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=U32)
    letter = _letter_table()[c]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in low])[:-1]]).astype(np.int64)
    x = np.where(letter, c, U32(32))
    out = []
    with np.errstate(over="ignore"):
        h = x * U32(0x85EBCA6B)
        for n in (2, 3, 4):
            h = h * U32(0x01000193)
            h[: len(h) - n + 1] += x[n - 1 :] * U32(0xC2B2AE35)
            g = (h ^ (h >> U32(15))) * U32(0x2C1B3C6D)
            out.append((g >> U32(32 - BITS)).astype(np.int64))
    return out, starts, np.add.reduceat(letter.astype(np.int64), starts) if len(texts) else np.zeros(0, np.int64)


@dataclass
class Model:
    families: list[str]
    members: list[list[str]]
    family_w: np.ndarray  # families x (buckets + 1), the last column the bias
    pair_w: dict[int, np.ndarray]  # family -> pairs x (buckets + 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.families or not texts:
            return lang, score
        grams, starts, letters = ngram_buckets([t or "" for t in texts])
        n = np.array([len(t or "") + 4 for t in texts], dtype=np.float64) * len(grams)

        def values(w: np.ndarray) -> np.ndarray:
            return np.stack([sum(np.add.reduceat(row[:-1][g], starts, dtype=np.float64) for g in grams) / n + row[-1] for row in w], axis=1)

        top = values(self.family_w)
        fam, conf = top.argmax(axis=1), _sigmoid(top)
        conf = conf.max(axis=1)
        pairs = {f: values(w) for f, w in self.pair_w.items()}
        for i in np.flatnonzero(letters > 0).tolist():
            f = int(fam[i])
            names = self.members[f]
            if len(names) == 1:
                lang[i], score[i] = names[0], conf[i]
                continue
            wins, sums, at = [0] * len(names), [0.0] * len(names), 0
            for a in range(len(names)):
                for b in range(a + 1, len(names)):
                    v = float(pairs[f][i, at])
                    at += 1
                    wins[a if v >= 0 else b] += 1
                    sums[a] += v
                    sums[b] -= v
            best = max(range(len(names)), key=lambda k: (wins[k], sums[k], -k))
            lang[i], score[i] = names[best], float(conf[i] * _sigmoid(np.float64(sums[best] / (len(names) - 1))))
        return lang, np.clip(score, 0, 1)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4.0 * np.clip(v, -20, 20)))


@dataclass
class Rows:
    """Sparse vectors: those of row i are value[at[i] : at[i + 1]] at column[...]."""

    at: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def take(self, which: np.ndarray) -> Rows:
        n = np.diff(self.at)[which]
        at = np.concatenate([[0], np.cumsum(n)])
        index = np.repeat(self.at[which] - at[:-1], n) + np.arange(at[-1])
        return Rows(at, self.column[index], self.value[index])


def linear_svm(x: Rows, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """L2-regularised squared-hinge SVM by dual coordinate descent; y in {-1, 1}; classes weighted equally. Weights, then bias."""
    weight = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    d = 1 / (2 * c * weight)
    q = np.add.reduceat(x.value.astype(np.float64) ** 2, x.at[:-1]) + 1 + d
    a, w, bias, order = np.zeros(len(x)), np.zeros(1 << BITS, np.float32), 0.0, np.random.default_rng(7)
    parts = [(x.column[i:j], x.value[i:j]) for i, j in zip(x.at[:-1].tolist(), x.at[1:].tolist())]
    for _ in range(rounds):
        for i in order.permutation(len(x)).tolist():
            at, value = parts[i]
            old = a[i]
            a[i] = max(old - (y[i] * (float(value @ w[at]) + bias) - 1 + d[i] * old) / q[i], 0.0)
            if a[i] != old:
                step = (a[i] - old) * y[i]
                w[at] += np.float32(step) * value
                bias += step
    return np.append(w.astype(np.float64), bias)


def train(lang: list[str], x: Rows) -> Model:
    """lang of each row of x, the frequencies of its buckets."""
    if not lang:
        return Model([], [], np.zeros((0, 1)), {})
    langs = sorted(set(lang))
    families = sorted({FAMILY.get(n, n) for n in langs})
    members = [[n for n in langs if FAMILY.get(n, n) == f] for f in families]
    mean = np.bincount(x.column, x.value, minlength=1 << BITS) / len(x)
    scale = (1 / np.sqrt(mean + 1e-6)).astype(np.float32)
    value = x.value * scale[x.column]
    unit = float(np.sqrt((value.astype(np.float64) ** 2).sum() / len(x))) or 1.0
    x = Rows(x.at, x.column, value / np.float32(unit))
    names = np.array(lang)
    fam = np.array([FAMILY.get(n, n) for n in lang])

    def fit(rows: Rows, y: np.ndarray) -> np.ndarray:
        w = linear_svm(rows, y)
        w[:-1] *= scale / unit
        return w

    family_w = np.stack([fit(x, np.where(fam == f, 1.0, -1.0)) for f in families]) if len(families) > 1 else np.append(np.zeros(1 << BITS), 5.0)[None]
    pair_w = {}
    for k, own in enumerate(members):
        if len(own) > 1:
            found = []
            for i, p in enumerate(own):
                for q in own[i + 1 :]:
                    which = np.flatnonzero((names == p) | (names == q))
                    found.append(fit(x.take(which), np.where(names[which] == p, 1.0, -1.0)))
            pair_w[k] = np.stack(found)
    return Model(families, members, family_w, pair_w)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_lang: int = 200) -> Model:
    """Learn from about per_lang documents of every language: those with the least hash, by a threshold from the counts. One task learns."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("string").alias("d"), "text")
    counts = write_table(known.groupBy("lang").agg(F.count("*").alias("n")))
    # A row a language; beyond any number of real languages it is joined like any table.
    counts = F.broadcast(counts) if counts.count() <= 100_000 else counts
    unit = F.pmod(F.xxhash64("d", "lang"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.withColumn("u", unit).join(counts, "lang").where(F.col("u") * F.col("n") < per_lang).select("lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                grams, _, _ = ngram_buckets([text])
                n = np.bincount(np.concatenate(grams), minlength=1 << BITS)
                at = np.flatnonzero(n)
                out.append(np.stack([at, n[at]]).astype(np.uint32).tobytes())
            yield pa.record_batch({"lang": batch.column(0), "x": pa.array(out, pa.binary())})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each row once and in an order of its own, so that the model does not depend on how rows arrive.
        rows = sorted({r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())})
        pairs = [np.frombuffer(r[1], dtype=np.uint32).reshape(2, -1) for r in rows]
        at = np.concatenate([[0], np.cumsum([p.shape[1] for p in pairs])]).astype(np.int64)
        column = np.concatenate([p[0] for p in pairs]).astype(np.int64) if pairs else np.zeros(0, np.int64)
        value = np.concatenate([p[1] / p[1].sum() for p in pairs]).astype(np.float32) if pairs else np.zeros(0, np.float32)
        yield pa.record_batch({"model": pa.array([pickle.dumps(train([r[0] for r in rows], Rows(at, column, value)))], pa.binary())})

    made = sample.mapInArrow(features, "lang string, x binary").dropDuplicates().coalesce(1).mapInArrow(learn, "model binary")
    got = made.collect()
    return pickle.loads(got[0]["model"]) if got else train([], Rows(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)))


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs -> the same columns and the two results, string and double, under `names`."""
    docs = docs.drop(*names)
    schema = StructType(list(docs.schema.fields)).add(names[0], "string").add(names[1], "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, value = [], []
            for part in chunked(batch.column(batch.schema.get_field_index("text")).to_pylist(), lambda t: len(t or ""), CHUNK):
                a, b = model.predict(part)
                lang += a
                value.append(b)
            cols = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(np.concatenate(value) if value else np.zeros(0))], names=[*batch.schema.names, *names])

    return docs.mapInArrow(score, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: documents without a language, or with a prediction of under `least`, go; so do null and empty texts.

    The columns are those of docs, whatever their names. Repeated rows have one fate; an empty table gives an empty one.
    """
    names = (free_name(docs, "lang_found"), free_name(docs, "lang_score"))
    return predict(docs, fit(docs), names).where((F.col(names[0]) != "und") & (F.col(names[1]) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
