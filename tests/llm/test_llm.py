"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns; and against brute force."""

import hashlib
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from linkora.llm import fingerprint, html_text, lang_id, license_scan, line_dedup, ngram_join, packing, pii, quality, sentencepiece_nbest

RNG = random.Random(3)
WORDS = ["".join(RNG.choices("abcdefghij", k=RNG.randrange(2, 8))) for _ in range(300)]


def text(n, lines=4):
    return "\n".join(" ".join(RNG.choices(WORDS, k=n // lines)) for _ in range(lines))


def near(t, edits):
    w = t.split(" ")
    for _ in range(edits):
        w[RNG.randrange(len(w))] = "changed" + str(RNG.random())[2:6]
    return " ".join(w)


BASE = [text(RNG.randrange(40, 300)) for _ in range(12)]
ROWS = [(i, t) for i, t in enumerate(BASE + [near(BASE[0], 1), near(BASE[0], 2), near(BASE[1], 30), BASE[2], "", "one", "one two", "ONE two", "  \n \t", text(4000)])]
ROWS += [(100, None), (None, BASE[3]), (5, BASE[5]), (5, BASE[5])]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rk string, id string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr")[(i or 0) % 2], "src0", len(t or ""), "x", "y", "z") for i, t in ROWS]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_op1(spark, docs, empty):
    path = sentencepiece_nbest.public_model()
    sp = sentencepiece_nbest.model(path)

    def brute(t, most):
        s, out = sp.surface(t), []

        def go(i, score):
            if i == len(s):
                out.append(score)
                return
            for n in range(1, min(sp.longest, len(s) - i) + 1):
                if (p := sp.pieces.get(s[i : i + n])) is not None:
                    go(i + n, score + p[1])
                elif n == 1:
                    go(i + 1, score + sp.unknown)

        go(0, 0.0)
        return sorted(out, reverse=True)[:most]

    for t in ("hello a", "the\ncat", "a  b", "é☃x", "ab ab", " "):
        found = sp.encode([t], 5)[0]
        assert [s for s, _ in found] == pytest.approx(brute(t, 5))
        assert len({tuple(i.tolist()) for _, i in found}) == len(found)
        assert all(sp.decode(i.tolist()) == t for _, i in found)
    rows = sentencepiece_nbest.encode_nbest(docs, path, 3, digest=True).collect()
    assert len(rows) == len(ROWS) and all(r.round_trip for r in rows)
    ids = sentencepiece_nbest.encode_nbest(docs.where("doc_id = 1"), path, 3)
    assert {r.text for r in sentencepiece_nbest.decode_ids(ids, path).collect()} == {ROWS[1][1]}
    assert sentencepiece_nbest.encode_nbest(empty, path, 3, digest=True).count() == 0


def test_op2(docs, empty):
    got = {r.doc_id: r for r in quality.quality(docs.where("doc_id < 100")).collect()}
    for i, t in ROWS:
        if i is None or i >= 100:
            continue
        w = t.split()
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {j + k for j, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
    assert quality.quality(docs).count() == len(ROWS) and quality.quality(empty).count() == 0


def sets(t, k=3):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_op3(docs, empty):
    have = [(i, sets(t)) for i, t in ROWS if i is not None]
    low = {i: i for i, _ in have}
    for _ in have:
        for a, x in have:
            for b, y in have:
                if x and y and 100 * len(x & y) >= 90 * len(x | y):
                    low[a] = low[b] = min(low[a], low[b])
    got = ngram_join.jaccard_components(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {i: (len(s), low[i]) for i, s in have}
    assert [r.component_id for r in got if r.doc_id is None] == [3]
    assert ngram_join.jaccard_components(empty).count() == 0


def test_op4(spark, empty):
    rows = [("a/LICENSE", "x\nReleased under the MIT License."), ("a/b/c.py", "code"), ("a/b/d.py", "Licensed under the Apache License, Version 2.0."), ("q/e.py", None), (None, ""), ("a/b/c.py", "code"), ("LICENSES.txt", "All rights reserved.")]
    got = [tuple(r) for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).select("path", "own_license", "license", "inherited_from").collect()]
    assert sorted(got, key=str) == sorted([("a/LICENSE", "MIT", "MIT", None), ("a/b/c.py", None, "MIT", "a"), ("a/b/c.py", None, "MIT", "a"), ("a/b/d.py", "Apache-2.0", "Apache-2.0", None), ("q/e.py", None, None, None), (None, None, None, None), ("LICENSES.txt", "LicenseRef-Proprietary", "LicenseRef-Proprietary", None)], key=str)
    assert license_scan.scan(license_scan.documents_as_files(empty)).count() == 0


def test_op5(docs, empty):
    from tokenizers import Tokenizer

    path = packing.public_tokenizer()
    tok = Tokenizer.from_file(path)
    odd = "a<|endoftext|>b  \n\n cé☃ 1234 don't"
    assert packing.encoder(path).encode(odd, allowed_special="all") == tok.encode(odd, add_special_tokens=False).ids
    got = packing.pack(docs, path, window=64, shard=5).collect()
    ids = {(i, crc32(a.tobytes())): a for i, t in ROWS for a in [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")]}
    lengths, seq = Counter(), Counter()
    for r in got:
        assert any(i == r.doc_id and len(a) == r.doc_tokens and crc32(a[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for (i, _), a in ids.items())
        lengths[r.doc_id] += r.length
        seq[r.sequence_id] += r.length
    want = Counter()
    for i, t in ROWS:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert lengths == want and all(n == 64 or n & (n - 1) == 0 for n in seq.values())
    assert packing.pack(empty, path).count() == 0


def test_op6(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></ul></nav><header>top</header><div class='cookie notice'>We use, cookies</div><article class=post><h1>Head &amp; line</h1><p>One,  two<br>three<p><b>four<p>five&nbsp;six</p><form><p>mail</form><script>'</p>'</script></article><div id=comments><p>me, too</div><aside><p>x</aside><footer>&copy;</footer></body>"
    assert html_text.main_text(page) == "Head & line\nOne, two three\nfour\nfive six"
    assert html_text.main_text("plain") == "plain" and html_text.main_text(None) == "" and html_text.main_text("<div>" * 3000 + "deep") == "deep"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", ""), (1, "u", page)], "page_id long, url string, html string")
    assert [r.n_chars for r in html_text.extract(rows).orderBy("page_id").collect()] == [0, 40, 40, 0]


def test_op7(spark, empty):
    words = {"en": "the of and with ing", "de": "der die und ung sch", "fr": "le la eau que oui", "es": "el los ción que mente"}
    rows = [(i, " ".join(RNG.choices(words[x].split(), k=40)), x) for i in range(400) for x in [("en", "de", "fr", "es")[i % 4]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = lang_id.fit(df, per_lang=50)
    got = lang_id.predict(df, m).withColumn("held", lang_id.held_out()).collect()
    held = [r for r in got if r.held]
    assert {r.doc_id for r in held} == {i for i, _, _ in rows if crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (None, "the of and")], "doc_id long, text string")
    assert [r.lang_pred for r in lang_id.predict(odd, m).orderBy("doc_id").collect()] == ["en", "und", "und", "und"]
    assert lang_id.predict(empty, lang_id.fit(empty)).count() == 0


def test_op8(docs, empty):
    have = [(i, t) for i, t in ROWS if i is not None]
    first, keep = {}, {}
    lines = sorted({(i, j, line_dedup.normalised(s)) for i, t in have for j, s in enumerate((t or "").split("\n")) if len(line_dedup.normalised(s)) >= 30})
    grams = {s: {s[q : q + 7] for q in range(max(len(s) - 6, 1))} for _, _, s in lines}
    names = list(grams)
    low = {s: s for s in names}
    for _ in range(3):
        for a in names:
            for b in names:
                x = len(grams[a] & grams[b])
                if 100 * x >= 85 * (len(grams[a]) + len(grams[b]) - x):
                    low[a] = low[b] = min(low[a], low[b])
    for i, j, s in lines:
        first.setdefault(low[s], (i, j))
    keep = set(first.values())
    judged = {(i, j) for i, j, _ in lines}
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs.where("doc_id is not null")).collect()}
    for i, t in have:
        want = None if t is None else "\n".join(s for j, s in enumerate(t.split("\n")) if (i, j) not in judged or (i, j) in keep)
        assert got[i] == want
    assert line_dedup.dedup_lines(docs).count() == len(ROWS) and line_dedup.dedup_lines(empty).count() == 0


def test_op9(spark, docs, empty):
    rows = [(1, "Mail A.Bc9@Mail8.example.com or a.bc9@mail8.example.com, +1 (269) 555-3296, +12695553296, 4111 1111 1111 1111, 42.144.35.254."), (2, "Mrs. Anna Weber, Mr. WEBER; г-жа Анна Иванова; DE89 3704 0044 0532 0130 00; password=b7db7aa4; 123-45-6789"), (3, None), (4, ""), (1, "x@y.org x@y.org")]
    got = [r.text for r in pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id", "text").collect()]
    a = next(t for t in got if t and t.startswith("Mail"))
    words = a.replace(",", "").split()
    assert "555-3296" not in a and words[1].lower() == words[3] and words[1] != rows[0][1].split()[1]
    b = next(t for t in got if t and t.startswith("Mrs."))
    assert "Weber" not in b and b.split(",")[0].split()[-1].upper() == b.split("Mr. ")[1].split(";")[0] and "Иванова" not in b
    iban = b.split(";")[2].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert None in got and "" in got
    many = spark.createDataFrame([(i, f"u{i}@e.org 10.0.{i % 250}.{i // 250}") for i in range(2000)], "doc_id long, text string")
    out = [r.text.split() for r in pii.surrogates(many, "k").collect()]
    assert len({x[0] for x in out}) == len({x[1] for x in out}) == 2000
    assert pii.surrogates(docs, "k").count() == len(ROWS) and pii.surrogates(empty, "k").count() == 0


def test_op10(docs, empty):
    order = sorted(ROWS, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    got = fingerprint.document_fingerprints(docs, bucket_size=4).collect()
    want = Counter()
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        want[(i, hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want
    a, b = BASE[0], near(BASE[0], 20)
    x, y = Counter(a.split()), Counter(b.split())
    true = sum((x & y).values()) / sum((x | y).values())
    p = fingerprint.fingerprints([a, b, a, ""], 4096)
    assert p[0] == p[2] and p[3] == b"" and abs(fingerprint.likeness(p[0], p[1]) - true) < 0.05
    assert fingerprint.document_fingerprints(empty).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(BASE + [near(BASE[0], 1), BASE[4], "123", "Call x@y.org " + text(60)])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(12)) <= got and 15 in got and not got & {13, 14}
