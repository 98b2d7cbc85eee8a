"""The ten queries and the pipeline against SQL or brute force on the smallest tables."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest

from quillspark.llm import decontam, langid, minhash, pii, queries
from tests.oracle import same

QUERIES, ORACLES = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, sf_dir, name):
    same(spark, QUERIES[name], ORACLES[name], sf_dir)


def python_feistel(text, domain, key, letters=26):
    """A plain version of the permutation of strings."""
    half = len(text) // 2
    l, r = text[:half], text[half:]

    def moved(part, other, i):
        out = ""
        for c in part:
            v = int(hashlib.sha256("|".join([key, domain, str(i), str(places[c_at(out)]), other]).encode()).hexdigest()[:15], 16)
            out += shift(c, v)
        return out

    def c_at(out):
        return len(out)

    places = range(len(text) + 1)

    def shift(c, v):
        for base, size, low, high in ((48, 10, "0", "9"), (97, letters, "a", "z"), (65, 26, "A", "Z")):
            if low <= c <= high:
                return chr((ord(c) - base + v % size) % size + base)
        return c

    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            l = moved(l, r, i)
        else:
            r = moved(r, l, i)
    return l + r


def test_op2_changes_only_personal_data(spark, sf_dir, docs):
    finder = re.compile(r"(?<![\w.%+@-])(?:[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}|\+1 \(\d{3}\) \d{3}-\d{4}(?!\w)|(?:\d{1,3}\.){3}\d{1,3}(?![\w-]|\.\d)|\d{16}(?![\w-])|AKIA[A-Z0-9]{16}(?!\w)|(?=[0-9a-f]*[0-9])[0-9a-f]{32,128}(?!\w))")
    pairs: dict[str, set] = {}
    found = 0
    for r in QUERIES["op2_pii"](spark, sf_dir).collect():
        old = docs[r.doc_id]
        olds, news = finder.findall(old), finder.findall(r.text)
        assert finder.split(old) == finder.split(r.text)
        assert len(olds) == len(news)
        for a, b in zip(olds, news):
            pairs.setdefault(a, set()).add(b)
            assert len(a) == len(b) or "." in a
        found += r.n_pii
        assert r.n_pii == sum(r[f"n_{k}"] for k in pii.PATTERNS)
    assert found > 20
    assert all(len(v) == 1 for v in pairs.values())  # equal values stay linked
    for a, (b,) in pairs.items():
        if "@" in a:
            stem = a.rsplit(".", 1)[0]
            assert b == python_feistel(stem, "email", pii.DEMONSTRATION_KEY) + a[len(stem) :]
        if re.fullmatch(r"\d{16}", a):
            luhn = lambda s: sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(s))) % 10
            if luhn(a):  # no card number
                assert a == b
                continue
            assert luhn(b) == 0
            assert b[:15] == a[0] + python_feistel(a[1:15], "card", pii.DEMONSTRATION_KEY)


def test_op3_brute_force(spark, sf_dir, docs):
    from collections import Counter

    raw = {k: t.encode() for k, t in docs.items()}
    counts = Counter(b[i : i + 200] for b in raw.values() for i in range(len(b) - 199))
    for r in QUERIES["op3_suffix_dedup"](spark, sf_dir).collect():
        b = raw[r.doc_id]
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if counts[b[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op4_equals_the_library(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    for r in QUERIES["op4_bpe"](spark, sf_dir).collect():
        ids = t.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op5_accuracy(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op5_langid"](spark, sf_dir).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.95 * len(tested)


def test_op8_equals_the_library(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in QUERIES["op8_token_files"](spark, sf_dir).collect()}
    at = 0
    for k in sorted(docs):
        ids = [*t.encode(docs[k], add_special_tokens=False).ids, 1]
        assert (rows[k].start, rows[k].n_tokens) == (at, len(ids))
        assert rows[k].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_op9_brute_force(spark, sf_dir):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    last: dict[bytes, int] = {}
    for k, b in pages.items():
        last[b] = max(k, last.get(b, k))
    rows = QUERIES["op9_warc"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        b = pages[r.page_id]
        refers = None if last[b] == r.page_id else last[b]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == ("response" if refers is None else "revisit", refers)


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_pipeline_brute_force(spark, sf_dir, docs):
    """Each stage's decision, made again in plain Python where it is deterministic."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "pii", "bpe"]
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    lettered = {k: t for k, t in docs.items() if re.search(r"[^\W\d_]", t)}

    def shingles(text):
        low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", low) if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {k: shingles(t) for k, t in lettered.items()}
    comp = {k: k for k in sets}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    single = [k for k in ids if root(k) == k]
    items = [plain_words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 8]) for w in items if w for i in range(max(1, len(w) - 7))}
    lengths = {len(w) for w in windows}

    def dirty(text):
        w = plain_words(text)
        return any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))

    # benchmark passages are planted in the table, and none of them is left
    assert sum(map(dirty, docs.values())) > 0
    assert sorted(rows) == [k for k in single if not dirty(lettered[k])]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    changed = 0
    for k, r in rows.items():
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids
        assert (r.n_tokens, r.n_chars) == (len(r.ids), len(r.text))
        changed += r.text != docs[k]
        # every e-mail address was replaced
        old = re.findall(r"[\w.]+@[\w.]+\.[a-z]{2,}", docs[k])
        assert not old or r.text != docs[k]
    assert changed > 0


def test_language_profiles_are_ranked():
    codes = langid.grams("ab ab")
    assert len(codes) == 4 + 6 + 4
    assert langid.Profiles({"x": langid.ranked(codes).tolist()}).predict("ab ab") == ("x", 1.0)
    assert langid.Profiles({"x": [1]}).predict("12 !") == ("und", 0.0)
    assert minhash.SKETCH >= minhash.LISTED


def test_pipeline_drops_every_planted_passage(spark, sf_dir, docs):
    """Whatever holds a whole benchmark item of eight words or more must not come out, and clean documents must."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {r.doc_id for r in corpus_pipeline.benchmark(spark, table, sf_dir).select("doc_id").collect()}
    items = [" ".join(w) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(w := plain_words(r.text)) >= 8]
    planted = {k for k, t in docs.items() if any(f" {i} " in f" {' '.join(plain_words(t))} " for i in items)}
    assert planted
    assert not planted & out
    report = {r.doc_id for r in decontam.report(table, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0").collect()}
    assert out == set(docs) - report
