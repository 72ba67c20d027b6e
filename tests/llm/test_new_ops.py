"""Spelling variants, SentencePiece and hard negatives against brute force or the library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tests.llm.test_corpus_ops import DOCS, EDGE, EMPTY_SHA, docs_of, rows_of


# -- op11 ---------------------------------------------------------------------------------------------------------------
def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, every=0, shortest=5, rarest=3, ratio=2):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= shortest and n >= rarest}
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = [n, len(near), best if best and words[best] >= ratio * n else None]
    result = {}
    for w, (n, k, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        result[w] = (n, k, form, out[form][0] if form else None, root)
    return result


def got_variants(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def random_texts(seed, n, letters="abé", size=7, words=30):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(4, size + 2))) for _ in range(60)]

    def word():
        w = rnd.choice(stems[: rnd.choice([5, 60])])
        if rnd.random() < 0.3:
            at = rnd.randrange(len(w))
            w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + rnd.choice(letters) + w[at:], w[:at] + rnd.choice(letters) + w[at + 1 :]])
        return w.upper() if rnd.random() < 0.1 else w

    return [" ".join(word() for _ in range(words)) for _ in range(n)]


@pytest.mark.parametrize("tile", [4_000_000, 300])
def test_variants_by_plain_comparison(spark, tile):
    from wayfare.llm import op11_variants as op

    texts = [*random_texts(3, 60), *EDGE]
    docs = docs_of(spark, texts)
    assert got_variants(op.spelling_variants(docs, delete_every=7)) == plain_variants(list(enumerate(texts)), 7)
    words = op.cut(op.count_words(docs, "doc_id", "text", op.RUN, 5, 3, 7))
    found = {r.word: r.n_near for r in op.near_words(words, tile).collect()}
    assert found == {w: k for w, (_, k, *_) in plain_variants(list(enumerate(texts)), 7).items() if k}


def test_variants_large_groups_and_long_words(spark):
    """Many words that share a half, and words of thousands of letters."""
    from wayfare.llm import op11_variants as op

    rnd = random.Random(8)
    shared = {"".join(["prefix", *(rnd.choice("abc") for _ in range(6))]) for _ in range(400)}
    long = "lo" * 3000
    texts = [" ".join([*shared, long, long, long[:-1], long + "x", long[:2999] + "q" + long[3000:]])] * 3
    docs = docs_of(spark, texts)
    assert got_variants(op.spelling_variants(docs)) == plain_variants(list(enumerate(texts)))


def test_variants_chains_and_ties(spark):
    from wayfare.llm import op11_variants as op

    text = " ".join(["abcdefgh"] * 3 + ["abcdefg"] * 6 + ["abcdef"] * 12 + ["abcde"] * 30 + ["zzzzz"] * 3 + ["zzzzy"] * 6 + ["zzzzx"] * 6 + ["lonely"] * 3)
    got = got_variants(op.spelling_variants(docs_of(spark, [text])))
    assert got["abcdefgh"] == (3, 1, "abcdefg", 6, "abcde")
    assert got["zzzzz"][2] == "zzzzx" and got["lonely"] == (3, 0, None, None, "lonely")
    assert got == plain_variants([(0, text)])


def test_variants_defined_cases(spark):
    from wayfare.llm import op11_variants as op

    assert op.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    assert op.spelling_variants(docs_of(spark, ["one two", None])).count() == 0
    rows = [(None, "words words words wordz"), (1, "words wordz wordz"), (1, "words wordz wordz")]
    clash = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    assert got_variants(op.spelling_variants(clash, delete_every=3)) == plain_variants(rows, 3)


def test_op11_query(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["op11_variants"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got_variants(got) == plain_variants([(r.doc_id, r.text) for r in docs], 97)


# -- op12 ---------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def model():
    from wayfare.llm import op12_pieces as op

    return op.read_model(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def lib():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_like_the_library(model, lib):
    from wayfare.llm import op12_pieces as op

    p, rnd = op.Pieces(model), random.Random(12)
    parts = ["a", "e", "th", "▁", " ", "  ", "\n", "中", "文", "😀", "ing", "the", "\x00", "ß", ".", "'s", "0", "12", "́", "<s>", "<0x0A>", "   ", "==", "_", "²", "a_b", "\t"]
    for i in range(4000):
        t = "".join(rnd.choice(parts if i % 3 else " aeth_.") for _ in range(rnd.randrange(0, 60)))
        ids = lib.encode(t)
        assert p.encode(t) == ids, t
        assert p.decode(ids) == lib.decode(ids)
    for _ in range(1000):  # any ids, broken bytes among them
        ids = [rnd.randrange(3, 300) if rnd.random() < 0.5 else rnd.randrange(32000) for _ in range(rnd.randrange(1, 10))]
        assert p.decode(ids) == lib.decode(ids)


def test_pieces_of_long_texts(model, lib):
    from wayfare.llm import op12_pieces as op

    p, rnd = op.Pieces(model), random.Random(2)
    for t in ("a" * 100_000, " " * 50_000, "thethe" * 20_000, "".join(rnd.choice("abcdé中") for _ in range(100_000))):
        assert p.encode(t) == lib.encode(t)


def test_cut_is_the_merging(model):
    """Backtracking against merging, for vocabularies with tied scores and pieces that merging never makes."""
    from wayfare.llm import op12_pieces as op

    rnd = random.Random(5)
    for _ in range(150):
        p = op.Pieces.__new__(op.Pieces)
        vocabulary = list(dict.fromkeys([*"abc", *("".join(rnd.choice("abc") for _ in range(rnd.randrange(2, 6))) for _ in range(14))]))
        p.ids = {w: i for i, w in enumerate(vocabulary)}
        p.text, p.order = vocabulary, {w: float(rnd.randrange(6)) for w in vocabulary}
        p.tables()
        for _ in range(40):
            t = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 20)))
            assert p._cut(t) == p.merged(t), (t, p.order)


def test_sentencepiece_rows(spark, model, lib):
    from wayfare.llm import op12_pieces as op

    got = rows_of(op.encode_digests(docs_of(spark, EDGE), model))
    assert got[0].n_tokens == 0 and got[0].ids_sha256 == EMPTY_SHA and got[0].decoded_sha256 == EMPTY_SHA
    for i, t in enumerate(EDGE):
        ids = lib.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    clash = spark.createDataFrame([(None, "x y", "q", 1), (1, "x y", "q", 1)], "doc_id long, text string, ids string, n_tokens long")
    assert [tuple(r)[1:] for r in op.encode_digests(clash, model).collect()].count(tuple(got[0])[1:]) == 0
    assert op.encode_digests(spark.createDataFrame([], DOCS), model).count() == 0
    ids = op.encode_texts(docs_of(spark, EDGE), model)
    texts = rows_of(op.decode_ids(ids, model))
    assert all(texts[i].text == (t or "").replace("▁", " ") for i, t in enumerate(EDGE))


def test_op12_query(spark, lib):
    import __spark_entry__

    got = rows_of(__spark_entry__.queries()["op12_sentencepiece"](spark, "/root/testdata/sf0.001"))
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = lib.encode(r.text or "")
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


# -- op13 ---------------------------------------------------------------------------------------------------------------
def plain_negatives(rows, every=100, positives=5, negatives=5, low=80, scale=256):
    """rows: (id, vector, label); identity is the place in the list."""
    use = []
    for i, (vid, x, label) in enumerate(rows):
        if label is None or not x or any(c is None or not np.isfinite(c) for c in x):
            continue
        use.append((i, vid, [int(np.floor(scale * float(c))) for c in x], label))
    out = []
    order = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    for i, vid, v, label in use:
        if vid is None or vid % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), wid, j, lab) for j, wid, w, lab in use if j != i]
        for ps, pid, _, _ in sorted((s for s in scored if s[3] == label), key=order)[:positives]:
            inside = [s for s in scored if s[3] != label and low * ps <= 100 * s[0] <= 100 * ps]
            out += [(vid, pid, r, s[1], ps, s[0]) for r, s in enumerate(sorted(inside, key=order)[:negatives], 1)]
    return sorted(out, key=str)


def got_negatives(df):
    c = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in df.select(*c).collect()), key=str)


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed, n, dim=6, labels=4, coarse=False):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)).astype(np.float32)
    if coarse:
        x = np.round(x).astype(np.float32) / 4
    share = r.random(n)
    return [(i, x[i].tolist(), 0 if share[i] < 0.4 else int(r.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("coarse", [False, True])
@pytest.mark.parametrize("small", [False, True])
def test_negatives_by_plain_comparison(spark, monkeypatch, coarse, small):
    from wayfare.llm import op13_negatives as op

    if small:  # many blocks, parts and anchor blocks
        for name, value in (("HELD", 600), ("PART", 60), ("ANCHORS", 24), ("AT_ONCE", 7)):
            monkeypatch.setattr(op, name, value)
    rows = vectors(1, 400, coarse=coarse)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = got_negatives(op.hard_negatives(df, every=10))
    assert got == plain_negatives(rows, every=10) and got


def test_negatives_defined_cases(spark):
    from wayfare.llm import op13_negatives as op

    nan = float("nan")
    rows = [(0, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (2, [1.0, 2.0], 2), (None, [1.0, 2.0], 2), (3, [1.0], 2), (4, None, 1), (5, [None, 1.0], 1), (6, [nan, 1.0], 2)]
    rows += [(7, [], 1), (8, [1.0, 2.0], None), (100, [-1.0, 0.5], 3), (100, [-1.0, 0.5], 3), (9, [1.0, 1.9], 3)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], VECTORS + ", row int, score string")
    assert got_negatives(op.hard_negatives(df)) == plain_negatives(rows)
    assert op.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    huge = [(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 1), (2, [1e30, 0.0], 2), (3, [-1.0, 0.0], 2)]
    assert [r[:4] for r in got_negatives(op.hard_negatives(spark.createDataFrame(huge, VECTORS)))] == [(0, 1, 1, 2)]


def test_op13_and_op4_queries_by_sql(spark):
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    con.execute("create view embeddings as from '/root/testdata/sf0.01/embeddings.parquet'")
    for name in ("op13_negatives", "op4_topk"):
        sql = __spark_entry__.oracle_sql()[name]
        df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.01")
        want = con.execute(f"select {', '.join(df.columns)} from ({sql})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(want) and want


# -- op10 and op3: clustered labels, long words ---------------------------------------------------------------------------
def clustered(share, n, dim=32, seed=3, spread=0.06):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    k = int(share * n)
    x[:k] = r.standard_normal(dim) + spread * r.standard_normal((k, dim))
    far = x[k:]
    pairs = np.arange(0, len(far) - 1, 10)
    far[pairs + 1] = far[pairs] + 0.02 * r.standard_normal((len(pairs), dim))  # close pairs among the others
    return x, k


@pytest.mark.parametrize("share", [0.3, 0.5, 0.7, 0.9])
def test_forest_splits_beside_a_dense_group(spark, share):
    from wayfare.llm import op10_forest as op

    x, k = clustered(share, 6000)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(8)
    reps = df.select(F.col("vec_id").alias("rid"), F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("x"))
    reps = op.cut(op.usable(reps).select(F.col("rid").alias("rep"), "label", F.lit(1).cast("long").alias("n"), "v"))
    placed = op.cut(op.leaves(reps, 0.98, op.TREES, op.LEAF))
    others = placed.filter(F.col("rep") >= k).groupBy("node").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert others <= 2 * op.LEAF  # no leaf keeps vectors that directions could separate
    assert placed.count() <= 3 * op.TREES * len(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    got = rows_of(op.near_vectors(df), "vec_id")
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= near.sum(axis=1)).all()
    assert links[:k].sum() >= 0.95 * near[:k].sum() and links[k:].sum() >= 0.95 * near[k:].sum() > 0


def plain_language(model_rows, text, n_langs, words, grams):
    """The backoff by plain counting: log frequencies of known words, else of the longest known n-grams."""
    from wayfare.llm import op03_language as op

    total = np.zeros(n_langs)
    for w in op.words_of(text or ""):
        if w in words:
            total += words[w]
            continue
        for k in op.GRAMS:
            known = [grams[g] for g in op.grams_of(w, k) if g in grams] if len(w) + 2 * (k > 1) >= k else []
            if known:
                total += np.mean(known, axis=0)
                break
    return total


def test_language_by_plain_counting(spark):
    from wayfare.llm import op03_language as op

    rnd = random.Random(2)
    stems = {x: ["".join(rnd.choice(x + "e") for _ in range(rnd.randrange(2, 8))) for _ in range(60)] for x in ("abc", "cdf", "fgh")}
    texts, langs = [], []
    for i in range(120):
        lang = rnd.choice(list(stems))
        texts.append(" ".join(rnd.choice(stems[lang]) + rnd.choice(["", "", "x", "q"]) for _ in range(6)))
        langs.append(lang)
    texts += [None, "", "123", "zzzz öö", "a" * 30]
    langs += ["abc"] * 5
    docs = docs_of(spark, texts, langs=langs)
    model = op.fit(docs, hot_words=20)
    table = lambda df: {r.term: np.array(r.logs) for r in df.select("term", "logs").collect()}
    words, grams = table(model.words), table(model.grams)
    for i, r in rows_of(op.identify(docs, model)).items():
        n = len(op.words_of(texts[i] or ""))
        if not n:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logits = plain_language(None, texts[i], 3, words, grams) * min(n, op.EVIDENCE) / n
        share = np.exp(logits - logits.max())
        assert r.lang_pred == model.langs[int(np.argmax(np.round(logits, 9)))] and abs(r.score - 1 / share.sum()) < 1e-9
    assert op.identify(spark.createDataFrame([], DOCS), model).count() == 0


def test_language_of_a_very_long_word(spark):
    import time

    from wayfare.llm import op03_language as op

    rnd = random.Random(4)
    docs = docs_of(spark, ["abab baba"] * 8 + ["cdcd dcdc"] * 8, langs=["ab"] * 8 + ["cd"] * 8)
    model = op.fit(docs)
    long = docs_of(spark, ["".join(rnd.choice("cd") for _ in range(1_000_000)), "x" * 1_000_000])
    start = time.time()
    got = rows_of(op.identify(long, model))
    assert got[0].lang_pred == "cd" and time.time() - start < 90


def test_language_on_held_out_rows(spark):
    from wayfare.llm import op03_language as op

    got = op.op3_language(spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    by = got.filter("lang is not null and lang_pred <> 'und'").groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).collect()
    assert len(by) >= 4 and all(r.a >= 0.95 for r in by if r.n >= 20)
