"""Operator 9, toxicity: a weighted lexicon matched by Aho-Corasick, with exception phrases.

Texts are folded first: lower case, look-alike letters of other scripts and digits or signs standing for letters. The
lexicon holds word beginnings (whole words among them) with their smoothed log odds of standing in a toxic document.
Both are learned by Spark from labelled documents of the training fold; so are the exceptions, pairs of adjacent words
around a lexicon hit that only clean documents have. A document's sum of weights, taken as it is and normalised by
length, goes through a logistic curve fitted on labelled documents that the lexicon has not seen.

Fitting takes at most MAX_LABELLED labelled documents, those with the smallest id hash; that is the one bound. All entries
and exceptions that these documents give are used: they are as few as the documents' own words. They and the feature
rows of a quarter of the documents reach the driver.

Defined cases: null and empty texts get the score of a text without hits; documents without label are scored like others;
null labels are not learned from; a label table with several rows for a document, and several documents of an id, count
each; without labelled rows of both kinds every score is the smoothed base rate; a very long text is read whole, and its
hits see their true neighbours however far; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.common import cut, map_texts, slices, table

#: Labelled documents that fitting may use.
MAX_LABELLED = 12_000
#: Documents with an entry, and its log odds, at least.
LEAST_DOCS, LEAST_ODDS = 5, 2.5
#: Lengths of word beginnings that may become entries; longer words are entries of their own.
STEMS = (3, 4, 5, 6)
THRESHOLD = 0.7

#: Look-alike letters and their Latin forms (fixed pairs, in code point order).
HOMOGLYPHS = {
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
#: Digits and signs that stand for letters (fixed pairs).
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_ALIKE = str.maketrans(HOMOGLYPHS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_HAS_ALIKE = re.compile("[" + "".join(map(chr, sorted(_ALIKE))) + "]")
_STANDS = re.compile(r"(?<=[^\W\d_])[0134-57@$!](?=[^\W\d_])|(?<![^\s\"'(])[0134-57@$](?=[^\W\d_]{2})")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii() and _HAS_ALIKE.search(text):
        text = text.translate(_ALIKE)
    return _STANDS.sub(lambda m: DIGITS[m[0]], text)


def terms(word: str) -> list[str]:
    return [word[:n] for n in STEMS if n < len(word)] + [word]


class Lexicon:
    """Entries are word beginnings with weights; exceptions are pairs of adjacent words in which a hit counts nothing."""

    def __init__(self, weights: dict[str, float], exceptions: set[tuple[str, str]] = frozenset()):
        self.exceptions = exceptions
        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        if weights:
            self.automaton.make_automaton()
        self.empty = not weights

    def hits(self, text: str) -> dict[int, float]:
        """Start of each matched word in the folded text to the weight of the longest entry it begins with."""
        out: dict[int, tuple[int, float]] = {}
        if self.empty:
            return {}
        for end, (size, weight) in self.automaton.iter(text):
            start = end + 1 - size
            if (start == 0 or not text[start - 1].isalpha()) and size > out.get(start, (0, 0))[0]:
                out[start] = (size, weight)
        return {s: w for s, (_, w) in out.items()}

    def sum(self, text: str) -> float:
        hits = self.hits(text)
        if hits and self.exceptions:
            free = {s for s, pairs in around(text, hits).items() if not self.exceptions.intersection(pairs)}
            hits = {s: w for s, w in hits.items() if s in free}
        return sum(hits.values())


def around(text: str, starts) -> dict[int, list[tuple[str, str]]]:
    """For each word that starts at one of the places: the pairs of adjacent words that it is in."""
    found = [(m.start(), m[0]) for m in _WORD.finditer(text)]
    out: dict[int, list[tuple[str, str]]] = {s: [] for s in starts}
    for (s, x), (t, y) in zip(found, found[1:]):
        if s in out:
            out[s].append((x, y))
        if t in out:
            out[t].append((x, y))
    return out


def features(text: str | None, lexicon: Lexicon) -> tuple[float, float, float]:
    """Of the sum of weights: its root, and by two lengths."""
    text = fold(text or "")
    total = lexicon.sum(text)
    if not total:
        return 0.0, 0.0, 0.0
    n = len(text.split())
    return min(math.sqrt(total), 10.0), min(total / math.sqrt(n + 10.0), 10.0), min(20.0 * total / (n + 50.0), 10.0)


def held_out(id_col: str, mod: int, rest: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest


def _counted(df: DataFrame, pairs_of) -> DataFrame:
    """(term, n_pos, n_neg) over _text and _toxic rows; pairs_of gives a document's distinct terms."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                pos, neg = Counter(), Counter()
                for text, toxic in zip(part.column("_text").to_pylist(), part.column("_toxic").to_pylist()):
                    (pos if toxic else neg).update(pairs_of(fold(text or "")))
                keys = list(pos | neg)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())],
                    names=["term", "n_pos", "n_neg"],
                )

    parts = df.mapInArrow(run, "term string, n_pos long, n_neg long")
    return parts.groupBy("term").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))


def learn(labelled: DataFrame) -> tuple[dict[str, float], set[tuple[str, str]]]:
    """Weights and exceptions from rows (_text, _toxic)."""
    n = {bool(r["_toxic"]): r["count"] for r in labelled.groupBy("_toxic").count().collect()}
    if not (n.get(True) and n.get(False)):
        return {}, set()
    odds = F.log((F.col("n_pos") + 0.5) / (n[True] + 1.0)) - F.log((F.col("n_neg") + 0.5) / (n[False] + 1.0))
    found = (
        _counted(labelled, lambda text: {t for w in set(_WORD.findall(text)) for t in terms(w)})
        .filter((F.col("n_pos") >= LEAST_DOCS) & (F.length("term") >= STEMS[0]))
        .withColumn("odds", odds)
        .filter(F.col("odds") >= LEAST_ODDS)
        .collect()
    )
    weights: dict[str, float] = {}
    rows = {r["term"]: r for r in found}
    for term in sorted(rows, key=len):  # a longer entry must say more than its beginning does
        r = rows[term]
        shorter = [weights[term[:k]] for k in range(STEMS[0], len(term)) if term[:k] in weights]
        if all(r["odds"] > s + 1.0 for s in shorter):
            weights[term] = float(r["odds"])
    lexicon = Lexicon(weights)

    def phrases(text: str) -> set[str]:
        return {" ".join(p) for pairs in around(text, lexicon.hits(text)).values() for p in pairs}

    clean = (
        _counted(labelled, phrases)
        .filter((F.col("n_pos") == 0) & (F.col("n_neg") >= 3))
        .collect()
    )
    return weights, {tuple(r["term"].split(" ")) for r in clean}


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method; the last coefficient is the constant."""
    a = np.c_[x, np.ones(len(x))]
    b = np.zeros(a.shape[1])
    ridge = np.diag([0.05] * x.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        b = b - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ b)
    return b


class Model:
    def __init__(self, weights: dict[str, float], exceptions: set, curve: list[float]):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve

    def scorer(self):
        lexicon, b = Lexicon(self.weights, self.exceptions), self.curve

        def score(text: str | None) -> float:
            f = features(text, lexicon)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(x * w for x, w in zip(f, b)) + b[-1]))))

        return score


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold_of: tuple[int, int] = (3, 1), most: int = MAX_LABELLED) -> Model:
    """Learns from labelled documents whose crc32(id) mod fold_of[0] is not fold_of[1]."""
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col("toxic").alias("_toxic"))
        .filter(F.col("_toxic").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id", *fold_of))
        .withColumn("_order", F.xxhash64("_id"))
        .orderBy("_order", "_id", "_toxic")
        .limit(most)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    labelled = cut(texts.join(F.broadcast(chosen), "_id").select("_text", (F.col("_toxic") == 1).alias("_toxic"), "_order"))
    shaping = F.pmod(F.col("_order"), F.lit(4)) == 0
    weights, exceptions = learn(labelled.filter(~shaping).select("_text", "_toxic"))
    seen = labelled.filter(shaping).withColumn("_toxic", F.col("_toxic").cast("int"))
    rows = map_texts(
        seen.withColumn("_both", F.concat(F.col("_toxic").cast("string"), F.coalesce("_text", F.lit("")))),
        "_toxic",
        "_both",
        lambda ts, lexicon: [features(t[1:], lexicon) for t in ts],
        "a double, b double, c double",
        setup=lambda: Lexicon(weights, exceptions),
    ).collect()  # at most a quarter of `most` rows
    x = np.array([[r["a"], r["b"], r["c"]] for r in rows]).reshape(-1, 3)
    y = np.array([r["_toxic"] for r in rows], float)
    if not len(x) or not 0 < y.sum() < len(y):
        return Model(weights, exceptions, [0.5, 0.5, 0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5 + (len(y) == 0)))])
    return Model(weights, exceptions, fit_curve(x, y).tolist())


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id and score."""
    return map_texts(docs, id_col, text_col, lambda texts, score: [(score(t),) for t in texts], "score double", setup=model.scorer)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
