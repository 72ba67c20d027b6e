"""Operator 3, language identification: words first, backing off to shorter and shorter character n-grams.

Spark counts every word of every training document by language, and every character n-gram of the counted words; all of
them are the model, in two written tables. A known word is scored by its own frequencies, an unseen one by those of its
longest known n-grams. The most frequent words (HOT_WORDS) are also sent to all tasks, so that only the other words of a
document are joined with the tables; each distinct unseen word is scored once. HOT_WORDS does not change any result.

Training rows: crc32(id as text) mod 5 is not 0, with text and language. Prediction uses the text alone.

Defined cases: text that is null or has no letter, and any text when nothing was learned, give `und` with score 0;
languages equal in score go to the first by name; equal rows give equal rows; very long texts are read whole, and very long words
cost as much as their letters; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.common import apart, cut, map_texts, slices, table, uncollected

#: Words that are sent to all tasks and need no join: the most frequent ones.
HOT_WORDS = 100_000
#: Lengths of n-grams, tried in this order; words get a mark at either end.
GRAMS = (4, 3, 2, 1)
#: Words of a document that count as independent evidence, for the score.
EVIDENCE = 30
#: Counted words that a task holds before it passes them on.
HELD_COUNTS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def _counts(batches, key_columns: list[str], add):
    """Yields batches of (lang, term, n) from what add(counters, batch) counts, whenever there are many."""
    counters: dict[str, Counter] = defaultdict(Counter)

    def flushed():
        for lang, c in counters.items():
            terms, ns = list(c), list(c.values())
            for a in range(0, len(terms), 50_000):
                part = pa.array(terms[a : a + 50_000], pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part)), part, pa.array(ns[a : a + 50_000], pa.int64())], names=["lang", "term", "n"])
        counters.clear()

    with uncollected():
        for batch in batches:
            for part in slices(batch, key_columns[0]):
                add(counters, *(part.column(k).to_pylist() for k in key_columns))
                if sum(map(len, counters.values())) > HELD_COUNTS:
                    yield from flushed()
        yield from flushed()


def count_words(rows: DataFrame) -> DataFrame:
    """(lang, term, n) over all words of (_text, _lang) rows."""

    def add(counters, texts, langs):
        for text, lang in zip(texts, langs):
            counters[lang].update(words_of(text))

    parts = rows.mapInArrow(lambda it: _counts(it, ["_text", "_lang"], add), "lang string, term string, n long")
    return parts.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame) -> DataFrame:
    """(lang, term, n) over the n-grams of counted words."""

    def add(counters, terms, langs, ns):
        for term, lang, n in zip(terms, langs, ns):
            c = counters[lang]
            for k in GRAMS:
                for g in grams_of(term, k):
                    c[g] += n

    parts = words.mapInArrow(lambda it: _counts(it, ["term", "lang", "n"], add), "lang string, term string, n long")
    return parts.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def _wide(counts: DataFrame, langs: list[str], totals: dict[str, int]) -> DataFrame:
    """(term, n, logs): all counts and the log frequencies by language, one row for each term."""
    by = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(langs)]
    wide = cut(counts.groupBy("term").agg(F.sum("n").alias("n"), *by))
    size = max(1, wide.count())
    logs = [F.log((F.col(f"n{i}") + 0.2) / F.lit(totals[x] + 0.2 * size)) for i, x in enumerate(langs)]
    return wide.select("term", "n", F.array(*logs).alias("logs"))


def _totals(counts: DataFrame) -> dict[str, int]:
    return {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}


class Model:
    """langs, and tables of the log frequencies of all learned words and n-grams; hot has the most frequent words."""

    def __init__(self, langs: list[str], words: DataFrame | None = None, grams: DataFrame | None = None, hot: dict[str, int] | None = None, hot_logs: np.ndarray | None = None):
        self.langs, self.words, self.grams = langs, words, grams
        self.hot, self.hot_logs = hot or {}, hot_logs

    def predict(self, text: str | None) -> tuple[str, float]:
        """One text; many are cheaper with identify()."""
        if not self.langs or not (text and words_of(text)):
            return "und", 0.0
        one = self.words.sparkSession.createDataFrame([(0, text)], "doc_id long, text string")
        row = identify(one, self).first()
        return row["lang_pred"], row["score"]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: tuple[int, int] = (5, 0), hot_words: int = HOT_WORDS) -> Model:
    """Learns from rows whose crc32(id) mod fold[0] is not fold[1]."""
    train = docs.select(
        F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"), F.col(id_col).alias("_id")
    ).filter(F.col("_text").isNotNull() & F.col("_lang").isNotNull() & F.coalesce(_rest("_id", fold[0]) != fold[1], F.lit(True)))
    counts = cut(count_words(train.select("_text", "_lang")))
    totals = _totals(counts)
    langs = sorted(totals)
    if not langs:
        return Model([])
    gram_counts = cut(count_grams(counts))
    words, grams = _wide(counts, langs, totals), _wide(gram_counts, langs, _totals(gram_counts))
    most = words.orderBy(F.desc("n"), "term").limit(hot_words).select("term", "logs").toArrow()
    hot = {t: i for i, t in enumerate(most.column("term").to_pylist())}
    logs = most.column("logs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs))
    return Model(langs, words, grams, hot, logs)


def _grams(words: DataFrame, k: int) -> DataFrame:
    """(wid, term, times): the distinct n-grams of each numbered word, made in time and space linear in the word."""

    def made(held):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, (pa.int64(), pa.string(), pa.int64()))], names=["wid", "term", "times"])

    def run(batches):
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for wid, word in zip(batch.column("wid").to_pylist(), batch.column("word").to_pylist()):
                for term, times in Counter(grams_of(word, k)).items():
                    for x, v in zip(held, (wid, term, times)):
                        x.append(v)
                if len(held[0]) > 50_000:
                    yield made(held)
                    held = ([], [], [])
        yield made(held)

    return words.select("wid", "word").mapInArrow(run, "wid long, term string, times long")


def _unseen(words: DataFrame, model: Model) -> DataFrame:
    """(word, logs) of words that were not learned: the mean over their known n-grams of the greatest length that has any.

    Only a word's number moves with its n-grams, and equal ones of a word count once with their times, so a word of a million
    letters is a million letters of work.
    """
    numbered = cut(words.withColumn("wid", F.monotonically_increasing_id()))
    n, parts, left = len(model.langs), [], numbered
    mean = F.array(*(F.sum(F.col("times") * F.col("logs")[i]) / F.sum("times") for i in range(n)))
    for k in GRAMS:
        found = cut(_grams(left, k).join(model.grams.select("term", "logs"), "term").groupBy("wid").agg(mean.alias("logs")))
        parts.append(found)
        left = cut(left.join(found, "wid", "left_anti"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return numbered.join(out, "wid").select("word", "logs")


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: predicted language and its posterior share."""
    n = len(model.langs)
    if not n:
        return docs.select(F.col(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast((model.hot, model.hot_logs))  # at most HOT_WORDS rows of numbers

    def parts(texts, hot):
        known, logs = hot
        rows = []
        for text in texts:
            words = words_of(text) if text else []
            ids, times, rest, rest_n = [], [], [], []
            for w, k in Counter(words).items():
                i = known.get(w)
                if i is None:
                    rest.append(w)
                    rest_n.append(k)
                else:
                    ids.append(i)
                    times.append(k)
            total = np.array(times) @ logs[ids] if ids else np.zeros(n)
            rows.append((len(words), total, rest, rest_n))
        return rows

    fields = "n_words long, total array<double>, rest array<string>, rest_n array<long>"
    keyed = docs.select(F.struct(F.monotonically_increasing_id().alias("r"), F.col(id_col).alias("id")).alias("_key"), F.col(text_col).alias("_text"))
    made = cut(map_texts(keyed, "_key", "_text", parts, fields, setup=lambda: held.value))
    rest = made.select(F.col("_key.r").alias("r"), F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select("r", F.col("x.rest").alias("word"), F.col("x.rest_n").alias("k"))
    distinct = rest.select("word").distinct().join(model.words.select(F.col("term").alias("word"), "logs"), "word", "left")
    distinct = cut(distinct)
    scored = distinct.filter("logs is not null").unionByName(_unseen(distinct.filter("logs is null").select("word"), model))
    sums = rest.join(scored, "word").groupBy("r").agg(*(F.sum(F.col("k") * F.col("logs")[i]).alias(f"s{i}") for i in range(n)))
    joined = made.select("_key", "n_words", "total", F.col("_key.r").alias("r")).join(sums, "r", "left")
    scale = F.least(F.col("n_words"), F.lit(EVIDENCE)) / F.greatest(F.col("n_words"), F.lit(1))
    logits = F.array(*((F.col("total")[i] + F.coalesce(F.col(f"s{i}"), F.lit(0.0))) * scale for i in range(n)))
    best = joined.select(F.col("_key.id").alias(id_col), "n_words", logits.alias("l")).withColumn("m", F.array_max("l"))
    share = 1 / F.aggregate("l", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("m")))
    names = F.array(*map(F.lit, model.langs))
    some = F.col("n_words") > 0
    return best.select(
        id_col,
        F.when(some, F.element_at(names, F.array_position("l", F.col("m")).cast("int"))).otherwise("und").alias("lang_pred"),
        F.when(some, share).otherwise(0.0).alias("score"),
    )


def _rest(id_col: str, mod: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = apart(spark, lambda: identify(docs, fit(docs)))
    return found.select("doc_id", (_rest("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
