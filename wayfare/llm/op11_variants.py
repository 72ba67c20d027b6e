"""Operator 11, grouping of spelling variants by asymmetric q-chunks.

Words and their numbers of occurrences are counted over all texts: a task counts the runs of one slice of texts before
anything is shuffled. Two words are near if one edit of a code point turns one into the other. Of a pair, the shorter
word (or the smaller of equal lengths) contributes two disjoint chunks, its halves; the other one its positional grams. One
edit leaves a chunk whole, which then is a gram of the other word at the same place or, behind an insertion, one later. So
chunks and grams join on (length of the chunk's word, which half, characters); of the grams only those are sent that stand
within that shift of a chunk, as the others could not join.

Rows that share a key meet in a task and are verified there. A large group is not compared pair by pair: what is left of the
words has one edit in turn, so its own halves split the group again, down to a few words. A pair is taken in one
place only, given by where its first difference stands, so counts need no list of pairs: a task passes on, for each word, how
many near words it found and the best of them. Keys of over TILE rows are cut into pairs of chunks, none dropped. Forms are
followed by doubling: a form has at least twice the occurrences, so chains are short.

Defined cases: null text has no words; a null id counts as an empty one where deleted characters are chosen; equal rows count
as often as they occur; words of any length and texts of any length are handled whole; of near words of equal n the first in
code-point order is the form; an empty table, or one without words, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.common import apart, cut, join_hot, slices, table, tiled, uncollected

RUN, SHORTEST, RAREST, RATIO, DELETE_EVERY = "[A-Za-zÀ-ÿ]+", 5, 3, 2, 97
#: Distinct words that a task counts before it passes them on; characters (with 16 for each row) of a tile; pairs compared directly.
HELD, TILE, FEW = 100_000, 4_000_000, 64


def words_of(doc_id: str, text: str, find, every: int) -> Counter:
    """Words of a text: runs in lower case (A-Z only), some with one code point deleted, chosen by id and run."""
    runs = Counter(find(text.encode("utf-8", "replace").lower().decode()))  # bytes.lower() changes A-Z only
    if every:
        head = zlib.crc32(f"{doc_id}:".encode())
        for run, n in [x for x in runs.items() if zlib.crc32(x[0].encode(), head) % every == 0]:
            at = zlib.crc32(run.encode(), head) % len(run)
            runs[run] -= n
            runs[run[:at] + run[at + 1 :]] += n
    return runs


def count_words(docs: DataFrame, id_col: str, text_col: str, pattern: str, shortest: int, rarest: int, every: int) -> DataFrame:
    """(word, n): words of at least so many code points and occurrences."""
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        find, held = re.compile(pattern).findall, Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                with uncollected():
                    for i, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                        for w, n in words_of(i, t or "", find, every).items():
                            if n and len(w) >= shortest:
                                held[w] += n
                if len(held) > HELD:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    return src.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rarest)


def signatures(words: DataFrame) -> DataFrame:
    """(key, word, n, size, len, second, own): the two chunks of each word, and its grams that may meet those of a shorter one.

    A word's chunk is a gram of its own too, at the same place; one row stands for both. own: whether it is a chunk.
    """
    length = F.length("word")

    def half(short: int, second: bool):
        """A half of a word that is shorter by so many, as characters of this one."""
        of = length - short
        q = F.floor(of / 2).cast("int")
        chars = F.substring("word", length - (of - q) + 1, of - q) if second else F.substring("word", F.lit(1), q)
        return F.struct(of.alias("len"), F.lit(second).alias("second"), F.lit(not short).alias("own"), F.xxhash64(of, F.lit(second), chars).alias("key"))

    rows = words.select("word", "n", (length + 16).alias("size"), F.explode(F.array(*(half(d, s) for d in (0, 1) for s in (False, True)))).alias("s"))
    return rows.select("s.key", "word", "n", "size", "s.len", "s.second", "s.own").filter("len > 0")


def near_pairs(xs: list[str], ys: list[str], a: int, b: int, lo: int, hi: int) -> Iterator[tuple[str, str]]:
    """Pairs x, y of which y is x with one code point replaced or inserted, whose first difference is at lo <= place < hi.

    All x have one length, and every y that or one more; all share a code points at the start and b at the end.
    """
    if not xs or not ys:
        return
    n = len(xs[0])
    core = n - a - b
    if len(xs) * len(ys) <= FEW or core < 2:
        for x in xs:
            for y in ys:
                same = next((i for i in range(a, n) if x[i] != y[i]), n)
                if lo <= same < hi and x != y and x[same + (len(y) == n) :] == y[same + 1 :]:
                    yield x, y
        return
    cut_at = a + core // 2
    for first in (True, False):  # the first half of the core is whole, or the second one is
        groups: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
        for x in xs:
            groups[x[a:cut_at] if first else x[cut_at : n - b]][0].append(x)
        for y in ys:
            key = y[a:cut_at] if first else y[len(y) - (n - cut_at) : len(y) - b]
            if key in groups:
                groups[key][1].append(y)
        for gx, gy in groups.values():
            if first:
                yield from near_pairs(gx, gy, cut_at, b, max(lo, cut_at), hi)
            else:
                yield from near_pairs(gx, gy, a, n - cut_at, lo, min(hi, cut_at))


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, best): number of near words, and of the most frequent one struct(-n, word). words: a written table."""
    tiles = tiled(cut(signatures(words)), "key", "word", tile, "size").select("tile", "word", "n", "own", "len", "second", "chunk", "lo", "hi")

    def verify(rows: list[tuple]) -> Iterator[tuple[str, int, int, str]]:
        groups: dict[tuple, tuple[list, list]] = defaultdict(lambda: ([], []))
        number = {}
        for _, word, n, own, length, second, chunk, lo, hi in rows:
            q = length // 2
            chars = word[len(word) - (length - q) :] if second else word[:q]
            number[word] = n
            # in a tile of two chunks only words of different ones are compared
            if own:
                groups[length, second, chars, chunk == hi][0].append(word)
            groups[length, second, chars, chunk == lo][1].append(word)
        found: dict[str, list] = {}
        for (length, second, chars, _), (xs, ys) in groups.items():
            q = length // 2
            a, b, low, high = (0, length - q, 0, q) if second else (q, 0, q, length + 1)
            for x, y in near_pairs(xs, ys, a, b, low, high):
                if len(x) == len(y) and x > y:
                    continue
                for w, other in ((x, y), (y, x)):
                    best = (-number[other], other)
                    f = found.get(w)
                    if f is None:
                        found[w] = [1, best]
                    else:
                        f[0] += 1
                        if best < f[1]:
                            f[1] = best
        for w, (count, (minus, other)) in found.items():
            yield w, count, minus, other

    def run(batches):
        names = ["tile", "word", "n", "own", "len", "second", "chunk", "lo", "hi"]
        held: list[tuple] = []
        done: list[tuple] = []

        def out():
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "found", "minus", "other"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if held and held[0][0] != row[0]:
                    done.extend(verify(held))
                    held = []
                    if len(done) > 50_000:
                        yield out()
                        done = []
                held.append(row)
        done.extend(verify(held))
        if done:
            yield out()

    met = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "word string, found long, minus long, other string")
    return met.groupBy("word").agg(F.sum("found").alias("n_near"), F.min(F.struct("minus", "other")).alias("best"))


def with_roots(formed: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: their forms followed to the last, by doubling. formed: (word, form)."""
    now = cut(formed.select("word", F.col("form").alias("root")))
    while True:
        beyond = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        counts = cut(now.groupBy("root").agg(F.count("*").alias("n")).join(beyond, "root"))
        if counts.isEmpty():
            return now
        step = join_hot(now, counts, ["root"], "left")
        now = cut(step.select("word", F.coalesce("further", "root").alias("root")))


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    pattern: str = RUN,
    shortest: int = SHORTEST,
    rarest: int = RAREST,
    ratio: int = RATIO,
    delete_every: int = 0,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of the texts; delete_every: misspells one run of so many, for tests."""

    def found() -> DataFrame:
        words = cut(count_words(docs, id_col, text_col, pattern, shortest, rarest, delete_every))
        near = words.join(near_words(words), "word", "left")
        has = -F.col("best.minus") >= ratio * F.col("n")
        every = cut(
            near.select(
                "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.minus")).alias("form_n"),
            )
        )
        roots = with_roots(every.filter("form is not null"))
        return every.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))

    return apart(docs.sparkSession, found)


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), delete_every=DELETE_EVERY)
