"""Operator 2, substring dedup by level-wise doubling.

A window is `window` consecutive words. Lengths are halved from the window down to a start length; a window can only
repeat if its parts repeat, so short windows are counted first and only repeated ones are extended, to twice the length
each time, until the full length is reached or none survives.

Level 1 need not count every short window: each full window stands for the smallest hash among the short windows within
it. Equal full windows choose the same one, so none is lost, and about one short window in fourteen is counted. Consecutive
full windows with the same choice are a run, and runs are what the levels pass on (as a number within the document). A
level extends a run's short window to the right for the full windows that hold such an extension, and to the left for the
others, which become a run of their own.

At full length whole runs are compared first. A run that occurs twice settles all its windows at once; only runs that
occur once send their windows one by one, together with one witness of each repeated run.

Texts are written once, bucketed by row, so that every level joins its survivors to the texts without moving them. What a
level finds is written once too, counted with partial sums, and joined to the repeated hashes by join_hot: the few hashes
that stand for over a thousandth of the rows go by broadcast, so a passage that a third of all documents share is no large
group in any task. Keys at full length have 96 bits. All intermediate tables are deleted at the end.

Defined cases: null text is no words (nothing removed, digest of the empty string); documents shorter than the window
keep all; repeated rows are different documents, so they remove each other's windows; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.common import apart, cut, delete, join_hot, shared_dir, slices, table, uncollected

WINDOW = 35
#: Windows of fewer words are not worth a level.
START = 9


def lengths(window: int, start: int) -> list[int]:
    """The window's length halved (upwards) down to at least `start`, ascending."""
    out = [window]
    while (out[0] + 1) // 2 >= start and out[0] > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15 ^ salt) + (b ^ (b >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_hashes(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hashes of all windows of so many words, each from two windows of half its length."""
    if size == 1:
        return h
    half = (size + 1) // 2
    x = window_hashes(h, half, salt)
    n = max(0, len(h) - size + 1)
    return _mix(x[:n], x[size - half : size - half + n], salt)


#: A run in one number: its first full window, how many there are, and its short window's distance from the first.
_COUNT, _OFFSET = 1 << 24, 1 << 12


def run_code(first: np.ndarray, count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return first * _COUNT + count * _OFFSET + offset


def run_parts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return code // _COUNT, code % _COUNT // _OFFSET, code % _OFFSET


def window_starts(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, one after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Document:
    """A text's words and their hashes."""

    def __init__(self, text: str | None, window: int, start: int):
        self.words = (text or "").encode("utf-8", "replace").split()  # bytes: the six ASCII blanks only
        self.window, self.levels = window, lengths(window, start)
        if window >= _OFFSET // 2:
            raise ValueError(f"windows of {window} words are too long")

    @functools.cached_property
    def h(self) -> np.ndarray:
        digest = xxhash.xxh64_digest
        return np.frombuffer(b"".join([digest(w) for w in self.words]), np.uint64)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the runs and the hashes of their short windows."""
        n = len(self.words) - self.window + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        short = window_hashes(self.h, self.levels[0])
        at = np.arange(n) + leftmost_minima(short, self.window - self.levels[0] + 1)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.concatenate([first, [n]]))
        return run_code(first, count, at[first] - first), short[at[first]]

    def extended(self, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(code, hash) of the parts of the runs and of the windows of that length that begin or end with the short one."""
        first, count, offset = run_parts(codes)
        x, seed, last = window_hashes(self.h, size), first + offset, first + count
        turn = np.clip(seed - (self.window - size), first, last)  # full windows from here on reach far enough to the right
        left, right = turn > first, turn < last
        codes = [run_code(first, turn - first, offset)[left], run_code(turn, last - turn, seed - turn)[right]]
        return np.concatenate(codes), np.concatenate([x[seed[left] + self.levels[0] - size], x[seed[right]]])

    def full(self) -> tuple[np.ndarray, np.ndarray]:
        return window_hashes(self.h, self.window), window_hashes(self.h, self.window, 0x51ED270B)

    def run_hashes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all words that the run's windows cover: its first and last window (they overlap) and its length."""
        first, count, _ = run_parts(codes)
        h, g = self.full()
        n = count.astype(np.uint64)
        return _mix(h[first], h[first + count - 1], 1) + n, _mix(g[first], g[first + count - 1], 2) + n

    def removed(self, codes: np.ndarray) -> np.ndarray:
        """Which words the windows of these runs cover."""
        first, count, _ = run_parts(codes)
        cover = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, first + count + self.window - 1, -1)
        return np.cumsum(cover[:-1]) > 0


def leftmost_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum within each `width` consecutive values, by doubling the width."""
    n, place, have = len(x) - width + 1, np.zeros(len(x), np.int64), 1
    low = x
    while have < width:
        step = min(have, width - have)
        m = len(low) - step
        later = low[step:] < low[:m]
        place = np.where(later, place[step:] + step, place[:m])
        low = np.where(later, low[step:], low[:m])
        have += step
    return place[:n]


def _texts(batches, columns: list[str]):
    with uncollected():
        for batch in batches:
            for part in slices(batch, "text"):
                yield from zip(*(part.column(c).to_pylist() for c in columns))


def _emit(rows_of, schema: pa.Schema, at_once: int = 100_000):
    """Batches of the columns (lists of arrays) that rows_of yields."""
    held, n = [], 0
    for columns in rows_of:
        held.append(columns)
        n += len(columns[0])
        if n >= at_once:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _schema(**types) -> pa.Schema:
    return pa.schema(list(types.items()))


_LONG, _INT = pa.int64(), pa.int32()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _low32(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.uint32).view(np.int32)


class Dedup:
    """The steps over one written table of texts."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, window: int, start: int):
        self.window, self.start, self.levels = window, start, lengths(window, start)
        spark = docs.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"wayfare_texts_{uuid.uuid4().hex}"
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("rid"))
        writer = rows.repartition(n, "rid").write.option("path", f"{shared_dir(spark)}/{self.name}").option("compression", "zstd")
        writer.bucketBy(n, "rid").saveAsTable(self.name)
        self.texts = spark.table(self.name)

    def runs_of_all(self) -> DataFrame:
        """(h, rid, r): the short window of every run, and the run's code."""
        window, start = self.window, self.start

        def rows(batches):
            for rid, text in _texts(batches, ["rid", "text"]):
                codes, seeds = Document(text, window, start).runs()
                yield _signed(seeds), np.full(len(seeds), rid), codes

        schema = _schema(h=_LONG, rid=_LONG, r=_LONG)
        return self.texts.select("rid", "text").mapInArrow(lambda it: _emit(rows(it), schema), "h long, rid long, r long")

    def with_runs(self, runs: DataFrame, rows_of, schema: pa.Schema, ddl: str) -> DataFrame:
        """rows_of(rid, document, its listed codes) over the texts that have some; the texts stay where they are."""
        window, start = self.window, self.start
        listed = runs.groupBy("rid").agg(F.collect_set("r").alias("rs"))
        joined = self.texts.join(listed, "rid").select("rid", "text", "rs")

        def rows(batches):
            for rid, text, rs in _texts(batches, ["rid", "text", "rs"]):
                yield from rows_of(rid, Document(text, window, start), np.sort(np.array(rs, np.int64)))

        return joined.mapInArrow(lambda it: _emit(rows(it), schema), ddl)

    def survivors(self) -> DataFrame:
        """(rid, r): runs whose short window repeats, and so does its extension at each further level."""
        found = cut(self.runs_of_all())
        for size in self.levels[1:]:
            again = found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
            runs = cut(join_hot(found, again, ["h"], "left_semi").select("rid", "r"))
            if size == self.window or runs.isEmpty():
                return runs

            def extend(rid, doc, rs, size=size):
                r, h = doc.extended(rs, size)
                yield _signed(h), np.full(len(r), rid), r

            found = cut(self.with_runs(runs, extend, _schema(h=_LONG, rid=_LONG, r=_LONG), "h long, rid long, r long"))
        return found.select("rid", "r")

    def repeated(self, runs: DataFrame) -> DataFrame:
        """(rid, r): codes of the runs, or of the single windows, that go."""

        def whole(rid, doc, rs):
            h, g = doc.run_hashes(rs)
            yield _signed(h), _low32(g), np.full(len(rs), rid), rs

        hashed = cut(self.with_runs(runs, whole, _schema(h=_LONG, g=_INT, rid=_LONG, r=_LONG), "h long, g int, rid long, r long"))
        twice = hashed.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("rid", "r")).alias("least")).filter("n > 1")
        # 0: the run is alone; 1: the first of its kind, the witness of the others; 2: another copy
        state = join_hot(hashed, twice, ["h", "g"], "left").select(
            "rid", "r", F.when(F.col("least").isNull(), 0).when(F.col("least") == F.struct("rid", "r"), 1).otherwise(2).alias("is")
        )
        state = cut(state)

        def single(rid, doc, codes):
            h, g = doc.full()
            witness = codes < 0
            first, count, _ = run_parts(np.where(witness, -1 - codes, codes))
            s, known = window_starts(first, count), np.repeat(witness, count)
            yield _signed(h[s]), _low32(g[s]), np.where(known, -1, rid), np.where(known, -1, s)

        coded = state.filter("is < 2").select("rid", F.when(F.col("is") == 1, -1 - F.col("r")).otherwise(F.col("r")).alias("r"))
        windows = cut(self.with_runs(coded, single, _schema(h=_LONG, g=_INT, rid=_LONG, s=_INT), "h long, g int, rid long, s int"))
        of_hash = windows.groupBy("h", "g").agg(F.count("*").alias("n"), F.count_if(F.col("s") >= 0).alias("open"))
        of_hash = of_hash.filter("open > 1 or (open > 0 and n > open)").select("h", "g", "n")
        some = join_hot(windows.filter("s >= 0"), of_hash, ["h", "g"], "left_semi")
        single_code = F.col("s").cast("long") * _COUNT + _OFFSET
        return cut(some.select("rid", single_code.alias("r")).unionByName(state.filter("is > 0").select("rid", "r")))

    def kept(self, gone: DataFrame, id_col: str, with_text: bool = False) -> DataFrame:
        """One row for each text: counts and digest of what is kept, or also the kept text."""
        window, start = self.window, self.start
        listed = gone.groupBy("rid").agg(F.collect_set("r").alias("rs"))
        joined = self.texts.join(listed, "rid", "left").select("id", "text", "rs")
        kind = dict(joined.dtypes)["id"]

        def run(batches):
            for batch in batches:
                for part in slices(batch, "text"):
                    n, less, sha, texts = [], [], [], []
                    for text, rs in zip(part.column("text").to_pylist(), part.column("rs").to_pylist()):
                        doc = Document(text, window, start)
                        mask = doc.removed(np.array(rs or [], np.int64))
                        total, removed = len(doc.words), int(mask.sum())
                        left = b" ".join(w for w, out in zip(doc.words, mask.tolist()) if not out) if removed else b" ".join(doc.words)
                        n.append(total)
                        less.append(removed)
                        sha.append(hashlib.sha256(left).hexdigest())
                        texts.append((left.decode("utf-8", "replace") if removed else text) if with_text else None)
                    columns = [part.column("id"), pa.array(n, _LONG), pa.array(less, _LONG), pa.array(sha, pa.string())]
                    names = [id_col, "n_words", "n_removed", "kept_sha256"]
                    if with_text:
                        columns.append(pa.array(texts, pa.string()))
                        names.append("kept_text")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        ddl = f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
        return joined.mapInArrow(run, ddl)

    def close(self) -> None:
        spark = self.texts.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(spark, f"{shared_dir(spark)}/{self.name}")


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, start: int = START, with_text: bool = False
) -> DataFrame:
    """One row for each document: n_words, n_removed, kept_sha256 (and kept_text)."""
    steps = Dedup(docs, id_col, text_col, window, start)
    try:
        return apart(docs.sparkSession, lambda: steps.kept(steps.repeated(steps.survivors()), id_col, with_text))
    finally:
        steps.close()


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
