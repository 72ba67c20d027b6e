"""Operator 13, hard-negative mining by slot-decomposed selection.

An anchor's positives are the best rows of its own label. Their scores are the upper limits of its windows; the windows
overlap, but the limits, in descending order, cut the scores into disjoint slots, and a window is what its slot and the lower
ones hold. So a row of another label falls into one slot, a combiner keeps the k best of each slot, combiners add up, and
merging the slots from the lowest upwards gives for each limit the k best rows at or under it: the answers of all windows from
one pass, after their lower limits. Rows under the lower limit of their slot's own positive are in no window and go at once.

Vectors become integer components, held in the smallest integer type that fits. Rows are dealt to large blocks by the
hash of their row, a label with enough rows to blocks of its own; anchors are in small blocks of one label each. A task holds
one block while anchor blocks pass by, and keeps the best rows of an anchor block in arrays: in the first pass of its
label, where anchors visit only the blocks that hold it; in the second of all others, where they visit all blocks but
those of their own label. A tile passes on its combiner once. Only scalars and the counts of labels that fill half a block (so
as many as blocks at most) reach the driver. Memory: a block, part of it as doubles, and one anchor block's arrays.

Defined cases: rows with a null label or a vector that is null, empty or has null or non-finite components take no part; shorter
vectors are padded with zeros; every row counts: rows that repeat an id are rows of their own, in the order of their scores,
ids and rows; a row with a null id comes after all others at equal score and is no anchor; anchors without positives have no
windows, and negative positive scores give empty ones; components beyond 2^62 count as that, and scores beyond 2^56 too; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.common import apart, cut, join_hot, table

SCALE, POSITIVES, NEGATIVES, ANCHOR_EVERY, LOW = 256, 5, 5, 100, 80
#: Components of a block, of one of its rows, and of an anchor block; rows scored at once.
HELD, PART, ANCHORS, AT_ONCE = 1 << 25, 1 << 17, 1 << 16, 1024
#: Scores under this bound are exact in double precision, so BLAS may make them; none counts as more than MOST.
EXACT, MOST = 2.0**52, 1 << 56
_NO_ID, _NONE = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_STATE = "anchor_block long, state binary"


def integers(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(row, id, label, v, dim, most, norm): components floor(scale * x) as little-endian 64-bit integers; rows that take part."""
    x = F.col("x")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    src = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("x")
    ).filter(x.isNotNull() & (F.size(x) > 0) & whole & F.col("label").isNotNull())

    def run(batches):
        for batch in batches:
            flat = np.floor(scale * batch.column("x").flatten().to_numpy(zero_copy_only=False))
            flat = np.clip(flat, -(2.0**62), 2.0**62)
            at = np.concatenate([[0], np.cumsum(batch.column("x").value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            rows = [flat[a:b] for a, b in zip(at, at[1:])]
            made = [
                pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary()), pa.array([len(r) for r in rows], pa.int64()),
                pa.array([float(np.abs(r).max()) for r in rows], pa.float64()), pa.array([float(np.sqrt(r @ r)) for r in rows], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "label")), *made], names=["row", "id", "label", "v", "dim", "most", "norm"])

    return src.mapInArrow(run, "row long, id long, label string, v binary, dim long, most double, norm double")


def _packed(vectors: DataFrame, by: str, dim: int, size: int, kind: str, alone: bool = False) -> DataFrame:
    """(by, label, rows, ids, labels, m): up to `size` rows of one value of `by`, sorted by it, as arrays.

    label: the first row's; alone: rows of another label start anew.
    """

    def run(batches):
        key, held = None, []

        def out():
            row, ids, labels, vs = zip(*held)
            m = np.zeros((len(held), dim), kind)
            for i, v in enumerate(vs):
                m[i, : len(v) // 8] = np.frombuffer(v, "<i8")
            number = np.array([~r if i is None else r for r, i in zip(row, ids)], "<i8")  # of rows without an id, the complement
            ids = np.array([_NO_ID if i is None else i for i in ids], "<i8")
            columns = [pa.array([key], pa.int64()), pa.array(labels[:1], pa.string()), *(pa.array([x], pa.binary()) for x in (number.tobytes(), ids.tobytes())), pa.array([labels], pa.list_(pa.string())), pa.array([m.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=[by, "label", "rows", "ids", "labels", "m"])

        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in (by, "row", "id", "label", "v"))):
                if held and (k != key or len(held) == size or (alone and row[2] != held[0][2])):
                    yield out()
                    held = []
                key = k
                held.append(row)
        if held:
            yield out()

    return vectors.mapInArrow(run, f"{by} long, label string, rows binary, ids binary, labels array<string>, m binary")


class Best:
    """The k best (score, id, row) of each slot of each anchor: higher scores, smaller ids, rows with ids, smaller rows first."""

    def __init__(self, slots: int, k: int, state: bytes | None = None):
        self.k, self.slots = k, slots
        raw = np.frombuffer(state, "<i8").reshape(3, slots * k) if state else np.array([[_NONE], [_NO_ID], [0]]).repeat(slots * k, axis=1)
        self.score, self.id, self.row = (x.copy() for x in raw)

    def floor(self) -> np.ndarray:
        """Scores under this of a slot have no place."""
        return self.score.reshape(self.slots, self.k)[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        filled = self.score != _NONE
        at = np.concatenate([np.arange(self.slots).repeat(self.k)[filled], slot])
        score, ids, row = (np.concatenate([a[filled], b]) for a, b in ((self.score, score), (self.id, ids), (self.row, row)))
        order = np.lexsort((np.where(row < 0, ~row, row), row < 0, ids, -score, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.k
        order, to = order[keep], at[keep] * self.k + place[keep]
        self.score[:], self.id[:], self.row[:] = _NONE, _NO_ID, 0
        self.score[to], self.id[to], self.row[to] = score[order], ids[order], row[order]

    def bytes(self) -> bytes:
        return np.concatenate([self.score, self.id, self.row]).astype("<i8").tobytes()


def _meeting(blocks: DataFrame, visits: DataFrame, n_blocks: int) -> DataFrame:
    """Anchor blocks behind the rows of the blocks that they visit; partitions hold whole blocks. visits: anchors with c."""
    none = F.lit(None)
    columns = ("rows", "ids", "label", "labels", "m")
    held = blocks.select("c", none.cast("long").alias("anchor_block"), *columns, none.cast("binary").alias("state"))
    passing = visits.select("c", "anchor_block", *columns, "state")
    return held.unionByName(passing).repartition(n_blocks, "c").sortWithinPartitions("c", F.col("anchor_block").asc_nulls_first())


def _scored(batches, dim: int, kind: str, fast: bool, start: Callable, take: Callable):
    """Of each anchor block that meets a block: start(anchors, state), then take(...) for each part of scores."""
    as_number = (lambda m: m.astype(np.float64)) if fast else (lambda m: m.astype(object))
    held, number = [], None
    for batch in batches:
        for c, q, rows, ids, label, labels, m, state in zip(*(batch.column(x).to_pylist() for x in ("c", "anchor_block", "rows", "ids", "label", "labels", "m", "state"))):
            if c != number:
                number, held = c, []
            rows, ids, m = np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(m, kind).reshape(-1, dim)
            if q is None:
                held.append((rows, ids, np.array(labels, object), m))
                continue
            anchors, own = as_number(m), start(rows, state)
            for of_rows, of_ids, of_labels, of_m in held:
                for a in range(0, len(of_rows), AT_ONCE):
                    part = slice(a, a + AT_ONCE)
                    s = anchors @ as_number(of_m[part]).T
                    s = s.astype(np.int64) if fast else np.clip(s, -MOST, MOST).astype(np.int64)
                    take(own, rows, s, of_labels[part] == label, of_rows[part], of_ids[part])
            yield pa.RecordBatch.from_arrays([pa.array([q], pa.int64()), pa.array([own.bytes()], pa.binary())], names=["anchor_block", "state"])


def _added(tiles: DataFrame, k: int) -> DataFrame:
    """One combiner for each anchor block."""

    def add(batches):
        key, best = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([best.bytes()], pa.binary())], names=["anchor_block", "state"])

        for batch in batches:
            for q, state in zip(batch.column("anchor_block").to_pylist(), batch.column("state").to_pylist()):
                if q != key:
                    if key is not None:
                        yield out()
                    key, best = q, Best(len(state) // (24 * k), k, state)
                    continue
                more = Best(best.slots, k, state)
                some = more.score != _NONE
                best.add(np.arange(best.slots).repeat(k)[some], more.score[some], more.id[some], more.row[some])
        if key is not None:
            yield out()

    return tiles.repartition("anchor_block").sortWithinPartitions("anchor_block").mapInArrow(add, _STATE)


def _limits(state: bytes, anchors: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors x k) scores of positives in descending order, _NONE where there are fewer, their ids and rows."""
    best = Best(anchors, k, state)
    return best.score.reshape(-1, k), best.id.reshape(-1, k), best.row.reshape(-1, k)


class _Slots(Best):
    """A combiner of anchors x positives slots that knows its limits."""

    def __init__(self, state: bytes, anchors: int, positives: int, negatives: int, low: int):
        super().__init__(anchors * positives, negatives)
        self.upper = _limits(state, anchors, positives)[0]
        there = self.upper != _NONE
        self.width, self.there = positives, there.any(axis=1)
        lowest = np.where(there, self.upper, MOST).min(axis=1)
        self.top, self.bottom = np.where(self.there, self.upper[:, 0], _NONE), -(-low * lowest // 100)
        self.lower = np.where(there, -(-low * np.where(there, self.upper, 0) // 100), MOST)


def hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    every: int = ANCHOR_EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor and each of its positives.

    Anchors: rows whose id is divisible by `every`. A negative's score is at most the positive's and at least low / 100 of it.
    """
    return apart(vectors.sparkSession, lambda: _hard_negatives(vectors, id_col, vec_col, label_col, every, positives, negatives, low, scale))


def _hard_negatives(vectors, id_col, vec_col, label_col, every, positives, negatives, low, scale) -> DataFrame:
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    ints = cut(integers(vectors, id_col, vec_col, label_col, scale))
    is_anchor = F.col("id") % every == 0
    n, n_anchors, dim, most, norm = ints.agg(F.count("*"), F.count_if(is_anchor), F.max("dim"), F.max("most"), F.max("norm")).first()
    if not n or not n_anchors:
        return spark.createDataFrame([], out)
    fast = norm * norm + 1 < EXACT
    kind = next((f"<i{b}" for b in (1, 2, 4) if most < 2 ** (8 * b - 1)), "<i8")

    # blocks of their own for labels with many rows, the others share blocks by their label's hash
    n_blocks = max(spark.sparkContext.defaultParallelism, -(-n * dim // HELD))
    room = -(-n // n_blocks)
    large = [(r.label, r.n) for r in ints.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") * 2 > room).collect()]
    first, starts = 0, []
    for label, rows in sorted(large):
        starts.append((label, first, -(-rows // room)))
        first += starts[-1][2]
    shared = max(1, -(-(n - sum(x for _, x in large)) // room))
    total = first + shared
    own = F.broadcast(spark.createDataFrame(starts, "label string, first long, blocks long"))  # at most 2 * n_blocks rows
    placed = ints.join(own, "label", "left")
    of_label = F.lit(first) + F.pmod(F.xxhash64("label"), F.lit(shared).cast("long"))
    c = F.when(F.col("first").isNull(), of_label).otherwise(F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks"))).cast("long")
    dealt = placed.select("row", "id", "label", "v", c.alias("c")).repartition(total, "c").sortWithinPartitions("c")
    blocks = cut(_packed(dealt, "c", dim, max(1, PART // dim), kind))

    # anchor blocks: of one label, by hash where it has many anchors
    size = max(1, ANCHORS // dim)
    anchors = ints.filter(is_anchor)
    counts = anchors.groupBy("label").agg(F.count("*").alias("n")).withColumn("pieces", F.ceil(F.col("n") / size))
    anchors = join_hot(anchors, counts, ["label"]).withColumn("g", F.xxhash64("label", F.pmod(F.xxhash64("row"), F.col("pieces"))))
    anchors = anchors.select("row", "id", "label", "v", "g").repartition("g").sortWithinPartitions("g", "label")
    packed = _packed(anchors, "g", dim, size, kind, alone=True).withColumn("anchor_block", F.monotonically_increasing_id())
    anchor_blocks = cut(packed.drop("g").withColumn("state", F.lit(None).cast("binary")))
    reach = anchor_blocks.join(own, "label", "left")
    home = F.when(F.col("first").isNull(), F.array(of_label)).otherwise(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1))

    def start_positive(rows, state):
        return Best(len(rows), positives)

    def take_positive(best, rows, s, same, of_rows, of_ids):
        inside = same[None, :] & (s >= best.floor()[:, None]) & (rows[:, None] != of_rows[None, :])
        a, b = np.nonzero(inside)
        if len(a):
            best.add(a, s[a, b], of_ids[b], of_rows[b])

    def first_pass(batches):
        return _scored(batches, dim, kind, fast, start_positive, take_positive)

    found = _added(_meeting(blocks, reach.withColumn("c", F.explode(home)), total).mapInArrow(first_pass, _STATE), positives)
    limited = cut(anchor_blocks.drop("state").join(found, "anchor_block"))

    def start_slots(rows, state):
        return _Slots(state, len(rows), positives, negatives, low)

    def take_negative(best, rows, s, same, of_rows, of_ids):
        inside = ~same[None, :] & (s <= best.top[:, None]) & (s >= best.bottom[:, None]) & best.there[:, None]
        a, b = np.nonzero(inside)
        if not len(a):
            return
        score = s[a, b]
        j = (score[:, None] <= best.upper[a]).sum(axis=1) - 1  # the lowest limit that is not under the score
        slot = a * best.width + j
        keep = (score >= best.floor()[slot]) & (score >= best.lower[a, j])
        if keep.any():
            best.add(slot[keep], score[keep], of_ids[b[keep]], of_rows[b[keep]])

    def second_pass(batches):
        return _scored(batches, dim, kind, fast, start_slots, take_negative)

    everywhere = F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long"))
    others = F.filter(everywhere, lambda x: F.col("first").isNull() | (x < F.col("first")) | (x >= F.col("first") + F.col("blocks")))
    visits = limited.join(own, "label", "left").withColumn("c", F.explode(others))
    slots = _added(_meeting(blocks, visits, total).mapInArrow(second_pass, _STATE), negatives)

    def answer(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for ids, state, kept in zip(*(batch.column(c).to_pylist() for c in ("ids", "positive", "state"))):
                ids = np.frombuffer(ids, "<i8")
                upper, of, of_row = _limits(state, len(ids), positives)
                held = Best(len(ids) * positives, negatives, kept)
                score, neg, row = (x.reshape(len(ids), positives, negatives) for x in (held.score, held.id, held.row))
                below = Best(len(ids), negatives)  # merged from the lowest slot upwards
                for j in range(positives - 1, -1, -1):
                    a, b = np.nonzero(score[:, j] != _NONE)
                    below.add(a, score[a, j, b], neg[a, j, b], row[a, j, b])
                    s, n, r = (x.reshape(-1, negatives) for x in (below.score, below.id, below.row))
                    limit = upper[:, j : j + 1]
                    inside = (s != _NONE) & (limit != _NONE)
                    inside &= low * np.where(inside, limit, 0) <= 100 * np.where(inside, s, 0)
                    a, b = np.nonzero(inside)
                    for to, x in zip(columns, (ids[a], of[a, j], b + 1, n[a, b], upper[a, j], s[a, b], of_row[a, j] < 0, r[a, b] < 0)):
                        to.append(x)
            made = [np.concatenate(x) if x else np.zeros(0, bool if i > 5 else np.int64) for i, x in enumerate(columns)]
            null = {1: made[6], 3: made[7]}  # rows without an id
            arrays = [pa.array(x, pa.int32() if i == 2 else pa.int64(), mask=null.get(i)) for i, x in enumerate(made[:6])]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in out.split(", ")])

    return limited.select("anchor_block", "ids", F.col("state").alias("positive")).join(slots, "anchor_block").drop("anchor_block").mapInArrow(answer, out)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label))
