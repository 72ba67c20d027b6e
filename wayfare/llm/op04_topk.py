"""Operator 4, exact top-k search by distributed histogram selection.

Vectors become integer components, so scores are integers with a known bound. Candidates are dealt to large blocks by the
hash of their row, queries to small ones, and a task holds one candidate block while the query blocks pass by: each tile is
one matrix product. A pass scores all tiles and makes, for each query, a histogram of the scores in its current interval;
the bin that holds the k-th score is the next interval. When intervals are single values each k-th score is known; a last
pass keeps scores not below it (per tile the k best at most, which loses none of the k best overall) and ranks them with ties
to the smaller id.

Components are held in the smallest integer type that fits and become floats a part at a time, so a block is large in rows and
there are few blocks for the queries to visit. Of the two sides the smaller one moves: in each pass a candidate goes once to
its block, and a query once to every candidate block. Only scalars (counts, the largest norm, component and length) reach the
driver. A histogram is passed on as soon as its
tile is done, and sums are made of one query block after another, so no task's memory grows with the table.

Defined cases: vectors that are null, empty or have null or non-finite components take no part; shorter vectors are
padded with zeros; every row counts: rows that repeat an id are candidates and queries of their own, and a row is not its own
candidate; a row with a null id is a candidate, after all others at equal score, and no query; fewer than k candidates give
all of them; components beyond 2^62 count as that, and scores beyond the range of a long as its ends; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfare.llm.common import apart, cut, table

SCALE, K, QUERY_EVERY = 64, 20, 20
#: Bytes of a candidate block; components of a row of it or a query block; rows scored at once; bins of a histogram.
HELD, PART, AT_ONCE, BINS = 1 << 26, 1 << 15, 1024, 128
#: Scores under these bounds are exact in single and double precision, so BLAS may make them.
EXACT = {"f4": 2.0**23, "f8": 2.0**52}


def integers(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(row, id, v): components floor(scale * x) as little-endian 64-bit integers, of the vectors that take part."""
    src = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x"))
    x = F.col("x")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    src = src.filter(x.isNotNull() & (F.size(x) > 0) & whole)

    def run(batches):
        for batch in batches:
            lists = batch.column("x")
            flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
            flat = np.clip(flat, -(2.0**62), 2.0**62).astype("<i8")
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            rows = [flat[a:b].tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(rows, pa.binary())], names=["row", "id", "v"])

    return src.select("row", "id", x.cast("array<double>").alias("x")).mapInArrow(run, "row long, id long, v binary")


#: A block: rows, ids (0 for null), which ids are null, and the matrix, as bytes.
BLOCK = "rows binary, ids binary, nulls binary, m binary"


def blocks(vectors: DataFrame, dim: int, name: str, kind: str) -> DataFrame:
    """(name, rows, ids, nulls, m): some vectors of a partition as a matrix of `kind`; of one value of `name` if vectors have it."""
    size, dealt = max(1, PART // dim), name in vectors.columns

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        key, held = None, []

        def packed():
            row, ids, vs = zip(*held)
            m = np.zeros((len(held), dim), kind)
            for i, v in enumerate(vs):
                m[i, : len(v) // 8] = np.frombuffer(v, "<i8")
            null = np.array([x is None for x in ids])
            bytes_of = (np.array(row, "<i8"), np.array([x or 0 for x in ids], "<i8"), null, m)
            number = key if dealt else (part << 32) + made
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in bytes_of)], names=[name, "rows", "ids", "nulls", "m"]
            )

        for batch in batches:
            keys = batch.column(name).to_pylist() if dealt else [None] * batch.num_rows
            for k, *row in zip(keys, *(batch.column(c).to_pylist() for c in ("row", "id", "v"))):
                if held and (k != key or len(held) == size):
                    yield packed()
                    made, held = made + 1, []
                key = k
                held.append(row)
        if held:
            yield packed()

    return vectors.mapInArrow(run, f"{name} long, {BLOCK}")


class _Block:
    def __init__(self, parts: list[tuple], kind: str):
        self.rows, self.ids = (np.frombuffer(b"".join(p[i] for p in parts), "<i8") for i in (0, 1))
        self.nulls = np.frombuffer(b"".join(p[2] for p in parts), bool)
        self.m = np.frombuffer(b"".join(p[3] for p in parts), kind).reshape(len(self.rows), -1)


def _tiles(batches, kind: str):
    """(query block's number, query block, lo, above, candidate block) of each tile; a candidate block's rows come first."""
    held, number, block = [], None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("c", "q", "rows", "ids", "nulls", "m", "lo", "above")]
        for c, q, rows, ids, nulls, m, lo, above in zip(*columns):
            if c != number:
                number, held, block = c, [], None
            if q is None:
                held.append((rows, ids, nulls, m))
                continue
            if held:
                block, held = _Block(held, kind), []
            if block:
                yield q, _Block([(rows, ids, nulls, m)], kind), np.frombuffer(lo, "<i8"), np.frombuffer(above, "<i8"), block


def _scores(query: _Block, block: _Block, number: str):
    """(first candidate, scores, (query, candidate) places of rows that meet themselves) for parts of a block."""
    order = np.argsort(query.rows)
    m = query.m.astype(number)
    for a in range(0, len(block.rows), AT_ONCE):
        rows = block.rows[a : a + AT_ONCE]
        s = m @ block.m[a : a + AT_ONCE].astype(number).T
        s = (np.clip(s, -(2**63), 2**63 - 1) if number == "O" else s).astype(np.int64)
        at = np.minimum(np.searchsorted(query.rows, rows, sorter=order), len(order) - 1)
        own = np.flatnonzero(query.rows[order[at]] == rows)
        yield a, s, (order[at[own]], own)


def _meeting(queries: DataFrame, candidates: DataFrame, n_blocks: int) -> DataFrame:
    """Every query block behind the rows of every candidate block; partitions hold whole candidate blocks."""
    none = F.lit(None)
    held = candidates.select("c", none.cast("long").alias("q"), "rows", "ids", "nulls", "m", none.cast("binary").alias("lo"), none.cast("binary").alias("above"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("c")
    passing = queries.select(every, "q", "rows", "ids", "nulls", "m", "lo", "above")
    return held.unionByName(passing).repartition(n_blocks, "c").sortWithinPartitions("c", F.col("q").asc_nulls_first())


def _narrowed(queries: DataFrame, candidates: DataFrame, n_blocks: int, width: int, k: int, kind: str, number: str) -> tuple[DataFrame, int]:
    """One pass: each query's interval [lo, lo + width) shrinks to the bin with its k-th score."""
    step = -(-width // BINS)

    def count(batches):
        for q, query, lo, _, block in _tiles(batches, kind):
            sums = np.zeros(len(lo) * BINS, np.int64)
            for _, s, (qi, ci) in _scores(query, block, number):
                bins = (s - lo[:, None]) // step
                inside = (bins >= 0) & (s - lo[:, None] < width)
                inside[qi, ci] = False
                sums += np.bincount((bins + BINS * np.arange(len(lo))[:, None])[inside], minlength=len(sums))
            yield pa.RecordBatch.from_arrays([pa.array([q], pa.int64()), pa.array([sums.astype("<i4").tobytes()], pa.binary())], names=["q", "n"])

    def add(batches):
        def row():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["q", "n"])

        key, total = None, None
        for batch in batches:
            for q, n in zip(batch.column("q").to_pylist(), batch.column("n").to_pylist()):
                n = np.frombuffer(n, "<i4").astype(np.int64)
                if q == key:
                    total += n
                    continue
                if key is not None:
                    yield row()
                key, total = q, n
        if key is not None:
            yield row()

    def choose(batches):
        for batch in batches:
            los, aboves = [], []
            for n, lo, above in zip(*(batch.column(c).to_pylist() for c in ("n", "lo", "above"))):
                lo, above = np.frombuffer(lo, "<i8"), np.frombuffer(above, "<i8")
                n = np.frombuffer(n, "<i8").reshape(len(lo), BINS)
                down = above[:, None] + np.cumsum(n[:, ::-1], axis=1)[:, ::-1]  # scores in this bin or higher
                b = np.maximum((down >= k).sum(axis=1) - 1, 0)  # the highest bin that reaches k; the lowest if none does
                each = np.arange(len(lo))
                los.append((lo + b * step).astype("<i8").tobytes())
                aboves.append((down[each, b] - n[each, b]).astype("<i8").tobytes())
            names = ["q", "rows", "ids", "nulls", "m"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(los, pa.binary()), pa.array(aboves, pa.binary())], names=[*names, "lo", "above"])

    counted = _meeting(queries, candidates, n_blocks).mapInArrow(count, "q long, n binary")
    sums = counted.repartition("q").sortWithinPartitions("q").mapInArrow(add, "q long, n binary")
    return cut(queries.join(sums, "q").mapInArrow(choose, f"q long, {BLOCK}, lo binary, above binary")), step


def top_k(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = QUERY_EVERY, scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row whose id is divisible by `every`."""
    return apart(vectors.sparkSession, lambda: _top_k(vectors, id_col, vec_col, k, every, scale))


def _top_k(vectors: DataFrame, id_col: str, vec_col: str, k: int, every: int, scale: int) -> DataFrame:
    spark = vectors.sparkSession
    ints = cut(integers(vectors, id_col, vec_col, scale))

    def norms(batches):
        for batch in batches:
            rows = [np.frombuffer(r, "<i8").astype(np.float64) for r in batch.column("v").to_pylist()]
            made = [pa.array([float(np.sqrt(r @ r)) for r in rows], pa.float64()), pa.array([float(np.abs(r).max()) for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays([*made, pa.array([len(r) for r in rows], pa.int64())], names=["norm", "most", "dim"])

    is_query = F.col("id") % every == 0
    n, n_queries = ints.agg(F.count("*"), F.count_if(is_query)).first()
    norm, most, dim = ints.mapInArrow(norms, "norm double, most double, dim long").agg(F.max("norm"), F.max("most"), F.max("dim")).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not n or not n_queries:
        return spark.createDataFrame([], out)
    bound = norm * norm + 1
    number = next((name for name, exact in EXACT.items() if bound < exact), "O")
    bytes_each = next((b for b in (1, 2, 4) if most < 2 ** (8 * b - 1)), 8)
    kind = f"<i{bytes_each}"
    limit = int(min(bound, 2.0**62))
    n_blocks = max(spark.sparkContext.defaultParallelism, -(-n * dim * bytes_each // HELD))
    dealt = ints.withColumn("c", F.pmod(F.xxhash64("row"), F.lit(n_blocks).cast("long")))
    candidates = cut(blocks(dealt.repartition(n_blocks, "c").sortWithinPartitions("c"), dim, "c", kind))
    queries = blocks(ints.filter(is_query), dim, "q", kind)

    def start(batches):
        for batch in batches:
            sizes = [len(x) // 8 for x in batch.column("ids").to_pylist()]
            lo = [np.full(s, -limit, "<i8").tobytes() for s in sizes]
            above = [np.zeros(s, "<i8").tobytes() for s in sizes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lo, pa.binary()), pa.array(above, pa.binary())], names=[*batch.schema.names, "lo", "above"])

    queries = cut(queries.mapInArrow(start, f"q long, {BLOCK}, lo binary, above binary"))
    width = 2 * limit + 1
    while width > 1:
        queries, width = _narrowed(queries, candidates, n_blocks, width, k, kind, number)

    def keep(batches):
        for _, query, lo, _, block in _tiles(batches, kind):
            for a, s, (qi, ci) in _scores(query, block, number):
                inside = s >= lo[:, None]
                inside[qi, ci] = False
                qs, cs = np.nonzero(inside)
                score, cs = s[qs, cs], cs + a
                order = np.lexsort((block.rows[cs], block.ids[cs], block.nulls[cs], -score, qs))
                qs, cs, score = qs[order], cs[order], score[order]
                best = np.arange(len(qs)) - np.searchsorted(qs, qs) < k  # qs is sorted: place within the query
                qs, cs, score = qs[best], cs[best], score[best]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query.rows[qs]), pa.array(query.ids[qs]), pa.array(block.rows[cs]), pa.array(block.ids[cs], mask=block.nulls[cs]), pa.array(score)],
                    names=["q", "query_id", "row", "vec_id", "score"],
                )

    kept = _meeting(queries, candidates, n_blocks).mapInArrow(keep, "q long, query_id long, row long, vec_id long, score long")
    by = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    ranked = kept.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
