"""What the corpus operators share: reading tables, Arrow row mapping and cutting lineage."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch are handled in slices of about this many text bytes, so that memory follows neither
#: the batch size nor the document count.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="wayfare-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


class _Open(threading.local):
    """For each make() that apart() is running in this thread: the tables that cut() has written for it."""

    def __init__(self):
        self.made: list[list[str]] = []


_OPEN = _Open()


def apart(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, as a written table; the tables that were cut on the way are deleted."""
    _OPEN.made.append([])
    made = _OPEN.made[-1]
    try:
        try:
            df = make()
        finally:
            _OPEN.made.pop()
        return cut(df)
    finally:
        for path in made:
            delete(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: later steps neither recompute it nor depend on an executor."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    if _OPEN.made:
        _OPEN.made[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by cut() that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.rsplit("/", 1)[1].startswith("cut-"):
                delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], how: str = "inner", share: int = 1000) -> DataFrame:
    """rows joined to keyed (one row a key, with the number n of rows of that key), however skewed the rows are.

    Keys with over 1/share of all rows, so fewer than `share`, are joined by broadcast; no task of the shuffled join of the
    others gets more than that of one key. how: inner, left or left_semi; n is not passed on.
    """
    keyed = cut(keyed)
    total = keyed.agg(F.sum("n")).first()[0] or 0
    n_hot = keyed.filter(F.col("n") * share > total)
    one = rows.join(F.broadcast(n_hot.drop("n")), keys, "left_semi" if how == "left_semi" else "inner")
    rest = rows.join(F.broadcast(n_hot.select(*keys)), keys, "left_anti")
    other = rest.join(keyed.filter(F.col("n") * share <= total).drop("n"), keys, how)
    return one.unionByName(other)


def tiled(rows: DataFrame, key: str, member: str, limit: int, size: str | None = None) -> DataFrame:
    """rows of keys that at least two rows have, with columns tile, chunk, lo and hi (long): rows that share a key share a tile.

    A key of up to `limit` rows (or sizes in all) is one tile. One of more is cut into chunks by its members' hash, and every
    pair (lo, hi) of chunks is a tile, so that no task holds more than about two limits and no pair is lost. rows: a written
    table.
    """
    weight = F.sum(size) if size else F.count("*")
    shared = rows.groupBy(key).agg(F.count("*").alias("n"), F.ceil(weight / limit).alias("chunks")).filter("n > 1")
    held = join_hot(rows, shared, [key])
    held = held.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), member), F.col("chunks")))
    spread = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    spread = spread.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))
    tile = F.when(F.col("chunks") == 1, F.col(key)).otherwise(F.xxhash64(key, "lo", "hi"))
    return spread.withColumn("tile", tile).drop("chunks", "other")


@contextlib.contextmanager
def uncollected():
    """Without the cyclic garbage collector, which would walk millions of words and pieces that form no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of bounded text size; a single longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    fn: Callable[[list], list[tuple]],
    fields: str,
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """One output row for each input row: the id and what fn makes of the text. No shuffle.

    fn gets the texts of a slice (None for null) and returns a tuple of the given fields (a DDL string) for each. With
    setup, fn gets setup()'s result (made once a task) as a second argument. Other columns of df are not read, so
    their names cannot clash.
    """
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    names = [f.split()[0] for f in fields.split(",")]
    schema = f"`{id_col}` {dict(src.dtypes)['_id']}, {fields}"

    def run(batches):
        extra = (setup(),) if setup else ()
        for batch in batches:
            for part in slices(batch, "_text"):
                with uncollected():
                    rows = fn(part.column("_text").to_pylist(), *extra)
                    columns = [pa.array(c) for c in zip(*rows)]
                yield _typed([part.column("_id"), *columns], out_types)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_types = to_arrow_schema(_parse_datatype_string(schema))
    assert len(names) + 1 == len(out_types)
    return src.mapInArrow(run, schema)


def _typed(columns: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema)], names=schema.names
    )


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of numpy arrays or lists in the given schema."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def map_batches(docs: DataFrame, text_col: str, fn: Callable, setup: Callable[[], object] | None = None) -> DataFrame:
    """docs with its own columns, after fn(part, texts[, setup()]) has changed or filtered each part of a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.schema)

    def run(batches):
        extra = (setup(),) if setup else ()
        for batch in batches:
            for part in slices(batch, text_col):
                yield _typed(fn(part, part.column(text_col).to_pylist(), *extra).columns, schema)

    return docs.mapInArrow(run, docs.schema)


def with_texts(part: pa.RecordBatch, text_col: str, texts: list, size_col: str = "n_chars") -> pa.RecordBatch:
    """The part with other texts, and their lengths in code points where it has a column for them."""
    columns = list(part.columns)
    names = part.schema.names
    columns[names.index(text_col)] = pa.array(texts, pa.string())
    if size_col in names:
        at = names.index(size_col)
        columns[at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[at].type)
    return pa.RecordBatch.from_arrays(columns, names=names)
