"""Monthly on-time records: zip archives with one CSV each, and plain CSV files.

Archives on a file system that all machines share are a Python data source ("ontime_archives"): one partition an archive,
which its task opens in place and decompresses block by block, so neither an archive's size nor its CSV's is a limit, and only
the wanted columns are parsed. Archives in a store that only Spark can open are read as binary files, each whole (2 GB
at most). CSV files are read by header: files with the same header line are one scan with that header's columns, so the order
of columns may differ from file to file. Archives that cannot be read and rows that do not fit their header are set
aside with their error, not fatal.
"""

from __future__ import annotations

import codecs
import csv
import glob
import io
import os
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import BinaryIO

import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from wayfare import schema

#: The fixed columns with their types; those of a state are taken if a file has them.
TYPES = {
    "Year": "int", "Month": "int", "DayOfWeek": "int", "FlightDate": "string", "Reporting_Airline": "string", "Origin": "string", "Dest": "string",
    "CRSDepTime": "int", "Distance": "double", "ArrDel15": "double", "Cancelled": "double", "Diverted": "double",
}
STATES = [c for names in schema.STATE_CANDIDATES.values() for c in names]
_COLUMNS = [*TYPES, *STATES]
_NAMES = ["path", "error", *_COLUMNS]
_RAW = ", ".join(f"`{n}` string" for n in _NAMES)
BLOCK_BYTES = 8 << 20
#: Bad rows of an archive that are passed on together.
_BAD_AT_ONCE = 1000


# -- archives -----------------------------------------------------------------------------------------------------------


def _member(source: bytes | BinaryIO):
    """The first CSV member, open; bytes that are no UTF-8 are replaced."""
    z = zipfile.ZipFile(io.BytesIO(source) if isinstance(source, bytes) else source)
    name = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
    if name is None:
        raise ValueError("no CSV member")
    return codecs.EncodedFile(z.open(name), "utf-8", errors="replace")


def first_csv(source: bytes | BinaryIO, bad: list[str], columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Blocks of the first CSV member, the columns as strings; rows that do not fit the header are put in `bad`."""
    columns = _COLUMNS if columns is None else columns

    def skipped(row) -> str:
        bad.append(f"{row.actual_columns} columns for {row.expected_columns}: {(row.text or '')[:200]}")
        return "skip"

    options = pacsv.ConvertOptions(
        column_types=dict.fromkeys(columns, pa.string()), include_columns=columns, include_missing_columns=True, null_values=[""], strings_can_be_null=True
    )
    with _member(source) as f:
        yield from pacsv.open_csv(f, pacsv.ReadOptions(block_size=BLOCK_BYTES, use_threads=False), pacsv.ParseOptions(invalid_row_handler=skipped), options)


def _rows_of(path: str, source: bytes | BinaryIO, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches (path, error, columns) of an archive, and at its end what could not be read."""
    names, bad = ["path", "error", *columns], []
    try:
        for rows in first_csv(source, bad, columns):
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path), n), pa.nulls(n, pa.string()), *(rows.column(c) for c in columns)], names=names)
            if len(bad) >= _BAD_AT_ONCE:
                yield _failed(path, bad, names)
                bad.clear()
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError) as e:
        bad.append(f"{type(e).__name__}: {e}")
    if bad:
        yield _failed(path, bad, names)


def _failed(path: str, errors: list[str], names: list[str]) -> pa.RecordBatch:
    none = pa.nulls(len(errors), pa.string())
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path), len(errors)), pa.array(errors, pa.string()), *[none] * (len(names) - 2)], names=names)


class OnTimeArchives(DataSource):
    """Archives under a path or pattern of a shared file system; the schema that is asked for says which columns are parsed."""

    @classmethod
    def name(cls) -> str:
        return "ontime_archives"

    def schema(self) -> str:
        return _RAW

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArchiveReader(self.options["path"], [c for c in schema.names if c not in ("path", "error")])


class _ArchiveReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path.removeprefix("file:"), columns

    def partitions(self) -> list[InputPartition]:
        inside = f"{self.path.rstrip('/')}/*" if os.path.isdir(self.path) else self.path
        return [InputPartition(p) for p in sorted(glob.glob(inside)) if os.path.isfile(p) and not os.path.basename(p).startswith(("_", "."))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:  # no archive matches
            return
        with open(partition.value, "rb") as f:
            yield from _rows_of(f"file:{partition.value}", f, self.columns)


def _typed(raw: DataFrame, with_errors: bool) -> DataFrame:
    cast = {c: F.col(c).try_cast(t).alias(c) for c, t in TYPES.items()}
    typed = raw.select(*(cast.get(c, F.col(c)) for c in raw.columns))
    return typed if with_errors else typed.filter("error is null").drop("path", "error")


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _shared(path: str) -> bool:
    """Whether the path is of a file system that tasks can open files of."""
    return path.startswith(("/", "file:/"))


def read_archives(spark: SparkSession, path: str, with_errors: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Rows of all archives, of all or of the named columns.

    with_errors adds path and error, and a row for each archive or row that cannot be read.
    """
    wanted = _COLUMNS if columns is None else [c for c in _COLUMNS if c in columns]
    ddl = ", ".join(f"`{c}` string" for c in ["path", "error", *wanted])
    if _shared(path):
        spark.dataSource.register(OnTimeArchives)
        return _typed(spark.read.format(OnTimeArchives.name()).schema(ddl).load(path), with_errors)

    def run(batches):
        for b in batches:
            for p, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                yield from _rows_of(p, content, wanted)

    return _typed(_archives(spark, path).mapInArrow(run, ddl), with_errors)


def write_archives(df: DataFrame, folder: str, by: list[str]) -> None:
    """A zip archive with one CSV for each value of the key columns, in a folder of a shared file system.

    Rows of a key come sorted to a task, which writes them block by block under another name and renames the whole archive at
    its end, so a task that runs again replaces its own archives.
    """
    folder, names = folder.removeprefix("file:"), df.columns

    def write(batches):
        key = target = z = member = None

        def close():
            member.close()
            z.close()
            os.replace(f"{target}.{os.getpid()}.part", target)

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            keys = list(zip(*(batch.column(f"_{i}").to_pylist() for i in range(len(by)))))
            starts = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                rows = batch.slice(a, b - a).select(names)
                if keys[a] != key:
                    if member:
                        close()
                    key, target = keys[a], f"{folder}/{'-'.join(map(str, keys[a]))}.zip"
                    z = zipfile.ZipFile(f"{target}.{os.getpid()}.part", "w", zipfile.ZIP_DEFLATED)
                    member = z.open("rows.csv", "w", force_zip64=True)
                    pacsv.write_csv(rows, member)
                else:
                    pacsv.write_csv(rows, member, pacsv.WriteOptions(include_header=False))
        if member:
            close()
        yield from ()

    keyed = df.select(*names, *(F.col(k).alias(f"_{i}") for i, k in enumerate(by)))
    keys = [f"_{i}" for i in range(len(by))]
    keyed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(write, "done int").count()


def cut_short(names: DataFrame, folder: str) -> None:
    """Damages the archives of the names: what is left of each is its first bytes, as after a broken download."""
    folder = folder.removeprefix("file:")

    def cut(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                with open(f"{folder}/{name}.zip", "r+b") as f:
                    f.truncate(40)
        yield from ()

    names.mapInArrow(cut, "done int").count()


def archive_columns(spark: SparkSession, path: str) -> set[str]:
    """All column names in the archives' header lines."""

    def run(batches):
        for b in batches:
            names: set[str] = set()
            for content in b.column("content").to_pylist():
                try:
                    with _member(content) as f:
                        names.update(next(csv.reader([f.readline().decode()]), []))
                except (zipfile.BadZipFile, ValueError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(sorted(names), pa.string())], names=["name"])

    return {r["name"] for r in _archives(spark, path).mapInArrow(run, "name string").distinct().collect()}


# -- plain files --------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, pattern: str) -> list:
    """Hadoop's statuses of the files that match; of a matching folder, those of its files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(fs.globStatus(at) or [])
    inside = [f for d in found if d.isDirectory() for f in fs.listStatus(d.getPath()) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    return [f for f in found if f.isFile()] + inside


def _first_line(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()


def _first_lines(batches):
    for b in batches:
        lines = []
        for path in b.column("path").to_pylist():
            with open(path.removeprefix("file:"), encoding="utf-8", errors="replace") as f:
                lines.append(f.readline().rstrip("\r\n"))
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(lines, pa.string())], names=["path", "line"])


def headers(spark: SparkSession, pattern: str) -> dict[tuple[str, ...], list[str]]:
    """Header to files; only each file's first line is read, and files without one are left out.

    Tasks read them from a shared file system; from a store, many threads of the driver.
    """
    files = [f.getPath().toString() for f in _files(spark, pattern)]
    if not files:
        return {}
    if all(map(_shared, files)):
        named = spark.createDataFrame([(f,) for f in files], "path string").repartition(min(len(files), 8 * spark.sparkContext.defaultParallelism))
        found = sorted(tuple(r) for r in named.mapInArrow(_first_lines, "path string, line string").collect())
    else:
        with ThreadPoolExecutor(32) as pool:
            found = sorted(zip(files, pool.map(lambda f: _first_line(spark, f), files)))
    out: dict[tuple[str, ...], list[str]] = {}
    for path, line in found:
        if line:
            out.setdefault(tuple(next(csv.reader([line.removeprefix("\ufeff")]))), []).append(path)
    return out


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], _RAW)


def read_csv(spark: SparkSession, path: str, with_errors: bool = False) -> DataFrame:
    """Plain CSV files with a header, whatever each file's order of columns; values of a wrong type become null.

    with_errors adds path and error, and keeps the rows whose number of values is not their header's.
    """
    parts = []
    for names, files in headers(spark, path).items():
        ddl = ", ".join(f"_{i} string" for i in range(len(names))) + ", _bad string"
        # without pruning, as the parser counts only the values that it is asked for
        raw = spark.read.option("columnPruning", "false").csv(files, schema=ddl, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
        place = {c: f"_{i}" for i, c in reversed(list(enumerate(names)))}
        columns = [(F.col(place[c]) if c in place else F.lit(None).cast("string")).alias(c) for c in _COLUMNS]
        # Spark allows no query of the corrupt record alone, so the error reads a value too
        error = F.concat("_bad", F.substring(F.coalesce("_0", F.lit("")), 1, 0))
        parts.append(raw.select(F.col("_metadata.file_path").alias("path"), error.alias("error"), *columns))
    return _typed(reduce(DataFrame.unionByName, parts) if parts else _nothing(spark), with_errors)


def with_present_states(df: DataFrame, have: set[str]) -> DataFrame:
    """Drops the state columns that no file has, so that the first candidate that exists is taken later."""
    return df.drop(*(c for c in STATES if c not in have))


def read_folder(spark: SparkSession, folder: str, with_errors: bool = False) -> DataFrame:
    """All archives and CSV files of a folder; either kind may be missing."""
    zips, plain = f"{folder}/*.zip", f"{folder}/*.csv"
    have = {c for names in headers(spark, plain) for c in names}
    both = read_csv(spark, plain, with_errors)
    if _files(spark, zips):
        both = read_archives(spark, zips, with_errors).unionByName(both)
        have |= archive_columns(spark, zips)
    return with_present_states(both, have)
