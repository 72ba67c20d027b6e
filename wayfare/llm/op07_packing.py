"""Operator 7, packing: concatenate and cut.

Pass 1 tokenizes each document once into a written table, with its start within its partition. Pass 2 turns the token
totals of the partitions (one number each) into global offsets by a prefix sum and cuts the concatenation at fixed
windows; a document that crosses a boundary gives a record on either side of it. Neither pass shuffles. The rest after
the last full window is cut at descending powers of two, so no sequence needs padding.

Ids are those of the tokenizers library for its vocabulary file, special strings being ordinary text. A slice's texts are
split into pieces together (pieces.py, with the library's own character classes) and stay Arrow and numpy columns: the pieces
are dictionary-encoded, so Python only meets each distinct piece of a slice once, and the ids of the texts are gathered from those of the
distinct pieces. The library's model tokenizes the pieces that a task has not met; a table of bounded size keeps their ids.

Defined cases: null text is empty and gives only the end id; every document gives at least one piece; equal rows and
equal or null ids are documents of their own; a very long text is one document in many pieces; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.common import cut, slices, table, uncollected
from wayfare.llm.pieces import split_column, tokenizers_classes

WINDOW = 2048
END_ID = 1
#: A task forgets the ids of its pieces beyond so many, and keeps none of more bytes than these.
KEPT, KEPT_SIZE = 800_000, 64
#: How a byte-level vocabulary writes each byte: those that print stand for themselves, the others are moved up.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(b) for b in _PRINTS} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTS)}

_HELD: dict = {}


class Encoder:
    def __init__(self, spec: str, classes: np.ndarray):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        self.tokenize = tokenizer.model.tokenize
        self.raw = [np.uint32(i).tobytes() for i in range(tokenizer.get_vocab_size())]
        self.classes = classes
        self.of_piece: dict[bytes, bytes] = {}

    @property
    def of_chunk(self) -> dict[bytes, bytes]:
        """Chunks of texts are their pieces: one table holds both."""
        return self.of_piece

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.columns(pa.array(texts, pa.string()), b"")[0].to_pylist()

    def columns(self, texts: pa.Array, end: bytes) -> tuple[pa.Array, np.ndarray]:
        """Ids of each text (null: empty) with `end` after them, little-endian unsigned 32-bit integers, and their numbers."""
        pieces, firsts = split_column(texts, self.classes)
        coded = pieces.dictionary_encode()
        found = [*self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), end]
        kinds = np.insert(coded.indices.to_numpy(), firsts[1:], len(found) - 1)  # an end behind each text's pieces
        last = firsts + np.arange(len(firsts))
        held = np.frombuffer(b"".join(found), "<u4")
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = lengths[kinds]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = held[np.repeat((np.cumsum(lengths) - lengths)[kinds] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[last]
        offsets = pa.array(4 * bounds).cast(pa.int32())  # refuses what a binary column cannot hold
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets.buffers()[1], pa.py_buffer(ids)]), np.diff(bounds)

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each of the pieces, which are distinct."""
        out: list = list(map(self.of_piece.get, pieces))
        new = [k for k, ids in enumerate(out) if ids is None]
        if len(self.of_piece) + len(new) > KEPT:
            self.of_piece = {p: ids for p, ids in zip(pieces, out) if ids is not None}
        kept, raw, tokenize = self.of_piece, self.raw, self.tokenize
        shown = b"\xff".join([pieces[k] for k in new]).decode("latin-1").translate(_SHOWN).split(_SHOWN[0xFF])  # a byte that UTF-8 never has
        for k, s in zip(new, shown):
            out[k] = b"".join([raw[t.id] for t in tokenize(s)])
            if len(pieces[k]) <= KEPT_SIZE:
                kept[pieces[k]] = out[k]
        return out


def encoder_of(spec: str, classes: np.ndarray) -> Encoder:
    """The worker's own encoder: later tasks of the worker find its pieces again."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if hash(spec) not in _HELD:
        _HELD.clear()
        _HELD[hash(spec)] = Encoder(spec, classes)
    return _HELD[hash(spec)]


def place_tokens(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Each document's ids with the end id (little-endian unsigned 32-bit integers), its partition and start within it."""
    held = docs.sparkSession.sparkContext.broadcast((spec, tokenizers_classes()))  # a vocabulary and a byte a code point: under 5 MB whatever the corpus
    end = np.array([end_id], "<u4").tobytes()
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = dict(src.dtypes)["_id"]

    def run(batches):
        part, at, encoder = TaskContext.get().partitionId(), 0, encoder_of(*held.value)
        for batch in batches:
            for piece in slices(batch, "_text"):
                with uncollected():
                    ids, sizes = encoder.columns(piece.column("_text"), end)
                ends = at + np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("_id"), ids, pa.array(np.full(len(ids), part, np.int64)), pa.array(ends - sizes), pa.array(ends)],
                    names=[id_col, "ids", "part", "part_start", "part_end"],
                )
                at = int(ends[-1]) if len(ends) else at

    return src.mapInArrow(run, f"`{id_col}` {kind}, ids binary, part long, part_start long, part_end long")


def windows(total: int, window: int) -> np.ndarray:
    """Starts of the sequences: full windows, then the rest at descending powers of two, and the end."""
    full = total // window
    starts, at = [], full * window
    for k in reversed(range(window.bit_length())):
        if (total - full * window) >> k & 1:
            starts.append(at)
            at += 1 << k
    return np.array([*starts, at], np.int64)


def pack(placed: DataFrame, id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """One row for each piece of a document in a sequence; placed: a written table of place_tokens()."""
    totals = placed.groupBy("part").agg(F.max("part_end").alias("n")).orderBy("part").collect()  # one row a partition
    sums = np.concatenate([[0], np.cumsum([r["n"] for r in totals])]).astype(np.int64)
    offsets = {r["part"]: int(s) for r, s in zip(totals, sums)}
    total = int(sums[-1])
    full = total // window
    tail = windows(total, window)
    held = placed.sparkSession.sparkContext.broadcast(offsets)
    kind = dict(placed.dtypes)[id_col]
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "ids"):
                rows, take = [], []
                of = zip(piece.column("ids").to_pylist(), piece.column("part").to_pylist(), piece.column("part_start").to_pylist())
                for i, (ids, part, start) in enumerate(of):
                    n, first = len(ids) // 4, held.value[part] + start
                    at = first
                    while at < first + n:
                        if at < full * window:
                            seq = at // window
                            a, b = seq * window, (seq + 1) * window
                        else:
                            k = int(np.searchsorted(tail, at, "right")) - 1
                            seq, a, b = full + k, int(tail[k]), int(tail[k + 1])
                        stop = min(b, first + n)
                        crc = zlib.crc32(ids[4 * (at - first) : 4 * (stop - first)])
                        rows.append((at - first, stop - at, crc, n, seq, at - a))
                        take.append(i)
                        at = stop
                columns = zip(*rows) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(id_col).take(pa.array(take, pa.int32())), *(pa.array(c, pa.int64()) for c in columns)],
                    names=[id_col, *names],
                )

    return placed.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def pack_documents(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    return pack(cut(place_tokens(docs, spec, id_col, text_col, end_id)), id_col, window)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())
