"""Operator 5, byte-level BPE encoding and decoding.

Each slice of documents is split by the pattern (pieces.py, with the character classes of the tiktoken library); its distinct pieces are the rows of padded numpy matrices, bucketed by
length. In a round every row merges its leftmost pair of minimum rank; pair ranks come from a hashed pair table
(open addressing, probed for the whole matrix at once) and the matrix is compacted after each round. A piece's ids are kept
for later slices of the task in a table of bounded size. No shuffle; memory is bounded by a slice of text.

Pieces of more than LONG bytes would cost a round for each byte, so those few take the same merges (leftmost pair of
minimum rank first) from a heap over a linked list.

Defined cases: null text is empty (no ids, digests of nothing); equal rows and equal or null ids give rows of their own; a
very long text is encoded whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from wayfare.llm.common import map_texts, table
from wayfare.llm.pieces import split, tiktoken_classes

#: Pieces of more bytes go to the heap; others to matrices of at most so many entries.
LONG, ENTRIES = 256, 600_000
#: A task forgets its pieces' ids beyond so many.
KEPT_PIECES = 250_000
_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if b}


class PairTable:
    """(left id, right id) -> (rank of the merged token) as two numpy arrays with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        values = np.array(merged, np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.values = np.full(size, _NONE, np.int32)
        self.probes = 0
        at, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):  # each round, one key takes each free slot and the others move on by one
            self.probes += 1
            free = self.keys[at[waiting]] == np.uint64(2**64 - 1)
            slots, first = np.unique(at[waiting][free], return_index=True)
            took = waiting[free][first]
            self.keys[slots], self.values[slots] = keys[took], values[took]
            waiting = np.setdiff1d(waiting, took, assume_unique=True)
            at[waiting] = (at[waiting] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE; negative ids pair with nothing."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], _NONE)
        look = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        for _ in range(self.probes - 1):
            if not len(look):
                break
            at[look] = (at[look] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[look]]
            hit = got == keys[look]
            out[look[hit]] = self.values[at[look[hit]]]
            look = look[~hit & (got != np.uint64(2**64 - 1))]
        out[(left < 0) | (right < 0)] = _NONE
        return out


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(ranks)
        self.by_pair = None
        self.ranks = ranks
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens])
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.kept: dict[str, bytes] = {}

    def encode_matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of similar lengths: a padded matrix, one merge a row and round, compacted after each."""
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), int(sizes.max())), -1, np.int32)
        ids[np.arange(ids.shape[1]) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list = [None] * len(pieces)
        rows = np.arange(len(pieces))
        ranks = self.pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), -1)
        while True:
            done = ranks.min(axis=1, initial=_NONE) == _NONE
            if done.any():
                raw, width = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, (r, n) in enumerate(zip(rows[done].tolist(), sizes[done].tolist())):
                    out[r] = raw[k * width : k * width + 4 * n]
                ids, ranks, rows, sizes = ids[~done], ranks[~done], rows[~done], sizes[~done]
            if not len(rows):
                return out
            each = np.arange(len(rows))
            at = ranks.argmin(axis=1)
            merged = ranks[each, at]
            width = int(sizes.max()) - 1
            columns = np.arange(width)
            take = columns + (columns > at[:, None])  # close the gap that the right part leaves
            ids = np.take_along_axis(ids, take, axis=1)
            ids[each, at] = merged
            sizes = sizes - 1
            old = np.take_along_axis(ranks, np.minimum(take, ranks.shape[1] - 1)[:, : max(width - 1, 0)], axis=1)
            ranks = old
            if width > 1:  # only the pairs that touch the new token changed
                for shift in (-1, 0):
                    where = at + shift
                    ok = (where >= 0) & (where < width - 1)
                    r, c = each[ok], where[ok]
                    ranks[r, c] = self.pairs.ranks(ids[r, c], ids[r, c + 1])
                last = columns[: width - 1] >= (sizes - 1)[:, None]
                ranks[last] = _NONE

    def encode_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of (rank, place) over a doubly linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        first = self.pairs.ranks(ids[:-1], ids[1:])
        ids = ids.tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), int(i), ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        if self.by_pair is None:
            used = self.pairs.values != _NONE
            self.by_pair = dict(zip(self.pairs.keys[used].tolist(), self.pairs.values[used].tolist()))
        rank_of = self.by_pair
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of.get((rank << 32) | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := rank_of.get((ids[h] << 32) | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers for each piece."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) > LONG:
                out[i] = self.encode_long(p).astype("<u4").tobytes()
            else:
                buckets.setdefault((len(p) + 3) // 4, []).append(i)
        for width, of in buckets.items():
            at_once = ENTRIES // (4 * width + 4)
            for a in range(0, len(of), at_once):
                part = of[a : a + at_once]
                for i, ids in zip(part, self.encode_matrix([pieces[i] for i in part])):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = split(texts, tiktoken_classes())
        here = set().union(*pieces)
        new = list(here - self.kept.keys())
        if len(self.kept) + len(new) > KEPT_PIECES:
            self.kept = {p: self.kept[p] for p in here & self.kept.keys()}
        self.kept.update(zip(new, self.encode_pieces([p.encode("utf-8", "replace") for p in new])))
        return [b"".join(map(self.kept.__getitem__, s)) for s in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids: one gather from the vocabulary's bytes."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b""
        at = np.repeat(self.offsets[ids] - (ends - n), n) + np.arange(int(ends[-1]))
        return self.blob[at].tobytes()


_HELD: dict[int, Bpe] = {}


def bpe_of(ranks: dict[bytes, int]) -> Bpe:
    """The worker's own Bpe of a broadcast vocabulary: later tasks of the worker find its pieces again."""
    if id(ranks) not in _HELD:
        _HELD.clear()
        _HELD[id(ranks)] = Bpe(ranks)
    return _HELD[id(ranks)]


def digest(texts: list[str | None], bpe: Bpe) -> list[tuple]:
    out = []
    for ids in bpe.encode([t or "" for t in texts]):
        decoded = bpe.decode(np.frombuffer(ids, "<u4"))
        out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    return out


FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its ids as an array."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: under 2 MB whatever the corpus
    return map_texts(
        docs,
        id_col,
        text_col,
        lambda texts, bpe: [(np.frombuffer(x, "<u4").astype(np.int64).tolist(),) for x in bpe.encode([t or "" for t in texts])],
        "ids array<long>",
        setup=lambda: bpe_of(held.value),
    )


def encode_digests(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: number of ids, digests of the ids and of the bytes decoded from them."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    return map_texts(docs, id_col, text_col, digest, FIELDS, setup=lambda: bpe_of(held.value))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode_digests(table(spark, sf_dir, "documents"), ranks)
