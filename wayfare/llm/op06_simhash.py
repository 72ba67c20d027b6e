"""Operator 6, SimHash near-duplicates by Golay-code fuzzy hashing.

A document's 64-bit fingerprint is the bitwise majority over the hashes of its word shingles. Equal fingerprints are merged
first. For the others a fingerprint is split into four 16-bit segments. With at most three differing bits in all, some
segment agrees while its successor has at most one error (pigeonhole). The successor, padded to 23 bits, is decoded
by the perfect binary Golay code: every word within one bit of it is decoded as well, so that two segments one bit apart
share a codeword index. (agreeing segment, index) are the keys, about twenty a fingerprint. Fingerprints with a common key
are compared: within a key's rows a breadth-first search over exact Hamming distances links everything it
reaches to the smallest fingerprint, so a key gives fewer edges than members however dense it is. The edges of all keys
are joined to components.

A key's fingerprints beyond a thousand are grouped once more, by parts of the bits that they do not share yet, so that the
search does not grow with the square of a key. A key with over TILE fingerprints is cut into chunks whose pairs are searched
apart (tiled), so no task holds a large group.

near_copies() is the same operator with a wider radius, for five-word shingles and a Jaccard similarity of at least 0.8, where
about one bit in seven differs. Its fingerprints are those of the sets of shingles and have ten segments of 23 bits, the
length of the Golay code. A segment is decoded softly: the two codewords nearest to the vector of majorities (not only of
their signs) are its keys. By pigeonhole a pair is a candidate if two of the ten segments share a codeword, of which at
most one is a second choice. Keys move once, each with 64 bits of the fingerprint (its head): most keys that several sets have
they have by chance, more so the larger the corpus, and such sets go there unless a head is within HEAD_RADIUS bits. Whole
fingerprints are fetched for what is left. Candidates within WIDE_RADIUS bits make loose groups, and within those the exact
sets decide.

Defined cases: null or blank text has fingerprint zero and is linked like any other; rows with equal ids are one
document with several fingerprints for the component and appear once each; null ids keep their fingerprint and link
others, their own component is the smallest id they reach; a text of fewer words than a shingle is one shingle; a very long
text is read whole; an empty table gives no rows; other columns are ignored. In near_copies() null and blank texts have
the empty set and are one group.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.common import apart, cut, map_texts, table, tiled
from wayfare.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
SEGMENTS, BITS = 4, 16
#: Generator polynomial of the binary Golay code of length 23 (fixed).
GENERATOR = 0b101011100011
#: Fingerprints of a key that are searched together, and so many that each is compared with all that are left.
TILE, SEARCHED = 500_000, 1000
#: The wide form: shingle, similarity as a fraction (so that comparing is exact), segments, and bits that may differ.
WIDE_SHINGLE, LEAST, WIDE_SEGMENTS, WIDE_RADIUS = 5, (4, 5), 10, 60
#: Which of a wide fingerprint's bits its head has, and how many of them may differ: at a similarity of 0.8 some 10 of the 64 do, more than
#: 24 for some three pairs in a million; some six in a million differ in more than WIDE_RADIUS of all bits.
HEAD, HEAD_RADIUS = np.arange(64) * (WIDE_SEGMENTS * 23) // 64, 24
#: Rows of a key up to which heads are compared; those of a larger one all go on.
COMPARED = 2000
#: Shingles of a loose group that are compared together.
TILE_SHINGLES = 500_000


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; none of a blank text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1)[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops)]), ">u8").astype("<u8")


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit; 255 rows at a time fit a byte."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 255):
        bits = np.unpackbits(h[a : a + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint8)
    return ones


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bitwise majority of the shingles' hashes, as an unsigned 64-bit number."""
    h = shingle_hashes(text, shingle)
    return int(np.packbits(2 * _ones(h) > len(h), bitorder="little").view("<u8")[0])


def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the generator."""
    r = words.copy()
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


@functools.cache
def segment_keys() -> np.ndarray:
    """For each 16-bit word the distinct codeword indices of the words within one bit of it, padded with -1."""
    ones = [1 << i for i in range(23)]
    errors = [0, *ones]
    errors += [a | b for i, a in enumerate(ones) for b in ones[:i]]
    errors += [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j]]
    errors = np.array(errors)
    nearest = np.zeros(2048, np.int64)
    nearest[_remainders(errors)] = errors  # perfect code: every remainder is that of one error of at most three bits
    words = np.arange(1 << BITS)
    ball = words[:, None] ^ np.array([0, *(1 << np.arange(BITS))])
    index = np.sort((ball ^ nearest[_remainders(ball)]) >> 11, axis=1)
    index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
    index = -np.sort(-index, axis=1)
    return index[:, : int((index >= 0).sum(axis=1).max())]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs of unsigned fingerprints."""
    rows, keys = [], []
    for s in range(SEGMENTS):
        exact = (prints >> np.uint64(BITS * s) & np.uint64(0xFFFF)).astype(np.int64)
        after = (prints >> np.uint64(BITS * ((s + 1) % SEGMENTS)) & np.uint64(0xFFFF)).astype(np.int64)
        index = segment_keys()[after]
        r, c = np.nonzero(index >= 0)
        rows.append(r)
        keys.append((s << 28) | (exact[r] << 12) | index[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _chained(rest: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, root) for distinct sorted fingerprints that chains within radius connect; root is the smallest."""
    edges = []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= radius
            found = rest[near]
            rest = rest[~near]
            queue.extend(found)
            edges.extend((int(x), int(root)) for x in found)
    return edges


def near_edges(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Pairs (member, smaller member) that connect the distinct fingerprints which chains of distances within radius connect.

    Of many members only those are compared that agree in one of radius + 1 interleaved parts of their bits: any two within
    radius do (pigeonhole). Interleaved, as the members of a key agree in one run of bits already.
    """
    members = np.sort(members)
    if len(members) <= SEARCHED:
        return _chained(members, radius)
    edges = []
    for part in range(radius + 1):
        bits = members & np.uint64(sum(1 << i for i in range(part, 64, radius + 1)))
        order = np.argsort(bits, kind="stable")
        for group in np.split(members[order], np.flatnonzero(np.diff(bits[order])) + 1):
            edges += _chained(group, radius)
    return edges


def _keyed(batches):
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False)
        for a in range(0, len(prints), 5000):
            part = prints[a : a + 5000]
            rows, keys = fuzzy_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])


def _linked(batches):
    """Edges within each key of rows sorted by key; only the key in hand is held."""

    def edges(k: np.ndarray, f: np.ndarray):
        cuts = np.flatnonzero(np.diff(k)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(k)]])
        size = ends - starts
        pair = starts[size == 2]
        near = pair[np.bitwise_count((f[pair] ^ f[pair + 1]).view(np.uint64)) <= RADIUS]
        a, b = [np.maximum(f[near], f[near + 1])], [np.minimum(f[near], f[near + 1])]
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            if found := near_edges(np.unique(f[s:e]).view(np.uint64)):
                x = np.array(found, np.uint64).view(np.int64)
                a.append(x[:, 0])
                b.append(x[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        k, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        if not len(k):
            continue
        last = int(np.searchsorted(k, k[-1]))
        if last == 0 and (not waiting or waiting[0][0][0] == k[0]):
            waiting.append((k, f))  # still the same key
            continue
        done = [*waiting, (k[:last], f[:last])]
        yield edges(np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done]))
        waiting = [(k[last:], f[last:])]
    if waiting:
        yield edges(np.concatenate([x for x, _ in waiting]), np.concatenate([x for _, x in waiting]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number."""
    return map_texts(
        docs, id_col, text_col, lambda texts: [(x - (x >> 63 << 64),) for x in (fingerprint(t, shingle) for t in texts)], "fp long"
    )


def near_duplicates(prints: DataFrame, id_col: str = "doc_id", tile: int = TILE) -> DataFrame:
    """(id, fp, component_id) of (id, fp) rows: the smallest id that links reach."""

    def found() -> DataFrame:
        distinct = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
        keyed = cut(distinct.select("fp").mapInArrow(_keyed, "key long, fp long"))
        tiles = tiled(keyed, "key", "fp", tile).select(F.col("tile").alias("key"), "fp")
        edges = tiles.repartition("key").sortWithinPartitions("key").mapInArrow(_linked, "a long, b long")
        roots = components(edges).withColumnRenamed("a", "fp")
        rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        class_of = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
        return prints.join(class_of, "fp").select(id_col, "fp", "component_id")

    return apart(prints.sparkSession, found)


# -- the wide form ------------------------------------------------------------------------------------------------------


@functools.cache
def codewords() -> np.ndarray:
    """The 4096 codewords as columns of signs, 23 rows."""
    words = np.arange(1 << 12) << 11
    words = words | _remainders(words)
    return (1.0 - 2 * (words >> np.arange(23)[:, None] & 1)).astype(np.float32)


def wide_print(h: np.ndarray, segments: int = WIDE_SEGMENTS) -> np.ndarray:
    """The majorities of a set's hashes for each bit of each segment, between -1 and 1 and 0 for the empty set."""
    out = []
    for k in range(-(-segments * 23 // 64)):
        x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        out.append(1 - 2 * _ones(x ^ x >> np.uint64(29)) / max(1, len(h)))
    return np.concatenate(out)[: segments * 23]


def decoded(prints: np.ndarray) -> np.ndarray:
    """For each row and segment the numbers of the two nearest codewords, the nearer first and ties to the smaller."""
    fit = prints.reshape(-1, 23).astype(np.float32) @ codewords()
    each = np.arange(len(fit))
    first = fit.argmax(axis=1)
    fit[each, first] = -np.inf
    return np.stack([first, fit.argmax(axis=1)], axis=1).reshape(len(prints), -1, 2).astype("<u2")


def _set_rows(texts: list) -> list[tuple]:
    """(set, fp, codes) of each text; a set's number stands for the whole set."""
    sets = [np.unique(shingle_hashes(t, WIDE_SHINGLE)) for t in texts]
    prints = np.array([wide_print(h) for h in sets])
    fps = np.packbits(np.pad(prints < 0, ((0, 0), (0, -prints.shape[1] % 64))), axis=1)
    codes = np.concatenate([decoded(prints[a : a + 256]) for a in range(0, len(prints), 256)])
    number = [xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63) for h in sets]
    return [(n, f.tobytes(), c.tobytes()) for n, f, c in zip(number, fps, codes)]


def wide_keys(codes: np.ndarray) -> np.ndarray:
    """The keys of each row of (segments, 2) codes: two segments, their codewords, at most one of them a second choice."""
    codes, out = codes.astype(np.int64), []
    for k, (i, j) in enumerate(itertools.combinations(range(codes.shape[1]), 2)):
        out += [k << 24 | codes[:, i, x] << 12 | codes[:, j, y] for x, y in ((0, 0), (0, 1), (1, 0))]
    return np.stack(out, axis=1)


def _wide_keyed(batches):
    for batch in batches:
        sets = batch.column("set").to_numpy(zero_copy_only=False)
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<u2").reshape(len(sets), WIDE_SEGMENTS, 2)
        head = heads(np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(len(sets), -1))
        for a in range(0, len(sets), 2000):
            keys = wide_keys(codes[a : a + 2000])
            each = [pa.array(np.repeat(x[a : a + 2000], keys.shape[1])) for x in (sets, head)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *each], names=["key", "set", "head"])


def heads(prints: np.ndarray) -> np.ndarray:
    """64 bits of each row of bytes, spread over all segments, as signed numbers."""
    return np.ascontiguousarray(np.packbits(np.unpackbits(prints, axis=1)[:, HEAD], axis=1)).view("<i8").ravel()


def with_partner(keys: np.ndarray, head: np.ndarray, radius: int = HEAD_RADIUS) -> np.ndarray:
    """Which rows, sorted by key, have another row of their key within the radius."""
    found, at, step = np.zeros(len(keys), bool), np.arange(len(keys)), 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        near = at[np.bitwise_count((head[at] ^ head[at + step]).view(np.uint64)) <= radius]
        found[near] = found[near + step] = True
        step += 1
    return found


def _wide_shared(batches):
    """(key, set) of the rows (key, set, head), sorted by key, that may have a near copy there; at most COMPARED rows of the key in hand are held."""
    row = lambda k, ids, to: pa.RecordBatch.from_arrays([pa.array(k[to]), pa.array(ids[to])], names=["key", "set"])
    held, large = [], None  # rows of the last key, and a key that is known to be large
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "set", "head")]
        if large is not None:
            here = int(np.searchsorted(columns[0], large, "right"))
            yield row(*columns[:2], slice(0, here))
            columns = [c[here:] for c in columns]
        if not len(columns[0]):
            continue
        large = None
        k, ids, head = (np.concatenate(x) for x in zip(*held, columns))
        last = int(np.searchsorted(k, k[-1]))
        held = [(k[last:], ids[last:], head[last:])]
        if last:
            yield row(k, ids, _kept(k[:last], head[:last]))
        if len(k) - last > COMPARED:
            held, large = [], k[-1]
            yield row(k, ids, slice(last, None))
    if held:
        k, ids, head = held[0]
        yield row(k, ids, _kept(k, head))


def _kept(k: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Places of the rows with a partner, and of all rows of the keys of over COMPARED rows."""
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(starts, len(k)))
    every = np.repeat(sizes > COMPARED, sizes)
    some = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= COMPARED), sizes))
    every[some] = with_partner(k[some], head[some])
    return np.flatnonzero(every)


def wide_edges(ids: np.ndarray, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, root) for the rows that chains of distances within radius connect; root is the smallest of distinct ids."""
    order = np.argsort(ids)
    ids, prints, edges = ids[order], prints[order], []
    while len(ids) > 1:
        root, queue = int(ids[0]), [prints[0]]
        ids, prints = ids[1:], prints[1:]
        while queue and len(ids):
            near = np.bitwise_count(prints ^ queue.pop()).sum(axis=1) <= radius
            edges.extend((int(x), root) for x in ids[near])
            queue.extend(prints[near])
            ids, prints = ids[~near], prints[~near]
    return edges


def _wide_linked(batches):
    """Edges within each key of rows (key, set, fp) sorted by key; only the key in hand is held."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def edges():
        k, ids, prints = (np.concatenate(x) for x in zip(*held))
        cuts = np.flatnonzero(np.diff(k)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(k)]])
        pair = starts[ends - starts == 2]
        near = pair[np.bitwise_count(prints[pair] ^ prints[pair + 1]).sum(axis=1) <= WIDE_RADIUS]
        a, b = [np.maximum(ids[near], ids[near + 1])], [np.minimum(ids[near], ids[near + 1])]
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
            if found := wide_edges(ids[s:e], prints[s:e], WIDE_RADIUS):
                x = np.array(found, np.int64)
                a.append(x[:, 0])
                b.append(x[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "set"))
        prints = np.frombuffer(b"".join(batch.column("fp").to_pylist()), "<u8").reshape(len(k), -1)
        last = int(np.searchsorted(k, k[-1]))
        if last or (held and held[0][0][0] != k[0]):
            held.append((k[:last], ids[:last], prints[:last]))
            yield edges()
            held = []
        held.append((k[last:], ids[last:], prints[last:]))
    if held:
        yield edges()


def jaccard_edges(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(member, root) for the sets that chains of similarities of at least LEAST connect; root is the smallest id."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    sizes = np.array([len(sets[i]) for i in order])
    values, owner = np.concatenate([sets[i] for i in order]), np.repeat(np.arange(len(order)), sizes)
    alive = np.ones(len(order), bool)
    edges = []
    for first in range(len(order)):
        if not alive[first]:
            continue
        alive[first] = False
        queue = [first]
        while queue and alive.any():
            held = alive[owner]
            values, owner = values[held], owner[held]
            mine = sets[order[queue.pop()]]
            at = np.searchsorted(mine, values)
            at[at == len(mine)] = 0
            shared = np.bincount(owner[mine[at] == values], minlength=len(order))
            near = np.flatnonzero(alive & (shared * LEAST[1] >= (len(mine) + sizes - shared) * LEAST[0]))
            alive[near] = False
            queue.extend(near.tolist())
            edges.extend((ids[order[i]], ids[order[first]]) for i in near.tolist())
    return edges


def _exact(t: pa.Table) -> pa.Table:
    found = jaccard_edges(t.column("set").to_pylist(), [np.frombuffer(x, "<u8") for x in t.column("hashes").to_pylist()])
    return pa.table({c: pa.array([x[i] for x in found], pa.int64()) for i, c in enumerate("ab")})


def near_copies(rows: DataFrame, key: str, text_col: str = "text", tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(key, group) of each row, group being the smallest key of its near copies; keys: distinct, not null, with an order."""

    def found() -> DataFrame:
        made = cut(map_texts(rows, key, text_col, _set_rows, "set long, fp binary, codes binary"))
        distinct = cut(made.groupBy("set").agg(F.min(key).alias("least"), F.min("fp").alias("fp"), F.min("codes").alias("codes")))
        every = distinct.select("set", "codes", "fp").mapInArrow(_wide_keyed, "key long, set long, head long")
        keyed = cut(every.repartition("key").sortWithinPartitions("key").mapInArrow(_wide_shared, "key long, set long"))
        tiles = tiled(keyed, "key", "set", tile).select(F.col("tile").alias("key"), "set")
        shown = tiles.join(distinct.select("set", "fp"), "set")
        loose = components(shown.repartition("key").sortWithinPartitions("key").mapInArrow(_wide_linked, "a long, b long"))
        members = cut(loose.select(F.col("a").alias("set"), "root").unionByName(loose.select(F.col("root").alias("set"), "root").distinct()))
        texts = members.select("set").join(distinct, "set").select("set", F.col("least").alias(key)).join(rows, key).select("set", text_col)
        hashes = cut(map_texts(texts, "set", text_col, lambda ts: [(len(h), h.tobytes()) for h in (np.unique(shingle_hashes(t, WIDE_SHINGLE)) for t in ts)], "size long, hashes binary"))
        sized = cut(members.join(hashes.select("set", "size"), "set"))
        groups = tiled(sized, "root", "set", tile_shingles, "size").select("tile", "set").join(hashes.select("set", "hashes"), "set")
        roots = components(groups.groupBy("tile").applyInArrow(_exact, "a long, b long")).withColumnRenamed("a", "set")
        rooted = distinct.select("set", "least").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
        groups = rooted.select("set", "root").join(rooted.groupBy("root").agg(F.min("least").alias("group")), "root").select("set", "group")
        return made.select(key, "set").join(groups, "set").select(key, "group")

    return apart(rows.sparkSession, found)


def hex_of(fp) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(cut(fingerprints(table(spark, sf_dir, "documents"))))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
