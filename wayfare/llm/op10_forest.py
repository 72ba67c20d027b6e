"""Operator 10, embedding near-duplicates by a forest of random projection trees.

Equal vectors of a label are merged into one with a count. Every label grows TREES trees from its own vectors: a node of over
LEAF vectors is split at a place of a random direction, the median if vectors lie evenly, else beside what is dense (best_cut),
and vectors near the split go to both sides (spill overlap), so a close pair shares a leaf of some tree almost surely. Trees grow by LEVELS levels a round, as deep as the data need: the
splits of a node are fitted in a task on about FIT of its vectors and joined back to all of them, and nodes that are still
too large are split again in the next round. Directions follow from the node's number, so only places are passed on. A
node is a leaf early only if no direction separates it, as in a group of near copies.

Rows of a leaf meet in tiles of bounded size (a leaf of over CHUNK rows is cut into chunks and every pair of chunks becomes
a tile, so no row is dropped and no task holds a large group). A tile is a matrix of exact cosines; pairs at or above the
threshold are links. A pair that shares several leaves counts in the smallest of them only, so link counts need no
pair to be written; a tile passes on a count for each vector and fewer edges than vectors, which are then joined to components.

Recall follows the number of trees and the spill margin (tests measure it against all pairs); precision is exact.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
link with nothing; vectors of different lengths never link; rows that repeat an id, or have none, are vectors of their own
like any others; a component that has only null ids has a null component_id, and kept compares null-safely; equal
cosines need no tie rule; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.common import apart, cut, join_hot, table, tiled
from wayfare.llm.components import components

COSINE = 0.98
#: Trees, vectors that a leaf should have, and the seed.
TREES, LEAF, SEED = 4, 400, 17
#: Levels of a round, vectors of a node that its splits are fitted on, and directions that a split chooses from.
LEVELS, FIT, CHOICES = 4, 4000, 3
#: Places that a split may have on its direction, as quantiles; rows that both sides get may be this many times those that the
#: smaller side has alone; of the rows fitted on, so many at least must be on either side alone.
PLACES, OVERLAP, ALONE = np.linspace(0.01, 0.99, 99), 1.5, 2
#: Rows of a chunk; a tile has two at most.
CHUNK = 2000
#: Half width of the spill band, in standard deviations of a borderline pair's difference along a random direction.
SPILL = 0.75
_NODES = (1 << LEVELS) - 1


def _unit(raw: list[bytes]) -> np.ndarray:
    """Vectors of one length at length one; scaled first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def usable(rows: DataFrame) -> DataFrame:
    """(rid, id, label, v): the vectors that can link, as little-endian doubles; only equal labels and lengths compare."""
    x = F.col("x")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    some = rows.filter(x.isNotNull() & F.col("label").isNotNull() & whole & F.exists(x, lambda c: c != 0))
    some = some.select("rid", "id", F.concat_ws("/", "label", F.size(x)).alias("label"), x.cast("array<double>").alias("x"))

    def run(batches):
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0
            at = np.concatenate([[0], np.cumsum(batch.column("x").value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            v = [flat[a:b].tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), batch.column("label"), pa.array(v, pa.binary())], names=["rid", "id", "label", "v"])

    return some.mapInArrow(run, f"rid long, id {dict(rows.dtypes)['id']}, label string, v binary")


# -- trees --------------------------------------------------------------------------------------------------------------


def _directions(node: int, dim: int) -> np.ndarray:
    d = np.random.default_rng(node & (1 << 64) - 1).standard_normal((_NODES, CHOICES, dim))
    return d / np.linalg.norm(d, axis=2, keepdims=True)


def best_cut(p: np.ndarray, margin: float, least: float) -> tuple[float, int]:
    """(threshold, direction) of the cut that leaves the fewest pairs; NaN where none separates. p: projections, a column a direction.

    A median inside a dense group would send the group to both sides, so places off the middle count too: beside the
    group the cut takes a part of the other vectors away, whatever the group's share. A cut that mostly copies is none.
    """
    best, out = 1.0, (np.nan, 0)
    for c, x in enumerate(np.sort(p, axis=0).T):
        at = np.unique(np.quantile(x, PLACES))
        left = np.searchsorted(x, at + margin, side="right") / len(x)
        right = 1 - np.searchsorted(x, at - margin, side="left") / len(x)
        alone = np.minimum(1 - left, 1 - right)
        good = (alone >= least) & (left + right - 1 <= OVERLAP * alone)
        work = np.where(good, left**2 + right**2, 1.0)
        i = int(np.argmin(work))
        if work[i] < best:
            best, out = work[i], (float(at[i]), c)
    return out


def fit_splits(node: int, unit: np.ndarray, n: int, leaf: int, margin: float) -> np.ndarray:
    """(threshold, choice) of each split of the node's subtree; the threshold is NaN where a vector stays."""
    out, directions = np.full((_NODES, 2), np.nan), _directions(node, unit.shape[1])
    inside, enough = {0: np.arange(len(unit))}, leaf * len(unit) / n
    for k in range(_NODES):
        rows = inside.pop(k, None)
        if rows is None or len(rows) <= max(enough, 8):
            continue
        p = unit[rows] @ directions[k].T
        at, c = best_cut(p, margin, max(ALONE, enough / 4) / len(rows))
        if not np.isnan(at):
            out[k] = at, c
            inside[2 * k + 1], inside[2 * k + 2] = rows[p[:, c] <= at + margin], rows[p[:, c] >= at - margin]
    return out


def descend(node: int, unit: np.ndarray, splits: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place within the subtree, whether the subtree's last level was reached) for each leaf that a row comes to."""
    directions, choice = _directions(node, unit.shape[1]), np.nan_to_num(splits[:, 1]).astype(int)
    rows, at = np.arange(len(unit)), np.zeros(len(unit), np.int64)
    out_r, out_at = [], []
    for _ in range(LEVELS):
        stays = np.isnan(splits[at, 0])
        out_r.append(rows[stays])
        out_at.append(at[stays])
        rows, at = rows[~stays], at[~stays]
        p = np.einsum("ij,ij->i", unit[rows], directions[at, choice[at]]) - splits[at, 0]
        left, right = p <= margin, p >= -margin
        rows, at = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * at[left] + 1, 2 * at[right] + 2])
    deep = np.repeat([False, True], [sum(map(len, out_r)), len(rows)])
    return np.concatenate([*out_r, rows]), np.concatenate([*out_at, at]), deep


def _child(node: np.ndarray, at: np.ndarray) -> np.ndarray:
    x = (node.astype(np.int64).view(np.uint64) ^ at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return np.where(at == 0, node, (x ^ x >> np.uint64(29)).view(np.int64))


_ROW = "rep long, label string, n long, v binary, node long"


def leaves(reps: DataFrame, cosine: float, trees: int, leaf: int) -> DataFrame:
    """(rep, label, n, v, node): a row for each leaf that a representative is in."""

    def margin(dim: int) -> float:
        return SPILL * np.sqrt(2 * (1 - cosine) / dim)

    def fit(key, t):
        unit, n = _unit(t.column("v").to_pylist()), t.column("size")[0].as_py()
        splits = fit_splits(key[0].as_py(), unit, n, leaf, margin(unit.shape[1]))
        return pa.table({"node": [key[0]], "n": [n], "splits": pa.array([splits.tobytes()], pa.binary())})

    def grow(batches):
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            raw, splits = batch.column("v").to_pylist(), batch.column("splits").to_pylist()
            order = np.argsort(nodes, kind="stable")
            for of in np.split(order, np.flatnonzero(np.diff(nodes[order])) + 1):
                if not len(of):
                    continue
                r, at, deep = of, np.zeros(len(of), np.int64), np.zeros(len(of), bool)
                if splits[of[0]] is not None:
                    unit = _unit([raw[i] for i in of])
                    r, at, deep = descend(int(nodes[of[0]]), unit, np.frombuffer(splits[of[0]], "<f8").reshape(-1, 2), margin(unit.shape[1]))
                    r = of[r]
                take = pa.array(r)
                columns = [batch.column(c).take(take) for c in ("rep", "label", "n", "v")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(_child(nodes[r], at)), pa.array(deep)], names=["rep", "label", "n", "v", "node", "deep"])

    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    now = cut(reps.select("rep", "label", "n", "v", tree.alias("tree")).withColumn("node", F.xxhash64(F.lit(SEED), "label", "tree")).drop("tree"))
    done = []
    while True:
        large = cut(now.groupBy("node").agg(F.count("*").alias("size")).filter(F.col("size") > leaf).withColumn("n", F.col("size")))
        if large.isEmpty():
            done.append(now)
            break
        picked = join_hot(now.drop("n"), large.select("node", "n", "size"), ["node"])
        picked = picked.filter(F.pmod(F.xxhash64("rep", F.lit("fit")), F.ceil(F.col("size") / FIT)) == 0).select("node", "size", "v")
        splits = picked.groupBy("node").applyInArrow(fit, "node long, n long, splits binary")
        grown = cut(join_hot(now, splits, ["node"], "left").mapInArrow(grow, _ROW + ", deep boolean"))
        done.append(grown.filter("not deep").drop("deep"))
        now = grown.filter("deep").drop("deep")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


# -- tiles --------------------------------------------------------------------------------------------------------------


def _owned(i: np.ndarray, j: np.ndarray, lists: np.ndarray, leaf: int) -> np.ndarray:
    """Whether `leaf` is the smallest leaf that the pair shares; lists: leaves of each row, padded with the greatest number."""
    out = np.ones(len(i), bool)
    for a in range(0, len(i), 20_000):
        x, y = lists[i[a : a + 20_000]], lists[j[a : a + 20_000]]
        same = (x[:, :, None] == y[:, None, :]) & (x < leaf)[:, :, None]
        out[a : a + 20_000] = ~same.any(axis=(1, 2))
    return out


def _tile(ids: np.ndarray, n: np.ndarray, unit: np.ndarray, chunk: np.ndarray, lists: np.ndarray, leaf: int, pair: tuple[int, int], cosine: float):
    """Links of one tile: (id, partners counted here, smallest id connected here) of each row that has any."""
    one, two = np.flatnonzero(chunk == pair[0]), np.flatnonzero(chunk == pair[1])
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    found_i, found_j = [], []
    for a in range(0, len(one), 500):
        rows = one[a : a + 500]
        r, c = np.nonzero(unit[rows] @ unit[two].T >= cosine)
        i, j = rows[r], two[c]
        if pair[0] == pair[1]:
            i, j = i[i < j], j[i < j]
        own = _owned(i, j, lists, leaf)
        np.add.at(links, i[own], n[j[own]])
        np.add.at(links, j[own], n[i[own]])
        found_i.append(i)
        found_j.append(j)
    i, j = np.concatenate(found_i or [root[:0]]), np.concatenate(found_j or [root[:0]])
    while True:  # smallest row index over chains of links; rows are sorted by id
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
    return ids[some], links[some], ids[root[some]]


def tile_links(placed: DataFrame, cosine: float, chunk: int = CHUNK) -> DataFrame:
    """(rep, links, root) rows, several for a representative; placed: a written table of leaves()."""
    lists = placed.groupBy("rep").agg(F.collect_set("node").alias("nodes"))
    tiles = tiled(placed, "node", "rep", chunk).join(lists, "rep")

    def link(key, t):
        out = []
        for label in t.column("label").unique():  # one, but for two nodes of equal number
            own = t.filter(pc.equal(t.column("label"), label)).sort_by("rep")
            raw = own.column("nodes").to_pylist()
            nodes = np.full((len(raw), max(map(len, raw))), np.iinfo(np.int64).max)
            for i, x in enumerate(raw):
                nodes[i, : len(x)] = x
            ids, n, of = (own.column(c).to_numpy() for c in ("rep", "n", "chunk"))
            leaf, lo, hi = (own.column(c)[0].as_py() for c in ("node", "lo", "hi"))
            out.append(_tile(ids, n, _unit(own.column("v").to_pylist()), of, nodes, leaf, (lo, hi), cosine))
        return pa.table({c: pa.array(np.concatenate(x), pa.int64()) for c, x in zip(("rep", "links", "root"), zip(*out))})

    return tiles.groupBy("tile").applyInArrow(link, "rep long, links long, root long")


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    trees: int = TREES,
    leaf: int = LEAF,
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""

    def found() -> DataFrame:
        columns = (F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("x"))
        every = cut(df.select(F.monotonically_increasing_id().alias("rid"), *columns))
        rows = cut(usable(every))
        reps = cut(rows.groupBy("label", "v").agg(F.min("rid").alias("rep"), F.min("id").alias("least"), F.count("*").alias("n")))
        links = cut(tile_links(cut(leaves(reps, cosine, trees, leaf)), cosine))
        roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("a", "rep")
        counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
        of_rep = reps.join(counts, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        of_rep = of_rep.join(of_rep.groupBy("root").agg(F.min("least").alias("component_id")), "root")
        of_rep = of_rep.select("label", "v", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("linked"))
        linked = join_hot(rows, of_rep, ["label", "v"]).select("rid", "n_links", "component_id", "linked")
        out = every.select("rid", "id").join(linked, "rid", "left")
        component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id")).cast("long")
        return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))

    return apart(df.sparkSession, found)


def op10_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
