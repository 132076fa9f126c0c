"""Embedding near-duplicates over a robust-pruned flat graph.

Equal vectors collapse first. A tree of centroids (groups, cells, clusters), fitted on a bounded sample, gives each vector
its `overlap` nearest clusters, which so overlap. Each cluster is a build shard: its members' nearest neighbours are pruned
robustly (a neighbour goes if another kept one is nearer to it, by the factor alpha) to a bounded degree. The adjacency
lists of a vector from all its shards are then united. Search takes the united graph a cell at a time: each vector at home
there starts at the nearest medoids (and at itself, where it is a node), expands best first, and from then on every vector
within range, until the range brings no new one. Found links are verified in double precision.

A link between vectors of two cells is found by one of the two: a vector asks in every cell that can be home to one within
the threshold (`Tree.reach`), if of the two cells its own is the one to ask. There it is compared with all vectors at home,
in blocks, which costs less than a search. So every link belongs to one task, which adds it to the number of links of both
ends; a task passes on those numbers and a spanning forest, never pairs.

Random queries are compared with all vectors by brute force; below the wanted recall, the index is built again with more
overlap and a longer search, and if that does not suffice either, vectors are compared in blocks in their own cells too.

Clusters, cells and the askers of a cell over a bound are cut into tiles by a hash: each tile of a cluster has a graph of
its own, and every tile of a cell meets every other. So no task holds an unbounded group, and copies in a third of all rows
are one vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import common as C
from ledgerline.llm.components import connected_components, forest

#: Vectors a build shard and a search cell aim at; most of a tile of either.
SHARD, CELL, SHARD_TILE, CELL_TILE = 400, 6000, 2048, 16384
#: Rows that centroids are fitted on: SAMPLE, or SAMPLE_PER_CELL for each cell up to SAMPLE_BYTES of single-precision numbers.
#: That gives a million rows of 64 numbers or cells for 750 million vectors; beyond, cells have more rows and more tiles.
SAMPLE, SAMPLE_PER_CELL, SAMPLE_BYTES = 32_000, 8, 256 << 20
#: Cells up to which there is one group of them.
GROUP = 64
DEGREE, ALPHA, CANDIDATES = 16, 1.2, 64
#: Audit queries of each draw; queries with a link that make a further draw needless.
AUDIT, AUDIT_LINKED = (500, 1000, 2000), 100


def usable(v: Column) -> Column:
    """Not null, not empty, all components finite, and not all zero."""
    return F.coalesce(
        (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision; scaled first, so that no square overflows."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def _below(x: np.ndarray, parents: np.ndarray, lists: list[np.ndarray], keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(parent, place in its list) of the `keep` nearest children of each row's parents, -1 where there are fewer. The best
    child of the first parent comes first, the others by similarity."""
    width = max(map(len, lists))
    best = np.full((len(x), parents.shape[1] * width), -9.0)
    for j in range(parents.shape[1]):
        for c in np.unique(parents[:, j]):
            rows = np.flatnonzero(parents[:, j] == c)
            if c >= 0:
                best[rows, j * width : j * width + len(lists[c])] = x[rows] @ lists[c].T
    best[np.arange(len(x)), best[:, :width].argmax(1)] = 9.0
    order = np.argsort(-best, axis=1, kind="stable")[:, :keep]
    ok = np.take_along_axis(best, order, 1) > -9
    return np.where(ok, np.take_along_axis(parents, order // width, 1), -1), np.where(ok, order % width, -1)


def _beyond(x: np.ndarray, centres: np.ndarray, sine: float) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre of each row, mask of the centres that can be the nearest of a vector within the angle of that sine).

    Such a vector is nearer to its own centre than to the row's, so the row lies at most that sine beyond the plane between
    both.
    """
    sims = x @ centres.T
    home = sims.argmax(1)
    dots = centres @ centres.T
    norms = dots.diagonal()
    apart = np.sqrt(np.maximum(0, norms[home][:, None] + norms[None] - 2 * dots[home]))
    return home, sims[np.arange(len(x)), home][:, None] - sims <= sine * apart + 1e-6


class Tree:
    """Centroids of one dimension: groups of cells, cells, and clusters in each cell."""

    def __init__(self, x: np.ndarray, n: int):
        rng = np.random.default_rng(11)
        cells = int(max(1, min(-(-n // CELL), len(x) // SAMPLE_PER_CELL or 1)))
        self.groups = _kmeans(x, 1 if cells <= GROUP else int(np.ceil(np.sqrt(cells))), rng)
        group = (x @ self.groups.T).argmax(1)
        own = [np.flatnonzero(group == i) for i in range(len(self.groups))]
        self.cells = [_kmeans(x[r], int(max(1, round(cells * len(r) / len(x)))), rng) if len(r) else self.groups[i : i + 1] for i, r in enumerate(own)]
        self.first = np.cumsum([0, *map(len, self.cells)])
        cell = np.empty(len(x), np.int64)
        for i, r in enumerate(own):
            cell[r] = self.first[i] + (x[r] @ self.cells[i].T).argmax(1)
        clusters = max(1, -(-n // int(self.first[-1]) // SHARD))
        whole = np.concatenate(self.cells)
        order = np.argsort(cell, kind="stable")
        cut = np.searchsorted(cell[order], np.arange(len(whole) + 1))
        self.clusters = [_kmeans(x[order[a:b]], clusters, rng) if b > a else whole[i : i + 1] for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]

    def assign(self, x: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
        """(cell, cluster in it) of each row's clusters, the one at home first, then nearest first; -1 where there are fewer."""
        groups = np.argsort(-(x @ self.groups.T), axis=1, kind="stable")[:, :2]
        group, place = _below(x, groups, self.cells, max(2, overlap // 2 + 1))
        return _below(x, np.where(group >= 0, self.first[group] + place, -1), self.clusters, overlap)

    def reach(self, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every cell other than the row's own that can be home to a vector with a cosine of `threshold` or
        more to the row, if of the two cells the row's is the one to ask."""
        sine = np.sqrt(1 - threshold * threshold) if 0 < threshold < 1 else float(threshold <= 0)
        rows, cells = [], []
        for lo in range(0, len(x), 1024):
            part = x[lo : lo + 1024]
            group, near = _beyond(part, self.groups, sine)
            home = np.empty(len(part), np.int64)
            found = []
            for g in range(len(self.groups)):
                own = np.flatnonzero(near[:, g])
                if len(own):
                    best, hit = _beyond(part[own], self.cells[g], sine)
                    mine = group[own] == g
                    home[own[mine]] = self.first[g] + best[mine]
                    r, c = np.nonzero(hit)
                    found.append((own[r], self.first[g] + c))
            r, c = (np.concatenate(v) for v in zip(*found, strict=True))
            asks = (c != home[r]) & ((c > home[r]) == ((c + home[r]) % 2 == 0))
            rows.append(r[asks] + lo)
            cells.append(c[asks])
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.empty(0, np.int64),) * 2


def prune(sims: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, candidates: int = CANDIDATES) -> np.ndarray:
    """Robust pruning for all nodes at once: neighbours of each by local number, -1 where there are fewer than degree."""
    n = len(sims)
    m = min(candidates, n - 1)
    out = np.full((n, degree), -1, np.int64)
    if m < 1:
        return out
    s = sims.copy()
    np.fill_diagonal(s, -np.inf)
    near = np.argpartition(-s, m - 1, axis=1)[:, :m]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
    far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, near, 1)))
    alive = np.ones((n, m), bool)
    rows = np.arange(n)
    for k in range(degree):
        pick = alive.argmax(1)  # nearest that is left
        some = alive[rows, pick]
        if not some.any():
            break
        star = near[rows, pick]
        out[some, k] = star[some]
        between = np.sqrt(np.maximum(0, 2 - 2 * sims[star[:, None], near]))
        alive &= ~((alpha * between <= far) & some[:, None])
        alive[rows[some], pick[some]] = False
    return out


class Graph:
    """The united graph of one search cell."""

    def __init__(self, x: np.ndarray, neighbours: np.ndarray, cluster: np.ndarray):
        self.x, self.near = x, neighbours  # neighbours: local numbers, -1 for none
        self.medoids = []
        for c in np.unique(cluster):
            rows = np.flatnonzero(cluster == c)
            self.medoids.append(rows[int((x[rows] @ x[rows].mean(0)).argmax())])
        self.medoids = np.array(self.medoids)

    def search(self, q: np.ndarray, reach: float, steps: int, starts: int = 4, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs seen with a similarity of `reach` or more: greedy steps, then the whole range. own: the node
        that each query is, -1 for none."""
        n = len(self.x)
        seen = np.full((len(q), n), -9.0, np.float32)
        done = np.zeros((len(q), n), bool)

        def visit(who: np.ndarray, node: np.ndarray) -> None:
            flat = np.unique((who * n + node)[node >= 0])
            flat = flat[seen.ravel()[flat] < -8]
            for lo in range(0, len(flat), 1 << 17):
                a, b = np.divmod(flat[lo : lo + (1 << 17)], n)
                seen[a, b] = np.einsum("ij,ij->i", q[a], self.x[b])

        rows = np.arange(len(q))
        first = np.argsort(-(q @ self.x[self.medoids].T), axis=1, kind="stable")[:, :starts]
        visit(np.repeat(rows, first.shape[1]), self.medoids[first.ravel()])
        if own is not None:
            visit(rows, own)
        for _ in range(steps):
            open_ = np.where(done, np.float32(-9), seen)
            pick = open_.argmax(1)
            live = open_[rows, pick] > -8
            if not live.any():
                break
            done[rows[live], pick[live]] = True
            visit(np.repeat(rows[live], self.near.shape[1]), self.near[pick[live]].ravel())
        while True:  # range expansion
            who, node = np.nonzero((seen >= reach) & ~done)
            if not len(who):
                break
            done[who, node] = True
            for lo in range(0, len(who), 1 << 15):
                w, m = who[lo : lo + (1 << 15)], node[lo : lo + (1 << 15)]
                visit(np.repeat(w, self.near.shape[1]), self.near[m].ravel())
        return np.nonzero(seen >= reach)


def _tiles(df: DataFrame, by: str, most: int, name: str) -> DataFrame:
    """df with `name`: the number of tiles of at most about `most` rows that its rows of one `by` make.

    There are as many cells as the tree has, and up to CELL / SHARD clusters in each: a bounded table, which is broadcast, so
    that no cell's rows meet in a join.
    """
    return df.join(F.broadcast(df.groupBy(by).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias(name))), by)


class Found:
    """Links among the rows of one task: the copies that each row is linked with, and a forest."""

    def __init__(self, x: np.ndarray, copies: np.ndarray, threshold: float):
        self.x, self.copies, self.threshold = x, copies, threshold
        self.n, self.tree = np.zeros(len(x), np.int64), np.arange(len(x))

    def sure(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair holds in double precision."""
        out = np.empty(len(a), bool)
        for lo in range(0, len(a), 1 << 17):
            p, q = a[lo : lo + (1 << 17)], b[lo : lo + (1 << 17)]
            out[lo : lo + len(p)] = np.einsum("ij,ij->i", self.x[p], self.x[q]) >= self.threshold
        return out & (a != b)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Count links, each of which comes once."""
        self.n += np.bincount(a, weights=self.copies[b], minlength=len(self.n)).astype(np.int64)
        self.n += np.bincount(b, weights=self.copies[a], minlength=len(self.n)).astype(np.int64)
        new = self.tree[a] != self.tree[b]
        if new.any():
            self.tree = forest(np.concatenate([np.arange(len(self.tree)), a[new]]), np.concatenate([self.tree, b[new]]), len(self.tree))

    def compare(self, asks: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first ask of a block, place in it, place in rows) of links, all compared in blocks."""
        single = self.x[rows].astype(np.float32)
        for lo in range(0, len(asks), 256):
            who, hit = np.nonzero(self.x[asks[lo : lo + 256]].astype(np.float32) @ single.T >= self.threshold - 1e-4)
            ok = self.sure(asks[lo + who], rows[hit])
            yield lo, who[ok], hit[ok]


def neighbours(distinct: DataFrame, threshold: float, n: int, overlap: int = 3, steps: int = 32, exact: bool = False) -> DataFrame:
    """(a, b, n): rows without b say that a is linked with n copies in one task, rows without n are links of a forest.

    distinct: key, vec (array<double>, usable), copies; vectors of different lengths never link. Links are those of a cosine
    of threshold or more that the graph finds, or all if `exact`.
    """
    spark = distinct.sparkSession
    most = F.array_max(F.transform("vec", F.abs))
    scaled = F.transform("vec", lambda x: x / most)
    width = distinct.agg(F.max(F.size("vec"))).first()[0] or 1
    size = max(1, min(max(SAMPLE, SAMPLE_PER_CELL * -(-n // CELL)), SAMPLE_BYTES // (4 * width)))
    rows = distinct.orderBy(F.xxhash64("key")).limit(size).select(scaled.cast("array<float>").alias("vec")).toArrow().column("vec").combine_chunks()
    sizes = np.diff(np.asarray(rows.offsets)) if len(rows) else np.empty(0, np.int64)
    trees = spark.sparkContext.broadcast({int(d): Tree(_unit(rows.filter(pa.array(sizes == d))), max(1, round(n * float((sizes == d).mean())))) for d in np.unique(sizes)})

    def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, Tree | None]]:
        """Batches (key, copies, vec) of one length; no tree for a length that the sample lacks: one cell."""
        for b in batches:
            size = np.diff(np.asarray(b.column(2).offsets))
            for d in np.unique(size):
                own = b.filter(pa.array(size == d))
                yield int(d) << 40, own, _unit(own.column(2)), trees.value.get(int(d))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, own, x, tree in by_length(batches):
            cell, cluster = tree.assign(x, overlap) if tree else (np.zeros((len(x), 1), np.int64),) * 2
            for j in range(cell.shape[1]):
                ok = np.flatnonzero(cell[:, j] >= 0)
                home = np.full(len(ok), j == 0)
                yield pa.RecordBatch.from_arrays([pa.array(base + cell[ok, j]), pa.array(base + (cell[ok, j] << 16) + cluster[ok, j]), pa.array(home), *[own.column(i).take(pa.array(ok)) for i in range(3)]], names=["cell", "cluster", "home", "key", "copies", "vec"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, own, x, tree in by_length(batches):
            row, cell = tree.reach(x, threshold) if tree else (np.empty(0, np.int64),) * 2
            for lo in range(0, len(row), 1 << 14):
                r = pa.array(row[lo : lo + (1 << 14)])
                yield pa.RecordBatch.from_arrays([pa.array(base + cell[lo : lo + (1 << 14)]), *[own.column(i).take(r) for i in range(3)]], names=["cell", "key", "copies", "vec"])

    kind = "key long, copies long, vec array<double>"
    own = distinct.select("key", "copies", "vec")
    placed = C.materialise(own.mapInArrow(assign, "cell long, cluster long, home boolean, " + kind), "placed")
    pick = F.xxhash64("cluster", "key")
    sharded = _tiles(placed, "cluster", SHARD_TILE, "shards").withColumn("shard", F.xxhash64("cluster", F.pmod(pick, F.col("shards"))))

    def build(table: pa.Table) -> pa.Table:
        keys = np.asarray(table.column("key"))
        x = _unit(table.column("vec").combine_chunks())
        near = prune(x @ x.T)
        lists = [keys[r[r >= 0]].tolist() for r in near]
        return pa.table({"key": pa.array(keys), "near": pa.array(lists, pa.list_(pa.int64()))})

    united = sharded.groupBy("shard").applyInArrow(build, "key long, near array<long>").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    # a shard stays whole in one tile of its cell
    nodes = C.materialise(_tiles(sharded, "cell", CELL_TILE, "tiles").withColumn("part", F.pmod(F.xxhash64("shard"), F.col("tiles")).cast("int")).join(united, "key"), "graph")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["part", "shard", "home", "key", "copies", "vec", "near"]
    inside = nodes.withColumn("other", each("tiles")).select("cell", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), F.lit(-1).alias("turn"), *cols)
    # askers from other cells meet the vectors at home, a tile of either at a time
    asks = _tiles(own.mapInArrow(route, "cell long, " + kind), "cell", CELL_TILE, "turns")
    parts = nodes.groupBy("cell").agg(F.first("tiles").alias("tiles"))
    askers = asks.join(F.broadcast(parts), "cell").withColumn("p", each("tiles")).select("cell", "p", F.col("p").alias("q"), F.pmod(F.xxhash64("key", F.lit(3)), F.col("turns")).cast("int").alias("turn"), F.lit(-1).alias("part"), F.lit(None).cast("long").alias("shard"), F.lit(False).alias("home"), "key", "copies", "vec", F.lit(None).cast("array<long>").alias("near"))
    turns = asks.groupBy("cell").agg(F.first("turns").alias("turns"))
    hosts = nodes.filter("home").join(F.broadcast(turns), "cell").withColumn("turn", each("turns")).select("cell", F.col("part").alias("p"), F.col("part").alias("q"), "turn", "part", "shard", "home", "key", "copies", "vec", F.lit(None).cast("array<long>").alias("near"))

    def graph(table: pa.Table, rows: np.ndarray, keys: np.ndarray, x: np.ndarray) -> tuple[Graph, np.ndarray]:
        """The united graph of one tile, and its rows, one for each key: that at home, if any."""
        home = np.asarray(table.column("home"))
        rows = rows[np.lexsort((~home[rows], keys[rows]))]
        rows = rows[np.r_[True, keys[rows][1:] != keys[rows][:-1]]]
        lists = table.column("near").take(pa.array(rows)).combine_chunks()
        size = np.diff(np.asarray(lists.offsets))
        flat = np.asarray(lists.flatten())
        at = np.minimum(np.searchsorted(keys[rows], flat), len(rows) - 1)
        near = np.full((len(rows), max(1, int(size.max(initial=0)))), -1, np.int64)
        near[np.repeat(np.arange(len(rows)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.where(keys[rows][at] == flat, at, -1)
        return Graph(x[rows].astype(np.float32), near, np.asarray(table.column("shard"))[rows]), rows

    def hits(table: pa.Table, found: Found, asks: np.ndarray, pool: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Bits of (ask, row of pool at home) for what the asks find in the graph of pool."""
        home = np.asarray(table.column("home"))
        at_home = pool[home[pool]]
        bits = np.zeros((len(asks), -(-len(at_home) // 8)), np.uint8)
        if not len(asks) or not len(at_home):
            return bits
        if exact:
            for lo, who, hit in found.compare(asks, at_home):
                block = np.zeros((min(256, len(asks) - lo), len(at_home)), bool)
                block[who, hit] = True
                bits[lo : lo + len(block)] = np.packbits(block, axis=1)
            return bits
        g, rows = graph(table, pool, keys, found.x)
        place = np.full(len(table), -1, np.int64)
        place[at_home] = np.arange(len(at_home))
        starts = 4 * max(1, -(-len(g.medoids) * SHARD // max(1, len(rows))))
        at = np.minimum(np.searchsorted(keys[rows], keys[asks]), len(rows) - 1)
        own = np.where(keys[rows][at] == keys[asks], at, -1)
        for lo in range(0, len(asks), 128):
            who, hit = g.search(found.x[asks[lo : lo + 128]].astype(np.float32), threshold - 1e-4, steps, starts, own[lo : lo + 128])
            there = place[rows[hit]]
            who, there = who[there >= 0], there[there >= 0]
            ok = found.sure(asks[lo + who], at_home[there])
            block = np.zeros((min(128, len(asks) - lo), len(at_home)), bool)
            block[who[ok], there[ok]] = True
            bits[lo : lo + len(block)] = np.packbits(block, axis=1)
        return bits

    def search(key: tuple, table: pa.Table) -> pa.Table:
        p, q, turn = (k.as_py() for k in key[1:])
        keys, part, home = np.asarray(table.column("key")), np.asarray(table.column("part")), np.asarray(table.column("home"))
        found = Found(_unit(table.column("vec").combine_chunks()), np.asarray(table.column("copies")), threshold)
        if turn >= 0:
            asks, rows = np.flatnonzero(part < 0), np.flatnonzero(part >= 0)
            for lo, who, hit in found.compare(asks, rows) if len(asks) and len(rows) else ():
                found.add(asks[lo + who], rows[hit])
        else:
            left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
            a, b = left[home[left]], right[home[right]]
            there = hits(table, found, a, right, keys)
            back = there if p == q else hits(table, found, b, left, keys)
            for lo in range(0, len(a), 256):  # a link counts if either end has found the other
                one = np.unpackbits(there[lo : lo + 256], axis=1, count=len(b)).astype(bool)
                other = np.unpackbits(back[:, lo // 8 : lo // 8 + 32], axis=1, count=len(one)).astype(bool).T if len(b) else one
                i, j = np.nonzero(one | other)
                if p == q:
                    i, j = i[lo + i < j], j[lo + i < j]
                found.add(a[lo + i], b[j])
        some, up = np.flatnonzero(found.n), np.flatnonzero(found.tree != np.arange(len(keys)))
        none = pa.nulls(len(some), pa.int64()), pa.nulls(len(up), pa.int64())
        return pa.table({"a": pa.chunked_array([pa.array(keys[some]), pa.array(keys[up])]), "b": pa.chunked_array([none[0], pa.array(keys[found.tree[up]])]), "n": pa.chunked_array([pa.array(found.n[some]), none[1]])})

    return inside.unionByName(askers).unionByName(hosts).groupBy("cell", "p", "q", "turn").applyInArrow(search, "a long, b long, n long")


def brute_degrees(distinct: DataFrame, queries: pa.Table, threshold: float) -> DataFrame:
    """(key, truth): copies that each of the queries (a bounded table of key, vec) is linked with, by comparing them with all vectors."""
    sent = distinct.sparkSession.sparkContext.broadcast([(k, v) for k, v in zip(queries.column("key").to_pylist(), queries.column("vec").to_pylist(), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        for b in batches:
            size = np.diff(np.asarray(b.column(2).offsets))
            for d in np.unique(size):
                own, mine = b.filter(pa.array(size == d)), [(k, v) for k, v in sent.value if len(v) == d]
                if mine:
                    keys, copies, ask = np.asarray(own.column(0)), np.asarray(own.column(1)), np.array([k for k, _ in mine])
                    hit = _unit(own.column(2)) @ _unit(pa.array([v for _, v in mine], pa.list_(pa.float64()))).T >= threshold
                    for k, x in zip(ask.tolist(), ((hit & (keys[:, None] != ask)) * copies[:, None]).sum(0).tolist(), strict=True):
                        n[k] = n.get(k, 0) + x
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["key", "n"])

    return distinct.select("key", "copies", "vec").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("truth"))


def audit_of(distinct: DataFrame, threshold: float) -> dict[int, int]:
    """Of random queries, the copies that each is linked with, where that is any; more are drawn until AUDIT_LINKED have some
    or the draws are used up."""
    truth: dict[int, int] = {}
    for k, n in enumerate(AUDIT):
        asked = distinct.orderBy(F.xxhash64("key", F.lit(k + 1))).limit(n).select("key", "vec").toArrow()
        truth |= {key: n for key, n in brute_degrees(distinct, asked, threshold).collect() if n}
        if len(truth) >= AUDIT_LINKED:
            break
    return truth


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, recall: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, audited_recall, audited_links.

    Null, empty and zero vectors and those with null or non-finite components link with nothing: their component is
    themselves. Repeated rows count as vectors of their own. A null id is never kept and names no component.
    audited_recall, the same for all rows, is the mean share of its links between different vectors that the index found
    for a query of the audit that has any, null if none has; audited_links is the number of those links.
    """
    v = F.col(f"`{vec_col}`").cast("array<double>")
    base = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.when(usable(v), v).alias("vec"))
    copies = base.filter("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    distinct = C.materialise(copies.withColumn("key", F.monotonically_increasing_id()), "vectors")
    n, total = distinct.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    truth = audit_of(distinct, threshold)
    asked = rows.sparkSession.createDataFrame(list(truth.items()), "key long, truth long")
    overlap, steps, share = 3, 32, None
    for attempt in range(4):
        found = C.materialise(neighbours(distinct, threshold, n, overlap, steps, exact=attempt == 3), "links")
        degree = found.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("near"))
        if not truth:
            break
        share = F.broadcast(asked).join(degree, "key", "left").agg(F.avg(F.coalesce("near", F.lit(0)) / F.col("truth"))).first()[0]
        if share >= recall:
            break
        overlap, steps = overlap + 2, steps * 2
    roots = connected_components(found.filter("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "key")
    told = distinct.join(degree, "key", "left").join(roots, "key", "left").select("vec", "first", "copies", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root"))
    least = told.groupBy("root").agg(F.min("first").alias("component_id"))
    full = told.join(least, "root").select("vec", "copies", "n_links", "component_id")
    return C.join_hot(base, full, ["vec"], total).select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("vec").isNull() & F.col("vec_id").isNotNull() | (F.col("vec_id") == F.col("component_id")), F.lit(False)).alias("kept"),
        F.lit(share).cast("double").alias("audited_recall"),
        F.lit(sum(truth.values())).cast("long").alias("audited_links"),
    )
