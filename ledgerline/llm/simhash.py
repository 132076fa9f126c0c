"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has one bit per position that over half of a text's shingle hashes set. Two fingerprints link at
`distance` or fewer differing bits. Candidates come from chains on a ring of `distance + 1` segments: some segment of a
linked pair agrees exactly and, going round from one such segment, every prefix of l segments differs in at most
floor(l * distance / segments) bits (pigeonring principle). Two segments of the chain are the lookup key (the first
exact, the second with at most one flipped bit); longer chains are tested before the full Hamming distance.

Equal fingerprints collapse first, so a group of copies is one row here. Keys of one segment that hold more than TILE
fingerprints are divided by the second segment, where each fingerprint also asks at its one-bit changes; what is still
larger is cut into tiles that meet pairwise. A task keeps a spanning forest of the links it finds, never the pairs.

`similar_classes` links by a similarity of shingle sets instead of a number of bits. Its fingerprints are PARTS times as
wide; at 0.8 two of them differ in about 15 of 100 bits, too many for a key that must agree in nearly all segments, so
the chain is only required to start well: a segment that agrees, two with at most one, three with at most two bits.
By the pigeonring principle every pair that differs in fewer bits than there are segments has such a chain, and of the
pairs at 0.8 more than 99 in 100 have one. Pairs within `limit` bits form loose groups; the texts of a group then meet in
bounded tiles, where the sets themselves decide. So links are exact, and what a group passes on is a forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import common as C
from ledgerline.llm.components import connected_components, forest
from ledgerline.llm.substrings import _mix, _roll

WIDTH = 64
#: Most fingerprints of one side of a comparison.
TILE = 4096
#: 64-bit parts of a wide fingerprint, bits of a segment of its ring, segments of a chain that are looked at, and most wide
#: fingerprints of one side of a comparison.
PARTS, SEGMENT, CHAIN, WIDE_TILE = 6, 8, 3, 1 << 16
#: Most texts, and about the most bytes of them, of one side of a comparison of sets.
SET_TILE, SET_BYTES = 2048, 16 << 20
_PART_SEED = np.random.default_rng(17).integers(0, 1 << 63, 64).astype(np.uint64)
_ROLL_BASE = np.uint64(0x9E3779B97F4A7C17)


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one text. No words: 0; fewer words than a shingle: the whole sequence is the one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n - shingle + 1)
    return int(np.packbits(_votes(hashes, np.zeros(1, np.int64))[0] * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _votes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of each run of hashes, which begin at `starts`, set each bit. Bytes count up to 255 rows at once."""
    out = np.zeros((len(starts), WIDTH), np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        first, last = int(np.searchsorted(starts, at, "right")) - 1, int(np.searchsorted(starts, at + len(part), "left"))
        own = np.r_[max(0, starts[first] - at), starts[first + 1 : last] - at]
        size = np.diff(own, append=len(part))
        runs = -(-size // 255)
        cuts = np.repeat(own, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
        lanes = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64).reshape(-1, WIDTH // 8)
        few = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(-1, WIDTH).astype(np.int64)
        out[first:last] += np.add.reduceat(few, np.cumsum(runs) - runs, axis=0)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 4, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) plus simhash, the fingerprint as a signed long. A null text counts as empty."""

    def run(texts: list) -> dict:
        return {"simhash": pa.array(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))}

    return C.append(docs, text_col, run, T.StructType([T.StructField("simhash", T.LongType())]), keep)


@dataclass
class Ring:
    """Segments (part, shift, width) in ring order, the most differing bits of a chain's first 1, 2, ... segments, and of
    all parts (None where the longest chain is the whole ring)."""

    segments: list[tuple[int, int, int]]
    budgets: list[int]
    limit: int | None = None
    parts: int = 1
    ratio: float = 1.0

    def value(self, x: np.ndarray, i: int) -> np.ndarray:
        part, shift, width = self.segments[i % len(self.segments)]
        return (x[:, part] >> np.uint64(shift)) & np.uint64((1 << width) - 1)

    def near(self, x: np.ndarray, y: np.ndarray, first: int) -> np.ndarray:
        """Positions of pairs whose chain from segment `first` stays within budget for every length, and within the limit."""
        alive, total = np.arange(len(x)), np.zeros(len(x), np.int64)
        for length, most in enumerate(self.budgets):
            total = total + np.bitwise_count(self.value(x[alive], first + length) ^ self.value(y[alive], first + length))
            ok = total <= most
            alive, total = alive[ok], total[ok]
        return alive[self.within(x[alive], y[alive])]

    def within(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.ones(len(x), bool) if self.limit is None else np.bitwise_count(x ^ y).sum(1) <= self.limit


def narrow_ring(distance: int) -> Ring:
    """distance + 1 nearly equal segments of 64 bits; a chain's budget is its share of distance, rounded down."""
    m = distance + 1
    cuts = [round(i * WIDTH / m) for i in range(m + 1)]
    return Ring([(0, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)], [length * distance // m for length in range(1, m + 1)])


def wide_ring(similarity: float, parts: int = PARTS) -> Ring:
    """For sets of that Jaccard similarity: bits differ with the chance of the angle between the sets; four deviations more."""
    bits = WIDTH * parts
    chance = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity)))) / np.pi
    limit = int(np.ceil(bits * chance + 4 * np.sqrt(bits * chance * (1 - chance))))
    return Ring([(p, s, SEGMENT) for p in range(parts) for s in range(0, WIDTH, SEGMENT)], list(range(CHAIN)), limit, parts, similarity)


def _links(a: np.ndarray, b: np.ndarray | None, first: int, ring: Ring, size: np.ndarray | None = None) -> np.ndarray:
    """Links of a with b, or within a, as pairs of row numbers (b's after a's): a spanning forest. All agree in segment `first`.
    size: of the sets of both; only pairs of which the smaller is ring.ratio of the larger or more are looked at.

    All are compared with a few of their own first, which settles a large group of near copies; only those that
    then aren't in the largest component ask further, each among all.
    """
    everything = a if b is None else np.concatenate([a, b])
    side = np.zeros(len(everything), bool)
    side[len(a) :] = True
    tree = np.arange(len(everything))
    size = np.zeros(len(everything), np.int64) if size is None else size.astype(np.int64)
    least, most = np.floor(size * ring.ratio).astype(np.int64), np.ceil(size / ring.ratio).astype(np.int64)

    def settle(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal tree
        if len(i):
            tree = forest(np.concatenate([np.arange(len(tree)), i]), np.concatenate([tree, j]), len(tree))

    for _ in range(3 if len(everything) > 64 else 0):
        largest = np.bincount(tree).argmax()
        for k in {0, int(np.flatnonzero(tree == largest)[-1]), len(a) - 1}:
            other = np.flatnonzero((tree != tree[k]) & (size >= least[k]) & (size <= most[k]) & ((side != side[k]) if b is not None else True))
            settle(np.full(len(other), k)[(ok := ring.near(everything[other], np.broadcast_to(everything[k], (len(other), everything.shape[1])), first))], other[ok])
    ask = np.flatnonzero(tree != np.bincount(tree).argmax())
    second = ring.value(everything, first + 1).astype(np.int64)
    width = ring.segments[(first + 1) % len(ring.segments)][2]
    flips = [0, *(1 << k for k in range(width))] if len(ring.budgets) > 1 and ring.budgets[1] >= 1 else [0]
    for asks, pool in [(ask, np.arange(len(everything)))] if b is None else [(ask[~side[ask]], np.flatnonzero(side)), (ask[side[ask]], np.flatnonzero(~side))]:
        place = second << 40 | size  # by second segment, then by size
        pool = pool[np.argsort(place[pool], kind="stable")]
        keys = place[pool]
        for flip in flips:
            near = (second[asks] ^ flip) << 40
            lo, hi = np.searchsorted(keys, near | least[asks], "left"), np.searchsorted(keys, near | most[asks], "right")
            many = hi - lo
            at, ends = 0, np.cumsum(many)
            while at < len(asks):  # bounded runs of candidates
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
                n = many[at:stop]
                i = np.repeat(asks[at:stop], n)
                j = pool[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:stop], n)]
                differ = tree[i] != tree[j]  # links inside a known component add nothing
                i, j = i[differ], j[differ]
                ok = ring.near(everything[i], everything[j], first)
                settle(i[ok], j[ok])
                at = stop
    used = np.flatnonzero(tree != np.arange(len(tree)))
    return np.stack([used, tree[used]])


def link_forest(prints: DataFrame, ring: Ring, node: str = "simhash", parts: list[str] | None = None, size: str | None = None, tile: int | None = None, rows_bytes: int = 0) -> DataFrame:
    """(src, dst) links that connect exactly the nodes joined by chains of links within the ring's budgets and limit.

    prints: a node (long) for each distinct fingerprint, and its parts as long columns; without `parts` the node is its own
    only part. size: a column with the sizes of the sets, by which pairs are cut down. rows_bytes: about what is dealt, which
    the number of tasks follows. Complete for narrow rings: by the
    pigeonring principle no linked pair lacks a chain.
    """
    tile = tile or TILE
    cols = [f"fp{i}" for i in range(ring.parts)] + ["size"] * bool(size) if parts else []
    part = lambda p: F.col(f"fp{p}") if parts else F.col("node")
    value = lambda p, s, w: F.shiftrightunsigned(part(p), s).bitwiseAND(F.lit((1 << w) - 1)).cast("int")
    own = prints.select(F.col(node).alias("node"), *[F.col(c).alias(n) for n, c in zip(cols, [*(parts or []), size], strict=False)])
    m = len(ring.segments)
    rows = own.select("node", *cols, F.posexplode(F.array(*[value(*x) for x in ring.segments])).alias("seg", "key"))
    # a row for each value of each segment at most: a bounded table
    sizes = F.broadcast(rows.groupBy("seg", "key").agg(F.count("*").alias("n")).filter(F.col("n") > 1))
    sized = rows.join(sizes, ["seg", "key"])
    whole = sized.filter(F.col("n") <= tile).select("seg", "key", F.lit(-1).alias("sub"), F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("tile"), "node", *cols)
    # a hot key is divided by the next segment of the chain: a row keeps its value there, and asks at each one-bit change
    after = F.element_at(F.array(*[value(*ring.segments[(i + 1) % m]) for i in range(m)]), F.col("seg") + 1)
    width = max(w for _, _, w in ring.segments)
    asks = [1 << k for k in range(width)] if len(ring.budgets) > 1 and ring.budgets[1] >= 1 else []
    places = F.array(*[F.struct(after.bitwiseXOR(F.lit(x)).alias("sub"), F.lit(int(x > 0)).alias("asks")) for x in [0, *asks]])
    divided = sized.filter(F.col("n") > tile).select("seg", "key", "node", *cols, F.explode(places).alias("x")).select("seg", "key", "node", *cols, "x.*")
    tiles = lambda n: F.ceil(F.col(n) / F.lit(tile)).cast("int")
    groups = divided.groupBy("seg", "key", "sub").agg(F.count_if(F.col("asks") == 0).alias("n_own"), F.count_if(F.col("asks") == 1).alias("n_asks")).filter("n_own > 0 and n_own + n_asks > 1")
    groups = groups.select("seg", "key", "sub", tiles("n_own").alias("own"), tiles("n_asks").alias("askers"))
    pick = F.xxhash64("node", F.lit(7))
    dealt = (
        divided.join(groups, ["seg", "key", "sub"])
        .withColumn("tile", F.when(F.col("asks") == 0, F.pmod(pick, F.col("own"))).otherwise(F.col("own") + F.pmod(pick, F.greatest("askers", F.lit(1)))).cast("int"))
        # an own tile meets itself and every other, a tile of askers every own one: a row is sent once to each such pair
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("asks") == 0, F.col("own") + F.col("askers")).otherwise(F.col("own")) - 1)))
        .select("seg", "key", "sub", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "node", *cols)
        .unionByName(whole)
    )

    def solve(key: tuple, held: list[pa.RecordBatch]) -> np.ndarray:
        seg, _, _, p, q = key
        node = np.concatenate([np.asarray(h.column(6)) for h in held])
        fp = np.stack([np.concatenate([np.asarray(h.column(c)) for h in held]).view(np.uint64) for c in (range(7, 7 + ring.parts) if cols else [6])], axis=1)
        sizes = np.concatenate([np.asarray(h.column(7 + ring.parts)) for h in held]) if size else None
        if p == q:
            return node[_links(fp, None, seg, ring, sizes)]
        tile = np.concatenate([np.asarray(h.column(5)) for h in held])
        left, right = np.flatnonzero(tile == p), np.flatnonzero(tile == q)
        if not len(left) or not len(right):
            return np.empty((2, 0), np.int64)
        return np.concatenate([node[left], node[right]])[_links(fp[left], fp[right], seg, ring, None if sizes is None else sizes[np.concatenate([left, right])])]

    by = ["seg", "key", "sub", "p", "q"]
    return dealt.repartition(C.parts(prints.sparkSession, rows_bytes), *by).sortWithinPartitions(*by).mapInArrow(lambda batches: _by_key(batches, 5, solve), "src long, dst long")


def _by_key(batches: Iterator[pa.RecordBatch], width: int, solve) -> Iterator[pa.RecordBatch]:
    """solve(key, batches) for the rows of each key; rows arrive sorted by their first `width` integer columns."""

    def batch(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["src", "dst"])

    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        k = np.stack([np.asarray(b.column(i)) for i in range(width)])
        cuts = [0, *(np.flatnonzero((np.diff(k, axis=1) != 0).any(0)) + 1).tolist(), b.num_rows]
        out = []
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e == s:
                continue
            now = tuple(k[:, s].tolist())
            if last is not None and now != last:
                out.append(solve(last, held))
                held = []
            held.append(b.slice(s, e - s))
            last = now
        yield batch(out)
    if last is not None:
        yield batch([solve(last, held)])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: id, simhash (long), component_id: the smallest id reachable over links, its own included.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows each give a row. A null id has a
    class too, named by the smallest non-null id of its component, if any. Extra columns don't matter.
    """
    prints = C.materialise(fingerprints(docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`")), text_col, shingle, seed, [id_col]), "simhash")
    distinct = C.materialise(prints.groupBy("simhash").agg(F.min(id_col).alias("first"), F.count("*").alias("copies")), "simhash-distinct")
    total = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    roots = connected_components(C.materialise(link_forest(distinct.select("simhash"), narrow_ring(distance), rows_bytes=32 * (distance + 1) * total), "simhash-links"))
    grouped = distinct.join(roots.withColumnRenamed("node", "simhash"), "simhash", "left").select("simhash", "first", "copies", F.coalesce("root", "simhash").alias("root"))
    named = grouped.join(grouped.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("simhash", "copies", "component_id")
    return C.join_hot(prints, named, ["simhash"], total).select(id_col, "simhash", "component_id")


def shingle_sets(texts: list[bytes | None], shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, size of each text's set): distinct 64-bit hashes of each text's runs of `shingle` lower-cased words, sorted
    in each text. Fewer words than a shingle are one run, no words none."""
    ids, words, n = C.word_ids([(t or b"").lower() for t in texts], bytes.split)
    x = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[ids]
    begin = np.cumsum(n) - n
    text = np.repeat(np.arange(len(n)), n)
    k = max(0, len(x) - shingle + 1)
    fits = np.flatnonzero(text[:k] == text[shingle - 1 :]) if k else np.empty(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < shingle))
    whole = np.array([xxhash.xxh3_64_intdigest(x[begin[i] : begin[i] + n[i]].tobytes()) for i in short.tolist()], np.uint64)
    h = np.concatenate([_mix(_roll(x, _ROLL_BASE, shingle)[fits]) if len(fits) else np.empty(0, np.uint64), whole])
    text = np.concatenate([text[fits], short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])] if len(h) else np.empty(0, bool)
    return h[new], np.bincount(text[new], minlength=len(n))


def wide_fingerprints(hashes: np.ndarray, sizes: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """A row of `parts` 64-bit numbers for each set: a bit is 1 if over half of the set's hashes, mixed anew for each part, set it."""
    out = np.zeros((len(sizes), parts), np.uint64)
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    for p in range(parts if len(some) else 0):
        votes = _votes(_mix(hashes ^ _PART_SEED[p]), starts)
        out[some, p] = np.packbits(votes * 2 > sizes[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _same_sets(x: list, y: list | None, seen: np.ndarray, shingle: int, similarity: float) -> np.ndarray:
    """Pairs of row numbers (y's after x's) that connect exactly the texts joined by links within x, or of x with y.

    seen: fingerprints of both. Each text not yet in the others' component is compared with all of those at once.
    """
    ring = wide_ring(similarity, seen.shape[1])
    h, size = shingle_sets([*x, *(y or [])], shingle)
    _, term = np.unique(h, return_inverse=True)
    begin = np.cumsum(size) - size
    mark = np.zeros(int(term.max(initial=-1)) + 1, bool)
    tree = np.arange(len(size))
    ends = np.r_[0, np.cumsum(size)]
    for i in range(len(x)):
        j = np.arange(len(x), len(size)) if y is not None else np.arange(i + 1, len(size))
        j = j[(tree[j] != tree[i]) & (np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]) - 1e-9)]
        j = j[ring.within(seen[j], np.broadcast_to(seen[i], (len(j), seen.shape[1])))]
        if not len(j) or not size[i]:
            continue
        own = term[begin[i] : ends[i + 1]]
        mark[own] = True
        n = size[j]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[j], n)
        common = np.add.reduceat(mark[term[at]].astype(np.int64), np.cumsum(n) - n)
        mark[own] = False
        hit = j[common >= similarity * (n + size[i] - common) - 1e-9]
        if len(hit):
            tree = forest(np.concatenate([np.arange(len(tree)), np.full(len(hit), i)]), np.concatenate([tree, hit]), len(tree))
    used = np.flatnonzero(tree != np.arange(len(tree)))
    return np.stack([used, tree[used]])


def _similar(docs: DataFrame, id_col: str, text_col: str, keep: list[str], shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): stored rows with `keep`, __id, __row and __node; for each distinct set of shingles its __node, __root,
    the number of its rows as `copies`, and `least`, the first of them as a struct by id."""
    fps = [f"__fp{i}" for i in range(PARTS)]
    made = T.StructType([T.StructField("__node", T.LongType()), T.StructField("__bytes", T.LongType()), T.StructField("__size", T.LongType()), *[T.StructField(c, T.LongType()) for c in fps]])

    def run(texts: list) -> dict:
        h, size = shingle_sets(texts, shingle)
        fp, end = wide_fingerprints(h, size), np.cumsum(size)
        node = np.array([xxhash.xxh3_64_intdigest(h[e - n : e].tobytes()) for e, n in zip(end.tolist(), size.tolist(), strict=True)], np.uint64)
        return {"__node": pa.array(node.view(np.int64)), "__bytes": pa.array([len(t or b"") for t in texts], pa.int64()), "__size": pa.array(size, pa.int64())} | {c: pa.array(fp[:, i].copy().view(np.int64)) for i, c in enumerate(fps)}

    held = text_col in keep  # then the text is stored already
    text = text_col if held else "__words"
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{id_col}`").cast("long").alias("__id"), F.monotonically_increasing_id().alias("__row"), *([] if held else [F.col(f"`{text_col}`").cast("string").alias(text)]))
    rows = C.materialise(C.append(src, text, run, made, src.columns), "wide-simhash")  # stored, so that row numbers stay
    distinct = C.materialise(rows.groupBy("__node").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__row")).alias("least"), F.min("__bytes").alias("__bytes"), F.first("__size").alias("__size"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in fps]), "wide-distinct")
    ring = wide_ring(similarity)
    n, total = distinct.agg(F.count("*"), F.coalesce(F.sum("__bytes"), F.lit(0))).first()
    loose = connected_components(C.materialise(link_forest(distinct, ring, "__node", fps, "__size", WIDE_TILE, len(ring.segments) * 8 * (PARTS + 4) * n), "wide-links"))
    members = distinct.select(F.col("__node").alias("node"), F.col("least.__row").alias("__row"), "__bytes", *fps).join(loose, "node")
    tiles = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / F.lit(SET_TILE), F.sum("__bytes") / F.lit(SET_BYTES))).cast("int").alias("tiles"))
    placed = members.join(tiles, "root").select("__row", "node", "root", "tiles", F.pmod(F.xxhash64("node", F.lit(5)), F.col("tiles")).cast("int").alias("tile"), *fps)
    # one text stands for all that share its set, found by its row number: no group of copies meets in a join
    texts = rows.select("__row", F.col(f"`{text}`").cast("string").cast("binary").alias("text")).join(C.materialise(placed, "loose"), "__row")
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("root", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "node", *fps, "text")

    def solve(key: tuple, held: list[pa.RecordBatch]) -> np.ndarray:
        _, p, q = key
        t = pa.Table.from_batches(held)
        node, tile = np.asarray(t.column("node")), np.asarray(t.column("tile"))
        seen = np.stack([np.asarray(t.column(c)).astype(np.int64).view(np.uint64) for c in fps], axis=1)
        text = t.column("text").to_pylist()
        left, right = np.flatnonzero(tile == p), np.flatnonzero(tile == q) if q != p else np.empty(0, np.int64)
        both = np.concatenate([left, right])
        return node[both][_same_sets([text[i] for i in left], [text[i] for i in right] if q != p else None, seen[both], shingle, similarity)]

    by = ["root", "p", "q"]
    links = dealt.repartition(C.parts(docs.sparkSession, total), *by).sortWithinPartitions(*by).mapInArrow(lambda batches: _by_key((y for x in batches for y in C.slices(x, 2 << 20)), 3, solve), "src long, dst long")
    roots = connected_components(C.materialise(links, "similar-links"))
    return rows, distinct.join(roots.select(F.col("node").alias("__node"), "root"), "__node", "left").select("__node", "least", "copies", F.coalesce("root", "__node").alias("__root"))


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: id, component_id: the smallest id reachable over links, its own included.

    Two texts link if the Jaccard similarity of their sets of `shingle`-word runs (A-Z lower-cased) is `similarity` or more.
    Null and texts without words are copies of each other. Repeated rows each give a row. A null id has a class too, named
    by the smallest non-null id. Extra columns don't matter.
    """
    rows, sets = _similar(docs, id_col, text_col, [], shingle, similarity)
    named = sets.join(sets.groupBy("__root").agg(F.min("least").alias("first")), "__root").select("__node", "copies", F.col("first.__id").alias("component_id"))
    total = sets.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    return C.join_hot(rows.select(F.col("__id").alias(id_col), "__node"), named, ["__node"], total).select(id_col, "component_id")


def one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the near copies: of each class (see similar_classes) the row with the smallest id stays, of several such
    rows one. Null ids come last. Rows are told apart by place, not by id, so a repeated id loses no other text."""
    rows, sets = _similar(docs, id_col, text_col, docs.columns, shingle, similarity)
    stay = sets.groupBy("__root").agg(F.min("least").alias("first")).select(F.col("first.__row").alias("__row"))
    # a stored list has a known size: the last join broadcasts it where it is small, and else doesn't
    go = C.materialise(rows.select("__row").join(stay, "__row", "left_anti"), "copies")
    return rows.join(go, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
