"""Variable-capacity best-fit packing.

Documents are cut into pieces of at most the largest permitted length. Pieces are dealt by a hash to shards of bounded
size; each shard packs its own pieces, longest first, each into the open bin with the least room that still takes it.
When none does, a bin is opened: of all permitted sizes that hold the piece, the one that costs least for each token that
it can be filled with from what is still to be packed. A size costs its length, an overhead, and the square of its length
by ATTENTION, so a long bin must be worth its price. At the end each bin shrinks to the smallest permitted size that holds
its contents. The same is done with every smaller choice of one size to open, and the cheapest packing of a shard counts,
so mixing sizes never costs more than the best single one. Only lengths travel, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import common as C

SIZES = (512, 1024, 2048, 4096)
#: Tokens that a bin costs beside its size: each is a row with an overhead of its own. At this length, work that grows with
#: the square of the length costs as much as work that grows with the length.
OVERHEAD, ATTENTION = 16, 8192
SHARD_PIECES = 100_000


def cost_of(size: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    """What a bin of that size costs, in tokens."""
    return overhead + size + size * size / attention


def _fill(room: int, left: np.ndarray, mask: int) -> int:
    """Tokens of the remaining lengths that go into room, longest first. mask: bit n is set if some piece of length n is left."""
    done = 0
    mask &= (2 << room) - 1
    while mask and room:
        n = mask.bit_length() - 1
        k = min(int(left[n]), room // n)
        done, room = done + k * n, room - k * n
        mask &= (2 << min(room, n - 1)) - 1
    return done


def pack_lengths(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, costs: dict[int, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it, bin's size) of each length; lengths are 1 to max(sizes). Equal lengths keep their order.

    costs: by size, default cost_of. The cheapest of opening any size by its cost for what it can carry, or always one size
    (a larger one only for pieces that need it).
    """
    sizes = tuple(sorted(sizes))
    costs = costs or {c: cost_of(c) for c in sizes}
    best, least = None, None
    for only in (None, *sizes):
        found = _pack(lengths, sizes, costs, only)
        ends = np.unique(found[0], return_index=True)[1]
        price = sum(costs[c] for c in found[2][ends].tolist())
        if least is None or price < least:
            best, least = found, price
    return best


def _pack(lengths: np.ndarray, sizes: tuple[int, ...], costs: dict[int, float], only: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    largest = sizes[-1]
    n = len(lengths)
    bin_of, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    left = np.bincount(lengths, minlength=largest + 1)
    some = sum(1 << k for k in np.flatnonzero(left).tolist())  # bit k: a piece of length k is left
    room: list[int] = []  # of each bin
    used: list[int] = []
    open_by_room: list[list[int]] = [[] for _ in range(largest + 1)]
    mask = 0  # bit r: some bin has room r
    for i in order.tolist():
        size = int(lengths[i])
        left[size] -= 1
        if not left[size]:
            some ^= 1 << size
        above = mask >> size
        if above:
            r = size + (above & -above).bit_length() - 1
            b = open_by_room[r].pop()
            if not open_by_room[r]:
                mask ^= 1 << r
        else:
            fits = [c for c in sizes if c >= size]
            c = min(fits, key=lambda c: costs[c] / (size + _fill(c - size, left, some))) if only is None else max(only, fits[0])
            b, r = len(room), c
            room.append(c)
            used.append(0)
        bin_of[i], offset[i] = b, used[b]
        used[b] += size
        over = r - size
        room[b] = over
        if over:
            if not open_by_room[over]:
                mask |= 1 << over
            open_by_room[over].append(b)
    grid = np.array(sizes)
    final = grid[np.searchsorted(grid, np.array(used, np.int64))] if used else np.empty(0, np.int64)
    return bin_of, offset, final[bin_of] if n else np.empty(0, np.int64)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", sizes: tuple[int, ...] = SIZES, costs: dict[int, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bin_id, bin_size, bin_offset.

    start: the piece's first token in its document. bin_id is unique over all shards. Null, zero and negative lengths
    make one piece of length 0, bin_id null. Repeated rows are packed each for itself. Pieces are numbered as they are
    stored and dealt by number, so that no id, null included, fills a shard; ties in a shard are broken by id.
    """
    largest = max(sizes)
    length = F.greatest(F.coalesce(F.col(f"`{length_col}`").cast("long"), F.lit(0)), F.lit(0))
    cut = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), length.alias("n")).select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0)))).alias("piece"))
    pieces = cut.select("doc_id", F.col("piece").cast("long").alias("piece"), (F.col("piece") * largest).cast("long").alias("start"), F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).cast("long").alias("n_tokens"))
    n = C.materialise(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-n.count() // SHARD_PIECES))
    spread = n.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards))).drop("number")

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("n_tokens", "ascending")]).combine_chunks()
        lengths = np.asarray(t.column("n_tokens")).astype(np.int64)
        some = lengths > 0
        bins, offsets, caps = (np.zeros(len(lengths), np.int64) for _ in range(3))
        bins[some], offsets[some], caps[some] = pack_lengths(lengths[some], sizes, costs)
        bins += int(key[0].as_py()) << 32
        none = pa.array(~some)
        out = t.select(["doc_id", "piece", "start", "n_tokens"])
        for name, x in (("bin_id", bins), ("bin_size", caps), ("bin_offset", offsets)):
            out = out.append_column(name, pa.chunked_array([pa.array(x, mask=np.asarray(none))]))
        yield from out.combine_chunks().to_batches()

    return spread.groupBy("shard").applyInArrow(run, "doc_id long, piece long, start long, n_tokens long, bin_id long, bin_size long, bin_offset long")


def count_words(text_col: str):
    """Tokens of a text as white-space words and one end; native. Null texts have the end alone."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return (F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")
