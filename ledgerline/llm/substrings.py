"""Substring dedup with a count-min prefilter and an exact second pass.

A window is `window` consecutive words of one document. Every word covered by a window whose word sequence also starts
earlier (smaller id, or the same id and an earlier start) goes. Windows are judged on the input.

Documents are dealt to blocks (a hash of id and text) and packed; a run of blocks is one task's work, taken a block at a
time. Three exchanges of packed arrays follow, each keyed by a hash, so that nothing is gathered on the driver or broadcast.
A run sends one message to each slice of the sketch and each bucket of windows; blocks in a run, slices and buckets grow
with the square root of the corpus, so that messages grow with the corpus:

1. Each block builds its partition sketch: the cells of a count-min sketch that its distinct windows fall in, once or
   more often, per row of the sketch. Slices of the sketch merge all blocks' counts; a block gets one bit for each cell
   it asked about: is the merged count, an overestimate, two or more?
2. Windows estimated repeated in every row are grouped exactly, by 96 bits of two independent fingerprints of their
   words. A block sends only its first occurrence of a window, so that a passage in a third of all documents costs one
   entry a block. It gets back which of these aren't the first of all.
3. Each block removes the words covered by later occurrences.

The estimate is never too low, so no repeated window is lost; the sketch's width follows the number of windows, which
keeps false candidates to a few hundredths. These only cost time: step 2 is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import common as C

BLOCK_BYTES = 4 << 20
#: Least cells of one slice of one row of the sketch.
SLICE = 1 << 22
ROWS = 2
#: Odd multipliers of the two rolling fingerprints; 3 modulo 4, so that differences of powers keep most bits.
BASES = (np.uint64(0x9E3779B97F4A7C17), np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _roll(h: np.ndarray, base: np.uint64, window: int) -> np.ndarray:
    """Sum over j < window of h[i + j] * base ** j modulo 2 ** 64, for each i, by doubling."""
    have, size, power = None, 0, np.uint64(1)
    part, n, p = h, 1, base
    rest = window
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                have = part.copy() if have is None else have[: max(0, len(h) - size - n + 1)] + power * part[size : size + max(0, len(h) - size - n + 1)]
                size, power = size + n, power * p
            rest >>= 1
            if rest:
                k = max(0, len(h) - 2 * n + 1)
                part, n, p = part[:k] + p * part[n : n + k], 2 * n, p * p
    return have


class Block:
    """The words and windows of one block's documents, the same in every pass."""

    def __init__(self, docs: pa.Table, window: int, part: int = SLICE):
        self.docs, self.window, self.part = docs, window, part
        self.texts = docs.column("__text").to_pylist()
        ids, self.words, self.n = C.word_ids(self.texts, bytes.split)
        self.ids = ids
        self.start = np.cumsum(self.n) - self.n
        digest = xxhash.xxh3_128_digest
        both = np.frombuffer(b"".join(map(digest, self.words)), "<u8").reshape(-1, 2).astype(np.uint64)
        # first word of each window inside a document
        own = np.repeat(np.arange(len(self.n)), self.n)
        k = max(0, len(ids) - window + 1)
        fits = own[:k] == own[window - 1 :] if k else np.empty(0, bool)
        self.at = np.flatnonzero(fits)
        self.doc = own[self.at]
        if k and len(both):
            self.h = tuple(_mix(_roll(both[ids, i], BASES[i], window)[self.at]) for i in (0, 1))
        else:
            self.h = (np.empty(0, np.uint64), np.empty(0, np.uint64))
        # the first occurrence in this block of each distinct window, by (id, start); that is their order unless ids repeat
        idv = self.ids_of_docs()
        rel = self.at - self.start[self.doc]
        order = np.argsort(self.h[0], kind="stable") if (np.diff(idv) != 0).all() else None
        if order is None or self._mixed(order):
            order = np.lexsort((rel, idv[self.doc], self.h[1], self.h[0]))
        a, b = self.h[0][order], self.h[1][order]
        head = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(order) else np.empty(0, bool)
        self.first = order[head]
        self.times = np.diff(np.r_[np.flatnonzero(head), len(order)]) if len(order) else np.empty(0, np.int64)
        lead = np.repeat(self.first, self.times)
        self.later = order[~head]  # those that aren't
        # a copy of the same id and start (a repeated row) isn't later than itself
        lead_of_later = lead[~head]
        same = (idv[self.doc[self.later]] == idv[self.doc[lead_of_later]]) & (rel[self.later] == rel[lead_of_later])
        self.twin, self.twin_of = self.later[same], lead_of_later[same]
        self.later = self.later[~same]

    def _mixed(self, order: np.ndarray) -> bool:
        """Whether some windows agree in the first fingerprint alone."""
        a, b = self.h[0][order], self.h[1][order]
        return bool(((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any())

    def ids_of_docs(self) -> np.ndarray:
        """Null ids rank first, as the smallest long."""
        return np.asarray(pc.fill_null(self.docs.column("__id"), -(2**63)).combine_chunks()).astype(np.int64)

    def cells(self, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct cells in order, which of them each window of `first` falls in): the top bits of a fingerprint. `first` is
        in order of the first one."""
        cells = self.h[row][self.first] >> np.uint64(64 - width.bit_length() + 1) if width > 1 else np.zeros(len(self.first), np.uint64)
        if row:
            return np.unique(cells, return_inverse=True)
        new = np.r_[True, cells[1:] != cells[:-1]] if len(cells) else np.empty(0, bool)
        return cells[new], np.cumsum(new) - 1

    def estimated_repeated(self, bits: dict[tuple[int, int], list], width: int) -> np.ndarray:
        """Positions in `first` of the windows whose estimate is two or more. bits: by row and slice, what the run was told
        and how much of it earlier blocks have used."""
        ok = np.ones(len(self.first), bool)
        for row in range(ROWS):
            distinct, at = self.cells(row, width)
            flag = np.zeros(len(distinct), bool)
            for s, lo, hi in _runs(distinct // np.uint64(self.part)):
                told = bits[row, s]
                flag[lo:hi] = np.unpackbits(told[0][told[1] // 8 :], count=told[1] % 8 + hi - lo)[told[1] % 8 :].astype(bool)
                told[1] += hi - lo
            ok &= flag[at]
        return np.flatnonzero(ok)

    def candidates(self, bits: dict[tuple[int, int], list], width: int) -> np.ndarray:
        """Window numbers of the candidates, in order of place."""
        return np.sort(self.first[self.estimated_repeated(bits, width)])

    def kept(self, drop: np.ndarray) -> np.ndarray:
        """Words that no dropped window covers."""
        cover = np.zeros(len(self.ids) + 1, np.int32)
        np.add.at(cover, self.at[drop], 1)
        np.subtract.at(cover, self.at[drop] + self.window, 1)
        return np.cumsum(cover[:-1]) == 0


def _runs(sorted_keys: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(sorted_keys):
        return []
    cut = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return list(zip(sorted_keys[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(sorted_keys)], strict=True))


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _delta(sorted_values: np.ndarray) -> np.ndarray:
    return _narrow(np.diff(sorted_values, prepend=sorted_values.dtype.type(0)))


def _grouped(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(key, rows) of batches sorted by column `key`."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        for k, lo, hi in _runs(np.asarray(b.column(key))):
            if held and k != last:
                yield last, held
                held = []
            held.append(b.slice(lo, hi - lo))
            last = k
    if held:
        yield last, held


def _window_cells(total: int, part: int) -> int:
    """Width of a row of the sketch: a power of two, at least four times the windows that `total` bytes can hold at six a word."""
    return max(part, 1 << int(np.ceil(np.log2(max(1, total) / 6 * 4))))


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, carry: list[str] | None = None, digest: bool = False, unchanged: bool = False, block_bytes: int = BLOCK_BYTES, part: int = SLICE) -> DataFrame:
    """One row per document: id, text (kept words joined by one space), n_words, n_removed, then the columns in `carry`
    (default: all others). With digest, kept_sha256 stands in for text; with unchanged, a text that loses no word stays as
    it is, white space included.

    A null text is empty: no words, text "". Null ids rank before all others. Rows that repeat an id rank by start
    alone, so two equal rows keep or lose the same words. Columns named like a result column are dropped. block_bytes and
    part (cells of a slice of the sketch) bound what a task holds.
    """
    made = ["n_words", "n_removed", "kept_sha256" if digest else text_col]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in {id_col, text_col, *made}]
    spark = docs.sparkSession
    total = C.text_bytes(docs, text_col)
    per_run, slices = C.runs_and_slices(total, block_bytes)
    width = _window_cells(total, part)
    part = max(part, width >> max(0, int(np.ceil(np.log2(slices)))))
    blocks, inner = C.pack(docs, id_col, text_col, carry, block_bytes, total, per_run)
    parts = C.parts(spark, total)
    buckets = max(1, min(slices, -(-total // (16 << 20))))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, rows in _grouped(batches):
            out: dict[tuple[int, int], list] = {}
            for _, docs_here in C.blocks_of(rows, inner):
                b = Block(docs_here, window, part)
                for row in range(ROWS):
                    distinct, at = b.cells(row, width)
                    several = np.bincount(at, weights=b.times, minlength=len(distinct)) > 1
                    for s, lo, hi in _runs(distinct // np.uint64(part)):
                        own = (distinct[lo:hi] - np.uint64(s * part)).astype(np.uint32)
                        out.setdefault((s, row), []).append((_delta(own), several[lo:hi]))
            for (s, row), x in out.items():
                yield _table([(s, row, run, s * ROWS + row, C.squeeze(np.array([len(c) for c, _ in x], np.uint32), np.concatenate([c for c, _ in x]), np.packbits(np.concatenate([m for _, m in x]))))], ["slice", "row", "run", "key", "blob"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()])

    def cells_of(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
        """(cells of each block, whether each cell came more than once in its block)"""
        n, step, several = C.unsqueeze(blob)
        return [np.cumsum(x, dtype=np.int64) for x in np.split(step, np.cumsum(n[:-1], dtype=np.int64))], np.unpackbits(several, count=len(step))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 3):
            count = np.zeros(part, np.uint8)
            asked = []
            for r in rows:
                for s, row, run, blob in zip(*(r.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                    cells, several = cells_of(blob)
                    lo = 0
                    for c in cells:
                        count[c] = np.minimum(count[c] + 1 + several[lo : lo + len(c)], 2)
                        lo += len(c)
                    asked.append((run, row, s, blob))
            for run, row, s, blob in asked:
                flags = count[np.concatenate(cells_of(blob)[0])] > 1
                yield _table([(run, row, s, np.packbits(flags).tobytes())], ["run", "row", "slice", "blob"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()])

    def send(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        bits = {(r, s): [np.frombuffer(x, np.uint8), 0] for r, s, x in zip(*(right.column(c).to_pylist() for c in ("row", "slice", "blob")), strict=True)}
        out: dict[int, list] = {}
        for block, docs_here in C.blocks_of(left, inner):
            b = Block(docs_here, window, part)
            pick = b.candidates(bits, width)
            bucket = b.h[0][pick] % np.uint64(buckets)
            idv = b.ids_of_docs()
            order = np.argsort(bucket, kind="stable")
            for k, lo, hi in _runs(bucket[order]):
                w = pick[order[lo:hi]]
                out.setdefault(k, []).append((b.h[0][w], (b.h[1][w] & np.uint64(0xFFFFFFFF)).astype(np.uint32), idv[b.doc[w]], b.at[w] - b.start[b.doc[w]], np.full(len(w), block), w))
        run = int(left.column("run")[0].as_py()) if left.num_rows else 0
        rows = []
        for k, x in out.items():
            h, g, ids, start, block, w = (np.concatenate(y) for y in zip(*x, strict=True))
            own, at = np.unique(ids, return_inverse=True)
            rows.append((k, run, C.squeeze(h, g, own, _narrow(at), _narrow(start), _narrow(block - run * per_run), _narrow(w))))
        return pa.Table.from_batches([_table(rows, ["bucket", "run", "blob"], [pa.int64(), pa.int64(), pa.binary()])])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            owners, got = [], []
            for r in rows:
                for run, blob in zip(r.column(1).to_pylist(), r.column(2).to_pylist(), strict=True):
                    h, g, ids, at, start, block, w = C.unsqueeze(blob)
                    owners.append(run)
                    got.append((h, g, ids[at], start.astype(np.int64), block, w))
            h, g, ids, start, block, w = (np.concatenate(x) for x in zip(*got, strict=True))
            own = np.repeat(np.arange(len(owners)), [len(x[0]) for x in got])
            order = np.lexsort((start, ids, g, h))
            hs, gs = h[order], g[order]
            head = np.r_[True, (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])]
            lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
            late = np.zeros(len(order), bool)
            late[order] = (ids[order] != ids[lead]) | (start[order] != start[lead])
            hit = np.flatnonzero(late)
            for k, lo, hi in _runs(own[hit]):
                yield _table([(owners[k], C.squeeze(block[hit[lo:hi]], w[hit[lo:hi]]))], ["run", "blob"], [pa.int64(), pa.binary()])

    fields = [docs.schema[id_col] if docs.schema[id_col].dataType == T.LongType() else T.StructField(id_col, T.LongType())]
    fields += [T.StructField(made[2], T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), *[docs.schema[c] for c in carry]]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    kinds = [C._arrow(f.dataType) for f in schema.fields]

    def remove(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        late: dict[int, list] = {}
        for blob in right.column("blob").to_pylist():
            block, w = C.unsqueeze(blob)
            order = np.argsort(block, kind="stable")
            for k, lo, hi in _runs(block[order]):
                late.setdefault(k, []).append(w[order[lo:hi]].astype(np.int64))
        run = int(left.column("run")[0].as_py()) if left.num_rows else 0
        done = [pa.table([pa.array([], k) for k in kinds], names=schema.names)]
        for block, docs_here in C.blocks_of(left, inner):
            b = Block(docs_here, window, part)
            gone = np.zeros(len(b.at), bool)
            for w in late.get(block - run * per_run, []):
                gone[w] = True
            gone[b.twin] = gone[b.twin_of]
            gone[b.later] = True
            keep = b.kept(np.flatnonzero(gone))
            texts, n_kept = [], []
            words, ids = b.words, b.ids
            for i, (s, n) in enumerate(zip(b.start.tolist(), b.n.tolist(), strict=True)):
                mine = ids[s : s + n][keep[s : s + n]].tolist()
                text = b.texts[i] if unchanged and len(mine) == n else b" ".join([words[w] for w in mine])
                n_kept.append(len(mine))
                texts.append(hashlib.sha256(text).hexdigest() if digest else text)
            n_kept = np.array(n_kept, np.int64)
            text = pa.array(texts, pa.string() if digest else pa.binary())
            cols = [b.docs.column("__id"), text.cast(pa.string()), pa.array(b.n), pa.array(b.n - n_kept), *[b.docs.column(f"__c{i}") for i in range(len(carry))]]
            done.append(pa.table([pa.chunked_array([c]).cast(k) if isinstance(c, pa.Array) else c.cast(k) for c, k in zip(cols, kinds, strict=True)], names=schema.names))
        return pa.concat_tables(done)

    cells = blocks.sortWithinPartitions("run").mapInArrow(sketch, "slice long, row int, run long, key long, blob binary")
    replies = cells.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(merge, "run long, row int, slice long, blob binary")
    windows = blocks.groupBy("run").cogroup(replies.groupBy("run")).applyInArrow(send, "bucket long, run long, blob binary")
    repeats = windows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(settle, "run long, blob binary")
    return blocks.groupBy("run").cogroup(repeats.groupBy("run")).applyInArrow(remove, schema)
