"""Benchmark decontamination with a distributed positional inverted index.

`build_index` cuts the corpus into shards of bounded size, sharded by document, and stores for each shard its documents
and, per term, the sorted list of the term's positions. `search` answers test phrases against the stored index: in each
shard a phrase starts with the positions of its rarest term, moved back by the term's offset, and is intersected with
the lists of its other terms, each moved back by its own offset, from rare to frequent. What is left are exact matches.
Proximity matches ask for all words of a phrase within a span of so many more words, in any order.

The test set is small beside the corpus: it is sent to the shards in blocks of at most TEST_WORDS words, one search per
block, so that no broadcast grows with it. A vocabulary bounds the index to terms that a test holds; without one, or
when the tests exceed one block, all terms are stored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import common as C

#: Words are runs of bytes of letters, digits and anything beyond ASCII.
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARD_BYTES = 4 << 20
#: Most words of test items in one broadcast block, and most candidates looked at together.
TEST_WORDS = 1_000_000
RUN = 1 << 20


def words_of(text: bytes | None, pattern: re.Pattern = re.compile(WORD)) -> list[bytes]:
    return pattern.findall((text or b"").lower())


INDEX = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("n_words", T.ArrayType(T.IntegerType())),
        T.StructField("terms", T.BinaryType()),
        T.StructField("postings", T.BinaryType()),
    ]
)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: set[bytes] | None = None) -> DataFrame:
    """One row per shard: document ids and word counts, terms, and their position lists.

    Positions count words through the shard, with one empty position after each document, so no phrase spans two.
    `terms` are newline-joined (a word holds no newline); `postings` are list lengths and delta-coded lists. Documents
    without words stay in the shard with n_words 0. Repeated rows and null ids are kept as documents of their own.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("__text"))
    words = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, made = None if words is None else words.value, TaskContext.get().partitionId() << 32
        for big in batches:
            for b in C.slices(big, SHARD_BYTES):
                yield _shard(b, only, made)
                made += 1

    def _shard(b: pa.RecordBatch, only: frozenset | None, number: int) -> pa.RecordBatch:
        seen: dict[bytes, int] = {} if only is None else {w: i for i, w in enumerate(only)}
        ids, counts = [], []
        pattern = re.compile(WORD)
        for t in b.column(1).to_pylist():
            w = words_of(t, pattern)
            counts.append(len(w))
            if only is None:
                ids.append(np.fromiter((seen.setdefault(x, len(seen)) for x in w), np.int64, len(w)))
            else:
                get = seen.get
                ids.append(np.fromiter((get(x, -1) for x in w), np.int64, len(w)))
            ids.append(np.array([-1]))
        flat = np.concatenate(ids)
        order = np.argsort(flat, kind="stable")
        order = order[np.searchsorted(flat[order], 0) :]
        term, length = np.unique(flat[order], return_counts=True)
        step = np.diff(order, prepend=0)
        if len(order):
            at = np.cumsum(length) - length
            step[at] = order[at]
        names = list(seen)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int32())),
                pa.array([C.squeeze(np.frombuffer(b"\n".join(names[i] for i in term.tolist()), np.uint8))], pa.binary()),
                pa.array([C.squeeze(length.astype(np.uint32), step.astype(np.uint32))], pa.binary()),
            ],
            names=INDEX.names,
        )

    return src.mapInArrow(run, INDEX)


class Phrases:
    """Distinct phrases of a block of tests; `owner` lists (phrase, item) pairs."""

    def __init__(self, items: list[tuple], window: int):
        seen: dict[tuple, int] = {}
        owner: set[tuple] = set()
        for item, words in items:
            n = min(window, len(words))
            for s in range(len(words) - n + 1 if n else 0):
                owner.add((seen.setdefault(tuple(words[s : s + n]), len(seen)), item))
        self.terms: dict[bytes, int] = {}
        self.length = np.array([len(p) for p in seen], np.int64)
        self.word = np.full((len(seen), int(self.length.max()) if len(seen) else 1), -1, np.int64)
        for i, p in enumerate(seen):
            self.word[i, : len(p)] = [self.terms.setdefault(w, len(self.terms)) for w in p]
        pairs = sorted(owner, key=lambda x: x[0])
        self.owner_phrase = np.array([p for p, _ in pairs], np.int64)
        self.owner_item = [i for _, i in pairs]


class Shard:
    def __init__(self, row: dict, phrases: Phrases):
        (raw,) = C.unsqueeze(row["terms"])
        names = raw.tobytes().split(b"\n") if len(raw) else []
        length, step = (x.astype(np.int64) for x in C.unsqueeze(row["postings"]))
        start = np.cumsum(length) - length
        at = np.cumsum(step)
        if len(at):
            at -= np.repeat((at - step)[start], length)
        # this shard's list of each test term
        self.n = np.zeros(len(phrases.terms) + 1, np.int64)  # the last one is no term
        self.start = np.zeros(len(phrases.terms) + 1, np.int64)
        for i, name in enumerate(names):
            t = phrases.terms.get(name, -1)
            if t >= 0:
                self.n[t], self.start[t] = length[i], start[i]
        self.at = at
        self.words = np.array(row["n_words"], np.int64)
        self.doc_start = np.cumsum(self.words + 1) - self.words - 1
        self.size = int(self.doc_start[-1] + self.words[-1] + 1) if len(self.words) else 0
        # one sorted key a posting: list number, then position
        self.key = np.repeat(np.arange(len(length)), length) * (self.size + 1) + at
        self.list_of = np.full(len(phrases.terms) + 1, -1, np.int64)
        for i, name in enumerate(names):
            t = phrases.terms.get(name, -1)
            if t >= 0:
                self.list_of[t] = i

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the list of each term holds each position."""
        want = self.list_of[term] * (self.size + 1) + position
        at = np.searchsorted(self.key, want)
        ok = (position >= 0) & (at < len(self.key))
        ok[ok] = self.key[at[ok]] == want[ok]
        return ok

    def exact(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start position) of every occurrence."""
        size = np.where(p.word >= 0, self.n[p.word], np.iinfo(np.int64).max)
        alive = np.flatnonzero(size.min(1) > 0) if len(size) else np.empty(0, np.int64)
        rank = np.argsort(size[alive], axis=1, kind="stable")  # offsets, rarest term first
        found = []
        ends = np.cumsum(np.take_along_axis(size[alive], rank[:, :1], 1)[:, 0]) if len(alive) else np.empty(0, np.int64)
        lo = 0
        while lo < len(alive):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + RUN, "right")))
            ph, r = alive[lo:hi], rank[lo:hi]
            term = p.word[ph, r[:, 0]]
            n = self.n[term]
            who = np.repeat(np.arange(len(ph)), n)
            pos = self.at[np.repeat(self.start[term], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] - r[who, 0]
            for k in range(1, p.word.shape[1]):
                offset = r[who, k]
                term = p.word[ph[who], offset]
                ok = term < 0
                ok[~ok] = self.has(term[~ok], pos[~ok] + offset[~ok])
                who, pos = who[ok], pos[ok]
                if not len(who):
                    break
            found.append(np.stack([ph[who], pos]))
            lo = hi
        both = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return both[0], both[1]

    def near(self, p: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, start, words) of spans of at most length + slop words that hold all words of a phrase, as often as they
        recur in it.

        A span starts and ends at one of the words, and is the shortest of those that start at its first word.
        """
        who, where, size = [], [], []
        for i in range(len(p.length)):
            words = p.word[i, : p.length[i]]
            term, need = np.unique(words, return_counts=True)
            lists = [self.at[self.start[t] : self.start[t] + self.n[t]] for t in term.tolist()]
            if any(len(x) < k for x, k in zip(lists, need.tolist(), strict=True)):
                continue
            span = int(p.length[i]) + slop
            rare = lists[int(np.argmin([len(x) for x in lists]))]
            # spans worth a look start at a posting at most span - 1 before one of the rarest term
            starts = np.unique(np.concatenate(lists))
            nxt = np.searchsorted(rare, starts)
            starts = starts[(nxt < len(rare)) & (rare[np.minimum(nxt, len(rare) - 1)] < starts + span)]
            ok = np.ones(len(starts), bool)
            last = starts.copy()  # where the last word that is needed stands
            d = np.searchsorted(self.doc_start, starts, "right") - 1
            stop = np.minimum(starts + span, self.doc_start[d] + self.words[d])
            for x, k in zip(lists, need.tolist(), strict=True):
                at = np.searchsorted(x, starts) + k - 1
                there = x[np.minimum(at, len(x) - 1)]
                ok &= (at < len(x)) & (there < stop)
                last = np.maximum(last, there)
            who.append(np.full(int(ok.sum()), i))
            where.append(starts[ok])
            size.append(last[ok] + 1 - starts[ok])
        return tuple(np.concatenate(x) for x in (who, where, size)) if who else (np.empty(0, np.int64),) * 3


def test_blocks(tests: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Test items as (id, words), in blocks of at most TEST_WORDS words; one longer item stands alone."""
    held, n = [], 0
    for row in tests.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")).toLocalIterator():
        words = words_of(None if row[1] is None else row[1].encode())
        if not words or row[0] is None:
            continue
        if held and n + len(words) > TEST_WORDS:
            yield held
            held, n = [], 0
        held.append((row[0], words))
        n += len(words)
    if held:
        yield held


MATCH = "shard long, place int, doc_id long, n_words int, spans array<struct<start:int,end:int>>, items array<string>"


def search(index: DataFrame, phrases: Phrases, slop: int | None = None) -> DataFrame:
    """One row per document of the index: its place there (shard, place), doc_id, n_words, spans, items.

    spans: words in a match, as merged [start, end) runs; items: distinct ids, in byte order, of tests with a match. With
    slop, proximity matches (spans of at most a phrase's length + slop words, from one of its words to another) instead of
    exact ones.
    """
    sent = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            for row in b.to_pylist():
                s = Shard(row, p)
                who, pos, *size = s.exact(p) if slop is None else s.near(p, slop)
                doc = np.searchsorted(s.doc_start, pos, "right") - 1
                width = size[0] if size else p.length[who]
                cover = np.zeros(s.size + 1, np.int64)
                np.add.at(cover, pos, 1)
                np.add.at(cover, pos + width, -1)
                edge = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
                begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                spans: list[list] = [[] for _ in s.words]
                for a, e in zip(begin.tolist(), end.tolist(), strict=True):
                    d = int(np.searchsorted(s.doc_start, a, "right")) - 1
                    spans[d].append({"start": a - int(s.doc_start[d]), "end": e - int(s.doc_start[d])})
                items: list[set] = [set() for _ in s.words]
                pair = np.unique(np.stack([doc, who]), axis=1)
                lo, hi = np.searchsorted(p.owner_phrase, pair[1], "left"), np.searchsorted(p.owner_phrase, pair[1], "right")
                for d, x, y in zip(pair[0].tolist(), lo.tolist(), hi.tolist(), strict=True):
                    items[d].update(p.owner_item[x:y])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(s.words), row["shard"])),
                        pa.array(np.arange(len(s.words), dtype=np.int32)),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["n_words"], pa.int32()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array([sorted(x, key=str.encode) for x in items], pa.list_(pa.string())),
                    ],
                    names=["shard", "place", "doc_id", "n_words", "spans", "items"],
                )

    return index.mapInArrow(run, MATCH)


def find_contamination(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", test_col: str = "text", window: int = 8, slop: int | None = None, store: bool = True) -> DataFrame:
    """Documents with the test items they hold: doc_id, n_words, spans, items (see search). One row per document.

    A phrase is `window` consecutive words of an item; an item of fewer words is one phrase; one of none has none. Null
    texts have no words, null item ids aren't searched, items that repeat count once. With no tests, all lists are empty.
    """
    blocks = test_blocks(tests, item_col, test_col)
    first, second = next(blocks, []), next(blocks, None)
    index = build_index(docs, id_col, text_col, {w for _, words in first for w in words} if second is None else None)
    if second is None:
        return search(C.materialise(index, "postings") if store else index, Phrases(first, window), slop).drop("shard", "place")
    index = C.materialise(index, "postings")
    both = None
    for block in itertools.chain((first, second), blocks):  # each block's answers are stored before the next is read
        found = C.materialise(search(index, Phrases(block, window), slop), "matches")
        both = found if both is None else both.unionByName(found)
    return (
        both.groupBy("shard", "place")
        .agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), _merged(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .drop("shard", "place")
    )


def _merged(spans):
    """Sorted runs, overlapping ones joined."""
    kind = "array<struct<start:int,end:int>>"
    return F.aggregate(
        spans,
        F.array().cast(kind),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(-1)) >= x["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
