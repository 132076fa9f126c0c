"""LM scoring with a hidden Markov model whose counts come from the whole training corpus.

Tokens are lower-cased words and one end per text. Each token belongs to an emission class: the TOP most frequent tokens
have one each, all others share one by their last letters (`ENDINGS` of them by hash). A state emits a class, the class a
token by its count in training; so the model's size is fixed while its counts grow with the corpus.

1. Token counts: runs of blocks of documents send their distinct tokens, as 64-bit hashes with training counts, to slices
   of the vocabulary; each gets back the corpus counts of the tokens it asked about. Runs and slices grow with the square
   root of the corpus, so that messages grow with it. No vocabulary is gathered or broadcast; what slices report for the
   model is added up in tasks.
2. Blocks are stored as class numbers beside each text's count-based scores.
3. Baum-Welch: start values come from a bounded sample; then each full round sums the expected counts of all training
   texts, a row per state and task, added up per state.
4. Scaled forward recursion over each whole text gives its exact likelihood.

At 64 bits, two of a billion distinct tokens share a hash with a chance of 0.03; they would share their count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import common as C
from ledgerline.llm.substrings import _grouped, _narrow, _runs

END = b"\n"
TOP, ENDINGS = 1024, 1024
STATES = 8
BLOCK_BYTES = 4 << 20
#: Least text whose tokens make a slice of the vocabulary.
SLICE_BYTES = 16 << 20
#: Tokens of the sample that start values are fitted on; rounds on it, and most rounds on everything. These end before when
#: the likelihood of all training texts has risen by less than GAIN of itself.
SAMPLE_TOKENS, SAMPLE_ROUNDS, ROUNDS, GAIN = 150_000, 12, 4, 0.001


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


class Words:
    """Tokens of one block."""

    def __init__(self, table: pa.Table):
        self.docs = table
        self.ids, words, self.n = C.word_ids(table.column("__text").to_pylist(), tokens)
        self.held = np.asarray(table.column("__c0").combine_chunks().fill_null(False)).astype(bool)
        digest = xxhash.xxh3_64_intdigest
        self.hash = np.fromiter(map(digest, words), np.uint64, len(words))
        ending = xxhash.xxh32_intdigest
        self.ending = np.fromiter((ending(w[-3:]) % ENDINGS for w in words), np.uint16, len(words))
        weight = np.repeat(~self.held, self.n).astype(np.float64)
        self.count = np.bincount(self.ids, weights=weight, minlength=len(words)).astype(np.int64)


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def random(frequency: np.ndarray, states: int = STATES, seed: int = 3) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = frequency * np.exp(rng.normal(0, 0.7, (states, len(frequency))))
        move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return Hmm(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    @staticmethod
    def of_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, frequency: np.ndarray) -> Hmm:
        """Smoothed by a small share of even chances and of the classes' overall frequencies; no chance is zero."""
        emit = emit + 5.0 * frequency
        move = move + 0.1
        start = start + 0.1
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


class Batch:
    """Class sequences laid out step by step: all texts' first tokens, then the second ones of those that have one."""

    def __init__(self, classes: np.ndarray, lengths: np.ndarray):
        self.order, self.loglik = np.argsort(-lengths, kind="stable"), 0.0
        n = lengths[self.order]
        self.steps = int(n[0]) if len(n) else 0
        self.live = len(n) - np.searchsorted(n[::-1], np.arange(self.steps), "right")  # texts longer than t
        self.at = np.cumsum(self.live) - self.live
        begin = (np.cumsum(lengths) - lengths)[self.order]
        text = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.text = np.empty(n.sum(), np.int64)
        where = self.at[step] + text
        self.classes = np.empty(n.sum(), classes.dtype)
        self.classes[where] = classes[np.repeat(begin, n) + step]
        self.text[where] = text
        self.before = np.empty(n.sum(), np.int64)
        self.before[where] = np.where(step > 0, self.at[np.maximum(step - 1, 0)] + text, -1)

    def forward(self, m: Hmm, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scaled forward values, scales, emission values), a row per token."""
        emit = np.ascontiguousarray(m.emit.T.astype(kind))[self.classes]
        move = m.move.astype(kind)
        alpha, scale = emit, np.empty(len(emit), kind)  # in place: alpha takes emit's rows over
        keep = emit.copy()
        for t in range(self.steps):
            a, n = self.at[t], self.live[t]
            row = alpha[a : a + n]
            if t:
                p = self.at[t - 1]
                row *= alpha[p : p + n] @ move
            else:
                row *= m.start.astype(kind)
            s = row.sum(1)
            row /= s[:, None]
            scale[a : a + n] = s
        return alpha, scale, keep

    def log10(self, m: Hmm) -> np.ndarray:
        """log10 likelihood of each text, in the order they came."""
        out = np.zeros(len(self.order))
        if self.steps:
            scale = self.forward(m)[1]
            out[self.order] = np.bincount(self.text, weights=np.log10(scale), minlength=len(self.order))
        return out

    def expected(self, m: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves, and emissions; sets `loglik`, the natural log of all texts' likelihood."""
        k, classes = len(m.start), m.emit.shape[1]
        if not self.steps:
            return np.zeros(k), np.zeros((k, k)), np.zeros((k, classes))
        kind = np.float32
        alpha, scale, emit = self.forward(m, kind)
        self.loglik = float(np.log(scale.astype(np.float64)).sum())
        back = np.ascontiguousarray(m.move.T.astype(kind))
        ahead = emit  # becomes emission * beta / scale
        beta = np.ones_like(alpha)
        for t in range(self.steps - 1, -1, -1):
            a, n = self.at[t], self.live[t]
            row = ahead[a : a + n]
            row *= beta[a : a + n]
            row /= scale[a : a + n, None]
            if t:
                p = self.at[t - 1]
                beta[p : p + n] = row @ back
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        later = np.flatnonzero(self.before >= 0)
        move = m.move * (alpha[self.before[later]].T @ ahead[later])
        emitted = np.stack([np.bincount(self.classes, weights=gamma[:, i], minlength=classes) for i in range(k)])
        return gamma[: self.live[0]].sum(0, dtype=np.float64), move, emitted


def _by_length(classes: np.ndarray, lengths: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, Batch]]:
    """(texts, their Batch), longest first, about `most` tokens each, so that few batches have many steps."""
    order = np.argsort(-lengths, kind="stable")
    begin = np.cumsum(lengths) - lengths
    run = np.cumsum(lengths[order]) // most
    for _, lo, hi in _runs(run):
        texts = order[lo:hi]
        yield texts, Batch(np.concatenate([classes[b : b + n] for b, n in zip(begin[texts].tolist(), lengths[texts].tolist(), strict=True)]), lengths[texts])


def _merged(blocks: list[Words]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, training count, ending) of the distinct tokens of some blocks, by hash."""
    held, first, at = np.unique(np.concatenate([w.hash for w in blocks]), return_index=True, return_inverse=True)
    count = np.bincount(at, weights=np.concatenate([w.count for w in blocks]), minlength=len(held)).astype(np.int64)
    return held, count, np.concatenate([w.ending for w in blocks])[first]


def _sliced(held: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by (slice, hash), and the slices in that order."""
    part = held % np.uint64(slices)
    order = np.lexsort((held, part))
    return order, part[order]


def _reported(a: list | None, b: list) -> list:
    """Two reports of slices as one: mass and kinds of endings, and the TOP most frequent tokens with count and ending."""
    if a is None:
        return b
    h, c, e = (np.concatenate(x) for x in zip(a[2:], b[2:], strict=True))
    best = np.lexsort((h, -c))[:TOP]
    return [a[0] + b[0], a[1] + b[1], h[best], c[best], e[best]]


CODED = "block long, ids array<long>, held array<boolean>, n array<int>, known array<int>, base array<double>, own array<double>, classes binary"


def _sequences(rows: list[dict], training: bool) -> tuple[np.ndarray, np.ndarray]:
    classes, lengths = [], []
    for r in rows:
        n = np.array(r["n"], np.int64)
        (c,) = C.unsqueeze(r["classes"])
        if training:
            keep = ~np.array(r["held"], bool)
            c, n = c[np.repeat(keep, n)], n[keep]
        classes.append(c)
        lengths.append(n)
    return (np.concatenate(classes), np.concatenate(lengths)) if classes else (np.empty(0, np.uint16), np.empty(0, np.int64))


def _batches(rows: Iterator[pa.RecordBatch], most: int = 8_000_000) -> Iterator[list[dict]]:
    held, n = [], 0
    for b in rows:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            held.append(r)
            n += sum(r["n"])
            if n >= most:
                yield held
                held, n = [], 0
    if held:
        yield held


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: a boolean column of docs; true rows aren't learned from, null counts as false. A null text is empty: its
    one token is the end. Repeated rows are learned and scored each for itself. With nothing to learn from, every token
    is unknown and the model is its start values.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.lit(False) if held_out is None else held_out, F.lit(False)).alias("held_out"))
    total = C.text_bytes(src, "text")
    per_run, slices = C.runs_and_slices(total, BLOCK_BYTES)
    slices = max(1, min(slices, -(-total // SLICE_BYTES)))
    blocks, inner = C.pack(src, "doc_id", "text", ["held_out"], BLOCK_BYTES, total, per_run)
    parts = C.parts(spark, total)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, rows in _grouped(batches):
            held, count, ending = _merged([Words(t) for _, t in C.blocks_of(rows, inner)])
            order, part = _sliced(held, slices)
            out = [(s, run, C.squeeze(held[order[lo:hi]], _narrow(count[order[lo:hi]]), ending[order[lo:hi]])) for s, lo, hi in _runs(part)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["slice", "run", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in _grouped(batches):
            owners = [x for r in rows for x in r.column(1).to_pylist()]
            asked = [C.unsqueeze(x) for r in rows for x in r.column(2).to_pylist()]
            h, at = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
            c = np.bincount(at, weights=np.concatenate([x[1] for x in asked]), minlength=len(h)).astype(np.int64)
            ending = np.zeros(len(h), np.int64)
            ending[at] = np.concatenate([x[2] for x in asked])
            known = c > 0
            top = np.lexsort((h, -c))[:TOP]
            top = top[known[top]]
            stats = C.squeeze(np.bincount(ending[known], weights=c[known], minlength=ENDINGS).astype(np.int64), np.bincount(ending[known], minlength=ENDINGS).astype(np.int64), h[top], c[top], ending[top])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([s]), pa.array([stats], pa.binary())], names=["run", "slice", "blob"])
            lo = 0
            for run, x in zip(owners, asked, strict=True):
                hi = lo + len(x[0])
                yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([s]), pa.array([C.squeeze(_narrow(c[at[lo:hi]]))], pa.binary())], names=["run", "slice", "blob"])
                lo = hi

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What several slices report, as one report."""
        all_ = None
        for b in batches:
            for blob in b.column(0).to_pylist():
                all_ = _reported(all_, C.unsqueeze(blob))
        if all_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([C.squeeze(*all_)], pa.binary())], names=["blob"])

    sent = blocks.sortWithinPartitions("run").mapInArrow(send, "slice long, run long, blob binary")
    replies = C.materialise(sent.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(count, "run long, slice long, blob binary"), "counts")
    report = None
    reports = replies.filter("run is null").select("slice", "blob").repartition(max(1, int(np.sqrt(slices))), "slice").select("blob").mapInArrow(add, "blob binary")
    for (blob,) in reports.toLocalIterator():
        report = _reported(report, C.unsqueeze(bytes(blob)))
    none = np.empty(0, np.int64)
    mass, kinds, *top = report or (np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64), none.astype(np.uint64), none, none)
    n, v = int(mass.sum()), int(kinds.sum())
    np.subtract.at(mass, top[2], top[1])
    np.subtract.at(kinds, top[2], 1)
    by_hash = np.argsort(top[0])
    sorted_top = top[0][by_hash]
    frequency = np.concatenate([top[1], np.zeros(TOP - len(top[1])), mass]).astype(np.float64) + 1.0
    frequency /= frequency.sum()

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["block", "ids", "held", "n", "known", "base", "own", "classes"]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary()]
        made = [pa.table([pa.array([], k) for k in types], names=names)]
        if not left.num_rows:
            return made[0]
        run = [(block, Words(t)) for block, t in C.blocks_of(left, inner)]
        held, _, _ = _merged([w for _, w in run])
        order, part = _sliced(held, slices)
        got = dict(zip(right.column("slice").to_pylist(), right.column("blob").to_pylist(), strict=True))
        told = np.empty(len(order), np.int64)
        told[order] = np.concatenate([C.unsqueeze(got[s])[0].astype(np.int64) for s, _, _ in _runs(part)])
        for block, w in run:
            c = told[np.searchsorted(held, w.hash)]
            base = np.log10((c + 1) / (n + v + 1))
            kind = w.ending.astype(np.int64) + TOP
            own = np.log10((c + 1) / (mass[w.ending] + kinds[w.ending] + 1))
            if len(sorted_top):
                p = np.minimum(np.searchsorted(sorted_top, w.hash), len(sorted_top) - 1)
                is_top = sorted_top[p] == w.hash
                kind[is_top], own[is_top] = by_hash[p[is_top]], 0.0
            text = np.repeat(np.arange(len(w.n)), w.n)
            total_of = lambda x: np.bincount(text, weights=x[w.ids], minlength=len(w.n))  # noqa: B023, E731
            row = [block, w.docs.column("__id").to_pylist(), w.held, w.n.astype(np.int32), total_of((c > 0).astype(np.float64)).astype(np.int32), total_of(base), total_of(own), C.squeeze(kind[w.ids].astype(np.uint16))]
            made.append(pa.table([pa.array([x], k) for x, k in zip(row, types, strict=True)], names=names))
        return pa.concat_tables(made)

    coded = C.materialise(blocks.groupBy("run").cogroup(replies.filter("run is not null").groupBy("run")).applyInArrow(code, CODED), "coded")

    model = Hmm.random(frequency, states)
    sample = coded.orderBy("block").limit(1).toArrow().to_pylist()  # one block: a bounded part
    classes, lengths = _sequences(sample, True)
    few = int(np.searchsorted(np.cumsum(lengths), SAMPLE_TOKENS)) + 1
    batch = Batch(classes[: lengths[:few].sum()], lengths[:few])
    for _ in range(SAMPLE_ROUNDS if batch.steps else 0):
        model = Hmm.of_counts(*batch.expected(model), frequency)
    last = None
    for _ in range(rounds):
        model, loglik = _round(coded, model, frequency)
        if last is not None and loglik - last < GAIN * abs(last):
            break
        last = loglik
    sent_model = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(batches):
            classes, lengths = _sequences(rows, False)
            likelihood = np.zeros(len(lengths))
            for texts, batch in _by_length(classes, lengths):
                likelihood[texts] = batch.log10(sent_model.value)
            flat = lambda key: [x for r in rows for x in r[key]]
            ids = flat("ids")
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(flat("held"), pa.bool_()), pa.array(flat("n"), pa.int64()), pa.array(flat("known"), pa.int64()), pa.array([n] * len(ids), pa.int64()), pa.array(flat("base"), pa.float64()), pa.array(np.array(flat("own")) + likelihood)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return coded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _round(coded: DataFrame, model: Hmm, frequency: np.ndarray) -> tuple[Hmm, float]:
    """One round of Baum-Welch over all training texts: the new model, and the log likelihood of the texts under the old one."""
    sent = coded.sparkSession.sparkContext.broadcast(model)
    k = len(model.start)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows in _batches(batches):
            for _, batch in _by_length(*_sequences(rows, True)):
                got = (*batch.expected(sent.value), batch.loglik)
                total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
        if total is not None:
            start, move, emit, loglik = total
            for i in range(k):
                yield C.array_row(i, np.concatenate([[start[i]], move[i], emit[i]]))
            yield C.array_row(k, np.array([loglik]))

    counts = C.add_arrays(coded.mapInArrow(expect, C.ARRAY_ROW))
    if not counts:
        return model, 0.0
    lines = np.stack([counts[i] for i in range(k)])
    return Hmm.of_counts(lines[:, 0], lines[:, 1 : 1 + k], lines[:, 1 + k :], frequency), float(counts[k][0])
