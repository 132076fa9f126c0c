"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams (1 to 3 letters, words padded with a space) of a language's training texts, in
order of frequency. A document's own most frequent n-grams are ranked likewise; the out-of-place distance to a language
sums how far each n-gram's rank is from its rank there, and the profile length for n-grams that the language lacks. The
nearest language wins.

Three code points of 21 bits fit one 64-bit key, so n-grams of any script are exact, and counting is sorting.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import common as C

PROFILE = 300
#: Most languages that profiles are made for at once; more raise, as the profiles are broadcast.
LANGUAGES = 5_000


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point, itself if a letter, else a space (0x20)."""
    out = np.full(0x110000, 0x20, np.uint32)
    at = np.array([i for i in range(0x110000) if chr(i).isalpha()], np.uint32)
    out[at] = at
    return out


def ngrams(text: bytes | None) -> np.ndarray:
    """Keys of all n-grams of one text's lower-cased letters, in order; empty if it has no letter."""
    if not text:
        return np.empty(0, np.uint64)
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.concatenate(([0x20], _letters()[points], [0x20])).astype(np.uint64)
    space = points == 0x20
    points = points[~(space & np.r_[False, space[:-1]])]  # one space between words
    if len(points) < 2:
        return np.empty(0, np.uint64)
    one = points[points != 0x20]
    two = points[:-1] << np.uint64(21) | points[1:]
    middle = points[1:-1] != 0x20  # no gram spans two words
    three = (two[:-1] << np.uint64(21) | points[2:])[middle]
    return np.concatenate([one, two, three])


def top(keys: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent keys, most frequent first; ties by key."""
    distinct, n = np.unique(keys, return_counts=True)
    if len(distinct) > k:
        least = np.partition(n, len(n) - k)[len(n) - k]
        some = n >= least
        distinct, n = distinct[some], n[some]
    return distinct[np.lexsort((distinct, -n))][:k]


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", k: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): per language its k most frequent n-grams, counted over every text. Null languages have none.

    Tasks count first and send one row per language and n-gram; a language's candidates are ranked in its own window
    of distinct n-grams, which grows with the alphabet, not with the texts.
    """
    src = docs.filter(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for big in batches:
            for b in C.slices(big):
                by: dict[str, list] = {}
                for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    by.setdefault(lang, []).append(ngrams(t))
                for lang, grams in by.items():
                    keys, n = np.unique(np.concatenate(grams), return_counts=True)
                    held.setdefault(lang, []).append((keys, n))
                    if len(held[lang]) >= 16:
                        held[lang] = [_sum(held[lang])]
        for lang, x in held.items():
            keys, n = _sum(x)
            for lo in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[lo : lo + 50_000])), pa.array(keys[lo : lo + 50_000].view(np.int64)), pa.array(n[lo : lo + 50_000])], names=["lang", "gram", "n"])

    counts = src.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a bound on the bare row number lets tasks cut each language to k rows before any meets another
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("place") <= k)
    return ranked.select("lang", "gram", (F.col("place") - 1).alias("rank"))


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


class Profiles:
    """Ranks by n-gram, sparsely: for each n-gram the languages whose profile has it, with its rank there."""

    def __init__(self, rows: list[tuple], k: int = PROFILE):
        self.k = k
        self.langs = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        gram = np.array([r[1] for r in rows], np.int64).view(np.uint64)
        lang, rank = np.array([at[r[0]] for r in rows], np.int32), np.array([r[2] for r in rows], np.int32)
        order = np.argsort(gram, kind="stable")
        self.grams, self.first = np.unique(gram[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.lang, self.rank = lang[order], rank[order]

    def nearest(self, text: bytes | None) -> tuple[str, float]:
        """(language, score): score is 1 for ranks all in place, 0 for no common n-gram. `und`, 0 without letters."""
        own = top(ngrams(text), self.k)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        place = np.flatnonzero(self.grams[at] == own)
        at = at[place]
        n = self.first[at + 1] - self.first[at]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[at], n)
        # out of place by k unless the language has the n-gram
        saved = self.k - np.minimum(self.k, np.abs(self.rank[entry] - np.repeat(place, n)))
        distance = self.k * len(own) - np.bincount(self.lang[entry], weights=saved, minlength=len(self.langs))
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (self.k * len(own)))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", k: int = PROFILE) -> Profiles:
    """Profiles for the driver: k rows a language, for at most LANGUAGES languages, 16 bytes a row."""
    rows = profiles(docs, lang_col, text_col, k).limit(k * LANGUAGES + 1).toArrow()
    if rows.num_rows > k * LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return Profiles(list(zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True)), k)


def identify(docs: DataFrame, model: Profiles, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) plus lang_pred and score. Null, empty and letterless texts: `und`, 0.

    Equal distances go to the first language in order. With no profile every text is `und`. Columns of these names are
    replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> dict:
        found = [sent.value.nearest(t) for t in texts]
        return {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())}

    return C.append(docs, text_col, run, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]), keep)
