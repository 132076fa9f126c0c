"""Digests of sorted rows: a byte stream per key, hashed in order without ever being gathered.

A SHA-256 is sequential, so a key's rows are one sorted stream in one task; it holds a batch of rows at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag(c: Column) -> Column:
    """A string as its length in 8 bytes, big end first, and its UTF-8 bytes; null counts as empty."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(s).cast("long")), 16, "0")), s.cast("binary"))


def flag(c: Column) -> Column:
    """One byte, 1 or 0; null counts as false."""
    return F.when(F.coalesce(c, F.lit(False)), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))


def optional(c: Column) -> Column:
    """One byte 0 for null, else 1 and the number in 8 bytes, big end first."""
    return F.when(c.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0"))))


def tag_bytes(s: str) -> bytes:
    raw = s.encode()
    return len(raw).to_bytes(8, "big") + raw


def stream_digest(rows: DataFrame, by: str, order: list[Column], record: Column, head: bytes = b"", tail: bytes = b"", between: bytes = b"") -> DataFrame:
    """(by, digest, n): the SHA-256, as lower-case hex, of head, the records of a key in order, `between` two, and tail."""
    names = [f"__o{i}" for i in range(len(order))]
    src = rows.select(F.col(by).cast("string").alias("__key"), *[c.alias(n) for c, n in zip(order, names, strict=True)], record.alias("__record"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = src.repartition(n, "__key").sortWithinPartitions("__key", *names).select("__key", "__record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h, n = None, None, 0

        def done() -> pa.RecordBatch:
            h.update(tail)
            return pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([h.hexdigest()]), pa.array([n], pa.int64())], names=["key", "digest", "n"])

        for b in batches:
            for key, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if h is None or key != last:
                    if h is not None:
                        yield done()
                    last, h, n = key, hashlib.sha256(head), 0
                elif between:
                    h.update(between)
                h.update(record)
                n += 1
        if h is not None:
            yield done()

    return dealt.mapInArrow(run, "key string, digest string, n long").withColumnRenamed("key", by)
