"""Pieces shared by the training-data operators.

Everything here is row- or block-local: nothing gathers a corpus on the driver.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the separators of `[^\x20\x09-\x0D]+`. bytes.split() without arguments uses the same set.
SPACES = " \t\n\r\x0b\x0c"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset in a one-machine session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(sc, "_ledgerline_dir", None):
        sc._ledgerline_dir = tempfile.mkdtemp(prefix="ledgerline-")
        atexit.register(shutil.rmtree, sc._ledgerline_dir, True)
    return sc._ledgerline_dir


#: Tables made inside the `stage_output` calls that are running.
_made: list[list[str]] = []


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    for held in _made:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_output(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What make returns, materialised; the tables that it took on the way are deleted then."""
    held: list[str] = []
    _made.append(held)
    try:
        out = make()
        held_before = list(held)
        stored = materialise(out, tag)
    finally:
        _made.pop()
    for path in held_before:
        _delete(spark, path)
    return stored


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        pass


def join_hot(rows: DataFrame, keys: DataFrame, on: list[str], total: int, copies: str = "copies") -> DataFrame:
    """rows left-joined to keys, which has one row for each value of `on` and in `copies` how many of the `total` rows have it.

    Values in over a hundredth of all rows, fewer than a hundred of them, are broadcast, so that none of them is one task.
    """
    hot = F.broadcast(keys.filter(F.col(copies) * 100 > total))
    cold = keys.filter(F.col(copies) * 100 <= total)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on, "left"))


def held_out(id_col: str, modulus: int, remainder: int):
    """crc32 of the id's decimal text, mod `modulus`, equals `remainder`; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def append(df: DataFrame, text_col: str, fn: Callable[[list], dict[str, pa.Array]], out: T.StructType, keep: Iterable[str] | None = None) -> DataFrame:
    """df's columns (or those in `keep`) followed by the columns of `out`, which fn makes from a batch of raw UTF-8 texts.

    A column of df named like one of `out` is replaced by it. fn gets a list of bytes or None.
    """
    names = [c for c in (df.columns if keep is None else keep) if c not in set(out.names)]
    schema = T.StructType([df.schema[c] for c in names] + list(out.fields))
    src = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").cast("string").cast("binary").alias("__text"))
    kinds = [(f.name, _arrow(f.dataType)) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big):
                made = fn(b.column(b.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(i) for i in range(len(names))] + [pa.array(made[n], type=k) if not isinstance(made[n], pa.Array) else made[n].cast(k) for n, k in kinds],
                    names=names + [n for n, _ in kinds],
                )

    return src.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch whose last column is text or binary into runs of about `size` bytes; a longer value stands alone."""
    if not batch.num_rows:
        return
    lens = np.array(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0), dtype=np.int64)
    run = np.cumsum(lens + 64) // size
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# ---- blocks: documents dealt by a hash, packed and compressed, so that several passes can shuffle them cheaply


def text_bytes(df: DataFrame, text_col: str) -> int:
    return df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")).cast("long"))).first()[0] or 0


def parts(spark: SparkSession, total_bytes: int = 0) -> int:
    """Tasks of a shuffle: the session's number, or more where a task would otherwise get over 32 MB of text."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // (32 << 20)))


def runs_and_slices(total_bytes: int, block_bytes: int) -> tuple[int, int]:
    """(blocks in a run, slices of what they send): a run sends one message to each slice. Both numbers grow with the square
    root of the blocks, so that messages grow with the corpus and not with its square."""
    root = np.sqrt(max(1, -(-total_bytes // block_bytes)))
    return max(1, round(root / 16)), max(1, int(np.ceil(16 * root)))


def pack(df: DataFrame, id_col: str, text_col: str, carry: list[str], block_bytes: int, total_bytes: int, per_run: int = 1) -> tuple[DataFrame, pa.Schema]:
    """(run, block, blob) rows, partitioned by run. A block is a set of documents fixed by a hash of id and text, about
    block_bytes of text; a run is `per_run` blocks, which a task takes one by one.

    The set doesn't depend on the input's order or partitions, so a recomputed task remakes the same blocks. One block
    may come as several rows. Columns in a blob: __id (long, null if null), __text (binary, empty if null), then `carry`.
    """
    n = max(1, -(-total_bytes // block_bytes))
    src = df.select(
        F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")), F.lit(n)).alias("__block"),
        *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)],
        F.col(f"`{id_col}`").cast("long").alias("__id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit(b"")).alias("__text"),
    )
    inner = pa.schema([(f.name, _arrow(f.dataType)) for f in src.schema.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for big in batches:
            for b in slices(big, 32 << 20):
                at = np.asarray(b.column(0))
                order = np.argsort(at, kind="stable")
                cut = np.flatnonzero(np.diff(at[order], prepend=-1))
                rest = b.select(list(range(1, b.num_columns))).take(pa.array(order)).cast(inner)
                ends = [*cut[1:].tolist(), b.num_rows]
                blobs = []
                for s, e in zip(cut.tolist(), ends, strict=True):
                    piece = rest.take(pa.array(np.arange(s, e)))
                    blobs.append(z.compress(piece.serialize()))
                block = at[order][cut]
                yield pa.RecordBatch.from_arrays([pa.array(block // per_run, pa.int64()), pa.array(block, pa.int64()), pa.array(blobs, pa.binary())], names=["run", "block", "blob"])

    return src.mapInArrow(run, "run long, block long, blob binary").repartition(parts(df.sparkSession, total_bytes), "run"), inner


def blocks_of(rows: pa.Table | list[pa.RecordBatch], inner: pa.Schema) -> Iterator[tuple[int, pa.Table]]:
    """(block, its documents) of the rows of one run, by block."""
    t = rows if isinstance(rows, pa.Table) else pa.Table.from_batches(rows)
    block = np.asarray(t.column("block"))
    blobs = t.column("blob")
    for k in np.unique(block).tolist():
        yield k, unpack((blobs[i].as_py() for i in np.flatnonzero(block == k).tolist()), inner)


def unpack(blobs: Iterable[bytes], inner: pa.Schema) -> pa.Table:
    """The documents of one block, ordered by id (null first) and text, so that every pass sees one order."""
    z = zstandard.ZstdDecompressor()
    t = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(z.decompress(x)), inner) for x in blobs], inner)
    return t.take(pc.sort_indices(t, sort_keys=[("__id", "ascending"), ("__text", "ascending")], null_placement="at_start"))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Integer arrays as bytes, byte planes apart (high planes of small numbers are then cheap)."""
    z = zstandard.ZstdCompressor(level=1)
    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append((a.dtype.str, len(a)))
        body.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
    top = repr(head).encode()
    return z.compress(len(top).to_bytes(4, "little") + top + b"".join(body))


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    import ast

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for kind, k in ast.literal_eval(raw[4 : 4 + n].decode()):
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, np.uint8, k * size, at).reshape(size, k).T.copy().view(kind).reshape(k) if k else np.empty(0, kind))
        at += k * size
    return out


ARRAY_ROW = "part long, blob binary"


def array_row(part: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([squeeze(x)], pa.binary())], names=["part", "blob"])


def add_arrays(rows: DataFrame, salts: int = 64) -> dict[int, np.ndarray]:
    """The sum of the arrays of each part, for a number of parts that doesn't grow. Tasks add what `salts` groups of tasks
    have made, then what those came to, so that no task reads an array of each task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (x,) = unsqueeze(blob)
                sums[part] = sums[part] + x if part in sums else x
        for part, x in sums.items():
            yield array_row(part, x)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).repartition(n, "part", "salt").select("part", "blob").mapInArrow(add, ARRAY_ROW)
    done = some.repartition(n, "part").mapInArrow(add, ARRAY_ROW).toArrow()
    return {p: unsqueeze(x)[0] for p, x in zip(done.column("part").to_pylist(), done.column("blob").to_pylist(), strict=True)}


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


def word_ids(texts: list[bytes], split: Callable[[bytes], list[bytes]]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(id of each word in order, distinct words, number of words of each text)."""
    seen = _Numbers()
    ids, counts = [], np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = split(t)
        counts[i] = len(w)
        ids.append(np.fromiter(map(seen.__getitem__, w), np.int32, len(w)))
    return (np.concatenate(ids) if ids else np.empty(0, np.int32)), list(seen), counts
