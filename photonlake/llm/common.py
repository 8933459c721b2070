"""Helpers shared by the training-data operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import materialise, shared_dir, side

__all__ = ["TRAIN_BYTES", "arrow_map", "bucket_of", "drop_path", "evaluated", "flat_utf8", "materialise", "mix64", "sampled", "shared_dir", "side", "slices", "span_hashes", "split_words", "table", "unused"]

#: Text bytes that one numpy step of an operator handles at a time; larger Arrow batches are cut.
STEP_BYTES = 1 << 20
#: Text bytes that a classifier is fitted on at most, but for the last document. It bounds what the driver holds.
TRAIN_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's reader only (the path may be a remote one)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``step`` bytes of ``column``, and a row at least."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(column))
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    ends = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1]
    at = 0
    while at < n:
        to = int(np.searchsorted(ends, int(ends[at]) + step, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str) -> DataFrame:
    """``mapInArrow`` of a batch function over pieces of bounded size (see :func:`slices`)."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, column):
                yield fn(piece)

    return df.mapInArrow(run, schema)


def flat_utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; a null is an empty text."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    ends = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    ends = ends.astype(np.int64)
    body = col.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span ``data[starts:ends]``, by a sum of mixed (byte, place in span) terms.

    Equal bytes give equal hashes wherever the span lies. Spans must not overlap and must be in order.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    lens = ends - starts
    total = int(lens.sum())
    inside = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
    src = inside + np.repeat(starts, lens)
    with np.errstate(over="ignore"):
        place = power_table(int(lens.max(initial=0)) + 1)
        terms = (data[src].astype(np.uint64) + np.uint64(1)) * place[inside]
        firsts = np.cumsum(lens) - lens
        live = lens > 0
        out = np.zeros(n, np.uint64)
        if live.any():
            out[live] = np.add.reduceat(terms, firsts[live])
        return mix64(out + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def split_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words (runs of bytes other than ASCII white space) of texts laid end to end, with n+1 offsets.

    Returns the bytes with A-Z lower-cased and a space before, between and after the texts; begin and end of each
    word in these; and the number of its text. Byte p of text i is at p + i + 1.
    """
    n, lens = len(at) - 1, np.diff(at)
    apart = np.full(len(data) + n + 1, 32, np.uint8)
    apart[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), lens)] = _LOWER[data]
    step = np.diff(_SPACE[apart].astype(np.int8))
    begin, end = np.flatnonzero(step == -1) + 1, np.flatnonzero(step == 1) + 1
    return apart, begin, end, np.searchsorted(at[1:] + np.arange(1, n + 1), begin, side="right")


_POWERS = np.ones(1, np.uint64)


def power_table(n: int) -> np.ndarray:
    """Mixed odd multipliers of the places 0..n-1, kept and grown when needed."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 4096)
        _POWERS = mix64(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    return _POWERS[:n]


def evaluated(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``df`` with the columns ``keep`` and new ones, each computed once a row.

    Through a one-row generator: the optimiser would else copy an expression into every place that reads it, and
    inside a lambda that is once for each element.
    """
    one = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("_once")
    return df.select(*keep, one).select(*keep, *(F.col(f"_once.{name}").alias(name) for name in columns))


def sampled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int) -> DataFrame:
    """(text, y): labelled documents to fit on, a row an id, in the order of the ids' hashes until a bound is passed.

    At most ``max_rows`` ids, and no document after those that come to ``max_bytes``; a null text is empty. Ids and
    sizes of so many rows are small enough to be sent to all executors and to be summed up in one task.
    """
    of = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("of")).agg(F.max(label).cast("int").alias("y"))
    of = of.orderBy(F.xxhash64("of"), "of").limit(max_rows)
    text = F.coalesce("text", F.lit(""))
    met = docs.select("doc_id", text.alias("text")).join(F.broadcast(of), F.col("doc_id") == F.col("of"))
    met = materialise(met.groupBy("of", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))
    before = Window.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = met.select(F.col("of").alias("id"), F.xxhash64("of").alias("h"), F.octet_length("text").cast("bigint").alias("n"))
    within = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < max_bytes).select("id")
    return met.join(F.broadcast(within), F.col("of") == F.col("id"), "left_semi").select("text", "y")


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names with underscores before them, as many as make them no column of ``df`` (case doesn't count)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that owns it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bucket_of(col: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; null where the id is null."""
    return F.pmod(F.crc32(F.encode(col.cast("string"), "UTF-8")), F.lit(modulus)).cast("int")
