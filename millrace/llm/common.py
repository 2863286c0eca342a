"""Shared plumbing: table access, bounded text batches, durable intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of text that a Python worker turns into arrays at once (one longer text still goes in whole).
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive [lo, hi) ranges whose texts hold about ``limit`` bytes; each has one text at least."""
    lo = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def give_back() -> None:
    """Return a task's memory to the system: other stages use its worker again, which would keep what it doesn't need."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list, list], Iterable[dict] | dict]],
    schema: str,
    key: str = "doc_id",
    text: str = "text",
    limit: int = CHUNK_BYTES,
    more: tuple[str, ...] = (),
) -> DataFrame:
    """Apply a function of (keys, texts, *more) to bounded batches of whole texts.

    ``make()`` runs once in each task and returns the function, so tables and caches live as long as the task.
    Only the named columns are read; other columns of ``docs`` are neither needed nor touched.
    """
    fields: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        try:
            for batch in batches:
                for lo, hi in spans(batch.column(1), limit):
                    out = call(*[c.slice(lo, hi - lo).to_pylist() for c in batch.columns])
                    for part in [out] if isinstance(out, dict) else out:
                        arrays = [x if isinstance(x := part[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow]
                        yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        finally:
            del call
            give_back()

    read = [docs[key].alias("key"), docs[text].cast("string").alias("text"), *[docs[c] for c in more]]
    return docs.select(read).mapInArrow(run, fields)


def keep_texts(docs: DataFrame, make: Callable[[], Callable[[list], list]], text: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose text a function of bounded batches of whole texts says True of.

    ``make()`` runs once in each task, as for map_texts.
    """
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        try:
            for batch in batches:
                texts = pc.cast(batch.column(place), pa.string())
                for lo, hi in spans(texts, limit):
                    keep = pa.array(call(texts.slice(lo, hi - lo).to_pylist()), pa.bool_())
                    yield batch.slice(lo, hi - lo).filter(keep)
        finally:
            del call
            give_back()

    return docs.mapInArrow(run, docs.schema)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, mark), mark a hash of the text: rows that share a doc_id are told apart by it."""
    read = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    return read.withColumn("mark", F.xxhash64("text"))


#: Bits of the filter that tells which rows may be among others: at most 8 MB are broadcast, however many rows there are.
BITS = 1 << 26


def flagged(rows: DataFrame, few: DataFrame, key: str, mark: str, flag: str) -> DataFrame:
    """``rows`` with a column ``flag``: whether their (key, mark) may be among those (doc_id, mark) of ``few``; false is
    certain. So only rows that matter are shuffled; where few are so many that all bits are set, all are."""

    def place(df: DataFrame, key: str, mark: str):
        return F.pmod(F.xxhash64(df[key], df[mark]), F.lit(BITS))

    at = place(few, "doc_id", "mark")
    bucket, bits = unused(rows, "bucket"), unused(rows, "bits")
    made = few.groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bits))
    own = place(rows, key, mark)
    bit = F.bitmap_bit_position(own).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False)).alias(flag)
    joined = rows.withColumn(bucket, F.bitmap_bucket_number(own)).join(F.broadcast(made), bucket, "left")
    return joined.select(*[rows[c] for c in rows.columns], there)


def may_have(rows: DataFrame, few: DataFrame, column: str) -> DataFrame:
    """Those of ``rows`` whose value of a column (long) may be among that of ``few``, by a filter of the same kind."""
    name, flag = unused(rows, "same"), unused(rows, "flag")
    own = rows.withColumn(name, F.lit(0).cast("long"))
    some = few.select(F.col(column).alias("doc_id"), F.lit(0).cast("long").alias("mark"))
    return flagged(own, some, column, name, flag).where(flag).drop(name, flag)


def one_row_each(docs: DataFrame, grouped: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each group: that of the smallest doc_id, then of the smallest mark; null ids come last.

    ``grouped`` has (doc_id, mark, node, root) of every row of docs: rows of equal texts share a node, nodes of a group a
    root. Minima are taken by node before they are by root, so many copies of one text don't meet in one task. Of wholly
    equal rows, which are few where ids are unique, one stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "mark")
    nodes = grouped.groupBy("node", "root").agg(F.min(order).alias("first"))
    first = durable(nodes.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.mark"), "firsts")
    rows = grouped.groupBy("doc_id", "mark").agg(F.count("*").alias("n"))
    same = rows["doc_id"].eqNullSafe(first["doc_id"]) & (rows["mark"] == first["mark"])
    gone = rows.join(first, same, "left_anti").select("doc_id", "mark")
    twice = durable(rows.where("n > 1").join(first, same, "left_semi").select("doc_id", "mark"), "twice")
    some = not twice.isEmpty()
    drop = durable(gone.unionByName(twice) if some else gone, "gone")
    name, flag = unused(docs, "mark"), unused(docs, "flag")
    own = flagged(docs.withColumn(name, F.xxhash64(docs[text].cast("string"))), drop, key, name, flag)

    def among(rows: DataFrame):
        return own[key].eqNullSafe(rows["doc_id"]) & (own[name] == rows["mark"])

    maybe = own.where(flag)
    kept = own.where(~F.col(flag)).unionByName(maybe.join(drop, among(drop), "left_anti"))
    if some:
        kept = kept.unionByName(maybe.join(twice, among(twice), "left_semi").dropDuplicates([key, name]))
    return kept.drop(name, flag)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset (tests) one under the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def subfolders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names in a folder, with a prefix, of what Spark has written to the end."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    found = jvm.org.apache.hadoop.fs.Path(f"{path}/{prefix}*/_SUCCESS")
    return [x.getPath().getParent().getName() for x in found.getFileSystem(conf).globStatus(found) or []]


def forget(df: DataFrame) -> None:
    """Delete the files of a durable table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Seconds between two releases at least.
RELEASE_EVERY = 3.0
_released = 0.0


def release(spark: SparkSession) -> None:
    """Have shuffle files go that no table refers to any more; else they stay until the driver collects its garbage."""
    global _released
    if time.monotonic() - _released >= RELEASE_EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released = time.monotonic()


def shrink(spark: SparkSession) -> None:
    """Have executors return heap that they don't use to the system, which a long run's workers need beside it."""
    context = spark.sparkContext
    if not context._jsc.sc().isLocal():
        n = 2 * context.defaultParallelism  # a task for each core, and one for those that come late
        spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()
