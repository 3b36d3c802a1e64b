"""What the operators share: the shared scratch folder, written tables and per-row columns made in Python."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


HOT = 1000  # a key with more than this part of all rows is hot at least
MOST_HOT = 100_000  # and fewer keys than this are broadcast
LISTS = 4096  # files of numbers of dropped rows
#: The scratch folders made in the innermost removed_after() of this thread.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    If that is unset, a local folder is made where driver and executors are one process, as in tests; elsewhere it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.split("[")[0] == "local"
    if not root:
        if not local:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", root)
    elif "://" not in root and not root.startswith("file:"):
        root = "file://" + root if local else root
    folder, made = f"{root.rstrip('/')}/tidemill-{uuid.uuid4().hex}", _made.get()
    if made is not None:
        made.append(folder)
    return folder


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: work is done once and survives lost executors."""
    path = f"{folder or scratch(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path there, for tasks that read or write files themselves."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder whose tables nobody will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Scratch folders made inside, by this thread, are deleted at its end, also after an error: for a step whose result has been written elsewhere by then."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for folder in made:
            remove(spark, folder)


def hot(spark: SparkSession) -> int:
    """A key with more than this part of all rows is hot: a quarter of what a task of a shuffle has on average, within bounds."""
    return max(HOT, min(MOST_HOT, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def joined(rows: DataFrame, table: DataFrame, key: str, total: int, inner: bool = False, keep_n: bool = False) -> DataFrame:
    """``rows`` with the columns of a written ``table`` that has a row for each key and, in ``n__``, how many of the ``total`` rows have it.

    Fewer than k keys can have more than a k-th of the rows, which bounds what is broadcast (``hot``); their rows, and rows
    without a key, aren't shuffled.
    """
    is_hot = F.col("n__") * hot(rows.sparkSession) > total
    few = table.where(is_hot)
    at_once = rows.join(F.broadcast(few), key, "inner" if inner else "left")
    if not inner:
        at_once = at_once.where(F.col(key).isNull() | F.col("n__").isNotNull())
    others = rows.where(F.col(key).isNotNull()).join(F.broadcast(few.select(key)), key, "left_anti")
    out = at_once.unionByName(others.join(table.where(~is_hot), key, "inner" if inner else "left"))
    return out if keep_n else out.drop("n__")


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The ``doc`` of those rows of a written table whose ``row__`` is not among ``dropped``'s.

    The numbers of dropped rows are written in at most LISTS files by the task that gave them, sorted and in small groups, and
    whoever reads a task's rows reads its groups, so texts aren't shuffled, however many rows are dropped.
    """
    path = f"{scratch(rows.sparkSession)}/dropped"
    numbers = dropped.select("row__", F.pmod(F.shiftright("row__", _TASK_BITS), F.lit(LISTS)).alias("list__"))
    numbers.repartition("list__").sortWithinPartitions("list__", "row__").write.partitionBy("list__").option("parquet.block.size", 1 << 20).parquet(path)
    schema = rows.schema["doc"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files_, root = store(path)
        lists: dict[int, np.ndarray] = {}
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            stays = np.ones(len(numbers), bool)
            for task in np.unique(numbers >> _TASK_BITS).tolist():
                if task not in lists:
                    found = files_.get_file_info(fs.FileSelector(f"{root}/list__={task % LISTS}", allow_not_found=True))
                    own = [("row__", ">=", task << _TASK_BITS), ("row__", "<", (task + 1) << _TASK_BITS)]
                    parts = [pq.read_table(f.path, columns=["row__"], filesystem=files_, partitioning=None, filters=own) for f in found if f.path.endswith(".parquet")]
                    lists = {task: np.concatenate([numbers[:0], *(p.column(0).to_numpy() for p in parts)])}
                stays &= ~np.isin(numbers, lists[task])
            kept = batch.filter(pa.array(stays))
            yield pa.RecordBatch.from_arrays(kept.column(1).flatten(), names=schema.names)

    return rows.select("row__", "doc").mapInArrow(run, schema)


_TASK_BITS = 33


class Memo:
    """Keeps values of short keys in two generations, of about ``memory`` bytes together; ``new`` and ``old`` may be read directly."""

    def __init__(self, memory: int, longest: int = 64) -> None:
        self.new: dict = {}
        self.old: dict = {}
        self.half, self.longest, self.used = memory // 2, longest, 0

    def put(self, key, value, characters: int, size: int = 0) -> None:
        """``size``: bytes of the value beyond a small object."""
        if characters <= self.longest:
            self.new[key] = value
            self.used += 250 + 3 * characters + size
            if self.used > self.half:
                self.old, self.new, self.used = self.new, {}, 0


def first_row_number() -> int:
    """The number of a task's first row; numbers of different tasks don't meet."""
    return TaskContext.get().partitionId() << _TASK_BITS


Maker = Callable[[], Callable[[pa.RecordBatch, list[str]], list[pa.Array]]]


def with_columns(docs: DataFrame, text_col: str, make: Maker, fields: str, keep: list[str] | None = None, at_once: int | None = None) -> DataFrame:
    """Rows of ``docs`` with columns made from the text (null: empty), in Arrow batches.

    ``make()`` runs once in each task and returns a function of a batch and its texts.
    ``keep`` lists the columns that stay; None keeps whole rows as struct ``doc``, whatever their columns are called.
    ``at_once``: rows that go through it together at most, less than a batch where much is made of each.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text__")
    kept = docs.select(F.struct("*").alias("doc"), text) if keep is None else docs.select(*keep, text)
    stay = [f for f in kept.schema.fields if f.name != "text__"]
    schema = StructType(stay + StructType.fromDDL(fields).fields)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = make()
        for batch in (b.slice(i, at_once) for b in batches for i in range(0, b.num_rows, at_once or b.num_rows)):
            if batch.num_rows:
                made = columns(batch, batch.column(batch.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    return kept.mapInArrow(run, schema)
