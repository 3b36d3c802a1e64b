"""Exact deduplication by Grace hashing.

Rows are equal when their texts are after all ASCII white space is deleted. Each
task first unites equal rows among its own, so that a group that holds a third of
all rows leaves a task as one record. Only these records, with their compressed
content, are dealt by hash; the receiving task keeps contents in an
open-addressing table that compares complete contents, and once its memory is
used up it partitions whatever isn't in the table to spill files and treats each
of those in turn, recursively.

Null text counts as empty; empty texts are one group. A null id sorts after all
others. Repeated rows are rows of their own, of which one stays. An empty table
gives an empty result. Other columns of ``docs`` don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.shared import first_row_number, with_columns, without, written

WHITE = b" \t\n\r\x0b\x0c"
FAN_OUT_BITS = 4


class ContentTable:
    """Open addressing with linear probing; equal means that hash and complete content are equal."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.entries: list[tuple[int, bytes, int]] = []
        self.bytes = 0

    def find(self, key: int, content: bytes) -> int | None:
        """The value stored with the content."""
        mask = len(self.slots) - 1
        at = key & mask
        while (i := self.slots[at]) >= 0:
            if self.entries[i][0] == key and self.entries[i][1] == content:
                return self.entries[i][2]
            at = (at + 1) & mask
        return None

    def add(self, key: int, content: bytes, value: int) -> None:
        if 2 * len(self.entries) >= len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            for i, entry in enumerate(self.entries):
                self._place(entry[0], i)
        self.entries.append((key, content, value))
        self._place(key, len(self.entries) - 1)
        self.bytes += len(content) + 100

    def _place(self, key: int, i: int) -> None:
        mask = len(self.slots) - 1
        at = key & mask
        while self.slots[at] >= 0:
            at = (at + 1) & mask
        self.slots[at] = i


Record = tuple[int, int, bytes]  # hash, class, content


def grace(records: Iterable[Record], memory: int, depth: int = 0) -> Iterator[tuple[int, int]]:
    """(class, class of the first record of equal content) for each record.

    Contents enter the table until ``memory`` is used; from then on records that
    aren't in it go to spill files by further bits of the hash. Every round takes
    in one content at least, so it ends even if all hashes are equal.
    """
    table, spills = ContentTable(), {}
    for key, cls, content in records:
        found = table.find(key, content)
        if found is None:
            if not spills and (table.bytes + len(content) <= memory or not table.entries):
                table.add(key, content, cls)
                found = cls
            else:
                part = (key >> (20 + FAN_OUT_BITS * depth)) & (2**FAN_OUT_BITS - 1)
                if part not in spills:
                    spills[part] = tempfile.TemporaryFile(prefix="grace-")  # noqa: SIM115  closed below
                pickle.dump((key, cls, content), spills[part], -1)
                continue
        yield cls, found
    del table
    for file in spills.values():
        file.seek(0)
        yield from grace(_read(file), memory, depth + 1)
        file.close()


def _read(file) -> Iterator[Record]:
    try:
        while True:
            yield pickle.load(file)
    except EOFError:
        return


def _local_classes(memory: int, carry: bool):
    """Adds row number, local class (the number of its first row), size and digest; with ``carry`` that row has the content, compressed."""

    def make():
        number, table, squeeze = first_row_number(), ContentTable(), zstandard.ZstdCompressor(level=1)

        def columns(batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
            nonlocal number, table
            rows, classes, points, digests, contents = [], [], [], [], []
            for text in texts:
                content = text.encode("utf-8", "surrogatepass").translate(None, WHITE)
                digest = hashlib.sha256(content)
                key = int.from_bytes(digest.digest()[:8], "little")
                cls = table.find(key, content)
                if cls is None:
                    if table.bytes + len(content) > memory:
                        table = ContentTable()  # later copies make a class of their own, united after the shuffle
                    cls = number
                    table.add(key, content, cls)
                    contents.append(squeeze.compress(content) if carry else None)
                else:
                    contents.append(None)
                rows.append(number)
                classes.append(cls)
                points.append(len(text))
                digests.append(digest.hexdigest())
                number += 1
            return [pa.array(rows, pa.int64()), pa.array(classes, pa.int64()), pa.array(points, pa.int64()), pa.array(digests, pa.string()), pa.array(contents, pa.binary())]

        return columns

    return make


def _contents():
    squeeze = zstandard.ZstdCompressor(level=1)
    return lambda batch, texts: [pa.array([squeeze.compress(t.encode("utf-8", "surrogatepass").translate(None, WHITE)) for t in texts], pa.binary())]


def _unite(memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            expand = zstandard.ZstdDecompressor()
            for batch in batches:
                for cls, digest, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    yield int.from_bytes(bytes.fromhex(digest[:16]), "little"), cls, expand.decompress(content)

        rows: list[tuple[int, int]] = []
        for row in grace(records(), memory):
            rows.append(row)
            if len(rows) == 20_000:
                yield _pairs(rows)
                rows = []
        if rows:
            yield _pairs(rows)

    return run


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["class__", "united__"])


def _grouped(docs: DataFrame, id_col: str, text_col: str, whole_rows: bool, memory: int) -> tuple[DataFrame, DataFrame]:
    """The numbered rows with their local classes, and (class__, group_size, winner) for each class."""
    keep = None if whole_rows else [F.col(id_col).alias("id__")]
    rows = with_columns(docs, text_col, _local_classes(memory, not whole_rows), "row__ long, class__ long, points__ long, text_sha256 string, content__ binary", keep)
    if whole_rows:
        rows = rows.withColumn("id__", F.col("doc").getField(id_col))
    rows = written(rows, "rows")
    firsts = rows.where("class__ = row__")
    if whole_rows:  # the rows have their texts, which needn't be stored twice
        firsts = firsts.select("class__", "text_sha256", F.col("doc").getField(text_col).alias("text__"))
        contents = with_columns(firsts, "text__", _contents, "content__ binary", ["class__", "text_sha256"])
    else:
        contents = firsts.select("class__", "text_sha256", "content__")
    united = contents.repartition("text_sha256").mapInArrow(_unite(memory), "class__ long, united__ long")
    # The order of a struct: most code points, ids before null, smallest id, first row.
    best = F.min(F.struct((-F.col("points__")).alias("p"), F.col("id__").isNull().alias("n"), F.col("id__").alias("id"), F.col("row__").alias("row"))).alias("best")
    local = rows.groupBy("class__").agg(F.count(F.lit(1)).alias("n__"), best)
    local = written(local.join(united, "class__"), "classes")
    groups = local.groupBy("united__").agg(F.sum("n__").alias("group_size"), F.min("best").alias("winner"))
    answers = local.select("class__", "united__").join(groups, "united__").select("class__", "group_size", "winner")
    return rows, answers


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False, memory: int = 64 << 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then that with the
    smallest id. With ``whole_rows`` the input's row comes along as struct ``doc``.
    ``memory``: bytes of content that a task holds.
    """
    rows, answers = _grouped(docs, id_col, text_col, whole_rows, memory)
    joined = rows.drop("content__").join(answers, "class__")
    return joined.select(
        *(["doc"] if whole_rows else []),
        F.col("id__").alias("doc_id"),
        F.col("winner.id").alias("keep_id"),
        "group_size",
        (F.col("row__") == F.col("winner.row")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` that exact_dedup() keeps, with all their columns."""
    rows, answers = _grouped(docs, id_col, text_col, True, memory)
    dropped = rows.select("row__", "class__").join(answers, "class__").where("row__ <> winner.row")
    return without(rows, dropped)
