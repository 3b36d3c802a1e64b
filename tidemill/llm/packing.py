"""Best-fit packing of documents into sequences by hierarchical residual packing.

Texts become token ids with an end id. A document longer than a sequence is cut,
from its end, into full pieces, so that only its first piece may be shorter. All
pieces that don't fill a sequence are dealt to groups of bounded size; each group
packs best-fit decreasing and emits its nearly full bins. The underfull bins are
dealt anew, so that those of several groups meet as items of another best-fit round,
and so on up the tree until one group is left or a round merges nothing. A bin with
less room than the least filled bin left anywhere can take nothing more and is
emitted too.

Null text counts as empty and gives a piece with the end id alone. Null and
repeated ids are documents of their own. An empty table gives no pieces. Groups
are dealt by row, not by id, so no id or length can make one large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from zlib import crc32

from tidemill.llm.bpe import binary, ids_column
from tidemill.llm.shared import first_row_number, scratch, written

_FULL = 127 << 56  # sequence ids of pieces that fill one alone start here
_LEVEL, _GROUP = 56, 28


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The documents' pieces: doc_id, piece, start, length, ids_crc32, row__ (a number for each piece), and ids if asked for."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text__"))
    fields = "piece int, start long, length long, ids_crc32 long, row__ long" + ", ids binary" * with_ids
    schema = StructType([source.schema["doc_id"], *StructType.fromDDL(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = first_row_number()
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, data in enumerate(ids_column(batch.column(1).to_pylist(), tokenizer, end)):
                n = len(data) // 4
                begin, k = 0, 0
                stop = n % capacity or capacity
                while begin < n:
                    part = data[4 * begin : 4 * stop]
                    at.append(i)
                    piece.append(k)
                    start.append(begin)
                    length.append(stop - begin)
                    crc.append(crc32(part))
                    if with_ids:
                        ids.append(part)
                    begin, stop, k = stop, stop + capacity, k + 1
            rows = np.arange(number, number + len(at))
            number += len(at)
            made = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(rows, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *made, *([binary(ids)] if with_ids else [])], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def best_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, place in it) of each item; sizes descend. Bins wait in lists by the room they have; a bit set finds the least room that is enough."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fills, out = 0, [], []
    for size in sizes:
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        out.append((b, fills[b]))
        fills[b] += size
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return out


def _round(level: int, capacity: int, slack: int):
    """Packs a group's bins, each of one or more pieces, and marks those with at most ``slack`` room as done."""

    def run(group: pa.Table) -> pa.Table:
        old = group.column("bin__").to_numpy()
        length = group.column("length").to_numpy()
        offset = group.column("offset").to_numpy()
        bins, item = np.unique(old, return_inverse=True)
        fill = np.bincount(item, weights=length, minlength=len(bins)).astype(np.int64)
        order = np.lexsort((bins, -fill))
        placed = best_fit(fill[order].tolist(), capacity)
        new, place = np.empty(len(bins), np.int64), np.empty(len(bins), np.int64)
        new[order] = [b for b, _ in placed]
        place[order] = [p for _, p in placed]
        total = np.bincount(new, weights=fill).astype(np.int64)[new][item]
        name = (level << _LEVEL) + (group.column("group__")[0].as_py() << _GROUP) + new
        made = {"bin__": name[item], "offset": offset + place[item], "fill__": total, "done__": capacity - total <= slack}
        for k, v in made.items():
            group = group.set_column(group.schema.get_field_index(k), k, pa.array(v))
        return group

    return run


def pack(parts: DataFrame, capacity: int = 2048, group_rows: int = 50_000, slack: int = 8) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (columns length and row__, and whatever else)."""
    folder = scratch(parts.sparkSession)
    short = F.col("length") < capacity
    out = parts.where(~short).withColumns({"sequence_id": F.lit(_FULL) + F.col("row__"), "offset": F.lit(0).cast("long")}).drop("row__")
    names = out.columns
    left = parts.where(short).select(
        "*", F.col("row__").alias("bin__"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("fill__"), F.lit(False).alias("done__"),
        F.lit(0).cast("long").alias("group__"),
    )
    rows = bins = left.count()
    level = 0
    while rows:
        groups = -(-rows // group_rows)
        left = left.withColumn("group__", F.pmod(F.xxhash64("bin__", F.lit(level)), F.lit(groups).cast("long")))
        packed = written(left.groupBy("group__").applyInArrow(_round(level, capacity, slack), left.schema), f"level{level}", folder)
        was, smallest = bins, F.min(F.when(~F.col("done__"), F.col("fill__")))
        least = packed.agg(smallest).first()[0]
        last = groups == 1 or least is None
        done = F.lit(True) if last else F.col("done__") | (capacity - F.col("fill__") < least)
        if not last:
            rows, bins = packed.where(~done).agg(F.count(F.lit(1)), F.count_distinct("bin__")).first()
            last = level and bins == was
            done = F.lit(True) if last else done
        out = out.unionByName(packed.where(done).withColumnRenamed("bin__", "sequence_id").select(*names))
        left = packed.where(~done)
        level += 1
        if last:
            break
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with sequence_id and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""
    return pack(written(pieces(docs, tokenizer, capacity, end, id_col, text_col, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences' ids, one row each, from packed pieces with their ids; a group is a sequence, so at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.concat_ws("", F.transform(parts, lambda x: F.hex(x["ids"]))).alias("h"), F.sum("length").alias("length")).select("sequence_id", "length", F.unhex("h").alias("ids"))
