"""Token ids in files of patched frame-of-reference blocks.

A file holds whole documents in ascending order of id:

    magic | block size, blocks, values, documents (uint32, uint32, uint64, uint64)
    | place of each block in the file (uint64) | documents: id (int64), whether it is null (uint8), ids before it in the file (uint64)
    | blocks: minimum (uint32), values (uint32), width (uint8), exceptions (uint32)
      | the low ``width`` bits of value - minimum | exceptions: place (uint32), value - minimum (uint32)

The width is that of the ``percentile`` of the block's differences; larger ones
are exceptions. Numbers are little-endian. The block index lets a reader decode a
range of values without the rest.

Null text counts as empty, so such a document has the end id alone. Null ids come
first; ids that aren't whole numbers are an error, as files hold them as such. Repeated ids are documents of their own. An empty table gives no files and
no rows. Documents are dealt by ranges of (id, random number), so that an id which
many rows share doesn't land in one task; a file has at most ``file_values`` ids
unless a single document is longer.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.bpe import encoder
from tidemill.llm.shared import scratch, store, written

MAGIC = b"TMPFOR1\n"
_HEAD = struct.Struct("<IIQQ")
_BLOCK = struct.Struct("<IIBI")


def _pack_words(diffs: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of uint32 values (blocks x values, a multiple of 32), one after another, as 32-bit words."""
    groups = diffs.reshape(len(diffs), -1, 32)
    words = np.zeros((*groups.shape[:2], width), "<u4")
    mask = np.uint32((1 << width) - 1)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        x = groups[:, :, i] & mask
        words[:, :, word] |= x << np.uint32(shift)
        if shift + width > 32:
            words[:, :, word + 1] |= x >> np.uint32(32 - shift)
    return words.reshape(len(diffs), -1)


def _unpack_words(words: np.ndarray, width: int) -> np.ndarray:
    """The values again, from blocks x words."""
    groups = words.reshape(len(words), -1, width) if width else words.reshape(len(words), -1, 1)
    out = np.zeros((*groups.shape[:2], 32), "<u4")
    mask = np.uint32((1 << width) - 1)
    for i in range(32 if width else 0):
        word, shift = divmod(i * width, 32)
        x = groups[:, :, word] >> np.uint32(shift)
        if shift + width > 32:
            x = x | groups[:, :, word + 1] << np.uint32(32 - shift)
        out[:, :, i] = x & mask
    return out.reshape(len(words), -1)


def encode_blocks(values: np.ndarray, block: int, percentile: float = 0.95) -> list[bytes]:
    """Blocks of uint32 values; those of one width are packed together."""
    n = len(values)
    if not n:
        return []
    counts = np.full(-(-n // block), block)
    counts[-1] = n - block * (len(counts) - 1)
    held = -(-block // 32) * 32
    diffs = np.zeros((len(counts), held), "<u4")
    whole = n // block
    diffs[:whole, :block] = values[: whole * block].reshape(whole, block)
    if whole < len(counts):
        diffs[-1, : counts[-1]] = values[whole * block :]
    inside = np.arange(held) < counts[:, None]
    lows = np.where(inside, diffs, np.uint32(0xFFFFFFFF)).min(1)
    diffs = np.where(inside, diffs - lows[:, None], np.uint32(0))
    widths, odd = np.zeros(len(counts), np.int64), [np.empty(0, np.int64)] * len(counts)
    for b, m in enumerate(counts.tolist()):
        rank = min(m - 1, int(percentile * m))
        widths[b] = int(np.partition(diffs[b, :m], rank)[rank]).bit_length()
        if widths[b] < 32:
            odd[b] = np.flatnonzero(diffs[b, :m] >> np.uint32(widths[b]))
    packed: list[bytes] = [b""] * len(counts)
    for width in np.unique(widths).tolist():
        same = np.flatnonzero(widths == width)
        for b, words in zip(same.tolist(), _pack_words(diffs[same], width), strict=True):
            packed[b] = words.tobytes()[: (counts[b] * width + 7) // 8]
    return [
        b"".join((_BLOCK.pack(low, m, width, len(o)), bits, o.astype("<u4").tobytes(), diffs[b, o].tobytes()))
        for b, (low, m, width, o, bits) in enumerate(zip(lows.tolist(), counts.tolist(), widths.tolist(), odd, packed, strict=True))
    ]


def decode_blocks(data: bytes, places: list[int]) -> np.ndarray:
    """The values of the blocks at these places; those of one width and size are unpacked together."""
    heads = [_BLOCK.unpack_from(data, at) for at in places]
    starts = np.cumsum([0, *(h[1] for h in heads)])
    out = np.empty(int(starts[-1]), "<u4")
    alike: dict[tuple[int, int], list[int]] = {}
    for b, (_, n, width, _) in enumerate(heads):
        alike.setdefault((n, width), []).append(b)
    for (n, width), blocks in alike.items():
        n_bytes, held = (n * width + 7) // 8, -(-n // 32) * width * 4
        words = np.zeros((len(blocks), held or 4 * -(-n // 32)), np.uint8)
        for row, b in zip(words, blocks, strict=True):
            row[:n_bytes] = np.frombuffer(data, np.uint8, n_bytes, places[b] + _BLOCK.size)
        for values, b in zip(_unpack_words(words.view("<u4"), width), blocks, strict=True):
            low, _, _, n_odd = heads[b]
            diff = values[:n]
            at = places[b] + _BLOCK.size + n_bytes
            if n_odd:
                diff[np.frombuffer(data, "<u4", n_odd, at)] = np.frombuffer(data, "<u4", n_odd, at + 4 * n_odd)
            out[starts[b] : starts[b + 1]] = diff + np.uint32(low)
    return out


def encode_file(ids: list[int | None], texts: list[bytes], block: int = 4096, percentile: float = 0.95) -> bytes:
    """A file of documents given as little-endian uint32 ids."""
    values = np.frombuffer(b"".join(texts), "<u4")
    blocks = encode_blocks(values, block, percentile)
    starts = np.cumsum([0, *(len(t) // 4 for t in texts)])[:-1]
    head = len(MAGIC) + _HEAD.size + 8 * len(blocks) + 17 * len(ids)
    places = head + np.cumsum([0, *map(len, blocks)])[:-1]
    documents = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], np.uint8).tobytes() + starts.astype("<u8").tobytes()
    return b"".join((MAGIC, _HEAD.pack(block, len(blocks), len(values), len(ids)), places[: len(blocks)].astype("<u8").tobytes(), documents, *blocks))


def read_documents(data: bytes) -> tuple[list[int | None], np.ndarray, int]:
    """Ids, each document's first value, and the number of values."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    _, n_blocks, n_values, n_docs = _HEAD.unpack_from(data, len(MAGIC))
    at = len(MAGIC) + _HEAD.size + 8 * n_blocks
    ids = np.frombuffer(data, "<i8", n_docs, at).tolist()
    null = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
    return [None if x else i for i, x in zip(ids, null, strict=True)], np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64), n_values


def read_values(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values from first to last, by the blocks that hold them."""
    block, n_blocks, n_values, _ = _HEAD.unpack_from(data, len(MAGIC))
    last = n_values if last is None else last
    if first >= last:
        return np.empty(0, "<u4")
    places = np.frombuffer(data, "<u8", n_blocks, len(MAGIC) + _HEAD.size)
    low = first // block
    out = decode_blocks(data, places[low : (last - 1) // block + 1].tolist())
    return out[first - low * block : last - low * block]


def write_files(docs: DataFrame, folder: str, tokenizer: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", file_values: int = 1 << 20) -> DataFrame:
    """Writes the files and returns their list: part__, file__, n_values, file_start (ids in all files before)."""
    source = docs.select(F.col(id_col).cast("long").alias("id__"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text__"), F.rand(11).alias("deal__"))
    ordered = source.repartitionByRange("id__", "deal__").sortWithinPartitions("id__", "deal__").select("id__", "text__")
    names = ["part__", "file__", "n_values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, (files_, path) = task.partitionId(), store(folder)
        encode, tail = encoder(tokenizer).encode, struct.pack("<I", end)
        ids, texts, size, k = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, texts, size, k
            final = f"{path}/part-{part:06d}-{k:06d}.pfor"
            attempt = f"{path}/_attempts/{part}-{k}-{task.taskAttemptId()}"
            with files_.open_output_stream(attempt) as f:
                f.write(encode_file(ids, texts))
            files_.move(attempt, final)  # a repeated attempt replaces the file by an equal one
            row = pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, k, size)], names=names)
            ids, texts, size, k = [], [], 0, k + 1
            return row

        files_.create_dir(f"{path}/_attempts", recursive=True)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = encode(text) + tail
                if size and size + len(data) // 4 > file_values:
                    yield flush()
                ids.append(i)
                texts.append(data)
                size += len(data) // 4
        if ids:
            yield flush()

    files = written(ordered.mapInArrow(run, "part__ long, file__ long, n_values long"), "files")
    # Figures of partitions, not of files or documents: as many as there are tasks.
    starts, total = [], 0
    for part, n in sorted(files.groupBy("part__").agg(F.sum("n_values")).collect()):
        starts.append((part, total))
        total += n
    before = files.sparkSession.createDataFrame(starts, "part__ long, part_start long")
    within = F.sum("n_values").over(Window.partitionBy("part__").orderBy("file__").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("within", F.coalesce(within, F.lit(0))).join(before, "part__").select(*names, (F.col("part_start") + F.col("within")).alias("file_start"))


def read_files(listed: DataFrame, folder: str) -> DataFrame:
    """Documents read back from the listed files: doc_id, start (ids in all documents before), n_tokens, ids_crc32."""
    spark = listed.sparkSession
    if not listed.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder)
    name = F.regexp_extract("path", r"part-(\d+)-(\d+)\.pfor$", 0)
    files = files.select(F.regexp_extract(name, r"part-(\d+)", 1).cast("long").alias("part__"), F.regexp_extract(name, r"-(\d+)\.", 1).cast("long").alias("file__"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, k, content in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data = content.as_py()
                ids, starts, n = read_documents(data)
                values = read_values(data).tobytes()
                ends = [*starts[1:].tolist(), n]
                crcs = [crc32(values[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * len(ids), pa.int64()), pa.array([k.as_py()] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(starts), pa.array(np.array(ends) - starts, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["part__", "file__", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    documents = files.mapInArrow(run, "part__ long, file__ long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return documents.join(listed, ["part__", "file__"]).select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents' ids to files in ``folder`` (default: a new one in the shared folder) and reads them back."""
    folder = folder or f"{scratch(docs.sparkSession)}/tokens"
    return read_files(write_files(docs, folder, tokenizer, end, id_col, text_col), folder)
