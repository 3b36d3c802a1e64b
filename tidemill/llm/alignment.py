"""Cross-tokenizer alignment of texts by diagonal run skipping.

Both tokenizers cut the same bytes, a space and the text, so each token has an end in them and both ends ascend. From a
common end on, token i + k of the first stands for token j + k of the second as long as their ends agree: a run on the
diagonal of shift j - i. Its length is found by exponential probing, comparing stretches of the two end arrays at that shift
which double in size, and halving the one that differs. Where the ends differ, the tokens up to the next common end make
an irregular group; it is resolved token by token, which also updates the shift. Groups end at common ends. Two tokens are
linked if their byte ranges overlap: on a run each with its partner, in an irregular group as the resolving passes them.

How often two ids are linked is counted over the whole corpus. Tasks add up what they read before the shuffle. The most
frequent pairs, at most ``head`` of them, are broadcast; links of the others are joined by pair, and no such pair has more
than a ``head``-th of all links, so none makes a task large.

Null and empty texts, and those whose tokens of either side don't give the bytes again, have no tokens: zeros and ''. Ids
may be null or repeated, each row is a document of its own. An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.llm.bpe import binary, encoder
from tidemill.llm.shared import first_row_number, scratch, with_columns, written

HEAD = 1 << 20  # pairs of ids that are broadcast at most, of 17 bytes each
AT_ONCE = 1 << 19  # characters of texts that are aligned together
MEMORY = 64 << 20  # bytes that the first tokenizer's remembered stretches may take in a worker
COUNTED = 1 << 22  # pairs that a task adds up at most before it sends them


def diagonal_runs(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Aligns ascending ends whose last ones agree.

    Returns stretches (first token of a, of b, tokens of a, of b, groups: as many as tokens on a run, 1 of an irregular
    group), and the links of irregular groups as token numbers of a and of b.
    """
    n, m = len(a), len(b)
    stretches: list[int] = []
    link_a: list[int] = []
    link_b: list[int] = []
    i = j = 0
    while i < n:
        x, y = a[i], b[j]
        if x == y:
            run = 1
            while (part := a[i + run : i + 2 * run]) and part == b[j + run : j + 2 * run]:
                run += len(part)
            over = min(2 * run, n - i, m - j)
            while run < over:  # the first difference is beyond run, and not beyond over
                half = (run + over + 1) // 2
                if a[i + run : i + half] == b[j + run : j + half]:
                    run = half
                else:
                    over = half - 1
            stretches += (i, j, run, run, run)
            i += run
            j += run
        else:
            first, other = i, j
            while x != y:
                link_a.append(i)
                link_b.append(j)
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            link_a.append(i)
            link_b.append(j)
            i += 1
            j += 1
            stretches += (first, other, i - first, j - other, 1)
    return np.array(stretches, np.int64).reshape(-1, 5), np.array(link_a, np.int64), np.array(link_b, np.int64)


class Aligner:
    """Both tokenizers and what is made of their tokens, in a Python worker."""

    def __init__(self, tokenizer: str, model: bytes) -> None:
        import sentencepiece

        self.first = encoder(tokenizer, plain=True, memory=MEMORY)
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        a, b = self.first.token_bytes(), [self._bytes(i) for i in range(self.second.get_piece_size())]
        self.bytes = [pa.array(x, pa.binary()) for x in (a, b)]
        self.sizes = [np.array([len(t) for t in x], np.int64) for x in (a, b)]
        # An id and what follows it in the description of groups: a comma, or after the last one of a group's side "|" and ";".
        self.written = pa.array([f"{i}{end}" for tokens, last in ((a, "|"), (b, ";")) for i in range(len(tokens)) for end in (",", last)], pa.string())
        self.n_a, self.n_b = len(a), len(b)
        self.kind = np.uint32 if self.n_a * self.n_b <= 1 << 32 else np.uint64

    def _bytes(self, i: int) -> bytes:
        name = self.second.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.second.is_byte(i) else name.replace("▁", " ").encode()

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and numbers of tokens of each text, by both; a text that either doesn't give again has none."""
        encode = self.first.encode
        a = [np.frombuffer(encode(" " + t), "<u4") if t else np.empty(0, "<u4") for t in texts]
        b = [np.array(x, "<u4") for x in self.second.encode(texts, num_threads=1)]
        good = np.array([bool(t) for t in texts])
        for side, table in zip((a, b), self.bytes, strict=True):
            found = table.take(pa.array(np.concatenate(side)))
            data = _data(found)
            offsets = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1)
            at = offsets[np.cumsum([0, *map(len, side)])].tolist()
            good &= [data[p:q] == f" {t}".encode() for p, q, t in zip(at, at[1:], texts, strict=False)]
        ids = [np.concatenate([x for x, ok in zip(side, good, strict=True) if ok] or [np.empty(0, "<u4")]) for side in (a, b)]
        return ids, [np.array([len(x) if ok else 0 for x, ok in zip(side, good, strict=True)], np.int64) for side in (a, b)]

    def align(self, texts: list[str], with_groups: bool = False) -> list:
        """Columns of n_a, n_b, n_groups, groups_sha256 (or the groups), and each text's pairs of linked ids, distinct, with how often."""
        (a, b), (n_a, n_b) = self.tokens(texts)
        stretches, link_a, link_b = diagonal_runs(*(np.cumsum(sizes[ids]).tolist() for sizes, ids in zip(self.sizes, (a, b), strict=True)))
        start_a, start_b, size_a, size_b, groups = stretches.T
        regular = (size_a == groups) & (size_b == groups)
        in_a = np.repeat(np.where(regular, 1, size_a), groups)
        in_b = np.repeat(np.where(regular, 1, size_b), groups)
        end_a, end_b = np.cumsum(in_a), np.cumsum(in_b)

        # Where each token stands in the description of the groups, a side after the other.
        codes = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[end_a - 1] = 1
        last_b[end_b - 1] = 1
        codes[np.arange(len(a)) + np.repeat(end_b - in_b, in_a)] = 2 * a.astype(np.int64) + last_a
        codes[np.arange(len(b)) + np.repeat(end_a, in_b)] = 2 * (self.n_a + b.astype(np.int64)) + last_b
        found = self.written.take(pa.array(codes))
        data, offsets = _data(found), np.frombuffer(found.buffers()[1], np.int32, len(found) + 1)
        at = offsets[np.concatenate(([0], np.cumsum(n_a + n_b)))].tolist()
        described = [data[p : q - 1] if q > p else b"" for p, q in zip(at, at[1:], strict=False)]

        tokens_a = np.cumsum(n_a)
        n_groups = np.diff(np.searchsorted(end_a, np.concatenate(([0], tokens_a)), "right"))
        runs, length = stretches[regular], groups[regular]
        along = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        link_a = np.concatenate((np.repeat(runs[:, 0], length) + along, link_a))
        link_b = np.concatenate((np.repeat(runs[:, 1], length) + along, link_b))
        of = np.searchsorted(tokens_a, link_a, "right").astype(np.uint64)
        keys = a[link_a].astype(np.uint64) * np.uint64(self.n_b) + b[link_b]
        order = np.lexsort((keys, of)) if self.kind is np.uint64 else None
        if order is None:  # a text's number and its pair fit one integer, which is sorted faster
            both = np.sort(of << np.uint64(32) | keys)
            of, keys = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        else:
            of, keys = of[order], keys[order]
        new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]))))[: len(keys)]
        times = np.diff(np.append(new, len(keys))).astype(np.uint32)
        return [
            n_a, n_b, n_groups, [x.decode() for x in described] if with_groups else [hashlib.sha256(x).hexdigest() if x else "" for x in described],
            packed(keys[new].astype(self.kind), times, np.searchsorted(of[new], np.arange(len(texts) + 1, dtype=np.uint64))),
        ]


def _data(strings: pa.Array) -> bytes:
    """All bytes of strings that begin at offset 0."""
    return strings.buffers()[2].to_pybytes() if len(strings) and strings.buffers()[2] else b""


def packed(keys: np.ndarray, times: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """For each text its ascending keys' differences and their times, each as planes of bytes, which compress well."""
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    first = starts[:-1][starts[:-1] < len(keys)]
    steps[first] = keys[first]
    size, out = keys.itemsize, []
    for p, q in zip(starts.tolist(), starts[1:].tolist(), strict=False):
        out.append(steps[p:q].view(np.uint8).reshape(-1, size).T.tobytes() + times[p:q].view(np.uint8).reshape(-1, 4).T.tobytes())
    return out


def unpacked(columns: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' keys and times, and where each text's begin."""
    size, keys, times, starts = np.dtype(kind).itemsize, [], [], [0]
    for data in columns:
        planes = np.frombuffer(data, np.uint8).reshape(size + 4, -1) if data else np.empty((size + 4, 0), np.uint8)
        keys.append(np.cumsum(np.ascontiguousarray(planes[:size].T).view(kind).ravel(), dtype=kind))
        times.append(np.ascontiguousarray(planes[size:].T).view(np.uint32).ravel())
        starts.append(starts[-1] + planes.shape[1])
    return np.concatenate([np.empty(0, kind), *keys]), np.concatenate([np.empty(0, np.uint32), *times]), np.array(starts)


_aligners: dict[str, Aligner] = {}


def _aligner(tokenizer: str, model: bytes) -> Aligner:
    key = f"{tokenizer} {hashlib.sha256(model).hexdigest()}"
    if key not in _aligners:
        _aligners[key] = Aligner(tokenizer, model)
    return _aligners[key]


def align(docs: DataFrame, tokenizer: str, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 (or, if asked for, ``groups`` themselves), pairs (packed), row__; a written table."""
    with open(model_file, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # of the size of a vocabulary

    def make():
        aligner, number = _aligner(tokenizer, model.value), first_row_number()

        def columns(batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
            nonlocal number
            parts, i = [], 0
            while i < len(texts):
                k, size = i, 0
                while k < len(texts) and (k == i or size + len(texts[k]) <= AT_ONCE):
                    size += len(texts[k])
                    k += 1
                n_a, n_b, n_groups, groups, pairs = aligner.align(texts[i:k], with_groups)
                parts.append([pa.array(n_a), pa.array(n_b), pa.array(n_groups, pa.int64()), pa.array(groups, pa.string()), binary(pairs)])
                i = k
            number += len(texts)
            return [*(pa.concat_arrays(c) for c in zip(*parts, strict=True)), pa.array(np.arange(number - len(texts), number))]

        return columns

    fields = f"n_a long, n_b long, n_groups long, {'groups' if with_groups else 'groups_sha256'} string, pairs binary, row__ long"
    return written(with_columns(docs, text_col, make, fields, [F.col(id_col).alias("doc_id")], at_once=1000), "aligned")


def _vocabularies(tokenizer: str, model_file: str) -> tuple[int, type]:
    """How many ids the second tokenizer has, and the type of pairs."""
    with open(model_file, "rb") as f:
        aligner = _aligner(tokenizer, f.read())
    return aligner.n_b, aligner.kind


def pair_counts(aligned: DataFrame, n_b: int, kind: type) -> DataFrame:
    """pair (a's id times n_b plus b's), n (links that hold it), best (n is the largest that b's id has); a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, kind), np.empty(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            all_keys = np.concatenate([keys, *(w[0] for w in waiting)])
            all_counts = np.concatenate([counts, *(w[1] for w in waiting)])
            order = np.argsort(all_keys, kind="stable")
            all_keys = all_keys[order]
            new = np.flatnonzero(np.concatenate(([True], all_keys[1:] != all_keys[:-1])))
            waiting.clear()
            return all_keys[new], np.add.reduceat(all_counts[order], new)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

        size = 0
        for batch in batches:
            columns = batch.column(0).to_pylist()
            for i in range(0, len(columns), 1000):
                some, times, _ = unpacked(columns[i : i + 1000], kind)
                waiting.append((some, times.astype(np.int64)))
                size += len(some)
                if size > COUNTED:
                    keys, counts = merged()
                    size = len(keys)
                    if size > COUNTED // 2:
                        yield rows()
                        keys, counts, size = keys[:0], counts[:0], 0
        if size:
            keys, counts = merged()
            yield rows()

    folder = scratch(aligned.sparkSession)
    counts = written(aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "counts", folder)
    b = F.col("pair") % n_b
    most = counts.groupBy(b.alias("b__")).agg(F.max("n").alias("most__"))  # a row for each of b's ids at most, so it may be broadcast
    return written(counts.join(F.broadcast(most), b == F.col("b__")).select("pair", "n", (F.col("n") == F.col("most__")).alias("best")), "pairs", folder)


def cross_map(aligned: DataFrame, tokenizer: str, model_file: str) -> DataFrame:
    """The corpus-wide map between the vocabularies: a_id, b_id, n, best."""
    n_b, kind = _vocabularies(tokenizer, model_file)
    return pair_counts(aligned, n_b, kind).select(F.floor(F.col("pair") / n_b).alias("a_id"), (F.col("pair") % n_b).alias("b_id"), "n", "best")


def cross_align(docs: DataFrame, tokenizer: str, model_file: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text."""
    spark = docs.sparkSession
    n_b, kind = _vocabularies(tokenizer, model_file)
    aligned = align(docs, tokenizer, model_file, id_col, text_col)
    pairs = pair_counts(aligned, n_b, kind)
    # Pairs in the highest classes of counts that hold no more than ``head`` of them together.
    size = F.floor(8 * F.log2("n"))
    least, taken = None, 0
    for of, k in sorted(pairs.groupBy(size.alias("size")).count().collect(), reverse=True):
        taken += k
        if taken > head:
            break
        least = of
    known = pairs.where(size >= least).toArrow() if least is not None else pairs.limit(0).toArrow()
    order = np.argsort(known.column("pair").to_numpy())
    columns = tuple(known.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best"))
    shared = spark.sparkContext.broadcast((columns[0].astype(kind), columns[1], columns[2]))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "row__"]
    schema = StructType([*aligned.select(*kept).schema.fields, *StructType.fromDDL("best__ long, sum__ long, rest__ array<long>, times__ array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_keys, head_n, head_best = shared.value
        for batch in batches:
            keys, times, starts = unpacked(batch.column(len(kept)).to_pylist(), kind)
            at = np.searchsorted(head_keys, keys)
            at[at == len(head_keys)] = 0
            hit = head_keys[at] == keys if len(head_keys) else np.zeros(len(keys), bool)
            n, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            times = times.astype(np.int64)
            n[hit] = head_n[at[hit]] * times[hit]
            best[hit] = head_best[at[hit]] * times[hit]
            sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[starts]) for x in (best, n)]
            lists = pa.array(np.concatenate(([0], np.cumsum(~hit)))[starts], pa.int32())
            rest = [pa.ListArray.from_arrays(lists, pa.array(x[~hit].astype(np.int64))) for x in (keys, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *map(pa.array, sums), *rest], names=schema.names)

    rows = written(aligned.select(*kept, "pairs").mapInArrow(run, schema), "known")
    rest = rows.where(F.size("rest__") > 0)
    each = rest.select("row__", F.inline(F.arrays_zip(F.col("rest__").alias("pair"), F.col("times__").alias("times"))))
    found = each.join(pairs, "pair").groupBy("row__").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("n") * F.col("times")).alias("s"))
    whole = rows.where(F.size("rest__") == 0).withColumns({"b": F.lit(0).cast("long"), "s": F.lit(0).cast("long")})
    out = whole.unionByName(rest.join(found, "row__"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"), (F.col("best__") + F.col("b")).alias("n_best"), (F.col("sum__") + F.col("s")).alias("count_sum"), "groups_sha256")
