"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Every token has a slot, and 16 slots make a class. The most frequent tokens have
slots of their own, the others share the rest by hash, so the slot of any token is
known without a table. The model is

    P(token | history) = P(class | history) * P(slot | class, history) * P(token | slot)

with softmaxes over hashed features: the previous token, the previous two, and the
one before the previous (a skip). The last factor is the smoothed unigram's share of
the slot. Feature weights start at zero, where the model is the unigram; training
takes all training rows once, in rounds, to which a first pass deals their texts by
hash, a folder each: in a round, tasks add up gradients at the
common weights and how often each row of the weights occurs. Executors add these
sums over all tasks in a tree, and the driver makes one update by them, so the
result depends on the rows and not on how they are dealt to tasks. Only sums of the
weights' size, which is fixed, reach the driver.

Unigram counts cover all training rows. Counts of the ``head`` most frequent tokens,
named by their hashes whatever their length, are broadcast, those of all others are
joined by token; none of these has more than a ``head``-th of all tokens.

Null text counts as empty: its only token is the end. A null id counts as the text
''. Repeated rows are rows of their own. An empty table gives an empty result;
without training rows each token has the probability of an unknown one, and a model
without changes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemill.llm.shared import first_row_number, remove, scratch, with_columns, written

SLOTS, CLASSES = 16, 16
OWN = 160  # slots that hold one token
END = b""  # no word is empty
KNOWN = 300_000
LONGEST = 64  # bytes of a token whose hash is remembered


@dataclass(frozen=True)
class Settings:
    class_rows: int = 1 << 15  # rows of hashed weights for the classes
    slot_rows: int = 1 << 16  # and for the slots; both powers of two
    rounds: int = 8
    rate: float = 2.0
    calm: float = 50.0  # occurrences before a row's step falls
    batch: int = 16384  # tokens
    head: int = 100_000  # tokens whose counts are broadcast
    parts: int = 4  # partitions of the table that one task deals to rounds, so that files aren't small


def tokens(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words and the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


class Hashes(dict):
    """Hashes of the first ``KNOWN`` short tokens that come are kept, others are made each time."""

    def __missing__(self, word: bytes) -> int:
        h = xxh64_intdigest(word, 42)
        if len(self) < KNOWN and len(word) <= LONGEST:
            self[word] = h
        return h


class Vocabulary:
    """What the broadcast head knows of tokens, found by their hashes: slots and counts, in a table with linear probing.

    Tokens are given as they are or by their hashes. Memory is bounded by the head and by KNOWN. Hashes have 64 bits; those
    of the head's tokens differ.
    """

    def __init__(self, own: dict[bytes | int, int], head: dict[bytes | int, int]) -> None:
        bits = max(10, (8 * len(head)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1)
        self.slots = np.array([*(own.get(w, -1) for w in head), -1])
        self.counts = np.array([*head.values(), 0])
        self.probes, self.hashes = 1, Hashes()
        for i, word in enumerate(head):
            key = word if isinstance(word, int) else xxh64_intdigest(word, 42)
            at, probe = key >> (64 - bits), 1
            while self.values[at] >= 0:
                if int(self.keys[at]) == key:
                    raise ValueError("two frequent tokens have the same hash")
                at, probe = (at + 1) & self.mask, probe + 1
            self.keys[at], self.values[at], self.probes = key, i, max(self.probes, probe)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each in the head, -1 for others."""
        at = (hashes >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == hashes, self.values[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.values[at] >= 0))
        for _ in range(self.probes - 1):
            at[open_] = (at[open_] + 1) & self.mask
            now = at[open_]
            found = (self.keys[now] == hashes[open_]) & (self.values[now] >= 0)
            out[open_[found]] = self.values[now[found]]
            open_ = open_[~found & (self.values[now] >= 0)]
            if not len(open_):
                break
        return out

    def read(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts' tokens, where each text starts, and the tokens' hashes, slots and counts (0 if not in the head)."""
        lists = [tokens(t) for t in texts]
        starts = np.cumsum([0, *map(len, lists)])
        words = list(chain.from_iterable(lists))
        hashes = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        places = self.find(hashes)
        slots = self.slots[places]
        # As xxhash64() in SQL, whose sign counts.
        slots = np.where(slots < 0, OWN + hashes.view(np.int64) % (SLOTS * CLASSES - OWN), slots)
        return words, starts, hashes, slots, self.counts[places]


class Weights:
    """The weights and what is made of them for a batch of tokens."""

    def __init__(self, s: Settings, mass: np.ndarray, classes: np.ndarray | None = None, slots: np.ndarray | None = None) -> None:
        self.s = s
        self.side = side = isqrt(len(mass))  # as many classes as slots in each
        by_class = mass.reshape(side, side)
        self.class_bias = np.log(by_class.sum(1) / mass.sum()).astype(np.float32)
        self.slot_bias = np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32)
        self.classes = np.zeros((s.class_rows, side), np.float32) if classes is None else classes.copy()
        self.slots = np.zeros((s.slot_rows, side), np.float32) if slots is None else slots.copy()

    @staticmethod
    def features(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hashes of each token's three features; before a text's start stand zeros."""
        n = len(hashes)
        out = np.empty((3, n), np.uint64)
        one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        one[1:], two[2:] = hashes[:-1], hashes[:-2]
        first = starts[:-1]
        one[first] = 0
        two[first] = 0
        two[np.minimum(first + 1, n - 1)] = 0
        k1, k2, k3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        out[0] = one * k1
        out[1] = (one * k2) ^ (two * k3)
        out[2] = (two * k2) + k1
        out ^= out >> np.uint64(29)
        out *= k3
        return out

    def rows(self, features: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = (features >> np.uint64(40)) & np.uint64(self.s.class_rows - 1)
        own = (slot // self.side).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        s = ((features ^ own) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & np.uint64(self.s.slot_rows - 1)
        return c.astype(np.int64), s.astype(np.int64)

    def forward(self, c: np.ndarray, s: np.ndarray, slot: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For the classes, and for the slots of the token's class: the target, its log probability, and all exponentials with their sums."""
        of, within = np.divmod(slot, self.side)
        ones, at, out = np.ones(self.side, np.float32), np.arange(len(slot)), []
        for z, rows, weights, target in ((self.class_bias, c, self.classes, of), (self.slot_bias.take(of, 0), s, self.slots, within)):
            z = z + weights.take(rows[0], 0)
            z += weights.take(rows[1], 0)
            z += weights.take(rows[2], 0)
            if max(z.max(), -z.min()) > 60:  # exponentials beyond float32
                z -= z.max(1, keepdims=True)
            log = z[at, target]
            np.exp(z, out=z)
            total = z @ ones
            out.append((target, log - np.log(total), z, total))
        return out

    def gain(self, features: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """log P(slot | history) - log P(slot) of each token."""
        (of, a, _, _), (within, b, _, _) = self.forward(*self.rows(features, slot), slot)
        return (a - self.class_bias[of] + b - self.slot_bias[of, within]).astype(np.float64)

    def sums(self) -> tuple[np.ndarray, ...]:
        """Zeros for gradient(): of the classes, of the slots (a row for each column of the weights), and the counts of both."""
        return np.zeros(self.classes.shape[::-1]), np.zeros(self.slots.shape[::-1]), np.zeros(len(self.classes)), np.zeros(len(self.slots))

    def gradient(self, features: np.ndarray, slot: np.ndarray, sums: tuple[np.ndarray, ...]) -> None:
        """Adds the gradients at these weights, and how often each row of them occurs, to ``sums``."""
        both = self.rows(features, slot)
        for rows, (target, _, gradient, whole), total, seen in zip(both, self.forward(*both, slot), sums[:2], sums[2:], strict=True):
            gradient /= -whole[:, None]
            gradient[np.arange(len(slot)), target] += 1
            flat = rows.ravel()
            seen += np.bincount(flat, minlength=len(seen))
            for k, column in enumerate(gradient.T.astype(np.float64)):
                total[k] += np.bincount(flat, np.tile(column, 3), len(seen))

    def step(self, sums: tuple[np.ndarray, ...], touched: tuple[np.ndarray, np.ndarray]) -> None:
        """One update by summed gradients. A row's step falls with its occurrences in all rounds, and starts small, so that rare features stay near zero."""
        for weights, total, n, seen in zip((self.classes, self.slots), sums[:2], sums[2:], touched, strict=True):
            seen += n.astype(np.int64)
            weights += (self.s.rate / np.sqrt((self.s.calm + n) * (self.s.calm + seen)) * total).T.astype(np.float32)

    def learn(self, features: np.ndarray, slot: np.ndarray, touched: tuple[np.ndarray, np.ndarray]) -> None:
        """One update by the gradients of these tokens."""
        sums = self.sums()
        self.gradient(features, slot, sums)
        self.step(sums, touched)


def _held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 1


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, n) over all rows; each task adds up what it reads before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        read = 0  # characters, no fewer than the counted tokens have

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text or ""))
                read += len(text or "")
                if len(counts) > 300_000 or read > 1 << 27:
                    yield rows()
                    counts.clear()
                    read = 0
        if counts:
            yield rows()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


BLOCKS = 64
_SUM = np.float32  # of gradients and occurrences between tasks
FAN_IN = 32


def _train_round(s: Settings, mass: np.ndarray, own: dict[int, int], shared):
    """Each task's sums of gradients and occurrences, in BLOCKS parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, vocabulary = Weights(s, mass, *shared.value), Vocabulary(own, own)
        sums = w.sums()
        any_ = False
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), 256):
                _, starts, hashes, slot, _ = vocabulary.read([t or "" for t in texts[i : i + 256]])
                features = w.features(hashes, starts)
                for j in range(0, len(slot), s.batch):
                    w.gradient(features[:, j : j + s.batch], slot[j : j + s.batch], sums)
                    any_ = True
        if any_:
            parts = [[p.astype(_SUM).tobytes() for p in np.array_split(x.T, BLOCKS)] for x in sums]
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([part] * BLOCKS, pa.int32()), *(pa.array(p, pa.binary()) for p in parts)], names=["block", "part", "c", "s", "nc", "ns"])

    return run


def _sum(group: pa.Table) -> pa.Table:
    """Adds the arrays in the binary columns of at most FAN_IN rows, one after another."""
    sums = [sum((np.frombuffer(x.as_py(), _SUM) for x in group.column(k)), _SUM(0)) for k in ("c", "s", "nc", "ns")]
    return pa.Table.from_arrays([group.column("block")[:1], group.column("part")[:1], *(pa.array([x.tobytes()], pa.binary()) for x in sums)], names=group.schema.names)


_ROUND = "block int, part int, c binary, s binary, nc binary, ns binary"


def train(docs: DataFrame, mass: np.ndarray, own: dict[int, int], s: Settings, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The weights after all rounds; a round takes the rows whose text's hash falls to it.

    Each task sends sums of the weights' size. Texts are written once, by round, so a round reads its own alone.
    """
    spark, root = docs.sparkSession, f"{scratch(docs.sparkSession)}/rounds"
    text = F.col(text_col).cast("string")
    dealt = docs.select(text.alias("text"), F.pmod(F.xxhash64(text), F.lit(s.rounds)).cast("int").alias("round"))
    dealt.coalesce(max(1, docs.rdd.getNumPartitions() // s.parts)).write.partitionBy("round").option("compression", "zstd").parquet(root)
    w, touched = Weights(s, mass), (np.zeros(s.class_rows, np.int64), np.zeros(s.slot_rows, np.int64))
    for r in range(s.rounds):
        shared = spark.sparkContext.broadcast((w.classes, w.slots))
        texts = spark.read.schema("text string, round int").parquet(root).where(F.col("round") == r).select("text")
        tasks = max(1, texts.rdd.getNumPartitions())
        made = texts.mapInArrow(_train_round(s, mass, own, shared), _ROUND)
        added, parts = made, tasks
        while parts > 1:
            parts = -(-parts // FAN_IN)
            added = added.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("block", "part").applyInArrow(_sum, _ROUND)
        sums = w.sums()
        for row in added.toLocalIterator():  # BLOCKS rows, of the weights' size together
            for total, data in zip(sums, (row.c, row.s, row.nc, row.ns), strict=True):
                part = np.array_split(total.T, BLOCKS)[row.block]
                part += np.frombuffer(data, _SUM).reshape(part.shape)
        w.step(sums, touched)
        shared.unpersist()
    remove(spark, root)
    return w.classes, w.slots


def _scores(s: Settings, mass: np.ndarray, own: dict[int, int], shared, total: float):
    """n_tokens, what the head says of the counts, the model's gain, and the tokens that aren't in the head with their numbers."""

    def make():
        weights, head = shared.value
        w, vocabulary, number = Weights(s, mass, *weights), Vocabulary(own, head), first_row_number()

        def some(texts: list[str]) -> list[pa.Array]:
            words, starts, hashes, slot, counts = vocabulary.read(texts)
            features, first = w.features(hashes, starts), starts[:-1]
            gain = np.concatenate([w.gain(features[:, j : j + s.batch], slot[j : j + s.batch]) for j in range(0, len(slot), s.batch)])
            logs = np.where(counts > 0, np.log10((counts + 0.5) / total), 0.0)
            known = np.add.reduceat((counts > 0).astype(np.int64), first)
            # Tokens that the head doesn't know, once for each text, with how often they are there.
            rest = np.flatnonzero(counts == 0)
            of = np.searchsorted(starts, rest, "right") - 1
            order = np.lexsort((hashes[rest], of))
            rest, of = rest[order], of[order]
            new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (hashes[rest[1:]] != hashes[rest[:-1]]))))[: len(rest)]
            times = np.diff(np.append(new, len(rest)))
            lists = pa.array(np.searchsorted(of[new], np.arange(len(texts) + 1)), pa.int32())
            return [
                pa.array(np.diff(starts)), pa.array(known), pa.array(np.add.reduceat(logs, first)), pa.array(np.add.reduceat(gain, first) / np.log(10)),
                pa.ListArray.from_arrays(lists, pa.array([words[k] for k in rest[new].tolist()], pa.binary())), pa.ListArray.from_arrays(lists, pa.array(times, pa.int64())),
            ]

        def columns(batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
            nonlocal number
            parts = [some(texts[i : i + 256]) for i in range(0, len(texts), 256)]
            number += len(texts)
            return [*(pa.concat_arrays(c) for c in zip(*parts, strict=True)), pa.array(np.arange(number - len(texts), number))]

        return columns

    return make


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Learns from the rows that aren't held out and scores all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    s, spark, folder = settings, docs.sparkSession, scratch(docs.sparkSession)
    training = docs.where(~_held_out(id_col))
    counts = written(count_tokens(training, text_col), "counts", folder)
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total = n + 0.5 * (v + 1)
    # Tokens in the highest classes of counts that hold no more than ``head`` of them together: a bounded number, without sorting the others.
    size = F.floor(8 * F.log2("n"))
    least, taken = None, 0
    for kind, k in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):
        taken += k
        if taken > s.head:
            break
        least = kind
    hashed = F.xxhash64("token")
    found = counts.where(size >= least).select("n", hashed.alias("hash"), F.substring("token", 1, LONGEST).alias("start")).collect() if least is not None else []
    found.sort(key=lambda r: (-r.n, bytes(r.start), r.hash))
    head = {r.hash % 2**64: r.n for r in found}
    if len(head) < len(found):
        raise ValueError("two frequent tokens have the same hash")
    own = {h: i for i, h in enumerate(list(head)[:OWN])}
    first = spark.createDataFrame([(r.hash, i) for i, r in enumerate(found[:OWN])], "hash long, own int")
    slot = F.coalesce("own", F.lit(OWN) + F.pmod(F.xxhash64("token"), F.lit(SLOTS * CLASSES - OWN)))
    mass = np.full(SLOTS * CLASSES, 0.5)
    for row in counts.join(F.broadcast(first), hashed == F.col("hash"), "left").groupBy(slot.alias("slot")).agg(F.sum(F.col("n") + 0.5).alias("mass")).collect():
        mass[row.slot] += row.mass
    shared = spark.sparkContext.broadcast((train(training, mass, own, s, text_col), head))
    keep = [F.col(id_col).alias("doc_id"), _held_out(id_col).alias("held_out")]
    fields = "n_tokens long, known__ long, head__ double, gain__ double, rest__ array<binary>, rest_n__ array<long>, row__ long"
    rows = written(with_columns(docs, text_col, _scores(s, mass, own, shared, total), fields, keep), "scores", folder)
    rest = rows.where(F.size("rest__") > 0).select("row__", F.inline(F.arrays_zip(F.col("rest__").alias("token"), F.col("rest_n__").alias("times"))))
    found = rest.join(counts, "token", "left").select("row__", "times", F.coalesce("n", F.lit(0)).alias("n"))
    by_row = found.groupBy("row__").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / total)).alias("l"))
    base = F.col("head__") + F.coalesce("l", F.lit(0.0))
    return rows.join(by_row, "row__", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known__") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("gain__")).alias("score"),
    )
