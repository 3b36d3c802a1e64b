"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, searched through a block-max inverted index.

Terms are words (runs of letters, lower case) and the first 4 to 8 letters of longer ones. Those whose documents go with
the label, by the log-likelihood ratio over the examples, are the vocabulary; all words together are one more term, so that
a text's length, and texts without any listed term, have their place too. Weights are (1 + ln tf) (1 + ln((1 + N) / (1 + df)))
in vectors of length 1.

Equal vectors are one entry with how many examples it has and how many of them are toxic. Entries are dealt to blocks, like
ones together; for each term the index has its postings by block and the largest weight in each block. A query's bound for
a block is the product of its weights and those; blocks are taken by falling bound until no bound reaches the k-th
similarity found, so that the k nearest entries, with all ties (to nine decimals), are exact. They vote by nearness, and a
logistic curve fitted to votes that leave each example itself out makes the share of toxic votes a probability.

The classifier is fitted on a bounded sample: at most ``Settings.examples`` labelled ids, those of smallest hash. Index and
vocabulary are bounded by it and broadcast. Nothing but the text goes into a score.

Null text counts as empty. Texts without words have no vector and get the examples' share of toxic ones; without examples all
do, as (toxic + 0.5) / (n + 2). Labels other than 0 and 1 count as none; an id labelled more than once is toxic if half or
more of its labels are. Of rows with one id the smallest text is the example; all rows are scored. Null ids are never
labelled. An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.llm.shared import Memo, with_columns, written

_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = range(4, 9)


@dataclass(frozen=True)
class Settings:
    """``examples``: the bound of the fitted sample; ``evidence``: least log-likelihood ratio of a term; ``nearest``: voting entries."""

    examples: int = 16_384
    terms: int = 512
    least_documents: int = 5
    evidence: float = 15.0
    nearest: int = 16
    block: int = 64


def words(text: str) -> dict[str, int]:
    return Counter(_WORD.findall(text.lower()))


def _terms(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in _PREFIXES if len(word) > k)]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that labels are never learnt from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


class Vocabulary:
    """Maps texts to vectors: ascending term numbers and weights; the last number stands for all words together."""

    def __init__(self, terms: list[str], weights: list[float]) -> None:
        self.number = {t: i for i, t in enumerate(terms)}
        self.heads = {t[:_PREFIXES[0]] for t in terms}  # all of a word's terms begin with as many of its letters
        self.idf = np.array([*weights, 1.0])
        self.known = Memo(32 << 20)

    def _numbers(self, word: str) -> tuple[int, ...]:
        found = self.known.old.get(word)
        if found is None:
            found = tuple(self.number[t] for t in _terms(word) if t in self.number)
        self.known.put(word, found, len(word), 8 * len(found))
        return found

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts, known, heads, letters = words(text), self.known.new, self.heads, _PREFIXES[0]
        found: dict[int, int] = {}
        for word in [w for w in counts if w[:letters] in heads]:
            numbers, n = known.get(word), counts[word]
            for i in self._numbers(word) if numbers is None else numbers:
                found[i] = found.get(i, 0) + n
        total = sum(counts.values())
        if total:
            found[len(self.number)] = total
        terms = np.array(sorted(found), np.int64)
        weights = (1 + np.log([found[i] for i in terms.tolist()])) * self.idf[terms]
        return terms, np.round(weights / np.sqrt((weights**2).sum()), 9) if total else weights


class Index:
    """Block-max inverted index of distinct vectors, each with its examples, toxic ones among them, and an example's id."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n: list[int], toxic: list[int], ids: list, n_terms: int, block: int) -> None:
        order = sorted(range(len(vectors)), key=lambda i: (self._rare_first(*vectors[i]), vectors[i][1].tolist()))
        self.n, self.toxic = np.array([n[i] for i in order], np.int64), np.array([toxic[i] for i in order], np.int64)
        self.ids, self.block = [ids[i] for i in order], block
        self.blocks = -(-len(order) // block)
        term = np.concatenate([np.empty(0, np.int64), *(vectors[i][0] for i in order)])
        entry = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        weight = np.concatenate([np.empty(0), *(vectors[i][1] for i in order)])
        by_term = np.lexsort((entry, term))
        term, self.entry, self.weight = term[by_term], entry[by_term], weight[by_term]
        # Postings of a term in a block, and the largest of their weights.
        cell = term * self.blocks + self.entry // block
        self.starts = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1)).reshape(-1)
        self.most = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(n_terms, self.blocks)

    @staticmethod
    def _rare_first(terms: np.ndarray, weights: np.ndarray) -> list[int]:
        return terms[np.argsort(-weights, kind="stable")].tolist()

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k entries of largest cosine above 0, with all that tie with the last, and their cosines; and how many blocks were read."""
        bounds = weights @ self.most[terms]
        order = np.argsort(-bounds, kind="stable")
        cells, width = (terms * self.blocks)[:, None], self.block
        entries, found, least, at, step = [np.empty(0, np.int64)], [np.empty(0)], 0.0, 0, 4
        while at < len(order) and bounds[order[at]] > 0 and bounds[order[at]] + 2e-9 >= least:
            some = order[at : at + step]
            some = np.sort(some[(bounds[some] > 0) & (bounds[some] + 2e-9 >= least)])
            starts = self.starts[cells + some].ravel()
            n = self.starts[cells + some + 1].ravel() - starts
            ends = np.cumsum(n)
            # Postings of all these blocks, term by term, so that an entry's products are added in the order of its terms.
            postings = np.arange(ends[-1]) + np.repeat(starts - ends + n, n)
            shift = (some - np.arange(len(some))) * width
            place = self.entry[postings] - np.repeat(np.tile(shift, len(terms)), n)
            scores = np.bincount(place, np.repeat(np.repeat(weights, len(some)), n) * self.weight[postings], len(some) * width)
            hit = np.flatnonzero(scores)
            entries.append(hit + shift[hit // width])
            found.append(scores[hit])
            at, step = at + step, 2 * step
            both = np.concatenate(found)
            if len(both) >= k:
                least = float(np.partition(both, len(both) - k)[len(both) - k])
        entry, cosine = np.concatenate(entries), np.round(np.concatenate(found), 9)
        some = cosine >= np.round(least, 9)
        return entry[some], cosine[some], min(at, len(order))


def votes(index: Index, terms: np.ndarray, weights: np.ndarray, k: int, own: int | None = None) -> tuple[float | None, int, float]:
    """The share of toxic votes, the nearest entry and its cosine; ``own``: the label of an example that is left out of its own entry."""
    entry, cosine, _ = index.nearest(terms, weights, k)
    n, toxic = index.n[entry].astype(float), index.toxic[entry].astype(float)
    if own is not None:
        same = cosine >= 1 - 1e-7
        same &= np.cumsum(same) == 1
        n[same] -= 1
        toxic[same] -= own
    some = n > 0
    if not some.any():
        return None, -1, 0.0
    near = 1 / (np.sqrt(np.maximum(0, 2 - 2 * cosine[some])) + 0.05) ** 2
    first = int(np.lexsort((entry, -cosine))[0])
    return float((near * toxic[some] / n[some]).sum() / near.sum()), int(entry[first]), float(cosine[first])


def _logit(share: float) -> float:
    return log((share + 0.01) / (1.01 - share))


def curve(shares: list[float], toxic: list[int], n: list[int]) -> tuple[float, float]:
    """Slope (above 0) and offset of the logistic curve from votes to labels, by Newton's method on smoothed targets."""
    x, y, m = np.array([_logit(s) for s in shares]), np.array(toxic, float), np.array(n, float)
    one, all_ = y.sum(), m.sum()
    if not 0 < one < all_:
        return 1.0, 0.0
    target = y * (one + 1) / (one + 2) + (m - y) / (all_ - one + 2)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        gap, w = m * p - target, m * p * (1 - p) + 1e-9
        g, h = np.array([(gap * x).sum(), gap.sum()]), np.array([[(w * x * x).sum() + 1e-6, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        move *= min(1.0, 2 / max(np.abs(move).max(), 1e-12))
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-10:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


@dataclass
class Classifier:
    """Vocabulary, index and curve; all of a size that the settings bound."""

    vocabulary: Vocabulary
    index: Index
    nearest: int
    share: float  # of toxic examples, for texts without a vector
    slope: float = 1.0
    offset: float = 0.0

    def score(self, text: str) -> tuple[float, int, float]:
        """The probability, the nearest entry (or -1) and its cosine."""
        terms, weights = self.vocabulary.vector(text)
        if not len(terms):
            return self.share, -1, 0.0
        key = terms.tobytes() + weights.tobytes()
        memo = self.__dict__.setdefault("memo", Memo(32 << 20, 1024))
        found = memo.new.get(key) or memo.old.get(key)
        if found is None:
            share, entry, cosine = votes(self.index, terms, weights, self.nearest)
            found = (self.share if share is None else 1 / (1 + exp(-self.slope * _logit(share) - self.offset)), entry, cosine)
        memo.put(key, found, len(key))
        return found


def _examples(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """id__, text__, toxic__ of at most ``s.examples`` labelled ids; a written table."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).where(~held_out(id_col)).groupBy(F.col(id_col).alias("id__")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic__"))
    taken = known.orderBy(F.xxhash64("id__"), "id__").limit(s.examples)
    texts = docs.select(F.col(id_col).alias("id__"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text__"))
    return written(texts.join(F.broadcast(taken), "id__").groupBy("id__").agg(F.min("text__").alias("text__"), F.first("toxic__").alias("toxic__")), "examples")


def _vocabulary(examples: DataFrame, n: int, toxic: int, s: Settings) -> Vocabulary:
    """The terms of most evidence, each task's counts added up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            terms = list(counts[0])
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(list(counts[0].values()), pa.int64()), pa.array([counts[1][t] for t in terms], pa.int64())], names=["term", "df", "df1"])
            counts[0].clear()
            counts[1].clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = {t for w in words(text) for t in _terms(w)}
                counts[0].update(terms)
                if label:
                    counts[1].update(terms)
                if len(counts[0]) > 300_000:
                    yield rows()
        yield rows()

    counted = examples.select("text__", "toxic__").mapInArrow(run, "term string, df long, df1 long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("df1").alias("df1"))
    df, df1 = F.col("df"), F.col("df1")
    part = lambda seen, rows, of: F.when(seen > 0, seen * F.log(seen * F.lit(float(n)) / (rows * F.lit(float(of))))).otherwise(0.0)
    ratio = 2 * (part(df1, df, toxic) + part(df - df1, df, n - toxic) + part(toxic - df1, n - df, toxic) + part(n - toxic - df + df1, n - df, n - toxic))
    best = counted.where((df >= s.least_documents) & (df < n)).withColumn("ratio", F.round(ratio, 6)).where(F.col("ratio") >= s.evidence).orderBy(F.desc("ratio"), "term").limit(s.terms).collect()
    return Vocabulary([r.term for r in best], [1 + log((1 + n) / (1 + r.df)) for r in best])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> Classifier:
    """Fits a classifier on labels (columns ``id_col`` and toxic) of the rows that aren't held out."""
    s, context = settings, docs.sparkSession.sparkContext
    examples = _examples(docs, labels, s, id_col, text_col)
    n, toxic = examples.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic__"), F.lit(0))).first()
    vocabulary = _vocabulary(examples, n, toxic, s)
    shared = context.broadcast((list(vocabulary.number), vocabulary.idf[:-1].tolist()))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(*shared.value)
        for batch in batches:
            made = [own.vector(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([x[k].tobytes() for x in made], pa.binary()) for k in (0, 1))], names=["id__", "toxic__", "terms", "weights"])

    schema = StructType([examples.schema["id__"], *StructType.fromDDL("toxic__ int, terms binary, weights binary").fields])
    made = written(examples.select("id__", "text__", "toxic__").mapInArrow(vectors, schema), "vectors").where(F.length("terms") > 0)
    # No more rows than examples, and no more terms in each than the vocabulary has.
    rows = made.groupBy("terms", "weights").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic__").alias("toxic"), F.min("id__").alias("id")).collect()
    index = Index([(np.frombuffer(r.terms, np.int64), np.frombuffer(r.weights)) for r in rows], [r.n for r in rows], [r.toxic for r in rows], [r.id for r in rows], len(vocabulary.number) + 1, s.block)
    fitted = context.broadcast(index)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, weights, toxic, n = (c.to_pylist() for c in batch.columns)
            shares = [votes(fitted.value, np.frombuffer(t, np.int64), np.frombuffer(w), s.nearest, y)[0] for t, w, y in zip(terms, weights, toxic, strict=True)]
            rounded = pa.array([None if x is None else round(x, 6) for x in shares], pa.float64())
            yield pa.RecordBatch.from_arrays([rounded, pa.array([y * k for y, k in zip(toxic, n, strict=True)], pa.int64()), batch.column(3)], names=["share", "toxic", "n"])

    each = made.groupBy("terms", "weights", F.col("toxic__").alias("toxic")).agg(F.count(F.lit(1)).alias("n"))
    each = each.repartition(max(32, 4 * context.defaultParallelism))  # few bytes, but a search for each row
    pairs = each.mapInArrow(left_out, "share double, toxic long, n long").where(F.col("share").isNotNull()).groupBy("share").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).collect()
    slope, offset = curve([r.share for r in pairs], [r.toxic for r in pairs], [r.n for r in pairs])
    return Classifier(vocabulary, index, s.nearest, (toxic + 0.5) / (n + 2), slope, offset)


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and as evidence the nearest entry: an example's id, the cosine, its examples and toxic ones."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    keep = [F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out")]
    kind = docs.select(keep[0]).schema["doc_id"].dataType.simpleString()

    def make():
        c = shared.value

        def columns(batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
            rows = [c.score(t) for t in texts]
            scores, entries = np.array([r[0] for r in rows]), [r[1] for r in rows]
            at = lambda values, none: [values[e] if e >= 0 else none for e in entries]
            return [
                pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(at(c.index.ids, None), batch.schema.field(0).type), pa.array([r[2] for r in rows]),
                pa.array(at(c.index.n.tolist(), 0), pa.int64()), pa.array(at(c.index.toxic.tolist(), 0), pa.int64()),
            ]

        return columns

    return with_columns(docs, text_col, make, f"score double, predicted int, nearest_id {kind}, similarity double, nearest_n long, nearest_toxic long", keep)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Learns from the labelled rows that aren't held out and scores all rows."""
    return score(docs, train(docs, labels, id_col, text_col, settings), id_col, text_col)
