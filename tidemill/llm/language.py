"""Language identification by Bayesian fusion of evidence.

Texts give log likelihoods from byte trigrams, hashed into a fixed number of
cells, whose counts by language are taken over all labelled documents. The
declared markup language and the address suffix have their own likelihoods: how
often each value stands with each language that the text alone suggests. A host's
prior is smoothed towards that of its domain, this towards that of its suffix,
and this towards that of all rows; all are grouped counts of the rows whose text
and declarations suggest the language, and a row's own count is left out. Domains
and suffixes add up the counts of their hosts, so rows meet a table only by host
and by suffix. A key that holds more than a ``HOT``-th of all rows is broadcast;
its rows, and rows without a key, aren't shuffled (``shared.joined``).

Rows with null or empty text have no text evidence; with no evidence at all they
get the overall prior. A null label is not used in training. Null or odd
addresses have no host and take the overall prior. Repeated rows count each time.
An empty table gives an empty result, whatever is there to train on; without
training data the language is null. Whole texts are used. Markup is taken away only
where a row is said to be markup, so plain text keeps whatever stands between ``<``
and ``>``. A row that was counted in training can name its label, and its own
trigrams are left out of that label's likelihood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.shared import joined, scratch, with_columns, written

CELLS = 1 << 15
_HIDDEN = re.compile(r"<(?:(script|style)\b|!--)", re.I)
_ENDS = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "!--": re.compile("-->"), "tag": re.compile(">")}


def strip_markup(html: str) -> str:
    """The text between the tags; scripts, styles and comments go.

    One pass: an end that isn't found from some place on isn't looked for again. What has no end of its own kind is a tag up
    to the next ``>``, and text without one.
    """
    out, at, missing = [], 0, set()
    while (start := html.find("<", at)) >= 0:
        hidden = _HIDDEN.match(html, start)
        kinds = ["tag"] if not hidden else [(hidden[1] or "!--").lower(), "tag"]
        for kind in kinds:
            end = None if kind in missing else _ENDS[kind].search(html, hidden.end() if kind != "tag" else start)
            if end:
                break
            missing.add(kind)
        if not end:
            break
        out += [html[at:start], " "]
        at = end.end()
    return "".join([*out, html[at:]])


def _cells(text: str) -> np.ndarray:
    """A cell for each trigram of the bytes of the lower-cased words, with a space on either side."""
    data = np.frombuffer(b" %s " % b" ".join(text.lower().encode("utf-8", "surrogatepass").split()), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int64)
    mixed = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    return ((mixed * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", most_labels: int = 200) -> tuple[list[str], np.ndarray]:
    """Languages and how often they have each cell, languages x CELLS. Each task counts for itself; as many rows are shuffled as languages and cells, for each task.

    More than ``most_labels`` labels are an error: a task holds a quarter of a megabyte for each.
    """
    source = docs.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    if source.select("lang").distinct().limit(most_labels + 1).count() > most_labels:
        raise ValueError(f"more than {most_labels} values in {label_col}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(CELLS, np.int64)
                sums[lang] += np.bincount(_cells(text), minlength=CELLS)
        for lang, n in sums.items():
            own = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own), pa.array(n[own])], names=["lang", "cell", "n"])

    # Bounded: a row for each language and cell.
    found = source.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), CELLS), np.int64)
    for i, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        counts[i, own["cell"].to_numpy()] += own["n"].to_numpy()
    return langs, counts


def _text_scores(langs: list[str], counts: np.ndarray, temper: int):
    """Sums of log likelihoods; beyond ``temper`` trigrams they are scaled down, as neighbours are not independent."""

    def make():
        totals = counts.sum(1) + 0.5 * CELLS
        likelihood = (np.log(counts + 0.5) - np.log(totals)[:, None]).T.copy()
        place = {lang: i for i, lang in enumerate(langs)}

        def one(text: str, markup: bool, label: str | None) -> list[float]:
            cells = _cells(strip_markup(text) if markup else text)
            if not len(cells):
                return [0.0] * len(langs)
            n = np.bincount(cells, minlength=CELLS)
            score = n @ likelihood
            i = place.get(label)
            if i is not None:  # as if it had been trained without this row
                own = np.flatnonzero(n)
                score[i] = n[own] @ np.log(np.maximum(0, counts[i, own] - n[own]) + 0.5) - len(cells) * np.log(max(totals[i] - len(cells), 0.5 * CELLS))
            return ((score - score.max()) * min(1.0, temper / len(cells))).tolist()

        def columns(batch: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
            markup, label = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("markup__", "label__"))
            return [pa.array([one(*row) for row in zip(texts, markup, label, strict=True)], pa.list_(pa.float64()))]

        return columns

    return make


def _best(scores: Column) -> Column:
    """The place of the largest score, the first of equals."""
    return F.array_position(scores, F.array_max(scores)).cast("int")


def _log_counts(counts: list[Column], prior: list[Column], weight: float) -> list[Column]:
    total = reduce(lambda a, b: a + b, counts)
    return [(n + weight * p) / (total + weight) for n, p in zip(counts, prior, strict=True)]


def identify(
    rows: DataFrame, langs: list[str], counts: np.ndarray, text_col: str = "text", url_col: str = "url", declared_col: str = "declared", keep: tuple[str, ...] = ("doc_id",),
    weight: float = 20.0, temper: int = 200, markup_col: str | None = None, label_col: str | None = None,
) -> DataFrame:
    """``keep``, lang, posterior, text_lang, declared, host for each row, by what train() counted.

    markup_col: says which rows are markup (null: isn't); without it none is.
    label_col: the label under which train() counted the row's text, null where it didn't; without it none was.
    weight: how many rows' worth the more general prior counts in the more special one.
    """
    if not langs:
        return rows.select(*keep, *(F.lit(None).cast(k).alias(n) for n, k in (("lang", "string"), ("posterior", "double"), ("text_lang", "string"), ("declared", "string"), ("host", "string"))))
    n = len(langs)
    host = F.lower(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    markup = F.coalesce(F.col(markup_col), F.lit(False)) if markup_col else F.lit(False)
    label = (F.col(label_col) if label_col else F.lit(None)).cast("string")
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(declared_col), F.when(markup, F.regexp_extract(text_col, r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1))), r"^([A-Za-z]{2,3})(?:$|[-_])", 1))
    kept = [F.col(k).alias(f"keep{i}__") for i, k in enumerate(keep)]
    named = [*kept, host.alias("host"), declared.alias("declared"), markup.alias("markup__"), label.alias("label__")]
    scored = with_columns(rows, text_col, _text_scores(langs, counts, temper), "scores array<double>", named).drop("markup__", "label__")
    scored = scored.withColumns({"host": F.nullif(F.coalesce("host", F.lit("")), F.lit("")), "declared": F.nullif(F.coalesce("declared", F.lit("")), F.lit(""))})
    parts = F.split("host", r"\.")
    scored = scored.withColumns({
        "suffix": F.when(F.size(parts) > 1, F.element_at(parts, -1)), "domain": F.when(F.size(parts) > 1, F.concat_ws(".", F.slice(parts, -2, 2))),
        "text_best": F.when(F.array_max("scores") > F.array_min("scores"), _best(F.col("scores"))),
    })
    folder = scratch(rows.sparkSession)
    scored = written(scored, "text", folder)

    def votes(by: str) -> list[Column]:
        """How many rows each language has."""
        return [F.count(F.when(F.col(by) == i + 1, 1)) for i in range(n)]

    def values(key: str) -> DataFrame:
        """A row for each value; its counts are null if no text suggests a language."""
        seen = F.when(F.count("text_best") > 0, F.array(*votes("text_best"))).alias(f"{key}_n")
        return written(scored.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n__"), seen), f"values_{key}", folder)

    at = lambda name, i: F.coalesce(F.col(name)[i], F.lit(0))

    def likelihoods(name: str) -> list[Column]:
        """P(value | language) up to a factor that languages share; a value never seen says nothing."""
        return [F.when(F.col(name).isNull(), 0.0).otherwise(F.log((at(name, i) + 0.5) / (F.lit(float(totals[i])) + 0.5 * n))) for i in range(n)]

    *totals, n_rows = scored.agg(*votes("text_best"), F.count(F.lit(1))).first()
    # Two or three letters: fewer than 20,000 declared values.
    with_values = joined(scored, values("suffix"), "suffix", n_rows).join(F.broadcast(values("declared").drop("n__")), "declared", "left")
    fused = F.array(*(F.col("scores")[i] + a + b for i, (a, b) in enumerate(zip(likelihoods("declared_n"), likelihoods("suffix_n"), strict=True))))
    informed = F.col("text_best").isNotNull() | F.col("declared_n").isNotNull() | F.col("suffix_n").isNotNull()
    fused = written(with_values.withColumn("fused", fused).withColumn("vote", F.when(informed, _best(F.col("fused")))).drop("declared_n", "suffix_n"), "fused", folder)
    overall = fused.agg(*votes("vote")).first()
    hosts = fused.where(F.col("host").isNotNull()).groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).alias("rows__"), F.array(*votes("vote")).alias("host_n"))
    hosts = written(hosts, "hosts", folder)
    n_hosts = hosts.count()
    for key in ("domain", "suffix"):
        sums = F.array(*(F.sum(F.col("host_n")[i]) for i in range(n))).alias(f"{key}_n")
        general = hosts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n__"), sums)
        hosts = written(joined(hosts, written(general, key, folder), key, n_hosts), f"hosts_{key}", folder)
    out = joined(fused, hosts.drop("domain", "suffix").withColumnRenamed("rows__", "n__"), "host", n_rows)
    own = [F.when(F.col("vote") == i + 1, 1).otherwise(0) for i in range(n)]
    prior = [(F.lit(overall[i]) - own[i] + 1.0) / (F.lit(sum(overall) + n) - F.col("vote").isNotNull().cast("int")) for i in range(n)]
    for key in ("suffix", "domain", "host"):
        prior = _log_counts([F.greatest(F.lit(0), at(f"{key}_n", i) - own[i]) for i in range(n)], prior, weight)
        out = out.withColumn(f"{key}_p", F.array(*prior))
        prior = [F.col(f"{key}_p")[i] for i in range(n)]
    out = out.withColumn("total", F.array(*(F.col("fused")[i] + F.log(prior[i]) for i in range(n)))).withColumn("best", _best(F.col("total")))
    names = F.array(*map(F.lit, langs))
    top = F.array_max("total")
    share = 1 / F.aggregate("total", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return out.select(*(F.col(f"keep{i}__").alias(k) for i, k in enumerate(keep)), F.get(names, F.col("best") - 1).alias("lang"), F.round(share, 6).alias("posterior"), F.get(names, F.col("text_best") - 1).alias("text_lang"), "declared", "host")
