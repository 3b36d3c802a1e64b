import math
import random
import re
from collections import Counter

import zstandard
from pyspark.sql import functions as F

from tidemill.llm import quality as m
from tidemill.llm import queries

SF = "/root/testdata/sf0.001"


def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside), failed


def test_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op3_quality_rules(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = _base(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
        ratio, failure = _bands(docs[r.doc_id])
        assert r.ratio == ratio and (r.band_failure or "") == failure and r.kept == (not base[5] and not failure)


def _bands(text):
    """The plain version's ratio and verdict, with the limits written out."""
    limits = {128: (0, 1.65), 256: (0.97, 1.8), 512: (1.0, 2.07), 1024: (1.28, 2.26), 2048: (1.32, 2.42), 4096: (1.36, 2.71), 16384: (1.38, 3.1), 65536: (1.38, 3.6)}
    data, squeeze = text.encode(), zstandard.ZstdCompressor(level=3)

    def said(part, classes):
        low, high = limits[max(c for c in classes if c <= len(part))] if len(part) >= min(classes) else (0, math.inf)
        ratio = len(part) / len(squeeze.compress(part))
        return "incompressible" if ratio < low else "repetitive" if ratio > high else ""

    failure = said(data, limits)
    chunks = [data[i : i + 4096] for i in range(0, len(data), 4096)] if len(data) > 4096 else []
    chunks = [c for c in chunks if len(c) >= 1024]
    bad = sum(len(c) for c in chunks if said(c, [1024, 2048, 4096]))
    if not failure and bad > 0.3 * sum(map(len, chunks)):
        failure = "chunks"
    return (len(data) / len(squeeze.compress(data)) if data else 0.0), failure


def test_bands_leave_labelled_prose_alone_and_change_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = m.quality(docs).join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id", "left").where("NOT base_failed")
    n = {r.quality: (r.n, r.bad) for r in rows.groupBy("quality").agg(F.count("*").alias("n"), F.count("band_failure").alias("bad")).collect()}
    assert n[1][1] <= 0.002 * n[1][0]
    assert n[0][1] >= 0.1 * n[0][0]


def test_limits_of_one_half_hold_in_the_other(spark):
    """Limits are no tighter than one half of the labelled texts gives; what they do is measured in the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = m.quality(docs).join(docs.select("doc_id", F.octet_length("text").alias("n")), "doc_id").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    rows = rows.where("NOT base_failed").withColumn("half", F.expr("crc32(cast(doc_id AS string)) % 2")).select("half", "n", "ratio", "quality", "band_failure").toPandas()
    edges = [*(b[0] for b in m.Bands().whole), 1 << 60]
    for (least, _, most), end in zip(m.Bands().whole, edges[1:]):
        some = rows[(rows.half == 0) & (rows.quality == 1) & (rows.n >= least) & (rows.n < end)]
        assert not len(some) or most >= round(1.05 * some.ratio.max(), 2) - 0.001
    other = rows[rows.half == 1]
    good, bad = (other[other.quality == q].band_failure.notna() for q in (1, 0))
    assert len(good) > 1500 and good.sum() == 0 and bad.mean() > 0.1


def test_contract_columns_come_first(spark):
    assert queries.op3_quality_rules(spark, SF).columns[:8] == "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()


def test_cases_and_bands(spark):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000))
    noise = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") + (" " if i % 60 == 59 else "") for i in range(20_000))
    almost = " ".join(f"item {i} costs" for i in range(3000))
    texts = {1: prose, 2: noise, 3: almost, 4: None, 5: "", 6: "a b\na b\n \n\t\x0b", 7: "a b c d e f a b c d e", 8: prose[:8000] + " " + noise * 2}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string").selectExpr("*", "'q' AS n_words", "1 AS kept")
    got = {r.doc_id: r for r in m.quality(df).collect()}
    for i, t in texts.items():
        assert tuple(got[i])[1:6] == _base(t or "")[:5]
    assert {i: got[i].band_failure for i in (1, 2, 3)} == {1: None, 2: "incompressible", 3: "repetitive"}
    assert got[8].band_failure == "incompressible" or got[8].band_failure == "chunks"
    half = prose[:12_000] + " " + noise[:8000]
    assert m.quality(spark.createDataFrame([(1, half)], "doc_id int, text string")).first().band_failure == "chunks"
    kept = m.keep_good(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]
    assert m.quality(df.limit(0)).count() == 0
