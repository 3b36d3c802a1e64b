import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tidemill.llm import alignment as m
from tidemill.llm import queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.fixture(scope="module")
def plain():
    """The contract word by word, on lists of texts."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    level = {ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0]: b for b in range(128)}
    for c in map(chr, range(128, 0x800)):  # two bytes each, so that every byte of such characters is met
        level |= dict(zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0], c.encode(), strict=True))
    for c in map(chr, [*range(0x800, 0xD800, 64), *range(0xE000, 0x10000, 64), *range(0x10000, 0x110000, 4096)]):
        level |= dict(zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0], c.encode(), strict=True))

    def tokens(text):
        if not text:
            return [], []
        a = [(i, bytes(level[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()) for i in second.encode(text)]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == whole else ([], [])

    def spans(side):
        at, out = 0, []
        for i, x in side:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    def run(texts):
        rows, counts = [], Counter()
        for text in texts:
            a, b = map(spans, tokens(text))
            cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
            groups, low = [], 0
            for cut in cuts:
                groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in (a, b)))
                low = cut
            links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
            counts.update(links)
            rows.append((len(a), len(b), groups, links))
        most = defaultdict(int)
        for (_, j), n in counts.items():
            most[j] = max(most[j], n)
        return [
            (n_a, n_b, len(g), len(k), sum(counts[x] == most[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "")
            for n_a, n_b, g, k in rows
        ], counts, most

    return run


TEXTS = [
    "A plain sentence, and another one.", "A plain sentence, and another one.", "", None, " ", "  two  spaces ", "\ttab\nline\r\n\n\nlines\n", "<|endoftext|> and <s></s><unk> <0x0A>", "▁ is taken",
    "das größte Übermaß, élève, niño", "漢字とかな交じり文", "😀👍🏽 ​ x", "a", "\x00\x1c nul", "x" * 3000, "http://www.example.com/a_b?c=1234567890", "    code(indented)\n        more", "antidisestablishmentarianism " * 40,
]


@pytest.mark.parametrize("head", [m.HEAD, 40, 0])
def test_equals_plain_version(spark, plain, head):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(12)
    texts = TEXTS + [r.text[:700] for r in docs.collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n_a", "2 AS pairs", "3 AS row__", "4 AS pair").repartition(5)
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in m.cross_align(df, A, B, head=head).collect()}
    want, _, _ = plain(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert want[2][0] == want[3][0] == want[8][0] == 0 < want[7][0]


def test_map_and_groups(spark, plain):
    df = spark.createDataFrame([(None, t) for t in TEXTS], "doc_id long, text string")
    aligned = m.align(df, A, B, with_groups=True)
    _, counts, most = plain(TEXTS)
    assert {(r.a_id, r.b_id): (r.n, r.best) for r in m.cross_map(aligned, A, B).collect()} == {k: (n, n == most[k[1]]) for k, n in counts.items()}
    row = aligned.where("groups LIKE '%;%'").first()
    assert len(row.groups.split(";")) == row.n_groups and row.doc_id is None


def test_diagonal_runs():
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randrange(1, 60)
        ends = [sorted({*rng.sample(range(1, n), rng.randrange(n) if rng.random() < 0.5 else n - 1 - rng.randrange(min(n, 4))), n}) for _ in "ab"]
        a, b = ends
        stretches, link_a, link_b = m.diagonal_runs(a, b)
        groups, links = [], list(zip(link_a.tolist(), link_b.tolist(), strict=True))
        for i, j, p, q, k in stretches.tolist():
            if p == q == k:
                groups += [a[i + x] for x in range(k)]
                links += [(i + x, j + x) for x in range(k)]
                assert a[i : i + k] == b[j : j + k]
            else:
                assert k == 1 and a[i + p - 1] == b[j + q - 1]
                groups.append(a[i + p - 1])
        assert groups == sorted(set(a) & set(b))
        begin = lambda side, i: side[i - 1] if i else 0
        assert sorted(links) == [(i, j) for i in range(len(a)) for j in range(len(b)) if begin(a, i) < b[j] and begin(b, j) < a[i]]
    assert len(m.diagonal_runs([], [])[0]) == 0


def test_probing_skips_runs():
    """On a run of n tokens the number of comparisons grows with log n: a run is one stretch, found in time that C needs."""
    ends = list(range(1, 2_000_001))
    began = time.process_time()
    stretches, _, _ = m.diagonal_runs(ends, list(ends))
    assert stretches.tolist() == [[0, 0, 2_000_000, 2_000_000, 2_000_000]] and time.process_time() - began < 2


def test_packed_pairs():
    rng = np.random.default_rng(1)
    for kind in (np.uint32, np.uint64):
        lists = [np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint64)).astype(kind) for n in (0, 5, 1, 0, 300)]
        keys, starts = np.concatenate(lists), np.cumsum([0, *map(len, lists)])
        times = rng.integers(1, 1 << 31, len(keys)).astype(np.uint32)
        got = m.unpacked(m.packed(keys, times, starts), kind)
        assert all((x == y).all() for x, y in zip(got, (keys, times, starts), strict=True))


def test_counts_in_parts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(m.cross_align(docs, A, B).collect())
    monkeypatch.setattr(m, "COUNTED", 500)
    monkeypatch.setattr(m, "AT_ONCE", 2000)
    assert sorted(m.cross_align(docs.repartition(3), A, B).collect()) == want


def test_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert m.cross_align(empty, A, B).count() == 0
    nulls = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in m.cross_align(nulls, A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_query(spark):
    rows = queries.op13_cross_alignment(spark, "/root/testdata/sf0.01")
    assert rows.columns[0] == "doc_id" and set(rows.columns) == {"doc_id", *FIELDS}
    n, bad, best, links = rows.agg(F.count(F.lit(1)), F.count(F.when(F.expr("n_a = 0 OR n_links <> n_a + n_b - n_groups OR n_best > n_links"), 1)), F.sum("n_best"), F.sum("n_links")).first()
    assert n == 1000 and bad == 0 and best > 0.7 * links
