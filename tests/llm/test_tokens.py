import random
from zlib import crc32

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemill.llm import bpe, packing, queries, token_files
from tidemill.llm.bpe import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ROWS = [(3, "one two"), (1, None), (1, ""), (1, "same"), (1, "same"), (None, "no id"), (9, "x y z " * 9000)]


def _want(spark, end):
    library = Tokenizer.from_file(PATH)
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    return [(i, np.array([*library.encode(t, add_special_tokens=False).ids, end], "<u4")) for i, t in docs]


def test_ids_equal_the_library():
    encoder, rng = Encoder(PATH), random.Random(3)
    odd = [" ", "  ", "\n", "\n\n", " x", " y\n", "\t", "a", "b.", "'s", "don't", "1", "\xb2", "\xe9", "\xa0", "　", "\r\n", "_", "<|endoftext|>", "\x1c", "!?", "中文", "\U0001f642", "‍", "́", "\x85", "x,", "A;B", " ", "Ⅷ", "\xaa", "\xb5", "\xdf"]
    for _ in range(5000):
        s = "".join(rng.choice(odd) for _ in range(rng.randrange(12)))
        assert encoder.encode(s) == encoder._whole(s), repr(s)
    plain = ["a", "b.", " c", " d\n", "e\n", "\ng", "\n", " ", "h's", " 12"]  # white space of the plain path
    for _ in range(5000):
        s = "".join(rng.choice(plain) for _ in range(rng.randrange(12)))
        assert encoder.encode(s) == encoder._whole(s), repr(s)


def test_remembered_stretches_are_bounded():
    small = Encoder(PATH, memory=1 << 20)
    for i in range(20_000):
        small.encode(f"word{i} and {'x' * 100}{i}")
    held = [small, small.older]
    assert all(len(k) <= bpe.SHORT for m in held for k in m)
    assert sum(bpe._COST + 2 * len(k) + len(v) for m in held for k, v in m.items()) < 1.1 * (1 << 20)


def test_packing_against_brute_force(spark):
    want = dict(_want(spark, 0))
    rows = queries.op2_best_fit_packing(spark, SF).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert all(r.length == 2048 for r in parts[1:])
        assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1]]
        assert sum(r.length for r in parts) == len(want[i])
        assert all(crc32(want[i][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in parts)
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1]]
        assert sum(r.length for r in parts) <= 2048
    least = -(-sum(map(len, want.values())) // 2048)
    assert len(by_seq) <= 1.05 * least + 1


def test_rounds_use_few_bins(spark):
    rng = random.Random(5)
    sizes = [rng.randrange(1, 101) for _ in range(3000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "row__ long, length long")
    rows = packing.pack(df, capacity=100, group_rows=300, slack=1).collect()
    assert len(rows) == 3000
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [p for p, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 100
    whole = 1 + max(b for b, _ in packing.best_fit(sorted(sizes, reverse=True), 100))
    assert len(bins) <= 1.03 * whole
    assert len({r.sequence_id for r in packing.pack(df.withColumn("length", df.length * 0 + 60), capacity=100, group_rows=300).collect()}) == 3000


def test_underfull_bins_of_all_groups_meet(spark):
    """Pieces of 51 fill no bin with each other; those of 49, a third as many, go one into each of a third of the bins."""
    sizes = [51] * 3000 + [49] * 1000
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "row__ long, length long")
    rows = packing.pack(df, capacity=100, group_rows=100, slack=0).collect()
    assert len(rows) == 4000 and len({r.sequence_id for r in rows}) == 3000


def test_packing_cases(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS bin__", "3 AS text__")
    rows = packing.pack_documents(df, PATH, with_ids=True)
    assert sum(r.length for r in rows.collect()) == sum(len(Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    whole = packing.sequences(rows).collect()
    assert all(len(r.ids) == 4 * r.length <= 4 * 2048 for r in whole)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_files_against_brute_force(spark):
    want = _want(spark, 2)
    starts = np.cumsum([0, *(len(v) for _, v in want)])
    got = {r.doc_id: r for r in queries.op8_token_files(spark, SF).collect()}
    assert got.keys() == {i for i, _ in want}
    for (i, v), start in zip(want, starts, strict=False):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(v), crc32(v.tobytes()))


def test_files_cases(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS part__", "2 AS id__")
    listed = token_files.write_files(df, f"file://{tmp_path}/t", PATH, file_values=3)
    rows = sorted(token_files.read_files(listed, f"file://{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1, 1, 1, 3, 9]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    assert token_files.token_files(df.limit(0), PATH).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 50)), min_size=1, max_size=300), st.sampled_from([0.0, 0.5, 0.95, 1.0]))
def test_blocks_round_trip(values, percentile):
    v = np.array(values, "<u4")
    assert (token_files.decode_blocks(b"".join(token_files.encode_blocks(v, len(v), percentile)), [0]) == v).all()
    half = len(v) // 2
    data = token_files.encode_file([5, None], [v[:half].tobytes(), v[half:].tobytes()], 16, percentile)
    ids, starts, n = token_files.read_documents(data)
    assert ids == [5, None] and starts.tolist() == [0, half] and n == len(v)
    assert (token_files.read_values(data) == v).all() and (token_files.read_values(data, half, len(v)) == v[half:]).all()
