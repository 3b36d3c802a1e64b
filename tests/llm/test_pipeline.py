import random
import re
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from types import SimpleNamespace

from zlib import crc32

import corpus_pipeline
import public_tokenizers
import pytest
from tests.llm.test_quality import _bands, _base
from tests.llm.test_secrets import _linked
from tests.llm.test_simhash import _components
from tidemill.llm import exact_dedup, shared
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

SF = "/root/testdata/sf0.001"


def _mixed(x):
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 29) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 32


def _wide(text, width=5):
    """512 bits, set where over half the distinct shingles have them set."""
    words, golden = [xxh64_intdigest(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())], 0x9E3779B97F4A7C15
    hashes = set()
    for i in range(max(1, len(words) - width + 1)):
        total = 0
        for w in words[i : i + width]:
            total = (total * golden + w) % 2**64
        hashes.add(_mixed(total))
    bits = [_mixed(h ^ golden * k % 2**64) for k in range(1, 9) for h in hashes]
    n = len(hashes)
    return sum(1 << 64 * k + b for k in range(8) for b in range(64) if 2 * sum(x >> b & 1 for x in bits[k * n : k * n + n]) > n)


def test_against_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fine = {i for i, t in docs.items() if not _bands(t)[1] and not _base(t)[5]}
    best = {}
    for i in sorted(fine):
        key = re.sub(r"[\x20\x09-\x0D]", "", docs[i])
        if key not in best or len(docs[i]) > len(docs[best[key]]):
            best[key] = i
    ids = sorted(best.values())
    root = _components([_wide(docs[i]) for i in ids], 86)
    kept = {min(i for i, r in zip(ids, root) if r == c) for c in root}
    stage, want = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF)
        assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        want = {"quality": fine, "exact_dedup": set(ids), "near_dedup": kept, "secrets": kept}[name]
        rows = stage.collect()
        assert sorted(r.doc_id for r in rows) == sorted(want)
    assert all(len(r.text) == r.n_chars and (r.text == docs[r.doc_id]) == (not _linked(docs[r.doc_id], 300)) for r in rows)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == kept
    _packing_is_whole(packed, {r.doc_id: r.text for r in rows})


def _packing_is_whole(rows, texts):
    """Pieces hold each text's ids as the library gives them and an end, lie in sequences without gaps, and few sequences are needed."""
    library, sequences, total = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}, 0
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    for i, each in ids.items():
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(each) // 2048))) and all(r.length == 2048 for r in own[1:])
        at = 0
        for r in own:
            part = each[r.start : r.start + r.length]
            assert r.start == at and r.ids_crc32 == crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r.length
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert at == len(each)
        total += at
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.01 * total / 2048 + 1


def _made_up(spark):
    rng = random.Random(3)
    prose = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(120)) for _ in range(4)]
    near = prose[1].split()
    near[60] = "changed"
    texts = [(1, None), (1, ""), (2, prose[0]), (2, prose[0]), (None, prose[0]), (3, prose[0].replace(" ", "\n")), (4, " ".join(near)), (5, prose[1]), (6, prose[2] + "\nlogin: bob pwd: hunter22"), (None, prose[3]), (7, "w " * 30_000), (8, "b" * 60_000)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS row__", "2 AS fp__", "3 AS doc", "4 AS text__", "5 AS keys__", "6 AS n__"), prose


def test_nulls_ties_repeats_and_clashing_columns(spark):
    df, prose = _made_up(spark)
    kept = {"quality": [2, 2, 3, 4, 5, 6, None, None], "exact_dedup": [2, 4, 5, 6, None], "near_dedup": [2, 4, 6, None], "secrets": [2, 4, 6, None]}
    stage = df
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF)
        assert stage.columns == df.columns
        rows = stage.collect()
        assert sorted((r.doc_id for r in rows), key=lambda i: (i is None, i)) == kept[name], name
        assert all((r.row__, r.fp__, r.doc, r.text__, r.keys__, r.n__) == (1, 2, 3, 4, 5, 6) for r in rows)
    texts = {r.doc_id: r.text for r in rows}
    assert texts[6] == prose[2] + "\n[SECRET] [SECRET]" and texts[2] == prose[0]
    places = corpus_pipeline.pack(spark, stage, SF).collect()
    assert sorted((r.doc_id for r in places), key=lambda i: (i is None, i)) == [2, 4, 6, None] and all(r.piece == 0 for r in places)


def test_empty_table(spark):
    df, _ = _made_up(spark)
    stage = df.limit(0)
    for _, f in corpus_pipeline.STAGES:
        stage = f(spark, stage, SF)
        assert stage.count() == 0


@pytest.mark.parametrize("lists", [1, 3, shared.LISTS])
def test_dropped_rows_are_read_by_task(spark, monkeypatch, lists):
    """Many dropped rows, of several tasks that share lists or don't, none of which meet the texts in a shuffle."""
    monkeypatch.setattr(shared, "LISTS", lists)
    rows = [(i, f"text {i % 700}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    left = exact_dedup.drop_copies(df)
    assert sorted(r.doc_id for r in left.collect()) == list(range(700))
    assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()


def test_scratch_folders_are_removed_and_needed_on_a_cluster(spark, tmp_path):
    with shared.removed_after(spark):
        shared.written(spark.range(3), "t", folder := shared.scratch(spark))
        assert Path(folder.removeprefix("file://")).exists()
    assert not Path(folder.removeprefix("file://")).exists()
    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.scratch(session)


def test_jobs_in_threads_keep_their_own_folders(spark):
    """Two pipelines at once: neither removes what the other still reads. A failed step leaves nothing."""
    want = sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())
    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(lambda _: sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()), range(2)))
    assert found == [want, want]
    with pytest.raises(RuntimeError), shared.removed_after(spark):
        shared.written(spark.range(3), "t", folder := shared.scratch(spark))
        raise RuntimeError
    assert not Path(folder.removeprefix("file://")).exists()
