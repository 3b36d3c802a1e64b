import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tidemill.llm import maxent as m
from tidemill.llm import queries

SF = "/root/testdata/sf0.001"


def _base(docs):
    cut = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or "")) + [None] for i, t in docs.items()}
    held = {i: crc32(str(i).encode()) % 5 == 1 for i in docs}
    counts = Counter(w for i, words in cut.items() if not held[i] for w in words)
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, w in cut.items()}


@pytest.mark.parametrize("head", [20, 100_000])
def test_base_against_brute_force_and_held_out_gain(spark, head):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = _base({r.doc_id: r.text for r in table.collect()})
    rows = (queries.op4_maxent_scores(spark, SF) if head > 20 else m.score(table, settings=m.Settings(head=max(head, m.OWN)))).collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and math.isclose(r.base_score, w[4], rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    s = m.Settings(class_rows=64, slot_rows=64)
    mass = rng.random(64) + 0.1
    w = m.Weights(s, mass, rng.normal(size=(64, 8)).astype(np.float32), rng.normal(size=(64, 8)).astype(np.float32))
    f = np.repeat(rng.integers(0, 2**63, (3, 1)).astype(np.uint64), 64, 1)
    p = np.exp(w.gain(f, np.arange(64))) * mass / mass.sum()
    assert abs(p.sum() - 1) < 1e-4


def test_learns_a_sequence():
    s = m.Settings(class_rows=1024, slot_rows=1024, batch=512)
    own = {b"a": 0, b"b": 9, b"c": 18, m.END: 27}
    w = m.Weights(s, np.ones(64))
    _, starts, hashes, slot, _ = m.Vocabulary(own, own).read(["a b c " * 600])
    f = w.features(hashes, starts)
    touched = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    for _ in range(10):
        for i in range(0, len(slot), 512):
            w.learn(f[:, i : i + 512], slot[i : i + 512], touched)
    assert w.gain(f, slot).mean() > 2.7  # of log(64) = 4.2


def test_frequent_words_have_slots_of_their_own_and_are_learned():
    words = [b"w%d" % i for i in range(150)]
    s = m.Settings(class_rows=4096, slot_rows=4096, batch=512)
    own = {w: i for i, w in enumerate([m.END, *words])}
    _, starts, hashes, slot, _ = m.Vocabulary(own, own).read([b" ".join(words * 12).decode()])
    f = m.Weights.features(hashes, starts)
    assert len(set(slot.tolist())) == 151 < m.OWN < m.SLOTS * m.CLASSES and m.Settings().slot_rows >= 65536
    w, touched = m.Weights(s, np.ones(m.SLOTS * m.CLASSES)), (np.zeros(4096, np.int64), np.zeros(4096, np.int64))
    for _ in range(40):
        for i in range(0, len(slot), 512):
            w.learn(f[:, i : i + 512], slot[i : i + 512], touched)
    assert w.gain(f, slot).mean() > 3.5  # of log(256) = 5.5


def test_vocabulary_finds_all_of_the_head():
    head = {b"w%d" % i: i + 1 for i in range(5000)}
    own = {b"w%d" % i: i for i in range(m.OWN)}
    words, starts, hashes, slots, counts = m.Vocabulary(own, head).read([" ".join(f"w{i}" for i in range(9000)), ""])
    assert counts.tolist() == [i + 1 if i < 5000 else 0 for i in range(9000)] + [0, 0] and starts.tolist() == [0, 9001, 9002]
    assert slots[: m.OWN].tolist() == list(range(m.OWN)) and slots[m.OWN :].min() >= m.OWN


def _plain_scores(docs, s):
    """Log10 gains over the unigram token by token: the same hashed model with its gradients summed over a round."""
    k1, k2, k3, k4, two = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 2**64
    side, lists = m.SLOTS, {i: m.tokens(t) for i, t in docs.items()}
    training = [i for i in docs if crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for i in training for w in lists[i])
    own = {w: k for k, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: m.OWN])}
    signed = lambda h: h - two if h >> 63 else h
    hashed = lambda w: xxh64_intdigest(w, 42)
    slot = lambda w: own[w] if w in own else m.OWN + signed(hashed(w)) % (side * m.CLASSES - m.OWN)
    mass = np.full(side * m.CLASSES, 0.5)
    for w, n in counts.items():
        mass[slot(w)] += n + 0.5
    by_class = mass.reshape(m.CLASSES, side)
    biases = [np.log(by_class.sum(1) / mass.sum()), np.log(by_class / by_class.sum(1, keepdims=True))]
    weights = [np.zeros((n, side)) for n in (s.class_rows, s.slot_rows)]
    seen = [np.zeros(len(w)) for w in weights]

    def events(words):
        past = [0, 0]
        for w in words:
            f = [past[-1] * k1 % two, past[-1] * k2 % two ^ past[-2] * k3 % two, (past[-2] * k2 + k1) % two]
            f = [(x ^ x >> 29) * k3 % two for x in f]
            of, within = divmod(slot(w), side)
            rows = [x >> 40 & s.class_rows - 1 for x in f], [((x ^ of * k4 % two) * k1 % two) >> 40 & s.slot_rows - 1 for x in f]
            yield rows, (of, within), (biases[0], biases[1][of])
            past += [hashed(w)]

    def softmax(bias, rows, w):
        z = np.exp(bias + w[rows].sum(0))
        return z / z.sum()

    for r in range(s.rounds):
        total, n = [np.zeros_like(w) for w in weights], [np.zeros(len(w)) for w in weights]
        for i in training:
            if signed(xxh64_intdigest(docs[i].encode(), 42)) % s.rounds == r:
                for rows, target, bias in events(lists[i]):
                    for k in (0, 1):
                        g = -softmax(bias[k], rows[k], weights[k])
                        g[target[k]] += 1
                        for row in rows[k]:
                            total[k][row] += g
                            n[k][row] += 1
        for k in (0, 1):
            seen[k] += n[k]
            weights[k] += (s.rate / np.sqrt((s.calm + n[k]) * (s.calm + seen[k])))[:, None] * total[k]
    out = {}
    for i, words in lists.items():
        out[i] = sum(math.log10(softmax(bias[k], rows[k], weights[k])[target[k]]) - bias[k][target[k]] / math.log(10) for rows, target, bias in events(words) for k in (0, 1))
    return out


def test_scores_against_plain_version(spark):
    docs = {r.doc_id: r.text[:1500] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()}
    s = m.Settings(class_rows=512, slot_rows=1024, rounds=2)
    want = _plain_scores(docs, s)
    rows = m.score(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), settings=s).collect()
    assert len(rows) == len(docs) and max(map(abs, want.values())) > 1
    assert all(math.isclose(r.score - r.base_score, want[r.doc_id], rel_tol=1e-3, abs_tol=1e-2) for r in rows)


def test_partitions_make_no_difference(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    s = m.Settings(class_rows=1024, slot_rows=1024, rounds=3)
    few, many = ({r.doc_id: r for r in m.score(table.repartition(n), settings=s).collect()} for n in (2, 200))
    assert len(few) == len(many) and any(abs(r.score - r.base_score) > 1 for r in few.values())
    assert all(math.isclose(r.score, many[i].score, rel_tol=1e-5, abs_tol=1e-3) for i, r in few.items())


def test_long_frequent_tokens_are_in_the_head(spark):
    """A long token that stands everywhere has a slot of its own, and its rows aren't joined."""
    long = "-" * 5000
    rows = [(i, f"{long} w{i} {long}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _base(dict(rows))
    got = {r.doc_id: r for r in m.score(df, settings=m.Settings(class_rows=256, slot_rows=256)).collect()}
    assert all((got[i].n_known, got[i].train_tokens) == w[2:4] and math.isclose(got[i].base_score, w[4], rel_tol=1e-9) for i, w in want.items())
    key = xxh64_intdigest(long.encode(), 42)
    _, _, hashes, slots, counts = m.Vocabulary({key: 3}, {key: 77}).read([f"{long} a"])
    assert hashes[0] == key and slots[0] == 3 and counts.tolist() == [77, 0, 0]


def test_sums_over_tasks_accumulate():
    rng = np.random.default_rng(3)
    s = m.Settings(class_rows=64, slot_rows=64)
    f, slot = rng.integers(0, 2**63, (3, 5)).astype(np.uint64), np.arange(5)
    moved = []
    for tasks in (1, 240):
        w = m.Weights(s, np.ones(64))
        sums = w.sums()
        for _ in range(tasks):
            w.gradient(f, slot, sums)
        w.step(sums, (np.zeros(64, np.int64), np.zeros(64, np.int64)))
        moved.append(np.abs(w.classes).max())
    assert moved[1] > 5 * moved[0]


def test_cases(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "A a b"), (3, "b " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 AS n", "2 AS token")
    got = sorted(tuple(r)[2:5] for r in m.score(df).collect())
    train = sum(n for (i, _), n in zip(rows, [1, 1, 1, 4, 20_001]) if crc32(str(i if i is not None else "").encode()) % 5 != 1)
    assert [g[0] for g in got] == [1, 1, 1, 4, 20_001] and all(g[2] == train for g in got)
    assert m.score(df.limit(0)).count() == 0
