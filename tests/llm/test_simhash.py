import random
import re

import numpy as np
import pytest
import xxhash

from tidemill.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def _print(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, radius=4):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def _check(rows, docs):
    ids = list(docs)
    prints = [_print(docs[i] or "") for i in ids]
    root = _components(prints)
    least = {}
    for i, r in zip(ids, root):
        least[r] = min(i, least.get(r, i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert got == {i: (f"{p:016x}", least[r]) for i, p, r in zip(ids, prints, root)}


def test_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_simhash_near_dedup(spark, SF).collect()
    assert len(rows) == len(docs)
    _check(rows, docs)


def test_cases(spark):
    rows = [(5, None), (4, ""), (7, " \n"), (8, "one two"), (2, "One two"), (2, "ONE TWO"), (None, "one two"), (None, "alone here now"), (9, "\xc9 x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp__", "2 AS row__", "3 AS doc")
    got = simhash.near_dedup(df, whole_rows=True)
    seen = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got.collect())
    assert seen == sorted([(5, 4, False), (4, 4, True), (7, 4, False), (8, 2, False), (2, 2, True), (2, 2, False), (-1, 2, False), (-1, -1, True), (9, 9, True)])
    assert got.select("doc.*").columns == df.columns
    assert simhash.near_dedup(df.limit(0)).count() == 0


def _distinct_parts(got, want):
    return len(set(zip(got, want))) == len(set(got)) == len(set(want))


def _made_up(seed, bits, flips):
    rng = random.Random(seed)
    prints = [rng.getrandbits(bits) for _ in range(60)]
    for _ in range(5):  # chains, near and just too far, of common and rare blocks
        prints += [p ^ sum(1 << b for b in rng.sample(range(bits), rng.choice(flips))) for p in rng.sample(prints, 50)]
    return sorted(set(prints))


def test_trees_split_and_prune_at_given_sizes(spark):
    """The registered query's own shards of sf0.1: trees have vantage points and leave most pairs out."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    prints = simhash._numbers(docs, "text", [], simhash._narrow(4), "fp__ long").select("fp__").distinct().persist()
    shards = simhash.block_shards(prints, 4).toPandas()
    n, sizes, all_pairs, pairs, vantages = prints.count(), [], 0, 0, 0
    for _, rows in shards.groupby("shard__"):
        tree = simhash.Shard(rows.f0__.to_numpy().view(np.uint64)[:, None], 4)
        tree.roots()
        sizes.append(len(rows))
        all_pairs, pairs, vantages = all_pairs + len(rows) * (len(rows) - 1) // 2, pairs + tree.compared, vantages + tree.vantages
    assert n > 9000 and len(shards) == 5 * n and 1000 < np.median(sizes) < 4096
    assert vantages > 100 and pairs < 0.5 * all_pairs
    prints.unpersist()


def test_keys_at_every_size():
    """Any two values within the radius agree on a key; shards stay small up to ten thousand million values, keys few."""
    rng = random.Random(4)
    for n, most in ((10, 1), (4096, 1), (10**5, 5), (10**7, 5), (10**9, 15), (10**10, 35), (10**11, 35)):
        keys = simhash.block_keys(n, 4, 4096)
        bits = sum(k for _, k in keys[0])
        assert len(keys) <= most and n / 2**bits <= 4096, n
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 4])))
            assert any(all((x ^ y) >> low & (1 << k) - 1 == 0 for low, k in key) for key in keys)


@pytest.mark.parametrize("target", [1, 8, 100])
def test_small_targets_against_brute_force(spark, target):
    prints = _made_up(target, 64, [1, 3, 4, 5, 6])
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp__ long")
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(simhash.block_shards(df, 4, target), 4, 1)).collect()}
    assert _distinct_parts([roots.get(p, p) for p in prints], _components(prints))


@pytest.mark.parametrize("shard_rows", [3, 40, 16_384])
def test_links_against_brute_force(spark, shard_rows):
    prints = _made_up(shard_rows, 64, [1, 3, 4, 5, 6])
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp__ long")
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(simhash.block_shards(df, 4), 4, 1, shard_rows)).collect()}
    assert _distinct_parts([roots.get(p, p) for p in prints], _components(prints))


@pytest.mark.parametrize("shard_rows", [40, 16_384])
def test_wide_links_of_one_shard_against_brute_force(spark, shard_rows):
    """All in one shard, which rings part only in part."""
    prints = _made_up(7, 512, [10, 60, 86, 87, 100])
    words = lambda p: [int(np.uint64(p >> 64 * w & 2**64 - 1).astype(np.int64)) for w in range(8)]
    df = spark.createDataFrame([(0, i, *words(p)) for i, p in enumerate(prints)], "shard__ long, node__ long, " + ", ".join(f"f{w}__ long" for w in range(8)))
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, 86, 8, shard_rows)).collect()}
    assert _distinct_parts([roots.get(i, i) for i in range(len(prints))], _components(prints, 86))


def test_a_group_that_rings_do_not_part_makes_few_links(spark):
    """Near copies of one text, most of them linked and none nearer to a vantage point than others: links grow with their number, not its square."""
    rng, n = random.Random(6), 2000
    centre = rng.getrandbits(512)
    prints = [centre ^ sum(1 << b for b in rng.sample(range(512), 44)) for _ in range(n)]  # pairs lie around 80 apart
    prints += [centre ^ sum(1 << b for b in rng.sample(range(512), 100)) for _ in range(30)] + [rng.getrandbits(512) for _ in range(30)]
    words = lambda p: [int(np.uint64(p >> 64 * w & 2**64 - 1).astype(np.int64)) for w in range(8)]
    df = spark.createDataFrame([(0, i, *words(p)) for i, p in enumerate(prints)], "shard__ long, node__ long, " + ", ".join(f"f{w}__ long" for w in range(8)))
    found = simhash.links(df, 86, 8, 200).collect()
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(found)).collect()}
    assert _distinct_parts([roots.get(i, i) for i in range(len(prints))], _components(prints, 86))
    assert len(found) < 4 * n


@pytest.mark.parametrize(("words", "radius", "spread"), [(1, 4, 12), (8, 86, 140), (1, 4, 3), (8, 86, 60)])
def test_trees_against_brute_force(words, radius, spread):
    """Unrelated ones, and dense groups around a few centres: most are united, and some reach others only through a few."""
    rng = np.random.default_rng(spread)
    bits = 64 * words
    rows = [rng.integers(0, 2, bits) for _ in range(300)]
    for centre in rows[:3]:
        for _ in range(500):
            other = centre.copy()
            other[rng.choice(bits, rng.integers(0, spread + 1), replace=False)] ^= 1
            rows.append(other)
    prints = np.unique(np.packbits(np.array(rows, np.uint8), axis=1).view(np.uint64), axis=0)
    shard = simhash.Shard(prints, radius)
    got = shard.roots()
    near = sum(np.bitwise_count(prints[:, None, w] ^ prints[None, :, w]).astype(int) for w in range(words)) <= radius
    want = np.arange(len(prints))
    while True:
        new = np.array([want[row].min() for row in near])
        if (new == want).all():
            break
        want = new
    assert _distinct_parts(got.tolist(), want.tolist())
    assert shard.compared < len(prints) ** 2


def _jaccard(a, b, width=5):
    sets = []
    for text in (a, b):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_groups_reach_similarity(spark):
    """Edited copies at 0.85 or more are united with their source, those below 0.65 and unrelated texts aren't; hot passages don't matter."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage, rows, near, far = " ".join(word() for _ in range(40)), [], 0, 0
    for source in range(60):
        words = [word() for _ in range(300)]
        rows.append((source * 100, " ".join(words) + " " + passage))
        for copy in range(1, 4):
            other = list(words)
            for at in rng.sample(range(300), rng.choice([1, 4, 20, 30])):
                other[at] = word()
            rows.append((source * 100 + copy, " ".join(other) + " " + passage))
    texts = dict(rows)
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    for i in texts:
        alike = _jaccard(texts[i], texts[i // 100 * 100])
        if i % 100 and alike >= 0.85:
            near += 1
            assert i not in kept
        elif i % 100 == 0 or alike < 0.65 and all(_jaccard(texts[i], texts[j]) < 0.65 for j in texts if j // 100 == i // 100 and j != i):
            far += 1
            assert i in kept
    assert near > 40 and far > 80


def test_near_copies_cases(spark):
    same = "one two three four five six seven"
    rows = [(5, None), (4, ""), (7, " \n"), (8, same), (2, same.upper()), (None, same), (3, "one two"), (6, "One  two"), (9, "\xc9 x y z " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp__", "2 AS row__", "3 AS doc", "4 AS keys__")
    left = simhash.drop_near_copies(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 9]
    assert simhash.drop_near_copies(df.limit(0)).count() == 0


def test_every_pair_at_the_similarity_is_found(spark):
    """Also pairs that share none of the smallest shingle hashes, pairs at 0.8 to the shingle, chains of such, and short texts of a common passage."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage, rows = [word() for _ in range(30)], []
    for source in range(0, 80, 10):
        words = [word() for _ in range(1500)]
        each = [int(simhash.shingle_hashes(" ".join(words[i : i + 5]))[0]) for i in range(1496)]
        for step in range(3):  # a copy changes the smallest shingles of the text before it
            rows.append((source + step, " ".join(words)))
            for at in np.argsort(np.array(each, np.uint64))[:20].tolist():
                words[at + 2] = word()
            each = [int(simhash.shingle_hashes(" ".join(words[i : i + 5]))[0]) for i in range(1496)]
    for source in range(80, 200, 10):
        words = [word() for _ in range(14)]
        rows += [(source, " ".join(words)), (source + 1, " ".join(words[:12])), (source + 2, " ".join(words[:11]))]
    rows += [(200 + i, " ".join([word(), *passage, word()])) for i in range(60)]
    sets = {i: {s for s in simhash.shingle_hashes(t).tolist()} for i, t in rows}
    alike = {(i, j) for i in sets for j in sets if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    samples = {i: set(sorted(s)[:16]) for i, s in sets.items()}
    assert sum(not samples[i] & samples[j] for i, j in alike) >= 8 and (80, 81) in alike and (80, 82) not in alike
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    _, groups = simhash.near_groups(docs)
    prints = simhash.near_groups(docs)[0].select("id__", "fp__").collect()
    winner = {bytes(r.fp__): r.winner__.id for r in groups.collect()}
    of = {r.id__: winner[bytes(r.fp__)] for r in prints}
    assert len(alike) > 1700 and all(of[i] == of[j] for i, j in alike)
    assert len({of[i] for i in range(0, 80, 10)}) == 8 and len({of[i] for i in range(80, 200, 10)}) == 12


def test_prefixes_and_sketches_miss_no_similar_pair():
    rng, seen = np.random.default_rng(5), 0
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.choice([0, 0.05, 0.15])], rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)]))
        frequent = np.sort(rng.choice(a, len(a) // 2, replace=False))
        ranks = rng.integers(1, 9, len(frequent))
        differ = len(np.setxor1d(a, b))
        x, y = (np.frombuffer(simhash.parity_sketch(h), np.uint64) for h in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= differ
        assert simhash.differing(simhash.long_sketch(a), simhash.parity_sketch(b, 1024)) <= differ
        both = len(np.intersect1d(a, b))
        if len(b) and both >= 0.8 * (both + differ):
            seen += 1
            assert set(simhash.prefix(a, 0.8, frequent, ranks).tolist()) & set(simhash.prefix(b, 0.8, frequent, ranks).tolist())
    assert seen > 100
    assert not len(simhash.prefix(np.empty(0, np.uint64), 0.8, np.empty(0, np.uint64), np.empty(0, np.int64)))
