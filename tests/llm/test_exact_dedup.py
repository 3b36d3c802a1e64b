import random

import pytest

from tests.oracle import same_rows
from tidemill.llm import exact_dedup as m
from tidemill.llm import queries as q


def test_sql(spark):
    same_rows(q.op5_exact_dedup(spark, "/root/testdata/sf0.001"), q.ORACLE_SQL["op5_exact_dedup"], "/root/testdata/sf0.001")


def test_grace_recursion_with_equal_hashes():
    rng = random.Random(1)
    records = [(7 if rng.random() < 0.5 else rng.getrandbits(64), i, bytes([rng.randrange(40)]) * 900) for i in range(400)]
    records = [(7 if c[0] % 2 else hash(c) & (2**63 - 1), i, c) for _, i, c in records]
    got = dict(m.grace(records, 3000))
    by = {}
    for _, i, c in records:
        by.setdefault(c, set()).add(i)
    assert len(got) == len(records)
    for members in by.values():
        assert len({got[i] for i in members}) == 1
    assert len(set(got.values())) == len(by)


@pytest.mark.parametrize("memory", [1, 1 << 20])
def test_cases(spark, memory):
    rows = [(1, "a b"), (2, "ab "), (2, "ab "), (3, None), (4, " \n"), (None, "ab  c"), (5, "abc"), (6, "x" * 300_000), (7, "x" * 300_000 + "\t"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS group_size", "'z' AS row__", "2 AS doc")
    got = sorted(tuple(r)[:4] for r in m.exact_dedup(df, memory=memory).selectExpr("coalesce(doc_id, -1)", "coalesce(keep_id, -1)", "group_size", "kept").collect())
    want = [(1, 1, 3, True), (2, 1, 3, False), (2, 1, 3, False), (3, 4, 3, False), (4, 4, 3, True), (-1, -1, 2, True), (5, -1, 2, False), (6, 7, 2, False), (7, 7, 2, True), (-1, 4, 3, False)]
    assert got == sorted(want)
    whole = m.exact_dedup(df, whole_rows=True, memory=memory).where("kept").select("doc.*")
    assert whole.columns == df.columns and whole.count() == 4
    left = m.drop_copies(df, memory=memory)
    assert sorted(map(repr, left.collect())) == sorted(map(repr, whole.collect()))
    assert m.exact_dedup(df.limit(0)).count() == m.drop_copies(df.limit(0)).count() == 0
