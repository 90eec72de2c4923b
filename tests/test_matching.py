import random

import pytest
from pyspark.sql import functions as F

from histora.operators import ownership


def walked(pairs, key):
    a_used, b_used, out = set(), set(), []
    for a, b, s in sorted(pairs, key=key):
        if a not in a_used and b not in b_used:
            a_used.add(a)
            b_used.add(b)
            out.append((a, b, s))
    return sorted(out)


def matched(spark, pairs, order, walked=100_000):
    df = spark.createDataFrame(pairs, "a_id long, b_id long, score double").repartition(5)
    return sorted(map(tuple, ownership.greedy_match(df, order, walked).collect()))


@pytest.fixture(autouse=True)
def checkpoints(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("most", [1, 20, 100_000])
def test_the_walks_own_result_at_every_size_of_task(spark, most):
    r = random.Random(most)
    pairs = [(a, b + 1000, r.randrange(4) / 4) for a in range(60) for b in range(60) if r.random() < 0.03 + 0.3 * (a < 8 and b < 8)]
    got = matched(spark, pairs, [F.desc("score"), F.col("a_id"), F.col("b_id")], most)
    assert got == walked(pairs, lambda x: (-x[2], x[0], x[1]))


def test_equal_scores_take_few_rounds(spark, monkeypatch):
    """10,000 equal scores of one component in less than 20 rounds, with no task that walks more than 50 pairs."""
    rounds = []
    monkeypatch.setattr(ownership.graph, "components", lambda pairs, f=ownership.graph.components: rounds.append(1) or f(pairs))
    pairs = [(a, b, 1.0) for a in range(100) for b in range(100)]
    df = spark.createDataFrame(pairs, "a_id long, b_id long, score double")
    ranked = df.select("a_id", "b_id", F.xxhash64("a_id", "b_id").alias("h"))
    key = {(r["a_id"], r["b_id"]): r["h"] for r in ranked.collect()}
    got = matched(spark, pairs, [F.desc("score"), *ownership.hashed_ties()], 50)
    assert got == walked(pairs, lambda x: (-x[2], key[x[0], x[1]], x[0], x[1])) and len(got) == 100
    assert len(rounds) * ownership.ROUNDS_APART < 20
    rounds.clear()
    assert matched(spark, pairs, [F.desc("score"), F.col("a_id"), F.col("b_id")]) == [(i, i, 1.0) for i in range(100)] and not rounds


def test_long_chains_and_other_columns(spark):
    pairs = [(i, i, 1.0 + 2 * i) for i in range(40)] + [(i, i + 1, 2.0 + 2 * i) for i in range(40)]
    assert matched(spark, pairs, [F.desc("score")], 10) == walked(pairs, lambda x: -x[2])
    df = spark.createDataFrame([("x", "p", 2, None), ("x", "q", 1, "w"), ("y", "p", 1, "v"), (None, "p", 9, "n")], "a_id string, b_id string, score int, note string")
    assert sorted(map(tuple, ownership.greedy_match(df, [F.desc("score")]).collect())) == [("x", "p", 2, None)]
    assert ownership.greedy_match(df.limit(0), [F.desc("score")]).collect() == []


def test_lineage_with_equal_groups_and_a_member_that_all_have(spark):
    r = random.Random(6)
    base = {f"b{i}": {"hot", *(f"m{r.randrange(30)}" for _ in range(r.randint(0, 5)))} for i in range(40)}
    new = {f"a{i}": {"hot", *(f"m{r.randrange(30)}" for _ in range(r.randint(0, 5)))} if i % 3 else set(r.choice(list(base.values()))) for i in range(40)}
    frame = lambda sets, k: spark.createDataFrame([(g, m, int(g[1:])) for g, ms in sets.items() for m in ms], f"{k}_id string, member string, {k}_idx int")
    got = {x["a_id"]: (x["keeps_id"], x["related_id"], round(x["jaccard"], 9), x["kind"]) for x in ownership.lineage(frame(base, "b"), frame(new, "a")).collect()}
    best = {}
    for a, s in new.items():
        close = [(len(s & t) / len(s | t), int(b[1:]), b) for b, t in base.items() if len(s & t) / len(s | t) >= 0.4]
        best[a] = max(close, default=None)
    want = {}
    for a in new:
        if best[a] is None:
            want[a] = (None, None, 0.0, "fresh")
            continue
        j, _, b = best[a]
        rival = min((-best[x][0], int(x[1:])) for x in new if best[x] is not None and best[x][2] == b)
        wins = j >= 0.7 and rival == (-j, int(a[1:]))
        want[a] = (b if wins else None, b, round(j, 9), "kept" if wins else "split")
    assert got == want
