import random

import pytest

from histora.operators import setjoin


def table(spark, sets, key):
    rows = [(i, m) for i, members in sets.items() for m in members]
    return spark.createDataFrame(rows, f"{key} long, member string")


def made(seed, n, hot=0.0, members=40):
    """Sets of which a share has the hot members, some of nothing else, and copies."""
    r = random.Random(seed)
    out = {}
    for i in range(n):
        own = {f"m{int(r.random() ** 3 * members)}" for _ in range(r.randint(1, 8))}
        if r.random() < hot:
            own = {*(own if r.random() < 0.5 else ()), *(f"hot{k}" for k in range(r.randint(1, 4)))}
        elif r.random() < 0.2 and out:
            own = out[r.choice(list(out))]
        out[i] = set(own)
    return out


def plainly(a, b, least, share):
    def classes(sets):
        least_of = {}
        for i, s in sorted(sets.items()):
            least_of.setdefault(frozenset(s), i)
        return {i: s for s, i in least_of.items()}

    out = {}
    for i, s in classes(a).items():
        for j, t in classes(b).items():
            k = len(s & t)
            if k and k / (len(s) if share else len(s | t)) >= least:
                out[i, j] = (k, len(s), len(t), k / len(s | t))
    return out


@pytest.mark.parametrize("least,share", [(0.4, False), (0.5, True), (0.7, False), (1.0, False), (0.05, False)])
@pytest.mark.parametrize("heavy", [2, 8, 1000])
def test_similar_equals_all_pairs(spark, least, share, heavy):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    a, b = made(1, 60, 0.4), {100 + i: s for i, s in made(2, 70, 0.4).items()}
    got = {(r["a_id"], r["b_id"]): (r["shared"], r["n_a"], r["n_b"], r["jaccard"]) for r in setjoin.similar(table(spark, a, "a_id"), table(spark, b, "b_id"), least, share, heavy, listed=0 if heavy < 1000 else 10**6).collect()}
    assert got == plainly(a, b, least, share)


@pytest.mark.parametrize("heavy", [1, 5, 1000])
def test_meetings_equal_all_pairs(spark, heavy):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    for sets in (made(3, 90, 0.5), made(4, 50, 0.0), {0: {"x"}, 1: {"y"}}):
        got = {r["id"]: r["others"] for r in setjoin.meetings(table(spark, sets, "id"), heavy).collect()}
        assert got == {i: sum(bool(s & t) for j, t in sets.items() if j != i) for i, s in sets.items()}


def test_no_rows(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    assert setjoin.meetings(table(spark, {}, "id")).collect() == [] and setjoin.similar(table(spark, {}, "a_id"), table(spark, {1: {"x"}}, "b_id"), 0.5).collect() == []
    with pytest.raises(ValueError):
        setjoin.similar(table(spark, {}, "a_id"), table(spark, {}, "b_id"), 0.0)


def test_a_member_of_a_third_of_all_sets_stays_linear(spark):
    """Twice the sets with a hot member make twice the rows that joins give, not four times."""
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    rows = {}
    try:
        for n in (6000, 12000):
            sets = spark.range(n).selectExpr("id", "explode(if(id % 3 = 0, array('hot', concat('a', id div 2)), array(concat('a', id div 2), concat('b', id div 4)))) AS member")
            found = setjoin.meetings(sets, 200)
            third = -(-n // 3)
            assert found.where("others >= " + str(third - 1)).count() == third
            pairs = setjoin.similar(sets.withColumnRenamed("id", "a_id"), sets.withColumnRenamed("id", "b_id"), 0.5, heavy=200, listed=0)
            rows[n] = pairs.count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert rows[12000] <= 2.2 * rows[6000]


@pytest.mark.parametrize("heavy", [2, 1000])
def test_pairs_are_made_in_slices(spark, heavy):
    """all pairs through light members were shuffled at once."""
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rows = [(i, m) for i in range(12) for m in range(30) if (i * 7 + m * 5) % 4 == 0 or m == i]
    sets = spark.createDataFrame([*rows, (99, 500)], "id int, member int")
    want = {i: len({j for j, m in rows for k, n in rows if k == i and n == m and j != i}) for i in range(12)} | {99: 0}
    assert {r.id: r.others for r in setjoin.meetings(sets, heavy, at_once=20).collect()} == want
    assert {r.id: r.others for r in setjoin.meetings(sets, heavy).collect()} == want
