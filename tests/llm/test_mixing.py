import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from histora.llm import mixing
from histora.llm.registry import QUERIES

from ..conftest import MEDIUM

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shares(sizes, cycle=(1, 2, 3), most=3):
    """Targets by source: shared by weight, capped, the excess shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if most * sizes[s] <= weight[s] * level]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= most * sizes[s]
            open_.discard(s)
    return target


def mixed(docs, cycle=(1, 2, 3)):
    """docs: (doc_id, text, source, weight). Rows of the result, sorted."""
    size = [len(WORD.findall(t or "")) for _, t, _, _ in docs]
    sizes = defaultdict(int)
    for (_, _, s, _), n in zip(docs, size, strict=True):
        sizes[s] += n
    target, out = shares(sizes, cycle), []
    for source in sizes:
        keyed = []
        for (d, t, s, w), n in zip(docs, size, strict=True):
            if s == source:
                h = sha(f"mix:{'none' if d is None else d}:{sha(t or '')}")
                u = (int(h[:13], 16) + 0.5) / 2**52
                keyed.append((-math.log(u) / (w if w and w > 0 else 1.0), d is None, d or 0, h[13:29], n))
        epochs = int(target[source] // sizes[source]) if sizes[source] else 0
        rest, at = target[source] - epochs * sizes[source], 0
        for _, none, d, _, n in sorted(keyed):
            taken = n * (epochs + (rest > 0 and at + n / 2 <= rest))
            at += n
            out.append((None if none else d, n, sizes[source], target[source], taken))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in df.collect()), key=str)


def same(a, b):
    return len(a) == len(b) and all(x[:3] == y[:3] and x[4] == y[4] and x[3] == pytest.approx(y[3], rel=1e-12) for x, y in zip(a, b, strict=True))


def corpus(seed=3, n=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        source = r.choices(["hot", "b", "Z", "é", "", None], [20, 6, 3, 3, 1, 2])[0]
        text = " ".join("w" * r.randint(1, 5) for _ in range(r.choice([0, 1, 5, 40, 300]))) if r.random() > 0.05 else None
        out.append((r.choice([None, i, i, i, 2**63 - 1, -(2**63)]), text, source, r.choice([None, 0.0, 0.5, 1.0, 2.0])))
    return out + [(7, "the same row", "b", 1.0)] * 50 + [(None, "a row without id", "hot", 2.0)] * 120


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, source string, w double").selectExpr("*", "'x' AS key", "'x' AS size", "1 AS nth", "'x' AS tie", "2 AS target", "'x' AS rest")


@pytest.mark.parametrize("cell_rows", [20_000, 3])
def test_mix_matches_a_plain_walk(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(mixing, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(mixing, "CELLS", 1024 if cell_rows > 3 else 4)
    monkeypatch.setattr(mixing, "BLOCK", 10_000 if cell_rows > 3 else 7)
    docs = corpus()
    found = mixing.mix(frame(spark, docs), "w")
    assert same(got(found), mixed(docs))


def test_a_source_is_near_its_target_and_none_is_above(spark):
    docs = corpus(9)
    rows = mixing.mix(frame(spark, docs).repartition(5), "w").collect()
    by, longest, target = Counter(), Counter(), {}
    for r in rows:
        by[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"]
    assert all(abs(by[s] - target[s]) <= longest[s] / 2 for s in target)
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert got(mixing.mix(frame(spark, docs).coalesce(1), "w")) == got(mixing.mix(frame(spark, docs[::-1]).repartition(3), "w"))


def test_heavier_documents_come_first(spark):
    docs = [(i, "a b c", s, 8.0 if i % 2 else 1.0) for i in range(2000) for s in ("x", "y")]
    picked = Counter()
    for r in mixing.mix(frame(spark, docs), "w", cycle=(1, 3)).where("source = 'x'").collect():
        picked[r["doc_id"] % 2] += r["picked"]
    assert picked[1] > 2 * picked[0] > 0


def test_targets_reshare_what_is_over(spark):
    sizes = spark.createDataFrame([("a", 1000, 1.0), ("b", 10, 2.0), ("c", 100, 3.0), ("d", 300, 1.0)], "source string, source_size long, weight double")
    found = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert found == pytest.approx({"b": 30, "c": 300, "a": 540, "d": 540})


def test_empty_and_wordless_tables(spark):
    assert got(mixing.mix(frame(spark, []), "w")) == []
    assert got(mixing.mix(frame(spark, [(1, None, "a", 1.0), (2, "  ", None, None)]), "w")) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_labels_weigh(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 0), (3, 1), (None, 0), (4, None)], "doc_id long, quality int")
    weights = mixing.label_weights(labels)
    assert {r["doc_id"]: r["weight"] for r in weights.collect()} == {1: 2.0, 2: 0.5, 3: 1.0, 4: 1.0}
    docs = [(d, f"word {d} {i}", "s", {1: 2.0, 2: 0.5}.get(d)) for d in (1, 2, 3, 5, None) for i in range(20)]
    docs += [(7, "x", "t", None)] * 9
    assert same(got(mixing.mix(frame(spark, docs), weights)), mixed(docs))


def test_op11_on_whole_table(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    weight = {1: 2.0, 0: 0.5, None: 1.0}
    want = mixed([(r["doc_id"], r["text"], r["source"], weight[labels.get(r["doc_id"])]) for r in docs])
    assert same(got(QUERIES["op11_mixing"](spark, MEDIUM)), want)
