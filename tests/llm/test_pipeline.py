from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from histora.llm import packing, quality
from histora.llm.common import stored, table

from ..conftest import MEDIUM
from . import brute
from .test_operators import check_packing


def documents(df):
    return {r.doc_id: r for r in df.collect()}


def lines_of(rows, percent=8):
    """Plain line dedup by source."""
    pages, seen = Counter(), defaultdict(Counter)
    for r in rows:
        pages[r.source] += 1
        for line in {x for x in r.text.split("\n") if x.strip(" \t\r\f\v")}:
            seen[r.source][line] += 1
    out = {}
    for r in rows:
        n = pages[r.source]
        bad = {x for x, k in seen[r.source].items() if k >= 2 and k * 100 > n * percent}
        kept = [x for x in r.text.split("\n") if x not in bad]
        if not any(x.strip(" \t\r\f\v") for x in kept):
            kept = r.text.split("\n")
        out[r.doc_id] = "\n".join(kept)
    return out


def test_stages_against_plain_versions(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    docs = table(spark, MEDIUM, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, MEDIUM), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append(documents(docs))
    whole = documents(table(spark, MEDIUM, "documents"))

    model = quality.fit(quality.labelled_sample(table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")))
    score = model.scorer()
    assert set(kept[0]) == {d for d, r in whole.items() if score(r.text.encode()) >= quality.THRESHOLD}
    assert all(kept[0][d] == whole[d] for d in kept[0])

    want = lines_of(kept[0].values())
    assert {d: r.text for d, r in kept[1].items()} == want
    assert all(r.n_chars == len(r.text) for r in kept[1].values())

    classes = brute.jaccard([(d, r.text) for d, r in kept[1].items()], 5, 80)
    assert set(kept[2]) == {d for d, (_, of, _) in classes.items() if d == of}

    items = [(r.item_id, r.text) for r in table(spark, MEDIUM, "benchmark").collect()]
    bad = {d for d, x in brute.decontaminate([(d, r.text) for d, r in kept[2].items()], items).items() if x[4]}
    assert set(kept[3]) == set(kept[2]) - bad

    got = [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, docs, MEDIUM).collect()]
    lengths = defaultdict(int)
    for r in got:
        lengths[r["doc_id"]] += r["length"]
    assert set(lengths) == set(kept[3])
    bins = check_packing(got, lengths, 4096)
    assert bins <= packing.lower_bound(np.array([r["length"] for r in got]), 4096) * 1.01 + 1


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, MEDIUM)
    docs = table(spark, MEDIUM, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, MEDIUM), name)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))


def test_empty_corpus(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, MEDIUM, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_through_every_stage(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, __line_dedup_host string, gone long"
    same = " ".join(f"word{i}" for i in range(60))
    data = [(1, same), (2, same + " end"), (2, same + " end"), (None, same), (None, None), (3, None), (4, ""), (5, "menu\n" * 50), (6, "x" * 50_000)]
    docs = spark.createDataFrame([(d, t, None, None, None, "a", "b", 7) for d, t in data], schema)
    spark.createDataFrame([(1, None, 0), (None, 1, None), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    count = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        count[name] = out.count()
    # the only label says good, so the share of good ones, 2/3, is under the threshold for all
    assert count == {"quality_classifier": 0, "line_dedup": 9, "ngram_jaccard_join": 7, "benchmark_decontamination": 9, "best_fit_packing": count["best_fit_packing"]}
    assert count["best_fit_packing"] >= 9
