import hashlib
import random

import numpy as np
import pytest

from histora.llm import fill_in_middle as fim
from histora.llm.registry import QUERIES

from ..conftest import MEDIUM


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc_id, text):
    text = text or ""
    n, h = len(text), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS h1", "'x' AS row", "'x' AS form", "'x' AS a", "'x' AS chunk")


def result(df):
    from pyspark.sql import functions as F

    cols = ["doc_id", "units", "form", F.char_length("prefix"), F.char_length("middle"), F.sha2("output", 256), F.sha2(fim.restored(F.col("output"), F.col("form")), 256)]
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def odd_texts(seed=2, n=300):
    r = random.Random(seed)
    marks = ["<", "P", "<P", "<P>", "<<M>", "M>", ">", "é", "😀", "\n", " ", "word", "<s>", "<S", "\x00"]
    out = [(r.choice([None, i, i, 2**63 - 1, -i]), "".join(r.choice(marks if i % 3 else marks[7:]) for _ in range(r.randint(0, 400)))) for i in range(n)]
    return out + [(1, None), (1, ""), (2, "x"), (2, "x"), (None, None), (3, "é" * 63 + "<P>"), (4, "a" * 62 + "<S>"), (5, "a" * 128)]


def test_forms_and_cuts_match_a_plain_version(spark):
    docs = odd_texts()
    assert result(fim.fill_in_middle(frame(spark, docs))) == sorted((plainly(*d) for d in docs), key=str)


def test_giant_texts_are_cut_by_their_chunks(spark, monkeypatch):
    giant = "é€😀 wörter und < > <P noch mehr\n" * 9000
    docs = [(i, giant[i:]) for i in range(30)] + [(3, giant[3:])] * 2 + [(None, giant), (50, giant + "<M>"), (51, "a" * ((1 << 16) - 1) + "<P>"), (52, "b" * (1 << 16)), (53, "c" * ((1 << 16) + 1)), (54, "é" * 100_000)]
    assert result(fim.fill_in_middle(frame(spark, docs))) == sorted((plainly(*d) for d in docs), key=str)


@pytest.mark.parametrize("unit", ["chars", "words", "lines"])
def test_functions_compose_as_the_text_runs(unit):
    """A text scanned whole, or in pieces whose functions are composed, counts and ends alike, from each state."""
    auto, r = fim.automaton(unit), random.Random(4)
    alphabet = [x.encode() for x in ("<", "P", ">", "<S>", " ", "\n", "é", "b", "😀")]
    for _ in range(20):
        text = b"".join(r.choice(alphabet) for _ in range(r.randint(1, 500)))
        cuts = sorted(r.randint(0, len(text)) for _ in range(4))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

        def function(data):
            return tuple(x[0] for x in fim.composed(fim.scan(auto, np.frombuffer(data, np.uint8), np.array([0, len(data)]))))

        ends, units, marks = function(text)
        for state in range(auto.states):
            s, n, m = state, 0, 0
            for p in parts:
                e, u, k = function(p)
                n, m, s = n + u[s], m + k[s], e[s]
            assert (s, n, m) == (ends[state], units[state], marks[state])
        plain = text.decode()
        want = {"chars": len(plain), "words": len(plain.replace("\n", " ").split(" ")) - plain.replace("\n", " ").split(" ").count(""), "lines": len(plain.split("\n")) - plain.endswith("\n")}[unit]
        assert units[0] == want and marks[0] == sum(plain.count(x) for x in fim.SENTINELS)


@pytest.mark.parametrize("unit,joint", [("words", " "), ("lines", "\n")])
def test_words_and_lines_are_not_torn(spark, unit, joint):
    texts = [(i, joint.join(f"{i}w{k}" for k in range(40 if i % 2 else 20_000))) for i in range(12)]
    for r in fim.fill_in_middle(frame(spark, texts), unit=unit).where("form <> 'plain'").collect():
        whole = dict(texts)[r["doc_id"]]
        assert r["prefix"] + r["middle"] + r["suffix"] == whole
        assert all(not x or x.endswith(joint) or x.endswith(whole[-3:]) for x in (r["prefix"], r["middle"]) if x != whole)


def test_empty_table(spark):
    assert result(fim.fill_in_middle(frame(spark, []))) == []


def test_op12_on_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()]
    cols = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, QUERIES["op12_fill_in_middle"](spark, MEDIUM).select(*cols).collect()), key=str) == sorted((plainly(*d) for d in docs), key=str)
