import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from histora.llm import decontamination, exact_dedup, jaccard_join, line_dedup, packing, pii, quality, sharding, substring_dedup, url_filters
from histora.llm.components import components
from histora.llm.registry import QUERIES
from histora.llm.tokens import Encoder

from ..conftest import MEDIUM, SMALL
from . import brute


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="session")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def benchmark(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect()]


def made(spark, data, extra=True):
    """Documents with columns whose names operators use inside."""
    schema = "doc_id long, text string, source string"
    data = [(d, t, "s") for d, t in data]
    df = spark.createDataFrame(data, schema)
    if extra:
        for name in ("n", "anchor", "hash", "score", "kept", "digest", "bin", "least", "size", "key", "region"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def copies(seed=5, n=60):
    """Texts with near copies, shared passages, repeats inside a text, and short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeXYZé") for _ in range(r.randint(1, 4)))
    out, texts = [], []
    passage = [word() for _ in range(45)]
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.35:
            w = r.choice(texts).split(" ")
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = word()
        elif kind < 0.5:
            w = [word() for _ in range(r.randint(0, 30))] + passage[r.randint(0, 20) :] + [word() for _ in range(5)]
        elif kind < 0.6:
            w = [word()] * r.randint(1, 60)
        elif kind < 0.7:
            w = [word() for _ in range(r.randint(0, 5))]
        else:
            w = [word() for _ in range(r.randint(20, 120))]
        texts.append(" ".join(w))
        out.append((i, texts[-1]))
    return out


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two three four five " * 400), (7, "one two three four five " * 400), (8, "x" * 100_000), (9, "+" * 5000 + "1 " * 3000)]


# -- substring dedup ---------------------------------------------------------------


@pytest.mark.parametrize("span,gram", [(20, 6), (8, 3)])
def test_substring_dedup_matches_brute_force(spark, span, gram):
    data = copies() + [(100 + d, t) for d, t in ODD]
    want = brute.substring_dedup(data, span)
    got = rows(substring_dedup.substring_dedup(made(spark, data), span, gram))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_maximal_repeats_and_rows_without_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    data = [(1, a), (2, f"x {a} y {b[:-4]}"), (3, f"{b} {c}"), (4, f"{c} {c}"), (None, a), (None, "q " + a), (None, c + " r"), (5, "s"), (5, f"t {a}"), (5, f"t {a}")]
    got = [(r["doc_id"], r["kept_text"], [(x["start"], x["length"]) for x in r["repeats"]]) for r in rows(substring_dedup.substring_dedup(made(spark, data)))]
    want = [(1, a, []), (2, f"x y {b[:-4]}", [(1, 30)]), (3, " ".join(b.split()[29:]) + " " + c, [(0, 29)]), (4, "", [(0, 30), (30, 30)]), (None, "", [(0, 30)]), (None, "q", [(1, 30)]), (None, "r", [(0, 30)]), (5, "s", [])]
    assert sorted(map(str, got)) == sorted(map(str, [*want, (5, "t", [(1, 30)]), (5, "t", [(1, 30)])]))


def test_op1_on_whole_table(spark, documents):
    got = rows(QUERIES["op1_substring_dedup"](spark, MEDIUM))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute.substring_dedup(documents)


# -- personal data -----------------------------------------------------------------

PII_TEXTS = [
    "write a.b@c.de and a@b.c_d@e.f or x@y then 1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 12345678901234567890123 é\U0001f600 5500005555555559",
    "+1 (706) 555-3138 +44 20 7946 0958. +1 2 +" + "1" * 40,
    "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, token = \"7c72db563d7f6e50cec00950f7bab1f2223b6afd\"",
    None,
    "",
    "a" * 60_000 + "@" + "b" * 50,
    "7" * 60_000 + ".1",
]


def test_pii_base_spans(spark):
    got = {r["doc_id"]: r for r in rows(pii.find_pii(made(spark, list(enumerate(PII_TEXTS)))))}
    for i, text in enumerate(PII_TEXTS):
        counts, spans = brute.pii(text)
        base = [s for s in got[i]["found"] if s["kind"] in ("email", "ip", "card", "phone")]
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base) == spans
        for s in got[i]["found"]:
            assert (text or "")[s["start"] : s["end"]] == s["match"]
    assert [s["kind"] for s in got[3]["found"]] == ["iban", "iban", "secret"]


def test_account_numbers_end_where_a_group_does(spark):
    plain, spaced = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    data = [f"{n}{after}" for n in (plain, spaced) for after in (" Please", " I will", " 17 times", " 2024", ".", "", " AND ALL THIS IN CAPITALS", f" {plain}")]
    data += [f"{plain}x", f"X{plain}", plain[:-1] + "1 Please", "AB12 " + plain, "AB12 3456 7890 1234 " + spaced + " Z9", "é\U0001f600 " + plain + " É", ("AB12 " * 4000) + plain]
    got = {r["doc_id"]: [(s["start"], s["match"]) for s in r["found"] if s["kind"] == "iban"] for r in rows(pii.find_pii(made(spark, list(enumerate(data)))))}
    for i, n in enumerate((plain, spaced)):
        assert all(got[8 * i + k] == [(0, n)] for k in range(7)) and got[8 * i + 7] == [(0, n), (len(n) + 1, plain)]
    assert [got[k] for k in range(16, 23)] == [[], [], [], [(5, plain)], [(20, spaced)], [(3, plain)], [(20000, plain)]]
    redacted = {r["doc_id"]: r["text"] for r in rows(pii.redact(made(spark, list(enumerate(data)))))}
    assert redacted[0] == "[iban] Please" and redacted[8 + 2] == "[iban] 17 times"


def test_op2_on_whole_table(spark, documents):
    got = {r["doc_id"]: r for r in rows(QUERIES["op2_pii"](spark, MEDIUM))}
    for d, t in documents:
        counts, spans = brute.pii(t)
        r = got[d]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == counts
        assert r["base_sha256"] == brute.sha(spans)
        assert r["spans"].startswith(spans)


def test_redaction_leaves_no_base_match(spark):
    out = rows(pii.redact(made(spark, [(1, PII_TEXTS[0])])))
    assert "a.b@c.de" not in out[0]["text"] and "[email]" in out[0]["text"]


def test_redaction_by_span(spark, monkeypatch):
    monkeypatch.setattr(pii, "WALKED", 3)
    texts = ["21.2.3.400 and 1.2.3.4, then 21.2.3.400", "a 1.2.3.4 1.2.3.4", "é\U0001f600 x@y.de +49 30 1234567, x@y.de" * 7, "", None, "plain", "+4111 1111 1111 1111 x", *PII_TEXTS]
    found = {r["doc_id"]: (r["text"], r["found"]) for r in rows(pii.find_pii(made(spark, list(enumerate(texts)))))}
    got = {r["doc_id"]: r["text"] for r in rows(pii.redact(made(spark, list(enumerate(texts)))))}
    assert got[0] == "21.2.3.400 and [ip], then 21.2.3.400" and got[1] == "a [ip] [ip]" and got[3] == got[4] == ""
    for i, (text, spans) in found.items():
        owner = {}
        for s in sorted(spans, key=lambda s: (s["start"], -s["end"], s["kind"])):
            for k in range(s["start"], s["end"]):
                owner.setdefault(k, owner.get(s["start"], (s["kind"], s["start"])))
        want, last = "", None
        for k, c in enumerate(text):
            now = owner.get(k)
            want += c if now is None else f"[{now[0]}]" if now != last else ""
            last = now
        assert got[i] == want
        counts, base = brute.pii(text)
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] in ("email", "ip", "card", "phone")) == base


def test_context_moves_the_score(spark):
    texts = ["host 1.2.3.4", "1.2.3.4 is the server", "version 1.2.3.4", "1.2.3.4"]
    got = {r["doc_id"]: round(r["found"][0]["score"], 2) for r in rows(pii.find_pii(made(spark, list(enumerate(texts)))))}
    assert got == {0: 0.8, 1: 0.8, 2: 0.3, 3: 0.6}


def plain_accounts(text):
    """Account numbers, plainly: at each head that no letter or digit precedes, the longest valid start of the run of groups."""
    import re

    out, at = [], 0
    for m in re.finditer(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}", text):
        run = re.match(r"(?: ?[A-Z0-9]){11,30}", text[m.end() :])
        if not run or m.start() < at:
            continue
        whole = m[0] + run[0]
        after = text[m.end() + run.end() : m.end() + run.end() + 1]
        groups = (whole + (after if re.match("[A-Za-z0-9]", after) else "")).split(" ")
        for n in range(len(groups), 0, -1):
            one = " ".join(groups[:n])
            bare = one.replace(" ", "")
            if re.fullmatch("[A-Z0-9]{15,34}", bare) and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
                out.append((m.start(), m.start() + len(one)))
                at = m.start() + len(one)
                break
    return out


def plain_secrets(text):
    import re

    words = re.compile(r"(?:token|secret|passw(?:or)?d|api_?key|key)\"?\s*[:=]\s*\"?$", re.I)
    found = [m for m in re.finditer(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,64}(?![A-Za-z0-9_])", text)]
    return [(m.start(), m.end()) for m in found if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and words.search(text[max(0, m.start() - 24) : m.start()])]


def test_added_kinds_against_plain_versions(spark, documents):
    got = {r["doc_id"]: r["spans"] for r in rows(QUERIES["op2_pii"](spark, MEDIUM))}
    n = 0
    for d, t in documents:
        want = [f"iban:{a}:{b}" for a, b in plain_accounts(t)] + [f"secret:{a}:{b}" for a, b in plain_secrets(t)]
        assert [x for x in got[d].split(",") if x.startswith(("iban", "secret"))] == want
        n += len(want)
    assert n


# -- url filters -------------------------------------------------------------------


def test_captures_see_the_entries_active_when_fetched(spark):
    entries = spark.createDataFrame(
        [(1, "bad.example", "2024-01-01 10:00:00", True), (2, "bad.example", "2024-01-05 10:00:00", False), (3, "BAD.example", "2024-01-05 10:00:00", True), (4, "bad.example", "2024-02-01 00:00:00", False), (5, None, "2024-01-01 00:00:00", True), (6, "a.ok.example", "2024-01-01 00:00:00", True)],
        "entry_id long, host string, ts string, listed boolean",
    )
    captures = spark.createDataFrame(
        [
            (1, "http://bad.example/x", "2024-01-01 09:59:59"),
            (2, "http://www.bad.example:80/x", "2024-01-01 10:00:00"),
            (3, "http://bad.example", "2024-01-20 00:00:00"),
            (4, "http://bad.example", "2024-02-01 00:00:00"),
            (5, None, "2024-01-20 00:00:00"),
            (6, "nonsense", "2024-01-20 00:00:00"),
            (7, "http://bad.example", None),
            (8, "http://u:p@B.A.OK.example./", "2024-03-20 00:00:00"),
            (9, "http://ok.example", "2024-03-20 00:00:00"),
            (9, "http://ok.example", "2024-03-20 00:00:00"),
        ],
        "capture_id long, url string, fetched string",
    )
    got = sorted((r["capture_id"], r["rule"], r["blocked"]) for r in rows(url_filters.judge_captures(captures, entries)))
    assert got == [(1, None, False), (2, "bad.example", True), (3, "bad.example", True), (4, None, False), (5, None, False), (6, None, False), (7, None, False), (8, "a.ok.example", True), (9, None, False), (9, None, False)]


def test_captures_without_entries_and_entries_without_captures(spark):
    """Empty tables on either side, extra columns with clashing names, repeats, long and odd urls."""
    capture, entry = "capture_id long, url string, fetched string, host string, rule string, key string, bucket string, blocked int", "entry_id long, host string, ts string, listed boolean, valid_from int, state string, url string"
    odd = [None, "", " ", "http://", "://x", "http:///p", "http://[::1]/x", "http://" + "a." * 3000 + "example/" + "x" * 50_000, "HTTP://Bad.Example./?q#f", "ftp://bad.example", "http://ok.example"]
    rows_ = [(i, u, "2024-01-02 00:00:00", "h", "r", "k", "b", 1) for i, u in enumerate(odd)] + [(None, "http://bad.example", "2024-01-02 00:00:00", *["x"] * 4, 0)] * 2
    none, captures = spark.createDataFrame([], capture), spark.createDataFrame(rows_, capture)
    listed = [(1, "bad.example", "2024-01-01 00:00:00", True), (1, "bad.example", "2024-01-01 00:00:00", True), (2, "bad.example", None, False), (3, None, None, None), (None, "", "2024-01-01 00:00:00", True), (4, "example", "2024-01-03 00:00:00", True)]
    entries = spark.createDataFrame([(*e, 1, "s", "u") for e in listed], entry)
    assert rows(url_filters.judge_captures(none, entries)) == [] and rows(url_filters.judge_captures(none, spark.createDataFrame([], entry))) == []
    without = rows(url_filters.judge_captures(captures, spark.createDataFrame([], entry)))
    assert len(without) == len(rows_) and not any(r["blocked"] for r in without)
    got = rows(url_filters.judge_captures(captures, entries))
    assert len(got) == len(rows_) and sorted(str(r["capture_id"]) for r in got if r["blocked"]) == ["8", "9", "None", "None"]


# -- quality -----------------------------------------------------------------------


def test_held_out_quality(spark):
    got = {r["doc_id"]: r for r in rows(QUERIES["op4_quality_classifier"](spark, "/root/testdata/sf0.1"))}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(got[d]["predicted"], q) for d, q in labels.items() if got[d]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    good, bad = [p for p, q in held if q == 1], [p for p, q in held if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_dictionaries_hold_all_samples_and_their_ends():
    samples = [b"%04d" % i * 1000 for i in range(2000)]
    content = quality._dictionary(samples, 112 << 10)
    assert len(content) <= 112 << 10 and all(content.split(b"\n")) and content.count(b"\n") == 1999
    late = quality._dictionary([bytes([97 + i // 1000 for i in range(20_000)])] * 10, 32 << 10)
    assert set(late) == {*range(97, 117), 10}


def test_quality_without_labels_or_text(spark):
    model = quality.fit([])
    assert [r["score"] for r in rows(quality.quality_scores(made(spark, ODD), model))] == [0.5] * len(ODD)
    texts = [(b"fine words in a row. and more of them.", 1), (b"BAD!! BAD!! ### $$$", 0)] * 8
    got = rows(quality.quality_scores(made(spark, ODD + [(None, "x")]), quality.fit(texts)))
    assert len(got) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in got)


def test_scores_equal_a_plain_fit():
    """Fit and score written out again, on 20 fixed texts: dictionaries, chunk-wise size differences, ridge logistic by Newton steps."""
    import itertools
    import re

    import zstandard

    r = random.Random(3)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
    texts = [" ".join(word() if i % 2 else r.choice(["WIN", "$$$", "CLICK!!", word().upper(), "77"]) for _ in range(r.choice([3, 40, 300]))).encode() for i in range(20)]
    rows = [(t, i % 2) for i, t in enumerate(texts)]
    views = ((lambda t: t, 112 << 10, 512), (lambda t: re.sub(b"0+", b"0", re.sub(b"A+", b"A", re.sub(b"a+", b"a", re.sub(rb"[A-Z]", b"A", re.sub(rb"[0-9]", b"0", re.sub(rb"[a-z\x80-\xff]", b"a", t.replace(b"A", b"B"))))))), 32 << 10, 128))

    def pieces(text, share):
        if len(text) <= share:
            return text
        n = max(1, share // 64)
        cuts = [i * len(text) // n for i in range(n + 1)]
        return b"".join(text[a + zlib.crc32(text, i) % max(1, b - a - share // n + 1) :][: share // n] for i, (a, b) in enumerate(itertools.pairwise(cuts)))

    def dictionaries(rows):
        out = []
        for view, size, _ in views:
            for label in (1, 0):
                own = [view(t) for t, y in rows if y == label]
                out.append(b"\n".join(pieces(t, max(1, size // len(own) - 1)) for t in own)[:size])
        return out

    def features(text, dicts):
        out = []
        for k, (view, _, chunk) in enumerate(views):
            v = view(text)
            parts = [v[i : i + chunk] for i in range(0, max(1, len(v)), chunk)]
            if len(parts) > 1 and len(parts[-1]) < chunk // 2:
                parts[-2:] = [parts[-2] + parts[-1]]

            def size(x, content=None):
                known = {} if content is None else {"dict_data": zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), "write_dict_id": False}
                return len(zstandard.ZstdCompressor(level=3, write_content_size=False, **known).compress(x))

            good, bad = ([size(x, dicts[2 * k + side]) for x in parts] for side in (0, 1))
            room = [len(x) + 8 for x in parts]
            gain = [(b - g) / n for g, b, n in zip(good, bad, room)]
            plain = size(v) / (len(v) + 16)
            share = [g / n for g, n in zip(good, room)]
            out += [np.mean(gain), min(gain), max(gain), plain, min(plain, 0.2), sum(good) / sum(room), sum(map(min, good, bad)) / sum(room), min(share), max(share)]
        return out

    fold = [i // 2 % 2 for i in range(20)]  # every other one of each class
    x = np.array([features(t, dictionaries([q for q, g in zip(rows, fold) if g != f])) for (t, _), f in zip(rows, fold)])
    y = np.array([label for _, label in rows], float)
    centre, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(20), (x - centre) / spread]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w + np.linalg.inv(z.T @ np.diag(p * (1 - p)) @ z + 0.1 * np.eye(len(w))) @ (z.T @ (y - p) - 0.1 * w)
    own = dictionaries(rows)
    want = [1 / (1 + np.exp(-np.clip(w[0] + (np.array(features(t, own)) - centre) / spread @ w[1:], -30, 30))) for t in [*texts, b"", b"fresh words here", b"CLICK $$$ 77"]]
    score = quality.fit(rows).scorer()
    assert [score(t) for t in [*texts, b"", b"fresh words here", b"CLICK $$$ 77"]] == pytest.approx(want, abs=1e-6)
    assert min(want[1:20:2]) > 0.5 > max(want[0:20:2])


def test_sample_is_of_documents_that_can_be_used(spark):
    docs = made(spark, [(i, f"text {i} " * (1 if i % 5 else 9000)) for i in range(200)] + [(None, "x"), (7, "again")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(10_000 + i, i % 2) for i in range(8000)] + [(7, 1), (8, None), (None, 1)], "doc_id long, quality int")
    for n in (5, 30):
        sample = quality.labelled_sample(docs, labels, n)
        assert [sum(y == label for _, y in sample) for label in (0, 1)] == [n, n] and all(len(t) < 100 for t, _ in sample)
    usable = [i for i in range(200) if i % 5 and zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(int(t.split()[1]) for t, _ in quality.labelled_sample(docs, labels, 500) if b"again" not in t) == [i for i in usable if i != 7]


# -- jaccard join ------------------------------------------------------------------


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_matches_brute_force(spark, monkeypatch, words, percent):
    data = copies(seed=words, n=150) + [(1000 + d, t) for d, t in ODD]
    want = brute.jaccard(data, words, percent)
    monkeypatch.setattr(jaccard_join, "BLOCK", 700)  # regions are dealt into blocks
    got = rows(jaccard_join.jaccard_classes(made(spark, data), words, percent))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got} == want


def test_region_recursion_finds_all_links():
    r = np.random.default_rng(3)
    base = [r.choice(5000, 60, replace=False) for _ in range(30)]
    sets = []
    for _ in range(700):
        own = set(base[r.integers(30)].tolist())
        for x in r.choice(sorted(own), r.integers(0, 6), replace=False):
            own.discard(int(x))
            own.add(int(r.integers(5000)))
        sets.append(np.array(sorted(own), np.uint64))
    space, whole, sides = (jaccard_join.Region(sets, 85, record=True) for _ in range(3))
    space.join(np.arange(len(sets)))
    whole.links()
    side = np.arange(len(sets)) % 2 == 0
    sides.cross_links(side)
    pairs = lambda x: {tuple(sorted(p)) for a, b in x.pairs for p in zip(a.tolist(), b.tolist())}
    got = pairs(space)
    assert sum(len(a) for a, _ in space.pairs) == len(got) == sum(len(a) for a, _ in whole.pairs)
    assert pairs(whole) == got and pairs(sides) == {p for p in got if side[p[0]] != side[p[1]]}
    small = [set(s.tolist()) for s in sets]
    assert whole.found.sum() == 2 * len(got)
    assert whole.label.tolist() == [brute.components(range(700), got)[i] for i in range(700)]
    assert got == {(i, j) for i in range(700) for j in range(i + 1, 700) if 100 * len(small[i] & small[j]) >= 85 * len(small[i] | small[j])}


def test_op5_on_whole_table(spark, documents):
    got = rows(QUERIES["op5_jaccard_join"](spark, MEDIUM))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got} == brute.jaccard(documents)


def test_unrelated_texts_stay_apart_under_null_and_repeated_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    data = [(1, a), (2, b), (None, a + " end"), (None, b + " end"), (7, a + " fin"), (7, b + " fin"), (7, b + " fin")]
    got = sorted((r["doc_id"] or 99, r["component_id"], r["n_links"]) for r in rows(jaccard_join.jaccard_classes(made(spark, data))))
    assert got == [(1, 1, 2), (2, 2, 3), (7, 1, 2), (7, 2, 3), (7, 2, 3), (99, 1, 2), (99, 2, 3)]


def test_one_row_of_each_component_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    data = [(3, a), (2, b), (None, a + " end"), (None, b + " end"), (7, a + " fin"), (7, b + " fin"), (8, c), (8, c), (8, c + " fin"), (9, None), (9, "")]
    got = [(r["doc_id"], r["text"]) for r in rows(jaccard_join.one_of_each(made(spark, data)))]
    eights = [x for x in got if x[0] == 8]
    assert len(eights) == 1 and eights[0] in data
    # rows without an id stay, as the pipeline's stage has them
    want = [(2, b), (3, a), (9, None), (9, ""), (None, a + " end"), (None, b + " end")]
    assert sorted(map(str, got)) == sorted(map(str, [*want, *eights]))


def test_components_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(200) if i != 77] + [(500, 300), (300, 400), (9, 9)]
    got = {r["id"]: r["component"] for r in rows(components(spark.createDataFrame(pairs, "a long, b long")))}
    want = brute.components({x for p in pairs for x in p}, pairs)
    assert got == {i: c for i, c in want.items()}


# -- sharding ----------------------------------------------------------------------


@pytest.mark.parametrize("seed,shards", [(1, 7), (2, 40), (3, 3)])
def test_shards_are_minimal_and_whole(spark, monkeypatch, seed, shards):
    r = random.Random(seed)
    data = [(i * r.choice((1, 1000)) + 10**6 * (i % 3), r.choice((None, "", "same", "hot" * 50, "t" * r.randint(0, 300)))) for i in range(400)]
    monkeypatch.setattr(sharding, "FIRST_CELLS", 8)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 30)
    got = rows(sharding.shard_documents(made(spark, data), shards))
    check_shards(data, got, shards)


def test_shards_of_any_ids(spark):
    wide = [(-(2**62) - 5, "a"), (2**62 + 9, "bb"), (2**63 - 1, "ccc"), (-(2**63), "d" * 9), (-5, None), (None, "x"), (None, "y" * 30), (None, "x"), (3, "a"), (7, "q"), (7, "r" * 5)]
    got = rows(sharding.shard_documents(made(spark, wide), 4))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), 16 + len(t or "")) for d, t in wide)
    sizes = defaultdict(int)
    for r in got:
        sizes[r["shard"]] += r["size"]
    # the groups in order: d..., a, None, q and r..., bb, ccc, then those without an id by the hash of their text
    both = [brute.least_capacity([25, 34, 16, *seven, 18, 19, *none], 4) for seven in ((17, 21), (21, 17)) for none in ((34, 46), (46, 34))]
    assert max(sizes.values()) in both and len({r["shard"] for r in got if r["doc_id"] in (3, -(2**62) - 5)}) == 1
    assert len({r["shard"] for r in got if r["size"] == 17 and r["doc_id"] is None}) == 1
    none = rows(sharding.shard_documents(made(spark, [(None, "z" * i) for i in range(1, 60)]), 5))
    assert len({r["shard"] for r in none}) == 5 and len(none) == 59


def check_shards(data, got, shards):
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in data)
    groups = defaultdict(list)
    for d, t in data:
        groups[t or ""].append(d)
    order = defaultdict(int)
    for t, ids in groups.items():
        order[min(ids)] += len(ids) * (16 + len(t.encode()))
    least = brute.least_capacity([order[k] for k in sorted(order)], shards)
    sizes, slots, of = defaultdict(int), defaultdict(list), {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of.setdefault(r["doc_id"], set()).add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert max(sizes.values()) == least
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for ids in groups.values():
        assert len(set().union(*(of[i] for i in ids))) == 1 or len(set(d for d, _ in data)) < len(data)
    starts = sorted(order)
    cut = [min(of[k]) for k in starts]
    assert cut == sorted(cut)


def test_op6_on_whole_table(spark, documents):
    got = rows(QUERIES["op6_minimax_sharding"](spark, MEDIUM))
    check_shards(documents, got, 40)
    by = {r["doc_id"]: r for r in got}
    assert all(by[d]["size"] == 16 + len(t.encode()) and by[d]["text_crc32"] == brute.crc(t) for d, t in documents)


# -- exact dedup -------------------------------------------------------------------


@pytest.mark.parametrize("largest", [True, False])
def test_exact_dedup(spark, largest):
    data = [(1, "Ab"), (2, "aB"), (3, "ab "), (4, None), (5, ""), (6, "É"), (7, "é"), (None, "AB"), (3, "ab "), (9, "ß"), (10, "K")]
    found = rows(exact_dedup.exact_dedup(made(spark, data), largest))
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in sorted(found, key=lambda r: r["kept"])}
    h = brute.sha
    assert len(found) == len(data) and sum(r["kept"] for r in found) == len(got) - 3 == 7  # one row a group, also of rows that repeat
    stays = None if largest else 1
    assert got[1, h("ab")] == (stays, 3, not largest) and got[2, h("ab")] == (stays, 3, False) and got[None, h("ab")] == (stays, 3, largest)
    assert got[3, h("ab ")] == (3, 2, True)
    assert got[4, h("")] == (5 if largest else 4, 2, not largest) and got[6, h("É")] == (6, 1, True) and got[7, h("é")] == (7, 1, True)


#: The largest and the smallest id, rows without one beside them, and repeats.
FAR = [(2**63 - 1, "Aa"), (2**63 - 1, "aa"), (None, "b b"), (2**63 - 1, "B b"), (-(2**63), "c"), (-(2**63), "c"), (0, "d"), (None, "d"), (None, "d")]


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("torn", [False, True])
def test_any_id_is_legal_and_one_row_of_a_group_stays(spark, monkeypatch, largest, torn):
    from pyspark.sql import functions as F

    if torn:
        entries = exact_dedup._entries
        monkeypatch.setattr(exact_dedup, "_entries", lambda docs: entries(docs).withColumn("digest", F.substring(F.col("digest"), 1, 0)))
    got = sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"])) for r in rows(exact_dedup.exact_dedup(made(spark, FAR), largest)))
    top, low = 2**63 - 1, -(2**63)
    none = (lambda d: None) if largest else (lambda d: d)
    want = [(top, top, 2, True), (top, top, 2, False), (None, none(top), 2, largest), (top, none(top), 2, not largest), (low, low, 2, True), (low, low, 2, False)]
    want += [(0, none(0), 3, not largest), (None, none(0), 3, largest), (None, none(0), 3, False)]
    assert got == sorted(map(str, want))


def test_a_row_that_an_earlier_batch_has_goes(spark):
    index = exact_dedup.DigestIndex(spark)
    seen = [(1, "a"), (5, "b"), (None, "n")]
    exact_dedup.exact_dedup(made(spark, seen), index=index).count()
    got = rows(exact_dedup.exact_dedup(made(spark, [(1, "a"), (1, "a"), (4, "b"), (None, "n"), (9, "new")]), index=index, before=made(spark, seen)))
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["kept"])) for r in got) == sorted(map(str, [(1, 1, 3, False), (1, 1, 3, False), (4, 4, 2, True), (None, None, 2, False), (9, 9, 1, True)]))


def test_torn_digests_are_grouped_by_text(spark, monkeypatch):
    from pyspark.sql import functions as F

    entries = exact_dedup._entries
    monkeypatch.setattr(exact_dedup, "_entries", lambda docs: entries(docs).withColumn("digest", F.lit(bytes(1))))
    data = [(1, "a"), (2, "b"), (3, "A"), (4, "c")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows(exact_dedup.exact_dedup(made(spark, data), True))}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True)}


def test_batches_meet_in_one_index(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "VERIFIED", 2)
    index = exact_dedup.DigestIndex(spark, fanout=2)
    batches = [[(1, "Ab"), (2, "x"), (3, None)], [(4, "aB"), (5, "y")], [(6, ""), (7, "X"), (8, "ab")], [(9, "Z")], [(10, "ab"), (10, "ab"), (11, "z")]]
    seen, levels = [], []
    for batch in batches:
        before = made(spark, seen) if seen else None
        got = {(r["doc_id"]): (r["keep_id"], r["group_size"], r["kept"]) for r in rows(exact_dedup.exact_dedup(made(spark, batch), index=index, before=before))}
        seen += batch
        low = lambda t: (t or "").lower()
        own = {d: [i for i, u in seen if low(u) == low(t)] for d, t in batch}
        assert got == {d: (min(ids), len(ids), d == min(ids)) for d, ids in own.items()}
        levels.append(sorted(r.split("-")[0] for r in index.runs()))
    assert levels == [["L0"], ["L1"], ["L0", "L1"], ["L2"], ["L0", "L2"]]


# -- packing -----------------------------------------------------------------------


def test_exchange_goes_on_until_it_gains_nothing(spark, monkeypatch):
    """Packing that gains a bin a round, however many rounds."""
    sizes = [60] * 40 + [40] * 40
    pieces = spark.createDataFrame([(i if i % 7 else None, 0, 0, n, 1) for i, n in enumerate(sizes)], packing._PIECES)
    turns = []

    def slow(size, turn):
        turns.append(turn)

        def run(key, rows):
            whole = list(zip(sorted(rows.index[rows.length == 60]), sorted(rows.index[rows.length == 40]), strict=True))
            bins = {i: k for k, pair in enumerate(whole[: 2 * turn]) for i in pair}  # a few more pairs a round
            for i in rows.index:
                bins.setdefault(i, len(bins) + 1000)
            out = packing._placed(rows.assign(bin=[turn << 48 | bins[i] for i in rows.index]))
            single = ~out.duplicated("bin", keep=False)
            return out.assign(released=single, group_bins=1, group_bound=1)[[c.split()[0] for c in packing._PACKED.split(", ")]]

        return run

    monkeypatch.setattr(packing, "_pack_group", slow)
    got = rows(packing.pack(pieces, 100))
    bins = defaultdict(int)
    for x in got:
        bins[x["bin"]] += x["length"]
    assert sorted(str(x["doc_id"]) for x in got) == sorted(str(i if i % 7 else None) for i in range(80))
    assert len(turns) > 5 and list(bins.values()) == [100] * 40


def check_packing(got, lengths, size):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for d, n in lengths.items():
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-n // size)))
        assert [r["start"] for r in own] == [i * size for i in range(len(own))]
        assert [r["length"] for r in own] == [min(size, n - i * size) for i in range(len(own))]
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(bins)


@pytest.mark.parametrize("group", [40, 100_000])
def test_op8_round_trip(spark, documents, group):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    ids = {d: whole.encode(t, add_special_tokens=False).ids + [1] for d, t in documents}
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = rows(packing.pack_documents(docs, group=group))
    bins = check_packing(got, {d: len(x) for d, x in ids.items()}, 4096)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    bound = packing.lower_bound(np.array([r["length"] for r in got]), 4096)
    assert bound <= bins <= bound * 1.01 + 1
    assert all(r["group_bound"] <= r["group_bins"] for r in got)


def test_packing_odd_rows(spark):
    got = rows(packing.pack_documents(made(spark, ODD + [(None, "a b"), (4, "one")])))
    assert {r["doc_id"] for r in got} == {d for d, _ in ODD} | {None}
    assert [r["length"] for r in got if r["doc_id"] == 1] == [1]
    assert sum(r["doc_id"] == 4 for r in got) == 2


def test_bound_and_best_fit():
    r = np.random.default_rng(1)
    for _ in range(50):
        x = r.integers(1, 101, r.integers(1, 60))
        bins = packing.best_fit(x, 100)
        assert max(np.bincount(bins, x)) <= 100
        assert -(-x.sum() // 100) <= packing.lower_bound(x, 100) <= bins.max() + 1
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3


ODD_TEXTS = ["", "   ", "İstanbul ΣΑΣ Ünï ﬁ", "don't I'll we're 'tis !!'s a's2024x", "a\x1cb\x85c d", "<|endoftext|> hi", "ªº µ ²³ x\xadY", "日本語 텍스트 😀!!", "é ŉn", "a. b, c.", "a .b. c", "x), y.", "ÿ. ×. ", "1. b 2."]


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    whole, quick = Tokenizer.from_file(path), Encoder(path, most_pieces=5)
    for _ in range(2):
        assert [x.tolist() for x in quick(ODD_TEXTS)] == [whole.encode(t, add_special_tokens=False).ids for t in ODD_TEXTS]


# -- line dedup --------------------------------------------------------------------


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_line_dedup(spark, broadcast_rows):
    data = [(i, f"menu\n\nbody {i}\nmenu\nfoot " if i % 2 else f"body {i}\n \nfoot ", "h") for i in range(30)]
    data += [(100 + i, "menu\nfoot ", "small") for i in range(3)] + [(200, None, "h"), (201, "menu\n\nfoot ", "h"), (202, "menu\nx", None), (203, "", "h")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").selectExpr("*", "'x' AS line", "'y' AS n", "'z' AS host")
    got = {r["doc_id"]: (r["kept_text"], r["n_lines"], r["n_dropped"]) for r in rows(line_dedup.dedup_lines(docs, "source", least_pages=20, keep_bare=True, broadcast_rows=broadcast_rows))}
    assert len(got) == len(data)
    assert got[1] == ("\nbody 1", 5, 3) and got[0] == ("body 0\n ", 3, 1)
    assert got[100] == ("menu\nfoot ", 2, 0) and got[200] == (None, 1, 0) and got[201] == ("menu\n\nfoot ", 3, 0)
    assert got[202] == ("menu\nx", 2, 0) and got[203] == ("", 1, 0)
    plain = {r["doc_id"]: (r["kept_text"], r["n_dropped"]) for r in rows(line_dedup.dedup_lines(docs, "source", broadcast_rows=broadcast_rows))}
    assert plain[100] == ("", 2) and plain[201] == ("", 2) and plain[1] == ("\nbody 1", 3) and plain[202] == ("menu\nx", 0)


def test_line_dedup_by_host_of_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").withColumnRenamed("html", "text")
    got = line_dedup.dedup_lines(pages, url_filters.host_of("url"), least_pages=3, ratio_percent=50)
    assert got.count() == pages.count()


# -- decontamination ---------------------------------------------------------------


@pytest.mark.parametrize("filter_bits", [decontamination.FILTER_BITS, 512])
def test_decontamination(spark, filter_bits):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcÉ9") for _ in range(2))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((40, 13, 12, 3, 1, 0, 25))] + [(50, None), (51, ""), (None, "zz yy"), (0, "aa")]
    docs = [(1, items[0][1][5:90]), (2, "x, " + items[1][1].upper() + "!"), (3, items[2][1]), (4, None), (5, ""), (6, "zz-yy qq"), (7, " ".join(word() for _ in range(300)))]
    docs += [(8, items[6][1] + " q" * 600), (9, "-".join(items[0][1].split()[:12]))]
    got = rows(decontamination.decontaminate(made(spark, docs), spark.createDataFrame(items, "item_id long, text string"), filter_bits=filter_bits))
    keys = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert {x["doc_id"]: tuple(x[k] for k in keys) for x in got} == brute.decontaminate(docs, items)


@pytest.mark.parametrize("filter_bits", [decontamination.FILTER_BITS, 512])
def test_contaminated_rows_go(spark, filter_bits):
    items = [(1, " ".join(f"w{i}" for i in range(20))), (2, " ".join(f"v{i}" for i in range(15)))]
    docs = [(1, items[0][1]), (1, "clean text"), (None, items[1][1]), (None, None), (3, "")]
    got = rows(decontamination.drop_contaminated(made(spark, docs), spark.createDataFrame(items, "item_id long, text string"), filter_bits=filter_bits))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == [("1", "clean text"), ("3", ""), ("None", "None")]


def test_op10_on_whole_table(spark, documents, benchmark):
    keys = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = {x["doc_id"]: tuple(x[k] for k in keys) for x in rows(QUERIES["op10_benchmark_decontamination"](spark, MEDIUM))}
    assert got == brute.decontaminate(documents, benchmark)


# -- odd rows through every operator -----------------------------------------------

OPERATORS = {
    "substring": substring_dedup.substring_dedup,
    "pii": pii.find_pii,
    "jaccard": jaccard_join.jaccard_classes,
    "shards": sharding.shard_documents,
    "exact": exact_dedup.exact_dedup,
    "packing": packing.pack_documents,
    "lines": line_dedup.dedup_lines,
    "quality": lambda docs: quality.quality_scores(docs, quality.fit([])),
    "decontamination": lambda docs: decontamination.decontaminate(docs, docs.sparkSession.createDataFrame([(1, "one two")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    data = ODD[:6] + [(None, "one two three"), (None, None), (4, "one"), (4, "other words")]
    got = rows(OPERATORS[name](made(spark, data)))
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((d for d, _ in data), key=key)


def test_odd_rows_against_a_full_filter(spark):
    data = ODD[:6] + [(None, "one two three"), (None, "one two three"), (None, None), (4, "one"), (4, "other words"), (4, "other words")]
    items = spark.createDataFrame([(1, "one two"), (2, "other words"), (3, "three")], "item_id long, text string")
    one, several = (sorted(map(str, rows(decontamination.decontaminate(made(spark, data), items, filter_bits=n)))) for n in (decontamination.FILTER_BITS, 512))
    assert len(several) == len(data) and several == one


@pytest.mark.parametrize("name", OPERATORS)
def test_the_largest_id_is_no_missing_one(spark, name):
    data = [(2**63 - 1, "one two three"), (2**63 - 1, "x"), (None, "one two three"), (-(2**63), "one two three"), (None, "long " * 30), (2**63 - 1, "long " * 30)]
    got = rows(OPERATORS[name](made(spark, data)))
    assert sorted((str(r["doc_id"]) for r in got)) == sorted(str(d) for d, _ in data)
    for column in {"component_id", "keep_id"} & set(got[0]):
        assert {str(r[column]) for r in got} <= {str(d) for d, _ in data}
    if "n_removed" in got[0]:  # the rows without an id come last, so theirs go
        assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got if r["n_words"] == 30) == [(str(2**63 - 1), 29), ("None", 30)]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert rows(OPERATORS[name](made(spark, []))) == []


def test_substring_dedup_asks_for_anchors_once_a_run():
    """Neighbouring spans own one anchor: what is asked is the runs, and spans that occur twice are told without the places of all."""
    anchor, own = np.repeat(np.array([5, 9, 5, 7], np.uint64), [300, 200, 100, 1]), np.array([5, 8], np.uint64)
    assert len(substring_dedup._runs(anchor)) == 4
    assert substring_dedup._among(anchor, own).tolist() == np.isin(anchor, own).tolist()
    assert not substring_dedup._among(anchor, own[:0]).any() and len(substring_dedup._among(anchor[:0], own)) == 0
    whole, marked = np.array([3, 1, 3, 2, 1, 3], np.uint64), np.array([0, 0, 0, 1, 0, 0], bool)
    assert substring_dedup._twice(whole).tolist() == [1, 3]
    assert substring_dedup.covered(whole, marked).tolist() == [False, False, True, True, True, True]
    assert substring_dedup.covered(whole[3:5], marked[3:5]).tolist() == [True, False]
