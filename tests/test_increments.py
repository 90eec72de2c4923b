import json
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from histora.operators import increments
from histora.streaming import ledger


@pytest.fixture(autouse=True)
def checkpoints(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))


def stem_of(raw):
    s = raw.lower()
    for end in increments.STEM_ENDS:
        if s.endswith(end) and len(s) > len(end):
            s = s[: -len(end)]
            break
    for head in increments.STEM_HEADS:
        if s.startswith(head):
            s = s[len(head) :]
            break
    return s.strip("_- ")


def plainly(features, paths, files):
    """features: names in order; paths: (feature, path) in order."""
    owner, dirs, stems = {}, {}, {}
    for f in features:
        for g, p in paths:
            if g == f:
                owner[p] = f
                if "/" in p:
                    dirs.setdefault(p.rpartition("/")[0], f)
        for s in [f, *f.split("-"), f[:-1] if f.endswith("s") else f + "s"]:
            if len(s) >= 3:
                stems[s] = f

    def best(name):
        if not name:
            return None
        if name in stems:
            return stems[name]
        found, size = None, 0
        for s, f in stems.items():
            if (name.startswith(s) or s.startswith(name) or s in re.split("[_-]", name)) and len(s) > size:
                found, size = f, len(s)
        return found

    out = {}
    for p in files:
        got, up = (owner.get(p), "path"), p
        while got[0] is None and "/" in up:
            up = up.rpartition("/")[0]
            got = (dirs.get(up), "dir")
        if got[0] is None:
            leaf = p.rpartition("/")[2]
            got = (best(stem_of(leaf.rpartition(".")[0] or leaf)), "stem")
        for part in p.split("/")[-2::-1]:
            if got[0] is None:
                got = (best(stem_of(part)), "folder")
        out[p] = got if got[0] else (None, None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_files_find_their_features(spark, seed):
    r = random.Random(seed)
    words = ["chat", "order", "orders", "bill", "billing", "auth-login", "user", "team-user", "ab", "api", "file-upload"]
    features = r.sample(words, 7)
    paths = [(f, p) for f in features for p in {f"src/{r.choice(words)}/{r.choice(words)}{r.choice(['', 'Page', '_view'])}.ts" for _ in range(4)}]
    files = sorted({"/".join([*(r.choice(["src", "lib", "v1_" + r.choice(words), r.choice(words), "x"]) for _ in range(r.randint(0, 3))), r.choice(["", "api_", "v1_"]) + r.choice([*words, "zzz", "c", "or"]) + r.choice(["", "Page", "_controller", "s", "_x", "-user"]) + r.choice([".ts", ""])]) for _ in range(150)} | {p for _, p in paths[:5]})
    got = increments.assign_files(
        spark.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, pos int"), spark.createDataFrame([(f, p, i) for i, (f, p) in enumerate(paths)], "feature string, path string, pos int"), spark.createDataFrame([(p,) for p in files], "path string")
    )
    assert {x["path"]: (x["feature"], x["by"]) for x in got.collect()} == plainly(features, paths, files)


def test_update_of_a_map(spark):
    t = datetime(2024, 5, 1)
    features = spark.createDataFrame([("pay", 0, 98, 48, 0.49, ["ann"], datetime(2024, 1, 1), 50.0), ("chat", 1, 5, 0, 0.0, [], t, 88.0)], "feature string, pos int, total_commits long, bug_fixes long, bug_fix_ratio double, authors array<string>, last_modified timestamp, health_score double")
    paths = spark.createDataFrame([("pay", "src/pay/a.ts", 0), ("chat", "src/chat/c.ts", 0)], "feature string, path string, pos int")
    commits = spark.createDataFrame([("s1", "bob", t, True, 7), ("s2", "ann", datetime(2023, 5, 1), False, None), ("s3", "cyd", t, True, 9)], "sha string, author string, ts timestamp, is_bug_fix boolean, pr_number int")
    files = spark.createDataFrame([("s1", "src/pay/a.ts"), ("s1", "src/pay/deep/new.ts"), ("s2", "src/pay/a.ts"), ("s2", "lib/pay_service.ts"), ("s3", "README")], "sha string, path string")
    out, owned, prs = increments.update_map(features, paths, commits, files, F.lit(t))
    rows = {r["feature"]: r for r in out.collect()}
    # one commit of today weighs 2, one of a year ago 0.5; 100 commits are full activity
    assert rows["pay"][2:7] == (100, 49, 0.49, ["ann", "bob"], t) and rows["pay"]["health_score"] == pytest.approx(100 / (1 + 2.718281828 ** (8 * (2 / 2.5 - 0.55))), abs=0.05)
    assert tuple(rows["chat"]) == ("chat", 1, 5, 0, 0.0, [], t, 88.0)
    assert sorted(map(tuple, owned.collect())) == [("chat", "src/chat/c.ts", 0), ("pay", "lib/pay_service.ts", 1), ("pay", "src/pay/a.ts", 0), ("pay", "src/pay/deep/new.ts", 1)]
    assert [(r["feature"], r["number"]) for r in prs.collect()] == [("pay", 7)]


def test_ledger_takes_commits_back(spark, tmp_path):
    """A history that is rewritten: commits come, come again, go, and others take their place."""
    batches = [
        [("f", 1, "add", "a", "ann", True, ["x", "y"]), ("f", 1, "add", "b", "bob", False, ["y"]), ("g", 1, "add", "a", "ann", True, ["z"])],
        [("f", 1, "add", "a", "ann", True, ["x", "y"]), ("f", 2, "drop", "b", None, None, None), ("f", 3, "add", "b2", "bob", True, ["y", "w"]), ("h", 5, "drop", "n", None, None, None)],
        [("f", 4, "drop", "a", None, None, None), ("f", 3, "add", "a", "ann", True, ["x"]), ("f", 6, "add", "b", "cyd", False, None), ("h", 4, "add", "n", "ann", True, ["x"]), ("h", 6, "add", "n", "ann", True, ["x"])],
    ]
    src, at = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    names = [c.split()[0] for c in ledger.EVENTS.split(", ")]
    want = [
        {"f": (2, 1, 2, 2), "g": (1, 1, 1, 1)},
        {"f": (2, 2, 2, 3), "g": (1, 1, 1, 1), "h": (0, 0, 0, 0)},
        {"f": (2, 1, 2, 2), "g": (1, 1, 1, 1), "h": (1, 1, 1, 1)},
    ]
    for n, rows in enumerate(batches):
        (src / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
        query = ledger.start_ledger(spark.readStream.schema(ledger.EVENTS).json(str(src)), at, str(tmp_path / "log"))
        query.awaitTermination()
        got = {r["feature"]: tuple(r)[1:] for r in ledger.current(spark.read.parquet(f"{at}/*")).collect()}
        assert got == want[n]
