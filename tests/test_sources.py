import datetime
import json
import random

from pyspark.sql import functions as F

from histora.plans.queries import ORACLE, QUERIES
from histora.sources import code, history
from histora.streaming import refresh

from .conftest import SMALL


def rows(df, *order):
    return sorted(tuple(r) for r in (df.select(*order) if order else df).collect())


def test_commits_from_json(spark, tmp_path):
    lines = [
        {"sha": "0123456789ab", "author": "a", "ts": "2024-05-01T10:00:00Z", "message": "fix: crash (#7)", "files": ["app/x.ts", "application/y.ts"]},
        {"sha": "b" * 12, "author": "b", "ts": "2023-05-01T10:00:00Z", "message": "old", "files": ["app/z.ts"]},
        {"sha": "c" * 12, "author": "c", "ts": "2024-06-01T10:00:00Z", "message": None, "files": None},
    ]
    (tmp_path / "log.json").write_text("\n".join(map(json.dumps, lines)))
    got = history.read_commits(spark, str(tmp_path), since="2024-01-01", subtree="app/")
    assert rows(got, "short_sha", "is_bug_fix", "pr_number", "files") == [("01234567", True, 7, ["x.ts"])]
    assert rows(history.commit_files(got)) == [("0123456789ab", "x.ts")]


def test_commits_whose_short_ids_are_the_same_stay_apart(spark):
    raw = spark.createDataFrame([("0123456789ab", "a", None, "fix: x", ["p"]), ("01234567ffff", "b", None, "feat: y", ["q"])], history.COMMIT)
    commits = history.prepare_commits(raw)
    assert rows(history.commit_files(commits).join(commits.select("sha", "author", "is_bug_fix"), "sha").select("path", "author", "is_bug_fix")) == [("p", "a", True), ("q", "b", False)]


def test_tree_skips_what_is_no_source(spark, tmp_path):
    for p, t in {"src/a.py": "x = 1", "node_modules/b.js": "", "logo.png": "", "src/deep/c.ts": "//"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    assert rows(history.read_tree(spark, str(tmp_path)), "path", "dir", "ext") == [("src/a.py", "src", "py"), ("src/deep/c.ts", "src/deep", "ts")]


def test_workspaces(spark):
    m = spark.createDataFrame([("apps/web/package.json", '{"name":"web","dependencies":{"ui":"1","react":"2"}}'), ("packages/ui/package.json", '{"name":"ui"}')], "path string, text string")
    assert rows(history.dependency_edges(history.workspaces(m))) == [("apps/web", "packages/ui", "ui")]


def test_cache_and_replay(spark, tmp_path):
    cache = history.TableCache(spark, str(tmp_path / "cache"), ttl_days=10)
    entries = spark.createDataFrame([("k1", "old", "2024-01-01 00:00:00"), ("k1", "new", "2024-02-01 00:00:00")], "key string, value string, written string").withColumn("written", F.col("written").cast("timestamp"))
    keys = spark.createDataFrame([("k1",), ("k2",)], "key string")
    assert cache.misses("s", keys).count() == 2
    cache.write("s", entries)
    assert rows(cache.read("s"), "key", "value") == [("k1", "new")] and rows(cache.misses("s", keys)) == [("k2",)]
    assert cache.read("s", as_of="2025-01-01").count() == 0
    a = history.write_stage(spark.createDataFrame([(1,), (2,)], "x int"), str(tmp_path / "run"), "one")
    assert rows(history.replay_difference(a, spark.createDataFrame([(2,), (3,)], "x int"))) == [(1, "first"), (3, "second")]


SOURCES = {
    "api/users.py": '@router.get("/users/{id}")\ndef f(): pass\n@app.route("/old")\n',
    "web/server.ts": 'app.post("/login", h); fetch("/api/users/" )\nexport async function handler() {}\nimport x from "./lib"\n',
    "cmd/main.go": 'r.GET("/ping", f)\nimport "fmt"\n',
    "config/routes.rb": "Rails.application.routes.draw do\n  resources :posts\n  get '/up'\nend",
    "app/models/post.rb": "class Post < ApplicationRecord\nend",
    "schema.prisma": "model Invoice {\n}\n",
    "app/(shop)/cart/page.tsx": "export default function Page() {}",
    "empty.py": None,
}


def test_anchors(spark):
    files = spark.createDataFrame(list(SOURCES.items()), "path string, text string")
    got = {(r.source, r.method, r.name) for r in code.from_text(files).collect()}
    want = {("fastapi", "GET", "/users/{id}"), ("flask", None, "/old"), ("express", "POST", "/login"), ("url_literals", None, "/api/users/"), ("go_router", "GET", "/ping"), ("rails_routes", "RESOURCES", "posts"), ("rails_routes", "GET", "/up"), ("rails_models", None, "Post"), ("prisma_models", None, "Invoice"), ("js_exports", "FUNCTION", "handler"), ("js_imports", None, "./lib")}
    assert want <= got
    paths = {(r.source, r.name) for r in code.from_paths(files).collect()}
    assert ("next_app", "cart") in paths and ("go_packages", "main.go") not in paths
    assert code.profile_scores(files).first().profile in ("next_app_router", "fastapi_family", "go_server")


def test_python_symbols_and_edges(spark):
    files = spark.createDataFrame([("pkg/a.py", "from .b import f\nimport pkg.c\nclass K:\n    def m(self):\n        pass\n"), ("pkg/b.py", "def f(): pass"), ("pkg/c.py", ""), ("bad.py", "def ("), ("x.ts", "")], "path string, text string")
    got = rows(code.python_symbols(files).where("kind in ('class', 'function')"), "path", "kind", "name", "start", "end")
    assert got == [("pkg/a.py", "class", "K", 3, 5), ("pkg/a.py", "function", "m", 4, 5), ("pkg/b.py", "function", "f", 1, 1)]
    assert code.python_symbols(files).where("kind = 'error'").count() == 1
    assert rows(code.python_edges(files)) == [("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/c.py")]


def test_executable_lines(spark):
    files = spark.createDataFrame([("a.py", "# c\n\nx = 1\n"), ("b.ts", "/* a\n b */\n// c\nlet x\n\n"), ("c.ts", None)], "path string, text string")
    assert rows(code.executable_lines(files)) == [("a.py", 1), ("b.ts", 1), ("c.ts", 0)]


def test_route_matching(spark):
    refs = spark.createDataFrame([("c1", "/api/users/12?x=1"), ("c2", "/nope")], "caller string, url string")
    routes = spark.createDataFrame([("/api/users/:id", "h1"), ("/{a}/users/{id}", "h2"), ("/api/users", "h3")], "pattern string, handler string")
    assert rows(code.match_routes(refs, routes), "caller", "handler") == [("c1", "h1"), ("c1", "h2")]


def test_streamed_refresh_is_idempotent(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    schema = "feature string, sha string, is_bug_fix boolean"

    def drop(name, *r):
        (src / name).write_text("\n".join(json.dumps(dict(zip(("feature", "sha", "is_bug_fix"), x))) for x in r))

    drop("1.json", ("f", "a", True), ("f", "a", True), ("g", "b", False))
    for k in (0, 1):
        refresh.start_refresh(spark.readStream.schema(schema).json(str(src)), out, str(tmp_path / "cp")).awaitTermination()
        if not k:
            drop("2.json", ("f", "c", False))
    assert rows(refresh.snapshot(spark, out, 1)) == [("f", 2, 1), ("g", 1, 0)]
    batch = spark.createDataFrame([("f", "c", False)], schema)
    refresh.merge_into(out)(batch, 1)
    assert rows(refresh.snapshot(spark, out, 1)) == [("f", 2, 1), ("g", 1, 0)]


def test_streamed_bursts(spark, tmp_path):
    events = [("r", "a.ts", "2024-01-01 00:00:00"), ("r", "b.ts", "2024-01-01 00:00:20"), ("r", "node_modules/x.js", "2024-01-01 00:00:40"), ("r", "c.ts", "2024-01-01 01:00:00"), ("r", "d.ts", "2024-01-01 03:00:00")]
    for i, e in enumerate(events):
        (tmp_path / f"{i}.json").write_text(json.dumps(dict(zip(("repo", "path", "ts"), e))))
    q = refresh.bursts(refresh.file_events(spark, str(tmp_path))).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("bursts"), "events")[:2] == [(1,), (2,)]


def test_every_query_runs_on_the_smallest_tables(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name in ("feature_health", "cochange", "test_efficacy", "span_owned_shared", "primary_owner", "lineage_overlap"):
        df = QUERIES[name](spark, SMALL)
        want = con.sql(ORACLE[name])
        assert sorted(df.columns) == sorted(want.columns)
        columns = sorted(df.columns)
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, want.select(*(f'"{c}"' for c in columns)).fetchall())), name


def test_log_is_read_by_ranges(spark, tmp_path):
    """A log as text, cut into ranges anywhere: the same commits and files as a walk through it gives."""
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    r, want, text = random.Random(2), {}, ""
    for i in range(300):
        sha, files = f"{i:040x}", [f"dir{r.randrange(5)}/f {r.randrange(40)}é.ts" for _ in range(r.choice([0, 1, 3, 60]))]
        body = r.choice(["fix: crash (#12)\n\nwith a body\nof lines", "feat: y", "", "a \x1d b"])
        want[sha] = ("Ann Ö", 1_700_000_000 + i, body.strip(), sorted(set(files)))
        text += f"{sha}\x1f{1_700_000_000 + i}\x1fAnn Ö\x1f{body}\n\x1e" + ("\n" + "\x00".join(files) + "\x00" if files else "") + "\x00"
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "one.txt").write_text(text)
    (tmp_path / "log" / "two.txt").write_text("f" * 40 + "\x1f5\x1fbob\x1ffix: z\n\x1e\nsrc/a.ts\x00")
    want["f" * 40] = ("bob", 5, "fix: z", ["src/a.ts"])
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = history.read_log(spark, str(tmp_path / "log"))
            assert {x["sha"]: (x["author"], int(x["ts"].timestamp()), x["message"].strip(), x["files"]) for x in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert history.read_log(spark, str(tmp_path / "log"), since="2023-11-14", subtree="dir1/").where("size(files) = 0").count() == 0


def test_packed_commits_are_pruned_by_month(spark, tmp_path, capsys):
    raw = spark.createDataFrame([(f"{m:040d}", "a", datetime.datetime(2024, m, 3), "fix: x", ["p"]) for m in range(1, 13)], history.COMMIT)
    history.pack_commits(history.prepare_commits(raw), str(tmp_path / "packed"))
    got = history.read_packed(spark, str(tmp_path / "packed"), "2024-05-02")
    got.explain("formatted")
    plan = capsys.readouterr().out
    assert got.count() == 8 and "PartitionFilters: [isnotnull(month" in plan and "GreaterThanOrEqual(ts" in plan
