"""What keeps the work in step with the input: sizes that aren't guessed too low, tasks by rows, texts scanned once."""

import gc
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from histora.operators import calls, graph, keep, regions, repos, shaping, tools
from histora.plans import commands, links, planted, tables, trees
from histora.plans.domain import Domain
from histora.plans.queries import ORACLE, QUERIES
from histora.sources import intake, languages, scripts
from histora.streaming import ledger

from .conftest import SMALL


def keys(spark, tmp_path, n):
    spark.range(n).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    return Domain(spark, str(tmp_path))


def text(df):
    return df._jdf.queryExecution().toString()


def test_stamped_rows_are_never_broadcast_by_a_guess(spark, tmp_path):
    files = planted.stamped(keys(spark, tmp_path, 100), trees.FILES, trees.REPO)
    joined = files.join(files.select("path").withColumn("x", F.lit(1)), "path")
    assert "SortMergeJoin" in text(joined) and "BroadcastHashJoin" not in text(joined)


def test_stamped_rows_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(planted, "ROWS_A_TASK", 60)
    files = planted.stamped(keys(spark, tmp_path, 100), trees.FILES, trees.REPO)
    assert files.rdd.getNumPartitions() == -(-100 * len(trees.REPO) // 60)
    assert files.count() == 100 * len(trees.REPO)


def test_stamps_reach_into_nested_values(spark, tmp_path):
    d = keys(spark, tmp_path, 2)
    kind = "a array<string>, m map<string,string>, s struct<x:string,n:int>, b boolean"
    got = planted.stamped(d, kind, [(["p{k}", None], {"q{k}": "r{k}"}, ("t{k}", 1), True), (None, None, None, None)]).collect()
    assert [(r.a, r.m, tuple(r.s), r.b) for r in sorted((r for r in got if r.a), key=lambda r: r.a[0])] == [([f"p{k}", None], {f"q{k}": f"r{k}"}, (f"t{k}", 1), True) for k in (0, 1)]
    assert sum(r.s is None and r.m is None for r in got) == 2


@pytest.mark.parametrize("name", ["call_graph", "reach", "resolve", "cross_stack"])
def test_loops_and_joins_read_scans_that_are_written_down(spark, name):
    d = Domain(spark, SMALL)
    files = planted.stamped(d, trees.FILES, trees.REPO)
    if name == "call_graph":
        made = calls.call_graph(trees._graph(files)[0], planted.stamped(d, *trees.ENTRIES))
    elif name == "reach":
        made = graph.reach(scripts.script_edges(files), planted.stamped(d, "seed string, node string", [("s{k}", "r{k}/apps/web/src/page.tsx")]), 2)
    elif name == "resolve":
        made = trees._resolved(files)
    else:
        made = calls.cross_stack(calls.client_calls(planted.stamped(d, trees.FILES, trees.CLIENTS)), planted.stamped(d, *trees.ROUTES))
    assert "MapInPandas" not in text(made) and "regexp_extract_all" not in text(made)


def test_titles_meet_by_rare_words_alone(spark):
    n = 400
    specs = spark.range(n).select(F.concat(F.lit("user can create paid invoice"), "id").alias("title")).unionByName(spark.createDataFrame([("odd",), (None,), ("create large order",)], "title string"))
    journeys = spark.range(n).select(F.concat(F.lit("u"), "id").alias("uf"), F.concat(F.lit("create-paid-invoice"), "id").alias("name")).unionByName(spark.createDataFrame([("t", "order-large"), ("s", "large-order"), (None, "x-y")], "uf string, name string"))
    got = {r.title: (r.uf, r.n) for r in shaping.match_specs(specs, journeys).collect()}
    assert len(got) == n + 3 and got["odd"] == got[None] == (None, None) and got["create large order"] == ("s", 2)
    assert all(got[f"user can create paid invoice{k}"] == (f"u{k}", 3) for k in range(n))


def test_hot_words_of_titles_make_no_pairs(spark, tmp_path):
    """What the join of words gives is the number of titles, not its square."""
    n = 2000
    specs = spark.range(n).select(F.concat(F.lit("create invoice"), "id").alias("title"))
    journeys = spark.range(n).select(F.concat(F.lit("u"), "id").alias("uf"), F.concat(F.lit("create-invoice"), "id").alias("name"))
    out = shaping.match_specs(specs, journeys)
    assert out.where("n = 2").count() == n
    seen = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()
    joined = [m for p in nodes(plan.finalPhysicalPlan(), seen) if "Join" in p.nodeName() for m in [p.metrics().get("numOutputRows")] if m.isDefined()]
    assert joined and max(m.get().value() for m in joined) <= 2 * n


def nodes(plan, seen):
    yield plan
    inner = [plan.plan()] if plan.nodeName().endswith("QueryStage") else list(seen(plan.children()))
    for p in inner:
        yield from nodes(p, seen)


def test_truth_is_parsed_once(spark):
    rows = intake.truth_rows(spark.createDataFrame([("a", "features:\n  - name: x\n  - name: x\n"), ("b", "a: [")], "path string, text string"))
    assert "MapInPandas" not in text(rows)
    assert sorted((r.path, r.kind, r.name) for r in rows.collect())[-1][0] == "b"


def test_parts_with_texts_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "PARTS_A_TASK", 50)
    d = Domain(spark, SMALL)
    assert tables._parts(d).rdd.getNumPartitions() == -(-d.table("part").count() // 50)


def test_lineage_takes_names_in_their_order(spark, tmp_path):
    """Of equal groups the later name is the best: Brand#9 after Brand#25, as the SQL has it."""
    ts = lambda y: f"timestamp_ntz'{y}-01-01 00:00:00'"
    part = [(i, b, "same") for i, b in enumerate(("Brand#9", "Brand#25", "Brand#1"))]
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    lines = [(o * 10 + p, p) for o in (0, 1) for p, _, _ in part]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = spark.createDataFrame([(k,) for k, _ in lines], "o_orderkey long").select("o_orderkey", F.lit(1).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit("2-HIGH").alias("o_orderpriority"), F.expr(f"CASE WHEN o_orderkey < 10 THEN {ts(1995)} ELSE {ts(1999)} END").alias("o_orderdate"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES["lineage_overlap"](spark, str(tmp_path)).select("a_id", "keeps_id", "related_id", "kind").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(f"SELECT a_id, keeps_id, related_id, kind FROM ({ORACLE['lineage_overlap']})").fetchall()))


def test_regions_over_several_stretches_count_once_without_a_broadcast(spark):
    """Fifty regions of a symbol of three stretches, and one over all of them: twenty are kept, the first ones."""
    body = "".join(f"  if (a{k}) {{\n    go()\n  }}\n" for k in range(1, 51))
    files = spark.createDataFrame([(f"s{p}.ts", f"function f() {{\n  if (all) {{\n{body}  }}\n}}\n") for p in range(40)], "path string, text string")
    symbols = files.select("path", F.lit("f").alias("name"), F.lit(1).alias("start"), F.lit(155).alias("end"))
    out = regions.branch_regions(files, symbols)
    assert "BroadcastHashJoin" not in text(out)
    rows = out.collect()
    assert len(rows) == 40 * regions.MOST_REGIONS
    assert {r.condition for r in rows if r.path == "s7.ts"} == {"all", *(f"a{k}" for k in range(1, 20))}


def test_one_features_commits_are_dealt_out(spark, tmp_path):
    """What happens to the commits of one feature, in any order, as a plain walk has it; its commits stand in many parts."""
    rng, names = random.Random(7), [c.split()[0] for c in ledger.EVENTS.split(", ")]
    live: dict[str, tuple] = {}
    at, src = str(tmp_path / "out"), str(tmp_path / "in")
    for n in range(2):
        rows = [("f", rng.randrange(9), rng.choice((ledger.ADD, ledger.DROP)), f"c{rng.randrange(60)}", None, None, None) for _ in range(200)]
        # what an event says of a commit follows from the commit and its place, so that repeats say the same
        rows = [(f, q, k, s, *((f"a{(q + len(s)) % 5}", q % 2 == 0, [f"x{q}", f"y{s}", f"x{q}"]) if k == ledger.ADD else (None, None, None))) for f, q, k, s, *_ in rows]
        for _, q, k, s, *own in sorted(rows, key=lambda r: (r[1], r[2] == ledger.DROP)):
            seq, was, held = live.get(s, (-1, False, None))
            if q >= seq:
                live[s] = (q, k == ledger.ADD, held if was and k == ledger.ADD else own)
        spark.createDataFrame(rows, ledger.EVENTS).select(*names).write.mode("append").parquet(src)
        ledger.start_ledger(spark.readStream.schema(ledger.EVENTS).parquet(src), at, str(tmp_path / "log")).awaitTermination()
        own = [x[2] for x in live.values() if x[1]]
        want = ("f", len(own), sum(x[1] for x in own), len({x[0] for x in own}), len({f for x in own for f in x[2]}))
        assert [tuple(r) for r in ledger.current(spark.read.parquet(f"{at}/*")).collect()] == [want]
    assert len(list((tmp_path / "log-state" / "commits").glob("*/bucket=*"))) > 8


def test_run_time_rows_meet_a_feature_by_path(spark):
    """Equal rows count each, one of several paths once, and none is compared with every path of the feature."""
    features = spark.createDataFrame([("F", ["p1", "p2", "p2"], "f")], "feature string, paths array<string>, display_name string").withColumns({c: F.array().cast("array<string>") for c in ("aliases", "labels")})
    rows = spark.createDataFrame([(["p1", "p2"], 2), (["p1", "p2"], 2), (["p2", None], None), (["no"], 7), ([], 7), (None, 3)], "paths array<string>, count int").withColumn("path", F.lit("p1"))
    out = tools.feature_errors(features, rows, "F")
    assert "arrays_overlap" not in text(out) and "NestedLoop" not in text(out)
    assert [tuple(r) for r in out.collect()] == [("F", 4, 8)]


@pytest.mark.parametrize("name", ["late_imports", "dispatch_registries"])
def test_late_imports_and_registries_are_scanned_once(spark, name):
    files = planted.stamped(Domain(spark, SMALL), trees.FILES, trees.LATE if name == "late_imports" else trees.DISPATCH)
    made = languages.late_edges(files) if name == "late_imports" else languages.dispatch_targets(files)
    assert "MapInPandas" not in text(made)
    assert made.count() == (3 if name == "late_imports" else 6) * 200


def test_texts_of_routes_are_read_before_routes_of_one_pattern_meet(spark):
    """What comes together by pattern is a name and a verdict, not the text; the head of a text is cut once."""
    routes = spark.createDataFrame([("/p", "a.ts", " " * 4096 + "svix"), ("/p", "b.ts", "if (!svix) x"), ("/c", "c.ts", "bullmq"), ("/p", "d.ts", None), (None, "e.ts", "bullmq")], "pattern string, path string, text string")
    out = repos.triggers(routes, spark.createDataFrame([("/c",)], "pattern string")).select("path", "trigger")
    assert sorted(map(tuple, out.collect())) == [("a.ts", "interactive"), ("b.ts", "webhook"), ("c.ts", "scheduled"), ("d.ts", "interactive"), ("e.ts", "queue")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" not in plan[: plan.index("Join")] and plan.count("substring(") == 1


def test_marks_of_routes_are_found_anywhere_in_a_text(spark):
    routes = spark.createDataFrame([("/p", "a.ts", "x" * 100_000 + "svix"), ("/p", "b.ts", " " * 4090 + "new Worker("), ("/p", "c.ts", None), ("/p", "d.ts", " " * 100_000), ("/c", "e.ts", " " * 5000 + "svix")], "pattern string, path string, text string")
    out = repos.triggers(routes, spark.createDataFrame([("/c",)], "pattern string")).select("path", "trigger")
    assert sorted(map(tuple, out.collect())) == [("a.ts", "webhook"), ("b.ts", "queue"), ("c.ts", "interactive"), ("d.ts", "interactive"), ("e.ts", "scheduled")]


def test_scans_take_few_steps_for_what_is_no_code_and_are_written_down(spark):
    """The scan goes from mark to mark, not from character to character: a long string or comment costs next to nothing."""
    long = "x" * 2_000_000
    text_ = f"/* {long} */ const a = '{long}', b = `{long} ${{a}} {long}`;\nexport {{ a }};"
    at = time.process_time()
    found = scripts.read_script(text_)
    assert time.process_time() - at < 1.5
    assert [d[:2] for d in found["defs"]] == [("const", "a"), ("const", "b")] and found["exports"] == [("a", "local", None, "a")]
    files = spark.createDataFrame([("a.ts", "import b from './b'"), ("b.ts", "export default 1"), ("n.ts", None)], "path string, text string")
    scanned = {r.path: r for r in scripts.scan_scripts(files).collect()}
    assert [tuple(x) for x in scanned["a.ts"].imports] == [("default", "./b", "default", "b", 1, False)] and scanned["n.ts"].defs == []
    assert "MapInArrow" in text(scripts.scan_scripts(files)) and "MapInArrow" not in text(scripts.symbol_edges(files))


def test_long_templates_are_dealt_by_their_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(planted, "TEXT_A_TASK", 10_000)
    files = planted.stamped(keys(spark, tmp_path, 100), trees.FILES, [("r{k}/a.tsx", "x" * 1000)])
    assert files.rdd.getNumPartitions() >= 10 and files.count() == 100


def test_tasks_of_stamped_rows_grow_in_size_before_number():
    """12 times the rows gave 12 times the tasks, each with its cost in every exchange."""
    assert planted._tasks(240_000, 10 << 20, 48) == 12  # few rows: small tasks, for all cores
    assert planted._tasks(14_400_000, 3 << 30, 48) == 96  # 768 before
    assert planted._tasks(1_000_000, 1, 1000) == 50


def test_files_tell_their_stems(spark):
    """what a specifier may mean was exploded to fifteen files; now a file names the few stems that mean it, in the same order."""
    stems = ["a/b", "a/b.js", "a/b.jsx", "a/b.mjs", "a/b.ts", "a/b.d", "", "a", "a/index", "a/b.cjs", "a/.js", "a/b.js.ts"]
    tried = {}
    for s in stems:
        swapped = [re.sub(r"\.([cm]?)jsx?$", rf".\g<1>{e}", s) for e in ("ts", "tsx")]
        tried[s] = list(dict.fromkeys([*(s + e for e in scripts._ENDINGS), *swapped]))
    paths = sorted({p for ps in tried.values() for p in ps})
    found = scripts._meant(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert sorted((r.stem, r.nth, r.path) for r in found if r.stem in tried) == sorted((s, n, p) for s, ps in tried.items() for n, p in enumerate(ps))
    assert len(found) <= 5 * len(paths)


def shuffle_bytes(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_shuffles_of_tables_that_are_written_down_are_dropped(spark):
    """shuffle files of all joins on the way stayed until the driver happened to collect its garbage."""
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    files = planted.stamped(Domain(spark, SMALL), trees.FILES, trees.REPO)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = shuffle_bytes(spark)
    edges = scripts.symbol_edges(files)
    assert shuffle_bytes(spark) - before < 20_000 and spark.conf.get(keep.DROPPED, None) != "true"
    assert edges.count() == len(trees.SYMBOLS) * 200


def test_one_scan_serves_imports_and_calls(spark, monkeypatch):
    """a text was scanned for its imports, and twice more for its calls."""
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    made, scan = [], scripts.Scan
    for module in (scripts, calls):
        monkeypatch.setattr(module, "Scan", lambda t: made.append(1) or scan(t))
    found, sites = calls._read("a.ts", "import b from './b';\nfunction f() { b(); b() }")
    assert [s[1:3] for s in sites] == [("f", "b")] * 2 and len(found["imports"]) == 1 and len(made) == 1
    monkeypatch.undo()
    rows = [*trees.REPO, *trees.PYTHON, ("a/x.d.ts", "function f() { g() }"), ("a/y.test.ts", "export function t() { g() }"), ("n.ts", None)]
    files = spark.createDataFrame(rows, "path string, text string")
    scanned, sites = calls.scan_calls(files)
    assert sorted(map(str, scanned.collect())) == sorted(map(str, scripts.scan_scripts(files).collect()))
    assert sorted(map(tuple, sites.collect())) == sorted(map(tuple, calls.calls(files).select("path", "caller", "callee").distinct().collect()))


def test_a_call_graph_leaves_no_shuffles_and_ranks_once(spark):
    """shuffles of every depth stayed, and the cap sorted all nodes twice."""
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    edges = spark.range(3000).select(F.lit("a").alias("path"), F.concat(F.lit("s"), F.col("id") % 3).alias("caller"), F.lit("b").alias("to_path"), F.concat(F.lit("t"), "id").alias("callee"), F.lit(True).alias("cross")).repartition(8, "callee")
    entries = spark.createDataFrame([("f", "a", "s0"), ("g", "a", "s1"), ("h", "z", "z")], "flow string, path string, symbol string")
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = shuffle_bytes(spark)
    graph_ = calls.call_graph(edges, entries, most=1000)
    assert shuffle_bytes(spark) - before < 5_000 and text(graph_).split("== Optimized")[1].split("== Physical")[0].count("Window ") == 1
    got = graph_.groupBy("flow", "kind", "depth").count().collect()
    assert sorted(map(tuple, got)) == [("f", "deep_call_subtree", 1, 1), ("f", "entry", 0, 1), ("f", "import", 1, 999), ("g", "deep_call_subtree", 1, 1), ("g", "entry", 0, 1), ("g", "import", 1, 999), ("h", "entry", 0, 1)]
    assert calls.call_graph(edges, entries, most=1001).where("kind = 'deep_call_subtree'").isEmpty()


def test_a_name_is_chased_once_and_any_file_of_its_stem_is_told(spark):
    """importers of one name each chased it, with both texts of the import in every row."""
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    files = [(f"u{k}.ts", "import { a } from './lib';\nimport { b } from './old.js';\nimport x from 'far';") for k in range(20)]
    files += [("lib/index.ts", "export * from './one';\nexport { c as a } from './two';"), ("lib/two.tsx", "export const c = 1"), ("lib/one.ts", "export const a = 2"), ("old.ts", "export const b = 1"), ("old.tsx", "export const b = 2")]
    files = spark.createDataFrame(files, "path string, text string")
    got = sorted((r.importer, r.name, r.target, r.original, list(r.via), r.how) for r in scripts.symbol_edges(files).collect())
    assert got == sorted([(f"u{k}.ts", "a", "lib/two.tsx", "c", ["lib/index.ts"], "relative") for k in range(20)] + [(f"u{k}.ts", "b", "old.ts", "b", [], "relative") for k in range(20)])
    scanned = scripts.scan_scripts(files)
    wanted = spark.createDataFrame([("lib/index.ts", "a")] * 20, "first string, name string")
    resolved = spark.createDataFrame([("lib/index.ts", "./two", "lib/two.tsx"), ("lib/index.ts", "./one", "lib/one.ts")], "importer string, spec string, target string")
    assert [tuple(r) for r in scripts.chase(wanted, scripts.exports(scanned), resolved).collect()] == [("lib/index.ts", "a", "lib/two.tsx", "c", ["lib/index.ts"])]


def test_stems_and_places_give_the_files_again(spark):
    """a file moved beside its stem; it follows from it."""
    paths = ["a/b.ts", "a/b.d.ts", "a/b.cts", "a/b.tsx", "a/index.jsx", "x", "a.js.ts", "a/b.mts", ".ts", "a/tsx.ctsx"]
    found = scripts._meant(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert found.where(~scripts._means("stem", "nth").eqNullSafe(F.col("path"))).count() == 0 and found.count() >= 2 * len(paths)


def test_a_scan_makes_only_the_tables_that_are_read(spark, monkeypatch):
    """the flows of a scan paid for its edges, reach and metrics too."""
    made = []
    monkeypatch.setattr(commands, "import_edges", lambda files: made.append("edges"))
    monkeypatch.setattr(commands.metrics, "feature_metrics", lambda *a: made.append("metrics"))
    read, text_hits = [], commands.anchors.text_hits
    monkeypatch.setattr(commands.anchors, "text_hits", lambda files: read.append(1) or text_hits(files))
    files = spark.createDataFrame([("web/app/cart/page.tsx", "export default function Page() {}")], "path string, text string")
    commits = spark.createDataFrame([], "sha string, author string, ts timestamp, message string, files array<string>")
    tables = commands.scan(files, commits, "2024-06-01")
    assert [(r.feature, r.flow) for r in tables["flows"].collect()] == [("cart", "browse-cart-flow")]
    assert made == [] and len(read) == 1
    assert set(tables) == {"features", "feature_paths", "routes", "flows", "edges", "reach", "commits"}


def test_mounted_files_are_dealt_by_parts(spark, monkeypatch):
    """one task made and read the files of all parts, since part is a small file; its rows' size was guessed from it."""
    monkeypatch.setattr(links, "PARTS_A_TASK", 50)
    d = Domain(spark, SMALL)
    n = d.table("part").count()
    files = links._mounted_files(d)
    assert files.rdd.getNumPartitions() == -(-n // 50) and files.where("text is not null").distinct().count() == 3 * n
    assert "CartesianProduct" in text(files) or "BroadcastNestedLoopJoin" in text(files)
