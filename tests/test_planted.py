"""Planted queries: their rows are those that the cases state, and empty tables give none."""

import json
import urllib.request

import duckdb
import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from histora.operators import server
from histora.plans import planted
from histora.plans.queries import ORACLE, QUERIES
from histora.sources import intake, scripts
from histora.streaming import refresh

from .conftest import SMALL

NAMES = [n for n in ORACLE if QUERIES[n].__qualname__.startswith("_with_checkpoints") and n not in ("identity_match", "import_reach", "import_components", "cocommit_claims", "test_efficacy")]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{SMALL}/part.parquet'")
    return con


@pytest.mark.parametrize("name", [*NAMES, *(f"once:{n}" for n in planted.CASES)])
def test_planted(spark, con, name):
    queries, sql = (planted.CASES, planted.CASE_SQL) if name.startswith("once:") else (QUERIES, ORACLE)
    name = name.removeprefix("once:")
    df = queries[name](spark, SMALL)
    columns = sorted(df.columns)
    want = con.sql(sql[name])
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", ["alias_map", "barrel_chase", "call_graph", "go_edges", "rust_edges", "late_imports", "dispatch_registries", "cross_stack", "framework_links", "branch_slices", "source_fastapi_routes", "source_django_urls", "source_rust_workspace", "profile_composite", "repo_shapes", "entry_flows", "feature_map_round_trip", "result_cache", "command_scan_flows"])
def test_planted_in_empty_tables(spark, tmp_path, name):
    spark.read.parquet(f"{SMALL}/part.parquet").limit(0).write.parquet(str(tmp_path / "part.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_literals(spark):
    assert planted.expected_sql(["a", "b"], [("it's {k}", None), ("x", 0.5)]) == "SELECT replace('it''s {k}', '{k}', p_partkey::VARCHAR) AS a, NULL AS b FROM part UNION ALL SELECT 'x' AS a, 0.5::DOUBLE AS b FROM part"


@pytest.mark.parametrize("text", ["", "}", "/* open", "`a ${", "const a = /[/]/; const b = 1", "'unended\nexport const a = 1", "export", "import x from", "class {", "export default", "a ? b : c", "{" * 2000, "export const x = " + "(" * 500, "if (" * 300])
def test_odd_scripts_are_read(text):
    found = scripts.read_script(text)
    assert set(found) == {"defs", "imports", "exports"}
    assert scripts.read_jsonc(text) == {}


def test_comments_and_strings_are_no_code():
    found = scripts.read_script("const a = 'export function no() {}';\n// export const no = 1\n/* import x from 'no' */\nexport const yes = `import y from 'no'`;")
    assert [d[1] for d in found["defs"]] == ["a", "yes"] and found["imports"] == [] and [e[0] for e in found["exports"]] == ["yes"]


@pytest.mark.parametrize("features", ["features: 3", "features: [a]", "features:\n  - description: x", "features:\n  - name: a\n  - name: a", "- a", "features:\n  - name: a\n    aliases: b"])
def test_bad_truth_is_refused(spark, features):
    with pytest.raises(ValueError):
        intake.read_truth(spark, features)


def test_empty_settings(spark):
    config = intake.read_config("")
    features = spark.createDataFrame([("a", "p")], "feature string, path string")
    assert intake.apply_config(features, config).collect() == features.collect()
    assert intake.render_config(spark.createDataFrame([("a", ["B b"]), ("c", [])], "canonical string, variants array<string>")) == 'features:\n  a:\n    variants:\n      - "B b"\n  c:\n    variants: []\n'


def test_truth_names_what_is_wrong(spark):
    texts = {"a": "features:\n  - name: pay\n    aliases: [bill, ' ']\n  - name: pay\nflows: 3\nsamples:\n  - path: x.ts", "b": ": [", "c": None, "d": "flows:\n  - {name: go, feature: pay}\n  - name: go"}
    rows = intake.truth_rows(spark.createDataFrame(list(texts.items()), "path string, text string")).collect()
    got = sorted((r["path"], r["kind"], r["name"] or "", ",".join(r["words"] or [])) for r in rows)
    assert got == [("a", "error", "", ""), ("a", "error", "", ""), ("a", "error", "pay", ""), ("a", "feature", "pay", ""), ("a", "feature", "pay", "bill"), ("b", "error", "", ""), ("d", "flow", "go", ""), ("d", "flow", "go", "")]


def test_tables_come_back_as_they_were(spark, tmp_path):
    import datetime
    import decimal

    schema = "a long, t timestamp, n timestamp_ntz, d date, b binary, m map<int,array<string>>, s struct<x:double,y:array<int>>, e decimal(10,2), z string"
    t = datetime.datetime(2024, 5, 1, 12, 30, 1, 123456)
    rows = [(2**60, t, t, t.date(), b"\x00\xff", {1: ["p", None], 7: []}, (0.1, [3]), decimal.Decimal("5.25"), "é\n\"'"), (None,) * 9]
    df = spark.createDataFrame(rows, schema)
    intake.write_typed(df, str(tmp_path / "t"))
    back = intake.read_typed(spark, str(tmp_path / "t"))
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_digest_tells_tables_apart(spark):
    of = lambda rows, **more: tuple(intake.digest_of(spark.createDataFrame(rows, "a array<string>, b int, run string"), **more).first())
    rows = [(["y", "x"], 1, "r1"), (["z"], None, "r2")]
    same = of([(["z"], None, "q"), (["x", "y"], 1, "q")], volatile=("run",))
    assert of(rows, volatile=("run",)) == same and of(rows) != same and of(rows[:1], volatile=("run",)) != same and of(rows + rows, volatile=("run",)) != of(rows[:1] * 2 + rows[:1] * 2, volatile=("run",))
    assert of([])[0] == 0


def test_report(spark):
    row = "health_score double, total_commits long, bug_fixes long, bug_fix_ratio double, coverage_pct double"
    features = spark.createDataFrame([("a", 90.0, 10, 0, 0.0, None)], f"feature string, {row}")
    flows = spark.createDataFrame([], f"feature string, flow string, {row}")
    assert "No critical risk zones" in intake.report(features, flows)
    worse = spark.createDataFrame([("a", 40.0, 10, 5, 0.5, 50.0)], f"feature string, {row}")
    assert intake.report(worse, flows).endswith("Top 3 risk zones:\n1. a: 5 bug fixes out of 10 commits (50.0%)\n")


def test_tools_over_http(spark):
    symbols = spark.createDataFrame([("pay", "f1", "p1", "charge", [(3, 9)])], "feature string, flow string, file string, symbol string, ranges array<struct<start:int,end:int>>")
    at = server.http_server({"symbols": symbols})
    import threading

    threading.Thread(target=at.serve_forever, daemon=True).start()
    try:
        body = json.dumps({"tool": "find_symbols_for_feature", "args": {"feature": "pay"}}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{at.server_port}", body)) as r:
            assert json.load(r)["rows"][0]["symbol"] == "charge"
    finally:
        at.shutdown()
        at.server_close()


def test_answers_and_texts_are_bounded(spark):
    rows = spark.range(30).selectExpr("concat('f', id) AS feature", "'d' AS description", "1.0D AS health_score", "0.5D AS bug_fix_ratio", "id AS total_commits", "array('p') AS paths", "1.0D AS coverage_pct")
    cut = server.answer({"features": rows}, {"tool": "list_features"}, most=7)
    assert len(cut["rows"]) == 7 and cut["more"] and "more" not in server.answer({"features": rows}, {"tool": "list_features"})
    with pytest.raises(ValueError):
        intake.render_config(rows.selectExpr("feature AS canonical", "paths AS variants"), most=29)


def test_commits_that_come_again_count_once(spark, tmp_path):
    schema, at = "feature string, sha string, is_bug_fix boolean", str(tmp_path / "state")
    batches = [[("f", "a", True), ("g", "a", False)], [("f", "a", True), ("f", "b", False)], [("g", "c", True)], [("f", "b", False)]]
    for n, rows in enumerate(batches):
        refresh.merge_into(at, buckets=4)(spark.createDataFrame(rows, schema), n)
    got = lambda n: sorted(tuple(r) for r in refresh.snapshot(spark, at, n).collect())
    assert got(3) == [("f", 2, 1), ("g", 2, 1)]
    refresh.merge_into(at, buckets=4)(spark.createDataFrame(batches[3], schema), 3)  # run again after a failure
    assert got(3) == [("f", 2, 1), ("g", 2, 1)] and refresh.snapshot(spark, str(tmp_path / "none"), 1) is None
