"""Planted cases for predicates, readers, sinks, classification, journeys, tools and commands."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, journeys, ownership, repos, sets, shaping, tools
from ..sources import anchors, code, history, intake
from ..streaming import refresh
from . import commands
from .planted import once, planted

FILES = "path string, text string"
PATHS = "path string"


def _scratch(spark: SparkSession, label: str) -> str:
    """A folder of its own where the cluster shares files; on one machine, as in tests, a local one stands in."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{(at or '/tmp/histora-checkpoints').rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _scalar(name: str, schema: str, rows: list[tuple], columns: str, want: list[tuple], **made) -> None:
    """A case of column expressions over one table."""
    planted(name, {"rows": (schema, rows)}, lambda rows: rows.select("*", *(f.alias(c) if not callable(f) else f().alias(c) for c, f in made.items())), columns, want)


# -- predicates and scalars --------------------------------------------------------

PLACES = ["src{k}/a.ts", "src{k}/__tests__/a.ts", "a{k}/app.e2e-spec.ts", "a{k}/webhook-test-header.tsx", "a{k}/latest.ts", "a{k}/test_x.py", "tests/a{k}.ts", "spec{k}/vendor/a.ts", "a{k}/foo_test.go", "node_modules/x{k}.js"]
_scalar(
    "test_and_vendor_paths", PATHS, [(p,) for p in PLACES], "path v2 legacy vendor",
    [(p, *v) for p, v in zip(PLACES, [(False, False, False), (True, True, True), (True, False, False), (False, False, False), (False, False, False), (True, True, False), (True, True, True), (False, False, True), (True, False, True), (False, False, True)], strict=True)],
    v2=lambda: text.is_test_path("path"), legacy=lambda: text.is_test_path_legacy("path"), vendor=lambda: text.is_vendor_or_test("path"),
)
_scalar(
    "generated_files", FILES, [("a{k}/x.pb.go", None), ("a{k}/x_pb2.py", None), ("a{k}/user.generated.ts", "x"), ("a{k}/q.sql_generated.go", None), ("zz_generated.k{k}.go", None), ("a{k}/b.go", "// Code generated by x. DO NOT EDIT."), ("a{k}/b.ts", None)], "path named any",
    [("a{k}/x.pb.go", True, True), ("a{k}/x_pb2.py", True, True), ("a{k}/user.generated.ts", False, False), ("a{k}/q.sql_generated.go", True, True), ("zz_generated.k{k}.go", True, True), ("a{k}/b.go", False, True), ("a{k}/b.ts", False, False)],
    named=lambda: text.is_generated("path"), any=lambda: text.is_generated("path", F.col("text")),
)
_scalar(
    "infra_files", PATHS, [(p,) for p in ("Dockerfile", "k{k}/config.yml", "a/b{k}/c.yml", "src{k}/docs/a.ts", ".storybook/m{k}.ts", "src/k{k}.ts", "a/b{k}/package.json", "prisma/x{k}.ts")], "path infra",
    [("Dockerfile", True), ("k{k}/config.yml", True), ("a/b{k}/c.yml", False), ("src{k}/docs/a.ts", True), (".storybook/m{k}.ts", True), ("src/k{k}.ts", False), ("a/b{k}/package.json", True), ("prisma/x{k}.ts", True)],
    infra=lambda: text.is_infra("path"),
)
SYMBOLS = [
    ("useDeleteUserMutation", "function", "a{k}.ts", False, "data-fetch"), ("isLoadingError", "const", "a{k}.ts", False, "loading-state"), ("formErrors", "const", "a{k}.ts", False, "error-state"), ("terror", "const", "a{k}.ts", False, "helper"),
    ("UserSchema", "const", "a{k}.ts", False, "validator"), ("useScrollEffect", "function", "a{k}.ts", False, "side-effect"), ("useCart", "function", "a{k}.ts", False, "state"), ("handleClick", "function", "a{k}.tsx", False, "handler"),
    ("Card", "function", "a{k}.tsx", False, "ui-component"), ("Card", "function", "a{k}.ts", False, "helper"), ("GET", "function", "a{k}.ts", True, "entry"), ("Props", "type", "a{k}.ts", False, "type"), ("", "function", "a{k}.ts", False, "helper"),
]
_scalar("symbol_roles", "name string, kind string, path string, routes boolean", [r[:4] for r in SYMBOLS], "name kind path role", [(r[0], r[1], r[2], r[4]) for r in SYMBOLS], role=lambda: text.symbol_role(F.col("name"), F.col("kind"), F.col("path"), F.col("routes")))
_scalar("remote_urls", "a string", [("git@github.com:o{k}/r.git",), ("https://h/o{k}/r/",), ("https://h/o{k}/r",)], "a url", [("git@github.com:o{k}/r.git", "https://github.com/o{k}/r"), ("https://h/o{k}/r/", "https://h/o{k}/r"), ("https://h/o{k}/r", "https://h/o{k}/r")], url=lambda: text.remote_url("a"))
_scalar("strict_containment", "id string, b array<string>, c array<string>", [("a{k}", ["x{k}", "y"], ["x{k}", "y", "z"]), ("b{k}", ["x"], ["x", "y"]), ("c{k}", ["x", "y"], ["x", "y"]), ("d{k}", ["x", "x", "y"], ["y", "x", "z"])], "id inner", [("a{k}", True), ("b{k}", False), ("c{k}", False), ("d{k}", True)], inner=lambda: text.strictly_contained(F.col("b"), F.col("c")))
_scalar("display_names", "flow string", [("create-order{k}-flow",), ("list_items",)], "flow shown", [("create-order{k}-flow", "Create Order{k}"), ("list_items", "List Items")], shown=lambda: text.title_case(F.regexp_replace("flow", "-flow$", "")))
_scalar("file_routes", PATHS, [("app/(shop)/items{k}/[id]/page.tsx",), ("app/page.tsx",), ("lib/a{k}.ts",), ("src/routes/x{k}/+page.svelte",)], "path route", [("app/(shop)/items{k}/[id]/page.tsx", "/items{k}/{id}"), ("app/page.tsx", "/"), ("lib/a{k}.ts", None), ("src/routes/x{k}/+page.svelte", "/x{k}")], route=lambda: text.path_to_route("path"))
_scalar("deeplinks", "file string, ranges array<struct<start:int,end:int>>", [("a{k}.ts", [(3, 9), (12, 12)])], "file links", [("a{k}.ts", "https://h/blob/HEAD/a{k}.ts#L3-L9 https://h/blob/HEAD/a{k}.ts#L12-L12")], links=lambda: F.array_join(text.deeplinks(F.lit("https://h"), F.col("file"), F.col("ranges")), " "))
once("response_sizes", {"rows": ("a string, b int", [("x" * 20, 1), ("", None)])}, lambda rows: rows.select("a", text.response_tokens(F.col("a"), F.col("b")).alias("tokens")), "a tokens", [("x" * 20, 8), ("", 2)])

# -- readers -----------------------------------------------------------------------

COMMITS = "sha string, author string, ts timestamp, message string, files array<string>"
T0 = datetime.datetime(2024, 5, 1)
RAW = [
    ("abcdef0123{k}", "ann", T0, "fix: crash (#12)", ["apps/web/a{k}.ts", "apps/webx/b.ts"]),
    ("bcdef01234{k}", "bob", T0 - datetime.timedelta(days=40), "fix typo in docs", ["apps/web/a{k}.ts"]),
    ("cdef012345{k}", "ann", T0 + datetime.timedelta(days=1), "Merge pull request #7 from x", ["README{k}.md"]),
]
planted(
    "history_scan",
    {"raw": (COMMITS, RAW)},
    lambda raw: history.prepare_commits(raw, "2024-04-01").withColumn("files", F.array_join("files", ",")).withColumn("sha", F.col("short_sha")),
    "sha author message files is_bug_fix pr_number",
    [("abcdef01", "ann", "fix: crash (#12)", "apps/web/a{k}.ts,apps/webx/b.ts", True, 12), ("cdef0123", "ann", "Merge pull request #7 from x", "README{k}.md", False, 7)],
)
planted("history_subtree", {"raw": (COMMITS, RAW)}, lambda raw: history.prepare_commits(raw, None, "apps/web/").withColumn("files", F.array_join("files", ",")).withColumn("sha", F.col("short_sha")), "sha files", [("abcdef01", "a{k}.ts"), ("bcdef012", "a{k}.ts")])


def _snapshots(raw: DataFrame) -> DataFrame:
    shared = intake.Snapshot(raw, most=None)
    whole, web = shared.of(), shared.of("apps/web")
    return whole.select(F.lit("all").alias("tree"), F.col("short_sha").alias("sha"), F.explode("files").alias("path")).unionByName(web.select(F.lit("web").alias("tree"), F.col("short_sha").alias("sha"), F.explode("files").alias("path")))


planted(
    "history_snapshot",
    {"raw": (COMMITS, RAW)},
    _snapshots,
    "tree sha path",
    [("all", "abcdef01", "apps/web/a{k}.ts"), ("all", "abcdef01", "apps/webx/b.ts"), ("all", "bcdef012", "apps/web/a{k}.ts"), ("all", "cdef0123", "README{k}.md"), ("web", "abcdef01", "a{k}.ts"), ("web", "bcdef012", "a{k}.ts")],
)
planted("tree_scan", {"files": (FILES, [("src{k}/a.ts", "x"), ("node_modules/b{k}.js", "x"), ("a{k}/logo.png", "x"), ("c{k}.py", None)])}, history.describe_files, "path dir ext", [("src{k}/a.ts", "src{k}", "ts"), ("c{k}.py", "", "py")])
MANIFESTS = [("p{k}/package.json", '{"name": "@o/p{k}", "dependencies": {"@o/q{k}": "1"}, "devDependencies": {"x": "1"}}'), ("q{k}/package.json", '{"name": "@o/q{k}"}')]
planted("workspace_manifests", {"manifests": (FILES, MANIFESTS)}, history.workspaces, "dir name dependency", [("p{k}", "@o/p{k}", "@o/q{k}"), ("p{k}", "@o/p{k}", "x"), ("q{k}", "@o/q{k}", None)])
planted("workspace_edges", {"manifests": (FILES, MANIFESTS)}, lambda manifests: history.dependency_edges(history.workspaces(manifests)), "from_dir to_dir dependency", [("p{k}", "q{k}", "@o/q{k}")])
planted(
    "nested_manifests",
    {"files": (PATHS, [("package.json",), ("a{k}/b/package.json",), ("a{k}/go.mod",), ("a{k}/b/c/d/e/Cargo.toml",), ("a{k}/x.json",), ("s{k}/pnpm-workspace.yaml",)])},
    intake.nested_manifests,
    "dir kind depth",
    [("a{k}/b", "npm", 2), ("a{k}", "go", 1), ("s{k}", "pnpm", 1)],
)
planted(
    "stacks_of_directories",
    {"files": (FILES, [("a{k}/package.json", '{"dependencies": {"next": "1", "vite": "1"}}'), ("b{k}/package.json", '{"dependencies": {"next": "1"}}'), ("b{k}/pages/x.tsx", ""), ("c{k}/requirements.txt", "FastAPI==1"), ("d{k}/go.mod", "module x"), ("e{k}/package.json", "{}")])},
    intake.stacks,
    "dir stack",
    [("a{k}", "next-app-router"), ("b{k}", "next-pages"), ("c{k}", "fastapi"), ("d{k}", "go"), ("e{k}", "node")],
)


def _context(files: DataFrame, raw: DataFrame) -> DataFrame:
    out = intake.intake(files, raw, subtree="apps/web")
    rows = [out["files"].select(F.lit("file").alias("kind"), F.col("path").alias("what")), out["stacks"].select(F.lit("stack").alias("kind"), F.concat_ws(":", "dir", "stack").alias("what")), out["commit_files"].select(F.lit("commit").alias("kind"), F.concat_ws(":", F.substring("sha", 1, 8), "path").alias("what")), out["workspaces"].select(F.lit("package").alias("kind"), F.col("name").alias("what"))]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    return both.distinct()


planted(
    "intake_context",
    {"files": (FILES, [("apps/web/w{k}/package.json", '{"name": "web{k}", "dependencies": {"express": "1"}}'), ("apps/web/w{k}/a.ts", ""), ("apps/webx/b{k}.ts", "")]), "raw": (COMMITS, RAW)},
    _context,
    "kind what",
    [("file", "w{k}/package.json"), ("file", "w{k}/a.ts"), ("stack", "w{k}:express"), ("package", "web{k}"), ("commit", "abcdef01:a{k}.ts"), ("commit", "bcdef012:a{k}.ts")],
)
planted(
    "product_strings",
    {
        "files": (
            FILES,
            [
                ("l{k}/locales/en/common.json", '{"b": {"title": "Pay now {k}"}, "a": "Carts"}'), ("l{k}/locales/de/common.json", '{"a": "Körbe"}'), ("l{k}/README.md", "# Never"),
                ("l{k}/sidebar.tsx", "const items = [{ label: 'Billing', href: '/billing{k}' }, { icon: x, title: \"Team\" }];\n<Link href=\"/faq\">Help {k}</Link>"), ("l{k}/app/page.tsx", "export const metadata = { title: 'Home {k}' };\n<h1>Welcome</h1>"), ("l{k}/x.ts", "const a = { label: 'No', href: '/no' }"),
            ],
        )
    },
    intake.product_strings,
    "path source text nth",
    [
        ("l{k}/locales/en/common.json", "i18n", "Carts", 0), ("l{k}/locales/en/common.json", "i18n", "Pay now {k}", 1), ("l{k}/sidebar.tsx", "nav", "Billing (/billing{k})", 0), ("l{k}/sidebar.tsx", "nav", "Team", 1), ("l{k}/sidebar.tsx", "nav", "Help {k} (/faq)", 2),
        ("l{k}/app/page.tsx", "title", "Home {k}", 0), ("l{k}/app/page.tsx", "title", "Welcome", 1),
    ],
)
planted(
    "product_evidence",
    {"strings": ("path string, source string, text string, nth int", [("a{k}", "i18n", "one", 0), ("b{k}", "nav", "two", 0), ("b{k}", "title", "three", 1), ("b{k}", "nav", "one", 2)]), "members": ("feature string, path string, anchor boolean", [("f{k}", "a{k}", True), ("f{k}", "b{k}", False)])},
    intake.evidence,
    "feature text nth",
    [("f{k}", "one", 1), ("f{k}", "two", 2), ("f{k}", "three", 3)],
)
planted("executable_lines", {"files": (FILES, [("a{k}.py", "# c\n\nx = 1\n"), ("b{k}.ts", "/* a\n b */\n// c\nlet x\n\n"), ("c{k}.ts", None)])}, code.executable_lines, "path loc", [("a{k}.py", 1), ("b{k}.ts", 1), ("c{k}.ts", 0)])

planted(
    "text_rules",
    {"files": (FILES, [("a{k}.prisma", "model Bill{k} {"), ("b{k}.go", 'r.GET("/x{k}", h)'), ("c{k}.ts", "export async function go{k}() {}"), ("d{k}.ts", None)])},
    lambda files: code.from_text(files).where("source in ('prisma_models', 'go_router', 'js_exports')"),
    "source path method name",
    [("prisma_models", "a{k}.prisma", None, "Bill{k}"), ("go_router", "b{k}.go", "GET", "/x{k}"), ("js_exports", "c{k}.ts", "FUNCTION", "go{k}")],
)
TRUTH = ("features:\n  - name: billing\n    aliases: [pay, checkout]\n    must_include: [a.ts]\n  - name: auth\n    description: login\n", "flows:\n  - name: pay-order\n    feature: billing\n", "samples:\n  - path: a.ts\n    expected: billing\n")


def _truth(one: DataFrame) -> DataFrame:
    t = intake.read_truth(one.sparkSession, *TRUTH)
    rows = t["features"].select(F.lit("feature").alias("kind"), "name", F.array_join("aliases", ",").alias("more"))
    return rows.unionByName(t["flows"].select(F.lit("flow").alias("kind"), "name", F.col("feature").alias("more"))).unionByName(t["attribution"].select(F.lit("sample").alias("kind"), F.col("path").alias("name"), F.col("expected").alias("more")))


once("truth_files", {"one": ("x int", [(1,)])}, _truth, "kind name more", [("feature", "billing", "pay,checkout"), ("feature", "auth", ""), ("flow", "pay-order", "billing"), ("sample", "a.ts", "billing")])
CONFIG = "features:\n  billing:\n    variants: [Pay, invoices]\n  documentation:\n    variants: []\nskip_features: [junk, examples]\nforce_merges:\n  - into: core\n    sources: [kernel]\nauto_aliases:\n  login:\n    variants: [signin]\n"
planted(
    "repo_config",
    {"features": ("feature string, path string", [("invoices", "a{k}"), ("JUNK", "b{k}"), ("examples", "c{k}"), ("kernel", "d{k}"), ("signin", "e{k}"), ("other", "f{k}")])},
    lambda features: intake.apply_config(features, intake.read_config(CONFIG)),
    "feature path",
    [("billing", "a{k}"), ("examples", "c{k}"), ("core", "d{k}"), ("login", "e{k}"), ("other", "f{k}")],
)
planted(
    "suggested_config",
    {"files": (FILES, [*MANIFESTS, ("x{k}/package.json", '{"name": "p{k}"}')])},
    lambda files: commands.suggest_config(files).withColumn("variants", F.array_join("variants", ",")).withColumn("by", F.array_join("by", ",")),
    "canonical variants by",
    [("p{k}", "@o/p{k}", "manifest"), ("q{k}", "@o/q{k}", "manifest")],
)
once("code_owners", {"files": (FILES, [(".github/CODEOWNERS", "# c\n/pay/ @org/billing-team @ann\n*.md docs@x.io\n"), ("a/CODEOWNERS", "* @no")])}, intake.code_owners, "pattern team", [("/pay/", "@org/billing-team"), ("/pay/", "@ann")])

# -- sinks -------------------------------------------------------------------------

MAP = ("feature string, uuid string, paths array<string>, total_commits long, bug_fixes long, health_score double", [("f{k}", "u{k}", ["a{k}"], 3, 1, 80.5), ("g{k}", "v{k}", ["b{k}", "c{k}"], 1, 0, 100.0)])
FLOWS = ("feature string, flow string, uuid string, paths array<string>", [("f{k}", "x{k}", "1{k}", ["a{k}"]), ("f{k}", "y{k}", "2{k}", ["a{k}", "b{k}"])])


def _round_trip(features: DataFrame, flows: DataFrame) -> DataFrame:
    at = _scratch(features.sparkSession, "map")
    history.write_feature_map(features, flows, at)
    base = intake.read_base(features.sparkSession, at)
    return base["features"].select("feature", F.array_join("paths", ",").alias("paths"), "total_commits", F.lit(None).cast("string").alias("flow")).unionByName(base["flows"].select("feature", F.array_join("paths", ",").alias("paths"), F.lit(None).cast("long").alias("total_commits"), "flow"))


planted("feature_map_round_trip", {"features": MAP, "flows": FLOWS}, _round_trip, "feature paths total_commits flow", [("f{k}", "a{k}", 3, None), ("g{k}", "b{k},c{k}", 1, None), ("f{k}", "a{k}", None, "x{k}"), ("f{k}", "a{k},b{k}", None, "y{k}")])


def _base_document(docs: DataFrame) -> DataFrame:
    at = _scratch(docs.sparkSession, "base")
    docs.select("text").write.text(at)
    return intake.read_base(docs.sparkSession, at)["flows"].select("feature", "flow")


once("base_scan", {"docs": ("text string", [('{"features": [{"feature": "f", "paths": ["a"], "flows": [{"flow": "x", "uuid": "1", "paths": []}]}, {"feature": "g", "flows": []}]}',)])}, _base_document, "feature flow", [("f", "x")])


def _replayed(rows: DataFrame) -> DataFrame:
    spark, run = rows.sparkSession, _scratch(rows.sparkSession, "run")
    history.write_stage(rows, run, "stage")
    changed = rows.withColumn("n", F.when(F.col("id").like("b%"), F.col("n") + 1).otherwise(F.col("n")))
    return commands.replay(run, "stage", lambda _: changed, spark)


planted("stage_replay", {"rows": ("id string, n int", [("a{k}", 1), ("b{k}", 2)])}, _replayed, "id n only_in", [("b{k}", 2, "first"), ("b{k}", 3, "second")])


def _cached(keys: DataFrame) -> DataFrame:
    cache = history.TableCache(keys.sparkSession, _scratch(keys.sparkSession, "cache"), ttl_days=30)
    at = F.lit("2024-05-01").cast("timestamp")
    cache.write("parse", keys.where("key not like 'c%'").select("key", F.lit("old").alias("value"), at.alias("written")))
    cache.write("parse", keys.where("key like 'a%'").select("key", F.lit("new").alias("value"), (at + F.expr("INTERVAL 1 DAY")).alias("written")))
    cache.write("parse", keys.where("key like 'c%'").select("key", F.lit("stale").alias("value"), (at - F.expr("INTERVAL 90 DAY")).alias("written")))
    live = cache.read("parse", "2024-05-05").select("key", "value")
    return live.unionByName(cache.misses("parse", keys, "2024-05-05").select("key", F.lit("missing").alias("value")))


planted("result_cache", {"keys": ("key string", [("a{k}",), ("b{k}",), ("c{k}",)])}, _cached, "key value", [("a{k}", "new"), ("b{k}", "old"), ("c{k}", "missing")])


def _logged(records: DataFrame) -> DataFrame:
    at = _scratch(records.sparkSession, "log")
    history.append_log(records.where("id like 'a%'"), at)
    history.append_log(records.where("id like 'b%'"), at)
    return records.sparkSession.read.schema("id string, choice string").json(at)


planted("decision_log", {"records": ("id string, choice string", [("a{k}", "x"), ("b{k}", None)])}, _logged, "id choice", [("a{k}", "x"), ("b{k}", None)])
RISK = "health_score double, total_commits long, bug_fixes long, bug_fix_ratio double, coverage_pct double"
once(
    "risk_report",
    {"features": (f"feature string, {RISK}", [("a", 90.0, 10, 1, 0.1, None), ("b", 40.4, 10, 5, 0.5, 62.0)]), "flows": (f"feature string, flow string, {RISK}", [("b", "y", 50.0, 4, 1, 0.25, None), ("b", "x", 50.0, 4, 2, 0.5, None)])},
    intake.report_lines,
    "n line",
    [(1, "| b | 40 | 10 | 5 | 50.0% | 62% |"), (2, "| - x | 50 | 4 | 2 | 50.0% | - |"), (3, "| - y | 50 | 4 | 1 | 25.0% | - |"), (4, "| a | 90 | 10 | 1 | 10.0% | - |")],
)
once("stable_order", {"rows": ("a array<string>, b int", [(["y", "x"], 2), (["z"], 1)])}, lambda rows: intake.stable(rows).select(F.array_join("a", ",").alias("a"), "b"), "a b", [("x,y", 2), ("z", 1)])

# -- classification ----------------------------------------------------------------

REPOS = {
    "shop{k}": [("package.json", '{"dependencies": {"next": "1"}}'), ("app/page.tsx", "")],
    "mono{k}": [("package.json", "{}"), ("turbo.json", "{}"), ("apps/web/package.json", "{}"), ("packages/ui/package.json", "{}"), ("apps/web/src/a.ts", "")],
    "lib{k}": [("package.json", '{"name": "x", "main": "i.js"}')],
    "pylib{k}": [("pyproject.toml", '[project]\nname = "tool{k}"\ndependencies = ["numpy"]')],
    "pyapp{k}": [("pyproject.toml", '[project]\nname = "x{k}"\ndependencies = ["fastapi>=1"]'), ("x/main.py", "app = FastAPI()")],
    "rails{k}": [("Gemfile", ""), ("app/controllers/a.rb", ""), ("app/models/b.rb", "")],
    "god{k}": [("go.mod", "module x/god{k}"), ("cmd/d/main.go", ""), ("server/a.go", "")],
    "gocli{k}": [("go.mod", "module x/c{k}"), ("main.go", "")],
    "golib{k}": [("go.mod", "module x/l{k}"), ("l.go", "")],
    "rust{k}": [("Cargo.toml", "[workspace]\nmembers = []"), ("crates/a/Cargo.toml", "[package]"), ("crates/b/Cargo.toml", "[package]")],
    "flask{k}": [("pyproject.toml", '[project]\nname = "flask"')],
    "empty{k}": [("a.txt", "")],
}
TREES = ("repo string, path string, text string", [(r, *f) for r, fs in REPOS.items() for f in fs])
planted(
    "repo_classes",
    {"files": TREES},
    lambda files: repos.repo_class(repos.signals(files)),
    "repo class confidence suppressed",
    [
        ("shop{k}", "product-app", 0.95, False), ("mono{k}", "product-app", 0.95, False), ("lib{k}", "library", 0.85, True), ("pylib{k}", "library", 0.85, True), ("pyapp{k}", "product-app", 0.95, False), ("rails{k}", "product-app", 0.95, False),
        ("god{k}", "infra-daemon", 0.9, True), ("gocli{k}", "cli-tool", 0.8, True), ("golib{k}", "library", 0.85, True), ("rust{k}", "product-app", 0.4, False), ("flask{k}", "framework", 0.9, True), ("empty{k}", "product-app", 0.4, False),
    ],
)
planted(
    "repo_shapes",
    {"files": TREES},
    commands.classify_shape,
    "repo shape confidence rollup",
    [
        ("shop{k}", "single-saas-routed", 0.85, "single_saas"), ("mono{k}", "turborepo-monorepo", 0.95, "turborepo"), ("lib{k}", "oss-library", 0.9, "library"), ("pylib{k}", "oss-library", 0.9, "library"), ("pyapp{k}", "single-saas-routed", 0.85, "single_saas"),
        ("rails{k}", "backend-monolith", 0.9, "backend"), ("god{k}", "go-server", 0.9, "go_server"), ("gocli{k}", "go-library", 0.9, "library"), ("golib{k}", "go-library", 0.9, "library"), ("rust{k}", "rust-workspace", 0.85, "universal"),
        ("flask{k}", "oss-library", 0.9, "library"), ("empty{k}", "universal-residual", 0.4, "universal"),
    ],
)
planted(
    "project_partitions",
    {"files": ("repo string, path string, text string", [("m{k}", "apps/web/package.json", '{"dependencies": {"next": "1"}}'), ("m{k}", "apps/web/app/page.tsx", ""), ("m{k}", "packages/ui/package.json", '{"main": "i.js"}'), ("m{k}", "README.md", "")])},
    repos.partition,
    "repo workspace files class confidence scan",
    [("m{k}", "apps/web", 2, "product-app", 0.95, True), ("m{k}", "packages/ui", 1, "library", 0.85, False), ("m{k}", "root", 1, "product-app", 0.4, False)],
)
planted(
    "route_triggers",
    {"routes": ("pattern string, path string, text string", [("/k{k}/digest", "a{k}.ts", None), ("/x", "api/cron/b{k}.ts", None), ("/y", "src/workers/c{k}.ts", None), ("/webhooks/z", "d{k}.ts", None), ("/s", "e{k}.ts", "if (!svix.ok) x"), ("/q", "f{k}.ts", "import 'bullmq'"), ("/p", "g{k}.ts", " " * 4096 + "svix")]), "files": (FILES, [("v{k}/vercel.json", '{"crons": [{"path": "/k{k}/digest?x=1", "schedule": "0"}]}')])},
    lambda routes, files: repos.triggers(routes, repos.cron_paths(files)),
    "path trigger",
    [("a{k}.ts", "scheduled"), ("api/cron/b{k}.ts", "scheduled"), ("src/workers/c{k}.ts", "queue"), ("d{k}.ts", "webhook"), ("e{k}.ts", "webhook"), ("f{k}.ts", "queue"), ("g{k}.ts", "webhook")],
)
SURFACED = [
    ("app/(marketing)/pricing{k}/page.tsx", "marketing"), ("app/(dashboard)/blog/p{k}/page.tsx", "product"), ("apps/web/app/legal/t{k}/page.tsx", "legal"), ("src/features/blog-model/a{k}.ts", None), ("apps/docs/app/guides/a{k}/page.tsx", "docs"),
    ("packages/cli/src/i{k}.ts", "dev_tooling"), ("website/src/x{k}.ts", "marketing"), ("app/(.)pricing/x{k}/page.tsx", None), ("x{k}/app/(shop)/privacy/page.tsx", "legal"),
]
planted("surface_paths", {"rows": (PATHS, [(p,) for p, _ in SURFACED])}, lambda rows: rows.select("path", shaping.surface_signal("path").alias("scope")), "path scope", SURFACED)
INK = [("a{k}/locales/en.json", "locale"), ("i18n/d{k}.po", "locale"), ("messages/m{k}/package.json", None), ("lang/tsconfig.k{k}.json", None), ("s{k}/__generated__/t.ts", "generated"), ("s{k}/api.generated.ts", "generated"), ("s{k}/mocks/d.ts", "testing"), ("p{k}/testing/mock-data/a.ts", "testing"), ("db{k}/seeds/u.ts", "seed"), ("s{k}/a.ts", None)]
planted("artifact_paths", {"rows": (PATHS, [(p,) for p, _ in INK])}, lambda rows: rows.select("path", shaping.artifact_kind("path").alias("kind")), "path kind", INK)
planted(
    "terminal_classes",
    {"gaps": ("gap string, path string", [("g{k}", "a{k}"), ("g{k}", "b{k}"), ("h{k}", None), ("i{k}", "x{k}.tf"), ("j{k}", "q{k}"), ("j{k}", "r{k}")]), "owners": ("path string, feature string", [("a{k}", "F{k}"), ("q{k}", "F{k}")])},
    lambda gaps, owners: shaping.terminal_class(gaps, owners, F.endswith("path", F.lit(".tf"))),
    "gap members class part_of",
    [("g{k}", 2, "part_of", "F{k}"), ("h{k}", 0, "not_a_feature", None), ("i{k}", 1, "infra", None), ("j{k}", 2, "part_of", "F{k}")],
)
planted("schema_only_features", {"features": ("feature string, sources array<string>", [("a{k}", ["schema"]), ("b{k}", ["route", "schema"]), ("c{k}", [])])}, shaping.schema_only, "feature", [("a{k}",), ("c{k}",)])
planted("residual_guards", {"residual": ("feature string, path string", [("a{k}", "x{k}"), ("a{k}", "y{k}"), ("b{k}", "z{k}"), ("c{k}", "p{k}"), ("c{k}", "q{k}")]), "known": ("feature string", [("c{k}",)])}, shaping.guard_residual, "feature paths", [("a{k}", 2)])

# -- features and flows ------------------------------------------------------------

planted("directory_candidates", {"files": (PATHS, [("src{k}/pay/a.ts",), ("src{k}/pay/b.ts",), ("main{k}.py",)])}, sets.candidates, "path feature", [("src{k}/pay/a.ts", "src{k}/pay"), ("src{k}/pay/b.ts", "src{k}/pay"), ("main{k}.py", "main{k}")])
planted(
    "source_fan_out",
    {"files": (FILES, [("f{k}/main.py", "@app.get('/orders{k}')\ndef x(): pass"), ("f{k}/bad.prisma", "model"), ("app/controllers/bill{k}_controller.rb", ""), ("cmd/run{k}/main.go", 'r.GET("/up{k}", h)')])},
    lambda files: anchors.text_hits(files).unionByName(anchors.path_hits(files)).select("source", "name", "path").where("name <> ''"),
    "source name path",
    [("mvc", "bill{k}", "app/controllers/bill{k}_controller.rb"), ("go-router", "up{k}", "cmd/run{k}/main.go"), ("go-package", "run{k}", "cmd/run{k}/main.go")],
)
planted(
    "reconciled_features",
    {"candidates": ("id string, name string, source string, priority int, confidence double, paths array<string>", [("1{k}", "billing{k}", "route", 2, 0.5, ["a{k}", "b{k}"]), ("2{k}", "Billing{k}", "schema", 1, 0.9, ["c{k}"]), ("3{k}", "invoices{k}", "mvc", 1, 0.1, ["a{k}", "b{k}"]), ("4{k}", "alone{k}", "schema", 1, 0.1, ["z{k}"])])},
    lambda candidates: shaping.reconcile(candidates).withColumn("sources", F.array_join("sources", ",")).withColumn("paths", F.array_join("paths", ",")),
    "name sources paths confidence",
    [("billing{k}", "mvc,route,schema", "a{k},b{k},c{k}", "high"), ("alone{k}", "schema", "z{k}", "medium")],
)
once("merge_pairs", {"candidates": ("id int, name string, paths array<string>", [(1, "team-org", ["a"]), (2, "team-org-admin", ["b"]), (3, "x", ["p", "q", "r"]), (4, "y", ["p", "q", "r"]), (5, "team", ["z"])])}, shaping.merge_pairs, "a b", [(1, 2), (3, 4)])
once("split_by_levels", {"paths": ("feature string, path string", [("f", f"a/{i % 2}/{i % 3}/{i}.ts") for i in range(12)] + [("g", "x/1.ts")])}, lambda paths: sets.split_large(paths, most=4).groupBy("part").agg(F.count("*").alias("n")), "part n", [(f"f/a/{i}/{j}", 2) for i in range(2) for j in range(3)] + [("g", 1)])
BLOB = [("blob", f"modules/caddy/{d}/{i}.go") for d, n in (("proxy", 4), ("encode", 3), ("tiny", 2)) for i in range(n)] + [("blob", "modules/caddy/root.go")] + [(f"s{i}", f"x{i}/a.go") for i in range(6)]
once("subdecomposed", {"paths": ("feature string, path string", BLOB)}, lambda paths: repos.subdecompose(paths).groupBy("part").agg(F.count("*").alias("n")), "part n", [("blob/proxy", 4), ("blob/encode", 3), ("blob", 3)] + [(f"s{i}", 1) for i in range(6)])
planted(
    "entry_flows",
    {"routes": ("pattern string, method string, path string, trigger string", [("/api/v1/orders{k}", "POST", "a{k}", "interactive"), ("/api/v1/orders{k}/:id", "GET", "a{k}", "interactive"), ("/shop{k}", "PAGE", "b{k}", "interactive"), ("/digest{k}", "GET", "b{k}", "scheduled"), ("/none", "GET", "zz{k}", "interactive"), ("/", "PAGE", "b{k}", "interactive")]), "owners": ("path string, feature string", [("a{k}", "F{k}"), ("b{k}", "G{k}")])},
    repos.entry_flows,
    "feature flow path pattern trigger",
    [("F{k}", "create-orders{k}-flow", "a{k}", "/api/v1/orders{k}", "interactive"), ("F{k}", "get-orders{k}-flow", "a{k}", "/api/v1/orders{k}/:id", "interactive"), ("G{k}", "browse-shop{k}-flow", "b{k}", "/shop{k}", "interactive"), ("G{k}", "run-digest{k}-flow", "b{k}", "/digest{k}", "scheduled"), ("G{k}", "browse-home-flow", "b{k}", "/", "interactive")],
)
planted(
    "test_sources",
    {"imports": ("importer string, target string", [("t{k}/tests/b.test.ts", "t{k}/src/a.ts")]), "files": (PATHS, [("t{k}/src/a.ts",), ("t{k}/src/only{k}.ts",), ("t{k}/tests/b.test.ts",), ("t{k}/tests/only{k}.test.ts",)])},
    shaping.test_map,
    "test source by",
    [("t{k}/tests/b.test.ts", "t{k}/src/a.ts", "import"), ("t{k}/tests/only{k}.test.ts", "t{k}/src/only{k}.ts", "name")],
)
planted(
    "flow_lineage",
    {"base": ("b_id string, member string, b_idx int", [("x{k}", m + "{k}", 0) for m in "abcd"]), "new": ("a_id string, member string, a_idx int", [("p{k}", m + "{k}", 0) for m in "abc"] + [("q{k}", "d{k}", 1), ("r{k}", "z{k}", 2)])},
    ownership.lineage,
    "a_id keeps_id related_id jaccard kind",
    [("p{k}", "x{k}", "x{k}", 0.75, "kept"), ("q{k}", None, None, 0.0, "fresh"), ("r{k}", None, None, 0.0, "fresh")],
)
planted(
    "reverse_imports",
    {"edges": ("importer string, target string", [("a{k}", "m{k}"), ("b{k}", "a{k}"), ("c{k}", "m{k}"), ("m{k}", "z{k}")]), "seeds": ("seed string, node string", [("s{k}", "m{k}")])},
    lambda edges, seeds: graph.reach(edges.select(F.col("target").alias("importer"), F.col("importer").alias("target")), seeds, 2),
    "seed node depth",
    [("s{k}", "m{k}", 0), ("s{k}", "a{k}", 1), ("s{k}", "c{k}", 1), ("s{k}", "b{k}", 2)],
)
planted(
    "journey_members",
    {"flows": ("flow string, uuid string, name string, uf string", [("f1{k}", "i1{k}", "n1{k}", "u{k}"), ("f2{k}", "i2{k}", "n2{k}", None), ("f3{k}", "i3{k}", "n3{k}", None), ("f4{k}", "i4{k}", "n4{k}", None)]), "journeys": ("uf string, member string", [("u{k}", "i1{k}"), ("u{k}", "n2{k}"), ("u{k}", "i3{k}")])},
    lambda flows, journeys: shaping.flow_members(flows, journeys),
    "uf flow",
    [("u{k}", "f1{k}"), ("u{k}", "f2{k}"), ("u{k}", "f3{k}")],
)
planted(
    "lane_homes",
    {"files": ("feature string, path string", [("f{k}", "r{k}/a/x"), ("f{k}", "r{k}/a/b/y"), ("f{k}", "r{k}/a/z"), ("g{k}", "r{k}/q")]), "anchors": ("dir string, product string", [("r{k}/a", "P{k}"), ("r{k}/a/b", "Q{k}")])},
    lambda files, anchors: journeys.subtree_homes(files, anchors),
    "feature product n all",
    [("f{k}", "P{k}", 2, 3)],
)
planted(
    "spec_matches",
    {"specs": ("title string", [("user can create invoice{k}",), ("odd title {k}",)]), "journeys": ("uf string, name string", [("u1{k}", "create-invoice{k}"), ("u2{k}", "delete-invoice{k}")])},
    lambda specs, journeys: shaping.match_specs(specs, journeys),
    "title uf n",
    [("user can create invoice{k}", "u1{k}", 2), ("odd title {k}", None, None)],
)
planted("vendor_connectors", {"paths": ("feature string, path string", [("f{k}", "integrations/slack/a{k}.ts"), ("f{k}", "integrations/slack/b{k}.ts"), ("f{k}", "integrations/one/a{k}.ts")])}, lambda paths: shaping.vendor_split(paths.where("path like '%slack%'"), "integrations").select("path", "feature"), "path feature", [("integrations/slack/a{k}.ts", "f{k}/slack"), ("integrations/slack/b{k}.ts", "f{k}/slack")])
planted(
    "output_map",
    {"features": MAP, "flows": FLOWS},
    lambda features, flows: features.join(flows.groupBy("feature").agg(F.array_join(F.array_sort(F.collect_list("flow")), ",").alias("flows")), "feature", "left"),
    "feature uuid total_commits flows",
    [("f{k}", "u{k}", 3, "x{k},y{k}"), ("g{k}", "v{k}", 1, None)],
)

# -- rollups -----------------------------------------------------------------------

FLOW_PATHS = ("flow string, path string, entry boolean, key string", [("f{k}", "d{k}/a", True, "k{k}"), ("f{k}", "d{k}/b", False, "k{k}"), ("g{k}", "e{k}/c", True, "k{k}"), ("g{k}", "e{k}/d", False, "k{k}"), ("h{k}", "z{k}/z", True, "none")])
PRODUCT_PATHS = ("product string, path string, key string", [("P{k}", "d{k}/a", "x"), ("P{k}", "d{k}/b", "x"), ("Q{k}", "e{k}/d", "k{k}"), ("R{k}", "d{k}/a", "k{k}")])
MEMBERS = ("flow string, product string", [("h{k}", "M{k}")])
ROLLED = {
    "turborepo": [("f{k}", "R{k}", "entry"), ("g{k}", None, None), ("h{k}", None, None)],
    "single_saas": [("f{k}", "P{k}", "entry"), ("g{k}", None, None), ("h{k}", None, None)],
    "library": [("f{k}", None, None), ("g{k}", None, None), ("h{k}", "M{k}", "map")],
    "framework": [("f{k}", "P{k}", "entry"), ("g{k}", None, None), ("h{k}", "M{k}", "map")],
    "backend": [("f{k}", "Q{k}", "key"), ("g{k}", "Q{k}", "key"), ("h{k}", None, None)],
    "go_server": [("f{k}", "P{k}", "entry"), ("g{k}", "Q{k}", "dir"), ("h{k}", None, None)],
    "cli": [("f{k}", "Q{k}", "key"), ("g{k}", "Q{k}", "key"), ("h{k}", None, None)],
    "universal": [("f{k}", "P{k}", "overlap"), ("g{k}", "Q{k}", "overlap"), ("h{k}", None, None)],
}
for _kind, _rows in ROLLED.items():
    planted(f"rollup_of_{_kind}", {"flow_paths": FLOW_PATHS, "product_paths": PRODUCT_PATHS, "members": MEMBERS}, lambda flow_paths, product_paths, members, _kind=_kind: journeys.rollup(flow_paths, product_paths, _kind, members), "flow product by", _rows)

# -- tools -------------------------------------------------------------------------

FEATURES = (
    "feature string, display_name string, description string, aliases array<string>, labels array<string>, health_score double, bug_fix_ratio double, bug_fixes long, total_commits long, coverage_pct double, authors array<string>, paths array<string>",
    [("pay", "Payments", "billing of orders", ["checkout"], [], 40.0, 0.2, 2, 10, None, ["a"], ["p1"]), ("auth", None, None, None, ["login"], 90.0, 0.6, 6, 10, 50.0, ["a", "b"], ["p2", "p3", "p4"])],
)
TOOL_FLOWS = ("feature string, flow string, health_score double, bus_factor int, hotspot_files array<string>, paths array<string>", [("pay", "f1", 50.0, 3, ["h1", "h2"], ["p1"]), ("pay", "f2", 50.0, 2, ["h3", "h4"], ["p9"])])
TOOL_SYMBOLS = ("feature string, flow string, file string, symbol string, ranges array<struct<start:int,end:int>>", [("pay", "f1", "p1", "charge", [(3, 9)]), ("pay", "f2", "p1", "charge", [(3, 9)])])
once("tool_find_feature", {"features": FEATURES}, lambda features: tools.call("find_feature", features, "payment checkouts").select("name", "score", "file_count"), "name score file_count", [("Payments", 2.5, 1)])
once("tool_feature_files", {"features": FEATURES, "flows": TOOL_FLOWS}, lambda features, flows: tools.call("get_feature_files", features, flows, "CHECKOUT").withColumn("paths", F.array_join("paths", ",")).withColumn("hotspots", F.array_join("hotspots", ",")), "feature paths hotspots", [("pay", "p1", "h1,h2,h3,h4")])
once("tool_flow_files", {"flows": TOOL_FLOWS}, lambda flows: tools.call("get_flow_files", flows, "pay", "f2").withColumn("paths", F.array_join("paths", ",")), "feature flow paths health_score", [("pay", "f2", "p9", 50.0)])
once("tool_feature_owners", {"features": FEATURES, "flows": TOOL_FLOWS}, lambda features, flows: tools.call("get_feature_owners", features, flows, "pay").unionByName(tools.call("get_feature_owners", features, flows, "login")).drop("authors"), "feature contributors bus_factor at_risk", [("pay", 1, 2, False), ("auth", 2, 2, False)])
once("tool_flow_symbols", {"symbols": TOOL_SYMBOLS, "flows": TOOL_FLOWS}, lambda symbols, flows: tools.call("find_symbols_in_flow", symbols, flows, "pay", "f2", "https://h").withColumn("links", F.array_join("links", " ")), "file symbol links", [("p1", "charge", "https://h/blob/HEAD/p1#L3-L9"), ("p9", None, None)])
once("tool_feature_symbols", {"symbols": TOOL_SYMBOLS}, lambda symbols: tools.call("find_symbols_for_feature", symbols, "pay").select("file", "symbol"), "file symbol", [("p1", "charge")])
once("tool_feature_errors", {"features": FEATURES, "errors": ("path string, count long", [("p1", 2), ("p1", 2), ("p1", 3), ("p1", None), ("p2", 9)])}, lambda features, errors: tools.call("get_feature_errors", features, errors, "payments"), "feature rows total", [("pay", 4, 8)])
once("tool_feature_views", {"features": FEATURES, "views": ("path string, count long", [("p1", None), ("p1", 4), ("p1", 4)])}, lambda features, views: tools.call("get_feature_pageviews", features, views, "payments"), "feature rows total", [("pay", 3, 8)])


def _answers(features: DataFrame, flows: DataFrame) -> DataFrame:
    import io
    import json

    from ..operators import server

    tables, sink = {"features": features, "flows": flows}, io.StringIO()
    asked = [{"tool": "list_features"}, {"tool": "get_flow_files", "args": {"feature": "pay", "flow": "f1"}}, {"tool": "none"}, {"tool": "find_feature", "args": {"q": "x"}}, {"tool": "find_symbols_for_feature", "args": {"feature": "pay"}}]
    server.serve_lines(tables, io.StringIO("\n".join(map(json.dumps, asked)) + "\nnot json\n"), sink)
    out = [json.loads(x) for x in sink.getvalue().splitlines()]
    return features.sparkSession.createDataFrame([(i, len(x.get("rows", [])), "error" in x) for i, x in enumerate(out)], "n int, rows int, failed boolean")


once("tool_server", {"features": FEATURES, "flows": TOOL_FLOWS}, _answers, "n rows failed", [(0, 2, False), (1, 1, False), (2, 0, True), (3, 0, True), (4, 0, True), (5, 0, True)])

# -- streams and commands ----------------------------------------------------------

COMMIT_ROWS = [("f{k}", "a", True), ("f{k}", "a", True), ("f{k}", "b", False), ("g{k}", "a", True)]


def _streamed(first: DataFrame, second: DataFrame) -> DataFrame:
    spark, at = first.sparkSession, _scratch(first.sparkSession, "stream")
    schema = "feature string, sha string, is_bug_fix boolean"
    for n, batch in enumerate((first, second)):
        batch.write.mode("append").parquet(f"{at}/in")
        query = refresh.start_refresh(spark.readStream.schema(schema).parquet(f"{at}/in"), f"{at}/state", f"{at}/log")
        query.awaitTermination()
    ended = refresh.stop(query) and not refresh.status(query)["active"]
    return refresh.snapshot(spark, f"{at}/state", 1 << 20).withColumn("ended", F.lit(ended))


planted("streamed_refresh", {"first": ("feature string, sha string, is_bug_fix boolean", COMMIT_ROWS), "second": ("feature string, sha string, is_bug_fix boolean", [("f{k}", "b", False), ("f{k}", "c", True)])}, _streamed, "feature total_commits bug_fixes ended", [("f{k}", 3, 2, True), ("g{k}", 1, 1, True)])


def _watched(events: DataFrame) -> DataFrame:
    spark, at = events.sparkSession, _scratch(events.sparkSession, "watch")
    events.where("repo like 'r%'").write.json(f"{at}/in")
    name = "bursts_" + uuid.uuid4().hex
    closing = events.where("repo like 'r%'").select("repo").distinct().select("repo", F.lit("end").alias("path"), F.lit(T0 + datetime.timedelta(days=2)).alias("ts"))
    for extra in (None, closing):
        if extra is not None:
            extra.write.mode("append").json(f"{at}/in")
        query = refresh.bursts(refresh.file_events(spark, f"{at}/in")).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{at}/out")


once(
    "watched_bursts",
    {"events": ("repo string, path string, ts timestamp", [("r1", "a.ts", T0), ("r1", "a.ts", T0 + datetime.timedelta(seconds=10)), ("r1", "b.ts", T0 + datetime.timedelta(seconds=35)), ("r1", "node_modules/x.js", T0 + datetime.timedelta(seconds=60)), ("r1", "c.ts", T0 + datetime.timedelta(hours=1)), ("r2", "x.lock", T0), ("r2", "d.ts", T0)])},
    _watched,
    "repo events paths",
    [("r1", 3, 2), ("r1", 1, 1), ("r2", 1, 1)],
)
SCANNED = (
    FILES,
    [
        ("s{k}/routers/orders{k}.py", "from .. import store\nrouter = APIRouter(prefix='/orders{k}')\n@router.get('/{oid}')\ndef one(oid):\n    return store.load(oid)\n"),
        ("s{k}/store.py", "def load(x):\n    return x\n"),
        ("s{k}/web/app/cart{k}/page.tsx", "import { total } from './sum';\nexport default function Page() { return <b>{total()}</b> }"),
        ("s{k}/web/app/cart{k}/sum.ts", "export const total = () => 1;"),
    ],
)
SCAN_COMMITS = (COMMITS, [("aaaaaaaa{k}", "ann{k}", T0, "fix: crash", ["s{k}/store.py", "s{k}/routers/orders{k}.py"]), ("bbbbbbbb{k}", "bob{k}", T0, "feat: x", ["s{k}/routers/orders{k}.py"])])


def _scan(part: str):
    def run(files: DataFrame, raw: DataFrame) -> DataFrame:
        # short hashes would meet over the stamped repositories
        unique = raw.withColumn("sha", F.substring(F.sha2("sha", 256), 1, 8))
        return commands.scan(files, unique, "2024-06-01", coverage=lambda t: t.where("path like '%.py'").select("path", F.lit(50.0).alias("pct")))[part]

    return run


planted("command_scan_paths", {"files": SCANNED, "raw": SCAN_COMMITS}, _scan("feature_paths"), "feature path source", [("orders{k}", "s{k}/routers/orders{k}.py", "fastapi-route"), ("cart{k}", "s{k}/web/app/cart{k}/page.tsx", "approuter-keyless"), ("cart{k}", "s{k}/web/app/cart{k}/sum.ts", "directory"), ("s{k}", "s{k}/store.py", "residual")])
planted("command_scan_flows", {"files": SCANNED, "raw": SCAN_COMMITS}, _scan("flows"), "feature flow path pattern trigger", [("orders{k}", "get-orders{k}-flow", "s{k}/routers/orders{k}.py", "/orders{k}/{oid}", "interactive"), ("cart{k}", "browse-cart{k}-flow", "s{k}/web/app/cart{k}/page.tsx", "/cart{k}", "interactive")])
planted("command_scan_edges", {"files": SCANNED, "raw": SCAN_COMMITS}, _scan("edges"), "importer target", [("s{k}/routers/orders{k}.py", "s{k}/store.py"), ("s{k}/web/app/cart{k}/page.tsx", "s{k}/web/app/cart{k}/sum.ts")])
once(
    "command_scan_metrics",
    {"files": (FILES, [(p.replace("{k}", "1"), t.replace("{k}", "1")) for p, t in SCANNED[1]]), "raw": (COMMITS, [(s.replace("{k}", ""), a, t, m, [f.replace("{k}", "1") for f in fs]) for s, a, t, m, fs in SCAN_COMMITS[1]])},
    _scan("features"),
    "feature total_commits bug_fixes coverage_pct",
    [("orders1", 2, 1, 50.0), ("cart1", 0, 0, None), ("s1", 1, 1, 50.0)],
)
once(
    "command_update",
    {"base": ("feature string, total_commits long, bug_fixes long, health_score double", [("f", 100, 50, 12.0), ("g", 5, 0, 88.0)]), "paths": ("feature string, path string", [("f", "a"), ("g", "b")]), "raw": (COMMITS, [("aaaaaaaa", "x", T0, "feat: y", ["a"]), ("bbbbbbbb", "x", T0, "fix: y", ["a", "z"])])},
    lambda base, paths, raw: commands.update(base, paths, lambda: raw).select("feature", "total_commits", "bug_fixes"),
    "feature total_commits bug_fixes",
    [("f", 102, 51), ("g", 5, 0)],
)
