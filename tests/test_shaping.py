from pyspark.sql import functions as F

from histora.operators import shaping


def rows(df, *order):
    return sorted((tuple(r) for r in (df.select(*order) if order else df).collect()), key=str)


def test_classes_and_shapes(spark):
    files = spark.createDataFrame([(p,) for p in ("apps/web/package.json", "apps/web/app/page.tsx", "packages/ui/package.json", "packages/ui/src/index.ts", "README.md")], "path string")
    assert shaping.repo_shape(shaping.repo_signals(files)).first()["shape"] == "monorepo"
    assert rows(shaping.partition_plan(files), "workspace", "files", "class") == [("apps/web", 2, "product"), ("packages/ui", 2, "library"), ("root", 1, "product")]
    kinds = files.sparkSession.createDataFrame([("locales/en.json",), ("a/__snapshots__/x.snap",), ("src/a.ts",)], "p string").select(shaping.artifact_kind("p"), shaping.surface("p"))
    assert [tuple(r) for r in kinds.collect()] == [("locale", "product"), (None, "product"), (None, "product")]


def test_artifacts(spark):
    want = {
        "apps/web/locales/en/common.json": "locale", "i18n/de.po": "locale", "messages/package.json": None, "lang/tsconfig.base.json": None, "src/lang/en.ts": None,
        "src/__generated__/types.ts": "generated", "a/generated-metadata/x.json": "generated", "src/api.generated.ts": "generated", "src/generatedx/a.ts": None,
        "src/__mocks__/data.ts": None, "src/mocks/data.ts": "testing", "packages/testing/mock-data/a.ts": "testing", "db/seeds/users.ts": "seed", "x/seed-data/a.sql": "seed",
        "seeds.ts": None, "src/a.ts": None,
    }
    got = spark.createDataFrame([(p,) for p in want], "p string").select("p", shaping.artifact_kind("p")).collect()
    assert {r[0]: r[1] for r in got} == want


def test_surfaces(spark):
    want = {
        "app/(marketing)/pricing/page.tsx": "marketing", "app/(dashboard)/blog/page.tsx": "product", "apps/web/app/legal/terms/page.tsx": "legal", "pages/blog.tsx": "marketing",
        "src/features/blog-model/a.ts": None, "apps/docs/app/guides/auth/page.tsx": "docs", "packages/cli/src/index.ts": "dev_tooling", "docs/readme.md": "docs", "website/src/x.ts": "marketing",
        "docs": None, "app/routes/api/x.ts": None, "blog/app/x/page.tsx": None, "app/(.)pricing/page.tsx": None, "tools/storybook/a/b.ts": "dev_tooling",
    }
    got = spark.createDataFrame([(p,) for p in want], "p string").select("p", shaping.surface_signal("p"), shaping.surface_signal("p", F.array(F.lit("packages/cli")))).collect()
    assert {r[0]: r[1] for r in got} == want and [r[2] for r in got if r[0].startswith("packages/cli")] == ["product"]
    routes = {"/pricing": "marketing", "/docs/[slug]": "docs", "/u/:blog": None, "/privacy/blog": "legal", "": None}
    got = spark.createDataFrame([(p,) for p in routes], "p string").select("p", shaping.route_surface("p"), shaping.is_shell("p"), shaping.is_info_page("p")).collect()
    assert {r[0]: r[1] for r in got} == routes
    names = spark.createDataFrame([("Home",), ("main-page",), ("Home Office",)], "p string").select(shaping.is_shell("p")).collect()
    assert [r[0] for r in names] == [True, True, False]
    info = spark.createDataFrame([("app/faq/page.tsx",), ("app/terms.tsx",), ("src/faq/page.tsx",)], "p string").select(shaping.is_info_page("p")).collect()
    assert [r[0] for r in info] == [True, True, False]


def test_flow_names(spark):
    from histora.operators import journeys

    want = {"create-detector-flow": ("create", "detector", "author"), "list-classes": ("list", "class", "browse"), "archive-status": ("archive", "status", "lifecycle"), "frob-cases-analyses": ("frob", "case-analyse", "other"), "delete": ("delete", "item", "manage"), "export-companies-flow": ("export", "company", "export")}
    got = journeys.split_name(spark.createDataFrame([(f,) for f in want], "flow string")).collect()
    assert {r["flow"]: (r["verb"], r["resource"], r["intent"]) for r in got} == want
    named = spark.createDataFrame([("user_group", "author", "x"), (None, "lifecycle", "order")], "d string, i string, r string").select(journeys.journey_name(F.col("d"), F.col("i"), F.col("r"))).collect()
    assert [r[0] for r in named] == ["Create & edit user groups", "Transition order through its lifecycle"]


def test_reconcile(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    schema = "id int, name string, source string, priority int, confidence double, paths array<string>"
    c = spark.createDataFrame([(1, "billing", "route", 2, 0.5, ["a", "b"]), (2, "Billing", "schema", 1, 0.9, ["c"]), (3, "invoices", "mvc", 1, 0.1, ["a", "b"]), (4, "alone", "schema", 1, 0.1, ["z"])], schema)
    assert rows(shaping.reconcile(c)) == [("alone", ["schema"], ["z"], "medium"), ("billing", ["mvc", "route", "schema"], ["a", "b", "c"], "high")]


def test_test_map(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b.ts",), ("tests/a.test.ts",), ("tests/b.test.ts",)], "path string")
    imports = spark.createDataFrame([("tests/a.test.ts", "src/b.ts")], "importer string, target string")
    assert rows(shaping.test_map(imports, files)) == [("tests/a.test.ts", "src/b.ts", "import"), ("tests/b.test.ts", "src/b.ts", "name")]


def test_terminal_classes(spark):
    gaps = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", None), ("i", "x.tf")], "gap string, path string")
    owners = spark.createDataFrame([("a", "F")], "path string, feature string")
    out = shaping.terminal_class(gaps, owners, F.col("path").endswith(".tf"))
    assert rows(out, "gap", "class", "part_of") == [("g", "part_of", "F"), ("h", "not_a_feature", None), ("i", "infra", None)]


def test_moves(spark):
    votes = spark.createDataFrame([("u", "h", "x", 6), ("u", "h", "y", 4), ("v", "h", "x", 5), ("v", "h", "y", 5)], "id string, home string, candidate string, weight int")
    assert rows(shaping.home_votes(votes)) == [("u", "x"), ("v", "h")]
    specs = spark.createDataFrame([("user can create invoice",), ("odd title",)], "title string")
    ufs = spark.createDataFrame([("u1", "create-invoice"), ("u2", "delete-invoice")], "uf string, name string")
    assert rows(shaping.match_specs(specs, ufs)) == [("odd title", None, None), ("user can create invoice", "u1", 2)]
    v = spark.createDataFrame([("f", "integrations/slack/a.ts"), ("f", "integrations/slack/b.ts"), ("f", "integrations/one/a.ts")], "feature string, path string")
    assert rows(shaping.vendor_split(v, "integrations"), "feature") == [("f",), ("f/slack",), ("f/slack",)]
    flows = spark.createDataFrame([("f1", "id1", "n1", "u"), ("f2", "id2", "n2", None)], "flow string, uuid string, name string, uf string")
    js = spark.createDataFrame([("u", "id1"), ("u", "n2")], "uf string, member string")
    assert rows(shaping.flow_members(flows, js)) == [("u", "f1"), ("u", "f2")]


def test_banners_of_generators(spark):
    from pyspark.sql import functions as F

    from histora.functions import text

    heads = {
        "// Code generated by x. DO NOT EDIT.": True, "// Code generated by x.\n// do not edit": True, "// do not edit this list by hand": False, "# code generated by y": False, "/** @generated */": True, "// @generatedby": False,
        "// Generated by orval\n// Do not edit manually": True, "// automatically generated\n// should not be edited": True, "// never change; auto-generated": True, "// generated nightly": False, "x" * 2048 + "@generated": False, "\x00 @generated": False, None: False,
    }
    rows = spark.createDataFrame([("a.ts", t) for t in heads], "path string, text string").select("text", text.is_generated("path", F.col("text")).alias("is")).collect()
    assert {r["text"]: r["is"] for r in rows} == heads
