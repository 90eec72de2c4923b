from pyspark.sql import functions as F

from histora.functions import text, weeks


def values(spark, column, *rows, schema):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(column.alias("v")).collect()]


def test_bug_fix_predicate(spark):
    got = values(spark, text.is_bug_fix("m"), ("fix: login crash",), ("fix typo in docs",), ("feat: x",), ("prefix work",), (None,), ("Memory  leak gone",), schema="m string")
    assert got == [True, False, False, False, False, True]


def test_pr_number(spark):
    got = values(spark, text.pr_number("m"), ("Merge pull request #12 from a",), ("fix y (#34)",), ("see #5",), ("a (#1)\n(#2) tail",), (None,), schema="m string")
    assert got == [12, 34, None, 1, None]


def test_names_and_tokens(spark):
    assert values(spark, text.tokens("m"), ("organizationPayments_billing (RAG)",), (None,), schema="m string") == [["organization", "payment", "bill", "rag"], []]
    got = values(spark, text.names_match("a", "b"), ("billing", "Billing"), ("sign", "sign/recipient"), ("team-and-org-management", "org-and-team-management"), ("envelope-doc", "envelope-big-doc"), ("email", "org-email-domains"), schema="a string, b string")
    assert got == [True, True, True, True, False]
    assert values(spark, text.slugify("m"), ("--Ab  C!d-",), schema="m string") == ["ab-c-d"]
    assert values(spark, text.singular("m"), ("entries",), ("boxes",), ("users",), ("class",), schema="m string") == ["entry", "box", "user", "class"]


def test_token_coverage(spark):
    cover = text.token_coverage(text.tokens("q"), text.tokens("h"))
    assert values(spark, cover, ("knowledge rag", "organization-knowledge-(rag)"), ("org x", "organization"), ("", "a"), schema="q string, h string") == [1.0, 0.25, 0.0]


def test_jaccard_of_empty_sets_must_be_said(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"]), ([], [])], "a array<string>, b array<string>")
    assert [tuple(r) for r in df.select(text.jaccard(F.col("a"), F.col("b"), 0.0), text.jaccard(F.col("a"), F.col("b"), 1.0)).collect()] == [(0.5, 0.5), (0.0, 1.0)]
    assert [r[0] for r in df.select(text.strictly_contained(F.col("a"), F.col("b"), 1)).collect()] == [True, False]


def test_paths_and_urls(spark):
    assert values(spark, text.ancestors("p"), ("a/b/c.ts",), ("x.ts",), schema="p string") == [["a/b", "a"], []]
    assert values(spark, text.is_test_path("p"), ("src/__tests__/a.ts",), ("a/login.test.tsx",), ("contest/a.ts",), ("test_x.py",), schema="p string") == [True, True, False, True]
    assert values(spark, text.path_to_route("p"), ("app/(shop)/items/[id]/page.tsx",), ("app/page.tsx",), ("lib/a.ts",), schema="p string") == ["/items/{id}", "/", None]
    assert values(spark, text.url_template("u"), ("https://x.io/a/12/b?q=1",), ("/u/${id}/",), ("",), schema="u string") == ["/a/{param}/b", "/u/{param}", "/"]
    assert values(spark, text.url_matches(F.col("u"), F.col("p")), ("/a/1", "/a/:id"), ("/a/1/2", "/a/:id"), ("/b/1", "/a/{id}"), schema="u string, p string") == [True, False, False]
    assert values(spark, text.remote_url("u"), ("git@github.com:o/r.git",), ("https://h/o/r/",), schema="u string") == ["https://github.com/o/r", "https://h/o/r"]


def test_iso_week_uses_the_iso_year(spark):
    df = spark.createDataFrame([("2024-12-30 00:00:00",), ("2021-01-03 10:00:00",), ("2021-01-04 00:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    got = [tuple(r) for r in df.select(weeks.iso_week("t"), weeks.week_index("t")).collect()]
    assert [g[0] for g in got] == ["2025-W01", "2020-W53", "2021-W01"] and got[2][1] == got[1][1] + 1


def test_age_weight(spark):
    df = spark.createDataFrame([(0,), (29,), (30,), (395,), (5000,)], "a long")
    assert [r[0] / weeks.WEIGHT_UNIT for r in df.select(weeks.age_weight_units(F.col("a"))).collect()] == [2.0, 2.0, 1.0, 0.5, 0.5]
