import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from histora.operators import cochange, evaluation, graph, history, incremental, intervals, journeys, metrics, ownership, sets, tools
from histora.plans.domain import Domain
from histora.plans.queries import QUERIES

from .conftest import SMALL


def rows(df, *order):
    return sorted(tuple(r) for r in (df.select(*order) if order else df).collect())


def week(n, day=1):
    return dt.datetime(2024, 1, 1) + dt.timedelta(weeks=n - 1, days=day - 1)


# -- metrics -----------------------------------------------------------------------


def test_health_values(spark):
    df = spark.createDataFrame([(0.55, 50), (0.0, 0), (0.55, 25)], "x double, n long")
    assert [r[0] for r in df.select(metrics.health(F.col("x"), F.col("n"))).collect()] == [50.0, 100.0, 45.0]


def test_confidence_floor(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (0,)], "total_commits long")
    assert metrics.confidence_floor(df).first()[0] == 1
    assert metrics.confidence_floor(df.where("total_commits = 0")).first()[0] == 1


def test_feature_metrics_with_and_without_commits(spark):
    fc = spark.createDataFrame([("f", "a", "x", week(1), True), ("f", "b", "y", week(2), False)], "feature string, sha string, author string, ts timestamp, is_bug_fix boolean")
    out = {r.feature: r for r in metrics.feature_metrics(fc, spark.createDataFrame([("f",), ("empty",)], "feature string"), F.lit(week(3))).collect()}
    assert (out["f"].total_commits, out["f"].bug_fixes, out["f"].bug_fix_ratio, out["f"].n_authors, out["f"].last_modified) == (2, 1, 0.5, 2, week(2))
    assert (out["empty"].health_score, out["empty"].health_confidence, out["empty"].last_modified) == (100.0, "insufficient", dt.datetime(1970, 1, 1))


def test_hotspots(spark):
    index = spark.createDataFrame([("in", 5, 2), ("few", 4, 4), ("ok", 10, 3)], "path string, commits long, bug_fixes long")
    assert rows(metrics.hotspots(index), "path") == [("in",)]
    fp = spark.createDataFrame([("f", p) for p in ("in", "few", "ok")], "feature string, path string")
    assert rows(metrics.ranked_hotspots(index, fp), "rank", "path") == [(1, "few")]


def test_bus_factor(spark):
    fc = spark.createDataFrame([("f", a) for a, n in (("A", 7), ("B", 2), ("C", 1)) for _ in range(n)], "feature string, author string")
    assert metrics.bus_factor(fc).first().bus_factor == 2


def test_coverage_by_suffix(spark):
    fp = spark.createDataFrame([("f", "src/a/x.ts"), ("f", "y.ts")], "feature string, path string")
    cov = spark.createDataFrame([("/src/a/x.ts", 50.0), ("lib/y.ts", 100.0), ("b/x.ts", 1.0)], "cov_path string, pct double")
    assert rows(metrics.coverage_mean(fp, cov)) == [("f", 2, 75.0)]


# -- co-change ---------------------------------------------------------------------


def test_cochange(spark):
    cf = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "a")], "sha long, path string")
    assert rows(cochange.cochange(cf)) == [("a", "b", 2, 3, 2, 2 / 3)]
    bulk = spark.createDataFrame([(s, f"f{i}") for s in (1, 2) for i in range(31)], "sha long, path string")
    assert rows(cochange.cochange(bulk)) == []


def test_cocommit_claims_abstain_on_ties(spark):
    cf = spark.createDataFrame([(s, p) for s, ps in ((1, "xfo"), (2, "xfo"), (3, "xg"), (4, "yf"), (5, "yg"), (6, "yfg"), (7, "yfg"), (8, "zf"), (9, "zf"), (10, "zf")) for p in ps], "sha long, path string")
    fp = spark.createDataFrame([("F", "f"), ("G", "g")], "feature string, path string")
    assert rows(cochange.cocommit_claims(cf, fp), "path", "feature", "n") == [("z", "F", 3)]


# -- history -----------------------------------------------------------------------


def weekly(spark, *points):
    return spark.createDataFrame([("e", f"w{w}", w, c, b, t) for w, c, b, t in points], "entity string, week string, week_idx long, commits long, bug_fixes long, test_commits long")


def test_trailing_window_goes_by_week_number(spark):
    assert rows(history.trailing(weekly(spark, (1, 5, 0, 0), (14, 2, 1, 0))), "week_idx", "trailing_commits") == [(1, 5), (14, 2)]
    assert rows(history.trailing(weekly(spark, (1, 5, 0, 0), (13, 2, 1, 0))), "week_idx", "trailing_commits") == [(1, 5), (13, 7)]


def test_efficacy_and_shift(spark):
    gates = spark.createDataFrame([("e", False)], "entity string, gated boolean")
    out = history.test_efficacy(weekly(spark, (1, 10, 5, 0), (2, 10, 1, 1)), gates).first()
    assert (out.verdict, out.commits_before, out.commits_after) == ("improved", 10, 10)
    assert history.test_efficacy(weekly(spark, (1, 10, 5, 1)), gates).first().verdict == "insufficient_data"


def test_waves(spark):
    points = weekly(spark, (1, 9, 0, 1), (2, 9, 0, 1), (3, 9, 0, 1), (4, 9, 0, 5))
    assert rows(history.test_waves(points), "week_idx", "mark") == [(4, 2.0)]
    run = weekly(spark, *[(w, 9, 0, 1) for w in range(1, 12)], (12, 9, 0, 5), (13, 9, 0, 6), (15, 9, 0, 7))
    assert rows(history.test_waves(run), "week_idx") == [(12,), (15,)]


def test_hotspot_emergence_counts_the_week_whole(spark):
    t = spark.createDataFrame([("e", "p", week(1), False)] * 3 + [("e", "p", week(2), True)] * 2, "entity string, path string, ts timestamp, is_bug_fix boolean")
    assert history.hotspot_emergence(t).count() == 1


def test_history_confidence_counts_untouched_as_old(spark):
    t = spark.createDataFrame([("e", "a", week(1)), ("e", "b", week(9)), ("e", "c", week(2))], "entity string, path string, ts timestamp")
    m = spark.createDataFrame([("e", p) for p in "abcd"], "entity string, path string")
    assert history.history_confidence(t, m).first().confidence == 0.75


def test_impact(spark):
    points = spark.createDataFrame([("g", w, r, 1) for w, r in enumerate((10, 11, 40))] + [("s", w, 5, 1) for w in range(3)] + [("z", 0, 9, 0), ("z", 1, 9, 1)], "entity string, week_idx long, reach long, members_present long")
    assert rows(history.impact_trend(points), "entity", "trend") == [("g", "growing"), ("s", "stable")]
    assert rows(history.impact_events(points), "entity", "week_idx", "kind") == [("g", 2, "coupling_spike")]


def test_evenly_spaced_commits(spark):
    c = spark.createDataFrame([(f"{i:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(100)], "sha string, ts timestamp")
    assert [s for _, s in rows(history.evenly_spaced(c, 3), "week", "sha")] == ["000", "050", "099"]


# -- intervals ---------------------------------------------------------------------


def spans(spark, *data):
    return spark.createDataFrame(data, "flow string, path string, start long, end long")


def test_union_merges_neighbours(spark):
    s = spans(spark, ("f", "p", 10, 12), ("f", "p", 13, 15), ("f", "p", 20, 20))
    assert intervals.union_length(s, ["flow", "path"]).first().lines == 7


def test_shared_mask_and_owned(spark):
    s = spans(spark, ("f1", "p", 1, 10), ("f2", "p", 5, 12))
    assert rows(intervals.shared_mask(s)) == [("p", 5, 10)]
    assert rows(intervals.owned_shared(s), "flow", "loc", "loc_shared") == [("f1", 4, 6), ("f2", 2, 6)]


def test_line_lookup(spark):
    s = spans(spark, ("f", "p", 5, 9), ("g", "p", 1, 500))
    points = spark.createDataFrame([("p", n) for n in (4, 5, 9, 10)], "path string, line long")
    assert [x for x in rows(intervals.line_lookup(points, s), "line", "flow") if x[1] == "f"] == [(5, "f"), (9, "f")]


def test_intervals_against_line_sets(spark):
    r = random.Random(2)
    data = [(f"f{r.randrange(4)}", f"p{r.randrange(2)}", a := r.randrange(1, 300), a + r.randrange(0, 150)) for _ in range(60)]
    lines = {}
    for f, p, a, b in data:
        lines.setdefault((f, p), set()).update(range(a, b + 1))
    got = {(x[0], x[1]): x[2] for x in rows(intervals.union_length(spans(spark, *data), ["flow", "path"]))}
    assert got == {k: len(v) for k, v in lines.items()}
    deep = {(p, n) for (f, p), v in lines.items() for n in v if sum(n in w for (g, q), w in lines.items() if q == p) > 1}
    own = {f: (sum((p, n) not in deep for (g, p), v in lines.items() if g == f for n in v), sum((p, n) in deep for (g, p), v in lines.items() if g == f for n in v)) for f in {k[0] for k in lines}}
    assert {x[0]: x[1:] for x in rows(intervals.owned_shared(spans(spark, *data)), "flow", "loc", "loc_shared")} == own


# -- ownership ---------------------------------------------------------------------


def test_directory_fallback_must_be_unambiguous(spark):
    fp = spark.createDataFrame([("F", "d/x", "d"), ("G", "d/y", "d"), ("F", "e/x", "e")], "feature string, path string, dir string")
    files = spark.createDataFrame([("d/z", "d"), ("e/z", "e"), ("d/x", "d")], "path string, dir string")
    assert rows(ownership.owner_lookup(files, fp), "path", F.coalesce("feature", F.lit("-"))) == [("d/x", "F"), ("d/z", "-"), ("e/z", "F")]


def test_nearest_ancestor(spark):
    files = spark.createDataFrame([("a/b/c/x.ts",), ("a/y.ts",), ("q/z.ts",)], "path string")
    dirs = spark.createDataFrame([("a", "top"), ("a/b", "deep")], "dir string, feature string")
    assert rows(ownership.nearest_ancestor(files, dirs), "path", "feature") == [("a/b/c/x.ts", "deep"), ("a/y.ts", "top")]


def test_local_tests(spark):
    tests = spark.createDataFrame([("a/b/__tests__/x.test.ts",), ("z/x.test.ts",)], "path string")
    members = spark.createDataFrame([("e", "a/b/x.ts"), ("r", "root.ts")], "entity string, path string")
    assert rows(ownership.local_tests(tests, members)) == [("e", "a/b/__tests__/x.test.ts")]


def test_primary_owner_election(spark):
    schema = "path string, feature string, module_depth int, is_facet boolean, dir_files int, flows int"
    c = spark.createDataFrame([("p", "a", 0, False, 9, 9), ("p", "b", 2, False, 1, 0), ("q", "f", 5, True, 9, 9), ("q", "c", 0, False, 1, 1), ("r", "y", 0, False, 1, 1), ("r", "x", 0, False, 1, 1)], schema)
    assert rows(ownership.primary_owners(c)) == [("p", "b"), ("q", "c"), ("r", "x")]


def test_claims_protect_features_without_other_paths(spark):
    c = spark.createDataFrame([("w", "p", 2, 2), ("ghost", "p", 1, 2), ("l", "p", 1, 1), ("l", "own", 1, 1)], "feature string, path string, priority int, confidence int")
    assert rows(ownership.settle_claims(c)) == [("ghost", "p", False), ("l", "own", True), ("w", "p", True)]


def groups(spark, side, **members):
    return spark.createDataFrame([(g, m, i) for i, (g, ms) in enumerate(members.items()) for m in ms], f"{side}_id string, member string, {side}_idx int")


def test_lineage(spark):
    out = ownership.lineage(groups(spark, "b", base="abcd"), groups(spark, "a", new1="abc", new2="d"))
    assert rows(out, "a_id", F.coalesce("keeps_id", F.lit("-")), "kind") == [("new1", "base", "kept"), ("new2", "-", "fresh")]
    out = ownership.lineage(groups(spark, "b", base="abcdefg"), groups(spark, "a", n1="abcde", n2="fg"))
    assert rows(out, "a_id", "kind") == [("n1", "kept"), ("n2", "fresh")]


def test_greedy_match_equals_a_walk(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    r = random.Random(7)
    pairs = [(f"a{i}", f"b{j}", r.randrange(20) / 20) for i in range(15) for j in range(15) if r.random() < 0.5]
    used, want = set(), []
    for a, b, s in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.append((a, b, s))
    df = spark.createDataFrame(pairs, "a_id string, b_id string, score double")
    assert rows(ownership.greedy_match(df, [F.desc("score"), F.col("a_id"), F.col("b_id")])) == sorted(want)


def test_greedy_match_takes_all_of_equal_scores(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    df = spark.createDataFrame([(a, b, 1.0) for a in range(30) for b in range(30)], "a_id long, b_id long, score double")
    assert rows(ownership.greedy_match(df, [F.desc("score"), F.col("a_id"), F.col("b_id")])) == [(i, i, 1.0) for i in range(30)]


def test_conservation(spark):
    votes = spark.createDataFrame([("u", "in", 6, 0), ("u", "x", 4, 1), ("v", "in", 2, 0), ("v", "x", 8, 0), ("t", "b", 5, 1), ("t", "a", 5, 1)], "uf string, pf string, span long, entries long")
    inc = spark.createDataFrame([("u", "in"), ("v", "in"), ("t", "c"), ("none", "in")], "uf string, pf string")
    assert rows(ownership.conserve(votes, inc), "uf", "home", "resettled") == [("none", "in", False), ("t", "a", True), ("u", "in", False), ("v", "x", True)]


def test_vote_needs_a_share(spark):
    t = spark.createDataFrame([("e", f"p{i}", "x") for i in range(6)] + [("e", f"q{i}", "y") for i in range(4)] + [("f", "a", "x"), ("f", "b", "y"), ("f", "c", None)], "entity string, path string, token string")
    assert rows(ownership.vote_token(t), "entity", F.coalesce("token", F.lit("-"))) == [("e", "x"), ("f", "-")]


# -- graphs ------------------------------------------------------------------------


def test_importer_reach(spark):
    e = spark.createDataFrame([(1, "x", "m1"), (1, "m2", "m1"), (1, "y", "m2")], "snapshot int, importer string, target string")
    m = spark.createDataFrame([("e", "m1"), ("e", "m2")], "entity string, path string")
    assert rows(graph.importer_reach(e, m)) == [(1, "e", 2, 2)]


def test_fan_in(spark):
    def shared(*n):
        calls = spark.createDataFrame([(f"s{i}", f"f{j}") for i, k in enumerate(n) for j in range(k)], "symbol string, flow string")
        return graph.fan_in(calls).where("shared").count()

    assert shared(1, 1, 1, 1, 6) == 1 and shared(1, 1, 1, 1, 5) == 0


def test_reach_both_ways(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "importer string, target string")
    s = spark.createDataFrame([("s", "a")], "seed string, node string")
    want = [("s", "a", 0), ("s", "b", 1), ("s", "c", 2), ("s", "d", 3)]
    assert rows(graph.reach(e, s)) == want and rows(graph.reach_sql(e, s)) == want
    assert rows(graph.reach(e, s, cap=2)) == want[:2]


def test_components_and_cohesion(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in graph.components(e).groupBy("component").count().collect()} == {(0, 31), (100, 2)}
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "importer string, target string")
    clusters = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "node string, cluster int")
    assert rows(graph.cohesion(edges, clusters)) == [(1, 2, 2, 1, 1.0), (2, 1, 0, 0, 0.0)]


def test_components_of_a_path_in_no_order(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    ids = list(range(1000))
    random.Random(3).shuffle(ids)
    path = spark.createDataFrame([*zip(ids, ids[1:]), (5000, 5000), (6001, 6000)], "a long, b long")
    assert rows(graph.components(path).groupBy("component").count()) == [(0, 1000), (5000, 1), (6000, 2)]
    with pytest.raises(RuntimeError):
        graph.components(path, rounds=2)


def test_whole_table_queries(spark):
    q, d = {k: rows(QUERIES[k](spark, SMALL)) for k in ("import_reach", "import_components", "member_backfill", "sibling_collapse")}, Domain(spark, SMALL)
    files, flows, steps = rows(d.feature_paths.select("feature", "path")), rows(d.flow_paths.select("flow", "path")), {}
    for a, b in rows(d.edges.select("importer", "target")):
        steps.setdefault(a, set()).add(b)

    want, of = [], {}
    for feature, path in files:
        of.setdefault(feature, set()).add(path)
    for feature, seeds in of.items():
        seen, now = {p: 0 for p in seeds}, seeds
        for depth in (1, 2, 3):
            now = {b for a in now for b in steps.get(a, ())} - set(seen)
            seen |= dict.fromkeys(now, depth)
        want += [(feature, node, depth) for node, depth in seen.items()]
    assert q["import_reach"] == sorted(want)

    up = {}
    for s, p in rows(d.table("lineitem").select("l_suppkey", "l_partkey")):
        sides = [f"s{s}", f"p{p}"]
        group = set(sides).union(*(up.get(x, ()) for x in sides))
        for x in group:
            up[x] = group
    assert q["import_components"] == sorted((x, min(g)) for x, g in up.items())

    want = []
    for feature, paths in of.items():
        shared = {k: len(paths & {p for f, p in flows if f % 4 == k}) for k in range(4)}
        best = min(shared, key=lambda k: (-shared[k], k))
        if shared[best] * 2 >= len(paths):
            want.append((feature, best, shared[best], shared[best] / len(paths)))
    assert q["member_backfill"] == sorted(want)

    names = {}
    for brand, kind, part in rows(d.table("part").select("p_brand", "p_type", "p_partkey")):
        names.setdefault(brand, {}).setdefault(f"{brand}/{kind}", set()).add(part)
    want = [(b, len(set().union(*k.values())), True) if len(k) >= 3 else (n, len(p), False) for b, k in names.items() for n, p in k.items()]
    assert q["sibling_collapse"] == sorted(set(want))


def test_import_resolution(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/lib/index.ts",), ("pkg/z.tsx",)], "path string")
    specs = spark.createDataFrame([("src/x/y.ts", "../a"), ("src/x.ts", "./lib"), ("src/x.ts", "@p/z"), ("src/x.ts", "react")], "importer string, spec string")
    aliases = spark.createDataFrame([("@p/", "pkg/")], "prefix string, target string")
    assert rows(graph.resolve_imports(specs, files, aliases), "spec", "target") == [("../a", "src/a.ts"), ("./lib", "src/lib/index.ts"), ("@p/z", "pkg/z.tsx")]


# -- sets and increments -----------------------------------------------------------


def test_hash_diff(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, hash int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "path string, hash int")
    assert rows(sets.hash_diff(old, new)) == [("a", "removed"), ("b", "modified"), ("c", "added")]


def test_split_and_merge_lose_nothing(spark):
    paths = spark.createDataFrame([("f", f"a/{i % 3}/{i}.ts") for i in range(30)], "feature string, path string")
    out = sets.split_large(paths, most=12)
    assert out.count() == 30 and out.groupBy("part").count().agg(F.max("count")).first()[0] <= 12
    small = spark.createDataFrame([("x", "t", 5), ("y", "t", 1), ("z", "u", 2)], "feature string, top string, files int")
    assert rows(sets.merge_small(small)) == [("x", "x"), ("y", "x"), ("z", "z")]


def test_incremental_health_is_of_new_commits_alone(spark):
    base = spark.createDataFrame([("f", 100, 50, 12.0), ("g", 5, 0, 88.0)], "feature string, total_commits long, bug_fixes long, health_score double")
    fresh = spark.createDataFrame([("f", 50, 0)], "feature string, new_commits long, new_bugs long")
    assert rows(incremental.incremental_update(base, fresh)) == [("f", 150, 50, 98.8), ("g", 5, 0, 88.0)]


def test_touched_and_rehydrated(spark):
    fp = spark.createDataFrame([("f", "a"), ("g", "b")], "feature string, path string")
    part = incremental.touched(fp, spark.createDataFrame([("a",), ("zz",)], "path string"))
    base, scan = (spark.createDataFrame([("f", v), ("g", v)], "feature string, v string") for v in ("old", "new"))
    assert rows(incremental.rehydrate(part, base, scan)) == [("f", "new", "scan"), ("g", "old", "base")]


# -- journeys ----------------------------------------------------------------------


def test_clusters_by_domain_resource_intent(spark):
    f = spark.createDataFrame([("create-users-flow", "d", "interactive"), ("add-user", "d", "interactive"), ("purge-users", "d", "cron")], "flow string, domain string, trigger string")
    assert rows(journeys.cluster(f), "resource", "intent", "space", "flows") == [("user", "author", "person", 2), ("user", "other", "system", 1)]


@pytest.mark.parametrize("kind,want", [("single_saas", [("f", "P"), ("g", None)]), ("backend", [("f", "Q"), ("g", "Q")]), ("universal", [("f", "P"), ("g", "Q")]), ("turborepo", [("f", None), ("g", None)])])
def test_rollups(spark, kind, want):
    fp = spark.createDataFrame([("f", "a", True, "k"), ("f", "b", False, "k"), ("g", "c", True, "k"), ("g", "d", False, "k")], "flow string, path string, entry boolean, key string")
    pp = spark.createDataFrame([("P", "a", "x"), ("P", "b", "x"), ("Q", "d", "k")], "product string, path string, key string")
    assert [(r.flow, r.product) for r in journeys.rollup(fp, pp, kind).orderBy("flow").collect()] == want


# -- tools and evaluation ----------------------------------------------------------


@pytest.fixture(scope="module")
def features(spark):
    schema = "feature string, display_name string, description string, aliases array<string>, labels array<string>, health_score double, bug_fix_ratio double, bug_fixes long, total_commits long, coverage_pct double, authors array<string>, paths array<string>"
    return spark.createDataFrame([("pay", "Payments", "billing of orders", ["checkout"], [], 40.0, 0.2, 2, 10, None, ["a"], ["p1"]), ("auth", None, None, None, ["login"], 90.0, 0.6, 6, 10, 50.0, ["a", "b"], ["p2", "p3", "p4"])], schema)


def test_tools(spark, features):
    flows = spark.createDataFrame([("pay", "f1", 50.0, 3, ["h1", "h2"], ["p1"]), ("pay", "f2", 50.0, 2, ["h3", "h4"], ["p9"])], "feature string, flow string, health_score double, bus_factor int, hotspot_files array<string>, paths array<string>")
    assert [r.feature for r in tools.call("list_features", features).collect()] == ["pay", "auth"]
    assert [r.name for r in tools.call("find_feature", features, "payment checkouts").collect()] == ["Payments"]
    assert tools.call("get_feature_files", features, flows, "CHECKOUT").first().hotspots == ["h1", "h2", "h3", "h4"]
    assert tools.call("get_hotspots", features, flows, 1).first().hotspot_files == ["h1", "h2", "h3"]
    assert tools.call("get_feature_owners", features, flows, "pay").first().bus_factor == 2
    assert tools.call("get_feature_owners", features, flows, "login").first().bus_factor == 2
    assert tools.call("get_flow_files", flows, "pay", "f2").first().paths == ["p9"]
    s = tools.call("get_repo_summary", features, flows).first()
    assert (s.total_features, s.features_at_risk, s.avg_coverage_pct, s.total_flows) == (2, 1, 50.0, 2)
    symbols = spark.createDataFrame([("pay", "f1", "p1", "charge", [(3, 9)])], "feature string, flow string, file string, symbol string, ranges array<struct<start:int,end:int>>")
    assert tools.call("find_symbols_in_flow", symbols, flows, "pay", "f1", "https://h").first().links == ["https://h/blob/HEAD/p1#L3-L9"]
    assert tools.call("find_symbols_in_flow", symbols, flows, "pay", "f2").first().file == "p9"
    assert tools.call("find_symbols_for_feature", symbols, "pay").count() == 1
    errors = spark.createDataFrame([("p1", None), ("p1", 4), ("p2", 9)], "path string, count long")
    assert tools.call("get_feature_errors", features, errors, "payments").first().total == 5
    assert tools.call("get_feature_pageviews", features, errors, "payments").first().total == 4
    with pytest.raises(KeyError):
        tools.call("none")


def test_equal_runtime_rows_all_count(spark, features):
    name = features.first()["feature"]
    path = features.first()["paths"][0]
    errors = spark.createDataFrame([(path, 2, "a"), (path, 2, "a"), (path, 3, "b"), (path, None, "c"), ("none", 9, "d")], "path string, count int, kind string")
    assert [(r["rows"], r["total"]) for r in tools.feature_errors(features, errors, name).collect()] == [(4, 8)]
    several = spark.createDataFrame([([path, path, "none"], 2), ([path], None), (["none"], 5)], "paths array<string>, count int").withColumn("path", F.lit(None).cast("string"))
    assert [(r["rows"], r["total"]) for r in tools.feature_pageviews(features, several, name).collect()] == [(2, 2)]


def test_change_tools(spark):
    f = spark.createDataFrame([("a", 0.5, 50.0), ("b", 0.0, None)], "feature string, bug_fix_ratio double, coverage_pct double")
    fp = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "feature string, path string")
    out = {r.feature: r for r in tools.change_impact(f, fp, spark.createDataFrame([("x",), ("y",)], "path string")).collect()}
    assert out["a"].impact == 2.25 and out["a"].risk == "critical"
    f = spark.createDataFrame([("a", 0.2), ("b", 0.6)], "feature string, bug_fix_ratio double")
    fp = spark.createDataFrame([("a", "x"), ("b", "p"), ("b", "q"), ("b", "r")], "feature string, path string")
    got = tools.regression_risk(f, fp, spark.createDataFrame([(c,) for c in "xpqr"], "path string")).first()
    assert (got.regression_probability, got.risk) == (0.5, "high")
    none = tools.regression_risk(f, fp, spark.createDataFrame([("zz",)], "path string")).first()
    assert (none.regression_probability, none.risk) == (0.0, "low")


def test_evaluation(spark):
    e = spark.createDataFrame([("billing",), ("team-management",), ("lost",)], "expected string")
    a = spark.createDataFrame([("lost", "found-it")], "expected string, alias string")
    f = spark.createDataFrame([("Billing/invoices",), ("team",), ("found-it",), ("utils",)], "found string")
    assert evaluation.recall(e, a, f).first().recall == 1.0
    assert evaluation.precision(e, a, f).first().precision == 0.75
    assert evaluation.generic_rate(f).first().generic_rate == 0.25


def split_plainly(features, most):
    """One feature after the other, by its directories, else by its stems."""
    skip, support, stems = set(sets.TECHNICAL_DIRS), set(sets.SUPPORT_DIRS), set(sets.SUPPORT_STEMS)
    out = {}
    for name, paths in features.items():
        parts = [p.split("/") for p in paths]
        prefix = 0
        while prefix < min(map(len, parts)) and len({x[prefix] for x in parts}) == 1:
            prefix += 1
        by_dir = {p: f"{name}-{x[prefix].lower()}" if prefix < len(x) - 1 and x[prefix].lower() not in skip else name for p, x in zip(paths, parts)}
        by_stem = {}
        for p, x in zip(paths, parts):
            stem = (x[-1].rpartition(".")[0] or x[-1]).lower()
            apart = (x[-2].lower() if len(x) > 1 else "") in support or stem in stems or stem.startswith(("test_", "tests_"))
            by_stem[p] = None if apart else f"{name}-{stem}"
        counts = Counter(by_stem.values())
        by_stem = {p: g if g and counts[g] > 1 else name for p, g in by_stem.items()}
        dirs, own = Counter(by_dir.values()), Counter(by_stem.values())
        if len(paths) <= most:
            part = dict.fromkeys(paths, name)
        elif len(dirs) > 2 and max(dirs.values()) < 0.7 * len(paths):
            part = by_dir
        elif len({*own, name}) > 3 and max(own.values()) < 0.7 * len(paths):
            part = by_stem
        else:
            part = dict.fromkeys(paths, name)
        out |= {(name, p): g for p, g in part.items()}
    return out


def test_large_features_split_by_directories_or_stems(spark):
    r = random.Random(5)
    features = {"small": ["a/b.py", "c.py"], "flat": [f"x/main/{k}/m{k % 4}.py" for k in range(20)] + ["x/other/tests/test_m1.py", "x/other/urls.py"]}
    for i in range(30):
        dirs = r.sample(["A", "b", "tests", "c", "migrations", "d"], r.randint(1, 5))
        features[f"f{i}"] = sorted({"/".join(["src"] * (i % 3) + ([r.choice(dirs)] if r.random() < 0.8 else []) + ([r.choice(dirs)] if r.random() < 0.4 else []) + [r.choice(["m", "n.x", "o", "test_p", "urls", ".env", "Q"]) + str(r.randint(0, 5) if i % 2 else "") + r.choice([".py", ".TS", ""])]) for _ in range(r.randint(3, 60))})
    df = spark.createDataFrame([(f, p) for f, paths in features.items() for p in paths], "feature string, path string")
    got = {(x["feature"], x["path"]): x["part"] for x in sets.split_features(df, 10).collect()}
    assert got == split_plainly(features, 10) and len(set(got.values())) > len(features) + 10
