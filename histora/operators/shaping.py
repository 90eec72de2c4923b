"""Classifying repositories, merging anchor candidates into features, and late moves of files and journeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import conventions as c
from ..functions.text import directory, extension, is_test_path, jaccard, name_tokens, slugify, strictly_contained
from .graph import components

def _any(segments: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(segments, F.array(*[F.lit(w) for w in words]))


def artifact_kind(path: str | Column) -> Column:
    """Why a file is no authored source: locale, generated, testing, seed, the first that holds; else null.

    Configuration is never one, wherever it is; tests, compiled code and lock files are counted elsewhere.
    """
    path = F.lower(F.trim(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/"))))
    path = F.regexp_replace(path, "^/+|/+$", "")
    parts = F.split(path, "/")
    name, dirs, end = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1), extension(path)
    config = name.isin(*c.CONFIG_NAMES) | name.rlike(c.CONFIG_PATTERN)
    elsewhere = is_test_path(path) | name.rlike(r"(?:\.gen\.|\.pb\.|_pb2\.py$|\.min\.(?:js|css)$|\.d\.ts$|^(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|go\.sum)$)")
    return (
        F.when(config | elsewhere | (path == ""), F.lit(None).cast("string"))
        .when(end.isin(*c.LOCALE_ENDINGS) | ((end == "json") & _any(dirs, c.LOCALE_DIRS)), "locale")
        .when(_any(dirs, c.GENERATED_DIRS) | name.rlike(c.GENERATED_NAME), "generated")
        .when(_any(dirs, c.TESTING_DIRS) | F.contains(F.concat(F.lit("/"), path), F.lit(c.TESTING_PLACE)), "testing")
        .when(_any(dirs, c.SEED_DIRS), "seed")
    )


def _scope_of(word: Column, *tables: dict[str, tuple[str, ...]]) -> Column:
    """The class of a word in the first table that has it."""
    each = [F.try_element_at(F.create_map(*[F.lit(x) for kv in c.lookup(t).items() for x in kv]), word) for t in tables]
    return F.coalesce(*each)


def _first_scope(hits: Column) -> Column:
    return F.coalesce(*[F.when(F.array_contains(hits, s), s) for s in c.SCOPES])


def url_words(path: Column) -> Column:
    """Segments of a file's path that stand for its url: those after the last routing root, without groups and neutral file names."""
    parts = F.split(path, "/")
    last = F.greatest(*[F.size(parts) - F.array_position(F.reverse(parts), r) + F.when(F.array_contains(parts, r), 1).otherwise(-10_000) for r in c.URL_ROOTS])
    after = F.filter(F.slice(parts, F.greatest(last, F.lit(0)) + 1, F.size(parts)), lambda s: ~s.rlike(r"^\(.*\)$"))
    stem = F.regexp_replace(F.element_at(after, -1), r"\.[^.]*$", "")
    tail = F.when(stem.isin(*c.NEUTRAL_STEMS), F.array().cast("array<string>")).otherwise(F.array(stem))
    return F.when((last > 0) & (F.size(after) > 0), F.concat(F.slice(after, 1, F.size(after) - 1), tail)).otherwise(F.array().cast("array<string>"))


def surface_signal(path: str | Column, published: Column | None = None) -> Column:
    """What surface a file is of, by its route groups, url segments, workspace and root directory; null without any sign.

    The order of precedence is that of SCOPES. ``published``: directories of command-line packages that are shipped, which are product.
    """
    path = F.regexp_replace(F.lower(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/"))), "^[/ ]+|[/ ]+$|(?<=/)/+", "")
    parts = F.split(path, "/")
    groups = F.transform(F.filter(parts, lambda s: s.rlike(r"^\([^.].*\)$")), lambda s: _scope_of(F.regexp_replace(s, r"^\(|\)$", ""), c.ROUTE_GROUPS, c.URL_SEGMENTS))
    urls = F.transform(url_words(path), lambda s: _scope_of(s, c.URL_SEGMENTS))

    def workspace(s: Column, i: Column) -> Column:
        scope = _scope_of(F.try_element_at(parts, i + 2), c.WORKSPACE_DIRS)
        if published is not None:
            scope = F.when((scope == "dev_tooling") & F.array_contains(published, F.array_join(F.slice(parts, F.lit(1), i + 2), "/")), "product").otherwise(scope)
        return F.when(s.isin(*c.WORKSPACE_PARENTS), scope)

    spaces = F.transform(parts, workspace)
    root = F.when(F.size(parts) > 1, _scope_of(parts[0], c.ROOT_DIRS))
    return _first_scope(F.concat(groups, urls, spaces, F.array(root)))


def surface(path: str | Column) -> Column:
    return F.coalesce(surface_signal(path), F.lit("product"))


def route_surface(pattern: str | Column) -> Column:
    """What surface a url pattern is of; null without any sign."""
    pattern = F.lower(F.col(pattern) if isinstance(pattern, str) else pattern)
    words = F.filter(F.split(pattern, "/"), lambda s: (s != "") & ~s.rlike(r"^\[.*\]$|^:.+$|^<.+>$|^\{.+\}$|^\*|^\$"))
    return _first_scope(F.transform(words, lambda s: _scope_of(s, c.URL_SEGMENTS)))


def is_shell(name: str | Column) -> Column:
    """Whether a name is that of a container page."""
    slug = F.regexp_replace(slugify(name), "-page$", "")
    return slug.isin(*c.SHELL_NAMES)


def is_info_page(path: str | Column) -> Column:
    words = url_words(F.regexp_replace(F.lower(F.col(path) if isinstance(path, str) else path), "^/+|/+$", ""))
    return _any(words, c.INFO_SEGMENTS + c.URL_SEGMENTS["legal"])


def repo_signals(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (a workspace) of counts that the classifiers use. files: path (and by)."""
    path = F.col("path")
    counts = {
        "files": F.count("*"),
        "manifests": F.count_if(path.rlike(r"(?:^|/)(?:package\.json|pyproject\.toml|Cargo\.toml|go\.mod|Gemfile|composer\.json)$")),
        "workspaces": F.count_if(path.rlike(r"^(?:apps|packages|services|crates)/[^/]+/(?:package\.json|pyproject\.toml|Cargo\.toml|go\.mod)$")),
        "pages": F.count_if(path.rlike(r"(?:^|/)(?:app|pages|routes)/.*\.(?:[jt]sx?|svelte|vue)$")),
        "servers": F.count_if(path.rlike(r"(?:^|/)(?:routers?|controllers?|handlers?|api)/.*\.\w+$")),
        "commands": F.count_if(path.rlike(r"(?:^|/)(?:cmd|cli|bin|commands)/")),
        "exports": F.count_if(path.rlike(r"(?:^|/)(?:lib|src)/(?:index|mod|lib|__init__)\.\w+$")),
        "infra": F.count_if(path.rlike(r"\.(?:tf|hcl)$|(?:^|/)(?:charts|helm|k8s|terraform)/")),
        "tests": F.count_if(is_test_path(path)),
    }
    return files.groupBy(*(by or [])).agg(*(x.cast("long").alias(n) for n, x in counts.items()))


def repo_class(signals: DataFrame) -> DataFrame:
    """signals with class (library, cli, infra or product) and its confidence, the share of deciding files."""
    n = F.greatest("files", F.lit(1))
    product = F.col("pages") + F.col("servers")
    kind = F.when(F.col("infra") * 2 > n, "infra").when(product > 0, "product").when(F.col("commands") > 0, "cli").when(F.col("exports") > 0, "library").otherwise("product")
    weight = F.when(kind == "infra", F.col("infra")).when(kind == "cli", F.col("commands")).when(kind == "library", F.col("exports")).otherwise(product)
    return signals.withColumn("class", kind).withColumn("confidence", F.least(F.lit(1.0), weight / n))


def repo_shape(signals: DataFrame) -> DataFrame:
    """signals with shape: monorepo, app, server, library or unknown."""
    shape = F.when(F.col("workspaces") >= 2, "monorepo").when(F.col("pages") > 0, "app").when(F.col("servers") > 0, "server").when(F.col("exports") > 0, "library").otherwise("unknown")
    return signals.withColumn("shape", shape)


def partition_plan(files: DataFrame) -> DataFrame:
    """Workspaces of a monorepo with class and size; files outside of any make the partition ``root``."""
    of = F.regexp_extract("path", r"^((?:apps|packages|services|crates)/[^/]+)/", 1)
    placed = files.select(F.when(of != "", of).otherwise("root").alias("workspace"), "path")
    return repo_class(repo_signals(placed, ["workspace"])).select("workspace", "files", "class", "confidence")


def terminal_class(gaps: DataFrame, owners: DataFrame, infra: Column) -> DataFrame:
    """What each gap row is: not_a_feature without members, infra, part_of the one owner of most members, else own.

    gaps: gap, path (nullable); owners: path, feature.
    """
    joined = gaps.join(owners, "path", "left")
    each = joined.groupBy("gap").agg(F.count("path").alias("members"), F.count_if(infra).alias("infra"))
    votes = joined.where("feature is not null").groupBy("gap", "feature").agg(F.countDistinct("path").alias("n"))
    best = votes.withColumn("_nth", F.row_number().over(Window.partitionBy("gap").orderBy(F.desc("n"), "feature"))).where("_nth = 1")
    out = each.join(best, "gap", "left")
    kind = F.when(F.col("members") == 0, "not_a_feature").when(F.col("infra") == F.col("members"), "infra").when(F.col("n") * 2 >= F.col("members"), "part_of").otherwise("own")
    return out.select("gap", "members", kind.alias("class"), F.when(kind == "part_of", F.col("feature")).alias("part_of"))


# -- reconciling candidates --------------------------------------------------------


def merge_pairs(candidates: DataFrame, least: float = 0.7) -> DataFrame:
    """Candidates that are one feature: equal names, names contained by two tokens, or alike path sets.

    candidates: id, name, paths. Pairs are found by a shared token or path, never by a product.
    """
    t = candidates.select("id", "name", "paths", name_tokens("name").alias("tokens"))
    by_token = t.select(F.explode("tokens").alias("key"), "id").distinct()
    by_path = t.select(F.explode("paths").alias("key"), "id").distinct()

    def met(keys: DataFrame) -> DataFrame:
        return keys.alias("x").join(keys.alias("y"), "key").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    pairs = met(by_token).unionAll(met(by_path)).distinct()
    a = t.select(F.col("id").alias("a"), F.col("tokens").alias("ta"), F.col("paths").alias("pa"))
    b = t.select(F.col("id").alias("b"), F.col("tokens").alias("tb"), F.col("paths").alias("pb"))
    full = pairs.join(a, "a").join(b, "b")
    alike = (F.col("ta") == F.col("tb")) | strictly_contained(F.col("ta"), F.col("tb")) | strictly_contained(F.col("tb"), F.col("ta")) | (jaccard(F.col("pa"), F.col("pb"), 1.0) >= least)
    return full.where(alike).select("a", "b")


def reconcile(candidates: DataFrame, least: float = 0.7) -> DataFrame:
    """Features out of candidates of several sources: name by source priority, confidence, then name; paths united.

    candidates: id, name, source, priority, confidence, paths. High confidence needs two sources.
    """
    group = components(merge_pairs(candidates, least)).withColumnRenamed("node", "id").withColumnRenamed("component", "_group")
    rows = candidates.join(group, "id", "left").withColumn("_group", F.coalesce("_group", "id"))
    best = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_group").orderBy(F.desc("priority"), F.desc("confidence"), "name")))
    out = best.groupBy("_group").agg(F.min_by("name", "_nth").alias("name"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("paths"))
    return out.select("name", "sources", "paths", F.when(F.size("sources") >= 2, "high").otherwise("medium").alias("confidence"))


def schema_only(features: DataFrame) -> DataFrame:
    """Features that only schema sources back. features: feature, sources."""
    return features.where(F.size(F.array_except("sources", F.array(F.lit("schema")))) == 0).select("feature")


def guard_residual(residual: DataFrame, known: DataFrame) -> DataFrame:
    """Residual features that hold: over one path, and no name that exists already. residual: feature, path; known: feature."""
    sized = residual.groupBy("feature").agg(F.countDistinct("path").alias("paths"))
    return sized.where("paths > 1").join(known.select("feature"), "feature", "left_anti")


# -- moves -------------------------------------------------------------------------


def test_map(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Source of each test: what it imports, else the file of its name without test marks. imports: importer, target; files: path."""
    tests, sources = files.where(is_test_path("path")), files.where(~is_test_path("path"))
    by_import = tests.withColumnRenamed("path", "test").join(imports.withColumnRenamed("importer", "test"), "test").join(sources.select(F.col("path").alias("target")), "target").select("test", F.col("target").alias("source"), F.lit("import").alias("by"))
    leaf = F.element_at(F.split("path", "/"), -1)
    bare = F.regexp_replace(F.regexp_replace(leaf, r"^test_", ""), r"(?:\.test|\.spec|_test|_spec)(?=\.\w+$)", "")
    named = tests.select(F.col("path").alias("test"), bare.alias("leaf")).join(by_import.select("test"), "test", "left_anti").join(sources.select(F.col("path").alias("source"), leaf.alias("leaf")), "leaf")
    return by_import.unionByName(named.select("test", "source", F.lit("name").alias("by"))).distinct()


def shared_members(residual: DataFrame, imports: DataFrame, owners: DataFrame) -> DataFrame:
    """Unowned files beside every feature that imports them. residual: path; owners: path, feature."""
    met = residual.join(imports.withColumnRenamed("target", "path"), "path").join(owners.select(F.col("path").alias("importer"), "feature"), "importer")
    return met.select("feature", "path", F.lit("shared").alias("role")).distinct()


def split_spans(flow_paths: DataFrame, homes: DataFrame, owners: DataFrame) -> DataFrame:
    """Flow files as own or foreign to the flow's product. homes: flow, product; owners: path, product."""
    joined = flow_paths.join(homes, "flow").join(owners.withColumnRenamed("product", "owner"), "path", "left")
    return joined.select("flow", "path", "product", F.when(F.col("owner").isNull() | (F.col("owner") == F.col("product")), "own").otherwise("shared").alias("ledger"))


def cases(members: DataFrame, least_members: int = 30, least_case: int = 5) -> DataFrame:
    """Splits journeys of thirty flows or more by the next word of the flows' names where that gives cases of five. members: uf, flow, name."""
    word = F.split_part("name", F.lit("-"), F.lit(2))
    by = Window.partitionBy("uf")
    sized = members.withColumn("_n", F.count("*").over(by)).withColumn("_case", word).withColumn("_k", F.count("*").over(Window.partitionBy("uf", "_case")))
    split = (F.col("_n") >= least_members) & (F.col("_k") >= least_case) & (F.col("_case") != "")
    return sized.select("uf", "flow", F.when(split, F.col("_case")).alias("case"))


def home_votes(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Late re-homing: a row moves to the home that holds over ``least`` of its evidence. rows: id, home, candidate, weight."""
    by = Window.partitionBy("id")
    sums = rows.groupBy("id", "home", "candidate").agg(F.sum("weight").alias("w")).withColumn("all", F.sum("w").over(by))
    best = sums.withColumn("_nth", F.row_number().over(by.orderBy(F.desc("w"), "candidate"))).where("_nth = 1")
    return best.select("id", F.when(F.col("w") > least * F.col("all"), F.col("candidate")).otherwise(F.col("home")).alias("home"))


def match_specs(specs: DataFrame, journeys: DataFrame, least: int = 2) -> DataFrame:
    """Test titles and the journeys that share most words with them, two at least; titles without one come back null.

    specs: title; journeys: uf, name. Titles, and journeys, of the same words are one. In one order of all words, from rare to
    frequent, a pair that shares ``least`` of them shares one that is not among the last ``least`` - 1 of either side, so a word
    that all have joins nothing by itself.
    """
    titles = specs.select("title").distinct()
    a = titles.select("title", F.array_sort(F.array_distinct(name_tokens(F.regexp_replace("title", r"\W+", "-")))).alias("words")).where("title is not null")
    b = journeys.select("uf", F.explode(name_tokens("name")).alias("t")).groupBy("uf").agg(F.array_sort(F.collect_set("t")).alias("words")).groupBy("words").agg(F.min(F.struct("uf")).alias("of"))  # no name comes first, as in an order
    each = [x.select("words", F.explode("words").alias("t")).distinct() for x in (a, b)]
    df = [x.groupBy("t").agg(F.count("*").alias(f"d{i}")) for i, x in enumerate(each)]
    rank = df[0].join(df[1], "t").select("t", (F.col("d0") + F.col("d1")).alias("df"))

    def first(x: DataFrame, name: str) -> DataFrame:
        known = x.join(rank, "t").groupBy("words").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("known")).where(F.size("known") >= least)
        return known.select(F.col("words").alias(name), F.explode(F.transform(F.slice("known", F.lit(1), F.size("known") - (least - 1)), lambda x: x["t"])).alias("t"))

    near = first(each[0], "asked").join(first(each[1], "words"), "t").select("asked", "words").distinct()
    met = near.withColumn("n", F.size(F.array_intersect("asked", "words")).cast("long")).where(F.col("n") >= least).join(b, "words")
    best = met.groupBy("asked").agg(F.min(F.struct((-F.col("n")).alias("less"), "of")).alias("x"))
    found = a.join(best, F.col("words") == F.col("asked")).select("title", F.col("x.of.uf").alias("uf"), (-F.col("x.less")).alias("n"))
    return titles.join(found, "title", "left")


def vendor_split(paths: DataFrame, root: str, least: int = 2) -> DataFrame:
    """Connector features: one a vendor directory below ``root`` with two files or more. paths: feature, path."""
    vendor = F.regexp_extract("path", rf"(?:^|/){root}/([^/]+)/", 1)
    n = F.count("*").over(Window.partitionBy("feature", vendor))
    return paths.withColumn("_v", vendor).withColumn("_n", n).select("path", F.when((F.col("_v") != "") & (F.col("_n") >= least), F.concat_ws("/", "feature", "_v")).otherwise(F.col("feature")).alias("feature"))


def flow_members(flows: DataFrame, journeys: DataFrame) -> DataFrame:
    """Flows of each journey by back pointer, id or name, each once. flows: flow, uuid, name, uf; journeys: uf, member."""
    by_pointer = flows.where("uf is not null").select("uf", "flow")
    by_id = journeys.join(flows.select(F.col("uuid").alias("member"), "flow"), "member").select("uf", "flow")
    by_name = journeys.join(flows.select(F.col("name").alias("member"), "flow"), "member").select("uf", "flow")
    return by_pointer.unionByName(by_id).unionByName(by_name).distinct()


def scan_counters(rows: DataFrame) -> DataFrame:
    """Stage runs, fallbacks and their share. rows: stage, fell_back, degradation (nullable)."""
    return rows.groupBy("stage").agg(F.count("*").alias("runs"), F.count_if("fell_back").alias("fallbacks"), (F.count_if("fell_back") / F.count("*")).alias("fallback_share"), F.array_sort(F.collect_set("degradation")).alias("degradations"))


def path_index(features: DataFrame) -> DataFrame:
    """Owner of each path: the first feature in order. features: uuid, pos, path."""
    return features.groupBy("path").agg(F.min_by("uuid", F.struct("pos", "uuid")).alias("uuid"))


def routes_index(routes: DataFrame, owners: DataFrame) -> DataFrame:
    """Routes with the owner of their file, empty where nobody owns it. routes: pattern, method, path; owners: path, uuid."""
    return routes.join(owners, "path", "left").select("pattern", "method", "path", F.coalesce("uuid", F.lit("")).alias("uuid"))


def by_directory(files: DataFrame) -> DataFrame:
    return files.groupBy(directory("path").alias("dir")).agg(F.count("*").alias("files"))
