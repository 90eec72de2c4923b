"""Commands: chains of operators from a tree and a history to tables, and from tables to newer ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls, graph, incremental, metrics, ownership, repos, sets
from ..sources import anchors, code, history, intake, languages, scripts


class Tables(Mapping):
    """Tables by name. Each is made when it is first read, so what nobody reads costs nothing."""

    def __init__(self, **makers: Callable[[Tables], DataFrame]) -> None:
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name](self)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def import_edges(files: DataFrame) -> DataFrame:
    """importer, target over all languages. files: path, text."""
    each = [scripts.script_edges(files), code.python_edges(files), languages.go_edges(files), languages.rust_edges(files)]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.distinct()


def route_table(files: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """pattern, method, path and trigger of all routes that a tree's sources give. hits: what text_hits gives, if it is at hand."""
    found = (anchors.text_hits(files) if hits is None else hits).unionByName(anchors.path_hits(files)).checkpoint()
    routes = anchors.mounted_fastapi(found).unionByName(anchors.mounted_django(found)).unionByName(found.where("pattern is not null and source in ('approuter-keyless', 'express-route', 'fastify-route', 'go-router', 'server-api', 'spa-router')"))
    listed = routes.select("pattern", "method", "path").distinct().join(files.select("path", "text"), "path")
    return repos.triggers(listed, repos.cron_paths(files)).select("pattern", "method", "path", "trigger")


def features_of(files: DataFrame, stack: str = "", hits: DataFrame | None = None) -> DataFrame:
    """feature, path, source: each file goes to the anchor that names it, by confidence, then to the only anchor of its directory, else to its directory."""
    raw = (anchors.text_hits(files) if hits is None else hits).unionByName(anchors.path_hits(files, stack)).checkpoint()
    found = raw.where("name <> '' and source not in ('cargo-member', 'cargo-package', 'fastapi-route', 'fastapi-mount', 'django-mount', 'rails-association')").unionByName(anchors.mounted_fastapi(raw))
    sure = anchors.candidates(found).select("source", "name", "confidence")
    named = found.select("source", "name", "path").distinct().join(sure, ["source", "name"])
    owner = named.groupBy("path").agg(F.max_by(F.struct("name", "source"), F.struct("confidence", F.col("name"), "source")).alias("x")).select("path", F.col("x.name").alias("feature"), F.col("x.source").alias("source"))
    rest = files.select("path").join(owner, "path", "left_anti")
    by_dir = ownership.owner_lookup(rest.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)), owner.select("path", "feature").withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)))
    homed = by_dir.where("feature is not null").select("path", "feature", F.lit("directory").alias("source"))
    left = sets.candidates(rest.join(homed.select("path"), "path", "left_anti")).select("path", "feature", F.lit("residual").alias("source"))
    return owner.unionByName(homed).unionByName(left)


def scan(files: DataFrame, raw_commits: DataFrame, as_of: str, stack: str = "", coverage: Callable[[DataFrame], DataFrame] | None = None) -> Tables:
    """A whole scan: features with paths and metrics, flows with their symbols, routes and edges.

    files: path, text; raw_commits as of read_commits. ``coverage`` is a provider that may give (path, pct) of the files; without one coverage is unknown.
    """
    texts = history.describe_files(files).select("path", "text")
    hits = anchors.text_hits(texts).checkpoint()  # both features and routes read them

    def features(t: Tables) -> DataFrame:
        touched = history.commit_files(t["commits"])
        owned = t["feature_paths"].select("feature", "path")
        fc = metrics.feature_commits(t["commits"], touched, owned.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)))
        measured = metrics.feature_metrics(fc, owned, F.lit(as_of).cast("timestamp"))
        if coverage is None:
            return measured.withColumn("coverage_pct", F.lit(None).cast("double"))
        covered = coverage(texts).join(t["feature_paths"], "path").groupBy("feature").agg(F.round(F.avg("pct"), 6).alias("coverage_pct"))
        return measured.join(covered, "feature", "left")

    return Tables(
        features=features,
        feature_paths=lambda t: features_of(texts, stack, hits).checkpoint(),
        routes=lambda t: route_table(texts, hits),
        flows=lambda t: repos.entry_flows(t["routes"], t["feature_paths"].select("path", "feature")),
        edges=lambda t: import_edges(texts),
        reach=lambda t: graph.reach(t["edges"], t["flows"].select(F.col("flow").alias("seed"), F.col("path").alias("node")), 2),
        commits=lambda t: history.prepare_commits(raw_commits),
    )


def update(base: DataFrame, feature_paths: DataFrame, fetch_commits: Callable[[], DataFrame]) -> DataFrame:
    """Stored counts with the commits that ``fetch_commits`` gives, which the caller may replace. base: feature, total_commits, bug_fixes, health_score."""
    commits = history.prepare_commits(fetch_commits())
    fresh = history.commit_files(commits).join(feature_paths.select("feature", "path"), "path").select("feature", "sha").distinct().join(commits.select("sha", "is_bug_fix"), "sha")
    counted = fresh.groupBy("feature").agg(F.count("*").alias("new_commits"), F.sum(F.col("is_bug_fix").cast("long")).alias("new_bugs"))
    return incremental.incremental_update(base, counted)


def replay(run: str, stage: str, make: Callable[[SparkSession], DataFrame], spark: SparkSession) -> DataFrame:
    """Rows that differ between a stage's stored result and the same stage made again."""
    return history.replay_difference(spark.read.parquet(f"{run.rstrip('/')}/{stage}"), make(spark))


def classify_shape(files: DataFrame) -> DataFrame:
    """The shape of each repository and the rollup that follows. files: repo, path, text."""
    rollup = F.create_map(*[F.lit(x) for kv in repos.ROLLUP_OF.items() for x in kv])
    return repos.repo_shape(repos.signals(files)).select("repo", "shape", "confidence", F.element_at(rollup, F.col("shape")).alias("rollup"))


def suggest_config(files: DataFrame) -> DataFrame:
    """Names that manifests and code owners of a tree suggest. files: path, text."""
    packages = history.workspaces(files.where(F.element_at(F.split("path", "/"), -1) == "package.json")).select("dir", "name").distinct()
    return intake.suggest_config(packages, intake.code_owners(files))


def linked(files: DataFrame) -> DataFrame:
    """Links over frameworks of a whole tree. files: path, text."""
    routes = route_table(files).select("pattern", "method", F.col("path").alias("handler"))
    return calls.framework_links(files, scripts.symbol_edges(files), calls.calls(files), routes)
