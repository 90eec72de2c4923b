"""Reach, fan-in, components and clusters of import graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TO_END

MOST_ROUNDS = 50


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 3, cap: int | None = None) -> DataFrame:
    """Breadth-first reach: seed, node, least depth. edges: importer, target; seeds: seed, node.

    One join a level over the frontier alone; nodes met before drop out. With a cap, the first
    nodes by depth and name a seed.
    """
    seen = seeds.select("seed", "node", F.lit(0).alias("depth")).distinct()
    frontier, steps = seen, edges.select(F.col("importer").alias("node"), F.col("target").alias("to")).checkpoint()
    for d in range(1, depth + 1):
        found = frontier.join(steps, "node").select("seed", F.col("to").alias("node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        frontier = found.withColumn("depth", F.lit(d)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    if cap is None:
        return seen
    return seen.withColumn("_nth", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node"))).where(F.col("_nth") <= cap).drop("_nth")


def reach_in_order(edges: DataFrame, seeds: DataFrame, depth: int = 3, most: int = 8, skipped: DataFrame | None = None) -> DataFrame:
    """The nodes that a queue visits from each seed, in its order: seed, node, depth, place (from 1).

    edges: importer, target, pos, in whose order a node's targets are looked at; seeds: seed, node. A layer is visited in
    the order of the one before; the walk ends, within a layer too, at ``most`` nodes with the seed's own. Nodes of
    ``skipped`` (node), as tests are, aren't visited, though a seed may be one.

    A node's order key is (its parent's place, the edge's place), so each layer is one join and a rank; of a layer no more than
    ``most`` nodes a seed go on, so a frontier never grows with the fan-out.
    """
    steps = edges.groupBy(F.col("importer").alias("node"), F.col("target").alias("to")).agg(F.min("pos").alias("pos")).where("node <> to")
    if skipped is not None:
        steps = steps.join(skipped.select(F.col("node").alias("to")).distinct(), "to", "left_anti")
    # of a node's targets the first ones are enough: the walk takes most - 1 new ones, and passes over most - 1 that it knows
    near = Window.partitionBy("node").orderBy("pos", "to")
    steps = steps.withColumn("_nth", F.row_number().over(near)).where(F.col("_nth") <= 2 * most).checkpoint()
    frontier = seeds.select("seed", "node").distinct().withColumns({"depth": F.lit(0), "place": F.lit(1)}).checkpoint()
    seen = frontier
    for d in range(1, depth + 1):
        live = frontier.join(seen.groupBy("seed").agg(F.count("*").alias("_n")), "seed").where(F.col("_n") < most)
        found = live.join(steps, "node").groupBy("seed", "_n", "to").agg(F.min(F.struct("place", "_nth")).alias("key"))
        fresh = found.join(seen.select("seed", F.col("node").alias("to")), ["seed", "to"], "left_anti")
        ranked = fresh.withColumn("_k", F.row_number().over(Window.partitionBy("seed").orderBy("key", "to"))).where(F.col("_k") <= most)
        frontier = ranked.where(F.col("_n") + F.col("_k") <= most).select("seed", F.col("to").alias("node"), F.lit(d).alias("depth"), (F.col("_n") + F.col("_k")).cast("int").alias("place")).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


REACH_SQL = """
WITH RECURSIVE walk(seed, node, depth) AS (
  SELECT seed, node, 0 FROM {seeds}
  UNION ALL
  SELECT w.seed, e.target, w.depth + 1 FROM walk w JOIN {edges} e ON e.importer = w.node WHERE w.depth < {depth}
)
SELECT seed, node, min(depth) AS depth FROM walk GROUP BY seed, node
"""


def reach_sql(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """The same by a recursive query. It keeps every walk, not every node, so it suits small depths and sparse graphs."""
    mark = uuid.uuid4().hex
    edges.createOrReplaceTempView(f"edges_{mark}")
    seeds.createOrReplaceTempView(f"seeds_{mark}")
    return edges.sparkSession.sql(REACH_SQL.format(edges=f"edges_{mark}", seeds=f"seeds_{mark}", depth=depth))


def importer_reach(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Importers from outside an entity, and its members that the snapshot has. edges: snapshot, importer, target; members: entity, path."""
    m = members.select("entity", "path").distinct()
    into = edges.join(m.withColumnRenamed("path", "target"), "target").select("snapshot", "entity", "importer", "target")
    outside = into.join(m.withColumnRenamed("path", "importer"), ["entity", "importer"], "left_anti").groupBy("snapshot", "entity").agg(F.countDistinct("importer").alias("reach"))
    nodes = edges.select("snapshot", F.col("importer").alias("path")).unionAll(edges.select("snapshot", F.col("target").alias("path"))).distinct()
    present = nodes.join(m, "path").groupBy("snapshot", "entity").agg(F.countDistinct("path").alias("members_present"))
    return present.join(outside, ["snapshot", "entity"], "left").select("snapshot", "entity", F.coalesce("reach", F.lit(0)).alias("reach"), "members_present")


def fan_in(calls: DataFrame, ratio: float = 5.0, least: int = 2) -> DataFrame:
    """Flows of each symbol, and whether it is shared: two or more, and over ``ratio`` times the median. calls: symbol, flow."""
    each = calls.groupBy("symbol").agg(F.countDistinct("flow").alias("fan_in"))
    middle = each.agg(F.expr("percentile(fan_in, 0.5)").alias("median"))
    return each.crossJoin(F.broadcast(middle)).select("symbol", "fan_in", "median", ((F.col("fan_in") >= least) & (F.col("fan_in") > ratio * F.col("median"))).alias("shared"))  # one row


def scaffold(claims: DataFrame, pattern: str, least: int = 3) -> DataFrame:
    """Paths under a scaffold directory that at least max(3, 90th percentile) features claim. claims: feature, path."""
    each = claims.groupBy("path").agg(F.countDistinct("feature").alias("claims"))
    mark = each.agg(F.greatest(F.lit(least), F.expr("percentile_disc(0.9) within group (order by claims)").cast("long")).alias("mark"))
    return each.crossJoin(F.broadcast(mark)).where((F.col("claims") >= F.col("mark")) & F.col("path").cast("string").rlike(pattern))


def file_lane(imports: DataFrame, n_products: DataFrame, share_percent: int = 8, least: int = 2) -> DataFrame:
    """Files that at least 8 percent of the products import, two at least. imports: path, product; n_products: n, one row."""
    each = imports.groupBy("path").agg(F.countDistinct("product").alias("products"))
    need = F.greatest(F.lit(least), F.ceil(F.col("n") * share_percent / 100))
    return each.crossJoin(F.broadcast(n_products)).where(F.col("products") >= need).select("path", "products")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v: larger neighbours (large) or all others go to a node's least one."""
    sides = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = sides.groupBy(F.col("u").alias("at")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    near = sides.join(least, sides["u"] == least["at"])
    moved = near.where("v > u") if large else near
    to = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        to = to.unionAll(near.select("u", F.col("m").alias("v")))
    return to.where("u > v").distinct()


def components(pairs: DataFrame, rounds: int = MOST_ROUNDS) -> DataFrame:
    """Connected components by large-star and small-star rounds until nothing changes. pairs: a, b; out: node, component.

    component is the least node. Rounds grow with the logarithm of a path's length; should ``rounds`` not be enough, it raises.
    """
    pairs = pairs.select("a", "b").where("a is not null and b is not null").checkpoint()
    edges = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct().checkpoint()

    def sign(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    was = sign(edges)
    for _ in range(rounds):
        edges = _star(_star(edges, True), False).checkpoint()
        now = sign(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    label = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def import_clusters(edges: DataFrame, hub_fan_in: int = 20) -> DataFrame:
    """Components of the import graph without edges into hubs. edges: importer, target."""
    hubs = edges.groupBy("target").agg(F.countDistinct("importer").alias("n")).where(F.col("n") > hub_fan_in).select("target")
    kept = edges.join(hubs, "target", "left_anti").where("importer <> target")
    return components(kept.select(F.col("importer").alias("a"), F.col("target").alias("b")))


def cohesion(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges within and out of each cluster, and the inner ones over n(n-1). clusters: node, cluster."""
    e = edges.select("importer", "target").distinct().where("importer <> target")
    a = clusters.select(F.col("node").alias("importer"), F.col("cluster").alias("ca"))
    b = clusters.select(F.col("node").alias("target"), F.col("cluster").alias("cb"))
    both = e.join(a, "importer").join(b, "target")
    size = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    inner = both.groupBy(F.col("ca").alias("cluster")).agg(F.count_if(F.col("ca") == F.col("cb")).alias("inner_edges"), F.count_if(F.col("ca") != F.col("cb")).alias("outer_edges"))
    ie = F.coalesce("inner_edges", F.lit(0))
    return size.join(inner, "cluster", "left").select("cluster", "n", ie.alias("inner_edges"), F.coalesce("outer_edges", F.lit(0)).alias("outer_edges"), F.when(F.col("n") > 1, ie / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("cohesion"))


def resolve_imports(specifiers: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """The file that each specifier means. specifiers: importer, spec; files: path; aliases: prefix, target.

    Candidates in order: relative to the importer, by alias, as a path; each as it is, with an
    extension, as an index file. The first that exists is taken.
    """
    base = F.regexp_extract("importer", "^(.*)/[^/]*$", 1)
    relative = F.when(F.startswith("spec", F.lit(".")), _folded(F.concat(base, F.lit("/"), F.col("spec"))))
    by_alias = specifiers.join(aliases, F.startswith("spec", "prefix"), "left").groupBy("importer", "spec").agg(F.max_by(F.concat("target", F.substring(F.col("spec"), F.length("prefix") + 1, F.lit(TO_END))), F.length("prefix")).alias("aliased"))
    stem = F.coalesce(relative, F.col("aliased"), F.regexp_replace("spec", "^/+", ""))
    endings = ["", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.tsx", "/index.js", "/__init__.py"]
    tried = by_alias.select("importer", "spec", F.posexplode(F.array(*[F.concat(stem, F.lit(e)) for e in endings])).alias("nth", "path"))
    return tried.join(files.select("path"), "path").groupBy("importer", "spec").agg(F.min_by("path", "nth").alias("target"))


def _folded(path):
    """Path without . and .. parts."""
    return F.array_join(
        F.aggregate(
            F.split(path, "/"),
            F.array().cast("array<string>"),
            lambda a, s: F.when(s.isin("", "."), a).when((s == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(s))),
        ),
        "/",
    )
