"""Journeys out of flows: clustering, rollup to products, splitting and naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import conventions

def _word(w: Column) -> Column:
    """A token in the singular; -us, -is and -ss stay, -es goes after a hiss alone."""
    return (
        F.when(F.length(w) <= 3, w)
        .when(F.endswith(w, F.lit("ies")) & (F.length(w) > 4), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("(?:ss|us|is)$"), w)
        .when(w.rlike("(?:sses|shes|ches|xes|zzes)$"), F.regexp_replace(w, "es$", ""))
        .otherwise(F.regexp_replace(w, "s$", ""))
    )


def intent_of(verb: Column) -> Column:
    verbs = conventions.lookup(conventions.INTENT_VERBS)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in verbs.items() for x in kv]), verb), F.lit("other"))


def split_name(flows: DataFrame) -> DataFrame:
    """flows with verb, resource (each token in the singular, ``item`` if there is none) and intent; names are verb-resource-... with a final -flow dropped."""
    parts = F.split(F.regexp_replace(F.lower("flow"), "-flow$", ""), "-")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    resource = F.when(F.size(rest) > 0, F.array_join(F.transform(rest, _word), "-")).otherwise("item")
    return flows.withColumn("verb", parts[0]).withColumn("resource", resource).withColumn("intent", intent_of(F.col("verb")))


def journey_name(domain: Column, intent: Column, resource: Column) -> Column:
    """Name of a journey: its domain in the plural, or its resource, in the words of its intent."""
    label = F.coalesce(F.concat(F.replace(domain, F.lit("_"), F.lit(" ")), F.lit("s")), resource)
    out = F.when(F.lit(False), label)
    for kind, words in conventions.JOURNEY_NAMES.items():
        before, after = words.split("{}")
        out = out.when(intent == kind, F.concat(F.lit(before), label, F.lit(after)))
    return out.otherwise(label)


def cluster(flows: DataFrame) -> DataFrame:
    """Journeys by (domain, resource, intent); flows that no person sets off make journeys apart. flows: flow, domain, trigger."""
    named = split_name(flows.dropDuplicates(["flow", "domain"]))
    space = F.when(F.col("trigger") == "interactive", "person").otherwise("system")
    return named.groupBy("domain", "resource", "intent", space.alias("space")).agg(F.count("*").alias("flows"), F.array_sort(F.collect_set("flow")).alias("members"))


def aggregate_domains(flows: DataFrame, least: int = 2) -> DataFrame:
    """One journey a domain with at least two flows. flows: flow, domain."""
    return flows.groupBy("domain").agg(F.countDistinct("flow").alias("flows")).where(F.col("flows") >= least)


def lattice(members: DataFrame, buckets: int = 3, flows: int = 2, loc: int = 150) -> DataFrame:
    """Splits a catch-all journey by an axis if three buckets or more are large enough; small ones stay with it.

    members: uf, flow, axis, loc.
    """
    sized = members.groupBy("uf", "axis").agg(F.countDistinct("flow").alias("n"), F.sum("loc").alias("loc"))
    ok = sized.withColumn("ok", (F.col("n") >= flows) | (F.col("loc") >= loc))
    split = ok.withColumn("many", F.count_if("ok").over(Window.partitionBy("uf")) >= buckets)
    part = F.when(F.col("many") & F.col("ok"), F.concat_ws("/", F.col("uf").cast("string"), F.col("axis").cast("string"))).otherwise(F.col("uf").cast("string"))
    return members.join(split.select("uf", "axis", part.alias("part")), ["uf", "axis"]).groupBy("uf", "part").agg(F.countDistinct("flow").alias("flows"), F.sum("loc").alias("loc"))


ROLLUPS = ("turborepo", "single_saas", "library", "framework", "backend", "go_server", "cli", "universal")


def rollup(flow_paths: DataFrame, product_paths: DataFrame, kind: str, member_map: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """Product of each flow by the strategy of the repository's shape.

    flow_paths: flow, path, entry (bool), key (controller, command or workspace); product_paths:
    product, path, key. member_map: flow, product. Strategies are ordered lookups; the first
    that answers is taken: by map, by key, by entry file (with the same workspace for
    turborepo), by directory, by overlap of at least a half.
    """
    if kind not in ROLLUPS:
        raise ValueError(f"{kind} is none of {', '.join(ROLLUPS)}")
    flows = flow_paths.select("flow").distinct()
    entry = flow_paths.where("entry") if kind not in ("universal", "library") else flow_paths

    def least_product(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("flow").agg(F.min("product").alias(name))

    ways: dict[str, DataFrame] = {}
    if kind in ("library", "framework") and member_map is not None:
        ways["map"] = least_product(member_map, "map")
    if kind in ("backend", "cli"):
        ways["key"] = least_product(entry.select("flow", "key").join(product_paths.select("product", "key").distinct(), "key"), "key")
    if kind == "turborepo":
        same = entry.select("flow", "path", F.col("key").alias("ws")).join(product_paths.select("product", "path"), "path").join(product_paths.select("product", F.col("key").alias("ws")).distinct(), ["product", "ws"], "left_semi")
        ways["entry"] = least_product(same, "entry")
    elif kind in ("single_saas", "framework", "backend", "go_server", "cli"):
        ways["entry"] = least_product(entry.select("flow", "path").join(product_paths.select("product", "path"), "path"), "entry")
    if kind == "go_server":
        d = F.regexp_extract(F.col("path").cast("string"), "^(.*)/[^/]*$", 1)
        ways["dir"] = least_product(entry.select("flow", d.alias("dir")).where("dir <> ''").join(product_paths.select("product", d.alias("dir")).distinct(), "dir"), "dir")
    if kind in ("universal", "go_server"):
        fp = flow_paths.select("flow", "path").distinct()
        n = fp.groupBy("flow").agg(F.count("*").alias("n"))
        met = fp.join(product_paths.select("product", "path").distinct(), "path").groupBy("flow", "product").agg(F.count("*").alias("k")).join(n, "flow").where(F.col("k") >= least * F.col("n"))
        best = met.withColumn("_nth", F.row_number().over(Window.partitionBy("flow").orderBy(F.desc("k"), "product"))).where("_nth = 1")
        ways["overlap"] = best.select("flow", F.col("product").alias("overlap"))
    out = flows
    for name, way in ways.items():
        out = out.join(way, "flow", "left")
    if not ways:
        return out.select("flow", F.lit(None).cast("string").alias("product"), F.lit(None).cast("string").alias("by"))
    by = F.coalesce(*[F.when(F.col(w).isNotNull(), F.lit(w)) for w in ways])
    return out.select("flow", F.coalesce(*ways).alias("product"), by.alias("by"))


def name_by_rung(names: DataFrame) -> DataFrame:
    """The name of the first rung, shortest and then first by the alphabet. names: entity, rung, name."""
    order = Window.partitionBy("entity").orderBy("rung", F.length("name"), "name")
    return names.where("name is not null and name <> ''").withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("entity", "name", "rung")


def last_writes(ledger: DataFrame) -> DataFrame:
    """Present home of each id and how often it changed. ledger: id, seq, home, writer."""
    before = F.lag("home").over(Window.partitionBy("id").orderBy("seq"))
    moved = ledger.withColumn("_moved", (~F.col("home").eqNullSafe(before)) & before.isNotNull())
    return moved.groupBy("id").agg(F.max_by("home", "seq").alias("home"), F.max_by("writer", "seq").alias("writer"), F.count_if("_moved").alias("overturns"))


def journey_lines(spans: DataFrame, members: DataFrame) -> DataFrame:
    """Lines of a journey: the union, file by file, of its flows' ranges. members: uf, flow."""
    from .intervals import union_length

    return union_length(spans.join(members, "flow"), ["uf", "path"]).groupBy("uf").agg(F.sum("lines").alias("loc"), F.count("*").alias("files"))


def subtree_homes(files: DataFrame, anchors: DataFrame, theta: float = 0.5) -> DataFrame:
    """Products whose anchor subtree holds at least theta of a feature's files; the deepest anchor of each file votes.

    files: feature, path; anchors: dir, product.
    """
    from .ownership import nearest_ancestor

    near = nearest_ancestor(files.select("path").distinct(), anchors.select("dir", F.col("product").alias("feature"))).select("path", F.col("feature").alias("product"))
    votes = files.join(near, "path").groupBy("feature", "product").agg(F.countDistinct("path").alias("n"))
    total = files.groupBy("feature").agg(F.countDistinct("path").alias("all"))
    best = votes.join(total, "feature").withColumn("_nth", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "product"))).where("_nth = 1")
    return best.where(F.col("n") >= theta * F.col("all")).select("feature", "product", "n", "all")
