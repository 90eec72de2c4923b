"""Which flows make journeys, and in what domain: structural filters over a repository's own distribution.

A flow is judged by the file it enters by. The order of the rules matters, so each flow carries the first that holds:
a sample's flow makes none; one under a connector hub goes to the hub, or to its vendor if the vendor has several;
one under a directory of many small siblings goes to the integrations; one that no person sets off makes a journey of
the system's; and of the rest those that are drawn or built on, rather than done, make none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import conventions as words
from ..functions.text import ancestors
from .journeys import _word, split_name

#: A plugin root has so many children at least, so many flows a child at most, and a child for so many flows.
LEAST_CHILDREN, MOST_FLOWS, LEAST_RATIO = 3, 8, 0.25
VENDOR_FLOWS = 2


# -- domains -----------------------------------------------------------------------


def normal_domain(token: Column) -> Column:
    return _word(F.regexp_replace(token, r"^v\d+_", ""))


def label_domain(label: Column) -> Column:
    """The first noun of a product's label; a brand before a dot, signs and words that lead up to the noun are skipped."""
    low = F.trim(F.lower(label))
    brand = F.substring_index(low, ".", 1)
    cut = F.contains(low, F.lit(".")) & (~brand.rlike(r"^\p{L}+$") | (F.length(brand) <= 4))
    bare = F.regexp_replace(F.when(cut, F.substring(low, F.length(brand) + 2, F.length(low))).otherwise(low), r"[&–—(),:/]", " ")
    tokens = F.filter(F.split(F.regexp_replace(bare, r"[\s_]+", "-"), "-"), lambda t: t != "")
    nouns = F.filter(tokens, lambda t: ~t.isin(*words.LABEL_LEADS))
    return normal_domain(F.coalesce(F.try_element_at(nouns, F.lit(1)), F.try_element_at(tokens, F.lit(1))))


def name_domain(feature: Column) -> Column:
    return _word(F.replace(F.regexp_replace(feature, r"^(?:(?:api|test|v\d+)-)+", ""), F.lit("-"), F.lit("_")))


def _first(files: Column, pattern: str, bad: tuple[str, ...] = ()) -> Column:
    """What a pattern finds in the first file that has it."""
    found = F.filter(F.transform(files, lambda f: F.regexp_extract(f, pattern, 1)), lambda x: (x != "") & ~x.isin("", *bad))
    return F.try_element_at(found, F.lit(1))


def flow_domain(flows: DataFrame) -> DataFrame:
    """flows with ``domain``. flows: entry, paths, product (label of the owning feature's product, or null), feature.

    By, in order: a router's file, a job's file, the product's label, a module's directory, a source directory, the feature's name.
    """
    files = F.filter(F.concat(F.array("entry"), F.coalesce("paths", F.array().cast("array<string>"))), lambda f: f.isNotNull() & (f != ""))
    module = F.replace(_first(files, words.MODULE_DIR, words.NO_MODULES), F.lit("-"), F.lit("_"))
    order = (
        normal_domain(_first(files, words.ROUTER_FILE, ("__init__",))), normal_domain(_first(files, words.JOB_FILE, ("__init__",))), F.when(F.trim("product") != "", label_domain(F.col("product"))),
        normal_domain(module), normal_domain(_first(files, words.SOURCE_DIR)), F.when(F.col("feature") != "", name_domain(F.col("feature"))),
    )
    return flows.withColumn("domain", F.coalesce(*order))


# -- what a flow or a domain is ----------------------------------------------------


def path_segments(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), r"[\\/]+"), lambda s: s != "")


def package_segments(path: Column) -> Column:
    """The segments from the package's name on: leading workspace directories are skipped."""
    segments = path_segments(path)
    own = F.array_position(F.transform(segments, lambda s: ~s.isin(*words.WORKSPACE_ROOTS)), True).cast("int")
    return F.when(own > 0, F.slice(segments, F.greatest(own, F.lit(1)), F.size(segments))).otherwise(F.array().cast("array<string>"))


def is_drawn(entry: Column) -> Column:
    """Whether a file is in a package of things to draw: by the package's name or the directory in it, not by deeper ones."""
    package = package_segments(entry)
    return F.coalesce((F.size(package) >= 2) & F.exists(F.slice(package, 1, 2), lambda s: s.isin(*words.PRIMITIVE_DIRS)), F.lit(False))


def is_infra_package(entry: Column) -> Column:
    package = package_segments(entry)
    return F.coalesce((F.size(package) >= 2) & F.try_element_at(package, F.lit(1)).isin(*words.INFRA_PACKAGES), F.lit(False))


def _domain_words(domain: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(domain)), r"[_\-]+"), lambda w: w != "")


def is_drawn_domain(domain: Column) -> Column:
    parts = _domain_words(domain)
    lead = (F.size(parts) >= 2) & F.try_element_at(parts, F.lit(1)).isin(*words.PRIMITIVE_LEADS)
    return F.coalesce((F.size(parts) > 0) & (lead | F.forall(parts, lambda w: w.isin(*words.PRIMITIVE_WORDS))), F.lit(False))


def is_infra_domain(domain: Column) -> Column:
    low, parts = F.lower(F.trim(domain)), _domain_words(domain)
    headed = (F.size(parts) >= 2) & F.try_element_at(parts, F.lit(-1)).isin(*words.INFRA_DOMAINS)
    return F.coalesce((low != "") & ((F.char_length(low) == 1) | low.rlike(r"^\d+$|^v\d+$") | low.isin(*words.INFRA_DOMAINS) | headed), F.lit(False))


def plugin_place(entry: Column) -> Column:
    """(root, child) of the first plugin directory on a path that has a child of its own name; null without one."""
    segments = path_segments(entry)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(segments) - 1, F.lit(1))), lambda i: F.struct(F.try_element_at(segments, i).alias("root"), F.try_element_at(segments, i + 1).alias("child")))
    return F.try_element_at(F.filter(pairs, lambda p: p["root"].isin(*words.PLUGIN_ROOTS) & p["child"].isNotNull() & ~p["child"].rlike(r"^[._]")), F.lit(1))


def plugin_roots(flows: DataFrame) -> DataFrame:
    """root, children and flows of the directories whose children are many and small. flows: anchor. As many rows as PLUGIN_ROOTS at most."""
    placed = flows.select(plugin_place(F.col("anchor")).alias("p")).where("p is not null").groupBy("p.root", "p.child").agg(F.count("*").alias("n"))
    roots = placed.groupBy("root").agg(F.count("*").alias("children"), F.sum("n").alias("flows"))
    return roots.where((F.col("children") >= LEAST_CHILDREN) & (F.col("flows") <= MOST_FLOWS * F.col("children")) & (F.col("children") >= LEAST_RATIO * F.col("flows")))


def hub_places(flows: DataFrame, hubs: DataFrame, vendors: DataFrame) -> DataFrame:
    """flow, feature, hub (its domain) and vendor (null if the child names none, or several) of the flows under a hub, the deepest one.

    flows: flow, feature, anchor; hubs: dir, key; vendors: token.
    """
    path = F.regexp_replace(F.replace("anchor", F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    above = flows.select("flow", "feature", path.alias("path")).withColumn("dir", F.explode(ancestors("path")))
    best = above.join(hubs.select("dir", "key").distinct(), "dir").groupBy("flow", "feature", "path").agg(F.max(F.struct(F.length("dir").alias("size"), "dir", "key")).alias("h"))
    child = F.split(F.substring(F.col("path"), F.length("h.dir") + 2, F.length("path")), "/")[0]
    tokens = F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(child, r"\.[^.]*$", "")), "[^a-z0-9]+"), lambda t: t != ""))
    named = best.select("flow", "feature", normal_domain(F.replace(F.lower("h.key"), F.lit("-"), F.lit("_"))).alias("hub"), F.explode_outer(tokens).alias("token"))
    known = named.join(vendors.select("token", F.col("token").alias("vendor")).distinct(), "token", "left")
    return known.groupBy("flow", "feature", "hub").agg(F.when(F.count("vendor") == 1, F.max("vendor")).alias("vendor"))


# -- the verdict -------------------------------------------------------------------

ARTIFACT, HUB, PLUGIN, SYSTEM, DRAWN, INFRA, SEED = "dev_artifact", "hub", "plugin", "system", "ui_primitive", "infra_domain", "seed"


def seeds(flows: DataFrame, hubs: DataFrame | None = None, vendors: DataFrame | None = None) -> DataFrame:
    """Every flow once, with ``rule``, the first that holds, and the domain, resource, intent and space of the journey it makes.

    flows: flow, feature, entry, paths, domain (as of flow_domain), trigger (null or ``interactive`` for a person's), artifact (whether its
    feature is laned as a sample), pos. Of flows of one name and feature the first counts. Flows of the rules ``dev_artifact``,
    ``ui_primitive`` and ``infra_domain`` make no journey: domain and the rest are null.
    """
    once = flows.groupBy("flow", "feature").agg(F.min_by(F.struct(*[c for c in flows.columns if c not in ("flow", "feature")]), "pos").alias("x")).select("flow", "feature", "x.*")
    anchor = F.when(F.col("entry") != "", F.col("entry")).otherwise(F.coalesce(F.try_element_at("paths", F.lit(1)), F.lit("")))
    once = split_name(once.withColumn("anchor", anchor)).checkpoint()
    # a row of ten names at most
    roots = plugin_roots(once).agg(F.coalesce(F.collect_set("root"), F.array().cast("array<string>")).alias("roots"))
    met = once.crossJoin(F.broadcast(roots))
    if hubs is not None:
        places = hub_places(once, hubs, vendors if vendors is not None else hubs.select(F.lit(None).cast("string").alias("token"))).checkpoint()
        several = places.where("vendor is not null").groupBy("hub", "vendor").agg(F.count("*").alias("n")).where(F.col("n") >= VENDOR_FLOWS).select("hub", "vendor", F.lit(True).alias("own"))
        places = places.join(several, ["hub", "vendor"], "left").withColumnsRenamed({"flow": "_flow", "feature": "_feature"})
        met = met.join(places, (F.col("flow") == F.col("_flow")) & F.col("feature").eqNullSafe(F.col("_feature")), "left").drop("_flow", "_feature")
    else:
        met = met.withColumns({"hub": F.lit(None).cast("string"), "vendor": F.lit(None).cast("string"), "own": F.lit(None).cast("boolean")})

    domain = F.col("domain")
    weak_word, weak_infra = is_drawn_domain(domain), is_infra_domain(domain)
    strong = domain.isNotNull() & ~weak_word & ~weak_infra
    system = F.col("trigger").isNotNull() & (F.col("trigger") != "interactive")
    rule = (
        F.when(F.coalesce("artifact", F.lit(False)) | F.lower(F.substring_index("anchor", "/", 1)).isin(*words.ARTIFACT_ROOTS), ARTIFACT)
        .when(F.col("hub").isNotNull(), HUB)
        .when(F.arrays_overlap(path_segments(F.col("anchor")), "roots"), PLUGIN)
        .when(system, SYSTEM)
        .when(weak_word | (~strong & is_drawn(F.col("anchor"))), DRAWN)
        .when(weak_infra | (~strong & is_infra_package(F.col("anchor"))), INFRA)
        .otherwise(SEED)
    )
    met = met.withColumn("rule", rule)
    makes = ~F.col("rule").isin(ARTIFACT, DRAWN, INFRA)
    of_hub = F.when(F.col("own"), F.concat_ws("_", "hub", "vendor")).otherwise(F.col("hub"))
    placed = F.when(F.col("rule") == HUB, of_hub).when(F.col("rule") == PLUGIN, words.PLUGIN_DOMAIN).when((F.col("rule") == SYSTEM) & ~strong, F.coalesce("resource", "trigger")).otherwise(domain)
    resource = F.when(F.col("rule") == HUB, F.coalesce("vendor", "resource")).otherwise(F.col("resource"))
    space = F.when(F.col("rule") == SYSTEM, "system").otherwise("person")
    return met.select("flow", "feature", "anchor", "rule", *[F.when(makes, c).alias(n) for n, c in (("domain", placed), ("resource", resource), ("intent", F.col("intent")), ("space", space))])


def seeded_journeys(seeded: DataFrame) -> DataFrame:
    """Journeys by (space, domain, resource, intent), with the flows that make them."""
    made = seeded.where(~F.col("rule").isin(ARTIFACT, DRAWN, INFRA))
    return made.groupBy("space", "domain", "resource", "intent").agg(F.count("*").alias("flows"), F.min("flow").alias("first_flow"))


def seeding_counts(seeded: DataFrame) -> DataFrame:
    """How many flows each rule took."""
    return seeded.groupBy("rule").agg(F.count("*").alias("flows"))
