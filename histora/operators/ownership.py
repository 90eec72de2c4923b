"""Who owns a file: lookups, elections, claims, votes and identity across snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ancestors
from . import graph, setjoin
from .keep import kept

MOST_WALKED = 100_000  # pairs of a component that one task walks through
ROUNDS_APART = 4  # rounds of mutual bests before what is left is split again


def owner_lookup(files: DataFrame, feature_paths: DataFrame) -> DataFrame:
    """Owners of each file by path; else the only feature of its directory; else null.

    files: path, dir; feature_paths: feature, path, dir. A directory of several
    features is ambiguous and attributes nothing.
    """
    exact = feature_paths.select("path", "feature").distinct()
    only = feature_paths.groupBy("dir").agg(F.min("feature").alias("by_dir"), F.max("feature").alias("_most")).where(F.col("by_dir") == F.col("_most")).select("dir", "by_dir")
    found = files.join(exact, "path", "left").join(only, "dir", "left")
    how = F.when(F.col("feature").isNotNull(), "path").when(F.col("by_dir").isNotNull(), "dir")
    return found.select("path", "dir", F.coalesce("feature", "by_dir").alias("feature"), how.alias("matched_by"))


def first_claimant(feature_paths: DataFrame) -> DataFrame:
    """The older fallback: of a directory's features the first in order. feature_paths has pos."""
    return feature_paths.groupBy("dir").agg(F.min_by("feature", F.struct("pos", "feature")).alias("feature"))


def nearest_ancestor(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """The owner of the longest directory above a path. files: path; dirs: dir, feature (one a directory)."""
    above = files.select("path", F.posexplode(ancestors("path")).alias("nth", "dir"))
    met = above.join(dirs, "dir")
    return met.groupBy("path").agg(F.min_by("feature", "nth").alias("feature"), F.min_by("dir", "nth").alias("dir"))


def local_tests(tests: DataFrame, members: DataFrame) -> DataFrame:
    """Tests next to an entity: their directory without test parts, or one above it, holds members. The root doesn't count."""
    bare = F.array_join(F.filter(F.split("path", "/"), lambda s: ~s.isin("test", "tests", "__tests__", "spec", "e2e")), "/")
    above = tests.select("path", F.explode(ancestors(bare)).alias("dir"))
    dirs = members.select("entity", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir")).where("dir <> ''").distinct()
    return above.join(dirs, "dir").select("entity", "path").distinct()


def primary_owners(claims: DataFrame) -> DataFrame:
    """One owner a file: deepest own module that holds it, then no facet, most files in its directory, most flows, name.

    claims: path, feature, module_depth (0: none), is_facet, dir_files, flows.
    """
    depth = F.when(F.col("is_facet"), 0).otherwise(F.col("module_depth"))
    order = [depth.desc(), F.col("is_facet").cast("int"), F.desc("dir_files"), F.desc("flows"), F.col("feature")]
    return claims.withColumn("_nth", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where("_nth = 1").drop("_nth").select("path", "feature")


def settle_claims(claims: DataFrame) -> DataFrame:
    """Contested paths go to one feature, but none is left without a path.

    claims: feature, path, priority, confidence (2 high, 1 medium, 0 low). Winner:
    priority, confidence, number of paths, name. A feature that would keep nothing keeps
    all of its contested paths, shared with their winners.
    """
    sized = claims.withColumn("_size", F.count("*").over(Window.partitionBy("feature")))
    order = Window.partitionBy("path").orderBy(F.desc("priority"), F.desc("confidence"), F.desc("_size"), "feature")
    ranked = sized.withColumn("_nth", F.row_number().over(order))
    left = F.count_if(F.col("_nth") == 1).over(Window.partitionBy("feature"))
    return ranked.withColumn("_left", left).where("_nth = 1 or _left = 0").select("feature", "path", (F.col("_nth") == 1).alias("wins"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared members of groups of both sides. a: a_id, member; b: b_id, member; repeated members count once.

    An equi-join on the member with sizes beside it: no product of the groups.
    """
    a, b = a.select("a_id", "member").distinct(), b.select("b_id", "member").distinct()
    shared = a.join(b, "member").groupBy("a_id", "b_id").agg(F.count("*").alias("shared"))
    na, nb = a.groupBy("a_id").agg(F.count("*").alias("n_a")), b.groupBy("b_id").agg(F.count("*").alias("n_b"))
    out = shared.join(na, "a_id").join(nb, "b_id")
    return out.withColumn("jaccard", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")))


def lineage(base: DataFrame, new: DataFrame, related: float = 0.40, keeps: float = 0.70) -> DataFrame:
    """Which new group goes on as which base group.

    base: b_id, member, b_idx; new: a_id, member, a_idx. Of related pairs (Jaccard over
    ``related``) each new group takes its best base, the later one on ties, and keeps its id
    if the Jaccard reaches ``keeps``; two new groups on one base compete, the higher and
    then the earlier wins; related groups without the id are splits; others are fresh.
    """
    # the groups' places go with their members, so that both are read once
    a = kept(new.select("a_id", "member", "a_idx").where("member is not null").distinct())
    b = kept(base.select("b_id", "member", "b_idx").where("member is not null").distinct())
    a_place, b_place = a.groupBy("a_id").agg(F.min("a_idx").alias("a_idx")), b.groupBy("b_id").agg(F.min("b_idx").alias("b_idx"))
    a, b = a.select("a_id", "member").distinct(), b.select("b_id", "member").distinct()
    a_class, b_class = setjoin.set_classes(a, "a_id"), setjoin.set_classes(b, "b_id")
    met = setjoin.similar_of(a, a_class, b, b_class, related)
    # of equal base groups the later one is the best
    latest = b_class.join(b_place, "b_id").groupBy(F.col("rep").alias("b_rep")).agg(F.max(F.struct("b_idx", "b_id")).alias("b"))
    placed = met.withColumnRenamed("b_id", "b_rep").join(latest, "b_rep")
    best = placed.groupBy(F.col("a_id").alias("rep")).agg(F.max(F.struct("jaccard", "b")).alias("best")).select("rep", F.col("best.b.b_id").alias("b_id"), F.col("best.jaccard").alias("jaccard"))
    each = a_class.select("a_id", "rep").join(best, "rep").join(a_place, "a_id")
    first = each.groupBy("b_id").agg(F.min(F.struct((-F.col("jaccard")).alias("less"), "a_idx", "a_id"))["a_id"].alias("first"))
    wins = each.join(first, "b_id").withColumn("_wins", (F.col("jaccard") >= keeps) & (F.col("a_id") == F.col("first")))
    full = a_place.select("a_id").join(wins.select("a_id", "b_id", "jaccard", "_wins"), "a_id", "left")
    kind = F.when(F.col("_wins"), "kept").when(F.col("b_id").isNotNull(), "split").otherwise("fresh")
    return full.select("a_id", F.when(F.col("_wins"), F.col("b_id")).alias("keeps_id"), F.col("b_id").alias("related_id"), F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"), kind.alias("kind"))


def backfill(dev: DataFrame, product: DataFrame, least: float = 0.5) -> DataFrame:
    """The product that holds the largest share of a dev feature's paths, if at least half; ties by name."""
    a, b = setjoin.members_of(dev, "a_id"), setjoin.members_of(product, "b_id")
    classes = setjoin.set_classes(a, "a_id")
    met = setjoin.similar_of(a, classes, b, setjoin.set_classes(b, "b_id"), least, share=True)
    best = met.groupBy(F.col("a_id").alias("rep")).agg(F.min(F.struct((-F.col("shared")).alias("less"), "b_id", "n_a")).alias("best"))
    shared = -F.col("best.less")
    return classes.join(best, "rep").select(F.col("a_id").alias("dev"), F.col("best.b_id").alias("product"), shared.alias("shared"), (shared / F.col("best.n_a")).alias("share"))


def secondary_owners(flow_paths: DataFrame, feature_paths: DataFrame, primary: DataFrame) -> DataFrame:
    """Features that share a path with a flow and aren't its primary owner. primary: flow, feature."""
    met = flow_paths.join(feature_paths, "path").groupBy("flow", "feature").agg(F.countDistinct("path").alias("shared"))
    return met.join(primary.select("flow", "feature"), ["flow", "feature"], "left_anti")


def flow_overlaps(flow_paths: DataFrame) -> DataFrame:
    """How many other flows share a path with each flow."""
    met = setjoin.meetings(flow_paths.select(F.col("flow").alias("id"), F.col("path").alias("member")))
    return met.select(F.col("id").alias("flow"), "others")


def flow_owner(members: DataFrame) -> DataFrame:
    """Primary owner of a flow: the anchor first, then confidence, then name. members: flow, feature, is_anchor, confidence."""
    order = Window.partitionBy("flow").orderBy(F.col("is_anchor").cast("int").desc(), F.desc("confidence"), "feature")
    return members.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("flow", "feature")


def conserve(votes: DataFrame, incumbents: DataFrame) -> DataFrame:
    """Home of each journey by its members' lines and entries.

    votes: uf, pf, span, entries; incumbents: uf, pf. The incumbent stands with over half of the
    span and, if there are entries, half of these; else the most span, then entries,
    then the smallest key wins; without any vote it stays.
    """
    sums = votes.groupBy("uf", "pf").agg(F.sum("span").alias("span"), F.sum("entries").alias("entries"))
    by = Window.partitionBy("uf")
    full = sums.withColumn("all_span", F.sum("span").over(by)).withColumn("all_entries", F.sum("entries").over(by))
    full = full.withColumn("_nth", F.row_number().over(by.orderBy(F.desc("span"), F.desc("entries"), "pf")))
    best = full.where("_nth = 1").select("uf", F.col("pf").alias("best"))
    held = incumbents.withColumnRenamed("pf", "was").join(full.withColumnRenamed("pf", "was"), ["uf", "was"], "left").join(best, "uf", "left")
    stands = (F.col("span") * 2 > F.col("all_span")) & ((F.col("all_entries") == 0) | (F.col("entries") * 2 >= F.col("all_entries")))
    home = F.when(F.col("best").isNull() | F.coalesce(stands, F.lit(False)), F.col("was")).otherwise(F.col("best"))
    return held.select("uf", "was", home.alias("home"), (~home.eqNullSafe(F.col("was"))).alias("resettled"))


def vote_token(tokens: DataFrame, least: float = 0.6) -> DataFrame:
    """Most common token of each entity if at least ``least`` of its voting paths have it. tokens: entity, path, token."""
    votes = tokens.where("token is not null").select("entity", "path", "token").distinct()
    voters = votes.groupBy("entity").agg(F.countDistinct("path").alias("voters"))
    counted = votes.groupBy("entity", "token").agg(F.count("*").alias("n")).join(voters, "entity")
    first = counted.withColumn("_nth", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("n"), "token"))).where("_nth = 1")
    return first.select("entity", F.when(F.col("n") >= least * F.col("voters"), F.col("token")).alias("token"), "n", "voters")


def sequence_ids(rows: DataFrame, space: str, name: str = "name", order: str = "pos") -> DataFrame:
    """rows with seq, the number of the name's occurrence, and a stable id of both."""
    from ..functions.text import minted_id

    seq = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return rows.withColumn("seq", seq).withColumn("uuid", minted_id(space, F.col(name), F.col("seq")))


def hashed_ties(a: str = "a_id", b: str = "b_id") -> list[Column]:
    """The end of an order that settles ties of a greedy matching by chance, the same in every run."""
    return [F.xxhash64(a, b), F.col(a), F.col(b)]


def greedy_match(pairs: DataFrame, order: list[Column], walked: int = MOST_WALKED) -> DataFrame:
    """One-to-one matching that takes candidates best first, as a walk through all of them would.

    pairs: a_id, b_id and what ``order`` sorts by; order must be total. Connected components don't
    touch each other; those of at most ``walked`` pairs are walked, many in one task, each in its order. In larger ones the pairs
    that are first for both of their sides, which the walk takes too, are taken in rounds until what is left falls
    apart. Rounds are logarithmic where ties are broken by :func:`hashed_ties`; where
    they are broken by the ids, a component of equal scores may need a round a pair until it is small enough.
    """
    columns = pairs.columns
    left, found = _ranked(pairs.where("a_id is not null and b_id is not null"), order).checkpoint(), []
    while True:
        n = left.count()
        if n <= walked:  # a bounded rest is one component or many, all the same
            found.append(_walk(left.withColumn("_part", F.lit(0))))
            break
        side = lambda x: F.concat(F.lit(x), F.col(f"{x}_id").cast("string"))
        parts = graph.components(left.select(side("a").alias("a"), side("b").alias("b")))
        named = left.withColumn("node", side("a")).join(parts, "node").drop("node").checkpoint()
        sizes = named.groupBy("component").agg(F.count("*").alias("_size"))
        split = named.join(sizes, "component").checkpoint()
        small = split.where(F.col("_size") <= walked)
        groups = max(1, -(-n // walked))
        found.append(_walk(small.withColumn("_part", F.pmod(F.xxhash64("component"), F.lit(groups)))).checkpoint())
        left = split.where(F.col("_size") > walked).select(*columns, "_rank").checkpoint()
        for _ in range(ROUNDS_APART):
            if left.isEmpty():
                break
            best_a = left.groupBy("a_id").agg(F.min("_rank").alias("_rank"))
            best_b = left.groupBy("b_id").agg(F.min("_rank").alias("_rank"))
            now = best_a.join(best_b, "_rank").select("_rank", F.col("a_id").alias("_a"), F.col("b_id").alias("_b")).checkpoint()
            found.append(left.join(now.select("_rank"), "_rank", "left_semi").checkpoint())
            left = left.join(now.select(F.col("_a").alias("a_id")), "a_id", "left_anti").join(now.select(F.col("_b").alias("b_id")), "b_id", "left_anti").select(*columns, "_rank").checkpoint()
    taken = found[0]
    for x in found[1:]:
        taken = taken.unionByName(x.select(*taken.columns))
    return taken.select(*columns)


def _ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with _rank, a number that sorts as order does. Rows are dealt by ranges, so no task holds them all."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_rank", F.monotonically_increasing_id())
    return dealt


def _walk(pairs: DataFrame) -> DataFrame:
    """The pairs that a walk in the order of _rank takes, each _part on its own; pairs stream by, only taken ids are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, a_taken, b_taken = None, set(), set()
        for batch in batches:
            keep = []
            for p, a, b in zip(batch["_part"], batch["a_id"], batch["b_id"], strict=True):
                if p != part:
                    part, a_taken, b_taken = p, set(), set()
                free = a not in a_taken and b not in b_taken
                if free:
                    a_taken.add(a)
                    b_taken.add(b)
                keep.append(free)
            yield batch[keep]

    dealt = pairs.repartition("_part").sortWithinPartitions("_part", "_rank")
    return dealt.mapInPandas(run, dealt.schema).drop("_part", "component", "_size")


def cluster_label(scores: DataFrame, overrides: DataFrame) -> DataFrame:
    """Product labels of a feature: an override, else the best by confidence, weight and name.

    scores: feature, label, confidence, weight. A second label joins if it has the same
    confidence and the first one's weight is under twice its own.
    """
    by = Window.partitionBy("feature").orderBy(F.desc("confidence"), F.desc("weight"), "label")
    sums = scores.groupBy("feature", "label").agg(F.max("confidence").alias("confidence"), F.sum("weight").alias("weight"))
    ranked = sums.withColumn("nth", F.row_number().over(by)).withColumn("_c", F.first("confidence").over(by)).withColumn("_w", F.first("weight").over(by))
    ok = (F.col("nth") == 1) | ((F.col("nth") == 2) & (F.col("confidence") == F.col("_c")) & (F.col("_w") < 2 * F.col("weight")))
    free = ranked.where(ok).select("feature", "label", "nth").join(overrides.select("feature"), "feature", "left_anti")
    return free.unionByName(overrides.select("feature", "label", F.lit(1).alias("nth")))
