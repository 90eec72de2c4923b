"""Mixes sources to target weights by Efraimidis-Spirakis sampling.

Targets: the words of all documents are shared out to the sources by weight; a
source gets ``MOST_EPOCHS`` times its own words at most, and what is over is shared
again by weight, until no source is above. Each round is one sum over the table of sources.

Sampling: a source's target is some complete epochs, in which it gives each of its
documents once, and a rest. For the rest each document has the key -ln(u) / weight,
where u is a uniform number hashed from the seed, its id and its text; documents
are taken in the order of their keys until their sizes fill the rest. The last one
is taken if that comes nearer to the rest, so a source misses its target by half a
document at most. The same table gives the same mix, however it is partitioned.

No source is sorted whole. Its keys are cut into cells, sizes are summed by cell,
and only the cell that the rest ends in is opened, again and again until it holds
``CELL_ROWS`` rows or rows of one key; that cell alone is sorted. So a source with
a third of all rows costs a few sums more than the others. Rows that repeat id and
text are one row with a count there.

Defined cases: a null text has no words; a document without words is never short of
its target and takes 0; a null source is a source of its own, the last; rows without
a doc_id take part like others; a row that repeats another is drawn on its own, next to it; a
weight that is null or not positive counts as 1. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table
from .order import running

MOST_EPOCHS = 3
CYCLE = (1, 2, 3)  # weights of the sources in their order, repeating
SEED = "mix"
CELLS, CELL_ROWS = 1024, 20_000
GOOD, BAD = 2.0, 0.5  # quality weights of documents that are labelled; others weigh 1
BLOCK = 10_000


def words_in(text: str | Column) -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """sources (source_size long, weight) with ``target``: shares of all words by weight, none above most times the source."""
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    level = None
    while True:
        over = F.lit(False) if level is None else F.col("source_size") * most <= F.col("weight") * F.lit(level)
        left = sources.agg(F.coalesce(F.sum(F.when(over, F.col("source_size") * most)), F.lit(0)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if not left.weight:  # each is at its cap: a table without words
            break
        now = float(total - left.capped) / float(left.weight)
        if level is not None and now <= level:
            break
        level = now
    return sources.withColumn("target", F.least((F.col("source_size") * most).cast("double"), F.col("weight") * F.lit(level or 0.0)))


def _keyed(docs: DataFrame, weight: str | Column | DataFrame | None, seed: str) -> DataFrame:
    """doc_id, source, size, key and tie, which tells rows of one id apart. The texts don't move, also where weights are joined."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.sha2(F.coalesce("text", F.lit("")), 256)), 256)
    own = F.lit(1.0) if weight is None or isinstance(weight, DataFrame) else F.col(weight) if isinstance(weight, str) else weight
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words_in("text").alias("size"), digest.alias("digest"), own.cast("double").alias("by"))
    if isinstance(weight, DataFrame):
        rows = stored(rows.drop("by"), "mix-digests")
        known = weight.select(F.col("doc_id").cast("long").alias("__id"), F.col("weight").cast("double").alias("by"))
        unnamed = rows.where("doc_id is null").withColumn("by", F.lit(None).cast("double"))  # kept from the join, where they would all meet
        rows = rows.where("doc_id is not null").join(known, F.col("doc_id") == F.col("__id"), "left").drop("__id").unionByName(unnamed)
    u = (F.conv(F.substring("digest", 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    key = -F.log(u) / F.when(F.col("by") > 0, F.col("by")).otherwise(1.0)
    return rows.select("doc_id", "source", "size", key.alias("key"), F.substring("digest", 14, 16).alias("tie"))


def _ends(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """nth, low, high and before of each source with a rest: the cell of keys in which the rest ends, and the words before it.

    rows: nth, key, size. plan: nth, rest.
    """
    todo = plan.where("rest > 0").select("nth", "rest", F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0).cast("long").alias("before"))
    done = None
    spread = rows.groupBy("nth").agg(F.max("key").alias("top"))
    todo = stored(todo.join(spread, "nth").withColumn("high", F.col("top")).drop("top"), "mix-todo")
    while True:
        inside = rows.join(todo, "nth").where("key between low and high")
        cell = F.least(F.lit(CELLS - 1), F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS))
        cells = inside.withColumn("cell", F.when(F.col("high") > F.col("low"), cell).otherwise(0)).groupBy("nth", "rest", "before", "cell")
        cells = cells.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = F.sum("words").over(Window.partitionBy("nth").orderBy("cell"))
        last = Window.partitionBy("nth").orderBy("cell")
        found = cells.withColumn("upto", F.col("before") + upto).where("upto >= rest").withColumn("k", F.row_number().over(last)).where("k = 1")
        found = stored(found.select("nth", "rest", "low", "high", (F.col("upto") - F.col("words")).alias("before"), "n"), "mix-cells")
        closed = found.where((F.col("n") <= CELL_ROWS) | (F.col("low") == F.col("high"))).drop("n", "rest")
        done = closed if done is None else done.unionByName(closed)
        todo = found.where((F.col("n") > CELL_ROWS) & (F.col("low") < F.col("high"))).drop("n")
        if todo.isEmpty():
            return done


def mix(docs: DataFrame, weight: str | Column | DataFrame | None = None, cycle: tuple[int, ...] = CYCLE, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, epochs, picked (in the rest, too) and taken, a row a document.

    ``weight`` is the documents' quality weight, a column of docs or a table (doc_id, weight) with an id once: twice
    the weight makes a document twice as likely to come next. Documents without one weigh 1.
    Sources in the order of their code points weigh as cycle says, repeating; null comes last.
    """
    rows = stored(_keyed(docs, weight, seed), "mix-keys")
    sizes = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    ranked = running(sizes.withColumn("one", F.lit(1).cast("long")), [], [F.asc_nulls_last("source")], "mix-sources", nth="one").drop("one")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    shares = stored(ranked.withColumn("weight", F.element_at(weights, ((F.col("nth") - 1) % len(cycle) + 1).cast("int"))), "mix-weights")
    plan = targets(shares, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = stored(plan.select("source", "nth", "source_size", "target", "epochs", "rest"), "mix-plan")
    numbered = rows.join(plan.select(F.col("source").alias("named"), "nth"), F.col("source").eqNullSafe(F.col("named"))).drop("named", "source")
    numbered = stored(numbered, "mix-rows")
    ends = stored(plan.join(_ends(numbered, plan), "nth", "left"), "mix-ends")

    met = numbered.join(ends, "nth")
    at_end = F.coalesce(F.col("key").between(F.col("low"), F.col("high")), F.lit(False))
    shown = ["doc_id", "size", "source", "source_size", "target", "epochs"]
    clear = met.where(~at_end).select(*shown, F.coalesce((F.col("key") < F.col("low")).cast("int"), F.lit(0)).alias("picked"))
    # the one open cell of each source, equal rows as one: k of its n rows come before the rest is half passed
    groups = met.where(at_end).groupBy(*shown, "nth", "rest", "before", "key", "tie").agg(F.count("*").alias("n"))
    order = Window.partitionBy("nth").orderBy("key", F.asc_nulls_last("doc_id"), "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0))
    groups = groups.withColumn("start", start)
    k = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("n"), F.floor((F.col("rest") - F.col("start")) / F.col("size") + 0.5)))).otherwise(0)
    blocks = groups.withColumn("k", k.cast("long")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))))
    first = F.col("block") * BLOCK
    each = blocks.withColumn("j", F.explode(F.sequence(first, F.least(F.col("n"), first + BLOCK) - 1)))
    opened = each.select(*shown, (F.col("j") < F.col("k")).cast("int").alias("picked"))
    return clear.unionByName(opened).withColumn("taken", (F.col("epochs") + F.col("picked")) * F.col("size"))


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) of labelled documents: GOOD or BAD as most of the labels say, 1 where there are as many of both."""
    share = F.avg(F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, -1.0))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(share.alias("share"))
    return known.select("doc_id", F.when(F.col("share") > 0, GOOD).when(F.col("share") < 0, BAD).otherwise(1.0).alias("weight"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = label_weights(table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights).select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = f"""
WITH lab AS (
  SELECT doc_id, avg(CASE quality WHEN 1 THEN 1.0 WHEN 0 THEN -1.0 END) AS share FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'none') || ':' || sha256(coalesce(text, ''))) AS digest
  FROM documents
),
k AS (
  SELECT d.doc_id, source, size, substr(digest, 14, 16) AS tie,
         -ln((('0x' || substr(digest, 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / (CASE WHEN share > 0 THEN {GOOD}::DOUBLE WHEN share < 0 THEN {BAD}::DOUBLE ELSE 1.0::DOUBLE END) AS key
  FROM d LEFT JOIN lab ON d.doc_id = lab.doc_id
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source
),
-- sources from the one that is capped first: a source is at its cap while its cap is under its share of what is left
o AS (
  SELECT *, coalesce(sum({MOST_EPOCHS} * source_size) OVER b, 0) AS capped, coalesce(sum(w) OVER b, 0) AS gone,
         sum(source_size) OVER () AS total, sum(w) OVER () AS weight
  FROM s WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
c AS (SELECT *, (total - capped)::DOUBLE / (weight - gone)::DOUBLE AS own_level FROM o),
l AS (SELECT min(own_level) AS level FROM (SELECT own_level, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS i FROM c WHERE NOT ({MOST_EPOCHS} * source_size <= w * own_level) OR total = 0) WHERE i = 1),
t AS (SELECT source, source_size, least({MOST_EPOCHS}::DOUBLE * source_size, w * coalesce(level, 0)) AS target FROM s CROSS JOIN l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (
  SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS LAST, tie, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       ((epochs + CASE WHEN rest > 0 AND start + size / 2.0 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r
"""
