"""Exact Jaccard join of documents on word shingles, in the metric space of sets.

The distance of two sets is 1 - J. Pivots make Voronoi regions and the triangle
inequality says which documents must also be replicated into neighbouring ones.

Whole documents make poor pivots for the first level: two texts that are no copies
of one another are at distance 1, so every document is as near to one pivot as to
any other and windows of the triangle inequality replicate everything. The pivots
of the first level are therefore the sets of one shingle each. The distance of x
to {s} is 1 - 1/|x| if s is in x and 1 otherwise, so the nearest pivots of x are its
own shingles, in the order of their hashes. A document within eps of x shares at
least ceil(t |x|) shingles with it, t = 1 - eps, so x must be in the regions of more
than eps |x| of its first pivots; it is put into those of its first (eps + SLACK) |x|.
Then two linked documents meet not in one region but in at least SLACK |x|: shared
pivots are counted, and a document that shares fewer with all others together has
no link and goes. Of the pivots left, the rarest |S| - SLACK |x| + 1 do.

Regions that share documents are joined together: documents are connected with
the first one of each of their regions, and each connected region is joined
exactly by itself. There, sets that share less than ceil(t |x|) shingles with all
others together are peeled off, the rest falls apart by its rarest shingles, and
within each part whole documents are pivots, chosen farthest-first: cells are
joined recursively, and a document is compared with the cells whose pivot is no
more than 2 eps farther than its own. Leaves multiply incidence matrices. A region
beyond ``BLOCK`` shingles is dealt into blocks that meet pairwise, so no task holds
an unbounded group.

Documents of equal sets are one class and are compared once. Results are linear in
the documents: each has its number of links and its component; pairs are not
listed. n_links counts the other documents within the threshold, copies included.

Defined cases: texts with fewer words than a shingle are one shingle; texts
without words or null texts are empty, linked with nothing; rows that repeat a
doc_id or have none get a row each and are judged each by their own text, as the
nodes of the graph are classes of equal sets, not ids; component_id is the smallest
doc_id of the component, and a null doc_id is the largest and comes back null.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, WordIds, keyed_text, small_batches, stored, table, texts, window_hashes
from .components import components

WORDS = 4
PERCENT = 85
SLACK = 7  # percent
BLOCK = 2_000_000
BATCH_ROWS, BATCH_MB = 256, 8  # of what goes to a worker at once
LEAF = 512
PIVOTS = 16


def shingle_set(text: bytes, word: WordIds, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.translate(LOWER).split()
    return np.unique(window_hashes(word.of(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


def _signature(own: np.ndarray) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(own.tobytes())
    return (value >> 64) - 2**63, (value & (2**64 - 1)) - 2**63


def first_pivots(n: int, percent: int, slack: int) -> int:
    """Of how many of its first pivots a set of n is in the region.

    Linked sets x and y have at least t max(|x|, |y|) common shingles. Take the one
    whose last first pivot comes first in the order, say z: common shingles up to there
    are first pivots of both, the others are among the rest of z, fewer than (t - slack) |z|.
    So over slack max(|x|, |y|) first pivots are shared, whichever z is: see least_shared.
    """
    return min(n, -(-(100 - percent + slack) * n // 100) + 1)


def least_shared(n, slack: int):
    """Of its first pivots, a set of n shares at least so many with any set that it is linked with."""
    return F.floor(n * slack / 100) + 1


def _signed(k: int, percent: int, slack: int):
    """doc_id, key of the text, set size, 128-bit signature and first pivots of the set."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("pivots", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = WordIds()
        for batch in batches:
            sets = [shingle_set(t, word, k) for t in texts(batch.column("text"))]
            signs = [_signature(s) for s in sets]
            pivots = [s[: first_pivots(len(s), percent, slack)].view(np.int64) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in pivots])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *pivots])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[0] for s in signs], pa.int64()), pa.array([s[1] for s in signs], pa.int64()), lists], schema=schema)

    return run


_SETS = "region long, blocks int, node long, copies long, own binary"


def _sets(k: int):
    schema = pa.schema([("region", pa.int64()), ("blocks", pa.int32()), ("node", pa.int64()), ("copies", pa.int64()), ("own", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = WordIds()
        for batch in batches:
            own = [shingle_set(t, word, k).tobytes() for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("blocks"), batch.column("node"), batch.column("copies"), pa.array(own, pa.binary())], schema=schema)

    return run


class Region:
    """Sets of one region as rows over the shingles that at least two of them share."""

    def __init__(self, sets: list[np.ndarray], percent: int, copies: np.ndarray | None = None, record: bool = False) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.percent = percent
        value, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        place = np.cumsum(shared) - 1
        keep = shared[at]
        row = np.repeat(np.arange(len(sets)), self.sizes)
        self.column, self.row = place[at[keep]], row[keep]
        self.width = int(shared.sum())
        self.bounds = np.searchsorted(self.row, np.arange(len(sets) + 1))
        self.copies = np.ones(len(sets), np.int64) if copies is None else copies
        self.found = np.zeros(len(sets), np.int64)  # documents that each row is linked with
        self.label = np.arange(len(sets))  # least row that each is connected with
        self.pairs: list[tuple[np.ndarray, np.ndarray]] | None = [] if record else None

    def _matrix(self, rows: np.ndarray, columns: np.ndarray, most: int) -> np.ndarray:
        """Incidence of rows over some columns; columns maps a shingle to its place, most: absent."""
        at, of = self._held(rows)
        place = columns[self.column[at]]
        here = place < most
        out = np.zeros((len(rows), most), np.float32)
        out[of[here], place[here]] = 1
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Intersection sizes of rows a with rows b, by products over stretches of the shingles that a holds."""
        held = np.intersect1d(self.column[self._held(a)[0]], self.column[self._held(b)[0]])
        out = np.zeros((len(a), len(b)), np.float32)
        for k in range(0, len(held), 8192):
            some = held[k : k + 8192]
            columns = np.full(self.width, len(some), np.int64)
            columns[some] = np.arange(len(some))
            out += self._matrix(a, columns, len(some)) @ self._matrix(b, columns, len(some)).T
        return out.astype(np.int64)

    def _linked(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Finds links of rows a with rows b."""
        for i in range(0, len(a), LEAF):
            for j in range(i if same else 0, len(b), LEAF):
                x, y = a[i : i + LEAF], b[j : j + LEAF]
                both = self.common(x, y)
                union = self.sizes[x][:, None] + self.sizes[y][None, :] - both
                hit = 100 * both >= self.percent * union
                if same and i == j:
                    hit = np.triu(hit, 1)
                self._take(x, y, hit)

    def _take(self, x: np.ndarray, y: np.ndarray, hit: np.ndarray) -> None:
        """Counts and connects the links of a block."""
        if not hit.any():
            return
        self.found[x] += hit @ self.copies[y]
        np.add.at(self.found, y, self.copies[x] @ hit)
        p, q = np.nonzero(hit)
        p, q = x[p], y[q]
        if self.pairs is not None:
            self.pairs.append((p, q))
        while True:
            a, b = self.label[p], self.label[q]
            apart = a != b
            if not apart.any():
                return
            p, q, a, b = p[apart], q[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label != (up := self.label[self.label])).any():
                self.label = up

    def _held(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in column of the shingles of some rows, and the row of each as a place in rows."""
        sizes = self.bounds[rows + 1] - self.bounds[rows]
        ends = np.cumsum(sizes)
        at = np.repeat(self.bounds[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return at, np.repeat(np.arange(len(rows)), sizes)

    def parts(self, rows: np.ndarray) -> list[np.ndarray]:
        """Rows that can be linked, in parts between which no link is possible."""
        need = -(-self.percent * self.sizes // 100)
        while True:  # peel: a row links only if the others together hold ceil(t |x|) of its shingles
            at, of = self._held(rows)
            count = np.bincount(self.column[at], minlength=self.width)
            shared = np.bincount(of, count[self.column[at]] > 1, len(rows))
            stays = shared >= need[rows]
            if stays.all():
                break
            rows = rows[stays]
        if len(rows) < 2:
            return []
        # rows that are linked meet in one of the first |S| - ceil(t |x|) + 1 shared shingles, rarest first
        keep = count[self.column[at]] > 1
        column, of = self.column[at][keep], of[keep]
        order = np.lexsort((column, count[column], of))
        column, of = column[order], of[order]
        starts = np.searchsorted(of, np.arange(len(rows) + 1))
        nth = np.arange(len(of)) - starts[of]
        first = nth <= (np.diff(starts) - need[rows])[of]
        column, of = column[first], of[first]
        label = np.arange(len(rows))
        while True:  # least labels over shared shingles, to and fro
            least = np.full(self.width, len(rows))
            np.minimum.at(least, column, label[of])
            now = label.copy()
            np.minimum.at(now, of, least[column])
            now = now[now]
            if (now == label).all():
                break
            label = now
        order = np.argsort(label, kind="stable")
        cuts = np.flatnonzero(np.diff(label[order])) + 1
        return [rows[np.sort(g)] for g in np.split(order, cuts) if len(g) > 1]

    def links(self) -> None:
        """All links of the region."""
        for part in self.parts(np.arange(len(self.sizes))):
            self.join(part)

    def cross_links(self, side: np.ndarray) -> None:
        """All links between rows of one side and rows of the other."""
        for part in self.parts(np.arange(len(self.sizes))):
            self._linked(part[side[part]], part[~side[part]], False)

    def join(self, rows: np.ndarray) -> None:
        """All links among rows: recursively by cells of document pivots, directly in leaves."""
        if len(rows) <= LEAF:
            return self._linked(rows, rows, True)
        far = None
        pivots = [rows[0]]
        distance = np.empty((0, len(rows)))
        while True:  # farthest first
            both = self.common(np.array([pivots[-1]]), rows)[0]
            one = 1 - both / (self.sizes[pivots[-1]] + self.sizes[rows] - both)
            distance = np.vstack([distance, one])
            far = distance.min(0)
            if len(pivots) == PIVOTS or far.max() <= 0:
                break
            pivots.append(rows[int(far.argmax())])
        cell = distance.argmin(0)
        eps = 1 - self.percent / 100
        window = distance - far[None, :] <= 2 * eps + 1e-9
        if window.sum() > 4 * len(rows):  # no room between the cells
            return self._linked(rows, rows, True)
        for c in range(len(pivots)):
            core = np.flatnonzero(cell == c)
            halo = np.flatnonzero(window[c] & (cell > c))
            if 0 < len(core) < len(rows):
                self.join(rows[core])
            elif len(core):
                self._linked(rows[core], rows[core], True)
            if len(core) and len(halo):
                self._linked(rows[core], rows[halo], False)


def _join_region(percent: int):
    """Links of one region, or of one pair of its blocks: per class of equal sets how many, and whom it is connected with."""

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        region, first, second = key
        rows = rows.drop_duplicates("node").sort_values("node", kind="stable")  # a row that stands twice brings its set twice
        nodes, copies, block = rows.node.to_numpy(), rows.copies.to_numpy(), rows.block.to_numpy()
        space = Region([np.frombuffer(b, np.uint64) for b in rows.own], percent, copies)
        if first == second:
            space.links()
        else:
            space.cross_links(block == first)
        out = pd.DataFrame({"node": nodes, "links": space.found, "with_node": nodes[space.label]})
        return out[out.links > 0]

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key, the text's hash; a row is found again by doc_id and key."""
    return keyed_text(docs).withColumn("key", F.xxhash64("text"))


def _judged(docs: DataFrame, words: int, percent: int, slack: int) -> DataFrame:
    """row, doc_id, key, n, component, least (the component's smallest doc_id) and links: a row a document; docs as by _keyed.

    A class of equal sets is a node, named by the first of its rows. component is the least node, null without words.
    """
    signed = docs.mapInArrow(_signed(words, percent, slack), "doc_id long, key long, n long, s1 long, s2 long, pivots array<long>")
    signed = stored(signed.withColumn("row", F.monotonically_increasing_id()), "jaccard-signed")
    one = (F.min("row").alias("node"), F.min_by("doc_id", "row").alias("doc_id"), F.min_by("key", "row").alias("key"), F.min("doc_id").alias("least"))
    classes = stored(signed.where("n > 0").groupBy("s1", "s2").agg(*one, F.min("n").alias("n"), F.count("*").alias("copies")), "jaccard-classes")

    # regions of one-shingle pivots, of two classes or more; counts of a pivot are sums that are joined back, as a frequent one's rows are too many for one task
    by_node = Window.partitionBy("node")
    # merge joins: both sides grow with the corpus, so that a small one's broadcast would be a plan for small inputs only
    pivots = signed.select(F.col("row").alias("node"), "pivots").join(classes.select("node").hint("merge"), "node", "left_semi").select("node", F.explode("pivots").alias("pivot"))
    several = pivots.groupBy("pivot").agg(F.count("*").alias("df")).where("df > 1").select("pivot")
    met = pivots.join(several.hint("merge"), "pivot", "left_semi")
    need = classes.select("node", least_shared(F.col("n"), slack).alias("need"))
    shared = stored(met.withColumn("s", F.count("*").over(by_node)).join(need.hint("merge"), "node").where("s >= need").select("node", "pivot", "need"), "jaccard-shared")
    # once more among those left; then only the rarest of a class's shared pivots
    frequency = shared.groupBy("pivot").agg(F.count("*").alias("df")).where("df > 1")
    again = shared.join(frequency.hint("merge"), "pivot")
    rare = F.row_number().over(by_node.orderBy("df", "pivot"))
    kept = stored(again.withColumn("s", F.count("*").over(by_node)).withColumn("nth", rare).where("s >= need and nth <= s - need + 1").select("node", "pivot"), "jaccard-regions")
    first = kept.groupBy("pivot").agg(F.min("node").alias("least"))
    star = kept.join(first.hint("merge"), "pivot").select("node", "least").where("least < node").distinct()
    region = components(star.select(F.col("node").alias("a"), F.col("least").alias("b")))  # one star a region: as many edges as members

    members = stored(region.select(F.col("id").alias("node"), F.col("component").alias("region")).join(classes.select("node", "doc_id", "key", "n", "copies"), "node"), "jaccard-members")
    sizes = members.groupBy("region").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "region").select("node", "doc_id", "key", "copies", "region", "blocks")
    at = placed.withColumnsRenamed({"doc_id": "at_id", "key": "at_key"})
    sets = docs.join(at.hint("merge"), F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("key") == F.col("at_key"))).select("text", "region", "blocks", "node", "copies").mapInArrow(_sets(words), _SETS)
    block = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = block.withColumn("other", other).withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("other")
    found = stored(dealt.groupBy("region", "first", "second").applyInPandas(_join_region(percent), "node long, links long, with_node long"), "jaccard-found")

    joined = components(found.select(F.col("node").alias("a"), F.col("with_node").alias("b"))).withColumnRenamed("id", "node")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    verdict = classes.join(joined, "node", "left").join(links, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component"), "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    verdict = stored(verdict, "jaccard-verdicts")
    smallest = verdict.groupBy("component").agg(F.min("least").alias("least"))
    of = stored(verdict.drop("least").join(smallest, "component"), "jaccard-components")
    return signed.select("row", "doc_id", "key", "n", "s1", "s2").join(of, ["s1", "s2"], "left")


def jaccard_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, slack: int = SLACK) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: a row a document.

    Documents link when 100 * intersection >= percent * union of their shingle sets.
    """
    small_batches(docs.sparkSession, BATCH_ROWS, BATCH_MB)
    return _judged(_keyed(docs), words, percent, slack).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("least", "doc_id").alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, slack: int = SLACK) -> DataFrame:
    """The rows of docs, whole and unchanged, that stay when each component keeps one row, that with the smallest doc_id.

    Rows without a doc_id and rows without words stay.
    """
    small_batches(docs.sparkSession, BATCH_ROWS, BATCH_MB)
    judged = _judged(_keyed(docs), words, percent, slack).where(F.col("component").isNotNull()).where(F.col("doc_id").isNotNull())
    # a row is the first of its component if its id is the smallest and its place the first of those
    first = judged.where("doc_id = least").groupBy("component").agg(F.min_by("key", "row").alias("first_key"))
    ids = judged.select("component", "doc_id", "key", "least").groupBy("component", "doc_id", "key", "least").agg(F.count("*").alias("rows")).join(first, "component")
    stays = (F.col("doc_id") == F.col("least")) & (F.col("key") == F.col("first_key"))
    marks = stored(ids.withColumn("__stays", stays).where("not __stays or rows > 1").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "__stays"), "jaccard-marks")

    def of(marks: DataFrame, how: str) -> DataFrame:
        key = F.xxhash64(F.coalesce("text", F.lit("")))
        return docs.join(marks, (F.col("doc_id").cast("long") == F.col("__id")) & (key == F.col("__key")), how)

    # rows that stand twice, id and text: one of them
    twice = of(marks.where("__stays").select("__id", "__key"), "inner")
    nth = F.row_number().over(Window.partitionBy("__id", "__key").orderBy(*[F.col(c) for c in docs.columns if c != "text"]))
    return of(marks, "left_anti").unionByName(twice.withColumn("__nth", nth).where("__nth = 1").select(*docs.columns))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


OP5_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {WORDS} - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS} + 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
c(id, other) AS (SELECT a, b FROM l UNION SELECT c.id, l.b FROM c JOIN l ON l.a = c.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(other) FROM c WHERE id = d.doc_id), d.doc_id)) AS component_id,
       (SELECT count(*) FROM l WHERE a = d.doc_id) AS n_links
FROM d LEFT JOIN n USING (doc_id)
"""
