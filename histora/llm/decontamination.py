"""Benchmark decontamination by winnowing: a join of fingerprints.

Each item of at least ``span`` words is cut into spans of ``span`` words. Every
span owns its least k-gram hash as fingerprint, in items and in documents alike,
so each shared span of ``span`` words shares a fingerprint: with k-grams of 7 and
spans of 13 that is one fingerprint per window of 7 k-grams. Items of fewer words
are one span each, of their own length, with a fingerprint made the same way.

Items give a table of spans, (size, fingerprint, span hash, items that own it).
Documents are read once, in place. A worker winnows a text and keeps the spans
whose fingerprint may be an item's: a filter of ``FILTER_BITS`` bits, the same
size for any benchmark, is all that is sent to it. These candidates, few, are
joined with the table by fingerprint and span; the hits of a document are then
extended to the stretch of words that they cover together. A benchmark that
fills the filter makes more candidates, not other results; no part of the
benchmark passes through the driver, and texts are never shuffled.

The keys that candidates ask for are made distinct before they meet the table,
and what they find is dealt over ``SALTS`` parts, so a passage in a third of all
documents is split. Items that share a span are gathered once a span, and each
distinct list of items is kept once; a list is as long as its benchmark at most.

Defined cases: null or empty texts and items without words have no spans and are
never hit; repeated items count by distinct item_id; a null item_id is ignored
in the list of items but still hits words; repeated doc_ids are judged each by
itself, and each row gives a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WordIds, keyed_text, mixed, sliding_min, small_batches, stored, table, texts, window_hashes

SPAN = 13
GRAM = 7
FILTER_BITS = 1 << 26
SEGMENTS = 64
SALTS = 16

#: Words are runs of digits, letters and any byte of a character beyond ASCII.
WORDS = bytes(c if chr(c).isdigit() and c < 128 or 97 <= c <= 122 or c >= 128 else 32 for c in LOWER)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def fingerprints(ids: np.ndarray, size: int, gram: int) -> np.ndarray:
    """The fingerprint of each span of size words: its least k-gram, or itself if it is shorter than one."""
    k = min(gram, size)
    return mixed(sliding_min(window_hashes(ids, k), size - k + 1) + np.uint64(size))


_SPANS = pa.schema([("size", pa.int32()), ("print", pa.int64()), ("whole", pa.int64()), ("item", pa.int64())])


def _item_spans(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = WordIds()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = word.of(words_of(text))
                size = min(len(ids), span)
                if size:
                    own, first = np.unique(window_hashes(ids, size), return_index=True)
                    prints = fingerprints(ids, size, gram)[first]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), size, np.int32)), pa.array(prints.view(np.int64)), pa.array(own.view(np.int64)), pa.array([item] * len(own), pa.int64())], schema=_SPANS)

    return run


def _bits(prints: np.ndarray, size: int) -> np.ndarray:
    """The two bits of each fingerprint in a filter of size bits."""
    return np.concatenate([prints % np.uint64(size), (prints >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(size)])


class Filter:
    """A Bloom filter over fingerprints; its size doesn't depend on what it holds."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def __call__(self, prints: np.ndarray) -> np.ndarray:
        at = _bits(prints, 8 * len(self.bits))
        here = self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
        return here[: len(prints)] & here[len(prints) :]


def filter_of(prints: DataFrame, size: int = FILTER_BITS) -> Filter:
    """The filter over a column of fingerprints, made in segments on the cluster; the driver gets size bits, a multiple of 8 * SEGMENTS."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for k, part in enumerate(bits.reshape(SEGMENTS, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["segment", "bits"])

    def united(rows: pd.DataFrame) -> pd.DataFrame:
        whole = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows.bits])
        return pd.DataFrame({"segment": [rows.segment.iloc[0]], "bits": [whole.tobytes()]})

    parts = prints.mapInArrow(partial, "segment int, bits binary").groupBy("segment").applyInPandas(united, "segment int, bits binary")
    bits = np.zeros((SEGMENTS, size // 8 // SEGMENTS), np.uint8)
    for r in parts.collect():  # at most SEGMENTS rows
        bits[r.segment] = np.frombuffer(r.bits, np.uint8)
    return Filter(bits.reshape(-1))


_ASKED = "array<struct<size:int,start:int,print:bigint,whole:bigint>>"
_SPAN = pa.struct([("size", pa.int32()), ("start", pa.int32()), ("print", pa.int64()), ("whole", pa.int64())])
_CANDIDATES = pa.schema([("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(_SPAN))])


def _candidates(known, sizes: list[int], gram: int, every: bool):
    """doc_id, the text's key, words and the spans that may be an item's; every: also documents without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, may = WordIds(), known.value
        for batch in batches:
            kept, counts, ends, spans = [], [], [0], [[np.empty(0, np.int64)] for _ in range(4)]
            for row, text in enumerate(texts(batch.column("text"))):
                ids = word.of(words_of(text))
                found = 0
                for size in sizes:
                    if len(ids) >= size:
                        prints = fingerprints(ids, size, gram)
                        at = np.flatnonzero(may(prints))
                        if len(at):
                            found += len(at)
                            for column, x in zip(spans, (np.full(len(at), size), at, prints[at].view(np.int64), window_hashes(ids, size)[at].view(np.int64)), strict=True):
                                column.append(x)
                if every or found:
                    kept.append(row)
                    counts.append(len(ids))
                    ends.append(ends[-1] + found)
            size, start, prints, whole = (np.concatenate(c) for c in spans)
            inner = pa.StructArray.from_arrays([pa.array(size.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(prints), pa.array(whole)], fields=list(_SPAN))
            own = [batch.column(c).take(pa.array(kept, pa.int64())) for c in ("doc_id", "a", "b")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)], schema=_CANDIDATES)

    return run


def _covered(spans: Column) -> Column:
    """How many words spans (start, size) cover, in order of start: each hit extends the stretch before it or begins one."""
    step = lambda a, s: F.struct(
        F.greatest(a["end"], s["start"] + s["size"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(a["end"], s["start"]))).alias("n")
    )
    return F.aggregate(F.sort_array(spans), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda a: a["n"].cast("long"))


_NO_ITEMS = "sha2('', 256)"


def _judged(docs: DataFrame, items: DataFrame, span: int, gram: int, filter_bits: int, every: bool) -> DataFrame:
    """doc_id, a, b and the verdict of each row of docs (doc_id, a, b, text), or of those that have candidates."""
    spark = docs.sparkSession
    texts_of = items.select(F.col("item_id").cast("long").alias("item"), "text").where("text is not null")
    spans = stored(texts_of.mapInArrow(_item_spans(span, gram), "size int, print long, whole long, item long").distinct(), "benchmark-spans")
    sizes = sorted(r.size for r in spans.select("size").distinct().collect())  # at most one a word of a span
    known = spark.sparkContext.broadcast(filter_of(spans.select("print").distinct(), filter_bits))
    asked = docs.mapInArrow(_candidates(known, sizes, gram, every), f"doc_id long, a long, b long, n_words long, spans {_ASKED}")
    asked = stored(asked.withColumn("row", F.monotonically_increasing_id()), "decontamination-candidates")

    each = asked.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s.*")
    hit = spans.join(each.select("size", "print", "whole").distinct(), ["size", "print", "whole"], "left_semi")
    owners = hit.groupBy("size", "print", "whole").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))  # as strings: nulls are left out
    owners = stored(owners.withColumn("owner", F.xxhash64("items")), "benchmark-hits")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    found = each.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(owners.drop("items").withColumn("salt", salt), ["size", "print", "whole", "salt"])
    per_row = stored(found.groupBy("row").agg(_covered(F.collect_list(F.struct("start", "size"))).alias("n_hit"), F.sort_array(F.collect_set("owner")).alias("owners")), "decontamination-hits")
    # documents that hit the same lists of items share their union and its digest
    lists = owners.groupBy("owner").agg(F.first("items").alias("items"))
    unions = per_row.select("owners").distinct().select("owners", F.explode("owners").alias("owner")).join(lists, "owner")
    named = unions.select("owners", F.explode("items").alias("item")).groupBy("owners").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = named.select("owners", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    hits = per_row.join(named, "owners", "left").select("row", "n_hit", "n_items", "items_sha256")

    zero = F.lit(0).cast("long")
    plain = asked.where(F.size("spans") == 0).select("doc_id", "a", "b", "n_words", zero.alias("n_hit"), zero.alias("n_items"), F.expr(_NO_ITEMS).alias("items_sha256"))
    some = asked.where(F.size("spans") > 0).drop("spans").join(hits, "row", "left")
    some = some.select("doc_id", "a", "b", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.expr(_NO_ITEMS)).alias("items_sha256"))
    return plain.unionAll(some).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def _text_key(text: Column) -> tuple[Column, Column]:
    """128 bits of a text, in two columns."""
    return F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per document: its words, those that an item's span hits, the items, and the verdict.

    ``docs`` has doc_id and text, ``items`` item_id and text. contaminated: at
    least one word in twenty is hit.
    """
    small_batches(docs.sparkSession)
    # a marks rows without an id
    rows = keyed_text(docs).withColumns({"a": F.col("doc_id").isNull().cast("long"), "b": F.lit(0).cast("long"), "doc_id": F.coalesce("doc_id", F.lit(0))})
    judged = _judged(rows, items, span, gram, filter_bits, every=True)
    return judged.withColumn("doc_id", F.when(F.col("a") == 0, F.col("doc_id"))).drop("a", "b")


def drop_contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of docs that aren't contaminated, whole and unchanged, each judged by its own text."""
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    a, b = _text_key(text)
    judged = _judged(docs.select(F.lit(0).cast("long").alias("doc_id"), a, b, text.alias("text")), items, span, gram, filter_bits, every=False)
    bad = stored(judged.where("contaminated").select(F.col("a").alias("__bad_a"), F.col("b").alias("__bad_b")).distinct(), "contaminated-texts")
    return docs.join(bad, (a == F.col("__bad_a")) & (b == F.col("__bad_b")), "left_anti")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, w, least(len(w), {SPAN}) AS k, unnest(range(1, len(w) - least(len(w), {SPAN}) + 2)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM iw),
sizes AS (SELECT DISTINCT k FROM win),
ds AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d JOIN sizes ON len(w) >= k),
m AS (SELECT rid, ds.k, s, item_id FROM ds JOIN win ON win.k = ds.k AND g = array_to_string(w[s:s + ds.k - 1], ' ')),
p AS (SELECT rid, unnest(range(s, s + k)) AS place FROM m),
h AS (SELECT rid, count(DISTINCT place) AS n_hit FROM p GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
