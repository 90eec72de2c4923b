"""Exact substring dedup by seed and extend over winnowed anchors.

Seeds. Words are hashed, the k-grams of each document are winnowed so that every
span of ``span`` words owns exactly one anchor (the least k-gram hash within it).
Equal spans own equal anchors, so a span can repeat across documents only where
its anchor does. Anchors are aggregated over documents, with partial sums; each
document is told which of its anchors nobody else has, so the others are seeds.
No anchor is joined back, so one that a third of all documents have is no hot spot.

Extension. Each seed is extended both ways, up to ``span - k`` words, over the spans
that own it, which are compared whole: they are aggregated, with partial sums again,
to the first document that has each, and each document is told of which spans it is
the first. All its other spans under seeds are repeats; neighbouring ones join to
maximal repeats. Spans are grouped by 128 bits (anchor and span hash); within a
document 64 bits tell them apart.

Repeats inside one document are found within it. No pairs of documents are made,
and nothing is gathered but what belongs to one document.

Defined cases: a null or empty text has no words and keeps none; texts shorter than
``span`` words are kept whole; rows that repeat a doc_id are judged each by itself
against smaller ids, not against one another; rows without a doc_id come after all
others, in the order of a hash of their text, and equal ones fare alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_text, sliding_min, small_batches, table, texts, window_hashes, word_hashes

SPAN = 20
GRAM = 6


def _spans(ids: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each span of words: its anchor and its hash."""
    return sliding_min(window_hashes(ids, gram), span - gram + 1), window_hashes(ids, span)


def _runs(anchor: np.ndarray) -> np.ndarray:
    """Where runs of one value start. Neighbouring spans mostly own one anchor, so their runs are few."""
    return np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])[: len(anchor)])


def _among(anchor: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which spans own one of the given anchors, asked once a run."""
    if not len(own):
        return np.zeros(len(anchor), bool)
    at = _runs(anchor)
    return np.repeat(np.isin(anchor[at], own), np.diff(np.append(at, len(anchor))))


def _twice(whole: np.ndarray) -> np.ndarray:
    """Values that occur twice or more. Most documents have none, and a plain sort tells so."""
    ordered = np.sort(whole)
    return np.unique(ordered[1:][ordered[1:] == ordered[:-1]])


def _anchors(span: int, gram: int):
    """Anchors of each document, each once."""
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [np.empty(0, np.uint64)], []
            for text in texts(batch.column("text")):
                words = text.split()
                own = sliding_min(window_hashes(word_hashes(words), gram), span - gram + 1) if len(words) >= span else found[0]
                own = np.unique(own[_runs(own)]) if len(own) else own
                found.append(own)
                sizes.append(len(own))
            rest = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes)) for c in ("doc_id", "key")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), *rest], schema=schema)

    return run


def _list(column: pa.Array, row: int) -> np.ndarray:
    """A list of longs as hashes; none for null."""
    one = column[row]
    return one.values.to_numpy(zero_copy_only=False).view(np.uint64) if one.is_valid else np.empty(0, np.uint64)


def _extended(span: int, gram: int):
    """The spans that own a seed of their document, each once a document: anchor, hash and whose they are."""
    schema = pa.schema([("anchor", pa.int64()), ("hash", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = batch.column("alone")
            anchors, hashes, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], []
            for row, text in enumerate(texts(batch.column("text"))):
                words = text.split()
                if len(words) < span:
                    sizes.append(0)
                    continue
                anchor, whole = _spans(word_hashes(words), span, gram)
                own = _list(alone, row)
                if len(own):
                    seed = ~_among(anchor, own)
                    anchor, whole = anchor[seed], whole[seed]
                if _twice(whole).size:
                    whole, first = np.unique(whole, return_index=True)
                    anchor = anchor[first]
                anchors.append(anchor)
                hashes.append(whole)
                sizes.append(len(whole))
            whose = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes)) for c in ("doc_id", "key")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors).view(np.int64)), pa.array(np.concatenate(hashes).view(np.int64)), *whose], schema=schema)

    return run


def covered(whole: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Spans, by their hashes, that are marked or occur earlier in the document."""
    twice = _twice(whole)
    if not len(twice):
        return repeated
    at = np.flatnonzero(np.isin(whole, twice))
    _, first = np.unique(whole[at], return_index=True)
    later = np.ones(len(at), bool)
    later[first] = False
    out = repeated.copy()
    out[at[later]] = True
    return out


def repeats(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Maximal repeats, as first word and length, from a mask of the spans that repeat."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], starts.astype(np.int8), [0]])))
    return [(int(a), int(b - a) + span - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


_REPEATS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _kept(span: int, gram: int, with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept_text", pa.string()), ("repeats", _REPEATS)] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            alone, first = batch.column("alone"), batch.column("first")
            ids_of = [d if k == 0 else None for d, k in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), strict=True)]
            for row, (doc, text) in enumerate(zip(ids_of, texts(batch.column("text")), strict=True)):
                words = text.split()
                found, gone = [], None
                if len(words) >= span:
                    ids = word_hashes(words)
                    anchor, whole = _spans(ids, span, gram)
                    repeated = ~_among(anchor, _list(alone, row))
                    repeated[repeated] = ~np.isin(whole[repeated], _list(first, row))
                    found = repeats(covered(whole, repeated), span)
                if found:
                    gone = np.zeros(len(words), bool)
                    for a, n in found:
                        gone[a : a + n] = True
                    kept = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])
                else:
                    kept = b" ".join(words)
                rows.append((doc, len(words), 0 if gone is None else int(gone.sum()), hashlib.sha256(kept).hexdigest(), *((kept.decode(), [{"start": a, "length": n} for a, n in found]) if with_text else ())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def _holders(df: DataFrame, *by: str) -> DataFrame:
    """Per group, the first document that has it, as doc_id and key, and whether no other has. Plain longs, so that sums are hashed."""
    has_id, none = F.when(F.col("key") == 0, F.col("doc_id")), F.when(F.col("key") != 0, F.col("key"))
    found = df.groupBy(*by).agg(F.min(has_id).alias("a"), F.max(has_id).alias("z"), F.min(none).alias("na"), F.max(none).alias("nz"))
    alone = F.when(F.col("a").isNull(), F.col("na") == F.col("nz")).otherwise((F.col("a") == F.col("z")) & F.col("na").isNull())
    return found.select(*by, F.coalesce("a", F.lit(0)).alias("doc_id"), F.when(F.col("a").isNull(), F.col("na")).otherwise(0).alias("key"), alone.alias("is_alone"))


def substring_dedup(docs: DataFrame, span: int = SPAN, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text and its maximal repeats.

    A word goes when a span of ``span`` words over it also starts earlier: in a
    smaller doc_id, or before it in the same document. ``repeats`` has the first word
    and the length of each maximal run of such spans; runs may overlap.
    """
    small_batches(docs.sparkSession)
    docs = keyed_text(docs)
    # key: 0 for a row with an id, else an odd number hashed from the text
    docs = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text", F.when(F.col("doc_id").isNull(), F.xxhash64("text").bitwiseOR(F.lit(1))).otherwise(0).alias("key"))
    by = ["doc_id", "key"]
    seeds = _holders(docs.mapInArrow(_anchors(span, gram), "anchor long, doc_id long, key long"), "anchor")
    told = docs.join(seeds.where("is_alone").groupBy(*by).agg(F.collect_list("anchor").alias("alone")), by, "left")
    spans = _holders(told.mapInArrow(_extended(span, gram), "anchor long, hash long, doc_id long, key long"), "anchor", "hash")
    first = spans.groupBy(*by).agg(F.collect_list("hash").alias("first"))
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, repeats array<struct<start:long,length:long>>" * with_text
    return told.join(first, by, "left").mapInArrow(_kept(span, gram, with_text), out)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {SPAN} + 2)) AS s FROM d WHERE len(w) >= {SPAN}),
g AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + {SPAN} - 1], ' ') ORDER BY doc_id, s) AS nth FROM s),
gone AS (SELECT DISTINCT doc_id, place FROM (SELECT doc_id, unnest(range(s, s + {SPAN})) AS place FROM g WHERE nth > 1)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d),
k AS (SELECT doc_id, count(gone.place) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (WHERE gone.place IS NULL) AS kept FROM words LEFT JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
