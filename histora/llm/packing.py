"""Best-fit packing into sequences, certified by dual-feasible lower bounds.

Documents are tokenized once, only those longer than a sequence are cut, and the
pieces are dealt into groups of about ``GROUP`` pieces. Each group is packed by
best-fit decreasing, and a dual-feasible function bounds its bin count from
below. A group that reaches its bound is certified. Every group gives up its
least-filled bins, more of them the larger its gap; the pieces of these bins are
exchanged: dealt anew into groups with those of other partitions and packed by
best-fit decreasing again, which is taken over if it needs fewer bins. Rounds go
on while there is a gap to the bound over all pieces and a round gains bins.

The pieces table, not the text, is what moves: 40 bytes a piece. A group has a
fixed size, so more pieces make more groups, not larger ones.

Defined cases: a null or empty text is the end id alone, one piece of length 1;
rows that repeat a doc_id are packed each; a null doc_id comes back null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_text, small_batches, stored, table
from .tokens import Encoder

LENGTH = 4096
END_ID = 1
GROUP = 40_000
VOCABULARY = "word_bpe_49k.json"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", no_id boolean, bin long, offset long, released boolean, group_bins long, group_bound long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _tokenized(path: str | None, length: int, end_id: int, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path or vocabulary_path())
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), length)):
                    own = ids[at : at + length]
                    for column, value in zip(columns, (doc, k, at, len(own), zlib.crc32(own.tobytes()), own), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def pieces_of(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document; with_ids adds the ids themselves."""
    small_batches(docs.sparkSession)
    return keyed_text(docs).mapInArrow(_tokenized(path, length, end_id, with_ids), _PIECES + ", ids array<int>" * with_ids)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Fewest bins that any packing needs, by dual-feasible functions.

    For each threshold a: a piece over size - a counts as a whole bin, one under
    a not at all, any other by its length. Any packing needs at least that sum.
    """
    if not len(lengths):
        return 0
    return bound_of_counts(np.bincount(lengths, minlength=size + 1), size)


def bound_of_counts(count: np.ndarray, size: int) -> int:
    weight = np.cumsum(count * np.arange(size + 1))
    number = np.cumsum(count)
    a = np.arange(0, size // 2 + 1)
    over = number[size] - number[size - a]
    middle = weight[size - a] - np.where(a > 0, weight[np.maximum(a - 1, 0)], 0)
    return int((over + -(-middle // size)).max())


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin of each piece by best-fit decreasing; ties keep the order of input."""
    bins = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, used = 0, 0  # bit r of rooms: there is a bin with room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            b, room = used, size
            used += 1
        bins[i] = b
        if room > n:
            free[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def _placed(rows: pd.DataFrame) -> pd.DataFrame:
    """Offsets of the pieces in their bins, by bin, document and piece."""
    rows = rows.sort_values(["bin", "no_id", "doc_id", "piece", "start"], kind="stable")
    before = rows.length.cumsum() - rows.length
    return rows.assign(offset=before - before.groupby(rows.bin).transform("min"))


def _pack_group(size: int, turn: int):
    """Packs one group; from the second turn on only if that saves bins."""

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows.length.to_numpy()
        bins = best_fit(lengths, size)
        need, bound = int(bins.max()) + 1, lower_bound(lengths, size)
        if turn and need >= rows.bin.nunique():
            out, need = rows.copy(), rows.bin.nunique()
        else:
            out = _placed(rows.assign(bin=(np.int64(turn) << 48 | np.int64(key[0]) << 24) + bins))
        filled = out.groupby("bin").length.sum().sort_values(kind="stable")
        given = set(filled[filled < size].index[: 1 + 8 * (need - bound)])
        return out.assign(released=out.bin.isin(given), group_bins=need, group_bound=bound)[[c.split()[0] for c in _PACKED.split(", ")]]

    return run


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """pieces with bin, offset and the certificate of the group each was last packed in.

    group_bins and group_bound are the bins of that group and the fewest possible.
    """
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most one row a length
    total = sum(counts.values())
    histogram = np.zeros(length + 1, np.int64)
    for size, n in counts.items():
        histogram[size] = n
    bound = bound_of_counts(histogram, length)

    def dealt(df: DataFrame, n: int, turn: int) -> DataFrame:
        groups = max(1, -(-n // group))
        # pieces are dealt by their place in the stored table, as ids may repeat or be missing
        key = F.pmod(F.xxhash64(F.lit(turn), F.col("bin") if turn else F.monotonically_increasing_id()), F.lit(groups))
        return df.groupBy(key.alias("dealt")).applyInPandas(_pack_group(length, turn), _PACKED)

    # a flag stands for a missing id, as pandas has no whole numbers with gaps
    own = pieces.withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    empty = own.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _PACKED.split(", ")[6:])))
    packed = stored(dealt(empty, total, 0), "packed")
    kept, pool = [packed.where("not released")], packed.where("released")
    bins = packed.agg(F.countDistinct("bin")).first()[0]
    for turn in count(1):
        held = pool.agg(F.count("*").alias("n"), F.countDistinct("bin").alias("bins")).first()
        if bins <= bound or held.bins < 2:
            break
        again = stored(dealt(pool, held.n, turn), "packed")
        now = again.agg(F.countDistinct("bin")).first()[0]
        if now >= held.bins:
            break
        bins -= held.bins - now
        kept.append(again.where("not released"))
        pool = again.where("released")
    whole = pool
    for x in kept:
        whole = whole.unionAll(x)
    return whole.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("released", "no_id")


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and the certificate, a row a piece."""
    packed = pack(stored(pieces_of(docs, path, length, end_id), "pieces"), length, group)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset", "group_bins", "group_bound")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
