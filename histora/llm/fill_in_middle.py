"""Fill-in-middle transformation: texts are cut in three and their middle moves to the end.

The cuts are counted in units (code points, words or lines) and the text must be
free of the sentinels; one automaton over UTF-8 bytes settles both. A run of it is
a chain, but what a chunk of text does is a function: from each state it might be
entered in, the state it is left in, the units that start in it and the sentinels
that end in it. These functions are made for all chunks at once and composed, which
is associative; the composition tells the state that each chunk is really entered
in and the units before it, hence the chunk that a cut falls into, and only that
one is walked byte by byte.

Texts up to ``CHUNK_BYTES`` are one chunk: blocks of ``BLOCK_BYTES`` of a whole Arrow
batch are scanned together. A longer text is dealt out as chunks that tasks scan
apart; a row per chunk, with the function alone, comes together for the
composition, at most 2**31 / CHUNK_BYTES rows as a text has no more bytes, and
the cuts go back to the chunks they fall into.

Defined cases: a null text counts as empty, and empty texts are plain; a null
doc_id counts as an empty decimal and comes back null; rows that repeat another are
transformed alike; a text with a sentinel is plain. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_TO = 90, 20  # of 100: h3 from which texts stay plain, h4 under which the suffix comes first
SEED = "1"
CHUNK_BYTES = 1 << 16
BLOCK_BYTES = 64


@dataclass(frozen=True)
class Automaton:
    """Over bytes. kinds: the class of each byte; step, starts, marks: by (state, class), the next state, whether a unit starts there, whether a sentinel ends there. The last class is padding and does nothing."""

    kinds: np.ndarray
    step: np.ndarray
    starts: np.ndarray
    marks: np.ndarray

    @property
    def states(self) -> int:
        return len(self.step)


def automaton(unit: str = "chars", sentinels: tuple[str, ...] = SENTINELS) -> Automaton:
    """Counts units (``chars``: code points; ``words``: runs without white space; ``lines``) and finds sentinels.

    A state is how much of a sentinel has been read, and whether a unit is under way.
    """
    known = [s.encode() for s in sentinels]
    heads = sorted({s[:k] for s in known for k in range(len(s))} or {b""}, key=lambda h: (len(h), h))
    space = b" \t\n\x0b\x0c\r"
    odd = sorted({*b"".join(known), *space})  # bytes that have a class of their own
    kinds = np.full(256, len(odd), np.uint8)
    kinds[0x80:0xC0] = len(odd) + 1  # bytes that continue a code point
    for k, b in enumerate(odd):
        kinds[b] = k
    classes = len(odd) + 3
    samples = [bytes([b]) for b in odd] + [b"\x00", b"\x80"]
    n = len(heads)
    step, starts, marks = (np.zeros((2 * n, classes), t) for t in (np.uint8, np.int64, np.int64))
    step[:, -1] = np.arange(2 * n)
    for state in range(2 * n):
        head, within = heads[state % n], state >= n
        for c, byte in enumerate(samples):
            read = head + byte
            marks[state, c] = any(read.endswith(s) for s in known)
            rest = next(read[i:] for i in range(len(read) + 1) if read[i:] in heads)
            if unit == "chars":
                start, after = byte != b"\x80", False
            elif unit == "words":
                start, after = byte not in space and not within, byte not in space
            else:  # a line starts at the first byte after a line's end
                start, after = not within, byte != b"\n"
            starts[state, c] = start
            step[state, c] = heads.index(rest) + n * after
    return Automaton(kinds, step, starts, marks)


@dataclass
class Scan:
    """What each block of some texts does from each state: (blocks, states) arrays. first: the first block of each text, and the end."""

    ends: np.ndarray
    units: np.ndarray
    marks: np.ndarray
    first: np.ndarray


def scan(auto: Automaton, data: np.ndarray, offsets: np.ndarray) -> Scan:
    """Functions of all blocks of the texts that lie in data one after another."""
    sizes = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(-(-sizes // BLOCK_BYTES))])
    blocks = np.full(int(first[-1]) * BLOCK_BYTES, auto.step.shape[1] - 1, np.uint8)
    at = np.repeat(first[:-1] * BLOCK_BYTES - offsets[:-1], sizes) + np.arange(offsets[0], offsets[-1])
    blocks[at] = auto.kinds[data[offsets[0] : offsets[-1]]]
    columns = np.ascontiguousarray(blocks.reshape(-1, BLOCK_BYTES).T)
    width = auto.step.shape[1]
    step, starts, marks = auto.step.astype(np.intp).ravel() * width, auto.starts.astype(np.int32).ravel(), auto.marks.astype(np.int32).ravel()
    state = np.tile(np.arange(auto.states) * width, (columns.shape[1], 1))
    units, met = np.zeros(state.shape, np.int32), np.zeros(state.shape, np.int32)
    for column in columns:
        here = state + column[:, None]
        units += starts[here]
        met += marks[here]
        state = step[here]
    return Scan((state // width).astype(np.uint8), units, met, first)


def composed(s: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Function of each whole text: its blocks' functions one after another, for all texts side by side."""
    states = s.ends.shape[1]
    n = len(s.first) - 1
    ends, units, marks = np.tile(np.arange(states, dtype=np.uint8), (n, 1)), np.zeros((n, states), np.int64), np.zeros((n, states), np.int64)
    count = np.diff(s.first)
    order = np.argsort(-count, kind="stable")
    for k in range(int(count.max(initial=0))):
        live = order[: np.searchsorted(-count[order], -k, side="left")]  # texts with more than k blocks
        at = s.first[live] + k
        now = ends[live].astype(np.intp)
        units[live] += np.take_along_axis(s.units[at], now, 1)
        marks[live] += np.take_along_axis(s.marks[at], now, 1)
        ends[live] = np.take_along_axis(s.ends[at], now, 1)
    return ends, units, marks


def place(auto: Automaton, text: bytes, s: Scan, which: int, entry: int, k: int) -> int:
    """Offset in a text, entered in that state, of the start of the unit after k others; its end if it has no more."""
    state, width = entry, auto.step.shape[1]
    for block in range(int(s.first[which]), int(s.first[which + 1])):
        own = int(s.units[block, state])
        if own > k:
            begin = (block - int(s.first[which])) * BLOCK_BYTES
            for i, c in enumerate(auto.kinds[np.frombuffer(text[begin : begin + BLOCK_BYTES], np.uint8)].tolist()):
                if auto.starts[state, c]:
                    if not k:
                        return begin + i
                    k -= 1
                state = int(auto.step[state, c])
        k -= own
        state = int(s.ends[block, state])
    return len(text)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def _drawn(h: int, n: int) -> int:
    return h % (n + 1)


_CUT = "doc_id long, text binary, h3 long, h4 long, units long, marks long, a long, b long"


def _cut_whole(unit: str):
    """Cuts of texts of one chunk, in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(unit)
        for batch in batches:
            data, offsets = _buffers(batch.column(1))
            s = scan(auto, data, offsets)
            _, units, marks = composed(s)
            n, m = units[:, 0], marks[:, 0]
            h1, h2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            cuts = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
            found = np.zeros(cuts.shape, np.int64)
            for i in np.flatnonzero((m == 0) & (n > 0)).tolist():
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                for side in (0, 1):
                    k = int(cuts[side, i])
                    found[side, i] = 0 if k == 0 else place(auto, text, s, i, 0, k)
            columns = [batch.column(0), batch.column(1), batch.column(4), batch.column(5), pa.array(n), pa.array(m), pa.array(found[0]), pa.array(found[1])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "h3", "h4", "units", "marks", "a", "b"])

    return run


_FUNCTION = "row string, chunk int, h1 long, h2 long, ends array<int>, units array<long>, marks array<long>"


def _functions(unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(unit)
        for batch in batches:
            ends, units, marks = composed(scan(auto, *_buffers(batch.column(4))))
            columns = [*batch.columns[:4], pa.array(ends.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(units.tolist(), pa.list_(pa.int64())), pa.array(marks.tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "chunk", "h1", "h2", "ends", "units", "marks"])

    return run


_TARGET = "row string, units long, marks long, side int, chunk int, entry int, k long"


def _chunks_of_cuts(rows: pd.DataFrame) -> pd.DataFrame:
    """The chunks of one text that its two cuts fall into, each with the state it is entered in and the units of it before the cut. A cut at the text's very start has no chunk."""
    rows = rows.sort_values("chunk")
    state, units, marks, entered = 0, 0, 0, []
    for ends, own, met in zip(rows["ends"], rows["units"], rows["marks"], strict=True):
        entered.append((state, units))
        units, marks, state = units + int(own[state]), marks + int(met[state]), int(ends[state])
    before = np.array([u for _, u in entered])
    out = []
    for side, k in enumerate(sorted(_drawn(int(rows[h].iloc[0]), units) for h in ("h1", "h2"))):
        at = int(np.searchsorted(before, k, side="right")) - 1  # the last chunk that has no more than k units before it
        out.append((rows["row"].iloc[0], units, marks, side, at if k else -1, entered[at][0], k - int(before[at])))
    return pd.DataFrame(out, columns=["row", "units", "marks", "side", "chunk", "entry", "k"])


def _places(unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(unit)
        for batch in batches:
            data, offsets = _buffers(batch.column(5))
            s = scan(auto, data, offsets)
            found = [
                (chunk * CHUNK_BYTES + place(auto, data[offsets[i] : offsets[i + 1]].tobytes(), s, i, entry, k))
                for i, (chunk, entry, k) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["row", "side", "at"])

    return run


def _cut_giants(giants: DataFrame, unit: str) -> DataFrame:
    """Cuts of long texts, whose chunks are scanned apart. Rows of one id and text are one text here."""
    row = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.sha2("text", 256)), 256)
    named = giants.withColumn("row", row)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / CHUNK_BYTES).cast("int")), lambda i: F.substring(F.col("text"), i * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)))
    chunks = stored(named.select("row", "h1", "h2", F.posexplode(pieces).alias("chunk", "bytes")), "fim-chunks")
    functions = chunks.select("row", "chunk", "h1", "h2", "bytes").mapInArrow(_functions(unit), _FUNCTION).dropDuplicates(["row", "chunk"])
    targets = stored(functions.groupBy("row").applyInPandas(_chunks_of_cuts, _TARGET), "fim-targets")

    met = targets.where("marks = 0 and chunk >= 0").select("row", "side", "chunk", "entry", "k").join(chunks.select("row", "chunk", "bytes"), ["row", "chunk"]).select("row", "side", "chunk", "entry", "k", "bytes")
    at = met.mapInArrow(_places(unit), "row string, side int, at long").groupBy("row").agg(F.max(F.when(F.col("side") == 0, F.col("at"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("at"))).alias("b"))
    totals = targets.where("side = 0").select("row", "units", "marks").join(at, "row", "left")
    return named.join(totals, "row").select("doc_id", "text", "h3", "h4", "units", "marks", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


def _group(doc_id: Column, seed: str) -> list[Column]:
    """The first four groups of eight digits of the hash of seed and id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone. No text with a sentinel is transformed, so the first ones found are the right ones."""
    p, s, m = (F.locate(x, output) for x in SENTINELS)
    of = lambda start, end: F.substring(output, start, end - start)
    end = F.char_length(output) + 1
    psm = F.concat(of(p + 3, s), of(m + 3, end), of(s + 3, m))
    spm = F.concat(of(p + 3, m), of(m + 3, end), of(s + 3, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, unit: str = "chars", seed: str = SEED) -> DataFrame:
    """doc_id, form, units, prefix, middle, suffix (null if plain) and output, a row a document.

    unit: what cuts are counted in, ``chars``, ``words`` or ``lines``. With words or lines
    a cut lies before the first byte of a unit.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.select("doc_id", "text", *_group(F.col("doc_id"), seed))
    whole = rows.where(F.octet_length("text") <= CHUNK_BYTES).mapInArrow(_cut_whole(unit), _CUT)
    cut = whole.unionByName(_cut_giants(rows.where(F.octet_length("text") > CHUNK_BYTES), unit))
    plain = (F.octet_length("text") == 0) | (F.col("marks") > 0) | (F.col("h3") % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SPM_TO, "spm").otherwise("psm")
    part = lambda start, end: F.when(F.col("form") != "plain", F.substring(F.col("text"), start + 1, end - start).cast("string"))
    size = F.octet_length("text").cast("long")
    cut = cut.withColumn("form", form).select(
        "doc_id", "form", "units", F.col("text").cast("string").alias("whole"), part(F.lit(0), F.col("a").cast("int")).alias("prefix"), part(F.col("a").cast("int"), F.col("b").cast("int")).alias("middle"), part(F.col("b").cast("int"), size.cast("int")).alias("suffix")
    )
    p, s, m = map(F.lit, SENTINELS)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "plain", F.col("whole")).when(F.col("form") == "psm", psm).otherwise(spm)
    return cut.select("doc_id", "form", "units", "prefix", "middle", "suffix", output.alias("output"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    chars = lambda c: F.char_length(c).cast("long")
    return made.select(
        "doc_id", F.col("units").alias("n"), "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
),
g AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4
  FROM d
),
f AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM g
),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t
                      WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
                      ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END AS output
  FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""
