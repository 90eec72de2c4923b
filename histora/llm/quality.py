"""Quality by compression: how much better a text packs next to good examples than next to bad ones.

Two zstandard dictionaries are made for each of two views of a text, one from
good and one from bad labelled texts: the bytes as they are, and their outline
(runs of lower-case, upper-case and digit characters as one mark each). A text
is cut into chunks of equal size, each chunk is compressed with both
dictionaries, and the difference of the two sizes over the chunk's size is the
evidence. Each sampled text has an equal share of its class's dictionaries, in
pieces spread over the whole text; with 2,500 texts that is 44 bytes of each and
12 of its outline. Mean and extremes of that evidence, with the compressed shares
themselves, go through a logistic calibration to a score from 0 to 1.

The model is fitted on the driver from a bounded sample: at most
``SAMPLE_ROWS`` labelled rows of each class, those with the smallest hash of
doc_id, of texts up to ``SAMPLE_BYTES`` bytes; of an id that repeats, one text. Two folds keep the calibration
honest: a text is never measured against a dictionary that holds it. Scoring
reads every whole text and sends nothing back.

Defined cases: a null text scores as empty, and an empty text gets a score like
any other; without labels of both classes each document scores the share of good
ones (0.5 without any); null labels are ignored; a null doc_id is not held out.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_text, small_batches, stored, table, texts

SAMPLE_ROWS = 2500
SAMPLE_BYTES = 32_768
THRESHOLD = 0.7
HELD_OUT_FOLD, FOLDS = 2, 4

_LOWER, _UPPER, _DIGIT = re.compile(b"a+"), re.compile(b"A+"), re.compile(b"0+")
_MARKS = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


def outline(text: bytes) -> bytes:
    return _DIGIT.sub(b"0", _UPPER.sub(b"A", _LOWER.sub(b"a", text.translate(_MARKS))))


@dataclass(frozen=True)
class View:
    outlined: bool
    dictionary_bytes: int
    chunk: int

    def of(self, text: bytes) -> bytes:
        return outline(text) if self.outlined else text


VIEWS = (View(False, 112 << 10, 512), View(True, 32 << 10, 128))
LEVEL = 3
PIECE = 64


def _pieces(text: bytes, share: int) -> bytes:
    """share bytes of a text: the whole of a shorter one, else pieces at hashed offsets, one from each of equal stretches."""
    if len(text) <= share:
        return text
    n = max(1, share // PIECE)
    size, cuts = share // n, [i * len(text) // n for i in range(n + 1)]
    starts = [a + zlib.crc32(text, i) % max(1, b - a - size + 1) for i, (a, b) in enumerate(itertools.pairwise(cuts))]
    return b"".join(text[at : at + size] for at in starts)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary: an equal share of each sample, in pieces spread over the whole of it."""
    share = max(1, size // max(1, len(samples)) - 1)
    return b"\n".join(_pieces(s, share) for s in samples)[:size] or b"\n" * 8


class Measure:
    """Evidence of one view."""

    def __init__(self, view: View, good: bytes, bad: bytes) -> None:
        self.view = view
        self.packers = [self._packer(d) for d in (good, bad)]
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    @staticmethod
    def _packer(content: bytes) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)

    def __call__(self, text: bytes) -> list[float]:
        view, size = self.view.of(text), self.view.chunk
        chunks = [view[i : i + size] for i in range(0, max(1, len(view)), size)]
        if len(chunks) > 1 and len(chunks[-1]) < size // 2:
            tail = chunks.pop()
            chunks[-1] += tail
        sizes = np.array([len(c) for c in chunks], float) + 8
        good, bad = (np.array([len(p.compress(c)) for c in chunks], float) for p in self.packers)
        gain = (bad - good) / sizes
        plain = len(self.plain.compress(view)) / (len(view) + 16)
        return [gain.mean(), gain.min(), gain.max(), plain, min(plain, 0.2), good.sum() / sizes.sum(), np.minimum(good, bad).sum() / sizes.sum(), (good / sizes).min(), (good / sizes).max()]


@dataclass
class Model:
    """Dictionaries and calibration; small and picklable."""

    dictionaries: list[tuple[bytes, bytes]]
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def scorer(self):
        if not len(self.weights):
            return lambda text: self.prior
        measures = [Measure(v, *d) for v, d in zip(VIEWS, self.dictionaries, strict=True)]

        def score(text: bytes) -> float:
            x = (np.concatenate([m(text) for m in measures]) - self.centre) / self.spread
            return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))))

        return score


def _dictionaries(rows: list[tuple[bytes, int]]) -> list[tuple[bytes, bytes]]:
    return [tuple(_dictionary([v.of(t) for t, y in rows if y == label], v.dictionary_bytes) for label in (1, 0)) for v in VIEWS]


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """From (text, label) rows: dictionaries of all, calibration by two folds."""
    labels = np.array([y for _, y in rows], float)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    if min((labels == 1).sum(), (labels == 0).sum()) < 2:
        return Model([], np.empty(0), np.empty(0), np.empty(0), float(prior))
    fold = np.zeros(len(rows), int)
    for label in (0, 1):
        own = np.flatnonzero(labels == label)
        fold[own] = np.arange(len(own)) % 2
    x = None
    for k in (0, 1):
        measures = [Measure(v, *d) for v, d in zip(VIEWS, _dictionaries([r for r, f in zip(rows, fold, strict=True) if f != k]), strict=True)]
        for i in np.flatnonzero(fold == k):
            one = np.concatenate([m(rows[i][0]) for m in measures])
            x = np.zeros((len(rows), len(one))) if x is None else x
            x[i] = one
    centre, spread = x.mean(0), x.std(0) + 1e-9
    z, w, ridge = np.c_[np.ones(len(x)), (x - centre) / spread], np.zeros(x.shape[1] + 1), 0.1
    for _ in range(40):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (labels - p) - ridge * w)
    return Model(_dictionaries(rows), centre, spread, w, float(prior))


def is_held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """At most ``rows`` labelled texts of each class, outside the held-out fold, on the driver.

    Of the labelled documents that have a text of at most most_bytes, those with the smallest hashes of their ids.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(~is_held_out("doc_id"))
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= most_bytes)
    with_text = usable.select("doc_id").join(known, "doc_id").distinct()
    picked = None
    for label in (0, 1):
        one = with_text.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = one if picked is None else picked.unionAll(one)
    picked = stored(picked, "labelled-ids")
    # ids may repeat, so there is one text an id and label: the rows are bounded by the ids
    found = usable.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return [(r.text.encode(), r.label) for r in sorted(found, key=lambda r: (r.doc_id * 0x9E3779B97F4A7C15 % 2**64, r.doc_id, r.label))]


def _scored(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t) for t in texts(batch.column(1))], pa.float64())], schema=schema)

    return run


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    small_batches(docs.sparkSession)
    scored = keyed_text(docs).mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _verdicts(model: Model, most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            keep = [score((t or "").encode()) >= most for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, whole and unchanged, whose text scores at least the threshold."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_verdicts(model, threshold), docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit(labelled_sample(docs, table(spark, sf_dir, "labels"))))
