"""Toxicity by compression distance.

Dictionaries are trained by zstandard on whole texts: one on ordinary text
(``BASE_BYTES``), and on toxic text one for each of ``PARTS`` parts of the sample that it
leaves out (``TOXIC_BYTES``, of segments short enough for words).  One compressor has the
ordinary dictionary, the others have that and a toxic one, so that they differ in the
toxic part alone.  A text is lower-cased (A-Z), cut into windows of ``WINDOW`` bytes that
overlap a little, and each window compressed with all.  How much shorter the windows get
with a toxic dictionary is summed up in a few features, which a logistic calibration,
weighted to the full counts of labels, turns into a score; the mean over the toxic
dictionaries counts.

Calibration is cross-fitted: features of a part come from dictionaries, ordinary and
toxic, trained without it.  Sizes, segment lengths, features and the number of parts were
chosen by cross-validation within the training folds.

Only the labelled sample is bounded: ``SAMPLE`` documents of each label, those of the
smallest hash of their ids, or as many of them as have ``SAMPLE_BYTES`` of text together
(one at least); a repeated doc_id counts once.  Texts are never cut.  Scoring is
map-only, over all of every text; dictionaries of some kilobytes are broadcast.

Labels are read from rows whose crc32(doc_id as text) mod 4 isn't ``HELD_OUT`` alone;
nothing but the text enters a score.

Defined results: null and empty texts score what no saving scores; a document of
several labels counts as toxic if one of them says so; null labels are no labels;
without labels of both kinds the score is the share of toxic ones (0.5 without any);
where texts are too few for the trainer, a dictionary is the end of the texts joined;
repeated rows are rows of their own; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplewise.llm.common import cut, id_of, small_batches

HELD_OUT, FOLDS = 2, 4
SAMPLE, SAMPLE_BYTES = 3000, 32 << 20
BASE_BYTES, TOXIC_BYTES = 112640, 4096
#: the trainer's parameters for a toxic dictionary: bytes of a segment, and of what it counts
SEGMENT, COUNTED = 12, 6
PARTS = 4
WINDOW, OVERLAP = 256, 16
THRESHOLD = 0.3
N_FEATURES = 7

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(id_of(column).cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _lowered(text: str | None) -> bytes:
    return (text or "").encode().translate(_LOWER)


def trained(size: int, texts: list[bytes], **parameters: int) -> bytes:
    """A dictionary of at most ``size`` bytes, trained on whole texts."""
    texts = sorted(t for t in texts if t)
    try:
        return zstandard.train_dictionary(size, texts, **parameters).as_bytes()
    except zstandard.ZstdError:  # too few texts for the trainer
        return b"".join(texts)[-size:]


class Model:
    """An ordinary dictionary, toxic ones, and the calibration of what these save."""

    def __init__(self, ordinary: bytes, toxic: list[bytes], weights: list[float] | None = None) -> None:
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights

    def opened(self) -> "Model":
        def compressor(content: bytes):
            content = content or b"\0" * 8
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(level=6, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.plain, self.others = compressor(self.ordinary), [compressor(t + self.ordinary) for t in self.toxic]
        return self

    def features(self, text: str | None) -> np.ndarray:
        """A row of features for each toxic dictionary."""
        data = _lowered(text)
        windows = [data[max(0, k - OVERLAP) : k + WINDOW] for k in range(0, max(len(data), 1), WINDOW)]
        plain = [len(self.plain(w)) for w in windows]
        out = []
        for other in self.others:
            gain = np.array([n - len(other(w)) for n, w in zip(plain, windows, strict=True)])
            more = np.maximum(gain, 0)
            out.append([np.log1p(more.sum()), more.max(), gain.mean(), np.log1p((gain >= 3).sum()), np.log1p(len(gain)), np.log1p((gain >= 6).sum()), (gain >= 4).mean()])
        return np.array(out, dtype=np.float64)

    def scores(self, features: np.ndarray) -> np.ndarray:
        """From features (text, dictionary, feature), the mean over the dictionaries."""
        w = np.array(self.weights)
        return (1 / (1 + np.exp(-np.clip(w[0] + features @ w[1:], -500, 500)))).mean(axis=1)


def calibrated(features: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> list[float]:
    """Weighted logistic regression with a slight ridge, by Newton's method on standardised features."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.c_[np.ones(len(features)), (features - mean) / scale]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        pull = np.full(len(w), 0.5)
        pull[0] = 1e-6
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-12)) @ x + np.diag(pull), x.T @ (weight * (toxic - p)) - pull * w)
        w += np.clip(step, -4, 4)
    slopes = w[1:] / scale
    return [float(w[0] - slopes @ mean), *map(float, slopes)]


def labelled_sample(docs: DataFrame, known: DataFrame, sample: int, sample_bytes: int) -> DataFrame:
    """(doc_id, toxic, part, text), stored: at most ``sample`` documents of each label, and ``sample_bytes`` of their text."""
    picked = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for t in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most 2 * sample ids
    found = texts.join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = cut(found.select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)).cast("int").alias("part"), "text"))
    sizes = rows.select("doc_id", "toxic", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect()  # at most 2 * sample rows
    ids = []
    for label in (0, 1):
        left = sample_bytes
        for r in sorted((r for r in sizes if r["toxic"] == label), key=lambda r: (r["h"], r["doc_id"])):
            if left < r["n"] and left < sample_bytes:
                break
            left -= r["n"]
            ids.append((r["doc_id"],))
    if len(ids) == len(sizes):
        return rows
    return rows.join(F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long")), "doc_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits the model to ``labels`` (doc_id, toxic) outside the held-out fold."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter(~held_out()).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = total.get(1, 0) / sum(total.values()) if total else 0.5
    rows = labelled_sample(docs, known, sample, sample_bytes)
    table = rows.select("part", "toxic", "text").toArrow()  # at most 2 * sample_bytes, or a longer text of each label
    parts, toxic = table["part"].to_pylist(), table["toxic"].to_pylist()
    texts = [_lowered(t) for t in table["text"].to_pylist()]
    of = lambda label, part=None: [t for t, y, p in zip(texts, toxic, parts, strict=True) if y == label and p != part]
    if len(set(toxic)) < 2:
        return Model(b"", [b""], [float(np.log((share + 1e-6) / (1 - share + 1e-6)))] + [0.0] * N_FEATURES)
    model = Model(trained(BASE_BYTES, of(0)), [trained(TOXIC_BYTES, of(1, part), d=COUNTED, k=SEGMENT) for part in range(PARTS)])
    by_part = spark.sparkContext.broadcast([Model(trained(BASE_BYTES, of(0, part)), [model.toxic[part]]) for part in range(PARTS)])
    columns = ", ".join(f"f{k} double" for k in range(N_FEATURES))
    seen = rows.select("part", "toxic", "text").mapInArrow(_featured(by_part), f"toxic int, {columns}").toArrow()
    y = seen["toxic"].to_numpy()
    weight = np.array([total[t] / toxic.count(t) for t in (0, 1)])[y]
    model.weights = calibrated(np.stack([seen[f"f{k}"].to_numpy() for k in range(N_FEATURES)], axis=1), y, weight)
    return model


def _featured(by_part):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Model(m.ordinary, m.toxic).opened() for m in by_part.value]
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
            found = np.array([models[part].features(t) for part, t in pairs]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, found.T)], names=["toxic", *[f"f{k}" for k in range(N_FEATURES)]])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A row per document (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 from ``THRESHOLD`` on)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model.value.ordinary, model.value.toxic, model.value.weights).opened()
        for batch in batches:
            found = np.array([own.features(t) for t in batch.column(2).to_pylist()]).reshape(-1, len(own.toxic), N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.scores(found))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
