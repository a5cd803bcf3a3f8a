"""The two document classifiers: quality (word n-grams and shapes) and toxicity (character n-grams).

Both are linear hinge-loss models over indicators scaled by naive Bayes log-count ratios (see nbsvm). They are fitted in one
executor task on at most SAMPLE labelled rows, the first by a hash of doc_id; every document is then scored whole, in one
pass. Rows whose hashed id says so are held out and never learnt from. Scores depend on the text alone.

A null text counts as empty and gets a score like any other; a null doc_id is scored and not held out; labels that are null
or repeat differently for one id are not learnt from; without any labelled row all scores are 0.5. Repeated rows each get
their row; an empty table gives an empty result; other columns are ignored unless asked for. A very long text is scored whole
in one go: its n-gram ids take some ten times its size in memory, and no more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nbsvm
from .common import give_back, give_back_driver, table

#: The most labelled rows that a model is fitted on.
SAMPLE = 4000
THRESHOLD = 0.7
#: The columns of the result.
OWN = ("doc_id", "held_out", "score", "predicted")
TOXIC = nbsvm.CharNgrams(orders=(4, 5, 6, 7, 8), bits=20)
TOXIC_FIT = {"cost": 5.0, "epochs": 15, "folds": 3, "alpha": 20.0, "least": 10, "best_at": THRESHOLD}
QUALITY = nbsvm.WordNgrams(orders=(1, 2), bits=19)
QUALITY_FIT = {"folds": 2}


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str, features, modulus: int, rest: int, sample: int = SAMPLE, how: dict | None = None) -> bytes:
    """A model fitted on at most `sample` rows of docs with a label that are not held out, one for each doc_id (that of the
    smallest text), however many rows repeat it."""
    known = labels.where(f"{label} in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"), F.max(label).alias("z"))
    known = known.where((F.col("y") == F.col("z")) & ~held_out(F.col("doc_id"), modulus, rest) & F.col("doc_id").isNotNull())
    drawn = known.orderBy(F.xxhash64(F.lit(29), "doc_id"), "doc_id").limit(sample).select("doc_id", "y")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")  # bounded by sample
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = features.scratch()
        for b in batches:
            found = [np.sort(features(x.as_py(), scratch)).astype("<i4").tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), pa.array(found, pa.binary())], ["doc_id", "y", "ids"])
            give_back()

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few large blocks instead of one for each row: a worker that lives on gives their memory back
        blocks, places = [], []
        for b in batches:
            ends = np.cumsum([len(x.as_buffer()) for x in b.column(2)], dtype=np.int64) // 4
            blocks.append(np.concatenate([np.frombuffer(x.as_buffer(), "<i4") for x in b.column(2)]) if len(b) else np.zeros(0, "<i4"))
            places += [(d, y, len(blocks) - 1, s, e) for d, y, s, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        own = sorted(places)[:sample]  # a doc_id has one row
        model = nbsvm.fit([blocks[k][s:e] for _, _, k, s, e in own], np.array([y for _, y, *_ in own]), features.bits, **(how or {}))
        blocks = own = None
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model.pack()], pa.binary())], ["model"])

    got = rows.select("doc_id", "text", "y").mapInArrow(ids, "doc_id long, y int, ids binary").repartition(1).mapInArrow(one, "model binary").collect()
    give_back_driver(docs.sparkSession)
    return bytes(got[0].model) if got else nbsvm.fit([], np.zeros(0), features.bits).pack()


def score(docs: DataFrame, model: bytes, features, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and the columns in keep, for every row of docs (doc_id, text). A kept column that has the name of one of
    OWN is called doc_<name>."""
    name = lambda c: f"doc_{c}" if c in OWN else c
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(f"`{c}`").alias(name(c)) for c in keep if c not in ("doc_id", "text")))
    kept = [*(["text"] if "text" in keep else []), *rows.columns[2:]]
    packed = docs.sparkSession.sparkContext.broadcast(model)  # one weight for each hashed feature: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scratch = nbsvm.Model.unpack(packed.value), features.scratch()
        for b in batches:
            s = [own.score(features(x.as_py(), scratch)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), *(b.column(c) for c in kept)], ["doc_id", "score", *kept])
            give_back()

    more = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"doc_id long, score double{more}")


def classify(docs: DataFrame, labels: DataFrame, label: str, features, modulus: int, rest: int, keep: tuple[str, ...] = (), how: dict | None = None) -> DataFrame:
    model = train(docs, labels, label, features, modulus, rest, how=how)
    out = score(docs, model, features, keep)
    return out.select("doc_id", held_out(F.col("doc_id"), modulus, rest).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *out.columns[2:])


def quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return classify(docs, labels, "quality", QUALITY, 4, 2, keep, QUALITY_FIT)


def toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return classify(docs, labels, "toxic", TOXIC, 3, 1, keep, TOXIC_FIT)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
