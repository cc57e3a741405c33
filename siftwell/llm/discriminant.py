"""Document quality by regularised quadratic discriminant analysis.

Each class has the mean and the shrunken covariance of transformed document statistics
(``docstats.FEATURES``). The moments are sums over the labelled training rows, added up by Spark; only
two small matrices reach the driver. Their Cholesky factors are computed once and cached in the scoring
closure. The score is the logistic of the difference of the two log densities plus the log prior ratio.

Defined results for odd input: a null or blank text has the statistics of an empty text and gets a score
like any other; a null id is never held out nor used for training; labels other than 0 and 1, null labels
and labels that disagree for one id are not trained on; with one class or none to learn from every score is the share of label 1
(0.5 without any label); repeated rows are scored each; columns besides those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch, fold, map_slices
from siftwell.llm.docstats import FEATURES, DocStats
from siftwell.llm.textcodes import column_bytes

SHRINK = 0.1  #: weight of the diagonal in each class covariance
RIDGE = 1e-3  #: added to each variance
MAX_LOG_ODDS = 30.0
FOLDS, HELD = 3, 1


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the feature vector of every row's whole text."""

    def stats(part: pa.RecordBatch) -> pa.RecordBatch:
        x = DocStats(*column_bytes(part.column(1))).features()
        flat = pa.array(x.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), flat)
        return pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), lists], names=["doc_id", "x"])

    return map_slices(docs.select("doc_id", "text"), stats, "doc_id long, x array<double>")


def class_moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class of ``rows`` (x, label): count, sum of x and sum of outer products, added up by Spark."""
    d = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, d)
            y = np.asarray(batch.column(1))
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        size = total.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], size)), pa.array(np.tile(np.arange(size), 2)), pa.array(total.ravel())],
            names=["label", "at", "v"],
        )

    parts = rows.select("x", F.col("label").cast("long")).mapInArrow(sums, "label long, at long, v double")
    out = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    for r in parts.groupBy("label", "at").agg(F.sum("v").alias("v")).collect():  # 2 * (1 + d + d * d) numbers
        out[r["label"]][r["at"]] = r["v"]
    return {k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in out.items()}


class Discriminant:
    """The fitted model: per class mean, inverse Cholesky factor and the log density's constant."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        n = [moments[k][0] for k in (0, 1)]
        self.constant = None if min(n) >= 2 else (n[1] / sum(n) if sum(n) else 0.5)
        self.classes = []
        for k in (0, 1) if self.constant is None else ():
            count, s, ss = moments[k]
            mean = s / count
            cov = ss / count - np.outer(mean, mean)
            cov = (1 - SHRINK) * cov + SHRINK * np.diag(np.diag(cov)) + RIDGE * np.eye(len(mean))
            factor = np.linalg.cholesky(cov)
            self.classes.append((mean, np.linalg.inv(factor), np.log(count / sum(n)) - np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        low, high = (c - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, c in self.classes)
        return 1.0 / (1.0 + np.exp(-np.clip(high - low, -MAX_LOG_ODDS, MAX_LOG_ODDS)))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` after training on the labelled rows."""
    spark = docs.sparkSession
    stats = Scratch(spark, "qda").save(document_statistics(docs), "stats")
    agreed = (
        labels.where(F.col("quality").isin(0, 1) & (fold("doc_id", FOLDS) != HELD))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .where("label = other")
    )
    model = Discriminant(class_moments(stats.join(agreed, "doc_id").select("x", "label")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.score(np.asarray(b.column(1).flatten()).reshape(b.num_rows, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p)], names=["doc_id", "held_out", "score"])

    held = F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(False))
    scored = stats.select("doc_id", "x", held.alias("held_out")).mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
