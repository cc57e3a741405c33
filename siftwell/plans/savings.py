"""Queries of the savings log."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import savings as V
from siftwell.plans.catalog import Catalog
from siftwell.sources import tables as S

CATALOG = Catalog()
query = CATALOG.query

_SUMS = "count(*) AS calls, CAST(sum(actual) AS BIGINT) AS actual_total, CAST(sum(baseline) AS BIGINT) AS baseline_total, CAST(sum(greatest(0, baseline - actual)) AS BIGINT) AS saved_total"


@query("savings_fact", f"WITH {S.SAVINGS_SQL} SELECT event_id, operation, caller, actual, baseline, greatest(0, baseline - actual) AS saved FROM savings")
def savings_fact(spark, sf_dir):
    return S.savings(spark, sf_dir).withColumn("saved", V.saved(F.col("actual"), F.col("baseline")))


@query("savings_by_op", f"WITH {S.SAVINGS_SQL} SELECT operation, {_SUMS} FROM savings GROUP BY operation")
def savings_by_op(spark, sf_dir):
    return V.summary(S.savings(spark, sf_dir))


@query("savings_rollup", f"WITH {S.SAVINGS_SQL} SELECT coalesce(operation, 'overall') AS operation, {_SUMS} FROM savings GROUP BY ROLLUP (operation)")
def savings_rollup(spark, sf_dir):
    return V.summary(S.savings(spark, sf_dir), overall=True)


@query(
    "savings_rates",
    f"WITH {S.SAVINGS_SQL}, s AS (SELECT operation, {_SUMS} FROM savings GROUP BY operation) SELECT operation, calls, saved_total, "
    "CAST(greatest(0, least(100, floor(saved_total * 100 / baseline_total + 0.5))) AS BIGINT) AS percent, saved_total // calls AS per_call FROM s",
)
def savings_rates(spark, sf_dir):
    return V.rates(V.summary(S.savings(spark, sf_dir)))


@query("savings_recent", f"WITH {S.SAVINGS_SQL} SELECT event_id, operation, caller, actual, baseline FROM savings ORDER BY event_id DESC LIMIT 500")
def savings_recent(spark, sf_dir):
    return S.savings(spark, sf_dir).orderBy(F.desc("event_id")).limit(500)


@query(
    "baseline_tokens",
    f"WITH {S.chunks_sql(20)}, hits AS (SELECT DISTINCT path FROM chunks WHERE contains(lower(content), 'erble')) SELECT count(*) AS files, CAST(sum((length(content) + 3) // 4) AS BIGINT) AS tokens FROM files JOIN hits USING (path)",
)
def baseline_tokens(spark, sf_dir):
    hits = S.chunks(spark, sf_dir, 20).where(T.contains(F.col("content"), "erble")).select("path").distinct()
    f = S.files(spark, sf_dir).select("path", T.token_estimate(F.col("content")).alias("t"))
    return f.join(hits, "path", "left_semi").agg(F.count("*").alias("files"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))


@query("p95_nearest_rank", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def p95_nearest_rank(spark, sf_dir):
    return V.nearest_rank(S.table(spark, sf_dir, "events"), "event_type", "value", 0.95).withColumnRenamed("value", "p95")
