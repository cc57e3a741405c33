"""SQL functions of the engine for a session: scalar ones and a table function, all plain expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = (
    "text_tokens(t STRING) RETURNS BIGINT RETURN CAST(floor((coalesce(length(t), 0) + 3) / 4) AS BIGINT)",
    """fit_tokens(t STRING, n INT) RETURNS STRING RETURN CASE WHEN floor((coalesce(length(t), 0) + 3) / 4) <= n THEN t
         WHEN n <= 0 THEN '' ELSE concat(rtrim(substring(t, 1, n * 4 - 1)), '…') END""",
    "path_tier(p STRING, n INT) RETURNS STRING RETURN array_join(slice(split(p, '/'), 1, n), '/')",
    """line_windows_of(t STRING, n INT) RETURNS TABLE (start_line BIGINT, end_line BIGINT, content STRING)
         RETURN SELECT w.start_line, w.end_line, w.content
                FROM inline(get(transform(array(split(t, '\\n')), l -> transform(sequence(1, size(l), n), s ->
                  named_struct('start_line', CAST(s AS BIGINT), 'end_line', CAST(least(s + n - 1, size(l)) AS BIGINT), 'content', array_join(slice(l, s, n), '\\n')))), 0)) AS w""",
)


def register(spark: SparkSession) -> None:
    """Makes the functions known to ``spark.sql`` of this session."""
    for f in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")
