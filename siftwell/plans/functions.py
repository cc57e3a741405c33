"""One probe for each family of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions.imports import imported_modules
from siftwell.functions.sql import register
from siftwell.plans.catalog import Catalog
from siftwell.sources import tables as S

CATALOG = Catalog()
query = CATALOG.query


@query(
    "fn_string",
    """SELECT p_partkey, upper(p_name) AS upper_name, trim('  ' || p_name || ' ') AS trimmed, ltrim('../' || p_name, './') AS stripped, split_part(p_name, ' ', 2) AS second, starts_with(p_name, 'small') AS small,
      regexp_replace(p_name || '  x', '\\s+', '-', 'g') AS slug, replace(p_brand, '#', '_') AS brand FROM part""",
)
def fn_string(spark, sf_dir):
    name = F.col("p_name")
    return S.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.upper(name).alias("upper_name"),
        F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
        F.ltrim(F.concat(F.lit("../"), name), F.lit("./")).alias("stripped"),
        F.split_part(name, F.lit(" "), F.lit(2)).alias("second"),
        name.startswith("small").alias("small"),
        F.regexp_replace(F.concat(name, F.lit("  x")), r"\s+", "-").alias("slug"),
        F.replace("p_brand", F.lit("#"), F.lit("_")).alias("brand"),
    )


@query(
    "fn_array",
    """WITH a AS (SELECT p_partkey, list_distinct([p_size % 4, p_size % 3, p_size % 5]) AS x FROM part) SELECT p_partkey, CAST(len(x) AS BIGINT) AS n, array_to_string(list_sort(x), ',') AS sorted, list_contains(x, 2) AS has_two,
      len(list_filter(x, lambda v: v > 2)) > 0 AS some_large, len(list_filter(x, lambda v: v < 5)) = len(x) AS all_small, array_to_string(list_sort(list_intersect(x, [1, 2])), ',') AS common FROM a""",
)
def fn_array(spark, sf_dir):
    s = F.col("p_size")
    x = F.col("x")
    joined = lambda a: F.array_join(F.transform(F.array_sort(a), lambda v: v.cast("string")), ",")
    a = S.table(spark, sf_dir, "part").select("p_partkey", F.array_distinct(F.array(s % 4, s % 3, s % 5)).alias("x"))
    return a.select(
        "p_partkey",
        F.size(x).cast("long").alias("n"),
        joined(x).alias("sorted"),
        F.array_contains(x, 2).alias("has_two"),
        F.exists(x, lambda v: v > 2).alias("some_large"),
        F.forall(x, lambda v: v < 5).alias("all_small"),
        joined(F.array_intersect(x, F.array(F.lit(1), F.lit(2)))).alias("common"),
    )


@query(
    "fn_map_json",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || '=' || user_id AS pair, CAST(user_id AS VARCHAR) AS looked_up, CAST(to_json({'t': event_type, 'u': user_id}) AS VARCHAR) AS packed FROM events",
)
def fn_map_json(spark, sf_dir):
    pair = F.concat("event_type", F.lit("="), "user_id")
    read = F.from_json("props", "k bigint")
    looked = F.element_at(F.str_to_map(pair, F.lit(";"), F.lit("=")), F.col("event_type"))
    return S.table(spark, sf_dir, "events").select(
        "event_id", read.k.alias("k"), pair.alias("pair"), looked.alias("looked_up"), F.to_json(F.struct(F.col("event_type").alias("t"), F.col("user_id").alias("u"))).alias("packed")
    )


@query(
    "fn_datetime",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS later,
      o_orderdate + INTERVAL 14 DAY <= TIMESTAMP '1996-06-01' AS expired, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders""",
)
def fn_datetime(spark, sf_dir):
    d = F.col("o_orderdate")
    return S.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_format(d, "yyyy-MM-dd").alias("day"),
        F.datediff(d.cast("date"), F.lit("1990-01-01").cast("date")).cast("long").alias("days"),
        F.date_format(d + F.expr("INTERVAL 30 DAYS"), "yyyy-MM-dd").alias("later"),
        (d + F.expr("INTERVAL 14 DAYS") <= F.lit("1996-06-01 00:00:00").cast("timestamp_ntz")).alias("expired"),
        F.year(d).cast("long").alias("y"),
    )


@query(
    "sql_functions",
    "SELECT doc_id, (length(text) + 3) // 4 AS tokens, CASE WHEN (length(text) + 3) // 4 <= 10 THEN text ELSE rtrim(left(text, 39)) || '…' END AS fitted, lang AS top FROM documents",
)
def sql_functions(spark, sf_dir):
    register(spark)
    rows = S.table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "lang", "source").alias("p"))
    return rows.selectExpr("doc_id", "text_tokens(text) AS tokens", "fit_tokens(text, 10) AS fitted", "path_tier(p, 1) AS top")


_CODE = """CASE doc_id % 5 WHEN 0 THEN 'import os.m' || doc_id || chr(10) || 'from .a import b' || chr(10) || 'x = 1' WHEN 1 THEN 'import {a} from "./m' || doc_id || '";' || chr(10) || 'const b = require(''b'')'
  WHEN 2 THEN 'use std::m' || doc_id || ';' WHEN 3 THEN '#include <m' || doc_id || '.h>' || chr(10) || '#include "b.h"' ELSE 'import nothing' END"""
_LANG = "CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'tsx' WHEN 2 THEN 'rust' WHEN 3 THEN 'c' ELSE 'prose' END"


@query(
    "source_imports",
    """SELECT doc_id, unnest(CASE doc_id % 5 WHEN 0 THEN ['os.m' || doc_id, '.a'] WHEN 1 THEN ['./m' || doc_id, 'b'] WHEN 2 THEN ['std::m' || doc_id] WHEN 3 THEN ['m' || doc_id || '.h', 'b.h'] ELSE [] END) AS module FROM documents""",
)
def source_imports(spark, sf_dir):
    found = imported_modules(F.expr(_LANG), F.expr(_CODE.replace("chr(10)", "'\\n'").replace("''b''", "\\'b\\'")))
    return S.table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("module"))


@query(
    "import_lists",
    """WITH p AS (SELECT doc_id, 'm' || doc_id AS m FROM documents)
      SELECT doc_id, 'python' AS language, unnest(['os', m, 'pkg.' || m, '.near', '..']) AS module FROM p UNION ALL SELECT doc_id, 'rust', unnest(['std::' || m, 'std::io', 'std::io::Read', 'a::b::c', 'a::b::d::*', 'one']) FROM p""",
)
def import_lists(spark, sf_dir):
    """Lists, aliases, nested braces, and words in strings and comments that only look like imports."""
    m = F.concat(F.lit("m"), "doc_id")
    python = F.concat(F.lit('\"\"\"\nfrom here we go\nimport nothing\n\"\"\"\nimport os, '), m, F.lit(" as x\n# import no\n    import pkg."), m, F.lit("\nfrom .near import (a,\n  b)\nfrom .. import c\nfrom there to here\n"))
    rust = F.concat(F.lit("/* use no::no; */\n// use no;\npub use std::{"), m, F.lit(", io::{self, Read as R}};\nuse a::b::{\n  c,\n  d::{*},\n};\nuse one;\n"))
    row = lambda name, text: F.struct(F.lit(name).alias("language"), text.alias("content"))
    rows = S.table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(row("python", python), row("rust", rust))))
    return rows.select("doc_id", "language", F.explode(imported_modules(F.col("language"), F.col("content"))).alias("module"))


@query("sql_line_windows", f"WITH {S.chunks_sql(80)} SELECT doc_id, start_line, end_line, chunk_hash FROM chunks")
def sql_line_windows(spark, sf_dir):
    register(spark)
    S.table(spark, sf_dir, "documents").select("doc_id", "text").createOrReplaceTempView("windowed_documents")
    return spark.sql("SELECT doc_id, start_line, end_line, sha2(content, 256) AS chunk_hash FROM windowed_documents, LATERAL line_windows_of(text, 80)")
