"""The engine's relations, derived from the given tables: files, chunks, entries, graph, tasks, contracts, logs.

Each function has a constant of the same meaning in SQL (a list of common table expressions), so that a query and
its SQL start from the same relation. Derivations are projections wherever that is possible: chunks, for example,
are cut with array functions and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T

NOW = "1996-06-01 00:00:00"
WINDOW = 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# files and chunks

FILES_SQL = """files AS (SELECT doc_id, lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, lang AS language,
  text AS content, sha256(text) AS content_hash, CAST(n_chars AS BIGINT) AS size FROM documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, language, content, content_hash, size)."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt"))).alias("path"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("content_hash"),
        F.col("n_chars").cast("long").alias("size"),
    )


def chunks_sql(window: int = WINDOW) -> str:
    return f"""{FILES_SQL},
  lines AS (SELECT doc_id, path, language, unnest(string_split(content, chr(10))) AS line,
    generate_subscripts(string_split(content, chr(10)), 1) - 1 AS pos FROM files),
  cut AS (SELECT doc_id, path, any_value(language) AS language, CAST(min(pos) + 1 AS BIGINT) AS start_line,
    CAST(max(pos) + 1 AS BIGINT) AS end_line, string_agg(line, chr(10) ORDER BY pos) AS content
    FROM lines GROUP BY doc_id, path, pos // {window}),
  chunks AS (SELECT *, sha256(content) AS chunk_hash, regexp_extract(content, '[A-Za-z0-9_]+') AS symbol FROM cut)"""


def chunks(spark: SparkSession, sf_dir: str, window: int = WINDOW) -> DataFrame:
    """Files cut into windows of lines. The symbol stands for a definition's name: the first word."""
    from siftwell.operators.ingest import line_windows

    cut = line_windows(files(spark, sf_dir).select("doc_id", "path", "language", "content"), window)
    return cut.withColumns({"chunk_hash": F.sha2("content", 256), "symbol": F.regexp_extract("content", f"({T.WORD})", 1)})


# curated entries

ENTRIES_SQL = """entries AS (SELECT conv_id * 1000 + turn AS entry_id, conv_id, role AS section, turn AS priority, text AS detail,
  CASE WHEN length(split_part(trim(text), chr(10), 1)) <= 120 THEN split_part(trim(text), chr(10), 1)
    ELSE rtrim(left(split_part(trim(text), chr(10), 1), 119)) || '…' END AS headline,
  CASE conv_id % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'archived' WHEN 2 THEN 'deleted' ELSE 'open' END AS status,
  CASE conv_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'in-progress' WHEN 2 THEN 'blocked' ELSE 'not-started' END AS requirement_status,
  conv_id % 60 AS age_days FROM conversations)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, conv_id, section, priority, detail, headline, status, requirement_status, age_days)."""
    conv = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select(
        (conv * 1000 + F.col("turn")).alias("entry_id"),
        "conv_id",
        F.col("role").alias("section"),
        F.col("turn").alias("priority"),
        F.col("text").alias("detail"),
        T.headline(F.col("text")).alias("headline"),
        F.when(conv % 5 == 0, "resolved").when(conv % 5 == 1, "archived").when(conv % 5 == 2, "deleted").otherwise("open").alias("status"),
        F.when(conv % 4 == 0, "done").when(conv % 4 == 1, "in-progress").when(conv % 4 == 2, "blocked").otherwise("not-started").alias("requirement_status"),
        (conv % 60).alias("age_days"),
    )


ENTRY_LOG_SQL = """entry_log AS (SELECT event_id AS seq, 'p' || user_id % 3 AS project, user_id * 8 + CAST(floor(value) AS BIGINT) % 8 AS entry_id,
  CASE event_id % 8 WHEN 3 THEN 'update' WHEN 4 THEN 'update' WHEN 5 THEN 'resolve' WHEN 6 THEN 'archive' WHEN 7 THEN 'delete' ELSE 'create' END AS op,
  CASE WHEN event_id % 3 <> 0 THEN event_type || ' ' || event_id END AS headline,
  CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS priority, 'a' || event_id % 4 AS author FROM events)"""


def entry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, project, entry_id, op, headline, priority, author): the commands on entries, in order of seq."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("seq"),
        F.concat(F.lit("p"), F.col("user_id") % 3).alias("project"),
        (F.col("user_id") * 8 + F.floor("value") % 8).alias("entry_id"),
        F.when((i % 8).isin(3, 4), "update").when(i % 8 == 5, "resolve").when(i % 8 == 6, "archive").when(i % 8 == 7, "delete").otherwise("create").alias("op"),
        F.when(i % 3 != 0, F.concat("event_type", F.lit(" "), i)).alias("headline"),
        F.when(i % 5 != 0, F.get_json_object("props", "$.k").cast("long")).alias("priority"),
        F.concat(F.lit("a"), i % 4).alias("author"),
    )


# a hierarchy with dependency edges

GRAPH_SQL = """cust AS (SELECT c_custkey, 'r' || n_regionkey || '/n' || c_nationkey || '/c' || c_custkey AS path, c_mktsegment, c_acctbal
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
  supp AS (SELECT s_suppkey, 'r' || n_regionkey || '/n' || s_nationkey || '/s' || s_suppkey AS path, s_acctbal
    FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  gfiles AS (SELECT path, c_mktsegment AS language, CAST(abs(floor(c_acctbal)) AS BIGINT) AS size, CAST(c_custkey % 90 + 1 AS BIGINT) AS loc FROM cust
    UNION ALL SELECT path, 'supplier', CAST(abs(floor(s_acctbal)) AS BIGINT), CAST(s_suppkey % 90 + 1 AS BIGINT) FROM supp),
  gedges AS (SELECT DISTINCT cust.path AS src, CASE WHEN l_suppkey % 10 = 9 THEN '' ELSE supp.path END AS dst,
    CASE WHEN l_suppkey % 10 = 9 THEN 'mod' || l_suppkey % 30 ELSE '' END AS module, l_returnflag AS kind
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey JOIN supp ON l_suppkey = s_suppkey)"""


def _placed(rows: DataFrame, nation: DataFrame, key: str, nation_key: str, letter: str) -> DataFrame:
    dim = nation.select(F.col("n_nationkey").alias(nation_key), "n_regionkey")
    path = F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), nation_key, F.lit(f"/{letter}"), key)
    return rows.join(dim, nation_key).withColumn("path", path)


def graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, language, size, loc): customers and suppliers as files under region and nation."""
    nation = table(spark, sf_dir, "nation")
    c = _placed(table(spark, sf_dir, "customer"), nation, "c_custkey", "c_nationkey", "c")
    s = _placed(table(spark, sf_dir, "supplier"), nation, "s_suppkey", "s_nationkey", "s")
    size = lambda col: F.abs(F.floor(col)).cast("long").alias("size")
    loc = lambda col: (F.col(col) % 90 + 1).cast("long").alias("loc")
    return c.select("path", F.col("c_mktsegment").alias("language"), size("c_acctbal"), loc("c_custkey")).unionByName(
        s.select("path", F.lit("supplier").alias("language"), size("s_acctbal"), loc("s_suppkey"))
    )


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, module, kind), distinct: customer to supplier; every tenth supplier counts as an external module."""
    nation = table(spark, sf_dir, "nation")
    c = _placed(table(spark, sf_dir, "customer"), nation, "c_custkey", "c_nationkey", "c").select("c_custkey", F.col("path").alias("src"))
    s = _placed(table(spark, sf_dir, "supplier"), nation, "s_suppkey", "s_nationkey", "s").select("s_suppkey", F.col("path").alias("to"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("kind"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    # keys are reduced to distinct pairs before the paths are joined to them
    pairs = lines.join(orders, "l_orderkey").select("c_custkey", F.col("l_suppkey").alias("s_suppkey"), "kind").distinct()
    outside = F.col("s_suppkey") % 10 == 9
    return (
        pairs.join(c, "c_custkey")
        .join(s, "s_suppkey")
        .select(
            "src",
            F.when(outside, "").otherwise(F.col("to")).alias("dst"),
            F.when(outside, F.concat(F.lit("mod"), F.col("s_suppkey") % 30)).otherwise("").alias("module"),
            "kind",
        )
        .distinct()
    )


# plans and tasks

TASKS_SQL = f"""tasks AS (SELECT l_orderkey AS plan_id, CAST(l_linenumber AS BIGINT) AS task_no, count(*) AS n_rows,
    CASE WHEN bool_and(l_linestatus = 'F') THEN 'completed' WHEN bool_and(l_returnflag = 'N') THEN 'pending'
      WHEN bool_or(l_returnflag = 'R') THEN 'claimed' ELSE 'ready' END AS status,
    max(l_shipdate) AS lease_expires_at, CAST(max(l_partkey) % 7 AS BIGINT) AS priority FROM lineitem GROUP BY ALL),
  ranked AS (SELECT plan_id, task_no, row_number() OVER w AS k, lag(task_no) OVER w AS prev, min(task_no) OVER (PARTITION BY plan_id) AS first
    FROM tasks WINDOW w AS (PARTITION BY plan_id ORDER BY task_no)),
  deps AS (SELECT plan_id, task_no, prev AS needs FROM ranked WHERE prev IS NOT NULL
    UNION SELECT plan_id, task_no, first FROM ranked WHERE k >= 3),
  plans AS (SELECT o_orderkey AS plan_id, CASE o_orderstatus WHEN 'P' THEN 'draft' ELSE 'active' END AS plan_status, o_orderpriority AS title FROM orders),
  clock AS (SELECT TIMESTAMP '{NOW}' AS now)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, task_no, n_rows, status, lease_expires_at, priority): one task for each line number of an order."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").cast("long").alias("task_no"))
        .agg(
            F.count("*").alias("n_rows"),
            F.when(F.bool_and(F.col("l_linestatus") == "F"), "completed")
            .when(F.bool_and(F.col("l_returnflag") == "N"), "pending")
            .when(F.bool_or(F.col("l_returnflag") == "R"), "claimed")
            .otherwise("ready")
            .alias("status"),
            F.max("l_shipdate").alias("lease_expires_at"),
            (F.max("l_partkey") % 7).cast("long").alias("priority"),
        )
    )


def dependencies(of: DataFrame) -> DataFrame:
    """(plan_id, task_no, needs): each task needs the one before it, and from the third on the first."""
    order = Window.partitionBy("plan_id").orderBy("task_no")
    placed = of.select(
        "plan_id",
        "task_no",
        F.row_number().over(order).alias("k"),
        F.lag("task_no").over(order).alias("prev"),
        F.first("task_no").over(order).alias("first"),
    )
    needs = F.array_distinct(F.array_compact(F.array("prev", F.when(F.col("k") >= 3, F.col("first")))))
    return placed.select("plan_id", "task_no", F.explode(needs).alias("needs"))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("plan_id"),
        F.when(F.col("o_orderstatus") == "P", "draft").otherwise("active").alias("plan_status"),
        F.col("o_orderpriority").alias("title"),
    )


# contracts and evidence

CONTRACTS_SQL = r"""criteria AS (SELECT doc_id AS criterion_id, doc_id // 10 AS requirement_id, doc_id // 5 AS invariant_id,
    CASE doc_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'file' ELSE 'command' END AS evidence_kind, doc_id % 4 <> 3 AS required,
    doc_id % 2 = 0 AS independent_review, (doc_id // 5) % 3 = 0 AS high_risk, CASE WHEN doc_id % 6 = 2 THEN 'Only Authorised access' ELSE 'Works' END AS statement FROM documents),
  marked AS (SELECT labels.doc_id, quality, toxic, evidence_kind, invariant_id, requirement_id FROM labels JOIN criteria ON labels.doc_id = criterion_id),
  recorded AS (
    SELECT doc_id AS criterion_id, requirement_id, invariant_id, doc_id * 3 + 1 AS seq, evidence_kind AS kind, CASE WHEN quality = 1 THEN 'passed' ELSE 'failed' END AS result,
      CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 2 END AS revision, CASE WHEN doc_id % 11 = 0 THEN 'provisional' ELSE 'verified' END AS recorded,
      'Author ' || doc_id % 5 AS author, CASE doc_id % 3 WHEN 0 THEN './tests//T' WHEN 1 THEN 'tests\t' ELSE 'tests/t' END || doc_id % 40 AS test_ref, '' AS review_ref FROM marked
    UNION ALL SELECT doc_id, requirement_id, invariant_id, doc_id * 3, evidence_kind, 'passed', 1 + doc_id % 2, 'verified', 'author 0', 'tests/t' || doc_id % 9, '' FROM marked WHERE doc_id % 6 < 2
    UNION ALL SELECT doc_id, requirement_id, invariant_id, doc_id * 3 + 2, 'review', CASE WHEN toxic = 0 THEN 'passed' ELSE 'failed' END, 2, 'verified', 'author ' || doc_id % 4, NULL,
      CASE doc_id % 3 WHEN 0 THEN 'invariant:' || invariant_id WHEN 1 THEN 'criterion:' || doc_id ELSE 'other' END FROM marked WHERE doc_id % 4 < 3),
  evidence AS (SELECT *, CASE WHEN seq % 17 <> 0 THEN 'c' || seq % 5 END AS source_commit, seq % 19 <> 0 AS commit_verified, CASE WHEN test_ref <> '' THEN seq % 23 <> 0 END AS ref_verified,
    CASE WHEN seq % 4 <> 0 THEN 'w' END AS fingerprint, CASE WHEN kind = 'command' THEN CASE seq % 4 WHEN 0 THEN 'uv run pytest -q' WHEN 1 THEN 'bash -c "npm run test"' WHEN 2 THEN 'pytest tests/t.py' ELSE 'make all' END END AS command_ref FROM recorded),
  violations AS (SELECT doc_id AS violation_id, invariant_id, requirement_id, CASE WHEN doc_id % 2 = 0 THEN 'blocking' ELSE 'warning' END AS severity,
    CASE WHEN doc_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status FROM marked WHERE toxic = 1)"""


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("criterion_id"),
        F.floor(i / 10).cast("long").alias("requirement_id"),
        F.floor(i / 5).cast("long").alias("invariant_id"),
        F.when(i % 3 == 0, "test").when(i % 3 == 1, "file").otherwise("command").alias("evidence_kind"),
        (i % 4 != 3).alias("required"),
        (i % 2 == 0).alias("independent_review"),
        (F.floor(i / 5) % 3 == 0).alias("high_risk"),
        F.when(i % 6 == 2, "Only Authorised access").otherwise("Works").alias("statement"),
    )


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = criteria(spark, sf_dir).select(F.col("criterion_id").alias("doc_id"), "evidence_kind", "invariant_id", "requirement_id")
    return table(spark, sf_dir, "labels").join(own, "doc_id")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(criterion_id, requirement_id, invariant_id, seq, kind, result, revision, recorded, author, test_ref, review_ref, source_commit, commit_verified, ref_verified, fingerprint, command_ref)."""
    i, text = F.col("doc_id"), lambda s, c: F.concat(F.lit(s), c)
    none = F.lit(None).cast("string")
    base = ["requirement_id", "invariant_id"]
    row = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, ("seq", "kind", "result", "revision", "recorded", "author", "test_ref", "review_ref"), strict=True)])
    now = row(
        i * 3 + 1,
        F.col("evidence_kind"),
        F.when(F.col("quality") == 1, "passed").otherwise("failed"),
        F.when(i % 7 == 0, 1).otherwise(2).cast("long"),
        F.when(i % 11 == 0, "provisional").otherwise("verified"),
        text("Author ", i % 5),
        F.concat(F.when(i % 3 == 0, "./tests//T").when(i % 3 == 1, "tests\\t").otherwise("tests/t"), i % 40),
        F.lit(""),
    )
    old = row(i * 3, F.col("evidence_kind"), F.lit("passed"), (1 + i % 2).cast("long"), F.lit("verified"), F.lit("author 0"), text("tests/t", i % 9), F.lit(""))
    review = row(
        i * 3 + 2,
        F.lit("review"),
        F.when(F.col("toxic") == 0, "passed").otherwise("failed"),
        F.lit(2).cast("long"),
        F.lit("verified"),
        text("author ", i % 4),
        none,
        F.when(i % 3 == 0, text("invariant:", F.col("invariant_id"))).when(i % 3 == 1, text("criterion:", i)).otherwise("other"),
    )
    rows = F.array_compact(F.array(now, F.when(i % 6 < 2, old), F.when(i % 4 < 3, review)))
    seq, command = F.col("seq"), F.col("kind") == "command"
    run = F.when(seq % 4 == 0, "uv run pytest -q").when(seq % 4 == 1, 'bash -c "npm run test"').when(seq % 4 == 2, "pytest tests/t.py").otherwise("make all")
    return _marked(spark, sf_dir).select(i.alias("criterion_id"), *base, F.inline(rows)).select(
        "*",
        F.when(seq % 17 != 0, text("c", seq % 5)).alias("source_commit"),
        (seq % 19 != 0).alias("commit_verified"),
        F.when(F.col("test_ref") != "", seq % 23 != 0).alias("ref_verified"),
        F.when(seq % 4 != 0, "w").alias("fingerprint"),
        F.when(command, run).alias("command_ref"),
    )


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return (
        _marked(spark, sf_dir)
        .where("toxic = 1")
        .select(
            i.alias("violation_id"),
            "invariant_id",
            "requirement_id",
            F.when(i % 2 == 0, "blocking").otherwise("warning").alias("severity"),
            F.when(i % 3 == 0, "resolved").otherwise("open").alias("status"),
        )
    )


# the log of contract commands: requirements, their invariants, and these' criteria; evidence and violations

CONTRACT_LOG_SQL = """log AS (SELECT seq, n, requirement_id, invariant_id, invariant_id * 2 + k % 2 AS criterion_id, op, k, author,
    CASE WHEN op = 'create' OR seq % 4 <> 0 THEN CASE WHEN seq % 3 = 0 THEN 'test' ELSE 'command' END END AS evidence_kind, CASE WHEN op = 'create' OR seq % 4 <> 1 THEN seq % 5 <> 0 END AS required,
    CASE WHEN op = 'create' OR seq % 4 <> 2 THEN seq % 2 = 0 END AS independent_review
  FROM (SELECT event_id AS seq, event_id % 10 AS n, user_id // 3 AS requirement_id, (user_id // 3) * 2 + CAST(floor(value) AS BIGINT) % 2 AS invariant_id,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'author ' || event_id % 3 AS author,
    CASE (event_id // 10) % 8 WHEN 5 THEN 'delete' WHEN 6 THEN 'restore' WHEN 3 THEN 'update' WHEN 4 THEN 'update' WHEN 7 THEN 'update' ELSE 'create' END AS op FROM events)),
  records AS (SELECT seq, criterion_id, requirement_id, invariant_id, CASE seq % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'test' ELSE 'command' END AS kind, CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'passed' END AS result,
    CASE WHEN k % 7 = 0 THEN 'provisional' ELSE 'verified' END AS recorded, author, 'criterion:' || criterion_id AS review_ref FROM log WHERE n IN (6, 7)),
  found AS (SELECT seq AS violation_id, seq, invariant_id, requirement_id, CASE WHEN k % 2 = 0 THEN 'blocking' ELSE 'warning' END AS severity FROM log WHERE n = 8),
  resolves AS (SELECT seq, seq - 1 - 10 * (k % 4) AS violation_id FROM log WHERE n = 9),
  places AS (SELECT requirement_id, ((SELECT max(event_id) FROM events) * (1 + requirement_id % 3)) // 3 AS spot FROM (SELECT DISTINCT requirement_id FROM log))"""


def contract_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, n, requirement_id, invariant_id, criterion_id, op, k, author, evidence_kind, required, independent_review); ``n`` tells what a command is about."""
    i = F.col("event_id")
    requirement = F.floor(F.col("user_id") / 3).cast("long")
    turn = F.floor(i / 10) % 8
    rows = table(spark, sf_dir, "events").select(
        i.alias("seq"),
        (i % 10).alias("n"),
        requirement.alias("requirement_id"),
        (requirement * 2 + F.floor("value") % 2).cast("long").alias("invariant_id"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.concat(F.lit("author "), i % 3).alias("author"),
        F.when(turn == 5, "delete").when(turn == 6, "restore").when(turn.isin(3, 4, 7), "update").otherwise("create").alias("op"),
    )
    seq, create = F.col("seq"), F.col("op") == "create"
    return rows.withColumns(
        {
            "criterion_id": F.col("invariant_id") * 2 + F.col("k") % 2,
            "evidence_kind": F.when(create | (seq % 4 != 0), F.when(seq % 3 == 0, "test").otherwise("command")),
            "required": F.when(create | (seq % 4 != 1), seq % 5 != 0),
            "independent_review": F.when(create | (seq % 4 != 2), seq % 2 == 0),
        }
    )


def contract_records(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a contract log: evidence records, violations and their resolves."""
    seq, k = F.col("seq"), F.col("k")
    records = log.where("n IN (6, 7)").select(
        "seq",
        "criterion_id",
        "requirement_id",
        "invariant_id",
        F.when(seq % 4 == 0, "review").when(seq % 4 == 1, "test").otherwise("command").alias("kind"),
        F.when(k % 5 == 0, "failed").otherwise("passed").alias("result"),
        F.when(k % 7 == 0, "provisional").otherwise("verified").alias("recorded"),
        "author",
        F.concat(F.lit("criterion:"), "criterion_id").alias("review_ref"),
    )
    found = log.where("n = 8").select(seq.alias("violation_id"), "seq", "invariant_id", "requirement_id", F.when(k % 2 == 0, "blocking").otherwise("warning").alias("severity"))
    return records, found, log.where("n = 9").select("seq", (seq - 1 - 10 * (k % 4)).alias("violation_id"))


# the savings log

SAVINGS_SQL = """savings AS (SELECT event_id, event_type AS operation, user_id AS caller, CAST(floor(value) AS BIGINT) AS actual,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS baseline FROM events)"""


def savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("operation"),
        F.col("user_id").alias("caller"),
        F.floor("value").cast("long").alias("actual"),
        F.get_json_object("props", "$.k").cast("long").alias("baseline"),
    )
