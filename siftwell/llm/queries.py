"""The registered queries of the thirteen training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftwell.llm.chat_snapshots import render
from siftwell.llm.common import table
from siftwell.llm.compression_bands import compression_bands
from siftwell.llm.conversation_repair import repaired_digests
from siftwell.llm.discriminant import quality_scores
from siftwell.llm.feistel_pii import pseudonymise, session_key
from siftwell.llm.maxent_lm import score_documents
from siftwell.llm.mixing_coder import write_and_read
from siftwell.llm.order_minhash import classes
from siftwell.llm.ppm_language import identify
from siftwell.llm.prefix_bpe import encode_and_decode
from siftwell.llm.pstable_dedup import near_vectors
from siftwell.llm.qgram_decontamination import contamination
from siftwell.llm.yinyang_codes import vector_codes


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def op3_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


def op8_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a session without a key of its own gets a published one here, for comparison only: anyone can undo it
    return pseudonymise(docs, session_key(spark, b"siftwell demonstration key"), count="n_replaced")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_digests(table(spark, sf_dir, "conversations"))


def op12_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_pstable_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compression_bands": op1_compression_bands,
    "op2_order_minhash": op2_order_minhash,
    "op3_quadratic_discriminant": op3_quadratic_discriminant,
    "op4_mixing_coder": op4_mixing_coder,
    "op5_prefix_bpe": op5_prefix_bpe,
    "op6_maxent_lm": op6_maxent_lm,
    "op7_chat_snapshots": op7_chat_snapshots,
    "op8_qgram_decontamination": op8_qgram_decontamination,
    "op9_ppm_language": op9_ppm_language,
    "op10_feistel_pii": op10_feistel_pii,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_yinyang_codes": op12_yinyang_codes,
    "op13_pstable_dedup": op13_pstable_dedup,
}


def _crc32(text: str) -> str:
    """crc32 of an ASCII text: the register shifts once for each bit of it."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> i) & 1)))"
    register = f"list_reduce(list_prepend(4294967295, {bits}), lambda h, b: xor(h >> 1, 3988292384 * (xor(h, b) & 1)))"
    return f"xor({register}, 4294967295)"


def _repair_sql() -> str:
    """A state is its cost in twelve digits and then its audit, so that the least string is the cheapest edit, then the ASCII-least."""
    never = "'999999999999'"
    paid = lambda state, cost, letter: f"lpad(CAST(CAST({state}[1:12] AS BIGINT) + {cost} AS VARCHAR), 12, '0') || {state}[13:] || {letter}"
    after_u = lambda n, s, u, a: f"least({u}, {', '.join(paid(x, 3, chr(39) + 'I' + chr(39)) for x in (n, s, a))})"
    taken = lambda state, initial: f"CASE WHEN f.fault IN ('b', 'd') THEN {never} ELSE {paid(state, f'f.more + CASE WHEN f.initial = {initial} THEN 0 ELSE 3 END', f'CASE WHEN f.initial = {initial} THEN {chr(39)}K{chr(39)} ELSE {chr(39)}R{chr(39)} END')} END"
    gone = lambda c: paid(c, 4, "'D'")
    insert = "'I'"
    return f"""
        WITH RECURSIVE damaged AS (
          SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, copy,
            CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
          FROM (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
              {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations
          ), (SELECT unnest([0, 1]) AS copy) WHERE k <> 0 AND (copy = 0 OR k = 3)
        ), placed AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS two,
            regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS trimmed
          FROM (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM damaged)
        ), faults AS MATERIALIZED (
          SELECT *, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS more FROM (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN again > 1 THEN 'd'
              WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed)
        ), fold AS (
          SELECT conv_id, 0 AS place, '000000000000' AS n, {never} AS s, '000000000003I' AS u, '000000000006II' AS a FROM (SELECT DISTINCT conv_id FROM conversations)
          UNION ALL
          SELECT conv_id, place, n, s, u, least(a, {paid("u", 3, insert)}) FROM (
            SELECT conv_id, place, n, s, {after_u("n", "s", "u", "a")} AS u, a FROM (
              SELECT o.conv_id, f.place, {gone("o.n")} AS n,
                least({gone("o.s")}, CASE WHEN f.initial = 's' AND f.fault NOT IN ('b', 'd') THEN {paid("o.n", "f.more", "'K'")} ELSE {never} END) AS s,
                least({gone("o.u")}, {taken("least(o.n, o.s, o.a)", "'u'")}) AS u, least({gone("o.a")}, {taken("o.u", "'a'")}) AS a
              FROM fold o JOIN faults f ON o.conv_id IS NOT DISTINCT FROM f.conv_id AND f.place = o.place + 1))
        ), best AS (
          SELECT conv_id, least(n, a) AS x FROM fold QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1
        ), edits AS (
          SELECT conv_id, i, edit, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER w AS place, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER w - 1 AS said
          FROM (SELECT conv_id, i, x[12 + i] AS edit FROM (SELECT conv_id, x, unnest(range(1, len(x) - 11)) AS i FROM best))
          WINDOW w AS (PARTITION BY conv_id ORDER BY i)
        ), turned AS (
          SELECT e.conv_id, e.i, e.edit, e.said, f.role, f.text,
            max(CASE WHEN e.said = 0 AND e.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS first
          FROM edits e LEFT JOIN faults f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.place = f.place AND e.edit <> 'I' WHERE e.edit <> 'D'
        ), repaired AS (
          SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (said - first) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS said
          FROM turned GROUP BY conv_id
        ), counts AS (
          SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
            count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id
        )
        SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
          coalesce(illegal, 0) AS illegal, CAST(x[1:12] AS BIGINT) AS cost, x[13:] AS audit, sha256(coalesce(r.said, '')) AS repaired_sha256
        FROM best b LEFT JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON b.conv_id IS NOT DISTINCT FROM r.conv_id
    """


def _codes_sql(rounds: int = 4) -> str:
    """Every distance of every round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""assigned{k} AS MATERIALIZED (
          SELECT rid, p, x, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS best
          FROM parts JOIN book{k} USING (p) GROUP BY rid, p, x
        )""")
        if k < rounds:
            steps.append(f"""sums{k} AS (
          SELECT p, best % 256 AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS i FROM assigned{k}) GROUP BY ALL
        ), new{k} AS (
          SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM sums{k} GROUP BY p, e
        ), book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(new{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN new{k} USING (p, e))""")
    return f"""
        WITH kept AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS rid, * FROM (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
        ), parts AS MATERIALIZED (SELECT rid, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS p)),
        book0 AS MATERIALIZED (SELECT p, rid AS e, x AS c FROM parts WHERE rid < 256),
        {", ".join(steps)},
        coded AS (
          SELECT rid, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM assigned{rounds} GROUP BY rid
        ), books AS (
          SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), books
    """

ORACLE_SQL: dict[str, str] = {
    "op7_chat_snapshots": """
        WITH turns AS (
          SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
          FROM conversations WHERE conv_id IS NOT NULL
        ), placed AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS pos FROM turns
        ), prefixes AS (
          SELECT conv_id, pos, list(role || chr(1) || text) OVER (PARTITION BY conv_id ORDER BY pos) AS said FROM placed
        ), whole AS (
          SELECT conv_id, len(said) AS n_turns, said FROM prefixes
          QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1
        ), strict AS (
          SELECT DISTINCT p.said FROM prefixes p JOIN whole w ON p.conv_id = w.conv_id WHERE p.pos < w.n_turns - 1
        ), kept AS (
          SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_copies FROM whole
          WHERE said NOT IN (SELECT said FROM strict) GROUP BY said
        )
        SELECT k.conv_id, p.pos // 256 AS segment, CAST(k.n_turns AS BIGINT) AS n_turns, k.n_copies,
          string_agg('<|im_start|>' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10), '' ORDER BY p.pos) AS rendered
        FROM kept k JOIN placed p ON p.conv_id = k.conv_id GROUP BY ALL
    """,
    "op11_conversation_repair": _repair_sql(),
    "op12_yinyang_codes": _codes_sql(),
    "op13_pstable_dedup": """
        WITH RECURSIVE v AS MATERIALIZED (
          SELECT row_number() OVER () AS rid, vec_id, embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok,
            CAST(embedding AS DOUBLE[]) AS x FROM embeddings
        ), links AS MATERIALIZED (
          SELECT a.rid AS u, b.rid AS w FROM v a JOIN v b ON a.rid <> b.rid AND a.ok AND b.ok AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9
        ), reached AS (
          SELECT rid AS u, rid AS w FROM v
          UNION
          SELECT r.u, l.w FROM reached r JOIN links l ON r.w = l.u
        ), least AS (SELECT r.u AS rid, min(v.vec_id) AS component_id FROM reached r JOIN v ON v.rid = r.w GROUP BY r.u),
        counts AS (SELECT u AS rid, count(*) AS n FROM links GROUP BY u)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
        FROM v JOIN least USING (rid) LEFT JOIN counts USING (rid)
    """,
}
