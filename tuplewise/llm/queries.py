"""The registered queries of this subpackage, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewise.llm.common import shared_folder, table
from tuplewise.llm.decontaminate import decontaminate
from tuplewise.llm.importance import importance_resample
from tuplewise.llm.near_duplicates import near_duplicates
from tuplewise.llm.pieces import encode_decode
from tuplewise.llm.quality_rules import quality_rules
from tuplewise.llm.substring_dedup import substring_dedup
from tuplewise.llm.token_counts import token_counts
from tuplewise.llm.tool_calls import link_tool_calls
from tuplewise.llm.toxicity import toxicity
from tuplewise.llm.warc import read_warc, write_warc


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the machine's public tokenizers keep a vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


REPLY_SCHEMA = """{"type": "object", "required": ["prompt", "turn"], "additionalProperties": false,
 "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 250}, "turn": {"type": "integer", "minimum": 0}}}"""


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "hit_from", "hit_to", "text_hash")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, model_path()).drop("text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), model_path())


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn as a call, each assistant turn as the result of the turn before it.

    A call follows the user's turn before (two turns back); in every fourth
    conversation it waits for the next one instead, in another fourth the first two
    wait for each other, and in the last a third call on waits for one that doesn't
    exist too.  Long prompts break the schema, some turns call a tool without one, and
    some first turns have broken JSON.
    """
    turns = table(spark, sf_dir, "conversations")
    call = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    turn, kind = F.col("turn"), F.col("conv_id") % 4
    before = F.when(turn >= 2, call(turn - 2))
    after = (
        F.when(kind == 1, F.array(call(turn + 2)))
        .when(kind == 2, F.array(F.when(turn < 2, call(turn + 2)).otherwise(call(turn - 2))))
        .when((kind == 3) & (turn >= 4), F.array(before, F.lit("call_99")))
        .otherwise(F.array(before))
    )
    arguments = F.to_json(F.struct(turn.alias("turn"), F.col("text").alias("prompt")))
    broken = (F.col("conv_id") % 5 == 4) & (turn < 2)
    calls = turns.filter("role = 'user'").select(
        "conv_id", call(turn).alias("call_id"), "turn", F.when(turn % 6 == 4, "search").otherwise("reply").alias("name"),
        F.when(broken, F.concat(arguments, F.lit("}"))).otherwise(arguments).alias("arguments"), after.alias("after"),
    )
    results = turns.filter("role = 'assistant'").select("conv_id", call(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    schemas = spark.createDataFrame([("reply", REPLY_SCHEMA)], "name string, schema string")
    return link_tool_calls(calls, results, schemas).withColumns({"errors": F.array_join("errors", "; "), "level": F.col("level").cast("long")})


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "group")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance": op1_importance,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc": op3_warc,
    "op4_pieces": op4_pieces,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_tool_calls": op8_tool_calls,
    "op9_toxicity": op9_toxicity,
    "op10_near_duplicates": op10_near_duplicates,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP2_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH item AS (
  SELECT item_id, {_OP2_WORDS} AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, len(w[s : s + 12]) AS n, array_to_string(w[s : s + 12], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, {_OP2_WORDS} AS w FROM documents
), pos AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
  FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n
), hit AS (
  SELECT p.doc_id, p.s, p.n, win.item_id
  FROM (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM pos) p JOIN win ON p.g = win.g AND p.n = win.n
), word AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP3_SQL = r"""
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to,
  replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url
FROM (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first
  FROM (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages))
"""

OP8_SQL = """
WITH RECURSIVE call AS (
  SELECT conv_id, turn, 'call_' || turn AS id, text, CASE WHEN turn % 6 = 4 THEN 'search' ELSE 'reply' END AS name, conv_id % 5 = 4 AND turn < 2 AS broken,
    CASE WHEN conv_id % 4 = 1 OR conv_id % 4 = 2 AND turn < 2 THEN 'call_' || (turn + 2) WHEN turn >= 2 THEN 'call_' || (turn - 2) END AS dep,
    CASE WHEN conv_id % 4 = 3 AND turn >= 4 THEN 'call_99' END AS more
  FROM conversations WHERE role = 'user'
), answer AS (
  SELECT conv_id, 'call_' || (turn - 1) AS id, turn, text FROM conversations WHERE role = 'assistant'
), edge AS (
  SELECT a.conv_id, a.id, a.dep FROM call a JOIN call b ON b.conv_id = a.conv_id AND b.id = a.dep
), reach AS (
  SELECT conv_id, id, dep FROM edge
  UNION
  SELECT reach.conv_id, reach.id, edge.dep FROM reach JOIN edge ON edge.conv_id = reach.conv_id AND edge.id = reach.dep
), cyclic AS (
  SELECT DISTINCT a.conv_id, a.id FROM reach a JOIN reach b ON b.conv_id = a.conv_id AND b.id = a.dep AND b.dep = a.dep
), path AS (
  SELECT conv_id, id, 0 AS n FROM call
  UNION
  SELECT edge.conv_id, edge.id, n + 1 FROM path JOIN edge ON edge.conv_id = path.conv_id AND edge.dep = path.id WHERE n < 1000
    AND NOT EXISTS (SELECT 1 FROM cyclic c WHERE c.conv_id = edge.conv_id AND c.id = edge.id)
), level AS (
  SELECT conv_id, id, max(n) AS level FROM path GROUP BY conv_id, id
), judged AS (
  SELECT call.*, CASE WHEN y.id IS NULL THEN level END AS level, concat_ws('; ',
      CASE WHEN dep IS NOT NULL AND NOT EXISTS (SELECT 1 FROM call b WHERE b.conv_id = call.conv_id AND b.id = call.dep) THEN 'no such dependency: ' || dep END,
      CASE WHEN more IS NOT NULL THEN 'no such dependency: ' || more END, CASE WHEN y.id IS NOT NULL THEN 'waits on a cycle' END,
      CASE WHEN broken THEN '$: broken JSON' WHEN name = 'search' THEN 'no such tool' WHEN text IS NULL THEN '$.prompt: missing'
        WHEN length(text) = 0 THEN '$.prompt: too short' WHEN length(text) > 250 THEN '$.prompt: too long' END) AS errors
  FROM call LEFT JOIN level USING (conv_id, id) LEFT JOIN cyclic y ON y.conv_id = call.conv_id AND y.id = call.id
), linked AS (
  SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.id, a.id) AS call_id, coalesce(c.turn, a.turn) AS turn, c.turn IS NOT NULL AS called, level, coalesce(errors, '') AS errors,
    CASE WHEN c.turn IS NULL THEN 'no call' WHEN a.turn IS NULL THEN 'no result' ELSE 'linked' END AS status, name,
    '[' || concat_ws(',', '"' || dep || '"', '"' || more || '"') || ']' AS after,
    CASE WHEN c.turn IS NULL OR broken THEN 'null' ELSE '{' || coalesce('"prompt":' || to_json(c.text) || ',', '') || '"turn":' || c.turn || '}' END AS arguments,
    coalesce(CAST(to_json(a.text) AS VARCHAR), 'null') AS result
  FROM judged c FULL JOIN answer a ON a.conv_id = c.conv_id AND a.id = c.id
)
SELECT CAST(conv_id AS VARCHAR) AS conv_id, call_id, CAST(level AS BIGINT) AS level, turn, status, called AND errors = '' AS valid, errors,
  '{"after":' || after || ',"arguments":' || arguments || ',"id":"' || call_id || '","name":' || coalesce('"' || name || '"', 'null')
    || ',"result":' || result || ',"status":"' || status || '"}' AS json
FROM linked
"""

OP10_SQL = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[s : s + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM doc WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT a, b FROM pair JOIN size sa ON a = sa.doc_id JOIN size sb ON b = sb.doc_id WHERE 100 * pair.n >= 75 * (sa.n + sb.n - pair.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM doc
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT doc.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, c.component_id, doc.doc_id = c.component_id AS kept
FROM doc JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = doc.doc_id LEFT JOIN size ON size.doc_id = doc.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op8_tool_calls": OP8_SQL,
    "op10_near_duplicates": OP10_SQL,
}
