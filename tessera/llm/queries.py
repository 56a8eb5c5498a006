"""Registered queries of the operators here, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, line_dedup, mixing, ngram_join, pitman_yor, quality_rules, substring_dedup, token_counts, tool_calls
from .spread import discard, settle, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Labelled documents, of one kind, up to which op5 sends their ids to the executors; a bounded table.
BROADCAST_IDS = 1_000_000


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.apportion(table(spark, sf_dir, "documents"))


@_query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


@_query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.drop_lines(docs, counts=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op8_line_dedup"] = f"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
marked AS (SELECT *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS solid FROM lines),
pages AS (SELECT source, count(*) AS pages FROM documents WHERE text IS NOT NULL GROUP BY source),
often AS (SELECT m.source, m.line FROM marked m JOIN pages p ON m.source IS NOT DISTINCT FROM p.source WHERE m.solid GROUP BY m.source, m.line, p.pages HAVING count(DISTINCT m.doc_id) >= {line_dedup.MIN_PAGES} AND count(DISTINCT m.doc_id) > {line_dedup.MAX_RATIO} * p.pages),
judged AS (SELECT m.*, o.line IS NOT NULL AS gone FROM marked m LEFT JOIN often o ON m.source IS NOT DISTINCT FROM o.source AND m.line = o.line AND m.solid)
SELECT doc_id, count(*) FILTER (WHERE solid) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@_query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents"))


ORACLES["op9_ngram_join"] = """
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p : p + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * common >= 80 * (x.n + y.n - common)),
reached AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT u, min(v) AS component_id FROM reached GROUP BY u) r ON r.u = d.doc_id
"""


@_query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(table(spark, sf_dir, "documents"))


ORACLES["op7_substring_dedup"] = f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, p, array_to_string(w[p : p + {substring_dedup.MIN_WORDS - 1}], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substring_dedup.MIN_WORDS - 2})) AS p FROM texts)),
later AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, p + unnest(range(0, {substring_dedup.MIN_WORDS})) AS i FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
judged AS (SELECT t.doc_id, t.i, t.word, g.i IS NOT NULL AS gone FROM words t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.i = t.i)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(j.n_removed, 0) AS n_removed, sha256(coalesce(j.kept, '')) AS kept_sha256
FROM texts d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM judged GROUP BY doc_id) j ON j.doc_id = d.doc_id
"""


@_query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


@_query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op1_decontamination"] = """
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
grams AS (SELECT doc_id, p, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS p FROM docs)),
keys AS (SELECT item_id, n, s, count(*) AS c FROM (SELECT item_id, len(w) AS n, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS p FROM items)) GROUP BY ALL),
hits AS (SELECT doc_id, item_id, n, p, s, c FROM grams JOIN keys USING (s)),
pairs AS (SELECT DISTINCT doc_id, item_id, n FROM hits),
windows AS (SELECT doc_id, item_id, n, a, least(a + n - 1, size) AS z FROM (SELECT p.*, len(d.w) AS size, unnest(range(1, greatest(1, len(d.w) - n + 1) + 1)) AS a FROM pairs p JOIN docs d USING (doc_id))),
shared AS (SELECT w.doc_id, w.item_id, w.n, w.a, w.z, h.s, least(count(*), max(h.c)) AS k FROM windows w JOIN hits h ON h.doc_id = w.doc_id AND h.item_id = w.item_id AND h.p BETWEEN w.a AND w.z - 4 GROUP BY ALL),
judged AS (SELECT doc_id, item_id, a, z, sum(k)::bigint AS common, (z - 4 - a + 1) + (n - 4) - sum(k)::bigint AS union_ FROM shared GROUP BY doc_id, item_id, n, a, z),
short AS (SELECT d.doc_id, i.item_id, 1.0::double AS similarity, min(a) AS a, len(i.w) AS n FROM items i, (SELECT *, unnest(range(1, len(w) + 1)) AS a FROM docs) d WHERE len(i.w) BETWEEN 1 AND 4 AND d.w[a : a + len(i.w) - 1] = i.w GROUP BY ALL)
SELECT doc_id, item_id, common::double / union_ AS similarity, a - 1 AS first_word, z AS end_word FROM judged WHERE 100 * common >= 80 * union_
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common::double / union_ DESC, a) = 1
UNION ALL SELECT doc_id, item_id, similarity, a - 1, a - 1 + n FROM short
"""


@_query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


TOOLS = [("ask", "text", "string", True), ("ask", "turn", "integer", True), ("ask", "lines", "integer", False), ("follow_up", "text", "string", True), ("follow_up", "turn", "integer", True), ("follow_up", "limit", "number", False)]


@_query
def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of two tools are the user turns of conversations, each behind the one before it and the third behind both; results the assistant turns after them."""
    schemas = spark.createDataFrame(TOOLS, "name string, field string, type string, required boolean")
    return tool_calls.link(tool_calls.as_calls(table(spark, sf_dir, "conversations")), schemas)


ORACLES["op4_tool_calls"] = """
WITH RECURSIVE calls AS (SELECT CAST(conv_id AS varchar) AS conv_id, conv_id || ':' || turn AS call_id, turn, text, CASE WHEN contains(text, chr(10)) THEN length(text) - length(replace(text, chr(10), '')) + 1 END AS lines FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
written AS (SELECT *, '{' || concat_ws(',', CASE WHEN turn >= 6 THEN '"limit":"' || turn || '"' END, '"lines":' || lines, '"text":' || to_json(text)::varchar, '"turn":' || turn) || '}' AS arguments FROM calls),
first AS (SELECT conv_id, call_id, min(turn) AS call_turn, min(arguments) AS arguments, arg_min(text IS NOT NULL AND (turn < 2 OR (lines IS NULL AND turn < 6)), arguments) AS valid, count(*) AS n_calls FROM written GROUP BY ALL),
leveled AS (SELECT conv_id, call_turn, 0::bigint AS level FROM first WHERE call_turn < 2
  UNION ALL SELECT f.conv_id, f.call_turn, l.level + 1 FROM first f JOIN leveled l ON f.conv_id = l.conv_id AND f.call_turn = l.call_turn + 2),
answers AS (SELECT CAST(conv_id AS varchar) AS conv_id, conv_id || ':' || (turn - 1) AS call_id, turn, text FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL),
answer AS (SELECT conv_id, call_id, min(turn) AS result_turn, arg_min(to_json(coalesce(text, ''))::varchar, to_json(coalesce(text, ''))::varchar) AS reply, count(*) AS n_results FROM answers GROUP BY ALL),
named AS (SELECT *, CASE WHEN call_turn < 2 THEN 'ask' ELSE 'follow_up' END AS name FROM first)
SELECT coalesce(f.conv_id, a.conv_id) AS conv_id, coalesce(f.call_id, a.call_id) AS call_id, f.name, f.call_turn,
  CASE WHEN f.call_id IS NOT NULL THEN 0 END::bigint AS slot, result_turn, l.level, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
  CASE WHEN n_calls IS NULL THEN 'orphan' WHEN n_results IS NULL THEN 'unanswered' ELSE 'linked' END AS status, f.valid,
  '{"arguments":' || coalesce(f.arguments, 'null') || ',"call_id":' || to_json(coalesce(f.call_id, a.call_id))::varchar || ',"name":' || coalesce('"' || f.name || '"', 'null') || ',"result":' || coalesce(a.reply, 'null') || '}' AS json
FROM named f FULL OUTER JOIN answer a ON f.conv_id = a.conv_id AND f.call_id = a.call_id LEFT JOIN leveled l ON f.conv_id = l.conv_id AND f.call_turn = l.call_turn
"""


@_query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in; those labelled toxic go; those of low quality are counted anew as their whole text with its white space made single spaces. The second batch is sent twice."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_d"), "quality", "toxic")

    def of(rows: DataFrame, which: str) -> DataFrame:
        ids = labels.where(which).select("_d")
        few = ids.count() <= BROADCAST_IDS  # then the ids go to the texts, not the texts to the ids
        return rows.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("_d"), "left_semi")

    poor = "quality = 0 AND toxic = 0"
    whole = settle(token_counts.count_tokens(docs))
    tidy = token_counts.count_tokens(of(docs, poor).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))))
    rollup = token_counts.Rollup(spark, shared_dir(spark))
    rollup.commit("load", token_counts.signed(whole, 1))
    for _ in range(2):
        rollup.commit("toxic", token_counts.signed(of(whole, "toxic = 1"), -1))
    rollup.commit("poor", token_counts.revised(of(whole, poor), tidy))
    discard(whole)
    return rollup.totals()
