"""Queries over conversations and over questions with answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.functions import text as fn
from lexlake.operators import conversations as ops
from lexlake.plans.catalogue import query, table


@query("""SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn, substr(arg_min(text, turn) FILTER (role = 'user'), 1, 100) AS preview FROM conversations GROUP BY conv_id""")
def list_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with its size and the start of its first question."""
    return ops.listing(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, role, age, age = 0 AS is_immediate FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS age FROM conversations WHERE role = 'assistant') WHERE age < 3")
def context_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three answers of every conversation."""
    return ops.context_history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.col("age").cast("long").alias("age"), "is_immediate")


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest answer of every conversation."""
    return ops.last_context(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4")
def last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four messages of every conversation."""
    return ops.last_messages(table(spark, sf_dir, "conversations"), 4).select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages left after their owners deleted the conversations with a system message."""
    messages = table(spark, sf_dir, "conversations")
    parents = messages.groupBy("conv_id").agg(F.min_by("role", "turn").alias("owner"))
    gone = parents.join(messages.filter("role = 'system'").select("conv_id"), "conv_id", "left_semi")
    return ops.deleted(parents, messages, gone, "conv_id", "owner")[1].select("conv_id", "turn", "role")


@query(r"""WITH m AS (SELECT conv_id, turn, lower(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS q, len(regexp_extract_all(text, '\S+')) AS n,
    coalesce(bool_or(role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS prev FROM conversations),
  w AS (SELECT *, list_filter(regexp_split_to_array(q, '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS words, regexp_replace(q, '[^\p{L}\p{N}_]+', ' ', 'g') AS flat FROM m),
  d AS (SELECT *, list_has_any(words, ['artículo', 'articulo', 'ley', 'leyes', 'normativa', 'normativo', 'código', 'codigo', 'reglamento', 'decreto', 'constitución', 'constitucion', 'sentencia', 'jurisprudencia',
      'tribunal', 'juzgado', 'demanda', 'recurso', 'apelación', 'apelacion', 'casación', 'casacion', 'amparo', 'disposición', 'disposicion', 'transitoria', 'derogatoria'])
    OR regexp_matches(q, '(^|[^\p{L}\p{N}_])art\.[\p{L}\p{N}_]') OR regexp_matches(q, '(^|[^\p{L}\p{N}_])(habeas corpus|orden ministerial)([^\p{L}\p{N}_]|$)') AS legal,
    trim(q, '¿?') IN ('está seguro', 'estás seguro', 'esta seguro', 'estas seguro', 'seguro', 'de verdad', 'en serio', 'por qué', 'cómo') AND NOT q LIKE '%?_%' AND NOT q LIKE '%_¿%' OR q IN ('ok', 'vale', 'entiendo', 'ya veo') AS remark FROM w)
  SELECT conv_id, turn, CASE WHEN n > 6 THEN 'query_too_long' WHEN legal THEN 'contains_legal_terms' WHEN remark AND prev THEN 'matches_clarification_pattern' WHEN NOT prev THEN 'no_previous_context' ELSE 'default' END AS reason FROM d""")
def context_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each message needs a search, and why."""
    rows = fn.with_previous_answer(table(spark, sf_dir, "conversations"))
    decided = fn.context_decision(F.col("text"), F.col("has_previous"))
    return rows.select("conv_id", "turn", decided["reason"].alias("reason"))


@query("""SELECT round(100.0 * sum(CASE WHEN quality = toxic THEN 1 ELSE 0 END) / count(*), 4) AS score, count(*) AS answered FROM labels WHERE quality IS NOT NULL""")
def exam_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of right answers among the answered, in percent (a pair of labels stands in for answer and key)."""
    from lexlake.operators.evaluation import score

    rows = table(spark, sf_dir, "labels").select(F.col("quality").alias("answer"), F.col("toxic").alias("key"))
    return score(rows).select(F.round("score", 4).alias("score"), "answered")


@query("""SELECT b.item_id, b.text AS question, l.quality, l.toxic FROM benchmark b LEFT JOIN labels l ON l.doc_id = b.item_id""")
def question_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their key, where there is one."""
    questions = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "question")
    key = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "item_id")
    return questions.join(key, "item_id", "left").select("item_id", "question", "quality", "toxic")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  r AS (SELECT user_id, event_id, value, k, value <= 2000.0 AS accepted, CASE WHEN value <= 2000.0 THEN 2000.0 - value ELSE 2000.0 END::DOUBLE AS balance FROM o WHERE k = 1
    UNION ALL SELECT o.user_id, o.event_id, o.value, o.k, o.value <= r.balance, CASE WHEN o.value <= r.balance THEN r.balance - o.value ELSE r.balance END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
  SELECT user_id, event_id, round(value, 2) AS value, accepted, round(balance, 2) AS "left" FROM r""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of every user against a balance of 2000, those that don't fit rejected without effect."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return ops.budget(rows, 2000, "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", F.round("value", 2).alias("value"), "accepted", F.round("left", 2).alias("left"))


@query("""SELECT e.event_id, e.event_id % 100 AS conv_id, e.event_id % 3 AS turn FROM events e
  WHERE (e.event_id % 100, e.event_id % 3) IN (SELECT (conv_id, turn) FROM conversations) AND e.user_id % 7 = (e.event_id % 100) % 7""")
def owned_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback (events stand in) on messages that exist, by the owners of their conversations."""
    marks = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 100).alias("conv_id"), (F.col("event_id") % 3).alias("turn"), (F.col("user_id") % 7).alias("user_id"))
    messages = table(spark, sf_dir, "conversations")
    owners = messages.select("conv_id", (F.col("conv_id") % 7).alias("user_id")).distinct()
    return ops.owned_feedback(marks, messages, owners).select("event_id", "conv_id", "turn")
