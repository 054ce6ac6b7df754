"""Registered queries over prompts, answers and conversations. Every user message is a question;
the assistant's messages in the six turns after it are its hits, in order of turn."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions.text import technology_name
from corpusloom.operators import prompts
from corpusloom.plans.tables import documents, table

TECH = "CASE conv_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'django' WHEN 2 THEN 'unknown' END"
MODE = "CASE conv_id % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'detailed' ELSE 'smart' END"
QUERY_ID = "conv_id * 100000 + turn"
REACH = 6  # turns
ANSWER_MODE = "CASE conv_id % 2 WHEN 0 THEN 'code_generation' ELSE 'smart_answer' END"


def _questions(spark, sf_dir):
    """One question for each user turn, with technology and modes."""
    talk = table(spark, sf_dir, "conversations").where("role = 'user'")
    return talk.select(F.expr(QUERY_ID).alias("query_id"), F.col("text").alias("question"), F.expr(TECH).alias("technology"),
                       F.expr(MODE).alias("mode"), F.expr(ANSWER_MODE).alias("response_mode"))


def _hits(spark, sf_dir):
    """A message is a hit of the questions at most six turns before it."""
    talk = table(spark, sf_dir, "conversations")
    near = F.transform(F.sequence(F.lit(1), F.lit(REACH)), lambda n: F.col("turn") - n)
    replies = talk.where("role = 'assistant'").select("conv_id", "turn", "text", F.explode(near).alias("asked"))
    questions = talk.where("role = 'user'").select("conv_id", F.col("turn").alias("asked"))
    found = replies.join(questions, ["conv_id", "asked"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("conv_id", "asked").orderBy("turn"))
    ranked = found.withColumn("rank", rank.cast("bigint"))
    return ranked.select(
        (F.col("conv_id") * 100000 + F.col("asked")).alias("query_id"), "rank", F.col("turn").cast("string").alias("id"),
        F.when(F.col("turn") % 3 > 0, F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("title"),
        F.col("text").alias("content"), F.round(F.lit(1.0) / F.col("rank"), 6).alias("score"),
    )


def provider_prompts(spark, sf_dir):
    """Full prompts for each kind of model; questions without hits have no context."""
    return prompts.provider_prompts(_questions(spark, sf_dir).select("query_id", "question"), _hits(spark, sf_dir))


def chat_messages(spark, sf_dir):
    asked, found = _questions(spark, sf_dir).select("query_id", "question"), _hits(spark, sf_dir)
    made = prompts.prompts(asked, prompts.context_blocks(found, "openai"), "openai")
    return made.select("query_id", F.posexplode("messages").alias("place", "message")).select(
        "query_id", F.col("place").cast("bigint").alias("place"), "message.role", "message.content"
    )


def code_prompts(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "lang")
    request = prompts.styled_request(F.lit("complete"), "lang", "content")
    return docs.select(
        "doc_id", F.md5(prompts.code_prompt(request, "lang")).alias("code_prompt"),
        F.md5(prompts.explain_prompt("content", "lang")).alias("explain_prompt"),
    )


def mode_questions(spark, sf_dir):
    asked = _questions(spark, sf_dir)
    return asked.select(
        "query_id",
        prompts.mode_question("response_mode", "question").alias("plain"),
        prompts.mode_question("response_mode", "question", technology_name("technology", None)).alias("with_tech"),
        prompts.technology_question("mode", "question", "technology").alias("technology_question"),
    )


def answer_records(spark, sf_dir):
    """The second assistant message stands for the generated answer."""
    asked, found = _questions(spark, sf_dir), _hits(spark, sf_dir)
    answers = found.where("rank = 2").select("query_id", F.col("content").alias("answer"))
    out = prompts.answer_records(asked, found, answers)
    return out.select(
        "query_id", "answer", "source_count", "technology_context", "response_mode",
        F.array_join(F.transform("sources", lambda s: s["id"]), ",").alias("source_ids"),
    )


def message_order(spark, sf_dir):
    out = prompts.numbered_messages(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "message_no")


def transcripts(spark, sf_dir):
    return prompts.transcripts(table(spark, sf_dir, "conversations"))


def transcript_pages(spark, sf_dir):
    """The same in pages of four turns."""
    return prompts.transcripts(table(spark, sf_dir, "conversations"), page_turns=4)


QUERIES = {f.__name__: f for f in (
    provider_prompts, chat_messages, code_prompts, mode_questions, answer_records, message_order,
    transcripts, transcript_pages,
)}


def _text(template: str, **values: str) -> str:
    """Template as an SQL concatenation."""
    from corpusloom.plans.split_sql import quoted

    for name, value in values.items():
        template = template.replace("{" + name + "}", f"\x00{value}\x00")
    parts = template.split("\x00")
    return "(" + " || ".join(p if i % 2 else quoted(p) for i, p in enumerate(parts) if i % 2 or p) + ")"


_Q = f"""asked AS (SELECT {QUERY_ID} AS query_id, text AS question, {TECH} AS technology, {MODE} AS mode,
  {ANSWER_MODE} AS response_mode FROM conversations WHERE role = 'user'),
hits AS (SELECT q.conv_id * 100000 + q.turn AS query_id, a.turn, row_number() OVER (PARTITION BY q.conv_id, q.turn ORDER BY a.turn) AS rank,
  a.turn::VARCHAR AS id, CASE WHEN a.turn % 3 > 0 THEN 'turn ' || a.turn END AS title, a.text AS content
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn BETWEEN q.turn + 1 AND q.turn + {REACH}
  WHERE q.role = 'user' AND a.role = 'assistant')"""


def _context(name: str) -> str:
    from corpusloom.plans.split_sql import quoted

    return f"""coalesce((SELECT {quoted(prompts.CONTEXT_HEAD[name])} || string_agg(chr(10) || rank || '. From ''' || coalesce(title, 'Unknown') || ''':' || chr(10)
    || left(content, {prompts.CONTEXT_CHARS[name]}) || '...' || chr(10), '' ORDER BY rank) FROM hits h WHERE h.query_id = a.query_id AND rank <= 3), '')"""


_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.TECHNOLOGIES.items())
_TECH = f"(CASE technology {_NAMES} END)"
_MODES = " ".join(f"WHEN '{m}' THEN {_text(t, question='question', tech=_TECH)}" for m, t in prompts.TECH_QUESTIONS.items())

ORACLE = {
    "provider_prompts": f"WITH {_Q} " + " UNION ALL ".join(
        f"SELECT query_id, '{n}' AS provider, {_text(t, context='context', question='question')} AS prompt "
        f"FROM (SELECT query_id, question, {_context(n)} AS context FROM asked a)" for n, t in prompts.PROMPTS.items()),
    "chat_messages": f"""WITH {_Q} SELECT query_id, 0::BIGINT AS place, 'system' AS role, {_text(prompts.SYSTEM_MESSAGE)} AS content FROM asked
UNION ALL SELECT query_id, 1, 'user', {_context('openai')} || chr(10) || chr(10) || 'Question: ' || question FROM asked a""",
    "code_prompts": f"""SELECT doc_id, md5({_text(prompts.CODE_PROMPT, language='lang', prompt="('Generate complete ' || lang || ' code. Request: ' || text)")}) AS code_prompt,
  md5({_text(prompts.EXPLAIN_PROMPT, language='lang', code='text')}) AS explain_prompt FROM documents""",
    "mode_questions": f"""WITH {_Q} SELECT query_id,
  CASE WHEN response_mode = 'code_generation' THEN {_text(prompts.CODE_QUESTION, question='question')} ELSE 'Question: ' || question END AS plain,
  CASE WHEN response_mode = 'code_generation' THEN CASE WHEN {_TECH} IS NULL THEN {_text(prompts.CODE_QUESTION, question='question')}
    ELSE {_text(prompts.CODE_QUESTION_WITH_TECH, question='question', tech=_TECH)} END ELSE 'Question: ' || question END AS with_tech,
  CASE WHEN {_TECH} IS NOT NULL THEN CASE mode {_MODES} END END AS technology_question FROM asked""",
    "answer_records": f"""WITH {_Q}, n AS (SELECT query_id, count(*) AS c, string_agg(id, ',' ORDER BY rank) AS ids,
  max(CASE WHEN rank = 2 THEN content END) AS answer FROM hits WHERE rank <= 100 GROUP BY query_id)
SELECT a.query_id, answer, coalesce(c, 0) AS source_count, {_TECH} AS technology_context, response_mode, ids AS source_ids
FROM asked a LEFT JOIN n ON a.query_id = n.query_id""",
    "message_order": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message_no FROM conversations",
    "transcripts": """SELECT conv_id, turn // 1000 AS page, count(*) AS messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript
FROM conversations GROUP BY conv_id, turn // 1000""",
    "transcript_pages": """SELECT conv_id, turn // 4 AS page, count(*) AS messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript
FROM conversations GROUP BY conv_id, turn // 4""",
}
