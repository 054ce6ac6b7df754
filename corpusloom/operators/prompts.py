"""Hits to prompts ready for batch inference, answer records, conversation transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions.text import _col, preview, technology_name
from corpusloom.operators.joins import numbered

# What each kind of model is told. {context}, {question}, {language}, {prompt},
# {code}, {tech} are filled in per row.
CONTEXT_CHARS = {"ollama": 500, "openai": 800, "gemini": 800}
CONTEXT_HEAD = {
    "ollama": "\n\nContext from documents:\n",
    "openai": "Context from documents:\n",
    "gemini": "Context from documents:\n",
}
SYSTEM_MESSAGE = (
    "You are a helpful assistant that answers questions based on provided context. If the "
    "context doesn't contain relevant information, say so and provide general guidance."
)
PROMPTS = {
    "ollama": "{context}\n\nQuestion: {question}\n\nAnswer based on the context above:",
    "openai": "{context}\n\nQuestion: {question}",
    "gemini": (
        "Based on the following context, please answer the question. If the context doesn't "
        "contain relevant information, provide general guidance.\n\n{context}\n\n"
        "Question: {question}\n\nAnswer:"
    ),
}
CODE_PROMPT = (
    "Generate {language} code for the following request:\n\nRequest: {prompt}\n\n"
    "Please provide:\n1. Clean, well-documented code\n2. Comments explaining the logic\n"
    "3. Example usage if applicable\n\nRequirements:\n- Follow best practices for {language}\n"
    "- Include error handling where appropriate\n- Make the code production-ready\n\nCode:"
)
EXPLAIN_PROMPT = (
    "Please explain the following {language} code:\n\n```{language}\n{code}\n```\n\nProvide:\n"
    "1. Overview of what the code does\n2. Explanation of key functions/methods\n"
    "3. Any potential improvements\n4. How to use it\n\nExplanation:"
)
QUESTION = "Question: {question}"
CODE_QUESTION = "Provide a complete code implementation for: {question}"
CODE_QUESTION_WITH_TECH = "Using {tech}, Provide a complete code implementation for: {question}"
STYLED_REQUEST = "Generate {style} {language} code. Request: {prompt}"
TECH_QUESTIONS = {
    "code": "Provide {tech} code implementation for: {question}",
    "detailed": "Provide detailed {tech} documentation and examples for: {question}",
    "smart": "Explain how to {question} using {tech}. Include practical examples.",
}


def fill(template: str, **values: Column | str) -> Column:
    """Template as a concatenation; ``{name}`` is replaced by the column of that name."""
    parts: list[Column] = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        if i % 2:
            parts.append(F.coalesce(_col(values[piece]).cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _block(rank: Column, title: Column, content: Column, provider: str) -> Column:
    return F.concat(
        F.lit("\n"), rank.cast("string"), F.lit(". From '"), F.coalesce(title, F.lit("Unknown")), F.lit("':\n"),
        preview(F.coalesce(content, F.lit("")), CONTEXT_CHARS[provider]), F.lit("...\n"),
    )


def context_blocks(
    hits: DataFrame, provider: str = "ollama", query_id: str = "query_id", limit: int = C.CONTEXT_HITS
) -> DataFrame:
    """Context text per question from its best hits (query id, rank, title, content)."""
    few = hits.where(F.col("rank") <= limit).select(
        query_id,
        F.col("rank"),
        _block(F.col("rank"), F.col("title"), F.col("content"), provider).alias("_block"),
    )
    # At most ``limit`` short blocks per question are collected.
    ordered = F.array_sort(F.collect_list(F.struct("rank", "_block")))
    joined = F.array_join(F.transform(ordered, lambda s: s["_block"]), "")
    return few.groupBy(query_id).agg(F.concat(F.lit(CONTEXT_HEAD[provider]), joined).alias("context"))


def provider_prompts(questions: DataFrame, hits: DataFrame, providers: list[str] | None = None,
                     query_id: str = "query_id", limit: int = C.CONTEXT_HITS) -> DataFrame:
    """query id, provider and prompt for several kinds of model: one aggregation of the hits
    serves all of them."""
    names = list(providers or PROMPTS)
    few = hits.where(F.col("rank") <= limit).select(query_id, F.struct("rank", "title", "content").alias("_hit"))
    best = few.groupBy(query_id).agg(F.array_sort(F.collect_list("_hit")).alias("_hits"))  # at most ``limit``

    def context(name: str) -> Column:
        blocks = F.transform("_hits", lambda h: _block(h["rank"], h["title"], h["content"], name))
        return F.coalesce(F.concat(F.lit(CONTEXT_HEAD[name]), F.array_join(blocks, "")), F.lit(""))

    made = [
        F.struct(F.lit(n).alias("provider"), fill(PROMPTS[n], context=context(n), question="question").alias("prompt"))
        for n in names
    ]
    return questions.join(best, query_id, "left").select(query_id, F.inline(F.array(*made)))


def prompts(questions: DataFrame, contexts: DataFrame, provider: str = "ollama",
            query_id: str = "query_id", question: str = "question") -> DataFrame:
    """Full prompt per question; without hits the context is empty."""
    joined = questions.join(contexts, query_id, "left")
    context = F.coalesce("context", F.lit(""))
    out = joined.withColumn("prompt", fill(PROMPTS[provider], context=context, question=question))
    if provider == "openai":
        out = out.withColumn(
            "messages",
            F.array(
                F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_MESSAGE).alias("content")),
                F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
            ),
        )
    return out.drop("context")


def code_prompt(prompt: Column | str, language: Column | str = "language") -> Column:
    return fill(CODE_PROMPT, prompt=prompt, language=language)


def explain_prompt(code: Column | str, language: Column | str = "language") -> Column:
    return fill(EXPLAIN_PROMPT, code=code, language=language)


def mode_question(mode: Column | str, question: Column | str, tech: Column | str | None = None) -> Column:
    """Question text of the general modes: code generation or anything else."""
    code = fill(CODE_QUESTION, question=question)
    if tech is not None:
        code = F.when(_col(tech).isNull(), code).otherwise(
            fill(CODE_QUESTION_WITH_TECH, question=question, tech=tech)
        )
    return F.when(_col(mode) == "code_generation", code).otherwise(fill(QUESTION, question=question))


def technology_question(mode: Column | str, question: Column | str, technology: Column | str) -> Column:
    """Question text of the technology modes: code, detailed, smart; null if unknown."""
    tech = technology_name(technology, None)
    texts = {m: fill(t, question=question, tech=tech) for m, t in TECH_QUESTIONS.items()}
    out = F.when(_col(mode) == "code", texts["code"]).when(
        _col(mode) == "detailed", texts["detailed"]
    )
    return F.when(tech.isNotNull(), out.otherwise(texts["smart"]))


def styled_request(style: Column | str, language: Column | str, prompt: Column | str) -> Column:
    return fill(STYLED_REQUEST, style=style, language=language, prompt=prompt)


def answer_records(
    questions: DataFrame, hits: DataFrame, answers: DataFrame, query_id: str = "query_id",
    limit: int = C.MAX_SEARCH_K,
) -> DataFrame:
    """Question, its answer and its sources: the first ``limit`` hits, as a search returns no
    more. That bounds what is collected for a question."""
    hits = hits.where(F.col("rank") <= limit)
    sources = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "id", "title", "score"))), lambda s: s
    )
    found = hits.groupBy(query_id).agg(sources.alias("sources"), F.count("*").alias("source_count"))
    out = questions.join(answers, query_id, "left").join(found, query_id, "left")
    return out.withColumn("source_count", F.coalesce("source_count", F.lit(0)).cast("bigint")).withColumn(
        "technology_context", technology_name("technology", None)
    )


def numbered_messages(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages with their place in the conversation, from 1."""
    return numbered(messages, conversation, turn, "message_no")


def shown_sources(hits: DataFrame, n: int = C.CODE_CONTEXT_HITS) -> DataFrame:
    """Lines naming the first sources of an answer (rank, title, technology of each hit)."""
    line = F.concat(
        F.lit("- **"), F.coalesce("title", F.lit("Untitled")), F.lit("** ("),
        F.coalesce("technology", F.lit(C.DEFAULT_TECHNOLOGY)), F.lit(")"),
    )
    return hits.where(F.col("rank") <= n).withColumn("line", line)


def transcripts(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", sources: str | None = None, page_turns: int = 1000,
) -> DataFrame:
    """Conversation text, one row per page of ``page_turns`` turns, so that a row and a group
    stay bounded however long a conversation gets; all usual ones have a single page. With
    ``sources`` (array of titles) every message is followed by the titles it rests on."""
    line = F.concat(F.col(role), F.lit(": "), F.col(text))
    if sources:
        titles = F.transform(
            sources, lambda t: F.concat(F.lit("\n- "), F.coalesce(t, F.lit("Unknown")))
        )
        line = F.concat(line, F.coalesce(F.array_join(titles, ""), F.lit("")))
    page = F.floor(F.col(turn) / F.lit(page_turns)).cast("bigint").alias("page")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("_t"), line.alias("_line"))))
    return messages.groupBy(conversation, page).agg(
        F.count("*").alias("messages"),
        F.array_join(F.transform(ordered, lambda s: s["_line"]), "\n").alias("transcript"),
    )
