"""Assistants' raw answers, as JSON strings of three interfaces, to one table: of an answer's text the first ``most_text`` characters, of what it searched
for the first ``most_queries`` (None: all)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_LINK = "struct<url: string, title: string>"
OUTPUT = (
    "model string, usage struct<input_tokens: long, output_tokens: long>, output array<struct<type: string, action: struct<query: string, sources: array<struct<url: string>>>, "
    "content: array<struct<type: string, text: string, annotations: array<struct<type: string, url: string, title: string>>>>>>"
)
CONTENT = f"model string, usage struct<input_tokens: long, output_tokens: long>, content array<struct<type: string, text: string, input: struct<query: string>, content: array<{_LINK}>, citations: array<{_LINK}>>>"
PARTS = (
    "modelVersion string, usageMetadata struct<promptTokenCount: long, candidatesTokenCount: long, totalTokenCount: long>, candidates array<struct<content: struct<parts: array<struct<text: string>>>, "
    "groundingMetadata: struct<webSearchQueries: array<string>, groundingChunks: array<struct<web: struct<uri: string, title: string>>>, groundingSupports: array<struct<groundingChunkIndices: array<int>>>>>>"
)
MOST_TEXT, MOST_QUERIES = 12_000, 10


def _links(items: Column) -> Column:
    return F.coalesce(F.transform(items, lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"))), F.array().cast(f"array<{_LINK}>"))


def _flat(items: Column) -> Column:
    return F.flatten(F.filter(items, lambda x: x.isNotNull()))


def _row(text: Column, cited: Column, consulted: Column, queries: Column, inputs: Column, outputs: Column, model: Column, most: tuple[int | None, int | None]) -> list[Column]:
    clean = T.strip_invisible(F.coalesce(text, F.lit("")))
    clean = clean if most[0] is None else F.left(clean, F.lit(most[0]))
    asked = F.array_distinct(F.filter(F.transform(queries, T.squash), lambda q: F.coalesce(q, F.lit("")) != ""))
    asked = asked if most[1] is None else F.slice(asked, 1, most[1])
    return [clean.alias("text"), cited.alias("cited"), consulted.alias("consulted"), asked.alias("queries"), inputs.alias("input_tokens"), outputs.alias("output_tokens"), model.alias("model"), (F.size(queries) > 0).alias("searched")]


def output_answers(raw: DataFrame, most_text: int | None = MOST_TEXT, most_queries: int | None = MOST_QUERIES) -> DataFrame:
    """From (answer_id, json) with a list of output items: search calls and messages."""
    j = raw.select("answer_id", F.from_json("json", OUTPUT).alias("j"))
    said = F.flatten(F.transform(F.filter("j.output", lambda o: o["type"] == "message"), lambda o: o["content"]))
    notes = F.filter(_flat(F.transform(said, lambda c: c["annotations"])), lambda a: a["type"] == "url_citation")
    calls = F.filter("j.output", lambda o: o["type"] == "web_search_call")
    sources = F.transform(_flat(F.transform(calls, lambda o: o["action"]["sources"])), lambda s: F.struct(s["url"].alias("url"), F.lit(None).cast("string").alias("title")))
    return j.select("answer_id", *_row(F.array_join(F.transform(said, lambda c: c["text"]), ""), _links(notes), sources, F.transform(calls, lambda o: o["action"]["query"]), F.col("j.usage.input_tokens"), F.col("j.usage.output_tokens"), F.col("j.model"), (most_text, most_queries)))


def content_answers(raw: DataFrame, most_text: int | None = MOST_TEXT, most_queries: int | None = MOST_QUERIES) -> DataFrame:
    """From (answer_id, json) with a list of content blocks: tool uses, tool results and texts."""
    j = raw.select("answer_id", F.from_json("json", CONTENT).alias("j"))
    of = lambda kind: F.filter("j.content", lambda c: c["type"] == kind)
    return j.select(
        "answer_id",
        *_row(
            F.array_join(F.transform(of("text"), lambda c: c["text"]), ""), _links(_flat(F.transform(of("text"), lambda c: c["citations"]))), _links(_flat(F.transform(of("web_search_tool_result"), lambda c: c["content"]))),
            F.transform(of("server_tool_use"), lambda c: c["input"]["query"]), F.col("j.usage.input_tokens"), F.col("j.usage.output_tokens"), F.col("j.model"), (most_text, most_queries),
        ),
    )


def part_answers(raw: DataFrame, most_text: int | None = MOST_TEXT, most_queries: int | None = MOST_QUERIES) -> DataFrame:
    """From (answer_id, json) with candidates of parts: chunks that a passage rests on are cited, the
    others consulted."""
    j = raw.select("answer_id", F.from_json("json", PARTS).alias("j")).withColumn("c", F.get("j.candidates", F.lit(0)))
    chunks = F.transform(F.coalesce(F.col("c.groundingMetadata.groundingChunks"), F.array().cast("array<struct<web: struct<uri: string, title: string>>>")), lambda x, i: F.struct(i.alias("i"), x["web"]["uri"].alias("url"), x["web"]["title"].alias("title")))
    used = _flat(F.transform("c.groundingMetadata.groundingSupports", lambda s: s["groundingChunkIndices"]))
    rests = lambda x: F.coalesce(F.array_contains(used, x["i"]), F.lit(False))
    link = lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"))
    queries = F.coalesce(F.col("c.groundingMetadata.webSearchQueries"), F.array().cast("array<string>"))
    return j.select(
        "answer_id",
        *_row(
            F.array_join(F.transform("c.content.parts", lambda p: p["text"]), ""), F.transform(F.filter(chunks, rests), link), F.transform(F.filter(chunks, lambda x: ~rests(x)), link), queries,
            F.col("j.usageMetadata.promptTokenCount"), F.coalesce(F.when(F.col("j.usageMetadata.candidatesTokenCount") > 0, F.col("j.usageMetadata.candidatesTokenCount")), F.col("j.usageMetadata.totalTokenCount")), F.col("j.modelVersion"), (most_text, most_queries),
        ),
    )


def raw_citations(answers: DataFrame) -> DataFrame:
    """(answer_id, kind, ordinal, url, title): what ``collect_citations`` takes."""
    part = lambda kind: answers.select("answer_id", F.lit(kind).alias("kind"), F.posexplode({"cited": "cited", "consulted": "consulted"}[kind]).alias("ordinal", "l")).select("answer_id", "kind", "ordinal", "l.url", "l.title")
    return part("cited").unionByName(part("consulted"))
