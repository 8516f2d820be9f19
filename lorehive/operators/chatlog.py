"""Captured chat event logs: frames, citations, turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIT = "struct<filename:string,heading_path:string,page:int,document_id:string,chunk_id:string,relevance:double>"
RESULT = f"struct<results:array<{HIT}>,guidance:string>"
ROLES, MAX_CHARS, MAX_MESSAGES = ("user", "assistant"), 8000, 50


def frames(logs: DataFrame) -> DataFrame:
    """logs(conv_id, turn, body) to conv_id, turn, seq, type, payload; frames that aren't JSON with
    a type are skipped."""
    split = logs.select("conv_id", "turn", F.posexplode(F.split("body", "\n\n", -1)).alias("seq", "frame"))
    payload = F.regexp_extract("frame", r"(?s)\Adata: (.*)\z", 1)
    return split.select("conv_id", "turn", "seq", F.get_json_object(payload, "$.type").alias("type"), payload.alias("payload")).filter("type is not null")


def citations(events: DataFrame) -> DataFrame:
    """tool_result events to one row per search hit: conv_id, turn, seq, place, the six fields.
    payload has the structured result; results of other tools give none."""
    parsed = F.from_json(F.get_json_object("payload", "$.structured"), RESULT)
    hits = events.filter("type = 'tool_result'").select("conv_id", "turn", "seq", F.posexplode(parsed["results"]).alias("place", "hit"))
    return hits.filter("hit is not null").select("conv_id", "turn", "seq", "place", "hit.*")


def result_sizes(events: DataFrame) -> DataFrame:
    """conv_id, turn, seq, result_count (null unless results is a list), guidance."""
    structured = F.get_json_object("payload", "$.structured")
    parsed = F.from_json(structured, RESULT)
    count = F.when(parsed["results"].isNotNull(), F.size(parsed["results"]))
    return events.filter("type = 'tool_result'").select("conv_id", "turn", "seq", count.alias("result_count"), parsed["guidance"].alias("guidance"))


def turn_texts(events: DataFrame) -> DataFrame:
    """conv_id, turn, text (all text events in order), error (the last one)."""
    text = F.when(F.col("type") == "text", F.struct("seq", F.get_json_object("payload", "$.text").alias("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda x: x["text"]), "")
    error = F.max_by(F.get_json_object("payload", "$.message"), F.when(F.col("type") == "error", F.col("seq")))
    return events.groupBy("conv_id", "turn").agg(joined.alias("text"), error.alias("error"))


def turn_citations(cited: DataFrame) -> DataFrame:
    """Citations of a turn without repeats: a chunk counts in the first event that cites it (several
    times if that event does), and never without an id."""
    first = F.min("seq").over(Window.partitionBy("conv_id", "turn", "chunk_id"))
    return cited.filter("chunk_id <> ''").withColumn("first", first).filter("seq = first").drop("first")


PAIRED = "conv_id long, turn int, seq int, name string, result_seq int"


def pair_calls(events: DataFrame) -> DataFrame:
    """Tool calls with the event that completed them: a result goes to the latest open call of its
    name in the turn; result_seq is null for calls that stay open."""

    def fold(conv_id: int, turn: int, steps: list[dict]) -> list[list]:
        done, waiting = [], {}
        for s in steps:
            if s["call"]:
                waiting.setdefault(s["name"], []).append(len(done))
                done.append([conv_id, turn, s["seq"], s["name"], None])
            elif waiting.get(s["name"]):
                done[waiting[s["name"]].pop()][4] = s["seq"]
        return done

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [x for row in batch.itertuples(index=False) for x in fold(*row)]
            yield pd.DataFrame(done, columns=["conv_id", "turn", "seq", "name", "result_seq"]).astype({"result_seq": "Int64"})

    step = F.struct("seq", (F.col("type") == "tool_call").alias("call"), F.get_json_object("payload", "$.name").alias("name"))
    turns = events.filter("type in ('tool_call', 'tool_result')").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return turns.mapInPandas(run, PAIRED)


def message_reason(role: Column, content: Column, of_conversation: Column) -> Column:
    """Why a message is refused: role, empty, too_long, too_many, or null."""
    n = F.length(content)
    return F.when(~F.coalesce(role.isin(*ROLES), F.lit(False)), "role").when(F.coalesce(n, F.lit(0)) == 0, "empty").when(n > MAX_CHARS, "too_long").when(of_conversation > MAX_MESSAGES, "too_many")


def admit_messages(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, content) with reason; sizes are counted apart, so a long
    conversation combines before it is shuffled."""
    sizes = messages.groupBy("conv_id").agg(F.count("*").alias("size"))
    return messages.join(sizes, "conv_id").withColumn("reason", message_reason(F.col("role"), F.col("content"), F.col("size"))).drop("size")
