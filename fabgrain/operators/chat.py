"""Conversation context and follow-up suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Messages kept as context, topic words, the marker of a status lookup, and the three
# lists of follow-up suggestions.
CONTEXT_MESSAGES = 10
TOPIC_WORDS = ("wafer", "lot")
STATUS_TOOL = "get_wafer_status"
OFF_TOPIC = ["搜尋異常晶圓", "查詢特定 Wafer 狀態", "有哪些可用工具？"]
AFTER_STATUS = ["再查另一個晶圓", "搜尋相似異常"]
ON_TOPIC = ["搜尋 Lot1 異常", "查詢 Wafer_001 狀態", "幫助我分析數據"]


def context_window(turns: DataFrame, keep_last: int = CONTEXT_MESSAGES) -> DataFrame:
    """The last messages of each conversation, with roles "user" and "model".

    The rank filter is applied per partition before the shuffle, so a long conversation costs little.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return (
        turns.withColumn("_age", F.row_number().over(newest))
        .where(F.col("_age") <= keep_last)
        .withColumn("role", F.when(F.col("role") == "user", "user").otherwise("model"))
        .drop("_age")
    )


def suggestions(answer: Column, response: Column, topics: Sequence[str] = TOPIC_WORDS, tool: str = STATUS_TOOL) -> Column:
    """Follow-up suggestions for an answer: off topic, after a status lookup, or general."""
    on_topic = F.lit(False)
    for word in topics:
        on_topic = on_topic | F.contains(F.lower(answer), F.lit(word))
    texts = lambda items: F.array(*[F.lit(i) for i in items])
    return F.when(~on_topic, texts(OFF_TOPIC)).when(F.contains(response, F.lit(tool)), texts(AFTER_STATUS)).otherwise(texts(ON_TOPIC))
