"""From hits to citations, context, prompts and event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import DEFAULTS
from lectern.functions.text import snippet

#: The wording that clients look for.
HIT, SOURCE = "[文档 ", "[来源 "
#: For the tool, the context and the history where there is nothing to show, and before the text of a tool's error.
NOTHING_FOUND = "未找到相关文档。知识库中可能没有与此查询相关的内容。"
NO_SOURCES = "没有找到相关的参考资料。"
NO_HISTORY = "（无历史对话）"
FAILED = "搜索过程中发生错误: "
UNKNOWN = "Unknown"
ROLE_NAMES = {"user": "用户"}
OTHER_ROLE = "助手"


def in_order(rows: DataFrame, keys: list[str], order: str, text: str, separator: str, alias: str) -> DataFrame:
    """Per key the texts, joined in order."""
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("p"))
    return packed.select(*keys, F.array_join(F.transform("p", lambda x: x["t"]), separator).alias(alias))


def source_text() -> Column:
    return F.coalesce(F.col("source"), F.lit(UNKNOWN))


def page_text() -> Column:
    return F.coalesce(F.col("page_number").cast("string"), F.lit("N/A"))


def tool_text(hits: DataFrame) -> DataFrame:
    """query_id, text: the hits as a tool's answer to a model."""
    line = F.concat(
        F.lit(HIT), F.col("rank").cast("string"), F.lit("] "), source_text(), F.lit(" - 第 "), page_text(), F.lit(" 页 (相关度: "),
        F.format_string("%.2f", F.col("score")), F.lit(")\n"), F.col("content"),
    )
    return in_order(hits.withColumn("_line", line), ["query_id"], "rank", "_line", "\n\n", "text")


def or_nothing(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Every query's answer, a fixed text where nothing was found."""
    return queries.select("query_id").join(answers, "query_id", "left").select("query_id", F.coalesce("text", F.lit(NOTHING_FOUND)).alias("text"))


def citations(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "rank", "document_id", "chunk_index", source_text().alias("document_name"), snippet(F.col("content")).alias("chunk_content"),
        "page_number", F.round("score", 2).alias("relevance_score"),
    )


def context(hits: DataFrame) -> DataFrame:
    """query_id, context: numbered sources and their contents."""
    line = F.concat(F.lit(SOURCE), F.col("rank").cast("string"), F.lit(": "), source_text(), F.lit(" - 第 "), page_text(), F.lit(" 页]\n"), F.col("content"))
    return in_order(hits.withColumn("_line", line), ["query_id"], "rank", "_line", "\n\n", "context")


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation."""
    last = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.withColumn("_nth", F.row_number().over(last)).where(F.col("_nth") <= n).drop("_nth")


def history(messages: DataFrame, n: int = DEFAULTS.history_messages) -> DataFrame:
    """conv_id, history: the last n messages with the names of their roles."""
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    line = F.concat(F.coalesce(F.element_at(names, F.col("role")), F.lit(OTHER_ROLE)), F.lit(": "), F.col("text"), F.lit("\n\n"))
    return in_order(last_messages(messages, n).withColumn("_line", line), ["conv_id"], "turn", "_line", "", "history")


def prompt(context: Column, history: Column, question: Column) -> Column:
    return F.concat(
        F.lit("Answer from the sources below and name them; say so if they do not hold the answer.\n\nSources:\n"), F.coalesce(context, F.lit(NO_SOURCES)),
        F.lit("\n\nConversation so far:\n"), F.coalesce(history, F.lit(NO_HISTORY)), F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"),
    )


def tool_citations(messages: DataFrame) -> DataFrame:
    """Citations from the tool messages that hold hits."""
    return messages.where(F.col("text").contains(HIT)).select("conv_id", "turn", F.lit("knowledge base").alias("source"), snippet(F.col("text")).alias("content"))


def events(messages: DataFrame, cites: DataFrame, cites_first: bool = True, keys: tuple[str, ...] = ("conversation_id",)) -> DataFrame:
    """keys, seq, type, data: citations, a token event per word, then done; where a message has an ``error``, that instead of done."""
    rank = {"citations": 0 if cites_first else 2, "token": 1, "done": 3}
    token = messages.select(*keys, F.posexplode(F.split("content", "(?<= )")).alias("i", "data")).select(*keys, F.lit(rank["token"]).alias("r"), "i", F.lit("token").alias("type"), "data")
    cited = cites.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list("citation"))).alias("data")).select(*keys, F.lit(rank["citations"]).alias("r"), F.lit(0).alias("i"), F.lit("citations").alias("type"), "data")
    error = F.col("error") if "error" in messages.columns else F.lit(None).cast("string")
    last = messages.select(*keys, error.alias("error")).select(
        *keys, F.lit(rank["done"]).alias("r"), F.lit(0).alias("i"), F.when(F.col("error").isNull(), "done").otherwise("error").alias("type"),
        F.when(F.col("error").isNull(), "").otherwise(F.to_json(F.struct(F.col("error").alias("message")))).alias("data"),
    )
    order = Window.partitionBy(*keys).orderBy("r", "i")
    return token.unionByName(cited).unionByName(last).withColumn("seq", (F.row_number().over(order) - 1).cast("int")).select(*keys, "seq", "type", "data")


def frame(kind: Column, data: Column) -> Column:
    """A server-sent event; text outside ASCII stays as it is."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(kind.alias("type"), data.alias("data"))), F.lit("\n\n"))


def decode(streams: DataFrame, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """keys, text: the tokens of each framed stream (keys, stream), put together if it is done."""
    lines = streams.select(*keys, F.posexplode(F.split("stream", "\n")).alias("i", "line")).where(F.col("line").startswith("data: "))
    found = lines.select(*keys, "i", F.from_json(F.substring("line", 7, 1 << 30), "type string, data string").alias("e")).select(*keys, "i", "e.*")
    packed = found.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "token", F.struct("i", "data")))).alias("p"), F.max(F.when(F.col("type") == "done", True)).alias("done")
    )
    return packed.where("done").select(*keys, F.array_join(F.transform("p", lambda x: x["data"]), "").alias("text"))
