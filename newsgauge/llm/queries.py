"""The registered queries of the operators, with production parameters over whole tables, and the SQL that checks some of them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge.llm.bag_search import CHECK_SQL as BAG_SQL
from newsgauge.llm.common import table
from newsgauge.llm.line_dedup import CHECK_SQL as LINE_SQL
from newsgauge.llm.prefix_trie import CHECK_SQL as TRIE_SQL
from newsgauge.llm.suffixes import CHECK_SQL as SUFFIX_SQL
from newsgauge.llm.url_filter import CHECK_SQL as URL_SQL
from newsgauge.session import run_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from newsgauge.llm.quality_rules import judged
    done = judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


@query
def op5_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    from newsgauge.llm.near_dups import near_groups
    return near_groups(table(spark, folder, "documents")).drop("text_id")


SQL["op2_url_filter"] = URL_SQL
SQL["op9_line_dedup"] = LINE_SQL


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from newsgauge.llm.line_dedup import without_repeats
    return without_repeats(table(spark, folder, "documents")).select("doc_id", "text", "n_chunks", "n_removed")


@query
def op6_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from newsgauge.llm.wavelet import token_table
    found = token_table(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op10_language_model(spark: SparkSession, folder: str) -> DataFrame:
    from newsgauge.llm.language_model import judged
    done = judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return done.withColumn("perplexity", F.round("perplexity", 6)).withColumn("threshold", F.round("threshold", 6))


SHARDS = {f"shard-{k:03d}": 2 if k % 16 == 0 else 1 for k in range(64)}        # every sixteenth machine is twice as large


@query
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from newsgauge.llm.sharding import write_shards
    files = write_shards(table(spark, folder, "documents"), ["doc_id"], SHARDS, run_dir(spark, "shards"))
    return files.select("doc_id", "source", "lang", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), "slot", "shard")


@query
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from newsgauge.llm.decontaminate import leaks
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).withColumn("score", F.round("score", 6)).drop("text_id")


@query
def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from newsgauge.llm.pieces import encoded
    return encoded(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from newsgauge.llm.url_filter import judged
    return judged(table(spark, folder, "pages"), table(spark, folder, "labels"))


TOOLS = {
    "search": {"query": {"type": "string", "required": True}, "limit": {"type": "integer"}},
    "count": {"text": {"type": "string", "required": True}, "unit": {"type": "string", "enum": ["words", "chars"], "required": True}},
    "quote": {"turn": {"type": "integer", "required": True}},
}


def with_calls(conversations: DataFrame) -> DataFrame:
    """The given conversations hold no tool calls, so each user turn gets a call over its own text and each assistant turn answers the turn before with its own.

    Every third conversation has its calls wait for later ones, every seventh for both sides (a circle), and some calls, arguments or answers are at fault.
    """
    c, t = F.col("conv_id"), F.col("turn")
    cid = lambda turn: F.concat(F.lit("c"), c, F.lit("-"), turn)
    args = (F.when(t % 4 == 0, F.to_json(F.struct(F.col("text").alias("query"), (t + 1).alias("limit")))).when(t % 4 == 1, F.to_json(F.struct("text", F.lit("words").alias("unit"))))
            .when(c % 5 == 0, F.to_json(F.struct(F.lit("two").alias("turn")))).otherwise(F.to_json(F.struct(t.alias("turn")))))
    name = F.when(c % 11 == 0, "delete").when(t % 4 == 0, "search").when(t % 4 == 1, "count").otherwise("quote")
    back = F.when((t >= 2) & ((c % 3 != 0) | (c % 7 == 0)), F.concat(F.lit('"'), cid(t - 2), F.lit('"')))
    on = F.when((c % 3 == 0) | (c % 7 == 0), F.concat(F.lit('"'), cid(t + 2), F.lit('"')))
    call = F.concat(F.lit('{"tool_call":{"id":"'), cid(t), F.lit('","name":"'), name, F.lit('","arguments":'), args, F.lit(',"after":['), F.concat_ws(",", back, on), F.lit("]}}"))
    result = F.concat(F.lit('{"tool_result":{"id":"'), cid(t - 1), F.lit('","content":'), F.to_json(F.struct(F.length("text").alias("chars"), "text")), F.lit("}}"))
    line = F.when(F.col("role") == "user", call).when((F.col("role") == "assistant") & (c % 13 != 0), result)
    return conversations.withColumn("text", F.concat_ws("\n", "text", line))


@query
def op8_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    from newsgauge.llm.tool_calls import formatted
    return formatted(with_calls(table(spark, folder, "conversations")), TOOLS)


@query
def op11_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from newsgauge.llm.suffixes import without_repeats
    done = without_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from newsgauge.llm.prefix_trie import rebuilt, trie_nodes
    return trie_nodes(rebuilt(table(spark, folder, "conversations")))


SQL["op13_prefix_trie"] = TRIE_SQL
SQL["op11_suffix_dedup"] = SUFFIX_SQL


@query
def op12_bag_search(spark: SparkSession, folder: str) -> DataFrame:
    from newsgauge.llm.bag_search import ranked
    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL["op12_bag_search"] = BAG_SQL
