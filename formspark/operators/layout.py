"""Layout blocks of a page: words, lines, key-value pairs, tables and selection marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_MODES = {"word": (lambda c: F.when(c > 0, c), 0.0), "block": (lambda c: F.when(c != 0, c), 85.0), "page": (lambda c: c * 100, 90.0)}


def page_confidence(words: DataFrame, mode: str = "word") -> DataFrame:
    """Mean confidence and number of words that aren't blank, by page."""
    of, default = _MODES[mode]
    return words.groupBy("page_id").agg(F.coalesce(F.avg(of(F.col("confidence"))), F.lit(default)).alias("confidence"), F.count_if(F.trim("text") != "").alias("word_count"))


def assemble_lines(lines: DataFrame) -> DataFrame:
    return lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l")).select("page_id", F.trim(F.array_join("l.text", "\n")).alias("raw_text"))


def kv_map(pairs: DataFrame) -> DataFrame:
    """page_id and the map of its pairs; the last of equal keys wins."""
    w = Window.partitionBy("page_id", "key").orderBy(F.desc("ord"))
    last = pairs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return last.groupBy("page_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("structured_data"))


def assemble_key_values(blocks: DataFrame) -> DataFrame:
    """KEY blocks joined to their VALUE blocks, and both to their words: page_id, key, value."""
    sets = blocks.filter("block_type = 'KEY_VALUE_SET'")
    links = sets.select("page_id", "block_id", F.explode("relationships").alias("r")).select("page_id", "block_id", "r.type", F.posexplode("r.ids").alias("at", "to"))
    words = blocks.filter("block_type = 'WORD'").select("page_id", F.col("block_id").alias("to"), "text")
    texts = links.filter("type = 'CHILD'").join(words, ["page_id", "to"]).groupBy("page_id", "block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda w: w["text"]), " ").alias("said"))
    keys = sets.filter(F.array_contains("entity_types", "KEY")).select("page_id", "block_id")
    values = links.filter("type = 'VALUE'").select("page_id", "block_id", F.col("to").alias("value_id"))
    met = keys.join(values, ["page_id", "block_id"], "left").join(texts.withColumnRenamed("said", "key"), ["page_id", "block_id"])
    return met.join(texts.select("page_id", F.col("block_id").alias("value_id"), F.col("said").alias("value")), ["page_id", "value_id"], "left").select("page_id", "key", F.coalesce("value", F.lit("")).alias("value"))


def tables_from_cells(cells: DataFrame) -> DataFrame:
    """Rows of each table as arrays, with its numbers of rows and columns."""
    rows = cells.groupBy("page_id", "table_no", "row_index").agg(F.array_sort(F.collect_list(F.struct("column_index", "content"))).alias("c"), F.max("column_index").alias("m"))
    return rows.groupBy("page_id", "table_no").agg((F.max("row_index") + 1).alias("row_count"), (F.max("m") + 1).alias("column_count"), F.transform(F.array_sort(F.collect_list(F.struct("row_index", F.col("c.content").alias("cells")))), lambda r: r["cells"]).alias("rows"))


def selection_marks(blocks: DataFrame) -> DataFrame:
    return blocks.filter("block_type = 'SELECTION_ELEMENT'").select("page_id", "block_id", (F.col("selection_status") == "SELECTED").alias("selected"), "confidence")


def selection_counts(marks: DataFrame) -> DataFrame:
    return marks.groupBy("page_id").agg(F.count_if("selected").alias("n_selected"), F.count("*").alias("n_marks"))
