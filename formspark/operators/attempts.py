"""Best attempts, page assembly and form status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import attempt_score, mode_score, round_at


def best_by(attempts: DataFrame, score: Column, keys: tuple[str, ...] = ("form_id", "page")) -> DataFrame:
    """The row of the highest score of each group; the first attempt wins ties. Failed attempts don't take part."""
    ok = attempts.filter(F.col("error").isNull()) if "error" in attempts.columns else attempts
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "attempt_ord", "provider")
    return ok.withColumn("score", score).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def best_attempt(attempts: DataFrame, on_all_failed: str = "skip") -> DataFrame:
    """on_all_failed: "error" adds a row with the first error for pages without any success."""
    best = best_by(attempts, attempt_score(F.col("confidence"), F.col("raw_text")))
    if on_all_failed != "error":
        return best
    failed = attempts.groupBy("form_id", "page").agg(F.min(F.struct("attempt_ord", "provider", "error")).alias("f"), F.count_if(F.col("error").isNull()).alias("n")).filter("n = 0")
    return best.unionByName(failed.select("form_id", "page", "f.*"), allowMissingColumns=True)


def best_mode(modes: DataFrame) -> DataFrame:
    return best_by(modes, mode_score(F.col("confidence"), F.col("word_count")))


def attempt_list(attempts: DataFrame) -> DataFrame:
    row = F.struct("attempt_ord", "provider", "confidence", F.char_length(F.coalesce("raw_text", F.lit(""))).alias("text_length"))
    return attempts.filter(F.col("error").isNull()).groupBy("form_id", "page").agg(F.sort_array(F.collect_list(row)).alias("attempts"))


def all_attempts(attempts: DataFrame) -> DataFrame:
    """Map of provider to confidence (the first attempt of each), with the best provider."""
    ok = attempts.filter(F.col("error").isNull())
    one = ok.groupBy("form_id", "page", "provider").agg(F.min(F.struct("attempt_ord", "confidence")).alias("a"))
    maps = one.groupBy("form_id", "page").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("provider", "a.confidence")))).alias("results"))
    return maps.join(best_attempt(attempts).select("form_id", "page", F.col("provider").alias("best_provider")), ["form_id", "page"])


def assemble_pages(pages: DataFrame, mode: str = "upload", keys: tuple[str | Column, ...] = ("form_id",)) -> DataFrame:
    """One row a form (or other keys): raw_text with page markers, confidence, pages_processed, provider of the first page,
    page_results. One form is one row: its pages must fit into a task."""
    worded = F.trim(F.coalesce("raw_text", F.lit(""))) != ""
    c = F.when(worded & (F.col("confidence") != 0), F.col("confidence")) if mode == "upload" else F.col("confidence")
    n = F.count("*") if mode == "upload" else F.count_if(F.col("raw_text").isNotNull() | F.col("confidence").isNotNull())
    row = F.struct("page", "raw_text", "confidence", "provider")
    out = pages.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("page_results"), round_at(F.coalesce(F.avg(c), F.lit(0.0)), 2).alias("confidence"), n.alias("pages_processed"), F.min_by("provider", "page").alias("provider"))
    said = F.transform(F.filter("page_results", lambda p: F.trim(F.coalesce(p["raw_text"], F.lit(""))) != ""), lambda p: F.concat(F.lit("\n--- Page "), p["page"].cast("string"), F.lit(" ---\n"), p["raw_text"]))
    return out.withColumn("raw_text", F.array_join(said, "\n"))


def joined_pages(results: Column) -> dict[str, Column]:
    """assemble_pages' columns from an array of a form's pages, as uploads have them."""
    worded = F.filter(results, lambda p: F.trim(F.coalesce(p["raw_text"], F.lit(""))) != "")
    sure = F.filter(F.transform(worded, lambda p: p["confidence"]), lambda c: F.coalesce(c != 0, F.lit(False)))
    said = F.transform(worded, lambda p: F.concat(F.lit("\n--- Page "), p["page"].cast("string"), F.lit(" ---\n"), p["raw_text"]))
    mean = F.aggregate(sure, F.lit(0.0), lambda a, c: a + c) / F.nullif(F.size(sure), F.lit(0))
    return {"raw_text": F.array_join(said, "\n"), "confidence": round_at(F.coalesce(mean, F.lit(0.0)), 2), "pages_processed": F.size(results), "provider": F.get(results, 0)["provider"]}


def split_pages(forms: DataFrame) -> DataFrame:
    """Pages from assembled text."""
    parts = F.split("raw_text", r"(?:^|\n)\n--- Page ")
    return forms.select("form_id", F.explode(F.slice(parts, 2, 1 << 30)).alias("p")).select("form_id", F.regexp_extract("p", r"^(\d+) ---\n", 1).try_cast("int").alias("page"), F.regexp_replace("p", r"^\d+ ---\n", "").alias("raw_text"))


def shown_pages() -> Column:
    """The number of pages to show: those counted, or else those held, or else one."""
    return F.coalesce(F.nullif("pages_processed", F.lit(0)), F.nullif(F.size("page_results"), F.lit(0)), F.lit(1))


def union_pages(lists: list[DataFrame]) -> DataFrame:
    """The page lists of several files (form_id, page, ...), numbered through in the order of the files."""
    own = [p.withColumnRenamed("page", "page_in_file").withColumn("file_ord", F.lit(k)) for k, p in enumerate(lists)]
    return number_pages(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own))


def number_pages(pages: DataFrame) -> DataFrame:
    """Pages of several files of one form, numbered through."""
    return pages.withColumn("page", F.row_number().over(Window.partitionBy("form_id").orderBy("file_ord", "page_in_file")))


def form_status(pages: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("error").isNull())
    return pages.groupBy("form_id").agg(F.when(ok > 0, "extracted").otherwise("error").alias("status"))


def dashboard(forms: DataFrame, docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row of totals."""
    own = forms.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("status") == "extracted").alias("pending"))
    return own.crossJoin(docs.agg(F.count("*").alias("documents"))).crossJoin(profiles.agg(F.count("*").alias("profiles")))
