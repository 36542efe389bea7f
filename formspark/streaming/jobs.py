"""The same functions on streams of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions.fields import extract_fields
from ..operators.attempts import assemble_pages, joined_pages
from ..sources.tables import validate_intake
from .snapshots import read_snapshot, stream_upsert, write_snapshot

PAGES = "form_id BIGINT, page INT, raw_text STRING, confidence DOUBLE, provider STRING, ts TIMESTAMP, n_pages INT"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(PAGES).parquet(path)


def stream_extract(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """New pages -> fields; stateless, so batch and stream share the code."""
    found = extract_fields(read_pages(spark, path))
    return found.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def stream_intake(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """New rows of a manifest (filename, size) -> out/accepted=true and out/accepted=false, the latter with a reason."""
    return validate_intake(files).writeStream.format("parquet").partitionBy("accepted").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


HELD = "page int, raw_text string, confidence double, provider string"
STATE = f"held array<struct<{HELD.replace(' ', ': ').replace(',:', ',')}>>, expected int, closes long, told boolean"


def stream_assemble(pages: DataFrame, late: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """assemble_pages' columns, closed_at, and is_complete of each form, told once.

    pages has n_pages, too: how many pages the form has, NULL where that isn't known. A form is told as soon as pages 1 to
    n_pages are there, or else when the watermark passes its first page by `within`, as incomplete (NULL where n_pages never
    came). Of pages with one number the first counts. Pages that come after that are left out until the form's time ends;
    then they begin it anew. Pages later than the watermark are left out. The pages of a form are its state: one row.
    """
    span = int(pd.Timedelta(within).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, expected, closes, told = state.get if state.exists else ([], None, None, False)
        if state.hasTimedOut:
            state.remove()
            if not told:
                yield row(key, held, closes, None if expected is None else False)
            return
        held = {r[0]: tuple(r) for r in held}
        for part in parts:
            closes = min([closes] * (closes is not None) + [int(part["ms"].min()) + span])
            known = part["n_pages"].dropna()
            expected = int(known.max()) if expected is None and len(known) else expected
            for r in part.sort_values("ms", kind="stable")[["page", "raw_text", "confidence", "provider"]].itertuples(index=False):
                held.setdefault(int(r.page), (int(r.page), *(None if pd.isna(x) else x for x in r[1:])))
        if not told and expected is not None and all(k in held for k in range(1, expected + 1)):
            told = True
            yield row(key, list(held.values()), int(part["ms"].max()), True)
        state.update(([] if told else list(held.values()), expected, closes, told))
        state.setTimeoutTimestamp(max(closes, state.getCurrentWatermarkMs() + 1))

    def row(key: tuple, held: list, closed: int, complete: bool | None) -> pd.DataFrame:
        results = [dict(zip(("page", "raw_text", "confidence", "provider"), r)) for r in sorted(map(tuple, held), key=lambda r: r[0])]
        return pd.DataFrame({"form_id": [key[0]], "closed": [closed], "page_results": [results], "is_complete": pd.array([complete], "boolean")})

    own = pages.select("form_id", "page", "raw_text", "confidence", "provider", "ts", "n_pages", F.unix_millis("ts").alias("ms")).withWatermark("ts", late)
    told = own.groupBy("form_id").applyInPandasWithState(step, f"form_id long, closed long, page_results array<struct<{HELD.replace(' ', ': ').replace(',:', ',')}>>, is_complete boolean", STATE, "append", "EventTimeTimeout")
    return told.select("form_id", F.timestamp_millis("closed").alias("closed_at"), *[c.alias(n) for n, c in joined_pages(F.col("page_results")).items()], "page_results", "is_complete")


def stream_sla(extracted: DataFrame, verified: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """Forms (form_id, extracted_at) without a verification (form_id, verified_at) within the hours, told once each, when both
    streams' watermarks have passed the limit. A verification that comes late, but within the watermark, still counts."""
    e = extracted.select("form_id", "extracted_at").withWatermark("extracted_at", late)
    v = verified.select(F.col("form_id").alias("_form"), "verified_at").withWatermark("verified_at", late)
    limit = F.expr(f"extracted_at + INTERVAL {hours} HOURS")
    met = e.join(v, (F.col("form_id") == F.col("_form")) & (F.col("verified_at") >= F.col("extracted_at")) & (F.col("verified_at") <= limit), "left")
    return met.filter("_form IS NULL").select("form_id", "extracted_at", limit.alias("due_at"))


def page_reason() -> Column:
    """Why a page can't be taken in; NULL where it can."""
    return (
        F.when(F.col("form_id").isNull(), "no form")
        .when(F.coalesce(F.col("page") < 1, F.lit(True)), "page number")
        .when(F.col("raw_text").isNull() & F.col("confidence").isNull(), "nothing recognized")
        .when(~F.coalesce(F.col("confidence").between(0, 100), F.lit(True)), "confidence")
    )


def stream_pages(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Pages of a stream to out/accepted and, with the reason, to out/rejected: a folder for each batch, which a batch that
    is applied again writes anew."""

    def split(batch: DataFrame, n: int) -> None:
        told = batch.withColumn("reason", page_reason()).persist()
        try:
            told.filter("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{out}/accepted/batch={n}")
            told.filter("reason IS NOT NULL").write.mode("overwrite").parquet(f"{out}/rejected/batch={n}")
        finally:
            told.unpersist()

    return pages.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_extractor(df: DataFrame, extract: Callable[[pd.DataFrame], pd.DataFrame], key: str = "id") -> DataFrame:
    """A user's extractor over batches: it gets rows of key and raw_text and gives raw_text, confidence, structured and
    provider, a row for each.

    A batch that fails is halved until the rows that fail stand alone, so that k of n cost some k log n calls; they carry the
    message in error. So do rows for which the extractor gives no row.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, raw_text string, confidence double, structured map<string,string>, provider string, error string"
    columns = [x.split()[0] for x in schema.split(", ")]

    def tried(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        waiting = [part]
        while waiting:
            rows = waiting.pop()
            try:
                got = extract(rows).assign(error=None)
            except Exception as e:
                if len(rows) > 1:
                    waiting += [rows.iloc[len(rows) // 2 :], rows.iloc[: len(rows) // 2]]
                    continue
                got = pd.DataFrame({key: rows[key], "error": f"{type(e).__name__}: {e}"})
            lost = rows[~rows[key].isin(got[key])]
            if len(lost):
                got = pd.concat([got, pd.DataFrame({key: lost[key], "error": "no result"})])
            got = got.reindex(columns=columns).astype({c: object for c in columns[1:]})
            yield got.where(got.notna(), None).astype({"confidence": "float64"})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield from tried(part)

    return df.select(key, "raw_text").mapInPandas(run, schema)


__all__ = ["assemble_pages", "page_reason", "read_pages", "read_snapshot", "stream_assemble", "stream_extract", "stream_intake", "stream_pages", "stream_sla", "stream_upsert", "with_extractor", "write_snapshot"]
