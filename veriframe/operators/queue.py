"""The review queue over tables: what is visible, the latest verdicts beside it, filters, order, tabs and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.operators.latest import latest_per_key, progress_percent
from veriframe.operators.lifecycle import search

#: Verdicts worst first, tabs, states that end an attempt, and columns of a formula.
VERDICT_RANK = {"fail": 0, "needs_review": 1, "request_retake": 2, "error": 3, "pass_with_note": 4, "pass": 5}
TABS = ("needs_attention", "ready_to_approve", "failed", "unchecked", "decided")
TERMINAL = ("passed", "failed", "needs_review", "error")
UNDERWAY = ("queued", "processing")
FORMULA = ("declared_class_type", "actual_alcohol_content")
FORMULA_FLAGS = ("contains_fd_c_yellow_5", "contains_cochineal_carmine", "contains_sulfites_10ppm", "contains_saccharin", "contains_aspartame", "contains_added_coloring")
#: Channels (null: any) and sources of records that reviewers, the history and the samples show.
ARTWORK_TYPES, BACK_TYPES, MOST_BYTES = ("image/jpeg", "image/png", "image/webp", "application/pdf"), ("image/jpeg", "image/png", "image/webp"), 20 * 1024 * 1024


def visible(df: DataFrame, kinds: Sequence[str], channel: str | None = None, kind_col: str = "source_kind", channel_col: str = "channel", quarantine_col: str = "quarantined_at") -> DataFrame:
    """Rows of the given sources, and channel if one is given, that are not in quarantine."""
    rows = df.filter(F.col(kind_col).isin(*kinds) & F.col(quarantine_col).isNull())
    return rows if channel is None else rows.filter(F.col(channel_col) == channel)


def with_latest(left: DataFrame, right: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """left with the columns of right's newest row of the key, null where there is none. right is reduced before it is joined."""
    return left.join(latest_per_key(right, [key], order), key, "left")


def filter_history(df: DataFrame, filters: dict[str, str | None], text_cols: Sequence[str] = ("serial_number", "brand_name"), kind_col: str = "beverage_type", verdict_col: str = "overall_verdict") -> DataFrame:
    """Keys of filters: q (in any of text_cols), the name of a text column (contained), kind, verdict ('unchecked': none yet). Blank values keep all rows."""
    df = search(df, text_cols, filters.get("q"))
    for c in text_cols:
        df = search(df, [c], filters.get(c))
    if filters.get("kind"):
        df = df.filter(F.col(kind_col) == filters["kind"])
    if filters.get("verdict"):
        df = df.filter(F.coalesce(verdict_col, F.lit("unchecked")) == filters["verdict"])
    return df


def filter_latest_verdict(left: DataFrame, history: DataFrame, key: str, order: Sequence[str], verdict_col: str, verdict: str) -> DataFrame:
    """Rows of left whose newest verdict is this one."""
    return left.join(latest_per_key(history, [key], order).filter(F.col(verdict_col) == verdict).select(key), key, "left_semi")


def completed(df: DataFrame, verdict_col: str) -> DataFrame:
    return df.filter(F.col(verdict_col) != "error")


def with_extraction(df: DataFrame, extraction_col: str) -> DataFrame:
    return df.filter(F.col(extraction_col).isNotNull())


def retry_set(left: DataFrame, history: DataFrame, key: str, order: Sequence[str], verdict_col: str) -> DataFrame:
    """Rows of left with no verdict, or an error as the newest."""
    good = latest_per_key(history, [key], order).filter(F.coalesce(F.col(verdict_col) != "error", F.lit(False)))
    return left.join(good.select(key), key, "left_anti")


def verdict_rank(c: Column) -> Column:
    """Worst first; an unknown or missing verdict is last (99)."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in VERDICT_RANK.items() for x in kv]), c), F.lit(99))


def queue_tab(verdict: Column, decision: Column) -> Column:
    return (F.when(F.trim(decision) != "", "decided").when(verdict.isNull() | (verdict == "error"), "unchecked").when(verdict.isin("needs_review", "fail"), "needs_attention")
            .when(verdict.isin("pass", "pass_with_note"), "ready_to_approve").when(verdict == "request_retake", "failed").otherwise("unchecked"))


def partition_tabs(df: DataFrame, verdict: Column, decision: Column, key: Column, tie: str, direction: str = "desc") -> DataFrame:
    """df with its tab, tabs in their order and rows within each by key and tie, both falling with desc."""
    place = F.array_position(F.array(*map(F.lit, TABS)), F.col("tab"))
    turn = (lambda c: c.desc()) if direction == "desc" else (lambda c: c.asc())
    return df.withColumns({"tab": queue_tab(verdict, decision), "_key": key}).orderBy(place, turn(F.col("_key")), turn(F.col(tie))).drop("_key")


def recent_quarantined(df: DataFrame, at: str, tie: str, n: int = 100) -> DataFrame:
    """The n rows put in quarantine last."""
    return df.filter(F.col(at).isNotNull()).orderBy(F.col(at).desc(), F.col(tie).desc()).limit(n)


def list_samples(df: DataFrame, brand: str = "brand_name", serial: str = "serial_number") -> DataFrame:
    return df.orderBy(brand, serial)


def promote(df: DataFrame, channel_col: str = "channel") -> tuple[DataFrame, DataFrame]:
    """(df with pre_review rows submitted, one row with the number changed)."""
    due = F.coalesce(F.col(channel_col) == "pre_review", F.lit(False))
    return df.withColumn(channel_col, F.when(due, "submitted").otherwise(F.col(channel_col))), df.agg(F.count_if(due).alias("submitted"))


def verdict_counts(history: DataFrame, batch: str, key: str, order: Sequence[str], verdict_col: str) -> DataFrame:
    """(batch, verdict, n) over the newest verdict of each key."""
    return latest_per_key(history, [batch, key], order).groupBy(batch, F.col(verdict_col).alias("verdict")).agg(F.count("*").alias("n"))


def batch_state_counts(batches: DataFrame, batch: str, total: str, attempts: DataFrame, key: str, order: Sequence[str], state_col: str, history: DataFrame) -> DataFrame:
    """(batch, queued, processing, errors, done, percent) of each batch by the newest attempt of each key.

    done counts attempts that ended; a batch without any attempt counts its keys with a verdict instead."""
    newest = latest_per_key(attempts.select(batch, key, *order, state_col), [batch, key], order)
    of = lambda *states: F.count_if(F.col(state_col).isin(*states))
    counts = newest.groupBy(batch).agg(of("queued").alias("queued"), of("processing").alias("processing"), of("error").alias("errors"), of(*TERMINAL).alias("_ended"))
    had = history.select(batch, key).distinct().groupBy(batch).agg(F.count("*").alias("_had"))
    j = batches.select(batch, total).join(counts, batch, "left").join(had, batch, "left")
    none = F.lit(0).cast("long")
    done = F.coalesce("_ended", "_had", none)
    return j.select(batch, *[F.coalesce(c, none).alias(c) for c in ("queued", "processing", "errors")], done.alias("done"), progress_percent(done, F.col(total)).alias("percent"))


def batch_status(batches: DataFrame, batch: str, status: str, completed_at: str, attempts: DataFrame, key: str, order: Sequence[str], state_col: str, now: Column) -> DataFrame:
    """batches with status and completed_at after their attempts: any newest attempt under way makes a batch processing and clears the time; else it is
    completed, at its own time or now; a batch without attempts stays as it is."""
    newest = latest_per_key(attempts.select(batch, key, *order, state_col), [batch, key], order)
    open_ = newest.groupBy(batch).agg(F.count_if(F.col(state_col).isin(*UNDERWAY)).alias("_open"))
    j = batches.join(open_, batch, "left")
    at = F.when(F.col("_open").isNull(), F.col(completed_at)).when(F.col("_open") == 0, F.coalesce(F.when(F.col(status) == "completed", F.col(completed_at)), now))
    return j.withColumns({completed_at: at, status: F.when(F.col("_open").isNull(), F.col(status)).when(F.col("_open") > 0, "processing").otherwise("completed")}).drop("_open")


def formula_provided(texts: Sequence[str] = FORMULA, flags: Sequence[str] = FORMULA_FLAGS) -> Column:
    """Any text or number is there, or any flag is known; a flag that is false counts."""
    out = F.lit(False)
    for c in texts:
        out = out | F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    for c in flags:
        out = out | F.col(c).isNotNull()
    return out


def record_errors(required: Sequence[str], percents: Sequence[str], imported: str, country: str, vintage: str, front_type: str, front_bytes: str, back_type: str, back_bytes: str) -> Column:
    """array<struct(kind, message)> of a record: what is missing, out of range, or no fit artwork."""
    from veriframe.sources.ingest import error, row_errors

    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    number, year = (lambda c: F.col(c).cast("double")), F.col(vintage).cast("int")
    return row_errors(
        *[error(blank(c), "missing_value", f"{c} can't be blank") for c in required], error(F.col(imported) & blank(country), "missing_value", f"{country} is required for imported products"),
        *[error((number(c) < 0) | (number(c) >= 100), "invalid_value", f"{c} must be at least 0 and under 100") for c in percents], error((year <= 1900) | (year > 2100), "invalid_value", f"{vintage} must be a year from 1901 to 2100"),
        error(~F.col(front_type).isin(*ARTWORK_TYPES), "invalid_artwork", "artwork must be JPEG, PNG, WebP or PDF"), error(F.col(front_bytes) > MOST_BYTES, "invalid_artwork", "artwork must be 20 MB or smaller"),
        error(~F.col(back_type).isin(*BACK_TYPES), "invalid_artwork", "back artwork must be JPEG, PNG or WebP"), error(F.col(back_bytes) > MOST_BYTES, "invalid_artwork", "back artwork must be 20 MB or smaller"),
        error(F.col(back_type).isNotNull() & (F.col(front_type) == "application/pdf"), "invalid_artwork", "back artwork cannot go with PDF artwork"))
