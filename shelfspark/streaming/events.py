"""File-event streams: filters, debouncing and per-path cooldown."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Formats of books, endings of temporary names.
EXTENSIONS = ("epub", "pdf", "mobi", "cbz", "fb2", "txt", "djvu", "azw3")
TEMPORARY = ("part", "tmp", "crdownload", "swp")


def relevant(events: DataFrame) -> DataFrame:
    """Changes of book files that are neither hidden nor temporary, and removals of any book file; other kinds are out."""
    name = F.element_at(F.split("path", "/"), -1)
    temp = name.rlike(rf"(?i)(\.({'|'.join(TEMPORARY)})|~)$")
    book = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)).isin(*EXTENSIONS) | F.lower(F.regexp_extract(name, r"^\.[^.]+\.([^.]+)$", 1)).isin(*EXTENSIONS)
    return events.where(book & ((F.col("kind") == "removed") | ((F.col("kind") == "changed") & ~name.startswith(".") & ~temp)))


def debounced(events: DataFrame, gap: str = "2 seconds") -> DataFrame:
    """The last event of each burst of a path (bursts are parted by ``gap``); batch or stream with a watermark."""
    return events.groupBy("path", F.session_window("ts", gap)).agg(F.max_by("kind", "ts").alias("kind"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n")).drop("session_window")


def cooled(events: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Events (path, kind, ts) at least ``seconds`` after the last *passed* event of their path.

    A stream keeps one time for each path and forgets it once two cooldowns of
    processing time went by without an event.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def passed(at, last: float | None) -> tuple[list[int], float | None]:
        keep = []
        for i, t in enumerate(at):
            if last is None or t - last >= seconds:
                last = t
                keep.append(i)
        return keep, last

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for frame in frames:
            frame = frame.sort_values("ts")
            keep, last = passed(frame["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6, last)
            yield frame.iloc[keep][["path", "kind", "ts"]]
        if last is not None:
            state.update((last,))
            state.setTimeoutDuration(int(2000 * seconds))

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "kind"])
        return frame.iloc[passed(frame["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6, None)[0]]

    by_path = events.select("path", "kind", "ts").groupBy("path")
    if not events.isStreaming:
        return by_path.applyInPandas(whole, "path string, kind string, ts timestamp")
    return by_path.applyInPandasWithState(step, "path string, kind string, ts timestamp", "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def unchanged_dropped(events: DataFrame, files: DataFrame) -> DataFrame:
    """Changes of ``events(path, hash)`` without those whose path is known with that very hash in every row of ``files(path, hash)``."""
    known = files.groupBy("path").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi"))
    same = (F.col("lo") == F.col("hash")) & (F.col("hi") == F.col("hash"))
    return events.join(known, "path", "left").where(~F.coalesce(same, F.lit(False))).drop("lo", "hi")


def foreign_removals(removals: DataFrame, deletions: DataFrame, seconds: int = 30) -> DataFrame:
    """Removals that do not follow an own deletion of the path within ``seconds``.

    Batch or stream: as streams both need a watermark on ``ts``, and rows that
    an own deletion explains are dropped once its time is past, which bounds
    the state.
    """
    if not removals.isStreaming:
        return _unexplained(removals, deletions, seconds)
    own = deletions.select(F.col("path").alias("own_path"), F.col("ts").alias("own_ts"))
    near = (F.col("path") == F.col("own_path")) & (F.col("ts") >= F.col("own_ts")) & (F.col("ts") < F.col("own_ts") + F.expr(f"interval {seconds} seconds"))
    return removals.join(own, near, "left_outer").where("own_path is null").drop("own_path", "own_ts")


def _unexplained(removals: DataFrame, deletions: DataFrame, seconds: int) -> DataFrame:
    """The rows of ``foreign_removals`` in batch, in time that grows with the rows, however many share a path.

    Time is cut into spans of ``seconds``. A deletion explains a removal if it
    is in the same span and not later, or in the span before and less than
    ``seconds`` ago; so the first and last deletion of a path and span suffice.
    """
    if seconds <= 0:
        return removals
    span = seconds * 1_000_000

    def timed(df: DataFrame) -> DataFrame:
        # local times are told apart as they are written, whatever the session's zone makes of them
        ts = F.concat(F.col("ts").cast("string"), F.lit("Z")) if dict(df.dtypes)["ts"] == "timestamp_ntz" else F.col("ts")
        micros = F.unix_micros(ts.cast("timestamp"))
        return df.withColumns({"own_": micros, "at_": micros - F.pmod(micros, F.lit(span))})

    seen = timed(deletions).groupBy("path", "at_").agg(F.min("own_").alias("first_"), F.max("own_").alias("last_"))
    rows = timed(removals).join(seen.drop("last_"), ["path", "at_"], "left")
    rows = rows.join(seen.select("path", (F.col("at_") + span).alias("at_"), "last_"), ["path", "at_"], "left")
    explained = (F.col("first_") <= F.col("own_")) | (F.col("last_") > F.col("own_") - span)
    return rows.where(~F.coalesce(explained, F.lit(False))).select(*removals.columns)


def finished_imports(imports: DataFrame, completions: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Files of ``imports(task_id, path, ts)`` whose task succeeded: these may be deleted at their source. As streams both need a watermark on ``ts``."""
    done = completions.where("status = 'completed'").select(F.col("task_id").alias("done_id"), F.col("ts").alias("done_at"))
    on = (F.col("task_id") == F.col("done_id")) & (F.col("done_at") >= F.col("ts")) & (F.col("done_at") <= F.col("ts") + F.expr(f"interval {wait}"))
    return imports.join(done, on).select("task_id", "path", "done_at")
