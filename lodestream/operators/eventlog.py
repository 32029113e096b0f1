"""An ordered event log as a DataFrame: filter, sort, group, limit, append, retention.

Arrival order is the column ``_pos``; every ordering ends with it, so that ties keep arrival
order. Limits are top-k plans, not full sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import contains
from ..functions.text import ascii_clean, epoch_seconds
from ..schema import DEFAULT_LIMIT, KEPT_IN_MEMORY, KEPT_ON_DISK

BY_TIME = "timestamp"


class EventLog:
    """A log with the columns ``_pos``, ``command``, ``timestamp`` and any others."""

    def __init__(self, df: DataFrame, order: tuple[Column, ...] = ()):
        self.df = df
        self.order = order or (F.col("_pos"),)

    def filter(self, needle: str | None) -> EventLog:
        """Rows whose command holds the needle, case-sensitive."""
        return EventLog(self.df.where(contains(F.col("command"), needle)), self.order)

    def sort(self, by: str | None) -> EventLog:
        """By time, a missing one as 0; anything else leaves the order as it is."""
        if by != BY_TIME:
            return self
        return EventLog(self.df, (F.coalesce("timestamp", F.lit(0.0)), F.col("_pos")))

    def tail(self, n: int | None) -> EventLog:
        """The last rows in the present order; all for none or a negative number."""
        if n is None or n < 0:
            return self
        return EventLog(self.df.orderBy(*(c.desc() for c in self.order)).limit(n), self.order)

    def head(self, n: int) -> EventLog:
        return EventLog(self.df.orderBy(*self.order).limit(n), self.order)

    def rows(self) -> DataFrame:
        return self.df.orderBy(*self.order)

    def summary(self, key: str | Column = "command", limit: int | None = None) -> DataFrame:
        """group, count, last_run and first_pos by any atomic key, in order of first appearance.

        The key of a row that lacks the field is ``unknown``; a null stays null. A limit keeps
        the first groups.
        """
        if isinstance(key, str) and key not in self.df.columns:
            key = F.lit("unknown")
        key = F.col(key) if isinstance(key, str) else key
        groups = self.df.groupBy(key.alias("group")).agg(
            F.count(F.lit(1)).alias("count"),
            F.max(F.coalesce("timestamp", F.lit(0.0))).alias("last_run"),
            F.min("_pos").alias("first_pos"),
        )
        return groups if limit is None or limit < 0 else groups.orderBy("first_pos").limit(limit)

    def grouped_entries(self, limit: int | None = None) -> DataFrame:
        """group, count, entries (rows in arrival order) by command; a limit keeps the last groups.

        Entries nest a group's rows in one value, so this is for logs that a limit has cut.
        """
        entry = F.struct("_pos", *(c for c in self.df.columns if c != "_pos"))
        groups = self.df.groupBy(F.coalesce("command", F.lit("")).alias("group")).agg(
            F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list(entry)).alias("entries"), F.min("_pos").alias("first_pos")
        )
        return groups if not limit else groups.orderBy(F.col("first_pos").desc()).limit(limit)

    def append(self, other: EventLog) -> EventLog:
        """The other log's rows behind this one's."""
        last = self.df.agg(F.coalesce(F.max("_pos"), F.lit(-1)).alias("last"))
        # one row
        moved = other.df.crossJoin(F.broadcast(last)).withColumn("_pos", F.col("_pos") + F.col("last") + 1).drop("last")
        return EventLog(self.df.unionByName(moved, allowMissingColumns=True))

    def append_import(self, other: EventLog, kept: int = KEPT_IN_MEMORY) -> EventLog:
        """The other log's rows behind this one's; the last ``kept`` of all stay."""
        return self.append(other).retained(kept)

    def retained(self, n: int = KEPT_IN_MEMORY) -> EventLog:
        """The rows that loading keeps (``KEPT_ON_DISK``: that writing keeps)."""
        return EventLog(self.df).tail(n)


def service_view(log: EventLog, limit: int | None = DEFAULT_LIMIT, group_by: str | None = None, needle: str | None = None, sort: str | None = None) -> DataFrame:
    """Filter, sort, then groups from the head or rows from the tail."""
    if limit == 0:
        return log.df.limit(0)
    view = log.filter(needle).sort(sort)
    return view.summary(group_by, limit) if group_by else view.tail(limit).rows()


def command_view(log: EventLog, limit: int | None = DEFAULT_LIMIT, group_by: str | None = None, needle: str | None = None, sort: str | None = None) -> DataFrame:
    """As :func:`service_view`, but all of it on the last ``DEFAULT_LIMIT`` rows only."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    if sort not in (None, BY_TIME) or group_by not in (None, "command"):
        raise ValueError("sort is by timestamp and grouping by command")
    view = log.tail(DEFAULT_LIMIT).filter(needle).sort(sort)
    if limit == 0:
        return view.df.limit(0)
    return view.grouped_entries(limit) if group_by else view.tail(limit).rows()


def restamped(rows: DataFrame, now: float) -> DataFrame:
    """Rows as if added now: every time is ``now``, whatever it was."""
    return rows.withColumn("timestamp", F.lit(now))


def wrapped(rows: DataFrame, runtime: dict[str, str] | None = None) -> DataFrame:
    """One row: the rows in order as ``entries``, and runtime facts as columns. For views that a limit has cut."""
    entry_ = F.struct("_pos", *(c for c in rows.columns if c != "_pos"))
    return with_runtime(rows.agg(F.sort_array(F.collect_list(entry_)).alias("entries")), runtime)


def with_runtime(rows: DataFrame, runtime: dict[str, str] | None = None) -> DataFrame:
    """Constant columns with facts of the runtime, as a verbose view has them."""
    return rows.withColumns({k: F.lit(v) for k, v in (runtime or {}).items()})


def limited(rows: DataFrame, setting: str | None, *order: str) -> DataFrame:
    """The first rows by a limit given as text (of the environment): none given is all, else a number from 0."""
    if setting is None:
        return rows
    if not setting.strip().isdigit():
        raise ValueError("the limit is a whole number, 0 or more")
    return rows.orderBy(*order).limit(int(setting))


def entry(command: Column, params: Column, timestamp: Column, success: Column, return_code: Column, duration_ms: Column) -> list[Column]:
    """The columns of a well-formed entry, with defaults for what is null."""
    return [
        ascii_clean(command).alias("command"),
        F.coalesce(params, F.array().cast("array<string>")).alias("params"),
        timestamp.cast("double").alias("timestamp"),
        F.coalesce(success, F.lit(False)).alias("success"),
        F.coalesce(return_code.cast("bigint"), F.lit(0)).alias("return_code"),
        duration_ms.cast("double").alias("duration_ms"),
    ]


def from_events(events: DataFrame) -> EventLog:
    """The driver's ``events`` table as a log."""
    return EventLog(
        events.select(
            F.col("event_id").alias("_pos"),
            F.col("event_type").alias("command"),
            epoch_seconds("ts").alias("timestamp"),
            (F.col("event_type") != "error").alias("success"),
            F.col("value").alias("duration_ms"),
            "props",
        )
    )


__all__ = ["KEPT_IN_MEMORY", "KEPT_ON_DISK", "EventLog", "command_view", "entry", "from_events", "service_view"]
