"""Writers: JSON arrays, dotenv, YAML and JSON exports, several at once.

Exports in one file are for small stores; what is large is written by Spark in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape


def as_json_array(df: DataFrame, order: str = "_pos", pretty: bool = False) -> DataFrame:
    """One row: the rows as one JSON array in order; null fields are written. For stores that retention bounds."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(order), F.struct(*[c for c in df.columns if c != order]).alias("row"))))
    options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {})
    return df.agg(F.to_json(F.transform(entries, lambda e: e["row"]), options).alias("value"))


def dotenv_lines(store: DataFrame, prefix: str = "", escaped: bool = True) -> DataFrame:
    """Lines PREFIXKEY=value in order of key; an export leaves values as they are."""
    value: Column = F.coalesce("value", F.lit(""))
    line = F.concat(F.lit(prefix), F.upper("key"), F.lit("="), escape(value) if escaped else value)
    return store.orderBy("key").select(line.alias("value"))


def json_object(store: DataFrame) -> DataFrame:
    """One row: the store as a JSON object with upper-case keys."""
    pairs = F.sort_array(F.collect_list(F.struct(F.upper("key").alias("key"), "value")))
    return store.agg(F.to_json(F.map_from_entries(pairs)).alias("value"))


def yaml_lines(store: DataFrame) -> DataFrame:
    """Lines KEY: "value" in order of key; JSON strings are YAML strings."""
    quoted = F.expr("substring(to_json(array(value)), 2, length(to_json(array(value))) - 2)")
    return store.orderBy("key").select(F.concat(F.upper("key"), F.lit(": "), quoted).alias("value"))


def export(store: DataFrame, path: str, kind: str, prefix: str = "") -> None:
    """Write a key-value store as ``env``, ``yaml`` or ``json`` text, one part."""
    made = {"env": lambda: dotenv_lines(store, prefix, escaped=False), "yaml": lambda: yaml_lines(store), "json": lambda: json_object(store)}[kind]()
    made.coalesce(1).write.mode("errorifexists").text(path)


def write_all(df: DataFrame, paths: list[str], kind: str = "parquet") -> None:
    """The same rows to several places, computed once."""
    df = df.cache()
    try:
        for path in paths:
            df.write.format(kind).mode("errorifexists").save(path)
    finally:
        df.unpersist()


def emit(df: DataFrame, path: str | None = None, level: str = "info", quiet: bool = False, pretty: bool = False) -> None:
    """The rows as JSON lines to a folder or, by :meth:`DataFrame.show`'s way over the driver, to the
    console; ``quiet`` lets errors alone pass."""
    if quiet and level not in ("error", "critical"):
        return
    text = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {})).alias("value"))
    if path is not None:
        text.write.mode("errorifexists").text(path)
        return
    for row in text.toLocalIterator():
        print(row.value)


def discard(df: DataFrame) -> None:
    """Compute all rows and keep none."""
    df.write.format("noop").mode("overwrite").save()
