"""Readers for small-record files: JSON arrays and objects, dotenv, YAML, directories, literals.

JSON goes through VARIANT, so one odd element never spoils a file and unknown fields are kept.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import ascii_clean, ascii_safe, normalise_key, split_key_value, strip_quotes, stripped, unescape
from ..schema import KEY_VALUE, PLUGIN


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: value, parsed (null if it isn't JSON); no row for missing or empty files."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = spark.createDataFrame([], "value string")
    bare = F.regexp_replace("value", r"^\s+|\s+\z", "")
    return files.select(bare.alias("value")).where("value <> ''").select("value", F.try_parse_json("value").alias("parsed"))


def _kind(variant: str) -> Column:
    return F.expr(f"schema_of_variant({variant})")


def elements(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """_pos and the objects of a JSON array; other elements are passed over.

    A file that is no array raises when ``strict``, else gives nothing.
    """
    whole = _whole(spark, path)
    array = _kind("parsed").startswith("ARRAY")
    if strict:
        whole = whole.withColumn("parsed", F.when(array, F.col("parsed")).otherwise(F.raise_error(F.lit("not a JSON array")).cast("variant")))
    found = whole.where(array).select(F.posexplode(F.expr("variant_get(parsed, '$', 'array<variant>')")).alias("_pos", "_raw"))
    return found.where(_kind("_raw").startswith("OBJECT")).select(F.col("_pos").cast("bigint"), "_raw")


def _field(name: str, kind: str) -> Column:
    return F.expr(f"try_variant_get(_raw, '$.{name}', '{kind}')")


def _has(name: str) -> Column:
    return F.expr(f"variant_get(_raw, '$.{name}', 'variant')").isNotNull()


def _log(raw: DataFrame, command: Column, timestamp: Column) -> DataFrame:
    return raw.select(
        "_pos",
        command.alias("command"),
        _field("params", "array<string>").alias("params"),
        timestamp.alias("timestamp"),
        _field("success", "boolean").alias("success"),
        _field("return_code", "bigint").alias("return_code"),
        _field("duration_ms", "double").alias("duration_ms"),
        "_raw",
    )


def _command() -> Column:
    """The cleaned command: absent is empty, an explicit null is the text None."""
    null = F.expr("is_variant_null(variant_get(_raw, '$.command', 'variant'))")
    return ascii_clean(F.when(null, "None").otherwise(F.coalesce(_field("command", "string"), F.lit(""))))


def read_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """An event log from a JSON array; missing and empty files are empty logs."""
    return _log(elements(spark, path, strict), _command(), _field("timestamp", "double"))


def read_import(spark: SparkSession, path: str, now: float) -> DataFrame:
    """As :func:`read_log`, with ``now`` where an entry has no timestamp."""
    return _log(elements(spark, path), _command(), F.when(_has("timestamp"), _field("timestamp", "double")).otherwise(F.lit(now)))


def legacy_entry(raw: DataFrame) -> DataFrame:
    """Entries whose command may be under ``cmd``; empty ones go, the rest gets defaults."""
    command = F.coalesce(F.when(_field("command", "string") != "", _field("command", "string")), _field("cmd", "string"), F.lit(""))
    rows = _log(raw, ascii_safe(F.trim(command)), _field("timestamp", "double")).where("command <> ''")
    defaults = {"success": F.lit(True), "return_code": F.lit(0).cast("bigint"), "duration_ms": F.lit(0.0), "params": F.array().cast("array<string>")}
    return rows.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def read_legacy_import(spark: SparkSession, path: str) -> DataFrame:
    return legacy_entry(elements(spark, path))


def dotenv(lines: DataFrame, prefix: str = "") -> DataFrame:
    """key, value of numbered lines (``_pos``, ``value``): of a repeated key the last one.

    Blank lines and comments are passed over; a line without ``=`` or beyond ASCII raises with
    its number.
    """
    text = stripped(F.col("value"))
    used = lines.where((text != "") & ~text.startswith("#"))
    bad = F.concat(F.lit("line "), (F.col("_pos") + 1).cast("string"), F.lit(": not KEY=VALUE in ASCII"))
    good = F.when(text.contains("=") & F.col("value").rlike(r"^[\x00-\x7F]*\z"), text).otherwise(F.raise_error(bad).cast("string"))
    key, value = split_key_value(good)
    malformed = F.concat(F.lit("line "), (F.col("_pos") + 1).cast("string"), F.lit(": malformed escape"))
    plain = unescape(value)
    plain = F.when(value.isNotNull() & plain.isNull(), F.raise_error(malformed).cast("string")).otherwise(plain)
    rows = used.select("_pos", normalise_key(key, prefix).alias("key"), strip_quotes(plain).alias("value"))
    return rows.groupBy("key").agg(F.max_by("value", "_pos").alias("value"))


def read_dotenv(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """As :func:`dotenv`, for files that fit the driver. Spark's readers pass over names that begin with a dot, so the one file is opened here."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return dotenv(spark.createDataFrame(list(enumerate(text.splitlines())), "_pos bigint, value string"), prefix)


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """key, value (VARIANT) of a JSON object; missing or bad JSON is empty, another value raises."""
    whole = _whole(spark, path).where("parsed is not null")
    checked = whole.withColumn(
        "parsed", F.when(_kind("parsed").startswith("OBJECT"), F.col("parsed")).otherwise(F.raise_error(F.lit("not a JSON object")).cast("variant"))
    )
    return spark.sql("SELECT e.key, e.value FROM {file}, LATERAL variant_explode(parsed) AS e(pos, key, value)", file=checked)


def read_environment(spark: SparkSession, environment: Mapping[str, str] | None = None, prefix: str = "") -> DataFrame:
    """The driver's environment, or another mapping, as keys and values."""
    rows = [(k, v) for k, v in (os.environ if environment is None else environment).items() if k.startswith(prefix)]
    return spark.createDataFrame(rows, KEY_VALUE).withColumn("key", normalise_key(F.col("key"), prefix))


def items(spark: SparkSession, rows: Iterable[tuple[str, str | None]]) -> DataFrame:
    """A collection from literals, numbered from 1."""
    return spark.createDataFrame([(k + 1, name, text) for k, (name, text) in enumerate(rows)], "id bigint, name string, description string")


def plugin_directories(spark: SparkSession, root: str) -> DataFrame:
    """Names of the folders under ``root`` that hold a ``plugin.py``."""
    try:
        files = spark.read.format("binaryFile").load(f"{root}/*/plugin.py").select("path")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = spark.createDataFrame([], "path string")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("name")).distinct().orderBy("name")


def read_plugins(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of plugins, one JSON object in each file; raises where name, desc or version is missing."""
    fields = [f"try_variant_get(parsed, '$.{c.split()[0]}', 'string') AS {c.split()[0]}" for c in PLUGIN.split(", ")]
    found = _whole(spark, path).selectExpr(*fields)
    whole = F.col("name").isNotNull() & F.col("desc").isNotNull() & F.col("version").isNotNull()
    return found.withColumn("name", F.when(whole, F.col("name")).otherwise(F.raise_error(F.lit("name, desc or version is missing")).cast("string")))


@F.pandas_udf(StringType())
def yaml_to_json(texts: pd.Series) -> pd.Series:
    """YAML as JSON text; an empty document is ``{}``, a malformed one null."""
    import json

    import yaml

    def convert(text: str) -> str | None:
        try:
            return json.dumps(yaml.safe_load(text) or {}, default=str)
        except yaml.YAMLError:
            return None

    return texts.map(convert, na_action="ignore")


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """path and parsed (VARIANT) of YAML files; a missing file gives no row."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = spark.createDataFrame([], "value string")
    return files.select(F.try_parse_json(yaml_to_json("value")).alias("parsed"))


def known_commands(spark: SparkSession, path: str, fallback: list[str]) -> DataFrame:
    """Commands that a spec file lists, or the fallback where there is none."""
    listed = _whole(spark, path).select(F.explode(F.expr("try_variant_get(parsed, '$.commands', 'array<string>')")).alias("command"))
    return listed.distinct() if not listed.isEmpty() else spark.createDataFrame([(c,) for c in fallback], "command string")
