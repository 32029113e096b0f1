"""Queries over the driver's tables, each with the DuckDB SQL that its result must equal."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import collection, eventlog, keyvalue, lines
from ..operators.registry import FunctionRegistry, choices
from ..scratch import new_path
from ..sources import records, sinks
from ..streaming import streams
from .stores import LogStore, VersionedStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def register(make: Query) -> Query:
        QUERIES[make.__name__] = make
        if sql:
            SQL[make.__name__] = sql
        return make

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> eventlog.EventLog:
    return eventlog.from_events(table(spark, sf_dir, "events"))


#: The events table as a log, in SQL.
LOG = "SELECT event_id AS _pos, event_type AS command, epoch_us(ts) / 1e6 AS ts, value AS duration_ms FROM events"


# --- the event log


@query("SELECT event_id AS _pos, event_type AS command FROM events WHERE contains(event_type, 'ur')")
def hist_filter(spark, sf_dir):
    return log(spark, sf_dir).filter("ur").df.select("_pos", "command")


@query(f"SELECT _pos, command, ts AS timestamp FROM ({LOG}) ORDER BY ts DESC, _pos DESC LIMIT 20")
def hist_tail(spark, sf_dir):
    return eventlog.service_view(log(spark, sf_dir), sort="timestamp").select("_pos", "command", "timestamp")


@query(f"SELECT _pos, command FROM ({LOG}) WHERE contains(command, 'c') ORDER BY _pos DESC LIMIT 50")
def hist_filter_tail(spark, sf_dir):
    return eventlog.service_view(log(spark, sf_dir), limit=50, needle="c").select("_pos", "command")


@query(f"SELECT command AS \"group\", count(*) AS \"count\", max(ts) AS last_run, min(_pos) AS first_pos FROM ({LOG}) GROUP BY command")
def hist_group_summary(spark, sf_dir):
    return log(spark, sf_dir).summary()


@query(f"SELECT command AS \"group\", count(*) AS \"count\", max(ts) AS last_run, min(_pos) AS first_pos FROM ({LOG}) GROUP BY command ORDER BY min(_pos) LIMIT 3")
def hist_first_appearance(spark, sf_dir):
    return eventlog.service_view(log(spark, sf_dir), limit=3, group_by="command")


@query(f"SELECT 'unknown' AS \"group\", count(*) AS \"count\", max(ts) AS last_run, min(_pos) AS first_pos FROM ({LOG})")
def hist_group_by_missing_field(spark, sf_dir):
    return log(spark, sf_dir).summary("no_such_field")


@query(
    f"""WITH last AS (SELECT * FROM ({LOG}) ORDER BY _pos DESC LIMIT 20)
    SELECT command AS "group", count(*) AS "count", string_agg(CAST(_pos AS VARCHAR), ',' ORDER BY _pos) AS entries FROM last GROUP BY command"""
)
def hist_group_entries(spark, sf_dir):
    groups = eventlog.command_view(log(spark, sf_dir), group_by="command")
    return groups.select("group", "count", F.array_join(F.col("entries._pos").cast("array<string>"), ",").alias("entries"))


@query(
    f"""WITH last AS (SELECT * FROM ({LOG}) ORDER BY _pos DESC LIMIT 20)
    SELECT command AS "group", count(*) AS "count", min(_pos) AS first_pos FROM last WHERE contains(command, 'c') GROUP BY command"""
)
def hist_filter_after_cap(spark, sf_dir):
    return eventlog.command_view(log(spark, sf_dir), needle="c", group_by="command").select("group", "count", "first_pos")


@query("SELECT event_id AS _pos FROM events ORDER BY event_id DESC LIMIT 10000")
def hist_retain_memory(spark, sf_dir):
    return log(spark, sf_dir).retained().df.select("_pos")


@query("SELECT event_id AS _pos FROM events ORDER BY event_id DESC LIMIT 1000")
def hist_retain_disk(spark, sf_dir):
    return log(spark, sf_dir).retained(eventlog.KEPT_ON_DISK).df.select("_pos")


@query(
    """SELECT event_id AS _pos, event_type AS command FROM events
    UNION ALL SELECT o_orderkey + (SELECT max(event_id) FROM events) + 1, o_orderpriority FROM orders"""
)
def append_import(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_pos"), F.col("o_orderpriority").alias("command"))
    return log(spark, sf_dir).append(eventlog.EventLog(orders)).df.select("_pos", "command")


@query(
    """SELECT event_id AS _pos, event_type AS command, event_id % 5 <> 0 AS success, CAST(0 AS BIGINT) AS return_code,
        coalesce(CASE WHEN event_id % 2 = 0 THEN value END, 0.0) AS duration_ms
    FROM events WHERE event_id % 3 <> 0"""
)
def import_legacy(spark, sf_dir):
    """Entries with the command under ``cmd``, an empty ``command`` or neither, as JSON."""
    n = F.col("event_id")
    fields = [
        F.when(n % 3 == 1, F.lit("")).otherwise(F.when(n % 3 == 2, F.col("event_type"))).alias("command"),
        F.when(n % 3 == 1, F.col("event_type")).alias("cmd"),
        (n % 5 != 0).alias("success"),
        F.when(n % 2 == 0, F.col("value")).alias("duration_ms"),
    ]
    raw = table(spark, sf_dir, "events").select(n.alias("_pos"), F.parse_json(F.to_json(F.struct(*fields))).alias("_raw"))
    return records.legacy_entry(raw).select("_pos", "command", "success", "return_code", "duration_ms")


@query(
    """SELECT event_id AS _pos, event_type AS command, event_type <> 'error' AS success, CAST(0 AS BIGINT) AS return_code, value AS duration_ms FROM events"""
)
def normal_entries(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    cols = eventlog.entry(F.col("event_type"), F.lit(None).cast("array<string>"), F.lit(0.0), F.col("event_type") != "error", F.lit(None), F.col("value"))
    return df.select(F.col("event_id").alias("_pos"), *cols).drop("params", "timestamp")


# --- the collection


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"))


ITEMS = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS description FROM customer"


@query(f"SELECT *, (SELECT count(*) FROM customer) AS total FROM ({ITEMS}) ORDER BY id LIMIT 10 OFFSET 30")
def items_page(spark, sf_dir):
    return collection.page(customers(spark, sf_dir), offset=30, limit=10)


@query(f"SELECT * FROM ({ITEMS}) WHERE id = 7")
def items_lookup(spark, sf_dir):
    return collection.lookup(customers(spark, sf_dir), 7)


@query(
    f"""WITH new AS (SELECT n_name AS name, min(CAST(n_regionkey AS VARCHAR)) AS description FROM nation GROUP BY 1)
    SELECT * FROM ({ITEMS}) UNION ALL
    SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY name), name, description FROM new"""
)
def items_insert(spark, sf_dir):
    """New rows from nations and, as taken names, customers."""
    items = customers(spark, sf_dir)
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("description"))
    return collection.insert(items, nations.unionByName(items.select("name", "description")))


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN concat('new ', c_name) ELSE c_name END AS name,
        CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS description FROM customer""")
def items_update(spark, sf_dir):
    items = customers(spark, sf_dir)
    overdrawn = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    new = overdrawn.select(F.col("c_custkey").alias("id"), F.concat(F.lit("new "), "c_name").alias("name"), F.lit(None).cast("string").alias("description"))
    return collection.update(items, new)


@query(f"SELECT * FROM ({ITEMS}) WHERE id NOT IN (SELECT o_custkey FROM orders)")
def items_delete(spark, sf_dir):
    return collection.delete(customers(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@query("SELECT name FROM (SELECT concat('Customer#', lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) AS name FROM supplier) WHERE name IN (SELECT c_name FROM customer)")
def unique_probe(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("name"))
    return collection.taken_names(customers(spark, sf_dir), names)


@query("SELECT n_nationkey, n_name AS name, coalesce(r_name, n_name) AS resolved FROM nation LEFT JOIN region ON n_name = concat('NATION_', r_regionkey)")
def alias_lookup(spark, sf_dir):
    calls = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    aliases = table(spark, sf_dir, "region").select(F.concat(F.lit("NATION_"), "r_regionkey").alias("alias"), F.col("r_name").alias("canonical"))
    return collection.resolve_alias(calls, aliases)


# --- key-value tables


@query("SELECT event_type AS key, arg_max(event_id, event_id) AS value FROM events GROUP BY 1")
def kv_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("value"), F.col("event_id").alias("_pos"))
    return keyvalue.last_by_key(rows)


STORE = "SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS value FROM customer"
CHANGES = "SELECT CAST(o_custkey AS VARCHAR) AS key, max(o_orderpriority) AS value FROM orders GROUP BY 1"


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.max("o_orderpriority").alias("value"))


@query(f"SELECT coalesce(c.key, s.key) AS key, coalesce(c.value, s.value) AS value FROM ({STORE}) s FULL JOIN ({CHANGES}) c USING (key)")
def kv_upsert(spark, sf_dir):
    return keyvalue.upsert(store(spark, sf_dir), changes(spark, sf_dir))


@query(f"SELECT * FROM ({STORE}) WHERE key NOT IN (SELECT key FROM ({CHANGES}))")
def kv_delete(spark, sf_dir):
    return keyvalue.delete(store(spark, sf_dir), changes(spark, sf_dir))


@query(f"SELECT key, count(*) OVER () AS n FROM ({STORE})")
def kv_keys(spark, sf_dir):
    keys = keyvalue.listed(store(spark, sf_dir))
    return keys.crossJoin(F.broadcast(keys.agg(F.count(F.lit(1)).alias("n"))))  # one row


@query(
    """WITH f AS (SELECT lower(n_name) AS key, CASE WHEN n_regionkey = 0 THEN 'True' WHEN n_regionkey = 1 THEN 'false' ELSE n_name END AS value FROM nation),
    e AS (SELECT lower(n_name) AS key, 'true' AS value FROM nation WHERE n_regionkey IN (1, 2) UNION ALL SELECT lower(r_name), r_name FROM region)
    SELECT coalesce(e.key, f.key) AS key, coalesce(e.value, f.value) AS value,
        CASE WHEN e.value IS NULL AND lower(f.value) = 'true' THEN true WHEN e.value IS NULL AND lower(f.value) = 'false' THEN false END AS as_boolean
    FROM f FULL JOIN e ON e.key = f.key"""
)
def cfg_overlay(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    value = F.when(F.col("n_regionkey") == 0, "True").when(F.col("n_regionkey") == 1, "false").otherwise(F.col("n_name"))
    file = nation.select(F.lower("n_name").alias("key"), value.alias("value"))
    env = nation.where("n_regionkey IN (1, 2)").select(F.lower("n_name").alias("key"), F.lit("true").alias("value"))
    return keyvalue.overlay(file, env.unionByName(region.select(F.lower("r_name").alias("key"), F.col("r_name").alias("value"))))


@query(
    """SELECT c_custkey AS id, CASE WHEN n.n_regionkey < 3 THEN concat('name=', n_name, ',nation=', n_name, ',path=', c_name)
        ELSE concat('name=', c_name, ',path=', c_name) END AS fields
    FROM customer JOIN nation n ON c_nationkey = n_nationkey"""
)
def struct_merge(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    left = c.select(F.col("c_custkey").alias("id"), F.create_map(F.lit("name"), "c_name", F.lit("path"), "c_name").alias("fields"))
    right = c.join(n.where("n_regionkey < 3"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.create_map(F.lit("name"), "n_name", F.lit("nation"), "n_name").alias("fields")
    )
    merged = keyvalue.merge_fields(left, right, "id")
    pairs = F.sort_array(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return merged.select("id", F.array_join(pairs, ",").alias("fields"))


@query("SELECT concat('APP_', upper(n_name), '=', n_name) AS value FROM nation")
def export_env(spark, sf_dir):
    return sinks.dotenv_lines(table(spark, sf_dir, "nation").select(F.lower("n_name").alias("key"), F.col("n_name").alias("value")), "APP_", escaped=False)


@query("""SELECT concat('[', string_agg(concat('{"command":"', event_type, '","value":', event_id, '}'), ',' ORDER BY event_id), ']') AS value
    FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 20)""")
def export_history(spark, sf_dir):
    rows = log(spark, sf_dir).tail(20).df.select("_pos", "command", F.col("_pos").alias("value"))
    return sinks.as_json_array(rows)


# --- aggregates over the log


@query(
    """SELECT count(*) AS n, count(DISTINCT event_type) AS n_types, max(event_id) AS last_id,
        bool_or(value > 99) AS any_long, bool_and(value >= 0) AS none_negative FROM events"""
)
def log_totals(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("event_type").alias("n_types"),
        F.max("event_id").alias("last_id"),
        F.bool_or(F.col("value") > 99).alias("any_long"),
        F.bool_and(F.col("value") >= 0).alias("none_negative"),
    )


@query("SELECT DISTINCT event_type AS command FROM events")
def command_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("command")).distinct().orderBy("command")


# --- text functions


@query(r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\x20-\x7E]', '', 'g') AS cleaned FROM documents")
def fn_ascii_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.ascii_clean("text").alias("cleaned"))


@query(r"SELECT doc_id, regexp_replace(text, '[^\x20-\x7E\n\r\t]', '?', 'g') AS safe FROM documents")
def fn_ascii_safe(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.ascii_safe(F.col("text")).alias("safe"))


@query(r"""SELECT doc_id, replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r'), '"', '\"') AS escaped FROM documents""")
def fn_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.escape(F.col("text")).alias("escaped"))


@query("SELECT doc_id, text AS back FROM documents")
def fn_unescape(spark, sf_dir):
    """Escaping and decoding give the text back."""
    return table(spark, sf_dir, "documents").select("doc_id", T.unescape(T.escape(F.col("text"))).alias("back"))


@query("SELECT event_id, split_part(kv, '=', 1) AS key, substr(kv, instr(kv, '=') + 1) AS value FROM (SELECT event_id, concat(event_type, '=', props, '=x') AS kv FROM events)")
def fn_split_kv(spark, sf_dir):
    line = F.concat(F.col("event_type"), F.lit("="), F.col("props"), F.lit("=x"))
    key, value = T.split_key_value(F.col("line"))
    return table(spark, sf_dir, "events").select("event_id", line.alias("line")).select("event_id", key.alias("key"), value.alias("value"))


@query("SELECT p_partkey, lower(substr(p_brand, 7)) AS key FROM part")
def fn_normalise_key(spark, sf_dir):
    padded = F.concat(F.lit("  "), F.col("p_brand"), F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalise_key(padded, "Brand#").alias("key"))


@query("SELECT c_custkey, c_name AS bare, concat('\"', c_name) AS half FROM customer")
def fn_strip_quotes(spark, sf_dir):
    quoted = F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))
    half = F.concat(F.lit('"'), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.strip_quotes(quoted).alias("bare"), T.strip_quotes(half).alias("half"))


@query("SELECT c_custkey, concat(c_name, chr(10), 'x') AS value FROM customer")
def fn_strip_quotes_any(spark, sf_dir):
    quoted = F.concat(F.lit("'"), F.col("c_name"), F.lit("\\nx'"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.strip_quotes_any(quoted).alias("value"))


@query("SELECT event_id, event_type AS plain FROM events")
def fn_strip_ansi(spark, sf_dir):
    coloured = F.concat(F.lit("\x1b[1;31m"), F.col("event_type"), F.lit("\x1b[0m"))
    return table(spark, sf_dir, "events").select("event_id", T.strip_ansi(coloured).alias("plain"))


@query("SELECT c_custkey, c_mktsegment AS first, concat('\"', c_name, ';x\"') AS second FROM customer")
def fn_split_quoted(spark, sf_dir):
    line = F.concat(F.col("c_mktsegment"), F.lit(';"'), F.col("c_name"), F.lit(';x"'))
    parts = T.split_unquoted(line)
    return table(spark, sf_dir, "customer").select("c_custkey", parts[0].alias("first"), parts[1].alias("second"))


@query("SELECT c_custkey, 3 AS n, concat(c_mktsegment, ' x') AS middle FROM customer")
def fn_shell_split(spark, sf_dir):
    line = F.concat(F.lit("run '"), F.col("c_mktsegment"), F.lit(" x' "), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.shell_split(line).alias("t")).select("c_custkey", F.size("t").alias("n"), F.col("t")[1].alias("middle"))


@query(
    """SELECT o_orderkey, lower(trim(o_orderpriority)) AS fmt, CASE WHEN o_orderstatus IN ('O', 'F') THEN lower(o_orderstatus) END AS state,
        CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS flag,
        CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice END AS number,
        CAST(trunc(o_totalprice * 1000) AS BIGINT) AS ms, '***' AS hidden
    FROM orders"""
)
def fn_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    number = F.when(F.col("o_orderkey") % 2 == 0, price.cast("string")).otherwise(F.to_json(F.struct(price.alias("value"))))
    return o.select(
        "o_orderkey",
        T.normal_format(F.concat(F.lit(" "), F.col("o_orderpriority"))).alias("fmt"),
        T.parse_enum(status, ["o", "f"]).alias("state"),
        T.parse_bool(F.when(status == "O", "TRUE").when(status == "F", "False").otherwise(status)).alias("flag"),
        T.parse_float(number).alias("number"),
        T.whole_milliseconds(price).alias("ms"),
        T.redact(status).alias("hidden"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, 'none' AS absent FROM events")
def fn_json_get(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.json_field(F.col("props"), "k").alias("k"), T.json_field(F.col("props"), "zz", "none").alias("absent"))


@query("SELECT page_id, split_part(url, '/', -1) AS base, CASE WHEN page_id % 3 = 0 THEN 'yaml' WHEN page_id % 3 = 1 THEN 'env' ELSE 'json' END AS fmt FROM pages")
def fn_paths(spark, sf_dir):
    n = F.col("page_id")
    path = F.concat(F.col("page_id"), F.when(n % 3 == 0, ".YML").when(n % 3 == 1, ".env").otherwise(".txt"))
    return table(spark, sf_dir, "pages").select("page_id", T.base_name(F.col("url")).alias("base"), T.format_of(path).alias("fmt"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'None' WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END AS shown, 0.5 * pow(2, event_id % 6) AS delay FROM events")
def fn_shown(spark, sf_dir):
    n = F.col("event_id")
    value = F.when(n % 4 != 0, n % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", T.shown(value, "boolean").alias("shown"), T.backoff_delay(n % 6, 0.5, 2.0).alias("delay"))


@query("SELECT doc_id, nfc_normalize(text) AS composed FROM documents")
def fn_nfc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.nfc("text").alias("composed"))


@query("SELECT n_nationkey, levenshtein(n_name, 'NATION_1') AS distance FROM nation")
def fn_edit_distance(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.levenshtein("n_name", F.lit("NATION_1")).alias("distance"))


@query(
    """SELECT n_nationkey, CASE WHEN m.distance BETWEEN 1 AND 3 THEN m.name END AS hint
    FROM nation, LATERAL (SELECT r_name AS name, levenshtein(n_name, r_name) AS distance FROM region ORDER BY 2, 1 LIMIT 1) m"""
)
def nearest_command(spark, sf_dir):
    known = [r.r_name for r in table(spark, sf_dir, "region").collect()]  # a table of fixed size
    return table(spark, sf_dir, "nation").select("n_nationkey", lines.nearest_name(F.col("n_name"), known).alias("hint"))


# --- predicates


@query(
    r"""SELECT c_custkey, regexp_full_match(c_name, '[A-Za-z0-9_]+') AS is_key, regexp_full_match(c_name, '[a-zA-Z0-9_-]+') AS is_plugin,
        regexp_full_match(concat(c_nationkey, '.0.', c_custkey), '[0-9]+\.[0-9]+\.[0-9]+') AS is_version,
        starts_with(c_mktsegment, 'AUTO') AS has_prefix, c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_allowed,
        regexp_matches(concat(c_name, CASE WHEN c_custkey % 2 = 0 THEN '|x' ELSE '' END), '[;|&><`!]') AS has_meta, true AS same_name
    FROM customer"""
)
def fn_predicates(spark, sf_dir):
    name, n = F.col("c_name"), F.col("c_custkey")
    version = F.concat_ws(".", F.col("c_nationkey"), F.lit("0"), n)
    args = F.array(F.lit("plain"), F.concat(name, F.when(n % 2 == 0, "|x").otherwise("")))
    return table(spark, sf_dir, "customer").select(
        n,
        P.is_config_key(name).alias("is_key"),
        P.is_plugin_name(name).alias("is_plugin"),
        P.is_version(version).alias("is_version"),
        P.has_prefix(F.col("c_mktsegment"), "AUTO").alias("has_prefix"),
        P.is_allowed(F.concat(F.lit("/bin/"), "c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("is_allowed"),
        P.has_shell_meta(args).alias("has_meta"),
        P.same_name(F.upper(name), F.lower(name)).alias("same_name"),
    )


@query(
    r"""SELECT doc_id, regexp_full_match(text, '[\x00-\x7F]*', 's') AS is_ascii, regexp_full_match(text, '[\x20-\x7E]*', 's') AS is_printable,
        false AS is_key, length(text) > 0 AS recorded FROM documents"""
)
def fn_text_predicates(spark, sf_dir):
    text = F.col("text")
    key = P.is_memory_key(F.concat(text, F.lit(" ")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", P.is_ascii(text).alias("is_ascii"), P.is_printable_ascii(text).alias("is_printable"), key.alias("is_key"), P.is_recorded(text).alias("recorded")
    )


@query("SELECT o_orderkey, o_orderkey % 3 <> 2 AS is_line, o_orderkey % 4 IN (1, 2) AS in_range, CASE WHEN o_orderstatus = 'O' THEN 'healthy' ELSE 'unhealthy' END AS health FROM orders")
def fn_lines_and_versions(spark, sf_dir):
    n = F.col("o_orderkey")
    line = F.when(n % 3 == 0, F.lit("# note")).when(n % 3 == 1, F.concat(F.lit("A_KEY="), n)).otherwise(F.lit("no line"))
    version = F.concat(n % 4, F.lit(".5"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", P.is_env_line(line).alias("is_line"), P.satisfies(">=1.0,<3")(version).alias("in_range"), P.health(F.col("o_orderstatus") == "O").alias("health")
    )


# --- lines and trees


@query(
    """SELECT doc_id, line, trim(l, ' ' || chr(9)) AS segment FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
        FROM documents)
    WHERE trim(l, ' ' || chr(9)) <> ''"""
)
def segments(spark, sf_dir):
    """The SQL parts at line feeds alone: the table's texts have no semicolon and no other line end."""
    return lines.segments(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", F.col("line").cast("bigint"), "segment")


@query(
    """SELECT r_name AS name, r_name AS path, 0 AS depth FROM region
    UNION ALL SELECT n_name, concat(r_name, ' ', n_name), 1 FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT s_name, concat(r_name, ' ', n_name, ' ', s_name), 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def tree_paths(spark, sf_dir):
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    first = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    second = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("parent"), F.col("s_name").alias("child"))
    return lines.tree_paths(first.unionByName(second), region.select(F.col("r_name").alias("name")))


# --- without a counterpart in the reference


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def ext_pricing_summary(spark, sf_dir):
    kept = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


@query(
    """SELECT n_name, count(*) AS lines, count(DISTINCT o_orderkey) AS orders FROM customer JOIN orders ON c_custkey = o_custkey
    JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""
)
def ext_lines_by_nation(spark, sf_dir):
    c, o, li, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "nation"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    per_order = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"))  # before the join, so that it moves one row per order
    return joined.join(per_order, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(F.sum("k").alias("lines"), F.count(F.lit(1)).alias("orders"))


@query(
    """SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
    FROM orders) WHERE rank <= 3"""
)
def ext_top_orders(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("rank")).where("rank <= 3")


@query(
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders
    GROUP BY CUBE (o_orderstatus, o_orderpriority)"""
)
def ext_order_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_hourly_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT a.event_id, b.event_id AS before_id FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b
    ON a.user_id = b.user_id AND a.ts > b.ts WHERE a.event_type = 'click'"""
)
def ext_asof_purchase(spark, sf_dir):
    """For each click the user's last purchase before it: one window over the user's events, no join."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    earlier = Window.partitionBy("user_id").orderBy(T.epoch_micros("ts")).rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).over(earlier)
    return e.select("event_id", "event_type", last["event_id"].alias("before_id")).where("event_type = 'click'").drop("event_type")


# --- files, stores, streams and registered functions


LAST = "SELECT row_number() OVER (ORDER BY event_id) - 1 AS _pos, * FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 1000)"


def _as_file(df: DataFrame, name: str) -> str:
    """The rows of one text column as a text file in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.coalesce(1).write.text(path)
    return path


@query(f"SELECT _pos, event_type AS command, epoch_us(ts) / 1e6 AS timestamp, event_type <> 'error' AS success, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM ({LAST})")
def scan_log(spark, sf_dir):
    """What a log keeps on disk written as a JSON array among elements that are no objects, and read again."""
    rows = log(spark, sf_dir).retained(eventlog.KEPT_ON_DISK).df.withColumn("props", F.from_json("props", "k bigint"))
    array = sinks.as_json_array(rows).select(F.regexp_replace("value", r"\]\z", ', 7, "text", null]').alias("value"))
    k = F.expr("try_variant_get(_raw, '$.props.k', 'bigint')")
    return records.read_log(spark, _as_file(array, "log")).select("_pos", "command", "timestamp", "success", k.alias("k"))


@query(f"SELECT _pos, event_type AS command, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) / 1e6 ELSE 12.5 END AS timestamp FROM ({LAST})")
def scan_import(spark, sf_dir):
    rows = log(spark, sf_dir).retained(eventlog.KEPT_ON_DISK).df
    known = F.to_json(F.struct("command", F.when(F.col("_pos") % 2 == 0, F.col("timestamp")).alias("timestamp")))  # null fields are left out
    array = rows.agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_pos", known.alias("e")))), lambda x: x["e"]), ","), F.lit("]")).alias("value"))
    return records.read_import(spark, _as_file(array, "import"), now=12.5).select("_pos", "command", "timestamp")


#: Events in one file of a whole import.
CHUNK = 1000


@query("SELECT event_id, event_type AS command, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) / 1e6 ELSE 12.5 END AS timestamp FROM events")
def scan_import_all(spark, sf_dir):
    """All events as JSON arrays of at most ``CHUNK`` consecutive ids each, read again as one import."""
    rows = log(spark, sf_dir).df.select(F.col("_pos").alias("event_id"), "command", F.when(F.col("_pos") % 2 == 0, F.col("timestamp")).alias("timestamp"))
    entry = F.struct("event_id", F.to_json(F.struct("event_id", "command", "timestamp")).alias("e"))
    listed = rows.groupBy(F.floor(F.col("event_id") / CHUNK)).agg(F.array_sort(F.collect_list(entry)).alias("es"))
    arrays = listed.select(F.concat(F.lit("["), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("]")).alias("value"))
    path = new_path(spark, "imports")
    arrays.write.option("maxRecordsPerFile", 1).text(path)  # a file is one array
    return records.read_import(spark, path, now=12.5).select(F.expr("try_variant_get(_raw, '$.event_id', 'bigint')").alias("event_id"), "command", "timestamp")


@query("SELECT lower(c_name) AS key, c_mktsegment AS value FROM customer")
def scan_dotenv(spark, sf_dir):
    """Written lines, each key once more before with another value."""
    store_ = table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    old = sinks.dotenv_lines(store_.withColumn("value", F.lit("old")), "APP_").select(F.lit(0).alias("_pos"), "value")
    new = sinks.dotenv_lines(store_.withColumn("value", F.concat(F.lit('"'), "value", F.lit('"'))), "APP_", escaped=False).select(F.lit(1).alias("_pos"), "value")
    return records.dotenv(old.unionByName(new), "APP_")


@query("SELECT upper(n_name) AS key, CAST(n_regionkey AS BIGINT) AS value FROM nation")
def scan_memory(spark, sf_dir):
    pairs = table(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(F.struct(F.upper("n_name"), "n_regionkey"))).alias("m"))
    path = _as_file(pairs.select(F.to_json("m").alias("value")), "memory")
    return records.read_memory(spark, path).select("key", F.expr("variant_get(value, '$', 'bigint')").alias("value"))


@query("SELECT concat(upper(n_name), ': \"', n_name, '\"') AS value FROM nation")
def export_yaml(spark, sf_dir):
    return sinks.yaml_lines(table(spark, sf_dir, "nation").select(F.lower("n_name").alias("key"), F.col("n_name").alias("value")))


@query("""SELECT concat('{', string_agg(concat('"', upper(r_name), '":"', r_name, '"'), ',' ORDER BY upper(r_name)), '}') AS value FROM region""")
def export_json(spark, sf_dir):
    return sinks.json_object(table(spark, sf_dir, "region").select(F.lower("r_name").alias("key"), F.col("r_name").alias("value")))


@query(
    """WITH two AS (SELECT event_id AS _pos, event_type AS command FROM events
        UNION ALL SELECT (SELECT max(event_id) FROM events) + 1 + o_orderkey, o_orderpriority FROM orders)
    SELECT command FROM (SELECT * FROM two ORDER BY _pos DESC LIMIT 1000)"""
)
def store_log(spark, sf_dir):
    """Two batches appended to a store that keeps its last rows."""
    kept = LogStore(spark, new_path(spark, "log-store"), "_pos bigint, command string")
    kept.replace(log(spark, sf_dir).df.select("_pos", "command"))
    kept.append(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_pos"), F.col("o_orderpriority").alias("command")))
    return kept.read().select("command")


@query(f"SELECT coalesce(c.key, s.key) AS key, coalesce(c.value, s.value) AS value FROM ({STORE}) s FULL JOIN ({CHANGES}) c USING (key) WHERE coalesce(c.key, s.key) <> '7'")
def store_key_values(spark, sf_dir):
    """A versioned store after a load, an upsert and a delete."""
    kept = VersionedStore(spark, new_path(spark, "kv-store"), "key string, value string")
    kept.write(store(spark, sf_dir))
    kept.change(lambda df: keyvalue.upsert(df, changes(spark, sf_dir)))
    kept.change(lambda df: keyvalue.delete(df, spark.createDataFrame([("7",)], "key string")))
    return kept.read()


@query("SELECT event_id, event_type FROM events")
def stream_growing_log(spark, sf_dir):
    """All events through a file stream that takes what is there and stops."""
    events = table(spark, sf_dir, "events")
    out = new_path(spark, "stream-out")
    streams.take_available(streams.growing_log(spark, sf_dir, events.schema, "events.parquet").select("event_id", "event_type"), out, new_path(spark, "stream-state"))
    return spark.read.parquet(out)


@query("SELECT n_nationkey, concat(upper(n_name), '!') AS shouted FROM nation")
def registered_function(spark, sf_dir):
    """A vectorized function called by its alias."""
    names = FunctionRegistry(spark)

    @F.pandas_udf("string")
    def shout(names_: pd.Series) -> pd.Series:
        return names_.str.upper() + "!"

    names.register("lodestream_shout", shout, alias="shout_it")
    return table(spark, sf_dir, "nation").select("n_nationkey", names.call("shout_it", F.col("n_name")).alias("shouted"))


@query("SELECT DISTINCT c_mktsegment AS choice FROM customer WHERE starts_with(lower(c_mktsegment), 'b')")
def completion_choices(spark, sf_dir):
    return choices(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "choice"), "choice", "B", case_sensitive=False)


# --- imports with retention, listings, names and sets


@query(
    """WITH two AS (SELECT event_id AS _pos, event_type AS command FROM events
        UNION ALL SELECT o_orderkey + (SELECT max(event_id) FROM events) + 1, o_orderpriority FROM orders)
    SELECT _pos, command FROM two ORDER BY _pos DESC LIMIT 10000"""
)
def append_import_capped(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_pos"), F.col("o_orderpriority").alias("command"))
    return log(spark, sf_dir).append_import(eventlog.EventLog(orders)).df.select("_pos", "command")


@query("SELECT event_id AS _pos, event_type AS command, CAST(7.5 AS DOUBLE) AS timestamp FROM events ORDER BY event_id DESC LIMIT 1000")
def replace_import(spark, sf_dir):
    """An import that replaces the log: the times are new."""
    kept = LogStore(spark, new_path(spark, "replaced-log"), "_pos bigint, command string, timestamp double")
    kept.replace_import(log(spark, sf_dir).df.select("_pos", "command", "timestamp"), 7.5)
    return kept.refresh()


@query(
    f"""SELECT 'x' AS python, string_agg(concat(_pos, ':', command), ',' ORDER BY _pos) AS entries
    FROM (SELECT * FROM ({LOG}) ORDER BY _pos DESC LIMIT 20)"""
)
def wrapped_entries(spark, sf_dir):
    view = eventlog.wrapped(log(spark, sf_dir).tail(20).df.select("_pos", "command"), {"python": "x"})
    return view.select("python", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["_pos"], e["command"])), ",").alias("entries"))


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name LIMIT 7")
def limited_listing(spark, sf_dir):
    return eventlog.limited(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "7", "n_name")


@query(
    """SELECT event_id, line, segment FROM (
        SELECT event_id, 0 AS line, 0 AS at, concat('run ', event_type) AS segment FROM events WHERE event_id % 3 = 0
        UNION ALL SELECT event_id, 0, 1, concat('say "', event_id, '; # x"') FROM events WHERE event_id % 3 = 0
        UNION ALL SELECT event_id, 2, 0, 'last' FROM events)"""
)
def segments_with_comments(spark, sf_dir):
    """Lines with comments, empty parts, quoted separators and a leading separator."""
    first = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" run "), "event_type", F.lit(';; # note ; say "'), "event_id", F.lit('; # x"'))).otherwise(F.lit("  # all of it; a comment"))
    text = F.concat(first, F.lit("\n;no command\r\n\tlast ;\n\n"))
    found = lines.segments(table(spark, sf_dir, "events").withColumn("text", text), "text", "event_id")
    return found.select("event_id", F.col("line").cast("int"), "segment")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name, c_custkey % 2 = 0 AS overlap, CASE c_custkey % 4 WHEN 0 THEN 'healthy' WHEN 1 THEN 'degraded' ELSE 'unhealthy' END AS state FROM customer")
def names_flags_states(spark, sf_dir):
    n = F.col("c_custkey")
    raw = F.when(n % 3 == 0, F.when(n % 2 == 0, " \t").otherwise(F.repeat(F.lit("x"), 101))).otherwise(F.concat(F.lit("\t "), "c_name", F.lit("\n")))
    flags = F.array(F.lit("-q"), F.when(n % 2 == 0, "-f").otherwise("-v"))
    told = F.when(n % 4 == 0, "Healthy").when(n % 4 == 1, "DEGRADED").when(n % 4 == 2, "down")
    return table(spark, sf_dir, "customer").select(
        n, T.item_name(raw).alias("name"), P.flags_overlap(flags, F.array(F.lit("-f"), F.lit("-x"))).alias("overlap"), P.health_of(told).alias("state")
    )


@query("SELECT c_custkey, c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AS is_key, c_custkey % 2 = 0 AS same_name, c_custkey % 3 = 0 AS same_composed FROM customer")
def names_and_keys(spark, sf_dir):
    n, name = F.col("c_custkey"), F.col("c_name")
    key = F.when(n % 5 == 0, F.concat(name, F.lit("\x07"))).when(n % 7 == 0, F.concat(name, F.lit(" b"))).otherwise(F.concat(name, F.lit("é")))
    other = F.when(n % 2 == 0, F.upper(name)).otherwise(F.concat(name, F.lit("x")))
    composed = F.when(n % 3 == 0, F.lit("é")).otherwise(F.lit("e"))
    return table(spark, sf_dir, "customer").select(
        n, P.is_memory_key(key).alias("is_key"), P.same_name(name, other).alias("same_name"), P.same_composed(F.lit("é"), composed).alias("same_composed")
    )


@query(r"""SELECT event_id, concat('a"b', chr(10), chr(9), 'é', event_type) AS plain FROM events""")
def fn_unescape_escapes(spark, sf_dir):
    coded = F.concat(F.lit(r"a\"b\n\t\xe9"), "event_type")
    return table(spark, sf_dir, "events").select("event_id", T.unescape(coded).alias("plain"))


@query(
    """WITH left_ AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS description FROM customer WHERE c_custkey <> (SELECT max(c_custkey) FROM customer))
    SELECT * FROM left_ UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY r_name), r_name, NULL FROM region"""
)
def items_insert_after_delete(spark, sf_dir):
    """The id of the deleted last row isn't given out again."""
    items = customers(spark, sf_dir)
    last = items.agg(F.max("id")).first()[0]
    left = collection.delete(items, spark.createDataFrame([(last,)], "id bigint"))
    return collection.insert(left, table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("description")), last)


@query("SELECT lower(r_name) AS key, concat('v', r_regionkey) AS value FROM region")
def scan_environment(spark, sf_dir):
    names = {f"APP_{r.r_name}": f"v{r.r_regionkey}" for r in table(spark, sf_dir, "region").limit(100).collect()}  # a table of fixed size
    return records.read_environment(spark, names | {"OTHER": "x"}, "APP_")


@query("SELECT row_number() OVER (ORDER BY r_regionkey) AS id, r_name AS name, 'd' AS description FROM region")
def scan_items(spark, sf_dir):
    names = [(r.r_name, "d") for r in table(spark, sf_dir, "region").orderBy("r_regionkey").limit(100).collect()]  # a table of fixed size
    return records.items(spark, names)


@query("SELECT n_name AS name, n_regionkey AS region FROM nation")
def scan_yaml(spark, sf_dir):
    """A YAML file of a mapping of lists."""
    doc = table(spark, sf_dir, "nation").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- name: "), "n_name", F.lit("\n  region: "), "n_regionkey"))), "\n").alias("value"))
    path = _as_file(doc.select(F.concat(F.lit("nations:\n"), "value").alias("value")), "yaml")
    rows = records.read_yaml(spark, path).select(F.explode(F.expr("variant_get(parsed, '$.nations', 'array<struct<name:string,region:int>>')")).alias("x"))
    return rows.select("x.name", "x.region")


@query("SELECT lower(n_name) AS key FROM nation")
def kv_keys_in_any_case(spark, sf_dir):
    return keyvalue.listed(table(spark, sf_dir, "nation").select(F.lower("n_name").alias("key")), ignore_case=True)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_regionkey = 0 THEN 'None' ELSE CAST(n_regionkey AS VARCHAR) END AS value FROM nation")
def kv_replaced(spark, sf_dir):
    pairs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.when(F.col("n_regionkey") != 0, F.col("n_regionkey")).alias("value"))
    return keyvalue.replaced(pairs)
