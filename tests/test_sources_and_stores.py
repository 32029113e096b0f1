import json

import pytest
from pyspark.sql import functions as F

from lodestream.functions import predicates as P
from lodestream.functions import text as T
from lodestream.operators import collection, keyvalue, lines
from lodestream.operators.eventlog import EventLog, command_view, service_view
from lodestream.operators.registry import FunctionRegistry, choices
from lodestream.plans.stores import LogStore, VersionedStore
from lodestream.sources import records, sinks


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def log(spark, rows):
    return EventLog(spark.createDataFrame(rows, "_pos bigint, command string, timestamp double"))


# --- readers


def test_log_keeps_objects_and_unknown_fields(spark, tmp_path):
    entries = [{"command": "café ☕", "timestamp": 2.5, "extra": {"a": 1}}, 7, "text", {"timestamp": 1}, {"command": None}, [1]]
    got = records.read_log(spark, put(tmp_path / "h.json", json.dumps(entries))).orderBy("_pos").collect()
    assert [(r._pos, r.command, r.timestamp) for r in got] == [(0, "cafe ", 2.5), (3, "", 1.0), (4, "None", None)]
    assert json.loads(got[0]._raw.toJson())["extra"] == {"a": 1}


@pytest.mark.parametrize("text", ["", "  \n", "[]"])
def test_missing_and_empty_logs_are_empty(spark, tmp_path, text):
    assert records.read_log(spark, put(tmp_path / "h.json", text)).count() == 0
    assert records.read_log(spark, str(tmp_path / "none.json")).count() == 0


@pytest.mark.parametrize("text", ['{"a": 1}', "[{]", "\x00\x00", "12"])
def test_what_is_no_array_raises_or_is_empty(spark, tmp_path, text):
    path = put(tmp_path / "h.json", text)
    with pytest.raises(Exception, match="not a JSON array"):
        records.read_log(spark, path).collect()
    assert records.read_log(spark, path, strict=False).count() == 0


def test_imports_fill_what_is_missing(spark, tmp_path):
    path = put(tmp_path / "i.json", json.dumps([{"command": "a"}, {"command": "b", "timestamp": 5}, {"cmd": "old"}, {"command": "", "cmd": "older"}, {"x": 1}]))
    got = records.read_import(spark, path, now=99.0).orderBy("_pos").collect()
    assert [r.timestamp for r in got] == [99.0, 5.0, 99.0, 99.0, 99.0]
    legacy = records.read_legacy_import(spark, path).orderBy("_pos").collect()
    assert [(r.command, r.success, r.return_code, r.duration_ms, r.params) for r in legacy] == [(c, True, 0, 0.0, []) for c in ("a", "b", "old", "older")]


def test_dotenv(spark, tmp_path):
    text = '# note\n\nAPP_A=1\nAPP_B="two words"\nAPP_a=3\nC=x=y\nAPP_D=line\\nfeed\n'
    got = {r.key: r.value for r in records.read_dotenv(spark, put(tmp_path / ".env", text), "APP_").collect()}
    assert got == {"a": "3", "b": "two words", "c": "x=y", "d": "line\nfeed"}
    for bad in ("A=1\nnonsense\n", "A=é\n"):
        with pytest.raises(Exception, match="line [12]"):
            records.read_dotenv(spark, put(tmp_path / "bad.env", bad)).collect()


def test_memory_files(spark, tmp_path):
    path = put(tmp_path / "m.json", json.dumps({"b": [1, 2], "a": "x", "c": {"d": None}}))
    got = {r.key: json.loads(r.value.toJson()) for r in records.read_memory(spark, path).collect()}
    assert got == {"a": "x", "b": [1, 2], "c": {"d": None}}
    assert records.read_memory(spark, put(tmp_path / "bad.json", "{")).count() == 0
    with pytest.raises(Exception, match="not a JSON object"):
        records.read_memory(spark, put(tmp_path / "list.json", "[1]")).collect()


def test_other_readers(spark, tmp_path):
    env = records.read_environment(spark, {"APP_X": "1", "OTHER": "2"}, "APP_").collect()
    assert [(r.key, r.value) for r in env] == [("x", "1")]
    for name in ("one", "two"):
        (tmp_path / "plugins" / name).mkdir(parents=True)
        put(tmp_path / "plugins" / name / "plugin.py", "x = 1")
    (tmp_path / "plugins" / "empty").mkdir()
    assert [r.name for r in records.plugin_directories(spark, str(tmp_path / "plugins")).collect()] == ["one", "two"]
    whole = put(tmp_path / "plugin.json", '{"name": "p", "desc": "d", "version": "1.0.0"}')
    assert records.read_plugins(spark, whole).first().version == "1.0.0"
    with pytest.raises(Exception, match="missing"):
        records.read_plugins(spark, put(tmp_path / "part.json", '{"name": "p"}')).collect()
    yaml = records.read_yaml(spark, put(tmp_path / "c.yaml", "a: [1, two]\nb:\n  c: null\n"))
    assert json.loads(yaml.first().parsed.toJson()) == {"a": [1, "two"], "b": {"c": None}}
    assert json.loads(records.read_yaml(spark, put(tmp_path / "d.yaml", "# nothing\n")).first().parsed.toJson()) == {}
    spec = put(tmp_path / "spec.json", '{"commands": ["x", "y"]}')
    assert sorted(r.command for r in records.known_commands(spark, spec, ["z"]).collect()) == ["x", "y"]
    assert [r.command for r in records.known_commands(spark, str(tmp_path / "no.json"), ["z"]).collect()] == ["z"]
    assert [(r.id, r.name) for r in records.items(spark, [("a", None), ("b", "text")]).collect()] == [(1, "a"), (2, "b")]


# --- the log


def test_limits_of_the_log(spark):
    rows = log(spark, [(i, f"c{i % 3}", float(10 - i)) for i in range(30)])
    assert service_view(rows, limit=0).count() == 0
    assert [r._pos for r in service_view(rows, limit=3).collect()] == [27, 28, 29]
    assert service_view(rows, limit=None).count() == service_view(rows, limit=-1).count() == 30
    assert [r._pos for r in service_view(rows, limit=2, sort="timestamp").collect()] == [1, 0]
    assert service_view(rows, limit=5, needle="C1").count() == 0
    assert command_view(rows, limit=50).count() == 20
    with pytest.raises(ValueError):
        command_view(rows, limit=-1)
    with pytest.raises(ValueError):
        command_view(rows, sort="command")


def test_ties_keep_arrival_order_and_missing_times_are_zero(spark):
    rows = log(spark, [(0, "a", 5.0), (1, "b", None), (2, "c", 5.0), (3, "d", 0.0)])
    assert [r._pos for r in rows.sort("timestamp").rows().collect()] == [1, 3, 0, 2]
    assert [r._pos for r in rows.sort("command").rows().collect()] == [0, 1, 2, 3]


def test_groups(spark):
    rows = log(spark, [(0, "b", 1.0), (1, "a", 3.0), (2, "b", None), (3, None, 2.0)])
    got = rows.summary(limit=2).collect()
    assert [(r.group, r["count"], r.last_run) for r in got] == [("b", 2, 1.0), ("a", 1, 3.0)]
    nested = {r.group: [e._pos for e in r.entries] for r in rows.grouped_entries().collect()}
    assert nested == {"b": [0, 2], "a": [1], "": [3]}
    assert [r.group for r in rows.grouped_entries(1).collect()] == [""]
    plan = rows.summary()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2


# --- stores and sinks


def test_versioned_store(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/kv", "key string, value string")
    assert store.read().count() == 0
    store.write(spark.createDataFrame([("a", "1"), ("b", "2")], store.schema))
    reader = store.read()
    store.change(lambda df: keyvalue.upsert(df, spark.createDataFrame([("b", "3"), ("c", "4")], store.schema)))
    store.change(lambda df: keyvalue.delete(df, spark.createDataFrame([("a",)], "key string")))
    assert {r.key: r.value for r in store.read().collect()} == {"b": "3", "c": "4"}
    assert {r.key: r.value for r in reader.collect()} == {"a": "1", "b": "2"}
    assert store.clear() == 4 and store.read().count() == 0


def test_log_store_keeps_the_last_rows(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/log", "_pos bigint, command string, timestamp double", kept=5)
    for k in range(3):
        store.append(spark.createDataFrame([(i, f"run{k}-{i}", 0.0) for i in range(3)], store.schema))
    got = [r.command for r in store.read().orderBy("_pos").collect()]
    assert got == ["run1-1", "run1-2", "run2-0", "run2-1", "run2-2"]
    store.replace(spark.createDataFrame([(0, "x", 0.0)], store.schema))
    assert store.read().count() == 1


def test_exports_and_round_trip(spark, tmp_path):
    store = spark.createDataFrame([("b", 'say "hi"\n\\'), ("a", "1")], "key string, value string")
    text = "\n".join(r.value for r in sinks.dotenv_lines(store, "APP_").collect())
    back = {r.key: r.value for r in records.read_dotenv(spark, put(tmp_path / "e.env", text + "\n"), "APP_").collect()}
    assert back == {"a": "1", "b": 'say "hi"\n\\'}
    for kind in ("env", "yaml", "json"):
        sinks.export(store, str(tmp_path / kind), kind, "APP_")
    read = "\n".join(r.value for r in spark.read.text(str(tmp_path / "json")).collect())
    assert json.loads(read) == {"A": "1", "B": 'say "hi"\n\\'}
    import yaml

    assert yaml.safe_load("\n".join(r.value for r in spark.read.text(str(tmp_path / "yaml")).collect())) == {"A": "1", "B": 'say "hi"\n\\'}
    rows = spark.createDataFrame([(1, "x", None), (0, "y", 2)], "_pos bigint, command string, n int")
    array = sinks.as_json_array(rows).first().value
    assert json.loads(array) == [{"command": "y", "n": 2}, {"command": "x", "n": None}]
    assert json.loads(sinks.as_json_array(rows, pretty=True).first().value) == json.loads(array)
    sinks.write_all(rows, [str(tmp_path / "p1"), str(tmp_path / "p2")])
    assert spark.read.parquet(str(tmp_path / "p1")).count() == spark.read.parquet(str(tmp_path / "p2")).count() == 2
    sinks.discard(rows)


# --- collection, functions, registry


def test_collection(spark):
    items = records.items(spark, [("a", "1"), ("b", "2"), ("c", None), ("d", "4"), ("e", "5")])
    assert [(r.id, r.total) for r in collection.page(items, 1, 2).collect()] == [(2, 5), (3, 5)]
    with pytest.raises(ValueError):
        collection.page(items, 0, 101)
    with pytest.raises(KeyError):
        collection.lookup(items, 9)
    new = spark.createDataFrame([("z", "x"), ("a", "taken"), ("y", None), ("z", "again")], "name string, description string")
    added = collection.insert(items, new).where("id > 5").orderBy("id").collect()
    assert [(r.id, r.name, r.description) for r in added] == [(6, "y", None), (7, "z", "again")]


def test_text_functions_on_odd_values(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y

    x = F.col("x")
    assert one(T.ascii_clean("x"), "ﬁ Ａ² naïve ☕\t") == "fi A2 naive "
    assert one(T.ascii_safe(x), "a☕b\t") == "a?b\t"
    assert one(T.unescape("x"), "a\\tb\\x41") == "a\tbA"
    assert one(T.shell_split("x"), "a 'b c' d") == ["a", "b c", "d"] and one(T.shell_split("x"), "a 'b") is None
    assert one(T.split_unquoted(x), "a;'b;c';d") == ["a", "'b;c'", "d"]
    assert len(one(T.split_unquoted(x), "w;" + "y" * 50_000)) == 2
    assert one(T.strip_ansi(x), "\x1b[31mred\x1b[0m") == "red"
    assert one(T.shown(x), None) == "None"
    for bad in ("a\n", "a b", ""):
        assert not one(P.is_config_key(x), bad)
    assert one(P.is_version(x), "1.2.3") and not one(P.is_version(x), "1.2.3\n")
    assert not one(P.is_memory_key(x), "a b") and one(P.is_memory_key(x), "clé") and not one(P.is_memory_key(x), "k" * 5000)
    assert one(P.same_composed(x, F.lit("é")), "é")
    assert one(P.satisfies(">=1")(x), "junk") is False


def test_composition_gives_python_only_what_may_compose(spark):
    import unicodedata

    import pyarrow as pa

    odd = ["e\u0301", "\u0301", "é", "\u1112\u1161\u11ab", "\u212b", "\U0001d15e", "a\u0323\u0307\u0301", "ё е\u0308", "\u02ff", "日本", "", "plain \x00 text", None]
    texts = (odd * 20)[:-1] + [c + "\u0323\u0302" for c in map(chr, range(0x41, 0x250))]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", T.nfc("text").alias("composed"), T.nfc(F.col("text")).alias("again"))
    want = [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert [(r.composed, r.again) for r in rows.orderBy("n").collect()] == list(zip(want, want, strict=True))
    # null for what is composed already, in slices
    given = T._recomposed.func(pa.array(texts, pa.string())).to_pylist()
    assert given == [w if w != t else None for t, w in zip(texts, want, strict=True)]
    assert T._recomposed.func(pa.array([], pa.string())).to_pylist() == []
    assert not spark.createDataFrame([("ÿ \u02ff",)], "text string").where(F.col("text").rlike(T.COMPOSING)).count()


def test_segments(spark):
    df = spark.createDataFrame([(1, "a; b\n\x1b[1mc\x1b[0m ;'d;e'\r\n\n;")], "id int, text string")
    assert [r.segment for r in lines.segments(df, "text", "id").orderBy("line", "part").collect()] == ["a", "b", "c", "'d;e'"]


def test_registry(spark):
    registry = FunctionRegistry(spark)
    registry.register("twice", lambda x: x * 2, alias="double_it", return_type="bigint")
    assert spark.range(3).select(registry.call("double_it", F.col("id")).alias("y")).agg(F.sum("y")).first()[0] == 6
    with pytest.raises(ValueError):
        registry.register("twice", lambda x: x)
    assert [(r.name, r.alias) for r in registry.listing().collect()] == [("twice", "double_it")]
    registry.deregister("double_it")
    with pytest.raises(KeyError):
        registry.call("twice", F.col("id"))
    rows = spark.createDataFrame([("Alpha",), ("beta",), ("alpine",)], "v string")
    assert {r.v for r in choices(rows, "v", "al", case_sensitive=False).collect()} == {"Alpha", "alpine"}


def test_of_two_writers_of_a_version_one_wins(spark, tmp_path):
    from lodestream.plans.stores import VersionedStore

    store = VersionedStore(spark, f"file://{tmp_path}/raced", "id bigint")
    other = VersionedStore(spark, f"file://{tmp_path}/raced", "id bigint")
    mark = store._marked

    def late(number, folder):
        other.write(spark.range(2))  # between this writer's look and its marker
        return mark(number, folder)

    store._marked = late
    with pytest.raises(RuntimeError):
        store.write(spark.range(1))
    assert store.version() == 1 and store.read().count() == 2
    with pytest.raises(FileNotFoundError):
        VersionedStore(spark, f"file://{tmp_path}/never", "id bigint").refresh()


def test_updates_check_ids_and_names(spark):
    from lodestream.operators import collection, keyvalue

    items = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id bigint, name string, description string")
    for rows, error in (([(1, "b", "x")], ValueError), ([(3, "c", "x")], KeyError), ([(1, "c", "x"), (1, "d", "x")], ValueError)):
        with pytest.raises(error):
            collection.update(items, spark.createDataFrame(rows, items.schema))
    got = collection.update(items, spark.createDataFrame([(1, "a", "x"), (2, "c", "y")], items.schema))
    assert sorted(map(tuple, got.collect())) == [(1, "a", "x"), (2, "c", "y")]
    with pytest.raises(KeyError):
        keyvalue.delete(items.selectExpr("name AS key", "description AS value"), spark.createDataFrame([("z",)], "key string"), strict=True)


def test_malformed_escapes_raise_with_their_line_and_tabs_are_space(spark):
    from lodestream.sources import records

    lines = spark.createDataFrame([(0, "\t# note"), (1, "\tA =1\t")], "_pos bigint, value string")
    assert [tuple(r) for r in records.dotenv(lines).collect()] == [("a", "1")]
    with pytest.raises(Exception, match="line 3"):
        records.dotenv(spark.createDataFrame([(2, "B=\\x")], "_pos bigint, value string")).collect()


def test_separators_and_quotes_in_one_pass(spark):
    from pyspark.sql import functions as F

    from lodestream.functions.text import split_unquoted

    cases = {"a;b": ["a", "b"], "a;'b;c';d": ["a", "'b;c'", "d"], "a;\"b'\";c'd;e'": ["a", "\"b'\"", "c'd;e'"], "a;b \"c": ['a;b "c'], 'a "b;c': ['a "b', "c"], "": [""], ";": ["", ""]}
    df = spark.createDataFrame([(k,) for k in cases] + [("x;'y';" * 20000,)], "t string")
    got = {r.t: r.p for r in df.select("t", split_unquoted(F.col("t")).alias("p")).collect()}
    assert {k: got[k] for k in cases} == cases and len(got["x;'y';" * 20000]) == 40001


def test_groups_of_functions_and_emitted_rows(spark, tmp_path, capsys):
    from pyspark.sql import functions as F

    from lodestream.operators.registry import FunctionRegistry
    from lodestream.sources import sinks

    names = FunctionRegistry(spark)

    @names.group("lode", version="1")("twice", "bigint")
    def twice(n):
        return 2 * n

    df = spark.range(3).select(names.call("lode_twice", F.col("id")).alias("n"))
    assert [r.n for r in df.collect()] == [0, 2, 4] and names.groups == {("lode", "1"): ["twice"]}
    sinks.emit(df.orderBy("n"))
    sinks.emit(df, quiet=True)
    assert capsys.readouterr().out.split() == ['{"n":0}', '{"n":2}', '{"n":4}']
    sinks.emit(df, f"{tmp_path}/emitted")
    assert spark.read.json(f"{tmp_path}/emitted").count() == 3
