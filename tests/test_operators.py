"""Small golden cases of expressions, routes, windows, codecs and streams."""

import datetime as dt
import math
import random
import re
import time
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import FUNCTIONS, SchemaError, array, call, case, cast, field, if_, lit, null, of_table, udf
from millrace.functions import types as T
from millrace.operators import nodes, stateful, windows
from millrace.operators.route import Field, Route, altered, apply, schema
from millrace.operators.windows import Aggregate
from millrace.plans import catalogue
from millrace.sources import codecs, connectors
from millrace.streaming import nodes as streams


def value(spark, e):
    return spark.range(1).select(e.value.alias("v"), e.errors().alias("e")).collect()[0]


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: call("initcap", lit("  hello.world  ")), "  Hello.World  "),
        (lambda: call("lpad", lit("he"), lit(7), lit("xy")), "xyxyxhe"),
        (lambda: call("rpad", lit("he"), lit(7), lit("xy")), "hexyxyx"),
        (lambda: call("md5", lit("he")), "6f96cfdfe5ccc627cadf24b41725caa4"),
        (lambda: call("to_hex", lit(255)), "ff"),
        (lambda: call("to_hex", lit(-1, "I8")), "ff"),
        (lambda: call("replace", lit("ab"), lit(""), lit("-")), "-a-b-"),
        (lambda: call("split_part", lit("ab"), lit(""), lit(1)), "ab"),
        (lambda: call("left", lit("abc"), lit(-5)), ""),
        (lambda: call("lower", lit("ÀB")), "Àb"),
        (lambda: lit(7) / lit(2), 3),
        (lambda: lit(-7) / lit(2), -3),
        (lambda: lit(-7) % lit(3), -1),
        (lambda: call("ceil", lit(-1.75)), -1.0),
        (lambda: call("floor", lit(-1.75)), -2.0),
        (lambda: call("round", lit(1.6)), 2.0),
        (lambda: call("round", lit(-0.5)), -1.0),
        (lambda: cast(lit(1.0), "STRING"), "1"),
        (lambda: cast(lit("42"), "I64"), 42),
        (lambda: cast(lit(-1.9), "I64"), -1),
        (lambda: case((null("BOOL"), lit(1)), (lit(True), lit(2))), 2),
        (lambda: call("concat", null("STRING"), lit("x")), "x"),
    ],
)
def test_values(spark, make, want):
    got = value(spark, make())
    assert got.v == want and got.e == []


@pytest.mark.parametrize(
    ("make", "code"),
    [
        (lambda: lit(1) / lit(0), "division_by_zero"),
        (lambda: lit(2**63 - 1) + lit(1), "overflow"),
        (lambda: lit(250, "U8") + lit(10, "U8"), "overflow"),
        (lambda: -lit(-128, "I8"), "overflow"),
        (lambda: call("abs", lit(-128, "I8")), "overflow"),
        (lambda: cast(lit("x"), "I64"), "cast_failed"),
        (lambda: cast(lit(" 12 "), "I64"), "cast_failed"),
        (lambda: cast(lit("2020-01-01"), "DATETIME"), "cast_failed"),
        (lambda: call("ln", lit(0)), "invalid_argument"),
        (lambda: call("sqrt", lit(-1)), "invalid_argument"),
    ],
)
def test_row_errors(spark, make, code):
    got = value(spark, make())
    assert got.v is None and [e.code for e in got.e] == [code]


def test_errors_of_arms_not_taken_do_not_count(spark):
    got = value(spark, if_(lit(True), lit(5), lit(1) / lit(0)))
    assert got.v == 5 and got.e == []


def test_types_are_exact():
    for make in (lambda: lit(1, "I32") + lit(1), lambda: lit(1).eq(lit("1")), lambda: call("lower", lit(1)), lambda: call("nope"), lambda: lit(True) < lit(False)):
        with pytest.raises(SchemaError):
            make()


def test_route_finalises_and_guards_sensitive_fields(spark):
    df = spark.createDataFrame([(1, "s")], "id long, secret string")
    message = of_table(df, {"secret"})
    with pytest.raises(SchemaError):
        apply(df, message, Route(schema(id="I64", secret="STRING"), inherit="all"))
    with pytest.raises(SchemaError):
        apply(df, message, Route(schema(id="I64", more="I64"), inherit=("id",)))
    out = apply(df, message, Route(schema(id="I64", secret="STRING", note="STRING?"), inherit=("id",), set=(("secret", lambda m: m["secret"].leak()),)))
    assert out.rows.collect() == [(1, "s", None)]


def test_schema_alterations_are_atomic():
    fields = schema(a="I64", b="STRING")
    assert list(altered(fields, ("rename", "a", "c"), ("drop", "b"), ("add", "d", Field("BOOL")))) == ["c", "d"]
    with pytest.raises(SchemaError):
        altered(fields, ("drop", "a"), ("drop", "b"))
    assert list(fields) == ["a", "b"]


@pytest.mark.parametrize(("high", "percent", "want"), [(100.0, 50, 25.0), (100.0, 90, 35.0), (100.0, 100, 35.0), (200.0, 50, 30.0)])
def test_histogram_percentile(spark, high, percent, want):
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate((30, 10, 20))], "tenant string, seq long, latency long")
    made = windows.by_messages(df, ["tenant"], ["seq"], 3, 3, {"p": Aggregate("percentile_linear_histogram", "latency", percent, 10, 0.0, high)})
    assert made.collect()[0].p == want


def test_deduplicate_does_not_refresh(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("k", i, at(s)) for i, s in enumerate((0, 6, 9, 10, 15, 25))], "id string, seq long, ts timestamp")
    assert sorted(r.seq for r in stateful.deduplicate(df, ["id"], "ts", "seq", 10).collect()) == [0, 3, 5]


def test_lookup_takes_the_later_entry_and_null_for_missing(spark):
    dim = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "k string, city string, n int")
    got = nodes.lookup(spark.createDataFrame([("a",), ("b",)], "id string"), dim, field("id", "STRING").value, "k", ["city"], order="n")
    assert sorted(got.collect(), key=str) == [("a", "new"), ("b", None)]


def test_json_strict_and_loose(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":1,"b":2}',), ('{"a":"1"}',), ('{"a":300}',), ("[1]",), ("{",), (None,)], "raw string")
    fields = schema(a="U8")
    strict, loose = (codecs.decode_json(df, "raw", fields, strict=s) for s in (True, False))
    assert (strict.rows.count(), strict.errors.count()) == (1, 6)
    assert (loose.rows.count(), loose.errors.count()) == (2, 5)


def test_xml(spark):
    df = spark.createDataFrame([("<row><a>1</a><s>x</s></row>",), ("<row><s>x</s></row>",)], "raw string")
    got = codecs.decode_xml(df, "raw", schema(a="I64", s="STRING?"))
    assert got.rows.select("a", "s").collect() == [(1, "x")] and got.errors.count() == 1


def test_headers(spark):
    df = connectors.write_header(connectors.write_header(spark.createDataFrame([("v",)], "value string"), "h", "value"), "h", "value")
    got = df.select(call("read_header", lit("h")).value.alias("one"), call("read_headers", lit("h")).value.alias("all")).collect()
    assert got == [("v", ["v", "v"])]


def test_udf_spares_nulls(spark):
    double = udf("double", lambda x: x.astype("int64") * 2, ("I64",), "I64")
    df = spark.createDataFrame([(1,), (None,)], "x long")
    assert sorted(r[0] or 0 for r in df.select(double(field("x", "I64")).value).collect()) == [0, 2]


def streamed(spark, tmp_path, df, make, parts=3):
    """All rows that a streaming node puts out over df, written in several files in an order of its own; a last row of another branch, years later, lets the watermark pass."""
    streams.configure(spark)
    rows = df.collect()
    random.Random(5).shuffle(rows)
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = []
    query = streams.emit(make(stream), lambda b, _: got.extend(b.collect()), str(tmp_path / "check")).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return got


LAST = dt.datetime(2030, 1, 1)


def stamped(spark, times):
    rows = [("k", i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for i, s in enumerate(times)] + [("end", 10**6, LAST)]
    return spark.createDataFrame(rows, "id string, seq long, ts timestamp")


def test_streamed_deduplication(spark, tmp_path):
    df = stamped(spark, (0, 6, 9, 10, 15, 25))
    got = streamed(spark, tmp_path, df, lambda s: streams.deduplicate(s, ["id"], "ts", "seq", 10))
    assert sorted(r.seq for r in got if r.id == "k") == [0, 3, 5]


def test_streamed_reordering(spark, tmp_path):
    df = stamped(spark, (5, 3, 9, 1, 1))
    got = streamed(spark, tmp_path, df, lambda s: streams.reorder(s, ["id"], "ts", "seq", "1 hour"))
    assert [r.seq for r in got if r.id == "k"] == [3, 4, 1, 0, 2]


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    df = stamped(spark, (0, 1, 2, 8, 9, 30, 31, 55))
    make = lambda rows, now, _: {"ids": [r["seq"] for r in rows], "closed": int(now.timestamp())}
    how = {"width_seconds": 10, "step_seconds": 5, "messages": 3, "step_messages": 2}
    schema = "ids array<long>, closed long"
    got = streamed(spark, tmp_path, df, lambda s: streams.anchored_windows(s, ["id"], "ts", "seq", schema, make, "1 hour", **how))
    want = stateful.anchored_windows(df.filter("id = 'k'"), ["id"], "ts", "seq", schema, make, **how).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 4


def test_streamed_correlation_equals_the_batch(spark, tmp_path):
    df = stamped(spark, (0, 1, 2, 3, 20, 21, 50, 52, 90))
    make = lambda a, b: {"l": a["l"], "r": b["r"]}
    late = lambda side, row: {"l": row["l"], "r": row["r"]}
    left = lambda d: d.filter("seq % 3 = 0 OR id = 'end'").withColumn("l", F.col("seq"))
    right = lambda d: d.filter("seq % 3 <> 0 AND id <> 'end'").withColumn("r", F.col("seq"))
    got = streamed(spark, tmp_path, df, lambda s: streams.correlate(left(s), right(s), ["id"], "ts", "seq", "l long, r long", make, "1 hour", 10, timed_out=late))
    want = stateful.correlate(left(df), right(df), ["id"], "ts", "seq", "l long, r long", make, horizon_seconds=10, timed_out=late).filter("l IS NULL OR l < 1000000").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) >= 5


def test_streamed_guest_ends_after_its_time_to_live(spark, tmp_path):
    class Count:
        def __init__(self):
            self.n = 0

        def see(self, row):
            self.n += 1
            return iter(())

        def end(self):
            yield {"n": self.n}

    got = streamed(spark, tmp_path, stamped(spark, (0, 1, 2, 100, 101)), lambda s: streams.guest(s, ["id"], "ts", "seq", Count, "n long", "1 hour", 10))
    assert sorted(r.n for r in got) == [2, 3]


def test_streamed_latest_state(spark, tmp_path):
    rows = [("a", 1, 10), ("b", 2, 20), ("a", 3, 30), ("b", 4, 15)]
    df = spark.createDataFrame([*[(b, s, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)) for b, s, t in rows], ("end", 9, LAST)], "branch string, seq long, ts timestamp")
    streams.configure(spark)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = streams.emit(streams.latest(stream, ["branch"], "ts", "seq"), lambda b, n: streams.keep(b, n, str(tmp_path / "out")), str(tmp_path / "check")).start()
    query.awaitTermination(120)
    assert query.exception() is None
    newest = streams.snapshot(spark, str(tmp_path / "out"), ["branch"], "ts").collect()
    assert sorted((r.branch, r.seq) for r in newest if r.branch != "end") == [("a", 3), ("b", 2)]


# ---- row errors never end a job


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: call("log", lit(1), lit(5)), "invalid_argument"),
        (lambda: call("left", lit("abc"), lit(2**40)), "abc"),
        (lambda: call("left", lit("abc"), lit(-(2**40))), ""),
        (lambda: call("right", lit("abc"), lit(2**62)), "abc"),
        (lambda: call("substr", lit("abc"), lit(2**40)), ""),
        (lambda: call("substr", lit("abc"), lit(-(2**40)), lit(2**40)), "abc"),
        (lambda: call("lpad", lit("abc"), lit(2**40), lit("x")), "invalid_argument"),
        (lambda: call("rpad", lit("abc"), lit(2**40), lit("")), "abc"),
        (lambda: call("repeat", lit("abc"), lit(2**40)), "invalid_argument"),
        (lambda: call("repeat", lit("abc"), lit(-(2**40))), ""),
        (lambda: call("split_part", lit("a-b"), lit("-"), lit(2**40)), ""),
        (lambda: call("nth", array(lit(1), lit(2)), lit(2**40)), None),
        (lambda: call("regexp_like", lit("abc"), lit("a(")), "invalid_argument"),
        (lambda: call("regexp_substr", lit("abc"), lit("[")), "invalid_argument"),
        (lambda: call("regexp_replace", lit("abc"), lit("(b)"), lit("<$1$9$$\\>")), "a<b$\\>c"),
        (lambda: call("regexp_replace", lit("abc"), lit("(?<x>b)"), lit("${x}${y}1")), "ab1c"),
        (lambda: call("regexp_replace", lit("abc"), lit("(b)"), lit("${1}2")), "ab2c"),
        (lambda: call("regexp_replace", lit("abc"), lit("("), lit("x")), "invalid_argument"),
        (lambda: call("regexp_replace", lit("abc"), lit("b"), field("dollar", "STRING")), "invalid_argument"),
        (lambda: call("regexp_replace", lit("abc"), lit("b"), field("slash", "STRING")), "a\\c"),
        (lambda: call("regexp_like", lit("abc"), field("open", "STRING")), "invalid_argument"),
        (lambda: call("regexp_like", lit("a$x"), field("dollar", "STRING")), False),
        (lambda: cast(lit(1e30), "STRING"), "1" + "0" * 30),
        (lambda: cast(lit(-1.25e-14), "STRING"), "-0.0000000000000125"),
        (lambda: cast(lit(1234567.5), "STRING"), "1234567.5"),
        (lambda: cast(lit(12345678.25), "STRING"), "12345678.25"),
        (lambda: cast(lit(0.0001), "STRING"), "0.0001"),
        (lambda: cast(lit(0.1, "F32"), "STRING"), "0.1"),
        (lambda: cast(lit(1e30), "I64"), "cast_failed"),
        (lambda: cast(lit(-(2.0**63)), "I64"), -(2**63)),
        (lambda: cast(lit("0x1p3"), "F64"), "cast_failed"),
        (lambda: cast(lit("1e400"), "F64"), "cast_failed"),
        (lambda: lit(2**64 - 1, "U64") / lit(3, "U64"), (2**64 - 1) // 3),
        (lambda: lit(2**64 - 1, "U64") + lit(1, "U64"), "overflow"),
        (lambda: lit(-(2**63)) / lit(-1), "overflow"),
        (lambda: lit(1.0) / lit(0.0), "invalid_argument"),
    ],
)
def test_extreme_arguments(spark, make, want):
    df = spark.createDataFrame([("$x", "\\", "(")], "dollar string, slash string, open string")
    e = make()
    got = df.select(e.value.alias("v"), e.errors().alias("e")).collect()[0]
    if want in {"invalid_argument", "cast_failed", "overflow"}:
        assert got.v is None and [x.code for x in got.e] == [want]
    else:
        assert got.v == want and got.e == []


EXTREMES = {
    "STRING": ["", " ", "a", "ÀÉ\u2003", "(", "$1", "\\", "x" * 3000, "-1", "1e999", "nan", "\0", "2024-01-01T00:00:00Z", None],
    "F64": [0.0, -0.0, 1.0, -1.5, 1e308, -1e308, 5e-324, 2.0**63, math.nan, math.inf, -math.inf, None],
    "I64": [0, 1, -1, 2, 2**31, -(2**31) - 1, 2**40, 2**63 - 1, -(2**63), None],
    "I8": [0, 1, -1, 127, -128, None],
    "BOOL": [True, False, None],
}


def test_no_function_fails_a_job(spark):
    """Every function over rows of extreme values, by all types that it takes."""
    chance = random.Random(3)
    rows = [tuple(chance.choice(EXTREMES[k]) for k in EXTREMES for _ in range(3)) for _ in range(250)]
    names = {k: [f"{k}_{n}" for n in range(3)] for k in EXTREMES}
    df = spark.createDataFrame(rows, ", ".join(f"{n} {T.spark(k)}" for k in EXTREMES for n in names[k])).cache()
    made = []
    for name, f in FUNCTIONS.items():
        if name.startswith("udf::") or name in {"read_header", "read_headers"}:
            continue
        for kinds in [(), *[(a,) for a in EXTREMES], *[(a, b) for a in EXTREMES for b in EXTREMES], *[("STRING", a, b) for a in EXTREMES for b in EXTREMES]]:
            try:
                made.append(f(*[field(names[k][n], k) for n, k in enumerate(kinds)]))
            except (SchemaError, TypeError):
                continue
    for a in EXTREMES:
        made += [cast(field(names[a][0], a), b) for b in (*T.SPARK,) if (a, b) not in {("STRING", a), ("BOOL", "DATETIME"), ("F64", "DATETIME")}]
        if a in T.NUMBERS:
            x, y = (field(n, a) for n in names[a][:2])
            made += [x + y, x - y, x * y, x / y, x % y, -x, (x + y) * x - y]
    assert len(made) > 100
    for at in range(0, len(made), 25):
        some = made[at : at + 25]
        df.select(*[e.value.alias(f"v{k}") for k, e in enumerate(some)], *[e.errors().alias(f"e{k}") for k, e in enumerate(some)]).write.format("noop").mode("overwrite").save()


def test_user_functions_that_raise_are_row_errors(spark):
    half = udf("half", lambda x: x.map(lambda v: v // 2 if v % 2 == 0 else 1 / 0), ("I64",), "I64")
    df = spark.createDataFrame([(k,) for k in range(6)], "x long")
    e = half(field("x", "I64"))
    got = {r.x: (r.v, len(r.e)) for r in df.select("x", e.value.alias("v"), e.errors().alias("e")).collect()}
    assert got == {0: (0, 0), 1: (None, 1), 2: (1, 0), 3: (None, 1), 4: (2, 0), 5: (None, 1)}


# ---- machines


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def sides(spark, n, seed=0):
    chance = random.Random(seed)
    rows = [(chance.randrange(4), at(k // 3), 2**53 + 1 + k, chance.random() < 0.5) for k in range(n)]
    df = spark.createDataFrame(rows, "b long, ts timestamp, seq long, is_left boolean")
    return df.filter("is_left").select("b", "ts", "seq", F.col("seq").alias("left_id")), df.filter("NOT is_left").select("b", "ts", "seq", F.col("seq").alias("right_id"))


@pytest.mark.parametrize("match", ["earliest", "latest"])
def test_counted_correlation_equals_the_machine(spark, match):
    make = lambda a, b: {"left_id": a["left_id"], "right_id": b["right_id"]}
    late = lambda side, row: {"left_id": row["left_id"], "right_id": row["right_id"]}
    run = lambda native: sorted(map(str, stateful.correlate(*sides(spark, 400), ["b"], "ts", "seq", "left_id long, right_id long", make, match=match, timed_out=late, native=native).collect()))
    assert run(True) == run(False) and len(run(True)) > 200


def test_machines_keep_64_bit_values(spark):
    left, right = sides(spark, 100)
    make = lambda a, b: {"left_id": a["left_id"], "right_id": b["right_id"]}
    got = stateful.correlate(left, right, ["b"], "ts", "seq", "left_id long, right_id long", make, matches=lambda a, b: a["right_id"] is None).collect()
    ids = {r.left_id for r in left.collect()}
    assert got and {r.left_id for r in got} <= ids and any(r.left_id % 2 for r in got)


def test_many_waiting_rows_take_linear_time(spark):
    left = spark.range(60_000).select(F.lit(1).alias("b"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"), F.col("id").alias("left_id"))
    right = spark.range(60_000).select(F.lit(1).alias("b"), F.timestamp_seconds(F.col("id") + 100_000).alias("ts"), (F.col("id") + 100_000).alias("seq"), F.col("id").alias("right_id"))
    start = time.time()
    got = stateful.correlate(left, right, ["b"], "ts", "seq", "left_id long, right_id long", lambda a, b: {"left_id": a["left_id"], "right_id": b["right_id"]}, native=False)
    assert got.filter("left_id = right_id").count() == 60_000 and time.time() - start < 60


def windowed(rows, **how):
    """Literal simulation of windows with both kinds of bounds."""
    out, buf, start, i = [], [], None, 0
    w, s, m, sm = how.get("width_seconds"), how.get("step_seconds"), how.get("messages"), how.get("step_messages")
    while True:
        if m and len(buf) >= m:
            out.append([x for x, _ in buf])
            cut = sm if sm is not None else max(1, sum(t < start + s for _, t in buf))
            start = start + s if sm is None else None
            buf = buf[cut:]
            start = (buf[0][1] if start is None else start) if buf else None
        elif w and buf and (i == len(rows) or rows[i][1] >= start + w):
            out.append([x for x, _ in buf])
            if s is not None:
                start += s
                buf = [b for b in buf if b[1] >= start]
            else:
                buf = buf[sm:]
                start = buf[0][1] if buf else None
            start = start if buf else None
        elif i < len(rows):
            start = rows[i][1] if not buf else start
            buf.append(rows[i])
            i += 1
        else:
            return out


@pytest.mark.parametrize(
    "how",
    [
        {"width_seconds": 10, "step_seconds": 10}, {"width_seconds": 10, "step_seconds": 3}, {"messages": 3, "step_messages": 1}, {"messages": 3, "step_messages": 3},
        {"width_seconds": 10, "step_seconds": 5, "messages": 3, "step_messages": 2}, {"width_seconds": 10, "messages": 3, "step_messages": 1}, {"width_seconds": 10, "step_seconds": 4, "messages": 3},
    ],
)
def test_windows_equal_a_simulation(spark, how):
    chance = random.Random(7)
    times = sorted(chance.randrange(100) for _ in range(40))
    df = spark.createDataFrame([("b", k, at(t)) for k, t in enumerate(times)], "b string, seq long, ts timestamp")
    got = stateful.anchored_windows(df, ["b"], "ts", "seq", "ids array<long>", lambda rows, *_: {"ids": [r["seq"] for r in rows]}, **how)
    assert sorted(r.ids for r in got.collect()) == sorted(windowed(list(enumerate(times)), **how))


def test_windows_check_their_bounds(spark):
    df = spark.createDataFrame([("b", 1, at(0))], "b string, seq long, ts timestamp")
    for how in ({"messages": 3}, {"messages": 3, "step_messages": 4}, {"messages": 3, "step_seconds": 1}, {"width_seconds": 3, "step_seconds": 0}):
        with pytest.raises(SchemaError):
            stateful.anchored_windows(df, ["b"], "ts", "seq", "n long", lambda rows, *_: {"n": len(rows)}, **how)
    with pytest.raises(SchemaError):
        windows.by_messages(df, ["b"], ["seq"], 1, 1, {"p": Aggregate("percentile_linear_histogram", "seq", delay_seconds=1)})


@pytest.mark.parametrize(("delay", "want"), [(0.0, [15.0, 95.0, 95.0]), (2.0, [15.0, 15.0, 95.0])])
def test_histogram_delay(spark, delay, want):
    df = spark.createDataFrame([("t", k, at(s), v) for k, (s, v) in enumerate(((0, 10), (1, 90), (2, 90), (4, 90)))], "b string, seq long, ts timestamp, v long")
    made = stateful.windows(df, ["b"], "ts", "seq", {"p0": Aggregate("percentile_linear_histogram", "v", 0, 10, 0.0, 100.0, delay_seconds=delay)}, messages=2, step_messages=1)
    assert [r.p0 for r in made.orderBy("closed_at").collect()] == want


def test_waiting_for_state_in_a_long_branch(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("b"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("row_id"))
    state = rows.filter("row_id = 99999").select("b", "ts", F.col("row_id").alias("state_id"))
    start = time.time()
    got = nodes.with_state(rows, state, ["b"], "ts", "wait")
    assert got.filter("state_state_id = 99999").count() == 100_000 and time.time() - start < 40


def test_ticks_are_made_by_their_own_state_only(spark):
    state = spark.range(100_000).select(F.lit(1).alias("b"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("s"))
    got = nodes.ticks(state, ["b"], "ts", 10, F.timestamp_seconds(F.lit(5)), F.timestamp_seconds(F.lit(100_020)))
    rows = {r.t: r.s for r in got.select(F.unix_seconds("tick").alias("t"), "s").collect()}
    assert rows == {t: min(t, 99_999) for t in range(5, 100_021, 10)}


@pytest.mark.parametrize(("instances", "segments"), [(1, 4), (3, 1), (3, 16), (8, 7)])
def test_evictions_equal_a_cache(spark, instances, segments):
    chance = random.Random(instances)
    rows = [(chance.randrange(9), at(k // 2), k) for k in range(500)]
    cache, lives, want = OrderedDict(), {}, {}
    for b, _, k in rows:
        if b not in cache:
            lives[b] = lives.get(b, -1) + 1
        cache[b] = None
        cache.move_to_end(b)
        if len(cache) > instances:
            cache.popitem(last=False)
        want[k] = lives[b]
    got = nodes.evictions(spark.createDataFrame(rows, "b long, ts timestamp, seq long"), ["b"], "ts", "seq", instances, segments=segments)
    assert {r.seq: r.life for r in got.collect()} == want


def test_inference_groups_rows_by_shape(spark):
    model = catalogue.linear_model([1.0, 2.0])
    rows = [(0, [1.0, 1.0]), (1, None), (2, [1.0]), (3, [0.5, 0.25]), (4, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "k long, x array<double>").coalesce(1)
    scored = stateful.infer(df, model, {"rows": ("x", "F64", ("BATCH", 2))}, {"scores": "s"}, "k long, s array<double>", keep=["k"])
    assert [tuple(r) for r in scored.collect()] == [(0, [3.0]), (1, None), (2, None), (3, [1.0]), (4, None)]
    alone = stateful.infer(df, model, {"rows": ("x", "F64", ("dynamic", 2))}, {"scores": "s"}, "k long, s array<array<double>>", keep=["k"])
    assert [tuple(r) for r in alone.collect()] == [(0, [[3.0]]), (1, None), (2, None), (3, [[1.0]]), (4, [[5.0], [11.0]])]
    assert np.isclose(float(scored.first().s[0]), 3.0)


def test_arrays_are_decoded_exactly(spark):
    raw = ['{"a":[1,2]}', '{"a":["1","2"]}', '{"a":[1,2,3]}', '{"a":[1,null]}', '{"a":[1,2.5]}', '{"a":7}']
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    assert [r.a for r in codecs.decode_json(df, "raw", {"a": Field("ARRAY<I64,2>")}).rows.collect()] == [[1, 2]]
    assert sorted(r.a for r in codecs.decode_json(df, "raw", {"a": Field("VEC<I64>")}).rows.collect()) == [[1, 2], [1, 2, 3]]
    nested = spark.createDataFrame([('{"a b.c":[[1,2,3],[4,5,6]]}',), ('{"a b.c":[[1,2],[4,5]]}',)], "raw string")
    assert [r["a b.c"] for r in codecs.decode_json(nested, "raw", {"a b.c": Field("ARRAY<I64,2,3>")}).rows.collect()] == [[[1, 2, 3], [4, 5, 6]]]


def test_xml_is_strict_and_typed(spark):
    raw = ["<row><a>1</a><s>x</s></row>", "<row><a>x</a></row>", "<row><a>300</a></row>", "<row><a>1</a><b/></row>", "<row><a>1</row>", "", None, "<other><a>1</a></other>", "<row><a>2</a><s><![CDATA[<b>]]></s></row>"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    strict, loose = (codecs.decode_xml(df, "raw", schema(a="U8", s="STRING?"), strict=s) for s in (True, False))
    assert sorted((r.a, r.s) for r in strict.rows.select("a", "s").collect()) == [(1, "x"), (2, "<b>")] and strict.errors.count() == 7
    assert loose.rows.count() == 3


def largest_method(df):
    """Bytecodes of the longest method that Spark generates for a query; the JVM compiles none beyond 8,000."""
    code = df._jdf.queryExecution().debug().codegenToSeq()
    return max(code.apply(k)._3().maxMethodCodeSize() for k in range(code.size()))


def test_nested_floats_write_their_operands_once(spark):
    """Size is linear in depth, and ordered assignments over floats are compiled by the JVM."""
    deep = field("x", "F64")
    for _ in range(10):
        deep = deep * lit(0.5) + lit(1.0)
    assert str(deep.value).count("inf") <= 2 * 10
    assert largest_method(catalogue.ordered_set(spark, "/root/testdata/sf0.001")) < 8000


@pytest.mark.parametrize("kind", T.FLOATS)
def test_floats_stay_finite_and_exact(spark, kind):
    least, most = {"F64": (5e-324, 1.7976931348623157e308), "F32": (1.401298464324817e-45, 3.4028234663852886e38)}[kind]
    good = [0.0, -0.0, least, -least, most, -most, 1.5, -2.25]
    df = spark.createDataFrame([(v,) for v in [*good, math.inf, -math.inf, math.nan, None]], "x double").select(F.col("x").cast(T.spark(kind)).alias("x"))
    e = field("x", kind) * lit(1.0, kind)
    assert dict(df.select(e.value.alias("v")).dtypes)["v"] == T.spark(kind)
    got = [(r.v, [x.code for x in r.e]) for r in df.select(e.value.alias("v"), e.errors().alias("e")).collect()]
    assert [(v, math.copysign(1, v)) for v, _ in got[: len(good)]] == [(v, math.copysign(1, v)) for v in good] and not any(errors for _, errors in got[: len(good)])
    assert got[len(good) :] == [(None, ["invalid_argument"])] * 3 + [(None, [])]
    assert value(spark, lit(most, kind) * lit(2.0, kind)).v is None


def test_texts_of_floats_are_written_once(spark):
    """Casts between floats and texts stay short enough for the JVM to compile, and name their operand once."""
    assert largest_method(catalogue.fn_cast_float_text(spark, "/root/testdata/sf0.001")) < 8000
    assert str(cast(cast(field("operand", "F64"), "STRING"), "F64").value).count("operand") == 1
    assert largest_method(spark.range(3).select(cast(cast(cast(cast(field("id", "I64"), "F64"), "STRING"), "F64"), "STRING").value)) < 8000


def test_texts_of_floats_have_no_exponent(spark):
    good = [0.0, -0.0, 1.0, -1.0, 0.001, -0.00099, 9999999.0, 1e7, -1e7, 12345678.9, -12345678.25, 1e22, 1.5e300, -5e-324, 1.7976931348623157e308, 2.0**53, 1234567.0]
    rng = np.random.default_rng(5)
    good += (rng.integers(-(10**6), 10**6, 300) * 10.0 ** rng.integers(-12, 25, 300)).tolist()
    df = spark.createDataFrame([(v,) for v in [*good, math.inf, -math.inf, math.nan, None]], "x double")
    text = cast(field("x", "F64"), "STRING")
    back = cast(text, "F64")
    got = df.select(text.value.alias("t"), back.value.alias("b"), back.errors().alias("e")).collect()
    assert [float(r.t) for r in got[: len(good)]] == good and [r.b for r in got[: len(good)]] == good
    for v, r in zip(good, got, strict=False):
        assert re.fullmatch(r"-?(0|[1-9]\d*)(\.\d*[1-9])?", r.t) and r.t.startswith("-") == (math.copysign(1, v) < 0) and r.e == []
    assert [(r.t, r.b, [x.code for x in r.e]) for r in got[len(good) :]] == [("inf", None, ["cast_failed"]), ("-inf", None, ["cast_failed"]), ("NaN", None, ["cast_failed"]), (None, None, [])]
