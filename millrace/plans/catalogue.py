"""Queries over the given tables, one or more for each operator, with their SQL twins where SQL can express them."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import Expr, array, call, case, cast, if_, lit, of_table, udf
from millrace.functions import lookup_hash_map as looked_up
from millrace.operators import nodes, stateful, windows
from millrace.operators.route import Route, schema
from millrace.operators.windows import Aggregate
from millrace.sources import codecs, connectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def computed(df: DataFrame, *keys: str, **made: Expr) -> DataFrame:
    """Key columns and computed ones."""
    return df.select(*keys, *[e.value.alias(n) for n, e in made.items()])


def s(text: str) -> Expr:
    return lit(text)


# ---- nodes that filter and map


@query("SELECT event_id, upper(event_type) AS kind FROM events WHERE contains(event_type, 'c')")
def junction_filter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = Route(schema(event_id="I64", kind="STRING"), inherit=("event_id",), set=(("kind", lambda m: call("upper", m["event_type"])),))
    return nodes.junction([(table(spark, sf_dir, "events"), None)], {"out": route}, where=lambda m: call("contains", m["event_type"], s("c")))["out"].rows


@query("""SELECT event_id, user_id, 'big' AS lane FROM (SELECT * FROM events WHERE event_type = 'click' UNION ALL SELECT * FROM events WHERE event_type = 'purchase') WHERE value > 50
UNION ALL SELECT event_id, user_id, 'all' AS lane FROM events WHERE event_type IN ('click', 'purchase')""")
def junction_fanout_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    fields = schema(event_id="I64", user_id="I64", lane="STRING", value="F64?")
    lane = lambda name, **k: Route(fields, inherit=("event_id", "user_id", "value"), set=(("lane", lambda m: s(name)),), **k)
    sources = [(events, lambda m, k=kind: m["event_type"].eq(s(k))) for kind in ("click", "purchase")]
    out = nodes.junction(sources, {"big": lane("big", where=lambda m: m["value"] > lit(50.0)), "all": lane("all")})
    return out["big"].rows.unionByName(out["all"].rows).drop("value")


@query("""SELECT l_orderkey, l_linenumber, price, (price + price) + tax AS total, CASE WHEN (price + price) + tax > 1000 THEN 'high' ELSE 'low' END AS band
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS price, l_extendedprice * (1 - l_discount) * l_tax AS tax FROM lineitem)""")
def ordered_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lit(1.0)
    route = Route(
        schema(l_orderkey="I64", l_linenumber="I32", price="F64", total="F64", band="STRING"),
        inherit=("l_orderkey", "l_linenumber"),
        set=(
            ("price", lambda m: m["l_extendedprice"] * (one - m["l_discount"])),
            ("total", lambda m: m["price"] * m["l_tax"]),
            ("total", lambda m: (m["price"] + m["price"]) + m["total"]),
            ("band", lambda m: if_(m["total"] > lit(1000.0), s("high"), s("low"))),
        ),
    )
    return nodes.junction([(table(spark, sf_dir, "lineitem"), None)], {"out": route})["out"].rows


@query("""SELECT l_orderkey, l_linenumber, 'ok' AS lane, l_orderkey // (l_partkey % 7) AS result, NULL AS error_code FROM lineitem WHERE l_partkey % 7 <> 0
UNION ALL SELECT l_orderkey, l_linenumber, 'error', NULL, 'division_by_zero' FROM lineitem WHERE l_partkey % 7 = 0""")
def int_div_error_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("l_orderkey", "l_linenumber")
    route = Route(
        schema(l_orderkey="I64", l_linenumber="I32", lane="STRING", result="I64", error_code="STRING?"),
        inherit=keys,
        set=(("lane", lambda m: s("ok")), ("result", lambda m: m["l_orderkey"] / (m["l_partkey"] % lit(7)))),
        errors=(*[(k, lambda m, k=k: m[k]) for k in keys], ("lane", lambda m: s("error")), ("result", lambda m: m["partial_result"]), ("error_code", lambda m: m["error_code"])),
    )
    out = nodes.junction([(table(spark, sf_dir, "lineitem"), None)], {"out": route})["out"]
    return out.rows.unionByName(out.errors)


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN 2 END AS simple, CASE WHEN value > 50 THEN event_id // (user_id - user_id % 2 + 1) ELSE 0 END AS guarded FROM events""")
def case_selected_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    m = of_table(events)
    simple = case((s("click"), lit(1)), (s("view"), lit(2)), of=m["event_type"])
    guarded = if_(m["value"] > lit(50.0), m["event_id"] / (m["user_id"] - m["user_id"] % lit(2) + lit(1)), lit(0))
    return computed(events, "event_id", simple=cast(simple, "I32"), guarded=guarded)


# ---- scalar functions

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(f"""SELECT p_partkey, translate(p_name, '{UP}', '{LOW}') AS lowered, translate(p_name, '{LOW}', '{UP}') AS uppered, length(p_name) AS size, strlen(p_name) * 8 AS bits, ord(p_name)::BIGINT AS first_code,
reverse(p_type) AS reversed, md5(p_name) AS digest, 'x' AS trimmed, 'x  ' AS ltrimmed, '  x' AS rtrimmed FROM part""")
def fn_string_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    m = of_table(part)
    name = m["p_name"]
    return computed(
        part, "p_partkey", lowered=call("lower", name), uppered=call("upper", name), size=call("length", name), bits=call("bit_length", name), first_code=call("ascii", name), reversed=call("reverse", m["p_type"]),
        digest=call("md5", name), trimmed=call("trim", s("  x  ")), ltrimmed=call("ltrim", s("  x  ")), rtrimmed=call("rtrim", s("  x  ")),
    )


@query("""SELECT p_partkey, left(p_name, 3) AS head, left(p_name, -2) AS all_but_tail, right(p_name, 3) AS tail, right(p_name, -2) AS all_but_head, substr(p_name, 1, 4) AS part_of, substr(p_name, 3) AS rest,
lpad(p_name, 4, 'xy') AS short_padded, rpad(p_name, 40, 'xy') AS padded, repeat(p_brand, 2) AS twice, concat(p_brand, '-', p_type) AS joined, replace(p_name, 'a', 'AA') AS replaced, translate(p_name, 'abc', 'x') AS translated FROM part""")
def fn_string_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    m = of_table(part)
    name = m["p_name"]
    return computed(
        part, "p_partkey", head=call("left", name, lit(3)), all_but_tail=call("left", name, lit(-2)), tail=call("right", name, lit(3)), all_but_head=call("right", name, lit(-2)), part_of=call("substr", name, lit(0), lit(4)),
        rest=call("substring", name, lit(3)), short_padded=call("lpad", name, lit(4), s("xy")), padded=call("rpad", name, lit(40), s("xy")), twice=call("repeat", m["p_brand"], lit(2)),
        joined=call("concat", m["p_brand"], s("-"), m["p_type"]), replaced=call("replace", name, s("a"), s("AA")), translated=call("translate", name, s("abc"), s("x")),
    )


@query("""SELECT c_custkey, contains(c_name, '1') AS has, starts_with(c_name, 'Cust') AS starts, ends_with(c_name, '0') AS ends, strpos(c_name, '#')::BIGINT AS place, split_part(c_name, '#', 2) AS after_mark, '' AS none,
c_mktsegment || NULL IS NULL AS missing, regexp_matches(c_name, '[0-9]5$') AS likes, regexp_replace(c_name, '0+', 'z', 'g') AS subbed, nullif(regexp_extract(c_name, '[1-9]+'), '') AS digits FROM customer""")
def fn_string_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    m = of_table(customer)
    name = m["c_name"]
    return computed(
        customer, "c_custkey", has=call("contains", name, s("1")), starts=call("starts_with", name, s("Cust")), ends=call("ends_with", name, s("0")), place=call("strpos", name, s("#")), after_mark=call("split_part", name, s("#"), lit(2)),
        none=call("split_part", name, s("#"), lit(0)), missing=call("is_null", call("nullif", m["c_mktsegment"], m["c_mktsegment"])), likes=call("regexp_like", name, s("[0-9]5$")),
        subbed=call("regexp_replace", name, s("0+"), s("z")), digits=call("regexp_substr", name, s("[1-9]+")),
    )


@query("""SELECT c_custkey, lower(to_hex(c_custkey)) AS hexed, lower(to_hex(CASE WHEN -c_nationkey < 0 THEN 4294967296 - c_nationkey ELSE 0 END)) AS negative,
array_to_string(list_transform(regexp_extract_all(lower(c_name), '[a-z0-9]+|[^a-z0-9]+'), lambda w: upper(w[1]) || w[2:]), '') AS capitals FROM customer""")
def fn_hex_initcap(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    m = of_table(customer)
    return computed(customer, "c_custkey", hexed=call("to_hex", m["c_custkey"]), negative=call("to_hex", -m["c_nationkey"]), capitals=call("initcap", m["c_name"]))


@query("""SELECT event_id, round(acos(value / 1000), 9) AS acos, round(asin(value / 1000), 9) AS asin, round(atan(value), 9) AS atan, round(cos(value), 9) AS cos, round(tan(value / 1000), 9) AS tan, round(exp(value / 100), 6) AS exp,
CASE WHEN value > 0 THEN round(ln(value), 9) END AS ln, CASE WHEN value >= 0 THEN round(sqrt(value), 9) END AS sqrt, CASE WHEN value > 0 THEN round(log10(value), 9) END AS log, CASE WHEN value > 0 THEN round(ln(value) / ln(2), 9) END AS log2,
round(pow(value, 2), 6) AS squared, abs(-value) AS size, CAST(NULL AS DOUBLE) AS infinite FROM events""")
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    v = of_table(events)["value"]
    small = v / lit(1000.0)
    made = {
        "acos": call("acos", small), "asin": call("asin", small), "atan": call("atan", v), "cos": call("cos", v), "tan": call("tan", small), "exp": call("exp", v / lit(100.0)), "ln": call("ln", v), "sqrt": call("sqrt", v),
        "log": call("log", v), "log2": call("log", lit(2.0), v), "squared": call("pow", v, lit(2.0)),
    }
    digits = {"exp": 6, "squared": 6}
    return events.select("event_id", *[F.round(e.value, digits.get(n, 9)).alias(n) for n, e in made.items()], call("abs", -v).value.alias("size"), call("pow", v + lit(10.0), lit(1e6)).value.alias("infinite"))


@query("""SELECT l_orderkey, l_linenumber, ceil(l_extendedprice) AS up, floor(l_extendedprice) AS down, sign(l_extendedprice) * floor(abs(l_extendedprice) + 0.5) AS near, l_linenumber AS same,
CAST(trunc(l_quantity) AS BIGINT) AS whole, CAST(l_linenumber AS BIGINT) AS wide, l_partkey % 5 AS remainder, -l_partkey // 3 AS quotient, CAST(NULL AS BIGINT) AS too_large, -l_partkey AS negative FROM lineitem""")
def fn_round_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    m = of_table(lines)
    price, key = m["l_extendedprice"], m["l_partkey"]
    return computed(
        lines, "l_orderkey", "l_linenumber", up=call("ceil", price), down=call("floor", price), near=call("round", price), same=call("round", m["l_linenumber"]), whole=cast(m["l_quantity"], "I64"), wide=cast(m["l_linenumber"], "I64"),
        remainder=key % lit(5), quotient=-key / lit(3), too_large=key * lit(2**63 - 1) * lit(4), negative=-key,
    )


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS text, user_id::BIGINT AS back, user_id <> 0 AS flag, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS stamp, TRUE AS truth, CAST(NULL AS BIGINT) AS bad, epoch_us(ts) * 1000 AS nanos FROM events""")
def fn_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    m = of_table(events)
    text = cast(m["user_id"], "STRING")
    return computed(
        events, "event_id", text=text, back=cast(text, "I64"), flag=cast(m["user_id"], "BOOL"), stamp=call("left", cast(m["ts"], "STRING"), lit(19)), truth=cast(s("true"), "BOOL"), bad=cast(m["event_type"], "I64"),
        nanos=cast(Expr(F.col("ts").cast("timestamp"), "DATETIME"), "I64"),
    )


@query("""SELECT vec_id, embedding[1] AS first_value, embedding[len(embedding)] AS last_value, embedding[3] AS third, CAST(NULL AS FLOAT) AS outside, len(embedding)::BIGINT AS size, 6::BIGINT AS summed FROM embeddings""")
def fn_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    v = of_table(vectors)["embedding"]
    return computed(vectors, "vec_id", first_value=call("first", v), last_value=call("last", v), third=call("nth", v, lit(2)), outside=call("nth", v, lit(-1)), size=call("count", v), summed=call("sum", array(lit(1), lit(2), lit(3))))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_orderkey + l_partkey + coalesce(nullif(l_suppkey % 3, 0), 0) AS BIGINT) AS summed, 3::BIGINT AS size, nullif(l_suppkey % 3, 0) AS last_value,
CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey % 3 END AS small FROM lineitem""")
def fn_list_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    m = of_table(lines)
    third = call("nullif", m["l_suppkey"] % lit(3), lit(0))
    values = array(m["l_orderkey"], m["l_partkey"], third)
    return computed(lines, "l_orderkey", "l_linenumber", summed=call("sum", values), size=call("count", values), last_value=call("last", values), small=call("sum", array(third)))


@query("""SELECT event_id, coalesce(nullif(event_type, 'error'), 'none') AS kind, nullif(event_type, 'error') IS NULL AS missing, concat(nullif(event_type, 'error'), '!') AS marked,
CASE WHEN nullif(event_type, 'error') = 'click' THEN TRUE WHEN event_type = 'error' THEN NULL ELSE FALSE END AS clicked FROM events""")
def fn_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = call("nullif", of_table(events)["event_type"], s("error"))
    return computed(events, "event_id", kind=call("coalesce", kind, s("none")), missing=call("is_null", kind), marked=call("concat", kind, s("!")), clicked=kind.eq(s("click")))


@query("SELECT event_id, length(CAST(event_id AS VARCHAR)) = 0 AS same, TRUE AS fourth, TRUE AS seventh FROM events")
def fn_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("four", call("uuid_v4").value).withColumn("seven", call("uuid_v7").value)
    like = lambda c, v: F.col(c).rlike(f"^[0-9a-f]{{8}}-[0-9a-f]{{4}}-{v}[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$")
    return events.select("event_id", (F.col("four") == F.col("seven")).alias("same"), like("four", 4).alias("fourth"), like("seven", 7).alias("seventh"))


@query("SELECT o_orderkey, (o_custkey * 31 + 7) % 97 AS code FROM orders")
def fn_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    code = udf("code", lambda x: (x.astype("int64") * 31 + 7) % 97, ("I64",), "I64")
    return computed(orders, "o_orderkey", code=code(of_table(orders)["o_custkey"]))


# ---- deduplication, order, branches

EVENT = ("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.first_of_key(table(spark, sf_dir, "events").select("ts", *EVENT), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ts FROM events),
passed AS (SELECT event_id, user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM e) WHERE n = 1
UNION ALL SELECT n.event_id, n.user_id, n.event_type, n.ts FROM (SELECT e.*, row_number() OVER (PARTITION BY e.user_id, e.event_type ORDER BY e.ts, e.event_id) AS k FROM passed p JOIN e ON e.user_id = p.user_id AND e.event_type = p.event_type AND e.ts >= p.ts + INTERVAL 6 HOUR) n WHERE k = 1)
SELECT event_id, user_id, event_type FROM passed""")
def dedup_max_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.deduplicate(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "event_id", 6 * 3600).drop("ts")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY nullif(event_type, 'error') NULLS FIRST, value NULLS FIRST, event_id)::INT AS position FROM events")
def reorder_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.nullif("event_type", F.lit("error"))
    return nodes.reorder(table(spark, sf_dir, "events"), ["user_id"], [kind, F.col("value")], "event_id").select("event_id", "user_id", "position")


@query("SELECT o_orderkey, '{\"nation\":' || c_nationkey || '}' AS _branch FROM orders JOIN customer ON o_custkey = c_custkey")
def reingest_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return nodes.rekey(joined, {"nation": F.col("c_nationkey")}).select("o_orderkey", "_branch")


# ---- windows


@query("""SELECT user_id, (n - 1) // 4 AS window, count(*) AS n_events, min_by(value, n) AS first_value, max_by(value, n) AS last_value, CAST(sum(event_id) AS BIGINT) AS total, min(value) AS low, max(value) AS high
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY ALL HAVING count(*) = 4""")
def window_tumbling_msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"n_events": ("count", "event_id"), "first_value": ("first", "value"), "last_value": ("last", "value"), "total": ("sum", "event_id"), "low": ("min", "value"), "high": ("max", "value")}
    return windows.by_messages(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 4, 4, {n: Aggregate(*a) for n, a in made.items()})


@query("""SELECT user_id, (n - 5) // 2 AS window, cnt AS n_events, total, low FROM (SELECT user_id, row_number() OVER w AS n, count(*) OVER f AS cnt, CAST(sum(event_id) OVER f AS BIGINT) AS total, min(value) OVER f AS low
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n >= 5 AND (n - 5) % 2 = 0""")
def window_sliding_msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"n_events": Aggregate("count", "event_id"), "total": Aggregate("sum", "event_id"), "low": Aggregate("min", "value")}
    return windows.by_messages(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 5, 2, made)


RANK = "(list_extract(list_sort(list(least(greatest(floor(value / 10), 0), 19))), CAST(greatest(1, ceil({} * count(*))) AS INT)) + 0.5) * 10"


@query(f"""SELECT user_id, "window", {RANK.format(0.5)} AS p50, {RANK.format(0.9)} AS p90 FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS "window" FROM events) GROUP BY ALL HAVING count(*) = 8""")
def window_hist_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {n: Aggregate("percentile_linear_histogram", "value", p, 20, 0.0, 200.0) for n, p in (("p50", 50.0), ("p90", 90.0))}
    return windows.by_messages(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 8, 8, made)


@query("""SELECT event_type, strftime(w, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_events, CAST(sum(event_id) AS BIGINT) AS total FROM (SELECT event_type, event_id, unnest([date_trunc('day', ts), date_trunc('day', ts) + INTERVAL 12 HOUR, date_trunc('day', ts) - INTERVAL 12 HOUR]) AS w, ts FROM events)
WHERE w <= ts AND ts < w + INTERVAL 1 DAY GROUP BY ALL""")
def window_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.by_time(table(spark, sf_dir, "events"), ["event_type"], "ts", ["ts", "event_id"], "1 day", "12 hours", {"n_events": Aggregate("count", "event_id"), "total": Aggregate("sum", "event_id")})
    return made.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_events", "total")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts FROM events),
w AS (SELECT user_id, min(ts) AS start FROM e GROUP BY user_id
UNION ALL SELECT user_id, start FROM (SELECT w.user_id, e.ts AS start, row_number() OVER (PARTITION BY w.user_id ORDER BY e.ts) AS k FROM w JOIN e ON e.user_id = w.user_id AND e.ts >= w.start + INTERVAL 1 DAY) WHERE k = 1)
SELECT w.user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n_events, CAST(sum(event_id) AS BIGINT) AS total FROM w JOIN e ON e.user_id = w.user_id AND e.ts >= start AND e.ts < start + INTERVAL 1 DAY GROUP BY w.user_id, start""")
def window_duration_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda rows, *_: {"user_id": rows[0]["user_id"], "start": str(rows[0]["ts"])[:19], "n_events": len(rows), "total": sum(r["event_id"] for r in rows)}
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return stateful.anchored_windows(events, ["user_id"], "ts", "event_id", "user_id long, start string, n_events long, total long", make, 86400, 86400)


#: One action at a time: close by messages, close by time, or take the next event.
@query("""WITH RECURSIVE r AS (SELECT user_id, event_id AS id, ts::TIMESTAMP AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::STRUCT(id BIGINT, ts TIMESTAMP)[] AS buf, NULL::TIMESTAMP AS start, NULL::STRUCT(first_event BIGINT, n_events BIGINT, total BIGINT, closed_at TIMESTAMP) AS made FROM r
UNION ALL SELECT user_id, CASE WHEN act = 'take' THEN n + 1 ELSE n END, CASE act WHEN 'take' THEN list_append(buf, {'id': id, 'ts': ts}) WHEN 'count' THEN buf[3:] ELSE list_filter(buf, lambda x: x.ts >= start + INTERVAL 12 HOUR) END,
CASE act WHEN 'take' THEN coalesce(start, ts) WHEN 'count' THEN buf[3].ts ELSE CASE WHEN len(list_filter(buf, lambda x: x.ts >= start + INTERVAL 12 HOUR)) > 0 THEN start + INTERVAL 12 HOUR END END,
CASE WHEN act <> 'take' THEN {'first_event': buf[1].id, 'n_events': len(buf)::BIGINT, 'total': list_sum(list_transform(buf, lambda x: x.id))::BIGINT, 'closed_at': CASE WHEN act = 'count' THEN buf[-1].ts ELSE start + INTERVAL 1 DAY END} END
FROM (SELECT s.*, r.id, r.ts, CASE WHEN len(buf) >= 4 THEN 'count' WHEN len(buf) > 0 AND (r.ts IS NULL OR r.ts >= start + INTERVAL 1 DAY) THEN 'time' WHEN r.ts IS NOT NULL THEN 'take' END AS act FROM s LEFT JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1) WHERE act IS NOT NULL)
SELECT user_id, made.first_event AS first_event, made.n_events AS n_events, made.total AS total, strftime(made.closed_at, '%Y-%m-%d %H:%M:%S') AS closed FROM s WHERE made IS NOT NULL""")
def window_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"first_event": Aggregate("first", "event_id"), "n_events": Aggregate("count", "event_id"), "total": Aggregate("sum", "event_id")}
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    out = stateful.windows(events, ["user_id"], "ts", "event_id", made, width_seconds=86400, step_seconds=43200, messages=4, step_messages=2)
    return out.select("user_id", *made, F.date_format("closed_at", "yyyy-MM-dd HH:mm:ss").alias("closed"))


@query("""WITH r AS (SELECT user_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
c AS (SELECT user_id, (i - 7) // 4 AS k, ts AS closed FROM r WHERE i >= 7 AND (i - 7) % 4 = 0),
v AS (SELECT r.*, c.closed AS removed FROM r LEFT JOIN c ON c.user_id = r.user_id AND c.k = r.i // 4)
SELECT c.user_id, c.k AS "window", count(*) FILTER (i >= 4 * k) AS n_events, (list_extract(list_sort(list(least(greatest(floor(value / 10), 0), 19))), CAST(greatest(1, ceil(0.25 * count(*))) AS INT)) + 0.5) * 10 AS p25
FROM c JOIN v ON v.user_id = c.user_id AND (i BETWEEN 4 * k AND 4 * k + 7 OR (i < 4 * k AND removed + INTERVAL 2 DAY > closed)) GROUP BY ALL""")
def window_hist_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a step removed stays in the histogram for two more days."""
    made = {"n_events": Aggregate("count", "value"), "p25": Aggregate("percentile_linear_histogram", "value", 25.0, 20, 0.0, 200.0, delay_seconds=2 * 86400)}
    out = stateful.windows(table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts"), ["user_id"], "ts", "event_id", made, messages=8, step_messages=4)
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("closed_at")) - 1
    return out.select("user_id", number.cast("long").alias("window"), "n_events", "p25")


# ---- joins


def correlated(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    side = lambda kind, name: table(spark, sf_dir, "events").filter(F.col("event_type") == kind).select("user_id", "ts", "event_id", F.col("event_id").alias(name), F.col("value").alias(f"{name}_value"))
    make = lambda a, b: {"user_id": a["user_id"], "left_id": a["left_id"], "right_id": b["right_id"]}
    late = lambda name, row: {"user_id": row["user_id"], "left_id": row["left_id"], "right_id": row["right_id"]}
    return stateful.correlate(side("click", "left_id"), side("purchase", "right_id"), ["user_id"], "ts", "event_id", "user_id long, left_id long, right_id long", make, timed_out=late, **how)


PAIRED = "left_id IS NOT NULL AND right_id IS NOT NULL"
KTH = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'click'), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase')
SELECT l.user_id, l.event_id AS left_id, r.event_id AS right_id FROM l JOIN r USING (user_id, k)"""
#: Clicks and purchases of each user, one after another.
SIDES = """WITH RECURSIVE r AS (SELECT user_id, event_id AS id, ts, value, event_type = 'click' AS is_left, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('click', 'purchase')),"""


@query(KTH)
def correlate_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the machine that takes each arrival in turn."""
    return correlated(spark, sf_dir, native=False).filter(PAIRED)


@query(KTH)
def correlate_earliest_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a predicate every branch is a queue: the k-th left row meets the k-th right one."""
    return correlated(spark, sf_dir).filter(PAIRED)


@query(f"""{SIDES} s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::BIGINT[] AS waiting, FALSE AS lefts, NULL::BIGINT AS left_id, NULL::BIGINT AS right_id FROM r
UNION ALL SELECT r.user_id, r.n, CASE WHEN len(waiting) = 0 OR lefts = is_left THEN list_append(waiting, id) ELSE waiting[:-2] END, CASE WHEN len(waiting) = 0 THEN is_left ELSE lefts END,
CASE WHEN len(waiting) > 0 AND lefts <> is_left THEN CASE WHEN is_left THEN id ELSE waiting[-1] END END, CASE WHEN len(waiting) > 0 AND lefts <> is_left THEN CASE WHEN is_left THEN waiting[-1] ELSE id END END
FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1)
SELECT user_id, left_id, right_id FROM s WHERE left_id IS NOT NULL""")
def correlate_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlated(spark, sf_dir, match="latest").filter(PAIRED)


ROW = "STRUCT(id BIGINT, ts TIMESTAMP, value DOUBLE)[]"
OUT = "STRUCT(left_id BIGINT, right_id BIGINT)[]"


@query(f"""{SIDES} s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, []::{ROW} AS l, []::{ROW} AS g, []::{OUT} AS emitted FROM r
UNION ALL SELECT user_id, n, CASE WHEN is_left THEN CASE WHEN hit > 0 THEN l ELSE list_append(l, own) END ELSE CASE WHEN hit > 0 THEN list_filter(l, lambda x: x.id <> l[hit].id) ELSE l END END,
CASE WHEN is_left THEN CASE WHEN hit > 0 THEN list_filter(g, lambda x: x.id <> g[hit].id) ELSE g END ELSE CASE WHEN hit > 0 THEN g ELSE list_append(g, own) END END,
list_concat(list_concat(list_transform(l0, lambda x: {{'left_id': x.id, 'right_id': NULL::BIGINT}}), list_transform(g0, lambda x: {{'left_id': NULL::BIGINT, 'right_id': x.id}})),
CASE WHEN hit > 0 THEN [{{'left_id': CASE WHEN is_left THEN own.id ELSE l[hit].id END, 'right_id': CASE WHEN is_left THEN g[hit].id ELSE own.id END}}] ELSE []::{OUT} END)
FROM (SELECT *, coalesce(CASE WHEN is_left THEN list_position(list_transform(g, lambda x: own.value <= x.value), TRUE) ELSE list_position(list_transform(l, lambda x: x.value <= own.value), TRUE) END, 0) AS hit
FROM (SELECT r.user_id, r.n, is_left, {{'id': r.id, 'ts': r.ts::TIMESTAMP, 'value': r.value::DOUBLE}} AS own, list_filter(s.l, lambda x: x.ts + INTERVAL 1 DAY >= r.ts) AS l, list_filter(s.g, lambda x: x.ts + INTERVAL 1 DAY >= r.ts) AS g,
list_filter(s.l, lambda x: x.ts + INTERVAL 1 DAY < r.ts) AS l0, list_filter(s.g, lambda x: x.ts + INTERVAL 1 DAY < r.ts) AS g0 FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1))),
last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)
SELECT user_id, e.left_id, e.right_id FROM (SELECT user_id, unnest(emitted) AS e FROM s)
UNION ALL SELECT user_id, x.id, NULL FROM (SELECT user_id, unnest(l) AS x FROM last) UNION ALL SELECT user_id, NULL, x.id FROM (SELECT user_id, unnest(g) AS x FROM last)""")
def correlate_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlated(spark, sf_dir, matches=lambda a, b: a["left_id_value"] <= b["right_id_value"], horizon_seconds=86400)


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def materialized_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return nodes.latest(events, ["user_id"], "ts", "ts", "event_id").drop("ts")


STATE = "SELECT user_id, ts, event_id AS purchase_id FROM events WHERE event_type = 'purchase'"


def state_of(spark: SparkSession, sf_dir: str, mode: str, **more) -> DataFrame:
    events = table(spark, sf_dir, "events")
    state = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return nodes.with_state(events.filter("event_type = 'click'").select("user_id", "ts", "event_id"), state, ["user_id"], "ts", mode, prefix="", **more).drop("ts")


@query(f"SELECT e.user_id, e.event_id, s.purchase_id FROM events e ASOF JOIN ({STATE}) s ON e.user_id = s.user_id AND e.ts >= s.ts WHERE e.event_type = 'click'")
def enrich_state_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_of(spark, sf_dir, "skip")


@query(f"SELECT e.user_id, e.event_id, coalesce(s.purchase_id, -1) AS purchase_id FROM events e ASOF LEFT JOIN ({STATE}) s ON e.user_id = s.user_id AND e.ts >= s.ts WHERE e.event_type = 'click'")
def enrich_state_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_of(spark, sf_dir, "default", defaults={"purchase_id": -1})


@query(f"""SELECT e.user_id, e.event_id, coalesce(s.purchase_id, n.purchase_id) AS purchase_id FROM events e ASOF LEFT JOIN ({STATE}) s ON e.user_id = s.user_id AND e.ts >= s.ts ASOF LEFT JOIN ({STATE}) n ON e.user_id = n.user_id AND e.ts <= n.ts
WHERE e.event_type = 'click' AND coalesce(s.purchase_id, n.purchase_id) IS NOT NULL""")
def enrich_state_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_of(spark, sf_dir, "wait")


@query("SELECT o_orderkey, c_name AS customer_name, c_mktsegment AS customer_segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) ON o_custkey = c_custkey")
def lookup_hash_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").filter("c_nationkey < 20").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return nodes.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customers, F.col("o_custkey"), "c_custkey", ["name", "segment"], order="c_custkey", prefix="customer_").drop("o_custkey")


@query("""WITH t AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS tick), b AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, strftime(tick, '%Y-%m-%d') AS day, e.event_id FROM (SELECT user_id, tick FROM b, t) x ASOF JOIN events e USING (user_id) WHERE TRUE""".replace("ASOF JOIN events e USING (user_id) WHERE TRUE", "ASOF JOIN events e ON x.user_id = e.user_id AND x.tick >= e.ts").replace("SELECT user_id, strftime", "SELECT x.user_id, strftime", 1))
def generator_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return nodes.ticks(state, ["user_id"], "ts", 86400, day("2024-01-01"), day("2024-01-31")).select("user_id", F.date_format("tick", "yyyy-MM-dd").alias("day"), "event_id")


@query("""SELECT event_id, least(off, 3600000000 - off) <= 600000000 AS admitted FROM (SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) % 3600000000 AS off FROM events)""")
def paced_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.admitted(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-01").cast("timestamp"), 3600, 600).select("event_id", "admitted")


# ---- sinks, codecs, subscriptions


@query("SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def upsert_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.upsert(table(spark, sf_dir, "events").select(*EVENT), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id, min_by(value, event_id) AS value FROM events GROUP BY ALL")
def upsert_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.upsert(table(spark, sf_dir, "events").select(*EVENT), ["user_id", "event_type"], "event_id", update=False)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_codec_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.decode_json(table(spark, sf_dir, "events"), "props", schema(k="I64"), strict=True).rows.select("event_id", "k")


@query("SELECT event_id, (event_id % 2) AS odd FROM events WHERE event_id % 3 <> 0")
def json_codec_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("event_id") % 3 == 0, F.lit('"text"')).otherwise((F.col("event_id") % 2).cast("string"))
    raw = table(spark, sf_dir, "events").withColumn("raw", F.concat(F.lit('{"odd":'), odd, F.lit(',"more":1}')))
    return codecs.decode_json(raw, "raw", schema(odd="I64"), strict=False).rows.select("event_id", "odd")


@query("SELECT o_orderkey, '{\"o_orderkey\":' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ',\"status\":\"' || o_orderstatus || '\"' END || '}' AS payload FROM orders")
def json_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    return orders.select("o_orderkey", codecs.encode_json(orders, ["o_orderkey", "status"]).alias("payload"))


@query("SELECT c_custkey, '<masked>' AS c_name, c_mktsegment FROM customer WHERE c_acctbal > 0")
def sensitive_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.subscribe(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), ["c_name"], F.col("c_acctbal") > 0).drop("c_acctbal")


def message(*fields: tuple[int, int | bytes | str]) -> bytes:
    """Fields of a Protobuf message: number and an integer, bytes, or text."""

    def number(n: int) -> bytes:
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)

    out = b""
    for k, v in fields:
        v = v.encode() if isinstance(v, str) else v
        out += number(k << 3) + number(v) if isinstance(v, int) else number(k << 3 | 2) + number(len(v)) + v
    return out


def linear_model(weights: list[float]) -> bytes:
    """An ONNX model of scores = rows · weights, in F64."""
    kind = 11  # double
    shape = lambda *dims: message((1, message((1, kind), (2, b"".join(message((1, message((2, d) if isinstance(d, str) else (1, d)))) for d in dims)))))
    tensor = message((1, len(weights)), (1, 1), (2, kind), (8, "weights"), (9, struct.pack(f"<{len(weights)}d", *weights)))
    node = message((1, "rows"), (1, "weights"), (2, "scores"), (4, "MatMul"))
    graph = message((1, node), (2, "linear"), (5, tensor), (11, message((1, "rows"), (2, shape("n", len(weights))))), (12, message((1, "scores"), (2, shape("n", 1)))))
    return message((1, 8), (7, graph), (8, message((1, ""), (2, 13))))


@query("SELECT vec_id, round(list_sum(list_transform(range(len(embedding)), lambda i: embedding[i + 1]::DOUBLE * (i % 7 - 3))), 6) AS score FROM embeddings")
def inferencer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear model run by onnxruntime over batches of rows."""
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.filter("embedding IS NOT NULL").first()
    size = len(one.embedding) if one else 1
    scored = stateful.infer(vectors, linear_model([float(k % 7 - 3) for k in range(size)]), {"rows": ("embedding", "F64", ("BATCH", size))}, {"scores": "scores"}, "vec_id long, scores array<double>", keep=["vec_id"])
    return scored.select("vec_id", F.round(F.get("scores", 0), 6).alias("score"))


@query("SELECT event_id, user_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS running FROM events")
def guest_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    class Total:
        def __init__(self) -> None:
            self.total = 0

        def see(self, row):
            self.total += row["event_id"]
            yield {"event_id": row["event_id"], "user_id": row["user_id"], "running": self.total}

        def end(self):
            return iter(())

    return stateful.guest(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], Total, "event_id long, user_id long, running long")


@query("""SELECT event_id, user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS life FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events)""")
def branch_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.lives(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 12 * 3600).select("event_id", "user_id", "life")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id ORDER BY max(ts) DESC LIMIT 20")
def branch_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = nodes.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", "ts", "event_id")
    return nodes.most_recent(state, "ts", "event_id", 20).select("user_id", "event_id")


@query("""WITH e AS (SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events), p AS (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY n) AS before FROM e),
d AS (SELECT p.n, count(DISTINCT e.user_id) AS others FROM p JOIN e ON e.n > p.before AND e.n < p.n GROUP BY p.n)
SELECT event_id, user_id, CAST(sum(CASE WHEN before IS NULL OR coalesce(others, 0) >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY p.n) AS BIGINT) - 1 AS life FROM p LEFT JOIN d ON d.n = p.n""")
def branch_lru_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user who isn't among the 40 seen last starts anew."""
    return nodes.evictions(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id", 40).select("event_id", "user_id", "life")


# ---- row errors, logic, lookups in assignments, further codecs


@query("""SELECT event_id, (event_type = 'click' AND value > 50) AS both, (event_type = 'click' OR nullif(event_type, 'error') = 'view') AS either, NOT (nullif(event_type, 'error') = 'view') AS neither,
(nullif(event_type, 'error') = 'view' AND value > 50) AS kleene FROM events""")
def fn_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    m = of_table(events)
    click, view, large = m["event_type"].eq(s("click")), call("nullif", m["event_type"], s("error")).eq(s("view")), m["value"] > lit(50.0)
    return computed(events, "event_id", both=click & large, either=click | view, neither=~view, kleene=view & large)


@query("""SELECT p_partkey, p_name AS trimmed, p_name || chr(9) || ' ' AS ltrimmed, '  ' || chr(160) || p_name AS rtrimmed FROM part""")
def fn_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumns({"padded": F.concat(F.lit("  \u00a0"), "p_name", F.lit("\t ")), "left": F.concat(F.lit(" \n"), "p_name", F.lit("\t ")), "right": F.concat(F.lit("  \u00a0"), "p_name", F.lit("\u2003"))})
    m = of_table(part)
    return computed(part, "p_partkey", trimmed=call("trim", m["padded"]), ltrimmed=call("ltrim", m["left"]), rtrimmed=call("rtrim", m["right"]))


@query(r"""SELECT l_orderkey, l_linenumber, regexp_replace(l_extendedprice::VARCHAR, '\.0$', '') AS price, l_quantity::BIGINT::VARCHAR || '00000000000000000000' AS large, TRUE AS back, FALSE AS exponent FROM lineitem""")
def fn_cast_float_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    m = of_table(lines)
    tiny = m["l_extendedprice"] * lit(1e-17)
    text = cast(tiny, "STRING")
    return computed(lines, "l_orderkey", "l_linenumber", price=cast(m["l_extendedprice"], "STRING"), large=cast(m["l_quantity"] * lit(1e20), "STRING"), back=cast(text, "F64").eq(tiny), exponent=call("contains", text, s("E")))


@query("""SELECT event_id, 'ok' AS lane, contains(event_type, 'c') AS found, NULL AS error_code, NULL AS error_operation FROM events WHERE event_id % 5 <> 0
UNION ALL SELECT event_id, 'error', NULL, 'invalid_argument', 'regexp_like' FROM events WHERE event_id % 5 = 0""")
def regex_error_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern for each row, some of them no patterns."""
    events = table(spark, sf_dir, "events").withColumn("pattern", F.when(F.col("event_id") % 5 == 0, "c(").otherwise("[c]"))
    route = Route(
        schema(event_id="I64", lane="STRING", found="BOOL?", error_code="STRING?", error_operation="STRING?"),
        inherit=("event_id",),
        set=(("lane", lambda m: s("ok")), ("found", lambda m: call("regexp_like", m["event_type"], m["pattern"]))),
        errors=(("event_id", lambda m: m["event_id"]), ("lane", lambda m: s("error")), ("found", lambda m: m["partial_found"]), ("error_code", lambda m: m["error_code"]), ("error_operation", lambda m: m["error_operation"])),
    )
    out = nodes.junction([(events, None)], {"out": route})["out"]
    return out.rows.unionByName(out.errors)


@query("""SELECT o_orderkey, upper(c_mktsegment) AS segment, coalesce(c_mktsegment, 'none') || ':' || o_orderstatus AS tag FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) ON o_custkey = c_custkey WHERE coalesce(c_mktsegment, 'none') <> 'BUILDING'""")
def lookup_in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash map read by the expressions of a route."""
    customers = table(spark, sf_dir, "customer").filter("c_nationkey < 20").select("c_custkey", "c_mktsegment")
    segment = lambda m: looked_up(customers, "c_custkey", m["o_custkey"], "c_mktsegment", "c_custkey")
    route = Route(
        schema(o_orderkey="I64", segment="STRING?", tag="STRING"),
        inherit=("o_orderkey",),
        set=(("segment", lambda m: call("upper", segment(m))), ("tag", lambda m: call("concat", call("coalesce", segment(m), s("none")), s(":"), m["o_orderstatus"]))),
        where=lambda m: ~call("starts_with", m["tag"], s("BUILDING:")),
    )
    return nodes.junction([(table(spark, sf_dir, "orders"), None)], {"out": route})["out"].rows


@query("""SELECT o_orderkey, o_orderstatus AS first_value, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus || ',' || o_orderkey ELSE o_orderstatus END AS all_values, NULL AS none FROM orders""")
def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("second", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string")))
    sent = connectors.write_header(connectors.write_header(orders, "status", "o_orderstatus"), "status", "second")
    kept = sent.withColumn("headers", F.filter("headers", lambda h: h["value"].isNotNull()))
    every = call("read_headers", s("status"))
    return computed(kept, "o_orderkey", first_value=call("read_header", s("status")), all_values=Expr(F.array_join(every.value, ","), "STRING"), none=call("read_header", s("other")))


@query("""SELECT event_id, event_id % 4 <> 0 AS good, CASE WHEN event_id % 4 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 4 <> 0 AND event_id % 3 <> 0 THEN event_type END AS kind FROM events""")
def xml_codec_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown element, text for a number, and what isn't well formed go to errors."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    kind = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("<kind>"), "event_type", F.lit("</kind>")))
    good = F.concat(F.lit("<row><user_id>"), F.col("user_id").cast("string"), F.lit("</user_id>"), kind, F.lit("</row>"))
    bad = F.element_at(F.array(F.lit("<row><user_id>1</user_id><more>1</more></row>"), F.lit("<row><user_id>x1</user_id></row>"), F.lit("<row><user_id>1</row>")), (F.col("event_id") % 3 + 1).cast("int"))
    raw = events.select("event_id", F.when(F.col("event_id") % 4 == 0, bad).otherwise(good).alias("raw"))
    out = codecs.decode_xml(raw, "raw", schema(user_id="I64", kind="STRING?"))
    failed = out.errors.select("event_id", F.lit(False).alias("good"), F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("kind"))
    return out.rows.select("event_id", F.lit(True).alias("good"), "user_id", "kind").unionByName(failed)


@query("""SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN 'refused' WHEN least(off, 3600000000 - off) <= 900000000 THEN 'taken' ELSE 'refused' END AS lane,
CASE WHEN event_id % 7 <> 0 AND least(off, 3600000000 - off) <= 900000000 THEN epoch_us(ts) // 1000000 END AS low FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) % 3600000000 AS off FROM events WHERE event_type <> 'view')
WHERE event_id % 7 = 0 OR event_type <> 'click' OR NOT least(off, 3600000000 - off) <= 900000000""")
def ingest_paced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads with their own time in a paced domain; clicks are filtered out. Refused are bad payloads and rows too far from a tick."""
    events = table(spark, sf_dir, "events").filter("event_type <> 'view'")
    body = F.struct("event_id", "user_id", F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"))
    sent = events.select("event_id", "user_id", F.when(F.col("event_id") % 7 == 0, "{").otherwise(F.to_json(body)).alias("payload")).withColumnsRenamed({"event_id": "id", "user_id": "user"})
    route = Route(schema(event_id="I64", user_id="I64"), inherit="all")
    fields = schema(event_id="I64", user_id="I64", kind="STRING", at="DATETIME")
    out, refused = connectors.ingest(sent, "payload", fields, {"out": route}, "at", where=lambda m: m["kind"].ne(s("click")), pace=(F.lit("2024-01-01").cast("timestamp"), 3600, 900))
    taken = out["out"].rows.select("event_id", "user_id", F.lit("taken").alias("lane"), F.unix_seconds("_wm_low").alias("low"))
    return taken.unionByName(refused.select(F.col("id").alias("event_id"), F.col("user").alias("user_id"), F.lit("refused").alias("lane"), F.lit(None).cast("long").alias("low")))


@query("""SELECT event_id, event_id AS one, user_id AS two FROM events WHERE event_id % 4 = 0""")
def json_codec_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARRAY<I64,2>: other lengths, and elements of other types, are errors."""
    made = lambda *parts: F.concat(F.lit('{"pair":['), *parts, F.lit("]}"))
    a, b = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, made(a, F.lit(","), b)).when(k == 1, made(a, F.lit(","), b, F.lit(",1"))).when(k == 2, made(a, F.lit(',"'), b, F.lit('"'))).otherwise(made(a))
    return codecs.decode_json(table(spark, sf_dir, "events").withColumn("raw", raw), "raw", schema(pair="ARRAY<I64,2>")).rows.select("event_id", F.get("pair", 0).alias("one"), F.get("pair", 1).alias("two"))


@query("""SELECT o_orderkey AS "key", o_orderstatus || ':' || o_totalprice::VARCHAR IS NOT NULL AS there, o_orderstatus || ':' || regexp_replace(o_totalprice::VARCHAR, '[.]0$', '') AS label, CASE WHEN o_totalprice > 100000 THEN 'large' END AS size_class FROM orders""")
def emitter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VALUES: an independent mapping of output columns."""
    orders = table(spark, sf_dir, "orders")
    m = of_table(orders)
    text = call("concat", m["o_orderstatus"], s(":"), cast(m["o_totalprice"], "STRING"))
    return computed(orders, **{"key": m["o_orderkey"], "there": ~call("is_null", text), "label": text, "size_class": case((m["o_totalprice"] > lit(100000.0), s("large")))})
