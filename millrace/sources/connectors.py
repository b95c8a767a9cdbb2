"""Sources and sinks by Spark's own formats; those whose jars aren't here work where they are."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.expr import Expr, SchemaError
from millrace.operators import nodes
from millrace.operators.route import Field, Message, Route, Routed
from millrace.sources.codecs import decode_json

#: Kind of source or sink -> Spark's format name.
FORMATS = {"kafka": "kafka", "pulsar": "pulsar", "parquet": "parquet", "json": "json", "text": "text", "rate": "rate", "socket": "socket", "iceberg": "iceberg", "jdbc": "jdbc", "mongodb": "mongodb", "avro": "avro"}


def source(spark: SparkSession, kind: str, options: Mapping[str, str], schema: str | None = None, stream: bool = False) -> DataFrame:
    """A table or stream. Kafka rows come with value as text and headers as an array of key and value."""
    reader = (spark.readStream if stream else spark.read).format(FORMATS[kind]).options(**({"includeHeaders": "true"} | dict(options) if kind == "kafka" else options))
    df = (reader.schema(schema) if schema else reader).load()
    if kind == "kafka":
        headers = F.transform("headers", lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value")))
        df = df.withColumns({"value": F.col("value").cast("string"), "key": F.col("key").cast("string"), "headers": headers})
    return df


def sink(df: DataFrame, kind: str, options: Mapping[str, str], mode: str = "append") -> None:
    """Append a table. For Kafka the columns are key, value, topic and headers."""
    df.write.format(FORMATS[kind]).options(**options).mode(mode).save()


def ingest(
    df: DataFrame, payload: str, fields: Mapping[str, Field], routes: Mapping[str, Route], timestamp: str | None = None, where: Callable[[Message], Expr] | None = None, strict: bool = True, decode: Callable[..., Routed] = decode_json, pace: tuple[Column, int, float] | None = None
) -> tuple[dict[str, Routed], DataFrame]:
    """An ingestor: decode payloads, give each row its watermarks, filter, and send it to the routes. Gives the routes and the rows that were refused.

    Watermarks (_wm_low and _wm_high, which the routes keep) are a DATETIME field, or the time of the batch. Refused are payloads that can't be decoded, rows whose
    timestamp is null, and with a pace (start, period in seconds, skew in seconds) those too far from every tick of that clock, which needs a timestamp of its own."""
    if timestamp is not None and fields[timestamp].type != "DATETIME":
        raise SchemaError(f"{timestamp} is no DATETIME")
    if pace is not None and timestamp is None:
        raise SchemaError("a paced domain takes its time from a field")
    decoded = decode(df, payload, fields, strict)
    at = F.current_timestamp() if timestamp is None else F.col(timestamp)
    marked = decoded.rows.withColumns({"_wm_low": at, "_wm_high": at})
    marked = marked.withColumn("__taken", F.col("_wm_low").isNotNull())
    if pace is not None:
        marked = nodes.admitted(marked, "_wm_low", *pace).withColumn("__taken", F.coalesce(F.col("__taken") & F.col("admitted"), F.lit(False))).drop("admitted")
    rest = [c for c in df.columns if c in marked.columns]
    refused = decoded.errors.select(rest).unionByName(marked.filter("NOT __taken").select(rest))
    taken = marked.filter("__taken").drop("__taken")
    return nodes.junction([(taken, None)], routes, where, keep=("_wm_low", "_wm_high")), refused


def write_header(df: DataFrame, name: str, value: str) -> DataFrame:
    """Stage a header: value is a column's name."""
    entry = F.array(F.struct(F.lit(name).alias("key"), F.col(value).cast("string").alias("value")))
    return df.withColumn("headers", F.concat("headers", entry) if "headers" in df.columns else entry)


def jdbc_upsert(df: DataFrame, connect: Callable[[], object], table: str, target: Sequence[str], update: bool = True, batch: int = 1000) -> None:
    """INSERT … ON CONFLICT by the connection that connect() opens in each task, in batches; running a task twice changes nothing more."""
    columns = df.columns
    marks, names = ", ".join(["%s"] * len(columns)), ", ".join(columns)
    rest = [c for c in columns if c not in target]
    action = f"DO UPDATE SET {', '.join(f'{c} = EXCLUDED.{c}' for c in rest)}" if update and rest else "DO NOTHING"
    statement = f"INSERT INTO {table} ({names}) VALUES ({marks}) ON CONFLICT ({', '.join(target)}) {action}"

    def put(rows) -> None:
        link = connect()
        cursor, waiting = link.cursor(), []
        for row in rows:
            waiting.append(tuple(row))
            if len(waiting) >= batch:
                cursor.executemany(statement, waiting)
                waiting = []
        if waiting:
            cursor.executemany(statement, waiting)
        link.commit()
        link.close()

    df.foreachPartition(put)
