"""Reading and writing the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from turnsift import schema as S
from turnsift.functions.text import safe_session_id, strip
from turnsift.operators.durable import written


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table with its declared schema. An unreadable file is an error: events that are
    silently missing would make every signal, chain and report on top wrong."""
    return spark.read.schema(schema).option("mergeSchema", "true").parquet(path)


def read_listing(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows of the readable files, paths of files that gave no row) for an overview that
    has to come up although a file is broken."""
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").load(path).select("path")
    )
    seen = rows.select(F.col("_metadata.file_path").alias("path")).distinct()

    def plain(column):  # one slash or three after the scheme
        return F.regexp_replace(column, "^file:/+", "file:/")

    skipped = files.withColumn("_path", plain("path")).join(
        seen.select(plain("path").alias("_path")), "_path", "left_anti"
    )
    return rows, skipped.select("path")


def session_events(events: DataFrame, session_ids: list[str]) -> DataFrame:
    """Events of the named sessions in turn order; the filter reaches the scan."""
    return events.filter(F.col("session_id").isin(session_ids)).orderBy(
        "session_id", "turn_index", "timestamp", "event_id"
    )


def session_signals(signals: DataFrame, session_ids: list[str]) -> DataFrame:
    return signals.filter(F.col("session_id").isin(session_ids)).orderBy(
        "session_id", "turn_index", "stage", "msg_index"
    )


def wanted_rows(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the sessions in ``wanted`` (session_id), any number of them. On a table from
    ``write_bucketed`` only the ids move, never the rows."""
    return table.join(wanted.select("session_id").distinct(), "session_id", "left_semi").select(*table.columns)


def write_bucketed(rows: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """The rows as table ``name`` at ``path``, dealt and sorted by session, for lookups and joins by
    session. A session's rows share a bucket, so take enough buckets for a task to hold the largest ones,
    and no fewer than shuffle partitions: Spark shuffles a table of fewer buckets after all."""
    (
        rows.repartition(buckets, "session_id")
        .write.mode("overwrite").format("parquet").option("path", path)
        .bucketBy(buckets, "session_id").sortBy("session_id").saveAsTable(name)
    )
    return rows.sparkSession.table(name)


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by date. Range partitioning keeps files even when one day or session is
    large, and clusters sessions so that a session filter skips row groups."""
    dated = events.withColumn("event_date", F.to_date("timestamp"))
    (
        dated.repartitionByRange("event_date", "session_id", "turn_index")
        .sortWithinPartitions("event_date", "session_id", "turn_index")
        .write.mode(mode)
        .partitionBy("event_date")
        .parquet(path)
    )


def purge_stored(spark: SparkSession, path: str, session_ids: DataFrame, partition: str = "event_date") -> None:
    """Delete sessions from a partitioned table by rewriting only the partitions that hold them.

    Their values are looked up first (one per partition of the table at most), so only those are read
    in full; what stays of them is stored apart before it replaces them, and a partition of which
    nothing stays is removed. Files of other partitions are not touched.
    """
    table = spark.read.parquet(path)
    gone = session_ids.select("session_id").distinct()
    touched = [r[0] for r in table.join(gone, "session_id", "left_semi").select(partition).distinct().collect()]
    if not touched:
        return
    named = [value for value in touched if value is not None]
    mine = F.col(partition).isin(named) if named else F.lit(False)
    if None in touched:
        mine = mine | F.col(partition).isNull()
    rest = written(table.filter(mine).join(gone, "session_id", "left_anti").select(*table.columns), "purge-rest")
    (
        rest.repartitionByRange(partition, "session_id").sortWithinPartitions(partition, "session_id")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    )
    left = {r[0] for r in rest.select(partition).distinct().collect()}
    for value in touched:
        if value not in left:
            name = "__HIVE_DEFAULT_PARTITION__" if value is None else value
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={name}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_signals(signals: DataFrame, path: str, mode: str = "append") -> None:
    wide = signals
    if "campaign_match" not in signals.columns:
        empty = F.lit(None).cast(S.CAMPAIGN_MATCH.simpleString())
        wide = signals.withColumn("campaign_match", empty)
    wide.select(*S.SIGNALS.fieldNames()).write.mode(mode).parquet(path)


def export_json(events: DataFrame, path: str) -> None:
    """One JSON object per line, nulls kept."""
    events.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def decode_payloads(rows: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(events, rejects) from JSON payloads; malformed ones keep their text."""
    schema = StructType([*S.TRACE_EVENTS.fields, StructField("_bad", StringType())])
    parsed = rows.withColumn(
        "_event",
        F.from_json(payload, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}),
    )
    broken = F.col("_event").isNull() | F.col("_event._bad").isNotNull()
    good = parsed.filter(~broken).select("_event.*").drop("_bad")
    return good, parsed.filter(broken).select(payload)


def with_safe_session_id(df: DataFrame, column: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """(rows with a sanitised id, rows whose id is empty or missing)."""
    named = df.withColumn("_safe", safe_session_id(F.col(column)))
    empty = F.coalesce(F.col("_safe"), F.lit("")) == ""
    good = named.filter(~empty).withColumn(column, F.col("_safe")).drop("_safe")
    return good, named.filter(empty).drop("_safe")


def load_payloads(corpus: DataFrame, key: str, text: str, limit: int | None = None) -> DataFrame:
    """Payload corpus without blank rows, optionally the first ``limit`` rows by key."""
    chosen = corpus if limit is None else corpus.orderBy(key).limit(limit)
    trimmed = chosen.withColumn(text, strip(F.coalesce(text, F.lit(""))))
    return trimmed.filter(F.col(text) != "")


def class_counts(labelled: DataFrame, label: str = "label") -> DataFrame:
    return labelled.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(label) == 1).alias("injections"),
        F.count_if(F.col(label) == 0).alias("benign"),
    )
