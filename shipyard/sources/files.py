"""Sources and sinks: messages (batch or stream), catalog extracts, snapshots, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table of a directory (``<dir>/<name>.parquet``)."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def read_messages(spark: SparkSession, path: str, streaming: bool = False,
                  fmt: str = "json", max_files_per_trigger: int | None = None) -> DataFrame:
    """Command messages (headers + body) from files; rows without client id are ignored.

    Streaming uses the file source with the explicit schema (a Kafka source plugs in
    the same way in a deployment); ``max_files_per_trigger`` bounds a micro-batch.
    """
    if streaming:
        reader = spark.readStream.schema(S.MESSAGE_SCHEMA).format(fmt)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        df = reader.load(path)
    else:
        df = spark.read.schema(S.MESSAGE_SCHEMA).format(fmt).load(path)
    return df.where(F.col("client_id").isNotNull())


def read_catalog(spark: SparkSession, directory: str, tables: list[str]) -> dict[str, DataFrame]:
    """S3: catalog extracts, one parquet table each (``client_id``, ``environment`` lead)."""
    return {t: read_table(spark, directory, t) for t in tables}


def read_catalog_jdbc(spark: SparkSession, url: str, table: str, properties: dict) -> DataFrame:
    """S3 against a live catalog: Spark's own JDBC source (credentials come from ``properties``)."""
    return spark.read.jdbc(url, table, properties=properties)


def _commits(path: str) -> str:
    return f"{path.rstrip('/')}_commits"


#: A commit: this client's environment is whole in this generation.
COMMIT_SCHEMA = "client_id string, environment string, generation long"


def _read_if_there(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """None if the path does not exist; any other failure (an unreadable or schemaless folder) is raised."""
    from pyspark.errors import AnalysisException

    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_snapshot(spark: SparkSession, path: str, environment: str | None = None,
                  before: int | None = None) -> DataFrame | None:
    """The latest committed generation (before ``before``) of each client environment's balancer snapshot.

    Which one that is stands in the commit rows, one per client, environment and generation,
    so the snapshots themselves are not searched, and a generation that is half written (or
    whose writer died) is never read. Partitions are pruned on the environment. None if
    nothing was ever committed at the path.
    """
    commits = _read_if_there(spark, _commits(path), COMMIT_SCHEMA)
    if commits is not None and commits.isEmpty():
        return None
    df = _read_if_there(spark, path)
    if df is None or commits is None:
        return None
    if environment is not None:
        same = F.col("environment") == environment.lower()
        df, commits = df.where(same), commits.where(same)
    if before is not None:
        commits = commits.where(F.col("generation") < before)
    key = ["client_id", "environment"]
    latest = commits.groupBy(*key).agg(F.max("generation").alias("generation"))
    return df.join(latest, [*key, "generation"], "left_semi")


def save_snapshot(topo: DataFrame, path: str, generation: int) -> None:
    """Write a new generation (never overwrite one being read), then commit it.

    ``topo`` carries client_id and environment. Older generations stay readable as
    backups; readers take the latest one. A retry of the same generation replaces the
    partitions it writes. The commit rows are written last.
    """
    write_generation(topo, path, generation)
    write_generation(topo.select("client_id", "environment").distinct(), _commits(path), generation)


def write_generation(rows: DataFrame, path: str, generation: int) -> None:
    """The rows as partitions of (environment, generation); replaces those that it writes."""
    (rows.withColumn("generation", F.lit(generation).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("environment", "generation").parquet(path))


def write_events(events: DataFrame, path: str, batch_id: int | str) -> None:
    """Status and log rows as JSON documents, one per line, under ``batch_id=<id>``.

    A retried batch replaces its own folder.
    """
    (events.select(F.to_json(F.struct(*events.columns)).alias("value"))
     .write.mode("overwrite").text(f"{path.rstrip('/')}/batch_id={batch_id}"))
