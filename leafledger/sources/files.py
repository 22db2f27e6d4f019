"""Files of the store: log segments, cold documents, snapshots.

Everything is written by Spark to a new folder and becomes visible by a small pointer
file that is renamed into place, so readers see all of a commit or nothing.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.changelog import format_line, parse_lines


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where that is unset and the session is of this machine alone, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not checkpoint.isDefined():
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafledger-"))
            checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = checkpoint.get()
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def kept(spark: SparkSession, df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written to the working folder and read again, which cuts its lineage; with ``folder``, after the rows that it has."""
    folder = folder or work_dir(spark)
    df.write.mode("append").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def read_text_file(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under a temporary name and rename it over ``path``."""
    fs, p = _fs(spark, path)
    _, temp = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(temp, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(fs.makeQualified(temp), fs.makeQualified(p), options)


def write_segments(log: DataFrame, folder: str, lines_per_file: int = 100_000) -> None:
    """Write entries (line, ts, pointer, json) as text segments in order of ``line``."""
    text = log.select("line", format_line(F.col("ts"), F.col("pointer"), F.col("json")).alias("value"))
    text.orderBy("line").select("value").write.option("maxRecordsPerFile", lines_per_file).mode("errorifexists").text(folder)


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed entries with (file, place in the file): ``line`` counts within a segment file.

    Numbers come from the files' own order: the position of a line in its file, by a
    split-free read (one task for each segment, whose size is bounded when it is written).
    """
    lines = spark.read.option("wholetext", True).text(folder).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "value"))
    rows = lines.where("value <> ''").withColumn("line", (F.col("at") + 1).cast("long")).select("file", "line", "value")
    return parse_lines(rows)


def write_cold(docs: DataFrame, folder: str) -> None:
    """Documents (key, type, body) as a table partitioned by type."""
    docs.write.mode("overwrite").partitionBy("type").parquet(folder)


def read_cold(spark: SparkSession, folder: str, type_: str | None = None, key: str | None = None) -> DataFrame:
    """All documents, those of a type (only its partition is read), or one."""
    df = spark.read.schema("key string, body string, type string").parquet(folder)
    if type_ is not None:
        df = df.where(F.col("type") == type_)
    return df if key is None else df.where(F.col("key") == key)


def list_cold(spark: SparkSession, folder: str) -> DataFrame:
    """(key, type, file) without reading bodies."""
    return spark.read.schema("key string, type string").parquet(folder).select("key", "type", F.col("_metadata.file_name").alias("file"))


def cold_folder(folder: str, key: str) -> str:
    """Where the documents of a key's type stand."""
    return f"{folder}/type={key.partition('_')[0]}"


def exists_cold(spark: SparkSession, folder: str, key: str) -> bool:
    fs, p = _fs(spark, cold_folder(folder, key))
    return fs.exists(p) and not read_cold(spark, folder, key.partition("_")[0], key).isEmpty()


def delete_cold(spark: SparkSession, folder: str, keys: DataFrame) -> None:
    """Delete documents by key (first column of ``keys``); unknown keys are ignored.

    The types that are touched are written anew beside the old files, which go only when
    the new ones stand.
    """
    gone = keys.select(F.col(keys.columns[0]).alias("key")).distinct()
    types = [r[0] for r in gone.select(F.substring_index("key", "_", 1)).distinct().collect()]  # a row for each type
    for code in types:
        fs, old = _fs(spark, f"{folder}/type={code}")
        if not fs.exists(old):
            continue
        rest = read_cold(spark, folder, code).join(gone, "key", "left_anti").drop("type")
        own = f"{folder}/_new-{uuid.uuid4().hex}"
        rest.write.parquet(own)
        _, new = _fs(spark, own)
        _, aside = _fs(spark, f"{folder}/_old-{uuid.uuid4().hex}")
        fs.rename(old, aside)
        fs.rename(new, old)
        fs.delete(aside, True)


def write_snapshot(state: DataFrame, folder: str, line: int, sets: DataFrame | None = None) -> str:
    """Write documents (key, value) and set members, and point to them; returns the folder that was written."""
    spark = state.sparkSession
    own = f"{folder}/v-{uuid.uuid4().hex}"
    at = {"version": 2, "line": line, "path": f"{own}/documents"}
    state.select("key", "value").write.parquet(at["path"])
    if sets is not None:
        at["sets"] = f"{own}/sets"
        sets.select("set_name", "member").write.parquet(at["sets"])
    publish(spark, f"{folder}/LATEST", json.dumps(at))
    return own


def read_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, int] | None:
    """(documents, line) of the latest snapshot; None if there is none."""
    text = read_text_file(spark, f"{folder}/LATEST")
    if text is None:
        return None
    at = json.loads(text)
    return spark.read.schema("key string, value string").parquet(at["path"]), at["line"]


def read_snapshot_sets(spark: SparkSession, folder: str) -> tuple[DataFrame, int] | None:
    """(set members, line) of the latest snapshot; None if it has none."""
    text = read_text_file(spark, f"{folder}/LATEST")
    at = json.loads(text) if text else {}
    return (spark.read.schema("set_name string, member string").parquet(at["sets"]), at["line"]) if "sets" in at else None


def snapshot_documents(snapshots: DataFrame, text: str = "value") -> DataFrame:
    """(version, line, key, value) of snapshots that are JSON texts ``{version, walLine, documents}``.

    Documents of version 1 are strings of JSON, those of version 2 are objects; both become JSON text.
    """
    head = F.from_json(text, "version int, walLine long")
    whole = F.from_json(F.get_json_object(text, "$.documents"), "map<string, string>")
    return snapshots.select(F.coalesce(head["version"], F.lit(1)).alias("version"), head["walLine"].alias("line"), F.explode(whole).alias("key", "value"))
