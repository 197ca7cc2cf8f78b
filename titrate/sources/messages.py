"""Message and file sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clip
from ..operators.tabular import lines, text_of
from ..schemas import RAW_MESSAGES

MAX_FILE_BYTES = 20 * 1024 * 1024


def raw_messages(spark: SparkSession, path: str) -> DataFrame:
    """Envelope rows."""
    return spark.read.schema(RAW_MESSAGES).parquet(path)


def raw_messages_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A01, streaming."""
    return spark.readStream.schema(RAW_MESSAGES).option("maxFilesPerTrigger", max_files).parquet(path)


def directory_files(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """Files of a directory whose names match; dotfiles left out; an absent directory has no files."""
    return _named(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("ignoreMissingFiles", "true")
                  .option("recursiveFileLookup", "false").load(directory))


def directory_stream(spark: SparkSession, directory: str, glob: str = "*", max_files: int = 1000) -> DataFrame:
    """Continuous intake; the checkpoint remembers what was seen, files are never moved."""
    stream = (
        spark.readStream.format("binaryFile").schema(
            "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY")
        .option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(directory)
    )
    return _named(stream)


def _named(files: DataFrame) -> DataFrame:
    name = F.substring_index("path", "/", -1)
    return files.withColumn("name", name).filter(~F.col("name").startswith(".")).select(
        "path", "name", "length", F.col("modificationTime").alias("modified_at"), "content")


def claimed(files: DataFrame, registrations: DataFrame) -> DataFrame:
    """Files of registered directories; a registration whose directory holds nothing yet yields no rows."""
    parent = F.regexp_replace("path", r"/[^/]*\z", "")
    return files.withColumn("directory", parent).join(registrations, "directory")


def within_size(files: DataFrame, limit: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(readable, parked). The length test stands before anything touches the content column."""
    return files.filter(F.col("length") <= limit), files.filter(F.col("length") > limit).drop("content")


def within_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """A10: files below an allowed root. Every ancestor directory of a path is a join key, so no prefix scan of all
    roots is needed; the depth of a path is small."""
    depth = F.size(F.split("path", "/"))
    ancestors = F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    hits = (
        files.select("path").distinct().withColumn("root", F.explode(ancestors))
        .join(roots.select(F.regexp_replace("root", r"/+\z", "").alias("root")).distinct(), "root", "left_semi")
        .select("path").distinct()
    )
    return files.join(hits, "path", "left_semi")


def text_lines(files: DataFrame) -> DataFrame:
    """Numbered lines of each text file."""
    return files.select("path", F.posexplode(lines(text_of(F.col("content")))).alias("line_no", "line"))


def documents_table(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents below a path, one per file."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def catalog(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that parse to an object, set-aside documents with a reason)."""
    body = F.col("body")
    parsed = F.try_parse_json(body)
    reason = F.when(parsed.isNull(), "unreadable").when(~clip(body).startswith("{"), "not_an_object")
    rows = documents.withColumn("reason", reason)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL").drop("body")


def profile_rows(documents: DataFrame, default_revision: Column | int = 1) -> DataFrame:
    """Pin columns of profile documents."""
    revision = F.lit(default_revision) if isinstance(default_revision, int) else default_revision
    catalog_revision = F.get_json_object("body", "$.catalog.revision").try_cast("int")
    return documents.select(
        F.get_json_object("body", "$.profileMeta.id").alias("profile_id"),
        F.coalesce(catalog_revision, revision).alias("revision"),
        F.get_json_object("body", "$.profileMeta.displayName").alias("display_name"), "body")


def connection_rows(documents: DataFrame) -> DataFrame:
    """Saved connections."""
    get = lambda p: F.get_json_object("body", p)
    return documents.select(
        get("$.connectionId").alias("connection_id"), get("$.clientAnalyzerId").alias("analyzer_id"),
        get("$.displayName").alias("display_name"), get("$.profileRef.profileId").alias("profile_id"),
        get("$.profileRef.revision").try_cast("int").alias("revision"),
        get("$.configRevision").try_cast("int").alias("config_revision"),
        F.from_json(get("$.values"), "map<string,string>").alias("values"))
