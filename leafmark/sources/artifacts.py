"""Artifact folders, JSON lines and paths as sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.operators import review
from leafmark.sources.folders import ArtifactFolders
from leafmark.sources.shared import shuffles_dropped

#: Two traps of old files: codes as a list or as text, and grades as numbers or text. Both are read as text. Keys that are not named here, private
#: ones among them, are dropped.
PARTS = {
    "metadata.json": "submission_id string, original_filename string, byte_size long, created_at string",
    "structured.json": "student_name string, school_name string, grade string, word_count long, doc_type string, format string, extraction_method string",
    "ocr.json": "text string, confidence_avg double, confidence_min double, low_conf_page_count int",
    "validation.json": "needs_review boolean, review_reason_codes string",
}
#: What a folder should hold; either name of the original will do.
ORIGINALS = ("original.pdf", "original.jpg")
REQUIRED = ("metadata.json", "ocr.json", "raw_text.txt", "contact_block.txt", "essay_block.txt", "structured.json", "validation.json")
#: Bytes of a folder that are fewer or more than usual.
LEAST, MOST = 10 * 1024, 2 * 1024 * 1024


def folders(spark: SparkSession, root: str, names: tuple[str, ...] = ()) -> DataFrame:
    """(folder, files) of all artifact folders; contents of files of these names only."""
    spark.dataSource.register(ArtifactFolders)
    return spark.read.format("artifact_folders").option("names", ",".join(names)).load(root)


def write_folders(files: DataFrame, root: str, packed: bool = False, dealt: bool = False) -> None:
    """Files (folder, name, body) under their own names. A folder's files are written by one task.

    packed: into archives of whole folders, which take a fraction of the disk that small files do; such a root is written once. dealt: rows of a folder
    already follow one another in one task, so they need no shuffle.
    """
    spark, rows = files.sparkSession, files.select("folder", "name", "body")
    spark.dataSource.register(ArtifactFolders)
    if not dealt:
        rows = rows.repartition("folder").sortWithinPartitions("folder") if packed else rows.repartition("folder")
    with shuffles_dropped(spark):
        rows.write.format("artifact_folders").option("packed", str(packed).lower()).mode("append").save(root)


def _body(name: str) -> Column:
    """Contents of a folder's file of this name; null if it isn't there."""
    return F.get(F.filter("files", lambda f: f["name"] == name), F.lit(0))["body"]


def _broken(body: Column) -> Column:
    """Whether contents are there that are no JSON."""
    return body.isNotNull() & F.try_parse_json(body).isNull()


def artifact_records(spark: SparkSession, root: str) -> DataFrame:
    """A row for each folder with its status and what its files say.

    skipped: no metadata or no structured fields; error: a file of the four that is no JSON; imported otherwise, with the folder's name for an id
    that isn't given, `unknown` for a file name and 0 words.
    """
    rows = folders(spark, root, tuple(PARTS)).select("folder", *[_body(n).alias(f"__{n[:-5]}") for n in PARTS])
    broken = reduce(lambda a, b: a | b, [_broken(F.col(f"__{n[:-5]}")) for n in PARTS])
    status = F.when(F.col("__metadata").isNull() | (F.col("__structured").isNull() & ~_broken(F.col("__metadata"))), "skipped").when(broken, "error").otherwise("imported")
    parsed = rows.withColumn("status", status).select("folder", "status", *[F.from_json(f"__{n[:-5]}", schema).alias(n[:-5]) for n, schema in PARTS.items()])
    codes = F.regexp_replace(F.regexp_replace("validation.review_reason_codes", r'[\[\]" ]', ""), ",", ";")
    return parsed.select(
        "folder",
        "status",
        F.coalesce(F.nullif("metadata.submission_id", F.lit("")), "folder").alias("submission_id"),
        F.coalesce("metadata.original_filename", F.lit("unknown")).alias("filename"),
        "metadata.byte_size",
        "metadata.created_at",
        *[F.col(f"structured.{c}").alias(c) for c in ("student_name", "school_name", "grade", "doc_type", "format", "extraction_method")],
        F.coalesce("structured.word_count", F.lit(0)).alias("word_count"),
        "ocr.text",
        F.col("ocr.confidence_avg").alias("ocr_confidence_avg"),
        codes.alias("review_reason_codes"),
    )


def import_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """The records of folders that can be imported."""
    return artifact_records(spark, root).where("status = 'imported'").drop("status")


def reviewed_import(spark: SparkSession, root: str, reference: DataFrame) -> DataFrame:
    """Imported records, validated anew; codes that a folder already holds stay. All of them await review."""
    rows = import_artifacts(spark, root).withColumns({"is_chunk": F.lit(False), "is_container_parent": F.lit(False), "doc_class": F.lit(None).cast("string")})
    checked = review.validate(rows.withColumn("doc_type", F.coalesce("doc_type", F.lit("unknown"))), reference)
    return checked.withColumn("review_reason_codes", F.coalesce(F.nullif("review_reason_codes", F.lit("")), "codes")).withColumn("needs_review", F.lit(True))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def pick_paths(spark: SparkSession, root: str, names: tuple[str, ...]) -> DataFrame:
    """Paths below a folder that end with a wanted name, each once. Contents are not read."""
    files = folders(spark, root).select(F.explode("files.path").alias("path"))
    return files.where(reduce(lambda a, b: a | b, [F.endswith("path", F.lit(n)) for n in names])).distinct()


def artifact_health(spark: SparkSession, root: str, names: tuple[str, ...] = REQUIRED, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Of each folder: files, bytes, names that are missing, JSON files that are none, empty files, whether its size is unusual, and whether it is healthy.

    Names are joined in order. An unusual size alone doesn't make a folder unhealthy.
    """
    have = folders(spark, root, tuple(PARTS)).withColumn("have", F.transform("files", lambda f: f["name"]))
    original = F.when(~F.arrays_overlap("have", F.array(*map(F.lit, ORIGINALS))), F.lit("/".join(ORIGINALS))) if names == REQUIRED else F.lit(None)
    missing = F.array_compact(F.array(original, *[F.when(~F.array_contains("have", n), n) for n in names]))
    corrupted = F.array_compact(F.array(*[F.when(_broken(_body(n)), n) for n in sorted(PARTS)]))
    empty = F.transform(F.filter("files", lambda f: f["size"] == 0), lambda f: f["name"])
    size = F.aggregate("files", F.lit(0).cast("long"), lambda total, f: total + f["size"])
    found = have.select("folder", F.size("files").cast("long").alias("files"), size.alias("bytes"), *[F.array_join(c, ",").alias(n) for n, c in (("missing", missing), ("corrupted", corrupted), ("empty", empty))])
    odd = F.when(F.col("bytes") < least, "small").when(F.col("bytes") > most, "large")
    return found.withColumn("odd_size", odd).withColumn("healthy", (F.col("missing") == "") & (F.col("corrupted") == "") & (F.col("empty") == ""))


def health_summary(health: DataFrame) -> DataFrame:
    """Totals over folders: how many, healthy ones, bytes, and those with each kind of fault."""
    kinds = [F.count_if(F.col(c) != "").alias(c) for c in ("missing", "corrupted", "empty")]
    return health.agg(F.count("*").alias("folders"), F.count_if("healthy").alias("healthy"), F.sum("bytes").alias("bytes"), *kinds, F.count("odd_size").alias("odd_size"))


def read_logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Log lines with their service, which is the file's name; a table or a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[a-z]+)?$", 1).alias("service"), F.col("value").alias("line"))
