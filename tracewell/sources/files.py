"""Files as documents: uploads, deduplicated by content, with ids that tell both name and content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

#: Extensions that are read, by media type.
SUPPORTED = {"pdf": "pdf", "docx": "word", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image"}


#: Files whose paths are broadcast; more are joined by shuffling.
MOST_BROADCAST = 1_000_000


def read_uploads(spark: SparkSession, path: str, max_bytes: int = 200 << 20) -> DataFrame:
    """doc_id, filename, sha256, size_bytes, media_type, uploaded_at and content of each distinct file under path.

    Files of other kinds are left out by their names and larger ones by their lengths, before their bytes are read. Of equal files
    the first stays: files are hashed where they are read, only hashes and paths are compared, and then the chosen files are read."""
    either = ",".join("".join(f"[{c}{c.upper()}]" for c in ext) for ext in SUPPORTED)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{either}}}").load(path).where(F.col("length") <= max_bytes)
    kinds = F.create_map(*[F.lit(x) for kv in SUPPORTED.items() for x in kv])
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    filename = C.safe_filename(F.element_at(F.split("path", "/"), -1))
    hashed = files.select("path", filename.alias("filename"), "modificationTime", F.sha2("content", 256).alias("sha256"))
    first = hashed.groupBy("sha256").agg(F.min(F.struct("modificationTime", "filename", "path")).alias("f")).select("sha256", "f.path")
    small = first.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    one = files.join(F.broadcast(first) if small else first, "path").withColumns({"filename": filename, "ext": ext})
    stem = F.substring(F.regexp_replace("filename", r"\.[A-Za-z]+$", ""), 1, 60)
    return one.select(
        F.concat(stem, F.lit("__"), F.substring("sha256", 1, 8)).alias("doc_id"), "filename", "sha256", F.col("length").alias("size_bytes"),
        F.try_element_at(kinds, F.col("ext")).alias("media_type"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("uploaded_at"), "content",
    )


def write_transcripts(pages: DataFrame, path: str) -> None:
    """A text file for each document of pages (doc_id, page_num, text)."""
    from ..operators.corpus import transcripts

    transcripts(pages).select("doc_id", F.col("transcript").alias("value")).write.partitionBy("doc_id").mode("overwrite").text(path)
