"""Uploads: reading, checking, decoding, storing; idempotent replacement of a document's chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 50 * 1024 * 1024
# Allowed mime types with their labels and extensions.
ALLOWED = {
    "application/pdf": ("PDF Document", [".pdf"]),
    "text/csv": ("CSV Spreadsheet", [".csv"]),
    "text/plain": ("Text File", [".txt"]),
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ("Excel Spreadsheet", [".xlsx"]),
    "application/vnd.ms-excel": ("Excel Spreadsheet", [".xls"]),
    "image/jpeg": ("JPEG Image", [".jpg", ".jpeg"]),
    "image/png": ("PNG Image", [".png"]),
    "image/tiff": ("TIFF Image", [".tiff", ".tif"]),
    "application/json": ("JSON File", [".json"]),
    "text/markdown": ("Markdown Document", [".md"]),
}


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of stored objects."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def extension(name: Column) -> Column:
    """Lower-cased extension with its dot; leading dots of the name do not start one."""
    base = F.regexp_extract(name, r"([^/]*)\z", 1)
    return F.lower(F.regexp_extract(F.regexp_replace(base, r"^\.+", ""), r"[^.](\.[^.]*)\z", 1))


def mime_of(name: Column) -> Column:
    """The mime type that belongs to the name's extension; null if none does."""
    of = {e: m for m, (_, extensions) in ALLOWED.items() for e in extensions}
    pairs = F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
    return F.try_element_at(pairs, extension(name))


def validate_uploads(manifest: DataFrame) -> DataFrame:
    """(filename, mime_type, size_bytes) + reject_code; the first rule that fails counts, null is accepted. Extension and type are tested
    independently of each other."""
    extensions = sorted({e for _, es in ALLOWED.values() for e in es})
    name = F.col("filename")
    bad_name = F.contains(name, F.lit("..")) | name.rlike(r"[/\\\x00]") | (F.length(name) > 255)
    code = (F.when(F.col("size_bytes") > MAX_BYTES, "FILE_TOO_LARGE").when(~extension(name).isin(extensions), "UNSUPPORTED_FILE_TYPE")
            .when(~F.col("mime_type").isin(list(ALLOWED)), "UNSUPPORTED_FILE_TYPE").when(bad_name, "INVALID_FILENAME"))
    return manifest.withColumn("reject_code", code)


def sanitize_filename(name: Column) -> Column:
    """Base name with spaces as underscores and nothing but word characters and hyphens, cut to 100 with its extension."""
    base, ext = F.regexp_extract(name, r"([^/]*)\z", 1), extension(name)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    clean = F.regexp_replace(F.replace(stem, F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_\-]", "")
    return F.concat(F.substring(clean, F.lit(1), F.greatest(100 - F.length(ext), F.lit(0))), ext)


def classify_mime(mime: Column) -> Column:
    """struct(label, category, class)."""
    from skerry.operators.catalog import display_class
    from skerry.operators.search import CATEGORIES

    label, category = F.lit("Unknown File Type"), F.lit(None).cast("string")
    for m, (text, _) in ALLOWED.items():
        label = F.when(mime == m, text).otherwise(label)
    for c, ms in CATEGORIES.items():
        category = F.when(mime.isin(ms), c).otherwise(category)
    return F.struct(label.alias("label"), category.alias("category"), display_class(mime).alias("class"))


def write_by_owner_month(uploads: DataFrame, path: str, user: str = "uploaded_by", at: str = "created_at") -> None:
    """Partition folders by user, year and month, so that reads of one user's month skip the rest."""
    parts = uploads.withColumns({"user_id": F.col(user), "year": F.year(at), "month": F.month(at)})
    parts.repartition("user_id", "year", "month").write.mode("append").partitionBy("user_id", "year", "month").parquet(path)


#: Bytes that are looked at to tell UTF-16 without a mark from other encodings.
SAMPLE = 4096


def _sampled_pairs(content: Column) -> Column:
    """Hexadecimal byte pairs from the start of the content, four digits each."""
    return F.regexp_extract_all(F.hex(F.substring(content, 1, SAMPLE)), F.lit("[0-9A-F]{4}"), F.lit(0))


def unmarked_utf16(content: Column) -> Column:
    """"utf-16le" or "utf-16be" for UTF-16 text without a byte order mark, else null. Of the byte pairs at the start, in the order that
    is tested: at least 40 % must have a zero high byte and no more than 10 % a zero low byte (texts that are mostly in Latin
    letters), no pair may be NUL, and each high surrogate must come before a low one and each low one after a high one. The
    content has an even number of bytes."""
    pairs = _sampled_pairs(content)
    n = F.size(pairs)
    even = (F.octet_length(content) > 0) & (F.octet_length(content) % 2 == 0)

    def fits(high: int, low: int) -> Column:
        at = lambda p, k: F.substring(p, 2 * k + 1, 2)
        zero_high = F.size(F.filter(pairs, lambda p: at(p, high) == "00"))
        zero_low = F.size(F.filter(pairs, lambda p: at(p, low) == "00"))
        kinds = F.array_join(F.transform(pairs, lambda p: F.when(at(p, high).between("D8", "DB"), "h").when(at(p, high).between("DC", "DF"), "l").otherwise(".")), "")
        sound = ~F.regexp_replace(kinds, "hl", "").rlike("l|h.") & ~F.array_contains(pairs, "0000")  # a last h may have its partner beyond the sample
        return even & (n > 0) & (zero_high >= 0.4 * n) & (zero_low <= 0.1 * n) & sound

    # no pair needs a look where there is no zero byte
    return F.when(F.contains(F.substring(content, 1, SAMPLE), F.lit(b"\x00")), F.when(fits(1, 0), "utf-16le").when(fits(0, 1), "utf-16be"))


def decode_corpus(uploads: DataFrame, *keep: str) -> DataFrame:
    """(path, content) -> (path, text, encoding, and the columns to keep): by byte order mark, else UTF-16 without a mark by its zero bytes,
    else UTF-8 if valid, else latin-1, which always succeeds."""
    head = F.hex(F.substring("content", 1, 3))
    bare = unmarked_utf16(F.col("content"))
    enc = (F.when(head == "EFBBBF", "utf-8-sig").when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be").when(bare.isNotNull(), F.concat(bare, F.lit("-bare")))
           .when(F.is_valid_utf8(F.col("content").cast("string")), "utf-8").otherwise("latin-1"))
    body = {"utf-8-sig": F.decode(F.expr("substring(content, 4)"), "UTF-8"), "utf-16le": F.decode(F.expr("substring(content, 3)"), "UTF-16LE"),
            "utf-16be": F.decode(F.expr("substring(content, 3)"), "UTF-16BE"), "utf-16le-bare": F.decode("content", "UTF-16LE"), "utf-16be-bare": F.decode("content", "UTF-16BE"),
            "utf-8": F.col("content").cast("string")}
    text = F.decode("content", "ISO-8859-1")
    for name, value in body.items():
        text = F.when(F.col("encoding") == name, value).otherwise(text)
    out = uploads.withColumn("encoding", enc).withColumn("text", text)
    return out.select("path", "text", F.regexp_replace("encoding", "-bare$", "").alias("encoding"), *keep)


def encoding_counts(decoded: DataFrame) -> DataFrame:
    return decoded.groupBy("encoding").agg(F.count(F.lit(1)).alias("files"))


def replace_document_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents in ``new`` lose their old chunks and get the new ones; running it again changes nothing."""
    return old.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)


def append_audit(documents: DataFrame, action: str, as_of: str) -> DataFrame:
    """Audit rows of processed documents, with metadata as JSON."""
    meta = F.to_json(F.struct("status", "chunk_count"))
    return documents.select(F.col("uploaded_by").alias("user_id"), F.lit(action).alias("action"), F.lit("document").alias("resource_type"),
                            F.col("document_id").alias("resource_id"), meta.alias("metadata"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"))
