"""Documents from text files, folders and JSON lines: good records and bad ones, never a silent loss."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

DOCUMENTS = "doc_id string, text string, replaced int, path string, line_no bigint"
_BAD = "�"


def decode(content: str = "content") -> tuple[Column, Column]:
    """UTF-8 text without byte-order mark, invalid bytes as U+FFFD; and how many were put in."""
    raw = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.expr(f"substring({content}, 4)")).otherwise(F.col(content))
    text = F.make_valid_utf8(raw.cast("string"))
    count = lambda x: (F.char_length(x) - F.char_length(F.replace(x, F.lit(_BAD), F.lit("")))).cast("int")
    # genuine U+FFFD are valid UTF-8 already: count them in the bytes
    genuine = (F.char_length(F.regexp_replace(F.hex(raw), "(..)", "$1 ")) - F.char_length(F.replace(F.regexp_replace(F.hex(raw), "(..)", "$1 "), F.lit("EF BF BD "), F.lit("")))) / 9
    return text, (count(text) - genuine.cast("int")).cast("int")


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole files; folders give their .txt and .text files at any depth, by path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    text, replaced = decode()
    return rows.select(F.col("path").alias("doc_id"), text.alias("text"), replaced.alias("replaced"), F.col("_metadata.file_path").alias("path"), F.lit(None).cast("bigint").alias("line_no"))


def is_text(path: str = "path") -> Column:
    return F.lower(path).rlike(r"\.(txt|text)$")


def is_lines(path: str) -> bool:
    return path.lower().endswith((".jsonl", ".jsonl.gz", ".ndjson"))


def skipped_in_folders(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files in the folders that aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path").where(~is_text())


def input_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, length, modification time and SHA-256 of the inputs."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return rows.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def reused_hashes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Inputs (path, length, modificationTime) with the hash of an earlier manifest where nothing changed, else NULL."""
    return now.join(before.select("path", "length", "modificationTime", "sha256"), ["path", "length", "modificationTime"], "left")


def read_lines(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of JSON-lines files, plain or gzip.

    A record is an object with a string ``text``; its key is ``id``, else ``doc_id``, else name:line, where an empty string is no key but 0 is. Blank lines
    are passed over. Errors name the line and its type: JSONDecodeError, KeyError or TypeError; never the text.
    """
    at = [F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.option("lineSep", "\n").text(paths).select(*at, F.col("value").cast("binary").alias("raw"), F.monotonically_increasing_id().alias("n"))
    # a line's number is its place in its block of the file, after the lines of the file's earlier blocks. Blocks are cut and read in
    # one way by every scan of the files; no exchange stands between a scan and these numbers
    counts = lines.groupBy("path", "block").agg(F.count("*").alias("rows"), F.min("n").alias("least"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.join(counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))), ["path", "block"]).withColumn("line_no", F.col("before") + F.col("n") - F.col("least") + 1)
    text, replaced = decode("raw")
    rows = lines.select("name", "path", "line_no", text.alias("value"), replaced.alias("replaced")).where(F.regexp_replace("value", r"(?U)\s+", "") != "")
    rows = rows.withColumn("v", F.try_parse_json("value")).withColumn("kind", F.schema_of_variant("v"))
    field = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    kind = lambda name: F.schema_of_variant(field(name))
    is_object = F.col("kind").startswith("OBJECT")
    fault = F.when(F.col("v").isNull(), "JSONDecodeError").when(~is_object, "TypeError").when(field("text").isNull(), "KeyError").when(kind("text") != "STRING", "TypeError")
    key = lambda name: F.when(field(name).isNotNull() & (kind(name) != "VOID"), F.nullif(F.try_variant_get("v", f"$.{name}", "string"), F.lit("")))
    rows = rows.withColumn("error_type", fault)
    docs = rows.where("error_type is null").select(F.coalesce(key("id"), key("doc_id"), F.concat_ws(":", "name", "line_no")).alias("doc_id"), F.try_variant_get("v", "$.text", "string").alias("text"), "replaced", "path", "line_no")
    return docs, rows.where("error_type is not null").select(F.concat_ws(":", "path", "line_no").alias("doc_key"), F.lit("read").alias("stage"), "error_type")


def read_stdin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("stdin", sys.stdin.read(), 0, None, None)], DOCUMENTS)


#: Lines that one file may have without meeting the numbers of the next.
_FILE_LINES = 2**36


def numbered(docs: DataFrame, files: DataFrame) -> DataFrame:
    """``doc_seq``: a number that rises in input order (by file and line), and tells documents with one key apart.

    It is a function of (path, line_no) and of the list of files (path, arg: the place of the argument that named it), never of how
    a plan deals out rows, so a document has the same number wherever it is read again. One row for each file goes through one task.
    """
    order = files.groupBy(F.col("path").alias("__path")).agg(F.min("arg").alias("arg"))
    order = order.select("__path", F.row_number().over(Window.orderBy("arg", "__path")).cast("bigint").alias("__file"))
    out = docs.join(order, docs["path"].eqNullSafe(order["__path"]))
    return out.withColumn("doc_seq", F.col("__file") * F.lit(_FILE_LINES) + F.coalesce("line_no", F.lit(0))).drop("__path", "__file")


def auto_ids(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Missing keys as doc-000001 and so on; the number counts all documents, also those with their own key.

    A document's number is its place among those of its file, after the documents of earlier files: a window over one file at a time and
    one over the files.
    """
    rows = docs.withColumn("__file", F.shiftright("doc_seq", 36))
    counts = rows.groupBy("__file").agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(counts.select("__file", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before")), "__file")
    n = F.col("__before") + F.row_number().over(Window.partitionBy("__file").orderBy("doc_seq"))
    return rows.withColumn("__n", n).withColumn(key, F.coalesce(key, F.format_string("doc-%06d", "__n"))).drop("__file", "__n", "__before")


def _listed(spark: SparkSession, paths: list[str], args: list[str]) -> DataFrame:
    """(path, arg) of the files at these paths, folders at any depth; no content is read. arg: the first argument that names a file or its folder."""
    named = [(k, spark._jvm.org.apache.hadoop.fs.Path(p)) for k, p in enumerate(args) if p in paths]
    whole = [(k, str(p.getFileSystem(spark._jsc.sc().hadoopConfiguration()).makeQualified(p).toString())) for k, p in named]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sorted({*paths})).select(F.col("_metadata.file_path").alias("path"), F.col("path").alias("plain"))
    by = spark.createDataFrame(whole, "arg int, named string")
    return files.join(F.broadcast(by), (F.col("plain") == F.col("named")) | F.col("plain").startswith(F.concat("named", F.lit("/")))).select("path", "arg")  # as many rows as arguments


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Is a folder at this path? Nothing there is an error; a pattern names files."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.sc().hadoopConfiguration()).globStatus(target)
    if not found:
        raise FileNotFoundError(f"nothing at {path}")
    return len(found) == 1 and found[0].isDirectory()


def read_documents(spark: SparkSession, paths: list[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """All documents of files, folders, JSON lines and "-" (standard input), with the errors; strict: an error raises.

    A file that is named is read whatever its suffix; a folder, whatever its name, gives its .txt and .text files. A file named twice, or
    named and in a folder, is read once.
    """
    good, bad, files = [], [], []
    lines = [p for p in paths if p != "-" and is_lines(p) and not _is_folder(spark, p)]
    plain = [p for p in paths if p != "-" and p not in lines]
    folders = [p for p in plain if _is_folder(spark, p)]
    named = [p for p in plain if p not in folders]
    if "-" in paths:
        good.append(read_stdin(spark))
        files.append(good[-1].select("path", F.lit(paths.index("-")).alias("arg")))
    if lines:
        docs, errors = read_lines(spark, lines)
        good.append(docs)
        bad.append(errors)
        files.append(_listed(spark, lines, paths))
    if named:
        good.append(read_files(spark, sorted({*named})))
        files.append(_listed(spark, named, paths))
    if folders:
        inside = read_files(spark, sorted({*folders})).where(is_text()).dropDuplicates(["path"])
        good.append(inside.join(good[-1].select("path"), "path", "left_anti").select(inside.columns) if named else inside)
        files.append(_listed(spark, folders, paths))
    errors = reduce(DataFrame.unionByName, bad) if bad else spark.createDataFrame([], "doc_key string, stage string, error_type string")
    if strict and (first := errors.first()):
        raise ValueError(f"{first['doc_key']}: {first['error_type']}")
    return numbered(reduce(DataFrame.unionByName, good), reduce(DataFrame.unionByName, files)), errors


def limited(docs: DataFrame, n: int) -> DataFrame:
    """The first n documents, in order."""
    return docs.orderBy("doc_seq").limit(n)


def load_note_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, note_id) of a CSV; an id that isn't an integer, or two for one document, is an error."""
    rows = spark.read.csv(path, header=True).select("doc_id", F.expr("try_cast(trim(note_id) as bigint)").alias("note_id"))
    ids = rows.groupBy("doc_id").agg(F.min("note_id").alias("note_id"), F.max("note_id").alias("most"), F.max(F.col("note_id").isNull()).alias("unread"))
    if bad := ids.where("unread or note_id <> most").select("doc_id").first():
        raise ValueError(f"note ids of {path}: one isn't an integer, or a document has two (first: {bad['doc_id']})")
    return ids.select("doc_id", "note_id")


def read_worksheet(spark: SparkSession, path: str, required: tuple[str, ...] = ("doc_id", "mention_text")) -> DataFrame:
    """A worksheet CSV, byte-order mark allowed, with ``row`` as a spreadsheet counts."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return rows.withColumn("row", (F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) + 1).cast("int"))
