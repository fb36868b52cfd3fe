"""Readers: JSON lines, JSON documents, OCR block folders, delimited files, spreadsheets, paged text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists, asked of Spark's file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    return None


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines (gzip is transparent); lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def valid_pages(rows: DataFrame, shortest: int = 20) -> DataFrame:
    """Pages with a subject, a title, enough text and an integer section."""
    return rows.withColumn("section", F.expr("try_cast(section as int)")).filter(
        (F.trim("subject") != "") & (F.trim("title") != "") & (F.length("text") >= shortest) & F.col("section").isNotNull()
    )


def json_document(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One JSON document for each file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def ocr_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Text blocks (path, page, pos, text) of all *_content_list.json below a folder, tests excluded."""
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_content_list.json")
        .text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    )
    # The place of a block is its index in the file's list.
    blocks = F.from_json("value", "array<struct<type:string,text:string,page_idx:int>>")
    placed = files.select("path", F.posexplode(blocks).alias("pos", "b")).select("path", F.col("pos").cast("long").alias("pos"), "b.*")
    return placed.filter(
        (F.col("type") == "text") & (F.col("page_idx") >= 0) & (F.length(F.trim("text")) >= 2) & ~F.col("path").rlike("/test[_/]")
    ).select("path", F.col("page_idx").alias("page"), "pos", "text")


def json_lines_with_rejects(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines that are no JSON of the schema: path, line (text) and how often it occurs.

    Plain and gzip files are read alike. Empty lines are neither.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line")).filter("line <> ''")
    parsed = lines.withColumn("row", F.from_json("line", f"{schema}, _rejected string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_rejected"}))
    bad = F.col("row").isNull() | F.col("row._rejected").isNotNull()
    good = parsed.filter(~bad).select("row.*").drop("_rejected")
    return good, parsed.filter(bad).groupBy("path", "line").agg(F.count(F.lit(1)).alias("n"))


def first_readable(spark: SparkSession, sources: list[tuple[str, Callable[[SparkSession, str], DataFrame]]]) -> DataFrame:
    """The rows of the first of several sources (path, reader) that exists and has a row, whatever its format."""
    for path, read in sources:
        try:
            rows = read(spark, path)
            if not rows.isEmpty():
                return rows
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    raise FileNotFoundError(f"none of {[path for path, _ in sources]} has rows")


def delimited(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """Delimited text with a header, all columns as strings."""
    return spark.read.option("sep", separator).option("header", True).csv(path)


def paged_text(rows: DataFrame) -> DataFrame:
    """Pages (id, page, text) of texts whose pages end with a form feed."""
    return rows.select("id", F.posexplode(F.split("text", "\f")).alias("page", "text"))


def key_values(rows: DataFrame) -> DataFrame:
    """Metadata (key, value) with values that parse as JSON strings unquoted, others as they are."""
    parsed = F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")
    return rows.select("key", F.coalesce(parsed, F.col("value")).alias("value"))


def spreadsheet_rows(spark: SparkSession, path: str, sheet_name: str | None = None) -> DataFrame:
    """path, row number and cells (strings) of a sheet of XLSX files (the first one unless named), also inside ZIP archives."""
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}

    def column(ref: str) -> int:
        n = 0
        for ch in re.match(r"[A-Z]+", ref)[0]:
            n = 26 * n + ord(ch) - 64
        return n - 1

    def sheet_of(book: zipfile.ZipFile) -> str:
        """The part of the wanted sheet, or of the first one in the workbook's order; by number where the workbook names none."""
        names = book.namelist()
        if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(names):
            targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
            sheets = [(x.get("name"), x.get(link)) for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind(".//m:sheet", space)]
            for name, ref in sheets:
                target = targets.get(ref, "").removeprefix("/xl/").removeprefix("/")
                if sheet_name in (None, name) and f"xl/{target}" in names:
                    return f"xl/{target}"
        if sheet_name is not None:
            raise ValueError(f"no sheet is named {sheet_name}")
        numbered = [x for x in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)]
        return min(numbered, key=lambda x: int(re.search(r"\d+", x)[0]))

    def rows_of(data: bytes) -> Iterator[tuple[int, list[str]]]:
        book = zipfile.ZipFile(io.BytesIO(data))
        inner = [x for x in book.infolist() if x.filename.endswith(".xlsx")]
        if inner:
            book = zipfile.ZipFile(io.BytesIO(book.read(max(inner, key=lambda x: x.file_size))))
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", space)) for si in root.iterfind("m:si", space)]
        sheet = sheet_of(book)
        for i, row in enumerate(ElementTree.fromstring(book.read(sheet)).iterfind(".//m:row", space)):
            cells: list[str] = []
            for c in row.iterfind("m:c", space):
                at = column(c.get("r", "A1"))
                cells += [""] * (at + 1 - len(cells))
                v = c.find("m:v", space)
                text = "".join(t.text or "" for t in c.iterfind(".//m:t", space)) if v is None else v.text or ""
                cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
            yield i, cells

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"], strict=True):
                found = list(rows_of(bytes(data)))
                yield pd.DataFrame({"path": p, "row": [i for i, _ in found], "cells": [c for _, c in found]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, row int, cells array<string>")


def with_headers(rows: DataFrame, wanted: dict[str, list[str]], header_row: int = 0) -> DataFrame:
    """Spreadsheet rows as named columns: a header is taken if it equals, else if it contains, a pattern."""
    header = rows.filter(F.col("row") == header_row).first()["cells"]
    picked = {}
    for name, patterns in wanted.items():
        for test in (lambda h, p: h == p, lambda h, p: p in h):
            hit = next((i for p in patterns for i, h in enumerate(header) if test(h.strip(), p)), None)
            if hit is not None:
                picked[name] = F.get(F.col("cells"), hit)
                break
    body = rows.filter(F.col("row") > header_row)
    return body.select("path", "row", *[c.alias(n) for n, c in picked.items()])
