"""Files into documents: type by extension, encodings, office formats. Bytes come through Spark's binaryFile reader."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.text import clean_text

PLAIN = ["txt", "md", "markdown", "csv", "json", "yaml", "yml", "log"]
MOST_BYTES, MOST_AUDIO = 50 << 20, 25 << 20


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def kind(path: Column) -> Column:
    e = extension(path)
    return F.when(e == "pdf", "pdf").when(e.isin("docx", "doc"), "docx").otherwise("text")


def upload_status(size: Column, most: int = MOST_BYTES) -> Column:
    return F.when(size == 0, 400).when(size > most, 413).otherwise(200)


def decoded(data: bytes) -> tuple[str, str]:
    """(text, encoding): byte order mark first, then UTF-8, then the western single-byte sets."""
    tries = ("utf-16", "utf-8", "latin-1") if data[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8", "utf-8-sig", "cp1252", "latin-1", "iso-8859-15")
    for name in tries:
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace"), "utf-8 (replaced)"


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs, then tables with " | " between cells, blank lines between."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def text(node: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()

    lines = [text(p) for p in body.findall(f"{_W}p")]
    for table in body.findall(f"{_W}tbl"):
        lines += [" | ".join(text(c) for c in row.findall(f"{_W}tc")) for row in table.findall(f"{_W}tr")]
    return "\n\n".join(x for x in lines if x)


def pdf_pages(data: bytes) -> list[str]:
    """Text of every page by the first PDF library that is installed."""
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("no PDF library is installed") from e
    return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages]


def extracted(files: DataFrame) -> DataFrame:
    """``files`` as binaryFile reads them. Adds text, engine, page_count, char_count, is_scanned, error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, data, what in zip(part["path"], part["content"], part["kind"], strict=True):
                text, engine, pages, error = "", "", 1, None
                try:
                    if not data:
                        raise ValueError("empty file")
                    if what == "pdf":
                        each = pdf_pages(bytes(data))
                        text, engine, pages = "\n\n".join(p.strip() for p in each if p.strip()), "pdf", len(each)
                    elif what == "docx":
                        text, engine = docx_text(bytes(data)), "docx"
                    else:
                        text, name = decoded(bytes(data))
                        engine = f"text_decode ({name})"
                except Exception as e:  # a broken file is a row with an error, not a failed job
                    error = str(e) or type(e).__name__
                rows.append((path, text, engine, pages, error))
            yield pd.DataFrame(rows, columns=["path", "raw", "engine", "page_count", "error"])

    read = files.select("path", "content", kind(F.col("path")).alias("kind")).mapInPandas(run, "path string, raw string, engine string, page_count int, error string")
    text = clean_text(F.col("raw"))
    return read.select("path", text.alias("text"), "engine", "page_count", F.length(text).alias("char_count"), ((F.col("page_count") > 0) & (F.length(text) < 50 * F.col("page_count")) & F.startswith("engine", F.lit("pdf"))).alias("is_scanned"), "error")


def read_files(spark: SparkSession, path: str, glob: str = "*", most: int = MOST_BYTES) -> DataFrame:
    """Files of a folder in any store Spark reads; larger ones than ``most`` are not opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.filter((F.col("length") > 0) & (F.col("length") <= most))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """filename, text of the text and Markdown files of a folder."""
    whole = spark.read.option("pathGlobFilter", "*.{txt,md}").text(path, wholetext=True)
    return whole.select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("filename"), F.col("value").alias("text"))


ENTITY = "entity_name string, entity_type string, properties map<string,string>, relations array<struct<target_name:string,target_type:string,relation_type:string,properties:map<string,string>>>"


def parse_entities(raw: DataFrame, column: str = "value") -> DataFrame:
    """Entity payloads from JSON text; what does not parse is dropped into nulls."""
    return raw.select("*", F.from_json(column, ENTITY).alias("payload"))


def tenants(spark: SparkSession, path: str) -> DataFrame:
    """tenant_id, display_name of a registry {id: {display_name}}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<display_name:string>>").alias("m"))
    return raw.select(F.explode("m").alias("tenant_id", "v")).select("tenant_id", F.coalesce("v.display_name", "tenant_id").alias("display_name"))
