"""Fetching and parsing of files and pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cleanup, extension, file_type


def files(spark: SparkSession, path: str, most_bytes: int | None = None, pattern: str | None = None) -> DataFrame:
    """(path, name, size, modified, content) of files of any Hadoop file system; larger ones than ``most_bytes`` are not read."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(path)
    if most_bytes is not None:
        rows = rows.where(F.col("length") <= most_bytes)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def parser_for(name: Column, mime: Column) -> Column:
    """'markdown' or 'html' where name or type say so, 'text' for text, else 'binary'."""
    kind = file_type(name, mime)
    plain = F.coalesce(mime.startswith("text/"), F.lit(False)) | extension(name).isin("txt", "log", "csv")
    return F.when(kind == "markdown", "markdown").when(kind.isin("html", "htm", "text/html"), "html").when(plain, "text").otherwise("binary")


class _Text(HTMLParser):
    BREAKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 table ul ol section article".split())

    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(page: str) -> str:
    parser = _Text()
    parser.feed(page)
    parser.close()
    return "".join(parser.parts)


def parsed(rows: DataFrame, name: str = "name", content: str = "content", mime: str | None = None) -> DataFrame:
    """Adds parser and text (cleaned; null for binary files). HTML runs as an Arrow UDF, the rest in the JVM."""

    @F.arrow_udf("string")
    def page(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else html_text(x) for x in column.to_pylist()], pa.string())

    kind = parser_for(F.col(name), F.col(mime) if mime else F.lit(None).cast("string"))
    text = F.decode(F.col(content), "UTF-8")
    rows = rows.withColumn("parser", kind)
    return rows.withColumn("text", cleanup(F.when(F.col("parser") == "html", page(text)).when(F.col("parser") != "binary", text)))


def rule_allows(name: Column, mime: Column, rules: list[str]) -> Column:
    """Whether the type of a file (extension before MIME type) is among the rules; 'ALL' or no rules allow any."""
    wanted = [r.strip().lower() for r in rules]
    return F.lit(True) if not wanted or "all" in wanted else F.coalesce(file_type(name, mime).isin(wanted), F.lit(False))


def document_token(url: Column) -> Column:
    """The token of a cloud document's address (/docx/<token>, /docs/<token>), null for other addresses."""
    token = F.regexp_extract(url, r"/(?:docx|docs)/([A-Za-z0-9_-]+)", 1)
    return F.when(token != "", token)
