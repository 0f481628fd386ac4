"""Files of a folder as documents, blocks and failures; tables saved in the order of a key.

Sources are parsed in one pass over (path, content): a row for each document, its blocks, and what could not be
parsed with the reason, set aside rather than raised. A saved table is a new version beside the old ones,
published when it is whole, so that a writer that is lost leaves the last version standing.

Edge cases: names are matched whatever their case; null contents, bytes that are no UTF-8 and sources
without a parser (PDF among them: no decoder here) are failures; blank files are documents without blocks, files without a byte are not
listed by Spark; a folder or table that isn't there is empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators.ingest import route
from gritstone.sources import markup
from gritstone.sources.scratch import kept

# Suffixes of files that are sources.
SUFFIXES = (".pdf", ".md", ".markdown", ".mdx", ".html", ".htm", ".xhtml", ".txt")

_BLOCK = pa.struct([("ord", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("section_path", pa.list_(pa.string())), ("level", pa.int32())])
_ROW = pa.schema([("path", pa.string()), ("parser", pa.string()), ("title", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("blocks", pa.list_(_BLOCK)), ("error", pa.string())])
_DDL = "path string, parser string, title string, metadata map<string,string>, blocks array<struct<ord:bigint,kind:string,text:string,section_path:array<string>,level:int>>, error string"


def discover(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, length, content of every file below ``root`` with one of the suffixes; unless content is selected it is not read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    except AnalysisException:
        files = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes)).select("path", "length", "content")


def parse(sources: DataFrame) -> DataFrame:
    """(path, content: binary) -> path, parser, title, metadata, blocks, error: a row for each source."""
    routed = sources.select("path", route(F.col("path")).alias("parser"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a source at a time: they may be long
                path, parser, content = (batch.column(k)[i].as_py() for k in range(3))
                title, metadata, blocks, error = None, {}, [], None
                try:
                    if parser not in ("html", "markdown"):
                        raise ValueError(f"no parser for {parser} sources")
                    if content is None:
                        raise ValueError("no content")
                    text = content.decode("utf-8")
                    title, metadata, found = (markup.html_document if parser == "html" else markup.markdown_document)(text, path)
                    stack: list[tuple[int, str]] = []
                    for k, (kind, body, level) in enumerate(found):
                        while level and stack and stack[-1][0] >= level:
                            stack.pop()
                        blocks.append({"ord": k, "kind": kind, "text": body, "section_path": [t for _, t in stack], "level": level})
                        if level:
                            stack.append((level, body))
                except Exception as failure:  # noqa: BLE001 - one bad source must not end the others
                    title, metadata, blocks, error = None, {}, [], f"{type(failure).__name__}: {failure}"
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((path, parser, title, list(metadata.items()), blocks, error), _ROW)], schema=_ROW)

    return routed.mapInArrow(run, _DDL)


def parse_sources(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents (path, parser, title, metadata, n_blocks), blocks (path, ord, kind, text, section_path, level) and
    failures (path, parser, error), from one written pass."""
    made = kept(parse(sources), "parsed")
    good = made.where("error is null")
    documents = good.select("path", "parser", "title", "metadata", F.size("blocks").alias("n_blocks"))
    return documents, good.select("path", F.explode("blocks").alias("b")).select("path", "b.*"), made.where("error is not null").select("path", "parser", "error")


def save(df: DataFrame, path: str, key: str) -> int:
    """Writes ``df`` as JSON lines in the order of ``key`` over its files, as the next version; returns its number."""
    spark, number = df.sparkSession, _newest(df.sparkSession, path)[0] + 1
    part = f"{path}/v{number:06d}-{uuid.uuid4().hex}"
    df.repartitionByRange(key).sortWithinPartitions(key).write.json(part)
    spark.range(1).select(F.lit(number).alias("number"), F.lit(part).alias("part")).write.mode("append").parquet(f"{path}/published")
    return number


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version; blank lines are no rows, and where nothing was saved there are none."""
    part = _newest(spark, path)[1]
    return spark.createDataFrame([], schema) if part is None else spark.read.schema(schema).json(part)


def _newest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    try:
        last = spark.read.parquet(f"{path}/published").agg(F.max(F.struct("number", "part")).alias("last")).first().last
    except AnalysisException:
        return 0, None
    return last.number, last.part
