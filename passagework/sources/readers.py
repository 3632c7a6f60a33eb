"""Readers: corpus files, evaluation sets, service logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.constants import PARSER_FAMILIES

SOURCE_TYPE = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("snippet", T.StringType()),
    ]
)
EVAL_ITEM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("reference_context", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("expected_answer_keywords", T.ArrayType(T.StringType())),
        T.StructField("sources", T.ArrayType(SOURCE_TYPE)),
    ]
)
QA_MESSAGE = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField(
            "sources",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("filename", T.StringType()),
                        T.StructField("score", T.DoubleType()),
                        T.StructField("snippet", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(path, r"([^/\\.]|^|/)(\.[^./\\]+)$", 2))


def parser_family(path: Column) -> Column:
    """Parser family of a file name, null when no parser takes it."""
    ext = extension(path)
    family = F.lit(None).cast("string")
    for name, extensions in PARSER_FAMILIES.items():
        family = F.when(ext.isin(extensions), F.lit(name)).otherwise(family)
    return family


def route(files: DataFrame, path: str = "file_path") -> tuple[DataFrame, DataFrame]:
    """Files with their parser family, and the files nothing can parse."""
    marked = files.withColumn("file_type", extension(F.col(path))).withColumn(
        "parser_used", parser_family(F.col(path))
    )
    return marked.where("parser_used is not null"), marked.where("parser_used is null")


def corpus_rows(docs: DataFrame, path: Column, content: str, metadata: dict[str, Column]) -> DataFrame:
    """Bring a document table into the corpus shape."""
    pairs = [p for name, value in metadata.items() for p in (F.lit(name), value.cast("string"))]
    return docs.select(
        path.alias("file_path"),
        extension(path).alias("file_type"),
        F.col(content).alias("content"),
        F.create_map(*pairs).alias("metadata"),
        F.coalesce(parser_family(path), F.lit("unknown")).alias("parser_used"),
    )


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files below ``path``, with a byte order mark removed."""
    raw = spark.read.text(path, wholetext=True).withColumn("file_path", F.col("_metadata.file_path"))
    clean = raw.withColumn("value", F.regexp_replace("value", "^﻿", ""))
    return corpus_rows(clean, F.col("file_path"), "value", {"source": F.col("file_path")})


def read_eval_items(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Items of ``{"dataset": [...]}`` files; a missing path gives no rows."""
    schema = T.StructType([T.StructField("dataset", T.ArrayType(EVAL_ITEM))])
    try:
        raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], EVAL_ITEM)
    return raw.select(F.explode("dataset").alias("item")).select("item.*")


LOG_LINE = r"^(\S+ \S+) \| (\w+) *\| (\S+) \| (.*)$"


def parse_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Split ``time | level | logger | message`` lines; other lines keep only ``line``."""
    fields = {"logged_at": 1, "level": 2, "logger": 3, "message": 4}
    found = F.col(line).rlike(LOG_LINE)
    return lines.select(
        F.col(line).alias("line"),
        *[
            F.when(found, F.regexp_extract(line, LOG_LINE, group)).alias(name)
            for name, group in fields.items()
        ],
    )


def error_lines(parsed: DataFrame, last: int | None = None) -> DataFrame:
    """Lines that mention an error, optionally the ``last`` ones by time."""
    errors = parsed.where(F.col("line").rlike("ERROR|CRITICAL|Traceback"))
    return errors if last is None else errors.orderBy(F.desc("logged_at"), F.desc("line")).limit(last)


def qa_messages(parsed: DataFrame) -> DataFrame:
    """Questions, answers and exploded sources logged by the question services."""
    kind = F.regexp_extract("message", r"^(RAG_QUERY|CHAT) ", 1)
    body = F.regexp_extract("message", r"(?s)^(?:RAG_QUERY|CHAT) (\{.*\})$", 1)
    return (
        parsed.select("logged_at", kind.alias("kind"), F.from_json(body, QA_MESSAGE).alias("qa"))
        .where("kind <> ''")
        .select("logged_at", "kind", "qa.question", "qa.answer", F.explode_outer("qa.sources").alias("s"))
        .select("logged_at", "kind", "question", "answer", "s.filename", "s.score", "s.snippet")
    )
