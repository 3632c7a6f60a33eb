"""Stages that call caller-supplied model functions in partition-parallel batches."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework import constants as K
from passagework import skew
from passagework.functions import text as X

log = logging.getLogger(__name__)
Reply = tuple[str | None, int, int]


def model_stage(
    df: DataFrame,
    prompt: str,
    fn: Callable[[Sequence[str]], Sequence[Reply]],
    batch: int = K.EMBED_BATCH,
) -> DataFrame:
    """Send the prompt column through ``fn`` and add text, token usage and error.

    ``fn`` takes a list of prompts and returns ``(text, prompt_tokens,
    completion_tokens)`` per prompt. A failing batch gives null texts and an error
    text; the job goes on.
    """
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("model_text", T.StringType()),
            T.StructField("prompt_tokens", T.LongType()),
            T.StructField("completion_tokens", T.LongType()),
            T.StructField("model_error", T.StringType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            replies: list[tuple] = []
            prompts = frame[prompt].tolist()
            for begin in range(0, len(prompts), batch):
                part = prompts[begin : begin + batch]
                try:
                    answers = [(*reply, None) for reply in fn(part)]
                    if len(answers) != len(part):
                        raise ValueError(f"{len(answers)} replies to {len(part)} prompts")
                    replies += answers
                except Exception as error:  # noqa: BLE001 - reported per row
                    replies += [(None, 0, 0, str(error) or type(error).__name__)] * len(part)
            columns = ["model_text", "prompt_tokens", "completion_tokens", "model_error"]
            added = pd.DataFrame(replies, columns=columns, index=frame.index)
            yield pd.concat([frame, added], axis=1)

    return df.mapInPandas(run, schema)


def embed(
    df: DataFrame,
    text: str,
    fn: Callable[[Sequence[str]], Sequence[Sequence[float]]] | None = None,
    dim: int = K.EMBED_DIM,
    out: str = "embedding",
    batch: int = K.EMBED_BATCH,
) -> DataFrame:
    """Add a unit-length vector per text.

    ``fn`` turns a list of texts into vectors; without it hashed term counts are
    used, which need no model and stay in the JVM. A batch that fails, or gives another
    number of vectors, gets null vectors; the job goes on.
    """
    if fn is None:
        words = df.withColumn("_words", X.tokens(F.col(text)))
        counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(words)
        unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
        return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows[text].to_pylist()
            vectors = [pa.array([], pa.list_(pa.float32()))]
            for begin in range(0, len(texts), batch):
                part = texts[begin : begin + batch]
                try:
                    made = fn(part)
                    # A matrix of numbers needs no look at each of them.
                    if isinstance(made, np.ndarray) and made.ndim == 2 and made.dtype.kind == "f":
                        ends = pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32())
                        made = pa.ListArray.from_arrays(ends, pa.array(made.astype(np.float32).reshape(-1)))
                    else:
                        made = pa.array([[float(x) for x in v] for v in made], vectors[0].type)
                except Exception as error:  # noqa: BLE001 - a text without a vector takes no part in search
                    log.warning("batch without vectors: %s", error)
                    made = []
                vectors.append(made if len(made) == len(part) else pa.nulls(len(part), vectors[0].type))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.concat_arrays(vectors)], [*rows.schema.names, out])

    return df.mapInArrow(run, schema)


def embed_distinct(df: DataFrame, text: str, fn=None, dim: int = K.EMBED_DIM, out: str = "embedding") -> DataFrame:
    """Embed every distinct text once and give the vector to all its copies.

    The copies of a very common text are spread over many tasks.
    """
    keyed = df.withColumn("_key", F.md5(text))
    unique = keyed.groupBy("_key").agg(F.first(text).alias(text), F.count("*").alias("_n"))
    vectors = embed(unique, text, fn, dim, out).select("_key", out, "_n")
    return skew.join_groups(keyed, vectors, ["_key"], "_n", df.columns, "inner").drop("_key")


def score_pairs(
    pairs: DataFrame,
    fn: Callable[[Sequence[tuple[str, str]]], Sequence[float]],
    question: str = "question",
    content: str = "content",
    out: str = "rerank_score",
    batch: int = K.EMBED_BATCH,
) -> DataFrame:
    """Score (question, text) pairs with a caller's scorer, ``batch`` at a time; a failing batch gives nulls."""
    schema = T.StructType([*pairs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            couples = list(zip(frame[question], frame[content], strict=True))
            scores: list = []
            for begin in range(0, len(couples), batch):
                part = couples[begin : begin + batch]
                try:
                    made = [float(s) for s in fn(part)]
                except Exception as error:  # noqa: BLE001 - the caller falls back to the old order
                    log.warning("batch without scores: %s", error)
                    made = []
                scores += made if len(made) == len(part) else [None] * len(part)
            yield frame.assign(**{out: pd.array(scores, dtype="Float64")})

    return pairs.mapInPandas(run, schema)
