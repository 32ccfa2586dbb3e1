"""Outside models as small interfaces, run in Arrow batches, and deterministic stand-ins for tests and offline use."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.functions.batches import text_slices


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def rerank(self, query: str, texts: Sequence[str]) -> list[float]: ...


class Captioner(Protocol):
    def caption(self, doc: str, markdown: str) -> str: ...


class Canonicaliser(Protocol):
    def canonical_name(self, seed: str, aliases: Sequence[str]) -> str: ...


class CharacterEmbedder:
    """Three numbers from the character codes: sum mod 97, weighted sum mod 101 and length mod 89, over 100."""

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            codes = [ord(c) for c in text]
            out.append([sum(codes) % 97 / 100, sum((i + 1) * c for i, c in enumerate(codes)) % 101 / 100, len(codes) % 89 / 100])
        return out


class OverlapReranker:
    """Share of the query's words that a text holds."""

    def rerank(self, query: str, texts: Sequence[str]) -> list[float]:
        words = set(query.lower().split())
        return [len(words & set(t.lower().split())) / max(1, len(words)) for t in texts]


def embed_all(embedder: Embedder, texts: Sequence[str]) -> tuple[list[list[float] | None], list[str | None]]:
    """A vector or else an error for each text: a batch that fails is cut in half until single texts stand alone.

    One bad text of n costs 2 log2(n) more calls and loses no other text's vector. A reply of another length is an error.
    """
    try:
        vectors = embedder.embed(texts)
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors of {len(texts)} texts")
        return list(vectors), [None] * len(texts)
    except Exception as e:  # the provider's errors are of any kind; each row keeps its own
        if len(texts) == 1:
            return [None], [str(e) or type(e).__name__]
        half = len(texts) // 2
        left, right = embed_all(embedder, texts[:half]), embed_all(embedder, texts[half:])
        return left[0] + right[0], left[1] + right[1]


def with_embedding(df: DataFrame, text: str, embedder: Embedder, batch: int = 64, column: str = "embedding") -> DataFrame:
    """df with an array<float> of embedder, asked in batches; rows that fail by themselves get null and embedding_error."""
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.FloatType())), T.StructField("embedding_error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                part[column], part["embedding_error"] = embed_all(embedder, part[text].fillna("").tolist())
                yield part

    return df.mapInPandas(run, schema)


def write_embedded(df: DataFrame, text: str, embedder: Embedder, path: str, batch: int = 500) -> tuple[DataFrame, DataFrame]:
    """with_embedding() written below path in one pass of calls: the rows with a vector, and the dead letters with their errors."""
    spark = df.sparkSession
    found = with_embedding(df, text, embedder, batch).withColumn("dead", F.col("embedding_error").isNotNull())
    found.write.mode("overwrite").partitionBy("dead").parquet(path)
    rows = spark.read.schema(found.schema).parquet(path)
    return rows.filter(~F.col("dead")).drop("dead", "embedding_error"), rows.filter("dead").drop("dead", "embedding")


def with_caption(df: DataFrame, captioner: Captioner, column: str = "caption") -> DataFrame:
    """df (doc, markdown, ...) with a caption of each page; a task holds batches.HELD_BYTES of pages as objects, not a batch of them."""
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.StringType())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for part in text_slices(batch, "markdown"):
                said = [captioner.caption(d, m) for d, m in zip(part["doc"].to_pylist(), part["markdown"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def reranked(df: DataFrame, reranker: Reranker) -> DataFrame:
    """df (query_id, query, content, ...) with relevance_score, one call for each query's rows of a batch."""
    schema = T.StructType([*df.schema.fields, T.StructField("relevance_score", T.DoubleType())])

    def run(frames):
        for frame in frames:
            frame = frame.assign(relevance_score=0.0)
            for _, part in frame.groupby("query_id", dropna=False):
                frame.loc[part.index, "relevance_score"] = reranker.rerank(part["query"].iloc[0], part["content"].fillna("").tolist())
            yield frame

    return df.mapInPandas(run, schema)
