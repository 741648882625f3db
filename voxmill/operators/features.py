"""Text features: hashed term vectors, pluggable encoders, centroids and similarities."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.config import Config
from voxmill.functions.numbers import dot, unit, vector_dot
from voxmill.functions.text import english_stopwords, feature_tokens
from voxmill.operators.scale import lookup_join

# Bytes of tokens that are counted at a time.
TEXT_BYTES = 1 << 20

Encoder = Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]


def _murmur3(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """Signed 32-bit hashes of pieces of text, as ``HashingTF`` makes them; ``words`` are the four bytes at each place of the text."""
    order = np.argsort(-(lengths >> 2), kind="stable")
    starts, lengths = starts[order], lengths[order]
    blocks = lengths >> 2

    def mixed(k: np.ndarray) -> np.ndarray:
        k *= np.uint32(0xCC9E2D51)
        k = (k << np.uint32(15)) | (k >> np.uint32(17))
        k *= np.uint32(0x1B873593)
        return k

    h = np.full(len(starts), seed, dtype=np.uint32)
    for block in range(int(blocks[0]) if len(blocks) else 0):
        # The longest pieces stand first.
        n = int(np.searchsorted(-blocks, -block))
        part = h[:n]
        part ^= mixed(words[starts[:n] + 4 * block])
        part = (part << np.uint32(13)) | (part >> np.uint32(19))
        part *= np.uint32(5)
        part += np.uint32(0xE6546B64)
        h[:n] = part
    rest = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], dtype=np.uint32)[lengths & 3]
    h ^= mixed(words[starts + 4 * blocks] & rest)
    h ^= lengths.astype(np.uint32)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    out = np.empty(len(h), dtype=np.int32)
    out[order] = h.view(np.int32)
    return out


def _counted(data: np.ndarray, offsets: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of tokens with single spaces between: how many different places each has, the places, and their parts of a unit-length vector."""
    begins, ends = offsets[:-1], offsets[1:]
    some = begins < ends
    spaces = np.flatnonzero(data[offsets[0] : offsets[-1]] == 32) + offsets[0]
    first = np.sort(np.concatenate([begins[some], spaces + 1]))
    last = np.sort(np.concatenate([spaces, ends[some]]))
    row = np.searchsorted(ends, first, side="right")
    # A pair of neighbours is the text from the one to the other.
    pairs = np.flatnonzero(row[1:] == row[:-1])
    starts = np.concatenate([first, first[pairs]]) - offsets[0]
    lengths = np.concatenate([last, last[pairs + 1]]) - offsets[0] - starts
    padded = np.concatenate([data[offsets[0] : offsets[-1]], np.zeros(4, dtype=np.uint8)])
    words = np.ndarray((len(padded) - 3,), dtype="<u4", buffer=padded, strides=(1,)).astype(np.uint32)
    places = _murmur3(words, starts, lengths).astype(np.int64) % dim
    keys, counts = np.unique(np.concatenate([row, row[pairs]]) * dim + places, return_counts=True)
    row, counts = keys // dim, counts.astype(np.float64)
    norms = np.sqrt(np.bincount(row, counts * counts, minlength=len(begins)))
    return np.bincount(row, minlength=len(begins)), (keys % dim).astype(np.int32), counts / norms[row]


def _hashed(dim: int):
    """Unit-length vectors of the terms and neighbouring pairs of texts of tokens."""

    def run(texts: pa.Array) -> pa.Array:
        if texts.null_count:
            raise ValueError("a text is null")
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        cuts = [0]
        while cuts[-1] < len(texts):
            # Some texts at a time, which keeps what is made of them small.
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offsets, offsets[cuts[-1]] + TEXT_BYTES, side="right")) - 1))
        found = [_counted(data, offsets[a : b + 1], dim) for a, b in itertools.pairwise(cuts)]
        sizes, places, values = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, t) for t in (np.int64, np.int32, np.float64))
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (places, values)]
        return pa.StructArray.from_arrays([pa.array(np.zeros(len(sizes)), pa.int8()), pa.array(np.full(len(sizes), dim), pa.int32()), *lists], names=["type", "size", "indices", "values"])

    return F.arrow_udf(run, VectorUDT())


def hashed_tf(df: DataFrame, text: str = "text", out: str = "features", cfg: Config = Config()) -> DataFrame:
    """Unit-length sparse vector of hashed word 1-grams and 2-grams, with the hashes of ``pyspark.ml.feature.HashingTF``."""
    tokens = F.array_join(feature_tokens(F.col(text), english_stopwords()), " ")
    return df.withColumn(out, _hashed(cfg.hash_dim)(tokens))


def embed_external(df: DataFrame, encoder: Encoder, text: str = "text", out: str = "embedding") -> DataFrame:
    """Unit-length float vectors from a pluggable model, loaded once per task."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        encode = encoder()
        for batch in batches:
            vectors = np.asarray(encode(batch[text].tolist()), dtype="float64").reshape(len(batch), -1)
            norms = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            yield batch.assign(**{out: list((vectors / norms).astype("float32"))})

    return df.mapInPandas(run, schema)


def as_vector(c: Column) -> Column:
    return array_to_vector(c.cast("array<double>"))


def centroids(df: DataFrame, group: Sequence[str], vector: str = "features", normalise: bool = True) -> DataFrame:
    """Mean vector per group as array<double>, by default scaled to unit length.

    ``vector`` is an ML vector column. The mean is a partially combined aggregate: one running sum per
    group and input partition goes through the shuffle, whatever the size of the group.
    """
    means = df.groupBy(*group).agg(
        Summarizer.mean(F.col(vector)).alias("_mean"), F.count(F.lit(1)).alias("members")
    )
    mean = vector_to_array("_mean")
    return means.withColumn("centroid", unit(mean) if normalise else mean).drop("_mean")


def similarity_to_centroid(
    df: DataFrame, cents: DataFrame, group: str, id_col: str, vector: str = "embedding", out: str = "similarity"
) -> DataFrame:
    """Dot product of every row's vector (an array or an ML vector) with the centroid of its group."""
    joined = lookup_join(df, cents.select(group, "centroid"), group, salt_from=id_col, how="inner", small_rows=1000)
    product = vector_dot if df.schema[vector].dataType.typeName() == "vectorudt" else dot
    return joined.withColumn(out, product(F.col(vector), F.col("centroid"))).drop("centroid")


def similarity_to(vector: Column, centroid: list[float]) -> Column:
    """Dot product of an ML vector with one fixed vector, inlined as a literal."""
    return vector_dot(vector, F.lit([float(x) for x in centroid]).cast("array<double>"))
