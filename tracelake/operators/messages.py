"""Screening of user messages: embeddings in batches, compressed vectors, a logistic head, labels per trace."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

#: Characters of a message that are embedded, tokens that a text may have, texts per request (fixed values).
CHARACTERS, TOKENS, BATCH = 20_000, 8192, 100
COMPLAINT, FINE, SILENT = "complaint", "no_complaint", "no_user_messages"


def embedded(messages: DataFrame, encode: Callable[[list[str]], list[tuple[int, list[float]]]], count_tokens: Callable[[str], int] | None = None) -> DataFrame:
    """(trace_id, pos, embedding) of messages (trace_id, pos, text): texts are cut, sent in batches, and put back in order.

    encode takes up to BATCH texts and gives (place, vector) pairs in any order, one for each; it runs in the tasks.
    Blank messages are left out. A text with more than TOKENS tokens raises ValueError.
    """

    def work(frames):
        for frame in frames:
            for start in range(0, len(frame), BATCH):
                part = frame.iloc[start : start + BATCH]
                texts = [t[:CHARACTERS] for t in part["text"]]
                if count_tokens and (worst := max(map(count_tokens, texts))) > TOKENS:
                    raise ValueError(f"a message has {worst} tokens; {TOKENS} at most")
                found = dict(encode(texts))
                if sorted(found) != list(range(len(texts))):
                    raise ValueError("the encoder gave other places than it was asked for")
                yield part[["trace_id", "pos"]].assign(embedding=[found[i] for i in range(len(texts))])

    rows = messages.where(F.btrim("text") != "").select(F.col("trace_id").cast("string"), F.col("pos").cast("long"), "text")
    return rows.mapInPandas(work, "trace_id string, pos long, embedding array<double>")


def compressed(vector: Column, components: np.ndarray, rotation: np.ndarray, centers: np.ndarray, mean: np.ndarray | None = None) -> Column:
    """Vectors as bytes: projected on components, turned, each value by its nearest of 16 centres in four bits, and the length.

    Two values share a byte, the first in its low half; four bytes of little-endian float32 follow. NULL for null vectors.
    """

    @F.pandas_udf(BinaryType())
    def pack(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        there = np.flatnonzero(vectors.notna())
        if len(there):
            x = np.asarray(vectors.iloc[there].tolist(), float)
            x = (x if mean is None else x - mean) @ components.T
            size = np.linalg.norm(x, axis=1)
            turned = (x / np.maximum(size, 1e-30)[:, None]) @ rotation.T
            codes = np.abs(turned[:, :, None] - centers).argmin(axis=2).astype(np.uint8)
            pairs = codes[:, 0::2] | codes[:, 1::2] << 4
            for i, p, n in zip(there, pairs, size.astype("<f4")):
                out.iloc[i] = p.tobytes() + n.tobytes()
        return out

    return pack(vector)


def restored(packed: Column, rotation: np.ndarray, centers: np.ndarray) -> Column:
    """What compressed() kept of the projected vectors; NULL for bytes of another length or without a finite length of 0 or more."""
    wide = len(rotation)

    @F.pandas_udf(ArrayType(DoubleType()))
    def unpack(values: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> list[float] | None:
            if data is None or len(data) != wide // 2 + 4:
                return None
            size = float(np.frombuffer(data[-4:], "<f4")[0])
            if not np.isfinite(size) or size < 0:
                return None
            pairs = np.frombuffer(data[:-4], np.uint8)
            codes = np.stack([pairs & 15, pairs >> 4], axis=1).ravel()
            return (size * (centers[codes] @ rotation)).tolist()

        return pd.Series([one(v) for v in values], dtype=object)

    return unpack(packed)


def screened(traces: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """(trace_id, label, messages, complaints, highest) of all traces, from scores (trace_id, score) of their messages.

    A trace is a complaint if any of its messages is one.
    """
    per_trace = scores.groupBy("trace_id").agg(F.count("*").alias("messages"), F.count_if(F.col("score") >= threshold).alias("complaints"), F.max("score").alias("highest"))
    out = traces.select("trace_id").join(per_trace, "trace_id", "left")
    label = F.when(F.col("messages").isNull(), SILENT).when(F.col("complaints") > 0, COMPLAINT).otherwise(FINE)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("trace_id", label.alias("label"), zero("messages"), zero("complaints"), "highest")


def screening_coverage(labels: DataFrame) -> DataFrame:
    """One row: traces, traces with messages, candidates."""
    return labels.agg(F.count("*").alias("traces"), F.count_if(F.col("label") != SILENT).alias("with_messages"), F.count_if(F.col("label") == COMPLAINT).alias("candidates"))
