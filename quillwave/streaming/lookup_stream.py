"""Mean word vectors and classes of texts as they arrive.

The vector table, the vocabulary and the model are static. A micro-batch goes
through the same operators as a whole table, so a lookup that doesn't fit a
broadcast is a shuffle join here too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillwave.operators.vectors import mean_vectors
from quillwave.plans import tweets
from quillwave.streaming import batch_files


def mean_vector_stream(
    stream: DataFrame, id_col: str, text_col: str, vectors: DataFrame, dim: int, path: str, progress: str, **running
) -> StreamingQuery:
    """``(id, n_tokens, vector)`` of every text; ``vectors`` is a stored table (word, vector)."""

    def transform(batch: DataFrame) -> DataFrame:
        return mean_vectors(batch, id_col, text_col, vectors, dim)

    return batch_files.start(stream, transform, path, progress, **running)


def classify_stream(
    stream: DataFrame,
    id_col: str,
    text_col: str,
    label_col: str,
    vocabulary: DataFrame,
    make_predict: Callable[[], Callable],
    path: str,
    progress: str,
    *,
    length: int = 512,
    unknown_id: int = 1,
    **running,
) -> StreamingQuery:
    """``(id, label)`` of every text by a batch model on fixed-length ids."""

    def transform(batch: DataFrame) -> DataFrame:
        return tweets.classify(batch, id_col, text_col, label_col, vocabulary, make_predict, length=length, unknown_id=unknown_id)

    return batch_files.start(stream, transform, path, progress, **running)
