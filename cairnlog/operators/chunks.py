"""Overlapping line windows, their vectors and similarity search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_span, preview
from ..functions.vectors import unit
from ..plans.durable import materialise
from ..plans.prefix import running_totals
from ..plans.shipping import ship_code
from .nearest import VectorIndex, build_index, matrix, similarities

ENCODE_BATCH = 32
CHUNKS_PER_SEGMENT = 4096


def _windows(lines: DataFrame, size: int, overlap: int) -> DataFrame:
    """Each line once per window that holds it; neighbours share ``overlap`` lines."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    place = F.col("line_no") - 1
    first = F.greatest(F.lit(0), F.ceil((place - size + 1) / step))
    return lines.withColumn(
        "window_no", F.explode(F.sequence(first.cast("long"), F.floor(place / step)))
    )


def chunk_lines(
    lines: DataFrame, size: int = 100, overlap: int = 10, *, first: int | None = None
) -> DataFrame:
    """Cut the lines of each file into chunks, numbered without the blank ones.

    ``lines`` has ``file``, dense ``line_no`` from 1 and ``value``. A group is one
    window, so a file of any length is spread over all tasks. Numbers are counted on
    window ids alone; the text is shuffled once and joined to them on the same key.
    With ``first`` only so many chunks are built: lines of other windows are not shuffled.
    """
    windows = _windows(lines, size, overlap)
    filled = F.col("value").rlike(r"(?U)\S")
    # Stored, so that the text is read twice only: for this and for the chunks.
    kept = materialise(windows.where(filled).select("file", "window_no").distinct(), "filled-windows")
    numbers = _chunk_numbers(kept)
    if first is not None:
        numbers = materialise(numbers.where(F.col("chunk_index") < first), "first-windows")
        windows = windows.join(numbers.select("file", "window_no"), ["file", "window_no"], "left_semi")
    text = F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "value"))),
        lambda x: F.concat(x["value"], F.lit("\n")),
    )
    bodies = windows.groupBy("file", "window_no").agg(
        F.array_join(text, "").alias("chunk"),
        F.min("line_no").cast("int").alias("start_line"),
        F.max("line_no").cast("int").alias("end_line"),
        F.count(F.lit(1)).cast("int").alias("size"),
    )
    return bodies.join(numbers, ["file", "window_no"]).select(
        "chunk_index", "chunk", "file", "start_line", "end_line", "chunk_num", "size"
    )


def _chunk_numbers(windows: DataFrame) -> DataFrame:
    """``chunk_num`` in the file and ``chunk_index`` over all files, both from 0."""
    tagged = windows.withColumn("_segment", F.floor(F.col("window_no") / CHUNKS_PER_SEGMENT))
    counts = materialise(
        tagged.groupBy("file", "_segment").agg(F.count(F.lit(1)).alias("_rows")), "chunk-counts"
    )
    # One row per segment of thousands of chunks.
    in_file = Window.partitionBy("file").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(
        running_totals(counts, ["file", "_segment"], {"_over_all": "_rows"}).select(
            "file",
            "_segment",
            F.coalesce(F.sum("_rows").over(in_file), F.lit(0)).alias("_in_file"),
            "_over_all",
        ),
        "chunk-offsets",
    )
    place = F.row_number().over(Window.partitionBy("file", "_segment").orderBy("window_no")) - 1
    return (
        tagged.withColumn("_place", place)
        .join(offsets, ["file", "_segment"])
        .select(
            "file",
            "window_no",
            (F.col("_place") + F.col("_in_file")).alias("chunk_num"),
            (F.col("_place") + F.col("_over_all")).alias("chunk_index"),
        )
    )


def first_chunks(chunks: DataFrame, n: int) -> DataFrame:
    """The first ``n`` chunks over all files."""
    return chunks.where(F.col("chunk_index") < n)


def _hashed_terms(chunks: DataFrame, text: str, dim: int) -> DataFrame:
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\W+").transform(chunks)
    counted = HashingTF(inputCol="_words", outputCol="_terms", numFeatures=dim).transform(words)
    scaled = Normalizer(inputCol="_terms", outputCol="_unit", p=2.0).transform(counted)
    return scaled.withColumn("vec", vector_to_array("_unit", "float32")).drop(
        "_words", "_terms", "_unit"
    )


def embed_chunks(
    chunks: DataFrame,
    make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    *,
    text: str = "chunk",
    dim: int = 256,
) -> DataFrame:
    """Add unit vectors ``vec``.

    ``make_encoder`` is called once per task and gives a function from a batch of texts
    to a matrix. Without one, hashed term counts are used, which need no model.
    """
    if make_encoder is None:
        return _hashed_terms(chunks, text, dim)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            texts = batch.fillna("").tolist()
            rows: list[np.ndarray] = []
            for start in range(0, len(texts), ENCODE_BATCH):
                matrix = np.asarray(encoder(texts[start : start + ENCODE_BATCH]), dtype="float64")
                length = np.linalg.norm(matrix, axis=1, keepdims=True)
                rows.extend((matrix / np.where(length > 0, length, 1)).astype("float32"))
            yield pd.Series(rows, dtype=object)

    return chunks.withColumn("vec", encode(F.col(text)))


def normalize_vectors(vectors: DataFrame, column: str = "vec") -> DataFrame:
    return vectors.withColumn(column, unit(F.col(column)))


def _similarity(vectors: Column, query: Sequence[float]) -> Column:
    """Products of a column of vectors with one query, a batch of rows at a time."""
    own = np.array([float(x) for x in query])

    @F.arrow_udf("double")
    def product(column: pa.Array) -> pa.Array:
        known = column.is_valid().to_numpy(zero_copy_only=False)
        found = np.zeros(len(column))
        found[known] = similarities(matrix(column.drop_null()), own) if known.any() else 0.0
        return pa.array(found, mask=~known)

    return product(vectors)


def _nearest(
    corpus: DataFrame, query: Sequence[float], top_k: int, minimum: float | None, key: str, column: str
) -> DataFrame:
    ship_code(corpus.sparkSession)
    scored = corpus.withColumn("similarity", _similarity(F.col(column), query))
    if minimum is not None:
        scored = scored.where(F.col("similarity") >= minimum)
    # Top k per task first, then over the tasks' k rows.
    return (
        scored.where(F.col("similarity").isNotNull())
        .orderBy(F.desc("similarity"), key)
        .limit(max(top_k, 0))
        .withColumn("similarity", F.round("similarity", 4))
    )


def _from_index(
    corpus: DataFrame, index: VectorIndex, queries: DataFrame, top_k: int, minimum: float | None, others_only: bool
) -> DataFrame:
    """The rows of ``corpus`` that an index finds for one query."""
    found = index.nearest(queries, max(top_k, 0), minimum, others_only=others_only)
    near = materialise(found.select(index.key, F.round("similarity", 4).alias("similarity")), "nearest")
    return corpus.join(near, index.key)


def with_preview(found: DataFrame) -> DataFrame:
    """Hits with a short text and a line label."""
    return found.withColumn("preview", preview(F.col("chunk"))).withColumn(
        "lines", line_span(F.col("start_line"), F.col("end_line"))
    )


def search_similar(
    corpus: DataFrame,
    query: Sequence[float] | DataFrame,
    top_k: int = 5,
    min_similarity: float = 0.0,
    *,
    column: str = "vec",
    key: str = "chunk_index",
    index: VectorIndex | None = None,
) -> DataFrame:
    """The ``top_k`` rows closest to a unit vector.

    ``query`` is the vector or a frame of one row and column that holds it. Without an
    ``index`` the corpus is scanned once; with one, only cells that can matter are.
    """
    vector = query.head()[0] if isinstance(query, DataFrame) else query
    if index is None:
        return _nearest(corpus, vector, top_k, min_similarity, key, column)
    asked = corpus.sparkSession.createDataFrame([(0, [float(x) for x in vector])], _QUERY)
    return _from_index(corpus, index, asked, top_k, min_similarity, False)


_QUERY = "query_id long, vec array<double>"


def _row_at(corpus: DataFrame, place: int, key: str, column: str) -> object:
    row = corpus.where(F.col(key) == place).select(column).head() if place >= 0 else None
    if row is None:
        raise IndexError(f"chunk index {place} out of range")
    return row[0]


def similar_to_chunk(
    corpus: DataFrame,
    place: int,
    top_k: int = 5,
    *,
    column: str = "vec",
    key: str = "chunk_index",
    index: VectorIndex | None = None,
) -> DataFrame:
    """The ``top_k`` rows closest to one of the rows, itself left out."""
    own = _row_at(corpus, place, key, column)
    if index is None:
        return _nearest(corpus.where(F.col(key) != place), own, top_k, None, key, column)
    asked = corpus.sparkSession.createDataFrame([(place, [float(x) for x in own])], _QUERY)
    return _from_index(corpus, index, asked, top_k, None, True)


def similar_batch(
    corpus: DataFrame,
    places: Sequence[int] | DataFrame,
    top_k: int = 5,
    *,
    column: str = "vec",
    key: str = "chunk_index",
    index: VectorIndex | None = None,
) -> DataFrame:
    """``query_id, <key>, similarity, rank``: ``similar_to_chunk`` for many rows at once.

    ``places`` are keys, as a frame of one column or a list. Their rows are sent to the cells
    of ``index`` (made here if there is none) that can hold one of their ``top_k``. Places
    that no row has are an error, as in ``similar_to_chunk``; no place gives no row.
    """
    spark = corpus.sparkSession
    if not isinstance(places, DataFrame):
        places = spark.createDataFrame([(int(p),) for p in set(places)], "query_id long")
    wanted = materialise(places.toDF("query_id").distinct(), "query-ids")
    own = corpus.select(F.col(key).cast("long").alias("query_id"), F.col(column).alias("vec"))
    queries = materialise(own.join(wanted, "query_id"), "query-vectors")
    missing = wanted.join(queries.select("query_id"), "query_id", "left_anti").limit(10).collect()
    if missing:
        raise IndexError(f"chunk indexes {sorted(row[0] for row in missing)} out of range")
    index = index or build_index(corpus, column=column, key=key)
    found = index.nearest(queries, max(top_k, 0), others_only=True)
    return found.withColumn("similarity", F.round("similarity", 4))


def chunk_by_index(chunks: DataFrame, index: int, key: str = "chunk_index") -> DataFrame:
    """One chunk with its metadata."""
    _row_at(chunks, index, key, key)
    return chunks.where(F.col(key) == index)


def embedding_info(corpus: DataFrame, column: str = "vec", file: str = "file") -> DataFrame:
    """Number of chunks, dimension and number of files."""
    per_file = corpus.groupBy(file).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size(column)).alias("dim")
    )
    return per_file.agg(
        F.sum("n").alias("num_chunks"),
        F.max("dim").alias("embedding_dim"),
        F.count(F.lit(1)).alias("total_files"),
    )
