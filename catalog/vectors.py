"""Chunks, vectors and similarity search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlog.functions.vectors import dot
from cairnlog.operators import chunks as ops
from cairnlog.operators.nearest import build_index
from cairnlog.plans.files import new_folder
from cairnlog.sources.chunks import read_chunk, read_chunk_range, write_chunks

from . import CATALOG, register
from .views import Tables, sql

SIZE, OVERLAP = 10, 3

_CHUNKS = rf"""w AS (SELECT file, line_no, value,
    unnest(generate_series(greatest(0, CAST(ceil((line_no - {SIZE}) / {SIZE - OVERLAP}) AS BIGINT)), (line_no - 1) // {SIZE - OVERLAP})) AS k
  FROM doc_lines),
  g AS (SELECT file, k, string_agg(value || chr(10), '' ORDER BY line_no) AS chunk, CAST(min(line_no) AS INTEGER) AS start_line,
    CAST(max(line_no) AS INTEGER) AS end_line, CAST(count(*) AS INTEGER) AS size FROM w GROUP BY file, k),
  chunks AS (SELECT row_number() OVER (ORDER BY file, k) - 1 AS chunk_index, chunk, file, start_line, end_line,
    row_number() OVER (PARTITION BY file ORDER BY k) - 1 AS chunk_num, size FROM g WHERE regexp_matches(chunk, '\S'))"""


def _chunked(body: str) -> str:
    return sql("SELECT 1", "doc_lines").replace("\nSELECT 1", ",\n" + _CHUNKS + "\n" + body)


def _chunks(t: Tables) -> DataFrame:
    return ops.chunk_lines(t.doc_lines(), SIZE, OVERLAP)


def _corpus(t: Tables) -> DataFrame:
    return t.view("v_vectors")


register("v1_chunk_lines", _chunks, _chunked("SELECT * FROM chunks"))
register(
    "v2_first_chunks",
    lambda t: ops.chunk_lines(t.doc_lines(), SIZE, OVERLAP, first=40),
    _chunked("SELECT * FROM chunks WHERE chunk_index < 40"),
)


def _stored_chunks(t: Tables) -> str:
    """The folder of all chunks, stored by number."""
    folder = new_folder(t.spark, "catalog-chunks")
    write_chunks(_chunks(t), folder, chunk_size=SIZE, overlap=OVERLAP, model_name="none", per_part=64)
    return folder


register(
    "v2_stored_chunks",
    lambda t: read_chunk_range(t.spark, _stored_chunks(t), 0, 40),
    CATALOG["v2_first_chunks"].sql,
)
register(
    "v3_embed_chunks",
    lambda t: ops.embed_chunks(_chunks(t)).select(
        "chunk_index", F.round(dot(F.col("vec"), F.col("vec")), 4).alias("squared_length")
    ),
    _chunked(
        r"""SELECT chunk_index, CASE WHEN regexp_matches(chunk, '[\p{L}\p{N}_]') THEN 1.0 ELSE 0.0 END::double AS squared_length
        FROM chunks"""
    ),
)


def _query_vector(t: Tables) -> DataFrame:
    """The vector of the largest id."""
    return t.table("embeddings").agg(F.max_by("embedding", "vec_id"))


_SIMILARITY = "list_dot_product(CAST(e.embedding AS double[]), CAST(q.embedding AS double[]))"
register(
    "v4_search_similar",
    lambda t: ops.search_similar(_corpus(t), _query_vector(t), 7, 0.1).select(
        "chunk_index", "file", "similarity"
    ),
    f"""SELECT vec_id AS chunk_index, concat('label', CAST(label AS varchar)) AS file, round(s, 4) AS similarity FROM (
      SELECT e.vec_id, e.label, {_SIMILARITY} AS s FROM embeddings e,
        (SELECT embedding FROM embeddings ORDER BY vec_id DESC LIMIT 1) q)
    WHERE s >= 0.1 ORDER BY s DESC, vec_id LIMIT 7""",
)
# The text of a chunk finds that chunk, or the first one with the same text.
register(
    "v4_search_similar_text",
    lambda t: ops.with_preview(
        ops.search_similar(
            ops.embed_chunks(_chunks(t)),
            ops.embed_chunks(_chunks(t).where(F.col("chunk_index") == 5).select("chunk")).select("vec"),
            1,
        )
    ).select("chunk_index", "file", "lines", "preview", "similarity"),
    _chunked(
        """SELECT chunk_index, file, concat(start_line, '-', end_line) AS lines,
        CASE WHEN length(chunk) > 500 THEN concat(chunk[1:500], '...') ELSE chunk END AS preview,
        1.0::double AS similarity FROM chunks
        WHERE chunk = (SELECT chunk FROM chunks WHERE chunk_index = 5) ORDER BY chunk_index LIMIT 1"""
    ),
)
register(
    "v4_search_similar_indexed",
    lambda t: ops.search_similar(
        _corpus(t), _query_vector(t), 7, 0.1, index=build_index(_corpus(t))
    ).select("chunk_index", "file", "similarity"),
    CATALOG["v4_search_similar"].sql,
)
register(
    "v5_similar_to_chunk",
    lambda t: ops.similar_to_chunk(_corpus(t), 3, 6).select(
        "chunk_index", "similarity"
    ),
    f"""SELECT vec_id AS chunk_index, round(s, 4) AS similarity FROM (
      SELECT e.vec_id, {_SIMILARITY} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q
      WHERE e.vec_id <> 3) ORDER BY s DESC, vec_id LIMIT 6""",
)


def _batch(t: Tables) -> DataFrame:
    """The nearest rows of each label's first vector."""
    firsts = t.table("embeddings").groupBy("label").agg(F.min("vec_id").alias("id"))
    return ops.similar_batch(_corpus(t), firsts.select("id"), 4).select(
        "query_id", "chunk_index", F.col("rank").cast("long"), "similarity"
    )


register(
    "v6_similar_batch",
    _batch,
    f"""SELECT query_id, chunk_index, rank, round(s, 4) AS similarity FROM (
      SELECT q.vec_id AS query_id, e.vec_id AS chunk_index, {_SIMILARITY} AS s,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIMILARITY} DESC, e.vec_id) AS rank
      FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) q
      WHERE e.vec_id <> q.vec_id) WHERE rank <= 4""",
)
register(
    "v7_chunk_by_index",
    lambda t: read_chunk(t.spark, _stored_chunks(t), 5),
    _chunked("SELECT * FROM chunks WHERE chunk_index = 5"),
)
register(
    "v8_embedding_info",
    lambda t: ops.embedding_info(_corpus(t)),
    """SELECT count(*) AS num_chunks, CAST(max(len(embedding)) AS INTEGER) AS embedding_dim,
      count(DISTINCT label) AS total_files FROM embeddings""",
)
register(
    "v9_normalize_vectors",
    lambda t: ops.normalize_vectors(
        t.table("embeddings").withColumn("vec", F.transform("embedding", lambda x: x * 3.0))
    ).select(
        "vec_id",
        F.round(dot(F.col("vec"), F.col("vec")), 6).alias("squared_length"),
        F.round(F.col("vec")[0], 5).alias("first"),
    ),
    """SELECT vec_id, 1.0::double AS squared_length,
      round(embedding[1] / sqrt(list_dot_product(CAST(embedding AS double[]), CAST(embedding AS double[]))), 5) AS first
    FROM embeddings""",
)
