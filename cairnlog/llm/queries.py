"""One query per operator over its whole table, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import quality_sql
from .shipping import ship_code

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(run: Query) -> Query:
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = shipped
    return shipped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    from .decontaminate import find_leaks

    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "item_id", "start_word", "n_words", F.round("similarity", 6).alias("similarity")
    )


#: Items of the given table have at least five words. All windows that hold a shingle of an
#: item are compared with it, wherever they begin.
ORACLE_SQL["op1_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), ds AS (
  SELECT doc_id, len(w) - 4 AS m, i, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)
), its AS (
  SELECT item_id, len(w) - 4 AS n, i, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw)
), hits AS (
  SELECT DISTINCT doc_id, item_id, n, least(n, m) AS size, m, ds.i AS p FROM ds JOIN its USING (s)
), starts AS (
  SELECT DISTINCT doc_id, item_id, n, size, b FROM (
    SELECT *, unnest(range(greatest(1, p - size + 1), least(p, m - size + 1) + 1)) AS b FROM hits)
), wc AS (
  SELECT doc_id, item_id, n, size, b, s, count(*) AS c
  FROM starts JOIN ds USING (doc_id) WHERE ds.i BETWEEN b AND b + size - 1 GROUP BY ALL
), ic AS (SELECT item_id, s, count(*) AS c FROM its GROUP BY ALL),
sims AS (
  SELECT doc_id, item_id, size, b, sum(least(wc.c, ic.c)) / (n + size - sum(least(wc.c, ic.c))) AS sim
  FROM wc JOIN ic USING (item_id, s) GROUP BY doc_id, item_id, n, size, b
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, b) AS r
  FROM sims WHERE sim >= 0.75
)
SELECT doc_id, item_id, cast(b - 1 AS INTEGER) AS start_word, cast(size + 4 AS INTEGER) AS n_words,
  round(cast(sim AS DOUBLE), 6) AS similarity
FROM best WHERE r = 1
"""


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written to block files and read back."""
    from .storage import new_folder
    from .token_files import read_token_files, write_token_files

    folder = new_folder(spark, "token-ids")
    write_token_files(
        table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), folder
    )
    read = read_token_files(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first cleaning: counts and verdict of every document."""
    from .quality import quality

    judged = table(spark, sf_dir, "documents").select("doc_id", quality("text").alias("q"))
    names = (
        "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_failed_lines base_failed kept"
    )
    return judged.select("doc_id", *(f"q.{name}" for name in names.split()))


ORACLE_SQL["op4_line_quality"] = quality_sql()


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, digest of the base spans, all spans."""
    from .secrets import BASE_KINDS, secrets, spans_text

    found = table(spark, sf_dir, "documents").select("doc_id", secrets("text").alias("s"))
    base = F.filter("s", lambda span: span["kind"].isin(*BASE_KINDS))

    def count(kind: str):
        return F.size(F.filter("s", lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(kind) for kind in BASE_KINDS),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("s")).alias("spans"),
    )


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that occurred before."""
    from .line_dedup import remove_repeated_chunks

    cleaned, name = remove_repeated_chunks(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", f"{name}.n_lines", f"{name}.n_removed", f"{name}.text")


#: Rules of the query: host and path, verdict.
URL_RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
#: Members of the block list that results do not name.
BLOCKED_SITES = ("spam-farm.example.org/",)


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and block list applied to every page's URL."""
    from .url_filter import judge_urls, write_index

    rows = [(entry, verdict, True) for entry, verdict in URL_RULES]
    rows += [(entry, "block", False) for entry in BLOCKED_SITES]
    index = write_index(spark.createDataFrame(rows, "entry string, verdict string, named boolean"))
    return judge_urls(table(spark, sf_dir, "pages"), index)


ORACLE_SQL["op7_url_filter"] = f"""
WITH parts AS (
  SELECT page_id, regexp_extract(substr(url, nullif(strpos(url, '://'), 0) + 3), '^([^/?#]*)', 1) AS raw,
         regexp_extract(substr(url, nullif(strpos(url, '://'), 0) + 3), '^[^/?#]*([^?#]*)', 1) AS raw_path
  FROM pages
), p AS (
  SELECT page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(raw_path, '') AS path
  FROM parts
), entries AS (
  SELECT split_part(e, '/', 1) AS h, substr(e, strpos(e, '/')) AS q, e, v, named
  FROM (VALUES {", ".join(f"('{e}', '{v}', true)" for e, v in URL_RULES)},
               {", ".join(f"('{e}', 'block', false)" for e in BLOCKED_SITES)}) AS t(e, v, named)
), fits AS (
  SELECT page_id, e, v, named, length(h) + length(q) AS n FROM p JOIN entries
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
)
SELECT page_id, host, path,
  (SELECT arg_max(e, n) FROM fits WHERE fits.page_id = p.page_id AND named) AS rule,
  coalesce((SELECT arg_max(v, n) FROM fits WHERE fits.page_id = p.page_id AND named),
           (SELECT max(v) FROM fits WHERE fits.page_id = p.page_id), 'allow') AS verdict
FROM p
"""


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    from .packing import assign_sequences, tokenize_pieces

    pieces = tokenize_pieces(
        table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")
    )
    digest = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = digest.join(assign_sequences(pieces), "item_id")
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op9_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's view."""
    from .chat import rotate_perspectives

    return rotate_perspectives(table(spark, sf_dir, "conversations"))


ORACLE_SQL["op9_chat_perspectives"] = r"""
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(text, ''), '<|', '< |') AS text,
    CASE WHEN trim(coalesce(role, '')) = '' THEN '%' ELSE replace(replace(replace(replace(replace(
      role, '%', '%25'), '|', '%7C'), '<', '%3C'), '>', '%3E'), chr(10), '%0A') END AS role
  FROM conversations
), v AS (SELECT DISTINCT conv_id, role AS viewer FROM t WHERE role <> 'system'),
s AS (
  SELECT conv_id, viewer, turn, role,
    CASE WHEN role = viewer THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
         ELSE '<|user name=' || role || '|>' END || chr(10) AS header, text
  FROM t JOIN v USING (conv_id)
), r AS (SELECT *, header || text || chr(10) || '<|end|>' || chr(10) AS segment FROM s),
e AS (
  SELECT *, cast(sum(length(segment)) OVER (
    PARTITION BY conv_id, viewer ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end"
  FROM r
)
SELECT conv_id, viewer, turn, role AS name,
  CASE WHEN role = viewer THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' END AS speaks_as,
  segment, "end" - length(segment) AS start, "end",
  "end" - length(segment) + length(header) AS learn_start,
  CASE WHEN role = viewer THEN "end" ELSE "end" - length(segment) + length(header) END AS learn_end
FROM e
"""


@query
def op10_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of passages that start in an earlier document, removed from every document."""
    from .phrases import remove_repeated_passages

    cleaned = remove_repeated_passages(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents."""
    from .exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL["op11_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS plain FROM documents
), g AS (
  SELECT doc_id, plain, min(doc_id) OVER (PARTITION BY plain) AS keep_id,
    count(*) OVER (PARTITION BY plain) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM g
"""


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as four-byte codes, with the error of each and of its label."""
    from .vector_codes import codebooks_digest, compress_vectors

    coded, codebooks = compress_vectors(table(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(codebooks_digest(codebooks)))


def _vector_codes_sql(parts: int, entries: int, rounds: int) -> str:
    """Assignment and averaging by brute force, a common table for each round."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, label, part, q[part * (len(q) // {parts}) + 1 : (part + 1) * (len(q) // {parts})] AS x
  FROM v CROSS JOIN (SELECT unnest(range({parts})) AS part)
), c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p
  QUALIFY entry < {entries}
)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, label, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d, any_value(x) AS x
  FROM (
    SELECT vec_id, label, part, entry, x,
      cast(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM p JOIN c{i} USING (part)
  ) GROUP BY vec_id, label, part
)""")
        if i < rounds:
            steps.append(f"""s{i} AS (
  SELECT part, entry, i, cast(floor(cast(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m
  FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{i}) GROUP BY part, entry, i
), c{i + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m, c) AS c
  FROM c{i} LEFT JOIN (SELECT part, entry, list(m ORDER BY i) AS m FROM s{i} GROUP BY part, entry)
  USING (part, entry)
)""")
    return f"""
WITH {", ".join(steps)}
, books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}
), coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', cast(entry AS INTEGER)), '' ORDER BY part) AS code,
    cast(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded CROSS JOIN books
"""


ORACLE_SQL["op12_vector_codes"] = _vector_codes_sql(4, 256, 4)


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, every seventh label being another one."""
    from .hard_negatives import mine_hard_negatives

    given = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(given.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE_SQL["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    cast(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
  cast(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
