"""The queries of this folder over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containers, distinctive, encoding, landmarks, markup, near_duplicates, neighbours, ranking, stuffing
from .shared import table, written


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = distinctive.term_scores(table(spark, sf_dir, "posting"), table(spark, sf_dir, "chunk"), table(spark, sf_dir, "term_probe"))
    return distinctive.most_distinctive(scores)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.as_pairs(neighbours.nearest_vectors(table(spark, sf_dir, "chunk"), table(spark, sf_dir, "vector_probe"), k=5))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.found_elements(markup.clean_documents(table(spark, sf_dir, "document")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = near_duplicates.two_tables(table(spark, sf_dir, "document"), table(spark, sf_dir, "chunk"))
    return near_duplicates.near_duplicate_pairs(records, threshold=0.6, shingle=3)


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and chunks with five-word sequences: the class of equal ones, and how many other classes it is linked to at 0.8."""
    records = near_duplicates.two_tables(table(spark, sf_dir, "document"), table(spark, sf_dir, "chunk"))
    return near_duplicates.linked_records(*near_duplicates.similar_classes(records))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_of_each(ranking.one_ranking(table(spark, sf_dir, "hit")))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = landmarks.two_tables(table(spark, sf_dir, "document"), table(spark, sf_dir, "chunk"))
    return landmarks.split_oversized(items, table(spark, sf_dir, "size_limit"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landmarks.boundaries(_split(spark, sf_dir))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the items above their limit."""
    return _split(spark, sf_dir).select("record", "item_id", "idx", "piece")


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item above its limit: pieces within it, numbered from 0, each a part of the content, together all of it but blanks."""
    items = landmarks.two_tables(table(spark, sf_dir, "document"), table(spark, sf_dir, "chunk"))
    bare = lambda c: F.octet_length(F.regexp_replace(c, r"\s", ""))
    big = items.join(F.broadcast(table(spark, sf_dir, "size_limit").select("record", "max_bytes")), "record").where(F.octet_length("content") > F.col("max_bytes"))
    one = big.groupBy("record", "item_id").agg(F.max(F.struct(F.octet_length("content").alias("n"), "content", "max_bytes")).alias("m")).select("record", "item_id", "m.*")
    rows = landmarks.split_oversized(items, table(spark, sf_dir, "size_limit")).join(one, ["record", "item_id"])
    rows = rows.select("record", "item_id", "idx", "max_bytes", F.octet_length("piece").alias("size"), F.instr(F.col("content"), F.col("piece")).alias("at"), bare(F.col("content")).alias("all"), bare(F.col("piece")).alias("part"))
    got = rows.groupBy("record", "item_id").agg((F.max("size") <= F.first("max_bytes")).alias("within"), ((F.max("idx") + 1 == F.count("idx")) & (F.countDistinct("idx") == F.count("idx"))).alias("numbered"), ((F.min("at") > 0) & (F.sum("part") >= F.first("all"))).alias("whole"))
    return one.select("record", "item_id").join(got, ["record", "item_id"], "left")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, sf_dir, "documents"))


def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, decoded from their ids."""
    return encoding.decode_corpus(encoding.encode_corpus(table(spark, sf_dir, "documents")))


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.fill_containers(encoding.encode_corpus(table(spark, sf_dir, "documents"), lengths_only=True))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.divided(_filled(spark, sf_dir))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every container and what it holds."""
    placed = _filled(spark, sf_dir).where(F.col("container").isNotNull())
    return placed.groupBy("container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per text with tokens: whether its pieces make up the whole text, divided only if need be, in containers that hold no more than they can."""
    lengths = encoding.encode_corpus(table(spark, sf_dir, "documents"), lengths_only=True)
    placed = written(containers.fill_containers(lengths), "placed")
    fill = placed.groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    rows = placed.where("container IS NOT NULL").join(fill, "container").groupBy("doc_id")
    got = rows.agg(F.sum("n_tokens").alias("n"), F.max("fill").alias("fill"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("part").alias("parts"))
    whole = (F.col("n") == F.col("n_tokens")) & (F.col("fill") <= 4096) & (F.col("pieces") == F.col("parts")) & (F.col("parts") == F.ceil(F.col("n") / 4096))
    return lengths.where("n_tokens > 0").select("doc_id", "n_tokens").join(got, "doc_id", "left").select("doc_id", F.coalesce(whole, F.lit(False)).alias("placed"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.flagged(stuffing.stuffed_pages(table(spark, sf_dir, "documents"), lang_col="lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p4_links, p5_found, p6_found, p6_pieces, p6_checks, p7_ids, p7_texts, p8_found, p8_containers, p8_checks, p9_found)}


P1_SQL = """
WITH live AS (SELECT DISTINCT chunk_id FROM chunk WHERE chunk_id IS NOT NULL),
p AS (SELECT chunk_id, term, coalesce(max(tf), 1) AS tf, max(dl) AS dl FROM posting
      WHERE term IS NOT NULL AND chunk_id IN (SELECT chunk_id FROM live) GROUP BY ALL),
c AS (SELECT (SELECT count(*) FROM live)::DOUBLE AS n, (SELECT sum(tf) FROM p)::DOUBLE / (SELECT count(*) FROM live) AS avgdl),
s AS (SELECT term, count(*) AS df, sum(tf)::DOUBLE AS f FROM p GROUP BY term),
x AS (SELECT p.chunk_id, p.term, f / n AS r,
             p.tf * log2(1 + avgdl / CASE WHEN dl > 0 THEN dl::DOUBLE ELSE avgdl END) AS tfn
      FROM p JOIN s USING (term), c
      WHERE p.chunk_id IN (SELECT chunk_id FROM term_probe) AND p.tf >= 2 AND df >= 2)
SELECT chunk_id, term FROM x
QUALIFY row_number() OVER (PARTITION BY chunk_id
                           ORDER BY round(-(log2(1 + r) + tfn * log2((1 + r) / r)) / (tfn + 1), 9), term) = 1
"""

P5_SQL = """
WITH h AS (SELECT query_id, coalesce(search_no, 0) AS search_no, chunk_id, dense, sparse, is_dense,
                  CASE WHEN is_dense IS NULL THEN 'rerank' WHEN is_dense THEN 'dense' ELSE 'sparse' END AS kind,
                  CASE WHEN isfinite(score) THEN score END AS score
           FROM hit WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL),
kept AS (SELECT query_id, chunk_id, 'dense' AS kind, max(dense) AS k FROM h WHERE is_dense IS NULL AND dense <> 0 AND isfinite(dense) GROUP BY ALL
         UNION ALL
         SELECT query_id, chunk_id, 'sparse', max(sparse) FROM h WHERE is_dense IS NULL AND sparse <> 0 AND isfinite(sparse) GROUP BY ALL),
e AS (SELECT query_id, search_no, kind, chunk_id, max(score) AS own FROM h GROUP BY ALL),
l AS (SELECT e.query_id, e.search_no, e.kind, e.chunk_id, coalesce(own, k) AS score
      FROM e LEFT JOIN kept ON e.query_id = kept.query_id AND e.kind = kept.kind AND e.chunk_id = kept.chunk_id AND e.search_no = 0),
m AS (SELECT query_id, search_no, kind, quantile_disc(score, 0.5) AS mid FROM l GROUP BY ALL),
d AS (SELECT query_id, search_no, kind, any_value(mid) AS mid, quantile_disc(abs(score - mid), 0.5) AS mad, avg(abs(score - mid)) AS aad
      FROM l JOIN m USING (query_id, search_no, kind) GROUP BY ALL),
v AS (SELECT query_id, kind, chunk_id,
             1 / (1 + exp(-coalesce((score - mid) / CASE WHEN mad > 0 THEN mad * 1.4826 WHEN aad > 0 THEN aad * 1.2533 END, 0))) AS v
      FROM l JOIN d USING (query_id, search_no, kind)),
b AS (SELECT query_id, chunk_id, max(v) FILTER (kind = 'dense') AS a, max(v) FILTER (kind = 'sparse') AS s, max(v) FILTER (kind = 'rerank') AS r
      FROM v GROUP BY ALL),
w AS (SELECT query_id, max((kind = 'dense')::INT) AS wa, max((kind = 'sparse')::INT) AS ws, max((kind = 'rerank')::INT) AS wr FROM v GROUP BY ALL)
SELECT query_id, chunk_id FROM b JOIN w USING (query_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY
    round(-exp((wa * ln(coalesce(a, 0.02)) + ws * ln(coalesce(s, 0.02)) + wr * ln(coalesce(r, 0.02))) / (wa + ws + wr)), 9), chunk_id) = 1
"""

P6_SQL = r"""
WITH i AS (SELECT 'document' AS record, doc_id AS item_id, content FROM document
           UNION ALL SELECT 'chunk', chunk_id, content FROM chunk),
b AS (SELECT DISTINCT record, item_id, content, max_bytes FROM i JOIN size_limit USING (record)
      WHERE item_id IS NOT NULL AND strlen(content) > max_bytes),
x AS (SELECT record, item_id, max_bytes,
             list_max([strlen(trim(p, E' \t\r\n')) FOR p IN regexp_split_to_array(content, '\n[\t\r ]*\n\s*')]) AS a,
             list_max([strlen(trim(p, E' \t\r\n')) FOR p IN string_split(content, E'\n')]) AS l,
             list_max([strlen(p) FOR p IN regexp_split_to_array(content, '\s+')]) AS w FROM b)
SELECT record, item_id, CASE WHEN a <= max_bytes THEN 'paragraph' WHEN l <= max_bytes THEN 'line' WHEN w <= max_bytes THEN 'word' ELSE 'none' END AS boundary
FROM x
"""


P6_CHECKS_SQL = """
SELECT DISTINCT record, item_id, true AS within, true AS numbered, true AS whole
FROM (SELECT 'document' AS record, doc_id AS item_id, content FROM document UNION ALL SELECT 'chunk', chunk_id, content FROM chunk)
JOIN size_limit USING (record) WHERE item_id IS NOT NULL AND strlen(content) > max_bytes
"""
P7_TEXTS_SQL = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
P8_CHECKS_SQL = "SELECT doc_id, true AS placed FROM documents WHERE text <> ''"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p5_found": P5_SQL, "p6_found": P6_SQL, "p6_checks": P6_CHECKS_SQL, "p7_texts": P7_TEXTS_SQL, "p8_checks": P8_CHECKS_SQL}
