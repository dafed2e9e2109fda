"""Layout boxes, texts and job events made from the ``lineitem`` and ``events`` tables, for tests and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgate.storage import file_bytes, parts_for

TEXTS_SQL = """
base AS (
  SELECT CAST(FLOOR(l_orderkey / 40) AS BIGINT) AS doc_id,
         CAST(FLOOR((l_orderkey % 40) / 4) AS INT) AS page_index,
         l_orderkey AS ok, l_linenumber AS ln,
         CAST(l_partkey % 8 AS INT) AS kind, CAST(l_suppkey % 9 AS INT) AS k,
         ROW_NUMBER() OVER (PARTITION BY CAST(FLOOR(l_orderkey / 40) AS BIGINT), CAST(FLOOR((l_orderkey % 40) / 4) AS INT)
                            ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i
  FROM {lineitem}),
texts AS (
  SELECT doc_id, page_index, CAST(i AS BIGINT) AS text_idx, CONCAT('text_', CAST(i AS STRING)) AS text_id,
    CASE WHEN i = 0 AND page_index % 3 = 1 AND doc_id % 5 <> 0
           THEN CASE doc_id % 3 WHEN 0 THEN CONCAT('Chapter ', CAST(CAST(FLOOR(page_index / 3) AS INT) + 1 AS STRING), ': Part ', CAST(doc_id AS STRING))
                                WHEN 1 THEN CONCAT('제 ', CAST(CAST(FLOOR(page_index / 3) AS INT) + 1 AS STRING), ' 장 서론 ', CAST(doc_id AS STRING))
                                ELSE CONCAT('第', CAST(CAST(FLOOR(page_index / 3) AS INT) + 1 AS STRING), '章 标题') END
         WHEN i = 1 AND page_index % 3 = 1 AND doc_id % 2 = 0
           THEN CONCAT(CAST(CAST(FLOOR(page_index / 3) AS INT) + 1 AS STRING), CASE doc_id % 3 WHEN 0 THEN '.1 Scope' ELSE '.1.2 Deep' END)
         WHEN i = 1 AND page_index % 3 = 2 AND doc_id % 4 <= 1
           THEN CASE doc_id % 3 WHEN 0 THEN 'Section 3.1 Method' WHEN 1 THEN '§ 4 Bounds' ELSE 'section 12' END
         WHEN i = 0 AND page_index % 3 = 2 AND doc_id % 4 = 1 THEN CONCAT(CAST(page_index AS STRING), ' Results')
         WHEN i = 0 AND page_index % 3 = 0 AND doc_id % 4 = 1 THEN CONCAT(CAST(page_index AS STRING), '.2.3 Deep')
         WHEN kind = 1 THEN CONCAT('As shown in Figure ', CAST(k AS STRING), ', the flow')
         WHEN kind = 2 THEN CONCAT('see fig. ', CAST(k AS STRING), '.2 for detail')
         WHEN kind = 3 THEN CONCAT('(Fig. ', CAST(k AS STRING), ') and [그림 ', CAST(k AS STRING), ']')
         WHEN kind = 4 THEN CONCAT('Figures ', CAST(k AS STRING), '-', CAST(k + 2 AS STRING), ' compare')
         WHEN kind = 5 THEN CONCAT('Figure ', CAST(k AS STRING), '. Caption')
         WHEN kind = 7 THEN CONCAT('도표 ', CAST(k AS STRING), ' 및 도표', CAST(k + 1 AS STRING), '.5 참조')
         ELSE 'plain prose without any pointer' END AS text,
    CAST(100 AS DOUBLE) AS x0, CAST(100 + 60 * i - CASE WHEN kind = 0 AND k < 4 THEN 55 ELSE 0 END AS DOUBLE) AS y0,
    CAST(500 AS DOUBLE) AS x1, CAST(130 + 60 * i - CASE WHEN kind = 0 AND k < 4 THEN 55 WHEN kind = 0 AND k = 8 THEN -40 ELSE 0 END AS DOUBLE) AS y1, kind, k
  FROM base)"""
LAYOUTS_SQL = """
layouts AS (
  SELECT doc_id, page_index, 2 * text_idx AS layout_idx,
    CASE WHEN text_idx <= 1 AND doc_id % 4 = 0 THEN 'Paragraph_Title' WHEN text_idx <= 1 AND doc_id % 4 = 1 THEN 'header'
         WHEN text_idx % 5 = 0 THEN 'abstract' ELSE 'text' END AS label,
    x0 + (doc_id % 3) * 3 AS x0, y0 AS y0, x1 AS x1, y1 AS y1,
    CAST(0.9 AS DOUBLE) AS score, CAST(2 AS INT) AS cls_id FROM texts
  UNION ALL
  SELECT doc_id, page_index, 2 * text_idx + 1,
    CASE WHEN k % 3 = 0 THEN 'Image' WHEN k % 3 = 1 THEN 'chart' ELSE 'figure_title' END,
    x0, y0 - 22, x1, y0 - 2, CAST(0.8 AS DOUBLE), CAST(1 AS INT) FROM texts WHERE text LIKE 'Figure %. Caption'
  UNION ALL
  SELECT doc_id, page_index, 2 * text_idx + 1, 'table', x0, y0 - 22, x1, y0 - 2, CAST(0.7 AS DOUBLE), CAST(8 AS INT) FROM texts WHERE kind = 6)"""
EVENTS_SQL = """
SELECT event_id, user_id AS task_id, ts,
  CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'page_completed' WHEN 'purchase' THEN 'completed' ELSE 'error' END AS type,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
  CAST(event_id % 20 AS INT) AS current_page, CAST(20 AS INT) AS total_pages, CAST(event_id % 20 AS DOUBLE) / 20 * 100 AS progress FROM {events}"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture_parts(spark: SparkSession, sf_dir: str) -> int:
    """The partitions over which the fixture's documents are dealt."""
    return parts_for(spark, file_bytes(spark, f"{sf_dir}/lineitem.parquet"))


def fixture_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, dealt by document: only the numbers that they are made from are moved, and what follows by document or page is not."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = lines.repartition(fixture_parts(spark, sf_dir), F.expr("CAST(FLOOR(l_orderkey / 40) AS BIGINT)"))
    rows = spark.sql(f"WITH {TEXTS_SQL} SELECT * FROM texts", lineitem=lines)
    return rows.select("doc_id", "page_index", "text_idx", "text_id", "text", "x0", "y0", "x1", "y1", "kind", "k")


def fixture_layouts(texts: DataFrame) -> DataFrame:
    """Layout boxes around the fixture's texts."""
    return texts.sparkSession.sql(f"WITH {LAYOUTS_SQL.replace('FROM texts', 'FROM {texts}')} SELECT * FROM layouts", texts=texts)


def fixture_pages(texts: DataFrame) -> DataFrame:
    """Pages of the fixture: one in eleven is an error page, one in thirteen has an error without a status."""
    pages = texts.select("doc_id", "page_index").distinct()
    return pages.selectExpr(
        "doc_id", "page_index",
        "CASE WHEN (doc_id + page_index) % 11 = 0 THEN 'error' WHEN (doc_id + page_index) % 13 = 0 THEN NULL ELSE 'success' END AS status",
        "CASE WHEN (doc_id + page_index) % 11 = 0 OR (doc_id + page_index) % 13 = 0 THEN 'failed' END AS error",
        "CAST(600 AS INT) AS width", "CAST(2000 AS INT) AS height",
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(EVENTS_SQL, events=read_table(spark, sf_dir, "events"))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))
