"""Queries and SQL of incremental processing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import incremental
from corpusmill.session import shared_dir, table


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    t = {n: table(spark, base, n) for n in ("file_candidates", "file_fingerprints", "data_items", "sync_runs")}
    return incremental.found_rows(t["file_candidates"], t["file_fingerprints"], t["data_items"], t["sync_runs"])


def p6_state(spark: SparkSession, base: str) -> DataFrame:
    """The newest time of each item, kept by partition: computed from what the last successful runs could read, then brought up to date with what arrived since."""
    items = table(spark, base, "data_items").select("source", "id", F.coalesce("updated_at", F.lit(-1)).alias("updated_at"), "arrived_at")
    marks = incremental.read_marks(table(spark, base, "sync_runs")).withColumnRenamed("adapter_id", "source")
    state = incremental.PartitionedState(spark, f"{shared_dir(spark)}/p6-state-{uuid.uuid4().hex}", ["source", "id"], incremental.partitions_of(items) // 64 + 1)

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("source", "id", "part").agg(F.max("updated_at").alias("updated_at"), F.min("arrived_at").alias("arrived_at"))

    state.run(items.join(marks, "source").where("arrived_at <= mark").drop("mark"), newest)
    state.run(items, newest)
    return state.read().select("source", "id", "updated_at", "arrived_at")


P6_SQL = r"""
WITH fp AS (SELECT lower(replace(path, '\', '/')) np, content_hash,
                   rank() OVER (PARTITION BY lower(replace(path, '\', '/')) ORDER BY updated_at DESC NULLS LAST) k FROM file_fingerprints),
f AS (SELECT DISTINCT 'file' AS source, c.path AS record_id FROM file_candidates c
      WHERE NOT c.is_dir AND NOT EXISTS (SELECT 1 FROM fp WHERE fp.k = 1 AND fp.np = lower(replace(c.path, '\', '/')) AND fp.content_hash = c.content_hash)),
m AS (SELECT adapter_id, read_upto FROM (SELECT *, row_number() OVER (PARTITION BY adapter_id ORDER BY started_at DESC, read_upto DESC NULLS LAST) k
      FROM sync_runs WHERE status = 'success' AND started_at IS NOT NULL) WHERE k = 1),
v AS (SELECT source, id, updated_at, title, content, min(arrived_at) a FROM data_items GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY updated_at DESC NULLS LAST, a DESC) k FROM v)
SELECT source, record_id FROM f UNION ALL
SELECT DISTINCT n.source, n.id FROM n LEFT JOIN m ON m.adapter_id = n.source WHERE n.k = 1 AND n.a > coalesce(m.read_upto, -1)
"""
P6_STATE_SQL = "SELECT source, id, max(coalesce(updated_at, -1)) AS updated_at, min(arrived_at) AS arrived_at FROM data_items GROUP BY source, id"
