"""Benchmark logs in the formats that the reports read, derived from the driver's tables: each order is a line of a run log,
groups of line items are transfers, scaling runs and sweeps, and a nation is a graph.

The text of each derivation is one SQL expression that Spark and the queries' SQL counterparts share; what the reports do
with the rows is not shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUFFERS = [0.1, 0.5, 1.1, 4.3]
TAB = "chr(9)"

_IMPL = """CASE (o_custkey + o_orderkey) % 8 WHEN 0 THEN 'Sequential' WHEN 1 THEN 'OpenMP' WHEN 2 THEN 'GPU' WHEN 3 THEN 'GPU_Managed'
  WHEN 4 THEN 'GPU_ReadMostly' WHEN 5 THEN 'GPU_Opt' WHEN 6 THEN 'gpu' ELSE 'gpu_opt' END"""

#: Headers again and again, short and long rows, unknown names, numbers that are none, and noise before the first header.
RUN_LINES = f"""SELECT CAST(1 + o_orderkey % 3 AS INT) AS file_ord, o_orderkey AS line_no, CASE o_orderkey % 40
  WHEN 1 THEN 'Implementation' || {TAB} || 'Graph' || {TAB} || 'Time_sec' || {TAB} || 'GTEPS'
  WHEN 2 THEN 'GPU' || {TAB} || 'short_row'
  WHEN 3 THEN 'unknown_impl' || {TAB} || n_name || {TAB} || '1' || {TAB} || '1'
  WHEN 4 THEN 'GPU' || {TAB} || n_name || {TAB} || 'not_a_number' || {TAB} || '0.5'
  ELSE {_IMPL} || {TAB} || CASE WHEN o_orderkey % 3 = 0 THEN '/some/dir/' ELSE '' END || n_name
    || {TAB} || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '.5' || {TAB} || CAST(o_custkey % 97 AS STRING) || '.25'
    || CASE WHEN o_orderkey % 40 = 5 THEN {TAB} || 'extra' ELSE '' END END AS value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

#: A nation's graph has as many vertices as the keys of its customers add up to.
SIZES = """SELECT n_name AS graph_base, CAST(sum(c_custkey) AS BIGINT) AS nodes, CAST(2 * sum(c_custkey) + count(*) AS BIGINT) AS edges
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""

BANDWIDTH = """SELECT CASE l_suppkey % 5 WHEN 0 THEN 'HBM3_DtoD' WHEN 1 THEN 'Pinned_HtoD' WHEN 2 THEN 'Pinned_DtoH' WHEN 3 THEN 'NVLink_C2C_Prefetch' ELSE 'Other' END AS transfer_type,
  CAST(CASE l_partkey % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 0.5 WHEN 2 THEN 1.1 ELSE 4.3 END AS DOUBLE) AS size_gb, max(l_extendedprice) AS bandwidth_gbs
FROM lineitem GROUP BY l_suppkey % 5, l_partkey % 4, l_linenumber"""

SCALING = """SELECT l_returnflag AS impl, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS sharp,
  CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS ranks, max(l_extendedprice) AS time_sec, CAST(count(*) AS DOUBLE) AS gteps
FROM lineitem GROUP BY 1, 2, 3"""

SWEEP = """SELECT CASE l_linenumber % 5 WHEN 0 THEN '32' WHEN 1 THEN '64' WHEN 2 THEN '128' WHEN 3 THEN '256' ELSE '512' END AS batchsize,
  '/data/' || l_returnflag || l_linestatus AS graph, min(l_extendedprice) AS time_sec, CAST(count(*) AS DOUBLE) AS gteps
FROM lineitem GROUP BY 1, 2"""

#: Comments, blank and malformed lines, self-loops, repeats, tabs and extra fields among pairs of customer and order numbers.
EDGE_LINES = f"""SELECT CASE o_orderkey % 30 WHEN 0 THEN '# comment' WHEN 1 THEN 'bad line' WHEN 2 THEN '7' WHEN 3 THEN 'x 9' WHEN 4 THEN ''
  WHEN 5 THEN '  ' || CAST(o_custkey AS STRING) || '   ' || CAST(o_orderkey * 7 % 1000 AS STRING) || ' '
  WHEN 6 THEN CAST(o_custkey AS STRING) || {TAB} || CAST(-o_custkey AS STRING) || ' extra'
  ELSE CAST(o_custkey AS STRING) || ' ' || CAST(o_orderkey * 7 % 1000 AS STRING) END AS value
FROM orders"""


#: Lines of a scaling log with comments; of a dataset catalogue with malformed lines; of phase logs, one log a clerk.
SCALING_LINES = f"""SELECT 1 AS file_ord, CAST(-1 AS BIGINT) AS line_no, 'Impl' || {TAB} || 'Graph' || {TAB} || 'Ranks' || {TAB} || 'SHARP' || {TAB} || 'Time_sec' || {TAB} || 'GTEPS' AS value
UNION ALL SELECT 1, o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN '# note' WHEN 1 THEN '' ELSE o_orderstatus || {TAB} || 'g' || {TAB}
  || CASE WHEN o_orderkey % 10 = 2 THEN 'many' ELSE CAST(o_custkey % 8 + 1 AS STRING) END || {TAB} || CAST(o_orderkey % 2 AS STRING) || {TAB}
  || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || {TAB} || 'x' || CASE WHEN o_orderkey % 10 = 3 THEN ' # late' ELSE '' END END FROM orders"""
CATALOGUE_LINES = """SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'no|fields' ELSE CASE s_suppkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END
  || '|' || s_name || ' | http://host/' || CAST(s_suppkey AS STRING) || '|directed| about ' || s_name END AS value FROM supplier"""
PHASE_LINES = """SELECT CAST(o_custkey AS INT) AS file_ord, o_orderkey AS line_no, CASE o_orderkey % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'BFS: ' || CAST(o_orderkey % 50 AS STRING) || '.5 s'
  WHEN 2 THEN 'Backward: ' || CAST(o_orderkey % 30 AS STRING) ELSE 'BFS: ' || CAST(o_orderkey % 7 AS STRING) || ' Backward: ' || CAST(o_orderkey % 9 AS STRING) END AS value FROM orders"""


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derivation over the tables of ``sf_dir``."""
    names = [n for n in ("orders", "customer", "nation", "lineitem", "supplier") if n in sql]
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(sql, **frames)
