"""Queries on length bins and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batching as N
from . import proxies as P
from .registry import query

_BINS_SQL = f"""{P.GROUPS_SQL}, q AS (SELECT unnest(quantile_cont(L, [0.2, 0.4, 0.6, 0.8])) AS p FROM groups),
edges AS (SELECT DISTINCT floor(p + 1e-9)::BIGINT AS edge FROM q),
binned AS (SELECT *, (SELECT count(*) FROM edges WHERE edge < L)::INT AS bin FROM groups)"""


@query("length_bins", f"WITH {_BINS_SQL} SELECT chain_key, L, bin FROM binned")
def length_bins(spark, d):
    return N.length_bins(P.groups(spark, d)).select("chain_key", "L", "bin")


def _batch_sql(order: str, partition: str = "PARTITION BY bin") -> str:
    return f"(row_number() OVER ({partition} ORDER BY {order}) - 1) // 16"


_SHUFFLED = "md5(chain_key || ':42'), chain_key"


@query("bucket_batches", f"WITH {_BINS_SQL} SELECT chain_key, bin, {_batch_sql(_SHUFFLED)} AS batch_no FROM binned")
def bucket_batches(spark, d):
    return N.bucket_batches(P.groups(spark, d), 16).select("chain_key", "bin", "batch_no")


@query("bucket_batches_sorted", f"WITH {_BINS_SQL} SELECT chain_key, bin, {_batch_sql('doc_id')} AS batch_no FROM binned")
def bucket_batches_sorted(spark, d):
    return N.bucket_batches(P.groups(spark, d), 16, seed=None, order="doc_id").select("chain_key", "bin", "batch_no")


@query("batch_count", f"WITH {_BINS_SQL} SELECT bin, count(*) AS n, ceil(count(*) / 16)::BIGINT AS batches FROM binned GROUP BY bin")
def batch_count(spark, d):
    return N.batch_count(P.groups(spark, d), 16)


_PLAIN_SQL = f"{P.GROUPS_SQL}, plain AS (SELECT chain_key, {_batch_sql('doc_id', '')} AS batch_no FROM groups)"


@query("plain_batches", f"WITH {_PLAIN_SQL} SELECT * FROM plain")
def plain_batches(spark, d):
    return N.plain_batches(P.groups(spark, d), 16, "doc_id").select("chain_key", "batch_no")


@query("limit_batches", f"""WITH {_PLAIN_SQL} SELECT chain_key, batch_no,
    batch_no < 3 AS in_first FROM plain WHERE batch_no < floor((SELECT max(batch_no) + 1 FROM plain) * 0.25)""")
def limit_batches(spark, d):
    some = N.limit_batches(N.plain_batches(P.groups(spark, d), 16, "doc_id"), 0.25)
    return some.select("chain_key", "batch_no", (F.col("batch_no") < 3).alias("in_first"))
