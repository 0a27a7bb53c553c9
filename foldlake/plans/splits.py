"""Queries on splits and leakage audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as U
from ..operators import splits as X
from ..session import shared_folder
from . import proxies as P
from .registry import query


def _ids(spark, d):
    return P.groups(spark, d).select(F.col("chain_key").alias("pdb_id"))


_SPLIT_SQL = f"""{P.GROUPS_SQL}, split_ids AS (SELECT chain_key AS pdb_id, CASE WHEN row_number() OVER (ORDER BY md5(chain_key || ':42'), chain_key)
    <= greatest(1, least(round_even(count(*) OVER () * 0.1, 0)::BIGINT, count(*) OVER () - 1)) THEN 'val' ELSE 'train' END AS split FROM groups)"""


@query("split_ids", f"WITH {_SPLIT_SQL} SELECT * FROM split_ids")
def split_ids(spark, d):
    return X.split_ids(_ids(spark, d))


@query("named_split", f"WITH {_SPLIT_SQL} SELECT * FROM split_ids")
def named_split(spark, d):
    """Stored on the first call, read back on the second."""
    folder, tag = shared_folder(spark), X.split_tag(0.1, 42, 20)
    X.named_split(spark, folder, tag, _ids(spark, d))
    return X.named_split(spark, folder, tag, _ids(spark, d))


def _listed(spark, d):
    """Three id lists that overlap, of structures named by source and document: by hash, labelled ones, toxic ones."""
    ids = P.table(spark, d, "documents").select("doc_id", F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("pdb_id"))
    marked = ids.join(P.table(spark, d, "labels"), "doc_id").select("pdb_id", "quality", "toxic")
    return (ids.filter(F.substring(F.md5("pdb_id"), 1, 1) < "4").select("pdb_id").withColumn("split", F.lit("test"))
            .unionByName(marked.filter("quality = 1").select("pdb_id").distinct().withColumn("split", F.lit("val")))
            .unionByName(marked.filter("toxic = 1").select("pdb_id").distinct().withColumn("split", F.lit("train"))))


_LISTED_SQL = f"""{P.GROUPS_SQL}, {P.TEST_IDS_SQL}, marked AS (SELECT chain_key AS pdb_id, quality, toxic FROM groups JOIN labels USING (doc_id)),
listed AS (SELECT chain_key AS pdb_id, 'test' AS split FROM groups WHERE substr(md5(chain_key), 1, 1) < '4'
    UNION ALL SELECT DISTINCT pdb_id, 'val' FROM marked WHERE quality = 1 UNION ALL SELECT DISTINCT pdb_id, 'train' FROM marked WHERE toxic = 1)"""


def _summary_sql(found: str) -> str:
    return (f"SELECT (SELECT count(*) FROM ({found})) AS n, "
            f"array_to_string((SELECT list(pdb_id ORDER BY pdb_id) FROM (SELECT pdb_id FROM ({found}) ORDER BY pdb_id LIMIT 10)), ' ') AS first_ids")


def _flat(df):
    return df.select("n", F.array_join("first_ids", " ").alias("first_ids"))


_SHARED = "SELECT pdb_id FROM listed WHERE split = 'val' INTERSECT SELECT pdb_id FROM listed WHERE split = 'test'"


@query("split_overlap", f"WITH {_LISTED_SQL} {_summary_sql(_SHARED)}")
def split_overlap(spark, d):
    listed = _listed(spark, d)
    return _flat(U.overlap(listed.filter("split = 'val'"), listed.filter("split = 'test'")))


@query("split_overlap3", f"""WITH {_LISTED_SQL} SELECT count(*) FILTER (WHERE k > 1) AS in_several,
    count(*) FILTER (WHERE k = (SELECT count(DISTINCT split) FROM listed)) AS in_all
FROM (SELECT pdb_id, count(DISTINCT split) AS k FROM listed GROUP BY pdb_id)""")
def split_overlap3(spark, d):
    return U.overlap_all(_listed(spark, d))


_INDEXED_SQL = f"{_LISTED_SQL}, indexed AS (SELECT * FROM groups WHERE doc_id IN (SELECT doc_id FROM labels))"


def _indexed(spark, d):
    return P.groups(spark, d).join(P.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("index_contamination", f"WITH {_INDEXED_SQL} " + _summary_sql(
    "SELECT DISTINCT pdb_id FROM indexed WHERE pdb_id IN (SELECT pdb_id FROM test_ids)"))
def index_contamination(spark, d):
    return _flat(U.index_contamination(_indexed(spark, d), P.test_ids(spark, d)))


@query("chains_per_group", f"WITH {_INDEXED_SQL} SELECT pdb_id, count(*) AS n_chains FROM indexed GROUP BY pdb_id")
def chains_per_group(spark, d):
    return U.chains_per_group(_indexed(spark, d))


@query("chain_distribution", f"""WITH {_INDEXED_SQL} SELECT n_chains, count(*) AS n_groups
FROM (SELECT count(*) AS n_chains FROM indexed GROUP BY pdb_id) GROUP BY n_chains ORDER BY n_chains LIMIT 10""")
def chain_distribution(spark, d):
    return U.chain_distribution(_indexed(spark, d))


@query("top_multichain", f"""WITH {_INDEXED_SQL}, top AS (SELECT pdb_id, count(*) AS n_chains FROM indexed GROUP BY pdb_id
    HAVING count(*) > 1 ORDER BY n_chains DESC, pdb_id LIMIT 10) SELECT pdb_id, n_chains, chain_key FROM indexed JOIN top USING (pdb_id)""")
def top_multichain(spark, d):
    return U.top_multichain(_indexed(spark, d))


_CHECKS_SQL = f"""checks AS (SELECT 'val_test' AS check_name, (SELECT count(*) FROM ({_SHARED})) AS n
    UNION ALL SELECT 'train_test', (SELECT count(*) FROM ({_SHARED.replace("'val'", "'train'")}))
    UNION ALL SELECT 'index', (SELECT count(DISTINCT pdb_id) FROM indexed WHERE pdb_id IN (SELECT pdb_id FROM test_ids))
    UNION ALL SELECT 'older_index', NULL)"""


@query("audit_report", f"""WITH {_INDEXED_SQL}, {_CHECKS_SQL} SELECT check_name, n, coalesce(n = 0, false) AS passed FROM checks
UNION ALL SELECT 'overall', sum(n)::BIGINT, bool_and(coalesce(n = 0, false)) FROM checks""")
def audit_report(spark, d):
    """The checks of this data, and one on an index that is not there, which fails without a number."""
    listed, held_out = _listed(spark, d), P.test_ids(spark, d)
    part = {s: listed.filter(F.col("split") == s) for s in ("train", "val", "test")}
    return U.audit_report({
        "val_test": U.overlap(part["val"], part["test"]),
        "train_test": U.overlap(part["train"], part["test"]),
        "index": U.index_contamination(_indexed(spark, d), held_out),
        "older_index": U.attempt(U.index_contamination, lambda: P.table(spark, d, "older_index"), lambda: held_out),
    })
