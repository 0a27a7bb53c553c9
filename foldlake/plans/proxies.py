"""Input tables of the library derived from the provided parquet tables.

Each proxy is a Spark function and the same rule as a SQL common table
expression, so that a query and its oracle start from equal rows. All of them
are projections (or map-side aggregates) of whole tables and grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import AMINO_ACIDS, RESIDUE_LETTERS
from ..session import spread, tasks_for

CHAIN_SIZE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A text table, dealt out to all cores when the files are too few to do so themselves."""
    return spread(table(spark, sf_dir, name), *keys)


# ---------------------------------------------------------------- residues

def _chain_columns() -> list[Column]:
    pdb_id = F.concat(F.lit("P"), F.expr("vec_id div 100").cast("string"))
    chain_id = F.when(F.expr("vec_id div 50") % 2 == 0, "A").otherwise("B")
    return [
        pdb_id.alias("pdb_id"),
        chain_id.alias("chain_id"),
        F.concat_ws("_", pdb_id, chain_id).alias("chain_key"),
        (F.col("vec_id") % CHAIN_SIZE).cast("int").alias("pos"),
        F.substring(F.lit(AMINO_ACIDS), (F.col("label") * 2 + F.col("vec_id") % 2 + 1).cast("int"), F.lit(1)).alias("aa"),
    ]


def _at(k: int) -> Column:
    return F.col("embedding")[k].cast("double") * 60


def points(spark: SparkSession, d: str) -> DataFrame:
    """residues: chains of 50 consecutive vectors, two chains per structure."""
    return table(spark, d, "embeddings").select(
        *_chain_columns(), _at(0).alias("x"), _at(1).alias("y"), _at(2).alias("z"),
        (F.col("vec_id") % 11 != 0).alias("has_ca"),
    )


_CHAIN_SQL = f"""
    'P' || (vec_id // 100) AS pdb_id,
    CASE WHEN (vec_id // 50) % 2 = 0 THEN 'A' ELSE 'B' END AS chain_id,
    'P' || (vec_id // 100) || '_' || CASE WHEN (vec_id // 50) % 2 = 0 THEN 'A' ELSE 'B' END AS chain_key,
    (vec_id % 50)::INT AS pos,
    substr('{AMINO_ACIDS}', (label * 2 + vec_id % 2 + 1)::INT, 1) AS aa"""

POINTS_SQL = f"""points AS (SELECT {_CHAIN_SQL},
    embedding[1]::DOUBLE * 60 AS x, embedding[2]::DOUBLE * 60 AS y, embedding[3]::DOUBLE * 60 AS z,
    vec_id % 11 <> 0 AS has_ca FROM embeddings)"""


def backbone(spark: SparkSession, d: str) -> DataFrame:
    """Backbone atoms: CA from dims 0-2, N from 3-5, C from 6-8; some residues lack one."""
    def atom(first: int) -> Column:
        return F.struct(_at(first).alias("x"), _at(first + 1).alias("y"), _at(first + 2).alias("z"))

    return table(spark, d, "embeddings").select(
        *_chain_columns(), atom(3).alias("n"),
        F.when(F.col("vec_id") % 11 != 0, atom(0)).alias("ca"), atom(6).alias("c"),
    )


def _atom_sql(first: int) -> str:
    parts = ", ".join(f"'{axis}': embedding[{first + 1 + k}]::DOUBLE * 60" for k, axis in enumerate("xyz"))
    return "{" + parts + "}"


BACKBONE_SQL = f"""backbone AS (SELECT {_CHAIN_SQL}, {_atom_sql(3)} AS n,
    CASE WHEN vec_id % 11 <> 0 THEN {_atom_sql(0)} END AS ca, {_atom_sql(6)} AS c FROM embeddings)"""


def bulk_points(spark: SparkSession, d: str) -> DataFrame:
    """A larger residue table from lineitem: chains of 16 orders, coordinates from the measures."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_quantity").alias("q"), F.max("l_discount").alias("dis"), F.max("l_tax").alias("tax"),
    ).select(
        F.concat(F.lit("L"), F.expr("l_orderkey div 32").cast("string")).alias("pdb_id"),
        F.concat(F.lit("L"), F.expr("l_orderkey div 32").cast("string"), F.lit("_"),
                 F.expr("(l_orderkey div 16) % 2").cast("string")).alias("chain_key"),
        (F.col("l_orderkey") % 16 * 7 + F.col("l_linenumber") - 1).cast("int").alias("pos"),
        (F.col("q") * 3).alias("x"), (F.col("dis") * 300).alias("y"), (F.col("tax") * 300).alias("z"),
        F.lit(True).alias("has_ca"),
    )


BULK_POINTS_SQL = """bulk_points AS (SELECT 'L' || (l_orderkey // 32) AS pdb_id,
    'L' || (l_orderkey // 32) || '_' || ((l_orderkey // 16) % 2) AS chain_key,
    (l_orderkey % 16 * 7 + l_linenumber - 1)::INT AS pos,
    q * 3 AS x, dis * 300 AS y, tax * 300 AS z, true AS has_ca
    FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_discount) AS dis, max(l_tax) AS tax
          FROM lineitem GROUP BY ALL))"""


# ------------------------------------------------------------- pair scores

def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scored residue pairs (i<j) from lineitem: 64 orders form a chain, every line is a pair."""
    chain = F.expr("l_orderkey div 64")
    i = (F.col("l_orderkey") % 64).cast("int")
    return table(spark, d, "lineitem").select(
        chain.alias("chain"), i.alias("i"),
        (i + 1 + F.col("l_partkey") % 48).cast("int").alias("j"),
        (F.col("l_quantity") / 50 * 0.6 + F.col("l_discount") * 4).alias("p"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
    ).groupBy("chain", "i", "j").agg(F.max("p").alias("p"), F.max("y").alias("y")).select(
        F.when(F.col("chain") % 2 == 0, "val").otherwise("test").alias("split"),
        F.concat(F.lit("C"), F.col("chain").cast("string")).alias("chain_key"),
        "i", "j", "p", "y", (F.col("j") - F.col("i") >= 6).alias("valid"),
    )


def pair_tasks(spark: SparkSession, d: str, channels: int = 1) -> int:
    """Tasks for the pairs, with one row per channel, so that a task stays as small however many there are."""
    return tasks_for(table(spark, d, "lineitem"), 500_000 // channels)


PAIRS_SQL = """pair_scores AS (SELECT CASE WHEN chain % 2 = 0 THEN 'val' ELSE 'test' END AS split,
    'C' || chain AS chain_key, i, j, p, y, j - i >= 6 AS valid FROM (
      SELECT l_orderkey // 64 AS chain, (l_orderkey % 64)::INT AS i,
        (l_orderkey % 64 + 1 + l_partkey % 48)::INT AS j,
        max(l_quantity / 50 * 0.6 + l_discount * 4) AS p,
        max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y
      FROM lineitem GROUP BY ALL))"""


# --------------------------------------------------------- text sequences

def clean(text: Column) -> Column:
    """Letters of the text, upper case, only the twenty residue letters."""
    letters = F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.regexp_replace(letters, f"[^{AMINO_ACIDS}]", "")


def clean_sql(column: str) -> str:
    return (f"regexp_replace(upper(regexp_replace({column}, '[^A-Za-z]', '', 'g')), "
            f"'[^{AMINO_ACIDS}]', '', 'g')")


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """One residue string per document, from its whole text."""
    return texts(spark, d, "documents", "doc_id").select(
        F.col("doc_id"), F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("chain_key"),
        clean(F.col("text")).alias("seq"),
    )


SEQUENCES_SQL = f"""sequences AS (SELECT doc_id, source || '_' || doc_id AS chain_key,
    {clean_sql('text')} AS seq FROM documents)"""


def groups(spark: SparkSession, d: str) -> DataFrame:
    """Chain catalogue: structure id = source, one chain per document, length = characters."""
    return table(spark, d, "documents").select(
        F.col("source").alias("pdb_id"),
        F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("chain_key"),
        F.col("doc_id"), F.col("n_chars").alias("L"),
    )


GROUPS_SQL = """groups AS (SELECT source AS pdb_id, source || '_' || doc_id AS chain_key, doc_id,
    n_chars AS L FROM documents)"""


def test_ids(spark: SparkSession, d: str) -> DataFrame:
    """Held-out structure ids, chosen by hash."""
    return groups(spark, d).select("pdb_id").distinct().filter(F.substring(F.md5("pdb_id"), 1, 1) < "4")


TEST_IDS_SQL = "test_ids AS (SELECT DISTINCT pdb_id FROM groups WHERE substr(md5(pdb_id), 1, 1) < '4')"


def index_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Chain embeddings; the group that must not leak is the label."""
    return table(spark, d, "embeddings").select(
        F.concat_ws("_", F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("chain_key"),
        F.col("label").cast("string").alias("pdb_id"), F.col("vec_id"), F.col("embedding").alias("emb"),
    )


INDEX_SQL = """index_vectors AS (SELECT label || '_' || vec_id AS chain_key, label::VARCHAR AS pdb_id,
    vec_id, embedding::DOUBLE[] AS emb FROM embeddings)"""


# ------------------------------------------------------------- run metrics

def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Logged steps: a run per user, ten steps per epoch by event number, a metric per event type."""
    return table(spark, d, "events").select(
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"),
        F.expr("event_id div 500").cast("int").alias("epoch"),
        F.col("event_id").alias("step"),
        F.concat(F.lit("val/"), F.col("event_type")).alias("metric"), F.col("value"),
    )


METRICS_SQL = """run_metrics AS (SELECT 'run' || user_id AS run_id, (event_id // 500)::INT AS epoch,
    event_id AS step, 'val/' || event_type AS metric, value FROM events)"""


# ---------------------------------------------------------- structure text

_THREE = {letter: name for name, letter in reversed(RESIDUE_LETTERS.items())}


def structure_lines(spark: SparkSession, d: str) -> DataFrame:
    """Fixed-width atom records for every backbone atom, with the usual dirt.

    Per residue up to five records: N, CA, C, a water (hetero) and a second,
    less occupied location of N. Some residues have an unknown name, some no CA,
    in every fourth file some a broken coordinate.
    """
    b = backbone(spark, d).select("*", (F.regexp_extract("pdb_id", r"(\d+)", 1).cast("bigint") * 100
                                        + F.when(F.col("chain_id") == "A", 0).otherwise(50) + F.col("pos")).alias("v"))
    names = F.create_map(*[F.lit(x) for pair in _THREE.items() for x in pair])
    residue = F.when(F.col("v") % 19 == 0, "UNK").otherwise(names[F.col("aa")])

    def record(kind: str, k: int, atom: str, alt: str, name: Column, xyz: Column, occupancy: str) -> Column:
        x = F.format_string("%8.3f", F.round(xyz["x"], 3))
        bad = F.when((F.col("v") % 43 == 5) & (F.expr("v div 100") % 4 == 1), F.lit("   x.xxx")).otherwise(x) if atom == "C" else x
        return F.struct(
            (F.col("v") % 100 * 5 + k + 2).cast("int").alias("line_no"),
            F.concat(F.lit(f"{kind:<6}"), F.format_string("%5d", F.col("v") % 100 * 5 + k), F.lit(f"  {atom:<3}{alt}"), name,
                     F.lit(" "), F.col("chain_id"), F.format_string("%4d", F.col("pos") + 1), F.lit("    "), bad,
                     F.format_string("%8.3f%8.3f", F.round(xyz["y"], 3), F.round(xyz["z"], 3)), F.lit(occupancy)).alias("line"))

    records = F.array(
        record("ATOM", 0, "N", " ", residue, F.col("n"), "  1.00"),
        F.when(F.col("ca").isNotNull(), record("ATOM", 1, "CA", " ", residue, F.col("ca"), "  0.60")),
        record("ATOM", 2, "C", " ", residue, F.col("c"), "  1.00"),
        F.when(F.col("v") % 13 == 0, record("HETATM", 3, "O", " ", F.lit("HOH"), F.col("c"), "  1.00")),
        F.when((F.col("v") % 17 == 0) & F.col("ca").isNotNull(), record("ATOM", 4, "CA", "B", residue, F.col("n"), "  0.40")),
    )
    return b.select("pdb_id", F.explode(F.filter(records, lambda r: r.isNotNull())).alias("r")).select(
        "pdb_id", F.concat(F.lit("mem/"), F.col("pdb_id"), F.lit(".pdb")).alias("path"), "r.line_no", "r.line")


def _record_sql(kind: str, k: int, atom: str, alt: str, name: str, xyz: str, occupancy: str) -> str:
    x = f"printf('%8.3f', round({xyz}.x, 3))"
    if atom == "C":
        x = f"CASE WHEN v % 43 = 5 AND v // 100 % 4 = 1 THEN '   x.xxx' ELSE {x} END"
    return (f"SELECT pdb_id, 'mem/' || pdb_id || '.pdb' AS path, (v % 100 * 5 + {k} + 2)::INT AS line_no, "
            f"'{kind:<6}' || printf('%5d', v % 100 * 5 + {k}) || '  {atom:<3}{alt}' || {name} || ' ' || chain_id || "
            f"printf('%4d', pos + 1) || '    ' || {x} || printf('%8.3f%8.3f', round({xyz}.y, 3), round({xyz}.z, 3)) || "
            f"'{occupancy}' AS line FROM numbered")


_RESIDUE_SQL = ("CASE WHEN v % 19 = 0 THEN 'UNK' ELSE CASE aa "
                + " ".join(f"WHEN '{a}' THEN '{n}'" for a, n in _THREE.items()) + " END END")

LINES_SQL = f"""{BACKBONE_SQL},
numbered AS (SELECT *, regexp_extract(pdb_id, '([0-9]+)', 1)::BIGINT * 100
    + CASE WHEN chain_id = 'A' THEN 0 ELSE 50 END + pos AS v FROM backbone),
structure_lines AS (
    {_record_sql('ATOM', 0, 'N', ' ', _RESIDUE_SQL, 'n', '  1.00')}
    UNION ALL {_record_sql('ATOM', 1, 'CA', ' ', _RESIDUE_SQL, 'ca', '  0.60')} WHERE ca IS NOT NULL
    UNION ALL {_record_sql('ATOM', 2, 'C', ' ', _RESIDUE_SQL, 'c', '  1.00')}
    UNION ALL {_record_sql('HETATM', 3, 'O', ' ', "'HOH'", 'c', '  1.00')} WHERE v % 13 = 0
    UNION ALL {_record_sql('ATOM', 4, 'CA', 'B', _RESIDUE_SQL, 'n', '  0.40')} WHERE v % 17 = 0 AND ca IS NOT NULL)"""


def ingest_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same; every fifth structure is there a second time, in another folder."""
    lines = structure_lines(spark, d)
    again = lines.filter(F.substring("pdb_id", 2, 20).cast("bigint") % 5 == 2).withColumn("path", F.concat(F.lit("mem/old/"), F.col("pdb_id"), F.lit(".pdb")))
    return lines.unionByName(again)


INGEST_LINES_SQL = f"""{LINES_SQL}, ingest_lines AS (SELECT * FROM structure_lines
    UNION ALL SELECT pdb_id, 'mem/old/' || pdb_id || '.pdb' AS path, line_no, line FROM structure_lines WHERE substr(pdb_id, 2)::BIGINT % 5 = 2)"""


def structure_files(spark: SparkSession, d: str) -> DataFrame:
    """Whole structure files: a header, the records as model 1 and a second model to be ignored."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n")
    return structure_lines(spark, d).groupBy("pdb_id", "path").agg(body.alias("body")).select(
        "pdb_id", "path",
        F.concat(F.lit("HEADER    TEST\nMODEL        1\n"), F.col("body"),
                 F.lit("\nENDMDL\nMODEL        2\n"), F.col("body"), F.lit("\nENDMDL\nEND\n")).alias("value"))
