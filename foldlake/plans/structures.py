"""Queries on structure text, chains, FASTA text and id lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import AMINO_ACIDS, RESIDUE_LETTERS
from ..functions.scalars import r6
from ..operators import chains as C
from ..session import shared_folder
from ..sources import fasta, ids, ingest, structures
from ..streaming import ingest_stream
from . import proxies as P
from .registry import query

def _parsed_sql(lines: str) -> str:
    return f"""SELECT pdb_id, path, line_no, trim(line[1:6]) = 'HETATM' AS hetero, trim(line[13:16]) AS atom,
    trim(line[17:17]) AS altloc, trim(line[18:20]) AS res_name, trim(line[22:22]) AS chain_id,
    try_cast(trim(line[23:26]) AS INT) AS res_no, trim(line[27:27]) AS icode,
    try_cast(trim(line[31:38]) AS DOUBLE) AS x, try_cast(trim(line[39:46]) AS DOUBLE) AS y,
    try_cast(trim(line[47:54]) AS DOUBLE) AS z, try_cast(trim(line[55:60]) AS DOUBLE) AS occupancy FROM {lines}"""


ATOMS_SQL = f"""{P.LINES_SQL}, atoms AS ({_parsed_sql('structure_lines')}),
good AS (SELECT * FROM atoms WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND res_no IS NOT NULL)"""

#: Whole files only: those without a broken record, one per stem.
FILES_SQL = f"""{P.INGEST_LINES_SQL}, atoms AS ({_parsed_sql('ingest_lines')}),
files AS (SELECT pdb_id, path, count(*) AS records, count(*) FILTER (WHERE x IS NULL OR y IS NULL OR z IS NULL OR res_no IS NULL) AS broken FROM atoms GROUP BY ALL),
states AS (SELECT *, CASE WHEN broken > 0 THEN 'broken' WHEN path = min(path) FILTER (WHERE broken = 0) OVER (PARTITION BY pdb_id) THEN 'ok' ELSE 'repeated' END AS state FROM files),
good AS (SELECT * FROM atoms WHERE path IN (SELECT path FROM states WHERE state = 'ok'))"""

_MAP_SQL = "letters(res_name, aa) AS (VALUES " + ", ".join(f"('{n}', '{a}')" for n, a in sorted(RESIDUE_LETTERS.items())) + ")"

_RESIDUE_STEPS_SQL = f"""{_MAP_SQL},
best AS (SELECT *, row_number() OVER (PARTITION BY pdb_id, path, chain_id, res_no, icode, res_name, atom
    ORDER BY occupancy DESC, line_no) AS place FROM good WHERE NOT hetero),
residues AS (SELECT pdb_id, chain_id, pdb_id || '_' || chain_id AS chain_key, path,
    (row_number() OVER (PARTITION BY pdb_id, path, chain_id ORDER BY first_line) - 1)::INT AS pos, aa, x, y, z, x IS NOT NULL AS has_ca
    FROM (SELECT pdb_id, path, chain_id, res_no, icode, aa, min(line_no) AS first_line,
            max(CASE WHEN atom = 'CA' AND place = 1 THEN x END) AS x, max(CASE WHEN atom = 'CA' AND place = 1 THEN y END) AS y,
            max(CASE WHEN atom = 'CA' AND place = 1 THEN z END) AS z
          FROM best JOIN letters USING (res_name) GROUP BY ALL))"""
_CHAIN_STEPS_SQL = """all_chains AS (SELECT chain_key, pdb_id, chain_id, path, string_agg(aa, '' ORDER BY pos) AS seq, count(*)::INT AS L,
    count(*) FILTER (WHERE has_ca)::INT AS n_ca FROM residues GROUP BY ALL)"""

RESIDUES_SQL = f"{ATOMS_SQL}, {_RESIDUE_STEPS_SQL}"
CHAINS_SQL = f"{RESIDUES_SQL}, {_CHAIN_STEPS_SQL}"
BUILD_SQL = f"{FILES_SQL}, {_RESIDUE_STEPS_SQL}, {_CHAIN_STEPS_SQL}"


def _atoms(spark, d):
    return structures.parse_atoms(structures.structure_lines(P.structure_files(spark, d)))


def _good(spark, d):
    return structures.split_rejects(structures.parse_atoms(P.structure_lines(spark, d)), "record")[0]


def _built(spark, d):
    """Residues of a build: whole files, one per stem."""
    return structures.residues(structures.usable(structures.parse_atoms(P.ingest_lines(spark, d))))


def _residues(spark, d):
    return structures.residues(_good(spark, d))


@query("pdb_scan", f"""WITH {P.LINES_SQL},
body AS (SELECT pdb_id, line, (row_number() OVER (PARTITION BY pdb_id ORDER BY line_no) + 1)::INT AS line_no FROM structure_lines)
SELECT pdb_id, line_no, line FROM body
UNION ALL SELECT DISTINCT pdb_id, 0, 'HEADER    TEST' FROM body
UNION ALL SELECT DISTINCT pdb_id, 1, 'MODEL        1' FROM body""")
def pdb_scan(spark, d):
    return structures.structure_lines(P.structure_files(spark, d)).select("pdb_id", "line_no", "line")


@query("pdb_atoms", f"""WITH {ATOMS_SQL} SELECT pdb_id, hetero, atom, altloc, res_name, chain_id, res_no, icode,
    x, y, z, occupancy FROM good""")
def pdb_atoms(spark, d):
    good, _ = structures.split_rejects(_atoms(spark, d), "record")
    return good.select("pdb_id", "hetero", "atom", "altloc", "res_name", "chain_id", "res_no", "icode", "x", "y", "z", "occupancy")


@query("residues", f"""WITH {RESIDUES_SQL} SELECT pdb_id, chain_id, chain_key, pos, aa, x, y, z, has_ca FROM residues""")
def residues(spark, d):
    return _residues(spark, d).drop("path")


_RECORDS_SQL = """SELECT chain_key, pdb_id, chain_id, path AS source_path, seq, L, n_ca, 8.0::DOUBLE AS cutoff, 6 AS min_sep
FROM all_chains WHERE L >= 20 AND n_ca > 0"""


@query("chains", f"WITH {BUILD_SQL} {_RECORDS_SQL}")
def chains(spark, d):
    return C.assemble_chains(_built(spark, d))


@query("chain_sink", f"WITH {BUILD_SQL} {_RECORDS_SQL}")
def chain_sink(spark, d):
    """The chain records, written and read back."""
    path = f"{shared_folder(spark)}/chains"
    ingest.write_chains(C.assemble_chains(_built(spark, d)), path)
    return spark.read.parquet(path).drop("bucket")


def _streamed(spark, d):
    """The sink of a stream build over the structure files, in two runs: a second file of a stem comes in the second."""
    folder = shared_folder(spark)
    arrived, sink = f"{folder}/arrived", f"{folder}/sink"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n")
    files = P.ingest_lines(spark, d).groupBy("pdb_id", "path").agg(body.alias("value"))
    for again in (False, True):
        files.filter(F.col("path").startswith("mem/old/") == F.lit(again)).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 64).parquet(arrived)
        ingest_stream.build_chains(stream, sink, f"{folder}/state", min_len=47).awaitTermination()
    return sink


@query("ingest_stream", f"WITH {BUILD_SQL} {_RECORDS_SQL.replace('L >= 20', 'L >= 47')}")
def ingest_streamed(spark, d):
    return ingest_stream.read_chains(spark, _streamed(spark, d))


@query("ingest_rejects", f"WITH {FILES_SQL} SELECT pdb_id, path, records, broken, state FROM states")
def ingest_rejects(spark, d):
    return structures.file_states(structures.parse_atoms(P.ingest_lines(spark, d)))


_SUMMARY_SQL = f"""WITH {BUILD_SQL}
SELECT (SELECT count(*) FROM states) AS files,
       (SELECT count(*) FROM states WHERE state = 'broken') AS failed, (SELECT count(*) FROM states WHERE state = 'repeated') AS repeated,
       (SELECT count(*) FROM all_chains WHERE L >= 47 AND n_ca > 0) AS saved,
       (SELECT count(*) FROM all_chains WHERE NOT (L >= 47 AND n_ca > 0)) AS skipped"""


@query("ingest_build", _SUMMARY_SQL)
def ingest_build(spark, d):
    """The same counts, of a build that writes its chains."""
    counts = ingest.write_build(structures.parse_atoms(P.ingest_lines(spark, d)), f"{shared_folder(spark)}/built", min_len=47)
    return spark.range(1).select(*[F.lit(counts[n]).cast("bigint").alias(n) for n in ("files", "failed", "repeated", "saved", "skipped")])


@query("ingest_summary", _SUMMARY_SQL)
def ingest_summary(spark, d):
    return structures.ingest_summary(structures.parse_atoms(P.ingest_lines(spark, d)), C.all_chains(_built(spark, d)), min_len=47)


@query("fetch_stored", f"""WITH {P.GROUPS_SQL} SELECT chain_key, pdb_id, L, toxic FROM groups JOIN labels USING (doc_id) WHERE toxic = 1""")
def fetch_stored(spark, d):
    """Chains of the written sink for the toxic documents; only the buckets of their keys are read."""
    path = f"{shared_folder(spark)}/groups"
    ingest.write_chains(P.groups(spark, d), path, buckets=256)
    marked = P.groups(spark, d).join(P.table(spark, d, "labels").filter("toxic = 1"), "doc_id").select("chain_key", "toxic")
    return ingest.fetch_stored(spark, marked, path, buckets=256).select("chain_key", "pdb_id", "L", "toxic")


@query("ingest_incremental", f"""WITH {P.GROUPS_SQL}, existing AS (SELECT chain_key FROM groups JOIN labels USING (doc_id))
SELECT pdb_id, count(*) AS saved, sum(L)::BIGINT AS residues FROM groups
WHERE chain_key NOT IN (SELECT chain_key FROM existing) GROUP BY pdb_id""")
def ingest_incremental(spark, d):
    catalogue = P.groups(spark, d)
    existing = catalogue.join(P.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return ingest.ingest(catalogue, existing).groupBy("pdb_id").agg(
        F.count(F.lit(1)).alias("saved"), F.sum("L").alias("residues"))


def _fasta_text(spark, d):
    wrapped = F.regexp_replace("seq", "(.{60})", "$1\n")
    reverse = F.regexp_replace(F.reverse("seq"), "(.{60})", "$1\n")
    label = F.when(F.col("doc_id") % 7 == 3, "").otherwise(F.concat(F.lit("rev_"), F.col("doc_id").cast("string")))
    return P.sequences(spark, d).select(
        F.concat(F.lit("mem/"), F.col("chain_key")).alias("path"),
        F.concat(F.lit(">"), F.col("chain_key"), F.lit("\n"), wrapped, F.lit("\n> "), label, F.lit("\n"), reverse).alias("value"))


@query("fasta_read", f"""WITH {P.SEQUENCES_SQL}
SELECT 'mem/' || chain_key AS path, 0 AS record_no, chain_key AS label, seq FROM sequences
UNION ALL SELECT 'mem/' || chain_key, 1, CASE WHEN doc_id % 7 = 3 THEN printf('seqnum%09d', 2 + length(seq) // 60)
    ELSE 'rev_' || doc_id END, reverse(seq) FROM sequences""")
def fasta_read(spark, d):
    return fasta.fasta_records(_fasta_text(spark, d))


@query("alignment_clean", """SELECT conv_id AS msa_id, turn AS row_no, text AS raw,
    regexp_replace(regexp_replace(text, '-', '', 'g'), '[a-z]', '', 'g') AS dropped,
    length(regexp_replace(text, '[a-z]', '', 'g')) AS n_kept FROM conversations""")
def alignment_clean(spark, d):
    msa = P.table(spark, d, "conversations").select(
        F.col("conv_id").alias("msa_id"), F.col("turn").alias("row_no"), F.col("text").alias("raw"), F.col("text").alias("dropped"))
    both = fasta.clean_alignment(msa, "dropped", keep_gaps=False, keep_insertions=False)
    return both.withColumn("n_kept", F.length(F.regexp_replace("raw", "[a-z]", "")).cast("bigint"))


@query("msa_check", """SELECT conv_id AS msa_id, count(*) AS n_rows, min(length(text))::INT AS min_len, max(length(text))::INT AS max_len,
    min(length(text)) = max(length(text)) AS aligned FROM conversations GROUP BY conv_id""")
def msa_check(spark, d):
    return fasta.check_msa(P.table(spark, d, "conversations").select(
        F.col("conv_id").alias("msa_id"), F.col("text").alias("seq")))


@query("id_list", """SELECT DISTINCT trim(line) AS pdb_id FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE length(trim(line)) > 0""")
def id_list(spark, d):
    lines = P.texts(spark, d, "documents", "doc_id").select(F.explode(F.split("text", "\n")).alias("value"))
    return ids.clean_ids(lines).distinct()


@query("select_chains", f"""WITH {P.GROUPS_SQL}, {P.TEST_IDS_SQL}
SELECT pdb_id, chain_key, L FROM groups WHERE pdb_id IN (SELECT pdb_id FROM test_ids) AND L >= 20""")
def select_chains(spark, d):
    return C.select_chains(P.groups(spark, d), P.test_ids(spark, d), 20).select("pdb_id", "chain_key", "L")


@query("pick_chains", f"WITH {CHAINS_SQL} SELECT chain_key, chain_id, L FROM all_chains WHERE chain_id IN ('A')")
def pick_chains(spark, d):
    return C.pick_chains(C.all_chains(_residues(spark, d)), ["A"]).select("chain_key", "chain_id", "L")


def _point_sql(name: str) -> str:
    at = f"max(CASE WHEN atom = '{name}' AND place = 1 THEN {{0}} END)"
    return ", ".join(f"{at.format(axis)} AS {name.lower()}_{axis}" for axis in "xyz")


@query("backbone_pivot", f"""WITH {RESIDUES_SQL} SELECT pdb_id, chain_id, res_no, res_name,
    {_point_sql('N')}, {_point_sql('CA')}, {_point_sql('C')} FROM best GROUP BY ALL""")
def backbone_pivot(spark, d):
    pivoted = structures.backbone_pivot(structures.best_locations(_good(spark, d)))
    return pivoted.select("pdb_id", "chain_id", "res_no", "res_name", *[
        F.col(f"{atom}.{axis}").alias(f"{atom}_{axis}") for atom in ("n", "ca", "c") for axis in "xyz"])


@query("complex_map", f"""WITH {CHAINS_SQL} SELECT pdb_id, max(seq) FILTER (WHERE chain_id = 'A') AS seq_a,
    max(seq) FILTER (WHERE chain_id = 'B') AS seq_b, count(*) AS n_chains FROM all_chains GROUP BY pdb_id""")
def complex_map(spark, d):
    return C.complex_map(C.all_chains(_residues(spark, d))).select(
        "pdb_id", F.col("seqs")["A"].alias("seq_a"), F.col("seqs")["B"].alias("seq_b"), "n_chains")


@query("concat_chains", f"""WITH {P.BACKBONE_SQL},
lengths AS (SELECT pdb_id, chain_id, count(*) AS L FROM backbone GROUP BY ALL),
offsets AS (SELECT *, coalesce(sum(L + 10) OVER (PARTITION BY pdb_id ORDER BY (chain_id <> 'B')::INT, chain_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM lengths
    WHERE pdb_id IN (SELECT pdb_id FROM lengths WHERE chain_id = 'B'))
SELECT pdb_id, (shift + pos)::INT AS at, chain_id, pos, {', '.join(f"round({a}.{x}, 6) + 0.0 AS {a}_{x}" for a in ('n', 'ca', 'c') for x in 'xyz')}
FROM backbone JOIN offsets USING (pdb_id, chain_id)
UNION ALL SELECT pdb_id, (shift - k)::INT, {', '.join(['NULL'] * 11)} FROM offsets, range(1, 11) t(k) WHERE shift > 0""")
def concat_chains(spark, d):
    return C.concat_chains(P.backbone(spark, d), "B").select(
        "pdb_id", "at", "chain_id", "pos", *[r6(F.col(f"{a}.{x}")).alias(f"{a}_{x}") for a in ("n", "ca", "c") for x in "xyz"])


@query("multimer_encode", f"""WITH turns AS (SELECT conv_id AS key, turn, {P.clean_sql('text')} AS seq FROM conversations),
placed AS (SELECT *, coalesce(sum(length(seq) + 25) OVER (PARTITION BY key ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, row_number() OVER (PARTITION BY key ORDER BY turn) - 1 AS c,
    turn = max(turn) OVER (PARTITION BY key) AS last FROM turns),
letters AS (SELECT key, start, c, length(seq) AS own, unnest(range(0, length(seq) + CASE WHEN last THEN 0 ELSE 25 END)) AS k,
    seq || 'GGGGGGGGGGGGGGGGGGGGGGGGG' AS text FROM placed)
SELECT key, (start + k)::INT AS pos, (strpos('{AMINO_ACIDS}', text[k + 1]) - 1)::INT AS code, (start + k + c * 512)::INT AS residue_index,
    (k < own)::INT AS linker_mask, c::INT AS chain_index FROM letters""")
def multimer_encode(spark, d):
    """Each conversation is a complex, its turns (in order, whole) are the chains."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "seq"))), lambda r: r["seq"])
    complexes = P.table(spark, d, "conversations").select("conv_id", "turn", P.clean(F.col("text")).alias("seq")).groupBy(
        F.col("conv_id").alias("key")).agg(F.array_join(turns, ":").alias("seq"))
    return C.encode_multimer(complexes, AMINO_ACIDS).withColumn("chain_index", F.col("chain_index").cast("int"))
