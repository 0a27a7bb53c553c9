"""Structure text: files, atom records, residues, backbone atoms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import RESIDUE_LETTERS
from ..session import stored


def read_structures(spark: SparkSession, path: str, glob: str = "*.pdb") -> DataFrame:
    """Structure files below ``path``: pdb_id (file stem), path, whole text."""
    files = (spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).load(path))
    return files.select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("pdb_id"),
        F.col("_metadata.file_path").alias("path"), "value",
    )


def _first_model(value: Column) -> Column:
    """Lines of the first model of a whole text."""
    marked = F.concat(F.lit("\n"), value)
    model = F.substring_index(F.substring_index(marked, "\nENDMDL", 1), "\nMODEL ", 2)
    return F.split(F.substring(model, 2, 2**31 - 1), "\r?\n")


def structure_lines(files: DataFrame) -> DataFrame:
    """Lines of the first model, numbered from 0 in file order.

    A file is one row here, so the order of its lines never depends on a shuffle
    and the later models are cut off before any line is made a row.
    """
    return files.select("pdb_id", "path", F.posexplode(_first_model(F.col("value"))).alias("line_no", "line"))


def _field(line: Column, start: int, stop: int) -> Column:
    """Fixed columns ``start`` to ``stop`` of a record, from 1."""
    return F.trim(F.substring(line, start, stop - start + 1))


def _is_atom(line: Column) -> Column:
    return _field(line, 1, 6).isin("ATOM", "HETATM")


#: Fixed columns of the numbers without which a record is broken: residue number and coordinates.
_NUMBERS = {"res_no": (23, 26, "int"), "x": (31, 38, "double"), "y": (39, 46, "double"), "z": (47, 54, "double")}


def parse_atoms(lines: DataFrame) -> DataFrame:
    """Atom records by fixed columns; numbers that do not parse become NULL."""
    def field(start: int, stop: int):
        return _field(F.col("line"), start, stop)

    numbers = {name: field(start, stop).try_cast(kind).alias(name) for name, (start, stop, kind) in _NUMBERS.items()}
    return lines.filter(_is_atom(F.col("line"))).select(
        "pdb_id", "path", "line_no",
        (field(1, 6) == "HETATM").alias("hetero"),
        field(13, 16).alias("atom"), field(17, 17).alias("altloc"), field(18, 20).alias("res_name"),
        field(22, 22).alias("chain_id"), numbers["res_no"], field(27, 27).alias("icode"),
        numbers["x"], numbers["y"], numbers["z"], F.coalesce(field(55, 60).try_cast("double"), F.lit(1.0)).alias("occupancy"),
    )


def record_counts(value: Column) -> tuple[Column, Column]:
    """How many atom records a whole text has, and how many of them are broken, without making them rows."""
    atoms = F.filter(_first_model(value), _is_atom)
    bad = lambda line: reduce(Column.__or__, [_field(line, start, stop).try_cast(kind).isNull() for start, stop, kind in _NUMBERS.values()])
    return F.size(atoms).cast("bigint"), F.size(F.filter(atoms, bad)).cast("bigint")


def broken() -> Column:
    """Whether a record lacks its residue number or a coordinate."""
    return reduce(Column.__or__, [F.col(name).isNull() for name in _NUMBERS])


def split_rejects(atoms: DataFrame, reject: str = "file") -> tuple[DataFrame, DataFrame]:
    """(usable records, broken records).

    ``file``: a file with a broken record gives no record at all; ``record``: only the broken ones are left out.
    Either way the other files are not held up.
    """
    bad = atoms.filter(broken())
    if reject == "record":
        return atoms.filter(~broken()), bad
    if reject != "file":
        raise ValueError(f"reject must be file or record, not {reject!r}")
    return atoms.join(bad.select("path").distinct(), "path", "left_anti").select(*atoms.columns), bad


def file_states(atoms: DataFrame) -> DataFrame:
    """pdb_id, path, records, broken and state of each file: ``ok``, ``broken`` or ``repeated``.

    Of several unbroken files with one stem, the one with the first path is taken, the others are repeated.
    """
    files = atoms.groupBy("pdb_id", "path").agg(F.count(F.lit(1)).alias("records"), F.count_if(broken()).alias("broken"))
    first = files.filter("broken = 0").groupBy("pdb_id").agg(F.min("path").alias("first"))
    state = F.when(F.col("broken") > 0, "broken").when(F.col("path") == F.col("first"), "ok").otherwise("repeated")
    return files.join(first, "pdb_id", "left").select("pdb_id", "path", "records", "broken", state.alias("state"))


def usable(atoms: DataFrame) -> DataFrame:
    """Records of the files whose state is ``ok``. The files are parsed once: what is parsed is stored, judged, and read again."""
    parsed = stored(atoms)
    return parsed.join(file_states(parsed).filter("state = 'ok'").select("path"), "path", "left_semi").select(*atoms.columns)


def ingest_summary(atoms: DataFrame, chains: DataFrame, min_len: int) -> DataFrame:
    """Files read, broken and repeated files, chains kept and chains too short or without CA."""
    kept = (F.col("L") >= min_len) & (F.col("n_ca") > 0)
    files = file_states(atoms).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("state") == "broken").alias("failed"),
                                   F.count_if(F.col("state") == "repeated").alias("repeated"))
    made = chains.agg(F.count_if(kept).alias("saved"), F.count_if(~kept).alias("skipped"))
    return files.select("*", *[made.select(n).scalar().alias(n) for n in ("saved", "skipped")])


def _residue_letters(spark: SparkSession) -> DataFrame:
    """Residue names and letters: a table of 23 rows."""
    return spark.createDataFrame(sorted(RESIDUE_LETTERS.items()), "res_name string, aa string")


def residues(atoms: DataFrame) -> DataFrame:
    """One row per standard residue, numbered within its chain after filtering.

    Of several locations of an atom the most occupied wins, then the first.
    """
    letters = F.broadcast(_residue_letters(atoms.sparkSession))
    rank = F.when(F.col("atom") == "CA", F.struct(F.col("occupancy"), (-F.col("line_no")).alias("first")))
    grouped = (
        atoms.filter(~F.col("hetero")).join(letters, "res_name")
        .groupBy("pdb_id", "path", "chain_id", "res_no", "icode", "res_name", "aa")
        .agg(F.min("line_no").alias("first_line"), F.max_by(F.struct("x", "y", "z"), rank).alias("ca"))
    )
    in_chain = Window.partitionBy("pdb_id", "path", "chain_id").orderBy("first_line")
    return grouped.select(
        "pdb_id", "chain_id", F.concat_ws("_", "pdb_id", "chain_id").alias("chain_key"), "path",
        (F.row_number().over(in_chain) - 1).alias("pos"), "aa",
        F.col("ca.x").alias("x"), F.col("ca.y").alias("y"), F.col("ca.z").alias("z"),
        F.col("ca").isNotNull().alias("has_ca"),
    )


def backbone_pivot(atoms: DataFrame, wanted=("N", "CA", "C")) -> DataFrame:
    """Backbone atoms side by side per residue; a missing atom is NULL.

    An atom name met twice in a residue is an error that stops the job.
    """
    def place(name: str):
        mine = F.col("atom") == name
        twice = F.raise_error(F.lit("structure has several atoms of one name in a residue"))
        point = F.max(F.when(mine, F.struct("x", "y", "z")))
        return F.when(F.count_if(mine) > 1, twice.cast("struct<x:double,y:double,z:double>")).otherwise(point).alias(name.lower())

    return atoms.filter(~F.col("hetero") & F.col("atom").isin(*wanted)).groupBy(
        "pdb_id", "path", "chain_id", "res_no", "icode", "res_name").agg(*[place(w) for w in wanted])


def best_locations(atoms: DataFrame) -> DataFrame:
    """Keep one location of each atom: the most occupied, then the first."""
    rank = F.struct(F.col("occupancy"), (-F.col("line_no")).alias("first"))
    keys = ["pdb_id", "path", "hetero", "chain_id", "res_no", "icode", "res_name", "atom"]
    rest = ["line_no", "altloc", "x", "y", "z", "occupancy"]
    best = atoms.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest])
