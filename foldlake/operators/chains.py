"""Chains: assembly, selection, complexes and their concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CONTACT_CUTOFF, MIN_CHAIN_LENGTH, MIN_SEPARATION


def _in_order(position: str, *fields: str) -> Column:
    """The rows of a group as an array of structs sorted by position."""
    return F.array_sort(F.collect_list(F.struct(position, *fields)))


def all_chains(residues: DataFrame) -> DataFrame:
    """One row per chain of a file: its residue string, length and number of residues with CA."""
    letters = F.transform(_in_order("pos", "aa"), lambda r: r["aa"])
    keys = [c for c in ("chain_key", "pdb_id", "chain_id", "path") if c in residues.columns]
    return residues.groupBy(*keys).agg(
        F.array_join(letters, "").alias("seq"), F.count(F.lit(1)).cast("int").alias("L"),
        F.count_if("has_ca").cast("int").alias("n_ca"),
    )


def assemble_chains(residues: DataFrame, min_len: int = MIN_CHAIN_LENGTH, cutoff: float = CONTACT_CUTOFF,
                    min_sep: int = MIN_SEPARATION) -> DataFrame:
    """Chain records: chains of at least ``min_len`` residues with at least one CA, their source and the contact parameters."""
    chains = all_chains(residues).filter((F.col("L") >= min_len) & (F.col("n_ca") > 0))
    return chains.withColumnRenamed("path", "source_path").withColumns({"cutoff": F.lit(cutoff), "min_sep": F.lit(min_sep)})


def select_chains(chains: DataFrame, ids: DataFrame, min_len: int = 0) -> DataFrame:
    """Chains of listed structures that are long enough."""
    return chains.filter(F.col("L") >= min_len).join(ids.select("pdb_id"), "pdb_id", "left_semi")


def fetch(keys: DataFrame, chains: DataFrame, key: str = "chain_key") -> DataFrame:
    """Chain records for a table of keys; Spark picks the join by size."""
    return keys.join(chains.withColumnRenamed("chain_key", key), key)


def pick_chains(chains: DataFrame, chain_ids: list[str] | str | None = None) -> DataFrame:
    """All chains, or those with the given chain ids; a chain id no structure has is an error."""
    if chain_ids is None:
        return chains
    wanted = [chain_ids] if isinstance(chain_ids, str) else list(chain_ids)
    present = {r[0] for r in chains.filter(F.col("chain_id").isin(wanted)).select("chain_id").distinct().take(len(wanted))}
    missing = [c for c in wanted if c not in present]
    if missing:
        raise ValueError(f"chain {missing[0]} not found")
    return chains.filter(F.col("chain_id").isin(wanted))


def complex_map(chains: DataFrame) -> DataFrame:
    """Structures as a map from chain id to residue string."""
    entries = F.array_sort(F.collect_list(F.struct("chain_id", "seq")))
    return chains.groupBy("pdb_id").agg(
        F.map_from_entries(entries).alias("seqs"), F.count(F.lit(1)).alias("n_chains"))


def concat_chains(backbone: DataFrame, target: str, pad: int = 10) -> DataFrame:
    """Chains of each structure end to end, the target chain first, ``pad`` empty rows between.

    Structures without the target chain are left out. Offsets are computed on
    one row per chain, so only the join touches the residues.
    """
    lengths = backbone.groupBy("pdb_id", "chain_id").agg(F.count(F.lit(1)).cast("int").alias("L"))
    has_target = lengths.filter(F.col("chain_id") == target).select("pdb_id")
    first = F.when(F.col("chain_id") == target, 0).otherwise(1)
    ordered = Window.partitionBy("pdb_id").orderBy(first, "chain_id")
    offsets = lengths.join(has_target, "pdb_id", "left_semi").select(
        "pdb_id", "chain_id", "L",
        F.coalesce(F.sum(F.col("L") + pad).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        (F.row_number().over(ordered) == 1).alias("leads"),
    )
    placed = backbone.join(offsets.select("pdb_id", "chain_id", "offset"), ["pdb_id", "chain_id"]).select(
        "pdb_id", (F.col("offset") + F.col("pos")).cast("int").alias("at"), "chain_id", "pos", "n", "ca", "c")
    gaps = offsets.filter(~F.col("leads")).select(
        "pdb_id", F.explode(F.sequence(F.col("offset") - pad, F.col("offset") - 1)).alias("at"))
    return placed.unionByName(gaps.withColumn("at", F.col("at").cast("int")), allowMissingColumns=True)


def encode_multimer(df: DataFrame, alphabet: str, offset: int = 512, linker: str = "G" * 25) -> DataFrame:
    """Residues of ':'-separated chains joined by a linker.

    Per position: letter code (unknown letters get the code after the last),
    residue index moved by ``offset`` per chain, 0/1 linker mask and the chain
    number. A linker belongs to the chain in front of it.
    """
    width = len(linker)
    parts = F.split("seq", ":")
    # One pass that carries where the next chain starts.
    empty = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<chain:int,start:int,own:int,text:string>>").alias("done"))

    def append(acc, part):
        n, last = F.size(acc["done"]), F.size(acc["done"]) == F.size(parts) - 1
        piece = F.struct(n.alias("chain"), acc["next"].alias("start"), F.length(part).alias("own"),
                         F.when(last, part).otherwise(F.concat(part, F.lit(linker))).alias("text"))
        return F.struct((acc["next"] + F.length(part) + width).alias("next"), F.concat(acc["done"], F.array(piece)).alias("done"))

    pieces = F.aggregate(parts, empty, append, lambda acc: acc["done"])
    chains = df.select("key", F.explode(pieces).alias("z"))
    letters = chains.select("key", F.col("z.chain").alias("chain_index"), F.col("z.start").alias("start"), F.col("z.own").alias("own"),
                            F.posexplode(F.filter(F.split("z.text", ""), lambda c: c != "")).alias("k", "aa"))
    code = F.call_function("locate", F.col("aa"), F.lit(alphabet)) - 1
    return letters.select(
        "key", (F.col("start") + F.col("k")).cast("int").alias("pos"),
        F.when(code < 0, len(alphabet)).otherwise(code).cast("int").alias("code"),
        (F.col("start") + F.col("k") + F.col("chain_index") * offset).cast("int").alias("residue_index"),
        F.when(F.col("k") < F.col("own"), 1).otherwise(0).alias("linker_mask"), "chain_index",
    )
