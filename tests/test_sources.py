"""Files in, tables out."""

import os
import re
import shutil
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from foldlake.operators import chains, splits
from foldlake.plans import proxies as P
from foldlake.session import stored, temporary_tables
from foldlake.sources import fasta, ids, ingest, structures
from foldlake.streaming import ingest_stream
from foldlake.streaming.ingest_stream import ingest_available


@pytest.fixture(scope="module")
def structure_dir(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("structures")
    for row in P.structure_files(spark, sf_dir).collect():
        sub = folder / row.pdb_id[-1]
        sub.mkdir(exist_ok=True)
        (sub / f"{row.pdb_id}.pdb").write_text(row.value)
    (folder / "notes.txt").write_text("not a structure")
    return str(folder)


def test_files_equal_lines(spark, sf_dir, structure_dir):
    def rows(lines):
        atoms = structures.split_rejects(structures.parse_atoms(lines), "record")[0]
        return sorted(map(tuple, structures.residues(atoms).drop("path").collect()), key=str)

    read = structures.structure_lines(structures.read_structures(spark, structure_dir))
    assert rows(read) == rows(P.structure_lines(spark, sf_dir))


def test_only_the_first_model_counts(spark):
    texts = ["MODEL        1\nA\nB\nENDMDL\nMODEL        2\nC\nENDMDL\n", "X\nMODEL        1\nA\nMODEL        2\nC\n", "A\r\nB"]
    files = spark.createDataFrame([(str(k), "f", t) for k, t in enumerate(texts)], "pdb_id string, path string, value string")
    got = {}
    for r in structures.structure_lines(files).orderBy("pdb_id", "line_no").collect():
        got.setdefault(r.pdb_id, []).append(r.line)
    assert got == {"0": ["MODEL        1", "A", "B"], "1": ["X", "MODEL        1", "A"], "2": ["A", "B"]}


def test_broken_records_are_kept_apart(spark, structure_dir):
    atoms = structures.parse_atoms(structures.structure_lines(structures.read_structures(spark, structure_dir)))
    good, bad = structures.split_rejects(atoms, "record")
    assert bad.count() > 0 and good.count() + bad.count() == atoms.count()
    whole, same = structures.split_rejects(atoms)
    assert same.count() == bad.count()
    assert {r.pdb_id for r in whole.select("pdb_id").distinct().collect()} == {"P0", "P2", "P3", "P4"}
    summary = structures.ingest_summary(atoms, chains.all_chains(structures.residues(structures.usable(atoms))), 20).first()
    assert (summary.files, summary.failed, summary.repeated, summary.saved, summary.skipped) == (5, 1, 0, 8, 0)
    with pytest.raises(ValueError):
        structures.split_rejects(atoms, "chain")


def test_two_files_of_one_stem(spark):
    def lines(path, name):
        return [("P", path, k, f"ATOM      {k}  CA  {name} A   {k}       1.000   2.000   3.000  1.00") for k in (1, 2, 3)]

    table = spark.createDataFrame(lines("/b/P.pdb", "TRP") + lines("/a/P.pdb", "GLY"), "pdb_id string, path string, line_no int, line string")
    atoms = structures.parse_atoms(table)
    assert sorted(r.seq for r in chains.all_chains(structures.residues(atoms)).collect()) == ["GGG", "WWW"]
    assert [r.seq for r in chains.all_chains(structures.residues(structures.usable(atoms))).collect()] == ["GGG"]
    assert {r.path: r.state for r in structures.file_states(atoms).collect()} == {"/a/P.pdb": "ok", "/b/P.pdb": "repeated"}
    assert structures.backbone_pivot(atoms).count() == 6


def test_repeated_atom_stops_the_job(spark):
    line = "ATOM      1  CA  ALA A   1       1.000   2.000   3.000  1.00"
    lines = spark.createDataFrame([("p", "p.pdb", k, line) for k in (0, 1)], "pdb_id string, path string, line_no int, line string")
    with pytest.raises(Exception, match="several atoms of one name"):
        structures.backbone_pivot(structures.parse_atoms(lines)).collect()


def test_chain_selection(spark):
    df = spark.createDataFrame([("p_A", "A"), ("p_B", "B")], "chain_key string, chain_id string")
    assert chains.pick_chains(df).count() == 2
    assert [r.chain_id for r in chains.pick_chains(df, "B").collect()] == ["B"]
    with pytest.raises(ValueError, match="chain Z not found"):
        chains.pick_chains(df, ["A", "Z"])


def test_chain_sink_and_increment(spark, sf_dir, tmp_path):
    table = chains.all_chains(P.points(spark, sf_dir))
    target = str(tmp_path / "chains")
    ingest.write_chains(table.filter("chain_id = 'A'"), target, buckets=4)
    known = spark.read.parquet(target)
    fresh = stored(ingest.ingest(table, known))
    assert {r.chain_id for r in fresh.collect()} == {"B"}
    counts = ingest.ingest_counts(table, known).first()
    assert (counts.saved, counts.skipped) == (5, 5)
    ingest.write_chains(fresh, target, buckets=4, mode="append")
    assert spark.read.parquet(target).count() == table.count()
    assert ingest.ingest(table, known, overwrite=True).count() == table.count()


def test_stream_reads_each_file_once(spark, structure_dir, tmp_path):
    sink, state = str(tmp_path / "atoms"), str(tmp_path / "state")
    for _ in range(2):
        ingest_available(spark, structure_dir, sink, state).awaitTermination()
    direct = structures.parse_atoms(structures.structure_lines(structures.read_structures(spark, structure_dir)))
    stored = spark.read.parquet(sink)
    assert stored.count() == direct.count()
    assert stored.filter("broken = 'true'").count() == structures.split_rejects(direct)[1].count() > 0


class Stopped(Exception):
    pass


def test_stream_build_equals_the_batch_build(spark, structure_dir, tmp_path):
    """A stop between write and commit, a repeated file, and a second file of one stem."""
    source, sink, state = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "state")
    shutil.copytree(structure_dir, source)

    def run(stop=None):
        query = ingest_stream.build_chains(ingest_stream.stream_structures(spark, str(source), files_per_trigger=2), sink, state, before_commit=stop)
        query.awaitTermination()

    def stop(number):
        if number == 1:
            raise Stopped("between write and commit")

    with pytest.raises(Exception, match="between write and commit"):
        run(stop)
    assert {r.batch for r in ingest_stream.read_files(spark, sink).collect()} == {0}
    half = ingest_stream.read_chains(spark, sink).count()
    assert half < spark.read.parquet(f"{sink}/chains").count()  # what the stopped batch wrote is there, but does not count
    run()
    first = ingest_stream.read_chains(spark, sink).count()

    whole = next(p for p in source.rglob("P2.pdb"))
    (source / "zz").mkdir()
    shutil.copy(whole, source / "zz" / "P2.pdb")  # a second file of one stem
    os.utime(next(p for p in source.rglob("P0.pdb")))  # a file that comes again
    run()
    run()
    assert ingest_stream.read_chains(spark, sink).count() == first

    atoms = structures.parse_atoms(structures.structure_lines(structures.read_structures(spark, str(source))))
    batch = chains.assemble_chains(structures.residues(structures.usable(atoms)))
    columns = sorted(batch.columns)
    assert sorted(map(tuple, ingest_stream.read_chains(spark, sink).select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))
    counts = ingest_stream.build_counts(ingest_stream.read_files(spark, sink).dropDuplicates(["path"])).first()
    want = structures.ingest_summary(atoms, chains.all_chains(structures.residues(structures.usable(atoms))), 20).first()
    assert counts.asDict() == want.asDict()


def test_records_counted_in_whole_texts(spark, structure_dir):
    files = structures.read_structures(spark, structure_dir)
    records, broken = structures.record_counts(F.col("value"))
    got = {tuple(r) for r in files.select("path", records, broken).collect()}
    want = structures.file_states(structures.parse_atoms(structures.structure_lines(files))).select("path", "records", "broken")
    assert got == {tuple(r) for r in want.collect()}


FASTA = "skip me\n>first one\nACD\nEFG\n\n>\nKKK\n>last\n"


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(FASTA)
    rows = fasta.read_fasta(spark, str(tmp_path)).orderBy("record_no").collect()
    assert [(r.label, r.seq) for r in rows] == [("first one", "ACDEFG"), ("seqnum000000005", "KKK"), ("last", "")]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_split_reading_equals_whole_files(small_splits, tmp_path):
    spark = small_splits
    texts = {
        "named": "".join(f">s{k} x\n{'ACDE' * (k % 5 + 1)}\nGG\n" for k in range(700)),
        "unnamed": "preamble\n\n" + "".join(f">{' ' if k % 3 else 'n%d' % k}\n" + "AC\n" * (k % 7) + "\n" * (k % 2) for k in range(900)),
        "windows": "".join(f">{'' if k % 4 == 1 else 'w%d' % k}\r\nAC\r\nDE\r\n" for k in range(500)),
        "long": ">one\n" + "ACDEFGHIKL\n" * 2000 + ">\n" + "W" * 9000 + "\n>last",
        "none": "no record at all\n", "empty": "", "marks": ">\n>\n>\nA",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.fasta").write_bytes(text.encode())
    whole = fasta.fasta_records(fasta.read_fasta_files(spark, str(tmp_path)))
    split = fasta.read_fasta(spark, str(tmp_path))
    assert split.columns == whole.columns
    got, want = (sorted(map(tuple, df.collect())) for df in (split, whole))
    assert got == want and len(want) == 700 + 900 + 500 + 3 + 3
    places = spark.read.format("text").option("lineSep", "\n>").load(str(tmp_path / "long.fasta")).select("_metadata.file_block_start").distinct()
    assert places.count() > 1


def test_duplicate_labels(spark):
    files = spark.createDataFrame([("f", ">a\nA\n>a\nC\n")], "path string, value string")
    with pytest.raises(ValueError, match="duplicate sequence label"):
        fasta.require_unique_labels(fasta.fasta_records(files))


def test_alignment_options(spark):
    df = spark.createDataFrame([("A-cD.e",)], "seq string")
    assert fasta.clean_alignment(df).first()[0] == "A-cD.e"
    assert fasta.clean_alignment(df, keep_gaps=False, keep_insertions=False).first()[0] == "AD."
    assert fasta.clean_alignment(df, to_upper=True).first()[0] == "A-CD.E"


def test_id_list_round_trip(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("1ABC \n\n  2XYZ\n\t\n")
    table = ids.read_ids(spark, str(tmp_path / "ids.txt"))
    ids.write_ids(table, str(tmp_path / "out"))
    assert sorted(r[0] for r in ids.read_ids(spark, str(tmp_path / "out")).collect()) == ["1ABC", "2XYZ"]


def test_multimer_small(spark):
    df = spark.createDataFrame([("k", "AC:D")], "key string, seq string")
    rows = chains.encode_multimer(df, "ACD", offset=100, linker="GG").orderBy("pos").collect()
    assert [r.code for r in rows] == [0, 1, 3, 3, 2]
    assert [r.residue_index for r in rows] == [0, 1, 2, 3, 104]
    assert [r.linker_mask for r in rows] == [1, 1, 0, 0, 1]
    assert [r.chain_index for r in rows] == [0, 0, 0, 0, 1]


def test_fetch_reads_only_the_buckets_asked_for(spark, sf_dir, tmp_path):
    table = P.groups(spark, sf_dir)
    target = str(tmp_path / "sink")
    ingest.write_chains(table, target, buckets=32)
    keys = table.filter("doc_id in (3, 17)").select("chain_key", F.col("doc_id").alias("asked"))
    got = ingest.fetch_stored(spark, keys, target, buckets=32)
    assert sorted((r.chain_key, r.asked, r.doc_id) for r in got.collect()) == sorted((r.chain_key, r.asked, r.asked) for r in keys.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: [^\n]*array_contains\((Reused)?Subquery[^\n]*bucket", plan)
    read = [m.getValue().value() for m in _metrics(got._jdf.queryExecution().executedPlan()) if m.getKey() == "numPartitions"]
    assert read and max(read) <= 2


def _metrics(plan):
    """Metrics of all scans of an executed plan."""
    nodes, found = [plan], []
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            nodes.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            found += _java_list(node.metrics().toSeq())
        nodes += _java_list(node.children())
    return [_Entry(m) for m in found]


class _Entry:
    def __init__(self, pair):
        self.pair = pair

    def getKey(self):
        return self.pair._1()

    def getValue(self):
        return self.pair._2()


def _java_list(seq):
    return [seq.apply(k) for k in range(seq.size())]


def test_a_build_counts_what_it_writes(spark, sf_dir, tmp_path):
    atoms = structures.parse_atoms(P.ingest_lines(spark, sf_dir))
    counts = ingest.write_build(atoms, str(tmp_path / "built"), 47)
    built = chains.all_chains(structures.residues(structures.usable(atoms)))
    assert counts == structures.ingest_summary(atoms, built, 47).first().asDict()
    assert spark.read.parquet(str(tmp_path / "built")).count() == counts["saved"]


# ---------------------------------------------------------------- stored splits

def _split_ids(spark, n=50):
    return spark.range(n).select(F.col("id").cast("string").alias("pdb_id"))


def test_only_a_complete_split_counts(spark, tmp_path):
    half = tmp_path / "tag=t"
    spark.createDataFrame([("x", "val")], "pdb_id string, split string").write.parquet(str(half))
    (half / "_SUCCESS").unlink()  # as a writer leaves it that stops half-way
    assert not splits.published(spark, str(tmp_path), "tag=t")
    made = splits.named_split(spark, str(tmp_path), "t", _split_ids(spark))
    assert made.count() == 50 and splits.published(spark, str(tmp_path), "tag=t")
    assert sorted(map(tuple, splits.named_split(spark, str(tmp_path), "t", _split_ids(spark, 3)).collect())) == sorted(map(tuple, made.collect()))


def test_the_first_of_two_writers_wins(spark, tmp_path):
    one, two = (spark.createDataFrame([(w, "val")], "pdb_id string, split string") for w in ("one", "two"))
    assert splits.publish(one, str(tmp_path), "tag=t") and not splits.publish(two, str(tmp_path), "tag=t")
    assert [r.pdb_id for r in splits.named_split(spark, str(tmp_path), "t", _split_ids(spark)).collect()] == ["one"]
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda k: splits.publish(_split_ids(spark, k + 1), str(tmp_path), "tag=race"), range(4)))
    assert won.count(True) == 1
    assert spark.read.parquet(str(tmp_path / "tag=race")).count() == won.index(True) + 1


def test_other_read_errors_pass_through(spark, tmp_path):
    (tmp_path / "tag=t").mkdir()
    (tmp_path / "tag=t" / "_SUCCESS").touch()
    (tmp_path / "tag=t" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        splits.named_split(spark, str(tmp_path), "t", _split_ids(spark)).collect()


def test_temporary_tables_are_removed(spark):
    with temporary_tables(spark) as outer:
        kept = stored(spark.range(3))
        with temporary_tables(spark) as inner:
            assert stored(spark.range(5)).count() == 5
        assert len(inner) == 1 and not os.path.exists(inner[0])
        assert len(outer) == 2 and kept.count() == 3
    assert not any(os.path.exists(folder) for folder in outer)
    assert stored(spark.range(2)).count() == 2


def test_list_of_a_batch_is_not_made_in_one_task(spark, sf_dir, monkeypatch):
    """The rows of the list move to one task after they are made; with coalesce all that makes them would run there."""
    from foldlake.plans.structures import ingest_streamed

    def stop(*_):
        raise AssertionError("coalesce")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", stop)
    assert ingest_streamed(spark, sf_dir).count() >= 0
