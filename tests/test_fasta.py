import pytest

from strandlake.sources import fasta


def write(path, text):
    path.write_bytes(text.encode())


def test_folder(spark, tmp_path):
    write(tmp_path / "test_class.fasta", ">seq1\nACGTACGT\n>seq2 more words\nTGCA\ntgca\n")
    write(tmp_path / "other.v2.FA", ">J.CD.2002 x > y\r\nAC GT\r\n\r\nNN\r\n>empty\r\n")
    write(tmp_path / "notes.txt", ">no\nACGT\n")
    got = sorted((r["sequence_name"], r["class"], r["length"], r["seq"]) for r in fasta.read_fasta(spark, str(tmp_path)).collect())
    assert got == [("J.CD.2002 x > y", "other.v2", 6, "ACGTNN"), ("empty", "other.v2", 0, ""), ("seq1", "test_class", 8, "ACGTACGT"), ("seq2 more words", "test_class", 8, "TGCATGCA")]
    by_header = {r["class"] for r in fasta.read_fasta(spark, str(tmp_path / "other.v2.FA"), "header").collect()}
    assert by_header == {"J", "empty"}


def test_records_over_small_splits(spark, tmp_path):
    want = {}
    lines = []
    for i in range(40):
        seq = ("ACGT" * 9)[i % 5 : 20 + i % 13]
        want[f"s{i}"] = seq * 3
        lines.append(f">s{i}\n" + f"{seq}\n" * 3)
    write(tmp_path / "a.fna", "".join(lines))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert {r["sequence_name"]: r["seq"] for r in fasta.read_fasta(spark, str(tmp_path)).collect()} == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="No fasta files found in"):
        fasta.read_fasta(spark, str(tmp_path)).collect()
    assert fasta.empty_sequences(spark).columns == ["seq_id", "sequence_name", "class", "length", "seq"]


def test_checkpoint_sink(spark, tmp_path):
    fasta.save_checkpoint({"x": spark.range(3)}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/x").count() == 3


def test_flat_reader_keeps_the_last_of_a_name(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one x\nACGT\n>two\nAAAA\n>one y\nCCCC\n")
    (tmp_path / "b.fasta").write_text(">two z\nGGGG\n")
    got = {r["sequence_name"]: (r["seq"], r["class"]) for r in fasta.read_flat(spark, str(tmp_path)).collect()}
    assert got == {"one": ("CCCC", "a"), "two": ("GGGG", "b")}
