import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom import ColumnTypeError, EmptyFileError, GenomeFileError, RangeFrame, UnsupportedFormatError
from spanloom.functions.nucleotide import gc_content_strict
from spanloom.operators import sequences as Q
from spanloom.sources import random as rnd
from spanloom.sources import sequences as src
from spanloom.sources import text as txt


@pytest.fixture
def put(tmp_path):
    def f(name, content, gz=False):
        p = tmp_path / name
        p.write_bytes(gzip.compress(content.encode()) if gz else content.encode())
        return p

    return f


def test_extensions():
    assert [txt.base_extension(p) for p in ("test.bed.gz", "some/path/test.gff.gz", "test", "a.b/test", "x.bed.bgz", "x.gz")] == ["bed", "gff", None, None, "bed", "gz"]


def test_detect(put):
    assert txt.detect(put("a.bed", "# c\nchr1\t1\t2\n")) == "bed3"
    assert txt.detect(put("b.bed", "chr1\t1\t2\tn\n")) == "bed4"
    assert txt.detect(put("c.bed", "chr1\t1\t2\tn\t.\t+\n")) == "bed5"
    assert txt.detect(put("d.tsv", "chr1\t1\t2\t3\t4\t5\n")) == "bedlike"
    assert txt.detect(put("e.txt", "chr1\t1\t2\n")) == "bedlike"
    assert txt.detect(put("f.bed.gz", "chr1\t1\t2\tn\tx\n", gz=True)) == "bed4"
    for bad, err in ((put("g.bed", "chr1\t-1\t2\n"), UnsupportedFormatError), (put("noext", "chr1\t1\t2\n"), UnsupportedFormatError), (put("h.bed", "# only\n"), EmptyFileError), (put("i.bed", ""), EmptyFileError)):
        with pytest.raises(err):
            txt.detect(bad)
    assert txt.valid_bedlike(put("j.tsv", "chr1\tx\t2\n")) is False


def test_seqlens(spark, put):
    got = [tuple(r) for r in txt.read_seqlens(spark, put("g.tsv", "chr2\t5\nchr1\t7\n", gz=True)).orderBy("ord").collect()]
    assert got == [("chr2", 5, 0), ("chr1", 7, 1)]
    for bad in ("chr1\t5\nchr1\t6\n", "chr1\n", "#c\t\n"):
        with pytest.raises(GenomeFileError):
            txt.read_seqlens(spark, put("bad.tsv", bad))


def test_preamble(put):
    p = txt.preamble(put("p.tsv", "#a\n#b\nchrom\tstart\nchr1\t1\t2\n"), header="chrom")
    assert (p.metadata, p.header, p.columns) == (["#a", "#b"], "chrom\tstart", 3)


@pytest.mark.parametrize(("name", "gz"), [("x.bed", False), ("x.bed.gz", True), ("misnamed.bed", True)])
def test_bed_scans(spark, put, rows, name, gz):
    p = put(name, "# c\nchr1\t1\t5\t.\t.\t+\nchr2\t3\t9\tb\t2.5\t-\textra\n\n", gz)
    assert rows(txt.read_bed3(spark, p)) == [("chr1", 1, 5), ("chr2", 3, 9)]
    assert rows(txt.read_bed4(spark, p)) == [("chr1", 1, 5, "."), ("chr2", 3, 9, "b")]
    assert rows(txt.read_bed5(spark, p)) == [("chr1", 1, 5, ".", None), ("chr2", 3, 9, "b", 2.5)]
    assert rows(txt.read_bedlike(spark, p), "rest") == [(".\t.\t+",), ("b\t2.5\t-\textra",)]
    assert txt.read_ranges(spark, p)[0] == "bed5"


def test_strictness(spark, put):
    with pytest.raises(Exception, match=ColumnTypeError.__doc__[:20]):
        txt.read_bed3(spark, put("a.bed", "chr1\tx\t5\n")).collect()
    with pytest.raises(Exception, match="fewer columns"):
        txt.read_bed4(spark, put("b.bed", "chr1\t1\t5\n")).collect()
    lenient = txt.read_bed4(spark, put("c.bed", "chr1\tx\t5\n"), strict=False).first()
    assert tuple(lenient) == ("chr1", None, 5, None)


FA = ">chr1 first\nTTCACTACTATTAGTACTCA\nCGGCGCAATA\n>chr2\nGGG\n>empty\n"


def test_fasta(spark, put, tmp_path):
    p = put("s.fa", FA)
    put("s.fa.fai", "chr1\t30\t12\t20\t21\nchr2\t3\t50\t3\t4\nempty\t0\t61\t0\t0\n")
    for chunk in (4, 1 << 16):
        a = sorted(tuple(r) for r in src.read_fasta(spark, str(p), chunk=chunk).collect())
        b = sorted(tuple(r) for r in src.read_indexed_fasta(spark, str(p), chunk=chunk).collect())
        assert a == b and "".join(r[2] for r in a if r[0] == "chr1") == "TTCACTACTATTAGTACTCACGGCGCAATA"
    gz = put("t.fa.gz", FA, gz=True)
    assert {r.seqname for r in src.read_fasta(spark, str(gz), ["chr2"]).collect()} == {"chr2"}
    assert {r.seqname for r in src.read_indexed_fasta(spark, str(p), ["chr1"]).collect()} == {"chr1"}
    assert [tuple(r)[:2] for r in src.fai_seqlens(spark, str(p) + ".fai").orderBy("ord").collect()] == [("chr1", 30), ("chr2", 3), ("empty", 0)]


def test_regions(spark, put):
    text = "TTCACTACTATTAGTACTCACGGCGCAATA"
    chunks = src.read_fasta(spark, str(put("s.fa", FA)), chunk=7)
    seqlens = Q.sequence_lengths(chunks).withColumn("ord", F.lit(0))
    wins = RangeFrame.from_windows(seqlens.where("seqname = 'chr1'"), 10, 5).df.withColumn("rid", F.col("range_start"))
    got = {r.rid: (r["slice"]) for r in Q.region_slices(wins, chunks, 7).collect()}
    assert got == {s: text[s : s + 10] for s in range(0, 30, 5)}
    gc = {r.rid: round(r.value, 6) for r in Q.region_map(wins, chunks, gc_content_strict, chunk=7).collect()}
    assert gc == {s: round(sum(c in "GC" for c in text[s : s + 10]) / len(text[s : s + 10]), 6) for s in range(0, 30, 5)}
    over = spark.createDataFrame([(1, "chr2", 1, 4), (2, "nope", 0, 1), (3, "chr2", 1, 3)], "rid long, seqname string, range_start long, range_end long")
    assert [r.rid for r in Q.region_slices(over, chunks, 7, out_of_bounds="drop").collect()] == [3]
    with pytest.raises(Exception, match="exceeds"):
        Q.region_slices(over, chunks, 7).collect()


def test_numeric(spark, tmp_path):
    one, two = np.arange(20.0), np.arange(24.0).reshape(12, 2)
    a = src.numeric_in_memory(spark, {"x": one}, 6)
    b = src.numeric_in_memory(spark, {"x": two}, 5)
    np.save(tmp_path / "x.npy", two)
    c = src.numeric_files(spark, str(tmp_path), "{}.npy", ["x"], two_d=True, chunk=5)
    r = spark.createDataFrame([(1, "x", 3, 11)], "rid long, seqname string, range_start long, range_end long")
    assert Q.region_slices(r, a, 6).first()["slice"] == one[3:11].tolist()
    for m in (b, c):
        assert Q.sequence_lengths(m).first().seq_length == 12
        assert Q.region_slices(r, m, 5).first()["slice"] == two[3:11].tolist()


def test_arrays(spark):
    df = spark.createDataFrame([(1.1,), (8.1,), (10.1,), (3.7,), (1.1,)], "x double")
    arr = Q.into_array(df, [F.col("x") + 1, F.lit(1)], "v", 2)
    assert {r.position: round(r.total, 6) for r in Q.column_sums(arr, "v", 2).collect()} == {0: 29.1, 1: 5.0}
    with pytest.raises(ValueError):
        Q.into_array(df, ["x"], ncols=2)
    with pytest.raises(Exception, match="ragged"):
        Q.check_width(arr, "v", 3).collect()
    assert arr.select(Q.array_value("v", 5)).first()[0] is None


def test_random(spark):
    lens = RangeFrame.seqlens_from(spark, {"a": 5000, "b": 90_000})
    a, b = (rnd.random_ranges(spark, lens, 500, scores=True).collect() for _ in range(2))
    assert a == b and len(a) == 500
    for r in a:
        assert 1 <= r.range_end - r.range_start < 1000 and r.range_start >= 0 and r.range_end <= {"a": 5000, "b": 90_000}[r.seqname]
        assert len(r.feature_name) == 8 and 0 <= r.score < 1


def test_fasta_over_many_splits(spark, put):
    """Sequences that run over several splits, and splits that hold several sequences or none whole."""
    rng = __import__("random").Random(3)
    want = {f"s{i}": "".join(rng.choices("ACGT", k=rng.choice([0, 1, 7, 60, 400, 1500]))) for i in range(40)}
    text = "; no header yet\n" + "".join(f">{k} about > {k}\n" + "".join(v[i : i + 50] + "\n" for i in range(0, len(v), 50)) + "\n" for k, v in want.items())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (97, 333, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            chunks = src.read_fasta(spark, str(put("many.fa", text)), chunk=64).orderBy("seqname", "chunk").collect()
            got = {}
            for r in chunks:
                got[r.seqname] = got.get(r.seqname, "") + r.chunk_text
                assert r.total == len(want[r.seqname]) and r.chunk == (len(got[r.seqname]) - 1) // 64
            assert got == {k: v for k, v in want.items() if v}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_gzip_lines_end_at_line_feeds(spark, put, rows):
    p = put("odd.bed", "a\tb\x0bc\u2028d\x85e\n\x1cf\r\nlast", gz=True)
    assert rows(txt.read_lines(spark, p)) == [("\x1cf",), ("a\tb\x0bc\u2028d\x85e",), ("last",)]


def test_after_preamble_and_scheme(spark, put, rows):
    p = put("p.tsv", "#a\nchrom\tstart\nchr1\t1\t2\nchr2\t3\t4\n")
    q = txt.preamble(f"file://{p}", header="chrom")
    assert (q.metadata, q.header, q.columns) == (["#a"], "chrom\tstart", 3)
    assert rows(txt.after_preamble(txt.read_lines(spark, p), q)) == [("chr1\t1\t2",), ("chr2\t3\t4",)]
