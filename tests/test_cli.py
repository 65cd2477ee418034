import gzip

import pytest

from spanloom import NoOperationError, UnsupportedFormatError, cli
from spanloom.errors import MissingSequenceError
from spanloom.sinks.tsv import Report, TsvConfig, write_tsv, write_tsv_folder


@pytest.fixture
def files(tmp_path):
    out = {}
    for name, text in {
        "genome.tsv": "chr1\t30\nchr10\t40\nchr2\t100\n",
        "a.bed": "chr2\t18\t32\ta\t1.5\nchr1\t0\t5\tb\t2\nchr1\t4\t7\ta\t.\nchr10\t1\t3\tb\t4\n",
        "b.bed": "chr1\t4\t6\nchr2\t0\t20\n",
        "odd.bed": "chrZ\t1\t2\nchr1\t1\t2\n",
        "names.bed": "chr1\t0\t5\ta\nchr1\t3\t9\tb\n",
    }.items():
        (tmp_path / name).write_text(text)
        out[name] = str(tmp_path / name)
    out["dir"] = tmp_path
    return out


@pytest.fixture
def run(spark, files):
    def f(*args):
        out = files["dir"] / "out.tsv"
        cli.run([*[files.get(a, a) for a in args], "-o", str(out)], spark)
        return out.read_text()

    return f


def test_commands(run):
    assert run("windows", "-g", "genome.tsv", "-w", "25") == "chr1\t0\t25\nchr1\t25\t30\nchr10\t0\t25\nchr10\t25\t40\nchr2\t0\t25\nchr2\t25\t50\nchr2\t50\t75\nchr2\t75\t100\n"
    assert run("adjust", "-g", "genome.tsv", "b.bed", "-b", "5", "--sort") == "chr1\t0\t11\nchr2\t0\t25\n"
    assert run("filter", "-g", "genome.tsv", "--left", "a.bed", "--right", "b.bed") == "chr1\t0\t5\tb\t2\nchr1\t4\t7\ta\t.\nchr2\t18\t32\ta\t1.5\n"
    assert run("flank", "-g", "genome.tsv", "b.bed", "-l", "2", "-r", "3") == "chr1\t2\t4\nchr1\t6\t9\nchr2\t20\t23\n"
    assert run("map", "-g", "genome.tsv", "--left", "b.bed", "--right", "a.bed", "-f", "sum,min,collapse") == "chr1\t4\t6\t2\t2\t2\nchr2\t0\t20\t1.5\t1.5\t1.5\n"
    assert run("merge", "b.bed", "-d", "100") == "chr1\t4\t6\nchr2\t0\t20\n"
    assert run("merge", "a.bed", "-f", "max") == "chr1\t0\t7\t2\nchr2\t18\t32\t1.5\nchr10\t1\t3\t4\n"
    assert run("merge", "names.bed") == "chr1\t0\t9\ta,b\n"
    assert run("filter-chroms", "-g", "genome.tsv", "odd.bed") == "chr1\t1\t2\n"
    assert run("filter", "-g", "genome.tsv", "--left", "odd.bed", "--right", "odd.bed", "-s") == "chr1\t1\t2\n"


def test_density(run):
    got = run("feature-density", "-g", "genome.tsv", "names.bed", "-w", "30", "--exclusive").splitlines()
    assert got[:2] == ["chrom\tstart\tend\tb\ta\ta,b", "chr1\t0\t30\t4\t3\t2"]
    got = run("feature-density", "-g", "genome.tsv", "names.bed", "-w", "30").splitlines()
    assert got[0] == "chr1\t0\t30\t5\t6" and len(got) == 1 + 2 + 4


def test_random(run):
    got = [x.split("\t") for x in run("random-bed", "-g", "genome.tsv", "-n", "50", "--scores", "--sort").splitlines()]
    assert len(got) == 50 and all(0 <= int(s) < int(e) <= {"chr1": 30, "chr10": 40, "chr2": 100}[q] for q, s, e, _, _ in got)


def test_errors(run):
    with pytest.raises(MissingSequenceError):
        run("adjust", "-g", "genome.tsv", "odd.bed", "-b", "1")
    with pytest.raises(NoOperationError):
        run("map", "-g", "genome.tsv", "--left", "b.bed", "--right", "a.bed")
    with pytest.raises(NoOperationError):
        run("merge", "a.bed")
    with pytest.raises(SystemExit):
        run("flank", "-g", "genome.tsv", "b.bed", "-b", "1", "-l", "2")
    with pytest.raises(UnsupportedFormatError):
        run("feature-density", "-g", "genome.tsv", "b.bed", "-w", "5")


def test_tsv(spark, tmp_path):
    df = spark.createDataFrame([("chr2", 1, 2, 2.0, [1.0, 2.5], None), ("chr1", 3, 4, float("nan"), None, "x")], "seqname string, range_start long, range_end long, v double, a array<double>, s string")
    p = tmp_path / "o.tsv.gz"
    n = write_tsv(df, str(p), TsvConfig("NA", ["c", "s"], ["made"], True))
    assert n == 2 and gzip.open(p, "rt").read() == "#made\n#c\ts\nchr1\t3\t4\tNaN\tNA\tx\nchr2\t1\t2\t2\t1,2.5\tNA\n"
    write_tsv_folder(df, str(tmp_path / "parts"), TsvConfig("NA", ["c"]), compress=True)
    assert [r[0][:4] for r in spark.read.text(str(tmp_path / "parts")).collect()] and (tmp_path / "parts/_header").read_text() == "c\n"
    r = Report()
    r.add_issue("x", 0)
    r.add_issue("y", 2)
    assert r.lines() == ["y (2 times)"]
