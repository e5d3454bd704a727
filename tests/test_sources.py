"""Every reader and writer on tiny files made by hand."""

import gzip
import math

import pytest
from pyspark.sql import functions as F

from strandwork.operators import genome, models
from strandwork.sources import formats as S


@pytest.fixture
def put(tmp_path):
    def write(name, text, zipped=False):
        path = tmp_path / name
        if zipped:
            with gzip.open(path, "wt") as f:
                f.write(text)
        else:
            path.write_text(text)
        return str(path)

    return write


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_lines_plain_and_gzip(spark, put):
    text = "# a comment\nACGT\nTTGCA\n"
    for path in (put("a.txt", text), put("a.txt.gz", text, True)):
        assert rows(S.read_lines(spark, path)) == [("ACGT",), ("TTGCA",)]
    assert rows(S.read_infixes(spark, path, 1, 2)) == [("CG",), ("TG",)]
    assert S.first_records(S.read_lines(spark, path), 1).count() == 1


def test_fasta(spark, put, tmp_path):
    path = put("a.fa", ">one first; x: 1\nACG\nTAC\n>two\nttga\r\n\n>three\n")
    assert rows(S.read_fasta(spark, path)) == [("one first; x: 1", "ACGTAC"), ("three", ""), ("two", "ttga")]
    assert rows(S.read_dna(spark, path))[2] == ("two", "TTGA")
    with pytest.raises(Exception, match="outside the alphabet"):
        S.read_dna(spark, put("b.fa", ">x\nACGX\n")).collect()
    assert rows(S.keyed(S.read_fasta(spark, path), r"^(\w+)", find="o", put="0")) == [("0ne", "ACGTAC"), ("three", ""), ("tw0", "ttga")]
    out = str(tmp_path / "out")
    S.write_fasta(S.read_fasta(spark, path).where("seq <> ''"), out, width=4)
    assert rows(S.read_fasta(spark, out)) == [("one first; x: 1", "ACGTAC"), ("two", "ttga")]


def test_genome_parts(spark):
    text = "NN" + "ACGT" * 5 + "nnnACNN" + "TTTTT"
    fasta = spark.createDataFrame([("c1 long name", text), ("c2", "NNN"), ("c3", "")], "header string, seq string")
    assert rows(S.genome_parts(fasta, 3)) == [("c1", 2, "ACGT" * 5), ("c1", 29, "TTTTT")]
    cut = rows(S.genome_parts(fasta, 3, 8, 3))
    assert cut == [("c1", 2, "ACGTACGTACG"), ("c1", 10, "ACGTACGTACG"), ("c1", 18, "ACGT"), ("c1", 29, "TTTTT")]
    many = spark.createDataFrame([("m", "ACN" * 500)], "header string, seq string")
    assert [r[1] for r in rows(S.genome_parts(many, 1))] == [3 * i for i in range(500)]


def test_annotations(spark):
    df = spark.createDataFrame([("id: a; weight : 2.5;junk; id: b: c",), ("",), (None,)], "h string")
    got = [r[0] for r in df.select(S.annotations(F.col("h"))).collect()]
    assert got == [{"id": "a,b: c", "weight": "2.5"}, {}, None]


GFF = """##gff-version 3
chr1\tx\tgene\t11\t40\t.\t+\t.\tID=g1;Name=first
chr1\tx\tCDS\t11\t20\t5\t+\t0\tID=c1;Parent=t1,t2
chr1\tx\tCDS\t31\t40\t.\t+\t2\tID=c2;Parent=t1
chr1\tx\texon\t1\t5\t.\t-\t.\tgene_id "g2"; tag "basic"; tag "CCDS"; note "a = b"
"""


def test_gff(spark, put, tmp_path):
    gff = S.read_gff(spark, put("a.gff", GFF))
    by = {r["start"] * 100 + r["end"]: r for r in gff.collect()}
    assert by[1140]["attrs"] == {"ID": "g1", "Name": "first"}
    assert by[105]["attrs"] == {"gene_id": "g2", "tag": "basic,CCDS", "note": "a = b"}
    assert sorted(r["parent"] for r in S.with_parents(gff.where("type = 'CDS'")).collect()) == ["t1", "t1", "t2"]
    spans = S.coding_only(gff).where("type = 'mRNA'")
    assert rows(spans.select("parent", "start", "end", "parts")) == [("t1", 11, 40, 2), ("t2", 11, 20, 1)]
    out = str(tmp_path / "gff")
    S.write_gff(gff.where("type = 'CDS'"), out)
    assert rows(S.read_gff(spark, out).select("start", "end", "attrs", "score"), "start") == [(11, 20, {"ID": "c1", "Parent": "t1,t2"}, "5"), (31, 40, {"ID": "c2", "Parent": "t1"}, ".")]


def test_introns(spark, put):
    text = "#c\nchr1\tx\tintron\t11\t20\t7\t+\t.\t.\nchr1\tx\tintron\t11\t20\t2\t+\t.\t.\nchr1\tx\tintron\t31\t40\t.\t.\t.\t.\n"
    assert rows(S.read_introns(spark, put("i.gff", text), 3)) == [("chr1", 10, 20, "+", 7), ("chr1", 30, 40, "+", 3), ("chr1", 30, 40, "-", 3)]


def test_tracks(spark, put, tmp_path):
    assert rows(S.read_bedgraph(spark, put("a.bg", "track type=bedGraph\nchr1\t0\t10\t2\nchr1\t10\t12\tx\n"))) == [("chr1", 0, 10, 2.0), ("chr1", 10, 12, 1.0)]
    peaks = S.read_narrowpeak(spark, put("p.bed", "chr1\t100\t200\tp1\t5\t.\t1.5\t2\t3\t40\nchr1\t10\t21\tp2\t5\t.\t1.5\t2\t3\t-1\n"))
    assert rows(peaks.select("name", "top")) == [("p1", 140), ("p2", 15)]
    assert rows(S.read_fai(spark, put("g.fai", "chr1\t1000\t6\t79\t80\n"))) == [("chr1", 1000, 6, 79, 80)]
    meth = S.read_methylation(spark, put("m.cov", "chr1\t5\t6\t50\t1\t1\nchr1\t5\t6\t75\t3\t1\n"))
    assert rows(meth) == [("chr1", 5, 4, 2)]
    out = str(tmp_path / "bg")
    S.write_bedgraph(S.read_bedgraph(spark, put("b.bg", "chr1\t0\t10\t2\n")), out)
    assert rows(S.read_bedgraph(spark, out)) == [("chr1", 0, 10, 2.0)]


def test_hits(spark, put):
    short = "q\ts\t98.5\t20\t1\t0\t1\t20\t5\t24\t1e-5\t40.1\n"
    got = S.read_hits(spark, put("h.txt", short + short.strip() + "\tsid\t90\t19\t19\t0\t99\t1/1\tAC\tAC\t20\t100\ttext\n")).orderBy("subjects").collect()
    assert (got[0]["evalue"], got[0]["score"]) == (1e-5, None)
    assert (got[1]["identical"], got[1]["frames"], got[1]["title"]) == (19, "1/1", "text")


def test_sam(spark, put):
    text = "@HD\tVN:1\nr1\t0\tchr1\t11\t60\t5M10N5M\t*\t0\t0\tA\tI\nr2\t0\tchr1\t13\t60\t2S3M1I2M1D4M\t*\t0\t0\tA\tI\nr3\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n"
    sam = S.read_sam(spark, put("a.sam", text))
    by = {r["name"]: r for r in sam.collect()}
    assert [tuple(x)[:2] for x in by["r1"]["blocks"]] == [(10, 15), (25, 30)]
    assert [tuple(x)[:2] for x in by["r1"]["introns"]] == [(15, 25)]
    assert [tuple(x)[:2] for x in by["r2"]["blocks"]] == [(12, 15), (15, 17), (18, 22)]
    assert by["r3"]["blocks"] == []
    assert rows(genome.read_depth(sam)) == [("chr1", 10, 12, 1), ("chr1", 12, 15, 2), ("chr1", 15, 17, 1), ("chr1", 18, 22, 1), ("chr1", 25, 30, 1)]
    assert rows(genome.split_reads(sam)) == [("chr1", 15, 25, 1)]


ORDER = ("motif", "pos", "sym", "cnt")
WANT = [("m", 0, "A", 1.0), ("m", 0, "C", 2.0), ("m", 0, "G", 3.0), ("m", 0, "T", 4.0), ("m", 1, "A", 0.5), ("m", 1, "C", 0.0), ("m", 1, "G", 0.0), ("m", 1, "T", 9.5)]


def test_matrices(spark, put):
    long = ">big x\n" + "".join(f"{c} [ {' '.join(['1'] * 1500)} ]\n" for c in "ACGT")
    got = S.read_pfms(spark, put("a.pfm", ">m name\nA [ 1 0.5 ]\nC [ 2 0 ]\nG [ 3 0 ]\nT [ 4 9.5 ]\n" + long))
    assert rows(got.where("motif = 'm'").select(*ORDER)) == WANT and got.where("motif = 'big'").count() == 6000
    assert rows(S.read_pfms(spark, put("b.pfm", ">m\n1 0.5\n2 0\n3 0\n4 9.5\n")).select(*ORDER)) == WANT
    transfac = "ID m\nBF x\nP0 A C G T\n01 1 2 3 4 N\n02 0.5 0 0 9.5 T\nXX\n//\nID n\nP0 A C G T\n01 1 0 0 0 A\n//\n"
    assert rows(S.read_position_rows(spark, put("t.dat", transfac)).where("motif = 'm'").select(*ORDER)) == WANT
    assert rows(S.read_position_rows(spark, put("e.dat", "NA m\nPO A C G T\n01 1 2 3 4\n02 0.5 0 0 9.5\n//\n"), "NA")) == WANT
    assert rows(S.read_labelled_rows(spark, put("u.txt", "m\n\nA:\t1\t0.5\nC:\t2\t0\nG:\t3\t0\nT:\t4\t9.5\n")).select(*ORDER)) == WANT


def test_newick():
    tree = S.parse_newick("((a:1,b:2):0.5,c:3)root;")
    assert tree == [(0, -1, "root", 0.0), (1, 0, "", 0.5), (2, 1, "a", 1.0), (3, 1, "b", 2.0), (4, 0, "c", 3.0)]


def test_profile_model():
    def line(*p):
        return " ".join("*" if x == 0 else f"{-math.log(x):.5f}" for x in p)

    text = "HMMER3/f [x]\nNAME toy\nLENG 2\nALPH DNA\nHMM A C G T\n m->m m->i m->d i->m i->i d->m d->d\n COMPO " + line(0.25, 0.25, 0.25, 0.25)
    text += "\n " + line(0.25, 0.25, 0.25, 0.25) + "\n " + line(0.9, 0.05, 0.05, 0.5, 0.5, 1, 0) + "\n"
    for k, p in ((1, (0.7, 0.1, 0.1, 0.1)), (2, (0.1, 0.1, 0.1, 0.7))):
        text += f" {k} " + line(*p) + f" {k} x - -\n " + line(0.25, 0.25, 0.25, 0.25) + "\n " + line(0.9, 0.05, 0.05, 0.5, 0.5, 0.6, 0.4) + "\n"
    p = S.parse_profile(text + "//\n")
    assert (p["name"], p["alphabet"], len(p["match"]), len(p["move"])) == ("toy", "ACGT", 3, 3)
    assert p["match"][2] == pytest.approx([0.1, 0.1, 0.1, 0.7], abs=1e-4)
    assert p["move"][0] == pytest.approx([0.9, 0.05, 0.05, 0.5, 0.5, 1, 0], abs=1e-4)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, f"line {i}", {"b": "2", "a": str(i)}, "ACGT") for i in range(6)], "id bigint, t string, notes map<string,string>, seq string")
    S.write_lines(df, str(tmp_path / "a"), "t", "[0-2]$")
    assert [r[0] for r in rows(spark.read.text(str(tmp_path / "a")))] == ["line 0", "line 1", "line 2"]
    S.write_lines(df, str(tmp_path / "b"), "t", "[0-2]$", False)
    assert [r[0] for r in rows(spark.read.text(str(tmp_path / "b")))] == ["line 3", "line 4", "line 5"]
    S.write_annotated(df.where("id < 2"), str(tmp_path / "c"), "notes")
    assert rows(S.read_fasta(spark, str(tmp_path / "c"))) == [("a: 0; b: 2", "ACGT"), ("a: 1; b: 2", "ACGT")]
    S.write_split(df.select("id", "t"), str(tmp_path / "d"), 3, F.col("id"))
    parts = spark.read.parquet(str(tmp_path / "d"))
    assert parts.count() == 6 and parts.groupBy("id").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    S.save(df.select("id"), str(tmp_path / "e"), "json")
    assert spark.read.json(str(tmp_path / "e")).count() == 6
    assert S.column_of(df, 2).columns == ["t"]
    edges = spark.createDataFrame([("b", "c", 0.5), ("a", "b", 1.0)], "x string, y string, w double")
    assert S.graph_text(edges, "x", "y", "w") == 'digraph g {\n  "a" -> "b" [label="1.0"];\n  "b" -> "c" [label="0.5"];\n}\n'


def test_models_survive(spark):
    df = spark.createDataFrame([("ACGT", 1.0, 0), ("AATT", 2.0, 1), ("CCGA", 1.0, 0), ("TTGA", 1.0, 1)], "seq string, weight double, class_id int")
    import numpy as np

    made = [
        models.PWM.fit(df, "seq", "ACGT", 1.0), models.Markov.fit(df, "seq", "ACGT", 1, 1.0), models.Dependent.markov(df, "seq", "ACGT", 4, 1, 1.0),
        models.Mixture.fit(df, "seq", "ACGT", 2, 1), models.LogLinear.fit(df, "seq", "ACGT", 4, steps=2), models.Generative.fit(df, lambda x: models.PWM.fit(x, "seq", "ACGT", 1.0), 2),
        models.HMM("ACGT", np.asarray([1.0]), np.asarray([[1.0]]), np.full((1, 4), 0.25)),
    ]
    for m in made:
        back = S.load_model(S.dump_model(m))
        assert type(back) is type(m) and S.dump_model(back) == S.dump_model(m)
        if hasattr(m, "score"):
            a, b = (df.select(x.score(F.col("seq")).alias("s")).collect() for x in (m, back))
            assert a == b
