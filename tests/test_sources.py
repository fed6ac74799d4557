"""Files in and out."""

import gzip
import json

import pytest

from strandlake.functions.kmers import KmerParams
from strandlake.operators.index_build import IndexParams, build_index
from strandlake.sources import alignments as A
from strandlake.sources import catalog, fastx


def test_fasta_and_fastq(spark, tmp_path):
    fa = tmp_path / "a.fa"
    fa.write_text(">one first\nACG\nTT\n\n>two\n\n>three\nA\n")
    got = fastx.read_fastx(spark, str(fa)).orderBy("part", "idx").collect()
    assert [(r.name, r.seq, r.qual) for r in got] == [("one", "ACGTT", None), ("two", "", None), ("three", "A", None)]
    fq = tmp_path / "b.fastq.gz"
    with gzip.open(fq, "wt") as f:
        f.write("@r1/1\nACGT\n+\n@@@@\n@r2/1\nA\n+x\nI\n")
    got = fastx.numbered(fastx.read_fastx(spark, str(fq))).orderBy("read").collect()
    assert [(r.read, r.name, r.seq, r.qual) for r in got] == [(0, "r1/1", "ACGT", "@@@@"), (1, "r2/1", "A", "I")]


@pytest.mark.parametrize("split", [37, 64, 200])
def test_files_are_cut_at_records(spark, tmp_path, split):
    fq, fa = tmp_path / "x.fq", tmp_path / "x.fa"
    fq.write_text("".join(f"@r{i}\n{'ACGT' * (i % 5 + 1)}\n+\n{'@+I!' * (i % 5 + 1)}\n" for i in range(60)))
    fa.write_text("".join(f">t{i}\n{'MKLV' * (i % 7)}\n{'A' * (i % 3)}\n" for i in range(60)))
    for path, mark in ((fq, "r"), (fa, "t")):
        got = fastx.numbered(fastx.read_fastx(spark, str(path), split_bytes=split)).orderBy("read").collect()
        assert [r.name for r in got] == [f"{mark}{i}" for i in range(60)]


def test_broken_records(spark, tmp_path):
    bad = tmp_path / "bad.fq"
    bad.write_text("@r\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="differ in length"):
        fastx.read_fastx(spark, str(bad)).collect()
    one, two = tmp_path / "1.fq", tmp_path / "2.fq"
    one.write_text("@r\nA\n+\nI\n")
    two.write_text("@r\nA\n+\nI\n@s\nA\n+\nI\n")
    with pytest.raises(ValueError, match="reads"):
        fastx.read_pairs(spark, str(one), str(two))
    assert fastx.read_pairs(spark, str(one), str(one)).count() == 2


def test_members(spark, tmp_path):
    fa = tmp_path / "m.fa"
    fa.write_text(">a\nMK\n>b\nMKL\n>c\nM\n")
    groups = spark.createDataFrame([("a", "g"), ("b", "g")], "target_id string, group string")
    got = {r.member_id: r.unit_key for r in fastx.members_from_fasta(spark, str(fa), groups).collect()}
    assert got == {"a": "g", "b": "g", "c": "c"}
    with pytest.raises(ValueError, match="unknown"):
        fastx.members_from_fasta(spark, str(fa), spark.createDataFrame([("z", "g")], "target_id string, group string"))
    fa.write_text(">a\nM\n>a\nM\n")
    with pytest.raises(ValueError, match="repeated"):
        fastx.members_from_fasta(spark, str(fa))


def test_sinks_and_windows(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGTACGTAC", "I" * 10), ("b", "AC", "II")], "name string, seq string, qual string")
    fastx.write_fasta(df, str(tmp_path / "fa"))
    fastx.write_fastq(df, str(tmp_path / "fq"))
    back = fastx.read_fastx(spark, str(tmp_path / "fq")).orderBy("name").collect()
    assert [(r.name, r.seq, r.qual) for r in back] == [tuple(r) for r in df.collect()]
    got = fastx.genome_windows(df, 6, 2).orderBy("name", "start").collect()
    assert [(r.name, r.start, r.seq) for r in got] == [("a", 0, "ACGTAC"), ("a", 4, "ACGTAC")]
    names = spark.createDataFrame([("a/1",)], "name string")
    assert [r.name for r in fastx.recruit(df, names).collect()] == ["a"]


def test_tracebacks(spark):
    cols, events = A.btop_columns("2AC-D3E-/-1", 3, "MMQRSTUVWXYZ")
    assert cols == [(2, "Q"), (3, "R"), (4, "A"), (5, "-"), (6, "U"), (7, "V"), (8, "W"), (9, "X")]
    assert events == [(9, "IE"), (9, "/")]
    cols, events = A.cigar_columns("2S3M1I2D1M", 5, "xxABCDE")
    assert cols == [(4, "A"), (5, "B"), (6, "C"), (7, "-"), (8, "-"), (9, "E")] and events == [(7, "ID")]
    hits = spark.createDataFrame([(1, "1AC-A", 1)], "hit long, btop string, sstart int")
    assert A.expand_columns(hits, ["hit"]).count() == 3 and A.expand_events(hits, ["hit"]).count() == 0


def test_sam(spark, tmp_path):
    f = tmp_path / "x.sam"
    f.write_text("@HD\tVN:1\nr\t0\tc\t1\t60\t4M\t*\t0\t0\tAACG\tIIII\tAS:i:8\nr\t272\tc\t9\t0\t4M\t*\t0\t0\t*\t*\tAS:i:-3\n")
    a, b = A.read_sam(spark, str(f)).orderBy("pos").collect()
    assert (a.seq, a.score, b.seq, b.score, b.reverse) == ("AACG", 8.0, "CGTT", -3.0, True)


def test_domains_and_signatures(spark, tmp_path):
    f = tmp_path / "d.txt"
    f.write_text("# c\np1 - 100 fam PF1 50 1e-9 30.1 0 1 1 1e-8 1e-9 28.0 0 2 48 3 60 1 61 0.9 x\n")
    r = A.read_domains(spark, str(f)).first()
    assert (r.target, r["query"], r.hmm_from, r.env_to, r.i_evalue) == ("p1", "fam", 2, 61, 1e-9)
    s = tmp_path / "s.sig"
    s.write_text(json.dumps([{"name": "a", "signatures": [{"ksize": 11, "mins": [1, (1 << 64) - 1]}]}, {"name": "b", "signatures": [{"ksize": 11, "mins": [1]}]}]))
    rows = A.read_signatures(spark, str(s))
    assert sorted((r.name, r.hash) for r in rows.collect()) == [("a", -1), ("a", 1), ("b", 1)]
    i = catalog.index_from_signatures(rows, IndexParams(k=11))
    assert sorted((r.unit_key, r.m_g, r.pin_sum) for r in i.units.collect()) == [("a", 2, 2.0), ("b", 1, 1.0)]


def test_index_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(f"u{i % 3}", i, i % 2 == 0, "MKLVACDEFGHIKLMNPQRSTVWY"[i:] + "ACDEFGHIKL") for i in range(9)], "unit_key string, member_id long, full_length boolean, sequence string")
    i = build_index(t, IndexParams(k=4, t_base=0.5, n_min=5, t_dense=0.7))
    catalog.save_index(i, str(tmp_path / "i"), buckets=4)
    j = catalog.load_index(spark, str(tmp_path / "i"))
    assert j.params == i.params
    for name in ("units", "postings", "promiscuous", "dense"):
        a, b = getattr(i, name), getattr(j, name)
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))
    assert KmerParams(4).letters.name == "protein"
