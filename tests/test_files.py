"""Readers and writers on small files."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from locusframe.operators import probes as P
from locusframe.plans.flows import repair_gtf
from locusframe.sources import fasta, reports, sinks, tables, vcf
from locusframe.streaming import intake

VCF = """##fileformat=VCFv4.2
##contig=<ID=chr1,length=1000>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB
chr1\t10\t.\tA\tG\t.\t.\t.\tGT:AD:DP\t0|1:3,4:7\t./.:.:.
chr1\t20\t.\tAT\tA,ATT\t.\t.\t.\tDP:GT\t9:1/2\t4:.
"""
OTHER = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tC
chr2\t5\t.\tG\tC\t.\t.\t.\tGT\t1/1
"""


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    (tmp_path / "b.vcf").write_text(OTHER)
    p = str(tmp_path)
    # files with different samples in one read
    assert tuples(vcf.read_vcf_calls(spark, p), "pos", "sample_id", "gt") == [
        (5, "C", "1/1"), (10, "A", "0/1"), (10, "B", "./."), (20, "A", "1/2"), (20, "B", "./."),
    ]
    assert tuples(vcf.read_vcf_depth(spark, p), "pos", "sample_id", "depth", "ref_depth", "alt_depth") == [
        (5, "C", 0, 0, 0), (10, "A", 7, 3, 4), (10, "B", 0, 0, 0), (20, "A", 9, 0, 0), (20, "B", 4, 0, 0),
    ]
    assert tuples(vcf.read_vcf_coded(spark, p, max_variants=1), "pos", "sample_id", "code") == [(10, "A", 1), (10, "B", 3)]
    assert tuples(vcf.vcf_samples(spark, p), "ordinal", "sample_id") == [(0, "A"), (0, "C"), (1, "B")]
    assert tuples(vcf.read_vcf_sites(spark, p), "chrom", "pos", "alt") == [("chr1", 10, "G"), ("chr1", 20, "A,ATT"), ("chr2", 5, "C")]


def test_vcf_writer_order(spark, tmp_path):
    wide = spark.createDataFrame([("c2", 5, "A", "G", "0/1"), ("c10", 7, "A", "G", None), ("c2", 1, "T", "G", "0/0")], "chrom string, pos bigint, ref string, alt string, S string")
    sizes = spark.createDataFrame([("c2", 100, 0), ("c10", 90, 1)], "chrom string, size bigint, rank int")
    out = str(tmp_path / "o")
    sinks.write_vcf(wide, sizes, ["S"], out)
    lines = [line for f in sorted((tmp_path / "o").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[0] == "##fileformat=VCFv4.2"
    assert lines[1:3] == ["##contig=<ID=c2,length=100>", "##contig=<ID=c10,length=90>"]
    assert [x.split("\t")[:2] for x in lines[5:]] == [["c2", "1"], ["c2", "5"], ["c10", "7"]]
    assert lines[-1].endswith("GT\t./.")


def test_fasta(spark, tmp_path):
    f = tmp_path / "x.fa"
    f.write_text(">s1 a -> b\nACGT\nAC\n>s2\nTTT\n\n")
    assert tuples(fasta.read_fasta(spark, str(f)), "seq_id", "description", "seq") == [("s1", "a -> b", "ACGTAC"), ("s2", "", "TTT")]


def test_fetch_crosses_chunks(spark):
    rng = random.Random(7)
    seqs = {f"k{i}": "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 95))) for i in range(6)}
    g = P.genome_chunks(spark.createDataFrame(list(seqs.items()), "seq_id string, seq string"), 10)
    regions = [(k, s, s + n) for k in seqs for s in (-5, 0, 7, 9, 10, 33, 60) for n in (0, 1, 10, 25, 200) if s < len(seqs[k])]
    df = spark.createDataFrame(regions, "chrom string, start bigint, end bigint")
    got = {(r.chrom, r.start, r.end): r.seq for r in P.fetch(df, g, 10).collect()}
    for k, s, e in regions:
        assert got[(k, s, e)] == seqs[k][max(s, 0) : max(e, 0)], (k, s, e)


def test_tiles(spark):
    rng = random.Random(8)
    seqs = {i: "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate([4, 5, 11, 57, 300])}
    df = spark.createDataFrame(list(seqs.items()), "seq_id int, seq string")
    want = sorted((i, t + 1, s[t : t + 5]) for i, s in seqs.items() for t in range(len(s) - 4))
    assert tuples(P.tile_sequence(df, 5), "seq_id", "tile", "tile_seq") == want


def test_best_gc_tile(spark):
    rng = random.Random(9)
    seqs = {i: "".join(rng.choice("ACGTcgN") for _ in range(n)) for i, n in enumerate([6, 7, 12, 13, 57, 300])}
    df = spark.createDataFrame(list(seqs.items()), "seq_id int, seq string")
    want = []
    for i, s in seqs.items():
        gc = lambda t: sum(x in "GC" for x in s[t : t + 6].upper())
        t = min(range(len(s) - 5), key=lambda t: (abs(2 * gc(t) - 6), t))
        want.append((i, t + 1, s[t : t + 6]))
    assert tuples(P.best_gc_tile(df, 6), "seq_id", "tile", "tile_seq") == want


def test_fastq_tree(spark, tmp_path):
    for d, names in {"Sample_X-L12": ["a_R1.fastq.gz", "a_R2.fastq.gz", "a.fastq.gz"], "Sample_Y-L7-2": ["b_1.fastq.gz"]}.items():
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_bytes(b"x" * 5)
    assert tuples(tables.scan_fastq_tree(spark, str(tmp_path)), "libid", "read_type", "bytes") == [
        ("L12", "R1", 5), ("L12", "R2", 5), ("L7-2", "R1", 5),
    ]


def test_gtf_attributes(spark, tmp_path):
    f = tmp_path / "a.gtf"
    f.write_text('#x\nc1\ts\texon\t1\t9\t.\t-\t.\tgene_id "g1"; transcript_id "t1"; db_xref "a"; db_xref "b";\n')
    r = tables.read_gtf(spark, str(f)).first()
    assert (r.attrs["gene_id"], r.attrs["transcript_id"], r.attrs["db_xref"], r.start) == ("g1", "t1", "a", 1)


def test_repair_gtf(spark):
    rows = [("c1", "CDS", 1, 9, ".", 'transcript_id "t1";'), ("c1", "exon", 1, 9, "-", 'transcript_id "t2"; gene_id "g2";')]
    df = spark.createDataFrame(rows, "chrom string, feature string, start bigint, end bigint, strand string, attributes string")
    got = tuples(repair_gtf(df), "transcript_id", "feature", "strand", "attributes")
    assert [(a, b, s) for a, b, s, _ in got] == [
        ("t1", "CDS", "+"), ("t1", "exon", "+"), ("t2", "CDS", "-"), ("t2", "exon", "-"), ("t2", "transcript", "-"),
    ]
    assert all("gene_id" in x[3] for x in got)


def test_effect_sections(spark, tmp_path):
    (tmp_path / "s1.csv").write_text("# Summary\nA , 1\n\n# Count by effects\n\nType , Count , Percent\nmissense , 5 , 1%\n\n# Count by regions\nmissense , 9 , 1%\n")
    assert tuples(reports.read_snpeff_stats(spark, str(tmp_path)), "sample_id", "effect", "n") == [("s1", "missense", 5)]


def test_quality_report(spark, tmp_path):
    (tmp_path / "lib1.json").write_text('{"read1_before_filtering": {"quality_curves": {"mean": [30.5, 31]}}, "read2_before_filtering": {"quality_curves": {"mean": [20]}}}')
    got = [(r.libid, r.read_type, list(r.curve)) for r in reports.read_fastp(spark, str(tmp_path)).orderBy("read_type").collect()]
    assert got == [("lib1", "read1", [30.5, 31.0]), ("lib1", "read2", [20.0])]


def test_fixed_precision(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.write_table(spark.createDataFrame([("a", 1.23456)], "k string, v double"), out, precision=2)
    assert spark.read.csv(out, sep="\t", header=True).first().v == "1.23"


def test_intake_takes_new_files_only_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "k string, ts int, status string"
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
    run = lambda: intake.intake_stream(
        intake.file_stream(spark, src, spark.createDataFrame([], schema).schema), ["k"], "ts", out, mark
    ).awaitTermination()
    put([("a", 1, "new"), ("b", 1, "new")])
    run()
    put([("a", 3, "done"), ("b", 0, "stale")])
    run()
    run()
    assert tuples(intake.latest(spark, out, ["k"], "ts"), "k", "ts", "status") == [("a", 3, "done"), ("b", 1, "new")]
