"""Hand-computed cases of the scalar expressions."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from locusframe.functions import alignment as A
from locusframe.functions import genotype as G
from locusframe.functions import sequence as S
from locusframe.functions import stats as ST
from locusframe.functions import variant as V

c = F.col


def values(spark, rows, schema, expr):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.select("i", expr.alias("v")).orderBy("i").select("v").collect()]


def test_indel_length(spark):
    rows = [("ATG", "ATGC,ATGCA"), ("ATG", "AT"), ("ATG", "A,TG,ATGCCC"), ("ATG", "ATG")]
    assert values(spark, rows, "r string, a string", V.indel_length(c("r"), c("a"))) == [2, 1, 3, 0]


def test_allele_shorthand(spark):
    rows = [("ATG", "A"), ("A", "ATG"), ("ATG", "AT"), ("A", "G"), ("AC", "*"), ("GC", "GTC")]
    one = values(spark, rows, "r string, a string", V.allele_shorthand(c("r"), c("a")))
    assert one == ["delTG", "insTG", "delTG", "G", "delAC", "insTC"]
    whole = values(spark, rows, "r string, a string", V.allele_shorthand(c("r"), c("a"), prefix=True))
    assert whole == ["delTG", "insTG", "delG", "G", "delAC", "insGTC"]


CLASSES = {
    "SNP": ["A/T", "G/C", "A/G,T"], "MNP": ["AA/TT", "GC/CG"],
    "DEL": ["A/-", "A/del", "AT/A", "ATG/A", "ATGC/AT", "AT/A,ATG"],
    "INS": ["A/AT", "G/GTT", "AT/ATG", "A/AT,ATG"], "UNKNOWN": ["-/-"],
}


def test_variant_class_len(spark):
    flat = [(a, k) for k, group in CLASSES.items() for a in group]
    got = values(spark, [(a,) for a, _ in flat], "a string", V.variant_class_len(c("a")))
    assert got == [k for _, k in flat]


def test_malformed_alleles(spark):
    bad = [("",), ("A",), ("/",), ("A/T/GG",)]
    assert values(spark, bad, "a string", V.variant_class_len(c("a"), strict=False)) == [None] * 4
    with pytest.raises(Exception):
        values(spark, bad[1:2], "a string", V.variant_class_len(c("a")))


def test_mendel_all_27(spark):
    gts = ["0/0", "0/1", "1/1"]
    rows = list(itertools.product(gts, repeat=3))
    got = values(spark, rows, "f string, m string, k string", G.mendel_ok(c("f"), c("m"), c("k")))

    def ok(f, m, k):
        return any(sorted(x + y) == sorted(k.replace("/", "")) for x in f.split("/") for y in m.split("/"))

    assert got == [ok(*r) for r in rows]


def test_markers(spark):
    rows = [("ACGT[R/Y]GCTA",), ("[M/K]TCGA",), ("[X/T]A",), ("[A/T]C[G/C]",), ("ACGT",), ("AC[A/G]Z",)]
    ref = values(spark, rows, "s string", S.probe_reference(c("s"))["ref_seq"])
    err = values(spark, rows, "s string", S.probe_reference(c("s"))["error"])
    assert ref == ["ACGTRGCTA", "MTCGA", None, None, None, None]
    assert [e is None for e in err] == [True, True, False, False, False, False]


def test_iupac(spark):
    got = values(spark, [("r",), ("N",), ("Z",)], "x string", S.iupac_bases(c("x")))
    assert got == ["AG", "ACGT", None]


def test_real_match_length(spark):
    rows = [(100, 2, 0), (150, 5, 1), (50, 3, 1)]
    e = A.real_match_length(c("l"), c("m"), c("g"), F.lit(120))
    assert values(spark, rows, "l int, m int, g int", e) == [98, 116, 46]


def lift(cigar, off, match_start, probe_start):
    """Straight reading of the rule, one operation at a time."""
    import re

    m = ins = dels = 0
    for n, op in re.findall(r"(\d+)([MID])", cigar):
        n = int(n)
        if op == "M":
            m += n
        elif op == "I":
            ins += n
        else:
            if m == off:
                return None
            dels += n
        if m > off:
            break
    return None if m < off else match_start + off + 1 - probe_start + dels - ins


def test_lift_pos(spark):
    rows = [
        (cg, s, o, 500, p)
        for cg in ["50M", "10M2I20M3D20M", "5M1D5M1I40M", "3D50M"]
        for s in "+-" for o in (0, 4, 5, 9, 10, 11, 29, 30, 31, 60) for p in (0, 3)
    ]
    off = lambda side: F.when(c("s") == side, c("o")).otherwise(F.lit(999))
    e = A.lift_pos(c("cg"), c("s"), off("+"), off("-"), c("ms"), c("ps"))
    got = values(spark, rows, "cg string, s string, o int, ms int, ps int", e)
    assert got == [lift(r[0], r[2], r[3], r[4]) for r in rows]


def test_hamming(spark):
    got = values(spark, [("ACGT", "acgA"), ("A", "AC"), ("", "")], "a string, b string", V.hamming(c("a"), c("b"), strict=False))
    assert got == [1, None, 0]


def test_hypergeom(spark):
    rows = [(k, t, m, n) for t in (10, 60, 400) for m in (3, 9) for n in (2, 10) for k in (0, 1, 2, 5)]
    got = values(spark, rows, "k int, t int, m int, n int", ST.hypergeom_sf(c("k"), c("t"), c("m"), c("n")))
    for (k, t, m, n), p in zip(rows, got):
        exact = sum(math.comb(m, i) * math.comb(t - m, n - i) for i in range(k, min(m, n) + 1) if n - i <= t - m)
        assert p == pytest.approx(exact / math.comb(t, n), abs=1e-9)


def test_hypergeom_deep_tails(spark):
    rows = [(k, t, m, n) for t, m, n in [(20000, 600, 400), (3000, 1000, 900), (50, 40, 30), (5, 5, 5), (7, 0, 3), (0, 0, 0)]
            for k in {-1, 0, 1, n // 4, m * n // max(t, 1), m * n // max(t, 1) + 1, n - 1, n, n + 1}]
    got = values(spark, rows, "k int, t int, m int, n int", ST.hypergeom_log_sf(c("k"), c("t"), c("m"), c("n")))
    deepest = 0.0
    for (k, t, m, n), log_p in zip(rows, got):
        exact = sum(math.comb(m, i) * math.comb(t - m, n - i) for i in range(max(k, 0, n + m - t), min(m, n) + 1))
        if not exact:
            assert log_p == -math.inf
            continue
        want = math.log(exact) - math.log(math.comb(t, n))
        assert log_p == pytest.approx(want, rel=1e-6, abs=1e-9), (k, t, m, n)
        deepest = min(deepest, want)
    assert deepest < -400 * math.log(10)
    nothing = values(spark, [(None, 5, 2, 2), (1, None, 2, 2), (9, 5, 2, None)], "k int, t int, m int, n int",
                     ST.hypergeom_log_sf(c("k"), c("t"), c("m"), c("n")))
    assert nothing == [None, None, None]


def test_accession_and_af(spark):
    text = [("S1=0/1;3,7",), ("S2=./.;4,4",), ("S3=1/1;.,5",)]
    a = V.parse_accession(c("t"))
    assert values(spark, text, "t string", a["ref_depth"]) == [3, 0, 0]
    assert values(spark, text, "t string", a["af"]) == [0.7, 0.0, 1.0]
    af = [(0.0,), (0.25,), (0.7499,), (0.75,)]
    assert values(spark, af, "x double", G.gt_from_af(c("x"))) == ["0/0", "0/1", "0/1", "1/1"]


def test_gt_norm(spark):
    rows = [("1|0",), (".",), ("10/2",), ("0/.",), ("1/1",)]
    assert values(spark, rows, "g string", G.gt_norm(c("g"))) == ["0/1", "./.", "2/10", "0/.", "1/1"]


def test_gc_leaves_out_unknown_bases(spark):
    assert values(spark, [("GCNN",), ("atGC",), ("",), ("NN",)], "s string", S.gc_fraction(c("s"))) == [1.0, 0.5, 0.0, 0.0]


def test_probe_with_marker(spark):
    rows = [("ACGTA", 3, 0, "G/T"), ("ACGTA", 9, 0, "G/T"), ("ACGTA", 3, 0, "G")]
    e = S.probe_with_marker(c("s"), c("p"), c("b"), c("a"))
    assert values(spark, rows, "s string, p int, b int, a string", e) == ["AC[G/T]TA", "ACGTA", "ACGTA"]


def test_phenotype(spark):
    rows = [("A", "G", "AA"), ("A", "G", "GG"), ("A", "G", "AG"), ("A", "G", "NN"), ("A", "del", "delTG"), ("A", "ins", "A/insT")]
    e = G.phenotype(c("a"), c("b"), F.lit("TALL"), F.lit("short"), c("g"))
    assert values(spark, rows, "a string, b string, g string", e) == ["Tall", "Short", "Heterozygous", "Missing", "Short", "Heterozygous"]
