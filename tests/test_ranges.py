"""Ranges of plain, bgzip and gzip files, and the VCF source over them."""

import gzip
import random

import pytest

from locusframe.operators import probes
from locusframe.sources import fasta, vcf
from locusframe.sources.bgzip import END, block, write_bgzip
from locusframe.sources.ranges import cut, lines


def packed(text: bytes, how: str, size: int) -> bytes:
    if how == "plain":
        return text
    if how == "gzip":
        return gzip.compress(text[: len(text) // 2]) + gzip.compress(text[len(text) // 2 :])
    return b"".join(block(text[lo : lo + size]) for lo in range(0, len(text), size)) + END


@pytest.mark.parametrize("how", ["plain", "bgzip", "gzip"])
def test_every_line_once(tmp_path, how):
    rng = random.Random(how)
    for k in range(25):
        rows = [bytes(rng.choice(b"abc\x1f\x8b\x08\x04") for _ in range(rng.choice([0, 1, 5, 300, 3000]))) for _ in range(rng.randrange(0, 60))]
        text = b"\n".join(rows) + b"\n" * rng.randrange(2)
        path = tmp_path / f"{k}"
        path.write_bytes(packed(text, how, rng.choice([7, 500, 4000])))
        for most in (1, 50, 333, 5000, 1 << 40):
            parts = cut([f"file:{path}"], max(most, len(text) // 200))
            assert b"".join(p for part in parts for p in lines(part)) == text


def cohort(n=3000):
    rng = random.Random(1)
    head = ["##fileformat=VCFv4.2", "##contig=<ID=chr1>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\tC"]
    body, calls = [], []
    for k in range(n):
        form = rng.choice(["GT", "GT:AD:DP", "DP:GT"])
        gts = [rng.choice(["0/0", "0|1", "1/1", ".", "./."]) for _ in "ABC"]
        text = {"GT": lambda g: g, "GT:AD:DP": lambda g: rng.choice([g, g + ":3,4:7", g + ":3"]), "DP:GT": lambda g: "9:" + g}[form]
        body.append("\t".join([f"chr{k % 3}", str(k * 10 + 1), f"id{k}", "A", "G", ".", ".", ".", form, *map(text, gts)]))
        calls += [(f"chr{k % 3}", k * 10 + 1, s, {".": "./."}.get(g, g).replace("|", "/")) for s, g in zip("ABC", gts)]
    body.append("chr9\t5\tid\tA\tC,T\t.\t.\t.\tGT\t0/1")
    calls += [("chr9", 5, "A", "0/1"), ("chr9", 5, "B", "./."), ("chr9", 5, "C", "./.")]
    return "\n".join(head + body) + "\n", sorted(calls)


def got(df):
    return sorted(tuple(r) for r in df.select("chrom", "pos", "sample_id", "gt").collect())


@pytest.mark.parametrize("how", ["plain", "bgzip", "gzip"])
def test_vcf_by_many_tasks(spark, tmp_path, how):
    text, calls = cohort()
    (tmp_path / "a b.vcf.gz").write_bytes(packed(text.encode(), how, 8000))
    df = vcf.read_vcf_calls(spark, str(tmp_path), split=9_000)
    assert got(df) == calls
    assert df.rdd.getNumPartitions() == -(-(tmp_path / "a b.vcf.gz").stat().st_size // 9_000) > 2
    plan = df._jdf.queryExecution().toString()
    assert plan.count("BatchScan") == 1 and "Join" not in plan
    some = df.filter("chrom = 'chr1' and pos > 1000 and pos <= 20000")
    assert got(some) == [c for c in calls if c[0] == "chr1" and 1000 < c[1] <= 20000]
    assert vcf.read_vcf_sites(spark, str(tmp_path), split=9_000).count() == 3001
    assert [r["sample_id"] for r in vcf.vcf_samples(spark, str(tmp_path)).orderBy("ordinal").collect()] == ["A", "B", "C"]


def test_pushed_filters_drop_lines():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

    reader = vcf.VcfReader({"mode": "calls", "files": "[]", "split": "1", "fields": '["GT"]'})
    filters = [In(("chrom",), ("a", "b")), EqualTo(("chrom",), "a"), GreaterThan(("pos",), 5), LessThanOrEqual(("pos",), 9), IsNotNull(("pos",))]
    assert list(reader.pushFilters(filters)) == filters
    assert [reader._wanted(x) for x in (b"a\t6\t", b"b\t6\t", b"a\t4\t", b"a\t10\t")] == [True, False, False, False]


def test_written_parts_are_one_file(spark, tmp_path):
    rows = [f"line {k}" for k in range(20000)]
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, value string").repartition(3)
    write_bgzip(df.repartitionByRange(4, "k").sortWithinPartitions("k"), path)
    parts = sorted((tmp_path / "out").iterdir())
    assert [p.name for p in parts] == [f"part-{k:05d}.gz" for k in range(4)]
    assert gzip.decompress(b"".join(p.read_bytes() for p in parts)).decode().split("\n")[:-1] == rows


def test_parts_without_a_header(spark, tmp_path):
    text, calls = cohort(60)
    rows = text.split("\n")
    for k, lo in enumerate(range(0, len(rows), 25)):
        (tmp_path / f"part-{k}").write_text("\n".join(rows[lo : lo + 25]) + "\n")
    assert got(vcf.read_vcf_calls(spark, str(tmp_path))) == calls


def test_fasta_by_ranges(spark, tmp_path):
    rng = random.Random(9)
    folder = tmp_path / "fa"
    folder.mkdir()
    exp = []
    for name in ("a.fa", "b.fa.gz"):
        text = "stray line\n"
        for k in range(rng.randrange(8, 14)):
            seq = "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 5, 59, 60, 61, 700, 9000])))
            text += f">s{k % 3} note > {k}\r\n" + "".join(seq[i : i + 60] + "\n" for i in range(0, len(seq), 60)) + "\n" * (k % 2)
            exp.append((name, k + 1, f"s{k % 3}", f"note > {k}", seq))
        (folder / name).write_bytes(packed(text.encode(), "bgzip" if name.endswith("gz") else "plain", 900))
    for split, width in ((700, 100), (2500, 33), (1 << 30, 10_000)):
        rows = {}
        for r in fasta.read_fasta_pieces(spark, str(folder), width, split).collect():
            assert len(r["seq"]) <= width
            rows.setdefault((r["file"].rpartition("/")[2], r["record"], r["seq_id"], r["description"]), []).append((r["start"], r["seq"]))
        got = []
        for key, pieces in rows.items():
            seq = ""
            for start, s in sorted(pieces):
                assert start == len(seq)
                seq += s
            got.append((*key, seq))
        assert sorted(got) == sorted(exp)


def test_tiles_of_pieces_are_those_of_records(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(probes, "SPAN", 3)
    seqs = {f"r{k}": "".join(rng.choice("ACGT") for _ in range(n)) for k, n in enumerate([3, 12, 13, 72, 73, 84, 500, 1001])}
    (tmp_path / "x.fa").write_text("".join(f">{k}\n{s}\n" for k, s in seqs.items()))
    pieces = fasta.read_fasta_pieces(spark, str(tmp_path), 17, 90)
    records = spark.createDataFrame(list(seqs.items()), "seq_id string, seq string")
    for op in (probes.tile_sequence, probes.best_gc_tile):
        assert sorted(map(tuple, op(pieces, 12).collect())) == sorted(map(tuple, op(records, 12).collect())) != []
    chunks = probes.genome_from_pieces(pieces, 50).collect()
    assert all(r["seq"] == seqs[r["chrom"]][r["chunk_no"] * 50 :][:50] for r in chunks) and sum(len(r["seq"]) for r in chunks) == sum(map(len, seqs.values()))
