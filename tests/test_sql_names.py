"""SQL functions against their Column forms, over odd values."""

from pyspark.sql import functions as F

from locusframe.functions import alignment as A
from locusframe.functions import genotype as G
from locusframe.functions import sql
from locusframe.functions import variant as V


def same(frame, **pairs):
    both = [c for name, (column, text) in pairs.items() for c in (column.alias(name), F.expr(text).alias(f"{name}_sql"))]
    for row in frame.select(*both).collect():
        for name in pairs:
            assert row[name] == row[f"{name}_sql"], (name, row)


def test_sql_functions_equal_columns(spark):
    sql.register(spark)
    gts = [None, "", ".", "./.", ".|.", "0/0", "0|1", "1/0", "1|0", "2/1", "10/9", "01/0", "./1", "1/.", "0", "x/y"]
    gt = F.col("gt")
    same(
        spark.createDataFrame([(g,) for g in gts], "gt string"),
        norm=(G.gt_norm(gt), "gt_norm(gt)"), class4=(G.gt_class4(gt), "gt_class4(gt)"),
    )
    x = F.col("x")
    same(
        spark.createDataFrame([(v,) for v in (None, 0.0, 0.1, 0.25, 0.5, 0.6, 0.75, 1.0)], "x double"),
        pic=(V.pic(x), "pic(x)"), fold=(V.fold_maf(x), "fold_maf(x)"), from_af=(G.gt_from_af(x), "gt_from_af(x)"),
    )
    alleles = [(r, a, p) for r in ("G", "C", "A", "", None) for a in ("A", "T", "GA", None) for p in (7, None)]
    ref, alt, pos = F.col("ref"), F.col("alt"), F.col("pos")
    same(
        spark.createDataFrame(alleles, "ref string, alt string, pos bigint"),
        ems=(V.is_ems(ref, alt), "is_ems(ref, alt)"), site=(V.site_id(ref, pos), "site_id(ref, pos)"),
    )
    lengths = [(n, m, g, p) for n in (90, 120, 130, None) for m in (0, 3, None) for g in (0, 2) for p in (120, None)]
    same(
        spark.createDataFrame(lengths, "n int, m int, g int, p int"),
        real=(A.real_match_length(*map(F.col, "nmgp")), "real_match_length(n, m, g, p)"),
    )
