"""Operators over long genotype calls.

A call row is ``chrom, pos, ref, alt, sample_id, gt`` plus ``ref_depth`` and
``alt_depth`` where depths are needed.  Pair and trio operators take the small
table of wanted families.  A few families pick their calls from those of a site;
many have each call sent to the families it belongs to and their rows rebuilt with
one conditional aggregate per (family, site).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..functions import variant as V
from .joins import lookup_join

SITE = ["chrom", "pos", "ref", "alt"]


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if empty is None else F.coalesce(r, F.lit(empty))


# --- site and sample statistics ----------------------------------------------


def _call_flags(gt: Column, strict: bool) -> tuple[Column, Column, Column, Column]:
    """Whether a call is missing and heterozygous, and its reference and alternative alleles."""
    a, b = (F.split_part(gt, F.lit("/"), F.lit(k)) for k in (1, 2))
    miss = G.gt_is_missing(gt)
    if strict:
        miss = miss | gt.contains(".")
    hits = lambda x: F.when(miss, 0).otherwise((a == x).cast("int") + (b == x).cast("int"))
    return miss, ~miss & (a != b) & (a != ".") & (b != "."), hits("0"), hits("1")


def _allele_counts(strict: bool) -> dict[str, Column]:
    miss, het, ref, alt = _call_flags(F.col("gt"), strict)
    return {
        "n": F.count("*"), "n_miss": count_if(miss), "n_het": count_if(het),
        "n_ref_alleles": F.sum(ref), "n_alt_alleles": F.sum(alt),
    }


def _rates(c: DataFrame, keys: list[str]) -> DataFrame:
    p = ratio(F.col("n_ref_alleles"), F.col("n_ref_alleles") + F.col("n_alt_alleles"))
    q = ratio(F.col("n_alt_alleles"), F.col("n_ref_alleles") + F.col("n_alt_alleles"))
    return c.select(
        *keys, "n",
        ratio(F.col("n_miss"), F.col("n")).alias("missing"),
        ratio(F.col("n_het"), F.col("n") - F.col("n_miss")).alias("het"),
        F.least(p, q).alias("maf"),
    )


def line_stats(lines: DataFrame, strict: bool = False, keys: list[str] = SITE) -> DataFrame:
    """:func:`site_stats` of rows that hold a whole site, its calls in an array ``gts``.

    One row per line and no shuffle: nothing is exploded.
    """
    total = lambda k: F.aggregate("gts", F.lit(0).cast("bigint"), lambda s, g: s + F.coalesce(_call_flags(g, strict)[k].cast("int"), F.lit(0)))
    counts = {"n": F.size("gts").cast("bigint"), "n_miss": total(0), "n_het": total(1), "n_ref_alleles": total(2), "n_alt_alleles": total(3)}
    return _rates(lines.select(*keys, *[v.alias(k) for k, v in counts.items()]), keys)


def site_stats(calls: DataFrame, strict: bool = False, keys: list[str] = SITE) -> DataFrame:
    """Missing rate, het rate over the called samples and folded MAF per site.

    A partly missing call such as ``0/.`` counts as called with one allele;
    ``strict`` counts it as missing.
    """
    c = calls.groupBy(*keys).agg(*[v.alias(k) for k, v in _allele_counts(strict).items()])
    return _rates(c, keys)


def filter_sites(
    stats: DataFrame, min_maf: float = 0.0, max_missing: float = 1.0,
    biallelic: bool = True, snp_only: bool = False,
) -> DataFrame:
    keep = (F.col("maf") >= min_maf) & (F.col("missing") <= max_missing)
    if biallelic:
        keep = keep & ~F.col("alt").contains(",")
    if snp_only:
        keep = keep & (F.length("ref") == 1) & (F.length("alt") == 1)
    return stats.filter(keep)


def site_stats_indel(calls: DataFrame) -> DataFrame:
    """Site statistics with allele shorthand; per position the best MAF wins
    (ties: the smaller allele string)."""
    c = G.gt_class4(F.col("gt"))
    s = calls.groupBy(*SITE).agg(
        F.count("*").alias("n"), count_if(c == "MISS").alias("m"),
        count_if(c == "HET").alias("h"), count_if(c == "ALT").alias("a"),
    )
    called = F.col("n") - F.col("m")
    af = ratio(2 * F.col("a") + F.col("h"), 2 * called, None)
    short = V.alleles_shorthand(F.col("ref"), F.col("alt"))
    s = s.select(
        V.site_id(F.col("chrom"), F.col("pos")).alias("id"), "chrom", "pos",
        F.concat_ws("/", F.substring("ref", 1, 1), short).alias("alleles"),
        ratio(F.col("m"), F.col("n")).alias("missing"),
        ratio(F.col("h"), called, None).alias("het"),
        F.least(af, 1 - af).alias("maf"),
        V.indel_length(F.col("ref"), F.col("alt")).alias("indel_length"),
        V.variant_class(short).alias("indel_type"),
    )
    rest = [x for x in s.columns if x not in ("chrom", "pos")]
    # a null MAF (no call at all) ranks last; min_by keeps one partial row per task
    best = s.groupBy("chrom", "pos").agg(
        F.min_by(F.struct(*rest), F.struct(-F.coalesce("maf", F.lit(-1.0)), F.col("alleles"))).alias("b")
    )
    return best.select("chrom", "pos", "b.*")


def group_site_stats(calls: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """Genotype-class rates per site for each named sample group.

    ``groups`` is ``sample_id, grp``; samples outside the names are ignored.
    """
    c = G.gt_class4(F.col("gt"))
    aggs = []
    for g in names:
        own = F.col("grp") == g
        n = count_if(own)
        cnt = {k: count_if(own & (c == k.upper())) for k in ("miss", "ref", "het", "alt")}
        aggs += [ratio(v, n).alias(f"{g}_{k}") for k, v in cnt.items()]
        af = ratio(2 * cnt["alt"] + cnt["het"], 2 * (n - cnt["miss"]), None)
        aggs += [af.alias(f"{g}_af"), F.least(af, 1 - af).alias(f"{g}_maf")]
    picked = lookup_join(calls, groups.filter(F.col("grp").isin(names)).select("sample_id", "grp"), "sample_id", spread=SITE)
    return picked.groupBy(*SITE).agg(*aggs)


def specific_sites(
    stats: DataFrame, case: str, control: str, case_min: float = 0.8, control_max: float = 0.01,
    allow_het: bool = True,
) -> DataFrame:
    """Sites where a class is common in the cases and near absent in the controls."""
    kinds = ["alt", "ref"] + (["het"] if allow_het else [])
    hit = lambda k: (F.col(f"{case}_{k}") >= case_min) & (F.col(f"{control}_{k}") < control_max)
    labels = F.array_compact(F.array(*[F.when(hit(k), F.lit(k)) for k in kinds]))
    return stats.withColumn("specific", F.explode(labels))


def _diversity(n_ref: Column, n_het: Column, n_alt: Column) -> list[Column]:
    n = n_ref + n_het + n_alt
    p = ratio(2 * n_ref + n_het, 2 * n, None)
    return [
        p.alias("p_ref"), F.greatest(p, 1 - p).alias("p_major"),
        ratio(n_het, n, None).alias("ho"), V.he(p).alias("he"),
        V.pic(p).alias("pic"), V.shannon(p, 1 - p).alias("shi"),
    ]


def _class_counts() -> dict[str, Column]:
    return {
        "n_ref": count_if(F.col("gt") == "0/0"),
        "n_het": count_if(F.col("gt") == "0/1"),
        "n_alt": count_if(F.col("gt") == "1/1"),
    }


def diversity(calls: DataFrame, by: list[str]) -> DataFrame:
    """Ho, He, PIC and Shannon index per locus or per sample (null if uncalled)."""
    c = calls.groupBy(*by).agg(*[v.alias(k) for k, v in _class_counts().items()])
    return c.select(*by, *_diversity(F.col("n_ref"), F.col("n_het"), F.col("n_alt")))


def class_summary(df: DataFrame, by: list[str], col: str, classes: list[str]) -> DataFrame:
    """Count and row ratio of each class per ``by`` group."""
    total = F.count_if(F.col(col).isin(classes))
    aggs = []
    for k in classes:
        n = count_if(F.col(col) == k)
        aggs += [n.alias(f"{k}_count"), ratio(n, total).alias(f"{k}_ratio")]
    return df.groupBy(*by).agg(*aggs)


def hdplot(calls: DataFrame) -> DataFrame:
    """Het read ratio, its deviation D and the het share H per site."""
    het = F.split_part("gt", F.lit("/"), F.lit(1)) != F.split_part("gt", F.lit("/"), F.lit(2))
    called = ~G.gt_is_missing(F.col("gt"))
    het = het & called
    s = calls.groupBy(*SITE).agg(
        F.sum(F.when(het, F.col("ref_depth")).otherwise(0)).alias("depth_a"),
        F.sum(F.when(het, F.col("alt_depth")).otherwise(0)).alias("depth_b"),
        count_if(het).alias("num_hets"),
        F.count("*").alias("num_samples"),
        count_if(called).alias("num_called"),
    )
    n = F.col("depth_a") + F.col("depth_b")
    std = F.sqrt(n * 0.25)
    return s.withColumns(
        {
            "ratio": ratio(F.col("depth_a"), n),
            "h_all": ratio(F.col("num_hets"), F.col("num_samples")),
            "h": ratio(F.col("num_hets"), F.col("num_called")),
            "std": std,
            "d": ratio(F.col("depth_a") - n / 2, std),
        }
    )


def filter_paralogs(hd: DataFrame, h: float = 0.5, d: float = 3.0, either: bool = False) -> DataFrame:
    a, b = F.col("h") > h, F.abs("d") > d
    return hd.filter((a | b) if either else (a & b))


# --- reshaping ---------------------------------------------------------------


def to_long(wide: DataFrame, samples: list[str], site: list[str] = SITE) -> DataFrame:
    return wide.unpivot(site, samples, "sample_id", "gt")


def to_wide(calls: DataFrame, samples: list[str], site: list[str] = SITE, value: str = "gt") -> DataFrame:
    """One column per listed sample; the list is explicit so no extra job runs."""
    cols = [F.max(F.when(F.col("sample_id") == s, F.col(value))).alias(s) for s in samples]
    return calls.groupBy(*site).agg(*cols)


def explode_alts(sites: DataFrame) -> DataFrame:
    """One row per alternate allele with its index and ``chrom_pos_k`` id."""
    return (
        sites.select("*", F.posexplode(F.split("alt", ",")).alias("_k", "_a"))
        .withColumns({"alt": F.col("_a"), "alt_index": F.col("_k") + 1})
        .withColumn("id", F.concat_ws("_", "chrom", "pos", "alt_index"))
        .drop("_k", "_a")
    )


def filter_calls(calls: DataFrame, min_depth: int = 5, min_af: float = 0.2) -> DataFrame:
    """Called, single-alternate rows with enough depth and alternate share."""
    depth = F.col("ref_depth") + F.col("alt_depth")
    return calls.filter(
        ~F.col("alt").contains(",") & ~G.gt_is_missing(F.col("gt"))
        & (depth >= min_depth) & (F.try_divide(F.col("alt_depth"), depth) >= min_af)
    )


def polymorphic_sites(calls: DataFrame, p1: list[str], p2: list[str]) -> DataFrame:
    """Sites where both parents (one or more lines each) are fixed and differ."""
    def side(names: list[str], tag: str) -> list[Column]:
        own = F.when(F.col("sample_id").isin(names), F.col("gt"))
        return [F.min(own).alias(f"{tag}_lo"), F.max(own).alias(f"{tag}_hi"), F.count(own).alias(f"{tag}_n")]

    parents = calls.filter(F.col("sample_id").isin(p1 + p2))
    s = parents.groupBy(*SITE).agg(*side(p1, "p1"), *side(p2, "p2"))
    fixed = lambda t, k: (
        (F.col(f"{t}_lo") == F.col(f"{t}_hi")) & (F.col(f"{t}_n") == k)
        & ~F.col(f"{t}_lo").isin("./.", "0/1")
    )
    return s.filter(
        fixed("p1", len(p1)) & fixed("p2", len(p2)) & (F.col("p1_lo") != F.col("p2_lo"))
    ).select(*SITE, F.col("p1_lo").alias("p1_gt"), F.col("p2_lo").alias("p2_gt"))


# --- pairs -------------------------------------------------------------------


def sample_pairs(samples: DataFrame) -> DataFrame:
    """All unordered pairs of a sample list (the list itself, not the calls).

    Each sample names the ordinals behind it and meets them by an equi join.
    """
    names = samples.select("sample_id").distinct()
    # one row per sample
    ids = names.withColumn("n", F.row_number().over(Window.orderBy("sample_id")))
    total = names.agg(F.count("*").cast("int")).scalar()
    a = ids.filter(F.col("n") < total).select(
        F.col("sample_id").alias("sample_a"), F.explode(F.sequence(F.col("n") + 1, total)).alias("n")
    )
    return a.join(ids.withColumnRenamed("sample_id", "sample_b"), "n").select("sample_a", "sample_b")


#: Families up to which each site looks for all of them among its calls.
FEW_FAMILIES = 200


def _families(table: DataFrame, roles: dict[str, str]) -> DataFrame:
    cols = list(roles.values())
    members = F.array(
        *[F.struct(F.lit(r).alias("role"), F.col(c).alias("sample_id")) for r, c in roles.items()]
    )
    return table.select(*cols, F.explode(members).alias("m")).select(*cols, "m.role", "m.sample_id")


def _families_at_sites(calls: DataFrame, few: DataFrame, roles: dict[str, str], values: list[str], site: list[str]) -> DataFrame:
    """:func:`family_calls` of few families: a site's calls of their members meet once, then the
    families pick from them, so that no call is sorted once for every family that it belongs to."""
    cols = list(roles.values())
    members = few.select(F.explode(F.array(*cols)).alias("sample_id")).distinct()
    own = calls.select(*site, "sample_id", *values).join(F.broadcast(members), "sample_id", "left_semi")
    at = own.groupBy(*site).agg(F.collect_list(F.struct("sample_id", *values)).alias("_c")).crossJoin(F.broadcast(few))
    of = lambda c: F.filter("_c", lambda x: x["sample_id"] == F.col(c))
    found = F.struct(*[of(c).alias(r) for r, c in roles.items()])
    whole = lambda x: F.forall(F.array(*[F.size(x[r]) for r in roles]), lambda n: n > 0)
    out = at.select(*cols, *site, F.explode(F.filter(F.array(found), whole)).alias("_f"))
    return out.select(*cols, *site, *[F.array_max(F.col(f"_f.{r}.{v}")).alias(f"{r}_{v}") for r in roles for v in values])


def family_calls(
    calls: DataFrame, table: DataFrame, roles: dict[str, str], values: list[str] = ["gt"],
    site: list[str] = SITE,
) -> DataFrame:
    """One row per (family, site) at which every member has a call row.

    ``roles`` maps a role to the column of ``table`` that names its sample; the
    outcome has ``<role>_<value>`` columns.
    """
    cols = list(roles.values())
    few = table.select(*cols).distinct()
    if few.limit(FEW_FAMILIES + 1).count() <= FEW_FAMILIES:
        return _families_at_sites(calls, few, roles, values, site)
    j = lookup_join(calls.select(*site, "sample_id", *values), _families(table, roles), "sample_id", spread=site)
    aggs = [
        F.max(F.when(F.col("role") == r, F.col(v))).alias(f"{r}_{v}") for r in roles for v in values
    ]
    have = [F.count_if(F.col("role") == r).alias(f"_n_{r}") for r in roles]
    out = j.groupBy(*cols, *site).agg(*aggs, *have)
    for r in roles:
        out = out.filter(F.col(f"_n_{r}") > 0)
    return out.drop(*[f"_n_{r}" for r in roles])


PAIR = {"a": "sample_a", "b": "sample_b"}
TRIO = {"father": "father", "mother": "mother", "child": "child"}


def pair_calls(calls: DataFrame, pairs: DataFrame, values: list[str] = ["gt"]) -> DataFrame:
    return family_calls(calls, pairs, PAIR, values)


def trio_calls(calls: DataFrame, pedigree: DataFrame) -> DataFrame:
    return family_calls(calls, pedigree, TRIO)


_PAIR_COUNTS = [
    "sites", "valid", "a_hom", "a_het", "b_hom", "b_het", "both_hom", "equal", "hom_equal",
]


def _pair_report(c: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col
    het = n("valid") - n("both_hom")
    het_equal = n("equal") - n("hom_equal")
    pct = lambda a, b: ratio(100 * a, b)
    return c.select(
        *keys, "sites", "valid", "a_hom", "a_het", "b_hom", "b_het", "equal",
        pct(n("equal"), n("valid")).alias("equal_pct"),
        "hom_equal", pct(n("hom_equal"), n("both_hom")).alias("hom_equal_pct"),
        het_equal.alias("het_equal"), pct(het_equal, het).alias("het_equal_pct"),
        (n("valid") - n("equal")).alias("not_equal"),
        pct(n("valid") - n("equal"), n("valid")).alias("not_equal_pct"),
    )


def compare_samples(calls: DataFrame, pairs: DataFrame, by_chrom: bool = False) -> DataFrame:
    """Genotype agreement of the listed sample pairs, overall or per chromosome."""
    p = pair_calls(calls, pairs)
    a, b = G.gt_class3(F.col("a_gt")), G.gt_class3(F.col("b_gt"))
    valid = (a != "MISS") & (b != "MISS")
    both = valid & (a == "HOM") & (b == "HOM")
    same = F.col("a_gt") == F.col("b_gt")
    keys = ["sample_a", "sample_b"] + (["chrom"] if by_chrom else [])
    c = p.groupBy(*keys).agg(
        F.count("*").alias("sites"), count_if(valid).alias("valid"),
        count_if(valid & (a == "HOM")).alias("a_hom"), count_if(valid & (a == "HET")).alias("a_het"),
        count_if(valid & (b == "HOM")).alias("b_hom"), count_if(valid & (b == "HET")).alias("b_het"),
        count_if(both).alias("both_hom"), count_if(valid & same).alias("equal"),
        count_if(both & same).alias("hom_equal"),
    )
    return _pair_report(c, keys)


def _block_counter():
    """The per-block function, nested so that workers need not import this package."""

    def block_counts(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pair counts of one block from a sample x site matrix of codes.

        A code is ``1000 a + b`` of the two alleles, or -1 for a missing call.
        """
        samples, s_ix = np.unique(pdf["sample_id"].to_numpy(dtype=str), return_inverse=True)
        site_ix = pdf.groupby(["pos", "alleles"], sort=False).ngroup().to_numpy()
        code = pdf["code"].to_numpy()
        grid = np.full((len(samples), site_ix.max() + 1), -2, dtype=np.int32)
        grid[s_ix, site_ix] = code
        hom_code = (grid >= 0) & (grid // 1000 == grid % 1000)
        present, valid, homs = ((m).astype(np.float32) for m in (grid > -2, grid >= 0, hom_code))
        # float32 is exact here: a block has far fewer than 2**24 sites
        equal = np.zeros((len(samples), len(samples)), dtype=np.float32)
        hom_equal = np.zeros_like(equal)
        for k in np.unique(code[code >= 0]):
            one = (grid == k).astype(np.float32)
            both = one @ one.T
            equal += both
            if k // 1000 == k % 1000:
                hom_equal += both
        i, j = np.triu_indices(len(samples), 1)
        pick = lambda m: m[i, j].astype(np.int64)
        vv, hv, hh = valid @ valid.T, homs @ valid.T, homs @ homs.T
        return pd.DataFrame(
            {
                "sample_a": samples[i], "sample_b": samples[j],
                "sites": pick(present @ present.T), "valid": pick(vv),
                "a_hom": pick(hv), "a_het": pick(vv - hv),
                "b_hom": pick(hv.T), "b_het": pick(vv - hv.T),
                "both_hom": pick(hh), "equal": pick(equal), "hom_equal": pick(hom_equal),
            }
        )

    return block_counts


def compare_all_samples(calls: DataFrame, width: int = 20_000) -> DataFrame:
    """Agreement of every sample pair.

    Joining all pairs at each site would give samples^2 rows per site.  Instead
    each block of ``width`` bases becomes a sample x site matrix whose products
    are the pair counts, so a block emits one row per pair and Spark sums the
    blocks.  A block holds at most ``width`` positions of each sample.
    """
    schema = "sample_a string, sample_b string, " + ", ".join(f"{c} bigint" for c in _PAIR_COUNTS)
    block = F.floor(F.col("pos") / width)
    part = lambda i: F.split_part("gt", F.lit("/"), F.lit(i)).try_cast("int")
    code = F.coalesce(part(1) * 1000 + part(2), F.lit(-1))
    # numbers stand for the allele texts; they only tell records of one position apart
    x = calls.select(
        "chrom", block.alias("block"), "pos", F.xxhash64("ref", "alt").alias("alleles"),
        "sample_id", code.alias("code"),
    )
    out = x.groupBy("chrom", "block").applyInPandas(_block_counter(), schema)
    c = out.groupBy("sample_a", "sample_b").agg(*[F.sum(x).alias(x) for x in _PAIR_COUNTS])
    return _pair_report(c, ["sample_a", "sample_b"])


def repeat_sites(calls: DataFrame, pairs: DataFrame, min_depth: int = 10) -> DataFrame:
    """Replicate pair rows with both depths high enough and both called."""
    d = calls.withColumn("depth", F.col("ref_depth") + F.col("alt_depth"))
    p = pair_calls(d, pairs, ["gt", "depth"])
    return p.filter(
        (F.col("a_depth") >= min_depth) & (F.col("b_depth") >= min_depth)
        & ~G.gt_is_missing(F.col("a_gt")) & ~G.gt_is_missing(F.col("b_gt"))
    ).withColumn("same", F.col("a_gt") == F.col("b_gt"))


def repeatability(calls: DataFrame, pairs: DataFrame, min_depth: int = 10) -> DataFrame:
    same = count_if(F.col("same"))
    return repeat_sites(calls, pairs, min_depth).groupBy("sample_a", "sample_b").agg(
        F.count("*").alias("total"), same.alias("consistent"),
        ratio(same, F.count("*")).alias("repeatability"),
    )


def repeatability_sites(calls: DataFrame, pairs: DataFrame, min_depth: int = 10) -> DataFrame:
    """Consistent and inconsistent pair counts per site."""
    return repeat_sites(calls, pairs, min_depth).groupBy("chrom", "pos").agg(
        count_if(F.col("same")).alias("consist_count"),
        count_if(~F.col("same")).alias("in_consist_count"),
    )


def recovery_rate(calls: DataFrame, pairs: DataFrame) -> DataFrame:
    """Background recovery of ``sample_b`` towards its parent ``sample_a``."""
    p = pair_calls(calls, pairs).withColumns(
        {"a_gt": G.gt_norm(F.col("a_gt")), "b_gt": G.gt_norm(F.col("b_gt"))}
    )
    base = F.col("a_gt").isin("0/0", "1/1")
    called = base & (F.col("b_gt") != "./.")
    same = called & (F.col("a_gt") == F.col("b_gt"))
    other = called & (F.col("a_gt") != F.col("b_gt")) & F.col("b_gt").isin("0/0", "1/1")
    het = called & (F.col("b_gt") == "0/1")
    c = p.groupBy("sample_a", "sample_b").agg(
        count_if(base).alias("total"), count_if(same).alias("a_sites"),
        count_if(other).alias("b_sites"), count_if(het).alias("h_sites"),
        (count_if(base) - count_if(called)).alias("n_sites"),
    )
    a, b, h = F.col("a_sites"), F.col("b_sites"), F.col("h_sites")
    n_rate = ratio(F.col("n_sites"), F.col("total"), None)
    return c.withColumns(
        {
            "bc_rate": ratio(a + 0.5 * h, a + b + h),
            "n_rate": n_rate,
            "het_rate": ratio(h, F.col("total") - F.col("n_sites"), None),
        }
    ).filter(F.col("n_rate") < 1)


def site_differences(calls: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Share of differing genotypes per pair and chromosome window ``(l, r]``."""
    p = pair_calls(calls, pairs)
    ok = ~G.gt_is_missing(F.col("a_gt")) & ~G.gt_is_missing(F.col("b_gt"))
    end = (F.ceil(F.col("pos") / width) * width).cast("bigint")
    return (
        p.filter(ok)
        .groupBy("sample_a", "sample_b", "chrom", (end - width).alias("start"), end.alias("end"))
        .agg(F.count("*").alias("n"), count_if(F.col("a_gt") != F.col("b_gt")).alias("n_diff"))
        .withColumn("diff_share", ratio(F.col("n_diff"), F.col("n")))
    )


def dissimilarity(calls: DataFrame) -> DataFrame:
    """Distance of each sample pair: 1 - equal share of the shared calls."""
    return compare_all_samples(calls).select(
        "sample_a", "sample_b", "valid", (1 - F.col("equal_pct") / 100).alias("distance")
    )


# --- trios -------------------------------------------------------------------


def mendel_sites(calls: DataFrame, pedigree: DataFrame) -> DataFrame:
    """Per trio and site: ``missing`` / ``consistent`` / ``inconsistent``."""
    t = trio_calls(calls, pedigree)
    gts = [F.col(f"{r}_gt") for r in TRIO]
    miss = F.lit(False)
    for g in gts:
        miss = miss | g.contains(".")
    return t.withColumn(
        "status",
        F.when(miss, "missing").when(G.mendel_ok(*gts), "consistent").otherwise("inconsistent"),
    )


def mendel_summary(calls: DataFrame, pedigree: DataFrame) -> DataFrame:
    s = mendel_sites(calls, pedigree)
    n = lambda k: count_if(F.col("status") == k)
    c = s.groupBy("father", "mother", "child").agg(
        F.count("*").alias("total"), n("consistent").alias("consistent"),
        n("inconsistent").alias("inconsistent"), n("missing").alias("missing"),
    )
    return c.withColumns(
        {
            "rate": ratio(F.col("consistent"), F.col("total") - F.col("missing")),
            "status": F.when(F.col("inconsistent") == 0, "ok").otherwise("inconsistent"),
        }
    )


def mendel_report(summary: DataFrame) -> DataFrame:
    ok = count_if(F.col("inconsistent") == 0)
    return summary.agg(
        F.count("*").alias("families"), ok.alias("consistent_families"),
        F.avg("rate").alias("mean_rate"), F.sum("inconsistent").alias("inconsistent"),
        ratio(F.sum("inconsistent"), F.sum("total") - F.sum("missing")).alias("error_rate"),
    )


def worst_families(summary: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` least consistent families that have a problem at all."""
    ordered = summary.orderBy("rate", "father", "mother", "child").limit(k)
    return ordered.filter(F.col("inconsistent") > 0)


def filter_hom_trios(trios: DataFrame, roles: list[str]) -> DataFrame:
    """Biallelic sites where every member is ``0/0`` or ``1/1``."""
    keep = ~F.col("alt").contains(",")
    for r in roles:
        keep = keep & F.col(f"{r}_gt").isin("0/0", "1/1")
    return trios.filter(keep)


OFFSPRING = {"p1": "p1", "p2": "p2", "child": "child"}


def contribution(calls: DataFrame, families: DataFrame, groups: DataFrame) -> DataFrame:
    """Parental share of a child's differing sites per chromosome, chromosome
    group and in total; ``families`` is ``p1, p2, child`` and ``groups`` is
    ``chrom, chrom_group``."""
    t = filter_hom_trios(family_calls(calls, families, OFFSPRING), list(OFFSPRING))
    d = t.filter(F.col("p1_gt") != F.col("p2_gt"))
    d = lookup_join(d, groups.select("chrom", "chrom_group").distinct(), "chrom", "left")
    cols = list(OFFSPRING)
    own = lambda p: count_if(F.col(f"{p}_gt") == F.col("child_gt"))
    sets = [[*cols, "chrom"], [*cols, "chrom_group"], cols]
    g = d.groupingSets([[F.col(c) for c in s] for s in sets], *cols, "chrom", "chrom_group").agg(
        F.grouping("chrom").alias("_no_chrom"), F.grouping("chrom_group").alias("_no_group"),
        F.count("*").alias("n_diff"), own("p1").alias("n_p1"), own("p2").alias("n_p2"),
    )
    level = F.when(F.col("_no_chrom") == 0, "chrom").when(F.col("_no_group") == 0, "group").otherwise("total")
    label = F.when(level == "chrom", F.col("chrom")).when(level == "group", F.col("chrom_group")).otherwise("total")
    return g.select(
        *cols, level.alias("level"), label.alias("label"), "n_diff", "n_p1",
        ratio(100 * F.col("n_p1"), F.col("n_diff")).alias("p1_pct"), "n_p2",
        ratio(100 * F.col("n_p2"), F.col("n_diff")).alias("p2_pct"),
    ).filter(F.col("label").isNotNull())


def origin_track(calls: DataFrame, families: DataFrame) -> DataFrame:
    """Per site of a child: all_same / p1 / p2 / specific (homozygous sites)."""
    t = filter_hom_trios(family_calls(calls, families, OFFSPRING), list(OFFSPRING))
    return t.withColumn("origin", G.origin(F.col("child_gt"), F.col("p1_gt"), F.col("p2_gt")))


def join_pheno(gt: DataFrame, pheno: DataFrame) -> DataFrame:
    """Calls joined to described alleles on (chrom, pos), consistent ones only."""
    j = gt.join(pheno, ["chrom", "pos"])
    return j.filter(G.pheno_alleles_match(*[F.col(c) for c in ("allele1", "allele2", "ref", "alt")]))
