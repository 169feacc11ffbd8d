"""Mutant-population summaries over calls joined to effect annotation.

A row is ``chrom, pos, refer, alt, type, impact, gene, protein_pos, sample_id,
genotype, ref_depth, alt_depth``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..functions import variant as V
from .calls import count_if, ratio

SITE = ["chrom", "pos", "refer", "alt"]

# Report order of the transitions and effect classes.
TRANSITIONS = ["C:G>T:A", "T:A>C:G"]
EFFECTS = [
    "stop_gained/lost", "start_lost", "frameshift_variant", "splice_site_variant",
    "missense_variant", "synonymous_variant", "5_prime_UTR_variant", "3_prime_UTR_variant",
    "upstream_gene_variant", "downstream_gene_variant",
]


def build_db(accessions: DataFrame, annotation: DataFrame, min_depth: int = 5, min_af: float = 0.2) -> DataFrame:
    """Packed accessions filtered and joined to one annotation row per site."""
    # parsed once a row: a filter on columns would be moved below and parse once a condition
    passed = lambda a: (a["gt"] != G.MISSING) & (a["ref_depth"] + a["alt_depth"] >= min_depth) & (a["af"] >= min_af)
    good = F.filter(F.array(V.parse_accession(F.col("accession"))), passed)
    flat = accessions.filter(~F.col("alt").contains(",")).select(*SITE, F.explode(good).alias("a"))
    flat = flat.select(*SITE, "a.sample_id", F.col("a.gt").alias("genotype"), "a.ref_depth", "a.alt_depth")
    rest = [c for c in annotation.columns if c not in SITE]
    one = annotation.groupBy(*SITE).agg(F.min(F.struct(*rest)).alias("_x")).select(*SITE, "_x.*")
    return flat.join(one, SITE)


def sites(db: DataFrame) -> DataFrame:
    """One row per distinct variant."""
    return db.groupBy(*SITE).agg(
        F.min(F.struct("type", "impact", "gene", "protein_pos")).alias("x")
    ).select(*SITE, "x.*", V.snp_ins_del(F.col("refer"), F.col("alt")).alias("kind"))


def mutant_overview(db: DataFrame, genes: DataFrame, cds: DataFrame) -> DataFrame:
    """One-row overview; each part is a scalar aggregate."""
    s = sites(db)
    snp = F.col("kind") == "snp"
    ems = V.is_ems(F.col("refer"), F.col("alt"))
    in_cds = snp & F.col("protein_pos").isNotNull()
    in_gene = snp & (F.col("type") != "intergenic_region")
    total = s.agg(
        F.count("*").alias("total_variants"), count_if(snp).alias("total_snp"),
        count_if(F.col("kind") == "ins").alias("total_ins"), count_if(F.col("kind") == "del").alias("total_del"),
        count_if(in_cds).alias("cds_snp"), count_if(in_cds & ems).alias("cds_ems_snp"),
        count_if(in_gene).alias("gene_snp"), count_if(in_gene & ems).alias("gene_ems_snp"),
    )
    depth = db.agg(F.floor(F.avg(F.col("ref_depth") + F.col("alt_depth"))).cast("bigint")).scalar()
    cds_len = cds.agg(F.sum(F.col("end") - F.col("start"))).scalar()
    n_genes = genes.agg(F.count("*")).scalar()
    hit = s.filter(F.col("impact").isin("HIGH", "MODERATE")).join(genes.select(F.col("gene_id").alias("gene")), "gene", "left_semi")
    n_hit = hit.agg(F.countDistinct("gene")).scalar()
    return total.withColumns(
        {
            "avg_cov": depth,
            "cds_ems_rate": ratio(F.col("cds_ems_snp"), F.col("cds_snp")),
            "gene_ems_rate": ratio(F.col("gene_ems_snp"), F.col("gene_snp")),
            "per_cds_kb": F.try_divide(F.col("total_variants"), cds_len / 1000),
            "impacted_genes": n_hit, "total_genes": n_genes,
        }
    ).withColumn("impacted_rate", ratio(F.col("impacted_genes"), F.col("total_genes")))


def variants_by_chrom(db: DataFrame, sizes: DataFrame) -> DataFrame:
    kind = lambda k: count_if(F.col("kind") == k).alias(k)
    c = sites(db).groupBy("chrom").agg(kind("snp"), kind("ins"), kind("del"), F.count("*").alias("total"))
    return sizes.join(c, "chrom")


def ts_tv(db: DataFrame) -> DataFrame:
    """Strand-collapsed changes with subtotals and the transition ratio."""
    snp = sites(db).filter((F.length("refer") == 1) & (F.length("alt") == 1))
    c = snp.groupBy(V.strand_change(F.col("refer"), F.col("alt")).alias("change")).agg(F.count("*").alias("n"))
    is_ts = F.col("change").isin(TRANSITIONS)
    t = c.agg(F.sum(F.when(is_ts, F.col("n")).otherwise(0)).alias("ts"), F.sum(F.when(~is_ts, F.col("n")).otherwise(0)).alias("tv"))
    rows = F.array(
        F.struct(F.lit("Total transitions").alias("change"), F.col("ts").cast("double").alias("n")),
        F.struct(F.lit("Total transversions").alias("change"), F.col("tv").cast("double").alias("n")),
        F.struct(F.lit("Transitions/transversions").alias("change"), F.round(ratio(F.col("ts"), F.col("tv"), None), 1).alias("n")),
    )
    return c.select("change", F.col("n").cast("double").alias("n")).unionByName(
        t.select(F.explode(rows).alias("r")).select("r.*")
    )


def genes_by_effect(db: DataFrame, genes: DataFrame) -> DataFrame:
    """Distinct annotated genes hit per effect class."""
    s = sites(db).join(genes.select(F.col("gene_id").alias("gene")), "gene", "left_semi")
    return s.groupBy(V.first_effect(F.col("type")).alias("effect")).agg(F.countDistinct("gene").alias("genes"))


def sample_effects(db: DataFrame, effects: list[str] = EFFECTS) -> DataFrame:
    """Mutations of each sample per effect class, with its C:G>T:A count."""
    e = V.first_effect(F.col("type"))
    snp = (F.length("refer") == 1) & (F.length("alt") == 1)
    ct = snp & (V.strand_change(F.col("refer"), F.col("alt")) == "C:G>T:A")
    return db.groupBy("sample_id").agg(
        F.count("*").alias("total_mutations"), count_if(ct).alias("cg_ta"),
        *[count_if(e == x).alias(x) for x in effects],
    )


def ems_spectrum(calls: DataFrame) -> DataFrame:
    """Per sample and zygosity (HOM, HET, ALL): counts and percent of C-T, G-A
    and other changes.  Genotypes come from the allele fraction."""
    depth = F.col("ref_depth") + F.col("alt_depth")
    af = F.when(depth == 0, F.lit(0.0)).otherwise(F.col("alt_depth") / depth)
    raw = G.gt_from_af(af)
    x = calls.withColumns(
        {"zygosity": F.when(raw == "0/1", "HET").otherwise("HOM"), "change": V.ems_change(F.col("refer"), F.col("alt")), "_g": raw}
    ).filter(F.col("_g") != "0/0")
    kinds = {"c_t": "C-T", "g_a": "G-A", "other": "other"}
    cnt = {k: count_if(F.col("change") == v) for k, v in kinds.items()}
    g = x.groupingSets(
        [[F.col("sample_id"), F.col("zygosity")], [F.col("sample_id")]], "sample_id", "zygosity"
    ).agg(*[v.alias(f"{k}_count") for k, v in cnt.items()], *[(100 * ratio(v, F.count("*"))).alias(f"{k}_pct") for k, v in cnt.items()])
    return g.withColumn("zygosity", F.coalesce("zygosity", F.lit("ALL")))


def gene_mutants(db: DataFrame, samples: DataFrame, prefix: str = "") -> DataFrame:
    """Per gene: variants, variants shared by two or more samples, sample lists.

    Stop (high impact), frameshift and missense rows of the listed samples.
    """
    own = db.join(samples.select("sample_id").distinct(), "sample_id", "left_semi")
    stop = F.col("type").contains("stop") & (F.col("impact") == "HIGH")
    shift = F.col("type").contains("frameshift")
    mis = F.col("type").contains("missense")
    core = own.withColumns({"_s": stop, "_f": shift, "_m": mis}).filter("_s or _f or _m")
    per_site = core.groupBy("gene", *SITE).agg(F.countDistinct("sample_id").alias("_k"))
    n = per_site.groupBy("gene").agg(
        F.count("*").alias("variants"), count_if(F.col("_k") > 1).alias("shared_variants")
    )
    text = lambda c: F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ","), F.lit("")), F.lit("-"))
    # one row per (gene, sample) before the lists are built
    gs = core.groupBy("gene", "sample_id").agg(F.max("_s").alias("_s"), F.max("_f").alias("_f"), F.max("_m").alias("_m"))
    pick = lambda f: F.when(F.col(f), F.col("sample_id"))
    lists = gs.groupBy("gene").agg(
        F.count("*").alias("samples"), text(F.col("sample_id")).alias("sample_list"),
        text(pick("_s")).alias("stop_samples"), text(pick("_f")).alias("frameshift_samples"),
        text(pick("_m")).alias("missense_samples"),
    )
    out = n.join(lists, "gene")
    return out.select("gene", *[F.col(c).alias(prefix + c) for c in out.columns if c != "gene"])


def compare_gene_mutants(db: DataFrame, target: DataFrame, everyone: DataFrame) -> DataFrame:
    """Target samples beside the background of all other listed samples."""
    rest = sample_difference(everyone, target)
    j = gene_mutants(db, target, "target_").join(gene_mutants(db, rest, "other_"), "gene", "left")
    numbers = ["variants", "shared_variants", "samples"]
    return j.fillna(0, [f"other_{c}" for c in numbers]).fillna("-")


def sample_difference(everyone: DataFrame, target: DataFrame) -> DataFrame:
    return everyone.select("sample_id").distinct().join(target.select("sample_id"), "sample_id", "left_anti")
