"""User-facing dataflows, each a chain of the library's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..functions import sequence as S
from ..functions import variant as V
from ..operators import calls as C
from ..operators import coverage as cov
from ..operators import enrich as E
from ..operators import hits as H
from ..operators import intervals as I
from ..operators import mutants as M
from ..operators import probes as P
from ..operators import qc as Q
from ..operators import runs as R
from ..operators import tables as T
from ..operators import tracks as K


def genotype_tables(calls: DataFrame, miss: str = "NN", sep: str = "") -> DataFrame:
    """Long calls with normalised genotype, bases and variant type."""
    short = V.alleles_shorthand(F.col("ref"), F.col("alt"))
    # one step at a time: a lambda would pick up the new ``ref`` of the same select
    x = calls.select("chrom", "pos", "ref", "alt", "sample_id", G.gt_norm(F.col("gt")).alias("gt"))
    x = x.withColumn("alt", short).withColumn("ref", F.substring("ref", 1, 1))
    return x.withColumns(
        {
            "bases": G.gt_to_seq(F.col("gt"), F.col("ref"), F.col("alt"), miss, sep),
            "type": V.variant_class(F.col("alt")),
        }
    )


def linkage_table(calls: DataFrame, p1: list[str], p2: list[str], miss: str = "N") -> DataFrame:
    """AA / BB / AB codes of all samples at the parents' polymorphic sites."""
    sites = C.polymorphic_sites(calls, p1, p2)
    code = G.linkage_code(F.col("gt"), F.col("p1_gt"), F.col("p2_gt"), miss)
    return calls.join(sites, C.SITE).select(*C.SITE, "sample_id", code.alias("code"))


def linkage_stats(table: DataFrame, parents: list[str], by: list[str], miss: str = "N") -> DataFrame:
    """Segregation counts and ratios of the offspring, per sample or locus."""
    kids = table.filter(~F.col("sample_id").isin(parents))
    return C.class_summary(kids, by, "code", ["AA", "BB", "AB", miss])


def qtl_candidates(
    track: DataFrame, delta: str, band: str, gprime: str, distance: str, ci: str, keys: list[str]
) -> DataFrame:
    """Sites outside the SNP-index band, or high in G' or ED, with their labels."""
    found = {
        "SNPindex": K.filter_outside_band(track, delta, band),
        "Gprime": K.above_ci(track, gprime, ci),
        "ED": K.above_ci(track, distance, ci),
    }
    merged = T.union_distinct_by(list(found.values()), keys, [F.asc(c) for c in track.columns])
    return merged.join(K.label_sites(found), ["chrom", "pos"], "left")


def bsa_regions(track: DataFrame, genes: DataFrame, threshold: float, **limits) -> DataFrame:
    """Threshold regions with the number of genes they overlap."""
    regions = R.threshold_regions(track, threshold, **limits)
    return I.count_overlaps(regions, genes, "gene_count")


def contrast_enrichment(diff: DataFrame, gene_term: DataFrame, names: DataFrame) -> DataFrame:
    """Every UP / DOWN / ALL list of every contrast tested in one job."""
    lists = E.diff_lists(E.diff_genes(diff))
    return E.name_terms(E.enrich(gene_term, lists, ["contrast", "gene_list"]), names)


def mutant_summary(accessions: DataFrame, annotation: DataFrame, sizes: DataFrame) -> DataFrame:
    """Packed accessions to the per-chromosome variant table."""
    return M.variants_by_chrom(M.build_db(accessions, annotation), sizes)


def choose_probes(
    candidates: DataFrame, width: int, per_region: int = 1, min_dist: int = 50, high: int = 0
) -> DataFrame:
    """Score, one row per site, thin close sites, pick per window."""
    c = F.col
    end = (F.ceil(c("pos") / width) * width).cast("bigint")
    x = candidates.withColumns(
        {
            "score2": P.probe_score(c("gc"), c("alleles"), c("score"), c("match_0"), c("match_60"), c("match_100"), c("maf")),
            "start": end - width, "end": end,
        }
    )
    one = T.distinct_by(x, ["chrom", "pos"], [F.desc("score2"), F.asc("id")])
    thin = R.thin_by_distance(one, min_dist, "score2", keys=["chrom", "start", "end"])
    return P.pick_per_region(thin, per_region, high)


def lift_probes(paf: DataFrame, offsets: DataFrame, anno: DataFrame, min_ratio: float = 0.9) -> DataFrame:
    """Annotation moved to the positions found by realignment."""
    return H.relocate(anno, H.lift_sites(paf, offsets, min_ratio))


def filter_probes_by_overlap(
    probes: DataFrame, variants: DataFrame, indels: DataFrame, max_variants: int = 3,
    max_indels: int = 0,
) -> DataFrame:
    """Probes with few variants and indels inside."""
    one = lambda df: df.withColumn("marker", F.lit(1))
    x = I.map_overlap(probes, one(variants), "marker", "sum", "variant_overlap")
    x = I.map_overlap(x, one(indels), "marker", "sum", "indel_overlap")
    return x.filter((F.col("variant_overlap") <= max_variants) & (F.col("indel_overlap") <= max_indels))


def calling_bed(design: DataFrame, sizes: DataFrame, flank: int = 200) -> DataFrame:
    """Merged calling intervals of a probe design."""
    return I.merge_intervals(P.panel_targets(design, sizes, flank).select("chrom", "start", "end"))


def target_bed(design: DataFrame) -> DataFrame:
    """One-base target intervals with their ``chrom_pos`` ids."""
    return design.select(
        "chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"),
        V.site_id(F.col("chrom"), F.col("pos")).alias("id"),
    ).distinct()


def coverage_report(depth: DataFrame, pieces: DataFrame, cutoffs: list[int] = cov.CUTOFFS) -> DataFrame:
    """Region coverage on whole-chromosome coordinates."""
    return I.restore_coords(cov.region_coverage(depth, ["chrom", "start", "end"], cutoffs), pieces)


def phenotype_table(base_calls: DataFrame, pheno: DataFrame) -> DataFrame:
    """Phenotype per sample and trait at consistent sites."""
    j = C.join_pheno(base_calls, pheno)
    cols = [F.col(c) for c in ("allele1", "allele2", "phenotype1", "phenotype2", "bases")]
    return j.select("chrom", "pos", "trait", "gene", "sample_id", G.phenotype(*cols).alias("phenotype"))


def gwas_subsets(assoc: DataFrame, anno: DataFrame, cutoffs: list[float] = [1e-5, 5e-8]) -> DataFrame:
    """Annotated associations under each p cutoff, as one table keyed by cutoff."""
    hit = T.inner_on(assoc, anno, ["chrom", "pos"], [F.asc("gene"), F.asc("effect")])
    best = F.least("p_wald", "p_lrt", "p_score")
    passed = F.filter(F.array(*[F.lit(float(c)) for c in cutoffs]), lambda c: best <= c)
    return hit.withColumn("p_cutoff", F.explode(passed)).distinct()


def ssr_locations(left: DataFrame, right: DataFrame, max_dist: int = 1000) -> DataFrame:
    """Best-matching location(s) of each primer pair."""
    p = H.pair_hits(left, right, max_dist).withColumns(
        {
            "total_length": F.col("left_match_len") + F.col("right_match_len"),
            "total_gap": F.col("left_gapopen") + F.col("right_gapopen"),
            "total_mismatch": F.col("left_mismatch") + F.col("right_mismatch"),
        }
    )
    return H.best_hits(p, "name", [F.desc("total_length"), F.asc("total_gap"), F.asc("total_mismatch")])


def species_proteins(records: DataFrame, taxa: DataFrame, style: str = "swissprot") -> DataFrame:
    """Protein records of the listed taxon ids."""
    parse = S.parse_swissprot_header if style == "swissprot" else S.parse_uniref_header
    x = records.withColumn("h", parse(F.col("description"))).withColumn("taxon_id", F.col("h.taxon_id")).drop("h")
    return T.keep_in(x, taxa, ["taxon_id"])


def library_report(sheet: DataFrame, files: DataFrame) -> DataFrame:
    """All problems of a delivery in one table."""
    return Q.library_errors(sheet, files)


def sample_variants(calls: DataFrame, annotation: DataFrame) -> DataFrame:
    """One row per non-reference call with its depths and first annotation."""
    hit = calls.filter(~F.col("gt").isin("0/0", "./."))
    one = T.distinct_by(annotation, ["chrom", "pos", "ref", "alt"], [F.asc("impact_order"), F.asc("effect"), F.asc("gene")])
    return hit.join(one.drop("impact_order"), ["chrom", "pos", "ref", "alt"], "left").fillna("-", ["effect", "gene"])


def repair_gtf(features: DataFrame) -> DataFrame:
    """Fill strand and gene_id, and build missing transcript, exon and CDS rows
    from one another."""
    attrs = F.col("attributes")
    x = features.withColumns(
        {
            "transcript_id": S.gtf_attr(attrs, "transcript_id"),
            "strand": F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise("+"),
            "attributes": F.when(attrs.contains("gene_id"), attrs).otherwise(
                F.concat(attrs, F.lit(" gene_id "), F.substring_index(F.trim(attrs), " ", -1))
            ),
        }
    )
    has = x.groupBy("transcript_id").agg(
        *[F.max((F.col("feature") == f).cast("int")).alias(f"_{f}") for f in ("transcript", "exon", "CDS")]
    )
    j = x.join(has, "transcript_id")
    lacks = lambda f: F.col(f"_{f}") == 0
    made = (
        F.when(F.col("feature") == "exon", F.array(
            F.lit("exon"), F.when(lacks("transcript"), F.lit("transcript")), F.when(lacks("CDS"), F.lit("CDS"))
        ))
        .when(F.col("feature") == "CDS", F.array(F.lit("CDS"), F.when(lacks("exon"), F.lit("exon"))))
        .otherwise(F.array(F.col("feature")))
    )
    return j.withColumn("feature", F.explode(F.array_compact(made))).drop("_transcript", "_exon", "_CDS")


def export_calls(calls: DataFrame) -> DataFrame:
    """Non-reference calls (missing ones as ``./.``) with packed accession text."""
    packed = F.format_string("%s=%s;%d,%d", "sample_id", "gt", "ref_depth", "alt_depth")
    return calls.filter(F.col("gt") != "0/0").select("chrom", "pos", "ref", "alt", packed.alias("accession"))


def pack_accessions(calls: DataFrame) -> DataFrame:
    """Ragged accession line per site; a site has at most one entry per sample."""
    x = export_calls(calls)
    return x.groupBy("chrom", "pos", "ref", "alt").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("accession")), "\t").alias("accessions")
    )
