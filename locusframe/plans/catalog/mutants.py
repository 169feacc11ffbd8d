"""Mutant-population queries."""

from pyspark.sql import functions as F

from ...operators import mutants as M
from ..flows import mutant_summary
from ..registry import query
from .scalar import CHANGE, EFFECT

c = F.col

# the views give every variant one type, gene and impact
SITES = """
st AS (SELECT DISTINCT chrom, pos, refer, alt, type, impact, gene, protein_pos,
  CASE WHEN length(refer) = length(alt) THEN 'snp' WHEN length(refer) > length(alt) THEN 'del' ELSE 'ins' END AS kind FROM g_db)
"""
SNP = "length(refer) = 1 AND length(alt) = 1"
EMS = "concat(refer, alt) IN ('GA', 'CT')"


@query(
    "agg_mutant_overview",
    "WITH " + SITES + f"""
SELECT count(*) AS total_variants, count(*) FILTER (WHERE kind = 'snp') AS total_snp, count(*) FILTER (WHERE kind = 'ins') AS total_ins,
  count(*) FILTER (WHERE kind = 'del') AS total_del,
  count(*) FILTER (WHERE kind = 'snp' AND protein_pos IS NOT NULL) AS cds_snp,
  count(*) FILTER (WHERE kind = 'snp' AND protein_pos IS NOT NULL AND {EMS}) AS cds_ems_snp,
  count(*) FILTER (WHERE kind = 'snp' AND type <> 'intergenic_region') AS gene_snp,
  count(*) FILTER (WHERE kind = 'snp' AND type <> 'intergenic_region' AND {EMS}) AS gene_ems_snp,
  CAST(floor((SELECT avg(ref_depth + alt_depth) FROM g_db)) AS BIGINT) AS avg_cov,
  round(count(*) FILTER (WHERE kind = 'snp' AND protein_pos IS NOT NULL AND {EMS}) * 1.0 / count(*) FILTER (WHERE kind = 'snp' AND protein_pos IS NOT NULL), 6) AS cds_ems_rate,
  round(count(*) FILTER (WHERE kind = 'snp' AND type <> 'intergenic_region' AND {EMS}) * 1.0 / count(*) FILTER (WHERE kind = 'snp' AND type <> 'intergenic_region'), 6) AS gene_ems_rate,
  round(count(*) / ((SELECT sum("end" - start) FROM g_genes) / 1000.0), 6) AS per_cds_kb,
  (SELECT count(DISTINCT gene) FROM st WHERE impact IN ('HIGH', 'MODERATE') AND gene IN (SELECT gene_id FROM g_genes)) AS impacted_genes,
  (SELECT count(*) FROM g_genes) AS total_genes,
  round((SELECT count(DISTINCT gene) FROM st WHERE impact IN ('HIGH', 'MODERATE') AND gene IN (SELECT gene_id FROM g_genes)) * 1.0
    / (SELECT count(*) FROM g_genes), 6) AS impacted_rate
FROM st""",
)
def mutant_overview(v):
    return M.mutant_overview(v.g_db, v.g_genes, v.g_genes)


BY_CHROM = """SELECT s.chrom, s.size, s.rank, count(*) FILTER (WHERE kind = 'snp') AS snp, count(*) FILTER (WHERE kind = 'ins') AS ins,
  count(*) FILTER (WHERE kind = 'del') AS del, count(*) AS total FROM st JOIN g_sizes s ON st.chrom = s.chrom GROUP BY s.chrom, s.size, s.rank"""


@query("agg_variants_by_chrom", "WITH " + SITES + BY_CHROM)
def variants_by_chrom(v):
    return M.variants_by_chrom(v.g_db, v.g_sizes)


@query(
    "agg_ts_tv",
    "WITH " + SITES + f""", k AS (SELECT {CHANGE.format(r='refer', a='alt')} AS change, CAST(count(*) AS DOUBLE) AS n FROM st WHERE {SNP} GROUP BY 1)
SELECT * FROM k UNION ALL SELECT 'Total transitions', coalesce(sum(n) FILTER (WHERE change IN ('C:G>T:A', 'T:A>C:G')), 0) FROM k
UNION ALL SELECT 'Total transversions', coalesce(sum(n) FILTER (WHERE change NOT IN ('C:G>T:A', 'T:A>C:G')), 0) FROM k
UNION ALL SELECT 'Transitions/transversions', round(sum(n) FILTER (WHERE change IN ('C:G>T:A', 'T:A>C:G')) / sum(n) FILTER (WHERE change NOT IN ('C:G>T:A', 'T:A>C:G')), 1) FROM k""",
)
def ts_tv(v):
    return M.ts_tv(v.g_db)


@query(
    "agg_genes_by_effect",
    "WITH " + SITES + f"SELECT {EFFECT} AS effect, count(DISTINCT gene) AS genes FROM st WHERE gene IN (SELECT gene_id FROM g_genes) GROUP BY 1",
)
def genes_by_effect(v):
    return M.genes_by_effect(v.g_db, v.g_genes)


@query(
    "agg_sample_effects",
    f"""SELECT sample_id, count(*) AS total_mutations, count(*) FILTER (WHERE {SNP} AND {EMS}) AS cg_ta, """
    + ", ".join(f"""count(*) FILTER (WHERE {EFFECT} = '{e}') AS "{e}" """ for e in M.EFFECTS)
    + " FROM g_db GROUP BY sample_id",
)
def sample_effects(v):
    return M.sample_effects(v.g_db)


def _spectrum(zyg: str, group: str) -> str:
    kinds = {"c_t": "refer = 'C' AND alt = 'T'", "g_a": "refer = 'G' AND alt = 'A'", "other": "concat(refer, alt) NOT IN ('CT', 'GA')"}
    cnt = ", ".join(f"count(*) FILTER (WHERE {w}) AS {k}_count" for k, w in kinds.items())
    pct = ", ".join(f"round(100.0 * count(*) FILTER (WHERE {w}) / count(*), 6) AS {k}_pct" for k, w in kinds.items())
    return f"SELECT sample_id, {zyg} AS zygosity, {cnt}, {pct} FROM x GROUP BY {group}"


@query(
    "agg_ems_spectrum",
    """WITH x AS (SELECT sample_id, ref AS refer, alt, CASE WHEN alt_depth < 0.75 * (ref_depth + alt_depth) THEN 'HET' ELSE 'HOM' END AS zyg
  FROM g_calls WHERE ref_depth + alt_depth > 0 AND alt_depth >= 0.25 * (ref_depth + alt_depth))
""" + _spectrum("zyg", "sample_id, zyg") + " UNION ALL " + _spectrum("'ALL'", "sample_id"),
)
def ems_spectrum(v):
    return M.ems_spectrum(v.g_calls.withColumnRenamed("ref", "refer"))


def _gene_mutants(samples: str, prefix: str = "") -> str:
    ls = lambda w: f"coalesce(string_agg(DISTINCT sample_id, ',' ORDER BY sample_id) FILTER (WHERE {w}), '-')"
    stop = "type LIKE '%stop%' AND impact = 'HIGH'"
    return f"""SELECT gene, count(DISTINCT (chrom, pos, refer, alt)) AS {prefix}variants,
  (SELECT count(*) FROM (SELECT 1 FROM core y WHERE y.gene = x.gene AND y.sample_id IN ({samples}) GROUP BY chrom, pos, refer, alt HAVING count(DISTINCT sample_id) > 1) z) AS {prefix}shared_variants,
  count(DISTINCT sample_id) AS {prefix}samples, {ls('TRUE')} AS {prefix}sample_list, {ls(stop)} AS {prefix}stop_samples,
  {ls("type LIKE '%frameshift%'")} AS {prefix}frameshift_samples, {ls("type LIKE '%missense%'")} AS {prefix}missense_samples
FROM core x WHERE sample_id IN ({samples}) GROUP BY gene"""


CORE = "core AS (SELECT * FROM g_db WHERE (type LIKE '%stop%' AND impact = 'HIGH') OR type LIKE '%frameshift%' OR type LIKE '%missense%')"
TARGET = "'S1', 'S2', 'S3'"


def _target(v):
    return v.g_db.filter(c("sample_id").isin("S1", "S2", "S3")).select("sample_id").distinct()


@query("agg_gene_mutants", "WITH " + CORE + _gene_mutants(TARGET))
def gene_mutants(v):
    return M.gene_mutants(v.g_db, _target(v))


@query(
    "agg_compare_gene_mutants",
    "WITH " + CORE + ", t AS (" + _gene_mutants(TARGET, "target_") + "), o AS (" + _gene_mutants("'S4', 'S5', 'S6', 'S7'", "other_") + """)
SELECT t.*, coalesce(o.other_variants, 0) AS other_variants, coalesce(o.other_shared_variants, 0) AS other_shared_variants,
  coalesce(o.other_samples, 0) AS other_samples, coalesce(o.other_sample_list, '-') AS other_sample_list,
  coalesce(o.other_stop_samples, '-') AS other_stop_samples, coalesce(o.other_frameshift_samples, '-') AS other_frameshift_samples,
  coalesce(o.other_missense_samples, '-') AS other_missense_samples FROM t LEFT JOIN o ON t.gene = o.gene""",
)
def compare_gene_mutants(v):
    return M.compare_gene_mutants(v.g_db, _target(v), v.g_db.select("sample_id"))


@query("set_sample_difference", f"SELECT DISTINCT sample_id FROM g_db WHERE sample_id NOT IN ({TARGET})")
def sample_difference(v):
    return M.sample_difference(v.g_db, _target(v))


def _accessions(v):
    text = F.format_string("%s=%s;%d,%d", "sample_id", "gt", "ref_depth", "alt_depth")
    return v.g_calls.select("chrom", "pos", c("ref").alias("refer"), "alt", text.alias("accession"))


def _annotation(v):
    return v.g_sites.selectExpr(
        "chrom", "pos", "ref AS refer", "alt", "concat('t', pos % 3) AS type", "'HIGH' AS impact", "concat('G', pos % 500) AS gene", "pos % 300 AS protein_pos"
    )


PASSED = """
ok AS (SELECT chrom, pos, ref AS refer, alt, sample_id, gt AS genotype, ref_depth, alt_depth, concat('t', CAST(pos % 3 AS VARCHAR)) AS type,
  concat('G', CAST(pos % 500 AS VARCHAR)) AS gene FROM g_calls WHERE gt <> './.' AND ref_depth + alt_depth >= 5 AND alt_depth * 1.0 / (ref_depth + alt_depth) >= 0.2)
"""


@query(
    "jn_build_db",
    "WITH " + PASSED + "SELECT chrom, pos, refer, alt, sample_id, genotype, CAST(ref_depth AS INT) AS ref_depth, CAST(alt_depth AS INT) AS alt_depth, type, gene FROM ok",
)
def build_db(v):
    return M.build_db(_accessions(v), _annotation(v)).drop("impact", "protein_pos")


@query(
    "flow_mutant_summary",
    "WITH " + PASSED + """, st AS (SELECT DISTINCT chrom, pos, refer, alt,
  CASE WHEN length(refer) = length(alt) THEN 'snp' WHEN length(refer) > length(alt) THEN 'del' ELSE 'ins' END AS kind FROM ok) """ + BY_CHROM,
)
def mutant_flow(v):
    return mutant_summary(_accessions(v), _annotation(v), v.g_sizes)
