"""Site, sample, pair and trio queries."""

from pyspark.sql import functions as F

from ...functions import genotype as G
from ...operators import calls as C
from ...operators import runs as R
from ..flows import linkage_stats, linkage_table
from ..registry import query

PAIR_ROWS = """
p AS (SELECT p.sample_a, p.sample_b, a.chrom, a.pos, a.ref, a.alt, a.gt AS ga, b.gt AS gb,
        a.ref_depth + a.alt_depth AS da, b.ref_depth + b.alt_depth AS db,
        CASE WHEN a.gt = './.' THEN 'MISS' WHEN a.gt = '0/1' THEN 'HET' ELSE 'HOM' END AS ca,
        CASE WHEN b.gt = './.' THEN 'MISS' WHEN b.gt = '0/1' THEN 'HET' ELSE 'HOM' END AS cb
      FROM {PAIRS} p JOIN g_calls a ON a.sample_id = p.sample_a
      JOIN g_calls b ON b.sample_id = p.sample_b AND b.chrom = a.chrom AND b.pos = a.pos)
"""
PAIR_REPORT = """
c AS (SELECT {KEYS}, count(*) AS sites,
        count(*) FILTER (WHERE ca <> 'MISS' AND cb <> 'MISS') AS valid,
        count(*) FILTER (WHERE ca = 'HOM' AND cb <> 'MISS') AS a_hom,
        count(*) FILTER (WHERE ca = 'HET' AND cb <> 'MISS') AS a_het,
        count(*) FILTER (WHERE cb = 'HOM' AND ca <> 'MISS') AS b_hom,
        count(*) FILTER (WHERE cb = 'HET' AND ca <> 'MISS') AS b_het,
        count(*) FILTER (WHERE ca = 'HOM' AND cb = 'HOM') AS both_hom,
        count(*) FILTER (WHERE ca <> 'MISS' AND cb <> 'MISS' AND ga = gb) AS equal,
        count(*) FILTER (WHERE ca = 'HOM' AND cb = 'HOM' AND ga = gb) AS hom_equal
      FROM p GROUP BY {KEYS})
SELECT {KEYS}, sites, valid, a_hom, a_het, b_hom, b_het, equal,
  round(coalesce(100.0 * equal / nullif(valid, 0), 0), 6) AS equal_pct, hom_equal,
  round(coalesce(100.0 * hom_equal / nullif(both_hom, 0), 0), 6) AS hom_equal_pct,
  equal - hom_equal AS het_equal,
  round(coalesce(100.0 * (equal - hom_equal) / nullif(valid - both_hom, 0), 0), 6) AS het_equal_pct,
  valid - equal AS not_equal,
  round(coalesce(100.0 * (valid - equal) / nullif(valid, 0), 0), 6) AS not_equal_pct
FROM c
"""
ALL_PAIRS = """
ap AS (SELECT x.sample_id AS sample_a, y.sample_id AS sample_b
       FROM (SELECT DISTINCT sample_id FROM g_calls) x JOIN (SELECT DISTINCT sample_id FROM g_calls) y
       ON x.sample_id < y.sample_id)
"""
SITE_STATS = """
SELECT chrom, pos, ref, alt, count(*) AS n,
  round(count(*) FILTER (WHERE gt = './.') * 1.0 / count(*), 6) AS missing,
  round(coalesce(count(*) FILTER (WHERE gt = '0/1') * 1.0 / nullif(count(*) FILTER (WHERE gt <> './.'), 0), 0), 6) AS het,
  round(coalesce(least(
    (2 * count(*) FILTER (WHERE gt = '0/0') + count(*) FILTER (WHERE gt = '0/1')) * 1.0,
    (2 * count(*) FILTER (WHERE gt = '1/1') + count(*) FILTER (WHERE gt = '0/1')) * 1.0)
    / nullif(2 * count(*) FILTER (WHERE gt <> './.'), 0), 0), 6) AS maf
FROM g_calls GROUP BY chrom, pos, ref, alt
"""


@query("agg_site_stats", SITE_STATS)
def site_stats(v):
    return C.site_stats(v.g_calls)


@query(
    "flt_filter_sites",
    f"SELECT * FROM ({SITE_STATS}) s WHERE maf >= 0.1 AND missing <= 0.4 AND length(ref) = 1 AND length(alt) = 1",
)
def filter_sites(v):
    return C.filter_sites(C.site_stats(v.g_calls), 0.1, 0.4, snp_only=True)


@query(
    "agg_site_stats_indel",
    """
SELECT chrom, pos, id,
  concat(substr(ref, 1, 1), '/', CASE WHEN length(ref) > length(alt) THEN concat('del', substr(ref, 2))
    WHEN length(ref) < length(alt) THEN concat('ins', substr(alt, 2)) ELSE substr(alt, 1, 1) END) AS alleles,
  round(count(*) FILTER (WHERE gt = './.') * 1.0 / count(*), 6) AS missing,
  round(count(*) FILTER (WHERE gt = '0/1') * 1.0 / nullif(count(*) FILTER (WHERE gt <> './.'), 0), 6) AS het,
  round(least(
    (2 * count(*) FILTER (WHERE gt = '0/0') + count(*) FILTER (WHERE gt = '0/1')) * 1.0,
    (2 * count(*) FILTER (WHERE gt = '1/1') + count(*) FILTER (WHERE gt = '0/1')) * 1.0)
    / nullif(2 * count(*) FILTER (WHERE gt <> './.'), 0), 6) AS maf,
  CAST(abs(length(ref) - length(alt)) AS INT) AS indel_length,
  CASE WHEN length(ref) > length(alt) THEN 'DEL' WHEN length(ref) < length(alt) THEN 'INS' ELSE 'SNP' END AS indel_type
FROM g_calls GROUP BY chrom, pos, id, ref, alt
""",
)
def site_stats_indel(v):
    return C.site_stats_indel(v.g_calls)


def _rates(g: str, own: str) -> str:
    n = f"count(*) FILTER (WHERE {own})"
    k = lambda gt: f"count(*) FILTER (WHERE {own} AND gt = '{gt}')"
    called = f"nullif(2 * count(*) FILTER (WHERE {own} AND gt <> './.'), 0)"
    af = f"(2 * {k('1/1')} + {k('0/1')}) * 1.0 / {called}"
    rate = lambda gt, name: f"round(coalesce({k(gt)} * 1.0 / nullif({n}, 0), 0), 6) AS {g}_{name}"
    return ", ".join(
        [rate("./.", "miss"), rate("0/0", "ref"), rate("0/1", "het"), rate("1/1", "alt"),
         f"round({af}, 6) AS {g}_af",
         f"round(CASE WHEN {af} IS NULL THEN NULL ELSE least({af}, 1 - {af}) END, 6) AS {g}_maf"]
    )


GROUP_STATS = f"""
SELECT chrom, pos, ref, alt, {_rates('case', "sample_id IN ('S1','S2','S3')")},
  {_rates('control', "sample_id IN ('S4','S5','S6','S7')")}
FROM g_calls GROUP BY chrom, pos, ref, alt
"""


def _groups(v):
    grp = F.when(F.col("sample_id") < "S4", "case").otherwise("control")
    return v.g_calls.select("sample_id").distinct().withColumn("grp", grp)


def _group_stats(v):
    return C.group_site_stats(v.g_calls, _groups(v), ["case", "control"])


@query("agg_group_site_stats", GROUP_STATS)
def group_site_stats(v):
    return _group_stats(v)


@query(
    "flt_specific_sites",
    f"""WITH s AS ({GROUP_STATS})
SELECT *, 'alt' AS specific FROM s WHERE case_alt >= 0.8 AND control_alt < 0.01
UNION ALL SELECT *, 'ref' FROM s WHERE case_ref >= 0.8 AND control_ref < 0.01
UNION ALL SELECT *, 'het' FROM s WHERE case_het >= 0.8 AND control_het < 0.01""",
)
def specific_sites(v):
    return C.specific_sites(_group_stats(v), "case", "control")


def _diversity(by: str) -> str:
    return f"""
WITH c AS (SELECT {by}, count(*) FILTER (WHERE gt = '0/0') AS r, count(*) FILTER (WHERE gt = '0/1') AS h,
             count(*) FILTER (WHERE gt = '1/1') AS a FROM g_calls GROUP BY {by}),
p AS (SELECT *, (2 * r + h) * 1.0 / nullif(2 * (r + h + a), 0) AS p, h * 1.0 / nullif(r + h + a, 0) AS ho FROM c)
SELECT {by}, round(p, 6) AS p_ref, round(CASE WHEN p IS NULL THEN NULL ELSE greatest(p, 1 - p) END, 6) AS p_major,
  round(ho, 6) AS ho, round(1 - p * p - (1 - p) * (1 - p), 6) AS he,
  round(1 - (p * p + (1 - p) * (1 - p)) - 2 * (p * p) * ((1 - p) * (1 - p)), 6) AS pic,
  round(CASE WHEN p = 0 OR p = 1 THEN 0 ELSE -(p * ln(p) + (1 - p) * ln(1 - p)) END, 6) AS shi FROM p
"""


@query("agg_diversity_by_locus", _diversity("chrom, pos"))
def diversity_by_locus(v):
    return C.diversity(v.g_calls, ["chrom", "pos"])


@query("agg_diversity_by_sample", _diversity("sample_id"))
def diversity_by_sample(v):
    return C.diversity(v.g_calls, ["sample_id"])


HDPLOT = """
SELECT chrom, pos, ref, alt, depth_a, depth_b, num_hets, num_samples, num_called,
  round(coalesce(depth_a * 1.0 / nullif(depth_a + depth_b, 0), 0), 6) AS ratio,
  round(num_hets * 1.0 / num_samples, 6) AS h_all,
  round(coalesce(num_hets * 1.0 / nullif(num_called, 0), 0), 6) AS h,
  round(sqrt((depth_a + depth_b) * 0.25), 6) AS std,
  round(coalesce((depth_a - (depth_a + depth_b) / 2.0) / nullif(sqrt((depth_a + depth_b) * 0.25), 0), 0), 6) AS d
FROM (SELECT chrom, pos, ref, alt,
  CAST(sum(CASE WHEN gt = '0/1' THEN ref_depth ELSE 0 END) AS BIGINT) AS depth_a,
  CAST(sum(CASE WHEN gt = '0/1' THEN alt_depth ELSE 0 END) AS BIGINT) AS depth_b,
  count(*) FILTER (WHERE gt = '0/1') AS num_hets, count(*) AS num_samples,
  count(*) FILTER (WHERE gt <> './.') AS num_called
  FROM g_calls GROUP BY chrom, pos, ref, alt) x
"""


@query("agg_hdplot", HDPLOT)
def hdplot(v):
    return C.hdplot(v.g_calls)


@query("flt_filter_paralogs", f"SELECT * FROM ({HDPLOT}) x WHERE h > 0.5 AND abs(d) > 3")
def filter_paralogs(v):
    return C.filter_paralogs(C.hdplot(v.g_calls))


SAMPLES = [f"S{i}" for i in range(1, 8)]
_PIVOT = ", ".join(f"max(gt) FILTER (WHERE sample_id = '{s}') AS {s}" for s in SAMPLES)


@query("prj_to_wide", f"SELECT chrom, pos, ref, alt, {_PIVOT} FROM g_calls GROUP BY chrom, pos, ref, alt")
def to_wide(v):
    return C.to_wide(v.g_calls, SAMPLES)


@query("prj_to_long", "SELECT chrom, pos, ref, alt, sample_id, gt FROM g_calls")
def to_long(v):
    return C.to_long(C.to_wide(v.g_calls, SAMPLES), SAMPLES).filter(F.col("gt").isNotNull())


@query(
    "prj_explode_alts",
    """
SELECT chrom, pos, ref, alt, alt_index, concat(chrom, '_', CAST(pos AS VARCHAR), '_', CAST(alt_index AS VARCHAR)) AS id FROM (
  SELECT chrom, pos, ref, alt, 1 AS alt_index FROM g_sites
  UNION ALL SELECT chrom, pos, ref, concat(ref, 'GG'), 2 FROM g_sites) x
""",
)
def explode_alts(v):
    multi = v.g_sites.select("chrom", "pos", "ref", F.concat("alt", F.lit(","), "ref", F.lit("GG")).alias("alt"))
    return C.explode_alts(multi)


@query(
    "flt_filter_calls",
    """
SELECT * FROM g_calls WHERE gt <> './.' AND ref_depth + alt_depth >= 30
  AND alt_depth * 1.0 / (ref_depth + alt_depth) >= 0.4""",
)
def filter_calls(v):
    return C.filter_calls(v.g_calls, 30, 0.4)


POLY = """
SELECT a.chrom, a.pos, a.ref, a.alt, a.gt AS p1_gt, b.gt AS p2_gt FROM g_calls a
JOIN g_calls b ON a.chrom = b.chrom AND a.pos = b.pos
WHERE a.sample_id = 'S1' AND b.sample_id = 'S2' AND a.gt IN ('0/0', '1/1') AND b.gt IN ('0/0', '1/1') AND a.gt <> b.gt
"""


@query("flt_polymorphic_sites", POLY)
def polymorphic_sites(v):
    return C.polymorphic_sites(v.g_calls, ["S1"], ["S2"])


LINKAGE = f"""
SELECT c.chrom, c.pos, c.ref, c.alt, c.sample_id, CASE WHEN c.gt = './.' THEN 'N' WHEN c.gt = s.p1_gt THEN 'AA'
  WHEN c.gt = s.p2_gt THEN 'BB' ELSE 'AB' END AS code
FROM g_calls c JOIN ({POLY}) s ON c.chrom = s.chrom AND c.pos = s.pos
"""


@query("flow_linkage_table", LINKAGE)
def linkage(v):
    return linkage_table(v.g_calls, ["S1"], ["S2"])


def _linkage_stats(by: str) -> str:
    cols = ", ".join(
        f"count(*) FILTER (WHERE code = '{k}') AS {k}_count, "
        f"round(count(*) FILTER (WHERE code = '{k}') * 1.0 / count(*), 6) AS {k}_ratio"
        for k in ("AA", "BB", "AB", "N")
    )
    return f"SELECT {by}, {cols} FROM ({LINKAGE}) x WHERE sample_id NOT IN ('S1', 'S2') GROUP BY {by}"


@query("agg_gt_class_summary_by_sample", _linkage_stats("sample_id"))
def class_by_sample(v):
    return linkage_stats(linkage_table(v.g_calls, ["S1"], ["S2"]), ["S1", "S2"], ["sample_id"])


@query("agg_gt_class_summary_by_locus", _linkage_stats("chrom, pos"))
def class_by_locus(v):
    return linkage_stats(linkage_table(v.g_calls, ["S1"], ["S2"]), ["S1", "S2"], ["chrom", "pos"])


# --- pairs -------------------------------------------------------------------


@query(
    "jn_pair_calls",
    "WITH " + PAIR_ROWS.format(PAIRS="g_pairs") + "SELECT sample_a, sample_b, chrom, pos, ref, alt, ga AS a_gt, gb AS b_gt FROM p",
)
def pair_calls(v):
    return C.pair_calls(v.g_calls, v.g_pairs)


@query("jn_sample_pairs", "WITH " + ALL_PAIRS + "SELECT * FROM ap")
def sample_pairs(v):
    return C.sample_pairs(v.g_calls)


@query(
    "agg_compare_samples",
    "WITH " + PAIR_ROWS.format(PAIRS="g_pairs") + "," + PAIR_REPORT.format(KEYS="sample_a, sample_b"),
)
def compare_samples(v):
    return C.compare_samples(v.g_calls, v.g_pairs)


@query(
    "agg_compare_samples_by_chrom",
    "WITH " + PAIR_ROWS.format(PAIRS="g_pairs") + "," + PAIR_REPORT.format(KEYS="sample_a, sample_b, chrom"),
)
def compare_by_chrom(v):
    return C.compare_samples(v.g_calls, v.g_pairs, by_chrom=True)


_EVERY = "WITH " + ALL_PAIRS + "," + PAIR_ROWS.format(PAIRS="ap") + "," + PAIR_REPORT.format(KEYS="sample_a, sample_b")


@query("agg_compare_all_samples", _EVERY)
def compare_all(v):
    return C.compare_all_samples(v.g_calls)


@query(
    "re_dissimilarity",
    f"SELECT sample_a, sample_b, valid, round(1 - equal * 1.0 / valid, 6) AS distance FROM ({_EVERY}) x",
)
def dissimilarity(v):
    return C.dissimilarity(v.g_calls)


_REPEAT = "WITH " + PAIR_ROWS.format(PAIRS="g_pairs") + (
    ", r AS (SELECT * FROM p WHERE da >= 40 AND db >= 40 AND ga <> './.' AND gb <> './.')"
)


@query(
    "agg_repeatability",
    _REPEAT + """SELECT sample_a, sample_b, count(*) AS total, count(*) FILTER (WHERE ga = gb) AS consistent,
      round(count(*) FILTER (WHERE ga = gb) * 1.0 / count(*), 6) AS repeatability FROM r GROUP BY sample_a, sample_b""",
)
def repeatability(v):
    return C.repeatability(v.g_calls, v.g_pairs, 40)


@query(
    "agg_repeatability_sites",
    _REPEAT + """SELECT chrom, pos, count(*) FILTER (WHERE ga = gb) AS consist_count,
      count(*) FILTER (WHERE ga <> gb) AS in_consist_count FROM r GROUP BY chrom, pos""",
)
def repeatability_sites(v):
    return C.repeatability_sites(v.g_calls, v.g_pairs, 40)


@query(
    "agg_recovery_rate",
    "WITH " + PAIR_ROWS.format(PAIRS="g_pairs") + """,
c AS (SELECT sample_a, sample_b, count(*) AS total, count(*) FILTER (WHERE gb = ga) AS a_sites,
        count(*) FILTER (WHERE gb <> ga AND gb IN ('0/0', '1/1')) AS b_sites,
        count(*) FILTER (WHERE gb = '0/1') AS h_sites, count(*) FILTER (WHERE gb = './.') AS n_sites
      FROM p WHERE ga IN ('0/0', '1/1') GROUP BY sample_a, sample_b)
SELECT *, round((a_sites + 0.5 * h_sites) / (a_sites + b_sites + h_sites), 6) AS bc_rate,
  round(n_sites * 1.0 / total, 6) AS n_rate, round(h_sites * 1.0 / (total - n_sites), 6) AS het_rate FROM c
WHERE n_sites < total""",
)
def recovery_rate(v):
    return C.recovery_rate(v.g_calls, v.g_pairs)


@query(
    "re_site_differences",
    "WITH " + PAIR_ROWS.format(PAIRS="g_pairs") + """
SELECT sample_a, sample_b, chrom, CAST(ceil(pos / 50000.0) * 50000 - 50000 AS BIGINT) AS start,
  CAST(ceil(pos / 50000.0) * 50000 AS BIGINT) AS "end", count(*) AS n, count(*) FILTER (WHERE ga <> gb) AS n_diff,
  round(count(*) FILTER (WHERE ga <> gb) * 1.0 / count(*), 6) AS diff_share
FROM p WHERE ga <> './.' AND gb <> './.' GROUP BY ALL""",
)
def site_differences(v):
    return C.site_differences(v.g_calls, v.g_pairs, 50_000)


# --- trios -------------------------------------------------------------------

TRIO_ROWS = """
t AS (SELECT p.father, p.mother, p.child, f.chrom, f.pos, f.ref, f.alt, f.gt AS fg, m.gt AS mg, c.gt AS cg
      FROM g_trios p JOIN g_calls f ON f.sample_id = p.father
      JOIN g_calls m ON m.sample_id = p.mother AND m.chrom = f.chrom AND m.pos = f.pos
      JOIN g_calls c ON c.sample_id = p.child AND c.chrom = f.chrom AND c.pos = f.pos)
"""
# the allowed child genotypes of each parental pair, written out
MENDEL = """
s AS (SELECT *, CASE WHEN fg = './.' OR mg = './.' OR cg = './.' THEN 'missing'
  WHEN (fg = '0/0' AND mg = '0/0' AND cg = '0/0') OR (fg = '1/1' AND mg = '1/1' AND cg = '1/1')
    OR (fg = '0/1' AND mg = '0/1')
    OR (((fg = '0/0' AND mg = '0/1') OR (fg = '0/1' AND mg = '0/0')) AND cg IN ('0/0', '0/1'))
    OR (((fg = '1/1' AND mg = '0/1') OR (fg = '0/1' AND mg = '1/1')) AND cg IN ('1/1', '0/1'))
    OR (((fg = '0/0' AND mg = '1/1') OR (fg = '1/1' AND mg = '0/0')) AND cg = '0/1')
  THEN 'consistent' ELSE 'inconsistent' END AS status FROM t)
"""
SUMMARY = "WITH " + TRIO_ROWS + "," + MENDEL + """,
u AS (SELECT father, mother, child, count(*) AS total, count(*) FILTER (WHERE status = 'consistent') AS consistent,
  count(*) FILTER (WHERE status = 'inconsistent') AS inconsistent, count(*) FILTER (WHERE status = 'missing') AS missing
  FROM s GROUP BY father, mother, child),
w AS (SELECT *, coalesce(consistent * 1.0 / nullif(total - missing, 0), 0) AS rate FROM u)
"""


@query(
    "jn_trio_calls",
    "WITH " + TRIO_ROWS + "SELECT father, mother, child, chrom, pos, ref, alt, fg AS father_gt, mg AS mother_gt, cg AS child_gt FROM t",
)
def trio_calls(v):
    return C.trio_calls(v.g_calls, v.g_trios)


@query(
    "agg_mendel_summary",
    SUMMARY + """SELECT father, mother, child, total, consistent, inconsistent, missing, round(rate, 6) AS rate,
  CASE WHEN inconsistent = 0 THEN 'ok' ELSE 'inconsistent' END AS status FROM w""",
)
def mendel_summary(v):
    return C.mendel_summary(v.g_calls, v.g_trios)


@query(
    "agg_mendel_report",
    SUMMARY + """SELECT count(*) AS families, count(*) FILTER (WHERE inconsistent = 0) AS consistent_families,
  round(avg(rate), 6) AS mean_rate, CAST(sum(inconsistent) AS BIGINT) AS inconsistent,
  round(sum(inconsistent) * 1.0 / sum(total - missing), 6) AS error_rate FROM w""",
)
def mendel_report(v):
    return C.mendel_report(C.mendel_summary(v.g_calls, v.g_trios))


@query(
    "srt_worst_families",
    SUMMARY + """SELECT father, mother, child, total, consistent, inconsistent, missing, round(rate, 6) AS rate,
  'inconsistent' AS status FROM (SELECT * FROM w ORDER BY rate, father, mother, child LIMIT 3) x WHERE inconsistent > 0""",
)
def worst_families(v):
    return C.worst_families(C.mendel_summary(v.g_calls, v.g_trios), 3)


def _families(v):
    return v.g_trios.select(F.col("father").alias("p1"), F.col("mother").alias("p2"), "child")


HOM = "h AS (SELECT * FROM t WHERE fg IN ('0/0', '1/1') AND mg IN ('0/0', '1/1') AND cg IN ('0/0', '1/1'))"


@query(
    "flt_hom_trios",
    "WITH " + TRIO_ROWS + "," + HOM + " SELECT father, mother, child, chrom, pos, ref, alt, fg AS father_gt, mg AS mother_gt, cg AS child_gt FROM h",
)
def hom_trios(v):
    return C.filter_hom_trios(C.trio_calls(v.g_calls, v.g_trios), list(C.TRIO))


def _level(keys: str, level: str, label: str) -> str:
    group = "father, mother, child" + (f", {keys}" if keys else "")
    return f"""SELECT father AS p1, mother AS p2, child, '{level}' AS level, {label} AS label, count(*) AS n_diff,
  count(*) FILTER (WHERE fg = cg) AS n_p1, round(100.0 * count(*) FILTER (WHERE fg = cg) / count(*), 6) AS p1_pct,
  count(*) FILTER (WHERE mg = cg) AS n_p2, round(100.0 * count(*) FILTER (WHERE mg = cg) / count(*), 6) AS p2_pct
FROM d GROUP BY {group}"""


@query(
    "agg_contribution",
    "WITH " + TRIO_ROWS + "," + HOM
    + ", d AS (SELECT *, CASE WHEN chrom IN ('chr1', 'chr2') THEN 'A' ELSE 'B' END AS grp FROM h WHERE fg <> mg) "
    + _level("chrom", "chrom", "chrom") + " UNION ALL " + _level("grp", "group", "grp")
    + " UNION ALL " + _level("", "total", "'total'"),
)
def contribution(v):
    grp = F.when(F.col("chrom").isin("chr1", "chr2"), "A").otherwise("B")
    return C.contribution(v.g_calls, _families(v), v.g_sizes.select("chrom", grp.alias("chrom_group")))


TRACK = "WITH " + TRIO_ROWS + "," + HOM + """, o AS (SELECT father AS p1, mother AS p2, child, chrom, pos,
  CASE WHEN cg = fg AND cg = mg THEN 'all_same' WHEN cg = fg THEN 'p1' WHEN cg = mg THEN 'p2' ELSE 'specific' END AS origin FROM h)
"""


@query("win_origin_track", TRACK + "SELECT * FROM o")
def origin_track(v):
    return C.origin_track(v.g_calls, _families(v)).select("p1", "p2", "child", "chrom", "pos", "origin")


@query(
    "win_origin_segments",
    TRACK + """, a AS (SELECT *, CASE WHEN origin IS DISTINCT FROM lag(origin) OVER (PARTITION BY p1, p2, child, chrom ORDER BY pos)
  THEN 1 ELSE 0 END AS brk FROM o), b AS (SELECT *, sum(brk) OVER (PARTITION BY p1, p2, child, chrom ORDER BY pos) AS run FROM a)
SELECT p1, p2, child, chrom, min(pos) AS start, origin, max(pos) AS "end", count(*) AS n_sites FROM b
GROUP BY p1, p2, child, chrom, run, origin""",
)
def origin_segments(v):
    return R.origin_segments(C.origin_track(v.g_calls, _families(v)), ["p1", "p2", "child"], 20_000)


# --- phenotypes --------------------------------------------------------------

PHENO = """
ph AS (SELECT DISTINCT chrom, pos, substr(ref, 1, 1) AS allele1, substr(alt, 1, 1) AS allele2, 'tall' AS phenotype1, 'SHORT' AS phenotype2,
  'height' AS trait, concat('G', CAST(pos % 500 AS VARCHAR)) AS gene FROM g_sites WHERE pos % 3 = 0)
"""


def pheno_view(v):
    s = v.g_sites.filter("pos % 3 = 0")
    return s.selectExpr(
        "chrom", "pos", "substr(ref, 1, 1) AS allele1", "substr(alt, 1, 1) AS allele2", "'tall' AS phenotype1",
        "'SHORT' AS phenotype2", "'height' AS trait", "concat('G', CAST(pos % 500 AS STRING)) AS gene",
    ).distinct()


@query(
    "jn_join_pheno",
    "WITH " + PHENO + """SELECT c.chrom, c.pos, c.sample_id, c.gt, ph.trait, ph.gene FROM g_calls c JOIN ph
  ON c.chrom = ph.chrom AND c.pos = ph.pos WHERE length(c.ref) = 1 AND length(c.alt) = 1""",
)
def join_pheno(v):
    j = C.join_pheno(v.g_calls, pheno_view(v))
    return j.select("chrom", "pos", "sample_id", "gt", "trait", "gene")
