"""Statistic-track, enrichment and expression queries."""

from pyspark.sql import functions as F

from ...functions import stats as ST
from ...operators import enrich as E
from ...operators import tables as T
from ...operators import tracks as K
from ..flows import contrast_enrichment, gwas_subsets, qtl_candidates
from ..registry import query

c = F.col


@query("flt_outside_band", "SELECT chrom, pos, round(stat, 6) AS stat FROM g_track WHERE stat > abs(ci) OR stat < -abs(ci)")
def outside_band(v):
    return K.filter_outside_band(v.g_track, "stat", "ci").select("chrom", "pos", "stat")


def _ci(z: float) -> str:
    return f"""SELECT * FROM g_track WHERE stat >= (SELECT avg(s) + {z} * stddev_samp(s) FROM
  (SELECT chrom, pos, max(stat) AS s FROM g_track GROUP BY chrom, pos) u)"""


@query("agg_above_ci", f"SELECT chrom, pos, round(stat, 6) AS stat FROM ({_ci(1.96)}) x")
def above_ci(v):
    return K.above_ci(v.g_track, "stat").select("chrom", "pos", "stat")


WINDOWS = """
w AS (SELECT chrom, CAST(floor(pos / 100000.0) * 100000 AS BIGINT) AS start, CAST(floor(pos / 100000.0) * 100000 + 99999 AS BIGINT) AS "end",
  count(*) AS n FROM g_track GROUP BY ALL),
k AS (SELECT n, row_number() OVER (ORDER BY n) AS r, count(*) OVER () AS t FROM w),
q AS (SELECT n AS lim FROM k WHERE r = floor(0.9 * (t - 1) + 0.5) + 1)
"""


def windows(v):
    lo = F.floor(c("pos") / 100_000) * 100_000
    return v.g_track.groupBy("chrom", lo.alias("start"), (lo + 99_999).alias("end")).agg(F.count("*").alias("n"))


@query(
    "agg_above_quantile",
    "WITH " + WINDOWS + """SELECT t.chrom, t.pos, t.feature FROM g_track t JOIN w ON t.chrom = w.chrom AND t.pos BETWEEN w.start AND w."end"
  WHERE w.n > (SELECT lim FROM q)""",
)
def above_quantile(v):
    return K.above_quantile(windows(v), v.g_track, "n", 0.9, 100_000).select("chrom", "pos", "feature")


@query(
    "agg_quantile_nearest",
    """WITH k AS (SELECT stat, row_number() OVER (ORDER BY stat) AS r, count(*) OVER () AS t FROM g_track)
SELECT round(stat, 6) AS q FROM k WHERE r = floor(0.95 * (t - 1) + 0.5) + 1""",
)
def quantile_nearest(v):
    # one row of the aggregate carries the scalar
    return v.g_track.agg(F.count("*").alias("_n")).select(K.quantile_nearest(v.g_track, "stat", 0.95).alias("q"))


def _labelled(a: str, b: str, d: str) -> str:
    return f"""SELECT chrom, pos, string_agg(DISTINCT label, ', ' ORDER BY label) AS label FROM (
  SELECT chrom, pos, 'SNPindex' AS label FROM {a} UNION ALL SELECT chrom, pos, 'Gprime' FROM {b} UNION ALL SELECT chrom, pos, 'ED' FROM {d}) u
  GROUP BY chrom, pos"""


BAND = "(SELECT * FROM g_track WHERE stat > abs(ci)) x1"
CI95 = f"({_ci(1.96)}) x2"
HALF = """(SELECT * FROM g_track WHERE ci >= (SELECT avg(s) + 1.96 * stddev_samp(s) FROM
  (SELECT chrom, pos, max(ci) AS s FROM g_track GROUP BY chrom, pos) u)) x3"""


@query("agg_label_sites", _labelled(BAND, CI95, HALF))
def label_sites(v):
    return K.label_sites(
        {"SNPindex": K.filter_outside_band(v.g_track, "stat", "ci"), "Gprime": K.above_ci(v.g_track, "stat"), "ED": K.above_ci(v.g_track, "ci")}
    )


@query(
    "flow_qtl_candidates",
    f"""SELECT m.chrom, m.pos, m.feature, round(m.stat, 6) AS stat, l.label FROM (
  SELECT * FROM {BAND} UNION SELECT * FROM {CI95} UNION SELECT * FROM {HALF}) m
  JOIN ({_labelled(BAND, CI95, HALF)}) l ON m.chrom = l.chrom AND m.pos = l.pos""",
)
def qtl(v):
    q = qtl_candidates(v.g_track, "stat", "ci", "stat", "ci", "CI_95", ["chrom", "pos", "feature"])
    return q.select("chrom", "pos", "feature", "stat", "label")


ANY_P = "(p_wald <= 1e-5 OR p_lrt <= 1e-5 OR p_score <= 1e-5)"


@query("flt_any_p", f"SELECT DISTINCT chrom, pos, id FROM g_assoc WHERE {ANY_P}")
def any_p(v):
    return K.filter_any_p(v.g_assoc, 1e-5).select("chrom", "pos", "id")


@query(
    "flow_gwas_subsets",
    """WITH an AS (SELECT DISTINCT chrom, pos, concat('G', CAST(pos % 500 AS VARCHAR)) AS gene FROM g_sites WHERE pos % 2 = 0),
h AS (SELECT a.*, an.gene, least(p_wald, p_lrt, p_score) AS p FROM g_assoc a JOIN an ON a.chrom = an.chrom AND a.pos = an.pos)
SELECT id, gene, 'suggestive' AS level FROM h WHERE p <= 1e-5 UNION ALL SELECT id, gene, 'strict' FROM h WHERE p <= 5e-8""",
)
def gwas(v):
    anno = v.g_sites.filter("pos % 2 = 0").selectExpr("chrom", "pos", "concat('G', CAST(pos % 500 AS STRING)) AS gene", "alt AS effect")
    level = F.when(c("p_cutoff") > 1e-6, "suggestive").otherwise("strict")
    return gwas_subsets(v.g_assoc, anno).select("id", "gene", level.alias("level"))


@query(
    "agg_explained_variance",
    "SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (), 6) AS share FROM supplier",
)
def explained_variance(v):
    return K.explained_variance(v.supplier, value="s_acctbal").select("s_suppkey", "share")


def _shares(v):
    """Long population shares: lines of an order as populations."""
    return v.lineitem.groupBy(c("l_orderkey").alias("sample_id"), c("l_linenumber").alias("population")).agg(F.sum("l_quantity").alias("share"))


@query(
    "agg_assign_group",
    """WITH q AS (SELECT l_orderkey AS sample_id, l_linenumber AS population, sum(l_quantity) AS share FROM lineitem GROUP BY ALL)
SELECT sample_id, population, share FROM q QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY share DESC, population DESC) = 1""",
)
def assign_group(v):
    return K.assign_group(_shares(v))


@query(
    "agg_best_k",
    """WITH l AS (SELECT p_size AS k, round(avg(p_retailprice), 2) AS cv FROM part GROUP BY p_size)
SELECT k, cv FROM l ORDER BY cv, k LIMIT 1""",
)
def best_k(v):
    log = v.part.groupBy(c("p_size").alias("k")).agg(F.round(F.avg("p_retailprice"), 2).alias("cv"))
    return K.best_k(log, "cv", smallest=True)


# --- enrichment --------------------------------------------------------------

LG = "lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - {b} + 1)"
# ties in p are settled on eight digits in both engines before the adjustment
ENRICH = """
bg AS (SELECT term, count(DISTINCT gene) AS n FROM {GT} GROUP BY term),
tot AS (SELECT count(DISTINCT gene) AS t FROM {GT}),
hit AS (SELECT DISTINCT {BY} g.term, g.gene FROM {GT} g JOIN {PICK} p ON p.gene = g.gene),
pk AS (SELECT {BY} count(DISTINCT gene) AS pt FROM hit {GROUP}),
k AS (SELECT {BY} term, count(*) AS k, string_agg(gene, '/' ORDER BY gene) AS genes FROM hit GROUP BY {BY} term),
j AS (SELECT k.*, bg.n, pk.pt, tot.t FROM k JOIN bg ON k.term = bg.term JOIN pk ON {ON}, tot),
pv AS (SELECT *, least(1, list_sum(list_transform(range(k, least(n, pt) + 1),
  lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + lgamma(t - n + 1) - lgamma(pt - i + 1) - lgamma(t - n - pt + i + 1)
    - lgamma(t + 1) + lgamma(pt + 1) + lgamma(t - pt + 1))))) AS p FROM j),
r AS (SELECT *, p * count(*) OVER ({PART}) / row_number() OVER ({PART} ORDER BY p) AS q FROM pv),
e AS (SELECT {BY} term, k AS pick_count, n AS bg_count, round(p, 4) AS p4, abs(round(log10(p), 4)) AS l4, genes, concat(CAST(k AS VARCHAR), '|', CAST(pt AS VARCHAR)) AS gene_ratio,
  concat(CAST(n AS VARCHAR), '|', CAST(t AS VARCHAR)) AS bg_ratio,
  round(least(1, min(q) OVER ({PART} ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 4) AS q4 FROM r)
"""


def _enrich_sql(pick: str, by: list[str], gt: str = "g_gene_term") -> str:
    return ENRICH.format(
        GT=gt, PICK=pick, BY="".join(f"{b}, " for b in by), GROUP=f"GROUP BY {', '.join(by)}" if by else "",
        ON=" AND ".join(f"k.{b} = pk.{b}" for b in by) or "TRUE", PART=f"PARTITION BY {', '.join(by)}" if by else "",
    )


def _show(df, by):
    cols = ["term", "pick_count", "bg_count", "genes", "gene_ratio", "bg_ratio"]
    return df.select(*by, *cols, F.round("pvalue", 4).alias("p4"), F.round("p_adjust", 4).alias("q4"), F.abs(F.round("neglog10_p", 4)).alias("l4"))


@query(
    "agg_enrich",
    "WITH pick AS (SELECT concat('G', CAST(p_partkey AS VARCHAR)) AS gene FROM part WHERE p_size < 10)," + _enrich_sql("pick", []) + "SELECT * FROM e",
)
def enrich(v):
    picked = v.part.filter("p_size < 10").select(F.concat(F.lit("G"), c("p_partkey").cast("string")).alias("gene"))
    return _show(E.enrich(v.g_gene_term, picked), [])


LISTS = """
d AS (SELECT *, CASE WHEN logfc >= 1 THEN 'UP' ELSE 'DOWN' END AS direction FROM g_diff WHERE fdr <= 0.05 AND (logfc >= 1 OR logfc <= -1)),
lists AS (SELECT contrast, gene, direction AS gene_list FROM d UNION ALL SELECT contrast, gene, 'ALL' FROM d)
"""


@query(
    "agg_enrich_lists",
    "WITH " + LISTS + "," + _enrich_sql("lists", ["contrast", "gene_list"]) + "SELECT * FROM e",
)
def enrich_lists(v):
    by = ["contrast", "gene_list"]
    return _show(E.enrich(v.g_gene_term, E.diff_lists(E.diff_genes(v.g_diff)), by), by)


def _names(v):
    return v.supplier.groupBy(F.concat(F.lit("T"), (c("s_suppkey") % 50).cast("string")).alias("term")).agg(
        F.min("s_name").alias("description")
    )


@query(
    "flow_contrast_enrichment",
    "WITH " + LISTS + "," + _enrich_sql("lists", ["contrast", "gene_list"]) + """,
nm AS (SELECT concat('T', CAST(s_suppkey % 50 AS VARCHAR)) AS term, min(s_name) AS description FROM supplier GROUP BY 1)
SELECT e.contrast, e.gene_list, e.term, nm.description, e.p4, e.q4 FROM e JOIN nm ON e.term = nm.term""",
)
def contrast_flow(v):
    x = contrast_enrichment(v.g_diff, v.g_gene_term, _names(v))
    return x.select("contrast", "gene_list", "term", "description", F.round("pvalue", 4).alias("p4"), F.round("p_adjust", 4).alias("q4"))


@query(
    "jn_name_terms",
    """SELECT g.gene, g.term, n.description FROM g_gene_term g JOIN
  (SELECT concat('T', CAST(s_suppkey % 50 AS VARCHAR)) AS term, min(s_name) AS description FROM supplier GROUP BY 1) n ON g.term = n.term""",
)
def name_terms(v):
    return E.name_terms(v.g_gene_term, _names(v))


# a source gene is written Eg<part>, two of them share an id in every tenth case
@query(
    "agg_enrich_kegg",
    """WITH gt AS (SELECT DISTINCT concat('N', CAST(l_partkey % 1000 AS VARCHAR)) AS gene, concat('T', CAST(l_suppkey % 50 AS VARCHAR)) AS term FROM lineitem),
pick AS (SELECT DISTINCT concat('N', CAST(p_partkey % 1000 AS VARCHAR)) AS gene FROM part WHERE p_size < 10),"""
    + _enrich_sql("pick", [], "gt") + "SELECT concat('ko', term) AS term, pick_count, bg_count, gene_ratio, bg_ratio, p4, q4, l4 FROM e",
)
def enrich_kegg(v):
    gt = v.lineitem.selectExpr("concat('N', l_partkey % 1000) AS gene", "concat('T', l_suppkey % 50) AS term").distinct()
    ids = v.part.selectExpr("concat('Eg', p_partkey) AS gene", "concat('N', p_partkey % 1000) AS target")
    picked = v.part.filter("p_size < 10").selectExpr("concat('Eg', p_partkey) AS gene")
    return _show(E.enrich_kegg(gt, picked, ids, prefix="ko"), []).drop("genes")


@query(
    "jn_shown_genes",
    """WITH b AS (SELECT p_partkey % 1000 AS t, string_agg(concat('Eg', CAST(p_partkey AS VARCHAR)), ',' ORDER BY concat('Eg', CAST(p_partkey AS VARCHAR))) AS s, count(*) AS n
  FROM part GROUP BY 1)
SELECT concat('T', CAST(t AS VARCHAR)) AS term, CASE WHEN n > 1 THEN concat('(', s, ')') ELSE s END AS genes FROM b""",
)
def shown_genes(v):
    ids = v.part.selectExpr("concat('Eg', p_partkey) AS gene", "concat('N', p_partkey % 1000) AS target")
    result = v.part.selectExpr("concat('T', p_partkey % 1000) AS term", "concat('N', p_partkey % 1000) AS genes").distinct()
    return E.shown_genes(result, ids).select("term", "genes")


@query(
    "win_bh_adjust",
    """WITH r AS (SELECT id, p_wald AS p, p_wald * count(*) OVER (PARTITION BY chrom) / row_number() OVER (PARTITION BY chrom ORDER BY p_wald) AS q, chrom FROM g_assoc)
SELECT id, round(least(1, min(q) OVER (PARTITION BY chrom ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) * 1000, 6) AS q FROM r""",
)
def bh_adjust(v):
    return E.bh_adjust(v.g_assoc, "p_wald", ["chrom"]).select("id", (c("p_adjust") * 1000).alias("q"))


@query(
    "flt_diff_genes",
    "WITH " + LISTS + "SELECT contrast, gene, direction FROM d",
)
def diff_genes(v):
    return E.diff_genes(v.g_diff).select("contrast", "gene", "direction")


@query(
    "agg_zscore_long",
    """SELECT gene, sample_name, 'tpm_raw' AS value_type, round(value, 6) AS value FROM g_expr UNION ALL
SELECT gene, sample_name, 'tpm_zscore', round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 6) FROM g_expr WINDOW w AS (PARTITION BY gene)""",
)
def zscore_long(v):
    return E.zscore_long(v.g_expr)


@query(
    "prj_explode_terms",
    """SELECT DISTINCT gene, unnest(string_split(terms, ',')) AS term FROM (SELECT concat('G', CAST(p_partkey AS VARCHAR)) AS gene,
  CASE WHEN p_size % 5 = 0 THEN '-' ELSE concat(p_brand, ',', p_type, ',', p_brand) END AS terms FROM part) x WHERE terms <> '-'""",
)
def explode_terms(v):
    x = v.part.selectExpr(
        "concat('G', p_partkey) AS gene", "CASE WHEN p_size % 5 = 0 THEN '-' ELSE concat(p_brand, ',', p_type, ',', p_brand) END AS terms"
    )
    return E.explode_terms(x, "terms")


@query(
    "srt_top_terms",
    "SELECT term, count(*) AS n FROM g_gene_term GROUP BY term ORDER BY n DESC, term LIMIT 30",
)
def top_terms(v):
    n = v.g_gene_term.groupBy("term").agg(F.count("*").alias("n"))
    return T.top_k(n, [F.desc("n"), F.asc("term")], 30)


@query(
    "scl_magnitude_bin",
    """SELECT count(*) AS n, 0 AS out_of_order FROM events""",
)
def magnitude_bin(v):
    # the largest value of a bin never passes the smallest of the next
    from pyspark.sql import Window

    b = v.events.groupBy(ST.magnitude_bin(c("value")).alias("b")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    # one row per distinct magnitude bin
    o = b.withColumn("prev", F.lag("hi").over(Window.orderBy("b")))
    return o.agg(F.sum("n").alias("n"), F.count_if(c("prev") >= c("lo")).cast("int").alias("out_of_order"))
