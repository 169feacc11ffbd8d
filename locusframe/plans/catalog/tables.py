"""Joins, sets, sorts, validation and library bookkeeping queries."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...operators import qc as Q
from ...operators import tables as B
from ..registry import query

c = F.col


def _anno(v):
    return v.g_genes.select(c("gene_id").alias("gene"), c("chrom").alias("gene_chrom"), "start")


@query(
    "jn_annotate",
    "SELECT g.gene, g.term, a.chrom AS gene_chrom, a.start FROM g_gene_term g LEFT JOIN g_genes a ON a.gene_id = g.gene",
)
def annotate(v):
    return B.annotate(v.g_gene_term, _anno(v), ["gene"])


@query(
    "jn_inner_on",
    """SELECT s.id, h.hit FROM g_sites s JOIN (SELECT chrom, max(id) AS hit FROM g_intervals GROUP BY chrom) h ON s.chrom = h.chrom""",
)
def inner_on(v):
    other = v.g_intervals.select("chrom", c("id").alias("hit"))
    return B.inner_on(v.g_sites, other, ["chrom"], [F.desc("hit")]).select("id", "hit")


@query(
    "jn_outer_counts",
    """SELECT coalesce(a.k, b.k) AS k, coalesce(a.n1, 0) AS n1, coalesce(b.n2, 0) AS n2 FROM
  (SELECT l_partkey AS k, count(*) AS n1 FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a FULL JOIN
  (SELECT l_partkey AS k, count(*) AS n2 FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON a.k = b.k""",
)
def outer_counts(v):
    n = lambda flag, name: v.lineitem.filter(c("l_returnflag") == flag).groupBy(c("l_partkey").alias("k")).agg(F.count("*").alias(name))
    return B.outer_counts([n("A", "n1"), n("R", "n2")], ["k"], ["n1", "n2"])


@query("jn_keep_in", "SELECT gene, term FROM g_gene_term WHERE gene IN (SELECT gene_id FROM g_genes)")
def keep_in(v):
    return B.keep_in(v.g_gene_term, _anno(v), ["gene"])


@query("jn_keep_not_in", "SELECT gene, term FROM g_gene_term WHERE gene NOT IN (SELECT gene_id FROM g_genes)")
def keep_not_in(v):
    return B.keep_not_in(v.g_gene_term, _anno(v), ["gene"])


@query(
    "jn_rename_keys",
    "SELECT CASE WHEN chrom IN ('chr1', 'chr2') THEN concat('NC_', substr(chrom, 4)) ELSE chrom END AS chrom, pos, id FROM g_sites",
)
def rename_keys(v):
    m = v.g_sizes.filter("rank <= 2").select(c("chrom").alias("old"), F.concat(F.lit("NC_"), "rank").alias("new"))
    return B.rename_keys(v.g_sites.select("chrom", "pos", "id"), m, "chrom")


@query("jn_rename_keys_inner", "SELECT concat('NC_', substr(chrom, 4)) AS chrom, pos, id FROM g_sites WHERE chrom IN ('chr1', 'chr2')")
def rename_keys_inner(v):
    m = v.g_sizes.filter("rank <= 2").select(c("chrom").alias("old"), F.concat(F.lit("NC_"), "rank").alias("new"))
    return B.rename_keys(v.g_sites.select("chrom", "pos", "id"), m, "chrom", keep=False)


@query("prj_rename_map", "SELECT p_partkey AS id, p_name AS description, CASE WHEN p_size > 25 THEN p_brand ELSE '--' END AS pfam FROM part")
def rename_map(v):
    x = v.part.withColumn("p_brand", F.when(c("p_size") > 25, c("p_brand")))
    return B.rename_map(x, {"p_partkey": "id", "p_name": "description", "p_brand": "pfam"}, "--")


@query(
    "prj_coordinates",
    """SELECT id, start + 1 AS pos, (start + "end") // 2 AS mid, "end" - start AS span FROM g_intervals""",
)
def coordinates(v):
    return v.g_intervals.select("id", (c("start") + 1).alias("pos"), F.expr("(start + `end`) div 2").alias("mid"), (c("end") - c("start")).alias("span"))


@query("jn_attach_by_line", "SELECT p_partkey AS line_no, p_name, p_size FROM part")
def attach_by_line(v):
    return B.attach_by_line(
        v.part.select(c("p_partkey").alias("line_no"), "p_name"), v.part.select(c("p_partkey").alias("line_no"), "p_size")
    )


@query(
    "flt_slice_region",
    "SELECT DISTINCT chrom, pos, id, ref, alt FROM g_sites WHERE chrom = 'chr2' AND pos BETWEEN 50000 AND 400000 AND length(ref) = 1 AND length(alt) = 1",
)
def slice_region(v):
    return B.slice_region(v.g_sites.select("chrom", "pos", "id", "ref", "alt"), "chr2", 50_000, 400_000, snp_only=True)


@query(
    "flt_no_variant",
    """SELECT id, alt, 'snp' AS kind FROM x WHERE NOT (alt = '.' AND length(ref) > 1) UNION ALL
  SELECT id, alt, 'indel' FROM x WHERE NOT (alt = '.' AND length(ref) = 1)""".replace(
        "x WHERE", "(SELECT id, ref, CASE WHEN site_no % 3 = 0 THEN '.' ELSE alt END AS alt FROM g_sites) x WHERE"
    ),
)
def no_variant(v):
    x = v.g_sites.select("id", "ref", F.when(c("site_no") % 3 == 0, ".").otherwise(c("alt")).alias("alt"))
    one = lambda k: B.filter_no_variant(x, k).select("id", "alt", F.lit(k).alias("kind"))
    return one("snp").unionByName(one("indel"))


@query(
    "flt_validate",
    """SELECT 'protein_pos' AS "column", 'null values' AS problem, count(*) AS rows FROM g_db WHERE protein_pos IS NULL
UNION ALL SELECT 'cds_pos', 'missing column', 0 UNION ALL SELECT 'pos', 'type bigint, wanted int', 0""",
)
def validate(v):
    schema = T.StructType(
        [
            T.StructField("chrom", T.StringType(), False), T.StructField("pos", T.IntegerType(), False),
            T.StructField("protein_pos", T.LongType(), False), T.StructField("cds_pos", T.LongType(), True),
            T.StructField("impact", T.StringType(), True),
        ]
    )
    return B.validate(v.g_db, schema)


# --- sorts -------------------------------------------------------------------


@query("srt_sites", "SELECT chrom, pos, id FROM g_sites ORDER BY chrom, pos")
def sort_sites(v):
    return B.sort_sites(v.g_sites.select("chrom", "pos", "id"))


@query("srt_genome_order", "SELECT s.chrom, s.pos, s.id FROM g_sites s JOIN g_sizes z ON s.chrom = z.chrom ORDER BY z.rank, s.pos")
def genome_order(v):
    return B.sort_sites(v.g_sites.select("chrom", "pos", "id"), v.g_sizes)


@query("srt_priority", "SELECT id, score, round(maf, 6) AS maf FROM g_candidates ORDER BY score DESC, maf, id")
def priority(v):
    return B.sort_priority(v.g_candidates.select("id", "score", "maf"), ["score", "maf", "id"], [False, True, True])


@query("srt_head_sites", "SELECT chrom, pos, id FROM g_sites ORDER BY chrom, pos LIMIT 500")
def head_sites(v):
    return B.head_sites(v.g_sites.select("chrom", "pos", "id"), 500)


@query("srt_down_sample", "SELECT id, pos FROM g_sites ORDER BY md5(concat('7:', id)), id LIMIT 1000")
def down_sample(v):
    return B.down_sample(v.g_sites.select("id", "pos"), 1000, 7)


# --- sets --------------------------------------------------------------------


@query("set_union_all", "SELECT id, chrom, pos, CAST(NULL AS BIGINT) AS start FROM g_sites UNION ALL SELECT id, chrom, NULL, start FROM g_intervals")
def union_all(v):
    return B.union_all([v.g_sites.select("id", "chrom", "pos"), v.g_intervals.select("id", "chrom", "start")])


@query(
    "set_union_distinct_by",
    """SELECT chrom, id FROM (SELECT chrom, id, row_number() OVER (PARTITION BY chrom, k ORDER BY id) AS r FROM (
  SELECT chrom, id, pos % 50 AS k FROM g_sites UNION ALL SELECT chrom, id, start % 50 FROM g_intervals) u) x WHERE r = 1""",
)
def union_distinct_by(v):
    a = v.g_sites.select("chrom", "id", (c("pos") % 50).alias("k"))
    b = v.g_intervals.select("chrom", "id", (c("start") % 50).alias("k"))
    return B.union_distinct_by([a, b], ["chrom", "k"], [F.asc("id")]).select("chrom", "id")


@query("set_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct(v):
    return B.distinct_by(v.lineitem.select("l_partkey", "l_suppkey"))


@query(
    "set_first_by_id",
    "SELECT l_partkey, l_orderkey FROM (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS k FROM lineitem) x WHERE k = 1",
)
def first_by_id(v):
    return B.distinct_by(v.lineitem.select("l_partkey", "l_orderkey"), ["l_partkey"], [F.asc("l_orderkey")])


@query("set_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicates(v):
    return B.duplicates(v.lineitem, ["l_orderkey", "l_linenumber"])


STATUS = """SELECT user_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) = 1"""


@query("snk_upsert_latest", STATUS)
def upsert_latest(v):
    x = v.events.select("user_id", "ts", "event_type")
    half = F.lit("2024-01-15").cast("timestamp")
    return B.upsert_latest(x.filter(c("ts") < half), x.filter(c("ts") >= half), ["user_id"], "ts")


# --- libraries ---------------------------------------------------------------


@query("jn_match_libraries", "SELECT s.libid, s.sample_id, f.read_type, f.path FROM g_sheet s LEFT JOIN g_files f ON s.libid = f.libid")
def match_libraries(v):
    return Q.match_libraries(v.g_sheet, v.g_files).select("libid", "sample_id", "read_type", "path")


@query(
    "agg_library_qc",
    """SELECT count(DISTINCT s.sample_id) AS samples, count(DISTINCT s.libid) AS libraries,
  count(DISTINCT s.sample_id) FILTER (WHERE f.path IS NULL) AS missing_samples, count(DISTINCT s.libid) FILTER (WHERE f.path IS NULL) AS missing_libraries
  FROM g_sheet s LEFT JOIN g_files f ON s.libid = f.libid""",
)
def library_qc(v):
    return Q.library_qc(v.g_sheet, v.g_files)


@query(
    "flow_library_report",
    """WITH sh AS (SELECT * FROM g_sheet UNION ALL SELECT * FROM g_sheet WHERE dir_name = 'd1')
SELECT libid AS name, 'DUPLICATED' AS error_type, concat_ws(' | ', 'duplicate sheet row', libid, sample_id, dir_name) AS message FROM sh GROUP BY libid, sample_id, dir_name HAVING count(*) > 1
UNION ALL SELECT DISTINCT libid, 'INCOMPLETE', concat_ws(' | ', 'low data', libid, sample_id, dir_name) FROM sh WHERE data_size < 0.01
UNION ALL SELECT libid, 'INCOMPLETE', concat('R1 ', CAST(count(*) FILTER (WHERE read_type = 'R1') AS VARCHAR), ' R2 ', CAST(count(*) FILTER (WHERE read_type = 'R2') AS VARCHAR))
  FROM g_files GROUP BY libid HAVING count(*) FILTER (WHERE read_type = 'R1') <> count(*) FILTER (WHERE read_type = 'R2')
UNION ALL SELECT DISTINCT libid, 'INCOMPLETE', concat_ws(' | ', 'no files', libid, sample_id, dir_name) FROM sh WHERE libid NOT IN (SELECT libid FROM g_files)""",
)
def library_report(v):
    from ..flows import library_report as flow

    return flow(v.g_sheet.unionByName(v.g_sheet.filter("dir_name = 'd1'")), v.g_files)


@query(
    "agg_merge_plan",
    """SELECT s.sample_id, f.read_type, string_agg(f.path, ',' ORDER BY f.path) AS files, count(f.path) AS n_files
  FROM g_sheet s LEFT JOIN g_files f ON s.libid = f.libid GROUP BY s.sample_id, f.read_type HAVING count(*) = count(f.path)""",
)
def merge_plan(v):
    return Q.merge_plan(Q.match_libraries(v.g_sheet, v.g_files))


# fifty events in a row stand for one read-quality curve
CURVES = """
cv AS (SELECT event_id // 50 AS libid, row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) - 1 AS position, value FROM events),
n AS (SELECT libid, count(*) AS n FROM cv GROUP BY libid HAVING count(*) >= 10),
ht AS (SELECT cv.libid, avg(value) FILTER (WHERE position < least(10, n // 4)) AS head_quality, avg(value) FILTER (WHERE position >= n - least(10, n // 4)) AS tail_quality
  FROM cv JOIN n ON cv.libid = n.libid GROUP BY cv.libid),
th AS (SELECT *, CASE WHEN head_quality - tail_quality > 0 THEN (head_quality - tail_quality) * 0.1 ELSE 2.0 END AS lim FROM ht),
st AS (SELECT libid, position, value AS quality_after, lag(value) OVER (PARTITION BY libid ORDER BY position) AS quality_before FROM cv),
an AS (SELECT st.libid, CAST(st.position AS INT) AS position, quality_before, quality_after, abs(quality_before - quality_after) AS d, quality_after < 30 AS below_q30, head_quality, tail_quality, lim
  FROM st JOIN th ON st.libid = th.libid WHERE abs(quality_before - quality_after) > lim)
"""


def _curves(v):
    x = v.events.groupBy(F.expr("event_id div 50").alias("libid")).agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("x"))
    return x.select("libid", F.transform("x", lambda y: y["value"]).alias("curve"))


@query(
    "agg_quality_anomalies",
    "WITH " + CURVES + """SELECT libid, position, round(quality_before, 6) AS quality_before, round(quality_after, 6) AS quality_after, round(d, 6) AS "drop", below_q30,
  round(head_quality, 6) AS head_quality, round(tail_quality, 6) AS tail_quality, round(lim, 6) AS dynamic_threshold FROM an""",
)
def quality_anomalies(v):
    return Q.quality_anomalies(_curves(v), ["libid"])


@query(
    "agg_quality_summary",
    "WITH " + CURVES + """SELECT l.libid, count(an.position) AS bad_number, coalesce(min(position), 0) AS bad_start, coalesce(max(position), 0) AS bad_end, round(coalesce(max(d), 0), 6) AS max_drop
  FROM (SELECT DISTINCT libid FROM cv) l LEFT JOIN an ON l.libid = an.libid GROUP BY l.libid""",
)
def quality_summary(v):
    x = _curves(v)
    return Q.quality_summary(Q.quality_anomalies(x, ["libid"]), x)


@query(
    "agg_q30_rate",
    "WITH " + CURVES + "SELECT libid, round(count(*) FILTER (WHERE value >= 30) * 1.0 / count(*), 6) AS q30_rate FROM cv GROUP BY libid",
)
def q30_rate(v):
    return Q.q30_rate(_curves(v)).select("libid", "q30_rate")


# --- genes -------------------------------------------------------------------


def _features(v):
    return v.g_intervals.selectExpr(
        "concat('G', p_size) AS gene_id", "id AS transcript_id", "concat('c', p_size % 5) AS chrom", "start", "end",
        "CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand",
    )


@query(
    "agg_gene_locus",
    """WITH f AS (SELECT p_size, concat('G', CAST(p_size AS VARCHAR)) AS gene_id, start, "end", CASE WHEN p_size % 2 = 0 THEN p_brand END AS nm, p_type AS ds
  FROM g_intervals i JOIN part p ON i.id = concat('iv', CAST(p.p_partkey AS VARCHAR)) AND i.p_size = p.p_size) """.replace("SELECT p_size,", "SELECT i.p_size AS p_size,").replace("WHEN p_size %", "WHEN i.p_size %").replace("CAST(p_size AS", "CAST(i.p_size AS")
    + """SELECT gene_id, concat('c', CAST(any_value(p_size) % 5 AS VARCHAR), ':', CAST(min(start) AS VARCHAR), '-', CAST(max("end") AS VARCHAR), '|', CASE WHEN any_value(p_size) % 2 = 0 THEN '+' ELSE '-' END) AS locus,
  coalesce(string_agg(DISTINCT nm, '|' ORDER BY nm), '-') AS gene_name, string_agg(DISTINCT ds, '|' ORDER BY ds) AS gene_description FROM f GROUP BY gene_id""",
)
def gene_locus(v):
    anno = v.part.selectExpr(
        "concat('iv', p_partkey) AS transcript_id", "CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '-' END AS gene_name", "p_type AS gene_description"
    )
    return Q.gene_locus(_features(v), anno)


@query(
    "agg_gene_products",
    """SELECT concat('G', CAST(p_size AS VARCHAR)) AS gene_id, CASE WHEN p_size % 3 = 0 THEN '--' ELSE string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) END AS description
  FROM part GROUP BY p_size""",
)
def gene_products(v):
    return Q.gene_products(v.part.selectExpr("concat('G', p_size) AS gene_id", "CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS product"))


@query(
    "agg_representative",
    """SELECT gene_id, transcript_id, md5(seq) AS seq_md5 FROM (SELECT concat('G', CAST(seq_id % 100 AS VARCHAR)) AS gene_id, seq_id AS transcript_id, seq,
  row_number() OVER (PARTITION BY seq_id % 100 ORDER BY length(seq) DESC, seq_id) AS k FROM g_seq) x WHERE k = 1""",
)
def representative(v):
    seqs = v.g_seq.select(c("seq_id").alias("transcript_id"), "seq", c("seq_id").alias("ord"))
    genes = v.g_seq.selectExpr("seq_id AS transcript_id", "concat('G', seq_id % 100) AS gene_id")
    return Q.representative(seqs, genes).select("gene_id", "transcript_id", F.md5("seq").alias("seq_md5"))


# --- recast calls ------------------------------------------------------------


@query(
    "flow_genotype_tables",
    """SELECT chrom, pos, substr(ref, 1, 1) AS ref, sa AS alt, sample_id, gt,
  CASE gt WHEN './.' THEN 'NN' WHEN '0/0' THEN concat(r, r) WHEN '1/1' THEN CASE WHEN length(sa) > 1 THEN sa ELSE concat(sa, sa) END
    ELSE CASE WHEN length(sa) > 1 THEN concat(r, '/', sa) ELSE concat(r, sa) END END AS bases,
  CASE WHEN sa LIKE 'ins%' THEN 'INS' WHEN sa LIKE 'del%' THEN 'DEL' ELSE 'SNP' END AS type
  FROM (SELECT *, substr(ref, 1, 1) AS r, CASE WHEN length(ref) > length(alt) THEN concat('del', substr(ref, 2))
    WHEN length(ref) < length(alt) THEN concat('ins', substr(alt, 2)) ELSE substr(alt, 1, 1) END AS sa FROM g_calls) x""",
)
def genotype_tables(v):
    from ..flows import genotype_tables as flow

    return flow(v.g_calls)


@query(
    "flow_phenotype_table",
    """SELECT chrom, pos, 'height' AS trait, concat('G', CAST(pos % 500 AS VARCHAR)) AS gene, sample_id,
  CASE gt WHEN './.' THEN 'Missing' WHEN '0/0' THEN 'Tall' WHEN '1/1' THEN CASE WHEN substr(ref, 1, 1) = substr(alt, 1, 1) THEN 'Tall' ELSE 'Short' END
    ELSE CASE WHEN substr(ref, 1, 1) = substr(alt, 1, 1) THEN 'Tall' ELSE 'Heterozygous' END END AS phenotype
  FROM g_calls WHERE pos % 3 = 0 AND length(ref) = length(alt)""",
)
def phenotype_table(v):
    from ..flows import genotype_tables as tables
    from ..flows import phenotype_table as flow
    from .calls import pheno_view

    # indel sites carry no described del / ins allele and fall out
    return flow(tables(v.g_calls), pheno_view(v))


@query(
    "flow_sample_variants",
    """SELECT c.id, c.sample_id, c.gt, c.ref_depth, c.alt_depth, CASE WHEN c.pos % 4 = 0 THEN '-' ELSE concat('t', CAST(c.pos % 3 AS VARCHAR)) END AS effect,
  CASE WHEN c.pos % 4 = 0 THEN '-' ELSE concat('G', CAST(c.pos % 500 AS VARCHAR)) END AS gene FROM g_calls c WHERE gt IN ('0/1', '1/1')""",
)
def sample_variants(v):
    from ..flows import sample_variants as flow

    first = v.g_sites.filter("pos % 4 <> 0").selectExpr(
        "chrom", "pos", "ref", "alt", "concat('t', pos % 3) AS effect", "concat('G', pos % 500) AS gene", "1 AS impact_order"
    )
    later = first.withColumns({"impact_order": F.lit(2), "effect": F.lit("a")})
    return flow(v.g_calls, first.unionByName(later)).select("id", "sample_id", "gt", "ref_depth", "alt_depth", "effect", "gene")


PACKED = "concat(sample_id, '=', gt, ';', CAST(ref_depth AS VARCHAR), ',', CAST(alt_depth AS VARCHAR))"


@query("flow_export_calls", f"SELECT chrom, pos, ref, alt, {PACKED} AS accession FROM g_calls WHERE gt <> '0/0'")
def export_calls(v):
    from ..flows import export_calls as flow

    return flow(v.g_calls)


@query(
    "flow_pack_accessions",
    f"SELECT chrom, pos, ref, alt, count(*) AS n, string_agg({PACKED}, chr(9) ORDER BY {PACKED}) AS accessions FROM g_calls WHERE gt <> '0/0' GROUP BY chrom, pos, ref, alt",
)
def pack_accessions(v):
    from ..flows import pack_accessions as flow

    return flow(v.g_calls)


@query(
    "flow_species_proteins",
    """SELECT s_suppkey AS seq_id, CAST(s_nationkey AS VARCHAR) AS taxon_id FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""",
)
def species_proteins(v):
    from ..flows import species_proteins as flow

    rec = v.supplier.selectExpr("s_suppkey AS seq_id", "concat('Protein OS=', s_name, ' OX=', s_nationkey, ' GN=g PE=1') AS description")
    taxa = v.nation.filter("n_regionkey = 1").selectExpr("CAST(n_nationkey AS STRING) AS taxon_id")
    return flow(rec, taxa).select("seq_id", "taxon_id")


@query(
    "flow_repair_gtf",
    """WITH f AS (SELECT id, p_size, CASE p_size % 4 WHEN 0 THEN 'exon' WHEN 1 THEN 'CDS' WHEN 2 THEN 'transcript' ELSE 'exon' END AS feature, start FROM g_intervals)
SELECT id, feature, start FROM f
UNION ALL SELECT id, 'transcript', start FROM f WHERE feature = 'exon' UNION ALL SELECT id, 'CDS', start FROM f WHERE feature = 'exon'
UNION ALL SELECT id, 'exon', start FROM f WHERE feature = 'CDS'""",
)
def repair_gtf(v):
    from ..flows import repair_gtf as flow

    x = v.g_intervals.selectExpr(
        "id", "CASE p_size % 4 WHEN 0 THEN 'exon' WHEN 1 THEN 'CDS' WHEN 2 THEN 'transcript' ELSE 'exon' END AS feature", "start", "`end`",
        "'.' AS strand", "concat('transcript_id \"', id, '\";') AS attributes",
    )
    return flow(x).select("id", "feature", "start")


@query(
    "re_marker_set",
)
def marker_set(v):
    from ..markers import marker_set as run

    return run(v.g_calls)
