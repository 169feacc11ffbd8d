"""Coverage queries."""

from pyspark.sql import functions as F

from ...operators import coverage as V
from ...operators import intervals as I
from ..flows import coverage_report
from ..registry import query

c = F.col
CUTS = [10, 30, 50, 100]


def _breadth(cuts=CUTS) -> str:
    return ", ".join(f"round(avg(CASE WHEN depth >= {k} THEN 1.0 ELSE 0 END), 6) AS coverage_{k}x" for k in cuts)


def _region(keys: str) -> str:
    return f"""SELECT {keys}, min(depth) AS min_cov, max(depth) AS max_cov, round(avg(depth), 6) AS mean_cov,
  round(quantile_cont(depth, 0.5), 6) AS median_cov, {_breadth()} FROM g_depth GROUP BY {keys}"""


@query("agg_region_coverage", _region('chrom, start, "end"'))
def region_coverage(v):
    return V.region_coverage(v.g_depth, ["chrom", "start", "end"], CUTS)


@query(
    "agg_sample_coverage",
    f"""SELECT sample_id, round(avg(depth), 6) AS mean_coverage, {_breadth()}, count(*) AS total_count,
  count(*) FILTER (WHERE depth <= 0) AS missing_count, round(count(*) FILTER (WHERE depth > 0) * 1.0 / count(*), 6) AS detected,
  round(count(*) FILTER (WHERE depth <= 0) * 1.0 / count(*), 6) AS missing FROM g_depth GROUP BY sample_id""",
)
def sample_coverage(v):
    return V.sample_coverage(v.g_depth, CUTS)


@query(
    "agg_per_base_coverage",
    """SELECT chrom, start, round(min(depth / 100.0), 6) AS min_cov, round(max(depth / 100.0), 6) AS max_cov FROM g_depth GROUP BY chrom, start""",
)
def per_base_coverage(v):
    return V.per_base(v.g_depth).groupBy("chrom", "start").agg(F.min("depth").alias("min_cov"), F.max("depth").alias("max_cov"))


def _windows(source: str, by: str = "") -> str:
    k = f"{by}, " if by else ""
    end = "CAST(ceil(((start + \"end\") // 2) / 20000.0) * 20000 AS BIGINT)"
    return f"""SELECT {k}chrom, {end} - 20000 AS win_start, {end} AS win_end, round(avg(CASE WHEN depth >= 60 THEN 1.0 ELSE 0 END), 6) AS coverage,
  CAST(avg(CASE WHEN depth >= 60 THEN 1.0 ELSE 0 END) < 0.5 AS INT) AS miss FROM {source} WHERE (start + "end") // 2 >= 1 GROUP BY ALL"""


@query("agg_window_coverage", _windows("g_depth"))
def window_coverage(v):
    return V.window_coverage(v.g_depth, 20_000, 60)


@query("agg_miss_percent", f"SELECT round(100 * avg(CAST(miss AS DOUBLE)), 1) AS miss_percent FROM ({_windows('g_depth')}) x")
def miss_percent(v):
    return V.miss_percent(V.window_coverage(v.g_depth, 20_000, 60))


@query(
    "agg_panel_window_coverage",
    """WITH ok AS (SELECT chrom, start FROM g_depth GROUP BY chrom, start HAVING avg(CASE WHEN depth >= 60 THEN 1.0 ELSE 0 END) >= 0.5),
q AS (SELECT d.* FROM g_depth d JOIN ok ON d.chrom = ok.chrom AND d.start = ok.start) """ + _windows("q", "sample_id"),
)
def panel_window_coverage(v):
    return V.panel_window_coverage(v.g_depth, 20_000, 60)


@query(
    "agg_evenness",
    """WITH m AS (SELECT sample_id, 0.2E0 * avg(depth) AS lim FROM g_depth GROUP BY sample_id), n AS (SELECT count(*) AS n FROM m)
SELECT d.chrom, d.pos, count(*) FILTER (WHERE d.depth >= m.lim) AS n_pass, round(count(*) FILTER (WHERE d.depth >= m.lim) * 1.0 / any_value(n.n), 6) AS pass_share
FROM g_depth d JOIN m ON d.sample_id = m.sample_id, n GROUP BY d.chrom, d.pos""",
)
def evenness(v):
    return V.evenness(v.g_depth)


@query("agg_sample_thresholds", "SELECT sample_id, round(avg(depth) * 0.2, 6) AS threshold FROM g_depth GROUP BY sample_id")
def sample_thresholds(v):
    return V.sample_thresholds(v.g_depth)


@query("set_all_positions", "SELECT DISTINCT chrom, pos FROM g_depth")
def all_positions(v):
    return V.all_positions(v.g_depth)


SAMPLES = [f"S{i}" for i in range(1, 8)]
_WIDE = ", ".join(f"max(depth) FILTER (WHERE sample_id = '{s}') AS {s}" for s in SAMPLES)


@query("jn_depth_matrix", f"SELECT chrom, pos, {_WIDE} FROM g_depth GROUP BY chrom, pos")
def depth_matrix(v):
    return V.matrix(v.g_depth, ["chrom", "pos"], SAMPLES)


def _reads(v):
    """Reads per probe and sample from the order lines."""
    return v.lineitem.groupBy(
        F.concat(F.lit("iv"), "l_partkey").alias("id"), F.concat(F.lit("S"), "l_linenumber").alias("sample_id")
    ).agg(F.count("*").alias("reads"))


@query(
    "agg_probe_density",
    """SELECT p.id, concat('S', CAST(l_linenumber AS VARCHAR)) AS sample_id, round(count(*) / 120.0, 6) AS density FROM lineitem l
  JOIN g_probes p ON p.id = concat('iv', CAST(l_partkey AS VARCHAR)) GROUP BY p.id, l_linenumber""",
)
def probe_density(v):
    return V.probe_density(_reads(v), v.g_probes)


@query(
    "agg_probe_counts",
    """SELECT p.id, count(DISTINCT l_orderkey) AS n FROM g_probes p LEFT JOIN lineitem l
  ON p.id = concat('iv', CAST(l_partkey AS VARCHAR)) AND l_returnflag <> 'N' GROUP BY p.id""",
)
def probe_counts(v):
    side = lambda flag, tag: v.lineitem.filter(c("l_returnflag") == flag).select(
        F.concat(c("l_orderkey").cast("string"), F.lit(tag)).alias("read_name"), F.concat(F.lit("iv"), "l_partkey").alias("id")
    )
    return V.probe_counts(side("A", "/1"), side("R", "/2"), v.g_probes)


GRID = """
g AS (SELECT chrom, unnest(range(0, size, 10000)) AS start FROM g_sizes),
n AS (SELECT chrom, CAST(ceil(pos / 10000.0) * 10000 - 10000 AS BIGINT) AS start, count(*) AS n FROM g_sites GROUP BY ALL)
"""


@query(
    "jn_grid_counts",
    "WITH " + GRID + """SELECT g.chrom, g.start, g.start + 10000 AS "end", coalesce(n.n, 0) AS n FROM g LEFT JOIN n ON g.chrom = n.chrom AND g.start = n.start""",
)
def grid_counts(v):
    return V.grid_counts(I.make_windows(v.g_sizes, 10_000), V.window_counts(v.g_sites, 10_000))


@query(
    "flt_filter_covered",
    """SELECT chrom, start, "end", sample_id, depth FROM g_depth WHERE depth >= 0.8 * ("end" - start)
  AND chrom IN (SELECT chrom FROM g_sizes WHERE rank <= 3)""",
)
def filter_covered(v):
    return V.filter_covered(v.g_depth, v.g_sizes.filter("rank <= 3"), 0.8).select("chrom", "start", "end", "sample_id", "depth")


@query(
    "jn_capture_efficiency",
    """WITH d AS (SELECT sample_id AS name, CAST(sum(depth) AS BIGINT) AS target_bases,
  round(avg(CASE WHEN depth >= 30 THEN 1.0 ELSE 0 END), 6) AS coverage_30x FROM g_depth GROUP BY sample_id),
m AS (SELECT concat('S', CAST(l_linenumber AS VARCHAR)) AS name, CAST(count(*) * 1000 AS BIGINT) AS mapped_bases FROM lineitem GROUP BY l_linenumber)
SELECT d.name, m.mapped_bases, d.target_bases, d.coverage_30x, round(d.target_bases * 1.0 / m.mapped_bases, 6) AS efficiency,
  concat('lib_', d.name) AS lib_id FROM d JOIN m ON d.name = m.name""",
)
def capture_efficiency(v):
    name = F.concat(F.lit("S"), c("l_linenumber").cast("string"))
    mapping = v.lineitem.groupBy(name.alias("name")).agg((F.count("*") * 1000).alias("mapped_bases"))
    names = v.g_depth.select(F.concat(F.lit("lib_"), "sample_id").alias("lib_id"), F.concat(F.lit(" "), "sample_id").alias("name")).distinct()
    return V.capture_efficiency(v.g_depth, mapping, names, [30])


@query("agg_panel_size", """SELECT CAST(sum("end" - start) AS BIGINT) AS panel_bases FROM g_intervals""")
def panel_size(v):
    return V.panel_size(v.g_intervals)


@query(
    "agg_panel_depth",
    """SELECT sample_id, CAST(sum(depth) AS BIGINT) AS mapped_bases, round(sum(depth) * 1.0 / (SELECT sum("end" - start) FROM g_intervals), 6) AS mean_depth
  FROM g_depth GROUP BY sample_id""",
)
def panel_depth(v):
    return V.panel_depth(v.g_intervals, v.g_depth.groupBy("sample_id").agg(F.sum("depth").alias("mapped_bases")))


@query(
    "agg_probes_by_chrom",
    """SELECT s.chrom, round(s.size / 1e6, 6) AS length_mb, count(i.id) AS probes FROM g_sizes s LEFT JOIN g_intervals i
  ON i.chrom = s.chrom GROUP BY s.chrom, s.size""",
)
def probes_by_chrom(v):
    return V.probes_by_chrom(v.g_intervals, v.g_sizes)


@query(
    "flow_coverage_report",
    f"""WITH r AS ({_region('chrom, start, "end"')})
SELECT p.chrom, r.start + p.start AS start, r."end" + p.start AS "end", r.min_cov, r.max_cov, r.mean_cov, r.median_cov,
  r.coverage_10x, r.coverage_30x, r.coverage_50x, r.coverage_100x
FROM r JOIN g_pieces p ON r.chrom = replace(p.part, 'b', '') AND p.part LIKE '%b' """,
)
def coverage_flow(v):
    # depths measured on the second pieces
    pieces = v.g_pieces.filter("part LIKE '%b'")
    on_piece = v.g_depth.withColumn("chrom", F.concat("chrom", F.lit("b")))
    return coverage_report(on_piece, pieces, CUTS)
