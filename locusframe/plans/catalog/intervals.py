"""Interval, run, cluster and split queries."""

from pyspark.sql import functions as F

from ...operators import intervals as I
from ...operators import runs as R
from ..registry import query

c = F.col


def _gene_features(v):
    return v.g_genes.select(c("gene_id").alias("id"), "chrom", "start", "end")


@query(
    "jn_points_in_regions",
    """SELECT t.chrom, t.pos, t.stat, r.id FROM g_track t JOIN g_intervals r
  ON t.chrom = r.chrom AND t.pos BETWEEN r.start AND r."end" """,
)
def points_in_regions(v):
    r = v.g_intervals.select("chrom", "start", "end", "id")
    return I.points_in_regions(v.g_track, r).select("chrom", "pos", "stat", "id")


@query(
    "jn_overlap_join",
    """SELECT a.id AS id_a, b.id AS id_b, a.start AS start_a, b.start AS start_b FROM g_intervals a JOIN g_intervals b
  ON a.chrom = b.chrom AND a.start <= b."end" AND b.start <= a."end" AND a.id < b.id""",
)
def overlap_join(v):
    r = v.g_intervals.select("chrom", "start", "end", "id")
    return I.overlap_join(r, r).filter("id_a < id_b").select("id_a", "id_b", "start_a", "start_b")


@query(
    "jn_count_overlaps",
    """SELECT r.chrom, r.start, r."end", r.id, count(g.gene_id) AS n FROM g_intervals r LEFT JOIN g_genes g
  ON r.chrom = g.chrom AND g.start <= r."end" AND g."end" >= r.start GROUP BY ALL""",
)
def count_overlaps(v):
    return I.count_overlaps(v.g_intervals.select("chrom", "start", "end", "id"), _gene_features(v))


@query(
    "jn_map_overlap",
    """SELECT r.id, r.chrom, r.start, r."end", CAST(coalesce(sum(s.site_no), 0) AS BIGINT) AS mapped FROM g_probes r LEFT JOIN g_sites s
  ON r.chrom = s.chrom AND s.pos > r.start AND s.pos <= r."end" GROUP BY ALL""",
)
def map_overlap(v):
    return I.map_overlap(v.g_probes, v.g_sites, "site_no")


@query(
    "jn_subtract_overlapping",
    """SELECT p.id, p.chrom, p.start, p."end" FROM g_probes p WHERE NOT EXISTS (SELECT 1 FROM g_genes g
  WHERE g.chrom = p.chrom AND p.start < g."end" AND g.start < p."end" AND g.start < g."end")""",
)
def subtract_overlapping(v):
    return I.subtract_overlapping(v.g_probes, v.g_genes, "id")


@query(
    "win_merge_intervals",
    """WITH a AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g_intervals),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT chrom, min(start) AS start, max("end") AS "end" FROM b GROUP BY chrom, run""",
)
def merge_intervals(v):
    return I.merge_intervals(v.g_intervals, width=20_000)


@query(
    "win_segment_overlaps",
    """WITH p AS (SELECT chrom, start AS x FROM g_intervals UNION SELECT chrom, "end" FROM g_intervals),
s AS (SELECT chrom, x AS start, lead(x) OVER (PARTITION BY chrom ORDER BY x) AS stop FROM p)
SELECT s.chrom, s.start, s.stop AS "end", string_agg(g.id, ',' ORDER BY g.id) AS labels FROM s JOIN g_intervals g
  ON g.chrom = s.chrom AND g.start < s.stop AND s.start < g."end" GROUP BY s.chrom, s.start, s.stop""",
)
def segment_overlaps(v):
    return I.segment_overlaps(v.g_intervals, "id", width=20_000)


@query(
    "jn_split_coords",
    """SELECT p.part AS chrom, i.start - p.start AS start, i."end" - p.start AS "end", i.id FROM g_intervals i JOIN g_pieces p
  ON i.chrom = p.chrom AND i.start >= p.start AND i.start < p."end" """,
)
def split_coords(v):
    return I.split_coords(v.g_intervals, v.g_pieces).select("chrom", "start", "end", "id")


@query(
    "jn_restore_coords",
    """SELECT i.chrom, i.start, i."end", i.id FROM g_intervals i JOIN g_pieces p
  ON i.chrom = p.chrom AND i.start >= p.start AND i.start < p."end" """,
)
def restore_coords(v):
    return I.restore_coords(I.split_coords(v.g_intervals, v.g_pieces), v.g_pieces).select("chrom", "start", "end", "id")


@query(
    "jn_split_features",
    """SELECT p.part AS chrom, greatest(i.start, p.start) - p.start AS start, least(i."end", p."end") - p.start AS "end", i.id
  FROM g_intervals i JOIN g_pieces p ON i.chrom = p.chrom
  WHERE i.start BETWEEN p.start AND p."end" OR (i.start < p.start AND i."end" > p.start)""",
)
def split_features(v):
    return I.split_features(v.g_intervals, v.g_pieces).select("chrom", "start", "end", "id")


@query(
    "jn_split_positions",
    """SELECT p.part AS chrom, s.pos - p.start AS pos, s.id FROM g_sites s JOIN g_pieces p
  ON s.chrom = p.chrom AND s.pos > p.start AND s.pos <= p."end" """,
)
def split_positions(v):
    return I.split_positions(v.g_sites, v.g_pieces).select("chrom", "pos", "id")


@query(
    "agg_make_windows",
    """SELECT chrom, unnest(range(0, size, 1000)) AS start, unnest(range(0, size, 1000)) + 1000 AS "end" FROM g_sizes""",
)
def make_windows(v):
    return I.make_windows(v.g_sizes, 1000)


@query(
    "win_design_sites",
    """WITH x AS (SELECT id, start, start + p_size * 100 AS stop FROM g_intervals)
SELECT id, start AS pos FROM x WHERE stop - start < 500 UNION ALL SELECT id, (start + stop) // 2 FROM x WHERE stop - start < 500
UNION ALL SELECT id, stop FROM x WHERE stop - start < 500
UNION ALL SELECT id, unnest(range(start, stop + 300, 300)) FROM x WHERE stop - start >= 500 AND stop - start < 3000
UNION ALL SELECT id, unnest(range(start, stop + 500, 500)) FROM x WHERE stop - start >= 3000""",
)
def design_sites(v):
    wide = v.g_intervals.withColumn("end", c("start") + (c("p_size") * 100))
    return I.design_sites(wide).select("id", "pos")


@query(
    "win_split_bed",
    """WITH a AS (SELECT *, coalesce(sum("end" - start) OVER (ORDER BY chrom, start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum("end" - start) OVER () AS total FROM g_intervals)
SELECT id, CAST(least(7, CAST(floor(before * 8 / total) AS INT)) AS INT) AS part FROM a""",
)
def split_bed(v):
    return I.split_bed(v.g_intervals, 8, width=20_000).select("id", "part")


@query(
    "win_split_genome",
    """WITH g AS (SELECT *, coalesce(sum(size) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, sum(size) OVER () AS total FROM g_sizes),
t AS (SELECT *, CAST(greatest(1, ceil(total / 60.0)) AS BIGINT) AS tile FROM g),
w AS (SELECT chrom, size, off, total, tile, unnest(range(0, size, tile)) AS start FROM t)
SELECT chrom, CAST(least(5, CAST(floor((off + start) / (total / 6.0)) AS INT)) AS INT) AS part, min(start) AS start, max(least(start + tile, size)) AS "end" FROM w GROUP BY chrom, 2""",
)
def split_genome(v):
    return I.split_genome(v.g_sizes, 6)


def _points(v):
    repeats = v.g_intervals.filter("p_size >= 25").withColumn("repeat_size", c("end") - c("start"))
    # the band of a chromosome under twice the limit
    return I.split_points(v.g_sizes, repeats, v.g_genes, max_len=400_000, min_repeat=100)


SPLIT_POINTS = """
r AS (SELECT id, chrom, start, "end", "end" - start AS repeat_size FROM g_intervals WHERE p_size >= 25),
free AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM g_genes g WHERE g.chrom = r.chrom AND r.start < g."end" AND g.start < r."end" AND g.start < g."end")),
z AS (SELECT *, greatest(0.3, 1 - 400000.0 / size) * size AS lo FROM g_sizes),
b AS (SELECT f.*, row_number() OVER (PARTITION BY f.chrom ORDER BY repeat_size DESC, f.start) AS k FROM free f JOIN z ON f.chrom = z.chrom
  WHERE z.size >= 400000 AND f.start >= lo AND f."end" <= size - lo AND repeat_size >= 100),
pts AS (SELECT s.chrom, s.size, s.rank, s.size >= 400000 AS is_long, (b.start + b."end") // 2 AS cut, b.id AS repeat_id
  FROM g_sizes s LEFT JOIN b ON s.chrom = b.chrom AND b.k = 1)
"""


@query("win_split_points", "WITH " + SPLIT_POINTS + "SELECT * FROM pts")
def split_points(v):
    return _points(v)


@query(
    "win_split_pieces",
    "WITH " + SPLIT_POINTS + """SELECT chrom, CAST(0 AS BIGINT) AS start, CASE WHEN is_long THEN cut ELSE size END AS "end",
  CASE WHEN is_long THEN concat(chrom, 'a') ELSE chrom END AS part FROM pts
UNION ALL SELECT chrom, cut, size, concat(chrom, 'b') FROM pts WHERE is_long""",
)
def split_pieces(v):
    return I.split_pieces(_points(v))


# --- runs --------------------------------------------------------------------

REGIONS = """
a AS (SELECT chrom, pos, stat >= 40 AS hit, lag(stat >= 40) OVER w AS phit, lag(pos) OVER w AS ppos FROM g_track
      WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
b AS (SELECT *, sum(CASE WHEN hit AND (phit IS NULL OR NOT phit OR pos - ppos > 20000) THEN 1 ELSE 0 END)
        OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM a),
r AS (SELECT chrom, min(pos) AS start, max(pos) AS "end", max(pos) - min(pos) + 1 AS length, count(*) AS no_snps
      FROM b WHERE hit GROUP BY chrom, run HAVING count(*) >= 2)
"""


def regions(v):
    return R.threshold_regions(v.g_track, 40, min_snps=2, min_length=1000, max_gap=20_000, width=200_000)


@query("win_threshold_regions", "WITH " + REGIONS + "SELECT * FROM r")
def threshold_regions(v):
    return regions(v)


@query(
    "flow_bsa_regions",
    "WITH " + REGIONS + """SELECT r.chrom, r.start, r."end", r.length, r.no_snps, count(g.gene_id) AS gene_count FROM r
  LEFT JOIN g_genes g ON g.chrom = r.chrom AND g.start <= r."end" AND g."end" >= r.start GROUP BY ALL""",
)
def bsa_regions(v):
    from ..flows import bsa_regions as flow

    return flow(v.g_track, v.g_genes, 40, min_snps=2, min_length=1000, max_gap=20_000, width=200_000)


def _cluster(k: int, w: int) -> str:
    lags = " OR ".join(
        f"(lead(pos, {k - 1 - i}) OVER w - lag(pos, {i}) OVER w <= {w})" if i else f"(lead(pos, {k - 1}) OVER w - pos <= {w})"
        for i in range(k)
    ).replace(f"lead(pos, 0) OVER w", "pos")
    return f"""SELECT chrom, pos, id FROM (SELECT chrom, pos, id, coalesce({lags}, FALSE) AS hit FROM g_sites
  WINDOW w AS (PARTITION BY chrom ORDER BY pos)) x WHERE NOT hit"""


@query("win_filter_clusters", _cluster(4, 400))
def filter_clusters(v):
    return R.filter_clusters(v.g_sites, 400, 4, width=50_000).select("chrom", "pos", "id")


@query("win_filter_clusters_vcf", _cluster(3, 150))
def filter_clusters_vcf(v):
    # two more sites within the window, as the line filter counts
    return R.filter_clusters(v.g_sites, 150, 2 + 1, width=50_000).select("chrom", "pos", "id")


@query(
    "win_thin_by_distance",
    """WITH a AS (SELECT *, CASE WHEN lag(pos) OVER w IS NULL OR pos - lag(pos) OVER w >= 100 THEN 1 ELSE 0 END AS brk FROM g_candidates
  WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
b AS (SELECT *, sum(brk) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM a),
d AS (SELECT *, row_number() OVER (PARTITION BY chrom, run ORDER BY maf DESC, id) AS k FROM b)
SELECT chrom, pos, id, round(maf, 6) AS maf FROM d WHERE k = 1""",
)
def thin_by_distance(v):
    return R.thin_by_distance(v.g_candidates, 100, "maf", width=50_000).select("chrom", "pos", "id", "maf")
