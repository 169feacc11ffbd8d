"""Genomics-shaped views over the driver tables.

The operators are generic; these views only give them data that grows with the
tables.  Each text runs in Spark and, with plain table names, in DuckDB.
``{name}`` stands for a driver table or another view; ``/*g*/`` for the flag that
DuckDB needs to replace every match.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # variant sites: SNP, INS and DEL
    "g_sites": """
        SELECT concat('chr', CAST(o_custkey % 5 + 1 AS STRING)) AS chrom, o_orderkey * 37 + 1 AS pos,
          concat('chr', CAST(o_custkey % 5 + 1 AS STRING), '_', CAST(o_orderkey * 37 + 1 AS STRING)) AS id,
          CASE WHEN o_orderkey % 11 = 0 THEN concat(substr('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1), 'TG')
               ELSE substr('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1) END AS ref,
          CASE WHEN o_orderkey % 13 = 0 THEN concat(substr('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1), 'CA')
               WHEN o_orderkey % 11 = 0 THEN substr('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1)
               ELSE substr('ACGT', CAST((o_orderkey + 1 + o_custkey % 3) % 4 + 1 AS INT), 1) END AS alt,
          o_orderkey AS site_no FROM {orders}""",
    # long genotype calls
    "g_calls": """
        SELECT s.chrom, s.pos, s.id, s.ref, s.alt, concat('S', CAST(c.l_linenumber AS STRING)) AS sample_id,
          CASE WHEN c.k < 4 THEN '0/0' WHEN c.k < 7 THEN '0/1' WHEN c.k < 9 THEN '1/1' ELSE './.' END AS gt,
          c.ref_depth, c.alt_depth
        FROM (SELECT l_orderkey, l_linenumber, sum(l_partkey) % 10 AS k,
                CAST(min(l_quantity) AS BIGINT) AS ref_depth, min(l_suppkey) AS alt_depth
              FROM {lineitem} GROUP BY l_orderkey, l_linenumber) c
        JOIN {g_sites} s ON s.site_no = c.l_orderkey""",
    # statistic track
    "g_track": """
        SELECT concat('chr', CAST(user_id % 5 + 1 AS STRING)) AS chrom, event_id * 1000 + 1 AS pos,
          value AS stat, event_type AS feature, value * 0.5 + 20 AS ci FROM {events}""",
    "g_intervals": """
        SELECT concat('chr', CAST(p_partkey % 5 + 1 AS STRING)) AS chrom, p_partkey * 250 AS start,
          p_partkey * 250 + p_size * 40 AS "end", concat('iv', CAST(p_partkey AS STRING)) AS id, p_size
        FROM {part}""",
    "g_gene_term": """
        SELECT DISTINCT concat('G', CAST(l_partkey AS STRING)) AS gene,
          concat('T', CAST(l_suppkey % 50 AS STRING)) AS term FROM {lineitem}""",
    "g_seq": """
        SELECT doc_id AS seq_id, source, lang,
          translate(regexp_replace(lower(text), '[^a-z]+', ''/*g*/),
            'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM {documents}""",
    # every contig is one document
    "g_contigs": """
        SELECT concat('ctg', CAST(seq_id AS STRING)) AS chrom, seq, CAST(length(seq) AS BIGINT) AS size
        FROM {g_seq} WHERE length(seq) > 0""",
    # pieces of 901 bases; a site is at the first base of each piece and at the contig's last base
    "g_ctg_pieces": """
        SELECT chrom, size, CAST(k AS BIGINT) * 901 + 1 AS first, piece FROM {PIECES} x""",
    # the seventh allele differs from the genome, the fifth is an insertion
    "g_ctg_sites": """
        SELECT chrom, pos, concat(chrom, '_', CAST(pos AS STRING)) AS id,
          CASE WHEN pos % 7 = 0 THEN 'T' ELSE base END AS ref,
          CASE WHEN pos % 5 = 0 THEN concat(base, 'AC') WHEN base = 'A' THEN 'G' ELSE 'A' END AS alt
        FROM (SELECT chrom, CASE tail WHEN 0 THEN first ELSE size END AS pos, CASE tail WHEN 0 THEN substr(piece, 1, 1) ELSE right(piece, 1) END AS base
              FROM (SELECT chrom, size, first, piece, {BOTH} AS tail FROM {g_ctg_pieces}) a
              WHERE tail = 0 OR (length(piece) > 1 AND first + length(piece) - 1 = size)) b""",
    "g_sizes": """
        SELECT chrom, max(pos) + 1000 AS size, CAST(substr(chrom, 4) AS INT) AS rank
        FROM {g_sites} GROUP BY chrom""",
    "g_db": """
        SELECT chrom, pos, ref AS refer, alt,
          CASE pos % 11 WHEN 0 THEN 'stop_gained' WHEN 1 THEN 'stop_lost&splice_region_variant'
            WHEN 2 THEN 'missense_variant' WHEN 3 THEN 'missense_variant&splice_region_variant'
            WHEN 4 THEN 'synonymous_variant' WHEN 5 THEN 'frameshift_variant'
            WHEN 6 THEN 'upstream_gene_variant' WHEN 7 THEN 'intergenic_region'
            WHEN 8 THEN 'splice_donor_variant&intron_variant' WHEN 9 THEN '3_prime_UTR_variant'
            ELSE 'start_lost' END AS type,
          CASE WHEN pos % 11 IN (0, 1, 5, 8) THEN 'HIGH' WHEN pos % 11 IN (2, 3) THEN 'MODERATE'
            WHEN pos % 11 = 4 THEN 'LOW' ELSE 'MODIFIER' END AS impact,
          concat('G', CAST(pos % 500 AS STRING)) AS gene,
          CASE WHEN pos % 11 <= 5 THEN pos % 300 END AS protein_pos,
          sample_id, gt AS genotype, ref_depth, alt_depth
        FROM {g_calls} WHERE gt <> '0/0' AND gt <> './.'""",
    "g_genes": """
        SELECT concat('G', substr(id, 3)) AS gene_id, chrom, start, "end" FROM {g_intervals} WHERE p_size < 25""",
    "g_depth": """
        SELECT chrom, pos, pos - 1 AS start, pos + 99 AS "end", sample_id, ref_depth + alt_depth AS depth
        FROM {g_calls}""",
    "g_hits": """
        SELECT concat('H', CAST(l_orderkey AS STRING)) AS id, concat('chr', CAST(l_suppkey % 5 + 1 AS STRING)) AS chrom,
          85 + l_extendedprice % 15 AS identity, CAST(l_quantity AS INT) + 80 AS match_len,
          CAST(round(l_discount * 100) AS INT) AS mismatch, l_linenumber AS gapopen,
          l_partkey * 100 AS start, l_partkey * 100 + CAST(l_quantity AS BIGINT) + 80 AS "end"
        FROM {lineitem}""",
    "g_assoc": """
        SELECT chrom, pos, id, CAST(site_no % 1000 + 1 AS DOUBLE) * (site_no % 7 + 1) / 1e8 AS p_wald,
          CAST(site_no % 777 + 1 AS DOUBLE) * (site_no % 5 + 1) / 1e8 AS p_lrt,
          CAST(site_no % 555 + 1 AS DOUBLE) * (site_no % 3 + 1) / 1e8 AS p_score
        FROM {g_sites}""",
    # groups of the seven samples, as pedigrees and pairs
    "g_pairs": """
        SELECT DISTINCT concat('S', CAST(a AS STRING)) AS sample_a, concat('S', CAST(b AS STRING)) AS sample_b
        FROM (SELECT l_linenumber AS a, l_linenumber % 7 + 1 AS b FROM {lineitem}) x""",
    "g_trios": """
        SELECT DISTINCT concat('S', CAST(a AS STRING)) AS father, concat('S', CAST(a % 7 + 1 AS STRING)) AS mother,
          concat('S', CAST((a + 1) % 7 + 1 AS STRING)) AS child
        FROM (SELECT l_linenumber AS a FROM {lineitem}) x""",
    # piece table: every chromosome cut at half its length
    "g_pieces": """
        SELECT chrom, CAST(0 AS BIGINT) AS start, {HALF} AS "end", concat(chrom, 'a') AS part FROM {g_sizes}
        UNION ALL SELECT chrom, {HALF}, size, concat(chrom, 'b') FROM {g_sizes}""",
    # expression values: events of a user as samples of a gene
    "g_expr": """
        SELECT concat('G', CAST(user_id AS STRING)) AS gene, concat('E', CAST(event_id AS STRING)) AS sample_name,
          value FROM {events}""",
    # differential table: a contrast per ship mode stand-in
    "g_diff": """
        SELECT concat('C', CAST(p_size % 3 AS STRING)) AS contrast, concat('G', CAST(p_partkey AS STRING)) AS gene,
          (p_size - 25) / 8.0E0 AS logfc, CAST(p_partkey % 100 AS DOUBLE) / 1000 AS fdr,
          CAST(p_partkey % 50 AS DOUBLE) / 1000 AS pvalue FROM {part}""",
    # library sheet and files
    "g_sheet": """
        SELECT DISTINCT concat('L', CAST(conv_id AS STRING)) AS libid, concat('P', CAST(conv_id % 40 AS STRING)) AS sample_id,
          concat('d', CAST(conv_id % 3 AS STRING)) AS dir_name, CAST(conv_id % 9 AS DOUBLE) / 300 AS data_size
        FROM {conversations}""",
    "g_files": """
        SELECT DISTINCT concat('L', CAST(conv_id AS STRING)) AS libid, CASE WHEN turn % 2 = 0 THEN 'R1' ELSE 'R2' END AS read_type,
          concat('/data/Sample_L', CAST(conv_id AS STRING), '/t', CAST(turn AS STRING),
            CASE WHEN turn % 2 = 0 THEN '_R1.fastq.gz' ELSE '_R2.fastq.gz' END) AS path
        FROM {conversations} WHERE conv_id % 7 <> 0""",
    # probe candidates at the sites
    "g_candidates": """
        SELECT chrom, pos, id, concat(ref, ',', alt) AS alleles, CAST(site_no % 60 AS DOUBLE) / 60 AS gc,
          site_no % 4 AS score, site_no % 3 AS match_0, site_no % 2 + 1 AS match_60, CAST(1 AS BIGINT) AS match_100,
          CAST(site_no % 50 AS DOUBLE) / 100 AS maf FROM {g_sites}""",
    "g_probes": """
        SELECT id, chrom, start, start + 120 AS "end" FROM {g_intervals}""",
}

# forms that differ between the engines
_SPARK = {
    "{PIECES}": "(SELECT chrom, size, posexplode(regexp_extract_all(seq, '.{{1,901}}', 0)) AS (k, piece) FROM {g_contigs})",
    "{BOTH}": "explode(array(0, 1))",
    "{HALF}": "size div 2", "/*g*/": "",
}
_DUCK = {
    "{PIECES}": "(SELECT chrom, size, unnest(range(len(p))) AS k, unnest(p) AS piece FROM (SELECT chrom, size, regexp_extract_all(seq, '.{1,901}') AS p FROM {g_contigs}) c)",
    "{BOTH}": "unnest([0, 1])", "{HALF}": "size // 2", "/*g*/": ", 'g'",
}
_NAME = re.compile(r"\{([a-z]\w*)\}")


def _swap(text: str, table: dict[str, str]) -> str:
    for k, v in table.items():
        text = text.replace(k, v)
    return text


class Views:
    """Lazily built DataFrames: ``v.g_calls`` or a driver table ``v.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                text = _swap(VIEWS[name], _SPARK).replace('"end"', "`end`")
                needs = {n: getattr(self, n) for n in set(_NAME.findall(text))}
                self._made[name] = self.spark.sql(text, **needs)
            else:
                raise AttributeError(name)
        return self._made[name]


def duck_sql(body: str) -> str:
    """DuckDB text of a query with the views it names as leading CTEs."""
    needed: list[str] = []

    def need(text: str) -> None:
        for n in re.findall(r"\bg_\w+\b", text):
            if n in VIEWS and n not in needed:
                need(_swap(VIEWS[n], _DUCK))
                if n not in needed:
                    needed.append(n)

    need(body)
    ctes = [f"{n} AS ({_NAME.sub(lambda m: m.group(1), _swap(VIEWS[n], _DUCK)).strip()})" for n in needed]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        ctes.append(body[5:])
        return "WITH " + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
