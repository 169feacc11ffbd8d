"""Column expressions over DNA strings and bracketed probe sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases covered by each IUPAC code.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT",
    "H": "ACT", "B": "CGT", "V": "ACG", "D": "AGT", "N": "ACGT",
}
_CODES = "".join(IUPAC)
# Fixed value: two alleles in square brackets.
MARKER = r"\[([A-Za-z]+/[A-Za-z]+)\]"


def _count_of(seq: Column, chars: str) -> Column:
    """Number of the given capital letters, in either case."""
    left = F.upper(seq)
    for x in chars:
        left = F.replace(left, F.lit(x), F.lit(""))
    return F.length(seq) - F.length(left)


def gc_count(seq: Column) -> Column:
    return _count_of(seq, "GCS")


def gc_fraction(seq: Column) -> Column:
    """GC share of the unambiguous bases (N and other codes are left out)."""
    gc = gc_count(seq)
    n = gc + _count_of(seq, "ATWU")
    return F.when(n == 0, F.lit(0.0)).otherwise(gc / n)


def n_count(seq: Column) -> Column:
    return _count_of(seq, "N")


def gc_bias(seq: Column) -> Column:
    return F.abs(gc_fraction(seq) - 0.5)


def iupac_bases(code: Column) -> Column:
    """Sorted base string of an IUPAC code; null for an illegal code."""
    table = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    return F.try_element_at(table, F.upper(code))


def parse_marker(seq: Column) -> Column:
    """Struct (ref_seq, offset, ref, alt, right_len) of ``left[REF/ALT]right``.

    ``offset`` counts the bases left of the marker; ``-`` alleles are dropped
    from the reference string.
    """
    pat = r"^([^\[]*)\[([^/\]]*)/([^\]]*)\](.*)$"
    part = lambda i: F.regexp_extract(seq, pat, i)
    ref = F.replace(part(2), F.lit("-"), F.lit(""))
    return F.struct(
        F.concat(part(1), ref, part(4)).alias("ref_seq"),
        F.length(part(1)).alias("left_len"),
        F.length(part(4)).alias("right_len"),
        part(2).alias("ref"),
        part(3).alias("alt"),
        F.concat_ws("/", part(2), part(3)).alias("alleles"),
    )


def marker_alleles(seq: Column) -> Column:
    """``REF/ALT`` of an ACGT/- marker, ``-/-`` when there is none."""
    pat = r"\[([ACGT\-]+/[ACGT\-]+)\]"
    m = F.regexp_extract(seq, pat, 1)
    return F.when(m == "", "-/-").otherwise(m)


def probe_reference(seq: Column) -> Column:
    """Struct (ref_seq, error) of a probe with exactly one legal marker."""
    n = F.regexp_count(seq, F.lit(MARKER))
    inner = F.regexp_extract(seq, MARKER, 1)
    illegal = F.translate(F.upper(F.replace(inner, F.lit("/"), F.lit(""))), _CODES, "")
    rest = F.translate(F.regexp_replace(seq, MARKER, ""), _CODES, "")
    error = (
        F.when(F.coalesce(F.length(seq), F.lit(0)) == 0, "empty sequence")
        .when(n == 0, "no marker")
        .when(n > 1, "more than one marker")
        .when(illegal != "", "illegal marker base")
        .when(rest != "", "illegal base")
    )
    ref = F.regexp_replace(seq, r"\[([A-Za-z]+)/[A-Za-z]+\]", "$1")
    return F.struct(
        F.when(error.isNull(), ref).alias("ref_seq"), error.alias("error")
    )


def probe_with_marker(seq: Column, pos: Column, probe_start: Column, alleles: Column) -> Column:
    """Replace the base at ``pos`` by ``[alleles]``; bad input is unchanged."""
    off = pos - 1 - probe_start
    ok = alleles.contains("/") & (off >= 0) & (off < F.length(seq))
    out = F.concat(
        F.substr(seq, F.lit(1), off.cast("int")),
        F.lit("["), alleles, F.lit("]"),
        F.substr(seq, (off + 2).cast("int")),
    )
    return F.when(ok, out).otherwise(seq)


def unknown_sequence(length: Column) -> Column:
    """Stand-in for a probe on an absent chromosome."""
    return F.repeat(F.lit("N"), length.cast("int"))


def flank_text(left: Column, ref: Column, alt: Column, right: Column) -> Column:
    """``left[REF/ALT]right``."""
    return F.concat(left, F.lit("["), ref, F.lit("/"), alt, F.lit("]"), right)


def parse_swissprot_header(text: Column) -> Column:
    part = lambda p: F.regexp_extract(text, p, 1)
    return F.struct(
        part(r"OS=(.*?) OX=").alias("species"),
        part(r"OX=(\d+)").alias("taxon_id"),
        part(r"GN=(\S+)").alias("gene"),
    )


def parse_uniref_header(text: Column) -> Column:
    part = lambda p: F.regexp_extract(text, p, 1)
    return F.struct(
        part(r"Tax=(.*?) TaxID=").alias("species"),
        part(r"TaxID=(\d+)").alias("taxon_id"),
        part(r"RepID=(\S+)").alias("rep_id"),
    )


def gtf_attr(attributes: Column, key: str) -> Column:
    """Value of ``key "value"`` in GTF attribute text."""
    return F.regexp_extract(attributes, rf'(?:^|[\s;]){key} "([^"]*)"', 1)


def gff_attrs(attributes: Column) -> Column:
    """GFF ``k=v;k=v`` text as a map."""
    return F.str_to_map(
        F.regexp_replace(attributes, r";\s*$", ""), F.lit("; *"), F.lit("=")
    )
