"""Column expressions over variant alleles, effects and site statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complement of each base.
BASES, COMPLEMENT = "ACGT", "TGCA"

# Rank of each predicted impact.
IMPACT_RANKS = {"HIGH": 0, "MODERATE": 1, "LOW": 2, "MODIFIER": 3}


def _tail(c: Column) -> Column:
    return F.substr(c, F.lit(2))


def allele_shorthand(ref: Column, alt: Column, prefix: bool = False) -> Column:
    """``del…`` / ``ins…`` without the anchor base, or the alternate base.

    ``prefix`` strips the whole shorter allele where it leads the longer one,
    instead of one base.
    """
    lr, la = F.length(ref), F.length(alt)

    def tail(longer: Column, shorter: Column) -> Column:
        if not prefix:
            return _tail(longer)
        rest = F.substr(longer, F.length(shorter) + 1)
        return F.when(F.startswith(longer, shorter), rest).otherwise(longer)

    return (
        F.when(alt == "*", F.concat(F.lit("del"), ref))
        .when(lr > la, F.concat(F.lit("del"), tail(ref, alt)))
        .when(lr < la, F.concat(F.lit("ins"), tail(alt, ref)))
        .when(lr > 1, F.substring(alt, 1, 1))
        .otherwise(alt)
    )


def alleles_shorthand(ref: Column, alts: Column) -> Column:
    """Shorthand of a comma list of alternates; one alternate skips the list."""
    many = F.array_join(
        F.transform(F.split(alts, ","), lambda a: allele_shorthand(ref, a)), ","
    )
    return F.when(alts.contains(","), many).otherwise(allele_shorthand(ref, alts))


def _kind(short: Column) -> Column:
    return F.when(short.contains("ins"), "INS").when(short.contains("del"), "DEL").otherwise("SNP")


def variant_class(alts: Column) -> Column:
    """SNP / INS / DEL / MIXED from a comma list of shorthands."""
    kinds = F.array_distinct(F.transform(F.split(alts, ","), _kind))
    many = F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise("MIXED")
    return F.when(alts.contains(","), many).otherwise(_kind(alts))


def snp_ins_del(ref: Column, alt: Column) -> Column:
    """snp / ins / del by allele length."""
    lr, la = F.length(ref), F.length(alt)
    return F.when(lr == la, "snp").when(lr > la, "del").otherwise("ins")


def _clean(alleles: Column) -> Column:
    return F.regexp_replace(alleles, "-|del", "")


def _bad_alleles(alleles: Column) -> Column:
    c = _clean(alleles)
    return (c == "/") | (F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit(""))) != 1)


def _ref_and_alts(alleles: Column) -> tuple[Column, Column]:
    c = _clean(alleles)
    return (
        F.split_part(c, F.lit("/"), F.lit(1)),
        F.split(F.split_part(c, F.lit("/"), F.lit(2)), ","),
    )


def base_differences(a: Column, b: Column) -> Column:
    """Positions that differ over the shared length, case-insensitive."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc
        + (F.upper(F.substr(a, i, F.lit(1))) != F.upper(F.substr(b, i, F.lit(1)))).cast("int"),
    )


def hamming(a: Column, b: Column, strict: bool = True) -> Column:
    """Mismatches of two equal-length sequences, case-insensitive.

    Unequal lengths raise, or give null when ``strict`` is off.
    """
    bad = F.raise_error("sequences differ in length").cast("int") if strict else F.lit(None)
    return F.when(F.length(a) == 0, 0).when(
        F.length(a) == F.length(b), base_differences(a, b)
    ).otherwise(bad)


def variant_class_len(alleles: Column, strict: bool = True) -> Column:
    """SNP / MNP / DEL / INS / UNKNOWN of a ``REF/ALT,ALT`` string."""
    ref, alts = _ref_and_alts(alleles)
    lr = F.length(ref)
    worst = F.array_max(F.transform(alts, lambda a: base_differences(ref, a)))
    bad = (
        F.raise_error(F.concat(F.lit("malformed alleles "), alleles)).cast("string")
        if strict
        else F.lit(None).cast("string")
    )
    return (
        F.when(alleles == "-/-", "UNKNOWN")
        .when(_bad_alleles(alleles), bad)
        .when(F.exists(alts, lambda a: F.length(a) < lr), "DEL")
        .when(F.exists(alts, lambda a: F.length(a) > lr), "INS")
        .when((lr == 1) | (worst == 1), "SNP")
        .otherwise("MNP")
    )


def indel_length(ref: Column, alts: Column) -> Column:
    """Largest length difference between the reference and an alternate."""
    return F.array_max(
        F.transform(F.split(alts, ","), lambda a: F.abs(F.length(ref) - F.length(a)))
    )


def indel_right_pos(pos: Column, length: Column, cls: Column) -> Column:
    """Right edge of a deletion; other classes keep the position."""
    return F.when(cls.isin("DEL", "MIXED"), pos + length).otherwise(pos)


def ref_right_pos(pos: Column, ref: Column) -> Column:
    """Last reference base covered by a site."""
    return pos + F.length(ref) - 1


def strand_change(ref: Column, alt: Column) -> Column:
    """Strand-collapsed change such as ``C:G>T:A`` (pyrimidine first)."""
    rc = F.translate(ref, BASES, COMPLEMENT)
    ac = F.translate(alt, BASES, COMPLEMENT)
    join = lambda a, b, c, d: F.concat(a, F.lit(":"), b, F.lit(">"), c, F.lit(":"), d)
    return F.when(ref.isin("C", "T"), join(ref, rc, alt, ac)).otherwise(join(rc, ref, ac, alt))


def is_ems(ref: Column, alt: Column) -> Column:
    return F.concat(ref, alt).isin("GA", "CT")


def ems_change(ref: Column, alt: Column) -> Column:
    c = F.concat(ref, F.lit("-"), alt)
    return F.when(c.isin("C-T", "G-A"), c).otherwise("other")


def first_effect(effect: Column) -> Column:
    """First of an ``&`` list, with stop and splice kinds merged."""
    e = F.split_part(effect, F.lit("&"), F.lit(1))
    return (
        F.when(e.isin("stop_gained", "stop_lost"), "stop_gained/lost")
        .when(e.contains("splice_"), "splice_site_variant")
        .otherwise(e)
    )


def protein_change(hgvs_p: Column) -> Column:
    """synonymous / non-synonymous / other from an HGVS.p string."""
    res = F.split(F.split_part(hgvs_p, F.lit("."), F.lit(2)), "[0-9]+")
    same = (F.size(res) == 2) & (F.element_at(res, 1) == F.element_at(res, -1))
    return (
        F.when(hgvs_p.isNull() | (hgvs_p == ""), "other")
        .when(hgvs_p.contains("*") | hgvs_p.contains("?"), "non-synonymous")
        .when(same, "synonymous")
        .otherwise("non-synonymous")
    )


def impact_rank(impact: Column) -> Column:
    out = None
    for name, rank in IMPACT_RANKS.items():
        out = F.when(impact == name, rank) if out is None else out.when(impact == name, rank)
    return out


def pic(p: Column) -> Column:
    """Polymorphism information content of a two-allele locus."""
    q = 1 - p
    return 1 - (p * p + q * q) - 2 * (p * p) * (q * q)


def shannon(p: Column, q: Column) -> Column:
    """Shannon index; a fixed locus gives 0."""
    return F.when((p == 0) | (q == 0), F.lit(0.0)).otherwise(-(p * F.ln(p) + q * F.ln(q)))


def he(p: Column) -> Column:
    """Expected heterozygosity."""
    return 1 - p * p - (1 - p) * (1 - p)


def fold_maf(f: Column) -> Column:
    return F.when(f <= 0.5, f).otherwise(1 - f)


def site_id(chrom: Column, pos: Column) -> Column:
    return F.concat(chrom, F.lit("_"), pos.cast("string"))


def split_site_id(sid: Column) -> tuple[Column, Column]:
    """(chrom, pos) of a ``chrom_pos`` id; the chromosome may contain ``_``."""
    pat = "^(.*)_([0-9]+)$"
    return F.regexp_extract(sid, pat, 1), F.regexp_extract(sid, pat, 2).try_cast("bigint")


def parse_accession(text: Column) -> Column:
    """``sample=a/b;ref,alt`` to a struct; a missing genotype has zero depths.

    Every part is bound to a name once: a filter on the struct's fields would otherwise
    work out the text and its parts anew wherever they occur.
    """
    bound = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    first = lambda x, by: F.substring_index(x, by, 1)
    second = lambda x, one, by: first(F.substr(x, F.length(one) + 2), by)
    number = lambda x: F.coalesce(x.try_cast("int"), F.lit(0))

    def fields(sample: Column, gt: Column, miss: Column, d: Column) -> Column:
        r, a = d["r"], d["a"]
        return F.struct(
            sample.alias("sample_id"), F.when(miss, "./.").otherwise(gt).alias("gt"), r.alias("ref_depth"), a.alias("alt_depth"),
            F.when(r + a == 0, F.lit(0.0)).otherwise(a / (r + a)).alias("af"),
        )

    def depths(sample: Column, info: Column, gt: Column) -> Column:
        texts = bound(second(info, gt, ";"), lambda x: bound(first(x, ","), lambda r: F.struct(r.alias("r"), second(x, r, ",").alias("a"))))
        read = lambda miss: bound(texts, lambda x: F.struct(*[F.when(miss, F.lit(0)).otherwise(number(x[n])).alias(n) for n in "ra"]))
        return bound(gt.contains("."), lambda miss: bound(read(miss), lambda d: fields(sample, gt, miss, d)))

    def parsed(t: Column, sample: Column) -> Column:
        return bound(second(t, sample, "="), lambda info: bound(first(info, ";"), lambda gt: depths(sample, info, gt)))

    return bound(text, lambda t: bound(first(t, "="), lambda sample: parsed(t, sample)))
