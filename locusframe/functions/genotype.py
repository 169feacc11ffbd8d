"""Column expressions over genotype strings (``a/b`` allele indices)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "./."


def _alleles(gt: Column) -> Column:
    return F.split(gt, "/")


def _first(gt: Column) -> Column:
    return F.split_part(gt, F.lit("/"), F.lit(1))


def _second(gt: Column) -> Column:
    return F.split_part(gt, F.lit("/"), F.lit(2))


def gt_norm(gt: Column) -> Column:
    """Unphased form with ordered allele indices; ``.`` becomes ``./.``."""
    g = F.translate(gt, "|", "/")
    a, b = _first(g).try_cast("int"), _second(g).try_cast("int")
    return F.when(g == ".", MISSING).when(a > b, F.concat_ws("/", b, a)).otherwise(g)


def gt_is_missing(gt: Column) -> Column:
    return gt.isNull() | gt.isin(MISSING, ".", ".|.")


def gt_class4(gt: Column) -> Column:
    """REF / HET / ALT / MISS; any unequal pair of alleles is HET."""
    a, b = _first(gt), _second(gt)
    return (
        F.when(gt_is_missing(gt), "MISS")
        .when(a != b, "HET")
        .when(a == "0", "REF")
        .otherwise("ALT")
    )


def gt_class3(gt: Column) -> Column:
    """HOM / HET / MISS."""
    return (
        F.when(gt_is_missing(gt), "MISS")
        .when(_first(gt) == _second(gt), "HOM")
        .otherwise("HET")
    )


def gt_code(gt: Column) -> Column:
    """0 hom-ref, 1 het, 2 hom-alt, 3 unknown."""
    c = gt_class4(gt)
    return (
        F.when(c == "REF", 0).when(c == "HET", 1).when(c == "ALT", 2).otherwise(3)
    ).cast("int")


def gt_from_af(af: Column) -> Column:
    """Genotype implied by the alternate allele fraction."""
    return F.when(af < 0.25, "0/0").when(af < 0.75, "0/1").otherwise("1/1")


def gt_to_seq(
    gt: Column, ref: Column, alts: Column, miss: str = "N", sep: str = ""
) -> Column:
    """Allele indices to bases.

    A homozygous indel is written once and a pair with a multi-base allele is
    joined by ``/``; ``alts`` is the comma list of alternate alleles.
    """

    def base(part: Column) -> Column:
        nth = part.try_cast("int")
        return (
            F.when(part == ".", "N").when(nth == 0, ref)
            .when(nth > 0, F.nullif(F.split_part(alts, F.lit(","), nth), F.lit("")))
        )

    a, b = base(_first(gt)), base(_second(gt))
    same = _first(gt) == _second(gt)
    return (
        F.when(gt_is_missing(gt), miss)
        .when(same & (F.length(a) > 1), a)
        .when(~same & ((F.length(a) > 1) | (F.length(b) > 1)), F.concat(a, F.lit("/"), b))
        .otherwise(F.concat(a, F.lit(sep), b))
    )


def origin(child: Column, p1: Column, p2: Column) -> Column:
    """Which parent a call agrees with: all_same / p1 / p2 / specific."""
    return (
        F.when((child == p1) & (child == p2), "all_same")
        .when(child == p1, "p1")
        .when(child == p2, "p2")
        .otherwise("specific")
    )


def mendel_ok(father: Column, mother: Column, child: Column) -> Column:
    """The child pair takes one allele from each parent (inputs non-missing)."""
    f, m = _alleles(father), _alleles(mother)
    c1, c2 = _first(child), _second(child)
    diploid = (F.size(f) == 2) & (F.size(m) == 2) & (F.size(_alleles(child)) == 2)
    split = (F.array_contains(f, c1) & F.array_contains(m, c2)) | (
        F.array_contains(f, c2) & F.array_contains(m, c1)
    )
    return diploid & split


def array_call(call: Column, ref: Column) -> Column:
    """Two-letter array call to genotype by counting the reference base."""
    n = F.length(call) - F.length(F.replace(call, ref, F.lit("")))
    return (
        F.when(call == "---", MISSING)
        .when(n == 0, "1/1")
        .when(n == 1, "0/1")
        .when(n == 2, "0/0")
    )


def gt_base_pair(gt: Column, ref: Column, alt: Column) -> Column:
    """Genotype to ``A/G`` style bases; missing is ``---``."""
    return (
        F.when(gt == "0/0", F.concat_ws("/", ref, ref))
        .when(gt == "0/1", F.concat_ws("/", ref, alt))
        .when(gt == "1/1", F.concat_ws("/", alt, alt))
        .when(gt == MISSING, "---")
    )


def linkage_code(
    gt: Column,
    p1: Column,
    p2: Column,
    miss: str = "N",
    fmt: str = "ab",
    ref: Column | None = None,
    alt: Column | None = None,
) -> Column:
    """AA / BB / AB by parent match, or base pairs when ``fmt='base'``."""
    if fmt == "ab":
        hit1, hit2, other = F.lit("AA"), F.lit("BB"), F.lit("AB")
    else:
        pair = lambda g: F.when(g == "0/0", F.concat(ref, ref)).otherwise(F.concat(alt, alt))
        hit1, hit2, other = pair(p1), pair(p2), F.concat(ref, alt)
    return (
        F.when(gt == MISSING, miss).when(gt == p1, hit1).when(gt == p2, hit2).otherwise(other)
    )


def phenotype(
    allele1: Column, allele2: Column, pheno1: Column, pheno2: Column, gt_seq: Column
) -> Column:
    """Phenotype of a base-pair call given the two described alleles."""
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))
    indel = allele1.isin("del", "ins") | allele2.isin("del", "ins")
    has_del = (allele1 == "del") | (allele2 == "del")
    first_base = F.substring(gt_seq, 1, 1)
    mixed = F.length(F.replace(gt_seq, first_base, F.lit(""))) > 0
    pick = lambda key: F.when(allele1 == key, cap(pheno1)).when(allele2 == key, cap(pheno2))
    return (
        F.when(gt_seq.contains("N"), "Missing")
        .when(indel & gt_seq.contains("/"), "Heterozygous")
        .when(indel & has_del, pick(F.lit("del")))
        .when(indel, pick(F.lit("ins")))
        .when(mixed, "Heterozygous")
        .otherwise(pick(first_base))
    )


def pheno_alleles_match(allele1: Column, allele2: Column, ref: Column, alt: Column) -> Column:
    """The called alleles are among the described ones (indels by kind)."""
    described = lambda x: (allele1 == x) | (allele2 == x)
    known = lambda x: (x == ".") | described(x)
    # the reference base decides first, then the alternate
    by_kind = lambda x, rest: (
        F.when(x.contains("del"), described(F.lit("del")))
        .when(x.contains("ins"), described(F.lit("ins")))
        .otherwise(rest)
    )
    return by_kind(ref, by_kind(alt, known(ref) & known(alt)))
