"""Scalar expressions of the copy-number model. Rounding is half-even throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the number that stands for "masked" in files.
SENTINEL = 3300


def bin_index(pos: Column, size: int) -> Column:
    return F.floor(pos / F.lit(size)).cast("long")


def is_masked(*states: Column) -> Column:
    """Whether any of the states is the sentinel."""
    out = F.lit(False)
    for s in states:
        out = out | (F.abs(s) == SENTINEL)
    return out


def sentinel_to_null(x: Column) -> Column:
    return F.when(~is_masked(x), x)


def half_even(x: Column, digits: int = 0) -> Column:
    """A double scaled, rounded half to even and scaled back: ties are those of the scaled double (1.995 is one, as 199.5 is exact),
    not those of its shortest decimal."""
    scale = F.lit(10.0**digits)
    return F.rint(x * scale) / scale


def snap(x: Column, centers: list[float], digits: int = 0) -> Column:
    """Coverage to copy number by interpolation between centers of coverage levels 0, 1, 2, ...

    Below the first center 0, above the last one extrapolated with the last spacing; the sentinel passes through
    and negative values count as positive.
    """
    y, n = F.abs(x), len(centers)
    above = F.lit(float(n - 1)) if n < 2 else F.lit(float(n - 1)) + (y - F.lit(centers[-1])) / F.lit(centers[-1] - centers[-2])
    out = half_even(above, digits)
    for i in reversed(range(n - 1)):
        low, high = centers[i], centers[i + 1]
        out = F.when(y.between(low, high), half_even(F.lit(float(i)) + (y - F.lit(low)) / F.lit(high - low), digits)).otherwise(out)
    if n >= 2:
        out = F.when(y < centers[0], F.lit(0.0)).otherwise(out)
    return F.when(is_masked(x), x.cast("double")).otherwise(out)


def center_of(x: Column, centers: list[float]) -> Column:
    """Coverage moved to the nearest center, by the same interpolation and extrapolation."""
    step = centers[-1] - centers[-2] if len(centers) > 1 else 0.0
    cn = snap(x, centers)
    place = F.least(F.abs(cn), F.lit(float(len(centers) - 1))) + 1
    inside = F.element_at(F.array(*(F.lit(float(c)) for c in centers)), place.cast("int"))
    return F.when(is_masked(x), x.cast("double")).when(cn < len(centers), inside).otherwise(F.lit(centers[-1]) + (cn - (len(centers) - 1)) * F.lit(step))


# Cody's rational approximations of the error function (1969), numerators and denominators by falling powers.
ERFC_LOW = (
    (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
ERFC_HIGH = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _horner(x, coefficients):
    out = coefficients[0] * x + coefficients[1]
    for c in coefficients[2:]:
        out = out * x + c
    return out


def erfc(x: Column) -> Column:
    """The complementary error function of numbers of 0 and more, to about 1e-15; no engine has it built in."""
    square = x * x
    low = 1 - x * _horner(square, ERFC_LOW[0]) / _horner(square, ERFC_LOW[1])
    middle = F.exp(-square) * _horner(x, ERFC_MIDDLE[0]) / _horner(x, ERFC_MIDDLE[1])
    inverse = 1 / square
    high = F.exp(-square) * (F.lit(1 / math.sqrt(math.pi)) - inverse * _horner(inverse, ERFC_HIGH[0]) / _horner(inverse, ERFC_HIGH[1])) / x
    return F.when(x <= 0.46875, low).when(x <= 4, middle).otherwise(high)


def two_sided_p(x: Column, center: Column, sigma: float = 10.0) -> Column:
    """Two-sided normal p-value of the distance to a center, 7 digits.

    The distance is bound by a lambda, so that it is computed once and not at each of its many places.
    """
    return F.bround(F.element_at(F.transform(F.array(F.abs((x - center) / sigma) / math.sqrt(2)), erfc), 1), 7)


def normal_parts(purity: Column, ploidy: Column, coverage: Column) -> dict[str, Column]:
    """Shares of the normal and the tumor genome, and the normal coverage in all and per haplotype."""
    normal, tumor = 2 * (1 - purity), ploidy * purity
    return {"normal_share": normal / (normal + tumor), "tumor_share": tumor / (normal + tumor), "normal_coverage": coverage * normal / (normal + tumor), "per_haplotype": coverage * normal / ((normal + tumor) * 2)}


def dna_purity(tumor_coverage: Column, normal_coverage: Column) -> Column:
    return (tumor_coverage - normal_coverage) / tumor_coverage


def cell_purity(alpha: Column, ploidy: Column) -> Column:
    """Cell purity from DNA purity; null where either is out of range."""
    return F.when(alpha.between(0, 1) & (ploidy > 0), 2 * alpha / (ploidy + 2 * alpha - alpha * ploidy))


def parse_vaf(vaf: Column) -> Column:
    """The first number of a comma list; dots and blanks are null."""
    return F.split(vaf, ",").getItem(0).try_cast("double")


def fold_vaf(x: Column) -> Column:
    return F.when(x > 0.5, 1 - x).otherwise(x)


def is_hom(gt: Column) -> Column:
    """Homozygous alternative; everything else counts as heterozygous."""
    return F.coalesce(gt.isin("1/1", "1|1"), F.lit(False))


def allele_depths(gt: Column, ref: Column, alt: Column, counts: dict[str, Column], unphased: bool = False) -> tuple[Column, Column]:
    """Depths of haplotypes 1 and 2 from base counts; 0 for other genotypes and for longer alleles."""

    def depth(base: Column) -> Column:
        out = F.lit(0)
        for letter, n in counts.items():
            out = F.when(base == letter, n).otherwise(out)
        return out

    first = gt.isin("1|0", "1/0") if unphased else gt == "1|0"
    second = gt.isin("0|1", "0/1") if unphased else gt == "0|1"
    one = F.when(first, depth(ref)).when(second, depth(alt)).otherwise(0)
    two = F.when(first, depth(alt)).when(second, depth(ref)).otherwise(0)
    return one, two


def cna_type(cn1: Column, cn2: Column) -> Column:
    a, b = F.bround(cn1), F.bround(cn2)
    return (
        F.when(((a == 0) & (b > 1)) | ((b == 0) & (a > 1)), "CNLOH")
        .when(((a > 1) & (b > 0)) | ((a > 0) & (b > 1)), "GAIN")
        .when((a == 1) & (b == 1), "REF")
        .otherwise("LOSS")
    )


def cna_alt(cn1: Column, cn2: Column) -> Column:
    kind = cna_type(cn1, cn2)
    both = F.when((F.bround(cn1) == 0) & (F.bround(cn2) > 1), "<DEL>,<DUP>").otherwise("<DUP>,<DEL>")
    return F.when(kind == "LOSS", "<DEL>").when(kind == "GAIN", "<DUP>").when(kind == "REF", ".").otherwise(both)


def cna_genotype(cn1: Column, cn2: Column) -> Column:
    a, b = F.bround(cn1), F.bround(cn2)
    return (
        F.when((a == 1) & (b == 1), "0/0").when((a == 1) | (b == 1), "0/1")
        .when(((a > 1) & (b > 1)) | ((a == 0) & (b == 0)), "1/1").otherwise("1/2")
    )


def has_imbalance(a: Column, b: Column, rate: float = 0.3, absolute: float = 10.0) -> Column:
    return F.abs(a - b) > F.least(F.lit(rate) * F.least(a, b), F.lit(absolute))


def mate(alt: Column) -> tuple[Column, Column]:
    """Contig and position of a breakend's mate from its bracket notation."""
    pattern = r"[\[\]]([^\[\]]+):(\d+)[\[\]]"
    return F.regexp_extract(alt, pattern, 1), F.regexp_extract(alt, pattern, 2).try_cast("long")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of products, each rounded to 3 digits, over the sum of weights; 0 without weight. An aggregate."""
    total = F.sum(weight)
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.sum(F.bround(value * weight, 3)) / total)


def median_nonzero(x: Column) -> Column:
    """Median of values other than 0; 0 if there are none. An aggregate."""
    return F.coalesce(F.median(F.when(x != 0, x)), F.lit(0.0))
