"""Column functions on bases, UMIs, qualities and site keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Header forms of a UMI, tried in this order (fixed values).
UMI_PATTERNS = [r"UMI:([A-Z]+)", r"_([A-Z]{8,12})_", r":([A-Z]{8,12})$"]
BASES = ["A", "C", "G", "T", "N"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def umi_from_header(header: Column | str) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(_c(header), p, 1), F.lit("")) for p in UMI_PATTERNS))


def phred_decode(quality: Column | str) -> Column:
    return F.transform(F.filter(F.split(_c(quality), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def phred_weight(quality: Column | str) -> Column:
    """10 ** (q / 10) with six decimals, so that sums don't depend on their order."""
    return F.pow(F.lit(10.0), _c(quality) / 10.0).cast("decimal(20,6)")


def complement(bases: Column | str) -> Column:
    return F.translate(F.regexp_replace(_c(bases), "[^ACGT]", "N"), "ACGT", "TGCA")


def reverse_complement(bases: Column | str) -> Column:
    return F.reverse(complement(bases))


def purine_centred(context: Column | str) -> Column:
    return F.substring(_c(context), 2, 1).isin("A", "G")


def normal_context(context: Column | str) -> Column:
    """The context of the pyrimidine strand; null unless it has three bases."""
    c = _c(context)
    return F.when(F.length(c) == 3, F.when(purine_centred(c), reverse_complement(c)).otherwise(c))


def normal_base(context: Column | str, base: Column | str) -> Column:
    return F.when(purine_centred(context), complement(base)).otherwise(_c(base))


def mutation_type(ref: Column | str, alt: Column | str) -> Column:
    return F.when(F.concat(_c(ref), _c(alt)).isin("AG", "GA", "CT", "TC"), "transition").otherwise("transversion")


def extract_context(sequence: Column | str, position: Column | str) -> Column:
    """Upper-case 3-mer around a 0-based position; null where it would cross an end."""
    s, p = _c(sequence), _c(position)
    return F.when((p >= 1) & (p < F.length(s) - 1), F.upper(s.substr(p.cast("int"), F.lit(3))))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Mismatches; the larger length for strings of unequal length."""
    x, y = _c(a), _c(b)
    return F.when(F.length(x) != F.length(y), F.greatest(F.length(x), F.length(y))).otherwise(_mismatches(x, y))


def hamming_overlap(a: Column | str, b: Column | str) -> Column:
    """Mismatches on the common length plus the difference of lengths."""
    x, y = _c(a), _c(b)
    n = F.least(F.length(x), F.length(y))
    return _mismatches(x.substr(F.lit(1), n), y.substr(F.lit(1), n)) + F.abs(F.length(x) - F.length(y))


def _mismatches(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: (p != q).cast("int")), F.lit(0), lambda acc, v: acc + v)


def umi_distance(a: Column | str, b: Column | str) -> Column:
    """Hamming for equal lengths, else Levenshtein."""
    x, y = _c(a), _c(b)
    return F.when(F.length(x) == F.length(y), _mismatches(x, y)).otherwise(F.levenshtein(x, y))


def site_key() -> Column:
    return F.concat_ws(":", "chrom", "pos", "ref")


def variant_key() -> Column:
    return F.concat(site_key(), F.lit(">"), F.col("alt"))
