"""Bases and molecular barcodes (UMIs) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(s: Column) -> Column:
    """A, C, G, T (and U, read as T) complemented, other letters kept, in reverse order."""
    return F.translate(F.reverse(s), "ACGTUacgtu", "TGCAAtgcaa")


def packed(umi: Column) -> Column:
    """2 bits a base as a long, for up to 31 bases of ACGT (dashes skipped); null for any other text."""
    plain = F.upper(F.regexp_replace(umi, "-", ""))
    return F.when(plain.rlike("^[ACGT]{1,31}$"), F.conv(F.translate(plain, "ACGT", "0123"), 4, 10).cast("long"))


def packed_distance(x: Column, y: Column) -> Column:
    """Mismatching bases of two packed UMIs of equal length."""
    d = x.bitwiseXOR(y)
    return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def distance(a: Column, b: Column) -> Column:
    """Mismatching characters; null where lengths differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda n, x: n + x))


def has_no_call(umi: Column) -> Column:
    return F.contains(umi, F.lit("N"))


def called_bases(umi: Column) -> Column:
    """Letters ACGT of either case."""
    return F.length(F.regexp_replace(umi, "[^ACGTacgt]", "")).cast("long")


def molecule_base(mi: Column) -> Column:
    """A molecule id without its last /suffix, if something stands before it."""
    return F.regexp_replace(mi, "(?<=.)/[^/]*$", "")


def flipped(umi: Column) -> Column:
    """The halves of a dual UMI exchanged."""
    return F.concat(F.substring_index(umi, "-", -1), F.lit("-"), F.substring_index(umi, "-", 1))


def canonical(umi: Column) -> Column:
    """A dual UMI with its smaller half first."""
    return F.least(umi, flipped(umi))
