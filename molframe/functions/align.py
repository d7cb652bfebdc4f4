"""Flags, CIGARs, positions and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x4, 0x8, 0x10, 0x20
FIRST, LAST, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def primary(flag: Column) -> Column:
    return flag.bitwiseAND(F.lit(SECONDARY | SUPPLEMENTARY)) == 0


def cigar(text: Column) -> Column:
    """array<struct<op, len>> of a CIGAR string."""
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0)), lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("len")))


def _sum(ops: Column, *kinds: str) -> Column:
    return F.aggregate(F.filter(ops, lambda o: o["op"].isin(*kinds)), F.lit(0), lambda n, o: n + o["len"])


def reference_length(ops: Column) -> Column:
    return _sum(ops, "M", "D", "N", "=", "X")


def query_length(ops: Column) -> Column:
    return _sum(ops, "M", "I", "S", "=", "X")


def aligned_bases(ops: Column) -> Column:
    return _sum(ops, "M", "I", "=", "X")


def clipped_bases(ops: Column) -> Column:
    return _sum(ops, "S", "H")


def read_position(pos: Column, ops: Column, ref_pos: Column) -> Column:
    """The 0-based place in a read (soft clips included) of the base aligned to a 0-based reference position; -1 where a deletion or skip spans it, null outside the alignment."""
    start = F.struct(F.lit(0).cast("long").alias("query"), pos.cast("long").alias("ref"), F.lit(None).cast("long").alias("found"))

    def step(s: Column, o: Column) -> Column:
        here = (ref_pos >= s["ref"]) & (ref_pos < s["ref"] + o["len"])
        both, ref_only = o["op"].isin("M", "=", "X"), o["op"].isin("D", "N")
        found = F.when(both & here, s["query"] + ref_pos - s["ref"]).when(ref_only & here, F.lit(-1).cast("long"))
        return F.struct((s["query"] + F.when(both | o["op"].isin("I", "S"), o["len"]).otherwise(0)).alias("query"), (s["ref"] + F.when(both | ref_only, o["len"]).otherwise(0)).alias("ref"), F.coalesce(s["found"], found).alias("found"))

    return F.aggregate(ops, start, step)["found"]


def leading_clip(ops: Column) -> Column:
    """Soft and hard clipped bases before the first other operator."""
    state = F.aggregate(ops, F.struct(F.lit(0).alias("n"), F.lit(False).alias("past")), lambda s, o: F.struct((s["n"] + F.when(~s["past"] & o["op"].isin("S", "H"), o["len"]).otherwise(0)).alias("n"), (s["past"] | ~o["op"].isin("S", "H")).alias("past")))
    return state["n"]


def trailing_clip(ops: Column) -> Column:
    return leading_clip(F.reverse(ops))


def five_prime(pos: Column, ops: Column, reverse: Column) -> Column:
    """The unclipped 5' position (0-based pos): before leading clips on the forward strand, after trailing clips on the reverse."""
    return F.when(reverse, pos + reference_length(ops) - 1 + trailing_clip(ops)).otherwise(pos - leading_clip(ops))


def pair_orientation(tid: Column, pos: Column, end: Column, reverse: Column, mate_tid: Column, mate_pos: Column, mate_end: Column, mate_reverse: Column) -> Column:
    """FR, RF or TANDEM of a pair on one reference (null else): FR if the forward read's 5' end is not behind the reverse read's."""
    forward5 = F.when(reverse, mate_pos).otherwise(pos)
    reverse5 = F.when(reverse, end).otherwise(mate_end)
    return F.when(tid != mate_tid, None).when(reverse == mate_reverse, "TANDEM").when(forward5 <= reverse5, "FR").otherwise("RF")


def plain_name(name: Column) -> Column:
    """A read name without comment and /1 or /2."""
    return F.regexp_replace(F.regexp_replace(name, r"\s.*$", ""), "/[12]$", "")


def natural_key(name: Column) -> Column:
    """Sorts as names whose digit runs compare as numbers: each run, without leading zeros, is prefixed by its length; names alike but for zeros sort by length."""
    parts = F.transform(F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(F.regexp_replace(p, "^0+", "")).cast("string"), 4, "0"), F.regexp_replace(p, "^0+", ""), F.lit("\x01"))).otherwise(p))
    return F.concat(F.array_join(parts, ""), F.lit("\x00"), F.lpad(F.length(name).cast("string"), 6, "0"))


def flag_order(flag: Column) -> Column:
    """Order of a name's records: neither, first, last, both of first and last; of each primary before supplementary before secondary."""
    return (F.when(has(flag, LAST), 2).otherwise(0) + F.when(has(flag, FIRST), 1).otherwise(0)) * 4 + F.when(has(flag, SECONDARY), 2).otherwise(0) + F.when(has(flag, SUPPLEMENTARY), 1).otherwise(0)


def umi_of_name(name: Column) -> Column:
    """The last colon field of a name of eight or more: segments split at +, r-prefixed ones reverse-complemented, joined by -, upper case; an error for other letters."""
    from molframe.functions.dna import reverse_complement

    fields = F.split(name, ":")
    parts = F.transform(F.split(F.element_at(fields, -1), r"\+"), lambda p: F.when(F.startswith(p, F.lit("r")), reverse_complement(F.substring(p, F.lit(2), F.length(p)))).otherwise(p))
    umi = F.upper(F.array_join(parts, "-"))
    return F.when(F.size(fields) >= 8, F.when(umi.rlike("^[ACGTN-]*$"), umi).otherwise(F.raise_error(F.concat(F.lit("no UMI in read name "), name))))
