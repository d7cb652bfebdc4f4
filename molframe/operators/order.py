"""Sort orders, verification, merging, comparison and interval joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.functions.align import flag_order, natural_key, read_position, reference_length
from molframe.functions.dna import molecule_base
from molframe.session import written

LAST = 2**31 - 1


def sort_keys(order: str) -> list[Column]:
    """Columns that put reads (tid, pos, reverse, qname, flag; template-coordinate also mate_tid, mate_pos, mate_reverse, cell, library, mi) in an order."""
    tid = F.when(F.col("tid") < 0, LAST).otherwise(F.col("tid"))
    if order == "coordinate":
        return [tid, F.col("pos"), F.col("reverse")]
    if order == "queryname-natural":
        return [natural_key(F.col("qname")), flag_order(F.col("flag")), F.col("qname")]
    if order == "queryname":
        return [F.col("qname"), flag_order(F.col("flag"))]
    if order == "template-coordinate":
        own, mate = F.struct(tid.alias("tid"), "pos", "reverse"), F.struct(F.when(F.col("mate_tid") < 0, LAST).otherwise(F.col("mate_tid")).alias("tid"), F.col("mate_pos").alias("pos"), F.col("mate_reverse").alias("reverse"))
        low, high = F.least(own, mate), F.greatest(own, mate)
        return [low["tid"], high["tid"], low["pos"], high["pos"], ~low["reverse"], ~high["reverse"], F.col("cell"), F.col("library"), F.col("mi"), F.col("qname"), own != low]
    raise ValueError(f"no order {order!r}")


def sort_reads(reads: DataFrame, order: str = "template-coordinate") -> DataFrame:
    return reads.orderBy(*sort_keys(order))


def out_of_order(reads: DataFrame, order: str, ordinal: str = "ord", parts: int | None = None) -> DataFrame:
    """Reads whose key is less than that of the read before by `ordinal`. Reads are compared inside ranges of ordinals, each range with the last read of the one before."""
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_keys(order))])
    size = parts or 100_000
    rows = reads.withColumn("key_", key).withColumn("part_", F.floor(F.col(ordinal) / size))
    ends = rows.groupBy("part_").agg(F.max_by("key_", ordinal).alias("last_"))
    ends = ends.select("part_", F.lag("last_").over(Window.orderBy("part_")).alias("end_"))  # a row for each range that has reads
    before = F.lag("key_").over(Window.partitionBy("part_").orderBy(ordinal))
    return rows.withColumn("before_", before).join(ends, "part_", "left").withColumn("before_", F.coalesce("before_", "end_")).filter(F.col("key_") < F.col("before_")).drop("key_", "part_", "before_", "end_")


def merge_reads(inputs: list[DataFrame], order: str = "template-coordinate") -> DataFrame:
    return sort_reads(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs), order)


def compare_content(a: DataFrame, b: DataFrame, keys: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a and b (unique by keys) that are in one alone or differ in a column: (keys, side, columns that differ)."""
    columns = [c for c in a.columns if c not in keys and c not in ignore]
    both = a.withColumn("in_", F.lit(True)).alias("a").join(b.withColumn("in_", F.lit(True)).alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    unlike = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in columns]))
    side = F.when(F.col("b.in_").isNull(), "left").when(F.col("a.in_").isNull(), "right").otherwise("both")
    rows = both.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], side.alias("side"), F.when(side == "both", unlike).otherwise(F.array().cast("array<string>")).alias("columns"))
    return rows.filter((F.col("side") != "both") | (F.size("columns") > 0))


def compare_multisets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often, with the difference in number."""
    counted = a.withColumn("n_", F.lit(1)).unionByName(b.withColumn("n_", F.lit(-1)))
    return counted.groupBy(*a.columns).agg(F.sum("n_").alias("difference")).filter("difference <> 0")


def compare_molecules(a: DataFrame, b: DataFrame, mi: str = "mi", name: str = "qname") -> DataFrame:
    """Molecules, known by their least read name, that differ in their reads or are in one side alone; molecule numbers don't count."""
    def molecules(df: DataFrame, side: str) -> DataFrame:
        # members are compared by a sum of hashes, so that no task gathers a molecule
        return df.groupBy(mi).agg(F.min(name).alias("least"), F.count("*").alias(f"{side}_reads"), F.sum(F.xxhash64(name).cast("decimal(38,0)")).alias(f"{side}_sum")).drop(mi)

    both = molecules(a, "left").join(molecules(b, "right"), "least", "full_outer")
    same = F.col("left_reads").eqNullSafe(F.col("right_reads")) & F.col("left_sum").eqNullSafe(F.col("right_sum"))
    return both.filter(~same).select("least", "left_reads", "right_reads")


def compare_metrics(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(keys, column, left, right) of numbers that differ by more than the tolerance or are missing on one side."""
    columns = [c for c in a.columns if c not in keys]
    long = lambda df, side: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias(side)) for c in columns])).alias("x")).select(*keys, "x.*")
    both = long(a, "left").join(long(b, "right"), [*keys, "column"], "full_outer")
    return both.filter(F.coalesce(F.abs(F.col("left") - F.col("right")) > tolerance, ~F.col("left").eqNullSafe(F.col("right"))))


def overlapping(reads: DataFrame, intervals: DataFrame, width: int = 1024, start: str = "start", end: str = "end") -> DataFrame:
    """reads (tid, start, end; 1-based, inclusive) that overlap an interval (tid, from, to; 0-based, half-open): an equi-join of the distinct places of reads on windows of `width` positions, then the exact test. Equal reads all stay."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    places = reads.select("tid", F.col(start).alias("a_"), F.col(end).alias("b_")).distinct()
    i = intervals.select(F.col("tid").alias("i_tid"), "from", "to", cells(F.col("from"), F.col("to")).alias("i_cell"))
    hit = (F.col("tid") == F.col("i_tid")) & (F.col("cell_") == F.col("i_cell")) & (F.col("a_") <= F.col("to")) & (F.col("from") < F.col("b_"))
    found = places.withColumn("cell_", cells(F.col("a_"), F.col("b_"))).join(i, hit, "left_semi").select(F.col("tid").alias("t_"), "a_", "b_").distinct()
    return reads.join(found, (F.col("tid") == F.col("t_")) & (F.col(start) == F.col("a_")) & (F.col(end) == F.col("b_")), "left_semi")


#: Sites up to which a table of them goes to every task.
FEW_SITES = 100_000


def pileup(reads: DataFrame, variants: DataFrame, seq: str = "seq") -> DataFrame:
    """(variant columns, qname, mi, base) of ungapped reads (tid, pos, seq) at variant sites (tid, site): the site is an equi-join key, as reads are exploded to positions of few bases. Few sites go to the reads, so that no base moves that lies at
    none of them."""
    bases = reads.select("qname", "mi", "tid", F.col("pos").alias("pos_"), F.posexplode(F.split(seq, "")).alias("at", "base"))
    sites = variants.withColumnRenamed("tid", "v_tid")
    if variants.limit(FEW_SITES + 1).count() <= FEW_SITES:
        sites = F.broadcast(sites)
    return bases.join(sites, (F.col("tid") == F.col("v_tid")) & (F.col("pos_") + F.col("at") == F.col("site"))).drop("v_tid", "pos_", "at")


def review(consensus: DataFrame, grouped: DataFrame, variants: DataFrame) -> DataFrame:
    """A row for each consensus base unlike the reference at a variant: the counts of its raw reads' bases (distinct by base and name) at the site."""
    calls = pileup(consensus, variants).filter(F.col("base") != F.col("ref")).select("site", "tid", "ref", "mi", F.col("qname").alias("consensus_read"), F.col("base").alias("consensus_call"))
    calls = written(calls, "calls")  # they are needed twice, and consensuses may be costly
    raw = pileup(grouped, variants).select("site", "tid", "mi", "base", "qname").distinct()
    count = lambda b: F.count_if(F.col("base") == b).alias(f"raw_{b.lower()}")
    counts = raw.join(calls.select("site", "tid", "mi").distinct(), ["site", "tid", "mi"], "left_semi").groupBy("site", "tid", "mi").agg(*[count(b) for b in "ACGTN"])
    return calls.join(counts, ["site", "tid", "mi"], "left")


def minor_allele(af: Column, ad: Column) -> Column:
    """AF where given, else 1 - AD[0] / sum(AD)."""
    return F.coalesce(af, 1 - F.try_divide(F.get(ad, F.lit(0)), F.aggregate(ad, F.lit(0).cast("long"), lambda s, x: s + x)))


def genotype(alleles: Column, phased: Column) -> Column:
    return F.when(phased, F.array_join(alleles, "|")).otherwise(F.array_join(alleles, "/"))


def _with_mate(reads: DataFrame, name: str, taken: list[str]) -> DataFrame:
    """reads with mate_, a struct of the columns `taken` of the other segment of their name (null without one). Reads move once, by name."""
    of = lambda segment: F.max(F.when(F.col("segment") == segment, F.struct(*taken))).over(Window.partitionBy(name))
    own = F.when(F.col("segment") == 1, F.col("mate2_")).when(F.col("segment") == 2, F.col("mate1_"))
    return reads.withColumns({"mate1_": of(1), "mate2_": of(2)}).withColumn("mate_", F.when(F.col(name).isNotNull(), own)).drop("mate1_", "mate2_")


def mate_info(reads: DataFrame, name: str = "qname") -> DataFrame:
    """Primary pairs (segment 1 and 2 of a name) with their mates' place, strand, quality and the template length."""
    mate = lambda c: F.col(f"mate_.{c}")
    out = _with_mate(reads.drop("mate_tid", "mate_pos", "mate_reverse", "mq"), name, ["tid", "pos", "reverse", "mapq", "end"])
    five, mate_five = F.when(F.col("reverse"), F.col("end")).otherwise(F.col("pos")), F.when(mate("reverse"), mate("end")).otherwise(mate("pos"))
    length = F.when(F.col("tid") == mate("tid"), mate_five - five + F.when(mate_five >= five, 1).otherwise(-1)).otherwise(0)
    return out.withColumns({"mate_tid": mate("tid"), "mate_pos": mate("pos"), "mate_reverse": mate("reverse"), "mq": mate("mapq"), "tlen": length}).drop("mate_")


def full_mate_info(reads: DataFrame, name: str = "qname") -> DataFrame:
    """Primary pairs (segment 1 and 2 of a name; tid, pos, end, reverse, mapq, cigar, unmapped) with mate_tid, mate_pos, mate_reverse, mate_unmapped, mq and mc of their mates and tlen. An unmapped read with a mapped mate is placed where the mate
    is; mq and mc of unmapped mates are null; tlen is 0 unless both are mapped to one reference. A read without a mate keeps nulls."""
    taken = ["tid", "pos", "end", "reverse", "mapq", "cigar", "unmapped"]
    both = _with_mate(reads.drop("mate_tid", "mate_pos", "mate_reverse", "mate_unmapped", "mq", "mc", "tlen"), name, taken)
    both = both.withColumns({f"{c}_": F.col(f"mate_.{c}") for c in taken} | {"n_": F.when(F.col("mate_").isNotNull(), F.col(name))}).drop("mate_")
    to_mate, mate_to = F.col("unmapped") & ~F.col("unmapped_"), ~F.col("unmapped") & F.col("unmapped_")
    five = lambda end, pos, reverse: F.when(F.col(reverse), F.col(end)).otherwise(F.col(pos))
    one, two = five("end", "pos", "reverse"), five("end_", "pos_", "reverse_")
    placed = ~F.col("unmapped") & ~F.col("unmapped_") & (F.col("tid") == F.col("tid_"))
    out = both.select(
        *[c for c in reads.columns if c not in ("tid", "pos", "mate_tid", "mate_pos", "mate_reverse", "mate_unmapped", "mq", "mc", "tlen")],
        *[F.when(F.coalesce(to_mate, F.lit(False)), F.col(f"{c}_")).otherwise(F.col(c)).alias(c) for c in ("tid", "pos")],
        *[F.when(mate_to, F.col(c)).otherwise(F.col(f"{c}_")).alias(f"mate_{c}") for c in ("tid", "pos")],
        F.col("reverse_").alias("mate_reverse"), F.col("unmapped_").alias("mate_unmapped"), F.when(~F.col("unmapped_"), F.col("mapq_")).alias("mq"), F.when(~F.col("unmapped_"), F.col("cigar_")).alias("mc"),
        F.when(placed, two - one + F.when(two >= one, 1).otherwise(-1)).otherwise(F.when(F.col("n_").isNotNull(), 0)).cast("long").alias("tlen"),
    )
    return out


def compare_positional(a: DataFrame, b: DataFrame, ordinal: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Records at equal places that differ: (ordinal, side, columns)."""
    return compare_content(a, b, [ordinal], ignore)


#: What a comparison leaves out, by the step whose output it is for: molecule numbers where they are assigned anew, the template-coordinate tag everywhere.
PRESETS = {"exact": ("tc",), "group": ("tc", "mi"), "dedup": ("tc", "mi"), "consensus": ("tc",), "filter": ("tc",), "sort": ("tc",)}


def compare_reads(a: DataFrame, b: DataFrame, preset: str = "exact", keys: tuple[str, ...] = ("qname", "flag"), ordinal: str | None = None, tags: str = "tags") -> DataFrame:
    """Differences of two sets of records under a preset: by place where an ordinal is given, else by keys. Tags (a map) are compared without order and without those the preset leaves out; a preset that leaves out mi compares molecules by their reads
    (compare_molecules) besides."""
    left_out = PRESETS[preset]
    plain = lambda df: df.withColumn(tags, F.array_sort(F.map_entries(F.map_filter(tags, lambda k, _: ~F.lower(k).isin(*left_out))))) if tags in df.columns else df
    if ordinal is not None:
        return compare_positional(plain(a), plain(b), ordinal, left_out)
    return compare_content(plain(a), plain(b), list(keys), left_out)


def compare_headers(a: list[str], b: list[str], ignore: tuple[str, ...] = ("@PG", "@CO")) -> list[tuple[str, str]]:
    """(side, line) of header lines that one side alone has, programs and comments aside; the fields of a line come in any order."""
    kept = lambda lines: {tuple([x.split("\t")[0], *sorted(x.rstrip("\n").split("\t")[1:])]) for x in lines if not x.startswith(ignore)}
    x, y = kept(a), kept(b)
    return [("left", "\t".join(v)) for v in sorted(x - y)] + [("right", "\t".join(v)) for v in sorted(y - x)]


def strand_partition(a: DataFrame, b: DataFrame, mi: str = "mi", name: str = "qname") -> DataFrame:
    """Molecules, known by their least read name, whose reads are parted differently into strands (/A and /B, whichever is which): (least)."""

    def parted(df: DataFrame, side: str) -> DataFrame:
        base = molecule_base(F.col(mi))
        strands = df.groupBy(base.alias("m_"), F.col(mi).alias("s_")).agg(F.min(name).alias("least"), F.sum(F.xxhash64(name).cast("decimal(38,0)")).alias("sum"))
        return strands.groupBy("m_").agg(F.min("least").alias("least"), F.array_sort(F.collect_list("sum")).alias(side)).drop("m_")  # two strands

    both = parted(a, "left").join(parted(b, "right"), "least", "full_outer")
    return both.filter(~F.col("left").eqNullSafe(F.col("right"))).select("least")


def bases_at(reads: DataFrame, variants: DataFrame, width: int = 1000, keep: tuple[str, ...] = ("qname", "mi")) -> DataFrame:
    """(variant columns, the columns of keep, base) of reads (tid, pos, ops, seq) at variant sites (tid, site): * where a deletion spans the site; reads without a place there are left out. Reads and sites meet on windows of `width` positions."""
    span = reads.select(*keep, "tid", "pos", "ops", "seq", F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor((F.col("pos") + F.greatest(reference_length(F.col("ops")) - 1, F.lit(0))) / width))).alias("cell_"))
    sites = variants.withColumn("cell_", F.floor(F.col("site") / width)).withColumnRenamed("tid", "v_tid")
    met = span.join(sites, (F.col("tid") == F.col("v_tid")) & (span["cell_"] == sites["cell_"])).withColumn("at_", read_position(F.col("pos"), F.col("ops"), F.col("site")))
    base = F.when(F.col("at_") < 0, "*").otherwise(F.substring("seq", (F.col("at_") + 1).cast("int"), F.lit(1)))
    return met.filter("at_ IS NOT NULL").select(*[c for c in variants.columns if c != "tid"], "tid", *keep, base.alias("base"))


def full_review(consensus: DataFrame, grouped: DataFrame, variants: DataFrame, ignore_ns: bool = False) -> tuple[DataFrame, DataFrame]:
    """(calls, raw): consensus reads whose base at a variant is not the reference's (another base, N unless ignored, or a deletion), and the raw reads of their molecules with the base they have there. calls counts bases over both, distinct by base and
    read name: the molecule's raw reads and all consensus reads at the site."""
    at = bases_at(consensus, variants)
    wrong = at.filter((F.col("base") != F.col("ref")) & (F.lit(not ignore_ns) | (F.col("base") != "N")))
    keys = ["site", "tid", "ref"]
    whole = at.select(*keys, "base", "qname").distinct().groupBy(*keys).agg(*[F.count_if(F.col("base") == b).alias(f"consensus_{'del' if b == '*' else b.lower()}") for b in "ACGTN*"])
    raw = bases_at(grouped.withColumn("mi", molecule_base(F.col("mi"))), variants).join(wrong.select(*keys, molecule_base(F.col("mi")).alias("mi")).distinct(), [*keys, "mi"], "left_semi")
    counts = raw.select(*keys, "mi", "base", "qname").distinct().groupBy(*keys, "mi").agg(*[F.count_if(F.col("base") == b).alias(f"raw_{'del' if b == '*' else b.lower()}") for b in "ACGTN*"])
    calls = wrong.select(*keys, F.col("mi"), molecule_base(F.col("mi")).alias("m_"), F.col("qname").alias("consensus_read"), F.col("base").alias("consensus_call"))
    calls = calls.join(whole, keys).join(counts.withColumnRenamed("mi", "m_"), [*keys, "m_"], "left").drop("m_")
    return calls, raw


def template_coordinate(reads: DataFrame, name: str = "qname") -> DataFrame:
    """reads with tc, the template's two primary 5' places, the lower first, on all its records."""
    end = lambda segment: F.max(F.when(F.col("primary") & (F.col("segment") == segment), F.struct("tid", "five_prime", "reverse"))).over(Window.partitionBy(name))
    rows = reads.withColumn("e1", end(1)).withColumn("e2", end(2))
    return rows.withColumn("tc", F.struct(F.least("e1", "e2").alias("low"), F.greatest("e1", "e2").alias("high"))).drop("e1", "e2")


def to_fastq(reads: DataFrame, require: int = 0, exclude: int = 0x900, umi: str | None = None) -> DataFrame:
    """(qname, line): FASTQ records of reads (qname, flag, seq, qual as Phred+33 text): reverse reads turned, /1 and /2 by segment, missing qualities B."""
    from molframe.functions.align import FIRST, LAST as LAST_SEGMENT, PAIRED, REVERSE, has
    from molframe.functions.dna import reverse_complement

    flag, rev = F.col("flag"), has(F.col("flag"), REVERSE)
    name = F.concat(F.col("qname"), F.concat(F.lit("+"), F.col(umi)) if umi else F.lit(""), F.when(has(flag, PAIRED) & has(flag, FIRST), "/1").when(has(flag, PAIRED) & has(flag, LAST_SEGMENT), "/2").otherwise(""))
    qual = F.coalesce(F.col("qual"), F.repeat(F.lit("B"), F.length("seq")))
    kept = reads.filter((flag.bitwiseAND(F.lit(require)) == require) & (flag.bitwiseAND(F.lit(exclude)) == 0))
    return kept.select("qname", F.concat_ws("\n", F.concat(F.lit("@"), name), F.when(rev, reverse_complement(F.col("seq"))).otherwise(F.col("seq")), F.lit("+"), F.when(rev, F.reverse(qual)).otherwise(qual)).alias("line"))


def quality_offset(quals: DataFrame, column: str = "qual", sample: int = 400) -> int:
    """33 or 64, from the first records' least and greatest quality characters."""
    low, high = quals.limit(sample).select(F.explode(F.transform(F.filter(F.split(column, ""), lambda c: c != ""), F.ascii)).alias("c")).agg(F.min("c"), F.max("c")).first()
    if low is None or low < 33 or high > 126:
        raise ValueError("no known quality encoding")
    return 33 if low < 59 else 64 if low >= 64 and high >= 75 else 33


def tag_reversed(tags: dict[str, str], reverse: Column) -> list[Column]:
    """Per-base columns turned on the reverse strand: `reverse` arrays, `revcomp` base strings."""
    from molframe.functions.dna import reverse_complement

    return [F.when(reverse, F.reverse(F.col(c)) if how == "reverse" else reverse_complement(F.col(c))).otherwise(F.col(c)).alias(c) for c, how in tags.items()]


def methylation(positions: DataFrame, reference: DataFrame, family: list[str]) -> DataFrame:
    """(family, at, unconverted, converted) of reference C: reads' C and T at positions (family, tid, ref_pos, at, base)."""
    sites = reference.filter("ref = 'C'").select(F.col("tid").alias("r_tid"), F.col("ref_pos").alias("r_pos"))
    rows = positions.join(sites, (F.col("tid") == F.col("r_tid")) & (F.col("ref_pos") == F.col("r_pos")))
    return rows.groupBy(*family, "at").agg(F.count_if(F.col("base") == "C").alias("unconverted"), F.count_if(F.col("base") == "T").alias("converted"))
