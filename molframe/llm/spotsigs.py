"""Document fingerprints by spot signatures, in DataFrame functions only.

Each common word (an anchor) together with the CHAIN content words that follow it is a spot signature; a document's fingerprint is its set of
signatures. Likeness is the Jaccard similarity of two sets, which set lengths bound from above.

Defined results: a text without any spot has one signature, that of the whole text, so equal texts always have equal fingerprints; a null text is an
empty one; rows with equal ids are ordered by text; a null id sorts first; the next row after the last is the first; extra input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molframe.llm.neardup import classes_of, shared
from molframe.session import table, written

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from he in is it not of on or that the this to was which with "
    "au dans de des du elle en est et la le les ne par pas pour que qui sur un une "
    "als auf das dem den der des die ein eine es für im in ist mit nicht sich und von zu "
    "al como con del el en la las lo los no para por se su una y"
).split()
CHAIN = 2
#: Ranges that ids are dealt to, at most, and rows of a range where that allows it.
RANGES, RANGE_ROWS = 1 << 14, 4000


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def spot_signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct signatures (int) of a text."""
    anchor = lambda w: w.isin(*sorted(set(ANCHORS)))

    def spots(words: Column) -> Column:
        at = F.filter(F.transform(words, lambda w, i: F.when(anchor(w), i).otherwise(F.lit(-1))), lambda i: i >= 0)
        found = let(F.struct(words.alias("words"), F.filter(words, lambda w: ~anchor(w)).alias("content"), at.alias("at")), signed)
        return found

    def signed(x: Column) -> Column:
        # of the words before the j-th anchor all but j are content, so its chain starts at content word (place - j)
        one = lambda i, j: F.when(i - j < F.size(x["content"]), F.hash(F.get(x["words"], i), *[F.get(x["content"], i - j + k) for k in range(chain)]))
        return F.array_sort(F.array_distinct(F.array_compact(F.transform(x["at"], one))))

    text = F.coalesce(text, F.lit(""))
    found = let(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), spots)
    return let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.hash(F.lit("text"), text))))


def fingerprint(signatures: Column) -> Column:
    """The signatures, 4 bytes each, as base64."""
    return F.base64(F.unhex(F.array_join(F.transform(signatures, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; sets of which one is empty aren't alike."""
    both = F.size(F.array_intersect(a, b))
    return let(both, lambda n: F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def bounded_likeness(a: Column, b: Column, least: float) -> Column:
    """The likeness where it is at least `least`, else null; sets whose lengths rule that out aren't compared."""
    shorter, longer = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(shorter >= longer * least, let(likeness(a, b), lambda x: F.when(x >= least, x)))


def length_part(signatures: Column, least: float) -> Column:
    """The part of a set by its length: sets at least `least` alike are in the same part or in neighbouring ones."""
    return F.floor(F.log(F.greatest(F.size(signatures), F.lit(1))) / F.lit(math.log(1 / least))).cast("int")


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at or below the value, by halving."""
    table_ = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))]) if bounds else F.array().cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table_, at + step - 1) <= value, at + step).otherwise(at))


def with_next(df: DataFrame, id_col: str, text_col: str, extra: dict | None = None) -> DataFrame:
    """(id, text, extra columns computed from text, next_text and next_<extra> of the row with the next id). One exchange of the texts.

    Ids are dealt to ranges of about equally many rows, by approximate quantiles. Each range also gets the first rows of the next range
    (the last range those of the first), so that a window inside the range finds every row's successor. Rows of one id, and those without, stay together."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = min(RANGES, -(-rows.count() // RANGE_ROWS))
    bounds = rows.select(F.percentile_approx("id", [k / parts for k in range(1, parts)], 8 * parts)).first()[0] if parts > 1 else []
    rows = rows.withColumn("range", F.when(F.col("id").isNull(), -1).otherwise(range_of(F.col("id"), sorted(set(bounds or [])))))
    before = Window.orderBy("range")
    firsts = rows.groupBy("range").agg(F.min("id").alias("first")).select("range", "first", F.lag("range").over(before).alias("into"), F.max("range").over(Window.partitionBy()).alias("last"))
    firsts = firsts.select(F.col("range").alias("first_range"), "first", F.coalesce("into", "last").alias("into"), F.col("into").isNull().cast("int").alias("wrap"))
    dealt = rows.join(F.broadcast(firsts), (F.col("range") == F.col("first_range")) & F.col("id").eqNullSafe(F.col("first")), "left")  # RANGES + 1 rows at most
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("wrap"), F.lit(False).alias("guest"))
    guest = F.when(F.col("into").isNotNull(), F.struct(F.col("into").alias("range"), F.col("wrap").alias("wrap"), F.lit(True).alias("guest")))
    dealt = dealt.select("id", "text", F.explode(F.array_compact(F.array(own, guest))).alias("at")).select("id", "text", "at.*").repartition("range")
    for name, make in (extra or {}).items():
        dealt = dealt.withColumn(name, make(F.col("text")))
    # a range that is alone is its own next one: its guests come after its own rows by wrap
    order = Window.partitionBy("range").orderBy("wrap", F.col("id").asc_nulls_first(), "text")
    names = ["text", *(extra or {})]
    out = dealt.select("id", *names, "guest", *[F.lead(c).over(order).alias(f"next_{c}") for c in names])
    return out.filter(~F.col("guest")).drop("guest")


def spot_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """(id, signatures array<int>, fingerprint) of every whole text."""
    out = df.select(F.col(id_col).alias("id"), spot_signatures(F.col(text_col), chain).alias("signatures"))
    return out.select(F.col("id").alias(id_col), "signatures", fingerprint(F.col("signatures")).alias("fingerprint"))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"), "doc_id", "text", {"own": spot_signatures})
    cut = F.floor(F.length("text") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut)))
    rows = rows.withColumn("other", spot_signatures(F.col("edited")))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def spot_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(id, class_id, class_size): rows whose fingerprints are at least `least` alike, directly or over others, are a class; class_id is its least id.

    Equal fingerprints are one node. Nodes are parted by set length, each into its own part and the next, so that sets that can be alike meet. In a part a node is listed under the prefix of its
    signatures, rarest first, that any set as alike must share one of; under a signature every two nodes listed are compared, unless they are in one class already (neardup.classes_of)."""
    rows = written(spot_fingerprints(df, id_col, text_col).select(F.col(id_col).alias("id"), "signatures", F.unhex(F.md5("fingerprint")).alias("node")), "spots")
    nodes = written(rows.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("signatures").alias("signatures")), "spot-nodes")
    size = F.size("signatures")
    listed = nodes.select("node", size.alias("n"), length_part(F.col("signatures"), least).alias("part"), F.explode("signatures").alias("s"))
    often = listed.groupBy("s").agg(F.count("*").alias("often"))
    rare = Window.partitionBy("node").orderBy("often", "s")
    prefix = listed.join(often, "s").withColumn("nth", F.row_number().over(rare)).filter(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    members = prefix.select("s", "node", "n", F.explode(F.array("part", F.col("part") + 1)).alias("p"))
    members = members.select(F.xxhash64("s", "p").alias("band"), "node", "n")
    of = lambda name: nodes.select(F.col("node").alias(name), F.col("signatures").alias(f"of_{name}"))
    alike = bounded_likeness(F.col("of_a"), F.col("of_b"), least).isNotNull()
    labels = classes_of(shared(written(members, "spot-members").distinct()), lambda pairs: pairs.join(of("a"), "a").join(of("b"), "b").filter(alike).select("a", "b"), least)
    if labels is None:
        labels = nodes.select("node", F.col("node").alias("label")).limit(0)
    placed = nodes.select("node", "id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = placed.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    return rows.select("id", "node").join(placed.select("node", "label").join(classes, "label"), "node").select(F.col("id").alias(id_col), "class_id", "class_size")
