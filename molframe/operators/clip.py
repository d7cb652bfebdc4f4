"""Clipping of alignments: soft, soft with masking, or hard.

Alignments are (pos, ops, seq, qual) with ops a list of (op, len). Functions clip at the alignment's start; its end is clipped as the start of the mirrored one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.functions.flat import at as value_at, letters, number_column, numbers, places, text_column
from molframe.operators.calls import cigar_text

QUERY, REFERENCE = "MIS=X", "MDN=X"
SOFT, MASK, HARD = "soft", "soft-with-mask", "hard"
REASONS = ("five", "three", "overlap", "beyond")
#: Shapes of pairs a task remembers, and the first letter of stand-ins for places.
MOST_PLANS, FIRST = 100_000, 1000
READ_TYPES = ("Fragment", "ReadOne", "ReadTwo", "Pair", "All")


def overlap_midpoint(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """struct<clip1, clip2>: reference bases to clip off the forward read's (s1..e1) end and the reverse read's (s2..e2) start so that they meet in the middle of the template; none without overlap."""
    middle = F.floor((s1 + e2) / 2)
    middle = F.when(middle > e1, e1).when(middle < s2, s2 - 1).otherwise(middle)
    apart = F.greatest(s1, s2) > F.least(e1, e2)
    bases = lambda n: F.when(apart, F.lit(0)).otherwise(F.greatest(n, F.lit(0))).cast("long")
    return F.struct(bases(e1 - middle).alias("clip1"), bases(middle + 1 - s2).alias("clip2"))


def _joined(ops: list[tuple[str, int]]) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for op, n in ops:
        if n and out and out[-1][0] == op:
            out[-1] = (op, out[-1][1] + n)
        elif n:
            out.append((op, n))
    return out


def clip_start(pos: int, ops: list, seq: str, qual: list, n: int, mode: str = HARD) -> tuple[int, list, str, list, int]:
    """Clips n more aligned query bases. An insertion that the cut falls into goes as a whole, a deletion right behind the cut too. Returns the alignment and the bases clipped; one with no
    aligned base left has pos -1 and no ops."""
    hard = sum(k for op, k in ops if op == "H") if ops and ops[0][0] == "H" else 0
    hard = ops[0][1] if hard else 0
    rest = list(ops[1:] if hard else ops)
    soft = rest.pop(0)[1] if rest and rest[0][0] == "S" else 0
    aligned = sum(k for op, k in rest if op in "MI=X")
    if n <= 0 or not aligned:
        return pos, ops, seq, qual, 0
    if n >= aligned:
        return -1, [], seq, qual, aligned
    left, moved, cut = n, 0, 0
    while left > 0 or (rest and rest[0][0] in "DN"):
        op, k = rest[0]
        if op in "DN":
            moved += k
            rest.pop(0)
        elif op == "I":
            cut, left = cut + k, left - k
            rest.pop(0)
        else:
            take = min(k, left)
            cut, left, moved = cut + take, left - take, moved + take
            rest[0] = (op, k - take)
            if take == k:
                rest.pop(0)
    gone = soft + cut
    if mode == HARD:
        return pos + moved, _joined([("H", hard + gone), *rest]), seq[gone:], qual[gone:], cut
    if mode == MASK:
        seq, qual = "N" * gone + seq[gone:], [2] * gone + list(qual[gone:])
    return pos + moved, _joined([("H", hard), ("S", gone), *rest]), seq, qual, cut


def clip_end(pos: int, ops: list, seq: str, qual: list, n: int, mode: str = HARD) -> tuple[int, list, str, list, int]:
    at, turned, text, quals, cut = clip_start(0, list(ops[::-1]), seq[::-1], list(qual[::-1]), n, mode)
    return (-1 if at < 0 else pos), turned[::-1], text[::-1], list(quals[::-1]), cut


def upgrade(pos: int, ops: list, seq: str, qual: list) -> tuple[int, list, str, list]:
    """Soft clips at either end made hard."""
    for _ in range(2):
        hard = ops[0][1] if ops and ops[0][0] == "H" else 0
        rest = ops[1:] if hard else ops
        if rest and rest[0][0] == "S":
            k = rest[0][1]
            ops, seq, qual = [("H", hard + k), *rest[1:]], seq[k:], qual[k:]
        ops, seq, qual = ops[::-1], seq[::-1], qual[::-1]
    return pos, list(ops), seq, list(qual)


def query_bases(ops: list, reference: int, from_start: bool) -> int:
    """Aligned query bases in the first (or last) `reference` reference bases."""
    out = 0
    for op, k in ops if from_start else ops[::-1]:
        if reference <= 0:
            break
        if op in "M=X":
            out += min(k, reference)
            reference -= k
        elif op == "I":
            out += k
        elif op in "DN":
            reference -= k
    return out


def reference_length(ops: list) -> int:
    return sum(k for op, k in ops if op in REFERENCE)


def past_mate(pos: int, ops: list, reverse: bool, mate_pos: int, mate_ops: list) -> int:
    """Query bases, soft clips too, of a read of a forward-reverse pair that lie beyond its mate's unclipped end."""
    soft = lambda x, front: next((k for op, k in (x if front else x[::-1]) if op != "H"), 0) if [op for op, _ in (x if front else x[::-1]) if op != "H"][:1] == ["S"] else 0
    if reverse:
        limit = mate_pos - soft(mate_ops, True)
        over = limit - pos
        return max(0, query_bases(ops, over, True) + soft(ops, True)) if over > 0 else max(0, soft(ops, True) + over)
    limit = mate_pos + reference_length(mate_ops) - 1 + soft(mate_ops, False)
    over = pos + reference_length(ops) - 1 - limit
    return max(0, query_bases(ops, over, False) + soft(ops, False)) if over > 0 else max(0, soft(ops, False) + over)


def clip_pairs(pairs: DataFrame, mode: str = HARD, fixed: tuple[int, int, int, int] = (0, 0, 0, 0), overlap: bool = False, beyond_mate: bool = False, upgrading: bool = False) -> DataFrame:
    """pairs (qname; pos<i>, cigar<i> struct array, seq<i>, qual<i>, reverse<i> of reads 1 and 2; a fragment has a null cigar2) clipped in order: upgrade, fixed bases off read 1's and read 2's 5' and 3' ends, overlap, beyond the mate.
    clipped<i> counts bases; pre<i> those clipped before, five<i>, three<i>, overlap<i> and beyond<i> the ones clipped for each reason, post<i> all that are clipped now. CIGAR surgery is irregular, so it runs once for each shape of pairs in Arrow batches."""

    def one(row: dict) -> dict:
        here = [i for i in (1, 2) if row[f"cigar{i}"] is not None]
        reads = [[row[f"pos{i}"], [(o["op"], o["len"]) for o in row[f"cigar{i}"]], row[f"seq{i}"], list(row[f"qual{i}"])] for i in here]
        reverse = [row[f"reverse{i}"] for i in here]
        clips = lambda ops: sum(k for op, k in ops if op in "SH")
        tally = [{"pre": clips(r[1]), "aligned": sum(k for op, k in r[1] if op in "MI=X"), "five": 0, "three": 0, "overlap": 0, "beyond": 0} for r in reads]
        for i in range(len(reads)):
            if upgrading:
                reads[i] = list(upgrade(*reads[i]))
            for what, amount, at_start in (("five", fixed[2 * i], not reverse[i]), ("three", fixed[2 * i + 1], reverse[i])):
                *reads[i][:], tally[i][what] = (clip_start if at_start else clip_end)(*reads[i], amount, mode)
        if len(reads) == 2 and reverse[0] != reverse[1] and all(r[0] >= 0 for r in reads):
            f, r = (0, 1) if not reverse[0] else (1, 0)
            (s1, ops1), (s2, ops2) = reads[f][:2], reads[r][:2]
            e1, e2 = s1 + reference_length(ops1) - 1, s2 + reference_length(ops2) - 1
            if overlap and max(s1, s2) <= min(e1, e2):
                middle = (s1 + 1 + e2 + 1) // 2 - 1
                middle = e1 if middle > e1 else s2 - 1 if middle < s2 else middle
                for i, n, clip, at_start in ((f, e1 - middle, clip_end, False), (r, middle + 1 - s2, clip_start, True)):
                    *reads[i], tally[i]["overlap"] = clip(*reads[i], query_bases(reads[i][1], n, at_start), mode)
            if beyond_mate and all(x[0] >= 0 for x in reads):
                n = [past_mate(reads[i][0], reads[i][1], reverse[i], reads[1 - i][0], reads[1 - i][1]) for i in (0, 1)]
                for i in (0, 1):
                    *reads[i], tally[i]["beyond"] = (clip_start if reverse[i] else clip_end)(*reads[i], n[i], mode)
        out = dict.fromkeys(columns) | {"qname": row["qname"]}
        for i, (pos, ops, seq, qual), t in zip(here, reads, tally, strict=True):
            lost = sum(t[k] for k in REASONS)
            post = t["pre"] + t["aligned"] if pos < 0 else clips(ops)  # a read without alignment has all its bases clipped
            out |= {f"pos{i}": pos, f"cigar{i}": "".join(f"{k}{op}" for op, k in ops), f"seq{i}": seq, f"qual{i}": qual, f"clipped{i}": lost, f"bases{i}": t["aligned"] + t["pre"], f"pre{i}": t["pre"], f"post{i}": post} | {f"{k}{i}": t[k] for k in REASONS}
        return out

    counts = ("clipped", "bases", "pre", "post", *REASONS)
    columns = ["qname", *[f"{c}{i}" for i in (1, 2) for c in ("pos", "cigar", "seq", "qual", *counts)]]
    plans: dict[tuple, dict] = {}

    def plan(key: tuple) -> dict:
        """What becomes of pairs of one shape: one() of stand-ins, whose letters and qualities are places in the read; N and -1 stand for masked ones."""
        if key not in plans:
            if len(plans) >= MOST_PLANS:
                plans.clear()
            p1, p2, *sides = key
            row = {"qname": ""}
            for i, pos, (ops, length, quals, reverse) in ((1, p1, sides[0]), (2, p2, sides[1])):
                row |= {f"pos{i}": pos, f"cigar{i}": None if ops is None else [{"op": x[-1], "len": int(x[:-1])} for x in re.findall("[0-9]+[^0-9]", ops)], f"seq{i}": "".join(chr(FIRST + j) for j in range(length)), f"qual{i}": list(range(FIRST, FIRST + quals)), f"reverse{i}": reverse}
            plans[key] = one(row)
        return plans[key]

    def run(batches):
        for batch in batches:
            keys, kind, shift = _shapes(batch)
            done = [plan(k) for k in keys]
            made = {"qname": batch["qname"]}
            for i in (1, 2):
                there = np.array([d[f"pos{i}"] is not None for d in done])
                taken = lambda values, kind_type: pa.array(values, kind_type).take(pa.array(kind))
                for c in counts:
                    made[f"{c}{i}"] = taken([d[f"{c}{i}"] for d in done], pa.int64())
                made[f"cigar{i}"] = taken([d[f"cigar{i}"] for d in done], pa.string())
                pos = np.array([-1 if d[f"pos{i}"] is None else d[f"pos{i}"] for d in done])[kind]
                made[f"pos{i}"] = pa.array(np.where(pos < 0, pos, pos + shift), mask=~there[kind])
                text = [d[f"seq{i}"] or "" for d in done]
                codes, bounds = _picked(*letters(batch[f"seq{i}"]), [[-1 if x == "N" else ord(x) - FIRST for x in t] for t in text], kind, ord("N"))
                made[f"seq{i}"] = pc.if_else(pa.array(there[kind]), text_column(codes, bounds), None)
                values, bounds = _picked(*numbers(batch[f"qual{i}"]), [[-1 if x < FIRST else x - FIRST for x in d[f"qual{i}"] or []] for d in done], kind, 2)
                made[f"qual{i}"] = pc.if_else(pa.array(there[kind]), number_column(values, bounds), None)
            yield pa.RecordBatch.from_arrays([made[c] for c in columns], columns)

    return pairs.mapInArrow(run, "qname string, " + ", ".join(f"pos{i} long, cigar{i} string, seq{i} string, qual{i} array<int>, " + ", ".join(f"{c}{i} long" for c in counts) for i in (1, 2)))


def _picked(values: np.ndarray, bounds: np.ndarray, templates: list[list[int]], kind: np.ndarray, masked: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the values at the places of its kind's template; -1 gives `masked`."""
    flat = np.array([x for t in templates for x in t], np.int64)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in templates])]).astype(np.int64)
    out = np.concatenate([[0], np.cumsum(np.diff(begin)[kind])]).astype(np.int64)
    row, at = places(out)
    place = value_at(flat, begin, kind[row], at, -1)
    return np.where(place < 0, masked, value_at(values, bounds, row, place, masked)), out


def _shapes(batch: pa.RecordBatch) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """(shapes, each row's shape, what its places are beyond those of the shape): pairs whose reads lie alike to each other, are aligned alike and equally long are clipped alike. Reads without a place keep their own."""
    pos = [batch[f"pos{i}"].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2)]
    gone = batch["cigar2"].is_null().to_numpy(zero_copy_only=False)
    pos[1] = np.where(gone, pos[0], pos[1])
    shift = np.where((pos[0] >= 0) & (pos[1] >= 0), np.minimum(*pos), 0)
    pos = [p - shift for p in pos]
    parts = [pa.array(p) for p in pos]
    for i in (1, 2):
        size = lambda c: pc.fill_null(c, 0)
        parts += [cigar_text(batch[f"cigar{i}"]), size(pc.binary_length(batch[f"seq{i}"])), size(pc.list_value_length(batch[f"qual{i}"])), batch[f"reverse{i}"]]
    code = np.zeros(batch.num_rows, np.int64)
    for p in parts:
        x = p.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        code = np.unique(code * (batch.num_rows + 2) + x, return_inverse=True)[1]
    _, first, kind = np.unique(code, return_index=True, return_inverse=True)
    rows = zip(*[p.take(pa.array(first)).to_pylist() for p in parts], strict=True)
    return [(r[0], r[1], tuple(r[2:6]), tuple(r[6:10])) for r in rows], kind, shift


def clipping_metrics(clipped: DataFrame) -> DataFrame:
    """For Fragment, ReadOne, ReadTwo, Pair (both reads of pairs) and All: reads, those without alignment now, and the reads and bases clipped before, after, and for each reason."""
    numbers = ("bases", "pre", "post", *REASONS)
    fragment = F.col("pos2").isNull()
    side = lambda i, kinds: F.struct(kinds.alias("kinds"), (F.col(f"pos{i}") < 0).alias("gone"), *[F.col(f"{c}{i}").alias(c) for c in numbers])
    one = F.when(fragment, F.array(F.lit("Fragment"), F.lit("All"))).otherwise(F.array(F.lit("ReadOne"), F.lit("Pair"), F.lit("All")))
    two = F.array(F.lit("ReadTwo"), F.lit("Pair"), F.lit("All"))
    sides = clipped.select(F.explode(F.array(side(1, one), side(2, two))).alias("x")).select("x.*").filter("bases IS NOT NULL")
    kept = {c: F.sum(c) for c in numbers} | {f"{c}_reads": F.count_if(F.col(c) > 0) for c in numbers[1:]} | {"reads": F.count("*"), "gone": F.count_if("gone")}
    # few kinds of sides first, then each to the rows it counts in
    rows = sides.groupBy("kinds").agg(*[v.alias(k) for k, v in kept.items()]).select(F.explode("kinds").alias("read_type"), *kept).groupBy("read_type").agg(*[F.sum(k).alias(k) for k in kept])
    every = rows.sparkSession.createDataFrame([(t,) for t in READ_TYPES], "read_type string").join(rows, "read_type", "left").fillna(0)
    named = {"pre": "pre", "post": "post", "five": "five_prime", "three": "three_prime", "overlap": "overlapping", "beyond": "extending"}
    return every.select("read_type", "reads", F.col("gone").alias("reads_unmapped"), *[F.col(f"{c}_reads").alias(f"reads_clipped_{n}") for c, n in named.items()], "bases", *[F.col(c).alias(f"bases_clipped_{n}") for c, n in named.items()])


def clipped_tag(values: Column, before: Column, after: Column, from_start: Column) -> Column:
    """A per-base text or array cut like its read, from `before` bases to `after`, at its start or at its end; one of another length than the read had stays."""
    lost = before - after
    text = F.when(from_start, F.substring(values, lost + 1, after)).otherwise(F.substring(values, F.lit(1), after))
    return F.when(F.length(values) == before, text).otherwise(values)
