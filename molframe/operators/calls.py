"""Consensus calls of whole families in Arrow batches: what consensus.py says by columns, for all bases of a batch at a time. Sums run by ascending quality as there."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from molframe.functions.flat import NO_QUALITY, at as value_at, letters, number_column, numbers, places, text_column
from molframe.functions.phred import BASES, LEAST, MOST, PRECISION, TIE, ln_error, right_and_wrong, single_read

MOST_SHORT = 32767
N = ord("N")
CODES = np.frombuffer(BASES.encode(), np.uint8)
#: 0 to 3 for A, C, G, T, 4 for all else.
KIND = np.full(256, 4, np.int64)
KIND[CODES] = np.arange(4)


def named(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def changes(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Whether a row differs in one of the columns from the row before; the first one does."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for c in columns:
        x = batch[c].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return new


def families(rows: DataFrame, family: list[str], step: Callable[[pa.RecordBatch], pa.RecordBatch], shape: str, order: tuple[str, ...] = ()) -> DataFrame:
    """step of whole families, many at a time; rows of a family are in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held:  # one row of the family held is enough to see where it ends
                both = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch]).combine_chunks().to_batches()[0]
                starts = np.flatnonzero(changes(both, family)[1:])
            else:
                starts = np.flatnonzero(changes(batch, family))[1:]
            if len(starts):
                last = int(starts[-1])
                ready = [*held, batch.slice(0, last)] if last else held
                yield step(pa.Table.from_batches(ready).combine_chunks().to_batches()[0])
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield step(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.sortWithinPartitions(*family, *order).mapInArrow(run, shape)


def bases(batch: pa.RecordBatch, seq: str, qual: str, mask: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, qualities, row, place, lengths of the rows), where asked with bases below a quality made N and N at the ends left out of the lengths."""
    codes, bounds = letters(batch[seq])
    values, value_bounds = numbers(batch[qual])
    row, place = places(bounds)
    quals = value_at(values, value_bounds, row, place, NO_QUALITY)
    size = np.diff(bounds)
    if mask is not None:
        low = quals < mask
        codes, quals = np.where(low, N, codes), np.where(low, LEAST, quals)
        size = np.zeros_like(size)
        kept = codes != N
        np.maximum.at(size, row[kept], place[kept] + 1)
    return codes, quals, row, place, size


def scores(position: np.ndarray, kind: np.ndarray, qual: np.ndarray, weight: np.ndarray | None, size: int, post_umi: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihoods, reads) of A, C, G, T at each of `size` positions."""
    right, wrong = (np.array(x) for x in right_and_wrong(post_umi))
    key, at = np.unique(position * (MOST + 1) + qual, return_inverse=True)
    n = np.bincount(at * 4 + kind, weight, len(key) * 4).reshape(-1, 4)
    where, q = key // (MOST + 1), key % (MOST + 1)
    every = n.sum(1)
    with np.errstate(invalid="ignore"):
        terms = [np.where(n[:, b] > 0, n[:, b] * right[q], 0.0) + (every - n[:, b]) * wrong[q] for b in range(4)]
    # bincount adds in the order of its input, by ascending quality
    return np.stack([np.bincount(where, t, size) for t in terms], 1), np.stack([np.bincount(where, n[:, b], size) for b in range(4)], 1).astype(np.int64)


def called(score: np.ndarray, pre_umi: int) -> tuple[np.ndarray, np.ndarray]:
    """(base as 0 to 3, or 4 for N; quality) of log-likelihoods."""
    pre = ln_error(pre_umi)
    with np.errstate(all="ignore"):
        at = score.argmax(1)
        off = score - score.max(1)[:, None]
        later = np.arange(4) > at[:, None]
        ties = (later & (np.abs(off) <= TIE)).any(1)
        odds = np.where(np.arange(4) == at[:, None], 0.0, np.exp(off))
        others = ((odds[:, 0] + odds[:, 1]) + odds[:, 2]) + odds[:, 3]
        wrong = np.log(others) - np.log1p(others)
        high, low = np.maximum(wrong, pre), np.minimum(wrong, pre)
        both = np.where(high - low >= 6, high, np.log(np.exp(high) + np.exp(low) - 4 / 3 * np.exp(high + low)))
        chance = np.where(others == 0, pre, both)
        raw = np.floor(chance * (-10 / math.log(10)) + PRECISION)
        qual = np.where(chance < ln_error(MOST), MOST, np.minimum(MOST, np.maximum(LEAST, np.nan_to_num(raw, nan=0.0)))).astype(np.int64)
    return np.where(ties, 4, at), np.where(ties, LEAST, qual)


class Called:
    """The positions of the families of a batch: bounds by family, and of each position base, qual, depth and errors. Families of fewer than min_reads reads have none."""

    def __init__(self, part: np.ndarray, count: int, codes: np.ndarray, quals: np.ndarray, row: np.ndarray, place: np.ndarray, size: np.ndarray, min_reads: int = 1, pre_umi: int = 45, post_umi: int = 40, min_qual: int = 2):
        reads = np.bincount(part, minlength=count)
        # the min_reads-th longest read of each family
        order = np.lexsort((-size, part))
        begin = np.concatenate([[0], np.cumsum(reads)])
        self.enough = reads >= min_reads
        nth = np.minimum(begin[:-1] + max(min_reads, 1) - 1, len(part) - 1)
        length = np.where(self.enough, size[order][nth], 0)
        self.bounds = np.concatenate([[0], np.cumsum(length)])
        family = part[row]
        used = (place < size[row]) & (place < length[family]) & (quals != NO_QUALITY)
        codes, quals = codes[used], np.minimum(quals[used], MOST)
        position, kind, total = self.bounds[family[used]] + place[used], KIND[codes], int(self.bounds[-1])
        known = kind < 4
        score, n = scores(position[known], kind[known], quals[known], None, total, post_umi)
        depth = n.sum(1)
        base, qual = called(score, pre_umi)
        base, qual = np.where(depth == 0, 4, base), np.where(depth == 0, LEAST, qual)
        agreeing = np.where(base < 4, n[np.arange(total), np.minimum(base, 3)], 0)
        errors = np.minimum(depth - agreeing, MOST_SHORT)
        code = np.append(CODES, N)[base]
        low, thin = qual < min_qual, depth < min_reads
        code, qual = np.where(low | thin, N, code), np.where(thin, 0, np.where(low, LEAST, qual))
        single = np.repeat(reads == 1, length)
        if single.any():
            alone = single[position]
            table = np.array(single_read(pre_umi, post_umi))
            own, value = np.full(total, N, np.int64), np.full(total, LEAST, np.int64)
            own[position[alone]], value[position[alone]] = codes[alone], table[quals[alone]]
            weak = value < min_qual
            code, qual = np.where(single, np.where(weak, N, own), code), np.where(single, np.where(weak, LEAST, value), qual)
            errors = np.where(single, 0, errors)
        self.base, self.qual, self.depth, self.errors = code, qual, np.minimum(depth, MOST_SHORT), errors


def position_step(family: list[str], mask: int | None, seq: str, qual: str, options: dict) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        first = changes(batch, family)
        x = Called(np.cumsum(first) - 1, int(first.sum()), *bases(batch, seq, qual, mask), **options)
        part, at = places(x.bounds)
        keys = pa.array(np.flatnonzero(first)[part])
        number = lambda v: pa.array(v.astype(np.int32))
        made = [number(at), text_column(x.base, np.arange(len(at) + 1)), number(x.qual), number(x.depth), number(x.errors)]
        return pa.RecordBatch.from_arrays([*[batch[k].take(keys) for k in family], *made], [*family, "at", "base", "qual", "depth", "errors"])

    return step


def rates(errors: np.ndarray, depths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    part = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    lost, all_ = (np.bincount(part, v, len(bounds) - 1) for v in (errors, depths))
    return np.divide(lost, all_, out=np.zeros(len(lost)), where=all_ > 0).astype(np.float32)


def assembled_step(family: list[str], mask: int | None, seq: str, qual: str, options: dict) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        first = changes(batch, family)
        x = Called(np.cumsum(first) - 1, int(first.sum()), *bases(batch, seq, qual, mask), **options)
        kept = np.flatnonzero(np.diff(x.bounds) > 0)  # the others have no positions
        bounds, begin = np.append(x.bounds[kept], x.bounds[-1]), x.bounds[kept]
        least, most = (f.reduceat(x.depth, begin) if len(kept) else x.depth for f in (np.minimum, np.maximum))
        keys = pa.array(np.flatnonzero(first)[kept])
        made = [text_column(x.base, bounds), *[number_column(v, bounds, None) for v in (x.qual, x.depth, x.errors)], pa.array(most.astype(np.int32)), pa.array(least.astype(np.int32)), pa.array(rates(x.errors, x.depth, bounds))]
        return pa.RecordBatch.from_arrays([*[batch[k].take(keys) for k in family], *made], [*family, "seq", "qual", "depths", "errors", "cD", "cM", "cE"])

    return step


def duplex_step(family: list[str], strand: str, mask: int | None, min_reads: tuple[int, int, int], combine: Callable, options: dict) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Families whose strands have enough reads; rows come by family."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        first = changes(batch, family)
        part, count = np.cumsum(first) - 1, int(first.sum())
        side = (batch[strand].to_numpy(zero_copy_only=False) == "B").astype(np.int64)
        n = np.bincount(part * 2 + side, minlength=2 * count).reshape(-1, 2)
        enough = (n.sum(1) >= min_reads[0]) & (n.max(1) >= min_reads[1]) & (n.min(1) >= min_reads[2])
        x = Called(part * 2 + side, 2 * count, *bases(batch, "seq", "qual", mask), **options)
        size = np.diff(x.bounds).reshape(-1, 2)
        paired = (size > 0).all(1)
        length = np.where(enough, np.where(paired, size.min(1), size.max(1)), 0)
        kept = np.flatnonzero(length > 0)
        bounds = np.concatenate([[0], np.cumsum(length[kept])])
        where, at = places(bounds)
        owner = kept[where]
        has = [size[owner, s] > 0 for s in (0, 1)]
        one = []
        for s in (0, 1):
            place = np.where(has[s], x.bounds[owner * 2 + s] + at, 0)
            one.append([np.where(has[s], v[place], -1) for v in (x.base, x.qual, x.depth, x.errors)])
        (a, qa, da, ea), (b, qb, db, eb) = one
        both = has[0] & has[1]
        base, qual = combine(a, qa, b, qb)
        agree = a == b
        errors = np.minimum(np.where(agree, ea + eb, np.where(qa >= qb, ea + db - eb, eb + da - ea)), MOST_SHORT)
        pick = lambda c, u, v: np.where(both, c, np.where(has[0], u, v))
        base, qual, depth, errors = pick(base, a, b), pick(qual, qa, qb), pick(da + db, da, db), pick(errors, ea, eb)
        alone = lambda v, s: text_column(v[has[s]], np.concatenate([[0], np.cumsum(np.bincount(where[has[s]], minlength=len(kept)))]))
        keys = pa.array(np.flatnonzero(first)[kept])
        made = [text_column(base, bounds), *[number_column(v, bounds, None) for v in (qual, depth, errors)], alone(a, 0), alone(b, 1), *[number_column(v, bounds, -1) for v in (da, db, ea, eb)]]
        return pa.RecordBatch.from_arrays([*[batch[k].take(keys) for k in family], *made], [*family, "seq", "qual", "depths", "errors", "ac", "bc", "ad", "bd", "ae", "be"])

    return step


def umi_step(family: list[str]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """rows (family, seq: a UMI, n: its reads), by family and UMI."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        first = changes(batch, family)
        begin, part = np.flatnonzero(first), np.cumsum(first) - 1
        codes, bounds = letters(batch["seq"])
        size, kinds = np.diff(bounds), np.diff(np.append(begin, len(first)))
        mixed = np.minimum.reduceat(size, begin) < np.maximum.reduceat(size, begin)
        voted = (kinds > 1) & ~mixed
        width = size[begin]
        out = np.concatenate([[0], np.cumsum(width)])
        row, place = places(bounds)
        position = out[part[row]] + place
        used = voted[part[row]]
        position, code, weight = position[used], codes[used], batch["n"].to_numpy(zero_copy_only=False)[row[used]]
        kind = KIND[code]
        known = kind < 4
        score, n = scores(position[known], kind[known], np.full(int(known.sum()), 20), weight[known], int(out[-1]), 90)
        base, _ = called(score, 90)
        greatest = np.zeros(int(out[-1]), np.int64)
        np.maximum.at(greatest, position, code)
        text = np.where(n.sum(1) > 0, np.append(CODES, N)[base], greatest)
        # one UMI is itself, of unlike lengths the first stays
        slot, at = places(out)
        text = np.where(voted[slot], text, value_at(codes, bounds, begin[slot], at, 0))
        keys = pa.array(begin)
        return pa.RecordBatch.from_arrays([*[batch[k].take(keys) for k in family], text_column(text, out), pa.array(mixed)], [*family, "umi", "mixed_lengths"])

    return step


def observed_step(family: list[str]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """rows (family, seq: a UMI in upper case or null, text: as it was read, n: its reads), by family and UMI: the family's consensus UMI with the reads that have it or another one, and those that have another one."""
    consensus = umi_step(family)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        first = changes(batch, family)
        part, begin = np.cumsum(first) - 1, np.flatnonzero(first)
        there = batch["seq"].is_valid().to_numpy(zero_copy_only=False)
        n = batch["n"].to_numpy(zero_copy_only=False)
        known = np.flatnonzero(np.bincount(part[there], minlength=len(begin)))
        umis = consensus(batch.filter(pa.array(there)))["umi"]  # of the known ones, in their order
        place = np.full(len(begin), -1)
        place[known] = np.arange(len(known))
        codes, bounds = letters(batch["text"])
        own, own_bounds = letters(umis)
        row, at = places(bounds)
        mine = place[part]
        same_size = np.zeros(len(part), bool)
        same_size[there] = np.diff(bounds)[there] == np.diff(own_bounds)[mine[there]]
        used = same_size[row]
        unlike = np.bincount(row[used & (value_at(own, own_bounds, np.maximum(mine[row], 0), at, 0) != codes)], minlength=len(part)) > 0
        wrong = there & (~same_size | unlike)
        count = lambda test: pa.array(np.bincount(part, np.where(test, n, 0), len(begin)).astype(np.int64))
        keys = pa.array(begin)
        return pa.RecordBatch.from_arrays([*[batch[k].take(keys) for k in family], umis.take(pa.array(place, mask=place < 0)), count(True), count(wrong)], [*family, "umi", "raw", "wrong"])

    return step


def cigar_text(column: pa.Array) -> pa.Array:
    """CIGAR strings of array<struct<op, len>>."""
    bounds = np.append(0, np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)))
    ops = column.flatten()
    each = pc.binary_join_element_wise(pc.struct_field(ops, "len").cast(pa.string()), pc.struct_field(ops, "op"), "")
    return pc.if_else(column.is_valid(), pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), each), ""), pa.scalar(None, pa.string()))


def simplified(cigar: str, length: int) -> tuple:
    """consensus.simplified of one alignment: (op, len) with clips, = and X as M, neighbours joined, cut to the first `length` bases."""
    joined: list[tuple[str, int]] = []
    for n, op in re.findall("([0-9]+)([^0-9])", cigar):
        op = "M" if op in "SH=XM" else op
        if joined and joined[-1][0] == op:
            joined[-1] = (op, joined[-1][1] + int(n))
        else:
            joined.append((op, int(n)))
    out, left = [], length
    for op, n in joined:
        if left <= 0:
            break
        take = min(n, left) if op in "MI" else n
        out.append((op, take))
        left -= take if op in "MI" else 0
    return tuple(out)


def fits(shorter: tuple, longer: tuple) -> bool:
    n = len(shorter)
    if n == 0:
        return True
    return n <= len(longer) and shorter[: n - 1] == longer[: n - 1] and shorter[-1][0] == longer[n - 1][0] and shorter[-1][1] <= longer[n - 1][1]


def majority(counts: list[tuple[int, tuple, int]]) -> frozenset:
    """The shapes that stay, of (length, shape, reads)."""
    groups: list[list] = []
    for _, shape, n in sorted((-size, shape, n) for size, shape, n in counts):
        joined = [g for g in groups if fits(shape, g[0])]
        for g in joined:
            g[1] += n
            g[2].append(shape)
        if not joined:
            groups.append([shape, n, [shape]])
    return frozenset(min(groups, key=lambda g: (-g[1], [(n, "MIDNSHP=X".find(op) + 1) for op, n in g[0]], g[2]))[2])


def majority_step(family: list[str], ops: str, seq: str, mapped: str | None) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        first = changes(batch, family)
        part = np.cumsum(first) - 1
        size = pc.binary_length(batch[seq]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        text = cigar_text(batch[ops]).dictionary_encode()
        kind = text.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        there = np.ones(len(part), bool)
        live = there
        if mapped is not None:
            there = batch[mapped].fill_null(False).to_numpy(zero_copy_only=False)
            live = there | (np.bincount(part[there], minlength=int(part[-1]) + 1) == 0)[part]
            kind = np.where(there, kind, 0)
        names = ["", *text.dictionary.to_pylist()]
        most = int(size.max()) + 1
        # distinct (alignment, length) of the batch get their shapes, distinct shapes their places
        pair, which = np.unique(kind * most + size, return_inverse=True)
        shapes = [simplified(names[p // most], int(p % most)) for p in pair.tolist()]
        entry, inverse, n = np.unique(part[live] * len(pair) + which[live], return_inverse=True, return_counts=True)
        owner, entry_pair = entry // len(pair), entry % len(pair)
        kept = np.ones(len(entry), bool)
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
        known: dict[tuple, frozenset] = {}
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(owner)], strict=True):
            if b - a > 1:
                key = (tuple(entry_pair[a:b].tolist()), tuple(n[a:b].tolist()))
                if key not in known:
                    merged: dict[tuple, int] = {}
                    for p, c in zip(*key, strict=True):
                        k = (int(pair[p] % most), shapes[p])
                        merged[k] = merged.get(k, 0) + c
                    known[key] = majority([(size_, shape, c) for (size_, shape), c in merged.items()])
                kept[a:b] = [shapes[p] in known[key] for p in key[0]]
        return batch.take(pa.array(np.flatnonzero(live)[kept[inverse]]))

    return step
