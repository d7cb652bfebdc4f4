"""Suffix-array dedup: maximal repeats from common-prefix intervals.

A string of LENGTH bytes that starts anywhere else too is a repeat; every byte that one covers is removed. Whether two places hold the same string is settled locally:

1. Each window of LENGTH bytes has an anchor: its leftmost GRAM-byte substring of least hash, the same wherever the window's content is the same. The windows of one anchor
   form a segment of a document. Anchors that occur once in the corpus can't be in a repeat.
2. Segments of equal content, by a cryptographic digest of 128 bits of their bytes, are repeats as a whole; from here on a content counts once, however many copies it has.
3. Different contents of an anchor may share part of their windows. Their contents make an enhanced suffix array; a stack scan of its common prefixes gives the tree
   of intervals, and an interval whose occurrences are preceded by different bytes is a maximal repeat group, output with all its occurrences.

An array takes the contents of one part whole. An anchor of more contents than a task should hold is parted first: windows that begin farther before the anchor share more bytes to its left, the others more to its
right, so the contents are cut in two halves of their windows and parted by the bytes that all windows of a half share. This goes on, at most until parts are of single windows, where contents that are
in one part are equal. The answers are the same at every limit; hashes only choose anchors, and no decision rests on them.

Before they go to the array, the contents of a part are narrowed to what any other may share: equal windows have their anchors at the same place, so no shared string reaches farther from the anchor than the longest prefix that
a content has in common with another to the right of the anchor, and to its left.

Defined results: a null text is empty; texts shorter than LENGTH keep all bytes; matches never cross documents; repeated rows are copies of each other; an empty table gives
an empty result; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.llm.neardup import mixed
from molframe.llm.rows import small_batches
from molframe.session import discard, scratch_tables, sweep, table, written

LENGTH, GRAM = 400, 64
#: Bytes of a string that counts as a shared passage: those of more than 50 words have about 280 at least.
PASSAGE = 250
#: Contents of a part that go to one suffix array at most, and bytes of contents of an array of several parts.
GROUP, ARRAY_BYTES = 1000, 1 << 18
#: Bytes of a document hashed at once.
BLOCK = 1 << 20
#: Rows of a frame that is handed back.
FRAME_ROWS = 20_000
_BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of an odd base modulo 2^64, and of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            fill = lambda b: np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, b, np.uint64))])
            self.up, self.down = fill(self.base), fill(self.inverse)

    def hashes(self, data: np.ndarray, size: int) -> np.ndarray:
        """A hash of each substring of `size` bytes, the same at every place."""
        self.grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return mixed((sums[size:] - sums[: len(data) - size + 1]) * self.down[: len(data) - size + 1])


def digests(parts: Iterable[bytes | memoryview]) -> np.ndarray:
    """A cryptographic digest of each part, as two numbers: parts of equal digests are taken as equal."""
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts]), np.int64).reshape(-1, 2)


class Segmenter:
    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.powers = length, gram, Powers(_BASE)

    def segments(self, data: bytes) -> tuple[np.ndarray, ...]:
        """(anchor, c1, c2, start, windows, offset): the anchor's hash, the digest of the content, the first window's start, the windows, the anchor's place from start."""
        parts = [self._block(data[k : k + BLOCK + self.length - 1], k) for k in range(0, max(len(data) - self.length + 1, 0), BLOCK)]
        if not parts:
            return tuple(np.empty(0, np.int64) for _ in range(6))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _block(self, data: bytes, begin: int) -> tuple[np.ndarray, ...]:
        h = self.powers.hashes(np.frombuffer(data, np.uint8), self.gram)
        least = (h & np.uint64(0xFFFFFFFFFE000000)) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost
        want, have = self.length - self.gram + 1, 1
        while have * 2 <= want:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < want:
            least = np.minimum(least[: len(least) - (want - have)], least[want - have :])
        at = (least & np.uint64(0x1FFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        windows = np.diff(first, append=len(at))
        end, whole = first + windows + self.length - 1, memoryview(data)
        content = digests(whole[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True))
        return h[at[first]].view(np.int64), content[:, 0], content[:, 1], first + begin, windows, at[first] - first


def suffix_array(contents: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, lcp, of, data): the suffixes of at least `least` bytes of all contents in order, as places in the joined data; the common prefix of each with the one before; the
    content each byte is of. A prefix ends with its content."""
    size = np.array([len(c) for c in contents])
    data = np.frombuffer(b"".join(contents), np.uint8)
    of = np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # bytes from a place to its content's end
    code = np.zeros(len(data), np.int64)
    for k in range(7):  # the first ranks: 7 symbols of 9 bits, 0 after the end
        inside = left > k
        code = (code << 9) | np.where(inside, np.concatenate([data[k:], np.zeros(k, np.uint8)])[: len(data)].astype(np.int64) + 1, 0)
    wide = 3 if len(data) < 1 << 20 else 2  # ranks that one number holds
    places = np.flatnonzero(left >= least)

    def joined(rank: np.ndarray, step: int, at: np.ndarray | slice) -> np.ndarray:
        """From ranks of `step` bytes, a code of `wide` times as many."""
        out = rank[at]
        for k in range(step, wide * step, step):
            after = np.concatenate([rank[k:], np.zeros(min(k, len(rank)), np.int64)])
            out = out * (len(data) + 2) + np.where(left[at] > k, after[at] + 1, 0)
        return out

    ranks, step, rank = [(1, data)], 7, _ranks(code)
    while step * wide < size.max():
        ranks.append((step, rank.astype(np.int32)))
        rank, step = _ranks(joined(rank, step, slice(None))), step * wide
    ranks.append((step, rank.astype(np.int32)))
    places = places[np.argsort(joined(rank, step, places))]  # the last round needs no others
    a, b = places[:-1], places[1:]
    most = np.minimum(left[a], left[b])
    lcp = np.zeros(len(a), np.int64)
    for step, rank in reversed(ranks):  # equal blocks of falling length
        live = np.arange(len(a))
        while len(live):
            live = live[lcp[live] + step <= most[live]]
            live = live[rank[a[live] + lcp[live]] == rank[b[live] + lcp[live]]]
            lcp[live] += step
    return places, np.concatenate([[0], lcp])[: len(places)], of, data


def _ranks(code: np.ndarray) -> np.ndarray:
    order = np.argsort(code)
    fresh = np.diff(code[order], prepend=code[order[0]]) != 0
    out = np.empty(len(code), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def maximal_repeats(contents: list[bytes], least: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, contents, starts) of every maximal repeat group of at least `least` bytes: all occurrences of a string that can be extended neither to the left nor to the right
    without losing one."""
    if not contents:
        return []
    places, lcp, of, data = suffix_array(contents, least)
    size = np.array([len(c) for c in contents])
    start = places - (np.cumsum(size) - size)[of[places]]
    before = np.where(start > 0, data[np.maximum(places - 1, 0)].astype(np.int64), -1 - of[places])  # a content's begin is unlike all else
    change = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])  # equal over an interval without diversity to the left
    out = []
    deep = np.concatenate([[False], lcp >= least, [False]])
    first, last = np.flatnonzero(deep[1:-1] & ~deep[:-2]), np.flatnonzero(deep[1:-1] & ~deep[2:])
    diverse = change[last] != change[first - 1]  # the others have no maximal repeats
    for begin, end in zip(first[diverse].tolist(), last[diverse].tolist(), strict=True):  # suffixes begin-1 .. end share at least `least` bytes
        stack = []  # of (common prefix, first suffix)
        for k, value in zip(range(begin, end + 2), [*lcp[begin : end + 1].tolist(), 0], strict=True):
            low = k - 1
            while stack and stack[-1][0] > value:
                length, low = stack.pop()
                if change[k - 1] != change[low]:
                    out.append((length, of[places[low:k]], start[low:k]))
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, low))
    return out


def common(a: bytes, b: bytes) -> int:
    """Bytes of the longest common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def narrowed(contents: list[bytes], offsets: list[int], least: int) -> list[tuple[int, int]]:
    """(start, end) in each content of a part: all strings of at least `least` bytes around the anchor, which is at its offset, that another content has around its anchor are inside; (0, 0) if there are none."""
    reach = []
    for sides in ([c[:k][::-1] for c, k in zip(contents, offsets, strict=True)], [c[k:] for c, k in zip(contents, offsets, strict=True)]):
        order = sorted(range(len(sides)), key=sides.__getitem__)
        near = [0, *[common(sides[a], sides[b]) for a, b in pairwise(order)], 0]  # in order, the most alike stand side by side
        most = [0] * len(sides)
        for k, c in enumerate(order):
            most[c] = max(near[k], near[k + 1])
        reach.append(most)
    return [(k - a, k + b) if a + b >= least else (0, 0) for k, a, b in zip(offsets, *reach, strict=True)]


def covered(repeats: list[tuple[int, np.ndarray, np.ndarray]], n: int) -> list[list[tuple[int, int]]]:
    """Spans of each of n contents that repeats cover, merged."""
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for length, which, starts in repeats:
        for c, s in zip(which.tolist(), starts.tolist(), strict=True):
            spans[c].append((s, s + length))
    return [merged(x) for x in spans]


def long_runs(bounds: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of at least `length` bytes that spans cover without a gap, from start, end, start, end and so on."""
    start, end = np.asarray(bounds, np.int64).reshape(-1, 2).T
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]])[: len(start)])
    last = np.append(first[1:], len(start))[: len(first)] - 1
    return [(a, b) for a, b in zip(start[first].tolist(), reach[last].tolist(), strict=True) if b - a >= length]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _keyed(df: DataFrame, text_col: str, *more) -> DataFrame:
    """node: a digest of the text, the same for all copies of it."""
    small_batches(df)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(*more, F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32)).alias("node"), text.alias("text"))


def _node() -> Column:
    """The digest of a text from n1 and n2, the numbers that it goes by where rows are many."""
    return F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("n1", "n2")]))


def _frames(names: str, parts: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    """Frames of about FRAME_ROWS rows from (digest of a text, arrays of the columns after n1 and n2)."""
    held: list[tuple] = []
    rows = 0

    def frame() -> pd.DataFrame:
        nodes = np.frombuffer(b"".join(bytes(p[0]) for p in held), ">i8").astype(np.int64).reshape(-1, 2)
        nodes = np.repeat(nodes, [len(p[1]) for p in held], axis=0)
        return pd.DataFrame(dict(zip(names.split(), [nodes[:, 0], nodes[:, 1], *(np.concatenate(x) for x in list(zip(*held, strict=True))[1:])], strict=True)))

    for part in parts:
        if len(part[1]):
            held.append(part)
            rows += len(part[1])
        if rows >= FRAME_ROWS:
            yield frame()
            held, rows = [], 0
    if held:
        yield frame()


CONTENT = ["c1", "c2"]


def _occurrences(texts: DataFrame, length: int, gram: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """(met, found) of texts (node, text, and perhaps runs: bounds of the byte spans outside which no repeat is looked for). met (n1, n2, anchor, c1, c2, start, windows, offset): the segments whose anchors occur more than once. found (c1, c2, start, end, s1, s2): the strings in the contents that are repeats; a content that has
    copies is one as a whole. Unless every, contents with copies have no further rows, and overlapping spans of the others are merged, with null digests s1, s2."""

    def cut(batches):
        own = Segmenter(length, gram)

        def parts():
            for pdf in batches:
                for node, text, *runs in zip(*(pdf[c] for c in pdf.columns), strict=True):
                    data = text.encode()
                    for a, b in long_runs(*runs, length) if runs else [(0, len(data))]:
                        anchor, c1, c2, start, windows, offset = own.segments(data[a:b])
                        yield node, anchor, c1, c2, start + a, windows, offset

        yield from _frames("n1 n2 anchor c1 c2 start windows offset", parts())

    long = texts.filter(F.octet_length("text") >= length)
    texts = texts.select("node", "text")
    segments = written(long.mapInPandas(cut, "n1 long, n2 long, anchor long, c1 long, c2 long, start int, windows int, offset int"), "segments")
    often = written(segments.groupBy("anchor").count().filter("count > 1").select("anchor"), "anchors")
    met = written(segments.join(often.hint("shuffle_hash"), "anchor", "left_semi"), "met")
    discard(segments, often)
    # a row for each different content (its bytes give its anchor): what only one text has needs a closer look if its anchor has others
    one = [F.any_value(c).alias(c) for c in ("n1", "n2", "start", "windows", "offset")]  # of one and the same row; numbers alone need no sort
    own = written(met.groupBy("anchor", *CONTENT).agg(F.count("*").alias("copies"), *one), "contents")
    many = written(own.groupBy("anchor").agg(F.count("*").alias("contents"), F.min("copies").alias("least")).filter((F.col("contents") > 1) & (F.lit(every) | (F.col("least") == 1))).select("anchor", "contents"), "parts")
    zero = F.lit(0)
    look = written(_with_bytes(texts, own.join(many, "anchor"), length).select(F.col("anchor").alias("k1"), zero.cast("long").alias("k2"), zero.alias("low"), F.lit(length - gram + 1).alias("high"), "contents", F.col("c1").alias("d1"), F.col("c2").alias("d2"), *CONTENT, zero.alias("first"), "offset", "copies", "bytes"), "look")
    found = [own.filter("copies > 1").select(*CONTENT, zero.alias("start"), (F.col("windows") + (length - 1)).cast("int").alias("end"), F.col("c1").alias("s1"), F.col("c2").alias("s2"))]
    pieces = None
    while True:
        small = look.filter(F.col("contents") <= GROUP).repartition("k1", "k2").sortWithinPartitions("k1", "k2")
        inside = written(small.mapInPandas(_arrays(length, every), f"{KEYS}, first int, start int, end int, s1 long, s2 long"), "found")
        if every and pieces is not None:  # the piece's other owners too
            inside = inside.drop(*CONTENT, "first").join(pieces, [*PART, "d1", "d2"])
        found.append(inside.select(*CONTENT, (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("end")).alias("end"), "s1", "s2"))
        large = look.filter(F.col("contents") > GROUP)
        if large.isEmpty():
            discard(look)
            break
        was = look
        pieces, alike, look = _halved(large, length, every)
        discard(was)
        # without every, what stands in contents with copies is known already
        owners = pieces.filter(F.lit(every) | (F.col("copies") == 1)).join(alike, [*PART, "d1", "d2"])
        found.append(owners.select(*CONTENT, F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("end"), F.col("d1").alias("s1"), F.col("d2").alias("s2")))
    return met, reduce(DataFrame.union, found)


PART = ["k1", "k2"]
KEYS = "k1 long, k2 long, d1 long, d2 long, c1 long, c2 long"


def _with_bytes(texts: DataFrame, contents: DataFrame, length: int) -> DataFrame:
    """contents with their bytes, from one of the texts they are in."""
    columns = ["anchor", "c1", "c2", "contents", "copies", "offset"]
    wanted = written(contents.groupBy("n1", "n2").agg(F.collect_list(F.struct(*columns, "start", "windows")).alias("wanted")).select(_node().alias("node"), "wanted"), "wanted")

    def take(batches):
        for pdf in batches:
            rows = []
            seen = set()
            for node, text, wanted in zip(pdf["node"], pdf["text"], pdf["wanted"], strict=True):
                if bytes(node) in seen:
                    continue
                seen.add(bytes(node))
                data = text.encode()
                rows += [(*[w[c] for c in columns], data[w["start"] : w["start"] + w["windows"] + length - 1]) for w in wanted]
            out = pd.DataFrame(rows, columns=[*columns, "bytes"])
            if (digests(out["bytes"]) != out[CONTENT].to_numpy(np.int64)).any():
                raise ValueError("a content isn't where its row says")
            yield out

    got = texts.join(wanted, "node").mapInPandas(take, "anchor long, c1 long, c2 long, contents long, copies long, offset int, bytes binary")
    return got.dropDuplicates(CONTENT)


def _halved(large: DataFrame, length: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contents of large parts cut in halves of their windows, each parted by the bytes that its windows share. (pieces: part, digest and owner of every piece, its first window, size and owner's copies; alike: the pieces that are there more
    than once; look: a row for each different piece of the parts that need a closer look)."""

    def split(batches):
        for pdf in batches:
            rows = []
            for k1, k2, low, high, c1, c2, first, offset, copies, data in zip(*(pdf[c].tolist() for c in ("k1", "k2", "low", "high", "c1", "c2", "first", "offset", "copies", "bytes")), strict=True):
                data, half, part = bytes(data), (low + high) // 2, f"{k1} {k2} ".encode()
                nearest = offset - (len(data) - length)  # the last window's distance before the anchor
                for begin, end in ((low, half), (half, high)):
                    near, far = max(begin, nearest), min(end - 1, offset)
                    if near <= far:
                        shared = data[offset - begin : offset - (end - 1) + length]
                        rows.append((part + b"%d " % begin + shared, begin, end, c1, c2, first + offset - far, far, copies, data[offset - far : offset - near + length]))
            out = pd.DataFrame(rows, columns=["shared", "low", "high", "c1", "c2", "first", "offset", "copies", "bytes"])
            key, own = digests(out.pop("shared")), digests(out["bytes"])
            yield out.assign(k1=key[:, 0], k2=key[:, 1], d1=own[:, 0], d2=own[:, 1])

    columns = "k1 long, k2 long, d1 long, d2 long, low int, high int, c1 long, c2 long, first int, offset int, copies long, bytes binary"
    cut = written(large.mapInPandas(split, columns), "halves")
    pieces = cut.select(*PART, "d1", "d2", *CONTENT, "first", F.octet_length("bytes").alias("size"), "copies")
    one = F.any_value(F.struct(*CONTENT, "low", "high", "first", "offset", "bytes")).alias("one")
    different = written(cut.groupBy(*PART, "d1", "d2").agg(F.sum("copies").alias("copies"), one), "pieces")
    parts = written(different.groupBy(*PART).agg(F.count("*").alias("contents"), F.min("copies").alias("least")).filter((F.col("contents") > 1) & (F.lit(every) | (F.col("least") == 1))).select(*PART, "contents"), "parts")
    look = different.join(parts, PART).select(*PART, "one.low", "one.high", "contents", "d1", "d2", "one.c1", "one.c2", "one.first", "one.offset", "copies", "one.bytes")
    return pieces, different.filter("copies > 1").select(*PART, "d1", "d2"), written(look, "look")


def _arrays(length: int, every: bool) -> Callable:
    """Suffix arrays over whole parts, narrowed, as many as ARRAY_BYTES hold; rows come sorted by part."""

    def solve(rows):
        contents = [r[-1] for r in rows]
        groups = maximal_repeats(contents, length)
        if every:
            keys = digests(contents[which[0]][starts[0] : starts[0] + n] for n, which, starts in groups)
            at = [(c, rows[c][-2] + s, rows[c][-2] + s + n, *key) for (n, which, starts), key in zip(groups, keys.tolist(), strict=True) for c, s in zip(which.tolist(), starts.tolist(), strict=True)]
        else:
            at = [(c, rows[c][-2] + a, rows[c][-2] + b, None, None) for c, spans in enumerate(covered(groups, len(rows))) if rows[c][-3] == 1 for a, b in spans]
        out = pd.DataFrame([(*rows[c][:7], *x) for c, *x in at], columns=["k1", "k2", "d1", "d2", "c1", "c2", "first", "start", "end", "s1", "s2"])
        return out.astype({"s1": "Int64", "s2": "Int64"})

    def narrow(part):
        spans = narrowed([r[-1] for r in part], [r[-2] for r in part], length)
        return [(*r[:-2], a, r[-1][a:b]) for r, (a, b) in zip(part, spans, strict=True) if b > a]

    def rows(batches):
        for pdf in batches:
            yield from zip(*(pdf[c].tolist() for c in ("k1", "k2", "d1", "d2", "c1", "c2", "first", "copies", "offset")), map(bytes, pdf["bytes"]), strict=True)

    def run(batches):
        held, size = [], 0
        for _, part in groupby(rows(batches), lambda r: r[:2]):
            part = narrow(list(part))
            held += part
            size += sum(len(r[-1]) for r in part)
            if size > ARRAY_BYTES:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)

    return run


def repeat_spans(df: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(node, spans array<struct<start, end>>): byte spans, not yet merged, that repeats cover in the texts of digest node."""
    return _spans(_keyed(df, text_col), length, gram)


def _spans(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """repeat_spans of texts as _occurrences takes them."""
    before = scratch_tables()
    met, found = _occurrences(texts, length, gram, every=False)
    at = met.select(*CONTENT, "n1", "n2", F.col("start").alias("base")).join(found.hint("shuffle_hash"), CONTENT)
    span = F.struct((F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"))
    spans = written(at.select("n1", "n2", span.alias("span")).distinct().groupBy("n1", "n2").agg(F.collect_list("span").alias("spans")).select(_node().alias("node"), "spans"), "spans")
    sweep(texts.sparkSession, before, spans)
    return spans


def repeat_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(string binary: a digest, size, id, start): a row for every occurrence of each maximal repeat group, rows of equal texts included. A group's string is maximal among the windows that share an anchor, or a part of one: longer
    repeats are groups that overlap, and together the groups cover all that occurs more than once."""
    met, found = _occurrences(_keyed(df, text_col), length, gram, every=True)
    at = met.select(*CONTENT, _node().alias("node"), F.col("start").alias("base")).join(found, CONTENT)
    key = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("s1", "s2")]))
    groups = at.select(key.alias("string"), (F.col("end") - F.col("start")).alias("size"), "node", (F.col("base") + F.col("start")).alias("start")).distinct()
    rows = _keyed(df, text_col, F.col(id_col).alias("id")).select("id", "node")
    return written(groups, "groups").join(rows, "node").select("string", "size", F.col("id").alias(id_col), "start")


CUT = "n_removed long, spans array<struct<start:int,end:int>>, kept_sha256 string, kept string"


def _without(texts: bool) -> Callable:
    """A column function of text and spans, both null for texts that keep all: what is left, as CUT says."""

    @F.pandas_udf(CUT)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text_column, spans_column in batches:
            out = []
            for text, spans in zip(text_column, spans_column, strict=True):
                if spans is None:
                    out.append((None, None, None, None))
                    continue
                data, kept, at = text.encode(), [], 0
                gone = merged([(s["start"], s["end"]) for s in spans])
                for x, y in gone:
                    kept.append(data[at:x])
                    at = y
                left = b"".join([*kept, data[at:]])
                out.append((len(data) - len(left), [{"start": x, "end": y} for x, y in gone], hashlib.sha256(left).hexdigest(), left.decode(errors="ignore") if texts else None))
            yield pd.DataFrame(out, columns=["n_removed", "spans", "kept_sha256", "kept"]).astype({"n_removed": "Int64"})

    return cut.asNondeterministic()  # else the optimizer may cut once for each part of the answer


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """(id, the columns of keep, n_bytes, n_removed, spans array<struct<start, end>> merged, kept_sha256, and with texts: kept, the remaining bytes as text, those cut within a character left out). Only texts that lose bytes go to Python."""
    named = {id_col: "id_"} | {c: f"keep_{i}" for i, c in enumerate(keep) if c != id_col}
    return _removed(_keyed(df, text_col, *[F.col(c).alias(n) for c, n in named.items()]), repeat_spans(df, text_col, length, gram), named, texts)


def _removed(rows: DataFrame, spans: DataFrame, named: dict[str, str], texts: bool = False) -> DataFrame:
    """remove_repeats of rows (node, text, and what named has by the answer's column) without the spans of their nodes."""
    rows = rows.join(spans.withColumnRenamed("spans", "found_"), "node", "left")
    rows = rows.withColumn("cut_", _without(texts)(F.when(F.col("found_").isNotNull(), F.col("text")), F.col("found_")))
    whole = F.array().cast("array<struct<start:int,end:int>>")
    return rows.select(
        *[F.col(n).alias(c) for c, n in named.items()],
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.coalesce("cut_.n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("cut_.spans", whole).alias("spans"),
        F.coalesce("cut_.kept_sha256", F.sha2(F.col("text").cast("binary"), 256)).alias("kept_sha256"),
        *[F.when(F.col("found_").isNull(), F.col("text")).otherwise(F.col("cut_.kept")).alias("kept")][: int(texts)],
    )


def cover(spans: Column) -> Column:
    """struct<total, longest>: the bytes that spans cover, and those of their longest run without a gap."""
    start = F.struct(F.lit(0).alias("begin"), F.lit(0).alias("reach"), F.lit(0).alias("total"), F.lit(0).alias("longest"))

    def step(s: Column, x: Column) -> Column:
        begin = F.when(x["start"] > s["reach"], x["start"]).otherwise(s["begin"])
        reach = F.greatest(s["reach"], x["end"])
        total = s["total"] + F.greatest(reach - F.greatest(s["reach"], x["start"]), F.lit(0))
        return F.struct(begin.alias("begin"), reach.alias("reach"), total.alias("total"), F.greatest(s["longest"], reach - begin).alias("longest"))

    done = F.aggregate(F.array_sort(spans), start, step)
    return F.transform(F.array(done), lambda x: F.struct(x["total"].alias("total"), x["longest"].alias("longest")))[0]


def repeats_and_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """remove_repeats with n_shared: the bytes covered by shorter strings too, of `passage` bytes, that start anywhere else; these stay in the text.

    The shorter strings are looked for first. A string of `length` bytes that starts elsewhere lies in a run of them at each place, so only runs of that size need a second look."""
    small_batches(df)
    near = repeat_spans(df, text_col, passage, min(gram, passage // 5))
    rows = _keyed(df, text_col, F.col(id_col).alias("id_")).join(near.select("node", "spans", cover(F.col("spans")).alias("cover_")), "node", "left")
    bounds = F.when(F.col("cover_.longest") >= length, F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["end"])))).alias("runs")
    shared = F.coalesce("cover_.total", F.lit(0)).cast("long").alias("shared_")
    rows = written(rows.select("id_", "node", "text", shared, bounds), "passages")
    spans = _spans(rows.filter(F.col("runs").isNotNull()).select("node", "text", "runs"), length, gram)
    cut = _removed(rows.filter(F.col("runs").isNotNull()).drop("runs"), spans, {"id_": "id_", "shared_": "shared_"})
    kept = F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    rest = rows.filter(F.col("runs").isNull()).select("id_", "shared_", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), kept)
    return cut.unionByName(rest).select(F.col("id_").alias(id_col), "n_bytes", "n_removed", "spans", "kept_sha256", F.col("shared_").alias("n_shared"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats_and_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_shared")
