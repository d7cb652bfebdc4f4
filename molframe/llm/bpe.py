"""Byte-level BPE encoding and decoding.

Every match of the pre-token pattern is encoded on its own. The distinct pre-tokens of a block of
documents become rows of padded matrices, bucketed by length; in each round every row merges its leftmost
pair of minimum rank, found by hashed pair lookup, and finished rows are compacted away.

Defined results: a null or empty text has no ids; ranks ties go to the leftmost pair; a text of any length is
encoded whole, block by block; extra input columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.llm.rows import back, sent, sent_type, small_batches
from molframe.session import table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of text whose pre-tokens are held at once, and pre-tokens remembered by a worker.
BLOCK_CHARS, REMEMBERED = 2_000_000, 300_000
#: Rows wider than this are merged alone, all occurrences of the minimum pair in a round.
WIDE = 128

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Texts of only these characters are split by an equal pattern of the faster standard module.
_PLAIN = re.compile(f"[\t\n\r -~{_LETTERS}]*")
_PLAIN_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+")


class PairTable:
    """Open-addressed hash table from a pair of ids to the id of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right
        slot = self.slot(key)
        todo = np.arange(len(key))
        while len(todo):  # the first claimant of a free slot gets it, the others move on
            free = self.keys[slot[todo]] == -1
            first = np.zeros(len(todo), bool)
            _, at = np.unique(slot[todo][free], return_index=True)
            first[np.flatnonzero(free)[at]] = True
            won = todo[first]
            self.keys[slot[won]], self.values[slot[won]] = key[won], merged[won]
            todo = todo[~first]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, NONE where there is none (or an id is negative)."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -2
        slot = self.slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        todo = np.flatnonzero((found != key) & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


NONE = np.iinfo(np.int32).max


class Codec:
    """Encodes and decodes by a rank file; ids are ranks."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        self.pattern = regex.compile(pattern)
        self.plain = pattern == public_tokenizers.PATTERN
        self.token = {i: t for t, i in self.ranks.items()}
        self.token_of_text = {str(i): t for i, t in self.token.items()}
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[a], self.ranks[b], i) for t, i in self.ranks.items() for k in range(1, len(t)) if (a := t[:k]) in self.ranks and (b := t[k:]) in self.ranks]
        self.pairs = PairTable(*np.array(pairs or np.empty((0, 3)), np.int64).T)
        self.known: dict[str, str] = {}

    def split(self, text: str) -> list[str]:
        return (_PLAIN_PATTERN if self.plain and _PLAIN.fullmatch(text) else self.pattern).findall(text)

    def encode_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        """Ids of each row of bytes."""
        out: list = [None] * len(rows)
        buckets: dict[int, list[int]] = {}
        for i, row in enumerate(rows):
            if (whole := self.ranks.get(row)) is not None:
                out[i] = np.array([whole], np.int32)
            elif len(row) > WIDE:
                out[i] = self.encode_wide(row)
            else:
                buckets.setdefault(1 << max(2, (len(row) - 1).bit_length()), []).append(i)
        for width, members in buckets.items():
            for k in range(0, len(members), 65536):
                self.encode_bucket([rows[i] for i in members[k : k + 65536]], members[k : k + 65536], width, out)
        return out

    def encode_bucket(self, rows: list[bytes], members: list[int], width: int, out: list) -> None:
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        length = np.array([len(r) for r in rows])
        ids = np.where(np.arange(width) < length[:, None], self.byte_id[raw], -1).astype(np.int32)
        member = np.array(members)
        rank = self.pairs.merge(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while len(member):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(member), np.int64)
            line = np.arange(len(member))
            least = rank[line, at] if rank.shape[1] else np.full(len(member), NONE)
            done = least == NONE
            if done.any():
                for i, row, n in zip(member[done].tolist(), ids[done], length[done].tolist(), strict=True):
                    out[i] = row[:n]
                live = ~done
                ids, rank, length, member, at, least = ids[live], rank[live], length[live], member[live], at[live], least[live]
                line = np.arange(len(member))
                if not len(member):
                    return
            ids[line, at] = least
            keep = np.ones(ids.shape, bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(len(member), -1)
            keep = np.ones(rank.shape, bool)
            keep[line, at] = False
            rank = rank[keep].reshape(len(member), -1)
            length = length - 1
            right = at < rank.shape[1]
            rank[line[right], at[right]] = self.pairs.merge(ids[line[right], at[right]], ids[line[right], at[right] + 1])
            left = at > 0
            rank[line[left], at[left] - 1] = self.pairs.merge(ids[line[left], at[left] - 1], ids[line[left], at[left]])

    def encode_wide(self, row: bytes) -> np.ndarray:
        """One long row. A round merges the leftmost minimum pair and, as far as no merge makes a pair of a still lower rank, the further ones of that rank."""
        ids = self.byte_id[np.frombuffer(row, np.uint8)]
        rank = self.pairs.merge(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) != NONE:
            at = np.flatnonzero(rank == least)
            run = np.cumsum(np.diff(at, prepend=-2) != 1)
            at = at[(at - at[np.searchsorted(run, run)]) % 2 == 0]  # every other one of pairs that overlap
            new = np.full(len(at), least, np.int32)
            before = np.where(at > 0, ids[at - 1], -1)
            joined = np.flatnonzero(np.diff(at, prepend=-9) == 2)
            before[joined] = least
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            low = np.minimum(self.pairs.merge(before, new), self.pairs.merge(new, after)) < least
            if low.any():
                at = at[: low.argmax() + 1]
            ids[at] = least
            ids = np.delete(ids, at + 1)
            at = at - np.arange(len(at))
            rank = np.delete(rank, at + np.arange(len(at)))
            for near in (at - 1, at):
                near = near[(near >= 0) & (near < len(rank))]
                rank[near] = self.pairs.merge(ids[near], ids[near + 1])
        return ids

    def learn(self, pieces: Iterable[str]) -> None:
        """Adds the ids of new pre-tokens, as decimal text, to what this worker remembers."""
        new = [p for p in pieces if p not in self.known]
        for piece, ids in zip(new, self.encode_rows([p.encode() for p in new]), strict=True):
            self.known[piece] = ",".join(map(str, ids.tolist()))

    def encode_texts(self, texts: Iterable[str | None]) -> Iterator[str]:
        """Ids of each text as decimals joined by commas."""
        block: list[list[str]] = []
        held = 0
        for text in texts:
            block.append(self.split(text) if text else [])
            held += len(text or "")
            if held >= BLOCK_CHARS:
                yield from self._encode_block(block)
                block, held = [], 0
        yield from self._encode_block(block)

    def _encode_block(self, block: list[list[str]]) -> Iterator[str]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        distinct: set[str] = set()
        for pieces in block:
            distinct.update(pieces)
        self.learn(distinct)
        for pieces in block:
            yield ",".join(map(self.known.__getitem__, pieces))

    def decode_text(self, ids: str) -> bytes:
        """The bytes of ids given as decimals joined by commas."""
        return b"".join(map(self.token_of_text.__getitem__, ids.split(","))) if ids else b""


@lru_cache(2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def _where(ranks_path: str | None, pattern: str | None) -> tuple[str, str]:
    return ranks_path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = (), decode: bool = False) -> DataFrame:
    """(id, the columns of keep, n_tokens long, ids array<int>) of every text; with decode also decoded, the text that the ids give."""
    where = _where(ranks_path, pattern)
    small_batches(df)

    def run(batches):
        own = codec(*where)
        for pdf in batches:
            texts = list(own.encode_texts(pdf["text_"]))
            ids = [np.array(x.split(","), np.int32) if x else np.empty(0, np.int32) for x in texts]
            out = pdf.drop(columns="text_").assign(n_tokens=[len(x) for x in ids], ids=ids)
            yield out.assign(decoded=[own.decode_text(x).decode() for x in texts]) if decode else out

    named = {id_col: "id_"} | {c: f"keep_{i}" for i, c in enumerate(keep) if c != id_col}
    chosen = df.select(*[sent(df, c).alias(n) for c, n in named.items()], F.col(text_col).alias("text_"))
    shape = ", ".join(f"{n} {sent_type(df, c)}" for c, n in named.items())
    out = chosen.mapInPandas(run, f"{shape}, n_tokens long, ids array<int>{', decoded string' * decode}")
    return out.select(*[back(df, c, n) for c, n in named.items()], "n_tokens", "ids", *["decoded"][: int(decode)])


def bpe_decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, decoded binary) of every array of ids; null ids decode to no bytes."""
    where = _where(ranks_path, pattern)

    def run(batches):
        token = codec(*where).token
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "decoded": [b"".join(map(token.__getitem__, [] if x is None else list(x))) for x in pdf["ids"]]})

    out = df.select(sent(df, id_col).alias("id"), F.col(ids_col).alias("ids")).mapInPandas(run, f"id {sent_type(df, id_col)}, decoded binary")
    return out.select(back(df, id_col, "id"), "decoded")


def bpe_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes, decodes the ids and digests both, in one pass without moving the ids: (id, n_tokens, ids_sha256, decoded_sha256)."""
    where = _where(ranks_path, pattern)
    small_batches(df)

    def run(batches):
        own = codec(*where)
        for pdf in batches:
            rows = [(x.count(",") + 1 if x else 0, hashlib.sha256(x.encode()).hexdigest(), hashlib.sha256(own.decode_text(x)).hexdigest()) for x in own.encode_texts(pdf["text"])]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    out = df.select(sent(df, id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {sent_type(df, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(back(df, id_col, "id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))
