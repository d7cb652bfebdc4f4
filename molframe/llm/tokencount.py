"""Token counts by dynamic programming over a trie.

The distinct pre-tokens of a block of documents form a trie of bytes. Level by level, each node (a prefix that any number of pre-tokens share) gets
its forward score once: the best log-probability of a unigram segmentation of the prefix, and the tokens in it. Walkers run the
vocabulary's own trie alongside, from every node where a token may begin. Where a pre-token ends, the count is stored.

A pre-token of more than CHAIN bytes shares next to nothing, so it gets the same scores along its own chain, without a round for every byte.

A token's log-probability falls as the logarithm of its rank; single bytes, the fallback, have the least. Of segmentations that score alike the one with
fewest tokens counts. Defined results: a null or empty text has no tokens; texts of any length are counted whole; extra input columns are ignored;
repeated rows count alike.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.llm.bpe import BLOCK_CHARS, NONE, RANKS, REMEMBERED, PairTable, codec
from molframe.llm.rows import back, sent, sent_type, small_batches
from molframe.session import table


#: Bytes of a pre-token that goes through the trie, at most; starts of tokens in a long one that are looked up at once.
CHAIN, STARTS = 1000, 1 << 16


def unigram_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    floor = -float(np.log(len(ranks))) - 1
    return {t: floor if len(t) == 1 else -float(np.log(r + 1)) for t, r in ranks.items()}


class Counter:
    def __init__(self, scores: dict[bytes, float]):
        """scores must have all 256 bytes."""
        node, left, right, merged, self.score = {b"": 0}, [], [], [], [np.nan]
        for token in sorted(scores):
            for k in range(1, len(token) + 1):
                if token[:k] not in node:
                    node[token[:k]] = len(self.score)
                    left.append(node[token[: k - 1]])
                    right.append(token[k - 1])
                    merged.append(len(self.score))
                    self.score.append(np.nan)
            self.score[node[token]] = scores[token]
        self.score = np.array(self.score)
        self.step = PairTable(np.array(left), np.array(right), np.array(merged))
        self.known: dict[str, int] = {}

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens in the best segmentation of each word."""
        out = np.zeros(len(words), np.int64)
        for i in (i for i, w in enumerate(words) if len(w) > CHAIN):
            out[i] = self.chain(words[i])
        order = sorted((i for i, w in enumerate(words) if len(w) <= CHAIN), key=words.__getitem__)
        size = np.array([len(words[i]) for i in order], np.int64)
        flat = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        start = np.cumsum(size) - size
        live = np.arange(len(order))  # words that reach the level, in sorted order
        node = np.zeros(len(order), np.int64)  # of each live word
        best, tokens = np.zeros(1), np.zeros(1, np.int64)
        at, from_best, from_tokens, state = (np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int32))  # walkers, sorted by node
        depth = 0
        place = np.array(order, np.int64)
        while True:
            done = size[live] == depth
            out[place[live[done]]] = tokens[node[done]]
            live, node = live[~done], node[~done]
            if not len(live):
                return out
            byte = flat[start[live] + depth]
            fresh = np.ones(len(live), bool)  # a child begins where the parent or the byte changes
            fresh[1:] = (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])
            parent, edge = node[fresh], byte[fresh]
            child = np.cumsum(fresh) - 1
            # walkers of the parents, for each child, and one that begins at the parent
            low, high = np.searchsorted(at, parent, "left"), np.searchsorted(at, parent, "right")
            many = high - low
            of = np.repeat(np.arange(len(parent)), many + 1)
            inner = np.arange(len(of)) - np.repeat(np.cumsum(many + 1) - (many + 1), many + 1)
            newcomer = inner == many[of]
            from_ = np.where(newcomer, 0, low[of] + inner)
            state = np.where(newcomer, 0, state[from_] if len(state) else 0)
            from_best, from_tokens = (np.where(newcomer, own[parent[of]], was[from_] if len(was) else 0) for own, was in ((best, from_best), (tokens, from_tokens)))
            state = self.step.merge(state, edge[of].astype(np.int32))
            on = state != NONE
            at, state, from_best, from_tokens = of[on], state[on], from_best[on], from_tokens[on]
            here = from_best + self.score[state]
            here = np.where(np.isnan(here), -np.inf, here)
            first = np.searchsorted(at, np.arange(len(parent)))
            best = np.maximum.reduceat(here, first)
            tokens = np.minimum.reduceat(np.where(here == best[at], from_tokens + 1, np.iinfo(np.int64).max), first)
            node, depth = child, depth + 1

    def chain(self, word: bytes) -> int:
        """The same for one long word: the tokens at all starts of a block are looked up together, then scores go along the word."""
        flat, n = np.frombuffer(word, np.uint8).astype(np.int32), len(word)
        best, tokens = [-np.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for k in range(0, n, STARTS):
            at, state, depth, found = np.arange(k, min(n, k + STARTS)), np.zeros(min(n - k, STARTS), np.int32), 0, []
            while len(at):
                state = self.step.merge(state, flat[at + depth])
                on = state != NONE
                at, state, depth = at[on], state[on], depth + 1
                token = ~np.isnan(self.score[state])
                found.append((at[token], np.full(np.count_nonzero(token), depth), self.score[state[token]]))
                inside = at + depth < n
                at, state = at[inside], state[inside]
            start, size, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(start, kind="stable")
            for a, b, v in zip(start[order].tolist(), (start + size)[order].tolist(), score[order].tolist(), strict=True):
                here, count = best[a] + v, tokens[a] + 1
                if here > best[b] or (here == best[b] and count < tokens[b]):
                    best[b], tokens[b] = here, count
        return tokens[n]

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        self.known.update(zip(new, self.counts([p.encode() for p in new]).tolist(), strict=True))


@lru_cache(2)
def _counter(ranks_path: str, pattern: str) -> Counter:
    return Counter(unigram_scores(codec(ranks_path, pattern).ranks))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n_pretokens, n_tokens) of every whole text."""
    where = ranks_path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    small_batches(df)

    def run(batches):
        own, split = _counter(*where), codec(*where).split
        for pdf in batches:
            rows: list[tuple[int, int]] = []
            block: list[list[str]] = []
            held = 0
            for i, text in enumerate(pdf["text"]):
                block.append(split(text) if text else [])
                held += len(text or "")
                if held >= BLOCK_CHARS or i == len(pdf) - 1:
                    if len(own.known) > REMEMBERED:
                        own.known.clear()
                    own.learn(set().union(*block))
                    rows += [(len(b), sum(map(own.known.__getitem__, b))) for b in block]
                    block, held = [], 0
            out = pd.DataFrame(rows, columns=["n_pretokens", "n_tokens"], dtype=np.int64)
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    out = df.select(sent(df, id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {sent_type(df, id_col)}, n_pretokens long, n_tokens long")
    return out.select(back(df, id_col, "id"), "n_pretokens", "n_tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
