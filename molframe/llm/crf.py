"""Language ID by a linear-chain conditional random field.

Each word of a text is labelled with a language. A word's emission scores are learned weights of its affixes, its
character n-grams and, if the learned lexicon has it, of the word and of the languages the lexicon gives it to; learned transitions tie
neighbouring words. Training sequences splice runs of words of different languages, so the transitions learn to switch.
Forward-backward gives each word's label probabilities, whose mean over the whole text is the document's.

Learned from at most `train_rows` rows of each language (the bound of what reaches the driver), dealt by a hash of the id. Defined results:
`und` with score 0 if the text is null or has no letter, or nothing could be learned; ties go to the language that sorts first; extra input
columns are ignored; repeated rows are labelled alike; texts of any length are labelled whole, exactly, block by block.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molframe.llm.rows import back, dealt, held_out, sent, sent_type, small_batches
from molframe.session import table

WORDS = re.compile(r"[^\W\d_]+")
TRAIN_ROWS, ALL_ROWS, SEED = 150, 15_000, 7
#: Words of a training row that are used at most, spread over the whole row.
ROW_WORDS = 600
BUCKETS, AFFIX, GRAMS = 1 << 16, 4, (2, 3)
SEQUENCE, RUN, EPOCHS, MINIBATCH = 48, 24, 4, 128
#: Words of a link of the chain; words handled at once; words whose scores a worker remembers.
LINK, BLOCK_WORDS, REMEMBERED = 64, 200_000, 300_000


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)) % np.uint64(BUCKETS)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature, value) of all words' affixes and n-grams. A word's n-grams count as their mean, four times."""
    flat = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    end = np.cumsum(size)
    start = end - size
    of = np.repeat(np.arange(len(words)), size)
    word, feature, value = [], [], []
    for n in GRAMS:
        at = np.flatnonzero(np.arange(len(flat)) + n <= end[of])
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * np.uint64(1_000_003) + flat[at + k]
        word.append(of[at])
        feature.append(_mix(h, n))
        value.append(4 / (size[of[at]] - n + 1) / len(GRAMS))
    for sign in (1, -1):
        h = np.zeros(len(words), np.uint64)
        for k in range(1, AFFIX + 1):
            here = np.flatnonzero(size - 2 >= k)
            h = h[here] if k == 1 else h[np.isin(was, here, assume_unique=True)]
            h = h * np.uint64(1_000_003) + flat[start[here] + k if sign > 0 else end[here] - 1 - k]
            was = here
            word.append(here)
            feature.append(_mix(h, 100 * sign + 1000 + k))
            value.append(np.ones(len(here)))
    return np.concatenate(word), np.concatenate(feature).astype(np.int64), np.concatenate(value)


class Tagger:
    def __init__(self, labels: list[str]):
        self.labels = labels
        n = len(labels)
        self.lexicon: dict[str, int] = {}  # word -> row of lexical weights
        self.known = np.zeros((0, n))  # share of each language in a lexicon word's rows
        self.weights = np.zeros((BUCKETS, n))
        self.lexical, self.shared = np.zeros((0, n)), np.zeros((n, n))
        self.trans, self.start = np.zeros((n, n)), np.zeros(n)

    def _lexical(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        row = np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))
        has = np.flatnonzero(row >= 0)
        return has, row[has]

    def emissions(self, words: list[str]) -> np.ndarray:
        word, feature, value = features(words)
        out = np.stack([np.bincount(word, self.weights[feature, l] * value, len(words)) for l in range(len(self.labels))], 1)
        has, row = self._lexical(words)
        out[has] += self.lexical[row] + self.known[row] @ self.shared
        return out

    def fit(self, rows: list[tuple[str, str]], seed: int = SEED) -> Tagger:
        """Stochastic gradient (Adagrad) on the conditional log-likelihood of spliced sequences."""
        r = np.random.default_rng(seed)
        runs: list[tuple[int, list[str]]] = []
        seen: dict[str, Counter] = {}
        for text, lang in rows:
            own = self.labels.index(lang)
            words = WORDS.findall(text.lower())
            pieces = [words[i : i + RUN] for i in range(0, len(words), RUN)]
            most = ROW_WORDS // RUN
            if len(pieces) > most:
                pieces = [pieces[i] for i in np.linspace(0, len(pieces) - 1, most).astype(int)]
            runs += [(own, p) for p in pieces]
            for w in set(words):
                seen.setdefault(w, Counter())[own] += 1
        if not runs:
            return self
        for w in sorted(w for w, c in seen.items() if sum(c.values()) >= 3):
            self.lexicon[w] = len(self.lexicon)
        n = len(self.labels)
        self.known = np.zeros((len(self.lexicon), n))
        for w, i in self.lexicon.items():
            for l, c in seen[w].items():
                self.known[i, l] = c
        self.known /= np.maximum(self.known.sum(1, keepdims=True), 1)
        self.lexical = np.zeros((len(self.lexicon), n))
        vocab = {w: i for i, w in enumerate(dict.fromkeys(w for _, p in runs for w in p))}
        listed = list(vocab)
        word, feature, value = features(listed)
        order = np.argsort(word, kind="stable")
        word, feature, value = word[order], feature[order], value[order]
        count = np.bincount(word, minlength=len(listed))
        first = np.cumsum(count) - count
        has, lex = self._lexical(listed)
        lex_of = np.full(len(listed), -1)
        lex_of[has] = lex
        squares = [np.full_like(x, 1e-6) for x in (self.weights, self.lexical, self.shared, self.trans, self.start)]

        def step(i: int, x: np.ndarray, g: np.ndarray, rate: float) -> None:
            squares[i] += g * g
            x -= rate * g / np.sqrt(squares[i])

        for _ in range(EPOCHS):
            order = r.permutation(len(runs))
            # neighbours in this order are mostly of other languages: cut some runs short, so that the places of switches vary
            ids, gold = [], []
            for k in order:
                own, p = runs[k]
                p = p[: int(r.integers(max(1, len(p) // 2), len(p) + 1))]
                ids += [vocab[w] for w in p]
                gold += [own] * len(p)
            full = len(ids) // SEQUENCE * SEQUENCE
            if not full:
                ids, gold, full, wide = ids[:SEQUENCE], gold[:SEQUENCE], len(ids), len(ids)
            else:
                wide = SEQUENCE
            x, y = np.array(ids[:full]).reshape(-1, wide), np.array(gold[:full]).reshape(-1, wide)
            for k in range(0, len(x), MINIBATCH):
                bx, by = x[k : k + MINIBATCH], y[k : k + MINIBATCH]
                own, back = np.unique(bx, return_inverse=True)
                rows_ = np.concatenate([np.arange(first[w], first[w] + count[w]) for w in own])
                of = np.repeat(np.arange(len(own)), count[own])
                f, v = feature[rows_], value[rows_]
                score = np.stack([np.bincount(of, self.weights[f, l] * v, len(own)) for l in range(n)], 1)
                inside = lex_of[own] >= 0
                rows_lex = lex_of[own][inside]
                score[inside] += self.lexical[rows_lex] + self.known[rows_lex] @ self.shared
                e = score[back.reshape(bx.shape)]
                post, pairs = self._expected(e)
                np.subtract.at(post.reshape(-1, n), (np.arange(by.size), by.ravel()), 1)
                scale = 1 / by.size
                g_word = np.stack([np.bincount(back.ravel(), post[:, :, l].ravel(), len(own)) for l in range(n)], 1) * scale
                g = np.stack([np.bincount(f, g_word[of, l] * v, BUCKETS) for l in range(n)], 1)
                step(0, self.weights, g, 0.1)
                g = np.zeros_like(self.lexical)
                g[rows_lex] = g_word[inside]
                step(1, self.lexical, g, 0.1)
                step(2, self.shared, self.known[rows_lex].T @ g_word[inside], 0.1)
                np.subtract.at(pairs, (by[:, :-1].ravel(), by[:, 1:].ravel()), 1)
                step(3, self.trans, pairs * scale, 0.1)
                step(4, self.start, post[:, 0].sum(0) * scale, 0.1)
        return self

    def _expected(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected labels and label pairs of sequences of equal length with emission scores e."""
        b, t, n = e.shape
        w = np.exp(e - e.max(2, keepdims=True))
        a, trans = np.empty((b, t, n)), np.exp(self.trans - self.trans.max())
        cur = w[:, 0] * np.exp(self.start - self.start.max())
        for i in range(t):
            cur = cur if i == 0 else (a[:, i - 1] @ trans) * w[:, i]
            a[:, i] = cur / cur.sum(1, keepdims=True)
        post, pairs = np.empty_like(a), np.zeros((n, n))
        post[:, -1] = a[:, -1]
        beta = np.ones((b, n))
        for i in range(t - 2, -1, -1):
            after = w[:, i + 1] * beta
            joint = a[:, i, :, None] * trans * after[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            pairs += joint.sum(0)
            post[:, i] = joint.sum(2)
            beta = after @ trans.T
            beta /= beta.sum(1, keepdims=True)
        return post, pairs

    def marginals(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Label probabilities of each word, by forward-backward over documents that lie one after another in e (sizes: their words, none 0).

        Chains are cut into links. The product of a link's transfer matrices carries the forward and backward vectors over the link, so that all links
        are then run through side by side; the result is that of one run from end to end."""
        n = e.shape[1]
        links = -(-sizes // LINK)
        doc = np.repeat(np.arange(len(sizes)), links)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(links) - links, links)
        begin = np.repeat(np.cumsum(sizes) - sizes, links) + nth * LINK
        long = np.minimum(LINK, np.repeat(sizes, links) - nth * LINK)
        place = begin[:, None] + np.arange(LINK)
        real = np.arange(LINK) < long[:, None]
        w = np.exp(e - e.max(1, keepdims=True))
        w = np.where(real[:, :, None], w[np.minimum(place, len(e) - 1)], 1.0)
        trans, start = np.exp(self.trans - self.trans.max()), np.exp(self.start - self.start.max())
        product = np.broadcast_to(np.eye(n), (len(doc), n, n)).copy()
        for t in range(LINK):
            live = np.flatnonzero(real[:, t])
            if not len(live):
                break
            move = product[live] @ trans
            if t == 0:
                head = nth[live] == 0
                move[head] = start  # a document's first word has no transition into it
            move *= w[live, t][:, None, :]
            product[live] = move / move.sum((1, 2), keepdims=True)
        front, rear = np.ones((len(doc), n)), np.ones((len(doc), n))
        last = np.cumsum(links) - 1
        for j in range(1, int(links.max())):
            at = np.flatnonzero(nth == j)
            v = (front[at - 1][:, None, :] @ product[at - 1])[:, 0]
            front[at] = v / v.sum(1, keepdims=True)
        from_end = np.repeat(last, links) - np.arange(len(doc))
        for j in range(1, int(links.max())):
            at = np.flatnonzero(from_end == j)
            v = (product[at + 1] @ rear[at + 1][:, :, None])[:, :, 0]
            rear[at] = v / v.sum(1, keepdims=True)
        alpha, cur = np.empty((len(doc), LINK, n)), front
        for t in range(LINK):
            nxt = cur @ trans
            if t == 0:
                nxt[nth == 0] = start
            nxt = nxt * w[:, t]
            cur = np.where(real[:, t, None], nxt / nxt.sum(1, keepdims=True), cur)
            alpha[:, t] = cur
        beta = rear
        for t in range(LINK - 1, -1, -1):
            alpha[:, t] *= beta
            back = (beta * w[:, t]) @ trans.T
            beta = np.where(real[:, t, None], back / back.sum(1, keepdims=True), beta)
        out = alpha[real]
        return out / out.sum(1, keepdims=True)


class Reader:
    """A tagger with the emission scores of words it has met."""

    def __init__(self, tagger: Tagger):
        self.tagger, self.row, self.scores = tagger, {}, np.zeros((0, len(tagger.labels)))

    def read(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[tuple[int, np.ndarray]]]:
        """Language and score of each text, and (text number, word probabilities) of those with letters."""
        lang, score, parts = ["und"] * len(texts), np.zeros(len(texts)), []
        held, words, count = [], [], 0
        for i, text in enumerate(texts):
            if text and self.tagger.labels and any(map(str.isalpha, text)):
                held.append(i)
                words.append(WORDS.findall(text.lower()))
                count += len(words[-1])
            if held and (count >= BLOCK_WORDS or i == len(texts) - 1):
                if len(self.row) > REMEMBERED:
                    self.row, self.scores = {}, self.scores[:0]
                new = sorted(w for w in set().union(*words) if w not in self.row)
                if new:
                    self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
                    self.scores = np.concatenate([self.scores, self.tagger.emissions(new)])
                sizes = np.array([len(w) for w in words])
                ids = np.fromiter((x for w in words for x in map(self.row.__getitem__, w)), np.int64, count)
                p = self.tagger.marginals(self.scores[ids], sizes)
                first = np.cumsum(sizes) - sizes
                mean = np.add.reduceat(p, first) / sizes[:, None]
                for k, best in enumerate(mean.argmax(1)):
                    lang[held[k]], score[held[k]] = self.tagger.labels[best], min(1.0, mean[k, best])
                    parts.append((held[k], p[first[k] : first[k] + sizes[k]]))
                held, words, count = [], [], 0
        return lang, score, parts


def train_tagger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, all_rows: int = ALL_ROWS) -> Tagger:
    """Learns from rows with text and language that aren't held out: of each language the train_rows least by a hash of the id, fewer where that would make more than all_rows. More languages than all_rows are an error."""
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = rows.select("lang").distinct().count()
    if languages > all_rows:
        raise ValueError(f"{languages} languages; at most {all_rows} rows are learned from")
    train_rows = min(train_rows, all_rows // max(1, languages))
    place = dealt("id", SEED)
    ids = rows.select("lang", F.coalesce(place, F.lit(0)).alias("place"), "id").withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("place", "id"))).filter(F.col("nth") <= train_rows)
    ids = ids.select(F.col("lang").alias("l"), F.col("id").alias("i")).distinct()
    got = rows.join(F.broadcast(ids), (F.col("lang") == F.col("l")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")  # at most all_rows ids
    got = got.groupBy("lang", "id").agg(F.min("text").alias("text")).orderBy("lang", "id").collect()
    return Tagger(sorted({r["lang"] for r in got})).fit([(r["text"], r["lang"]) for r in got])


def tag_languages(df: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, n_words, shares array<double> of the languages in order of tagger.labels, n_switches: neighbours with other best labels)."""

    small_batches(df)

    def run(batches):
        reader = Reader(tagger)
        for pdf in batches:
            lang, score, parts = reader.read(list(pdf["text"]))
            n_words, switches, shares = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), [np.zeros(len(tagger.labels))] * len(pdf)
            for i, p in parts:
                best = p.argmax(1)
                n_words[i], switches[i], shares[i] = len(p), np.count_nonzero(best[1:] != best[:-1]), p.mean(0)
            yield pd.DataFrame({"id": pdf["id"], "lang_pred": lang, "score": score, "n_words": n_words, "shares": shares, "n_switches": switches})

    out = df.select(sent(df, id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {sent_type(df, id_col)}, lang_pred string, score double, n_words long, shares array<double>, n_switches long")
    return out.select(back(df, id_col, "id"), *out.columns[1:])


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagged = tag_languages(docs, train_tagger(docs))
    return tagged.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
