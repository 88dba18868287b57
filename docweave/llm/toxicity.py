"""Toxicity from the nearest labelled examples, found exactly with a block-max inverted index."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, remainder, sampled

#: Bounds of what is learned: examples of each label (about, by hash), examples of a block, neighbours.
EXAMPLES, BLOCK, NEIGHBOURS = 800, 32, 15
#: Weight of the prior in the vote.
PRIOR_WEIGHT = 0.5
#: Blocks that are scored together, from the largest bound on; the number doubles as long as more are needed.
FIRST_BLOCKS = 4

_TERM = re.compile(r"[^\W\d_]+")


def terms(text: str) -> Counter:
    """How often each word of letters is in text, in lower case."""
    return Counter(_TERM.findall(text.lower()))


class BlockMaxIndex:
    """Exact top-k by TF-IDF cosine over labelled examples (id, label, terms and their counts).

    A term weighs (1 + log count) * IDF * its chi-squared with the labels, so that a few telling words in a long text aren't
    drowned by its topic. No term is left out: every term of an example is in its vector, in its norm and in the postings.

    Postings are grouped in blocks of BLOCK examples, with each term's largest weight in each block. The sum of
    query weight times largest weight bounds every cosine in a block, so blocks are scored in order of that
    bound until the k-th best cosine found exceeds the next bound. Examples are in the order given: those of one
    label should be side by side, as that makes the bounds tight. Equal cosines go by order of the hash of the id.
    """

    def __init__(self, examples: list[tuple[object, int, dict[str, int]]], priors: tuple[float, float]):
        self.ids = [e[0] for e in examples]
        self.labels = np.array([e[1] for e in examples], float)
        n, n1 = len(examples), int(self.labels.sum())
        #: Each example stands for this many of its label among all labelled documents, relative to the sample.
        self.stands = np.where(self.labels == 1, priors[1] * n / max(n1, 1), priors[0] * n / max(n - n1, 1))
        self.prior = priors[1]
        self.tie = np.array([hash_of(i) for i in self.ids], np.uint64)
        df, df1 = Counter(), Counter()
        for _, label, bag in examples:
            df.update(bag.keys())
            if label:
                df1.update(bag.keys())
        self.vocab = {t: k for k, t in enumerate(sorted(df))}
        at = np.array([df[t] for t in self.vocab], float)
        self.weigh = (np.log((1 + n) / (1 + at)) + 1) * chi2(at, np.array([df1[t] for t in self.vocab], float), n, n1)
        rows = [self.vector(bag) for _, _, bag in examples]
        term = np.concatenate([np.zeros(0, np.int64), *[t for t, _ in rows]])
        which = np.repeat(np.arange(n), [len(t) for t, _ in rows])
        weight = np.concatenate([np.zeros(0), *[w for _, w in rows]])
        order = np.lexsort((which, term))
        self.which, self.weights = which[order].astype(np.int32), weight[order]
        self.blocks = max(1, -(-n // BLOCK))
        #: Where the postings of a term in a block begin, and where those of its last block end.
        cell = term[order] * self.blocks + self.which // BLOCK
        self.begins = np.searchsorted(cell, np.arange(len(self.vocab) * self.blocks + 1)).astype(np.int32)
        self.most = np.zeros(len(self.vocab) * self.blocks, np.float32)
        np.maximum.at(self.most, cell, np.nextafter(self.weights.astype(np.float32), np.float32(2)))
        self.most = self.most.reshape(len(self.vocab), self.blocks)

    def vector(self, bag) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of a text's terms, of length 1; terms of no example have no weight that is known."""
        number = np.array([self.vocab.get(t, -1) for t in bag], np.int64)
        count = np.array(list(bag.values()), float)
        known = np.flatnonzero(number >= 0)
        known = known[np.argsort(number[known])]
        at = number[known]
        w = (1 + np.log(count[known])) * self.weigh[at]
        norm = math.sqrt(math.fsum((w * w).tolist())) or 1.0
        return at[w > 0], w[w > 0] / norm

    def cosines(self, at: np.ndarray, w: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Of all examples, those of the given blocks scored."""
        cells = (at[:, None] * self.blocks + blocks[None, :]).ravel()
        begins = self.begins[cells].astype(np.int64)
        lengths = self.begins[cells + 1] - begins
        total = int(lengths.sum())
        flat = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
        return np.bincount(self.which[flat], self.weights[flat] * np.repeat(np.repeat(w, len(blocks)), lengths), minlength=len(self.ids))

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k largest cosines above 0 as (cosine, example), ties by the hash of the id."""
        if not len(at) or not self.ids:
            return []
        bounds = w @ self.most[at]
        order = np.argsort(-bounds, kind="stable")
        best: list[tuple[float, int]] = []
        done, step = 0, FIRST_BLOCKS
        while done < self.blocks:
            floor = best[-1][0] if len(best) == k else 0.0
            some = order[done : done + step]
            some = some[bounds[some] >= max(floor - 1e-9, 1e-12)]
            if not len(some):
                break
            scores = np.round(self.cosines(at, w, some), 12)
            found = np.flatnonzero(scores >= max(floor, 1e-12))
            found = found[np.lexsort((found, self.tie[found], -scores[found]))[:k]]
            best += [(float(scores[i]), i) for i in found.tolist()]
            best = sorted(best, key=lambda x: (-x[0], self.tie[x[1]], x[1]))[:k]
            done, step = done + step, 2 * step
        return best

    def score(self, text: str) -> tuple[float, list[tuple[float, int]]]:
        """Probability of label 1: votes of the neighbours weighted by cosine / (1.1 - cosine), what they stand for, and the prior."""
        best = self.nearest(*self.vector(terms(text)))
        one, all_of = self.prior * PRIOR_WEIGHT, PRIOR_WEIGHT
        for cosine, i in best:
            vote = cosine * self.stands[i] / (1.1 - cosine)
            one += vote * self.labels[i]
            all_of += vote
        return float(one / all_of), best


def chi2(df: np.ndarray, df1: np.ndarray, n: int, n1: int) -> np.ndarray:
    """Chi-squared of terms with df documents of n, df1 of them among the n1 of label 1."""
    a, b, c, d = df1, df - df1, n1 - df1, n - n1 - df + df1
    bottom = (a + b) * (c + d) * (a + c) * (b + d)
    return np.where(bottom > 0, n * (a * d - b * c) ** 2 / np.maximum(bottom, 1), 0.0)


def hash_of(key) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(str(key).encode())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES) -> BlockMaxIndex:
    """An index of about examples documents of each label, drawn by a hash of their ids.

    Rows without id or label teach nothing, a repeated id counts once: with label 1 if any row says so, and of several
    texts with the first in their order (null: the empty text). No labelled rows give an index that scores everything by a prior of 0.5.
    """
    marked = labels.select(F.col(id_col).alias("_key"), F.col(label_col).cast("int").alias("_label")).where("_key is not null and _label in (0, 1)")
    marked = marked.groupBy("_key").agg(F.max("_label").alias("_label"))
    n = {r["_label"]: r["n"] for r in marked.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    if not total:
        return BlockMaxIndex([], (0.5, 0.5))
    few = sampled(marked, "_label", F.col("_key"), examples)
    # few has at most about 2 * examples rows at any size of the corpus, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("_key"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(few), "_key")
    texts = texts.groupBy("_key").agg(F.max("_label").alias("_label"), F.coalesce(F.min("_text"), F.lit("")).alias("_text"))
    texts = texts.select(F.struct("_key", "_label").alias("_row"), "_text")

    def make():
        def compute(rows):
            bags = [terms(t or "") for t in rows]
            return {"words": [list(b) for b in bags], "counts": [list(b.values()) for b in bags]}

        return compute

    bags = map_texts(texts, "_row", "_text", {"words": "array<string>", "counts": "array<int>"}, make).select("_row._key", "_row._label", "words", "counts")
    drawn = [(r["_key"], r["_label"], dict(zip(r["words"], r["counts"], strict=True))) for r in bags.collect()]
    drawn.sort(key=lambda e: (e[1], hash_of(e[0])))  # those of one label share blocks
    return BlockMaxIndex(drawn, (n.get(0, 0) / total, n.get(1, 0) / total))


def score(docs: DataFrame, index: BlockMaxIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns (id_col, score, neighbours, cosines array<double>) for each row of docs; neighbours are ids, as text unless integers.

    The whole text is scored; neighbours and cosines are the evidence. A null or empty text, or one without a known
    term, gets the prior and no neighbours. Repeated rows each get a row; other columns aren't read.
    """
    whole = all(isinstance(i, int) for i in index.ids)
    sent = docs.sparkSession.sparkContext.broadcast(index)  # its size is bounded by the terms of the examples; a worker reads it once

    def make():
        known = sent.value
        ids = known.ids if whole else [str(i) for i in known.ids]

        def compute(texts):
            found = [known.score(t or "") for t in texts]
            return {
                "score": [p for p, _ in found],
                "neighbours": [[ids[i] for _, i in best] for _, best in found],
                "cosines": [[c for c, _ in best] for _, best in found],
            }

        return compute

    return map_texts(docs, id_col, text_col, {"score": "double", "neighbours": "array<bigint>" if whole else "array<string>", "cosines": "array<double>"}, make)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours, cosines; learns where crc32(doc_id) mod 5 is not 0."""
    index = fit(docs, labels.where(remainder("doc_id", 5) != 0))
    out = score(docs, index)
    return out.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "neighbours",
        "cosines",
    )
