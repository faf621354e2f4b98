"""Toxicity by a weighted lexicon that Aho-Corasick matches in folded text.

Folding lowers case, maps homoglyphs to Latin letters, drops invisible characters and reads digits and
signs inside words as the letters they stand for. Terms are words and word beginnings, learned from
labelled documents with their shrunken log odds as weights. What is counted is a document's distinct words: a beginning
that many words of few documents share weighs as much as a word of many documents, so a language of which few
documents are labelled gives terms too. Exception phrases (words that begin like a term but speak for nothing and pairs
of a term's word and its neighbour that clean documents have, both learned, and phrases given) cancel the hits inside
them. The score is a logistic function of the strongest hit and of the sum of hits, absolute and by length.

The lexicon is bounded by the words of the labelled sample, and words of any length count whole. Null and empty texts have no hits and so the least score. Without labels of both classes there is no
lexicon and every score is the share of label 1 (0 without labels). Repeated rows get equal scores;
null doc_id rows are scored and not held out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import checkpoint, python_stage, table
from quillspark.llm.learn import held_out, logistic, sample, sigmoid

ACCEPT = 0.3
#: Word beginnings of these lengths, and whole words, may become terms.
PREFIXES = range(3, 11)
#: Least log-likelihood ratio, log odds and labelled documents of a term, and the words by which its odds are drawn towards none.
LEAST_G2, LEAST_WEIGHT, LEAST_DOCS, PRIOR = 25.0, 1.5, 2, 3.0
#: Phrases in which a term is harmless, in folded form.
PHRASES = ("trash can", "trash bin", "clown fish", "sore loser board game")
#: Letters of other scripts by the Latin letter they look like.
HOMOGLYPHS = {
    "a": "аα", "b": "вβ", "c": "сϲ", "e": "еεё", "h": "һн", "i": "іıι", "j": "ј", "k": "кκ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "s": "ѕ", "t": "тτ", "u": "υս", "x": "хχ", "y": "уγ", "w": "ѡω",
}
FOLD = {ord(look): plain for plain, looks in HOMOGLYPHS.items() for look in looks} | dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: A word with a sign before a letter; signs at its end are not part of it.
SIGNED = re.compile(r"(?<![^\W_@$])(?=[^\W\d_]*[\d@$]+[^\W\d_])[@$\d]*[^\W_]+(?:[@$]+[^\W_]+)*")
HAS_SIGN = re.compile(r"[\d@$][^\W\d_]")
PLAIN = str.maketrans(SIGNS)
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower().translate(FOLD)
    if HAS_SIGN.search(low):
        low = SIGNED.sub(lambda m: m[0].translate(PLAIN), low)
    return WORD.findall(low)


def grams_of(text: str | None) -> dict[str, int]:
    """The text's distinct words ( word ), once each, and the number of them with each beginning ( wor), with the leading space that binds them to a word's start."""
    out: dict[str, int] = {}
    for w in set(words_of(text)):
        out[f" {w} "] = 1
        for n in PREFIXES:
            if n <= len(w):
                out[f" {w[:n]}"] = out.get(f" {w[:n]}", 0) + 1
    return out


@dataclass(frozen=True)
class Model:
    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    weights: tuple[float, ...]
    base: float

    def found(self, words: list[str]) -> list[tuple[int, float]]:
        """(place in the joined words, weight) of the hits that no exception covers."""
        shut: list[tuple[int, int]] = []
        got: list[tuple[int, int, float]] = []
        if words and self.terms:
            for end, (n, weight) in automaton(self).iter(f" {' '.join(words)} "):
                if weight is None:
                    shut.append((end - n + 1, end))
                else:
                    got.append((end - n + 1, end, weight))
        return uncovered(got, shut)

    def hits(self, text: str | None) -> list[float]:
        words = words_of(text)
        best: dict[int, float] = {}
        for start, weight in self.found(words):  # of nested terms the strongest counts
            best[start] = max(best.get(start, 0.0), weight)
        total = sum(best.values())
        return [max(best.values(), default=0.0), math.log1p(total), math.log1p(100 * total / (len(words) + 20))]

    def pairs(self, text: str | None) -> list[str]:
        """The distinct pairs of a hit's word and a neighbour."""
        words = words_of(text)
        at = {s for s, _ in self.found(words)}
        out, place = set(), 0
        for i, w in enumerate(words):
            if place in at:
                out.update(" ".join(words[j : j + 2]) for j in (i - 1, i) if 0 <= j < len(words) - 1)
            place += len(w) + 1
        return sorted(out)

    def score(self, text: str | None) -> float:
        if not self.weights:
            return self.base
        return sigmoid(float(np.dot(self.weights, [*self.hits(text), 1.0])))


def uncovered(got: list[tuple[int, int, float]], shut: list[tuple[int, int]]) -> list[tuple[int, float]]:
    """(start, weight) of the hits (start, end, weight) that lie in no exception (start, end): one sweep over both in order of their starts."""
    shut, out, i, reach = sorted(shut), [], 0, -1
    for start, end, weight in sorted(got):
        while i < len(shut) and shut[i][0] <= start:  # of exceptions that begin here or before, the one that reaches farthest decides
            reach = max(reach, shut[i][1])
            i += 1
        if end > reach:
            out.append((start, weight))
    return out


@lru_cache(maxsize=4)
def automaton(model: Model):
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase in model.exceptions:
        out.add_word(f" {phrase} ", (len(phrase) + 2, None))
    for term, weight in model.terms:
        if not out.exists(term):
            out.add_word(term, (len(term), weight))
    out.make_automaton()
    return out


def lexicon(grams: DataFrame, n_pos: int, n_neg: int) -> tuple[list[tuple[str, float]], list[str]]:
    """Terms with weights and learned exceptions, from (gram, pos, neg, docs): the distinct words of each label that have a gram, of n_pos and n_neg, and the documents of label 1 that do."""
    p, q = F.col("pos"), F.col("neg")
    total, share = p + q, n_pos / (n_pos + n_neg)
    odds = F.log((p + PRIOR * share) / (n_pos + PRIOR)) - F.log((q + PRIOR * (1 - share)) / (n_neg + PRIOR))
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    g2 = 2 * (part(p, total * share) + part(q, total * (1 - share)))
    scored = grams.withColumns({"w": odds, "g2": g2})
    rows = scored.filter((F.col("g2") >= LEAST_G2) & (F.col("w") >= LEAST_WEIGHT) & (F.col("docs") >= LEAST_DOCS)).orderBy(F.desc("g2"), F.length("gram"), "gram").collect()
    terms: dict[str, float] = {}
    for r in rows:  # a longer term adds nothing where a shorter one, as strong, begins it
        g = r["gram"]
        if not any(g != (s := g[:n]) and s in terms and terms[s] >= r["w"] - 0.7 for n in range(2, min(len(g), PREFIXES[-1] + 2))):
            terms[g] = r["w"]
    begins = [t for t in terms if not t.endswith(" ")]
    calm: list[str] = []
    if begins:
        whole = scored.filter(F.col("gram").endswith(" ") & (q >= 3) & (p * 20 <= q))
        like = F.exists(F.lit(begins), lambda b: F.startswith(F.col("gram"), b))
        calm = [r["gram"].strip() for r in whole.filter(like).orderBy("gram").collect()]
    return sorted(terms.items()), calm


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of labelled documents: the sample's texts are read once, and its grams and hits come from that."""
    seen = checkpoint(sample(docs, labels, "toxic", 4, 2).select("doc_id", "text", "label"))
    sizes = {r["label"]: r["count"] for r in seen.groupBy("label").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model((), (), (), 1.0 if sizes.get(1) else 0.0)
    rows = python_stage(seen, ["text"], "grams map<string,int>", lambda t: (list(grams_of(t).items()),)).select("label", F.explode("grams").alias("gram", "n"))
    count = lambda y: F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0))
    grams = checkpoint(rows.groupBy("gram").agg(count(1).alias("pos"), count(0).alias("neg"), F.count_if(F.col("label") == 1).alias("docs")))
    words = grams.filter(F.col("gram").endswith(" ")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    if not words["pos"] or not words["neg"]:
        terms, calm = [], []
    else:
        terms, calm = lexicon(grams.filter("pos + neg >= 3"), words["pos"], words["neg"])
    bare = Model(tuple(terms), (*PHRASES, *calm), (), 0.0)
    pairs = python_stage(seen, ["text"], "pairs array<string>", lambda t: (bare.pairs(t),)).select("label", F.explode("pairs").alias("pair"))
    told = pairs.groupBy("pair").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    calm += [r["pair"] for r in told.filter("neg >= 3 and pos * 20 <= neg").orderBy("pair").collect()]
    bare = Model(bare.terms, (*PHRASES, *calm), (), 0.0)
    fitted = python_stage(seen, ["text"], "x array<double>", lambda t: (bare.hits(t),)).select("label", "x").collect()
    x, y = np.array([r["x"] for r in fitted]), np.array([r["label"] for r in fitted], float)
    order = np.lexsort([*x.T, y])
    weights = logistic(x[order], y[order], 1.0)
    weights[-1] += math.log(share_odds(labels) * sizes[0] / sizes[1])  # from the sample's share of label 1 to that of all labels
    return Model(bare.terms, bare.exceptions, tuple(weights), 0.0)


def share_odds(labels: DataFrame) -> float:
    """Odds of label 1 among all training labels."""
    r = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(4, 2)).agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n")).first()
    return max(r["p"], 0.5) / max(r["n"], 0.5)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1)."""
    return python_stage(docs, ["text"], "score double", lambda t: (model.score(t),))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    got = score(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
