import math
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quillspark.llm import quality, toxicity
from tests.llm.util import EDGES, frame, tables

LABELS = "doc_id bigint, quality int, toxic int"


def auc(score, label):
    score, label = np.array(score), np.array(label)
    gap = score[label == 1][:, None] - score[label == 0][None, :]
    return ((gap > 0) + 0.5 * (gap == 0)).mean()


@pytest.mark.parametrize(("query", "label", "mod", "rest", "least"), [(quality.op9_quality, "quality", 5, 0, 0.98), (toxicity.op8_toxicity, "toxic", 4, 2, 0.96)])
def test_held_out_accuracy(spark, query, label, mod, rest, least):
    sf = "/root/testdata/sf0.1"
    if not Path(sf).is_dir():
        pytest.skip("no test tables here")
    got = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) for r in got)
    held = [r for r in got if r["held_out"]]
    assert auc([r["score"] for r in held], [r[label] for r in held]) > least
    assert np.mean([r["predicted"] == r[label] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


@pytest.mark.parametrize("query", [quality.op9_quality, toxicity.op8_toxicity])
@pytest.mark.parametrize("labels", [[], [(4, 1, 1), (6, 1, 1), (5, None, None)], [(i, i % 2, i % 2) for i in range(1, 9)]])
def test_edges(spark, tmp_path, query, labels):
    got = query(spark, tables(spark, tmp_path, documents=frame(spark, [(*r, "x") for r in EDGES], "doc_id bigint, text string, score string"), labels=frame(spark, labels, LABELS))).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
    same = {r["score"] for r in got if r["doc_id"] in (6, 7)}
    assert len(same) == 1 and {r["score"] for r in got if r["doc_id"] == 1} == {r["score"] for r in got if r["doc_id"] == 2}


@pytest.mark.parametrize("query", [quality.op9_quality, toxicity.op8_toxicity])
def test_empty_table(spark, tmp_path, query):
    assert query(spark, tables(spark, tmp_path, documents=frame(spark, []), labels=frame(spark, [], LABELS))).count() == 0


def test_pairs_rank_good_above_bad():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, 3)) + y[:, None] * [2.0, 0.0, -1.0]
    model = quality.fit(x, y, float(1 - y.mean()))
    assert auc(model.strength(x), y) > 0.93
    assert abs((model.strength(x) < model.threshold).mean() - (1 - y.mean())) < 0.02


@pytest.mark.parametrize(("seed", "apart"), [(1, [2.0, 0.0, -1.0]), (2, [9.0, 1.0, 0.0]), (3, [0.3, 0.1, 0.0])])
def test_weights_are_those_of_all_pairs(seed, apart):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 3)) + y[:, None] * apart
    model = quality.fit(x, y, float(1 - y.mean()))
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    pairs = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 3)
    w = np.zeros(3)
    for _ in range(60):  # Newton's method on every pair
        p = 1 / (1 + np.exp(np.clip(pairs @ w, -500, 500)))
        share = quality.PAIRS / len(pairs)
        w = w - np.linalg.solve(share * (pairs * (p * (1 - p))[:, None]).T @ pairs + np.eye(3), w - share * pairs.T @ p)
    assert model.weights == pytest.approx(w, rel=5e-4, abs=5e-4)
    s = np.sort(model.strength(x))
    assert model.threshold == pytest.approx(s[(y == 0).sum() - 1 : (y == 0).sum() + 1].mean(), abs=1e-12)


@pytest.mark.parametrize("shares", [(0.0, 1.0), (0.3, 0.3), (0.9, 0.1)])
def test_threshold_among_equal_strengths(shares):
    rng = np.random.default_rng(5)
    s, y = rng.integers(0, 40, 3000) / 7, rng.integers(0, 2, 3000)
    n = np.bincount(y)
    mass = np.array([shares[0], 1 - shares[0]]) / n
    got = quality.quantile(lambda work: [work(iter([(s[i : i + 700], y[i : i + 700])])) for i in range(0, 3000, 700)], lambda x: x, mass, shares[1])
    order = np.argsort(s, kind="stable")
    below = min(int(np.searchsorted(np.cumsum(mass[y[order]]), shares[1] - 1e-9)), 2999)
    assert got in {s[order][below], (s[order][below] + s[order][min(below + 1, 2999)]) / 2}


def test_every_labelled_row_is_learned_from(spark, tmp_path):
    docs = [(i, f"word{i} and {'more ' * (i % 9)}" + ("!! " * (i % 5) if i % 2 else "plain text. ")) for i in range(16_000)] + [(None, "no identifier")]
    labels = frame(spark, [(i, int(i % 2 == 0), 0) for i, _ in docs[:-1]], LABELS)
    model = quality.train(frame(spark, docs), labels)
    rows = [(i, t) for i, t in docs[:-1] if zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([quality.features(t) for _, t in rows]), np.array([int(i % 2 == 0) for i, _ in rows])
    assert min(np.bincount(y)) > 6000
    assert model.center == pytest.approx(x.mean(axis=0), rel=1e-9) and model.scale == pytest.approx(x.std(axis=0) + 1e-6, rel=1e-6)
    plain = quality.fit(x, y, float(1 - y.mean()))
    assert model.weights == pytest.approx(plain.weights, rel=1e-5, abs=1e-5) and model.threshold == pytest.approx(plain.threshold, rel=1e-5, abs=1e-5)


def test_folding():
    assert toxicity.words_of("1d10t ІDІΟT scu​m lo5er$$$ 15 cats") == ["idiot", "idiot", "scum", "loser", "cats"]


def test_few_documents_of_a_language_are_enough(spark):
    """sf0.01 has two labelled toxic German documents to learn from and four held out."""
    sf = "/root/testdata/sf0.01"
    if not Path(sf).is_dir():
        pytest.skip("no test tables here")
    got = toxicity.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert auc([r["score"] for r in got], [r["toxic"] for r in got]) > 0.98
    for lang in ("en", "de", "fr"):
        assert auc([r["score"] for r in got if r["lang"] == lang], [r["toxic"] for r in got if r["lang"] == lang]) > 0.95


def plain_hits(model, text):
    """Every term at every place, but where an exception covers it."""
    words = toxicity.words_of(text)
    whole = f" {' '.join(words)} "
    places = lambda x: [i for i in range(len(whole)) if whole.startswith(x, i)]
    shut = [(i, i + len(e) + 1) for e in model.exceptions for i in places(f" {e} ")]
    best = {}
    for t, w in model.terms:
        for i in places(t):
            if not any(a <= i and i + len(t) - 1 <= b for a, b in shut):
                best[i] = max(best.get(i, 0), w)
    total = sum(best.values())
    return [max(best.values(), default=0.0), math.log1p(total), math.log1p(100 * total / (len(words) + 20))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["trash", "can", "trashy", "low", "lowland", "idiot", "1d10t", "x", "a" * 45, "."]), max_size=25))
def test_hits_are_brute_force(words):
    model = toxicity.Model(((" a", 0.5), (" idiot ", 3.5), (" low", 2.0), (" trash", 2.5), (" trash ", 3.0)), ("lowland", "trash can", "can idiot"), (1.0, 0.5, 0.5, -2.0), 0.0)
    text = " ".join(words)
    assert model.hits(text) == pytest.approx(plain_hits(model, text))
    assert model.score(text) == pytest.approx(1 / (1 + math.exp(2.0 - sum(w * x for w, x in zip(model.weights, plain_hits(model, text), strict=False)))))


def test_scores_of_a_query_are_the_models(spark, tmp_path):
    docs = [(i, ("such idiot words here " if i % 3 == 0 else "plain words here ") + f"n{chr(97 + i % 20)} " * 5) for i in range(60)] + [(None, "idiot"), (4, None)]
    labels = [(i, 1 - (i % 3 == 0), int(i % 3 == 0)) for i in range(60)]
    frames = tables(spark, tmp_path, documents=frame(spark, docs), labels=frame(spark, labels, LABELS))
    model = toxicity.train(spark.read.parquet(f"{frames}/documents.parquet"), spark.read.parquet(f"{frames}/labels.parquet"))
    plain = lambda t: 1 / (1 + math.exp(-sum(w * x for w, x in zip(model.weights, [*plain_hits(model, t), 1.0], strict=True))))
    got = sorted(((r["doc_id"], r["score"]) for r in toxicity.op8_toxicity(spark, frames).collect()), key=str)
    assert [s for _, s in got] == pytest.approx([s for _, s in sorted(((k, plain(t)) for k, t in docs), key=str)])
    assert {t for t, _ in model.terms} & {" idiot ", " idi", " such ", " suc"}
    known = quality.train(spark.read.parquet(f"{frames}/documents.parquet"), spark.read.parquet(f"{frames}/labels.parquet"))
    gap = lambda t: sum(w * (x - c) / s for w, x, c, s in zip(known.weights, quality.features(t), known.center, known.scale, strict=True)) - known.threshold
    got = sorted(((r["doc_id"], r["score"]) for r in quality.op9_quality(spark, frames).collect()), key=str)
    assert [s for _, s in got] == pytest.approx([s for _, s in sorted(((k, 1 / (1 + math.exp(-gap(t)) * 0.7 / 0.3)) for k, t in docs), key=str)])


def test_features_by_definition():
    text = "Good words words HERE...  a , b !!\n\nline line\nline line\n1 2 3"
    words, got = text.split(), dict(zip(quality.FEATURES, quality.features(text), strict=True))
    d = len(words) + quality.SMOOTH
    assert got["repeats"] == pytest.approx(sum(a == b for a, b in zip(words, words[1:], strict=False)) / d)
    assert got["distinct"] == pytest.approx((len(set(words)) + quality.SMOOTH) / d) and got["lines"] == pytest.approx(text.count("\n") / d)
    assert got["digits"] == pytest.approx(3 / (len(text) + 8 * quality.SMOOTH)) and got["log_words"] == pytest.approx(math.log(len(words) + 1))
    assert got["repeated_lines"] == pytest.approx(1 / (4 + quality.SMOOTH)) and got["commonest"] == pytest.approx(4 / d)


def test_learned_pairs_are_exceptions(spark, tmp_path):
    docs = [(i, "scum of it all") for i in range(20)] + [(100 + i, "algae scum layer on ponds" if i < 6 else "ponds and fields") for i in range(80)]
    labels = [(k, 1, int(k < 100)) for k, _ in docs]
    model = toxicity.train(frame(spark, docs), frame(spark, labels, LABELS))
    assert "algae scum" in model.exceptions and model.hits("algae scum ponds")[0] == 0 < model.hits("scum")[0]


@pytest.mark.parametrize("piece", ["trash can ", "trash ", "x" * 45 + " ", "1d10t ", "@", "$a"])
def test_long_texts_take_time_in_proportion(piece):
    model = toxicity.Model(((" trash", 2.5), (" trash ", 3.0), (f" {'x' * 45} ", 1.0)), ("trash can",), (1.0, 0.5, 0.5, -2.0), 0.0)
    start = time.perf_counter()
    got = model.hits(piece * (5_000_000 // len(piece)))
    assert time.perf_counter() - start < 40 and (got[0] > 0) == (piece in ("trash ", "x" * 45 + " "))


def test_exceptions_cancel_hits():
    model = toxicity.Model(((" trash ", 3.0), (" low", 2.0)), ("trash can", "lowland"), (1.0, 1.0, 1.0, -2.0), 0.0)
    assert model.hits("a trash can on lowland")[0] == 0 and model.hits("such trash")[0] == 3.0 and model.hits("lowest")[0] == 2.0
    assert model.score("") == model.score(None) < model.score("trash")
