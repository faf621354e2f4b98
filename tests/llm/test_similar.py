import numpy as np

from quillspark.llm import similar
from tests.llm.util import LONG, frame


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def pair(seed, n, changed):
    rng = np.random.default_rng(seed)
    words = [f"w{x}" for x in rng.integers(0, 10**6, n)]
    other = list(words)
    for i in rng.choice(n, changed, replace=False):
        other[i] = f"x{rng.integers(10**6)}"
    return " ".join(words), " ".join(other)


def test_the_estimate_follows_jaccard_similarity():
    for n in (80, 500, 3000):
        for part in (0.0, 0.01, 0.03, 0.1, 0.4):
            gaps = []
            for seed in range(6):
                a, b = pair(seed, n, int(n * part))
                true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
                x, y = (np.frombuffer(similar.signature(t)[2], np.uint8) for t in (a, b))
                gaps.append((x == y).mean() - true)
            assert abs(np.mean(gaps)) < 0.04


def test_words_of_no_text_have_no_set():
    assert similar.signature(None) == similar.signature(" \n") == (None, [], b"")
    assert similar.signature(LONG)[0] == similar.signature(LONG.upper())[0]


def test_similar_documents_are_linked_and_others_are_not(spark):
    a, b = pair(1, 400, 4)
    c, d = pair(2, 400, 60)
    rows = frame(spark, [(1, a, 11), (2, b, 12), (3, c, 13), (4, d, 14), (5, a, 15), (6, "", 16), (7, None, 16)], "doc_id bigint, text string, fp bigint")
    got = {tuple(sorted(r)) for r in similar.similar_links(similar.signatures(rows)).collect()}
    assert got == {(11, 12), (11, 15)}


def test_links_are_exact_at_the_threshold(spark):
    rows, want = [], set()
    for i in range(60):
        a, b = pair(100 + i, 300, 5 + i % 8)
        rows += [(2 * i, a, 2 * i), (2 * i + 1, b, 2 * i + 1)]
        if len(shingles(a) & shingles(b)) >= similar.SIMILARITY * len(shingles(a) | shingles(b)):
            want.add((2 * i, 2 * i + 1))
    got = {tuple(sorted(r)) for r in similar.similar_links(similar.signatures(frame(spark, rows, "doc_id bigint, text string, fp bigint"))).collect()}
    assert 10 < len(want) < 50 and got == want
