import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from quillspark.llm import grouped, simhash
from quillspark.llm.components import connected_components
from tests.llm.util import EDGES, frame, tables


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(prints: dict[int, int]) -> dict[int, int]:
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aBÉ \t\n\x0b\x1f\xa0", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def ball(seed, n):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        out.append(rng.choice(out) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    return sorted({simhash.signed(x) for x in out})


def same_parts(nodes, edges):
    got = plain_parts(nodes, edges)
    want = plain_components({k: x & (1 << 64) - 1 for k, x in enumerate(nodes)})
    return got == [want[k] for k in range(len(nodes))]


def plain_parts(nodes, edges):
    at, root = {x: i for i, x in enumerate(nodes)}, list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(nodes))]


def test_links_are_those_of_brute_force(spark):
    nodes = ball(1, 300)
    edges = [(r["a"], r["b"]) for r in simhash.links(frame(spark, [(x,) for x in nodes], "fp bigint")).collect()]
    assert same_parts(nodes, edges) and len(edges) < 35 * len(nodes)


def test_the_tally_rejects_and_verification_decides():
    base = 0x0123456789ABCDEF
    four = base ^ (0x01 << 56 | 0x01 << 48 | 0x01 << 40 | 0x01 << 32)  # shares a posting, but four bytes only
    wide = base ^ (0xFF << 56)  # shares seven bytes and differs in eight bits
    kin = base ^ (0x80 << 56 | 0x01)
    a = np.array([four, wide, kin], "<u8").view(np.uint8).reshape(-1, 8)
    b = np.array([base], "<u8").view(np.uint8).reshape(-1, 8)
    assert simhash.tally(a, b).tolist() == [4, 7, 6] and simhash.near(a, b).tolist() == [False, False, True]
    masks = [m % (1 << 64) for m in simhash.position_masks()]
    assert any(four & m == base & m for m in masks) and len(masks) == 35


def test_finer_masks_keep_all_near_pairs():
    rng = random.Random(4)
    for _ in range(300):
        x, bits = rng.getrandbits(64), rng.sample(range(64), 3)
        y = x ^ sum(1 << i for i in bits)
        masks = [m for m in simhash.position_masks() if not (x ^ y) & m]
        for free in (24, 18, 14):
            masks = [f for m in masks for f in simhash.finer(m) if not (x ^ y) & f]
            assert masks and all(64 - (m % (1 << 64)).bit_count() <= free for m in masks)


def test_heavy_postings_are_made_finer(spark):
    base = random.Random(5).getrandbits(64)
    nodes = sorted({simhash.signed(base ^ 1 << i ^ 1 << j ^ 1 << k) for i in range(14) for j in range(14) for k in (0, 63)} | set(ball(9, 60)))
    edges = [(r["a"], r["b"]) for r in simhash.links(frame(spark, [(x,) for x in nodes], "fp bigint"), block=8).collect()]
    assert same_parts(nodes, edges)


def test_large_groups_are_held_against_hubs_and_dealt_in_blocks(spark):
    rng = random.Random(5)
    bases = [rng.getrandbits(64) for _ in range(4)]
    nodes = sorted({simhash.signed(b ^ 1 << i ^ 1 << j) for b in bases for i in range(9) for j in range(9)})
    rows = frame(spark, [(7, x, x) for x in nodes] + [(8, x, x) for x in nodes[:3]], "key bigint, node bigint, data bigint")
    edges = [(r["a"], r["b"]) for r in grouped.links_in_groups(rows, simhash.near, 8, block=10).collect()]
    assert same_parts(nodes, edges) and len(edges) < len(nodes) * 20


def test_groups_shuffled_for_want_of_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(grouped, "MOST_BROADCAST", 0)
    test_large_groups_are_held_against_hubs_and_dealt_in_blocks(spark)


def test_rows_that_share_an_identifier_are_rows_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "p"), (1, b, "q"), (9, b, "r"), (None, c, "s"), (None, c, "t"), (None, a, "u"), (4, c + " x", "v")]
    got = simhash.drop_near_duplicates(frame(spark, rows, "doc_id bigint, text string, __row string"))
    assert got.columns == ["doc_id", "text", "__row"] and sorted(r["__row"] for r in got.collect()) == ["p", "q", "v"]


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 600)]
    edges = frame(spark, path + star + [(9, 9), (None, 3), (100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 600)}}


def test_edges_of_query(spark, tmp_path):
    got = simhash.op6_simhash(spark, tables(spark, tmp_path, documents=frame(spark))).collect()
    assert len(got) == len(EDGES)
    by = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got}
    assert by[1] == by[2] == by[3] == ("0" * 16, 1) and by[6][1] == by[7][1] == 6
    prints = {k: plain_fingerprint(t or "") for k, t in EDGES if k is not None}
    assert all(int(by[k][0], 16) == p for k, p in prints.items())
    assert {k: by[k][1] for k in prints} == plain_components(prints)


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_small_tables_match_brute_force(spark, small):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.op6_simhash(spark, small).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {k: v[0] for k, v in got.items()} == {k: plain_fingerprint(t) for k, t in texts.items()}
    assert {k: v[1] for k, v in got.items()} == plain_components({k: v[0] for k, v in got.items()})


def test_drop_keeps_one_of_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    near = list(words)
    for i in (50, 150, 250, 350):
        near[i] = "changed"
    other = [f"v{rng.randrange(5000)}" for _ in range(400)]
    rows = [(3, " ".join(words), "c"), (5, " ".join(near), "c"), (5, " ".join(near), "c"), (9, " ".join(other), "c"), (None, "x", "c"), (None, "x", "c")]
    got = simhash.drop_near_duplicates(frame(spark, rows, "doc_id bigint, text string, fp string"))
    assert got.columns == ["doc_id", "text", "fp"]
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 3, 9]


def test_equal_shingle_sets_are_linked(spark):
    rows = [(1, "a b c d e f g a b c d e f g a b c d e"), (2, "a b c d e f g a b c d e f g a b c d e f g a b c d e"), (3, "q r s t u v w")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame(spark, rows), similar=True).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_forest_of_one_node():
    assert grouped.forest(np.array([4, 4]), np.zeros((2, 8), np.uint8), simhash.near) == []
