import random

import pytest

from quillspark.operators import layout

SCHEMA = "doc_id bigint, item_ix bigint, label string, text string, l double, t double, r double, b double"


def box(doc, ix, x, y, w=40.0, h=10.0, text=None, label="text"):
    return (doc, ix, label, f"b{ix}" if text is None else text, float(x), float(y + h / 2), float(x + w), float(y - h / 2))


def nearest(boxes):
    """Lines by search among all of them, as a check on the ordered fold: (item_ix) lists, top first."""
    lines = []
    for y, ix in sorted(((y, ix) for ix, y in boxes), key=lambda v: (-v[0], v[1])):
        best = min(lines, key=lambda n: abs(n["y"] - y), default=None)
        if best is None or abs(best["y"] - y) > 25.0:
            lines.append({"y": y, "in": [(y, ix)]})
        else:
            best["in"].append((y, ix))
            best["y"] = sum(v[0] for v in best["in"]) / len(best["in"])
    return [[ix for _, ix in n["in"]] for n in lines]


def test_clusters_equal_a_search_of_all_lines(spark):
    rng = random.Random(4)
    docs = {d: [(i, float(rng.randrange(0, 4000)) / 8) for i in range(rng.randrange(1, 60))] for d in range(60)}
    df = spark.createDataFrame([box(d, i, 10, y) for d, bs in docs.items() for i, y in bs], SCHEMA)
    got: dict = {}
    for r in layout.cluster_lines(layout.selected_boxes(df)).orderBy("doc_id", "rank").collect():
        got.setdefault(r["doc_id"], {}).setdefault(r["line_no"], []).append(r["item_ix"])
    assert {d: list(n.values()) for d, n in got.items()} == {d: nearest(b) for d, b in docs.items()}


@pytest.mark.parametrize(("ys", "lines"), [((100, 75), 1), ((100, 74.9), 2), ((100, 80, 60), 2), ((100, 100, 100), 1)])
def test_distance_is_to_the_running_mean(spark, ys, lines):
    df = spark.createDataFrame([box(1, i, 10, y) for i, y in enumerate(ys)], SCHEMA)
    assert layout.cluster_lines(layout.selected_boxes(df)).select("line_no").distinct().count() == lines


def test_text_ties_tables_and_fallback(spark):
    rows = [
        box(1, 0, 50, 100, text=" right "), box(1, 1, 5, 102, text="left"), box(1, 2, 5, 50, text=" "), box(1, 3, 5, 10, w=2, h=90, text="| t |", label="table"), box(1, 4, 5, 200, w=2, h=90, text="tall"),
        box(2, 0, 5, 10, w=9, h=9, text=""), box(3, 0, 10, 10, w=5, h=50, text="low"), box(3, 1, 10, 90, w=5, h=50, text="high"), (4, 0, "text", "nowhere", None, None, None, None),
    ]
    got = {r["doc_id"]: (r["orientation"], r["text"]) for r in layout.reading_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    none = "No se encontraron textos en orientación horizontal.\n"
    assert got == {1: ("horizontal", "left | right\n| t |\n"), 2: ("horizontal", none), 3: ("vertical", "high | low\n"), 4: ("horizontal", none)}
    with pytest.raises(ValueError):
        layout.selected_boxes(spark.createDataFrame(rows, SCHEMA), "diagonal")


def test_empty_table(spark):
    assert layout.reading_order(spark.createDataFrame([], SCHEMA)).count() == 0


def test_gap_rows_chain(spark):
    df = spark.createDataFrame([(1, i, f"t{i}", x, float(y)) for i, (x, y) in enumerate([(9.0, 0), (1.0, 30), (5.0, 60), (2.0, 91)])], "doc_id bigint, item_ix bigint, text string, x double, y double")
    rows = layout.gap_rows(df)
    assert {r["item_ix"]: r["row_no"] for r in rows.collect()} == {0: 1, 1: 1, 2: 1, 3: 2}
    cols = {r["row_no"]: (r["left_text"], r["right_text"]) for r in layout.ticket_columns(rows).collect()}
    assert cols == {1: ("t1", "t2 t0"), 2: ("t3", "")}
