import functools
import io
import json
import time
import urllib.error
import urllib.request

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.operators import models, state
from quillspark.plans import pipelines
from quillspark.sources import converter, files, sinks
from quillspark.streaming import front

PROMPTS = {s: {"system": f"step {s}", "user": "{{documento}}{{descripcion}}|{{centro_costo}}|{{macro_categoria}}"} for s in (*pipelines.EXTRACTION, *pipelines.CLASSIFICATION)}


class Counting:
    """A deterministic backend that writes down each call in a folder."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, messages, as_json):
        import uuid
        from pathlib import Path

        step, user = messages[0]["content"].removeprefix("step "), messages[-1]["content"]
        Path(self.folder, f"{step}.{uuid.uuid4().hex}").touch()
        if "broken" in user and step.startswith("11"):
            return "no object here"
        if "down" in user:
            raise OSError("server is down")
        if step == "01_centro_costo":
            return 'Sure: {"centros_costos": []}' if "bare" in user else '{"centros_costos": [{"codigo_centro_costo": "CC0004"}]}'
        if step == "02_macro_categoria":
            return '{"macro_categorias": [{"macro_categoria": "MC08"}]}'
        return json.dumps({"seen": user})

    def count(self):
        import os

        return len(os.listdir(self.folder))


def test_resume_and_chain(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    backend, path = Counting(calls), f"{tmp_path}/results"
    docs = spark.createDataFrame([(1, "fine"), (2, "broken"), (3, "bare"), (4, "down")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["step"]): r for r in pipelines.extract_documents(spark, docs, PROMPTS, backend, path).collect()}
    assert backend.count() == 8 and len(got) == 8
    assert got[2, "11_extraccion_factura"]["error"].startswith("11_extraccion_factura: no JSON object") and got[2, "10_extraccion_generica"]["error"] is None
    assert "server is down" in got[4, "10_extraccion_generica"]["error"]
    pipelines.extract_documents(spark, docs, PROMPTS, backend, path, run_id=2).collect()
    assert backend.count() == 8 + 3  # failures only
    chain = {(r["doc_id"], r["step"]): r for r in pipelines.classify_documents(spark, docs, PROMPTS, backend, path).collect()}
    assert json.loads(chain[1, "03_concepto_codigo_final"]["response"])["seen"] == "{{documento}}fine|CC0004|MC08"
    assert "no primary option" in chain[3, "02_macro_categoria"]["error"] and chain[3, "01_centro_costo"]["error"] is None
    assert (3, "03_concepto_codigo_final") not in chain and (4, "02_macro_categoria") not in chain


def test_later_errors_destroy_no_success(spark):
    rows = [(1, "f", "s", "ok", None, 1), (1, "f", "s", None, "late", 2), (2, "f", "s", None, "e1", 1), (2, "f", "s", None, "e2", 2), (3, "f", "s", None, "e1", 1), (3, "f", "s", "ok", None, 2)]
    df = spark.createDataFrame(rows, state.RESULTS)
    assert {r["doc_id"]: (r["response"], r["error"]) for r in state.current(df).collect()} == {1: ("ok", None), 2: (None, "e2"), 3: ("ok", None)}
    assert {r["doc_id"]: r["errors"] for r in state.error_maps(df).collect()} == {1: None, 2: {"s": "e2"}, 3: None}


def write_sources(folder):
    folder.mkdir()
    (folder / "sub").mkdir()
    (folder / "a.png").write_text(json.dumps([["text", "hi", 1, 0, 10, 50, 0], ["text", "there", 1, 60, 10, 99, 0]]))
    (folder / "sub" / "b.PDF").write_text("[]")
    (folder / "c.jpg").write_text("not json")
    (folder / "d.Jpg").write_text("[]")
    (folder / "e.md").write_text("# text")


def test_files_conversion_and_full_pipeline(spark, tmp_path):
    write_sources(tmp_path / "in")
    found = files.find_source_files(spark, str(tmp_path / "in"))
    assert [r["path"].rsplit("/", 1)[1] for r in files.in_path_order(found).orderBy("position").collect()] == ["a.png", "c.jpg", "b.PDF"]
    got = {r["path"].rsplit("/", 1)[1]: r for r in pipelines.convert_documents(found, converter.json_converter).collect()}
    assert got["a.png"]["markdown"] == "hi | there\n" and got["b.PDF"]["markdown"].startswith("No se") and got["c.jpg"]["status"] == "error"
    summary = state.status_summary(pipelines.process_folder(found, found.select("path").limit(1), converter.json_converter)).first()
    assert (summary["skipped"], summary["total"]) == (1, 3)
    calls = tmp_path / "calls"
    calls.mkdir()
    backend = Counting(calls)
    done = pipelines.full_pipeline(spark, found, converter.json_converter, PROMPTS, backend, f"{tmp_path}/out")
    assert done.filter("error IS NULL").count() == 10 == backend.count()
    pipelines.full_pipeline(spark, found, converter.json_converter, PROMPTS, backend, f"{tmp_path}/out", run_id=2).collect()
    assert backend.count() == 10
    routed = {r["path"].rsplit("/", 1)[1]: r for r in files.load_text(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "in")), converter.json_converter).collect()}
    assert routed["e.md"]["text"] == "# text" and routed["a.png"]["text"] == "hi | there\n"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.jpg", "A"), ("y/b.jpg", "B")], "path string, text string")
    named = sinks.flattened(rows)
    assert sinks.write_each(named, str(tmp_path / "md"), "name", "text").filter("error IS NULL").count() == 2
    assert (tmp_path / "md" / "a.md").read_text() == "A"
    clash = spark.createDataFrame([("x/a.jpg",), ("y/a.pdf",)], "path string")
    try:
        sinks.flattened(clash)
    except ValueError as e:
        assert "a.md" in str(e)
    else:
        raise AssertionError("a clash went unseen")
    one = spark.createDataFrame([(1, "a", '{"k": "é"}')], "doc_ord int, name string, json string")
    sinks.export_results(one, str(tmp_path / "one.json"))
    assert (tmp_path / "one.json").read_text(encoding="utf-8") == '{\n  "k": "é"\n}'


def test_ordered_exports(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{9 - i}", json.dumps({"i": i, "t": "é\n"})) for i in range(9)], "doc_ord int, name string, json string").repartition(5)
    sinks.export_results(rows, str(tmp_path / "all.json"), shape="array")
    text = (tmp_path / "all.json").read_text(encoding="utf-8")
    assert text == json.dumps([{"i": i, "t": "é\n"} for i in range(9)], ensure_ascii=False, indent=2)
    sinks.export_results(rows, str(tmp_path / "map.json"))
    assert list(json.loads((tmp_path / "map.json").read_text(encoding="utf-8"))) == [f"n{9 - i}" for i in range(9)]
    sinks.export_results(rows.limit(0), str(tmp_path / "none.json"), shape="array")
    assert (tmp_path / "none.json").read_text() == "[]"
    with pytest.raises(ValueError, match="n1"):
        sinks.export_results(rows.union(rows.filter("name = 'n1'")), str(tmp_path / "map.json"))


def test_markdown_and_prompts(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\ntwo\n")
    assert [r["text"] for r in files.require_markdown_files(spark, str(tmp_path)).collect()] == ["one\ntwo\n"]
    try:
        files.require_markdown_files(spark, str(tmp_path / "none"))
    except FileNotFoundError:
        pass
    else:
        raise AssertionError("a missing folder went unseen")


def test_question_form_is_a_fold(spark):
    docs = spark.createDataFrame([(1, "doc"), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["answers"] for r in models.question_form(docs, [("a", "first?"), ("b", "second?")], models.echo_backend).collect()}
    assert got[1] == {"a": "first? 6", "b": "second? 7"} == got[2]


def test_dialogue():
    said: list = []
    cli.dialogue([], models.echo_backend, ["hello there", "quit", "never"], said.append)
    assert said == ["hello 11\n"]


def as_boxes(options):
    """A converter of plain text: a box a line."""
    return lambda path, content: [("text", f"{x}*{options.picture_scale}", 1, 0.0, 100.0 - 30 * i, 50.0, 90.0 - 30 * i) for i, x in enumerate(content.decode().splitlines())]


def test_commands(spark, tmp_path, capsys):
    source, out = tmp_path / "in", tmp_path / "out"
    write_sources(source)
    (source / "c.jpg").write_text("[]")
    assert cli.main(["convert", str(source), "-o", str(out), "--markdown", str(tmp_path / "md")]) == 0
    assert (tmp_path / "md" / "a.md").read_text() == "hi | there\n"
    (source / "a.png").write_text(json.dumps([["text", "new", 1, 0, 10, 50, 0]]))
    (source / "z.png").write_text(json.dumps([["text", "more", 1, 0, 10, 50, 0]]))
    assert cli.main(["convert", str(source), "-o", str(out)]) == 0
    texts = lambda: {r["path"].rsplit("/", 1)[1]: r["markdown"] for r in pipelines.latest_texts(spark, str(out)).collect()}
    assert texts()["a.png"] == "hi | there\n" and texts()["z.png"] == "more\n"  # what is there is skipped
    assert cli.main(["convert", str(source), "-o", str(out), "--force"]) == 0 and texts()["a.png"] == "new\n"
    (tmp_path / "plain.png").write_text("one\ntwo")
    capsys.readouterr()
    assert cli.main(["text", str(tmp_path / "plain.png"), "--converter", "tests.test_pipelines:as_boxes", "--picture-scale", "2"]) == 0
    assert capsys.readouterr().out == "one*2.0\ntwo*2.0\n"
    assert cli.main(["raw", str(source / "a.png"), "-o", str(tmp_path / "a.raw.md")]) == 0 and (tmp_path / "a.raw.md").read_text() == "new\n"
    assert cli.main(["report", str(source / "a.png")]) == 0
    assert capsys.readouterr().out == "horizontal 1, vertical 0: horizontal\n- [TEXT] new (0.0, 10.0, 50.0, 0.0)\n"
    assert cli.main(["ask", str(source / "a.png"), "-q", "what is it?"]) == 0 and capsys.readouterr().out == "what 11\n"
    assert cli.main(["text", str(tmp_path / "none")]) == 1 and cli.main(["convert", str(source), "-o", str(out), "-w", "0"]) == 1


def test_single_prompts(spark, tmp_path, capsys):
    (tmp_path / "p.yaml").write_text("system: base\nsystem_vlm: look\nsystem_llm: read\nuser: 'doc {{documento}}{{descripcion}} {{centro_costo}}'\nuser_vlm: 'see {{documento}}'\n")
    (tmp_path / "docs").mkdir()
    for n in "ba":
        (tmp_path / "docs" / f"{n}.md").write_text(f"text {n}")
    (tmp_path / "i.png").write_bytes(b"\x89PNG")
    base = ["-p", str(tmp_path / "p.yaml"), "-M"]
    assert cli.main(["prompt", str(tmp_path / "docs"), *base, "ccc", "-o", str(tmp_path / "r.json")]) == 1  # the stand-in answers no JSON where none is asked for
    assert "no JSON object" in capsys.readouterr().err
    assert cli.main(["prompt", str(tmp_path / "docs"), *base, "kvg", "-o", str(tmp_path / "r.json")]) == 0
    got = json.loads((tmp_path / "r.json").read_text())
    assert [k.rsplit("/", 1)[1] for k in got] == ["a.md", "b.md"] and all(v["first_word"] == "doc" for v in got.values())
    capsys.readouterr()
    assert cli.main(["prompt", str(tmp_path / "i.png"), *base, "kvi"]) == 0
    assert json.loads(capsys.readouterr().out) == {"n_messages": 2, "n_chars": 4, "first_word": "see"}
    assert cli.main(["prompt", str(tmp_path / "docs"), *base, "mcc"]) == 1 and "cost centre" in capsys.readouterr().err
    assert cli.main(["prompt", str(tmp_path / "docs"), *base, "cfc", "--cost-center", "CC0001"]) == 1 and "macro category" in capsys.readouterr().err


def test_ordered_export_of_a_folder(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for n in "ba":
        (tmp_path / "docs" / f"{n}.md").write_text(f"text {n}")
    assert cli.main(["extract", str(tmp_path / "docs"), "-o", str(tmp_path / "out"), "--export", str(tmp_path / "all.json")]) == 0
    got = json.loads((tmp_path / "all.json").read_text())
    assert [x["archivo"].rsplit("/", 1)[1] for x in got] == ["a.md", "b.md"] and set(got[0]["extracciones"]) == set(pipelines.EXTRACTION)
    assert got[0]["extracciones"][pipelines.EXTRACTION[0]]["n_messages"] == 2


def test_detected_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (200).to_bytes(4, "big") + (100).to_bytes(4, "big")
    items = [["text", "t", 1, 0, 10, 5, 0], ["picture", None, 1, 10, 90, 60, 40], ["picture", None, 1, None, None, None, None], ["picture", None, 1, 150, 50, 400, 20]]
    rows = [("x/a.png", png), ("x/b.png", b"no image")]
    got = pipelines.detected_images(spark.createDataFrame(rows, "path string, content binary"), functools.partial(fixed_items, items), str(tmp_path), lambda content, box: repr(box).encode()).collect()
    assert {r["name"]: (tmp_path / r["name"]).read_text() for r in got} == {"a_detected_0.png": "(10, 10, 60, 60)", "a_detected_2.png": "(150, 50, 200, 80)"}


def fixed_items(items):
    return lambda path, content: [tuple(x) for x in items]


def test_tagged_jobs_are_stopped(spark):
    from quillspark.operators import ops

    failed = []

    def work():
        with ops.tagged(spark, "test-stop"):
            try:
                spark.range(10**9).repartition(4).selectExpr("sum(hash(id, 'x'))").collect()
                spark.range(10**11).selectExpr("sum(hash(id, 'x'))").collect()
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    thread = InheritableThread(target=work, session=spark)
    thread.start()
    for _ in range(60):
        time.sleep(0.5)
        ops.stop(spark, "test-stop")
        if not thread.is_alive():
            break
    thread.join(30)
    assert failed and "cancel" in str(failed[0]).lower()
    assert spark.range(3).count() == 3


def test_servers_are_asked_again(monkeypatch):
    calls = []

    def answer(request, timeout):
        calls.append(timeout)
        if len(calls) < 3:
            raise urllib.error.URLError("down")
        return io.BytesIO(b'{"message": {"content": "yes"}}')

    monkeypatch.setattr(urllib.request, "urlopen", answer)
    assert models.HttpBackend("http://x", "m", wait=0.0)([{"role": "user", "content": "?"}], True) == "yes" and len(calls) == 3
    calls.clear()
    with pytest.raises(OSError):
        models.HttpBackend("http://x", "m", retries=1, wait=0.0)([{"role": "user", "content": "?"}], True)


def test_stream_processes_files_once(spark, tmp_path):
    write_sources(tmp_path / "in")
    (tmp_path / "in" / "sub" / "b.PDF").rename(tmp_path / "in" / "b.PDF")

    def run():
        stream = front.watch_files(spark, str(tmp_path / "in"), files.SOURCE_SUFFIXES)
        front.process_stream(stream, lambda df, n: pipelines.convert_documents(df, converter.json_converter), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    assert run().count() == 3
    (tmp_path / "in" / "z.png").write_text("[]")
    out = run()
    assert out.count() == 4 and front.latest(spark, str(tmp_path / "out")).count() == 4
    assert out.select(F.countDistinct("batch")).first()[0] == 2
