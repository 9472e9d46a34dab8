"""Golden values of Kannada repair, an independent model for distances, stream = batch."""

import datetime as dt
import math
import pathlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textmend import catalog, cli, staging
from textmend.functions import text as T
from textmend.operators import candidates, correct, heal, layout, lexicon, morph
from textmend.plans.document import Engine
from textmend.script import KANNADA, LATIN
from textmend.sources import backends, files, sinks
from textmend.streaming import stream

WORDS = "ಕನ್ನಡ ಶಾಂತಿ ಪ್ರಮುಖ ಪಾತ್ರ ಜೀವನದಲ್ಲಿ ವಹಿಸುತ್ತದೆ ಕರ್ನಾಟಕ ಜೀವನ ಸಂಗೀತ ಕಾಫಿ ದೂಷಿಸು ಯೋಜನೆ".split()


@pytest.fixture(scope="module")
def lex(spark):
    return lexicon.Lexicon(lexicon.literal_table(spark, [(w,) for w in WORDS], ["word"]))


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_tokens_join_to_the_text(spark):
    t = "ಕನ್ನಡ 123 English ! ಶಾಂತಿ .ೱ"
    toks = one(spark, T.tokens(F.lit(t), KANNADA))
    assert "".join(x.value for x in toks) == t and toks[0].value == "ಕನ್ನಡ"
    assert sum(x.type == "word" for x in toks) == 2
    assert all(t[x.start : x.end] == x.value and x.pos == i for i, x in enumerate(toks))
    long_ = "ಕ 1" * 700
    got = one(spark, T.tokens(F.lit(long_), KANNADA))
    assert "".join(x.value for x in got) == long_ and [x.pos for x in got] == list(range(len(got)))
    assert one(spark, T.tokens(F.lit(""), KANNADA)) == [] and one(spark, T.tokens(F.lit(None).cast("string"), KANNADA)) is None


@pytest.mark.parametrize("bad,good", [("ಕನಾ೯ಟಕ", "ಕರ್ನಾಟಕ"), ("ಕತ೯ವ್ಯ", "ಕರ್ತವ್ಯ"), ("ಮಾ೯", "ರ್ಮಾ"), ("ಗ್ರಹಿಸಿಕೊ೦ಂಡೇ", "ಗ್ರಹಿಸಿಕೊಂಡೇ")])
def test_normalise(spark, bad, good):
    assert one(spark, T.normalise(F.lit(bad), KANNADA)) == good
    assert one(spark, T.normalise(F.lit(good), KANNADA)) == good


@pytest.mark.parametrize("root,suf,word", [("ವಹಿಸು", "ುತ್ತದೆ", "ವಹಿಸುತ್ತದೆ"), ("ಮನಸ್ಸು", "ಗೆ", "ಮನಸ್ಸಿಗೆ"), ("ಮಾಡಿಕೊಡು", "ತ್ತಾರೆ", "ಮಾಡಿಕೊಡುತ್ತಾರೆ")])
def test_sandhi(spark, root, suf, word):
    assert one(spark, T.join_suffix(F.lit(root), F.lit(suf), KANNADA)) == word


def test_suggest(spark, lex):
    want = {"ಕಾಥಿ": ("ಕಾಫಿ", "ocr_repair"), "ದೂಹಿಸು": ("ದೂಷಿಸು", "ocr_repair"), "ಯೋಪನೆ": ("ಯೋಜನೆ", "ocr_repair"), "ಕನಾ೯ಟಕ": ("ಕರ್ನಾಟಕ", "ocr_repair"), "ಜಿವನ": ("ಜೀವನ", "word_correction"), "ಸಂಗಿತ": ("ಸಂಗೀತ", "word_correction"), "ಕ": ("ಕ", "none")}
    got = correct.suggest(lexicon.literal_table(spark, [(w,) for w in want], ["word"]), lex, KANNADA).collect()
    assert {r.word: (r.correction, r.type) for r in got} == want


def test_whole_text_and_stream(spark, lex, tmp_path):
    rows = [(1, "ಸಂಗೀತ ಜಿವನದಲ್ಲಿ ಪ್ರಮುಖ ಪಾತ್ರ ವಹಿಸುತದೆ. 12 abc"), (2, "ಕರ್ ನಾಟಕ"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    batch = {r.doc_id: r for r in Engine(lex, KANNADA).correct(df).collect()}
    assert "ಜೀವನದಲ್ಲಿ" in batch[1].corrected and "ವಹಿಸುತ್ತದೆ" in batch[1].corrected
    assert batch[1].has_errors and batch[1].total_corrections == 2 and batch[1].total_words == 5 and batch[1].accuracy_rate == 60.0
    assert batch[2].corrected == "ಕರ್ನಾಟಕ" and batch[2].corrections[0].edit_distance == 0.5
    assert batch[3].corrected == "" and batch[4].corrected is None and not batch[4].has_errors
    df.write.parquet(str(tmp_path / "in"))
    got = {}
    q = stream.correct_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lex, KANNADA, lambda d, i: got.update({r.doc_id: r for r in d.collect()}), str(tmp_path / "ck"), trigger={"availableNow": True})
    q.awaitTermination()
    assert got == batch


def model_distance(a, b, costs, limit=4.0):
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (0 if x == y else costs.get((x, y), 1.0))))
        row = new
        if min(row) > limit:
            return limit + 1
    return row[-1]


def test_weighted_distance_equals_the_model(spark):
    r = random.Random(3)
    pairs = [("".join(r.choices("lieceuvh", k=r.randint(0, 8))), "".join(r.choices("lieceuvh", k=r.randint(0, 8)))) for _ in range(300)]
    costs = {(a, b): c for a, b, c, _ in LATIN.directed}
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.weighted_distance(F.col("a"), F.col("b"), LATIN).alias("d"))
    assert all(abs(x.d - model_distance(x.a, x.b, costs)) < 1e-9 for x in df.collect())


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "w.dic").write_text("3\nಮನೆ/1,9\nಮರ\nabc/1\n\nಊರು/2\n")
    (tmp_path / "w.aff").write_text("SET UTF-8\nSFX 1 Y 2\nSFX 1 0 ಗಳು\nSFX 1 0 0/77\nSFX 2 Y 1\nSFX 2 ು ಿನ/3 .\n")
    got = lexicon.load(spark, str(tmp_path / "w.dic"), KANNADA, str(tmp_path / "w.aff"), ["ಕನ್ನಡ"])
    assert {r.word for r in got.collect()} == {"ಮನೆ", "ಮನೆಗಳು", "ಮರ", "ಊರು", "ಊರಿನ", "ಕನ್ನಡ"}


def test_neighbours_cross_partitions(spark):
    words = [(f"w{i:04d}",) for i in range(500)]
    rows = lexicon.ordered(spark.createDataFrame(words, "word string").repartition(7)).orderBy("ord").collect()
    assert [r.word for r in rows] == [w for w, in words] and [r.ord for r in rows] == list(range(500))
    assert all(rows[i].after == rows[i + 1].word and rows[i + 1].before == rows[i].word for i in range(499))


class FakePdf:
    """Pages parted by |, blocks by ;. A leading ? marks pictures without blocks, a leading ! a broken file."""

    def info(self, content):
        if content.startswith(b"!"):
            raise OSError("broken")
        return (0 if content == b"none" else content.count(b"|") + 1), {"title": "t"}

    def blocks(self, content):
        if content.startswith(b"?"):
            return
        for n, page in enumerate(content.decode().split("|"), 1):
            for i, t in enumerate(page.split(";")):
                yield dict(page_num=n, page_width=600.0, seq=i, x0=10.0, y0=12.0 * i, x1=500.0, y1=12.0 * i + 10, text=t, block_type=0)

    def pages(self, content, dpi, first, last):
        for n, page in enumerate(content.lstrip(b"?").split(b"|"), 1):
            yield n, page


class FakeOcr:
    def languages(self):
        return ["kan"]

    def boxes(self, image, lang, psm=3, oem=3):
        for i, w in enumerate(image.decode().split()):
            yield dict(seq=i, block_num=0, par_num=1, line_num=i // 3, left=60 * i, top=0, width=50, height=10, conf=90.0, text=w, page_width=720)


def test_documents(spark, lex, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pdf").write_bytes(("ಸಂಗಿತ ಪ್ರಮುಖ\n\nಪಾತ್ರ" + ";ಕಾಥಿ" * 30 + "|ಜಿವನ").encode())
    (src / "b.png").write_bytes("ಯೋಪನೆ ಪಾತ್ರ".encode())
    (src / "c.txt").write_text("x")
    found = files.read_folder(spark, str(src))
    assert found.count() == 2
    res = Engine(lex, KANNADA, FakeOcr(), FakePdf()).process(spark.read.format("binaryFile").load(str(src)))
    rep = {r.doc_id.rsplit("/", 1)[1]: r for r in res.report.collect()}
    assert rep["a.pdf"].total_pages == 2 and "ಸಂಗೀತ" in rep["a.pdf"].full_text and rep["a.pdf"].full_text.endswith("ಜೀವನ")
    assert rep["b.png"].full_text == "ಯೋಜನೆ ಪಾತ್ರ" and rep["b.png"].generated_files.json.startswith("b-") and rep["b.png"].generated_files.json.endswith("_report.json")
    assert [r.error for r in res.rejected.collect()] == ["unsupported file type"]
    sinks.write_pages(res.pages, str(tmp_path / "pages"))
    sinks.write_reports(res.report, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).count() == 2
    assert any("page_002.txt" in str(p) for p in (tmp_path / "pages").rglob("*"))
    assert "<p style=" in sinks.printable(res.lines).first().html


def test_every_file_has_a_way(spark, lex, tmp_path):
    """PDFs without blocks, with blank pages, few characters, too many or no pages, and broken ones: lines or a reason, never neither."""
    texts = {
        "/a/none.pdf": "?ಸಂಗಿತ|ಜಿವನ", "/b/none.pdf": "?|", "/a/few.pdf": "ಕಾಥಿ", "/a/many.pdf": "x|" * 500, "/a/zero.pdf": "none", "/a/bad.pdf": "!", "/a/x.zip": "z", "/a/i.png": "ಯೋಪನೆ",
    }
    df = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in texts.items()], "path string, content binary")
    engine = Engine(lex, KANNADA, FakeOcr(), FakePdf())
    res = engine.process(df)
    pages = {(r.doc_id, r.page_num): r.corrected_text for r in res.pages.collect()}
    assert pages == {("/a/none.pdf", 1): "ಸಂಗೀತ", ("/a/none.pdf", 2): "ಜೀವನ", ("/b/none.pdf", 1): "", ("/b/none.pdf", 2): "", ("/a/few.pdf", 1): "ಕಾಫಿ", ("/a/i.png", 1): "ಯೋಜನೆ"}
    why = {r.doc_id: r.error for r in res.rejected.collect()}
    assert why == {"/a/many.pdf": "PDF has 501 pages; the limit is 500", "/a/zero.pdf": "PDF has no pages", "/a/bad.pdf": "OSError: broken", "/a/x.zip": "unsupported file type"}
    report = {r.doc_id: r for r in res.report.collect()}
    assert report.keys() | why.keys() == set(texts) and not report.keys() & why.keys() and report["/b/none.pdf"].total_pages == 2
    names = {r.generated_files.text for r in report.values()}
    assert len(names) == len(report)  # /a/none.pdf and /b/none.pdf stay apart
    sinks.write_combined(res.report, str(tmp_path / "text"))
    assert len(list((tmp_path / "text").glob("doc=*"))) == len(report)
    assert {(r.doc_id, r.page_num): r.text for r in backends.plain_text(engine.intake(df).images, FakeOcr()).collect()}["/b/none.pdf", 2] == ""


def test_printable_breaks_where_the_page_changes(spark, tmp_path):
    rows = [("d", 1, 1, "a"), ("d", 1, 2, "b"), ("d", 2, 3, "c"), ("e", 1, 1, "x")]
    lines = spark.createDataFrame(rows, "doc_id string, page_num int, line_ord int, text string").withColumn("alignment", F.lit("L"))
    html = {r.doc_id: r.html for r in sinks.printable(lines).collect()}
    assert html["d"].count('class="page"') == 1 and html["d"].index("b</p>") < html["d"].index('class="page"') < html["d"].index("c</p>") and 'class="page"' not in html["e"]

    class Writer:
        def write(self, pages, header, footer):
            return "|".join(",".join(x["text"] for x in p) for p in pages).encode() + header.encode()

    sinks.write_documents(lines, Writer(), str(tmp_path / "w"), header="!")
    assert {bytes(r.content) for r in spark.read.parquet(str(tmp_path / "w")).collect()} == {b"a,b|c!", b"x!"}


def test_no_staged_table_is_left(spark, lex, tmp_path):
    left = lambda: {r.path for r in _staged(spark)}
    before = left()
    df = spark.createDataFrame([(1, "ಸಂಗಿತ ಕನಾ ೯ಟಕ"), (2, None)], "doc_id long, text string")
    with staging.scope():
        assert correct.correct(df, lex, KANNADA).texts().count() == 2
    assert left() == before
    for i in range(3):
        df.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    seen = []
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    stream.correct_stream(reader, lex, KANNADA, lambda d, i: seen.append(d.count()), str(tmp_path / "ck"), trigger={"availableNow": True}).awaitTermination()
    assert sum(seen) == 6 and len(seen) >= 3 and left() == before


def _staged(spark):
    import collections
    import pathlib

    folder = staging.shared_dir(spark).removeprefix("file:")
    return [collections.namedtuple("P", "path")(str(p)) for p in pathlib.Path(folder).glob("stage-*")]


def test_sessions_keep_the_newest_state(spark, tmp_path):
    """A late event changes nothing newer, across micro-batches; a burst of edits gives its last text."""
    schema = "session_id string, ts timestamp, upload_path string, total_pages int, stage string, percent int"
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batches = [[("s", at(5), "u1", None, "ocr", 40)], [("s", at(2), "u0", 7, "inspecting", 5)], [("s", at(6), None, None, "exporting", 92)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        time.sleep(0.01)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = []
    q = stream.sessions(reader).writeStream.outputMode("update").foreachBatch(lambda d, i: got.extend(d.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(got, key=lambda r: r.events)
    assert (last.upload_path, last.total_pages, last.stage, last.percent, last.events) == ("u1", 7, "exporting", 92, 3)
    edits = [("s", dt.datetime(2024, 1, 1, 0, 0, 0, 100_000 * i), f"t{i}") for i in range(3)] + [("s", dt.datetime(2024, 1, 1, 0, 0, 5), "later")]
    out = stream.settled(spark.createDataFrame(edits, "session_id string, ts timestamp, text string")).collect()
    assert sorted((r.text, r.edits) for r in out) == [("later", 1), ("t2", 3)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "w.dic").write_text("2\nಸಂಗೀತ\nಪಾತ್ರ\n")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes("ಸಂಗಿತ".encode())
    base = ["--dic", str(tmp_path / "w.dic")]
    assert cli.main([*base, "--text", "ಸಂಗಿತ"], spark) == 0 and "ಸಂಗೀತ" in capsys.readouterr().out
    out = str(tmp_path / "out")
    assert cli.main([*base, "--batch", str(tmp_path / "in"), "--output-dir", out, "--save-images"], spark, FakeOcr(), FakePdf()) == 0
    assert spark.read.json(f"{out}/reports").first().full_text == "ಸಂಗೀತ" and spark.read.parquet(f"{out}/images").count() == 1
    assert cli.main(base, spark) == 1
    status = files.system_status(spark, ocr=FakeOcr(), pdf=FakePdf())
    assert status["ocr"] and status["languages"] == ["kan"] and not files.system_status(spark)["pdf"]
    names = files.uploads(spark.createDataFrame([("/x/a b?.PDF", 2 << 20), ("/x/c.exe", 1)], "path string, length long")).collect()
    assert [(r.filename, r.file_size_mb) for r in names] == [("a b.pdf", 2.0)]
    assert files.languages(spark, ["kan", "zzz"]).collect()[1].name == "zzz"
    found = sinks.find_output(spark.createDataFrame([("x_corrected.txt",), ("x_report.json",)], "path string"), "json").collect()
    assert [r.path for r in found] == ["x_report.json"]
    events = sinks.server_events(spark.createDataFrame([(1, "ಅ")], "n int, s string")).first().value
    assert events == 'data: {"n":1,"s":"ಅ"}\n\n'


def test_chains_of_any_length_settle(spark):
    """Every word's choice depends on the choice before it, over more words than any block; equal to the plain fold."""
    words = [f"{a}{b}" for a in "bcdfghjk" for b in ("ea", "oe", "ae", "oo")]
    lx = lexicon.Lexicon(spark.createDataFrame([(w,) for w in words], "word string"))
    r = random.Random(4)
    texts = [" ".join(["beea"] * 150), " ".join(r.choices(["beea", "cea", "ceae", "dooe", "fea", "foe", "xx"], k=120))] + [" ".join(r.choices(["beea", "bea", "cooe", "ceae", "dae", "zzz"], k=r.randint(0, 12))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.corrected for x in correct.correct(df, lx, LATIN).texts().collect()}
    cands = {x.word: x.cands for x in correct.per_word(spark.createDataFrame([(w,) for w in {w for t in texts for w in t.split()}], "word string"), lx, LATIN).collect()}
    n = lx.size

    def score(c, prev, nxt):
        lm = math.log((2.0 if c.seen else 1.0) / (2.0 * n)) + 1.5 * (c.before is not None and prev == c.before) + 1.5 * (c.after is not None and nxt == c.after)
        bonus = max(0.0, min(0.3, (lm + 10.0) / 20.0)) if prev is not None or nxt is not None else 0.0
        return (round(c.cost - bonus, 3), c.gen, c.ord, c.cand)

    assert any(cands.values())
    for i, t in enumerate(texts):
        ws = t.split(" ") if t else []
        new = []
        for k, w in enumerate(ws):
            cs = cands.get(w)
            new.append(min(score(c, new[-1] if new else None, ws[k + 1] if k + 1 < len(ws) else None) for c in cs)[3] if cs else w)
        assert got[i] == " ".join(new)


def test_equal_and_null_ids_are_rows_of_their_own(spark, lex):
    df = spark.createDataFrame([(1, "ಸಂಗಿತ"), (1, "ಜಿವನ"), (None, "ಕಾಥಿ"), (None, "ಕಾಥಿ")], "doc_id long, text string")
    got = sorted(r.corrected for r in correct.correct(df, lex, KANNADA).texts().collect())
    assert got == sorted(["ಸಂಗೀತ", "ಜೀವನ", "ಕಾಫಿ", "ಕಾಫಿ"])


def test_page_runs_follow_changes(spark):
    rows = [("d", i + 1, p) for i, p in enumerate([1, 1, 2, 1, 1])]
    got = layout.page_runs(spark.createDataFrame(rows, "doc_id string, line_ord int, page_num int")).orderBy("line_ord").collect()
    assert [r.run for r in got] == [1, 1, 2, 3, 3]


def test_highlight(spark):
    rows = [(1, "a rn <m> m", [("rn", "m", 0.2, "ocr_repair", 0, 1)]), (2, "x", [])]
    df = spark.createDataFrame(rows, f"doc_id long, corrected string, corrections {correct.CORRECTION}")
    got = {r.doc_id: r.html for r in correct.highlight(df).collect()}
    assert got[1].count('<mark class="diff-blue">m</mark>') == 2 and got[2] == "x"


def test_correction_stages_little(spark, tmp_path, monkeypatch):
    """Tokens and raw candidates of all words are not written: what is staged at any time stays near the input's size."""
    r = random.Random(5)
    letters = "bdfgjkprvwz"
    words = ["".join(r.choices(letters, k=6)) for _ in range(3000)]
    lx = lexicon.Lexicon(spark.createDataFrame([(w,) for w in words], "word string"))
    texts = [(i, " ".join(r.choices(words, k=400)) + " " + "".join(r.choices(letters, k=9)) + "b") for i in range(1500)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(4).write.parquet(str(tmp_path / "in"))
    size = lambda paths: sum(f.stat().st_size for p in paths for f in p.rglob("*.parquet"))
    folder = pathlib.Path(staging.shared_dir(spark).removeprefix("file:"))
    given, old, peak, before = size([tmp_path / "in"]), staging.stage, [0], set(folder.glob("stage-*"))

    def watched(df):
        out = old(df)
        peak[0] = max(peak[0], size(set(folder.glob("stage-*")) - before))
        return out

    for m in (correct, heal, morph, candidates):
        monkeypatch.setattr(m, "stage", watched)
    monkeypatch.setattr(correct, "PORTION", 300, raising=False)
    with staging.scope():
        got = correct.correct(spark.read.parquet(str(tmp_path / "in")), lx, LATIN).texts().agg(F.count("*").alias("n"), F.sum("total_words").alias("w")).first()
    assert (got.n, got.w) == (1500, 1500 * 401)
    assert peak[0] < 1.5 * given, (peak[0], given)


def test_texts_of_one_id_count_once(spark):
    rows = [(None, "aa bb"), (None, "aa cc"), (1, "aa bb"), (2, "bb cc"), (2, "cc"), (3, "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.word for r in lexicon.from_documents(df, LATIN, min_docs=3).orderBy("word").collect()] == ["bb", "cc"]


def test_distances_equal_the_columns(spark):
    r = random.Random(6)
    rows = [("".join(r.choices("acdehiluvnmé", k=r.randint(0, 9))), "".join(r.choices("acdehiluvnmé", k=r.randint(0, 9)))) for _ in range(300)]
    df = spark.createDataFrame([*rows, ("ab", "ab")], "a string, b string")
    got = df.select(T.distances(F.col("a"), F.col("b"), LATIN).alias("x"), T.weighted_distance(F.col("a"), F.col("b"), LATIN).alias("y")).collect()
    assert [x.x for x in got] == [x.y for x in got]


@pytest.mark.parametrize("name", ["correction_summary", "diff_spans"])
def test_queries_of_corrections_stage_little(spark, tmp_path, monkeypatch, name):
    """Beside the texts themselves little is staged at any time; every text's one wrong word is found."""
    r = random.Random(7)
    words = ["".join(r.choices("bdfgjkprvwz", k=6)) for _ in range(2000)]
    wrong = [w[:3] + "y" + w[3:] for w in r.sample(words, 1200)]
    texts = [(i, " ".join(r.choices(words, k=300)) + " " + w) for i, w in enumerate(wrong)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(4).write.parquet(str(tmp_path / "documents.parquet"))
    size = lambda paths: sum(f.stat().st_size for p in paths for f in p.rglob("*.parquet"))
    folder = pathlib.Path(staging.shared_dir(spark).removeprefix("file:"))
    given, old, peak, before = size([tmp_path / "documents.parquet"]), staging.stage, [0], set(folder.glob("stage-*"))

    def watched(df):
        out = old(df)
        peak[0] = max(peak[0], size(set(folder.glob("stage-*")) - before))
        return out

    for m in (correct, heal, morph, candidates, lexicon):
        monkeypatch.setattr(m, "stage", watched)
    with staging.scope():
        rows = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    if name == "diff_spans":
        assert sorted((x.doc_id, x.original) for x in rows) == list(enumerate(wrong))
    else:
        assert sum(x.n for x in rows) == 1200 and sum(x.originals for x in rows) == len(set(wrong))
    assert peak[0] < 2 * given, (peak[0], given)


def _on_disk(spark):
    """Bytes of staged tables and of shuffle files just now."""
    folder = pathlib.Path(staging.shared_dir(spark).removeprefix("file:"))
    dealt = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.stat().st_size for f in folder.rglob("*.parquet")) + sum(dealt.apply(i).length() for i in range(dealt.size()))


@pytest.mark.parametrize("name", ["correction_summary", "diff_spans"])
def test_queries_of_corrections_deal_out_little(spark, tmp_path, monkeypatch, name):
    """Staged tables and shuffle files together, with a dictionary that is too large to be broadcast and texts of many words."""
    r = random.Random(8)
    words = ["".join(r.choices("bdfgjkprvwz", k=6)) for _ in range(4000)]
    wrong = [w[:3] + "y" + w[3:] for w in r.sample(words, 2000)]
    texts = [(i, " ".join([*r.choices(words, k=500), w, *r.choices(words, k=500), w])) for i, w in enumerate(wrong)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(4).write.parquet(str(tmp_path / "documents.parquet"))
    given = sum(f.stat().st_size for f in (tmp_path / "documents.parquet").rglob("*.parquet"))
    staging.free(spark)
    time.sleep(1)
    old, before, peak = staging.stage, _on_disk(spark), [0]

    def watched(df):
        out = old(df)
        peak[0] = max(peak[0], _on_disk(spark) - before)
        return out

    for m in (correct, heal, morph, candidates, lexicon):
        monkeypatch.setattr(m, "stage", watched)
    monkeypatch.setattr(correct, "small", lambda df: df.hint("shuffle_merge"))
    monkeypatch.setattr(correct, "TEXTS", 1 << 20, raising=False)
    with staging.scope():
        rows = catalog.QUERIES[name](spark, str(tmp_path)).collect()
        peak[0] = max(peak[0], _on_disk(spark) - before)
    if name == "diff_spans":
        assert sorted((x.doc_id, x.row, x.original) for x in rows) == [(i, k, w) for i, w in enumerate(wrong) for k in (1, 2)]
    else:
        assert sum(x.n for x in rows) == 4000 and sum(x.originals for x in rows) == len(set(wrong))
    assert peak[0] < 2 * given, (peak[0], given)


def test_a_sieve_loses_no_key_and_few_others_pass(spark):
    keys = spark.range(0, 3000, 3).select(F.concat(F.lit("k "), "id").alias("key"))
    hits = spark.range(60_000).select(F.col("id").alias("__row"), F.concat(F.lit("k "), F.col("id") % 30_000).alias("key"))
    with staging.scope():
        got = {x["__row"] for x in correct.sieved(hits, keys).collect()}
        assert correct.sieved(hits, keys.limit(0)).count() == 0
    right = {i for i in range(60_000) if i % 30_000 < 3000 and i % 30_000 % 3 == 0}
    assert right <= got and len(got) < 8 * len(right)


def test_contenders_are_all_that_can_win(spark):
    """The fold over a word's contenders equals the fold over all its candidates, in any context."""
    r = random.Random(9)
    kind = "array<struct<c:string,d:double,t:string,g:int,o:int,b:string,a:string,s:array<double>>>"
    near = ["p", "q", None, None]

    def cand(i):
        s, up = round(r.choice([0.2, 0.25, 0.3, 0.35]), 3), r.choice([0.0, 0.013, 0.05])
        return (r.choice(["w", f"c{i}"]), 1.0, "t", r.randint(2, 4), i, r.choice(near), r.choice(near), [s, round(s - up, 3), round(s - up - 0.075, 3), round(s - up - 0.15, 3)])

    rows = [(i, [cand(j) for j in range(r.randint(1, 9))]) for i in range(300)]
    got = spark.createDataFrame(rows, f"id int, cands {kind}").select("id", F.to_json("cands").alias("x"), F.to_json(correct.contenders(F.col("cands"))).alias("y")).collect()
    pattern = re.compile("([a-z0-9]+)")
    for x in got:
        for text in ("w", "p w", "w q", "p w q", "q w p", "z w z", "z w q", "p w z", "w w"):
            assert correct.fold(text, [{"key": "w", "cands": x.x}], pattern) == correct.fold(text, [{"key": "w", "cands": x.y}], pattern)
    assert sum(len(x.y) for x in got) < 0.8 * sum(len(x.x) for x in got)
