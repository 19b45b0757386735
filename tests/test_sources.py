"""Sources, models, OCR, streams and flows."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewell.operators import ocr
from tracewell.plans import flows
from tracewell.sources import docx, files, models
from tracewell.streaming import sessions

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def word(body: str, **parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml", f'<w:{name} xmlns:w="{W}">{xml}</w:{name}>')
    return out.getvalue()


P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
BODY = P.format("Witness statement") + '<w:p><w:r><w:t>Seen</w:t><w:footnoteReference w:id="2"/></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:rPr><w:vanish/></w:rPr><w:t>secret</w:t></w:r><w:r><w:br w:type="page"/></w:r></w:p>' + "<w:tbl><w:tr><w:tc>" + P.format("a") + "</w:tc><w:tc>" + P.format("b") + "</w:tc></w:tr></w:tbl>"


def test_docx():
    pages = docx.read_docx(word(BODY, footnotes='<w:footnote w:id="2"><w:p><w:r><w:t>a note</w:t></w:r></w:p></w:footnote>'))
    assert pages == ["Witness statement\nSeen [footnote: a note]<<struck: gone>><<hidden: secret>>", "a | b"]
    assert docx.missing(["the quick brown fox jumps over", "held words are all here today"], ["Held words are ALL here, today."]) == ["the quick brown", "fox jumps over"]


def test_uploads_and_ingest(spark, tmp_path):
    content = word(BODY)
    for name in ("a sworn statement.docx", "copy.docx"):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "skip.exe").write_bytes(b"x")
    found = files.read_uploads(spark, str(tmp_path))
    assert found.count() == 2
    docs, pages = flows.ingest(found)
    assert {(r.status, r.doc_kind) for r in docs.collect()} >= {("done", "statement")}
    assert pages.where("error is not null").count() == 1 and pages.where("error is null").count() == 2


def test_models(spark):
    def call(texts):
        if any(t == "bad" for t in texts):
            raise ValueError("no")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "k int, t string")
    got = {r.k: (r.out, r.out_error) for r in models.apply_model(df, "t", call, "out", "string").collect()}
    assert got == {1: ("A", None), 2: (None, "no"), 3: ("", None)}
    chunks = spark.createDataFrame([("c1", "d", 1, "the red car"), ("c2", "d", 2, "a blue house")], "chunk_id string, doc_id string, page_num int, text string")
    held = spark.createDataFrame([], "chunk_id string, embedding array<float>, model string")
    vectors = flows.index(chunks, held, models.HashEmbedder(), "hash")
    assert flows.search(chunks, "red car", 1, vectors, models.HashEmbedder()).first().chunk_id == "c1"
    assert flows.search(chunks, "blue house", 1).first().chunk_id == "c2"
    t = spark.createDataFrame([("1", "d", 1, "PERSON", "Ann", "drove", "CLAIM", "the car", None, "q")], "triple_id string, doc_id string, page_num int, subject_type string, subject_name string, predicate string, object_type string, object_name string, event_date string, quote string")
    said = flows.ask("What of Ann?", flows.Store(chunks, chunks, t, chunks), models.EchoModel())
    assert said["answer"] == "What of Ann?" and said["relationships"] == ["Ann drove the car (undated) [d p.1]"]


def test_ocr(spark):
    words = [("d", 1, "world", 60, 10, 50, 10, 90.0), ("d", 1, "Hello", 0, 11, 50, 10, 90.0), ("d", 1, "Next", 0, 40, 40, 10, 60.0)]
    df = spark.createDataFrame(words, "doc_id string, page_num int, text string, left int, top int, width int, height int, conf double")
    page = ocr.read_pages(df)
    assert page.first().text == "Hello  world\nNext" and ocr.route(page).first().route == "vlm"
    todo = spark.createDataFrame([("d", 1, "vlm", None, b"x"), ("d", 2, "vlm", None, b""), ("d", 3, "ocr", None, b"x")], "doc_id string, page_num int, route string, text string, image binary")
    got = {r.page_num: (r.text, r.error) for r in ocr.transcribe(todo, lambda b: {b"x": "read"}[b]).collect()}
    assert got[1] == ("read", None) and got[2][0] is None and 3 not in got


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:10:00"), (1, "2024-01-01 12:00:00"), (2, "2024-01-03 00:00:00")], "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.events for r in sessions.sessions(e).collect()) == [1, 1, 2]
    e.write.parquet(str(tmp_path / "in"))
    stream = sessions.sessions(sessions.read_events(spark, str(tmp_path / "in"), e.schema), late="1 hour")
    q = stream.writeStream.format("memory").queryName("s").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.events for r in spark.table("s").collect()) == [1, 2]
    log = spark.createDataFrame([("r", 1, "token", "ab"), ("r", 2, "token", "c")], "run_id string, seq int, kind string, data string")
    assert [r.data for r in sessions.follow(log, 2).collect()] == ["c"]
    seen = []
    raw = spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "content binary")
    raw.write.parquet(str(tmp_path / "raw"))
    files_in = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "raw"))
    sessions.ingest(files_in, str(tmp_path / "ck"), lambda df: seen.append(df.count())).awaitTermination(60)
    assert sum(seen) == 2


def test_audit_finds_what_the_walk_lost():
    from tracewell.sources import docx

    held = ["The quick brown fox jumps over the lazy dog again and again."]
    assert docx.missing(["The quick  BROWN fox jumps over the lazy dog"], held) == []
    lost = docx.missing(["the quick brown fox jumps while nobody was looking at all"], held)
    assert " ".join(lost).endswith("nobody was looking at all") and "quick" not in " ".join(lost)
    assert docx.missing(["too short"], held) == [] and docx.missing(["supercalifragilisticexpialidocious"], held) == ["supercalifragilisticexpialidocious"]
    lost = word(BODY.replace("</w:body>", "<w:other><w:t>A text box that nobody looks at, with enough of it.</w:t></w:other></w:body>")) if "</w:body>" in BODY else None
    if lost is not None:
        assert any("text box" in p for p in docx.read_docx(lost))


def test_calls_are_tried_again():
    class Shaky:
        def __init__(self, failures):
            self.failures = failures

        def generate(self, prompts):
            if self.failures:
                raise self.failures.pop()
            return prompts

        def embed(self, texts):
            return [(1, [1.0]), (0, [0.0])]

    retry = lambda *f, **k: models.Retry(Shaky(list(f)), wait=0, **k)
    assert retry(ConnectionError(), ConnectionError()).generate(["a"]) == ["a"] and retry().embed(["a", "b"]) == [[0.0], [1.0]]
    for failure in (models.ContextOverflow(), TimeoutError("read"), models.Cancelled()):
        with pytest.raises(type(failure)):
            retry(failure, passing=(ConnectionResetError,)).generate(["a"])
    with pytest.raises(ConnectionError):
        retry(*[ConnectionError()] * 3).generate(["a"])
