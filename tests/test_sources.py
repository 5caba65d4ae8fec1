import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from docquarry.cli import main
from docquarry.operators.index import Index
from docquarry.plans.pipeline import scan
from docquarry.sources import files as S
from docquarry.sources import sinks
from docquarry.operators.search import SearchParams
from docquarry.sources.store import Store


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, data in entries:
            z.writestr(n, data)
    return out.getvalue()


DOCX = zipped([("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Ledger</w:t></w:r></w:p><w:p><w:r><w:t>gar</w:t></w:r><w:r><w:t>den</w:t></w:r></w:p></w:body></w:document>')])
XLSX = zipped([("xl/workbook.xml", "<w/>"), ("xl/sharedStrings.xml", '<sst xmlns="s"><si><t>plum jam</t></si></sst>'), ("xl/worksheets/sheet1.xml", '<worksheet xmlns="s"><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>')])
PPTX = zipped([(f"ppt/slides/slide{i}.xml", f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Slide {i}</a:t></a:r></a:p></p:sld>') for i in (10, 2, 1)])


def test_readers():
    assert S.extract(DOCX, "a.docx") == "Ledger\ngarden"
    assert S.extract(XLSX, "a.xlsx") == "plum jam\t7"
    assert S.extract(PPTX, "a.pptx") == "Slide 1\n\nSlide 2\n\nSlide 10"
    assert S.extract(b"hello world", "readme.me") == "hello world"
    assert S.extract(b"x", "a.pdf") == ""
    assert S.extract(b"x", "a.png", backends={"image": lambda raw, lang: f"seen {lang}"}) == "seen eng"
    assert S.extract(rb"{\rtf1 Ledger\par \'e9t\'e9}", "a.rtf") == "Ledger\nété"
    assert S.html_text("<p>a<script>no</script></p><p>b &amp; c</p>") == "a\nb & c"
    for raw, name in ((b"\x00\x01", "x.bin"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "a.docx"), (b"x", "a.doc"), (b"no zip", "a.docx")):
        with pytest.raises(Exception):
            S.extract(raw, name)


def test_archives():
    raw = zipped([("a.txt", "one"), ("b.docx", DOCX), ("c.zip", b"x"), ("d.bin", bytes([0, 1]))])
    assert S.archive_entries(raw, "x.zip") == [("a.txt", "one", None), ("b.docx", "Ledger\ngarden", None), ("c.zip", "", "nested archive"), ("d.bin", "", "binary")]
    assert S.extract(raw, "x.zip").startswith("─── a.txt ───\none")
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        info = tarfile.TarInfo("t.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"two"))
    assert S.archive_entries(out.getvalue(), "x.tar.gz") == [("t.txt", "two", None)]


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "root"
    for name, text in {"alpha.txt": "apple banana", "beta.md": "cherry date", "_keep.txt": "kept words", ".hidden.txt": "no", "sub/gamma.txt": "apple banana", "sub/deep/x.tmp": "no", "sub/deep/y.txt": "elderberry", "z.xyz": "no", "__pycache__/c.txt": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "link.txt").symlink_to(root / "alpha.txt")
    return root


def test_listing(spark, tree):
    rows = S.listing(spark, [("d1", str(tree))]).collect()
    assert {r["path"] for r in rows if not r["is_dir"]} == {"alpha.txt", "beta.md", "_keep.txt", "sub/gamma.txt", "sub/deep/y.txt"}
    assert {r["path"] for r in rows if r["is_dir"]} == {"sub", "sub/deep"}
    flat = S.listing(spark, [("d1", str(tree))], globs=("beta*",), recursive=False).where("not is_dir").collect()
    assert {r["path"] for r in flat} == {"alpha.txt", "_keep.txt"}
    one = S.list_one(spark, str(tree), spark.createDataFrame([("alpha.txt", 1)], "path string, indexed int")).collect()
    assert [r["name"] for r in one] == ["sub", "_keep.txt", "alpha.txt", "beta.md"] and one[2]["indexed"] == 1


def test_scan_incremental_equals_rebuild(spark, tree, tmp_path, capsys):
    state, index = str(tmp_path / "state"), str(tmp_path / "index")
    roots = [("d1", str(tree))]
    first = {r["change"]: r["n"] for r in scan(spark, roots, state, index, 100).collect()}
    assert first == {"created": 5}
    store = Store(spark, state)
    assert store.current("contents").count() == 4 and store.current("files").where("indexed = 1").count() == 5
    hits = lambda q: Index(spark, index).search(q).count()
    assert (hits("banana"), hits("cherry"), hits("elderberry"), hits("kept")) == (2, 1, 1, 1)
    (tree / "beta.md").write_text("fig grape and more")
    (tree / "new.txt").write_text("honeydew")
    (tree / "alpha.txt").unlink()
    second = {r["change"]: r["n"] for r in scan(spark, roots, state, index, 200).collect()}
    assert second == {"created": 1, "modified": 1, "deleted": 1, "unchanged": 3}
    assert (hits("banana"), hits("cherry"), hits("grape"), hits("honeydew")) == (1, 0, 1, 1)
    assert store.current("files").where("status = 'deleted'").select("path").collect()[0]["path"] == "alpha.txt"
    scan(spark, roots, str(tmp_path / "s2"), str(tmp_path / "i2"), 300)
    for q in ("banana", "grape", "honeydew", "elderberry"):
        assert hits(q) == Index(spark, str(tmp_path / "i2")).search(q).count()
    assert main(["--index", index, "search", "banana"]) == 0 and "gamma.txt (txt)" in capsys.readouterr().out
    assert main(["--index", index, "health"]) == 0


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.version() is None and store.versions() == []
    with pytest.raises(FileNotFoundError):
        store.current("t")
    for i in range(4):
        store.publish(t=spark.range(i + 1), u=spark.range(2))
    old = store.current("t")
    store.publish(t=spark.range(9))
    assert old.count() == 4 and store.current("t").count() == 9 and store.current("u").count() == 2
    store.restore(2)
    assert store.current("t").count() == 2
    assert store.retain(2) == [1, 3] and store.versions() == [2, 4, 5]
    assert store.status().where("published").first()["version"] == 2
    store.compact("t", 1)
    assert store.version() == 6 and store.current("t").count() == 2


def test_hash_and_reading(spark, tmp_path):
    for n, b in (("a.txt", b"same"), ("b.txt", b"same"), ("c.bin", bytes([0, 1]))):
        (tmp_path / n).write_bytes(b)
    files = S.with_hashes(spark.createDataFrame([(str(tmp_path / n),) for n in ("a.txt", "b.txt", "c.bin", "gone.txt")], "path string"))
    assert [r["md5"] is None for r in files.orderBy("path").collect()] == [False, False, False, True]
    got = S.read_texts(files).collect()
    assert len(got) == 2 and {r["text_content"] for r in got} == {"same", None} and sum(r["error"] is not None for r in got) == 1
    (tmp_path / "log.txt").write_text("one\ntwo\n")
    assert [(r["line_no"], r["line"]) for r in S.log_lines(spark, str(tmp_path / "log.txt")).collect()] == [(1, "one"), (2, "two")]


def test_sinks(spark, tmp_path):
    hits = spark.createDataFrame([('say "x", y.txt', "txt", "/p", 1.5, 7, "some\nsnippet")], "file_name string, file_ext string, path string, score double, file_size long, snippet string").withColumn("mtime", F.timestamp_micros(F.lit(1_000_001)))
    sinks.export_csv(hits, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back["file_name"] == 'say "x", y.txt' and back["mtime"] == "1000001"
    sinks.export_text(hits, str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).first()[0] == 'say "x", y.txt (txt): some snippet'
    assert sinks.history_filters(["a", "b"], None, "2024") == "ext:a,b;to:2024" and sinks.history_filters(None, None, None) is None
    h = spark.createDataFrame([("1", False), ("2", True)], "id string, pinned boolean")
    assert sinks.pinned(h, "1", True).where("pinned").count() == 2 and sinks.removed(h, "1").count() == 1 and sinks.removed(h).count() == 0
    for bad in (lambda: sinks.pinned(h, "9", True), lambda: sinks.removed(h, "9"), lambda: sinks.update_settings(spark.createDataFrame([], "key string, value string"), {"nope": "1"})):
        with pytest.raises(KeyError):
            bad()
    s = sinks.update_settings(spark.createDataFrame([("ocr_lang", "eng"), ("max_results", "5")], "key string, value string"), {"ocr_lang": "deu"})
    assert sinks.settings_map(s).first()[0] == {"ocr_lang": "deu", "max_results": "5"}
    d = spark.createDataFrame([("1", "/a", None)], "id string, path string, alias string")
    assert sinks.update_directory(d, "1", {"alias": "x", "path": None}).first()[:] == ("1", "/a", "x")
    with pytest.raises(ValueError):
        sinks.add_directory(d, {"id": "2", "path": "/a"})
    assert sinks.add_directory(d, {"id": "2", "path": "/b"}).count() == 2
    assert sinks.overlaps("/a/b", "/a") and not sinks.overlaps("/a/b", "/a/bc")
    for n in ("p", "q"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "f.txt").write_text(n)
    assert sinks.zip_files([str(tmp_path / n / "f.txt") for n in "pq"], str(tmp_path / "o.zip")) == 2
    with pytest.raises(ValueError):
        sinks.zip_files([str(tmp_path / "p" / "f.txt")], str(tmp_path / "o2.zip"), limit=0)
    sinks.append(h, str(tmp_path / "log"))
    sinks.append(h, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def make_pdf(texts, packed=True):
    import zlib

    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(len(texts)))
    out = [b"%PDF-1.4", b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj", f"2 0 obj <</Type /Pages /Kids [{kids}]>> endobj".encode()]
    for i, t in enumerate(texts):
        body = b"BT /F1 12 Tf 72 700 Td " + b" T* ".join(b"(" + x.encode("cp1252").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj" for x in t.split("\n")) + b" ET"
        data = zlib.compress(body) if packed else body
        out += [f"{3 + 2 * i} 0 obj <</Type /Page /Contents {4 + 2 * i} 0 R>> endobj".encode(), f"{4 + 2 * i} 0 obj <</Length {len(data)}{' /Filter /FlateDecode' if packed else ''}>>".encode() + b"\nstream\n" + data + b"\nendstream endobj"]
    return b"\n".join(out)


@pytest.mark.parametrize("packed", [True, False])
def test_pdf(packed):
    from docquarry.sources import pdf

    assert S.extract(make_pdf(["Ledger (PDF) café\nsecond line", "page two"], packed), "a.pdf") == "Ledger (PDF) café\nsecond line\n\npage two"
    stamp = [f"Licensed to Jane Doe of Example Street only 2024-01-0{i} Page {i}" for i in range(1, 6)]
    assert pdf.pages(make_pdf(stamp))[0].startswith("Licensed") and pdf.text(make_pdf(stamp)) == ""
    assert pdf.pages(b"[(a) -300 (b) 20 (c)] TJ") == [] and pdf._shown(b"[(a) -300 (b) 20 (c)] TJ") == "a bc"
    with pytest.raises(ValueError):
        pdf.text(b"trailer <</Encrypt 5 0 R>>")


def changes(df):
    return {r["change"]: r["n"] for r in df.collect()}


def test_scan_moves_files_and_survives_a_death_before_the_index(spark, tree, tmp_path, monkeypatch):
    from docquarry.plans import pipeline

    state, index, roots = str(tmp_path / "state"), str(tmp_path / "index"), [("d1", str(tree))]
    steps = []
    scan(spark, roots, state, index, 100, progress=lambda step, seconds: steps.append(step))
    assert steps == ["listed", "hashed", "read", "published", "indexed"]
    store = Store(spark, state)
    old = store.current("files").where("path = 'alpha.txt'").first()["id"]
    (tree / "sub" / "alpha.txt").write_bytes((tree / "alpha.txt").read_bytes())
    (tree / "alpha.txt").unlink()
    (tree / "late.txt").write_text("quince")

    def die(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(pipeline, "index_waiting", die)
        with pytest.raises(KeyboardInterrupt):
            scan(spark, roots, state, index, 200)
    moved = store.current("files").where("path = 'sub/alpha.txt'").collect()
    assert [r["id"] for r in moved] == [old] and moved[0]["indexed"] == 1 and store.current("waiting").count() > 0
    assert store.current("files").where("path = 'alpha.txt'").count() == 0 and Index(spark, index).search("quince").count() == 0
    assert changes(scan(spark, roots, state, index, 300)) == {"unchanged": 6}
    hits = {r["path"] for r in Index(spark, index).reader().hits(SearchParams("quince OR apple")).collect()}
    assert "late.txt" in hits and store.current("waiting").count() == 0 and "sub/alpha.txt" in hits
    before = store.version()
    assert pipeline.reindex(spark, [old], state, index) == 1 and store.version() > before
    assert changes(scan(spark, roots, state, index, 400)) == {"unchanged": 5, "pending": 1} and store.current("files").where("indexed = 0").count() == 0


def test_second_scan_is_busy_and_a_cancelled_one_deletes_nothing(spark, tree, tmp_path):
    from docquarry.plans.pipeline import Busy, guarded

    state, index, roots = str(tmp_path / "state"), str(tmp_path / "index"), [("d1", str(tree))]
    store = Store(spark, state)
    with guarded(store, "scan"), pytest.raises(Busy):
        scan(spark, roots, state, index, 100)
    with guarded(store, "scan", stale_after=-1.0):
        pass
    scan(spark, roots, state, index, 100)
    (tree / "alpha.txt").unlink()
    (tree / "more.txt").write_text("medlar")
    scan(spark, roots, state, index, 200, cancelled=lambda: True)
    assert store.current("files").where("status = 'deleted'").count() == 0 and Index(spark, index).search("medlar").count() == 1


def test_writer_that_dies_and_two_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.publish(t=spark.range(3), u=spark.range(1))
    number = store.begin()
    spark.range(9).write.parquet(store.path(number, "t"))  # dies before it commits
    assert store.current("t").count() == 3 and store.begin() == number
    one, two = store.begin(), Store(spark, store.root)
    spark.range(5).write.parquet(store.path(one, "t"))
    real = store._pointers()
    store.commit(one, store.manifest(1))
    two._pointers = lambda: real  # what the other writer saw before
    with pytest.raises(OSError):
        two.restore(1)
    assert store.current("t").count() == 5 and store.manifest(one)["u"] == "v=1/u"
    assert store.summary().first()["n"] == 2 and store.copy_to(str(tmp_path / "copy")).current("u").count() == 1


def test_converter_rounds_and_errors(spark, tmp_path):
    paths = [f"/a/{i}.doc" for i in range(40)] + ["/b/3.XLS", "/c/3.ppt"]
    rounds = S.conversion_rounds(paths)
    assert sorted(p for r in rounds for p in r) == sorted(paths) and max(map(len, rounds)) <= 32 and sum(len(r) for r in rounds) == 42
    assert all(len({p.rsplit("/", 1)[1].split(".")[0] for p in r}) == len(r) for r in rounds)
    asked = []

    def convert(part, seconds):
        asked.append(seconds)
        if any("9" in p for p in part):
            raise TimeoutError("slow")
        return {p: f"text of {p}" for p in part if "7" not in p}

    got = S.convert_all(["/x/1.doc", "/x/7.doc", "/y/1.xls"], convert)
    assert got["/x/1.doc"] == "text of /x/1.doc" and isinstance(got["/x/7.doc"], ValueError) and asked == [60.0, 45.0]
    assert isinstance(S.convert_all(["/x/9.doc"], convert)["/x/9.doc"], TimeoutError)
    (tmp_path / "old.doc").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")
    files = spark.createDataFrame([("m", str(tmp_path / "old.doc"))], "md5 string, path string")
    assert S.read_texts(files).first()["error"] and S.read_texts(files, convert=lambda part, s: {p: "made" for p in part}).first()["text_content"] == "made"


def scanned_pdf(n, texts=0):
    out = [b"%PDF-1.4"]
    for i in range(n):
        out += [f"{10 * i + 3} 0 obj <</Type /Page /Resources <</XObject <</Im1 {10 * i + 4} 0 R /Im2 {10 * i + 5} 0 R>>>>>> endobj".encode()]
        for k, (w, h) in enumerate(((400, 300), (20, 20))):
            out += [f"{10 * i + 4 + k} 0 obj <</Subtype /Image /Width {w} /Height {h} /Filter /DCTDecode>>".encode() + b"\nstream\n" + (f"image {i}" if i < texts else "blank").encode() + b"\nendstream endobj"]
    return b"\n".join(out)


def test_pdf_fallback_order():
    from docquarry.sources import pdf

    def seen(image, lang):
        return f"{image.decode()} in {lang}: " + "recognised words " * 5 if image.startswith(b"image") else ""

    raw = scanned_pdf(4, 4)
    assert pdf.page_images(raw) == [b"image 0", b"image 1", b"image 2", b"image 3"] and pdf.page_images(raw, 1_000_000) == [None] * 4
    got = pdf.best_text(raw, {"image": seen}, "deu")
    assert got.startswith("image 0 in deu") and got.count("\n\n") == 3
    assert pdf.best_text(scanned_pdf(4, 1), {"image": seen}) == "" and pdf.best_text(raw) == ""
    drawn = pdf.best_text(scanned_pdf(4, 1), {"image": seen, "pdf_pages": lambda raw, dpi: [b"image a", b"image b"]})
    assert dict(a=drawn.index("image a"), b=drawn.index("image b")) == dict(a=0, b=drawn.index("image b"))
    tool = "\f".join(f"page {k} tells of something else: {w}" for k, w in enumerate(("plums", "ships and sails", "the weather in May", "old maps")))
    assert pdf.best_text(raw, {"pdf_text": lambda raw, lang: tool, "image": seen}) == tool
    assert pdf.best_text(raw, {"pdf_text": lambda raw, lang: "same line\n" * 30, "image": seen}) == pdf.best_text(raw, {"image": seen})


def test_speech_pieces():
    import io
    import wave

    import numpy as np

    from docquarry.functions import media

    rng, rate = np.random.default_rng(1), 16_000
    quiet, loud = (lambda s: rng.normal(0, 5, int(s * rate))), (lambda s: rng.normal(0, 4000, int(s * rate)))
    x = np.concatenate([quiet(2), loud(3), quiet(1), loud(50), quiet(4)])
    parts = media.speech_segments(x)
    assert all((b - a) / rate <= 30.1 for a, b in parts) and abs(parts[0][0] / rate - 2) < 0.1 and sum(b - a for a, b in parts) / rate == pytest.approx(53, abs=0.5)
    assert media.speech_segments(np.zeros(rate * 60)) == [(0, 28 * rate), (28 * rate, 56 * rate), (56 * rate, 60 * rate)] and media.speech_segments(np.zeros(0)) == []
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.repeat(x[::2].astype(np.int16), 2).tobytes())
    pieces = media.wav_pieces(out.getvalue())  # from 8 kHz: the same speech, cut elsewhere
    assert all(len(p) / 2 / rate <= 30.1 for p in pieces) and sum(map(len, pieces)) / 2 / rate == pytest.approx(53, abs=0.5)
    assert S.extract(out.getvalue(), "a.wav", backends={"speech": lambda piece, lang: "heard"}) == " ".join(["heard"] * len(pieces))


def test_archive_limits_can_be_lifted():
    raw = zipped([(f"{i}.txt", "x") for i in range(1005)])
    assert len(S.archive_entries(raw, "a.zip")) == 1001 and len(S.archive_entries(raw, "a.zip", limits=S.ArchiveLimits(None, None, None))) == 1005
