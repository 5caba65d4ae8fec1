import pytest
from pyspark.sql import functions as F

from docquarry.functions import quality as Q
from docquarry.functions import scalars as S
from docquarry.functions import vectors as V


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_paths(spark):
    rows = [("a/b/x.TXT",), (".env",), ("x.tar.gz",), ("Make",), ("",), (None,), ("d\\e.pdf",)]
    got = values(spark, rows, "p string", S.file_name("p"), S.extension_of("p"))
    assert got == [("x.TXT", "txt"), (".env", ""), ("x.tar.gz", "gz"), ("Make", ""), ("unknown", ""), ("unknown", ""), ("e.pdf", "pdf")]


def test_relative(spark):
    rows = [("/tmp/foo", "/tmp/foo/bar.txt"), ("/tmp/foo/", "/tmp/foo/sub/deep.txt"), ("/tmp/foo", "/tmp/foobar/x.txt"), ("C:\\d", "C:\\d\\x")]
    assert values(spark, rows, "r string, p string", S.to_relative("r", "p")) == [("bar.txt",), ("sub/deep.txt",), (None,), ("x",)]


@pytest.mark.parametrize("name,out", [(".git", True), ("a.tmp", True), ("~x", True), ("#x", True), ("x~", True), ("IMG_1.png", True), ("ok.txt", False), ("_x.txt", False), ("scan 2.txt", True)])
def test_excluded(spark, name, out):
    assert values(spark, [(f"d/{name}",)], "p string", S.is_excluded("p", ["IMG_*", "scan [0-9].txt"])) == [(out,)]


def test_types(spark):
    rows = [("PDF",), ("png",), ("xyz",), (None,), ("rs",), ("mp3",), ("zip",), ("docx",)]
    assert values(spark, rows, "e string", S.classify_ext("e")) == [("pdf",), ("image",), ("unknown",), ("unknown",), ("text",), ("audio",), ("archive",), ("office",)]
    assert values(spark, [("odt",), ("zzz",)], "e string", S.file_type_name("e")) == [("OpenDocument Text",), ("ZZZ",)]


def test_misc(spark):
    assert values(spark, [("slide1.xml",), ("slide10.xml",), ("slide0.xml",), ("notaslide",)], "s string", S.slide_number("s")) == [(1,), (10,), (0,), (0,)]
    assert values(spark, [(5,), (2048,), (3 << 20,)], "n long", S.human_size("n")) == [("5 B",), ("2.0 KB",), ("3.0 MB",)]
    assert values(spark, [("deu", "fra"), ("eng", "fra"), ("", ""), (None, None)], "a string, b string", S.ocr_language("a", "b")) == [("deu",), ("fra",), ("eng",), ("eng",)]
    assert values(spark, [("x timeout",), ("Permission denied timeout",), ("",), (None,)], "m string", S.classify_error("m")) == [("timeout",), ("access_denied",), ("unknown",), ("unknown",)]


def test_repetition(spark):
    line = "This document is confidential and for internal use only\n"
    rows = [("short",), (line * 3,), ("".join(f"Line {i} of real content\n" for i in range(20)),), (None,), ("",)]
    assert values(spark, rows, "t string", Q.is_repetitive("t")) == [(False,), (True,), (False,), (False,), (False,)]


def test_garbled(spark):
    rows = [("",), (None,), ("fine\ttext\n",), ("���ab",), ("\x01\x02\x03\x04 abc",), (" " * 99 + "x",)]
    assert values(spark, rows, "t string", Q.is_garbled("t")) == [(False,), (False,), (False,), (True,), (True,), (True,)]


def test_page_stamp():
    a = Q.page_stamp("CONFIDENTIAL copy for Jane 2024-01-02 10:11:12 http://x.y/z?1 Page 3 12.")
    b = Q.page_stamp("CONFIDENTIAL copy for Jane 2025-03-04 23:59:00 http://q.r/s Page 44 7.")
    assert a == b == "CONFIDENTIALcopyforJanePage" and Q.page_stamp(None) == ""


@pytest.mark.parametrize("raw,text", [
    (bytes([0, 1, 2, 3, 255]), ""), (b"\xff\xfe" + "Hello".encode("utf-16-le"), "Hello"), (b"\xfe\xff" + "Hi".encode("utf-16-be"), "Hi"),
    (b"\xef\xbb\xbfHello with BOM", "Hello with BOM"), (b"", ""), (None, ""), ("搜索引擎".encode("gbk"), "搜索引擎"), (b"Hello\xff", "Hello�"),
])
def test_decoding(raw, text):
    assert Q.decode_bytes(raw) == text


def test_vectors(spark):
    rows = [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 2.0]), ([], []), (None, [1.0]), ([0.0], [1.0])]
    got = [round(r[0], 9) for r in values(spark, rows, "a array<double>, b array<double>", V.cosine("a", "b"))]
    assert got == [1, 0, 0, 0, 0, 0]
    assert values(spark, [([3.0, 4.0],)], "a array<double>", V.normalized("a")) == [([0.6, 0.8],)]
    back = values(spark, [([0.5, -1.0, 2.0],)], "a array<float>", V.from_blob(V.to_blob("a")))
    assert back == [([0.5, -1.0, 2.0],)]


def test_hash_of_large_content(spark):
    import hashlib

    raw = bytes(range(256)) * 40
    got = values(spark, [(raw,)], "b binary", S.content_hash("b"), S.content_hash("b", part=100, limit=1000))
    assert got == [(hashlib.md5(raw).hexdigest(), hashlib.md5(raw[:100] + raw[-100:]).hexdigest())]
