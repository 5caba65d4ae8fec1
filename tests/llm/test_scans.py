import random

import pytest

from docquarry.llm import scans as S

WORDS = "the of a in maintenance contract customer survey museum catalogue described network diagram folder remains open design brief project shortened old archive scanned ledger omitted reading list warranty card keep office backup schedule page volume".split()
REPAIRER = S.Repairer(S.Lexicon({w: 1000 for w in WORDS}, {("scanned", "ledger"): 50, ("old", "archive"): 50}))


@pytest.mark.parametrize("read,word", [("lcdger", "ledger"), ("sumrnary", None), ("rnuseum", "museum"), ("d0cument", None), ("contraof", None), ("ar(hive", "archive"), ("offlce", "office"), ("customcr", "customer"), ("warrantv", "warranty"), ("ledger", None), ("Tormarin", None), ("AB1234", None), ("xiv", None), ("siirvey", "survey"), ("ofﬁce", "office"), ("123", None), ("", None), ("ledgxr", "ledger"), ("ledgr", "ledger"), ("modem", None)])
def test_repair(read, word):
    assert REPAIRER.repair(read) == word


def test_context_breaks_ties():
    r = S.Repairer(S.Lexicon({"ledger": 10, "lodger": 10, "scanned": 10, "old": 10}, {("scanned", "ledger"): 90, ("old", "lodger"): 90}))
    assert r.repair("l0dger", "old") == "lodger" and S.distance("ledger", "lcdger") == pytest.approx(0.3)


PAGE = """Museum catalogue Calwick     11

The maintenance contract described the network diagram in the old ar-
chive folder. The customer survey shortened the design brief of the
project and the scanned lcdger remains open in the museum catalogue of
12
Muscum catalogue Calwick
the office. The reading list omitted the warranty card on page nine of
Design brief Garnik
The backup schedule of the office described the network diagram in the
folder of the museum. The old archive omitted the customer survey of -

5449,12
2473,30
Page 13 of 20
the project."""


def test_page():
    found, paragraphs, _ = S.repaired_page(PAGE, REPAIRER)
    kinds = {}
    for i, k in found:
        kinds.setdefault(i + 1, []).append(k)
    assert kinds == {1: ["header"], 3: ["hyphen"], 5: ["chars"], 6: ["page_no"], 7: ["header"], 15: ["page_no"]}
    text = "\n\n".join(paragraphs)
    assert "old archive folder" in text and "scanned ledger remains" in text and "catalogue of the office" in text and "Calwick" not in text and "Page 13" not in text


@pytest.mark.parametrize("line,yes", [("12", True), ("xiv", True), ("- 7 -", True), ("[16]", True), ("25/27", True), ("Page 3 of 6", True), ("Page l5", True), ("p. 5", True), ("Seite 4 von 9", True), ("Página 9 de 9", True), ("5449,12", False), ("Design brief", False), ("pages", False), ("page 999.", False), ("2. Design brief", False), ("l", False)])
def test_page_numbers(line, yes):
    assert S._page(line) is yes


def test_held_out_accuracy():
    rng = random.Random(9)
    right = wrong = 0
    for _ in range(400):
        word = rng.choice([w for w in WORDS if len(w) > 5])
        a, b = rng.choice([c for c in S.CONFUSIONS if c[0] in word] or [("", "")])
        if not a:
            continue
        read = word.replace(a, b, 1)
        got = REPAIRER.repair(read)
        right += got == word
        wrong += got != word and read not in WORDS
    assert right / (right + wrong) > 0.97


def test_frame(spark):
    clean = "The maintenance contract described the network diagram in the old archive folder. The customer survey shortened the design brief of the project and the scanned ledger remains open. Keep the office backup schedule, museum catalogue, reading list, warranty card, page, volume; a list omitted."
    rows = [(f"c{i}", clean, 0, "x") for i in range(40)] + [("scan", PAGE, 1, "x"), ("null", None, 0, "x"), ("empty", "", None, "x"), ("scan", PAGE, 1, "x")]
    df = spark.createDataFrame(rows, "id string, t string, ocr int, kind string")
    got = {(r["id"], r["line_no"], r["kind"]) for r in S.damage(df, "id", "t", "ocr").collect()}
    assert got == {("scan", i, k) for i, k in ((1, "header"), (3, "hyphen"), (5, "chars"), (6, "page_no"), (7, "header"), (15, "page_no"))}
    assert S.paragraphs(df, "id", "t", "ocr").select("id").distinct().count() == 1
    assert S.damage(df.limit(0), "id", "t", "ocr").count() == 0


def test_confusions_keep_the_skeleton(spark):
    rows = [(x + a + y, x + b + y) for a, b in S.CONFUSIONS for x in ("", "n", "s") for y in ("", "i", "s")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(S.skeleton(df.a) != S.skeleton(df.b)).count() == 0


SCAN = "The maintenance contract described the network\ndiagram in the old archive folder and the {}\nremains open in the museum catalogue of\nthe office."


def texts(words, n, rest=400):
    """`n` clean texts with the words among many others of another language."""
    return [(f"a{i}", f"Plain text number without any of them. {words}", 0) for i in range(n)] + [(f"b{i}", "Eine lange Liste der anderen Sprache.", 0) for i in range(rest)]


def repaired(spark, rows):
    df = spark.createDataFrame(rows, "id string, t string, ocr int")
    return {r["id"]: r["repaired"] for r in S.paragraphs(df, "id", "t", "ocr").collect()}, {(r["id"], r["line_no"]) for r in S.damage(df, "id", "t", "ocr").collect() if r["kind"] == "chars"}


def test_words_of_a_small_language_are_repaired_and_kept(spark):
    rows = texts("The surprisingly long ledger.", 6, 1500) + [("rare1", "A lodger came. He said surprisingly.", 0), ("rare2", "The lodger left.", 0)]
    text, chars = repaired(spark, [*rows, ("bad", SCAN.format("surprisinglv"), 1), ("good", SCAN.format("lodger"), 1)])
    assert "the surprisingly remains" in text["bad"] and "the lodger remains" in text["good"] and chars == {("bad", 2)}


def test_a_pair_met_once_decides(spark):
    rows = texts("The ledger. The ledger and the lodger.", 20, 3000) + texts("The ledger.", 30, 0)
    rows += [("seen", SCAN.format("friendly lodger"), 1)]
    text, chars = repaired(spark, [*rows, ("bad", SCAN.format("friendly lcdger"), 1)])
    assert "friendly lodger remains" in text["bad"] and chars == {("bad", 2)}


def test_pairs_of_clean_texts_decide(spark):
    """Pairs are counted in all texts, clean ones and null included, and the end of a text is no neighbour."""
    rows = texts("The ledger. The ledger and the lodger.", 20, 3000) + texts("The ledger.", 30, 0)
    rows += [("seen", "A friendly lodger came. He stayed.", 0), ("null", None, 0), ("end", SCAN.format("other") + " A ledger", 1)]
    text, chars = repaired(spark, [*rows, ("bad", SCAN.format("friendly lcdger"), 1)])
    assert "friendly lodger remains" in text["bad"] and chars == {("bad", 2)}


CAPITALS = "ANNUAL REPORT  1\n\nTHE MAINTENANCE CONTRACT DESCRIBED THE NETWORK\nDIAGRAM.\n\nANNUAL REPORT  2\n\nTHE OFFICE REMAINS OPEN.\n\n- 7 -\n"
CHINESE = "第一章的内容在这里写着。\n\n- 12 -\n\n第二章的内容也在这里。\n\n- 13 -\n"
NARROW = "The mainte-\nnance contract\nis open.\n\n[16]\n"


def test_other_evidence_of_scans(spark):
    rows = [("capitals", CAPITALS, 1), ("chinese", CHINESE, 1), ("narrow", NARROW, 1), ("unmarked", CAPITALS, 0), ("arrow", PAGE.replace("The reading list", ">> see a --> b\nThe reading list"), 1), ("plain", "An ordinary text. It has no damage.", 1), ("cues", "00:01 --> 00:02\nthe words that\ngo on\n\n00:03 --> 00:04\nother words\n\n12\n", 1)]
    df = spark.createDataFrame(rows, "id string, t string, ocr int")
    got = {(r["id"], r["line_no"], r["kind"]) for r in S.damage(df, "id", "t", "ocr").collect()}
    want = {(k, i, "header") for k in ("capitals", "unmarked") for i in (1, 6)} | {(k, 10, "page_no") for k in ("capitals", "unmarked")}
    want |= {("chinese", 3, "page_no"), ("chinese", 7, "page_no"), ("narrow", 1, "hyphen"), ("narrow", 5, "page_no")}
    assert {x for x in got if x[0] != "arrow"} == want and ("arrow", 6, "page_no") in got
    assert {r["id"] for r in S.paragraphs(df, "id", "t", "ocr").collect()} == {"capitals", "chinese", "narrow", "unmarked", "arrow"}


def test_unit_edits_only_where_letters_are_in_no_usual_order(spark):
    """A dropped or strange letter is repaired; rare words that look like words stay, beside frequent ones too."""
    rows = texts("The modern ledger and the leader of the garden, do and co; budget, markets, tickets, edge, modest, rodeo, hotel, lodge.", 40, 400) + [("m1", "A modem. The co came.", 0), ("m2", "The modem and do.", 0), ("l1", "The leger.", 0), ("l2", "A leger.", 0)]
    scans = {"drop": "ledgr", "strange": "ledgxr", "modem": "modem", "leger": "leger", "do": "do", "co": "co", "plural": "budgets"}
    text, chars = repaired(spark, rows + [(k, SCAN.format(w), 1) for k, w in scans.items()])
    want = scans | {"drop": "ledger", "strange": "ledger"}
    assert all(f"the {w} remains" in text[k] for k, w in want.items()) and chars == {("drop", 2), ("strange", 2)}


def test_repairs_stay_at_their_place(spark):
    """One reading stands for two words in one text, and a word broken at a line end is mended whole."""
    rows = texts("The ledger and the lodger of the museum.", 30)
    page = "The maintenance contract described the network of the friendly lcdger\nin the folder and of the scanned lcdger which\nremains open in the mus-\ncum of the office in the other town.\n"
    rows += [(f"p{i}", "The friendly lodger in the town. The scanned ledger which was\nfound in the office.", 1) for i in range(3)]
    text, chars = repaired(spark, [*rows, ("bad", page, 1)])
    assert "friendly lodger in" in text["bad"] and "scanned ledger which" in text["bad"] and "the museum of the office" in text["bad"]
    assert chars == {("bad", 1), ("bad", 2), ("bad", 4)}
