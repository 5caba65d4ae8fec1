import pytest

from docquarry.llm import personal as P

EVERY = frozenset(P._MAYBE)
CASES = [
    ("Ring me on 020 7946 0084 or write to ulmm46@mail.wesdell.example", {("phone", "020 7946 0084"), ("email", "ulmm46@mail.wesdell.example")}),
    ("Contact: Odile van Haldodell / (663) 555-0180 / odile.h (at) nevford (dot) example (dot) net", {("name", "Odile van Haldodell"), ("phone", "(663) 555-0180"), ("email", "odile.h (at) nevford (dot) example (dot) net")}),
    ("The tenant lives at Flat 9, 55 Quill Street, Nevnitis ZZ3 1QX and pays on time.", {("address", "Flat 9, 55 Quill Street, Nevnitis ZZ3 1QX")}),
    ("Neue Anschrift: Gerberstraße 96,\n00658 Kelrin\n\nMit freundlichen", {("address", "Gerberstraße 96, 00658 Kelrin")}),
    ("Mme Viktor Tortis habite 119 bis, rue des Aulnes,\n00159 Drevant.", {("name", "Viktor Tortis"), ("address", "119 bis, rue des Aulnes, 00159 Drevant")}),
    ("La señora Henrik Velniford vive en Calle del Aliso 36, 2.º B, 00231 Brashanik.", {("name", "Henrik Velniford"), ("address", "Calle del Aliso 36, 2.º B, 00231 Brashanik")}),
    ("原件寄往灯城市灯笼街175号3单元。", {("address", "灯城市灯笼街175号3单元")}),
    ("请在中午前拨打(010) 0000 2807或写信至ulmlotis73@margost.example.net 。", {("phone", "(010) 0000 2807"), ("email", "ulmlotis73@margost.example.net")}),
    ("Nevnik, Anna (passport no.: X00960423) signed the handover.", {("name", "Nevnik, Anna"), ("id_number", "X00960423")}),
    ("登记的身份证号 00000019860613929X。", {("id_number", "00000019860613929X")}),
    ("SSN 000-80-7648; Nevmumer, Salma", {("id_number", "000-80-7648"), ("name", "Nevmumer, Salma")}),
    ("Consta en el archivo: NIE X-0006135-W.", {("id_number", "X-0006135-W")}),
    ("Notably, Odile-Teo Nevdell checked the annex.", {("name", "Odile-Teo Nevdell")}),
    ("Henrik H. Nevvant and OSKAR MARNIVANT were both absent.", {("name", "Henrik H. Nevvant"), ("name", "OSKAR MARNIVANT")}),
    ("Rappeler le +33 (0)1-99-00-86-67 avant midi.", {("phone", "+33 (0)1-99-00-86-67")}),
    ("Lives at Via Roma 12, 00184 Roma.", {("address", "Via Roma 12, 00184 Roma")}),
]
TRAPS = ["See icon@2x.png and logo@3x.png in the folder.", "Handle @shelfbot posted the list.", "user@localhost ran the job.", "Anna is the name of the old server.", "Quill Street was closed all week.", "Ticket 555-0110-AB was merged.", "Order no. 4500-118-2231 was closed.", "Serial 8812 4471 0093 2210 is on the label.", "ISBN 000-0-00-123456-0 is on the cover.", "Rechnung 2024-0311-77 vom 12.03.2024.", "The Bramble Court opened at 9.", "Invoice 2025-03-0417, total 1 632,96.", "2025-02-11 08:14:02 INFO [watch] scan", "Checksum 0049a1f3 and offset 000-00."]


def rows():
    return [(i, t, "x") for i, (t, _) in enumerate(CASES * 8)] + [(1000 + i, t, "x") for i, t in enumerate(TRAPS * 8)] + [(5000, None, "x"), (5001, "", "x"), (5002, "word " * 20_000 + "Anna Berg", "x")]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(rows(), "id long, t string, kind string")
    out = {}
    for r in P.found(df, "id", "t").collect():
        out.setdefault(r["id"], set()).add((r["kind"], r["val"]))
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(found, i):
    assert found.get(i, set()) == CASES[i][1]


@pytest.mark.parametrize("i", range(len(TRAPS)))
def test_traps(found, i):
    assert 1000 + i not in found


#: Names that the gazetteer lacks, in places that tell, and capitalised words in other places.
BEYOND = {
    "Please ask Siobhan Murphy about the key.": {"Siobhan Murphy"}, "Contact: Kwame Mensah, +1 509 555 0125": {"Kwame Mensah"}, "Dr Giulia Rossi signed it.": {"Giulia Rossi"},
    "Regards,\nRajesh Kumar\nrajesh.kumar@mail.test": {"Rajesh Kumar"}, "The letter was signed Okonkwo, Adaeze in May.": {"Okonkwo, Adaeze"}, "联系人：王小明，周一。": {"王小明"}, "请找李娜女士。": {"李娜"},
    "Annual Report\n\nThe Quarterly Budget was open.": set(), "The Bramble Court in New Harbour opened. Am Ende, der Museum Kalender.": set(), "See the North Wing plan and the Upper Hall list.": set(), "这个王国的经理很多。": set(),
}


def test_names_beyond_the_gazetteer(spark):
    known = [f"{a} {n} Velmora." for n in ("Anna", "Klaus", "Lena", "Omar", "Nora") for a in ("Please ask", "Dr", "Mrs", "Contact:", "Regards,\n")]
    plain = [f"The {a} {b} was read, and the {b} {a} too." for a in ("Garden", "Museum", "Harbour", "Budget") for b in ("Plan", "Report", "Calendar", "Survey")]
    texts = [*known, *plain, *BEYOND] * 3
    got = {}
    for r in P.found(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").collect():
        if r["kind"] == "name":
            got.setdefault(texts[r["id"]], set()).add(r["val"])
    assert {t: got.get(t, set()) for t in BEYOND} == BEYOND and not any(t in got for t in plain) and all(t in got for t in known)


def test_given_names_are_learned_from_the_table(spark):
    """A given name seen with three family names in telling places holds in a place that tells nothing."""
    texts = [f"Dr Siobhan {x} came." for x in ("Murphy", "Kelly", "Byrne", "Doyle")] * 3 + ["Later Siobhan Walsh went home."] + ["Later Cedar Walk was closed."] + [f"Dr Anna {x} came." for x in ("Berg", "Tal")] * 3
    texts += [f"Now the {a} {b} was closed." for a in ("Garden", "Museum", "Harbour", "Budget") for b in ("Plan", "Report", "Calendar", "Survey")] * 3
    got = {r["val"] for r in P.found(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").collect()}
    assert "Siobhan Walsh" in got and "Cedar Walk" not in got


def test_anchored_em_learns_what_surrounds_names():
    known = {0b10100010: 80, 0b10100001: 80, 0b10100000: 40}
    chance = P.classifier({0b10100010: 5, 0b10100001: 5, 0b10100000: 4000, 0b10000000: 4000}, rates=P.anchored(known, {0b10100010: 5, 0b10100001: 5, 0b10100000: 4000, 0b10000000: 4000}))
    assert chance[0b10100010] > 0.7 and chance[0b10100001] > 0.7 and chance[0b10100000] < 0.1 and chance[0b10000000] < 0.1


def test_long_and_empty(found):
    assert found[5002] == {("name", "Anna Berg")} and not {5000, 5001} & set(found)


def test_masked(spark):
    df = spark.createDataFrame(rows(), "id long, t string, kind string")
    got = {r["id"]: r["masked"] for r in P.masked(df, "id", "t").collect()}
    assert got[0] == "Ring me on [PHONE] or write to [EMAIL]" and got[8] == "[NAME] (passport no.: [ID_NUMBER]) signed the handover."
    assert got[1000] == TRAPS[0] and got[5000] is None and got[5001] == "" and len(got) == len(rows())
    assert P.found(df.limit(0), "id", "t").count() == 0


def test_em_separates_labelers():
    counts = {0b11111: 500, 0b11101: 60, 0b11011: 50, 0b00011: 200, 0b00001: 300, 0b10000: 40}
    share, yes, no = P.expectation(counts)
    assert yes[4] > 0.8 and no[2] < 0.3
    p = P.classifier(counts)
    assert p[0b11111] > 0.9 and p[0b11101] > 0.5 and p[0b00001] < 0.3 and len(p) == 32


@pytest.mark.parametrize("text,kind,val", [("Er wohnt Unter den Linden 77, 10117 Berlin.", "address", "Unter den Linden 77, 10117 Berlin"), ("Adresse: Alter Markt 5, 50667 Köln", "address", "Alter Markt 5, 50667 Köln"), ("SSN 123\xa045\n6789 was given.", "id_number", "123 45 6789"), ("Please call 212\xa0555\xa00123 today.", "phone", "212 555 0123"), ("Please call (212) 555\n0123 today.", "phone", "(212) 555 0123")])
def test_filters_are_no_narrower_than_the_labelers(spark, text, kind, val):
    df = spark.createDataFrame([("a", text)], "id string, t string")
    assert (kind, val) in {(r["kind"], r["val"]) for r in P.candidates(df, "id", "t").collect()}


def test_a_phone_number_ends_before_the_next_line():
    assert [x for x in P.spans("Tel. 030 1234567\n1234 Stück", frozenset(["phone"])) if x.end > 16] == []


def test_a_number_above_is_no_part_of_a_phone_number():
    text = "52 Lantern Way, Torramer, ZZ 42802\n020 7946 0227"
    assert [text[x.start : x.end] for x in P.spans(text, frozenset(["phone"]))] == ["020 7946 0227"]


def test_report_counts_what_is_rejected(spark, found):
    df = spark.createDataFrame(rows(), "id long, t string, kind string")
    got = {r["kind"]: (r["candidates"], r["kept"]) for r in P.report(df, "id", "t").collect()}
    assert set(got) <= set(P.KINDS) and all(0 <= kept <= n for n, kept in got.values()) and got["name"][0] > got["name"][1] > 0
