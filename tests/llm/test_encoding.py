import pytest

from docquarry.llm import encoding as E

CLEAN = [
    "Das Büro verzögerte die Prüfliste für den Förderantrag im Anhang", "La réunion précisait le résumé à l’année dernière", "El número de páginas describió la garantía según el índice",
    "发票批次在附录里说明了项目报告第52页。网络图缩短了培训手册，共7条记录。维修单核实了索引快照第9页。", "Der Museumskatalog überging die Änderungshistorie später",
]
TRAPS = ["São Veldo und Łódka", "√2 ≈ 1,41 ±3 °C ½ page", "отчёт и папка", "├── docs └── scans", "NÃO ABRIR português avançado", "Ångström naïve «dossier»", "plain ascii only", "", "The sign � (U+FFFD) stands for a lost letter."]


def garble(text, true, wrong):
    return text.encode(true).decode({"web": "cp1252"}.get(wrong, wrong))


@pytest.mark.parametrize("h", range(len(E.HYPOTHESES)))
def test_undo_is_the_inverse(h):
    true, wrong = E.HYPOTHESES[h]
    done = 0
    for text in CLEAN:
        try:
            bad = text
            for _ in true.split("+"):
                bad = garble(bad, "utf-8" if "+" in true else true, wrong)
        except UnicodeError:
            continue
        if bad != text:
            assert E.undo(bad, h) == text
            done += 1
    assert done or true in ("cp1251", "big5") or wrong in ("gbk", "big5", "cp1253", "koi8_r", "cp1251", "mac_roman", "cp850", "cp437", "web", "cp1250")


def test_alignment():
    assert E.aligned("prÃ¼fte", "prüfte") == [("Ã¼", "ü")] and E.aligned("prÃ¼fe", "prüfte") is None
    assert E.explains([("Ã¼", "ü"), ("â€™", "’")], E.HYPOTHESES.index(("utf-8", "web"))) and not E.explains([], 0)


def test_found_and_restored(spark):
    rows, bad = [], {}
    for i in range(30):
        for j, t in enumerate(CLEAN):
            rows.append((f"c{i}-{j}", t))
    for n, (true, wrong) in enumerate([("utf-8", "web"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("utf-8", "mac_roman")]):
        for j in (0, 1, 2, 4):
            try:
                bad[f"b{n}-{j}"] = (garble(CLEAN[j], true, wrong), CLEAN[j])
            except UnicodeError:
                pass
    bad["zh"] = ("Intro. " + garble(CLEAN[3], "gbk", "web"), "Intro. " + CLEAN[3])
    bad["part"] = (CLEAN[1] + "\n" + garble(CLEAN[0], "utf-8", "web"), CLEAN[1] + "\n" + CLEAN[0])
    lost = {"lost": "Der F�rderantrag"}
    rows += [(k, v[0]) for k, v in bad.items()] + list(lost.items()) + [(f"t{i}", t) for i, t in enumerate(TRAPS)] + [("null", None), ("part", bad["part"][0])]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "id string, t string, unit string")
    found = {r["id"] for r in E.garbled(df, "id", "t").where("strong").select("id").distinct().collect()}
    assert found == set(bad) | set(lost)
    fixed = {r["id"]: r["restored"] for r in E.restored(df, "id", "t").collect()}
    assert fixed["lost"] is None
    assert {k: fixed[k] for k in bad} == {k: v[1] for k, v in bad.items()}


def test_empty_and_clean_tables(spark):
    df = spark.createDataFrame([("a", "für"), ("b", None)], "id string, t string")
    assert E.garbled(df, "id", "t").where("strong").count() == 0 and E.restored(df.limit(0), "id", "t").count() == 0


def test_mappings_that_no_hypothesis_knows(spark):
    """An unknown transformation (each ü and é read as two signs) is learned by aligning twins and applied to words met nowhere clean."""
    words = "für über Büro Prüfung Mühle Tür Hügel früh résumé café année réunion général légume médecin école".split()
    bad = str.maketrans({"ü": "¤¬", "é": "¤±"})
    rows = [(f"c{i}", f"{w} und {w}") for i in range(8) for w in words] + [(f"b{i}", w.translate(bad)) for i, w in enumerate(words[:-2])]
    rows += [("name", "Herr Krügerstädl".replace("ä", "a").translate(bad)), ("sign", "Das Zeichen ¤ steht da.")]
    df = spark.createDataFrame(rows, "id string, t string")
    fixed = {r["id"]: r["restored"] for r in E.restored(df, "id", "t").collect()}
    assert fixed == {**{f"b{i}": w for i, w in enumerate(words[:-2])}, "name": "Herr Krügerstadl"}


def test_twin_records_teach_a_transformation(spark):
    """Whole records that differ only in non-ASCII characters are aligned, though each of their words is met once."""
    text = "Der Bürgerverein prüfte die Förderanträge, und der Käufer schätzte die Gebühren für das Gehöft an der Brücke."
    rows = [("good", text), ("bad", garble(text, "utf-8", "web")), ("name", garble("Frau Tülänö und Herr Kröwüß", "utf-8", "web"))]
    df = spark.createDataFrame(rows, "id string, t string")
    fixed = {r["id"]: r["restored"] for r in E.restored(df, "id", "t").collect()}
    assert fixed["bad"] == text and "good" not in fixed
    assert E.record_twins(df.where("id <> 'bad'"), "t").count() == 0


def test_rare_words_follow_the_record(spark):
    rows = [(f"c{i}", "für über Büro Prüfung ö ä ß Größe Käse möglich") for i in range(9)]
    bad = garble("für über Büro Prüfung und Herr Pöllwärt", "cp1252", "mac_roman")
    fixed = {r["id"]: r["restored"] for r in E.restored(spark.createDataFrame([*rows, ("b", bad)], "id string, t string"), "id", "t").collect()}
    assert fixed == {"b": "für über Büro Prüfung und Herr Pöllwärt"}
