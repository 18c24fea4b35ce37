import pytest

from convolake.llm.sentences import sentence_units

# | marks where units begin
CASES = [
    "|It ran. |It stopped! |Why? |No.",
    "|We need approx. 71.40 MB, max. 105 MB. |At 3.22 s, e.g. in main.go, it fails. |load_rows returned early.",
    "|The build ran on the U.S. mirror. |Mr. Cron woke up at 5 a.m. on Sundays.",
    '|"Not again!" was the first line. |The note says: "Stop it. Then go." |The floor is 1.2.',
    "|The cause was (again!) a lock. |(The path is old.) |Note: see p. 5.",
    "|The cause was (again!) E0382 in the scan. |Done (but not in a.go!)… |Then more.",
    "|„Läuft es wieder?“, fragte die Prüferin. |Das betrifft z. B. Version 2.1 und Nr. 9. |Am 24. März wurde es gelöscht, d. h. der Rest.",
    "|Protokolle usw. bleiben. |Gelöscht wurden Abbilder usw. |Merke: nein.",
    "|« Est-ce fini ? » demande le journal. |Ça passe ! |M. Robot s'est réveillé à 758 h. |Non !",
    "|«¡Ojo!» decía la nota. |¿Por qué? |Los registros, trazas, etc. se guardan.",
    "|«Всё готово?» — спросил второй. |Журналы и т. д. хранятся. |Это, т. е. п. 313 списка.",
    "|Μήπως ο δείκτης χάνει γραμμές; |Το σχόλιο έλεγε «Μην το αγγίξετε. Δουλεύει.» και άλλο.",
    '|टिप्पणी में लिखा था "इसे मत छुओ। यह चल रहा है।" और कुछ नहीं। |डॉ. क्रॉन जागा।',
    "|من غيّر main.rs؟ |نعم. |لا!",
    '|"끝났나요?"라고 물었습니다. |네.',
    "|等一下……第3次运行。|“这样行吗？”第二位评审问道。|评审只写了“别动。它能跑。”这一句。|真的吗？！",
    "|备注里写着「先停索引器。再清空队列。」|版本3.1修好了。",
    "|「もう一度？」とレビュー担当が尋ねました。|はい。|本当に！？",
    "|ยังไม่เสร็จ |ใครแก้ไฟล์ main.rs เมื่อคืน |งานต่าง ๆ ในคิวหยุด",
    "|该死\n|好的",
    "|占比升到6.9%\n|“这样行吗？”第二位评审问道\n|v1.2修好了main.go\n|x.rs里只剩",
    "|A line\nthat goes on. |Then\nthe next.",
    "|One thing\n\n|another thing",
    "|# 1.4 Limits. And more\n\n|Text here. |More.",
    "|- [ ] One. Two.\n|- Three\n\n|1. Four. Five!\n|2. Six",
    "|```py\nx = 1. \n\ny = 2! Z\n```\n|After it. |Yes.",
    "|```\nnever closed. X",
    "|It works before.|Each row is kept. |Fine. |See variable x. |Then stop, d. h. Version 2 u. a. Teile.",
    "|Wait... the second run. |Not yet… |See above.",
    "| 　 x.  |Y.\r\n\r\n|Z",
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, c.replace("|", ""), "c") for i, c in enumerate(CASES)]
    out: dict = {}
    for r in sentence_units(spark.createDataFrame(rows, "doc_id bigint, text string, unit string"), "doc_id", "text").collect():
        out.setdefault(r.doc_id, []).append((r.start_pos, r.unit))
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_units(found, i):
    parts = CASES[i].split("|")[1:]
    text, at, expected = CASES[i].replace("|", ""), 0, []
    for part in parts:
        lead = len(part) - len(part.lstrip())
        expected.append((at + lead + 1, part.strip()))
        at += len(part)
    assert sorted(found[i]) == expected
    assert all(text[s - 1 :].startswith(u) for s, u in found[i])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t　 "), (4, "a. B."), (5, "Word. " * 20_000), (6, "Twice. Yes."), (6, "Twice. Yes."), (None, "X. Y."), (7, '"' * 50 + "(((" + "。。。"), (8, "x" * 100_000)]
    got: dict = {}
    for r in sentence_units(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect():
        got.setdefault(r.doc_id, []).append(r.start_pos)
    assert set(got) == {4, 5, 6, 7, 8, None}
    assert sorted(got[4]) == [1, 6] and len(got[5]) == 20_000 and sorted(got[6]) == [1, 1, 8, 8]
    assert sentence_units(spark.createDataFrame(rows, "doc_id bigint, text string").limit(0), "doc_id", "text").count() == 0


def test_no_length_changes_what_a_mark_means(spark):
    """Quotations, brackets, lists, runs of marks and lines of any length: units as if they were short, and no stack overflows."""
    inner = "It ran. It stopped! "
    texts = {}
    for i, n in enumerate((1, 40, 600)):  # 20 to 12,000 characters
        for j, (a, b) in enumerate((('"', '"'), ("„", "“"), ("«", "»"), ("‘", "’"), ("“", "”"), (" (", ")"))):
            texts[10 * i + j] = f"The note says {a}{(inner * n).strip()}{b} and goes on. Then more."
    texts[100] = "Ο δείκτης " + "χάνει " * 500 + "γραμμές; Ναι."
    texts[101] = "“这样行吗？”" + "第二位评审" * 40 + "问道。真的吗？"
    texts[102] = "漢 " + "x" * 500 + "\n" + "y" * 500 + " 漢"
    texts[103] = " " * 30 + "- one. Two.\n" + " " * 30 + "- three\n\n" + " " * 40 + "\n" + " " * 40 + "1234567. four. Five"
    texts[104] = "\n".join(f"- item {n}" for n in range(20_000))
    texts[105] = "." * 50_000 + " X. Y"
    texts[106] = "It" + " or-on" * 3 + "-on" * 50_000 + ". Then."
    got: dict = {}
    for r in sentence_units(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), "doc_id", "text").collect():
        got.setdefault(r.doc_id, []).append(r.start_pos)
    for i in (0, 1, 2):
        assert [sorted(got[10 * i + j]) for j in range(6)] == [[1, texts[10 * i + j].index("Then") + 1] for j in range(6)]
    assert [len(got[i]) for i in (100, 101, 102, 103, 104, 106)] == [2, 2, 2, 3, 20_000, 2]
