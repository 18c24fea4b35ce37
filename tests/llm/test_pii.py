import random

import pytest

from convolake.llm import pii

PEOPLE = ["Keiko Haldensohn", "Will Pellanetti", "Rose Marranetti", "Jürgen Karrquist", "Ilse O'Brimell", "Mark Pellquist", "Olu Brimquist", "Åsa van der Stellen", "Zoë Drax-Varga", "Tobin Karrensohn", "Ines Brimensohn"]
P = pii.People(PEOPLE)
CASES = [
    ("Mail keiko.h+ci@team.example now", "email", "keiko.h+ci@team.example"),
    ("to <KEIKO_9@MAIL.EXAMPLE>, then", "email", "KEIKO_9@MAIL.EXAMPLE"),
    ("mailto:a.b@c.example?subject=x", "email", "a.b@c.example"),
    ("mail zo76 (at) uni-x (dot) example (again)", "email", "zo76 (at) uni-x (dot) example"),
    ("x.y at inbox dot invalid and", "email", "x.y at inbox dot invalid"),
    ("cc tobin[at]uni-x.example,", "email", "tobin[at]uni-x.example"),
    ("Call +44 20 7946 0345 now", "phone", "+44 20 7946 0345"),
    ("tel:0044 20 7946 0345.", "phone", "0044 20 7946 0345"),
    ("fax +1 (303) 555-0199!", "phone", "+1 (303) 555-0199"),
    ("or on +15125550161.", "phone", "+15125550161"),
    ("dial 617.555.0152,", "phone", "617.555.0152"),
    ("tel. 030/23125833", "phone", "030/23125833"),
    ("+33 1 99 00 88 15 ?", "phone", "+33 1 99 00 88 15"),
    ("Call 01 99 00 45 95 if", "phone", "01 99 00 45 95"),
    ("SSN: 842-34-3219.", "national_id", "842-34-3219"),
    ("DNI 63464724-L was", "national_id", "63464724-L"),
    ("has X9620167A in", "national_id", "X9620167A"),
    ("id QQ 19 91 33 C (again)", "national_id", "QQ 19 91 33 C"),
    ("is 185049918238142.", "national_id", "185049918238142"),
    ("personnummer 19560518-1384 stod", "national_id", "19560518-1384"),
    ("lives at 1452 Gristmill Road, Eastbrim", "address", "1452 Gristmill Road"),
    ("is Flat 22, 20 Old Mill Rise\nX", "address", "Flat 22, 20 Old Mill Rise"),
    ("unter Lindenkamp 127, 20929 Nordhaven.", "address", "Lindenkamp 127, 20929 Nordhaven"),
    ("to Alte Gerberstraße 9.", "address", "Alte Gerberstraße 9"),
    ("à 3 bis, avenue du Vieux Phare, 69999", "address", "3 bis, avenue du Vieux Phare"),
    ("en C/ Tejedor 66, 4.º C", "address", "C/ Tejedor 66"),
    ("〒999-1970 霧浜県灯町7-9-8。", "address", "〒999-1970 霧浜県灯町7-9-8"),
    ("ask Keiko Haldensohn, then", "person_name", "Keiko Haldensohn"),
    ("HALDENSOHN, KEIKO wrote", "person_name", "HALDENSOHN, KEIKO"),
    ("by rose h. brimensohn's branch", "person_name", "rose h. brimensohn"),
    ("met with Ilse O'Brimell + bot", "person_name", "Ilse O'Brimell"),
    ("and Åsa van der Stellen's branch", "person_name", "Åsa van der Stellen"),
    ("thanks, Bettina Karrensohn", "person_name", "Bettina Karrensohn"),
    ("Спросите Ратмир Солнцеградов, почта", "person_name", "Ратмир Солнцеградов"),
    ("user.name=霧浜 蓮太 user", "person_name", "霧浜 蓮太"),
]
NONE = [
    "origin is git@forge.example:core/x.git", "ssh runner@192.0.2.129 hangs, postgres://app@db.invalid:9401/main", "icon@2x.png and serde@1.0.47", "@app.route handles /users/466 and the @scope/links package",
    "masked as [EMAIL] and <phone>", "Will Cargo rebuild it? Mark the thread and let Error Budget decide", "Rose Pine is the default theme, Grace Period the default setting", "build 2025-10-7515 passed, ticket 212-6159 is open",
    "It took 904 77 783 cycles at port 3777", "401.703.54 is a build, 31-20-1137 a batch", "offset 1736497909092 was written twice", "epoch 1736239600, size 8692 4826, span 287-166", "19 Main Branch commits took 2 hours",
    "lists 17 street tiles and 3 Avenue themes", "request b0960763-3172-4453-aeba-4d7d5b2b6c68", "7b58f62f-0133-4768-ae47-587ecfeefe95", "2025-01-12T21:42:34Z took 4479ms rows=74014", "等一下……第316次", "",
]


@pytest.mark.parametrize(("text", "kind", "mention"), CASES)
def test_mentions(text, kind, mention):
    assert [(text[a:b], k) for a, b, k in pii.find(text, P) if k == kind] == [(mention, kind)]


@pytest.mark.parametrize("text", NONE)
def test_no_mentions(text):
    assert pii.find(text, P) == []


def test_feistel_is_a_permutation():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(pii.feistel(i, size, b"k", "t") for i in range(size)) == list(range(size))
    assert [pii.feistel(i, 1000, b"k", "t") for i in range(9)] != [pii.feistel(i, 1000, b"l", "t") for i in range(9)]


def test_pseudonyms_keep_format_and_links():
    k = b"key"
    one, two = (pii.pseudonym("phone", s, k) for s in ("+1 (303) 555-0199", "303-555-0199"))
    assert [c for c in one if c.isdigit()][1:] == [c for c in two if c.isdigit()] and one[:4] == "+1 ("
    uk, home = (pii.pseudonym("phone", s, k) for s in ("0044 20 7946 0439", "020 7946 0439"))
    assert uk[5:].replace(" ", "") == home[1:].replace(" ", "")
    for s in ("63464724-L", "X9620167A", "185049918238142", "19560518-1384", "842-34-3219", "QQ 19 91 33 C"):
        fake = pii.pseudonym("national_id", s, k)
        assert pii.national_kind(fake) == pii.national_kind(s) and len(fake) == len(s) and fake == pii.pseudonym("national_id", s, k)
    assert pii.pseudonym("person_name", "Haldensohn, Keiko", k) == pii.pseudonym("person_name", "keiko  HALDENSOHN", k)
    assert pii.pseudonym("email", "x.y at inbox dot invalid", k) == pii.pseudonym("email", "X.Y@inbox.invalid", k)
    assert len(pii.pseudonym("email", "x@y.example", k)) == 32


def _numbers(kind, rng):
    day = f"{rng.randint(0, 99):02d}{rng.randint(1, 12):02d}{rng.randint(1, 28) + rng.choice((0, 60)):02d}"
    if kind == "ssn":
        return f"{rng.choice(pii._SSN_AREAS):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
    if kind == "nino":
        return f"{rng.choice([*pii._NINO_PAIRS, 'QQ'])}{rng.randint(0, 999999):06d}{rng.choice('ABCD')}"
    if kind == "dni":
        lead, n = rng.choice(["", "X", "Y", "Z"]), rng.randint(0, 9_999_999)
        return f"{lead}{n:0{7 if lead else 8}d}" + pii._DNI_LETTERS[int((str("XYZ".index(lead)) if lead else "") + f"{n:07d}") % 23]
    if kind == "nir":
        body = f"{rng.choice('12')}{rng.randint(0, 99):02d}{rng.choice([*range(1, 13), *range(20, 100)]):02d}{rng.choice(['75', '13', '2A', '2B'])}{rng.randint(0, 999999):06d}"
        return body + f"{97 - int(body.replace('2A', '19').replace('2B', '18')) % 97:02d}"
    return rng.choice(["", "18", "19", "20"]) + day + rng.choice("-+") + f"{rng.randint(0, 9999):04d}"


@pytest.mark.parametrize("kind", ["ssn", "nino", "dni", "nir", "personnummer"])
def test_numbers_are_permuted_within_their_kind(kind):
    """Other values in, other values out; each valid in its kind; and no date of birth stays."""
    rng = random.Random(kind)
    values = {v for v in (_numbers(kind, rng) for _ in range(4000)) if pii.national_kind(v) == kind}
    fakes = {v: pii.pseudonym("national_id", v, b"key") for v in values}
    if kind == "personnummer":
        key = lambda v: (pii._birth(pii._PERSONNUMMER.fullmatch(v)), int(v[-7:-5]) > 60, v[-4:])
        assert len({key(v) for v in values}) == len({key(f) for f in fakes.values()})
        assert sum(key(v)[0] == key(f)[0] for v, f in fakes.items()) < 5
        assert pii.pseudonym("national_id", "560518-1384", b"k") == pii.pseudonym("national_id", "19560518-1384", b"k")[2:]
        assert pii.pseudonym("national_id", "19210315-1234", b"k") != pii.pseudonym("national_id", "20210315-1234", b"k")
    else:
        assert len(values) == len(set(fakes.values())) > 3000
    assert all(pii.national_kind(f) == kind and len(f) == len(v) for v, f in fakes.items())
    if kind == "nir":
        assert sum(v[1:5] == f[1:5] for v, f in fakes.items()) < 40


@pytest.mark.parametrize("s", ["666-12-3456", "912-34-5678", "000-12-3456", "GB 12 34 56 C", "ZZ123456A", "DA123456A", "19990229-1234", "850229-1234", "850395-1234"])
def test_numbers_never_given(s):
    assert pii.national_kind(s) is None


#: Texts written by hand, not by any generator: names stand in double brackets.
PROSE = """[[John Smith]] met [[Priya Natarajan]] and [[Maria Garcia]] in Lisbon.
The talk by President [[Barack Obama]] starts at nine.
Minutes: [[Jane Doe]], [[Ahmed Hassan]] and Dr. [[Wilhelmina Krause]] were there.
Signed-off-by: [[Thorvald Amundsen]] <thorvald@kernel.example>
Reviewed-by: [[Chidi Okafor]] <c.okafor@kernel.example>
Regards,
[[Lucinda Abernathy]]
Name: [[Hiroshi Tanaka]]
The patch of [[Olga Smirnov]] went in before that of [[Lars Eriksson]].
Frau [[Hannelore Zimmer]] wohnt nicht mehr hier, Herr [[Klaus Weber]] schon.
[[Camille Dubois]] a relu le texte, puis [[Jean Moreau]] l'a publié.
[[Giulia Rossi]] ha scritto a [[Marco Bianchi]].
[[Carlos Hernandez]] y [[Lucía Fernandez]] llegaron tarde.
Письмо написал [[Сергей Иванов]], ответила [[Татьяна Петрова]].
Код проверил [[Мстислав Громов]].
Ask [[王小明]] or [[张伟国]] about it.
Contact: [[佐藤花子]] <hanako@mail.example>
連絡先は [[田村 由美]] です。
Красная Площадь, Новый Год и Российская Федерация не люди.
Совет Директоров собрался, Верховный Суд молчит.
状态: 设置完成, 内存不足, 连接失败.
The button reads "设置完成" and the log says 连接失败 twice.
New York and Los Angeles are cities, Mount Everest is a mountain.
Visual Studio, Apache Spark, Google Cloud and Linux Mint are products.
Will Power Query help? May Day is a holiday, Mark Down is no person.
General Electric and Johnson Controls sell machines to Deutsche Bahn.
Press Enter Key, then Click Apply Settings in Control Panel.
Merge Request and Pull Request mean the same thing here.
The University of Oxford and Harvard Business School answered.
Machine Learning, Data Engineering and Quality Assurance met on Monday Morning."""


def test_names_in_texts_of_no_generator():
    """Recall and precision of names with a list of people that holds none of them."""
    people, hits, wanted, found = pii.People(PEOPLE), 0, 0, 0
    for line in PROSE.replace("Regards,\n", "Regards,\r").split("\n"):
        line, names, at = line.replace("\r", "\n"), set(), 0
        while (a := line.find("[[", at)) >= 0:
            b = line.index("]]", a) - 2
            line, at = line[:a] + line[a + 2 : b + 2] + line[b + 4 :], b
            names.add((a, b))
        mine = {(a, b) for a, b, k in pii.find(line, people) if k == "person_name"}
        hits, wanted, found = hits + len(mine & names), wanted + len(names), found + len(mine)
    assert hits / wanted >= 0.9 and hits / found >= 0.9


def test_words_of_any_length_and_many_addresses_are_no_trouble():
    text = "x" * 300_000 + " Keiko " + "Y" * 300_000 + " a@b.example," * 20_000 + "z:" + "c@d.example:" * 20_000 + "1 2-" * 100_000
    assert sum(k == "email" for _, _, k in pii.find(text, P)) >= 20_000
    local = "l" * 500
    assert pii.find(f"to {local}@mail.example now", P) == [(3, 3 + 500 + 13, "email")]


def test_over_a_table(spark):
    people = spark.createDataFrame([(n, "t") for n in PEOPLE] + [(None, "t")], "full_name string, text string")
    text = "Ask Keiko Haldensohn <k.h@x.example> or +44 20 7946 0345."
    df = spark.createDataFrame([(1, text, "c"), (1, text, "c"), (2, None, "c"), (3, "", "c"), (4, "x " * 300_000 + text, "c"), (None, text, "c")], "id bigint, text string, pii_type string")
    rows = pii.find_mentions(df, "id", "text", people).distinct().collect()
    assert sorted((r.id or 0, r.pii_type) for r in rows) == sorted((i, k) for i in (0, 1, 4) for k in ("email", "person_name", "phone"))
    assert {r.start_pos for r in rows if r.id == 1 and r.pii_type == "person_name"} == {5}
    masked = {r.id: r.text for r in pii.mask_texts(df, "id", "text", people, "secret").distinct().collect()}
    assert masked[2] is None and masked[3] == "" and masked[1].startswith("Ask [PERSON_NAME:") and "@" not in masked[1] and masked[1].endswith("].")
    assert masked[4] == "x " * 300_000 + masked[1]
    assert pii.find_mentions(df.limit(0), "id", "text", people).count() == 0
    assert {r.pii_type for r in pii.find_mentions(df, "id", "text", people.limit(0)).collect()} == {"email", "phone", "person_name"}  # by its place before an address
