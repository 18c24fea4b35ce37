"""Sentence boundaries across languages and scripts, in SQL expressions only.

A text is cut into blocks (fenced code, heading lines, lists, and what stands between blank lines). In running text every mark
that ends nothing is masked by a private-use character of the same length: stops inside quotations and brackets, in
decimals, versions, paths and URLs, after initials, abbreviations and ordinals. Then terminators of each script
are matched with what may follow them, and the text is split there. As masks keep every length, positions need no repair,
and the units' text is taken from the text itself, which restores what was masked.

There is no shuffle and no Python; blocks and units are exploded, so that the expressions run on short strings.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT, MASK = "\ue000", "\ue001"
#: Marks beyond ASCII stand as characters of three ranges while patterns run, so that a class of them is a comparison or two.
_MARKS = {0xE010: "…।؟。！？｡", 0xE020: "«‹“「『（【《", 0xE030: "»›”」』）】》"}
MARKS_FROM = "".join(_MARKS.values())
MARKS_TO = "".join(chr(first + i) for first, marks in _MARKS.items() for i in range(len(marks)))
OPEN, CLOSE = "\ue028", "\ue038"
MARK = dict(zip(MARKS_FROM, MARKS_TO))

# ---------------------------------------------------------------- fixed values: abbreviations, months, marks
#: Never the end of a sentence.
ALWAYS = """Mr Mrs Ms Dr Prof St Sr Sra Srta Mme Mlle Hr Fr Mt Messrs vs cf incl excl esp approx viz Capt Gen Sen Rep Gov Jr
bzw vgl ca evtl ggf sog inkl exkl zzgl Dipl Ing Hrsg Abt Anm ebd aprox tel Uds Ud Vd D.ª av env éd chap
см напр ср тж им ул просп стр рис гл табл акад проф г-н π.χ κ.λπ δηλ βλ αρ σελ κεφ डॉ श्री e.g i.e z.B d.h u.a s.o s.u o.g p.ej p.ex т.е т.к т.н Mio Mrd Tsd млн млрд""".split()
#: Not before a number.
BEFORE_NUMBER = """no nos nr num núm p pp pg pág págs s sec secs sect fig figs rev ver vers v vol vols ch chs kap abschn abs art arts cap caps par para
bd bl ziff z ed eds ex eq eqs app tab min max avg est ok ок п пп ч т №
jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago dic""".split()
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan|Feb|Mär|Apr|Jun|Jul|Aug|Sep|Okt|Nov|Dez"
_STOPS, _NARROW, _WIDE = ".!?\ue010-\ue016", ".!?\ue010-\ue012", "\ue013-\ue016"
_DOTS = MARK["…"]
_OPEN, _CLOSE = "(\\[\ue020-\ue028", ")\\]\ue030-\ue038"
_THAI = "\u0e01-\u0e3a\u0e40-\u0e45\u0e47-\u0e4e"
_SPACELESS = "\u0e01-\u0e5b\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uff00-\uffef\ue013-\ue016\ue023-\ue027\ue033-\ue037"
_GREEK = "\u0370-\u03ff\u1f00-\u1fff"
_W = r"[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]"
_BREAK = r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])"
_MARKER = r"[ \t]*+(?:[-*+•‣◦]|\d{1,9}[.)])[ \t]"


def _trie(words: list[str]) -> str:
    """A pattern of the words that shares their beginnings; their own dots may be masked and followed by a blank."""
    root: dict = {}
    for w in words:
        at = root
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def write(node: dict) -> str:
        ends = "" in node
        parts = [("[.]" if c == "." else c.replace("-", "\\-")) + write(x) for c, x in sorted(node.items()) if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and not ends else "(?:" + "|".join(parts) + ")"
        return body + "?" if ends else body

    return write(root)


def _capital(words: list[str]) -> list[str]:
    return sorted({*words, *(w[0].upper() + w[1:] for w in words)})


# ---------------------------------------------------------------- blocks

#: A fence to its end (or the text's), a blank line, a heading line, a list after a blank line (where the last match ended); each becomes a block.
#: Groups repeat possessively here and below, as Java walks those in a loop: greedy ones recur and overflow the stack on long texts.
BLOCKS = (
    r"(?ms)^(?:[ \t]{0,3}(?:```|~~~).*?(?:^[ \t]{0,3}(?:```|~~~)[ \t]*$|\z)"
    rf"|[ \t\x{{a0}}\x{{3000}}]*{_BREAK}"
    r"|[ \t]{0,3}#{1,6}[ \t][^\n\r]*"
    rf"|(?:\G|(?<=```\n|```\r\n|~~~\n|~~~\r\n|[:：]\n|[:：]\r\n)){_MARKER}[^\n\r]*(?:{_BREAK}(?![ \t]*[\n\r]|[ \t]{{0,3}}(?:```|~~~|#{{1,6}}[ \t]))[^\n\r]+)*+)"
)


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def blocks(text: Column) -> Column:
    """The text's blocks, one after another without a gap; characters of the masks' own are made U+FFFD before."""
    clean = F.when(F.octet_length(text) > F.length(text), _sub(text, f"[{CUT}-\ue03f]", "\ufffd")).otherwise(text)
    return F.split(_sub(clean, BLOCKS, f"{CUT}$0{CUT}"), CUT)


# ---------------------------------------------------------------- running text

_LOWER_WORD = rf"\p{{Ll}}++(?:['’\-]\p{{Ll}}++)*+(?![\p{{L}}\p{{N}}_/(]|{MASK}\p{{L}})"
#: What may begin a sentence after a stop: anything but a word in lower case (names with _ . / or digits may), a dash, a mark.
_NEXT = rf"(?!{_LOWER_WORD})(?![—–\-]{_W})(?![,;:)\]\ue010\ue030-\ue038])[^\s]"
#: After an ellipsis or a quotation more is asked for: a capital, a number, an opening mark, or a name of code.
_NEXT_SURE = rf"(?:[\p{{Lu}}\p{{Lt}}\p{{N}}\p{{So}}{_OPEN}‘„¿¡#`]|\p{{Ll}}+[_/{MASK}(\d])"


#: Quotations and brackets have no length at which they end: possessive classes read each once, up to the next mark of their kind.
QUOTED = '"([^"]*+)"'
GERMAN = f"„([^„{MARK['“']}{MARK['”']}]*+)[{MARK['“']}{MARK['”']}]"
SINGLE = r"(?<![\p{L}\p{N}])‘([^‘’]*+)’(?!\p{L})"
#: The stops in a bracket that stands inside a sentence and has one at its end; from one such stop to the next.
_ROUND, _UNROUND = f"(\\[{MARK['（']}", f")\\]{MARK['）']}"
ASIDE = rf"((?:[{_ROUND}](?<=[^{_STOPS}\s{_CLOSE}]\s{{0,2}}.)(?=[^{_ROUND}{_UNROUND}]*+(?<=[{_STOPS}])[{_UNROUND}])|\G(?!\A))[^{_ROUND}{_UNROUND}{_STOPS}]*+)[{_STOPS}]"
#: A stop between an opening and a closing mark, unless it is the last one and stands before the latter; from one such stop to the next.
INSIDE = rf"((?:[{_OPEN}](?=[^{_OPEN}{_CLOSE}]*+[{_CLOSE}])|\G(?!\A))[^{_OPEN}{_CLOSE}{_STOPS};]*+)[{_STOPS};](?!\s*+[{_CLOSE}])"
#: A blank was left out after the stop: a word or number before it, a capitalised word after it.
_NO_BLANK = rf"(?<=(?:\p{{Ll}}{{2}}|[\d%){MARK['»']}{CLOSE}])[.!?])(?=\p{{Lu}}\p{{Ll}}*[ ,])"
_WHOLE = r"(?<![\p{L}\p{N}\p{M}_])"
#: One letter by itself, not a unit after a number: a capital, or small ones in a row (d. h., z. B.), but not the end of т. д.
_SINGLE = r"(?<![\p{L}\p{N}\p{M}_.])(?<!\p{N}\s)"
#: Dots that end nothing: inside decimals, versions, paths and URLs; after abbreviations and initials; after an ordinal before a month.
NO_END = (
    rf"\.(?:(?<=[\p{{L}}\p{{N}}_)/\-]\.)(?=[\p{{L}}\p{{N}}_/])(?!{_NO_BLANK})"
    rf"|(?=\s)(?:(?<={_WHOLE}(?:{_trie(_capital(ALWAYS))})\.)"
    rf"|(?=\s{{1,3}}[(]?[vV]?\p{{N}})(?<={_WHOLE}(?:{_trie(_capital(BEFORE_NUMBER))})\.)"
    rf"|(?<={_SINGLE}[\p{{Lu}}г]\.)|(?<={_SINGLE}(?<=(?<!\p{{L}})\p{{L}}[.]\s)\p{{Ll}}(?<!т[.]\s[дп])\.)|(?=\s\p{{Lu}}\.)(?<={_SINGLE}\p{{Ll}}\.)"
    rf"|(?=\s(?:{MONTHS})(?!\p{{L}}))(?<=(?<![\p{{N}}.,])\d{{1,2}}\.)))"
)
#: Each run of stops is read once, from its first.
_FULL = f".!?{MARK['।']}{MARK['؟']}"
ENDS = (
    rf"(?=[{_NARROW}])(?<![{_NARROW}])(?:([{_NARROW}]++(?<=[{_FULL}])(?<!\.\.\.)[)\]]*)(?={_W}++{_NEXT})"
    rf"|([{_NARROW}]++(?<={_DOTS}|\.\.\.)[)\]]*)(?={_W}++{_NEXT_SURE})"
    rf"|([{_NARROW}]++{_W}?[\ue030-\ue032{CLOSE}]+[)\]]*)(?={_W}+{_NEXT_SURE})"
    rf"|([.!?]){_NO_BLANK})"
)
#: What lies between two stops is Greek if it holds a Greek letter.
GREEK_QUESTION = rf"((?:\A|(?<=[.!?;\x{{37e}}]))[^.!?;\x{{37e}}{_GREEK}]*+[{_GREEK}][^.!?;\x{{37e}}]*+)([;\x{{37e}}])(?={_W}+{_NEXT})"
_SAID = "(?<=问道|問道|说道|說道|写道|回答|喊道|问|說|说)"
_GOES_ON = rf"\s*(?:[と、，,{MARK['。']}]|って|という|を|が|は|の|に|も|で|など|这|這|的|之|是|吗|嗎|[^{_WIDE}]*+{_SAID}(?:[{_WIDE}]|$)|[^{_WIDE}\s]*+{_SAID}\s)"
WIDE = rf"(?<![{_WIDE}{_DOTS}])({_DOTS}*+[{_WIDE}][{_WIDE}{_DOTS}!?]*+[)\]\ue035\ue036]*+)(?![)\]\ue032-\ue038]|\s*$)"
WIDE_QUOTE = rf"(?<![{_WIDE}{_DOTS}!?])([{_DOTS}!?]*+[{_WIDE}][{_WIDE}{_DOTS}!?]*+[\ue032-\ue034{CLOSE}]++)(?!{_GOES_ON}|\s*$)"
THAI_BLANK = rf"([{_THAI}])(?=[ \x{{a0}}]+[{_THAI}])"
#: A line break after such a script or before it, or between two lines that hold some of it. The first step marks the ends of
#: lines that hold some, as Java looks back only over bounded lengths; marks that become no cut are taken out again.
_HELD = "\ue002"
HOLDS = rf"([{_SPACELESS}][^\n\r]*+)"
SPACELESS_BREAK = rf"((?<=[{_SPACELESS}])[ \t]*+){_HELD}|{_HELD}(?={_BREAK}[^\n\r{_SPACELESS}]*+[{_SPACELESS}])|(?={_BREAK}[ \t]*+[{_OPEN}‘]*+[{_SPACELESS}])"

#: (what a text must hold: any of these, pattern, replacement), in order; the tests are searches for bytes.
STEPS = (
    (['"'], QUOTED, f"{OPEN}$1{CLOSE}"),
    (["„"], GERMAN, f"{OPEN}$1{CLOSE}"),
    (["‘"], SINGLE, f"{OPEN}$1{CLOSE}"),
    (["(", MARK["（"], "["], ASIDE, f"$1{MASK}"),
    (rf"[{_CLOSE}]", INSIDE, f"$1{MASK}"),
    (["."], NO_END, MASK),
    (None, ENDS, f"$1$2$3$4{CUT}"),
    (rf"[{_WIDE}]", WIDE, f"$1{CUT}"),
    (rf"[{_WIDE}]", WIDE_QUOTE, f"$1{CUT}"),
)
#: Only where some character is not ASCII.
BEYOND_ASCII = (("greek", GREEK_QUESTION, f"$1$2{CUT}"), ("spaceless", THAI_BLANK, f"$1{CUT}"), ("broken", HOLDS, f"$1{_HELD}"), ("broken", SPACELESS_BREAK, f"$1{CUT}"))

#: The white space of Unicode.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
FENCE, HEADING = r"\A\s{0,3}(?:```|~~~)", r"\A[ \t]{0,3}#{1,6}[ \t]"


def _offsets(pieces: Column) -> Column:
    """The number of characters before each piece."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(pieces, zero, lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.array_append(a["all"], a["at"]).alias("all")), lambda a: a["all"])


def _explode(df: DataFrame, pieces: str, names: tuple[str, str]) -> DataFrame:
    """A row for each piece with what lies before it."""
    rest = [c for c in df.columns if c != pieces]
    return df.select(*rest, F.inline(F.arrays_zip(F.col(pieces).alias("piece"), _offsets(F.col(pieces)).alias("at")))).withColumnsRenamed({"piece": names[0], "at": names[1]})


def sentence_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_pos, n_chars, unit): the units of each text, with the position of their first character, from 1.

    Null, empty and blank texts have none. A fenced code block, a heading line and a list item are one unit each. White space at the
    ends of a unit is left out. Rows that come twice give their units twice; other columns are left aside.
    """
    source = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).where(F.col("__text").rlike(r"\P{IsWhite_Space}"))
    rows = _explode(source.select("__key", blocks(F.col("__text")).alias("bs")), "bs", ("block", "before")).where(F.col("block").rlike(r"\P{IsWhite_Space}"))
    b = F.col("block")
    start, head = F.substring("block", 1, 16), F.substring(F.ltrim(b, F.lit(" \t")), 1, 16)  # a list may be indented by any number of blanks
    rows = rows.withColumn("kind", F.when(start.rlike(FENCE) | start.rlike(HEADING), 0).when(head.rlike(r"\A" + _MARKER), 1).otherwise(2)).withColumn("m", F.when(F.octet_length(b) > F.length(b), F.translate(b, MARKS_FROM, MARKS_TO)).otherwise(b))
    prose = F.col("kind") == 2
    wide = prose & (F.octet_length("m") > F.length("m"))
    asks = F.col("m").contains(";") | F.col("m").contains("\u037e")
    rows = rows.withColumns({"prose": prose, "greek": wide & asks & F.col("m").rlike(f"[{_GREEK}]"), "spaceless": wide & F.col("m").rlike(f"[{_SPACELESS}]")})
    rows = rows.withColumn("broken", F.col("spaceless") & F.btrim("m").rlike(r"[\n\r\x{85}\x{2028}\x{2029}]"))
    for holds, pattern, to in STEPS:
        m, test = F.col("m"), F.col("prose")
        if holds:
            test &= m.rlike(holds) if isinstance(holds, str) else reduce(or_, (m.contains(h) for h in holds))
        rows = rows.withColumn("m", F.when(test, _sub(m, pattern, to)).otherwise(m))
    for which, pattern, to in BEYOND_ASCII:
        rows = rows.withColumn("m", F.when(F.col(which), _sub(F.col("m"), pattern, to)).otherwise(F.col("m")))
    rows = rows.withColumn("m", F.when(F.col("broken"), F.replace("m", F.lit(_HELD), F.lit(""))).otherwise(F.col("m")))
    items = _sub(F.col("m"), rf"(?={_BREAK}{_MARKER})", CUT)
    rows = rows.withColumn("us", F.split(F.when(F.col("kind") == 1, items).otherwise(F.col("m")), CUT)).drop("m", "kind", "prose", "greek", "spaceless", "broken")
    found = _explode(rows, "us", ("u", "inside"))
    # trimming with a list of characters stops at the first other one
    found = found.withColumn("lead", F.length("u") - F.length(F.ltrim(F.col("u"), F.lit(WHITE)))).where(F.col("lead") < F.length("u"))
    found = found.withColumn("size", F.length(F.rtrim(F.col("u"), F.lit(WHITE))) - F.col("lead"))
    begin = F.col("inside") + F.col("lead") + 1
    return found.select(F.col("__key").alias(key), (F.col("before") + begin).alias("start_pos"), F.col("size").alias("n_chars"), F.substring("block", begin.cast("int"), F.col("size")).alias("unit"))
