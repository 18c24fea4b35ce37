"""Personal information in free text: finding it, and replacing it by typed placeholders with linked pseudonyms.

Candidates come from one pass per family of patterns, and from an Aho-Corasick automaton over the given names and
surnames of a list of people; each is then validated by its own rules (check digits and dates of identity numbers, the
numbering plans of phones, the shape of a street address, a given name beside a surname).

Numbers are replaced within their format: a keyed Feistel permutation maps each onto another valid number, with the
separators and the country's prefix kept and check digits computed again, so equal values stay equal across documents,
however they are written, and different values stay different. Names, addresses and emails get a keyed hash.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMAIL, PHONE, NATIONAL_ID, ADDRESS, PERSON = "email", "phone", "national_id", "address", "person_name"

# ---------------------------------------------------------------- patterns: fixed values of public numbering plans
_LOCAL = r"[A-Za-z0-9À-ɏ](?:[A-Za-z0-9À-ɏ._%+\-]*[A-Za-z0-9À-ɏ])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_AT = r"(?:\s?\[\s?(?:at|AT|@)\s?\]\s?|\s?\(\s?(?:at|AT|@)\s?\)\s?|\s?\{\s?(?:at|AT)\s?\}\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\.|\s?\[\s?(?:dot|DOT|\.)\s?\]\s?|\s?\(\s?(?:dot|DOT|\.)\s?\)\s?|\s?\{\s?(?:dot|DOT)\s?\}\s?|\s(?:dot|DOT)\s)"
_DOMAIN = re.compile(rf"{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,24}}(?![A-Za-z0-9\-])")
_FILE_ENDINGS = {"png", "svg", "jpg", "gif", "css", "js", "ts", "json", "git"}
_IN_LOCAL = re.compile(r"[A-Za-z0-9À-ɏ._%+\-]").match
_HIDDEN_EMAIL = re.compile(rf"(?<![A-Za-z0-9À-ɏ._%+\-])(?P<local>{_LOCAL}){_AT}(?P<domain>{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}})(?![A-Za-z0-9\-])")

_NUMBER = re.compile(r"[0-9][0-9 .()/\-]{5,}")
_NEXT = re.compile(r"[ (]+")
_PHONES = [
    re.compile(p)
    for p in (
        r"(?P<cc>\+1|001|1)?[ .\-]?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}",
        r"(?P<cc>\+1|001|1)[ .\-]?\d{3}[ .\-]?\d{3}[ .\-]?\d{4}",
        r"\d{3}(?P<s>[ .\-])\d{3}(?P=s)\d{4}",
        r"(?P<cc>\+33|0033)[ .]?\(?0?\)?[ .]?[1-9](?:[ .\-]?\d\d){4}",
        r"0[1-9](?P<s>[ .\-])\d\d(?:(?P=s)\d\d){3}",
        r"(?P<cc>\+44|0044)[ .]?(?:\(0\)[ .]?)?\d{2,5}[ .\-]?\d{3,4}[ .\-]?\d{3,4}",
        r"0\d{2,4} \d{3,4} \d{3,4}",
        r"(?P<cc>\+49|0049)[ .]?(?:\(0\)[ .]?)?\d{2,5}[ ./\-]?\d{3,8}(?:[ .\-]\d{1,5})?",
        r"0\d{2,4}[/\-] ?\d{4,9}(?:[ \-]\d{1,4})?",
        r"(?P<cc>\+(?!1|33|44|49)\d{1,3})[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}",
        r"0\d{1,3}-\d{2,4}-\d{4}",
    )
]
_SSN = re.compile(r"\d{3}([ \-])\d\d\1\d{4}")
_NINO = re.compile(r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]")
_DNI = re.compile(r"(?:\d{8}|[XYZ]-?\d{7})-?[A-Z]")
_NIR = re.compile(r"[12] ?\d\d ?(?:0[1-9]|1[0-2]|[2-9]\d) ?(?:\d\d|2[AB]) ?\d{3} ?\d{3} ?\d\d")
_PERSONNUMMER = re.compile(r"(\d\d)?(\d\d)(\d\d)(\d\d)([\-+])(\d{4})")
#: National insurance numbers: letters that may stand first and second, pairs that are never given, and the pair of samples.
_NINO_FIRST, _NINO_SECOND = "ABCEGHJKLMNOPRSTWXYZ", "ABCEGHJKLMNPRSTWXYZ"
_NINO_NEVER, _NINO_SAMPLE = {"BG", "GB", "KN", "NK", "NT", "TN", "ZZ"}, "QQ"
_NINO_PAIRS = [a + b for a in _NINO_FIRST for b in _NINO_SECOND if a + b not in _NINO_NEVER]
#: Areas of social security numbers: 001 to 899 without 666.
_SSN_AREAS = [a for a in range(1, 900) if a != 666]
#: Birth years fall into centuries that begin here: a personal number of two year digits and a hyphen is of the one from 1926 on.
_CENTURY = 1926
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

_CAP = r"(?:[A-ZÀ-Þ][\w’'\-]*|[0-9]+(?:st|nd|rd|th))"
_STREETS_EN = "street st road rd avenue ave lane ln drive dr court ct boulevard blvd terrace close rise way place pl square sq crescent gardens grove mews walk highway hwy parkway pkwy circle trail row hill green quay parade".split()
_BEFORE_EN = re.compile(rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\s\w{{1,5}},\s{{0,2}})?(?<![\w.])\d{{1,5}}[A-Za-z]?,?[ ]{_CAP}(?:[ ]{_CAP}){{0,3}}$")
_STREETS_FR = "rue|avenue|av.|boulevard|bd|chemin|place|allée|impasse|quai|route|cours|square|passage|ruelle|sentier|faubourg".split("|")
#: At most 14 characters long.
_BEFORE_FR = re.compile(r"(?<![\w.])\d{1,4}(?:\s?(?:bis|ter|quater))?,?\s$", re.IGNORECASE)
_AFTER_FR = re.compile(r"(?:de\sla\s|de\sl['’]|du\s|des\s|de\s|d['’]|la\s|le\s|les\s|l['’])*[A-ZÀ-Þ][\w’'\-]*(?:[ ][A-ZÀ-Þ][\w’'\-]*)*")
_STREETS_ES = "c/|calle |avenida |avda. |plaza |pza. |paseo |camino |carretera |ronda |travesía ".split("|")
_AFTER_ES = re.compile(r"\s?(?:(?:del|de|la|las|los|el)\s)*[A-ZÀ-Þ][\w’'\-]*(?:\s(?:(?:del|de|la|las|los|el)\s)*[A-ZÀ-Þ][\w’'\-]*)*,?\s(?:n\.?º\s?)?\d{1,4}\b")
_STREETS_DE = "straße strasse str. weg gasse platz allee ring damm ufer kamp stieg stich steig chaussee hof berg wall markt graben pfad winkel garten feld bruch kai brücke tor".split()
_BEFORE_DE = re.compile(r"(?:\b(?:Am|An|Auf|Im|In|Unter|Zum|Zur|Hinter|Alte[rn]?|Neue[rn]?|Große|Kleine|Obere|Untere|der|den|dem|[A-ZÄÖÜ][a-zäöüß]+er)\s)*(?<![\w-])[A-ZÄÖÜ][a-zäöüß]*(?:-[A-ZÄÖÜ]?[a-zäöüß]+)*$")
_HOUSE_DE = re.compile(r"\d{1,4}(?:\s?[a-z])?\b")
_PLACE_DE = re.compile(r"[0-9]{1,4}[a-z]?,\s{1,2}[0-9]{5}\s[A-ZÄÖÜ][a-zäöüß]+")
_WORDS_DE = re.compile(r"(?:\b(?:Am|An|Auf|Im|In|Unter|Zum|Zur|Hinter|Alte[rn]?|Neue[rn]?|der|den|dem)\s)*(?<![\w-])[A-ZÄÖÜ][a-zäöüß\-]+\s$")
_ADDRESS_JA = re.compile(r"〒\s?\d{3}[\-‐－]\d{4}\s?[々〇一-鿿ぁ-ヿ0-9０-９\-－‐丁目番地号ー]*|[一-鿿]{1,6}[都道府県][一-鿿ぁ-ヿ]{1,10}[市区町村郡][一-鿿ぁ-ヿ]{0,10}\d{1,4}(?:[\-－‐]\d{1,4}){1,2}")
_ADDRESS_RU = re.compile(r"(?<!\w)(?:ул\.|улица|пр\.|просп\.|проспект|пер\.|переулок|наб\.|бульвар|б-р|шоссе|пл\.)\s?[А-ЯЁ][\w\-]*(?:\s[А-ЯЁ][\w\-]*)*,?\s(?:д\.\s?)?\d{1,4}")
_ADDRESS_ZH = re.compile(r"[一-鿿]{2,8}[省市区县][一-鿿]{1,12}[路街道巷]\d{1,5}号")

# Given names and surnames that are common in many countries, beside those of the caller's list.
GIVEN = set("""james robert john michael david william richard joseph thomas charles christopher daniel matthew anthony steven paul andrew joshua kenneth kevin brian george
timothy ronald jason edward jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel gregory alexander patrick mary patricia jennifer linda
elizabeth barbara susan jessica sarah karen lisa nancy sandra margaret ashley emily donna michelle carol amanda melissa deborah stephanie rebecca laura helen sharon cynthia kathleen amy
angela anna ruth brenda pamela nicole katherine samantha christine emma catherine rachel jane maria josé juan luis carlos miguel pedro pablo sofía lucía carmen ana isabel jean pierre
michel françois camille chloé hans klaus peter wolfgang stefan ursula monika sabine greta lars erik ingrid astrid giovanni giuseppe marco giulia francesca priya amit rahul ananya
arjun wei ming yuki hiroshi kenji sakura mohammed ahmed ali omar fatima aisha layla ngozi chidi kwame amara ivan dmitri olga natasha""".split())
SURNAMES = set("""smith johnson williams jones garcia garcía miller davis rodriguez rodríguez martinez martínez hernandez lopez lópez gonzalez gonzález wilson anderson thomas taylor jackson martin
thompson harris sanchez clark ramirez lewis robinson doe müller mueller schmidt schneider fischer weber meyer wagner becker schulz hoffmann dubois durand lefebvre moreau rossi russo ferrari
bianchi silva santos oliveira patel sharma singh kumar gupta nguyen tran wang zhang chen liu yang huang kim park choi tanaka suzuki sato watanabe yamamoto nakamura kobayashi ivanov
petrov smirnov kowalski nowak hansen johansson andersson eriksson larsen okafor mensah khan hussain""".split())
RUSSIAN_GIVEN = set("""александр алексей анатолий андрей антон артём борис вадим василий виктор владимир вячеслав геннадий георгий григорий денис дмитрий евгений иван игорь илья кирилл константин максим
михаил никита николай олег павел пётр роман сергей степан тимофей фёдор юрий ярослав александра анастасия анна валентина вера виктория галина дарья евгения екатерина елена ирина ксения
лариса любовь людмила марина мария надежда наталья нина ольга полина светлана софия татьяна юлия злата""".split())
# Given names that are also common words: beside an unknown word they are no evidence.
_COMMON_WORDS = {"will", "mark", "rose", "grace", "bill", "may", "june", "hope", "faith", "joy", "art", "rob", "sue", "jack", "pat", "max", "ray", "drew", "chase", "dawn", "summer", "april", "ali", "park", "jean", "carol", "justin", "sakura", "ming"}
# Frequent words that are no surname although they may be written with a capital, and endings of such words.
_FUNCTION_WORDS = set("""this that then than when what with were will would from they them there these those have here your once most under after since before each does note both every nobody nothing everything
someone everyone today yesterday tomorrow again also just only very more some many such same other while because although however whether please could should must might shall into over onto about
according agreed todo fixme click check open close run see use add set get make take send call read write move stop start keep show find look need want think know said says
january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday street road avenue island river lake mountain university
institute company group team board committee council bank hospital school church party union party service system server""".split())
_NO_SURNAME = re.compile(r"(?:ly|ed|ing|tion|sion|ment|ness|ity|ism|ology)$")
_PARTICLES = {"van", "von", "der", "den", "de", "da", "di", "del", "la", "le", "bin", "al", "ter", "ten", "dos", "du"}
_LETTER = re.compile(r"[^\W\d_]")
_NAME_WORD = r"[^\W\d_]+(?:[’'\-][^\W\d_]+)*"
_AFTER = re.compile(rf"(?P<gap>[  ]{{1,2}}|\n)(?:(?P<initial>[^\W\d_])\.?(?:[  ]))?(?P<rest>{_NAME_WORD}(?:[ ]{_NAME_WORD}){{0,3}})")
_BEFORE = re.compile(rf"(?P<last>(?:{_NAME_WORD}[ ]){{0,3}}{_NAME_WORD}),?[ ](?:(?P<initial>[^\W\d_])\.?[ ])?$")


class People:
    """The given names and surnames of a list of full names, and the parts from which its surnames are made.

    Endings and stems that several surnames of the list share are learned from it, so that a surname of the same make is known as one
    though the list, which is incomplete, lacks it.
    """

    def __init__(self, full_names: Iterable[str]) -> None:
        self.given: set[str] = set()
        self.surnames: set[str] = set()
        for name in full_names:
            parts = name.split()
            if len(parts) >= 2:
                self.given.add(parts[0].lower())
                self.surnames.add(" ".join(parts[1:]).lower())
        self.listed = set(self.given)  # the caller's, whose word counts more than that of a common name
        self.last_words = {s.split()[-1] for s in self.surnames}
        self.tails = {s.rpartition("-")[2] for s in self.last_words if "-" in s}
        ends: Counter[str] = Counter()
        starts: Counter[str] = Counter()
        for s in self.last_words:
            for i in range(2, len(s) - 1):
                starts[s[:i]] += 1
                ends[s[i:]] += 1
        self.starts = {s for s, n in starts.items() if n >= 2 and len(s) >= 3}
        self.ends = {e for e, n in ends.items() if n >= 3 and len(e) >= 2}
        self.given |= GIVEN
        self.common_surnames = SURNAMES - self.given
        import ahocorasick

        keys = {f" {w}": ("en", len(w) + 1) for w in _STREETS_EN if len(w) > 3}
        keys |= {f" {w}{e}": ("en", len(w) + 1) for w in _STREETS_EN if len(w) <= 3 for e in " ,.;\n"}
        keys |= {f"{w} ": ("fr", len(w) + 1) for w in _STREETS_FR} | {w: ("es", len(w)) for w in _STREETS_ES}
        keys |= {f"{w} {d}": ("de", len(w) + 1) for w in _STREETS_DE for d in "123456789"}
        self.automaton = ahocorasick.Automaton()
        for key, value in keys.items():
            self.automaton.add_word(key, (*value, len(key)))
        for e in self.ends:
            if len(e) >= 4 and not any(e != x and e.endswith(x) and len(x) >= 4 for x in self.ends):
                self.automaton.add_word(e, ("sur", len(e), len(e)))
        for e in self.tails:
            self.automaton.add_word("-" + e, ("sur", len(e) + 1, len(e) + 1))
        for g in self.given:
            self.automaton.add_word(g, (PERSON, len(g), len(g)))
        self.automaton.make_automaton()

    def surname_word(self, word: str) -> bool:
        w = word.lower().replace("’", "'")
        if w in self.last_words or w in self.common_surnames or (len(w.partition("-")[0]) >= 3 and w.rpartition("-")[2] in self.tails):
            return True
        if w.startswith("o'") or w.startswith("mc"):
            w = w[2:]
        return any((w[:i] in self.starts or len(w) - i >= 4) and (w[i:] in self.ends or w[i:] in ("en", "er", "ell")) for i in range(3, len(w) - 1))


def _shape(word: str) -> str:
    return "upper" if word.isupper() and len(word) > 1 else "title" if word[:1].isupper() else "lower"


def _back(text: str, at: int, words: int, marks: str) -> int:
    """Where the last `words` words before `at` begin: back over letters, digits, `marks` and single blanks, to the edge of a word of any length."""
    while at > 0:
        c = text[at - 1]
        if c in "  ":
            words -= 1
            if words < 0:
                break
        elif not (c.isalnum() or c in marks):
            break
        at -= 1
    return at


def find_names(text: str, hits: list[tuple[int, int]], people: People) -> Iterator[tuple[int, int]]:
    """(start, end) of each given name with its surname, in any order and case; hits: where given names stand."""
    done = -1
    for start, end in hits:
        if start < done:
            continue
        word = text[start:end]
        style = _shape(word)
        common = word.lower() in _COMMON_WORDS
        listed = word.lower() in people.listed
        if not listed and style == "lower":
            continue
        # after: given [initial] surname
        found = maybe = None
        if m := _AFTER.match(text, end):
            words = m["rest"].split(" ")
            n = 0
            while n < len(words) - 1 and words[n].lower() in _PARTICLES:
                n += 1
            sur = words[n]
            stop = m.start("rest") + len(" ".join(words[: n + 1]))
            if sur[-2:] in ("'s", "’s"):
                sur, stop = sur[:-2], stop - 2
            glued = stop < len(text) and (text[stop] in "_@" or text[stop].isdigit())
            known = people.surname_word(sur)
            if glued or m["gap"] == "\n" and not known:
                pass
            elif known and (listed or _shape(sur) == style):
                found = (start, stop)
            elif not common and style == "title" and _shape(sur) == "title" and len(sur) > 3 and sur.isalpha() and sur.lower() not in people.given and sur.lower() not in _FUNCTION_WORDS and not _NO_SURNAME.search(sur):
                maybe = (start, stop)
        if found is None and (m := _BEFORE.search(text, _back(text, start, 6, ",.’'-"), start)):
            words = m["last"].split(" ")
            sur = words[-1]
            begin = m.start("last") + len(m["last"]) - len(sur)
            if people.surname_word(sur) and (listed or (_shape(sur) == style and "," in text[begin:start])) and begin >= done and not (begin and text[begin - 1] in "@_-."):
                n = len(words) - 1
                while n > 0 and words[n - 1].lower() in _PARTICLES:
                    n -= 1
                    begin -= len(words[n]) + 1
                found = (begin, end)
        found = found or maybe
        if found:
            yield found
            done = found[1]


_SURNAME_LEFT = re.compile(r"(?P<given>[^\W\d_]{2,}(?:-[^\W\d_]+)?)[  ](?:[A-ZÀ-ÞА-ЯЁ]\.?[  ])?(?:(?:van|von|der|den|de|da|di|del)[ ])*(?P<sur>(?:[OD]['’])?[^\W\d_]+(?:-[^\W\d_]+)*)$")
_SURNAME_RIGHT = re.compile(r",[ ](?P<given>[^\W\d_]{2,}(?:-[^\W\d_]+)?)(?:[ ][^\W\d_]\.)?(?![\w@])")
_SURNAME = re.compile(r"(?:[OD]['’])?[^\W\d_]+(?:-[^\W\d_]+)*$")
# Titles and words that introduce a person and so are no given name.
_TITLES = set("mr ms mrs dr prof frau herr hi hello dear ask per by from author cc thanks thx ping pinged and with for to owner who is user bitte señor señora sr sra mme monsieur madame спросите reported review signed contact the von van".split())
_CAPITAL = r"(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ’'\-]+(?:[A-Z][a-z]+)?)"
_FULL_NAME = rf"(?P<name>{_CAPITAL}(?:[ ](?:[A-Z]\.|van|von|der|den|de|da|di|del|la|bin|al|{_CAPITAL})){{0,3}}[ ]{_CAPITAL})"
# Titles and labels that only a person's name follows.
_HONORIFICS = "Mr|Mrs|Ms|Mx|Dr|Prof|Professor|President|Senator|Judge|Sir|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Signor|Signora"
_LABELS = "Signed-off-by|Co-authored-by|Reviewed-by|Reported-by|Tested-by|Acked-by|Author|Full name|Name|Contact|Attn|Regards|Sincerely|Cheers"
_INTRODUCED = re.compile(rf"(?<!\w)(?:(?:{_HONORIFICS})\.?[ ]|(?:{_LABELS})[:,][ \n]){_FULL_NAME}(?![\w@])(?=[ ]*(?P<after>[<,.;:!?()\n'’\"|]|$|[a-z]))")
_BEFORE_ADDRESS = re.compile(rf"(?<![\w.@/-]){_FULL_NAME}[ ][<(](?=[^<>()\s@]+@[^<>()\s@]+[>)])")

_CYR = r"[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?"
_CYR_NAME = re.compile(rf"(?<![\w-])({_CYR}|[А-ЯЁ]{{2,}})(?:\s[А-ЯЁ]\.)?\s({_CYR}|[А-ЯЁ]{{2,}})(?![\w-])")
_CYR_LEAD = set("по на не но он она это если как так что см при для под над без или нет да спросите где кто почему".split())
# Endings of Russian and Ukrainian surnames; of adjectives and abstract nouns, which are no given names; nouns that a genitive in -ов follows.
_CYR_SURNAME = re.compile(r"(?:[оеё]ва?|енко|чук|швили|дзе)$")
_CYR_NO_GIVEN = re.compile(r"(?:[аяое]я|[оеы]е|ие|[ыио]й|ция|сть|ство|ние|тие|тель|изм|тор)$")
_CYR_BODIES = set("совет союз дом комитет фонд банк центр отдел список набор класс журнал рынок музей клуб завод театр день год век закон сбор ряд курс обмен".split())
_HAN = r"[一-鿿々]"
_HAN_NAME = re.compile(rf"(?:^|(?<=[\s=\"'|;,(<>:#])){_HAN}{{1,3}}(?:[ 　][一-鿿々ぁ-ゖァ-ヺー]{{1,3}}|[一-鿿々ぁ-ゖァ-ヺー]{{1,4}})(?=[\s\"'|;:,)<>.!?\-&]|$)", re.MULTILINE)
# Characters of which the vocabulary of software and its reports is made: a run that is half of these is a phrase.
_HAN_PHRASE = set("设設置完成内內存不足连連接失败敗错錯误誤功请請求数數据據文件服务務器用户戶登录錄密码碼网網络絡系统統配更新下载載安装裝删刪除添加查询詢结結果测測试試运運行启啟动動停止超时時权權限路径徑参參型版本状狀态態输輸入出处處理信息消保缓緩日志表字段值列索引线線程队隊库庫代函端口开開始关關闭閉同步异異常警告报報示确認认取返回重复複检檢验驗证證构構建部署发發布提交合并併分支无無法已未正在中可能有的是了和与與或为為")
_HAN_SURNAMES = set("王李张張刘劉陈陳杨楊赵趙黄黃周吴吳徐孙孫朱胡郭何林罗羅郑鄭梁谢謝宋唐许許韩韓冯馮邓鄧曹彭曾肖蕭董潘袁蔡蒋蔣余杜叶葉魏苏蘇吕呂丁沈姚卢盧姜崔钟鍾谭譚陆陸汪范廖贾賈韦韋邹鄒孟熊秦邱尹薛侯陶黎贺賀顾顧郝龚龔邵")
_HAN_BEGINNINGS = set("程序 周期 周末 许可 許可 许多 余额 何时 何處 何处 曾经 林业 钟表 韩国 韓国 苏州 陆续 顾客 范围 程度 黄色 黃色 杨树 唐代 宋代 金额 胡同 叶子".split())
_HAN_BEFORE = re.compile(r"(?i:\b(?:name|contact|author|owner|reviewer|assignee|user|from|by|hi|hello|dear|ping|ask|mr|mrs|ms|dr|prof|herr|frau)[.:=]?\s?['\"]?|(?:担当者?|連絡先|作者|联系人|聯絡人|姓名|氏名|名前)[はは:：]?\s?)$")
_HAN_AFTER = re.compile(r"\s?(?:さん|様|氏|先生|女士|小姐|です|と申します|<[^<>\s@]+@)")


def find_introduced(text: str) -> Iterator[tuple[int, int]]:
    """Full names that a title or a label introduces, or that stand before an email address in brackets, whatever their words."""
    for m in _INTRODUCED.finditer(text):
        start, end = m.span("name")
        yield start, end - 2 if m["name"].endswith(("'s", "’s")) else end
    if "@" in text:
        for m in _BEFORE_ADDRESS.finditer(text):
            start, end = m.span("name")
            words = m["name"].split(" ")
            while len(words) > 2 and words[0].lower() in _TITLES:  # a sentence's first words
                start += len(words.pop(0)) + 1
            if not any(w.lower() in _FUNCTION_WORDS or w.lower() in _TITLES for w in words if w[0].isupper()):
                yield start, end


def find_by_surname(text: str, ends: list[int], people: People) -> Iterator[tuple[int, int]]:
    """Persons whose given name is not on the list, beside a surname of the list's make."""
    for end in ends:
        if not _word_ends(text, end):
            continue
        m = _SURNAME.search(text, _back(text, end, 0, "'’-"), end)
        if not m or not people.surname_word(m[0]):
            continue
        begin = m.start()
        if begin and (text[begin - 1] in "_@." or text[begin - 1].isdigit()):
            continue
        style = _shape(m[0])
        if style == "lower":
            continue
        left = _SURNAME_LEFT.search(text, _back(text, begin, 4, "'’-."), end)
        if left and _shape(left["given"]) == style and left["given"].lower() not in _TITLES:
            yield left.start(), end
        elif (right := _SURNAME_RIGHT.match(text, end)) and _shape(right["given"]) == style:
            yield begin, right.end("given")


def _cyrillic_person(one: str, two: str, people: People) -> bool:
    """Whether one of the words is a given name, or one has a surname's ending and the other may be a given name."""
    for given, sur in ((one.lower(), two.lower()), (two.lower(), one.lower())):
        if given in RUSSIAN_GIVEN or given in people.listed:
            return sur not in _CYR_LEAD
        if _CYR_SURNAME.search(sur) and not _CYR_NO_GIVEN.search(given) and given not in _CYR_BODIES and not _CYR_SURNAME.search(given):
            return True
    return False


def _other_script(text: str, start: int, end: int) -> bool:
    """Whether the nearest letters on either side of a run, within its sentence and line, are of no Han or Kana."""
    for step, at in ((-1, start - 1), (1, end)):
        while 0 <= at < len(text) and text[at] not in "\n.!?。！？…" and not text[at].isalpha():
            at += step
        if 0 <= at < len(text) and "\u3040" <= text[at] <= "\u9fff":
            return False
    return True


def _han_person(text: str, start: int, end: int) -> bool:
    """Evidence for a name in Han or Kana: what stands before or after it, a surname, or that it is no phrase and stands alone among another script."""
    run = text[start:end].replace(" ", "").replace("　", "")
    if len(run) < 3 or run[-1] in "はがをにのもでへと":  # a word and its particle
        return False
    phrase = 2 * sum(c in _HAN_PHRASE for c in run) >= len(run)
    if _HAN_AFTER.match(text, end) or _HAN_BEFORE.search(text, max(0, start - 16), start):  # the longest of these words has 16 characters
        return not phrase
    if len(run) == 3 and run[0] in _HAN_SURNAMES and run[:2] not in _HAN_BEGINNINGS:
        return not any(c in _HAN_PHRASE for c in run[1:])
    return not phrase and _other_script(text, start, end)


def find_other_scripts(text: str, people: People) -> Iterator[tuple[int, int]]:
    """Names in Cyrillic (two capitalised words) and in Han or Kana (a short run that stands alone between spaces or marks), by their evidence."""
    if text.isascii():
        return
    at = 0
    while m := _CYR_NAME.search(text, at):
        lead = m[1].lower() in _CYR_LEAD or not _cyrillic_person(m[1], m[2], people)  # the next word may begin a name
        at = m.start(2) if lead else m.end()
        if not lead:
            yield m.span()
    for m in _HAN_NAME.finditer(text):
        if _han_person(text, *m.span()):
            yield m.span()


def luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _birth(m: re.Match) -> datetime.date | None:
    """The date of a personal number, whose day may be raised by 60. Two digits of a year are of 1926 to 2025, after a plus a century earlier."""
    year = int(m[1] + m[2]) if m[1] else 1900 + int(m[2]) + (100 if 1900 + int(m[2]) < _CENTURY else 0) - (100 if m[5] == "+" else 0)
    day = int(m[4])
    try:
        return datetime.date(year, int(m[3]), day - 60 if day > 60 else day) if _CENTURY - 100 <= year < _CENTURY + 200 else None
    except ValueError:
        return None


def national_kind(s: str) -> str | None:
    """Which identity number s is, of those whose format, dates and check digits it keeps."""
    if _SSN.fullmatch(s):
        return None if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s.endswith("0000") else "ssn"
    if _NINO.fullmatch(s):
        return "nino" if s[:2] == _NINO_SAMPLE or (s[0] in _NINO_FIRST and s[1] in _NINO_SECOND and s[:2] not in _NINO_NEVER) else None
    if _DNI.fullmatch(s):
        t = s.replace("-", "")
        n = int(("012"["XYZ".index(t[0])] if t[0] in "XYZ" else t[0]) + t[1:-1])
        return "dni" if _DNI_LETTERS[n % 23] == t[-1] else None
    t = s.replace(" ", "")
    if _NIR.fullmatch(s) and len(t) == 15:
        n = t[:13].replace("2A", "19").replace("2B", "18")
        return "nir" if n.isdigit() and 97 - int(n) % 97 == int(t[13:]) else None
    if m := _PERSONNUMMER.fullmatch(s):  # by its date alone: numbers in use carry wrong check digits too
        return "personnummer" if _birth(m) else None
    return None


def find_numbers(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, type) of phones and identity numbers."""
    n, done = len(text), 0
    for m in _NUMBER.finditer(text):
        start, stop = m.span()
        if sum(map(str.isdigit, m[0])) < 6:
            continue
        at = start
        while at < stop:  # a run of digits and separators may hold several numbers, one after another
            hit = None
            for begin in _starts(text, at) if at == start else (at - 1, at) if text[at - 1] == "(" else (at,):
                if begin >= done and (hit := _number_at(text, begin, n)):
                    break
            if hit:
                yield hit
                at = done = hit[1]
            nxt = _NEXT.search(text, at, stop)
            at = nxt.end() if nxt else stop


def _starts(text: str, at: int) -> Iterator[int]:
    """Where a number whose first digit is at `at` may begin: at a plus, a bracket, or a letter of its own before it."""
    if at and text[at - 1] in "+(":
        yield at - 1
        if at > 1 and text[at - 1] == "(" and text[at - 2] == "+":
            yield at - 2
    elif at and text[at - 1] in "XYZ":
        yield at - 1
    elif at > 1 and text[at - 1] == "-" and text[at - 2] in "XYZ":
        yield at - 2
    elif at > 1 and text[at - 2 : at].isalpha() and text[at - 2 : at].isupper():
        yield at - 2
    elif at > 2 and text[at - 1] == " " and text[at - 3 : at - 1].isalpha() and text[at - 3 : at - 1].isupper():
        yield at - 3
    yield at


def _ends(text: str, end: int, n: int) -> bool:
    """Whether a number may end here: no digit, letter or decimal part follows."""
    if end >= n:
        return True
    c = text[end]
    if c.isascii() and (c.isalnum() or c == "_"):
        return False
    if c in "-./:" and end + 1 < n and text[end + 1].isdigit():
        return False
    return True


def _number_at(text: str, at: int, n: int) -> tuple[int, int, str] | None:
    if at and at < n and text[at].isalnum() and text[at - 1].isascii() and (text[at - 1].isalnum() or text[at - 1] in "_+"):
        return None
    if at and text[at - 1] in "-./:" and at > 1 and text[at - 2].isdigit():
        return None
    for p in (_NIR, _PERSONNUMMER, _SSN, _DNI, _NINO):
        if (m := p.match(text, at)) and _ends(text, m.end(), n) and national_kind(m[0]):
            return at, m.end(), NATIONAL_ID
    if at > 1 and text[at - 1] == "-" and text[at - 2].isalnum():  # inside an identifier of parts, as a UUID
        return None
    for p in _PHONES:
        if (m := p.match(text, at)) and _ends(text, m.end(), n) and not re.match(r"-[0-9A-Za-z]", text[m.end() : m.end() + 2]):
            return at, m.end(), PHONE
    return None


def find_emails(text: str, lower: str) -> Iterator[tuple[int, int]]:
    at, blank, seen = text.find("@"), 0, 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        here, at = at, text.find("@", at + 1)
        if not m or not here or not text[here - 1].isalnum():
            continue
        begin = here
        while begin and _IN_LOCAL(text[begin - 1]):
            begin -= 1
        while begin < here and not text[begin].isalnum():
            begin += 1
        if begin == here:
            continue
        while (after := text.find(" ", seen, begin)) >= 0:  # the last blank, looked for once over the text
            blank = seen = after + 1
        seen = max(seen, begin)
        if begin and text[begin - 1] in ":/" and "://" in text[blank:begin]:
            continue
        tail = text[m.end() : m.end() + 2]
        if tail[:1] in (":", "/") and len(tail) > 1 and (tail[1].isalnum() or tail[1] in "~/."):
            continue  # a repository or a service on a host
        if text[begin:here].lower() == "git" or m[0].lower().rpartition(".")[2] in _FILE_ENDINGS:
            continue
        yield begin, m.end()
    if any(k in lower for k in (" dot ", "dot)", "dot ]", "dot]", "at)", "at]", "(@)", "[@]")):
        for m in _HIDDEN_EMAIL.finditer(text):
            yield m.span()


def _address_at(text: str, lower: str, kind: str, start: int, end: int) -> tuple[int, int] | None:
    """The address whose word for a street (of an address family) stands at start to end, if it is one."""
    if kind == "en":
        if not text[start + 1].isupper() or (end < len(text) and (text[end].isalnum() or text[end] in "_'’")):
            return None
        m = _BEFORE_EN.search(text, _back(text, start, 8, ",.'’-\n"), start)
        return (m.start(), end) if m else None
    if kind == "fr":
        m = _BEFORE_FR.search(text, max(0, start - 16), start) if start and not text[start - 1].isalnum() else None
        rest = _AFTER_FR.match(text, end) if m else None
        return (m.start(), rest.end()) if rest else None
    if kind == "es":
        if not text[start].isupper() or start and text[start - 1].isalnum():
            return None
        m = _AFTER_ES.match(text, end)
        return (start, m.end()) if m else None
    if kind == "de":
        house = _HOUSE_DE.match(text, end)
        m = _BEFORE_DE.search(text, _back(text, start, 6, "-"), end - 1 if text[end - 2] != "." else end - 2) if house else None
        return (m.start(), house.end()) if m else None
    return None


def find_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Addresses that are not found by a word for a street."""
    for m in _PLACE_DE.finditer(text):
        before = _WORDS_DE.search(text, _back(text, m.start(), 6, "-"), m.start())
        if before:
            yield before.start(), m.end()
    if "〒" in text or "県" in text or "都" in text or "府" in text:
        for m in _ADDRESS_JA.finditer(text):
            yield m.span()
    if "号" in text:
        for m in _ADDRESS_ZH.finditer(text):
            yield m.span()
    if "ул" in text or "пр" in text or "пер" in text or "наб" in text:
        for m in _ADDRESS_RU.finditer(text):
            yield m.span()


def _alone(text: str, start: int, end: int) -> bool:
    """Whether a whole word stands at start to end, not a part of a longer one, an account or a hyphenated name."""
    if start and (text[start - 1].isalnum() or text[start - 1] in "_@"):
        return False
    if start > 1 and text[start - 1] in "-.'’/+" and text[start - 2].isalnum():
        return False
    return _word_ends(text, end)


def _word_ends(text: str, end: int) -> bool:
    if end < len(text) and (text[end].isalnum() or text[end] in "_@"):
        return False
    if end + 1 < len(text) and text[end] in "'’" and text[end + 1] == "s" and not text[end + 2 : end + 3].isalnum():
        return True
    return not (end + 1 < len(text) and text[end] in "-+/.'’" and text[end + 1].isalnum())


def find(text: str, people: People) -> list[tuple[int, int, str]]:
    """(start, end, type) of each mention, from 0, in order and without overlaps; emails win over names, addresses over numbers."""
    lower = text.lower()
    if len(lower) != len(text):  # a few letters are longer in lower case; they stay as they are
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = [(a, b, EMAIL) for a, b in find_emails(text, lower)]
    names: list[tuple[int, int]] = []
    surnames: list[int] = []
    for last, (kind, size, whole) in people.automaton.iter(lower):
        start = last - whole + 1
        if kind == "sur":
            surnames.append(start + size)
        elif kind == PERSON:
            if _alone(text, start, start + size):
                names.append((start, start + size))
        elif at := _address_at(text, lower, kind, start, start + size):
            found.append((*at, ADDRESS))
    found += [(a, b, ADDRESS) for a, b in find_addresses(text)]
    found += find_numbers(text)
    if names:
        found += [(a, b, PERSON) for a, b in find_names(text, names, people)]
    if surnames:
        found += [(a, b, PERSON) for a, b in find_by_surname(text, surnames, people)]
    found += [(a, b, PERSON) for a, b in find_other_scripts(text, people)]
    found += [(a, b, PERSON) for a, b in find_introduced(text)]
    if len(found) < 2:
        return found
    rank = {EMAIL: 0, ADDRESS: 1, NATIONAL_ID: 2, PHONE: 3, PERSON: 4}
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda x: (rank[x[2]], x[0], -x[1])):
        if all(b <= x or y <= a for x, y, _ in kept):
            kept.append((a, b, kind))
    return sorted(kept)


# ---------------------------------------------------------------- pseudonyms


def _round(key: bytes, tweak: str, n: int, value: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}:{n}:{value}".encode(), key=key, digest_size=8).digest(), "big")


def feistel(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..size-1: a balanced Feistel network over the next square, walked until it lands inside."""
    side = math.isqrt(size - 1) + 1
    while True:
        left, right = divmod(value, side)
        for n in range(8):
            left, right = right, (left + _round(key, tweak, n, right)) % side
        value = left * side + right
        if value < size:
            return value


def _refill(pattern: str, chars: str, letters: bool = False) -> str:
    """pattern with its digits (and letters) replaced by `chars`, one by one; all else stays."""
    each = iter(chars)
    return "".join(next(each) if c.isdigit() or letters and c.isalpha() else c for c in pattern)


def _packed(parts: list[tuple[int, int]], key: bytes, tweak: str) -> list[int]:
    """(value, size) of several parts, permuted together."""
    value = 0
    for v, size in parts:
        value = value * size + v
    value = feistel(value, math.prod(size for _, size in parts), key, tweak)
    out = []
    for _, size in reversed(parts):
        value, v = divmod(value, size)
        out.append(v)
    return out[::-1]


def _ssn(s: str, key: bytes) -> str:
    area, group, serial = (int(x) for x in (s[:3], s[4:6], s[7:]))
    a, g, n = _packed([(_SSN_AREAS.index(area), len(_SSN_AREAS)), (group - 1, 99), (serial - 1, 9999)], key, "ssn")
    return _refill(s, f"{_SSN_AREAS[a]:03d}{g + 1:02d}{n + 1:04d}")


def _nino(s: str, key: bytes) -> str:
    t = s.replace(" ", "")
    pairs = [_NINO_SAMPLE] if t[:2] == _NINO_SAMPLE else _NINO_PAIRS
    p, n, last = _packed([(pairs.index(t[:2]), len(pairs)), (int(t[2:8]), 10**6), ("ABCD".index(t[8]), 4)], key, f"nino{len(pairs)}")
    return _refill(s, f"{pairs[p]}{n:06d}{'ABCD'[last]}", letters=True)


def _nir(s: str, key: bytes) -> str:
    """Year, month (a real one stays one), department, place and number permuted together, the key computed again; the sex and a letter of the department stay."""
    t = s.replace(" ", "")
    month, first = int(t[3:5]), 1 if int(t[3:5]) <= 12 else 20
    months = 12 if first == 1 else 80
    land = t[5:7]
    parts = [(int(t[1:3]), 100), (month - first, months), (int(t[7:13]), 10**6)] + ([(int(land), 100)] if land.isdigit() else [])
    year, month, number, *lands = _packed(parts, key, f"nir{t[0]}{months}{'' if land.isdigit() else land}")
    body = f"{t[0]}{year:02d}{month + first:02d}{f'{lands[0]:02d}' if lands else land}{number:06d}"
    return _refill(s, body + f"{97 - int(body.replace('2A', '19').replace('2B', '18')) % 97:02d}", letters=True)


def _personnummer(s: str, key: bytes) -> str:
    """The whole date moves within its century, so that with and without the century's digits a number stays one; a raised day stays raised, and a check digit keeps its distance from the right one."""
    m = _PERSONNUMMER.fullmatch(s)
    born = _birth(m)
    century = (born.year - _CENTURY) // 100
    first = datetime.date(_CENTURY + 100 * century, 1, 1)
    days = (datetime.date(first.year + 100, 1, 1) - first).days
    moved = first + datetime.timedelta(days=feistel((born - first).days, days, key, f"born{century}"))
    raised = 60 if int(m[4]) > 60 else 0
    serial = feistel(int(m[6][:3]), 1000, key, f"serial{moved}{raised}")
    wrong = (int(m[6][3]) - luhn(m[2] + m[3] + m[4] + m[6][:3])) % 10
    short = f"{moved.year % 100:02d}{moved.month:02d}{moved.day + raised:02d}{serial:03d}"
    return _refill(s, (f"{moved.year // 100:02d}" if m[1] else "") + short + str((luhn(short) + wrong) % 10))


def _dni(s: str, key: bytes) -> str:
    lead, digits = s[0] if s[0] in "XYZ" else "", "".join(c for c in s if c.isdigit())
    body = f"{feistel(int(digits), 10 ** len(digits), key, 'dni' + lead):0{len(digits)}d}"
    return _refill(s[:-1], body) + _DNI_LETTERS[int((str("XYZ".index(lead)) if lead else "") + body) % 23]


def _phone(s: str, key: bytes) -> str:
    digits = "".join(c for c in s if c.isdigit())
    head = 0
    for p in _PHONES:
        m = p.fullmatch(s)
        if m:
            cc = m.groupdict().get("cc")
            head = sum(c.isdigit() for c in cc) if cc else 0
            break
    while head < len(digits) and digits[head] == "0":  # the trunk prefix: with or without it, and the country, it is one number
        head += 1
    own = digits[head:]
    if len(own) < 2:
        return s
    # the first digit stays, so that the number remains one of its plan
    rest = own[1:]
    return _refill(s, digits[:head] + own[0] + f"{feistel(int(rest), 10 ** len(rest), key, 'phone' + own[0]):0{len(rest)}d}")


_PERMUTED = {"ssn": _ssn, "nino": _nino, "nir": _nir, "personnummer": _personnummer, "dni": _dni}


def pseudonym(kind: str, s: str, key: bytes) -> str:
    """The value that stands for s: for phones and identity numbers another one that is valid in the same format, else a keyed hash of 128 bits of its normal form.

    Equal values have equal pseudonyms however they are written, and different ones different pseudonyms: numbers because they
    are permuted, the others but for the chance of a collision of 128 bits.
    """
    if kind == NATIONAL_ID and (which := national_kind(s)):
        return _PERMUTED[which](s, key)
    if kind == PHONE:
        return _phone(s, key)
    normal = " ".join(s.lower().replace("’", "'").split())
    if kind == EMAIL:
        normal = re.sub(_DOT, ".", re.sub(_AT, "@", s.lower(), count=1) if "@" not in s or "[@]" in s or "(@)" in s else s.lower())
    elif kind == PERSON:
        if "," in normal:
            last, _, first = normal.partition(",")
            normal = f"{first.strip()} {last.strip()}"
        normal = re.sub(r"\b[^\W\d_]\.?(?=\s)", "", normal)
        normal = " ".join(normal.split())
    return hashlib.blake2b(normal.encode("utf-8", "surrogatepass"), key=key, digest_size=16).hexdigest()


def mask(text: str, people: People, key: bytes) -> str:
    """text with each mention replaced by its type and pseudonym, as in [EMAIL:5f0c..] or [PHONE:+44 20 3141 5926]."""
    out, done = [], 0
    for a, b, kind in find(text, people):
        out += [text[done:a], f"[{kind.upper()}:{pseudonym(kind, text[a:b], key)}]"]
        done = b
    return "".join(out) + text[done:] if out else text


# ---------------------------------------------------------------- over a table

#: The list of people is a parameter of the operator and is broadcast; a list of more names, or of longer ones, is refused.
MOST_PEOPLE, MOST_PEOPLE_CHARS = 200_000, 8_000_000


def _people_list(people: DataFrame | None, column: str) -> list[str]:
    if people is None:
        return []
    names = [r[0] for r in people.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_PEOPLE + 1).collect()]
    if len(names) > MOST_PEOPLE:
        raise ValueError(f"the list has more than {MOST_PEOPLE} people")
    if sum(map(len, names)) > MOST_PEOPLE_CHARS:
        raise ValueError(f"the list has more than {MOST_PEOPLE_CHARS} characters")
    return sorted(names)


class _Worker:
    """The automaton of a list of people, built once a process."""

    _of: dict[int, People] = {}

    @classmethod
    def of(cls, names: list[str]) -> People:
        k = hash(tuple(names))
        if k not in cls._of:
            cls._of[k] = People(names)
        return cls._of[k]


def find_mentions(df: DataFrame, key: str, text: str, people: DataFrame | None, name: str = "full_name") -> DataFrame:
    """(key, pii_type, start_pos, end_pos): each mention in each text; positions in code points from 1, the end inclusive.

    Null, empty and blank texts have none. Texts of any length are searched whole. A row that comes twice gives its
    mentions twice; other columns are left aside. No shuffle.
    """
    sent = df.sparkSession.sparkContext.broadcast(_people_list(people, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Worker.of(sent.value)
        for batch in batches:
            rows: list[tuple] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    rows.extend((k, kind, a + 1, b) for a, b, kind in find(t, known))
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], [key, "pii_type", "start_pos", "end_pos"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, pii_type string, start_pos bigint, end_pos bigint")


def mask_texts(df: DataFrame, key: str, text: str, people: DataFrame | None, secret: str, name: str = "full_name") -> DataFrame:
    """(key, text): every text with its mentions replaced; null stays null, all other text is as it was."""
    sent, secret_key = df.sparkSession.sparkContext.broadcast(_people_list(people, name)), hashlib.blake2b(secret.encode(), digest_size=32).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Worker.of(sent.value)
        for batch in batches:
            out = [mask(t, known, secret_key) if t else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, text])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, `{text}` string")
