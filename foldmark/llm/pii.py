"""Surrogates for personal data: keyed, type-consistent replacements that keep distinctness and coreference.

Detected are e-mail addresses, telephone numbers, payment-card and other long account numbers, IPv4 addresses, social-security numbers, IBANs,
access keys, long hexadecimal strings, values assigned to names such as token or password (after a colon no plain words), and persons named with
a title, with the other uses of these names in the text in any letter case. The search for titles goes on where a name ends, so `Mr. and Mrs. Green` and
`Mr. Brown and Mrs. Green` are found; names that are ordinary words too (ORDINARY) count without a title only beside another word of a name. Names without any
title in their text are not looked for. Versions before which it says so and ISBNs are no addresses or accounts. An entity is its kind and canonical form (letters folded, separators of numbers left
out), so all spellings of it get one surrogate, in every document. The surrogate is drawn from an HMAC of the entity under a key and
keeps the entity's form: digits stay digits, letters letters of the same case, separators stay, numbers that pass their check sum
get surrogates that pass it, addresses stay in reserved domains, given names keep gender and script, family names their script.

A name is one entity whatever title it stands by. One job over the corpus counts each name's uses; the most frequent decides whether its surrogate
is a male, female or family name (of equal counts male, female, family, in this order); titles that tell no gender count where nothing else does
and give names that are borne by both.

Distinctness: one job over the different entities of the whole corpus looks for two entities with one surrogate, and for surrogates that are
entities themselves, of whatever kind; the later of them draws again until there are none. Texts are then rewritten with each entity's number of draws
and use; where no entity needs either that is a map over the documents, else the exceptions are joined to the texts that hold them.

Edge cases: null stays null and empty stays empty; texts without entities stay byte for byte; repeated rows get equal results; an
empty table gives an empty result; rows with null in other columns are kept; extra columns are kept as they are, but for the count
column, which is set.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# Titles, with the gender they tell where they do.
TITLES = {"Mr.": "m", "Mr": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "M.": "m", "Señor": "m", "Sr.": "m", "Don": "m", "господин": "m", "г-н": "m", "Κύριος": "m", "κ.": "m", "السيد": "m", "Mrs.": "f", "Mrs": "f", "Ms.": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Señorita": "f", "Sra.": "f", "Srta.": "f", "Doña": "f", "госпожа": "f", "г-жа": "f", "Κυρία": "f", "κα": "f", "السيدة": "f", "Dr.": "n", "Dr": "n", "Prof.": "n", "Δρ.": "n", "الدكتور": "n"}
# Titles after a name.
TITLES_AFTER = {"先生": "m", "女士": "f", "小姐": "f", "太太": "f", "博士": "n", "教授": "n", "医生": "n"}
# Frequent family names of one sign.
FAMILY_SIGNS = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
# Surrogate names by script and use.
NAMES = {
    ("latin", "m"): "Adam Albert Andrew Anton Arthur Bruno Carl Daniel David Edgar Emil Eric Felix Frank Gabriel Hugo Ivan Jacob Julian Leo Louis Lucas Martin Max Noel Oscar Paul Peter Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Ada Alice Amelia Anna Barbara Clara Diana Elena Emma Eva Flora Gloria Hanna Helen Ida Irene Julia Laura Lena Lucia Maria Martha Nina Nora Olga Paula Rosa Sara Sofia Teresa Vera Viola".split(),
    ("latin", "n"): "Alex Andrea Ariel Charlie Dana Eden Jamie Jean Jordan Kai Kim Luca Morgan Noa Robin Sam Sascha Taylor Toni Yael".split(),
    ("latin", "s"): "Abel Arnold Baker Bauer Berger Blanco Carter Costa Dubois Fischer Fuchs Garnier Graf Hoffman Keller Lambert Lange Marin Mercier Moreno Navarro Parker Reyes Richter Rossi Santos Turner Vidal Vogel Walker Winter".split(),
    ("cyrillic", "m"): "Андрей Антон Борис Виктор Глеб Денис Егор Иван Кирилл Максим Никита Олег Павел Роман Семён Фёдор".split(),
    ("cyrillic", "f"): "Алла Анна Вера Галина Дарья Елена Жанна Ирина Лидия Мария Нина Ольга Полина Раиса Тамара Юлия".split(),
    ("cyrillic", "n"): "Валя Женя Саша Слава Шура".split(),
    ("cyrillic", "s"): "Белов Волков Громов Дымов Ершов Жуков Зимин Ильин Котов Ларин Махов Носов Орлов Панов Рыбин Титов".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας Μάρκος Νίκος Πέτρος Στέφανος Χρήστος".split(),
    ("greek", "f"): "Άννα Βασιλική Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία Φωτεινή Χριστίνα".split(),
    ("greek", "n"): "Άλεξ Νίκη Ρένα Χάρις".split(),
    ("greek", "s"): "Αγγέλου Βλάχου Γεωργίου Δήμου Ιωάννου Κωστάκη Λάμπρου Νικολάου Παππά Σταύρου".split(),
    ("arabic", "m"): "أحمد حسن خالد سامي عمر فارس كريم مازن نبيل ياسر".split(),
    ("arabic", "f"): "أمل دينا سارة عائشة فاطمة ليلى مريم منى نور هدى".split(),
    ("arabic", "n"): "إحسان جهاد صباح نضال".split(),
    ("arabic", "s"): "الحسن الخطيب الشامي العلي القاسم المصري النجار حداد خوري منصور".split(),
    ("han", "m"): "伟强 建国 志明 国华 文军 大勇 海涛 俊杰".split(),
    ("han", "f"): "丽娜 秀英 美玲 晓红 雪梅 玉兰 婷婷 静怡".split(),
    ("han", "n"): "宁 晨 文 瑞 欣 乐".split(),
    ("han", "s"): "王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙".split(),
}
_SYLLABLES = {"latin": "an ber dor el fin gar hol in kel lan mar nor".split(), "cyrillic": "ан бер дор ел фин гар хол ин кел лан мар нор".split(), "greek": "αν βερ δορ ελ φιν γαρ χολ ιν κελ λαν μαρ νορ".split(), "arabic": "ان بر در ال فن جر حل ين كل لن مر نر".split(), "han": "安 波 德 尔 芳 光 和 金 可 兰 明 诺".split()}
#: Uses of a name, of equal counts the first decides; "n" only where there is no other.
USES = "mfsn"

_PATTERN = re.compile(
    r"""(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
    |(?P<key>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:ghp|gho|ghs|xoxb|xoxp|sk|pk)[_-][A-Za-z0-9_-]{16,})
    |\b(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth)\b["']?\s*[=:]\s*["']?(?P<secret>[^\s"'<>,;]{6,})
    |(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))
    |(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
    |(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w(])\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])0\d(?:[ .-]\d{2}){4}(?!\w|[.-]\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w]|[.-]\d))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?!\d))
    |(?P<hex>(?<![\w])(?=[0-9a-f]*\d)(?=[0-9]*[a-f])[0-9a-f]{32,}(?!\w))""",
    re.X,
)
_SHOUTED = {t.upper(): g for t, g in TITLES.items() if t.upper() not in TITLES and t.endswith(".")}
_GENDER = {**TITLES, **_SHOUTED}
_TITLE = re.compile(rf"(?<!\w)(?P<title>{'|'.join(re.escape(t) for t in sorted(_GENDER, key=len, reverse=True))})(?=[ ])")
#: A word of a name, without a possessive ending; an initial; a particle, which stays.
_NAME_WORD = re.compile(r"[ ]+(?P<word>(?!\w+['’]s(?!\w))[^\W\d_][\w'’-]*[\w]|[^\W\d_][\w-]*[\w](?=['’]s(?!\w)))")
_INITIAL, _PARTICLE = re.compile(r"[ ]+[^\W\d_]\."), re.compile(r"[ ]+(?:von|van|der|den|de|del|della|di|da|dos|du|la|le|bin|ibn|al|ter|zu)(?=[ ])")
#: Words of a name at most.
_NAME_WORDS = 5
# Words of a text that are names too; alone and without a title they are left as they are.
ORDINARY = frozenset(
    "will may mark bill rose grant hope faith joy grace april june august summer autumn winter day week brown green white black gray grey young long short little strong "
    "sharp wise good best bright north south east west page price rice art drew frank gene max pat ray rich rob skip guy iris lily dawn violet ruby pearl amber ivy penny sandy "
    "rusty sunny chance chase case close cope best bean berry church temple house hall park field hill lake wood stone street town city king bishop duke earl prince judge major "
    "neu klein gross lang kurz alt jung weiss schwarz braun rot sommer herbst winter berg wald stein blanc noir rouge petit grand".split()
)
_PERSON_BEFORE = re.compile(rf"(?P<family>[{FAMILY_SIGNS}])(?P<given>[\u4e00-\u9fff]{{0,2}}?)(?P<title>{'|'.join(TITLES_AFTER)})")
_CASELESS_WORDS = 2
#: What every entity but a person's name holds or starts with.
_ANCHOR = re.compile(r"\d+|[@=:]|A[KS]IA|gh[pos][_-]|xox[bp][_-]|[sp]k[_-]")
#: A name before the = or : of a secret; _NAME_ROOM characters hold the longest one and what is before it.
_NAMED = re.compile(r"""\b(?i:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth)\Z""")
_NAME_ROOM = 12
_LOCAL, _HEX = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), frozenset("0123456789abcdef")
#: Draws after which a surrogate gets longer, for a form may have too few others of its length; a name's do from the first on.
_WIDER_FROM, _WIDEST = 4, 12
_DIGITS = ("phone", "card", "ssn")


def canonical(kind: str, shown: str) -> str:
    if kind in _DIGITS:
        return ("+" if shown.startswith("+") else "") + re.sub(r"\D", "", shown)
    if kind == "iban":
        return shown.replace(" ", "")
    return shown.lower() if kind == "email" or kind.startswith("name") else shown


def _script(word: str) -> str:
    for name, low, high in (("cyrillic", "Ѐ", "ӿ"), ("greek", "Ͱ", "Ͽ"), ("greek", "ἀ", "῿"), ("arabic", "؀", "ۿ"), ("han", "一", "鿿")):
        if any(low <= c <= high for c in word):
            return name
    return "latin"


def _titled(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, word, kind) of the words of names that stand by a title; the search goes on where the name ends."""
    found, at = [], 0
    while m := _TITLE.search(text, at):
        at, words = m.end(), []
        while len(words) < _NAME_WORDS:
            step = _INITIAL.match(text, at) or words and _PARTICLE.match(text, at)
            if step:
                at = step.end()
                continue
            step = _NAME_WORD.match(text, at)
            word = step["word"] if step else ""
            caseless = word[:1].lower() == word[:1].upper()
            if not step or not (word[0].isupper() or caseless and len(words) < _CASELESS_WORDS) or word in _GENDER or f"{word}." in _GENDER and text[step.end() : step.end() + 1] == ".":
                break
            words.append((step.start("word"), step.end()))
            at = step.end()
        for k, (start, end) in enumerate(words):
            found.append((start, end, text[start:end], f"name:{'s' if k == len(words) - 1 else _GENDER[m['title']]}:{_script(text[start:end])}"))
        at = max(at, m.end())
    return found


def _people(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of names: those by a title, and their other uses in the text in any letter case.

    A word of ORDINARY counts elsewhere only beside another word of a name. The first use by a title gives a name's kind.
    """
    titled = _titled(text) if any(t in text for t in _GENDER) else []
    names: dict[str, str] = {}
    for _, _, word, kind in titled:
        names.setdefault(canonical("name", word), kind)
    found = [(start, end, names[canonical("name", word)], canonical("name", word)) for start, end, word, _ in titled]
    if names:
        whole = {a for a, *_ in found}
        others = [(m.start(), m.end(), m[0]) for m in re.finditer(rf"(?<![\w'’-])(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(?![\w-]|['’](?!s(?!\w))\w)", text, re.I)]
        others = [x for x in others if x[0] not in whole and not x[2][0].islower()]
        ends, starts = {e for _, e, *_ in (*found, *others)}, {a for a, *_ in (*found, *others)}
        for start, end, word in others:
            form = canonical("name", word)
            beside = text[start - 1 : start] == " " and start - 1 in ends or text[end : end + 1] == " " and end + 1 in starts
            if form in names and (form not in ORDINARY or beside):
                found.append((start, end, names[form], form))
    if any(t in text for t in TITLES_AFTER):
        signs: dict[str, str] = {}
        for m in _PERSON_BEFORE.finditer(text):
            if m["given"]:
                signs.setdefault(m["family"] + m["given"], f"name:{TITLES_AFTER[m['title']]}:han")
        if signs:
            found += [(m.start(), m.end(), signs[m[0]], m[0]) for m in re.finditer("|".join(map(re.escape, sorted(signs, key=len, reverse=True))), text)]
    return found


#: What stands before numbers that are no addresses or accounts.
_VERSION, _BOOK = re.compile(r"(?i)(?:\bv|\b(?:version|release|build|firmware|revision)\b)[ .:]*\Z"), re.compile(r"(?i)\bISBN(?:-1[03])?[ :]*\Z")
_PLAIN_WORD = re.compile(r"[^\W\d_]?[^\W\d_]+[.!?)\]]*")


def _private(m: re.Match) -> bool:
    """Whether a match is personal: not a version, a book's number, or a plain word after a colon."""
    kind, text, start = m.lastgroup, m.string, m.start(m.lastgroup)
    before = text[max(0, start - 24) : start]
    if kind == "ip":
        return not _VERSION.search(before)
    if kind == "card":
        return not _BOOK.search(before)
    if kind == "secret" and "=" not in text[m.start() : start]:
        value = m["secret"]
        return not (_PLAIN_WORD.fullmatch(value) and value[1:] == value[1:].lower())
    return True


def _starts(text: str) -> list[tuple[int, int]]:
    """(start, last start), in order: every place where the pattern can match is one of them; an address may start anywhere up to its last start."""
    out, before = [], 0
    for found in _ANCHOR.finditer(text):
        a, sign = found.start(), found[0]
        if sign.isdigit():
            out.append((a, a))
            lead = text[a - 1] if a else ""
            if lead in ("+", "("):
                out.append((a - 1, a - 1))
            elif "A" <= lead <= "Z" and a > 1:
                out.append((a - 2, a - 2))
            elif lead in _HEX:
                k = a
                while k > before and text[k - 1] in _HEX:
                    k -= 1
                # a word that reaches back to the digits before was tried from there
                if k > before or not before:
                    out.append((k, k))
            before = found.end()
        elif sign == "@":
            k = a
            while k and text[k - 1] in _LOCAL:
                k -= 1
            if k < a:
                out.append((k, a - 1))
        elif sign in "=:":
            k = a
            while k and text[k - 1].isspace():
                k -= 1
            if k and text[k - 1] in "\"'":
                k -= 1
            room = max(0, k - _NAME_ROOM)
            if name := _NAMED.search(text[room:k]):
                out.append((room + name.start(), room + name.start()))
        else:
            out.append((a, a))
    out.sort()
    return out


def _matches(text: str):
    """What _PATTERN.finditer(text) gives, tried only where a match can start."""
    end = 0
    for start, latest in _starts(text):
        if latest >= end and (m := _PATTERN.match(text, max(start, end))):
            yield m
            end = m.end()


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form), in order and apart from each other."""
    found = [(m.start(m.lastgroup), m.end(m.lastgroup), m.lastgroup, canonical(m.lastgroup, m[m.lastgroup])) for m in _matches(text) if _private(m)]
    found += _people(text)
    found.sort()
    apart, last = [], 0
    for x in found:
        if x[0] >= last:
            apart.append(x)
            last = x[1]
    return apart


class _Draw:
    """A stream of numbers from the HMAC of an entity and its number of draws."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.parts, self.n, self.left = key, "\x1f".join(parts), 0, b""

    def below(self, most: int) -> int:
        if len(self.left) < 4:
            self.left = hmac.new(self.key, f"{self.parts}\x1f{self.n}".encode(), hashlib.sha256).digest()
            self.n += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value * most >> 32


def _alike(text: str, draw: _Draw) -> str:
    """Each letter and digit replaced by one of its class."""
    hexa = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None and re.search(r"[a-fA-F]", text) is not None
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            new = ("abcdef" if hexa else "abcdefghijklmnopqrstuvwxyz")[draw.below(6 if hexa else 26)]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def _iban_check(text: str) -> str:
    number = "".join(str(int(c, 36)) for c in text[4:] + text[:2] + "00")
    return f"{98 - int(number) % 97:02d}"


def surrogate(kind: str, form: str, draws: int, key: bytes) -> str:
    """The surrogate's canonical form."""
    draw = _Draw(key, kind, form, str(draws))
    wider = min(max(0, draws - _WIDER_FROM), _WIDEST)
    if kind == "email":
        local, _, domain = form.partition("@")
        labels = domain.split(".")
        own = _Draw(key, "domain", domain)
        host = _alike(labels[0] if len(labels) > 2 else labels[0][:12], own)
        return f"{_alike(local, draw)}{_alike('x' * wider, draw)}@{host}.example.{labels[-1] if labels[-1] in ('com', 'net', 'org') else 'org'}"
    if kind == "ip":
        return ".".join(str(1 + draw.below(223) if k == 0 else draw.below(256)) for k in range(4))
    if kind in _DIGITS:
        code = 1 + (2 if len(form) > 12 else 1) if form.startswith("+") else 1 if kind == "card" else 0
        rest = len(form) - code + wider
        digits = "".join(str(2 + draw.below(8) if k == 0 and kind == "phone" else draw.below(10)) for k in range(rest))
        if kind == "card" and _luhn(form):
            digits = next(digits[:-1] + str(c) for c in range(10) if _luhn(form[:code] + digits[:-1] + str(c)))
        return form[:code] + digits
    if kind == "iban":
        body = form[:2] + "00" + _alike(form[4:], draw)
        return form[:2] + (_iban_check(body) if _iban_check(form) == form[2:4] else f"{draw.below(97):02d}") + body[4:]
    if kind == "key":
        lead = re.match(r"[A-Z]{4}|[a-z]+[_-]", form)[0]
        return lead + _alike(form[len(lead) :] + ("X" if form.isupper() else "x") * wider, draw)
    if kind.startswith("name"):
        _, use, script = kind.split(":")
        pool = NAMES[(script, use)]
        own = pool[draw.below(len(pool))]
        if script == "han" and use != "s":
            own = NAMES[("han", "s")][draw.below(len(NAMES[("han", "s")]))] + own
        more = "".join(_SYLLABLES[script][draw.below(len(_SYLLABLES[script]))] for _ in range(min(draws, _WIDEST)))
        return own.lower() + more
    return _alike(form, draw) + _alike(("a" if kind == "hex" else "x") * wider, draw)


def shown_like(kind: str, shown: str, form: str) -> str:
    """A surrogate in the layout of the text that it replaces."""
    if kind in _DIGITS or kind == "iban":
        left = iter(form.removeprefix("+") if kind != "iban" else form)
        return "".join([*(next(left) if (c.isalnum() if kind == "iban" else c.isdigit()) else c for c in shown), *left])
    if kind.startswith("name"):
        return form.upper() if shown.isupper() and len(shown) > 1 else form[:1].upper() + form[1:]
    if kind == "email" and shown != shown.lower():
        return "".join(c.upper() if k < len(shown) and shown[k].isupper() else c for k, c in enumerate(form))
    return form


def rewritten(text: str, key: bytes, others: dict[tuple[str, str], tuple[str, int]]) -> tuple[str, int]:
    """The text with surrogates, and how many it has; others: (kind, number of draws) to take for an entity, where that isn't its own kind's first."""
    out, last = [], 0
    found = entities(text)
    for start, end, kind, form in found:
        other, draws = others.get((kind, form), (kind, 0))
        out += [text[last:start], shown_like(kind, text[start:end], surrogate(other, form, draws, key))]
        last = end
    return ("".join([*out, text[last:]]) if found else text), len(found)


def _mentions(with_key: bool):
    """Texts' entities: (text_key, kind, form), or (kind, form, n) with the number of times."""
    def run(batches):
        for batch in (part for whole in batches for part in common.steps(whole)):
            rows = Counter()
            for text in batch.column("text").to_pylist():
                found = entities(text or "")
                digest = hashlib.sha256(text.encode()).digest() if found and with_key else b""
                rows.update((digest, kind, form) for _, _, kind, form in found)
            part = sorted(rows)
            columns = [pa.array([x[k] for x in part], pa.string() if k else pa.binary()) for k in range(3)]
            if with_key:
                yield pa.RecordBatch.from_arrays(columns, ["text_key", "kind", "form"])
            else:
                yield pa.RecordBatch.from_arrays([*columns[1:], pa.array([rows[x] for x in part], pa.int64())], ["kind", "form", "n"])

    return run


def _drawn(key: bytes):
    def run(batches):
        for batch in batches:
            made = [surrogate(*x, key) for x in zip(*(batch.column(c).to_pylist() for c in ("kind", "form", "draws")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "surrogate"])

    return run


def used(mentions: DataFrame) -> DataFrame:
    """(kind, form, as_kind) from (kind, form, n): the kind that a form's surrogate is drawn for; only names have several."""
    parts = F.split("kind", ":")
    named = F.col("kind").startswith("name:")
    rank = F.lit(len(USES)) - F.instr(F.lit(USES), parts[1])
    rated = F.struct((parts[1] != "n").alias("known"), F.col("n").alias("times"), rank.alias("rank"), F.col("kind").alias("as_kind"))
    counted = mentions.groupBy("kind", "form").agg(F.sum("n").alias("n"))
    names = counted.where(named)
    best = names.groupBy("form").agg(F.max(rated).alias("best")).select("form", "best.as_kind")
    return names.join(best, "form").select("kind", "form", "as_kind").unionByName(counted.where(~named).select("kind", "form", F.col("kind").alias("as_kind")))


def assigned(docs: DataFrame, key: bytes, most_rounds: int = 60) -> DataFrame:
    """(kind, form, as_kind, draws, surrogate): every entity of the documents' texts, with surrogates that differ from each other and from all entities."""
    schema = "kind string, form string, draws int, surrogate string"
    mentions = common.written(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_mentions(False), "kind string, form string, n long").groupBy("kind", "form").agg(F.sum("n").alias("n")), "entities")
    known = common.written(used(mentions), "used")
    real = known.select(F.col("form").alias("surrogate")).distinct()
    now = common.written(known.select(F.col("as_kind").alias("kind"), "form").distinct().withColumn("draws", F.lit(0)).mapInArrow(_drawn(key), schema), "surrogates")
    for _ in range(most_rounds):
        # of the entities with one surrogate the first keeps it
        first = now.groupBy("surrogate").agg(F.min(F.struct("draws", "kind", "form")).alias("first"), F.count("*").alias("n"))
        meet = first.join(real.withColumn("taken", F.lit(True)), "surrogate", "left").where("n > 1 or taken")
        clash = common.written(now.join(meet, "surrogate").where("taken or kind <> first.kind or form <> first.form").select("kind", "form", "draws"), "clashes")
        if clash.isEmpty():
            return known.join(now.select(F.col("kind").alias("as_kind"), "form", "draws", "surrogate"), ["as_kind", "form"]).select("kind", "form", "as_kind", "draws", "surrogate")
        again = clash.select("kind", "form", (F.col("draws") + 1).alias("draws")).mapInArrow(_drawn(key), schema)
        now = common.written(now.join(clash.select("kind", "form"), ["kind", "form"], "left_anti").unionByName(again), "surrogates")
    raise RuntimeError(f"assigned: surrogates still clash after {most_rounds} rounds")


def surrogates(docs: DataFrame, key: bytes, count_column: str = "n_replaced") -> DataFrame:
    """The documents with surrogates in `text` (their other columns as given) and the number of replacements."""
    docs = docs.drop(count_column).withColumn("text", F.col("text").cast("string"))
    text_key, others = common.unused([*docs.columns, count_column], "text_key", "others")
    redrawn = common.written(assigned(docs, key).where("draws > 0 or kind <> as_kind").select("kind", "form", "as_kind", "draws"), "redrawn")
    given = docs
    if not redrawn.isEmpty():
        mentions = docs.select("text").mapInArrow(_mentions(True), "text_key binary, kind string, form string").distinct().withColumn("entity", F.concat_ws("\x1f", "kind", "form"))
        found = common.joined_unevenly(common.written(mentions.select("entity", "text_key"), "mentions"), redrawn.withColumn("entity", F.concat_ws("\x1f", "kind", "form")), "entity")
        lists = found.groupBy(F.col("text_key").alias(text_key)).agg(F.collect_set(F.struct("kind", "form", "as_kind", "draws")).alias(others))  # no longer than the text
        keyed = docs.withColumn(text_key, F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
        given = common.joined_unevenly(keyed, lists, text_key, how="left").select(*docs.columns, others)

    def run(batches):
        for batch in (part for whole in batches for part in common.steps(whole)):
            names = [n for n in batch.schema.names if n != others]
            lists = batch.column(others).to_pylist() if others in batch.schema.names else [None] * batch.num_rows
            done = [(None, 0) if t is None else rewritten(t, key, {(x["kind"], x["form"]): (x["as_kind"], x["draws"]) for x in d or ()}) for t, d in zip(batch.column("text").to_pylist(), lists, strict=True)]
            columns = [pa.array([x[0] for x in done], pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in done], pa.int32())], [*names, count_column])

    return given.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(count_column, T.IntegerType())]))
