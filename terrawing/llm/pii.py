"""Problem 9: personal information in free text, and its replacement by typed placeholders.

Transducers first undo disguises (at/dot spellings, escapes, look-alike
letters, invisible characters, spelled digits) and keep the offsets; the
detectors read the normalised text, and what they find is mapped back to the
characters of the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- transducers


def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out



#: How digits are spelled.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: Letters of other scripts that look like Latin ones (Cyrillic, Greek, Armenian, Cherokee), and marks that look like ASCII ones.
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝɡɑΑΒΕΖΗΙΚΜΝΟΡΤΥΧοντυՕոսզհԼᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᏔᏃ‐‑‒–−·․", "ABESIJKMHOPCTYXaeopcyxsijhdqwgaABEZHIKMNOPTYXovtuOnuqhLABCDEHJKLMPRSTVWZ-----.."))
#: Likewise all characters whose compatibility form is one ASCII character: fullwidth, mathematical, circled and super- or subscript ones.
LOOKALIKES |= {c: n for c in map(chr, [*range(0xA0, 0x2FFF), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200), *range(0x1FBF0, 0x1FBFA)]) if len(n := unicodedata.normalize("NFKC", c)) == 1 and n.isascii()}
INVISIBLE = "\u200b\u200c\u200d\u2060\u00ad\ufeff"
#: Those of the first plane, and the ranges of the others, which a class of single characters would slow down.
_LIKE = rf"[{re.escape(''.join(c for c in LOOKALIKES if c < chr(0x10000)))}]|[\U0001d400-\U0001d7ff\U0001f100-\U0001f1ff\U0001fbf0-\U0001fbf9]"
_OPEN, _SHUT = r"[\[({<][ \t]{0,3}", r"[ \t]{0,3}[\])}>]"
_SPELLED = "|".join(DIGITS)
_TOKEN = rf"(?:(?:double|triple)[\s-]+)?(?:{_SPELLED})"
_BETWEEN = r"[\s,./-]{1,4}"
_TRANSDUCER = re.compile(
    rf"""(?P<at>[ \t]{{0,3}}{_OPEN}(?:at|@){_SHUT}[ \t]{{0,3}}|%40|&commat;|\\u0040|\\x40|[ \t]{{1,3}}(?-i:AT)[ \t]{{1,3}}(?=[\w-]{{1,63}}(?:[ \t]{{1,3}}DOT[ \t]|\.\w))|[ \t]{{1,3}}at[ \t]{{1,3}}(?=[\w-]{{1,63}}[ \t]{{1,3}}dot[ \t]))
    |(?P<dot>[ \t]{{0,3}}{_OPEN}(?:dot|punkt|point|\.){_SHUT}[ \t]{{0,3}}|%2e|&period;|\\u002e|\\x2e|(?<=\w)[ \t]{{1,3}}dot[ \t]{{1,3}}(?=\w))
    |(?P<plus>[ \t]{{0,3}}{_OPEN}plus{_SHUT}[ \t]{{0,3}}|%2b(?=\d)|&plus;)
    |(?P<entity>&\#(?:[0-9]{{1,7}}|x[0-9a-f]{{1,6}});)
    |(?P<spelled>(?<![\w-])(?:plus{_BETWEEN})?(?:\d{{1,4}}{_BETWEEN}){{0,3}}{_TOKEN}{_BETWEEN}{_TOKEN}{_BETWEEN}{_TOKEN}(?:{_BETWEEN}(?:{_TOKEN}|\d{{1,4}}(?![\w])))*(?![\w]))
    |(?P<none>[{INVISIBLE}])
    |(?P<like>(?-i:{_LIKE}))""",
    re.IGNORECASE | re.VERBOSE,
)
#: Letters that patterns without case take for an ASCII letter, besides its capital.
_ALSO = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


def _folded(t: str) -> str:
    """t in small letters, character by character, as patterns without case see it."""
    return t.lower() if t.isascii() else t.translate(_ALSO).lower()


#: Cheap tests whether a text can hold a disguise at all; whatever the transducer takes passes one of them. All but the first are for folded texts.
_HINTS_AS_IS = (" AT ", " AT\t", "\tAT ", "\tAT\t")
_HINTS = {"%": ("%40", "%2e", "%2b"), "&": ("&commat;", "&period;", "&plus;", "&#"), "\\": ("\\u0040", "\\x40", "\\u002e", "\\x2e"), "dot": (" dot ", " dot\t", "\tdot ", "\tdot\t")}
#: Words and marks in brackets, once the blanks are gone.
_BRACKETED = _automaton(tuple(w + c for w in ("at", "dot", "punkt", "point", "plus", "@", ".") for c in "])}>"))
_IN_BRACKETS = re.compile(r"[\[({<](?:at|dot|punkt|point|plus|[@.])[\])}>]")
_ODD = re.compile(f"[{INVISIBLE}]|{_LIKE}")
#: Every run of three spelled digits has a digit's end and another's beginning in a row.
_SPELLED_ROW = re.compile(rf"(?:{_SPELLED}){_BETWEEN}(?:{_TOKEN}){_BETWEEN}(?:{_TOKEN})")


def _disguised(text: str) -> bool:
    if any(h in text for h in _HINTS_AS_IS) or not text.isascii() and _ODD.search(text):
        return True
    low = _folded(text)
    if any(first in low and any(h in low for h in hints) for first, hints in _HINTS.items()):
        return True
    close = low.replace(" ", "").replace("\t", "")
    return next(_BRACKETED.iter(close), None) is not None and _IN_BRACKETS.search(close) is not None or sum(low.count(w) for w in DIGITS) >= 3 and _SPELLED_ROW.search(low) is not None


def _entity(m: str) -> str | None:
    """The character of a numeric reference, if it is an ASCII one that a disguise may hide."""
    n = int(m[3:-1], 16) if m[2] in "xX" else int(m[2:-1])
    return chr(n) if 32 < n < 127 and chr(n) not in "<>&" else None


def _digits(run: str) -> str:
    """The digits of a spelled run, with its plus sign."""
    out, times = [], 1
    for w in re.findall(r"[a-z]+|\d+", _folded(run)):
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        elif w == "plus":
            out.append("+")
        else:
            out.append(DIGITS.get(w, w) * times)
            times = 1
    return "".join(out)


class Normal:
    """A text with its disguises undone, the way back to the source's characters, and where its spelled numbers are."""

    def __init__(self, text: str, at: list[int], source: list[int], spelled: list[tuple[int, int]] = []):
        self.text, self._at, self._source, self.spelled = text, at, source, spelled

    def back(self, i: int) -> int:
        """The source position of the character at i."""
        if not self._at:
            return i
        k = bisect_right(self._at, i) - 1
        return self._source[k] + (i - self._at[k])

    def end(self, b: int) -> int:
        """The source position behind the item that ends before b; of a replacement all of it."""
        if not self._at or not b:
            return b
        k = bisect_right(self._at, b - 1)
        whole = k < len(self._at) and self._at[k] == b
        return self._source[k] if whole else self.back(b - 1) + 1


def normalise(text: str) -> Normal:
    if not _disguised(text):
        return Normal(text, [], [])
    parts, at, source, spelled, done, length = [], [0], [0], [], 0, 0
    for m in _TRANSDUCER.finditer(text):
        kind = m.lastgroup
        if kind == "like":
            new = LOOKALIKES.get(m[0])
        elif kind == "entity":
            new = _entity(m[0])
        elif kind == "spelled":
            new = _digits(m[0])
            new = new if sum(c.isdigit() for c in new) >= 7 else None
        else:
            new = {"at": "@", "dot": ".", "plus": "+", "none": ""}[kind]
        if new is None:
            continue
        # The replacement stands for the first character that isn't a blank.
        lead = len(m[0]) - len(m[0].lstrip())
        for piece, start in ((text[done : m.start()], done), (new, m.start() + lead)):
            at.append(length)
            source.append(start)
            parts.append(piece)
            length += len(piece)
        if kind == "spelled":
            spelled.append((length - len(new), length))
        at.append(length)
        source.append(m.end())
        done = m.end()
    at.append(length)
    source.append(done)
    parts.append(text[done:])
    return Normal("".join(parts), at, source, spelled)


# ------------------------------------------------------------------ detectors

#: Endings of file names, which follow an @ in the names of images and packages.
FILE_ENDINGS = frozenset("png jpg jpeg gif svg webp ico bmp js mjs ts tsx jsx css scss json map md txt py go java c h cc cpp rs rb php sh yml yaml toml xml html zip gz tgz whl jar".split())
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[\w-]*[A-Za-z0-9])?\.)+([A-Za-z]{2,24})(?![\w@-])")
_LOCAL = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ](?:[\wÀ-ÖØ-öø-ÿ.+'-]*[\wÀ-ÖØ-öø-ÿ+])?\Z")


def emails(t: str) -> Iterator[tuple[int, int]]:
    at = t.find("@")
    while at >= 0:
        domain = _DOMAIN.match(t, at + 1)
        if domain and domain[1].lower() not in FILE_ENDINGS:
            head = at
            while head and (t[head - 1].isalnum() or t[head - 1] in "._+'-"):
                head -= 1
            local = _LOCAL.search(t, head, at)
            if local:
                a, b = local.start(), domain.end()
                before = t[a - 1] if a else " "
                remote = t[b : b + 1] == ":" and t[b + 1 : b + 2].strip() != "" and not t[b + 1 : b + 2].isspace() or _in_url(t, a)
                if not remote and before not in "$%{}@":
                    yield a, b
        at = t.find("@", at + 1)


def _in_url(t: str, a: int) -> bool:
    """Whether what starts at a is the login part of a URL."""
    while a and not t[a - 1].isspace() and t[a - 1] not in "/?#\"'<>":
        a -= 1
    return t[max(0, a - 3) : a] == "://"


def _before(t: str, a: int, most: int = 60) -> int:
    """Where to look for words in front of a: blanks and marks next to it don't count."""
    while a and (t[a - 1].isspace() or t[a - 1] in ".:#='\"*_(-"):
        a -= 1
    return max(0, a - most)


_PHONE = re.compile(
    r"""(?<![\w+./-])(?<!\d[,:])(?:
    (?:\+\d{1,3}|00[1-9]\d)[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,6}(?:[ ./-]?\d{2,8}){1,5}
    |(?:1[-. ])?(?:\(\d{3}\)[ ]?|\d{3}[-. ])\d{3}[-. ]\d{4}
    |0\d{2}[ ]\d{4}[ ]\d{4}|0\d{4}[ ]\d{3}[ ]\d{3}|0\d{4}[ ]\d{6}|0\d{3}[ ]\d{3}[ ]\d{4}
    |0\d(?:[. -]\d{2}){4}
    |\(?0\d{1,4}\)?[ ]?[/-][ ]?\d{3,8}(?:-\d{1,4})?
    |0\d{3}[- ]\d{3}[- ]\d{3}
    )(?![\w%-]|[.,:]\d)""",
    re.VERBOSE,
)
#: Words after which a row of digits is no person's number.
_THINGS = re.compile(r"(?:serial|build|order|part|sku|ticket|invoice|batch|lot|model|version|rev|commit|hash|checksum|crc|issue|review|epsg|port|seed|frame|tile|offset|size|id of|item)(?:[\s_-]*(?:no|nr|number|num|id))?[\s.:#=\"']*\Z", re.IGNORECASE)


#: Anything that could be a phone number, found fast and looked at closely then.
_CLUMP = re.compile(r"[+(]?\d[\d ().\-/]{6,24}\d")


def phones(t: str) -> Iterator[tuple[int, int]]:
    for clump in _CLUMP.finditer(t):
        at, end = clump.span()
        while m := _PHONE.search(t, at, min(len(t), end + 2)):
            at = m.end()
            n = sum(c.isdigit() for c in m[0])
            if 8 <= n <= 15 and not _THINGS.search(t, _before(t, m.start()), m.start()) and m[0].strip("+0 ().-/"):
                yield m.start(), m.end()


def spelled_phones(t: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Numbers whose digits were spelled out: nobody does that to a size or a serial number that isn't called one."""
    for a, b in runs:
        if 7 <= sum(c.isdigit() for c in t[a:b]) <= 15 and not _THINGS.search(t, _before(t, a), a):
            yield a, b


_VALUE = r"""(?:\d{3}[- .]\d{2}[- .]\d{4}|[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]|[XYZ]?\d{7,8}[- ]?[A-Z]|[A-Z]{1,3}\d{6,8}[A-Z]?|\d{4}[- ]\d{4}[- ]\d{4}|\d{2,3}[. ]\d{3}[. ]\d{3}(?:[-/ ]\d{1,3})?|\d{6}[-+]?\d{4}|\d{8,14})(?![\w-])"""
_LABEL = r"""(?:ssn|sin|nino|dni|nie|nif|cpf|pesel|bsn|curp|rut|aadhaa?r|passport|personnummer|steuer-?id
    |(?:social[\s_-]+security|national[\s_-]+insurance|insurance)|ni(?=[\s_-]*(?:no|nr|num))|tax(?:payer)?(?=[\s_-]*(?:id|no|num|ident))
    |(?:personal|national|citizen|identity|id)[\s_-]*(?:id(?:entity|entification)?|card|code|number|no)|driver'?s?[\s_-]*licen[cs]e|driving[\s_-]*licen[cs]e)"""
_LABELLED = re.compile(rf"(?<![A-Za-z0-9]){_LABEL}(?:[\s_-]*(?:card|id|ident|no|nr|num|number|code))*\.?[\"'*\s:=#>]{{1,6}}({_VALUE})", re.IGNORECASE | re.VERBOSE)
#: An unlabelled number fills a cell of a record by itself.
_CELL = re.compile(rf"(?:(?<=[|;\"',\n\ufeff])|(?<=[|;\"',][ ])|\A)((?-i:\d{{3}}[- ]\d{{2}}[- ]\d{{4}}|QQ[ ]?\d\d[ ]?\d\d[ ]?\d\d[ ]?[A-D]|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][ ]?\d\d[ ]?\d\d[ ]?\d\d[ ]?[A-D]|\d{{8}}-?[A-Z]|[A-Z]{{1,2}}\d{{6,7}}|\d{{4}}[- ]\d{{4}}[- ]\d{{4}}|\d{{12}}))(?=[|;\"',\r\n]|\Z)")


#: How the labels begin, in folded texts: a start for each branch of _LABEL. No start takes more than letters, so none hides another.
_LABEL_START = re.compile(r"ssn|sin|social|steuer|nino|nie|nif|ni(?=[\s_-]*n)|national|dni|driv(?=er|ing)|cpf|curp|citizen|pesel|passport|person(?=al|nummer)|bsn|rut|aadha|insurance|tax|identity|id(?=[\s_-]*(?:id|ca|co|n))")


def labelled_numbers(t: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _LABEL_START.finditer(_folded(t)):
        a = m.start()
        if a >= done and (hit := _LABELLED.match(t, a)):
            done = hit.end()
            yield hit.span(1)


def cell_numbers(t: str, others: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Numbers that fill a cell of a line on which something else of a person was found. Each line is read once."""
    done = 0
    for a, b in sorted(others):
        lo, hi = t.rfind("\n", 0, a) + 1, t.find("\n", b)
        lo, hi = max(lo, done), len(t) if hi < 0 else hi
        if lo < hi:
            for m in _CELL.finditer(t, lo, hi):
                yield m.span(1)
            done = hi


_W = r"[^\W\d_][\w'’-]*"
_UP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_LINE = r"(?:[ ]|,[ ]?|,?[ ]*\r?\n[ \t]*(?:\#|//|\*|--|;)?[ \t]*)"
_ADDRESS = re.compile(
    rf"""(?<![\w.+-])(?:
    (?:(?:Flat|Apt\.?|Apartment|Unit|Suite|FLAT|APT\.?|UNIT|flat|apt\.?)[ ]?\#?\w{{1,5}}{_LINE})?\d{{1,5}}[A-Za-z]?(?:[-/]\d{{1,4}}[A-Za-z]?)?,?[ ](?:(?:[NSEW]\.?|North|South|East|West|Old|New|{_UP})[ ]){{1,4}}
        (?:Street|St|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Avenue|Ave|Boulevard|Blvd|Close|Way|Place|Pl|Terrace|Crescent|Cres|Square|Parade|Highway|Hwy|Row|Mews|Gardens|Grove|Walk|Circle|Parkway|Pkwy|STREET|ST|ROAD|RD|LANE|DRIVE|COURT|AVENUE|AVE)\b
    |\d{{1,5}}[ ](?:[NSEW]\.?[ ])?\d{{1,3}}(?:st|nd|rd|th|ST|ND|RD|TH)[ ](?:Street|St|Avenue|Ave|Road|Rd|Place|Pl|Drive|Dr)\b
    |\d{{1,4}}(?:[ ]?(?:bis|ter|quater|[A-D]))?,?[ ](?:rue|avenue|all[ée]e|boulevard|place|chemin|impasse|quai|cours|route|square|passage|Rue|Avenue|All[ée]e|Boulevard|RUE|AVENUE)[ ](?:(?:de[ ]la|de[ ]l['’]|des|du|de|d['’]|la|le|les)[ ]?)*{_UP}
    |{_UP}(?:stra(?:ß|ss)e|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig|gatan|gata|gade|gaten|v[äe]gen|veien|vej|straat|laan|gracht|plein|katu|kuja|STRASSE|WEG)[ ]\d{{1,4}}[ ]?[a-z]?\b
    |(?:Am|An[ ]der|Im|In[ ]der|Auf[ ]der|Unter[ ]den|Zum|Zur)[ ]{_UP}[ ]\d{{1,4}}[a-z]?(?=,[ ]?\d{{4,5}}[ ]{_UP})
    |{_UP}[ ](?:Stra(?:ß|ss)e|Weg|Allee|Platz|Ring|Damm|Str\.)[ ]\d{{1,4}}[a-z]?\b
    |(?:Calle|C/|Via|Viale|Piazza|Corso|Rua|Avenida|Av\.|Avda\.|Carrer|Plaza|Paseo|Travessa|ul\.|Ulica)[ ](?:(?:de|del|da|do|dos|das|di|dei|della|la|las|los|el|l['’])[ ]?)*(?:{_UP}[ ]?){{1,3}},?[ ]?(?:n[.ºo°]+[ ]?)?\d{{1,5}}\b
    )""",
    re.VERBOSE,
)


#: What an address has at its heart, found fast; the whole is looked for around it. The second pattern is for texts that hold one of the endings.
_HEART = re.compile(r"\d[A-Za-z]?,? (?:[A-ZÀ-Þ][\w.]|[NSEW] |\d{1,3}(?:st|nd|rd|th|ST|ND|RD|TH) |bis|ter|quater|rue|avenue|all|boul|place|chemin|impasse|quai|cours|route|square|passage)")
_ENDINGS = ("straße ", "strasse ", "Strasse ", "Straße ", "STRASSE ", "str. ", "Str. ", "weg ", "Weg ", "WEG ", "gasse ", "allee ", "Allee ", "platz ", "Platz ", "damm ", "Damm ", "ufer ", "steig ", "ring ", "Ring ",
            "gatan ", "gata ", "gade ", "gaten ", "vägen ", "vegen ", "veien ", "vej ", "straat ", "laan ", "gracht ", "plein ", "katu ", "kuja ", "Am ", "An der ", "In der ", "Auf der ", "Unter den ", "Zum ", "Zur ",
            "Calle ", "C/ ", "Via ", "Viale ", "Piazza ", "Corso ", "Rua ", "Avenida ", "Av. ", "Avda. ", "Carrer ", "Plaza ", "Paseo ", "Travessa ", "ul. ", "Ulica ")
#: Roles in front of a name in small letters.
_ROLES = ("author", "Author", "maintainer", "Maintainer", "owner", "Owner", "contact", "Contact", "pilot", "name", "written by", "Written by", "-by")
_MARKS = _automaton((*_ENDINGS, *_ROLES))
_NUMBER_LAST = re.compile(r"[^\W\d_.-][.)]?,? (?:n[.ºo°]* ?)?\d")


def marks(t: str) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """Where, and which, the endings of addresses and the roles of people are: one pass over the text."""
    found: tuple[list, list] = ([], [])
    for last, w in _MARKS.iter(t):
        found[w in _ROLES].append((last + 1 - len(w), w))
    return found


def addresses(t: str, endings: list[tuple[int, str]] | None = None) -> Iterator[tuple[int, int]]:
    hearts = [m.span() for m in _HEART.finditer(t)]
    for i, e in marks(t)[0] if endings is None else endings:
        j = i + len(e)
        if t[j : j + 1].isdigit() or e[0].isupper() and e not in ("Straße ", "Strasse ", "STRASSE ", "Str. ", "Weg ", "WEG ", "Allee ", "Platz ", "Damm ", "Ring ") and _NUMBER_LAST.search(t, j, j + 48):
            hearts.append((i, j))
    hearts.sort()
    done = 0
    for a, b in hearts:
        if a >= done:
            m = _ADDRESS.search(t, max(done, a - 60), min(len(t), b + 120))
            if m and m.start() <= b:
                yield m.span()
                done = m.end()


#: Given names common in several languages, without accents.
GIVEN = frozenset("""aaron adam aisha ahmed alejandro alex alexander ali alice amara amir ana anders andrea andrew anna anton antonio arjun arthur asa astrid
    barbara beatriz ben benjamin bjorn bruno camila carlos carmen caroline charlotte chen chloe christian clara claire claudia daniel david diego divya dmitri
    elena elias elin elisa elizabeth emil emile emily emma eric erik eva farid fatima felix fernando finn francesca frida gabriel george giulia greta gustav
    hana hannah hans hassan helen helena henrik hiro hugo ibrahim idris igor ines inigo ingrid irina isabel ivan jack jakob james jan jana javier jean jens
    johan john jonas jose joseph juan julia julien karim karin karl kate katarina kenji kofi kwame lars laura layla leila lena leo liam lina linnea lisa louis
    lucas lucia luis lukas magnus maja marco maria marie marta martin mary mateo maya meera michael miguel mohammed nadia natalia nikolai nils nina noah noor
    olga oliver omar oskar otto pablo paul paula pavel pedro peter pierre priya rachel rahul ravi renee robert rosa salma samuel sara sarah sebastian sofia
    stefan svetlana tara thomas tomas viktor wanda william yara yuki yusuf zoe""".split())
#: Words that make a capitalised phrase an organisation, place or thing.
ORGANISED = frozenset("""ltd limited inc gmbh llc llp corp corporation company contributors authors team labs lab laboratories robotics foundation university
    institute project group consortium software systems technologies technology developers maintainers community committee department society association
    holdings partners ventures services solutions media press college school council agency the all rights reserved license licence harbour ridge lake
    site office centre center street road lane drive court avenue strip mesher kernel loss filter""".split())
_I = r"[A-ZÀ-ÖØ-Þ]\."
_PARTICLE = r"(?:(?:van|von|der|den|de|la|del|della|di|da|dos|du|le|el|bin|ibn|ten|ter|af|av|zu|VAN|VON|DER|DE|LA|DEL|DI|DA|DU)[ ])"
_FAMILY = rf"{_PARTICLE}{{0,2}}(?:al-|el-|AL-|EL-|ad-|as-)?[A-ZÀ-ÖØ-Þ](?:[\w'’]{{0,40}}\w)(?:-[A-ZÀ-ÖØ-Þ][\w'’]{{0,40}}\w){{0,3}}"
_GIVEN = r"[A-ZÀ-ÖØ-Þ][\w'’]{0,40}[^\W\d_](?:-[A-ZÀ-ÖØ-Þ][\w'’]{0,40}\w)?"
_NAME = rf"(?:{_FAMILY},[ ](?:{_GIVEN}|{_I})(?:[ ]{_I}){{0,2}}(?!\w)|(?:{_GIVEN}|{_I})(?:[ ]?{_I}){{0,2}}[ ]{_FAMILY}(?!\w))"
_CAPITALS = re.compile(rf"(?<![\w.@/\\$-])(?<!\w['’]){_NAME}")
_LOWER = r"[a-zß-öø-ÿ][a-zß-öø-ÿ'’-]+"
#: What stands before a person's name: credits that name nobody else, and looser ones that also name things. The title isn't part of the name.
_END = r"""[ ]*,?[ ]*["'*]*[ ]*(?:(?:Dr|Prof|Mr|Mrs|Ms|Ing|Dipl)\.?[ ]+)?\Z"""
_STRICT = re.compile(
    rf"""(?:@author|\b(?:co-?)?authors?["'*]*[ ]*[:=]|\b(?:maintainer|pilot|crew|operator|full_?name|reporter|reviewer|assignee|surveyor|signatory|translator|contributor)s?["'*]*[ ]*(?:[:=]|=>)
    |\b(?:written|maintained|reported|reviewed|contributed|flown|authored|tested|suggested|patch(?:ed)?|approved|signed[ ]off|coded|submitted)(?:[ ]since[ ]\d{{4}})?[ ]by|[A-Za-z]+(?:-[a-z]+)?-by)[ ]*:?{_END}""",
    re.IGNORECASE | re.VERBOSE,
)
_LOOSE = re.compile(
    rf"""(?:\b(?:owner|contact|name|contact_?name|person|editor|creator|developer)s?["'*]*[ ]*(?:[:=]|=>)|\bthanks[ ]to|\bcredits?[ ](?:to|:)|\bask|\bcourtesy[ ]of|\bagreed[ ]with|\bcc[ ]*:
    |\b(?:created|developed|modified|ported|fixed|added|prepared)[ ]by|(?:copyright|\(c\)|©|&copy;)(?:[ ]*(?:\(c\)|©))?(?:[ ]*\d{{4}}(?:[ ]*[-–,][ ]*\d{{2,4}})*)?(?:[ ]by)?){_END}""",
    re.IGNORECASE | re.VERBOSE,
)
#: Rights said to be a person's: the years before or behind the name, or an end of the sentence.
_RIGHTS = re.compile(rf"(?:copyright|\(c\)|©|&copy;)(?:[ ]*(?:\(c\)|©))?(?:[ ]*(?P<year>\d{{4}})(?:[ ]*[-–,][ ]*\d{{2,4}})*)?,?(?:[ ]by)?{_END}", re.IGNORECASE | re.VERBOSE)
_RIGHTS_AFTER = re.compile(r"[ ]\d{4}\b|\.?[ ]All[ ]rights|[ ]*[.,]?[ \t]*(?:\*/)?\r?(?:\n|\Z)", re.VERBOSE | re.IGNORECASE)
_THANKS = re.compile(rf"\b(?:thanks|thank[ ]you|kudos|props)(?:[ ]to)?,?{_END}", re.IGNORECASE | re.VERBOSE)
#: Between the names of a list with bullets, an address of mail or nothing behind each.
_BULLET = re.compile(r"(?:[ ](?:<[^<>\n]*>|\([^()\n]*\)))?\r?\n[ \t]*(?:\#|//|--|\*)?[ \t]*[*-][ ]+")
#: Behind a name that somebody is to ask.
_ASK, _ABOUT = re.compile(r"\bask(?:ed)?[ ]\Z", re.IGNORECASE), re.compile(r"[ ](?:about|for|to|whether|if)\b")
_LINE_END = re.compile(r"[ \t]*(?:\*/)?\r?(?:\n|\Z)")
#: Between the names of a list.
_JOINT = re.compile(r"(?:[ ]*[,;&][ ]*|[ ]*,?[ ](?:and|und|et|y|e|og|och|&)[ ]+)\Z")
_CELL_BEFORE, _CELL_AFTER = re.compile(r"[|;\"',\n\ufeff][ ]?\Z|\A\Z"), re.compile(r"[|;\"',\r\n]|\Z")
_CREDIT = re.compile(r"[ ]*(?:<[^<>\s]*@|\([^()\s]*@|,?[ ]\[mail\]|[ ](?:asked[ ]for|flew|wrote|reported|reviewed|maintains)\b)", re.VERBOSE)
_LOWERED = re.compile(rf"(?:@author|\b(?:author|maintainer|owner|contact|pilot|name|written[ ]by|reviewed-by|signed-off-by)[\"'*]*[ ]*:?)[ ]+[\"']?((?:{_LOWER}),?[ ](?:[a-z]\.[ ])?(?:{_LOWER}))(?![\w@.])", re.IGNORECASE | re.VERBOSE)
_TITLE = frozenset("dr prof mr mrs ms ing".split())


def _plain(word: str) -> str:
    word = word.casefold().replace("ø", "o").replace("ł", "l")
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)) if not word.isascii() else word


_known: dict[str, bool] = {}


def _is_given(word: str) -> bool:
    known = _known.get(word)
    if known is None:
        known = _plain(word.partition("-")[0]) in GIVEN
        if len(_known) < 100_000:
            _known[word] = known
    return known


def names(t: str, mails: list[tuple[int, int]] = [], others: list[tuple[int, int]] = [], homes: list[tuple[int, int]] = [], roles: list[tuple[int, str]] | None = None) -> Iterator[tuple[int, int]]:
    """Capitalised phrases that their place shows to be a person, or whose given name is a common one.

    Places that tell: a credit before or after, a list that begins with one,
    an address of mail nearby whose local part has the name's words, and a
    cell of a line on which something else of a person was found.
    """
    at, listed = 0, -1
    lines: dict[int, str] | None = None
    while m := _PAIR.search(t, at):
        a, at = m.start(), m.end() - 1
        if a and (lead := _LEAD.search(t, max(0, a - 12), a)):
            a = lead.start()
        hit = _CAPITALS.match(t, a) or _CAPITALS.match(t, m.start())
        if not hit:
            continue
        kind = _is_person(t, hit)
        if kind is None and listed >= 0 and hit.start() - listed <= 8 and _JOINT.match(t[listed : hit.start()]):
            kind = "credit"
        if kind is None and listed >= 0 and _BULLET.fullmatch(t, listed, hit.start()):
            kind = "credit"
        if kind is None and others and _LOOSE.search(t, _before(t, hit.start()), hit.start()):
            cell = _CELL_BEFORE.search(t, max(0, hit.start() - 2), hit.start()) or t[hit.start() - 2 : hit.start()] == ": "
            if _next_to(hit.end(), others) or cell and _CELL_AFTER.match(t, hit.end()) and _near_lines(t, hit.start(), hit.end(), others):
                kind = "cell"
        if kind is None and mails:
            lines = _mails_by_line(t, mails) if lines is None else lines
            near = t.count("\n", 0, hit.start()) if len(lines) > 1 else next(iter(lines))
            if any(_of_mail(hit[0], lines[k]) for k in (near - 1, near, near + 1) if k in lines):
                kind = "mail"
        if kind is None and others and _CELL_BEFORE.search(t, max(0, hit.start() - 2), hit.start()) and _CELL_AFTER.match(t, hit.end()) and _on_line(t, hit.start(), others) and not _is_town(t, hit.start(), homes):
            kind = "cell"
        if kind:
            yield hit.span()
            at = hit.end()
            listed = at if kind == "credit" else -1
    for i, w in marks(t)[1] if roles is None else roles:
        m = _ROLE_LOWER.match(t, i + len(w)) and _LOWERED.search(t, max(0, i - 1), min(len(t), i + 200))
        if m and m[1].islower():
            words = m[1].replace(",", " ").split()
            if _is_given(words[0]) or "," in m[1] and _is_given(words[-1]) or _CREDIT.match(t, m.end(1)):
                yield m.span(1)


def _mails_by_line(t: str, mails: list[tuple[int, int]]) -> dict[int, str]:
    """The plain local parts of the addresses, by the number of their line."""
    out: dict[int, str] = {}
    line, done = 0, 0
    for a, b in sorted(mails):
        line += t.count("\n", done, a)
        done = a
        out[line] = out.get(line, "") + " " + _plain(t[a:b].partition("@")[0])
    return out


def _of_mail(name: str, local: str) -> bool:
    """Whether a local part holds two of the name's words, or one of at least five letters."""
    words = [_plain(w).strip(".'’") for w in re.split(r"[\s,'’-]+", name)]
    there = [w for w in words if len(w) > 2 and w in local]
    return len(there) > 1 or any(len(w) > 4 for w in there)


def _next_to(b: int, others: list[tuple[int, int]]) -> bool:
    """Whether one of the sorted others begins right behind b, after a bracket or a comma."""
    k = bisect_right(others, (b, 1 << 60))
    return k < len(others) and others[k][0] - b <= 3


def _near_lines(t: str, a: int, b: int, others: list[tuple[int, int]]) -> bool:
    """Whether one of the sorted others lies on the two lines before or behind, or on the same one."""
    k = bisect_right(others, (a, 1 << 60))
    return k < len(others) and t.count("\n", b, others[k][0]) <= 2 or k > 0 and t.count("\n", others[k - 1][1], a) <= 2


def _is_town(t: str, a: int, homes: list[tuple[int, int]]) -> bool:
    """Whether what starts at a goes on with an address before it, in the same cell."""
    k = bisect_right(homes, (a, 1 << 60))
    return k > 0 and not re.search(r"[\"';|\n]", t[homes[k - 1][1] : a])


def _on_line(t: str, a: int, others: list[tuple[int, int]]) -> bool:
    """Whether one of the sorted others lies on the line of a."""
    k = bisect_right(others, (a, 1 << 60))
    return k < len(others) and "\n" not in t[a : others[k][0]] or k > 0 and "\n" not in t[others[k - 1][1] : a]


#: Two capitalised words, or one and a particle: where a name may be. Family names may have particles in front.
_PAIR = re.compile(r"[A-ZÀ-ÖØ-Þ](?:[^\W\d_]|['’.-]){0,40},? (?:[A-ZÀ-ÖØ-Þ]|(?:v[ao]n|de[rnl]?|d[iau]|dos|l[ae]|el|bin|ibn|te[nr]|a[fv]|zu|al|ad|as)[ -])")
_LEAD = re.compile(rf"(?<![\w.@])(?:{_PARTICLE}{{1,2}}|(?:al|el|ad|as)-)\Z")
_ROLE_LOWER = re.compile(r"[\"'*]*[ ]*:?[ ]+[\"']?[a-zß-öø-ÿ]+,?[ ][a-zß-öø-ÿ]")


def _is_person(t: str, m: re.Match) -> str | None:
    """What shows that a phrase is a person's name: credit or given; None if nothing does, or if it is an organisation's."""
    a, b = m.span()
    words = m[0].replace(",", " ").split()
    if words[0].rstrip(".").lower() in _TITLE or any(_plain(w.strip(".")) in ORGANISED for w in words) or _organised_after(t, b):
        return None
    flip = "," in m[0]
    given = words[len(m[0].partition(",")[0].split())] if flip else words[0]
    initial = any(len(w) == 2 and w[1] == "." for w in words)
    before = _before(t, a)
    if _CREDIT.match(t, b) or _STRICT.search(t, before, a) and (initial or not flip or _LINE_END.match(t, b) is not None) or initial and _LOOSE.search(t, before, a):
        return "credit"
    if _RIGHTS.search(t, before, a) and _RIGHTS_AFTER.match(t, b) or _ASK.search(t, before, a) and _ABOUT.match(t, b):
        return "credit"
    if _THANKS.search(t, before, a) and re.match(r"[ ](?:for|who)\b|[.!,;]", t[b : b + 6]):
        return "credit"
    return "given" if _is_given(given) else None


_AFTER = re.compile(r"[ ]+([A-Za-z]+)")


def _organised_after(t: str, b: int) -> bool:
    m = _AFTER.match(t, b)
    return bool(m) and m[1].lower() in ORGANISED and m[1][0].isupper()


#: The order of precedence where items overlap.
TYPES = ("email", "id_number", "address", "phone", "name")


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(pii_type, start, end) of each item in the source's characters, sorted; items never overlap. Null and empty texts have none."""
    if not text:
        return []
    normal = normalise(text)
    t = normal.text
    endings, roles = marks(t)
    found: dict[str, list[tuple[int, int]]] = {"email": list(emails(t)), "id_number": list(labelled_numbers(t)), "phone": [*phones(t), *spelled_phones(t, normal.spelled)], "address": list(addresses(t, endings))}
    found["name"] = list(names(t, found["email"], sorted(x for k in found for x in found[k]), sorted(found["address"]), roles))
    others = found["email"] + found["phone"] + found["address"] + found["name"]
    found["id_number"] += cell_numbers(t, others) if others else []
    taken: list[tuple[int, int]] = []
    out = []
    for kind in TYPES:
        for a, b in sorted(set(found[kind])):
            k = bisect_right(taken, (a, 1 << 60))
            if (k and taken[k - 1][1] > a) or (k < len(taken) and taken[k][0] < b):
                continue
            taken.insert(k, (a, b))
            out.append((kind, normal.back(a), normal.end(b)))
    return sorted(out, key=lambda x: x[1:])


def replace(text: str | None) -> tuple[str | None, int]:
    """The text with each item replaced by its type in angle brackets, such as <EMAIL>, and the number of items; the rest stays as it is."""
    found = find(text)
    parts, done = [], 0
    for kind, a, b in found:
        parts += [text[done:a], f"<{kind.upper()}>"]
        done = b
    return ("".join([*parts, text[done:]]) if found else text), len(found)


def found_items(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, pii_type, start_pos, end_pos: one row per item, positions in characters from 0, end excluded. Whole texts are read."""
    slim = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, x in zip(ids, batch.column(1)):
                rows += [(i, *item) for item in find(x.as_py())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())],
                ["doc_id", "pii_type", "start_pos", "end_pos"],
            )

    return slim.mapInArrow(run, "doc_id long, pii_type string, start_pos int, end_pos int")


def redacted(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and text with placeholders, and n_items, the number of items replaced. Null texts stay null, with 0 items."""
    slim = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [replace(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], ["doc_id", "text", "n_items"])

    return slim.mapInArrow(run, "doc_id long, text string, n_items int")
