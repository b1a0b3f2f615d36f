"""Personal data and secrets replaced by keyed surrogates of the same type, gender, script and format.

A mention's canonical form (a phone's digits, a lower-cased address, a name's part) and a secret key decide its surrogate,
so an entity gets the same surrogate everywhere, without shared state. Whether two entities got the same surrogate, or one
that is itself an entity of the corpus, is checked over all distinct entities: the losers take their next surrogate
until none clashes. Only these exceptions are sent along with the documents that mention them. Tables hold entities sealed
by the key, never in clear.

Numbers with check digits (cards by Luhn, IBANs by mod 97) are detected only where these are right, and their surrogates' are
right too. Names are told by a title or by a cue (a signature, "my name is", an address header, an e-mail address beside them).
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace, free_names, ship

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = re.compile(r"(?<![\w.%+\-])[\w.%+\-]++@[\w\-]+(?:\.[\w\-]+)+")
IP = re.compile(rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\w:])")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\w)|(?<![\w+(])(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}(?!\w)|(?<![\w+(.\-])(?:\(0\d{2,4}\)|0\d{2,4})[ \-]\d{3,4}[ \-]?\d{3,4}(?![\w\-])")
CARD = re.compile(r"(?<![\w.\-+])(?:\d{13,19}|\d{4}([ \-])(?:\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?|\d{6}\1\d{4,5}))(?![\w\-])")
SSN = re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
SECRET = re.compile(r"(?i)(?<![a-z0-9])(?:token|secret|api[_\- ]?key|access[_\- ]?key|passw(?:or)?d|pwd)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_\-/+.]{8,}={0,2})")
BIRTH = re.compile(r"(?i)\b(?:born(?: on)?|date of birth|birth ?da(?:te|y)|d\.?o\.?b\.?)(?: is| was)?\s?[:\s]\s?(\d{4}-\d{2}-\d{2}|\d{1,2}([./\-])\d{1,2}\2\d{4}|\d{1,2} [a-z]{3,9} \d{4}|[a-z]{3,9} \d{1,2}, \d{4})(?!\w)")
STREET = re.compile(r"(?<![\w.,\-])(\d{1,5}[a-z]?(?: [A-Z][a-z'’\-]{1,30}){1,3}) (?:Street|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Blvd|Court|Square|Terrace|Crescent)\b|(?<!\w)([A-ZÄÖÜ][a-zäöüß]{2,30}(?:straße|strasse|gasse|allee) \d{1,4}[a-z]?)(?!\w)")
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
HEX = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])")
#: Titles that come before a name, with the gender that they tell (fixed values).
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Lady": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Dr": "n", "Prof": "n", "Professor": "n", "Doctor": "n", "Г-н": "m", "Господин": "m", "Г-жа": "f", "Госпожа": "f"}
GENDER = {t.casefold(): g for t, g in TITLES.items()}
_titles = "|".join(map(re.escape, sorted(TITLES, key=len, reverse=True)))
#: Titles in any case, more than one in "Frau Dr. X" ("Don" after a title is a name), then a word; the name's further words follow one by one.
_word = r"[^\W\d_]+(?:[\-'’][^\W\d_]+)*"
NAME = re.compile(rf"(?<!\w)((?i:{_titles})\.?[ \t]+(?:(?!(?i:Don)\b)(?i:{_titles})\.?[ \t]+)*)({_word})")
NEXT_WORD = re.compile(rf"[ \t]+({_word})")
#: Words in small letters that may stand inside a name, and words that end one where all is in capitals (fixed values).
PARTICLES = {"af", "al", "ap", "av", "bin", "bint", "da", "das", "de", "del", "della", "den", "der", "di", "do", "dos", "du", "el", "ibn", "la", "le", "ten", "ter", "van", "vom", "von", "zu", "zum", "zur"}
NO_NAMES = {"a", "an", "and", "at", "by", "but", "for", "from", "has", "in", "is", "of", "on", "or", "said", "the", "to", "was", "with", "und", "oder", "der", "die", "das", "et", "ou", "y", "o", "и"}
#: Two or three capitalised words, and what says that they name a person: a cue before them or an e-mail address after them.
_full = r"([^\W\d_a-z][^\W\d_]++(?:[\-'’][^\W\d_]++)*+(?:[ \t]++[^\W\d_a-z][^\W\d_]*+(?:[\-'’][^\W\d_]++)*+){1,2})"
CUED = re.compile(
    rf"(?:\b(?i:my name is|his name is|her name is|name is|the undersigned|signed(?: by)?|yours sincerely|sincerely|(?:best |kind |warm )?regards|attn\.?|(?:full |patient |customer |employee |contact )?name|patient|author|interviewed|befriended|married|met)"
    rf"(?:[ \t]*+[:,][ \t]*+\n?[ \t]*+|[ \t]++)|(?m:^)(?:From|To|Cc|Bcc):[ \t]*+\"?){_full}"
)
ADDRESSED = re.compile(rf"(?:^|(?<=[\n:;,>\"]))[ \t]*+\"?{_full}\"?[ \t]*+[<(]\Z")
#: Whole words of which one must be in a text, or parts of words, before its longer patterns are tried.
TITLE_WORDS, TITLE_PARTS = {t for t in GENDER if "-" not in t}, [t for t in GENDER if "-" in t]
CUE_WORDS, CUE_PARTS = {"name", "undersigned", "signed", "sincerely", "regards", "attn", "patient", "author", "interviewed", "befriended", "married", "met"}, ["from:", "to:", "cc:"]
BIRTH_WORDS, STREET_WORDS = {"born", "birth", "birthday", "birthdate", "dob", "d"}, {"street", "avenue", "ave", "road", "rd", "lane", "drive", "boulevard", "blvd", "court", "square", "terrace", "crescent"}
STREET_PARTS = ["straße", "strasse", "gasse", "allee"]
TOKENS = re.compile(r"\w+")
POSSESSIVE = re.compile(r"['’][sS]$")
#: A word, and words joined by hyphens or apostrophes.
WORD = re.compile(r"(?<!\w)[^\W\d_]++(?!\w)")
JOINED = re.compile(r"(?<!\w)[^\W\d_]++(?!\w)(?:[\-'’][^\W\d_]++(?!\w))*+")
SYLLABLES = {
    "LATIN": ["ba", "be", "bo", "ca", "ce", "da", "de", "do", "fa", "fe", "ga", "ha", "he", "ja", "jo", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "ni", "no", "pa", "pe", "po", "ra", "re", "ri", "ro", "sa", "se", "si", "so", "ta", "te", "ti", "to", "va", "ve", "vi", "vo", "wa", "za"],
    "CYRILLIC": ["ба", "бо", "ва", "ве", "га", "го", "да", "де", "до", "жа", "за", "зо", "ка", "ки", "ко", "ла", "ле", "ли", "ма", "ми", "мо", "на", "не", "ни", "но", "па", "по", "ра", "ре", "ри", "ро", "са", "се", "со", "та", "ти", "то", "фа", "ша", "шо"],
    "GREEK": ["βα", "γα", "γο", "δα", "δε", "δο", "ζα", "κα", "κο", "λα", "λε", "λι", "μα", "με", "μι", "να", "νι", "νο", "πα", "πε", "πο", "ρα", "ρο", "σα", "σι", "σο", "τα", "τε", "τι", "το"],
}
ENDINGS = {"LATIN": {"m": ["n", "r", "rt", "s"], "f": ["na", "lia", "ra", "tta"], "n": ["l", "m", "x", "nd"]}, "CYRILLIC": {"m": ["н", "р", "м", "с"], "f": ["на", "ля", "ра", "са"], "n": ["й", "ль", "нь", "т"]}, "GREEK": {"m": ["ς", "ος"], "f": ["α", "η"], "n": ["ν", "ιν"]}}


def script(word: str) -> str:
    for c in word:
        if c.isalpha():
            return unicodedata.name(c, "LATIN").split(" ")[0]
    return "LATIN"


def _stream(key: bytes, *what: str | int) -> Iterator[int]:
    """Bytes without end, drawn from the key and the entity."""
    block = 0
    while True:
        yield from hmac.digest(key, "\x1f".join(map(str, (*what, block))).encode("utf-8", "surrogatepass"), hashlib.sha256)
        block += 1


def _pick(stream: Iterator[int], n: int) -> int:
    return int.from_bytes(bytes(next(stream) for _ in range(8)), "big") % n


def alike(text: str, stream: Iterator[int]) -> str:
    """Each digit another digit (the first not 0), each letter one of its case and script; hex stays hex; the rest stays."""
    hexlike = len(text) >= 16 and all(c in "0123456789abcdefABCDEF" for c in text)
    out = []
    for i, c in enumerate(text):
        if c.isdecimal():
            zero = chr(ord(c) - unicodedata.decimal(c))
            out.append(chr(ord(zero) + (1 + _pick(stream, 9) if c != zero and not i else _pick(stream, 10))))
        elif c.isascii() and c.isalpha():
            out.append(chr(ord("A" if c.isupper() else "a") + _pick(stream, 6 if hexlike else 26)))
        elif c.isalpha():
            first = ord(c) & ~0x1F
            pool = [x for n in range(first, first + 32) if (x := chr(n)).isalpha() and x.isupper() == c.isupper() and x.islower() == c.islower() and unicodedata.name(x, "").split(" ")[:1] == unicodedata.name(c, "").split(" ")[:1]]
            out.append(pool[_pick(stream, len(pool))] if pool else c)
        else:
            out.append(c)
    return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> int:
    """1 for an IBAN with right check digits."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def date_parts(text: str) -> tuple[tuple[int, int, int], tuple[int, ...]] | None:
    """((year, month, day), where each stands among the date's words); None if it is no date. 3/4/1980 has the month first, 3.4.1980 the day."""
    words = re.findall(r"\w+", text)
    if len(words) != 3:
        return None
    named = next((i for i, w in enumerate(words) if w.isalpha()), None)
    if named is not None:
        month = next((n for n, m in enumerate(MONTHS, 1) if words[named].lower() in (m, m[:3])), 0)
        order = (2, named, 1 - named)
    else:
        month = None
        order = (0, 1, 2) if len(words[0]) == 4 else (2, 1, 0) if "/" not in text or int(words[0]) > 12 else (2, 0, 1)
    year, day = int(words[order[0]]), int(words[order[2]])
    month = int(words[order[1]]) if month is None else month
    return ((year, month, day), order) if 1800 <= year <= 2200 and 1 <= month <= 12 and 1 <= day <= 31 else None


def canonical(kind: str, text: str) -> str:
    if kind in ("phone", "card", "ssn"):
        digits = "".join(c for c in text if c.isdecimal())
        # With or without the country code +1 it is the same phone.
        return digits[1:] if kind == "phone" and len(digits) == 11 and digits[0] == "1" else digits
    if kind == "email":
        return text.lower()
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(text).exploded
    if kind == "birth":
        return "{:04d}-{:02d}-{:02d}".format(*date_parts(text)[0])
    if kind == "address":
        return " ".join(text.split()).casefold()
    return text.casefold() if kind.startswith("name") else text


def surrogate(kind: str, canon: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form of the surrogate of a canonical form."""
    stream = _stream(key, kind, canon, attempt)
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        labels = domain.split(".")
        hosts = _stream(key, "domain", domain)  # addresses of one domain stay together
        return f"{alike(local, stream)}@{'.'.join([*(alike(x, hosts) for x in labels[:-1]), labels[-1]])}"
    if kind == "ip":
        a, b, c, d = canon.split(".")
        if a == "10" or (a, b) in (("192", "168"), ("169", "254")):
            head = [a, b if a != "10" else str(_pick(stream, 256))]
        else:
            first = _pick(stream, 211)  # neither 0, 10, 127, 169, 172, 192 nor multicast
            for gap in (0, 10, 127, 169, 172, 192):
                first += first >= gap
            head = [str(min(first, 223)), str(_pick(stream, 256))]
        return ".".join([*head, str(_pick(stream, 256)), str(1 + _pick(stream, 254))])
    if kind == "card":
        out = canon[0] + alike("1" + canon[2:], stream)
        if luhn(canon):
            out = next(x for n in range(10) if luhn(x := out[:-1] + str(n)))
        return out
    if kind == "phone":
        keep = 2 if len(canon) > 10 else 0  # a country code
        return canon[:keep] + alike(canon[keep:], stream)
    if kind == "iban":
        bban = alike(canon[4:], stream)
        return f"{canon[:2]}{98 - mod97(canon[:2] + '00' + bban):02d}{bban}"
    if kind == "ipv6":
        # The first group, which tells the address's kind, and groups of zeros stay, so that a shortened address can be shortened alike.
        return ":".join(g if not i or not int(g, 16) else f"{1 + _pick(stream, (1 << (4 * (4 - (len(g) - len(g.lstrip('0')))))) - 1):04x}" for i, g in enumerate(canon.split(":")))
    if kind == "birth":
        return f"{int(canon[:4]) - 3 + _pick(stream, 7):04d}-{1 + _pick(stream, 12):02d}-{1 + _pick(stream, 28):02d}"
    if kind.startswith("name"):
        of = script(canon)
        if of not in SYLLABLES:
            return alike(canon, stream)
        # "name-m", "name-f" and "name-n" are given names, "name-" is a family name
        parts = [SYLLABLES[of][_pick(stream, len(SYLLABLES[of]))] for _ in range(3 + attempt // 4)]
        ends = ENDINGS[of].get(kind[5:] or "n")
        return ("".join(parts) + ends[_pick(stream, len(ends))]).casefold()
    return alike(canon, stream)


def laid_out(kind: str, text: str, new: str) -> str:
    """A canonical surrogate in the format of the mention."""
    if kind in ("phone", "card", "ssn", "iban"):
        fill = iter("1" + new if kind == "phone" and sum(c.isdecimal() for c in text) > len(new) else new)
        return "".join(next(fill, "") if (c.isalnum() if kind == "iban" else c.isdecimal()) else c for c in text)
    if kind == "email":
        return new.upper() if text.isupper() else new
    if kind == "ipv6":
        return ipaddress.IPv6Address(new).compressed if "::" in text else ":".join(g.lstrip("0").rjust(len(o), "0") or "0" for g, o in zip(new.split(":"), text.split(":"), strict=True))
    if kind == "birth":
        (_, _, _), order = date_parts(text)
        fresh = [x.lstrip("0") for x in new.split("-")]
        words = iter(sorted(zip(order, fresh, strict=True)))

        def put(m: re.Match) -> str:
            at, value = next(words)
            if not m[0].isalpha():
                return value.rjust(2, "0") if len(m[0]) == 2 else value
            name = MONTHS[int(value) - 1]
            name = name if len(m[0]) > 3 else name[:3]
            return name.upper() if m[0].isupper() else name.title() if m[0][0].isupper() else name

        return re.sub(r"\w+", put, text)
    if kind == "address":
        return " ".join(w.upper() if o.isupper() and len(o) > 1 else w.title() if o[:1].isupper() else w for w, o in zip(new.split(), text.split(), strict=True))
    if kind.startswith("name"):
        return new.upper() if text.isupper() and len(text) > 1 else new.title() if text[:1].isupper() else new
    return new


DIGIT = re.compile(r"\d")


def titled(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each word of a name after a title: all but the last are given names, with the title's gender.

    A name goes on, in its line, with every capitalised word, and over particles to the next one; another title or a word of NO_NAMES ends it.
    """
    found, at = [], 0
    while m := NAME.search(text, at):
        gender = next((g for t in m[1].split() if (g := GENDER[t.rstrip(".").casefold()]) != "n"), "n")
        words, at, word = [], m.end(1), (m.start(2), m.end(2))
        while word and not text[word[0]].islower():
            words.append(word)
            at = word[1]
            word = _next_name_word(text, at)
        for i, (a, b) in enumerate(words):
            b -= len(s[0]) if (s := POSSESSIVE.search(text[a:b])) else 0
            found.append((a, b, "name-" if i == len(words) - 1 else f"name-{gender}"))
    return found


def _next_name_word(text: str, at: int) -> tuple[int, int] | None:
    """Where the name that ends at `at` goes on."""
    for _ in range(4):  # "van der", "de la": particles stand in a row of three at most
        m = NEXT_WORD.match(text, at)
        if not m:
            return None
        low = m[1].casefold()
        if not m[1][0].islower():
            return None if low in GENDER or low in NO_NAMES and low not in PARTICLES else m.span(1)
        if low not in PARTICLES:
            return None
        at = m.end(1)
    return None


def cued(text: str, taken: list[tuple[int, int, str]], cues: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each word of a name without a title that a cue tells: all but the last are given names."""
    found, starts = [], {a for a, _, _ in taken}
    spans = [m.span(1) for m in CUED.finditer(text)] if cues else []
    for m in EMAIL.finditer(text) if "@" in text else ():
        # The name in front of a bracketed address, within its line.
        if m.start() and text[m.start() - 1] in "<(":
            line = max(m.start() - 120, text.rfind("\n", 0, m.start()) + 1)
            if n := ADDRESSED.search(text[line : m.start()]):
                spans.append((line + n.start(1), line + n.end(1)))
    for start, end in dict.fromkeys(spans):
        words = [(start + w.start(), start + w.end()) for w in re.finditer(r"\S+", text[start:end])]
        if any(text[a:b].casefold() in GENDER for a, b in words):
            continue
        for i, (a, b) in enumerate(words):
            b -= len(s[0]) if (s := POSSESSIVE.search(text[a:b])) else 0
            if a not in starts:
                found.append((a, b, "name-" if i == len(words) - 1 else "name-n"))
    return found


def names(text: str, low: str, words: set[str]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of names after titles or cues and of every whole-word mention, in any case, of their parts in the text.

    A part that is a given name anywhere in the text is one everywhere in it. Where titles tell its gender, a mention
    without one has that of the titled mention before it, or else of the first after it. An initial counts beside another part only.
    low, words: the text in lower case, and its words.
    """
    shown = titled(text) if _has(low, words, TITLE_WORDS, TITLE_PARTS) else []
    shown += cued(text, shown, _has(low, words, CUE_WORDS, CUE_PARTS))
    if not shown:
        return []
    parts = {text[a:b].casefold() for a, b, _ in shown}
    given: dict[str, list[tuple[int, str]]] = {}
    for a, b, kind in shown:
        if kind != "name-":
            given.setdefault(text[a:b].casefold(), []).extend([(a, kind)] if kind != "name-n" else [])

    def kind_at(part: str, at: int) -> str:
        if part not in given:
            return "name-"
        told = given[part]
        return told[max(bisect.bisect_right(told, at, key=lambda x: x[0]) - 1, 0)][1] if told else "name-n"

    found = {(a, b): kind if kind in ("name-m", "name-f") else kind_at(text[a:b].casefold(), a) for a, b, kind in shown}
    starts = {a for a, _ in found}
    longest = max(len(WORD.findall(p)) for p in parts)
    again: list[tuple[int, int]] = []
    for m in JOINED.finditer(text):
        words = [w.span() for w in WORD.finditer(text, m.start(), m.end())]
        i = 0
        while i < len(words):
            j = next((j for j in range(min(i + longest, len(words)), i, -1) if text[words[i][0] : words[j - 1][1]].casefold() in parts), i)
            if j > i:
                again.append((words[i][0], words[j - 1][1]))
            i = max(j, i + 1)
    for n, (a, b) in enumerate(again):
        beside = (n and not text[again[n - 1][1] : a].strip(" \t.")) or (n + 1 < len(again) and not text[b : again[n + 1][0]].strip(" \t."))
        if a not in starts and (b - a > 1 or beside or text[a].upper() == text[a].lower()):
            found[a, b] = kind_at(text[a:b].casefold(), a)
    return [(a, b, kind) for (a, b), kind in found.items()]


def _is_ipv6(text: str) -> bool:
    if len(text) < 7 or not DIGIT.search(text):
        return False
    try:
        return ipaddress.IPv6Address(text) is not None
    except ValueError:
        return False


def _iban_end(m: re.Match) -> int:
    """Where the longest run of the match's groups with right check digits ends; 0 if there is none."""
    text = m[0]
    while len(text.replace(" ", "")) >= 15:
        if mod97(text.replace(" ", "")) == 1:
            return m.start() + len(text)
        text = text.rpartition(" ")[0]
    return 0


def _has(low: str, words: set[str], whole: set[str], parts: Iterable[str]) -> bool:
    return not whole.isdisjoint(words) or any(p in low for p in parts)


def mentions(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order, not overlapping; where two overlap the earlier, then the longer one holds."""
    found: list[tuple[int, int, str]] = []

    def add(kind: str, pattern: re.Pattern, group: int = 0) -> None:
        found.extend((m.start(group), m.end(group), kind) for m in pattern.finditer(text))

    if "@" in text:
        add("email", EMAIL)
    if "=" in text or ":" in text:
        add("secret", SECRET, 1)
    low = text.lower()
    words = set(TOKENS.findall(low))
    digits = len(DIGIT.findall(text)) if DIGIT.search(text) else 0
    if ":" in text and text.count(":") > 1:
        found.extend((m.start(), m.end(), "ipv6") for m in IPV6.finditer(text) if _is_ipv6(m[0]))
    if digits >= 4:
        add("ip", IP)
        if _has(low, words, BIRTH_WORDS, ()):
            found.extend((m.start(1), m.end(1), "birth") for m in BIRTH.finditer(text) if date_parts(m[1]))
    if digits >= 7:
        add("phone", PHONE)
        found.extend((m.start(), end, "iban") for m in IBAN.finditer(text) if (end := _iban_end(m)))
    if digits >= 9:
        add("ssn", SSN)
    if digits >= 13:
        found.extend((m.start(), m.end(), "card") for m in CARD.finditer(text) if luhn("".join(filter(str.isdecimal, m[0]))))
    if digits:
        found.extend((m.start(), m.end(), "secret") for m in HEX.finditer(text) if not (m[0].isdecimal() or m[0].isalpha()))
        if _has(low, words, STREET_WORDS, STREET_PARTS):
            found.extend((m.start(m.lastindex), m.end(m.lastindex), "address") for m in STREET.finditer(text))
    found.extend(names(text, low, words))
    out, end = [], 0
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= end:
            out.append((a, b, kind))
            end = b
    return out


def replace_text(text: str, key: bytes, attempt: Callable[[str, str], int] = lambda kind, canon: 0, known: Callable[[str, str], str] = lambda kind, canon: kind) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds that were replaced. known: the kind that the corpus tells for a text's own."""
    parts, at, kinds = [], 0, []
    for a, b, kind in mentions(text):
        old = text[a:b]
        canon = canonical(kind, old)
        kind = known(kind, canon)
        parts += [text[at:a], laid_out(kind, old, surrogate(kind, canon, key, attempt(kind, canon)))]
        at = b
        kinds.append(kind.split("-")[0])
    return ("".join([*parts, text[at:]]) if kinds else text), kinds


def seal(key: bytes, text: str) -> bytes:
    """An entity as tables hold it: enciphered by the key, equal where entities are equal."""
    raw = text.encode("utf-8", "surrogatepass")
    tag = hmac.digest(key, b"seal\x1f" + raw, hashlib.sha256)[:16]
    mask = hashlib.shake_256(key + b"\x1fmask\x1f" + tag).digest(len(raw))
    return tag + (int.from_bytes(raw) ^ int.from_bytes(mask)).to_bytes(len(raw))


def unseal(key: bytes, sealed: bytes) -> str:
    tag, body = sealed[:16], sealed[16:]
    mask = hashlib.shake_256(key + b"\x1fmask\x1f" + tag).digest(len(body))
    return (int.from_bytes(body) ^ int.from_bytes(mask)).to_bytes(len(body)).decode("utf-8", "surrogatepass")


def clashes(ws: Workspace, entities: DataFrame, key: bytes, rounds: int = 40) -> DataFrame:
    """entities(kind, canon sealed), a written table of distinct entities -> kind, canon, attempt of those whose first surrogate won't do.

    Raises if some surrogates still clash after `rounds` draws, as where a kind has fewer forms than entities.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([seal(key, surrogate(k, unseal(key, c), key, n)) for k, c, n in rows], pa.binary())], names=["kind", "canon", "attempt", "new"])

    schema = "kind string, canon binary, attempt int, new binary"
    drawn = ws.save(entities.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema), "drawn")
    originals = entities.select(F.col("kind").alias("k"), F.col("canon").alias("c"))
    for _ in range(rounds):
        # A group holds the entities that drew one surrogate: a few, as surrogates are drawn evenly. The oldest draw keeps it.
        w = Window.partitionBy("kind", "new").orderBy("attempt", "canon")
        taken = drawn.join(originals, (F.col("kind") == F.col("k")) & (F.col("new") == F.col("c")), "left").withColumn("nth", F.row_number().over(w))
        judged = ws.save(taken.select("kind", "canon", "attempt", "new", (F.col("c").isNotNull() | (F.col("nth") > 1)).alias("bad")), "judged")
        again = judged.filter("bad").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if again.isEmpty():
            return judged.filter("attempt > 0").select("kind", "canon", "attempt")
        drawn = ws.save(judged.filter("not bad").drop("bad").unionByName(again.mapInArrow(draw, schema)), "drawn")
    raise RuntimeError(f"surrogates still clash after {rounds} rounds")


KEY_CONF = "spark.lexweave.pii.key"
_random_key = secrets.token_bytes(32)


def session_key(spark: SparkSession) -> bytes:
    """The session's spark.lexweave.pii.key; without one a random key of this process, so that surrogates can't be told from the source."""
    named = spark.conf.get(KEY_CONF, None) or spark.sparkContext.getConf().get(KEY_CONF, None)
    return named.encode() if named else _random_key


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", kinds_col: str = "pii_kinds") -> DataFrame:
    """docs with surrogates in text_col, and kinds_col array<string>: the kind of each replaced mention, in order.

    Kinds: email, ip, ipv6, phone, card, ssn, iban, birth, address, secret, name. Null texts stay null, texts without mentions are unchanged. Other
    columns stay; one named as kinds_col is replaced. Repeated rows get the same text. An empty table gives no rows. `key` decides
    all surrogates: keep it secret, and the same wherever surrogates are to agree. Tables hold no entity in clear, and all but
    that of the exceptions are deleted before this returns. Raises if surrogates still clash after 40 draws.
    """
    spark = docs.sparkSession
    ship(spark)
    ws = Workspace(spark, "pii")
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("text is not null")

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(i, kind, canonical(kind, text[a:b])) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, b, kind in mentions(text)}
            found = sorted(((i, kind, seal(key, canon)) for i, kind, canon in found), key=repr)
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary()), strict=True)], names=["id", "kind", "canon"])

    seen = ws.save(slim.mapInArrow(detect, "id string, kind string, canon binary"), "mentions")
    # A given name without a gender in its text has the one that most texts tell; texts are counted before the exchange.
    told = seen.filter("kind in ('name-m', 'name-f')").groupBy("canon").agg(F.when(F.count_if(F.col("kind") == "name-f") > F.count_if(F.col("kind") == "name-m"), "name-f").otherwise("name-m").alias("told"))
    known = seen.select("kind", "canon").distinct().join(told.withColumn("kind", F.lit("name-n")), ["kind", "canon"], "left")
    known = ws.save(known.select("kind", "canon", F.coalesce("told", "kind").alias("known")), "entities")
    entities = known.select(F.col("known").alias("kind"), "canon").distinct()
    drawn = clashes(ws, entities, key).select(F.col("kind").alias("known"), "canon", "attempt")
    other = known.join(drawn, ["known", "canon"], "left").filter("attempt is not null or known <> kind")
    other = ws.save(other.select("kind", "canon", "known", F.coalesce("attempt", F.lit(0)).alias("attempt")), "exceptions")
    kept = [c for c in docs.columns if c != kinds_col]
    others, owner = free_names(docs.columns, "exceptions", "of_document")
    source = docs.select(*kept)
    if other.isEmpty():
        source = source.withColumn(others, F.lit(None).cast("array<struct<kind:string,canon:binary,known:string,attempt:int>>"))
    else:
        # One row an id that mentions an exception; as many rows as the exceptions' mentions at most.
        by_doc = seen.join(other, ["kind", "canon"]).groupBy(F.col("id").alias(owner)).agg(F.collect_set(F.struct("kind", "canon", "known", "attempt")).alias(others))
        by_doc = ws.save(by_doc, "exceptions-by-document")
        source = source.join(by_doc, F.col(id_col).cast("string").eqNullSafe(F.col(owner)), "left").drop(owner)
        ws.clear(by_doc)
    at = kept.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = [], []
            for text, other in zip(batch.column(at).to_pylist(), batch.column(len(kept)).to_pylist(), strict=True):
                opened = [(o, unseal(key, o["canon"])) for o in other or ()]
                attempts = {(o["known"], canon): o["attempt"] for o, canon in opened}
                kinds_of = {(o["kind"], canon): o["known"] for o, canon in opened}
                new, found = (None, []) if text is None else replace_text(text, key, lambda k, c, attempts=attempts: attempts.get((k, c), 0), lambda k, c, kinds_of=kinds_of: kinds_of.get((k, c), k))
                texts.append(new)
                kinds.append(found)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kinds, pa.list_(pa.string()))], names=[*kept, kinds_col])

    fields = [T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.select(*kept).schema.fields]
    return source.mapInArrow(work, T.StructType([*fields, T.StructField(kinds_col, T.ArrayType(T.StringType()))]))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_pii(docs, session_key(spark)).select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct("pii_kinds")), ",").alias("kinds"))
