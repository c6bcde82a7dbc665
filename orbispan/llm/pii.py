"""Personal data surrogates (operator 2).

Detected entities get keyed replacements of their own type and shape: digits for digits, letters of the same script and
case, names of the same gender, addresses of the same class, check digits that hold where they held. The same entity has
the same surrogate everywhere (coreference): a name is known again in its document without its title and in part, and a
given name has one gender in the whole corpus, whatever the titles.

Addresses and numbers are permuted within the space of their format by a keyed cipher without fixed points, so different
entities cannot collide. Names are drawn by key. A check by joins over the distinct entities finds surrogates that equal a
real entity, or one another for names; only those take further attempts, which are few and joined back by their size.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from orbispan.llm.common import fresh, map_arrow, stored, texts_of

# Honorifics and the gender that they tell.
HONORIFICS = {"Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "M.": "m", "Sr": "m", "Señor": "m", "Don": "m", "г-н": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Sra": "f", "Srta": "f", "Señora": "f", "Doña": "f", "г-жа": "f", "Dr": "n", "Prof": "n", "Sir": "m", "Lady": "f", "господин": "m", "госпожа": "f", "Κύριος": "m", "Κυρία": "f", "السيد": "m", "السيدة": "f", "श्री": "m", "श्रीमती": "f", "מר": "m", "גברת": "f"}
# Beginnings of names by script, endings by script and gender. Names are composed from them.
STEMS = {"latin": ["bel", "cor", "dan", "el", "far", "gil", "hal", "jor", "kel", "lor", "mar", "nor", "ol", "per", "ros", "sel", "tam", "ul", "vel", "wen"], "cyrillic": ["бор", "вел", "гор", "дар", "елл", "зор", "кир", "лад", "мир", "нор", "ол", "пав", "род", "сав", "тим"], "greek": ["αλ", "βασ", "γερ", "δημ", "ελ", "θαλ", "καλ", "λεον", "μαρ", "νικ", "πετ", "σταμ"]}
ENDS = {("latin", "m"): ["an", "o", "us", "ric"], ("latin", "f"): ["a", "ine", "ia", "elle"], ("latin", "n"): ["er", "in", "ey", "is"], ("latin", "family"): ["son", "man", "ley", "berg", "ford"], ("cyrillic", "m"): ["ан", "ей", "ил"], ("cyrillic", "f"): ["а", "ия", "ина"], ("cyrillic", "n"): ["я", "ень"], ("cyrillic", "family"): ["енко", "ич", "чук"], ("greek", "m"): ["ος", "ης", "ας"], ("greek", "f"): ["α", "η", "ω"], ("greek", "n"): ["ι", "ις"], ("greek", "family"): ["ίδης", "άκης", "όπουλος"]}

# Days and months, which begin with a capital and are no names.
CALENDAR = frozenset("monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember lundi mardi mercredi jeudi vendredi samedi dimanche janvier février mars avril juin juillet août septembre octobre novembre décembre lunes martes miércoles jueves viernes sábado domingo enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split())

_GENDER = HONORIFICS | {h.upper(): g for h, g in HONORIFICS.items()}
_TITLES = re.compile(rf"(?<!\w)({'|'.join(re.escape(h) for h in sorted(_GENDER, key=len, reverse=True))})\.?\s+(?:(?:Dr|Prof|DR|PROF)\.?\s+)*")
_NAME_WORD = re.compile(r"[^\W\d_][\w'’-]*")
_PIECE = re.compile(r"[^\W\d_]\w*")
_BLANKS = re.compile(r"[ \t]+")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "phone": re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    "card": re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"),
}
KINDS = (*PATTERNS, "name")
#: Words of a titled name at most; of one in capitals, where other words have capitals too, fewer.
NAME_WORDS, CAPITAL_WORDS = 3, 2
#: Further attempts of an address or number whose surrogate is a real entity. One that fails all of them, as most of its
#: format's space is taken, keeps its first surrogate, which no other entity has.
ATTEMPTS = 12
#: Most letters of a name in scripts that do not part words.
UNPARTED = 6

def canonical(kind: str, text: str) -> str:
    """One form for all spellings of an entity."""
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in text if c.isdigit())
    if kind == "iban":
        return text.replace(" ", "")
    return text.casefold() if kind != "ip" else text


_DIGIT = re.compile(r"\d")
_UNPARTED = re.compile("[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0eff]+")


def _names_begin(word: str) -> bool:
    """A capital, or a letter of a script without case."""
    return word[0].isupper() or word[0].lower() == word[0].upper()


def _trimmed(word: str) -> str:
    """A name word without a possessive ending."""
    return word[:-2] if word[-2:] in ("'s", "’s", "'S", "’S") else word.rstrip("'’-")


def _name_words(text: str, title: str, at: int) -> list[tuple[int, int, str]]:
    """(start, end, text) of the words of the name that a title introduces at a place. Words that do not begin like a name, and
    days, months and titles, end it; a letter with a full stop is an initial."""
    out: list[tuple[int, int, str]] = []
    capitals = title not in HONORIFICS
    while len(out) < (CAPITAL_WORDS if capitals else NAME_WORDS) and (m := _NAME_WORD.match(text, at)):
        word = _trimmed(m[0])
        if not word or not _names_begin(word) or capitals and not word.isupper() or word.casefold() in CALENDAR or m[0] in _GENDER:
            break
        run = _UNPARTED.match(word)
        if run:
            word = word[: min(run.end(), UNPARTED)]
        out.append((m.start(), m.start() + len(word), word))
        at = m.end()
        if len(word) == 1 and text[at : at + 1] == ".":
            at += 1
        elif run or len(word) < len(m[0]):
            break
        blank = _BLANKS.match(text, at)
        if not blank:
            break
        at = blank.end()
    return out


def _persons(names: list[tuple[str, list[tuple[int, int, str]]]]) -> dict[str, str]:
    """Kind of each name word of a text: one role for all its mentions. In names of several words the last is a family name and
    the others are given ones; the first such name decides. A word that stands alone after a title has the role that it has
    there, else it is a family name. A given name has the gender that titles tell."""
    role: dict[str, str] = {}
    for _, words in names:
        for i, (_, _, w) in enumerate(words):
            if len(words) > 1 and len(w) > 1:
                role.setdefault(w.casefold(), "given" if i < len(words) - 1 else "family")
    kinds: dict[str, str] = {}
    for title, words in names:
        for _, _, w in words:
            x = w.casefold()
            kind = role.get(x, "family")
            if kind == "given":
                kind = f"given:{_GENDER[title]}"
                kind = _one_gender(kind, kinds[x]) if x in kinds else kind
            if len(w) > 1 or len(words) == 1:
                kinds[x] = kind
    return kinds


def _pairs(text: str, persons: dict[str, str]) -> dict[str, str]:
    """Name words that no title introduces: capitals that stand more than once, within sentences, before a known family name
    or after a known given name."""
    seen: dict[tuple[str, str], int] = {}
    last = None
    for m in _NAME_WORD.finditer(text):
        w = _trimmed(m[0])
        if last and w[:1].isupper() and text[last.end() : m.start()] == " ":
            x, y = last[0].casefold(), w.casefold()
            kx, ky = persons.get(x), persons.get(y)
            before = text[max(0, last.start() - 2) : last.start()].rstrip(" ")
            inside = bool(before) and before[-1] not in ".!?:;\n\"'“”«»(-"
            if len(x) > 1 and len(y) > 1 and not {x, y} & CALENDAR and last[0] not in _GENDER and (kx is None and ky == "family" and inside or ky is None and (kx or "").startswith("given:")):
                seen[x, y] = seen.get((x, y), 0) + 1
        last = m if m[0][0].isupper() else None
    more = {}
    for (x, y), n in seen.items():
        if n > 1:
            more |= {x: "given:n"} if x not in persons else {y: "family"}
    return more


class _Taken:
    """Spans without overlaps, by place."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []

    def free(self, s: int, e: int) -> bool:
        i = bisect_left(self.spans, (s, s))
        return not (i < len(self.spans) and self.spans[i][0] < e or i and self.spans[i - 1][1] > s)

    def add(self, spans: list[tuple[int, int]]) -> None:
        self.spans = sorted(self.spans + spans)


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical) in text order, without overlaps; kinds earlier in KINDS win. Each word of a name is an
    entity: given:<gender> or family, the same for all its mentions. Words of names found by a title are found again where
    they stand without one, if they begin like a name and have at least two letters, as are capitals that recur beside them.
    An initial is the given name of the same family name in the text that begins with it, if there is just one."""
    found: list[tuple[int, int, str, str]] = []
    if not text:
        return found
    digits = _DIGIT.search(text) is not None
    taken = _Taken()
    for kind, pattern in PATTERNS.items():
        if kind == "email" and "@" not in text or kind != "email" and not digits:
            continue
        new = [(*m.span(), kind, canonical(kind, m[0])) for m in pattern.finditer(text) if taken.free(*m.span())]
        taken.add([x[:2] for x in new])
        found += new
    names = []
    for m in _TITLES.finditer(text):
        words = [w for w in _name_words(text, m[1], m.end()) if taken.free(w[0], w[1])]
        if words:
            names.append((m[1], words))
    if not names:
        return sorted(found)
    persons = _persons(names)
    full: dict[tuple[str, str], set[str]] = {}
    for _, words in names:
        for _, _, w in words[:-1]:
            if len(w) > 1:
                full.setdefault((w[0].casefold(), words[-1][2].casefold()), set()).add(w.casefold())
    new = {}
    for title, words in names:
        for i, (s, e, w) in enumerate(words):
            x, own = w.casefold(), f"given:{_GENDER[title]}"
            if len(w) == 1 and i < len(words) - 1:
                known = full.get((x, words[-1][2].casefold()), set())
                x = next(iter(known)) if len(known) == 1 else x
                new[s] = (s, e, persons.get(x, own) if len(x) > 1 else own, x)
            else:
                new[s] = (s, e, persons[x], x)
    taken.add([x[:2] for x in new.values()])
    persons |= _pairs(text, persons)
    mentions = []
    for m in _NAME_WORD.finditer(text):
        word = _trimmed(m[0])
        spots = [(m.start(), word)] if word.casefold() in persons else [(m.start() + p.start(), p[0]) for p in _PIECE.finditer(m[0])] if len(word) < len(m[0]) or "-" in word or "'" in word or "’" in word else []
        for s, w in spots:
            x = w.casefold()
            if len(w) > 1 and x in persons and _names_begin(w) and taken.free(s, s + len(w)):
                mentions.append((s, s + len(w), persons[x], x))
    taken.add([x[:2] for x in mentions])
    if run := sorted((w for w in persons if len(w) > 1 and _UNPARTED.match(w)), key=lambda w: (-len(w), w)):
        pattern = re.compile("|".join(map(re.escape, run)), re.I)
        mentions += [(*m.span(), persons[m[0].casefold()], m[0].casefold()) for m in pattern.finditer(text) if taken.free(*m.span())]
    return sorted([*found, *new.values(), *mentions])


def _one_gender(a: str, b: str) -> str:
    """given:m and given:f by what either tells; given:n if neither does, or both differ."""
    told = {a, b} - {"given:n"}
    return told.pop() if len(told) == 1 else "given:n"


class Draw:
    """A keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int) -> None:
        self.key, self.seed, self.block, self.pool = key, f"{kind}\x00{entity}\x00{attempt}".encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.digest(self.key, self.seed + self.block.to_bytes(4, "big"), "sha256")
            self.block += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x * n >> 32


class Cipher:
    """A keyed permutation of 0 to n - 1 without fixed points, if n > 1.

    A Feistel network permutes the numbers of enough bits; walking on until the result is below n makes that a permutation
    of the range. Between it and its inverse the result moves on by a keyed step, so nothing stays where it was.
    """

    ROUNDS = 6

    def __init__(self, key: bytes, tweak: str, n: int) -> None:
        self.key, self.tweak, self.n = hashlib.sha256(key).digest(), tweak.encode("utf-8", "surrogatepass"), n
        self.half = max(1, -(-(n - 1).bit_length() // 2))
        self.mask = (1 << self.half) - 1
        self.step = 1 + self._hash(b"step", n) % (n - 1) if n > 1 else 0

    def _hash(self, label: bytes, x: int) -> int:
        size = x.bit_length() // 8 + 1
        out, need = b"", self.half // 8 + 9
        while len(out) < need:
            out += hashlib.blake2b(self.tweak + b"\0" + label + len(out).to_bytes(4, "big") + x.to_bytes(size, "big"), key=self.key).digest()
        return int.from_bytes(out[:need], "big")

    def _feistel(self, x: int, back: bool) -> int:
        a, b = x >> self.half, x & self.mask
        for r in reversed(range(self.ROUNDS)) if back else range(self.ROUNDS):
            if back:
                a, b = (b ^ self._hash(bytes([r]), a)) & self.mask, a
            else:
                a, b = b, (a ^ self._hash(bytes([r]), b)) & self.mask
        return a << self.half | b

    def _walk(self, x: int, back: bool) -> int:
        while (x := self._feistel(x, back)) >= self.n:
            pass
        return x

    def __call__(self, x: int) -> int:
        return self._walk((self._walk(x, False) + self.step) % self.n, True) if self.n > 1 else x


def luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country) + "00"
    return f"{98 - int(number) % 97:02d}"


def script_of(word: str) -> str | None:
    """The script of a word's first letter, if names of it are composed here."""
    name = unicodedata.name(word[0], "")
    return next((s for s in STEMS if name.startswith(s.upper())), None)


_SIGNS = {"a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0": "0123456789"}


def _shape(text: str) -> str:
    """Letters as 'a' or 'A' and digits as '0'; other signs as they are."""
    return "".join("a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if c.isdigit() else c for c in text)


def _rank(text: str, shape: str) -> tuple[int, int]:
    """Place of a text among all of its shape, and how many there are."""
    at, n = 0, 1
    for c, k in zip(text, shape):
        if signs := _SIGNS.get(k):
            at, n = at * len(signs) + (signs.index(c) if c in signs else int(c)), n * len(signs)
    return at, n


def _unrank(at: int, shape: str) -> str:
    out = []
    for k in reversed(shape):
        if signs := _SIGNS.get(k):
            at, i = divmod(at, len(signs))
            k = signs[i]
        out.append(k)
    return "".join(reversed(out))


@lru_cache(maxsize=4096)
def _cipher(key: bytes, kind: str, space: str, attempt: int, n: int) -> Cipher:
    return Cipher(key, f"{kind}\x00{space}\x00{attempt}", n)


def _permuted(key: bytes, kind: str, space: str, attempt: int, at: int, n: int) -> int:
    return _cipher(key, kind, space, attempt, n)(at)


def _same_shape(key: bytes, kind: str, space: str, attempt: int, text: str) -> str:
    shape = _shape(text)
    at, n = _rank(text, shape)
    return _unrank(_permuted(key, kind, f"{space}\x00{shape}", attempt, at, n), shape)


@lru_cache(maxsize=4096)
def _networks(a: int, b: int) -> tuple[list[tuple[int, int]], dict[tuple[int, int], int]]:
    """The first two numbers of the addresses of the same class, and the place of each: private, loopback and link-local
    ones stay in their range, others outside of all."""
    if (a, b) in ((192, 168), (169, 254)):
        firsts = [(a, b)]
    elif a == 172 and 16 <= b < 32:
        firsts = [(a, x) for x in range(16, 32)]
    elif a in (0, 10, 127) or a >= 224:
        firsts = [(a, x) for x in range(256)]
    else:
        return _public(a >> 6)
    return firsts, {f: i for i, f in enumerate(firsts)}


@lru_cache(maxsize=4)
def _public(quarter: int) -> tuple[list[tuple[int, int]], dict[tuple[int, int], int]]:
    lo, hi = ((1, 128), (1, 128), (128, 192), (192, 224))[quarter]
    closed = {(192, 168), (169, 254), *((172, x) for x in range(16, 32))}
    firsts = [(x, y) for x in range(lo, hi) if x not in (10, 127) for y in range(256) if (x, y) not in closed]
    return firsts, {f: i for i, f in enumerate(firsts)}


def _ip(key: bytes, entity: str, attempt: int) -> str:
    """An address of the same class."""
    a, b, c, d = (int(x) for x in entity.split("."))
    firsts, place = _networks(a, b)
    got = _permuted(key, "ip", f"{firsts[0]}", attempt, place[a, b] << 16 | c << 8 | d, len(firsts) << 16)
    return ".".join(map(str, (*firsts[got >> 16], got >> 8 & 255, got & 255)))


@lru_cache(maxsize=4096)
def _letters_like(c: str) -> str | range:
    """Code points to draw a letter from: the ideographs or syllables of Han and Hangul, else the letters of its block."""
    n = ord(c)
    for lo, hi in ((0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0x3400, 0x4DB6)):
        if lo <= n < hi:
            return range(lo, hi)
    block = n & ~0x7F
    script = unicodedata.name(c, "").split(" ")[0]
    return "".join(x for x in map(chr, range(block, block + 128)) if x.isalpha() and x.lower() == x and unicodedata.category(x) in ("Lo", "Ll") and unicodedata.name(x, "").startswith(script)) or c


@lru_cache(maxsize=65_536)
def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The canonical surrogate of a canonical entity."""
    if kind == "email":
        name, _, suffix = entity.rpartition(".")
        return f"{_same_shape(key, kind, suffix, attempt, name)}.{suffix}"
    if kind == "card":
        head, middle, last = entity[0], entity[1:-1], int(entity[-1])
        right = int(luhn_digit(entity[:-1]))
        if right == last:
            made = head + _same_shape(key, kind, f"valid{head}", attempt, middle)
            return made + luhn_digit(made)
        got = _permuted(key, kind, f"other{head}{len(middle)}", attempt, int(middle) * 9 + (last - right - 1) % 10, 9 * 10 ** len(middle))
        made = head + str(got // 9).zfill(len(middle))
        return made + str((int(luhn_digit(made)) + 1 + got % 9) % 10)
    if kind in ("phone", "ssn"):
        keep = 1 if kind == "phone" and len(entity) > 10 else 0
        return entity[:keep] + _same_shape(key, kind, entity[:keep], attempt, entity[keep:])
    if kind == "ip":
        return _ip(key, entity, attempt)
    if kind == "iban":
        country, check, rest = entity[:2], int(entity[2:4]), entity[4:]
        shape, right = _shape(rest), int(iban_check(country, rest))
        at, n = _rank(rest, shape)
        if right == check:
            made = _unrank(_permuted(key, kind, f"{country}valid{shape}", attempt, at, n), shape)
            return f"{country}{iban_check(country, made)}{made}"
        got = _permuted(key, kind, f"{country}other{shape}", attempt, at * 99 + (check - right - 1) % 100, n * 99)
        made = _unrank(got // 99, shape)
        return f"{country}{(int(iban_check(country, made)) + 1 + got % 99) % 100:02d}{made}"
    kind, _, gender = kind.partition(":")
    draw, script = Draw(key, kind, entity, attempt), script_of(entity)
    if script is None:
        letters = [_letters_like(c) if c.isalpha() else c for c in entity]
        letters += [_letters_like(entity[0])] * (attempt // 4)
        return "".join(x if isinstance(x, str) and len(x) == 1 else chr(x[draw.below(len(x))]) if isinstance(x, range) else x[draw.below(len(x))] for x in letters)
    stems = STEMS[script]
    name = "".join(stems[draw.below(len(stems))] for _ in range(1 + draw.below(2) + attempt // 4))
    ends = ENDS[script, gender or kind]
    return name + ends[draw.below(len(ends))]


def like(original: str, kind: str, value: str) -> str:
    """A canonical surrogate written as the original is: separators, case and length of groups."""
    if kind in ("phone", "card", "ssn", "iban"):
        chars = iter(value)
        return "".join(next(chars, "") if c.isalnum() else c for c in original)
    if kind == "email" or kind == "ip":
        return "".join(v.upper() if o.isupper() else v for o, v in zip(original, value)) + value[len(original) :] if kind == "email" else value
    if len(original) == 1 and len(value) > 1 and script_of(original):  # an initial stays one letter, and another one
        first = value[0].upper() if value[0].upper() != original.upper() else value[1].upper()
        return first if original.isupper() else first.lower()
    if original.isupper() and len(original) > 1:
        return value.upper()
    return value[0].upper() + value[1:] if original[:1].isupper() else value


def _replaced(text: str, key: bytes, settled: dict[tuple[str, str], tuple[str, int]]) -> tuple[str, list[str]]:
    out, at, kinds = [], 0, []
    for s, e, kind, entity in detect(text):
        own, attempt = settled.get((kind.partition(":")[0], entity), (kind, 0))
        out += [text[at:s], like(text[s:e], own, surrogate(key, own, entity, attempt))]
        kinds.append(kind)
        at = e
    return "".join([*out, text[at:]]), kinds


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, entity: the distinct entities of all texts, given names by the gender that their document tells."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {x[2:] for _, texts in texts_of(b.column(0)) for t in texts for x in detect(t)}
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in seen], pa.string()), pa.array([x[1] for x in seen], pa.string())], ["kind", "entity"])

    return map_arrow(docs.select(text_col), run, "kind string, entity string").distinct()


def settled_entities(found: DataFrame, key: bytes) -> DataFrame:
    """base, entity, kind, attempt of the entities that a document alone does not settle.

    Those are given names of which documents tell different genders (kind is then the one of the corpus: the only gender
    told, or n) and entities whose first surrogate is a real entity of the corpus or, for names, another's surrogate. Of
    names with one surrogate the smallest keeps it. Further attempts avoid real entities, all first surrogates and each
    other; names grow longer with the attempts, so they end; addresses and numbers stop after ATTEMPTS.
    """

    def run(batches):
        for b in batches:
            values = [surrogate(key, k, e, a) for k, e, a in zip(*(b.column(c).to_pylist() for c in ("kind", "entity", "attempt")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.string())], ["base", "entity", "kind", "mixed", "attempt", "value"])

    fields = "base string, entity string, kind string, mixed boolean, attempt int"
    tasks = found.sparkSession.sparkContext.defaultParallelism  # entities are short and surrogates dear, so sizes say little
    named = lambda todo: stored(map_arrow(todo.select("base", "entity", "kind", "mixed", "attempt").repartition(tasks, "entity"), run, f"{fields}, value string"), "surrogates")
    base = F.substring_index("kind", ":", 1)
    told = F.array_remove(F.collect_set("kind"), "given:n")
    real = found.groupBy(base.alias("base"), "entity").agg(F.when(F.size(told) == 1, told[0]).otherwise(F.min("kind")).alias("kind"), (F.size(told) > 1).alias("both"), (F.count(F.lit(1)) > 1).alias("mixed"))
    real = real.withColumn("kind", F.when(F.col("both"), "given:n").otherwise(F.col("kind"))).drop("both")
    first = named(real.withColumn("attempt", F.lit(0)))
    is_name = F.col("base").isin("given", "family")
    taken = first.select("base", F.col("entity").alias("value")).union(first.select("base", "value"))
    real_values = first.select("base", F.col("entity").alias("value"))
    winners = first.groupBy("base", "value").agg(F.min("entity").alias("winner")).join(real_values, ["base", "value"], "left_anti")
    judged = stored(first.join(winners, ["base", "value"], "left").withColumn("ok", F.col("winner").eqNullSafe(F.col("entity"))), "judged")
    done = judged.where("ok and mixed").select("base", "entity", "kind", "attempt")
    todo, round_no = judged.where("not ok"), 0
    while not todo.isEmpty():
        round_no += 1
        if round_no > ATTEMPTS:  # their first surrogates are their own: no other entity of their format has them
            done = done.union(todo.where(~is_name & F.col("mixed")).select("base", "entity", "kind", F.lit(0).alias("attempt")))
            todo = todo.where(is_name)
            if todo.isEmpty():
                break
        tried = named(todo.withColumn("attempt", F.lit(round_no)))
        free = tried.groupBy("base", "value").agg(F.min("entity").alias("winner")).join(taken, ["base", "value"], "left_anti")
        judged = stored(tried.join(free, ["base", "value"], "left").withColumn("ok", F.col("winner").eqNullSafe(F.col("entity"))), "judged")
        done = done.union(judged.where("ok").select("base", "entity", "kind", "attempt"))
        taken = taken.union(judged.where("ok").select("base", "value"))
        todo = judged.where("not ok")
    return done


def with_surrogates(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None, kinds_col: str | None = None, max_attempts: int = 50_000) -> DataFrame:
    """docs with every entity of text_col replaced; count_col and kinds_col add how many and of which kinds.

    Null texts stay null and empty ones empty; rows that repeat have equal results; an empty table gives none; texts are
    read whole; other columns stay as they are, whatever their names or values. If more than max_attempts entities are
    not settled by their documents, what settles them is joined to the texts that mention them, instead of being sent to
    every task.
    """
    needed = stored(settled_entities(entities(docs, text_col), key), "settled")
    few = needed.count() <= max_attempts
    table = {(r["base"], r["entity"]): (r["kind"], r["attempt"]) for r in needed.collect()} if few else {}
    extra, = fresh(docs, "_settled")
    source = docs if few else _joined(docs, needed, text_col, extra)
    names, at = list(docs.columns), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            own = [None] * b.num_rows if few else b.column(len(names)).to_pylist()
            texts, counts, kinds = [], [], []
            for lo, ts in texts_of(b.column(at)):
                for i, t in enumerate(ts, lo):
                    known = table if few else {(x["base"], x["entity"]): (x["kind"], x["attempt"]) for x in own[i] or []}
                    t, k = (t, []) if not t else _replaced(t, key, known)
                    texts.append(t)
                    counts.append(len(k))
                    kinds.append(",".join(sorted(set(k))))
            columns = [pa.array(texts, b.column(at).type) if i == at else b.column(i) for i in range(len(names))]
            more = [(count_col, pa.array(counts, pa.int64())), (kinds_col, pa.array(kinds, pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, *[c for n, c in more if n]], [*names, *[n for n, _ in more if n]])

    fields = docs.schema.fields + [StructField(n, t) for n, t in ((count_col, LongType()), (kinds_col, StringType())) if n]
    return map_arrow(source, run, StructType(fields))


def _joined(docs: DataFrame, needed: DataFrame, text_col: str, extra: str) -> DataFrame:
    """docs with the settled entities of each text, found by the text's hash: a list is as long as one text can make it."""
    mark, = fresh(docs, "_mark")
    marked = docs.withColumn(mark, F.xxhash64(text_col))

    def run(batches):
        for b in batches:
            rows = [(i, x[2].partition(":")[0], x[3]) for lo, texts in texts_of(b.column(1)) for i, t in enumerate(texts, lo) for x in dict.fromkeys(detect(t))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], [mark, "base", "entity"])

    mentions = map_arrow(marked.select(mark, text_col), run, f"{mark} long, base string, entity string").distinct()
    lists = mentions.join(needed, ["base", "entity"]).groupBy(mark).agg(F.collect_list(F.struct("base", "entity", "kind", "attempt")).alias(extra))
    return marked.join(lists, mark, "left").select(*docs.columns, extra)
