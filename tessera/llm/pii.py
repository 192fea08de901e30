"""Personal data: addresses of mail and machines, card and phone numbers, in plain and in disguise.

Plain identifiers are found by four patterns with their checks (parts of machine addresses, Luhn's sum, digits of a
phone number).  Disguised ones pass two transducers that keep, for every character they write, the span of the source
it came from.  The first works on characters: look-alikes of other scripts, full-width and other compatibility forms,
digits of any script, dashes and spaces become ASCII, invisible characters vanish.  The second works on tokens: at and
dot in brackets, as words or as entities, spelled digits in four languages (double and triple too), plus as a word, and
letters that stand for digits.  The same four patterns then read what came out, and spans are mapped back.

An added span stands only where something was rewritten, between characters that are no letters or digits, and apart
from plain spans of its kind, which always stay.  A mail address needs a last label of letters; where "at" is a bare
word or a sign between spaces, a dot of its host must be in disguise too or its local part must look like one (a digit
or one of ._%+-), so "look at example.com" is left alone.  Fewer than three spelled digits in a row are read as digits
only beside a dot or a plus.  Numbers above nine (twenty) are not digits.

Null texts are empty; offsets count code points, ends are exclusive.  Texts of any length are read whole, in time in
proportion to their length.  Repeated rows are rows of their own, spans come by start, then kind; an empty table gives
no rows.  Kept columns may have any names; one with the name of an output column gives way to it.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import scored

KINDS = ("email", "ip", "card", "phone")
#: A run of local characters is read once, with the host if one follows.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile("[^0-9]+")
DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  # start, end, index of the kind


def luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def plain(text: str) -> list[Span]:
    """The spans of the four patterns, leftmost and non-overlapping within each kind, by start and kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(*m.span(), 0) for m in EMAIL.finditer(text) if m.group(1)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m.group().split(".")):
                out.append((*m.span(), 1))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := NO_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= len(NO_DIGIT.sub("", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


#: Letters that look like the ASCII letter below them.
LIKE = "аеорсухіјѕԁһԛԝАВЕКМНОРСТХУІЈЅαονριυΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡ"
ASCII = "aeopcyxijsdhqwabekmhopctxyijsaovpiuabezhikmnoptyxiag"
OTHER = {"·": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-"}
#: Names of the digits in English, French, German and Spanish.
NAMES = (
    ("zero", "oh", "zéro", "null", "cero"), ("one", "un", "eins", "uno"), ("two", "deux", "zwei", "dos"), ("three", "trois", "drei", "tres"),
    ("four", "quatre", "vier", "cuatro"), ("five", "cinq", "fünf", "cinco"), ("six", "sechs", "seis"), ("seven", "sept", "sieben", "siete"),
    ("eight", "huit", "acht", "ocho"), ("nine", "neuf", "neun", "nueve"),
)
VALUE = {name: str(d) for d, names in enumerate(NAMES) for name in names}
TIMES = {"double": 2, "triple": 3}
SWAPPED = str.maketrans("oli|sb", "011158")

NAME = "|".join(sorted(VALUE, key=len, reverse=True))
ONE = rf"(?:(?:double|triple)\s)?(?:{NAME})(?!\w)"
AT = "at|arroba|arobase"
DOT = "dot|punto|point|punkt"
OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
CORE = re.compile(
    rf"(?P<boxed_at>{OPEN}\s{{0,3}}(?:{AT}|@)\s{{0,3}}{CLOSE})|(?P<boxed_dot>{OPEN}\s{{0,3}}(?:{DOT}|\.)\s{{0,3}}{CLOSE})"
    r"|(?P<coded_at>&#64;|&#x40;|&commat;|%40)|(?P<coded_dot>&#46;|&#x2e;|&period;|%2e)|(?P<sign>@)"
    rf"|(?<!\w)(?:(?P<at>{AT})(?!\w)|(?P<dot>{DOT})(?!\w)|(?P<plus>plus)(?!\w)|(?P<digits>{ONE}(?:[\s,/-]{{1,3}}{ONE})*+))"
    r"|(?<![a-z0-9])(?P<swapped>[0-9]++[oli|sb][0-9oli|sb]*+|[oli|sb][oli|sb]?[0-9][0-9oli|sb]*+)(?![a-z0-9])"
)
PART = {"digits": re.compile(rf"(?:(double|triple)\s)?({NAME})")}
HOST = re.compile(rf"[a-z0-9-]{{1,63}}(?:(?:\.|\s{{0,3}}{OPEN}\s{{0,3}}(?:{DOT}|\.)\s{{0,3}}{CLOSE}\s{{0,3}}|\s{{1,3}}(?:{DOT})\s{{1,3}})[a-z0-9-]{{1,63}}){{1,126}}")
LEFT_DOT = re.compile(rf"(?:(?<!\w)(?:{DOT}|plus)|[.+]|{CLOSE})\s{{0,3}}\Z")
RIGHT_DOT = re.compile(rf"\s{{0,3}}(?:(?:{DOT})(?!\w)|\.[0-9a-z]|{OPEN})")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: How sure a rewritten character is: as it was; another form of itself; a bare word or a sign between spaces.
SAME, SURE, BARE = 0, 1, 2


@cache
def alphabet() -> tuple[np.ndarray, dict[int, str]]:
    """For every code point what the first transducer writes for it (-1: itself, -2: more than one character)."""
    to = np.arange(sys.maxunicode + 1, dtype=np.int32)
    longer: dict[int, str] = {}
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if i < 128 or 0xD800 <= i < 0xE000:
            to[i] = ord(c.lower()) if i < 128 else i
            continue
        category = unicodedata.category(c)
        new = OTHER.get(c) or (str(unicodedata.decimal(c)) if category == "Nd" else "" if category == "Cf" else unicodedata.normalize("NFKC", c))
        if new != c and (not new or re.fullmatch(r"[ 0-9A-Za-z@.+()-]{1,3}", new) and new != "..."):
            to[i] = ord(new.lower()) if len(new) == 1 else -1
            if len(new) != 1:
                longer[i] = new.lower()
        elif 0xC0 <= i < 0xDF and i != 0xD7:
            to[i] = i + 32
    for c, new in zip(LIKE, ASCII, strict=True):
        to[ord(c)] = ord(new)
    return to, longer


WORD = re.compile(r"\w+")
CODE = {**dict.fromkeys(VALUE, "n"), **dict.fromkeys(TIMES, "n"), **dict.fromkeys(AT.split("|"), "a"), **dict.fromkeys(DOT.split("|"), "d"), "plus": "p"}
BOXED = re.compile(rf"{OPEN}\s{{0,3}}(?:{AT}|{DOT}|@|\.)\s{{0,3}}{CLOSE}")
BARE_SIGN = re.compile(r"\s@|@\s")
BARE_AT = re.compile(rf"(?:{AT})\s{{1,3}}[a-z0-9-]{{1,63}}(?:\.[a-z0-9-]|\s{{0,3}}{OPEN}|\s{{1,3}}(?:{DOT}))")
SWAP = re.compile(r"[0-9](?:[oli|sb]|(?<=[oli|sb].))")


def suspicious(text: str) -> bool:
    """Whether the second transducer could rewrite a lower-case text so that an identifier shows: a quick look at its words and signs."""
    sign, digit = "@" in text, bool(DIGIT.search(text))
    if BOXED.search(text) or "&" in text and re.search("&#64;|&#x40;|&commat;|&#46;|&#x2e;|&period;", text) or "%40" in text or "%2e" in text:
        return True
    if sign and BARE_SIGN.search(text) or digit and SWAP.search(text):
        return True
    words = "".join(map(CODE.get, WORD.findall(text), repeat(".")))
    if "nnn" in words or digit and ("n" in words or "p" in words or "d" in words) or sign and "d" in words:
        return True
    return "a" in words and bool(BARE_AT.search(text)) or bool(re.search("n+[dp]|[dp]n", words))


class Tape:
    """A text with, for every character, its span in the source and how it came to be."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, made: np.ndarray):
        self.text, self.start, self.end, self.made = text, start, end, made

    @classmethod
    def of(cls, text: str) -> Tape | None:
        """What the first transducer writes for a text; None if there is nothing that the second one could rewrite either."""
        if text.isascii():
            if not suspicious(low := text.lower()):
                return None
            at = np.arange(len(text) + 1)
            return cls(low, at[:-1], at[1:], np.zeros(len(text), np.int8))
        to, longer = alphabet()
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        new = to[codes]
        made = ((new < 0x80) & (codes >= 0x80)).astype(np.int8)  # lower case alone is no disguise
        if not made.any() and not suspicious(low := new.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")):
            return None
        at = np.arange(len(text) + 1)
        start, end = at[:-1], at[1:]
        if (new < 0).any():
            size = np.ones(len(new), np.int64)
            odd = np.flatnonzero(new < 0)
            texts = [longer[c] for c in codes[odd].tolist()]
            size[odd] = list(map(len, texts))
            first = np.cumsum(size) - size
            new, made, start, end = (np.repeat(x, size) for x in (new, made, start, end))
            for i, x in zip(first[odd].tolist(), texts, strict=True):
                new[i : i + len(x)] = list(map(ord, x))
            for i in odd.tolist():  # what stood beside an invisible character is in disguise
                made[max(0, first[i] - 1) : first[i] + size[i] + 1] = np.maximum(made[max(0, first[i] - 1) : first[i] + size[i] + 1], SURE)
        return cls(new.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass"), start, end, made)

    def rewritten(self, edits: list[tuple[int, int, str, int]]) -> Tape:
        """With each span of the edits replaced by characters that all stand for it."""
        texts, parts, at = [], [], 0
        for a, b, new, made in [*edits, (len(self.text), len(self.text), "", SAME)]:
            texts += [self.text[at:a], new]
            parts.append((self.start[at:a], self.end[at:a], self.made[at:a]))
            if new:
                n = len(new)
                parts.append((np.full(n, self.start[a]), np.full(n, self.end[b - 1]), np.full(n, made, np.int8)))
            at = b
        return Tape("".join(texts), *(np.concatenate([p[i] for p in parts]) for i in range(3)))


def blanks(text: str, at: int, step: int) -> int:
    """The end of at most three blanks from `at` on, to the left (step -1) or right."""
    n = 0
    while n < 3 and 0 <= (i := at + n * step - (step < 0)) < len(text) and text[i].isspace():
        n += 1
    return at + n * step


def disguises(text: str) -> Iterator[tuple[int, int, str, int]]:
    """The edits of the second transducer: spans of text and what to write for them."""
    done = 0
    for m in CORE.finditer(text):
        kind, (a, b) = m.lastgroup, m.span()
        left, right = blanks(text, a, -1), blanks(text, b, 1)
        if left < done:
            left = a
        if a < done:
            continue
        before, behind = text[left - 1 : left], text[right : right + 1]
        if kind in ("boxed_at", "coded_at"):
            edit = left, right, "@", SURE
        elif kind in ("boxed_dot", "coded_dot"):
            edit = left, right, ".", SURE
        elif kind in ("at", "sign"):
            spaced = left < a and right > b if kind == "at" else left < a or right > b
            if not (spaced and before in LOCAL and HOST.match(text, right)):
                continue
            edit = left, right, "@", BARE
        elif kind == "dot":
            if not (left < a and right > b and before.isalnum() and behind.isalnum()):
                continue
            edit = left, right, ".", SURE
        elif kind == "plus":
            if not (right > b and (behind.isdigit() or PART["digits"].match(text, right))):
                continue
            edit = a, right, "+", SURE
        elif kind == "swapped":
            edit = a, b, m.group().translate(SWAPPED), SURE
        else:
            words = list(PART["digits"].finditer(text, a, b))
            if sum(TIMES.get(w.group(1), 1) for w in words) < 3 and not (LEFT_DOT.search(text, max(0, a - 12), a) or RIGHT_DOT.match(text, b)):
                continue
            for k, w in enumerate(words):  # what stands between two spelled digits goes with the second
                yield words[k - 1].end() if k else a, w.end(), VALUE[w.group(2)] * TIMES.get(w.group(1), 1), SURE
            done = b
            continue
        yield edit
        done = edit[1]


def hidden(text: str, known: list[Span]) -> list[Span]:
    """Spans of the source that only show once it is rewritten, apart from known ones of their kind."""
    if not (tape := Tape.of(text)):
        return []
    edits = list(disguises(tape.text))
    tape = tape.rewritten(edits) if edits else tape
    marks = np.concatenate([[0], np.cumsum(tape.made > 0)])
    taken = [[s for s in known if s[2] == k] for k in range(len(KINDS))]
    out = []
    for a, b, k in plain(tape.text):
        if marks[a] == marks[b] or tape.text[a - 1 : a].isalnum() and a or tape.text[b : b + 1].isalnum():
            continue
        if k == 0 and not likely(tape, a, b):
            continue
        start, end = int(tape.start[a]), int(tape.end[b - 1])
        near = bisect_left(taken[k], (end,))  # the first known span that begins at the end or later
        if near and taken[k][near - 1][1] > start:
            continue
        out.append((start, end, k))
    return out


def likely(tape: Tape, a: int, b: int) -> bool:
    local, host = (text := tape.text[a:b]).split("@")
    last = host.rpartition(".")[2]
    if not (len(last) >= 2 and last.isalpha()):
        return False
    at = a + len(local)
    if tape.made[at] != BARE:
        return True
    dots = [at + 1 + i for i, c in enumerate(text[len(local) + 1 :]) if c == "."]
    return any(tape.made[i] for i in dots) or any(c in "0123456789._%+-" for c in local)


def spans(text: str) -> list[tuple[Span, bool]]:
    """All spans of a text by start and kind, with True for plain ones."""
    known = plain(text)
    return sorted([*((s, True) for s in known), *((s, False) for s in hidden(text, known))], key=lambda x: (x[0][0], x[0][2], x[0][1]))


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def detect(docs: DataFrame, *keep: str, text_column: str = "text") -> DataFrame:
    """The columns of `keep`, with spans: an array of kind, start, end and base (plain)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def judge() -> Callable[[pa.Array], list]:
        def of(texts: pa.Array) -> list:
            found = ([{"kind": KINDS[k], "start": a, "end": b, "base": base} for (a, b, k), base in spans(t.as_py() or "")] for t in texts)
            return [pa.array(found, kind)]

        return of

    return scored(docs, keep, text_column, f"spans {SPANS}", judge)


def redact(docs: DataFrame, *keep: str, text_column: str = "text") -> DataFrame:
    """The columns of `keep`, with redacted: the text with every span, or overlapping spans, replaced by [KIND] of the first."""

    def redacted(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for (a, b, k), _ in spans(text):
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def judge() -> Callable[[pa.Array], list]:
        return lambda texts: [pa.array([redacted(t.as_py()) for t in texts], pa.string())]

    return scored(docs, keep, text_column, "redacted string", judge)


def digest(found: DataFrame, *keep: str) -> DataFrame:
    """Counts of plain spans by kind, a checksum of them, all spans as text, and how many were added."""

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select(*keep, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added)
