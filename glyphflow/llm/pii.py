"""Personal data, plain or disguised, with places in the source text.

The plain kinds are found in the text itself.  Where the text shows a sign of
disguise, a chain of transducers rewrites it - look-alike characters, spelled
digits, at/dot disguises - and keeps for every character of the result where it
comes from; what is then found is mapped back to the source and added.  Nothing
is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

KINDS = ("email", "ip", "card", "phone")

# A digit run is entered at its start only: a pattern that fails there fails further on, too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")

#: Texts that can hold a kind at all; these run in Arrow.
_MAY = {"email": r"@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches; every @ is looked at once, so long runs without one cost nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def find_plain(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every plain match, by start and kind."""
    out = []
    if "email" in kinds:
        out += [(a, 0, b) for a, b in emails(text)]
    if "ip" in kinds:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    if "card" in kinds:
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "phone" in kinds:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


# Letters of other alphabets that look like Latin ones.
_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеіјорсухѕԁԛԝһ", "ABESIJKMHOPCTYXaeijopcyxsdqwh", strict=True))
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονραικτυχ", "ABEZHIKMNOPTYXovpaiktux", strict=True))
# Digits in words, in English, German, French and Spanish.
_SPELLED = {
    word: str(digit)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for digit, word in enumerate(words.split())
} | {"oh": "0"}
_WORDS = "|".join(sorted(_SPELLED, key=lambda w: (-len(w), w)))
_AT, _DOT, _OPEN, _CLOSE = "at|arroba|arobase|ät", "dot|punkt|punto|point", r"[\[({<]", r"[\])}>]"
_LOOK = r"[\x{00AD}\x{0370}-\x{03FF}\x{0400}-\x{052F}\x{0660}-\x{0669}\x{06F0}-\x{06F9}\x{0966}-\x{096F}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{FF01}-\x{FF5E}]"
# White space as Python's \s has it, and what may stand between digits.
_SPACE, _BETWEEN = r"[\s\v\x{1C}-\x{1F}\x{85}\p{Z}]", r"[\s\v\x{1C}-\x{1F}\x{85}\p{Z},.()-]"
#: Signs of disguise, for Arrow: a necessary condition of each transducer.
_SIGNS = (
    rf"{_LOOK}|(?i:{_OPEN}{_SPACE}*(?:{_AT}|@|{_DOT}|\.){_SPACE}*{_CLOSE}|{_SPACE}(?:{_DOT}){_SPACE}"
    rf"|{_SPACE}(?:{_AT}){_SPACE}+[A-Z0-9-]+\.[A-Z0-9]|(?:{_WORDS}){_BETWEEN}+(?:{_WORDS}|\pN)|\pN{_BETWEEN}+(?:{_WORDS}))"
)


def _look_alikes() -> dict[int, str]:
    table = {ord(a): b for a, b in (_CYRILLIC | _GREEK).items()}
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    table |= dict.fromkeys([0xAD, *range(0x200B, 0x200E), 0x2060, 0xFEFF], "")
    for first in (0x660, 0x6F0, 0x966):
        table |= {first + k: str(unicodedata.digit(chr(first + k))) for k in range(10)}
    return table


_TABLE = _look_alikes()
_ALIKE = re.compile("[" + "".join(map(chr, sorted(_TABLE))) + "]")
# Runs of white space are entered at their start only and never given back, so a long one costs its length.
_BRACKETED = re.compile(rf"{_OPEN}\s*+(?:(?P<at>{_AT}|@)|{_DOT}|\.)\s*+{_CLOSE}\s*+", re.IGNORECASE)
_NAME = r"[A-Za-z0-9_%+-]{1,64}"
_LINK = rf"(?:\.|\s++(?:{_DOT})\s++)"
_WORDY = re.compile(rf"(?<![A-Za-z0-9_%+-]){_NAME}(?:{_LINK}{_NAME}){{0,8}}(?:\s++(?P<at>{_AT})\s++|@)[A-Za-z0-9-]{{1,63}}(?:{_LINK}[A-Za-z0-9-]{{1,63}}){{0,8}}{_LINK}[A-Za-z]{{2,24}}\b", re.IGNORECASE)
_INSIDE = re.compile(rf"(?<!\s)\s++(?:(?P<at>{_AT})|{_DOT})\s++", re.IGNORECASE)
_OCTET = rf"(?:[0-9]{{1,3}}|(?:{_WORDS}|[0-9])(?:[\s,-]++(?:{_WORDS}|[0-9])){{0,2}})"
_DOTTED = re.compile(rf"(?<![\w.]){_OCTET}(?:{_LINK}{_OCTET}){{3}}\b", re.IGNORECASE)
_NUMBER = re.compile(rf"(?:\bplus[\s,.()-]++)?\b(?:{_WORDS}|[0-9]++)(?:[\s,.()-]++(?:{_WORDS}|[0-9]++))+\b", re.IGNORECASE)
_DIGIT = re.compile(rf"(?P<plus>plus)|(?P<dot>{_LINK})|(?P<word>{_WORDS})|[0-9]", re.IGNORECASE)

Edit = tuple[int, int, str]


class Source:
    """A rewritten text that knows for each of its characters where in the source it begins and ends."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text), dtype=np.int32)
        self.ends = self.starts + 1

    def rewrite(self, edits: list[Edit]) -> None:
        """Put (start, end, replacement) in place; edits are in order and do not overlap."""
        if not edits:
            return
        text, at = [], 0
        # Each character's copies: 0 for those that an edit takes away, the replacement's length for an edit's first.
        copies = np.ones(len(self.text), np.int32)
        ends = self.ends.copy()
        for a, b, new in edits:
            text += [self.text[at:a], new]
            copies[a:b] = 0
            copies[a], ends[a] = len(new), self.ends[b - 1]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = np.repeat(self.starts, copies), np.repeat(ends, copies)


def look_alikes(text: str) -> list[Edit]:
    return [(m.start(), m.end(), _TABLE[ord(m[0])]) for m in _ALIKE.finditer(text)]


def bracketed(text: str) -> list[Edit]:
    """Brackets around at or dot, with the white space on both sides."""
    out: list[Edit] = []
    for m in _BRACKETED.finditer(text):
        a, least = m.start(), out[-1][1] if out else 0
        while a > least and text[a - 1].isspace():
            a -= 1
        out.append((a, m.end(), "@" if m["at"] else "."))
    return out


def wordy(text: str) -> list[Edit]:
    """name at host dot domain, where all of it is there; any of its signs may be plain."""
    if not _INSIDE.search(text):
        return []
    return [(m.start() + i.start(), m.start() + i.end(), "@" if i["at"] else ".") for m in _WORDY.finditer(text) for i in _INSIDE.finditer(m[0])]


def _digits(m: re.Match, found: list[re.Match]) -> list[Edit]:
    """Each sign of a match becomes its character, what is between them goes."""
    out = []
    for d, follows in zip(found, [*found[1:], None], strict=True):
        a, b = m.start() + d.start(), m.start() + d.end()
        out.append((a, b, "+" if d["plus"] else "." if d["dot"] else _SPELLED[d["word"].lower()] if d["word"] else d[0]))
        if follows is not None and follows.start() > d.end():
            out.append((b, m.start() + follows.start(), ""))
    return out


def dotted(text: str) -> list[Edit]:
    """Four numbers with dots between them, of which some dots are words."""
    if not _INSIDE.search(text):
        return []
    return [e for m in _DOTTED.finditer(text) if _INSIDE.search(m[0]) for e in _digits(m, list(_DIGIT.finditer(m[0])))]


def spelled(text: str) -> list[Edit]:
    """Seven or more digits, alone or in groups, of which some are words."""
    out = []
    for m in _NUMBER.finditer(text):
        found = [d for d in _DIGIT.finditer(m[0]) if not d["dot"]]
        if any(d["word"] for d in found) and sum(not d["plus"] for d in found) >= 7:
            out += _digits(m, found)
    return out


TRANSDUCERS: tuple[Callable[[str], list[Edit]], ...] = (look_alikes, bracketed, wordy, dotted, spelled)


def find_disguised(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the rewritten text holds, in places of the source, less what lies within a plain match of its kind."""
    source = Source(text)
    for transducer in TRANSDUCERS:
        source.rewrite(transducer(source.text))
    if source.text == text:
        return []
    out = []
    taken = [[(c, d) for c, k, d in plain if k == kind] for kind in range(len(KINDS))]
    for a, kind, b in find_plain(source.text):
        a, b = int(source.starts[a]), int(source.ends[b - 1])
        at = bisect_right(taken[kind], (a, len(text) + 1)) - 1
        if at < 0 or taken[kind][at][1] < b:  # plain matches of a kind do not overlap
            out.append((a, kind, b))
    return out


def find_personal_data(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: the key and spans, array<struct<start, kind, end, plain>>, sorted.

    start and end (exclusive) are in code points of the source text, kind is the
    number of the kind in KINDS, plain tells a match in the text as it stands
    from one that deobfuscation added.  A null or empty text has no spans.
    Whole texts are searched; repeated rows are searched each.
    """
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())])

    @tidy
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1)
                may = {k: pc.match_substring_regex(texts, p).to_pylist() for k, p in _MAY.items()}
                signs = pc.match_substring_regex(texts, _SIGNS).to_pylist()
                out: list[list] = [[]] * part.num_rows
                for i in range(part.num_rows):
                    kinds = tuple(k for k in KINDS if may[k][i])
                    if not kinds and not signs[i]:
                        continue
                    own = texts[i].as_py()
                    plain = find_plain(own, kinds)
                    spans = [(a, k, b, True) for a, k, b in plain]
                    if signs[i]:
                        spans = sorted(spans + [(a, k, b, False) for a, k, b in find_disguised(own, plain)])
                    out[i] = [dict(zip(("start", "kind", "end", "plain"), s, strict=True)) for s in spans]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(kind))], ["k", "spans"])

    schema = f"k {dict(rows.dtypes)['k']}, spans array<struct<start:int,kind:int,end:int,plain:boolean>>"
    return rows.mapInArrow(find, schema).withColumnRenamed("k", key)


def spans_text(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def personal_data_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_email, n_ip, n_card, n_phone (plain ones), base_sha256 of the plain spans, spans (all), n_added, n_spans (all).

    A null or empty text has none; see ``find_personal_data``.
    """
    found = find_personal_data(df, key, text)
    plain = F.filter("spans", lambda s: s["plain"])
    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["plain"] & (s["kind"] == kind))).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    added = F.size(F.filter("spans", lambda s: ~s["plain"])).cast("long").alias("n_added")
    return found.select(key, *counts, F.sha2(spans_text(plain), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), added, F.size("spans").cast("long").alias("n_spans"))
