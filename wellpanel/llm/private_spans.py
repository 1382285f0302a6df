"""Personal data in disguise: text is normalised by transducers, identifiers are detected, spans are mapped back.

Three transducers run one after the other, each keeping where its output came from:

1. homoglyphs: look-alike letters, digits, dots, dashes and spaces become ASCII, invisible characters go, letters
   that stand for digits inside numbers become digits;
2. spelled digits: runs of digit words ("four one one") and disguised dots between numbers;
3. addresses: disguised at and dot signs ("[at]", " at ", "(dot)", " dot ") around a name and a host.

The detectors are those of plain text.  A span found only after normalisation is added under the source characters it
came from; spans of the plain text stay as they are.  Everything works on whole texts in linear time: a text without
digit, @ or disguise is passed over by one regular expression a batch, run on Arrow's side.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellpanel.llm.storage import table

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind string, start int, end int, base boolean>>"

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Look-alikes beyond those that Unicode itself calls compatible (first line: as written, second: as read).
LOOK = "аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅοιναρκΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡɑօո·∙⋅․。｡・−"
READ = "aeopcyxijshdqwABEKMHOPCTYXIJSoivapkABEZHIKMNOPTYXigaon.......-"
INVISIBLE = "­᠎​-‏⁠-⁤︀-️﻿"

# Digit words from zero to nine, and the words for signs.
SPELLED = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
DIGIT = {word: str(k) for words in SPELLED.values() for k, word in enumerate(words.split())}
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at|arroba|arobase", "dot|punkt|point|punto", "plus|más"
#: Words that follow "at" in prose, so that "at the dot com" is no address.
ARTICLES = frozenset("a an the this that these those every each".split())

WORD = "(?:" + "|".join(sorted(DIGIT, key=len, reverse=True)) + ")"
DOT_SIGN = rf"(?:[ ]?[\[({{<][ ]?(?:{DOT_WORDS}|\.)[ ]?[\])}}>][ ]?|[ ]+(?:{DOT_WORDS})[ ]+|[_-](?:{DOT_WORDS})[_-])"
AT_SIGN = rf"(?:[ ]?[\[({{<][ ]?(?:{AT_WORDS}|@)[ ]?[\])}}>][ ]?|[ ]+(?:{AT_WORDS})[ ]+|[_-](?:{AT_WORDS})[_-]|[ ]?@[ ]?)"
LINK = rf"(?:{DOT_SIGN}|[ ]?[()][ ]?[(]?|,?[ ]|-)"
RUN = re.compile(rf"(?<![^\W_])(?:{WORD}|[0-9]++)(?:{LINK}(?:{WORD}|[0-9]++))+(?![^\W_])", re.I)
PARTS = re.compile(rf"(?P<word>{WORD})|(?P<digits>[0-9]+)|(?P<dot>{DOT_SIGN})|(?P<link>[ ]?[()][ ]?[(]?|,?[ ]|-)", re.I)
SIGN = re.compile(rf"(?<![^\W_])(?:{PLUS_WORDS})[ ]$|\+[ ]$", re.I)
STAND_IN = re.compile(r"(?<=[0-9])[OolI|]{1,4}(?=[0-9 .-])|(?<=[ .-])[OolI|]{1,4}(?=[0-9])")
AT = re.compile(AT_SIGN, re.I)
HOST = re.compile(rf"[A-Za-z0-9-]+?(?:(?:\.|{DOT_SIGN})[A-Za-z0-9-]+?)+(?![A-Za-z0-9])", re.I)
LABELS = re.compile(rf"{DOT_SIGN}|\.", re.I)
DOT_BEFORE = re.compile(rf"(?:{DOT_SIGN})$", re.I)

PLAIN = "[0-9@]"
#: Texts that may hold a disguise: a superset of what the transducers change, for Arrow's linear-time matcher.
DISGUISED = (
    rf"(?i)(?:\b|_){WORD}{LINK}(?:{WORD}|[0-9]+){LINK}(?:{WORD}|[0-9])|{DOT_SIGN}|[\[({{<][ ]?(?:{AT_WORDS}|@)[ ]?[\])}}>]"
    rf"|[ _-](?:{AT_WORDS})[ _-]+[a-z0-9-]+\.[a-z]{{2}}|[ ]@|@[ ]|[0-9][oli|]{{1,4}}[0-9 .-]|[ .-][oli|]{{1,4}}[0-9]"
)


@cache
def homoglyphs() -> tuple[dict[int, str], str]:
    """The table of look-alikes, and a class of them and of the invisible characters for Arrow's matcher."""
    found = {}
    for point in range(0x80, 0x20000):  # no compatible character of one ASCII letter or digit lies beyond
        c = chr(point)
        category = unicodedata.category(c)
        plain = unicodedata.normalize("NFKC", c)
        if category == "Nd":
            found[point] = str(unicodedata.digit(c))
        elif category == "Zs":
            found[point] = " "
        elif category == "Pd":
            found[point] = "-"
        elif len(plain) == 1 and " " < plain <= "~" and not unicodedata.decomposition(c).startswith(("<super>", "<sub>")):
            found[point] = plain
    found |= {ord(a): b for a, b in zip(LOOK, READ, strict=True)}
    ranges: list[list[int]] = []
    for point in sorted(found):
        if ranges and ranges[-1][1] == point - 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return found, "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + INVISIBLE + "]"


GONE = re.compile(f"[{INVISIBLE}]+")


class Tape:
    """Rewritten text and where each of its characters came from."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        out, self.at, self.origin, size, done = [], [0], [(0, None)], 0, 0
        for start, end, new in edits:
            for piece, origin in ((text[done:start], (done, None)), (new, (start, end))):
                if piece:
                    self._mark(size, origin)
                    out.append(piece)
                    size += len(piece)
            done = end
        if done < len(text):
            self._mark(size, (done, None))
            out.append(text[done:])
        self.text = "".join(out)

    def _mark(self, at: int, origin: tuple[int, int | None]) -> None:
        if self.at[-1] == at:
            self.origin[-1] = origin
        else:
            self.at.append(at)
            self.origin.append(origin)

    def _source(self, place: int) -> tuple[int, int]:
        k = bisect_right(self.at, place) - 1
        start, end = self.origin[k]
        return (start, end) if end is not None else (start + place - self.at[k], start + place - self.at[k] + 1)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source characters behind ``text[start:end]``, which is not empty."""
        return self._source(start)[0], self._source(end - 1)[1]


def emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            found.append((start, host.end()))
        free = host.end() if host else at + 1
        at = text.find("@", free)
    return found


def ips(text: str) -> list[tuple[int, int]]:
    found = []
    for chain in CHAIN.finditer(text):
        at, parts = chain.start(), chain.group().split(".")
        for k in range(0, len(parts) - 3, 4):  # matches follow each other in fours; the rest is too short
            own = parts[k : k + 4]
            end = at + sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in own):
                found.append((at, end))
            at = end + 1
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48 << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]


DETECTORS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def plain_letters(text: str) -> Tape:
    """The first transducer; characters are read one by one, so only those that vanish shift the rest."""
    tape = Tape(text, [])
    if not text.isascii():
        text = text.translate(homoglyphs()[0])
        tape = Tape(text, [(m.start(), m.end(), "") for m in GONE.finditer(text)])
    tape.text = STAND_IN.sub(lambda m: "".join("0" if c in "Oo" else "1" for c in m.group()), tape.text)
    return tape


def plain_digits(text: str) -> Tape:
    """The second transducer.  Digit words count in runs of three, or beside a disguised dot; one alone is a word."""
    edits = []
    for run in RUN.finditer(text):
        parts = [(m.lastgroup, m.start(), m.end()) for m in PARTS.finditer(text, run.start(), run.end())]
        kinds = [kind for kind, _, _ in parts]
        if kinds.count("word") < 3 and "dot" not in kinds:
            continue
        sign = SIGN.search(text, max(0, run.start() - 6), run.start()) if kinds[0] == "word" else None
        if sign:
            edits.append((sign.start(), sign.end(), "+"))
        for k, (kind, start, end) in enumerate(parts):
            if kind == "word":
                edits.append((start, end, DIGIT[text[start:end].lower()]))
            elif kind == "dot":
                edits.append((start, end, "."))
            elif kind == "link" and kinds[k - 1] == kinds[k + 1] == "word" and not set(text[start:end]) & set("()"):
                edits.append((start, end, ""))
    return Tape(text, edits)


def addresses(text: str) -> list[tuple[int, int, str]]:
    """Start, end and plain form of addresses, disguised or not: the third transducer with its detector."""
    found, free = [], 0  # a name begins at ``free`` or later
    for at in AT.finditer(text):
        if at.start() < free:
            continue
        floor, free = free, at.end() if at.group()[0] not in "_-" else free
        host = HOST.match(text, at.end())
        if not host:
            continue
        sign, end = at.group(), host.end()
        tight, bracketed, worded = sign == "@", any(c in sign for c in "[({<"), "@" not in sign
        dots = [(m.start(), m.group()) for m in LABELS.finditer(text, host.start(), end)]
        if tight:  # a plain host ends before a loose dot word: "me@example.com point final"
            literal = False
            for place, dot in dots:
                if literal and dot[0] in " _-" and not any(c in dot for c in "[({<"):
                    end = place
                    break
                literal |= dot == "."
            dots = [d for d in dots if d[0] < end]
        labels = LABELS.split(text[host.start() : end])
        disguised = any(dot != "." for _, dot in dots)
        name, start = "", at.start()
        while True:
            begin = floor + len(text[floor:start].rstrip(LOCAL))
            if begin == start:
                break
            name, start = text[begin:start] + name, begin
            dot = DOT_BEFORE.search(text, max(floor, start - 16), start)
            if not dot or dot.start() == floor or text[dot.start() - 1] not in LOCAL or (tight and not set(dot.group()) & set("[({<")):
                break
            name, start = "." + name, dot.start()
        like_id = any(not c.isalpha() for c in name.strip("."))
        if not name or not len(labels) > 1:
            continue
        if not (tight or bracketed):
            if not (labels[-1].isalpha() and len(labels[-1]) > 1) or not (disguised or like_id) or (worded and labels[0].lower() in ARTICLES):
                continue
        elif disguised and not (labels[-1].isalpha() and len(labels[-1]) > 1):
            continue
        found.append((start, end, f"{name}@{'.'.join(labels)}"))
        free = end
    return found


def find(text: str, disguised: bool = True) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of a whole text, by kind, then start."""
    base = {kind: detect(text) for kind, detect in DETECTORS.items()}
    added: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if disguised:
        letters = plain_letters(text)
        digits = plain_digits(letters.text)
        seen = [(kind, s, e, digits.text[s:e]) for kind, detect in DETECTORS.items() for s, e in detect(digits.text)]
        seen += [("email", *address) for address in addresses(digits.text)]
        for kind, s, e, plain in sorted(seen, key=lambda x: (x[1], -x[2])):
            start, end = letters.back(*digits.back(s, e))
            meets = [b for b in base[kind] if b[0] < end and start < b[1]]
            inside = any(not (start <= a and b <= end) or (a, b) == (start, end) for a, b in meets)
            again = added[kind] and start < added[kind][-1][1]
            if not inside and not again and plain != text[start:end]:
                added[kind].append((start, end))
    out = []
    for kind in KINDS:
        out += sorted([(kind, s, e, True) for s, e in base[kind]] + [(kind, s, e, False) for s, e in added[kind]], key=lambda x: x[1:])
    return out


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    _, odd = homoglyphs()
    for batch in batches:
        texts = batch.column(1)
        plain = pc.fill_null(pc.match_substring_regex(texts, PLAIN), False).to_pylist()
        hidden = pc.fill_null(pc.match_substring_regex(texts, DISGUISED), False).to_pylist()
        look = pc.fill_null(pc.match_substring_regex(texts, odd), False).to_pylist()
        rows = []
        for k in range(batch.num_rows):
            found = find(texts[k].as_py(), hidden[k] or look[k]) if plain[k] or hidden[k] or look[k] else []
            rows.append([dict(zip(("kind", "start", "end", "base"), f)) for f in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, item)], names=["doc_id", "spans"])


def private_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` for every row of ``docs(doc_id, text)``; offsets count code points, ends are exclusive.

    A null or empty text has no spans; a null id keeps its row; repeated rows are read each; other columns are ignored.
    An added span never cuts through a plain span of its kind; it may contain one that is a part of it.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return narrow.mapInArrow(_finder, f"doc_id long, spans {SPANS}")


def op12_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of all spans, plain and added; ``base_sha256`` covers the plain ones."""
    found = private_spans(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(counted, KINDS),
        F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
