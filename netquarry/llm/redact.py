"""Personal information inside free text: found, judged by what the corpus tells, and replaced with typed placeholders.

One scan of the whole texts proposes spans by their shape, each with its cue (the words it stands behind). Two corpus-wide
co-occurrence counts then tell, in bits, how strongly a term reveals a protected entity:

* a name's words: how often each occurs in mailboxes against how often it stands in a capitalised pair, with the corpus rate as the
  expectation. Organisations, products and headings are capitalised too, but no mailbox has their words.
* a cue: how often what stands behind it is certain by its shape or by its words, against how often it is not; remotes and versions
  count against mailboxes, numbers of no form against phone and identity numbers. The corpus can so overrule every shape but that of an
  address, which has no look-alikes to count.

A span is disclosed, and so removed, if the bits of its shape, words and cue together exceed the threshold of its kind. Forms that the
corpus must bear out (family names with particles, capitals, other scripts, short phone numbers, passports) begin far below it. In
`redact` a word of a name that stands alone is generalised to [PERSON] if the corpus ties it to mailboxes.

Defined results: null and empty texts hold nothing; a span of one kind is given once per document and text; a name inside an
address or an e-mail address is part of it; texts of any length are read whole; repeated documents count once; an empty table gives
no rows; extra columns are ignored by `find` and kept by `redact`. Bank account numbers are no identity numbers.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.core import broadcast_if_small, materialise, salted_join, sorted_side

# Words that streets end in or begin with, and forms of phone and identity numbers in use.
STREET = "Street|St\\.|St|Road|Rd\\.|Rd|Avenue|Ave\\.|Ave|Lane|Ln\\.|Ln|Drive|Dr\\.|Dr|Court|Ct\\.|Ct|Way|Boulevard|Blvd\\.|Blvd|Parkway|Pkwy|Close|Crescent|Terrace|Place|Square|Highway|Hwy|Gardens|Grove|Mews|Row|Hill|Walk|Alley"
STREET_BEFORE = "rue|avenue|boulevard|place|chemin|allée|via|viale|calle|plaza|avenida|rua"
STREET_TAIL = "straße|strasse|str\\.|weg|allee|platz|gasse|damm|ufer|ring|steig|stieg|pfad|gatan|vägen|straat|laan"
# Letters by their Unicode class: what a capitalised word may begin with and go on with, Latin, Greek and Cyrillic.
_range = lambda kind, low, high: "".join(c for c in map(chr, range(low, high)) if unicodedata.category(c) == kind)
_LATIN_UP, _LATIN_LOW = "A-Z" + _range("Lu", 0xC0, 0x250), "a-z" + _range("Ll", 0xDF, 0x250)
_OTHER_UP, _OTHER_LOW = _range("Lu", 0x386, 0x530), _range("Ll", 0x386, 0x530)
_W = rf"[{_LATIN_UP}][{_LATIN_LOW}]+"
_PART = rf"(?:Mc{_W}|[{_LATIN_UP}]'{_W}|{_W})"
_FAMILY = rf"{_PART}(?:[-']{_W})?"
_I = rf"[{_LATIN_UP}]\."
# Each pattern begins with a plain set of characters, which the engine scans for fast; what must not stand before comes second.
NAME = re.compile(
    rf"[{_LATIN_UP}](?<![\w.@/-].)(?:(?:(?<=[{_LATIN_UP}])(?:c{_W}|'{_W}|[{_LATIN_LOW}]+)(?:[-']{_W})?), (?:{_W}|{_I})(?: {_I})?(?![\w-])|(?:[{_LATIN_LOW}]+|\.)(?: {_I})? {_FAMILY}(?![\w-]))", re.S
)
# Particles of family names.
PARTICLES = "van der|van den|van de|van|von der|von|de la|de los|de las|de|del|della|di|da|dos|das|du|le|la|ten|ter|af|bin|ibn|el|al"
NAME_PARTICLE = re.compile(rf"[{_LATIN_UP}](?<![\w.@/-].)(?:[{_LATIN_LOW}]+|\.)(?: {_I})? (?:{PARTICLES}) {_FAMILY}(?![\w-])", re.S)
NAME_UPPER = re.compile(rf"[{_LATIN_UP}](?<![\w.@/'-].)[{_LATIN_UP}]+(?: {_I})? [{_LATIN_UP}][{_LATIN_UP}'-]*[{_LATIN_UP}](?![\w-])", re.S)
NAME_OTHER = re.compile(rf"[{_OTHER_UP}](?<![\w.@/-].)(?:[{_OTHER_LOW}]+|\.)(?: [{_OTHER_UP}]\.)? [{_OTHER_UP}][{_OTHER_LOW}]+(?:-[{_OTHER_UP}][{_OTHER_LOW}]+)?(?![\w-])", re.S)
NAME_HAN = re.compile(r"[\u4e00-\u9fff](?<![\w].)[\u4e00-\u9fff]{1,3}(?!\w)", re.S)
_THIRD = re.compile(rf" {_FAMILY}(?=\s*(?:$|[\n\r<>(\[\])|;,*#\"]))")
_UNIT = r"(?:Apt\.?|Apartment|Unit|Suite|Ste\.?|Flat|Room|#)\s?\d+[A-Za-z]?"
ADDRESS = re.compile(
    rf"\d(?<![\w.].)\d{{0,4}}[A-Za-z]?,? (?:(?:North|South|East|West|N\.?|S\.?|E\.?|W\.?|NE|NW|SE|SW) )?(?:{_W}(?:[ -]{_W}){{0,2}} (?:{STREET})(?![\w])(?: (?:NE|NW|SE|SW)(?!\w))?(?:,? {_UNIT})?|(?:{STREET_BEFORE})(?: (?:de|du|des|la|le|del|della|dos|da))* {_W}(?:[ -]{_W})*)", re.S
)
ADDRESS_BACK = re.compile(r"[A-ZÄÖÜ](?<![\w.].)[a-zäöüß]{2,} \d{1,4}[a-z]?(?!\w)", re.S)
_TAIL = re.compile(rf"(?:{STREET_TAIL}) \d")
_UNIT_BEFORE = re.compile(rf"(?<![\w.]){_UNIT},? $")
_BOX = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}(?![\w-])")
_AT = re.compile(r"@| ?[\[({<] ?at ?[\])}>] ?|(?<=\w) at (?=\w)", re.I)
_SPELT = re.compile(r"[A-Za-z0-9-]+(?:(?: ?[\[({<] ?dot ?[\])}>] ?| dot |\.)[A-Za-z0-9-]+)*?(?: ?[\[({<] ?dot ?[\])}>] ?| dot )[A-Za-z]{2,}(?:(?: ?[\[({<] ?dot ?[\])}>] ?| dot )[A-Za-z]{2,})*(?![\w-])", re.I)
_NUMBER = re.compile(r"[+(\d](?<![\w.+(/:-].)(?:(?<=\d)|(?=\d))[\d ().\-]{6,21}\d(?![\w/])(?!\.\d)", re.S)
_ID = re.compile(r"[A-Z\d](?<![\w.-].)(?:(?<=[A-Z])(?:[A-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]\d{6,7}|\d{7,9}[A-Z]?)|(?<=\d)\d{2}(?:\.\d{3}\.\d{3}-\d{2}|-\d{2}-\d{4}| \d{2} \d{4}))(?![\w-])(?!\.\d)", re.S)
#: Forms of numbers: kind, bits, and whether the cues they stand behind are counted. Bits of at least SURE need no cue.
SURE = 6.0
NEVER = -99.0  # bits of what has a kind's place but not its form: evidence on its cue only
FORMS = [
    ("id_number", re.compile(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"), SURE, True),
    ("id_number", re.compile(r"\d{3}\.\d{3}\.\d{3}-\d{2}"), SURE, True),
    ("id_number", re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}"), 1.0, True),
    ("id_number", re.compile(r"[A-Z]\d{7,9}[A-Z]?"), 0.0, True),
    ("id_number", re.compile(r"[A-Z]{2}\d{6,7}"), -4.0, False),
    ("phone", re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{1,5}){1,5}"), SURE, True),
    ("phone", re.compile(r"00\d{2}[ -]\d{1,5}(?:[ -]\d{1,6}){1,5}"), SURE, True),
    ("phone", re.compile(r"\(\d{2,5}\) ?\d{3,4}[ -]?\d{3,4}"), SURE, True),
    ("phone", re.compile(r"0\d{2,4} \d{3,4} ?\d{3,4}"), 3.0, True),
    ("phone", re.compile(r"\d{3}([-.])\d{3}\1\d{4}"), 3.0, True),
    ("phone", re.compile(r"0?\d{10}"), -2.0, True),
    ("phone", re.compile(r"1([-. ])\d{3}\1\d{3}\1\d{4}"), 1.0, False),
    ("phone", re.compile(r"\d{3}-\d{4}"), -4.0, False),
]
#: Bits of forms of names that must be borne out by the corpus: by words that mailboxes hold, or by a cue that names stand behind.
PARTICLE_BITS, UPPER_BITS, OTHER_BITS, HAN_BITS, THIRD_BITS = -4.0, -7.0, -4.0, -7.0, -3.0
# Words of cues that speak for a kind even where the corpus is silent.
SPOKEN = {"phone": "tel|phone|fax|mobile|cell|call|hotline|telefon|dial", "id_number": "passport|ssn|social security|national id|tax id|tax no|taxpayer|nino|cpf|identity|id number|id no"}
SPOKEN_BITS = 4.0
_AFTER, _BEFORE = re.compile(rf"[ -]{_W}"), re.compile(rf"(?<![\w.])[{_LATIN_UP}][{_LATIN_LOW}]+ $")
_SMALL = re.compile("[a-zà-öø-ÿ]")
_CAPS_AFTER, _CAPS_BEFORE = re.compile(rf"[ ,-]+[{_LATIN_UP}]{{2}}"), re.compile(rf"[{_LATIN_UP}]{{2}},? $")
#: Bits of a mailbox and its domain.
EMAIL_BITS = 8.0
SCHEMA = pa.schema([("doc_id", pa.int64()), ("pii_kind", pa.string()), ("at", pa.int64()), ("found_text", pa.string()), ("bits", pa.float64()), ("cue", pa.string()), ("words", pa.list_(pa.string())), ("led", pa.bool_()), ("counts", pa.bool_())])


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def mailbox_words(mailbox: str) -> set[str]:
    """Words a mailbox may hold: its parts, and each without its first letter, for an initial may stand before a family name."""
    parts = [p for p in re.split(r"[._+]|\d+", fold(mailbox)) if len(p) > 2]
    out = set(parts)
    for p in parts:
        out.update(x for x in p.split("-") if len(x) > 2)
        if len(p) > 3:
            out.add(p[1:])
    return out


def _cue(text: str, start: int, before: list[tuple[int, int, str]]) -> str:
    """The one or two words before a place in its line, digits as 9, and a span found there as its kind."""
    line = text.rfind("\n", max(0, start - 40), start) + 1
    low = max(line, start - 40)
    left = text[low:start]
    for a, e, kind in reversed(before):
        if e <= start and e > low:
            left = f"<{kind}>" + text[e:start]
            break
    left = re.sub(r"\d+", "9", left).lower()
    parts = left.split()
    if not parts:
        return ""
    cue = parts[-1] + (" " if left[-1].isspace() else "")
    if sum(map(str.isalpha, cue)) < 3 and len(parts) > 1:
        cue = parts[-2][-16:] + " " + cue
    return cue[-24:]


def emails(text: str, against: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int]]:
    """Mailbox and domain, also where at and dot are spelt; no remotes, no versions, which go to `against`."""
    spelt = re.search(r"\bat\b", text, re.I) is not None
    if not spelt:
        at = text.find("@")
        marks = []
        while at >= 0:
            marks.append((at, at + 1))
            at = text.find("@", at + 1)
    else:
        marks = [m.span() for m in _AT.finditer(text)]
    for a, b in marks:
        box = a
        while box and text[box - 1] in _BOX:
            box -= 1
        while box < a and not text[box].isalnum():
            box += 1
        if box == a or text[a - 1] in ".%":
            continue
        plain = text[a:b] == "@"
        d = _DOMAIN.match(text, b)
        if plain and (re.match(r"v?\d+\.", text[b : b + 8]) or text[max(0, box - 3) : box] == "://"):
            if against is not None:
                against.append((box, b))
            continue  # package@version, or a user in a URL
        if plain and d:
            after = text[d.end() : d.end() + 2]
            if after[:1] == ":" and after[1:2].strip() and after[1:2] not in "\"'<>,;)":
                if against is not None:
                    against.append((box, d.end()))
                continue  # user@host:path
            yield box, d.end()
            continue
        d = _SPELT.match(text, b) or (_DOMAIN.match(text, b) if not plain and text[a:b].strip().lower() != "at" else None)
        if d:
            yield box, d.end()


class _Taken:
    """Spans in order of their starts, none overlapping another."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return not k or self.ends[k - 1] <= a


def candidates(text: str) -> list[tuple[str, int, int, float, bool, bool]]:
    """(kind, start, end, bits of its shape, beside another capitalised word, counted as evidence).

    A street's flat or unit is looked for in the 24 characters before the house number, a word beside a name in 24 as well."""
    out: list[tuple[str, int, int, float, bool, bool]] = []
    taken: list[tuple[int, int]] = []

    def take(kind: str, a: int, b: int, bits: float, beside: bool = False, counts: bool = True) -> None:
        out.append((kind, a, b, bits, beside, counts))
        taken.append((a, b))

    against: list[tuple[int, int]] = []
    for a, b in emails(text, against):
        take("email", a, b, EMAIL_BITS)
    out += [("email", a, b, NEVER, False, True) for a, b in against]
    for m in ADDRESS.finditer(text):
        a, b = m.span()
        unit = _UNIT_BEFORE.search(text, max(0, a - 24), a)
        take("address", unit.start() if unit else a, b, SURE)
    for m in ADDRESS_BACK.finditer(text):
        if _TAIL.search(m.group()):
            take("address", m.start(), m.end(), SURE)
    for pattern in (_ID, _NUMBER):
        held = _Taken(taken)
        for m in pattern.finditer(text):
            a, b = m.span()
            if held.free(a, b):
                s = m.group()
                for kind, form, bits, counts in FORMS:
                    if form.fullmatch(s):
                        take(kind, a, b, bits, counts=counts)
                        break
                else:  # a number of no form speaks against what else stands behind its cue
                    out.append(("id_number" if pattern is _ID else "phone", a, b, NEVER, False, True))
    held = _Taken(taken)
    beside = lambda a, b: _AFTER.match(text, b) is not None or _BEFORE.search(text, max(0, a - 24), a) is not None
    third: list[tuple[int, int]] = []
    for m in NAME.finditer(text):
        a, b = m.span()
        if held.free(a, b):
            take("name", a, b, 0.0, beside(a, b))
            more = _THIRD.match(text, b)
            if more and held.free(b, more.end()) and not _BEFORE.search(text, max(0, a - 24), a):
                third.append((a, more.end()))
    held = _Taken(taken)
    out += [("name", a, b, THIRD_BITS, False, False) for a, b in third]
    ascii_only = text.isascii()
    for pattern, bits in ((NAME_PARTICLE, PARTICLE_BITS), (NAME_UPPER, UPPER_BITS), (NAME_OTHER, OTHER_BITS), (NAME_HAN, HAN_BITS)):
        if ascii_only and pattern in (NAME_OTHER, NAME_HAN):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if not held.free(a, b) or pattern is NAME_UPPER and (_CAPS_AFTER.match(text, b) or _CAPS_BEFORE.search(text, max(0, a - 24), a) or not _SMALL.search(text, max(text.rfind("\n", max(0, a - 40), a), a - 40, 0), a)):
                continue  # capitals among capitals are no name
            out.append(("name", a, b, bits, beside(a, b), False))
    return out


def _rows(text: str) -> Iterator[tuple]:
    """(kind, at, found_text, bits, cue, words, led, counts) of each proposed span."""
    got = sorted(candidates(text), key=lambda c: (c[1], c[2]))
    where = [(a, e, kind) for kind, a, e, bits, _, counts in got if counts and bits > NEVER]
    k = 0
    for kind, a, e, bits, beside, counts in got:
        while k < len(where) and where[k][0] < a:
            k += 1
        s = text[a:e]
        if bits == NEVER:
            words = []
        elif kind == "email":
            words = sorted(mailbox_words(re.split(r"@|\W*\bat\b", s, maxsplit=1, flags=re.I)[0]))
        elif kind == "name" and counts:
            words = [fold(w) for w in re.findall(rf"{_W}(?:-{_W})?", s)]
        elif kind == "name":
            words = [fold(w) for w in re.findall(r"\w{2,}(?:-\w{2,})?", s)]
        else:
            words = []
        yield kind, a, s, bits, _cue(text, a, where[max(0, k - 3) : k]), words, beside, counts


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if text:
                rows += [(doc, *r) for r in _rows(text)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SCHEMA, strict=True)], schema=SCHEMA)


def proposed(documents: DataFrame) -> DataFrame:
    """Every proposed span of the documents, written once."""
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    spec = "doc_id long, pii_kind string, at long, found_text string, bits double, cue string, words array<string>, led boolean, counts boolean"
    return materialise(d.mapInArrow(_scan, spec).withColumn("row", F.monotonically_increasing_id()), "spans")


def word_bits(c: DataFrame) -> DataFrame:
    """word, bits: how much oftener documents have the word in a mailbox than its frequency in capitalised pairs lets expect."""
    word = c.filter("counts and pii_kind in ('name', 'email')").select("doc_id", (F.col("pii_kind") == "name").alias("is_name"), F.explode("words").alias("word")).distinct()
    word = word.groupBy("word").agg(F.count(F.when(F.col("is_name"), 1)).alias("n"), F.count(F.when(~F.col("is_name"), 1)).alias("m")).filter("n > 0")
    rate = word.agg(F.sum(F.least("m", "n")).alias("ms"), F.sum("n").alias("ns"))
    return word.crossJoin(F.broadcast(rate)).select("word", F.log2((F.col("m") + 0.5) / (F.col("n") * F.col("ms") / F.col("ns") + 0.5)).alias("bits"))  # rate is one row


def with_words(c: DataFrame, words: DataFrame) -> DataFrame:
    """c with word_bits, the sum over its words. Frequent words are salted."""
    each = c.filter("pii_kind = 'name'").select("row", F.explode("words").alias("word"))
    side, small = broadcast_if_small(words)
    each = each.join(side, "word") if small else salted_join(each, words, ["word"], by=F.col("row"))
    pairs = each.groupBy("row").agg(F.sum("bits").alias("word_bits"))
    return c.join(pairs, "row", "left").withColumn("word_bits", F.coalesce("word_bits", F.lit(0.0)))


def cue_bits(c: DataFrame) -> DataFrame:
    """pii_kind, cue, cue_bits: the odds, in bits, that what stands behind the cue is disclosed, by what is certain by its shape, or for
    names by its words."""
    name = F.col("pii_kind") == "name"
    sure = F.when(name, (F.col("word_bits") > 1) & ~F.col("led")).otherwise(F.col("bits") >= 1)
    cue = c.filter("counts").groupBy("pii_kind", "cue").agg(F.count("*").alias("n"), F.count(F.when(sure, 1)).alias("s"))
    odds, share = F.log2((F.col("s") + 0.5) / (F.col("n") - F.col("s") + 0.5)), F.log2((F.col("s") + 0.5) / (F.col("n") + 1.0))
    return cue.select("pii_kind", "cue", F.greatest(F.lit(-MOST_AGAINST), F.least(F.lit(6.0), F.when(name, F.greatest(F.lit(-3.0), share + 2)).otherwise(odds))).alias("cue_bits"))


def _spoken(kind: Column, cue: Column) -> Column:
    """Whether the words of a cue speak for the kind."""
    out = F.lit(False)
    for k, words in SPOKEN.items():
        out = out | ((kind == k) & cue.rlike(rf"\b(?:{words})\b"))
    return out


def judged(c: DataFrame, cues: DataFrame) -> DataFrame:
    """c with cue_bits and score. A form that is not counted, behind a cue the corpus does not know, has the odds of a single miss."""
    side, small = broadcast_if_small(cues)
    c = c.join(side, ["pii_kind", "cue"], "left") if small else salted_join(c, cues, ["pii_kind", "cue"], "left", by=F.col("row"))
    known = F.coalesce("cue_bits", F.when(F.col("pii_kind") == "name", F.lit(0.0)).otherwise(F.lit(UNKNOWN_CUE)))
    c = c.withColumn("cue_bits", F.when(~F.col("counts") & _spoken(F.col("pii_kind"), F.col("cue")), F.greatest(F.lit(0.0), known) + SPOKEN_BITS).otherwise(known))
    return c.withColumn("score", F.round(F.col("bits") + F.col("word_bits") + F.col("cue_bits") - F.when(F.col("led"), 6.0).otherwise(0.0), 9))


#: Bits that a cue may speak against a span: beyond those of any form, so the corpus can overrule every shape.
MOST_AGAINST = 12.0
UNKNOWN_CUE = -1.585  # log2(0.5 / 1.5)


def spans(documents: DataFrame) -> DataFrame:
    """Every proposed span with its bits: doc_id, pii_kind, at, found_text, score."""
    c = proposed(documents)
    c = materialise(with_words(c, word_bits(c)), "judged")
    return judged(c, cue_bits(c)).select("doc_id", "pii_kind", "at", "found_text", "led", "bits", "word_bits", "cue_bits", "cue", "counts", "score")


#: Least bits of a disclosure, by kind.
THRESHOLDS = {"email": 0.0, "address": 0.0, "phone": -1.0, "id_number": -1.0, "name": -6.0}


def _passes(thresholds: dict[str, float] | None) -> Column:
    least = F.create_map(*[F.lit(x) for kv in (thresholds or THRESHOLDS).items() for x in kv])
    return F.col("score") >= F.try_element_at(least, F.col("pii_kind"))


def find(documents: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """The disclosed spans: doc_id, pii_kind, found_text, at. Of spans of one kind that begin at one place the longest counts."""
    got = spans(documents).filter(_passes(thresholds))
    return got.groupBy("doc_id", "pii_kind", "at").agg(F.max_by("found_text", F.char_length("found_text")).alias("found_text")).select("doc_id", "pii_kind", "found_text", "at")


#: Words that stand alone are generalised if the corpus ties them to mailboxes by at least so many bits; most judged rows that every task holds.
ALONE_BITS, MOST_JUDGED = 3.0, 500_000
_ALONE = re.compile(rf"[{_LATIN_UP}](?<![\w.@/-].)[{_LATIN_LOW}]{{2,}}(?![\w-])", re.S)


def _replaced(text: str, words: dict[str, float], cues: dict[tuple[str, str], float], least: dict[str, float]) -> str:
    """The text with a typed placeholder for each disclosed span, and [PERSON] for a family or given name left alone."""
    best: dict[tuple[int, str], int] = {}
    for kind, a, s, bits, cue, own, led, counts in _rows(text):
        known = cues.get((kind, cue), 0.0 if kind == "name" else UNKNOWN_CUE)
        if not counts and kind in SPOKEN and re.search(rf"\b(?:{SPOKEN[kind]})\b", cue):
            known = max(0.0, known) + SPOKEN_BITS
        score = bits + (sum(words.get(w, 0.0) for w in own) if kind == "name" else 0.0) + known - (6.0 if led else 0.0)
        if kind in least and round(score, 9) >= least[kind]:
            best[a, kind] = max(best.get((a, kind), 0), a + len(s))
    found = sorted((a, e, kind) for (a, kind), e in best.items())
    held = _Taken([(a, e) for a, e, _ in found])
    for m in _ALONE.finditer(text):
        if held.free(*m.span()) and words.get(fold(m.group()), 0.0) >= ALONE_BITS:
            found.append((*m.span(), "person"))
    out, last = [], 0
    for a, e, kind in sorted(found):
        if a >= last:
            out += [text[last:a], "[", kind.upper(), "]"]
            last = e
    return "".join([*out, text[last:]])


def redact(documents: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """documents with text in which every disclosed span is a placeholder such as [EMAIL]; a name's word that stands alone, and that the
    corpus ties to mailboxes, is generalised to [PERSON].

    The judged words and cues are held by every task and the texts are scanned again, so no text is shuffled. If there are more than
    MOST_JUDGED of them, each text gets those that it holds by a join; the result is the same."""
    spark, least = documents.sparkSession, dict(thresholds or THRESHOLDS)
    c = proposed(documents)
    words = materialise(word_bits(c), "words")
    c = materialise(with_words(c, words), "judged")
    cues = materialise(cue_bits(c), "cues")
    strong = words.filter(F.abs("bits") > 0)
    if strong.count() + cues.count() > MOST_JUDGED:
        return _redact_joined(documents, strong, cues, least)
    held = spark.sparkContext.broadcast(({r["word"]: r["bits"] for r in strong.collect()}, {(r["pii_kind"], r["cue"]): r["cue_bits"] for r in cues.collect()}))
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = held.value
        for b in batches:
            text = pa.array([_replaced(t, own, known, least) if t else t for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([text if k == at else x for k, x in enumerate(b.columns)], schema=b.schema)

    return documents.mapInArrow(run, documents.schema)


def _terms(text: str) -> set[tuple[str, str]]:
    """What _replaced() looks up for a text: (kind, cue), and ("", word)."""
    out = {("", fold(m.group())) for m in _ALONE.finditer(text)}
    for kind, _, _, _, cue, own, _, _ in _rows(text):
        out.add((kind, cue))
        if kind == "name":
            out.update(("", w) for w in own)
    return out


def _redact_joined(documents: DataFrame, words: DataFrame, cues: DataFrame, least: dict[str, float]) -> DataFrame:
    """The way for more judged words and cues than a task should hold: those that a text holds are joined to it. Texts are known by their
    content, so documents without a number, or with that of another, are redacted too."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(key, *term) for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if text for term in _terms(text)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in cols], names=["_text", "kind", "term"])

    @F.udf("string", useArrow=True)
    def put(text: str, found: list):
        if not text:
            return text
        own = {x["term"]: x["bits"] for x in found or [] if not x["kind"]}
        return _replaced(text, own, {(x["kind"], x["term"]): x["bits"] for x in found or [] if x["kind"]}, least)

    keyed = documents.withColumn("_text", F.sha2("text", 256))
    known = words.select(F.lit("").alias("kind"), F.col("word").alias("term"), "bits").unionByName(cues.select(F.col("pii_kind").alias("kind"), F.col("cue").alias("term"), F.col("cue_bits").alias("bits")))
    terms = keyed.select("_text", "text").mapInArrow(held, "_text string, kind string, term string").distinct()
    terms = salted_join(terms, sorted_side(known), ["kind", "term"], by=F.col("_text"))
    terms = terms.groupBy("_text").agg(F.collect_list(F.struct("kind", "term", "bits")).alias("_found"))
    return keyed.join(sorted_side(terms), "_text", "left").withColumn("text", put("text", "_found")).select(*documents.columns)
