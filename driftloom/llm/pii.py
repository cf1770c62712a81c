"""Surrogates for personal data: keyed, of the same type and format, injective.

Detected entities are e-mail addresses, telephone numbers, social security numbers,
IPv4 and IPv6 addresses, payment cards (valid check digit), IBANs, secrets that are
assigned to a name, and persons: names after a form of address, two capitalised words
of which one is a listed given or family name or that stand where persons do (after
"by" or "met", before "said", joined to another person), and later mentions of a family
name found in the same text, possessives included.

A surrogate is a keyed permutation of the entity within its own format: every position
keeps its kind (digit, hex, letter of a script; in names vowel or consonant), check
digits are made anew, case and punctuation stay.  Listed names go to listed names of
their gender; other names keep the ending that tells the gender.  A permutation never
maps two entities to one, so distinct entities stay distinct and every mention of an
entity gets the same surrogate on any executor without a shared table.  The written
result is checked all the same; entities that do share a surrogate get another key
until none do.

Null and empty texts stay as they are, texts of any length are read whole, repeated
rows each get their result, of entities that tie for a place in the text the kind named first wins, other columns play no part, an empty table gives none.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Given names by script and gender, and family names by script.
GIVEN = {
    ("latin", "f"): "Alice Amanda Amelia Andrea Anna Barbara Camille Carmen Caroline Catherine Charlotte Chiara Christine Clara Claire Daniela Elena Elizabeth Emily Emma Eva Grace Hannah Helen Ingrid Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Linda Lisa Lucia Maria Marta Mary Nora Olivia Patricia Paula Rachel Ruth Sarah Sophie Susan Teresa Victoria".split(),
    ("latin", "m"): "Adam Alexander Andrew Anthony Benjamin Carlos Charles Christopher Daniel David Edward Felix Francisco Frank George Giovanni Hans Henry Hugo Jack James Jan Jean John Jonas Joseph Juan Karl Kevin Louis Lucas Marco Mark Martin Matthew Michael Miguel Oscar Patrick Paul Peter Pierre Richard Robert Samuel Simon Stefan Thomas Victor William".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Вера".split(),
    ("cyrillic", "m"): "Иван Пётр Павел Сергей Алексей Дмитрий Андрей Николай".split(),
}
FAMILY = {
    "latin": "Adams Allen Anderson Baker Becker Bernard Brown Campbell Carter Clark Cooper Davis Dubois Evans Ferrari Fischer Fernandez Garcia Gonzalez Green Hall Harris Hoffmann Jackson Johnson Jones Keller King Koch Laurent Lewis Lopez Martin Martinez Meyer Miller Mitchell Moore Moreau Morgan Müller Murphy Nelson Perez Roberts Robinson Rodriguez Romero Rossi Sanchez Schmidt Schneider Scott Smith Taylor Thompson Torres Turner Wagner Walker Weber White Williams Wilson Wright Young".split(),
    "cyrillic": "Иванов Петров Сидоров Кузнецов Попов Васильев Соколов Михайлов".split(),
}
#: Forms of address and the gender they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "", "Prof": "", "господин": "m", "госпожа": "f"}
COUNTRY_CODES = ("1", "7", "33", "34", "39", "41", "43", "44", "49")
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþąćčďęěğıłńňœřśşšťůűźżž")
#: The same for names: vowels and consonants of a script apart, so that a name stays one that can be spoken.
SOUNDS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь", "αεηιουω", "βγδζθκλμνξπρστφχψ", "àáâãäåæèéêëìíîïòóôõöøùúûüýąęěıœůű", "çðñþćčďğłńňřśşšťźżž")
#: First and last code points of scripts without case.
RANGES = ((0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x05D0, 0x05EA), (0x0621, 0x064A))
#: Endings that tell the gender or kind of a name, the longest that fits stays.
ENDINGS = ("ская", "ский", "ова", "ева", "ина", "ов", "ев", "ин", "ая", "ий", "ия", "а", "я", "ska", "ski", "ova", "eva", "ina", "mann", "son", "sen", "ia", "er", "ez", "us", "os", "is", "a", "e", "o", "i")
ROUNDS = 6

EMAIL = re.compile(r"(?<![\w.+-])[\w](?:[\w.+-]*[\w+-])?@(?:[\w](?:[\w-]*[\w])?\.)+[A-Za-z]{2,}(?![\w])")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)")
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:)(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:])")
CARD = re.compile(r"(?<![\w+.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)")
PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?|\(\d{2,4}\)[ .-]?)\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w])")
DOMESTIC = re.compile(r"(?<![\w.+-])(?:[2-9]\d{2}[ .-]\d{3}[.-]\d{4}|0\d{2,4}[ /-]\d{3,4} ?\d{3,4})(?![\w]|[.-]\d)")
SSN = re.compile(r"(?<![\w.-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w]|-\d)")
IBAN = re.compile(r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w])")
SECRET = re.compile(r"(?i)\b(?:api[_-]?key|access[_-]?key|secret|token|password|passwd)\b\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{12,})")
NAME = r"[^\W\d_][^\W\d_'-]*(?:['-][^\W\d_]+)*"
PERSON = re.compile(r"\b(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + rf")\b\.? ({NAME})(?: ({NAME}))?")
GIVEN_NAMES = {n: k for k, names in GIVEN.items() for n in names}
FAMILY_NAMES = frozenset(n for names in FAMILY.values() for n in names)
CAPITAL = "[" + "".join(chr(c) for c in range(0x41, 0x530) if chr(c).isupper()) + "]"
#: Two capitalised words in a row; the second may be the first of the next pair.
PAIR = re.compile(rf"(?<![\w'’-])({CAPITAL}[^\W\d_]+(?:['-][^\W\d_]+)*)(?= ({CAPITAL}[^\W\d_]+(?:['-][^\W\d_]+)*))")
#: Words that stand before or after a person in prose, and between two.
BEFORE = re.compile(r"\b(?:by|met|meet|meets|named|called|asked|told|dear|signed|author|contact|attn)[:,]? $", re.IGNORECASE)
AFTER = re.compile(r" (?:said|says|wrote|writes|asked|told|met|meets|replied|called|сказала?|ответила?)\b")
BETWEEN = re.compile(r",? (?:and|or|und|oder|et|ou|y|o|и|или) |, ")
#: Endings of a family name that a later mention may have: it stays in the text.
POSSESSIVE = ("'s", "’s", "'", "’", "s")
WORD = re.compile(NAME)
KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "secret", "person")


@lru_cache(1 << 12)
def place(c: str, sounds: bool = False) -> tuple[int, int, int] | None:
    """(alphabet, index, size) of a small letter, digit or sign; None if it is in no alphabet."""
    table = SOUNDS if sounds else ALPHABETS
    for a, letters in enumerate(table):
        i = letters.find(c)
        if i >= 0:
            return a, i, len(letters)
    for r, (lo, hi) in enumerate(RANGES):
        if lo <= ord(c) <= hi:
            return len(table) + r, ord(c) - lo, hi - lo + 1
    return None


def letter(alphabet: int, i: int, sounds: bool = False) -> str:
    table = SOUNDS if sounds else ALPHABETS
    return table[alphabet][i] if alphabet < len(table) else chr(RANGES[alphabet - len(table)][0] + i)


def is_name(word: str | None) -> bool:
    """A capital at the start, or a script that has none."""
    return bool(word) and (word[0].isupper() or (word[0].lower() == word[0].upper() and len(word) > 1))


def luhn(digits: str) -> int:
    """The digit that completes ``digits``."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


class Keyed:
    """Permutations under one secret key."""

    def __init__(self, key: bytes):
        self.key = key
        self.surrogate = lru_cache(1 << 16)(self._surrogate)

    def _stream(self, label: str, n: int) -> list[int]:
        out, i = b"", 0
        while len(out) < 4 * n:
            out += hmac.new(self.key, f"{label}|{i}".encode(), hashlib.sha256).digest()
            i += 1
        return [int.from_bytes(out[4 * j:4 * j + 4], "big") for j in range(n)]

    def permute(self, values: list[int], radix: list[int], tweak: str) -> list[int]:
        """A bijection of mixed-radix vectors: a Feistel network that adds to its halves in turn."""
        half, v = len(values) // 2, list(values)
        shape = f"{tweak}|{radix}"
        for r in range(ROUNDS):
            left = range(half) if r % 2 else range(half, len(v))
            other = v[half:] if r % 2 else v[:half]
            for i, x in zip(left, self._stream(f"{shape}|{r}|{other}", len(left)), strict=True):
                v[i] = (v[i] + x) % radix[i]
        return v

    def letters(self, text: str, tweak: str, alphabet: str | None = None, sounds: bool = False) -> str:
        """Letters and digits permuted in place; case, punctuation and unknown signs stay."""
        folded = [c.lower() if len(c.lower()) == 1 else c for c in text]
        places = [((0, alphabet.find(c), len(alphabet)) if c in alphabet else None) if alphabet else place(c, sounds) for c in folded]
        at = [i for i, p in enumerate(places) if p]
        new, out = self.permute([places[i][1] for i in at], [places[i][2] for i in at], f"{tweak}|{[places[i][0] for i in at]}"), list(text)
        for i, x in zip(at, new, strict=True):
            made = alphabet[x] if alphabet else letter(places[i][0], x, sounds)
            out[i] = made.upper() if text[i] != folded[i] else made
        return "".join(out)

    def digits(self, text: str, tweak: str, check=None) -> str:
        """The digits of ``text`` as one number of its length; ``check`` makes the last one."""
        only = [int(c) for c in text if c.isdigit()]
        body = only[:-1] if check else only
        new = self.permute(body, [10] * len(body), tweak)
        if check:
            new = [*new, check("".join(map(str, new)))]
        it = iter(new)
        return "".join(str(next(it)) if c.isdigit() else c for c in text)

    def name(self, word: str, known: list[str], tweak: str, others: frozenset[str] = frozenset()) -> str:
        """A name of the list goes to another of the list, any other name to one in no list with the same ending."""
        if word in known:
            order = sorted(known, key=lambda x: hmac.new(self.key, f"{tweak}|{x}".encode(), hashlib.sha256).digest())
            return order[(order.index(word) + 1) % len(order)]
        end = next((e for e in ENDINGS if word.lower().endswith(e) and len(word) >= len(e) + 2), "")
        stem, tail = word[:len(word) - len(end)], word[len(word) - len(end):]
        new = stem
        while True:  # a walk along the permutation's cycle stays a bijection
            new = self.letters(new, f"{tweak}|{end}", sounds=True)
            # the stem and its ending must come apart at the same place again
            cut = next((e for e in ENDINGS if (new + tail).lower().endswith(e) and len(new + tail) >= len(e) + 2), "")
            if new + tail not in others and cut == end:
                return new + tail

    def _surrogate(self, kind: str, text: str) -> str:
        if kind == "email":
            local, _, domain = text.rpartition("@")
            labels = domain.split(".")
            keep = 2 if len(labels) > 1 and labels[-2].lower() == "example" else 1
            head = ".".join(labels[:-keep])
            return f"{self.letters(local, 'local')}@{self.letters(head, 'domain')}{'.' if head else ''}{'.'.join(labels[-keep:])}"
        if kind == "card":
            return self.digits(text, "card", luhn)
        if kind == "iban":
            plain = text.replace(" ", "")
            account = self.letters(plain[4:], "iban")
            it = iter(plain[:2] + iban_check(plain[:2], account) + account)
            return "".join(c if c == " " else next(it) for c in text)
        if kind == "phone":
            code = country_code(text)
            cut = len(code) + 1 if code else 0
            return text[:cut] + self.digits(text[cut:], "phone")
        if kind == "ssn":
            new = self.digits(text, "ssn")
            while not SSN.fullmatch(new):
                new = self.digits(new, "ssn")
            return new
        if kind == "ip" and ":" in text:
            return self.address(text)
        if kind == "ip":
            octets = [int(x) for x in text.split(".")]
            fixed = 1 if octets[0] == 10 else 2 if octets[:2] == [192, 168] else 0
            if fixed:
                return ".".join(map(str, octets[:fixed] + self.permute(octets[fixed:], [256] * (4 - fixed), "ip")))
            new = octets
            while True:  # public stays public: walk past addresses that were left alone or are private
                new = self.permute(new, [256] * 4, "ip")
                if public(new):
                    return ".".join(map(str, new))
        if kind == "secret":
            hexa = re.fullmatch(r"[0-9a-fA-F]+", text)
            return self.letters(text, "secret", "0123456789abcdef") if hexa and (text.lower() == text or text.upper() == text) else self.letters(text, "secret")
        if kind == "person":
            return self.person(text)
        return text

    def address(self, text: str) -> str:
        """The surrogate of an IPv6 address: the first group and all zeros stay, the others keep their number of digits, so every way of writing it does too."""
        groups = [int(x, 16) for x in ipaddress.IPv6Address(text).exploded.split(":")]
        at = [i for i in range(1, 8) if groups[i]]
        low = [16 ** (len(f"{groups[i]:x}") - 1) for i in at]
        new = self.permute([groups[i] - a for i, a in zip(at, low, strict=True)], [15 * a for a in low], f"ip6|{groups[0]}|{at}")
        for i, a, v in zip(at, low, new, strict=True):
            groups[i] = v + a
        head, gap, tail = text.partition("::")
        before, after = ([p for p in part.split(":") if p] for part in (head, tail))
        put = lambda parts, values: ":".join(f"{v:x}".zfill(len(p)) for p, v in zip(parts, values, strict=True))
        made = put(before, groups[:len(before)]) + gap + put(after, groups[8 - len(after):] if after else [])
        return made.upper() if text.upper() == text and text.lower() != text else made

    def person(self, text: str) -> str:
        """The surrogate of a given and a family name, or of a single name: the title plays no part, so mentions agree."""
        words = text.split(" ")
        script = "cyrillic" if re.match("[а-яёА-ЯЁ]", words[-1]) else "latin"
        listed = frozenset(FAMILY["latin"] + FAMILY["cyrillic"])
        if len(words) == 1 and words[0] not in GIVEN_NAMES:
            return self.name(words[0], FAMILY[script], "family", listed)
        given = self.name(words[0], GIVEN.get(GIVEN_NAMES.get(words[0]), []), "given", frozenset(GIVEN_NAMES))
        return " ".join([given, *[self.name(w, FAMILY[script], "family", listed) for w in words[1:]]])


def country_code(text: str) -> str:
    return next((c for c in COUNTRY_CODES if re.match(rf"\+{c}(?!\d)", text)), "")


def public(octets: list[int]) -> bool:
    """Whether an address can be a host's on the internet."""
    a, b = octets[:2]
    return not (a in (0, 10, 127, 255) or (a, b) == (192, 168) or octets == [255] * 4)


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    for m in CARD.finditer(text):
        d = re.sub(r"\D", "", m[0])
        if luhn(d[:-1]) == int(d[-1]):
            yield *m.span(), "card"
    for m in IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if iban_check(plain[:2], plain[4:]) == plain[2:4]:
            yield *m.span(), "iban"
    yield from ((*m.span(), "ssn") for m in SSN.finditer(text))
    for pattern in (PHONE, DOMESTIC):
        yield from ((*m.span(), "phone") for m in pattern.finditer(text) if 7 <= sum(c.isdigit() for c in m[0]) <= 15)
    for m in IP.finditer(text):
        octets = [int(x) for x in m[0].split(".")]
        if (public(octets) or octets[0] == 10 or octets[:2] == [192, 168]) and not re.search(r"(?i)(?:\bv|version|release)\s*$", text[max(0, m.start() - 10):m.start()]):
            yield *m.span(), "ip"


def _addresses(text: str) -> Iterator[tuple[int, int, str]]:
    for m in IP6.finditer(text):
        try:
            ipaddress.IPv6Address(m[0])
        except ValueError:
            continue
        if any(c.isdigit() for c in m[0]):
            yield *m.span(), "ip"


def _persons(text: str) -> Iterator[tuple[int, int, str]]:
    for m in PERSON.finditer(text):
        if is_name(m[1]):
            yield m.start(1), m.end(2) if is_name(m[2]) else m.end(1), "person"
    last = -1  # where the person before ends
    for m in PAIR.finditer(text):
        (start, end), (given, family) = (m.start(), m.end(2)), m.groups()
        if start < last or given in TITLES:
            continue
        known = given in GIVEN_NAMES or family in FAMILY_NAMES
        if known or BEFORE.search(text, max(0, start - 12), start) or AFTER.match(text, end) or (last >= 0 and BETWEEN.fullmatch(text, last, start)):
            yield start, end, "person"
            last = end


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), disjoint, by start; where two overlap the earlier kind of ``KINDS`` wins, then the earlier start."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*m.span(), "email") for m in EMAIL.finditer(text)]
    if re.search(r"\d", text):
        found += _numbers(text)
    if ":" in text:
        found += _addresses(text)
    if "=" in text or ":" in text:
        found += [(*m.span(1), "secret") for m in SECRET.finditer(text) if re.search(r"\d", m[1])]
    found += _persons(text)
    starts: list[int] = []
    out: list[tuple[int, int, str]] = []

    def take(span: tuple[int, int, str]) -> None:
        i = bisect.bisect_right(starts, span[0])
        if (i == 0 or out[i - 1][1] <= span[0]) and (i == len(out) or span[1] <= out[i][0]):
            starts.insert(i, span[0])
            out.insert(i, span)

    for span in sorted(found, key=lambda x: (KINDS.index(x[2]), x[0], -x[1])):
        take(span)
    families = {w for s, e, k in out if k == "person" for w in text[s:e].split(" ")[-1:] if len(w) > 2}
    if families:  # later mentions of a person by family name
        first = next(s for s, _, k in out if k == "person")
        for m in WORD.finditer(text, first):
            if m[0] in families:
                take((*m.span(), "person"))
                continue
            cut = next((len(p) for p in POSSESSIVE if m[0].endswith(p) and m[0][:-len(p)] in families), 0)
            if cut:
                take((m.start(), m.end() - cut, "person"))
    return out


def canonical(kind: str, text: str) -> str:
    """What two mentions of one entity share."""
    if kind == "phone":
        code = country_code(text)
        return f"{code}:" + re.sub(r"\D", "", text[len(code) + 1 if code else 0:])
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "ip" and ":" in text:
        return ipaddress.IPv6Address(text).exploded
    return text if kind in ("person", "secret") else text.replace(" ", "").lower()


def entity_id(key: bytes, kind: str, text: str) -> str:
    """A keyed digest by which mentions of an entity are known without its text."""
    return hmac.new(key, f"{kind}|{canonical(kind, text)}".encode(), hashlib.sha256).hexdigest()[:32]


def replace(text: str, surrogate: Callable[[str, str], str]) -> tuple[str, list[tuple[str, int, str, str]]]:
    """The text with surrogates, and (kind, start in the input, entity, surrogate) of each."""
    parts, at, log = [], 0, []
    for s, e, kind in detect(text):
        entity = text[s:e]
        new = surrogate(kind, entity)
        parts += [text[at:s], new]
        log.append((kind, s, entity, new))
        at = e
    return "".join([*parts, text[at:]]), log


ENTITY = "array<struct<kind:string,start:int,length:int,surrogate:string,entity:string>>"
FORMS = "array<struct<kind:string,entity:string,form:string>>"


def _rewrite(key: bytes, make: Callable[[bytes], Keyed]):
    """Rows (doc_id, text, tries) to (doc_id, clean_text, entities, print, forms); ``tries`` counts the new keys of an entity."""
    entities = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("surrogate", pa.string()), ("entity", pa.string())]))
    forms = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string()), ("form", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = [make(key)]
        for batch in batches:
            texts, logs, marks = [], [], []
            for text, tries in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                again = {x["entity"]: x["tries"] for x in tries or []}

                def surrogate(kind: str, entity: str, again: dict = again) -> str:
                    n = again.get(entity_id(key, kind, entity), 0) if again else 0
                    while len(keyed) <= n:
                        keyed.append(make(hmac.new(key, str(len(keyed)).encode(), hashlib.sha256).digest()))
                    return keyed[n].surrogate(kind, entity)

                clean, log = (text, []) if not text else replace(text, surrogate)
                ids = [entity_id(key, k, e) for k, _, e, _ in log]
                texts.append(clean)
                logs.append([{"kind": k, "start": s, "length": len(e), "surrogate": n, "entity": i} for (k, s, e, n), i in zip(log, ids, strict=True)])
                marks.append([dict(zip(("kind", "entity", "form"), x, strict=True)) for x in sorted({(k, i, hashlib.sha256(canonical(k, n).encode()).hexdigest()[:32]) for (k, _, _, n), i in zip(log, ids, strict=True)})])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(logs, entities), batch.column(3), pa.array(marks, forms)], ["doc_id", "clean_text", "entities", "print", "forms"])

    return work


def collisions(written: DataFrame) -> DataFrame:
    """(kind, entity) of entities whose surrogate another one, of lesser id, has too: empty if all is well."""
    known = written.select(F.explode("forms").alias("f")).select("f.*").distinct()
    shared = known.groupBy("kind", "form").agg(F.min("entity").alias("least"), F.count("*").alias("n")).filter("n > 1")
    return known.join(shared, ["kind", "form"]).filter("entity <> least").select("kind", "entity").distinct()


def pseudonymize(docs: DataFrame, key: bytes, *, make: Callable[[bytes], Keyed] = Keyed, rounds: int = 20) -> DataFrame:
    """doc_id, clean_text and its entities for every row of ``docs`` (doc_id, text).

    One pass without exchange; the check that surrogates are distinct reads the
    narrow list of entities.  Only if two entities share a surrogate are the texts
    that hold the later one read again, with a new key for it.
    """
    tables = Scratch(docs.sparkSession, "pii")
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    schema = f"doc_id long, clean_text string, entities {ENTITY}, print long, forms {FORMS}"
    none = F.lit(None).cast("array<struct<entity:string,tries:int>>")
    out = tables.keep(source.select("doc_id", "text", none.alias("tries"), "print").mapInArrow(_rewrite(key, make), schema), "clean", batch=500)
    tries = None
    for _ in range(rounds):
        moved = tables.keep(collisions(out).select("entity", F.lit(1).alias("tries")), "moved")
        if not moved.limit(1).count():
            return out.select("doc_id", "clean_text", "entities")
        tries = tables.keep(moved if tries is None else tries.unionByName(moved).groupBy("entity").agg(F.sum("tries").cast("int").alias("tries")), "tries")
        marks = out.select("print", F.explode("forms").alias("f")).select("print", "f.entity").distinct().join(tries, "entity")
        by_text = marks.groupBy("print").agg(F.collect_list(F.struct("entity", "tries")).alias("tries"))  # at most the entities of a text
        again = source.join(by_text, "print").select("doc_id", "text", "tries", "print").mapInArrow(_rewrite(key, make), schema)
        out = tables.keep(out.join(by_text.select("print"), "print", "left_anti").select("doc_id", "clean_text", "entities", "print", "forms").unionByName(again), "clean", batch=500)
    raise RuntimeError(f"surrogates are not distinct after {rounds} rounds")
