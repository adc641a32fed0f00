"""Personal data replaced by keyed surrogates of the same type, format, script and gender."""

from __future__ import annotations

import hashlib
import math
import os
import re
import secrets
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean, stored

#: Given names by script and gender. A surrogate is another name of its list.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Sofia Emma Julia Clara Elena Lucia Marta Carmen Isabel Paula Sandra Claire Sophie Camille Juliette Ingrid Katrin Sabine Ursula Heidi Susan Linda Emily Sarah Alice Helen Karen".split(),
    ("latin", "m"): "John Peter Thomas Daniel Martin Robert Michael David James William Carlos Miguel Pedro Javier Diego Pablo Pierre Jacques Olivier Antoine Laurent Hans Klaus Stefan Jürgen Wolfgang Dieter Matthias Frank George".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Владимир Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Αγγελική Γεωργία Δήμητρα Άννα".split(),
    ("greek", "m"): "Γεώργιος Δημήτριος Νικόλαος Ιωάννης Κωνσταντίνος Παναγιώτης Χρήστος Αλέξανδρος".split(),
}
#: Titles before a surname, by gender.
TITLES = {"f": "Mrs Ms Miss Frau Señora Sra Madame Mme Mademoiselle Госпожа Κυρία".split(), "m": "Mr Herr Señor Sr Monsieur Mister Господин Κύριος".split()}
#: Letters that stand for one another in a surrogate (in names vowels stay vowels); those of other scripts follow a rule.
ALPHABETS = {
    "digit": "0123456789", "hex": "0123456789abcdef",
    "latin": "abcdefghijklmnopqrstuvwxyz", "latin accents": "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "greek": "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώς",
}
#: Characters that a cipher takes at once: its rounds' hashes have 64 bytes.
BLOCK = 150
VOWELS = {"latin": "aeiouy", "latin accents": "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ", "cyrillic": "аеиоуыэюяё", "greek": "αεηιουωάέήίόύώ"}
#: Words before ``=`` or ``:`` that make what follows a secret, and characters of the longest.
_KEYWORD, KEYWORD = re.compile(r"(?i:token|secret|passw(?:or)?d|passwd|api[_-]?key|access[_-]?key|auth|credential)s?\Z"), 16
#: A secret stands between quotes, or runs to white space or to a quote that closes something around it.
_SECRET = re.compile(r"""(\s{0,3})(?:"((?:\\.|[^"\\\n])+)"|'((?:\\.|[^'\\\n])+)'|["']?((?:(?!["'](?:[\s,;:)}\]<>]|\Z))\S)+))""")
_SEPARATOR = re.compile("[=:]")
_KNOWN_KEY = re.compile(r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])")
_AT = re.compile(r"@[\w-]+(?:\.[\w-]+)+")
_CHUNK = re.compile(r"[+(\d][\d().\- /]{5,}")
_NUMBER = re.compile(
    r"(?<![\w.])(?:(?P<card>(?:\d{4}(?P<s>[ -]?)\d{4}(?P=s)\d{4}(?P=s)\d{1,7}|\d{4}(?P<t>[ -])\d{6}(?P=t)\d{5})(?!\w))"
    r"|(?P<ip>(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.\d))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4}(?!\w))"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\w)|\d{3}(?P<d>[-.])\d{3}(?P=d)\d{4}(?!\w)))"
)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_CAPITAL = "[" + "".join(c for c in map(chr, range(1 << 16)) if unicodedata.category(c) in ("Lu", "Lt")) + "]"
#: Words with a capital each, or one that others join to it: what has matched is not tried again, so that a run of any length takes linear time.
_NAME = re.compile(
    rf"{_CAPITAL}(?<!\w.)(?:(?:['-]*+\w++)*+\.?(?: (?:{_CAPITAL}(?:['-]*+\w++)++|{_CAPITAL}(?:\.|(?= {_CAPITAL}))|(?!I){_CAPITAL}(?!\w)))+"
    r"|\w*+(?:['-]++\w++)++)"
)
_INITIAL = re.compile(rf"{_CAPITAL}\.?")
_PART = re.compile("[^-]+")
#: Words that introduce a name of two words or more, and characters of the longest.
_CUE, CUE = re.compile(r"(?i:\b(?:name is|name:|i am|i'm|dear|signed|sincerely,?|regards,?|attn:?|attention:|nombre es|me llamo|name ist|ich heiße|m'appelle|nom est|меня зовут|με λένε))\s\Z"), 16
_GENDER = {n: g for (_, g), names in GIVEN.items() for n in names}
_LISTS = {n: key for key, names in GIVEN.items() for n in names}
_TITLE = {t: g for g, ts in TITLES.items() for t in ts}
#: Of these words, those that may begin a run of capitalised words themselves.
_OPENING = {"dear", "signed", "sincerely", "regards", "attn", "attention"}


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    value: str


def _names(text: str) -> Iterator[Entity]:
    for m in _NAME.finditer(text):
        words, at = m[0].split(" "), m.start()
        if len(words) == 1:
            continue
        place = []
        for w in words:
            place.append(at)
            at += len(w) + 1
        first = next((i for i, w in enumerate(words[:-1]) if w.rstrip(".") in _TITLE or _is_given(w)), None)
        told = first is None and bool(_CUE.search(text, max(0, m.start() - CUE), m.start()))
        if first is None and not told:
            told = len(words) > 2 and words[0].lower() in _OPENING
            if not told:
                continue
            first = 1
        first = first or 0
        while first and _INITIAL.fullmatch(words[first - 1]):
            first -= 1
        for i in range(first, len(words)):
            if _INITIAL.fullmatch(words[i]):
                yield Entity(place[i], place[i] + 1, "initial", words[i][0])
            elif i < len(words) - 1 and (told or _is_given(words[i])):
                for m in _PART.finditer(words[i]):
                    yield Entity(place[i] + m.start(), place[i] + m.end(), "given", m[0])
            elif words[i].rstrip(".") not in _TITLE:
                yield Entity(place[i], place[i] + len(words[i]), "surname", words[i])


def _is_given(word: str) -> bool:
    """A listed given name, alone or joined to others, as it is or in capitals."""
    return any(p in _LISTS or (p.isupper() and len(p) > 2 and p.title() in _LISTS) for p in word.split("-"))


def _secrets(text: str) -> Iterator[Entity]:
    """What follows a keyword; a short plain word or number after a space, as in prose, only if the keyword is a password's."""
    at = 0
    for sep in _SEPARATOR.finditer(text):
        if sep.start() < at:
            continue
        end = sep.start()
        while end > at and text[end - 1].isspace():
            end -= 1
        end -= end > at and text[end - 1] in "\"'"
        keyword = _KEYWORD.search(text, max(at, end - KEYWORD), end)
        m = keyword and _SECRET.match(text, sep.end())
        if not m:
            continue
        start, end = m.span(m.lastindex)
        bare = m.lastindex == 4
        if bare:
            end = start + len(text[start:end].rstrip(".,;:!?)]}>\"'"))
        value = text[start:end]
        if not any(map(str.isalnum, value)):
            continue
        if len(value) < 12 and ("\n" in m[1] or (bare and (m[1] or sep[0] == ":") and not keyword[0].lower().startswith("passw") and (value.isalpha() or not any(map(str.isalpha, value))))):
            continue
        yield Entity(start, end, "secret", value)
        at = end


def find(text: str | None) -> list[Entity]:
    """Entities of a text in order, without overlaps: the first to start stays, of those the longest."""
    if not text:
        return []
    out: list[Entity] = []
    if "@" in text:
        done = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > done and ((c := text[start - 1]).isalnum() or c in "._+%-"):
                start -= 1
            if start < m.start():
                out.append(Entity(start, m.end(), "email", text[start : m.end()]))
            done = m.end()
    for c in _CHUNK.finditer(text):
        for m in _NUMBER.finditer(text, c.start(), c.end()):
            kind = m.lastgroup
            if m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] == "_"):
                continue
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            out.append(Entity(m.start(), m.end(), kind, m[0]))
    out += _secrets(text)
    if "AKIA" in text or "gh" in text:
        out += [Entity(m.start(), m.end(), "secret", m[0]) for m in _KNOWN_KEY.finditer(text)]
    out += [Entity(m.start(), m.end(), "iban", m[0]) for m in _IBAN.finditer(text) if sum(x.isdigit() for x in m[0]) >= 8 and not (m.start() and text[m.start() - 1].isalnum())]
    out += _names(text)
    out.sort(key=lambda e: (e.start, -e.end))
    kept, at = [], 0
    for e in out:
        if e.start >= at:
            kept.append(e)
            at = e.end
    return kept


def canonical(e: Entity) -> str:
    """What makes two mentions the same entity: letters of either case are one."""
    low = e.value.lower()
    return low if len(low) == len(e.value) else e.value


def shift(key: bytes, tweak: str, x: int, size: int) -> int:
    """A keyed permutation of 0 .. size - 1 in which nothing stays in place (if size > 1).

    It is a walk of one step on a secret cycle: a Feistel cipher maps x to its
    place on the cycle, and back from the next place.
    """
    bits = max(2, (size - 1).bit_length())
    left, right = bits - bits // 2, bits // 2

    def f(i: int, v: int, width: int) -> int:
        raw = f"{tweak}|{i}|{bits}|{v}".encode()
        return int.from_bytes(hashlib.blake2b(raw, key=key, digest_size=max(8, width // 8 + 1)).digest(), "big") & ((1 << width) - 1)

    def once(v: int, back: bool) -> int:
        a, b = v >> right, v & ((1 << right) - 1)
        for i in range(7, -1, -1) if back else range(8):
            if i % 2:
                b ^= f(i, a, right)
            else:
                a ^= f(i, b, left)
        return a << right | b

    def walk(v: int, back: bool) -> int:
        v = once(v, back)
        while v >= size:
            v = once(v, back)
        return v

    return walk((walk(x, False) + 1) % size, True) if size > 1 else x


@lru_cache(100_000)
def _alphabet(c: str, names: bool, hexed: bool) -> str:
    """The characters that may stand for ``c``, itself among them; empty for separators and marks.

    Letters outside ALPHABETS are exchanged with those of their 128 code points
    that are of the same category, case and (in names) kind of sound; digits
    with those of their script. Each of these characters has the same list.
    """
    for kind in (("hex",) if hexed else ("digit", "latin", "latin accents", "cyrillic", "greek")):
        if c in ALPHABETS[kind]:
            if names and kind in VOWELS:
                return "".join(x for x in ALPHABETS[kind] if (x in VOWELS[kind]) == (c in VOWELS[kind]))
            return ALPHABETS[kind]
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if not c.isalpha():
        return ""

    def nature(x: str) -> tuple:
        return unicodedata.category(x), x.lower() == x, x.upper() != x and len(x.upper()) == 1 and x.upper().lower() == x, names and unicodedata.normalize("NFD", x)[0] in "aeiouy"

    block = map(chr, range(ord(c) & ~127, (ord(c) | 127) + 1))
    return "".join(x for x in block if x.isalpha() and nature(x) == nature(c) and not any(x in abc for abc in ALPHABETS.values()))


def _letters(value: str, fixed: set[int], names: bool, hexed: bool) -> list[tuple[int, str]]:
    """(place, alphabet) of the characters that may change."""
    return [(i, abc) for i, c in enumerate(value) if i not in fixed and (abc := _alphabet(c, names, hexed))]


def _luhn(digits: list[int]) -> int:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10


def _mod_97(iban: str) -> int:
    x = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def _octets(value: str) -> list[range]:
    return [{1: range(10), 2: range(10, 100), 3: range(100, 256)}.get(len(o), range(256)) if str(int(o)) == o else range(int(o), int(o) + 1) for o in value.split(".")]


def _ciphered(key: bytes, tweak: str, value: str, free: list[tuple[int, str]]) -> str:
    """A permutation of the values of a format: long ones in blocks, each under a tweak of those before it."""
    template = list(value)
    for i, abc in free:
        template[i] = abc[0]
    tweak += "|" + "".join(template)
    for at in range(0, len(free) or 1, BLOCK):
        block = free[at : at + BLOCK]
        x, size = 0, 1
        for i, abc in block:
            x, size = x * len(abc) + abc.index(value[i]), size * len(abc)
        before = "".join(value[i] for i, _ in free[:at])
        x = shift(key, tweak + ("|" + hashlib.blake2b(before.encode(), key=key).hexdigest() if at else ""), x, size)
        for i, abc in reversed(block):
            x, r = divmod(x, len(abc))
            template[i] = abc[r]
    return "".join(template)


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The replacement of a canonical value, which it never equals.

    A value without a character that can change (as one of marks only) gets a
    keyed name of its kind instead of a value of its format.
    """
    out = _same_format(key, kind, value, attempt)
    return out if out != value else f"{kind}-{hashlib.blake2b(f'{kind}|{attempt}|{value}'.encode(), key=key, digest_size=12).hexdigest()}"


def form_of(kind: str, value: str) -> tuple[str, float]:
    """A value's format, and about how many values it has."""
    free = _letters(value, set(), kind in ("given", "surname", "initial"), False)
    shape = list(value)
    for i, abc in free:
        shape[i] = abc[0]
    return f"{kind}|{''.join(shape)}", 1.0 if kind in ("given", "initial") else float(math.prod(len(abc) for _, abc in free[:60]))


def _same_format(key: bytes, kind: str, value: str, attempt: int) -> str:
    """A replacement of the same format, where it has more values than one.

    For a kind, a format and an attempt it is a permutation of the values of
    that format without a fixed point: different entities get different
    replacements, and one entity always the same. What makes the format stays:
    separators, lengths, a phone number's country code and exchange 555, an
    email's top domain, a card number's check digit, an address' octet widths, a
    name's vowels and consonants.
    """
    tweak = f"{kind}|{attempt}"
    if kind == "given":
        own = value.title() if value.title() in _LISTS else next((n for n in _LISTS if n.lower() == value), None)
        if own is None:
            return _ciphered(key, tweak, value, _letters(value, set(), True, False))
        names = GIVEN[_LISTS[own]]
        return names[shift(key, f"{tweak}|{_LISTS[own]}", names.index(own), len(names))].lower()
    if kind in ("surname", "initial"):
        return _ciphered(key, tweak, value, _letters(value, set(), True, False))
    if kind == "ip":
        spans = _octets(value)
        x, size = 0, 1
        for o, s in zip(value.split("."), spans, strict=True):
            x, size = x * len(s) + int(o) - s.start, size * len(s)
        x = shift(key, tweak + "|" + ".".join(f"{s.start}-{s.stop}" for s in spans), x, size)
        out = []
        for o, s in reversed([*zip(value.split("."), spans, strict=True)]):
            x, r = divmod(x, len(s))
            out.append(o if len(s) == 1 else str(s.start + r))
        return ".".join(reversed(out))
    if kind == "email":
        local, _, domain = value.rpartition("@")
        top = domain.rfind(".")
        host = _ciphered(key, f"domain|{attempt}", domain, _letters(domain, set(range(top, len(domain))), False, False))
        return _ciphered(key, tweak + "|" + domain, local, _letters(local, set(), False, False)) + "@" + host
    fixed: set[int] = set()
    if kind == "phone":
        if m := re.match(r"\+\d{1,3}(?=[ .(-])", value):
            fixed |= set(range(m.end()))
        if m := re.search(r"(?<!\d)555(?=[-. ]\d{4}\Z)", value):
            fixed |= set(range(m.start(), m.end()))
    if kind == "iban":
        fixed |= {0, 1}
        if value.isascii() and _mod_97(value) == 1:  # a valid one stays valid
            out = _ciphered(key, tweak + "|97", value[:2] + "00" + value[4:], _letters(value, fixed | {2, 3}, False, False))
            return out[:2] + f"{98 - _mod_97(out):02d}" + out[4:]
    if kind == "card" and value.isascii():
        at = [i for i, c in enumerate(value) if c.isdigit()]
        if _luhn([int(value[i]) for i in at]) == 0:  # a valid number stays valid
            out = _ciphered(key, tweak + "|luhn", value[: at[-1]] + "0" + value[at[-1] + 1 :], _letters(value, fixed | {at[-1]}, False, False))
            digit = -_luhn([int(out[i]) for i in at]) % 10
            return out[: at[-1]] + str(digit) + out[at[-1] + 1 :]
    hexed = kind == "secret" and len(value) >= 16 and all(c in ALPHABETS["hex"] for c in value) and not value.isdigit()
    return _ciphered(key, tweak, value, _letters(value, fixed, False, hexed))


def cased(value: str, like: str) -> str:
    """A surrogate in the letter case of the mention it replaces."""
    if like.isupper() and len(like) > 1:
        return value.upper()
    if len(value) == len(like):
        return "".join(u if (u := v.upper()) and len(u) == 1 and x.isupper() else v for v, x in zip(value, like, strict=True))
    return value.title() if like[:1].isupper() else value


def replaced(text: str, key: bytes, redrawn: dict[tuple[str, str], int], cache: dict[tuple[str, str], str]) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and where these stand: (start, end, kind)."""
    out, spans, at, n = [], [], 0, 0
    for e in find(text):
        own = e.kind, canonical(e)
        s = cache.get(own)
        if s is None:
            if len(cache) > 50_000:
                cache.clear()
            s = cache[own] = surrogate(key, *own, redrawn.get(own, 0))
        s = cased(s, e.value)
        out += [text[at : e.start], s]
        n += e.start - at
        spans.append((n, n + len(s), e.kind))
        n += len(s)
        at = e.end
    out.append(text[at:])
    return "".join(out), spans


#: A surrogate isn't an entity of the corpus where the corpus has less than this share of a format's values.
SPARSE = 1e-4


def collisions(docs: DataFrame, key: bytes, text: str = "text", most: int = 1_000_000, draws: int = 100) -> dict[tuple[str, str], int]:
    """Attempts of entities whose surrogate would be another's, or an entity of the corpus itself: as a rule few or none.

    All different entities of the corpus get their surrogates. Where two agree
    (two kinds may read alike), all but the smallest draw again. So does an
    entity whose surrogate really is in the corpus, in formats of which the
    corpus has a share under SPARSE (parts of names are common words, and in a
    crowded format any value may be somebody's). It goes on until nothing
    agrees; an entity that has drawn ``draws`` times, or over ``most`` entries, raise
    an error that says to use another key.
    """

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = sorted({(e.kind, canonical(e)) for t in pdf["text"] for e in find(t)})
            if got:
                yield pd.DataFrame([(*x, *form_of(*x)) for x in got], columns=["kind", "value", "form", "room"])

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(surrogate=[surrogate(key, *x) for x in zip(pdf["kind"], pdf["value"], pdf["attempt"], strict=True)])

    every = stored(docs.select(F.col(text).alias("text")).mapInPandas(lean(seen), "kind string, value string, form string, room double").distinct(), "entities")
    sparse = every.groupBy("form").agg(F.count("*").alias("n"), F.first("room").alias("room")).where(F.col("n") < F.col("room") * SPARSE).select("form", F.lit(True).alias("sparse"))
    real = every.where("kind not in ('given', 'initial')").select(F.col("value").alias("surrogate")).distinct()
    rows = every.join(sparse, "form", "left").select("kind", "value", F.coalesce("sparse", F.lit(False)).alias("sparse"), F.lit(0).alias("attempt"))
    schema = "kind string, value string, sparse boolean, attempt int, surrogate string"
    rows = stored(rows.mapInPandas(drawn, schema), "surrogates")
    while True:
        least = rows.groupBy("surrogate").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "kind", "value")).alias("first")).where("n > 1").select("surrogate", "first")
        twice = rows.join(least, "surrogate").where(F.struct("attempt", "kind", "value") != F.col("first")).select("kind", "value")
        taken = rows.where("sparse").join(real, "surrogate", "left_semi").select("kind", "value")
        clash = stored(twice.unionByName(taken).distinct(), "collisions")
        if clash.isEmpty():
            break
        again = rows.join(clash, ["kind", "value"]).select("kind", "value", "sparse", (F.col("attempt") + 1).alias("attempt"))
        if not again.where(F.col("attempt") > draws).isEmpty():
            raise RuntimeError("some surrogates agree however often they are drawn: use another key")
        rows = stored(rows.join(clash, ["kind", "value"], "left_anti").unionByName(again.mapInPandas(drawn, schema)), "surrogates")
    redrawn = rows.where("attempt > 0")
    if redrawn.count() > most:
        raise RuntimeError("too many surrogates agree: use another key")
    return {(r.kind, r.value): r.attempt for r in redrawn.collect()}


#: The setting of a session, and the variable of the environment, that may hold the key.
SETTING, VARIABLE = "spark.gridloom.surrogates.key", "GRIDLOOM_SURROGATES_KEY"
_OWN: dict[str, bytes] = {}


def secret_key(spark: SparkSession) -> bytes:
    """The key that the session's setting or the driver's environment gives, else a random one of this application.

    Surrogates can be turned back with the key, so none is in the code. Runs
    agree with one another only where a key is given.
    """
    given = spark.conf.get(SETTING, None) or os.environ.get(VARIABLE)
    if given:
        return hashlib.blake2b(given.encode()).digest()
    return _OWN.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def pseudonymise(docs: DataFrame, key: bytes | None = None, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``pii``: array of (start, end, kind) of each surrogate.

    Found are emails, phone numbers, IPv4 addresses, card numbers, social
    security numbers, IBANs, secrets after a keyword (to white space or the closing
    quote), and names: from a known given name or a title, all given names,
    initials and surnames of the capitalised words that follow one another (a
    lower-case particle ends a name), and all of them after words that introduce
    a name. Capitals and digits are those of any script. ``key`` is that of
    secret_key() if None. An entity has the same surrogate in all
    rows, in the letter case of each mention, and different entities have
    different ones. Each row gives one row, repeated ones alike; other columns
    stay (one named ``pii`` is replaced). A null text stays null with no
    entities; texts without entities stay as they are; whole texts are searched.
    """
    bounded_batches(docs.sparkSession)
    key = secret_key(docs.sparkSession) if key is None else key
    sent = docs.sparkSession.sparkContext.broadcast(collisions(docs, key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[tuple[str, str], str] = {}
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts, spans = [], []
                for t in b.column("text").to_pylist():
                    new, where = (None, []) if t is None else replaced(t, key, sent.value, cache)
                    texts.append(new)
                    spans.append([{"start": a, "end": e, "kind": k} for a, e, k in where])
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["row", "text", "pii"])

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "pii")]
    base = docs.select(F.struct(*rest, F.lit(0).alias("__")).alias("row"), F.col(text).alias("text"))
    out = base.mapInArrow(lean(run), f"row {base.schema['row'].dataType.simpleString()}, text string, pii array<struct<start:int,end:int,kind:string>>")
    cols = [F.col("text").alias(text) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c != "pii"]
    return out.select(*cols, "pii")
