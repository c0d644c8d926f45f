"""Surrogates for personal data: keyed, type-consistent replacements of detected entities.

An entity's characters are read as digits of a mixed-radix number (decimal digits, letters by case and script, address
bytes, ...), which a keyed Feistel network permutes. So a surrogate keeps type, script, length and layout; equal
entities get equal surrogates everywhere without any table, different ones never meet, and none is its own surrogate.
Check digits are computed anew. Names keep their title and last vowel, hence their gender, and letters stay vowels or
consonants. The words of a name that a document shows after a title are replaced everywhere in it, by the same
surrogates, unless the document also uses the word in lower case. ``check_distinct`` counts entities against surrogates over the whole corpus.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 6

# Alphabets: a character is permuted among those of its own.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = "0123456789abcdef"
LEADING = "23456789"
NOT_LEADING = "01"
HEX_LEADING = "123456789abcdef"
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
ACCENTED_VOWELS = "àáâãäåèéêëìíîïòóôõöøùúûüýÿ"
CYRILLIC_VOWELS, CYRILLIC_CONSONANTS = "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщъь"
GREEK_VOWELS, GREEK_CONSONANTS = "αεηιουω", "βγδζθκλμνξπρστφχψ"

# Letters of scripts without case, by their ranges.
UNCASED = ["".join(map(chr, range(a, b + 1))) for a, b in (
    (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x0621, 0x063A), (0x0641, 0x064A), (0x05D0, 0x05EA), (0x0904, 0x0939))]

TITLES = r"(?:Mr|Mrs|Ms|Mx)\.|\bMiss|Herrn?|Frau|Mme|Mlle|Monsieur|Madame|Señora?|г-н|г-жа|Κύριος|Κυρία"
#: A letter that is no small one.
_CAPITAL = r"[^\W\d_a-zß-ÿα-ωά-ώа-џ]"
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]+@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w-])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "vendor_key": r"(?<![\w-])(?:gh[opsur]_[0-9A-Za-z]{20,}|github_pat_[0-9A-Za-z_]{20,}|glpat-[\w-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[\w-]{35})(?![\w-])",
    "login": r"(?<=://)[^\s/:@]*:(?P<login>[^\s/@]+)@",
    "bearer": r"(?i:\bbearer)\s+(?=[^\s]*[0-9])(?P<bearer>[\w.~+/-]{16,}=*)",
    "secret": r"""(?i:(?<![^\W_])(?:token|password|passwd|passphrase|pwd|secret|api[_-]?key)\b)\s*(?:[=:]|is\s(?=\s*["']?[^\s"']*[0-9]))\s*["']?(?P<secret>[^\s"']{8,})["']?""",
    "address6": r"(?:(?<![\w:.])|(?<=[g-zG-Z]:))(?=[:A-Fa-f]*[0-9])(?=[0-9A-Fa-f:]*::|(?:[0-9A-Fa-f]{1,4}:){7})(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])",
    "address": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[.-])[0-9]{3,4}[ .-][0-9]{3,4}(?!\w)|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?!\w)|(?<![\w+])(?<![0-9][ .-])(?:[2-9][0-9]{2} [0-9]{3} [0-9]{4}|0[0-9]{2,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4})(?!\w|[ .-][0-9])",
    "card": r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])",
    "name": rf"(?<!\w)(?:{TITLES})[ \u00a0](?P<name>{_CAPITAL}[\w'’-]+(?:[ \u00a0]{_CAPITAL}[\w'’-]+){{0,2}})",
}
#: Literals of which a text holds one if it holds such an entity; in any case for the last two.
_HINTS = {
    "email": ("@",),
    "access_key": ("AKIA", "ASIA"),
    "vendor_key": ("gho_", "ghp_", "ghs_", "ghu_", "ghr_", "github_pat_", "glpat-", "xox", "AIza"),
    "login": ("://",),
    "name": ("Mr.", "Mrs.", "Ms.", "Mx.", "Miss", "Herr", "Frau", "Mme", "Mlle", "Monsieur", "Madame", "Señor", "г-н", "г-жа", "Κύριος", "Κυρία"),
    "bearer": ("bearer",),
    "secret": ("token", "password", "passwd", "passphrase", "pwd", "secret", "api"),
}
_FOLDED = ("bearer", "secret")
_DIGIT = re.compile("[0-9]")
#: Kinds whose entity is a part of the match.
_PART = ("secret", "name", "bearer", "login")
_VENDOR = re.compile("gh[opsur]_|github_pat_|glpat-|xox[abprs]-|AIza")
#: Between the digit groups of a match that was none after all, a hyphen is a border too.
_LOOSE = {k: p.replace(r"(?<![\w-])", r"(?<!\w)").replace(r"(?![\w-])", r"(?!\w)") if k in ("ssn", "card") else p for k, p in PATTERNS.items()}
_WORD = re.compile(r"[^\W\d_][\w'’-]*")
_ONE = {k: re.compile(p) for k, p in _LOOSE.items()}


def _kinds(text: str) -> tuple[str, ...]:
    """Kinds of entities that the text may hold: the others need a literal or a digit that it lacks."""
    folded, digit = text.casefold().replace("ı", "i"), _DIGIT.search(text) is not None

    def possible(kind: str) -> bool:
        if kind not in _HINTS:
            return digit and (kind != "address6" or ":" in text)
        return any(h in (folded if kind in _FOLDED else text) for h in _HINTS[kind])

    return tuple(filter(possible, PATTERNS))


@lru_cache(maxsize=None)
def _finders(kinds: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern]:
    """Search for any of the kinds, and the same within a match that was none after all."""
    plain, loose = ("|".join(f"(?P<k_{kind}>{patterns[kind]})" for kind in kinds) for patterns in (PATTERNS, _LOOSE))
    return re.compile(plain), re.compile(loose)


class Permutation:
    """Keyed permutation, without fixed points, of numbers in any mixed radix."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _draw(self, tweak: bytes, turn: int, value: int, below: int) -> int:
        data = tweak + bytes([turn]) + value.to_bytes((value.bit_length() + 7) // 8, "big")
        size = (below.bit_length() + 7) // 8 + 8  # 64 bits beyond the range, so that no value is favoured
        out = b"".join(hashlib.blake2b(data + bytes([k]), key=self.key).digest() for k in range(-(-size // 64)))
        return int.from_bytes(out[:size], "big") % below

    def apply(self, digits: list[int], radices: list[int], tweak: bytes) -> list[int]:
        """Encrypt, count one further, decrypt: a permutation that leaves no number where it is."""
        if not digits:
            return []
        half = (len(digits) + 1) // 2
        sizes = [1, 1]
        values = [0, 0]
        for i, (d, r) in enumerate(zip(digits, radices)):
            side = int(i >= half)
            values[side] = values[side] * r + d
            sizes[side] *= r
        for turn in range(ROUNDS):
            a = turn % 2
            values[a] = (values[a] + self._draw(tweak, turn, values[1 - a], sizes[a])) % sizes[a]
        whole = (values[0] * sizes[1] + values[1] + 1) % (sizes[0] * sizes[1])
        values = [whole // sizes[1], whole % sizes[1]]
        for turn in reversed(range(ROUNDS)):
            a = turn % 2
            values[a] = (values[a] - self._draw(tweak, turn, values[1 - a], sizes[a])) % sizes[a]
        out = [0] * len(digits)
        for i in reversed(range(len(digits))):
            side = int(i >= half)
            values[side], out[i] = divmod(values[side], radices[i])
        return out


def _spell(p: Permutation, kind: str, text: str, alphabets: list[str], keep: set[int] = frozenset(),
           lead: set[int] = frozenset(), leading: tuple[str, ...] = (LEADING, NOT_LEADING)) -> str:
    """``text`` with every character of an alphabet permuted among it; ``keep`` stay, those at ``lead`` have alphabets of their own."""
    digits, radices, places = [], [], []
    for i, c in enumerate(text):
        own = leading if i in lead else alphabets
        found = next((a for a in own if c in a), None) if i not in keep else None
        if found:
            digits.append(found.index(c))
            radices.append(len(found))
            places.append((i, found))
    fixed = list(text)
    for i, _ in places:
        fixed[i] = "\0"
    layout = "".join(fixed) + "|" + ",".join(map(str, radices))
    for (i, found), d in zip(places, p.apply(digits, radices, f"{kind}|{layout}|".encode())):
        fixed[i] = found[d]
    return "".join(fixed)


def luhn_digit(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_ok(value: str) -> bool:
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _recased(source: str, lowered: str) -> str:
    return "".join(x.upper() if s.isupper() else x for s, x in zip(source, lowered)) if len(source) == len(lowered) else lowered


def _refill(layout: str, characters: str) -> str:
    """``characters`` poured into the letters and digits of ``layout``."""
    it = iter(characters)
    return "".join(next(it) if c.isalnum() else c for c in layout)


def surrogate(p: Permutation, kind: str, value: str) -> tuple[str, str, str] | None:
    """(canonical entity, canonical surrogate, surrogate as written), or None if it is no such entity after all."""
    if kind == "email":
        canonical = value.lower()
        dot = canonical.rindex(".")
        alphabets = [DIGITS, LOWER, ACCENTED, GREEK, CYRILLIC, *UNCASED]
        out = _spell(p, kind, canonical[:dot], alphabets) + canonical[dot:]
        return (canonical, out, _recased(value, out)) if out != canonical else None
    if kind == "card":
        digits = re.sub(r"[ -]", "", value)
        if luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        body = digits[0] + _spell(p, kind, digits[1:-1], [DIGITS])
        out = body + str(luhn_digit(body))
        return digits, out, _refill(value, out)
    if kind == "address":
        octets = [int(x) for x in value.split(".")]
        out = ".".join(map(str, p.apply(octets, [256] * 4, b"address")))
        return ".".join(map(str, octets)), out, out
    if kind == "address6":
        try:
            canonical = ipaddress.IPv6Address(value).compressed
        except ValueError:
            return None
        groups = [g for g in canonical.split(":") if g]
        # Times of day and scoped names have fewer groups; loopback and the like are nobody's.
        if len(groups) < 2 or (len(groups) == 2 and len(groups[0]) < 4):
            return None
        starts = {m.start() for m in re.finditer(r"(?<![0-9a-f])[0-9a-f]", canonical)}
        out = _spell(p, kind, canonical, [HEX], lead=starts, leading=(HEX_LEADING,))
        return canonical, out, out.upper() if value.isupper() else out
    if kind == "phone":
        # The country code stays; the rest is the number, however it is written.
        head = re.match(r"\+[0-9]{1,3}(?=[ .(-])|", value).group()
        number = re.sub(r"[^0-9]", "", value[len(head):])
        if not 7 <= len(number) <= 15:
            return None
        # Ten digits are area, exchange and line: the first two begin with 2 to 9.
        # A trunk zero stays.
        lead = {0, 3} if len(number) == 10 else frozenset()
        out = _spell(p, kind, number, [DIGITS], {0} if number[0] == "0" and not lead else frozenset(), lead)
        return head + number, head + out, head + _refill(value[len(head):], out)
    if kind == "ssn":
        out = _spell(p, kind, value, [DIGITS])
        return value, out, out
    if kind == "iban":
        if not iban_ok(value):
            return None
        canonical = value.replace(" ", "")
        body = _spell(p, kind, canonical[4:], [DIGITS, UPPER])
        check = 98 - int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00")) % 97
        out = f"{canonical[:2]}{check:02d}{body}"
        return canonical, out, _refill(value, out)
    if kind == "name":
        words = re.split("([ \u00a0])", value)
        made = [w if w.isspace() else _name(p, w) for w in words]
        out = "".join(made)
        return (value.lower(), out.lower(), out) if out != value else None
    prefix = _VENDOR.match(value) if kind == "vendor_key" else None
    keep = set(range(prefix.end() if prefix else 4 if kind == "access_key" else 0))
    alphabets = [HEX] if kind == "secret" and not set(value) - set(HEX) else [DIGITS, LOWER, UPPER]
    out = _spell(p, kind, value, alphabets, keep)
    return (value, out, out) if out != value else None


def _name(p: Permutation, word: str) -> str:
    # A capital without a single small letter stays as it is.
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in word)
    vowels = VOWELS + ACCENTED_VOWELS + CYRILLIC_VOWELS + GREEK_VOWELS
    keep = {len(low) - 1} if low[-1] in vowels and len(low) > 2 else set()
    alphabets = [VOWELS, CONSONANTS, ACCENTED_VOWELS, CYRILLIC_VOWELS, CYRILLIC_CONSONANTS, GREEK_VOWELS, GREEK_CONSONANTS, *UNCASED]
    return _recased(word, _spell(p, "name", low, alphabets, keep))


def _other(p: Permutation, text: str, start: int, rejected: str) -> tuple[str, int, tuple[str, str, str] | None]:
    """(kind, end, surrogate) of the entity at ``start`` behind a rejected match: shorter ones of its kind, then later kinds.

    Only kinds that can be rejected are searched for shorter ones; they end where a group of letters or digits does.
    """
    kinds = list(PATTERNS)
    for kind in kinds[kinds.index(rejected):]:
        m = _ONE[kind].match(text, start)
        if not m:
            continue
        if kind in _PART:  # begin with a word of their own, where nothing that is rejected can
            continue
        ends = [m.end()]
        if kind in ("card", "iban", "phone"):
            ends += [e for e in range(m.end() - 1, start, -1) if not re.match(r"\w", text[e])]
        for end in ends:
            if _ONE[kind].fullmatch(text, start, end):
                made = surrogate(p, kind, text[start:end])
                if made is not None:
                    return kind, end, made
    return rejected, start, None


def replace_entities(p: Permutation, text: str) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and its entities as (kind, canonical, surrogate)."""
    kinds = _kinds(text)
    if not kinds:
        return text, []
    find, within = _finders(kinds)
    spans: list[tuple[int, int, str, tuple[str, str, str]]] = []
    place = inside = 0
    while True:
        m = (within if place < inside else find).search(text, place)
        if m and place < inside <= m.start():
            m = find.search(text, place)
        if not m:
            break
        kind = next(k for k in kinds if m.group(f"k_{k}") is not None)
        start, end = m.span(kind) if kind in _PART else m.span()
        place = m.end()
        if kind == "name" and text[start:end].endswith(("'s", "’s")):
            end -= 2
        made = surrogate(p, kind, text[start:end])
        if made is None:
            # No such entity: others may begin here, or anywhere within.
            inside = max(inside, m.end())
            kind, end, made = _other(p, text, m.start(), kind)
            place = end if made else m.start() + 1
        if made is not None:
            spans.append((start, end, kind, made))
    spans = sorted(spans + _mentions(p, text, spans), key=lambda e: e[0])
    parts, at = [], 0
    for start, end, _, made in spans:
        parts += [text[at:start], made[2]]
        at = end
    return "".join([*parts, text[at:]]), [(kind, made[0], made[1]) for _, _, kind, made in spans]


def _mentions(p: Permutation, text: str, spans: list[tuple[int, int, str, tuple[str, str, str]]]) -> list[tuple]:
    """Spans, outside of ``spans``, where words of the names among these stand again, as written or in capitals."""
    names = {w for start, end, kind, _ in spans if kind == "name" for w in re.split("[ \u00a0]", text[start:end]) if len(w) > 2}
    if not names:
        return []
    forms = {f for w in names for f in (w, w.upper())}
    lowered = {w.lower() for w in names}
    common = {m.group() for m in _WORD.finditer(text) if m.group() in lowered}
    taken, k, found = sorted((s, e) for s, e, _, _ in spans), 0, []
    for m in _WORD.finditer(text):
        start, word = m.start(), m.group()
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < m.end():
            continue
        word = word[:-2] if word.endswith(("'s", "’s")) and word not in forms else word.rstrip("'’-")
        if word in forms and word.lower() not in common:
            made = surrogate(p, "name", word)
            if made is not None:
                found.append((start, start + len(word), "name", made))
    return found


OUT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("entities", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("entity", T.StringType()), T.StructField("surrogate", T.StringType())]))),
])


def surrogates(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``, with surrogates in its text) and ``entities``.

    NULL text stays NULL, with none. ``n_chars``, where there is such a column, follows the text.
    """

    @F.pandas_udf(OUT)
    def cleaned(texts: pd.Series) -> pd.DataFrame:
        p = Permutation(key.encode())
        done = [(None, []) if t is None else replace_entities(p, t) for t in texts]
        return pd.DataFrame({"text": [d[0] for d in done], "entities": [d[1] for d in done]})

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("made.text").alias(c)
        if c == "n_chars":
            n = F.length("made.text").cast(docs.schema[c].dataType)
            return F.coalesce(n, F.col("row.n_chars")).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), cleaned(F.col(text_col)).alias("made"))
    return whole.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), F.col("made.entities").alias("entities"))


def check_distinct(made: DataFrame) -> int:
    """Number of different entities; an error if two share a surrogate, or one has several, anywhere in the corpus.

    A pass of its own, of which only entities leave the tasks: surrogates depend on key and entity alone, so what it
    finds holds for any later pass, and no second copy of the texts has to be stored in between.
    """
    # The outer form: the inner one would add a filter that finds all entities a second time.
    each = made.select(F.explode_outer("entities").alias("e")).select("e.kind", "e.entity", "e.surrogate").distinct()
    pairs = each.where("kind IS NOT NULL")
    n, entities, images = pairs.agg(
        F.count("*"), F.count_distinct("kind", "entity"), F.count_distinct("kind", "surrogate")).first()
    if not n == entities == images:
        raise ValueError(f"{entities} entities have {images} surrogates in {n} pairs")
    return n


def report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, n_entities, kinds``: every whole text with its surrogates, after the collision check."""
    made = surrogates(docs.select(id_col, text_col), key, text_col)
    check_distinct(made)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",")
    return made.select("row.*", F.size("entities").cast("bigint").alias("n_entities"), kinds.alias("kinds"))


def masked(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in its texts, all columns kept, after the collision check."""
    made = surrogates(docs, key, text_col)
    check_distinct(made)
    return made.select("row.*")
