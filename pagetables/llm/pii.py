"""Personal data: detected entities and keyed surrogates of the same type and format.

A surrogate is a keyed permutation of the entity within its format (letters stay letters,
digits digits, a valid checksum stays valid), so equal entities get equal surrogates in every
document and different ones get different surrogates. Names are drawn from pools by gender and
script; there, and where a surrogate is itself somebody's data, a check over all entities
finds collisions and draws again.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm import numtext as nt
from pagetables.llm.common import cut

ROUNDS = 8
#: Redrawn entities are broadcast up to this many; more are joined.
BROADCAST_ROWS = 50_000
SALTS = 16
#: Longest run of characters that one permutation takes.
PIECE = 512

# Titles that mark a name, by gender.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Mlle", "Señora", "Sra", "Госпожа", "Κυρία"],
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
    "n": ["Dr", "Prof"],
}
# Given names for surrogates, by script and gender.
GIVEN = {
    ("LATIN", "f"): ["Anna", "Clara", "Elena", "Ida", "Julia", "Laura", "Marta", "Nina", "Paula", "Sofia"],
    ("LATIN", "m"): ["Adam", "Bruno", "David", "Felix", "Hugo", "Leo", "Martin", "Oscar", "Paul", "Victor"],
    ("LATIN", "n"): ["Alex", "Charlie", "Jules", "Kim", "Robin", "Sam", "Sascha", "Toni"],
    ("CYRILLIC", "f"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Ольга"],
    ("CYRILLIC", "m"): ["Антон", "Борис", "Иван", "Олег", "Пётр", "Сергей"],
    ("CYRILLIC", "n"): ["Саша", "Женя", "Валя", "Слава"],
    ("GREEK", "f"): ["Άννα", "Ελένη", "Μαρία", "Σοφία"],
    ("GREEK", "m"): ["Γιώργος", "Νίκος", "Πέτρος", "Σπύρος"],
    ("GREEK", "n"): ["Αλέξης", "Φώτης"],
}
# Syllables for surrogate family names, by script.
SYLLABLES = {
    "LATIN": ["ba", "den", "fal", "gor", "hem", "kin", "lo", "mar", "nes", "pol", "rus", "sten", "tal", "ver", "win", "zel"],
    "CYRILLIC": ["ба", "вер", "гор", "дан", "зел", "кин", "лов", "мар", "нов", "пол", "рус", "тал"],
    "GREEK": ["βα", "γορ", "δεν", "καλ", "λο", "μαρ", "νι", "πολ", "ρου", "ταλ"],
}

# Small words within names.
PARTICLES = ["al", "bin", "da", "de", "del", "della", "den", "der", "di", "dos", "du", "el", "ibn", "la", "le", "ten", "ter", "van", "von", "zu", "zur"]

_TITLE = "|".join(re.escape(t) for names in TITLES.values() for t in sorted(names, key=len, reverse=True))
#: A letter that is no small Latin, Cyrillic or Greek one.
_UPPER = r"[^\W\d_a-zß-öø-ÿа-яѐ-џα-ωάέήίόύώ]"
_INITIALS = rf"(?:{_UPPER}\.-?)+"
_NAME = rf"(?:{_UPPER}[^\W\d_]*(?:['’-][^\W\d_]+)+|{_UPPER}[^\W\d_]+)"
# A line feed may stand after a title or initials; after a full word the next line is another sentence as often as not.
_GIVEN = rf"(?:{_NAME}[^\S\n]+|{_INITIALS}\s*)"
_PARTICLE = rf"(?:{'|'.join(PARTICLES)})[^\S\n]+"
#: Titles in capitals need a name in capitals; MS, SR and SIR also mean other things.
_CAPITALS = "|".join(re.escape(t.upper()) for names in TITLES.values() for t in names if t not in ("Ms", "Sr", "Sir"))
_LOUD = rf"{_UPPER}(?:{_UPPER}|['’-](?={_UPPER}))+"
_BEFORE = rf"(?:{_TITLE})\.?\s+|(?:{_CAPITALS})\.?\s+(?=(?:{_INITIALS}\s*)*{_LOUD}(?!\w))"
PATTERNS: Mapping[str, re.Pattern[str]] = {
    "secret": re.compile(
        r"""\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[0-9A-Za-z]{36}\b|\bsk-[0-9A-Za-z]{20,}\b"""
        r"""|(?<![\w-])eyJ[0-9A-Za-z_-]{8,}+\.eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+"""
        r"""|-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----(?:[0-9A-Za-z+/=:,.\s]++|-(?!----))*+-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----"""
        r"""|(?i:\b(?:password|passwd|pwd|token|secret|api_?key)\b["']?\s{0,3}[:=]\s{0,3}["']?)()"""),  # the value follows
    "email": re.compile(r"(?<![\w.+-])[A-Za-z0-9_][\w.+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,6}[A-Za-z]{2,24}(?![A-Za-z0-9-])", re.ASCII),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b", re.ASCII),
    "card": re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])", re.ASCII),
    "ip": re.compile(r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)", re.ASCII),
    "ssn": re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])", re.ASCII),
    "phone": re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])", re.ASCII),
    "person": re.compile(rf"(?<!\w)(?:{_BEFORE})(?:{_GIVEN}|{_PARTICLE})*{_NAME}"),
}
_VALUE = re.compile(r"""[^\s"'<>|]{8,}?(?=[.,;!?]?(?:["'\s<>|#*$%&!]|$))""")
_UNTIL_DIGIT = re.compile(r"""[^\s"'\d]*+""")
#: What a text must hold for a pattern to be tried at all.
_HINTS = {"secret": re.compile(r"AKIA|ASIA|gh[pousr]_|sk-|eyJ|PRIVATE KEY|(?i:password|passwd|pwd|token|secret|api_?key)"), "email": re.compile("@"),
          "iban": re.compile(r"[A-Z]{2}\d\d", re.ASCII), "person": re.compile(rf"(?<!\w)(?:{_BEFORE})")}
_DIGIT = re.compile(r"\d", re.ASCII)

ENTITY = "struct<kind:string,start:int,end:int,text:string,surrogate:string>"


def luhn(digits: str) -> int:
    """0 for a number with a right check digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10


def iban_rest(text: str) -> int:
    """1 for a right IBAN."""
    compact = text.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def _real(kind: str, text: str) -> bool:
    if kind == "card":
        return luhn(re.sub(r"\D", "", text)) == 0
    if kind == "iban":
        return iban_rest(text) == 1
    if kind == "ip":
        return all(int(x) < 256 for x in text.split(".")) and not ipaddress.ip_address(".".join(str(int(x)) for x in text.split("."))).is_loopback
    if kind == "phone":
        return 7 <= len(re.sub(r"\D", "", text)) <= 15
    return True


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of secrets. A value after a word like password has a digit before the next space or quote."""
    done = clear = 0
    for m in PATTERNS["secret"].finditer(text):
        if m[1] is None:
            if m.start() >= done:
                done = m.end()
                yield m.span()
            continue
        start = m.end()
        if start < max(done, clear):
            continue
        stop = _UNTIL_DIGIT.match(text, start).end()
        if stop == len(text) or not text[stop].isdecimal():
            clear = stop
        elif value := _VALUE.match(text, start):
            done = value.end()
            yield value.span()


def _mentions(text: str, persons: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Start and end of the full and family names of these persons, wherever they stand as whole words."""
    names: set[str] = set()
    for start, end in persons:
        words = text[start:end].split()
        for name in (words, words[-1:]):
            names |= {" ".join(name), " ".join(name).upper()}
    if names:
        longest = sorted(names, key=lambda n: (-len(n), n))
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(re.escape(n).replace(re.escape(' '), r'\s+') for n in longest)})(?!\w)", text):
            yield m.span()


def detect(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of each entity, in order. Of overlapping ones, the kind named first in
    PATTERNS stays."""
    found: list[tuple[int, int, str]] = []  # in order, and none overlaps another
    digits = _DIGIT.search(text) is not None
    for kind, pattern in PATTERNS.items():
        if not (_HINTS[kind].search(text) if kind in _HINTS else digits):
            continue
        spans = _secrets(text) if kind == "secret" else (m.span() for m in pattern.finditer(text))
        if kind == "person":
            titled = [(s + re.match(_BEFORE, text[s:e + 1]).end(), e) for s, e in spans]
            spans = [*titled, *_mentions(text, titled)]
        for start, end in spans:
            at = bisect.bisect_left(found, (start,))
            free = (at == 0 or found[at - 1][1] <= start) and (at == len(found) or found[at][0] >= end)
            if free and _real(kind, text[start:end]):
                found.insert(at, (start, end, kind))
    return [(k, s, e) for s, e, k in found]


def _round(key: bytes, data: str) -> int:
    return int.from_bytes(hashlib.blake2b(data.encode("utf-8", "surrogatepass"), key=key[:64], digest_size=16).digest(), "big")


def _wide(key: bytes, data: str, bits: int) -> int:
    """As _round, with as many bits as are asked for."""
    out = _round(key, data)
    for i in range(1, -(-bits // 128)):
        out = out << 128 | _round(key, f"{i}|{data}")
    return out


def permute(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of 0..size-1: a Feistel network on two halves, walked until inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for i in range(6):
            left, right = right, left ^ (_wide(key, f"{tweak}|{i}|{right}", half) & mask)
        value = left << half | right
        if value < size:
            return value


_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]


def same_format(key: bytes, tweak: str, text: str, classes: Iterable[str] = tuple(_CLASSES)) -> str:
    """Each letter or digit by one of its class; everything else as it is. One to one for each format."""
    classes = list(classes)
    if len(text) > PIECE:
        # piece by piece, each under what stands before it: still one to one, and linear for a text of any length
        out, before = [], ""
        for at in range(0, len(text), PIECE):
            out.append(same_format(key, f"{tweak}|{len(text)}|{before}", text[at:at + PIECE], classes))
            before = f"{_round(key, f'{before}|{text[at:at + PIECE]}'):x}"
        return "".join(out)
    own = [next((k for k in classes if c in k), None) for c in text]
    value, size = 0, 1
    for c, k in zip(text, own, strict=True):
        if k:
            value, size = value * len(k) + k.index(c), size * len(k)
    shape = "".join("x" if k is None else str(classes.index(k)) for k in own)
    value = permute(key, f"{tweak}|{shape}", value, size)
    out = []
    for c, k in zip(reversed(text), reversed(own), strict=True):
        if k:
            value, at = divmod(value, len(k))
            c = k[at]
        out.append(c)
    return "".join(reversed(out))


def canonical(kind: str, text: str) -> str:
    """Equal for the spellings of one entity: case and separators don't count where they carry nothing."""
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "").upper()
    if kind == "email":
        return text.lower()
    if kind == "person":
        return " ".join(unicodedata.normalize("NFC", text).lower().split())
    return unicodedata.normalize("NFC", text)


def _script(text: str) -> str:
    names = [unicodedata.name(c, "").split(" ")[0] for c in text if c.isalpha()]
    return next((s for s in ("CYRILLIC", "GREEK") if s in names), "LATIN")


def surrogate(key: bytes, kind: str, entity: str, gender: str = "n", attempt: int = 0) -> str:
    """The replacement of a canonical entity. attempt counts the draws that collided."""
    tweak = f"{kind}|{attempt}"
    if kind == "card":
        body = same_format(key, tweak, entity[1:-1])
        body = entity[0] + body
        return body + next(str(d) for d in range(10) if luhn(body + str(d)) == luhn(entity))
    if kind == "iban":
        body = same_format(key, tweak, entity[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + entity[:2] + "00")) % 97
        return f"{entity[:2]}{check:02d}{body}"
    if kind == "ip":
        value = permute(key, tweak, int(ipaddress.ip_address(".".join(str(int(x)) for x in entity.split(".")))), 1 << 32)
        return str(ipaddress.ip_address(value))
    if kind == "phone":
        keep = max(0, len(entity) - 10)
        return entity[:keep] + same_format(key, f"{tweak}|{entity[:keep]}", entity[keep:])
    if kind == "email":
        name, _, host = entity.partition("@")
        labels = host.split(".")
        return same_format(key, tweak, ".".join(labels[:-1]) + "@" + name).partition("@")[2] + "@" + same_format(
            key, tweak, ".".join(labels[:-1]) + "@" + name).partition("@")[0] + "." + labels[-1]
    if kind == "secret" and entity.startswith("-----"):
        head, body, tail = re.fullmatch(r"(-----[A-Z ]+-----)(.*)(-----[A-Z ]+-----)", entity, re.S).groups()
        return head + same_format(key, tweak, body) + tail
    if kind == "secret":
        hexes = [c for c in ("0123456789abcdef", "0123456789ABCDEF") if set(entity) <= set(c) and len(entity) > 15]
        fixed = next((p for p in ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "eyJ") if entity.startswith(p)), "")
        return fixed + same_format(key, tweak, entity[len(fixed):], hexes or _CLASSES)
    if kind == "person":
        script, words = _script(entity), entity.split(" ")
        family = _family(key, f"{tweak}|{script}", words[-1], script, 3 + attempt)
        pool = GIVEN[script, gender]
        given = [(w, w if w in PARTICLES else pool[_round(key, f"{tweak}|given|{w}") % len(pool)]) for w in words[:-1]]
        return " ".join([*(name[0] + "." if w.endswith(".") else name for w, name in given), family])
    return same_format(key, tweak, entity)


def _family(key: bytes, tweak: str, name: str, script: str, size: int) -> str:
    parts, value = SYLLABLES[script], _round(key, f"{tweak}|family|{name}")
    return "".join(parts[value // len(parts) ** i % len(parts)] for i in range(size)).capitalize()


def dressed(kind: str, text: str, plain: str) -> str:
    """A canonical surrogate with the separators and case of the text it replaces."""
    if kind in ("card", "phone", "ssn"):
        rest = iter(plain)
        return "".join(next(rest) if c in "0123456789" else c for c in text)
    if kind == "iban":
        rest = iter(plain)
        return "".join(c if c == " " else next(rest) for c in text)
    if kind == "email" and text.isupper():
        return plain.upper()
    return plain.upper() if kind == "person" and text.isupper() else plain


def gender_of(text: str, start: int) -> str:
    before = text[:start].rstrip()[-12:]
    return next((g for g, names in TITLES.items() if re.search(rf"(?<!\w)(?i:{'|'.join(map(re.escape, names))})\.?$", before)), "n")


def _rows(text: str) -> list[tuple[str, int, int, str, str]]:
    rows = [(k, s, e, canonical(k, text[s:e])) for k, s, e in detect(text)]
    genders: dict[str, str] = {}
    for k, s, _, entity in rows:
        # a family name alone shows no gender; further mentions have that of the title
        if k == "person" and genders.get(entity, "n") == "n":
            genders[entity] = gender_of(text, s) if " " in entity else "n"
    return [(*r, genders[r[3]] if r[0] == "person" else "n") for r in rows]


FOUND = "struct<kind:string,start:int,end:int,entity:string,gender:string>"
_FOUND = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("entity", pa.string()), ("gender", pa.string())])


def find_entities(docs: DataFrame, keep: Iterable[str], text_col: str = "text") -> DataFrame:
    """row (struct of the columns keep) and found, the entities of each text."""
    def work(texts: nt.Texts) -> list[pa.Array]:
        raw = texts.data.tobytes()
        out = [[dict(zip(("kind", "start", "end", "entity", "gender"), r, strict=True)) for r in _rows(raw[a:b].decode())]
               for a, b in zip(texts.starts[:-1].tolist(), texts.starts[1:].tolist(), strict=True)]
        return [pa.array(out, pa.list_(_FOUND))]
    return nt.annotate(docs, text_col, keep, f"found array<{FOUND}>", work)


def redrawn(entities: DataFrame, key: bytes, rounds: int = ROUNDS) -> DataFrame:
    """kind, gender, entity and attempt of those entities whose first surrogate will not do.

    entities: kind, gender, entity, distinct. A surrogate will not do if it equals an entity of
    its kind, or if another entity with the same surrogate comes first. These draw again
    until none is left. Family names grow by a syllable with each draw, so there are enough of them for any
    number of persons. It raises only if `rounds` draws in a row leave no fewer than before: a format, as that
    of very short addresses, of which the entities take up nearly all values.
    """
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [canonical(k, surrogate(key, k, e, g, a)) for k, g, e, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["kind", "gender", "entity", "attempt", "made"])

    schema = "kind string, gender string, entity string, attempt int, made string"
    current = cut(entities.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema))
    originals = entities.select("kind", F.col("entity").alias("made")).distinct()
    least, idle = None, 0
    while idle < rounds:
        first = F.struct("attempt", "entity", "gender")
        winners = current.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min(first).alias("first"))
        shared = winners.filter("n > 1").select("kind", "made", "first")
        lost = current.join(shared, ["kind", "made"]).filter(first != F.col("first")).select("kind", "gender", "entity", "attempt", "made")
        taken = current.join(originals, ["kind", "made"], "left_semi")
        again = cut(lost.unionByName(taken).distinct())
        if again.isEmpty():
            return current.filter("attempt > 0").select("kind", "gender", "entity", "attempt")
        left = again.count()
        idle = 0 if least is None or left < least else idle + 1
        least = left if least is None else min(least, left)
        stays = current.join(again.select("kind", "gender", "entity"), ["kind", "gender", "entity"], "left_anti")
        more = again.select("kind", "gender", "entity", (F.col("attempt") + 1).alias("attempt")).mapInArrow(draw, schema)
        current = cut(stays.select("kind", "gender", "entity", "attempt", "made").unionByName(more))
    raise ValueError("surrogates still collide; a format has too few values for these entities")


def replace_entities(docs: DataFrame, key: bytes, text_col: str = "text", keep: Iterable[str] | None = None,
                     broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """row (struct of the columns keep, by default all), text with surrogates, and entities.

    entities: kind, start, end (code points in the original), text and surrogate of each. Null texts stay
    null and empty ones empty; both have no entities. Equal rows give equal results.
    Two passes over the texts: one gathers the distinct entities for the collision check, one replaces.
    """
    keep = list(docs.columns if keep is None else keep)
    key = hmac.new(key, b"surrogates", "sha256").digest()
    found = find_entities(docs, [], text_col)
    entities = cut(found.select(F.explode("found").alias("f")).select("f.kind", "f.gender", "f.entity").distinct())
    again = redrawn(entities, key)
    text = F.col(f"`{text_col}`")
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text.alias("text"))
    if again.limit(broadcast_rows + 1).count() <= broadcast_rows:
        table = {(r.kind, r.gender, r.entity): r.attempt for r in again.collect()}
        shared = docs.sparkSession.sparkContext.broadcast(table)
        return _apply(source.withColumn("attempts", F.lit(None).cast("array<int>")), key, shared)
    # the redrawn ones are joined to the places where they stand, salted for entities that many documents name
    numbered = cut(source.withColumn("n", F.monotonically_increasing_id()))
    places = find_entities(numbered, ["n"], "text").select("row.n", F.posexplode("found").alias("at", "f"))
    salted = again.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = places.select("n", "at", "f.kind", "f.gender", "f.entity", F.pmod("n", F.lit(SALTS)).cast("int").alias("salt")).join(
        salted, ["kind", "gender", "entity", "salt"], "left")
    attempts = joined.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("attempt", F.lit(0)).alias("k")))).alias("a"))
    return _apply(numbered.join(attempts.select("n", F.col("a.k").alias("attempts")), "n", "left").select("row", "text", "attempts"), key, None)


def _apply(source: DataFrame, key: bytes, shared: object) -> DataFrame:
    columns = ("kind", "start", "end", "text", "surrogate")
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("surrogate", pa.string())]))

    def one(text: str | None, attempts: list[int] | None) -> tuple[str | None, list[dict[str, object]]]:
        rows = _rows(text) if text else []
        if not rows:
            return text, []
        out, parts, at = [], [], 0
        for i, (kind, start, end, entity, gender) in enumerate(rows):
            attempt = attempts[i] if attempts is not None else shared.value.get((kind, gender, entity), 0) if shared else 0
            new = dressed(kind, text[start:end], surrogate(key, kind, entity, gender, attempt))
            parts += [text[at:start], new]
            at = end
            out.append(dict(zip(columns, (kind, start, end, text[start:end], new), strict=True)))
        return "".join([*parts, text[at:]]), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, attempts = batch.column(1), batch.column(2)
            for a in range(0, len(batch), 500):
                done = [one(t, k) for t, k in zip(texts.slice(a, 500).to_pylist(), attempts.slice(a, 500).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, 500), pa.array([t for t, _ in done], pa.string()), pa.array([e for _, e in done], shape)],
                    names=["row", "text", "entities"])
    return source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, text string, entities array<{ENTITY}>")
