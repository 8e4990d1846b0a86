"""Surrogates for personal data: keyed, of the same type and format, distinct and coreferent.

Every distinct entity of the corpus gets one surrogate, derived from a key, its
type and its normal form, so mentions of one entity stay mentions of one
surrogate. Surrogates that meet another entity's surrogate or any real entity
are dealt anew until none is left. Digits stay digits, letters keep their case
and script, card numbers pass their check digit again, names keep their gender.

A title shows a person; other mentions of that person's names in the same
document, with or without a title, are mentions of the same entities.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Titles that mark a person's name, by the gender they state (fixed values).
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Mister", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"),
    "n": ("Dr", "Prof"),
}
#: Particles within surnames; they stay as they are (fixed values).
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "ter", "ten", "zu", "bin", "al", "el")
#: Capitalised words that are no names: words that begin sentences, days, and what follows Miss in pageants (fixed values).
NO_NAMES = (
    "The", "This", "That", "He", "She", "It", "We", "You", "They", "On", "In", "At", "And", "But", "For", "From", "To", "As", "If", "When", "Der", "Die", "Das", "Er", "Sie", "Es", "Und", "Im", "Am",
    "Les", "Il", "Elle", "El", "Los", "Las", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "Universe", "World", "Earth", "International", "America", "USA",
)
#: Prefixes of access tokens, and the words before passwords and telephone numbers (fixed values).
TOKENS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xoxb-", "xoxp-", "sk_live_", "glpat-")
SECRETS = ("password", "passwd", "token", "secret", "api_key")
CALLS = ("phone", "Phone", "tel", "Tel", "telephone", "Telephone", "Telefon", "mobile", "Mobile", "call", "Call", "fax", "Fax")


def _any(names) -> str:
    return "|".join(re.escape(x) for x in sorted(names, key=len, reverse=True))


_TITLE = _any(t for v in TITLES.values() for t in v)
_LETTERS = r"(?:[^\W\d_][\u0300-\u036f]*)"
_UPPER = r"[^\W\d_a-zа-яß-öø-ÿ][\u0300-\u036f]*"
_PART = rf"(?:[A-Z]['’])?{_UPPER}{_LETTERS}+"
_NAME = rf"(?!(?:{_any(NO_NAMES)})\b){_PART}(?:-{_PART})*"
_SMALL = rf"(?:(?:{_any(PARTICLES)}) )"
_INITIAL = r"(?:[A-ZÀ-ÖØ-Þ]\. ?)"
#: One alternative a type; the first that matches at a place counts. Runs without a bound are of one class of
#: characters that the next part can't start with, so the search stays linear.
PATTERN = "|".join([
    r"(?P<email>(?<![\w.+-])[^\W_][\w.+-]*@[^\W_][\w-]*(?:\.[^\W_][\w-]*)+)",
    r"(?P<aws_key>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)",
    rf"(?P<token>\b(?:{_any(TOKENS)})[A-Za-z0-9_-]{{16,}})",
    rf"""(?P<secret>\b(?:{_any(SECRETS)})[ \t]{{0,3}}[=:][ \t]{{0,3}}["']?(?P<value>[^\s"'<>,;(){{}}\[\]]{{5,}}[^\s"'<>,;(){{}}\[\].:?]))""",
    r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
    r"(?P<ipv6>(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,8}(?![\w:]))",
    r"(?P<ipv4>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))",
    r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
    r"(?P<card>(?<![\d-])\d{4}(?:[ -]?\d{4}){2}[ -]?(?:\d{4}[ -]?\d{1,3}|\d{1,4})(?![\d-]))",
    r"(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d))",
    r"(?P<abroad>(?<![\w+])\+\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{2,12})){1,5}(?!\d))",
    rf"(?P<call>\b(?:{_any(CALLS)})\b[.:]{{0,2}} {{0,3}}(?P<number>\d{{7,15}})(?![\d.]))",
    rf"(?P<person>\b(?P<title>{_TITLE})\.? (?P<names>{_INITIAL}*{_SMALL}*{_NAME}(?: {_INITIAL}*{_SMALL}*{_NAME})*))",
])
#: The body of a private key; it spans lines.
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----\s*(?:[A-Za-z-]+: [^\n]*\s+)*(?P<body>(?:[A-Za-z0-9+/=]{32,}\s+)*(?:[A-Za-z0-9+/=]{32,}|[A-Za-z0-9+/=]{4,}(?=\s*-----END)))")
SPLIT_NAME = re.compile(rf"(?<![\w'’-]){_NAME}(?![\w])")

#: A card of up to 16 digits, where the numbers after it aren't part of it.
SHORT_CARD = r"(?P<card>\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,4}(?![\d-]))"

#: Every entity but a private key has one of these characters or strings, and spans no lines.
_CHARS = r"[\d@=:]"
_STRINGS = ("AKIA", "ASIA", *TOKENS, *(t for v in TITLES.values() for t in v))


def is_ipv6(found: str) -> bool:
    """An address with a digit; times and names of namespaces aren't, nor is the loopback."""
    try:
        return ipaddress.IPv6Address(found) is not None and any(c.isdigit() for c in found)
    except ValueError:
        return False


def is_kind(m) -> bool:
    """Whether a match passes its type's check."""
    kind = next((k for k in ("card", "ipv6", "abroad") if m.re.groupindex.get(k) and m[k]), None)
    return {"card": lambda: is_card(m[0]), "ipv6": lambda: is_ipv6(m[0]), "abroad": lambda: 8 <= sum(c.isdigit() for c in m[0]) <= 15}.get(kind, lambda: True)()


def finder():
    """Matches of the pattern over the lines that can hold an entity; cards only with a right check digit, addresses only if they are some."""
    search, short, some = re.compile(PATTERN).search, re.compile(SHORT_CARD).match, re.compile(_CHARS).search

    def matches(text, at, end):
        while m := search(text, at, end):
            if m.lastgroup == "card" and not is_kind(m):
                m = short(text, m.start(), end) or m
            ok = is_kind(m)
            if ok:
                yield m
            at = m.end() if ok or m.lastgroup == "card" else m.start() + 1  # the rest of a refused match, at most 80 characters, may hold others

    def find(text):
        if not (some(text) or any(x in text for x in _STRINGS)):
            return
        at = 0
        for line in text.split("\n"):
            if some(line) or any(x in line for x in _STRINGS):
                yield from matches(text, at, at + len(line))
            at += len(line) + 1

    return find


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def is_card(found: str) -> bool:
    digits = re.sub(r"\D", "", found)
    return 13 <= len(digits) <= 19 and luhn(digits)


def name_form(name: str) -> str:
    return unicodedata.normalize("NFC", name).replace("’", "'").casefold()


def titled_names(m) -> list[tuple[int, int, str, str]]:
    """The names after a title: the last is a surname, those before it given names with the title's gender."""
    gender = next(g for g, v in TITLES.items() if m["title"] in v)
    found = [(m.start("names") + x.start(), m.start("names") + x.end(), name_form(x[0])) for x in SPLIT_NAME.finditer(m["names"])]
    return [(a, b, "surname" if i == len(found) - 1 else f"given_{gender}", n) for i, (a, b, n) in enumerate(found)]


class People:
    """The persons that a document names with a title."""

    def __init__(self, persons: list[list[tuple[int, int, str, str]]]):
        self.whole, self.single, stated = {}, {}, {}
        for person in persons:
            for _, _, kind, norm in person:
                if kind in ("given_m", "given_f"):
                    stated.setdefault(norm, kind)
        for person in persons:
            kinds = [(stated.get(n, k) if k == "given_n" else k, n) for _, _, k, n in person]
            self.whole.setdefault(tuple(n for _, n in kinds), [k for k, _ in kinds])
            for k, n in kinds:
                self.single.setdefault(n, []).append(k)

    def kinds(self, norms: list[str]) -> list[str]:
        """The types of adjacent names: those of the person of just these names, else each name's first type, a given name before others."""
        if tuple(norms) in self.whole:
            return self.whole[tuple(norms)]
        out = []
        for i, norm in enumerate(norms):
            given = [k for k in self.single[norm] if k != "surname"] if i + 1 < len(norms) else []
            out.append((given or self.single[norm])[0])
        return out


def mentions(text: str, people: People, a: int, b: int) -> list[tuple[int, int, str, str]]:
    """Untitled mentions of known names within text[a:b]; names with a space or an initial between them are one person's."""
    runs = []
    for m in SPLIT_NAME.finditer(text, a, b):
        norm = name_form(m[0])
        if norm in people.single and not m[0][0].islower():
            if runs and re.fullmatch(rf" {_INITIAL}*{_SMALL}*", text[runs[-1][-1][1]:m.start()]):
                runs[-1].append((m.start(), m.end(), norm))
            else:
                runs.append([(m.start(), m.end(), norm)])
    return [(x, y, k, n) for run in runs for (x, y, n), k in zip(run, people.kinds([n for _, _, n in run]))]


def detect(text: str, find) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of each entity, left to right, none overlapping.

    A person's names are one entity each: the last is a surname, those before
    it given names with the title's gender; a lone name is a surname. A name
    that a title shows is found all over the document as a whole word with a
    capital, before the title too, so a name that is a word besides is replaced
    where it stands as one with a capital. A given name after a neutral title
    takes the gender that another title of the document states. Initials and
    particles stay.
    """
    out, persons, closed = [], [], []
    if "PRIVATE KEY-----" in text:
        closed = [m.span("body") for m in PRIVATE_KEY.finditer(text)]
        out += [(a, b, "private_key", "".join(text[a:b].split())) for a, b in closed]
    for m in find(text):
        if any(a < m.end() and m.start() < b for a, b in closed):
            continue
        kind = next(k for k in ("secret", "person", "call", "email", "aws_key", "token", "iban", "ipv6", "ipv4", "ssn", "card", "phone", "abroad") if m.re.groupindex.get(k) and m[k])
        if kind == "person":
            persons.append(titled_names(m))
        elif kind == "secret":
            out.append((m.start("value"), m.end("value"), "secret", m["value"]))
        elif kind == "call":
            out.append((m.start("number"), m.end("number"), "phone", m["number"]))
        else:
            found = m[kind]
            digits = re.sub(r"\D", "", found)
            norm = {"email": found.lower(), "phone": digits, "abroad": digits, "card": digits, "ssn": digits, "iban": found.replace(" ", "")}.get(kind, found)
            norm = str(ipaddress.IPv6Address(found)) if kind == "ipv6" else norm
            out.append((m.start(kind), m.end(kind), "phone" if kind == "abroad" else kind, norm))
    if persons:
        people = People(persons)
        for person in persons:
            out += [(a, b, k, n) for (a, b, _, n), k in zip(person, people.kinds([n for _, _, _, n in person]))]
        out.sort()
        at, more = 0, []
        for a, b in [*((x[0], x[1]) for x in out), (len(text), len(text))]:
            more += mentions(text, people, at, a)
            at = b
        out += more
    return sorted(out)


def _stream(key: bytes, *parts):
    """An endless keyed stream of numbers under 2**32."""
    import hashlib
    import hmac

    n = 0
    while True:
        block = hmac.new(key, "\x1f".join([*map(str, parts), str(n)]).encode(), hashlib.sha256).digest()
        for k in range(0, 32, 4):
            yield int.from_bytes(block[k:k + 4], "big")
        n += 1


#: Syllables that names are made of, by script (fixed values).
SYLLABLES = {
    "latin": ("ba", "den", "fo", "gar", "hel", "jo", "ka", "lin", "mar", "nor", "pe", "ros", "sal", "ten", "vi", "wes"),
    "cyrillic": ("ба", "ван", "го", "дар", "ел", "жо", "ка", "лин", "мар", "нор", "пе", "рос", "сал", "тен", "ви", "зор"),
    "greek": ("βα", "γαν", "δο", "ελ", "ζα", "θεν", "κα", "λιν", "μαρ", "νορ", "πε", "ρος", "σαλ", "τεν", "φι", "χορ"),
}
#: Endings that show a given name's gender, by script (fixed values).
ENDINGS = {"latin": {"m": "o", "f": "a", "n": "e"}, "cyrillic": {"m": "ил", "f": "ина", "n": "ен"}, "greek": {"m": "ος", "f": "ια", "n": "ι"}}


#: Ranges of letters, and the first letter and number of those that stand for them (fixed values).
LETTERS = (("A", "Z", 0x41, 26), ("a", "z", 0x61, 26), ("А", "Я", 0x410, 32), ("а", "я", 0x430, 32), ("Α", "Ρ", 0x391, 17), ("α", "ρ", 0x3B1, 17), ("一", "鿿", 0x4E00, 20000))


def script_of(word: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", word) else "greek" if re.search("[Ͱ-Ͽ]", word) else "latin"


def surrogate(kind: str, norm: str, attempt: int, key: bytes) -> str:
    """The surrogate's normal form. From the ninth attempt on forms grow, so that a used-up format can't go on for ever."""
    draw = _stream(key, kind, norm, attempt)
    longer = max(0, attempt - 8)

    def like(s):
        out = []
        for c in s:
            n = next(draw)
            if c.isdigit():
                out.append(str(n % 10))
            elif c.isalpha():
                first, size = next(((chr(a), b) for low, high, a, b in LETTERS if low <= c <= high), ("a", 26))
                out.append(chr(ord(first) + n % size))
            else:
                out.append(c)
        return "".join(out)

    if kind.startswith("given") or kind == "surname":
        script, out = script_of(norm), []
        for part in norm.split("-"):  # each part of a compound name is a name
            name = "".join(SYLLABLES[script][next(draw) % 16] for _ in range(2 + len(part) // 6 + longer))
            out.append(name + (ENDINGS[script][kind[-1]] if kind != "surname" else ""))
        return "-".join(out)
    if kind == "ipv6":
        groups = []
        for g in norm.split(":"):
            size = 4 if g and longer else len(g)
            groups.append(g if g in ("", "0") else "123456789abcdef"[next(draw) % 15] + "".join("0123456789abcdef"[next(draw) % 16] for _ in range(size - 1)))
        return ":".join(groups)
    if kind == "token":
        start = next(x for x in TOKENS if norm.startswith(x))
        return start + like(norm[len(start):] + "0" * longer)
    if kind == "email":
        local, _, domain = norm.partition("@")
        labels = domain.split(".")
        return like(local + "x" * longer) + "@" + ".".join([like(x) for x in labels[:-1]] + labels[-1:])
    if kind == "ipv4":
        low, high = {1: (1, 9), 2: (10, 99), 3: (100, 254)}, lambda s: 3 if longer else len(s)
        return ".".join(str(a + next(draw) % (b - a + 1)) for a, b in (low[high(x)] for x in norm.split(".")))
    if kind == "card":
        body = norm[0] + like(norm[1:-1])
        return next(body + d for d in "0123456789" if luhn(body + d))
    if kind == "iban":
        return norm[:2] + like(norm[2:])
    if kind == "aws_key":
        return norm[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[next(draw) % 32] for _ in range(16))
    if kind == "secret" and re.fullmatch("[0-9a-f]+", norm):
        return "".join("0123456789abcdef"[next(draw) % 16] for _ in range(len(norm) + longer))
    if kind == "phone":
        return norm[0] + like(norm[1:])
    return like(norm + "0" * longer)


def render(kind: str, norm: str, shown: str) -> str:
    """A normal form in the format of the mention it replaces."""
    if kind.startswith("given") or kind == "surname":
        return norm.upper() if shown.isupper() and len(shown) > 1 else "-".join(x.capitalize() for x in norm.split("-"))
    if kind == "ipv6":
        return norm.upper() if shown.isupper() else norm
    if kind in ("phone", "card", "ssn", "iban", "private_key"):
        rest = iter(norm)
        out = "".join(c if c.isspace() or (kind != "private_key" and not c.isalnum()) else next(rest, "") for c in shown)
        return out + "".join(rest)
    if kind == "email" and shown != shown.lower():
        return norm.upper() if shown.isupper() else "".join(b.upper() if a.isupper() else b for a, b in zip(shown.ljust(len(norm)), norm))
    return norm


def mapping(entities: DataFrame, key: bytes) -> DataFrame:
    """(type, norm, other): a surrogate for each distinct entity, none equal to another or to a real entity of its type."""
    @F.pandas_udf("string")
    def make(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kind, norm, attempt in parts:
            yield pd.Series([surrogate(k, n, a, key) for k, n, a in zip(kind, norm, attempt)], dtype=object)

    family = F.when(F.col("type").startswith("given") | (F.col("type") == "surname"), "name").otherwise(F.col("type"))
    real = materialize(entities.select("type", "norm").distinct().withColumn("family", family), "entities")
    taken = real.select("family", F.col("norm").alias("other")).distinct()
    settled, todo = None, real.withColumn("attempt", F.lit(0))
    while True:
        tried = materialize(todo.withColumn("other", make("type", "norm", "attempt")), "tried")
        clash = tried.join(taken, ["family", "other"], "left_semi").select("type", "norm").withColumn("lost", F.lit(True))
        first = tried.groupBy("family", "other").agg(F.min(F.struct("type", "norm")).alias("first"))
        state = tried.join(first, ["family", "other"]).join(clash, ["type", "norm"], "left")
        keep = F.col("lost").isNull() & (F.col("first.type") == F.col("type")) & (F.col("first.norm") == F.col("norm"))
        state = materialize(state.select("type", "norm", "family", "attempt", "other", keep.alias("keep")), "state")
        good = state.where("keep").select("type", "norm", "family", "other")
        settled = good if settled is None else settled.unionByName(good)
        todo = state.where("not keep").select("type", "norm", "family", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return settled.select("type", "norm", "other")
        taken = taken.unionByName(good.select("family", "other"))


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text with surrogates, n_entities (mentions), types (sorted, distinct).

    Texts without entities, null and empty ones come back as they are, without
    a shuffle. Ids may be null or repeat. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, ents array<struct<type:string,norm:string>>"

    def scan(batches):
        import pyarrow as pa

        find = finder()
        item = pa.list_(pa.struct([("type", pa.string()), ("norm", pa.string())]))
        for batch in batches:
            ents = [[{"type": k, "norm": n} for _, _, k, n in detect(t, find)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ents, item)], ["doc_id", "text", "ents"])

    scanned = rows.mapInArrow(scan, schema)
    some = materialize(scanned.where(F.size("ents") > 0).withColumn("rid", F.monotonically_increasing_id()), "with-entities")
    ents = some.select("rid", F.explode(F.array_distinct("ents")).alias("e")).select("rid", "e.type", "e.norm")
    known = materialize(mapping(ents, key), "surrogates")
    pairs = ents.join(known, ["type", "norm"]).groupBy("rid").agg(F.collect_list(F.struct("type", "norm", "other")).alias("pairs"))

    def rewrite(batches):
        import pyarrow as pa

        find = finder()
        for batch in batches:
            out = []
            for text, pairs_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                to, parts, at = {(p["type"], p["norm"]): p["other"] for p in pairs_}, [], 0
                for a, b, k, n in detect(text, find):
                    parts += [text[at:a], render(k, to[k, n], text[a:b])]
                    at = b
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(3), batch.column(4)], ["doc_id", "text", "n_entities", "types"])

    n, types = F.size("ents").cast("long").alias("n_entities"), F.array_sort(F.array_distinct(F.col("ents.type"))).alias("types")
    done = some.join(pairs, "rid").select("doc_id", "text", "pairs", n, types).mapInArrow(rewrite, f"doc_id {kind}, text string, n_entities long, types array<string>")
    return done.unionByName(scanned.where(F.size("ents") == 0).select("doc_id", "text", n, types))
