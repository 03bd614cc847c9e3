"""PII: surrogate generation.

Detected entities (e-mail addresses, IPv4 addresses, card numbers, phone numbers, social security numbers,
IBANs, and names after a title) are replaced by values drawn from a keyed hash: digits for digits, letters
of the same script and case for letters, the same punctuation; a card number keeps its first digit and
whether its check digit holds, a phone number its country code, an e-mail address its top-level domain, a
name its part (given or family), gender (from the title) and script.

An entity is its canonical form, so spellings of one entity stay one (coreference): each distinct entity of
the whole corpus gets one surrogate. Collision checks keep distinct entities distinct: a draw that equals
another entity's surrogate, or any entity that really occurs, is drawn again with the next attempt until
none is left. Names and the local parts of e-mail addresses grow with the attempts, so these always find room;
after ``AVOID_REAL`` attempts a number may equal one that occurs elsewhere (which is replaced as well), so that
a format whose every number occurs still has surrogates. Only distinct entities go through these checks; texts meet their own entities by a hash of the
text, and texts that a cheap pattern clears do not move at all.

Defined results: a null text stays null, an empty one empty; repeated rows stay equal; all other columns
pass unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

# Titles by gender, names by script, two-digit country calling codes.
TITLES = {"f": "Mrs Ms Miss Madam Frau Mme Madame Mademoiselle Señora Señorita Sra Dña Doña Signora госпожа г-жа".split(),
          "m": "Mr Mister Sir Herr Herrn Monsieur Señor Sr Signor господин г-н".split()}
NAMES = {
    ("latin", "f"): "Alma Beth Cora Dora Edith Flora Greta Hanna Ines Julia Karla Lena Mona Nora Olga Paula Rosa Sara Tilda Vera".split(),
    ("latin", "m"): "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Niels Oscar Paul Robin Simon Tomas Viktor".split(),
    ("latin", "s"): "Abel Brandt Castro Dupont Ebert Fuchs Garnier Holm Ibarra Jansen Keller Lopez Meyer Norton Ortega Porter Quist Renard Sander Turner".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    ("cyrillic", "s"): "Беляев Волков Громов Дроздов Ершов Зуев Котов Лосев Морозов Носов".split(),
}
CALLING_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "accented": "àáâãäåçèéêëìíîïñòóôõöùúûüý",
           "greek": "αβγδεζηθικλμνξοπρστυφχψω", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя"}

#: Attempts in which a surrogate may not equal any entity that occurs.
AVOID_REAL = 32

_TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
_CAPITAL = r"[^\W\d_a-zа-яß-öø-ÿ][^\W\d_]+"
_ENTITY = re.compile(rf"""
    (?P<email>[\w.+-]*[\w+-]@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{{2,}})
  | (?P<ip>(?<![\w.])(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?!\w)(?!\.\d))
  | (?P<iban>(?<!\w)[A-Z]{{2}}\d{{2}}(?:\ ?[A-Z0-9]{{4}}){{3,7}}(?:\ ?[A-Z0-9]{{1,3}})?(?!\w))
  | (?P<phone>(?<![\w.])\+\d{{1,3}}[ .-]?\(?\d{{2,4}}\)?(?:[ .-]?\d{{2,4}}){{2,4}}(?!\d)
      | (?<![\w+])\(\d{{3}}\)\ ?\d{{3}}-\d{{4}}(?!\d) | (?<![\w.+-])\d{{3}}[-.]\d{{3}}[-.]\d{{4}}(?![\w-]))
  | (?P<card>(?<![\w.+-])(?:\d{{13,19}}|\d{{4}}([ -])\d{{4}}\6\d{{4}}\6\d{{1,7}})(?![\w-]))
  | (?P<ssn>(?<![\w.+-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
  | (?<!\w)(?P<title>{_TITLE})\.?\s(?P<name>{_CAPITAL}(?:\ {_CAPITAL})?)
""".replace(r"\6", r"(?P=gap)").replace("([ -])", "(?P<gap>[ -])"), re.X)
#: Every text with an entity matches this (Java) pattern; most others do not. Most characters fail its first test.
MAYBE = (r"(?=[@\d+A-Z" + "".join(sorted({t[0] for ts in TITLES.values() for t in ts if not t[0].isascii()})) + "])"
         + rf"(?:@|\d(?:\d\d|\.\d+\.\d|\d\.\d+\.\d)|\+\d|[A-Z]{{2}}\d{{2}}|(?:{_TITLE}))")


def script_of(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[:1] <= "ӿ" else "latin"


def entities(text: str | None) -> Iterator[tuple[int, int, str, str]]:
    """``(start, end, kind, canonical form)`` of the entities of a whole text, in order."""
    for m in _ENTITY.finditer(text or ""):
        kind = next(k for k in ("email", "ip", "iban", "phone", "card", "ssn", "name") if m[k] is not None)
        own = m[kind]
        if kind == "email":
            yield m.start(), m.end(), kind, own.lower()
        elif kind == "ip":
            if all(int(x) < 256 for x in own.split(".")):
                yield m.start(), m.end(), kind, ".".join(str(int(x)) for x in own.split("."))
        elif kind == "name":
            gender = "f" if m["title"] in TITLES["f"] else "m"
            parts, at = own.split(" "), m.start("name")
            for k, part in enumerate(parts):
                role = "s" if k == len(parts) - 1 else gender
                yield at, at + len(part), f"name:{script_of(part)}:{role}", part.lower()
                at += len(part) + 1
        else:
            plain = "".join(c for c in own if c.isalnum())
            yield m.start(), m.end(), kind, ("+" if own[0] == "+" else "") + plain


class _Draws:
    """An endless keyed stream of small numbers for one entity and attempt."""

    def __init__(self, key: bytes, *about: object) -> None:
        self.key, self.about, self.block, self.pool = key, "\x1f".join(map(str, about)), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.blake2b(f"{self.about}\x1f{self.block}".encode("utf-8", "surrogatepass"), key=self.key[:64]).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n


def _letter(c: str, draws: _Draws) -> str:
    low = c.lower()
    kind = next((k for k, letters in LETTERS.items() if low in letters), None)
    if c.isdigit():
        return str(draws.below(10))
    if kind is None:
        return c if not c.isalpha() else LETTERS["cyrillic" if "Ѐ" <= c <= "ӿ" else "accented"][draws.below(20)]
    new = LETTERS[kind][draws.below(len(LETTERS[kind]))]
    return new.upper() if c != low else new


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def surrogate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """Canonical form of the replacement; the same for the same key, entity and attempt."""
    draws = _Draws(key, kind, canonical, attempt)
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        labels = domain.split(".")
        shared = _Draws(key, "domain", domain)                        # one domain, one surrogate domain
        longer = "".join(_letter("a", draws) for _ in range(attempt // 4))      # short addresses are soon used up
        return ("".join(_letter(c, draws) for c in local) + longer + "@"
                + ".".join(["".join(_letter(c, shared) for c in x) for x in labels[:-1]] + labels[-1:]))
    if kind == "ip":
        return ".".join(str(1 + draws.below(254)) for _ in range(4))
    if kind.startswith("name:"):
        _, script, role = kind.split(":")
        names = NAMES[(script, role)]
        ending = "а" if (script, role) == ("cyrillic", "s") and canonical.endswith("а") else ""     # a woman's family name
        return "-".join(names[draws.below(len(names))] + ending for _ in range(1 + attempt // 2)).lower()
    if kind == "iban":
        return canonical[:2] + "".join(_letter(c, draws) for c in canonical[2:])
    keep = 1
    if kind == "phone":
        if canonical[0] != "+":
            keep = 0
        elif canonical[1] not in "17":
            keep = 3 if canonical[1:3] in CALLING_CODES else 4
        else:
            keep = 2
    elif kind == "ssn":
        keep = 0
    new = canonical[:keep] + "".join(str(draws.below(10)) for _ in canonical[keep:])
    if kind == "card":
        new = new[:-1] + str((10 - _luhn(new[:-1] + "0")) % 10)
        if _luhn(canonical):
            new = new[:-1] + str((int(new[-1]) + 1 + draws.below(9)) % 10)
    return new


def rendered(kind: str, new: str, original: str) -> str:
    """The replacement in the spelling (case, gaps, punctuation) of the original."""
    if kind == "ip":
        return new
    if kind.startswith("name:"):
        return new.upper() if original.isupper() else "-".join(x.capitalize() for x in new.split("-"))
    if kind == "email":
        local, _, domain = original.rpartition("@")
        cased = local + "a" * (len(new) - len(original)) + "@" + domain
        return "".join(c.upper() if o.isupper() else c for c, o in zip(new, cased))
    fresh = iter(new.lstrip("+"))
    return "".join(next(fresh) if c.isalnum() else c for c in original)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: set[tuple[int, str, str]] = set()
        for h, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows |= {(h, kind, canonical) for _, _, kind, canonical in entities(text.as_py())}
        cols = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                                         ["h", "kind", "canonical"])


def assign(distinct: DataFrame, key: bytes) -> DataFrame:
    """``(kind, canonical, new)``: a surrogate for each distinct entity, no two alike and none a real one."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, names, tries = (batch.column(k).to_pylist() for k in range(3))
            new = [surrogate(key, k, c, n) for k, c, n in zip(kinds, names, tries)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], ["kind", "canonical", "attempt", "new"])

    schema = "kind string, canonical string, attempt int, new string"
    real = distinct.select("kind", F.col("canonical").alias("new"))
    table = distinct.select("kind", "canonical", F.lit(0).alias("attempt")).mapInArrow(draw, schema)
    mine = F.struct("attempt", "canonical")
    while True:
        # what is settled stays, since it has the fewest attempts of its draw; a draw that many entities share
        # is an aggregate's row, not a group
        table = stage(table, "draws")
        owners = table.groupBy("kind", "new").agg(F.min(mine).alias("owner"))
        table = table.join(owners, ["kind", "new"]).join(real.withColumn("taken", F.lit(True)), ["kind", "new"], "left")
        clash = (F.col("owner") != mine) | (F.col("taken").isNotNull() & (F.col("attempt") < AVOID_REAL))
        table = stage(table.select("kind", "canonical", "attempt", "new", clash.alias("clash")), "surrogates")
        if table.where("clash").isEmpty():
            return table.select("kind", "canonical", "new")
        again = table.where("clash").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt")).mapInArrow(draw, schema)
        table = table.where("not clash").select("kind", "canonical", "attempt", "new").unionByName(again)


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for text, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            new = {(x["kind"], x["canonical"]): x["new"] for x in known or []}
            out, at, n = [], 0, 0
            for start, end, kind, canonical in entities(text):
                out += [text[at:start], rendered(kind, new[(kind, canonical)], text[start:end])]
                at, n = end, n + 1
            texts.append("".join([*out, text[at:]]) if n else text)
            counts.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                                         ["r", "body", "n"])


def replace_entities(df: DataFrame, key: bytes, text: str = "text", count: str | None = None) -> DataFrame:
    """``df`` with surrogates in its text column; ``count`` names an added column of replacements."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"), F.col(f"`{text}`").alias("body"))
    maybe = F.coalesce(F.col("body").rlike(MAYBE), F.lit(False))
    moved = rows.where(maybe).withColumn("h", F.xxhash64("body"))
    found = stage(moved.select("h", "body").mapInArrow(_found, "h long, kind string, canonical string").distinct(), "entities")
    table = assign(found.select("kind", "canonical").distinct(), key)
    by_text = (found.join(table, ["kind", "canonical"]).groupBy("h")
               .agg(F.collect_list(F.struct("kind", "canonical", "new")).alias("known")))
    kind = rows.schema["r"].dataType.simpleString()
    done = (moved.join(by_text, "h", "left").select("r", "body", "known")
            .mapInArrow(_replaced, f"r {kind}, body string, n long"))
    done = done.unionByName(rows.where(~maybe).select("r", "body", F.lit(0).cast("long").alias("n")))
    out = [F.col("body").alias(c) if c == text else F.col(f"r.`{c}`").alias(c) for c in df.columns]
    return done.select(*out, *([F.col("n").alias(count)] if count else []))
