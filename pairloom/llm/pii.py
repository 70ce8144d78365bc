"""PII: detection and surrogate generation (operator 7).

Every detected entity is replaced by a keyed surrogate of its own type.  A
surrogate keeps the entity's format: digits stay digits, letters stay letters
of their script, case and (for names) vowel or consonant, punctuation stays, a
card that passes the Luhn check gives one that passes, a network address gives a
valid one; a listed first name gives one of the same gender and script.

Surrogates come from keyed permutations (Feistel networks over the symbols, so
no two entities of one format can meet, and one entity has one surrogate in
every document and in every layout of it: coreference needs no table).  The
entities found are nevertheless checked: distinct entities whose surrogates
agree are drawn again until none do."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import ROWS_AT_ONCE, map_texts, slim

KEY = b"pairloom"            # production jobs pass their own secret
ROUNDS, REDRAWS = 6, 8
MAX_REDRAWN = 100_000        # entities that may be redrawn: shipped to the tasks

PATTERN = re.compile(
    r"""(?P<secret>(?:(?<=["'=:\s])|^)(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,})
        |(?<![0-9A-Za-z])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,}(?![0-9A-Za-z]))
      |(?:(?i:api[_-]?key|token|secret|password|passwd|access[_-]?key)\s*[=:]\s*["']?)(?P<assigned>[A-Za-z0-9_/+-]{12,})
      |(?P<email>(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
      |(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))
      |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
      |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
      |(?P<card>(?<![\w+-])\d(?:[ -]?\d){12,18}(?![\w-]))
      |(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)
        |(?<![\w+.-])(?:\+?\d{1,3}[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])|(?<!\w)\+\d{8,15}(?!\w)|(?<![\w.+-])\d{3}-\d{4}(?![\w-]))
      |(?:(?<!\w)(?P<title>Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Señor|Señora|Г-н|Г-жа)\.?[ ])(?P<name>[^\W\d_a-zа-яß-ÿ][^\W\d_]+(?:[ ][^\W\d_a-zа-яß-ÿ][^\W\d_]+)?)""",
    re.X)
#: an address that begins where another entity ends; elsewhere addresses begin
#: where their run of characters does, so a long run is read once
REST = re.compile(r"[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
#: characters without which none of the patterns can match
HINT = re.compile(r"[0-9@=:]|\b(?:M[rsi]|Herr|Frau|Monsieur|Madame|Señor|Г-)")
KINDS = ("secret", "assigned", "email", "ip", "iban", "ssn", "card", "phone", "name")

FIRST_NAMES = {
    ("latin", "f"): "Anna Clara Emma Greta Helen Irene Julia Laura Maria Nora Paula Sofia".split(),
    ("latin", "m"): "Adam Bruno David Emil Felix Hugo Jonas Leo Martin Oscar Paul Victor".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("cyrillic", "m"): "Борис Виктор Денис Иван Кирилл Максим Олег Павел".split(),
}
GENDER = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Г-н": "m", "Mrs": "f", "Ms": "f", "Miss": "f",
          "Frau": "f", "Madame": "f", "Señora": "f", "Г-жа": "f"}
#: letters that stand for each other: surrogates keep the class of each symbol
CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäéèêëíîïóôöúùûü", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
_VOWELS = {c: (k, i) for k, s in enumerate(CLASSES) for i, c in enumerate(s)}


def luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def iban_check(text: str) -> int:
    """The number modulo 97 with its first four characters last: 1 if valid."""
    packed = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97


class Surrogates:
    """Keyed surrogates; ``redrawn`` maps (kind, canonical form) to the number
    of the draw that avoids a collision."""

    def __init__(self, key: bytes = KEY, redrawn: dict | None = None):
        self.key, self.redrawn = key, redrawn or {}
        self.lists = {f: k for k, names in FIRST_NAMES.items() for f in names}

    def permute(self, tweak: str, symbols: list[int], radix: list[int]) -> list[int]:
        """A keyed bijection of the symbol strings with these radices."""
        n = len(symbols)
        if not n:
            return []
        half = n // 2
        a, b = list(symbols[:half]), list(symbols[half:])
        ra, rb = radix[:half], radix[half:]
        head = self.key + b"|" + tweak.encode() + b"|" + bytes(str(radix), "ascii")

        def stream(r: int, part: list[int], size: int) -> np.ndarray:
            h = hashlib.shake_256(head + b"|%d|" % r + np.asarray(part, "<u4").tobytes())
            return np.frombuffer(h.digest(4 * size), "<u4")

        for r in range(ROUNDS):
            a = [(x + int(s)) % m for x, s, m in zip(a, stream(2 * r, b, len(a)), ra)]
            b = [(x + int(s)) % m for x, s, m in zip(b, stream(2 * r + 1, a, len(b)), rb)]
        return a + b

    def _digits(self, tweak: str, digits: list[int]) -> list[int]:
        return self.permute(tweak, digits, [10] * len(digits))

    def _letters(self, tweak: str, text: str, by_class: bool) -> str:
        """Permute digits and letters in place; other symbols stay."""
        where, symbols, radix, back = [], [], [], []
        for i, c in enumerate(text):
            low = c.lower()
            if c.isascii() and c.isdigit():
                kind = "0123456789"
            elif by_class and low in _VOWELS:
                kind = CLASSES[_VOWELS[low][0]]
            elif "a" <= low <= "z":
                kind = "abcdefghijklmnopqrstuvwxyz"
            elif low in _VOWELS:
                kind = CLASSES[_VOWELS[low][0]]
            else:
                continue
            where.append(i)
            symbols.append(kind.index(low))
            radix.append(len(kind))
            back.append((kind, c != low))
        out = list(text)
        for i, s, (kind, upper) in zip(where, self.permute(tweak, symbols, radix), back):
            out[i] = kind[s].upper() if upper else kind[s]
        return "".join(out)

    @staticmethod
    def canonical(kind: str, text: str) -> str:
        """What two mentions of one entity have in common."""
        if kind in ("card", "ssn", "phone"):
            digits = re.sub(r"\D", "", text)
            return digits[-10:] if kind == "phone" else digits
        if kind == "iban":
            return text.replace(" ", "")
        return text.lower() if kind in ("email", "name") else text

    def surrogate(self, kind: str, text: str, gender: str = "") -> str:
        draw = self.redrawn.get((kind, self.canonical(kind, text)), 0)
        tweak = f"{kind}{draw}"
        if kind == "ip":
            n = [int(x) for x in text.split(".")]
            return ".".join(map(str, self.permute(tweak, n, [256] * 4)))
        if kind in ("card", "ssn", "phone"):
            digits = [int(c) for c in text if c.isdigit()]
            if kind == "card" and luhn(digits):
                new = self._digits(tweak + "valid", digits[:-1])
                new.append(next(c for c in range(10) if luhn([*new, c])))
            elif kind == "card":
                new = self._digits(tweak, digits)
                while luhn(new):  # walk on within the numbers that fail the check
                    new = self._digits(tweak, new)
            elif kind == "phone" and len(digits) > 10:
                new = digits[:-10] + self._digits(tweak, digits[-10:])  # the country code stays
            else:
                new = self._digits(tweak, digits)
            left = iter(new)
            return "".join(str(next(left)) if c.isdigit() else c for c in text)
        if kind == "email":
            at, dot = text.rindex("@"), text.rindex(".")
            return self._letters(tweak, text[:at], True) + "@" + self._letters(tweak + "domain", text[at + 1 : dot], True) + text[dot:]
        if kind == "name":  # word by word, so a later mention by one word agrees
            return " ".join(self._name(f"name{self.redrawn.get((kind, w.lower()), 0)}", w, gender) for w in text.split(" "))
        if kind == "iban" and iban_check(text) == 1:  # the check digits follow the new number
            new = self._spaced(tweak, text)
            digits = f"{98 - iban_check(new[:2] + '00' + new[4:]):02d}"
            return new[:2] + digits + new[4:]
        if kind == "iban":
            return text[:2] + self._letters(tweak, text[2:].replace(" ", ""), False) if " " not in text else self._spaced(tweak, text)
        prefix = re.match(r"AKIA|gh[pousr]_|sk-", text)
        cut = prefix.end() if prefix else 0
        body = text[cut:]
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body):
            hexes = "0123456789abcdef" if body == body.lower() else "0123456789ABCDEF"
            return text[:cut] + "".join(hexes[s] for s in self.permute(tweak, [hexes.index(c) for c in body], [16] * len(body)))
        return text[:cut] + self._letters(tweak, body, False)

    def _spaced(self, tweak: str, text: str) -> str:
        packed = iter(self._letters(tweak, text[2:].replace(" ", ""), False))
        return text[:2] + "".join(c if c == " " else next(packed) for c in text[2:])

    def _name(self, tweak: str, word: str, gender: str) -> str:
        where = self.lists.get(word)
        if where and (not gender or where[1] == gender):
            names = FIRST_NAMES[where]
            shift = int.from_bytes(hashlib.sha256(self.key + f"|{tweak}|{where}".encode()).digest()[:4], "little") % (len(names) - 1) + 1
            return names[(names.index(word) + shift) % len(names)]
        new = self._letters(tweak, word, True)
        # a permuted name must not be taken for one of the listed names' surrogates
        return self._letters(tweak, new, True) if new in self.lists else new


def entities(text: str):
    """(kind, start, end, gender) of the entities of a text, left to right.
    A word of a name found after a title is a name wherever else it stands
    alone in the text, with the gender of the first title."""
    if not HINT.search(text):
        return
    found, words = [], {}
    for m in PATTERN.finditer(text):
        kind = m.lastgroup if m.lastgroup != "title" else "name"
        gender, start, end = GENDER.get(m["title"] or "", ""), m.start(kind), m.end(kind)
        if found and found[-1][2] > start:  # an address that went on behind the entity before
            continue
        if kind == "name":
            for w in m["name"].split(" "):
                gender = words.setdefault(w, gender) or gender
        found.append((kind, start, end, gender))
        rest = REST.match(text, end) if kind != "email" else None
        if rest:
            found.append(("email", end, rest.end(), ""))
    if not words:
        yield from found
        return
    again = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, words), key=len, reverse=True))})(?!\w)")
    at = 0
    for entity in [*found, ("", len(text), len(text), "")]:
        for m in again.finditer(text, at, entity[1]):
            if not text[m.end():m.end() + 1].isalnum():
                yield "name", m.start(), m.end(), words[m[0]]
        if entity[0]:
            yield entity
        at = entity[2]


def replace(text: str, names: Surrogates) -> tuple[str, int]:
    out, at, n = [], 0, 0
    for kind, s, e, gender in entities(text):
        out += [text[at:s], names.surrogate(kind, text[s:e], gender)]
        at, n = e, n + 1
    return ("".join(out) + text[at:], n) if n else (text, 0)


def mentions(docs: DataFrame) -> DataFrame:
    """Distinct (kind, entity, gender) mentioned in the (doc_id, text) table."""

    def run(batches):
        for b in batches:
            # a name is known by its words
            found = sorted({(k, w, g) for t in b.column(1).to_pylist() for k, s, e, g in entities(t) for w in (t[s:e].split(" ") if k == "name" else [t[s:e]])})
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in map(list, zip(*found))], names=["kind", "entity", "gender"])

    return docs.select("doc_id", "text").mapInArrow(run, "kind string, entity string, gender string").distinct()


def collisions(found: DataFrame, key: bytes, redrawn: dict) -> list:
    """Entities to draw again: of those with one surrogate, all but the first."""

    def run(batches):
        names = Surrogates(key, redrawn)
        for b in batches:
            rows = [(k, names.canonical(k, t), names.canonical(k, names.surrogate(k, t, g))) for k, t, g in zip(*(b.column(i).to_pylist() for i in range(3)))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in map(list, zip(*rows))], names=["kind", "canon", "fake"])

    drawn = found.mapInArrow(run, "kind string, canon string, fake string").distinct()
    several = drawn.groupBy("kind", "fake").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo <> hi")
    again = drawn.join(several, ["kind", "fake"]).where("canon <> lo").select("kind", "canon").distinct().limit(MAX_REDRAWN + 1).collect()
    if len(again) > MAX_REDRAWN:
        raise ValueError(f"more than {MAX_REDRAWN} colliding surrogates; use another key")
    return again


def keyed(docs: DataFrame, key: bytes = KEY) -> dict:
    """Draws that avoid all collisions among the entities of (doc_id, text)."""
    found, redrawn = mentions(docs), {}
    for draw in range(1, REDRAWS + 1):
        again = collisions(found, key, redrawn)
        if not again:
            return redrawn
        redrawn |= {(r["kind"], r["canon"]): draw for r in again}
    raise ValueError(f"surrogates still collide after {REDRAWS} draws")


def pseudonymise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """One row per input row: doc_id, text with surrogates, n_entities.

    Null and empty texts become empty texts without entities; a null id stays
    null; repeated rows get equal results; other columns are ignored; an empty
    table gives no rows.  Overlapping matches: the leftmost, then the first
    kind of the pattern, wins.  A text without entities is returned as is."""
    docs = slim(df, id_col, text_col)
    redrawn = keyed(docs, key)

    def make():
        names = Surrogates(key, redrawn)

        def fn(ids, texts):
            got = [replace(t, names) for t in texts]
            return [ids, [t for t, _ in got], [n for _, n in got]]

        return fn

    return map_texts(docs, make, "doc_id long, text string, n_entities int")


def pseudonymise_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """``df`` with all its columns and its texts pseudonymised (a null text
    stays null); no join, no shuffle of texts."""
    redrawn, at = keyed(slim(df, id_col, text_col), key), df.columns.index(text_col)

    def run(batches):
        names = Surrogates(key, redrawn)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                texts = [t and replace(t, names)[0] for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))
