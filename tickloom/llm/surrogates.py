"""Keyed surrogates for personal data.

Detected entities (mail addresses, phone numbers, card numbers, IBANs, IP addresses, social security
numbers, titled names) are replaced by surrogates of the same type and format: digits stay digits, letters
keep script and case, punctuation stays. A surrogate is a keyed permutation of the entity's format, built
as a Feistel network over its digits and letters, so that different entities get different surrogates and
one entity gets the same surrogate everywhere, on every executor and in every run, without a table of
entities. Collision checks walk the permutation on until the surrogate is valid for its type (octets below
256, card check digits as before, given names inside or outside the lists as before), which keeps it one
to one; each batch asserts that, and ``collisions`` checks it over a whole corpus.

Given names of the lists are exchanged for names of the same list (gender and script); other names keep
their pattern of vowels and consonants. Without the key nothing can be traced back.

Null texts stay null; texts without entities are returned as they are. Ids may be null or repeated; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm import words as W

ROUNDS = 8

# given names by gender and script
NAMES = {
    ("f", "latin"): "Anna Maria Laura Emma Julia Sofia Clara Elena Lucia Marie Sarah Alice Carla Nora Ida Eva Mary Linda Susan Karen Jane Paula Ines Rosa".split(),
    ("m", "latin"): "John David Peter Paul Thomas Martin Daniel Lukas Jonas Felix Simon Oscar Hugo Louis Pierre Jean Carlos Juan Pablo Diego Robert James Karl Max".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Екатерина Юлия Дарья Вера".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил Павел Олег Игорь Борис".split(),
    ("f", "greek"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Ιωάννα Δήμητρα Βασιλική".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος Πέτρος Αλέξανδρος".split(),
}
# titles and the gender they tell; "" for either
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Dr": "", "Prof": "", "Господин": "m", "Госпожа": "f"}
# letters that replace each other, by script; case is kept
CLASSES = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ", "çñßþðł", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ",
]

_NAME = r"[^\W\d_a-z][^\W\d_]*(?:[-'][^\W\d_]+)*"
PATTERNS = [
    ("email", r"[A-Za-z0-9](?:[\w.+%-]*[\w+%-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![\d]|\.\d)"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![\d])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d])"),
    ("name", rf"\b(?:{'|'.join(TITLES)})\.? (?:{_NAME})(?: {_NAME}){{0,2}}"),
]
ENTITY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
# without one of these a text holds no entity
_HINT = re.compile(rf"[\d@]|{'|'.join(TITLES)}")


@lru_cache(maxsize=1)
def _alphabets() -> dict[str, tuple[str, int]]:
    out = {}
    for letters in ["0123456789", *CLASSES]:
        for case in {letters, letters.upper()}:
            if len(case) == len(letters) and len(set(case)) == len(case):
                out |= {c: (case, i) for i, c in enumerate(case) if c not in out}
    return out


class Keyed:
    """Surrogates under one key."""

    def __init__(self, key: bytes):
        self.key = key
        self.of: dict[tuple[str, str], str] = {}
        self.owner: dict[tuple[str, str], str] = {}

    def _permute(self, value: int, size: int, label: str) -> int:
        """A keyed permutation of range(size): Feistel over two near-equal halves, walked until inside."""
        half = math.isqrt(max(size - 1, 0)) + 1
        width = (half.bit_length() + 15) // 8
        while True:
            left, right = divmod(value, half)
            for i in range(ROUNDS):
                tag = hmac.new(self.key, f"{label}|{size}|{i}|{right}".encode(), hashlib.sha256).digest()
                spread = b"".join(hashlib.sha256(tag + bytes([k])).digest() for k in range(-(-width // 32)))
                left, right = right, (left + int.from_bytes(spread[:width], "big")) % half
            value = left * half + right
            if value < size:
                return value

    def shaped(self, text: str, label: str) -> str:
        """``text`` with its digits and letters permuted inside their classes."""
        alphabets = _alphabets()
        slots = [(i, *alphabets[c]) for i, c in enumerate(text) if c in alphabets]
        if not slots:
            return text
        value, size = 0, 1
        for _, letters, digit in slots:
            value, size = value * len(letters) + digit, size * len(letters)
        shape = "".join(alphabets[c][0][0] if c in alphabets else c for c in text)
        value, out = self._permute(value, size, f"{label}|{shape}"), list(text)
        for i, letters, _ in reversed(slots):
            value, digit = divmod(value, len(letters))
            out[i] = letters[digit]
        return "".join(out)

    def _walk(self, text: str, label: str, valid) -> str:
        """The next value of the permutation that is as valid as the text: one to one among such."""
        new = self.shaped(text, label)
        while valid(new) != valid(text):
            new = self.shaped(new, label)
        return new

    def _name(self, text: str) -> str:
        title, rest = re.match(r"(\S+? )(.*)", text, re.S).groups()
        gender = TITLES.get(title.strip(" ."), "")
        parts = rest.split(" ")
        for (g, script), names in NAMES.items():
            if parts[0] in names:
                swapped = names[self._permute(names.index(parts[0]), len(names), f"given|{g}|{script}")]
                return title + " ".join([swapped, *[self.shaped(p, "family") for p in parts[1:]]])
        known = {n for names in NAMES.values() for n in names}
        return title + " ".join([self._walk(parts[0], f"name|{gender}", lambda n: n in known), *[self.shaped(p, "family") for p in parts[1:]]])

    def surrogate(self, kind: str, text: str) -> str:
        """The entity's surrogate; written forms that differ in blanks or dashes alone stay one entity."""
        known = self.of.get((kind, text))
        if known is not None:
            return known
        if len(self.of) > 200_000:
            self.of, self.owner = {}, {}
        if kind == "email":
            local, domain = text.rsplit("@", 1)
            labels = domain.split(".")
            # the host keeps its public suffix, every other label gets a surrogate
            new = self.shaped(local, "local") + "@" + ".".join([*[self.shaped(x, "host") for x in labels[:-1]], labels[-1]])
        elif kind == "ip":
            new = self._walk(text, kind, lambda t: all(int(x) < 256 and x == str(int(x)) for x in t.split(".")))
        elif kind in ("card", "phone", "ssn", "iban"):
            bare = re.sub(r"[^A-Za-z0-9]", "", text)
            if kind == "card":
                fresh = self._walk(bare, kind, luhn)
            elif kind == "iban":
                fresh = bare[:2] + self.shaped(bare[2:], bare[:2])
            elif kind == "phone" and text.startswith("+"):
                code = re.match(r"\+(\d{1,3}?)(?=[ .(-]|$|\d{7,}$)", text)
                keep = len(code[1]) if code else 1
                fresh = bare[:keep] + self.shaped(bare[keep:], f"phone|{bare[:keep]}")
            else:
                fresh = self.shaped(bare, kind)
            turn = iter(fresh)
            new = "".join(next(turn) if c.isalnum() else c for c in text)
        else:
            new = self._name(text)
        if self.owner.setdefault((kind, new), text) != text:
            raise AssertionError("two entities share a surrogate")
        self.of[kind, text] = new
        return new

    def rewritten(self, text: str) -> tuple[str, list[tuple[str, str, str]]]:
        """The text with surrogates, and (kind, entity, surrogate) of each place."""
        found: list[tuple[str, str, str]] = []
        if not _HINT.search(text):
            return text, found

        def swap(m: re.Match) -> str:
            new = self.surrogate(m.lastgroup, m[0])
            found.append((m.lastgroup, m[0], new))
            return new

        return ENTITY.sub(swap, text), found


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[::-1]]
    return (sum(odd[::2]) + sum(sum(divmod(2 * d, 10)) for d in odd[1::2])) % 10 == 0


KINDS = [k for k, _ in PATTERNS]


def surrogates(docs: DataFrame, *keep: str | Column, key: bytes, text: str = "text") -> DataFrame:
    """The columns ``keep`` with the rewritten text and the number of places of each kind."""
    narrow = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kept = [f for f in narrow.schema.fields if f.name != "_text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string, n_entities long"] + [f"n_{k} long" for k in KINDS])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Keyed(key)
        for cut in W.cuts(batches, "_text"):
            done = [(None, []) if t is None else keyed.rewritten(t) for t in cut.column("_text").to_pylist()]
            counts = [pa.array([sum(e[0] == k for e in found) for _, found in done], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [*cut.columns[:-1], pa.array([t for t, _ in done], pa.string()), pa.array([len(f) for _, f in done], pa.int64()), *counts],
                [*cut.schema.names[:-1], "text", "n_entities", *[f"n_{k}" for k in KINDS]],
            )

    return narrow.mapInArrow(run, schema)


def collisions(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """Surrogates that several entities share over the whole table, or entities with several: none, if all is well."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Keyed(key)
        for cut in W.cuts(batches, "_text"):
            rows = {e for t in cut.column("_text").to_pylist() if t for e in keyed.rewritten(t)[1]}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["kind", "entity", "surrogate"])

    found = docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(run, "kind string, entity string, surrogate string").distinct()
    shared = found.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).select("kind", F.col("surrogate").alias("value"), "n")
    split = found.groupBy("kind", "entity").agg(F.count("*").alias("n")).select("kind", F.col("entity").alias("value"), "n")
    return shared.union(split).where("n > 1")
