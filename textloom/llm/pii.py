"""Operator 5: surrogates for personal data and secrets.

Entities are found by patterns and by titles before names; names found so are replaced wherever they stand capitalised in the same
document, initials only beside a name. Function words are names only beside a title. Each gets a replacement of its own type and format from a keyed
permutation of all strings of that format, so one entity has one surrogate everywhere and two never share one. Digits become
digits, hex becomes hex, letters become letters of the same script, case, and (in Latin) kind of sound; card check digits hold,
address octets stay octets, domains keep their ending. Listed given names become listed given names of the same gender; the name alone
decides, not the title before it.

A surrogate that is itself an entity of the corpus, or that another entity has, is given up, and the entity's next one comes from
another keyed permutation, so distinct entities have distinct surrogates. One that finds none in MOST_STEPS, as its format is used
up, gets a longer string of the same script.

The caller gives the key: who has it can turn surrogates back. Null texts stay null, texts without entities stay as they are. Repeated rows are replaced each. Ids may be null or repeated: a
document is known by its id and its text. Nothing is collected: entities are checked against each other by joins.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import secrets
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import slices, table, tidied, written

MOST_STEPS = 40

#: Titles before names, and given names by gender.
TITLES = {"mr": "m", "herr": "m", "señor": "m", "monsieur": "m", "sr": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "señora": "f", "señorita": "f", "madame": "f", "mme": "f", "mlle": "f", "sra": "f", "dr": "", "prof": ""}
GIVEN = {
    "m": "james john robert michael william david richard thomas charles daniel peter paul hans klaus jürgen stefan pierre jean louis andré carlos josé juan miguel luis pedro antonio".split(),
    "f": "mary patricia linda elizabeth barbara susan jessica sarah karen anna emma laura julia ursula sabine petra marie sophie claire camille maría carmen ana lucía isabel rosa elena".split(),
}
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"), "@"),
    ("secret", re.compile(r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b)[\"']?\s*[=:]\s*[\"']?([^\s\"',;]{6,})"), "=:"),
    ("awskey", re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"), "0"),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)"), "0"),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), "0"),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), "0"),
    ("phone", re.compile(r"(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\w)"), "0"),
    ("card", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"), "0"),
]
_TITLE, _WORD, _INITIAL = r"\b((?i:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r"))\b", r"[^\W\d_]+(?:[-'][^\W\d_]+)*", r"(?<![^\W_])[^\W\d_]\."
_PART = rf"(?:{_INITIAL}\s*)*{_WORD}"
NAME = re.compile(rf"{_TITLE}(\.?\s+)({_PART}(?:\s+{_PART}){{0,2}})")
TITLE_HINT = re.compile(rf"{_TITLE}\.?\s")
WORD, INITIALS = re.compile(_WORD), re.compile(rf"(?:{_INITIAL}\s*)+\Z")
FUNCTION_WORDS = frozenset("a an the and or but if in on at of to for from by with as is was are were be he she it they we you i this that these those his her its their our my your not no der die das ein eine und oder in im am zu von mit auf ist war er sie es wir ihr ich le la les un une et ou de du des en à est il elle nous vous je el los las una y o del al es era él ella".split())
DIGIT = re.compile(r"[0-9]")


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(first, last, type, entity) of what is found, without overlaps; the entity is the same for all spellings of it."""
    if not text:
        return []
    found, digits = [], DIGIT.search(text) is not None
    for rank, (kind, pattern, hint) in enumerate(PATTERNS):
        if hint == "0" and not digits or hint == "@" and "@" not in text or hint == "=:" and "=" not in text and ":" not in text:
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1) if pattern.groups else m.span()
            found.append((a, rank, b, kind, entity(kind, text[a:b])))
    if TITLE_HINT.search(text):
        names = set()
        for m in NAME.finditer(text):
            after_initial = False
            for w in WORD.finditer(text, m.start(3), m.end(3)):
                a, b, e = _name(w)
                if not _capital(e) or after_initial and e.lower() in FUNCTION_WORDS and text[b : b + 1] != ".":
                    break
                after_initial = len(e) == 1 and text[b : b + 1] == "."
                found.append((a, len(PATTERNS), b, *_named(e)))
                names.add(e.lower())
        if names:
            for w in WORD.finditer(text):
                a, b, e = _name(w)
                if len(e) == 1 or not _capital(e) or e.lower() not in names or e.lower() in FUNCTION_WORDS:
                    continue
                found.append((a, len(PATTERNS) + 1, b, *_named(e)))
                if before := INITIALS.search(text, max(0, a - 24), a):
                    found.extend((x.start(), len(PATTERNS) + 1, x.end(), *_named(x[0])) for x in WORD.finditer(text, before.start(), a))
    out, end = [], -1
    for a, _, b, kind, e in sorted(found):
        if a >= end:
            out.append((a, b, kind, e))
            end = b
    return out


def _name(w: re.Match) -> tuple[int, int, str]:
    """First and last character of a word without the 's of a genitive, and the word."""
    e = re.sub("'[sS]$", "", w[0])
    return w.start(), w.start() + len(e), e


def _capital(e: str) -> bool:
    """True of letters without case, too."""
    return e[0].isupper() or e[0].lower() == e[0].upper()


def _named(e: str) -> tuple[str, str]:
    """Type and entity of a name: the same after any title and without one."""
    low = e.lower()
    return next((f"given-{g}" for g, names in GIVEN.items() if low in names), "name"), low


def entity(kind: str, s: str) -> str:
    if kind == "email":
        return s.lower()
    return "".join(c for c in s if c.isalnum()) if kind in ("phone", "card", "ssn", "iban") else s


def _number(key: bytes, *parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), key=key[:64], digest_size=16).digest(), "big")


def permuted(n: int, size: int, key: bytes, tweak: str) -> int:
    """Keyed permutation of 0 .. size - 1: a Feistel network over the least even number of bits, walked back into range."""
    if size < 2:
        return n
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = n >> half, n & mask
        for r in range(8):
            left, right = right, left ^ (_number(key, tweak, str(size), str(r), str(right)) & mask)
        n = (left << half) | right
        if n < size:
            return n


@lru_cache(maxsize=4096)
def _alphabet(c: str) -> str:
    """The letters among which a character is replaced; itself alone if it stays."""
    if "0" <= c <= "9":
        return "0123456789"
    for group in (VOWELS, CONSONANTS):
        if c.lower() in group and c.isascii():
            return group if c.islower() else group.upper()
    if not c.isalpha():
        return c
    block, kind = ord(c) & ~0xFF, unicodedata.category(c)
    # only letters that keep their case partner inside the group, so that lower-casing never merges two
    return "".join(x for k in range(block, block + 256) if unicodedata.category(x := chr(k)) == kind and len(x.lower()) == len(x.upper()) == 1 and not x.isascii() and (x.lower().upper() == x or x.upper().lower() == x))


def _letters(s: str, key: bytes, tweak: str, alphabets: list[str] | None = None) -> str:
    """A string of the same format: every character within its alphabet, all of them by one permutation."""
    groups = [a if c in a else c for a, c in zip(alphabets or [_alphabet(c) for c in s], s, strict=True)]
    n, size = 0, 1
    for c, g in zip(s, groups, strict=True):
        n, size = n * len(g) + g.index(c), size * len(g)
    n = permuted(n, size, key, tweak + "\x1f" + "".join(g[0] + str(len(g)) for g in groups))
    out = []
    for g in reversed(groups):
        n, k = divmod(n, len(g))
        out.append(g[k])
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """The digit that completes a card number."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def step(kind: str, e: str, key: bytes) -> str:
    """The permutation of a type's entities."""
    if kind == "email":
        local, _, domain = e.partition("@")
        labels, end = domain.rsplit(".", 1)
        return f"{_letters(local, key, 'local' + domain)}@{_letters(labels, key, 'domain')}.{end}"
    if kind == "ip" and "." in e:
        octets = [int(x) for x in e.split(".")]
        usual = 1 <= octets[0] <= 223
        first, sizes = (octets[0] - 1, 223) if usual else (0 if octets[0] == 0 else octets[0] - 223, 33)
        n = permuted(((first * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3], sizes << 24, key, f"ip{usual}")
        first = n >> 24
        return ".".join(map(str, (first + 1 if usual else 0 if first == 0 else first + 223, n >> 16 & 255, n >> 8 & 255, n & 255)))
    if kind == "card":
        body, off = e[:-1], (int(e[-1]) - _luhn(e[:-1])) % 10
        new = body[0] + _letters(body[1:], key, f"card{body[0]}{off}")
        return new + str((_luhn(new) + off) % 10)
    if kind == "phone":
        keep = 1 if len(e) > 10 else 0
        return e[:keep] + _letters(e[keep:], key, "phone" + e[:keep], ["23456789"] + ["0123456789"] * (len(e) - keep - 1))
    if kind == "awskey":
        return e[:4] + _letters(e[4:], key, e[:4], ["ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"] * (len(e) - 4))
    if kind == "iban":
        return e[:2] + _letters(e[2:], key, "iban" + e[:2])
    if kind == "secret" and re.fullmatch("[0-9a-f]+", e):
        return _letters(e, key, kind, ["0123456789abcdef"] * len(e))
    if kind.startswith("given-"):
        cycle = sorted(GIVEN[kind[-1]], key=lambda x: _number(key, kind, x))  # one cycle over all names leaves none in place
        return cycle[(cycle.index(e) + 1) % len(cycle)]
    return _letters(e, key, kind)


def longer(kind: str, e: str, turn: int) -> str:
    """A longer string of the entity's script, another one for each entity and turn; digits for numbers."""
    data = b"\x01" + turn.to_bytes(2, "big") + e.encode("utf-8", "surrogatepass")
    cycle = [CONSONANTS, VOWELS]
    if kind in ("phone", "card", "ssn", "iban", "ip"):
        cycle = ["0123456789"]
    elif kind == "awskey":
        cycle = [CONSONANTS.upper(), VOWELS.upper()]
    elif kind == "name":
        cycle = next(([a] for c in e if not c.isascii() and len(a := _alphabet(c)) > 1), cycle) if not any(c.isascii() and c.isalpha() for c in e) else cycle
    n, size, out = int.from_bytes(data, "big"), 1, []
    while size < 256 ** len(data) or len(out) < 2 * turn:
        a = cycle[len(out) % len(cycle)]
        n, k = divmod(n, len(a))
        size *= len(a)
        out.append(a[k])
    new = "".join(out)
    if kind == "email":
        return f"{new}@{e.partition('@')[2]}"
    return (e[:4] if kind == "awskey" else e[:2] if kind == "iban" else "") + new


def spelt(kind: str, original: str, surrogate: str) -> str:
    """The surrogate with the original's separators and case."""
    if kind in ("phone", "card", "ssn", "iban"):
        it = iter(surrogate)
        return "".join(next(it) if c.isalnum() else c for c in original) if len(surrogate) == sum(map(str.isalnum, original)) else surrogate
    if kind == "email" or kind == "name" or kind.startswith("given-"):
        if len(original) == len(surrogate):
            return "".join(s.upper() if o.isupper() else s for o, s in zip(original, surrogate, strict=True))
        return surrogate.capitalize() if original[:1].isupper() else surrogate
    return surrogate


SPANS = "array<struct<first: int, last: int, kind: string, entity: string>>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("kind", pa.string()), ("entity", pa.string())]))


def surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, surrogate for distinct (kind, entity) rows; no surrogate is an entity or another's surrogate."""
    walking, done = written(entities, "pii-entities"), None
    taken = walking.select(F.col("kind").alias("k"), F.col("entity").alias("e")).where("NOT startswith(k, 'given-')")
    listed = [("name", x) for names in GIVEN.values() for x in names]  # given names have surrogates among them
    taken = taken.unionAll(walking.sparkSession.createDataFrame(listed, "k string, e string"))

    def stepped(turn: int):
        more = turn // MOST_STEPS
        own = key if turn == 0 else hashlib.blake2b(turn.to_bytes(8, "big"), key=key[:64], digest_size=32).digest()

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = zip(b.column("kind").to_pylist(), b.column("entity").to_pylist(), strict=True)
                new = [step(k, longer(k, e, more) if more else e, own) for k, e in rows]
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("entity"), pa.array(new, pa.string())], names=["kind", "entity", "surrogate"])

        return tidied(run)

    for turn in itertools.count():
        new = walking.mapInArrow(stepped(turn), "kind string, entity string, surrogate string")
        new = new.withColumn("n", F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("entity")))
        met = new.join(taken, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("e")), "left")
        tried = written(met.select("kind", "entity", "surrogate", (F.col("k").isNotNull() | (F.col("n") > 1)).alias("clash")), "pii-walk")
        free, walking = tried.where("NOT clash").drop("clash"), tried.where("clash").select("kind", "entity")
        done = free if done is None else done.unionAll(free)
        if walking.isEmpty():
            return done
        taken = taken.unionAll(free.select("kind", "surrogate"))


def replaced(df: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """All columns of all rows, entities replaced, with `entities`: first and last character in the new text, and kind."""
    where, columns = df.columns.index(text), df.columns
    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.col(f"`{text}`").alias("text"))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            spans = [detect(t) for t in b.column("text").to_pylist()]
            rows = [[dict(zip(("first", "last", "kind", "entity"), s, strict=True)) for s in ss] for ss in spans]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("text"), pa.array(rows, _SPANS)], names=["doc", "text", "spans"])

    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    span = lambda *more: ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType()), StructField("kind", StringType()), *more]))
    found = inner.mapInArrow(tidied(find), StructType([*inner.schema.fields, StructField("spans", span(StructField("entity", StringType())))]))
    dirty = written(found.where(F.size("spans") > 0).withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    mentions = dirty.select("row", F.posexplode("spans").alias("n", "s")).select("row", "n", F.col("s.kind").alias("kind"), F.col("s.entity").alias("entity"))
    known = surrogates(mentions.select("kind", "entity").distinct(), key)
    named = mentions.join(known, ["kind", "entity"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("n", "surrogate"))).alias("new"))

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts_, at = [], []
            for t, spans, new in zip(*(b.column(c).to_pylist() for c in ("text", "spans", "new")), strict=True):
                parts, end, length, spots = [], 0, 0, []
                for s, x in zip(spans, new, strict=True):
                    value = spelt(s["kind"], t[s["first"] : s["last"]], x["surrogate"])
                    parts += [t[end : s["first"]], value]
                    length += s["first"] - end
                    spots.append({"first": length, "last": length + len(value), "kind": s["kind"].split("-")[0]})
                    length, end = length + len(value), s["last"]
                texts_.append("".join([*parts, t[end:]]))
                at.append(spots)
            doc = b.column("doc")
            fields = [pa.array(texts_, pa.string()) if k == where else doc.field(k) for k in range(len(columns))]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, names=columns), pa.array(at, kind)], names=["doc", "entities"])

    out = StructType([inner.schema["doc"], StructField("entities", span())])
    changed = dirty.join(named, "row").select("doc", "text", "spans", "new").mapInArrow(tidied(put), out)
    clean = found.where(F.size("spans") == 0).select("doc", F.array().cast(span()).alias("entities"))
    both = clean.unionAll(changed)
    return both.select(*[F.col("doc").getField(c).alias(c) for c in columns], F.col("entities").alias("pii_entities"))


def session_key(spark: SparkSession) -> bytes:
    """The key in textloom.pii.key of the session; a new random one where it is unset, so that nobody can turn surrogates back."""
    own = spark.conf.get("textloom.pii.key", None)
    return own.encode() if own else secrets.token_bytes(32)


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replaced(docs, session_key(spark)).select("doc_id", "text", F.size("pii_entities").alias("n_entities"), F.col("pii_entities").alias("entities"))
