"""Personal data replaced by keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.common import id_and_text, pieces
from tablegauge.session import broadcast_if_small, materialize

#: Surrogates that one task remembers.
CACHE_ENTITIES = 100_000
# Forms of address and the gender they state.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f",
          "Señor": "m", "Señora": "f", "господин": "m", "госпожа": "f"}
#: Capital letters of the Latin, Greek, Cyrillic and Armenian alphabets, and what may follow them in a word.
UPPER = "[" + "".join(chr(c) for r in (range(0x41, 0x590), range(0x1E00, 0x1F00)) for c in r if chr(c).isupper()) + "]"
LETTER = r"(?:[^\W\d_][\u0300-\u036f]*)"
#: A capitalised word with its hyphens and apostrophes, without the endings of contractions.
WORD = rf"(?:[dlDL]['’])?{UPPER}[\u0300-\u036f]*{LETTER}*(?:['’](?!(?:s|ll|d|ve|re|m)\b){LETTER}+|[-‐]{LETTER}+)*(?!{LETTER})"
INITIALS = rf"{UPPER}\.(?:[ -]?{UPPER}\.)*"
PARTICLES = ("(?:van|von|der|den|dem|de|del|della|di|da|do|dos|das|du|des|la|las|le|los|el|al|y|e|i|zu|zum|zur|vom|ten|ter|af|av"
             "|bin|ibn|bint|ben|фон|де)")
PART = rf"(?:{PARTICLES}[^\S\r\n])*(?:{INITIALS}|{WORD})"
#: International and national numbers; few digits are none.
NATIONAL = (r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(0\)[ ]?)?\(?\d{1,4}\)?(?:[ ./-]?\d{2,8}){1,5}(?!\d)"
            r"|(?<![\d+(])(?<!\d[ ./-])(?:\(0[1-9]\d{1,3}\) ?|0[1-9]\d{1,3}[ /-])\d{3,8}(?:[ -]\d{2,5}){0,3}(?![ .-]?\d)"
            r"|(?<![\d+])(?<!\d[ ./-])0[1-9](?P<fr>[ .-])\d\d(?:(?P=fr)\d\d){3}(?![ .-]?\d)"
            r"|(?<![\d+])(?<!\d[ ./-])(?:[89]\d[ ]\d{3}|[6-9]\d\d[ ]\d\d)[ ]\d\d[ ]\d\d(?![ .-]?\d)"
            r"|(?<![\d+])(?<!\d[ ./-])8[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]\d\d[ -]\d\d(?!\d)"
            r"|(?<![\d.-])(?:1[.-])?\d{3}(?P<us>[.-])\d{3}(?P=us)\d{4}(?![\d]|[.-]\d)"
            r"|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)")
#: In order of preference where two kinds start together.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "ip": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"),
    "card": re.compile(r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"),
    "phone": re.compile(r"(?=[+(0-9])(?:(?<![\w+])\+\d{1,3}[ -]?\(?\d{2,4}\)?(?:[ -]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) \d{3}-\d{4}(?!\d)"
                        r"|(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])|" + NATIONAL + ")"),
    "name": re.compile(rf"\b(?P<title>{'|'.join(TITLES)})\.?[^\S\r\n](?:(?:Dr|Prof|Professor|Doktor)\.?[^\S\r\n])*"
                       rf"(?P<name>{PART}(?:[^\S\r\n]{PART})*)"),
}
KINDS = tuple(PATTERNS)
# Consonants and vowels of each script, and the endings that state a gender.
SOUNDS = {"latin": ("bdfgklmnprstv", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"),
          "greek": ("βγδζκλμνπρστφ", "αειου"), "armenian": ("բգդզկլմնպրստվ", "աեիոէ")}
ENDINGS = {("latin", "m"): "n", ("latin", "f"): "na", ("cyrillic", "m"): "н", ("cyrillic", "f"): "на",
           ("greek", "m"): "ς", ("greek", "f"): "να", ("armenian", "m"): "ն", ("armenian", "f"): "նա"}
#: Starts the syllables that tell equal proposals apart; no other syllable has it.
MARKS = {"latin": "z", "cyrillic": "ф", "greek": "χ", "armenian": "ք"}
SCRIPTS = (("greek", 0x370, 0x400), ("cyrillic", 0x400, 0x530), ("armenian", 0x530, 0x590), ("greek", 0x1F00, 0x2000))


#: The parts of a name: initials and words.
PARTS = re.compile(rf"(?P<initial>(?<!\w){UPPER}\.)|(?<![\w'’-]){WORD}")
PIECE = re.compile(rf"{LETTER}+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value), leftmost first and without overlap."""
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            value, (start, end) = m[0], m.span()
            if kind == "name":
                value, (start, end) = f"{TITLES[m['title']]}:{m['name']}", m.span("name")
            elif kind == "card" and not luhn(re.sub(r"\D", "", value)):
                continue
            elif kind == "phone" and len(re.sub(r"\D", "", value)) < (7 if value[0] == "+" else 8):
                continue
            found.append((start, rank, end, kind, value.lower() if kind == "email" else value))
    out, at = [], 0
    for start, _, end, kind, value in sorted(found):
        if start >= at:
            out.append((start, end, kind, value))
            at = end
    return out


def _canonical(part: str) -> str:
    """A part of a name as it is written in mixed case; one letter stands for an initial."""
    part = unicodedata.normalize("NFC", part)
    letters = "".join(PIECE.findall(part))
    if len(letters) == 1:
        return letters
    return PIECE.sub(lambda m: m[0].capitalize(), part) if letters.isupper() else part


def find_parts(text: str) -> list[tuple[int, int, str, str, int, int]]:
    """(start, end, kind, canonical value, start and end of the entity) of what is replaced.

    Names go by their parts, so that a person keeps a surrogate under every form of the name;
    the parts of all persons are also found without a form of address, anywhere in the text.
    A part of several persons belongs to the last one named before it, else to the first.
    """
    out, persons, taken = [], {}, []
    for start, end, kind, value in find_entities(text):
        taken.append((start, end))
        if kind != "name":
            out.append((start, end, kind, value, start, end))
            continue
        gender = value[0]
        for m in PARTS.finditer(text, start, end):
            part = _canonical(m[0])
            if len(part) == 1:
                out.append((m.start(), m.start() + 1, kind, f"i:{part}", start, end))
            else:
                out.append((*m.span(), kind, f"{gender}:{part}", start, end))
                persons.setdefault(part, []).append((start, gender))
    if not persons:
        return out
    starts = [s for s, _ in taken]

    def bare(start: int, end: int) -> bool:
        part = _canonical(text[start:end])
        at = bisect_right(starts, start) - 1
        if part not in persons or (at >= 0 and start < taken[at][1]) or (at + 1 < len(taken) and taken[at + 1][0] < end):
            return False
        known = persons[part]
        gender = known[max(0, bisect_right(known, (start, "")) - 1)][1]
        out.append((start, end, "name", f"{gender}:{part}", start, end))
        return True

    for m in PARTS.finditer(text):
        if not m["initial"] and not bare(*m.span()):
            for piece in PIECE.finditer(text, *m.span()):
                if piece.span() != m.span():
                    bare(*piece.span())
    return sorted(out)


# --- keyed permutations of shapes ----------------------------------------------------------


def _digest(key: bytes, *parts: object) -> int:
    text = "|".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(blake2b(text, key=key).digest(), "big")


def permuted(key: bytes, shape: str, value: int, size: int, forward: bool = True) -> int:
    """A keyed permutation of ``0 .. size - 1`` that depends on the shape.

    Four rounds of a network over two halves permute the numbers of as many bits; a number that
    leaves the range goes round again until it is back.
    """
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for r in (0, 1, 2, 3) if forward else (3, 2, 1, 0):
            if forward:
                a, b = b, a ^ (_wide(key, shape, r, b, half) & mask)
            else:
                a, b = b ^ (_wide(key, shape, r, a, half) & mask), a
        value = a << half | b
        if value < size:
            return value


def _wide(key: bytes, shape: str, r: int, x: int, bits: int) -> int:
    """At least ``bits`` keyed bits."""
    out, block = 0, 0
    while 512 * block < bits:
        out, block = out << 512 | _digest(key, shape, r, block, x), block + 1
    return out


def another(key: bytes, shape: str, value: int, size: int) -> int:
    """Another value of the shape: the next one on a keyed ring of all its values.

    It is a permutation too, so values stay apart, and none stays itself unless it is alone.
    """
    return permuted(key, shape, (permuted(key, shape, value, size, forward=False) + 1) % size, size)


def _reshaped(key: bytes, kind: str, text: str) -> str:
    """Another text of the same shape: letters for letters of the same case and script, digits
    for digits; other signs, and letters of scripts without an alphabet here, stay."""
    places, shape = [], list(text)
    for i, c in enumerate(text):
        if c.isdecimal():
            places.append((i, ord(c) - unicodedata.decimal(c), unicodedata.decimal(c), 10))
        elif "a" <= c <= "z" or "A" <= c <= "Z":
            first = 97 if c >= "a" else 65
            places.append((i, first, ord(c) - first, 26))
        elif "а" <= c <= "я" or "А" <= c <= "Я":
            first = 0x430 if c >= "а" else 0x410
            places.append((i, first, ord(c) - first, 32))
    value, size = 0, 1
    for i, first, digit, base in places:
        shape[i] = f"<{first}>"
        value, size = value * base + digit, size * base
    if size == 1:
        return text
    value = another(key, kind + "|" + "".join(shape), value, size)
    out = list(text)
    for i, first, _, base in reversed(places):
        value, digit = divmod(value, base)
        out[i] = chr(first + digit)
    return "".join(out)


def script_of(name: str) -> str:
    """The script of the first letter that is not Latin, else Latin."""
    return next((s for c in name for s, lo, hi in SCRIPTS if lo <= ord(c) < hi and c.isalpha()), "latin")


def _syllables(script: str, number: int, count: int) -> str:
    consonants, vowels = SOUNDS[script]
    out = []
    for _ in range(count):
        number, digit = divmod(number, len(consonants) * len(vowels))
        out.append(consonants[digit // len(vowels)] + vowels[digit % len(vowels)])
    return "".join(out)


def surrogate(key: bytes, kind: str, value: str, rank: int = 0) -> str:
    """The replacement of an entity.

    E-mail and IP addresses, phone and card numbers get another value of their own shape, so two
    of a shape never agree and none keeps its own.  A name gets syllables of its script and the
    ending of its gender; of names with equal syllables all but the first are told apart by
    ``rank``, in syllables that no other name has.
    """
    if kind == "email":
        head, _, top = value.rpartition(".")
        return f"{_reshaped(key, kind, head)}.{top}"
    if kind == "ip":
        number = another(key, kind, int.from_bytes(bytes(map(int, value.split("."))), "big"), 1 << 32)
        return ".".join(map(str, number.to_bytes(4, "big")))
    if kind == "phone":
        lead = re.match(r"\+\d{1,3}|\(?0", value)
        lead = lead[0] if lead else ""
        return lead + _reshaped(key, f"{kind}|{lead}", value[len(lead):])
    if kind == "card":
        # The first digit stays and the last one is computed: the others are free.
        first = next(i for i, c in enumerate(value) if c.isdigit())
        body = value[: first + 1] + _reshaped(key, f"{kind}|{value[: first + 1]}", value[first + 1: -1])
        return next(body + d for d in "0123456789" if luhn(re.sub(r"\D", "", body + d)))
    gender, _, name = value.partition(":")
    made = 0

    def word(m: re.Match) -> str:
        nonlocal made
        if len(m[0]) == 1:
            return initial(key, m[0])
        script, made = script_of(m[0]), made + 1
        count = max(3, (len(m[0]) - 1) // 2)
        new = _syllables(script, _digest(key, "name", made, value), count)
        if made == 1 and rank:
            consonant, vowels = MARKS[script], SOUNDS[script][1]
            left = rank
            while left:
                left, digit = divmod(left - 1, len(vowels))
                new += consonant + vowels[digit]
        new += ENDINGS[script, gender]
        return new.capitalize() if m[0][0].isupper() else new

    return PIECE.sub(word, name)


#: Alphabets by the code point of their first small letter, and their lengths.
ALPHABETS = ((0x61, 26), (0x430, 32), (0x3B1, 25), (0x561, 38))


def initial(key: bytes, letter: str) -> str:
    """Another letter of the same case and script: the next one on a keyed ring, so letters stay
    apart.  A letter outside the alphabets goes by its plain form, or stays."""
    low = letter.lower()
    plain = low if any(f <= ord(low) < f + n for f, n in ALPHABETS) else unicodedata.normalize("NFD", low)[0]
    for first, n in ALPHABETS:
        if first <= ord(plain) < first + n:
            new = plain
            while new in (plain, "ς"):                  # the final form of sigma has no capital of its own
                new = chr(first + another(key, f"initial|{first}", ord(new) - first, n))
            return new.upper() if letter.isupper() else new
    return letter


def _detect(key: bytes):
    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict[tuple[str, str], str] = {}
        for batch in batches:
            for part in pieces(batch, ["text"]):
                rows = []
                for r, t, x in zip(part["rid"], part["tid"], part["text"]):
                    for begin, end, kind, value, first, last in find_parts(x):
                        new = memory.get((kind, value))
                        if new is None and not value.startswith("i:"):
                            if len(memory) >= CACHE_ENTITIES:
                                memory.clear()
                            new = memory[kind, value] = surrogate(key, kind, value)
                        rows.append((r, t, begin, end, kind, value, first, last, new))
                yield pd.DataFrame(rows, columns=["rid", "tid", "begin", "end", "kind", "value", "first", "last", "surrogate"])
    return detect


def told_apart(names: DataFrame, key: bytes) -> DataFrame:
    """``value, other``: the surrogates of names whose proposal another name has, or is the name itself.

    ``names`` are distinct ``value, surrogate``.  The first of equal proposals keeps it; the
    others get syllables for their number.  No rounds are needed, as marked syllables occur
    nowhere else.
    """
    order = Window.partitionBy(F.lower("surrogate")).orderBy("value")
    itself = (F.lower("surrogate") == F.lower(F.regexp_replace("value", "^[mf]:", ""))).cast("int")
    ranked = names.withColumn("rank", F.row_number().over(order) - 1 + F.max(itself).over(Window.partitionBy(F.lower("surrogate"))))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"value": batch["value"].to_numpy(),
                                "other": [surrogate(key, "name", v, int(r)) for v, r in zip(batch["value"], batch["rank"])]})

    return ranked.where("rank > 0").select("value", "rank").mapInPandas(again, "value string, other string")


def _rewrite(key: bytes):
    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in pieces(whole, ["text"])):
            rows = []
            for rid, text, spans in zip(batch["rid"], batch["text"], batch["spans"]):
                at, out, marks = 0, [], {}
                for s in sorted(spans if spans is not None else [], key=lambda s: s["begin"]):
                    own, new = text[s["begin"]: s["end"]], s["surrogate"]
                    if s["kind"] == "name":
                        new = initial(key, own) if new is None else new.upper() if own.isupper() else new
                    out += [text[at: s["begin"]], new]
                    at = s["end"]
                    marks[f"{s['kind']}:{s['first']}:{s['last']}"] = None
                new = "".join([*out, text[at:]])
                rows.append((rid, len(marks), ",".join(marks), sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), new))
            yield pd.DataFrame(rows, columns=["rid", "n_entities", "spans", "text_sha256", "text"])
    return rewrite


def replace_entities(docs: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_entities, spans, text_sha256, text`` for every row: texts with surrogates.

    Surrogates depend on the secret ``key`` and the entity only.  One entity has one surrogate in
    all documents (coreference), two entities have two (distinctness); of names this holds for
    each part.  A surrogate is never the entity itself; it may be the value of another one, as
    all values of a shape can occur.  Initials become other initials, particles stay.
    ``spans`` lists kind:start:end in code points of the input.  Null texts are empty;
    ids may be null or repeated; repeated rows are rewritten alike; an empty table gives no rows;
    other columns are ignored.
    """
    rows = id_and_text(docs, id_column, text_column).select(
        F.col("doc_id").isNull().alias("nil"), F.coalesce("doc_id", F.lit(0)).alias("rid"), F.xxhash64("text").alias("tid"), "text")
    found = materialize(rows.select(F.struct("nil", "rid").alias("rid"), "tid", "text").select(
        F.to_json("rid").alias("rid"), "tid", "text").mapInPandas(
        _detect(key), "rid string, tid bigint, begin int, end int, kind string, value string, first int, last int, surrogate string"))
    names = found.where("kind = 'name' AND surrogate IS NOT NULL").select("value", "surrogate").distinct()
    others = broadcast_if_small(materialize(told_apart(names, key)), 4)
    # A common entity is spread over as many tasks as it has texts.
    spans = (found.join(others, "value", "left").withColumn("surrogate", F.coalesce("other", "surrogate"))
             .groupBy("rid", "tid").agg(F.collect_set(F.struct("begin", "end", "kind", "surrogate", "first", "last")).alias("spans")))
    keyed = rows.select(F.to_json(F.struct("nil", "rid")).alias("rid"), "tid", "text")
    written = keyed.join(spans.hint("merge"), ["rid", "tid"], "left").select("rid", "text", "spans").mapInPandas(
        _rewrite(key), "rid string, n_entities bigint, spans string, text_sha256 string, text string")
    own = F.from_json("rid", "nil boolean, rid bigint")
    return written.select(F.when(~own["nil"], own["rid"]).alias("doc_id"), "n_entities", "spans", "text_sha256", "text")
