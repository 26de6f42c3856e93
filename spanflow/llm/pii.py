"""Surrogates for personal data and secrets.

Entities are detected in whole texts and replaced by keyed surrogates of the
same type: as many digits and letters in the same places, the same case, script
and gender, a card number that passes or fails its check digit like the
original, an address of the same network class, a mail address of one surrogate
domain for each original domain.

An entity is known by its canonical form (a phone number by its digits, a mail
address in lower case, a name by each of its parts), and gets the same surrogate
everywhere.  A collision check over all entities of the input keeps surrogates
distinct, and distinct from every entity that really occurs: those that collide
draw again, round after round, until none does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanflow.llm.words import text_key

GIVEN = {
    ("m", "latin"): "Adrian Bastian Carlo Dario Edgar Fabian Gregor Henrik Ivo Jonas Karel Lukas Marek Nils Oskar "
                    "Paulo Quentin Rafael Stefan Tobias Ulrich Victor Walter Xavier Yannick Zoltan",
    ("f", "latin"): "Alba Bianca Carla Daria Elena Flora Greta Helena Irene Julia Katja Lena Marta Nora Olivia "
                    "Petra Quinta Rosa Silvia Tamara Ursula Vera Wanda Xenia Yvonne Zora",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Игорь Кирилл Леонид Максим Николай Олег Павел Роман Степан",
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Марина Нина Ольга Раиса София",
    ("m", "greek"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Θάνος Κώστας Λευτέρης Μάριος Νίκος Πέτρος Σταύρος",
    ("f", "greek"): "Άννα Βάσω Γεωργία Δέσποινα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Ρένα Σοφία",
}
GIVEN = {k: v.split() for k, v in GIVEN.items()}
#: Given names that tell a gender without a title, besides those above.
KNOWN = {
    "m": "James John Robert Michael William David Richard Thomas Charles Daniel Peter Paul Hans Klaus Jürgen Pierre "
         "Jean Luc Michel José Juan Carlos Miguel Иван Сергей Дмитрий Алексей Γιάννης",
    "f": "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Anna Maria Ingrid Sabine Monika Marie Sophie "
         "Claire Camille Carmen Lucía Ana Isabel Наталья Татьяна Екатерина Светлана Ευαγγελία",
}
KNOWN = {n.casefold(): g for g, names in KNOWN.items() for n in names.split()} | {
    n.casefold(): g for (g, _), names in GIVEN.items() for n in names}
TITLES = {"m": ("Mr", "Herr", "Señor", "Monsieur", "господин", "г-н", "Κύριος"),
          "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "госпожа", "г-жа", "Κυρία"),
          "": ("Dr", "Prof")}
TITLES = {t: g for g, names in TITLES.items() for t in names}
SYLLABLES = {"latin": "ba be bor cal dan den fer gar hol jan kel lan lor mar mol nes nor pal per ras ros san sel tal "
                      "tor val ven wil zan zor",
             "cyrillic": "ба бел вар гор дан ден зор кам кол лан лов мар мир нов пал пет ров сал сем тал тор фед чер",
             "greek": "βα γαλ δαν ζαφ θεο καλ κορ λαμ μαν νικ παπ ραλ σαβ ταξ φωτ χαρ"}
SYLLABLES = {k: v.split() for k, v in SYLLABLES.items()}

_NAME = r"[^\W\d_][^\W\d_'’-]+(?:['’-][^\W\d_]+)*"
PATTERNS = {
    "email": re.compile(r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}"),
    "aws": re.compile(r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key)\s*[=:]\s*[\"']?([^\s\"']{6,})"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)"
                        r"|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)"
                        r"|(?<![\w.])\d{3}[.-]\d{3}[.-]\d{4}(?!\w)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "card": re.compile(r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7})(?![0-9A-Za-z])"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"),
    "name": re.compile(rf"(?<!\w)({'|'.join(map(re.escape, TITLES))})(\.? +)({_NAME}(?: {_NAME})?)"),
}
_DIGITS = re.compile(r"[0-9][0-9.]")


def luhn(digits: str) -> int:
    """Sum of the check-digit scheme, modulo 10; 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text, in order and without overlaps."""
    found = []

    def scan(kind):
        for m in PATTERNS[kind].finditer(text):
            found.append((m.start(), m.end(), kind, m.group()))

    if "@" in text:
        scan("email")
    if "=" in text or ":" in text:
        for m in PATTERNS["secret"].finditer(text):
            if any(c.isalpha() or c.isascii() and c.isdigit() for c in m.group(1)):  # a mask of other characters hides nothing
                found.append((m.start(1), m.end(1), "secret", m.group(1)))
    if "AKIA" in text or "ASIA" in text:
        scan("aws")
    if _DIGITS.search(text):
        for kind in ("phone", "card", "ip"):
            scan(kind)
        if "-" in text:
            scan("ssn")
        for m in PATTERNS["iban"].finditer(text):
            s = m.group().replace(" ", "")
            if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
                found.append((m.start(), m.end(), "iban", m.group()))
    for m in PATTERNS["name"].finditer(text) if any(t in text for t in TITLES) else ():
        parts = m.group(3).split(" ")
        if not all(p[:1].isupper() for p in parts):
            parts = parts[:1] if parts[0][:1].isupper() else []
        gender = TITLES[m.group(1)] or next((KNOWN[p.casefold()] for p in parts if p.casefold() in KNOWN), "")
        at = m.start(3)
        for i, p in enumerate(parts):
            first = i == 0 and (len(parts) > 1 or p.casefold() in KNOWN)
            kind = f"given:{gender or 'm'}:{script(p)}" if first else f"family:{script(p)}"
            found.append((at, at + len(p), kind, p))
            at += len(p) + 1
    out, end = [], 0
    for a, b, kind, s in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= end:
            out.append((a, b, kind, canonical(kind, s)))
            end = b
    return out


def script(word: str) -> str:
    c = word[:1].casefold()
    return "cyrillic" if "Ѐ" <= c <= "ԯ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin"


def canonical(kind: str, text: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"[^\d+]", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind in ("aws", "secret", "ip"):
        return text
    return text.casefold()


class Source:
    """Keyed pseudo-random choices for one entity and attempt."""

    def __init__(self, key: bytes, *what):
        self.key, self.what = key, "\x1f".join(map(str, what)).encode()
        self.pool, self.round = b"", 0

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.blake2b(self.what + self.round.to_bytes(4, "big"), key=self.key).digest()
            self.round += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def like(self, text: str, letters: str | None = None) -> str:
        """A digit for every digit and a lower-case letter for every letter; other characters stay."""
        return "".join(str(self.below(10)) if c.isdigit() and c.isascii() else
                       (letters or "abcdefghijklmnopqrstuvwxyz")[self.below(len(letters or "a" * 26))]
                       if c.isalpha() else c for c in text)


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The canonical surrogate of a canonical entity; another one for each attempt.

    A format may have no free surrogate left, so every eighth attempt adds a character or widens an address.
    """
    src = Source(key, kind, entity, attempt)
    wide = attempt // 8
    more = "0" * wide
    if kind == "email":
        local, domain = entity.split("@")
        body, top = domain.rsplit(".", 1)
        return src.like(local + "a" * wide) + "@" + Source(key, "domain", domain, attempt // 8).like(body) + "." + top
    if kind == "phone":
        if entity.startswith("+"):
            code = max(1, len(entity) - 11)
            return entity[:1 + code] + str(2 + src.below(8)) + src.like(entity[2 + code:] + more)
        return str(2 + src.below(8)) + src.like(entity[1:] + more)
    if kind == "card":
        body = entity[0] + src.like(entity[1:-1] + more)
        valid = luhn(entity) == 0
        check = next(str(d) for d in range(10) if luhn(body + str(d)) == 0)
        return body + (check if valid else str((int(check) + 1 + src.below(9)) % 10))
    if kind == "ip":
        octets = [int(o) for o in entity.split(".")]
        keep = 1 if octets[0] in (10, 127) else 2 if octets[:2] in ([192, 168],) or (
            octets[0] == 172 and 16 <= octets[1] < 32) else 0
        if wide:  # any octets of the same block; then of the largest private block, then of the public ones
            if wide > 2 or not keep:
                return ".".join(str(o) for o in (11 + src.below(116), src.below(256), src.below(256), src.below(256)))
            kept = octets[:keep] if wide == 1 else [10]
            return ".".join(str(o) for o in kept + [src.below(256) for _ in range(4 - len(kept))])
        low, high = {1: (0, 9), 2: (10, 99), 3: (100, 254)}, entity.split(".")
        out = [str(o) if i < keep else str(max(1 if i == 0 else 0, low[len(high[i])][0]) + src.below(
            low[len(high[i])][1] - low[len(high[i])][0] + (0 if i == 0 and len(high[i]) == 1 else 1)))
            for i, o in enumerate(octets)]
        return ".".join(out)
    if kind == "aws":
        return entity[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[src.below(32)] for _ in entity[4:])
    if kind == "iban":
        body = "".join(str(src.below(10)) if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[src.below(26)] for c in entity[4:] + more)
        check = 98 - int("".join(str(int(c, 36)) for c in body + entity[:2]) + "00") % 97
        return f"{entity[:2]}{check:02d}{body}"
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+", entity):
            return "".join("0123456789abcdef"[src.below(16)] for _ in entity + more)
        new = src.like(entity + "a" * wide)
        return "".join(n.upper() if o.isupper() else n for o, n in zip(entity, new)) + new[len(entity):]
    if kind.startswith("given:"):
        _, gender, letters = kind.split(":")
        names = GIVEN[gender, letters]
        if attempt < 4:
            return names[src.below(len(names))].casefold()
        return names[src.below(len(names))].casefold() + "-" + names[src.below(len(names))].casefold() + (
            "".join(SYLLABLES[letters][src.below(len(SYLLABLES[letters]))] for _ in range(attempt // 8)))
    if kind.startswith("family:"):
        parts = SYLLABLES[kind[7:]]
        return "".join(parts[src.below(len(parts))] for _ in range(2 + (len(entity) > 6) + attempt // 4))
    return src.like(entity + more)


def laid_out(kind: str, original: str, new: str) -> str:
    """The canonical surrogate ``new`` in the format of the text it replaces."""
    if kind in ("phone", "card", "ssn", "iban"):
        chars = iter(new)
        return "".join(c if c in " ().-" else next(chars) for c in original) + "".join(chars)
    if kind.startswith(("given:", "family:")):
        if len(original) > 1 and original.isupper():
            return new.upper()
        return "-".join(p[:1].upper() + p[1:] for p in new.split("-")) if original[:1].isupper() else new
    if kind == "email":
        if len(original) != len(new):
            return new
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, new))
    return new


def _unresolved(entities: DataFrame, key: bytes, stage) -> DataFrame:
    """(kind, entity, attempt) of the entities whose first surrogate collided, with the attempt that does not."""
    def propose(attempt):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind, entity = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1),
                     pa.array([surrogate(key, k, e, attempt) for k, e in zip(kind, entity)], pa.string())],
                    names=["kind", "entity", "surrogate"])
        return run

    # a given name and a family name of one script must differ too, so names share one space
    space = F.when(F.col("kind").startswith("given:") | F.col("kind").startswith("family:"), "name").otherwise(F.col("kind"))
    real = entities.select(space.alias("space"), F.col("entity").alias("surrogate")).distinct()
    todo, attempt, taken, late = entities, 0, None, None
    while True:
        drawn = stage(todo.mapInArrow(propose(attempt), "kind string, entity string, surrogate string")
                      .withColumn("space", space))
        winner = drawn.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "entity")).alias("w"))
        free = winner.join(real, ["space", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken, ["space", "surrogate"], "left_anti")
        free = stage(free.select("space", "surrogate", "w.kind", "w.entity"))
        if attempt:
            got = free.select("kind", "entity", F.lit(attempt).alias("attempt"))
            late = got if late is None else late.unionByName(got)
        now = free.select("space", "surrogate")
        taken = now if taken is None else taken.unionByName(now)
        todo = stage(drawn.select("kind", "entity").join(free.select("kind", "entity"), ["kind", "entity"], "left_anti"))
        if todo.isEmpty():
            return late
        attempt += 1


def replace_entities(docs: DataFrame, key: bytes, stage: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """``docs`` with every detected entity of ``text`` replaced, and n_replaced (a column of this name is replaced).

    A null text stays null with n_replaced 0; a text without entities is
    unchanged to the byte.  Equal rows are changed alike.  ``stage`` writes a
    frame to shared storage and returns what it wrote.
    """
    out = [c for c in docs.columns if c not in (text, "n_replaced")]
    # the caller's columns by number, so that no name of theirs meets one used here
    mine = [f"c{i}" for i in range(len(out))]
    keyed = docs.select(*[F.col(f"`{c}`").alias(m) for c, m in zip(out, mine)], F.col(text).cast("string").alias("text"),
                        *[k.alias(f"text_{n}") for n, k in zip(("k1", "k2"), text_key(F.col(text)))])

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for k1, k2, t in zip(*(c.to_pylist() for c in batch.columns)):
                if t:
                    rows.update((k1, k2, kind, entity) for _, _, kind, entity in find(t))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*sorted(rows)), (pa.int64(), pa.int32(), pa.string(), pa.string()))],
                    names=["k1", "k2", "kind", "entity"])

    seen = stage(keyed.select("text_k1", "text_k2", "text").mapInArrow(
        occurrences, "k1 long, k2 int, kind string, entity string"))
    late = _unresolved(seen.select("kind", "entity").distinct(), key, stage)
    if late is None:
        source = keyed.withColumn("late", F.lit(None).cast("map<string,int>"))
    else:
        later = (seen.join(late, ["kind", "entity"]).select("k1", "k2", F.concat_ws("\x1f", "kind", "entity").alias("e"), "attempt")
                 .distinct().groupBy("k1", "k2")
                 .agg(F.map_from_entries(F.collect_list(F.struct("e", "attempt"))).alias("late")))
        source = keyed.join(stage(later), (F.col("text_k1") == F.col("k1")) & (F.col("text_k2") == F.col("k2")), "left")
    source = source.select(*mine, "text", "late")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts, counts = [], []
                for t, late in zip(part.column(len(out)).to_pylist(), part.column(len(out) + 1).to_pylist()):
                    new, n = rewrite(t, key, dict(late or ()))
                    texts.append(new)
                    counts.append(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(out))] + [pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                    names=[*out, text, "n_replaced"])

    schema = "".join(f"`{c}` {f.dataType.simpleString()}, " for c, f in zip(out, source.schema.fields))
    return source.mapInArrow(run, schema + f"`{text}` string, n_replaced long")


def rewrite(text: str | None, key: bytes, late: dict[str, int]) -> tuple[str | None, int]:
    """A text with its entities replaced, and how many were; ``late`` has the attempts above the first."""
    if not text:
        return text, 0
    parts, at, n = [], 0, 0
    for a, b, kind, entity in find(text):
        new = surrogate(key, kind, entity, late.get(f"{kind}\x1f{entity}", 0))
        parts += [text[at:a], laid_out(kind, text[a:b], new)]
        at, n = b, n + 1
    return "".join(parts) + text[at:], n
