"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

A surrogate is a keyed permutation of its entity's letters and digits, each
within its own class (digit, hexadecimal digit, small or capital letter of its
script), by a Feistel network over the two halves. So distinct entities of one
format get distinct surrogates, and one entity gets the same surrogate in all
documents and in all its spellings (case and spacing of the spelling at hand
are kept).

A name after a title is two entities: the family name, which has one surrogate
whatever stands before it, and the given names within that family, drawn by key
from a list of the title's gender and the name's script. Later mentions of a
name that a document has introduced, with or without its given names, and of a
given name alone, get the same surrogates.

Lists and formats can still make two entities meet, and a surrogate may be
another document's real entity. So all distinct entities are checked: of those
that meet, all but the least, and all whose surrogate is real, are keyed anew
and checked against those that stand, until none is left. Formats may have fewer
values than entities, so surrogates grow after ``SAME_LENGTH`` attempts and a
free value always exists. Only these exceptions travel to the documents.
"""

from __future__ import annotations

import re
import secrets
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, ship, stage, unboxed

#: The setting that holds the secret key, in hexadecimal digits.
KEY_SETTING = "spark.loomtab.surrogateKey"
#: Exceptions up to this number are broadcast; more are joined to the texts that hold them.
BROADCAST_EXCEPTIONS = 10_000
#: Parts of the rows of one text in that join.
SALTS = 16
#: Attempts in an entity's own format; each later one adds GROWTH characters more.
SAME_LENGTH = 6
GROWTH = 3

# Titles by the gender that they tell.
TITLES = {
    "male": ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Господин"],
    "female": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Госпожа"],
    "any": ["Dr", "Prof", "Professor", "Doctor"],
}
# Given names by gender and script.
GIVEN = {
    ("male", "LATIN"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Simon", "Victor"],
    ("female", "LATIN"): ["Anna", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Ida", "Julia", "Laura", "Maria", "Nora", "Olga", "Sofia", "Vera"],
    ("male", "CYRILLIC"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Максим", "Олег", "Павел", "Роман"],
    ("female", "CYRILLIC"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Мария", "Нина", "Ольга", "Раиса", "Софья"],
}
for _script in ("LATIN", "CYRILLIC"):
    GIVEN["any", _script] = GIVEN["male", _script] + GIVEN["female", _script]
# Letters by script, vowels apart from consonants, so that surrogates can be spoken.
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
HEX = ["0123456789abcdef"]
KEY32 = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]

_title = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_small = "".join(c for c in map(chr, range(0x80, 0x2000)) if c.islower())
_letter = r"[^\W\d_]"
_name = rf"[^\W\d_a-z{_small}]{_letter}*(?:-{_letter}+|[’'](?!s(?!\w)){_letter}+)*"
_initial = rf"[^\W\d_a-z{_small}]\."
# Small words inside family names.
PARTICLES = "von van der den de del della di da dos du la le zu zum zur ter ten bin al".split()
_particles = "|".join(PARTICLES)
PATTERNS = [
    ("email", r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}"),
    ("secret", r"(?<!\w)(?:sk|pk|rk|ghp|gho|ghs|ghu|github_pat|glpat|xox[abprs]|hf|npm|AIza|ya29)[-_.]?(?=[A-Za-z_-]*\d)[A-Za-z0-9][A-Za-z0-9_-]{15,}(?!\w)"),
    ("access_key", r"(?<!\w)A[KS]IA[0-9A-Z]{16}(?!\w)"),
    ("token", r"(?<!\w)[0-9A-Fa-f]{32,64}(?!\w)"),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("ipv6", r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![\w:])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("card", r"(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w]|\.\d)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.,-])0\d{2,4}[ -]\d{3,4}[ -]?\d{3,4}(?![\w-]|[.,]\d)"),
    ("name", rf"(?<!\w)(?P<title>{_title})\.? (?P<given>(?:{_initial}[ -]?|(?!(?:{_title})(?!\w))(?:{_name}|{_particles}) )*)(?P<family>(?!(?:{_title})(?!\w)){_name})"),
]
FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
MAY_HOLD = re.compile(r"[0-9@]")
TITLE_WORDS = [t for ts in TITLES.values() for t in ts]


@lru_cache(4096)
def other_class(letter: str) -> str:
    """For a letter outside CLASSES those of its script and case near it (256 code points) that are outside, too."""
    kind, first = unicodedata.category(letter), ord(letter) & ~255
    near = (c for c in map(chr, range(first, first + 256)) if unicodedata.category(c) == kind and script(c) == script(letter))
    return "".join(c for c in near if len(c.upper()) == len(c.lower()) == 1 and not any(c in letters for letters in CLASSES))


def permuted(text: str, key: bytes, tweak: str, classes: list[str]) -> str:
    """text with each character of a class moved within it, a bijection for each format and tweak."""
    members = {c: k for k, letters in enumerate(classes) for c in letters}
    if classes is CLASSES:
        for c in text:
            if c not in members and c.isalpha() and c in other_class(c):
                members |= dict.fromkeys(other_class(c), len(classes))
                classes = [*classes, other_class(c)]
    places = [i for i, c in enumerate(text) if c in members]
    if not places:
        return text
    out = list(text)
    shape = "".join(chr(members[text[i]] + 48) if i in set(places) else c for i, c in enumerate(text))
    halves = places[: len(places) // 2], places[len(places) // 2 :]
    for turn in range(8):
        read, moved = halves[turn % 2], halves[1 - turn % 2]
        stream, block = b"", 0
        seed = f"{tweak}|{shape}|{turn}|{''.join(out[i] for i in read)}".encode()
        while len(stream) < 4 * len(moved):
            stream += blake2b(seed + block.to_bytes(4, "big"), key=key[:64], digest_size=64).digest()
            block += 1
        for k, i in enumerate(moved):
            letters = classes[members[out[i]]]
            out[i] = letters[(letters.index(out[i]) + int.from_bytes(stream[4 * k : 4 * k + 4], "big")) % len(letters)]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(digits)))
    return -total % 10


def script(text: str) -> str:
    return next((unicodedata.name(c, "LATIN").split()[0] for c in text if c.isalpha()), "LATIN")


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, type and canonical value of each entity, in order.

    A given name's type tells its gender, its value also the family; a name
    makes two entries, or one without given names.
    """
    if not MAY_HOLD.search(text) and not any(t in text for t in TITLE_WORDS):
        return []
    found, named = [], {}
    for m in FINDER.finditer(text):
        kind, start, end = m.lastgroup, m.start(), m.end()
        kind = next(k for k, _ in PATTERNS if m[k] is not None)
        value = m[kind]
        if kind == "name":
            gender = next(g for g, ts in TITLES.items() if m["title"] in ts)
            given, family = (m["given"] or "").rstrip(), m["family"]
            named.setdefault(family, {})
            if given:
                named[family].setdefault(given, f"name {gender}")
                found.append((m.start("given"), m.start("given") + len(given), named[family][given], f"{given}\n{family}"))
            found.append((m.start("family"), m.end("family"), "family", family))
            continue
        if kind in ("card", "phone", "iban"):
            value = re.sub(r"[^0-9A-Za-z+]", "", value)
        elif kind in ("email", "token", "ipv6"):
            value = value.lower()
        found.append((start, end, kind, value))
    # A single cased letter may be any word; other families and given names are looked for in the whole text.
    families = [f for f in named if len(f) > 1 or f.lower() == f.upper()]
    alone = {g: (kind, f) for f in reversed(named) for g, kind in named[f].items() if len(g) > 2 and g.isalpha() and g not in PARTICLES}
    for m, free in mentions(text, families, found):
        family = m[0]
        for given, kind in named[family].items():
            first = m.start() - len(given) - 1
            if first >= free and text[first : m.start()] in (given + " ", given + "\n") and not (first and text[first - 1].isalnum()):
                found.append((first, first + len(given), kind, f"{given}\n{family}"))
        found.append((m.start(), m.end(), "family", family))
    found.sort()
    for m, _ in mentions(text, [g for g in alone if g not in named], found):
        kind, family = alone[m[0]]
        found.append((m.start(), m.end(), kind, f"{m[0]}\n{family}"))
    return sorted(found)


def mentions(text: str, words: list[str], found: list[tuple]):
    """Whole words of text outside of the entities found so far, each with the end of the entity before it."""
    if not words:
        return
    taken = [(e[0], e[1]) for e in found]
    starts = [t[0] for t in taken]
    for m in re.finditer(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + r")(?!\w)", text):
        at = bisect_right(starts, m.start())
        if not (at and taken[at - 1][1] > m.start()) and not (at < len(taken) and taken[at][0] < m.end()):
            yield m, taken[at - 1][1] if at else 0


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value, longer than it after SAME_LENGTH attempts."""
    made = formatted(kind, value, key, attempt)
    more = GROWTH * (attempt - SAME_LENGTH + 1)
    if more <= 0:
        return made
    letters = {"token": HEX[0], "ipv6": HEX[0], "access_key": KEY32[0], "email": CLASSES[2]}.get(kind, CLASSES[0])
    family = ""
    if kind == "family" or kind.startswith("name "):
        made, _, family = made.partition("\n")
        last = (made.rstrip(".") or "x")[-1].lower()[0]
        letters = next((c for c in [*CLASSES, other_class(last)] if last in c and len(c) > 1), CLASSES[2])
    stream, block = b"", 0
    while len(stream) < 4 * more:
        stream += blake2b(f"{kind}|{attempt}|{value}|more|{block}".encode(), key=key[:64], digest_size=64).digest()
        block += 1
    end = "".join(letters[int.from_bytes(stream[4 * k : 4 * k + 4], "big") % len(letters)] for k in range(more))
    local, at, domain = made.rpartition("@") if kind == "email" else (made, "", "")
    return local + end + at + domain + ("\n" + family if family else "")


def formatted(kind: str, value: str, key: bytes, attempt: int) -> str:
    """The surrogate in the format of its value."""
    tweak = f"{kind}|{attempt}"
    if kind == "email":
        local, _, domain = value.rpartition("@")
        site, _, top = domain.rpartition(".")
        if not re.search(r"(?:^|\.)(?:example|test|invalid)$", site):
            site = permuted(site, key, tweak + "|site", CLASSES)
        return permuted(f"{local}", key, f"{tweak}|{domain}", CLASSES) + f"@{site}.{top}"
    if kind == "ip":
        number = 0
        for part in value.split("."):
            number = number * 256 + int(part)
        left, right = divmod(number, 65536)
        for turn in range(8):
            own = blake2b(f"{tweak}|{turn}|{right}".encode(), key=key[:64], digest_size=4).digest()
            left, right = right, (left + int.from_bytes(own, "big")) % 65536
        number = left * 65536 + right
        return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        if luhn(value[:-1]) == int(value[-1]):
            body = value[0] + permuted(value[1:-1], key, tweak + value[0], CLASSES)
            return body + str(luhn(body))
        return value[0] + permuted(value[1:], key, tweak + value[0], CLASSES)
    if kind == "ipv6":
        return permuted(value, key, tweak, HEX)
    if kind == "secret":
        head = re.match(r"(?:github_pat|xox[abprs]|AIza|ya29|[a-z]+)[-_.]?", value).end()
        return value[:head] + permuted(value[head:], key, tweak + value[:head], CLASSES)
    if kind == "phone" and value.startswith("0"):
        return "0" + permuted(value[1:], key, tweak + "0", CLASSES)
    if kind == "phone" and value.startswith("+"):
        head = 2 if value[1] in "17" else 3
        return value[:head] + permuted(value[head:], key, tweak + value[:head], CLASSES)
    if kind == "access_key":
        return value[:4] + permuted(value[4:], key, tweak, KEY32)
    if kind == "token":
        return permuted(value, key, tweak, HEX)
    if kind == "iban":
        return value[:2] + permuted(value[2:], key, tweak + value[:2], CLASSES)
    if kind.startswith("name "):
        given, family = value.split("\n")
        names = GIVEN.get((kind[5:], script(given)))
        # The first name comes from the list; initials and other names move within their letters, small words stay.
        words = re.split(r"([ .]+)", given)
        for k in range(0, len(words), 2):
            if k == 0 and names and len(words[0]) > 1 and words[0] not in PARTICLES:
                own = blake2b(f"{tweak}|{value}".encode(), key=key[:64], digest_size=8).digest()
                words[0] = names[int.from_bytes(own, "big") % len(names)]
            elif words[k] not in PARTICLES:
                words[k] = permuted(words[k], key, f"{tweak}|{family}|given{k or ''}", CLASSES)
        return "".join(words) + "\n" + family
    return permuted(value, key, tweak, CLASSES)


def dressed(found: str, kind: str, value: str) -> str:
    """The surrogate value in the spelling of the text found: its separators, or its case."""
    value = value.partition("\n")[0]
    if kind in ("card", "phone", "iban"):
        signs = iter(value)
        return "".join(next(signs, "") if re.match(r"[0-9A-Za-z+]", c) else c for c in found) + "".join(signs)
    if kind == "token" and found.upper() == found:
        return value.upper()
    if kind in ("email", "token", "ipv6") and len(found) == len(value):
        return "".join(v.upper() if c.isupper() else v for c, v in zip(found, value, strict=True))
    return value


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, int]:
    out, at, n = [], 0, 0
    for start, end, kind, value in entities(text):
        out += [text[at:start], dressed(text[start:end], kind, surrogate(kind, value, key, attempts.get((kind, value), 0)))]
        at, n = end, n + (not kind.startswith("name "))  # its family name follows
    return ("".join(out) + text[at:], n) if n else (text, 0)


def distinct_entities(docs: DataFrame) -> DataFrame:
    """kind and value of each entity in docs, once."""

    def run(batches):
        from loomtab.llm import pii

        for batch in batches:
            found = sorted({e[2:] for t in batch.column("text").to_pylist() if t for e in pii.entities(t)})
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["kind", "value"])

    return docs.select("text").mapInArrow(run, "kind string, value string").distinct()


def exceptions(spark: SparkSession, known: DataFrame, key: bytes) -> DataFrame:
    """kind, value and attempt (1 and up) of the entities whose first surrogate would meet another or a real one.

    Each round makes surrogates only for what met in the round before, and
    checks them against all that stand by then.
    """

    def run(batches):
        from loomtab.llm import pii

        for batch in batches:
            kinds, values, attempts = (batch.column(c).to_pylist() for c in ("kind", "value", "attempt"))
            made = [pii.surrogate(k, v, key, a) for k, v, a in zip(kinds, values, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["kind", "value", "attempt", "made"])

    real = known.select(F.col("value").alias("made")).distinct().withColumn("real", F.lit(True))
    standing: DataFrame | None = None
    current, attempt = known.withColumn("attempt", F.lit(0)), 0
    while True:
        made = stage(spark, current.mapInArrow(run, "kind string, value string, attempt int, made string"), "surrogates")
        # A surrogate belongs to the least value that has it, unless it is real or was given before.
        owners = made.groupBy("made").agg(F.min(F.struct("kind", "value")).alias("owner"))
        taken = real if standing is None else real.union(standing.select("made", F.lit(True))).distinct()
        judged = made.join(owners, "made").join(taken, "made", "left")
        meets = (F.struct("kind", "value") != F.col("owner")) | F.col("real").isNotNull()
        judged = stage(spark, judged.select("kind", "value", "attempt", "made", meets.alias("meets")), "judged")
        stand = judged.filter("not meets").select("kind", "value", "attempt", "made")
        standing = stand if standing is None else standing.union(stand)
        if judged.filter("meets").isEmpty():
            return standing.filter("attempt > 0").select("kind", "value", "attempt")
        attempt += 1
        current = judged.filter("meets").select("kind", "value", F.lit(attempt).alias("attempt"))


def key_of(spark: SparkSession, key: bytes | None) -> bytes:
    """The key given, or that of the session's KEY_SETTING; there is no other, as surrogates of a known key can be undone."""
    found = key or bytes.fromhex(spark.conf.get(KEY_SETTING, "") or "")
    if len(found) < 8:
        raise ValueError(f"give a secret key of 8 bytes or more, or set {KEY_SETTING}")
    return found


def session_key(spark: SparkSession) -> bytes | None:
    """None where the session names a key; else a secret one of this session, drawn once and known to no one after it.

    Surrogates then agree within a run, and no one can undo them, but another run makes others.
    """
    if spark.conf.get(KEY_SETTING, None):
        return None
    sc = spark.sparkContext
    if not hasattr(sc, "_loomtab_key"):
        sc._loomtab_key = secrets.token_bytes(32)
    return sc._loomtab_key


def replace_table(spark: SparkSession, docs: DataFrame, key: bytes | None = None, count: str | None = None) -> DataFrame:
    """docs, all columns as they are, with entities in text replaced; with count, their number in a last column of that name.

    A null text stays null and an empty one empty, with no entities. Equal rows
    get equal results, a null doc_id is of no account, and columns of any other
    name are handed on; an empty table gives an empty one. Texts of any length
    are searched whole.
    """
    ship(spark)
    key = key_of(spark, key)
    rare = stage(spark, exceptions(spark, stage(spark, distinct_entities(docs), "entities"), key), "exceptions")
    few = rare.limit(BROADCAST_EXCEPTIONS + 1).collect()
    source = docs.select("text", boxed(docs).alias("row"))
    attempts: dict[tuple[str, str], int] = {}
    if len(few) <= BROADCAST_EXCEPTIONS:
        attempts = {(r["kind"], r["value"]): r["attempt"] for r in few}
        source = source.withColumn("attempts", F.lit(None).cast("map<string,int>"))
    else:
        # Each text that holds exceptions is joined with its own ones, by its digest; salted, as many rows may share a text.
        def run_spans(batches):
            from loomtab.llm import pii

            for batch in batches:
                rows = sorted({(d, *e[2:]) for d, t in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for e in pii.entities(t)})
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1, 2)], names=["digest", "kind", "value"])

        spans = docs.select(F.sha2("text", 256).alias("digest"), "text").mapInArrow(run_spans, "digest string, kind string, value string").distinct()
        named = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\n\n", "kind", "value"), "attempt")))
        own = spans.join(rare, ["kind", "value"]).groupBy("digest").agg(named.alias("attempts")).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        source = source.withColumns({"digest": F.sha2("text", 256), "salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")})
        source = source.join(own, ["digest", "salt"], "left").select("text", "row", "attempts")

    def run(batches):
        from loomtab.llm import pii

        for batch in batches:
            texts, counts = [], []
            own = batch.column("attempts").to_pylist()
            for text, more in zip(batch.column("text").to_pylist(), own, strict=True):
                known = attempts | {tuple(k.split("\n\n", 1)): v for k, v in more} if more else attempts
                new, n = pii.replaced(text, key, known) if text else (text, 0)
                texts.append(new)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("row"), pa.array(counts, pa.int64())], names=["text", "row", "n"])

    out = T.StructType([T.StructField("text", T.StringType()), source.schema["row"], T.StructField("n", T.LongType())])
    done = source.mapInArrow(run, out)
    return done.select(*unboxed(docs, "row", F.col("text")), *([F.col("n").alias(count)] if count else []))
