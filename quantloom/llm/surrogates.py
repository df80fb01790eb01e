"""PII surrogates: detected entities are replaced by keyed, type-consistent stand-ins.

A stand-in is a function of a secret key, the entity's type and its canonical
form, so the same entity gets the same stand-in in every document, and it keeps
the format: digits stay digits, letters keep case and script, cards keep a
valid check digit, addresses stay valid, names keep gender and script. Spark
gathers the distinct entities of the corpus and checks that no two of a type
share a stand-in and that none is itself an entity of the corpus; entities that
collide draw again until all are distinct."""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .storage import staged

# Titles by gender, and pools of given names and surnames by script.
TITLES = {"m": "Mr Herr Señor Sr Monsieur Don Г-н κ", "f": "Mrs Ms Miss Frau Señora Sra Srta Madame Mme Mlle Doña Г-жа κα", "n": "Dr Prof Mx"}
GIVEN = {
    ("Latin", "m"): "James Robert John Michael David William Thomas Daniel Martin Peter Paul Andrew Lukas Felix Jonas Pierre Louis Hugo Carlos Javier Pablo Diego Oscar Simon",
    ("Latin", "f"): "Mary Patricia Linda Susan Sarah Karen Nancy Laura Emma Anna Julia Clara Lena Sophie Marie Camille Lucia Elena Carmen Paula Alice Nora Irene Ruth",
    ("Latin", "n"): "Alex Robin Sam Jordan Taylor Casey Jamie Morgan Riley Quinn Avery Rowan",
    ("Cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Николай Андрей Михаил Олег Юрий",
    ("Cyrillic", "f"): "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана Вера Юлия",
    ("Cyrillic", "n"): "Саша Женя Валя Слава",
    ("Greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Πέτρος",
    ("Greek", "f"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Ειρήνη",
    ("Greek", "n"): "Άλεξ Χάρις",
}
SURNAMES = {
    "Latin": "Adams Baker Carter Dawson Ellis Fischer Garcia Hughes Ingram Jensen Keller Lambert Morales Nolan Ortega Perrin Quincy Ramos Schmid Turner Ulrich Vidal Weber Young Zimmer Bennett Coleman Dubois Fuentes Hartmann",
    "Cyrillic": "Иваненко Петренко Коваленко Шевченко Бондаренко Ткаченко Кравченко Олейник Лысенко Савченко",
    "Greek": "Παπαδάκης Γεωργίου Δημητρίου Νικολάου Ιωάννου Βασιλείου Αντωνίου Πέτρου",
}
_TITLE = {t: g for g, ts in TITLES.items() for t in ts.split()}
_GENDER = {n: g for (_, g), names in GIVEN.items() for n in names.split()}
_WORD = r"[^\W\d_a-z](?:['’]?[^\W\d_])+"
_NAME = r"\b(?P<title>" + "|".join(sorted(map(re.escape, _TITLE), key=len, reverse=True)) + rf")\.?[ ]+(?P<person>{_WORD}(?:[ -]{_WORD}){{0,2}})"
_FULL_NAME = rf"\b(?P<full>(?:{'|'.join(sorted(_GENDER, key=len, reverse=True))}) {_WORD})"
_KINDS = {
    "EMAIL": r"(?<![\w.+-])[A-Za-z0-9_+-][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "IP": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "IBAN": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "ACCESS_KEY": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "TOKEN": r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})",
    "SECRET": r"(?i:(?<=password)|(?<=passwd)|(?<=pwd)|(?<=secret)|(?<=api_key)|(?<=apikey)|(?<=token))[ ]?[=:][ ]?[\"']?[^\s\"',;]{4,}",
    "HEX": r"\b(?=[0-9a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,64}\b",
    "CARD": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|-\d)",
    "SSN": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "PHONE": r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w]|-\d)|(?<![\w.+-])\+\d{8,15}(?!\w)",
    "NAME": _NAME,
    "FULL_NAME": _FULL_NAME,
}
_ALL = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS.items()))
#: what a match cannot do without: texts without any of these are not searched
_HINT = re.compile(rf"[0-9@]|[=:][ ]?\S{{4}}|\b(?:{'|'.join(map(re.escape, [*_TITLE, *_GENDER]))})\b|eyJ|xox|sk-|gh[pousr]_")


class Part(NamedTuple):
    """A place in a text whose stand-in depends on one entity: (kind, canonical form)."""

    start: int
    end: int
    kind: str
    canonical: str


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def script_of(text: str) -> str:
    for c in text:
        if c.isalpha():
            name = unicodedata.name(c, "").split(" ")[0].capitalize()
            return name if name in SURNAMES else "Latin"
    return "Latin"


def _name_parts(words: list[re.Match], gender: str, at: int) -> Iterator[Part]:
    """A part for each given name and one for the surname; a listed given name tells its gender better than a title without any."""
    if gender == "n" and len(words) > 1:
        gender = _GENDER.get(words[0][0], "n")
    for i, w in enumerate(words):
        sort = "SURNAME" if i == len(words) - 1 else f"GIVEN:{gender}"
        name = re.sub(r"['’][sS]$", "", w[0])  # Smith's is Smith
        yield Part(at + w.start(), at + w.start() + len(name), f"{sort}:{script_of(name)}", name.casefold())


def detect(text: str) -> list[Part]:
    """Entities of a text in order.

    Persons are found after a title, or by a listed given name before another
    name; every further mention of a name part found so, as a whole word that
    is written so, with a capital or in capitals, is the same entity."""
    out: list[Part] = []
    if not _HINT.search(text):
        return out
    for m in _ALL.finditer(text):
        kind, found = m.lastgroup, m[0]
        if m["person"] or m["full"]:
            words = list(re.finditer(r"[^ ]+", m["person"] or m["full"]))
            out += _name_parts(words, _TITLE[m["title"]] if m["person"] else "n", m.start("person" if m["person"] else "full"))
        elif kind == "CARD":
            digits = re.sub(r"\D", "", found)
            if not luhn(digits):
                continue
            out.append(Part(m.start(), m.end(), kind, digits))
        elif kind == "SECRET":
            value = re.sub(r"^[ ]?[=:][ ]?[\"']?", "", found)
            out.append(Part(m.end() - len(value), m.end(), kind, value))
        elif kind == "PHONE":
            out.append(Part(m.start(), m.end(), kind, ("+" if "+" in found else "") + re.sub(r"\D", "", found)))
        elif kind == "EMAIL":
            out.append(Part(m.start(), m.end(), kind, found.lower()))
        else:
            out.append(Part(m.start(), m.end(), kind, found.replace(" ", "") if kind == "IBAN" else found))
    spelled = {text[p.start : p.end] for p in out if p.kind.startswith(("SURNAME", "GIVEN"))}
    named = {p.canonical: p for p in reversed(out) if p.kind.startswith(("SURNAME", "GIVEN"))}
    if named:
        taken = {p.start: p.end for p in out}
        starts = sorted(taken)
        for m in re.finditer(rf"\b(?:{'|'.join(sorted(map(re.escape, spelled), key=len, reverse=True))})\b", text, re.IGNORECASE):
            if m[0].casefold() not in named or not (m[0] in spelled or m[0][0].isupper()):
                continue
            i = bisect.bisect_right(starts, m.start())
            if not i or taken[starts[i - 1]] <= m.start():
                out.append(Part(m.start(), m.end(), *named[m[0].casefold()][2:]))
        out.sort()
    return out


class _Stream:
    """Keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: bytes, *seed: object):
        self.key, self.seed, self.at, self.pool = key, "\0".join(map(str, seed)).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + self.at.to_bytes(4, "big"), hashlib.sha256).digest()
            self.at += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n


#: code points of the lower-case letters of scripts other than Latin, as first and end
_ALPHABETS = [(0x3B1, 0x3C2), (0x430, 0x450), (0x5D0, 0x5EB), (0x627, 0x63B), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4)]


def _alike(text: str, draw: _Stream, hexadecimal: bool = False) -> str:
    out = []
    for c in text:
        if hexadecimal and c in "0123456789abcdef":
            out.append("0123456789abcdef"[draw.below(16)])
        elif c.isascii() and c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isascii() and c.isalpha():
            x = chr(97 + draw.below(26))
            out.append(x.upper() if c.isupper() else x)
        elif c.isalpha():
            first, n = next(((a, b - a) for a, b in _ALPHABETS if a <= ord(c.lower()) < b), (97, 26))
            x = chr(first + draw.below(n))
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def iban(country: str, rest: str) -> str:
    """An IBAN whose two check digits fit its country and account."""
    value = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{country}{98 - value % 97:02d}{rest}"


def surrogate(kind: str, canonical: str, key: bytes, attempt: int = 0) -> str:
    """The stand-in of an entity in canonical form; always another string than the entity."""
    draw = _Stream(key, kind, canonical, attempt)
    sort, _, rest = kind.partition(":")
    for _ in range(64):
        if sort == "EMAIL":
            local, _, domain = canonical.partition("@")
            *hosts, top = domain.split(".")
            site = _Stream(key, "DOMAIN", domain)  # addresses of one domain stay together
            new = _alike(local, draw) + "@" + ".".join([*(h if h in ("mail", "www", "example") else _alike(h, site) for h in hosts), top])
        elif sort == "IP":
            new = ".".join(str(1 + draw.below(254)) for _ in range(4))
        elif sort == "CARD":
            body = canonical[0] + _alike(canonical[1:-1], draw)
            new = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        elif sort == "PHONE":
            n = canonical.startswith("+")
            keep = 1 + n if canonical.startswith("+1") else 3 * n
            new = canonical[:keep] + "".join(str(draw.below(10)) for _ in canonical[keep:])
        elif sort == "ACCESS_KEY":
            new = canonical[:4] + _alike(canonical[4:], draw)
        elif sort == "IBAN":
            new = iban(canonical[:2], _alike(canonical[4:], draw))
        elif sort == "TOKEN":
            keep = re.match(r"gh[pousr]_|sk-|xox[abp]-|eyJ|", canonical)[0]
            new = keep + _alike(canonical[len(keep) :], draw)
        elif sort == "HEX":
            new = _alike(canonical, draw, hexadecimal=True)
        elif sort in ("SURNAME", "GIVEN"):
            gender, _, script = rest.partition(":")
            pool = (SURNAMES[rest] if sort == "SURNAME" else GIVEN.get((script, gender), GIVEN["Latin", "n"])).split()
            new = pool[draw.below(len(pool))] + "-" + (pool[draw.below(len(pool))] if not attempt else pool[draw.below(len(pool))] + _syllables(draw, script or rest))
        else:
            new = _alike(canonical, draw)
        if canonical.casefold() not in (new.casefold(), *new.casefold().split("-")):
            return new
    return new + "".join(str(draw.below(10)) for _ in range(6))


def _syllables(draw: _Stream, script: str) -> str:
    c, v = {"Cyrillic": ("бвгдклмнпрст", "аеиоу"), "Greek": ("βγδκλμνπρστ", "αειο")}.get(script, ("bdfgklmnprst", "aeiou"))
    return "".join(c[draw.below(len(c))] + v[draw.below(len(v))] for _ in range(6))


def dressed(part: Part, found: str, new: str) -> str:
    """The stand-in in the format of the occurrence: its separators and its case."""
    sort = part.kind.partition(":")[0]
    if sort in ("CARD", "PHONE", "IBAN"):
        chars = iter(new.lstrip("+") if sort == "PHONE" else new)
        return "".join(next(chars, "0") if c.isalnum() else c for c in found)
    if sort in ("SURNAME", "GIVEN"):
        return new.upper() if found.isupper() and len(found) > 1 else new
    return new.upper() if sort == "EMAIL" and found.isupper() else new


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct entities of a batch."""
    for batch in textkit.parts(batches, 0):
        seen = {(p.kind, p.canonical) for t in textkit.texts(batch.column(0)) for p in detect(t.decode("utf-8", "replace"))}
        yield pa.record_batch([pa.array([x[i] for x in seen], pa.string()) for i in (0, 1)], names=["kind", "canonical"])


def _drawn(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "canonical", "attempt")), strict=True)
        yield pa.record_batch([*batch.columns, pa.array([surrogate(k, c, key, a) for k, c, a in rows], pa.string())], names=[*batch.schema.names, "surrogate"])


def surrogate_table(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """kind, canonical, attempt, surrogate, `as_kind` of every distinct entity: distinct within a kind, and no entity of the corpus.

    The first draw combines two names of a pool and leaves no key with more
    than a few hundredths of a kind; later draws come from a space too large to
    collide often. A given name that stands under titles of several genders is
    one entity, drawn as `as_kind`: with the one gender that any title or list
    tells, else with none."""
    schema = "kind string, canonical string, attempt int, surrogate string"
    found = staged(docs.select(text_col).mapInArrow(_entities, "kind string, canonical string").distinct(), "entities")
    part = F.split("kind", ":")
    given = found.where("kind like 'GIVEN:%'").groupBy(part[2].alias("script"), F.col("canonical").alias("name")).agg(F.bool_or(part[1] == "m").alias("m"), F.bool_or(part[1] == "f").alias("f"))
    sex = F.when(F.expr("m and not f"), "m").when(F.expr("f and not m"), "f").otherwise("n")
    given = staged(given.select(F.concat(F.lit("GIVEN:"), sex, F.lit(":"), "script").alias("as_kind"), "script", "name"), "given")
    entities = found.where("kind not like 'GIVEN:%'").unionByName(given.select(F.col("as_kind").alias("kind"), F.col("name").alias("canonical"))).withColumn("attempt", F.lit(0))
    drawn = _distinct_draws(staged(entities.mapInArrow(lambda it: _drawn(it, key), schema), "surrogates"), key, schema)
    other = found.where("kind like 'GIVEN:%'").join(given, (part[2] == F.col("script")) & (F.col("canonical") == F.col("name"))).select("kind", "canonical", "as_kind")
    names = found.where("kind not like 'GIVEN:%'").withColumn("as_kind", F.col("kind")).unionByName(other)
    return names.join(drawn.withColumnRenamed("kind", "as_kind"), ["as_kind", "canonical"])


def _distinct_draws(table: DataFrame, key: bytes, schema: str) -> DataFrame:
    real = table.select(F.col("kind").alias("k"), F.lower("canonical").alias("c"))
    while True:
        rank = F.row_number().over(Window.partitionBy("kind", F.lower("surrogate")).orderBy("attempt", "canonical"))
        marked = table.withColumn("rank", rank).join(real, (F.col("kind") == F.col("k")) & (F.lower("surrogate") == F.col("c")), "left")
        again = staged(marked.select("kind", "canonical", "attempt", "surrogate", ((F.col("rank") > 1) | F.col("c").isNotNull()).alias("clash")), "checked")
        if again.where("clash").isEmpty():
            return again.select("kind", "canonical", "attempt", "surrogate")
        new = again.where("clash").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        redrawn = new.mapInArrow(lambda it: _drawn(it, key), schema)
        table = staged(again.where("not clash").drop("clash").unionByName(redrawn), "surrogates")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct entities of each document."""
    for batch in textkit.parts(batches, 2):
        rows, kinds, names = [], [], []
        for i, text in enumerate(textkit.texts(batch.column(2))):
            for k, c in sorted({(p.kind, p.canonical) for p in detect(text.decode("utf-8", "replace"))}):
                rows.append(i), kinds.append(k), names.append(c)
        at = pa.array(rows, pa.int64())
        yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(kinds, pa.string()), pa.array(names, pa.string())], names=["id", "key", "kind", "canonical"])


def _replaced(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    for batch in textkit.parts(batches, 1):
        out, counts, kinds = [], [], []
        for text, is_null, special in zip(textkit.texts(batch.column("text")), batch.column("text").is_null().to_pylist(), batch.column("special").to_pylist(), strict=True):
            own = {(x["kind"], x["canonical"]): x["surrogate"] for x in special or ()}
            plain = text.decode("utf-8", "replace")
            pieces, at, parts = [], 0, detect(plain)
            for p in parts:
                found = plain[p.start : p.end]
                new = own.get((p.kind, p.canonical)) or surrogate(p.kind, p.canonical, key)
                pieces += [plain[at : p.start], dressed(p, found, new)]
                at = p.end
            out.append(None if is_null else "".join([*pieces, plain[at:]]))
            counts.append(len(parts))
            kinds.append(",".join(sorted({p.kind.partition(":")[0] for p in parts})))
        yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], names=["doc_id", "text", "n_entities", "kinds"])


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with stand-ins, n_entities and kinds of every row.

    Null texts stay null, empty ones empty. Null and repeated ids are treated
    row by row; other columns are not read; an empty table gives an empty
    result. Texts of any length are read whole, in runs of at most 4 MB or one
    longer text; of two possible entities at one place the one that begins
    first counts. Stand-ins at the first draw are recomputed where they are
    needed; only entities that had to draw again, or as another gender, are
    joined to the documents that name them."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = surrogate_table(src, key)
    again = staged(table.where("attempt > 0 or kind <> as_kind").select("kind", "canonical", "surrogate"), "redrawn")
    keyed = src.withColumn("key", F.xxhash64("text"))
    if again.isEmpty():
        joined = src.withColumn("special", F.lit(None).cast("array<struct<kind:string,canonical:string,surrogate:string>>"))
    else:
        named = keyed.select("doc_id", "key", "text").mapInArrow(_named, "id long, key long, kind string, canonical string")
        special = named.join(again, ["kind", "canonical"]).groupBy("id", "key").agg(F.collect_set(F.struct("kind", "canonical", "surrogate")).alias("special"))
        special = staged(special.withColumnRenamed("key", "k"), "special")
        joined = keyed.join(special, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")
    return joined.select("doc_id", "text", "special").mapInArrow(lambda it: _replaced(it, key), "doc_id long, text string, n_entities long, kinds string")
