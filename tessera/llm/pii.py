"""Personal data: detection and replacement by keyed surrogates."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, text_steps

# Forms of address and the gender they tell.
TITLES = {"mr": "m", "mister": "m", "herr": "m", "herrn": "m", "monsieur": "m", "señor": "m", "don": "",
          "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "mademoiselle": "f",
          "señora": "f", "señorita": "f", "dr": "", "prof": "", "господин": "m", "госпожа": "f", "sir": "m", "dame": "f",
          "lord": "m", "lady": "f", "rev": "", "capt": "", "sgt": "", "signor": "m", "signora": "f", "pan": "m", "pani": "f"}
# Offices that follow a form of address, and words that make a name a place.
OFFICES = {"president", "speaker", "chairman", "chairwoman", "chair", "secretary", "minister", "justice", "mayor", "ambassador"}
PLACES = {"street", "road", "avenue", "lane", "square", "park", "airport", "university", "college", "hospital", "bridge", "station"}
# Given names that start a full name without a form of address.
GIVEN_M = ("james robert john michael david william richard joseph thomas charles peter paul hans klaus jürgen "
           "wolfgang pierre jacques françois josé carlos miguel javier иван сергей дмитрий алексей daniel matthew anthony "
           "andrew joshua kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan "
           "stephen benjamin samuel alexander patrick jack dennis tyler henry adam peter arjun rahul mohammed ahmed ali "
           "omar hassan wei hiroshi kenji luca marco giovanni lars sven piotr tomasz")
GIVEN_F = ("mary patricia jennifer linda elizabeth barbara susan jessica sarah margaret emily ursula monika petra "
           "sabine françoise brigitte maría carmen lucía мария елена ольга татьяна jane anna ashley kimberly donna michelle "
           "carol amanda melissa deborah stephanie rebecca laura helen sandra kathleen amy angela shirley ruth catherine "
           "christine emma olivia sophia isabella charlotte alice julia priya anita fatima aisha mei yuki giulia chiara "
           "ingrid astrid agnieszka katarzyna")
GIVEN = {n: "m" for n in GIVEN_M.split()} | {n: "f" for n in GIVEN_F.split()}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_NAME = r"(?:[^\W\d_]['’])?[^\W\d_][^\W\d_'’-]+(?:-[^\W\d_]+)?"
_HEX = "[0-9A-Fa-f]{1,4}"
PATTERNS = (
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.])(?:[2-6][0-9]{3}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5})(?!\w)")),
    ("ip", re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.[0-9])")),
    ("ip6", re.compile(rf"(?<![\w:.])(?:{_HEX}:){{2,7}}(?::?{_HEX}|:)(?::{_HEX}){{0,6}}(?![\w:])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?!\w)"
                         r"|(?<![\w+])\+[0-9]{10,15}(?!\w)"
                         r"|(?<![\w+])\+[2-9][0-9]{0,2}(?:[ -]\(?[0-9]{1,8}\)?){2,5}(?!\w|\.[0-9])"
                         # national: a leading zero, then groups of the usual sizes
                         r"|(?<![\w+.,/-])0[0-9]{2,4}[ /-][0-9]{3,4}[ -][0-9]{3,4}(?![\w-]|[.,][0-9])")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
)
# what every match of a pattern holds: cheap to look for before the pattern itself
HOLDS = {"email": re.compile("@"), "iban": re.compile("[A-Z]{2}[0-9]{2}"), "card": re.compile("[0-9]{4}"),
         "ip": re.compile(r"[0-9]\.[0-9]"), "ip6": re.compile(r":[0-9A-Fa-f]*:"),
         "phone": re.compile(r"[+0-9](?:(?<=\+)[0-9]|[0-9]{2}[ .-][0-9]{4})|0[0-9]{2,4}[ /-][0-9]{3}"),
         "ssn": re.compile("[0-9]{3}-[0-9]{2}-")}
PLAIN = str.maketrans("ıſᲀᲁᲂᲃᲄᲅ", "isвдостт")
# words that may open a name: those not starting with a small ASCII letter
HEAD = re.compile(r"(?<!\w)[^\W\d_a-z]\w*")
AFTER_TITLE = re.compile(rf"\.?[ ]({_NAME})")
NEXT_WORD = re.compile(rf" ({_NAME})")
# words as names have them: those written small, and those that may be a bare mention
SMALL = re.compile(rf"(?<!\w)(?=[^\W\d_A-Z]){_NAME}")
WORD_WITH_CAPITAL = re.compile(rf"(?<!\w)(?=[^\W\d_a-z]){_NAME}(?!\w)")


@dataclass(frozen=True)
class Entity:
    """A span to replace. ``canonical`` is equal for all mentions of one thing; ``shape``
    carries what a surrogate must match besides (gender and script of a name)."""

    start: int
    end: int
    kind: str
    canonical: str
    shape: str = ""


# -- detection ------------------------------------------------------------------------

def _script(word: str) -> str:
    first = unicodedata.name(word[0], "LATIN").split()[0]
    return first if first in ("CYRILLIC", "GREEK") else "LATIN"


def _plain_case(word: str) -> str:
    """Lower case, with the letters that a pattern without case takes for others (as ``ſ`` for ``s``)."""
    return word.lower() if word.isascii() else word.replace("İ", "i").lower().translate(PLAIN)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban_rest(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def _address6(raw: str) -> str | None:
    """An IPv6 address of one host in its full form, None for what is none (as a time of day)."""
    try:
        address = ipaddress.IPv6Address(raw)
    except ValueError:
        return None
    return None if address.is_loopback or address.is_unspecified or address.is_multicast else address.exploded


def _words_on(text: str, first: re.Pattern, at: int, most: int) -> list[tuple[str, int, int]]:
    """Up to ``most`` capitalised words from ``at`` on, with their places. A form of address
    that a capitalised word follows starts another name and ends this one; ``don`` is a given
    name as well and does not."""
    out = []
    m = first.match(text, at)
    while m and len(out) < most and m.group(1)[0].isupper():
        if _plain_case(m.group(1)) in TITLES.keys() - {"don"}:
            then = AFTER_TITLE.match(text, m.end())
            if then and then.group(1)[0].isupper():
                break
        out.append((m.group(1), m.start(1), m.end(1)))
        m = NEXT_WORD.match(text, m.end())
    return out


def _name_parts(words: list[tuple[str, int, int]], given_gender: str | None, title_gender: str) -> list[Entity]:
    """One entity per word of a name: given names carry a gender, the last word is the surname."""
    out = []
    for i, (w, a, b) in enumerate(words):
        if i == len(words) - 1 and not (given_gender is not None and len(words) == 1):
            kind, shape = "surname", _script(w)
        else:
            gender = GIVEN.get(_plain_case(w), title_gender or given_gender or "")
            kind, shape = "given", f"{gender}:{_script(w)}"
        out.append(Entity(a, b, kind, w.lower(), shape))
    return out


def _names(text: str) -> list[Entity]:
    """The words of all names. Each form of address and each given name is looked at, also
    inside or right behind another name, so none is hidden by the one before it. An office
    after a form of address is no name, and a name before a word like Street is a place."""
    titled, full = [], []
    for m in HEAD.finditer(text):
        head = _plain_case(m.group())
        if not m.group()[0].isupper():
            continue
        if head in TITLES:
            words = _words_on(text, AFTER_TITLE, m.end(), 3)
            if words and _plain_case(words[0][0]) not in OFFICES:
                titled += _name_parts(words, None, TITLES[head])
        if head in GIVEN:
            more = _words_on(text, NEXT_WORD, m.end(), 2)
            then = NEXT_WORD.match(text, more[-1][2]) if more else None
            place = [_plain_case(w) in PLACES for w, *_ in more] + [bool(then) and _plain_case(then.group(1)) in PLACES
                                                                     and then.group(1)[0].isupper()]
            if more and not any(place):
                full += _name_parts([(m.group(), m.start(), m.end()), *more], GIVEN[head], "")
    return titled + full


def _again(text: str, names: list[Entity]) -> list[Entity]:
    """Bare mentions of names that the text gives in full elsewhere: the same word with a
    capital. A word that the text also writes small is left alone, unless it is a name of
    one of the lists."""
    known: dict[str, Entity] = {}
    for e in names:
        known.setdefault(e.canonical, e)
    if not known:
        return []
    small = {w for w in SMALL.findall(text) if w in known}
    out = []
    for m in WORD_WITH_CAPITAL.finditer(text):
        e = known.get(m.group().lower())
        if e is not None and (e.canonical not in small or e.canonical in GIVEN):
            out.append(Entity(m.start(), m.end(), e.kind, e.canonical, e.shape))
    return out


def detect(text: str) -> list[Entity]:
    """The entities of a text, left to right, without overlap (earlier patterns win)."""
    found: list[Entity] = []
    for kind, pattern in PATTERNS:
        if not HOLDS[kind].search(text):
            continue
        for m in pattern.finditer(text):
            raw = m.group()
            plain = re.sub(r"[^A-Za-z0-9]", "", raw)
            if kind == "email" or kind == "ip":
                canonical = raw.lower()
            elif kind == "ip6":
                canonical = _address6(raw)
                if canonical is None:
                    continue
            elif kind == "iban":
                if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
                    continue
                canonical = plain
            elif kind == "phone":
                if not 8 <= len(plain) <= 15:
                    continue
                canonical = ("+" if raw[0] == "+" else "") + plain
            else:
                canonical = plain
            shape = re.split(r"[ .(-]", raw)[0] if kind == "phone" and raw[0] == "+" and len(plain) < len(raw) - 1 else ""
            found.append(Entity(m.start(), m.end(), kind, canonical, shape))
    order = {k: i for i, (k, _) in enumerate(PATTERNS)}
    found.sort(key=lambda e: (order[e.kind], e.start, e.end))
    names = _names(text)
    # names in full come before bare mentions of them
    found += sorted(names, key=lambda e: (e.start, e.end)) + _again(text, names)
    starts: list[int] = []
    taken: dict[int, Entity] = {}
    for e in found:
        i = bisect_right(starts, e.start)
        if (not i or taken[starts[i - 1]].end <= e.start) and (i == len(starts) or e.end <= starts[i]):
            starts.insert(i, e.start)
            taken[e.start] = e
    return [taken[a] for a in starts]


# -- surrogates -----------------------------------------------------------------------

class Stream:
    """Numbers from a key and a label: the same in every process."""

    def __init__(self, key: bytes, *label: str):
        self.key, self.label, self.n, self.pool = key, "\0".join(label).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.label + b"\0%d" % self.n, hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n

    def like(self, text: str) -> str:
        """Same length and classes: digits for digits, letters for letters, the rest kept."""
        return "".join(str(self.below(10)) if c.isdigit() else chr(97 + self.below(26)) if "a" <= c <= "z"
                       else chr(65 + self.below(26)) if "A" <= c <= "Z" else c for c in text)


#: Attempts within the exact length; later ones may be longer, so no form runs out.
ROOM = 8

# Syllables and endings of made-up names by script.
SYLLABLES = {"LATIN": "bal cor dal fen gar hol jar kel lor mar nev por quin ros sal tor ulm ver wen zel".split(),
             "CYRILLIC": "бал вер гор дан жар зел кор лун мар нов пол рос сан тол фед хол чар".split(),
             "GREEK": "βαλ γορ δαν ζελ καρ λορ μαρ νικ παλ ροσ σαν τορ φιλ".split()}
ENDINGS = {"LATIN": {"m": "on er us".split(), "f": "a ia ella".split(), "": "in el is".split(), "s": "man field berg".split()},
           "CYRILLIC": {"m": "ий ан".split(), "f": "а ия".split(), "": "ин".split(), "s": "ов ин ко".split()},
           "GREEK": {"m": "ος ης".split(), "f": "α η".split(), "": "ι".split(), "s": "ου άκης".split()}}


def surrogate(key: bytes, kind: str, canonical: str, shape: str, attempt: int = 0) -> str:
    """The replacement of an entity, in the form of its canonical text."""
    s = Stream(key, kind, shape, canonical, str(attempt))
    if kind == "email":
        local, domain = canonical.split("@")
        labels = domain.split(".")
        kept = 2 if labels[-2] == "example" else 1
        other = Stream(key, "domain", domain)
        local += "a" * (attempt // ROOM)
        return s.like(local) + "@" + ".".join([other.like(x) for x in labels[:-kept]] + labels[-kept:])
    if kind == "ip":
        out = []
        for x in canonical.split("."):
            low, high = {1: (1, 9), 2: (10, 99), 3: (100, 255)}[len(x)] if attempt < ROOM else (1, 255)
            out.append(str(low + s.below(min(high, 223) - low + 1 if not out else high - low + 1)))
        return ".".join(out)
    if kind == "ip6":
        # the routing prefix of a registry stays, the rest is made up
        rest = "".join(f"{s.below(16):x}" for _ in range(28))
        return ":".join([canonical[:4], *(rest[i:i + 4] for i in range(0, 28, 4))])
    if kind == "card":
        new = canonical[0] + s.like(canonical[1:])
        valid = _luhn(canonical)
        return next(c for c in (new[:-1] + str((int(new[-1]) + i) % 10) for i in range(10)) if _luhn(c) == valid)
    if kind == "iban":
        body = s.like(canonical[4:])
        return canonical[:2] + f"{98 - _iban_rest(canonical[:2] + '00' + body):02d}" + body
    if kind == "phone":
        head = shape if shape and canonical.startswith(shape) else canonical[0] if canonical[0] in "+0" else ""
        rest = s.like(canonical[len(head):])
        return head + (str(2 + int(rest[0]) % 8) + rest[1:] if rest else "")
    if kind in ("given", "surname"):
        script = shape.split(":")[-1]
        gender = shape.split(":")[0] if kind == "given" else "s"
        syllables = SYLLABLES[script]
        # names get longer with every attempt, so there are always enough
        stem = "".join(syllables[s.below(len(syllables))] for _ in range(2 + attempt // 2))
        return stem + ENDINGS[script][gender][s.below(len(ENDINGS[script][gender]))]
    return s.like(canonical)


def dress(surface: str, kind: str, new: str) -> str:
    """Put a surrogate into the written form of the mention: punctuation, spaces, case."""
    if kind in ("given", "surname"):
        return new.upper() if surface.isupper() and len(surface) > 1 else new[:1].upper() + new[1:]
    if kind in ("ip", "ip6") or len(new) > len(surface):
        return new
    fill = iter([c for c in new if c.isalnum()])
    out = []
    for c in surface:
        if c.isalnum():
            n = next(fill)
            out.append(n.upper() if c.isupper() else n)
        else:
            out.append(c)
    return "".join(out)


# -- operator -------------------------------------------------------------------------

def entity_table(texts: DataFrame) -> DataFrame:
    """``blob, kind, canonical, shape`` of every entity of ``texts`` (``blob, text``)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_steps(batches):
            rows = [(b, *x) for b, t in zip(part.column("blob").to_pylist(), part.column("text").to_pylist())
                    for x in sorted({(e.kind, e.canonical, e.shape) for e in detect(t)})]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)],
                                                 names=["blob", "kind", "canonical", "shape"])

    return texts.mapInArrow(work, "blob string, kind string, canonical string, shape string")


def assign_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, canonical, shape, attempt, new``: different entities get different surrogates,
    none of which is itself an entity of the corpus.

    A surrogate depends on key, entity and attempt alone. Rounds of grouping by surrogate
    find clashes; of those that clash, the first keeps its surrogate and the others try
    again. The table stays distributed; the driver only counts clashes.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(key, *x) for x in zip(*(b.column(c).to_pylist()
                                                     for c in ("kind", "canonical", "shape", "attempt")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=[*b.schema.names, "new"])

    schema = "kind string, canonical string, shape string, attempt int, new string"
    real = materialize(entities.groupBy("kind", "canonical").agg(F.max("shape").alias("shape")), "pii_entities")
    table = materialize(real.withColumn("attempt", F.lit(0)).mapInArrow(work, schema), "pii_surrogates")
    while True:
        holder = table.groupBy("kind", "new").agg(F.min(F.struct("attempt", "canonical")).alias("holder"),
                                                 F.count(F.lit(1)).alias("n"))
        known = real.select("kind", F.col("canonical").alias("new"), F.lit(True).alias("is_real"))
        judged = (table.join(holder, ["kind", "new"]).join(known, ["kind", "new"], "left")
                  .withColumn("clash", F.col("is_real").isNotNull()
                              | (F.col("holder.canonical") != F.col("canonical"))))
        judged = materialize(judged.select("kind", "canonical", "shape", "attempt", "new", "clash"), "pii_judged")
        if not judged.where("clash").limit(1).count():
            return judged.drop("clash")
        again = (judged.where("clash").select("kind", "canonical", "shape", (F.col("attempt") + 1).alias("attempt"))
                 .mapInArrow(work, schema))
        table = materialize(judged.where("NOT clash").drop("clash").unionByName(again), "pii_surrogates")


def replace_personal_data(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, n_found, kinds`` for every row of ``docs``: the whole text with every
    entity replaced, their number, and the kinds in order of appearance (comma-joined).

    Kinds: email, iban, card, ip, ip6, phone, ssn, and the words of names after a form of
    address or a known given name, and their bare mentions in the same text. Surrogates keep kind, length, punctuation, case, checksum state,
    country code, gender and script; equal entities get equal surrogates in the whole
    corpus, different ones different surrogates. Every text is searched; null stays null. Only entities whose first surrogate clashed
    travel back to their texts; the others are computed where they stand. Equal texts get
    equal results; no rows in, no rows out; other columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    empty = rows.where("text IS NULL").select("doc_id", "text", F.lit(0).cast("long").alias("n_found"), F.lit("").alias("kinds"))
    held = rows.where("text IS NOT NULL").withColumn("blob", F.sha2("text", 256))
    entities = materialize(entity_table(held.select("blob", "text")).distinct(), "pii_mentions")
    moved = assign_surrogates(entities, key).where("attempt > 0")
    marks = (entities.join(moved.select("kind", "canonical", "attempt"), ["kind", "canonical"])
             .groupBy("blob").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("again")))
    shapes = entities.groupBy("kind", "canonical").agg(F.max("shape").alias("shape"), F.min("shape").alias("least"))
    mixed = (entities.join(shapes.where("shape != least").select("kind", "canonical", F.col("shape").alias("agreed")),
                           ["kind", "canonical"])
             .groupBy("blob").agg(F.collect_list(F.struct("kind", "canonical", "agreed")).alias("agreed")))
    marked = held.join(marks, "blob", "left").join(mixed, "blob", "left").select("doc_id", "text", "again", "agreed")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_steps(batches):
            texts, counts, kinds = [], [], []
            for text, again, agreed in zip(*(part.column(c).to_pylist() for c in ("text", "again", "agreed"))):
                tries = {(x["kind"], x["canonical"]): x["attempt"] for x in again or ()}
                shape = {(x["kind"], x["canonical"]): x["agreed"] for x in agreed or ()}
                out, at, found = [], 0, detect(text)
                for e in found:
                    one = (e.kind, e.canonical)
                    new = surrogate(key, *one, shape.get(one, e.shape), tries.get(one, 0))
                    out += [text[at:e.start], dress(text[e.start:e.end], e.kind, new)]
                    at = e.end
                texts.append("".join([*out, text[at:]]))
                counts.append(len(found))
                kinds.append(",".join(e.kind for e in found))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()),
                                              pa.array(counts, pa.int64()), pa.array(kinds, pa.string())],
                                             names=["doc_id", "text", "n_found", "kinds"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(work, f"doc_id {kind}, text string, n_found long, kinds string").unionByName(empty)
