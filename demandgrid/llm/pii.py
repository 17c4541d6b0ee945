"""Personal data replaced by surrogates of the same kind.

An entity is a kind and a value in a normal form (digits of a number, an address in lower
case), so the same entity is replaced alike wherever it stands. Names are found after a
title or as a listed given name before a capitalised word; every further mention of a name
found in a document, alone or in part, is the same entity. A surrogate is drawn from a
keyed hash of the entity and an attempt number, and keeps the format: letters stay letters
of their script and case, digits digits, card numbers pass their check digit, given names
keep gender and script. Attempt 0 serves nearly all. The distinct entities are checked
against each other in one distributed table: an entity whose surrogate is the surrogate of
another, or is itself an entity of the corpus, gets the next attempt until none collides.
Only the documents that hold such an entity then look their attempts up.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandgrid.llm.common import pick, stored

KEY = "surrogates"
ENTITY = T.ArrayType(T.StructType().add("kind", "string").add("value", "string"))

# Given names by script and gender, titles that announce a name.
NAMES = {
    ("latin", "f"): "Alice Anna Carmen Charlotte Claire Elena Emma Greta Ingrid Julia Laura Lucia Maria Marie Nora Paula Sophie Teresa".split(),
    ("latin", "m"): "Albert Andreas Carlos David Diego Felix Hans Jacques James Jean John Karl Louis Luis Michael Pablo Peter Robert".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Наталья Ольга Светлана".split(),
    ("cyrillic", "m"): "Александр Борис Виктор Дмитрий Иван Михаил Николай Сергей".split(),
    ("greek", "f"): "Αθηνά Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Παύλος".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Madame Mme Frau Señora Sra Госпожа Κυρία".split(),
    "m": "Mr Monsieur Herr Señor Sr Господин Κύριος".split(),
    "u": "Dr Prof Professor Доктор Профессор".split(),
}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

# Parts that names are built from, by script: beginnings, middles, endings of family and of given names by gender.
PARTS = {
    "latin": ("ald bar brem cal dor eld far gar hal hold kel lam lor mar mel nor ost pell ras rol sal stan tal tor ulm val wal wen".split(), "a el en er i in o ol or u".split()),
    "cyrillic": ("бел вол гор дем жар зим кал кор лес мор нов ор пет род сав тар ул чер".split(), "ан ел ен ик ин ов ол ор".split()),
    "greek": ("αλ βασ γαλ δαν ζερ θεμ καλ λαμπ μαρ νικ παπ ροδ σταμ τριαντ φιλ χατζ".split(), "αν ελ ερ ιν ον ορ".split()),
}
FAMILY = {
    ("latin", "u"): "berg don feld ford gren ham hart ini ley lund man mark mont nes rand sen son stein ter ton vale well wick wood".split(),
    ("cyrillic", "m"): "ев енко ин ов ский".split(),
    ("cyrillic", "f"): "ева енко ина ова ская".split(),
    ("greek", "m"): "άκης έας ίδης όπουλος".split(),
    ("greek", "f"): "άκη έα ίδου οπούλου".split(),
}
GIVEN = {
    ("latin", "f"): "a ella ette ina ine issa".split(),
    ("latin", "m"): "ard en in o on us".split(),
    ("cyrillic", "f"): "ана ина ия".split(),
    ("cyrillic", "m"): "ан ей ир ислав".split(),
    ("greek", "f"): "ία ίνα ούλα".split(),
    ("greek", "m"): "ας ης ος".split(),
}

GENDER = {name: key for key, names in NAMES.items() for name in names}
TITLE = {t: g for g, ts in TITLES.items() for t in ts}
_WORD = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_EMAIL = r"[A-Za-z0-9._%+\-]*[A-Za-z0-9_%+\-]@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"
_TITLES = "|".join(sorted(TITLE))
_LISTED = "|".join(sorted(GENDER))
_CAPITAL = r"[^\W\d_a-zа-яα-ω]"
_FAMILY = rf"(?={_CAPITAL}(?:[^\W\d_]|['’])){_WORD}"
PATTERN = re.compile(
    r"://(?P<login>[^\s/:@]+:[^\s/@]+)(?=@)"
    rf"|(?P<email>{_EMAIL})"
    r"|\b(?P<label>(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9+/_\-]{12,})"
    r"|\b(?P<access>AKIA[A-Z0-9]{16}\b|(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-)[A-Za-z0-9_\-]{16,})"
    r"|\b(?P<iban>[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b"
    r"|(?<![\w:.])(?P<ip6>(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4})(?![\w:])"
    r"|(?<![\w.])(?P<ip>(?:\d{1,3}\.){3}\d{1,3})(?![\w]|\.\d)"
    r"|(?<![\w\-])(?P<ssn>\d{3}-\d\d-\d{4})(?![\w]|-\d)"
    r"|(?<!\w)(?P<phone>(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}|\+\d{1,3}(?:[ .\-]?\(\d{2,4}\))?(?:[ .\-]?\d{2,4}){2,4}|(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4})(?!\w|[.\-]\d)"
    r"|(?<![\w.])(?P<card>\d(?:[ \-]?\d){12,18})(?!\w|\.\d)"
    rf"|\b(?P<title>{_TITLES})\.?\s+(?P<name>(?!{_EMAIL}){_WORD}(?:\s+(?!{_EMAIL}|(?:{_TITLES})\b){_FAMILY})?)"
    rf"|\b(?P<full>(?:(?:{_LISTED})\s+)+(?!{_EMAIL}|(?:{_TITLES})\b){_FAMILY})"
)
KINDS = ("login", "email", "secret", "access", "iban", "ip6", "ip", "ssn", "phone", "card", "name", "full")
#: What every entity has: without one of these a text has none.
HINT = re.compile(rf"[0-9@]|(?i:passw|pwd|secret|token|key)|\b(?:{_TITLES}|{_LISTED})\b")
_MENTION = re.compile(_WORD)


def check_digit(digits: str) -> str:
    """The last digit that makes a card number valid (Luhn)."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 - i % 2)
        total += x - 9 * (x > 9)
    return str(-total % 10)


def iban_digits(value: str) -> str:
    """The check digits of an account number (ISO 13616), whatever stands in their place."""
    number = "".join(str(int(c, 36)) for c in value[4:] + value[:2] + "00")
    return f"{98 - int(number) % 97:02d}"


def _mentions(text: str, out: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """``out`` with every further mention of the names in it, in order.

    A mention is the word in capitals or with a capital first, also as part of a compound or before a possessive. A word that the
    text has in lower case too is an ordinary word: it is a name only where it was found. A given name whose title
    leaves the gender open takes the one that the text shows elsewhere.
    """
    names: dict[str, str] = {}
    for *_, kind, value in out:
        if kind == "family" or kind.startswith("given") and names.get(value, "family") in ("family", "given-u"):
            names.setdefault(value, kind) if kind == "family" else names.update({value: kind})
    if not names:
        return out
    words, ordinary = [], set()
    for m in _MENTION.finditer(text):
        word, at = m[0], m.start()
        parts = [(at, word)] if word.lower() in names else [(at + p.start(), p[0]) for p in re.finditer(r"[^-'’]+", word)]
        for start, part in parts:
            if (low := part.lower()) in names:
                if part[0].islower():
                    ordinary.add(low)
                else:
                    words.append((start, start + len(part), low))
    done = [(s, e, names[v] if k == "given-u" else k, v) for s, e, k, v in out]
    taken, i = [], 0
    for start, end, low in words:
        while i < len(out) and out[i][1] <= start:
            i += 1
        if low not in ordinary and (i == len(out) or end <= out[i][0]):
            taken.append((start, end, names[low], low))
    return sorted(done + taken)


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form), in order.

    An address is four numbers up to 255, or a version 6 address of three groups or more; a card, an account number has
    valid check digits; a name follows a title and has a capitalised word, or is a listed given name and a capitalised
    word. Three, three and four digits with spaces between are a phone.
    """
    out = []
    if not HINT.search(text):
        return out
    # After a discarded match the search goes on inside it: it may hold the start of an entity.
    at, no_card = 0, 0
    while m := PATTERN.search(text, at):
        at = m.end()
        kind = next(k for k in KINDS if m[k])
        start, end = m.span(kind)
        value = m[kind]
        if kind == "email":
            value = value.lower()
        elif kind == "access":
            if not re.search(r"\d", value):
                at = start + 1
                continue
        elif kind == "iban":
            # Words in capitals may follow: the longest beginning with valid check digits counts.
            while (value := re.sub(" ", "", text[start:end])) and len(value) >= 15 and iban_digits(value) != value[2:4]:
                end = max(start, text.rfind(" ", start, end))
            at = end
            if len(value) < 15:
                at = start + 1
                continue
        elif kind == "ip6":
            try:
                if len(re.findall(r"[^:]+", value)) < 3 or not re.search(r"\d", value):
                    raise ValueError(value)
                value = ipaddress.IPv6Address(value).exploded
            except ValueError:
                at = start + 1
                continue
        elif kind == "ip":
            if any(int(p) > 255 for p in value.split(".")):
                continue
        elif kind == "ssn":
            value = value.replace("-", "")
            if value[:3] in ("000", "666") or value[0] == "9" or value[3:5] == "00" or value[5:] == "0000":
                continue
        elif kind in ("phone", "card"):
            value = re.sub(r"\D", "", value)
            if kind == "card" and (start < no_card or check_digit(value[:-1]) != value[-1]):
                # Digits of a number that is no card may be a phone, but no other card.
                at, no_card = start + 1, no_card if start < no_card else end
                continue
            if kind == "phone" and not 9 <= len(value) <= 15:
                continue
        elif kind in ("name", "full"):
            words = [w for w in value.split() if not w[0].islower()]
            if not words:
                at = m.end("title")
                continue
            end = start + value.index(words[-1]) + len(words[-1])
            titled = TITLE[m["title"]] if kind == "name" else GENDER[words[0]][1]
            for word in text[start:end].split():
                first = text.index(word, start)
                # A family name before a possessive is the name alone.
                bare = re.sub(r"['’]s$", "", word)
                # The title names the gender of a given name that is not in the lists.
                given = word == words[0] and len(words) > 1 or bare in GENDER
                gender = GENDER.get(bare, ("", titled))[1]
                out.append((first, first + len(bare), f"given-{gender}" if given else "family", bare.lower()))
                start = first + len(word)
            continue
        out.append((start, end, kind, value))
    return _mentions(text, out)


def _script(c: str) -> str:
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


class Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: str, *parts: str):
        self.key, self.parts, self.block, self.left = key.encode(), "\0".join(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hmac.new(self.key, self.parts + b"\0%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x % n


def _like(value: str, s: Stream) -> str:
    """Other letters and digits of the same scripts and cases, all else as it is."""
    out = []
    for c in value:
        if c.isdigit():
            out.append(str(s.below(10)))
        elif c.isalpha():
            letters = ALPHABETS[_script(c)]
            x = letters[s.below(len(letters))]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def surrogate(kind: str, value: str, attempt: int = 0, key: str = KEY) -> str:
    """The normal form of the surrogate of an entity in normal form."""
    s = Stream(key, kind, value, str(attempt))
    if kind == "email":
        # With many short addresses a longer name keeps surrogates distinct.
        name, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_like(name + 'a' * (attempt // 4), s)}@{_like(host, s)}.{top}"
    if kind == "login":
        return ":".join(_like(p + "a" * (attempt // 4), s) for p in value.split(":"))
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "ip6":
        # Groups of zeros stay, others keep their length (any length past some attempts).
        groups = [g if attempt < 4 else g and "ffff" for g in (g.lstrip("0") for g in value.split(":"))]
        return ":".join((f"{1 + s.below(15):x}" + "".join(f"{s.below(16):x}" for _ in g[1:]) if g else "0").zfill(4) for g in groups)
    if kind == "ssn":
        return f"{(100 + s.below(566)):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}"
    if kind == "iban":
        body = value[:2] + "00" + "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in value[4:])
        return value[:2] + iban_digits(body) + body[4:]
    if kind == "card":
        body = value[0] + "".join(str(s.below(10)) for _ in value[1:-1])
        return body + check_digit(body)
    if kind == "phone":
        # The country prefix stays: it is format.
        keep = max(0, len(value) - 10)
        return value[:keep] + "".join(str(s.below(10)) for _ in value[keep:])
    if kind == "access" and value.startswith("AKIA"):
        return value[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[s.below(32)] for _ in value[4:])
    if kind == "access":
        prefix = re.match("github_pat_|[a-z]+[_-]", value)[0]
        return prefix + _like(value[len(prefix):], s)
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+", value):
        return "".join("0123456789abcdef"[s.below(16)] for _ in value)
    if kind.startswith("given"):
        script, gender = _script(value[0]), "fm"[s.below(2)] if kind[-1] == "u" else kind[-1]
        # Past the list, names built by rule keep surrogates distinct.
        if attempt == 0:
            return NAMES[script, gender][s.below(len(NAMES[script, gender]))].lower()
        return _built(script, GIVEN[script, gender], attempt, s)
    if kind == "family":
        # Parts of one or two letters grow with the attempts: there are few of them.
        return re.sub("[^-'’]+", lambda m: _family(m[0], attempt, s) if len(m[0]) > 2 else _like(m[0] + "a" * (attempt // 4), s), value)
    return _like(value, s)


def _built(script: str, endings: list[str], middles: int, s: Stream) -> str:
    """A name of a beginning, some middles and an ending; each middle makes many more."""
    first, middle = PARTS[script]
    return first[s.below(len(first))] + "".join(middle[s.below(len(middle))] for _ in range(middles)) + endings[s.below(len(endings))]


def _family(part: str, attempt: int, s: Stream) -> str:
    """A family name of the same script, with the ending of the same gender where the script shows it."""
    script = _script(part[0])
    feminine = part.endswith(("а", "я")) if script == "cyrillic" else part.endswith(("α", "η", "ου", "ά", "ή"))
    gender = "u" if script == "latin" else "f" if feminine else "m"
    return _built(script, FAMILY[script, gender], s.below(2) + attempt, s)


def written(kind: str, replacement: str, original: str) -> str:
    """A surrogate in the writing of the original: its separators, its case."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(replacement)
        return "".join(next(digits) if c.isdigit() else c for c in original)
    if kind == "iban":
        signs = iter(replacement)
        return "".join(c if c == " " else next(signs) for c in original)
    if kind == "ip6":
        groups, new = original.split(":"), replacement.split(":")
        gap = groups.index("") if "" in groups else len(groups)
        shown = [new[i] if i < gap else new[i - len(groups)] for i in range(len(groups))]
        return ":".join(n.lstrip("0").rjust(max(1, len(g)), "0") if g else "" for g, n in zip(groups, shown))
    if kind == "email":
        return "".join(r.upper() if o.isupper() else r for r, o in zip(replacement, original)) if len(replacement) == len(original) else replacement
    if kind.startswith("given") or kind == "family":
        if original.isupper() and len(original) > 1:
            return replacement.upper()
        return re.sub(r"(^|[-'’])(\w)", lambda m: m[1] + m[2].upper(), replacement)
    return replacement


def replace(text: str, attempts: dict[tuple[str, str], int], key: str) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds replaced."""
    out, at, kinds = [], 0, []
    for start, end, kind, value in entities(text):
        new = surrogate(kind, value, attempts.get((kind, value), 0), key)
        out += [text[at:start], written(kind, new, text[start:end])]
        at = end
        kinds.append(kind)
    return ("".join([*out, text[at:]]) if out else text), kinds


@F.arrow_udf(ENTITY)
def found_entities(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))
    for array in texts:
        out = []
        for t in array:
            text = t.as_py()
            out.append([{"kind": k, "value": v} for k, v in dict.fromkeys((k, v) for *_, k, v in entities(text))] if text else [])
        yield pa.array(out, kind)


def _drawn(known: DataFrame, key: str) -> DataFrame:
    @F.arrow_udf("string")
    def draw(kind: pa.Array, value: pa.Array, attempt: pa.Array) -> pa.Array:
        return pa.array([surrogate(k, v, a, key) for k, v, a in zip(kind.to_pylist(), value.to_pylist(), attempt.to_pylist())], pa.string())

    return known.withColumn("new", draw("kind", "value", "attempt"))


def attempts(known: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, value, attempt, new) of distinct entities (kind, value), such that every ``new`` is one entity's alone and none's value.

    Among entities with the same surrogate the one with fewer attempts, then the least value, keeps it.
    Given and family names are one group here: no surrogate of either is a name of the corpus.
    """
    now = stored(_drawn(known.withColumn("attempt", F.lit(0)), key), "surrogates")
    group = F.when(F.col("kind").startswith("given") | (F.col("kind") == "family"), "name").otherwise(F.col("kind")).alias("group")
    real = known.select(group, F.col("value").alias("new"), F.lit(True).alias("real")).distinct()
    while True:
        grouped = now.select("*", group)
        first = grouped.groupBy("group", "new").agg(F.min(F.struct("attempt", "value")).alias("first"))
        judged = grouped.join(first, ["group", "new"]).join(real, ["group", "new"], "left")
        bad = F.col("real").isNotNull() | (F.col("first.value") != F.col("value"))
        judged = stored(judged.select("kind", "value", (F.col("attempt") + bad.cast("int")).alias("attempt"), "new", bad.alias("bad")), "surrogates")
        if judged.where("bad").isEmpty():
            return judged.drop("bad")
        again = _drawn(judged.where("bad").drop("new", "bad"), key)
        now = stored(judged.where("not bad").drop("bad").unionByName(again), "surrogates")


def replace_in(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with ``text`` replaced, and ``kinds`` (of the replaced entities, in order); other columns stay.

    Null texts stay null, texts without an entity stay as they are. Whole texts are read. Equal entities
    get equal surrogates in all rows, different ones of a kind different ones. Rows repeat as they do in ``docs``.
    """
    place = docs.columns.index("text")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[place]
    found = plain.select(F.md5(F.col(text).cast("binary")).alias("_key"), found_entities(text).alias("_e")).where(F.size("_e") > 0)
    found = stored(found.distinct().select("_key", F.explode("_e").alias("_e")).select("_key", "_e.*"), "entities")
    again = stored(attempts(found.select("kind", "value").distinct(), key).where("attempt > 0"), "attempts")
    if again.isEmpty():
        tried = plain.withColumn("_tries", F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>"))
    else:
        tries = found.join(again, ["kind", "value"]).groupBy("_key").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("_tries"))
        tried = plain.withColumn("_key", F.md5(F.col(text).cast("binary"))).join(tries, "_key", "left").drop("_key")

    @F.arrow_udf("text string, kinds array<string>")
    def rewrite(texts: pa.Array, tries: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(texts, tries):
            t = t.as_py()
            known = {(x["kind"], x["value"]): x["attempt"] for x in own.as_py() or []}
            new, kinds = (None, []) if t is None else replace(t, known, key)
            out.append({"text": new, "kinds": kinds})
        return pa.array(out, pa.struct([("text", pa.string()), ("kinds", pa.list_(pa.string()))]))

    done = tried.withColumn("_new", rewrite(text, "_tries"))
    columns = [F.col("_new.text").alias("text") if i == place else F.col(n).alias(c) for i, (n, c) in enumerate(zip(names, docs.columns))]
    return done.select(*columns, F.col("_new.kinds").alias("kinds"))
