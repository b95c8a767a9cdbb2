"""Surrogates for personal data and secrets: keyed, of the same type and format, distinct where the originals are, and the same wherever one recurs.

Found are e-mail addresses, IP addresses of both kinds, card numbers (whose check digit is right), phone numbers, social security numbers, IBANs, MAC addresses,
secrets (access keys, tokens and passwords of four characters or more after their names, hexadecimal strings of 32 or
more, both of any length) and persons after a title. A surrogate follows from a key and the entity by a keyed hash: punctuation and lengths stay, digits become digits and
letters letters of the same case and script; check digits of card numbers and IBANs stay right, persons keep gender and script (Latin, Greek, Cyrillic).

Mentions of one entity agree, each in its own format: what counts of an e-mail address is its lower-case form, of numbers,
IBANs and MAC addresses their digits and letters. Of persons every given name and surname is an entity, in any case; all
capitalised mentions of a titled person's names in the same text, without a title too, are replaced. Which gender a name after a neutral
title (Dr., Prof.) has follows from the text's other mentions. Inflected forms of a name are other names.

Distinctness is checked over the whole table in Spark: where two entities got one surrogate, or a surrogate is itself
an original, all but the first derive another, round by round, until none is left. Only texts that a cheap pattern
suspects are shuffled; equal texts are treated once.

The key is a secret of the user's: a parameter, or Spark's setting spark.millrace.pii.key. Without either a session draws one at random and keeps it
in that setting, so that its surrogates agree with each other but not with those of other sessions.

Null text stays null and empty text empty; texts without entities pass unchanged; repeated rows all appear; other
columns, of whatever names, pass through.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b
from ipaddress import IPv6Address

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, stored, texts

#: Titles by gender and script.
TITLES = {
    ("f", "latin"): ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra."),
    ("m", "latin"): ("Mr.", "Mr", "Herr", "Monsieur", "Señor", "Sr."),
    ("n", "latin"): ("Dr.", "Dr", "Doctor", "Prof.", "Prof", "Professor"),
    ("f", "cyrillic"): ("г-жа", "госпожа", "Госпожа"),
    ("m", "cyrillic"): ("г-н", "господин", "Господин"),
    ("f", "greek"): ("κα", "κυρία", "Κυρία"),
    ("m", "greek"): ("κ.", "κος", "κύριος", "Κύριος"),
}
#: Given names by gender and script.
GIVEN = {
    ("f", "latin"): ("Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nina", "Paula", "Sofia", "Teresa", "Vera", "Ida", "Emma", "Lena", "Marta", "Olivia"),
    ("m", "latin"): ("Adam", "Bruno", "Daniel", "Erik", "Felix", "Hugo", "Ivan", "Jakob", "Leon", "Martin", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"),
    ("f", "cyrillic"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Юрий"),
    ("f", "greek"): ("Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Σοφία", "Κατερίνα"),
    ("m", "greek"): ("Γιώργος", "Γιάννης", "Νίκος", "Πέτρος", "Σπύρος", "Ανδρέας"),
}
SCRIPTS = ("latin", "cyrillic", "greek")
GIVEN |= {("n", script): GIVEN["f", script] + GIVEN["m", script] for script in SCRIPTS}
WHO = {t: who for who, ts in TITLES.items() for t in ts}
#: Syllables of surnames by script, and their ends by gender and script.
SYLLABLES = {"latin": ("ba", "der", "fen", "gor", "hal", "kin", "lo", "mar", "nel", "or", "pat", "ro", "san", "tel", "vin", "wes"), "cyrillic": ("ба", "вор", "гал", "дер", "кар", "лом", "мар", "нов", "пет", "рос", "сам", "тол"), "greek": ("βα", "γε", "δη", "καρ", "λα", "μαν", "νικ", "πα", "ρου", "σαρ", "τσι", "χρι")}
ENDS = {("n", "latin"): ("son", "man", "ley", "berg"), ("f", "cyrillic"): ("ова", "ина"), ("m", "cyrillic"): ("ов", "ин"), ("n", "cyrillic"): ("енко", "ко"), ("f", "greek"): ("ίδου", "άκη"), ("m", "greek"): ("ίδης", "άκης"), ("n", "greek"): ("έα", "ου")}

BYTE = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Capital letters by script.
CAPITALS = {script: "".join(c for c in map(chr, ranges) if c.isupper()) for script, ranges in {"latin": range(0x41, 0x250), "greek": range(0x370, 0x400), "cyrillic": range(0x400, 0x530)}.items()}
CAPITAL = "".join(CAPITALS.values())
NAME = rf"[{CAPITAL}][\w'’-]+"


def titled(script: str, name: str) -> str:
    words = sorted((t for (_, s), ts in TITLES.items() if s == script for t in ts), key=len, reverse=True)
    title = "|".join(map(re.escape, words))
    word = rf"(?!(?:{title})(?!\w)){name}"
    return rf"(?:(?<=^)|(?<=[\s(\"'«„]))(?:(?:{title}) )+{word}(?: {word}){{0,2}}"


#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|(?=[a-f]*\d)[0-9a-f]{32,})(?![A-Za-z0-9])",
    "mac": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{BYTE}\.){{3}}{BYTE}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-]|\.\d)",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,5}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w|\.\d)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w|\.\d)",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*::|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f])(?:[0-9A-Fa-f]{1,4})?(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.\d)",
    "person": "|".join(titled(script, NAME) for script in SCRIPTS),
}
#: What follows the name of a secret; only the last group is the secret.
NAMED = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth)(?:[_-]?(?:key|id))?[\"']?\s*[=:]\s*[\"']?([^\s\"'<>,;]{4,})")
#: Words that may be a name without a title, and what ends a name within a word.
WORD, ENDING = re.compile(rf"(?<![\w'’-])[{CAPITAL}][\w'’-]+"), re.compile(r"(?:['’]s?|-)+(?= |$)")
#: Country codes of phone numbers.
COUNTRY = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")
ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: Every text with an entity holds one of these characters or strings.
MARKS, STRINGS = "[0-9@=:]", ("Mr", "Ms", "Miss", "Frau", "Mme", "Madame", "Señor", "Sra.", "Sr.", "Herr", "Monsieur", "Dr.", "Dr ", "Doctor", "Prof", "г-", "осп", "κ. ", "κος ", "ύριος ", "κα ", "υρία ", "AKIA", "ASIA", "sk-", "xox", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")


def suspicious(text: Column) -> Column:
    """Whether a text may hold an entity. Plain searches: one pattern of all alternatives takes Spark several times as long."""
    found = text.rlike(MARKS)
    for s in STRINGS:
        found = found | text.contains(s)
    return F.coalesce(found, F.lit(False))


def spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the entities of a text, in order and apart from each other."""
    found = [(m.start(1), m.end(1), "secret") for m in NAMED.finditer(text)] if "=" in text or ":" in text else []
    found += [(m.start(), m.start() + len(bare(m[0])) if m.lastgroup == "person" else m.end(), m.lastgroup) for m in ANY.finditer(text) if right(m.lastgroup, m[0])]
    found.sort(key=lambda f: (f[0], -f[1]))
    out: list[tuple[int, int, str]] = []
    for a, b, kind in found:
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
        elif b > out[-1][1]:  # no end of an overlapping entity may stay
            out[-1] = (out[-1][0], b, "secret")
    return with_untitled(text, out) if any(kind == "person" for _, _, kind in out) else out


def right(kind: str, value: str) -> bool:
    """Whether a match is what its pattern is for: a number with a card's check digit, a well-formed address."""
    if kind == "card":
        return luhn("".join(c for c in value if c.isdecimal())) % 10 == 0
    if kind == "ipv6":
        try:
            return IPv6Address(value).packed.count(0) < 15 and any(map(str.isdigit, value))
        except ValueError:
            return False
    return True


def script_of(name: str) -> str:
    return next((s for s in SCRIPTS if name[0].upper() in CAPITALS[s]), "latin")


def bare(name: str) -> str:
    """A name up to a possessive."""
    end = ENDING.search(name)
    return name[: end.start()] if end else name


def parsed(mention: str) -> tuple[tuple[str, str] | None, list[re.Match]]:
    """Gender and script by the titles of a mention (None without a title), and its names."""
    words = list(re.finditer(r"\S+", mention))
    n = next((k for k, m in enumerate(words) if m[0] not in WHO), len(words))
    said = [WHO[m[0]] for m in words[:n]]
    return next((w for w in said if w[0] != "n"), said[0] if said else None), words[n:]


Cast = tuple[dict[str, tuple[str, str]], dict[str, tuple[str, str]]]


def cast_of(text: str, found: list[tuple[int, int, str]]) -> Cast:
    """Gender and script of the given names, and of the surnames, of all titled persons of a text."""
    given, surnames, neutral = {}, {}, []
    for a, b, kind in found:
        who, names = parsed(text[a:b]) if kind == "person" else (None, [])
        if who:
            *first, last = (m[0].casefold() for m in names)
            if who[0] == "n":
                neutral.append((first, last, who))
                continue
            surnames.setdefault(last, who)
            for word in first:
                given.setdefault(word, who)
    for first, last, who in neutral:
        for word in first:
            given.setdefault(word, surnames.get(last, who))
    for _, last, who in neutral:
        surnames.setdefault(last, who)
    return given, surnames


def with_untitled(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """found, and the mentions without a title of its persons' names; names side by side are one mention."""
    given, surnames = cast_of(text, found)
    out: list[tuple[int, int, str]] = []
    last = 0
    for a, b, kind in [*found, (len(text), len(text), "")]:
        first = len(out)
        for m in WORD.finditer(text, last, a):
            word = bare(m[0])
            if word.casefold() in given or word.casefold() in surnames:
                joined = len(out) > first and text[out[-1][1] : m.start()] == " "
                out.append((out.pop()[0] if joined else m.start(), m.start() + len(word), "person"))
        if kind:
            out.append((a, b, kind))
        last = b
    return out


def canonical(kind: str, value: str) -> str:
    """What all mentions of an entity share."""
    if kind == "email":
        return value.lower()
    if kind == "ipv6":
        return IPv6Address(value).exploded
    if kind in {"mac", "iban"}:
        plain = re.sub(r"[ :-]", "", value)
        return plain.lower() if kind == "mac" else plain
    if kind in {"card", "ssn", "phone"}:
        return "+" * value.startswith("+") + "".join(str(int(c)) for c in value if c.isdecimal())
    return value


def parts_of_mention(kind: str, value: str, cast: Cast) -> list[tuple[int, int, str, str]]:
    """The entities of a mention: start, end, kind and canonical value. A person is a surname and any given names, whose kinds tell gender and script."""
    if kind != "person":
        return [(0, len(value), kind, canonical(kind, value))]
    (who, names), (given, surnames), out = parsed(value), cast, []
    for k, m in enumerate(names):
        word, is_last = m[0].casefold(), k == len(names) - 1
        if is_last if who else word not in given or (is_last and word in surnames):
            gender, script = (who or surnames[word])[0], script_of(word)
            out.append((*m.span(), f"surname {'n' if script == 'latin' else gender} {script}", word))
        else:
            gender, script = (who if who and who[0] != "n" else given.get(word, who))[0], script_of(word)
            out.append((*m.span(), f"given {gender} {script}", word))
    return out


def in_format(kind: str, made: str, value: str) -> str:
    """A canonical surrogate in the format of a mention."""
    if kind.startswith(("given ", "surname ")):
        return made.upper() if value.isupper() else made.title()
    if kind == "email":
        return made[: -len(value)] + "".join(c.upper() if v.isupper() else c for c, v in zip(made[-len(value) :], value, strict=True))
    if kind == "ipv6":
        before, gap, after = value.partition("::")
        groups, left, right_ = made.split(":"), before.split(":") if before else [], after.split(":") if after else []
        written = lambda old, new: [(n.upper() if o != o.lower() else n)[-max(len(o), len(n.lstrip("0"))) :] for o, n in zip(old, new, strict=True)]
        return ":".join(written(left, groups[: len(left)])) + gap + ":".join(written(right_, groups[len(groups) - len(right_) :]))
    if kind in {"mac", "iban", "card", "ssn", "phone"}:
        chars = iter(made.upper() if kind == "mac" and value != value.lower() else made.lstrip("+"))
        return "".join([next(chars) if c.isalnum() else c for c in value]) + "".join(chars)
    return made


def render(kind: str, value: str, cast: Cast, known: Callable[[str, str], str]) -> str:
    """A mention with surrogates for its entities; known gives a surrogate by kind and canonical value."""
    out, last = [], 0
    for a, b, part, entity in parts_of_mention(kind, value, cast):
        out += [value[last:a], in_format(part, known(part, entity), value[a:b])]
        last = b
    return "".join([*out, value[last:]])


class Stream:
    """Numbers that follow from a key, a kind, an entity and an attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed = blake2b(f"{kind}\0{attempt}\0{value}".encode("utf-8", "surrogatepass"), key=key[:64], digest_size=32).digest()
        self.pool, self.turn = int.from_bytes(self.seed, "big"), 0

    def below(self, n: int) -> int:
        if self.pool < 1 << 64:
            self.turn += 1
            self.pool = int.from_bytes(blake2b(self.turn.to_bytes(8, "big"), key=self.seed, digest_size=64).digest(), "big")
        self.pool, out = divmod(self.pool, n)
        return out


@lru_cache(maxsize=1 << 12)
def letters_like(c: str) -> str:
    """The letters of the same case in the character's part (128 places) of the code table."""
    part = map(chr, range(ord(c) & ~0x7F, (ord(c) | 0x7F) + 1))
    return "".join(x for x in part if x.isalpha() and x.isupper() == c.isupper() and x.islower() == c.islower() and len(x.lower()) == len(x.upper()) == 1) or c


def same_shape(value: str, stream: Stream, hexadecimal: bool = False) -> str:
    """Digits for digits and letters for letters of the same case and script; the rest stays."""
    out = []
    for c in value:
        if hexadecimal and c in "0123456789abcdefABCDEF":
            h = "0123456789abcdef"[stream.below(16)]
            out.append(h.upper() if c.isupper() else h)
        elif c.isdecimal():
            out.append(chr(ord(c) - int(c) + stream.below(10)))
        elif c.isalpha():
            some = letters_like(c)
            out.append(some[stream.below(len(some))])
        else:
            out.append(c)
    return "".join(out)


def iban_rest(value: str) -> int:
    """Of an IBAN without blanks the remainder by 97, which is 1 if its check digits are right."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def luhn(digits: str) -> int:
    """The sum that is a multiple of 10 for right card numbers."""
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits)))


#: After so many attempts in vain, which a format with too few values left takes, surrogates grow longer by one character (addresses don't; names grow with each attempt).
PATIENCE = 8


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The attempt-th surrogate of an entity; never the entity itself."""
    if kind == "person":
        return render(kind, value, cast_of(value, [(0, len(value), kind)]), lambda k, v: surrogate(key, k, v, attempt))
    name = kind.startswith(("given ", "surname "))
    stream, longer = Stream(key, kind, value, attempt), attempt if name else attempt // PATIENCE
    while True:
        made = derive(kind, value if name else "0" * longer + value if kind == "email" else value if kind in {"ip", "ipv6"} else value + "0" * longer, stream, longer)
        if made != value:
            return made


def derive(kind: str, value: str, stream: Stream, longer: int = 0) -> str:
    if kind == "email":
        local, _, domain = value.rpartition("@")
        name, _, top = domain.rpartition(".")
        return f"{same_shape(local, stream)}@{same_shape(name, stream)}.{top}"
    if kind == "ip":
        return ".".join(str(1 + stream.below(254)) for _ in range(4))
    if kind == "mac":
        return same_shape(value, stream, hexadecimal=True)
    if kind == "ipv6":  # groups of zeros stay, others keep their number of digits
        groups = [g.lstrip("0") for g in value.split(":")]
        return ":".join(("" if not g else "123456789abcdef"[stream.below(15)] + same_shape(g[1:], stream, hexadecimal=True)).rjust(4, "0") for g in groups)
    if kind == "iban":
        made = value[:2] + same_shape(value[2:], stream)
        return made[:2] + f"{98 - iban_rest(made[:2] + '00' + made[4:]):02d}" + made[4:] if iban_rest(value) == 1 or longer else made
    if kind == "phone":
        country = COUNTRY.match(value)
        at = country.end() if country else 0
        return value[:at] + same_shape(value[at:], stream)
    if kind == "card":
        made = value[0] + same_shape(value[1:], stream)
        digits, new = re.sub(r"\D", "", value), re.sub(r"\D", "", made)
        for last in range(10):
            if (luhn(new[:-1] + str(last)) % 10 == 0) == (luhn(digits) % 10 == 0):
                return made[:-1] + str(last)
    if kind == "secret":
        lead = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-", value)
        at = lead.end() if lead else 0
        return value[:at] + same_shape(value[at:], stream, hexadecimal=bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)))
    if kind.startswith(("given ", "surname ")):
        role, *who = kind.split(" ")
        syllables = SYLLABLES[who[1]]
        made = "".join(syllables[stream.below(len(syllables))] for _ in range(longer + (3 if role == "surname" else 1)))
        tails, names = ENDS.get(tuple(who), ()), GIVEN[tuple(who)]
        if role == "surname":
            return made + tails[stream.below(len(tails))]
        return names[stream.below(len(names))].lower() + (f"-{made}" if longer else "")
    return same_shape(value, stream)


def entities(suspects: DataFrame, text: str, key: str) -> DataFrame:
    """key, kind and canonical value of all entities; within a task, equal rows go out once."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = set()
            for k, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                found = spans(t)
                cast = cast_of(t, found)
                rows.update((k, part, entity) for a, b, kind in found for _, _, part, entity in parts_of_mention(kind, t[a:b], cast))
            if not rows:
                return None
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*sorted(rows), strict=True)], ["key", "kind", "value"])

        return step

    return map_rows(suspects.select(key, text), "key string, kind string, value string", make)


def surrogates(found: DataFrame, secret: bytes, rounds: int = 40) -> DataFrame:
    """kind, value, surrogate of all distinct entities, no surrogate occurring twice or being an original."""

    def derived(df: DataFrame) -> DataFrame:
        def make():
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                kind, value, attempt = (c.to_pylist() for c in batch.columns)
                return pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(surrogate, [secret] * len(kind), kind, value, attempt), pa.string())], ["kind", "value", "attempt", "surrogate"])

            return step

        return map_rows(df.select("kind", "value", "attempt"), "kind string, value string, attempt int, surrogate string", make)

    values = found.select("kind", "value").distinct().withColumn("attempt", F.lit(0))
    done = stored(derived(values), "pii-surrogates")
    originals = done.select(F.col("value").alias("surrogate")).distinct()
    for _ in range(rounds):
        first = done.groupBy("surrogate").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "kind", "value")).alias("first")).filter("n > 1").drop("n")
        clash = done.join(first, "surrogate").filter(F.struct("attempt", "kind", "value") != F.col("first")).select("kind", "value")
        again = stored(clash.union(done.join(originals, "surrogate", "left_semi").select("kind", "value")).distinct(), "pii-clashes")
        if again.isEmpty():
            return done.drop("attempt")
        retry = derived(done.join(again, ["kind", "value"]).withColumn("attempt", F.col("attempt") + 1))
        done = stored(done.join(again, ["kind", "value"], "left_anti").union(retry.select(done.columns)), "pii-surrogates")
    raise RuntimeError(f"surrogates still clash after {rounds} rounds")


def replace(docs: DataFrame, secret: bytes, text: str = "text", count: str | None = "n_entities") -> DataFrame:
    """docs with every entity of the text replaced; count names a further column with the number replaced, unless it is None."""
    names = docs.columns
    key, pairs, number = (free(f"__pii_{x}", names) for x in ("key", "map", "count"))
    suspected = suspicious(F.col(text))
    suspects = docs.filter(suspected).withColumn(key, F.sha2(F.col(text).cast("binary"), 256))
    found = stored(entities(suspects, text, key).distinct(), "pii-found")
    said = surrogates(found, secret)
    by_text = found.join(said, ["kind", "value"]).groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "value"), "surrogate"))).alias(pairs))
    maps = stored(by_text.withColumnRenamed("key", key), "pii-maps")
    at = names.index(text)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            new, counts = [], []
            for t, pairs_of in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                known, parts, last, n = dict(pairs_of or ()), [], 0, 0
                found = spans(t) if known else []
                cast = cast_of(t, found)
                for a, b, kind in found:
                    parts += [t[last:a], render(kind, t[a:b], cast, lambda k, v: known[f"{k}:{v}"])]  # noqa: B023
                    last, n = b, n + 1
                new.append("".join([*parts, t[last:]]))
                counts.append(n)
            cols = [*batch.columns[:at], pa.array(new, pa.string()), *batch.columns[at + 1 : len(names)]]
            return pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], [*names, number])

        return step

    quoted = [F.col(f"`{c}`") for c in names]
    schema = ", ".join([*(f"`{c}` {k}" for c, k in docs.dtypes), f"`{number}` long"])
    changed = map_rows(suspects.join(maps, key, "left").select(*quoted, pairs), schema, make)
    out = docs.filter(~suspected).select(*quoted, F.lit(0).cast("long").alias(number)).union(changed)
    return out.withColumnRenamed(number, count) if count else out.drop(number)


def free(name: str, names: list[str]) -> str:
    """A column name that isn't taken, whatever the case of its letters."""
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name


#: The setting that holds the key, as text.
KEY = "spark.millrace.pii.key"


def key_of(spark: SparkSession) -> bytes:
    """The session's key; drawn at random where none is set."""
    if not (found := spark.conf.get(KEY, None)):
        found = secrets.token_hex(32)
        spark.conf.set(KEY, found)
    return found.encode()


def redact(docs: DataFrame, secret: bytes | None = None) -> DataFrame:
    """doc_id, text with surrogates, n_entities."""
    return replace(docs.select("doc_id", "text"), secret or key_of(docs.sparkSession))
