"""Personal data: anchors found by an Aho-Corasick automaton, expanded by local parsers.

One pass of the automaton over a text finds at-signs, plus signs, digits, URL schemes and identifier
cues. A parser of each kind expands its anchor to the left and right and validates what it has found.
Every parser looks at the characters around its anchor only, so the work is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship

#: Kinds in their order: the base ones, then those that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "address")

# Cue words that announce an identifier, and words that end a street's name.
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "token", "secret", "password", "api_key", "apikey", "api key")
STREET_WORDS = ("street", "avenue", "boulevard", "strasse", "straße")
# More words of streets, by where name and number stand, and German words that only look like streets.
ENDS_CAPITAL = ("Road", "Lane", "Drive")
SUFFIXES = ("strasse", "straße", "str.", "allee", "gasse", "weg", "platz")
RUES = ("rue", "avenue", "boulevard", "place", "chemin", "allée", "impasse", "quai", "route")
CALLES = ("calle", "avenida", "plaza", "paseo", "carretera", "camino", "C/", "Avda.")
NO_STREETS = frozenset("Arbeitsplatz Ausweg Bauplatz Fahrweg Heimweg Hinweg Lehrplatz Parkplatz Radweg Rückweg Seeweg Sitzplatz Spielplatz Sportplatz Startplatz Stehplatz Stellplatz Studienplatz Umweg Speicherplatz Tabellenplatz".split())
NO_NAMES = frozenset("Auf Das Dem Den Der Des Die Diese Dieser Eine Einer Ihre In Jede Keine Meine Seine Unsere Zur".split())
# Lengths of IBANs.
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
    "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}
SCHEMES = ("http://", "https://", "ftp://")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"'`|]+")
#: After an account cue: up to 12 characters of assignment, then an identifier in word characters.
ACCOUNT = re.compile(r"(?:[ ]?(?:number|no\.?|id))?[ ]?[:=#][ ]?[\"']?(?P<id>[A-Za-z0-9][A-Za-z0-9_/+-]{6,})")
#: The same with a space, "number" or "no." as the separator; what follows is tried by ``looks_private``.
SPACED = re.compile(r"(?:[ ]?(?i:number|no\.?|nr\.?|id)[ ]|[ ]?(?i:no\.|nr\.)|[ ](?:(?i:is)[ ])?)(?P<id>[A-Za-z0-9][A-Za-z0-9_/+-]{6,}+)(?!\w)")
#: Dates, spans of years, and numbers with words hung on to them, as prose has them behind a cue.
PROSE = re.compile(r"[0-9]{4}[-/][0-9]{1,4}(?:[-/][0-9]{1,2})?|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}|[0-9]{1,4}[a-z]*(?:-[a-z]+)+|[0-9]{1,4}[a-z]+")
#: Behind the cue iban: separators, then the country, check digits and what may belong to it.
IBAN = re.compile(r"(?:[ ]?(?i:number|no\.?|nr\.?))?[ ]?[:=#]?[ ]?[\"']?(?P<id>[A-Za-z]{2}[0-9]{2}(?:[ ]?[A-Za-z0-9]){11,44}+)")
#: Behind the cue ssn: area, group and serial number. Forms of passport numbers.
SSN = re.compile(r"(?:[ ]?(?i:number|no\.?|is))?[ ]?[:=#]?[ ]?(?P<id>(?P<area>[0-9]{3})(?P<dash>-?)(?P<group>[0-9]{2})(?P=dash)(?P<serial>[0-9]{4}))(?![0-9-])")
PASSPORT = re.compile(r"[A-Z]{0,2}[0-9]{6,9}[A-Z]?|(?=(?:[A-Z]*[0-9]){4})[A-Z0-9]{8,9}", re.I)
#: Before a street word: a house number and one to three capitalised words.
STREET = re.compile(r"[0-9]{1,5}[A-Za-z]?(?: [A-ZÄÖÜÉ][\w'-]*){1,3} $")
#: Words before a street word that can belong to its address, with one more for what stands before them.
STREET_REACH = 6
#: A house number behind a name; the end of a name that a suffix hangs on to, or that stands before it.
HOUSE = re.compile(r" (?P<n>[0-9]{1,4}[A-Za-z]?)(?![\w%]|[.,:][0-9])")
COMPOUND = re.compile(r"[A-ZÄÖÜ][A-Za-zÄÖÜäöüßé-]+$")
NAME_BEFORE = re.compile(r"(?P<name>[A-ZÄÖÜ][A-Za-zÄÖÜäöüßé-]+)[ -]$")
_PARTS = r"(?:(?:de la|de las|de los|de l['’]|del|des|de|du|la|le|les|el|d['’]|l['’]) ?)?[A-ZÀ-ÖØ-Þ][\w'’-]*"
#: A number in front of a French street word; the name behind it. The name and number behind a Spanish one.
NUMBER_BEFORE = re.compile(r"[0-9]{1,4}(?: ?(?:bis|ter|quater|[A-Za-z]))?,? $")
RUE_NAME = re.compile(rf" {_PARTS}(?: {_PARTS}){{0,3}}")
CALLE_NAME = re.compile(rf" {_PARTS}(?: {_PARTS}){{0,3}},?(?: (?:n[.º°]{{1,2}}|núm\.|número))? [0-9]{{1,4}}[A-Za-z]?(?![\w%]|[.,:][0-9])")

REPLACEMENTS = {k: f"[{k.upper()}]" for k in KINDS}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def iban_end(text: str, start: int, most: int) -> int:
    """The end of the IBAN that starts here, with or without a space behind each group of four; 0 for none.

    It has its country's length, nothing alphanumeric behind it, and a remainder of 1 by 97.
    """
    wanted, taken, at = IBAN_LENGTHS.get(text[start : start + 2].upper(), 0), [], start
    while len(taken) < wanted and at < most:
        c = text[at]
        if c != " ":
            taken.append(c.upper())
        elif len(taken) % 4 or text[at - 1] == " ":
            return 0
        at += 1
    if not wanted or len(taken) < wanted or text[at : at + 1].isalnum():
        return 0
    return at if int("".join(str(int(c, 36)) for c in (*taken[4:], *taken[:4]))) % 97 == 1 else 0


def account_at(text: str, cue: str, end: int) -> tuple[int, int, bool] | None:
    """Start, end and validity of the identifier behind a cue that ends before ``end``."""
    if cue == "iban":
        m = IBAN.match(text, end)
        stop = m and iban_end(text, m.start("id"), m.end("id"))
        if stop:
            return m.start("id"), stop, True
        m = ACCOUNT.match(text, end)  # a number of another kind; what has an IBAN's country must be one
        other = m and m["id"][:2].isalpha() and m["id"][:2].upper() not in IBAN_LENGTHS and any("0" <= c <= "9" for c in m["id"])
        return (m.start("id"), m.end("id"), True) if other else None
    if cue == "ssn":
        m = SSN.match(text, end)
        return (m.start("id"), m.end("id"), True) if m and m["area"] not in ("000", "666") and m["area"] < "900" and m["group"] != "00" and m["serial"] != "0000" else None
    if m := ACCOUNT.match(text, end):
        return m.start("id"), m.end("id"), any("0" <= c <= "9" for c in m["id"]) and (cue != "passport" or PASSPORT.fullmatch(m["id"]) is not None)
    if (m := SPACED.match(text, end)) and any("0" <= c <= "9" for c in m["id"]) and not PROSE.fullmatch(m["id"]) and (cue != "passport" or PASSPORT.fullmatch(m["id"])):
        return m.start("id"), m.end("id"), True
    return None


def address_floor(text: str, at: int, low: int) -> int:
    """The place from which an address before text[at] may start: some words back, however long they are."""
    for _ in range(STREET_REACH):
        at = text.rfind(" ", low, at)
        if at < 0:
            return low
    return at


def address_at(text: str, at: int, end: int, low: int) -> tuple[int, int] | None:
    """Start and end of the address around the street word text[at:end], not before ``low``."""
    word, before = text[at:end], text[low:at]
    free = lambda start: not (start and text[start - 1].isalnum())
    if text[end : end + 1].isalnum():
        return None
    if (word.lower() in STREET_WORDS or word in ENDS_CAPITAL) and (m := STREET.search(before)) and free(low + m.start()):
        return low + m.start(), end
    if word.lower() in SUFFIXES and (h := HOUSE.match(text, end)):
        if word[0].islower():
            if (m := COMPOUND.search(before)) and free(low + m.start()) and m[0] + word not in NO_STREETS:
                return low + m.start(), h.end()
        elif (m := NAME_BEFORE.search(before)) and free(low + m.start()) and m["name"] not in NO_NAMES:
            return low + m.start(), h.end()
    if word.lower() in RUES and before[-1:] == " " and (m := NUMBER_BEFORE.search(before)) and free(low + m.start()) and (n := RUE_NAME.match(text, end)):
        return low + m.start(), n.end()
    if (word in CALLES or word.lower() in CALLES) and free(at) and (n := CALLE_NAME.match(text, end)):
        return at, n.end()
    return None


def folded(text: str) -> str:
    """The text in small letters, each at its place: what the automaton reads."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton():
    """All anchors in small letters, for ``folded`` texts."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for word in SCHEMES:
        found.add_word(word, ("scheme", len(word)))
    for cue in ACCOUNT_CUES:
        found.add_word(cue, ("cue", len(cue)))
    for word in {x.lower() for x in (*ENDS_CAPITAL, *STREET_WORDS, *SUFFIXES, *RUES, *CALLES)}:
        found.add_word(word, ("street", len(word)))
    found.make_automaton()
    return found


def spans_of(text: str, anchors) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans in code points, by start and then by kind as listed.

    Within a kind spans don't overlap, and the leftmost wins.
    """
    found: list[tuple[int, int, str]] = []
    last = dict.fromkeys(KINDS, 0)  # end of the last match of a kind, valid or not
    ip_from = 0

    def take(kind: str, start: int, end: int, valid: bool) -> None:
        last[kind] = end
        if valid:
            found.append((start, end, kind))

    for end, (what, length) in anchors.iter(folded(text)):
        at = end + 1 - length
        if what == "digit":
            if at >= last["card"] and (m := CARD.match(text, at)):
                number = m[0].replace(" ", "").replace("-", "")
                take("card", at, m.end(), 14 <= len(number) <= 19 and luhn(number))
            if at >= last["ip"] and at >= ip_from:
                if m := IP.match(text, at):
                    take("ip", at, m.end(), all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")))
                else:  # a later start in this run of digits meets the same end
                    ip_from = DIGITS.match(text, at).end()
        elif what == "at":
            start, floor = at, last["email"]
            while start > floor and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                take("email", start, m.end(), True)
        elif what == "plus":
            if m := PHONE.match(text, at):
                take("phone", at, m.end(), 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15)
        elif what == "scheme":
            if at >= last["url"] and (m := URL.match(text, end + 1)) and not (at and text[at - 1].isalnum()):
                stop = end + 1 + len(m[0].rstrip(".,;:!?)]}"))
                take("url", at, stop, stop > end + 1)
        elif what == "cue":
            if at >= last["account"] and not (at and (text[at - 1].isalnum())) and (a := account_at(text, text[at : end + 1].lower(), end + 1)):
                take("account", *a)
        elif at >= last["address"] and (a := address_at(text, at, end + 1, address_floor(text, at, last["address"]))):
            take("address", *a, True)
    found.sort(key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return found


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced; spans that overlap become one with the first one's name."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], REPLACEMENTS[kind]]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and
    n_other for the spans that the method adds (url, account, address).

    Null texts count as empty: no spans, and the digest of the empty text. Texts are read whole. An
    empty table gives an empty result; other columns of ``docs`` are ignored.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = automaton()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                spans = spans_of(text or "", anchors)
                base = [x for x in spans if x[2] in BASE_KINDS]
                counts = [sum(x[2] == k for x in base) for k in BASE_KINDS]
                rows.append((doc_id, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base)))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_other"])

    ship(docs.sparkSession)
    schema = "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_other long"
    kind = docs.schema["doc_id"].dataType
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(find, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def redact_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span of the text replaced by its kind's name.

    n_chars, if there is such a column, becomes the length of the text in every row (null: 0). Null and
    empty texts stay as they are, long ones are read whole, equal texts get equal results, repeated rows
    stay, an empty table stays empty, and all other columns pass as they are.
    """

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        anchors = automaton()
        return texts.map(lambda t: t if not t else redact(t, spans_of(t, anchors)))

    ship(docs.sparkSession)
    out = docs.withColumn("text", redacted("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out
