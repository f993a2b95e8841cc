"""Personal data: anchors found by an Aho-Corasick automaton, boundaries found by local parsers that expand them.

Anchors are at-signs, plus signs, digits, schemes' "://" and cue words (account, iban, token, …). Each parser reads on from
its anchor to where the item ends, checks it (parts, Luhn, mod 97, length) and never looks again at what it has passed, so
the time is in proportion to the text. Spans count code points, the end is exclusive.

Kinds, in the order that breaks ties of a start: email, ip, card and phone stand wherever their form does, leftmost and not
overlapping within a kind; a match that fails its check is dropped without another try. Four more need a cue or a scheme:
login (user:password of a URL), iban (cue, then a number that passes mod 97), account (cue, then 6 to 17 digits, or
the form of a social security number after its cue) and secret (cue, "=" or ":", then 16 or more characters, letters and
digits both).

Defined results: a null or empty text has no spans; a null doc_id stays null; rows are taken one by one, so repeated ids
and texts don't matter. Only doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import chunks

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account", "secret")

DIGIT = frozenset("0123456789")
LETTER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LABEL = DIGIT | LETTER | {"-"}
LOCAL = DIGIT | LETTER | set("._%+-")
PHONE = DIGIT | set(" ().-")
SECRET = DIGIT | LETTER | set("_+/=-")
AUTHORITY_END = frozenset(" \t\n\r\v\f/?#\"'<>")

#: Cue words, by the kind of what follows them.
CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "konto", "ssn"),
    "secret": ("token", "password", "passwd", "secret", "api_key", "apikey", "api-key"),
}


def automaton() -> ahocorasick.Automaton:
    """Every anchor with its (name, length); cues in lower case, capitalised and in upper case."""
    found = ahocorasick.Automaton()
    for anchor, name in [("@", "at"), ("+", "plus"), ("://", "scheme"), *((d, "digit") for d in sorted(DIGIT))]:
        found.add_word(anchor, (name, len(anchor)))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in (cue, cue.capitalize(), cue.upper()):
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def run_end(text: str, at: int, chars: frozenset[str]) -> int:
    """Where the run of chars that begins at the place ends."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign, beginning at floor or later: a local part, and two labels or more."""
    begin = at
    while begin > floor and text[begin - 1] in LOCAL:
        begin -= 1
    end = run_end(text, at + 1, LABEL)
    if begin == at or end == at + 1:
        return None
    labels = 1
    while text[end : end + 1] == "." and text[end + 1 : end + 2] in LABEL and end + 1 < len(text):
        end = run_end(text, end + 1, LABEL)
        labels += 1
    return (begin, end) if labels > 1 else None


def dotted(text: str, at: int) -> tuple[int, int, bool]:
    """The end of the digits at the place, the end of four parts of digits and dots (0: there are fewer), and whether each
    part is 255 at most."""
    first = end = run_end(text, at, DIGIT)
    parts = [text[at:end]]
    while len(parts) < 4:
        after = run_end(text, end + 1, DIGIT)
        if text[end : end + 1] != "." or after == end + 1:
            return first, 0, False
        parts.append(text[end + 1 : after])
        end = after
    return first, end, all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in parts)


def digit_chain(text: str, at: int, most: int = 19) -> tuple[int, str]:
    """The end of the digits at the place, single blanks or hyphens between them, and the first most + 1 of them."""
    digits, end, n = [text[at]], at + 1, len(text)
    while end < n:
        step = 1 if text[end] in DIGIT else 2 if text[end] in " -" and end + 1 < n and text[end + 1] in DIGIT else 0
        if not step:
            break
        end += step
        if len(digits) <= most:
            digits.append(text[end - 1])
    return end, "".join(digits)


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def phone(text: str, at: int) -> tuple[int, int] | None:
    """The number behind a plus sign: a digit, further characters, a digit; 9 to 15 digits in all."""
    if text[at + 1 : at + 2] not in DIGIT or at + 1 >= len(text):
        return None
    end = run_end(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGIT:
        end -= 1
    if end <= at + 3:
        return None
    return (at, end) if 9 <= sum(c in DIGIT for c in text[at:end]) <= 15 else None


def login(text: str, after: int) -> tuple[int, int] | None:
    """user:password before the last at-sign of a URL's authority, which begins at the place."""
    end, sign, colon, n = after, -1, -1, len(text)
    while end < n and text[end] not in AUTHORITY_END:
        if text[end] == "@":
            sign = end
        elif text[end] == ":" and colon < 0:
            colon = end
        end += 1
    return (after, sign) if after < colon < sign - 1 else None


def past(text: str, at: int, chars: str, most: int = 4) -> int:
    """The place behind up to most of the chars."""
    end = at
    while end < len(text) and end < at + most and text[end] in chars:
        end += 1
    return end


def iban(text: str, at: int) -> tuple[int, int] | None:
    """Two letters, two digits and 11 to 30 letters or digits, single blanks between them, with the right check digits. What
    follows may look like more of it, so the longest form that checks counts."""
    begin = past(text, at, " :=#")
    chars, ends, end = [], [], begin
    while end < len(text) and len(chars) < 34:
        step = 0 if text[end] in DIGIT or "A" <= text[end] <= "Z" else 1
        if step and not (text[end] == " " and end + 1 < len(text) and (text[end + 1] in DIGIT or "A" <= text[end + 1] <= "Z")):
            break
        chars.append(text[end + step])
        end += step + 1
        ends.append(end)
    form = "".join(chars)
    if not (form[:2].isalpha() and form[2:4].isdigit()):
        return None
    for n in range(len(form), 14, -1):
        if int("".join(str(int(c, 36)) for c in form[4:n] + form[:4])) % 97 == 1:
            return begin, ends[n - 1]
    return None


def account(text: str, at: int, cue: str) -> tuple[int, int] | None:
    """Digits behind the cue, with or without "no", "nr" or "number": 6 to 17, hyphens between them or none."""
    at = past(text, at, " :=#.")
    for word in ("number", "nummer", "no", "nr"):
        if text[at : at + len(word)].lower() == word:
            at = past(text, at + len(word), " :=#.")
            break
    end = run_end(text, at, DIGIT | {"-"})
    if text[end : end + 1] in LETTER and end < len(text):
        return None
    while end > at and text[end - 1] == "-":
        end -= 1
    parts = text[at:end].split("-")
    if cue == "ssn":
        return (at, end) if [len(p) for p in parts] == [3, 2, 4] else None
    return (at, end) if all(parts) and 6 <= sum(map(len, parts)) <= 17 else None


def secret(text: str, at: int) -> tuple[int, int] | None:
    """A value of 16 or more characters behind "=" or ":", in quotes or bare."""
    at = past(text, at, " \"'")
    if text[at : at + 1] not in ("=", ":"):
        return None
    at = past(text, at + 1, " \"'")
    end = run_end(text, at, SECRET)
    value = set(text[at:end])
    return (at, end) if end - at >= 16 and value & DIGIT and value & LETTER else None


def at_word(text: str, begin: int, end: int) -> bool:
    """The cue is a word of its own."""
    return not (begin and (text[begin - 1].isalnum() or text[begin - 1] == "_")) and not text[end : end + 1].isalnum()


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all items, in this order."""
    found: list[tuple[int, int, int]] = []
    passed = dict.fromkeys(("at", "ip", "card", *CUES), 0)

    def add(kind: str, span: tuple[int, int] | None) -> bool:
        if span:
            found.append((span[0], KINDS.index(kind), span[1]))
        return bool(span)

    for last, (name, size) in anchors.iter(text):
        if name == "digit":
            if last >= passed["card"]:
                passed["card"], digits = digit_chain(text, last)
                if 12 <= len(digits) <= 19 and luhn(digits):
                    add("card", (last, passed["card"]))
            if last >= passed["ip"]:
                first, end, fits = dotted(text, last)
                passed["ip"] = end or first
                if end and fits:
                    add("ip", (last, end))
        elif name == "at":
            if add("email", span := email(text, last, passed["at"])):
                passed["at"] = span[1]
        elif name == "plus":
            add("phone", phone(text, last))
        elif name == "scheme":
            add("login", login(text, last + 1))
        elif last >= passed[name] and at_word(text, last + 1 - size, last + 1):
            cue = text[last + 1 - size : last + 1].lower()
            span = secret(text, last + 1) if name == "secret" else iban(text, last + 1) if name == "iban" else account(text, last + 1, cue)
            if add(name, span):
                passed[name] = span[1]
    return sorted(found)


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each span, or group of overlapping ones, replaced by the kind of the first in brackets."""
    out, at = [], 0
    for start, kind, end in found:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SHAPE = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(SPAN)), ("redacted", pa.string())])


def personal_data(docs: DataFrame, redact: bool = False) -> DataFrame:
    """(doc_id, spans, redacted) of every row: spans as structs (kind, start, end) by start, then kind; redacted is the text
    with them replaced, null if not asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch, texts in chunks(batches):
            each = [spans(t, anchors) for t in texts]
            listed = pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in each], pa.list_(SPAN))
            left = [redacted(t, x) for t, x in zip(texts, each)] if redact else [None] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), listed, pa.array(left, pa.string())], schema=SHAPE)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return rows.mapInArrow(run, from_arrow_schema(SHAPE))


def of_kinds(found: str, kinds: tuple[str, ...]) -> Column:
    names = ", ".join(f"'{k}'" for k in kinds)
    return F.expr(f"filter({found}, x -> x.kind IN ({names}))")


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
