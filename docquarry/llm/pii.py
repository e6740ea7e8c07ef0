"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, schemes, digit groups and identifier
cues. From each anchor a deterministic parser grows the span left and right, checks it and
reports exact bounds:

- email: local part, at-sign, host with a letter-only last label of two or more letters;
- url: a scheme with "://", or "www.", up to a delimiter; trailing punctuation is left out;
- ipv4: four numbers of 0 to 255 without leading zeros, not part of a longer dotted number;
- ipv6: groups of hexadecimal digits that the address parser accepts, eight or with "::";
- card: 13 to 19 digits, single blanks or hyphens between groups, first digit 3 to 6 or 2
  and a valid Luhn sum;
- account: 12 to 19 digits without a break that aren't a card; or a cue (account, acct, IBAN,
  SSN, passport, ...) followed by an identifier with at least five digits;
- iban: two letters, two check digits and 11 to 30 letters or digits whose sum mod 97 is 1;
- phone: "+" and 8 to 15 digits, with blanks, hyphens, dots or brackets between them;
- ssn: three, two and four digits with hyphens, in the ranges that are issued.

Where digits go on behind one blank, into another number, a phone ends at the blank before an
item of another kind, or else at the last blank that leaves it valid; a card or ssn is
any valid run between blanks.

Spans never overlap: the earlier start wins, then the longer span, then a kind that was checked
over an account that was only cued, then the kind's name.

Defined cases: NULL and empty texts give no rows; rows that repeat are reported one by one;
a NULL id is carried along, and ids may be of any type; an empty table gives no rows. Whole texts
are searched, of whatever length. The two columns are picked by exact name, and other columns, of
any name, take no part.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import fields, slices

CUES = ("account", "acct", "konto", "compte", "cuenta", "passport", "iban", "ssn", "social security", "tax id", "member id", "customer id", "patient id", "driver license", "licence no", "license no")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.!#$%&'*+/=?^_`{|}~-")
_HOST = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-")
_HEX = frozenset("0123456789abcdefABCDEF:.")
_DIGITS = frozenset("0123456789")
_URL_END = frozenset("\"'<>`{}|\\^")
_AFTER_CUE = re.compile(r"(?:[ \t]*+(?:no|nr|num|number|id|#)\b\.?)?[ \t]*+[:#=]?[ \t]*+([A-Za-z0-9](?:[A-Za-z0-9]|[ -](?=[A-Za-z0-9]*\d)){4,33})", re.IGNORECASE)
#: Parts between blanks that a card may have at most, and more characters than one has.
PIECES = 5
WIDEST = 40
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}")

Span = tuple[int, int, str]
_automata: list = []


def _automaton():
    if not _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for a in "0123456789":
            made.add_word("+" + a, ("phone", 2))
            for b in "0123456789":
                made.add_word(f"{a}.{b}", ("dots", 3))
                made.add_word(a + "-" + b, ("run", 3))
                for c in "0123456789":
                    made.add_word(a + b + c, ("run", 3))
        for c in "0123456789abcdefABCDEF":
            made.add_word(":" + c, ("hex", 2))
        for word, kind in (("@", "at"), ("://", "scheme"), ("www.", "www"), ("::", "hex")):
            made.add_word(word, (kind, len(word)))
        for cue in CUES:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                made.add_word(form, ("cue", len(form)))
        made.make_automaton()
        _automata.append(made)
    return _automata[0]


def _reach(text: str, at: int, step: int, allowed: frozenset) -> int:
    """The last position from at on, in steps, whose character is allowed; at - step if none."""
    n = len(text)
    while 0 <= at < n and text[at] in allowed:
        at += step
    return at - step


def _email(text: str, at: int) -> Span | None:
    start = _reach(text, at - 1, -1, _LOCAL)
    end = _reach(text, at + 1, 1, _HOST) + 1
    while start < at and text[start] in ".'`/{|}=?&!*":
        start += 1
    if start >= at or text[at - 1] == "." or ".." in text[start:at] or at - start > 64:
        return None
    while end > at + 1 and text[end - 1] in ".-":
        end -= 1
    labels = text[at + 1 : end].split(".")
    while len(labels) > 1 and not (len(labels[-1]) >= 2 and labels[-1].isalpha()):
        end -= len(labels.pop()) + 1
    if len(labels) < 2 or any(not x or x[0] == "-" or x[-1] == "-" or len(x) > 63 for x in labels):
        return None
    return start, end, "email"


def _url(text: str, start: int, after: int) -> Span | None:
    if not text[after : after + 1].isalnum():
        return None
    end = after
    while end < len(text) and not text[end].isspace() and text[end] not in _URL_END:
        end += 1
    counts = {c: text.count(c, after, end) for c in "()[]"}
    while end > after:
        last = text[end - 1]
        open_ = {")": "(", "]": "["}.get(last)
        if last not in ".,;:!?'*" and not (open_ and counts[open_] < counts[last]):
            break
        if open_:
            counts[last] -= 1
        end -= 1
    return start, end, "url"


def _scheme(text: str, at: int) -> tuple[int, int] | None:
    """Where the URL with its "://" at at begins, and where its scheme has ended."""
    start = at
    while start > 0 and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+-."):
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    return (start, at + 3) if at - start >= 2 else None


def _ipv4(text: str, at: int) -> Span | None:
    dotted = _DIGITS | {"."}
    start, end = _reach(text, at, -1, dotted), _reach(text, at, 1, dotted) + 1
    while start < end and text[start] == ".":
        start += 1
    while end > start and text[end - 1] == ".":
        end -= 1
    parts = text[start:end].split(".")
    if len(parts) != 4 or any(not p or len(p) > 3 or int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    if start and (text[start - 1].isalnum() or text[start - 1] == "_") or end < len(text) and (text[end].isalnum() or text[end] == "_"):
        return None
    return start, end, "ipv4"


def _ipv6(text: str, start: int, end: int) -> Span | None:
    """The address that all hexadecimal digits, colons and dots of text[start:end] are, but for the last dots."""
    while end > start and (text[end - 1] == "." or text[end - 1] == ":" and text[end - 2 : end] != "::"):
        end -= 1
    if not 4 <= end - start <= 45 or text.count(":", start, end) < 2 or start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
        return None
    try:
        ipaddress.IPv6Address(text[start:end])
    except ValueError:
        return None
    return start, end, "ipv6"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digit_run(text: str, at: int, extra: str, widest: int | None = None) -> tuple[int, int]:
    """Digits around at, with single characters of extra between digits, at most so many on either side."""
    start, end = at, at + 1
    least, n = (0, len(text)) if widest is None else (max(0, at - widest), min(len(text), at + widest))
    while start > least and (text[start - 1] in _DIGITS or start > 1 and text[start - 1] in extra and text[start - 2] in _DIGITS):
        start -= 1
    while end < n and (text[end] in _DIGITS or end + 1 < len(text) and text[end] in extra and text[end + 1] in _DIGITS):
        end += 1
    return start, end


def _bounded(text: str, start: int, end: int) -> bool:
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    return not (before.isalnum() or before == "_" or after.isalnum() or after == "_")


def _numbers(text: str, at: int, run: tuple[int, int] | None = None) -> list[Span]:
    """Cards, ssns and plain accounts around the digit at at; of several, find_private takes the
    first. run: the digits around at with single blanks and hyphens, if they are known."""
    start, end = _digit_run(text, at, "")
    if _bounded(text, start, end) and 12 <= end - start <= 19:
        digits = text[start:end]
        return [(start, end, "card" if len(digits) >= 13 and digits[0] in "23456" and luhn(digits) else "account")]
    # What reaches WIDEST is too long for either kind, so the run need not be known beyond it.
    start, end = (max(run[0], at - WIDEST), min(run[1], at + WIDEST)) if run else _digit_run(text, at, " -", WIDEST)
    first, past = _piece(text, at, start, end)
    starts, ends = [first], [past]
    while len(starts) < PIECES and starts[-1] > start:
        starts.append(_piece(text, starts[-1] - 2, start, end)[0])
    while len(ends) < PIECES and ends[-1] < end:
        ends.append(_piece(text, ends[-1] + 1, start, end)[1])
    found = []
    for low in starts:
        ssn, card = text[low + 3 : low + 4] == "-", text[low] in "23456"
        if ssn or card:
            for high in ends:
                # 11 characters, or 13 to 19 digits with two to four separators.
                if (ssn and high - low == 11 or card and 15 <= high - low <= 23) and _bounded(text, low, high) and (kind := _card_or_ssn(text[low:high])):
                    found.append((low, high, kind))
    return found


def _piece(text: str, at: int, start: int, end: int) -> tuple[int, int]:
    """The part of text[start:end] around at that is without blanks."""
    after = text.find(" ", at, end)
    return text.rfind(" ", start, at) + 1 or start, after if after >= 0 else end


def _card_or_ssn(shown: str) -> str | None:
    digits = re.sub("[ -]", "", shown)
    if 13 <= len(digits) <= 19 and len(set(shown) & set(" -")) == 1 and digits[0] in "23456" and luhn(digits) and re.fullmatch(r"\d{4}(?:[ -]\d{2,7}){2,4}", shown):
        return "card"
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", shown) and shown[:3] not in ("000", "666") and shown[0] != "9" and shown[4:6] != "00" and shown[7:] != "0000":
        return "ssn"
    return None


def _phone(text: str, at: int) -> Span | None:
    if at and (text[at - 1].isalnum() or text[at - 1] == "+"):
        return None
    end, digits, last, n, ends = at + 1, 0, at, len(text), []
    while end < n and (text[end] in _DIGITS or text[end] in " -.()/" and end - last <= 2):
        if text[end] in _DIGITS:
            if text[last] in _DIGITS and text[last + 1 : end] == " " and 8 <= digits <= 15:
                ends.append(last + 1)
            digits, last = digits + 1, end
            if digits > 15:
                break
        end += 1
    for end in ends:
        if any(found and found[0] == end + 1 for found in (_ipv4(text, end + 1), *_numbers(text, end + 1))):
            return at, end, "phone"
    if 8 <= digits <= 15 and not (last + 1 < n and text[last + 1].isalnum()):
        ends.append(last + 1)
    return (at, ends[-1], "phone") if ends else None


def iban_valid(compact: str) -> bool:
    turned = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _iban(text: str, at: int) -> Span | None:
    """An IBAN around the digits at at, the longest whose check sum holds. Of one in groups of
    four the first three digits in a row come after its first five characters."""
    for start in range(max(0, at - 5), at + 1):
        if not "A" <= text[start] <= "Z" or start and text[start - 1].isalnum():
            continue
        found = _IBAN.match(text, start)
        if found:
            for end in range(found.end(), start + 14, -1):
                if text[end - 1] != " " and not (end < len(text) and text[end].isalnum()) and iban_valid(text[start:end].replace(" ", "")):
                    return start, end, "iban"
    return None


def _cued(text: str, start: int, end: int) -> Span | None:
    if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
        return None
    found = _AFTER_CUE.match(text, end)
    if not found or sum(c in _DIGITS for c in found[1]) < 5 or found.end() < len(text) and text[found.end()].isalnum():
        return None
    return found.start(1), found.end(1), "account"


def find_private(text: str) -> list[Span]:
    """Spans (start, end, kind) in code points, in order. The time is in proportion to the text:
    a run of digits or of hexadecimal groups is read once, and a URL only where it can count."""
    spans: set[Span | None] = set()
    urls: dict[int, list[int]] = {}
    dots_done = run_done = hex_done = -1
    run = (0, 0)
    for last, (kind, length) in _automaton().iter(text):
        at = last - length + 1
        if kind == "at":
            spans.add(_email(text, at))
        elif kind == "scheme":
            found = _scheme(text, at)
            if found:
                urls.setdefault(found[0], []).append(found[1])
        elif kind == "www":
            if not at or not (text[at - 1].isalnum() or text[at - 1] in "/.@"):
                urls.setdefault(at, []).append(at + 4)
        elif kind == "dots":
            if at > dots_done:
                spans.add(_ipv4(text, at))
                dots_done = _reach(text, at, 1, _DIGITS | {"."})
        elif kind == "run":
            if at > run_done:
                if at >= run[1]:
                    run = _digit_run(text, at, " -")
                spans.update(_numbers(text, at, run))
                spans.add(_iban(text, at))
                run_done = _digit_run(text, at, "")[1] - 1
        elif kind == "hex":
            if at > hex_done:
                hex_done = _reach(text, at, 1, _HEX)
                spans.add(_ipv6(text, _reach(text, at, -1, _HEX), hex_done + 1))
        elif kind == "phone":
            spans.add(_phone(text, at))
        else:
            spans.add(_cued(text, at, last + 1))
    spans.discard(None)
    by_start: dict[int, list[Span]] = {}
    for span in spans:
        by_start.setdefault(span[0], []).append(span)
    kept: list[Span] = []
    reached = 0
    for start in sorted(by_start.keys() | urls.keys()):
        if start < reached:
            continue
        here = by_start.get(start, []) + [u for after in urls.get(start, ()) if (u := _url(text, start, after))]
        if here:
            kept.append(min(here, key=lambda s: (-s[1], s[2] == "account", s[2])))
            reached = kept[-1][1]
    return kept


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, kind, value) of every piece of personal data; bounds in code points."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, starts, ends, kinds, values = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for start, end, kind in find_private(text) if text else ():
                    ids.append(row)
                    starts.append(start)
                    ends.append(end)
                    kinds.append(kind)
                    values.append(text[start:end])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=[id_col, "start", "end", "kind", "value"])

    rows = fields(docs, __id=id_col, __text=text_col).withColumn("__text", F.col("__text").cast("string"))
    return rows.mapInArrow(search, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, start int, end int, kind string, value string")
