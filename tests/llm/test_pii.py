import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import pii


def kinds(text):
    return [(k, text[a:b]) for a, b, k in pii.find_private(text)]


CASES = [
    ("write to ada.l+x@mail.example.org, now", [("email", "ada.l+x@mail.example.org")]),
    ("no mail: a@b, @x.org, x@-a.org, a..b@x.org", []),
    ("see https://x.org/a?b=(c). Or www.site.co/path, ok", [("url", "https://x.org/a?b=(c)"), ("url", "www.site.co/path")]),
    ("host 192.168.0.12 and 256.1.1.1 and 1.2.3.4.5", [("ipv4", "192.168.0.12")]),
    ("at 2001:db8::ff00:42:8329 here", [("ipv6", "2001:db8::ff00:42:8329")]),
    ("card 4111 1111 1111 1111 or 4111111111111111 not 4111 1111 1111 1112", [("card", "4111 1111 1111 1111"), ("card", "4111111111111111")]),
    ("ssn 123-45-6789 and 000-12-3456", [("ssn", "123-45-6789")]),
    ("call +49 (0)30 1234-5678 today", [("phone", "+49 (0)30 1234-5678")]),
    ("IBAN DE89 3704 0044 0532 0130 00 please", [("iban", "DE89 3704 0044 0532 0130 00")]),
    ("account no: 1234567 was", [("account", "1234567")]),
    ("number 123456789012 there", [("account", "123456789012")]),
    ("plain words, 12 of 345 and 2024-01-31", []),
]


@pytest.mark.parametrize("text, expected", CASES)
def test_kinds_and_bounds(text, expected):
    assert kinds(text) == expected


@pytest.mark.parametrize("filler", ["", "ü", "日本 "])
def test_bounds_are_code_points(filler):
    text = f"{filler * 7}mail a@b.org!"
    (start, end, kind), = pii.find_private(text)
    assert text[start:end] == "a@b.org" and kind == "email"


def test_every_kind_is_found_wherever_it_stands():
    for text, expected in CASES:
        for before, after in (("x ", ""), ("\n", "\n"), ("words " * 500, " words" * 500)):
            assert kinds(before + text + after) == expected


def test_table(make):
    rows = [(1, "a@b.org and c@d.org"), (2, None), (3, ""), (None, "e@f.org"), (4, "g@h.org"), (4, "g@h.org"), (5, "x " * 200_000 + "i@j.org")]
    found = sorted(((r.doc_id, r.value, r.start) for r in pii.private_spans(make(rows, clash=True)).collect()), key=repr)
    assert found == sorted([(1, "a@b.org", 0), (1, "c@d.org", 12), (None, "e@f.org", 0), (4, "g@h.org", 0), (4, "g@h.org", 0), (5, "i@j.org", 400_000)], key=repr)
    assert pii.private_spans(make([])).count() == 0


BESIDE = [
    ("call +1 (826) 555-4081 190.137.223.204 now", [("phone", "+1 (826) 555-4081"), ("ipv4", "190.137.223.204")]),
    ("call +1 555 40 81 7 1.2.3.4 now", [("phone", "+1 555 40 81 7"), ("ipv4", "1.2.3.4")]),
    ("call +1 826 555 4081 4111 1111 1111 1111.", [("phone", "+1 826 555 4081"), ("card", "4111 1111 1111 1111")]),
    ("call +1 826 555 4081 123-45-6789.", [("phone", "+1 826 555 4081"), ("ssn", "123-45-6789")]),
    ("call +1 826 555 4081 123456789012.", [("phone", "+1 826 555 4081"), ("account", "123456789012")]),
    ("call +1 826 555 4081 3rd floor", [("phone", "+1 826 555 4081")]),
    ("row 12 123-45-6789", [("ssn", "123-45-6789")]),
    ("row 123-45-6789 12 of 345", [("ssn", "123-45-6789")]),
    ("row 123-45-6789 7th", [("ssn", "123-45-6789")]),
    ("row 7 4111 1111 1111 1111", [("card", "4111 1111 1111 1111")]),
    ("row 2024 7 4111-1111-1111-1111 9", [("card", "4111-1111-1111-1111")]),
    ("row 4111 1111 1111 1111 123-45-6789 x", [("card", "4111 1111 1111 1111"), ("ssn", "123-45-6789")]),
    ("row 12-123-45-6789 and 123-45-6789-1", []),
]


@pytest.mark.parametrize("text, expected", BESIDE)
def test_numbers_beside_numbers(text, expected):
    assert kinds(text) == expected


def brute(text):
    """Every parser at every place, without an automaton and without remembering what was read."""
    found = set()
    lower = {form for cue in pii.CUES for form in (cue, cue.upper(), cue.capitalize(), cue.title())}
    for at in range(len(text)):
        here = text[at:]
        if here[0] == "@":
            found.add(pii._email(text, at))
        if here.startswith("://") and (begun := pii._scheme(text, at)):
            found.add(pii._url(text, *begun))
        if here.startswith("www.") and not (at and (text[at - 1].isalnum() or text[at - 1] in "/.@")):
            found.add(pii._url(text, at, at + 4))
        if here[0] in pii._DIGITS:
            if here[1:2] == "." and here[2:3] in pii._DIGITS and here[2:3]:
                found.add(pii._ipv4(text, at))
            if pii.re.match("[0-9](-[0-9]|[0-9]{2})", here):
                found.update(pii._numbers(text, at))
                found.add(pii._iban(text, at))
        if here[0] == ":" and here[1:2] in pii._HEX - {"."} and here[1:2]:
            found.add(pii._ipv6(text, pii._reach(text, at, -1, pii._HEX), pii._reach(text, at, 1, pii._HEX) + 1))
        if here[0] == "+" and here[1:2] in pii._DIGITS and here[1:2]:
            found.add(pii._phone(text, at))
        for cue in lower:
            if here.startswith(cue):
                found.add(pii._cued(text, at, at + len(cue)))
    kept = []
    for span in sorted(found - {None}, key=lambda s: (s[0], -s[1], s[2] == "account", s[2])):
        if not kept or span[0] >= kept[-1][1]:
            kept.append(span)
    return kept


PARTS = [text for text, _ in CASES + BESIDE] + ["123-", "4111", " ", "-", "1 ", "::", "a:b:", "1.2.", "+49 ", "@", "x@", "http://", "www.", ")", "](", ".", "acct ", "IBAN ", "DE89370400440532013000", "é", "ssn: ", "7"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=9).map("".join))
def test_spans_equal_brute_force(text):
    assert pii.find_private(text) == brute(text)


LONG = ["123 ", "a:b:", "12-", "1.2.", "+1 826 ", "a@b.c ", "x@", "http://a", "www.a.", "1234", ":1", "acct  ", "DE12 ", "://(", "a.", "account no. : "]


@pytest.mark.parametrize("unit", LONG)
def test_the_time_is_in_proportion_to_the_text(unit):
    def seconds(n):
        text = unit * (n // len(unit)) + ")" * (n // 4) + " " * (n // 4) + "!"
        began = time.process_time()
        pii.find_private(text)
        return time.process_time() - began

    small = max(seconds(30_000), 0.02)
    assert seconds(240_000) < 30 * small
