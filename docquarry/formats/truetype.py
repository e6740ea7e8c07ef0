"""Sizes of glyphs in TrueType fonts, and digits told by them.

Some PDFs map their digits to NUL. A digit is then told by the box of its glyph: of all pairs of
a glyph and a digit the most alike are matched first, each glyph and each digit once."""

from __future__ import annotations

from struct import error, unpack_from

#: Widths and heights of the digits 0 to 9 of a common sans-serif face, at 2048 units an em.
_EM = 2048
_WIDE = "956 540 971 960 1014 972 968 949 966 964"
_TALL = "1497 1472 1472 1498 1466 1471 1497 1447 1497 1497"

Box = tuple[int, int]


def glyph_boxes(font: bytes, glyphs: list[int]) -> tuple[int, dict[int, Box]]:
    """Units an em, and (width, height) of those glyphs that have an outline's header; nothing is
    found in what isn't a TrueType font."""
    try:
        places = {tag: (at, size) for tag, _, at, size in (unpack_from(">4sIII", font, 12 + 16 * i) for i in range(unpack_from(">H", font, 4)[0]) if 28 + 16 * i <= len(font))}
        head, glyf = places[b"head"][0], places[b"glyf"]
        em, = unpack_from(">H", font, head + 18)
        wide, = unpack_from(">h", font, head + 50)
        count, = unpack_from(">H", font, places[b"maxp"][0] + 4)
        loca = places[b"loca"][0]
        starts = unpack_from(f">{count + 1}{'I' if wide else 'H'}", font, loca)
    except (KeyError, error):
        return 0, {}
    found = {}
    for glyph in glyphs:
        if 0 <= glyph < count:
            start = starts[glyph] * (1 if wide else 2)
            if start + 10 <= glyf[1] and glyf[0] + start + 10 <= len(font):
                left, low, right, high = unpack_from(">4h", font, glyf[0] + start + 2)
                found[glyph] = right - left, high - low
    return em, found


def digits_of(boxes: dict[int, Box], em: int) -> dict[int, int]:
    """Glyph to digit, at most one of each for the other; the least difference first, then the
    lesser glyph, then the lesser digit."""
    sizes = [(int(w) * em / _EM, int(h) * em / _EM) for w, h in zip(_WIDE.split(), _TALL.split())]
    pairs = sorted((abs(box[0] - w) + abs(box[1] - h), glyph, digit) for glyph, box in boxes.items() for digit, (w, h) in enumerate(sizes))
    found: dict[int, int] = {}
    left = set(range(10))
    for _, glyph, digit in pairs:
        if glyph not in found and digit in left:
            found[glyph] = digit
            left.discard(digit)
    return found
