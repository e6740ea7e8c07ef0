"""AES in cipher-block chaining, in plain Python, for encrypted PDF files."""

from __future__ import annotations


def _doubled(x: int) -> int:
    return x << 1 ^ (0x11B if x & 0x80 else 0)


def _tables() -> tuple[bytes, bytes]:
    """The substitution box, from inverses in the field, and its inverse."""
    power, log, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= _doubled(x)
        x &= 0x1FF
    box = bytearray(256)
    for value in range(256):
        b = power[-log[value] % 255] if value else 0
        out = 0x63
        for shift in range(5):
            out ^= (b << shift | b >> 8 - shift) & 255
        box[value] = out
    back = bytearray(256)
    for i, b in enumerate(box):
        back[b] = i
    return bytes(box), bytes(back)


_BOX, _BACK = _tables()


def _times(factor: int) -> bytes:
    out = []
    for x in range(256):
        total, y, f = 0, x, factor
        while f:
            total ^= y if f & 1 else 0
            y, f = _doubled(y), f >> 1
        out.append(total)
    return bytes(out)


_T2, _T3, _T9, _T11, _T13, _T14 = map(_times, (2, 3, 9, 11, 13, 14))
_ROWS = [(i + 4 * (i % 4)) % 16 for i in range(16)]
_ROWS_BACK = [(i - 4 * (i % 4)) % 16 for i in range(16)]


def _round_keys(key: bytes) -> list[bytes]:
    n = len(key) // 4
    words = [key[i : i + 4] for i in range(0, len(key), 4)]
    constant = 1
    while len(words) < 4 * (n + 7):
        word = words[-1]
        if len(words) % n == 0:
            word = bytes(_BOX[b] for b in word[1:] + word[:1])
            word = bytes([word[0] ^ constant]) + word[1:]
            constant = _doubled(constant)
        elif n > 6 and len(words) % n == 4:
            word = bytes(_BOX[b] for b in word)
        words.append(bytes(a ^ b for a, b in zip(words[-n], word)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


def _xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(16, "big")


def _encrypt(block: bytes, keys: list[bytes]) -> bytes:
    s = _xor(block, keys[0])
    for k in keys[1:-1]:
        t = [_BOX[s[i]] for i in _ROWS]
        out = bytearray(16)
        for c in range(0, 16, 4):
            a, b, d, e = t[c : c + 4]
            out[c : c + 4] = bytes((_T2[a] ^ _T3[b] ^ d ^ e, a ^ _T2[b] ^ _T3[d] ^ e, a ^ b ^ _T2[d] ^ _T3[e], _T3[a] ^ b ^ d ^ _T2[e]))
        s = _xor(out, k)
    return _xor(bytes(_BOX[s[i]] for i in _ROWS), keys[-1])


def _decrypt(block: bytes, keys: list[bytes]) -> bytes:
    s = _xor(block, keys[-1])
    for k in keys[-2:0:-1]:
        t = _xor(bytes(_BACK[s[i]] for i in _ROWS_BACK), k)
        out = bytearray(16)
        for c in range(0, 16, 4):
            a, b, d, e = t[c : c + 4]
            out[c : c + 4] = bytes((_T14[a] ^ _T11[b] ^ _T13[d] ^ _T9[e], _T9[a] ^ _T14[b] ^ _T11[d] ^ _T13[e], _T13[a] ^ _T9[b] ^ _T14[d] ^ _T11[e], _T11[a] ^ _T13[b] ^ _T9[d] ^ _T14[e]))
        s = bytes(out)
    return _xor(bytes(_BACK[s[i]] for i in _ROWS_BACK), keys[0])


def cbc_decrypt(key: bytes, start: bytes, data: bytes) -> bytes:
    """Whole blocks, padding kept."""
    keys, out = _round_keys(key), []
    for i in range(0, len(data) - 15, 16):
        block = data[i : i + 16]
        out.append(_xor(_decrypt(block, keys), start))
        start = block
    return b"".join(out)


def cbc_encrypt(key: bytes, start: bytes, data: bytes) -> bytes:
    """Whole blocks, without padding."""
    keys, out = _round_keys(key), []
    for i in range(0, len(data) - 15, 16):
        start = _encrypt(_xor(data[i : i + 16], start), keys)
        out.append(start)
    return b"".join(out)
