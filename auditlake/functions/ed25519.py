"""ed25519 signatures as RFC 8032 defines them, for the few that are picked for it; about two milliseconds each."""

from __future__ import annotations

import hashlib

_P = 2**255 - 19
_ORDER = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P
_ROOT = pow(2, (_P - 1) // 4, _P)


def _point(data: bytes) -> tuple[int, int] | None:
    y = int.from_bytes(data, "little")
    sign, y = y >> 255, y & ((1 << 255) - 1)
    if y >= _P:
        return None
    square = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(square, (_P + 3) // 8, _P)
    if (x * x - square) % _P:
        x = x * _ROOT % _P
    if (x * x - square) % _P or (x == 0 and sign):
        return None
    return (_P - x if x & 1 != sign else x), y


def _add(a: tuple, b: tuple) -> tuple:
    """Sum of two points in extended coordinates (x, y, z, xy / z)."""
    m, n = (a[1] - a[0]) * (b[1] - b[0]) % _P, (a[1] + a[0]) * (b[1] + b[0]) % _P
    t, z = 2 * a[3] * b[3] * _D % _P, 2 * a[2] * b[2] % _P
    e, f, g, h = n - m, z - t, z + t, n + m
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(n: int, point: tuple[int, int]) -> tuple:
    out, step = (0, 1, 1, 0), (*point, 1, point[0] * point[1] % _P)
    while n:
        if n & 1:
            out = _add(out, step)
        step, n = _add(step, step), n >> 1
    return out


_BASE = _point((4 * pow(5, -1, _P) % _P).to_bytes(32, "little"))


def verify(message: bytes, public_key: bytes, signature: bytes) -> bool:
    if len(public_key) != 32 or len(signature) != 64:
        return False
    key, r, s = _point(public_key), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if key is None or r is None or s >= _ORDER:
        return False
    h = int.from_bytes(hashlib.sha512(signature[:32] + public_key + message).digest(), "little") % _ORDER
    a, b = _times(s, _BASE), _add((*r, 1, r[0] * r[1] % _P), _times(h, key))
    return (a[0] * b[2] - b[0] * a[2]) % _P == 0 and (a[1] * b[2] - b[1] * a[2]) % _P == 0


def _packed(point: tuple) -> bytes:
    inverse = pow(point[2], -1, _P)
    x, y = point[0] * inverse % _P, point[1] * inverse % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _keys(seed: bytes) -> tuple[int, bytes]:
    """The secret number and the rest of a seed's digest."""
    digest = hashlib.sha512(seed).digest()
    return int.from_bytes(digest[:32], "little") & ((1 << 254) - 8) | 1 << 254, digest[32:]


def public_key(seed: bytes) -> bytes:
    """The public key of a secret seed of 32 bytes."""
    return _packed(_times(_keys(seed)[0], _BASE))


def sign(message: bytes, seed: bytes) -> bytes:
    secret, prefix = _keys(seed)
    key = _packed(_times(secret, _BASE))
    number = lambda data: int.from_bytes(hashlib.sha512(data).digest(), "little") % _ORDER
    r = number(prefix + message)
    point = _packed(_times(r, _BASE))
    return point + ((r + number(point + key + message) * secret) % _ORDER).to_bytes(32, "little")
