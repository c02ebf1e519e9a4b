"""SHA-256 of many short messages of one length at once: an array element a message."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import isqrt

import numpy as np

_M = 0xFFFFFFFF
_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]


def _cube_root(n: int) -> int:
    x = 1 << -(-n.bit_length() // 3)
    while x**3 > n:
        x = (2 * x + n // (x * x)) // 3
    return x


_START = tuple(isqrt(p << 64) & _M for p in _PRIMES[:8])
_ROUND = [_cube_root(p << 96) & _M for p in _PRIMES]
_BY = [np.array(k, np.uint32) for k in range(32)]


def _parts(x, turns: tuple, shift: int | None) -> int:
    """The turns to the right of a number, and its shift, by exclusive or."""
    out = 0 if shift is None else x >> shift
    for k in turns:
        out ^= (x >> k | x << (32 - k)) & _M
    return out


def _mixed(x, right: tuple, left: tuple, r, l) -> None:  # noqa: E741
    """r := the exclusive or of x shifted to the right by three distances and to the left by others.  ``right``
    and ``left`` hold the steps between distances, so that every step works in place."""
    np.right_shift(x, _BY[right[0]], r)
    for k in right[1:]:
        np.bitwise_xor(r, x, r)
        np.right_shift(r, _BY[k], r)
    np.left_shift(x, _BY[left[0]], l)
    for k in left[1:]:
        np.bitwise_xor(l, x, l)
        np.left_shift(l, _BY[k], l)
    np.bitwise_xor(r, l, r)


#: Turns by 6, 11, 25 and by 2, 13, 22; turns by 7, 18 and 17, 19 with a shift by 3 and by 10.
_SUM1, _SUM0 = ((14, 5, 6), (5, 14, 7)), ((9, 11, 2), (11, 9, 10))
_LOW0, _LOW1 = ((11, 4, 3), (11, 14)), ((2, 7, 10), (2, 13))


def _shared(state, word: int, t: int) -> list:
    """A round of numbers.  With the word 0: what the state is but for the word, added to its a and e."""
    a, b, c, d, e, f, g, h = state
    t1 = h + _parts(e, (6, 11, 25), None) + (e & f ^ ~e & _M & g) + _ROUND[t] + word
    return [(t1 + _parts(a, (2, 13, 22), None) + (a & b ^ a & c ^ b & c)) & _M, a, b, c, (d + t1) & _M, e, f, g]


@lru_cache(maxsize=1)
def _room(n: int) -> list:
    """Arrays for 16 words, the state, and three between; each begins at a cache line."""
    each = -(-n // 16) * 16 + 16
    raw = np.empty(27 * each + 16, np.uint32)
    begin = -raw.ctypes.data % 64 // 4
    return [raw[begin + k * each : begin + k * each + n] for k in range(27)]


def _scheduled(w: list, t: int, free: list, r, l) -> None:  # noqa: E741
    """w[t % 16] := the t-th word of the schedule; words are numbers while no message differs in them."""
    known, arrays = 0, []
    for k, mix, turns, shift in ((t, None, (0,), None), (t + 9, None, (0,), None), (t + 1, _LOW0, (7, 18), 3), (t + 14, _LOW1, (17, 19), 10)):
        word = w[k % 16]
        if isinstance(word, int):
            known += _parts(word, turns, shift)
        else:
            arrays.append((word, mix))
    known &= _M
    out = w[t % 16]
    if isinstance(out, int):
        if not arrays:
            w[t % 16] = known
            return
        out = w[t % 16] = free[t % 16]
        out.fill(known)
    else:
        del arrays[0]
        if known:
            np.add(out, np.array(known, np.uint32), out)
    for word, mix in arrays:
        if mix:
            _mixed(word, *mix, r, l)
            word = r
        np.add(out, word, out)


def _compressed(start, block: list, n: int, last: bool) -> list:
    """The state (its first word alone after the last block) after a block of 16 words, of which numbers are the
    same in all n messages."""
    room = _room(n)
    w, state, t, first = list(block), list(start), 0, None
    for k, x in enumerate(block):
        if not isinstance(x, int):
            w[k] = room[k]
            w[k][:] = x
    if isinstance(state[0], int):
        while isinstance(w[t], int):
            state = _shared(state, w[t], t)
            t += 1
        state, first = _shared(state, 0, t), w[t]
        t += 1
    for k, x in enumerate(state):
        room[16 + k][:] = x
    a, b, c, d, e, f, g, h, r, l, bc = room[16:]  # noqa: E741
    if first is not None:
        np.add(a, first, a)
        np.add(e, first, e)
    np.bitwise_xor(b, c, bc)
    for t in range(t, 64):  # noqa: B020
        if t > 15:
            _scheduled(w, t, room, r, l)
        word = w[t % 16]
        if isinstance(word, int):
            np.add(h, np.array((word + _ROUND[t]) & _M, np.uint32), h)
        else:
            np.add(h, word, h)
            np.add(h, np.array(_ROUND[t], np.uint32), h)
        _mixed(e, *_SUM1, r, l)
        np.add(h, r, h)
        np.bitwise_xor(f, g, r)
        np.bitwise_and(r, e, r)
        np.bitwise_xor(r, g, r)
        np.add(h, r, h)
        np.add(d, h, d)
        _mixed(a, *_SUM0, r, l)
        np.add(h, r, h)
        np.bitwise_xor(a, b, l)
        np.bitwise_and(bc, l, bc)
        np.bitwise_xor(bc, b, bc)
        np.add(h, bc, h)
        bc, l = l, bc  # noqa: E741
        a, b, c, d, e, f, g, h = h, a, b, c, d, e, f, g
    return [x + (np.uint32(s) if isinstance(s, int) else s) for x, s in zip((a,) if last else (a, b, c, d, e, f, g, h), start)]


def first_words(message: list, n: int) -> np.ndarray:
    """The first 32 bits of the SHA-256 of n messages of one length.  ``message`` has an entry a byte: a number
    where all messages have the same, an array (uint32) of each message's otherwise."""
    size = len(message)
    message = [*message, 0x80, *[0] * ((55 - size) % 64), *(8 * size).to_bytes(8, "big")]
    if all(isinstance(x, int) for x in message):
        return np.full(n, int(hashlib.sha256(bytes(message[:size])).hexdigest()[:8], 16), np.uint32)
    state = _START
    for at in range(0, len(message), 64):
        block = []
        for i in range(at, at + 64, 4):
            number = sum(x << (24 - 8 * k) for k, x in enumerate(message[i : i + 4]) if isinstance(x, int))
            arrays = [x << _BY[24 - 8 * k] for k, x in enumerate(message[i : i + 4]) if not isinstance(x, int)]
            word = arrays[0] if arrays else number
            for x in arrays[1:]:
                word |= x
            if arrays and number:
                word |= np.uint32(number)
            block.append(word)
        last = at + 64 == len(message)
        if all(isinstance(x, int) for x in (state[0], *block)):  # one message does for all
            state = [int(x[0]) for x in _compressed(state, [np.array([block[0]], np.uint32), *block[1:]], 1, last)]
        else:
            state = _compressed(state, block, n, last)
    return state[0]
