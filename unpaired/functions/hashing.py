"""Deterministic randomness: every draw is a hash of what it is drawn for."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO52 = float(1 << 52)


def hash52(*parts: Column | str | int) -> Column:
    """52 bits of the MD5 of the parts joined by colons, as a long."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


#: Constants of MD5: what is added in each step, rotations and words of its four rounds, and where it begins.
_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_WORDS = ((1, 0), (5, 1), (3, 5), (7, 0))
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def hash52_of(prefix: str, numbers: np.ndarray) -> np.ndarray:
    """:func:`hash52` of ``prefix`` and each of the whole ``numbers`` (0 or more), for many at once inside a task."""
    out = np.zeros(len(numbers), np.int64)
    width = np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), numbers, "right") + 1
    for digits in np.unique(width).tolist():
        rows = np.flatnonzero(width == digits)
        out[rows] = _hash52_of_width(f"{prefix}:".encode(), numbers[rows], digits)
    return out


def _hash52_of_width(prefix: bytes, numbers: np.ndarray, digits: int) -> np.ndarray:
    size = len(prefix) + digits
    if size > 55:
        raise ValueError("one block of MD5 holds 55 bytes")
    block = np.zeros((64, len(numbers)), np.uint8)
    block[: len(prefix)] = np.frombuffer(prefix, np.uint8)[:, None]
    rest = numbers
    for at in range(size - 1, len(prefix) - 1, -1):
        rest, digit = np.divmod(rest, 10)
        block[at] = digit + 48
    block[size] = 0x80
    block[56], block[57] = 8 * size & 0xFF, 8 * size >> 8
    part = block.reshape(16, 4, -1).astype(np.uint32)
    words = part[:, 0] | part[:, 1] << 8 | part[:, 2] << 16 | part[:, 3] << 24
    a, b, c, d = (np.full(len(numbers), x, np.uint32) for x in _BEGIN)
    for i in range(64):
        turn, (step, first) = i // 16, _WORDS[i // 16]
        mixed = _mix(turn, b, c, d)
        mixed += a
        mixed += _ADDED[i]
        mixed += words[(step * i + first) % 16]
        left = _TURNS[turn][i % 4]
        a, d, c, b = d, c, b, b + (mixed << left | mixed >> (32 - left))
    a, b = ((x + np.uint32(y)).byteswap().astype(np.int64) for x, y in ((a, _BEGIN[0]), (b, _BEGIN[1])))
    return a << 20 | b >> 12


def _mix(turn: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if turn == 0:
        return d ^ (b & (c ^ d))
    if turn == 1:
        return c ^ (d & (b ^ c))
    return b ^ c ^ d if turn == 2 else c ^ (b | ~d)


class Endings:
    """Texts made ready to be hashed behind many prefixes: :func:`hash52` of ``prefix + text`` for all of them at once.

    The four ways a text can lie in the words of a block of MD5 are laid out once; a prefix then only adds its own bytes.
    """

    #: Texts hashed at once, which stay in the cache of a core.
    BLOCK = 16_384

    def __init__(self, texts: list[bytes]) -> None:
        self.size = len(texts)
        length = np.array([len(x) for x in texts], np.int64)
        self.groups: list[tuple[int, np.ndarray, list[np.ndarray]]] = []
        for n in np.unique(length).tolist():
            rows = np.flatnonzero(length == n)
            own = np.frombuffer(b"".join(texts[i] for i in rows.tolist()), np.uint8).reshape(len(rows), n)
            laid = []
            for shift in range(4):
                block = np.zeros((len(rows), (shift + n) // 4 * 4 + 4), np.uint8)
                block[:, shift : shift + n] = own
                block[:, shift + n] = 0x80
                laid.append(np.ascontiguousarray(block.view("<u4").T))
            self.groups.append((n, rows, laid))
        self.buffers = [np.empty(self.BLOCK, np.uint32) for _ in range(6)]

    @staticmethod
    def fit(prefix: int, longest: int) -> bool:
        """Whether texts of up to ``longest`` bytes behind as many bytes of a prefix are hashed in one block."""
        return prefix + longest <= 55

    def hashed(self, prefixes: list[bytes]):
        """Blocks (first, places, hashes) of the texts behind ``prefixes`` of one length: some prefixes from the ``first`` on, each with all ``places``, one after another."""
        p = len(prefixes[0])
        heads = np.frombuffer(b"".join(x + bytes(-p % 4) for x in prefixes), "<u4").reshape(len(prefixes), -1)
        for n, rows, laid in self.groups:
            if p + n > 55:
                raise ValueError("one block of MD5 holds 55 bytes")
            many = max(1, self.BLOCK // len(rows))
            for first in range(0, len(prefixes), many):
                head = heads[first : first + many]
                for i in range(0, len(rows), self.BLOCK):
                    part = laid[p % 4][:, i : i + self.BLOCK]
                    yield first, rows[i : i + self.BLOCK], self._md5(self._words(head, part, p, n), len(head) * part.shape[1])

    @staticmethod
    def _words(head: np.ndarray, part: np.ndarray, p: int, n: int) -> list[int | np.ndarray]:
        """The 16 words of each block of MD5: a number where all are the same."""
        words: list[int | np.ndarray] = [0] * 16
        for j, x in enumerate(head.T):
            words[j] = int(x[0]) if (x == x[0]).all() else np.repeat(x, part.shape[1])
        for j, x in enumerate(part, p // 4):
            x = np.tile(x, len(head)) if len(head) > 1 else x
            words[j] = x if isinstance(words[j], int) and not words[j] else x | np.asarray(words[j], np.uint32)
        words[14] = 8 * (p + n)
        return words

    def _md5(self, words: list[int | np.ndarray], n: int) -> np.ndarray:
        *state, t, s = (x[:n] for x in self.buffers)
        a, b, c, d = state
        for x, begin in zip(state, _BEGIN, strict=True):
            x.fill(begin)
        for i in range(64):
            turn, (step, first) = i // 16, _WORDS[i // 16]
            word, left = words[(step * i + first) % 16], _TURNS[turn][i % 4]
            if turn < 2:
                x, y, z = (b, c, d) if turn == 0 else (d, b, c)
                np.bitwise_xor(y, z, out=t)
                np.bitwise_and(t, x, out=t)
                np.bitwise_xor(t, z, out=t)
            elif turn == 2:
                np.bitwise_xor(b, c, out=t)
                np.bitwise_xor(t, d, out=t)
            else:
                np.invert(d, out=t)
                np.bitwise_or(t, b, out=t)
                np.bitwise_xor(t, c, out=t)
            np.add(t, a, out=t)
            if isinstance(word, int):
                np.add(t, np.uint32(int(_ADDED[i]) + word & 0xFFFFFFFF), out=t)
            else:
                np.add(t, _ADDED[i], out=t)
                np.add(t, word, out=t)
            np.left_shift(t, np.uint32(left), out=s)
            np.right_shift(t, np.uint32(32 - left), out=t)
            np.bitwise_or(t, s, out=t)
            np.add(t, b, out=a)
            a, d, c, b = d, c, b, a
        a, b = ((x + np.uint32(y)).byteswap().astype(np.int64) for x, y in ((a, _BEGIN[0]), (b, _BEGIN[1])))
        return a << 20 | b >> 12


def uniform(*parts: Column | str | int) -> Column:
    """A number strictly between 0 and 1."""
    return (hash52(*parts) + 0.5) / TWO52


def sha1_order(seed: int, u: Column, v: Column) -> Column:
    return F.sha1(F.concat_ws(":", F.lit(str(seed)), u, v).cast("binary"))


def parity(seed: int, key: Column) -> Column:
    """0 or 1: the parity of the last hex digit of a SHA-1."""
    digit = F.substring(F.sha1(F.concat_ws(":", F.lit(str(seed)), key).cast("binary")), 40, 1)
    return F.conv(digit, 16, 10).cast("int") % 2


def fold(seed: int, folds: int, *parts: Column) -> Column:
    return (hash52(seed, *parts) % folds).cast("int")
