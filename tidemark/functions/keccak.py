"""Keccak-256 with the original padding, for event signatures on the driver."""

from __future__ import annotations

_MASK = (1 << 64) - 1


def _constants() -> tuple[list[int], list[int]]:
    """Round constants from the degree-8 shift register, and rotations from the lane walk."""
    r, rounds = 1, []
    for _ in range(24):
        value = 0
        for j in range(7):
            if r & 1:
                value |= 1 << ((1 << j) - 1)
            r = (r << 1) ^ (0x171 if r >> 7 else 0)
        rounds.append(value)
    turns, x, y = [0] * 25, 1, 0
    for t in range(24):
        turns[x + 5 * y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return rounds, turns


_ROUNDS, _TURNS = _constants()


def _turn(v: int, n: int) -> int:
    return ((v << n) | (v >> (64 - n))) & _MASK if n else v


def _permute(a: list[int]) -> list[int]:
    for constant in _ROUNDS:
        c = [a[x] ^ a[x + 5] ^ a[x + 10] ^ a[x + 15] ^ a[x + 20] for x in range(5)]
        d = [c[x - 1] ^ _turn(c[(x + 1) % 5], 1) for x in range(5)]
        b = [0] * 25
        for x in range(5):
            for y in range(5):
                b[y + 5 * ((2 * x + 3 * y) % 5)] = _turn(a[x + 5 * y] ^ d[x], _TURNS[x + 5 * y])
        a = [b[i] ^ (~b[(i % 5 + 1) % 5 + i // 5 * 5] & b[(i % 5 + 2) % 5 + i // 5 * 5]) for i in range(25)]
        a[0] ^= constant
    return a


def keccak256(data: bytes) -> str:
    """Lower-case hex of the 256-bit digest."""
    rate = 136
    short = rate - len(data) % rate
    padded = bytearray(data + b"\x01" + b"\x00" * (short - 1))
    padded[-1] |= 0x80
    state = [0] * 25
    for at in range(0, len(padded), rate):
        for i in range(rate // 8):
            state[i] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        state = _permute(state)
    return b"".join(v.to_bytes(8, "little") for v in state[:4]).hex()


def signature(canonical: str) -> str:
    """Topic 0 of ``name(type,...)``, without a prefix."""
    if not canonical.strip():
        raise ValueError("a signature needs a text")
    return keccak256(canonical.encode())
