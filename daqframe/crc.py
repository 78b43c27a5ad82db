"""CRC-32C (Castagnoli) in numpy.

A long buffer is cut into lanes of equal length that advance together, two bytes a step, through one table of 65,536 entries. Lanes are then
joined pairwise: appending k zero bytes is a linear map of the 32-bit state, kept for each k as four byte tables.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

POLYNOMIAL = 0x82F63B78
SHORT = 1024


@lru_cache(maxsize=1)
def byte_table() -> list[int]:
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = (state >> np.uint32(1)) ^ (np.uint32(POLYNOMIAL) * (state & np.uint32(1)))
    return state.tolist()


@lru_cache(maxsize=1)
def pair_table() -> np.ndarray:
    one = np.array(byte_table(), np.uint32)
    state = np.arange(65536, dtype=np.uint32)
    for _ in range(2):
        state = one[state & np.uint32(255)] ^ (state >> np.uint32(8))
    return state


@lru_cache(maxsize=512)
def appending(zeros: int) -> np.ndarray:
    """Tables (4, 256) of what each byte of a state becomes after so many zero bytes."""
    one = np.array(byte_table(), np.uint32)
    if zeros == 1:
        basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
        basis = one[basis & np.uint32(255)] ^ (basis >> np.uint32(8))
    else:
        half = appending(zeros // 2)
        basis = apply_tables(half, apply_tables(half, np.uint32(1) << np.arange(32, dtype=np.uint32)))
        if zeros % 2:
            basis = apply_tables(appending(1), basis)
    tables = np.zeros((4, 256), np.uint32)
    values = np.arange(256)
    for k in range(4):
        for bit in range(8):
            tables[k] ^= np.where(values >> bit & 1, basis[8 * k + bit], 0).astype(np.uint32)
    return tables


def apply_tables(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return tables[0][state & 255] ^ tables[1][state >> np.uint32(8) & 255] ^ tables[2][state >> np.uint32(16) & 255] ^ tables[3][state >> np.uint32(24)]


def rounded(steps: int) -> int:
    """The next power of two, or three quarters of it: zeros in front cost little and few lengths need tables."""
    whole = 1 << (steps - 1).bit_length()
    return whole * 3 // 4 if whole >= 4 and steps <= whole * 3 // 4 else whole


def crc32c(data: bytes | bytearray | memoryview) -> int:
    n = len(data)
    if n < SHORT:
        table, state = byte_table(), 0xFFFFFFFF
        for b in bytes(data):
            state = table[(state ^ b) & 255] ^ (state >> 8)
        return state ^ 0xFFFFFFFF
    lanes = min(1 << (n // 12).bit_length() - 1, 4096)
    steps = rounded(-(-n // (2 * lanes)))
    padded = np.zeros(2 * lanes * steps, np.uint8)
    padded[len(padded) - n :] = np.frombuffer(data, np.uint8)
    padded[len(padded) - n : len(padded) - n + 4] ^= 0xFF  # the initial value; zeros before it leave a zero state zero
    words = np.ascontiguousarray(padded.view("<u2").reshape(lanes, steps).T)
    table, state = pair_table(), np.zeros(lanes, np.uint32)
    for column in words:
        state = table[(state ^ column) & np.uint32(0xFFFF)] ^ (state >> np.uint32(16))
    length = 2 * steps
    while len(state) > 1:
        state = apply_tables(appending(length), state[::2]) ^ state[1::2]
        length *= 2
    return int(state[0]) ^ 0xFFFFFFFF
