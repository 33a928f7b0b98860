"""Reflected cyclic checksums of many values at once.

A register is linear in the bytes. Blocks of 256 bytes are looked up by place, all blocks side by side; then
neighbours are joined, the left one moved on by the bytes of the right one, until each value is one register.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

#: Bytes of a block; blocks that are looked up together; bytes of values that are joined to one buffer.
BLOCK, SIDE_BY_SIDE, BUFFER = 256, 16_384, 8 << 20


@cache
def table(poly: int) -> list[int]:
    """What each byte adds to the register."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (poly if byte & 1 else 0)
        out.append(byte)
    return out


@cache
def _places(poly: int, width: int):
    """For each place in a block what each byte there adds to the register at the block's end."""
    import numpy as np

    one = np.array(table(poly), np.uint32 if width == 32 else np.uint64)
    out = np.empty((BLOCK, 256), one.dtype)
    out[-1] = one
    for k in range(BLOCK - 2, -1, -1):
        out[k] = out[k + 1] >> 8 ^ one[out[k + 1] & 255]
    return out


def _moved(registers, by):
    """Registers after as many zero bytes as ``by``, a table for each byte of them, stands for."""
    out = by[0][registers & 255]
    for k in range(1, len(by)):
        out ^= by[k][registers >> 8 * k & 255]
    return out


def _joined(values: Sequence[bytes], poly: int, width: int):
    """The registers, from zero on, of values that are padded in front to whole blocks and not empty."""
    import numpy as np

    places = _places(poly, width)
    blocks = np.frombuffer(b"".join(values), np.uint8).reshape(-1, BLOCK)
    found = np.zeros(len(blocks), places.dtype)
    for at in range(0, len(blocks), SIDE_BY_SIDE):
        columns, part = np.ascontiguousarray(blocks[at : at + SIDE_BY_SIDE].T), found[at : at + SIDE_BY_SIDE]
        for k in range(BLOCK):
            part ^= places[k][columns[k]]
    counts = np.array([len(x) // BLOCK for x in values], np.int64)
    by = places[: width // 8]
    while counts.max() > 1:
        half = (counts + 1) // 2
        ends = 2 * np.cumsum(half)
        keep = np.ones(ends[-1], bool)
        # a row of an odd count gets a register of zero in front, which adds nothing
        keep[(ends - 2 * half)[counts % 2 == 1]] = False
        even = np.zeros(ends[-1], places.dtype)
        even[keep] = found
        found = _moved(even[::2], by) ^ even[1::2]
        counts, by = half, np.stack([_moved(x, by) for x in by])
    return found


def _plain(data: bytes, poly: int, width: int) -> int:
    of, crc = table(poly), (1 << width) - 1
    for byte in data:
        crc = crc >> 8 ^ of[(crc ^ byte) & 255]
    return crc ^ (1 << width) - 1


def crcs(values: Sequence[bytes], poly: int, width: int) -> Iterator[int]:
    """The checksum of each value; the register starts and ends inverted."""
    lead, ones, held, size = width // 8, (1 << width) - 1, [], 0
    if sum(map(len, values)) < 16 * BLOCK:
        yield from (_plain(x, poly, width) for x in values)
        return

    def out() -> Iterator[int]:
        padded = [x for x in held if len(x) >= BLOCK]
        found = iter(_joined(padded, poly, width).tolist() if padded else [])
        for x in held:
            yield next(found) ^ ones if len(x) >= BLOCK else _plain(x, poly, width)

    for data in values:
        if len(data) >= lead:
            # ones at the start are the first bytes inverted, so that zeros may stand before them
            first = int.from_bytes(data[:lead], "little") ^ ones
            data = b"".join((bytes(-len(data) % BLOCK), first.to_bytes(lead, "little"), data[lead:]))
        held.append(data)
        size += len(data)
        if size >= BUFFER:
            yield from out()
            held, size = [], 0
    yield from out()
