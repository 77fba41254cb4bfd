"""Where the members of a ZIP package lie, found by reading a few byte ranges of it."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

#: Reads ``length`` bytes from ``start`` of a package.
Read = Callable[[int, int], bytes]

#: Bytes that one range read asks for at most.
BLOCK = 1 << 20

# Fixed values of the ZIP format: signatures, record layouts and the marks for "see ZIP64".
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
END_FORMAT, END64_FORMAT, LOCATOR64_FORMAT = "<4s4H2LH", "<4sQ2H2L4Q", "<4sLQL"
ENTRY_FORMAT, LOCAL_FORMAT = "<4s6H3L5H2L", "<4s5H3L2H"
FULL16, FULL32, LONGEST_COMMENT, EXTRA64, UTF8_NAME, ENCRYPTED = 0xFFFF, 0xFFFFFFFF, 0xFFFF, 1, 0x800, 1


class Member(NamedTuple):
    """A member as the central directory has it; ``header`` is where its local header begins."""

    name: str
    method: int
    flags: int
    size: int
    header: int


def blocks(read: Read, start: int, length: int) -> Iterator[bytes]:
    for at in range(start, start + length, BLOCK):
        yield read(at, min(BLOCK, start + length - at))


def _unpack(layout: str, data: bytes, at: int, signature: bytes) -> tuple:
    if data[at:at + 4] != signature or len(data) < at + struct.calcsize(layout):
        raise ValueError(f"no ZIP record {signature!r} where one is due")
    return struct.unpack_from(layout, data, at)[1:]


def directory_range(read: Read, size: int) -> tuple[int, int, int]:
    """Offset, bytes and entries of the central directory, by the end record or, where the
    package has one, the ZIP64 end record."""
    short, long = struct.calcsize(END_FORMAT), struct.calcsize(LOCATOR64_FORMAT)
    tail = read(max(0, size - short - LONGEST_COMMENT - long), min(size, short + LONGEST_COMMENT + long))
    at = tail.rfind(END)
    # the end record is the one whose comment ends with the package
    while at >= 0 and (len(tail) < at + short or at + short + struct.unpack_from("<H", tail, at + short - 2)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("not a ZIP package: no end record")
    disk, first_disk, _, n, length, offset, _ = _unpack(END_FORMAT, tail, at, END)
    if tail[max(0, at - long):at][:4] == LOCATOR64 and at >= long:
        _, record, _ = _unpack(LOCATOR64_FORMAT, tail, at - long, LOCATOR64)
        end = read(record, struct.calcsize(END64_FORMAT))
        _, _, _, disk, first_disk, _, n, length, offset = _unpack(END64_FORMAT, end, 0, END64)
    if disk or first_disk:
        raise ValueError("a package over several disks")
    return offset, length, n


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """The sizes and offset of an entry, those marked full taken from its ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<2H", extra, at)
        if kind == EXTRA64:
            place = at + 4
            for i, v in enumerate(values):
                if v == FULL32:
                    if place + 8 > at + 4 + length:
                        raise ValueError("a ZIP64 field without the value it is due")
                    values[i] = struct.unpack_from("<Q", extra, place)[0]
                    place += 8
            return values
        at += 4 + length
    return values


def members(read: Read, size: int) -> Iterator[Member]:
    """All members of the package, in the order of its central directory."""
    offset, length, n = directory_range(read, size)
    fixed, held, at = struct.calcsize(ENTRY_FORMAT), b"", 0
    more = blocks(read, offset, length)
    for _ in range(n):
        def have(wanted: int) -> bool:
            nonlocal held, at
            while len(held) - at < wanted:
                block = next(more, b"")
                if not block:
                    return False
                held, at = held[at:] + block, 0
            return True

        if not have(fixed):
            raise ValueError("the central directory ends early")
        f = _unpack(ENTRY_FORMAT, held, at, ENTRY)
        flags, method, sizes, names = f[2], f[3], list(f[7:9]), f[9:12]
        if not have(fixed + sum(names)):
            raise ValueError("the central directory ends early")
        name = held[at + fixed:at + fixed + names[0]]
        extra = held[at + fixed + names[0]:at + fixed + names[0] + names[1]]
        # ZIP64 fields hold the full size, the stored size, then the offset
        full, stored, header = _wide(extra, [sizes[1], sizes[0], f[15]])
        yield Member(name.decode("utf-8" if flags & UTF8_NAME else "cp437"), method, flags, stored, header)
        at += fixed + sum(names)


def stored_range(read: Read, member: Member) -> tuple[int, int]:
    """Offset and length of a stored member's bytes: parts of it can be read in place."""
    if member.method or member.flags & ENCRYPTED:
        raise ValueError(f"{member.name} is compressed or encrypted; only stored members are read in place")
    head = read(member.header, struct.calcsize(LOCAL_FORMAT))
    *_, name, extra = _unpack(LOCAL_FORMAT, head, 0, LOCAL)
    return member.header + len(head) + name + extra, member.size
