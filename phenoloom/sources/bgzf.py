"""Bgzip text and its position indexes (.tbi, .csi): what is needed to read a window's blocks and to write indexed parts.

A bgzip file is a row of gzip members of at most 64 KiB each, so a place in the text is a virtual offset: where its member
begins in the file, and where the line begins in the member. An index lists, for each sequence, the chunks of virtual
offsets that hold records of a bin; bins halve the sequence at each of several depths.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

# Fixed values of the formats.
GZIP_HEAD = b"\x1f\x8b\x08\x04"
BLOCK_HEAD = struct.pack("<4BI2BH2BH", 0x1F, 0x8B, 8, 4, 0, 0, 255, 6, 66, 67, 2)
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MIN_SHIFT, DEPTH = 14, 5
#: Depth of the bins of a file whose furthest place isn't known yet.
MOST_DEPTH = 10
#: Bytes of text in a member, so that it stays under 64 KiB even if it doesn't shrink.
MEMBER = 0xFF00

Chunk = tuple[int, int]


def members(file: BinaryIO, start: int, last: int) -> Iterator[tuple[int, bytes]]:
    """(offset in the file, text) of the members from `start` to the one that begins at `last`. Nothing beyond that is read."""
    at = start
    while at <= last:
        file.seek(at)
        head = file.read(12)
        if len(head) < 12:
            return
        if head[:4] != GZIP_HEAD:
            raise ValueError(f"no bgzip member at {at}")
        extra = file.read(struct.unpack_from("<H", head, 10)[0])
        size, k = None, 0
        while k + 4 <= len(extra):
            n = struct.unpack_from("<H", extra, k + 2)[0]
            if extra[k : k + 2] == b"BC" and n == 2:
                size = struct.unpack_from("<H", extra, k + 4)[0] + 1
            k += 4 + n
        if size is None:
            raise ValueError(f"the gzip member at {at} does not say its size: not bgzip")
        rest = size - 12 - len(extra)
        data = file.read(rest)
        if len(data) < rest:
            raise ValueError(f"the member at {at} is cut off")
        yield at, zlib.decompress(data[:-8], -15)
        at += size


def lines(file: BinaryIO, chunk: Chunk) -> Iterator[bytes]:
    """Lines that begin in the chunk [begin, end)."""
    begin, end = chunk
    rest = b""
    # The end may be the very start of a member, which then isn't needed.
    last = (end >> 16) if end & 0xFFFF else max((end >> 16) - 1, begin >> 16)
    for at, text in members(file, begin >> 16, last):
        text = text[: end & 0xFFFF] if at == end >> 16 else text
        text = rest + (text[begin & 0xFFFF :] if at == begin >> 16 else text)
        *whole, rest = text.split(b"\n")
        yield from whole
    if rest:
        yield rest


@dataclass
class Sequence:
    """Chunks by bin, and the least offset of each stretch of 2^14 places (.tbi) or bin (.csi)."""

    bins: dict[int, list[Chunk]] = field(default_factory=dict)
    stretches: list[int] = field(default_factory=list)
    least: dict[int, int] = field(default_factory=dict)


@dataclass
class Index:
    sequences: dict[str, Sequence]
    min_shift: int = MIN_SHIFT
    depth: int = DEPTH

    def first_bin(self, level: int) -> int:
        return ((1 << 3 * level) - 1) // 7

    def end(self, name: str) -> int:
        """A place after the last record's bin; a sequence with records in its widest bins only is as long as the index allows."""
        ends = [0]
        for b in self.sequences[name].bins:
            level = next(k for k in range(self.depth, -1, -1) if b >= self.first_bin(k))
            ends.append((b - self.first_bin(level) + 1) << self.min_shift + 3 * (self.depth - level))
        return max(ends)

    def chunks(self, name: str, start: int, end: int) -> list[Chunk]:
        """Chunks, joined where they meet in a member, that hold all records from place `start` (0-based) to before `end`."""
        sequence = self.sequences.get(name)
        if sequence is None or end <= start:
            return []
        found: list[Chunk] = []
        least = sequence.stretches[min(start >> MIN_SHIFT, len(sequence.stretches) - 1)] if sequence.stretches else 0
        for level in range(self.depth + 1):
            shift = self.min_shift + 3 * (self.depth - level)
            for b in range(self.first_bin(level) + (start >> shift), self.first_bin(level) + (end - 1 >> shift) + 1):
                if b in sequence.bins:
                    found += sequence.bins[b]
                    if level == self.depth and b == self.first_bin(level) + (start >> shift):
                        least = max(least, sequence.least.get(b, 0))
        out: list[Chunk] = []
        for begin, stop in sorted(c for c in found if c[1] > least):
            if out and begin >> 16 <= out[-1][1] >> 16:
                out[-1] = (out[-1][0], max(out[-1][1], stop))
            else:
                out.append((begin, stop))
        return out


def parse_index(data: bytes) -> Index:
    """A .tbi or .csi file, which are bgzip themselves."""
    import gzip

    data = gzip.decompress(data)
    at = 4

    def take(form: str) -> tuple:
        nonlocal at
        out = struct.unpack_from("<" + form, data, at)
        at += struct.calcsize("<" + form)
        return out

    kind = data[:4]
    if kind == b"TBI\x01":
        n, *_, length = take("8i")
        names, min_shift, depth = data[at : at + length], MIN_SHIFT, DEPTH
        at += length
    elif kind == b"CSI\x01":
        min_shift, depth, length = take("3i")
        names = data[at + 28 : at + length]
        at += length
        (n,) = take("i")
    else:
        raise ValueError("neither a .tbi nor a .csi index")
    sequences: dict[str, Sequence] = {}
    for name in [x.decode() for x in names.split(b"\0")[:n]]:
        own = sequences[name] = Sequence()
        widest = ((1 << 3 * (depth + 1)) - 1) // 7
        for _ in range(take("i")[0]):
            (b,) = take("I")
            if kind == b"CSI\x01":
                own.least[b] = take("Q")[0]
            flat = take(f"{2 * take('i')[0]}Q")
            # A bin after all others holds counts, not chunks.
            if b < widest:
                own.bins[b] = list(zip(flat[::2], flat[1::2], strict=True))
        if kind == b"TBI\x01":
            own.stretches = list(take(f"{take('i')[0]}Q"))
    return Index(sequences, min_shift, depth)


def member(text: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = packer.compress(text) + packer.flush()
    return BLOCK_HEAD + struct.pack("<H", len(BLOCK_HEAD) + 2 + len(data) + 8 - 1) + data + struct.pack("<2I", zlib.crc32(text), len(text))


def first_bin(level: int) -> int:
    return ((1 << 3 * level) - 1) // 7


def bin_of(start: int, end: int, depth: int = DEPTH) -> int:
    """The smallest bin that holds [start, end)."""
    if end > 1 << MIN_SHIFT + 3 * depth:
        raise ValueError(f"place {end} is beyond what {'a .tbi' if depth == DEPTH else 'an'} index can hold")
    for level in range(depth, 0, -1):
        shift = MIN_SHIFT + 3 * (depth - level)
        if start >> shift == end - 1 >> shift:
            return first_bin(level) + (start >> shift)
    return 0


def level_of(b: int, depth: int) -> tuple[int, int]:
    """(level, place in the level) of a bin."""
    level = next(k for k in range(depth, -1, -1) if b >= first_bin(k))
    return level, b - first_bin(level)


def index_ending(index: bytes) -> str:
    return ".csi" if zlib.decompressobj(31).decompress(index)[:4] == b"CSI\x01" else ".tbi"


def write_indexed(file: BinaryIO, header: bytes, records: Iterable[tuple[str, int, int, bytes]], far: bool = False) -> bytes:
    """Writes the header and the lines of (sequence, start, end, line), sorted by sequence and start; returns the index.

    That is a .tbi, which holds 2^29 places; with `far`, a .csi as deep as needed where a record lies beyond them. Only a
    member of text and the index are held.
    """
    sequences: dict[str, Sequence] = {}
    pending, at, furthest, most = bytearray(), 0, 0, MOST_DEPTH if far else DEPTH

    def flush(all_: bool = False) -> None:
        nonlocal at
        while len(pending) >= MEMBER or (all_ and pending):
            data = member(bytes(pending[:MEMBER]))
            file.write(data)
            at += len(data)
            del pending[:MEMBER]

    pending += header
    flush(True)
    for name, start, end, line in records:
        # Place 0 (a record before the first base) lies in the first bin.
        start, end = max(start, 0), max(end, 1)
        flush()
        begin = at << 16 | len(pending)
        pending += line + b"\n"
        flush()
        stop = at << 16 | len(pending)
        own = sequences.setdefault(name, Sequence())
        chunks = own.bins.setdefault(bin_of(start, end, most), [])
        furthest = max(furthest, end)
        if chunks and chunks[-1][1] == begin:
            chunks[-1] = (chunks[-1][0], stop)
        else:
            chunks.append((begin, stop))
        own.stretches += [begin] * ((end - 1 >> MIN_SHIFT) + 1 - len(own.stretches))
    flush(True)
    file.write(END_OF_FILE)
    depth = DEPTH
    while furthest > 1 << MIN_SHIFT + 3 * depth:
        depth += 1
    names = b"".join(n.encode() + b"\0" for n in sequences)
    about = struct.pack("<7i", 2, 1, 2, 0, ord("#"), 0, len(names)) + names
    out = [b"TBI\x01", struct.pack("<i", len(sequences)), about] if depth == DEPTH else [b"CSI\x01", struct.pack("<3i", MIN_SHIFT, depth, len(about)), about, struct.pack("<i", len(sequences))]
    for own in sequences.values():
        out.append(struct.pack("<i", len(own.bins)))
        for b, chunks in own.bins.items():
            # The upper levels of a deeper tree than needed hold nothing.
            level, place = level_of(b, most)
            level -= most - depth
            b = first_bin(level) + place
            least = b"" if depth == DEPTH else struct.pack("<Q", own.stretches[place << 3 * (depth - level)])
            out.append(struct.pack("<I", b) + least + struct.pack(f"<i{2 * len(chunks)}Q", len(chunks), *[x for c in chunks for x in c]))
        if depth == DEPTH:
            out.append(struct.pack(f"<i{len(own.stretches)}Q", len(own.stretches), *own.stretches))
    index = b"".join(out)
    return b"".join(member(index[k : k + MEMBER]) for k in range(0, len(index), MEMBER)) + END_OF_FILE
