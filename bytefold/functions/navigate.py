"""Where the headers, segments and sections of a binary lie: ``(label, offset, size, kind, depth)``."""

from __future__ import annotations

from collections.abc import Iterator

from bytefold.sources import codec

# At most so many entries of a table are listed.
LIMITS = {"phdr": 64, "shdr": 128, "section": 96, "command": 128, "block": 1024}

# Names of ELF segment types.
_SEGMENTS = {0: "NULL", 1: "LOAD", 2: "DYNAMIC", 3: "INTERP", 4: "NOTE", 6: "PHDR", 7: "TLS"}

# Fixed values: (header size, pointer size, table offsets, entry size and count fields, least entries).
_ELF = {"elf64": (64, 8, 32, 40, 54, 56, 58, 60, 56, 64), "elf32": (52, 4, 28, 32, 42, 44, 46, 48, 32, 40)}

Node = tuple[str, int, int, str, int]


def _elf(data: bytes, name: str) -> Iterator[Node]:
    size, word, ph, sh, ph_size, ph_count, sh_size, sh_count, least_ph, least_sh = _ELF[name]
    if len(data) < size:
        return
    number = lambda at, n: int.from_bytes(data[at : at + n], "little")
    yield (f"ELF-{word * 8} Header", 0, size, "header", 0)
    at, step = number(ph, word), number(ph_size, 2)
    for i in range(min(number(ph_count, 2), LIMITS["phdr"]) if at and step >= least_ph else 0):
        if at + i * step + 4 > len(data):
            break
        kind = number(at + i * step, 4)
        yield (f"PHDR[{i}] {_SEGMENTS.get(kind, hex(kind))}", at + i * step, step, "segment", 1)
    at, step = number(sh, word), number(sh_size, 2)
    for i in range(min(number(sh_count, 2), LIMITS["shdr"]) if at and step >= least_sh else 0):
        if at + i * step + 4 > len(data):
            break
        yield (f"Section[{i}]", at + i * step, step, "section", 1)


def _pe(data: bytes, _: str) -> Iterator[Node]:
    if len(data) < 64:
        return
    number = lambda at, n: int.from_bytes(data[at : at + n], "little")
    yield ("DOS Header", 0, 64, "header", 0)
    start = number(0x3C, 4)
    if start + 24 > len(data):
        return
    yield ("PE Signature", start, 4, "header", 1)
    yield ("COFF Header", start + 4, 20, "header", 1)
    sections, optional = number(start + 6, 2), number(start + 20, 2)
    if optional and start + 24 + optional <= len(data):
        yield ("Optional Header", start + 24, optional, "header", 1)
    for i in range(min(sections, LIMITS["section"])):
        at = start + 24 + optional + 40 * i
        if at + 40 > len(data):
            break
        name = data[at : at + 8].rstrip(b"\0").decode("ascii", "replace")
        yield (name or f"Section[{i}]", number(at + 20, 4), number(at + 16, 4), "section", 1)


def _macho(data: bytes, name: str) -> Iterator[Node]:
    size = 32 if "64" in name else 28
    if len(data) < size:
        return
    number = lambda at, n: int.from_bytes(data[at : at + n], "little")
    yield ("Mach-O Header", 0, size, "header", 0)
    at = size
    for i in range(min(number(16, 4), LIMITS["command"])):
        length = number(at + 4, 4)
        if at + 8 > len(data) or length < 8:
            break
        yield (f"LC[{i}] {number(at, 4):#x}", at, length, "command", 1)
        at += length


def _container(data: bytes, _: str) -> Iterator[Node]:
    head = codec.file_header(data)
    yield ("File Header", 0, head["header_size"], "header", 0)
    for b in codec.iter_blocks(data)[: LIMITS["block"]]:
        yield (f"Block {b['type']:#06x}", b["file_off"], b["length"], "block", 1)


_PARSERS = {"elf64": _elf, "elf32": _elf, "pe32": _pe, "pe64": _pe, "macho64_le": _macho, "macho32_le": _macho, "msl": _container}


def navigate(data: bytes, name: str | None) -> list[Node]:
    """Nodes of a binary of a known format; of damaged data only what could be read."""
    out: list[Node] = []
    if name in _PARSERS:
        try:
            out.extend(_PARSERS[name](data, name))
        except (codec.FormatError, IndexError):
            out = out or [(name.upper(), 0, min(len(data), 64), "header", 0)]
    return out
