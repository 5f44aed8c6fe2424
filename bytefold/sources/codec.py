"""The block container format as data: one layout per block type, read and written by one walker.

A layout is a list of (field, kind).  Kinds: ``u8 u16 u32 u64`` little-endian, ``Nx`` padding,
``Ns`` raw bytes, ``str:F`` text of the length in field F, padded to 8 bytes (0: no bytes at all),
``note`` as ``str`` but for the field F itself, ``rest`` all bytes left, ``flag`` one byte that is 1.
A table layout repeats its row layout as often as its count says.
"""

from __future__ import annotations

import struct
import uuid as uuids
from dataclasses import dataclass, field

from bytefold.functions.hashing import block_hash

# Fixed values of the format.
FILE_MAGIC, BLOCK_MAGIC = b"MEMSLICE", b"MSLC"
FILE_HEADER, BLOCK_HEADER = 64, 80
COMPRESSED, HAS_KEY_HINTS, HAS_CHILDREN, CONTINUATION = 1, 8, 16, 32
IMPORTED, INVESTIGATION, ENCRYPTED = 1, 2, 4
END, GRAPH, REGION, VAS = 0x0FFF, 0x1003, 0x0001, 0x1001
PAGE_STATES = ("CAPTURED", "FAILED", "UNMAPPED", "FAILED")

# File and block headers.
FILE_LAYOUT = [("magic", "8s"), ("endianness", "u8"), ("header_size", "u8"), ("version", "u16"), ("flags", "u32"), ("cap_bitmap", "u64"), ("dump_uuid", "16s"), ("ts_ns", "u64"), ("os", "u16"), ("arch", "u16"), ("pid", "u32"), ("clock", "u8"), ("block_count", "u32"), ("hash_algo", "u8"), ("", "2x")]
BLOCK_LAYOUT = [("magic", "4s"), ("type", "u16"), ("flags", "u16"), ("length", "u32"), ("payload_version", "u16"), ("", "2x"), ("uuid", "16s"), ("parent", "16s"), ("prev_hash", "32s")]

# Payloads of single-record blocks.
LAYOUTS: dict[int, tuple[str, list[tuple[str, str]]]] = {
    0x0002: ("module", [("base", "u64"), ("size", "u64"), ("path_len", "u16"), ("version_len", "u16"), ("", "4x"), ("path", "str:path_len"), ("version", "str:version_len"), ("disk_hash", "32s")]),
    0x0020: ("key_hint", [("region_uuid", "16s"), ("offset", "u64"), ("key_length", "u32"), ("key_type", "u16"), ("protocol", "u16"), ("confidence", "u8"), ("state", "u8"), ("", "2x"), ("note_len", "u32"), ("", "4x"), ("note", "str:note_len")]),
    0x0030: ("provenance", [("source_format", "u16"), ("", "2x"), ("tool_len", "u32"), ("import_ns", "u64"), ("orig_size", "u64"), ("note_len", "u32"), ("", "4x"), ("tool", "str:tool_len"), ("note", "str:note_len"), ("source_hash", "32s")]),
    0x0040: ("process", [("ppid", "u32"), ("session", "u32"), ("start_ns", "u64"), ("exe_len", "u16"), ("cmd_len", "u16"), ("", "4x"), ("exe", "str:exe_len"), ("cmd", "str:cmd_len")]),
    0x0041: ("related", [("related_uuid", "16s"), ("related_pid", "u32"), ("relationship", "u16"), ("", "2x"), ("target_hash", "32s")]),
    0x0050: ("system", [("boot_ns", "u64"), ("target_count", "u32"), ("table_bitmap", "u32"), ("user_len", "u16"), ("host_len", "u16"), ("domain_len", "u16"), ("os_len", "u16"), ("case_len", "u16"), ("", "6x"), ("user", "str:user_len"), ("host", "str:host_len"), ("domain", "str:domain_len"), ("os_detail", "str:os_len"), ("case_ref", "str:case_len"), ("uptime_ns", "u64"), ("osv_len", "u16"), ("", "6x"), ("os_version", "str:osv_len")]),
    0x0FFF: ("end", [("file_hash", "32s"), ("acq_end_ns", "u64")]),
    0x0011: ("thread", [("thread_id", "u64"), ("registers", "rest")]),
    0x0012: ("descriptor", [("fd", "u32"), ("path_len", "u16"), ("", "2x"), ("path", "str:path_len")]),
    0x0013: ("socket", [("local_port", "u16"), ("remote_port", "u16"), ("protocol", "u16"), ("", "2x"), ("addresses", "rest")]),
    0x0015: ("token", [("token_type", "u16"), ("", "2x"), ("token", "rest")]),
}

# Rows of table blocks (after a count of 4 bytes and the given padding).
TABLES: dict[int, tuple[str, int, list[tuple[str, str]]]] = {
    0x0010: ("module_index", 4, [("module_uuid", "16s"), ("base", "u64"), ("size", "u64"), ("path_len", "u16"), ("", "6x"), ("path", "str:path_len")]),
    0x0014: ("environment", 0, [("key_len", "u16"), ("value_len", "u16"), ("key", "str:key_len"), ("value", "str:value_len")]),
    0x0051: ("processes", 4, [("pid", "u32"), ("ppid", "u32"), ("uid", "u32"), ("is_target", "flag"), ("", "3x"), ("start_ns", "u64"), ("rss", "u64"), ("exe_len", "u16"), ("cmd_len", "u16"), ("user_len", "u16"), ("", "2x"), ("exe", "str:exe_len"), ("cmd", "str:cmd_len"), ("user", "str:user_len")]),
    0x0052: ("connections", 4, [("pid", "u32"), ("family", "u8"), ("protocol", "u8"), ("state", "u8"), ("", "1x"), ("local_addr", "16s"), ("local_port", "u16"), ("", "2x"), ("remote_addr", "16s"), ("remote_port", "u16"), ("", "2x")]),
    0x0053: ("handles", 4, [("pid", "u32"), ("fd", "u32"), ("handle_type", "u16"), ("path_len", "u16"), ("", "4x"), ("path", "str:path_len")]),
    0x1001: ("address_map", 4, [("base", "u64"), ("size", "u64"), ("prot", "u8"), ("region_type", "u8"), ("path_len", "u16"), ("", "4x"), ("path", "str:path_len")]),
}

# Variants of the connectivity table; ``tight`` is text with its length before it.
CONNECTIVITY: dict[int, tuple[str, list[tuple[str, str]]]] = {
    1: ("ipv4_route", [("iface", "tight"), ("dest", "4s"), ("gateway", "4s"), ("mask", "4s"), ("flags", "u16"), ("metric", "u32"), ("mtu", "u32")]),
    2: ("ipv6_route", [("iface", "tight"), ("dest", "16s"), ("prefix", "u8"), ("next_hop", "16s"), ("metric", "u32"), ("flags", "u32")]),
    3: ("arp", [("family", "u8"), ("ip", "4s"), ("hw_type", "u16"), ("flags", "u16"), ("hw_addr", "6s"), ("iface", "tight")]),
    4: ("packet_socket", [("pid", "u32"), ("inode", "u64"), ("proto", "u16"), ("iface_index", "u32"), ("user", "u32"), ("mem", "u64")]),
    5: ("iface_stats", [("iface", "tight"), ("rx_bytes", "u64"), ("rx_pkts", "u64"), ("rx_err", "u64"), ("rx_drop", "u64"), ("tx_bytes", "u64"), ("tx_pkts", "u64"), ("tx_err", "u64"), ("tx_drop", "u64")]),
    6: ("socket_family", [("family", "u8"), ("in_use", "u32"), ("alloc", "u32"), ("mem", "u64")]),
    7: ("mib_counter", [("mib", "tight"), ("counter", "tight"), ("value", "u64")]),
}

# Nodes and edges of the pointer graph behind the end block.
NODE = [("kind", "u8"), ("", "1x"), ("label_len", "u16"), ("value", "u64"), ("label", "str:label_len")]
EDGE = [("src", "u32"), ("dst", "u32"), ("kind", "u8"), ("", "1x"), ("meta_len", "u16"), ("metadata", "str:meta_len")]

_NUMBER = {"u8": 1, "u16": 2, "u32": 4, "u64": 8, "flag": 1}


class FormatError(ValueError):
    """Bytes that aren't what the format says."""


def pad8(n: int) -> int:
    return n + -n % 8


def read(layout: list[tuple[str, str]], data: bytes, at: int = 0, optional: tuple[str, ...] = ()) -> tuple[dict, int]:
    """Read one record; the record and the offset behind it.

    A missing ``disk_hash``, ``source_hash`` or ``target_hash`` is zeros and fields named
    ``optional`` may be missing; all else beyond the end is an error.
    """
    out: dict = {}
    for name, kind in layout:
        if kind in _NUMBER:
            n = _NUMBER[kind]
            if at + n > len(data):
                if name in optional:
                    out[name] = 0
                    continue
                raise FormatError(f"{name} lies beyond the block")
            v = int.from_bytes(data[at : at + n], "little")
            out[name] = v == 1 if kind == "flag" else v
            at += n
        elif kind == "rest":
            out[name], at = data[at:], len(data)
        elif kind == "tight" or kind.startswith("str:"):
            if kind == "tight":
                n, at = int.from_bytes(data[at : at + 2], "little"), at + 2
                step = n
            else:
                n = out[kind[4:]]
                step = pad8(n)
            if at + n > len(data):
                raise FormatError(f"{name} lies beyond the block")
            out[name] = data[at : at + n].split(b"\0", 1)[0].decode("utf-8", "replace")
            at += step
        else:
            n = int(kind[:-1])
            if kind.endswith("s"):
                part = data[at : at + n]
                if len(part) < n and not name.endswith("_hash"):
                    raise FormatError(f"{name} lies beyond the block")
                out[name] = part.ljust(n, b"\0")
            at += n
    return out, at


def write(layout: list[tuple[str, str]], record: dict) -> bytes:
    """Write one record; lengths follow from the texts, missing fields are zero or empty."""
    texts = {kind[4:]: _text(record.get(name, "")) for name, kind in layout if kind.startswith("str:")}
    out = b""
    for name, kind in layout:
        if kind in _NUMBER:
            v = len(texts[name]) if name in texts else int(record.get(name) or 0)
            out += v.to_bytes(_NUMBER[kind], "little")
        elif kind == "rest":
            out += record.get(name, b"")
        elif kind == "tight":
            t = _text(record.get(name, ""))
            out += len(t).to_bytes(2, "little") + t
        elif kind.startswith("str:"):
            out += texts[kind[4:]].ljust(pad8(len(texts[kind[4:]])), b"\0")
        else:
            n = int(kind[:-1])
            out += (record.get(name, b"") if kind.endswith("s") else b"").ljust(n, b"\0")[:n]
    return out


def _text(s: str) -> bytes:
    return s.encode() + b"\0" if s else b""


def read_table(kind: int, data: bytes) -> list[dict]:
    """Rows of a table block.  A module index of 8 bytes only announces modules and has no rows."""
    _, pad, layout = TABLES[kind]
    count, stride = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little") if kind == VAS else 0
    if len(data) < 4 + pad:
        raise FormatError("the table has no header")
    if kind == 0x0010 and len(data) == 8:
        return []
    rows, at = [], 4 + pad
    for _ in range(count):
        row, end = read(layout, data, at)
        rows.append(row)
        at = at + stride if stride else end
    return rows


def write_table(kind: int, rows: list[dict]) -> bytes:
    _, pad, layout = TABLES[kind]
    return len(rows).to_bytes(4, "little") + bytes(pad) + b"".join(write(layout, r) for r in rows)


def read_connectivity(data: bytes) -> list[dict]:
    """Rows of a connectivity table with their ``row_type``; unknown variants are skipped."""
    rows, at = [], 8
    for _ in range(int.from_bytes(data[:4], "little")):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 3], "little")
        body = data[at + 3 : at + 3 + size]
        if len(body) < size:
            raise FormatError("a row lies beyond the block")
        if kind in CONNECTIVITY:
            row, end = read(CONNECTIVITY[kind][1], body)
            if end > size:
                raise FormatError("a row is longer than it says")
            rows.append({"row_type": CONNECTIVITY[kind][0]} | row)
        at += 3 + size
    return rows


def write_connectivity(rows: list[dict]) -> bytes:
    kinds = {name: (k, layout) for k, (name, layout) in CONNECTIVITY.items()}
    out = len(rows).to_bytes(4, "little") + bytes(4)
    for r in rows:
        kind, layout = kinds[r["row_type"]]
        body = write(layout, r)
        out += bytes([kind]) + len(body).to_bytes(2, "little") + body
    return out


def page_intervals(states: bytes, pages: int) -> list[tuple[int, int, str]]:
    """Runs of page states as (first page, pages, state); 2 bits a page from the high end, missing ones failed."""
    out: list[tuple[int, int, str]] = []
    if pages and not any(states[: -(-pages // 4)]) and len(states) >= -(-pages // 4):
        return [(0, pages, PAGE_STATES[0])]
    for i in range(pages):
        state = PAGE_STATES[states[i // 4] >> (6 - 2 * (i % 4)) & 3] if i // 4 < len(states) else "FAILED"
        if out and out[-1][2] == state:
            out[-1] = (out[-1][0], out[-1][1] + 1, state)
        else:
            out.append((i, 1, state))
    return out


def page_map(states: list[int]) -> bytes:
    out = bytearray(pad8(-(-len(states) // 4)) if states else 0)
    for i, s in enumerate(states):
        out[i // 4] |= (s & 3) << (6 - 2 * (i % 4))
    return bytes(out)


_REGION = [("base", "u64"), ("size", "u64"), ("prot", "u8"), ("region_type", "u8"), ("page_log2", "u8"), ("", "5x"), ("ts_ns", "u64")]


def read_region(data: bytes) -> dict:
    """A memory region with its page intervals and captured runs (first page, pages, bytes)."""
    r, at = read(_REGION, data)
    if not 10 <= r["page_log2"] <= 40:
        raise FormatError(f"page size 2^{r['page_log2']} is out of range")
    page = 1 << r["page_log2"]
    pages = r["size"] // page
    map_size = pad8(-(-pages // 4))
    r["intervals"] = page_intervals(data[at : at + map_size], pages)
    at += map_size
    r["captured"] = []
    for first, n, state in r["intervals"]:
        if state == "CAPTURED":  # only captured pages have data
            r["captured"].append((first, n, data[at : at + n * page]))
            at += n * page
    return r


def write_region(record: dict, states: list[int], data: bytes) -> bytes:
    return write(_REGION, record) + page_map(states) + data


def read_graph(data: bytes, algorithm: int = 0) -> tuple[list[dict], list[dict], bool | None]:
    """Nodes, edges, and whether the trailing hash holds (None without one)."""
    n, m, flags = struct.unpack_from("<III", data)
    at, nodes, edges = 16, [], []
    for count, layout, rows in ((n, NODE, nodes), (m, EDGE, edges)):
        for _ in range(count):
            row, at = read(layout, data, at)
            rows.append(row)
    good = block_hash(data[:at], algorithm) == data[at : at + 32] if flags & 1 else None
    return nodes, edges, good


def write_graph(nodes: list[dict], edges: list[dict], algorithm: int = 0) -> bytes:
    body = struct.pack("<IIII", len(nodes), len(edges), 1, 0) + b"".join(write(NODE, x) for x in nodes) + b"".join(write(EDGE, x) for x in edges)
    return body + block_hash(body, algorithm)


def inflate(data: bytes, flags: int) -> bytes:
    """The payload of a block whose flags may say it is compressed (zstd or lz4 frames)."""
    if not flags & COMPRESSED:
        return data
    which = flags >> 1 & 3
    if which == 1:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if which == 2:
        import pyarrow as pa

        with pa.CompressedInputStream(pa.BufferReader(data), "lz4") as stream:
            return stream.read()
    raise FormatError("unknown compression")


def deflate(data: bytes, which: int) -> bytes:
    if which == 1:
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    import pyarrow as pa

    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "lz4") as stream:
        stream.write(data)
    return out.getvalue().to_pybytes()


def file_header(data: bytes) -> dict:
    """The file header; other byte orders and major versions are refused."""
    if data[:8] != FILE_MAGIC:
        raise FormatError("no container")
    h, _ = read(FILE_LAYOUT, data)
    if h["endianness"] != 1:
        raise FormatError("only little-endian containers exist")
    if h["version"] >> 8 != 1:
        raise FormatError(f"unknown major version {h['version'] >> 8}")
    return h


def tag_status(data: bytes) -> str:
    """What is known of the seal of a container: plain ones have none, encrypted ones need a key."""
    return "missing_key" if file_header(data)["flags"] & ENCRYPTED else "not_encrypted"


def iter_blocks(data: bytes) -> list[dict]:
    """Blocks up to the end block and then the appendix, with raw payload, offset and own hash.

    A truncated block ends the walk, one shorter than its header is an error; encrypted
    containers have no readable block.
    """
    head = file_header(data)
    if head["flags"] & ENCRYPTED:
        return []
    algorithm = head["hash_algo"] if head["hash_algo"] in (0, 1, 2) else 0
    at, out, appendix = head["header_size"], [], False
    while at + BLOCK_HEADER <= len(data) and data[at : at + 4] == BLOCK_MAGIC:
        b, _ = read(BLOCK_LAYOUT, data, at)
        if b["length"] < BLOCK_HEADER:
            if appendix:
                break
            raise FormatError(f"block at {at} is shorter than its header")
        end = at + b["length"]
        if end > len(data):
            break
        payload = data[at + BLOCK_HEADER : end]
        b |= {"file_off": at, "payload": payload if appendix else inflate(payload, b["flags"]), "appendix": appendix, "hash": block_hash(data[at:end], algorithm)}
        out.append(b)
        appendix = appendix or b["type"] == END
        at = end
    return out


@dataclass
class ContainerWriter:
    """Builds a container: chained blocks, end block with the file's hash, optional graph appendix."""

    pid: int = 0
    os: int = 1
    arch: int = 1
    ts_ns: int = 0
    dump_uuid: bytes = bytes(16)
    imported: bool = False
    algorithm: int = 0
    compression: int = 0
    blocks: list[tuple[int, bytes, bytes, bytes, int]] = field(default_factory=list)
    appendix: bytes = b""

    def add(self, kind: int, payload: bytes, uuid: bytes | None = None, parent: bytes = bytes(16), flags: int = 0) -> bytes:
        uuid = uuid or uuids.uuid5(uuids.UUID(bytes=self.dump_uuid), f"{kind}-{len(self.blocks)}").bytes
        if self.compression:
            payload, flags = deflate(payload, self.compression), flags | COMPRESSED | self.compression << 1
        self.blocks.append((kind, payload, uuid, parent, flags))
        return uuid

    def add_record(self, kind: int, record: dict, **where) -> bytes:
        return self.add(kind, write(LAYOUTS[kind][1], record), **where)

    def add_table(self, kind: int, rows: list[dict], **where) -> bytes:
        return self.add(kind, write_table(kind, rows), **where)

    def add_region(self, record: dict, states: list[int], data: bytes, **where) -> bytes:
        return self.add(REGION, write_region(record, states, data), **where)

    def set_graph(self, nodes: list[dict], edges: list[dict]) -> None:
        self.appendix = self._block(GRAPH, write_graph(nodes, edges, self.algorithm), bytes(16), bytes(16), 0, bytes(32))

    @staticmethod
    def _block(kind: int, payload: bytes, uuid: bytes, parent: bytes, flags: int, prev: bytes) -> bytes:
        return write(BLOCK_LAYOUT, {"magic": BLOCK_MAGIC, "type": kind, "flags": flags, "length": BLOCK_HEADER + len(payload), "payload_version": 1, "uuid": uuid, "parent": parent, "prev_hash": prev}) + payload

    def to_bytes(self) -> bytes:
        cap = 0
        for kind, *_ in self.blocks:
            cap |= 1 << (kind & 63)
        head = write(FILE_LAYOUT, {"magic": FILE_MAGIC, "endianness": 1, "header_size": FILE_HEADER, "version": 0x0101, "flags": IMPORTED if self.imported else 0, "cap_bitmap": cap, "dump_uuid": self.dump_uuid, "ts_ns": self.ts_ns, "os": self.os, "arch": self.arch, "pid": self.pid, "block_count": len(self.blocks) + 1, "hash_algo": self.algorithm})
        out, prev = [head], bytes(32)
        for kind, payload, uuid, parent, flags in self.blocks:
            out.append(self._block(kind, payload, uuid, parent, flags, prev))
            prev = block_hash(out[-1], self.algorithm)
        end = write(LAYOUTS[END][1], {"file_hash": block_hash(b"".join(out), self.algorithm), "acq_end_ns": self.ts_ns})
        out.append(self._block(END, end, bytes(16), bytes(16), 0, prev))
        return b"".join(out) + self.appendix

    def sealed_parts(self, nonce: bytes) -> tuple[bytes, bytes]:
        """Header and plain block stream of a sealed container: no chain, no block count."""
        if len(nonce) != 12:
            raise ValueError("the nonce has 12 bytes")
        head = write(FILE_LAYOUT, {"magic": FILE_MAGIC, "endianness": 1, "header_size": 128, "version": 0x0101, "flags": ENCRYPTED, "dump_uuid": self.dump_uuid, "ts_ns": self.ts_ns, "os": self.os, "arch": self.arch, "pid": self.pid, "hash_algo": self.algorithm})
        head += struct.pack("<BBBxIIBxH24s16s8x", 1, 0, 0, 0, 0, 0, 0, nonce, b"")
        out = [self._block(kind, payload, uuid, parent, flags, bytes(32)) for kind, payload, uuid, parent, flags in self.blocks]
        end = write(LAYOUTS[END][1], {"file_hash": block_hash(head + b"".join(out), self.algorithm), "acq_end_ns": self.ts_ns})
        out.append(self._block(END, end, bytes(16), bytes(16), 0, bytes(32)))
        return head, b"".join(out) + self.appendix


def import_raw(data: bytes, secrets: list[tuple[bytes, int, int]] = (), page_log2: int = 12, source_name: str = "", algorithm: int = 0, **header) -> bytes:
    """A raw image as a container: one region at address 0, padded to pages, and a key hint at the
    first occurrence of each secret (value, key type, protocol)."""
    page = 1 << page_log2
    padded = data + bytes(-len(data) % page)
    w = ContainerWriter(imported=True, algorithm=algorithm, **header)
    w.add_record(0x0030, {"tool": "bytefold", "orig_size": len(data), "note": source_name, "source_hash": block_hash(data, algorithm)})
    region = w.add_region({"size": len(padded), "prot": 3, "page_log2": page_log2}, [0] * (len(padded) // page), padded, flags=HAS_KEY_HINTS if secrets else 0)
    for value, key_type, protocol in secrets:
        at = data.find(value) if value else -1
        if at >= 0:
            w.add_record(0x0020, {"region_uuid": region, "offset": at, "key_length": len(value), "key_type": key_type, "protocol": protocol, "confidence": 2})
    return w.to_bytes()
