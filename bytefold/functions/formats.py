"""Binary formats by their magic bytes, as one CASE over the first bytes of an image."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magic bytes at offset 0, in order of precedence.
MAGICS = {
    "macho64_le": "CFFAEDFE",
    "macho32_le": "CEFAEDFE",
    "macho64_be": "FEEDFACF",
    "macho32_be": "FEEDFACE",
    "msl": "4D454D534C494345",
    "sqlite3": "53514C69746520666F726D6174203300",
    "gzip": "1F8B",
    "zip": "504B0304",
    "png": "89504E470D0A1A0A",
    "pdf": "25504446",
}


def _at(data: Column, offset: Column | int, size: int) -> Column:
    start = F.lit(offset + 1) if isinstance(offset, int) else offset + 1
    return F.hex(F.substring(data, start, F.lit(size)))


def _little(data: Column, offset: Column | int, size: int) -> Column:
    """An unsigned little-endian integer; null beyond the end."""
    start = F.lit(offset + 1) if isinstance(offset, int) else offset + 1
    part = F.substring(data, start, F.lit(size))
    turned = F.concat(*(F.substring(F.hex(part), 2 * i + 1, 2) for i in range(size - 1, -1, -1)))
    return F.when(F.octet_length(part) == size, F.conv(turned, 16, 10).cast("bigint"))


def detect_format(data: Column) -> Column:
    """The format of a binary column, or null.  Less than 4 bytes have none."""
    size = F.octet_length(data)
    c = F.when(size < 4, None)
    elf = F.when(_at(data, 4, 1) == "02", "elf64").when(_at(data, 4, 1) == "01", "elf32").otherwise("elf")
    c = c.when(_at(data, 0, 4) == "7F454C46", elf)
    for name, magic in MAGICS.items():
        c = c.when(_at(data, 0, len(magic) // 2) == magic, name)
    new_header = _little(data, 0x3C, 4)
    is_pe = (_at(data, 0, 2) == "4D5A") & (size >= 64) & (new_header < 0x7FFFFF00) & (_at(data, new_header.cast("int"), 4) == "50450000")
    c = c.when(is_pe, F.when(_at(data, (new_header + 24).cast("int"), 2) == "0B02", "pe64").otherwise("pe32"))
    fat = F.conv(_at(data, 4, 4), 16, 10).cast("bigint")
    c = c.when((size >= 8) & (_at(data, 0, 4) == "CAFEBABE"), F.when(fat <= 30, "macho_fat").otherwise("java_class"))
    return c.when((_at(data, 0, 2) == "3082") & (F.conv(_at(data, 2, 2), 16, 10).cast("int") >= 64), "asn1_der")


def suggest_formats(data: Column) -> Column:
    """Formats that the first bytes suggest, as ``array<struct<format, reason, magic_ok>>``; none for an empty image.

    Magic numbers come in the order of ``MAGICS`` behind ELF, then PE, then the two that share one.
    """
    one = lambda name, reason: F.struct(name.alias("format"), reason.alias("reason"), F.lit(True).alias("magic_ok"))
    start, size = F.lit("magic at 0x0"), F.octet_length(data)
    elf = F.when(_at(data, 4, 1) == "02", "elf64").when(_at(data, 4, 1) == "01", "elf32").otherwise("elf")
    out = [F.when(_at(data, 0, 4) == "7F454C46", one(elf, start))]
    out += [F.when(_at(data, 0, len(magic) // 2) == magic, one(F.lit(name), start)) for name, magic in MAGICS.items()]
    header = _little(data, 0x3C, 4)
    is_pe = (_at(data, 0, 2) == "4D5A") & (size >= 64) & (header < 0x7FFFFF00) & (_at(data, header.cast("int"), 4) == "50450000")
    pe = F.when(_at(data, (header + 24).cast("int"), 2) == "0B02", "pe64").otherwise("pe32")
    out.append(F.when(is_pe, one(pe, F.concat(F.lit("PE signature at 0x"), F.hex(header)))))
    fat = F.conv(_at(data, 4, 4), 16, 10).cast("bigint")
    out.append(F.when((size >= 8) & (_at(data, 0, 4) == "CAFEBABE"), one(F.when(fat <= 30, "macho_fat").otherwise("java_class"), start)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def parse_hex_pattern(text: Column) -> Column:
    """Bytes of a hex pattern with blanks; null if it is none."""
    return F.try_to_binary(F.replace(text, F.lit(" "), F.lit("")), F.lit("hex"))


def little_endian(data: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian field of up to 7 bytes; 8 bytes as a decimal that holds any address."""
    if size < 8:
        return _little(data, offset, size)
    turned = F.concat(*(F.substring(F.hex(F.substring(data, F.lit(offset + 1), F.lit(8))), 2 * i + 1, 2) for i in range(7, -1, -1)))
    return F.when(F.octet_length(data) >= offset + 8, F.conv(turned, 16, 10).cast("decimal(20,0)"))
