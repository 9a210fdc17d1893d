"""Embedded programs on hand-made headers."""

import struct

from factloom.functions import binary


def elf64(segments=((0, 300),), sections=0):
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0, 64, 400 if sections else 0, 0, 64, 56, len(segments), 64, sections, 0)
    return head + b"".join(struct.pack("<IIQQQQQQ", 1, 5, at, 0, 0, size, size, 0) for at, size in segments)


def elf32(size):
    head = b"\x7fELF\x01\x01\x01" + bytes(9) + struct.pack("<HHIIIIIHHHHHH", 2, 3, 1, 0, 52, 0, 0, 52, 32, 1, 0, 0, 0)
    return head + struct.pack("<IIIIIIII", 1, 0, 0, 0, size, size, 5, 0)


def wasm(*sections):
    return b"\0asm\1\0\0\0" + b"".join(bytes([kind, len(body)]) + body for kind, body in sections)


def test_elf():
    assert binary.embedded_size(elf64().ljust(1000, b"x")) == 300
    assert binary.embedded_size(elf64(sections=3).ljust(1000, b"x")) == 400 + 3 * 64
    assert binary.embedded_size(elf64(((0, 100), (200, 250))).ljust(1000, b"x")) == 450
    assert binary.embedded_size(elf32(90).ljust(200, b"x")) == 90
    assert binary.embedded_size(elf64().ljust(299, b"x")) is None
    assert binary.embedded_size(elf64()[:100]) is None
    big = bytearray(elf64().ljust(1000, b"x"))
    big[5] = 2
    assert binary.embedded_size(bytes(big)) is None


def test_wasm():
    whole = wasm((1, b"abc"), (0, b"name"), (3, b""), (10, b"code"))
    for tail in (b"", b"\x7f rest", b"\x0a\x01x", b"\x0b\xff", b"\x0b\x64few"):
        assert binary.embedded_size(whole + tail) == len(whole)
    assert binary.embedded_size(b"\0asm\1\0\0") is None and binary.embedded_size(b"\0asm\1\0\0\0") == 8


def test_leb128():
    assert binary.leb128(b"\xe5\x8e\x26", 0) == (624485, 3)
    assert binary.leb128(b"x\x80", 1) is None and binary.leb128(b"\x80" * 11, 0) is None


def test_column(spark):
    df = spark.createDataFrame([(1, bytearray(elf64().ljust(500, b"x"))), (2, bytearray(b"")), (3, None), (4, bytearray(b"text"))], "id int, content binary")
    assert [r[0] for r in df.orderBy("id").select(binary.payload_size("content")).collect()] == [300, None, None, None]
