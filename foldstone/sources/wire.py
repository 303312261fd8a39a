"""The binary record format (A7, A8): length-prefixed frames of protobuf messages.

Messages are read and written by field number, straight from the wire format, so no
generated classes are needed.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import BinaryIO

#: Nine bytes at the head of a framed file; give another to read files of other writers.
MAGIC = b"FSTN-PB1\n"

#: Field numbers of the messages (fixed values of the format).
RECORD_TEXT = {1: "collection", 2: "key", 3: "title", 4: "body", 8: "mutation_id"}
RECORD_NUMBER = {6: "version", 7: "updated_at_unix_ms"}
RECORD_METADATA = 5
LOG_OPERATION, LOG_RECORD, LOG_COLLECTION, LOG_KEY = 1, 2, 3, 4
ENTRY_RECORD, ENTRY_VECTOR = 1, 2
OPERATIONS = {1: "P", 2: "D"}

EMPTY = {"collection": "", "key": "", "title": "", "body": "", "metadata": {}, "version": 0, "updated_at_unix_ms": 0, "mutation_id": ""}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("broken number")
        b = data[at]
        n |= (b & 0x7F) << shift
        at += 1
        if b < 0x80:
            return n, at
        shift += 7


def _chunk(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n) if n else b""


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field; unknown kinds of equal size are passed over."""
    at = 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _read_varint(data, at)
        elif kind == 2:
            size, at = _read_varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        if at > len(data):
            raise ValueError("field runs past the message")
        yield tag >> 3, value


def encode_record(r: dict) -> bytes:
    out = b""
    for field in range(1, 9):
        if field in RECORD_TEXT:
            text = (r.get(RECORD_TEXT[field]) or "").encode()
            out += _chunk(field, text) if text else b""
        elif field in RECORD_NUMBER:
            out += _number(field, r.get(RECORD_NUMBER[field]) or 0)
        else:
            for k, v in sorted((r.get("metadata") or {}).items()):
                out += _chunk(field, _chunk(1, k.encode()) + _chunk(2, (v or "").encode()))
    return out


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def decode_record(data: bytes) -> dict:
    out = {**EMPTY, "metadata": {}}
    for field, value in fields(data):
        if field in RECORD_TEXT:
            out[RECORD_TEXT[field]] = value.decode()
        elif field in RECORD_NUMBER:
            out[RECORD_NUMBER[field]] = _signed(value)
        elif field == RECORD_METADATA:
            pair = dict(fields(value))
            out["metadata"][pair.get(1, b"").decode()] = pair.get(2, b"").decode()
    return out


def encode_log_entry(op: str, r: dict) -> bytes:
    if op == "P":
        return _number(LOG_OPERATION, 1) + _chunk(LOG_RECORD, encode_record(r))
    return _number(LOG_OPERATION, 2) + _chunk(LOG_COLLECTION, (r.get("collection") or "").encode()) + _chunk(LOG_KEY, (r.get("key") or "").encode())


def decode_log_entry(data: bytes) -> tuple[str, dict]:
    """(operation, record); anything but a delete is a put."""
    got = dict(fields(data))
    if got.get(LOG_OPERATION) == 2:
        return "D", {**EMPTY, "collection": got.get(LOG_COLLECTION, b"").decode(), "key": got.get(LOG_KEY, b"").decode()}
    return "P", decode_record(got.get(LOG_RECORD, b""))


def encode_vector_entry(r: dict, vector: list[float]) -> bytes:
    return _chunk(ENTRY_RECORD, encode_record(r)) + (_chunk(ENTRY_VECTOR, struct.pack(f"<{len(vector)}f", *vector)) if vector else b"")


def decode_vector_entry(data: bytes) -> tuple[dict, list[float]]:
    record, vector = {**EMPTY, "metadata": {}}, []
    for field, value in fields(data):
        if field == ENTRY_RECORD:
            record = decode_record(value)
        elif field == ENTRY_VECTOR:  # packed, or one number each
            vector += struct.unpack(f"<{len(value) // 4}f", value)
    return record, vector


def frame(payload: bytes) -> bytes:
    return struct.pack("<I", len(payload)) + payload


def frames(source: bytes | BinaryIO, magic: bytes = MAGIC) -> Iterator[bytes]:
    """The payloads of a framed file, one at a time; a missing head or a cut-off frame is
    an error."""
    stream = io.BytesIO(source) if isinstance(source, bytes) else source
    if stream.read(len(magic)) != magic:
        raise ValueError("not a framed file: its head is missing")
    while head := stream.read(4):
        if len(head) < 4:
            raise ValueError("cut off within a frame's size")
        (size,) = struct.unpack("<I", head)
        payload = stream.read(size)
        if len(payload) < size:
            raise ValueError("cut off within a frame")
        yield payload
