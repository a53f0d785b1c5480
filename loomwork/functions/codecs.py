"""Binary formats: sealed envelopes, history archives, event and command headers, payloads, stable ids."""

from __future__ import annotations

import re
import struct
import threading
import uuid
from dataclasses import dataclass

from .hashing import fnv1a64

#: Fixed values of the formats: magic bytes and versions.
ENVELOPE_MAGIC, ENVELOPE_VERSION = b"SPND", 1
ARCHIVE_MAGIC, ARCHIVE_VERSION = b"SPAR", 1
ENVELOPE = struct.Struct(">4sHQIIQ")
ARCHIVE_HEADER, ARCHIVE_RECORD = struct.Struct(">4sII"), struct.Struct(">QIqQII")


class FormatError(ValueError):
    """What is wrong with the bytes is in ``args[0]``."""


def seal(schema_id: int, version: int, payload: bytes) -> bytes:
    """An envelope: magic, format, schema, payload length and hash, payload."""
    if len(payload) > 0xFFFFFFFF:
        raise FormatError("LengthTooLarge")
    return ENVELOPE.pack(ENVELOPE_MAGIC, ENVELOPE_VERSION, schema_id, version, len(payload), fnv1a64(payload)) + payload


def unseal(raw: bytes, most: int) -> tuple[int, int, bytes]:
    """``(schema id, version, payload)`` of a whole, unharmed envelope with at most ``most`` bytes of payload."""
    if len(raw) < ENVELOPE.size:
        raise FormatError("Truncated")
    magic, form, schema_id, version, size, checksum = ENVELOPE.unpack_from(raw)
    for wrong, why in ((magic != ENVELOPE_MAGIC, "InvalidMagic"), (form != ENVELOPE_VERSION, "UnsupportedFormat"), (size > most, "LengthTooLarge"), (len(raw) != ENVELOPE.size + size, "LengthMismatch")):
        if wrong:
            raise FormatError(why)
    payload = bytes(raw[ENVELOPE.size :])
    if fnv1a64(payload) != checksum:
        raise FormatError("ChecksumMismatch")
    return schema_id, version, payload


@dataclass(frozen=True)
class ArchiveRecord:
    sequence: int
    kind: int
    utc_ms: int
    schema_id: int
    schema_version: int
    payload: bytes


def pack_archive(records: list[ArchiveRecord]) -> bytes:
    """History records of consecutive sequences behind a header, closed by the hash of all before."""
    if not records:
        raise FormatError("EmptyArchive")
    if any(b.sequence != a.sequence + 1 for a, b in zip(records, records[1:])):
        raise FormatError("InvalidSequence")
    body = ARCHIVE_HEADER.pack(ARCHIVE_MAGIC, ARCHIVE_VERSION, len(records))
    body += b"".join(ARCHIVE_RECORD.pack(r.sequence, r.kind, r.utc_ms, r.schema_id, r.schema_version, len(r.payload)) + r.payload for r in records)
    return body + struct.pack(">Q", fnv1a64(body))


def unpack_archive(raw: bytes) -> list[ArchiveRecord]:
    """The records of a whole, unharmed archive."""
    if len(raw) < ARCHIVE_HEADER.size + 8:
        raise FormatError("InvalidArchive")
    magic, version, count = ARCHIVE_HEADER.unpack_from(raw)
    if (magic, version) != (ARCHIVE_MAGIC, ARCHIVE_VERSION):
        raise FormatError("InvalidArchive")
    if not count:
        raise FormatError("EmptyArchive")
    end = len(raw) - 8
    if fnv1a64(raw[:end]) != struct.unpack_from(">Q", raw, end)[0]:
        raise FormatError("ChecksumMismatch")
    found, at = [], ARCHIVE_HEADER.size
    for _ in range(count):
        if at + ARCHIVE_RECORD.size > end:
            raise FormatError("InvalidArchive")
        *fields, size = ARCHIVE_RECORD.unpack_from(raw, at)
        at += ARCHIVE_RECORD.size
        if at + size > end:
            raise FormatError("InvalidArchive")
        found.append(ArchiveRecord(*fields, bytes(raw[at : at + size])))
        at += size
        if len(found) > 1 and found[-1].sequence != found[-2].sequence + 1:
            raise FormatError("InvalidSequence")
    if at != end:
        raise FormatError("InvalidArchive")
    return found


def event_header(sequence: int, kind: int, utc_ms: int, schema_id: int, schema_version: int) -> bytes:
    return struct.pack(">QIqQI", sequence, kind, utc_ms, schema_id, schema_version)


def command_header(sequence: int, kind: int, schema_id: int, schema_version: int) -> bytes:
    return struct.pack(">QIQI", sequence, kind, schema_id, schema_version)


def pack_timer(delay_ms: int, payload: bytes) -> bytes:
    return struct.pack(">Q", delay_ms) + payload


def unpack_timer(raw: bytes) -> tuple[int, bytes]:
    if len(raw) < 8:
        raise FormatError("InvalidTimerCommand")
    return struct.unpack_from(">Q", raw)[0], raw[8:]


#: What happens to an unfinished child when its parent ends: the numbers are fixed values of the format.
CLOSE_POLICIES = {1: "abandon", 2: "request_cancel", 3: "terminate"}


def pack_child(definition_id: int, definition_version: int, schema_id: int, schema_version: int, policy: int, payload: bytes) -> bytes:
    return struct.pack(">QIQIB", definition_id, definition_version, schema_id, schema_version, policy) + payload


def unpack_child(raw: bytes) -> tuple[int, int, int, int, int, bytes]:
    if len(raw) < 25 or raw[24] not in CLOSE_POLICIES:
        raise FormatError("InvalidChildCommand")
    return (*struct.unpack_from(">QIQIB", raw), raw[25:])


def pack_migration(version: int, identity: int, principal: bytes, reason: bytes) -> bytes:
    if max(len(principal), len(reason)) > 0xFFFF:
        raise FormatError("PayloadTooLarge")
    return struct.pack(">IQHH", version, identity, len(principal), len(reason)) + principal + reason


def pack_termination(principal: bytes, reason: bytes) -> bytes:
    if max(len(principal), len(reason)) > 0xFFFF:
        raise FormatError("PayloadTooLarge")
    return struct.pack(">HH", len(principal), len(reason)) + principal + reason


def snapshot_checksum(workflow_id: bytes, sequence: int, version: int, state: bytes) -> int:
    """The hash of id, sequence and version, mixed with that of the state."""
    return fnv1a64(workflow_id + struct.pack(">QI", sequence, version)) ^ fnv1a64(state)


def pack_resource_key(kind: int, namespace: bytes, name: bytes, page: int | None) -> bytes:
    tail = b"\0" if page is None else b"\1" + struct.pack(">Q", page)
    return bytes([kind]) + namespace + struct.pack(">I", len(name)) + name + tail


#: The schema of resource manifests.
MANIFEST_SCHEMA, MANIFEST_VERSION = 0x7370696E646C726D, 1
VERSION_STATES = ("tombstone", "present")


def pack_manifest(key: bytes, generation: int, state: str, content_hash: int | None, producer: bytes, location: bytes) -> bytes:
    """A resource's manifest in its envelope: packed key, generation, state, content hash if there is one, producer's id, where the artifact lies."""
    if len(location) > 0xFFFFFFFF:
        raise FormatError("ArtifactLocationTooLong")
    told = b"\0" if content_hash is None else b"\1" + struct.pack(">Q", content_hash)
    body = key + struct.pack(">QB", generation, VERSION_STATES.index(state)) + told + producer + struct.pack(">I", len(location)) + location
    return seal(MANIFEST_SCHEMA, MANIFEST_VERSION, body)


def unpack_manifest(raw: bytes, most: int, registered: set[tuple[int, int]]) -> dict[str, object]:
    """The parts of an unharmed manifest whose schema is registered."""
    schema_id, version, body = unseal(raw, most)
    if schema_id != MANIFEST_SCHEMA:
        raise FormatError("UnknownSchema")
    if version != MANIFEST_VERSION:
        raise FormatError("UnknownVersion")
    if (schema_id, version) not in registered:
        raise FormatError("UnknownSchema")
    at = 17 + 4 + struct.unpack_from(">I", body, 17)[0]
    at += 9 if body[at] else 1
    key, (generation, state, hashed) = body[:at], struct.unpack_from(">QBB", body, at)
    at += 10
    content = struct.unpack_from(">Q", body, at)[0] if hashed else None
    at += 8 if hashed else 0
    producer, (size,) = body[at : at + 16], struct.unpack_from(">I", body, at + 16)
    return {"key": key, "generation": generation, "state": VERSION_STATES[state], "content_hash": content, "producer": producer, "location": body[at + 20 : at + 20 + size]}


def derived_id(workflow_id: bytes, decision: int, sequence: int, kind: int) -> bytes:
    """Id of a task that a command makes. A hash of all parts: mixing them bit by bit would let different commands meet."""
    return uuid.uuid5(uuid.UUID(bytes=workflow_id), f"{decision}/{sequence}/{kind}").bytes


UUID_TEXT = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def parse_id(text: str) -> bytes:
    """Sixteen bytes of an id in canonical text."""
    if not UUID_TEXT.fullmatch(text):
        raise FormatError("InvalidStableId")
    return uuid.UUID(text).bytes


def format_id(raw: bytes) -> str:
    return str(uuid.UUID(bytes=raw))


class IdGenerator:
    """Time-ordered ids, version 7: they ascend even if the clock falls back, by a 12-bit sequence and then the next millisecond."""

    def __init__(self, entropy) -> None:
        self.entropy, self.ms, self.sequence, self.lock = entropy, -1, 0, threading.Lock()

    def next(self, utc_ms: int) -> bytes:
        with self.lock:
            if utc_ms > self.ms:
                self.ms, self.sequence = max(0, utc_ms), self.entropy.getrandbits(11)
            elif self.sequence < 0xFFF:
                self.sequence += 1
            else:
                self.ms, self.sequence = self.ms + 1, 0
            value = (self.ms & ((1 << 48) - 1)) << 80 | 7 << 76 | self.sequence << 64 | 2 << 62 | self.entropy.getrandbits(62)
            return value.to_bytes(16, "big")
