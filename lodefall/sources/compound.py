"""Compound files (the container of Outlook messages and older workbooks), for one file at a time inside a task.

Chains of sectors and the folder tree are followed with every sector and entry taken once at most, so cyclic and cut ones end. What isn't such
a file, and encrypted workbooks, raise ValueError.
"""

from __future__ import annotations

import re
import struct
from datetime import UTC, datetime, timedelta

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
#: Sector numbers from here on are marks, not sectors.
MARKS = 0xFFFFFFFA


class Compound:
    """The streams of a compound file by their path; storages are the parts of a path but the last."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("no compound file")
        sector, mini = (1 << min(x, 16) for x in struct.unpack_from("<HH", data, 30))
        first, cutoff, mini_at, _, more, n_more = struct.unpack_from("<I4xIIIII", data, 48)
        self.data, self.sector, self.cutoff = data, sector, cutoff
        listed = list(struct.unpack_from("<109I", data, 76))
        for _ in range(min(n_more, len(data) // sector)):
            part = self.at(more)
            if len(part) < sector:
                break
            *entries, more = struct.unpack(f"<{sector // 4}I", part)
            listed += entries
        self.next: list[int] = []
        for s in listed:
            if s < MARKS and len(part := self.at(s)) == sector:
                self.next += struct.unpack(f"<{sector // 4}I", part)
        self.entries = self.table(self.chain(first))
        mini_next = self.chain(mini_at)
        self.mini_next = list(struct.unpack(f"<{len(mini_next) // 4}I", mini_next[: len(mini_next) // 4 * 4]))
        self.mini_size, self.mini = mini, self.chain(self.entries[0][4]) if self.entries else b""
        self.streams: dict[tuple[str, ...], tuple[int, int]] = {}
        self.walk()

    def at(self, k: int) -> bytes:
        return self.data[(k + 1) * self.sector : (k + 2) * self.sector]

    def chain(self, k: int) -> bytes:
        parts, seen = [], set()
        while k < len(self.next) and k not in seen:
            seen.add(k)
            parts.append(self.at(k))
            k = self.next[k]
        return b"".join(parts)

    def mini_chain(self, k: int) -> bytes:
        parts, seen = [], set()
        while k < len(self.mini_next) and k not in seen:
            seen.add(k)
            parts.append(self.mini[k * self.mini_size : (k + 1) * self.mini_size])
            k = self.mini_next[k]
        return b"".join(parts)

    @staticmethod
    def table(data: bytes) -> list[tuple[str, int, tuple[int, int], int, int, int]]:
        """Name, type, siblings, child, first sector and size of each entry."""
        out = []
        for at in range(0, len(data) - 127, 128):
            size, kind, left, right, child, start, length = struct.unpack_from("<HBxIII36xII", data, at + 64)
            out.append((data[at : at + min(max(size - 2, 0), 64)].decode("utf-16-le", "replace"), kind, (left, right), child, start, length))
        return out

    def walk(self) -> None:
        todo, seen = [(self.entries[0][3], ())] if self.entries else [], set()
        while todo:
            k, above = todo.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            name, kind, near, child, start, length = self.entries[k]
            todo += [(x, above) for x in near]
            if kind == 1:
                todo.append((child, (*above, name)))
            elif kind == 2:
                self.streams[*above, name] = (start, length)

    def read(self, *path: str) -> bytes:
        """A stream's bytes; none where there is no such stream."""
        if path not in self.streams:
            return b""
        start, length = self.streams[path]
        return (self.mini_chain(start) if length < self.cutoff else self.chain(start))[:length]

    def storages(self, pattern: str) -> list[str]:
        return sorted({p[0] for p in self.streams if len(p) > 1 and re.fullmatch(pattern, p[0])})


# --- messages -----------------------------------------------------------------------------------------------------------

#: Numbers of the properties that a record needs, each with those to take where it is missing.
SUBJECT, SENDER, SENDER_MAIL, BODY, HEADERS, LONG_NAME, SHORT_NAME = (0x0037,), (0x0C1A, 0x0042), (0x5D01, 0x0C1F, 0x0065), (0x1000,), (0x007D,), (0x3707,), (0x3704, 0x3001)
NAME, MAIL, SHOWN_TO, SHOWN_CC, KIND, TIMES = (0x3001,), (0x39FE, 0x3003), (0x0E04,), (0x0E03,), 0x0C15, (0x0039, 0x0E06)


def message(content: bytes) -> dict:
    """What a message holds: subject, sender, sender_email, recipients (to, then copies), date, body and names of attachments."""
    file = Compound(content)

    def text(numbers: tuple[int, ...], *above: str) -> str:
        for n in numbers:
            if found := file.read(*above, f"__substg1.0_{n:04X}001F"):
                return found.decode("utf-16-le", "replace").rstrip("\0").strip()
            if found := file.read(*above, f"__substg1.0_{n:04X}001E"):
                return found.decode("cp1252", "replace").rstrip("\0").strip()
        return ""

    def fixed(header: int, *above: str) -> dict[int, bytes]:
        data = file.read(*above, "__properties_version1.0")
        return {struct.unpack_from("<I", data, at)[0] >> 16: data[at + 8 : at + 16] for at in range(header, len(data) - 15, 16)}

    people: dict[int, list[str]] = {1: [], 2: []}
    for storage in file.storages(r"__recip_version1\.0_#[0-9A-F]+"):
        name, address = text(NAME, storage), text(MAIL, storage)
        kind = int.from_bytes(fixed(8, storage).get(KIND, b"\1")[:4], "little")
        shown = f"{name} <{address}>" if address and name and name != address else address or name
        if shown and kind in people:
            people[kind].append(shown)
    if not any(people.values()):
        people = {k: [x.strip() for x in text(n).split(";") if x.strip()] for k, n in ((1, SHOWN_TO), (2, SHOWN_CC))}
    attached = [text(LONG_NAME, s) or text(SHORT_NAME, s) for s in file.storages(r"__attach_version1\.0_#[0-9A-F]+")]
    times, date = fixed(32), ""
    if m := re.search(r"^Date:[ \t]*(.+)$", text(HEADERS), re.M | re.I):
        date = m[1].strip()
    elif found := next((times[n] for n in TIMES if any(times.get(n, b""))), None):
        date = (datetime(1601, 1, 1, tzinfo=UTC) + timedelta(microseconds=min(int.from_bytes(found, "little") // 10, 2**57))).strftime("%Y-%m-%d %H:%M:%S+00:00")
    return {"subject": text(SUBJECT), "sender": text(SENDER), "sender_email": text(SENDER_MAIL), "recipients": people[1] + people[2], "date": date, "body": text(BODY), "attachments": [x for x in attached if x]}


# --- workbooks ----------------------------------------------------------------------------------------------------------

#: Numbers of the records that matter.
BOF, EOF, SHEET, STRINGS, CONTINUE, LOCKED = 0x0809, 0x000A, 0x0085, 0x00FC, 0x003C, 0x002F
TEXT_AT, LABEL, RICH, NUMBER, SHORT, SHORTS, FORMULA, FORMULA_TEXT, TRUTH = 0x00FD, 0x0204, 0x00D6, 0x0203, 0x027E, 0x00BD, 0x0006, 0x0207, 0x0205


def records(data: bytes, at: int = 0) -> list[tuple[int, list[bytes]]]:
    """Records from a place to the end of its part, each with those that continue it."""
    out: list[tuple[int, list[bytes]]] = []
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        body, at = data[at + 4 : at + 4 + size], at + 4 + size
        if kind == CONTINUE and out:
            out[-1][1].append(body)
            continue
        out.append((kind, [body]))
        if kind == EOF:
            break
    return out


class Parts:
    """The bytes of a record over its continuations. Letters that go on in the next one begin with their width anew."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts, self.k, self.at = parts, 0, 0

    def left(self) -> int:
        while self.at >= len(self.parts[self.k]) and self.k + 1 < len(self.parts):
            self.k, self.at = self.k + 1, 0
        return len(self.parts[self.k]) - self.at

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and (left := self.left()) > 0:
            some = min(n - len(out), left)
            out += self.parts[self.k][self.at : self.at + some]
            self.at += some
        return out

    def text(self, size_bytes: int = 2) -> str:
        n = int.from_bytes(self.take(size_bytes), "little")
        flags = (self.take(1) or b"\0")[0]
        runs = int.from_bytes(self.take(2), "little") if flags & 8 else 0
        extra = int.from_bytes(self.take(4), "little") if flags & 4 else 0
        out, wide = [], flags & 1
        while n > 0:
            left = len(self.parts[self.k]) - self.at
            if left <= 0:
                if self.k + 1 >= len(self.parts):
                    break
                self.k, self.at = self.k + 1, 0
                wide = (self.take(1) or b"\0")[0] & 1
                continue
            some = min(n, left // 2 if wide else left)
            if some == 0:
                self.at += left
                continue
            raw = self.parts[self.k][self.at : self.at + (2 * some if wide else some)]
            out.append(raw.decode("utf-16-le" if wide else "latin-1", "replace"))
            self.at += len(raw)
            n -= some
        self.take(4 * runs + extra)
        return "".join(out)


def number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def short(raw: bytes) -> float:
    """A number in 30 bits: whole or the upper part of a double, and maybe a hundred times the value."""
    x = int.from_bytes(raw, "little")
    value = float(struct.unpack("<i", raw)[0] >> 2) if x & 2 else struct.unpack("<d", b"\0" * 4 + (x & ~3).to_bytes(4, "little"))[0]
    return value / 100 if x & 1 else value


def cells(data: bytes, at: int, shared: list[str]) -> dict[int, dict[int, str]]:
    """Texts of a sheet's cells by row and column."""
    rows: dict[int, dict[int, str]] = {}
    waits = None
    for kind, parts in records(data, at):
        body = parts[0]
        if kind == FORMULA_TEXT and waits:
            rows.setdefault(waits[0], {})[waits[1]] = Parts(parts).text()
            waits = None
        if kind not in (TEXT_AT, LABEL, RICH, NUMBER, SHORT, SHORTS, FORMULA, TRUTH) or len(body) < 8:
            continue
        row, column = struct.unpack_from("<HH", body)
        put = lambda c, x: rows.setdefault(row, {}).__setitem__(c, x)  # noqa: B023, E731
        if kind == TEXT_AT:
            k = struct.unpack_from("<I", body, 6)[0] if len(body) >= 10 else len(shared)
            put(column, shared[k] if k < len(shared) else "")
        elif kind in (LABEL, RICH):
            put(column, Parts([body[6:], *parts[1:]]).text())
        elif kind == NUMBER and len(body) >= 14:
            put(column, number(struct.unpack_from("<d", body, 6)[0]))
        elif kind == SHORT and len(body) >= 10:
            put(column, number(short(body[6:10])))
        elif kind == SHORTS:
            for k in range((len(body) - 6) // 6):
                put(column + k, number(short(body[6 + 6 * k : 10 + 6 * k])))
        elif kind == TRUTH:
            put(column, str(body[6]) if not body[7] else f"#{body[6]}")
        elif kind == FORMULA and len(body) >= 14:
            if body[12:14] != b"\xff\xff":
                put(column, number(struct.unpack_from("<d", body, 6)[0]))
            elif body[6] == 0:
                waits = (row, column)
            elif body[6] == 1:
                put(column, str(body[8]))
    return rows


def sheets(content: bytes) -> list[tuple[str, str]]:
    """sheet01, sheet02 ... and the text of each worksheet: rows as lines, cells between tabs; empty ones are left out, but a sheet keeps its number."""
    file = Compound(content)
    data = file.read("Workbook") or file.read("Book")
    if not data:
        raise ValueError("no workbook")
    shared: list[str] = []
    places: list[int] = []
    for kind, parts in records(data):
        if kind == LOCKED:
            raise ValueError("encrypted")
        if kind == STRINGS and len(parts[0]) >= 8:
            reader, n = Parts([parts[0][8:], *parts[1:]]), struct.unpack_from("<I", parts[0], 4)[0]
            while len(shared) < n and reader.left() > 0:
                shared.append(reader.text())
        elif kind == SHEET and len(parts[0]) >= 6 and parts[0][5] == 0:
            places.append(struct.unpack_from("<I", parts[0])[0])
    out = []
    for k, at in enumerate(places, 1):
        rows = cells(data, at, shared)
        lines = ([rows[r][c] for c in sorted(rows[r]) if rows[r][c].strip()] for r in sorted(rows))
        if text := "\n".join("\t".join(x) for x in lines if x).strip():
            out.append((f"sheet{k:02d}", text))
    return out
