"""Facts from media headers: size, duration and capture time of MP4 and MOV files, read without a media library."""

from __future__ import annotations

import datetime
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

#: Extensions of media files.
VIDEO = (".mp4", ".mov", ".m4v", ".3gp")
STILL = (".jpg", ".jpeg", ".heic", ".heif", ".hif", ".png", ".gif", ".webp", ".bmp", ".tif", ".tiff", ".dng")
#: Seconds from 1904 to 1970, and how Apple's capture time is written.
EPOCH_1904 = 2082844800
CREATION_KEY = b"com.apple.quicktime.creationdate"
CREATION_DATE = re.compile(rb"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)([+-]\d{4}|Z)")


def is_video(ext: str) -> bool:
    return ext.lower() in VIDEO


def is_media(ext: str) -> bool:
    return ext.lower() in VIDEO + STILL


@dataclass(frozen=True)
class Edges:
    """A file known by its first and last bytes; small files are known whole, by their first bytes alone."""

    head: bytes
    tail: bytes = b""
    size: int = -1

    @property
    def total(self) -> int:
        return len(self.head) if self.size < 0 else self.size

    def span(self, start: int, end: int) -> bytes | None:
        """Bytes [start, end), or None where they aren't known."""
        if end <= len(self.head):
            return self.head[start:end]
        offset = self.total - len(self.tail)
        return self.tail[start - offset : end - offset] if offset <= start and end <= self.total else None


def boxes(file: Edges, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, content start, end) of the boxes from start on; ends where a size can't be."""
    while start + 8 <= end and (head := file.span(start, start + 8)):
        size, kind, skip = *struct.unpack(">I4s", head), 8
        if size == 1 and (long := file.span(start + 8, start + 16)):
            size, skip = int.from_bytes(long, "big"), 16
        elif size == 0:
            size = end - start
        if size < skip or start + size > end:
            return
        yield kind, start + skip, start + size
        start += size


def _movie(file: Edges) -> Edges | None:
    """The movie box's content; the whole file's bytes are never searched for it, only its box structure."""
    for kind, start, end in boxes(file, 0, file.total):
        if kind == b"moov":
            content = file.span(start, end)
            return None if content is None else Edges(content)
    return None


def _inside(box: Edges, wanted: bytes) -> Iterator[Edges]:
    for kind, start, end in boxes(box, 0, box.total):
        if kind == wanted:
            yield Edges(box.head[start:end])


def _header(movie: Edges) -> tuple[int, float | None] | None:
    """(creation in unix seconds or 0, duration in seconds) of the movie header."""
    for header in _inside(movie, b"mvhd"):
        created, _, scale, length = struct.unpack(">QQIQ", header.head[4:32]) if header.head[0] == 1 else struct.unpack(">IIII", header.head[4:20])
        return (created - EPOCH_1904 if created else 0), (length / scale if scale else None)
    return None


def _frame(movie: Edges) -> tuple[int, int] | None:
    """Width and height of the first track that has them; sound has none."""
    for track in _inside(movie, b"trak"):
        for header in _inside(track, b"tkhd"):
            at = 88 if header.head[0] == 1 else 76
            if len(header.head) >= at + 8:
                width, height = (x >> 16 for x in struct.unpack(">II", header.head[at : at + 8]))
                if width and height:
                    return width, height
            break
    return None


def _captured(movie: Edges, header: tuple[int, float | None] | None) -> int | None:
    """Apple's capture time where it is written, else the movie's creation, which a re-encoding may have set."""
    at = movie.head.find(CREATION_KEY)
    if at >= 0 and (found := CREATION_DATE.search(movie.head, at)):
        text, zone = (x.decode() for x in found.groups())
        return int(datetime.datetime.fromisoformat(text + ("+00:00" if zone == "Z" else f"{zone[:3]}:{zone[3:]}")).timestamp())
    return header[0] or None if header else None


def probe(file: Edges, ext: str) -> dict:
    """width, height, duration_s and own_time, each None if unknown; own_time is ISO text with an offset, or naive local time."""
    out: dict = {"width": None, "height": None, "duration_s": None, "own_time": None}
    if is_video(ext):
        if movie := _movie(file):
            header, frame = _header(movie), _frame(movie)
            if frame:
                out["width"], out["height"] = frame
            if header:
                out["duration_s"] = header[1]
            if taken := _captured(movie, header):
                out["own_time"] = datetime.datetime.fromtimestamp(taken, datetime.timezone.utc).isoformat()
        return out
    from .stills import still_facts

    return out | still_facts(file.head)
