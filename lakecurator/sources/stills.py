"""Size and capture time of stills, read from their headers; formats that aren't known here go to an image library where one is installed."""

from __future__ import annotations

import io
import struct

#: EXIF tags of the original date and its offset, and of the directory that holds them.
EXIF_DIRECTORY, ORIGINAL, OFFSET = 0x8769, 0x9003, 0x9011
#: JPEG markers of frames, which hold the size; C4, C8 and CC are tables.
_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
#: JPEG markers without a length.
_BARE = {0x01, *range(0xD0, 0xD9)}


def exif_time(date: str | None, offset: str | None) -> str | None:
    """ISO text of an EXIF date; the offset is added if it looks like one, and unset dates give None."""
    text = (date or "").strip("\x00 ")
    if len(text) < 19 or not text[:4].strip("0 :"):
        return None
    iso = f"{text[:10].replace(':', '-')}T{text[11:19]}"
    zone = (offset or "").strip("\x00 ")
    return iso + zone if len(zone) == 6 and zone[0] in "+-" else iso


def exif_tags(tiff: bytes) -> dict[int, str]:
    """The text tags of the EXIF directory of a TIFF block; what doesn't fit in it is left out."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return {}

    def directory(at: int) -> list[tuple[int, int, int, bytes]]:
        if at + 2 > len(tiff):
            return []
        n = struct.unpack_from(f"{order}H", tiff, at)[0]
        n = min(n, (len(tiff) - at - 2) // 12)
        return [(*struct.unpack_from(f"{order}HHI", tiff, at + 2 + 12 * i), tiff[at + 10 + 12 * i : at + 14 + 12 * i]) for i in range(n)]

    number = lambda raw: struct.unpack(f"{order}I", raw)[0]
    below = [number(raw) for tag, _, _, raw in directory(number(tiff[4:8])) if tag == EXIF_DIRECTORY]
    found = {}
    for tag, kind, count, raw in directory(below[0]) if below else []:
        if kind == 2:  # text
            value = raw[:count] if count <= 4 else tiff[number(raw) : number(raw) + count]
            found[tag] = value.decode("latin-1")
    return found


def _jpeg(data: bytes) -> dict:
    out, at = {}, 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF or marker in _BARE:  # padding, or no segment
            at += 1 if marker == 0xFF else 2
            continue
        length = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        if marker in _FRAMES and len(body) >= 5:
            height, width = struct.unpack_from(">HH", body, 1)
            return out | {"width": width, "height": height}
        if marker == 0xE1 and body.startswith(b"Exif\x00\x00") and "own_time" not in out:
            tags = exif_tags(body[6:])
            out["own_time"] = exif_time(tags.get(ORIGINAL), tags.get(OFFSET))
        if marker == 0xDA or length < 2:  # the picture itself, or no JPEG
            break
        at += 2 + length
    return out


def _heif(data: bytes) -> dict:
    """The largest of the sizes that a file's items have: tiles and previews are smaller than the picture."""
    sizes, at = [], data.find(b"ispe")
    while at >= 0:
        if at + 16 <= len(data):
            sizes.append(struct.unpack_from(">II", data, at + 8))
        at = data.find(b"ispe", at + 4)
    if not sizes:
        return {}
    width, height = max(sizes, key=lambda s: s[0] * s[1])
    exif = data.find(b"Exif\x00\x00")
    tags = exif_tags(data[exif + 6 :]) if exif >= 0 else {}
    return {"width": width, "height": height, "own_time": exif_time(tags.get(ORIGINAL), tags.get(OFFSET))}


def header_facts(data: bytes) -> dict:
    """width, height and own_time, as far as the header of a JPEG, PNG, GIF or HEIF file tells them."""
    if data[:2] == b"\xff\xd8":
        return _jpeg(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        return dict(zip(("width", "height"), struct.unpack_from(">II", data, 16)))
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return dict(zip(("width", "height"), struct.unpack_from("<HH", data, 6)))
    if data[4:8] == b"ftyp" and data[8:12] in (b"heic", b"heix", b"mif1", b"hevc", b"avif"):
        return _heif(data)
    return {}


def still_facts(data: bytes) -> dict:
    found = header_facts(data)
    if "width" in found:
        return {"own_time": None} | found
    try:
        from PIL import Image
    except ImportError:
        return found
    with Image.open(io.BytesIO(data)) as image:
        tags = image.getexif().get_ifd(EXIF_DIRECTORY)
        return {"width": image.width, "height": image.height, "own_time": exif_time(tags.get(ORIGINAL), tags.get(OFFSET))}
