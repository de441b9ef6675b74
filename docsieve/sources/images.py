"""What the headers of image files say, without an image library."""

from __future__ import annotations

import struct


def profile(data: bytes) -> dict[str, int]:
    """width, height and channels of a PNG or JPEG; other bytes raise ValueError."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        width, height, _, color = struct.unpack(">IIBB", data[16:26])
        return {"width": width, "height": height, "channels": {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color, 0)}
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return {"width": width, "height": height, "channels": data[at + 9]}
            at += 2 + size
    raise ValueError("neither PNG nor JPEG")
