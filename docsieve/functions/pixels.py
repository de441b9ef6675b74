"""Images as arrays: PNG in and out, grey levels, colour, components, matching, masks, skew. NumPy only.

An image is ``uint8`` of height x width x 3 (red, green, blue); grey images are height x width. Alpha is laid over white.
"""

from __future__ import annotations

import struct
import zlib
from importlib.util import find_spec
from io import BytesIO

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # by colour type

# Ranges of hue (0 to 180), saturation and value (0 to 255) that make a colour region.
COLORS = {
    "red": ((0, 50, 50), (10, 255, 255)),
    "blue": ((100, 50, 50), (130, 255, 255)),
    "green": ((40, 50, 50), (80, 255, 255)),
    "yellow": ((20, 50, 50), (40, 255, 255)),
}
MASKS = ("blur", "fill", "pixelate", "remove")


# ---- PNG


def _unfilter(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    """The bytes of a PNG's rows. ``step``: bytes of a pixel, at least 1."""
    out = np.zeros((rows, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(rows):
        at = y * (stride + 1)
        kind, line = raw[at], np.frombuffer(raw, np.uint8, stride, at + 1)
        if kind == 0:
            row = line
        elif kind == 1:  # a running sum of each byte of the pixels
            padded = np.zeros(-(-stride // step) * step, np.uint8)
            padded[:stride] = line
            row = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()[:stride]
        elif kind == 2:
            row = line + above
        elif kind in (3, 4):
            now, up, done = line.tolist(), above.tolist(), [0] * stride
            for x in range(stride):
                a, b = (done[x - step] if x >= step else 0), up[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[x - step] if x >= step else 0
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                done[x] = (now[x] + guess) & 255
            row = np.array(done, np.uint8)
        else:
            raise ValueError(f"unknown PNG filter {kind}")
        out[y] = above = row
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The pixels of a PNG that isn't interlaced; ValueError for anything else."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, palette, clear = 8, [], None, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk, at = data[at + 8 : at + 8 + size], at + 12 + size
        if kind == b"IHDR":
            width, height, depth, color, _, _, laced = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = chunk
        elif kind == b"IDAT":
            body.append(chunk)
    if laced:
        raise ValueError("interlaced PNGs aren't supported")
    n = CHANNELS[color]
    rows = _unfilter(zlib.decompress(b"".join(body)), height, -(-width * n * depth // 8), max(1, n * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]  # the higher byte
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[:, : width * n]
        if color == 0:
            rows = rows * (255 // ((1 << depth) - 1))
    pixels = rows.reshape(height, width, n)
    if color == 3:
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        pixels = np.concatenate([palette, alpha[:, None]], axis=1)[pixels[..., 0]]
    shown = pixels[..., -1:].astype(np.uint16) if color in (3, 4, 6) else None
    colors = pixels[..., :3] if color in (2, 3, 6) else np.repeat(pixels[..., :1], 3, axis=2)
    return colors.copy() if shown is None else ((colors * shown + 255 * (255 - shown)) // 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """The pixels of an image: PNG by itself, other formats by an image library where one is installed."""
    if data[:8] == SIGNATURE:
        return decode_png(data)
    if not find_spec("PIL"):
        raise RuntimeError("no image library is installed; only PNG is read without one")
    from PIL import Image

    return np.array(Image.open(BytesIO(data)).convert("RGB"))


def encode_png(image: np.ndarray) -> bytes:
    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(height, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


# ---- levels and colours


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue in half degrees (0 to 179), saturation and value from 0 to 255."""
    rgb = image.astype(np.float64)
    top, low = rgb.max(axis=2), rgb.min(axis=2)
    span = np.where(top > low, top - low, 1.0)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    turn = np.select([top == low, top == r, top == g], [0.0, (g - b) / span, 2 + (b - r) / span], 4 + (r - g) / span)
    saturation = np.where(top > 0, (top - low) * 255 / np.maximum(top, 1), 0)
    return np.stack([np.round(turn * 30 % 180) % 180, np.round(saturation), top], axis=2)


def measures(image: np.ndarray) -> dict[str, float]:
    """Blur score (variance of the Laplacian), contrast (deviation) and brightness (mean) of the grey levels."""
    g = np.pad(grey(image).astype(np.float64), 1, mode="reflect" if min(image.shape[:2]) > 1 else "edge")
    inner = g[1:-1, 1:-1]
    edges = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * inner
    return {"blur_score": float(edges.var()), "contrast": float(inner.std()), "brightness": float(inner.mean())}


def otsu(levels: np.ndarray) -> int:
    """The threshold that parts the grey levels best: levels beyond it are the bright class."""
    counts = np.bincount(levels.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    both = np.where((below > 0) & (above > 0), below * above, 1)
    spread = np.where((below > 0) & (above > 0), (mass[-1] * below - below[-1] * mass) ** 2 / both, 0)
    return int(spread.argmax())


# ---- neighbourhoods


def _windows(levels: np.ndarray, size: int, mode: str = "edge", **more) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(levels, size // 2, mode=mode, **more), (size, size))


def close_open(mask: np.ndarray, size: int = 5) -> np.ndarray:
    """Fills gaps, then removes specks smaller than a square. What lies outside the image never counts."""
    grow = lambda m: _windows(m, size, "constant", constant_values=False).any(axis=(2, 3))
    shrink = lambda m: _windows(m, size, "constant", constant_values=True).all(axis=(2, 3))
    return grow(shrink(shrink(grow(mask))))


def gaussian(image: np.ndarray, size: int = 51) -> np.ndarray:
    """A Gaussian blur whose deviation follows from its size; the border is mirrored."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    weights = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    out = image.astype(np.float64)
    for axis in (0, 1):
        pads = [(0, 0)] * out.ndim
        pads[axis] = (size // 2, size // 2)
        around = np.pad(out, pads, mode="reflect" if out.shape[axis] > 1 else "edge")
        out = np.lib.stride_tricks.sliding_window_view(around, size, axis=axis) @ (weights / weights.sum())
    return np.round(out).astype(np.uint8)


def preprocess(image: np.ndarray, steps: tuple[str, ...] = ("denoise", "contrast", "threshold")) -> np.ndarray:
    """Grey levels made ready for text recognition. Steps: denoise (median of 3 x 3), contrast (stretched between the 1st and
    99th percentile), sharpen, threshold (Otsu), adaptive (against the mean of 11 x 11, less 2), deskew."""
    g = grey(image)
    for step in steps:
        if step == "denoise":
            g = np.median(_windows(g, 3), axis=(2, 3)).astype(np.uint8)
        elif step == "contrast":
            low, high = np.percentile(g, (1, 99))
            g = np.clip((g - low) * 255.0 / max(high - low, 1), 0, 255).astype(np.uint8)
        elif step == "sharpen":
            g = np.clip(9.0 * g - (_windows(g.astype(np.float64), 3).sum(axis=(2, 3)) - g), 0, 255).astype(np.uint8)
        elif step == "threshold":
            g = np.where(g > otsu(g), 255, 0).astype(np.uint8)
        elif step == "adaptive":
            g = np.where(g > _windows(g.astype(np.float64), 11).mean(axis=(2, 3)) - 2, 255, 0).astype(np.uint8)
        elif step == "deskew":
            g = rotate(g, -skew(g))
        else:
            raise ValueError(f"unknown step {step}")
    return g


# ---- shapes


def shapes(mask: np.ndarray) -> list[dict[str, float]]:
    """The connected parts of a mask (corners connect): x, y, w, h, area in pixels, circularity (1 for a disc). Runs of
    pixels are joined to those that touch them in the row above."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edges == 1)
    ends = np.nonzero(edges == -1)[1]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    firsts = np.searchsorted(rows, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j, last, stop = firsts[y - 1], firsts[y], firsts[y], firsts[y + 1]
        while i < last and j < stop:
            if starts[i] <= ends[j] and starts[j] <= ends[i]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    if not parent:
        return []
    owners = np.array([root(i) for i in range(len(parent))])
    _, part = np.unique(owners, return_inverse=True)
    n = part.max() + 1
    padded = np.pad(mask, 1)
    rim = mask & ~(padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:])
    before = np.pad(np.cumsum(rim, axis=1), ((0, 0), (1, 0)))
    area, border = np.bincount(part, ends - starts, n), np.bincount(part, before[rows, ends] - before[rows, starts], n)
    left, up = np.full(n, mask.shape[1]), np.full(n, mask.shape[0])
    right, down = np.zeros(n, int), np.zeros(n, int)
    np.minimum.at(left, part, starts), np.minimum.at(up, part, rows)
    np.maximum.at(right, part, ends), np.maximum.at(down, part, rows + 1)
    return [
        {"x": int(left[k]), "y": int(up[k]), "w": int(right[k] - left[k]), "h": int(down[k] - up[k]), "area": float(area[k]), "circularity": float(4 * np.pi * area[k] / max(border[k], 1) ** 2)}
        for k in range(n)
    ]


def dark_shapes(image: np.ndarray) -> list[dict[str, float]]:
    """The parts darker than Otsu's threshold, by their number on the rim rather than a traced outline."""
    g = grey(image)
    return shapes(g <= otsu(g)) if g.min() < g.max() else []


def color_regions(image: np.ndarray) -> list[dict]:
    """Regions of a logo's colours: more than 500 pixels that fill more than 0.3 of their box, which is the confidence."""
    levels, out = hsv(image), []
    for name, (low, high) in COLORS.items():
        mask = close_open(((levels >= low) & (levels <= high)).all(axis=2))
        for s in shapes(mask):
            box = mask[s["y"] : s["y"] + s["h"], s["x"] : s["x"] + s["w"]]
            if s["area"] > 500 and box.mean() > 0.3:
                out.append({"method": f"color:{name}", **s, "confidence": float(box.mean())})
    return out


# ---- geometry


def resize(levels: np.ndarray, height: int, width: int) -> np.ndarray:
    """By the nearest pixel."""
    rows, columns = np.arange(height) * levels.shape[0] // height, np.arange(width) * levels.shape[1] // width
    return levels[rows[:, None], columns]


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its centre, counter-clockwise; the border is repeated. By the nearest pixel."""
    h, w = image.shape[:2]
    a, cy, cx = np.deg2rad(degrees), h // 2, w // 2
    y, x = np.mgrid[:h, :w]
    sx = np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx
    sy = np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy
    return image[np.clip(np.round(sy).astype(int), 0, h - 1), np.clip(np.round(sx).astype(int), 0, w - 1)]


def skew(image: np.ndarray, limit: float = 15.0, step: float = 0.5) -> float:
    """The angle in degrees that lines of dark pixels rise by (counter-clockwise), within ``limit``: the one whose row counts
    vary most. 0 for images of one level."""
    g = grey(image)
    if g.min() == g.max():
        return 0.0
    y, x = np.nonzero(g <= otsu(g))

    def sharpness(angle: float) -> float:
        a = np.deg2rad(angle)
        rows = np.round(y * np.cos(a) + x * np.sin(a)).astype(int)
        return float((np.bincount(rows - rows.min()).astype(np.float64) ** 2).sum())

    return max(np.arange(-limit, limit + step / 2, step), key=lambda a: (sharpness(a), -abs(a))).item()


def match(image: np.ndarray, template: np.ndarray, least: float = 0.8, scales: tuple[float, ...] = (0.5, 0.75, 1.0, 1.25, 1.5)) -> list[dict]:
    """Places where the template, scaled, correlates (mean removed, normalised) by at least ``least``: local peaks only."""
    g, out = grey(image).astype(np.float64), []
    for scale in scales:
        h, w = (max(1, int(n * scale)) for n in template.shape[:2])
        if h > g.shape[0] or w > g.shape[1]:
            continue
        t = resize(grey(template), h, w).astype(np.float64)
        t -= t.mean()
        size = (g.shape[0] + h - 1, g.shape[1] + w - 1)
        dot = np.fft.irfft2(np.fft.rfft2(g, size) * np.fft.rfft2(t[::-1, ::-1], size), size)[h - 1 : g.shape[0], w - 1 : g.shape[1]]
        sums = [np.pad(np.cumsum(np.cumsum(g**p, axis=0), axis=1), ((1, 0), (1, 0))) for p in (1, 2)]
        first, second = (s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w] for s in sums)
        norm = np.sqrt(np.maximum(second - first**2 / (h * w), 0) * (t**2).sum())
        score = np.where(norm > 1e-6, dot / np.maximum(norm, 1e-6), 0)
        peaks = (score >= least) & (score >= _windows(score, 3).max(axis=(2, 3)))
        out += [{"method": "template", "x": int(x), "y": int(y), "w": w, "h": h, "area": float(w * h), "confidence": float(min(score[y, x], 1.0))} for y, x in zip(*np.nonzero(peaks), strict=True)]
    return out


def mask_box(image: np.ndarray, x: int, y: int, w: int, h: int, mode: str = "blur") -> None:
    """Hides a box, cut to the image, in place: blur, fill (the mean colour up to 10 pixels around), pixelate (tenths of the
    box) or remove (white)."""
    height, width = image.shape[:2]
    top, left = min(max(0, y), height), min(max(0, x), width)
    bottom, right = min(max(top, y + h), height), min(max(left, x + w), width)
    if bottom <= top or right <= left:
        return
    box = image[top:bottom, left:right]
    if mode == "blur":
        box[:] = gaussian(box)
    elif mode == "fill":
        box[:] = image[max(0, top - 10) : bottom + 10, max(0, left - 10) : right + 10].mean(axis=(0, 1))
    elif mode == "pixelate":
        box[:] = resize(resize(box, max(1, (bottom - top) // 10), max(1, (right - left) // 10)), bottom - top, right - left)
    elif mode == "remove":
        box[:] = 255
    else:
        raise ValueError(f"mode must be one of {', '.join(MASKS)}")
