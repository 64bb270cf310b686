"""Image kernels in NumPy. Images are uint8 arrays: (h, w) gray, (h, w, 3) RGB or (h, w, 4) RGBA."""

from __future__ import annotations

import struct
import zlib

import numpy as np

C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
RADIUS, SIGMA, BAND = 5, 1.5, 32
MARK, OUTLINE = (255, 0, 0), (255, 196, 0, 255)


def luma(image: np.ndarray) -> np.ndarray:
    """8-bit gray: Rec. 709 weights in ten-thousandths, rounded down."""
    if image.ndim == 2:
        return image
    rgb = image[..., :3].astype(np.int64)
    return ((2126 * rgb[..., 0] + 7152 * rgb[..., 1] + 722 * rgb[..., 2]) // 10000).astype(np.uint8)


def rgba(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        image = np.repeat(image[..., None], 3, axis=2)
    if image.shape[2] == 3:
        image = np.concatenate([image, np.full((*image.shape[:2], 1), 255, np.uint8)], axis=2)
    return image


def lanczos_weights(source: int, target: int, lobes: int = 3) -> np.ndarray:
    """(target, source) matrix of a Lanczos filter, widened when the image shrinks; rows add up to one."""
    ratio = source / target
    scale = max(ratio, 1.0)
    centre = (np.arange(target) + 0.5) * ratio
    x = (np.arange(source)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Separable Lanczos, clamped and rounded to 8 bits after each direction."""
    if image.shape[1] == width and image.shape[0] == height:
        return image
    eight = lambda a: np.clip(np.floor(a + 0.5), 0, 255)
    rows = eight(np.tensordot(lanczos_weights(image.shape[0], height), image.astype(float), axes=(1, 0)))
    out = eight(np.tensordot(lanczos_weights(image.shape[1], width), rows, axes=(1, 1)))
    return np.ascontiguousarray(np.moveaxis(out, 0, 1)).astype(np.uint8)


def dct16(gray: np.ndarray) -> np.ndarray:
    """16 by 16 low-frequency coefficients of a 32 by 32 image."""
    k, x = np.arange(16)[:, None], np.arange(32)[None, :]
    basis = np.cos((2 * x + 1) * k * np.pi / 64)
    basis[0] /= np.sqrt(2)
    return 0.25 * basis @ gray.astype(float) @ basis.T


def zigzag(n: int = 16, count: int = 32) -> list[tuple[int, int]]:
    """(v, u) by diagonals, v ascending, without the constant term."""
    order = [(v, d - v) for d in range(1, 2 * n - 1) for v in range(d + 1) if v < n and d - v < n]
    return order[:count]


def fold(values: np.ndarray) -> int:
    """Bit i is set where value i lies above the (upper) median."""
    median = np.sort(values)[len(values) // 2]
    return int(sum(1 << i for i in np.flatnonzero(values > median).tolist()))


def dct_hash(gray: np.ndarray) -> int:
    c = dct16(gray)
    return fold(np.array([c[v, u] for v, u in zigzag()]))


def difference_hash(gray: np.ndarray) -> int:
    """32 bits of a 17 by 16 image: each pixel brighter than its right neighbour toggles bit (16 y + x) mod 32."""
    falls = (gray[:, :-1].astype(int) > gray[:, 1:]).reshape(-1)
    bits = np.bitwise_xor.reduce(falls.reshape(-1, 32).astype(np.uint8), axis=0)
    return int(sum(1 << i for i in np.flatnonzero(bits).tolist()))


def phash(image: np.ndarray) -> str:
    """16 hexadecimal digits: the DCT half, then the difference half."""
    return f"{dct_hash(luma(resize(image, 32, 32))) << 32 | difference_hash(luma(resize(image, 17, 16))):016x}"


def gaussian() -> np.ndarray:
    w = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA * SIGMA))
    return w / w.sum()


def blur(values: np.ndarray) -> np.ndarray:
    """Both directions of the window, the edge repeated and folded as often as a short side needs. Shifted slices are
    added up, so no array grows with the window."""
    w = gaussian()
    h, n = values.shape
    padded = np.pad(values, ((0, 0), (RADIUS, RADIUS)), mode="symmetric")
    across = padded[:, :n] * w[0]
    for k in range(1, len(w)):
        across += padded[:, k : k + n] * w[k]
    padded = np.pad(across, ((RADIUS, RADIUS), (0, 0)), mode="symmetric")
    out = padded[:h] * w[0]
    for k in range(1, len(w)):
        out += padded[k : k + h] * w[k]
    return out


def _band_sum(a: np.ndarray, b: np.ndarray, top: int, bottom: int) -> float:
    ma, mb, sa, sb, ab = (blur(x)[top : len(x) - bottom] for x in (a, b, a * a, b * b, a * b))
    va, vb, cov = np.maximum(sa - ma * ma, 0), np.maximum(sb - mb * mb, 0), ab - ma * mb
    return float(np.sum((2 * ma * mb + C1) * (2 * cov + C2) / ((ma * ma + mb * mb + C1) * (va + vb + C2))))


def ssim(left: np.ndarray, right: np.ndarray) -> float:
    """Mean structural similarity of two gray images of one size; may be negative."""
    if left.shape != right.shape:
        raise ValueError("the images differ in size")
    if not left.size:
        raise ValueError("the images are empty")
    h, total = len(left), 0.0
    for y in range(0, h, BAND):  # bands of rows fit the processor's cache; each reads its neighbours' edge rows
        top, bottom = min(y, RADIUS), min(max(h - y - BAND, 0), RADIUS)
        rows = slice(y - top, min(y + BAND, h) + bottom)
        total += _band_sum(left[rows].astype(float), right[rows].astype(float), top, bottom)
    return total / left.size


def target_size(a: tuple[int, int], b: tuple[int, int], edge: int | None = None) -> tuple[int, int]:
    """(w, h) of the smaller image by (pixels, w, h), scaled down to ``edge`` where one is given."""
    w, h = min(a, b, key=lambda s: (s[0] * s[1], *s))
    if edge and max(w, h) > edge and min(w, h) > 0:
        scale = edge / max(w, h)
        w, h = (max(1, int(np.floor(x * scale + 0.5))) for x in (w, h))
    return max(w, 1), max(h, 1)


def prepare(image: np.ndarray, width: int, height: int) -> np.ndarray:
    if not width or not height:
        raise ValueError("the target is empty")
    return luma(image) if image.shape[:2] == (height, width) else luma(resize(rgba(image), width, height))


def pair_ssim(a: np.ndarray, b: np.ndarray, edge: int | None = None) -> float:
    """Both images at the size of the smaller one (capped for tasks, uncapped for the tool)."""
    w, h = target_size((a.shape[1], a.shape[0]), (b.shape[1], b.shape[0]), edge)
    return ssim(prepare(a, w, h), prepare(b, w, h))


def threshold(sensitivity: int) -> int:
    return 56 - (48 * min(sensitivity, 100) + 50) // 100


def difference_mask(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Where any channel differs by more than ``least``."""
    return (np.abs(rgba(a).astype(int) - rgba(b).astype(int)).max(axis=2)) > least


def regions(mask: np.ndarray, least_area: int) -> list[dict]:
    """8-connected regions of at least ``least_area`` pixels in scan order: pixels (flat indexes) and bounds (inclusive).

    Runs of each row are joined to touching runs of the row above by union-find, so work follows the runs.
    """
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    steps = np.diff(padded, axis=1)
    y0, a = np.nonzero(steps == 1)
    _, b = np.nonzero(steps == -1)  # runs cover columns a..b-1
    parent = list(range(len(a)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(y0, np.arange(h + 1))
    for y in range(1, h):
        i, j = int(first[y - 1]), int(first[y])
        while i < first[y] and j < first[y + 1]:
            if a[j] <= b[i] and a[i] <= b[j]:
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
            if b[i] < b[j]:
                i += 1
            else:
                j += 1
    out: dict[int, dict] = {}
    for i in range(len(a)):
        r = out.setdefault(find(i), {"pixels": [], "x0": w, "y0": h, "x1": -1, "y1": -1})
        r["pixels"].append(np.arange(a[i], b[i]) + int(y0[i]) * w)
        r["x0"], r["x1"] = min(r["x0"], int(a[i])), max(r["x1"], int(b[i]) - 1)
        r["y0"], r["y1"] = min(r["y0"], int(y0[i])), max(r["y1"], int(y0[i]))
    found = [{**r, "pixels": np.concatenate(r["pixels"])} for _, r in sorted(out.items())]
    return [r for r in found if len(r["pixels"]) >= least_area]


def overlay(image: np.ndarray, pixels: np.ndarray) -> np.ndarray:
    """A red tint in integer arithmetic: 45 of 100 of the image, 55 of the mark; alpha 180 at least."""
    out = rgba(image).copy()
    flat = out.reshape(-1, 4)
    x = flat[pixels].astype(int)
    flat[pixels] = np.stack([(x[:, 0] * 45 + MARK[0] * 55) // 100, x[:, 1] * 45 // 100, x[:, 2] * 45 // 100, np.maximum(x[:, 3], 180)], axis=1)
    return out


def outline(image: np.ndarray, r: dict, pad: int = 2, width: int = 2) -> np.ndarray:
    """A box of two pixels around the region's bounds, two pixels outside, within the image."""
    out = image.copy()
    h, w = out.shape[:2]
    x0, y0, x1, y1 = max(r["x0"] - pad, 0), max(r["y0"] - pad, 0), min(r["x1"] + pad, w - 1), min(r["y1"] + pad, h - 1)
    box = np.zeros((h, w), bool)
    box[y0 : y1 + 1, x0 : x1 + 1] = True
    box[y0 + width : max(y1 + 1 - width, y0 + width), x0 + width : max(x1 + 1 - width, x0 + width)] = False
    out[box] = OUTLINE
    return out


def difference_preview(a: np.ndarray, b: np.ndarray, sensitivity: int = 50, edge: int = 1600, budget: int = 25_000_000) -> dict:
    """Regions, their share of the pixels, and PNGs of both images and of the marked difference."""
    if sensitivity > 100:
        raise ValueError("the sensitivity is at most 100")
    if max(a.shape[0] * a.shape[1], b.shape[0] * b.shape[1]) > budget:
        raise ValueError("the image has too many pixels for a preview")
    w, h = target_size((a.shape[1], a.shape[0]), (b.shape[1], b.shape[0]), edge)
    a, b = resize(rgba(a), w, h), resize(rgba(b), w, h)
    found = regions(difference_mask(a, b, threshold(sensitivity)), max(9, w * h // 100_000))
    marked = overlay(b, np.concatenate([r["pixels"] for r in found])) if found else b
    for r in found:
        marked = outline(marked, r)
    return {"width": w, "height": h, "regions": [{k: r[k] for k in ("x0", "y0", "x1", "y1")} | {"area": len(r["pixels"])} for r in found], "changed_ratio": sum(len(r["pixels"]) for r in found) / (w * h), "left_png": png(a), "right_png": png(b), "marked_png": png(marked)}


def png(image: np.ndarray) -> bytes:
    """A PNG file of an 8-bit image."""
    kind = {2: 0, 3: {3: 2, 4: 6}.get(image.shape[-1], 2)}[image.ndim]
    rows = image.reshape(image.shape[0], -1)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """An 8-bit, not interlaced PNG; raises ValueError for anything else."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"IDAT":
            body += part
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("this kind of PNG is not read here")
    w, h, n = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    except (zlib.error, ValueError) as e:
        raise ValueError("damaged PNG") from e
    out = np.zeros((h, w * n), np.uint8)
    before = np.zeros(w * n, np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + before
        elif kind == 1:
            line = np.cumsum(line.reshape(-1, n), axis=0).reshape(-1)
        elif kind in (3, 4):
            for i in range(len(line)):
                a, b, c = (line[i - n] if i >= n else 0), before[i], (before[i - n] if i >= n else 0)
                p = (a + b) // 2 if kind == 3 else min((a, b, c), key=lambda v, p=a + b - c: abs(p - v))
                line[i] = (line[i] + p) & 255
        before = line & 255
        out[y] = before
    return out.reshape(h, w) if n == 1 else out.reshape(h, w, n)
