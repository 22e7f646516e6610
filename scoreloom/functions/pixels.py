"""What a task does to one image: decode, resize, normalise, annotate, encode.

Pillow is used where a cluster has it (JPEG, PNG, drawn captions). Without it netpbm images (P5 grey,
P6 colour) are read and written, and the caption goes into the file's comment line.
"""

from __future__ import annotations

import io
import re
from functools import lru_cache

import numpy as np

try:
    from PIL import Image
except ImportError:
    Image = None

# Fixed values of the annotated picture.
BOX_CORNER = (2, 2)
BOX_PAD = 10
JPEG_QUALITY = 90
EXTENSIONS = {"jpeg": ".jpg", "netpbm": ".ppm"}
FIXED_BITS = 22  # fraction bits of the resize weights
GLYPH = (6, 11)  # size of one character of the default bitmap font

_NETPBM = re.compile(rb"^P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s", re.DOTALL)


class DecodeError(ValueError):
    """The bytes are not an image this installation can read."""


def decode_image(content: bytes) -> np.ndarray:
    """Bytes to an RGB picture, H x W x 3. Grey is repeated over the channels."""
    head = _NETPBM.match(content)
    if head:
        kind, width, height, top = (int(g) for g in head.groups())
        depth = 3 if kind == 6 else 1
        body = np.frombuffer(content, dtype=np.uint8, offset=head.end())
        if top != 255 or body.size < height * width * depth:
            raise DecodeError("truncated or unsupported netpbm image")
        grid = body[: height * width * depth].reshape(height, width, depth)
        return np.repeat(grid, 3, axis=2) if depth == 1 else grid
    if Image is None:
        raise DecodeError("unknown image format")
    try:
        return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))
    except Exception as err:
        raise DecodeError(str(err)) from err


def bgr_rows_to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Pixel bytes of Spark's ``image`` struct (BGR, BGRA or grey) as an RGB picture."""
    grid = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(grid, 3, axis=2) if channels == 1 else grid[:, :, 2::-1]


@lru_cache(maxsize=256)
def _taps(size_in: int, size_out: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and whole-number weights of every output sample along one axis.

    A triangle filter, widened when shrinking so that no input is skipped.
    """
    scale = size_in / size_out
    reach = max(scale, 1.0)
    centre = (np.arange(size_out) + 0.5) * scale
    away = np.abs(np.arange(size_in)[None, :] + 0.5 - centre[:, None]) / reach
    weight = np.clip(1.0 - away, 0.0, None)
    weight /= weight.sum(axis=1, keepdims=True)
    count = int((weight > 0).sum(axis=1).max())
    first = np.minimum((weight > 0).argmax(axis=1), size_in - count)
    places = first[:, None] + np.arange(count)
    whole = np.floor(np.take_along_axis(weight, places, axis=1) * (1 << FIXED_BITS) + 0.5)
    return places, whole.astype(np.int32)


def _shrink_rows(grid: np.ndarray, size: int) -> np.ndarray:
    """Resample the first axis of a two-dimensional grid of bytes, rounded to bytes again."""
    if grid.shape[0] == size:
        return grid
    places, weights = _taps(grid.shape[0], size)
    total = np.full((size, grid.shape[1]), 1 << (FIXED_BITS - 1), np.int32)
    for tap in range(places.shape[1]):
        total += grid[places[:, tap]] * weights[:, tap, None]
    return total >> FIXED_BITS


def resize(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize to a fixed size; the aspect ratio is not kept.

    Columns first, then rows, each pass rounded to bytes in fixed-point arithmetic, so results are exact.
    """
    rows, columns, _ = picture.shape
    wide = picture.transpose(1, 0, 2).reshape(columns, rows * 3).astype(np.int32)
    across = _shrink_rows(wide, width).reshape(width, rows, 3).transpose(1, 0, 2).reshape(rows, width * 3)
    return _shrink_rows(across, height).reshape(height, width, 3).astype(np.uint8)


def to_tensor(picture: np.ndarray, size: int, mean: tuple, std: tuple) -> np.ndarray:
    """Resize, scale to 0-1, normalise per channel; channels first."""
    return normalised(resize(picture, size, size), mean, std)


def normalised(small: np.ndarray, mean: tuple, std: tuple) -> np.ndarray:
    """The same for a picture that has the model's size."""
    return ((small.astype(np.float64) / 255.0 - np.asarray(mean)) / np.asarray(std)).transpose(2, 0, 1)


def annotate(picture: np.ndarray, text: str) -> np.ndarray:
    """Black box in the upper left corner, as wide as the caption; the caption itself travels as data."""
    boxed = picture.copy()
    x, y = BOX_CORNER
    boxed[y : GLYPH[1] + BOX_PAD + 1, x : GLYPH[0] * len(text) + BOX_PAD + 1] = 0
    return boxed


def settle_form(form: str) -> str:
    """``auto`` is JPEG where Pillow is installed, else netpbm. Settled once per run, so that tasks agree."""
    if form not in EXTENSIONS and form != "auto":
        raise ValueError(f"form must be auto or one of {sorted(EXTENSIONS)}")
    return form if form != "auto" else "netpbm" if Image is None else "jpeg"


def encode_image(picture: np.ndarray, text: str, form: str) -> bytes:
    """``jpeg`` needs Pillow and shows the caption in the picture; ``netpbm`` also carries it as a comment."""
    if form == "jpeg":
        if Image is None:
            raise RuntimeError("writing JPEG needs Pillow on every executor")
        out = io.BytesIO()
        Image.fromarray(picture).save(out, "JPEG", quality=JPEG_QUALITY)
        return out.getvalue()
    height, width = picture.shape[:2]
    note = text.replace("\n", " ")
    return f"P6\n# {note}\n{width} {height}\n255\n".encode() + np.ascontiguousarray(picture).tobytes()
