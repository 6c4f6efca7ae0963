"""Pictures inside tasks: a codec protocol, pages sized for a model, numbered outlines, crops and blank tests.

A codec is built per task from a factory, like a model client.  Pixels are arrays of rows x columns x 3
bytes.  Every function takes and returns a table; a task holds one page at a time.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import boxes

KEY = ["doc_id", "page_num"]
# Longer sides of what a model sees of a page, of a page to be searched for figures, of a crop; most bytes
PAGE_SIDE, SEARCH_SIDE, CROP_SIDE, MOST_BYTES = 2200, 1600, 800, 7_500_000
# What counts as white, and the share of it that makes a crop blank
WHITE, BLANK_SHARE = 240, 0.95
IMAGES = "array<struct<mime:string,data:binary>>"
_IMAGES = pa.list_(pa.struct([("mime", pa.string()), ("data", pa.binary())]))


class Codec(Protocol):
    def decode(self, data: bytes) -> np.ndarray: ...

    def encode(self, pixels: np.ndarray, kind: str, quality: int = 90) -> bytes:
        """``kind``: png or jpeg."""

    def resized(self, pixels: np.ndarray, width: int, height: int) -> np.ndarray: ...

    def labelled(self, pixels: np.ndarray, x: int, y: int, label: str) -> np.ndarray:
        """The pixels with a white label at a place."""


class PillowCodec:
    """Needs Pillow."""

    def __init__(self):
        from PIL import Image, ImageDraw

        self.image, self.draw = Image, ImageDraw

    def decode(self, data: bytes) -> np.ndarray:
        return np.asarray(self.image.open(io.BytesIO(data)).convert("RGB"))

    def encode(self, pixels: np.ndarray, kind: str, quality: int = 90) -> bytes:
        out = io.BytesIO()
        self.image.fromarray(pixels).save(out, format=kind.upper(), optimize=True, **({"quality": quality} if kind == "jpeg" else {}))
        return out.getvalue()

    def resized(self, pixels: np.ndarray, width: int, height: int) -> np.ndarray:
        return np.asarray(self.image.fromarray(pixels).resize((width, height), self.image.Resampling.LANCZOS))

    def labelled(self, pixels: np.ndarray, x: int, y: int, label: str) -> np.ndarray:
        own = self.image.fromarray(pixels)
        self.draw.Draw(own).text((x, y), label, fill=(255, 255, 255))
        return np.asarray(own)


class NetpbmCodec:
    """Binary Netpbm pictures under either name, for dry runs: no compression, the nearest pixel, no labels."""

    def decode(self, data: bytes) -> np.ndarray:
        _, size, _, pixels = data.split(b"\n", 3)
        width, height = map(int, size.split())
        return np.frombuffer(pixels, np.uint8).reshape(height, width, 3)

    def encode(self, pixels: np.ndarray, kind: str, quality: int = 90) -> bytes:
        return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()

    def resized(self, pixels: np.ndarray, width: int, height: int) -> np.ndarray:
        rows, columns = (np.arange(n) * of // n for n, of in zip((height, width), pixels.shape, strict=False))
        return pixels[rows][:, columns]

    def labelled(self, pixels: np.ndarray, x: int, y: int, label: str) -> np.ndarray:
        return pixels


def fitted(codec: Codec, pixels: np.ndarray, side: int) -> np.ndarray:
    height, width = pixels.shape[:2]
    if max(width, height) <= side:
        return pixels
    scale = side / max(width, height)
    return codec.resized(pixels, max(1, round(width * scale)), max(1, round(height * scale)))


def prepared(codec: Codec, pixels: np.ndarray, sides: list[int], most: int = MOST_BYTES) -> tuple[str, bytes, int, int]:
    """Kind, bytes, width and height of the first encoding of at most ``most`` bytes, side by side: as PNG, then by falling quality; the smallest at the last side if none is."""
    for side in sides:
        pixels = fitted(codec, pixels, side)
        size = pixels.shape[1], pixels.shape[0]
        whole = codec.encode(pixels, "png")
        if len(whole) <= most:
            return "image/png", whole, *size
        tries = []
        for quality in boxes.QUALITIES:
            tries.append(codec.encode(pixels, "jpeg", quality))
            if len(tries[-1]) <= most:
                return "image/jpeg", tries[-1], *size
    return "image/jpeg", min(tries, key=len), *size


def _by_page(factory: Callable[[], Codec], columns: list[str], make: Callable, schema: pa.Schema):
    """A ``mapInArrow`` function that yields the rows ``make(codec, pixels, *key and columns)`` of one page at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = factory()
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in (*KEY, *columns, "png")}
                pixels = codec.decode(row.pop("png"))
                rows = list(make(codec, pixels, *row.values()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)

    return run


def _mapped(rows: DataFrame, factory, columns: list[str], make, kinds: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    key = dict(rows.select(*KEY).dtypes)
    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    schema = pa.schema([(k, arrow[key[k]]) for k in KEY] + [(n, t) for n, (_, t) in kinds.items()])
    names = ", ".join([f"{k} {key[k]}" for k in KEY] + [f"{n} {s}" for n, (s, _) in kinds.items()])
    return rows.select(*KEY, *columns, "png").mapInArrow(_by_page(factory, columns, make, schema), names)


def sent(pages: DataFrame, factory: Callable[[], Codec] | None, side: int) -> DataFrame:
    """doc_id, page_num, images (of one), sent_width, sent_height of ``pages`` (width, height, png), at most ``side`` long and ``MOST_BYTES`` large; as they are without a codec."""
    if factory is None:
        return pages.select(*KEY, F.array(F.struct(F.lit("image/png").alias("mime"), F.col("png").alias("data"))).alias("images"), F.col("width").alias("sent_width"), F.col("height").alias("sent_height"))

    def make(codec, pixels, doc, page, sides):
        mime, data, width, height = prepared(codec, pixels, sides)
        yield doc, page, [{"mime": mime, "data": data}], width, height

    rows = pages.withColumn("sides", boxes.side_ladder(F.col("width"), F.col("height"), side))
    return _mapped(rows, factory, ["sides"], make, {"images": (IMAGES, _IMAGES), "sent_width": ("int", pa.int32()), "sent_height": ("int", pa.int32())})


def outlined(codec: Codec, pixels: np.ndarray, crops: list[dict], marks: list[dict]) -> np.ndarray:
    """The page with a numbered outline for each crop, as ``boxes.overlay`` lays them out."""
    out = pixels.copy()
    height, width = out.shape[:2]

    def fill(x1, y1, x2, y2, colour):
        out[max(y1, 0) : min(y2 + 1, height), max(x1, 0) : min(x2 + 1, width)] = colour

    for c, m in zip(crops, marks, strict=True):
        colour, t = tuple(bytes.fromhex(m["colour"])), m["outline"] - 1
        x1, y1, x2, y2 = (c[s] for s in boxes.SIDES)
        fill(x1 - t, y1 - t, x2 + t, y1, colour), fill(x1 - t, y2, x2 + t, y2 + t, colour)
        fill(x1 - t, y1 - t, x1, y2 + t, colour), fill(x2, y1 - t, x2 + t, y2 + t, colour)
        fill(m["tag_x1"], m["tag_y1"], m["tag_x2"], m["tag_y2"], colour)
        out = np.array(codec.labelled(out, m["tag_x1"] + 5, max(0, m["tag_y2"] - 20), str(m["label"])))
    return out


def _cut(pixels: np.ndarray, b: dict) -> np.ndarray:
    return pixels[b["y1"] : b["y2"], b["x1"] : b["x2"]]


def for_verification(pages: DataFrame, factory: Callable[[], Codec]) -> DataFrame:
    """doc_id, page_num, images: the page with numbered outlines, then every crop. ``pages`` have png and crops."""

    def make(codec, pixels, doc, page, crops, marks):
        shown = [(outlined(codec, pixels, crops, marks), PAGE_SIDE), *((_cut(pixels, c), CROP_SIDE) for c in crops)]
        found = [prepared(codec, image, [min(max(image.shape[:2]), side)]) for image, side in shown if image.size]
        yield doc, page, [{"mime": f[0], "data": f[1]} for f in found]

    rows = pages.withColumn("marks", boxes.overlay(F.col("crops")))
    return _mapped(rows, factory, ["crops", "marks"], make, {"images": (IMAGES, _IMAGES)})


def blank_boxes(pages: DataFrame, factory: Callable[[], Codec]) -> DataFrame:
    """doc_id, page_num, blanks: those of the pixel boxes ``candidates`` that are nearly white. ``pages`` have png and candidates."""
    sides = pa.list_(pa.struct([(s, pa.int32()) for s in boxes.SIDES]))

    def make(codec, pixels, doc, page, candidates):
        grey = (pixels @ np.array([0.299, 0.587, 0.114])).round()
        cuts = [(b, _cut(grey, b)) for b in candidates or [] if b]
        yield doc, page, [b for b, cut in cuts if cut.size and (cut > WHITE).mean() > BLANK_SHARE]

    return _mapped(pages, factory, ["candidates"], make, {"blanks": ("array<struct<x1:int,y1:int,x2:int,y2:int>>", sides)})


def crop_files(pages: DataFrame, factory: Callable[[], Codec]) -> DataFrame:
    """doc_id, page_num, filename, data of every crop of ``pages`` (png and crops)."""

    def make(codec, pixels, doc, page, crops):
        for c in crops:
            cut = _cut(pixels, c)
            if cut.size:
                yield doc, page, c["filename"], codec.encode(cut, "png")

    return _mapped(pages, factory, ["crops"], make, {"filename": ("string", pa.string()), "data": ("binary", pa.binary())})
