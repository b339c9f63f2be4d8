"""FITS images as a Spark data source, by a small parser of the uncompressed standard.

``spark.dataSource.register(FitsSource)``, then ``spark.read.format("fits").load(folder)`` yields one row for
each image of each file: header, size, and pixels row by row (null where not finite or masked).
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 2880
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def _value(raw: str):
    raw = raw.strip()
    if raw.startswith("'"):
        return raw[1 : raw.rfind("'")].replace("''", "'").rstrip()
    raw = raw.split("/")[0].strip()
    if raw in ("T", "F"):
        return raw == "T"
    try:
        return int(raw)
    except ValueError:
        try:
            return float(raw.replace("D", "E"))
        except ValueError:
            return raw or None


def read_units(data: bytes) -> Iterator[tuple[dict, np.ndarray | None]]:
    """Header and image (or None) of each unit of a file."""
    at = 0
    while at < len(data):
        header: dict = {}
        done = False
        while not done:
            if at + BLOCK > len(data):
                raise ValueError("the header is cut off")
            for i in range(at, at + BLOCK, 80):
                card = data[i : i + 80].decode("ascii", "replace")
                if card.startswith("END") and not card[3:].strip():
                    done = True
                    break
                if card[8:10] == "= ":
                    header.setdefault(card[:8].strip(), _value(card[10:]))
            at += BLOCK
        shape = [header.get(f"NAXIS{i}", 0) for i in range(header.get("NAXIS", 0), 0, -1)]
        bits = header.get("BITPIX", 8)
        n = int(np.prod(shape)) * abs(bits) // 8 * header.get("GCOUNT", 1) + header.get("PCOUNT", 0) if shape else 0
        image = None
        if len(shape) == 2 and n and header.get("XTENSION", "IMAGE") == "IMAGE":
            image = np.frombuffer(data, TYPES[bits], shape[0] * shape[1], at).reshape(shape)
            if header.get("BSCALE", 1) != 1 or header.get("BZERO", 0):
                image = image * float(header.get("BSCALE", 1)) + header.get("BZERO", 0)
        yield header, image
        at += -(-n // BLOCK) * BLOCK


def write_units(units: list[tuple[dict, np.ndarray | None]]) -> bytes:
    """The bytes of a file; the first unit is the primary one."""
    out = b""
    for k, (header, image) in enumerate(units):
        a = None if image is None else np.ascontiguousarray(image, ">f4" if image.dtype.kind == "f" else ">i4")
        cards = {"SIMPLE": True} if not k else {"XTENSION": "IMAGE"}
        cards |= {"BITPIX": 8 if a is None else (-32 if a.dtype.kind == "f" else 32), "NAXIS": 0 if a is None else 2}
        if a is not None:
            cards |= {"NAXIS1": a.shape[1], "NAXIS2": a.shape[0]}
        cards |= header
        text = "".join(f"{key:<8}= {('T' if v else 'F') if isinstance(v, bool) else repr(v) if isinstance(v, str) else v!s:>20}".ljust(80) for key, v in cards.items()) + "END".ljust(80)
        out += text.encode().ljust(-(-len(text) // BLOCK) * BLOCK)
        body = b"" if a is None else a.tobytes()
        out += body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")
    return out


def mid_mjd(header: dict) -> float | None:
    """Time of the middle of an exposure, from the first of the usual keys."""
    for key in ("DATE-AVG", "MJD-OBS", "DATE-OBS", "MJD"):
        if (v := header.get(key)) is None:
            continue
        t = float(v) if not isinstance(v, str) else (np.datetime64(v.strip()) - np.datetime64("1858-11-17")) / np.timedelta64(1, "us") / 86_400e6
        return t + (float(header.get("EXPREQ", 0)) + 0.5) / 2 / 86_400 if key == "DATE-AVG" else t
    return None


class FitsSource(DataSource):
    """Options: ``path``; ``pattern`` of file names; ``flags``: bits of the mask unit that mask a pixel."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return "path string, ext int, name string, mjd double, height int, width int, header map<string,string>, pixels array<double>"

    def reader(self, schema) -> DataSourceReader:
        return FitsReader(self.options)


class FitsReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern = options["path"], options.get("pattern", "*.fit*")

    def partitions(self) -> list[InputPartition]:
        names = [self.path] if os.path.isfile(self.path) else [os.path.join(d, f) for d, _, files in sorted(os.walk(self.path)) for f in sorted(files) if fnmatch.fnmatch(f, self.pattern)]
        return [InputPartition(n) for n in names]

    def read(self, partition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            data = f.read()
        units = [*read_units(data)]
        first = units[0][0] if units else {}
        for ext, (header, image) in enumerate(units):
            if image is not None:
                flat = image.astype(float).ravel()
                both = first | header
                yield partition.value, ext, str(header.get("EXTNAME", "")), mid_mjd(both), image.shape[0], image.shape[1], {k: str(v) for k, v in both.items()}, [float(v) if np.isfinite(v) else None for v in flat]


def standardized(images, flags: int = ~0, names: tuple[str, str, str] = ("SCI", "VAR", "MASK")):
    """Rows of the source as ``pixels(path, mjd, y, x, sci, var)``: units by name, pixels with any of the flags left out."""
    from pyspark.sql import functions as F

    def layer(name: str, value: str):
        one = images.where(F.upper("name").startswith(name))
        return one.select("path", "mjd", "width", F.posexplode("pixels").alias("p", value))

    sci, var = layer(names[0], "sci"), layer(names[1], "var").drop("mjd", "width")
    mask = layer(names[2], "mask").drop("mjd", "width")
    both = sci.join(var, ["path", "p"]).join(mask, ["path", "p"], "left")
    ok = (F.coalesce(F.col("mask").cast("long"), F.lit(0)).bitwiseAND(F.lit(flags)) == 0) & F.col("sci").isNotNull() & F.col("var").isNotNull()
    return both.where(ok).select("path", "mjd", F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).cast("int").alias("x"), "sci", "var")
