"""Page images through the system's renderer, and what a recognizer's command reads from them."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import ship
from palimpsest.sources.files import office, pdf_pages

DPI_RANGE = (72, 600)


@dataclass(frozen=True)
class Settings:
    """What a conversion needs besides its input. Environment variables override the defaults."""

    dpi: int = 200
    python: str = "python3"
    workers: int = min(os.cpu_count() or 1, 8)
    lang: str = "eng+kor"

    @classmethod
    def from_env(cls, prefix: str = "PALIMPSEST_") -> Settings:
        get = lambda k, d: type(d)(os.environ.get(prefix + k.upper(), d))
        try:
            return cls(get("dpi", 200), get("python", "python3"), max(1, get("workers", cls.workers)), get("lang", "eng+kor"))
        except ValueError:
            return cls()

    def check(self) -> Settings:
        if not DPI_RANGE[0] <= self.dpi <= DPI_RANGE[1]:
            raise ValueError(f"dpi must be within {DPI_RANGE}")
        return self


def image_name(page_idx: Column) -> Column:
    """A rendered page's name: the page twice, once padded. Renderers pad the second number for longer documents, so look
    for the prefix too (`find_image`)."""
    return F.format_string("page_%03d-%d.png", page_idx + 1, page_idx + 1)


def find_image(folder: str, page_idx: int) -> str | None:
    prefix = f"page_{page_idx + 1:03d}"
    found = sorted(n for n in os.listdir(folder) if n.startswith(prefix) and n.endswith(".png"))
    return os.path.join(folder, found[0]) if found else None


def render_page(pdf: str, page_idx: int, folder: str, dpi: int = 200) -> str:
    if not shutil.which("pdftoppm"):
        raise RuntimeError("pdftoppm is not installed")
    page = str(page_idx + 1)
    subprocess.run(["pdftoppm", "-png", "-r", str(dpi), "-f", page, "-l", page, pdf, os.path.join(folder, f"page_{page_idx + 1:03d}")], check=True)
    image = find_image(folder, page_idx)
    if image is None:
        raise RuntimeError(f"no image of page {page}")
    return image


def outputs(found: DataFrame, command: tuple[str, ...], settings: Settings) -> DataFrame:
    """found: doc_id, kind, content -> doc_id, page_idx, output, image. Files that aren't PDF are converted by the office
    suite first. A file or page that fails gives no output; an image is kept as soon as there is one."""
    ship(found.sparkSession)

    def pages(data: bytes, kind: str) -> Iterator[tuple[int, str | None, bytes | None]]:
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, f"file.{kind}")
            with open(path, "wb") as f:
                f.write(data)
            pdf = path if kind == "pdf" else office(path, "pdf")
            for k in range(pdf_pages(pdf)):
                image = out = None
                try:
                    name = render_page(pdf, k, folder, settings.dpi)
                    with open(name, "rb") as f:
                        image = f.read()
                    out = subprocess.run([*command, "--image", name, "--lang", settings.lang], capture_output=True, check=True).stdout.decode("utf-8", "replace")
                except (OSError, RuntimeError, subprocess.CalledProcessError):
                    pass  # the parser track stands alone on this page
                yield k, out, image

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, kind, data in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                try:
                    for k, out, image in pages(data, kind):
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([k], pa.int32()), pa.array([out], pa.string()), pa.array([image], pa.binary())], names=["doc_id", "page_idx", "output", "image"])
                except (OSError, RuntimeError, subprocess.CalledProcessError):
                    continue  # its error shows in the parser track

    return found.select("doc_id", "kind", "content").mapInArrow(run, "doc_id long, page_idx int, output string, image binary")
