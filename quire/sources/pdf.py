"""PDF files as a Spark data source: a row for each page, a task for each few pages.

    spark.dataSource.register(pdf.source(pdf.pymupdf_documents))
    spark.read.format("pdf_pages").option("pages_per_task", 8).load(folder)

A file above ``whole_bytes`` is opened once while the read is planned, to count its pages, and cut into
ranges; smaller ones are put together, some ``whole_bytes`` to a range, and not opened before.  A task
opens its file from where it lies and renders one page after the other, so neither a file nor a
document's pages are ever one row, and a thousand pages are rendered by as many tasks as there are
ranges, up to ``most_tasks``; beyond that a task has several ranges, as each task costs time of its
own, however little it has to do.  A lost task renders its own ranges again.

Files without pages, and folders without files, give no rows; what cannot be opened fails the read.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.sources.files import file_system, files_under

PAGES = "doc_id string, page_num int, width int, height int, png binary"
_PAGES = pa.schema([("doc_id", pa.string()), ("page_num", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("png", pa.binary())])


class Document(Protocol):
    def __len__(self) -> int: ...

    def page(self, number: int) -> tuple[int, int, bytes]:
        """Width, height and PNG of a page."""


#: makes, once for each task, a function that opens a seekable binary file as a document
Documents = Callable[[], Callable[[object], Document]]

# Fixed value: dots per inch at which pages are rendered
RENDER_DPI = 220
#: rows and bytes of pages that go to Spark at once; a page beyond goes alone
BATCH_ROWS, BATCH_BYTES = 256, 1 << 20


def pymupdf_documents() -> Callable[[object], Document]:
    """Needs PyMuPDF."""
    import fitz

    class Pdf:
        def __init__(self, file):
            self.pdf, self.matrix = fitz.open(stream=file.read(), filetype="pdf"), fitz.Matrix(RENDER_DPI / 72, RENDER_DPI / 72)

        def __len__(self) -> int:
            return len(self.pdf)

        def page(self, number: int) -> tuple[int, int, bytes]:
            image = self.pdf[number].get_pixmap(matrix=self.matrix)
            return image.width, image.height, image.tobytes("png")

    return Pdf


@dataclass
class Pages(InputPartition):
    """Files with the pages to render, from ``first`` to before ``end`` (None: the last)."""

    items: tuple[tuple[str, int, int | None], ...]


def doc_id(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


def ranges(files: list[tuple[str, int]], pages_of: Callable[[str], int], per_task: int, whole_bytes: int) -> list[Pages]:
    """Partitions of files (path, bytes): few pages of a large one, or several small ones."""
    out, together, held = [], [], 0
    for path, size in sorted(files):
        if size > whole_bytes:
            n = pages_of(path)
            out += [Pages(((path, at, min(at + per_task, n)),)) for at in range(0, n, per_task)]
            continue
        if together and held + size > whole_bytes:
            out.append(Pages(tuple(together)))
            together, held = [], 0
        together.append((path, 0, None))
        held += size
    return out + ([Pages(tuple(together))] if together else [])


def together(parts: list[Pages], most: int) -> list[Pages]:
    """``parts`` in order as at most ``most`` partitions, each with as many of them, or one fewer."""
    n = min(len(parts), most)
    cuts = [len(parts) * k // n for k in range(n + 1)] if n else []
    return [Pages(tuple(i for p in parts[a:b] for i in p.items)) for a, b in zip(cuts, cuts[1:], strict=False)]


def batched(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of ``PAGES`` as batches of few of them."""
    held, size = [], 0
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PAGES.types, strict=True)], schema=_PAGES)
    for row in rows:
        if held and size + len(row[-1]) > BATCH_BYTES:
            yield batch(held)
            held, size = [], 0
        held.append(row)
        size += len(row[-1])
        if len(held) == BATCH_ROWS or size >= BATCH_BYTES:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def source(documents: Documents) -> type[DataSource]:
    """The data source ``pdf_pages`` for a renderer.

    Options: path; pages_per_task (16); whole_bytes (1 MB); most_tasks (1,024).
    """

    class PdfPages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "pdf_pages"

        def schema(self) -> str:
            return PAGES

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path = options["path"]
            self.per_task, self.whole = int(options.get("pages_per_task", 16)), int(options.get("whole_bytes", 1 << 20))
            self.most = int(options.get("most_tasks", 1024))

        def _open(self, path: str):
            return file_system(self.path)[0].open_input_file(path)

        def partitions(self) -> list[InputPartition]:
            open_document = documents()

            def pages_of(path: str) -> int:
                with self._open(path) as file:
                    return len(open_document(file))

            files = [(f.path, f.size) for f in files_under(self.path) if f.path.lower().endswith(".pdf")]
            return together(ranges(files, pages_of, self.per_task, self.whole), self.most)

        def read(self, partition: Pages | None) -> Iterator[pa.RecordBatch]:
            open_document = documents()

            def rows() -> Iterator[tuple]:
                for path, first, end in partition.items if partition else ():
                    with self._open(path) as file:
                        document = open_document(file)
                        for n in range(first, len(document) if end is None else end):  # rendered one after the other
                            yield doc_id(path), n, *document.page(n)

            yield from batched(rows())

    return PdfPages


def pages(spark, path: str, documents: Documents = pymupdf_documents, pages_per_task: int = 16, whole_bytes: int = 1 << 20):
    """The pages (``PAGES``) of all PDF files under ``path``, or of the one that it names."""
    spark.dataSource.register(source(documents))
    return spark.read.format("pdf_pages").option("pages_per_task", pages_per_task).option("whole_bytes", whole_bytes).load(path)
