"""Document files: which are taken, what is in them, and their pages in chunks.

Rendering and reading PDF files needs libraries that may not be there; they are imported where they are used, and a document that
cannot be read becomes a row with an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlgate.shipping import map_in_pandas
from marlgate.sources.binary import as_uri, read_bytes

# Accepted file types, and the largest file in bytes.
EXTENSIONS = ["pdf", "png", "jpg", "jpeg"]
MOST_BYTES = 50 * 1024 * 1024


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length and content of all files under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime and length of the files that ``scan_files`` finds, without their contents, and of empty files.

    The driver lists ``path`` itself alone; the folders in it, with all that is below them, are listed by tasks.  So many files are best kept in
    many folders, and no file's name goes through the driver.
    """
    from pyarrow.fs import FileSelector, FileSystem, FileType

    uri = as_uri(path.rstrip("/"))
    fs, root = FileSystem.from_uri(uri)
    prefix = uri[: -len(root)] if uri.endswith(root) else uri.split("://")[0] + "://"
    top = [e for e in fs.get_file_info(FileSelector(root)) if not _hidden(e.base_name)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = FileSystem.from_uri(uri)
        for batch in batches:
            for place, is_folder in zip(batch["place"], batch["is_folder"], strict=True):
                found = fs.get_file_info(FileSelector(place, recursive=True) if is_folder else [place])
                rows = [(prefix + e.path, e.mtime, e.size) for e in found if e.type == FileType.File and not any(map(_hidden, e.path[len(root) :].split("/")))]
                yield pd.DataFrame(rows, columns=["path", "modificationTime", "length"])

    folders = spark.createDataFrame([(e.path, e.type == FileType.Directory) for e in top], "place string, is_folder boolean")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(top) // 8)
    return folders.repartition(min(parts, max(len(top), 1))).transform(map_in_pandas, run, "path string, modificationTime timestamp, length bigint")


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def accepted(files: DataFrame) -> DataFrame:
    """Files that may be analysed: a known type, a name that ends in .pdf in any case, and not too large."""
    name = F.lower("path")
    return files.where(F.element_at(F.split(name, "\\."), -1).isin(EXTENSIONS) & name.endswith(".pdf") & (F.col("length") <= MOST_BYTES))


def not_encrypted(infos: DataFrame) -> DataFrame:
    return infos.where(~F.coalesce("encrypted", F.lit(False)))


INFO = "path string, total_pages int, encrypted boolean, metadata map<string,string>, title string, error string"


def read_info(content: bytes) -> tuple[int, bool, dict[str, str]]:
    """Pages, encryption and the string-valued metadata of a PDF file."""
    import io

    from PyPDF2 import PdfReader

    reader = PdfReader(io.BytesIO(content))
    metadata = {str(k).lstrip("/"): v for k, v in (reader.metadata or {}).items() if isinstance(v, str)}
    return len(reader.pages), bool(reader.is_encrypted), metadata


def document_info(files: DataFrame, reader: Callable[[bytes], tuple[int, bool, dict[str, str]]] = read_info, read: Callable[[str], bytes] = read_bytes) -> DataFrame:
    """A row for each file; one that cannot be read has no pages and an error.  Files without their content are read by the tasks."""
    known = [c for c in ("path", "content") if c in files.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, *content in batch[known].itertuples(index=False):
                try:
                    pages, encrypted, metadata = reader(content[0] if content else read(path))
                    rows.append((path, pages, encrypted, metadata, None, None))
                except Exception as e:  # noqa: BLE001  a broken file is a result
                    rows.append((path, 0, False, {}, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "total_pages", "encrypted", "metadata", "title", "error"])

    return files.select(*known).transform(map_in_pandas, run, INFO)


def render_pages(content: bytes, first: int | None, last: int | None, dpi: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(page from 0, JPEG, width, height) of each page from ``first`` to ``last``, counted from 1; one page is held at a time."""
    import io

    from pdf2image import convert_from_bytes, pdfinfo_from_bytes

    total = pdfinfo_from_bytes(content)["Pages"]
    for number in range(first or 1, min(last or total, total) + 1):
        for image in convert_from_bytes(content, dpi=dpi, first_page=number, last_page=number):
            out = io.BytesIO()
            image.save(out, "JPEG")
            yield number - 1, out.getvalue(), image.width, image.height


IMAGES = "path string, page_index int, image binary, width int, height int, error string"


#: How many bytes and rows of images a task gathers before it sends them on.
_SENT_BYTES, _SENT_IMAGES = 4 * 1024 * 1024, 1000


def _frames(images: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Rows of ``IMAGES`` as frames of many small images, or of a large one."""
    columns, rows, size = [c.split()[0] for c in IMAGES.split(", ")], [], 0
    for row in images:
        rows.append(row)
        size += len(row[2] or b"")
        if size >= _SENT_BYTES or len(rows) >= _SENT_IMAGES:
            yield pd.DataFrame(rows, columns=columns, dtype=object)
            rows, size = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns, dtype=object)


def page_images(files: DataFrame, first: int | None = None, last: int | None = None, dpi: int = 200, render: Callable = render_pages) -> DataFrame:
    """A row for each page of each file, sent on some MB at a time; a file fails with one row that has the error.

    A file is rendered by one task; ``range_images`` spreads large files.
    """

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    for image in render(content, first, last, dpi):
                        yield (path, *image, None)
                except Exception as e:  # noqa: BLE001  a broken file is a result
                    yield (path, None, None, None, None, str(e) or type(e).__name__)

    return files.select("path", "content").transform(map_in_pandas, lambda batches: _frames(made(batches)), IMAGES)


def page_ranges(infos: DataFrame, size: int = 10) -> DataFrame:
    """Files (path, total_pages) as ranges of pages: path, chunk_id, start_page from 1, end_page included."""
    return page_chunks(infos.withColumnRenamed("path", "doc_id"), size).drop("total_pages").withColumnRenamed("doc_id", "path")


def range_images(ranges: DataFrame, dpi: int = 200, render: Callable = render_pages, read: Callable[[str], bytes] = read_bytes) -> DataFrame:
    """The images of ``page_ranges``: a row for each page; a range that fails ends with the page that did, and its error.

    Ranges are dealt over tasks by file and range, so a file of many pages is rendered by many tasks.  What is shuffled are names and
    numbers: each task reads the files of its ranges itself, and keeps one at a time.
    """
    parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        held: tuple[str, bytes] | None = None
        for batch in batches:
            for path, start, end in zip(batch["path"], batch["start_page"], batch["end_page"], strict=True):
                at = int(start) - 1
                try:
                    if held is None or held[0] != path:
                        held = (path, read(path))
                    for page, image, width, height in render(held[1], int(start), int(end), dpi):
                        yield (path, page, image, width, height, None)
                        at = page + 1
                except Exception as e:  # noqa: BLE001  a range that fails is a result
                    yield (path, at, None, None, None, str(e) or type(e).__name__)

    dealt = ranges.select("path", "start_page", "end_page").repartition(parts, "path", "start_page").sortWithinPartitions("path", "start_page")
    return dealt.transform(map_in_pandas, lambda batches: _frames(made(batches)), IMAGES)


def page_chunks(infos: DataFrame, size: int = 10) -> DataFrame:
    """Documents (doc_id, total_pages) as chunks of pages: chunk_id, start_page from 1, end_page included."""
    starts = F.when(F.col("total_pages") > 0, F.sequence(F.lit(0), F.col("total_pages") - 1, F.lit(size)))
    found = infos.select("doc_id", "total_pages", F.posexplode(starts).alias("chunk_id", "s"))
    return found.select("doc_id", "chunk_id", (F.col("s") + 1).alias("start_page"), F.least(F.col("s") + size, "total_pages").alias("end_page"), "total_pages")


# Rows that a Python task gathers before it sends them on.
SENT_ROWS = 10_000


class _Rows:
    """Rows of many pages, sent on as one frame: a frame for each page costs more than what is in it."""

    def __init__(self, names: list[str]):
        self.names, self.columns = names, [[] for _ in names]

    def add(self, count: int, **values) -> None:
        """Adds rows; a value that is no list is that of each of them."""
        for name, column in zip(self.names, self.columns, strict=True):
            value = values[name]
            column.extend(value if isinstance(value, list) else [value] * count)

    def full(self) -> bool:
        return len(self.columns[0]) >= SENT_ROWS

    def take(self) -> pd.DataFrame:
        out = pd.DataFrame(dict(zip(self.names, self.columns, strict=True)), dtype=object)
        self.columns = [[] for _ in self.names]
        return out


#: What a detector says of an image: a frame, or lists by the names of its columns.
Detected = pd.DataFrame | dict[str, list]


def _columns(found: Detected, names: list[str]) -> dict[str, list]:
    columns = {n: found[n].tolist() if isinstance(found, pd.DataFrame) else list(found[n]) for n in names}
    if len({len(c) for c in columns.values()}) > 1:
        raise ValueError("a detector's columns differ in length")
    return columns


def detect(pages: DataFrame, detector: Callable[[bytes], Detected], schema: str) -> DataFrame:
    """Applies a layout or text detector to page images.

    ``schema`` names the detector's columns; doc_id and page_index come before them, and a place among the page's rows and an error
    after.  A page on which the detector fails is one row with the error and nothing else.
    """
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _Rows(["doc_id", "page_index", *names, "place", "error"])
        for batch in batches:
            for doc, page, image in zip(batch["doc_id"], batch["page_index"], batch["image"], strict=True):
                try:
                    found = _columns(detector(image), names)
                    count = len(found[names[0]])
                    rows.add(count, doc_id=doc, page_index=page, **found, place=list(range(count)), error=None)
                except Exception as e:  # noqa: BLE001  a page that fails is a result
                    rows.add(1, doc_id=doc, page_index=page, **dict.fromkeys(names), place=None, error=str(e) or type(e).__name__)
                if rows.full():
                    yield rows.take()
        yield rows.take()

    return pages.select("doc_id", "page_index", "image").transform(map_in_pandas, run, f"doc_id bigint, page_index int, {schema}, place bigint, error string")


def failed_pages(pages: DataFrame, *found: DataFrame) -> DataFrame:
    """``pages`` (status, error and others) with status ``error`` and the first error where one of some detectors failed."""
    errors = reduce(DataFrame.unionByName, (f.where("error is not null").select("doc_id", "page_index", F.col("error").alias("_error")) for f in found))
    errors = errors.groupBy("doc_id", "page_index").agg(F.min("_error").alias("_error"))
    joined = pages.join(errors, ["doc_id", "page_index"], "left")
    status = F.when(F.col("_error").isNotNull(), F.lit("error")).otherwise(F.col("status"))
    return joined.withColumn("status", status).withColumn("error", F.coalesce("_error", "error")).select(*pages.columns)


RECOGNISED = "text_idx bigint, text_id string, text string, x0 double, y0 double, x1 double, y1 double, score double, det_score double"


def recognise(pages: DataFrame, boxes: DataFrame, crop: Callable[[bytes, tuple[int, int, int, int]], object], recogniser: Callable[[object], list[tuple[str, float]]]) -> DataFrame:
    """The texts in some boxes of page images, with the boxes' scores as det_score; a page that fails is one row with an error.

    ``pages`` has doc_id, page_index, image, width and height, ``boxes`` doc_id, page_index, place, a box and score.  What is cut out
    is the box within the page; a text keeps its whole box.  Boxes with nothing in the page give no text, and their places remain
    unused: text_id is by place.  A recogniser may read several texts in a box, and they share it.
    """
    whole = boxes.join(pages.select("doc_id", "page_index", "width", "height"), ["doc_id", "page_index"])
    kept = clamp_boxes(whole.select("doc_id", "page_index", "place", "score", F.struct("x0", "y0", "x1", "y1").alias("own"), "x0", "y0", "x1", "y1", "width", "height"))
    item = F.struct("place", "own", "score", "x0", "y0", "x1", "y1")
    grouped = kept.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(item)).alias("boxes"))  # a page's boxes, so not many

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _Rows(_READ)
        for batch in batches:
            for doc, page, image, found in zip(batch["doc_id"], batch["page_index"], batch["image"], batch["boxes"], strict=True):
                boxes = [(b["place"], tuple(b["own"][c] for c in _BOX), b["score"], tuple(b[c] for c in _BOX)) for b in found]
                _add_read(rows, doc, page, image, boxes, crop, recogniser)
                if rows.full():
                    yield rows.take()
        yield rows.take()

    return pages.select("doc_id", "page_index", "image").join(grouped, ["doc_id", "page_index"]).transform(map_in_pandas, run, f"doc_id bigint, page_index int, {RECOGNISED}, error string")


_BOX = ("x0", "y0", "x1", "y1")
_READ = ["doc_id", "page_index", *(c.split()[0] for c in RECOGNISED.split(", ")), "error"]


def _add_read(rows: _Rows, doc: int, page: int, image: bytes, boxes: list[tuple], crop: Callable, recogniser: Callable) -> None:
    """The texts in the boxes (place, whole box, score, box in the page) of one page, or the error of the page."""
    found, error = [], None
    try:
        for place, own, det_score, inner in boxes:
            for text, score in recogniser(crop(image, inner)):
                found.append((len(found), f"text_{place}", text, *own, score, det_score))
    except Exception as e:  # noqa: BLE001  a page that fails is a result
        found, error = [(None,) * (len(_READ) - 3)], str(e) or type(e).__name__
    if found:
        rows.add(len(found), doc_id=doc, page_index=page, **dict(zip(_READ[2:-1], map(list, zip(*found, strict=True)), strict=True)), error=error)


def _pixel(value: float | None, edge: int, most: bool) -> int:
    """A coordinate in whole pixels, not beyond the edge: what ``clamp_boxes`` says."""
    if value is None:
        return edge
    whole = 0 if math.isnan(value) else math.floor(value)
    return min(edge, whole) if most else max(edge, whole)


def _clamped(found: dict[str, list], width: int, height: int) -> list[tuple]:
    """The boxes of a page that have something in it, as ``_add_read`` takes them."""
    out = []
    for place, (x0, y0, x1, y1, score) in enumerate(zip(*(found[n] for n in (*_BOX, "score")), strict=True)):
        inner = (_pixel(x0, 0, False), _pixel(y0, 0, False), _pixel(x1, width, True), _pixel(y1, height, True))
        if inner[2] > inner[0] and inner[3] > inner[1]:
            out.append((place, (x0, y0, x1, y1), score, inner))
    return out


def detect_and_recognise(pages: DataFrame, detector: Callable[[bytes], Detected], crop: Callable, recogniser: Callable) -> DataFrame:
    """Texts of page images by a detector of text boxes (x0, y0, x1, y1, score) and a recogniser; failures of either as error rows.

    Both look at an image where it lies, one after the other, so neither images nor boxes are moved; the rows are those of ``detect``
    and ``recognise``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _Rows(_READ)
        for batch in batches:
            for doc, page, image, width, height in zip(batch["doc_id"], batch["page_index"], batch["image"], batch["width"], batch["height"], strict=True):
                try:
                    boxes = _clamped(_columns(detector(image), [*_BOX, "score"]), width, height)
                except Exception as e:  # noqa: BLE001  a page that fails is a result
                    rows.add(1, **{**dict.fromkeys(_READ), "doc_id": doc, "page_index": page, "error": str(e) or type(e).__name__})
                else:
                    _add_read(rows, doc, page, image, boxes, crop, recogniser)
                if rows.full():
                    yield rows.take()
        yield rows.take()

    return pages.select("doc_id", "page_index", "image", "width", "height").transform(map_in_pandas, run, f"doc_id bigint, page_index int, {RECOGNISED}, error string")


def clamp_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes cut to their page (width, height), in whole pixels; empty ones are left out."""
    whole = lambda c: F.floor(c).cast("int")
    cut = boxes.select(
        *(c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")),
        F.greatest(F.lit(0), whole(F.col("x0"))).alias("x0"), F.greatest(F.lit(0), whole(F.col("y0"))).alias("y0"),
        F.least("width", whole(F.col("x1"))).alias("x1"), F.least("height", whole(F.col("y1"))).alias("y1"),
    )
    return cut.where("x1 > x0 and y1 > y0")
