"""Document sources: CSV, text folders, PDF; all give document_id, source_path, text and metadata columns."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.functions.text import strip
from mosaiq.operators.checkpoint import exists
from mosaiq.session import written

#: Spellings that a CSV reader of data frames takes for missing.
NULL_TOKENS = ["", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "<NA>", "#N/A"]


def _present(spark: SparkSession, path: str) -> None:
    if not exists(spark, path):
        raise FileNotFoundError(path)


def _cleared(df: DataFrame, columns: list[str], tokens: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(tokens), F.col(f"`{c}`")) if kinds[c] == "string" else F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in columns})


def _ordinals(df: DataFrame, folder: bool, multi_line: bool) -> DataFrame:
    """df with mq_row, the row's number from 0 in its file. A partition numbers its rows one after the other, split by split;
    where each split begins is a table of one row a split."""
    numbered = df.withColumn("mq_row", F.monotonically_increasing_id())
    if not folder and multi_line:
        return numbered  # one file in one split
    splits = numbered.groupBy("mq_file", "mq_start").agg(F.min("mq_row").alias("mq_low"), F.count(F.lit(1)).alias("mq_n"))
    before = Window.partitionBy("mq_file").orderBy("mq_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = written(splits.withColumn("mq_low", F.col("mq_low") - F.coalesce(F.sum("mq_n").over(before), F.lit(0))).drop("mq_n"))
    return numbered.join(splits, ["mq_file", "mq_start"]).withColumn("mq_row", F.col("mq_row") - F.col("mq_low"))


#: A record that a reader of CSV takes as it is meant: quotes only around fields, and doubled inside them.
_RECORD = r'^(?:[^",\r\n]*|"(?:[^"]|"")*")(?:,(?:[^",\r\n]*|"(?:[^"]|"")*"))*'


def _file() -> Column:
    """The name of the file that a row is from."""
    return F.element_at(F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/"), -1)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of batches that lie in one split, with its (file, start)."""
    for batch in batches:
        keys = list(zip(batch.column("mq_file").to_pylist(), batch.column("mq_start").to_pylist()))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield keys[a], batch.slice(a, b - a)


def _quotes(lines: pa.Array, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the text is inside quotes before each line, and after it."""
    after = (np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)) + before) & 1
    return np.concatenate(([before], after[:-1])), after


def _blank(lines: pa.Array, crlf: bool) -> np.ndarray:
    return pc.is_in(lines, value_set=pa.array(["", "\r"] if crlf else [""])).to_numpy(zero_copy_only=False)


def _sums(crlf: bool):
    """For each split: whether its quotes are odd, and how many records end in it if it begins outside of quotes, or inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[tuple, list[int]] = {}
        for key, part in _segments(batches):
            lines, has = part.column("value"), told.setdefault(key, [0, 0, 0])
            empty, odd = _blank(lines, crlf), has[0]
            for inside in (0, 1):
                began, ended = _quotes(lines, odd ^ inside)
                has[1 + inside] += int(np.sum((ended == 0) & ~(empty & (began == 0))))
                has[0] = int(ended[-1]) ^ inside
        cols = [[k[0] for k in told], [k[1] for k in told], *([v[i] for v in told.values()] for i in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["mq_file", "mq_start", "mq_odd", "mq_out", "mq_in"])

    return run


def _bad(records: pa.Array, crlf: bool) -> int:
    return len(records) - (pc.sum(pc.match_substring_regex(records, _RECORD + (r"\r?$" if crlf else "$"))).as_py() or 0)


def _malformed(crlf: bool):
    """How many of a batch's records aren't well formed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_bad(batch.column("mq_record"), crlf)], pa.int64())], ["mq_row"])

    return run


def _records(crlf: bool, whole: bool):
    """Records (mq_file, mq_start, mq_row, mq_record). whole: those that begin and end in one split; else the pieces of the others,
    and for each split one row without text that has in mq_row the number of records that aren't well formed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, rows, texts):
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(rows, pa.int64()), texts], ["mq_file", "mq_start", "mq_row", "mq_record"])

        def closed():
            if last is not None and not whole:
                if open_:
                    yield out(last, [row], pa.array(["\n".join(x for a in open_ for x in a.to_pylist())]))
                yield out(last, [bad], pa.nulls(1, pa.string()))

        last, open_, row, odd, cut, bad = None, [], 0, 0, False, 0
        for key, part in _segments(batches):
            if key != last:
                yield from closed()
                last, open_, bad = key, [], 0
                row, odd = part.column("mq_first")[0].as_py(), part.column("mq_inside")[0].as_py()
                cut = bool(odd)  # the first record began in a split before
            lines = part.column("value")
            began, ended = _quotes(lines, odd)
            odd = int(ended[-1])
            ends = np.flatnonzero(ended == 0) + 1
            if not len(ends):
                open_.append(lines)
                continue
            joined = pa.concat_arrays([*open_, lines])
            shift = len(joined) - len(lines)
            offsets = np.concatenate(([0], ends + shift)).astype(np.int32)
            records = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), joined), "\n")
            open_ = [lines.slice(int(ends[-1]))] if ends[-1] < len(lines) else []
            if cut:
                if not whole:
                    yield out(key, [row], records.slice(0, 1))
                records, row, cut = records.slice(1), row + 1, False
            records = records.filter(pa.array(~_blank(records, crlf)))
            if whole:
                yield out(key, np.arange(row, row + len(records)), records)
            else:
                bad += _bad(records, crlf)
            row += len(records)
        yield from closed()

    return run


def _line_ends(spark: SparkSession, path: str) -> set[str]:
    """How the first lines of the files end, files larger than a split among them; nothing where there is none of these."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = [f for f in fs.listStatus(hadoop) if not f.isDirectory() and f.getPath().getName()[0] not in "._" and f.getLen()]
    if all(f.getLen() <= spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() for f in listed):
        return set()
    out = set()
    for f in listed:
        stream = fs.open(f.getPath())
        head = bytes(stream.readNBytes(1 << 16))
        stream.close()
        m = re.search(rb"\r\n|\r|\n", head)
        out.add(m[0].decode() if m else "")
    return out


def _split_csv(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """Rows of large CSV files with quoted line breaks, with mq_file and mq_row, each split read by a task of its own: whether a
    split begins inside quotes follows from the number of quotes before it. None for files that are small, or that such
    counting can't read: with quotes inside unquoted fields, or line ends of two kinds."""
    ends = _line_ends(spark, path)
    if ends not in ({"\n"}, {"\r\n"}):
        return None
    crlf = ends == {"\r\n"}
    lines = spark.read.option("lineSep", "\n").text(path).select(_file().alias("mq_file"), F.col("_metadata.file_block_start").alias("mq_start"), "value")
    sums = lines.mapInArrow(_sums(crlf), "mq_file string, mq_start long, mq_odd long, mq_out long, mq_in long")
    before = Window.partitionBy("mq_file").orderBy("mq_start").rowsBetween(Window.unboundedPreceding, -1)
    inside = sums.withColumn("mq_inside", F.coalesce(F.sum("mq_odd").over(before), F.lit(0)) % 2)
    first = F.coalesce(F.sum(F.when(F.col("mq_inside") == 1, F.col("mq_in")).otherwise(F.col("mq_out"))).over(before), F.lit(0))
    splits = written(inside.withColumn("mq_first", first).select("mq_file", "mq_start", "mq_inside", "mq_first"))
    placed = lines.join(F.broadcast(splits), ["mq_file", "mq_start"]).select("mq_file", "mq_start", "mq_inside", "mq_first", "value")
    record = "mq_file string, mq_start long, mq_row long, mq_record string"
    pieces = written(placed.mapInArrow(_records(crlf, False), record))
    joined = pieces.where("mq_record is not null").groupBy("mq_file", "mq_row").agg(F.sort_array(F.collect_list(F.struct("mq_start", "mq_record"))).alias("p"))
    joined = written(joined.select("mq_file", "mq_row", F.array_join("p.mq_record", "\n").alias("mq_record")))
    odd = joined.mapInArrow(_malformed(crlf), "mq_row long").unionByName(pieces.where("mq_record is null").select("mq_row"))
    if odd.agg(F.sum("mq_row")).first()[0]:
        return None
    rows = placed.mapInArrow(_records(crlf, True), record).select("mq_file", "mq_row", "mq_record").unionByName(joined)
    rows = rows.where("mq_row > 0").withColumn("mq_row", F.col("mq_row") - 1)  # without the header
    # where line ends are of two characters the reader takes those inside quotes for one
    text = F.replace(F.regexp_replace("mq_record", r"\r\z", ""), F.lit("\r\n"), F.lit("\n")) if crlf else F.col("mq_record")
    return rows.select("mq_file", "mq_row", F.from_csv(text, schema, {"escape": '"'}).alias("r")).select("r.*", "mq_file", "mq_row")


def read_csv(spark: SparkSession, path: str, text_column: str, metadata_columns: list[str] | None = None, document_id_column: str | None = None, auto_generate_ids: bool = True, encoding: str = "utf-8", null_tokens: list[str] | None = None, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """One document for each row with text, of a file or of all files in a folder. Ids: the id column where there is one,
    else stem_row (row from 0 in its file, counted before empty rows go), else random ones, which are written so that
    they stay. Unknown metadata columns are left out; missing text counts as empty.

    Files are split, also where quoted line breaks may be, if there is a schema and the encoding is UTF-8; without it, or where
    quotes are used in other ways, a file is one task, unless multi_line=False says that rows have no line breaks.
    """
    _present(spark, path)
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("encoding", encoding)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if text_column not in df.columns:
        raise ValueError(f"no column {text_column!r}; there are: {', '.join(df.columns)}")
    meta = [c for c in (metadata_columns or []) if c in df.columns]
    own_id = document_id_column if document_id_column in df.columns else None
    rows = _split_csv(spark, path, schema) if schema and multi_line and encoding.lower() in ("utf-8", "utf8") else None
    if rows is None:
        named = df.select("*", _file().alias("mq_file"), F.col("_metadata.file_block_start").alias("mq_start"))
        rows = _ordinals(named, is_folder(spark, path), multi_line)
    rows = rows.withColumn("mq_text", strip(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))))
    rows = _cleared(rows, meta, [t for t in (null_tokens if null_tokens is not None else NULL_TOKENS) if t])
    number = F.col("mq_row").cast("string")
    if own_id:
        ident = F.col(f"`{own_id}`").cast("string")
    elif auto_generate_ids:
        ident = F.concat(F.regexp_replace("mq_file", r"(?<=.)\.[^.]*$", ""), F.lit("_"), number)
    else:
        ident = F.expr("uuid()")
    out = rows.where("mq_text <> ''").select(ident.alias("document_id"), F.concat("mq_file", F.lit(":row_"), number).alias("source_path"), F.col("mq_text").alias("text"), *[F.col(f"`{m}`") for m in meta])
    return out if own_id or auto_generate_ids else written(out)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def read_text_folder(spark: SparkSession, path: str, auto_generate_ids: bool = True, ordered: bool = True) -> DataFrame:
    """One document for each *.txt of a folder (not of folders inside it), in the order of their paths; ordered=False
    spares the sort. Files that are not UTF-8 are left out. Random ids are written, so that they stay."""
    if not exists(spark, path) or not is_folder(spark, path):
        raise NotADirectoryError(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", False).load(path)
    # small files are planned as if each had 4 MB, which makes tasks of a few: as many as their bytes and the cores need are enough
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >> 26))
    files = files.coalesce(tasks)
    name = F.element_at(F.split("path", "/"), -1)
    decoded = F.try_validate_utf8(F.col("content").cast("string"))
    ident = F.regexp_replace(name, r"\.txt$", "") if auto_generate_ids else F.expr("uuid()")
    out = files.select(ident.alias("document_id"), F.col("path").alias("source_path"), strip(decoded).alias("text"), name.alias("filename"), F.lit("txt").alias("source"))
    out = out.where("text is not null and text <> ''")
    out = out if auto_generate_ids else written(out)
    return out.orderBy("source_path") if ordered else out


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """One document for each PDF: page texts joined by line breaks; pages that fail are skipped, so are files without text."""
    _present(spark, path)
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise ImportError("reading PDF needs the package pypdf") from e
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return pdf_documents(files.select("path", "content"))


def pdf_documents(files: DataFrame, pages_of=None) -> DataFrame:
    """Documents of (path, content) rows. pages_of: bytes -> list of functions that give a page's text."""

    def default(data: bytes):
        import pypdf

        return [p.extract_text for p in pypdf.PdfReader(io.BytesIO(data)).pages]

    read = pages_of or default

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                name = path.rsplit("/", 1)[-1]
                try:
                    pages = read(bytes(content))
                except Exception:  # a damaged file gives no document
                    continue
                texts = []
                for page in pages:
                    try:
                        texts.append(page() or "")
                    except Exception:
                        continue
                text = "\n".join(texts).strip()
                if text:
                    out.append((re.sub(r"\.pdf$", "", name), path, text, len(pages), name, "pdf"))
            yield pd.DataFrame(out, columns=["document_id", "source_path", "text", "num_pages", "filename", "source"])

    return files.mapInPandas(run, "document_id string, source_path string, text string, num_pages int, filename string, source string")


def ingest(spark: SparkSession, path: str, format: str = "csv", text_column: str | None = None, metadata_columns: list[str] | None = None, document_id_column: str | None = None, encoding: str = "utf-8", auto_generate_ids: bool = True) -> DataFrame:
    if format == "csv":
        if not text_column:
            raise ValueError("format csv needs text_column")
        return read_csv(spark, path, text_column, metadata_columns, document_id_column, auto_generate_ids, encoding)
    if format == "txt":
        return read_text_folder(spark, path, auto_generate_ids)
    if format == "pdf":
        return read_pdf(spark, path)
    raise ValueError(f"unsupported format: {format}")


def preview(spark: SparkSession, path: str, rows: int = 12) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).limit(rows)
