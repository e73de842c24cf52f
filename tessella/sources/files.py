"""Files as tables: strict manifests, key-value lines, archives, movies, blobs.

Files are read by Spark's own readers, so any store that Spark reads will do;
one file's bytes are one row, and files are dealt over tasks.
"""

import io
import json
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessella.functions.texts import first_reason, unsafe_path
from tessella.operators.audit import set_digest
from tessella.operators.pixels import measure
from tessella.sources.headers import decoder_configuration, header_of, upright
from tessella.operators.validation import agree, detected_type
from tessella.sources.shared import move_over, read_text, write_text

# Boxes of a movie file that hold boxes, and the most levels read.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta")
MOST_LEVELS = 8
#: Limits of an archive that is read: bytes of an entry and in all, entries, and compression.
MOST_ENTRY, MOST_TOTAL, MOST_ENTRIES, MOST_RATIO = 256 << 20, 4 << 30, 20_000, 100.0
#: Bytes of a JSON document that is read as one.
MOST_JSON = 8 << 20
CURRENT = "_current"


def read_manifest(spark: SparkSession, path: str, schema: StructType | str, most_bytes: int = MOST_JSON) -> DataFrame:
    """A JSON document as rows of a fixed schema; malformed input and NaN stop the read.

    Unknown fields are found by ``unknown_fields``, since a schema only selects.
    A file above ``most_bytes`` raises ValueError before it is parsed.
    """
    sizes = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0  # the lengths alone are read
    if sizes > most_bytes:
        raise ValueError(f"a manifest has {sizes} bytes, more than {most_bytes}")
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
    return reader.option("allowNonNumericNumbers", False).json(path)


def unknown_fields(spark: SparkSession, path: str, allowed: list[str]) -> DataFrame:
    """(field) for top-level fields of the JSON documents that the manifest may not have."""
    text = spark.read.option("wholetext", True).text(path)
    names = text.select(F.explode(F.json_object_keys("value")).alias("field"))
    return names.where(~F.col("field").isin(allowed)).distinct()


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, name, value) of ``name=value`` lines; blank lines and lines that begin with # are left out.

    Lines keep the order that they have in their file.
    """
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    kept = lines.where(~F.trim("text").rlike("^(#|$)"))
    parts = F.split("text", "=", 2)
    return kept.select("file", "line", F.trim(parts[0]).alias("name"), F.trim(F.try_element_at(parts, F.lit(2))).alias("value"))


def once_only(pairs: DataFrame) -> DataFrame:
    """(name, value, n): names with how often they occur; a strict file has each once."""
    return pairs.groupBy("name").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n"))


def last_assignments(pairs: DataFrame) -> DataFrame:
    """(name, value): the last assignment of each name holds."""
    return pairs.groupBy("name").agg(F.max(F.struct("file", "line", "value"))["value"].alias("value"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, digest, path, problem) of ``digest  path`` lines: bad lines, unsafe and repeated paths are named."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"), "value")
    rows = lines.select(
        "file", F.lower(F.regexp_extract("value", r"^([0-9a-fA-F]{64}) [ *](.+)$", 1)).alias("digest"),
        F.regexp_extract("value", r"^([0-9a-fA-F]{64}) [ *](.+)$", 2).alias("path"),
    )
    n = rows.groupBy("file", "path").agg(F.count(F.lit(1)).alias("n"))
    unsafe = F.col("path").rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)|[\p{Cc}\p{Cf}]")
    problem = F.when(F.col("digest") == "", "BAD_LINE").when(unsafe, "UNSAFE_PATH").when(F.col("n") > 1, "REPEATED_PATH")
    return rows.join(n, ["file", "path"]).select("file", "digest", "path", problem.alias("problem"))


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, size, compressed, is_dir, encrypted, problem) of archives, nothing extracted.

    A file that is no archive gives one row with the problem BAD_ARCHIVE.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    infos = zipfile.ZipFile(io.BytesIO(content.as_py())).infolist()
                    rows = [(name, i.filename, i.file_size, i.compress_size, i.is_dir(), bool(i.flag_bits & 1), None) for i in infos]
                except zipfile.BadZipFile:
                    rows = [(name, None, None, None, None, None, "BAD_ARCHIVE")]
                columns = zip(*rows) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    names = ["archive", "name", "size", "compressed", "is_dir", "encrypted", "problem"]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(scan, "archive string, name string, size bigint, compressed bigint, is_dir boolean, encrypted boolean, problem string")


def archive_problems(entries: DataFrame) -> DataFrame:
    """``entries`` of ``zip_entries``, each with the first rule it breaks.

    Unsafe and encrypted entries, names that fall together when case is folded
    (all but the first by name), entries too large or too much compressed, and
    archives with too many entries or bytes.
    """
    key = F.lower(F.regexp_replace("name", r"/+$", ""))
    same = Window.partitionBy("archive", key).orderBy("name")
    whole = entries.groupBy(F.col("archive").alias("a")).agg(F.count("name").alias("entries"), F.sum(F.when(~F.col("is_dir"), F.col("size"))).alias("bytes"))
    ratio = F.col("size") / F.greatest(F.col("compressed"), F.lit(1))
    problem = F.coalesce(
        F.col("problem"),
        first_reason(
            (unsafe_path(F.col("name")), "UNSAFE_PATH"), (F.col("encrypted"), "ENCRYPTED"), (F.col("k") > 1, "REPEATED_PATH"), (F.col("size") > MOST_ENTRY, "ENTRY_TOO_LARGE"),
            (~F.col("is_dir") & (ratio > MOST_RATIO), "COMPRESSION_RATIO"), (F.col("entries") > MOST_ENTRIES, "TOO_MANY_ENTRIES"), (F.col("bytes") > MOST_TOTAL, "ARCHIVE_TOO_LARGE"),
        ),
    )
    joined = entries.withColumn("k", F.row_number().over(same)).join(whole, F.col("archive") == F.col("a"))
    return joined.withColumn("problem", problem).select(*entries.columns)


def archive_totals(entries: DataFrame) -> DataFrame:
    """Files, pictures, movies, bytes and compression of each archive; ratio 0 for nothing compressed."""
    files = F.col("is_dir") == F.lit(False)
    ends = lambda *kinds: F.count_if(files & F.lower("name").rlike(rf"\.({'|'.join(kinds)})$"))
    out = entries.groupBy("archive").agg(
        F.count_if(files).alias("n_files"), ends("jpe?g", "png", "webp", "tiff?").alias("n_images"), ends("mp4", "mov", "webm").alias("n_videos"),
        F.coalesce(F.sum(F.when(files, F.col("size"))), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(files, F.col("compressed"))), F.lit(0)).alias("compressed"), F.count("problem").alias("n_problems"),
    )
    return out.withColumn("ratio", F.when(F.col("compressed") > 0, F.col("bytes") / F.col("compressed")).otherwise(0.0))


def movie_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(file, level, box, start, size, problem) of movie files' boxes, containers opened.

    A box that runs past its parent ends the walk there with the problem BAD_SIZE.
    """

    def walk(data: memoryview, start: int, end: int, level: int, out: list) -> None:
        while start < end:
            size = int.from_bytes(data[start : start + 4], "big") if end - start >= 8 else -1
            head, box = 8, bytes(data[start + 4 : start + 8])
            if size == 1 and end - start >= 16:
                size, head = int.from_bytes(data[start + 8 : start + 16], "big"), 16
            elif size == 0:
                size = end - start
            if size < head or start + size > end:
                out.append((level, box.decode("latin-1"), start, size, "BAD_SIZE"))
                return
            out.append((level, box.decode("latin-1"), start, size, None))
            if box in CONTAINERS and level < MOST_LEVELS:
                walk(data, start + head, start + size, level + 1, out)
            start += size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list = []
                data = memoryview(content.as_buffer())
                walk(data, 0, len(data), 0, rows)
                columns = list(zip(*rows)) if rows else [[]] * 5
                arrays = [pa.array([name] * len(rows), pa.string()), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["file", "level", "box", "start", "size", "problem"])

    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(scan, "file string, level int, box string, start bigint, size bigint, problem string")


# Where the boxes of a visual sample entry begin in a table of entries.
ENTRY_CHILDREN = 94
TRACK_NUMBERS = ("coded_width", "coded_height", "sized_samples", "sync_samples", "first_sync", "profile", "level", "nal_length", "n_sequence", "n_picture", "avc_width", "avc_height")


def _track(data: memoryview, boxes: list[tuple[bytes, int, int]]) -> dict:
    """What the boxes of one track say; fields that are missing or cut off stay null."""
    number = lambda at, n: int.from_bytes(data[at : at + n], "big") if at + n <= len(data) else None
    out: dict = {}
    for kind, start, end in boxes:
        version = data[start] if start < end else 0
        if kind == b"tkhd" and end - start >= 84:
            out["width"], out["height"] = number(end - 8, 2), number(end - 4, 2)
        elif kind == b"mdhd":
            at = start + (20 if version else 12)
            out["timescale"], out["ticks"] = number(at, 4), number(at + 4, 8 if version else 4)
        elif kind == b"hdlr":
            out["handler"] = bytes(data[start + 8 : start + 12]).decode("latin-1")
        elif kind == b"stsd":
            out["codec"] = bytes(data[start + 12 : start + 16]).decode("latin-1")
            out["coded_width"], out["coded_height"] = number(start + 40, 2), number(start + 42, 2)
            at = start + ENTRY_CHILDREN  # the boxes within the first entry
            while at + 8 <= end and (size := number(at, 4)) >= 8:
                if bytes(data[at + 4 : at + 8]) == b"avcC":
                    out |= decoder_configuration(bytes(data[at + 8 : min(at + size, end)]))
                at += size
        elif kind == b"stsz":
            out["sized_samples"] = number(start + 8, 4)
        elif kind == b"stss":
            out["sync_samples"] = number(start + 4, 4)
            out["first_sync"] = number(start + 8, 4) if out["sync_samples"] else None
        elif kind == b"stts":
            runs = [(number(at, 4), number(at + 4, 4)) for at in range(start + 8, min(end, start + 8 + 8 * (number(start + 4, 4) or 0)) - 7, 8)]
            out["samples"], out["run_ticks"] = sum(n for n, _ in runs), sum(n * d for n, d in runs)
    return out


def movie_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(file, track, handler, codec, width, height, timescale, ticks, samples, run_ticks, ..., seconds, agrees) of movie files' tracks.

    Also: the sizes in the first sample entry, the number of sized samples, of sync
    samples (null: all are) and the first of them, and for H.264 what
    ``headers.decoder_configuration`` says. ``agrees``: the duration in the header is that of the run lengths, within half
    a second or a twentieth. Boxes as in ``movie_boxes``; a file without tracks
    gives no rows.
    """

    def tracks(data: memoryview) -> list[dict]:
        found: list[list] = []

        def walk(start: int, end: int, level: int, into: list | None) -> None:
            while end - start >= 8:
                size, head = int.from_bytes(data[start : start + 4], "big"), 8
                kind = bytes(data[start + 4 : start + 8])
                if size == 1 and end - start >= 16:
                    size, head = int.from_bytes(data[start + 8 : start + 16], "big"), 16
                size = size or end - start
                if size < head or start + size > end:
                    return
                if kind == b"trak":
                    found.append([])
                if kind in CONTAINERS and level < MOST_LEVELS:
                    walk(start + head, start + size, level + 1, found[-1] if kind == b"trak" else into)
                elif into is not None:
                    into.append((kind, start + head, start + size))
                start += size

        walk(0, len(data), 0, None)
        return [_track(data, boxes) for boxes in found]

    fields = [("handler", pa.string()), ("codec", pa.string()), *((n, pa.int64()) for n in ("width", "height", "timescale", "ticks", "samples", "run_ticks", *TRACK_NUMBERS)), ("problem", pa.string())]
    kinds = pa.schema([("file", pa.string()), ("track", pa.int32()), *fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [{"file": name, "track": i, **t} for i, t in enumerate(tracks(memoryview(content.as_buffer())))]
                yield pa.RecordBatch.from_pylist(rows, kinds)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    columns = ", ".join(f"{n} {'string' if t == pa.string() else 'bigint'}" for n, t in fields)
    rows = files.mapInArrow(scan, f"file string, track int, {columns}")
    scale = F.when(F.col("timescale") > 0, F.col("timescale"))
    return rows.withColumns({"seconds": F.col("ticks") / scale, "agrees": agree(F.col("ticks") / scale, F.col("run_ticks") / scale, 0.5, 0.05)})


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """(file, width, height, channels, orientation, measured): pictures as they are to be seen, with their metrics.

    Spark's own reader decodes them; what it can't, and what ``headers.picture_header``
    refuses (sizes aside that are only too small), is left out.
    """
    files = spark.read.format("binaryFile").load(path).select("path", header_of(F.col("content")).alias("h"))
    fine = files.where("h.problem IS NULL OR h.problem = 'TOO_SMALL'").select("path", "h.orientation")
    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    same = lambda name: F.regexp_replace(name, "^file:/+", "/")  # noqa: E731  the two readers write local paths differently
    seen = image.join(fine, same("origin") == same("path")).withColumn("u", upright(F.col("data"), F.col("width"), F.col("height"), F.col("nChannels"), F.col("orientation")))
    measured = measure(F.col("u.data"), F.col("u.width"), F.col("u.height"), F.col("nChannels"), bgr=True)
    return seen.select(F.col("origin").alias("file"), "u.width", "u.height", F.col("nChannels").alias("channels"), "orientation", measured.alias("measured"))


def indexed_files(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """(sha256, media_type, content, problem) for the entries of an index (sha256, media_type): the file with that digest, read again and hashed.

    MISSING where no file has the digest, TYPE_DIFFERS where its first bytes say
    another type; content is null in both cases.
    """
    files = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("digest"), "content").dropDuplicates(["digest"])
    joined = index.select("sha256", "media_type").join(files, F.col("sha256") == F.col("digest"), "left")
    problem = F.when(F.col("digest").isNull(), "MISSING").when(~detected_type(F.col("content")).eqNullSafe(F.col("media_type")), "TYPE_DIFFERS")
    return joined.select("sha256", "media_type", F.when(problem.isNull(), F.col("content")).alias("content"), problem.alias("problem"))


def new_blobs(blobs: DataFrame, store: DataFrame, content: str = "content") -> DataFrame:
    """(sha256, content) of blobs that the store hasn't: what a content-addressed sink appends. Equal blobs come once."""
    hashed = blobs.select(F.sha2(content, 256).alias("sha256"), F.col(content).alias("content")).where("content is not null")
    return hashed.dropDuplicates(["sha256"]).join(store.select("sha256"), "sha256", "left_anti")


def _row_digest(vector: str, keys: tuple[str, ...]) -> Column:
    return F.sha2(F.to_json(F.struct(*keys, F.transform(vector, lambda x: x.cast("string")).alias("vector")), {"ignoreNullFields": "false"}), 256)


def write_view_archive(views: DataFrame, path: str, identity: dict, vector: str, *keys: str) -> None:
    """Views as Parquet with a digest of every row, and a manifest beside them that binds the archive.

    ``identity`` says what the vectors are: library, model, revision and so on.
    The manifest also has the number of rows, their dimension, and a digest of
    all rows; it is written last, so an archive is complete or has none.
    """
    views.withColumn("row_sha256", _row_digest(vector, keys)).write.mode("error").parquet(f"{path}/views")
    spark = views.sparkSession
    written = spark.read.parquet(f"{path}/views")
    n, least, most = written.agg(F.count(F.lit(1)), F.min(F.size(vector)), F.max(F.size(vector))).first()
    if n and least != most:
        raise ValueError(f"vectors have {least} to {most} dimensions")
    digest = set_digest(written, F.col("row_sha256")).first().digest
    write_text(spark, f"{path}/manifest.json", json.dumps({**identity, "rows": n, "dimension": most or 0, "rows_sha256": digest}, sort_keys=True))


def read_view_archive(spark: SparkSession, path: str, expected: dict, vector: str, *keys: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """The archive's views that agree with their digests, those that don't, and what binds it wrongly.

    The third are the names in ``expected`` for which the manifest says otherwise,
    and rows, dimension or rows_sha256 where the rows do. Without a manifest it is
    ["manifest"].
    """
    rows = spark.read.parquet(f"{path}/views")
    good: Column = F.col("row_sha256").eqNullSafe(_row_digest(vector, keys))
    text = read_text(spark, f"{path}/manifest.json")
    if text is None:
        return rows.where(good).drop("row_sha256"), rows.where(~good), ["manifest"]
    manifest = json.loads(text)
    n, least, most = rows.agg(F.count(F.lit(1)), F.min(F.size(vector)), F.max(F.size(vector))).first()
    actual = {**expected, "rows": n, "rows_sha256": set_digest(rows, F.col("row_sha256")).first().digest, "dimension": most or 0}
    wrong = [name for name, value in actual.items() if manifest.get(name) != value]
    if least != most and "dimension" not in wrong:
        wrong.append("dimension")
    return rows.where(good).drop("row_sha256"), rows.where(~good), wrong


def publish(df: DataFrame, check: Column, path: str) -> None:
    """Write a new version of a table below ``path``, check every row, and only then make it the current one.

    A pointer file names the current version and is replaced in one step, so a
    reader sees the old table or the new one, and a crash leaves the old one.
    Raises ValueError, leaving the pointer as it was, if a row fails ``check``.
    """
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    written = spark.read.schema(df.schema).parquet(f"{path}/{version}")
    if not written.where(~F.coalesce(check, F.lit(False))).isEmpty():
        raise ValueError("a row fails the check")
    write_text(spark, f"{path}/{version}.pointer", version)
    move_over(spark, f"{path}/{version}.pointer", f"{path}/{CURRENT}")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that ``publish`` put in place."""
    version = read_text(spark, f"{path}/{CURRENT}")
    if version is None:
        raise ValueError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/{version}")


def write_document(row: DataFrame, path: str) -> None:
    """The one row of a table as a JSON document, put in place in one step; any other number of rows raises ValueError."""
    found = row.select(F.to_json(F.struct(*row.columns), {"ignoreNullFields": "false"}).alias("json")).limit(2).collect()
    if len(found) != 1:
        raise ValueError("a document is exactly one row")
    draft = f"{path}.{uuid.uuid4().hex}"
    write_text(row.sparkSession, draft, found[0].json)
    move_over(row.sparkSession, draft, path)


def write_review_sheet(df: DataFrame, path: str) -> None:
    """CSV with a header, for people to fill in."""
    df.write.mode("error").option("header", True).csv(path)
