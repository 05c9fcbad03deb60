"""Fingerprint archives (ZIP containers) as rows, and rows as archives.

The retrieval vector of an archive (half-precision numbers, as plain bytes or as a ``.npy`` file) is turned into packed sign bits
where the archive is read, so that archives go straight into retrieval and 20 KB of vector become 1.25 KB.
"""

from __future__ import annotations

import ast
import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speakerprint.functions import packed

# Member names and the vector names written by earlier tools.
MANIFEST, SUMMARY, METADATA = "manifest.json", "summary.txt", "metadata.json"
VECTORS = ("vector.bin", "style_vector.bin", "task_vector.bin")
#: A value of a row cannot be longer than this in Spark; such files and members are named in ``error``.
LONGEST = (1 << 31) - 1 - 4096

SCHEMA = (
    "path string, size bigint, is_zip boolean, files array<string>, manifest_json string, metadata_json string,"
    " summary string, summary_utf8 boolean, vector_name string, vector binary, vector_dim bigint, bits array<bigint>, vector_error string, sha256 string, error string"
)
_ARROW = {
    "string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64()),
}
#: Opened archives that a task hands on together: so many rows, and bytes unless one alone has more.
HELD_ROWS, HELD_BYTES = 1_024, 8 << 20
# How an array file begins, and the earliest time that a ZIP member can carry.
NPY = b"\x93NUMPY"
EPOCH = (1980, 1, 1, 0, 0, 0)


def _member(archive: zipfile.ZipFile, name: str | None, errors: list[str]) -> bytes | None:
    """Bytes of a member; one that is damaged or too long for a value is null and leaves the others as they are."""
    if name is None or name not in archive.namelist():
        return None
    try:
        with archive.open(name) as f:
            data = f.read(LONGEST + 1)
    except (zipfile.BadZipFile, ValueError, RuntimeError, NotImplementedError, EOFError, OSError, zlib.error) as e:
        errors.append(f"{name}: {e}")
        return None
    if len(data) > LONGEST:
        errors.append(f"{name} unpacks to more than {LONGEST} bytes")
        return None
    return data


def vector_values(raw: bytes) -> np.ndarray:
    """Half-precision numbers of a vector: the bytes of an array, or an array file with its header."""
    if raw.startswith(NPY):
        size, at = (struct.unpack_from("<H", raw, 8)[0], 10) if raw[6] == 1 else (struct.unpack_from("<I", raw, 8)[0], 12)
        header = ast.literal_eval(raw[at : at + size].decode("latin-1"))
        kind, shape = header["descr"], header["shape"]
        if kind not in ("<f2", ">f2", "|f2", "=f2") or len(shape) != 1:
            raise ValueError(f"vector of {kind} with shape {shape}, not one row of float16")
        body = raw[at + size :]
        if len(body) != 2 * shape[0]:
            raise ValueError(f"vector of {shape[0]} numbers in {len(body)} bytes")
        return np.frombuffer(body, dtype=">f2" if kind[0] == ">" else "<f2")
    if len(raw) % 2:
        raise ValueError(f"vector of {len(raw)} bytes, not a whole number of float16")
    return np.frombuffer(raw, dtype="<f2")


def vector_bits(raw: bytes | None, errors: list[str]) -> tuple[int | None, list[int] | None]:
    """Dimensions and packed sign bits of a vector (bit 1: not below 0); one that cannot be read has none."""
    if raw is None:
        return None, None
    try:
        values = vector_values(raw)
    except (ValueError, SyntaxError, KeyError, TypeError, struct.error, IndexError) as e:
        errors.append(str(e))
        return None, None
    if np.isnan(values).any():
        errors.append("vector with what is not a number")
        return len(values), None
    return len(values), packed.pack((values >= 0)[None, :])[0].tolist()


def _open_one(path: str, content: bytes, raw: bool) -> tuple:
    digest = hashlib.sha256(content).hexdigest()
    errors: list[str] = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            files = archive.namelist()
            vector_name = next((v for v in VECTORS if v in files), None)
            manifest, summary, metadata, vector = (_member(archive, n, errors) for n in (MANIFEST, SUMMARY, METADATA, vector_name))
    except (zipfile.BadZipFile, ValueError, NotImplementedError, EOFError, OSError) as e:
        return (path, len(content), False, [], None, None, None, False, None, None, None, None, None, digest, str(e))

    def text(member: bytes | None) -> tuple[str | None, bool]:
        if member is None:
            return None, False
        try:
            return member.decode("utf-8"), True
        except UnicodeDecodeError:
            return member.decode("utf-8", "replace"), False

    summary_text, utf8 = text(summary)
    unread: list[str] = []
    dim, bits = vector_bits(vector, unread)
    error = "; ".join(errors) or None
    return (path, len(content), True, files, text(manifest)[0], text(metadata)[0], summary_text, utf8, vector_name, vector if raw else None, dim, bits, unread[0] if unread else None, digest, error)


def _opened(batches: Iterator[pa.RecordBatch], raw: bool) -> Iterator[pa.RecordBatch]:
    """Rows of ``SCHEMA`` of batches (path, content); many short archives are handed on together."""
    kinds = pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), kinds)], schema=kinds)
        held.clear()
        return out

    for batch in batches:
        for p, c in zip(batch.column("path"), batch.column("content")):
            row = _open_one(p.as_py(), c.as_py(), raw)
            own = sum(len(x) for x in row if isinstance(x, (bytes, str)))
            if held and size + own > HELD_BYTES:
                yield flush()
                size = 0
            held.append(row)
            size += own
            if len(held) >= HELD_ROWS:
                yield flush()
                size = 0
    if held:
        yield flush()


def open_archives(files: DataFrame, path: str = "path", content: str = "content", raw: bool = True) -> DataFrame:
    """One row per archive of a table ``(path, content)``: texts, vector, its sign bits, and digest.

    ``raw=False`` leaves the bytes of the vector behind once they are bits. A bad file or member gives ``error``, and
    a vector that is none gives ``vector_error``, not a failure.
    """

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _opened(batches, raw)

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).where("content IS NOT NULL").mapInArrow(unzip, SCHEMA)


def ingest_archives(spark: SparkSession, path: str | list[str], pattern: str = "*.fp", raw: bool = True) -> DataFrame:
    """:func:`open_archives` of files.

    Files of any length that Spark can hold in a value (2 GiB) are read whole and unpacked one at a
    time; the contract's limit of 200 KB is a matter of ``validate``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    read = open_archives(files.where(F.col("length") <= LONGEST), raw=raw)
    given = {"path": F.col("path"), "size": F.col("length"), "is_zip": F.lit(False), "summary_utf8": F.lit(False), "files": F.array().cast("array<string>")}
    given["error"] = F.lit("longer than a value can be")
    large = files.where(F.col("length") > LONGEST)
    return read.unionByName(large.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in read.schema.fields]))


def pack_archives(rows: DataFrame, id: str = "id") -> DataFrame:
    """``(id, content)``: the archive of each row ``(id, manifest, summary, metadata, vector)``.

    ``manifest`` and ``metadata`` are JSON texts, ``vector`` an array of numbers that is stored in half precision; a null leaves its member out. The same row
    always gives the same bytes.
    """
    kind = rows.schema[id].dataType.simpleString()
    chosen = rows.select(id, *[F.col(c).cast("string").alias(c) for c in ("manifest", "summary", "metadata")], F.col("vector").cast("array<float>").alias("vector"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = []
            columns = [batch.column(c).to_pylist() for c in ("manifest", "summary", "metadata", "vector")]
            for manifest, summary, metadata, vector in zip(*columns):
                members = {MANIFEST: manifest, SUMMARY: summary, METADATA: metadata}
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                    for name, text in members.items():
                        if text is not None:
                            archive.writestr(zipfile.ZipInfo(name, EPOCH), text.encode(), zipfile.ZIP_DEFLATED)
                    if vector is not None:
                        archive.writestr(zipfile.ZipInfo(VECTORS[0], EPOCH), np.array(vector, dtype="<f2").tobytes())
                contents.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(id), pa.array(contents, pa.binary())], names=[id, "content"])

    return chosen.mapInArrow(pack, f"`{id}` {kind}, content binary")
