"""Reading tables: CSV with sniffed delimiter and encoding, JSON, Parquet; writing them."""

from __future__ import annotations

import codecs
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lookup import blank_to_null, nan_to_null

# The encodings that are known, and the names by which Spark reads them. Those of SINGLE are read as the first of them and translated.
ENCODINGS = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "utf-16": "UTF-16", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-32": "UTF-32", "utf-32-be": "UTF-32", "ascii": "US-ASCII"}
SINGLE = ("iso-8859-1", "latin1", "cp1252", "cp1250", "macroman")
# Byte order marks, the longer ones first.
MARKS = ((b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
SNIFFED_LINES = 100
SNIFFED_BYTES = 1 << 18


def head_of(spark: SparkSession, path: str, limit: int = SNIFFED_BYTES) -> bytes:
    """The first bytes of a file (of the first one of a folder or pattern), from any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((f for f in fs.globStatus(at) or []), key=lambda f: f.getPath().toString())
    if found and found[0].isDirectory():
        found = sorted((f for f in fs.listStatus(found[0].getPath()) if f.isFile() and f.getPath().getName()[0] not in "._"), key=lambda f: f.getPath().toString())
    if not found:
        raise FileNotFoundError(path)
    stream = fs.open(found[0].getPath())
    try:
        # one byte a character on the way
        return jvm.org.apache.commons.io.IOUtils.toString(jvm.org.apache.commons.io.input.BoundedInputStream(stream, limit), "ISO-8859-1").encode("latin-1")
    finally:
        stream.close()


def sniff_encoding(head: bytes) -> str:
    """The encoding of a file by its first bytes.

    A byte order mark decides; then zero bytes, which of the encodings only those of two or four bytes have: their place in the
    unit tells its order (four bytes in little-endian order need a mark to be read); then whether the bytes are UTF-8. All else is iso-8859-1, which takes any bytes:
    other encodings of single bytes can't be told from it and have to be named.
    """
    for mark, name in MARKS:
        if head.startswith(mark):
            return name
    if b"\x00" in head:
        zeros = [head[i::4].count(0) for i in range(4)]
        quarter = max(1, len(head) // 4)
        if min(zeros[2:]) > 0.9 * quarter and zeros[0] < quarter / 2:
            return "utf-32-le"
        if min(zeros[:2]) > 0.9 * quarter and zeros[3] < quarter / 2:
            return "utf-32-be"
        return "utf-16-le" if zeros[1] + zeros[3] >= zeros[0] + zeros[2] else "utf-16-be"
    try:
        # the last character may be cut
        codecs.getincrementaldecoder("utf-8")().decode(head)
        return "utf-8"
    except UnicodeDecodeError:
        return "iso-8859-1"


def whole_encoding(spark: SparkSession, path: str, name: str) -> str:
    """The encoding of the head, unless it is UTF-8 and a later line is not: then the one that takes any bytes."""
    if name not in ("utf-8", "utf-8-sig", "ascii"):
        return name
    bad = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return "iso-8859-1" if bad else name


def sniff_delimiter(text: str, among: str = ",;") -> str:
    """The delimiter whose count per line is the same, most often; else the more frequent one."""
    lines = [x for x in text.splitlines()[:SNIFFED_LINES] if x.strip()]
    if not lines:
        raise ValueError("an empty file has no delimiter")
    scored = []
    for d in among:
        counts = Counter(x.count(d) for x in lines)
        n, often = counts.most_common(1)[0]
        scored.append((often if n else 0, sum(k * v for k, v in counts.items()), d))
    best = max(scored, key=lambda s: (s[0], s[1], -among.index(s[2])))
    return best[2] if best[1] else among[0]


def transcoded(df: DataFrame, encoding: str) -> DataFrame:
    """Texts and column names that were read a byte a character, as the encoding has them; bytes that it leaves out are replacement characters."""
    high = [bytes([b]) for b in range(128, 256)]
    here, there = "".join(b.decode("latin-1") for b in high), "".join(b.decode(encoding, "replace") for b in high)
    names = str.maketrans(here, there)
    one = lambda f: F.translate(f"`{f.name}`", here, there) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
    return df.select(*[one(f).alias(f.name.translate(names)) for f in df.schema])


def read_csv(spark: SparkSession, path: str, schema=None, delimiter: str | None = None, encoding: str | None = None, multiline: bool = False) -> DataFrame:
    """A CSV file with a header; blank strings and NaN are null. Give a schema to save a pass over large files.

    multiline: quoted fields may hold line ends. Such files, and those of units of two or four bytes, can't be cut at
    a byte that ends a line, so each file is one task; all others are split.
    """
    head = head_of(spark, path)
    if not head.strip():
        raise ValueError(f"{path} is empty")
    encoding = (encoding or whole_encoding(spark, path, sniff_encoding(head))).lower()
    marked = next((name for mark, name in MARKS if head.startswith(mark)), None)
    if marked and encoding.startswith(marked.removesuffix("-sig")):
        encoding = marked  # the mark tells the order, and is no part of the first column's name
    text = codecs.getincrementaldecoder(encoding)("replace").decode(head)
    if not text.strip():
        raise ValueError(f"{path} is empty")
    delimiter = delimiter or sniff_delimiter(text)
    if encoding not in (*ENCODINGS, *SINGLE):
        raise ValueError(f"encoding {encoding!r}: one of {', '.join((*ENCODINGS, *SINGLE))} is needed")
    reader = spark.read.option("sep", delimiter).option("header", True).option("encoding", ENCODINGS.get(encoding, "ISO-8859-1")).option("multiLine", multiline or encoding.startswith(("utf-16", "utf-32")))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    rows = reader.csv(path)
    return nan_to_null(blank_to_null(transcoded(rows, encoding) if encoding in SINGLE[2:] else rows))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A unique row number; stable for a stored table, not dense."""
    return df.withColumn(name, F.monotonically_increasing_id())


def to_dicts(df: DataFrame, most: int = 10_000) -> list[dict]:
    """Rows as dictionaries, for small results only."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: keep them in Spark")
    return [r.asDict(recursive=True) for r in rows]


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Parquet, JSON lines, or CSV with a header."""
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)
