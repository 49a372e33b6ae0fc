"""Fill-in-the-middle: a text becomes prefix, suffix and middle, cut at units that a hash of its id draws.

The units of a text (by default its lines) are never held in an array. A first pass over a lazy
iterator of matches counts them; the hash of the id turns the count into two ranks; a second
pass advances a fresh iterator to the smaller rank and then on to the larger one, and notes the two
offsets it passes. Besides the text itself and its output, memory is constant.

Layouts: psm `<P>`prefix`<S>`suffix`<M>`middle, spm `<S>`suffix`<P>`prefix`<M>`middle, plain: the text as it is. A text that
is empty or contains one of the three marks stays plain, so a mark in an output can only be one
that was put there, and `restore` gives back every text exactly.

Null texts count as empty; a null id draws what the empty id draws. Repeated rows get equal
results, texts of any length are cut as a whole, an empty table gives an empty result, and further columns are handed on only if
they are asked for (`keep`), so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import column, map_arrow, texts

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Draws begin with the seed; of a hundred texts so many are transformed, and of a hundred of these so many as spm.
SEED, RATE, SPM = 7, 100, 50


def draws(doc_id: object, seed: int = SEED) -> tuple[int, ...]:
    """Four numbers of 32 bits by the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def count(unit: re.Pattern, text: str) -> int:
    """First pass: the number of units."""
    return sum(1 for _ in unit.finditer(text))


def _advance(matches: Iterator[re.Match], steps: int, at: int) -> int:
    """The end of the match that is `steps` further on; `at` for none."""
    last = next(islice(matches, steps - 1, None)) if steps else None
    return last.end() if last else at


def offsets(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: the code points after which `low` and `high` units end."""
    matches = unit.finditer(text)
    a = _advance(matches, low, 0)
    return a, _advance(matches, high - low, a)


def transform(text: str, doc_id: object, unit: re.Pattern, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, characters of the middle, output)."""
    n = count(unit, text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = offsets(unit, text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text of an output."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError(f"no {form} output: {first} is missing at its start")
    one, rest = output[len(first) :].split(second, 1)
    other, middle = rest.split(MIDDLE, 1)
    return one + middle + other if form == "psm" else other + middle + one


def fill_in_middle(docs: DataFrame, keep: list[str], unit: str = LINES, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """keep columns, n, form, prefix_chars, middle_chars, output; one map, no shuffle. Units must cover the text up to its end or leave the rest to the suffix."""
    found = re.compile(unit)

    def run(batches):
        for batch in batches:
            out = [transform(t or "", i, found, seed, rate, spm) for i, t in zip(texts(batch, "__id"), texts(batch, "__text"), strict=True)]
            n, form, prefix, middle, output = map(list, zip(*out, strict=True)) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, k) for k in keep), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                [*keep, "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    rows = docs.select(*[F.col(f"`{k}`") for k in keep], F.col("doc_id").cast("string").alias("__id"), F.col("text").alias("__text"))
    return map_arrow(rows, run, f"{schema}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(transformed: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns and the text rebuilt from output and form alone."""

    def run(batches):
        for batch in batches:
            back = [restore(o, f) for o, f in zip(texts(batch, "__output"), texts(batch, "__form"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in keep), pa.array(back, pa.string())], [*keep, "restored"])

    schema = ", ".join(f"`{k}` {transformed.schema[k].dataType.simpleString()}" for k in keep)
    rows = transformed.select(*[F.col(f"`{k}`") for k in keep], F.col("output").alias("__output"), F.col("form").alias("__form"))
    return map_arrow(rows, run, f"{schema}, restored string")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the hashes of output and restored text."""
    done = fill_in_middle(docs, ["doc_id"])
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    hashed = done.select("*", sha("output").alias("output_sha256"))
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    return restored(hashed, kept).select(*kept, sha("restored").alias("restored_sha256"))
