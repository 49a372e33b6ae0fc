"""The registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, extract, langid, matroska, middle, packing, periodic, quality, secrets, simhash, suffixdup, tokenfile, toxicity
from .arrowio import has_table, id_text, read_table, store
from .oracles import ORACLES as ORACLES


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract.extract(read_table(spark, sf_dir, "pages"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows of one remainder of four are held out of the fit."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_text() % 4 == 2
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token-id blocks, read back."""
    return tokenfile.read(tokenfile.write(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), spaced=False))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated 200-byte strings."""
    return suffixdup.removed(read_table(spark, sf_dir, "documents")).drop("kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in all documents."""
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows of one remainder of five are held out of the fit."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_text() % 5 == 0
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: four-word shingles, links within four bits."""
    return simhash.components(read_table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a Matroska file in the shared folder, read back and parsed."""
    return matroska.media_digest(store(matroska.store_media(read_table(spark, sf_dir, "documents")), "media"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret candidates of all documents with the forest's verdict; a table of labelled findings trains the forest if there is one."""
    given = secrets.fit_table(read_table(spark, sf_dir, "findings")) if has_table(spark, sf_dir, "findings") else None
    return secrets.scan(read_table(spark, sf_dir, "documents"), given)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids, by column generation."""
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents; one id of ten gets a tail that repeats."""
    return periodic.longest(periodic.detect(read_table(spark, sf_dir, "documents"), ["doc_id"], periodic.planted))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; rows of one remainder of three are held out of the fit."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_text() % 3 == 1
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out, ["n_chars"])
    return quality.score(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"], ["n_chars"])


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in fill-in-the-middle form, and rebuilt from it."""
    return middle.digest(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html": op1_html,
    "op2_language": op2_language,
    "op3_tokens": op3_tokens,
    "op4_suffixes": op4_suffixes,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_media": op8_media,
    "op9_secrets": op9_secrets,
    "op10_packing": op10_packing,
    "op11_periodic": op11_periodic,
    "op12_quality": op12_quality,
    "op13_middle": op13_middle,
}
