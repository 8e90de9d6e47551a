"""Pages made ready for retrieval: English text only, in chunks of whole sentences that keep their page and place."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks, english
from ..sources.tables import read
from .catalog import query

C = F.col


def held_out():
    """A quarter of the documents, by their id: what the scorer is not fitted on."""
    return F.pmod(F.crc32(C("doc_id").cast("string").cast("binary")), F.lit(4)) == 3


def scorer(spark, d):
    return english.fitted(read(spark, d, "documents").filter(~held_out()))


@query("english_texts")
def english_texts(spark, d):
    """What is English of each document, blocks first, then lines; held against a plain version."""
    kept = english.english_only(read(spark, d, "documents").select("doc_id", "lang", "text"), "text", scorer(spark, d))
    return kept.select("doc_id", "lang", held_out().alias("held_out"), "text")


@query("sentence_chunks")
def sentence_chunks(spark, d):
    """Chunks of documents by whole sentences, 512 tokens with 64 of overlap."""
    c = chunks.chunked(read(spark, d, "documents").select("doc_id", "text"), ["doc_id"])
    return c.select("doc_id", "chunk", "start", "fresh", "end", "n_tokens", F.md5(C("text").cast("binary")).alias("digest"))


@query("ingested_pages")
def ingested_pages(spark, d):
    """Conversations as manuals: each turn a page, reduced to its English text and cut into chunks that know their page."""
    pages = read(spark, d, "conversations").select("conv_id", C("turn").alias("page"), "text")
    kept = english.english_only(pages, "text", scorer(spark, d))
    return chunks.chunked(kept, ["conv_id", "page"], size=64, overlap=16).select("conv_id", "page", "chunk", "start", "fresh", "end", "n_tokens", F.md5(C("text").cast("binary")).alias("digest"))
