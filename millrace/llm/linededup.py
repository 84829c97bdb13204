"""Substring dedup by hashing lines and runs of the sentences inside them.

A unit is a line, or a sentence of a line with several, of min_words words or
more.  A shorter line or sentence says little by itself; it counts together
with the pieces after it, and with those before it, up to min_words words, over
line ends too.  Units are normalised (lower case, one space between words), their
128-bit digests are grouped over all texts, the occurrence that ranks first by
(doc_id, digest of the text, offset) stays, and the others that don't overlap it are cut.  The cut spans
keep their offsets in the original text.

A digest's rows are never gathered: its least doc_id comes from a sum that is
combined before the shuffle, and goes back to the rows by a join, which Spark
splits where a line is very common.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import discard, durable
from millrace.llm.textbytes import lean, slices

#: Words of a unit: shorter repeats, such as a licence line or a stock phrase, are no copied passage.
MIN_WORDS = 25
_LINE = re.compile(r"[^\n]+")
_BREAK = re.compile(r"(?<=[.!?])\s+")


def _pieces(text: str, start: int, end: int) -> list[tuple[int, int, int, str]]:
    """(start, end, words, normalised text) of the sentences between start and end that have a word."""
    out, at = [], start
    for a, b in [*[m.span() for m in _BREAK.finditer(text, start, end)], (end, end)]:
        part = text[at:a]
        words = part.split()
        if words:
            lead = at + len(part) - len(part.lstrip())
            out.append((lead, at + len(part.rstrip()), len(words), " ".join(words).lower()))
        at = b
    return out


def units(text: str, min_words: int) -> list[tuple[int, int, str]]:
    """(start, end, normalised text) of a text's units, in code points; lines come before their sentences, and joined pieces last."""
    out: dict[tuple[int, int], str] = {}
    pieces: list[tuple[int, int, int, str]] = []
    for line in _LINE.finditer(text):
        own = _pieces(text, *line.span())
        if sum(p[2] for p in own) >= min_words:
            out[own[0][0], own[-1][1]] = " ".join([p[3] for p in own])
            for p in own:
                if p[2] >= min_words:
                    out[p[0], p[1]] = p[3]
        pieces += own
    for i, p in enumerate(pieces):
        if p[2] >= min_words:
            continue
        for step in (1, -1):
            n, j = p[2], i
            while n < min_words and 0 <= j + step < len(pieces):
                j += step
                n += pieces[j][2]
            if n >= min_words:
                low, high = min(i, j), max(i, j)
                place = pieces[low][0], pieces[high][1]
                if place not in out:
                    out[place] = " ".join([q[3] for q in pieces[low : high + 1]])
    return [(a, b, norm) for (a, b), norm in out.items()]


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, the blanks after them inside a line, and lines that they empty; line ends in a span stay."""
    merged: list[list[int]] = []
    for a, b in sorted((a + m.start(), a + m.end()) for a, b in set(spans) for m in _LINE.finditer(text[a:b])):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    pieces, at = [], 0
    for a, b in merged:
        while b < len(text) and text[b] in " \t\r":
            b += 1
        starts_line = a == 0 or text[a - 1] == "\n" or (a == at and (not pieces or pieces[-1].endswith("\n")))
        pieces.append(text[at:a])
        if starts_line and b < len(text) and text[b] == "\n":
            b += 1
        at = max(at, b)
        pieces = [p for p in pieces if p]
    return "".join([*pieces, text[at:]])


_UNIT = "high long, low long, doc_id long, mark long, span long, later boolean"


def _emit(min_words: int):
    """Units by digest; span holds start and end, later tells a unit that comes again in its own text, behind the first."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids, marks, digests, spans, later = [], [], [], [], []
                for doc_id, mark, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "mark", "text")), strict=True):
                    ends: dict[bytes, int] = {}
                    for a, b, norm in sorted(units(text or "", min_words)):
                        digest = xxhash.xxh3_128_digest(norm.encode("utf-8", "surrogatepass"))
                        ids.append(doc_id)
                        marks.append(mark)
                        digests.append(digest)
                        spans.append(a << 32 | b)
                        later.append(a >= ends.setdefault(digest, b))
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(spans, pa.int64()), pa.array(later, pa.bool_())],
                    ["high", "low", "doc_id", "mark", "span", "later"],
                )

    return run


def _apply(batches):
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            texts.append(cut(text, [(s["start"], s["end"]) for s in spans]) if text and spans else text)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), batch.column("spans")], ["row", "text", "spans"])


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, mark, spans): for each text with repeats, the spans that an earlier unit repeats, by rising offset.

    mark is the text's 64-bit digest, so rows that share a doc_id, or have
    none, keep their spans apart; rows that share doc_id and text are one
    document.  Null texts have no units; a null doc_id ranks last.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    rows = durable(docs.mapInArrow(lean(_emit(min_words)), _UNIT), "units")
    place = F.coalesce("doc_id", F.lit(2**63 - 1))
    key = ["high", "low"]
    # the least doc_id of every digest that comes again, then the least mark of its rows
    least = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(place).alias("at")).where("n > 1").drop("n")
    least = durable(least, "least")
    again = durable(rows.join(least, key), "again")
    for x in (rows, least):
        discard(x)
    # written, so that the join can split a digest that very many rows have
    first = durable(again.where(place == F.col("at")).groupBy(*key).agg(F.min("mark").alias("own")), "first")
    gone = again.join(first, key).where((place != F.col("at")) | (F.col("mark") != F.col("own")) | F.col("later"))
    span = F.struct(F.shiftright("span", 32).cast("int").alias("start"), F.col("span").bitwiseAND(2**32 - 1).cast("int").alias("end"))
    done = durable(gone.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(span)).alias("spans")), "spans")
    for x in (again, first):
        discard(x)
    return done


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated units cut from text, plus the column removed_spans (array of start, end in the original text).

    A null or empty text stays as it is.  removed_spans is empty where nothing
    was cut; an input column of that name is replaced.  Other columns, whatever
    their names, go along.  An empty table gives an empty result.
    """
    spans = repeated_spans(docs, min_words)
    docs = docs.drop("removed_spans")
    kind = "array<struct<start:int,end:int>>"
    # columns of docs travel in a struct, where no name can clash
    left = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), docs["text"].alias("text"), docs["doc_id"].cast("long").alias("id"))
    joined = left.join(spans, left["id"].eqNullSafe(spans["doc_id"]) & (F.xxhash64(left["text"]) == spans["mark"]), "left")
    packed = joined.select("row", "text", F.coalesce("spans", F.array().cast(kind)).alias("spans"))
    row = packed.schema["row"].dataType.simpleString()
    done = packed.mapInArrow(lean(_apply), f"row {row}, text string, spans {kind}")
    return done.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], F.col("spans").alias("removed_spans"))
