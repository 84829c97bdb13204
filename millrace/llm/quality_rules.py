"""Quality rules: plain counts, then a hashed n-gram log-likelihood ratio.

Two multinomials over 2**bits hash buckets of one- and two-token grams are
counted over whole tables: one over the trusted documents, one over the raw
corpus.  A document's score is the mean over its grams of log(trusted/raw);
it is kept when the score reaches a fixed threshold, the same for every
document and at every size.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 13
#: Least mean log-ratio of a kept document, in nats per gram.
THRESHOLD = -0.3
#: Letters and digits of any script, or a run of other signs; the upper range stands for all non-ASCII code points.
TOKEN = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]+|[^a-zA-Z0-9\x{80}-\x{10FFFF}\s]+"
BLANK = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """The whole text's words; a null text has none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK))


def count_symbols(text: Column) -> Column:
    bare = text
    for c in _SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return F.length(text) - F.length(bare)


def repeated_words(tri: Column) -> Column:
    """Words in the windows whose hashes (in order, one a window) occur twice or more."""
    ranked = F.sort_array(F.transform(tri, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def mark(s: Column) -> Column:
        again = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
        places = F.sort_array(F.array_compact(again))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))
        step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["at"])).alias("n"), x.alias("at"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    return F.get(F.transform(F.array(ranked), mark), F.lit(0))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); windows compare by 64-bit hashes."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(_BLANKS)) != "")
    first = docs.withColumns({"_w": words(F.col("text")), "_lines": lines})
    hashed = first.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": count_symbols(text).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": F.transform("_w", lambda x: F.xxhash64(x)),
        }
    ).drop("_w", "_lines")
    grams = F.transform(F.sequence(F.lit(0), F.size("_h") - 3), lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)))
    tri = hashed.withColumn("_tri", F.when(F.size("_h") >= 3, grams).otherwise(F.array().cast("array<bigint>"))).drop("_h")
    repeats = F.when(F.size(F.array_distinct("_tri")) == F.size("_tri"), F.lit(0)).otherwise(repeated_words(F.col("_tri")))
    return tri.withColumn("n_repeat_words", repeats.cast("long")).drop("_tri")


def grams(text: Column, bits: int = BITS) -> Column:
    """Buckets of a whole text's one- and two-token grams; a null text has none."""
    hashes = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x))
    mask = F.lit((1 << bits) - 1)

    def both(h: Column) -> Column:
        one = F.transform(h, lambda x: x.bitwiseAND(mask).cast("int"))
        two = F.transform(
            h, lambda x, i: F.when(i > 0, F.xxhash64(x, F.get(h, i - 1)).bitwiseAND(mask).cast("int"))
        )
        return F.concat(one, F.filter(two, lambda x: x.isNotNull()))

    return F.get(F.transform(F.array(hashes), both), F.lit(0))


def log_ratios(docs: DataFrame, trusted: DataFrame, bits: int = BITS) -> list[float]:
    """log(trusted/raw) of every bucket, counted over all of docs; trusted has a doc_id column.

    One count is added to every bucket.  The list has 2**bits entries at every
    corpus size.
    """
    ids = trusted.select(F.col("doc_id").alias("_trusted")).where("_trusted is not null").distinct()
    # one plan at every size: the texts move once, however few ids there are
    marked = docs.select("doc_id", "text").join(ids.hint("merge"), docs["doc_id"] == ids["_trusted"], "left")
    each = marked.select(F.col("_trusted").isNotNull().alias("good"), F.explode(grams(F.col("text"), bits)).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("good").alias("good")).collect()
    raw, good = [1.0] * (1 << bits), [1.0] * (1 << bits)
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        good[r["bucket"]] += r["good"]
    shift = math.log(sum(raw) / sum(good))
    return [math.log(g / r) + shift for g, r in zip(good, raw, strict=True)]


def ratio_score(text: Column, ratios: list[float]) -> Column:
    """Mean log-ratio of a text's grams; 0 for a text without any."""
    bits = (len(ratios) - 1).bit_length()
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in ratios)), ",").cast("array<double>")
    found = grams(text, bits)

    def mean(g: Column) -> Column:
        total = F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(table, x))
        return F.when(F.size(g) > 0, total / F.size(g)).otherwise(0.0)

    return F.get(F.transform(F.array(found), mean), F.lit(0))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """docs' columns with the base counts, base_failed, llr and kept.

    docs needs doc_id and text; a null text has no words, so it fails the base
    rules, as does an empty one.  Rows with equal texts get equal verdicts; an
    empty table gives an empty result.  Input columns named like a result are
    replaced.  Without a trusted document every ratio is near 0 and the base
    rules decide.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    kept = [c for c in docs.columns if c not in made]
    # columns of docs travel in a struct, where no name can clash
    packed = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"), docs["text"].alias("text"))
    ratios = log_ratios(docs.select("doc_id", "text"), trusted)
    out = base_counts(packed.withColumn("llr", ratio_score(F.col("text"), ratios)))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *made)
