"""Document fingerprints by an invertible Bloom lookup sketch of paragraph digests.

A text's paragraphs are its lines, long lines being cut further at sentence
ends that a content rule picks (most of them), so that a text of one line has paragraphs too.  Each paragraph's 64-bit digest (48 bits of hash, 16 bits
that check them) goes to one cell in each of three sub-tables of 16 cells; a
cell holds the exclusive or of its digests.  The sketch of one version minus
that of another holds only the paragraphs that differ, and peeling recovers
them: a cell whose content passes its own check holds one digest, and taking
that out of its other cells uncovers more.  When peeling stops early, it is
tried again with a larger sketch: the digests are dealt to groups with a sketch
each, twice as many groups at every try.

DataFrame functions only; every text is handled inside its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.ordering import by_ranges, order_key

SLOT_BITS = 4
SLOTS = 1 << SLOT_BITS
CELLS = 3 * SLOTS
#: Differing paragraphs that a group of a larger sketch is meant for.
PER_GROUP = 20
#: Larger sketches tried; at the last one a group has a millionth of a digest.
TRIES = 24
_SWEEPS = 16
_HIGH = -65536
_KEYS = "array<bigint>"
#: Ends of paragraphs: line ends, and sentence ends before a word with one of most first letters.
PARAGRAPH_END = r"\n+|(?<=[.!?;|])\s+(?=[A-PÀ-Ïa-p])"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def check_bits(key: Column) -> Column:
    return F.xxhash64(key.bitwiseAND(_HIGH)).bitwiseAND(65535)


def digests(text: Column) -> Column:
    """Distinct paragraph digests of a text; a null or blank text has none."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END), lambda p: F.trim(p)), lambda p: p != "")
    high = F.transform(parts, lambda p: F.xxhash64(p).bitwiseAND(_HIGH))
    return F.array_distinct(F.transform(high, lambda k: k.bitwiseOR(check_bits(k))))


def _slots(p: Column) -> list[Column]:
    """The three cells of a digest with place bits p, rising."""
    return [(p.bitwiseAND(15)).cast("int"), (F.shiftright(p, 4).bitwiseAND(15) + SLOTS).cast("int"), (F.shiftright(p, 8).bitwiseAND(15) + 2 * SLOTS).cast("int")]


def _put(cells: Column, key: Column, p: Column) -> Column:
    """cells with a digest put into, or taken out of, its three cells, one in each sub-table."""
    return let(F.array(*_slots(p)), lambda s: F.transform(cells, lambda x, c: F.when(F.get(s, F.shiftright(c, SLOT_BITS)) == c, x.bitwiseXOR(key)).otherwise(x)))


def _empty() -> Column:
    return F.array_repeat(F.lit(0).cast("bigint"), CELLS)


def _place(key: Column, level: Column) -> Column:
    return F.xxhash64(key, level)


def placed(keys: Column, level: Column) -> Column:
    """Digests with their place bits at a level of retrying."""
    return F.transform(keys, lambda k: F.struct(k.alias("k"), _place(k, level).alias("p")))


def sketch(keys: Column, start: Column | None = None) -> Column:
    """Cells after placed digests went in; a digest that start holds already comes out."""
    return F.aggregate(keys, _empty() if start is None else start, lambda cells, q: _put(cells, q["k"], q["p"]))


def minus(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda u, v: u.bitwiseXOR(v))


def peel(cells: Column, level: Column) -> Column:
    """struct(found, left): the digests that cells hold, and whether some cell is not empty after that."""
    state = lambda z, found, go: F.struct(z.alias("z"), found.alias("found"), go.alias("go"))
    lone = lambda x: (x != 0) & (check_bits(x) == x.bitwiseAND(65535))

    def step(s: Column, c: Column) -> Column:
        def look(x: Column) -> Column:
            def take(p: Column) -> Column:
                i, j, k = _slots(p)
                return F.when((c == i) | (c == j) | (c == k), state(_put(s["z"], x, p), F.concat(s["found"], F.array(x)), F.lit(True))).otherwise(s)

            return F.when(lone(x), let(_place(x, level), take)).otherwise(s)

        return let(F.get(s["z"], c), look)

    lone_cells = lambda z: F.filter(F.transform(z, lambda x, c: F.when(lone(x), c)), lambda c: c.isNotNull())
    sweep = lambda s: F.aggregate(lone_cells(s["z"]), state(s["z"], s["found"], F.lit(False)), step)
    none = F.array().cast(_KEYS)
    full = F.aggregate(F.sequence(F.lit(1), F.lit(_SWEEPS)), state(cells, none, F.lit(True)), lambda s, _: F.when(s["go"], sweep(s)).otherwise(s))
    return let(full, lambda s: F.struct(s["found"].alias("found"), F.exists(s["z"], lambda x: x != 0).alias("left")))


def larger(left: Column, right: Column, tries: int = TRIES) -> Column:
    """struct(found, left) from sketches dealt into groups by digest, more of them at every try.

    Digests are sorted by group once a try, so a try takes time in proportion to them.
    """

    def attempt(level: Column) -> Column:
        def by_group(groups: Column) -> Column:
            both = F.concat(placed(left, level), placed(right, level))
            return F.sort_array(F.transform(both, lambda q: F.struct(F.pmod(F.shiftright(q["p"], 12), groups).alias("g"), q["k"].alias("k"), q["p"].alias("p"))))

        def peeled(all_: Column) -> Column:
            begins = F.transform(all_, lambda q, i: F.when((i == 0) | (F.get(all_, i - 1)["g"] != q["g"]), i))

            def with_starts(starts: Column) -> Column:
                one = lambda at, j: peel(sketch(F.slice(all_, at + 1, F.coalesce(F.get(starts, j + 1), F.size(all_)) - at)), level)
                return let(F.transform(starts, one), lambda ps: F.struct(F.flatten(F.transform(ps, lambda x: x["found"])).alias("found"), F.exists(ps, lambda x: x["left"]).alias("left")))

            return let(F.array_compact(begins), with_starts)

        need = F.ceil((F.size(left) + F.size(right)) / F.lit(PER_GROUP)).cast("bigint")
        groups = F.greatest(F.lit(1).cast("bigint"), F.call_function("shiftleft", need, level - 1))
        return let(let(groups, by_group), peeled)

    start = F.struct(F.array().cast(_KEYS).alias("found"), F.lit(True).alias("left"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(tries)), start, lambda s, r: F.when(s["left"], attempt(r)).otherwise(s))


def difference(left: Column, right: Column, left_cells: Column, right_cells: Column) -> Column:
    """struct(a, b): digests that only the left and only the right text has, from sketches alone; left tells whose a digest is."""
    first = peel(minus(left_cells, right_cells), F.lit(0))
    found = let(first, lambda s: F.when(s["left"], larger(left, right)["found"]).otherwise(s["found"]))
    return let(found, lambda f: F.struct(F.array_intersect(f, left).alias("a"), F.array_except(f, left).alias("b")))


def likeness(left: Column, right: Column, diff: Column) -> Column:
    """Jaccard similarity of two digest sets from their difference; 1 for two empty ones."""
    return let(
        F.struct(F.size(left).alias("l"), F.size(right).alias("r"), F.size(diff["a"]).alias("a"), F.size(diff["b"]).alias("b")),
        lambda s: F.when(s["l"] + s["b"] == 0, F.lit(1.0)).otherwise((s["l"] - s["a"]) / (s["l"] + s["b"])),
    )


def as_text(keys: Column, cells: Column) -> Column:
    """A fingerprint: the number of digests and the cells, in hexadecimal."""
    return F.concat(F.hex(F.size(keys).cast("bigint")), F.lit("-"), F.array_join(F.transform(cells, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def successors(docs: DataFrame) -> DataFrame:
    """doc_id, text and digests, cells of every document, with next (text, digests, cells) of the document after it.

    Order is by doc_id, null first, then by hash of the text; the last
    document is followed by the first.  The text moves once, to its range of ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_key", order_key(F.col("doc_id")))
    dealt = by_ranges(rows, "_key", "_bucket", "_guest").withColumn("_late", (F.col("_guest") == 2).cast("int")).withColumn("_tie", F.xxhash64("text"))
    dealt = dealt.repartition("_bucket").sortWithinPartitions("_bucket", "_late", "_key", "_tie")
    dealt = dealt.withColumn("keys", digests(F.col("text"))).withColumn("cells", sketch(placed(F.col("keys"), F.lit(0))))
    order = W.partitionBy("_bucket").orderBy("_late", "_key", "_tie")
    return dealt.withColumn("next", F.lead(F.struct("text", "keys", "cells")).over(order)).where("_guest = 0").select("doc_id", "text", "keys", "cells", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and the likeness to both the edited text and the next document.

    docs needs doc_id and text (null: empty); other columns are ignored.  The
    edited text has its last quarter (rounded down, in code points) replaced by
    as many code points, or all, from the front of the next document.  Returns
    doc_id, n_chars, edited, fingerprint, edited_fingerprint, changed (digests
    only in the edited text), lost (digests only in the document), near_edited,
    near_next.  A lone document follows itself; an empty table gives an empty
    result.  Time and memory grow in proportion to a text's paragraphs; rows
    that repeat, and equal texts, have equal fingerprints.
    """
    rows = successors(docs).withColumn("n_chars", F.length("text").cast("long"))
    part = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - part), F.substring(F.col("next.text"), F.lit(1), part))
    rows = rows.withColumn("edited", edited).drop("text")
    rows = rows.withColumn("edited_keys", digests(F.col("edited")))
    rows = rows.withColumn("edited_cells", sketch(placed(F.col("edited_keys"), F.lit(0))))
    rows = rows.withColumn("to_edited", difference(F.col("keys"), F.col("edited_keys"), F.col("cells"), F.col("edited_cells")))
    rows = rows.withColumn("to_next", difference(F.col("keys"), F.col("next.keys"), F.col("cells"), F.col("next.cells")))
    return rows.select(
        "doc_id", "n_chars", "edited", as_text(F.col("keys"), F.col("cells")).alias("fingerprint"), as_text(F.col("edited_keys"), F.col("edited_cells")).alias("edited_fingerprint"),
        F.col("to_edited.b").alias("changed"), F.col("to_edited.a").alias("lost"),
        likeness(F.col("keys"), F.col("edited_keys"), F.col("to_edited")).alias("near_edited"), likeness(F.col("keys"), F.col("next.keys"), F.col("to_next")).alias("near_next"),
    )
