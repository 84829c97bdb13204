"""N-gram Jaccard join by token-combination prefixes.

A text's tokens are its distinct word shingles.  Tokens have one global order:
rare ones first, by the sum of the logarithms of their words' counts, then the
frequent ones.  Frequent are the tokens whose cell in a sketch of all shingles
stands above what chance fills; both sketches count whole texts of all
documents.  For a threshold t, two sets that link and share a rare token share
one in both plain prefixes (the first ``s - need + 1`` tokens), so rare tokens
of the prefix are keys by themselves.  If they share frequent tokens only, the
prefix is extended until two shared tokens must be neighbours in both orders:
there each two neighbouring frequent tokens together are a key.  A pair that
reaches t therefore always shares a key; the classes only steer cost, and any
assignment of them gives the same links.

Candidates are then verified on the whole sets.  No stage emits all pairs of a
key's texts: equal sets are one node; each node is first compared with the
first node of its key, and only keys whose nodes still lie in several
components go on, those with the same nodes once.  There each node is compared
with the likeliest node of another component, and what is apart after that is
compared exhaustively: a key's nodes in blocks, every two blocks in one task,
and only links that join components come out.
Before whole sets travel, short forms of them do: first a signature, a set's
tokens counted by hash in SIGNATURE cells, then a print, the last 16 bits of each
token.  The sum of the lesser counts of two short forms bounds the intersection
from above, so what it rules out can't be a link.
"""

from __future__ import annotations

import math
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import components, discard, durable
from millrace.llm.textbytes import distinct_sets, flat, lean, lower_ascii, mix64, shingle_hashes, slices, word_hashes

#: Cells of the frequency sketch: its size is fixed, whatever the corpus.
SKETCH_BITS = 18
#: Nodes of a key that one task compares at once.
BLOCK = 1024
#: Least threshold at which two sets that share frequent tokens only must share two neighbours.
_PAIRS_FROM = Fraction(3, 4)
#: Cells of a signature, a byte each.
SIGNATURE = 256
#: Sketches summed by one task of the reduction tree.
FAN_IN = 64
#: Above all sums of logarithms.
_OFTEN = np.int64(1 << 40)


def cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(texts)
    return word_hashes(lower_ascii(data), offsets)


def text_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes of each text, and where each text's begin."""
    return distinct_sets(*shingle_hashes(*text_words(texts), n))


def rarity(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(binary logarithm of each word cell's count in whole 1/256ths, levels of the shingle cells that stand above what chance fills: 0 for the others)."""
    by_word, by_shingle = sketch
    mean = int(by_shingle.sum()) // len(by_shingle)
    floor = mean + 4 * math.isqrt(mean) + 8
    return np.rint(256 * np.log2(by_word + 1.0)).astype(np.int32), np.ceil(np.log2(by_shingle // floor + 1.0)).astype(np.int32)


def ranked_sets(texts: pa.Array, n: int, by_word: np.ndarray, by_shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text_sets() and each token's place in the order: first tokens by the sum of their words' logarithms, then those that are often met, by level.

    All of it is whole numbers, so equal shingles get the same place in every text.
    """
    words, first = text_words(texts)
    values, at = shingle_hashes(words, first, n)
    total = np.concatenate([[0], np.cumsum(by_word[cell(words)], dtype=np.int64)])
    counts = np.diff(at)
    have = np.repeat(np.minimum(np.diff(first), n), counts)
    start = np.repeat(first[:-1] - at[:-1], counts) + np.arange(len(values))
    often = by_shingle[cell(values)]
    chance = np.where(often > 0, _OFTEN + often, total[start + have] - total[start])
    owner = np.repeat(np.arange(len(at) - 1), counts)
    order = np.lexsort((values, owner))
    v, o, c = values[order], owner[order], chance[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[new], np.searchsorted(o[new], np.arange(len(at))), c[new]


def set_ids(values: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """A 16-byte digest of each set that depends on its members only; None for an empty set."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    with np.errstate(over="ignore"):
        total, mixed = np.zeros(len(at) - 1, np.uint64), np.zeros(len(at) - 1, np.uint64)
        np.add.at(total, owner, mix64(values + np.uint64(0x1234567)))
        np.bitwise_xor.at(mixed, owner, mix64(values * np.uint64(0xD6E8FEB86659FD93)))
        both = np.stack([total, mix64(mixed + np.diff(at).astype(np.uint64))], 1)
    return [row.tobytes() if at[i + 1] > at[i] else None for i, row in enumerate(both)]


def need(size: int, t: Fraction) -> int:
    """The least intersection with which a set of this size can reach t."""
    return -(-size * t.numerator // t.denominator)


def prefix_keys(tokens: np.ndarray, place: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of one set, and whether each is of a pair; place orders the tokens, the frequent ones from _OFTEN on.

    Two sets that link and share a rare token share it in both plain prefixes,
    the first s - need + 1 tokens.  If all that they share is frequent, their
    rare tokens (r) are their own, and at most s * (1 - t) / t - r frequent
    tokens of both sets together are not shared.  Each of those parts two
    shared neighbours at most, so two shared tokens are next to each other in
    both orders no later than the prefix is extended here.
    """
    s = len(tokens)
    least = need(s, t)
    if s < 2:  # t lies above 1/2, so it links to equal sets only
        return tokens[:0], np.zeros(0, bool)
    order = np.lexsort((tokens, place))
    rare = int((place < _OFTEN).sum()) if t >= _PAIRS_FROM else s
    single = tokens[order[: min(s - least + 1, rare)]]
    own, both = s - least - rare, s * (t.denominator - t.numerator) // t.numerator - rare
    if own < 0:
        return single, np.zeros(len(single), bool)
    often = tokens[order[rare : rare + own + both + 2]]
    with np.errstate(over="ignore"):
        pairs = mix64(often[:-1] * np.uint64(0x9FB21C651E98DF25) + mix64(often[1:]))
    return np.concatenate([single, pairs]), np.arange(len(single) + len(pairs)) >= len(single)


def _pack(sketch: np.ndarray) -> bytes:
    return zlib.compress(sketch.tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), np.int64).reshape(2, -1)


def _scan(n: int):
    def run(batches):
        sketch = np.zeros((2, 1 << SKETCH_BITS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words, first = text_words(part.column("text"))
                values, at = distinct_sets(*shingle_hashes(words, first, n))
                sketch[0] += np.bincount(cell(words), minlength=1 << SKETCH_BITS)
                sketch[1] += np.bincount(cell(values), minlength=1 << SKETCH_BITS)
                rows = len(at) - 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("mark"), pa.array(np.diff(at)), pa.array(set_ids(values, at), pa.binary()), pa.nulls(rows, pa.binary())],
                    ["doc_id", "mark", "n_shingles", "set_id", "sketch"],
                )
        if sketch.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([_pack(sketch)])],
                ["doc_id", "mark", "n_shingles", "set_id", "sketch"],
            )

    return run


def _sum_sketches(batches):
    total = np.zeros((2, 1 << SKETCH_BITS), np.int64)
    for batch in batches:
        for blob in batch.column("sketch"):
            total += _unpack(blob.as_py())
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array([_pack(total)])], ["sketch"])


def _frequency_sketch(blobs: DataFrame) -> np.ndarray:
    """Sums the tasks' sketches in a tree; the result has 2 * 2**SKETCH_BITS cells at every corpus size."""
    parts, passed = blobs.count(), []
    while parts > 1:
        parts = -(-parts // FAN_IN)
        blobs = durable(blobs.repartition(parts).mapInArrow(lean(_sum_sketches), "sketch binary"), "sketch")
        passed.append(blobs)
    rows = blobs.collect()
    for x in passed:
        discard(x)
    return _unpack(rows[0][0]) if rows else np.zeros((2, 1 << SKETCH_BITS), np.int64)


def _index(n: int, t: Fraction, sketch):
    def run(batches):
        by_word, by_shingle = sketch.value
        for batch in batches:
            for part in slices(batch, "text"):
                values, at, place = ranked_sets(part.column("text"), n, by_word, by_shingle)
                ids = set_ids(values, at)
                own = [prefix_keys(values[at[i] : at[i + 1]], place[at[i] : at[i + 1]], t) for i in range(len(at) - 1)]
                owner = np.repeat(np.arange(len(own)), [len(x) for x, _ in own])
                keys = np.concatenate([np.zeros(0, np.uint64), *[x for x, _ in own]]).view(np.int64)
                # the last bit tells keys of pairs from those of single tokens
                keys = (keys & ~np.int64(1)) | np.concatenate([np.zeros(0, bool), *[x for _, x in own]])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids, pa.binary()).take(pa.array(owner))], ["key", "set_id"])

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                values, at = text_sets(part.column("text"), n)
                raw = [values[at[i] : at[i + 1]].tobytes() for i in range(len(at) - 1)]
                signs = [signature(values[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
                prints = [np.sort(values[at[i] : at[i + 1]].astype(np.uint16)).tobytes() for i in range(len(at) - 1)]
                yield pa.RecordBatch.from_arrays([part.column("set_id"), *[pa.array(x, pa.binary()) for x in (raw, signs, prints)]], ["set_id", "tokens", "sign", "print"])

    return run


def reaches(both, size_a, size_b, t: Fraction):
    """Whether an intersection makes the Jaccard similarity t or more, in whole numbers."""
    return both * t.denominator >= t.numerator * (size_a + size_b - both)


def signature(tokens: np.ndarray) -> bytes:
    """Counts of a set's tokens by cell; empty, which bounds nothing, where a count needs more than a byte."""
    counts = np.bincount((tokens & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 1 << 8 else b""


def _signatures(column) -> tuple[np.ndarray, np.ndarray]:
    """(counts by row, rows that have a bound)."""
    raw = column.to_pylist()
    known = np.array([len(x) > 0 for x in raw], bool)
    return np.stack([np.frombuffer(x or bytes(SIGNATURE), np.uint8) for x in raw]) if raw else np.zeros((0, SIGNATURE), np.uint8), known


def _possible(t: Fraction):
    """Keeps pairs that their signatures don't rule out."""

    def run(batches):
        for batch in batches:
            x, x_known = _signatures(batch.column("x_sign"))
            y, y_known = _signatures(batch.column("y_sign"))
            keep = reaches(np.minimum(x, y).sum(1, dtype=np.int64), x.sum(1, dtype=np.int64), y.sum(1, dtype=np.int64), t) | ~x_known | ~y_known
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def likely_partners(signs: np.ndarray, known: np.ndarray, labels: np.ndarray, t: Fraction) -> np.ndarray:
    """For each row of a block the row of another label that their signatures make likeliest, or -1 where they rule all out."""
    size = signs.sum(1, dtype=np.int64)
    out = np.full(len(size), -1)
    for i in range(len(size)):
        other = np.flatnonzero(labels != labels[i])
        both = np.minimum(signs[i], signs[other]).sum(1, dtype=np.int64)
        open_to = reaches(both, size[i], size[other], t) | ~known[other] | ~known[i]
        if open_to.any():
            likeness = np.where(open_to, both / np.maximum(size[i] + size[other] - both, 1), -1.0)
            out[i] = other[likeness.argmax()]
    return out


def _codes(column) -> np.ndarray:
    return np.unique(np.array(column.to_pylist(), object), return_inverse=True)[1]


_GUESS = "key long, set_id binary, label binary, partner binary"


def _guess(t: Fraction):
    """For each row of a block its likeliest link to another component; rows that signatures rule out go, where the block is all of its key."""

    def run(group):
        signs, known = _signatures(group.column("sign"))
        partner = likely_partners(signs, known, _codes(group.column("label")), t)
        ids = group.column("set_id").combine_chunks()
        near = ids.take(pa.array(np.maximum(partner, 0), mask=partner < 0))
        whole = group.column("n")[0].as_py() <= BLOCK
        return group.select(["key", "set_id", "label"]).append_column("partner", near).filter(pa.array((partner >= 0) | (not whole)))

    return run


def _verify(t: Fraction):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x_tokens"), batch.column("y_tokens"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                small, large = sorted((len(x), len(y)))
                close = small * t.denominator >= large * t.numerator
                keep.append(bool(close and reaches(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), t)))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def overlaps(sets: list[np.ndarray], t: Fraction):
    """(rows, row, sizes of the intersections) for all rows of near enough sizes, a row of sets at a time."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    for start in range(0, len(order), 128):
        rows = order[start : start + 128]
        top = sizes[rows[-1]] * t.denominator / t.numerator
        others = order[start:][sizes[order[start:]] <= top]
        vocabulary = np.unique(np.concatenate([sets[i] for i in rows]))
        left = np.zeros((len(rows), len(vocabulary)), np.float32)
        for k, i in enumerate(rows):
            left[k, np.searchsorted(vocabulary, sets[i])] = 1
        for j in others:
            at = np.minimum(np.searchsorted(vocabulary, sets[j]), len(vocabulary) - 1)
            at = at[vocabulary[at] == sets[j]]
            yield rows, j, left[:, at].sum(1).astype(np.int64)


def block_links(ids: list[bytes], labels: list[bytes], sets: list[np.ndarray], side: np.ndarray, t: Fraction) -> list[tuple[bytes, bytes]]:
    """Links between nodes of different labels, one for each two labels that they join; where side has both 0 and 1, from one to the other only."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    sizes, two = np.array([len(s) for s in sets]), len(set(side.tolist())) > 1
    out: list[tuple[bytes, bytes]] = []
    for rows, j, both in overlaps(sets, t):
        for k in np.flatnonzero(reaches(both, sizes[rows], sizes[j], t)):
            i = rows[k]
            if i != j and not (two and side[i] == side[j]):
                a, b = root(labels[i]), root(labels[j])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((ids[i], ids[j]))
    return out


def counted(short: np.ndarray) -> np.ndarray:
    """Sorted 16-bit values with their place among equals, so that common members are the sum of lesser counts."""
    place = np.arange(len(short)) - np.searchsorted(short, short)
    return np.sort((place.astype(np.uint64) << np.uint64(16)) | short)


def open_by_print(prints: list[np.ndarray], labels: np.ndarray, side: np.ndarray, t: Fraction) -> np.ndarray:
    """Rows of a block that may link to a row of another label, by their prints."""
    sizes, keep, two = np.array([len(x) for x in prints]), np.zeros(len(prints), bool), len(set(side.tolist())) > 1
    for rows, j, both in overlaps([counted(x) for x in prints], t):
        hit = reaches(both, sizes[rows], sizes[j], t) & (labels[rows] != labels[j])
        if two:
            hit &= side[rows] != side[j]
        keep[rows[hit]] = True
        keep[j] |= hit.any()
    return keep


def _narrow(t: Fraction):
    """Drops rows that no row of another label can link to: first by signatures, then by prints."""

    def run(group):
        codes, side = _codes(group.column("label")), group.column("side").to_numpy()
        prints = [np.frombuffer(x, np.uint16) for x in group.column("print").to_pylist()]
        return group.select(["tile", "set_id", "label", "side"]).filter(pa.array(open_by_print(prints, codes, side, t), pa.bool_()))

    return run


def _resolve(t: Fraction):
    def run(group):
        sets = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
        links = block_links(group.column("set_id").to_pylist(), group.column("label").to_pylist(), sets, group.column("side").to_numpy(), t)
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    return run


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(set_id, label) after more links: only the labels that they join are worked on."""
    of = lambda c: labels.select(F.col("set_id").alias(c), F.col("label").alias(f"{c}_label"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = components(named.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))).toDF("label", "new")
    # a node without a label so far is its own label
    alone = joined.join(labels.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("set_id"), F.col("new").alias("label"))
    old = labels.join(joined, "label", "left").select("set_id", F.coalesce("new", "label").alias("label"))
    return durable(old.unionByName(alone), "labels")


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, set_id, label, n) of the keys whose nodes lie in several components; n counts a key's nodes.  Keys with the same nodes count once."""
    named = durable(members.select("key", "set_id").join(labels, "set_id", "left").select("key", "set_id", F.coalesce("label", "set_id").alias("label")), "named")
    keys = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.sum(F.hash("set_id").cast("long")).alias("y"))
    once = keys.where("low <> high").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    out = durable(named.join(once, "key"), "apart")
    discard(named)
    return out


def _tiles(apart: DataFrame) -> DataFrame:
    """(tile, set_id, label, side): a key's nodes in blocks of about BLOCK, every two blocks of a key in one tile, each block also by itself."""
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64(F.lit(3), "set_id"), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    each = apart.select("key", "set_id", "label", own.alias("own"), F.explode(pairs).alias("p"))
    return each.select(F.struct("key", "p.i", "p.j").alias("tile"), "set_id", "label", (F.col("own") != F.col("p.i")).cast("int").alias("side"))


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, stats: dict | None = None) -> DataFrame:
    """Connected components of the texts whose shingle sets have a Jaccard similarity of num/den or more.

    docs needs doc_id (long) and text; other columns are ignored.  Returns one
    row per input row: doc_id, n_shingles (set size), component_id (least
    doc_id of the component).  A null or empty text, or one without words, has
    an empty set and is alone: its component_id is its doc_id.  Rows with equal
    texts, or the same doc_id twice, each get their row.  A null doc_id is
    allowed; it is a component_id only where a component has no other.  An
    empty table gives an empty result.  num/den must lie above 1/2.  stats, if
    given, gets the numbers of keys of single tokens and of pairs that several
    sets have, and of those that the exhaustive comparison got.
    """
    t = Fraction(num, den)
    if not Fraction(1, 2) < t <= 1:
        raise ValueError("the threshold must lie above 1/2 and not above 1")
    spark = docs.sparkSession
    # mark is the text's own digest: it leads from a set back to its text, whatever the doc_ids
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("mark"), "text")
    scan = durable(docs.mapInArrow(lean(_scan(words)), "doc_id long, mark binary, n_shingles long, set_id binary, sketch binary"), "scan")
    rows = scan.where("sketch is null").select("doc_id", "mark", "n_shingles", "set_id")
    sketch = spark.sparkContext.broadcast(rarity(_frequency_sketch(scan.where("sketch is not null").select("sketch"))))

    index = durable(docs.mapInArrow(lean(_index(words, t, sketch)), "key long, set_id binary"), "index")
    mark = F.xxhash64("set_id")
    shared = index.groupBy("key").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a < b").select("key")
    members = durable(index.join(shared, "key").distinct(), "members")
    discard(index)

    wanted = members.select("set_id").distinct().join(rows.where("set_id is not null").groupBy("set_id").agg(F.min("mark").alias("mark")), "set_id")
    texts = docs.join(wanted, "mark").dropDuplicates(["set_id"])
    sets = durable(texts.select("set_id", "text").mapInArrow(lean(_sets(words)), "set_id binary, tokens binary, sign binary, print binary"), "sets")
    tokens, signs = sets.select("set_id", "tokens"), sets.select("set_id", "sign")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs (x, y): signatures are compared first, whole sets after that."""
        first = pairs.join(signs.toDF("x", "x_sign"), "x").join(signs.toDF("y", "y_sign"), "y").mapInArrow(lean(_possible(t)), "x binary, y binary")
        both = durable(first, "possible")
        out = durable(both.join(tokens.toDF("x", "x_tokens"), "x").join(tokens.toDF("y", "y_tokens"), "y").mapInArrow(lean(_verify(t)), "a binary, b binary"), "near")
        discard(both)
        return out

    # each node with the first node of its keys
    reps = members.groupBy("key").agg(F.min("set_id").alias("y"))
    star = verified(members.join(reps, "key").where("set_id <> y").select(F.col("set_id").alias("x"), "y").distinct())
    labels = durable(components(star).toDF("set_id", "label"), "labels")
    discard(star)
    # in the keys that are still apart, each node with its likeliest link to another component
    apart = _apart(members, labels)
    dealt = apart.withColumn("block", F.pmod(F.xxhash64("set_id"), F.ceil(F.col("n") / BLOCK))).join(signs, "set_id")
    narrow = durable(dealt.select("key", "block", "n", "set_id", "label", "sign").groupBy("key", "block").applyInArrow(_guess(t), _GUESS), "narrow")
    found = verified(narrow.where("partner is not null").select(F.least("set_id", "partner").alias("x"), F.greatest("set_id", "partner").alias("y")).distinct())
    grown = _relabelled(labels, found)
    if stats is not None:
        kind = lambda df, bit: df.where(F.col("key").bitwiseAND(1) == bit).select("key").distinct().count()
        stats |= {"single": kind(members, 0), "pair": kind(members, 1)}
    for x in (apart, labels, found, members):
        discard(x)
    # what is apart now is compared exhaustively
    labels, again = grown, _apart(narrow, grown)
    discard(narrow)
    if stats is not None:
        stats |= {"single apart": kind(again, 0), "pair apart": kind(again, 1)}
    tiles = durable(_tiles(again), "tiles")
    open_rows = tiles.join(sets.select("set_id", "print"), "set_id").groupBy("tile").applyInArrow(_narrow(t), tiles.schema)
    last = durable(open_rows, "last")
    found = durable(last.join(tokens, "set_id").groupBy("tile").applyInArrow(_resolve(t), "a binary, b binary"), "near")
    final = _relabelled(labels, found)
    firsts = rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    named = firsts.join(final, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = named.join(least, "label").select("set_id", "component_id")
    out = rows.join(named, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    done = durable(out, "components")
    for x in (sets, labels, again, tiles, last, found, final, scan):
        discard(x)
    return done


def keep_one_each(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs without those whose component has a smaller doc_id; columns as they are, whatever their names.

    Rows that repeat one doc_id stay together.  Rows without a doc_id, and
    texts without words, stay.  An empty table gives an empty result.
    """
    found = jaccard_components(docs, words, num, den).where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == found["gone"], "left_anti")
