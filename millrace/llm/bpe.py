"""BPE encoding and decoding with content-defined chunk reuse.

A text's bytes are cut where a rolling hash of the last WINDOW bytes meets a
mask, so equal passages give equal chunks wherever they stand.  Chunks that
several documents share are counted over the whole table; the SHARED ones that
save most are encoded once, and every task gets their tokens.  Other chunks are
encoded where they stand, once a task while its tables have room.

A cut may fall inside a word, so the pieces around a cut up to the next blanks
are never taken from chunks.  The join is repaired: the piece is encoded again
together with the words before and behind it, and their tokens must agree
exactly with those that the chunks have.  Where they don't, as with a tokenizer
that joins characters across blanks, the whole text is encoded anew.

The tables of a task (chunks, and runs of letters or signs or whole words) are bounded and end with it; a full
table starts anew, which costs time and never changes a result.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import discard, durable
from millrace.llm.textbytes import flat, lean, slices

#: Mean bytes between two cuts is 2**CUT_BITS.
CUT_BITS = 9
WINDOW = 16
#: Shared chunks that are encoded once for all tasks: about 1 KB each.
SHARED = 10_000
#: Longest shared chunk, in bytes, so that the table has a bound.
LONGEST = 4096
#: Entries of a task's own tables.
CHUNKS = 5_000
WORDS = 100_000

_BLANK = re.compile(r"[ \t\n\r]+")
_BLANKS = " \t\n\r"
_GEAR = np.random.default_rng(99).integers(0, 2**32, 256, dtype=np.uint32)
#: Runs of letters and of signs, whose tokens may be looked up apart from each other if the tokenizer shows that it parts them.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"""!"#$%&()*+,\-./:;=?|"""
_RUN = re.compile(f"[{_LETTERS}]+|[{_SIGNS}]+")
_OTHER = re.compile(f"[^{_LETTERS}{_SIGNS}{_BLANKS}]")
_PROBES = ("word", "Word", "WORDS.", "ÈÉäöü", "straßeÿ!!", "a,", "Zz$$$", "éèê;:", "ÀÖØÞ#*?", "(word)", '"Zz"', "a-b", "x|y", "|", "%&é", "a/b.c", "+=x", "...", "#a")


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a chunk ends: by the rolling hash, never inside a character, and at every text's end."""
    n = len(data)
    h = np.zeros(n, np.uint32)
    gear = _GEAR[data]
    with np.errstate(over="ignore"):
        for k in range(min(WINDOW, n)):
            h[k:] += gear[: n - k] << np.uint32(k)
    ends = np.flatnonzero((h >> np.uint32(WINDOW - 1)) & np.uint32((1 << CUT_BITS) - 1) == 0) + 1
    ends = ends[ends < n]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    return np.union1d(ends, offsets)


class _Words(dict):
    """Tokens by piece or run; those of a run are made when it is first asked for.  A full table starts anew."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def keep(self, text: str, ids: bytes) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        self[text] = ids
        return ids

    def __missing__(self, run: str) -> bytes:
        return self.keep(run, self.make(run))


def _made_run(model):
    """Gives the tokens of lower-case letters, or of signs, straight from the merges."""
    letters = _byte_letters()
    return lambda run: array("i", [x.id for x in model.tokenize(run if run.isascii() else run.translate(letters))]).tobytes()


class Encoder:
    """Encodes texts with one tokenizer file, keeping what it has met before; shared: entries of chunk() by chunk."""

    def __init__(self, path: str, shared: dict[bytes, tuple] | None = None):
        self.tokenizer = _tokenizer(path)
        make = _made_run(self.tokenizer.model)
        self.words = _Words(make)
        self.chunks: dict[bytes, tuple] = {}
        self.shared = shared or {}
        self.reused = self.made = self.anew = 0
        self.vocabulary = _vocabulary(path)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = all(map(_OTHER.search, added)) and all(self._runs(x) == self._encoded(x) for x in _PROBES)
        if not self.plain:
            self.words = _Words(make)

    def _encoded(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _runs(self, text: str) -> bytes:
        """The tokens of a text of letters, signs and blanks, each run worked out once."""
        return b"".join(map(self.words.__getitem__, _RUN.findall(text.lower())))

    def word(self, text: str) -> bytes:
        """The ids of a piece between blanks, as 32-bit numbers."""
        if not text:
            return b""
        if self.plain and not _OTHER.search(text):
            return self._runs(text)
        found = self.words.get(text)
        return self.words.keep(text, self._encoded(text)) if found is None else found

    def made_chunk(self, raw: bytes) -> tuple:
        """(first piece, ids of the whole pieces after it, last piece, first and last whole piece); without a blank, ids are None."""
        text = raw.decode("utf-8", "surrogatepass")
        blank = _BLANK.search(text)
        if blank is None:
            return text, None, "", "", ""
        start, end = blank.end(), 1 + max(map(text.rfind, _BLANKS))
        inner = text[start:end].rstrip(_BLANKS)
        if self.plain and not _OTHER.search(inner):
            ids = self._runs(inner)
        else:
            ids = b"".join([self.word(p) for p in _BLANK.split(inner)])
        return text[: blank.start()], ids, text[end:], _BLANK.split(inner, 1)[0], inner[1 + max(map(inner.rfind, _BLANKS)) :]

    def chunk(self, raw: bytes) -> tuple:
        found = self.shared.get(raw) or self.chunks.get(raw)
        if found is not None:
            self.reused += 1
            return found
        self.made += 1
        found = self.made_chunk(raw)
        if len(self.chunks) >= CHUNKS:
            self.chunks = {}
        self.chunks[raw] = found
        return found

    def repaired(self, left: str, joined: str, right: str) -> bytes | None:
        """The tokens of the piece at a join, encoded again with its neighbours; None where theirs come out otherwise."""
        before, after = self.word(left), self.word(right)
        again = self._encoded(" ".join([x for x in (left, joined, right) if x]))
        end = len(again) - len(after)
        return again[len(before) : end] if len(before) <= end and again.startswith(before) and again.endswith(after) else None

    def ids(self, raws: list[bytes]) -> bytes:
        """The ids of a text given by its chunks."""
        ids, pending, left = [], [], ""
        for raw in [*raws, b" "]:
            head, own, tail, first, last = self.chunk(raw)
            pending.append(head)
            if own is None:
                continue
            joined = "".join(pending)
            if joined:
                found = self.repaired(left, joined, first)
                if found is None:
                    self.anew += 1
                    return self._encoded(b"".join(raws).decode("utf-8", "surrogatepass"))
                ids.append(found)
                left = joined
            ids.append(own)
            left, pending = last or left, [tail]
        return b"".join(ids)

    def decoded(self, ids: bytes) -> str:
        """The ids' text; a tokenizer without a decoder joins its tokens by blanks, and that is done here."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(array("i", ids).tolist(), skip_special_tokens=False)
        return " ".join(map(self.vocabulary.__getitem__, array("i", ids)))


_tokenizers: dict = {}
_vocabularies: dict = {}


def _tokenizer(path: str):
    """This worker's tokenizer of a file; nothing of the texts stays in it."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _tokenizers[path] = made
    return _tokenizers[path]


def _vocabulary(path: str) -> list[str]:
    """The tokens by id, also those that were added."""
    if path not in _vocabularies:
        ids = _tokenizer(path).get_vocab(with_added_tokens=True)
        found = [""] * (max(ids.values(), default=-1) + 1)
        for token, i in ids.items():
            found[i] = token
        _vocabularies[path] = found
    return _vocabularies[path]


def _byte_letters() -> dict[int, str]:
    """The letters that stand for the UTF-8 bytes of characters below 256 in byte-level vocabularies: printable bytes stand for themselves, the others for 256 and on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in own]
    letter = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(33, 256)}


def encode_texts(texts: pa.Array, enc: Encoder) -> tuple[pa.Array, pa.Array]:
    """(ids, decoded) of an array of texts."""
    data, offsets = flat(texts)
    ends = cuts(data, offsets)
    raw = data.tobytes()
    at = np.searchsorted(ends, offsets)
    ids, decoded = [], []
    for i in range(len(texts)):
        bounds = ends[at[i] : at[i + 1] + 1].tolist()
        ids.append(enc.ids([raw[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]))
        decoded.append(enc.decoded(ids[-1]))
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(ids), np.int32))), pa.array(decoded, pa.string())


def _encode(path: str, shared):
    def run(batches):
        enc = Encoder(path, by_bytes(shared.value))
        for batch in batches:
            for part in slices(batch, "text"):
                ids, decoded = encode_texts(part.column("text"), enc)
                yield pa.RecordBatch.from_arrays([part.column("row"), ids, decoded], ["row", "ids", "decoded"])

    return run


def _chunks(texts: pa.Array):
    """(digest, bytes) of the chunks of all texts that may be shared, each once a text."""
    data, offsets = flat(texts)
    ends = cuts(data, offsets)
    raw, at = data.tobytes(), np.searchsorted(ends, offsets).tolist()
    bounds = ends.tolist()
    for i in range(len(texts)):
        own = {raw[x:y] for x, y in zip(bounds[at[i] : at[i + 1]], bounds[at[i] + 1 : at[i + 1] + 1], strict=True) if y - x <= LONGEST}
        for c in own:
            yield xxhash.xxh3_64_intdigest(c) - (1 << 63), c


def _count_chunks(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            found: dict[int, list[int]] = {}
            for digest, c in _chunks(part.column("text")):
                found.setdefault(digest, [0, len(c)])[0] += 1
            n, size = zip(*found.values(), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(n, pa.int64()), pa.array(size, pa.int64())], ["digest", "n", "size"])


def _fetch_chunks(wanted):
    def run(batches):
        left = set(wanted.value)
        for batch in batches:
            for part in slices(batch, "text"):
                found = {}
                for digest, c in _chunks(part.column("text")):
                    if digest in left:
                        left.discard(digest)
                        found[digest] = c
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["digest", "raw"])

    return run


def _encode_chunks(path: str):
    def run(batches):
        enc = Encoder(path)
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            made = [enc.made_chunk(x) for x in raws]
            yield pa.RecordBatch.from_arrays(
                [pa.array(raws, pa.binary()), *[pa.array([m[i] for m in made], pa.binary() if i == 1 else pa.string()) for i in range(5)]], ["raw", "head", "ids", "tail", "first", "last"]
            )

    return run


def shared_chunks(docs: DataFrame, path: str, most: int = SHARED) -> pa.Table:
    """The tokens, as of made_chunk(), of the chunks that save most when they are encoded once: most of them at most, each in two or more documents.

    All chunks of all documents are counted by digest; only the chosen ones'
    bytes move, and one task encodes each.  Digests choose, bytes decide: a
    chunk is looked up by its bytes.
    """
    counted = docs.select("text").mapInArrow(lean(_count_chunks), "digest long, n long, size long").groupBy("digest").agg(F.sum("n").alias("n"), F.min("size").alias("size")).where("n > 1")
    top = counted.orderBy(((F.col("n") - 1) * F.col("size")).desc(), "digest").limit(most).select("digest").collect()
    kind = "raw binary, head string, ids binary, tail string, first string, last string"
    if not top:
        return docs.sparkSession.createDataFrame([], kind).toArrow()
    wanted = docs.sparkSession.sparkContext.broadcast([r["digest"] for r in top])
    raws = durable(docs.select("text").mapInArrow(lean(_fetch_chunks(wanted)), "digest long, raw binary").groupBy("digest").agg(F.min("raw").alias("raw")), "chunks")
    made = raws.select("raw").mapInArrow(lean(_encode_chunks(path)), kind).toArrow()
    discard(raws)
    return made


def by_bytes(table: pa.Table) -> dict[bytes, tuple]:
    """shared_chunks() as a task looks them up."""
    return dict(zip(table.column("raw").to_pylist(), zip(*(c.to_pylist() for c in table.columns[1:]), strict=True), strict=True))


def encode_decode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), shared: int = SHARED) -> DataFrame:
    """The kept columns of every row with ids (array of int) and decoded (the ids' text).

    ids are those of the tokenizer file's encode(text, add_special_tokens=False)
    without truncation and padding, decoded those of decode(ids,
    skip_special_tokens=False).  A null text counts as empty: no ids and an
    empty text.  Rows that repeat each get their tokens; other columns, whatever
    their names, don't matter.  The file must exist at path on every executor.
    An empty table gives an empty result.  shared bounds the chunks that are
    encoded once for all tasks; results don't depend on it.
    """
    table = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path, shared))
    packed = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), "text")
    out = packed.mapInArrow(lean(_encode(path, table)), f"row {packed.schema['row'].dataType.simpleString()}, ids array<int>, decoded string")
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "ids", "decoded")
