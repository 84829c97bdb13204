"""Language identification by hierarchical discrimination.

A text is first given a language family, by one linear support vector machine
for each family against the rest; inside a family of several languages, one
linear machine for each two languages votes.  Inputs are the frequencies of
hashed 1- to 3-byte grams of the lower-cased text.  All machines are linear in
those frequencies, so a text is scored by summing one row of weights per gram.

The machines only choose among the learned languages.  Whether a text is in
any of them is told by a one-class distance: how far the mean log-likelihood of
its grams under a language's learned gram means falls short of that language's
median text.  Close relatives of a learned language are not told from it.

The machines are fitted on a bounded sample: at most about SAMPLE labelled
texts over all languages, chosen by the hash of doc_id in equal shares.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.textbytes import STEP_BYTES, byte_ngrams, flat, gram_sums, lean, slices

#: Labelled texts in the training sample, over all languages.
SAMPLE = 2400
BITS = 12
GRAMS = (1, 2, 3)
#: Units that a weight of 1 has.
UNIT = 1 << 20
#: A text is in no learned language where it falls short of all by more than FAR nats a gram, and by FAR_SHORT / sqrt(grams) for short ones.
FAR, FAR_SHORT = 1.5, 2.0

# Language families by ISO 639-1 code; other codes are a family each.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ast ca co es fr gl it la oc pt ro sc",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "bn gu hi mr ne pa sd si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg mi ms su tl",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"only {lang}")


@dataclass
class Model:
    """langs by family; columns of weights, in units: one a family (where there are several), then one a pair of languages.

    logs and typical have a column and a value a language: log gram means, and the median text's mean of them.
    """

    families: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray
    logs: np.ndarray
    typical: np.ndarray


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the lower-cased texts."""
    return flat(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))


def summed(texts: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of each text's weight rows over its grams, number of its grams)."""
    data, offsets = lowered(texts)
    total, n = np.zeros((len(texts), weights.shape[1]), np.int64), np.zeros(len(texts), np.int64)
    for k in GRAMS:
        more, grams = gram_sums(data, offsets, k, BITS, weights)
        total += more
        n += grams
    return total / UNIT, n


def gram_counts(text: str) -> np.ndarray:
    """Frequencies of one text's gram buckets."""
    data, _ = lowered(pa.array([text], pa.large_string()))
    counts = np.zeros(1 << BITS, np.int64)
    for k in GRAMS:
        for a in range(0, len(data) - k + 1, STEP_BYTES):
            part = data[a : a + STEP_BYTES + k - 1]
            counts += np.bincount(byte_ngrams(part, np.array([0, len(part)]), k, BITS)[0], minlength=len(counts))
    return (counts / max(counts.sum(), 1)).astype(np.float32)


def whole(x: np.ndarray) -> np.ndarray:
    """Weights in whole units, so that sums over grams are exact."""
    return np.rint(np.clip(x, -1e6, 1e6) * UNIT).astype(np.int64)


def _features(batches):
    for batch in batches:
        rows = [gram_counts(t or "").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.binary())], ["lang", "freq"])


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 250, reg: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear machine by averaged sub-gradient steps on the hinge loss; classes weigh alike. y: -1 or 1."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    # steps are of the inputs' own kind, as numpy would widen all of x in every round otherwise
    w, b = np.zeros(x.shape[1], x.dtype), 0.0
    w_sum, b_sum, used = np.zeros(x.shape[1]), 0.0, 0
    for t in range(rounds):
        wrong = y * (x @ w + b) < 1
        step = 2.0 / (1 + t) ** 0.5 / x.shape[1] ** 0.5
        g = (weight * y * wrong).astype(x.dtype) @ x
        w = w * x.dtype.type(1 - step * reg) + x.dtype.type(step) * g
        b += step * float((weight * y * wrong).sum())
        if t >= rounds // 2:
            w_sum, b_sum, used = w_sum + w, b_sum + b, used + 1
    return w_sum / used, b_sum / used


def fit(langs: list[str], freq: np.ndarray) -> Model:
    """Fit all machines on texts' gram frequencies, which are overwritten."""
    known = sorted(set(langs))
    families = [sorted(g) for _, g in itertools.groupby(sorted(known, key=lambda c: (family_of(c), c)), key=family_of)]
    lang = np.array(langs)
    scale = freq.std(0) + 1e-4 if len(freq) else np.ones(1 << BITS)
    mean = freq.mean(0) if len(freq) else np.zeros(1 << BITS)
    logs = [np.log(0.9 * freq[lang == c].mean(0, dtype=np.float64) + 0.1 / (1 << BITS)) for c in known]
    typical = np.array([np.median(freq[lang == c] @ p.astype(np.float32)) for c, p in zip(known, logs, strict=True)])
    # in place, as the sample is the largest thing on the driver
    x = freq
    x -= mean.astype(np.float32)
    x /= scale.astype(np.float32)
    columns, bias, pairs = [], [], []

    def add(rows: np.ndarray, y: np.ndarray) -> None:
        w, b = svm(x if len(rows) == len(x) else x[rows], y)
        columns.append(w / scale)
        bias.append(b - float((w / scale) @ mean))

    if len(families) > 1:
        for f in families:
            add(np.arange(len(lang)), np.where(np.isin(lang, f), 1.0, -1.0))
    for f in families:
        for p in itertools.combinations(f, 2):
            rows = np.flatnonzero(np.isin(lang, p))
            pairs.append(p)
            add(rows, np.where(lang[rows] == p[0], 1.0, -1.0))
    weights = whole(np.stack(columns, 1)) if columns else np.zeros((1 << BITS, 0), np.int64)
    logs = whole(np.stack(logs, 1)) if logs else np.zeros((1 << BITS, 0), np.int64)
    return Model(families, pairs, weights, np.array(bias), logs, typical)


def far(model: Model, likelihood: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether texts of n grams and these sums of log gram means, a column a language, are in no learned language."""
    if not len(model.typical):
        return np.ones(len(n), bool)
    n = np.maximum(n, 1)
    return (likelihood / n[:, None] - model.typical).max(1) < -(FAR + FAR_SHORT / np.sqrt(n))


def decide(model: Model, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages and scores for rows of margins; the score is the least sure decision's logistic value."""
    n, several = len(margins), len(model.families) > 1
    if not model.families:
        return ["und"] * n, np.zeros(n)
    of_family = margins[:, : len(model.families)] if several else np.zeros((n, 1))
    family = of_family.argmax(1)
    sure = of_family.max(1) if several else np.full(n, 20.0)
    column = {p: len(model.families) * several + i for i, p in enumerate(model.pairs)}
    out = np.empty(n, object)
    for f, members in enumerate(model.families):
        rows = np.flatnonzero(family == f)
        votes, worst = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
        worst += 20.0
        for i, j in itertools.combinations(range(len(members)), 2):
            m = margins[rows, column[members[i], members[j]]]
            votes[:, i] += m > 0
            votes[:, j] += m <= 0
            worst[:, i], worst[:, j] = np.minimum(worst[:, i], m), np.minimum(worst[:, j], -m)
        best = (votes + 1e-3 * np.tanh(worst)).argmax(1)
        out[rows] = np.array(members, object)[best]
        if len(members) > 1:
            sure[rows] = np.minimum(sure[rows], worst[np.arange(len(rows)), best])
    return list(out), 1 / (1 + np.exp(-2 * np.clip(sure, -20, 20)))


def train(labelled: DataFrame, sample: int = SAMPLE, most_langs: int = 200) -> Model:
    """Fit on (doc_id, text, lang) rows with a text and a language; at most about sample texts, or 20 a language, are taken.

    All languages are learned; more than most_langs of them raise an error.
    """
    labelled = labelled.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(most_langs + 1).collect()}
    if len(counts) > most_langs:
        raise ValueError(f"more than most_langs = {most_langs} languages")
    if not counts:
        return fit([], np.zeros((0, 1 << BITS), np.float32))
    each = max(20, sample // len(counts))
    rates = F.map_from_arrays(F.lit(list(counts)), F.lit([min(1.0, each / n) for n in counts.values()]))
    rate = F.try_element_at(rates, F.col("lang"))
    draw = F.xxhash64(F.lit("lang sample"), "doc_id").bitwiseAND((1 << 52) - 1) / float(1 << 52)
    rows = labelled.where(draw < rate).select("lang", "text").mapInArrow(lean(_features), "lang string, freq binary").collect()
    rows.sort(key=lambda r: (r["lang"], xxhash.xxh3_128_digest(r["freq"])))
    langs, freq = [r["lang"] for r in rows], np.zeros((len(rows), 1 << BITS), np.float32)
    for i, r in enumerate(rows):
        freq[i] = np.frombuffer(r["freq"], np.float32)
    del rows
    return fit(langs, freq)


def _strange(model: Model, texts: pa.Array, likelihood: np.ndarray, n: np.ndarray) -> np.ndarray:
    """far(), where a text that is far is judged again without words of a digit or @, as numbers, keys and addresses have no language."""
    out = far(model, likelihood, n)
    again = np.flatnonzero(out)
    plain = [" ".join(w for w in (texts[int(i)].as_py() or "").split() if "@" not in w and not any(c.isdigit() for c in w)) for i in again]
    total, n = summed(pa.array(plain, pa.string()), model.logs)
    out[again] = far(model, total, n) | np.array([not any(c.isalpha() for c in t) for t in plain], bool)
    return out


def judged(model: Model, weights: np.ndarray, texts: pa.Array, reject: bool) -> tuple[list[str], np.ndarray]:
    """(languages, scores) of texts; weights are the machines' and, with reject, the log gram means beside them."""
    columns = model.weights.shape[1]
    total, n = summed(texts, weights)
    lang, score = decide(model, total[:, :columns] / np.maximum(n, 1)[:, None] + model.bias)
    known = pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
    if reject:
        known = known & ~_strange(model, texts, total[:, columns:], n)
    return [a if b else "und" for a, b in zip(lang, known, strict=True)], np.where(known, score, 0.0)


def _predict(shared, reject: bool):
    def run(batches):
        model = shared.value
        weights = np.hstack([model.weights, model.logs]) if reject else model.weights
        for batch in batches:
            for part in slices(batch, "text"):
                lang, score = judged(model, weights, part.column("text"), reject)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(lang, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), reject: bool = False) -> DataFrame:
    """The kept columns of every row with lang_pred and score.

    A null text, or one without a letter, gives und and a score of 0; so does, with
    reject, a text that is far from all learned languages.  Equal texts get equal results; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), "text")
    out = packed.mapInArrow(lean(_predict(shared, reject)), f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "lang_pred", "score")


def _known(shared, least: float):
    def run(batches):
        model = shared.value
        weights = np.hstack([model.weights, model.logs])
        for batch in batches:
            for part in slices(batch, "text"):
                lang, score = judged(model, weights, part.column("text"), True)
                yield part.filter(pa.array([a != "und" and b >= least for a, b in zip(lang, score, strict=True)], pa.bool_()))

    return run


def known_language(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs without the rows that are und, far from all learned languages, or that no family claims (score below least, which needs three); columns as they are.

    A null text, or one without a letter, goes; rows with equal texts stay or go
    together; a model that has learned nothing keeps nothing.  An empty table
    gives an empty result.  Every row travels once, whatever its columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lean(_known(shared, least)), docs.schema)
