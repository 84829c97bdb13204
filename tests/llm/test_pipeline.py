"""The pipeline's stages and the registered queries on small tables, held against plain Python."""

import os
import platform
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from millrace.llm import linededup, textbytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, gone long, spans string"
PARTS = {"en": "thing the nder other with that", "de": "sch und ein lich keit nicht", "fr": "eau les oui que elle de", "es": "cion los que para ado con"}


def text(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(PARTS[lang].split()) + rng.choice(["", "a", "o", "er"]) for _ in range(n))


def rows():
    out = [(i, text(c, i), c, f"s{i % 3}") for i, c in enumerate(list(PARTS) * 20)]
    out += [(200, text("en", 0) + " oner", "en", "s0"), (201, text("de", 1), "de", None), (202, None, "en", "s1"), (203, "", None, "s1"), (204, "1 2 3 $$$", None, "s2")]
    out += [(205, "Все люди рождаются свободными и равными в своем достоинстве и правах", None, "s2"), (None, text("fr", 900), "fr", "s1"), (None, text("fr", 901), None, "s1"), (206, text("es", 902), "es", "s2"), (206, text("es", 903), "es", "s2")]
    return [(i, t, c, s, len(t or ""), 0.5, 1, "x") for i, t, c, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def plain(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_keep_columns_and_empty_tables(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").schema.names == docs.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_language_stage(spark, docs):
    kept = plain(corpus_pipeline.language(spark, docs, ""))
    assert kept == Counter(r for r in rows() if r[0] not in (202, 203, 204, 205))


def test_near_duplicates_stage(spark, docs):
    kept = plain(corpus_pipeline.near_duplicates(spark, docs, ""))
    sets = [(r, {tuple(w[j : j + 5]) for w in [(r[1] or "").split()] for j in range(len(w) - 4)}) for r in rows()]
    gone = {r[0] for r, a in sets for q, b in sets if a and r[0] is not None and q[0] is not None and q[0] < r[0] and len(a & b) * 5 >= 4 * len(a | b)}
    assert gone == {200, 201} and kept == Counter(r for r in rows() if r[0] not in gone)


def test_repeats_stage(spark, docs):
    kept = plain(corpus_pipeline.repeats(spark, docs, ""))
    assert kept == Counter(r for r in rows() if r[0] != 201)


def test_mixture_and_tokens_stages(spark, docs):
    own = {r[:4] for r in rows()}
    mixed = corpus_pipeline.mixture(spark, docs, "").collect()
    times = Counter(tuple(r)[:4] for r in mixed)
    assert set(times) <= own and max(times.values()) <= 3
    found = corpus_pipeline.tokens(spark, docs, "").collect()
    assert len(found) == len(rows()) and all(r["n_tokens"] == len(r["ids"]) and (r["n_tokens"] > 0) == bool(r["decoded"]) for r in found)


def reference_cut(table, least):
    """The cut texts, unit by unit in rising rank."""
    first = {}
    order = sorted({(i is None, i or 0, mark, t) for i, t, mark in table if t})
    spans = {}
    for none, i, mark, t in order:
        mine = {}
        for a, b, norm in sorted(linededup.units(t, least)):
            home = first.setdefault(norm, (none, i, mark))
            end = mine.setdefault(norm, b)
            if home != (none, i, mark) or a >= end:
                spans.setdefault((none, i, t), set()).add((a, b))
    return Counter((i, linededup.cut(t, sorted(spans.get((i is None, i or 0, t), ()))) if t else t) for i, t, _ in table)


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_against_plain_python(spark, seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) + rng.choice([".", "", "!"]) for _ in range(14)]
    table = [(rng.choice([None, *range(12)]), rng.choice(["\n", " "]).join(rng.choice(lines) for _ in range(rng.randint(0, 7)))) for _ in range(40)]
    df = spark.createDataFrame([*table, (3, None)], "doc_id long, text string")
    marked = [(r["doc_id"], r["text"], r["mark"]) for r in df.withColumn("mark", F.xxhash64("text")).collect()]
    assert Counter((r["doc_id"], r["text"]) for r in linededup.drop_repeats(df, 6).collect()) == reference_cut(marked, 6)


def test_registered_queries_meet_their_contracts(spark):
    d = "/root/testdata/sf0.001"
    queries = __spark_entry__.queries()
    documents = spark.read.parquet(f"{d}/documents.parquet")
    n = documents.count()
    mixed = queries["op1_mix_sources"](spark, d).collect()
    by = {}
    for r in mixed:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    assert len(mixed) == n and abs(sum(v[0]["target"] for v in by.values()) - sum(r["size"] for r in mixed)) < 1e-3
    for v in by.values():
        off, least = abs(sum(r["taken"] for r in v) - v[0]["target"]), min((r["size"] for r in v if r["size"]), default=0)
        assert off <= max(0.01 * v[0]["target"], least)
    for name in ("op4_quality_classifier", "op7_language_id"):
        found = queries[name](spark, d).collect()
        assert len(found) == n and all(0 <= r["score"] <= 1 for r in found)
    found = queries["op10_bloom_diff"](spark, d).collect()
    assert len(found) == n and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)


def test_one_large_document_of_a_source(spark):
    from millrace.llm import mixing

    sizes = [7000] + [100 + 7 * i for i in range(20)]
    table = [(i, "w " * s, "big") for i, s in enumerate(sizes)] + [(100 + i, "w " * 500, f"o{i % 2}") for i in range(60)]
    found = [r for r in mixing.mix_sources(spark.createDataFrame(table, "doc_id long, text string, source string")).collect() if r["source"] == "big"]
    assert abs(sum(r["taken"] for r in found) - found[0]["target"]) <= 100


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="other C libraries return memory in their own ways")
def test_a_worker_gives_back_a_task_s_memory():
    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGESIZE") / 1e6

    def run(batches):
        held = [bytes(1000) for _ in range(100_000)]
        last.append(held.pop())  # on top of what is freed
        yield from batches

    last: list[bytes] = []
    before = resident()
    assert list(textbytes.lean(run)([1, 2])) == [1, 2]
    assert resident() < before + 30
