"""The operators against plain Python on small tables with nulls, empty, very long, tied and repeated rows."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import bloom_diff, bpe, chat, htmltext, jaccard, langid, linededup, mixing, quality_model, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string"
WORDS = [f"w{i}" for i in range(400)]


def prose(a, n):
    return " ".join(WORDS[(a * 37 + i * i * 7 + i) % 400] for i in range(n))


LONG = prose(5, 30000)
ROWS = [
    (1, prose(1, 80), "en", "b"), (2, prose(1, 80), "en", "b"), (3, prose(1, 79) + " changed", "en", None), (4, None, None, "a"), (5, "", "de", "a"), (6, "Only TWO", "de", None),
    (7, " \t\n", None, "c"), (8, LONG, "en", "c"), (8, LONG, "en", "c"), (9, "only two", "de", "d"), (10, prose(3, 60) + ". One sentence that comes again in another text here. " + prose(4, 30), "de", "d"),
    (11, "One sentence that comes again in another text here.\nAnd a line of its own, which is new.", "de", "d"), (None, prose(9, 70), None, "e"), (12, "🙂 é" * 9, "fr", "e"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "x") for r in ROWS], DOCS).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("n,t", [(3, (9, 10)), (5, (4, 5))])
def test_jaccard(docs, n, t):
    sets = []
    for i, text, *_ in ROWS:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) * t[1] >= t[0] * len(x | y):
                group = [group[b] if g == group[a] else g for g in group]
    want = Counter((i, len(s), min((sets[j][0] for j in range(len(sets)) if group[j] == group[q] and sets[j][0] is not None), default=None)) for q, (i, s) in enumerate(sets))
    want = Counter({(i, s, c if s else i): k for (i, s, c), k in want.items()})
    assert Counter(map(tuple, jaccard.jaccard_components(docs, n, *t).collect())) == want
    assert jaccard.jaccard_components(docs.limit(0), n, *t).count() == 0


def test_jaccard_null_and_repeated_ids(spark):
    a, b, c = prose(1, 80), prose(3, 80), prose(6, 80)
    rows = [(None, a + " more"), (5, a), (7, b), (7, c), (9, b + " more"), (11, c + " more"), (None, prose(11, 90)), (None, prose(11, 90) + " more")]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in found) == Counter([(None, 5), (5, 5), (7, 7), (7, 7), (9, 7), (11, 7), (None, None), (None, None)])


@pytest.mark.parametrize("num,den", [(9, 10), (4, 5), (3, 4)])
def test_linked_sets_share_a_key_whatever_the_classes(num, den):
    import numpy as np
    from fractions import Fraction

    rng, t, met = np.random.default_rng(num), Fraction(num, den), 0
    for _ in range(3000):
        tokens = rng.permutation(120).astype(np.uint64)
        place = rng.integers(0, 50, 120)
        place[rng.random(120) < rng.choice([0.1, 0.5, 0.9, 1.0])] += jaccard._OFTEN
        n, d = int(rng.integers(2, 90)), int(rng.integers(0, 12))
        x, y = np.sort(tokens[:n]), np.sort(tokens[d : n + int(rng.integers(0, 8))])
        both = len(np.intersect1d(x, y))
        if len(x) and len(y) and jaccard.reaches(both, len(x), len(y), t) and (len(x) != len(y) or (x != y).any()):
            a, b = (set(zip(*(k.tolist() for k in jaccard.prefix_keys(s, place[s.astype(int)], t)))) for s in (x, y))
            assert a & b
            met += 1
    assert met > 100


def test_block_links_join_all_labels():
    import numpy as np
    from fractions import Fraction

    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(1, 2**60, 100, dtype=np.uint64))
    sets = [np.sort(np.concatenate([np.delete(base, range(i % 20, i % 20 + 3)), rng.integers(1, 2**60, 3, dtype=np.uint64)])) for i in range(300)]
    ids = [i.to_bytes(4, "big") for i in range(300)]
    links = jaccard.block_links(ids, ids, sets, np.ones(300, bool), Fraction(4, 5))
    assert len(links) == 299


def test_mixing(docs, spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', cast(1 + id % 13 as int))").alias("text"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"))
    rows = mixing.mix_sources(many).collect()
    total, by = sum(r["size"] for r in rows), {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6
    for v in by.values():
        assert v[0]["target"] <= 3 * v[0]["source_size"] + 1e-9 and abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 13
    again = mixing.mix_sources(many.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    mixed = mixing.mix_sources(docs).collect()
    assert len(mixed) == len(ROWS) and {r["size"] for r in mixed if r["doc_id"] in (4, 5, 7)} == {0}
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs).columns == docs.columns


def test_base_counts_and_ratio(docs, spark):
    extra = spark.createDataFrame([(20, "a b c x a b c\nsame line\nsame line\n\n#$|", None, None, 0, "")], DOCS)
    rows = quality_rules.base_counts(docs.union(extra)).collect()
    for r in rows:
        w, text = words(r["text"]), r["text"] or ""
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
    good = spark.createDataFrame([(i, prose(i, 90)) for i in range(30)] + [(100 + i, "## !! " * 40 + prose(i, 20)) for i in range(10)], "doc_id long, text string")
    kept = {r["doc_id"]: r for r in quality_rules.judge(good, good.where("doc_id < 100").select("doc_id")).collect()}
    assert all(kept[i]["llr"] > kept[100]["llr"] for i in range(30)) and not any(kept[i]["kept"] for i in kept if i >= 100)
    assert quality_rules.judge(docs.limit(0), good).count() == 0


def test_line_dedup(docs):
    rows = {(r["doc_id"], r["text"]): r for r in linededup.drop_repeats(docs, 8).collect()}
    assert all(len(r["removed_spans"]) == 0 for (i, _), r in rows.items() if i in (1, 4, 5, 7, 10))
    two = next(r for (i, _), r in rows.items() if i == 2)
    assert two["text"] == "" and two["removed_spans"][0]["start"] == 0
    eleven = next(r for (i, _), r in rows.items() if i == 11)
    assert eleven["text"] == "And a line of its own, which is new."
    assert linededup.drop_repeats(docs.limit(0)).count() == 0


def test_line_dedup_short_pieces_go_with_their_neighbours(spark):
    passage = "Short one. This sentence of the passage has more than eight words in it. It ends. Here\nis a line. And a last one."
    rows = [(1, "Start of the first text. " + passage), (2, "Other words before it. " + passage + "\nWhat the second adds."), (3, "Here it ends.\nShort one.\nNothing comes again."), (4, "Yes. " * 24)]
    found = {r["doc_id"]: r["text"] for r in linededup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()}
    assert found[1] == rows[0][1] and found[3] == rows[2][1]
    assert found[2] == "Other words before it. \nWhat the second adds."
    assert found[4].split() == ["Yes."] * 8


def test_line_dedup_cuts_only_the_row_that_repeats(spark):
    again, fresh = "This line of the first text comes again in another one.", "A clean line that is nowhere else, as long as the other one is, stays here."
    rows = [(1, again), (None, again + "\nIts own end."), (None, fresh), (2, "Another " + fresh), (2, again)]
    found = Counter((r["doc_id"], r["text"]) for r in linededup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect())
    assert found == Counter([(1, again), (None, "Its own end."), (None, fresh), (2, "Another " + fresh), (2, "")])


def test_fingerprints(docs):
    def keys(t):
        return {p.strip(" ") for p in re.split(bloom_diff.PARAGRAPH_END, t or "")} - {""}

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    order = [(4, ""), (5, ""), (6, "Only TWO"), (10, ROWS[10][1]), (11, ROWS[11][1])]
    rows = {r["doc_id"]: r for r in bloom_diff.fingerprints(docs.where("doc_id in (4, 5, 6, 10, 11)")).collect()}
    for (i, text), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        q = len(text) // 4
        edited = text[: len(text) - q] + nxt[:q]
        assert rows[i]["edited"] == edited and rows[i]["near_edited"] == like(keys(text), keys(edited)) and rows[i]["near_next"] == like(keys(text), keys(nxt))
    assert rows[4]["fingerprint"] == rows[5]["fingerprint"] != rows[6]["fingerprint"]
    assert bloom_diff.fingerprints(docs.limit(0)).count() == 0
    assert bloom_diff.fingerprints(docs.select("doc_id", F.regexp_replace("text", " ", ".\n").alias("text"))).count() == len(ROWS)


def test_chat(spark):
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "system", "<\\| \\\\<|turn|> <|end|>\n"), (1, 1, "assistant", None), (1, None, None, "a"),
            (1, 2, "user", "\\<\\|x" * 900), (1, 3, "assistant", "w " * 700), (1, 3, "assistant", "v"), (None, 0, "user\n", "b")]
    read = {r["conv_id"]: r for r in chat.read_back(chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(read) == {-7, 1, None} and read[1]["n_windows"] > 1
    for conv, r in read.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [x[2:] for x in own]
        assert r["loss_text"] == "".join(x[3] for x in own if x[2] == "assistant")


def test_html():
    page = (
        '<title>T</title><nav>menu</nav><div class="ad">buy</div><article><h1>Head</h1><p><b>A &amp; b<br>c  d</b>e<p>f<form>no</form><script>x="</p>"</script>'
        '<section id="comments">reader</section></article><footer>&copy; x</footer>'
    )
    lines = htmltext.page_lines(page)
    assert htmltext.main_text([k for k, _ in lines], [t for _, t in lines], list(range(len(lines))), []) == "Head A & b c de f"
    assert htmltext.page_lines("") == [] and htmltext.shared_lines([1, 2, 3, 4], [2, 9, 4]) == {1, 3}
    assert htmltext.main_text([1, 1, 1], ["Home", "body text that is long", "Foot"], [1, 2, 3], [1, 8, 3]) == "body text that is long"


def test_html_names_that_only_hold_a_frame_word_stay():
    page = '<article><div class="entry-header"><h1>Head</h1></div><p class="share-price">One euro</p><div class="search-results">Found</div><div class="post ad-slot">buy</div></article><div id="site-footer">foot</div>'
    assert [t for k, t in htmltext.page_lines(page) if k != htmltext.FRAME] == ["Head", "One euro", "Found"]


def test_shared_lines_are_a_longest_common_subsequence():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(0, 14)).tolist() for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        found = sorted(htmltext.shared_lines(a, b))
        left = iter(b)
        assert len(found) == best[-1][-1] and all(any(y == a[i] for y in left) for i in found)


def test_range_of(spark):
    from millrace.llm import ordering

    for n in (0, 1, 255, 256, 257, 1500):
        bounds = list(range(0, 3 * n, 3))
        rows = spark.range(0, 3 * n + 5, 7).select("id", ordering.range_of(F.col("id"), bounds, "bigint").alias("r")).collect()
        assert all(r["r"] == sum(b <= r["id"] for b in bounds) for r in rows)


def test_html_table(spark):
    rows = [(1, "http://h/a/1", "<div>Frame</div><div>first text of the site</div>"), (2, "http://h/a/2", "<div>Frame</div><div>second text of the site</div>"), (3, None, None), (4, "x", "")]
    found = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: "first text of the site", 2: "second text of the site", 3: "", 4: ""}


def test_html_alignment_decides_beside_and_inside_an_article(spark):
    def page(lead, own):
        return f"<div>{lead}</div><div>Site frame</div><article><p>{own}</p><p>All rights reserved.</p></article>"

    rows = [
        (1, "http://h/a/1", page("lead one", "first text of the site")), (2, "http://h/a/2", page("lead two", "second text of the site")),
        (3, "http://copy/1", page("lead three", "the same long text on both")), (4, "http://copy/2", page("lead four", "the same long text on both")),
        (5, "http://alone/", page("lead five", "text without a neighbour")),
    ]
    found = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {
        1: "lead one first text of the site", 2: "lead two second text of the site",
        3: "lead three the same long text on both All rights reserved.", 4: "lead four the same long text on both All rights reserved.",
        5: "lead five Site frame text without a neighbour All rights reserved.",
    }


def test_bpe(docs, spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    odd = ["a<|endoftext|>b <|startoftext|>", "İstanbul x\x0by\x1cz é ́a", "it's  we'll\n\n", "x" * 5000, "ΑΣ ΣΑ"]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    assert bpe.shared_chunks(more, path).num_rows > 5 and bpe.encode_decode(more.limit(0), path).count() == 0
    for r in bpe.encode_decode(more, path, ("doc_id", "text")).collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == whole.decode(ids, skip_special_tokens=False)


def test_bpe_tables_and_disagreeing_joins(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    texts = [prose(i % 7, 400) + " É.a 'tis it's x\u0301 " + "y" * i for i in range(30)]
    whole = bpe.Encoder(path)
    for limits in ({}, {"CHUNKS": 3, "WORDS": 5}):
        for name, value in limits.items():
            monkeypatch.setattr(bpe, name, value)
        ids, decoded = bpe.encode_texts(__import__("pyarrow").array(texts), bpe.Encoder(path))
        for text, a, b in zip(texts, ids.to_pylist(), decoded.to_pylist(), strict=True):
            want = whole.tokenizer.encode(text, add_special_tokens=False).ids
            assert a == want and b == whole.tokenizer.decode(want, skip_special_tokens=False)
    # a chunk with wrong tokens at its edge: the join does not agree, and the text is encoded anew
    enc = bpe.Encoder(path)
    assert enc.plain and enc.repaired("one", "two", "three") == enc.word("two")
    enc.words["three"] = b"\1\0\0\0"
    assert enc.repaired("one", "two", "three") is None
    raws = [b"one t", b"wo three four"]
    assert enc.ids(raws) == enc._encoded("one two three four") and enc.anew == 1


def test_bpe_looks_runs_up_once_whatever_stands_beside_them():
    public = pytest.importorskip("public_tokenizers")
    enc = bpe.Encoder(public.path("word_bpe_49k.json"))
    assert enc.plain
    enc.words.clear()
    text = "One two, (one) TWO-one: one|two\n| One, two... \t«one» it's 2one"
    made = enc.made_chunk(f"a {text} b".encode())
    assert made == ("a", enc._encoded(text), "b", "One", "2one")
    assert set(enc.words) == {"one", "two", ",", "(", ")", "-", ":", "|", "...", "«one»", "it's", "2one"}
    for text in ("a", "", " ", " a", "a ", "a b", "a\n\tb c ", "  a  b  "):
        pieces = re.split(r"[ \t\n\r]+", text)
        inner = pieces[1:-1]
        want = (pieces[0], None, "", "", "") if len(pieces) == 1 else (pieces[0], enc._encoded(" ".join(inner)), pieces[-1], *(inner[:1] or [""]), *(inner[-1:] or [""]))
        assert enc.made_chunk(text.encode()) == want


def test_bpe_with_an_added_token_of_letters(tmp_path):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    whole.add_tokens(["eve"])
    whole.save(str(tmp_path / "added.json"))
    enc = bpe.Encoder(str(tmp_path / "added.json"))
    texts = [prose(3, n) + " seven " + prose(4, 300) for n in range(0, 300, 10)]
    ids, _ = bpe.encode_texts(__import__("pyarrow").array(texts), enc)
    assert ids.to_pylist() == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_learned_models(spark, docs):
    parts = {"en": "th ing the", "de": "sch und ein", "fr": "eau les oui", "es": "cion los que"}
    rows = [(i, " ".join(parts[c].split()[(i + j * j) % 3] for j in range(40)), c) for i, c in enumerate(list(parts) * 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table.where("doc_id % 4 <> 2 or lang = 'fr'"))
    assert model.families == [["de", "en"], ["es", "fr"]]
    found = langid.identify(table, model, ("doc_id", "lang")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) > 150
    und = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert und[4]["lang_pred"] == und[5]["lang_pred"] == und[7]["lang_pred"] == "und"
    labels = table.select("doc_id", (F.col("lang") == "en").cast("int").alias("label"))
    scored = quality_model.score(table, quality_model.train(table, labels), ("doc_id", "lang")).collect()
    assert sum((r["score"] >= 0.5) == (r["lang"] == "en") for r in scored) > 150
    assert quality_model.score(docs, quality_model.train(docs, labels.limit(0))).count() == len(ROWS)


def test_known_language_rejects_with_two_families(spark):
    parts = {"en": "thing the nder other with that", "de": "sch und ein lich keit nicht", "fr": "eau les oui que elle de", "es": "cion los que para ado con"}
    rows = [(i, " ".join(parts[c].split()[(i + j * j + j) % 6] for j in range(40)), c) for i, c in enumerate(list(parts) * 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table)
    assert len(model.families) == 2
    odd = [(1000, "zxqj kjwq vvbx qqkz jxxw pqzv kkjx wqzz", None), (1001, "Все люди рождаются свободными и равными в своем достоинстве", None), (1002, "x 1 2 3 4 5 6 ||| ### $$$", None), (1003, None, None)]
    more = table.union(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    assert sorted(r["doc_id"] for r in langid.known_language(more, model).collect()) == [r[0] for r in rows]


def test_train_learns_all_languages_or_raises(spark):
    table = spark.createDataFrame([(i, f"text {i}", f"l{i:03d}") for i in range(201)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.train(table)
    few = table.where("doc_id < 3")
    with pytest.raises(ValueError):
        langid.train(few, most_langs=2)
    assert langid.train(few, most_langs=3).families == [["l000"], ["l001"], ["l002"]]
