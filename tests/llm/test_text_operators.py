"""Decontamination, token counts, classifiers and the pipeline."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidalframe.llm import bytecnn, bytetext, common, decontaminate, langid, quality, tokens, toxicity, training

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def slow_hits(text, items):
    words, hit, found = lowered(text), set(), set()
    for item, t in items:
        w = lowered(t)
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == w[i : i + n]:
                    hit.update(range(k, k + n))
                    found.add(str(item))
    return words, hit, found


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "日本", "x9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 20)))) for i in range(30)]
    items += [(40, None), (41, "..."), (42, "w1 w2"), (None, "w3 w4 w5"), (43, "W1, w2!")]
    docs = []
    for i in range(60):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice([". ", " -- ", "\n"]) + rng.choice(items[:30])[1].upper()
        docs.append((i, text))
    return docs + [(100, None), (101, ""), (102, "?!"), (103, "w1"), (104, "w1\x00w2"), (105, "w1 w2 " * 9000)], items


@pytest.mark.parametrize("block_bytes", [32_000_000, 400])
def test_decontamination_equals_brute_force(spark, block_bytes):
    docs, items = corpus()
    out = decontaminate.decontaminate(
        spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, N_words string"),
        spark.createDataFrame(items, "item_id long, text string"),
        clean=True,
        block_bytes=block_bytes,
    ).collect()
    known = [(i, t) for i, t in items if i is not None]
    for r in out:
        words, hit, found = slow_hits(r.text, known)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(words), len(hit), len(found), sha, len(found) >= 2)
        assert {k for a, b in zip(r.spans[::2], r.spans[1::2]) for k in range(a, b)} == hit
        if r.text is None or not hit:
            assert r.clean_text == r.text
        else:
            assert lowered(r.clean_text) == [w for i, w in enumerate(words) if i not in hit] or "\x00" in r.text
    assert any(r.n_items > 1 for r in out)


def test_an_empty_benchmark_hits_nothing(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    r = decontaminate.decontaminate(df, spark.createDataFrame([], "item_id long, text string")).first()
    assert (r.n_words, r.n_hit, r.contaminated, r.items_sha256) == (3, 0, False, hashlib.sha256(b"").hexdigest())
    assert decontaminate.decontaminate(df.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


# ------------------------------------------------------------------ tokens
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="aB1 .'\n\t\r<|endoftx>é　‍", max_size=300))
def test_the_fast_way_counts_as_the_library(text):
    from tokenizers import Tokenizer

    if not hasattr(test_the_fast_way_counts_as_the_library, "library"):
        test_the_fast_way_counts_as_the_library.library = Tokenizer.from_file(PATH)
    library = test_the_fast_way_counts_as_the_library.library
    assert tokens.engine(PATH)(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_counts_come_from_the_cache(spark, tmp_path, library):
    texts = [None, "", "one two", "one two", "three <|endoftext|> four", "é" * 3000, "a" * 20_000, " "]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    cache = str(tmp_path / "cache")
    first = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(df, PATH, cache).collect()}
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert first == {i: (len((t or "").encode()), n, n > 1024) for i, (t, n) in enumerate(zip(texts, want))}
    held = spark.read.parquet(cache)
    assert held.count() == len({t or "" for t in texts})
    more = spark.createDataFrame([(1, "one two"), (2, "new")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(more, PATH, cache).collect()}[1] == want[2]
    assert spark.read.parquet(cache).count() == held.count() + 1  # only the new text was encoded


def test_other_tokenizers_and_no_rows(spark, tmp_path):
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        df = spark.createDataFrame([(1, "Some words, here.")], "doc_id long, text string")
        assert tokens.count_tokens(df, public_tokenizers.path(name), str(tmp_path / name)).first().n_tokens > 2
        assert tokens.count_tokens(df.limit(0), public_tokenizers.path(name), str(tmp_path / name)).count() == 0


# ------------------------------------------------------------------ classifiers
def labelled():
    rng = random.Random(5)
    kinds = {"en": ["the", "and", "thing", "with"], "de": ["und", "nicht", "schön", "über"]}
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "de"])
        words = rng.choices(kinds[lang], k=rng.randint(8, 60))
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grobian", "lumpax", "grobius"]))
        rows.append((i, (" " if good else "%%% ").join(words), lang if i % 11 else None, int(good), int(toxic)))
    return rows


ODD = [(1000, None), (1001, ""), (1002, "123 !?"), (1003, "日本語"), (1004, "the and " * 20_000)]


def test_pooling_equals_a_plain_convolution():
    rng = np.random.default_rng(1)
    model = bytecnn.ByteCNN(2)
    data = rng.integers(0, 256, 700).astype(np.uint8)
    windows, doc = bytecnn.windows_of(data, np.array([0, 0, 300, 700]))
    assert list(doc) == [0, 1, 1, 2, 2]
    got = model.pooled(windows, model.pairs())
    for n, w in enumerate(windows):
        want = []
        for width, table in model.tables.items():
            want.append(np.max([sum(table[j][w[t + j]] for j in range(width)) for t in range(bytecnn.WINDOW)], axis=0))
        assert np.allclose(got[n], np.maximum(np.concatenate(want) + model.shift, 0), atol=1e-5)


def test_language_id_learns_and_handles_odd_texts(spark):
    rows = labelled()
    train = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows[:160]], "id long, text string, lang string")
    model = langid.fit(train)
    test = spark.createDataFrame([(r[0], r[1], "x") for r in rows[160:]] + [(*o, "x") for o in ODD], "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(test, model).collect()}
    right = [got[r[0]][0] == r[2] for r in rows[160:] if r[2]]
    assert sum(right) / len(right) > 0.95
    assert [got[i][0] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003][0] in ("en", "de") and got[1004][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())
    again = langid.fit(train)
    assert np.array_equal(model[1].linear, again[1].linear)
    nothing = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.identify_languages(test, nothing).collect()} == {"und"}


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_classifiers_learn_and_handle_odd_texts(spark, name):
    rows = labelled()
    at = 3 if name == "quality" else 4
    texts = spark.createDataFrame([(r[0], r[1]) for r in rows], "id long, text string")
    labels = spark.createDataFrame([(r[0], r[at]) for r in rows[:180]] + [(None, 1), (5000, 0), (3, None)], "id long, label int")
    test = spark.createDataFrame([(r[0], r[1], 1) for r in rows[180:]] + [(*o, 1) for o in ODD], "doc_id long, text string, predicted int")
    if name == "quality":
        out = quality.score_quality(test, quality.fit(texts, labels))
        bare = quality.score_quality(test, quality.fit(texts, labels.limit(0)))
    else:
        out = toxicity.score_toxicity(test, toxicity.fit(texts, labels))
        bare = toxicity.score_toxicity(test, toxicity.fit(texts, labels.limit(0)))
    got = {r.doc_id: r.score for r in out.collect()}
    one = [got[r[0]] for r in rows[180:] if r[at]]
    zero = [got[r[0]] for r in rows[180:] if not r[at]]
    assert np.mean([a > b for a in one for b in zero]) > 0.9
    assert len(got) == 65 and all(0 <= s <= 1 for s in got.values())
    assert bare.select("score").distinct().count() == 1


def test_grams_of_a_word():
    data = np.frombuffer(b"Ab c", np.uint8)
    gram, word, text = toxicity.grams(data, np.array([0, 4]))
    spelled = [int(g).to_bytes(8, "big").lstrip(b"\0") for g in gram]
    assert spelled == [b" a", b" ab", b" ab ", b" c", b" c "] and list(word) == [0, 0, 0, 1, 1] and list(text) == [0, 0]


def test_shared_model_sums_to_one(spark):
    data = np.frombuffer(b"abra cadabra abba", np.uint8)
    gram, _, _ = toxicity.grams(data, np.array([0, len(data)]))
    keys, n = np.unique(gram, return_counts=True)
    counts = spark.createDataFrame([(int(k), int(c), 0) for k, c in zip(keys, n)], "g long, t long, o long")
    sums = toxicity.shared_model(counts).groupBy(F.shiftright("g", 8)).agg(F.sum("p").alias("p")).collect()
    assert all(0 < r.p <= 1 + 1e-9 for r in sums)


def test_no_ratio_is_lost():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 40, 900_000))
    held, other = keys[::2], keys[1::2]
    value = rng.standard_normal(len(held)).astype(np.float32)
    table = toxicity.Ratios(iter([(held, value)]))
    assert np.array_equal(table.of(held), value) and not table.of(other).any()
    assert not toxicity.Ratios(iter([])).of(other).any()


def test_all_counted_ngrams_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 1000)
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    found = spark.createDataFrame([(int(k), float(i + 1), 1) for i, k in enumerate(keys)], "key long, ratio double, n long")
    tables = toxicity._tables(found)
    assert len(tables) == 5 and np.array_equal(toxicity._ratio(tables, keys), np.arange(1, len(keys) + 1))


def test_broadcast_ngrams_take_no_table_on_the_driver(spark):
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 1 << 40, 40_000))
    found = spark.createDataFrame([(int(k), float(i + 1)) for i, k in enumerate(keys)], "key long, ratio double")
    tables = toxicity._tables(found)
    assert sum(len(t.value) for t in tables) < 13 * len(keys)
    once = toxicity._ratios_of(tables)
    assert toxicity._ratios_of(list(tables)) is once and np.array_equal(once.of(keys), np.arange(1, len(keys) + 1))
    assert toxicity._ratios_of(toxicity._tables(found.limit(10))) is not once


def test_no_plan_holds_the_ngrams_of_all_lengths_at_once(spark):
    counts = spark.createDataFrame([(g, g % 3, 1) for g in range(50)], "g long, t long, o long")
    plan = toxicity.ratios(counts)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") < 12


def test_a_batch_is_cut_so_that_its_numbers_stay_small():
    batch = pa.RecordBatch.from_pydict({"text": ["some words of a text " * 400] * 500})
    tracemalloc.start()
    for part in bytetext.parts(batch, "text"):
        toxicity.grams(*bytetext.buffers(part.column("text")))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120_000_000


def test_what_workers_of_the_pipeline_hold_and_keep_stays_small():
    common.worker_state().pop("powers", None)
    batch = pa.RecordBatch.from_pydict({"text": ["some words of a text " * 400] * 500})
    tracemalloc.start()
    for part in bytetext.parts(batch, "text"):
        data, offsets = bytetext.buffers(part.column("text"))
        bytecnn.windows_of(data, offsets)
        bytetext.word_hashes(data, *bytetext.runs(bytetext.ALNUM[data], offsets))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60_000_000 and sum(x.nbytes for x in common.worker_state()["powers"]) < 20_000_000


def test_uncounted_ngrams_back_off_to_their_context(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ORDER", 5)
    monkeypatch.setattr(toxicity, "CONTEXT", 1 << 40)
    texts = {1: b"abcde abcdf abcde", 0: b"abcdg xyxy xyz"}
    seen = {}
    for label, text in texts.items():
        for g in toxicity.grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]:
            seen.setdefault(int(g), [0, 0])[1 - label] += 1
    counts = spark.createDataFrame([(g, t, o) for g, (t, o) in seen.items()], "g long, t long, o long")
    tables = toxicity._tables(toxicity.ratios(counts).select("key", "ratio").union(toxicity.backed_off(counts)))
    new = int.from_bytes(b"abcdz", "big"), int.from_bytes(b"qrstu", "big")
    # Toxic: 3 of abcd, 2 kinds; ordinary: 1, 1 kind. The shared probability falls out.
    want = np.log(((0.75 * 2 + 5) / (3 + 5)) / ((0.75 * 1 + 5) / (1 + 5)))
    got = toxicity._ratio(tables, np.array([*new, *seen], np.int64))
    assert np.allclose(got[:2], [want, 0]) and want < -0.1
    own = {r.key: r.ratio for r in toxicity.ratios(counts).collect()}
    assert np.allclose(got[2:], [own[g] for g in seen], atol=1e-6)


def spelled(text):
    """N-grams of all words as byte strings: a space, the word and its end, up to ORDER bytes."""
    out = []
    for word in re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower()):
        whole = b" " + word + b" "
        out += [whole[max(0, i - toxicity.ORDER + 1) : i + 1] for i in range(1, len(whole))]
    return out


def naive_ratio(texts):
    """The log-likelihood ratio of an n-gram (byte string), straight from the definition."""
    own = [Counter(g for t, y in texts if y == c for g in spelled(t)) for c in (0, 1)]
    kinds = set(own[0]) | set(own[1])
    pad = lambda g: g.rjust(toxicity.ORDER, b"\0")
    levels = {toxicity.ORDER: {pad(g): own[0][g] + own[1][g] for g in kinds}}
    for size in range(toxicity.ORDER - 1, 0, -1):
        levels[size] = dict(Counter(g[1:] for g in levels[size + 1]))

    def shared(g):
        if not g:
            return 1 / 256
        level = levels[len(g)]
        follow = {h: n for h, n in level.items() if h[:-1] == g[:-1]}
        return (max(level[g] - 0.75, 0) + 0.75 * len(follow) * shared(g[1:])) / sum(follow.values())

    def ratio(g):
        g, p = pad(g), []
        for c in (1, 0):
            follow = {h: n for h, n in ((pad(k), own[c][k]) for k in kinds) if h[:-1] == g[:-1] and n}
            total, rest = sum(follow.values()) + 5, 0.75 * len(follow) + 5
            p.append((rest / total,) if g not in levels[toxicity.ORDER] else ((max(follow.get(g, 0) - 0.75, 0) + rest * shared(g)) / total,))
        return np.log(p[0][0] / p[1][0])

    return ratio


def test_toxicity_ratios_and_scores_equal_the_definition(spark):
    rng = random.Random(31)
    stems = ["stone", "river", "cloud", "meadow", "vile", "rotten", "Éclat", "x1"]
    texts = [(" ".join(rng.choice(stems[: 4 if y == 0 else 8]) + rng.choice(["", "s", "ed", "ing"]) for _ in range(rng.randint(3, 25))), y) for y in (0, 1) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "id long, text string, y int")
    labels = rows.select("id", F.col("y").alias("label"))
    model = toxicity.fit(rows.select("id", "text"), labels)
    tables, (mean, spread, b) = model
    fold = {r.id for r in labels.where(F.pmod(F.xxhash64("id", F.lit(77)), F.lit(5)) != 0).collect()}
    ratio = naive_ratio([t for i, t in enumerate(texts) if i in fold])
    new = ["rottenest river", "", "?!", "stone zebra", "VILEED Éclats x1"]
    got = {r.text: r.score for r in toxicity.score_toxicity(spark.createDataFrame([(t,) for t in new] + [(t,) for t, _ in texts[::17]], "text string"), model).collect()}
    for text, score in got.items():
        words = [sum(ratio(g) for g in spelled(w)) for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
        x = [sum(words) / max(1, len(words))] + [np.sqrt(sum(max(w - e, 0) for w in words) / max(1, len(words))) for e in toxicity.EVIDENCE]
        assert abs(score - 1 / (1 + np.exp(-np.clip(b[0] + ((np.array(x) - mean) / spread) @ b[1:], -30, 30)))) < 1e-4


# ------------------------------------------------------------------ the network, straight from its definition
def naive_windows(model, text):
    """Shifted maxima of each filter over each window of a text's bytes, cut at zero."""
    raw = (text or "").encode()
    padded = raw + bytes(bytecnn.WINDOW + bytecnn.AHEAD)
    out = []
    for start in range(0, max(1, len(raw)), bytecnn.WINDOW):
        best = []
        for w, table in model.tables.items():
            responses = [sum(table[j][padded[t + j]] for j in range(w)) for t in range(start, start + bytecnn.WINDOW)]
            best.append(np.max(responses, axis=0))
        out.append(np.maximum(np.concatenate(best) + model.shift, 0))
    return out


NETWORK_TEXTS = ["", "short", "naïve 中文 " * 60, "x" * 256, "y" * 257, "".join(random.Random(3).choices("abc de", k=1300))]


def test_quality_scores_equal_a_naive_network(spark):
    model = bytecnn.ByteCNN(2, seed=4)
    df = spark.createDataFrame([(t,) for t in [None, *NETWORK_TEXTS]], "text string")
    for r in quality.score_quality(df, model).collect():
        windows = naive_windows(model, r.text)
        chunks = [np.maximum(a, b) for a, b in zip(windows, [*windows[1:], windows[-1]])]
        z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ model.linear + model.bias
        assert abs(r.score - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-4 and r.predicted == (r.score >= 0.3)


def test_language_scores_equal_a_naive_network(spark):
    model = bytecnn.ByteCNN(3, seed=5)
    df = spark.createDataFrame([(t,) for t in NETWORK_TEXTS[1:]], "text string")
    for r in langid.identify_languages(df, (["aa", "bb", "cc"], model)).collect():
        raw, total = r.text.encode(), 0
        for k, f in enumerate(naive_windows(model, r.text)):
            z = np.concatenate([f, f]) @ model.linear + model.bias
            total = total + np.exp(z) / np.exp(z).sum() * len(raw[256 * k : 256 * k + 256])
        p = total / len(raw)
        assert abs(r.score - p.max()) < 1e-4 and r.lang_pred == ["aa", "bb", "cc"][p.argmax()]


def test_gradients_of_chunked_windows_equal_differences():
    rng = np.random.default_rng(6)
    model = bytecnn.ByteCNN(2, seed=8)
    model.tables = {w: t.astype(np.float64) for w, t in model.tables.items()}
    model.linear = rng.standard_normal(model.linear.shape)
    data = rng.integers(97, 123, 1500).astype(np.uint8)
    offsets = np.array([0, 200, 900, 1500])
    windows, doc = bytecnn.windows_of(data, offsets)
    y, weights = np.array([0, 1, 1]), np.array([1.0, 2.0, 1.0])

    def loss():
        p = model.probabilities(bytecnn.text_features(model, model.pairs(), data, offsets, 2))
        return -(weights / weights.sum() * np.log(p[np.arange(3), y])).sum()

    gradients = model._gradients(windows, doc, y, weights, 2)
    for k, w in enumerate(bytecnn.WIDTHS):
        at = np.argsort(-np.abs(gradients[k]).ravel())[[0, 5, 20]]
        for i in at:
            place = np.unravel_index(i, gradients[k].shape)
            kept, step = model.tables[w][place], 2e-3
            model.tables[w][place] = kept + step
            up = loss()
            model.tables[w][place] = kept - step
            down = loss()
            model.tables[w][place] = kept
            assert abs((up - down) / (2 * step) - gradients[k][place]) < 0.05 * abs(gradients[k][place]) + 2e-3


def test_training_samples_of_repeated_ids_stay_bounded(spark):
    texts = spark.range(2000).select(F.lit(7).cast("long").alias("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    chosen, counts = training.sampled(texts.select("id", F.lit("a").alias("label")), 600)
    windows, doc, labels = training.training_windows(texts, chosen, 3)
    again = training.training_windows(texts.repartition(7), chosen, 3)
    assert counts == {"a": 1} and labels == ["a"] and len(windows) == 1 and np.array_equal(windows, again[0])


def test_null_and_repeated_ids_are_judged(spark, tmp_path):
    rows = [(None, "the river runs", "en"), (None, None, None), *[(4, f"der fluss {i}", "de") for i in range(9)], *[(i, "the river", "en") for i in range(10, 30)]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, 1, 1), *[(i, i % 2, i % 3 % 2) for i in range(4, 30)] * 2], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for query in (langid.op1_langid, quality.op6_quality, toxicity.op7_toxicity):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == len(rows) and all(r.held_out is not None and 0 <= r.score <= 1 for r in got)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="local-cluster[3,2,1024]", applicationId="a"))
    with pytest.raises(RuntimeError):
        common.scratch_dir(session)


def test_benchmarks_in_blocks_of_bounded_size_and_long_items(spark):
    rng = random.Random(41)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 8, 40, 400])))) for i in range(60)] + [(None, "null item words that no one else has here at all")]
    texts = []
    for _ in range(120):
        words = [word() for _ in range(rng.randint(0, 30))]
        passage = rng.choice(items)[1].split()
        at = rng.randrange(len(passage) + 1)
        texts.append(" ".join(words + passage[at : at + rng.randint(0, 20)] + words[:3]))
    texts.append("x null item words that no one else has here at all y")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontaminate.decontaminate(df, benchmark, clean=True).collect())
    assert whole == sorted(decontaminate.decontaminate(df, benchmark, clean=True, block_bytes=700).collect())
    assert [r.n_hit for r in whole if r.doc_id == 120] == [11] and [r.n_items for r in whole if r.doc_id == 120] == [0]
    assert sum(r.n_hit > 0 for r in whole) > 30


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the supplied tables are not here")
def test_decontamination_equals_its_sql(spark):
    duck, data = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{data}/{t}.parquet").coalesce(1).createOrReplaceTempView(f"sql_{t}")
        duck.register(t, spark.table(f"sql_{t}").toArrow())
    want = duck.execute(decontaminate.OP10_SQL)
    columns = [c[0] for c in want.description]
    got = decontaminate.op10_decontaminate(spark, data).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and any(r.n_hit for r in got)


def test_word_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"foo bar foo", np.uint8)
    starts, ends = bytetext.runs(bytetext.ALNUM[data], np.array([0, 11]))
    h = bytetext.word_hashes(data, starts, ends)
    assert h[0] == h[2] != h[1]


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(1)
    vocabulary = [f"word{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=40)), "en", f"s{i % 3}") for i in range(90)]
    rows += [(100, rows[0][1], "en", "s0"), (101, None, "en", "s1"), (102, "...", "en", None)]
    passage = " ".join(f"secret{i}" for i in range(12))
    other = " ".join(f"hidden{i}" for i in range(12))
    rows += [(103, f"{rows[1][1][:50]} {passage} {rows[2][1][:60]}", "en", "s1"), (104, f"{passage} and {other} {rows[3][1][:70]}", "en", "s2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, passage), (1, other)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{i}"))
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    everything = {r[0] for r in rows}
    assert everything - ids[0] == {101, 102}
    assert ids[0] - ids[1] == {100}
    assert ids[1] - ids[2] == {104}
    assert docs.where(F.col("text").contains("secret5")).count() == 0
    assert docs.where("shard is null or slot is null").count() == 0
    words = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    kept = spark.read.parquet(str(tmp_path / "stage2"))
    sizes = {r.source: r.n for r in kept.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    total = sum(sizes.values())
    assert abs(words["s2"] - total / 2) <= 2 and abs(words["s0"] - total / 6) <= 2
    assert pipeline.run(spark, str(tmp_path)).count() == docs.count()
