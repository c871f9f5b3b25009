"""SimHash, lines, embeddings and components against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidalframe.llm import embeddings, lines, simhash
from tidalframe.llm.components import components


def united(n, pairs):
    up = list(range(n))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(a) for a in range(n)]


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def texts():
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(300)]
    out = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(60)]
    for i in range(40):  # chains of near copies
        words = out[i % 7].split() if i < 35 else out[-1].split()
        words[rng.randrange(len(words))] = "Changed"
        out.append(" ".join(words))
    return out + [None, "", " \n", "É Ünï", "a b\tc", "A B C", "x" * 100_000, "long " * 30_000, out[0], out[0]]


def test_components_equal_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i + 10, t, "clash") for i, t in enumerate(rows)], "doc_id long, text string, component_id string")
    got = {r.doc_id - 10: (r.fingerprint, r.component_id - 10) for r in simhash.near_duplicates(df).collect()}
    prints = [slow_fingerprint(t) for t in rows]
    roots = united(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert got == {i: (f"{p:016x}", r) for i, (p, r) in enumerate(zip(prints, roots))}


@pytest.mark.parametrize("plan", simhash.PLANS)
def test_every_plan_finds_the_same_components(spark, plan):
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(12)]
    for _ in range(150):
        x = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << b
        prints.append(x)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame(list(enumerate(signed)), "rep long, fp long")
    found = simhash.links(nodes, plan).distinct().collect()
    assert all((prints[r.a] ^ prints[r.b]).bit_count() <= 4 for r in found)
    want = united(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert united(len(prints), [(r.a, r.b) for r in found]) == want


def test_a_dense_ball_makes_few_links(spark):
    rng = random.Random(2)
    base, prints = rng.getrandbits(62), set()
    while len(prints) < 400:
        x = base
        for b in rng.sample(range(64), 2):
            x ^= 1 << b
        prints.add(x - (1 << 64) if x >> 63 else x)
    found = simhash.links(spark.createDataFrame(list(enumerate(sorted(prints))), "rep long, fp long"), (2, 2)).distinct().count()
    assert found < 400 * 40  # all pairs would be 79,800


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(5, "one two three four five"), (5, "one two three four five"), (None, "one two three four five"), (3, "other words are here now")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(twice).orderBy("component_id").collect()] == [3, 5, 5, 5]
    assert sorted(r.doc_id for r in simhash.one_of_each(twice).collect()) == [3, 5]


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ lines
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    pool = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 14))) for _ in range(25)]
    for _ in range(40):
        words = rng.choice(pool).split()
        words[rng.randrange(len(words))] += rng.choice(["", "s", "x"])
        pool.append(" ".join(words))
    docs = [(i, "\n".join(rng.choice(pool).upper() if rng.random() < 0.2 else rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    docs += [(90, None), (91, ""), (92, "\n\n"), (93, "  alpha   beta  "), (94, "ALPHA BETA\nalpha beta"), (95, "w " * 1000 + "\n" + "w " * 1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, set(r.dropped)) for r in lines.duplicate_lines(df).collect()}
    where = {}
    for d, t in docs:
        for i, raw in enumerate([] if t is None else t.split("\n")):
            line = re.sub(r"\s+", " ", raw.lower()).strip(" ")
            if line:
                where.setdefault(line, []).append((d, i))
    keys = list(where)
    shared = {r.k: set(r.s) for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", lines.line_keys(F.col("k")).alias("s")).collect()}
    pairs = [(a, b) for a, b in line_pairs(keys) if shared[keys[a]] & shared[keys[b]]]
    groups = {}
    for k, r in zip(keys, united(len(keys), pairs)):
        groups.setdefault(r, []).extend(where[k])
    want = {d: (0 if t is None else t.count("\n") + 1, set()) for d, t in docs}
    for places in groups.values():
        for d, i in sorted(places)[1:]:
            want[d][1].add(i)
    assert got == want and pairs
    clean = {r.doc_id: r.text for r in lines.without_duplicate_lines(df).collect()}
    for d, t in docs:
        assert clean[d] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d][1]))


def test_long_lines_are_compared_as_whole_ones(spark):
    rng = random.Random(12)
    base = "".join(rng.choices("abcde ", k=700))
    pairs = [(base, base[1:]), (base, "zz" + base), (base, base[350:] + base[:350]), (base, "".join(rng.choices("abcde ", k=700))), (base, base[:500]), (base, base[150:])]
    for keep in (0.9, 0.82, 0.79):
        pairs.append((base, "".join(c if rng.random() < keep else "z" for c in base)))
    df = spark.createDataFrame(pairs, "x string, y string")
    for r in df.select("x", "y", lines._similar(F.col("x"), F.col("y")).alias("s")).collect():
        assert r.s == (distance(r.x, r.y) <= 0.2 * max(len(r.x), len(r.y)) + 1e-9)


def test_no_lines(spark):
    assert lines.duplicate_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------------ embeddings
def vectors():
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 16))
    x = [c + rng.standard_normal(16) * s for c in centres for s in (0.05, 0.1, 0.2, 0.3, 0.4) for _ in range(8)]
    x += list(rng.standard_normal((60, 16)))
    x += [x[0]] * 5 + [x[1] * 3.0, -x[2], x[3] * 1e-160]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    return rows + [(1000 + i, v) for i, v in enumerate(odd)]


def check_vectors(spark, rows):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    good = [(i, np.array(v)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.array([v / np.abs(v).max() for _, v in good])
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    roots = united(len(good), list(zip(*np.nonzero(near))))
    want = {i: (0, i, True) for i, _ in rows}
    for k, (i, _) in enumerate(good):
        want[i] = (int(near[k].sum()), good[roots[k]][0], good[roots[k]][0] == i)
    assert got == want


def test_embeddings_equal_brute_force(spark):
    check_vectors(spark, vectors())


def test_embeddings_over_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 20)
    monkeypatch.setattr(embeddings, "SIDE", 15)
    check_vectors(spark, vectors())


def test_pivots_follow_the_structure(spark):
    rng = np.random.default_rng(9)
    spread = rng.standard_normal((600, 64))
    close = np.repeat(rng.standard_normal((60, 64)), 10, axis=0) + 0.02 * spread
    counts = []
    for x in (spread, close):
        rows = [(bytes(rng.bytes(16)), v.tobytes()) for v in x]
        points, apart = embeddings._pivots(spark.createDataFrame(rows, "key binary, raw binary"), 6_000_000, float(np.sqrt(0.2)))[64 * 8]
        assert apart.shape == (len(points), len(points))
        counts.append(len(points))
    small = embeddings._pivots(spark.createDataFrame(rows, "key binary, raw binary"), 600, float(np.sqrt(0.2)))[64 * 8]
    assert len(small[0]) >= embeddings.MIN_PIVOTS > 1 and counts[1] >= counts[0] > 1


def test_embeddings_of_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.01]), (None, [0.0, 0.0, 1.0]), (5, [0.0, 0.01, 1.0]), (None, None), (7, [0.0, 0.0, -1.0]), (None, [-1.0, -1.0, -1.0])]
    df = spark.createDataFrame([(i, v, "clash", 9) for i, v in rows], "vec_id long, embedding array<double>, kept string, node int")
    got = sorted(map(str, [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()]))
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (None, 1, 5, None), (5, 1, 5, True), (None, 0, None, None), (7, 0, 7, True), (None, 0, None, None)]
    assert got == sorted(map(str, want))


def test_no_embeddings(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ------------------------------------------------------------------ lines by edit similarity alone
def edited(rng, line, share):
    """``line`` with up to ``share`` of its characters replaced, taken out or doubled at random places."""
    out = list(line)
    for i in rng.sample(range(len(out)), int(share * len(out))):
        out[i] = rng.choice([rng.choice("aeinrst"), "", out[i] * 2])
    return " ".join("".join(out).split())


def reworded(rng, line, share, word):
    """``line`` with up to ``share`` of its words replaced, taken out or followed by a new one."""
    out = line.split(" ")
    for i in rng.sample(range(len(out)), int(share * len(out))):
        out[i] = rng.choice([word(), "", out[i] + " " + word()])
    return " ".join(" ".join(out).split())


def line_pairs(keys):
    near = lambda a, b: abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
    return [(a, b) for a in range(len(keys)) for b in range(a) if near(keys[a], keys[b])]


def made_lines(rng):
    letters = "etaoinshrdlucmfwypvbgk"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(2, 8)))
    return word, [" ".join(word() for _ in range(n)) for n in (1, 1, 1, 2, 2, 2, 3, 3, 4, 5, 6, 8, 10, 12, 14, 16, 20, 24, 28, 32, 48, 70) * 2]


def test_op8_finds_most_near_copies_by_edit_similarity_alone(spark, tmp_path):
    rng = random.Random(21)
    word, keys = made_lines(rng)
    keys += [reworded(rng, k, share, word) for k in list(keys) for share in (0.05, 0.1, 0.15)] + [edited(rng, k, 0.03) for k in keys]
    keys = sorted({k for k in keys if k})
    pairs = line_pairs(keys)
    spark.createDataFrame(list(enumerate(keys)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    gone = {r.doc_id for r in lines.op8_lines(spark, str(tmp_path)).collect() if r.n_dropped}
    roots = united(len(keys), pairs)
    # Nothing goes that no pair connects; of what should go, nearly all does.
    want = {i for i, r in enumerate(roots) if i != r}
    assert gone <= want and len(gone) >= 0.9 * len(want) and len(want) > 70


def test_keys_of_lines_miss_no_short_line(spark):
    rng = random.Random(22)
    keys = sorted({"".join(rng.choices("ab c", k=rng.randint(1, 14))).strip() or "a" for _ in range(250)})
    df = spark.createDataFrame(list(enumerate(keys)), "i long, line string")
    held = {r.i: set(r.k) for r in df.select("i", lines.line_keys(F.col("line")).alias("k")).collect()}
    pairs = line_pairs(keys)
    assert pairs and all(held[a] & held[b] for a, b in pairs)


def test_lines_with_fewer_changed_words_than_blocks_share_one(spark):
    rng = random.Random(23)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=9))
    rows = []
    for n in (64, 100, 200, 400):  # a changed word spoils the block it leaves and the one it comes to
        for _ in range(8):
            base = [word() for _ in range(n)]
            other = list(base)
            blocks = 2 ** int(np.log2(n / lines.BLOCK_FEATURES))
            for i in rng.sample(range(n), blocks // 8):
                other[i] = word()
            rows.append((len(rows), " ".join(base), " ".join(other)))
    df = spark.createDataFrame(rows, "i long, x string, y string")
    keys = df.select(F.size(F.array_intersect(lines.line_keys(F.col("x")), lines.line_keys(F.col("y")))).alias("n")).collect()
    assert all(r.n for r in keys)


def test_a_way_to_edit_is_never_shorter_than_the_distance(spark):
    rng = random.Random(24)
    word, base = made_lines(rng)
    pairs = [(k, reworded(rng, k, rng.choice([0, 0.1, 0.3, 1]), word)) for k in base for _ in range(4)]
    pairs += [(a, b) for a, b in zip(base, reversed(base))] + [("a", ""), ("", "a b"), ("a b c", "c a b"), ("x x x", "x")]
    df = spark.createDataFrame(pairs, "x string, y string").select("x", "y", lines._script(F.col("x"), F.col("y")).alias("n"))
    assert all(r.n >= distance(r.x, r.y) for r in df.collect())


def test_lines_of_null_ids_go_too(spark):
    df = spark.createDataFrame([(None, "some words here\nother things there"), (7, "other things there\nsome words here\nits own line")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.dropped) for r in lines.duplicate_lines(df).collect()}
    assert got == {None: (2, 0, []), 7: (3, 2, [0, 1])}
    df = df.union(spark.createDataFrame([(None, "a third line\n\na third line")], df.schema))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.dropped) for r in lines.duplicate_lines(df).collect()}
    assert got[None] == (5, 1, [2])
    clean = sorted(r.text for r in lines.without_duplicate_lines(df.where("doc_id is null and text like 'a%'")).collect())
    assert clean == ["a third line\n"]


def test_lines_that_collide_in_one_hash_stay_apart(spark):
    one = r"[]n{#*r{zk1[`:?s%rh@4\_e`(.!-5}g16v=3s2<w6.`?9815%_&1[2$l[g4ei`;"
    two = r"2:=>.pc-zk1[`:?s%rh@4\_e`(.!-5}g71ydds5pw6.`?9815%_&1[2$l[g4ei`;"
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert df.select(F.xxhash64("text")).distinct().count() == 1 and distance(one, two) > 0.2 * len(one)
    assert [r.n_dropped for r in lines.duplicate_lines(df).collect()] == [0, 0]


def test_one_of_each_goes_by_text_not_by_id(spark):
    words = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"}
    rows = [(None, words["a"]), (None, words["b"]), (1, words["c"]), (1, words["d"]), (2, words["d"]), (3, words["e"]), (None, words["e"]), (3, words["f"]), (3, words["f"]), (4, None), (5, "")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.columns == ["doc_id", "text"]
    want = [(None, "a"), (None, "b"), (1, "c"), (1, "d"), (3, "e"), (3, "f")]
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([(i, words[c]) for i, c in want] + [(4, None)], kept.schema).collect()))


def _duck(sql, **tables):
    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    return {tuple(r) for r in con.execute(sql).fetchall()}


def test_simhash_equals_its_sql(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgé") for _ in range(n)) for n in (1, 2, 3, 5, 8, 13, 34, 70)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 5, 9, 40, 300)]
    texts += [texts[7] + " end", texts[7].upper(), texts[6], texts[6] + "\n", "", None, " \t\r", "UND", "und", "x\x0by"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in simhash.near_duplicates(df).collect()}
    assert got == _duck(simhash.OP3_SQL, documents=("doc_id BIGINT, text VARCHAR", rows))


def test_embeddings_equal_their_sql(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] + rng.standard_normal(8) * (0.1 + 0.1 * (i % 5))).tolist()) for i in range(90)]
    rows += [(90, None), (91, [0.0] * 8), (92, [float("nan")] + [1.0] * 7), (93, [float("inf")] * 8), (94, [None] + [1.0] * 7), (95, rows[3][1]), (96, rows[3][1]), (97, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in embeddings.near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()}
    assert got == _duck(embeddings.OP4_SQL, embeddings=("vec_id BIGINT, embedding DOUBLE[]", rows))


def test_key_rows_are_the_keys_of_lines(spark):
    rng = random.Random(25)
    word, keys = made_lines(rng)
    keys += ["a", "été", "x " * 40 + "x", " ".join(["same"] * 50), "wörter " * 3 + "ende"] + [" ".join(word() for _ in range(n)) for n in range(1, 130, 3)]
    keys += [reworded(rng, k, 0.1, word) for k in keys]
    rows = [(i, -i, k) for i, k in enumerate(keys) if k]
    df = spark.createDataFrame(rows, "h1 long, h2 long, line string")
    want = df.select("h1", F.explode(lines.line_keys(F.col("line"))).alias("key"))
    got = sorted(map(tuple, lines.key_rows(df).collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 1000


def test_different_blocks_seldom_have_the_same_votes(spark):
    # 18 million pairs: in 30 bits some 13 of them met by chance, and such pairs grew with the square of the lines.
    prints = spark.range(6000).select(lines._hashes(F.array(F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), "id"))).alias("h"))
    assert prints.select(*[v.alias(f"v{i}") for i, v in enumerate(lines._votes(F.col("h")))]).distinct().count() == 6000


def test_similarity_of_whole_lines_equals_brute_force(spark):
    rng = random.Random(26)
    word = lambda: "".join(rng.choices("etaoinshé", k=rng.randint(2, 8)))
    pairs = [("", "a"), ("a", "a"), ("abc", "")]
    for n in (3, 10, 30, 60, 120):
        for _ in range(12):
            x = " ".join(word() for _ in range(n))
            y = rng.choice([edited, lambda r, k, s: reworded(r, k, s, word)])(rng, x, rng.choice([0.1, 0.2, 0.3]))
            cut = rng.randrange(len(x))
            pairs += [(x, y), (x, " ".join(word() for _ in range(n))), (x, y[cut // 4 :]), (x, y[: len(y) - cut // 4]), (x, y[cut:] + y[:cut]), (x, word() * 3 + y), (x, x[: len(x) // 2] + y[::-1][len(x) // 2 :])]
    df = spark.createDataFrame(pairs, "x string, y string").select("x", "y", lines._similar(F.col("x"), F.col("y")).alias("s"))
    got = df.collect()
    assert all(r.s == (distance(r.x, r.y) <= 0.2 * max(len(r.x), len(r.y)) + 1e-9) for r in got)
    assert 50 < sum(r.s for r in got) < len(got) - 50


def test_only_one_text_of_a_compared_pair_moves(spark, monkeypatch):
    rng = random.Random(17)
    rows = [(i, (i, 0), " ".join(rng.choices(["stone", "river", "cloud"], k=4))) for i in range(40)]
    texts = spark.createDataFrame(rows, "h1 long, node struct<id long, pos int>, line string")
    pairs = [(a, b) for a in range(40) for b in range(a)]
    plans = []
    monkeypatch.setattr(lines, "written", lambda df, _: plans.append(df) or df)
    got = lines._verified(spark.createDataFrame(pairs, "x long, y long"), texts).collect()
    most = {(a, b): max(len(rows[a][2]), len(rows[b][2])) for a, b in pairs}
    close = {p for p in pairs if 5 * abs(len(rows[p[0]][2]) - len(rows[p[1]][2])) <= most[p]}
    assert {(r.a.id, r.b.id) for r in got} == close and len(got) == len(close)
    assert all(r.good == (5 * distance(rows[r.a.id][2], rows[r.b.id][2]) <= most[r.a.id, r.b.id]) for r in got[::9])
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    moves = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plans[0]._jdf.queryExecution().explainString(mode))
    assert moves and not any("__x" in m and "__y" in m for m in moves)


def test_copies_of_a_leader_meet_strangers_of_their_bucket_as_one(spark, monkeypatch):
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=6))
    shared = [word() for _ in range(5)]
    bases = [" ".join(shared + [word() for _ in range(20)]) for _ in range(6)]
    # Two of them are further apart than similar lines are, some of their copies aren't.
    bases.append(edited(rng, bases[0], 0.25))
    rows = [edited(rng, b, rng.choice([0.02, 0.05, 0.12])) for b in bases for _ in range(6)] + bases + [bases[1][:90], bases[2] + " " + word() * 12]
    rows = sorted(set(rows))
    near = set(line_pairs(rows))
    leaders = {b: rows.index(b) for b in bases}
    group = {i: min((leaders[b] for b in bases if i == leaders[b] or (max(i, leaders[b]), min(i, leaders[b])) in near), default=i) for i in range(len(rows))}
    node = "struct<id long, pos int>"
    texts = spark.createDataFrame([(i, (i, 0), r, len(r)) for i, r in enumerate(rows)], f"h1 long, node {node}, line string, n int")
    keyed = [(key, i, 0, (group[i], 0), (group[i], 0), len(rows[i]), len(rows[i])) for key in (7, 8) for i in range(len(rows))]
    keyed = spark.createDataFrame(keyed, f"key int, h1 long, first long, low {node}, high {node}, short int, long int")
    links = spark.createDataFrame([(i, g, distance(rows[i], rows[g])) for i, g in group.items() if i != g], "x long, y long, edits int")
    got = [(r.x, r.y) for r in lines._across(keyed, links, texts).collect()]
    across = {(a, b) for a in range(len(rows)) for b in range(a) if group[a] != group[b]}
    assert len(got) == len(set(got)) and across & near <= set(got) <= across and across & near
    assert len(got) < len(across) / 3

    # The whole operator, with one leader a bucket: what is similar and shares a key meets.
    monkeypatch.setattr(lines, "LEADERS", 1)
    texts = [r for r in rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [set(r.k) for r in df.orderBy("doc_id").select(lines.line_keys(F.col("text")).alias("k")).collect()]
    roots = united(len(texts), [(a, b) for a, b in near if held[a] & held[b]])
    assert {r.doc_id for r in lines.duplicate_lines(df).collect() if r.n_dropped} == {i for i, r in enumerate(roots) if i != r}
