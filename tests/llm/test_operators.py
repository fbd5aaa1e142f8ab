"""Each corpus operator against a brute-force version, and over odd rows."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, components, langid, minhash, mixing, quality, rules, sampling, substring, tokenfile, url_sql, urls, wordhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id long, key string, size long"
RANKS, PATTERN, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")


def prose(n, seed, vocabulary=300):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "on", "an", "é", "ß", "ing"]) for _ in range(rng.randrange(1, 4))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


def texts():
    """Null, empty, blank, tiny, long, copies, near copies, shared passages, odd characters."""
    base, passage = prose(120, 1), prose(70, 2)
    words = base.split()
    near = [" ".join(words[:i] + ["xx"] + words[i + 1 :]) for i in (5, 40, 90)]
    far = " ".join(w if i % 3 else f"w{i}" for i, w in enumerate(words))
    out = [None, "", " \n\t ", "one", "one", "One two", "ONE  two\n", base, base, base.upper().replace("É", "é"), *near, far]
    out += [prose(30, 3) + " " + passage + " " + prose(30, 4), passage, prose(10, 5) + "\n" + passage, passage + " tail", prose(3000, 6), "a " * 200, "\x1c sep \x0b here nbsp 　wide", "<|endoftext|> it's  two   spaces ", "x" * 5000, "🙂 " * 60]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}", None if t is None else len(t), True, 5, "k", 9) for i, t in enumerate(texts())]
    rows += [rows[7], rows[8], (None, texts()[7], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def data(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def split(text):
    return (text or "").encode().split()


def test_words_and_hashes_equal_a_plain_split():
    some = [t for t in texts()]
    column = pa.array(some)
    for own in (column, column.slice(3, 9), column.cast(pa.large_string())):
        words = wordhash.Words(own)
        assert words.counts().tolist() == [len(split(t)) for t in own.to_pylist()]
        flat = [w for t in own.to_pylist() for w in split(t)]
        assert [bytes(words.data[a:b]) for a, b in zip(words.starts, words.ends, strict=True)] == flat
        h = words.hashes()
        assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
        low = words.hashes(lower=True)
        assert len({(w.lower(), x) for w, x in zip(flat, low.tolist(), strict=True)}) == len({w.lower() for w in flat})


def test_hashes_do_not_depend_on_chunks(monkeypatch):
    h = wordhash.Words(pa.array([prose(500, 8)])).hashes()
    w = wordhash.windows(h, 50)
    monkeypatch.setattr(wordhash, "CHUNK", 60)
    again = wordhash.Words(pa.array([prose(500, 8)])).hashes()
    assert (h == again).all() and (w == wordhash.windows(h, 50)).all()


def thue(n=10):
    """Two words of 2**n letters that a polynomial hash modulo 2**64 can't tell apart."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_of_one_pattern_have_different_hashes():
    some = [*thue(3), *thue(10), *("x" * i + "y" + "x" * (70 - i) for i in range(70)), *("z" * n for n in range(1, 90))]
    assert len(set(wordhash.Words(pa.array([" ".join(some)])).hashes().tolist())) == len(some)
    h = wordhash.Words(pa.array([prose(400, 3)])).hashes()
    for k in (1, 2, 7, 50, 64):
        every = wordhash.windows(h, k)
        assert len(every) == len(h) - k + 1 and all(wordhash.windows(h[i : i + k], k)[0] == every[i] for i in (0, 5, len(every) - 1))


def test_words_of_one_pattern_do_not_link_or_repeat(spark):
    a, b = thue()
    rest = prose(60, 77, 4000).split()
    rows = [(1, " ".join(w + a for w in rest)), (2, " ".join(w + b for w in rest)), (3, " ".join([a, *rest])), (4, " ".join([b, *rest]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, minhash.Params(shingle=2)).collect()}
    assert got == brute_near(rows, 2) and got[2][1] == 2
    assert Counter(tuple(r) for r in substring.strip_repeats(df).collect()) == brute_strip(rows)


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)] + [(5000, 4000 + i) for i in range(300)] + [(5000 + i, 5000) for i in range(200)] + [(300, 301), (301, 300), (300, 300)] + [(rng.randrange(500, 560), rng.randrange(500, 560)) for _ in range(40)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(df, "a", "b").collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(len(root)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in pairs)}
    assert components.components(df.limit(0), "a", "b").count() == 0


def base_measures(text):
    t = text or ""
    w = split(t)
    lines = [x for x in t.split("\n") if split(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(spark, docs, empty):
    extra = spark.createDataFrame([(901, "a b c a b c"), (902, "x\n\nx\n x\nx "), (903, "# * $ " * 30), (904, ("the of and " + prose(20, 7) + "\n") * 4), (905, "a b a b a b a")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    want = Counter((i, *base_measures(t)) for i, t in data(every))
    out = rules.judge(every)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect()) == want
    for r in out.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and (r.base_failed or r.failed))
    assert "PythonUDF" not in out._jdf.queryExecution().toString() and rules.judge(empty).count() == 0
    assert rules.judge(docs).count() == docs.count()  # columns with clashing names


def test_token_files_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(MODEL)
    t.encode_special_tokens = True
    ids = lambda x: t.encode(x or "", add_special_tokens=False).ids + [0]
    got = sorted(tuple(r) for r in tokenfile.crc32(tokenfile.read(spark, tokenfile.write(docs, MODEL))).collect() if r.doc_id is not None)
    start = sum(len(ids(x)) for i, x in data(docs) if i is None)
    want = []
    for i, x in sorted((i, x) for i, x in data(docs) if i is not None and x is not None) + [(1, None)]:
        want.append((i, len(ids(x)), zlib.crc32(np.array(ids(x), "<u4").tobytes())))
    assert sorted((g[0], g[2], g[3]) for g in got) == sorted(want)
    for g in sorted(got, key=lambda g: g[1]):
        assert g[1] == start
        start += g[2]
    assert tokenfile.read(spark, tokenfile.write(empty, MODEL)).count() == 0


def test_control_and_data_bytes():
    some = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint64)
    for n in range(len(some) + 1):
        control, body = tokenfile.pack(some[:n])
        assert len(control) == -(-n // 4) and tokenfile.unpack(control, body, n).tolist() == some[:n].tolist()


def test_pieces_encode_as_whole_texts():
    e = tokenfile.encoder(MODEL)
    some = [t or "" for t in texts()] + ["a  b", "a \n b", " lead", "trail ", "a\n\n b", "  x", "a  b", "1st 2nd, 3.", "don't 'll"]
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.batch(pa.array(some)).to_pylist()] == [x.ids for x in e.model.encode_batch(some, add_special_tokens=False)]


def brute_near(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = split("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(docs, empty, k):
    got = minhash.near_duplicates(docs, minhash.Params(shingle=k)).collect()
    assert len(got) == docs.count()
    want = brute_near([(i, t) for i, t in data(docs) if i is not None], k)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == want
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_shared_passages_and_chains(spark):
    """Many documents share a passage, so buckets hold pairs that don't link; copies of copies drift apart."""
    rng = random.Random(11)
    passage = prose(60, 20, 4000).split()
    rows = [(i, " ".join(passage + prose(rng.randrange(2, 40), 100 + i, 4000).split())) for i in range(60)]
    chain = prose(80, 21, 4000).split()
    for i in range(25):
        rows.append((1000 + i, " ".join(chain)))
        chain[rng.randrange(80)] = f"new{i}"
        chain[rng.randrange(80)] = f"other{i}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, minhash.Params(shingle=2)).collect()}
    assert got == brute_near(rows, 2)


def test_near_duplicates_of_ids_with_several_texts(spark):
    """A copy and an own text under one id; near copies of either; two near texts under one id."""
    a, b, c = (prose(80, 40 + i, 4000) for i in range(3))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b + " end"), (4, c), (4, c + " end"), (5, c + " end")]
    df = spark.createDataFrame(rows * 3, "doc_id long, text string").repartition(4)
    got = minhash.judged_copies(df).select("doc_id", "copy", "component_id", "kept").distinct()
    seen = {(r.doc_id, r.text): (r.component_id, r.kept) for r in got.join(df.select("text", F.xxhash64("text").alias("copy")).distinct(), "copy").collect()}
    assert [seen[x] for x in rows[:5]] == [(1, True), (1, False), (2, True), (2, True), (2, False)]
    assert [seen[x][0] for x in rows[5:]] == [4, 4, 4] and sorted(seen[x][1] for x in rows[5:7]) == [False, True] and not seen[rows[7]][1]


def test_pairs_of_unlike_sizes_and_large_buckets(spark):
    """Sets inside one another: buckets hold sizes that can't be similar, and chains of those that can."""
    words = prose(400, 90, 5000).split()
    rows = [(i, " ".join(words[: 20 + 9 * i])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, minhash.Params(shingle=2)).collect()}
    assert got == brute_near(rows, 2)


def test_open_pairs_lose_nothing(spark):
    """The prefix and positional filter leaves every similar pair of different labels."""
    rng = np.random.default_rng(5)
    sets = {i: np.unique(rng.choice(60, size=rng.integers(20, 50))).astype(np.uint64) for i in range(80)}
    df = spark.createDataFrame([(i, i, bytearray(s.tobytes())) for i, s in sets.items()], "cid long, label long, items binary")
    for percent in (50, 80):
        got = {tuple(r) for r in minhash._open_pairs(df, minhash.Params(percent=percent)).collect()}
        for a, b in combinations(sets, 2):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            assert 100 * len(x & y) < percent * len(x | y) or (a, b) in got


RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def test_urls_follow_links_and_let_allow_win(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.com/x", '<link rel="canonical" href="https://b.com/en/1">', "h"), (2, "https://B.com/en/1", None, "h"), (3, "http://c.com/p/q", '<META content="0; URL=/z" HTTP-EQUIV=refresh>', "h"),
            (4, "http://c.com/z", "<link href=//b.com/en/1#f rel=canonical>", "h"), (5, None, "x", "h"), (6, "nourl", "<link rel=canonical href=http://b.com/en/1>", "h"),
            (7, "http://d.net/q", '<link rel="canonical" href="http://x.example.com/en/7a">', "h"), (8, "http://d.net/de/", '<link rel="canonical" href="http://d.net/q">', "h"), (9, "HTTP://D.NET", "", "h"), (10, "http://r.org/o", "", "h"),
            (11, "http://www.example.com/en/70?q#f", "", "h"), (12, "http://example.net/de/8", "", "h"), (13, "http://notexample.com/en/7", "", "h"), (13, "http://notexample.com/en/7", "", "h"),
            (14, "http://e.com/a/b", "<link rel='canonical' href='c?x=1&amp;y=2'>", "h"), (15, "http://e.com/a/c?x=1&y=2", "<link rel=canonical href=http://b.com/en/1>", "h"), (None, "http://b.com/en/1", None, "h"),
        ],
        "page_id long, url string, html string, host string",
    )
    more = spark.createDataFrame([("http://r.org/o", "http://a.com/x"), (None, "http://a.com/x")], "url string, target string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, RULES, more).collect()}
    assert got == {
        (1, "a.com", "/x", None, "block"), (2, "b.com", "/en/1", "com/en/", "block"), (3, "c.com", "/p/q", None, "block"), (4, "c.com", "/z", None, "block"), (5, "", "", None, "allow"), (6, "", "", None, "allow"),
        (7, "d.net", "/q", None, "allow"), (8, "d.net", "/de/", "net/de/", "block"), (9, "d.net", "", None, "allow"), (10, "r.org", "/o", None, "block"), (11, "www.example.com", "/en/70", "example.com/en/7", "allow"),
        (12, "example.net", "/de/8", "example.net/de/8", "block"), (13, "notexample.com", "/en/7", "com/en/", "block"), (14, "e.com", "/a/b", None, "block"), (15, "e.com", "/a/c", None, "block"), (None, "b.com", "/en/1", "com/en/", "block"),
    }
    own = pages.toPandas()  # the SQL knows no table of redirects
    duckdb.register("pages", own)
    want = Counter(tuple(r) for r in duckdb.sql(url_sql.sql(RULES)).fetchall())
    assert Counter(None if r.page_id is None else (r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, RULES).collect()) == Counter(None if r[0] is None or r[0] != r[0] else (int(r[0]), *r[1:]) for r in want.elements())
    assert urls.judge(pages, RULES).count() == 17 and urls.judge(pages.limit(0), RULES).count() == 0


def test_canonical_among_other_link_types(spark):
    links = ('<link rel="canonical nofollow" href="http://b.com/en/1">', "<link rel='me\nCanonical' href='http://b.com/en/1'>", '<link rel="not-canonical" href="http://b.com/en/1">', '<link rel="canonicals nofollow" href="http://b.com/en/1">')
    pages = spark.createDataFrame([(i, f"http://a{i}.com/x", tag) for i, tag in enumerate(links)], "page_id long, url string, html string")
    want = [(0, "block"), (1, "block"), (2, "allow"), (3, "allow")]
    assert sorted((r.page_id, r.verdict) for r in urls.judge(pages, RULES).collect()) == want
    duckdb.register("pages", pages.toPandas())
    assert sorted((r[0], r[4]) for r in duckdb.sql(url_sql.sql(RULES)).fetchall()) == want


def test_bpe_equals_the_library(docs, empty):
    ranks = bpe.encoding(RANKS, PATTERN)._mergeable_ranks
    e = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in data(docs):
        ids = e.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.digest(bpe.round_trip(docs, RANKS, PATTERN)).collect()) == want
    assert bpe.round_trip(empty, RANKS, PATTERN).count() == 0
    carried = bpe.round_trip(docs, RANKS, PATTERN, ("doc_id", "text", "size"))
    assert carried.columns == ["doc_id", "text", "size", "ids", "decoded"]


def test_long_texts_are_cut_where_it_is_safe():
    e = bpe.encoding(RANKS, PATTERN)
    for t in (prose(4000, 9), "a  b \n c " * 900, "x" * 9000, "don't 's " * 900, " é 1" * 2000):
        assert [i for p in bpe.parts(t, 500) for i in e.encode_ordinary(p)] == e.encode_ordinary(t)
        assert "".join(bpe.parts(t, 500)) == t


def test_runs_of_millions_of_characters(spark):
    """Each is one match of the pattern, but for the white-space character before a word."""
    e = bpe.encoding(RANKS, PATTERN)
    piece = lambda x: e._encode_single_piece(x)
    runs = {1: " " * 3_000_000, 2: "\n" * 3_000_000, 3: "a" * 3_000_000, 4: "中" * 1_000_000, 5: "one" + "\u3000" * 1_200_000 + " two", 6: " \n" * 1_500_000 + "'s"}
    want = {i: piece(runs[i]) for i in (1, 2, 3, 4)}
    want[5] = [*e.encode_ordinary("one"), *piece("\u3000" * 1_200_000), *e.encode_ordinary(" two")]
    want[6] = [*piece(runs[6][:-3]), *e.encode_ordinary("\n's")]
    rows = bpe.round_trip(spark.createDataFrame(list(runs.items()), "doc_id long, text string"), RANKS, PATTERN).collect()
    assert len(rows) == 6 and all(r.ids == want[r.doc_id] and bytes(r.decoded) == runs[r.doc_id].encode() for r in rows)


def test_long_white_space_encodes_as_the_library_does(monkeypatch):
    e = bpe.encoding(RANKS, PATTERN)
    monkeypatch.setattr(bpe, "SPLIT", 100)
    rng = random.Random(1)
    for _ in range(40):
        run = lambda: "".join(rng.choice(" \n\t\x0b\r\x85\xa0\u2003\u3000\x1c") for _ in range(rng.choice([1, 3, 5000, 9000])))
        t = "".join(run() + rng.choice(["", "word", "'s", "12", "!!", "é 中"]) for _ in range(rng.randrange(1, 6)))
        assert bpe.encode_text(e, t) == e.encode_ordinary(t)


def labelled(spark):
    rng = random.Random(2)
    rows, told = [], []
    for i in range(400):
        good = i % 4 > 0
        t = prose(rng.randrange(20, 120), i)
        rows.append((i, t if good else " ".join(w.upper() + "!!" for w in t.split()), "en", f"src{i % 3 if good else 9}", len(t)))
        if i % 3:
            told.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(told, "doc_id long, quality int, toxic int")


def test_cotraining_separates_the_classes(spark, docs, empty):
    some, told = labelled(spark)
    model = quality.train(some, told, quality.Params(labelled=200, pool=200, handed=20))
    wrong = sum(r.kept != (r.doc_id % 4 > 0) for r in quality.score(some, model).collect())
    assert wrong <= 8
    odd = quality.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.train(some, told.limit(0)) is None and quality.train(empty, told.limit(0)) is None
    assert all(r.kept for r in quality.score(docs, None).collect()) and quality.score(empty, model).count() == 0
    assert quality.score(some, model).columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_round_hands_over_new_rows(monkeypatch):
    """A pool of sure rows: as many of each class in every round, while there are some."""
    rng = np.random.default_rng(3)
    y = (rng.random(600) > 0.5).astype(float)
    t, m = rng.normal(size=(600, 3)) + y[:, None] * 8, rng.normal(size=(600, 2)) + y[:, None] * 8
    plain, sizes = quality.logistic, []
    monkeypatch.setattr(quality, "logistic", lambda x, y, *a, **b: sizes.append((x.shape[1], len(y))) or plain(x, y, *a, **b))
    quality.fit(t[:100], m[:100], y[:100], t[100:], m[100:], quality.Params(handed=30, sure=0.8))
    assert [n for d, n in sizes if d == 3] == [80, 140, 200, 260]


def two_views(n, rng):
    """Metadata tells the classes of all rows apart; text does so by one feature in rows of kind 0, by another in those of kind 1."""
    y = (np.arange(n) % 2).astype(float)
    kind = np.arange(n) // 2 % 2
    t, m = rng.normal(size=(n, 4)), rng.normal(size=(n, 3))
    side = 2 * y - 1
    t[:, 0] += 6 * side * (kind == 0)
    t[:, 1] += 6 * side * (kind == 1)
    m[:, 0] += 6 * side
    return t, m, y, kind


def test_views_teach_each_other():
    """No labelled row shows the text feature of the second kind: the text view learns it from the metadata view's labels alone."""
    rng = np.random.default_rng(1)
    t, m, y, kind = two_views(1200, rng)
    told = np.flatnonzero(kind == 0)[:200]
    rest = np.setdiff1d(np.arange(len(y)), told)
    held = rest[kind[rest] == 1][-150:]
    pool = np.setdiff1d(rest, held)
    right = {}
    for rounds in (0, 3):
        model = quality.fit(t[told], m[told], y[told], t[pool], m[pool], quality.Params(handed=60, rounds=rounds, sure=0.9))
        text, _, both = model.score(t[held], m[held])
        right[rounds] = ((text > 0.5) == y[held]).mean()
        assert ((both > 0.5) == y[held]).mean() > 0.9
    assert right[0] < 0.75 and right[3] > 0.95


def test_scores_equal_the_plain_formula(spark):
    """Held-out rows: each score from the views' features by hand, and the share that is right."""
    some, told = labelled(spark)
    held = F.col("doc_id") % 7 == 0
    model = quality.train(some.where(~held), told.where(~held), quality.Params(labelled=200, pool=100, handed=20))
    rows = {r.doc_id: r for r in some.where(held).collect()}
    got = quality.score(some.where(held), model).collect()
    sig = lambda z: 1 / (1 + np.exp(-z))
    for r in got:
        own = rows[r.doc_id]
        batch = pa.RecordBatch.from_pydict({"source": [own.source], "lang": [own.lang], "n_chars": [own.n_chars]})
        t, m = quality.text_view(pa.array([own.text]))[0], quality.meta_view(batch)[0]
        odds = []
        for x, w, scale in ((t, model.text, model.scale[0]), (m, model.meta, model.scale[1])):
            odds.append(np.clip((float(x @ w[:-1]) + w[-1]) * scale[0] + scale[1], -12, 12))
        want = sig(odds[0] * model.both[0] + odds[1] * model.both[1] + model.both[2])
        assert abs(r.text_score - sig(odds[0])) < 1e-5 and abs(r.meta_score - sig(odds[1])) < 1e-5 and abs(r.score - want) < 1e-5 and r.kept == (r.score >= 0.3)
    assert sum(r.kept == (r.doc_id % 4 > 0) for r in got) >= 0.95 * len(got)


def test_samples_of_repeated_ids_are_bounded(spark):
    """Ids repeated very often count once, and a table of one id still gives it."""
    df = spark.range(3000).selectExpr("id AS doc_id").union(spark.range(2000).selectExpr("7L AS doc_id"))
    got = [r.doc_id for r in sampling.ids(df, 50).collect()]
    assert len(got) == len(set(got)) == 50 and sampling.ids(df.where("doc_id = 7"), 50).count() == 1 and sampling.ids(df.limit(0), 5).count() == 0
    again = [r.doc_id for r in sampling.ids(df.repartition(5), 50).collect()]
    assert sorted(got) == sorted(again)
    some, told = labelled(spark)
    many = some.union(some.where("doc_id IN (1, 2)").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(200)))).drop("n"))
    one, two = (quality.train(d, told, quality.Params(labelled=100, pool=50)) for d in (some, many))
    assert np.allclose(one.text, two.text) and np.allclose(one.both, two.both)
    df = spark.createDataFrame([(i, "abc " * 30 if i % 2 else "xyz " * 30, "ab"[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    one, two = (langid.train(d, F.lit(True), langid.Params(docs=10, epochs=1)) for d in (df, df.union(df).union(df)))
    assert np.allclose(one.dense, two.dense)


def test_language_of_whole_texts(spark, docs, empty):
    alphabets = {"aa": "abcde", "bb": "vwxyz", "cc": "éßñöü"}
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice(alphabets[k]) for _ in range(5)) for _ in range(rng.randrange(1, 60))), k) for i, k in enumerate(list(alphabets) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.col("doc_id") % 5 != 0, langid.Params(docs=60, epochs=6))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    held = [(i, k) for i, _, k in rows if i % 5 == 0]
    assert sum(got[i].lang_pred == k for i, k in held) >= 0.95 * len(held)
    odd = {r.doc_id: r for r in langid.predict(docs, model).collect() if r.doc_id is not None}
    for i, t in data(docs):
        if i is not None:
            assert (odd[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= odd[i].score <= 1
    assert langid.train(df, F.lit(False)) is None and langid.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}


def test_language_is_learned_from_whole_texts(spark):
    """Long texts that differ only after 66,000 characters."""
    rng = random.Random(4)
    tail = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    letters = {"a": "bcdfg ", "b": "mnpqr "}
    df = spark.createDataFrame([(i, "same " * 13200 + tail(letters[k], 66000), k) for i, k in enumerate("ab" * 15)], "doc_id long, text string, lang string")
    model = langid.train(df, F.lit(True), langid.Params(epochs=10))
    new = spark.createDataFrame([(i, tail(letters[k], 1000)) for i, k in enumerate("ab" * 10)], "doc_id long, text string")
    assert sorted((r.doc_id, r.lang_pred) for r in langid.predict(new, model).collect()) == list(enumerate("ab" * 10))


def test_tables_equal_the_convolution():
    p = langid.Params(epochs=1, windows=2)
    model = langid.fit(["abc " * 50, "xyz " * 50], ["a", "b"], p)
    start, row, size = langid.places(np.array([0, 320, 321]), 128)
    x = langid.cut(np.frombuffer(b"abc xyz " * 40 + b"z", np.uint8), start, size, 128)
    assert size.tolist() == [128, 128, 64, 1] and row.tolist() == [0, 0, 0, 1]
    f = p.filters
    want = np.zeros((len(x), len(model.bias)), np.float32)
    for n, w in enumerate(x):
        for i, k in enumerate(model.widths):
            conv = [sum(model.tables[j][w[t + j], i * f : (i + 1) * f] for j in range(k)) for t in range(128 - k + 1)]
            want[n, i * f : (i + 1) * f] = np.max(conv, axis=0)
    z = np.maximum(want + model.bias, 0) @ model.dense + model.out
    want = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(langid.probabilities(model, x, block=3), want, atol=1e-4)


def vectors(spark, n=900, dim=16):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, dim)).round(3)
    x[100:300] = x[100]  # a very common vector
    x[300:400] = x[100] + rng.normal(size=(100, dim)) * 0.001
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(2000, None), (2050, [0.0] * dim), (2100, [float("nan")] + [1.0] * (dim - 1)), (2150, [None] + [1.0] * (dim - 1)), (2200, [1.0]), (2250, [float("inf")] * dim), (None, rows[0][1]), (2300, [])]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), x


def test_neighbours_and_recall(spark):
    df, x = vectors(spark)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, params=ann.Params(pivots=32, near=16, file=100, least=24)).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 900, 50))
    hit = 0
    for q, own in got.items():
        score = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] ** 2).sum()))
        assert sorted(own) == [1, 2, 3, 4, 5] and all(v != q and abs(s - score[v]) < 1e-12 for v, s in own.values())
        score[q] = -2
        best = np.lexsort((np.arange(len(x)), -score))[:5].tolist()
        hit += len(set(best) & {v for v, _ in own.values()})
        if q in range(100, 300):
            assert [own[i][0] for i in range(1, 6)] == best
    assert hit >= 0.9 * 5 * len(got)
    few = ann.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0 and ann.nearest(df.where("vec_id >= 2000"), F.lit(True)).count() == 0


def test_repeated_vectors_count_once(spark):
    """Each row twice, the nearest one nine times, an id with a vector and its double: as without the repeats."""
    df = vectors(spark)[0].where("vec_id < 60")
    p = ann.Params(pivots=16, near=8, share=1, probe=1)
    rows = lambda d: sorted(ann.nearest(d.coalesce(1), F.col("vec_id") % 20 == 0, params=p).collect())  # noqa: E731, one block
    want = rows(df)
    assert [r["rank"] for r in want] == [1, 2, 3, 4, 5] * 3
    near = df.join(spark.createDataFrame([(r.vec_id,) for r in want if r["rank"] == 1], "vec_id long").distinct(), "vec_id")
    many = df.union(df)
    for _ in range(7):
        many = many.union(near)
    doubled = near.select("vec_id", F.transform("embedding", lambda x: x * 2))
    for got in (rows(df.union(df)), rows(many), rows(df.union(doubled))):
        assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_every_length_is_searched(spark):
    """Two lengths, the rarer one too, and an id that has both: each among its own length."""
    df = vectors(spark)[0].where("vec_id < 60")
    p = ann.Params(pivots=16, near=8, share=1, probe=1)
    rows = lambda d: {tuple(r) for r in ann.nearest(d, F.col("vec_id") % 20 == 0, params=p).collect()}
    short = df.where("vec_id < 50").select((F.col("vec_id") + 1000).alias("vec_id"), F.slice("embedding", 1, 4).alias("embedding"))
    assert len(rows(short)) == 15
    assert rows(df.union(short)) == rows(df) | rows(short)
    both = short.select(F.when(F.col("vec_id") == 1020, 0).otherwise(F.col("vec_id")).alias("vec_id"), "embedding")
    best = sorted([r for r in rows(df) if r[0] == 0] + [r for r in rows(short) if r[0] == 1020], key=lambda r: (-r[3], r[2]))[:5]
    assert sorted(r[1:] for r in rows(df.union(both)) if r[0] == 0) == [(i + 1, *r[2:]) for i, r in enumerate(best)]


def test_few_distances_find_nearly_all():
    """Gaussian vectors, the hardest case: at least 0.95 of the true five with a quarter of the distances of exact search."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(40000, 64))
    p = ann.Params()
    pivots = ann._unit(x[rng.choice(len(x), p.pivots, replace=False)])
    order = ann.orders(x, pivots, p.near)
    files = {}
    for pivot in range(p.pivots):
        rows = np.flatnonzero((order[:, : p.post] == pivot).any(axis=1))
        files[pivot] = ann.File(pivot, p.pivots, rows, x[rows], order[rows], p)
    hit, asked = 0, range(0, len(x), 800)
    for q in asked:
        found = [r for pivot in order[q][: ann.probes(p, p.pivots)].tolist() for r in zip(*files[pivot].nearest(q, x[q], order[q], 5), strict=True)]
        assert len({i for i, _ in found}) == len(found)  # each met once
        score = (x @ x[q]) / np.sqrt((x * x).sum(1))
        score[q] = -np.inf
        hit += len({i for i, _ in sorted(found, key=lambda r: -r[1])[:5]} & set(np.argsort(-score)[:5].tolist()))
    assert hit >= 0.95 * 5 * len(asked)
    assert sum(f.scored for f in files.values()) + p.pivots * len(asked) <= 0.25 * len(x) * len(asked)


def test_exact_search_is_an_option(spark):
    df, x = vectors(spark, 400)
    got = {}
    clashing = df.withColumns({"score": F.lit(7), "rank": F.lit("r"), "query_id": F.lit(1), "pivot": F.lit(2), "asked": F.lit("x")})
    for r in ann.nearest(clashing, F.col("vec_id") % 20 == 0, params=ann.Params(pivots=16, file=30, share=1, probe=1)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(0, 400, 20):
        score = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] ** 2).sum()))
        score[q] = -2
        assert [i for _, i in sorted(got[q])] == np.lexsort((np.arange(len(x)), -score))[:5].tolist()


def test_mix_meets_its_targets(spark, docs, empty):
    rng = random.Random(8)
    sizes = {"a": 400, "b": 300, None: 500, "c": 3, "d": 200}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join("w" * (1 + i % 3) for _ in range(rng.randrange(0, 30))), s))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(mixing.mix(df)).collect()
    source, size = {r[0]: r[2] for r in rows}, {r[0]: len(split(r[1])) for r in rows}
    total = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        total[source[r.doc_id]] += r.taken
    own = {source[r.doc_id]: (r.target, r.source_size) for r in got}
    want, caps = {}, {s: 2 * n for s, (_, n) in own.items()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    budget, open_ = 1.5 * sum(n for _, n in own.values()), set(caps)
    while open_:  # reshare until no target is above its cap
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > caps[s]}
        for s in full or open_:
            want[s] = caps[s] if full else weight[s] * level
            if full:
                budget -= caps[s]
        open_ = open_ - full if full else set()
    for s, (target, _) in own.items():
        assert abs(target - want[s]) < 1e-6 and abs(total[s] - target) <= 60
    again = mixing.taken(mixing.mix(df.repartition(7))).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert mixing.taken(mixing.mix(docs)).count() == docs.count() and mixing.mix(empty).count() == 0
    nothing = mixing.taken(mixing.mix(df.withColumn("text", F.lit(None).cast("string")))).collect()
    assert len(nothing) == len(rows) and all(r.taken == 0 for r in nothing)


def brute_strip(rows, k=50):
    first = {}
    for i, t in rows:
        w = split(t)
        for j in range(len(w) - k + 1) if i is not None else ():
            g = tuple(w[j : j + k])
            first[g] = min(first.get(g, i), i)
    out = Counter()
    for i, t in rows:
        w = split(t)
        gone = bytearray(len(w))
        for j in range(len(w) - k + 1) if i is not None else ():
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = b"\1" * k
        out[(i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())] += 1
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_passages_equal_brute_force(spark, docs, empty, hot):
    p = substring.Params(hot=hot)
    more = spark.createDataFrame([(500 + i, prose(i % 9, i) + " " + prose(90, 31) + " " + prose(i % 5, 50 + i)) for i in range(20)] + [(600, "same " * 130), (601, "same " * 130), (601, prose(95, 31))], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    got = Counter(tuple(r) for r in substring.strip_repeats(every, p).collect())
    assert got == brute_strip(data(every))
    carried = substring.strip_repeats(docs, p, give="text", carry=("source", "size"))
    assert carried.count() == docs.count() and carried.columns[:3] == ["doc_id", "source", "size"]
    assert all(r.kept == (r.text or "") for r in carried.join(docs.select("doc_id", "text"), "doc_id").where("n_removed = 0").collect() if r.doc_id not in (22, 25))
    assert substring.strip_repeats(empty, p).count() == 0
    clashing = docs.selectExpr("doc_id", "text", "size AS copy", "key AS spans", "kept AS least", "size AS content")
    assert substring.strip_repeats(clashing, p, carry=("copy", "spans", "least", "content")).columns == ["doc_id", "copy", "spans", "least", "content", "n_words", "n_removed", "kept"]
    with pytest.raises(ValueError):
        substring.strip_repeats(docs, p, carry=("kept",))
