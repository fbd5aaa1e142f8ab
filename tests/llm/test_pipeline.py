"""The pipeline's stages over planted documents, and without the subpackage."""

import hashlib
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

from tidemark.llm import bpe  # noqa: E402

from .test_operators import PATTERN, RANKS, brute_near, brute_strip, prose  # noqa: E402

TOP = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """200 clean documents, 40 poor ones, copies, near copies, and a passage in ten documents."""
    at = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(1)
    passage = prose(80, 999, 2000)
    rows, told = [], []
    for i in range(240):
        t = prose(rng.randrange(70, 160), i, 2000)
        if i % 6 == 5:
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif i in range(100, 120) and i % 2 == 0:
            t = prose(30, 3000 + i, 2000) + " " + passage + " " + prose(30, 4000 + i, 2000)
        rows.append((i, t))
        told.append((i, int(i % 6 != 5), 0))
    words = rows[0][1].split()
    rows += [(300, rows[1][1]), (301, rows[1][1]), (302, " ".join([*words[:-1], "changed"])), (303, None), (303, None)]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(told, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if i < 4:
            assert out.columns == corpus_pipeline.COLUMNS
            out.write.parquet(f"{folder}/stage{i}")
            docs = spark.read.parquet(f"{folder}/stage{i}")
            seen.append({r.doc_id: r.text for r in docs.collect()})
    good, near, stripped, mixed = seen
    assert not [i for i in good if i is not None and i < 240 and i % 6 == 5] and len([i for i in good if i < 240]) >= 196
    assert 1 in near and not {300, 301, 302} & set(near) and len(near) >= len(good) - 4
    cut = [i for i in range(102, 120, 2) if i in near and i % 6 != 5]
    first = min(j for j in range(100, 120, 2) if j in near)
    # a word next to the passage may be the same in two documents
    assert cut and all(80 <= len(near[i].split()) - len(stripped[i].split()) <= 84 for i in cut if i != first)
    assert all(stripped[i] == near[i] for i in stripped if i < 100)
    assert set(mixed) <= set(stripped)
    rows = out.collect()
    assert len(rows) == docs.count() and all(r.decodes for r in rows)
    e = bpe.encoding(RANKS, PATTERN)
    assert all(r.ids == e.encode_ordinary(mixed[r.doc_id] or "") for r in rows)


def test_own_text_of_a_repeated_id_stays(spark, folder):
    a, b = prose(90, 5001, 2000), prose(90, 5002, 2000)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(1, a), (2, a), (2, b), (2, b)]], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()) == [(1, a), (2, b)]


def brute(rows):
    """(doc_id, source, ids) that the stages after the classifier give for (doc_id, text, source), in plain Python."""
    near = brute_near([(i, t) for i, t, _ in rows], 5)
    rows = [r for r in {r[:2]: r for r in rows}.values() if near[r[0]][2]]
    left = {(i, n): (gone, kept) for i, n, gone, kept in brute_strip([(i, t) for i, t, _ in rows])}
    stripped = []
    for i, t, s in rows:
        n = len((t or "").encode().split())
        gone, kept = left[i, n]
        if not n or gone < n:
            stripped.append((i, kept if gone else t or "", s))
    size = lambda t: len(t.encode().split())
    sources = sorted({s for _, _, s in stripped})
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total = {s: sum(size(t) for _, t, o in stripped if o == s) for s in sources}
    target, budget, open_ = {}, 1.5 * sum(total.values()), set(sources)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * total[s]}
        target |= {s: 2.0 * total[s] if full else weight[s] * level for s in full or open_}
        budget -= sum(2 * total[s] for s in full)
        open_ = open_ - full if full else set()
    line = []
    for s in sources:
        upto = 0
        for key, i, t in sorted((hashlib.md5(f"{i}|0".encode()).hexdigest(), i, t) for i, t, o in stripped if o == s):
            upto += size(t)
            if size(t):
                line += [((upto + c * total[s]) / target[s], key, i, c, t, s) for c in (0, 1)]
    e, taken, out = bpe.encoding(RANKS, PATTERN), 0, []
    for _, _, i, _, t, s in sorted(line):
        taken += size(t)
        if 2 * taken > 3 * sum(total.values()):
            break
        out.append((i, s, tuple(e.encode_ordinary(t))))
    return Counter(out)


def test_run_equals_brute_force(spark, folder):
    """The rows of run() as a multiset; the classifier's own choice is the input of the brute force."""
    good = corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    want = brute([(r.doc_id, r.text, r.source) for r in good])
    rows = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in rows) == want and sum(want.values()) > 200
    assert all(r.decodes and r.n_tokens == len(r.ids) for r in rows)


def test_stages_with_clashing_columns_repeated_rows_and_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    names = ("copies", "rows", "copy", "copy_key", "kept", "n_words", "n_removed", "spans", "ids", "taken", "size", "score", "carried0", "label")
    wide = docs.union(docs).withColumns({n: F.lit("x") for n in names})
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, wide, folder)
        assert out.columns == corpus_pipeline.COLUMNS or i == 4
        assert out.count() == stage(spark, docs.union(docs), folder).count()
        assert stage(spark, wide.limit(0), folder).count() == 0
    once = corpus_pipeline.drop_near_duplicates(spark, wide, folder)
    assert once.count() == once.select("doc_id").distinct().count() > 30


def test_the_rest_works_without_the_subpackage(tmp_path):
    """As after deleting the folders: the entry imports and keeps the other queries."""
    for p in TOP.rglob("*.py"):
        at = p.relative_to(TOP)
        if "llm" not in at.parts and at.name != "corpus_pipeline.py" and ".git" not in at.parts:
            (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / at).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)}, timeout=120)
