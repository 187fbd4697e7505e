import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from data import AWKWARD, frame, stored
from pyspark.sql import functions as F

from sentable.llm import spelling


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    if len(x) > len(y):
        x, y = y, x
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1:] == x for k in range(len(y)))


def brute_vocabulary(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute_variants(counts):
    by_deletion = defaultdict(set)                        # near words share a word or one with a character deleted
    for w in counts:
        for k in range(len(w)):
            by_deletion[w[:k] + w[k + 1:]].add(w)
        by_deletion[w].add(w)
    near = defaultdict(set)
    for group in by_deletion.values():
        for x in group:
            near[x].update(y for y in group if y != x and y not in near[x] and one_edit(x, y))
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda y: (-counts[y], y))
            if counts[best] >= 10 * n:
                form[w] = best
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None)
    return out


def rows_of(df):
    got = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


@pytest.mark.parametrize("most", [3, 4096])
def test_variants_equal_brute_force(spark, most):
    """Small alphabets make every kind of edit, many ties, chains of forms and hot halves."""
    rng = random.Random(most)
    words = {"".join(rng.choice("ab") for _ in range(rng.choice([7, 8, 9]))) for _ in range(500)}
    words |= {"commonstart" + "".join(rng.choice("abcdé") for _ in range(rng.choice([2, 3]))) for _ in range(300)}
    words |= {"".join(rng.choice("xyz") for _ in range(3)) + "commonend" for _ in range(30)} | {"q" * 3000, "q" * 3001}
    counts = {w: rng.choice([2, 2, 3, 20, 21, 30, 300, 4000]) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.variants(df, most=most)) == brute_variants(counts)


def test_groups_are_bounded_and_meet_each_pair_once(spark):
    rng = random.Random(5)
    words = {"same" + "".join(rng.choice("abcdefgh") for _ in range(6)) + "same" for _ in range(1000)}
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    rows = spelling.groups(df, most=50)
    big = rows.groupBy("gid", "m", "a", "b").count().where((F.col("count") > 50) & (F.col("m") - F.col("a") - F.col("b") > 1))
    assert big.count() == 0


def test_small_chunks_change_nothing(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(7)) for _ in range(400)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(spelling.near_words(df, chunk=1)) == key(spelling.near_words(df))


def test_awkward_rows_and_an_empty_table(spark, tmp_path):
    rows = [*AWKWARD, (30, "Straße straße STRASSE Übermaß Übermaß naïveté naïvete naïveté ÷×÷×÷×÷ ÷×÷×÷×÷"),
            (31, "z" * 50_000 + " " + "Z" * 50_000), (31, "z" * 50_000)]
    rows += [(i, "information informations informtion colour9colours government's") for i in range(40)]
    docs = stored(spark, tmp_path, rows, clash=True)
    got = rows_of(spelling.variants(spelling.vocabulary(docs)))
    assert got == brute_variants(brute_vocabulary(rows))
    assert spelling.variants(spelling.vocabulary(frame(spark, []))).count() == 0


def test_query_on_the_small_table(spark, small_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    got = rows_of(spelling.query(spark, small_dir))
    assert got == brute_variants(brute_vocabulary(rows))
    assert any(form for form, *_ in got.values())
