import random

from sentable.llm import line_dedup as L
from tests.llm.data import AWKWARD, stored


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def words(line):
    return tuple(line.encode().translate(L.LOWER_BYTES).split())


def near(v, w, n):
    if len(v) >= n and len(w) >= n:
        return abs(len(v) - len(w)) <= 1 and distance(v, w) <= 1
    if len(v) >= n or len(w) >= n:
        return False
    a, b = sorted((b" ".join(x).decode() for x in (v, w)), key=len)
    if len(a) < L.MIN_CHARS or len(b) - len(a) > 1 or distance(a, b) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return not (b[k:k + 1] in "0123456789" or len(a) == len(b) and a[k] in "0123456789")


def brute(rows, n=L.MIN_WORDS):
    """Kept line numbers of each row: earliest of equal lines, and no earlier one within an edit."""
    places = {}
    for r, (i, text) in enumerate(rows):
        for k, line in enumerate((text or "").split("\n")):
            if words(line):
                place = (i is not None, i, r, k)
                places[words(line)] = min(places.get(words(line), place), place)
    kept = {r: [] for r in range(len(rows))}
    lines = sorted(places, key=places.get)
    for k, w in enumerate(lines):
        if not any(near(v, w, n) for v in lines[:k]):
            kept[places[w][2]].append(places[w][3])
    return [sorted(kept[r]) for r in range(len(rows))]


def test_variants_of_equal_rests_are_equal():
    a = L.variants(b"a b c d".split())
    b = L.variants(b"a x c d".split())
    c = L.variants(b"a c d".split())
    assert a[2] == b[2] == c[0] and len({*a, *b, *c}) == 5 + 5 + 4 - 2 - len({*c[1:]} & {*a[1:], *b[1:]})


def test_within_one():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ([rng.choice("ab") for _ in range(rng.randrange(5))] for _ in range(2))
        assert L.within_one(a, b) == (distance(a, b) <= 1)


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    lines = [[f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 16))] for _ in range(60)]
    rows = list(AWKWARD)
    for i in range(80):
        out = []
        for _ in range(rng.randrange(0, 7)):
            w = list(rng.choice(lines))
            kind = rng.randrange(8)
            at = rng.randrange(len(w))
            if kind == 1:
                w[at] = f"n{rng.randrange(4)}"
            elif kind == 2:
                w.insert(at, "extra")
            elif kind == 3:
                del w[at]
            line = "  ".join(w).title() if kind == 4 else " ".join(w)
            if kind > 5:                                      # a character put in, left out or replaced
                k = rng.randrange(len(line))
                line = line[:k] + rng.choice(["", "é", "x", "7"]) + line[k + rng.randrange(2):]
            out.append(line)
        rows.append((500 - i, "\n".join(out)))
    heads = ["Terms of the service", "Terms of the servise", "Terms of he service", "Chapter number 1", "Chapter number 2",
             "Chapter number x", "Chapter number y", "a short one", "a shirt one", "Über die Straße", "Uber die Straße"]
    rows += [(800 + i, "\n".join(rng.sample(heads, 4))) for i in range(20)]
    page = "page {} of the same long running head line of a book"
    rows += [(9000 + i, page.format(i)) for i in range(300)]
    docs = stored(spark, tmp_path, rows, clash=True)
    read = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]     # in the order of the scan
    out = L.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_kept").collect()
    want = []
    for (i, text), keep in zip(read, brute(read)):
        every = (text or "").split("\n")
        full = [bool(words(x)) for x in every]
        want.append((i, None if text is None else "\n".join(x for k, x in enumerate(every) if k in keep or not full[k]),
                     sum(full), len(keep)))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert sum(r.n_kept for r in out if r.doc_id and r.doc_id >= 9000) == 1


def test_empty(spark, tmp_path):
    assert L.dedup_lines(stored(spark, tmp_path, [])).collect() == []
