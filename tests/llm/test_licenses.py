import random
import re

from sentable.llm import licenses as L
from tests.llm.data import AWKWARD, stored

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, templates):
    w = TOKEN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, base = [], set()
    for phrase, label in L.BASE:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    found, score = set(), 0.0
    for s in range(0, max(1, len(w) - L.WINDOW + L.STRIDE), L.STRIDE):
        block = set(w[s:s + L.WINDOW])
        for label, ws in templates:
            overlap = len(block & set(ws))
            if overlap >= L.needed(len(ws)):
                found.add(label)
                score = max(score, overlap / len(ws))
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | found)), 1.0 if base else score)


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    vocab = sorted({w for _, ws in L.template_sets() for w in ws}) + [f"x{i}" for i in range(30)]
    rows = list(AWKWARD)
    for i in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 200))]
        if i % 2:
            t = rng.choice(L.TEMPLATES)[1].split()
            if len(t) > 10 and i % 4 == 1:
                t.pop(rng.randrange(len(t)))
            at = rng.randrange(len(w) + 1)
            w[at:at] = t
        rows.append((1000 + i, rng.choice([" ", "\n", ", "]).join(w).title()))
    rows += [(5000, "MIT\nLicense; mit license. GNU General-Public License"), (5001, "cc by cc by")]
    out = L.scan(stored(spark, tmp_path, rows, clash=True)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(((i, *brute(t, L.template_sets())) for i, t in rows), key=key)
    assert sorted(map(tuple, out), key=key) == want
    assert sum(1 for r in out if r.labels and not r.base_labels) > 10


def test_templates_fit_into_a_window():
    assert all(len(t.split()) <= L.WINDOW - L.STRIDE + 1 for _, t in L.TEMPLATES)


def test_empty(spark, tmp_path):
    assert L.scan(stored(spark, tmp_path, [])).collect() == []
