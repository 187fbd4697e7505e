import hashlib
from collections import defaultdict

import numpy as np

from sentable.llm import exact_dedup as D
from sentable.llm.common import LOWER_BYTES
from tests.llm.data import AWKWARD, stored


def test_rice_code_round_trip():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (1, 2 ** 47), (2, 5), (1000, 2 ** 47), (1000, 1500), (5, 2 ** 20)):
        v = np.unique(rng.integers(0, top, n))
        b, blob = D.rice_encode(v)
        assert (D.rice_decode(len(v), b, blob) == v).all()
        assert len(blob) * 8 <= len(v) * (np.log2(max(2, top / len(v))) + 4) + 64


def test_answer_marks_what_two_senders_sent():
    import pandas as pd
    a, b = np.array([3, 10, 500]), np.array([10, 700])
    rows = [(s, len(v), *D.rice_encode(v)) for s, v in ((1, a), (2, b))]
    out = D.answer((0,), pd.DataFrame(rows, columns=["sender", "n", "b", "blob"]))
    bits = [np.unpackbits(np.frombuffer(m, np.uint8), count=n).tolist() for m, n in zip(out["bitmap"], out["n"])]
    assert bits == [[0, 1, 0], [1, 0]]


def test_against_brute_force(spark, tmp_path):
    rows = AWKWARD + [(100 + i, "Hot Text" if i % 3 else "hot text") for i in range(300)] + [
        (1000 + i, f"text {i // 2 if i % 7 else i}") for i in range(200)]
    out = D.exact_duplicates(stored(spark, tmp_path, rows, clash=True)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().translate(LOWER_BYTES)].append(i)
    want = defaultdict(int)
    for norm, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(norm).hexdigest())] += 1
    got = defaultdict(int)
    for r in out:
        got[(r.doc_id, r.keep_id, r.group_size, r.text_sha256)] += 1
    assert got == want
    assert sum(r.kept for r in out) == len(groups)            # one row of each group, repeated rows included
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_empty(spark, tmp_path):
    assert D.exact_duplicates(stored(spark, tmp_path, [])).collect() == []
