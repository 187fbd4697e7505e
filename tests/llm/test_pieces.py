import random

import numpy as np
import pytest

from sentable.llm import pieces as P
from tests.llm.data import AWKWARD, stored


def small():
    rng = random.Random(1)
    texts = [b"\xff", b"\xff\xff", b"\xffa", b"a", b"b", b"ab", b"ba", b"aba", b"\xffab", b"abab", "é".encode(), "éa".encode(), b"c"]
    pieces = texts + [bytes([b]) for b in range(256)]
    return P.vocabulary(pieces, {i: -rng.uniform(1, 9) for i in range(len(texts))}, list(range(len(texts), len(texts) + 256)))


def best(text: bytes, v) -> float:
    """The score of the best segmentation, over whole texts and with no trie."""
    known = {v.pieces[i]: v.scores[i] for i in np.flatnonzero(v.scores > -np.inf)}
    width = lambda b: 1 if b < 0xC0 or b == 0xFF else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
    score = {0: 0.0}
    for i in range(len(text)):
        if i in score:
            w = width(text[i])
            steps = [(len(p), s) for p, s in known.items() if text.startswith(p, i)]
            if text[i:i + w] not in known:
                steps.append((w, v.unknown))
            for n, s in steps:
                score[i + n] = max(score.get(i + n, -np.inf), score[i] + s)
    return score[len(text)]


def test_viterbi_against_brute_force():
    v, rng = small(), random.Random(2)
    texts = ["".join(rng.choice("aab  béc\nzü漢🎉▁") for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    for t, ids in zip(texts, P.Encoder(v)([t.encode() for t in texts])):
        lone, total, i = [], 0.0, 0
        ids = ids.tolist()
        while i < len(ids):                                   # bytes of one character cost one unknown
            if v.scores[ids[i]] > -np.inf:
                total += v.scores[ids[i]]
                i += 1
            else:
                b = v.pieces[ids[i]][0]
                total += v.unknown
                i += 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        marked = (" " + t).encode().replace(b" ", P.MARK)
        assert abs(total - best(marked, v)) < 1e-9, (t, lone)
        assert P.decode(ids, v).decode() == t


def test_double_array_holds_just_its_keys():
    rng = random.Random(3)
    keys = {bytes(rng.choices(b"abcdef\xff\xc3", k=rng.randrange(1, 7))): i for i in range(3000)}
    base, check, value = P.double_array(keys)

    def look(key):
        node = 0
        for b in key:
            child = base[node] + b
            if check[child] != node:
                return -1
            node = child
        return value[node]
    assert all(look(k) == i for k, i in keys.items())
    assert all(look(bytes(rng.choices(b"abcdef", k=9))) == -1 for _ in range(100))
    assert all(look(k[:-1]) == keys.get(k[:-1], -1) for k in keys if len(k) > 1)


def test_round_trip_of_the_vocabulary_file(spark, tmp_path):
    rows = AWKWARD + [(100, "▁ literal mark <0x0A> </s>"), (101, "x" * 5000), (102, " lead and trail "), (103, "\x00\x01")]
    docs = stored(spark, tmp_path, rows, clash=True)
    out = P.encode(docs).select("doc_id", "text", "decoded", "piece_ids", "n_byte_pieces").collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.decoded == (r.text or "") and bool(r.piece_ids) == bool(r.text)
    assert P.encode(stored(spark, tmp_path, [], "none")).collect() == []


def test_pieces_over_words_are_refused():
    with pytest.raises(ValueError):
        P.vocabulary([b"a\xffb"], {0: -1.0}, [0] * 256)
