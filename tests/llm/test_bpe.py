import hashlib
import random

import numpy as np
import pytest
from data import AWKWARD, frame, stored

from sentable.llm import bpe

ALPHABETS = ["abcdefghij", "a", "aab", "0123456789", "'sredtlvm", "!?.,'\"-_", " \n\t", "漢字語文", "éüñç", "ab cd ef'll 12 ",
             "́a‍🎉👨‍👩‍👧", "\x1c\x85\xa0  ."]


@pytest.fixture(scope="module")
def codec():
    with open(bpe.DEFAULT_TOKENIZER, encoding="utf-8") as f:
        return bpe.Codec(f.read())


def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


def mixed(rng, size):
    out = []
    while sum(map(len, out)) < size:
        letters = rng.choice(ALPHABETS)
        if rng.random() < .2:
            out.append("<|endoftext|>" * rng.choice([1, 2]))
        out.append("".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 10, 60, 200]))))
    return "".join(out)


def test_parts_join_to_the_whole_encoding_wherever_cuts_fall(codec):
    rng, t = random.Random(7), library()
    for _ in range(600):
        text, piece = mixed(rng, rng.choice([20, 100, 1000])), rng.choice([1, 2, 5, 17, 50, 100])
        parts = codec.encode([text[k:k + piece] for k in range(0, len(text), piece)])
        got = bpe.concatenated(codec, parts)
        assert got.tolist() == t.encode(text, add_special_tokens=False).ids
        assert codec.decode(got).decode() == text


def test_both_encoders_split_every_character_alike(codec):
    assert codec.fast is not None
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x3400 or c % 16 == 7 or 0xA000 < c < 0x20000)]
    for k in range(0, len(points), 512):
        text = "".join(f"a{chr(c)}1{chr(c)}.{chr(c)} {chr(c)}b" for c in points[k:k + 512])
        assert codec.encode([text])[0].tolist() == codec.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_left_to_the_library(codec):
    import json
    with open(bpe.DEFAULT_TOKENIZER, encoding="utf-8") as f:
        file = json.load(f)
    file["model"]["vocab"]["zq"] = 50257          # a token that no merge makes in its place
    file["model"]["merges"].append(["z", "q"])
    file["model"]["merges"][0], file["model"]["merges"][1] = file["model"]["merges"][1], file["model"]["merges"][0]
    other = bpe.Codec(json.dumps(file))
    assert other.fast is None
    text = "the zq zqq quick"
    assert other.encode([text])[0].tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids
    assert other.decode_all(other.encode([text, ""])).to_pylist() == [text.encode(), b""]


def test_window_grows_in_a_unit_without_agreement(codec):
    """Runs whose tokens on either side of a cut shift all along."""
    t = library()
    for unit in ("a", "ab", "0", " ", "=", "-_", "語", "\n"):
        for size in (1000, 1001, 4097):
            text = "x" + unit * size
            for at in (1, 2, 333, 500, 999):
                got = codec.join(*codec.encode([text[:at], text[at:]]))
                assert got.tolist() == t.encode(text, add_special_tokens=False).ids


def test_operator_equals_the_library_on_awkward_rows(spark, tmp_path):
    rows = [*AWKWARD, (20, "a<|endoftext|>b"), (21, "x" * 5000), (22, "漢字" * 3000), (23, "it's " * 2500 + "'" * 900)]
    docs = stored(spark, tmp_path, rows, clash=True)
    out = bpe.encode(docs, piece=700)
    assert set(out.columns) == (set(docs.columns) - {"decoded"}) | {"token_ids", "decoded"}
    t, got = library(), out.collect()
    want = [(i, x, "" if x is None else x) for i, x in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.rid) for r in got) == \
        sorted((i is None, i or 0, x or "", "x") for i, x, _ in want)
    for r in got:
        assert r.token_ids == t.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == t.decode(r.token_ids, skip_special_tokens=False) == (r.text or "")
    assert bpe.encode(frame(spark, [])).count() == 0


def test_query_digests(spark, small_dir):
    t = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    got = bpe.query(spark, small_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
