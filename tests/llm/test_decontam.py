import itertools
import math
import random

from sentable.llm import decontam as C
from tests.llm.data import AWKWARD, stored


def overlap(doc, item, span=C.SPAN, share=C.SHARE):
    """Most equal words of any window that reaches the share, over all alignments; None if none does."""
    width = min(span, len(item))
    if len(item) < C.LEAST:
        return None
    if len(item) < C.WHOLE:
        share = 1.0
    best = None
    for shift in range(-len(item), len(doc)):
        eq = [0 <= shift + k < len(doc) and doc[shift + k] == w for k, w in enumerate(item)]
        good = [s for s in range(len(item) - width + 1) if sum(eq[s:s + width]) >= share * width - 1e-9]
        if good:
            n = sum(eq[good[0]:good[-1] + width])
            best = n if best is None else max(best, n)
    return best


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(400)] + ["the"] * 60
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [some(rng.randrange(10, 50)) for _ in range(25)] + [some(n) for n in (4, 5, 7, 8, 9)]
    items.append(list(items[0]))                              # an equal item
    docs = {}
    for i in range(160):
        d = some(rng.randrange(0, 150))
        item = list(rng.choice(items))
        kind = i % 5
        if kind == 0:
            docs[i] = d
            continue
        if kind == 1:                                         # as many words substituted as the share allows
            for k in rng.sample(range(len(item)), len(item) // 5 if len(item) >= C.WHOLE else 0):
                item[k] = "other"
        elif kind == 2 and len(item) >= C.WHOLE:
            item = item[:len(item) // 2]
        elif kind == 3:                                       # every other word substituted: no overlap
            item[::2] = ["z"] * len(item[::2])
        at = rng.randrange(len(d) + 1)
        docs[i] = d[:at] + item + d[at:]
    docs[500] = some(1015) + items[3] + some(3000)            # over a block's end
    rows = AWKWARD + [(1000 + i, rng.choice([" ", "\n", ", "]).join(d).title()) for i, d in docs.items()]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, ""), (92, "too short")],
                                  "item_id long, text string")
    got = C.contaminated(stored(spark, tmp_path, rows, clash=True), bench).collect()
    found = {(r.doc_id - 1000, r.item_id): r.n_equal for r in got}
    want = {(i, k): n for i, d in docs.items() for k, item in enumerate(items[:-1]) if (n := overlap(d, item))}
    assert found == want
    assert {k for _, k in want} > set(range(25, 30))
    assert (500, 3) in found and len(want) > 60


def test_masks_hit_every_window_that_reaches_the_share():
    """All places of as many unequal words as a window of 10 to 20 words may have."""
    used = [C.used(m) for m in C.MASKS]
    assert all(m.startswith("11") and m.endswith("1") for m in C.MASKS)
    for width in range(C.WHOLE, C.SPAN + 1):
        unequal = width - math.ceil(C.SHARE * width - 1e-9)
        for bad in itertools.combinations(range(width), unequal):
            assert any(not any(j + s in bad for j in u) for u in used for s in range(width - u[-1]))


def test_empty(spark, tmp_path):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert C.contaminated(stored(spark, tmp_path, AWKWARD), bench).collect() == []
    full = spark.createDataFrame([(1, " ".join("abcdefghijklmno"))], "item_id long, text string")
    assert C.contaminated(stored(spark, tmp_path, [], "none"), full).collect() == []
