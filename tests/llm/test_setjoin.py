import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillguard.llm import setjoin
from quillguard.llm import textbytes as tb


def sets_of(text, k=4):
    low = (text or "").translate({c: c + 32 for c in range(0x41, 0x5B)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent=85, k=4):
    """(place, n, component) of all rows, by comparing all pairs."""
    sets = [sets_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in ids.items()}
    return [(doc, len(s), least[find(i)] if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def corpus(seed, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = text(40)
    rows = []
    for _ in range(25):  # groups whose members drift apart
        base = text(rng.randrange(5, 120))
        for _ in range(rng.randrange(1, 9)):
            rows.append(list(base))
            for _ in range(rng.randrange(3)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = base[: max(1, len(base) - rng.randrange(8))]
    rows += [passage + text(rng.randrange(20)) for _ in range(40)] + [text(rng.randrange(5)) for _ in range(30)]
    texts = [rng.choice([" ", "\n", "\t "]).join(r) for r in rows]
    texts = [t.upper() if rng.random() < 0.2 else t for t in texts] + ["", None, " \n ", "é è", "É è", texts[0], texts[0]]
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    ids[3], ids[5] = None, ids[6]
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed, sizes", [(0, None), (1, None), (2, (4, 3, 2, 1)), (3, (2, 2, 1, 0))])
def test_against_brute_force(spark, monkeypatch, seed, sizes):
    if sizes:  # lists in parts, several chunks and cells, cells joined whole
        for name, value in zip(("LIST", "CHUNK", "CELL", "FEW"), sizes):
            monkeypatch.setattr(setjoin, name, value)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "`doc.id` long, text string, cid int, t1 string")
    got = [tuple(r) for r in setjoin.components_of(df, id_col="doc.id").collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_lower_threshold_and_other_width(spark):
    rows = corpus(5, words=60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in setjoin.components_of(df, k=2, percent=60).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows, 60, 2), key=key)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert setjoin.components_of(df).collect() == []
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, setjoin.components_of(df).collect())) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("seed", range(4))
def test_answers_and_bounds(seed):
    rng = np.random.default_rng(seed)
    base = rng.choice(300, 60, replace=False)
    sets = []
    for _ in range(60):
        if rng.random() < 0.2:
            base = rng.choice(300, rng.integers(1, 90), replace=False)
        sets.append(np.unique(np.concatenate([rng.choice(base, max(1, len(base) - rng.integers(6)), replace=False), rng.choice(300, rng.integers(5))])))
    size = np.array([len(s) for s in sets])
    first = np.concatenate([[0], np.cumsum(size)])
    a, b = setjoin.answers(np.concatenate(sets), first, size, 85)
    inter = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    link = 100 * inter >= 85 * (size[:, None] + size[None, :] - inter)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(link, 1)))}
    assert set(zip(a.tolist(), b.tolist())) == want
    bits = setjoin.bitmaps(tb.mix(np.concatenate(sets).astype(np.uint64)), first)
    near = setjoin.near_pairs(np.arange(60), size, bits, 85)
    assert want <= {(min(i, j), max(i, j)) for i, j in zip(near[0].tolist(), near[1].tolist())}
    least = setjoin.overlap(size[:, None], size[None, :])
    assert ((inter >= least) == link).all()


def test_joined_by_label():
    text = pa.array(["a b c d e f g h", "A B C D E F G H", "q", None, "a b c d e f g h"])
    a, b = setjoin.joined(text, np.array([0, 1, 2, 3, 0]), 4, 85)
    assert {(x, y) for x, y in zip(a.tolist(), b.tolist())} in ({(0, 1)}, {(1, 4)})
