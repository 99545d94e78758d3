import hashlib
import math
import random
import re

import numpy as np
import pytest

from quillguard.llm import codebooks, infill
from quillguard.llm import textbytes as tb


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error) of all rows by plain loops, for vectors of one length."""
    good = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not good:
        return [], None
    width = len(good[0][2]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = {}
    for i, _, v in sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        first.setdefault(i, v)
    book = [[cut(v)[p] for v in list(first.values())[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, part: min((dist(part, e), k) for k, e in enumerate(book[p]))
    for _ in range(rounds):
        held = [{} for _ in range(parts)]
        for _, _, v in good:
            for p, part in enumerate(cut(v)):
                held[p].setdefault(near(p, part)[1], []).append(part)
        for p in range(parts):
            for k, group in held[p].items():
                book[p][k] = [sum(x) // len(group) for x in zip(*group)]
    out, by_label = [], {}
    for i, label, v in good:
        best = [near(p, part) for p, part in enumerate(cut(v))]
        error = sum(d for d, _ in best)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in best), error, label))
    flat = ",".join(str(x) for p in book for e in p for x in e)
    return [(i, c, e, by_label[label]) for i, c, e, label in out], hashlib.sha256(flat.encode()).hexdigest()


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("seed", range(3))
def test_codes_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(codebooks, "BLOCK_BYTES", 8 * 8 * 7)
    monkeypatch.setattr(codebooks, "CHUNK", 3)
    rng = random.Random(seed)
    vector = lambda: [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(8)]
    rows = [(rng.randrange(500), vector(), rng.choice([1, 2, 2, 2, None])) for _ in range(120)]
    rows += [rows[0]] * 4 + [(7, rows[1][1], 3), (7, vector(), 3), (None, vector(), None), (None, vector(), 1), (-3, [1.0] * 8, 1)]
    rows += [(900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [math.nan] + [0.0] * 7, 1), (903, [math.inf] * 8, 1), (904, [], 1), (905, [1.0] * 3, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "`vec.id` long, embedding array<double>, label int, code string")
    got = codebooks.compress(df, id_col="vec.id", entries=20).collect()
    want, digest = brute_codes([r for r in rows if r[0] != 905], entries=20)
    assert ordered(tuple(r)[:4] for r in got) == ordered(want) and {r.codebooks_sha256 for r in got} == {digest}


def test_lengths_have_codebooks_of_their_own(spark):
    rows = [(i, [float(i % 5), 1.0, 0.5, float(i)], i % 2) for i in range(12)]
    long = [(i, [0.1 * i] * 8, i % 2) for i in range(12)]
    schema = "vec_id long, embedding array<float>, label int"
    apart = [codebooks.compress(spark.createDataFrame(r, schema), entries=4).collect() for r in (rows, long)]
    both = codebooks.compress(spark.createDataFrame(rows + long, schema), entries=4).collect()
    assert ordered((r.vec_id, r.code, r.error) for r in both) == ordered((r.vec_id, r.code, r.error) for part in apart for r in part)
    assert codebooks.compress(spark.createDataFrame([], schema)).collect() == []
    with pytest.raises(ValueError):
        codebooks.compress(spark.createDataFrame(rows, schema), entries=257)


def test_wide_numbers_stay_exact():
    rng = np.random.default_rng(4)
    data, book = rng.integers(-(10**6), 10**6, (8, 50)), rng.integers(-(10**6), 10**6, (2, 9, 4))
    code, error = codebooks.nearest(data, book)
    full = ((data.reshape(2, 1, 4, 50) - book[:, :, :, None]) ** 2).sum(2)
    assert (code == full.argmin(1)).all() and (error == full.min(1)).all()


def brute_forms(doc_id, text, seed=7, fim=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = ["", None, "\n", "\n\n\n", "one", "one\n", "one\ntwo", "é\nß<\n>P\n日本", "a <P> b", "<M>", "x<S", "<S", "P>", "<P", "ends with <", "S>\nstarts like a marker", "\r\n\x0b\n\x85\n", "😀\n" * 40, "long line " * 3000, "w\n" * 5000]


@pytest.mark.parametrize("fim, spm", [(100, 50), (60, 30), (0, 50)])
def test_forms_against_brute_force(spark, monkeypatch, fim, spm):
    monkeypatch.setattr(tb, "BLOCK", 64)
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(["a", "é", "\n", "<", "P", "S", ">", " "]) for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(None if k == 5 else k, t, "keep", k) for k, t in enumerate(texts)] + [(3, TEXTS[3], "keep", 3)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, N int")
    made = infill.transform(df, fim_percent=fim, spm_percent=spm)
    assert made.columns == ["doc_id", "a.b", "N", "_n", "form", "prefix_chars", "middle_chars", "output"]
    got = infill.restore(made).collect()
    want = sorted(((k, *brute_forms(i, t, fim=fim, spm=spm), t or "") for i, t, _, k in rows), key=str)
    assert sorted(((r.N, r["_n"], r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got), key=str) == want
    assert {r["a.b"] for r in got} == {"keep"}


def test_forms_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert infill.digests(df).collect() == []
