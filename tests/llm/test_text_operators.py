import collections
import hashlib
import json
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillguard.llm import bpe, graph, language, neardup, pii, quality, repeats, suffix_tree
from quillguard.llm import textbytes as tb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(11)
VOCABULARY = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 6))) for _ in range(300)]
ODD = [None, "", "   \n\t", "one", "two words", "A\nA\nA", "é" * 300, "x" * 5000, "a " * 700, "\n\n", "tail\n"]


def prose(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


def lowered(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def frame(spark, texts, extra="n_words int"):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], f"doc_id long, text string, source string, {extra}")


def test_words_and_blocks():
    texts = ODD + [prose(40) for _ in range(20)]
    for limit in (1, 300, 1 << 20):
        got = []
        for block in tb.blocks(pa.array(texts), limit):
            w = tb.words(block)
            got += [[block.data[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
        assert got == [WORD.findall(t or "") for t in texts]


# near duplicates


def components_brute(texts):
    sets = []
    for t in texts:
        w = lowered(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


def edited(text, n):
    words = text.split(" ")
    for _ in range(n):
        words[random.randrange(len(words))] = random.choice(VOCABULARY)
    return " ".join(words)


def test_near_duplicates(spark):
    bases = [prose(n) for n in (30, 80, 200)]
    texts = ODD + bases + [edited(b, random.randint(0, 5)) for b in bases for _ in range(25)] + [bases[0].upper(), bases[1]]
    got = sorted(tuple(r) for r in neardup.components_of(frame(spark, texts)).drop("t1", "t2").collect())
    assert got == components_brute(texts)


def test_cells_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 5)
    base = prose(60)
    texts = [edited(base, random.randint(1, 4)) for _ in range(40)]
    assert sorted(tuple(r) for r in neardup.components_of(frame(spark, texts)).drop("t1", "t2").collect()) == components_brute(texts)


def test_near_duplicates_odd_ids(spark):
    text = prose(20)
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (None, "alone"), (9, None)], "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.components_of(df).collect()]
    assert collections.Counter(got) == collections.Counter([(None, 5, False), (5, 5, True), (5, 5, True), (None, None, True), (9, 9, True)])
    assert sorted(str(r.doc_id) for r in neardup.keep_one(df).collect()) == ["5", "9", "None"]
    assert neardup.components_of(df.limit(0)).collect() == []


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(0)
    for shared in (100, 500, 900):
        a = rng.integers(1, 2**63, 1000, dtype=np.uint64)
        b = np.concatenate([a[:shared], rng.integers(1, 2**63, 1000 - shared, dtype=np.uint64)])
        regs = neardup.sketch(np.concatenate([a, b]), np.array([0, 1000, 2000]))
        j = shared / (2000 - shared)
        assert neardup.estimate(regs[:1], regs[1:], np.array([1000.0]), np.array([1000.0]))[0] == pytest.approx(j, abs=0.2)
        both = neardup.sketch(np.unique(np.concatenate([a, b])), np.array([0, 2000 - shared]))
        assert (neardup.merge(regs[0], regs[1]) == both[0]).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, j) for j in range(101, 130)] + [(7, 7)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_components_never_returns_unfinished_labels(spark):
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), rounds=1)


# byte pair encoding


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path(bpe.DEFAULT_VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Coder(ranks, public_tokenizers.PATTERN)


def test_encoding_agrees_with_the_library(tokenizer):
    theirs, ours = tokenizer
    parts = ["ab", "  ", "\n", "\t", "é", "漢字", "1", "23", "'s", "\x1c", "\x85", "\xa0", "🙂", "the", "ing", "tion", ".", "!!", "ß", " "]
    for text in [t or "" for t in ODD] + ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(3000)]:
        packed = ours.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == theirs.encode_ordinary(text)
        assert ours.decode(packed) == text.encode()


def test_prefix_table_appends_and_edits(tokenizer):
    _, coder = tokenizer
    for _ in range(200):
        data = bytes(random.choice(b"abcdething ") for _ in range(random.randint(1, 60)))
        table = bpe.PrefixTable(coder, data)
        a = random.randint(0, len(data))
        b = random.randint(a, len(data))
        table.edit(a, b, b"the")
        table.append(b"ing x")
        assert table.ids() == coder.merged(data[:a] + b"the" + data[b:] + b"ing x")


def test_encode_documents(spark, tokenizer):
    import public_tokenizers

    theirs, _ = tokenizer
    path = public_tokenizers.path(bpe.DEFAULT_VOCABULARY)
    out = bpe.encode_documents(frame(spark, ODD), path, public_tokenizers.PATTERN)
    for r in bpe.decode_ids(out, path).collect():
        text = ODD[r.doc_id] or ""
        ids = np.array(theirs.encode_ordinary(text), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.decoded)) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text.encode())


# language


def test_languages(spark):
    alphabets = {"aa": "abcdef ", "bb": "uvwxyz ", "cc": "aeiouéè "}
    rows = [(i, "".join(random.choice(alphabets[lang]) for _ in range(300)), lang) for i, lang in enumerate(list(alphabets) * 40)]
    rows += [(1000, None, "aa"), (1001, "123 !!", "aa"), (1002, "", None), (1003, "abc abc", None), (None, "uvw uvw", "bb")]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: lang for i, _, lang in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.doc_id is not None and r.doc_id < 1000:
            assert r.lang_pred == want[r.doc_id]
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.identify(unlabelled).collect()] == ["und"]


def test_copies_take_no_place_in_the_sample(spark):
    rows = [(lang, prose(20)) for lang in ("aa", "bb") for _ in range(40)]
    copied = rows + [r for r in rows[::2] for _ in range(30)]
    once, more = [language.train(spark.createDataFrame(r, "lang string, text string"), "lang", "text", 15) for r in (rows, copied)]
    assert list(once) == list(more) == ["aa", "bb"]
    for lang in once:
        for a, b in zip(once[lang].levels, more[lang].levels):
            assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_code_lengths():
    text = b"abracadabra"
    keys, times = np.unique(suffix_tree.grams(np.frombuffer(b"\n" + text + b" \n", np.uint8), np.array([0, len(text) + 3]), 2), return_counts=True)
    tree = language.ContextTree(keys, times.astype(float), 2)

    def bits(context, byte):  # straight from the definition
        data = b"\n" + text + b" \n"
        total = 0.0
        for k in (2, 1, 0):
            tail = context[len(context) - k :]
            seen = collections.Counter(data[i] for i in range(1, len(data)) if data[max(0, i - k) : i].rjust(k, b"\0") == tail)
            n, d = sum(seen.values()), len(seen)
            if seen[byte]:
                return total - math.log2(seen[byte] / (n + d))
            total -= math.log2(d / (n + d)) if n else 0
        return total + 8

    for context, byte in [(b"ab", ord("r")), (b"ra", ord("c")), (b"zz", ord("a")), (b"ab", ord("q")), (b"\n" + b"a", ord("b"))]:
        gram = int.from_bytes(context + bytes([byte]), "big")
        assert tree.bits(np.array([gram], np.uint64))[0] == pytest.approx(bits(context, byte))


# suffix tree


def test_scores(spark):
    texts = ODD + [prose(60) for _ in range(60)]
    got = {r.doc_id: r for r in suffix_tree.score_documents(frame(spark, texts)).collect()}
    tokens = [lowered(t) + ["\0end"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    count = collections.Counter(x for t, h in zip(tokens, held) if not h for x in t)
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(count[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t))
        assert r.score < 0 and math.isfinite(r.score)
    known = [r for i, r in got.items() if i >= len(ODD)]
    noise = suffix_tree.score_documents(frame(spark, texts).limit(0)).collect()
    assert noise == [] and sum(r.score for r in known) / sum(r.n_tokens for r in known) > -8


def scores_brute(texts, held, least, divergence, pull, depth=7):
    """The tree from dictionaries of byte strings, straight from the definition; and the number of its contexts."""
    read = [b"\n" + b"".join(w.encode() + b" " for w in lowered(t)) + b"\n" for t in texts]
    count = collections.defaultdict(collections.Counter)
    for data, h in zip(read, held):
        for i in range(1, len(data)) if not h else ():
            for d in range(min(i, depth) + 1):
                count[data[i - d : i]][data[i]] += 1
    tree = {b""} if count else set()
    for c, nexts in count.items():
        n, up = sum(nexts.values()), count[c[1:]]
        if c and n >= least and sum(k * math.log((k / n) / (up[x] / sum(up.values()))) for x, k in nexts.items()) >= divergence:
            tree.add(c)

    def p(context, byte):
        while context and context not in tree:
            context = context[1:]
        if context not in tree:
            return 1 / 256
        nexts, n = count[context], sum(count[context].values())
        w = pull * len(nexts)
        return (nexts[byte] + w * (p(context[1:], byte) if context else 1 / 256)) / (n + w)

    return [sum(math.log10(p(data[max(0, i - depth) : i], data[i])) for i in range(1, len(data))) for data in read], len(tree)


@pytest.mark.parametrize("part", [10_000_000, 60])
def test_scores_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(suffix_tree, "PART_NODES", part)
    monkeypatch.setattr(suffix_tree.kept_contexts, "__defaults__", (7, 12, 6.0))
    texts = ODD + [prose(60) for _ in range(60)]
    texts += [texts[20], "an\u00e4\U0001f642 new ones"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    want, contexts = scores_brute(texts, held, 12, 6.0, suffix_tree.PULL)
    got = {r.doc_id: r.score for r in suffix_tree.score_documents(frame(spark, texts, "total int")).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-5) and contexts > 50


def test_the_tree_grows_with_the_corpus_and_beats_words(spark):
    phrases = [prose(4) for _ in range(12)]
    texts = [" ".join(random.choice(phrases) for _ in range(30)) for _ in range(160)]
    size = lambda t: suffix_tree.kept_contexts(suffix_tree.counts(frame(spark, t).select("text"))).select("d", F.shiftrightunsigned("key", 8)).distinct().count()
    assert size(texts[:40]) < size(texts)
    rows = [r for r in suffix_tree.score_documents(frame(spark, texts)).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


# repeats


def repeats_brute(texts):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("bucket", [15, 20_000])
def test_repeats(spark, monkeypatch, bucket):
    monkeypatch.setattr(repeats, "BUCKET_CONTEXTS", bucket)
    shared = [prose(70) for _ in range(5)] + ["ab" * 300]
    texts = list(ODD)
    for _ in range(50):
        s = random.choice(shared)
        texts.append(prose(random.randint(0, 90)) + (" " + s[random.randint(0, 60) :] + prose(random.randint(0, 30)) if random.random() < 0.6 else ""))
    texts += texts[12:15]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == repeats_brute(texts)


def test_one_passage_after_many_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_CONTEXTS", 100)
    passage = prose(60)
    texts = [prose(random.randint(0, 40)) + f" {i} " + passage + (prose(5) if i % 3 else "") for i in range(1500)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(frame(spark, texts, "gram int")).collect()}
    assert [got[i] for i in range(len(texts))] == repeats_brute(texts)


def test_repeats_odd_rows(spark):
    long = " ".join(f"{i}" for i in range(90_000))
    rows = [(None, "x" * 300), (1, "\0" * 250), (1, "\0" * 250), (2, long), (3, "y" + long[5:]), (4, None), (5, "ab" * 99), (6, "ab" * 100), (7, "ba" * 101)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, `a.b` int")
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df).collect())
    assert got == collections.Counter((i, *b) for (i, _), b in zip(rows, repeats_brute([t for _, t in rows])))


def test_multikey_sort():
    words = np.random.default_rng(1).integers(0, 3, (400, 25)).astype(np.uint64)
    order = repeats.multikey_sort(words)
    assert words[order].tolist() == sorted(words.tolist())


# personal data


def pii_brute(text):
    luhn = lambda s: sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    found = sorted((m.start(), o, f"{k}:{m.start()}:{m.end()}", k) for o, (k, p, good) in enumerate(kinds) for m in re.finditer(p, text or "") if good(m[0]))
    return found


def test_base_spans(spark):
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.002.003.004", "4111 1111 1111 1111", "4111-1111-1111-1111-", "+1 (017) 555-7713", "+12", "+", " ", "é", "_", "%", "99", ".", "\n", "a@b.c_d@e.fg"]
    texts = ODD + ["".join(random.choice(parts) for _ in range(random.randint(1, 9))) for _ in range(300)] + ["1 " * 3000, "9" * 3000, "a" * 20000, "a@b.c " * 2000]
    for r in pii.find(frame(spark, texts, "start int")).collect():
        base = pii_brute(texts[r.doc_id])
        told = ",".join(b[2] for b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest(), texts[r.doc_id][:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[3] == k for b in base) for k in pii.KINDS]
        assert set(told.split(",")) - {""} <= set(r.spans.split(","))


def test_bootstrapping(spark):
    texts = [f"{prose(5)} contact me at u{i}@mail.com {prose(3)}" for i in range(12)] + ["please contact me at user#4471x now", "it went by user#4471x", "look near 77123 there"]
    got = {r.doc_id: r.spans for r in pii.find(frame(spark, texts)).collect()}
    at = texts[12].index("user#")
    assert got[12] == f"id:{at}:{at + 10}" and got[13] == "" and got[14] == ""
    clean = {r.doc_id: r.text for r in pii.redact(frame(spark, texts)).collect()}
    assert clean[12] == "please contact me at [ID] now" and clean[14] == texts[14] and "[EMAIL]" in clean[0] and "@" not in clean[0]


def test_patterns_need_no_share_of_all_finds(spark):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    many = " ".join(f"{word(i)} {word(i + 9)} {word(i)}@other.org" for i in range(6000))
    texts = [f"contact me at u{i}@mail.com {prose(3)}" for i in range(5)] + ["please contact me at user#4471x now", many]
    at = texts[5].index("user#")
    assert {r.doc_id: r.spans for r in pii.find(frame(spark, texts)).collect()}[5] == f"id:{at}:{at + 10}"


def test_copies_do_not_lower_trust(spark):
    texts = [f"{prose(5)} contact me at u{i}@mail.com {prose(3)}" for i in range(12)] + ["please contact me at user#4471x now", "it went by user#4471x"]
    texts += [texts[0]] * 300
    got = {r.doc_id: r.spans for r in pii.find(frame(spark, texts)).collect()}
    at = texts[12].index("user#")
    assert got[12] == f"id:{at}:{at + 10}" and got[13] == "" and got[313] == got[0] != ""


def patterns_brute(texts):
    """Accepted patterns and the places they claim, straight from the definition."""
    label = r"[^\W\d_][\w.-]{0,39}[=:]"
    strip = lambda s: re.sub(r"^[\W_]+|[\W_]+$", "", s)
    texts = sorted(set(texts))
    total, entities = collections.Counter(), []
    for t in texts:
        words = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(t)]
        low = [w for _, _, w in words]
        total.update(f"2 {low[i - 2]} {low[i - 1]}" for i in range(2, len(low)))
        total.update(f"1 {low[i - 1]}" for i in range(1, len(low)))
        total.update(f"r {low[i + 1]}" for i in range(len(low) - 1))
        total.update("= " + m[1] for w in low if (m := re.match(rf"[\W_]*({label}).", w)))
        spans = [tuple(map(int, b[2].split(":")[1:])) for b in pii_brute(t)]
        around = lambda a, b: (next((i for i, w in enumerate(words) if w[0] <= a < w[1])), next((i for i, w in enumerate(words) if w[0] < b <= w[1])))

        def add(a, b, value, seed, base, tag):
            i, j = around(a, b)
            opened = base and re.search(r"[^\W_]", t[words[i][0] : a])
            c = ([] if opened or i < 2 else [f"2 {low[i - 2]} {low[i - 1]}"]) + ([] if opened or i < 1 else [f"1 {low[i - 1]}"]) + ([f"r {low[j + 1]}"] if j + 1 < len(low) else []) + ([f"= {tag}"] if tag else [])
            entities.append((t, a, b, value, seed, base, c))

        for a, b in spans:
            head = re.match(rf"[\W_]*({label})[\"']?$", t[words[around(a, b)[0]][0] : a])
            add(a, b, strip(t[a:b]), True, True, head and head[1].lower())
        for a, b, _ in words:
            if re.search("[0-9]", t[a:b]) and not any(x < b and a < y for x, y in spans):
                head = re.match(rf"[\W_]*({label})(?=.)", t[a:b])
                value = strip(t[a + (len(head[0]) if head else 0) : b])
                seed = bool(re.fullmatch(r"[A-Za-z0-9_+/=-]{16,}", value)) and len(re.findall("[0-9]", value)) > 2 and len(re.findall("[A-Za-z]", value)) > 2
                if value:
                    add(a + (len(head[0]) if head else 0), b, value, seed, False, head and head[1].lower())
    n = collections.Counter((c, e[3]) for e in entities for c in e[6])
    score = {e[3]: 1.0 for e in entities if e[4]}
    seeds, sure = dict(score), {}
    for _ in range(pii.ROUNDS):
        new = {}
        for c in {c for c, _ in n}:
            held = [(v, k) for (x, v), k in n.items() if x == c]
            trust = min(1.0, sum(k * score.get(v, 0) for v, k in held) / total[c])
            if sum(score.get(v, 0) for v, _ in held) >= 3 - 1e-9 and trust >= pii.CONFIDENCE[c[0]] - 1e-9:
                new[c] = trust
        done, sure, score = new == sure, new, dict(seeds)
        if done:
            break
        for c, v in n:
            if c in sure:
                score[v] = max(score.get(v, 0), sure[c])
    return sure, {(t, a, b) for t, a, b, _, _, base, c in entities if not base and any(x in sure for x in c)}


def test_graph_against_brute_force(spark):
    random.seed(23)
    code = lambda: "".join(random.choice("abcdef0123456789") for _ in range(24)) + "a1b2c3"
    texts = [f"{prose(3)} mail to u{i}@x.org today {prose(2)}" for i in range(120)] + [f'{prose(4)} token = "{code()}" {prose(2)}' for _ in range(5)] + [f"password={code()} {prose(3)}" for _ in range(4)]
    texts += [f"mail to K{i}-77 {prose(2)} see ref K{i}-77 filed" for i in range(12)] + [f"{prose(2)} see ref Z/8 filed {prose(2)}"] + ["password=abc9 done", 'token = "q7"', "email:a@b.c (c@d.eu) e@f.gh, now"]
    texts += [" ".join(random.choice(VOCABULARY + ["77", "a1", "x9:b2", "=4", "u@v.w", "1.2.3.4"]) for _ in range(40)) for _ in range(40)] + ["", "9", "u@v.w u@v.w u@v.w u@v.w", texts[0]]
    df = frame(spark, texts)
    plain = df.selectExpr("text", "xxhash64(1, text) t1", "xxhash64(2, text) t2").dropDuplicates(["t1", "t2"])
    sure = {r.context: r.trust for r in pii.accepted(pii.entities(pii._finds(plain)), plain).collect()}
    want, claimed = patterns_brute(texts)
    assert sure == pytest.approx(want) and {c[0] for c in sure} == set("12r=")
    assert any("k" in t[a:b].lower() for t, a, b in claimed) and any("z" in t[a:b].lower() for t, a, b in claimed)
    for r in pii.find(df).collect():
        got = {(int(s.split(":")[1]), int(s.split(":")[2])) for s in r.spans.split(",") if s.startswith(("id:", "secret:"))}
        assert (r.n_secret, r.n_id) == tuple(sum(s.startswith(k) for s in r.spans.split(",")) for k in ("secret:", "id:"))
        assert got == {(a, b) for t, a, b in claimed if t == texts[r.doc_id]}, texts[r.doc_id]


def test_redaction_keeps_odd_columns(spark):
    df = spark.createDataFrame([(1, "a@b.org x", 7, "p"), (2, None, 8, "q")], "doc_id long, text string, t1 long, `a.b` string")
    assert sorted(map(tuple, pii.redact(df).collect())) == [(1, "[EMAIL] x", 7, "p"), (2, None, 8, "q")]
    assert pii.redact(df).columns == df.columns


# quality


def quality_brute(rows, limit, least):
    texts = {(s, t or "") for _, t, s in rows}
    seen = collections.Counter((s, line) for s, t in texts for line in {" ".join(lowered(x)) for x in t.split("\n")} - {""})
    common = {k for k, n in seen.items() if n > limit}
    out = []
    for i, t, s in rows:
        t = t or ""
        words = WORD.findall(t)
        windows = collections.Counter(tuple(words[j : j + 3]) for j in range(len(words) - 2))
        again = {j + d for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        lost = sum(len(lowered(x)) for x in lines if (s, " ".join(lowered(x))) in common)
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        out.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed, not failed and 100 * (len(words) - lost) >= least * len(words)))
    return out


def test_quality(spark):
    boiler = "Read  MORE about our terms and cookies here"
    rows = [(i, t, "a") for i, t in enumerate(ODD)]
    for i in range(100, 160):
        lines = [prose(random.randint(1, 30)) for _ in range(random.randint(1, 5))] + ([boiler if i % 2 else boiler.lower()] * random.randint(1, 9) if i % 3 else [])
        rows.append((i, "\n".join(lines) + random.choice(["", "\n", "\n\n"]), random.choice(["a", None])))
    rows += [(500, rows[-1][1], rows[-1][2])] * 2
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_words int")
    got = quality.judge(df, max_documents=5, least_left_percent=60).drop("n_common_lines", "n_common_words").collect()
    want = quality_brute(rows, 5, 60)
    assert collections.Counter(map(tuple, got)) == collections.Counter(want) and 0 < sum(w[-1] for w in want) < len(want)
    kept = collections.Counter(w[0] for w in quality_brute(rows, 10, 25) if w[-1])
    out = quality.keep_good(df)
    assert out.columns == df.columns and collections.Counter(r.doc_id for r in out.collect()) == kept


def test_verdict_rejects_depleted_documents(spark):
    boiler = [prose(30) for _ in range(3)]
    rows = [(i, "\n".join([prose(60) + f" {i}"] + boiler[:1]), "big", 1) for i in range(200)]
    rows += [(1000 + i, "\n".join([*boiler, f"only {i} is new here"]), "big", 1) for i in range(15)]
    rows += [(2000, rows[-1][1], "big", 1), (2001, rows[-1][1], "other", 1), (2002, rows[-1][1], None, 1)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int")).collect()}
    assert all(got[i].kept and got[i].n_common_lines == 1 for i in range(200))
    assert not any(got[1000 + i].kept or got[1000 + i].base_failed for i in range(15)) and not got[2000].kept
    assert got[2001].kept and got[2002].kept


def test_common_lines_are_cut(spark):
    from quillguard.llm import corpus

    own = ["\n".join(prose(40) + f" é{i} {j}" for j in range(2)) for i in range(14)]
    texts = [f"Read MORE here\n{t}\n\n read more  HERE" if i % 2 else t.replace("\n", "\nread more here\n") + "\n" for i, t in enumerate(own)]
    want = [t + "\n" for t in own]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)] + [(50, texts[1], "en", None, 0), (None, texts[1], "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert quality.cut_lines(df.limit(0).selectExpr("*", "array(1L) l"), "text", "l").collect() == []
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus.quality_rules(spark, df, "").collect()}
    assert got == {i: (t, len(t)) for i, t in [*enumerate(want), (50, texts[1]), (None, want[1])]}


def test_empty_tables(spark):
    df = frame(spark, []).withColumnRenamed("n_words", "lang").selectExpr("doc_id", "text", "source", "cast(lang as string) lang")
    import public_tokenizers

    path = public_tokenizers.path(bpe.DEFAULT_VOCABULARY)
    for f in (quality.judge, neardup.components_of, pii.find, repeats.remove_repeats, language.identify, suffix_tree.score_documents, lambda d: bpe.encode_documents(d, path, public_tokenizers.PATTERN)):
        assert f(df).collect() == []


def test_pipeline_against_the_stages_by_hand(spark, tmp_path, tokenizer):
    import corpus_pipeline

    theirs, _ = tokenizer
    texts = [prose(80) + f" mail u{i}@x.org" for i in range(30)]
    texts += [texts[0], edited(texts[1], 1), "short", None]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    plain = {i: re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", texts[i]) for i in range(30)}
    assert {r.doc_id for r in out} <= set(range(30)) and out
    for r in out:
        ids = np.array(theirs.encode_ordinary(plain[r.doc_id]), "<u4").tobytes()
        assert (bytes(r.token_ids), r.n_chars) == (ids, len(plain[r.doc_id]))
    words = {i: len(WORD.findall(t)) for i, t in plain.items()}
    got = collections.Counter()
    for r in out:
        got[r.source] += words[r.doc_id]
    total = sum(words.values())
    shares = {"s0": total / 3, "s1": 2 * total / 3}
    assert all(abs(got[s] - t) < 100 for s, t in shares.items())
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]) == '["quality_rules", "near_duplicates", "personal_data", "mixture", "token_ids"]'


@pytest.mark.parametrize("of, columns", [(lambda df: quality.features(df), ["doc_id", "text"]), (lambda df: neardup.features(df, ("doc_id",)), ["doc_id", "text"]), (lambda df: quality.cut_lines(df, "text", "gone"), ["doc_id", "text", "gone"])])
def test_workers_hold_little_beside_a_batch(spark, monkeypatch, of, columns):
    """What a stage leaves in its workers counts beside the next stage's heap: it must not follow the size of a batch."""
    df, ran = spark.createDataFrame([], "doc_id long, text string, gone array<long>"), []
    made = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **b: ran.append(f) or made(self, f, *a, **b))
    of(df)
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" + "\n" * (k % 9 == 0) for k in range(400)) for _ in range(2000)]
    all_columns = {"doc_id": pa.array(range(2000)), "text": pa.array(texts), "gone": pa.array([[]] * 2000, pa.list_(pa.int64()))}
    batch = pa.RecordBatch.from_pydict({c: all_columns[c] for c in columns})
    monkeypatch.setattr(tb, "_powers", {})
    tracemalloc.start()
    try:
        assert sum(out.num_rows for out in ran[0](iter([batch]))) == 2000
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()


def test_full_memory_keeps_what_is_in_use(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 4)
    coder = bpe.Coder(bpe.load_ranks(public_tokenizers.path(bpe.DEFAULT_VOCABULARY)), public_tokenizers.PATTERN)
    made = []
    pack = coder.pack_piece
    coder.pack_piece = lambda piece: made.append(piece) or pack(piece)
    coder.encode("x qwxzv aab bbc ccd")
    coder._pieces.clear()
    coder.encode("x ddeq qwxzv")
    assert made.count(" qwxzv") == 1 and len(coder._chunks) <= 4
    for text in ("x qwxzv aab", "naïve çava 数据 123abc", "don't  stop\n\n x", ""):
        assert coder.decode(coder.encode(text)) == text.encode() and coder.encode(text) == b"".join(int(i).to_bytes(4, "little") for p in coder.split(text) for i in coder.merged(p.encode()))
