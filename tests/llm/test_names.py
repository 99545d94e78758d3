"""Columns of any name: dotted, with back quotes, and named like those the operators use."""

import public_tokenizers
import pytest

from quillguard.llm import bpe, language, neardup, pii, quality, repeats, setjoin, sharding, suffix_tree

ID, TEXT, HOST = "doc.id", "the `text`", "so.urce"
OTHERS = {"t1__": "p", "t1": "q", "cid": "r", "hit": "s", "k": "t", "text": "u", "__text": "v", "c0": "w", "label": "x"}
LONG = " ".join(f"word{i % 70} of{i}" for i in range(90))


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(1, LONG, "a"), (2, LONG + " more", "a"), (3, "short mail a@b.org", "b"), (None, None, None), (5, "", "b")]
    names = ", ".join(f"`{n}` {t}" for n, t in ((ID, "long"), (TEXT.replace("`", "``"), "string"), (HOST, "string"), *((n, "string") for n in OTHERS)))
    return spark.createDataFrame([(*r, *OTHERS.values()) for r in rows], names)


def others(rows):
    return all(r[n] == v for r in rows for n, v in OTHERS.items())


def test_kept_columns_stay_as_they_are(frame):
    good = quality.keep_good(frame, TEXT, HOST)
    assert good.columns == frame.columns and {r[ID] for r in good.collect()} == {1, 2} and others(good.collect())
    one = neardup.keep_one(frame, ID, TEXT)
    assert one.columns == frame.columns and {r[ID] for r in one.collect()} == {1, 3, None, 5} and others(one.collect())
    red = pii.redact(frame, TEXT)
    assert red.columns == frame.columns and {r[ID]: r[TEXT] for r in red.collect()}[3] == "short mail [EMAIL]" and others(red.collect())


def test_ids_and_texts_of_any_name(frame):
    ids = lambda df, c="doc_id": {r[c] for r in df.collect()}
    every = {1, 2, 3, 5, None}
    assert ids(neardup.components_of(frame, ID, TEXT)) == ids(setjoin.components_of(frame, ID, TEXT)) == every
    assert ids(sharding.interleave(frame, id_col=ID, text_col=TEXT, source_col=HOST)) == every
    assert ids(language.identify(frame, ID, TEXT, HOST)) == every
    assert ids(pii.find(frame, ID, TEXT)) == ids(quality.judge(frame, TEXT, HOST, ID)) == every
    assert ids(suffix_tree.score_documents(frame, ID, TEXT)) == ids(repeats.remove_repeats(frame, ID, TEXT)) == every
    coded = bpe.encode_documents(frame, public_tokenizers.path(bpe.DEFAULT_VOCABULARY), public_tokenizers.PATTERN, TEXT, (ID, "t1__", HOST), with_ids=False)
    assert coded.columns[:3] == [ID, "t1__", HOST] and ids(coded, ID) == every


def test_another_pattern_is_not_split_by_white_space():
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.DEFAULT_VOCABULARY))
    whole, shipped = bpe.Coder(ranks, r"(?s).+"), bpe.Coder(ranks, public_tokenizers.PATTERN)
    assert not whole.cuts and shipped.cuts
    assert whole.decode(whole.encode("of the people\nby the people")) == b"of the people\nby the people"
    assert whole.encode("of the people") == whole.pack("of the people")
