import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from specweave.llm.token_count import PieceVocabulary, count_batch, count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
CASES = ["", " ", "  ", "   a", "a   b  c ", "▁a▁ b", "a\nb\n\n c\t", "<s>hi</s> <unk>", "\x00a", "é ﬁ \U0001f600\U0001f600", "x" * 500, "ab" * 300, " " * 100 + "word" + " " * 37, "aaa" * 77 + "haha" * 50, "中文" * 40, "1234567890" * 20, "=" * 99, "the end", "Donaudampfschiffahrtsgesellschaft" * 9]


@pytest.fixture(scope="module")
def both():
    return PieceVocabulary(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_counts_equal_the_library(both):
    mine, library = both
    assert count_batch(mine, pa.array(CASES)).tolist() == [len(library.encode(t)) for t in CASES]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁\nabcdehilnorst-=.0123'"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=6))
def test_any_text(both, texts):
    mine, library = both
    assert count_batch(mine, pa.array(texts)).tolist() == [len(library.encode(t)) for t in texts]


def test_long_random_letters(both):
    mine, library = both
    text = "".join(np.random.default_rng(1).choice(list("etaoinshr"), 30_000))
    assert count_batch(mine, pa.array([text])).tolist() == [len(library.encode(text))]


def test_nulls_repeats_and_other_columns(spark):
    rows = [(1, "a b", 5), (None, None, 6), (1, "a b", 7), (2, "", 8)]
    out = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH, 2).collect()
    assert [tuple(r) for r in out] == [(1, 3, 2, False), (None, 0, 0, False), (1, 3, 2, False), (2, 0, 0, False)]
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
