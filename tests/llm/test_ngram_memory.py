"""A task of the n-gram join gives back what its worker kept."""

from valora.llm import ngram_join as N


def test_words_are_given_back():
    N.shingles(b"one two three four", 3)
    assert N._WORDS
    N._give_back()
    assert not N._WORDS and len(N.shingles(b"one two three four", 3)) == 2
