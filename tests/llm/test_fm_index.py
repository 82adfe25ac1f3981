"""The index's parts against plain answers, and the steps that a search takes."""

import numpy as np

from topicpulse.llm.fm_index import FMIndex, WaveletMatrix, suffix_order


def test_suffix_order_of_repeating_texts():
    random = np.random.default_rng(5)
    for n in (1, 2, 3, 40, 300):
        text = random.integers(1, 3, n)
        ends = np.unique(np.append(random.integers(0, n, n // 20), n - 1))
        text[ends] = 0
        symbol = [int(x) + len(ends) for x in text]
        for i, e in enumerate(ends):
            symbol[e] = i
        assert suffix_order(text, ends).tolist() == sorted(range(n), key=lambda i: symbol[i:])


def test_wavelet_matrix_takes_a_step_for_four_bits_of_a_symbol():
    random = np.random.default_rng(6)
    for largest in (1, 15, 16, 5000, 70000):
        symbols = random.integers(0, largest + 1, 700)
        matrix = WaveletMatrix(symbols, largest)
        assert matrix.levels == max(-(-largest.bit_length() // 4), 1)
        asked, at = random.choice(symbols, 300), random.integers(0, 701, 300)
        assert matrix.rank(asked, at).tolist() == [int((symbols[:p] == s).sum()) for s, p in zip(asked, at, strict=True)]


def test_own_words_are_searched_without_a_look_up():
    random = np.random.default_rng(7)
    words = random.integers(0, 3, 400).astype(np.uint64)
    lengths, owners = np.full(20, 20), random.integers(0, 9, 20)
    index = FMIndex(words, lengths, owners)
    assert index.spelled.tolist() == index.symbols(words).tolist()
    twice = [np.concatenate([x, x]) for x in (index.spelled, lengths)]
    got = index.covered(*twice, np.concatenate([owners, owners + 3]), 8)
    apart = [index.covered_windows(words, lengths, r, 8) for r in (owners, owners + 3)]
    assert got.tolist() == np.concatenate(apart).tolist() and got.any()
