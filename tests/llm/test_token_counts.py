import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import token_counts as T
from docquarry.llm.tokens import DEFAULT_VOCAB, PATTERN, read_ranks


def brute(text, scores):
    """The best segmentation of every pre-token by itself."""
    return sum(best_count(word.encode(), scores) for word in regex.findall(PATTERN, text))


def best_count(raw, scores, longest=10**9):
    best = [(0.0, 0)] + [(-float("inf"), 0)] * len(raw)
    for end in range(1, len(raw) + 1):
        for start in range(max(0, end - longest), end):
            score = scores.get(raw[start:end])
            if score is not None and best[start][0] + score > best[end][0]:
                best[end] = (best[start][0] + score, best[start][1] + 1)
    return best[-1][1]


TEXTS = ["hello world", "  two  spaces ", "naïve café — 12,345 it's", "a\nb\tc", "日本語 text", "x" * 400, "", " ", "unbelievableness unbelievable unbeliever"]


def test_counts_equal_brute_force(make):
    scores = T.zipf_scores(read_ranks(DEFAULT_VOCAB))
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1]), (None, "hello"), (50, None)]
    got = sorted(((r.doc_id, r.n_tokens) for r in T.token_counts(make(rows, clash=True)).collect()), key=repr)
    assert got == sorted(((i, None if t is None else brute(t, scores)) for i, t in rows), key=repr)


def test_shared_prefixes_are_scored_once():
    pieces = T.Backwards({bytes([b]): -1.0 for b in range(256)} | {b"ab": -1.5})
    counts, nodes = T.trie_counts([b"abc", b"abd"], pieces)
    assert counts.tolist() == [2, 2] and nodes == 1 + 4


words_of = st.lists(st.text("abcé\0", max_size=12).map(str.encode), max_size=30)


@settings(max_examples=60, deadline=None)
@given(words_of, st.sets(st.text("abc", min_size=1, max_size=4).map(str.encode), max_size=12), st.randoms(use_true_random=False))
def test_trie_and_long_words_equal_brute_force(words, extra, random):
    scores = {bytes([b]): -5.0 - b / 999 for b in range(256)} | {p: -random.choice([1.0, 2.0, 2.5, 6.0]) for p in extra}
    pieces = T.Backwards(scores)
    expected = [best_count(w, scores) for w in sorted(set(words))]
    assert T.trie_counts(sorted(set(words)), pieces)[0].tolist() == expected
    assert [T.long_count(w, pieces) for w in sorted(set(words)) if w] == [n for n, w in zip(expected, sorted(set(words))) if w]


def test_long_words_equal_brute_force_over_several_windows():
    scores = T.zipf_scores(read_ranks(DEFAULT_VOCAB))
    word = ("abracadabra" * 2000).encode()
    assert T.long_count(word, T.unigram_counter()._pieces) == best_count(word, scores, 16)


def test_memo_is_bounded_by_bytes():
    counter = T.UnigramCounter(DEFAULT_VOCAB)
    expected = counter.counts(pa.array(TEXTS)).tolist()
    counter._memo._most = 300
    for _ in range(3):
        assert [counter.counts(pa.array([t]))[0] for t in TEXTS] == expected
        assert len(counter._words) <= 12
    # Neither double spaces nor blanks at the ends make a whole text an entry.
    counter = T.UnigramCounter(DEFAULT_VOCAB)
    counter.counts(pa.array([f" lorem  ipsum{i} " * 2000 for i in range(50)]))
    assert counter._memo.used < 50_000


def test_unbroken_words_and_empty_table(make):
    text = "x" * 300_000 + " " + "é" * 3000
    counter = T.UnigramCounter(DEFAULT_VOCAB)
    assert counter.counts(pa.array([text]))[0] > 1000 and counter._memo.used < 1000


def test_long_text_and_empty_table(make):
    text = "word " * 60_000
    assert T.token_counts(make([(1, text)])).collect()[0].n_tokens > 60_000
    assert T.token_counts(make([])).count() == 0
