import random

from runledger.llm.longest_match import LongestMatch, byte_level_automaton, count_tokens, tokenizer_path


def greedy(word, begin, go_on):
    n = i = 0
    while i < len(word):
        pieces = go_on if i else begin
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return 1
        i, n = j, n + 1
    return n


def test_random_vocabularies_equal_greedy():
    rng = random.Random(1)
    word = lambda most: bytes(rng.choice(b"abc") for _ in range(rng.randint(0, most)))
    for turn in range(1500):
        begin, go_on = ({word(5) for _ in range(rng.randint(1, 8))} - {b""} for _ in range(2))
        if turn % 2:
            go_on |= {b"a", b"b", b"c"}
        automaton = LongestMatch(begin, go_on)
        for _ in range(15):
            w = word(12)
            assert automaton.count(w) == greedy(w, begin, go_on), (w, begin, go_on)


def test_long_word_is_linear():
    automaton = byte_level_automaton(tokenizer_path())
    assert automaton.count(b"ab" * 200_000) > 0


def test_documents(documents):
    texts = ["a b  c", None, "", " \n ", "thththeé café", "z" * 2000]
    docs = documents(texts)
    out = count_tokens(docs)
    assert out.columns == [*docs.columns, "n_words", "n_tokens"]
    rows = {r["doc_id"]: r for r in out.collect()}
    automaton = byte_level_automaton(tokenizer_path())
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        assert (rows[i]["n_words"], rows[i]["n_tokens"]) == (len(words), sum(map(automaton.count, words)))
    assert count_tokens(docs.limit(0)).count() == 0
