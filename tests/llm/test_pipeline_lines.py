import corpus_pipeline as P


def test_line_in_a_small_share_of_a_hot_source_is_removed(documents):
    letters = str.maketrans("0123456789", "abcdefghij")  # digits are read as 0
    body = lambda i: " ".join(f"w{i}x{k}".translate(letters) for k in range(60))
    # 5 % of the hot source's 800 texts (40) share one line; 20 share another, which is not above the count.
    texts = [("shared line\n" if i % 20 == 0 else "rare line\n" if i % 40 == 1 else "") + body(i) for i in range(800)]
    out = {r["doc_id"]: r["text"] for r in P.quality_rules(None, documents(texts), "").collect()}
    assert len(out) == 800
    assert all(out[i] == (body(i) if i % 20 == 0 else texts[i]) for i in range(800))
