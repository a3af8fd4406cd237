import random
import re

from runledger.llm.line_frequency import LineLimits, clean_documents, line_verdicts


def brute(texts, hosts, limits):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    normal = lambda x: re.sub(r"[ \t\x0b\f\r]+", " ", re.sub("[1-9]", "0", x.lower())).strip(" ")
    seen, sizes = {}, {}
    for t, s in zip(texts, hosts, strict=True):
        sizes.setdefault(s, set()).add(t)
        for x in (t or "").split("\n"):
            if normal(x):
                seen.setdefault((s, normal(x)), set()).add(t)
    often = {k for k, v in seen.items() if len(v) > limits.min_docs and len(v) ** 2 > len(sizes[k[0]])}
    out = []
    for t, s in zip(texts, hosts, strict=True):
        w = split(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        rep = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        gone = [x for x in lines if (s, normal(x)) in often]
        n_gone = sum(len(split(x)) for x in gone)
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        out.append(
            (
                len(w),
                sum(map(len, w)),
                sum(c in "#*$%&|<>" for c in t or ""),
                len(lines) - len(set(lines)),
                len(rep),
                failed,
                n_gone,
                not failed and len(w) - n_gone >= limits.min_left * len(w),
            )
        )
    return out, often, normal


def fixture():
    rng = random.Random(5)
    vocab = [f"w{i}é" for i in range(400)] + ["#a", "B|b", "x<y"]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    common, boiler = line(6), [line(20) for _ in range(5)]
    texts, hosts = [], []
    for i in range(120):
        parts = [line(rng.randint(1, 30)) for _ in range(rng.randint(0, 6))]
        if i % 3 == 0:
            parts.insert(0, common.upper() if i % 2 else common + " ")
        if i % 10 == 1:
            parts = boiler + [line(3 + i % 7)]
        if i % 15 == 2:
            parts += parts[:2] + ["", " \t", "a b c a b c a b c"]
        texts.append("\n".join(parts))
        hosts.append(None if i % 11 == 0 else f"h{i % 2}")
    texts += [None, "", " \n\t", texts[3], texts[3], texts[3], "x" * 5000 + " y"]
    hosts += ["h0"] * 7
    return texts, hosts


LIMITS = LineLimits(min_docs=4, min_left=0.3)


def test_verdicts_equal_brute_force(documents):
    texts, hosts = fixture()
    want, often, _ = brute(texts, hosts, LIMITS)
    got = {r["doc_id"]: tuple(r)[1:] for r in line_verdicts(documents(texts, hosts=hosts), LIMITS).collect()}
    assert often and any(w[6] for w in want) and any(not w[5] and not w[7] for w in want)
    assert [got[i] for i in range(len(texts))] == want


def test_cleaned_texts_and_columns(documents):
    texts, hosts = fixture()
    want, often, normal = brute(texts, hosts, LIMITS)
    docs = documents(texts, hosts=hosts)
    out = clean_documents(docs, LIMITS)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == {i for i, w in enumerate(want) if w[7]}
    for i, r in got.items():
        left = "\n".join(x for x in texts[i].split("\n") if (hosts[i], normal(x)) not in often)
        assert (r["text"], r["n_chars"], r["row_key"]) == (left, len(left), "row_key")


def test_copies_do_not_flag_their_own_lines(documents):
    text = " ".join(f"w{i}" for i in range(80))
    rows = line_verdicts(documents([text] * 60 + ["a b"] * 3), LineLimits(min_docs=2)).collect()
    assert sum(r["kept"] for r in rows) == 60 and not any(r["n_removed_words"] for r in rows)


def test_repeated_rows_and_empty_table(documents):
    text = " ".join(f"w{i}" for i in range(80))
    rows = line_verdicts(documents([text] * 3, ids=[7, 7, None])).collect()
    assert len(rows) == 3 and all(r["kept"] for r in rows)
    assert line_verdicts(documents(["x"]).limit(0)).count() == 0
    assert clean_documents(documents(["x"]).limit(0)).count() == 0


def test_no_python_on_the_main_path(documents):
    plan = line_verdicts(documents(["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_a_line_in_a_small_share_of_a_hot_host_is_removed(documents):
    letters = str.maketrans("0123456789", "abcdefghij")  # digits are read as 0
    body = lambda i: " ".join(f"w{i}x{k}".translate(letters) for k in range(60))
    # of 800 texts 40 share one line; 25 share another: above the count, but not above the root of 800
    texts = [("shared line\n" if i % 20 == 0 else "rare line\n" if i % 32 == 1 else "") + body(i) for i in range(800)]
    got = {r["doc_id"]: r["n_removed_words"] for r in line_verdicts(documents(texts)).collect()}
    assert all(got[i] == (2 if i % 20 == 0 else 0) for i in range(800))


def test_a_very_long_text_of_many_lines(documents):
    lines = [f"line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(15_000)]
    texts = ["\n".join(lines)] + ["\n".join(lines[:5000]) + f"\nown {chr(97 + k)}" for k in range(10)]
    out = {r["doc_id"]: r["text"] for r in clean_documents(documents(texts), LineLimits(min_docs=4, min_left=0.0)).collect()}
    assert out[0] == "\n".join(lines[5000:]) and out[3] == "own c"
