"""Candidates of the secret scan by brute force, and texts with very many of them."""

import random
import re

import pytest

from rankloom.llm import secrets


def brute(text):
    """Start, end, token, sides and covered share of each candidate, character by character."""
    inside = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    spans, k = [], 0
    while k < len(text):
        if text[k] not in inside:
            k += 1
            continue
        end = k
        while end < len(text) and text[end] in inside:
            end += 1
        if end - k >= 16 and any(c.isdigit() for c in text[k:end]):
            stop = end
            while stop < len(text) and stop < end + 2 and text[stop] == "=":
                stop += 1
            spans.append((k, stop))
            end = stop
        k = end
    gaps, at = [], 0
    for a, b in spans:
        gaps.append(text[at:a])
        at = b
    gaps.append(text[at:])
    words = set(re.split("[^a-z]+", " ".join(gaps).lower()))
    out = []
    for n, (a, b) in enumerate(spans):
        runs = [w for w in re.split("[^a-z]+", text[a:b].lower()) if len(w) >= 3 and w in words and w not in secrets.SECRET_WORDS]
        out.append((a, b, text[a:b], gaps[n][-48:], gaps[n + 1][:48], round(sum(map(len, runs)) / (b - a), 9)))
    return out


def test_candidates_are_brute_force(spark):
    rng = random.Random(4)
    piece = lambda: "".join(rng.choice("abcdeXYZ019+/_-") for _ in range(rng.randint(1, 40)))
    words = ["the", "token", "path", "é", "=", "==", "abc", "'", " ", "\n", "0"]
    texts = ["".join(rng.choice((piece(), rng.choice(words), rng.choice(words))) + rng.choice((" ", "", "=", ": ")) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += ["the_path_the_path_77 the path", "abcdefgh12345678", "abcdefgh12345678===", "x" * 15 + "1", "x" * 16, "é" * 50 + "A" * 15 + "1" + "é" * 50]
    docs = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (99, None), (99, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.start, r.end, r.token, r.left, r.right, round(r.covered, 9)) for r in secrets.candidates(df).collect()), key=str)
    assert got == sorted(((i, *c) for i, t in docs if t for c in brute(t)), key=str) and len(got) > 100


@pytest.mark.parametrize("n", [100_000])
def test_a_text_with_very_many_candidates(spark, n):
    """They become many narrow rows, not as many copies of the text."""
    text = " ".join(f"word{k % 7} {k:06d}abcdefwordXY{k:06d}" for k in range(n))
    found = secrets.candidates(spark.createDataFrame([(1, text), (2, "k = 0123456789abcdef")], "doc_id long, text string"))
    last = found.where("doc_id = 1").orderBy("start", ascending=False).first()
    assert found.count() == n + 1 and text[last.start : last.end] == last.token and last.end == len(text) and last.covered == 0
