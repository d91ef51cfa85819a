"""Collocations against brute force with a low count, so that longer phrases, drops and ties occur."""

import collections
import random
import re

import pytest

from rankloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, w1 long, a string, score double"


def brute(docs, top, least):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, c in counts.items():
        found = []
        for p, a in c.items():
            if len(p) == 1 or a < least:
                continue
            if any(n >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, n in c.items()):
                continue
            score, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, n, p.decode(), -a, l, r, total[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def mined(spark, docs, top, least):
    df = spark.createDataFrame([(i, t, lang, 1, "x", 0.5) for i, (t, lang) in enumerate(docs)], SCHEMA)
    return sorted(map(tuple, phrases.collocations(df, top=top, min_count=least).collect()))


@pytest.mark.parametrize("top", [3, 20, 1000])
def test_phrases_are_brute_force(spark, top):
    rng = random.Random(top)
    words = ["a", "b", "C", "c", "éa", "ÉA", "x-y", "q", "\x1c", " "]
    fixed = ["new york city hall now", "a a a a", "as well as", "b new york"]
    docs = []
    for _ in range(60):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 12))]
        docs.append((rng.choice((" ", "  ", "\t")).join(parts).replace("now", rng.choice(("now.", "now", "now\n"))), rng.choice(("en", "de", None, "und", ""))))
    docs += [(None, "en"), ("", None), ("...;\r\n", "de"), docs[0], docs[0]]
    want = brute(docs, top, 3)
    assert max(len(p[2].split(" ")) for p in want) == 5 or top < 1000
    assert mined(spark, docs, top, 3) == want


def test_nothing_is_frequent(spark):
    assert mined(spark, [], 5, 2) == mined(spark, [("one two", "en"), (None, None)], 5, 2) == mined(spark, [("a. a. a", "en")], 5, 2) == []


def test_the_other_numbers_of_words_tell_words_and_languages_apart():
    import numpy as np

    data = np.frombuffer(b"one two ONE", np.uint8)
    starts, ends = np.array([0, 4, 8]), np.array([3, 7, 11])
    for seed in (0, 1, 2):
        en, de = (phrases._numbers(data, starts, ends, phrases._lang_hash([x] * 3), seed) for x in ("en", "de"))
        assert en[0] == en[2] != en[1] and not set(en.tolist()) & set(de.tolist())
