"""The filter audit and its tries against brute force, with ranges of few characters."""

import collections
import itertools
import random
import re

import pytest

from rankloom.llm.filter_audit import FILTERS, Trie, filter_audit, range_cuts, text_flags

SCHEMA = "doc_id long, text string, lang string, mask string, part string, rows double"
LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tests = (
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        bool(re.search(r"[#$%&*|]", text)),
    )
    return {f for f, t in zip(FILTERS, tests) if t}


def brute(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    rows = []
    for i, text, lang in docs:
        f = fails(text or "")
        if any((t or "") == (text or "") and j is not None and (i is None or j < i) for j, t, _ in docs):
            f.add("E")
        rows.append((i, lang or "", f))
    shares = collections.Counter()
    out = {}
    for order in itertools.permutations(FILTERS):
        left = list(rows)
        for step, x in enumerate(order, 1):
            gone = [r for r in left if x in r[2]]
            left = [r for r in left if x not in r[2]]
            for part in {r[1] for r in rows}:
                mine = [r for r in gone if r[1] == part]
                shares[part, x] += len(mine)
                before = set(order[: step - 1])
                out[part, "".join(order), step] = [
                    sum(r[1] == part for r in left), len(mine), sum(r[1] == part and x in r[2] and bool(r[2] & before) for r in rows),
                    sum(r[1] == part and r[2] == {x} for r in rows), sum(r[0] in good for r in mine), sum(r[0] in toxic for r in mine),
                ]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels, **options):
    df = spark.createDataFrame([(*d, "m", "p", 0.5) for d in docs], SCHEMA)
    rows = filter_audit(df, spark.createDataFrame(labels, LABELS), **options).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_is_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcX") for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.choice((3, 30, 199, 200, 260)))) + rng.choice(("", "", " #", "\n")) for _ in range(40)]
    texts += ["same start " * 40 + w for w in ("", "a", "b", "ab")] + ["", None, " \t", "É" * 300, "ÉA", "x"]
    docs = [(rng.randint(1, 400), rng.choice(texts), rng.choice(("en", "de", None, ""))) for _ in range(150)]
    docs += [(None, texts[0], "en"), (None, "only here", "en"), (None, "only here", "en"), docs[0], docs[1], docs[1]]
    docs += [(i, "copy", "en") for i in range(500, 540)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 500, 2)] + [(2, 1, 0), (None, 1, 1)]
    want = brute(docs, labels)
    for chars in (60, 1 << 24):
        assert audited(spark, docs, labels, range_chars=chars) == want
    assert audited(spark, [], labels) == {}
    assert set(audited(spark, [(1, None, None)], [])) == {("", "".join(o), k) for o in itertools.permutations(FILTERS) for k in range(1, 6)}


def test_batches_and_ranges_do_not_matter(spark):
    docs = [(i, f"text {i % 7}" if i % 3 else "hot", "en") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = text_flags(df, range_chars=40).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sum(r.rows for r in rows) == 300
    assert {r.doc_id for r in rows if not r.mask & 16} == {min(i for i, u, _ in docs if u == t) for t in {t for _, t, _ in docs}}


def test_cuts_part_what_short_prefixes_do_not(spark):
    shared = "All rights reserved. " * 30
    docs = spark.createDataFrame([(shared + f"{i:04d}",) for i in range(200)] + [("copy " * 50,)] * 500 + [(f"{i}",) for i in range(50)], "text string")
    cuts = range_cuts(docs, range_chars=20_000)
    assert cuts == sorted(cuts) and any(c.startswith(shared) for c in cuts)
    assert sum(c.startswith("copy") for c in cuts) <= 1


@pytest.mark.parametrize("seed", range(5))
def test_trie(seed):
    rng = random.Random(seed)
    trie, least = Trie(), {}
    for _ in range(3000):
        text, value = "".join(rng.choice("abé") for _ in range(rng.randint(0, 7))) * rng.choice((1, 1, 9)), rng.randint(0, 99)
        least[text] = min(value, least.get(text, value))
        assert trie.insert(text, value) == least[text]
