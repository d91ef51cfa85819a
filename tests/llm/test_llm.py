"""The training-data operators against brute force, round trips and odd input."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm import code_search, exact_dedup, line_dedup, mixing, packing, pii, secrets, simhash, suffix_tree_lm, toxicity
from rankloom.llm import queries as llm_queries
from rankloom.llm.components import components

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, score double, key string, rows long, _gone long, component string"
ODD = [
    (1, "Hello  world\tagain", "a"), (2, "Hello world again", "a"), (3, None, "a"), (4, "", None), (5, "", "b"), (5, "", "b"),
    (None, "Hello world again", "b"), (7, "x " * 30000, "b"), (8, "one", "a"), (9, "\x0b \x0c\r\n", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names that the operators use inside."""
    return spark.createDataFrame([(*r, 0.5, "k", 1, 2, "c") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = llm_queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    result = con.execute(llm_queries.oracle_sql()[name])
    names = [x[0] for x in result.description]
    show = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    assert sorted(tuple(show(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(show(r[names.index(c)]) for c in cols) for r in result.fetchall())


def test_exact_dedup(odd, empty):
    for every in (True, False):
        rows = exact_dedup.exact_dedup(odd, hash_all=every).collect()
        assert len(rows) == len(ODD)
        by = collections.defaultdict(list)
        for r in rows:
            by[r.doc_id].append(r)
        assert [by[i][0].keep_id for i in (1, 2, None, 3, 4, 5, 7)] == [1, 1, 1, 3, 3, 3, 7]
        assert by[3][0].group_size == 4 and not by[None][0].kept and by[9][0].keep_id == 9
        if every:
            assert by[2][0].text_sha256 == hashlib.sha256(b"Hello world again").hexdigest()
    assert [r.kept for r in by[5]] == [False, False]
    twice = odd.where("doc_id is null or doc_id > 5").union(odd.where("doc_id = 8"))  # an id and its text repeated
    kept = [(r.doc_id, r.kept) for r in exact_dedup.exact_dedup(twice).collect()]
    assert sorted(x for x in kept if x[0] == 8) == [(8, False), (8, True)]
    for df in (odd, twice):
        left = exact_dedup.deduplicated(df)
        assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect() if r.doc_id) == ([1, 3, 7, 8, 9] if df is odd else [7, 8, 9])
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_mixing(odd, empty, docs):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(empty).count() == 0
    first, again = (sorted(map(tuple, mixing.mix(docs.repartition(n)).collect())) for n in (1, 5))
    assert first == again
    sums = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("want"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.want) <= r.m for r in sums)
    weighted = mixing.mix(docs, importance=F.when(F.col("lang") == "en", 2.0).otherwise(0.5)).where("copies > 0").count()
    assert weighted > 0


def test_tokenizer_and_packing(spark, odd, empty, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text for r in docs.limit(60).collect()}
    texts |= {-1: "it's I'LL 12 34á é <|endoftext|> a<|endoftext|>B <|ENDOFTEXT|> \x1cx\x1d y À İI ŉ × ﬁ Σας 日本", -2: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = collections.defaultdict(dict)
    for r in packing.tokenise(df, 256).collect():
        got[r.doc_id][r.start] = np.frombuffer(bytes(r.ids), "<u4").tolist()
    for i, text in texts.items():
        ids = plain.encode(text, add_special_tokens=False).ids + [2]
        assert list(itertools.chain.from_iterable(got[i][k] for k in sorted(got[i]))) == ids
        assert all(len(p) == min(256, len(ids) - k) for k, p in got[i].items())
    for name, options in (("word_bpe_49k.json", {"plain_specials": True}), ("byte_bpe_50k.json", {})):  # ordinary text, and another vocabulary
        other = Tokenizer.from_file(public_tokenizers.path(name))
        other.encode_special_tokens = bool(options)
        ids = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in packing.tokenise(df, 1 << 20, public_tokenizers.path(name), **options).collect()}
        assert ids == {i: other.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}
    often = spark.createDataFrame([(None if i % 2 else 3, "a b c") for i in range(2000)], "doc_id long, text string")
    spread = packing.pack(packing.checkpoint(packing.tokenise(often).drop("ids")), shard_rows=100).groupBy((F.col("sequence_id") / (1 << 32)).cast("int").alias("shard")).count().collect()
    assert len(spread) == 20 and max(r["count"] for r in spread) < 200
    packed = packing.pack_documents(odd).collect()
    spans = collections.defaultdict(list)
    for r in packed:
        spans[r.sequence_id].append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r.length for r in packed if r.doc_id == 3) == 1
    assert packing.pack_documents(empty).count() == 0
    lengths = np.sort(np.random.default_rng(0).integers(1, 65, 500))[::-1]
    number, offset = packing.best_fit_decreasing(lengths, 64)
    open_windows: list[int] = []
    for length, n, o in zip(lengths, number, offset):  # the tightest open window, checked by looking at all
        fits = [64 - u for u in open_windows if 64 - u >= length]
        if fits:
            assert 64 - open_windows[n] == min(fits) and o == open_windows[n]
            open_windows[n] += length
        else:
            assert n == len(open_windows) and o == 0
            open_windows.append(int(length))
    sizes = [len(r.ids) for r in packing.sequences(df, 256).collect()]
    assert all(n == 256 or n & (n - 1) == 0 for n in sizes)


def test_simhash(spark, odd, empty):
    base = random.Random(3)
    fps = {base.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:40]:
        fps |= {f ^ 1 << base.randrange(64) ^ 1 << base.randrange(64) for _ in range(8)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
            parent[root(a)] = root(b)
    want = {frozenset(g) for g in _groups(parent, root)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for crowd in (64, 0):  # 0 sends everything through the hubs
        links = simhash.fingerprint_links(df, 2, crowd).collect()
        mine = {f: f for f in fps}

        def top(x):
            while mine[x] != x:
                x = mine[x]
            return x

        for r in links:
            mine[top(r.a)] = top(r.b)
        assert {frozenset(g) for g in _groups(mine, top)} == want
    text = "The quick brown Fox jumps"
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(3)]
    bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert simhash.fingerprint(text) % (1 << 64) == bits and simhash.fingerprint(" ") == 0
    got = simhash.near_duplicates(odd).collect()
    by = {r.doc_id: r.component_id for r in got}
    assert len(got) == len(ODD) and by[2] == by[None] == 1 and by[3] == by[4] == by[5] == by[9] == 3
    assert simhash.near_duplicates(empty).count() == 0


def _groups(parent, root):
    groups = collections.defaultdict(set)
    for f in parent:
        groups[root(f)].add(f)
    return groups.values()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100


def _classes(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    return {frozenset(g) for g in _groups(parent, root)}


def test_line_dedup(spark, odd, empty, monkeypatch):
    rnd = random.Random(2)

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            q = [i]
            for j, e in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != e)))
            p = q
        return p[-1]

    for _ in range(500):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        e, most = distance(a, b), rnd.randint(0, 4)
        assert line_dedup.edit_distance_within(a, b, most) == (e if e <= most else None)

    def changed(x, k):
        for _ in range(k):
            i, o = rnd.randrange(len(x)), rnd.randint(0, 2)
            x = x[:i] + (rnd.choice("xyz") if o != 1 else "") + x[i + (o != 2) :]
        return x

    seeds = ["".join(rnd.choice("abcde fghi") for _ in range(rnd.randint(42, 60))) for _ in range(8)]
    lines = [changed(s, rnd.randint(0, 3)) for s in seeds for _ in range(6)] + [changed(seeds[0], 2) for _ in range(20)]
    docs = spark.createDataFrame([(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(len(lines) // 4)], "doc_id long, text string")
    pool = sorted({x for x in lines if len(x) >= 40})
    ids = {x: xxhash.xxh64_intdigest(x, 42) for x in pool}
    ids = {x: v - (1 << 64) if v >> 63 else v for x, v in ids.items()}
    want = {tuple(sorted((ids[a], ids[b]))) for a, b in itertools.combinations(pool, 2) if distance(a, b) <= 2}
    degree = collections.Counter(itertools.chain.from_iterable(want))
    classes = _classes(want)
    for crowd, block in ((32, 512), (3, 512), (0, 2)):
        monkeypatch.setattr(line_dedup, "BLOCK_LINES", block)
        got = line_dedup.line_links(docs, crowd=crowd).collect()
        assert sum((collections.Counter({r.line_id: r.links}) for r in got), collections.Counter()) == degree
        edges = {tuple(sorted((r.line_id, r.other))) for r in got if r.other is not None}
        assert edges <= want and _classes(edges) == classes
    a = "".join(rnd.choice("abcdefgh ") for _ in range(100_000))
    assert line_dedup.edit_distance_within(a, "x" + a[1:-1] + "y", 2) == 2 and line_dedup.edit_distance_within(a, a[1:] + "y", 1) is None
    for most in (1, 2, 4):
        short, long = (["".join(rnd.choice("ab") for _ in range(n)) for _ in range(9)] for n in (12, 12 + most))
        assert line_dedup.within_matrix(short, long, most).tolist() == [[distance(a, b) <= most for b in long] for a in short]
    clean = line_dedup.without_repeated_lines(odd)
    assert clean.columns == odd.columns and clean.count() == len(ODD)
    assert line_dedup.line_classes(empty).count() == 0
    twice = spark.createDataFrame([(2, "short\n" + "z" * 50 + "\nend"), (1, "z" * 50)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.without_repeated_lines(twice).collect()} == {1: "z" * 50, 2: "short\nend"}


def test_toxicity(spark, odd, empty):
    rnd = random.Random(1)
    plain = [f"word{rnd.randrange(99)}" for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = rnd.choices(plain, k=12) + (["idiot"] if i % 4 == 0 else []) + (["muslim"] if i % 8 == 0 else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known, F.col("doc_id") < 300, steps=200)
    loose = toxicity.fit(docs, known, F.col("doc_id") < 300, steps=200, counterfactual=0.0)
    right = [(model.score(t) >= 0.5) == (i % 4 == 0) for i, t in rows[300:]]
    assert sum(right) / len(right) > 0.97
    gap = lambda m: abs(m.score("a muslim word1 here") - m.score("a christian word1 here"))
    assert gap(model) <= gap(loose) + 1e-9
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.non_toxic(odd, model).columns == odd.columns
    assert toxicity.score(empty, model).count() == 0
    assert 0 < toxicity.fit(docs, known.limit(0)).score("") < 1


def test_toxicity_sample_is_bounded_by_rows(spark):
    rows = [(1, f"text {k:04d}") for k in range(3000)] + [(i, f"other {i}") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels, F.lit(True), "doc_id", "text", "toxic", 10).collect()
    assert len(sample) == 10 and len({r["_id"] for r in sample}) == 10
    everyone = toxicity.training_sample(docs, labels, F.lit(True), "doc_id", "text", "toxic", 100).collect()
    assert sorted((r["_id"], r.text) for r in everyone) == [(1, "text 0000"), *((i, f"other {i}") for i in range(2, 40))]


def test_placed_lists():
    import pyarrow as pa

    lists = [[3, 1], None, [], [0, 2, 3]]
    place = np.array([-1, 5, -1, 7], np.int32)
    want = [[7, 5], None, [], [7]]
    whole = pa.array(lists, pa.list_(pa.int32()))
    assert toxicity._placed(whole, place).to_pylist() == want
    assert toxicity._placed(whole.slice(1, 3), place).to_pylist() == want[1:]


def test_keep_one_goes_by_text_where_ids_repeat(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (None, b), (6, b), (6, None), (7, "")], "doc_id long, text string")
    for options in ({}, {"shingle": 5, "similarity": 0.8}):
        left = sorted(map(tuple, simhash.keep_one(docs, **options).collect()), key=str)
        assert left == sorted([(1, a), (5, b), (None, b), (6, None)], key=str)


def test_toxicity_descent_ends_where_the_loss_is_least():
    """Loss and gradient by plain loops: at the end of the descent no small step lowers the loss."""
    import pyarrow as pa

    rnd = random.Random(3)
    f = [sorted(rnd.sample(range(6), rnd.randint(1, 4))) for _ in range(40)]
    y = [int((0 in x) != (rnd.random() < 0.2)) for x in f]
    g = [sorted({5 - j if j in (1, 4) else j for j in x}) if {1, 4} & set(x) else None for x in f]
    kind = pa.list_(pa.int32())
    rows = pa.table({"id": list(range(40)), "label": y, "f": pa.array(f, kind), "g": pa.array(g, kind)})
    ridge, force = 1e-2, 0.7
    w, b = toxicity._descend(rows, 6, 0.0, ridge, force, 3000)

    def loss(w, b):
        n, ones = len(y), sum(y)
        weight = [math.sqrt((n - ones) / ones) if v else 1.0 for v in y]
        total = sum(weight)
        z = [b + sum(w[j] for j in x) for x in f]
        fit = sum(c * n / total * (math.log1p(math.exp(-v)) if t else math.log1p(math.exp(v))) for c, v, t in zip(weight, z, y)) / n
        gaps = [sum(w[j] for j in set(a) - set(o)) - sum(w[j] for j in set(o) - set(a)) for a, o in zip(f, g) if o is not None]
        return fit + ridge * sum(v * v for v in w) + force * sum(v * v for v in gaps) / len(gaps)

    w, least = [float(v) for v in w], loss(w, b)
    for k in range(6):
        for step in (-0.02, 0.02):
            assert loss([v + step * (j == k) for j, v in enumerate(w)], b) > least - 1e-6
    assert loss(w, b + 0.02) > least - 1e-6 and loss(w, b - 0.02) > least - 1e-6


def test_suffix_tree(spark, odd, empty):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 40))) + " New York City is big" for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model, n, v = suffix_tree_lm.train(docs, F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r for r in suffix_tree_lm.score(docs, model, n, v).collect()}
    tokens = {i: t.lower().split() + [None] for i, t in enumerate(texts)}
    c = collections.Counter(w for i, t in tokens.items() if i % 3 for w in t)
    assert n == sum(c.values()) and v == len(c)
    for i, t in tokens.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert got[i].base_score == pytest.approx(base) and got[i].n_tokens == len(t) and got[i].n_known == sum(c[w] > 0 for w in t)
        assert got[i].score > base  # the repeated phrase is predicted, in unseen texts too
    terms = {r.key: r.term for r in model.collect()}
    unknown = math.log10(1 / (n + v + 1))

    def one(x):
        return int(np.array([x], np.uint64).view(np.int64)[0])

    def pair(a, b):
        return suffix_tree_lm.pair_key(np.array([a], np.uint64), np.array([b], np.uint64))[0]

    def log_p(keys, at):
        """Of the token at a place, by looking at the states of its history."""
        p, mark = terms.get(one(keys[at]), unknown), np.uint64(suffix_tree_lm.STATE_MARK)
        if at >= 1:
            p += terms.get(one(keys[at - 1] ^ mark), 0.0) + terms.get(one(pair(keys[at - 1], keys[at])), 0.0)
        if at >= 2:
            c = pair(keys[at - 2], keys[at - 1])
            p += terms.get(one(c ^ mark), 0.0) + terms.get(one(suffix_tree_lm.triple_key(c, pair(keys[at - 1], keys[at]))), 0.0)
        return p

    hasher = suffix_tree_lm.Hasher()
    for i, text in enumerate(texts[:20]):
        keys = hasher.tokens(text)
        assert got[i].score == pytest.approx(sum(log_p(keys, k) for k in range(len(keys))))
    # Distributions are proper: over all words, the end and an unknown word the probabilities sum to one.
    symbols = np.unique(np.concatenate([hasher.tokens(t) for i, t in enumerate(texts) if i % 3] + [hasher.tokens("unseen")]))
    states = 0
    for context in ("", "a", "new", "new york", "york city", "city is"):
        history = hasher.tokens(context)[:-1]
        assert sum(10 ** log_p(np.append(history, x), len(history)) for x in symbols) == pytest.approx(1.0)
        states += len(history) > 0 and one(history[-1] ^ np.uint64(suffix_tree_lm.STATE_MARK)) in terms
    assert states
    assert suffix_tree_lm.score(odd, model, n, v).count() == len(ODD) and suffix_tree_lm.score(empty, model, n, v).count() == 0


def test_pii(spark, odd, empty):
    rows = [(i, f"Some text here, call me: +1 (555) 222-33{i:02d} ok") for i in range(30)]
    rows += [(100, "hello call me: 5552223344 and more"), (101, None), (102, ""), (103, "a@b.co 10.0.0.1 300.1.1.1 and 4111 1111 1111 1111 é x@y"), (None, "the 12345678 thing")]
    got = {r.doc_id: [(pii.KINDS[s.kind], s.start, s.end, s.found) for s in r.spans] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == [("phone", 15, 25, 1)] and got[None] == []
    assert got[103] == [("email", 0, 6, 0), ("ip", 7, 15, 0), ("card", 30, 49, 0)]
    assert pii.find_pii(odd).count() == len(ODD) and pii.find_pii(empty).count() == 0


def test_pii_contract_columns(spark, tmp_path):
    """Counts, digest and spans of the query by the plain expressions of its contract, on strings that stress them."""
    import re

    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def keeps(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        return kind == "email" or (12 <= len(digits) <= 19 and pii.luhn(digits) if kind == "card" else 9 <= len(digits) <= 15)

    rnd = random.Random(6)
    texts = {i: "".join(rnd.choice(a) for _ in range(rnd.randint(0, 80))) for i, a in enumerate(["a.@1-_", "0123456789. ", "0123456789- +()", "ab@.+%é1"] * 60)}
    texts |= {i: t for i, t in enumerate(["4111 1111 1111 1111", "+1 555 222 33 44", "x@y.z.@w.v", "0" * 3000 + ".1.1.1", "a@b.c%d@e.f", None, ""], 1000)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in llm_queries.queries()["op9_pii"](spark, str(tmp_path)).collect():
        found = {k: [(m.start(), i, m.end(), k) for m in re.finditer(e, texts[r.doc_id] or "") if keeps(k, m[0])] for i, (k, e) in enumerate(plain.items())}
        base = [f"{k}:{a}:{b}" for a, _, b, k in sorted(itertools.chain.from_iterable(found.values()))]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in found.values()]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert not set(base) - set(r.spans.split(","))


def test_pii_takes_linear_time():
    import time

    began = time.time()
    for text in ("0" * 5000 + ".1.1.1", "a" * 1_000_000, "1" * 1_000_000, "a.b@" * 250_000, "1." * 500_000, "+1 " * 300_000):
        spans = pii.base_spans(text)
        list(pii.loose_spans(text, spans))
        pii._CUES.findall(text)
        pii._cue(text, len(text))
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 1, 5006)]
    assert time.time() - began < 12


def test_pii_cues_agree():
    rnd = random.Random(9)
    for _ in range(300):
        text = "".join(rnd.choice("ab1 _:+(é²") for _ in range(30))
        found = {m.end(): pii._hash(f"{m[1].lower()} {m[2]}") for m in pii._CUES.finditer(text)}
        for at in range(len(text)):
            if text[at].isalnum() or text[at] in "_+(":
                assert pii._cue(text, at) == found.get(at)


def test_discovered_identifiers_induce_patterns(spark):
    """``ring`` is never followed by a regular number, but by those that ``call me`` discovers; then it discovers one itself."""
    rows = [(i, f"call me: +1 (555) 222-33{i:02d} ok") for i in range(30)]
    rows += [(100 + i, f"call me: 66622233{i:02d} or so. ring 66622233{i:02d} now") for i in range(5)] + [(200, "ring 7772223399 now")]
    got = {r.doc_id: [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans if s.found] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200] == [("phone", 5, 15)] and len(got[100]) == 2


def test_secrets(spark, odd, empty):
    rnd = random.Random(4)
    key = lambda n, a: "".join(rnd.choice(a) for _ in range(n))
    rows = []
    for i in range(60):
        rows.append((i, f"set password={key(20, '0123456789abcdef')} now"))
        rows.append((100 + i, f"card {key(16, '0123456789')} paid"))
    rows.append((300, "id AKIA" + key(16, "ABCDEFGHIJ234567")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = secrets.find_secrets(df).collect()
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start : r.end] == r.token for r in got)
    verdict = {r.doc_id: r.secret for r in got}
    assert all(verdict[i] for i in range(60)) and not any(verdict[100 + i] for i in range(60)) and verdict[300]
    late = [(1, "key=" + "abcdefghij" * 9 + "7 x"), (1, "key=" + "abcdefghij" * 9 + "7 x"), (None, None), (2, "a" * 300_000 + " " + "b1" * 150_000)]
    found = secrets.candidates(spark.createDataFrame(late, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.end) for r in found) == [(1, 4, 95), (1, 4, 95), (2, 300_001, 600_001)]
    assert secrets.find_secrets(odd).count() == 0 and secrets.find_secrets(empty).count() == 0


def test_code_search(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 40))
    x[5] = x[6] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (1000, None)]
    codes = code_search.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    bits = x > 0
    for blocks in (64, 1000):
        got = collections.defaultdict(list)
        for r in code_search.top_k(codes, F.col("id") % 20 == 5, 10, blocks, 7).collect():
            got[r.query_id].append((r.rank, r.distance, r.id))
        assert set(got) == set(range(5, 400, 20))
        for q, found in got.items():
            want = sorted((int((bits[q] ^ bits[j]).sum()), j) for j in range(400) if j != q)[:10]
            assert [(d, j) for _, d, j in sorted(found)] == want
    assert code_search.top_k(codes.limit(0), F.col("id") % 2 == 0).count() == 0
    schema = "vec_id long, embedding array<double>, code string, block long, size string, chunk int"
    odd = [(i, v, "c", 1, "s", 2) for i, v in ((1, [1.0, -1.0]), (1, [1.0, -1.0]), (2, [1.0, None]), (3, []), (4, None), (None, [1.0, 1.0]), (5, [1.0] * 40), (6, [-1.0] * 40))]
    codes = code_search.sign_codes(spark.createDataFrame(odd, schema))
    assert codes.count() == 7
    got = sorted((r.query_id, r.rank, r.id, r.distance) for r in code_search.top_k(codes, F.lit(True), 2, 3, 2).collect())
    assert got == [(1, 1, 2, 0), (1, 2, 3, 1), (2, 1, 1, 0), (2, 2, 3, 1), (3, 1, 1, 1), (3, 2, 2, 1), (5, 1, 6, 40), (6, 1, 5, 40)]


def test_contract_columns(spark):
    assert llm_queries.queries()["op5_toxicity"](spark, DATA).columns == ["doc_id", "held_out", "score", "predicted"]
    held = {r.doc_id: r.held_out for r in llm_queries.queries()["op3_suffix_tree_lm"](spark, DATA).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 7 == 2) for i, h in held.items())


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert stage(spark, docs.limit(0), DATA).count() == 0
        if name != "packing":
            assert out.columns == docs.columns
            assert stage(spark, odd, DATA).columns == odd.columns
        else:
            assert stage(spark, odd, DATA).count() >= odd.count()
        before, docs = docs, out.cache()
        ids, kept = (sorted(r.doc_id for r in df.collect()) for df in (before, docs))
        if name == "toxicity":
            dropped = set(ids) - set(kept)
            clean = [i for i in ids if labels.get(i) == 0]
            assert dropped and sum(i in dropped for i in clean) <= 0.02 * len(clean)
        elif name == "line_dedup":
            assert ids == kept
        elif name == "simhash_near_dedup":
            texts = {r.doc_id: simhash.fingerprint(r.text, 5) for r in before.collect()}
            mine = {i: i for i in texts}

            def top(x):
                while mine[x] != x:
                    x = mine[x]
                return x

            for a, b in itertools.combinations(sorted(texts), 2):
                if ((texts[a] ^ texts[b]) & (1 << 64) - 1).bit_count() <= 2 and top(a) != top(b):
                    mine[max(top(a), top(b))] = min(top(a), top(b))
            assert kept == sorted({top(i) for i in texts})
        elif name == "source_mix":
            want = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
            assert collections.Counter(kept) == collections.Counter({i: c for i, c in want.items() if c})
            # Rows without an id are taken one by one: as many words as with ids, to within a document of each source.
            nameless = corpus_pipeline.source_mix(spark, before.withColumn("doc_id", F.lit(None).cast("long")), DATA)
            words = lambda df: {r.source: r.t for r in df.groupBy("source").agg(F.sum(mixing.words_in(F.col("text"))).alias("t")).collect()}
            most, a, b = before.agg(F.max(mixing.words_in(F.col("text")))).first()[0], words(docs), words(nameless)
            assert all(abs(a.get(k, 0) - b.get(k, 0)) <= 2 * most for k in a | b)
    assert docs.count() > 0


@pytest.mark.parametrize("block_sets", [512, 2])
def test_near_dedup_reaches_a_jaccard_similarity(spark, monkeypatch, block_sets):
    """Copies with some words changed go; classes are those of all pairs, by sets of five words, in blocks of any size."""
    import corpus_pipeline

    monkeypatch.setattr(simhash, "BLOCK_SETS", block_sets)

    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(5000)}"
    texts, parent = {}, {}
    for _ in range(40):
        base = [word() for _ in range(rnd.randint(60, 200))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rnd.randint(0, 6)):
                copy[rnd.randrange(len(copy))] = word()
            texts[len(texts)] = " ".join(copy)
    texts |= {1000: "", 1001: " ", 1002: "one two", 1003: "One  two", 1004: "one two three"}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in texts.items())}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    beyond = 0
    for a, b in itertools.combinations(texts, 2):
        both = len(sets[a] & sets[b])
        bits = ((simhash.fingerprint(texts[a], 5) ^ simhash.fingerprint(texts[b], 5)) & (1 << 64) - 1).bit_count()
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) or bits <= 2:
            beyond += bits > 2
            parent[max(top(a), top(b))] = min(top(a), top(b))
    assert beyond > 50
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()) == sorted({top(i) for i in texts})


def test_short_lines_that_repeat(spark):
    """Equal lines of any length have a class; from 15 characters on two edits link them; blank lines stay."""
    rows = [(1, "All rights reserved.\n\nend\nLicensed by A.B. Co."), (2, "first\n\nend\nAll rights reserved."), (3, "Licensed by A.C. Co.\n \nends"), (4, "all right, reserve it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got == {1: rows[0][1], 2: "first\n", 3: " \nends", 4: rows[3][1]}
    assert line_dedup.line_classes(docs).count() == 9


def test_suffix_tree_training_by_brute_force(spark):
    """Contexts, their probabilities and all scores, recomputed from plain counts."""
    rnd = random.Random(12)
    phrases = ["new york city is big", "new york times says", "the city of york", "a b a b a c"]
    texts = {i: " ".join(rnd.choice(phrases) if rnd.random() < 0.5 else rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 25))) for i in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model, n_tokens, n_words = suffix_tree_lm.train(docs, F.col("doc_id") % 4 != 0)
    grams = [collections.Counter() for _ in range(4)]
    for i, t in texts.items():
        tokens = [*t.split(), None]
        for size in (1, 2, 3):
            if i % 4:
                grams[size].update(tuple(tokens[k : k + size]) for k in range(len(tokens) - size + 1))
    n, v = sum(grams[1].values()), len(grams[1])
    assert (n_tokens, n_words) == (n, v)
    states: dict = {}

    def p(context, symbol):
        if not context:
            return (grams[1][(symbol,)] + 1) / (n + v + 1)
        if context not in states:
            return p(context[1:], symbol)
        listed, rest = states[context]
        return listed[symbol] if symbol in listed else p(context[1:], symbol) * rest

    for size in (1, 2):  # shorter contexts first: a state is judged against its suffix
        found = {}
        for context in {g[:-1] for g in grams[size + 1]}:
            total = grams[size][context]
            listed = {g[-1]: (c - 0.5) / (total + 1) for g, c in grams[size + 1].items() if g[:-1] == context and c >= 2}
            listed = {x: q for x, q in listed.items() if grams[size + 1][(*context, x)] * math.log(q / p(context[1:], x)) >= suffix_tree_lm.SYMBOL_GAIN}
            others = total - sum(grams[size + 1][(*context, x)] for x in listed)
            ps, qs = sum(listed.values()), sum(p(context[1:], x) for x in listed)
            if listed and ps < 1 and qs < 1:
                rest = (1 - ps) / (1 - qs)
                gain = sum(grams[size + 1][(*context, x)] * math.log(q / p(context[1:], x)) for x, q in listed.items()) + others * math.log(rest)
                if gain >= suffix_tree_lm.STATE_GAIN:
                    found[context] = (listed, rest)
        states |= found
    assert any(len(c) == 2 for c in states) and any(len(c) == 1 for c in states)
    assert model.where("not word").count() == sum(1 + len(listed) for listed, _ in states.values())
    for r in suffix_tree_lm.score(docs, model, n_tokens, n_words).collect():
        tokens = [*texts[r.doc_id].split(), None]
        want = sum(math.log10(p(tuple(tokens[max(0, k - 2) : k]), x)) for k, x in enumerate(tokens))
        assert r.score == pytest.approx(want)


def test_pairs_met_twice_are_listed(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(40)) for _ in range(50)] + ["zebra quark a b", "c zebra quark"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, _, _ = suffix_tree_lm.train(docs, F.lit(True))
    zebra, quark = suffix_tree_lm.Hasher().tokens("zebra quark")[:2]
    key = suffix_tree_lm.pair_key(np.array([zebra]), np.array([quark])).view(np.int64)[0]
    assert model.where(F.col("key") == int(key)).count() == 1
