"""Folding of letters, company keys and tail functions."""

import math
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from rankloom.functions import columns as C
from rankloom.functions import tails


def test_every_character_folds_as_its_decomposition(spark):
    texts = [f"a{chr(c)}b{chr(c).upper()}" for c in range(1, 0x1F00)] + [None, "", "été", "ẞtraße Łódź Ǆ ½"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", C.fold_accents(F.col("t")).alias("f")).collect()
    want = [None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower() for t in texts]
    got = {r.k: r.f for r in rows}
    assert [(t, got[k]) for k, t in enumerate(texts) if got[k] != want[k]] == []
    con = duckdb.connect()
    assert [con.execute(f"SELECT {C.fold_accents_sql('x')} FROM (SELECT ?::VARCHAR AS x)", [t]).fetchone()[0] for t in texts[::97]] == want[::97]


def test_company_keys(spark):
    names = ["The Société Générale Group, Inc.", "IBM Corp.", "Estée Lauder Companies", "Ålstom & Søn", "Victoria's Secret"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(C.company_key(F.col("n"), C.COMPANY_ALIASES)).collect()] == ["societe generale", "international business machines", "estee lauder", "alstom and sn", "victoria s secret and"]
    assert df.where("n like 'IBM%'").select(C.company_key(F.col("n"))).first()[0] == "ibm"


def test_all_descriptors_are_stripped(spark):
    df = spark.createDataFrame([(f"Acme {s.title()} Inc",) for s in C.SUFFIXES] + [("Acme LP",), ("Inc",)], "n string")
    keys = [{x["tier"]: x["key"] for x in r[0]} for r in df.select(C.name_keys(F.col("n"))).collect()]
    assert len(C.SUFFIXES) == 32 and all(k[4] == "ACME" for k in keys[:32])
    assert keys[32][4] == "ACME LP" and keys[33][4] == "INC"


def test_tails(spark):
    cases = [(a, x) for a in (0.3, 0.5, 1.0, 2.5, 10.0, 250.0, 5000.0) for x in (-1.0, 0.0, 1e-6, 0.4, 0.9 * a, a, a + 0.99, a + 1.01, 1.3 * a + 2, 3 * a + 30)]
    df = spark.createDataFrame(cases + [(0.0, 1.0), (-1.0, 1.0), (None, 1.0), (1.0, None), (math.nan, 1.0)], "a double, x double")
    for r in df.withColumn("q", C.gamma_tail(F.col("a"), F.col("x"))).collect():
        want = tails.gamma_tail(r.a, r.x)
        assert r.q == (None if want is None else pytest.approx(want, rel=1e-9, abs=1e-14)), r
    for r in spark.createDataFrame([(x,) for x in (0.1, 1.0, 5.0, 20.0)], "x double").select("x", C.chi_square_tail(F.col("x"), F.lit(1.0)).alias("one"), C.chi_square_tail(F.col("x"), F.lit(2.0)).alias("two")).collect():
        assert (r.one, r.two) == pytest.approx((math.erfc(math.sqrt(r.x / 2)), math.exp(-r.x / 2)))
    shares = [(a, b, x) for a in (0.5, 1.0, 3.0, 40.0, 900.0) for b in (0.5, 2.0, 60.0) for x in (0.0, 1e-5, 0.2, 0.5, 0.93, 1.0)]
    for r in spark.createDataFrame(shares, "a double, b double, x double").withColumn("i", C.beta_share(F.col("a"), F.col("b"), F.col("x"))).collect():
        assert r.i == pytest.approx(tails.beta_share(r.a, r.b, r.x), rel=1e-8, abs=1e-13), r
    for r in spark.createDataFrame([(t,) for t in (0.0, 0.5, 2.0, 30.0)], "t double").select("t", C.student_tail(F.col("t"), F.lit(1.0)).alias("p")).collect():
        assert r.p == pytest.approx(1 - 2 * math.atan(r.t) / math.pi)


def test_log_gamma(spark):
    xs = [0.1, 0.5, 1.0, 1.5, 2.0, 7.25, 100.0, 1e5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(C.log_gamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-12)
