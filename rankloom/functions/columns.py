"""Column builders: recodes, text keys, bins and tail functions. All stay inside Catalyst."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal words that a company key drops (v1, lower case) and descriptors that end a name (v2, upper case).
LEGAL_WORDS = ("inc", "incorporated", "corp", "corporation", "co", "company", "companies", "cos", "group", "holdings", "holding", "plc", "llc", "ltd", "limited", "the")
SUFFIXES = (
    "INC", "INCORPORATED", "CO", "COMPANY", "CORP", "CORPORATION", "LLC", "LTD", "PLC", "HOLDINGS", "HOLDING", "GROUP", "COS", "THE", "INTERNATIONAL", "WORLDWIDE",
    "GLOBAL", "SERVICES", "SERVICE", "TECHNOLOGIES", "TECHNOLOGY", "SOLUTIONS", "SYSTEMS", "SYSTEM", "COMMUNICATIONS", "COMMUNICATION", "NETWORKS", "NETWORK", "RETAIL", "ENTERPRISES", "ENTERPRISE", "COM",
)
#: Company keys that stand for other ones.
COMPANY_ALIASES = {
    "adp": "automatic data processing",
    "carrier": "carrier global",
    "costco": "costco wholesale",
    "disney": "walt disney",
    "dowdupont": "dow",
    "dr pepper snapple": "keurig dr pepper",
    "estee lauder": "estee lauder",
    "general electric": "ge aerospace",
    "ibm": "international business machines",
    "icahn enterprises": "icahn enterprises lp",
    "jpmorgan chase": "jpmorgan chase and",
    "laboratory of america": "labcorp",
    "merck": "merck and",
    "otis": "otis worldwide",
    "sears": "sears roebuck and",
    "synnex": "td synnex",
    "united continental": "united airlines",
    "ups": "united parcel service",
    "verizon": "verizon communications",
    "victoria s secret": "victoria s secret and",
    "wells fargo": "wells fargo and",
    "xpo logistics": "xpo",
}


def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """What characters outside ASCII leave in it once they are decomposed: those that leave one character, up to U+FFFF, and those that leave several, up to U+1EFF."""
    one, several = {}, {}
    for code in range(0x80, 0x10000):
        if not 0xD800 <= code <= 0xDFFF:
            plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
            if len(plain) == 1:
                one[chr(code)] = plain
            elif plain and code <= 0x1EFF:
                several[chr(code)] = plain
    return one, several


FOLDED, FOLDED_TO_SEVERAL = _foldings()


# ---- recodes
def label_code(c: Column, codes: Mapping[str, int]) -> Column:
    """Code of a label; null if the label is not in the map (check with ``operators.quality``)."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), c)


def reverse_code(c: Column, top: int = 6) -> Column:
    """``top - c`` for 1 to top - 1; other values, null among them, as they are."""
    return F.when(c.between(1, top - 1), top - c).otherwise(c)


def combine_framings(first: Column, second: Column, top: int = 6) -> Column:
    """The first framing if valid, else the second one reversed if valid, else the second as is."""
    return F.when(first.between(1, top - 1), first).when(second.between(1, top - 1), top - second).otherwise(second)


def null_if(c: Column, sentinel) -> Column:
    return F.nullif(c, F.lit(sentinel))


def pool(*arms: Column, sentinel: int = -1) -> Column:
    """First arm that is neither null nor the sentinel."""
    return F.coalesce(*[null_if(a, sentinel) for a in arms])


def binary_flag(c: Column, value) -> Column:
    return F.when(c.isNull(), None).when(c == value, 1).otherwise(0)


def member_flag(c: Column, values: Sequence) -> Column:
    """1 if in the set, else 0; null counts as outside."""
    return F.coalesce(c.isin(*values), F.lit(False)).cast("int")


def corrected_square(x: Column, se: Column) -> Column:
    return x * x - se * se


def log_gap(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.ln(a) - F.ln(b))


def half_open_bin(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of [edge, next edge); null outside."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((c >= low) & (c < high), label).otherwise(out)
    return out


def code_band(c: Column, bands: Sequence[tuple[int, int, int]], otherwise: Column | None = None) -> Column:
    """Value of the first closed range (low, high, value) that holds the code."""
    out = F.lit(None) if otherwise is None else otherwise
    for low, high, value in reversed(bands):
        out = F.when(c.between(low, high), value).otherwise(out)
    return out


# ---- text
def fold_accents(c: Column) -> Column:
    """Lower-case ASCII of a text: characters are decomposed, and what is not ASCII then is dropped."""
    out = F.translate(c, "".join(FOLDED), "".join(FOLDED.values()))
    for mark, plain in FOLDED_TO_SEVERAL.items():
        out = F.replace(out, F.lit(mark), F.lit(plain))
    return F.lower(F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(out, r"[^\x00-\x7F]", "")).otherwise(c))


def fold_accents_sql(c: str) -> str:
    """The same as SQL text."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"translate({c}, {quoted(''.join(FOLDED))}, {quoted(''.join(FOLDED.values()))})"
    for mark, plain in FOLDED_TO_SEVERAL.items():
        out = f"replace({out}, {quoted(mark)}, {quoted(plain)})"
    return f"lower(regexp_replace({out}, '[^\\x00-\\x7F]', '', 'g'))"


def company_key(c: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Key v1: folded, lower, ``&`` spelt out, letters and digits only, legal words dropped, alias applied."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(fold_accents(c), "&", " and "), "[^a-z0-9]+", " ")), " ")
    key = F.array_join(F.filter(words, lambda w: ~w.isin(*LEGAL_WORDS)), " ")
    if aliases:
        key = F.coalesce(label_code(key, aliases), key)
    return key


def name_keys(c: Column) -> Column:
    """Key v2: seven variants from strict to loose as ``array<struct<tier, key>>``; empty keys become null."""
    upper = F.upper(F.trim(c))
    plain = F.trim(F.regexp_replace(F.regexp_replace(upper, "&", " AND "), "[^A-Z0-9]+", " "))
    words = F.split(plain, " ")
    suffix = rf"( ({'|'.join(SUFFIXES)}))+$"
    stripped = F.regexp_replace(plain, suffix, "")
    short = F.split(stripped, " ")
    keys = [upper, plain, F.array_join(words, ""), stripped, F.array_join(short, ""), F.array_join(F.slice(short, 1, 2), " "), F.element_at(short, 1)]
    return F.array(*[F.struct(F.lit(t).alias("tier"), F.nullif(k, F.lit("")).alias("key")) for t, k in enumerate(keys, 1)])


def without_parentheses(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\([^)]*\)", ""))


def clean_text(c: Column, keep: str = "A-Za-z0-9 ") -> Column:
    """Keeps a character class; the word "nan" counts as missing."""
    out = F.trim(F.regexp_replace(c, f"[^{keep}]", ""))
    return F.when(F.lower(out) == "nan", None).otherwise(out)


def code_text(c: Column) -> Column:
    return F.regexp_replace(c, r"\.0$", "")


def number(c: Column, kind: str = "double") -> Column:
    """Number in a text, null for anything else (such as a suppression mark)."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast(kind)


def text_boolean(c: Column) -> Column:
    return F.when(c.isNull(), None).otherwise(F.lower(F.trim(c)).isin("true", "t", "1"))


def safe_name(c: Column) -> Column:
    """Lower-case name of letters, digits and underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def range_codes(c: Column) -> Column:
    """All whole numbers of a range text such as 24-35, or the one of a plain number."""
    low = F.split_part(c, F.lit("-"), F.lit(1)).try_cast("int")
    high = F.coalesce(F.split_part(c, F.lit("-"), F.lit(2)).try_cast("int"), low)
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


# ---- distribution functions
#: Coefficients of a rational approximation of the normal distribution (error below 7.5e-8).
CDF_P, CDF_B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_SQRT_2PI = 0.3989422804014327


def normal_pdf(z: Column) -> Column:
    return F.lit(INV_SQRT_2PI) * F.exp(-z * z / 2.0)


def normal_cdf(z: Column) -> Column:
    t = 1.0 / (1.0 + F.lit(CDF_P) * F.abs(z))
    poly = F.lit(0.0)
    for b in reversed(CDF_B):
        poly = (poly + F.lit(b)) * t
    tail = normal_pdf(z) * poly
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def normal_cdf_sql(z: str) -> str:
    """The same approximation as SQL text."""
    t = f"(1.0::DOUBLE / (1.0 + {CDF_P}::DOUBLE * abs({z})))"
    poly = "0.0::DOUBLE"
    for b in reversed(CDF_B):
        poly = f"(({poly} + ({b}::DOUBLE)) * {t})"
    return f"CASE WHEN {z} >= 0 THEN 1.0 - {normal_pdf_sql(z)} * {poly} ELSE {normal_pdf_sql(z)} * {poly} END"


def normal_pdf_sql(z: str) -> str:
    return f"({INV_SQRT_2PI}::DOUBLE * exp(-({z}) * ({z}) / 2.0))"


def positive_part(estimate: Column, se: Column) -> Column:
    """Mean of a normal truncated at 0: estimate + se * pdf(z) / cdf(z); null where it is not defined."""
    z = estimate / F.when(se > 0, se)
    return F.when(z > -6, estimate + se * normal_pdf(z) / normal_cdf(z))


def positive_part_sql(estimate: str, se: str) -> str:
    z = f"(({estimate}) / nullif({se}, 0))"
    return f"CASE WHEN {se} > 0 AND {z} > -6 THEN {estimate} + {se} * {normal_pdf_sql(z)} / ({normal_cdf_sql(z)}) END"


#: Coefficients of Lanczos' approximation of the gamma function, for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0."""
    parts = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        parts = parts + F.lit(c) / (x + i)
    t = x + 6.5
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.ln(t) - t + F.ln(parts)


def _steps(least: int, factor: float, size: Column) -> Column:
    """1, 2, ... up to what a series or fraction needs whose terms die off within some roots of ``size``."""
    return F.sequence(F.lit(1), F.ceil(least + factor * F.sqrt(size)).cast("int"))


def _fraction(first: Column, steps: Column) -> Column:
    """1 / (first + t1 / (b1 + t2 / (b2 + ...))) over ``steps`` of t and b: a fold over the last two convergents, scaled so that the last denominator is 1."""
    start = F.struct(F.lit(0.0).alias("older"), (1.0 / first).alias("below"), (1.0 / first).alias("last"))

    def go_on(s, e):
        bottom = e["b"] + e["t"] * s["below"]
        return F.struct((s["last"] / bottom).alias("older"), (1.0 / bottom).alias("below"), ((e["b"] * s["last"] + e["t"] * s["older"]) / bottom).alias("last"))

    return F.aggregate(steps, start, go_on, lambda s: s["last"])


def gamma_tail(a: Column, x: Column) -> Column:
    """Upper regularised incomplete gamma function Q(a, x): a series below a + 1, a continued fraction above, both as folds; null for a <= 0 or no number."""
    scale = F.exp(a * F.ln(x) - x - log_gamma(a))
    first = F.struct((1.0 / a).alias("term"), (1.0 / a).alias("sum"))
    ratios = F.transform(_steps(30, 9.0, a), lambda n: x / (a + n))
    series = F.aggregate(ratios, first, lambda s, r: F.struct((s["term"] * r).alias("term"), (s["sum"] + s["term"] * r).alias("sum")), lambda s: s["sum"])
    fraction = _fraction(x + 1.0 - a, F.transform(_steps(40, 12.0, a), lambda i: F.struct((-i * (i - a)).alias("t"), (x + 1.0 - a + 2 * i).alias("b"))))
    known = (a > 0) & ~F.isnan(a) & ~F.isnan(x)
    return F.when(known & (x <= 0), 1.0).when(known & (x < a + 1.0), 1.0 - scale * series).when(known, scale * fraction)


def _beta_part(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function for x up to (a + 1) / (a + b + 2)."""
    scale = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1.0 - x)) / a

    def top(k):
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.struct(F.when(k % 2 == 0, even).otherwise(odd).alias("t"), F.lit(1.0).alias("b"))

    return scale * _fraction(F.lit(1.0), F.transform(_steps(40, 12.0, F.greatest(a, b)), top))


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b); null where a or b is not positive or something is no number."""
    known = (a > 0) & (b > 0) & ~F.isnan(a) & ~F.isnan(b) & ~F.isnan(x)
    inner = F.when(x > (a + 1.0) / (a + b + 2.0), 1.0 - _beta_part(b, a, 1.0 - x)).otherwise(_beta_part(a, b, x))
    return F.when(known & (x <= 0), 0.0).when(known & (x >= 1), 1.0).when(known, inner)


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(X > x) of a chi-square variable."""
    return gamma_tail(df / 2.0, x / 2.0)


def student_tail(t: Column, df: Column) -> Column:
    """Two-sided P(|T| > |t|) of a Student variable."""
    return beta_share(df / 2.0, F.lit(0.5), df / (df + t * t))


def p_text(p: Column, digits: int = 3) -> Column:
    """``<0.001`` below the last digit shown, else the number."""
    least = 10.0**-digits
    return F.when(p.isNull(), "").when(p < least, f"<{least:.{digits}f}").otherwise(F.format_string(f"%.{digits}f", p))
