"""Personal data by bootstrapped contextual extraction.

Regular expressions give seed entities. The words before seeds are lexical patterns;
patterns and the identifier-like tokens that follow them form a graph, on which Spark
scores patterns and instances in turn. Patterns that are nearly always followed by
personal data then discover identifiers that no expression matches, and these are seeds of the next
round, in which they induce patterns of their own.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, table

KINDS = ("email", "ip", "card", "phone")
# The time of each expression is linear in the text: a run is entered at its start alone, and never given back.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Identifier-like tokens: with a digit or an at sign, of six or more characters from a word character or plus sign on.
_LOOSE = re.compile(r"[^\s\"',;:=<>|()\[\]]++")
_LOOSE_START, _LOOSE_MARK, LEAST_TOKEN = re.compile(r"[\w+]"), re.compile("[0-9@]"), 6
#: A lexical pattern: the last word before a token, and the one to four characters that stand between them.
MAX_GAP = 4
_CUES = re.compile(r"(?<![^\W\d_])([^\W\d_]++)([^\w+(]{1,4}+)(?=[\w+(])")
#: Most bits of the filter of patterns: 64 MB.
FILTER_BITS = 1 << 29


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with what may stand before it, back to the end of the match before, and after it."""
    low, at = 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if local else None
        if m:
            yield at - local, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end (exclusive) of the regular entities, ordered; leftmost non-overlapping per kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if "." in text:
        small = lambda p: len(p := p.lstrip("0")) <= 3 and int(p or 0) <= 255
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() >= 12 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Start and end of the identifier-like tokens that no span of ``taken`` (sorted) touches."""
    covered: list[list[int]] = []
    for a, _, b in taken:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(b, covered[-1][1])
        else:
            covered.append([a, b])
    starts = [a for a, _ in covered]
    for m in _LOOSE.finditer(text):
        first = _LOOSE_START.search(m[0])
        start, end = m.start() + (first.start() if first else 0), m.end()
        if first and end - start >= LEAST_TOKEN and _LOOSE_MARK.search(text, start, end):
            i = bisect_left(starts, end) - 1
            if i < 0 or covered[i][1] <= start:
                yield start, end


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 9) - (1 << 63)


def _is_letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def _cue(text: str, start: int) -> int | None:
    """The pattern before ``start``, or None: the one that ``_CUES`` finds there."""
    gap = start
    while gap > 0 and start - gap <= MAX_GAP and not (text[gap - 1].isalnum() or text[gap - 1] in "_+("):
        gap -= 1
    word = gap
    while word > 0 and _is_letter(text[word - 1]):
        word -= 1
    return _hash(f"{text[word:gap].lower()} {text[gap:start]}") if word < gap < start and start - gap <= MAX_GAP else None


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_LOOSE_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cue", pa.int64()), ("value", pa.int64()), ("kind", pa.int32())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, base, loose``: the base spans, and both seeds (with their kind) and loose tokens (kind -1) that follow a cue."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, loose = [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text)
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                own = [(a, b, k) for a, k, b in spans]
                if _LOOSE_MARK.search(text):
                    own += [(a, b, -1) for a, b in loose_spans(text, spans)]
                loose.append([{"start": a, "end": b, "cue": c, "value": _hash(text[a:b].lower()), "kind": k} for a, b, k in own if (c := _cue(text, a)) is not None])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(base, pa.list_(_SPAN)), pa.array(loose, pa.list_(_LOOSE_SPAN))], names=["doc_id", "row", "base", "loose"])

    return rows.mapInArrow(run, "doc_id long, row long, base array<struct<start:int,kind:int,end:int>>, loose array<struct<start:int,end:int,cue:long,value:long,kind:int>>")


def cue_counts(docs: DataFrame, cues: DataFrame, text_col: str = "text") -> DataFrame:
    """``cue, total``: how often each pattern of ``cues`` occurs in all texts, whatever follows it.

    A bitmap with the patterns is broadcast, 16 bits for each, from 128 KB up to 64 MB, so that the pass emits few counts of other words.
    """
    size = min(FILTER_BITS, 1 << max(20, (16 * cues.count()).bit_length()))
    at = F.pmod(F.col("cue"), F.lit(size)) + 1
    marks = cues.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for r in marks:
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, met = sent.value, {}
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(_CUES.findall(text))
            keys: Counter = Counter()
            for (word, gap), n in counts.items():
                key = met.get((word, gap))
                if key is None:
                    if len(met) > 200_000:
                        met.clear()
                    h = _hash(f"{word.lower()} {gap}")
                    key = met[word, gap] = h if bits[(h % size) >> 3] >> (h % 8) & 1 else 0
                if key:
                    keys[key] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.int64()), pa.array(list(keys.values()), pa.int64())], names=["cue", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "cue long, n long")
    return counted.groupBy("cue").agg(F.sum("n").alias("total")).join(cues, "cue", "left_semi")


def scored_patterns(edges: DataFrame, totals: DataFrame, rounds: int = 2, support: int = 3) -> DataFrame:
    """Scores of patterns: ``kind, cue, support, confidence``, of those that ``support`` different seeds follow.

    ``edges`` has ``cue, value, kind`` (the kind of a seed, -1 for a loose token) and ``n``. In each
    round a pattern's confidence for a kind is the summed score of what followed it over
    all its occurrences in the corpus, and an unseen instance's score is the chance that
    at least one of its patterns is right. Seeds score 1 throughout.
    """
    seeds = edges.where("kind >= 0").groupBy("kind", "cue").agg(F.sum("n").cast("double").alias("hits"), F.count(F.lit(1)).alias("support")).where(F.col("support") >= support)
    known = checkpoint(seeds.join(totals, "cue"))
    link = checkpoint(edges.where("kind < 0").select("cue", "value", "n").join(known.select("kind", "cue"), "cue").select("kind", "cue", "value", "n"))
    patterns = known.select("kind", "cue", "support", (F.col("hits") / F.greatest("total", "hits")).alias("confidence"))
    for _ in range(rounds):
        miss = F.exp(F.sum(F.log(F.greatest(1.0 - F.col("confidence"), F.lit(1e-6)))))
        instances = link.join(patterns.drop("support"), ["kind", "cue"]).groupBy("kind", "value").agg((1.0 - miss).alias("score"))
        gained = link.join(instances, ["kind", "value"]).groupBy("kind", "cue").agg(F.sum(F.col("n") * F.col("score")).alias("more"))
        total = known.join(gained, ["kind", "cue"], "left")
        patterns = checkpoint(total.select("kind", "cue", "support", F.least(F.lit(1.0), (F.col("hits") + F.coalesce("more", F.lit(0.0))) / F.greatest("total", "hits")).alias("confidence")))
    return patterns


def sure_patterns(edges: DataFrame, totals: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 3) -> DataFrame:
    """``cue, kind, confidence`` of the patterns that discover identifiers.

    A pattern is sure if its confidence and its support are enough. The tokens that follow a sure pattern become seeds of
    its kind (of the surest pattern's, where several claim one), and all patterns are scored anew, those included that only
    such seeds follow. This ends when no pattern is added, after ``rounds`` rounds at most.
    """
    best, before = None, -1
    now = edges
    for _ in range(rounds):
        patterns = scored_patterns(now, totals, support=support)
        sure = patterns.where((F.col("confidence") >= confidence) & (F.col("support") >= support))
        best = checkpoint(sure.groupBy("cue").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b")).select("cue", (-F.col("b.k")).alias("as_kind"), F.col("b.confidence").alias("confidence")))
        n = best.count()
        if n == before or not n:
            break
        before = n
        found = edges.where("kind < 0").join(best, "cue").groupBy("value").agg(F.max(F.struct("confidence", (-F.col("as_kind")).alias("k"))).alias("b")).select(F.col("value").alias("_value"), (-F.col("b.k")).alias("_kind"))
        now = checkpoint(edges.join(found, (F.col("value") == F.col("_value")) & (F.col("kind") < 0), "left").select("cue", "value", F.coalesce("_kind", "kind").alias("kind"), "n"))
    return best


def find_pii(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 3,
    confidence: float = 0.8,
    support: int = 3,
) -> DataFrame:
    """``doc_id, spans``: per row an array of ``start, kind, end, found`` in order of start and kind.

    ``kind`` indexes KINDS; ``found`` is 0 for spans of the regular expressions, which always
    stay, and 1 for identifiers discovered by a pattern that at least ``support``
    different seeds follow and whose confidence reaches ``confidence``; a token that
    several kinds claim gets the surest one. What a round discovers are seeds of the next
    one, up to ``rounds``. Offsets count code points, ends are exclusive.

    Texts are read whole, twice: for spans, and to count the patterns that stand before tokens wherever
    they occur; in time that is linear in their length. Null and empty texts have no spans; repeated rows give the same spans
    each; null ids stay; other columns are ignored; an empty table gives no rows.
    """
    seen = checkpoint(scan(docs, id_col, text_col))
    loose = seen.select("row", "doc_id", F.explode("loose").alias("t")).select("row", "doc_id", "t.*")
    edges = loose.groupBy("cue", "value", "kind").agg(F.count(F.lit(1)).alias("n"))
    # A pattern needs the support of different tokens, whatever their number of copies.
    cues = checkpoint(edges.groupBy("cue").agg(F.count(F.lit(1)).alias("s")).where(F.col("s") >= support).select("cue"))
    edges = checkpoint(edges.join(cues, "cue", "left_semi"))
    totals = checkpoint(cue_counts(docs, cues, text_col))
    best = sure_patterns(edges, totals, rounds, confidence, support).drop("confidence")
    extra = loose.where("kind < 0").join(best, "cue").select("row", "doc_id", F.struct("start", F.col("as_kind").alias("kind"), "end", F.lit(1).alias("found")).alias("s"))
    extra = extra.groupBy("row", "doc_id").agg(F.collect_set("s").alias("more")).select(F.col("row").alias("_row"), F.col("doc_id").alias("_doc"), "more")
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(0).alias("found")))
    # Rows are told by their id and a hash of id and text.
    joined = seen.drop("loose").join(extra, (seen["row"] == extra["_row"]) & seen["doc_id"].eqNullSafe(extra["_doc"]), "left")
    spans = F.when(F.col("more").isNull(), base).otherwise(F.array_sort(F.concat(base, "more")))
    return joined.select("doc_id", spans.alias("spans"))


def op9_pii(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["found"] == 0)

    def count(kind):  # a lambda with a second argument would be given the place of the element in it
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
