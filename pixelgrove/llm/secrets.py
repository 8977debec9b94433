"""Secret scans: fixed patterns, and character Markov models for what they miss.

Base spans come from three patterns (``BASE``). Further candidates are what the
base spans leave of runs of token characters; each is scored by the mean
log-likelihood ratio, per character, of two first-order Markov chains: one of
random strings and one of ordinary identifiers, both trained from labelled
samples. Everything is a projection of the row, in DataFrame operations: no
shuffle, no Python.

Positions are code points, ends exclusive. They are found by splitting a text
at the matches of a pattern: the lengths of gaps and matches add up. Sums run in
blocks (``running``) and parts of a text are cut from pieces of PIECE
characters (``part``), so a text with very many matches costs little more than
its length.

Cases: null text is the empty text and has no spans; a null doc_id is carried
as null; repeated rows are scanned each; an empty table gives no rows; other
columns are carried along by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pixelgrove.llm.common import unused

#: Kind, pattern, group whose length counts, least length of that group.
BASE = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),  # as AKIA[A-Z0-9]+ of 16 characters or more
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # as [0-9a-f]+ of 32 characters or more
)
KINDS = (*(b[0] for b in BASE), "markov")
CANDIDATE, LEAST = r"[A-Za-z0-9+/_=-]{20,}", 20
#: Characters of a candidate; number 0 stands before the first one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Mean log-likelihood ratio a character from which a candidate is a secret.
THRESHOLD = 0.7
SAMPLES = 4000
#: Characters of a piece that parts of a text are cut from.
PIECE = 1024
#: Parts of ordinary identifiers for the labelled samples.
WORDS = (
    "account action address after agent amount answer application archive array attention author background balance battery between buffer button "
    "cache calendar category channel chapter character client cluster collection column command comment company component condition config connection "
    "container content context control counter country create customer database default delivery description detail device directory document domain "
    "download element engine entry error event example exception execute expression factory feature field filter folder format function gateway general "
    "global group handler header height history identifier image index information initial input instance integer interface internal invoice iterator "
    "journal keyboard language layout length level library license listener location manager material maximum measure member message method minimum "
    "module monitor navigation network notification number object operation option order original output package parameter parent partition password "
    "payment performance permission person platform position practice previous priority process product profile project property protocol provider "
    "question queue random reference region register relation release remote report request resource response result return schedule schema season "
    "section segment selection sequence server service session setting shadow shipment signature simple single source standard station status storage "
    "stream string structure student subject support surface symbol system table target template terminal threshold timeout token total transaction "
    "transform transport trigger understand unique update upload utility validate value variable vector version visible volume warning weather widget window"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(text, label): n random strings (1) in usual alphabets, and 2n ordinary identifiers, numbers and rules (0).

    n is the bound of the sample; the strings follow from their number alone.
    """
    i = F.col("id")
    digest = F.sha2(i.cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    rand = spark.range(n).select(
        F.when(i % 5 == 0, digest).when(i % 5 == 1, F.upper(F.substring(F.regexp_replace(base64, "[+/=]", ""), 1, 32))).when(i % 5 == 2, F.regexp_replace(base64, "[+/=]", "")).when(i % 5 == 3, F.translate(base64, "+/", "-_")).otherwise(base64).alias("text"),
        F.lit(1).alias("label"),
    )
    words = F.split(F.lit(" ".join(WORDS)), " ")
    pick = lambda k: F.get(words, F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(WORDS))).cast("int"))
    sep = F.get(F.array(*[F.lit(x) for x in ("_", "-", "/", "")]), (i % 4).cast("int"))
    names = F.concat_ws("_", pick(0), pick(1), pick(2), pick(3))
    named = F.when(i % 8 == 0, F.upper(names)).when(i % 8 == 1, F.regexp_replace(F.initcap(F.translate(names, "_", " ")), " ", "")).otherwise(F.concat(pick(0), sep, pick(1), sep, pick(2), sep, pick(3)))
    nth = F.floor(i / 16)
    rules = F.when(nth % 2 == 0, F.repeat(F.get(F.split(F.lit("- = _ / + 0 x"), " "), F.pmod(F.floor(nth / 2), F.lit(7)).cast("int")), 40)).otherwise(F.concat(F.date_format(F.timestamp_seconds(i * 86413), "yyyyMMddHHmmss"), F.lpad((i * 7919).cast("string"), 12, "0")))
    plain = spark.range(2 * n).select(F.when(i % 16 == 15, rules).otherwise(named).alias("text"), F.lit(0).alias("label"))
    return rand.unionByName(plain)


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))


def train(samples: DataFrame, smoothing: float = 0.2) -> list[float]:
    """Log-likelihood ratios of the two chains for each pair of characters, from (text, label).

    Characters outside the alphabet are skipped. The counts that reach the driver are at most two tables of 68 x 67.
    """
    size = len(ALPHABET)
    codes = samples.where("text IS NOT NULL AND label IS NOT NULL").select("label", F.filter(_codes(F.col("text")), lambda c: c > 0).alias("c"))
    pairs = codes.select("label", F.explode(F.transform("c", lambda x, i: F.struct(F.coalesce(F.get("c", i - 1), F.lit(0)).alias("a"), x.alias("b")))).alias("p"))
    seen = {(r.label, r.a, r.b): r.n for r in pairs.groupBy("label", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for a in range(size + 1):
        sums = [sum(seen.get((k, a, b), 0) for b in range(1, size + 1)) + smoothing * size for k in (0, 1)]
        out += [0.0] + [log((seen.get((1, a, b), 0) + smoothing) / sums[1]) - log((seen.get((0, a, b), 0) + smoothing) / sums[0]) for b in range(1, size + 1)]
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though a lambda in it may use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column) -> Column:
    """Running sums of an array of longs, by blocks of about the root of its length."""
    none = F.array().cast("array<bigint>")

    def add(acc: Column, x: Column) -> Column:
        return F.struct((acc["s"] + x).alias("s"), F.concat(acc["out"], F.array(acc["s"] + x)).alias("out"))

    def shift(acc: Column, done: Column) -> Column:
        return F.struct((acc["s"] + done["s"]).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))

    start, zero = F.struct(F.lit(0).cast("long").alias("s"), none.alias("out")), F.lit(0)

    def sums(v: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        firsts = F.sequence(zero, F.greatest(F.size(v) - 1, zero), size)
        blocks = F.transform(firsts, lambda i: F.aggregate(F.slice(v, i + 1, size), start, add))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, F.aggregate(b, start, shift, lambda acc: acc["out"]), lambda done, before: F.transform(done["out"], lambda x: x + before))))

    return let(values, sums)


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(cut: Column, start: Column, end: Column) -> Column:
    """Characters from start to end of the text with these pieces."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(F.greatest(end - 1, F.lit(0)) / PIECE).cast("int")
    return F.substring(F.array_join(F.slice(cut, first + 1, F.greatest(last - first + 1, F.lit(0))), ""), (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio a character."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")
    size = len(ALPHABET) + 1

    def total(codes: Column) -> Column:
        steps = F.transform(codes, lambda c, i: F.get(table, (F.coalesce(F.get(codes, i - 1), F.lit(0)) * size + c).cast("int")))
        return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.size(codes)

    return let(_codes(token), total)


SPAN = "array<struct<start:int,rank:int,end:int>>"


def _span(start: Column, rank: int, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"))


def _spans(text: Column, pattern: str, group: int, least: int, rank: int) -> Column:
    """Spans of the matches whose group has the least length, in order."""
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = lambda texts: F.transform(texts, lambda t: F.length(t).cast("long"))
    found = F.struct(lengths(gaps).alias("gaps"), lengths(whole).alias("sizes"), lengths(kept).alias("kept"))

    def placed(m: Column) -> Column:
        ends = running(F.transform(m["sizes"], lambda size, i: F.get(m["gaps"], i) + size))
        spans = F.zip_with(F.arrays_zip(m["sizes"], m["kept"]), ends, lambda x, end: F.struct(_span(end - x["sizes"], rank, end).alias("span"), (x["kept"] >= least).alias("ok")))
        return F.transform(F.filter(spans, lambda x: x["ok"]), lambda x: x["span"])

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(F.array().cast(SPAN))


def _events(spans: Column, weight: int) -> Column:
    """A step up at each start and down at each end."""
    step = lambda name, by: F.transform(spans, lambda s: F.struct(s[name].alias("at"), F.lit(by).cast("long").alias("by")))
    return F.concat(step("start", weight), step("end", -weight))


def _swept(events: Column) -> Column:
    """(at, by, sum so far, next at) of the events in order; where they tie, ends come first."""

    def sums(e: Column) -> Column:
        return let(running(F.transform(e, lambda x: x["by"])), lambda s: F.transform(e, lambda x, i: F.struct(x["at"].alias("at"), x["by"].alias("by"), F.get(s, i).alias("sum"), F.get(e, i + 1)["at"].alias("next"))))

    return let(F.sort_array(events), sums)


def with_spans(docs: DataFrame, model: list[float], text_col: str, base: str, every: str, threshold: float = THRESHOLD) -> DataFrame:
    """Adds two columns of sorted spans: those of the patterns, and these with those of the model."""
    text, other = F.coalesce(F.col(text_col), F.lit("")), unused(docs, "__more")
    rows = docs.withColumn(base, F.sort_array(F.concat(*[_spans(text, pattern, group, least, rank) for rank, (_, pattern, group, least) in enumerate(BASE)])))
    rows = rows.withColumn(other, _spans(text, CANDIDATE, 0, LEAST, len(BASE)))
    # where the sum is 1, a run is open and no base span: what base spans leave of the runs
    free = F.filter(_swept(F.concat(_events(F.col(other), 1), _events(F.col(base), 1 << 20))), lambda e: (e["sum"] == 1) & (e["next"] - e["at"] >= LEAST))
    apart = F.transform(free, lambda e: _span(e["at"], len(BASE), e["next"]))
    judged = let(pieces(text), lambda cut: F.filter(apart, lambda c: ratio(part(cut, c["start"], c["end"]), model) >= threshold))
    more = F.when(F.size(other) > 0, judged).otherwise(F.col(other))
    return rows.withColumn(every, F.sort_array(F.concat(base, more))).drop(other)


def _listed(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_markov, base_spans, spans."""
    rows = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, "text", "__base", "__all", threshold)
    number = lambda rank: F.size(F.filter("__all", lambda s: s["rank"] == rank)).cast("long")
    counts = [number(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, _listed("__base").alias("base_spans"), _listed("__all").alias("spans"))


def redact(docs: DataFrame, model: list[float], text_col: str = "text", mask: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """The same columns and rows, with each span, or run of overlapping spans, of the text replaced."""
    base, every = unused(docs, "__base"), unused(docs, "__all")
    rows, text = with_spans(docs, model, text_col, base, every, threshold), F.coalesce(F.col(text_col), F.lit(""))


    def masked(cut: Column) -> Column:
        def joined(bounds: Column) -> Column:
            before = F.transform(bounds["starts"], lambda s, i: F.concat(part(cut, F.coalesce(F.get(bounds["ends"], i - 1), F.lit(0)), s), F.lit(mask)))
            return F.concat(F.array_join(before, ""), part(cut, F.element_at(bounds["ends"], -1), F.length(text)))

        at = lambda e, by, total: F.transform(F.filter(e, lambda x: (x["by"] == by) & (x["sum"] == total)), lambda x: x["at"])
        return let(let(_swept(_events(F.col(every), 1)), lambda e: F.struct(at(e, 1, 1).alias("starts"), at(e, -1, 0).alias("ends"))), joined)

    return rows.withColumn(text_col, F.when(F.size(every) > 0, let(pieces(text), masked)).otherwise(F.col(text_col))).select(*docs.columns)
