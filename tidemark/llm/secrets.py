"""Secret scans: fixed patterns, and a randomness battery, in SQL functions only.

The patterns give the base spans. For the rest, long runs of key-like
characters are candidates. Each is put to a battery under the hypothesis that
it was drawn at random from the alphabet of its inferred encoding: a
chi-squared test of the alphabet's uniformity, a runs test about the alphabet's
middle and a lag-one serial-correlation test. Prose, paths and identifiers fail
it; keys pass. A Benjamini-Hochberg step within each band of lengths holds the
rejections to a false-discovery rate, so that the share of true keys thrown
out is bounded at every length; what is not rejected is a finding.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

# The base patterns, the shortest match, the group that it measures. A run of
# access or hex letters that is too short holds no other match, so their patterns have the length.
PATTERNS = {
    "assign": (r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    "access": (r"AKIA[A-Z0-9]{16,}", 20, 0),
    "hex": (r"[0-9a-f]{24,}", 24, 0),
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Alphabets by name, in order of preference: what a run must look like, its letters in order.
ENCODINGS = {
    "hex": (r"^[0-9a-f]+$|^[0-9A-F]+$", "0123456789abcdef"),
    "base32": (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "upper36": (r"^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower36": (r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base62": (r"^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base64": (r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    "base64url": (r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
}
FALSE_DISCOVERY = 0.01
CERTAIN = 1e-4
BLOCK = 32
PIECE = 4096


def _let(x: Column, f) -> Column:
    """``f`` of ``x``, with ``x`` evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _prefixes(values: Column, reduce) -> Column:
    """A struct of arrays that ``_before`` reads: the values, and block by block what ``reduce`` makes of them."""

    def level(lower: Column) -> Column:
        n = F.size(lower)
        starts = F.sequence(F.lit(0), F.greatest((n - 1) / BLOCK, F.lit(0)).cast("int"))
        return F.when(n > 0, F.transform(starts, lambda b: reduce(F.slice(lower, b * BLOCK + 1, BLOCK)))).otherwise(F.array().cast("array<bigint>"))

    def third(s: Column) -> Column:
        return _let(level(s["b"]), lambda c: F.struct(s["a"].alias("a"), s["b"].alias("b"), c.alias("c")))

    return _let(values, lambda a: _let(F.struct(a.alias("a"), level(a).alias("b")), third))


def _before(levels: Column, i: Column, reduce) -> Column:
    """``reduce`` of the first ``i`` values: of whole blocks of blocks, of whole blocks, and of the rest.

    Takes some 2 * BLOCK steps and one for each BLOCK ** 2 values, so a text's
    matches cost time in proportion to their number.
    """
    whole = F.floor(i / BLOCK).cast("int")
    more = F.floor(i / BLOCK**2).cast("int")
    parts = (F.slice(levels["c"], 1, more), F.slice(levels["b"], more * BLOCK + 1, whole - more * BLOCK), F.slice(levels["a"], whole * BLOCK + 1, i - whole * BLOCK))
    return reduce(F.array(*[reduce(x) for x in parts]))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _max(a: Column) -> Column:
    return F.coalesce(F.array_max(a), F.lit(-1).cast("bigint"))


def touching(runs: Column, base: Column) -> Column:
    """For each of ``runs``, disjoint and in order, whether it shares a place with one of ``base``, which is in order.

    Run ends and base starts are sorted together: a run's place there less its
    own number is how many spans begin before its end, and it touches one of
    them if the farthest end among these lies behind its start.
    """
    events = F.sort_array(F.concat(F.transform(runs, lambda r: F.struct(r["end"].alias("at"), F.lit(0).alias("span"))), F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("span")))))
    places = F.transform(F.filter(F.transform(events, lambda e, i: F.struct(e["span"].alias("span"), i.alias("i"))), lambda e: e["span"] == 0), lambda e, q: e["i"] - q)
    given = F.struct(places.alias("places"), _prefixes(F.transform(base, lambda b: b["end"]), _max).alias("ends"))
    return _let(given, lambda g: F.zip_with(runs, g["places"], lambda r, n: _before(g["ends"], n, _max) > r["start"]))


def find_spans(text: Column, pattern: str, least: int, group: int, kind: str) -> Column:
    """Array of struct(start, kind, end, match) of the matches long enough.

    ``split`` gives what lies between the matches and ``regexp_extract_all``
    the matches, so positions are sums of lengths. Positions are code points.
    """
    between = F.transform(F.split(text, pattern, -1), lambda s: F.length(s).cast("bigint"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def spans(m: Column) -> Column:
        steps = F.zip_with(F.slice(m["b"], 1, F.size(m["f"])), m["f"], lambda b, s: b + F.length(s))
        return _let(F.struct(m["f"].alias("f"), m["g"].alias("g"), steps.alias("steps")), placed)

    def placed(m: Column) -> Column:
        ends = _let(_prefixes(m["steps"], _sum), lambda levels: F.transform(m["steps"], lambda s, i: _before(levels, i, _sum) + s))
        long_enough = lambda e: F.filter(made(m, e), lambda x: x["size"] >= least)
        return _let(ends, lambda e: F.transform(long_enough(e), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["match"].alias("match"))))

    def made(m: Column, ends: Column) -> Column:
        return F.transform(
            m["f"],
            lambda s, i: F.struct((F.get(ends, i) - F.length(s)).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), s.alias("match"), F.length(F.get(m["g"], i)).alias("size")),
        )

    return _let(F.struct(between.alias("b"), found.alias("f"), measured.alias("g")), spans)


SPANS = "array<struct<start:bigint,kind:string,end:bigint,match:string>>"


def _normal_tail(z: Column) -> Column:
    """Two-sided tail of a standard normal; absolute error below 1e-7."""
    x = F.least(F.abs(z), F.lit(8.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(2 * F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly, F.lit(1.0))


def battery(match: Column) -> Column:
    """struct(encoding, n, p) of a candidate: the least of three p-values times three.

    The encoding is the first alphabet that has all of the run's letters and
    null if none has; p is then null. Trailing padding is left out.
    """
    encoding = F.lit(None).cast("string")
    alphabet = F.lit(None).cast("string")
    for name, (looks, letters) in reversed(ENCODINGS.items()):
        fits = match.rlike(looks)
        encoding = F.when(fits, F.lit(name)).otherwise(encoding)
        alphabet = F.when(fits, F.lit(letters)).otherwise(alphabet)

    def tests(s: Column) -> Column:
        body = F.when(s["encoding"] == "hex", F.lower(F.rtrim(s["match"], F.lit("=")))).otherwise(F.rtrim(s["match"], F.lit("=")))
        codes = lambda x: F.transform(F.split(x, ""), lambda c: (F.position(c, s["alphabet"]) - 1).cast("double"))
        return _let(body, lambda x: _let(F.struct(codes(x).alias("c"), x.alias("body"), s["alphabet"].alias("alphabet"), F.length(s["alphabet"]).cast("double").alias("m"), s["encoding"].alias("encoding")), scores))

    def scores(s: Column) -> Column:
        c, m = s["c"], s["m"]
        n = F.size(c).cast("double")
        letters = F.transform(F.array_distinct(c), lambda x: F.substring(s["alphabet"], (x + 1).cast("int"), F.lit(1)))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
        counts = F.transform(letters, lambda k: n - F.length(F.replace(s["body"], k, F.lit(""))))
        chi = total(F.transform(counts, lambda x: x * x)) * m / n - n
        # both hold for any number of draws, also for fewer than there are letters
        mean, var = m - 1, 2 * (m - 1) * (n - 1) / n
        low = F.transform(c, lambda x: F.when(x < m / 2, 1.0).otherwise(0.0))
        later = lambda a: F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))
        first = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
        changes = total(F.zip_with(first(low), later(low), lambda a, b: F.abs(a - b)))
        p_low = F.ceil(m / 2).cast("double") / m
        q = 2 * p_low * (1 - p_low)
        spread = F.sqrt((n - 1) * q * (1 - q))
        centre = (m - 1) / 2
        unit = (m * m - 1) / 12
        serial = total(F.zip_with(first(c), later(c), lambda a, b: (a - centre) * (b - centre))) / unit
        p = F.least(
            F.when(chi <= mean, F.lit(1.0)).otherwise(_normal_tail((chi - mean) / F.sqrt(var))),
            _normal_tail((changes - (n - 1) * q) / spread),
            _normal_tail(serial / F.sqrt(n - 1)),
        )
        return F.struct(s["encoding"].alias("encoding"), n.cast("bigint").alias("n"), F.least(3 * p, F.lit(1.0)).alias("p"))

    given = F.struct(encoding.alias("encoding"), alphabet.alias("alphabet"), match.alias("match"))
    return _let(given, lambda s: F.when(s["encoding"].isNotNull(), tests(s)))


def scan(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Base spans and tested candidates of each document, if asked with its text.

    ``base`` is an array of struct(start, kind, end, match); ``candidates``
    adds encoding, n and p. A candidate has letters and digits, and none that
    touches a base span is looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(SPANS)
    columns = {}
    for kind, (pattern, least, group) in PATTERNS.items():
        columns[f"_{kind}"] = F.when(text.rlike(pattern), find_spans(text, pattern, least, group, kind)).otherwise(none)
    mixed = lambda x: x["match"].rlike("[0-9]") & x["match"].rlike("[A-Za-z]")
    columns["_runs"] = F.when(text.rlike(CANDIDATE), F.filter(find_spans(text, CANDIDATE, 20, 0, "random"), mixed)).otherwise(none)
    kept = [c for c in docs.columns if (with_text or c != "text") and c.lower() not in ("base", "candidates", "spans")]
    row = F.struct(*[docs[f"`{c}`"] for c in kept]) if kept else F.lit(None)  # apart from the columns made here, whatever their names
    found = docs.select(row.alias("_row"), *[v.alias(k) for k, v in columns.items()])
    ranked = F.array_sort(F.transform(F.concat("_assign", "_access", "_hex"), lambda x: F.struct(x["start"].alias("start"), F.when(x["kind"] == "assign", 0).when(x["kind"] == "access", 1).otherwise(2).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"), x["match"].alias("match"))))
    base = F.transform(ranked, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["match"].alias("match")))
    found = found.withColumn("_both", F.struct(base.alias("base"), F.col("_runs").alias("runs")))
    tested = lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end"), battery(r["match"]).alias("test"))
    free = lambda b: _let(touching(b["runs"], b["base"]), lambda t: F.filter(b["runs"], lambda r, i: ~F.get(t, i)))
    result = _let(F.col("_both"), lambda b: F.struct(b["base"].alias("base"), F.transform(F.when(F.size(b["runs"]) > 0, free(b)).otherwise(b["runs"]), tested).alias("candidates")))
    return found.withColumn("_result", result).select(*["_row.*"] * bool(kept), "_result.base", "_result.candidates")


def _band(n: Column) -> Column:
    """Bands of lengths: each begins a fourth root of two above the last."""
    return F.floor(4 * F.log2(n.cast("double"))).cast("int")


def rejection_limits(scanned: DataFrame, rate: float = FALSE_DISCOVERY) -> dict[int, float]:
    """The largest p-value to reject in each band of lengths (Benjamini-Hochberg).

    P-values are counted in bins of a hundredth of a power of ten and a bin
    counts with its upper end, so the rate holds; there are at most some
    hundred bands of 1,601 bins, whatever the corpus holds.
    """
    c = scanned.select(F.explode("candidates.test").alias("t")).where("t.p is not null")
    bins = c.groupBy(_band(F.col("t.n")).alias("band"), F.greatest(F.ceil(100 * F.log10(F.greatest(F.col("t.p"), F.lit(1e-16)))), F.lit(-1600)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    limits: dict[int, float] = {}
    rows = sorted(tuple(r) for r in bins.collect())
    for band in {r[0] for r in rows}:
        own = [(b, n) for k, b, n in rows if k == band]
        total, seen = sum(n for _, n in own), 0
        for b, n in own:
            seen += n
            if 10 ** (b / 100) <= rate * seen / total:
                limits[band] = 10 ** (b / 100)
    return limits


def add_spans(scanned: DataFrame, limits: dict[int, float], certain: float = CERTAIN) -> DataFrame:
    """Replace candidates by ``spans``: base spans and what passed the battery."""
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else None

    def random(x: Column) -> Column:
        p = x["test"]["p"]
        bound = F.coalesce(limit[_band(x["test"]["n"])], F.lit(0.0)) if limits else F.lit(0.0)
        return p.isNotNull() & (p > bound) & (p > certain)

    extra = F.transform(F.filter("candidates", random), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit("").alias("match")))
    code = lambda x: F.when(x["kind"] == "assign", 0).when(x["kind"] == "access", 1).when(x["kind"] == "hex", 2).otherwise(3)
    both = F.array_sort(F.transform(F.concat("base", extra), lambda x: F.struct(x["start"].alias("start"), code(x).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))))
    spans = F.transform(both, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return scanned.withColumn("spans", spans).drop("candidates")


def scan_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """Add ``base`` and ``spans`` to documents and take ``text`` away.

    A candidate stays out if its band rejects it or its p-value is at most
    CERTAIN. Both columns are arrays of struct(start, kind, end), ``base``
    also with the match, by start and then kind as listed (assign, access,
    hex, random). A null or empty text has none; an empty table gives no rows;
    repeated rows are scanned each; other columns stay, but for ones named as
    these are. Time grows in proportion to a text's length and its matches.
    """
    scanned = keep(scan(docs), "secrets")
    return add_spans(scanned, rejection_limits(scanned, rate))


def redact(docs: DataFrame, mark: str = "[secret]", rate: float = FALSE_DISCOVERY) -> DataFrame:
    """Documents with each stretch of secret spans replaced by ``mark``.

    The columns are those of ``docs``; ``n_chars`` is counted anew where
    something was replaced. Overlapping spans make one stretch. A null text
    stays null.
    """
    limits = rejection_limits(keep(scan(docs.select("text")).select("candidates"), "candidates"), rate)
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), "text")
    marked = add_spans(scan(whole, with_text=True), limits)
    found = F.size("spans") > 0
    text = F.when(found, _replaced(F.col("text"), F.col("spans"), mark)).otherwise(F.col("text"))
    clean = marked.withColumn("clean", text)
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(found, F.length("clean").cast("bigint")).otherwise(columns["n_chars"])
    return clean.select(*[v.alias(c) for c, v in columns.items()])


def _replaced(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark`` for each stretch of spans, which are in order.

    The text is cut into pieces of PIECE code points first, so that a place is
    found without a walk from the text's begin.
    """

    def between(pieces: Column, a: Column, b: Column) -> Column:
        i, j = (F.floor(x / PIECE).cast("int") for x in (a, b))
        part = lambda p, begin, n: F.substring(F.coalesce(F.get(pieces, p), F.lit("")), (begin + 1).cast("int"), n.cast("int"))
        apart = F.concat(part(i, a % PIECE, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), part(j, F.lit(0), b % PIECE))
        return F.when(i == j, part(i, a % PIECE, b - a)).otherwise(apart)

    def kept(g: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            covered = lambda c: F.when(x["start"] >= c, F.concat(between(g["pieces"], c, x["start"]), F.lit(mark))).otherwise("")
            return _let(F.greatest(_before(g["ends"], i, _max), F.lit(0).cast("bigint")), covered)

        last = _let(F.array_max(F.transform(spans, lambda x: x["end"])), lambda c: between(g["pieces"], c, F.length(text).cast("bigint")))
        return F.concat(F.array_join(F.transform(spans, one), ""), last)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return _let(F.struct(pieces.alias("pieces"), _prefixes(F.transform(spans, lambda x: x["end"]), _max).alias("ends")), kept)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
