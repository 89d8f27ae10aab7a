"""Secrets in texts: known shapes, and tokens that look drawn at random. DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three shapes. The rest of a text is
searched for long tokens. The encoding of a token is the smallest alphabet that holds it, and a
battery of tests looks at its characters there: the chi-squared statistic of uniform use, the runs
of characters above and below the middle of the alphabet, and the correlation of neighbours. A
token is structured, and no secret, if runs and correlation together reject randomness. Of the
others, p is the chance that written text, which uses characters unevenly, is as uniform as the
token is; it shrinks with length. The Benjamini-Hochberg rule, over the distinct tokens of all
texts and apart for every doubling of length, sets the p up to which tokens are reported, so that
the expected share of false ones stays below RATE at every length.

Defined cases. A null text counts as empty. Repeated rows have the same spans. Tokens that touch
a base span are not added to it. Without candidates nothing is added. An empty table gives no
rows. Other columns of the input are ignored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import unused

#: fixed values: kind, pattern, least length, group whose length counts
SHAPES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1),
    ("access", r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", r"[0-9a-f]+", 32, 0),
)
#: the same found faster: shorter matches of these two would be dropped anyway, and none hides a longer one
FAST = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
KIND = "random"

_LOW, _UP, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: encodings from the smallest alphabet to the largest
ALPHABETS = (
    ("decimal", _DIGIT), ("hex", _DIGIT + "abcdef"), ("HEX", _DIGIT + "ABCDEF"), ("lower", _LOW), ("upper", _UP),
    ("words", _LOW + "-_"), ("base32", _UP + "234567"), ("lower36", _LOW + _DIGIT), ("upper36", _UP + _DIGIT), ("letters", _UP + _LOW),
    ("base62", _UP + _LOW + _DIGIT), ("base64", _UP + _LOW + _DIGIT + "+/"), ("base64url", _UP + _LOW + _DIGIT + "-_"),
    ("mixed", _UP + _LOW + _DIGIT + "+/-_"),
)
#: how much more often than under uniform use two characters of written text are equal, per size of
#: the alphabet: equal letters have a chance of about 0.066
TEXT_MATCH = 0.066
STRUCTURE, RATE = 0.01, 0.01
#: p values are counted in bins of a tenth of a decade; lengths in doublings
BINS, BANDS = 300, 24

_IN, _OUT = "\u0001", "\u0002"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Each place's value put together with all before it, ``both`` being a sum, greatest or least.

    Every place takes in the one before it, then what the second before it has by then, the fourth
    and so on: an array costs its size times its doublings, where a fold that appends to an array
    copies it at every step."""
    doublings = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")
    jumps = F.transform(F.sequence(F.lit(0), doublings), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(jumps, values, lambda acc, jump: F.transform(
        acc, lambda v, i: F.when(i >= jump, both(v, F.get(acc, i - jump))).otherwise(v)))


def marks(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of all leftmost non-overlapping matches, in code points."""
    clean = F.translate(text, _IN + _OUT, "\u0003\u0003")  # no shape has control characters
    parts = F.split(F.regexp_replace(clean, f"({pattern})", f"{_IN}$1{_OUT}"), f"[{_IN}{_OUT}]", -1)
    ends = lambda p: running(F.transform(p, lambda x: F.length(x)), lambda v, w: v + w)
    # what lies at the odd places was matched
    placed = bound(parts, lambda p: bound(F.struct(p.alias("p"), ends(p).alias("e")), lambda s: F.filter(
        F.transform(s["p"], lambda m, i: F.struct((F.get(s["e"], i) - F.length(m)).alias("start"), F.get(s["e"], i).alias("end"),
                                                  m.alias("match"))), lambda m, i: i % 2 == 1)))
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(text.rlike(pattern), placed).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end, kind) of the base shapes, unsorted."""
    found = []
    for rank, (kind, pattern, least, group) in enumerate(SHAPES):
        size = (lambda m, p=pattern, g=group: F.length(F.regexp_extract(m["match"], p, g)))
        kept = F.filter(marks(text, FAST.get(kind, pattern)), lambda m: size(m) >= least)
        found.append(F.transform(kept, lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))))
    return F.concat(*found)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal within about 0.003, in closed form."""
    half = lambda x: 0.5 * F.exp(-0.717 * x - 0.416 * x * x)
    return F.when(z >= 0, half(z)).otherwise(1 - half(-z))


def battery(token: Column) -> Column:
    """(n, k, encoding, chi2, z_runs, z_serial, structure, p) of a token, padding left aside.

    ``structure`` is Fisher's combination of the two-sided runs and correlation tests, ``p`` the
    chance of written text to be as uniform."""
    def of(body: Column) -> Column:
        encoding = alphabet = None
        for name, chars in ALPHABETS:
            held = F.translate(body, chars, "") == ""
            encoding = F.when(held, name) if encoding is None else encoding.when(held, name)
            alphabet = F.when(held, chars) if alphabet is None else alphabet.when(held, chars)
        return F.transform(F.array(F.struct(body.alias("b"), encoding.alias("e"), alphabet.alias("a"))), counted)[0]

    def counted(s: Column) -> Column:
        n, k = F.length(s["b"]).cast("double"), F.length(s["a"]).cast("double")
        squares = F.aggregate(F.split(s["a"], ""), F.lit(0.0), lambda acc, c: acc + F.when(
            c == "", 0.0).otherwise(F.pow(F.length(s["b"]) - F.length(F.replace(s["b"], c, F.lit(""))), 2)))
        places = F.transform(F.filter(F.split(s["b"], ""), lambda c: c != ""), lambda c: (F.position(c, s["a"]) - 1).cast("double"))
        return F.transform(F.array(F.struct(s["e"].alias("e"), n.alias("n"), k.alias("k"), (squares * k / n - n).alias("chi2"),
                                            places.alias("x"))), centred)[0]

    def centred(s: Column) -> Column:
        # bound here, as lambdas would work these out anew for every character
        mean = F.aggregate(s["x"], F.lit(0.0), lambda acc, v: acc + v) / s["n"]
        high = F.transform(s["x"], lambda v: (v >= s["k"] / 2).cast("int"))
        return F.transform(F.array(F.struct(*[s[c].alias(c) for c in ("e", "n", "k", "chi2", "x")], mean.alias("mean"),
                                            high.alias("high"))), tested)[0]

    def tested(s: Column) -> Column:
        n, k, x, mean, high = s["n"], s["k"], s["x"], s["mean"], s["high"]
        ones = F.aggregate(high, F.lit(0.0), lambda acc, v: acc + v)
        pairs = F.arrays_zip(F.slice(high, F.lit(1), F.size(x) - 1).alias("u"), F.slice(high, F.lit(2), F.size(x) - 1).alias("v"),
                             F.slice(x, F.lit(1), F.size(x) - 1).alias("p"), F.slice(x, F.lit(2), F.size(x) - 1).alias("q"))
        runs = F.aggregate(pairs, F.lit(1.0), lambda acc, t: acc + F.when(t["u"] != t["v"], 1.0).otherwise(0.0))
        spread = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
        together = F.aggregate(pairs, F.lit(0.0), lambda acc, t: acc + (t["p"] - mean) * (t["q"] - mean))
        due = 2 * ones * (n - ones) / n + 1
        vary = (due - 1) * (due - 2) / (n - 1)
        # a token on one side of its alphabet, or of one character, is as structured as can be
        z_runs = F.when(vary > 0, (runs - due) / F.sqrt(vary)).otherwise(F.lit(-30.0))
        z_serial = F.when(spread > 0, (together / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(30.0))
        # chi-squared of written text: its mean over k - 1, and its spread, grow with n
        excess = F.greatest(k * TEXT_MATCH, F.lit(1.4)) - 1
        z_text = (s["chi2"] - (k - 1) - (n - 1) * excess) / F.sqrt(2 * (k - 1) + 4 * (n - 1) * excess)
        half = -F.log(F.greatest(2 * upper_tail(F.abs(z_runs)), F.lit(1e-30))) - F.log(
            F.greatest(2 * upper_tail(F.abs(z_serial)), F.lit(1e-30)))
        return F.struct(n.cast("int").alias("n"), k.cast("int").alias("k"), s["e"].alias("encoding"), s["chi2"].alias("chi2"),
                        z_runs.alias("z_runs"), z_serial.alias("z_serial"), (F.exp(-half) * (1 + half)).alias("structure"),
                        upper_tail(-z_text).alias("p"))

    return of(F.rtrim(F.replace(token, F.lit("="), F.lit(" "))))


def judged_tokens(text: Column) -> Column:
    """Array of (start, end, match, n, band, bin) of the unstructured tokens; bin is
    -10 log10 p, rounded down, so that a bin never makes a token look rarer than it is."""
    def judged(m: Column) -> Column:
        return F.transform(F.array(battery(m["match"])), lambda b: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), b["structure"].alias("structure"),
            F.least(F.floor(F.log2(b["n"].cast("double"))), F.lit(BANDS - 1)).cast("int").alias("band"),
            F.least(F.floor(-10 * F.log10(F.greatest(b["p"], F.lit(1e-30)))), F.lit(BINS)).cast("int").alias("bin")))[0]

    return F.filter(F.transform(marks(text, TOKEN), judged), lambda j: j["structure"] >= STRUCTURE)


def thresholds(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """Per band of lengths the least bin that is reported: at most BANDS numbers.

    Distinct tokens are counted per band and bin; the least bin is the largest p of which
    p * tokens / tokens up to p is within RATE."""
    tokens = docs.select(F.explode(judged_tokens(F.coalesce(text, F.lit("")))).alias("j")).select(
        "j.band", "j.bin", F.sha2("j.match", 256).alias("match")).distinct()
    bins = tokens.groupBy("band", "bin").count()  # at most BANDS * (BINS + 1) rows
    whole = Window.partitionBy("band")
    up_to = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = bins.select("band", "bin", F.sum("count").over(whole).alias("all"), F.sum("count").over(up_to).alias("found"))
    kept = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / 10) * F.col("all") <= RATE * F.col("found"))
    return {r["band"]: r["bin"] for r in kept.groupBy("band").agg(F.min("bin").alias("bin")).collect()}


def spans(text: Column, least_bin: dict[int, int]) -> Column:
    """Array of (start, rank, end, kind): base spans and reported tokens, by start, then kind."""
    text, last = F.coalesce(text, F.lit("")), F.lit(2**31 - 1)
    if not least_bin:
        return F.array_sort(base_spans(text))
    bins = F.create_map(*[F.lit(v) for pair in least_bin.items() for v in pair])
    reported = F.filter(judged_tokens(text), lambda j: j["bin"] >= F.coalesce(F.element_at(bins, j["band"]), F.lit(BINS + 1)))
    tokens = F.transform(reported, lambda j: F.struct(
        j["start"].alias("start"), F.lit(len(SHAPES)).alias("rank"), j["end"].alias("end"), F.lit(KIND).alias("kind")))
    is_base = lambda s: s["rank"] < len(SHAPES)

    def apart(sorted_spans: Column) -> Column:
        """Without the tokens that a base span before them reaches into or that reach into the next."""
        held = running(F.transform(sorted_spans, lambda s: F.when(is_base(s), s["end"]).otherwise(F.lit(0))), F.greatest)
        ahead = F.reverse(running(F.reverse(F.transform(
            sorted_spans, lambda s: F.when(is_base(s), s["start"]).otherwise(last))), F.least))
        return bound(F.struct(sorted_spans.alias("s"), held.alias("h"), ahead.alias("a")), lambda t: F.filter(
            t["s"], lambda s, i: is_base(s) | ((F.get(t["h"], i) <= s["start"]) & (F.get(t["a"], i) >= s["end"]))))

    return bound(F.struct(base_spans(text).alias("b"), tokens.alias("t")), lambda f: F.when(
        (F.size(f["b"]) == 0) | (F.size(f["t"]) == 0), F.array_sort(F.concat(f["b"], f["t"]))).otherwise(
        bound(F.array_sort(F.concat(f["b"], f["t"])), apart)))


def secret_spans(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``spans``, an array of (start, rank, end, kind), end exclusive."""
    return docs.select(*keep, spans(F.col(text), thresholds(docs, text)).alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by its kind in brackets; overlapping spans
    become one, named after the first."""
    found = spans(F.col(text), thresholds(docs, text))
    held = unused(docs, "_spans")

    def cut(s: Column) -> Column:
        """Of (spans, furthest end so far): the text with its secrets named, an array of strings."""
        gaps = F.filter(F.transform(s["s"], lambda x, i: F.struct(
            F.coalesce(F.get(s["e"], i - 1), F.lit(0)).alias("a"), x["start"].alias("b"), x["kind"].alias("kind"))),
            lambda g: g["b"] >= g["a"])
        # a place in a text is found by walking there, so gaps are cut from a stretch that holds the root of their number
        size = lambda g: F.ceil(F.sqrt(F.size(g).cast("double"))).cast("int")
        stretch = lambda g: F.struct(g.alias("g"), g[0]["a"].alias("a"), F.substring(
            F.col(text), g[0]["a"] + 1, F.element_at(g, -1)["b"] - g[0]["a"]).alias("t"))
        named = lambda w: F.transform(w["g"], lambda g: F.concat(
            F.substring(w["t"], g["a"] - w["a"] + 1, g["b"] - g["a"]), F.lit("["), g["kind"], F.lit("]")))
        parts = bound(gaps, lambda g: F.flatten(F.transform(
            F.sequence(F.lit(0), F.ceil(F.size(g) / size(g)).cast("int") - 1),
            lambda k: bound(bound(F.slice(g, k * size(g) + 1, size(g)), stretch), named))))
        rest = F.substring(F.col(text), F.element_at(s["e"], -1) + 1, F.length(text))
        return F.concat(parts, F.array(rest))

    reach = lambda s: F.struct(s.alias("s"), running(F.transform(s, lambda x: x["end"]), F.greatest).alias("e"))
    out = F.array_join(bound(bound(F.col(held), reach), cut), "")
    return docs.withColumn(held, found).withColumn(text, F.when(F.size(held) > 0, out).otherwise(F.col(text))).drop(held)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query: counts of the base kinds, their digest, all spans as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != KIND)
    return secret_spans(docs, ["doc_id"]).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k, *_ in SHAPES],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
