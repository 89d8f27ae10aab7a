"""Text columns. Every function takes and returns Columns and stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# whitespace and word characters as Unicode text rules understand them
WS = r"[\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
NOT_AFTER_WORD = rf"(?<!{WORD})"
NOT_BEFORE_WORD = rf"(?!{WORD})"

# fixed values: characters allowed in a section code, and what may trail a dropped code
CODE_UPPER = "A-ZÁÉÍÓÖŐÚÜŰ"
CODE_LOWER = "a-záéíóöőúüű"
FILE_ENDINGS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "rtf", "csv",
                "txt", "zip")
KINDS = ("objective", "measure", "target", "indicator")
PAGE_CHARS = 6000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value computed once. Lambdas see no common subexpressions, so anything
    costly used inside one is bound first."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quote_regex(text: str) -> str:
    """A literal for java.util.regex."""
    return "".join(ch if ch.isalnum() or ch == "_" or ord(ch) > 127 or ch == " " else "\\" + ch
                   for ch in text)


def squash(c: Column | str) -> Column:
    """Runs of whitespace become one space, ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), f"(?U){WS}+", " "))


def strip(c: Column | str, extra: str = "") -> Column:
    """Whitespace (and ``extra`` characters) off both ends."""
    cls = rf"[\s\x1c-\x1f{extra}]"
    return F.regexp_replace(_col(c), rf"(?U)\A{cls}+|{cls}+\z", "")


def without_space(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"(?U){WS}+", "")


def has_text(c: Column | str) -> Column:
    return _col(c).rlike(r"(?U)[^\s\x1c-\x1f]")


def casefold(c: Column | str) -> Column:
    return F.translate(F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss")), "ς", "σ")


def norm(c: Column | str) -> Column:
    """Casefolded words only; the underscore is a word character."""
    return F.trim(F.regexp_replace(casefold(c), f"{NON_WORD}+", " "))


def words(c: Column | str) -> Column:
    """Whitespace-separated words, no empty ones."""
    return F.filter(F.split(_col(c), f"(?U){WS}+"), lambda w: w != "")


def terms(c: Column | str) -> Column:
    """Lowercased word tokens, the default lexical analysis."""
    return F.filter(F.split(F.lower(_col(c)), f"{NON_WORD}+"), lambda w: w != "")


def receipt(page: Column | str, excerpt: Column | str) -> Column:
    """Where the page prints the excerpt, whitespace aside, in the page's own characters.

    The excerpt becomes one pattern, its characters with optional whitespace in between, so
    the first hit is exactly the first hit in the whitespace-free page."""
    gap = "￿"
    bare = without_space(excerpt)
    escaped = F.regexp_replace(bare, r"([^\p{L}\p{N}])", r"\\$1")
    spaced = F.regexp_replace(escaped, r"(?s)(\\?+.)(?=.)", "$1" + gap)
    pattern = F.concat(F.lit("(?U)"), F.replace(spaced, F.lit(gap), F.lit(f"{WS}*")))
    return F.when(bare != "", F.regexp_substr(_col(page), pattern))


def on_page(page: Column | str, excerpt: Column | str) -> Column:
    """A receipt is a non-blank literal piece of its page."""
    return F.coalesce(has_text(excerpt) & F.contains(_col(page), _col(excerpt)), F.lit(False))


def lead_code(title: Column | str) -> Column:
    """P5: section code in front of a title; a bare year or number is none."""
    t = strip(title)
    lettered = (rf"\A([{CODE_UPPER}][{CODE_LOWER}]{{0,2}}-?\d+(?:\.\d+)*)"
                rf"(?=[\s:.)\-]|\z)")
    dotted = rf"\A(\d+(?:\.\d+)+)(?=\s+[{CODE_UPPER}])"
    return F.coalesce(F.nullif(F.regexp_extract(t, lettered, 1), F.lit("")),
                      F.nullif(F.regexp_extract(t, dotted, 1), F.lit("")))


def grounded_title(title: Column | str, text: Column | str, page: Column | str) -> Column:
    """struct(title, code); a code the page never prints is dropped from the title."""
    code = lead_code(title)
    printed = F.contains(without_space(page), without_space(code))
    rest = F.regexp_replace(F.substring(strip(title), F.length(code) + 1, F.lit(1 << 30)),
                            r"\A[ :.\-–]+", "")
    return F.when(code.isNull() | printed,
                  F.struct(_col(title).alias("title"), code.alias("code"))).otherwise(
        F.struct(F.when(rest != "", rest).otherwise(F.left(_col(text), F.lit(120)))
                 .alias("title"), F.lit(None).cast("string").alias("code")))


def form_row(quote: Column | str, labels: Sequence[str]) -> Column:
    """A fact-sheet row: begins with a field label, or little is left without the labels."""
    if not labels:
        return F.lit(False)
    low = F.regexp_replace(squash(casefold(quote)), r"\A[•\-–* :]+", "")
    bounded = {w: NOT_AFTER_WORD + quote_regex(w) + NOT_BEFORE_WORD
               for w in sorted(labels, key=len, reverse=True)}
    starts = low.rlike(r"\A(?:" + "|".join(bounded.values()) + ")")
    rest, found = low, F.lit(False)
    for rx in bounded.values():
        hit = low.rlike(rx)
        rest = F.when(hit, F.regexp_replace(rest, rx, " ")).otherwise(rest)
        found = found | hit
    return found & (starts | (F.regexp_count(rest, F.lit(r"\p{L}{3,}")) < 4))


def valid_kind(kind: Column | str) -> Column:
    """Only commitments proper; background and unclear rows go."""
    return _col(kind).isin(*KINDS)


def page_block(number: Column | str, text: Column | str) -> Column:
    """One page as shown to a reader model."""
    return F.concat(F.lit("--- page "), _col(number).cast("string"), F.lit(" ---\n"),
                    F.left(_col(text), F.lit(PAGE_CHARS)))


def halves(text: Column | str) -> Column:
    """The two line halves of a page too long for one answer."""
    lines = F.split(F.regexp_replace(_col(text), r"\r?\n\z", ""), r"\r\n|[\n\r]")
    mid = F.floor(F.size(lines) / 2).cast("int")
    return F.when(F.size(lines) >= 2, F.array(
        F.array_join(F.slice(lines, F.lit(1), mid), "\n"),
        F.array_join(F.slice(lines, mid + 1, F.size(lines) - mid), "\n")))


def display_title(title: Column | str) -> Column:
    """Markdown marks and stray punctuation off a title."""
    plain = squash(F.regexp_replace(F.coalesce(_col(title), F.lit("")), r"[*_#`>]+", ""))
    return strip(plain, ".:–—\\-")


def title_tokens(title: Column | str, stopwords: Sequence[str]) -> Column:
    """The distinct telling words of a title."""
    toks = F.filter(F.split(F.lower(_col(title)), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1)
    stop = F.array(*[F.lit(s) for s in sorted(stopwords)]) if stopwords else None
    return F.array_distinct(toks) if stop is None else F.array_except(toks, stop)


YEAR = NOT_AFTER_WORD + r"(?:19|20)\p{Nd}{2}" + NOT_BEFORE_WORD


def years(text: Column | str) -> Column:
    """Distinct bare years in the order they appear."""
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(YEAR), F.lit(0)))


def first_year(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(text), YEAR, 0), F.lit("")).cast("int")


def host(url: Column | str) -> Column:
    return F.lower(F.try_parse_url(_col(url), F.lit("HOST")))


def host_suffixes(name: Column) -> Column:
    """Every dot-suffix of a host, itself first: turns "host or subdomain of" into equality."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def web_url(url: Column | str) -> Column:
    """http(s) without user or password."""
    return (F.lower(F.try_parse_url(_col(url), F.lit("PROTOCOL"))).isin("http", "https")
            & F.try_parse_url(_col(url), F.lit("USERINFO")).isNull())


def canonical_url(url: Column | str) -> Column:
    """Without the fragment."""
    return F.substring_index(_col(url), "#", 1)


def bare_url(url: Column | str) -> Column:
    """Without the query."""
    return F.substring_index(_col(url), "?", 1)


def search_key(title: Column | str, code: Column | str) -> Column:
    """First ten words of the title, then the code."""
    return strip(F.concat_ws(" ", F.array_join(F.slice(words(title), 1, 10), " "), _col(code)))


def query_text(title: Column | str, summary: Column | str, code: Column | str) -> Column:
    """The string a commitment is searched by."""
    return F.concat(_col(title), F.lit(" "), F.coalesce(_col(summary), F.lit("")), F.lit(" "),
                    F.coalesce(_col(code), F.lit("")))


def predates(published_on: Column | str, baseline_year: int | None) -> Column:
    """Published before the strategy; unknown dates or years never are."""
    if baseline_year is None:
        return F.lit(False)
    return F.coalesce(F.year(_col(published_on)) < F.lit(baseline_year), F.lit(False))


def norm_place(name: Column | str, suffixes: Sequence[str]) -> Column:
    """Lowercase base form; the first fitting ending of the last word goes."""
    low = squash(F.lower(_col(name)))
    last = F.substring_index(low, " ", -1)
    cut = None
    for s in suffixes:
        fits = F.endswith(last, F.lit(s)) & (F.length(last) - len(s) >= 3)
        cut = F.when(fits, F.lit(len(s))) if cut is None else cut.when(fits, F.lit(len(s)))
    if cut is None:
        return low
    return F.left(low, F.length(low) - F.coalesce(cut.otherwise(F.lit(0)), F.lit(0)))


def content_key(model: Column | str, size: int, text: Column | str) -> Column:
    """Key of a page's vectors; another model, chunk size or text makes another key."""
    return F.left(F.sha2(F.concat(F.lit("structure-v2|"), _col(model), F.lit(f"|{size}|"),
                                  _col(text)), 256), F.lit(24))


def text_key(text: Column | str) -> Column:
    """Short hash of a whole text."""
    return F.left(F.sha2(_col(text), 256), F.lit(16))


def short_number(c: Column | str) -> Column:
    """Six significant digits, no trailing zeros, an exponent from a million up."""
    sci = F.format_string("%.5e", _col(c).cast("double"))
    power = F.substring_index(sci, "e", -1).try_cast("int")
    trim = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+\z", "$1"), r"\.\z", "")
    return F.when(_col(c).isNull(), F.lit(None)).when(_col(c) == 0, F.lit("0")).when(
        power.between(-4, 5), trim(sci.try_cast("decimal(38,10)").cast("string"))).otherwise(
        F.concat(trim(F.substring_index(sci, "e", 1)), F.lit("e"), F.substring_index(sci, "e", -1)))


def goal(target: Column | str, unit: Column | str, deadline: Column | str,
         timeframe: Column | str) -> Column:
    """P24: "100 trees by 2027"; a dash where nothing is stated."""
    number = short_number(target)
    value = F.concat_ws(" ", number, F.nullif(_col(unit), F.lit("")))
    when = F.coalesce(_col(deadline).cast("string"), _col(timeframe))
    both = F.concat_ws(" by ", F.nullif(value, F.lit("")), F.nullif(when, F.lit("")))
    return F.when(both != "", both).otherwise(F.lit("–"))


def huf(amount: Column | str) -> Column:
    """P24: "1 234 567 Ft", halves rounded to even."""
    whole = F.format_number(F.bround(_col(amount).cast("decimal(38,6)"), 0), 0)
    return F.coalesce(F.concat(F.replace(whole, F.lit(","), F.lit(" ")), F.lit(" Ft")),
                      F.lit(""))


def page_link(url: Column | str, page: Column | str) -> Column:
    """struct(label, href) opening the strategy at a page."""
    number = _col(page).cast("string")
    known = F.coalesce(_col(url), F.lit("")) != ""
    return F.struct(
        F.concat(F.when(known, F.lit("Strategy · page ")).otherwise(F.lit("Source · page ")),
                 number).alias("label"),
        F.when(known, F.concat(canonical_url(url), F.lit("#page="), number)).alias("href"))


def evidence_kind(url: Column | str, title: Column | str) -> Column:
    """Planning papers against concrete project pages."""
    cue = r"(?iu)strateg|strategy|jelent|report|action.?plan|program"
    report = (F.coalesce(_col(url), F.lit("")).rlike(cue)
              | F.coalesce(_col(title), F.lit("")).rlike(cue))
    return F.when(report, F.lit("Strategy / report")).otherwise(F.lit("Project / update"))


def code_hint(code: Column | str, glossary: dict[str, str]) -> Column:
    """P25: struct(meaning, depth): what a code's letters stand for, how deep it is."""
    rx = r"\A([A-Za-z]+)(\d+(?:\.\d+)*)"
    if not glossary:
        return F.lit(None).cast("struct<meaning:string,depth:int>")
    table = F.create_map(*[F.lit(x) for kv in glossary.items() for x in kv])
    meaning = F.try_element_at(table, F.regexp_extract(_col(code), rx, 1))
    depth = F.size(F.split(F.regexp_extract(_col(code), rx, 2), r"\."))
    return F.when(meaning.isNotNull(), F.struct(meaning.alias("meaning"), depth.alias("depth")))


def candidate_note(code: Column | str, kind: Column | str, page: Column | str,
                   text: Column | str, excerpt: Column | str) -> Column:
    """A candidate as shown to a note writer."""
    return F.concat(F.lit("code: "), F.coalesce(_col(code), F.lit("-")), F.lit("\ntype guess: "),
                    _col(kind), F.lit("\npage "), _col(page).cast("string"), F.lit(": "),
                    _col(text), F.lit("\nverbatim quote: "), _col(excerpt))


def link_note(code: Column | str, commitment: Column | str, url: Column | str,
              published: Column | str, title: Column | str, snippet: Column | str) -> Column:
    """A suggested link as shown to a note writer; at most 1500 characters of passage."""
    return F.concat(F.lit("commitment: "), F.coalesce(_col(code), F.lit("")), F.lit(" "),
                    _col(commitment), F.lit("\nevidence from "), _col(url), F.lit(" ("),
                    F.coalesce(_col(published).cast("string"), F.lit("no date")), F.lit("):\n"),
                    _col(title), F.lit("\n"), F.left(_col(snippet), F.lit(1500)))


def word_pack(text: Column | str, size: int = 1000) -> Column:
    """Pieces of at most ``size`` characters that never cut a word; one greedy pattern."""
    return F.regexp_extract_all(squash(text), F.lit(rf"(.{{1,{size}}}|[^ ]+)(?: |\z)"),
                                F.lit(1))


def dedupe_names(names: Column | str) -> Column:
    """One spelling per name: the first one, standing where the last one stood."""
    def pick(b: Column) -> Column:
        low, names = b["low"], b["names"]
        rest = lambda i: F.slice(low, i + 2, F.greatest(F.size(low) - i - 1, F.lit(0)))
        last = F.filter(low, lambda n, i: F.array_position(rest(i), n) == 0)
        return F.transform(last, lambda n: F.element_at(
            names, F.array_position(low, n).cast("int")))
    return let(F.struct(F.transform(_col(names), F.lower).alias("low"),
                        _col(names).alias("names")), pick)


def filename_like(url: Column | str, title: Column | str) -> Column:
    """A page title that is just its address or a file name."""
    return ((_col(title) == _col(url))
            | _col(title).rlike(r"(?iu)\.(?:" + "|".join(FILE_ENDINGS) + r")\z"))
