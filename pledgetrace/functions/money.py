"""Money in running text: exact amounts, their currency, kind and year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profile import Profile
from .text import (NOT_BEFORE_WORD, WORD, _col, first_year, let, quote_regex, squash,
                   without_space)

NO_MATCH, MARK = r"(?!)", "\uffff"
MONEY = ("array<struct<amount_raw:string,currency:string,amount_native:string,"
         "amount:decimal(38,6),amount_huf:bigint,kind:string,year:int,sentence:string>>")


def sentence_around(left: Column, hit: Column, right: Column) -> Column:
    """The sentence a hit stands in, given the text before and after it. A newline begins
    a sentence, only a full stop followed by a space ends one."""
    head = F.substring_index(F.substring_index(left, ". ", -1), "\n", -1)
    tail = F.when(F.contains(right, F.lit(". ")),
                  F.concat(F.substring_index(right, ". ", 1), F.lit("."))).otherwise(right)
    return squash(F.concat(head, hit, tail))


def _looked_up(word: Column, values: dict, default: Column) -> Column:
    """The value of the lower-cased word, which is computed once."""
    if not values:
        return default
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.element_at(pairs, F.lower(word)), default)


def currency_of(word: Column, profile: Profile) -> Column:
    """Word as written -> ISO code, else the local currency."""
    codes = {w.lower(): code for w, code in reversed(list(profile.currency_words.items()))}
    return _looked_up(word, codes, F.lit(profile.currency))


def _plain_number(number: Column, profile: Profile) -> Column:
    bare = without_space(number)
    if profile.decimal_comma:
        return F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.replace(bare, F.lit(","), F.lit(""))


def _factor(word: Column, profile: Profile) -> Column:
    return _looked_up(word, profile.multiplier_words, F.lit(1)).cast("decimal(18,0)")


def _value(plain: Column, multiplier: Column, profile: Profile) -> Column:
    value = F.when(plain.rlike(r"\A\d+(\.\d*)?\z"), plain.try_cast("decimal(28,6)"))
    return (value * _factor(multiplier, profile)).cast("decimal(38,6)")


def _value_text(plain: Column, value: Column) -> Column:
    scale = F.length(F.regexp_extract(plain, r"\.(\d*)\z", 1))
    text = value.cast("string")
    whole = F.substring_index(text, ".", 1)
    return F.when(scale == 0, whole).otherwise(
        F.concat(whole, F.lit("."), F.left(F.substring_index(text, ".", -1),
                                           F.least(scale, F.lit(6)))))


def amount(number: Column, multiplier: Column, profile: Profile) -> Column:
    """Exact decimal value, null where the digits make no number."""
    return _value(_plain_number(number, profile), multiplier, profile)


def amount_text(number: Column, multiplier: Column, profile: Profile) -> Column:
    """The amount as text, with as many decimals as the page wrote."""
    return _value_text(_plain_number(number, profile), amount(number, multiplier, profile))


def budget_kind(sentence: Column, profile: Profile) -> Column:
    """First kind, in profile order, with a cue in the sentence."""
    def first(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, cues in reversed(list(profile.budget_cues.items())):
            for cue in cues:
                out = F.when(F.contains(low, F.lit(cue)), F.lit(kind)).otherwise(out)
        return out
    return let(F.lower(sentence), first)


def _pattern(profile: Profile) -> str:
    def alternatives(ws) -> str:
        return "|".join(quote_regex(w) for w in sorted(ws, key=len, reverse=True)) or NO_MATCH
    cur, mult = alternatives(profile.currency_words), alternatives(profile.multiplier_words)
    gap, digits = r"[\s\x1c-\x1f]*", r"[\p{Nd}\s\x1c-\x1f.,]*"
    before = rf"({cur}){gap}(\p{{Nd}}{digits}\p{{Nd}}|\p{{Nd}}){gap}(?:({mult}){NOT_BEFORE_WORD})?"
    after = rf"(\p{{Nd}}{digits}){gap}({mult})?{gap}({cur})(?!{WORD})"
    return f"(?iuU)(?:{before}|{after})"


def money_mentions(text: Column | str, profile: Profile) -> Column:
    """Every sum named in a text, in order, as an array of structs.

    One pass of one pattern gives the matches with their groups and the text between them; what
    stands before and after a match are its left and right context."""
    text = _col(text)
    if not profile.currency_words:
        return F.array().cast(MONEY)
    rx = _pattern(profile)
    # a code point no text may hold marks both ends of every match and of its word, number and
    # multiplier, which are groups of one of two alternatives
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit("\ufffd")), rx,
                              MARK.join(["", "$0", "$1$6", "$2$4", "$3$5", ""]))

    def read(parts: Column) -> Column:
        # parts: text, match, word, number, multiplier, text, …, text
        def all_of(page: Column) -> Column:
            # page: text, match, text, match, …, text
            def one(i: Column) -> Column:
                at = lambda n: F.element_at(parts, i * 5 - 5 + n)
                return F.struct(
                    at(2).alias("hit"), at(3).alias("word"), _plain_number(at(4), profile).alias("plain"),
                    at(5).alias("mult"),
                    F.array_join(F.slice(page, F.lit(1), i * 2 - 1), "").alias("left"),
                    F.array_join(F.slice(page, i * 2 + 1, F.size(page)), "").alias("right"))
            return F.transform(F.sequence(F.lit(1), F.floor(F.size(parts) / 5).cast("int")), one)
        return let(F.filter(parts, lambda _, i: i % 5 < 2), all_of)

    def finish(m: Column) -> Column:
        parts = F.struct(
            m["hit"].alias("hit"), currency_of(m["word"], profile).alias("code"), m["plain"].alias("plain"),
            _value(m["plain"], m["mult"], profile).alias("value"),
            sentence_around(m["left"], m["hit"], m["right"]).alias("sentence"))
        return let(parts, lambda p: F.struct(
            squash(p["hit"]).alias("amount_raw"), p["code"].alias("currency"),
            _value_text(p["plain"], p["value"]).alias("amount_native"), p["value"].alias("amount"),
            F.when(p["code"] == "HUF", p["value"].try_cast("bigint")).alias("amount_huf"),
            budget_kind(p["sentence"], profile).alias("kind"),
            first_year(p["sentence"]).alias("year"), p["sentence"].alias("sentence")))

    # most passages name no sum at all: look for a currency word before the full reading
    named = let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [
        F.contains(low, F.lit(w.lower())) for w in profile.currency_words]))
    found = F.when(named, F.split(marked, MARK, -1))
    return let(found, lambda parts: F.when(F.size(parts) > 1, F.transform(read(parts), finish).cast(MONEY)).otherwise(
        F.array().cast(MONEY)))


def relevant_money(mentions: Column, profile: Profile) -> Column:
    """Sums with a kind and a number, not trivially small, one per (currency, amount, kind)."""
    small = lambda m: (m["currency"] == profile.currency) & (m["amount"] < profile.min_amount)
    kept = F.filter(mentions, lambda m: m["kind"].isNotNull() & m["amount_native"].isNotNull()
                    & ~small(m))
    key = lambda m: F.concat_ws("|", m["currency"], m["amount_native"], m["kind"])
    return let(kept, lambda ms: let(F.transform(ms, key), lambda keys: F.filter(
        ms, lambda m, i: F.array_position(keys, key(m)) == i + 1)))
