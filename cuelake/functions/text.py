"""Names, clocks and other text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words that the material uses, by value.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
NUMBER_WORDS += ["eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]


def counting(limit: int = 99) -> dict[str, int]:
    """Number words up to `limit`, tens and units run together."""
    words = {w: i for i, w in enumerate(NUMBER_WORDS)}
    for i, ten in enumerate(TENS, 2):
        words[ten] = 10 * i
        words |= {ten + unit: 10 * i + k for k, unit in enumerate(NUMBER_WORDS[1:10], 1)}
    return {w: n for w, n in words.items() if n <= limit}


def number_map(limit: int = 99) -> Column:
    return F.create_map(*(x for w, n in counting(limit).items() for x in (F.lit(w), F.lit(str(n)))))


def _millis(seconds: Column) -> Column:
    return F.rint(seconds * F.lit(1000.0)).cast("long")


def clock_dashes(seconds: Column) -> Column:
    """HH-MM-SS.mmm, halves to even."""
    ms = _millis(seconds)
    return F.format_string("%02d-%02d-%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def clock_colons(seconds: Column) -> Column:
    """H:MM:SS.mmm, halves to even."""
    ms = _millis(seconds)
    return F.format_string("%d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def clock_short(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; fractions are cut off."""
    s = F.floor(seconds)
    return F.when(s < 3600, F.format_string("%d:%02d", F.floor(s / 60), s % 60)).otherwise(F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def clock_units(seconds: Column) -> Column:
    """1h02m, 3m04s or 5s."""
    s = F.floor(seconds)
    return (
        F.when(s >= 3600, F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s / 60) % 60))
        .when(s >= 60, F.format_string("%dm%02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%ds", s))
    )


def parse_clock(text: Column) -> Column:
    """any number of parts between colons, base 60; null for anything else."""
    ok = text.rlike(r"^[0-9]+(\.[0-9]+)?(:[0-9]+(\.[0-9]+)?)*$")
    total = F.aggregate(F.split(text, ":"), F.lit(0.0), lambda a, x: a * 60.0 + x.try_cast("double"))
    return F.when(ok, total)


def parse_offset(text: Column) -> Column:
    """hh:mm:ss(.f), or a number with h, m, s or ms; null for anything else."""
    unit = F.regexp_extract(text, r"^[0-9]+(?:\.[0-9]+)?(h|m|s|ms)$", 1)
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    scale = F.when(unit == "h", 3600.0).when(unit == "m", 60.0).when(unit == "s", 1.0).when(unit == "ms", 0.001)
    return F.when(text.rlike(r"^[0-9]+:[0-9]+:[0-9]+(\.[0-9]+)?$"), parse_clock(text)).when(unit != "", number * scale)


def decomposed(text: Column) -> Column:
    """V4: letters without their accents, ligatures and wide forms as plain letters (compatibility decomposition); what else is not ASCII goes.
    Each distinct text of a batch is looked at once, plain ASCII not at all."""

    @F.pandas_udf("string")
    def run(texts):
        import unicodedata

        known = {t: t if t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts.dropna().unique()}
        return texts.map(known).astype(object).where(texts.notna(), None)

    return run(text)


def name_words(text: Column, prefix: str = "") -> Column:
    """the words that tell a name apart: accents, marks and small words dropped."""
    plain = decomposed(F.replace(F.replace(F.replace(F.lower(text), F.lit("æ"), F.lit("ae")), F.lit("&"), F.lit("and")), F.lit("_"), F.lit(" ")))
    plain = F.regexp_replace(plain, "^" + prefix, "") if prefix else plain
    kept = F.split(F.regexp_replace(plain, "[^a-z0-9 ]", ""), " ")
    return F.filter(kept, lambda w: ~w.isin("", "the", "a", "an", "of", "and"))


def folded(text: Column) -> Column:
    """straight apostrophes, single spaces, trimmed, lower case."""
    return F.lower(F.btrim(F.regexp_replace(F.translate(text, "‘’", "''"), r"\s+", " ")))


def word_key(word: Column) -> Column:
    """lower case letters and digits only, number words up to ninety-nine as digits."""
    plain = F.regexp_replace(F.lower(word), "[^a-z0-9]", "")
    return F.coalesce(F.try_element_at(number_map(), plain), plain)


def plain_text(lines: Column) -> Column:
    """array of lines of runs (structs with text) to text."""
    return F.array_join(F.transform(lines, lambda line: F.array_join(F.transform(line, lambda run: run["text"]), "")), "\n")


def segments(text: Column, colour: str = "#ffffff") -> Column:
    """lines of one run each; blank lines dropped."""
    return F.transform(F.filter(F.split(text, "\n"), lambda s: F.btrim(s) != ""), lambda s: F.array(F.struct(s.alias("text"), F.lit(colour).alias("colour"))))


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, where a lambda that names its expression would compute it again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _merged_runs(some: Column) -> Column:
    """Neighbours of one colour as one run: each run of equal colours is cut out whole, so that a line costs what it is long."""
    changes = lambda i: (i == 0) | ~F.coalesce(F.get(some, i)["colour"] == F.get(some, i - 1)["colour"], F.lit(False))
    starts = F.filter(F.transform(some, lambda _, i: i), changes)

    def runs(starts: Column) -> Column:
        part = lambda at, k: F.slice(some, at + 1, F.coalesce(F.get(starts, k + 1), F.size(some)) - at)
        text = lambda at, k: F.regexp_replace(F.array_join(F.transform(part(at, k), lambda r: r["text"]), ""), r"\s+", " ")
        return F.transform(starts, lambda at, k: F.struct(text(at, k).alias("text"), F.get(some, at)["colour"].alias("colour")))

    return _held(starts, runs)


def _stripped_ends(merged: Column) -> Column:
    n = F.size(merged)
    text = lambda r, i: F.when((i == 0) & (i == n - 1), F.btrim(r["text"])).when(i == 0, F.ltrim(r["text"])).when(i == n - 1, F.rtrim(r["text"])).otherwise(r["text"])
    return F.transform(merged, lambda r, i: F.struct(text(r, i).alias("text"), r["colour"].alias("colour")))


def tidy_runs(runs: Column) -> Column:
    """F8: runs (text, colour) of a line with spaces collapsed, neighbours of one colour merged, ends stripped, empty ones dropped."""
    some = F.filter(F.transform(runs, lambda r: F.struct(F.regexp_replace(r["text"], r"\s+", " ").alias("text"), r["colour"].alias("colour"))), lambda r: r["text"] != "")
    return F.filter(_held(_held(some, _merged_runs), _stripped_ends), lambda r: r["text"] != "")


def safe_name(text: Column) -> Column:
    """Characters that paths can't hold become hyphens."""
    return F.regexp_replace(text, r'[/\\:*?"<>|]', "-")


def rendered(template: str, fields: dict[str, Column]) -> Column:
    """{name} replaced by the field (null as empty), written line breaks as such, trimmed."""
    out: Column = F.lit(template.replace("\\n", "\n"))
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.btrim(out, F.lit(" \n\t\r"))


#: Repairs of optical reading in order, as a pattern and what takes its place (None: zeros, see below). A lone bar; words whose
#: capital is a misreading inside a sentence; misread zeros in what looks like a number, then beside the dash of a score; a
#: backslash and a doubled capital after a dash; a quoted Yes.
MISREAD = ["Is", "It", "It's", "Its", "In", "If", "Into"]
NUMBERISH = r"(?<![A-Za-z])[0-9Q@Ø]+(?:[,.][0-9Q@Ø]+)*"
REPAIRS: list[tuple[str, str | None]] = [
    (r"(?<![\p{L}\p{N}_|])\|(?![\p{L}\p{N}_|])", "I"),
    *((rf"(?<=[a-z,] ){w}\b" + ("" if "'" in w else "(?!')"), w.lower()) for w in MISREAD),
    (NUMBERISH, None),
    (r"(?<=[0-9]-)(?:Q@|Q|@|Ø)|(?:Q@|Q|@|Ø)(?=-[0-9])", "0"),
    (r"(?<=-)\\(?=[A-Z])", ""),
    (r"\bWw(?=[a-z])", "W"),
    (r'^[“”"]V(?=es\b)', "-Y"),
]


def _zeros_in_numbers(lines: Column) -> Column:
    """Misread zeros in what looks like a number and has a digit."""

    @F.pandas_udf("string")
    def run(texts):
        import re

        numberish = re.compile(NUMBERISH)
        fix = lambda m: re.sub("[Q@Ø]", "0", m.group()) if any(c.isdigit() for c in m.group()) else m.group()
        return texts.map(lambda t: None if t is None else numberish.sub(fix, t))

    return run(lines)


def ocr_repaired(line: Column) -> Column:
    """what optical reading gets wrong in captions, repaired in order."""
    return reduce(lambda out, rule: _zeros_in_numbers(out) if rule[1] is None else F.regexp_replace(out, *rule), REPAIRS, line)


ALPHABET = "234567abcdefghijklmnopqrstuvwxyz"


def record_key(micros: Column, low_bits: Column) -> Column:
    """13 letters whose order is that of the time, from (microseconds << 10 | 10 bits)."""
    value = F.shiftleft(micros, 10).bitwiseOR(low_bits.bitwiseAND(F.lit(1023).cast("long")))
    digit = lambda i: F.substring(F.lit(ALPHABET), F.expr("1") + (F.call_function("shiftrightunsigned", value, (i * 5).cast("int")).bitwiseAND(F.lit(31).cast("long"))).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(12), F.lit(0), F.lit(-1)), digit), "")
