"""Names and texts of diaries as column functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What parts the words of a name, and what a title shows before a parenthesis.
_GAPS = re.compile(r"[-_\s]+")
_TITLE = re.compile(r"\s*([^(]*?)\s*(?:\(.*)?", re.DOTALL)


def plain_name(c: Column) -> Column:
    """A name in lower case with runs of blanks, - and _ as one _; accents stay (JVM only)."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"[-_\s\x1c-\x1f]+", " ")), " ", "_")


class _Plain(dict):
    """Character -> what is left of it without accents, in compatibility form; filled as characters come up."""

    def __missing__(self, code: int) -> str:
        apart = unicodedata.normalize("NFKD", chr(code))
        self[code] = out = "".join(x for x in apart if not unicodedata.combining(x))
        return out


_plain = _Plain()


def without_accents(name: str) -> str:
    return name.lower().translate(_plain)


def normal_name(name: str) -> str:
    """Words of letters without accents, joined by _."""
    return "_".join(word for word in _GAPS.split(without_accents(name)) if word)


@F.pandas_udf(StringType())
def _normal_names(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for names in parts:
        yield names.map(lambda x: None if x is None else normal_name(x))


def normalize_column(df: DataFrame, source: str, target: str) -> DataFrame:
    """Adds ``target``: ``source`` normalised. ASCII names stay in the JVM; Python gets a null for them."""
    other = F.when(~F.col(source).rlike(r"^[\x00-\x7F]*$"), F.col(source))
    return df.withColumn("_other", _normal_names(other)).withColumn(target, F.coalesce("_other", plain_name(F.col(source)))).drop("_other")


def normal_header(name: str) -> str:
    """A column title: without accents, cut at the first parenthesis, blanks as _."""
    return _TITLE.fullmatch(without_accents(name))[1].replace(" ", "_")


def header(c: Column) -> Column:
    """:func:`normal_header` for titles without accents."""
    return F.replace(F.trim(F.split_part(F.lower(F.trim(c)), F.lit("("), F.lit(1))), F.lit(" "), F.lit("_"))


def item_list(c: Column, sep: str = ";") -> Column:
    """Distinct, sorted, normalised items of a separated list."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), sep), plain_name)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def number(c: Column) -> Column:
    """A number with . or , as decimal mark; null if unreadable or not finite."""
    x = F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def date_shape(pattern: str) -> str:
    """What a date in a pattern of y, M and d looks like, as a regular expression."""
    digits = {"y": lambda n: rf"\d{{{n}}}", "M": lambda n: r"\d{1,2}", "d": lambda n: r"\d{1,2}"}
    return "^" + "".join(digits[m[0]](len(m)) if m[0] in digits else re.escape(m) for m in re.findall(r"y+|M+|d+|[^yMd]", pattern)) + "$"


def parsed_date(c: Column, formats: tuple[str, ...]) -> Column:
    """The date by the first format that it has the shape of; only that one is tried."""
    t, out = F.trim(c), F.lit(None).cast("timestamp")
    for f in reversed(formats):
        out = F.when(t.rlike(date_shape(f)), F.try_to_timestamp(t, F.lit(f))).otherwise(out)
    return out.cast("date")


def parsed_minutes(c: Column) -> Column:
    """Minutes from midnight of 8:00, 08:00:00 or 8:30am; null if unreadable."""
    t = F.lower(F.trim(c))
    hour, minute = F.substring_index(t, ":", 1).try_cast("int"), F.substring(F.split_part(t, F.lit(":"), F.lit(2)), 1, 2).try_cast("int")
    half = F.right(t, F.lit(2))
    twelve = half.isin("am", "pm")
    h = F.when(~twelve, hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    return F.when(t.rlike(r"^\d{1,2}:[0-5]\d(:\d{2})?\s*(am|pm)?$") & (h < 24), h * 60 + minute)


def iso_duration(c: Column) -> Column:
    """PT08H30M00S as 08:30; seconds go."""
    part = lambda unit: F.regexp_extract(c, rf"(\d+){unit}", 1)
    two = lambda x: F.when(x == "", F.lit("00")).otherwise(F.lpad(x, F.greatest(F.length(x), F.lit(2)), F.lit("0")))
    return F.concat(two(part("H")), F.lit(":"), two(F.regexp_extract(c, r"(\d+)M", 1)))


#: Unicode's space separators.
_SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def paragraphs(parts: Column) -> Column:
    """Paragraphs without spaces around, blank ones dropped, joined by a space."""
    # a function of two arguments would get the paragraph's number as its second
    return F.array_join(F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(_SPACES))), lambda x: x != ""), " ")


def repeat_count(c: Column, most: int = 4096) -> Column:
    """A run length, at least 1 and at most ``most``; 1 if unreadable."""
    return F.coalesce(F.least(F.greatest(c.try_cast("int"), F.lit(1)), F.lit(most)), F.lit(1))


#: The looks of a text, without blanks around, by which a cell is typed.
CELL_KINDS = {"date": r"\d{4}-\d{2}-\d{2}", "time": r"\d{1,2}:\d{2}", "float": r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"}


def cell_type(c: Column) -> Column:
    """The value type that a text is written with in a sheet."""
    t = F.trim(F.coalesce(c, F.lit("")))
    out = F.when(t == "", "blank")
    for kind, look in CELL_KINDS.items():
        out = out.when(t.rlike(f"^(?:{look})$"), kind)
    return out.otherwise("string")


def xml_escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def number_text(c: Column) -> Column:
    """2.0 as 2, 2.5 as 2.5."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def shortened(c: Column, by: int) -> Column:
    """A name and what is left of it without up to ``by`` of its characters."""
    out = F.array(c)
    for _ in range(by):
        cuts = F.transform(out, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))))
        out = F.array_distinct(F.concat(out, F.flatten(cuts)))
    return out


def near_names(names: DataFrame, col: str = "item", distance: int = 1) -> DataFrame:
    """(a, b): pairs a < b with the same first letter and an edit distance of at most ``distance``.

    Two such names have a form in common that is left of each without up to ``distance`` characters, so they meet on
    the form's hash: candidates follow the names' lengths and likenesses, not the number of names with a letter.
    """
    n = names.select(F.col(col).alias("n")).where("n <> ''").distinct()
    first = F.substring("n", 1, 1)
    forms = n.select("n", F.explode(F.transform(shortened(F.col("n"), distance), lambda x: F.xxhash64(first, x))).alias("form"))
    # forms are many times the names, which a plan's sizes don't tell: neither side is sent to all, and only near pairs go on
    a, b = forms.withColumnRenamed("n", "a"), forms.withColumnRenamed("n", "b").hint("merge")
    same = F.substring("a", 1, 1) == F.substring("b", 1, 1)
    near = F.levenshtein("a", "b", distance).between(0, distance)
    return a.join(b, "form").where((F.col("a") < F.col("b")) & same & near).select("a", "b").distinct()
