"""Text functions on columns. All but `decompose` stay in the JVM."""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What applicants write for no declaration, and what counts as true or false.
SENTINELS = ("not stated on application", "not stated", "n/a")
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "1", "y"), ("false", "no", "0", "n")
NUMBER = r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"
PUNCTUATION = r"[\p{P}$+<=>^`|~]"
#: What a secret looks like; where a pattern has a group, that much of it stays.
SECRETS = (r"sk-[A-Za-z0-9_\-]{8,}", r"""(?i)(api[_-]?key["'=:\s]+)[^"'\s,}]+""", r"""(?i)(authorization["'=:\s]+bearer\s+)[^"'\s,}]+""")
REDACTED = "[REDACTED]"
#: Commodity of a class text, by words; the first that it holds counts.
CLASS_WORDS = (
    (r"\b(MALT|BEER|ALE|LAGER|PORTER|STOUT|IPA)\b", "malt"),
    (r"\b(WINE|SAKE|MEAD|CHAMPAGNE|SHERRY|PORT)\b", "wine"),
    (r"\b(VODKA|WHISKEY|WHISKY|BOURBON|RUM|GIN|TEQUILA|CURACAO|COCKTAILS?|LIQUEURS?|CORDIALS?|BRANDY|DISTILLED|SPIRITS?)\b|PROPRIETAR", "spirits"),
)
#: Millilitres of a unit, and its system.
FLUID_OUNCE = 29.5735295625
UNITS = {"ml": (1.0, "metric"), "milliliter": (1.0, "metric"), "millilitre": (1.0, "metric"), "cl": (10.0, "metric"), "centiliter": (10.0, "metric"), "l": (1000.0, "metric"), "liter": (1000.0, "metric"), "litre": (1000.0, "metric"),
         **{name: (n * FLUID_OUNCE, "us") for n, names in ((1, ("fl oz", "floz", "fluid ounce", "oz", "ounce")), (16, ("pint", "pt")), (32, ("quart", "qt")), (128, ("gallon", "gal"))) for name in names}}


def strip(c: Column) -> Column:
    """Removes all white space at both ends (trim removes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def presence(c: Column) -> Column:
    """Blank is null."""
    return F.nullif(strip(c), F.lit(""))


def not_stated(c: Column) -> Column:
    """True for a sentinel of no declaration; false for null and blank."""
    return F.coalesce(F.lower(strip(c)).isin(*SENTINELS), F.lit(False))


def _fold(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), PUNCTUATION, " "), r"\s+", " "))


@F.pandas_udf(StringType())
def decompose(s: pd.Series) -> pd.Series:
    """NFKD without combining marks; the one text step that Spark lacks."""
    return s.map(lambda t: None if t is None else t if t.isascii() else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))


@functools.cache
def _plain_letters() -> tuple[str, str, str]:
    """By the rule of compatibility decomposition without combining marks: characters that become one other, what they become, and a JSON map of those that become several."""
    one, several = {}, {}
    for k in [*range(0xA0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2190), *range(0x2460, 0x2500), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        x = "".join(c for c in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(c))
        if x and x != chr(k):
            (one if len(x) == 1 else several)[chr(k)] = x
    return "".join(one), "".join(one.values()), json.dumps(several)


def unaccent(c: Column) -> Column:
    """Compatibility forms and letters with marks as plain ones (Latin, Greek, Cyrillic, signs and wide forms); other scripts stay as they are. No Python."""
    of, to, several = _plain_letters()
    table = F.from_json(F.lit(several), "map<string,string>")
    spelled = F.array_join(F.transform(F.split(F.translate(c, of, to), ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(spelled, r"\p{Mn}+", "")).otherwise(c)


def normalize(c: Column) -> Column:
    """Decomposed, without marks, lower case, punctuation to spaces, white space folded."""
    return _fold(unaccent(c))


def normalized(text: str) -> str:
    """normalize of a constant."""
    plain = "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x)).lower()
    return " ".join("".join(" " if unicodedata.category(x).startswith("P") or x in "$+<=>^`|~" else x for x in plain).split())


def normalize_ascii(c: Column) -> Column:
    """normalize for columns known to be ASCII, without Python."""
    return _fold(c)


def equivalent(a: Column, b: Column, norm=normalize) -> Column:
    """Equal when normalised and written without spaces; blank never equals anything."""
    x, y = F.replace(norm(a), F.lit(" ")), F.replace(norm(b), F.lit(" "))
    return F.coalesce((x == y) & (x != ""), F.lit(False))


def equivalent_not_identical(a: Column, b: Column, norm=normalize) -> Column:
    return equivalent(a, b, norm) & (a != b)


def near_equivalent(a: Column, b: Column, norm=normalize) -> Column:
    """As many tokens, six letters or more each side, and at most max(1, ceil(0.12 * letters)) edits."""
    x, y = norm(a), norm(b)
    p, q = F.replace(x, F.lit(" ")), F.replace(y, F.lit(" "))
    most = F.greatest(F.lit(1), F.ceil(F.length(p) * F.lit(0.12)))
    close = F.abs(F.length(p) - F.length(q)) <= most
    same = F.size(F.split(x, " ")) == F.size(F.split(y, " "))
    return F.coalesce(same & (F.length(p) >= 6) & (F.length(q) >= 6) & F.when(close, F.levenshtein(p, q) <= most).otherwise(False), F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def safe_utf8(c: Column, instead: str = " ") -> Column:
    """A binary column as text; bytes that are no UTF-8 become `instead`."""
    return F.replace(F.decode(c, "UTF-8"), F.lit("�"), F.lit(instead))


def match_norm(c: Column) -> Column:
    """Upper case letters, digits and % alone, parted by single spaces."""
    return F.trim(F.regexp_replace(F.upper(c), r"[^A-Z0-9%]+", " "))


def token_bounded(text: Column, name: Column) -> Column:
    """name stands in text between token borders."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), name, F.lit(" "))) & (name != "")


token_run = token_bounded


def fold_whisky(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\b(whisk)e?y\b", "$1y")


def join_hyphens(c: Column) -> Column:
    """A hyphen at a line's end is a break inside a word."""
    return F.regexp_replace(c, r"-\s+", "")


def repair_decimal(c: Column) -> Column:
    """A decimal point that reading lost before a unit: 15 5 GALLONS is 15.5 GALLONS."""
    units = "|".join(name.replace(" ", r"[.\s]*") for name in UNITS)
    return F.regexp_replace(c, rf"(?i)\b(\d\d?\d?)\s+(\d)(?=\s+(?:{units})s?\b)", "$1.$2")


def collapse_spaced_words(c: Column) -> Column:
    """Words written letter by letter: M A D E is MADE."""
    return F.regexp_replace(c, r"(?<=\b\p{L}) (?=\p{L}\b)", "")


def redact(c: Column, limit: int | None = 500) -> Column:
    """Secrets become REDACTED behind what names them, in JSON too; the text is cut at limit characters (None: whole, for documents)."""
    for pattern in SECRETS:
        c = F.regexp_replace(c, pattern, ("$1" if "(" in pattern else "") + REDACTED)
    return c if limit is None else F.substring(c, 1, limit)


def first_rule(c: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The value of the first rule (pattern, value) whose pattern is found."""
    out = None
    for pattern, value in rules:
        out = F.when(c.rlike(pattern), value) if out is None else out.when(c.rlike(pattern), value)
    return out.otherwise(F.lit(otherwise).cast("string"))


def commodity_of(c: Column) -> Column:
    """malt, wine or spirits of a class text, by the first of CLASS_WORDS that it holds; null if none."""
    return first_rule(F.upper(c), CLASS_WORDS)


def search_terms(c: Column) -> Column:
    """Spellings to look a value up by: as written, lower, upper and without white space."""
    return F.array_distinct(F.filter(F.array(c, F.lower(c), F.upper(c), F.regexp_replace(c, r"\s+", "")), lambda x: x.isNotNull() & (x != "")))


#: Ways in which a percentage of alcohol is written behind its number.
ABV_SUFFIXES = ("%", "% ABV", "% ALC/VOL", "% ALC. BY VOL.", "% BY VOL", "% ALCOHOL BY VOLUME")


def abv_terms(percent: Column) -> Column:
    """Spellings of a percentage of alcohol: its number without needless zeros before each suffix; empty for null."""
    n = trim_decimal(percent)
    return F.coalesce(F.when(n.isNotNull(), F.transform(F.array(*map(F.lit, ABV_SUFFIXES)), lambda x: F.concat(n, x))), F.array().cast("array<string>"))


def tri_bool(c: Column) -> Column:
    """Null when blank or unknown."""
    x = F.lower(strip(c))
    return F.when(x.isin(*TRUE_WORDS), True).when(x.isin(*FALSE_WORDS), False)


def trim_decimal(c: Column) -> Column:
    """40.00 -> 40, 12.50 -> 12.5"""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def fmt_pct(c: Column) -> Column:
    return F.concat(trim_decimal(F.round(c, 2)), F.lit("%"))


def fmt_ml(c: Column) -> Column:
    return F.concat(trim_decimal(F.round(c, 1)), F.lit(" mL"))


def fmt_secs(ms: Column) -> Column:
    return F.concat(F.format_string("%.1f", ms / 1000), F.lit(" s"))


def field_label(c: Column) -> Column:
    """brand_name -> Brand name"""
    x = F.replace(c, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2**31 - 1))


def elapsed_ms(a: Column, b: Column) -> Column:
    return F.round((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1000).cast("long")


def sum_present(m: Column, keys: Sequence[str]) -> Column:
    """Sum of the map's values under keys; null if it has none of them."""
    have = F.filter(F.array(*[m[k] for k in keys]), lambda x: x.isNotNull())
    return F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda s, x: s + x))


def decision_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "MMMM d, yyyy"), F.lit("pending"))


def fingerprint(*checksums: Column) -> Column:
    return F.concat_ws("+", *checksums)


def content_type(filename: Column) -> Column:
    """By extension; null when unknown. (A fixed table.)"""
    kinds = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "pdf": "application/pdf", "tif": "image/tiff", "tiff": "image/tiff"}
    extension = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), extension)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)
