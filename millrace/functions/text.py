"""Text cleaning as Column expressions: no Python on executors.

Patterns carry ``(?U)`` where the original classes are Unicode ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import constants as K

WHITE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Without leading and trailing white space, Unicode's included."""
    return F.regexp_replace(c, rf"(?U)^{WHITE}+|{WHITE}+$", "")


def is_present(c: Column) -> Column:
    return c.isNotNull() & (strip(c) != "")


def strip_tags(c: Column) -> Column:
    """Tags go; what stands inside script and style stays, entities stay encoded."""
    return F.regexp_replace(c, K.TAG, "")


def squeeze(c: Column) -> Column:
    """Runs of spaces and tabs to one space, three or more line ends to two, ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){K.URL}", "")


def mask_personal(c: Column) -> Column:
    """Phone, then identity card, then e-mail, then bank card: the order is part of the result."""
    for pattern, mask in ((K.PHONE, K.PHONE_MASK), (K.ID_CARD, K.ID_MASK), (K.EMAIL, K.EMAIL_MASK), (K.BANK_CARD, K.CARD_MASK)):
        c = F.regexp_replace(c, rf"(?U){pattern}" if pattern != K.EMAIL else pattern, mask)
    return c


def ad_hits(c: Column) -> Column:
    return F.regexp_count(c, F.lit("(?iu)" + "|".join(K.AD_PHRASES)))


def is_ad(c: Column, threshold: int = K.AD_HITS) -> Column:
    return ad_hits(c) >= threshold


def truncate(c: Column, most: int = K.MAX_TEXT) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(K.TRUNCATED))).otherwise(c)


def clean_text(c: Column, least: int = K.MIN_TEXT, most: int = K.MAX_TEXT, ads: bool = True, mask: bool = True) -> Column:
    """Tags, URLs, white space, advertisement, length gate, truncation, masks, in this order; null for a rejected text."""
    x = squeeze(remove_urls(strip_tags(c)))
    fine = is_present(c) & (F.length(x) >= least)
    if ads:
        fine &= ~is_ad(x)
    out = truncate(x, most)
    return F.when(fine, mask_personal(out) if mask else out)


def flat_text(c: Column) -> Column:
    """The news form: tags go and every run of white space, line ends too, is one space; null is empty."""
    return F.coalesce(strip(F.regexp_replace(strip_tags(c), r"(?U)\s+", " ")), F.lit(""))


def news_id(title: Column, date: Column) -> Column:
    return F.md5(F.concat(strip(title), F.lit("_"), strip(F.coalesce(date, F.lit("")))))


def content_hash(c: Column) -> Column:
    return F.md5(strip(c))


def cache_key(task: Column, content: Column) -> Column:
    return F.md5(F.concat(task, F.lit("_"), content))


def distinct_characters(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(F.size(F.array_distinct(F.split(c, ""))))


def character_ngrams(c: Column, n: int = K.NGRAM) -> Column:
    """The set of character n-grams of the stripped text; a shorter text is its own only gram."""
    t = strip(c)
    letters = F.split(t, "")
    size = F.length(t)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(letters, i, n), ""))
    return F.when(size < n, F.array(t)).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - common
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / whole)


def zero_padded(c: Column, width: int = 6) -> Column:
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def quote_id(code: Column) -> Column:
    return F.concat(F.when(code.startswith("6") | code.startswith("9"), F.lit("1.")).otherwise(F.lit("0.")), code)


def exchange_code(code: Column) -> Column:
    return F.concat(F.when(code.startswith("6"), F.lit("sh")).otherwise(F.lit("sz")), code)


def filled(template: str, columns: list[str]) -> Column:
    """The template with {name} replaced by columns; null if one of those it names is null or missing."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.col(name).cast("string") if name in columns else F.lit(None).cast("string")]
    return F.concat(*parts, F.lit(rest))
