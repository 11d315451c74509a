"""Text as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions import wordlists as W


def norm(c: Column) -> Column:
    """Lower case; everything but a-z and 0-9 becomes single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def norm_unicode(c: Column) -> Column:
    """Lower case; letters of any script, digits and _ stay, the rest becomes single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def norm_apostrophe(c: Column) -> Column:
    """Lower case; hyphens part words, apostrophes stay, the rest becomes single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(c), F.lit("-"), F.lit(" ")), "[^a-z0-9' ]+", " "), " +", " "))


def clean_token(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def tokens(c: Column) -> Column:
    """Words between white space of any script."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def ends_sentence(c: Column) -> Column:
    return c.rlike(r"""[.?!]["')]*\z""")


def token_estimate(c: Column) -> Column:
    """About 1.3 tokens a word, and one."""
    return (F.floor(F.size(tokens(c)) * F.lit(1.3)) + 1).cast("int")


def topic_words(c: Column) -> Column:
    """Words of three letters or more that can tell topics apart."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), F.lit(1)), lambda w: (F.length(w) > 2) & ~w.isin(*W.STOPWORDS))


def clock(seconds: Column) -> Column:
    """mm:ss.ss; minutes are whole, seconds rounded half to even; null stays null."""
    minutes = F.floor(seconds / 60)
    return F.when(seconds.isNotNull(), F.format_string("%02d:%05.2f", minutes, F.bround(seconds - minutes * 60, 2)))


def has_words(text: Column, words: Column) -> Column:
    """Whether a normalised text holds a normalised phrase as whole words."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), words, F.lit(" ")))


def first_phrase(text: Column, phrases) -> Column:
    """The first of the phrases, in their order, that the normalised text holds; else null."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, phrases)), lambda p: has_words(text, p)), F.lit(1))


def volunteers(normed: Column) -> Column:
    return normed.rlike(W.VOLUNTEER)


def negated(normed: Column) -> Column:
    return normed.rlike(W.NEGATED)


def hedged(normed: Column) -> Column:
    return normed.rlike(W.HEDGED)


def settled(quote: Column, decision: Column) -> Column:
    """Stated as decided: not hedged, not asked, and negated only if the decision is."""
    q = norm(quote)
    return (q != "") & ~hedged(q) & ~F.contains(quote, F.lit("?")) & (~negated(q) | negated(norm(decision)))


def same_person(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (b != "") & (norm(a) == norm(b)), F.lit(False))


def without_label(quote: Column, labels: Column) -> Column:
    """The quote without a copied 'Label:' in front, if the label is one of ``labels`` (normalised)."""
    head = F.split_part(quote, F.lit(":"), F.lit(1))
    copied = F.contains(quote, F.lit(":")) & F.coalesce(F.array_contains(labels, norm(head)), F.lit(False))
    return F.when(copied, F.substring(quote, F.length(head) + 2, F.length(quote))).otherwise(quote)


def role_words(role: Column) -> Column:
    return F.filter(F.split(norm(role), " "), lambda w: (w != "") & ~w.isin(*W.ROLE_FILLER))


def clean_role(role: Column) -> Column:
    """Without the filler words in front."""
    words = F.split(norm(role), " ")
    first = F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), F.lit(-1), lambda a, i: F.when((a < 0) & ~F.get(words, i).isin(*W.ROLE_FILLER), i).otherwise(a))
    return F.when(first < 0, F.lit("")).otherwise(F.array_join(F.slice(words, first + 1, F.size(words)), " "))


def role_mentioned(role: Column, text: Column) -> Column:
    """The whole role, or a telling word of it with a role noun at most two words behind."""
    words = F.split(norm(text), " ")
    telling = F.filter(role_words(role), lambda w: ~w.isin(*W.ROLE_NOUNS))
    near = F.exists(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda i: F.array_contains(telling, F.get(words, i)) & (F.coalesce(F.get(words, i + 1).isin(*W.ROLE_NOUNS), F.lit(False)) | F.coalesce(F.get(words, i + 2).isin(*W.ROLE_NOUNS), F.lit(False))),
    )
    return F.coalesce(((role != "") & has_words(norm(text), norm(role))) | near, F.lit(False))


def default_label(speaker: Column) -> Column:
    return F.concat(F.lit("Speaker "), F.ltrim(speaker, F.lit("S")))


def label(speaker: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), default_label(speaker))


def whole_number(c: Column, otherwise: int = -1) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(otherwise))


def person_name(c: Column) -> Column:
    """White space collapsed, punctuation trimmed."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), r"""^[ .,;:!?"']+|[ .,;:!?"']+$""", ""))


def without_speaker_mark(quote: Column) -> Column:
    return F.regexp_replace(F.trim(quote), r"^\s*S\d+\s*:\s*", "")


def unspecified(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == W.UNSPECIFIED, F.lit(True))


def value_in_quote(value: Column, quote: Column) -> Column:
    """The value is given and stands in the quote, within a word too."""
    return (F.trim(value) != "") & ~unspecified(value) & F.contains(norm(quote), norm(value))


def json_object(reply: Column) -> Column:
    """From the first { to the last } of a reply; null if there is none."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def ordered_join(order: str, text: str, sep: str = " ") -> Column:
    """Aggregate: the texts in order, joined; empty ones left out."""
    pairs = F.array_sort(F.collect_list(F.when(F.col(text) != "", F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    return F.array_join(F.transform(pairs, lambda p: p["t"]), sep)
