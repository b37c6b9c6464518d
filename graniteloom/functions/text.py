"""Text as column expressions: tokens, normal forms, shingles, sentences, masks. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms that an index leaves out.
ENGLISH_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with", "this",
    "but", "they", "have", "had", "what", "when", "where", "who", "which", "why", "how",
)
KOREAN_STOPWORDS = ("은", "는", "이", "가", "을", "를", "에", "와", "과", "도", "만", "의", "로", "으로", "에서", "부터", "까지", "에게", "한테", "께", "이다", "있다", "없다", "하다", "되다", "그", "저", "것")

# What an index term is, where sentences end, titles whose full stop ends none, values and labels of masked questions.
TERMS = "[가-힣]+|[a-z]+|[0-9]+"
TERMS_ANY_CASE = "[가-힣]+|[A-Za-z]+|[0-9]+"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z가-힣])"
CLAIM_END = r"[.!?](?:\s+(?=[A-Z가-힣])|$)"
TITLES = r"\b(Dr|Mr|Mrs|Ms|Prof)\."
MASKED = (r"(?U)\b\d+(\.\d+)?\b", r"(?U)\b\d{4}-\d{2}-\d{2}\b", "'[^']*'", '"[^"]*"')
ANSWER_LABELS = r"(?i)^(Masked Question:|Answer:|Output:)\s*"

_EMPTY = "array<string>"


def tokens(text: Column, lowercase: bool = True, stopwords: bool = True, shortest: int = 2, longest: int = 50) -> Column:
    """Index terms: runs of Hangul, of ASCII letters, of digits, between two lengths and no stopword. Null gives an empty array."""
    body = F.lower(text) if lowercase else text
    found = F.regexp_extract_all(body, F.lit(TERMS if lowercase else TERMS_ANY_CASE), F.lit(0))
    stop = [*ENGLISH_STOPWORDS, *KOREAN_STOPWORDS]
    keep = F.filter(found, lambda t: F.length(t).between(shortest, longest) & (~F.lower(t).isin(stop) if stopwords else F.lit(True)))
    return F.coalesce(keep, F.array().cast(_EMPTY))


def unique_terms(text: Column, **how) -> Column:
    return F.array_distinct(tokens(text, **how))


def words(text: Column) -> Column:
    """Runs of non-space characters, the default measure of size. Null and blank give an empty array."""
    return F.coalesce(F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.array().cast(_EMPTY))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def normalize(text: Column, punctuation: bool = True, separators: bool = True) -> Column:
    """Lower case, separators and punctuation to spaces, spaces collapsed and trimmed: ``L.A.`` becomes ``l a``."""
    c = F.lower(text)
    if separators:
        c = F.translate(c, "_-", "  ")
    if punctuation:
        c = F.regexp_replace(c, r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def shingles(text: Column, k: int = 3) -> Column:
    """The distinct k-character pieces of a text; a shorter text is its own piece, an empty one has none."""
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(k)))
    return F.when(n == 0, F.array().cast(_EMPTY)).when(n < k, F.array(text)).otherwise(F.array_distinct(cut))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """Trimmed, non-blank parts between separators (a literal string)."""
    parts = F.transform(F.split(text, "\\Q" + separator + "\\E", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def sentences(text: Column) -> Column:
    """Parts after ``.``, ``!`` or ``?`` and white space in front of a capital or a Hangul syllable."""
    parts = F.transform(F.split(text, SENTENCE_END), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def claim_sentences(text: Column, shortest: int = 11) -> Column:
    """Sentences as a fact check takes them: titles keep their full stop, terminators go, and so do fragments of 10 characters or fewer."""
    safe = F.regexp_replace(text, TITLES, "$1\u0001")
    parts = F.transform(F.split(safe, CLAIM_END, -1), lambda s: F.regexp_replace(F.translate(s, "\u0001", "."), r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.length(s) >= shortest)


def mask_values(question: Column) -> Column:
    """Numbers, then ISO dates, then quoted strings become [VALUE]; a date's numbers are masked first, so it becomes three."""
    c = question
    for p in MASKED:
        c = F.regexp_replace(c, p, "[VALUE]")
    return c


def longest_line(text: Column) -> Column:
    """A model's answer without its label and fences: the longest line, the first of several; empty if none."""
    c = F.trim(F.replace(F.regexp_replace(text, ANSWER_LABELS, ""), F.lit("```"), F.lit("")))
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    ranked = F.transform(lines, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("o"), x.alias("line")))
    return F.coalesce(F.array_max(ranked)["line"], F.lit(""))


def first_line_variant(text: Column) -> Column:
    """A rewritten query without numbering, label or quotes: its first line."""
    c = F.regexp_replace(F.trim(text), r"(?i)^\s*(?:\d+[.)]\s*|[-*•]\s*|(?:query|variant|question|질문)\s*\d*\s*[:：]\s*)", "")
    c = F.element_at(F.split(F.trim(c), "\n"), 1)
    return F.trim(F.regexp_replace(F.trim(c), "^[\"'“”]+|[\"'“”]+$", ""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, where a lambda would compute it anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(scores: Column) -> Column:
    """Of an array of doubles, shifted by its maximum."""
    e = once(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return once(e, lambda v: once(F.aggregate(v, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(v, lambda x: x / total)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """An array scaled to length 1; null for the zero vector."""
    return once(norm(a), lambda n: F.transform(a, lambda x: F.try_divide(x.cast("double"), n)))


def cosine(a: Column, b: Column, digits: int = 6) -> Column:
    """Rounded cosine; null where either vector is zero."""
    return F.round(F.try_divide(dot(a, b), norm(a) * norm(b)), digits)
