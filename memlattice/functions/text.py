"""Scalar text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words that queries and claims drop.
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should", "may", "might", "must", "can", "could",
    "i", "me", "my", "we", "our", "you", "your", "he", "she", "it", "its", "they", "them", "their", "this", "that", "these", "those", "what", "which", "who", "whom", "how", "when", "where", "why",
    "and", "or", "but", "if", "then", "so", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "into", "about", "between", "through", "after", "before", "during",
    "up", "down", "out", "off", "over", "under", "again", "further", "also", "very", "too", "now", "here", "there",
]
# Heuristic sentiment lexicons.
POSITIVE = ["good", "great", "excellent", "positive", "fortunate", "correct", "superior", "happy", "love", "like", "awesome", "amazing", "win", "success", "benefit", "best"]
NEGATIVE = ["bad", "terrible", "poor", "negative", "unfortunate", "wrong", "inferior", "sad", "hate", "dislike", "awful", "horrible", "lose", "failure", "risk", "worst"]


def tokens(text: Column) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_distinct(words(text))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def clean_tokens(text: Column) -> Column:
    """Words without possessives, then without punctuation."""
    bare = F.transform(words(text), lambda x: F.regexp_replace(F.regexp_replace(x, r"'s$", ""), r"[^0-9a-z_]", ""))
    return F.array_distinct(F.filter(bare, lambda x: x != ""))


def query_tokens(text: Column) -> Column:
    return F.array_except(clean_tokens(text), F.array(*[F.lit(x) for x in STOP_WORDS]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def positional_similarity(a: Column, b: Column) -> Column:
    """1 - (length difference + positional mismatches) / longer length: no edit distance."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    wrong = F.aggregate(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), F.lit(0), lambda n, i: n + F.when((i <= short) & (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))), 1).otherwise(0))
    return F.when(long > 0, 1 - (long - short + wrong) / long).otherwise(1.0)


def length_ratio(a: Column, b: Column) -> Column:
    long = F.greatest(F.length(a), F.length(b))
    return F.when(long > 0, 1 - F.abs(F.length(a) - F.length(b)) / long).otherwise(1.0)


def decompose(text: Column, most: int = 4) -> Column:
    """The query itself, then its parts between and, or, commas and semicolons with 3 characters or more."""
    parts = F.filter(F.transform(F.split(text, r"(?i)\s+and\s+|\s+or\s+|[,;]"), lambda x: F.trim(x)), lambda x: F.length(x) >= 3)
    return F.slice(F.array_distinct(F.concat(F.array(F.trim(text)), parts)), 1, most)


def wikilinks(text: Column) -> Column:
    """Targets of [[Target]] and [[Target|shown]]."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), 1), lambda x: F.trim(F.split_part(x, F.lit("|"), F.lit(1)))))


def concepts(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\(\(([^)]+)\)\)"), 1))


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"#([A-Za-z0-9_]+)"), 1))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", "")), r"\s+", "_")


def predicate_key(text: Column) -> Column:
    """lower_snake form of a relation's label."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def relation_type(text: Column) -> Column:
    """Upper case, runs of other characters to one underscore, 50 characters, REL_ before a non-letter, UNKNOWN if empty."""
    t = F.substring(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]+", "_"), "^_+|_+$", ""), 1, 50)
    return F.when(t == "", "UNKNOWN").when(~t.rlike("^[A-Z]"), F.concat(F.lit("REL_"), t)).otherwise(t)


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentiment(text: Column) -> Column:
    """(positive - negative) / (positive + negative) words without the marks at their ends, 0 if none."""
    w = F.transform(words(text), lambda x: F.btrim(x, F.lit(".,!?;:'()[]{}-")))
    n = lambda lexicon: F.size(F.filter(w, lambda x: x.isin(lexicon)))
    pos, neg = n(POSITIVE), n(NEGATIVE)
    return F.when(pos + neg > 0, (pos - neg) / (pos + neg)).otherwise(0.0)


def clean_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z]+"), lambda x: x != "")


def first_sentence(text: Column, most: int = 100) -> Column:
    """The text up to its first sentence mark, or its first `most` characters where there is none."""
    found = F.regexp_extract(text, r"^([^.!?]*[.!?])", 1)
    return F.when(found != "", F.trim(found)).otherwise(F.substring(text, 1, most))


def character_chunks(text: Column, size: int, lap: int) -> Column:
    """Stretches of `size` characters that start size - lap apart; a lap of `size` or more is an error."""
    if lap >= size:
        raise ValueError("the overlap must be smaller than the chunk")
    step = size - lap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - lap) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * step + 1, F.lit(size)))


def urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"https?://[^\s\"'<>)]+"), 0))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def claim_support(claim: Column, evidence: Column) -> Column:
    """Share of the claim's words (over two characters, no stop words) that the evidence holds as substrings."""
    key = F.filter(query_tokens(claim), lambda x: F.length(x) > 2)
    hit = F.size(F.filter(key, lambda x: F.lower(evidence).contains(x)))
    return F.when(F.size(key) > 0, hit / F.size(key)).otherwise(0.0)


def ngram_matches(text: Column, dictionary: list[str], most: int = 4) -> Column:
    """Dictionary phrases of up to `most` words that the text holds as whole words, longest first."""
    padded = F.concat(F.lit(" "), F.array_join(clean_words(text), " "), F.lit(" "))
    names = sorted((x for x in dictionary if len(x.split()) <= most), key=lambda x: (-len(x.split()), x))
    return F.filter(F.array(*[F.lit(x) for x in names]), lambda x: padded.contains(F.concat(F.lit(" "), x, F.lit(" "))))
