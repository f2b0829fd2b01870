"""Scalar functions as Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that token overlap leaves out.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "for", "from", "how", "in", "is", "it",
    "of", "on", "or", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why", "with",
]
#: Marker words of languages, in the order that decides ties.
LANGUAGE_MARKERS = {
    "en": ["the", "and", "this", "with"],
    "es": ["el", "la", "de", "que"],
    "fr": ["le", "la", "de", "et"],
    "de": ["der", "die", "das", "und"],
    "pt": ["o", "a", "de", "que"],
}
#: Scripts that decide a language by themselves, in the order that decides ties.
SCRIPTS = {"zh": r"[\x{4e00}-\x{9fff}]", "ja": r"[\x{3040}-\x{30ff}]", "ko": r"[\x{ac00}-\x{d7af}]", "ar": r"[\x{0600}-\x{06ff}]", "ru": r"[\x{0400}-\x{04ff}]"}
#: Patterns of injected instructions and of secrets.
INJECTION = {
    "instruction_override": r"(?i)\b(ignore|disregard|forget)\b.{0,40}\b(instruction|prompt|system)\b",
    "role_impersonation": r"(?i)\b(system|developer)\s*(message|prompt)\s*:",
    "secret_exfiltration": r"(?i)\b(reveal|print|expose)\b.{0,40}\b(api key|secret|system prompt)\b",
}
SECRETS = [r"(?i)(api[_ -]?key|token|password)\s*[:=]\s*\S+", r"\bsk-[A-Za-z0-9_-]{12,}\b"]
MAX_CONTENT = 24000
#: HTML entities that are decoded, in this order.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'"}


def trim_all(c: Column) -> Column:
    """All white space, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def round_half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def absolute(c: Column) -> Column:
    return F.abs(c.cast("double"))


def substring(c: Column, start: int, length: int | None = None) -> Column:
    """1-based; starts below 1 count as 1."""
    start = max(1, start)
    return F.substring(c, start, length if length is not None else 2**31 - 1 - start)


def avg_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c.cast("double")), F.lit(0.0))


def current_date_text() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def current_timestamp_text() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def tokens(c: Column) -> Column:
    """Runs of letters, digits, _, ' and -, ASCII lower-cased."""
    return F.regexp_extract_all(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z0-9_'-]+"), F.lit(0))


def cased_tokens(c: Column) -> Column:
    """The same runs, not lower-cased yet: ``lower`` of one after exploding (they are ASCII) is cheaper than of whole texts."""
    return F.regexp_extract_all(c, F.lit("[A-Za-z0-9_'-]+"), F.lit(0))


def _stop() -> Column:
    return F.array(*map(F.lit, STOP_WORDS))


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens, stop words aside, that the text has; 0 if there are none."""
    asked = F.array_except(tokens(query), _stop())
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(text))) / F.size(asked)).otherwise(F.lit(0.0))


def bigrams(c: Column) -> Column:
    """Distinct pairs of adjacent tokens; the last token stands alone."""
    t = tokens(c)
    following = F.slice(t, 2, F.greatest(F.size(t), F.lit(1)))  # not t inside the lambda: it would be evaluated for each token
    return F.array_distinct(F.zip_with(t, following, lambda x, y: F.when(y.isNotNull(), F.concat(x, F.lit("\n"), y)).otherwise(x)))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two columns of distinct bigrams; 0 if one is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(F.lit(0.0))


def content_hash(c: Column) -> Column:
    """SHA-256 of the text with white space normalised."""
    return F.sha2(trim_all(F.regexp_replace(c, r"\s+", " ")), 256)


def _with(value: Column, then) -> Column:
    """``then`` of a value that is evaluated once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _first_most(counts: Column, names: list[str]) -> Column:
    """The first name with the largest count."""
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(counts, F.array_max(counts)).cast("int"))


def detect_language(c: Column) -> Column:
    """By script counts, else by marker words of the first 10,000 characters, else ``und``; ties go to the first listed."""
    letter = r"[a-z\x{e0}-\x{ff}]"
    markers = "|".join(dict.fromkeys(w for m in LANGUAGE_MARKERS.values() for w in m))

    def by_words(sample: Column) -> Column:
        words = F.array_distinct(F.regexp_extract_all(F.lower(sample), F.lit(f"(?<!{letter})(?:{markers})(?!{letter})"), F.lit(0)))
        hits = _with(words, lambda w: F.array(*[F.size(F.array_intersect(w, F.array(*map(F.lit, m)))) for m in LANGUAGE_MARKERS.values()]))
        return _with(hits, lambda h: F.when(F.array_max(h) > 0, _first_most(h, list(LANGUAGE_MARKERS))).otherwise(F.lit("und")))

    def by_scripts(sample: Column) -> Column:
        counts = F.array(*[F.regexp_count(sample, F.lit(p)) for p in SCRIPTS.values()])
        enough = F.greatest(F.lit(3), F.floor(F.length(sample) / 20))
        return _with(counts, lambda n: F.when(F.array_max(n) >= enough, _first_most(n, list(SCRIPTS))))

    def of(sample: Column) -> Column:
        some = sample.rlike("|".join(SCRIPTS.values()))
        return F.coalesce(F.when(some, by_scripts(sample)), by_words(sample))

    return _with(F.substring(c, 1, 10000), of)


def injection_tags(c: Column) -> Column:
    return F.filter(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in INJECTION.items()]), lambda x: x.isNotNull())


def redact(c: Column, limit: int = MAX_CONTENT) -> Column:
    """Secrets replaced, then cut to ``limit`` characters."""
    for p in SECRETS:
        c = F.regexp_replace(c, p, "[REDACTED]")
    return F.substring(c, 1, limit)


def html_text(c: Column) -> Column:
    """Entities decoded, tags dropped, trimmed."""
    for a, b in ENTITIES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return trim_all(F.regexp_replace(c, "<[^>]*>", " "))


def steps(c: Column) -> Column:
    """A statement's steps: lines, sentences, and parts joined by then / after that / finally; of four letters or more."""
    parts = F.split(c, r"(?i)(?:\n+|(?<=[.!?])\s+|\s+(?:then|after that|finally)\s+)")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[ \-\t.]+|[ \-\t.]+$", "")), lambda x: F.length(x) >= 4)


def memory_category(subject: Column, statement: Column, namespace: Column) -> Column:
    text = F.lower(F.concat_ws(" ", subject, statement))
    named = {"preference": "preference", "prospective": "commitment", "episodic": "experience", "negative": "caution", "working": "current_task", "semantic": "fact"}
    out = F.when((namespace == "procedural") | (F.size(steps(statement)) > 1), "procedure")
    for words, name in ((("name", "country", "timezone", "language", "location"), "profile"), (("research", "study", "paper", "source", "hypothesis"), "research"), (("book", "novel", "project", "manuscript", "release"), "project")):
        out = out.when(text.rlike("|".join(words)), name)
    for k, v in named.items():
        out = out.when(namespace == k, v)
    return out.otherwise("general")


def verify_claims(answer: Column, context: Column, citations: Column) -> Column:
    """Sentences of four tokens or more as structs (claim, cited, invalid, overlap, supported): cited, and at least a quarter in the context."""
    claims = F.filter(F.regexp_extract_all(answer, F.lit(r"[^.!?]+[.!?]"), F.lit(0)), lambda s: F.size(tokens(s)) >= 4)

    def one(s):
        marks = F.transform(F.regexp_extract_all(s, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda m: m.cast("long"))
        valid = F.filter(marks, lambda m: F.array_contains(citations, m))
        overlap = token_overlap(F.regexp_replace(s, r"\[([0-9]+)\]", ""), context)
        cited = F.size(valid) > 0
        return F.struct(F.substring(s, 1, 512).alias("claim"), cited.alias("cited"), (F.size(marks) - F.size(valid)).alias("invalid"), overlap.alias("overlap"), (cited & (overlap >= 0.25)).alias("supported"))

    return F.slice(F.transform(claims, one), 1, 32)
