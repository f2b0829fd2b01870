"""Personal data: pattern spans, and information-theoretic sanitisation of terms that reveal them.  DataFrame functions only.

A protected entity c is a personal value (an e-mail address, IP address, card or phone number), what it belongs to (the
address' domain, the network, the issuer's or area's digits), its kind, or personal data at all.  Over the corpus' different
texts, IC(c) = log2(N / n(c)) measures what naming c tells, and PMI(c, t) = log2(N n(c, t) / (n(c) n(t))) how much of it a
term t tells.  Counts are small where entities are rare, so PMI is discounted by n(c, t) / (n(c, t) + 1) (Pantel and Lin).
In a document that holds c, a term whose discounted PMI reaches IC(c) / alpha discloses c (C-sanitisation, Sanchez and
Batet) and is generalised to a mark, like c itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import join_hot, maybe_in, saved

#: The kinds in their order with their patterns.  Possessive quantifiers and the look-behinds change no
#: match (what they forbid could never be matched) but keep long runs from quadratic time and deep recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
_NEEDS = {"email": "@", "phone": "+", "ip": "."}
_WORD = r"\p{L}{3,}+"
_SPAN = "array<struct<s:int,e:int,v:string>>"
_BROADCAST_TERMS = 200_000
ALPHA = 1.4


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(v, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))
    if kind == "card":
        digits = F.regexp_replace(v, "[ -]", "")
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(v, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _fold(matches: Column, gaps: Column, keep) -> Column:
    """Positions of matches, in code points, from the text between them; those that ``keep`` refuses only move on."""
    steps = F.filter(F.zip_with(matches, gaps, lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("v"))), lambda z: z["v"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc, z):
        s = acc["at"] + z["g"]
        e = s + z["n"]
        return F.struct(e.alias("at"), F.when(keep(z["v"]), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), z["v"].alias("v"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def spans(kind: str, text: Column) -> Column:
    """Leftmost non-overlapping valid spans of a kind: array of (s, e, v), code points, end exclusive."""
    found = _fold(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1), lambda v: _valid(kind, v))
    need = text.contains(_NEEDS[kind]) if kind in _NEEDS else text.rlike(r"[0-9][\x20-]?[0-9]")
    return F.when(need, found).otherwise(F.array().cast(_SPAN))


def _entities(kind: str) -> Column:
    """The entities that a column of spans mentions: values and what they belong to."""

    def levels(x: Column) -> Column:
        v = _value(kind, x["v"])
        wide = {"email": F.concat(F.lit("@"), F.substring_index(v, "@", -1)), "ip": F.concat(F.substring_index(v, ".", 3), F.lit(".*"))}.get(kind, F.concat(F.substring(v, 1, 6), F.lit("*")))
        return F.array(*[F.concat(F.lit(kind + ":"), c) for c in (v, wide)])

    return F.flatten(F.transform(F.col(kind), levels))


def _marks(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("v")))


def _value(kind: str, v: Column) -> Column:
    """What makes two mentions one value."""
    return F.lower(v) if kind == "email" else v if kind == "ip" else F.regexp_replace(v, "[^0-9]", "")


def _listed(kinds, of) -> Column:
    def one(k: str) -> Column:
        return F.transform(of(k), lambda x: F.concat(F.lit(k + ":"), x["s"], F.lit(":"), x["e"]))

    return F.array_join(F.concat(*map(one, kinds)), ",")


def _terms(text: Column) -> Column:
    """Distinct lower-case words of a text outside what the patterns match."""
    bare = text
    for pattern in PATTERNS.values():
        bare = F.regexp_replace(bare, pattern, " ")
    text = F.when(text.rlike("[0-9@]"), bare).otherwise(text)  # no pattern matches without
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower))


def disclosing_terms(rows: DataFrame, own: DataFrame, entities: DataFrame, alpha: float) -> DataFrame:
    """(key, terms): the terms to remove from each text that holds an entity they disclose.

    ``rows``: text, a row for each different text.  ``own``: key, text of those that hold entities.  ``entities``: key, c.
    Counts are taken over all rows.  A pair of fewer texts than 1 / (alpha - 1) cannot pass, nor can one whose largest
    possible count is too small, so such entities, terms and pairs are left out early; this changes no result.
    """
    least = math.ceil(1 / (alpha - 1) - 1e-9)
    n_c = saved(entities.groupBy(F.col("c").alias("_c")).agg(F.count("*").alias("n_c")).where(F.col("n_c") >= least), "counts")
    held = saved(join_hot(entities, "c", n_c, "_c", "n_c").select("key", "c", "n_c"), "entities")
    words = saved(own.select("key", F.explode(_terms(F.col("text"))).alias("t")), "words")
    seen = saved(words.groupBy(F.col("t").alias("asked")).agg(F.count("*").alias("n_own")).where(F.col("n_own") >= least), "asked")
    every = rows.select(F.explode(_terms(F.col("text"))).alias("t"))
    if seen.count() <= _BROADCAST_TERMS:  # checked; beyond it all words are counted, combined before the shuffle
        every = every.join(F.broadcast(seen), F.col("t") == F.col("asked"), "left_semi")
    n = float(rows.count())

    def discloses(n_ct: Column, n_c: Column) -> Column:
        tells = F.log2(F.lit(n) * n_ct / (n_c * F.col("n_t"))) * n_ct / (n_ct + 1)
        return tells >= F.log2(F.lit(n) / n_c) / F.lit(float(alpha)) - 1e-9

    # of all entities, one of as many texts as the term's own would be disclosed most easily: tells - IC / alpha grows with
    # n(c) = n(c, t) up to there and, as own >= 1 / (alpha - 1), falls with n(c) beyond
    n_t = every.groupBy("t").agg(F.count("*").alias("n_t")).join(seen, F.col("t") == F.col("asked")).select("asked", "n_own", "n_t")
    n_t = saved(n_t.where(discloses(F.col("n_own"), F.col("n_own"))), "terms")
    if n_t.count() <= _BROADCAST_TERMS:  # checked too
        counted = words.join(F.broadcast(n_t), F.col("t") == F.col("asked"))
    else:
        counted = join_hot(words, "t", n_t, "asked", "n_own")
    counted = counted.select(F.col("key").alias("k"), "t", "n_own", "n_t")
    pairs = counted.join(held, (F.col("k") == F.col("key")) & discloses(F.least("n_c", "n_own"), F.col("n_c")))
    pairs = saved(pairs.select("key", "c", "n_c", "t", "n_t", F.concat_ws(" ", "t", "c").alias("pair")), "pairs")
    flagged = pairs.groupBy(F.col("pair").alias("_pair")).agg(F.count("*").alias("n_ct"), F.first("n_c").alias("n_c"), F.first("n_t").alias("n_t"))
    flagged = saved(flagged.where((F.col("n_ct") >= least) & discloses(F.col("n_ct"), F.col("n_c"))).select("_pair", "n_ct"), "flagged")
    hit = join_hot(pairs.select("key", "t", "pair"), "pair", flagged, "_pair", "n_ct")
    return hit.groupBy("key").agg(F.array_sort(F.collect_set("t")).alias("terms"))


def _all_spans(docs: DataFrame, alpha: float) -> tuple[DataFrame, DataFrame]:
    """Rows (row columns in ``row``, raw, text, key) and their spans (doc_id, key, a column for each kind), saved."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("raw"), text.alias("text"))
    rows = rows.withColumn("key", F.sha2(F.col("text"), 256))
    shown = F.when(sum(F.size(k) for k in PATTERNS) > 0, F.col("text")).alias("own")  # few texts, read instead of all below
    found = rows.select(F.col("row.doc_id").alias("doc_id"), "key", "text", *[spans(k, F.col("text")).alias(k) for k in PATTERNS])
    found = saved(found.select("doc_id", "key", *PATTERNS, shown), "spans")
    private = found.where("own is not null")
    kinds = F.filter(F.array(F.lit("any"), *[F.when(F.size(k) > 0, F.lit(k)) for k in PATTERNS]), lambda k: k.isNotNull())
    values = F.array_distinct(F.concat(*map(_entities, PATTERNS), kinds))
    copies = saved(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("many")), "copies")

    def different(df: DataFrame) -> DataFrame:
        """A row for each key; those without copies stay where they are."""
        split = maybe_in(df, "key", copies, "many")
        once = split.where("not _maybe").select(df.columns)
        first = [F.first(c).alias(c) for c in df.columns if c != "key"]
        return once.unionByName(saved(split.where("_maybe").groupBy("key").agg(*first).select(df.columns), "different"))

    own = different(private.select("key", F.col("own").alias("text"), values.alias("cs")))
    entities = own.select("key", F.explode("cs").alias("c"))
    texts = different(rows.select("key", "text"))
    terms = saved(disclosing_terms(texts, own.select("key", "text"), entities, alpha), "terms")
    gone = terms.select(F.col("key").alias("k"), "terms")
    hit = own.select("key", "text").join(gone, F.col("key") == F.col("k"))
    placed = _fold(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), F.split("text", _WORD, -1), lambda v: F.array_contains(F.col("terms"), F.lower(v)))
    term_spans = saved(hit.select(F.col("key").alias("k"), placed.alias("term")), "termspans")
    out = private.join(term_spans, F.col("key") == F.col("k"), "left").drop("k", "own")  # other texts have no terms
    out = out.unionByName(found.where("own is null").drop("own").withColumn("term", F.lit(None).cast(_SPAN)))
    base = F.concat(*[F.col(k) for k in PATTERNS])
    clear = F.filter(F.coalesce("term", F.array().cast(_SPAN)), lambda t: ~F.exists(base, lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    return rows, out.withColumn("term", clear)


def pii_spans(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Finds personal data in whole texts: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    ``spans`` lists kind:start:end by kind (email, ip, card, phone, term) and start, comma-joined; base_sha256 is the
    SHA-256 of the same list without terms.  ``alpha`` (above 1) is how much of an entity's information a term may tell: the
    larger it is the more terms go.  A null text counts as empty; rows map one to one, repeated rows stay and
    count once in the corpus statistics (these are over different texts); ties and null ids need no rule; an empty table
    gives no rows; other columns are ignored.
    """
    _, out = _all_spans(docs.select("doc_id", "text"), alpha)
    return out.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(_listed(PATTERNS, F.col), 256).alias("base_sha256"),
        _listed(KINDS, F.col).alias("spans"),
    )


def pii_clean(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``docs`` with every span of ``pii_spans`` in text replaced by its kind in brackets.

    Overlapping spans become one, under the kind that starts first; a null text stays null; all columns and rows stay.
    """
    rows, out = _all_spans(docs, alpha)
    marks = F.array_sort(F.concat(*map(_marks, KINDS)))
    marked = saved(out.select(F.col("key").alias("k"), marks.alias("marks")).where("size(marks) > 0").groupBy("k").agg(F.first("marks").alias("marks")), "marks")
    split = maybe_in(rows, "key", marked, "k")
    joined = split.where("_maybe").join(marked, F.col("key") == F.col("k"), "left").drop("_maybe", "k")
    joined = joined.unionByName(split.where("not _maybe").drop("_maybe").withColumn("marks", F.lit(None).cast(joined.schema["marks"].dataType)))

    def cut(acc, m):
        fresh = m["s"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], m["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.col("raw").substr(acc["at"] + 1, m["s"] - acc["at"]), m["v"])).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("marks", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda acc: F.concat(acc["out"], F.col("raw").substr(acc["at"] + 1, F.length("raw"))))
    text = F.when(F.col("marks").isNotNull() & F.col("raw").isNotNull(), clean).otherwise(F.col("raw"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
