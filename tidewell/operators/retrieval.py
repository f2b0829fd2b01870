"""Retrieval over tables of chunks and queries: BM25, rank fusion, planning, rewriting, reranking, graph expansion, evaluation."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalar import bigrams, cased_tokens, content_hash, set_similarity, token_overlap, tokens

K1, B = 1.2, 0.75
RRF = 60
#: Abbreviations and their expansions, in order.
EXPANSIONS = {"SLA": "service level agreement", "SSO": "single sign-on", "RBAC": "role based access control", "RAG": "retrieval augmented generation"}
IDENTIFIER = r"(?i)\b[A-Z]{2,}[-_][A-Z0-9_-]+\b"
RELATIONAL = r"\b(related|relationship|before|after|parent|child|section|root|deep|depends|follow)\b"
CONCEPTUAL = r"\b(why|how|explain|meaning|concept|similar)\b"
PRONOUN = r"\b(it|that|they|this|those|its)\b"
#: Weights of graph edges, over 255.
W_SECTION, W_CHUNK, W_SIBLING = 230, 217, 179


def postings(chunks: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(term, id, tf) and (id, len): term counts are combined before the shuffle."""
    words = chunks.select(F.col(id), cased_tokens(F.col(text)).alias("_t"))
    lengths = words.select(id, F.size("_t").alias("len"))
    counts = words.select(id, F.explode("_t").alias("_w")).select(id, F.lower("_w").alias("term")).groupBy("term", id).agg(F.count("*").alias("tf"))
    return counts, lengths


#: Queries' terms in all up to which each task holds them; with more, postings are joined.
MOST_ASKED = 250_000
_TOKEN = re.compile("[A-Za-z0-9_'-]+")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


def _matches(texts, terms: dict[str, int]):
    """For the texts of an Arrow array: numbers of tokens, and arrays (place, term, tf) of the terms that they hold; a null has no length."""
    import numpy as np

    numbers, lengths, rows = {}, [], []  # tokens as written -> term, so each is lower-cased once
    for place, text in enumerate(texts):
        found = _TOKEN.findall(text.as_py()) if text.is_valid else []
        lengths.append(len(found))
        seen: dict[int, int] = {}
        for word, n in Counter(found).items():
            t = numbers.get(word)
            if t is None:
                t = numbers[word] = terms.get(word.lower(), -1)
            if t >= 0:
                seen[t] = seen.get(t, 0) + n
        rows += [(place, t, n) for t, n in sorted(seen.items())]
        if len(numbers) > 500_000:
            numbers.clear()
    return np.array(lengths, np.int64), np.array(rows, np.int64).reshape(-1, 3)


def _scored_here(rows: DataFrame, asked: DataFrame, n: int | None) -> DataFrame:
    """(query_id, _id, score) of rows (_id, text), in two passes: counts of the terms, then scores; each task gives its n best rows a query.

    Whoever may tie by the rounded score with the n-th stays, so what a task leaves out has n rows before it in that task.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    pairs = asked.collect()
    names = list(dict.fromkeys(r.query_id for r in pairs))
    terms = {t: i for i, t in enumerate(dict.fromkeys(r.term for r in pairs))}
    place = {q: i for i, q in enumerate(names)}
    uses = np.array(sorted((terms[r.term], place[r.query_id]) for r in pairs), np.int64).reshape(-1, 2)
    first = np.searchsorted(uses[:, 0], np.arange(len(terms) + 1))
    step = max(1, min(256, 2_000_000 // len(names)))  # texts whose scores are held at once

    def count(batches):
        df, n_docs, n_texts, total = np.zeros(len(terms), np.int64), 0, 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(a, 256)
                lengths, rows = _matches(texts, terms)
                n_docs, n_texts, total = n_docs + len(texts), n_texts + len(texts) - texts.null_count, total + int(lengths.sum())
                df += np.bincount(rows[:, 1], minlength=len(terms))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*held.tolist(), -1, -2, -3], pa.int64()), pa.array([*df[held].tolist(), n_docs, n_texts, total], pa.int64())], ["term", "n"])

    counts = {r.term: r.n for r in rows.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.array([counts.get(t, 0) for t in range(len(terms))], np.float64)
    n_docs, average = counts.get(-1, 0), max(counts.get(-3, 0) / max(1, counts.get(-2, 0)), 1.0)
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))

    def best(pool: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The rows that may be among the n best of their query, and for each query the score that others must reach."""
        pool = pool.take(pc.sort_indices(pool, sort_keys=[("q", "ascending"), ("score", "descending"), ("_id", "ascending")], null_placement="at_start"))
        q, score = pool["q"].to_numpy(), pool["score"].to_numpy()
        at = np.arange(len(q))

        def within(new):  # places within runs
            starts = np.flatnonzero(new)
            return at - np.repeat(starts, np.diff(np.r_[starts, len(q)]))

        new = np.ones(len(q), bool)
        new[1:] = q[1:] != q[:-1]
        equal = new.copy()
        equal[1:] |= score[1:] != score[:-1]
        last = np.flatnonzero(within(new) == n - 1)
        least = np.zeros(len(names))
        least[q[last]] = score[last] - 2e-9
        return pool.take(pa.array(np.flatnonzero((within(equal) < n) & (score >= least[q])))), least

    def score(batches):
        pool, least = [], np.zeros(len(names))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                ids = batch.column(0).slice(a, step)
                lengths, rows = _matches(batch.column(1).slice(a, step), terms)
                doc, t, tf = rows.T
                weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / average))
                times = first[t + 1] - first[t]
                use = np.repeat(first[t] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum()) if len(t) else np.zeros(0, np.int64)
                sums = np.bincount(np.repeat(doc, times) * len(names) + uses[use, 1], np.repeat(weight, times), minlength=len(ids) * len(names)).reshape(len(ids), -1)
                d, q = np.nonzero((sums > 0) & (sums >= least))
                found = pa.table({"q": pa.array(q, pa.int32()), "_id": ids.take(pa.array(d)), "score": pa.array(sums[d, q], pa.float64())})
                if n is None:
                    yield from found.to_batches()
                    continue
                pool.append(found)
                if sum(map(len, pool)) > max(100_000, 4 * n * len(names)):
                    one, least = best(pa.concat_tables(pool))
                    pool = [one]
        if pool:
            yield from best(pa.concat_tables(pool))[0].combine_chunks().to_batches()

    kind = rows.schema["_id"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"q int, _id {kind}, score double")
    known = rows.sparkSession.createDataFrame([(i, q) for i, q in enumerate(names)], f"q int, query_id {asked.schema['query_id'].dataType.simpleString()}")
    return scored.join(F.broadcast(known), "q").select("query_id", "_id", "score")  # as many rows as queries that are held anyway


def bm25(chunks: DataFrame, queries: DataFrame, n: int | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, query); statistics over the given, that is the visible, chunks.

    Each task scores its chunks for all queries and keeps the best, so no postings are shuffled.  Where the queries are too
    many for that, or chunks share ids (they count as one then), the queries' terms are exploded from chunks and joined.
    """
    asked = _asked(queries)
    held = 0 < asked.limit(MOST_ASKED + 1).count() <= MOST_ASKED
    if not held or chunks.groupBy(id).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).limit(1).count():
        scored = _scored_by_joins(chunks, queries, id, text)
    else:
        scored = _scored_here(chunks.select(F.col(id).alias("_id"), F.col(text).alias("text")), asked, n).withColumnRenamed("_id", id)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), id)
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def _scored_by_joins(chunks: DataFrame, queries: DataFrame, id: str, text: str) -> DataFrame:
    """(query_id, id, score); only the queries' terms are exploded from chunks (a join on distinct terms), so the shuffle is of matching postings."""
    asked = _asked(queries)
    words = chunks.select(F.col(id).alias("_id"), cased_tokens(F.col(text)).alias("_t"))
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("avg_len"))
    found = words.select("_id", F.size("_t").alias("len"), F.explode("_t").alias("_w")).select("_id", "len", F.lower("_w").alias("term"))
    found = found.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "_id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    hits = found.join(df, "term").join(asked, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1.0))))
    return hits.groupBy("query_id", F.col("_id").alias(id)).agg(F.sum(idf * weight).alias("score"))


def reciprocal_rank_fusion(lists: list[DataFrame], n: int | None = None, id: str = "doc_id") -> DataFrame:
    """Sum over lists (query_id, id, rank) of 1 / (60 + rank); one shuffle for any number of lists."""
    every = lists[0].select("query_id", id, "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select("query_id", id, "rank"))
    fused = every.groupBy("query_id", id).agg(F.sum(1 / (F.lit(float(RRF)) + F.col("rank"))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), id)
    fused = fused.withColumn("rank", F.row_number().over(w))
    return fused if n is None else fused.where(F.col("rank") <= n)


def shortlist(top_k: int) -> tuple[int, int]:
    """Sizes of the reranked shortlist and of each candidate list."""
    n = min(400, 4 * max(1, min(100, top_k)))
    return n, 4 * n


def plan(queries: DataFrame, mode: str | None = None) -> DataFrame:
    """Adds classification, lexical, vector, graph, rerank by the query's words (or an explicit mode column)."""
    q = F.translate("query", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kind = F.when(q.contains('"') | q.rlike(IDENTIFIER), "lexical").when(q.rlike(RELATIONAL), "graph").when(q.rlike(CONCEPTUAL), "vector").otherwise("hybrid")
    rerank = kind != "lexical"
    if mode:
        kind = F.coalesce(F.col(mode), kind)
    out = queries.withColumn("rerank", rerank).withColumn("classification", kind)
    c = F.col("classification")
    return out.withColumns({"lexical": c != "vector", "vector": c != "lexical", "graph": c == "graph"})


def expand_abbreviations(c: Column, most: int = 3) -> Column:
    """At most ``most`` different abbreviations, in listed order."""
    done, out = F.lit(0), c
    for short, long in EXPANSIONS.items():
        hit = out.rlike(rf"(?i)\b{short}\b") & (done < most)
        new = F.when(hit, F.regexp_replace(out, rf"(?i)\b{short}\b", long)).otherwise(out)
        done = done + hit.cast("int")
        out = new
    return out


def rewrite(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = 512) -> DataFrame:
    """User turns with abbreviations expanded and, where a pronoun refers back, the last different user turn put before."""
    users = turns.where(F.col(role) == "user")
    w = Window.partitionBy(conversation).orderBy(turn)
    prior = F.lag(text).over(w)
    effective = expand_abbreviations(F.col(text))
    joined = F.concat(prior, F.lit(" "), effective)
    refers = F.lower(text).rlike(PRONOUN) & prior.isNotNull() & (prior != F.col(text)) & (F.length(joined) <= most)
    return users.select(conversation, turn, F.when(F.coalesce(refers, F.lit(False)), joined).otherwise(effective).alias("effective_query"))


def rerank(hits: DataFrame) -> DataFrame:
    """score + overlap, recency, authority, source quality and feedback; columns query, title, section, text, age_days, authority, source_quality, feedback."""
    overlap = token_overlap(F.col("query"), F.concat_ws(" ", "title", "section", "text"))
    extra = 0.35 * overlap + 0.05 / (1 + F.col("age_days") / 365) + 0.08 * F.col("authority") + 0.08 * F.col("source_quality") + 0.05 * F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("feedback")))
    w = Window.partitionBy("query_id").orderBy(F.round(F.col("rerank_score"), 9).desc(), "doc_id")
    return hits.withColumn("overlap", overlap).withColumn("rerank_score", F.col("score") + extra).withColumn("rank", F.row_number().over(w))


def confidence(ranked: DataFrame) -> DataFrame:
    """(query_id, confidence, insufficient) from the first two hits of each query."""
    two = ranked.where("rank <= 2").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("overlap"))).alias("o"), F.max(F.when(F.col("rank") == 1, F.col("rerank_score"))).alias("s"), F.max(F.when(F.col("rank") == 2, F.col("rerank_score"))).alias("t"))
    margin = F.greatest(F.lit(0.0), F.col("s") - F.coalesce("t", F.lit(0.0)))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.55 * F.col("o") + 0.25 * F.least(F.lit(1.0), F.col("s")) + 0.2 * F.least(F.lit(1.0), 10 * margin)))
    return two.select("query_id", value.alias("confidence"), (value < 0.18).alias("insufficient"))


def evaluate(hits: DataFrame, judgments: DataFrame, k: int, id: str = "doc_id", by: str | None = None) -> DataFrame:
    """recall@k, MRR and nDCG@k over queries with judgments (query_id, id); hits: query_id, id, rank."""
    keys = ["query_id"] + ([by] if by else [])
    relevant = judgments.select(*keys, F.col(id).alias("_id")).distinct()
    total = relevant.groupBy(*keys).agg(F.count("*").alias("n"))
    found = hits.where(F.col("rank") <= k).select("query_id", F.col(id).alias("_id"), "rank")
    got = relevant.join(found, ["query_id", "_id"]).groupBy(*keys).agg(F.count("*").alias("hit"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    per = total.join(got, keys, "left").select(*keys, (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))
    grouped = per.groupBy(by) if by else per.groupBy()
    return grouped.agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"))


def retained_modes(per_mode: DataFrame, mode: str = "mode", baseline: str = "fast") -> DataFrame:
    """Modes whose nDCG is no worse than the baseline's."""
    base = per_mode.where(F.col(mode) == baseline).select(F.col("ndcg").alias("base"))
    return per_mode.crossJoin(F.broadcast(base)).withColumn("retained", F.col("ndcg") >= F.col("base")).drop("base")  # one row


def feedback_scores(feedback: DataFrame, id: str = "chunk_id") -> DataFrame:
    """Net score of +1 / -1 votes and the boost they suggest, within a tenth."""
    net = feedback.groupBy(id).agg(F.sum("vote").cast("long").alias("net"))
    return net.withColumn("boost", F.greatest(F.lit(-0.1), F.least(F.lit(0.1), F.col("net") * 0.02)))


def _parity(values, width: int):
    """Bits of ``width``: for each how often the values fall on it, odd or even."""
    import numpy as np

    return np.packbits(np.bincount(values & (width - 1), minlength=width).astype(np.uint8) & 1)


def _differing(a: bytes, b: bytes) -> int:
    """How many bits of two parity bitmaps differ; the wider one is folded to the other's width (both are powers of two)."""
    import numpy as np

    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    n = min(len(x), len(y))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, n)) ^ np.bitwise_xor.reduce(y.reshape(-1, n))).sum())


def _near(rows: DataFrame, id: str, recent: int, threshold: float) -> DataFrame:
    """Pairs (id, of) of ``rows`` (id, size, h, bits, _t, _k, _n, _own) within a group (_t, _k) that may reach the threshold.

    Sets differ in as many elements at least as their parity bitmaps in bits, so no pair that reaches it is left out.
    """
    import numpy as np
    import pyarrow as pa

    kind = rows.schema[id].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_n")
        place, size, own = (group[c].to_numpy() for c in ("_n", "size", "_own"))
        codes = group["h"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        bits, width = group["bits"].to_pylist(), np.array([len(b) for b in group["bits"].to_pylist()], np.int64)
        levels = {w: np.stack([np.frombuffer(b, np.uint8) for b, k in zip(bits, width) if k == w]).view(np.uint64) for w in np.unique(width)}
        spot = np.zeros(len(bits), np.int64)
        for w in levels:
            spot[width == w] = np.arange(int((width == w).sum()))
        left, right = [], []
        for i in np.flatnonzero(own):
            low = np.searchsorted(place, place[i] - recent)
            j = np.arange(low, i)
            total, small, large = size[j] + size[i], np.minimum(size[j], size[i]), np.maximum(size[j], size[i])
            most = total * (1 - threshold) / (1 + threshold) + 1e-6
            j, most = (x[(small > 0) & (small >= threshold * large - 1e-6) & (codes[j] != codes[i])] for x in (j, most))
            for w in np.unique(width[j]):
                of, limit = j[width[j] == w], most[width[j] == w]
                if w == width[i]:
                    differ = np.bitwise_count(levels[w][spot[of]] ^ levels[w][spot[i]]).sum(1)
                else:
                    differ = np.array([_differing(bits[i], bits[k]) for k in of])
                of = of[differ <= limit]
                left.append(np.full(len(of), i))
                right.append(of)
        pick = lambda at: group[id].take(pa.array(np.concatenate(at) if at else np.zeros(0, np.int64)))
        return pa.table({"id": pick(left), "of": pick(right)})

    return rows.groupBy("_t", "_k").applyInArrow(run, f"id {kind}, of {kind}")


def _with_bits(docs: DataFrame, id: str, keep: list[str]) -> DataFrame:
    """``docs`` (id, keep, g) with the number of bigrams and their parity bitmap, of two to four bits a bigram, instead of them."""
    import numpy as np
    import pyarrow as pa

    rows = docs.select(id, *keep, F.transform("g", lambda x: F.xxhash64(x)).alias("_x"))
    names = [id, *keep]

    def run(batches):
        for batch in batches:
            lists = batch.column(len(names))
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(ends)
            bits = [_parity(flat[a:b], max(512, 1 << int(2 * (b - a) - 1).bit_length()) if b > a else 512).tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())], [*names, "size", "bits"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{fields}, size int, bits binary")


def duplicates(docs: DataFrame, threshold: float = 0.9, recent: int = 200, tenant: str = "tenant", order: str = "ingested_at", id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, of, similarity, exact): equals by content hash within a tenant, and near ones among the ``recent`` documents before each in ``order``.

    Ids are unique.  Positions are dealt in blocks of ``recent``, so a document meets its own block and the one before.
    There parity bitmaps of the bigrams leave out pairs that cannot be near; texts of the others are compared.
    """
    hashed = docs.select(tenant, id, content_hash(F.col(text)).alias("h"))
    first = hashed.groupBy(tenant, "h").agg(F.min(id).alias("of"))
    exact = hashed.join(first, [tenant, "h"]).where(F.col(id) != F.col("of")).select(id, "of", F.lit(1.0).alias("similarity"), F.lit(True).alias("exact"))
    place = docs.where(F.col(tenant).isNotNull()).select(F.col(id).alias("_id"), F.col(tenant).alias("_t"), F.row_number().over(Window.partitionBy(tenant).orderBy(order, id)).alias("_n"))
    sets = docs.where(F.col(text).isNotNull()).select(id, content_hash(F.col(text)).alias("h"), bigrams(F.col(text)).alias("g"))
    placed = _with_bits(sets, id, ["h"]).join(place, F.col(id) == F.col("_id")).drop("_id").withColumn("_b", F.floor(F.col("_n") / recent))
    dealt = placed.withColumn("_k", F.explode(F.array(F.col("_b"), F.col("_b") + 1))).withColumn("_own", F.col("_k") == F.col("_b")).drop("_b")
    found = _near(dealt, id, recent, threshold)
    texts = docs.select(F.col(id).alias("_id"), text)
    pairs = found.join(texts.select(F.col("_id").alias("id"), F.col(text).alias("_a")), "id").join(texts.select(F.col("_id").alias("of"), F.col(text).alias("_b")), "of")
    pairs = pairs.select(F.col("id").alias("_i"), "of", bigrams(F.col("_a")).alias("_a"), bigrams(F.col("_b")).alias("_b"))
    near = pairs.select(F.col("_i").alias(id), "of", set_similarity(F.col("_a"), F.col("_b")).alias("similarity"), F.lit(False).alias("exact")).where(F.col("similarity") >= threshold)
    return exact.unionByName(near)


def document_versions(docs: DataFrame, parser: str, id: str = "doc_id", text: str = "text", metadata: list[str] | None = None) -> DataFrame:
    """version_id = hash of id, text, metadata and parser."""
    return docs.withColumn("version_id", F.sha2(F.concat_ws("\n", F.col(id).cast("string"), text, *[F.col(c).cast("string") for c in metadata or []], F.lit(parser)), 256))


def retention(docs: DataFrame, cutoff: Column, at: str = "ingested_at", tenant: str | None = None, erase: str | None = None) -> DataFrame:
    """Documents not older than the cutoff, without an erased tenant's."""
    out = docs.where(F.col(at) >= cutoff)
    return out.where(F.col(tenant) != erase) if tenant and erase else out


def pack_context(hits: DataFrame, budget: int = 16000, id: str = "chunk", text: str = "text") -> DataFrame:
    """(query_id, id, citation): distinct texts in rank order, one that would exceed the budget is passed over.

    The greedy choice folds over a query's hits in order; a query's hits are a bounded shortlist.
    """
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    first = Window.partitionBy("query_id", "_n").orderBy("rank")
    unique = hits.withColumn("_n", clean).withColumn("_k", F.row_number().over(first)).where("_k = 1")
    rows = unique.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(id).alias("id"), F.length(text).alias("size")))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(rows.schema["rows"].dataType).alias("kept"))

    def step(acc, x):
        fits = acc["used"] + x["size"] <= budget
        return F.struct((acc["used"] + F.when(fits, x["size"]).otherwise(0)).cast("long").alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    kept = rows.select("query_id", F.aggregate("rows", start, step)["kept"].alias("kept"))
    return kept.select("query_id", F.posexplode("kept").alias("_p", "x")).select("query_id", F.col("x.id").alias(id), (F.col("_p") + 1).alias("citation"))


def graph_edges(chunks: DataFrame, document: str = "document", position: str = "position", level: str | None = None) -> DataFrame:
    """src, dst, type, weight: each chunk with its section (or document root) and its neighbours.

    ``level``: column with the heading level of heading chunks (0 otherwise); a section's parent is the last heading
    before it of a smaller level.
    """
    w = Window.partitionBy(document).orderBy(position)
    node = F.concat_ws("/", F.col(document), F.col(position))
    root = F.concat_ws("/", F.col(document), F.lit("root"))
    rows = chunks.select(document, position, node.alias("node"), root.alias("root"), F.lag(position).over(w).alias("_p"), (F.col(level) if level else F.lit(0)).alias("_l"))
    before = rows.where("_p is not null").select(F.concat_ws("/", F.col(document), F.col("_p")).alias("src"), F.col("node").alias("dst"))
    if level:
        seen = F.collect_list(F.when(F.col("_l") > 0, F.struct("node", "_l"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_h", seen)
        own = F.element_at(F.filter("_h", lambda h: (F.col("_l") == 0) | (h["_l"] < F.col("_l"))), -1)
        rows = rows.withColumn("parent", F.coalesce(F.try_element_at(F.transform(F.filter("_h", lambda h: (F.col("_l") == 0) | (h["_l"] < F.col("_l"))), lambda h: h["node"]), F.lit(-1)), "root"))
        del own
    else:
        rows = rows.withColumn("parent", F.col("root"))
    weight = F.when(F.col("_l") > 0, W_SECTION).otherwise(W_CHUNK).alias("weight")
    up = rows.select(F.col("node").alias("src"), F.col("parent").alias("dst"), F.lit("parent").alias("type"), weight)
    down = rows.select(F.col("parent").alias("src"), F.col("node").alias("dst"), F.lit("child").alias("type"), weight)
    ahead = before.select("src", "dst", F.lit("next").alias("type"), F.lit(W_SIBLING).alias("weight"))
    back = before.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("previous").alias("type"), F.lit(W_SIBLING).alias("weight"))
    return up.union(down).union(ahead).union(back)


def expand(ranked: DataFrame, edges: DataFrame, top_k: int, seeds: int = 5, children: int = 8, neighbours: int = 32) -> DataFrame:
    """Hits (query_id, node, score, rank) with graph neighbours of the first ``seeds``: score x weight, through a section to its first children."""
    start = ranked.where(F.col("rank") <= seeds).select("query_id", F.col("node").alias("seed"), "score", F.col("rank").alias("seed_rank"))
    one = edges.select("src", F.col("dst").alias("mid"), "type", (F.col("weight") / 255.0).alias("w"))
    hop = start.join(one, F.col("seed") == F.col("src")).select("query_id", "seed", "seed_rank", "score", "mid", "type", "w")
    direct = hop.where("type in ('next', 'previous')").select("query_id", "seed", "seed_rank", F.col("mid").alias("node"), (F.col("score") * F.col("w")).alias("score"), F.col("type").alias("relation"))
    kids = edges.where("type = 'child'").select(F.col("src").alias("_s"), F.col("dst").alias("kid"), (F.col("weight") / 255.0).alias("w2"))
    kids = kids.withColumn("_n", F.row_number().over(Window.partitionBy("_s").orderBy("kid"))).where(F.col("_n") <= children)
    across = hop.where("type = 'parent'").join(kids, F.col("mid") == F.col("_s")).select("query_id", "seed", "seed_rank", F.col("kid").alias("node"), (F.col("score") * F.col("w") * F.col("w2")).alias("score"), F.lit("section_child").alias("relation"))
    found = direct.unionByName(across).where("node <> seed")
    w = Window.partitionBy("query_id").orderBy("seed_rank", F.col("score").desc(), "node", "relation")
    found = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= neighbours)
    new = found.join(ranked.select("query_id", "node"), ["query_id", "node"], "left_anti")
    new = new.groupBy("query_id", "node").agg(F.max("score").alias("score")).withColumn("hops", F.lit(1))
    both = ranked.select("query_id", "node", "score", F.lit(0).alias("hops")).unionByName(new)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "node")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def neighbours(edges: DataFrame, nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """One hop from ``nodes`` (node) to nodes that ``allowed`` (node) holds."""
    out = edges.join(nodes.select(F.col("node").alias("src")), "src")
    return out.join(allowed.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "type", "weight")


def split_by_decisions(chunks: DataFrame, decisions: DataFrame, id: str = "chunk", text: str = "text") -> DataFrame:
    """Chunks split at the ascending offsets that a decisions table (id, split_offsets, header) gives; others pass whole."""
    joined = chunks.join(decisions, id, "left")
    ends = F.concat(F.coalesce("split_offsets", F.array().cast("array<int>")), F.array(F.length(text)))
    parts = joined.withColumn("_e", ends).select("*", F.posexplode("_e").alias("part", "_end"))
    start = F.when(F.col("part") > 0, F.get("_e", F.col("part") - 1)).otherwise(0)
    body = F.col(text).substr(start + 1, F.col("_end") - start)
    return parts.select(id, "part", F.when(F.col("header").isNotNull(), F.concat_ws("\n", "header", body)).otherwise(body).alias(text)).where(F.length(text) > 0)
