"""Evidence-bound memory as relational transforms: status, event fold, recall ranking, consolidation, refinement proposals.

A ledger is append-only; every view is computed from it, so no row is ever changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalar import memory_category, redact, steps, token_overlap, tokens

#: Sensitivity classes that need confirmation, quarantine pattern, score weights, purpose multipliers.
SENSITIVE = ["sensitive", "personal", "legal", "financial", "identity"]
QUARANTINE = r"(?i)\b(system policy|agent identity|ignore previous|credential)\b"
PROPOSAL_REJECT = r"(?i)\b(ignore previous|system prompt|agent identity|api key|password)\b"
WEIGHTS = {"overlap": 0.42, "confidence": 0.18, "importance": 0.14, "reinforcement": 0.08, "decay": 0.08, "trust": 0.10}
PURPOSE_MIX = {
    "coding": {"procedural": 1.25, "negative": 1.15},
    "planning": {"prospective": 1.3, "working": 1.2},
    "conversation": {"preference": 1.25, "episodic": 1.1},
    "research": {"semantic": 1.2},
}
SECTIONS = {"working": "current_state", "semantic": "durable_facts", "episodic": "episodes", "procedural": "procedures", "preference": "preferences", "prospective": "commitments", "negative": "uncertainty"}
EXTRACT = [
    (r"(?i)\b(?:i|we) prefer\s+(.+?)(?:[.!?]|$)", "preference", "preference"),
    (r"(?i)\bremember(?: that)?\s+(.+?)(?:[.!?]|$)", "semantic", "explicit reminder"),
    (r"(?i)\b(?:need|must|should) (?:to )?(.+?)(?:[.!?]|$)", "prospective", "commitment"),
]
DAY_MS = 86_400_000
EVIDENCE_KINDS = ("message", "document", "observation", "tool_result", "feedback")


def append_evidence(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds rows with content redacted and hashed; ids that the log holds are left out, as evidence never changes."""
    fresh = rows.withColumn("content", redact(F.col("content"))).withColumn("content_hash", F.sha2("content", 256))
    return log.unionByName(fresh.join(log.select("id"), "id", "left_anti").dropDuplicates(["id"]))


def remember_status(records: DataFrame, confirmed: Column | None = None) -> DataFrame:
    """status: quarantined by pattern for untrusted origins, pending_confirmation for sensitive classes, else active."""
    sure = F.lit(False) if confirmed is None else F.coalesce(confirmed, F.lit(False))
    risky = F.col("provenance").isin("imported_document", "inferred") & F.col("statement").rlike(QUARANTINE)
    ask = (F.col("sensitivity").isin(SENSITIVE) | (F.col("provenance") == "identity")) & ~sure
    return records.withColumn("status", F.when(risky, "quarantined").when(ask, "pending_confirmation").otherwise("active"))


def missing_evidence(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, evidence_id) that records name and the evidence lacks."""
    named = records.select("id", F.explode("evidence_ids").alias("evidence_id"))
    return named.join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_anti")


def fold_events(records: DataFrame, events: DataFrame) -> DataFrame:
    """Latest state from events (id, seq, kind, amount): confirm, reject, dispute, supersede, forget decide the status by
    the latest of them; each reinforce adds one and 0.02 confidence (0.05 by new evidence: amount 1), at most 1."""
    kinds = {"confirm": "active", "reject": "rejected", "dispute": "disputed", "supersede": "superseded", "forget": "forgotten"}
    state = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    folded = events.groupBy("id").agg(
        F.max_by(F.when(F.col("kind").isin(list(kinds)), state[F.col("kind")]), F.when(F.col("kind").isin(list(kinds)), F.col("seq"))).alias("_status"),
        F.count_if(F.col("kind") == "reinforce").alias("_n"),
        F.coalesce(F.sum(F.when(F.col("kind") == "reinforce", F.when(F.col("amount") == 1, 0.05).otherwise(0.02))), F.lit(0.0)).alias("_c"),
    )
    out = records.join(folded, "id", "left")
    return out.withColumns({
        "status": F.coalesce("_status", "status"),
        "reinforcement": F.col("reinforcement") + F.coalesce("_n", F.lit(0)),
        "confidence": F.least(F.lit(1.0), F.col("confidence") + F.coalesce("_c", F.lit(0.0))),
    }).drop("_status", "_n", "_c")


def recall(memories: DataFrame, query: Column, purpose: str, now_ms: int, namespaces: list[str] | None = None, sensitivity: tuple[str, ...] = ("public", "internal"), history: bool = False) -> DataFrame:
    """All memories with recall_score, reason (of suppression, null if recalled) and section.

    Ranked are the rows without a reason, by score descending, event time descending, id.
    """
    c = F.col
    reason = (
        F.when(~c("namespace").isin(namespaces or list(SECTIONS)), "namespace")
        .when(~c("sensitivity").isin(list(sensitivity)), "sensitivity")
        .when(~F.array_contains("allowed_purposes", purpose), "purpose")
        .when((c("status") != "active") & ~(F.lit(history) & (c("status") == "superseded")), c("status"))
        .when(F.coalesce(F.lit(now_ms) < c("valid_from_ms"), F.lit(False)) & (c("valid_from_ms") != 0), "not_yet_valid")
        .when(F.coalesce(F.lit(now_ms) > c("valid_until_ms"), F.lit(False)) & (c("valid_until_ms") != 0), "expired")
    )
    asked = F.array_distinct(tokens(query))
    overlap = F.size(F.array_intersect(asked, tokens(F.concat_ws(" ", "subject", "statement")))) / F.greatest(F.lit(1), F.size(asked))
    age = F.greatest(F.lit(0), F.lit(now_ms) - c("event_time_ms")) / float(DAY_MS)
    decay = F.when(c("namespace") == "episodic", F.exp(-age / 30)).otherwise(1.0)
    trust = F.when(c("provenance").isin("explicit", "explicit_correction"), 1.0).otherwise(0.75)
    mix = F.lit(1.0)
    for name, factor in PURPOSE_MIX.get(purpose, {}).items():
        mix = F.when(c("namespace") == name, factor).otherwise(mix)
    w = WEIGHTS
    score = (w["overlap"] * overlap + w["confidence"] * c("confidence") + w["importance"] * c("importance") + w["reinforcement"] * F.least(c("reinforcement") / 5, F.lit(1.0)) + w["decay"] * decay + w["trust"] * trust) * mix
    section = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])[c("namespace")]
    return memories.withColumns({"recall_score": score, "reason": reason, "section": section})


def ranked(recalled: DataFrame, limit: int = 12) -> DataFrame:
    return recalled.where("reason is null").orderBy(F.round("recall_score", 9).desc(), F.col("event_time_ms").desc(), "id").limit(max(0, min(limit, 100)))


def native_recall(hits: DataFrame) -> DataFrame:
    """Retrieval hits of memories, weighted: score x (0.55 + 0.2 confidence + 0.15 importance + 0.1 reinforcement)."""
    factor = 0.55 + 0.2 * F.col("confidence") + 0.15 * F.col("importance") + 0.1 * F.least(F.col("reinforcement") / 5, F.lit(1.0))
    return hits.withColumn("recall_score", F.col("score") * factor)


def due(memories: DataFrame, now_ms: int, context: str = "", limit: int = 20) -> DataFrame:
    """Active prospective memories whose time has come and of whose tokens the context contains one (any, without context)."""
    live = memories.where("namespace = 'prospective' and status = 'active'")
    live = live.where(F.col("valid_from_ms").isNull() | (F.col("valid_from_ms") <= now_ms))
    if context.strip():
        words = tokens(F.concat_ws(" ", "provenance", "subject"))
        live = live.where(F.exists(words, lambda t: F.lit(context.lower()).contains(t)))
    return live.orderBy("id").limit(limit)


def combined(documents: DataFrame, memories: DataFrame) -> DataFrame:
    """Two tiers in one table: documents first, memory after; columns id, score."""
    a = documents.select(F.lit(0).alias("tier"), F.lit("authoritative_documents").alias("kind"), "id", "score")
    b = memories.select(F.lit(1).alias("tier"), F.lit("memory_context").alias("kind"), "id", "score")
    return a.union(b).orderBy("tier", F.col("score").desc(), "id")


def working(rows: DataFrame, now_ms: int) -> DataFrame:
    """Working memory whose time to live has not run out."""
    return rows.where(F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now_ms))


def extract(messages: DataFrame, id: str = "id", text: str = "content") -> DataFrame:  # noqa: A002
    """Explicit statements of preference, memory and commitment: id, namespace, subject, statement, the first of each pattern."""
    made = [F.struct(F.lit(ns).alias("namespace"), F.lit(subject).alias("subject"), F.regexp_extract(text, p, 1).alias("statement")) for p, ns, subject in EXTRACT]
    rows = messages.select(F.col(id), F.explode(F.array(*made)).alias("m")).select(id, "m.*")
    return rows.where(F.length("statement") > 0)


def acceptable(proposals: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds rejection: quote not verbatim in its evidence, low confidence, sensitive class, or identity and credential text (null: accepted).

    Proposals: id, evidence_id, quote, confidence, sensitivity, statement.
    """
    held = evidence.select(F.col("id").alias("evidence_id"), F.col("content").alias("_content"))
    out = proposals.join(held, "evidence_id", "left")
    why = (
        F.when(F.col("_content").isNull(), "unavailable evidence")
        .when(~F.contains("_content", "quote"), "quote not verbatim")
        .when(F.col("confidence") < 0.55, "low confidence")
        .when(F.col("sensitivity").isin(SENSITIVE), "sensitive")
        .when(F.col("statement").rlike(PROPOSAL_REJECT), "identity, policy or credential")
    )
    return out.withColumn("rejection", why).drop("_content")


def consolidate(memories: DataFrame, least: int = 3) -> DataFrame:
    """Semantic memories from episodes that share a subject: union of evidence, confidence + 0.05 up to 0.95, most importance."""
    live = memories.where("namespace = 'episodic' and status = 'active'")
    key = F.lower(F.trim("subject"))
    grouped = live.groupBy(key.alias("subject_key")).agg(
        F.count("*").alias("episodes"),
        F.max_by("statement", "event_time_ms").alias("statement"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"),
        F.least(F.lit(0.95), F.max("confidence") + 0.05).alias("confidence"),
        F.max("importance").alias("importance"),
    )
    return grouped.where(F.col("episodes") >= least)


def conflicts(memories: DataFrame) -> DataFrame:
    """Members of subjects with more than one different statement (id, subject_key, statements)."""
    keyed = memories.withColumn("subject_key", F.lower(F.trim("subject")))
    many = keyed.groupBy("subject_key").agg(F.count_distinct(F.lower(F.trim("statement"))).alias("statements")).where("statements > 1")
    return keyed.join(many, "subject_key").select("id", "subject_key", "statements")


def unreferenced(evidence: DataFrame, links: DataFrame, live: DataFrame) -> DataFrame:
    """Evidence that no live memory names: a correlated NOT EXISTS as an anti join."""
    used = links.join(live.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select(F.col("evidence_id").alias("id")).distinct()
    return evidence.join(used, "id", "left_anti")


def refinements(memories: DataFrame, now_ms: int, stale_days: int = 90) -> DataFrame:
    """Proposals (memory_id, operation, confidence, detail): categorize, split_step, add_validation, add_recovery, flag_stale, flag_conflict."""
    m = memories.where("status = 'active'").withColumn("_steps", steps(F.col("statement"))).withColumn("_low", F.lower("statement"))
    procedure = (F.col("namespace") == "procedural") | (F.size("_steps") > 1)
    age = F.floor(F.greatest(F.lit(0), F.lit(now_ms) - F.col("recorded_at_ms")) / float(DAY_MS))

    def made(when, operation, confidence, detail):
        return F.when(when, F.struct(F.lit(operation).alias("operation"), F.lit(confidence).alias("confidence"), detail.alias("detail")))

    all_made = F.array(
        made(F.lit(True), "categorize", 0.9, memory_category(F.col("subject"), F.col("statement"), F.col("namespace"))),
        made(procedure & (F.size("_steps") > 1), "split_step", 0.9, F.array_join("_steps", " | ")),
        made(procedure & ~F.col("_low").rlike("verify|check|test|validate"), "add_validation", 0.65, F.lit("Verify the expected outcome before continuing.")),
        made(procedure & ~F.col("_low").rlike("fail|rollback|recover|retry"), "add_recovery", 0.6, F.lit("Stop safely and record the failure for review.")),
        made(procedure & (age >= stale_days), "flag_stale", 0.8, age.cast("string")),
    )
    out = m.select(F.col("id").alias("memory_id"), F.explode(F.filter(all_made, lambda x: x.isNotNull())).alias("x")).select("memory_id", "x.*")
    clash = conflicts(memories.where("status = 'active'"))
    return out.unionByName(clash.select(F.col("id").alias("memory_id"), F.lit("flag_conflict").alias("operation"), F.lit(0.7).alias("confidence"), F.col("statements").cast("string").alias("detail")))


def overlay(memories: DataFrame, approved: DataFrame) -> DataFrame:
    """Memories with the latest approved patch (memory_id, seq, statement) laid over; the source rows stay as they are."""
    last = approved.groupBy(F.col("memory_id").alias("id")).agg(F.max_by("statement", "seq").alias("_patch"))
    return memories.join(last, "id", "left").withColumn("effective_statement", F.coalesce("_patch", "statement")).drop("_patch")


def procedure_for(memories: DataFrame, query: Column, least: float = 0.6) -> DataFrame:
    """Procedural memories whose tokens cover enough of the query, service usage aside."""
    hit = token_overlap(query, F.concat_ws(" ", "subject", "statement"))
    out = memories.where("namespace = 'procedural' and status = 'active'").withColumn("score", hit).where(F.col("score") >= least)
    return out.where(~F.lower("statement").rlike(r"\b(api usage|rate limit|billing)\b"))


def inspect(memories: DataFrame, links: DataFrame, evidence: DataFrame, relations: DataFrame) -> DataFrame:
    """id with sorted evidence ids and related ids."""
    ev = links.join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi").groupBy(F.col("memory_id").alias("id")).agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence"))
    rel = relations.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_set("target_id")).alias("related"))
    return memories.join(ev, "id", "left").join(rel, "id", "left")


def evaluate(cases: DataFrame) -> DataFrame:
    """One row from cases (recalled, expected, forbidden, stale: arrays of ids): useful, missed, intrusive, stale, harmful."""
    n = lambda c: F.size(c)
    r = F.array_distinct("recalled")
    out = cases.select(
        n(F.array_intersect(r, F.col("expected"))).alias("useful"),
        n(F.array_except(F.col("expected"), r)).alias("missed"),
        n(F.array_except(F.array_except(r, F.col("expected")), F.col("forbidden"))).alias("intrusive"),
        n(F.array_intersect(r, F.col("stale"))).alias("stale"),
        n(F.array_intersect(r, F.col("forbidden"))).alias("harmful"),
        n("expected").alias("wanted"),
    )
    sums = [F.sum(c).cast("long").alias(c) for c in ("useful", "missed", "intrusive", "stale", "harmful")]
    return out.agg(F.count("*").alias("cases"), *sums, (F.sum("useful") / F.greatest(F.lit(1), F.sum("wanted"))).alias("useful_recall"))
