"""Fingerprints of evidence snippets and the campaigns they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnsift.config import ScanConfig
from turnsift.functions.grams import gram_embedding
from turnsift.operators.components import connected_components
from turnsift.operators.durable import durable, written
from turnsift.operators.lsh import LSH_ABOVE, covered
from turnsift.operators.ordered import with_rank
from turnsift.operators.tiles import REF_GROUP, ROW_GROUP, best_of, compare, first_of
from turnsift.operators.vectors import similar_links

_STEPS = "array<struct<ref:string,cos:double>>"
#: Snippets whose leaders are found at once.
HEAD_ROWS = 2_048
#: Hexadecimal digits of an id.
ID_LENGTH = 64


def _ranked(fingerprints: DataFrame) -> DataFrame:
    """Stored fingerprints as references: more hits first, then the smaller id."""
    fewer = F.lpad((F.lit(10**18) - F.col("hit_count")).cast("string"), 19, "0")
    return fingerprints.select(
        F.col("fingerprint_id").alias("ref"), F.concat(fewer, F.col("fingerprint_id")).alias("rank"), "vector"
    )


def _snippet_key(snippet: str) -> Column:
    return F.sha2(F.coalesce(snippet, F.lit("")), 256)


def nearest_fingerprints(
    signals: DataFrame, fingerprints: DataFrame, cfg: ScanConfig = ScanConfig()
) -> DataFrame:
    """Best stored fingerprint of every signal with cosine >= the similarity, else null.

    Adds nearest_id and nearest_cos. Equal cosines go to the fingerprint with more hits, then to
    the smaller id. Equal snippets are compared once; ``signals`` is read twice.
    """
    snippets = written(
        signals.filter("evidence_snippet IS NOT NULL").select("evidence_snippet").distinct()
        .select(_snippet_key("evidence_snippet").alias("id"), gram_embedding("evidence_snippet").alias("vector")),
        "nearest-snippets",
    )
    refs = _ranked(fingerprints).filter("vector IS NOT NULL")
    best = best_of(compare(snippets, refs, cfg.similarity, "best")).select(
        F.col("id").alias("_key"), F.col("ref").alias("nearest_id"), F.col("cos").alias("nearest_cos")
    )
    keyed = signals.withColumn("_key", F.when(F.col("evidence_snippet").isNotNull(), _snippet_key("evidence_snippet")))
    return keyed.join(written(best, "nearest-best"), "_key", "left").drop("_key")


def _rounds(snippets: DataFrame, at_least: float, groups: dict) -> DataFrame:
    """Leaders of a bounded head of the snippets (id, vector).

    In every round the undecided snippets without an earlier undecided similar one lead, and what
    they cover is decided too. The earliest undecided snippet always leads, and a dense group
    is decided in one round, so the rounds follow the longest chain of snippets that decide each
    other, not their number.
    """
    open_, chosen = snippets, snippets.limit(0)
    while not open_.isEmpty():
        refs = _as_refs(open_)
        first = first_of(compare(open_, refs, at_least, "first", **groups))
        later = first.filter("rank < id").select("id")
        fresh = written(open_.join(later, "id", "left_anti").select("id", "vector"), "leaders")
        chosen = chosen.unionByName(fresh)
        rest = open_.join(fresh.select("id"), "id", "left_anti").select("id", "vector")
        done = compare(rest, _as_refs(fresh), at_least, "first", **groups).select("id").distinct()
        open_ = written(rest.join(done, "id", "left_anti").select("id", "vector"), "leaders-open")
    return chosen


def _as_refs(snippets: DataFrame) -> DataFrame:
    return snippets.select(F.col("id").alias("ref"), F.col("id").alias("rank"), "vector")


def _leaders(
    snippets: DataFrame, at_least: float, groups: dict, head_rows: int = HEAD_ROWS, lsh_above: int = LSH_ABOVE
) -> DataFrame:
    """The snippets (id, vector) a pass in id order would make leaders: a snippet leads unless an
    earlier leader is similar.

    Only a head of the open snippets is compared with itself; its leaders then cover what they can
    of the rest, which is compared with leaders alone. So the work is snippets x leaders, and
    leaders are not similar to each other. A head that covers less than half of the rest says that
    leaders are many; the next one is twice as long, so the heads stay few.
    """
    open_, chosen = snippets.select("id", "vector"), snippets.select("id", "vector").limit(0)
    left = open_.count()
    while left:
        cut = open_.select("id").orderBy("id").limit(head_rows).agg(F.max("id")).first()[0]
        fresh = written(_rounds(open_.filter(F.col("id") <= cut), at_least, groups), "leaders-head")
        chosen = chosen.unionByName(fresh)
        rest = open_.filter(F.col("id") > cut)
        done = covered(rest, _as_refs(fresh), at_least, lsh_above, **groups)
        open_ = written(rest.join(done, "id", "left_anti").select("id", "vector"), "leaders-rest")
        before, left = max(0, left - head_rows), open_.count()
        if 2 * left > before:
            head_rows *= 2
    return chosen


def assign_fingerprints(
    signals: DataFrame,
    fingerprints: DataFrame | None = None,
    cfg: ScanConfig = ScanConfig(),
    row_group: int = ROW_GROUP,
    ref_group: int = REF_GROUP,
    head_rows: int = HEAD_ROWS,
    lsh_above: int = LSH_ABOVE,
) -> DataFrame:
    """Fingerprint of every signal as if the signals had arrived one by one.

    ``signals`` is read twice; pass a stored table, not a plan that scans texts.

    ``signals``: signal_id, ts, session_id, evidence_snippet; (ts, signal_id) is the
    arrival order. A signal joins the most similar fingerprint that exists at that moment
    (cosine >= similarity) or founds a new one. Adds fingerprint_id, matched and
    match_cos.

    Equal snippets are embedded and compared once, all comparisons are tiles spread over the
    cluster. A snippet keeps every new leader that beats those before it; leaders are not similar
    to each other, which bounds how many one snippet can be similar to. More leaders than
    ``lsh_above`` are met through hash tables first; the result is the same. Equal cosines go to
    the older new fingerprint, and among stored ones to the one with more hits.
    """
    groups = {"row_group": row_group, "ref_group": ref_group}
    signals = signals.withColumn("evidence_snippet", F.coalesce("evidence_snippet", F.lit("")))
    arrival = F.concat(_stamp(F.col("ts")), F.col("signal_id"))
    snippets = written(
        signals.groupBy(F.col("evidence_snippet").alias("snippet"))
        .agg(F.min(arrival).alias("id"))
        .withColumn("vector", gram_embedding("snippet"))
        .withColumn("key", _snippet_key("snippet")).drop("snippet"),
        "assign-snippets",
    )
    start = snippets.select("id", "key").withColumn("steps", F.array().cast(_STEPS))
    open_ = snippets.select("id", "vector")
    if fingerprints is not None:
        stored = best_of(compare(open_, _ranked(fingerprints), cfg.similarity, "best", **groups))
        stored = written(stored, "assign-stored")
        open_ = open_.join(stored, "id", "left_anti").select("id", "vector")
        old = F.struct(F.concat(F.lit("0"), "ref").alias("ref"), F.col("cos"))
        start = snippets.select("id", "key").join(stored, "id", "left").select(
            "id", "key", F.when(F.col("ref").isNotNull(), F.array(old)).otherwise(F.array().cast(_STEPS)).alias("steps")
        )
    leaders = _leaders(written(open_, "assign-open"), cfg.similarity, groups, head_rows, lsh_above)
    refs = leaders.select(F.concat(F.lit("1"), "id").alias("ref"), F.concat(F.lit("1"), "id").alias("rank"), "vector")
    met = compare(snippets.select("id", "vector"), refs, cfg.similarity, "climb", **groups)
    met = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ref", "cos"))).alias("met"))

    def higher(found: Column, step: Column) -> Column:
        top = F.coalesce(F.try_element_at(found, F.lit(-1))["cos"], F.lit(-2.0))
        return F.when(step["cos"] > top, F.concat(found, F.array(step))).otherwise(found)

    steps = written(
        start.join(met, "id", "left").select(
            "key",
            F.aggregate(F.coalesce("met", F.array().cast(_STEPS)), F.col("steps"), higher).alias("steps"),
        ),
        "assign-steps",
    )
    placed = signals.withColumn("key", _snippet_key("evidence_snippet")).join(steps, "key").drop("key")
    now = F.concat(F.lit("1"), _stamp(F.col("ts")), F.col("signal_id"))
    earlier = F.filter("steps", lambda step: step["ref"] < now)
    best = F.coalesce(F.try_element_at(earlier, F.lit(-1)), F.get("steps", F.lit(0)))
    stored_ref = F.left(best["ref"], F.lit(1)) == "0"
    return (
        placed.withColumn("matched", F.size(earlier) > 0)
        .withColumn("match_cos", F.when(F.size(earlier) > 0, best["cos"]))
        .withColumn(
            "fingerprint_id",
            F.when(stored_ref, F.substring(best["ref"], F.lit(2), F.length(best["ref"])))
            .otherwise(F.sha2(best["ref"], 256)),
        )
        .drop("steps")
    )


# References sort as text: stored fingerprints ("0...") before new ones ("1" + arrival).
def _stamp(ts: Column) -> Column:
    micros = F.unix_micros(ts.cast("timestamp")) + F.lit(10**17)
    return F.lpad(micros.cast("string"), 20, "0")


def with_campaign_match(
    assigned: DataFrame, fingerprints: DataFrame | None = None
) -> DataFrame:
    """campaign_match of matched signals: hit count at that moment and campaign name."""
    numbered = with_rank(assigned, ["fingerprint_id"], ["ts", "signal_id"], "_nth")
    if fingerprints is None:
        known = numbered.withColumns(
            {"_hits": F.lit(0), "_name": F.lit(None).cast("string")}
        )
    else:
        known = numbered.join(
            fingerprints.select(
                "fingerprint_id", F.col("hit_count").alias("_hits"),
                F.col("campaign_name").alias("_name"),
            ),
            "fingerprint_id", "left",
        )
    match = F.struct(
        F.col("fingerprint_id"),
        (F.coalesce("_hits", F.lit(0)) + F.col("_nth") + 1).cast("long").alias("hit_count"),
        F.col("_name").alias("campaign_name"),
    )
    return known.withColumn("campaign_match", F.when(F.col("matched"), match)).drop(
        "_nth", "_hits", "_name"
    )


def fingerprint_updates(assigned: DataFrame) -> DataFrame:
    """New state per touched fingerprint: hits, first and last seen, founding snippet."""
    arrival = F.struct("ts", "signal_id")
    return (
        assigned.groupBy("fingerprint_id")
        .agg(
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.count(F.lit(1)).alias("hit_count"),
            F.min_by("evidence_snippet", arrival).alias("representative_snippet"),
        )
    )


def new_fingerprints(assigned: DataFrame) -> DataFrame:
    """Fingerprints table of a first run (no stored fingerprints)."""
    return fingerprint_updates(assigned).select(
        "fingerprint_id",
        "first_seen",
        "last_seen",
        "hit_count",
        "representative_snippet",
        gram_embedding("representative_snippet").alias("vector"),
        F.lit(None).cast("string").alias("campaign_name"),
        F.lit(False).alias("approved"),
    )


def upsert_fingerprints(stored: DataFrame, assigned: DataFrame) -> DataFrame:
    """Stored fingerprints with the hits of the new signals, plus the new ones."""
    fresh = new_fingerprints(assigned)
    old, new = stored.alias("old"), fresh.alias("new")
    joined = old.join(new, F.col("old.fingerprint_id") == F.col("new.fingerprint_id"), "full")

    def kept(name: str):
        return F.coalesce(F.col(f"old.{name}"), F.col(f"new.{name}")).alias(name)

    return joined.select(
        kept("fingerprint_id"),
        kept("first_seen"),
        F.greatest("old.last_seen", "new.last_seen").alias("last_seen"),
        (
            F.coalesce("old.hit_count", F.lit(0)) + F.coalesce("new.hit_count", F.lit(0))
        ).alias("hit_count"),
        kept("representative_snippet"),
        kept("vector"),
        F.col("old.campaign_name").alias("campaign_name"),
        F.coalesce("old.approved", F.lit(False)).alias("approved"),
    )


def merge_deltas(rows: DataFrame, batch: str) -> DataFrame:
    """One row per fingerprint from a full table and the deltas of later batches: hits add up,
    the first batch keeps snippet and vector, a name or an approval stays."""
    def first(name: str) -> Column:
        return F.min_by(name, batch).alias(name)

    return rows.groupBy("fingerprint_id").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("hit_count").alias("hit_count"),
        first("representative_snippet"),
        first("vector"),
        F.max_by("campaign_name", F.when(F.col("campaign_name").isNotNull(), F.col(batch))).alias("campaign_name"),
        F.bool_or("approved").alias("approved"),
    )


def session_links(assigned: DataFrame) -> DataFrame:
    """Which sessions a fingerprint was seen in, and since when."""
    return assigned.groupBy("fingerprint_id", "session_id").agg(F.min("ts").alias("first_seen"))


def list_fingerprints(fingerprints: DataFrame) -> DataFrame:
    return fingerprints.orderBy(F.desc("hit_count"), "fingerprint_id")


def campaigns(fingerprints: DataFrame, links: DataFrame) -> DataFrame:
    """Rollup by campaign name; an unnamed fingerprint is its own group."""
    key = F.coalesce(F.nullif("campaign_name", F.lit("")), F.col("fingerprint_id"))
    keyed = fingerprints.withColumn("campaign", key)
    lead = F.min_by("representative_snippet", F.struct(-F.col("hit_count"), F.col("fingerprint_id")))
    rolled = keyed.groupBy("campaign").agg(
        F.bool_or(F.coalesce(F.col("campaign_name") != "", F.lit(False))).alias("named"),
        F.count(F.lit(1)).alias("fingerprints"),
        F.sum("hit_count").alias("total_hits"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        lead.alias("top_snippet"),
    )
    sessions = campaign_sessions(keyed, links).groupBy("campaign").agg(
        F.count(F.lit(1)).alias("session_count")
    )
    return rolled.join(sessions, "campaign", "left").withColumn(
        "session_count", F.coalesce("session_count", F.lit(0))
    )


def campaign_sessions(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """Sessions of every campaign with the time of the first sighting."""
    return (
        links.join(keyed.select("fingerprint_id", "campaign"), "fingerprint_id")
        .groupBy("campaign", "session_id")
        .agg(F.min(links["first_seen"]).alias("first_seen"))
    )


def label_campaigns(fingerprints: DataFrame, labels: DataFrame) -> DataFrame:
    """Set names by exact fingerprint_id; '' clears a name, other rows keep theirs."""
    new = labels.select("fingerprint_id", F.col("name").alias("_name"))
    chosen = F.when(F.col("_name").isNotNull(), F.nullif("_name", F.lit(""))).otherwise(
        F.col("campaign_name")
    )
    return (
        fingerprints.join(new, "fingerprint_id", "left")
        .withColumn("campaign_name", chosen)
        .drop("_name")
    )


def resolve_prefixes(fingerprints: DataFrame, labels: DataFrame) -> DataFrame:
    """Turn id prefixes of any length into ids: the match with most hits.

    Every id offers its head for each length that a label has (at most 64 of them), and the best
    id per head is found before the join, so no pairs of unrelated ids arise. Prefixes without
    a match come out of ``unresolved_prefixes``.
    """
    lengths = labels.select(F.length("prefix").alias("_n")).filter("_n > 0").distinct()
    lengths = [row["_n"] for row in lengths.filter(F.col("_n") <= ID_LENGTH).collect()]
    if not lengths:
        return labels.limit(0).select("prefix", "name", F.lit("").alias("fingerprint_id"))
    heads = F.array(*[F.left("fingerprint_id", F.lit(n)) for n in sorted(lengths)])
    first = F.min_by("fingerprint_id", F.struct(-F.col("hit_count"), F.col("fingerprint_id")))
    best = (
        fingerprints.select("fingerprint_id", "hit_count", F.explode(F.array_distinct(heads)).alias("prefix"))
        .groupBy("prefix").agg(first.alias("fingerprint_id"))
    )
    return labels.select("prefix", "name").distinct().join(best, "prefix").select(
        "prefix", "name", "fingerprint_id"
    )


def unresolved_prefixes(fingerprints: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels whose prefix no id starts with (an empty prefix names nothing)."""
    found = resolve_prefixes(fingerprints, labels).select("prefix").distinct()
    return labels.join(found, "prefix", "left_anti").select("prefix", "name")


def mark_false_alarms(
    fingerprints: DataFrame, ids: DataFrame, approved: bool = True
) -> DataFrame:
    marked = ids.select("fingerprint_id").distinct().withColumn("_marked", F.lit(True))
    return (
        fingerprints.join(marked, "fingerprint_id", "left")
        .withColumn(
            "approved",
            F.when(F.col("_marked"), F.lit(approved)).otherwise(F.col("approved")),
        )
        .drop("_marked")
    )


def session_false_alarms(fingerprints: DataFrame, links: DataFrame, sessions: DataFrame) -> DataFrame:
    """Mark every fingerprint seen in one of the sessions."""
    seen = links.join(sessions.select("session_id"), "session_id", "left_semi")
    return mark_false_alarms(fingerprints, seen)


def approved_fingerprints(fingerprints: DataFrame) -> DataFrame:
    return (
        fingerprints.filter("approved")
        .withColumn("representative_snippet", F.left("representative_snippet", F.lit(200)))
        .orderBy(F.desc("last_seen"), "fingerprint_id")
    )


def session_matches(fingerprints: DataFrame, links: DataFrame) -> DataFrame:
    """One row per (session, fingerprint seen in it)."""
    counts = links.groupBy("fingerprint_id").agg(F.count(F.lit(1)).alias("session_count"))
    shown = fingerprints.join(counts, "fingerprint_id").select(
        "fingerprint_id",
        "hit_count",
        "campaign_name",
        F.left("representative_snippet", F.lit(200)).alias("representative_snippet"),
        "first_seen",
        "last_seen",
        "session_count",
    )
    return links.select("session_id", "fingerprint_id").join(shown, "fingerprint_id")


def fingerprint_groups(fingerprints: DataFrame, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """fingerprint_id, root_id: transitive closure of cosine >= similarity.

    The root is the member with most hits, the smallest id among equals.
    """
    vectors = durable(
        fingerprints.select(F.col("fingerprint_id").alias("id"), "vector", "hit_count")
    )
    links = similar_links(vectors, cfg.similarity)
    members = connected_components(vectors, links).join(vectors.select("id", "hit_count"), "id")
    roots = members.groupBy("component").agg(
        F.min_by("id", F.struct(-F.col("hit_count"), F.col("id"))).alias("root_id")
    )
    return members.join(roots, "component").select(F.col("id").alias("fingerprint_id"), "root_id")


def deduplicate(
    fingerprints: DataFrame, links: DataFrame, cfg: ScanConfig = ScanConfig()
) -> tuple[DataFrame, DataFrame]:
    """(merged fingerprints, merged session links); the root keeps snippet, vector, name."""
    groups = fingerprint_groups(fingerprints, cfg)
    sums = (
        fingerprints.join(groups, "fingerprint_id")
        .groupBy("root_id")
        .agg(
            F.sum("hit_count").alias("hit_count"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
        )
        .withColumnRenamed("root_id", "fingerprint_id")
    )
    kept = fingerprints.drop("hit_count", "first_seen", "last_seen").join(sums, "fingerprint_id")
    merged_links = (
        links.join(groups, "fingerprint_id")
        .groupBy(F.col("root_id").alias("fingerprint_id"), "session_id")
        .agg(F.min("first_seen").alias("first_seen"))
    )
    return kept.select(*fingerprints.columns), merged_links
