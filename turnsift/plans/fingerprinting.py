"""Registered queries over fingerprints, campaigns and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnsift.config import ScanConfig
from turnsift.functions import grams
from turnsift.operators import detect, drift, fingerprints as fp
from turnsift.operators.components import connected_components
from turnsift.operators.durable import durable
from turnsift.operators.vectors import similar_links
from turnsift.plans import overlay, sql as Q
from turnsift.plans.detection import signals


def vectors_sql(source: str, key: str, text: str, name: str) -> str:
    """CTE ``<name>(key, bucket, w)``: unit gram vectors of a column, non-zero entries."""
    code = "CAST(unicode(substr(t, i + {0}, 1)) AS BIGINT)"
    one, two, three = (code.format(k) for k in range(3))
    step, mask = grams.STEP, grams.MASK + 1
    pair = f"({one} * {step} + {two})"
    triple = f"({pair} * {step} + {three})"
    bucket = f"((({{}} % {mask}) * {grams.SPREAD}) % {mask}) // 16777216"
    return f"""{name}_at AS (SELECT {key}, t, unnest(range(1, length(t))) AS i
  FROM (SELECT {key}, ' ' || lower({text}) || ' ' AS t FROM {source})),
{name}_n AS (SELECT {key}, bucket, count(*) AS cnt FROM (
    SELECT {key}, {bucket.format(f'CAST({pair} AS BIGINT)')} AS bucket FROM {name}_at
    UNION ALL SELECT {key}, {bucket.format(f'CAST({triple} AS BIGINT)')} FROM {name}_at
    WHERE i + 2 <= length(t)) GROUP BY ALL),
{name} AS (SELECT {key}, bucket, cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY {key})) AS w FROM {name}_n)"""


def raised(spark, sf_dir) -> DataFrame:
    """Signals of the planted conversations with an id and an arrival time."""
    return arrived(durable(signals(spark, sf_dir)))


def arrived(found: DataFrame) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    seconds = F.col("session_id").cast("long") * 3600 + F.col("turn_index") * 60
    return found.select(
        F.concat_ws(":", "session_id", F.col("turn_index").cast("string"), "stage").alias("signal_id"),
        "session_id",
        F.timestamp_seconds(F.unix_seconds(start) + seconds).alias("ts"),
        "score",
        "evidence_snippet",
    )


RAISED = f"""{Q.ALL_SIGNALS},
raised AS (SELECT session_id || ':' || turn_index || ':' || stage AS signal_id, session_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(session_id AS BIGINT) * 3600 + turn_index * 60)
    AS ts, score, ev FROM sig)"""

# Leader clustering in arrival order, one snippet per recursion step.
ASSIGNED = f"""{RAISED},
snip AS (SELECT row_number() OVER (ORDER BY first) AS n, ev, first FROM
  (SELECT ev, min((ts, signal_id)) AS first FROM raised GROUP BY ev)),
{vectors_sql('snip', 'n', 'ev', 'vec')},
sim AS (SELECT a.n AS a, b.n AS b, sum(a.w * b.w) AS cos FROM vec a JOIN vec b USING (bucket)
  GROUP BY ALL HAVING sum(a.w * b.w) >= 0.70),
near AS (SELECT s.n, coalesce(list(m.b) FILTER (m.b < s.n), []) AS nb
  FROM snip s LEFT JOIN sim m ON m.a = s.n GROUP BY s.n),
lead(n, leaders) AS (SELECT CAST(0 AS BIGINT), []::BIGINT[]
  UNION ALL SELECT l.n + 1, CASE WHEN len(list_intersect(l.leaders, s.nb)) = 0
    THEN list_append(l.leaders, s.n) ELSE l.leaders END
  FROM lead l JOIN near s ON s.n = l.n + 1),
leaders AS (SELECT unnest(leaders) AS n FROM (SELECT leaders FROM lead ORDER BY n DESC LIMIT 1)),
founders AS (SELECT n, first, ev AS snippet, sha256('1' || lpad(CAST(epoch_us(first[1]) +
    100000000000000000 AS VARCHAR), 20, '0') || first[2]) AS fingerprint_id
  FROM leaders JOIN snip USING (n)),
cand AS (SELECT r.signal_id, r.session_id, r.ts, r.ev, f.fingerprint_id, m.cos,
    f.first < (r.ts, r.signal_id) AS earlier, f.snippet,
    row_number() OVER (PARTITION BY r.signal_id
      ORDER BY f.first < (r.ts, r.signal_id) DESC, m.cos DESC, f.first) AS rn
  FROM raised r JOIN snip s ON s.ev = r.ev JOIN sim m ON m.a = s.n JOIN founders f ON f.n = m.b
  WHERE f.first <= (r.ts, r.signal_id)),
assigned AS (SELECT signal_id, session_id, ts, ev, fingerprint_id, snippet, earlier AS matched,
  CASE WHEN earlier THEN cos END AS match_cos FROM cand WHERE rn = 1)"""


def gram_embedding(spark, sf_dir):
    """Non-zero entries of the gram vector of every benchmark text."""
    bench = overlay.table(spark, sf_dir, "benchmark")
    vectors = bench.select("item_id", F.posexplode(grams.gram_embedding("text")).alias("bucket", "w"))
    return vectors.filter("w > 0").select("item_id", "bucket", F.round("w", 9).alias("w"))


GRAM_SQL = f"""WITH {vectors_sql('benchmark', 'item_id', 'text', 'vec')}
SELECT item_id, CAST(bucket AS INTEGER) AS bucket, round(w, 9) AS w FROM vec"""


def assigned(spark, sf_dir) -> DataFrame:
    return fp.assign_fingerprints(raised(spark, sf_dir))


def campaign_assignment(spark, sf_dir):
    """Fingerprint of every signal in arrival order, with the running hit count."""
    matched = fp.with_campaign_match(assigned(spark, sf_dir))
    return matched.select(
        "signal_id", "fingerprint_id", "matched", F.round("match_cos", 6).alias("match_cos"),
        F.col("campaign_match.hit_count").alias("hit_count"),
    )


ASSIGNMENT_SQL = f"""WITH RECURSIVE {ASSIGNED}
SELECT signal_id, fingerprint_id, matched, round(match_cos, 6) AS match_cos,
  CASE WHEN matched THEN row_number() OVER (PARTITION BY fingerprint_id ORDER BY ts, signal_id) END
    AS hit_count FROM assigned"""


def campaign_assignment_lsh(spark, sf_dir):
    """The same assignment with every coverage check through hash tables, from short heads."""
    found = fp.assign_fingerprints(raised(spark, sf_dir), head_rows=256, lsh_above=0)
    return found.select("signal_id", "fingerprint_id", "matched", F.round("match_cos", 6).alias("match_cos"))


ASSIGNMENT_LSH_SQL = f"""WITH RECURSIVE {ASSIGNED}
SELECT signal_id, fingerprint_id, matched, round(match_cos, 6) AS match_cos FROM assigned"""


def false_alarm_gate_lsh(spark, sf_dir):
    """The false-alarm gate with approved snippets in hash tables."""
    approved = durable(document_snippets(spark, sf_dir).filter("approved"))
    scanned = detect.with_scan(overlay.documents(spark, sf_dir), "text").filter("score >= 0.25")
    kept = detect.drop_false_alarms(scanned, "text", approved, lsh_above=0)
    return overlay.with_labels(kept.select("doc_id", "score"), spark, sf_dir).drop("labelled")


def fingerprint_list(spark, sf_dir):
    made = fp.new_fingerprints(assigned(spark, sf_dir))
    return fp.list_fingerprints(made).select(
        "fingerprint_id", "hit_count", "first_seen", "last_seen", "representative_snippet"
    )


FINGERPRINTS = """prints AS (SELECT fingerprint_id, count(*) AS hit_count, min(ts) AS first_seen,
  max(ts) AS last_seen, any_value(snippet) AS representative_snippet FROM assigned GROUP BY 1)"""
LIST_SQL = f"""WITH RECURSIVE {ASSIGNED},
{FINGERPRINTS}
SELECT * FROM prints ORDER BY hit_count DESC, fingerprint_id"""


def session_fingerprints(spark, sf_dir):
    """Sessions every fingerprint was seen in."""
    return fp.session_links(assigned(spark, sf_dir))


LINKS_SQL = f"""WITH RECURSIVE {ASSIGNED}
SELECT fingerprint_id, session_id, min(ts) AS first_seen FROM assigned GROUP BY ALL"""


def campaign_prefixes(spark, sf_dir):
    """Fingerprint ids found from their first eight characters."""
    prints = fp.new_fingerprints(assigned(spark, sf_dir))
    labels = prints.select(
        F.left("fingerprint_id", F.lit(8)).alias("prefix"),
        F.concat(F.lit("campaign of "), F.col("hit_count").cast("string")).alias("name"),
    )
    return fp.resolve_prefixes(prints, labels)


PREFIX_SQL = f"""WITH RECURSIVE {ASSIGNED},
{FINGERPRINTS}
SELECT left(fingerprint_id, 8) AS prefix, 'campaign of ' || hit_count AS name, fingerprint_id FROM prints"""


def _labelled(spark, sf_dir):
    """Fingerprints named after the first word of their snippet when they have many hits."""
    found = durable(assigned(spark, sf_dir))
    made = fp.new_fingerprints(found)
    labels = made.filter("hit_count >= 5").select(
        "fingerprint_id", F.left("representative_snippet", F.lit(1)).alias("name")
    )
    return fp.label_campaigns(made, labels), fp.session_links(found)


def campaigns(spark, sf_dir):
    return fp.campaigns(*_labelled(spark, sf_dir))


CAMPAIGNS_SQL = f"""WITH RECURSIVE {ASSIGNED},
{FINGERPRINTS},
named AS (SELECT *, CASE WHEN hit_count >= 5 THEN nullif(left(representative_snippet, 1), '') END
  AS campaign_name FROM prints),
keyed AS (SELECT *, coalesce(campaign_name, fingerprint_id) AS campaign FROM named),
sess AS (SELECT campaign, count(DISTINCT session_id) AS session_count
  FROM keyed JOIN assigned USING (fingerprint_id) GROUP BY 1)
SELECT campaign, bool_or(campaign_name IS NOT NULL) AS named, count(*) AS fingerprints,
  CAST(sum(hit_count) AS BIGINT) AS total_hits, min(first_seen) AS first_seen,
  max(last_seen) AS last_seen,
  arg_min(representative_snippet, (-hit_count, fingerprint_id)) AS top_snippet,
  any_value(session_count) AS session_count
FROM keyed JOIN sess USING (campaign) GROUP BY campaign"""


def session_matches(spark, sf_dir):
    prints, links = _labelled(spark, sf_dir)
    return fp.session_matches(prints, links)


MATCHES_SQL = f"""WITH RECURSIVE {ASSIGNED},
{FINGERPRINTS},
links AS (SELECT DISTINCT fingerprint_id, session_id FROM assigned),
n AS (SELECT fingerprint_id, count(*) AS session_count FROM links GROUP BY 1)
SELECT session_id, fingerprint_id, hit_count,
  CASE WHEN hit_count >= 5 THEN nullif(left(representative_snippet, 1), '') END AS campaign_name,
  left(representative_snippet, 200) AS representative_snippet, first_seen, last_seen, session_count
FROM links JOIN prints USING (fingerprint_id) JOIN n USING (fingerprint_id)"""


def false_alarm_marks(spark, sf_dir):
    """Approved fingerprints after marking those seen in sessions with a signal of 0.65 or more."""
    found = durable(assigned(spark, sf_dir))
    prints, links = fp.new_fingerprints(found), fp.session_links(found)
    strong = found.filter("score >= 0.65").select("session_id").distinct()
    marked = fp.session_false_alarms(prints, links, strong)
    return fp.approved_fingerprints(marked).select(
        "fingerprint_id", "first_seen", "last_seen", "hit_count", "representative_snippet"
    )


MARKS_SQL = f"""WITH RECURSIVE {ASSIGNED},
{FINGERPRINTS}
SELECT fingerprint_id, first_seen, last_seen, hit_count,
  left(representative_snippet, 200) AS representative_snippet FROM prints
WHERE fingerprint_id IN (SELECT fingerprint_id FROM assigned WHERE session_id IN
  (SELECT session_id FROM raised WHERE score >= 0.65))"""


def document_snippets(spark, sf_dir) -> DataFrame:
    """Fingerprints table with one row per distinct evidence text of the document scan."""
    scanned = detect.text_scan(overlay.documents(spark, sf_dir), "text").filter("score >= 0.25")
    scanned = overlay.with_labels(scanned.select("doc_id", "evidence_snippet"), spark, sf_dir)
    day = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60)
    grouped = scanned.withColumn("ts", day).groupBy("evidence_snippet").agg(
        F.min("doc_id").alias("doc_id"),
        F.count(F.lit(1)).alias("hit_count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.min("label").alias("label"),
    )
    return grouped.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("fingerprint_id"),
        "first_seen", "last_seen", "hit_count",
        F.col("evidence_snippet").alias("representative_snippet"),
        grams.gram_embedding("evidence_snippet").alias("vector"),
        F.lit(None).cast("string").alias("campaign_name"),
        (F.col("label") == 0).alias("approved"),
    )


DOC_SNIPPETS = f"""{Q.with_rules('docs', 'text', 'druled')},
dhit AS (SELECT doc_id, label, text, {Q.evidence('text')} AS ev, {Q.ADDITIVE} AS score,
  {Q.AVERAGED} AS avg_score FROM druled WHERE {Q.ADDITIVE} >= 0.25),
dsnip AS (SELECT 'd' || min(doc_id) AS id, ev, count(*) AS hit_count,
    TIMESTAMP '2024-01-01' + to_minutes(min(doc_id)) AS first_seen,
    TIMESTAMP '2024-01-01' + to_minutes(max(doc_id)) AS last_seen, min(label) = 0 AS approved
  FROM dhit GROUP BY ev)"""


def nearest_fingerprint(spark, sf_dir):
    """Conversation signals against the fingerprints of the document scan."""
    stored = durable(document_snippets(spark, sf_dir))
    near = fp.nearest_fingerprints(raised(spark, sf_dir), stored)
    return near.select(
        "signal_id", "nearest_id", F.round("nearest_cos", 6).alias("nearest_cos")
    )


NEAREST_SQL = f"""WITH {RAISED},
docs AS ({overlay.DOCUMENTS_SQL_BODY}),
{DOC_SNIPPETS},
{vectors_sql('dsnip', 'id', 'ev', 'dvec')},
{vectors_sql('raised', 'signal_id', 'ev', 'rvec')},
sim AS (SELECT signal_id, id, round(sum(r.w * d.w), 12) AS cos FROM rvec r JOIN dvec d USING (bucket)
  GROUP BY ALL HAVING sum(r.w * d.w) >= 0.70),
best AS (SELECT signal_id, id, cos, row_number() OVER (PARTITION BY signal_id
  ORDER BY cos DESC, hit_count DESC, id) AS rn FROM sim JOIN dsnip USING (id))
SELECT r.signal_id, b.id AS nearest_id, round(b.cos, 6) AS nearest_cos
FROM raised r LEFT JOIN best b ON b.signal_id = r.signal_id AND b.rn = 1"""


def false_alarm_gate(spark, sf_dir):
    """Documents still flagged after approving every snippet of an unlabelled or harmless one."""
    approved = durable(document_snippets(spark, sf_dir).filter("approved"))
    scanned = detect.with_scan(overlay.documents(spark, sf_dir), "text").filter("score >= 0.25")
    kept = detect.drop_false_alarms(scanned, "text", approved)
    return overlay.with_labels(kept.select("doc_id", "score"), spark, sf_dir).drop("labelled")


GATE_SQL = f"""WITH {Q.DOCS},
{DOC_SNIPPETS},
flagged AS (SELECT * FROM dhit WHERE avg_score >= 0.25),
band AS (SELECT * FROM flagged WHERE avg_score < 0.70),
ok AS (SELECT * FROM dsnip WHERE approved),
{vectors_sql('ok', 'id', 'ev', 'ovec')},
{vectors_sql('band', 'doc_id', 'text', 'bvec')},
alike AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, id FROM bvec b JOIN ovec o USING (bucket)
  GROUP BY ALL HAVING sum(b.w * o.w) >= 0.70))
SELECT doc_id, avg_score AS score, label FROM flagged
WHERE doc_id NOT IN (SELECT doc_id FROM alike)"""


def fingerprint_dedupe(spark, sf_dir):
    """Document fingerprints merged by the transitive closure of cosine >= 0.70."""
    stored = durable(document_snippets(spark, sf_dir))
    links = stored.select(
        "fingerprint_id", F.col("fingerprint_id").alias("session_id"), "first_seen"
    )
    merged, _ = fp.deduplicate(stored, links)
    return merged.select(
        "fingerprint_id", "hit_count", "first_seen", "last_seen", "representative_snippet", "approved"
    )


DEDUPE_SQL = f"""WITH RECURSIVE {Q.DOCS},
{DOC_SNIPPETS},
{vectors_sql('dsnip', 'id', 'ev', 'dvec')},
edge AS (SELECT a.id AS a, b.id AS b FROM dvec a JOIN dvec b USING (bucket)
  GROUP BY a.id, b.id HAVING sum(a.w * b.w) >= 0.70 OR a.id = b.id),
reach(a, b) AS (SELECT a, b FROM edge
  UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
ranked AS (SELECT r.a, r.b AS root, row_number() OVER (PARTITION BY r.a
  ORDER BY s.hit_count DESC, s.id) AS rn FROM reach r JOIN dsnip s ON s.id = r.b),
roots AS (SELECT a AS id, root FROM ranked WHERE rn = 1)
SELECT r.root AS fingerprint_id, CAST(sum(s.hit_count) AS BIGINT) AS hit_count,
  min(s.first_seen) AS first_seen, max(s.last_seen) AS last_seen,
  any_value(t.ev) AS representative_snippet, any_value(t.approved) AS approved
FROM roots r JOIN dsnip s ON s.id = r.id JOIN dsnip t ON t.id = r.root GROUP BY r.root"""


def embedding_components(spark, sf_dir):
    """Components of the embeddings table under cosine >= 0.40."""
    vectors = overlay.table(spark, sf_dir, "embeddings").select(
        F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
    )
    found = connected_components(vectors, similar_links(vectors, 0.40))
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("members"))


EMBEDDING_SQL = """WITH RECURSIVE v AS (SELECT lpad(CAST(vec_id AS VARCHAR), 9, '0') AS id,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
edge AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b
  ON a.id = b.id OR list_dot_product(a.e, b.e) >= 0.40),
reach(a, b) AS (SELECT a, b FROM edge
  UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
comp AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT component, count(*) AS members FROM comp GROUP BY component"""


def question_answers(spark, sf_dir) -> DataFrame:
    """Every user turn with the turn after it."""
    conv = overlay.conversations(spark, sf_dir).select("session_id", "turn_index", "role", "content")
    asked = conv.filter("role = 'user'").select(
        "session_id", F.col("turn_index"), F.col("content").alias("question")
    )
    answers = conv.filter("role <> 'user'").select(
        "session_id", (F.col("turn_index") - 1).alias("turn_index"), F.col("content").alias("response")
    )
    return asked.join(answers, ["session_id", "turn_index"])


def drift_scores(spark, sf_dir):
    """Similarity of every question and answer, and the drift score."""
    pairs = question_answers(spark, sf_dir)
    scored = drift.with_drift(pairs, "question", "response", ScanConfig(drift_floor=0.6))
    return scored.select(
        "session_id", "turn_index", F.round("similarity", 6).alias("similarity"),
        F.round("drift_score", 3).alias("drift_score"),
    )


DRIFT_SQL = f"""WITH {Q.CONV},
pairs AS (SELECT a.session_id || ':' || a.turn_index AS k, a.session_id, a.turn_index,
    a.content AS question, b.content AS response
  FROM conv a JOIN conv b ON a.session_id = b.session_id AND b.turn_index = a.turn_index + 1
  WHERE a.role = 'user' AND b.role <> 'user'),
{vectors_sql('pairs', 'k', 'question', 'qv')},
{vectors_sql('pairs', 'k', 'response', 'rv')},
s AS (SELECT k, sum(q.w * r.w) AS cos FROM qv q JOIN rv r USING (k, bucket) GROUP BY k)
SELECT session_id, turn_index, round(coalesce(cos, 0), 6) AS similarity,
  round(CASE WHEN coalesce(cos, 0) >= 0.6 THEN 0
    ELSE round(0.5 * (1 - coalesce(cos, 0) / 0.6), 4) END, 3) AS drift_score
FROM pairs LEFT JOIN s USING (k)"""


def drift_signals(spark, sf_dir):
    """Signals of answers that stray from their question, with a high floor."""
    cfg = ScanConfig(drift_floor=0.8, threshold=0.05)
    found = drift.drift_signals(question_answers(spark, sf_dir), cfg)
    return found.select(
        "session_id", "turn_index", "stage", F.round("score", 3).alias("score"),
        F.array_join("matched_heuristics", ",").alias("rules"), "source",
    )


DRIFT_SIGNALS_SQL = f"""{DRIFT_SQL[:DRIFT_SQL.rindex('SELECT session_id')]}
SELECT session_id, turn_index, 'drift' AS stage,
  round(round(0.5 * (1 - coalesce(cos, 0) / 0.8), 4), 3) AS score, 'SEM01' AS rules,
  CAST(NULL AS VARCHAR) AS source
FROM pairs LEFT JOIN s USING (k)
WHERE coalesce(cos, 0) < 0.8 AND round(0.5 * (1 - coalesce(cos, 0) / 0.8), 4) >= 0.05"""


QUERIES = {
    "gram_embedding": (gram_embedding, GRAM_SQL),
    "campaign_assignment": (campaign_assignment, ASSIGNMENT_SQL),
    "campaign_assignment_lsh": (campaign_assignment_lsh, ASSIGNMENT_LSH_SQL),
    "fingerprint_list": (fingerprint_list, LIST_SQL),
    "session_fingerprints": (session_fingerprints, LINKS_SQL),
    "campaigns": (campaigns, CAMPAIGNS_SQL),
    "campaign_prefixes": (campaign_prefixes, PREFIX_SQL),
    "session_matches": (session_matches, MATCHES_SQL),
    "false_alarm_marks": (false_alarm_marks, MARKS_SQL),
    "nearest_fingerprint": (nearest_fingerprint, NEAREST_SQL),
    "false_alarm_gate": (false_alarm_gate, GATE_SQL),
    "false_alarm_gate_lsh": (false_alarm_gate_lsh, GATE_SQL),
    "fingerprint_dedupe": (fingerprint_dedupe, DEDUPE_SQL),
    "embedding_components": (embedding_components, EMBEDDING_SQL),
    "drift_scores": (drift_scores, DRIFT_SQL),
    "drift_signals": (drift_signals, DRIFT_SIGNALS_SQL),
}
