"""Registered queries that evaluate the detector, load corpora and train the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnsift.functions import scoring
from turnsift.operators import detect, evaluate, model, naive_bayes
from turnsift.plans import overlay, sql as Q
from turnsift.sources import tables


def scored_documents(spark, sf_dir) -> DataFrame:
    """Scan of the document corpus; scenario is the language, attack the source."""
    docs = tables.load_payloads(overlay.documents(spark, sf_dir), "doc_id", "text")
    scored = detect.text_scan(docs, "text").select(
        "doc_id", F.left("text", F.lit(200)).alias("text"), "score", "matched_heuristics",
        F.col("lang").alias("scenario"), F.col("source").alias("attack_name"),
    )
    return overlay.with_labels(scored, spark, sf_dir).drop("labelled")


SCORED = f"""{Q.DOCS},
trimmed AS (SELECT * REPLACE ({Q.strip('text')} AS text) FROM docs),
ok AS (SELECT * FROM trimmed WHERE text <> ''),
{Q.with_rules('ok', 'text', 'ruled')},
scored AS (SELECT doc_id, text, label, rules, {Q.ADDITIVE} AS score, lang AS scenario,
  source AS attack_name FROM ruled)"""


def detection_counts(spark, sf_dir):
    """Detected and missed among the documents that carry an attack."""
    return evaluate.detection_counts(scored_documents(spark, sf_dir).filter("label = 1"))


COUNTS_SQL = f"""WITH {SCORED},
p AS (SELECT * FROM scored WHERE label = 1)
SELECT count(*) AS tested, count(*) FILTER (score >= 0.25) AS detected,
  count(*) FILTER (score < 0.25) AS missed,
  round(count(*) FILTER (score >= 0.25) / count(*), 4) AS detection_rate FROM p"""


def detection_by_group(spark, sf_dir):
    payloads = scored_documents(spark, sf_dir).filter("label = 1")
    return evaluate.detection_by_group(payloads, "scenario", "attack_name")


BY_GROUP_SQL = f"""WITH {SCORED},
p AS (SELECT * FROM scored WHERE label = 1),
u AS (SELECT 'total' AS dimension, 'all' AS value, score FROM p
  UNION ALL SELECT 'scenario', scenario, score FROM p
  UNION ALL SELECT 'attack_name', attack_name, score FROM p)
SELECT dimension, value, count(*) AS total, count(*) FILTER (score >= 0.25) AS detected,
  round(count(*) FILTER (score >= 0.25) / count(*), 4) AS rate FROM u GROUP BY ALL"""


def rule_frequency(spark, sf_dir):
    """The fifteen rules with most hits over all documents."""
    return evaluate.top_rules(scored_documents(spark, sf_dir), 15)


FREQUENCY_SQL = f"""WITH {SCORED},
each AS (SELECT unnest(string_split(rules, ',')) AS rule_id FROM scored WHERE rules <> '')
SELECT rule_id, count(*) AS hits FROM each GROUP BY 1 ORDER BY hits DESC, rule_id LIMIT 15"""


def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(scored_documents(spark, sf_dir))


CONFUSION_SQL = f"""WITH {SCORED},
c AS (SELECT count(*) FILTER (label = 1 AND score >= 0.25) AS tp,
  count(*) FILTER (label = 1 AND score < 0.25) AS fn,
  count(*) FILTER (label = 0 AND score >= 0.25) AS fp,
  count(*) FILTER (label = 0 AND score < 0.25) AS tn FROM scored),
r AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS rec, coalesce(tp / nullif(tp + fp, 0), 0)
  AS prec, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM c)
SELECT tp, fn, fp, tn, round(rec, 4) AS detection_rate, round(fpr, 4) AS fp_rate,
  round(prec, 4) AS precision, round(rec, 4) AS recall,
  round(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0), 4) AS f1 FROM r"""


def missed_examples(spark, sf_dir):
    return evaluate.example_errors(scored_documents(spark, sf_dir), "doc_id", "text")


MISSED_SQL = f"""WITH {SCORED},
k AS (SELECT CASE WHEN label = 1 AND score < 0.25 THEN 'missed'
  WHEN label = 0 AND score >= 0.25 THEN 'false_positive' END AS kind, doc_id,
  left(text, 200) AS text, round(score, 4) AS score FROM scored),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS INTEGER) AS nth
  FROM k WHERE kind IS NOT NULL)
SELECT * FROM r WHERE nth <= 5"""


def class_counts(spark, sf_dir):
    """Size and classes of the labelled corpus."""
    docs = overlay.documents(spark, sf_dir).select("doc_id")
    return tables.class_counts(overlay.with_labels(docs, spark, sf_dir).filter("labelled"))


CLASS_SQL = f"""WITH {Q.DOCS}
SELECT count(*) AS total, count(*) FILTER (label = 1) AS injections,
  count(*) FILTER (label = 0) AS benign FROM docs WHERE labelled"""


def payload_corpus(spark, sf_dir):
    """The payload corpus after trimming, without blank texts."""
    loaded = tables.load_payloads(overlay.documents(spark, sf_dir), "doc_id", "text")
    return loaded.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


CORPUS_SQL = f"""WITH {Q.DOCS},
t AS (SELECT doc_id, {Q.strip('text')} AS text FROM docs)
SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, md5(text) AS digest FROM t WHERE text <> ''"""


def ml_scores(spark, sf_dir):
    """Model-weighted text check of every document with a model trained on the labels."""
    docs = overlay.documents(spark, sf_dir)
    labelled = overlay.with_labels(docs.select("doc_id", "text"), spark, sf_dir).filter("labelled")
    trained = model.train(labelled, "text", "label")
    checked = detect.text_check(docs, "text", scorer=model.scorer(trained)).select(
        "doc_id", "score", "ml_score", "verdict",
        scoring.additive(F.col("h_points"), F.col("ib_points"), F.col("ml_score")).alias(
            "additive_score"
        ),
    )
    return overlay.with_labels(checked, spark, sf_dir).drop("labelled")


def nb_scores(spark, sf_dir):
    """Probability of every document under word counts of the labelled ones, and the score with it."""
    docs = overlay.documents(spark, sf_dir)
    labelled = overlay.with_labels(docs.select("doc_id", "text"), spark, sf_dir).filter("labelled")
    weights = naive_bayes.train(labelled, "text", "label")
    scanned = detect.with_scan(docs.select("doc_id", "text"), "text", scorer=naive_bayes.scorer(weights, "doc_id", docs))
    return scanned.select("doc_id", F.round("ml_score", 6).alias("ml_score"), "score")


NB_SQL = f"""WITH {Q.DOCS},
{Q.with_rules('docs', 'text', 'ruled')},
w AS (SELECT doc_id, label, labelled, unnest(regexp_extract_all(translate(text,
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS word FROM docs),
c AS (SELECT word, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0
  FROM w WHERE labelled GROUP BY word),
t AS (SELECT count(*) AS v, sum(n1) AS t1, sum(n0) AS t0 FROM c),
p AS (SELECT ln(count(*) FILTER (label = 1) / count(*) FILTER (label = 0)) AS prior FROM docs WHERE labelled),
weight AS (SELECT word, ln((n1 + 1) / (t1 + v)) - ln((n0 + 1) / (t0 + v)) AS weight FROM c, t),
odds AS (SELECT doc_id, sum(weight) AS odds FROM w JOIN weight USING (word) GROUP BY doc_id),
ml AS (SELECT doc_id, hp, ibp, 0.5 * (1 + tanh((prior + coalesce(odds, 0)) / 2)) AS ml
  FROM ruled LEFT JOIN odds USING (doc_id), p)
SELECT doc_id, round(ml, 6) AS ml_score, round((hp + ibp) * 0.003 + ml * 0.4, 4) AS score FROM ml"""


QUERIES = {
    "nb_scores": (nb_scores, NB_SQL),
    "detection_counts": (detection_counts, COUNTS_SQL),
    "detection_by_group": (detection_by_group, BY_GROUP_SQL),
    "rule_frequency": (rule_frequency, FREQUENCY_SQL),
    "confusion_matrix": (confusion_matrix, CONFUSION_SQL),
    "missed_examples": (missed_examples, MISSED_SQL),
    "class_counts": (class_counts, CLASS_SQL),
    "payload_corpus": (payload_corpus, CORPUS_SQL),
    "ml_scores": (ml_scores, None),
}
