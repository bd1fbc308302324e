"""Registered queries of the prompt rules and the evaluation layer, over the driver's tables.

The tables hold no cue words, so turns of ``conversations`` get deterministic phrases by one SQL text that both engines run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import lexicon as L
from tessera.functions import text as T
from tessera.operators import antecedents, bpe, conflicts, labels, linediff, nearest, placeholders, reference, schema, semantic, tokens
from tessera.options import Options
from tessera.plans import evaluate, report
from tessera.session import table

INJECTED = """concat(text, CASE (conv_id * 3 + turn) % 13
 WHEN 0 THEN ' Dear {{customer.name}}, order {{ order_id }} for {{customer.name}}.'
 WHEN 1 THEN ' {{#if vip}}{{else}}{{/if}} Summarize the report.'
 WHEN 2 THEN ' <% user %> <%= x %> Please be concise and brief.'
 WHEN 3 THEN ' Give a detailed step by step answer. Continue as discussed above.'
 WHEN 4 THEN ' Return valid JSON only. Add commentary after the JSON.'
 WHEN 5 THEN ' I attached a document and a table. Review the following report.'
 WHEN 6 THEN ' Compare the reports with these files as shown below.'
 WHEN 7 THEN ' The output must be json only, then explain this table.'
 WHEN 8 THEN ' See the following data and check the list below.'
 WHEN 9 THEN ' Output JSON and then notes. The conversation continues previously.'
 WHEN 10 THEN ' Use the dataset; that dataset has stories, boxes and classes.'
 ELSE '' END)"""
MODEL = "CASE conv_id % 4 WHEN 0 THEN 'gpt-4' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'gpt-3.5-turbo' ELSE 'other-model' END"
SCHEMA = """CASE conv_id % 5 WHEN 0 THEN '{"properties":{"a":{"type":"string"}}}' WHEN 1 THEN '{"type":"objekt"}'
 WHEN 2 THEN '{"type":"object","properties":{"a":{"type":"strng"},"b":{"type":"number"},"c":{"type":"bool"}}}' WHEN 3 THEN '{"items":{"type":"string"}}' ELSE NULL END"""
EXPECTED = "CASE conv_id % 3 WHEN 0 THEN 'MISSING_PLACEHOLDER' WHEN 1 THEN 'MISSING_REFERENCE' ELSE 'SCHEMA_RISK' END"


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").selectExpr("conv_id", "turn", "role", f"{INJECTED} AS text")


def cases(spark: SparkSession, d: str) -> DataFrame:
    per = turns(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return per.selectExpr(
        "cast(conv_id AS string) AS case_id", "conv_id", "cast(null AS string) AS prompt", "transform(m, x -> struct(x.role AS role, x.text AS content)) AS messages", f"{MODEL} AS model", f"{SCHEMA} AS schema_json",
        "CASE WHEN conv_id % 4 = 0 THEN array(struct('file' AS type, 'sales_report.pdf' AS name)) ELSE array() END AS attachments",
    )


def texts(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).select("conv_id", T.full_text(F.col("prompt"), F.col("messages")).alias("text"), "model", "schema_json")


def views(spark: SparkSession, d: str) -> DataFrame:
    return reference.views(cases(spark, d)).select(F.col("case_id").cast("long").alias("conv_id"), "cur", "hist", "attached")


def placeholder_scan(s, d):
    return placeholders.scan(turns(s, d)).select("conv_id", "turn", "dialect", "variable", "pos", "end")


def placeholder_summary(s, d):
    return placeholders.summarize(placeholders.scan(turns(s, d)), ["conv_id", "turn"]).select("conv_id", "turn", "variable", "count", "first_pos")


def placeholder_first_seen(s, d):
    return placeholders.scan(texts(s, d)).groupBy("conv_id").agg(F.min("pos").alias("first_char"), F.countDistinct("variable").alias("variables"))


def placeholder_top3(s, d):
    return placeholders.top_positions(placeholders.scan(texts(s, d)), ["conv_id"]).select("conv_id", "variable", "pos", "rank", "place")


def placeholder_issues(s, d):
    return placeholders.rule(cases(s, d)).select("case_id", "code", "severity", "detail", "first_char", F.size("occurrences").cast("long").alias("n_occurrences"))


def ejs_scan(s, d):
    return placeholders.scan(turns(s, d), dialect=F.lit("ejs")).select("conv_id", "turn", "variable", "pos")


def jinja_scan(s, d):
    return placeholders.scan(turns(s, d), dialect=F.lit("jinja")).select("conv_id", "turn", "variable", "pos")


def dialect_detect(s, d):
    return turns(s, d).groupBy(F.coalesce(placeholders.detect_dialect(F.col("text")), F.lit("none")).alias("dialect")).agg(F.count("*").alias("n"))


def full_text_concat(s, d):
    return texts(s, d).select("conv_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def history_window(s, d):
    return views(s, d).select("conv_id", F.length("cur").cast("long").alias("cur_chars"), F.length("hist").cast("long").alias("hist_chars"), F.md5("hist").alias("digest"))


def history_window_k(s, d):
    v = reference.views(cases(s, d), Options(window_messages=2, window_chars=200))
    return v.select(F.col("case_id").cast("long").alias("conv_id"), F.md5("hist").alias("digest"), F.length("hist").cast("long").alias("hist_chars"))


def normalize_phrase(s, d):
    return turns(s, d).select("conv_id", "turn", T.normalize_phrase(F.col("text")).alias("phrase"))


def singularize_heads(s, d):
    w = turns(s, d).select(F.explode(F.split(T.normalize_phrase(F.col("text")), " ")).alias("word")).where("word <> ''")
    return w.groupBy("word", T.singularize(F.col("word")).alias("singular")).agg(F.count("*").alias("n"))


def preview_snippet(s, d):
    f = placeholders.scan(turns(s, d))
    return f.select("conv_id", "turn", "pos", T.preview(F.col("text"), F.col("pos"), F.col("pos") + F.length("variable") + 4).alias("preview"))


def word_count(s, d):
    return turns(s, d).select("conv_id", "turn", T.real_words(F.col("text")).cast("long").alias("words"))


def token_cheap(s, d):
    return turns(s, d).groupBy("conv_id").agg(F.sum(tokens.cheap_tokens(F.col("text"))).alias("tokens"))


def token_auto_method(s, d):
    t = table(s, d, "documents").select("doc_id", "text").withColumn("window", F.lit(2000).cast("long"))
    return tokens.estimate(t, "text", F.col("window")).select("doc_id", "method", "tokens")


def _models(s, d) -> DataFrame:
    t = table(s, d, "documents").selectExpr("doc_id", "text", "CASE doc_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4' ELSE 'other-model' END AS model")
    return t


#: Folder of the public vocabularies, and which of their files serves which model.
TOKENIZERS = "/opt/tokenizers"
RANKS = bpe.RankFiles(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", {"gpt-4o": f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"})


def token_exact(s, d):
    """Exact tokens of every document, by its model's rank file."""
    return bpe.count_tokens(_models(s, d), "text", RANKS, "model").select("doc_id", "model", "tokens")


def token_exact_boundary(s, d):
    """Automatic estimates with exact counts near the window of 1,000 tokens."""
    return tokens.estimate(_models(s, d), "text", F.lit(1000).cast("long"), ranks=RANKS, model="model").select("doc_id", "method", "tokens")


def token_overage(s, d):
    return tokens.rule(report.complete(cases(s, d)), Options(max_input_tokens=400)).where("code = 'TOKEN_OVERAGE'").select("case_id", "detail", F.col("first_char").alias("tokens"))


def token_char_limit(s, d):
    return tokens.rule(report.complete(cases(s, d)), Options(max_chars=1000)).where("detail LIKE 'Input text%'").select("case_id", "detail")


def cost_estimate(s, d):
    return tokens.costs(report.complete(cases(s, d))).select("case_id", "model", "tokens", "method", F.round("usd", 8).alias("usd"))


def cost_limit(s, d):
    return tokens.rule(report.complete(cases(s, d)), Options(max_cost_usd=0.01)).where("detail LIKE 'Estimated cost%'").select("case_id", F.element_at("summary", 1)["text"].alias("kind"))


def model_dim_left_join(s, d):
    return cases(s, d).select("conv_id", "model").join(F.broadcast(L.model_table(s)), "model", "left").select("conv_id", "model", F.coalesce("window", F.lit(L.DEFAULT_WINDOW)).alias("window"), "in_usd", "out_usd")


def conversation_tokens(s, d):
    c = tokens.costs(report.complete(cases(s, d)))
    return c.groupBy("model", "method").agg(F.sum("tokens").alias("tokens"), F.sum("char_count").alias("chars"), F.count("*").alias("n"))


def conflict_verbosity(s, d):
    t = texts(s, d)
    return t.where(F.regexp_like("text", F.lit(L.VERBOSE)) & F.regexp_like("text", F.lit(L.CONCISE))).select("conv_id")


def conflict_pairs(s, d):
    c = texts(s, d).select("conv_id", F.explode(conflicts.first_pairs(F.col("text"))).alias("c"))
    return c.select("conv_id", "c.bucket", F.col("c.a.text").alias("a_text"), F.col("c.a.start").alias("a_start"), F.col("c.b.text").alias("b_text"), F.col("c.b.start").alias("b_start"))


def conflict_issues(s, d):
    return conflicts.rule(cases(s, d)).select("case_id", "detail", "confidence", F.size("suggestions").cast("long").alias("n_suggestions"))


def conflict_pairs_cross(s, d):
    f = conflicts.phrases(texts(s, d).select("conv_id", "text")).drop("text")
    return conflicts.opposite_pairs(f, ["conv_id"]).groupBy("conv_id", "bucket").agg(F.count("*").alias("pairs"))


def phrase_pairs_self_join(s, d):
    f = conflicts.phrases(texts(s, d).select("conv_id", "text")).drop("text")
    return conflicts.phrase_pairs(f, ["conv_id"]).groupBy("conv_id").agg(F.count("*").alias("pairs"))


def conflict_dedupe(s, d):
    c = table(s, d, "events").selectExpr("user_id", "event_type AS bucket", "struct(event_id % 7 AS start, event_id % 7 + 3 AS end) AS a", "struct(event_id % 5 AS start, event_id % 5 + 4 AS end) AS b", "value AS confidence", "cast(event_id AS string) AS method")
    return conflicts.dedupe(c, ["user_id"]).groupBy("user_id", "bucket").agg(F.count("*").alias("kept"), F.round(F.max("confidence"), 6).alias("best"))


def json_keyword_filter(s, d):
    return texts(s, d).where(schema.has_json_cue(F.col("text"))).select("conv_id")


def schema_risk(s, d):
    r = schema.risk_rule(cases(s, d))
    return r.select("case_id", F.element_at("occurrences", 1)["text"].alias("json_text"), F.element_at("occurrences", 1)["start"].alias("json_start"), F.element_at("occurrences", 2)["text"].alias("prose_text"))


def schema_errors(s, d):
    e = cases(s, d).select("conv_id", F.explode(schema.schema_errors(F.col("schema_json"))).alias("e"))
    return e.groupBy("e.path", "e.keyword", "e.message").agg(F.count("*").alias("n"))


def schema_issue_detail(s, d):
    return schema.validation_rule(cases(s, d)).select("case_id", "severity", "detail", F.size("occurrences").cast("long").alias("n_errors"))


def definite_np_scan(s, d):
    return reference.definite_phrases(turns(s, d), "text").groupBy("raw", "head").agg(F.count("*").alias("n"), F.sum("start").alias("sum_start"))


def taxonomy_semi_join(s, d):
    f = reference.definite_phrases(turns(s, d), "text").select("conv_id", "turn", "head", "raw", "start")
    nouns = F.broadcast(L.taxonomy_table(s).select("noun").distinct())
    spelt = f.withColumn("noun", F.explode(F.array_distinct(F.array("head", "raw"))))
    return spelt.join(nouns, "noun", "left_semi").select("conv_id", "turn", "head", "start").distinct()


def forward_refs(s, d):
    return reference.forward_refs(turns(s, d), "text", L.nouns()).select("conv_id", "turn", F.lower("span").alias("span"), "head", "start")


def deictic_cue(s, d):
    return turns(s, d).where(reference.deictic(F.col("text"))).select("conv_id", "turn")


def noun_phrases(s, d):
    return reference.noun_phrases(turns(s, d).select("conv_id", "turn", "text"), "text").groupBy("head").agg(F.count("*").alias("n"))


def antecedent_exact(s, d):
    v = views(s, d).withColumn("h", T.normalize_phrase(F.col("hist")))
    c = reference.definite_phrases(v, "cur", L.nouns())
    return c.select("conv_id", "head", "start", F.regexp_like("h", T.word_pattern(F.col("head"))).alias("found"))


def antecedent_synonym(s, d):
    v = views(s, d)
    c = reference.definite_phrases(v, "cur", L.nouns()).select("conv_id", "head", "start")
    words = v.select(F.col("conv_id").alias("w_id"), F.explode(F.array_distinct(F.split(F.regexp_replace(T.normalize_phrase(F.col("hist")), "[^a-z0-9_]+", " "), " "))).alias("word"))
    syn = F.broadcast(L.synonym_table(s).select(F.col("head").alias("s_head"), "syn", "ord"))
    hit = c.join(syn, F.col("head") == F.col("s_head")).join(words, (F.col("conv_id") == F.col("w_id")) & F.col("word").isin(F.col("syn"), F.concat("syn", F.lit("s"))))
    return hit.groupBy("conv_id", "head", "start").agg(F.min_by("syn", "ord").alias("syn"))


def attachment_contains(s, d):
    c = reference.definite_phrases(views(s, d), "cur", L.nouns())
    return c.where(F.contains("attached", F.col("head"))).select("conv_id", "head", "start")


def uncovered_anti_join(s, d):
    v = views(s, d)
    c = reference.definite_phrases(v, "cur", L.nouns()).select("conv_id", "head", "start")
    words = v.select("conv_id", F.explode(F.array_distinct(F.split(F.regexp_replace(T.normalize_phrase(F.col("hist")), "[^a-z0-9_]+", " "), " "))).alias("word"))
    words = words.select("conv_id", F.explode(F.array("word", F.regexp_extract("word", "^(.+)s$", 1))).alias("head")).where("head <> ''").distinct()
    return c.join(words, ["conv_id", "head"], "left_anti")


def reference_candidates(s, d):
    """A row a candidate of every case: what resolves it, and how a report would tell it."""
    c = antecedents.described(reference.candidates(report.complete(cases(s, d))))
    return c.select("case_id", "forward", F.lower("span").alias("span"), "head", "start", "method", "matched", "resolution", "status", "checked_by", "sure", "penalty")


def reference_methods(s, d):
    c = reference.candidates(report.complete(cases(s, d)))
    return c.groupBy(F.coalesce("method", F.lit("none")).alias("method"), "forward").agg(F.count("*").alias("n"))


def reference_scores(s, d):
    r = report.resolved_by(cases(s, d))
    return r.select("case_id", F.col("n").cast("long").alias("n"), F.col("uncovered").cast("long").alias("uncovered"), F.col("score").cast("long").alias("score"), "flagged", F.array_join("methods", ",").alias("methods"))


def reference_issues(s, d):
    return reference.rule(report.complete(cases(s, d))).select("case_id", "detail", "confidence", "first_char", F.size("occurrences").cast("long").alias("n_occurrences"))


def issue_counts(s, d):
    return report.issue_table(cases(s, d)).groupBy("code", "severity").agg(F.count("*").alias("n"))


def disabled_rules(s, d):
    off = Options(disabled_rules=("MISSING_REFERENCE", "INVALID_SCHEMA", "TOKEN_OVERAGE", "SCHEMA_RISK"))
    return report.issue_table(cases(s, d), off).groupBy("code").agg(F.count("*").alias("n"))


def analyze_reports(s, d):
    r = report.analyze(cases(s, d))
    counts = F.array_join(F.transform(F.map_entries("summary.issue_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    return r.select(
        "case_id", F.size("issues").cast("long").alias("n_issues"), F.size("suggestions").cast("long").alias("n_suggestions"), "cost.est_input_tokens", F.coalesce(counts, F.lit("")).alias("issue_counts"),
        F.array_join(F.transform("issues", lambda i: i["detail"]), " | ").alias("details"),
    )


def case_param_cross_join(s, d):
    r = evaluate.runs(cases(s, d).select("conv_id"), evaluate.parameter_sets(s), 2)
    return r.groupBy("parameter_set", "iteration").agg(F.count("*").alias("runs"))


def _runs(s, d) -> DataFrame:
    """Result rows with deterministic latencies: detected codes of two rules under each parameter set."""
    t = texts(s, d)
    detected = F.concat(F.when(placeholders.detect_dialect(F.col("text")).isNotNull(), F.array(F.lit("MISSING_PLACEHOLDER"))).otherwise(F.array().cast("array<string>")), F.when(schema.has_prose_after_json(F.col("text")), F.array(F.lit("SCHEMA_RISK"), F.lit("SCHEMA_RISK"))).otherwise(F.array().cast("array<string>")))
    t = t.select("conv_id", detected.alias("detected"), F.when(F.col("conv_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.expr(EXPECTED))).alias("expected"))
    r = evaluate.runs(t, evaluate.parameter_sets(s)).join(F.broadcast(evaluate.parameter_sets(s).select("parameter_set", "ord")), "parameter_set")
    return r.select(
        F.col("conv_id").cast("string").alias("case_id"), "parameter_set", (F.col("conv_id") % 17 + F.col("ord") * 3).cast("double").alias("latency"), F.size("detected").cast("long").alias("issues_total"), "detected",
        evaluate.accuracy(F.col("detected"), F.col("expected")).alias("accuracy"), F.when(F.col("conv_id") % 11 == 0, F.lit("timeout")).alias("error"),
    )


def accuracy_per_case(s, d):
    r = _runs(s, d).where("parameter_set = 'baseline' AND accuracy IS NOT NULL").select("case_id", "accuracy.*")
    return r.select("case_id", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def summary_by_parameter_set(s, d):
    r = evaluate.summary_by_set(_runs(s, d))
    return r.select("parameter_set", "total_runs", "total_issues", *[F.round(c, 6).alias(c) for c in ("avg_latency", "success_rate", "avg_precision", "avg_recall", "avg_f1", "avg_tp", "avg_fp", "avg_fn")])


def summary_by_test_case(s, d):
    return evaluate.summary_by_case(_runs(s, d)).select("case_id", "runs", F.round("avg_latency", 6).alias("avg_latency"), "total_issues")


def issues_by_code(s, d):
    return evaluate.issues_by_code(_runs(s, d), ["parameter_set"])


def metric_table(s, d):
    return evaluate.metric_table(evaluate.summary_by_set(_runs(s, d))).select("parameter_set", "total_runs", "success_rate")


def feature_impact(s, d):
    i = evaluate.feature_impact(evaluate.summary_by_set(_runs(s, d)), evaluate.parameter_sets(s))
    return i.select("feature", *[F.round(c, 6).alias(c) for c in ("latency_on", "latency_off", "latency_change", "f1_on", "f1_off", "f1_change")])


def history_trend(s, d):
    e = table(s, d, "events").selectExpr("concat('report-', date_format(ts, 'yyyy-MM-dd'), '.json') AS file", "event_type AS parameter_set", "value").groupBy("file", "parameter_set").agg(F.sum("value").alias("avg_latency"), F.count("*").cast("double").alias("avg_f1"))
    t = evaluate.history_trend(e)
    return t.select("parameter_set", "reports", *[F.round(c, 4).alias(c) for c in ("avg_latency_current", "avg_latency_mean", "avg_latency_trend", "avg_f1_current", "avg_f1_trend")])


def dataset_statistics(s, d):
    c = table(s, d, "documents").selectExpr("lang AS category", "text AS prompt")
    return evaluate.dataset_stats(c).select("category", "cases", "tokens", F.round("avg_tokens", 6).alias("avg_tokens"))


def chunk_split(s, d):
    c = table(s, d, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("i", "chunk"))
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"), F.min(F.length("chunk")).cast("long").alias("shortest"))


def sentence_split(s, d):
    c = table(s, d, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("x"))
    return c.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("x")).alias("chars"))


def nli_hypotheses(s, d):
    c = reference.definite_phrases(turns(s, d), "text", L.nouns()).select("conv_id", "turn", "start", F.explode(T.hypotheses(F.col("span"))).alias("hypothesis"))
    return c.groupBy("hypothesis").agg(F.count("*").alias("n"))


def cosine_similarity(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label", "embedding")
    a, b = e.select(F.col("vec_id").alias("a_id"), "label", F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("a_id"), F.col("embedding").alias("y"))
    return a.join(b, "a_id").select("a_id", F.round(T.cosine(F.col("x"), F.col("y")), 5).alias("cosine"))


def best_match_similarity(s, d):
    """For the vectors whose id is divisible by 50, the best cosine among vectors of the same label."""
    m = nearest.best_in_group(table(s, d, "embeddings"), F.col("vec_id") % 50 == 0, "label")
    return m.select(F.col("query").alias("q_id"), F.round("cosine", 5).alias("best"))


def best_match_all(s, d):
    """For the vectors whose id is divisible by 50, the best match among all others."""
    m = nearest.best_match(table(s, d, "embeddings"), F.col("vec_id") % 50 == 0)
    return m.select(F.col("query").alias("q_id"), F.col("id").alias("best_id"), F.round("cosine", 5).alias("best"))


def line_diff_copies(s, d):
    """Line diffs between each document and the first one with the same longest line; both texts as they come back from the diff."""
    pairs = linediff.copies(table(s, d, "documents")).withColumn("ids", F.struct("first_id", "doc_id"))
    p = linediff.patches(pairs, "ids", "before", "after")
    digest = lambda gone: F.sha2(linediff.side_of(F.col("diff"), gone), 256)
    return p.select(
        "ids.first_id", "ids.doc_id", (F.col("n_same") + F.col("n_removed")).alias("n_before"), (F.col("n_same") + F.col("n_added")).alias("n_after"),
        (F.col("n_removed") + F.col("n_added") > 0).alias("changed"), digest(linediff.ADDED).alias("before_sha256"), digest(linediff.REMOVED).alias("after_sha256"),
    )


def combined_score(s, d):
    e = table(s, d, "events").selectExpr("event_id", "event_id % 10 / 10.0D AS p", "event_id % 7 / 7.0D AS s", "event_id % 11 / 11.0D AS n")
    c = semantic.combined(F.col("p"), F.col("s"), F.col("n"))
    return e.select(c.alias("c")).groupBy("c.status", "c.method").agg(F.count("*").alias("n"), F.round(F.sum("c.score"), 4).alias("score"))


def set_ops_codes(s, d):
    r = _runs(s, d).where("parameter_set = 'baseline'").select("case_id", F.explode("detected").alias("code"))
    want = table(s, d, "conversations").selectExpr("cast(conv_id AS string) AS case_id", f"{EXPECTED} AS code").distinct()
    hit, extra = r.intersect(want), r.distinct().exceptAll(want)
    return hit.withColumn("kind", F.lit("hit")).union(extra.withColumn("kind", F.lit("extra"))).groupBy("kind", "code").agg(F.count("*").alias("n"))


TAGS = """concat(text, CASE (conv_id + turn) % 6 WHEN 0 THEN ' Go on as discussed earlier, then continue the list.' WHEN 1 THEN ' Respond in one sentence but also deliver an exhaustive tutorial.'
 WHEN 2 THEN ' Output only valid JSON; then include a friendly narrative.' WHEN 3 THEN ' Please do not exceed 4,096 tokens.' WHEN 4 THEN ' See the rows below and the steps below.' ELSE '' END)"""


def label_references(s, d):
    r = turns(s, d).select("conv_id", "turn", F.explode(labels.references(F.col("text"))).alias("r"))
    return r.select("conv_id", "turn", F.col("r.start").alias("pos"), F.lower("r.text").alias("span"), "r.type")


def tagged_prompts(s, d):
    return turns(s, d).selectExpr("conv_id", "turn", f"{TAGS} AS text").select("conv_id", "turn", F.md5(labels.tagged(F.col("text"))).alias("digest"))


def valid_messages(s, d):
    m = "transform(messages, m -> struct(CASE WHEN length(m.content) % 3 = 0 THEN 'tool' ELSE m.role END AS role, m.content AS content))"
    c = cases(s, d).select("conv_id", labels.valid_messages(F.expr(m)).alias("m"))
    return c.select("conv_id", F.size("m").cast("long").alias("n"), F.md5(T.join_messages(F.col("m"))).alias("digest"))


def case_allocation(s, d):
    return labels.allocation(s, 303, [f"sector {i}" for i in range(8)], [f"pattern {i}" for i in range(5)])


def seeded_units(s, d):
    u = table(s, d, "documents").select("doc_id", T.seeded_units(F.col("doc_id"), 3).alias("u"))
    return u.select("doc_id", *[F.round(F.col("u")[i], 9).alias(f"u{i}") for i in range(3)])


def conflict_context(s, d):
    o = texts(s, d).select("conv_id", F.explode(T.occurrences(F.col("text"), L.VERBOSE)).alias("o"))
    return o.select("conv_id", F.col("o.start").alias("pos"), "o.text", F.md5("o.context").alias("context"))


def dynamic_forward(s, d):
    t = turns(s, d).selectExpr("conv_id", "turn", f"{TAGS} AS text")
    m = t.select("conv_id", "turn", F.explode(reference.dynamic_forward(F.col("text"))).alias("m"))
    return m.select("conv_id", "turn", "m.head", F.col("m.start").alias("pos"), F.lower("m.span").alias("span"))


def extracted_nouns(s, d):
    n = turns(s, d).select("conv_id", "turn", F.explode(reference.extracted_nouns(F.col("text"), F.array().cast("array<string>"))).alias("noun"))
    return n.groupBy("noun").agg(F.count("*").alias("n"))


def extracted_phrases(s, d):
    m = turns(s, d).select("conv_id", "turn", F.explode(reference.extracted_phrases(F.col("text"), F.array().cast("array<string>"))).alias("m"))
    return m.select("conv_id", "turn", "m.head", F.col("m.start").alias("pos"), F.lower("m.span").alias("span"))


def nlp_reference_issues(s, d):
    """The reference rule in extraction mode, patterns alone."""
    return reference.rule(report.complete(cases(s, d)), Options(use_nlp=True)).select("case_id", "detail", "confidence", "first_char")


def methods_used(s, d):
    return report.methods_used(reference.rule(report.complete(cases(s, d)))).select("case_id", F.array_join("methods", ",").alias("methods"))


def iso_dates(s, d):
    return table(s, d, "events").select("event_id", T.iso_date(F.col("ts")).alias("iso"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {turns, cases, texts, views, queries}
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and f not in own and not isinstance(f, type)}
