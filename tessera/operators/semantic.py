"""Model-backed checks with pluggable models: embedding similarity, entailment, entity extraction.

A model is any callable on lists of strings that a worker can import or unpickle; without one, scores are null and checks
degrade to patterns. Only rows that patterns leave open reach a model, one Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import lexicon as L
from tessera.functions import text as T
from tessera.operators import conflicts
from tessera.options import Options


@dataclass(frozen=True)
class Models:
    embed: Callable[[list[str]], list[list[float]]] | None = None
    entail: Callable[[list[str], list[str]], list[float]] | None = None
    entities: Callable[[list[str]], list[list[tuple[str, str]]]] | None = None

    def available(self) -> dict[str, bool]:
        """Which models there are."""
        return {"embed": self.embed is not None, "entail": self.entail is not None, "entities": self.entities is not None}


def embed_udf(model: Callable | None):
    if model is None:
        return lambda c: F.lit(None).cast("array<float>")
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(model(s.fillna("").tolist()))

    return run


def entail_udf(model: Callable | None):
    if model is None:
        return lambda a, b: F.lit(None).cast("double")
    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series(model(a.fillna("").tolist(), b.fillna("").tolist())).clip(0, 1)

    return run


def entity_udf(model: Callable | None):
    """Nouns that a tagger finds in a text: entities of known types, 3 characters or more, no stop words, lower-case, each once."""
    if model is None:
        return lambda c: F.array().cast("array<string>")
    types, stop = set(L.ENTITY_TYPES), set(L.STOP_WORDS)

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            got = model(s.fillna("").tolist())
            yield pd.Series([list(dict.fromkeys(w.lower().strip() for w, t in g if t.split("-")[-1].upper() in types and len(w.strip()) >= 3 and w.lower().strip() not in stop)) for g in got], index=s.index)

    return run


def pieces(text: Column, options: Options = Options()) -> Column:
    """What a reference is compared with: key phrases, sentences, chunks (of long texts) or the whole text, which also stands in for none."""
    if options.use_phrases or options.use_sentences:
        parts = T.key_phrases(text) if options.use_phrases else T.sentences(text)
        return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))
    cut = F.length(text) > 1000 if options.use_chunks is None else F.lit(options.use_chunks)
    return F.when(cut, T.chunks(text, options.chunk_size, options.chunk_overlap)).otherwise(F.array(text))


def similarity(a: Column, b: Column) -> Column:
    """Cosine clamped to 0 and 1; null without vectors."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), T.cosine(a, b))))


def best_scores(pairs: DataFrame, models: Models, options: Options = Options()) -> DataFrame:
    """pairs: (key, reference, context). Adds similarity (best over the context's pieces) and entailment (best over hypotheses)."""
    ref = pairs.withColumn("r_", embed_udf(models.embed)(F.col("reference")))
    parts = ref.withColumn("piece", F.explode(pieces(F.col("context"), options))).withColumn("p_", embed_udf(models.embed)(F.col("piece")))
    sim = parts.groupBy("key").agg(F.max(similarity(F.col("r_"), F.col("p_"))).alias("similarity"))
    say = T.hypotheses(F.col("reference"))
    hyp = pairs.withColumn("hypothesis", F.explode(say if options.use_many_hypotheses else F.slice(say, 1, 1))).withColumn("e_", entail_udf(models.entail)(F.col("context"), F.col("hypothesis")))
    ent = hyp.groupBy("key").agg(F.max("e_").alias("entailment"))
    return pairs.join(sim, "key").join(ent, "key")


def weights(options: Options) -> tuple[float, float, float]:
    p, s, n = options.combine_weights
    p = p if options.use_pattern else 0.0
    total = (p + s + n) or 1.0
    return p / total, s / total, n / total


def combined(pattern: Column, sim: Column, ent: Column, options: Options = Options()) -> Column:
    """Weighted score, status and primary method of the three scores."""
    wp, ws, wn = weights(options)
    p, s, n = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (pattern, sim, ent))
    score = p * wp + s * ws + n * wn
    status = F.when(score >= options.combined_threshold, "fulfilled").when(score >= options.combined_threshold * 0.7, "uncertain").otherwise("unfulfilled")
    strong = (p >= 0.5).cast("int") + (s >= options.similarity_threshold).cast("int") + (n >= options.entailment_threshold).cast("int")
    method = F.when(strong >= 2, "combined").when((p >= s) & (p >= n), "pattern").when(s >= n, "semantic-similarity").otherwise("nli-entailment")
    return F.struct(score.alias("score"), status.alias("status"), method.alias("method"))


def resolve(found: DataFrame, v: DataFrame, models: Models, options: Options = Options()) -> DataFrame:
    """Candidates of ``reference.candidates``, the open ones judged by the models against history and earlier text of their case's views ``v``."""
    open_ = found.where(F.col("method").isNull()).join(v.select("case_id", "cur", "hist"), "case_id")
    key = F.xxhash64("case_id", "start", "end", "forward")
    context = F.concat_ws("\n", F.nullif("hist", F.lit("")), F.nullif(F.substring(F.col("cur"), F.lit(1), F.col("start").cast("int")), F.lit("")))
    pairs = open_.select(key.alias("key"), F.col("span").alias("reference"), context.alias("context")).dropDuplicates(["key"])
    judged = best_scores(pairs, models, options).select("key", "similarity", "entailment")
    d = open_.withColumn("key", key).join(judged, "key", "left").drop("key")
    s, n = (F.col("similarity") if options.use_semantic else F.lit(None).cast("double")), (F.col("entailment") if options.use_nli else F.lit(None).cast("double"))
    if options.use_combined:
        c = combined(F.lit(0.0), s, n, options)
        method, sure = F.when(c["status"] == "fulfilled", c["method"]), c["score"]
    else:
        method = F.when(s >= options.similarity_threshold, "semantic-similarity").when(n >= options.entailment_threshold, "nli-entailment")
        sure = F.greatest(F.coalesce(s, F.lit(0.0)), F.coalesce(n, F.lit(0.0)))
    d = d.withColumn("method", method).withColumn("sure", sure).drop("similarity", "entailment", "cur", "hist")
    return found.where(F.col("method").isNotNull()).unionByName(d)


def semantic_conflicts(cases: DataFrame, models: Models, options: Options = Options()) -> DataFrame:
    """Pattern, semantic and logical conflicts of each case, deduplicated: (case_id, bucket, a, b, confidence, method)."""
    from tessera.operators import issues

    base = cases.select("case_id", T.full_text(F.col("prompt"), F.col("messages")).alias("text"), issues.scope_index(F.col("messages")).alias("message_index"))
    part = lambda c: F.struct(F.col(f"{c}.phrase").alias("text"), F.lit("").alias("value"), F.col(f"{c}.start").alias("start"), F.col(f"{c}.end").alias("end"))
    made = base.withColumn("c", F.explode(conflicts.first_pairs(F.col("text")))).select("case_id", "c.bucket", "c.a", "c.b", "c.confidence", "c.method")
    found = conflicts.phrases(base.select("case_id", "text"))
    if models.embed:
        e = embed_udf(models.embed)
        pairs = conflicts.opposite_pairs(found.drop("text"), ["case_id"]).withColumn("s", similarity(e(F.col("a.sentence")), e(F.col("b.sentence"))))
        made = made.union(pairs.where(F.col("s") < options.conflict_similarity).select("case_id", F.lit("semantic"), part("a"), part("b"), 1 - F.col("s"), F.lit("semantic")))
    if models.entail:
        n = entail_udf(models.entail)
        against = lambda c: F.concat(F.lit("This contradicts: "), F.col(f"{c}.sentence"))
        pairs = conflicts.phrase_pairs(found.drop("text"), ["case_id"]).withColumn("s", F.greatest(n(F.col("a.sentence"), against("b")), n(F.col("b.sentence"), against("a"))))
        made = made.union(pairs.where(F.col("s") > options.conflict_contradiction).select("case_id", F.lit("logical"), part("a"), part("b"), F.col("s"), F.lit("nli")))
    return conflicts.dedupe(made, ["case_id"])


def conflict_rule(cases: DataFrame, models: Models, options: Options = Options()) -> DataFrame:
    from tessera.operators import issues

    base = cases.select("case_id", T.full_text(F.col("prompt"), F.col("messages")).alias("text"), issues.scope_index(F.col("messages")).alias("message_index"))
    got = semantic_conflicts(cases, models, options).groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "a", "b", "confidence", "method"))).alias("conflicts"))
    return conflicts.report(base.join(got, "case_id"))


def entities(df: DataFrame, text: str, models: Models) -> DataFrame:
    """A row for each noun that the tagger finds: keys, noun. Empty without a model."""
    return df.select("*", F.explode(entity_udf(models.entities)(F.col(text))).alias("noun"))
