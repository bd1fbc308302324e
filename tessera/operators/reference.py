"""References without an antecedent: definite noun phrases, forward references and deictic cues.

The current text's candidates are judged (see ``antecedents``) against the history (any mention resolves them), the current text before them
(mentions without an article or determiner), and attachment names. Forward references without a noun are always
resolved unless ``strict_forward_refs`` is set, and "the following X" looks for the word "following" first; both keep
earlier behaviour. See ``Options`` for window, nouns and synonyms.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import lexicon as L
from tessera.functions import text as T
from tessera.operators import antecedents, issues
from tessera.options import Options



def views(cases: DataFrame, options: Options = Options()) -> DataFrame:
    """case_id, cur, hist, attached (normalised names), message_index."""
    names = F.transform("attachments", lambda a: T.normalize_phrase(F.coalesce(F.nullif(a["name"], F.lit("")), a["type"], F.lit("")))) if "attachments" in cases.columns else F.array().cast("array<string>")
    p, m = F.col("prompt"), F.col("messages")
    return cases.select(
        "case_id", T.current_text(p, m).alias("cur"), T.history_text(p, m, options.window_messages, options.window_chars).alias("hist"),
        F.coalesce(T.normalize_phrase(F.array_join(names, " ")), F.lit("")).alias("attached"), issues.scope_index(m).alias("message_index"),
    )


def definite_phrases(df: DataFrame, text: str, nouns: list[str] | None = None) -> DataFrame:
    """A row for each definite noun phrase: keys, span, head (normalised), start, end. With ``nouns``, only heads among them."""
    d = df.withColumn("m", F.explode(T.find_all(text, L.DEFINITE_NP, 2))).withColumn("raw", F.lower("m.value"))
    d = d.withColumn("head", T.normalize_noun(F.col("raw")))
    if nouns is not None:
        d = d.where(T.listed(F.col("raw"), nouns) | T.listed(F.col("head"), nouns))
    return d.select(*df.columns, F.col("m.text").alias("span"), "raw", "head", F.col("m.start").alias("start"), F.col("m.end").alias("end"))


def forward_matches(text: str) -> Column:
    """Forward references: array of (start, end, text, value), each range once, in order; value is the noun of "the following X"."""
    parts = [T.find_all(text, p, 1 if i == 0 else 0) for i, p in enumerate(L.FORWARD_REFS)]
    def keyed(x: Column, i: int) -> Column:
        value = lambda m: F.lower(m["value"]) if i == 0 else F.lit("")
        return F.transform(x, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(i).alias("pattern"), m["text"].alias("text"), value(m).alias("value")))

    all_ = F.sort_array(F.concat(*[keyed(x, i) for i, x in enumerate(parts)]))
    return F.filter(all_, lambda m, i: (i == 0) | ~((F.try_element_at(all_, F.greatest(i, F.lit(1)))["start"] == m["start"]) & (F.try_element_at(all_, F.greatest(i, F.lit(1)))["end"] == m["end"])))


def forward_refs(df: DataFrame, text: str, nouns: list[str], more: str | None = None) -> DataFrame:
    """A row for each forward reference: keys, span, head ('' unless a known noun follows), start, end. ``more``: a column of further nouns."""
    d = df.withColumn("m", F.explode(forward_matches(text)))
    noun = T.normalize_noun(F.col("m.value"))
    known = T.listed(F.col("m.value"), nouns) | T.listed(noun, nouns)
    if more:
        known = known | F.array_contains(more, F.col("m.value")) | F.array_contains(more, noun)
    known = (F.col("m.value") != "") & known
    return d.select(*df.columns, F.col("m.text").alias("span"), F.col("m.value").alias("raw"), F.when(known, noun).otherwise(F.lit("")).alias("head"), F.col("m.start").alias("start"), F.col("m.end").alias("end"))


def is_verb(word: Column) -> Column:
    """Whether a lower-case word is a verb form of the list, maybe with -s, -ed or -ing."""
    stem = lambda n: F.left(word, F.length(word) - n)
    return T.listed(word, L.VERBS) | (F.endswith(word, F.lit("ing")) & T.listed(stem(3), L.VERBS)) | (F.endswith(word, F.lit("ed")) & T.listed(stem(2), L.VERBS)) | (F.endswith(word, F.lit("s")) & T.listed(stem(1), L.VERBS))


def extracted_nouns(text: Column, entities: Column, verbs: bool = True) -> Column:
    """Nouns behind any determiner, and entities, each with its singular."""
    found = F.transform(F.regexp_extract_all(text, F.lit(L.ANY_DETERMINER), F.lit(2)), F.lower)
    found = F.filter(found, lambda w: ~T.listed(w, L.STOP_WORDS) & (~is_verb(w) if verbs else F.lit(True)))
    both = F.concat(found, entities)
    return F.array_distinct(F.concat(both, F.transform(both, T.normalize_noun)))


def extracted_phrases(text: Column, entities: Column) -> Column:
    """Definite noun phrases and entities: array<struct<start, head, end, span>> by start; of equal (start, head) the longest text.

    An entity counts at its first place, from the determiner before it on.
    """
    shape = lambda start, head, end, span: F.struct(start.cast("long").alias("start"), head.alias("head"), (-end).cast("long").alias("back"), span.alias("span"))
    np = F.filter(T.find_all(text, L.DEFINITE_NP, 2), lambda m: ~T.listed(F.lower(m["value"]), L.STOP_WORDS) & ~is_verb(F.lower(m["value"])) & ~F.startswith(F.lower(m["text"]), F.lit("aforementioned")))
    np = F.transform(np, lambda m: shape(m["start"], T.normalize_noun(m["value"]), m["end"], m["text"]))

    def placed(w):
        at = F.instr(F.lower(text), w) - 1
        ahead = F.substring(text, F.greatest(at - 9, F.lit(1)), F.least(at, F.lit(10)))
        start = at - F.length(F.regexp_extract(ahead, r"(?i)(?<![A-Za-z0-9_])(the|this|that|these|those|a|an)\s*$", 0))
        end = at + F.length(w)
        return shape(start, T.normalize_noun(w), end, F.substring(text, start + 1, end - start))

    named = F.transform(F.filter(entities, lambda w: F.instr(F.lower(text), w) > 0), placed)
    both = F.sort_array(F.concat(np, named))
    before = lambda i: F.try_element_at(both, F.greatest(i, F.lit(1)))
    kept = F.filter(both, lambda m, i: (i == 0) | (before(i)["start"] != m["start"]) | (before(i)["head"] != m["head"]))
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["head"].alias("head"), (-m["back"]).alias("end"), m["span"].alias("span")))


def dynamic_forward(text: Column | str) -> Column:
    """"the X below" for any X: array<struct<start, head, end, span>>."""
    return F.transform(T.find_all(text, L.DYNAMIC_FORWARD, 2), lambda m: F.struct(m["start"].alias("start"), T.normalize_noun(m["value"]).alias("head"), m["end"].alias("end"), m["text"].alias("span")))


def _as_candidates(found: Column, forward: bool) -> Column:
    return F.transform(found, lambda m: F.struct(m["span"].alias("span"), m["head"].alias("head"), m["start"].alias("start"), m["end"].alias("end"), F.lit(forward).alias("forward")))


def _known(m: Column, nouns: list[str], more: bool) -> Column:
    """Whether the noun of "the following X" is one that the case or the lists know."""
    noun = T.normalize_noun(m["value"])
    listed = T.listed(m["value"], nouns) | T.listed(noun, nouns)
    return (m["value"] != "") & (listed | F.array_contains("more", m["value"]) | F.array_contains("more", noun) if more else listed)


def candidate_list(nouns: list[str], extract: bool) -> Column:
    """All candidates of a case's current text ``cur`` as one array, so that they are found in one pass.

    With ``extract`` the views also have ``more`` nouns and the entities of the current text, ``named``.
    """
    fixed = forward_matches("cur")
    head = lambda m: F.when(_known(m, nouns, extract), T.normalize_noun(m["value"])).otherwise(F.lit(""))
    forward = F.transform(fixed, lambda m: F.struct(m["text"].alias("span"), head(m).alias("head"), m["start"].alias("start"), m["end"].alias("end")))
    if not extract:
        near = F.filter(T.find_all("cur", L.DEFINITE_NP, 2), lambda m: T.listed(F.lower(m["value"]), nouns) | T.listed(T.normalize_noun(m["value"]), nouns))
        near = F.transform(near, lambda m: F.struct(m["text"].alias("span"), T.normalize_noun(m["value"]).alias("head"), m["start"].alias("start"), m["end"].alias("end")))
        return F.concat(_as_candidates(near, False), _as_candidates(forward, True))
    # A range that a fixed pattern gives the same head is not repeated.
    new = F.filter(dynamic_forward("cur"), lambda d: ~F.exists(forward, lambda m: (m["start"] == d["start"]) & (m["head"] == d["head"]) & (m["head"] != "")))
    return F.concat(_as_candidates(extracted_phrases(F.col("cur"), F.col("named")), False), _as_candidates(forward, True), _as_candidates(new, True))


def candidates(cases: DataFrame, options: Options = Options(), entities: Callable[[Column], Column] | None = None) -> DataFrame:
    """All candidates with what resolves them, as ``antecedents.judge`` returns them.

    With ``use_nlp`` all definite phrases and entities are candidates, not those of known nouns alone; ``entities`` finds a text's entities.
    """
    nouns = L.nouns(list(options.reference_heads))
    v = views(cases, options)
    if options.use_nlp:
        named = entities or (lambda _: F.array().cast("array<string>"))
        v = v.withColumn("named", F.coalesce(named(F.col("cur")), F.array())).withColumn("named_before", F.coalesce(named(F.col("hist")), F.array()))
        v = v.withColumn("more", F.array_union(extracted_nouns(F.col("cur"), F.col("named")), extracted_nouns(F.col("hist"), F.col("named_before"))))
    both = v.withColumn("c", F.explode(candidate_list(nouns, options.use_nlp))).select(*v.columns, "c.*")
    return antecedents.judge(v, both, options)


def deictic(text: Column) -> Column:
    return F.regexp_like(text, F.lit(L.DEICTIC))


def rule(cases: DataFrame, options: Options = Options()) -> DataFrame:
    return report(views(cases, options), candidates(cases, options))


def report(v: DataFrame, found: DataFrame) -> DataFrame:
    """Issues from the cases' views and their judged candidates."""
    d = antecedents.scores(v, found).where("flagged")
    told = lambda x: issues.occurrence(
        text=x["span"], start=x["start"], end=x["end"], preview=x["preview"], message_index=x["message_index"], resolution=F.lit("unresolved"),
        fulfillment_status=x["status"], fulfillment_method=x["checked_by"], fulfillment_confidence=x["sure"], term=F.nullif(x["head"], F.lit("")),
    )
    keys = F.array_distinct(F.transform("open", lambda x: x["key"]))
    counted = F.transform(keys, lambda k, i: F.struct((-F.size(F.filter("open", lambda x: x["key"] == k))).cast("long").alias("neg"), i.alias("ord"), k.alias("key")))
    counted = F.concat(counted, F.when(F.col("cue"), F.array(F.struct(F.lit(-1).cast("long").alias("neg"), F.size(keys).alias("ord"), F.lit("deictic cue").alias("key")))).otherwise(F.array().cast("array<struct<neg:bigint,ord:int,key:string>>")))
    summary = F.transform(F.sort_array(counted), lambda x: F.struct(x["key"].alias("text"), (-x["neg"]).alias("count")))
    d = d.withColumn("summary_", summary)
    cue_row = issues.occurrence(text=F.lit("deictic cue present"), start=F.lit(-1), end=F.lit(-1), message_index=F.col("message_index"), preview=F.lit(""), resolution=F.lit("unresolved"), fulfillment_status=F.lit("unfulfilled"), fulfillment_method=F.lit("none"), fulfillment_confidence=F.lit(0.0))
    occurrences = F.concat(F.transform(F.slice("open", 1, 50), told), F.when(F.col("cue"), F.array(cue_row)).otherwise(F.array().cast(f"array<{issues.OCCURRENCE}>")))
    words = T.count_words(F.col("hist"))
    confidence = F.when(words < 20, "low").when((F.col("uncovered") > 0) & F.col("unsure"), "medium").otherwise("high")
    confidence = F.when(F.col("penalty") & (F.col("uncovered") == 0), F.when(confidence == "high", "medium").otherwise("low")).otherwise(confidence)
    said = F.transform(F.slice("summary_", 1, 3), lambda s: F.concat(F.lit('"'), s["text"], F.lit('"'), F.when(s["count"] > 1, F.concat(F.lit(" (×"), s["count"].cast("string"), F.lit(")"))).otherwise(F.lit(""))))
    # The wording of the detail and of the suggestions.
    detail = F.concat(F.lit("References "), F.array_join(said, ", "), F.lit(" without antecedent in prior context or attachments."))
    heads = F.transform("open", lambda x: x["head"])
    any_of = lambda *hs: reduce(lambda a, b: a | b, [F.array_contains(heads, h) for h in hs])
    advice = issues.suggestions(
        (any_of("report", "document", "transcript"), "ADD_CONTEXT", "Inline a 1–3 line summary or attach the file metadata."),
        (any_of("list", "results"), "ADD_CONTEXT", "Paste the prior items or a compact summary before asking to continue."),
    )
    first = F.get(F.filter("open", lambda x: x["start"] >= 0), 0)["start"]
    return issues.issue(d, 2, "MISSING_REFERENCE", "high", detail, confidence, F.col("summary_"), occurrences, first, F.col("message_index"), advice)


def noun_phrases(df: DataFrame, text: str, verbs: bool = True) -> DataFrame:
    """Definite noun phrases whose head is neither a stop word nor (if ``verbs``) a verb; of equal (start, head) the longest text."""
    d = definite_phrases(df, text).where(~T.listed(F.col("raw"), L.STOP_WORDS))
    if verbs:
        d = d.where(~is_verb(F.col("raw")))
    return d.groupBy(*df.columns, "start", "head").agg(F.max_by("span", F.length("span")).alias("span"))
