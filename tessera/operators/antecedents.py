"""What resolves a reference: a positional index of the words of each case, probed by equi-joins.

The index has a row for each case, part (history or current text) and word: the word's first and last place, and its first places that no
article or determiner precedes. Places count words, so "before the candidate" and "after it" are comparisons of numbers. A plural in s is indexed
under its singular too. Heads and synonyms of all candidates meet the index in one join by case and word; no pattern is made of a value.

Terms that are no plain word (with hyphens, blanks or letters beyond ASCII) are rare; their candidates are judged by patterns over the texts.
Index rows of a long case are dealt by word, so no task holds a whole case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import lexicon as L
from tessera.functions import text as T
from tessera.options import Options

_WORD = "[a-z0-9_]+"
#: Words before a mention that make it none.
_SKIP = ["this ", "that ", "a ", "an ", "some ", "any ", "each ", "every "]
_SKIP_END = "(?:" + "|".join(w.strip() for w in _SKIP) + ")$"
NOT_THE = "(?<!the[ \n\t])"
NOT_OTHER = "".join(f"(?<!{w})" for w in _SKIP)
_KEY = ["case_id", "forward", "start", "end", "head", "span"]
#: Candidates further behind a synonym than this lower the confidence.
FAR = 5000


def vocabulary(options: Options) -> list[str]:
    """Words that candidates of known nouns can ask for: the nouns, their singulars, all synonyms, and the words of the forward references."""
    nouns = L.nouns(list(options.reference_heads))
    singular = [w for n in nouns if n.endswith("s") for w in (n[:-1], n[:-2], n[:-3] + "y")]
    return sorted({*nouns, *singular, *L.FORWARD_WORDS, *(w for h, ws in L.synonyms(options.synonyms).items() for w in (h, *ws))})


def word_index(texts: DataFrame, options: Options | None = None) -> DataFrame:
    """(case_id, part, word, first, last, clear, plain, other, bare) from (case_id, part, text, and ``cur`` with options).

    With options only words that a candidate of known nouns can ask for are kept: the vocabulary and the nouns that ``cur`` has behind "the following".
    clear: first place without "the " before it; other: without another determiner; plain: without either; bare: without "the" and white space in the
    text as written.
    """
    norm = T.normalize_phrase(F.col("text"))
    ahead = F.transform(F.regexp_extract_all("cur", F.lit(L.FORWARD_REFS[0]), F.lit(1)), F.lower) if options else F.array().cast("array<string>")
    ahead = F.array_distinct(F.concat(ahead, F.transform(ahead, T.normalize_noun)))
    d = texts.select("case_id", "part", ahead.alias("ahead"), F.regexp_extract_all(norm, F.lit(_WORD), F.lit(0)).alias("w"),
        F.split(norm, _WORD).alias("gap"), F.split(F.lower("text"), _WORD).alias("raw"))
    prev = F.concat(F.array(F.lit("")), F.col("w"))
    each = F.slice(F.arrays_zip(F.col("w").alias("word"), F.col("gap").alias("gap"), F.col("raw").alias("raw"), prev.alias("prev")), 1, F.size("w"))
    # Exploded first, so that what follows is compiled: each word with the word and the characters before it.
    x = d.select("case_id", "part", "ahead", F.posexplode(each).alias("at", "x")).select("case_id", "part", "ahead", "at", "x.*")
    if options:
        known = lambda w: T.listed(w, vocabulary(options)) | F.array_contains("ahead", w)
        x = x.where(known(F.col("word")) | (F.endswith("word", F.lit("s")) & known(F.expr("left(word, length(word) - 1)"))))
    close, the = F.col("gap") == " ", F.endswith("prev", F.lit("the"))
    other = ~(close & F.regexp_like("prev", F.lit(_SKIP_END)))
    x = x.select("case_id", "part", "word", "at", (~(close & the)).alias("clear"), other.alias("other"),
        (~(F.col("raw").isin(" ", "\n", "\t") & the)).alias("bare"))
    forms = F.when(F.endswith("word", F.lit("s")) & (F.length("word") > 1), F.array("word", F.left("word", F.length("word") - 1))).otherwise(F.array("word"))
    at = lambda ok: F.min(F.when(ok, F.col("at")))
    return x.withColumn("word", F.explode(forms)).groupBy("case_id", "part", "word").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), at(F.col("clear")).alias("clear"), at(F.col("clear") & F.col("other")).alias("plain"),
        at(F.col("other")).alias("other"), at(F.col("bare")).alias("bare"),
    )


def terms(found: DataFrame, options: Options = Options(), nouns: list[str] | None = None) -> DataFrame:
    """Candidates with what is asked for: the noun of the span (``asked``), its synonyms and those of the head, and which of them are nouns."""
    nouns = L.nouns(list(options.reference_heads)) if nouns is None else nouns
    synonyms = L.synonyms(options.synonyms)
    table = F.str_to_map(F.lit("\x02".join(f"{h}\x03" + "\x01".join(s) for h, s in synonyms.items())), F.lit("\x02"), F.lit("\x03"))
    of = lambda head: F.coalesce(F.split(F.try_element_at(table, head), "\x01"), F.array(head))
    ref = T.normalize_phrase(F.col("span"))
    word = F.regexp_extract(ref, r"(?<![A-Za-z0-9_])(the|this|that|these|those|aforementioned)\s+([a-z][a-z0-9_-]{2,})(?![A-Za-z0-9_])", 2)
    asked = F.when(word != "", T.normalize_noun(word)).otherwise(F.element_at(F.split(ref, r"\s+"), -1))
    noun = lambda s: T.listed(s, nouns) | F.array_contains("more", s) if "more" in found.columns else T.listed(s, nouns)
    d = found.withColumn("asked", asked).withColumns({"syns": of(F.col("head")), "asked_syns": of(F.col("asked")), "head_noun": noun(F.col("head"))})
    return d.withColumn("noun_syns", F.filter("syns", noun))


def decided(options: Options, hit: dict[str, Column]) -> Column:
    """The method, from what was found: asked in history or behind; head and synonyms in history or before."""
    named = F.col("head") != ""
    return (
        F.when(hit["asked_h"], "pattern")
        .when(F.col("forward") & hit["asked_after"], "pattern")
        .when(named & F.col("long_hist") & hit["head_h"], "exact")
        .when(named & ~F.col("long_hist") & hit["head_before"], "exact")
        .when(named & F.col("long_hist") & hit["syn_h"], "synonym")
        .when(named & ~F.col("long_hist") & hit["syn_before"], "synonym")
        .when(named & hit["head_bare"], "memory")
        .when(named & hit["syn_bare"], "synonym")
        .when((F.col("head") == "") & F.lit(not options.strict_forward_refs), "attachment")
        .when(named & F.col("held"), "attachment")
    )


def by_index(asked: DataFrame, texts: DataFrame, options: Options) -> DataFrame:
    """Narrow candidates judged by the index of the cases' words; those with a verdict of the patterns (``told``) keep it."""
    wanted = F.when(F.col("told").isNull(), F.filter(F.array_distinct(F.concat("syns", "asked_syns")), lambda s: s != ""))
    rest = [c for c in asked.columns if c not in _KEY]
    probes = asked.select(*_KEY, F.struct(*rest).alias("rest"), F.explode_outer(wanted).alias("word"))
    hit = F.when(F.col("part").isNotNull(), F.struct("word", "part", "first", "last", "clear", "plain", "other", "bare"))
    met = probes.join(word_index(texts, None if options.use_nlp else options), ["case_id", "word"],
        "left").groupBy(*_KEY).agg(F.first("rest").alias("rest"), F.collect_list(hit).alias("hits"))
    d = met.select(*_KEY, "rest.*", "hits")
    some = lambda words, ok: F.exists(words, lambda s: F.exists("hits", lambda x: (x["word"] == s) & F.coalesce(ok(x), F.lit(False))))
    one = lambda word, ok: F.exists("hits", lambda x: (x["word"] == F.col(word)) & F.coalesce(ok(x), F.lit(False)))
    in_h = lambda x: x["part"] == "h"
    early = lambda c: lambda x: (x["part"] == "c") & (x[c] < F.col("n_before"))
    bare = lambda words: F.exists(words, lambda s: F.exists("hits",
        lambda x: (x["word"] == s) & F.coalesce(early("bare")(x) & early("plain")(x), F.lit(False))))
    method = decided(options, {
        "asked_h": some("asked_syns", in_h), "asked_after": some("asked_syns", lambda x: (x["part"] == "c") & (x["last"] >= F.col("n_until"))),
        "head_h": one("head", in_h), "head_before": one("head", early("clear")), "syn_h": some("syns", lambda x: in_h(x) & x["other"].isNotNull()),
        "syn_before": some("syns", early("plain")), "head_bare": F.col("head_noun") & bare(F.array("head")), "syn_bare": bare("noun_syns"),
    })
    matched = F.get(F.filter("asked_syns", lambda s: F.exists("hits", lambda x: in_h(x) & (x["word"] == s))), 0)
    fit = F.get(F.filter("syns", lambda s: F.exists("hits", lambda x: (x["word"] == s) & F.coalesce(early("plain")(x), F.lit(False)))), 0)
    nth = F.get(F.filter("hits", lambda x: (x["part"] == "c") & (x["word"] == fit)), 0)["plain"]
    # The place in characters of the nth word of the text before, which only candidates far in carry.
    size = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, s: a + F.length(s))
    place = F.when(F.col("far_text").isNotNull(), size(F.split("far_text", _WORD),
        nth + 1) + size(F.regexp_extract_all("far_text", F.lit(_WORD), F.lit(0)), nth))
    return d.withColumn("told", F.coalesce("told", verdict(method, matched, place))).drop("hits")


def verdict(method: Column, matched: Column, place: Column) -> Column:
    """What is kept of a candidate: the method, the matched word of the pattern check, the place of the synonym before it."""
    return F.struct(method.alias("method"), F.when(method == "pattern", matched).alias("matched"),
        F.when(method == "synonym", place).cast("long").alias("place"))


def by_patterns(options: Options) -> Column:
    """The verdict on a candidate with its case's texts (cur, hist), by patterns made of the terms."""
    h, raw = T.normalize_phrase(F.col("hist")), F.lower(F.substring(F.col("cur"), F.lit(1), F.col("start").cast("int")))
    before = T.normalize_phrase(raw)
    after = F.when(F.col("forward"), T.normalize_phrase(F.substring(F.col("cur"), (F.col("end") + 1).cast("int"), F.length("cur")))).otherwise(F.lit(""))
    has = lambda text, w, near="": F.regexp_like(text, T.word_pattern(w, near))
    some = lambda text, words, near="": F.exists(words, lambda s: has(text, s, near))
    plain = NOT_OTHER + "(?<!the )"
    bare = lambda words: F.exists(words, lambda s: has(raw, s, NOT_THE) & has(before, s, plain))
    method = decided(options, {
        "asked_h": some(h, "asked_syns"), "asked_after": (after != "") & some(after, "asked_syns"), "head_h": has(h,
            F.col("head")), "head_before": has(before, F.col("head"), "(?<!the )"),
        "syn_h": some(h, "syns", NOT_OTHER), "syn_before": some(before, "syns",
            plain), "head_bare": F.col("head_noun") & bare(F.array("head")), "syn_bare": bare("noun_syns"),
    })
    fit = F.get(F.filter("syns", lambda s: has(before, s, plain)), 0)
    place = F.when(F.col("start") > FAR, F.length(F.get(F.split(before, T.word_pattern(fit, plain), 2), 0)))
    return verdict(method, F.get(F.filter("asked_syns", lambda s: has(h, s)), 0), place)


def judge(v: DataFrame, found: DataFrame, options: Options = Options()) -> DataFrame:
    """Candidates (with the columns of the views) with method (null: nothing resolves it), matched word, confidence ``sure``, penalty, status and score.

    The rows keep case_id, message_index, forward, span, head, start, end and a preview; texts stay behind.
    """
    count = lambda size: F.regexp_count(F.substring(F.col("cur"), F.lit(1), F.col(size).cast("int")), F.lit("[A-Za-z0-9_]+"))
    word = lambda s: F.regexp_like(s, F.lit(f"^{_WORD}$"))
    d = terms(found, options).withColumns({
        "long_hist": T.count_words(F.col("hist")) > 40, "n_before": count("start"), "n_until": count("end"), "preview": T.preview(F.col("cur"),
            F.col("start"), F.col("end")),
        "far_text": F.when(F.col("start") > FAR, T.normalize_phrase(F.substring(F.col("cur"), F.lit(1), F.col("start").cast("int")))),
        "held": F.contains(F.col("attached"), F.col("head")) | F.exists("syns", lambda s: F.contains(F.col("attached"), s)),
    })
    odd = ~(word(F.col("asked")) & F.forall("asked_syns", word) & F.forall("syns", lambda s: (s == "") | word(s)))
    own = [*_KEY, "message_index", "preview", "asked"]
    narrow = d.select(*own, "asked_syns", "syns", "noun_syns", "head_noun", "long_hist", "n_before", "n_until", "far_text", "held",
        F.when(odd, by_patterns(options)).alias("told"))
    parts = F.array(F.struct(F.lit("h").alias("part"), F.col("hist").alias("text")), F.struct(F.lit("c").alias("part"), F.col("cur").alias("text")))
    method = F.col("told.method")
    sure = F.when(method.isNull(), F.lit(0.0)).when((method == "pattern") & (F.col("told.matched") == F.col("asked")), F.lit(0.9)).otherwise(F.lit(0.8))
    penalty = F.coalesce(F.col("start") - F.col("told.place") > FAR, F.lit(False))
    out = by_index(narrow, v.select("case_id", "cur", F.inline(parts)), options)
    return out.select(*own[:-1], "told.method", "told.matched", sure.alias("sure"), penalty.alias("penalty"))


def described(judged: DataFrame) -> DataFrame:
    """Judged candidates with resolution, status, checked_by and points: how a report tells each reference, resolved ones too."""
    method, open_ = F.col("method"), F.col("method").isNull()
    resolution = F.when(method.isin("exact", "synonym", "memory", "attachment"), F.concat(F.lit("resolved-by-"), method)).otherwise(F.lit("unresolved"))
    models = method.isin("semantic-similarity", "nli-entailment", "combined")
    checked = F.when(models, method).when(open_ | (method == "pattern"), "pattern").otherwise("none")
    points = F.when(method.isin("exact", "synonym", "pattern"), -2).when(method.isin("memory", "attachment"), -1).otherwise(0)
    return judged.withColumns({"resolution": resolution, "status": F.when(open_, "unfulfilled").otherwise("fulfilled"), "checked_by": checked,
        "points": points})


def scores(v: DataFrame, judged: DataFrame) -> DataFrame:
    """A row a case: its views, number of candidates and of open ones, score, whether an issue is due, methods, and the open candidates in order.

    The score is one point for a deictic cue and one for any candidate, less the points of what is resolved.
    """
    d = described(judged)
    open_ = F.col("method").isNull()
    per = d.groupBy("case_id").agg(
        F.count("*").alias("n"), F.sum(open_.cast("int")).alias("uncovered"), F.sum("points").alias("points"), F.max("penalty").alias("penalty"),
        F.max(F.col("method").isin("synonym", "memory", "pattern")).alias("unsure"), F.array_sort(F.collect_set("method")).alias("methods"),
        F.sort_array(F.collect_list(F.when(open_, F.struct("forward", "start", F.lower("span").alias("key"), "head", "span", "end", "preview",
            "message_index", "status", "checked_by", "sure")))).alias("open"),
    )
    none = {"n": F.lit(0), "uncovered": F.lit(0), "penalty": F.lit(False), "unsure": F.lit(False), "methods": F.array().cast("array<string>"),
        "open": F.array().cast(per.schema["open"].dataType), "points": F.lit(0)}
    out = v.withColumn("cue", F.regexp_like("cur", F.lit(L.DEICTIC))).join(per, "case_id", "left").withColumns({c: F.coalesce(c, x) for c, x in none.items()})
    out = out.withColumn("score", F.col("cue").cast("int") + (F.col("n") > 0).cast("int") + F.col("points")).drop("points")
    return out.withColumn("flagged", (F.col("uncovered") > 0) | (F.col("cue") & (F.col("n") == 0)) | (F.col("score") >= 2))
