"""Quality rules by distribution divergence.

A document's histogram of character classes and of common words is compared with the reference of
its language by Jensen-Shannon distance (base 2, 0 to 1). The references are the summed
histograms of all documents of a language; the common words are fixed lists. Documents below a
minimum length are not judged by a histogram they hardly fill. Base rules count words, symbols,
repeated lines and words in repeated windows exactly. DataFrame functions only; one pass over the
texts, nothing but (language, histogram) sums is shuffled.

Null texts have no words. Languages outside the lists, and null, share one reference ``other``. A null text fails the
base rule (fewer than 20 words). Repeated rows are judged alike. An empty table gives an empty
result. Columns other than the id, the text and the language are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import cut

# Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was as with be by are this at from or an not have but".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es lo como más o pero".split(),
}
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")
WINDOW = 8
#: Character histograms count from this many characters on, word histograms from this many words on.
MIN_CHARS, MIN_WORDS = 200, 50
#: A document further than this from its language's reference fails.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.34, 0.50

_SPACE = r"[\x20\x09-\x0D]"


def _strip(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def js_distance(p: Column, q: Column, p_total: Column, q_total: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts with the given sums; null if either sum is 0."""

    def part(x, y):
        a, b = x / p_total, y / q_total
        m = (a + b) / 2
        term = lambda v: F.when(v > 0, v * F.log2(v / m)).otherwise(F.lit(0.0))
        return (term(a) + term(b)) / 2

    total = F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda s, x: s + x)
    return F.when((p_total > 0) & (q_total > 0), F.sqrt(F.greatest(F.lit(0.0), total)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts and histograms of each row's text."""
    lang = F.when(F.col(lang_col).isin(*COMMON_WORDS), F.col(lang_col)).otherwise(F.lit("other"))
    d = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), lang.alias("lang"))
    d = d.withColumn("words", F.filter(F.split("t", _SPACE + "+"), lambda w: w != ""))
    # What is left after each class goes; the lengths tell how many characters it had.
    d = d.withColumn("r1", _strip(F.col("t"), r"[a-zß-öø-ÿ]++"))
    d = d.withColumn("r2", _strip(F.col("r1"), _SPACE + "++"))
    d = d.withColumn("r3", _strip(F.col("r2"), r"[A-ZÀ-ÖØ-Þ]++"))
    d = d.withColumn("r4", _strip(F.col("r3"), r"[#*$%&|<>]++"))
    d = d.withColumn("r5", _strip(F.col("r4"), r"[0-9]++"))
    d = d.withColumn("r6", _strip(F.col("r5"), r"[.,;:!?'\"()-]++"))
    n = {k: F.length(k) for k in ("t", "r1", "r2", "r3", "r4", "r5", "r6")}
    by = {"lower": n["t"] - n["r1"], "space": n["r1"] - n["r2"], "upper": n["r2"] - n["r3"], "symbol": n["r3"] - n["r4"], "digit": n["r4"] - n["r5"], "stop": n["r5"] - n["r6"], "other": n["r6"]}
    d = d.withColumn("char_hist", F.array(*[by[c].cast("double") for c in CLASSES]))
    d = d.withColumn("n_symbols", by["symbol"].cast("long")).withColumn("word_chars", (n["t"] - by["space"]).cast("long"))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    # Repeated windows: the text holds some if its window hashes are not all distinct.
    last = F.size("words") - WINDOW + 1
    d = d.withColumn(
        "wins",
        F.when(last >= 2, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(F.col("words"), i, WINDOW)))).otherwise(F.array().cast("array<bigint>")),
    )
    sorted_ = F.sort_array(F.transform(F.col("wins"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("order", F.when(F.size(F.array_distinct("wins")) < F.size("wins"), sorted_))
    twin = F.transform(
        F.col("order"),
        lambda x, k: F.when(
            (F.try_element_at("order", (k + 2).cast("int"))["h"] == x["h"]) | ((k > 0) & (F.try_element_at("order", F.when(k > 0, k).otherwise(F.lit(1)).cast("int"))["h"] == x["h"])), x["i"]
        ),
    )
    d = d.withColumn("starts", F.sort_array(F.filter(twin, lambda x: x.isNotNull())))
    gaps = F.zip_with(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.slice("starts", 1, F.greatest(F.size("starts") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x)
    d = d.withColumn("n_repeat_words", F.when(F.col("order").isNotNull(), covered).otherwise(F.lit(0)).cast("long"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(_strip(x, _SPACE + "+")) > 0)
    d = d.withColumn("lines", lines).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    # Common words: the text's function words alone, joined, so that each count is a difference of lengths.
    vocabulary = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    bare = F.transform("words", lambda w: F.lower(F.regexp_replace(w, r"[.,;:!?]+$", "")))
    d = d.withColumn("common", F.concat(F.lit(" "), F.array_join(F.filter(bare, lambda w: w.isin(*vocabulary)), "  "), F.lit(" ")))
    counts = [((F.length("common") - F.length(F.replace(F.col("common"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)) for w in vocabulary]
    d = d.withColumn("found", F.array(*[c.cast("double") for c in counts]))
    rest = F.col("n_words").cast("double") - F.aggregate("found", F.lit(0.0), lambda s, x: s + x)
    d = d.withColumn("word_hist", F.concat("found", F.array(rest)))
    return d.select("row_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_hist", "word_hist", n["t"].alias("chars"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each document: the base counts, base_failed, both distances (null where not judged) and kept."""
    m = cut(measure(docs, id_col, text_col, lang_col), "histograms")
    size = len({w for ws in COMMON_WORDS.values() for w in ws}) + 1
    sums = lambda c, k, name: F.array(*[F.sum(F.col(c)[i]) for i in range(k)]).alias(name)
    # One row a language, and there are len(COMMON_WORDS) + 1 of them at most: a proven bound.
    reference = m.groupBy("lang").agg(sums("char_hist", len(CLASSES), "char_ref"), sums("word_hist", size, "word_ref"), F.sum("chars").alias("char_sum"), F.sum("n_words").alias("word_sum")).withColumnRenamed("lang", "ref_lang")
    d = m.join(F.broadcast(reference), F.col("lang") == F.col("ref_lang"))
    d = d.withColumn("char_distance", F.when(F.col("chars") >= MIN_CHARS, js_distance(F.col("char_hist"), F.col("char_ref"), F.col("chars"), F.col("char_sum"))))
    d = d.withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, js_distance(F.col("word_hist"), F.col("word_ref"), F.col("n_words"), F.col("word_sum"))))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return d.select(
        F.col("row_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~far).alias("kept"), "char_distance", "word_distance",
    )
