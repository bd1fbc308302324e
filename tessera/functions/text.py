"""Text functions as Catalyst expressions. Offsets count code points from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PUNCTUATION = ".,;:!?()[]{}'\""


def words_of(words: list[str]) -> Column:
    """A list of words as one constant; made of one literal, as plans of many literals are slow to build."""
    return F.split(F.lit("\x01".join(words)), "\x01") if words else F.array().cast("array<string>")


def listed(word: Column, words: list[str]) -> Column:
    return F.array_contains(words_of(words), word)


def join_messages(messages: Column) -> Column:
    """Contents of the messages, one a line."""
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n")


def full_text(prompt: Column, messages: Column) -> Column:
    """Prompt, then all messages; empty parts are left out."""
    return F.concat_ws("\n", F.nullif(prompt, F.lit("")), F.nullif(join_messages(messages), F.lit("")))


def current_text(prompt: Column, messages: Column) -> Column:
    """The last message if there are messages, else the prompt."""
    return F.coalesce(F.when(F.size(messages) > 0, F.coalesce(F.element_at(messages, -1)["content"], F.lit(""))), prompt, F.lit(""))


def history_text(prompt: Column, messages: Column, last_messages: int | None = None, last_chars: int | None = None) -> Column:
    """What came before the current text: the prompt and earlier messages, of which the last few may be asked for."""
    n = F.size(messages)
    earlier = F.slice(messages, 1, F.greatest(n - 1, F.lit(0)))
    if last_messages and last_messages > 0:
        k = F.least(F.lit(last_messages), F.greatest(n - 1, F.lit(0)))
        earlier = F.when(k > 0, F.slice(messages, n - k, k)).otherwise(F.slice(messages, 1, 0))
    text = F.when(n > 0, F.concat_ws("\n", F.nullif(prompt, F.lit("")), F.when(F.size(earlier) > 0, join_messages(earlier)))).otherwise(F.lit(""))
    text = F.coalesce(text, F.lit(""))
    return F.right(text, F.lit(last_chars)) if last_chars else text


def count_words(text: Column) -> Column:
    """White-space separated words; an empty text has one empty word, as in a split."""
    return F.size(F.split(F.trim(text), r"\s+"))


def real_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def normalize_phrase(text: Column) -> Column:
    """Lower case, punctuation and runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), _PUNCTUATION, " " * len(_PUNCTUATION)), r"\s+", " "))


# The plural endings below, and the patterns and wording of key_phrases and hypotheses.
def singularize(word: Column) -> Column:
    """English plural endings cut by rule: ies, then es after hissing sounds, les/res/nes, other es, then s.

    One pattern with one branch an ending, so that plans hold the word three times and not for every ending.
    """
    shorter = F.regexp_replace(word, r"(?:(?<![lrn])es|(?<=[lrn]e)s|(?<![se])s)\z", "")
    return F.when(F.regexp_like(word, F.lit(r"(?s).ies\z")), F.regexp_replace(word, r"ies\z", "y")).otherwise(shorter)


def normalize_noun(word: Column) -> Column:
    return singularize(F.translate(F.lower(word), _PUNCTUATION, ""))


def preview(text: Column, start: Column, end: Column, radius: int = 40) -> Column:
    """The range and ``radius`` characters around it, white space collapsed, ellipses where text goes on."""
    n = F.length(text)
    lo, hi = F.greatest(F.lit(0), start - radius), F.least(n, end + radius)
    body = F.trim(F.regexp_replace(F.substring(text, (lo + 1).cast("int"), (hi - lo).cast("int")), r"\s+", " "))
    return F.concat(F.when(lo > 0, F.lit("…")).otherwise(F.lit("")), body, F.when(hi < n, F.lit("…")).otherwise(F.lit("")))


_FIND_ALL = """CASE WHEN regexp_like({t}, {p}) THEN aggregate(
  arrays_zip(slice(split({t}, {p}, -1), 1, size(regexp_extract_all({t}, {p}, 0))), regexp_extract_all({t}, {p}, 0), regexp_extract_all({t}, {p}, {g})),
  named_struct('at', 0L, 'out', CAST(array() AS {kind})),
  (acc, z) -> named_struct('at', acc.at + length(z.`0`) + length(z.`1`), 'out', concat(acc.out, array(named_struct('text', z.`1`, 'value', z.`2`,
    'start', acc.at + length(z.`0`), 'end', acc.at + length(z.`0`) + length(z.`1`))))),
  acc -> acc.out) ELSE CAST(array() AS {kind}) END"""


def find_all(text: Column | str, pattern: str, group: int = 0) -> Column:
    """All matches, leftmost first, as array<struct<text, value, start, end>>; value is the group.

    The pieces between matches and the matches themselves tell each match's offset, summed in one fold. Given the name of a column, the same
    is said as one SQL text, which is quicker to build.
    """
    if isinstance(text, str):
        return F.expr(_FIND_ALL.format(t=f"`{text}`", p=f"r'{pattern}'", g=group, kind="array<struct<text:string,value:string,start:bigint,end:bigint>>"))
    p = F.lit(pattern)
    gaps, whole, part = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<text:string,value:string,start:bigint,end:bigint>>").alias("out"))

    def step(acc, z):
        start = acc["at"] + F.length(z["g"])
        end = start + F.length(z["w"])
        m = F.struct(z["w"].alias("text"), z["v"].alias("value"), start.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(m)).alias("out"))

    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("g"), whole.alias("w"), part.alias("v"))
    return F.when(F.regexp_like(text, p), F.aggregate(zipped, zero, step)["out"]).otherwise(zero["out"])


def occurrences(text: Column, pattern: str, radius: int = 50) -> Column:
    """All matches as array<struct<text, start, end, context>>; the context is the match and ``radius`` characters on both sides."""

    def around(m):
        lo = F.greatest(m["start"] - radius, F.lit(0))
        return F.substring(text, (lo + 1).cast("int"), (m["end"] + radius - lo).cast("int"))

    return F.transform(find_all(text, pattern), lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), around(m).alias("context")))


def iso_date(ts: Column) -> Column:
    """A time as ISO 8601 in UTC with milliseconds."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def seeded_units(seed: Column, n: int) -> Column:
    """``n`` numbers from 0 to 1 of a 32-bit xorshift generator that starts from the seed (0: from 123456789)."""
    low = F.lit(0xFFFFFFFF)
    start = seed.cast("long").bitwiseAND(low)

    def step(acc, _):
        x = acc["x"]
        x = x.bitwiseXOR(F.shiftleft(x, 13).bitwiseAND(low))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 17))
        x = x.bitwiseXOR(F.shiftleft(x, 5).bitwiseAND(low))
        return F.struct(x.alias("x"), F.concat(acc["out"], F.array(x / low)).alias("out"))

    zero = F.struct(F.when(start == 0, F.lit(123456789).cast("long")).otherwise(start).alias("x"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), zero, step)["out"]


def word_pattern(word: Column, before: str = "") -> Column:
    """Pattern of the word, maybe with a plural s, between ASCII word boundaries; the word is quoted."""
    return F.concat(F.lit("(?i)(?<![A-Za-z0-9_])" + before + r"\Q"), word, F.lit(r"\Es?(?![A-Za-z0-9_])"))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def chunks(text: Column, size: int = 500, overlap: int = 100) -> Column:
    """Overlapping pieces of ``size`` characters; a short text is one piece."""
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(stride))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size))))


def sentences(text: Column) -> Column:
    """Sentences of more than 10 characters."""
    return F.filter(F.transform(F.split(text, r"[.!?]+\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)


def key_phrases(text: Column, most: int = 10) -> Column:
    """Distinct "the X" and "X above/below/..." phrases of 6 to 49 characters, the first ``most``."""
    a = F.regexp_extract_all(text, F.lit(r"(?i)(?<![A-Za-z0-9_])the\s+([a-z][a-z0-9_\s-]{2,20})(?![A-Za-z0-9_])"), F.lit(0))
    b = F.regexp_extract_all(text, F.lit(r"(?i)(?<![A-Za-z0-9_])([a-z][a-z0-9_\s-]{2,20})\s+(above|below|earlier|previously|aforementioned|mentioned)(?![A-Za-z0-9_])"), F.lit(0))
    fit = F.filter(F.concat(a, b), lambda x: (F.length(x) > 5) & (F.length(x) < 50))
    return F.slice(F.array_distinct(fit), 1, most)


def hypotheses(reference: Column) -> Column:
    """Five statements that a context would entail if it held the reference's noun."""
    ref = normalize_phrase(reference)
    found = F.regexp_extract(ref, r"(?<![A-Za-z0-9_])(the|this|that|these|those|aforementioned)\s+([a-z][a-z0-9_-]{2,})(?![A-Za-z0-9_])", 2)
    head = F.when(found != "", found).otherwise(F.element_at(F.split(ref, r"\s+"), -1))
    say = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    return F.array(say("There is ", head), say("The ", head, " was mentioned"), say("A ", head, " exists"), say("The context refers to ", head), say("There exists ", ref))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for different lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)
