"""Fill-in-the-middle: a document is cut at two unit ends, its middle moves behind prefix and suffix.

A pandas UDF over Arrow batches finds the ends of a text's units (lines, by default) with the regex library and keeps them in one
compact array; two lookups in it give both cuts. Seeds are SHA-256 digests of the document's id, so a rerun or a retried task cuts alike.
Every document is judged by itself: no shuffle, and a task holds one Arrow batch.

Null texts count as empty, empty texts stay plain; a null id seeds from the text "" in its place; repeated rows are cut alike. Texts
that contain a marker stay plain, so ``restore`` is exact for every row. Columns of the input that bear the name of an output column
are replaced, others pass through. Long texts are held whole, once as text and once as output. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINES = r"[^\n]*\n|[^\n]+"
_CUT = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string,output_sha256:string>"


@dataclass(frozen=True)
class Plan:
    """How texts are cut: the salt of the seeds, the pattern of a unit, and shares in per cent (of documents cut, of those as spm)."""

    salt: str = "7"
    unit: str = LINES
    rate: int = 100
    spm: int = 50


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def cut(text: str, doc_id: str, plan: Plan, unit: regex.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, lengths of prefix and middle, and the output of one text."""
    ends = array("Q", (m.end() for m in unit.finditer(text)))
    n = len(ends)
    seed = hashlib.sha256(f"{plan.salt}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(seed[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= plan.rate:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    if h4 % 100 < plan.spm:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def rebuild(output: str, form: str) -> str:
    """The text that ``cut`` was given. Markers stand once each, as a text that holds one stays plain."""
    if form == "plain":
        return output
    front, middle = output.split(MIDDLE)
    one, two = front.split(SUFFIX if form == "psm" else PREFIX)
    prefix, suffix = (one.removeprefix(PREFIX), two) if form == "psm" else (two, one.removeprefix(SUFFIX))
    return prefix + middle + suffix


def cutter(plan: Plan):
    """A pandas UDF (text, id as text) -> what ``cut`` gives, and the output's digest."""

    @F.pandas_udf(_CUT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        unit = regex.compile(plan.unit)
        for texts, ids in batches:
            made = [cut(t or "", i or "", plan, unit) for t, i in zip(texts, ids, strict=True)]
            out = pd.DataFrame(made, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            for c in ("prefix_chars", "middle_chars"):
                out[c] = out[c].astype("Int64")
            out["output_sha256"] = [digest(m[4]) for m in made]
            yield out

    return run


def restorer():
    """A pandas UDF (output, form) -> (text, its digest)."""

    @F.pandas_udf("struct<text:string,sha256:string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for outputs, forms in batches:
            texts = [rebuild(o, f) for o, f in zip(outputs, forms, strict=True)]
            yield pd.DataFrame({"text": texts, "sha256": [digest(t) for t in texts]})

    return run


def fill_in_middle(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with n (units), form, prefix_chars, middle_chars, output and output_sha256."""
    made = cutter(plan)(F.col(text_col), F.col(id_col).cast("string"))
    own = {"n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"}
    rest = [c for c in docs.columns if c.lower() not in own | {"made__"}]
    return docs.withColumn("made__", made).select(*rest, "made__.*")


def restore(cut_docs: DataFrame) -> Column:
    """The exact text, rebuilt from output and form alone, as struct<text, sha256>."""
    return restorer()(cut_docs["output"], cut_docs["form"])
