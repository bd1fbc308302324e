"""Exact token counts by byte-pair merges, as a dictionary of distinct pieces.

A text is cut into pieces by the pattern of its vocabulary, in the JVM. Pieces are counted inside each text's row, so repeated words cost once, no text is
shuffled and no task holds the pieces of more than one text; each distinct piece of the whole table is merged once, by rank, in Arrow batches; an
equi-join brings its number of tokens back to the texts. A rank file has tens of thousands of entries whatever the table holds, so it goes along with the tasks.

A frequent piece stands in nearly every text. Pieces in more than one of ``HEAD`` (text, piece) rows are at most ``HEAD`` many and join by broadcast; the
others join by shuffle, in as many partitions as ``RARE_ROWS`` rows each take, so a task's memory does not grow with the table. Null and empty texts have
no tokens. A model without a file of its own uses the default file.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.store import cut

# Fixed value: the pattern of pieces of the byte-level vocabularies; white space and letters as Unicode has them.
PIECES = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEAD = 4096
RARE_ROWS = 1 << 20


@dataclass(frozen=True)
class RankFiles:
    """Rank files by model, the file of all other models, and the pattern of pieces that they share."""

    default: str
    by_model: dict[str, str] = field(default_factory=dict)
    pattern: str = PIECES

    @property
    def paths(self) -> list[str]:
        """Each file once, the default file first."""
        return list(dict.fromkeys([self.default, *self.by_model.values()]))

    def of(self, model: Column | None) -> Column:
        """The file of a row's model, as its place in ``paths``."""
        out = F.lit(0)
        for name, path in self.by_model.items() if model is not None else ():
            out = F.when(model == name, F.lit(self.paths.index(path))).otherwise(out)
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token: a line each, the token in base64 and its rank. Read by the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens left when the adjacent pair of the lowest rank, the leftmost of equals, is merged until no pair has a rank."""
    n = len(piece)
    if n < 2 or piece in ranks:
        return min(n, 1)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # where the part that starts here ends, and where the one before it starts
    alive = [True] * n
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    left = n
    while heap:
        _, start, stop = heapq.heappop(heap)
        middle = end[start]
        if not alive[start] or middle >= n or end[middle] != stop:
            continue  # a part of this pair has changed since
        alive[middle], end[start] = False, stop
        left -= 1
        if stop < n:
            before[stop] = start
        for a, c in ((before[start], stop), (start, end[stop] if stop < n else n)):
            if a >= 0 and c > end[a] and (rank := ranks.get(piece[a:c])) is not None:
                heapq.heappush(heap, (rank, a, c))
    return left


def merged(files: list[dict[bytes, int]]):
    """Rows (file, piece, n_rows) -> the same with tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [merge(p.encode(), files[f]) for f, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], ["file", "piece", "n_rows", "tokens"])

    return run


def piece_counts(texts: DataFrame, pattern: str) -> DataFrame:
    """(id, digest, file, pieces) from rows (digest, file, text): each text's distinct pieces with their numbers, array<struct<piece, n>>.

    Pieces are sorted inside the row; a run of equals starts where the piece before differs. Ids hold once the rows are written.
    """
    d = texts.where("text <> ''").select("digest", "file", F.sort_array(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("sorted"))
    places = F.slice(F.sequence(F.lit(0), F.size("sorted")), F.lit(1), F.size("sorted"))
    d = d.withColumn("starts", F.filter(places, lambda i: (i == 0) | (F.get("sorted", i) != F.get("sorted", i - 1))))
    run = lambda start, k: F.struct(F.get("sorted", start).alias("piece"), (F.coalesce(F.get("starts", k + 1), F.size("sorted")) - start).alias("n"))
    return d.select(F.monotonically_increasing_id().alias("id"), "digest", "file", F.transform("starts", run).alias("pieces"))


def dictionary(pieces: DataFrame, files: RankFiles) -> DataFrame:
    """(file, piece, n_rows, tokens) of all distinct pieces of rows (file, piece); tokens come from one merge each."""
    ranks = [read_ranks(path) for path in files.paths]
    distinct = pieces.groupBy("file", "piece").agg(F.count("*").alias("n_rows"))
    return distinct.mapInArrow(merged(ranks), "file int, piece string, n_rows bigint, tokens bigint")


def count_tokens(df: DataFrame, text: str, files: RankFiles, model: str | None = None, name: str = "tokens") -> DataFrame:
    """The rows with the exact number of tokens of their text, by their model's rank file."""
    d = df.withColumn("file__", files.of(F.col(model) if model else None)).withColumn("digest__", F.unhex(F.sha2(F.col(text), 256)))
    texts = cut(piece_counts(d.select(F.col("digest__").alias("digest"), F.col("file__").alias("file"), F.col(text).alias("text")), files.pattern), "pieces")
    pieces = texts.select("id", "file", F.inline("pieces"))
    words = cut(dictionary(pieces, files), "piece-tokens")
    # Frequent pieces by their share of the rows, so their number is bounded whatever the table holds.
    rows = words.agg(F.sum("n_rows")).first()[0] or 0
    frequent = F.col("n_rows") > rows / HEAD
    known = pieces.join(F.broadcast(words.where(frequent).select("file", "piece", "tokens")), ["file", "piece"], "left")
    common = known.where("tokens IS NOT NULL").select("id", F.col("n") * F.col("tokens"))
    parts = rows // RARE_ROWS + 1
    deal = lambda x: x.repartition(parts, "file", "piece")
    rare = deal(known.where("tokens IS NULL").drop("tokens")).join(deal(words.where(~frequent).drop("n_rows")).hint("shuffle_hash"), ["file", "piece"])
    sums = common.union(rare.select("id", F.col("n") * F.col("tokens"))).toDF("id", name).groupBy("id").agg(F.sum(name).alias(name))
    # Copies of a text have one sum each, all the same.
    once = texts.select("id", F.col("digest").alias("digest__"), F.col("file").alias("file__")).join(sums, "id").groupBy("digest__", "file__").agg(F.max(name).alias(name))
    out = d.join(once, ["digest__", "file__"], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return out.drop("digest__", "file__")
