"""Language-model scores by subword lattice likelihood.

A word's probability under the subword model is the sum over all its segmentations into vocabulary pieces, got by a forward
recursion in log space; pieces never cross white space, so a document's lattice factors into its words. Piece weights
start from the scores of an existing vocabulary and are adapted to the training documents of each class by expectation steps in which
the current weights weigh all segmentations of the class's distinct words, as it is unseen words that the pieces answer for. Classes are the ``CLASSES`` most frequent languages of the training documents and
the rest; a document's class is summed out, so nothing but the text decides its score. In each class the word itself is one more arc,
with absolute discounting first to all classes together, then to the lattice (c: training count of N tokens and V types; u: the share of tokens
whose word stands in one training text only, which is the share of unseen words that a further text is expected to have):

    p(word | class) = max(c_class - d, 0) / N_class + (d * V_class / N_class) * p(word)
    p(word)         = (1 - u) * max(c - d, 0) / (N - d * V) + u * p_lattice(word | class)
    p(text)         = sum over classes of share(class) * product over words of p(word | class)

Each text ends in one end token. Counting, adaptation and lattice scores run once per distinct word, spread over the cluster. Documents
then look their words up: the ``HEAD`` most frequent words are sent to the workers (a fixed bound), all others meet their scores in a
shuffle join.

Null texts are empty: one end token. Repeated rows count as often as they stand. A null id counts as training. Very long texts are read whole, a
block each. Languages with as many documents rank by name. An empty table gives an empty result. Only the id, the text and (for training documents) the language are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.byte_cnn import held_out
from tessera.llm.store import cut
from tessera.llm.textbytes import Block, blocks, spark_long, string_parts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HEAD, PASSES, LONGEST, CLASSES, SCALE = 150_000, 5, 24, 5, 8.0
FLUSH = 150_000  # distinct words that a worker holds before it hands them on
PAD = 256  # read behind a word's end; no byte
_MARK = "▁".encode()
_LOG10 = math.log(10.0)


def load_pieces(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a SentencePiece vocabulary and their log weights.

    A vocabulary whose scores are merge ranks has no likelihoods; a piece of rank r then weighs 1 / (r + 2.7).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        score = model.get_score(i)
        if model.is_byte(i):
            piece, w = bytes([int(model.id_to_piece(i)[3:5], 16)]), 1e-7
        elif model.is_control(i) or model.is_unknown(i) or score < -1e8:
            continue
        else:
            piece, w = model.id_to_piece(i).encode(), 1 / (2.7 - score) if score <= -2 and score == int(score) else math.exp(score)
        if len(piece) <= LONGEST:
            weight[piece] = weight.get(piece, 0.0) + w
    names = sorted(weight)
    p = np.array([weight[n] for n in names])
    return names, np.log(p / p.sum())


@lru_cache(maxsize=2)
def trie(pieces: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All beginnings of the pieces as nodes, the empty one first, their steps in one flat table (rows with gaps, laid over one another).

    From a node, byte b leads to slot ``base[node] + b``; if ``owner`` of that slot is the node, ``to`` is the next one. ``piece`` is a node's piece or -1.
    """
    number: dict[bytes, int] = {b"": 0}
    steps: list[list[tuple[int, int]]] = [[]]
    for x in pieces:
        at = 0
        for i in range(len(x)):
            node = number.setdefault(x[: i + 1], len(steps))
            if node == len(steps):
                steps.append([])
                steps[at].append((x[i], node))
            at = node
    free, after = 0, 2 * len(steps) + 1024
    owner, to = [-1] * after, [0] * after
    base, piece = np.zeros(len(steps), np.int32), np.full(len(steps), -1, np.int32)
    for node in sorted(range(len(steps)), key=lambda i: -len(steps[i])):
        if not steps[node]:
            break
        low, spare = steps[node][0][0], 0
        while owner[free] >= 0:
            free += 1
        slot = max(free, low)
        while any(owner[slot - low + b] >= 0 for b, _ in steps[node]):
            slot, spare = slot + 1, spare + 1
            if slot + PAD >= len(owner):
                owner += [-1] * after
                to += [0] * after
        if spare > 30 and len(steps[node]) > 1:
            free = min(slot, free + 100)  # a crowded stretch is left behind
        base[node] = slot - low
        for b, child in steps[node]:
            owner[slot - low + b], to[slot - low + b] = node, child
    used = max((i for i, x in enumerate(owner) if x >= 0), default=0) + 1
    base[[i for i, x in enumerate(steps) if not x]] = used  # nothing follows
    piece[[number[x] for x in pieces]] = np.arange(len(pieces))
    return base, np.array(owner[:used] + [-1] * (PAD + 1), np.int32), np.array(to[:used] + [0] * (PAD + 1), np.int32), piece


class Lattice:
    """Segmentations of words under one set of piece weights a class."""

    def __init__(self, pieces: list[bytes], logp: list[np.ndarray], stop: list[float]):
        self.trie = trie(tuple(pieces))
        self.longest = max(len(x) for x in pieces)
        self.size = len(pieces)
        self.logp = [p + math.log1p(-q) for p, q in zip(logp, stop, strict=True)]
        self.end = [math.log(q) - math.log1p(-q) for q in stop]

    def _arcs(self, data: np.ndarray, offs: np.ndarray, rows: np.ndarray, width: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, piece ids) of all pieces in the given words; byte i of the k-th word is place i * len(rows) + k.

        All places walk down the trie together, and leave when no piece begins with what was read.
        """
        base, owner, to, piece = self.trie
        n = len(rows)
        at = offs[rows] + np.arange(width)[:, None]
        inside = at < offs[rows + 1]
        read = np.full((width + self.longest) * n, PAD, np.int32)
        where = np.flatnonzero(inside)
        read[where] = data[at.ravel()[where]]
        node, out = np.zeros(len(where), np.int32), []
        for length in range(1, self.longest + 1):
            slot = base[node] + read[where + (length - 1) * n]
            on = np.flatnonzero(owner[slot] == node)
            if not len(on):
                break
            where, node = where[on], to[slot[on]]
            ids = piece[node]
            hit = np.flatnonzero(ids >= 0)
            if len(hit):
                out.append((length, where[hit], ids[hit]))
        return out

    @staticmethod
    def _spread(values: np.ndarray, where: np.ndarray, places: int, rows: int, empty: float) -> np.ndarray:
        """Values of arcs as a table by place and row."""
        out = np.full(places * rows, empty, values.dtype)
        out[where] = values
        return out.reshape(places, rows)

    @staticmethod
    def _groups(n: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """Places of words of like length."""
        low = 0
        for high in (8, 12, 16, 24, 40, *(2**k for k in range(6, 40))):
            rows = np.flatnonzero((n > low) & (n <= high))
            step = max(1, 150_000 // max(1, high))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                yield part, int(n[part].max())
            low = high
            if high >= n.max(initial=0):
                return

    @staticmethod
    def _lse(terms: list[np.ndarray]) -> np.ndarray:
        m = np.stack(terms)
        top = m.max(axis=0)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            return safe + np.log(np.exp(m - safe).sum(axis=0))

    def _forward(self, cls: int, arcs, rows: int, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Log probabilities of all beginnings of the words, and the weights of the arcs by place."""
        weights = [self._spread(self.logp[cls][ids], where, width - length + 1, rows, -np.inf) for length, where, ids in arcs]
        alpha = np.full((width + 1, rows), -np.inf)
        alpha[0] = 0
        for i in range(1, width + 1):
            terms = [alpha[i - length] + w[i - length] for (length, *_), w in zip(arcs, weights, strict=True) if length <= i]
            if terms:
                alpha[i] = self._lse(terms)
        return alpha, weights

    @staticmethod
    def _sums(arcs, weights: list[np.ndarray], rows: int, width: int) -> np.ndarray:
        """As ``_forward``, with the plain products of weights by place."""
        alpha = np.zeros((width + 1, rows))
        alpha[0] = 1
        for i in range(1, width + 1):
            for (length, *_), w in zip(arcs, weights, strict=True):
                if length <= i:
                    alpha[i] += alpha[i - length] * w[i - length]
        return alpha

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Natural-log probability of each word in each class, summed over its segmentations.

        Probabilities are taken times SCALE a byte; words with a beginning that still nears the end of the range of floats go by logarithms.
        """
        out = np.tile(np.array(self.end), (len(offs) - 1, 1))
        n = np.diff(offs)
        for rows, width in self._groups(n):
            arcs, last, at = self._arcs(data, offs, rows, width), n[rows], np.arange(len(rows))
            for cls, logp in enumerate(self.logp):
                weights = [self._spread(np.exp(logp[ids] + length * math.log(SCALE)), where, width - length + 1, len(rows), 0.0) for length, where, ids in arcs]
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    alpha = self._sums(arcs, weights, len(rows), width)
                    fine = (((alpha > 1e-250) & (alpha < 1e250)) | (alpha == 0)).all(axis=0)
                    z = alpha[last, at]
                    fine &= z > 0
                    out[rows, cls] += np.where(fine, np.log(z) - last * math.log(SCALE), 0.0)
                rest = rows[~fine]
                if len(rest):
                    alpha, _ = self._forward(cls, self._arcs(data, offs, rest, width), len(rest), width)
                    out[rest, cls] += alpha[n[rest], np.arange(len(rest))]
        return out

    def expected(self, cls: int, data: np.ndarray, offs: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in one class when each word occurs ``count`` times."""
        return self.uses([cls], data, offs, [count])[0]

    def uses(self, classes: list[int], data: np.ndarray, offs: np.ndarray, counts: list[np.ndarray]) -> np.ndarray:
        """Expected uses of each piece in each class, whose words occur as often as ``counts`` has it.

        Probabilities are taken times SCALE a byte, which cancels out; words for which that still leaves the range of floats go by logarithms.
        """
        total, n = np.zeros((len(classes), self.size)), np.diff(offs)
        of, word = np.nonzero(np.stack(counts) > 0)  # each word once for each class that has it
        count = np.stack(counts)[of, word]
        weight = np.exp(np.stack([self.logp[cls] for cls in classes])).ravel()
        keys, posts = [], []
        for part, width in self._groups(n[word]):
            rows, rows_n, first = word[part], len(part), of[part] * self.size
            row = np.tile(np.arange(rows_n), width)
            arcs = self._arcs(data, offs, rows, width)
            key = [ids + first[row[where]] for _, where, ids in arcs]
            flat = [weight[k] * SCALE**length for (length, *_), k in zip(arcs, key, strict=True)]
            weights = [self._spread(w, where, width - length + 1, rows_n, 0.0) for (length, where, _), w in zip(arcs, flat, strict=True)]
            last, at = n[rows], np.arange(rows_n)
            beta = np.zeros((width + 1, rows_n))
            beta[last, at] = 1
            with np.errstate(over="ignore", invalid="ignore"):
                alpha = self._sums(arcs, weights, rows_n, width)
                for i in range(width - 1, -1, -1):
                    for (length, *_), w in zip(arcs, weights, strict=True):
                        if i + length <= width:
                            beta[i] += w[i] * beta[i + length]
                fine = np.isfinite(alpha).all(axis=0) & np.isfinite(beta).all(axis=0)
                z = alpha[last, at]
                fine &= (z > 1e-250) & (z < 1e250)
                share = np.where(fine, count[part] / np.where(fine, z, 1.0), 0.0)
                for (length, where, _), k, w in zip(arcs, key, flat, strict=True):
                    post = alpha.ravel()[where] * w * beta.ravel()[where + length * rows_n] * share[row[where]]
                    used = post > 0
                    keys.append(k[used])
                    posts.append(post[used])
            if sum(map(len, keys)) > 1_000_000:
                total += np.bincount(np.concatenate(keys), np.concatenate(posts), total.size).reshape(total.shape)
                keys, posts = [], []
            for i in np.unique(of[part][~fine]):
                total[i] += self._expected_by_logs(classes[i], data, offs, rows[~fine & (of[part] == i)], width, counts[i])
        if keys:
            total += np.bincount(np.concatenate(keys), np.concatenate(posts), total.size).reshape(total.shape)
        return total

    def _expected_by_logs(self, cls: int, data: np.ndarray, offs: np.ndarray, rows: np.ndarray, width: int, count: np.ndarray) -> np.ndarray:
        arcs = self._arcs(data, offs, rows, width)
        alpha, weights = self._forward(cls, arcs, len(rows), width)
        total, last = np.zeros(self.size), np.diff(offs)[rows]
        z = alpha[last, np.arange(len(rows))]
        beta = np.full((width + 1, len(rows)), -np.inf)
        for i in range(width, -1, -1):
            terms = [w[i] + beta[i + length] for (length, *_), w in zip(arcs, weights, strict=True) if i + length <= width]
            beta[i] = self._lse([*terms, np.where(last == i, 0.0, -np.inf)])
        for (length, where, ids), w in zip(arcs, weights, strict=True):
            i, r = np.divmod(where, len(rows))
            with np.errstate(invalid="ignore"):
                post = np.exp(alpha[i, r] + w[i, r] + beta[i + length, r] - z[r]) * count[rows][r]
            total += np.bincount(ids, np.nan_to_num(post), self.size)
        return total


def marked(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words, each behind the mark that starts a word."""
    return string_parts(pc.binary_join_element_wise(pa.scalar(_MARK.decode()), words, ""))


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def count_words(docs: DataFrame, classes: int) -> DataFrame:
    """docs: (cls, text), cls -1 for held-out rows. Distinct words: h, word, n (tokens), c0 .. (training tokens of each class), df (training texts that hold it)."""
    names = [*(f"c{i}" for i in range(classes)), "df"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def merged() -> pa.Table:
            t = pa.concat_tables(held).combine_chunks().group_by(["h", "word"], use_threads=False)
            return t.aggregate([(x, "sum") for x in ("n", *names)]).select(["h", "word", "n_sum", *(f"{x}_sum" for x in names)]).rename_columns(["h", "word", "n", *names])

        for b in batches:
            cls = b.column(0).to_numpy()
            for k in blocks(b.column(1)):
                s, e, owner = k.words()
                if not len(s):
                    continue
                h = k.hashes(s, e, lower=True)
                order = np.argsort(h, kind="stable")  # equal words together, those of a text next to each other
                h, text = h[order], owner[order]
                begins = np.append(True, h[1:] != h[:-1])
                first, word = order[begins], np.cumsum(begins) - 1
                h, n = h[begins], np.diff(np.append(np.flatnonzero(begins), len(h)))
                of = cls[text + k.first].astype(np.int64)
                by_class = np.bincount(word * (classes + 1) + of + 1, minlength=len(h) * (classes + 1)).reshape(len(h), classes + 1)
                c = {x: by_class[:, i + 1] for i, x in enumerate(names[:-1])}
                begins[1:] |= text[1:] != text[:-1]
                c["df"] = np.bincount(word[begins & (of >= 0)], minlength=len(h))
                offs = np.concatenate(([0], np.cumsum((e - s)[first])))
                low = lower_bytes(k.data)[np.arange(int(offs[-1])) + np.repeat(s[first] - offs[:-1], (e - s)[first])]
                word = pa.LargeStringArray.from_buffers(len(h), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(low)).cast(pa.string())
                held.append(pa.table({"h": spark_long(h), "word": word, "n": n.astype(np.int64), **c}))
                rows += len(h)
                if rows > 2 * FLUSH:
                    held = [merged()]
                    rows = held[0].num_rows
                    if rows > FLUSH:
                        yield from held.pop().to_batches(max_chunksize=100_000)
                        rows = 0
        if held:
            yield from merged().to_batches(max_chunksize=100_000)
            held.clear()
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    made = docs.mapInArrow(apply, "h long, word string, n long, " + ", ".join(f"{x} long" for x in names))
    return made.groupBy("h", "word").agg(*[F.sum(x).alias(x) for x in ("n", *names)])


def adapt(words: DataFrame, classes: int, pieces: list[bytes], start: np.ndarray, passes: int = PASSES) -> tuple[list[np.ndarray], list[float]]:
    """Piece weights of each class after some expectation steps over its training words, and the chance that a word stops after a piece."""
    logp, stop = [start] * classes, [0.3] * classes
    names = [f"c{i}" for i in range(classes)]
    for _ in range(passes):
        lattice = Lattice(pieces, logp, stop)

        def apply(batches: Iterator[pa.RecordBatch], lattice=lattice) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros((classes, lattice.size)), np.zeros(classes)
            for b in batches:
                # Each word counts once, and little if many texts hold it: the lattice is asked about words that none does.
                c = [(b.column(1 + i).to_numpy() > 0) / b.column(1 + classes).to_numpy().clip(1) for i in range(classes)]
                total += lattice.uses(list(range(classes)), *marked(b.column(0)), c)
                seen += [x.sum() for x in c]
            for i in range(classes):
                at = np.flatnonzero(total[i])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, i)), pa.array(np.append(at, -1)), pa.array(np.append(total[i][at], seen[i]))], names=["cls", "piece", "uses"])

        sums = words.select("word", *names, "df").mapInArrow(apply, "cls long, piece long, uses double").groupBy("cls", "piece").agg(F.sum("uses").alias("uses")).collect()  # at most a row a class and piece
        uses, seen = np.zeros((classes, len(pieces))), np.zeros(classes)
        for r in sums:
            if r["piece"] < 0:
                seen[r["cls"]] = r["uses"]
            else:
                uses[r["cls"], r["piece"]] = r["uses"]
        new = []
        for i in range(classes):
            all_ = uses[i].sum()
            if all_ > 0:
                stop[i] = min(0.9, max(0.05, seen[i] / all_))
                # The vocabulary's own weights keep a hundredth of the mass, so that every text has a probability.
                new.append(np.log((uses[i] / all_) * 0.999 + np.exp(start) * 0.001))
            else:
                new.append(start)
        logp = new
    return logp, stop


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The words with counts from some bound on, ``most`` at most; the bound is one of a few hundred steps of the count's logarithm."""
    step = F.floor(F.log(F.col("n").cast("double")) * 16)
    sizes = sorted(((r["step"], r["words"]) for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    bound, held = None, 0
    for at, size in sizes:
        if held + size > most:
            break
        bound, held = at, held + size
    return words.where(step >= bound) if bound is not None else words.limit(0)


def score_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", head: int = HEAD
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) for each row."""
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), folds, fold).alias("held_out"), F.col(text_col).alias("text"), lang.alias("lang"))
    train = rows.where(~F.col("held_out"))
    top = [r["lang"] for r in train.where(F.col("lang").isNotNull()).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(CLASSES - 1).collect()]
    cls = F.lit(len(top))
    for i, x in enumerate(top):
        cls = F.when(F.col("lang") == x, i).otherwise(cls)
    k_all = len(top) + 1
    names = [f"c{i}" for i in range(k_all)]
    counted = cut(count_words(rows.select(F.when(F.col("held_out"), -1).otherwise(cls).cast("int").alias("cls"), "text"), k_all), "words")
    doc_counts = {r["cls"]: r["count"] for r in train.select(cls.alias("cls")).groupBy("cls").count().collect()}
    ends = sum(doc_counts.values())
    whole = sum((F.col(x) for x in names[1:]), F.col(names[0]))
    stats = [f(c).alias(f"{n}_{i}") for i, c in enumerate([*(F.col(x) for x in names), whole]) for n, f in (("n", F.sum), ("v", lambda c: F.sum((c > 0).cast("long"))), ("o", lambda c: F.sum((c == 1).cast("long"))), ("t", lambda c: F.sum((c == 2).cast("long"))))]
    s = counted.agg(*stats, F.sum(F.when(F.col("df") == 1, whole)).alias("alone")).first()

    def law(i: int, more: int) -> tuple[float, float, int]:
        """Discount, share left to the next law, tokens: with ``more`` end tokens."""
        n, v, one, two = ((s[f"{x}_{i}"] or 0) for x in "nvot")
        d = one / (one + 2 * two) if one else 0.5
        return (d, d * (v + (more > 0)) / (n + more), n + more) if n + more else (0.0, 1.0, 1)

    laws = [law(i, doc_counts.get(i, 0)) for i in range(k_all)]
    d_all, share_all, total = law(k_all, ends)
    total = total if s[f"n_{k_all}"] or ends else 0
    # The share of tokens whose word no other text holds is what a further text will have of unseen words; the seen ones make room for it.
    kept = 1 - share_all
    share_all = min(0.5, (s["alone"] or 0) / max(total, 1) or share_all)
    seen = (1 - share_all) / kept if kept > 0 else 1.0
    types = (s[f"v_{k_all}"] or 0) + (ends > 0)
    pieces, start = load_pieces(vocabulary)
    lattice = Lattice(pieces, *adapt(counted, k_all, pieces, start))

    def mixture(c: list[np.ndarray], lat: np.ndarray) -> list[np.ndarray]:
        """log10 p(word | class) for each class; in logarithms, as lattice scores of long words fall below any float."""
        both = sum(c)
        with np.errstate(divide="ignore"):
            out = []
            for i, (d, share, n) in enumerate(laws):
                back = np.logaddexp(np.log(seen * np.maximum(both - d_all, 0) / max(total, 1)), math.log(share_all) + lat[:, i])
                out.append(np.logaddexp(np.log(np.maximum(c[i] - d, 0) / n), math.log(max(share, 1e-12)) + back) / _LOG10)
            return out

    models = [f"m{i}" for i in range(k_all)]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [b.column(3 + i).to_numpy().astype(float) for i in range(k_all)]
            made = mixture(c, lattice.score(*marked(b.column(1))))
            both = sum(c)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array((both > 0).astype(np.int64)), pa.array(np.log10((both + 1) / (total + types + 1))), *(pa.array(x) for x in made)], names=["h", "n", "known", "base", *models]
            )

    weighed = cut(counted.mapInArrow(weigh, "h long, n long, known long, base double, " + ", ".join(f"{m} double" for m in models)), "weights")
    common = frequent(weighed, head).toPandas()  # at most ``head`` rows
    keys = common["h"].to_numpy(np.int64).view(np.uint64)
    place = np.argsort(keys)
    sums_of = ["known", "base", *models]
    sent = docs.sparkSession.sparkContext.broadcast((keys[place], [common[x].to_numpy(float)[place] for x in sums_of]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h_head, values = sent.value
        at, row = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            for k in blocks(b.column(2)):
                s, e, owner = k.words()
                h = k.hashes(s, e, lower=True) if len(s) else np.empty(0, np.uint64)
                i = np.minimum(np.searchsorted(h_head, h), max(0, len(h_head) - 1))
                hit = h_head[i] == h if len(h_head) else np.zeros(len(h), bool)
                mine, got = owner[hit], i[hit]
                sums = [np.bincount(mine, x[got], k.n) if len(h_head) else np.zeros(k.n) for x in values]
                rest = np.flatnonzero(~hit)
                edge = np.searchsorted(owner[rest], np.arange(k.n + 1)).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(edge), pa.array(spark_long(h[rest])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at + row + np.arange(k.n)), b.column(0).slice(k.first, k.n), b.column(1).slice(k.first, k.n), pa.array(np.bincount(owner, minlength=k.n).astype(np.int64) + 1), *(pa.array(x) for x in sums), tail],
                    names=["row", "doc_id", "held_out", "n_tokens", *sums_of, "tail"],
                )
                row += k.n

    found = cut(rows.select("doc_id", "held_out", "text").mapInArrow(look_up, "row long, doc_id long, held_out boolean, n_tokens long, " + ", ".join(f"{x} double" for x in sums_of) + ", tail array<bigint>"), "looked-up")
    tail = found.select("row", F.explode("tail").alias("h"))
    late = tail.join(weighed.select("h", *(F.col(x).alias(f"{x}_late") for x in sums_of)), "h").groupBy("row").agg(*[F.sum(f"{x}_late").alias(f"{x}_late") for x in sums_of])
    plus = lambda x: F.col(x) + F.coalesce(F.col(f"{x}_late"), F.lit(0))
    # The end token has counts but no pieces; unseen, it shares the mass of unseen words.
    end = mixture([np.array([float(doc_counts.get(i, 0))]) for i in range(k_all)], np.full((1, k_all), math.log(1e-4)))
    end_base = math.log10((ends + 1) / (total + types + 1))
    prior = [math.log10((doc_counts.get(i, 0) + 0.5) / (ends + 0.5 * k_all)) for i in range(k_all)]
    logs = [plus(m) + float(end[i][0]) + prior[i] for i, m in enumerate(models)]
    most = F.greatest(*logs) if k_all > 1 else logs[0]
    score = most + F.log10(sum((F.pow(F.lit(10.0), x - most) for x in logs[1:]), F.pow(F.lit(10.0), logs[0] - most)))
    return found.drop("tail").join(late, "row", "left").select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.round(plus("known")).cast("long") + (1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (plus("base") + end_base).alias("base_score"), score.alias("score"),
    )
