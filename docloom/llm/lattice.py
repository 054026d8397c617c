"""Language-model scoring: the marginal likelihood of a text over all segmentations of its words.

A word's lattice has the pieces of an existing vocabulary as arcs, and one more arc over the whole word if training had it,
one over its stem if training had that.  Its probability is the sum over all paths, by a forward recursion in logs.  The
vocabulary's own scores give the pieces their first weights, and expectation maximisation over the distinct training stems
adapts them.  A whole-word arc has the word's discounted share of the training tokens; what the discount frees goes to the other
paths, times the chance of the word's last mark of punctuation (or none) and of the stem before it.  A stem's arc likewise has
its discounted share of the distinct training words, and the pieces share what that frees.  So what training gathers (the
words) grows with it, and all shares sum to one.  ``lattice_score`` is the same without the arcs of words and stems: pieces only.

Words are counted in the blocks (runs of rows of a file, by their numbers there) where they stand; each distinct stem and word is
scored once and joined back to its blocks, and a block's documents meet just that block's words, so nothing is sent to all
tasks.  A row's number does not depend on how files are split, so a later scan finds the same blocks.  Rows that are not read
from files (derived from others) have no number; their blocks come from a hash of the id and the text's length.  A very long
word is walked in windows of positions.

Edge cases: a null or empty text is the end alone; without training tokens all words are unknown and the end too, and the
model is the lattice alone with one half for the end; repeated rows are counted and scored each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.arrays import Spans, slices
from docloom.llm.common import staged

ROUNDS = 2
#: Bytes of text in a block, on average, and blocks in a task of the last step.
TEXT_BLOCK, BLOCKS = 1 << 25, 2
#: Bytes from which a word is walked by itself, and positions in a window of it.
LONG_WORD, WINDOW = 1024, 1 << 13
#: Words of the vocabulary's own weights that are added to what the corpus shows.
PRIOR = 2000.0
_MARK = "▁".encode()
_NEVER = -1e30
#: Marks of punctuation that are split from the end of a word.
TAILS = [".", ",", ";", ":", "!", "?"]


class Lattice:
    """Pieces of a vocabulary and their weights: of those that begin a word, and of those that go on or end it."""

    def __init__(self, model_file: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=model_file)
        found: dict[bytes, float] = {bytes([b]): _NEVER for b in range(256)}
        for i in range(own.get_piece_size()):
            if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i)):
                found[own.id_to_piece(i).encode()] = max(own.get_score(i), found.get(own.id_to_piece(i).encode(), _NEVER))
        self.pieces = sorted(found)
        score = np.array([found[p] for p in self.pieces])
        self.begins = np.array([p.startswith(_MARK) for p in self.pieces])
        self.longest = max(map(len, self.pieces))
        # The scores are ranks of merges: weights fall with the rank as frequencies do (Zipf and Mandelbrot).
        rank = np.where(score <= -1e8, len(score), -score)
        self.own = 1.0 / (np.minimum(np.maximum(rank, 0), len(score)) + 2.7)
        joined = np.frombuffer(b"".join(self.pieces), np.uint8)
        ends = np.cumsum([len(p) for p in self.pieces])
        hashes = Spans(joined).hash(ends - [len(p) for p in self.pieces], ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(hashes >> np.uint64(42)).astype(np.int64)] = True
        self.learn(np.zeros(len(self.pieces)), 0.0)

    def learn(self, counts: np.ndarray, words: float) -> None:
        """Set the weights from expected counts of pieces in so many words, with the vocabulary's own as a prior."""
        begin = np.where(self.begins, self.own, 0.0)
        go_on = np.where(self.begins, 0.0, self.own)
        stop = begin.sum() / (begin.sum() + go_on.sum())
        first = np.where(self.begins, counts, 0) + PRIOR * begin / begin.sum()
        rest = np.where(self.begins, 0, counts) + PRIOR * (1 - stop) * go_on / go_on.sum()
        end = words + PRIOR * stop
        total = rest.sum() + end
        with np.errstate(divide="ignore"):
            self.weight = np.log(np.where(self.begins, first / first.sum(), rest / total))
        self.stop = math.log(end / total)

    def arcs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of words of one length: (word, begin, length, piece) of every piece that stands in one."""
        size = len(words[0]) + len(_MARK)
        raw = np.frombuffer(b"".join(_MARK + w for w in words), np.uint8)
        most = min(size, self.longest)
        at, long = np.meshgrid(np.arange(size), np.arange(1, most + 1), indexing="ij")
        ok = (at + long <= size) & ((at == 0) | (at >= len(_MARK))) & ((at > 0) | (long >= len(_MARK)))
        at, long = at[ok], long[ok]
        starts = (np.arange(len(words)) * size)[:, None] + at
        hashes = Spans(raw).hash(starts, starts + long)
        word, arc = np.nonzero(self.maybe[(hashes >> np.uint64(42)).astype(np.int64)])
        h = hashes[word, arc]
        found = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[found] == h
        word, arc = word[hit], arc[hit]
        return word, at[arc], long[arc], self.order[found[hit]]

    def _forward(self, n: int, size: int, most: int, dense: np.ndarray) -> np.ndarray:
        alpha = np.full((n, size + 1), _NEVER)
        alpha[:, 0] = 0
        for j in range(1, size + 1):
            steps = np.arange(max(0, j - most), j)
            terms = alpha[:, steps] + dense[:, steps, j - steps - 1]
            top = terms.max(axis=1)
            alpha[:, j] = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
        return alpha

    def _windows(self, word: bytes, reverse: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(begin, end, piece) of the arcs of one word that end in each window of positions, by end (or that begin there, from the last begin)."""
        raw = np.frombuffer(_MARK + word, np.uint8)
        size, spans, longs = len(raw), Spans(raw), np.arange(1, self.longest + 1)
        starts = range(0, size, WINDOW)
        for start in reversed(starts) if reverse else starts:
            own = np.arange(start, min(size, start + WINDOW)) + (0 if reverse else 1)
            near, long = np.meshgrid(own, longs, indexing="ij")
            begin, end = (near, near + long) if reverse else (near - long, near)
            ok = (begin >= 0) & (end <= size) & ((begin == 0) | (begin >= len(_MARK))) & ((begin > 0) | (end >= len(_MARK)))
            begin, end = begin[ok], end[ok]
            hashes = spans.hash(begin, end)
            maybe = np.flatnonzero(self.maybe[(hashes >> np.uint64(42)).astype(np.int64)])
            found = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            hit = self.hashes[found] == hashes[maybe]
            at, piece = maybe[hit], self.order[found[hit]]
            if reverse:
                at, piece = at[::-1], piece[::-1]
            yield begin[at], end[at], piece

    def _recur(self, word: bytes, reverse: bool = False) -> np.ndarray:
        """Logs of the sums over paths from the word's start to each position (from each position to its end), in scaled numbers."""
        size = len(word) + len(_MARK)
        out = np.full(size + 1, _NEVER)
        at0 = size if reverse else 0
        out[at0] = 0.0
        live, scale = {at0: 1.0}, 0.0
        for begin, end, piece in self._windows(word, reverse):
            near, far = (begin, end) if reverse else (end, begin)
            weight = np.exp(self.weight[piece]).tolist()
            edges = np.flatnonzero(np.diff(near, prepend=-1)).tolist() + [len(near)]
            far, places = far.tolist(), near[edges[:-1]].tolist()
            for k, j in enumerate(places):
                total = 0.0
                for a in range(edges[k], edges[k + 1]):
                    total += live.get(far[a], 0.0) * weight[a]
                if total > 0:
                    out[j] = scale + math.log(total)
                    live[j] = total
                live.pop(j + self.longest if reverse else j - self.longest, None)
                if 0 < total < 1e-30:
                    live = {p: x / total for p, x in live.items()}
                    scale += math.log(total)
        return out

    def _long_marginal(self, word: bytes, counts: np.ndarray | None) -> float:
        """``marginals`` of one word in memory that is a few numbers a byte."""
        ahead = self._recur(word)
        if counts is not None:
            back = self._recur(word, reverse=True)
            for begin, end, piece in self._windows(word):
                counts += np.bincount(piece, np.exp(ahead[begin] + self.weight[piece] + back[end] - ahead[-1]), len(counts))
        return ahead[-1] + self.stop

    def marginals(self, words: list[bytes], counts: np.ndarray | None = None) -> np.ndarray:
        """The log probability of each word; with ``counts``, its expected pieces are added there."""
        out = np.zeros(len(words))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            n = len(words[order[at]])
            if n >= LONG_WORD:
                out[order[at]] = self._long_marginal(words[order[at]], counts)
                at += 1
                continue
            most = max(1, min(2048, 400_000 // (n + 3) ** 2))
            part = [i for i in order[at : at + most] if len(words[i]) == n]
            at += len(part)
            size, longest = n + len(_MARK), min(n + len(_MARK), self.longest)
            word, begin, long, piece = self.arcs([words[i] for i in part])
            dense = np.full((len(part), size, longest), _NEVER)
            dense[word, begin, long - 1] = self.weight[piece]
            alpha = self._forward(len(part), size, longest, dense)
            out[part] = alpha[:, size] + self.stop
            if counts is not None:
                back = np.full((len(part), size + 1), _NEVER)
                back[:, size] = 0
                for j in range(size - 1, -1, -1):
                    steps = np.arange(1, min(longest, size - j) + 1)
                    terms = back[:, j + steps] + dense[:, j, steps - 1]
                    top = terms.max(axis=1)
                    back[:, j] = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
                share = np.exp(alpha[word, begin] + dense[word, begin, long - 1] + back[word, begin + long] - alpha[word, size])
                counts += np.bincount(piece, share, len(counts))
        return out


_made: dict[str, Lattice] = {}


def lattice_of(path: str, weight: np.ndarray | None = None, stop: float | None = None) -> Lattice:
    if path not in _made:
        _made[path] = Lattice(path)
    own = _made[path]
    if weight is not None:
        own.weight, own.stop = weight, stop
    return own


def word_counts(docs: DataFrame) -> DataFrame:
    """(block, word, c): the words of each block of ``docs`` (block, trains, body) and their training count there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained: dict[int, Counter] = {}
        others: dict[int, set] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for block in {*trained, *others}:
                seen = trained.get(block, Counter())
                rest = [w for w in others.get(block, ()) if w not in seen]
                words = [*seen, *rest]
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block, np.int64)), pa.array(words, pa.binary()), pa.array([*seen.values()] + [0] * len(rest), pa.int64())], names=["block", "word", "c"])
            trained.clear()
            others.clear()

        for batch in slices(batches, "body"):
            for block, trains, body in zip(batch.column("block").to_pylist(), batch.column("trains").to_pylist(), batch.column("body").to_pylist()):
                words = body.encode().lower().split()
                if trains:
                    trained.setdefault(block, Counter()).update(words)
                else:
                    others.setdefault(block, set()).update(words)
            if sum(map(len, trained.values())) + sum(map(len, others.values())) > 1_000_000:
                yield from flush()
        yield from flush()

    return docs.select("block", "trains", "body").mapInArrow(run, "block long, word binary, c long")


def _expect(stems: DataFrame, path: str, weight: np.ndarray, stop: float, size: int) -> np.ndarray:
    """Expected counts of pieces over the distinct training stems; as many rows come back as the vocabulary has pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = lattice_of(path, weight, stop), np.zeros(size)
        for batch in batches:
            own.marginals(batch.column("stem").to_pylist(), counts)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["piece", "n"])

    found = stems.where("c > 0").select("stem").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size)
    for r in found:
        out[r.piece] = r.n
    return out


def _shares(counted: DataFrame) -> tuple[int, int, float]:
    """(sum, number, discount) of the counts above 0; the discount is the usual one from counts of 1 and of 2."""
    r = counted.where("c > 0").agg(F.count("*").alias("v"), F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("one"), F.sum((F.col("c") == 2).cast("long")).alias("two")).first()
    discount = r.one / (r.one + 2 * r.two) if r.one else 0.5
    return r.n or 0, r.v, min(max(discount, 0.1), 0.9)


def numbered(docs: DataFrame) -> bool:
    """Whether the rows come straight from files that number them."""
    try:
        return bool(docs.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:
        return False


def score_documents(docs: DataFrame, held_out: Column, model_file: str, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score (add-one counts), score, lattice_score; logs to base 10."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    trains = ~F.coalesce(held_out, F.lit(False))
    seen = docs.agg(F.count_if(trains).alias("ends"), F.count("*").alias("rows"), F.sum(F.octet_length(text)).alias("size")).first()
    ends, size = seen.ends, seen.size or 0
    block = F.pmod(F.xxhash64(key, F.length(text)), F.lit(size // TEXT_BLOCK + 1))
    if numbered(docs):
        block = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / max(1, TEXT_BLOCK * seen.rows // max(1, size))))
    docs = docs.select(F.col(key), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("body"), block.alias("block")).withColumn("trains", ~F.col("held_out"))

    in_blocks = staged(word_counts(docs), "words")
    vocabulary = staged(in_blocks.groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    n_all, v_words, discount = _shares(vocabulary)
    n_all, n_types = n_all + ends, v_words + (ends > 0)
    free = math.log(discount * n_types / n_all) if n_all else math.log(0.5)

    word = F.decode("word", "UTF-8")
    tail = F.when((F.length(word) > 1) & F.substring(word, -1, 1).isin(*TAILS), F.substring(word, -1, 1)).otherwise("")
    cut = vocabulary.select("word", "c", tail.alias("tail")).withColumn("stem", F.expr("substring(word, 1, length(word) - length(tail))"))
    stems = staged(cut.groupBy("stem").agg(F.sum((F.col("c") > 0).cast("long")).alias("c")), "stems")
    # One row for each mark of punctuation.
    tails = {r["tail"]: r["n"] for r in cut.where("c > 0").groupBy("tail").agg(F.count("*").alias("n")).collect()}
    chance = {t: (tails.get(t, 0) + 1) / (sum(tails.values()) + len(TAILS) + 1) for t in ["", *TAILS]}
    n_stems, v_stems, less = _shares(stems)

    lattice = lattice_of(model_file)
    lattice.learn(np.zeros(len(lattice.pieces)), 0.0)
    for _ in range(rounds if v_stems else 0):
        lattice.learn(_expect(stems, model_file, lattice.weight, lattice.stop, len(lattice.pieces)), float(v_stems))
    weight, stop = lattice.weight, lattice.stop
    freed = math.log(less * v_stems / n_stems) if n_stems else 0.0

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice_of(model_file, weight, stop)
        for batch in batches:
            c = np.asarray(batch.column("c")).astype(np.float64)
            pieces = own.marginals(batch.column("stem").to_pylist())
            spelled = freed + pieces
            counted = np.log(np.maximum(c - less, 1e-300) / max(n_stems, 1))
            yield pa.RecordBatch.from_arrays([batch.column("stem"), pa.array(np.where(c > 0, np.logaddexp(counted, spelled), spelled)), pa.array(pieces)], names=["stem", "log_stem", "log_pieces"])

    weighed = cut.join(stems.mapInArrow(weigh, "stem binary, log_stem double, log_pieces double"), "stem")
    log_tail = F.lit(math.log(chance[""]))
    for t in TAILS:
        log_tail = F.when(F.col("tail") == t, F.lit(math.log(chance[t]))).otherwise(log_tail)
    back = F.lit(free) + log_tail + F.col("log_stem")
    share = F.when(F.col("c") > 0, F.log((F.col("c") - discount) / max(n_all, 1) + F.exp(back))).otherwise(back)
    goes_on = math.log(1 - (ends - discount) / n_all) if ends and n_all > ends - discount else math.log(0.5)
    logs = [(x / math.log(10)).cast("float").alias(name) for x, name in ((share, "logp"), (F.lit(goes_on) + log_tail + F.col("log_pieces"), "pieces"))]
    here = in_blocks.select("block", "word").join(weighed.select("word", "c", *logs), "word").select("block", "word", "c", "logp", "pieces")
    n_blocks = in_blocks.select("block").distinct().count()
    base_end = math.log10((ends + 1) / (n_all + n_types)) if n_all else 0.0
    end = math.log10((ends - discount) / n_all) if ends else math.log10(0.5)
    kind = T.StructType([docs.schema[key], *T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double").fields])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        at = {w: i for i, w in enumerate(right.column("word").to_pylist())}
        c = right.column("c").to_numpy().astype(np.float64)
        logs = np.stack([np.log10((c + 1) / max(1, n_all + n_types)), right.column("logp").to_numpy().astype(np.float64), right.column("pieces").to_numpy().astype(np.float64), (c > 0).astype(np.float64)])
        rows = []
        for batch in slices(left.to_batches(), "body"):
            for body in batch.column("body").to_pylist():
                words = body.encode().lower().split()
                sums = logs[:, np.fromiter(map(at.__getitem__, words), np.int64, len(words))].sum(axis=1)
                rows.append((len(words) + 1, int(sums[3]) + (ends > 0), n_all, sums[0] + base_end, sums[1] + end, sums[2] + end))
        cols = list(zip(*rows)) or [()] * 6
        return pa.table([left.column(key), left.column("held_out"), *(pa.array(x, pa.int64()) for x in cols[:3]), *(pa.array(x, pa.float64()) for x in cols[3:])], schema=None, names=kind.names)

    # So many tasks that each has few blocks, whatever the session's number.
    tasks = max(parts, n_blocks // BLOCKS)
    left, right = docs.select(key, "held_out", "block", "body").repartition(tasks, "block"), here.repartition(tasks, "block")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(score, kind)
