"""A Brown class-based bigram model: P(text) = product of P(class | class before) x P(word | class).

Counting. The corpus is read once into blocks of some million tokens. A block numbers its own distinct words, by 64-bit digest, and keeps its
documents as those numbers. What is summed over blocks travels as one packed entry for each distinct word and block, dealt into shards by ranges of the
digest. The number of shards follows the number of entries, and a block has a row only for the shards that its words fall into, so rows and
bytes grow with the entries. The end and other common words stand in every block, though, so the shards that hold them get one packed row of each
block, whatever the number of shards.

Classes. Exchange clustering runs in two steps. The ``CORE`` most frequent words and ``ENDINGS`` groups of all other words, by their last letters, are
units; the end of a text is one of its own. On the driver the units are exchanged between classes, each to where the likelihood of the class bigrams is
highest, until none gains or ``SWEEPS`` are done; their bigram table is bounded by the number of units. This is where the classes
start. Then every other word that training documents hold is moved by its own contexts, ``WORD_SWEEPS`` times: the classes before and after it are counted over the whole
corpus, summed by word in the shards, and it goes to the class under which these contexts are likeliest. So the clustered vocabulary
is that of the corpus, and only words that training never saw have the class of their ending.

Smoothing. Transitions are interpolated with the class unigram (Witten-Bell); emissions are add-one with one more type for all unseen words
of a class.

Defined cases: null text is the empty text, whose only token is the end; very long texts are read whole, a block being at least one text; a null ``doc_id`` reads as the empty
string in the split; rows that repeat count each; ties between classes go to the lesser number, between core words to the lesser digest; an empty table gives an empty result; a table without
training documents gives each token P = 1 / 1 of the base; further columns are ignored. Two words whose 64-bit digests collide are counted as one: n^2 / 2^65 pairs are
to be expected among n distinct words, some three among ten billion.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, release, slices, texts, texts_of

FOLDS, HELD_OUT = 7, 2
CORE, ENDINGS, CLASSES, SWEEPS, WORD_SWEEPS = 1024, 256, 48, 6, 1
#: Last letters of a word that its group hashes.
TAIL = 3
#: Tokens after which a block is closed, entries of a shard on average, blobs that are summed up at a time, and the most frequent words that a block proposes for the core.
BLOCK_TOKENS = 1_200_000
SHARD_ENTRIES = 1 << 19
LEAST_SHARDS = 4
FAN = 64
PROPOSED = 4 * CORE
AT_ONCE = 4 << 20
#: Words whose contexts stand in a dense matrix at a time.
WORDS_AT_ONCE = 1 << 14
END_DIGEST = 0
UNITS = CORE + ENDINGS + 1
END_UNIT = UNITS - 1
#: The end token stands first among a block's words.
END = 0


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def ending(word: bytes) -> int:
    """The group of a word: a hash of its last letters."""
    return zlib.crc32(word[-TAIL:] if word.isascii() else word.decode("utf-8", "ignore")[-TAIL:].encode()) % ENDINGS


def _pack(x: np.ndarray) -> bytes:
    """Bytes of like weight together, then compressed."""
    return zstandard.ZstdCompressor(level=3).compress(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())


def _unpack(data: bytes, dtype: type) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


class _Block:
    """Words of a block by order of appearance, until it is closed."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.tokens: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, doc: int | None, text: bytes) -> None:
        numbers = self.numbers
        words = text.lower().split()
        own = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in words), np.int32, len(words))
        self.tokens += [own, np.zeros(1, np.int32)]
        self.docs.append(doc)
        self.lengths.append(len(words) + 1)
        self.size += len(words) + 1

    def row(self, block: str) -> tuple:
        """The block as a row; words are numbered anew, by digest."""
        tokens = np.concatenate(self.tokens)
        n = len(self.numbers) + 1
        digests, groups = np.full(n, END_DIGEST, np.uint64), np.zeros(n, np.uint8)
        digests[1:] = np.fromiter(map(xxhash.xxh64_intdigest, self.numbers), np.uint64, n - 1)
        groups[1:] = np.fromiter(map(ending, self.numbers), np.uint8, n - 1)
        self.numbers = {}  # the words themselves are not needed any more
        order = np.argsort(digests, kind="stable")
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        tokens, digests, groups = place[tokens], digests[order], groups[order]
        counts = np.bincount(tokens[_training(self.docs, self.lengths)], minlength=n)
        best = np.lexsort((digests, -counts))[: PROPOSED + 1]
        best = best[(counts[best] > 0) & (best != END)]
        return (block, self.docs, self.lengths, _pack(tokens), _pack(digests), _pack(groups), n, digests[best].view(np.int64).tolist(), counts[best].tolist())


def _training(docs: list[int | None], lengths: list[int]) -> np.ndarray:
    """Which tokens are of training documents."""
    return np.repeat(np.array([not held_out(d) for d in docs], bool), np.array(lengths, np.int64))


BLOCKS = "block string, docs array<long>, lengths array<long>, tokens binary, digests binary, groups binary, n_words long, top array<long>, top_counts array<long>"
_BLOCK_TYPES = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def out(row: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _BLOCK_TYPES, strict=True)], _names(BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, number, now = context.partitionId() if context else 0, 0, _Block()
        for batch in slices(batches, "text", AT_ONCE):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                now.add(doc, text)
                if now.size >= BLOCK_TOKENS:
                    yield out(now.row(f"{part}-{number}"))
                    number, now = number + 1, _Block()
        if now.size:
            yield out(now.row(f"{part}-{number}"))

    return texts(docs, id_col, text_col).mapInArrow(run, BLOCKS)


class Units:
    """The unit of each word: its rank among the core, or its ending's group, or the end."""

    def __init__(self, core: np.ndarray):
        self.order = np.argsort(core)
        self.ranked = core[self.order]

    def core(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are core words, and the ranks of these."""
        if not len(self.ranked):
            return np.zeros(len(digests), bool), np.zeros(0, np.int64)
        found = np.minimum(np.searchsorted(self.ranked, digests), len(self.ranked) - 1)
        hit = (self.ranked[found] == digests) & (digests != END_DIGEST)
        return hit, self.order[found[hit]]

    def of(self, digests: np.ndarray, groups: np.ndarray) -> np.ndarray:
        out = CORE + groups.astype(np.int64)
        hit, ranks = self.core(digests)
        out[hit] = ranks
        out[END] = END_UNIT
        return out


def _bigrams(units: Units):
    """The unit bigrams of each block's training documents, packed by runs of rows of their table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, docs, lengths, tokens, digests, groups in zip(*(batch.column(c).to_pylist() for c in ("block", "docs", "lengths", "tokens", "digests", "groups")), strict=True):
                text = units.of(_unpack(digests, np.uint64), _unpack(groups, np.uint8))[_unpack(tokens, np.int32)]
                before = np.concatenate(([END_UNIT], text[:-1]))  # the end before it opens each text
                pairs, n = np.unique((before * UNITS + text)[_training(docs, lengths)], return_counts=True)
                rows = pairs // UNITS // 16
                edges = [0, *(np.flatnonzero(rows[1:] != rows[:-1]) + 1).tolist(), len(pairs)] if len(pairs) else [0]
                spans = list(zip(edges[:-1], edges[1:], strict=True))
                packed = [_pack(np.stack([pairs[a:b], n[a:b]]).astype(np.int64).reshape(-1)) for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array([int(rows[a]) for a, _ in spans], pa.int32()), pa.array([block] * len(spans), pa.string()), pa.array(packed, pa.binary())], ["row", "part", "bigrams"])

    return run


def _sum_bigrams(table: pa.Table) -> pa.Table:
    both = np.concatenate([_unpack(x, np.int64).reshape(2, -1) for x in table.column("bigrams").to_pylist()], axis=1)
    pairs, where = np.unique(both[0], return_inverse=True)
    sums = np.bincount(where, both[1].astype(np.float64), len(pairs)).astype(np.int64)
    return pa.table({"row": table.column("row").slice(0, 1), "part": table.column("part").slice(0, 1), "bigrams": pa.array([_pack(np.stack([pairs, sums]).reshape(-1))], pa.binary())})


def unit_bigrams(made: DataFrame, units: Units, n_blocks: int) -> np.ndarray:
    """Their sums over all blocks, as a matrix; blobs are summed in a tree, ``FAN`` at a time, so no task's input grows with the corpus."""
    rows = made.select("block", "docs", "lengths", "tokens", "digests", "groups").mapInArrow(_bigrams(units), "row int, part string, bigrams binary")
    while True:
        n_blocks = -(-n_blocks // FAN)
        keyed = rows.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(max(1, n_blocks))).cast("string"))
        rows = keyed.groupBy("row", "part").applyInArrow(_sum_bigrams, "row int, part string, bigrams binary")
        if n_blocks <= 1:
            break
    out = np.zeros((UNITS, UNITS))
    for r in rows.collect():  # at most UNITS^2 counts
        pairs, n = _unpack(bytes(r["bigrams"]), np.int64).reshape(2, -1)
        out.reshape(-1)[pairs] = n
    return out


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit. The last unit (the end) keeps the last class to itself. Each unit in turn, by falling frequency, goes where the class bigram likelihood is highest; ties keep the lesser class."""
    n = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-n[:-1], kind="stable")
    of = np.zeros(len(n), np.int64)
    of[order] = np.arange(len(order)) % (classes - 1)
    of[-1] = classes - 1
    onto = np.eye(classes)[of]
    table = onto.T @ bigrams @ onto
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not n[u]:
                continue
            right, left = bigrams[u] @ onto, bigrams[:, u] @ onto  # to and from each class
            self_ = bigrams[u, u]
            home = of[u]
            right[home] -= self_
            left[home] -= self_
            base = table.copy()
            base[home] -= right
            base[:, home] -= left
            base[home, home] -= self_
            # Gain of joining class c over the table without u: the cells of row c and column c change.
            rows, columns = base.sum(axis=1) + left, base.sum(axis=0) + right  # u's neighbours keep their side of these pairs
            grown = xlogx(base + right[None, :]) - xlogx(base)  # row c takes u's right neighbours
            gain = grown.sum(axis=1) - np.diag(grown)
            grown = xlogx(base + left[:, None]) - xlogx(base)  # column c takes u's left neighbours
            gain += grown.sum(axis=0) - np.diag(grown)
            d = np.diag(base)
            gain += xlogx(d + right + left + self_) - xlogx(d)
            out, into = right.sum() + self_, left.sum() + self_
            gain -= xlogx(rows + out) - xlogx(rows) + xlogx(columns + into) - xlogx(columns)
            best = int(np.argmax(np.where(np.arange(classes) == classes - 1, -np.inf, gain)))
            if gain[best] <= gain[home] + 1e-9:
                best = home
            base[best] += right
            base[:, best] += left
            base[best, best] += self_
            table = base
            if best != home:
                of[u], moved = best, moved + 1
                onto[u] = 0
                onto[u, best] = 1
        if not moved:
            break
    return of


def preferences(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each class gains by one more bigram: from the class before it, to the class after it, and by one more token. To first order in the counts of one word."""
    smooth = table + 0.5
    return np.log(smooth), np.log(smooth.T), -np.log(smooth.sum(axis=1)) - np.log(smooth.sum(axis=0))


def _contexts(words: np.ndarray, classes: np.ndarray, training: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, count) of training tokens, sorted; contexts below k are the class before, the others the class after."""
    own = classes[words].astype(np.int64)
    keep = training & (words != END)
    before = np.concatenate(([classes[END]], own[:-1]))[keep]
    after = np.concatenate((own[1:], [classes[END]]))[keep] + k
    at = words[keep].astype(np.int64) * (2 * k)
    found, n = np.unique(np.concatenate((at + before, at + after)), return_counts=True)
    return found // (2 * k), found % (2 * k), n


SENT = "block string, shard int, digests binary, counts binary, classes binary, fixed binary, many binary, contexts binary, numbers binary"


def _send(shards: int, classes_of, k: int):
    """Each block's words by shard: digest, training count, class so far, whether it stays, and contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, digests = _unpack(r["tokens"], np.int32), _unpack(r["digests"], np.uint64)
                training = _training(r["docs"], r["lengths"])
                classes, fixed = classes_of(r, digests)
                counts = np.bincount(words[training], minlength=len(digests)).astype(np.uint32)
                word, context, n = _contexts(words, classes, training, k)
                many = np.bincount(word, minlength=len(digests)).astype(np.uint8)
                shard = ((digests >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                starts = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1))
                ends = np.concatenate((starts[1:], [len(shard)]))
                at = np.searchsorted(word, np.concatenate((starts, [len(shard)])))
                rows = [
                    (r["block"], int(shard[a]), _pack(digests[a:b]), _pack(counts[a:b]), _pack(classes[a:b]), _pack(fixed[a:b].astype(np.uint8)), _pack(many[a:b]), _pack(context[c:d].astype(np.uint8)), _pack(n[c:d].astype(np.uint32)))
                    for a, b, c, d in zip(starts.tolist(), ends.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)
                ]
                types = (pa.string(), pa.int32(), *[pa.binary()] * 7)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _names(SENT))

    return run


MOVED = "block string, shard int, counts binary, classes binary, tokens array<long>, types array<long>"


def _move(table_: np.ndarray):
    """One shard: sums over blocks, each word's best class, and back to each block. The row without a block has the training tokens and types of each class."""
    k = len(table_)
    before, after, token = preferences(table_)

    def run(table: pa.Table) -> pa.Table:
        read = lambda c, t: [_unpack(x, t) for x in table.column(c).to_pylist()]
        digests = read("digests", np.uint64)
        edges = np.concatenate(([0], np.cumsum([len(d) for d in digests])))
        every, first, where = np.unique(np.concatenate(digests), return_index=True, return_inverse=True)
        sums = np.bincount(where, np.concatenate(read("counts", np.uint32)).astype(np.float64), len(every)).astype(np.int64)
        classes = np.concatenate(read("classes", np.uint8))[first]
        stays = np.concatenate(read("fixed", np.uint8))[first].astype(bool) | (sums == 0) | (every == END_DIGEST)
        owner = np.repeat(where, np.concatenate(read("many", np.uint8)))
        context, n = np.concatenate(read("contexts", np.uint8)), np.concatenate(read("numbers", np.uint32)).astype(np.float64)
        order = np.argsort(owner, kind="stable")
        owner, context, n = owner[order], context[order], n[order]
        for a in range(0, len(every), WORDS_AT_ONCE):
            b = min(len(every), a + WORDS_AT_ONCE)
            c, d = np.searchsorted(owner, (a, b))
            seen = np.bincount((owner[c:d] - a) * (2 * k) + context[c:d], n[c:d], (b - a) * 2 * k).reshape(b - a, 2 * k)
            gain = seen[:, :k] @ before + seen[:, k:] @ after + sums[a:b, None] * token
            gain[:, k - 1] = -np.inf  # the end's own class
            # Sums over blocks come in any order; rounding makes ties of what is equal but for that.
            classes[a:b] = np.where(stays[a:b], classes[a:b], np.argmax(np.round(gain, 6), axis=1))
        names, shard = table.column("block").to_pylist(), table.column("shard")[0].as_py()
        back = [where[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        none = [None] * len(names)
        tokens, types = np.bincount(classes, sums, k).astype(np.int64), np.bincount(classes, sums > 0, k).astype(np.int64)
        return pa.table(
            {
                "block": pa.array([*names, None], pa.string()),
                "shard": pa.array([shard] * (len(names) + 1), pa.int32()),
                "counts": pa.array([*(_pack(sums[w]) for w in back), None], pa.binary()),
                "classes": pa.array([*(_pack(classes[w]) for w in back), None], pa.binary()),
                "tokens": pa.array([*none, tokens.tolist()], pa.list_(pa.int64())),
                "types": pa.array([*none, types.tolist()], pa.list_(pa.int64())),
            }
        )

    return run


RESOLVED = "block string, docs array<long>, lengths array<long>, tokens binary, digests binary, fixed binary, counts binary, classes binary, pairs array<int>, times array<long>"


def _resolve(units: Units, k: int, last: bool):
    """A block with its words' counts and classes, and the class bigrams of its training documents. Digests are kept only where another sweep needs them."""

    def run(key, docs: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("shard")
        counts, classes = (np.concatenate([_unpack(x, t) for x in right.column(c).to_pylist()]) for c, t in (("counts", np.int64), ("classes", np.uint8)))
        (r,) = docs.to_pylist()
        text = classes[_unpack(r["tokens"], np.int32)].astype(np.int64)
        before = np.concatenate(([k - 1], text[:-1]))
        pairs, n = np.unique((before * k + text)[_training(r["docs"], r["lengths"])], return_counts=True)
        fixed = None if last else _pack(units.core(_unpack(r["digests"], np.uint64))[0].astype(np.uint8))
        row = (r["block"], r["docs"], r["lengths"], r["tokens"], None if last else r["digests"], fixed, _pack(counts), _pack(classes), pairs.tolist(), n.tolist())
        types = (*_BLOCK_TYPES[:4], *[pa.binary()] * 4, pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.table({name: pa.array([x], t) for name, x, t in zip(_names(RESOLVED), row, types, strict=True)})

    return run


class Model:
    """Transition and emission probabilities, all of bounded size. The last class is the end's."""

    def __init__(self, table: np.ndarray, tokens: np.ndarray, types: np.ndarray):
        """table: class bigrams. tokens, types: training tokens and distinct words of each class."""
        unigram = (tokens + 1) / (tokens.sum() + len(table))
        follow = (table > 0).sum(axis=1, keepdims=True)
        total = table.sum(axis=1, keepdims=True)
        # Witten-Bell: as much weight for the unigram as kinds of followers were seen.
        weight = np.where(total + follow > 0, follow, 1)
        self.transition = np.log10((table + weight * unigram[None, :]) / (total + weight))
        self.spread = tokens + types + 1  # add-one over the class's types and one for all it has not seen

    def score(self, classes: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 P of each text; ``starts`` are the texts' first tokens, ``counts`` the words' training counts."""
        end = len(self.transition) - 1
        before = np.concatenate(([end], classes[:-1]))
        emission = np.log10((counts + 1) / self.spread[classes])
        emission[classes == end] = 0.0  # the end is all of its class
        return np.add.reduceat(self.transition[before, classes] + emission, starts)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, word_sweeps: int = WORD_SWEEPS) -> DataFrame:
    """One row per document: base (add-one unigram) and class-model log10 probability. ``classes`` is at most 127; at least one sweep over words is made, as it also counts them."""
    made = materialize(blocks(docs, id_col, text_col), "lm-blocks")
    n_blocks, entries = made.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    shards = max(LEAST_SHARDS, -(-entries // SHARD_ENTRIES))
    proposed = made.select(F.explode(F.arrays_zip("top", "top_counts")).alias("t")).groupBy("t.top").agg(F.sum("t.top_counts").alias("n"))
    units = Units(np.array([r["top"] for r in proposed.orderBy(F.desc("n"), "top").limit(CORE).collect()], np.int64).view(np.uint64))
    bigrams = unit_bigrams(made, units, n_blocks)
    of = exchange(bigrams, classes)
    onto = np.eye(classes)[of]
    table = onto.T @ bigrams @ onto

    def at_first(r: dict, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return of[units.of(digests, _unpack(r["groups"], np.uint8))].astype(np.uint8), units.core(digests)[0]

    def as_moved(r: dict, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _unpack(r["classes"], np.uint8), _unpack(r["fixed"], np.uint8)

    now = made
    for i in range(max(1, word_sweeps)):
        last = i + 1 >= word_sweeps
        sent = now.select("block", "docs", "lengths", "tokens", "digests", *(["groups"] if not i else ["classes", "fixed"])).mapInArrow(_send(int(shards), as_moved if i else at_first, classes), SENT)
        moved = materialize(sent.groupBy("shard").applyInArrow(_move(table), MOVED), "lm-moved")
        back = moved.filter("block is not null").select("block", "shard", "counts", "classes")
        whole = now.select("block", "docs", "lengths", "tokens", "digests")
        resolved = materialize(whole.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_resolve(units, classes, last), RESOLVED), "lm-resolved")
        table = np.zeros((classes, classes))
        for r in resolved.select(F.explode(F.arrays_zip("pairs", "times")).alias("t")).groupBy("t.pairs").agg(F.sum("t.times").alias("n")).collect():  # at most classes^2
            table.reshape(-1)[r["pairs"]] = r["n"]
        tokens, types = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for r in moved.filter("block is null").select(F.posexplode(F.arrays_zip("tokens", "types")).alias("i", "t")).groupBy("i").agg(F.sum("t.tokens").alias("tokens"), F.sum("t.types").alias("types")).collect():
            tokens[r["i"]], types[r["i"]] = r["tokens"], r["types"]
        release(now, moved)
        now = resolved
    total, distinct = int(tokens.sum()), int(types.sum())
    model = Model(table, tokens, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lengths, *packed in zip(*(batch.column(c).to_pylist() for c in ("docs", "lengths", "tokens", "counts", "classes")), strict=True):
                words, counts, own = (_unpack(x, t) for x, t in zip(packed, (np.int32, np.int64, np.uint8), strict=True))
                lengths = np.array(lengths, np.int64)
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                c = counts[words]
                base = np.add.reduceat(np.log10((counts + 1) / (total + distinct + 1))[words], starts)
                known = np.add.reduceat((c > 0).astype(np.int64), starts)
                scores = model.score(own[words].astype(np.int64), c, starts)
                columns = [pa.array(ids, pa.int64()), pa.array([held_out(d) for d in ids], pa.bool_()), pa.array(lengths), pa.array(known), pa.array(np.full(len(ids), total), pa.int64()), pa.array(base), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, _names(SCORES))

    return now.select("docs", "lengths", "tokens", "counts", "classes").mapInArrow(run, SCORES)


def query(spark, sf_dir: str) -> DataFrame:
    """op7 over the whole of ``documents``."""
    return score(documents(spark, sf_dir))
