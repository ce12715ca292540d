"""Language-model scores from a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Model.  Every word seen in training, and the start of a text, has a restaurant of the words seen after it.  All of
them share one parent, the restaurant of all words, whose base is uniform over the V known words and the unknown one.
In a restaurant with discount d and strength s, a dish w with c customers at t tables has probability
(c - d*t + (s + d*T) * P_parent(w)) / (s + C).  Each table of a context restaurant is a customer of the parent.
The discounts follow from the counts of ones and twos (n1 / (n1 + 2*n2)); the strengths are parameters.

Sampling (``seating``).  Restaurants are dealt to buckets by their context, so each is seated whole in one task, dish after
dish, given the other dishes' tables.  The pairs of a context of at least ``FREQUENT_TOKENS`` training tokens, which would
fill much of a bucket, are dealt by the pair; its tables in other buckets count as they stood at the last exchange.  An
exchange sums the tables of each word, and those of each frequent context, over all buckets exactly, seats the parent with
the former and returns the words' parent probabilities and the contexts' totals.
``ROUNDS`` rounds of ``SWEEPS`` sweeps and an exchange burn in; the last round keeps ``SAMPLES`` seatings,
and a token's probability is the mean of their predictive probabilities.

Movement.  Texts become chunks of token indices with one vocabulary each.  A chunk asks for the counts and numbers of its
distinct words over all chunks.  Then it sends its distinct pairs with their counts to the buckets of their contexts, so
that a pair or word as frequent as one likes costs a chunk one entry, and gets back one probability for each of them, in the
same order; its tokens never leave it.  Only totals reach the driver.  Counts, numbers and seatings depend on the corpus
alone, not on how rows are dealt to files or tasks.

Defined results: null text has no words, only its end token; repeated rows are counted again and scored alike; a null
id is never held out; with no training text every token is unknown (V = N = 0, probability 1); words with equal counts are
numbered by hash; columns other than the two named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.scratch import stash
from graphloom.llm.seating import sweep
from graphloom.llm.textkit import U64, mix, slices, word_hashes

CHUNK_TOKENS = 1_000_000
BUCKET_TOKENS = 2_000_000
#: Contexts of at least this many training tokens have their pairs dealt by the pair.
FREQUENT_TOKENS = BUCKET_TOKENS // 20
ROUNDS, SWEEPS, SAMPLES = 1, 2, 3
STRENGTH = ROOT_STRENGTH = 1.0
END = U64(0xE0DE0DE0DE0DE0DE)
BUCKET_ROWS = "bucket int, chunk_id bigint, blob binary"


def _dump(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes (the first bytes of all numbers, then the second ones, ...)."""
    planes = [(a.dtype.str, len(a), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in arrays]
    raw = pickle.dumps(planes, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _load(blob: bytes) -> list[np.ndarray]:
    planes = pickle.loads(pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))
    return [np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).reshape(n) if n else np.zeros(0, kind) for kind, n, raw in planes]


def _small(x: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds the values."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _steps(x: np.ndarray) -> np.ndarray:
    """Rising numbers as differences."""
    return _small(np.diff(x, prepend=x.dtype.type(0)))


def tokenise(documents: DataFrame, doc_id: str, text: str, folds: int) -> DataFrame:
    """Chunks: chunk_id, train_tokens, tokens, a blob of the sorted word hashes and their training counts, and one of documents and tokens.

    The latter: ids, known ids, lengths, flags, the place of the end token among the words, and of each token's word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held, held_tokens = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            ids, known, out, lengths, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            vocabulary, index = np.unique(tokens, return_inverse=True)
            counts = np.bincount(index[np.repeat(~out, lengths)], minlength=len(vocabulary))
            words = _dump(vocabulary, _small(counts))
            blob = _dump(ids, known, _small(lengths), out, np.searchsorted(vocabulary, END)[None], _small(index))
            train = int(lengths[~out].sum())
            return pa.RecordBatch.from_arrays([pa.array([(task << 24) + made]), pa.array([train]), pa.array([len(tokens)]), pa.array([words], pa.binary()), pa.array([blob], pa.binary())], names=["chunk_id", "train_tokens", "tokens", "words", "blob"])

        for batch in batches:
            ids, out = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for first, last, raw, bounds in slices(batch.column(1)):
                words, at = word_hashes(raw, bounds)
                tokens = np.insert(words, at[1:], END)  # one end token after each text
                held.append((ids[first:last], known[first:last], out[first:last].astype(bool), np.diff(at) + 1, tokens))
                held_tokens += len(tokens)
                if held_tokens >= CHUNK_TOKENS:
                    yield flush()
                    made, held, held_tokens = made + 1, [], 0
        if held:
            yield flush()

    out = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), out.alias("out"))
    return stash(rows.mapInArrow(run, "chunk_id bigint, train_tokens bigint, tokens bigint, words binary, blob binary"), "chunks")


def _bucket(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets are ranges of the hashes, so sorted hashes lie in the order of their buckets."""
    return (((hashes >> U64(32)) * U64(n_buckets)) >> U64(32)).astype(np.int32)


def _by_bucket(buckets: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of their bucket (stable) and where each bucket begins."""
    order = np.argsort(buckets, kind="stable")
    return order, np.searchsorted(buckets[order], np.arange(n_buckets + 1))


def ask_words(chunks: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, chunk_id, blob: the distinct words of a chunk and their training counts in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk_id, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vocabulary, counts = _load(blob)
                at = np.searchsorted(_bucket(vocabulary, n_buckets), np.arange(n_buckets + 1))
                buckets = np.flatnonzero(np.diff(at))
                blobs = [_dump(vocabulary[at[b] : at[b + 1]], _small(counts[at[b] : at[b + 1]])) for b in buckets]
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([chunk_id] * len(buckets), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "chunk_id", "blob"])

    return chunks.select("chunk_id", "words").mapInArrow(run, "bucket int, chunk_id bigint, blob binary")


def _rows(schema: str, rows: Sequence[tuple]) -> pa.Table:
    """Rows of (int and binary) columns as a table."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(columns)})


def count_words(asked: DataFrame, n_buckets: int, frequent: int = FREQUENT_TOKENS) -> DataFrame:
    """chunk_id, bucket, blob: the numbers, training counts and frequency marks of a chunk's words; ``known``: words of a bucket.

    Unknown words have number 0; others are numbered by falling count within their bucket.
    """
    schema = "bucket int, chunk_id bigint, blob binary, known bigint"

    def run(table: pa.Table) -> pa.Table:
        bucket, blobs = table["bucket"][0].as_py(), [_load(b) for b in table["blob"].to_pylist()]
        words, word_of = np.unique(np.concatenate([b[0] for b in blobs]), return_inverse=True)
        total = np.bincount(word_of, np.concatenate([b[1] for b in blobs]), minlength=len(words)).astype(np.int64)
        number = np.zeros(len(words), dtype=np.int64)
        order = np.lexsort((words, -total))[: np.count_nonzero(total)]
        number[order] = 1 + np.arange(len(order)) * n_buckets + bucket
        often = total >= frequent
        places = np.split(word_of, np.cumsum([len(b[0]) for b in blobs])[:-1])
        rows = [(bucket, c, _dump(_small(number[w]), _small(total[w]), often[w]), None) for c, w in zip(table["chunk_id"].to_pylist(), places, strict=True)]
        return _rows(schema, [*rows, (bucket, None, None, len(order))])

    return stash(asked.groupBy("bucket").applyInArrow(run, schema), "counts")


class Ordered(NamedTuple):
    """A chunk's documents, and its tokens in the order of their buckets, contexts and words."""

    ids: np.ndarray
    known: np.ndarray
    out: np.ndarray
    lengths: np.ndarray
    count: np.ndarray  # training count of each token's word, in the order of the texts
    numbers: np.ndarray  # the distinct numbers of words, and whether each is dealt by the pair
    split: np.ndarray
    bucket: np.ndarray  # of each pair; context and word are places among the numbers
    context: np.ndarray
    word: np.ndarray
    first: np.ndarray  # where each pair's tokens begin
    doc: np.ndarray  # of each token

    @property
    def tokens(self) -> np.ndarray:
        """Tokens of each pair."""
        return np.diff(np.append(self.first, len(self.doc)))


def in_order(chunk: bytes, answers: Sequence[bytes], n_buckets: int) -> Ordered:
    """A chunk with the answers to its words (in the order of their buckets, which is the order of its words)."""
    ids, known, lengths, out, end, index = _load(chunk)
    number, count, often = (np.concatenate(x) for x in zip(*map(_load, answers), strict=True))
    lengths = lengths.astype(np.int64)
    first = np.cumsum(lengths) - lengths
    numbers, place = np.unique(number.astype(np.int64), return_inverse=True)
    split = np.zeros(len(numbers), bool)
    split[place[often]] = True
    split |= numbers == 0
    word = place[index]
    context = np.empty(len(word), dtype=np.int64)
    context[1:] = word[:-1]
    context[first] = place[end[0]]
    hashes = mix(numbers.astype(U64) + U64(1))
    bucket = _bucket(hashes[context] + np.where(split[context], mix(hashes[word] + U64(7)), U64(0)), n_buckets)
    bits = len(numbers).bit_length()
    if 2 * bits + n_buckets.bit_length() < 63:
        order = np.argsort((((bucket.astype(np.int64) << bits) | context) << bits) | word, kind="stable")
    else:
        order = np.lexsort((word, context, bucket))
    bucket, context, word = bucket[order], context[order], word[order]
    pairs = np.flatnonzero(np.concatenate([[True], (np.diff(bucket) != 0) | (np.diff(context) != 0) | (np.diff(word) != 0)]))
    docs = np.repeat(np.arange(len(lengths)), lengths)[order]
    return Ordered(ids, known, out, lengths, count.astype(np.int64)[index], numbers, split, bucket[pairs], context[pairs], word[pairs], pairs, docs)


def deal(chunks: DataFrame, counted: DataFrame, n_buckets: int) -> DataFrame:
    """Per chunk and bucket its distinct pairs and how often each was trained."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        chunk_id = chunk["chunk_id"][0].as_py()
        c = in_order(chunk["blob"][0].as_py(), answers.sort_by("bucket")["blob"].to_pylist(), n_buckets)
        trained = np.add.reduceat((~c.out[c.doc]).astype(np.int64), c.first)
        at, rows = np.searchsorted(c.bucket, np.arange(n_buckets + 1)), []
        for b in np.flatnonzero(np.diff(at)).tolist():
            p = slice(at[b], at[b + 1])
            u, n = np.unique(c.context[p], return_counts=True)
            rows.append((b, chunk_id, _dump(_steps(c.numbers[u]), c.split[u], _small(n), _small(c.numbers[c.word[p]]), _small(trained[p]))))
        return _rows(BUCKET_ROWS, rows)

    return chunks.select("chunk_id", "blob").groupBy("chunk_id").cogroup(_answered(counted).groupBy("chunk_id")).applyInArrow(run, BUCKET_ROWS)


def _answered(counted: DataFrame) -> DataFrame:
    return counted.where("chunk_id is not null").select("chunk_id", "bucket", "blob")


STATE = "bucket int, target int, state binary, refs binary, tables binary, share binary, split binary, ones bigint, twos bigint"


def _shares(bucket: int, n_buckets: int, words: np.ndarray, sums: Sequence[np.ndarray], contexts: np.ndarray, totals: Sequence[np.ndarray]) -> Iterator[tuple]:
    """A bucket's tables of its words, and customers and tables of its frequent contexts, for the buckets that sum them (rows of ``STATE``)."""
    order, at = _by_bucket((words - 1) % n_buckets, n_buckets)
    hot, hot_at = _by_bucket((contexts - 1) % n_buckets, n_buckets)
    begin = np.searchsorted(words, 1)  # without the unknown word
    for t in range(n_buckets):
        own, mine = order[at[t] : at[t + 1]], hot[hot_at[t] : hot_at[t + 1]]
        own = own[own >= begin]
        if len(own) or len(mine):
            share = _dump(_steps(words[own]), *[_small(x[own].astype(np.int64)) for x in sums])
            yield bucket, t, None, None, None, share, _dump(_steps(contexts[mine]), *[_small(x[mine]) for x in totals]), None, None


def build(dealt: DataFrame, n_buckets: int) -> DataFrame:
    """Per bucket its pairs (``state``), those of each chunk (``refs``), and its shares with one table a dish."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk_id")
        bucket, got = table["bucket"][0].as_py(), [_load(b) for b in table["blob"].to_pylist()]
        column = lambda i: np.concatenate([g[i] for g in got])
        u = np.concatenate([np.repeat(np.cumsum(g[0].astype(np.int64)), g[2]) for g in got])
        marks = dict(zip(np.concatenate([np.cumsum(g[0].astype(np.int64)) for g in got]).tolist(), column(1).tolist(), strict=True))
        contexts, u = np.unique(u, return_inverse=True)
        words, w = np.unique(column(3).astype(np.int64), return_inverse=True)
        keys, pair_of = np.unique(u * len(words) + w, return_inverse=True)
        count = np.bincount(pair_of, column(4), minlength=len(keys)).astype(np.int64)
        split = np.asarray([marks[c] for c in contexts.tolist()], dtype=bool)
        context, word, seen = keys // len(words), keys % len(words), count > 0
        state = _dump(_steps(contexts), split, _small(np.bincount(context, minlength=len(contexts))), _steps(words), _small(word), _small(count))
        n_pairs = np.asarray([len(g[3]) for g in got])
        steps, first = np.diff(pair_of, prepend=0), np.cumsum(n_pairs) - n_pairs  # a chunk's pairs rise, as the bucket's do
        steps[first] = pair_of[first]
        refs = _dump(table["chunk_id"].to_numpy(), _small(n_pairs), _small(steps))
        own = (bucket, None, state, refs, None, None, None, int((count == 1).sum()), int((count == 2).sum()))
        hot = _split_totals(contexts, split, context, count, [seen.astype(np.int64)])
        return _rows(STATE, [own, *_shares(bucket, n_buckets, words, [np.bincount(word, seen, minlength=len(words))], *hot)])

    return stash(dealt.groupBy("bucket").applyInArrow(run, STATE), "state")


def _split_totals(contexts: np.ndarray, split: np.ndarray, context: np.ndarray, count: np.ndarray, tables: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The contexts whose pairs are dealt by the pair, and their customers and tables in this bucket."""
    at = np.flatnonzero(split & (contexts > 0))
    return contexts[at], [np.bincount(context, x, minlength=len(contexts))[at].astype(np.int64) for x in (count, *tables)]


PARENT = "bucket int, target int, parent binary, split binary, customers binary"


def seat_parent(shares: DataFrame, samples: int, root_tables: Sequence[float], discount: float, vocabulary: int, turn: int) -> DataFrame:
    """Per bucket its words' own parts of their parent probabilities, its frequent contexts' totals, and the root's (bucket -1).

    Tables of the root's other dishes count as they stood before.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        target, got = table["target"][0].as_py(), [_load(b) for b in table["share"].to_pylist()]
        asked = [np.cumsum(g[0].astype(np.int64)) for g in got]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        hot = [_load(b) for b in table["split"].to_pylist()]
        _, hot_at = np.unique(np.concatenate([np.cumsum(h[0].astype(np.int64)) for h in hot]), return_inverse=True)
        sums = [np.bincount(hot_at, np.concatenate([h[1 + i] for h in hot])).astype(np.int64) for i in range(samples + 1)]
        rng, own, totals = np.random.default_rng([13, turn, target]), [], []
        base, one = np.full(len(words), 1 / (vocabulary + 1)), np.zeros(len(words), np.int64)
        for s in range(samples):
            customers = np.bincount(at, np.concatenate([g[1 + s] for g in got]), minlength=len(words)).astype(np.int64)
            tables, before = (customers > 0).astype(np.int64), np.count_nonzero(customers)
            for _ in range(2):
                tables = sweep(customers, tables, base, one, np.asarray([max(root_tables[s] - before, 0.0)]), discount, ROOT_STRENGTH, rng, groups=4)
            own.append((customers - discount * tables).astype(np.float32))
            totals += [customers.sum(), tables.sum()]
        places = np.split(at, np.cumsum([len(a) for a in asked])[:-1])
        hot_places = np.split(hot_at, np.cumsum([len(h[0]) for h in hot])[:-1])
        rows = [(b, target, _dump(*[x[p] for x in own]), _dump(*[_small(x[q]) for x in sums]), None) for b, p, q in zip(table["bucket"].to_pylist(), places, hot_places, strict=True)]
        return _rows(PARENT, [*rows, (-1, target, None, None, _dump(np.asarray(totals, dtype=np.int64)))])

    return stash(shares.where("share is not null").select("bucket", "target", "share", "split").groupBy("target").applyInArrow(run, PARENT), "parent")


def parent_totals(parent: DataFrame, samples: int) -> np.ndarray:
    """Customers and tables of the root, a row for each sample; one small row a bucket is summed."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                x = _load(blob)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x)], names=["i", "x"])

    out = np.zeros(2 * samples)
    for i, x in parent.where("bucket = -1").select("customers").mapInArrow(unfold, "i int, x bigint").groupBy("i").agg(F.sum("x")).collect():
        out[i] = x
    return out.reshape(samples, 2)


class Bucket:
    """A bucket's pairs with their parents' probabilities and the totals of their contexts."""

    def __init__(self, own: pa.Table, answers: pa.Table, n_buckets: int, model: dict) -> None:
        self.bucket = own["bucket"][0].as_py()
        contexts, self.split, n, words, word, count = _load(own["state"][0].as_py())
        self.contexts, self.words = np.cumsum(contexts.astype(np.int64)), np.cumsum(words.astype(np.int64))
        self.context, self.word, self.count = np.repeat(np.arange(len(contexts)), n), word.astype(np.int64), count.astype(np.int64)
        self.tables = [(self.count > 0).astype(np.int64)]
        order, at = _by_bucket((self.words - 1) % n_buckets, n_buckets)
        self.hot = np.flatnonzero(self.split & (self.contexts > 0))
        hot, hot_at = _by_bucket((self.contexts[self.hot] - 1) % n_buckets, n_buckets)
        self.seated, self.totals = np.zeros((len(model["root"]), len(self.words))), np.zeros((1 + len(model["root"]), len(self.hot)))
        for target, parent, split, tables in zip(*(answers[c].to_pylist() for c in ("target", "parent", "split", "tables")), strict=True):
            if tables is not None:
                self.tables = [t.astype(np.int64) for t in _load(tables)]
            if parent is not None:
                mine = order[at[target] : at[target + 1]]
                self.seated[:, mine[self.words[mine] > 0]] = _load(parent)
                self.totals[:, hot[hot_at[target] : hot_at[target + 1]]] = _load(split)
        self.model = model

    def parent(self, sample: int) -> np.ndarray:
        """The parent's probability of each word."""
        (customers, tables), m = self.model["root"][sample], self.model
        return (self.seated[sample] + (ROOT_STRENGTH + m["root_discount"] * tables) / (m["vocabulary"] + 1)) / (ROOT_STRENGTH + customers)

    def elsewhere(self, sample: int) -> np.ndarray:
        """Tables of each context in other buckets."""
        own = np.bincount(self.context, self.tables[sample], minlength=len(self.contexts))
        out = np.zeros(len(self.contexts))
        out[self.hot] = self.totals[1 + sample] - own[self.hot]
        return out


def _answers(parent: DataFrame, state: DataFrame | None) -> DataFrame:
    """What buckets need besides their own pairs: parents, totals of frequent contexts and the last tables."""
    found = parent.where("bucket >= 0").select("bucket", "target", "parent", "split", F.lit(None).cast("binary").alias("tables"))
    if state is None:
        return found
    none = F.lit(None).cast("binary")
    return found.unionByName(state.where("tables is not null").select("bucket", F.lit(None).cast("int").alias("target"), none.alias("parent"), none.alias("split"), "tables"))


def gibbs(state: DataFrame, answers: DataFrame, model, n_buckets: int, keep: int, turn: int) -> DataFrame:
    """``SWEEPS`` sweeps over each bucket and ``keep - 1`` more; the last ``keep`` seatings, and the shares of their tables."""

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        m = model.value
        b = Bucket(own, answers, n_buckets, m)
        rng, base, elsewhere = np.random.default_rng([11, turn, b.bucket]), b.parent(0)[b.word], b.elsewhere(0)
        tables, kept = b.tables[0], []
        for _ in range(SWEEPS + keep - 1):
            tables = sweep(b.count, tables, base, b.context, elsewhere, m["discount"], STRENGTH, rng)
            kept = [*kept, tables][-keep:]
        row = (b.bucket, None, None, None, _dump(*[_small(t) for t in kept]), None, None, None, None)
        hot = _split_totals(b.contexts, b.split, b.context, b.count, kept)
        return _rows(STATE, [row, *_shares(b.bucket, n_buckets, b.words, [np.bincount(b.word, t, minlength=len(b.words)) for t in kept], *hot)])

    own = state.where("state is not null").select("bucket", "state")
    return stash(own.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, STATE), "seated")


def pair_chances(state: DataFrame, answers: DataFrame, model, n_buckets: int) -> DataFrame:
    """bucket, chunk_id, blob: the log10 probability of each pair that a chunk has in a bucket, in the chunk's order."""

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        m = model.value
        b = Bucket(own, answers, n_buckets, m)
        n, chance = len(b.contexts), np.zeros(len(b.word))
        customers = np.bincount(b.context, b.count, minlength=n)
        customers[b.hot] = b.totals[0]
        customers[b.contexts == 0] = 0
        for s, tables in enumerate(b.tables):
            all_tables = np.bincount(b.context, tables, minlength=n) + b.elsewhere(s)
            all_tables[b.contexts == 0] = 0
            chance += (b.count - m["discount"] * tables + (STRENGTH + m["discount"] * all_tables[b.context]) * b.parent(s)[b.word]) / (STRENGTH + customers[b.context])
        log_chance = np.log10(chance / len(b.tables)).astype(np.float32)
        chunk_ids, n_pairs, steps = _load(own["refs"][0].as_py())
        parts = np.split(steps, np.cumsum(n_pairs.astype(np.int64))[:-1])
        return _rows(BUCKET_ROWS, [(b.bucket, c, _dump(log_chance[np.cumsum(p.astype(np.int64))])) for c, p in zip(chunk_ids.tolist(), parts, strict=True)])

    own = state.where("state is not null").select("bucket", "state", "refs")
    return own.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, BUCKET_ROWS)


def score_documents(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folds: int = 10, frequent: int = FREQUENT_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every document."""
    context = documents.sparkSession.sparkContext
    chunks = tokenise(documents, doc_id, text, folds)
    train_tokens, tokens = chunks.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    n_buckets = max(8, -(-tokens // BUCKET_TOKENS))
    counted = count_words(ask_words(chunks, n_buckets), n_buckets, frequent)
    vocabulary = counted.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    state = build(deal(chunks, counted, n_buckets), n_buckets)
    ones, twos = state.agg(F.coalesce(F.sum("ones"), F.lit(0)), F.coalesce(F.sum("twos"), F.lit(0))).first()
    model = {"vocabulary": vocabulary, "discount": float(np.clip(ones / max(ones + 2 * twos, 1), 0.3, 0.9)), "root_discount": 0.6}
    seated, root_tables, samples = state, [float(vocabulary)], 1
    for turn in range(ROUNDS + 2):
        parent = seat_parent(seated, samples, root_tables, model["root_discount"], vocabulary, turn)
        root = parent_totals(parent, samples)
        shared = context.broadcast(model | {"root": root})
        answers = _answers(parent, seated if turn else None)
        if turn > ROUNDS:
            break
        samples = SAMPLES if turn == ROUNDS else 1
        seated = gibbs(state, answers, shared, n_buckets, samples, turn)
        root_tables = [root[0, 1]] * samples
    chances = pair_chances(state, answers, shared, n_buckets)

    def score(chunk: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        answers, got = ([b for b in rows[c].to_pylist() if b is not None] for c in ("answer", "blob"))
        c = in_order(chunk["blob"][0].as_py(), answers, n_buckets)
        chance = np.concatenate([_load(b)[0] for b in got]).astype(np.float64)
        first = np.cumsum(c.lengths) - c.lengths
        base = np.log10((c.count + 0.1) / (train_tokens + 0.1 * (vocabulary + 1)))
        return pa.table(
            {
                "doc_id": pa.array(c.ids, pa.int64(), mask=~c.known),
                "held_out": pa.array(c.out),
                "n_tokens": pa.array(c.lengths),
                "n_known": pa.array(np.add.reduceat((c.count > 0).astype(np.int64), first)),
                "train_tokens": pa.array(np.full(len(c.ids), train_tokens)),
                "base_score": pa.array(np.add.reduceat(base, first)),
                "score": pa.array(np.bincount(c.doc, np.repeat(chance, c.tokens), minlength=len(c.ids))),
            }
        )

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    none = F.lit(None).cast("binary")
    rows = _answered(counted).select("chunk_id", "bucket", F.col("blob").alias("answer"), none.alias("blob"))
    rows = rows.unionByName(chances.select("chunk_id", "bucket", none.alias("answer"), "blob"))
    return chunks.select("chunk_id", "blob").groupBy("chunk_id").cogroup(rows.groupBy("chunk_id")).applyInArrow(score, schema)
