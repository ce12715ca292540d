"""The text operators on small tables, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, chat, decontam, html_extract, lm, neardup, packing, quality, seating, sharding, url_filter
from graphloom.llm.components import connected_components
from graphloom.llm.html_blocks import blocks_of
from graphloom.llm.queries import tokenizer_file
from graphloom.llm.tokens import encoder

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOCS = "doc_id long, text string, lang string, score double"


def text(seed, n=60):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, nulls, empty and long texts, repeated rows, clashing columns."""
    base = text(1, 120)
    rows = [(i, text(i)) for i in range(10, 30)] + [(1, base), (2, base), (3, base + " extra"), (4, base + " extra tail"), (5, None), (6, ""), (7, " \n"), (8, "one two"), (8, "one two"), (9, text(9, 9000)), (None, "no id here")]
    return spark.createDataFrame([(i, t, "en", 0.5) for i, t in rows], DOCS).repartition(3)


def test_pack(spark, docs):
    made = packing.pack_documents(docs, tokenizer_file(), end_id=2, open_windows=3)
    assert made.agg(F.max("length")).first()[0] <= 4096
    pieces = packing.piece_digests(made).collect()
    tokenizer = encoder(tokenizer_file()).tokenizer
    whole = sorted(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(p.length for p in pieces) == sum(whole)
    ids = np.asarray([*tokenizer.encode(docs.where("doc_id = 9").first().text, add_special_tokens=False).ids, 2], "<u4")
    own = sorted((p for p in pieces if p.doc_id == 9), key=lambda p: p.start)
    assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
    assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for members in by_sequence.values():
        members.sort(key=lambda p: p.offset)
        assert [p.offset for p in members] == [0, *np.cumsum([p.length for p in members])[:-1]]


def test_tokens_match_the_tokenizer():
    e = encoder(tokenizer_file())
    odd = ["It's DON'T <|endoftext|> x", "ß÷×ªº²³¼ µ", "tab\x0bx\x1cy", "ΑΣ İ 你好 👍🏽", "''s ''S '' 's'll", "a’s — “q”…", "", "\n\n "]
    assert e.encode(odd) == [np.asarray(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(odd, add_special_tokens=False)]


def test_every_plain_character_matches_the_tokenizer():
    """Each admitted code point in several places, long pieces, and capitals whose small letters lie outside the range."""
    from graphloom.llm import tokens

    e, one = encoder(tokenizer_file()), re.compile(tokens.PLAIN)
    plain = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if one.fullmatch(c)]
    probes = [p for c in plain for p in (f"ab{c}cd", f"{c}'s {c}a", f"1{c}2", f"a{c}", f".{c}.", c + c)]
    probes += ["abƁcd", "Ə's Əa", "ƆƐƉƊƔƖ x", "x" * 5000 + " y", "a " + "b" * 1001 + " c", "<|ENDOFTEXT|> a"]
    assert len(plain) > 300 and e.splits
    assert e.encode(probes) == [np.asarray(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(probes, add_special_tokens=False)]


def test_a_full_memory_forgets_and_stays_right(monkeypatch):
    from graphloom.llm import tokens

    monkeypatch.setattr(tokens, "MEMO", 40)
    e = tokens.Encoder(tokenizer_file())
    for i in range(6):
        texts = [f"{text(i, 30)} new{i}x{k} word-{i}{k}!" for k in range(9)]
        assert e.encode(texts) == [np.asarray(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def near_brute(rows):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_near_duplicates(docs):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    want = near_brute([(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [r.kept for r in got if r.doc_id is None] == [False]


@pytest.mark.parametrize("percent", [80, 70])
def test_agreements_follow_the_threshold(spark, percent):
    """400 pairs just at the threshold; a fixed number of agreements fitted to 0.85 misses some at 0.70."""
    more = 100 - percent
    rows = [r for i in range(400) for r in ((2 * i, " ".join(f"{i}x{k}" for k in range(percent + 4))), (2 * i + 1, " ".join(f"{i}x{k}" for k in range(percent + 4 + more))))]
    kept = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).where("kept").count()
    assert kept == 400
    below = lambda p, m: sum(math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(m))
    for p in (85, 80, 70):
        m = neardup.agreements(p)
        assert below(p / 100, m) <= neardup.MISSED < below(p / 100, m + 1)


def test_near_stage_drops_from_080(spark):
    """Planted pairs with similarity 100 / 124, between 0.80 and 0.85; one of 100 / 126 stays whole."""
    import corpus_pipeline

    pair = lambda i, n: [(2 * i, " ".join(f"{i}x{k}" for k in range(104))), (2 * i + 1, " ".join(f"{i}x{k}" for k in range(104 + n)))]
    docs = spark.createDataFrame([r for i in range(50) for r in pair(i, 24)] + pair(50, 26), "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert left == {2 * i for i in range(51)} | {101}


def test_near_duplicates_without_a_hub(spark):
    """A chain in which only neighbours are linked."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 200])) for i in range(12)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_brute(rows)


def test_large_lists_are_dealt_by_size(spark, monkeypatch):
    """With tiny blocks every list is dealt by size and into blocks; the result is still that of brute force."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, f"{common} " + " ".join(f"d{i}x{k}" for k in range(20 + 3 * (i % 9)))) for i in range(40)]
    words = [f"w{i}" for i in range(400)]
    rows += [(100 + i, " ".join(words[10 * i : 10 * i + 200])) for i in range(12)] + [(200 + i, common + " tail" * (i % 3)) for i in range(8)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_brute(rows)


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """8 MB of texts in one partition; a batch is held several times outside the heap, so none may be that large."""
    hashes = neardup.shingle_sets

    def small(column, width):
        assert column.nbytes < 4_000_000, column.nbytes
        return hashes(column, width)

    monkeypatch.setattr(neardup, "shingle_sets", small)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    frame = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 250), k -> hex(xxhash64(id div 2, k))), id) AS text")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame).collect()}
    assert got == {i: (247, i - i % 2) for i in range(2000)}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_few_rows_are_written_in_few_files(spark, monkeypatch):
    """Narrow rows that come out of a shuffle of wide ones are one file, however many tasks that shuffle had."""
    written, write = [], neardup.stash

    def noted(df, label, *a, **b):
        out = write(df, label, *a, **b)
        written.append((label, len(out.inputFiles()), out.count()))
        return out

    monkeypatch.setattr(neardup, "stash", noted)
    words = [[f"{i}x{k}" for k in range(60)] for i in range(40)]
    rows = [(2 * i + j, " ".join(w[: 60 - j])) for i, w in enumerate(words) for j in (0, 1)]
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 2 for i in range(80)}
    few = [x for x in written if x[0] in ("pairs", "candidates", "ids", "links", "live") and x[2]]
    assert ("candidates", 1, 40) in few and ("links", 1, 40) in few
    assert all(files == 1 for _, files, _ in few), few


def test_links_at_exactly_the_threshold(spark):
    """17 of 20 shingles shared is a link at 85 percent, 84 of 99 is not."""
    rows = []
    for i in range(30):
        words = [f"{i}x{k}" for k in range(200)]
        rows += [(3 * i, " ".join(words[:21])), (3 * i + 1, " ".join(words[:24])), (3 * i + 2, " ".join(words[:29]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_brute(rows) and got[1] == (20, 0) and got[2] == (25, 2)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(40, 41), (41, 42), (40, 42)], "a long, b long")
    got = dict(connected_components(edges).collect())
    assert set(got.values()) == {1, 40} and got[20] == 1 and got[42] == 40


def test_decontaminate(spark, docs):
    passage = docs.where("doc_id = 12").first().text.split()
    bench = spark.createDataFrame([(1, " ".join(passage[5:18]).upper()), (2, "one, TWO"), (3, None), (4, "...")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): (r.n_hit, r["items"]) for r in decontam.find_contamination(docs, bench, block_windows=2).collect()}
    assert got[(12, 60)] == (13, ["1"]) and got[(8, 2)] == (2, ["2"]) and got[(5, 0)] == (0, [])
    assert sum(v[0] > 0 for v in got.values()) == 2
    empty = decontam.find_contamination(docs, bench.limit(0))
    assert empty.count() == docs.count() and empty.where("n_hit > 0").count() == 0


def test_shards(docs):
    got = sharding.assign_shards(docs, 4).collect()
    assert len(got) == docs.count()
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    loads = [sum(r.size for r in got if r.shard == s) for s in range(4)]
    largest = max(r.size for r in got)
    assert max(loads) - min(loads) <= 2 * largest
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 8} == {(15, zlib.crc32(b"one two"))}
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 5} == {(8, 0)}


def test_shards_of_one_hot_text(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("x"), "id")).alias("text"))
    loads = [r[1] for r in sharding.assign_shards(rows, 8).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(loads) == 8 and max(loads) - min(loads) < 40


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(["http://a.example.net/en/1", "http://A.Example.NET/de/1", "https://x.org/fr/9?q", "ftp://y.com#z", None, "no scheme", "http://spam.net/buy", "http://net", "http://net/"])] * 6
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), url_filter.DEFAULT_RULES).collect()}
    assert (got[0].rule, got[0].verdict) == ("example.net/en/", "allow")
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/de/1", "net/", "block")
    assert (got[2].rule, got[2].path) == ("org/fr/", "/fr/9")
    assert (got[3].host, got[3].path, got[4].host, got[5].path) == ("y.com", "", "", "")
    assert got[7].rule is None and got[8].rule == "net/"
    assert {r.verdict for r in got.values()} <= {"allow", "block"}


def test_url_models_learn(spark):
    good = [f"https://news{i}.example.net/en/story-{i}" for i in range(60)]
    bad = [f"http://casino-win{i}.net/bets?free={i}" for i in range(60)]
    asked = [(1000, "https://news99.example.com/en/story-5"), (1001, "http://casino-win7.com/bets?free=1")]
    frame = spark.createDataFrame(asked + list(enumerate(good + bad)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(frame, url_filter.DEFAULT_RULES).where("page_id >= 1000").collect()}
    assert got == {1000: "allow", 1001: "block"}


def url_model_brute(taught, order=url_filter.ORDER, contexts=url_filter.CONTEXTS):
    """The two variable-order models from their definition; returns the score of a URL."""
    fold = lambda u: re.sub(r"[^a-z0-9./\\\-_?=&%#:]", "~", (u or "").lower())
    counts, total = {}, 0
    for verdict, urls in taught.items():
        for u in urls:
            framed = "^" * order + fold(u) + "$"
            for i in range(order, len(framed)):
                total += 1
                for n in range(order + 1):
                    pair = counts.setdefault(framed[i - n : i], {}).setdefault(framed[i], {"allow": 0, "block": 0})
                    pair[verdict] += 1
    size = lambda c: sum(sum(x.values()) for x in counts[c].values())
    kept = {c for c in counts if len(c) < 2 or size(c) * contexts >= total}

    def chance(context, symbol, side):
        below = chance(context[1:], symbol, side) if context else 1 / len(url_filter.OUTCOMES)
        seen = [x[side] for x in counts[context].values()]
        n, kinds = sum(seen), sum(x > 0 for x in seen)
        return (counts[context].get(symbol, {side: 0})[side] + kinds * below) / (n + kinds) if n else below

    def score(u):
        framed, out = "^" * order + fold(u) + "$", []
        for i in range(order, len(framed)):
            context = next(framed[i - n : i] for n in range(order, -1, -1) if framed[i - n : i] in kept)
            out.append(np.log10(chance(context, framed[i], "allow")) - np.log10(chance(context, framed[i], "block")))
        return np.mean(out)

    return score


def test_url_scores_follow_the_definition(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "CONTEXTS", 60)
    good = [f"https://news{i}.example.net/en/story-{i}" for i in range(40)]
    bad = [f"http://casino-win{i}.net/bets?free={i}&É" for i in range(40)]
    other = ["https://news7.example.com/x", "", None, "zzz ###", "http://" + "a/b" * 500]
    frame = spark.createDataFrame(list(enumerate(good + bad + other)), "page_id long, url string")
    got = {r.url: r for r in url_filter.judge_urls(frame, url_filter.DEFAULT_RULES).collect()}
    teach = lambda urls: [u for u in urls if zlib.crc32(u.encode()) % 5]
    score = url_model_brute({"allow": teach(good), "block": teach(bad)}, contexts=60)
    assert all(got[u].score == pytest.approx(score(u), abs=1e-9) for u in good + bad + other)
    held = [(got[u].score, v) for urls, v in ((good, "allow"), (bad, "block")) for u in urls if not zlib.crc32(u.encode()) % 5]
    assert held and all((s > 0) == (v == "allow") for s, v in held)


def test_quality_scores_follow_the_definition(spark):
    """The fit on the learning fold, and each score as the logistic of the weighted features."""
    rows = [(i, text(i) + ". " + text(i + 500) + ".") for i in range(80)] + [(1000 + i, text(i).upper() + "!!") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows] + [(3, 0)], "doc_id long, quality int")
    import pyarrow as pa

    model = quality.train(frame, labels)
    learn = [(i, t) for i, t in sorted(rows) if zlib.crc32(str(i).encode()) % 5 and i != 3]  # 3 has both labels
    x = quality.features(pa.array([t for _, t in learn])).astype(np.float32).astype(np.float64)
    again = quality.fit(x, np.asarray([i < 1000 for i, _ in learn]), cutoff=0.3)
    assert np.allclose(model.weight, again.weight) and model.threshold == pytest.approx(again.threshold)
    got = {r.doc_id: r.score for r in quality.score_documents(frame, model).collect()}
    for i, t in rows:
        raw = float(((quality.features(pa.array([t]))[0] - model.mean) / model.scale) @ model.weight) - model.threshold + math.log(0.3 / 0.7)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-6)


def test_quality(spark):
    rows = [(i, text(i) + ". " + text(i + 500) + ".") for i in range(120)] + [(1000 + i, text(i).upper().replace(" ", "!! ")) for i in range(60)] + [(5000, None), (5001, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows[:-2]] + [(9999, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.score_documents(frame, quality.train(frame, labels)).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows)
    assert np.mean([(got[i] >= 0.3) == (i < 1000) for i, _ in rows[:-2]]) > 0.97
    assert {r.score for r in quality.score_documents(frame, quality.train(frame, labels.limit(0))).collect()} == {0.3}


def test_language_model(spark, docs):
    got = lm.score_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower()) + ["\0end"] for r in docs.collect() if r.doc_id is not None}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    counts = {}
    for i, w in words.items():
        for x in w if not out[i] else []:
            counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in got:
        base = sum(np.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in words[r.doc_id])
        assert r.base_score == pytest.approx(base) and r.train_tokens == n and r.held_out == out[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(words[r.doc_id]), sum(x in counts for x in words[r.doc_id]))
        assert r.score < 0
    assert lm.score_documents(docs.limit(0)).count() == 0


def test_model_probabilities_sum_to_one(spark):
    """After one context every word of a small language, known or not, shares probability 1."""
    train = [(i, " ".join(np.random.default_rng(i).choice(["a", "b", "c", "d"], 30))) for i in range(1, 40) if zlib.crc32(str(i).encode()) % 10]
    probe_ids = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    probes = list(zip(probe_ids, ["a", "b", "c", "d", "zzz", None], strict=True))
    got = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(train + [(i, t) for i, t in probes] + [(5000, "a a a")], "doc_id long, text string")).collect()}
    # P(x | start) P(end | x) for one-word texts cannot exceed P(x | start); the empty text is P(end | start).
    assert sum(10 ** got[i] for i in probe_ids) < 1.0


def test_every_context_counts(spark):
    """The words after a word seen 5 times in 120,000 tokens are told apart: P(next | context) is near (5 - d) / (5 + s)."""
    ids = iter(i for i in range(1, 2000) if zlib.crc32(str(i).encode()) % 10)
    rows = [(next(ids), text(i, 2000)) for i in range(60)]
    rows += [(next(ids), f"{text(i, 20)} {pair} {text(i + 50, 20)}") for i in range(5) for pair in ("seldom follower", "scarce stranger")]
    seen, unseen = [i for i in range(2000, 3000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows += [(seen, "alpha seldom follower"), (unseen, "alpha seldom stranger")]
    got = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("held_out").collect()}
    assert got[seen] > got[unseen] + 2


def test_frequent_words_are_counted_in_all_chunks(spark):
    """A word seen 8 times is frequent where 8 is the bound, though no chunk has it as often."""
    rows = [(i, " ".join([text(i, 29_990)] + ["uneven"] * n)) for i, n in ((1, 5), (2, 1), (3, 1), (4, 1))]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")
    chunks = lm.tokenise(frame, "doc_id", "text", 1 << 40)
    counted = lm.count_words(lm.ask_words(chunks, 8), 8, frequent=8)
    word = lm.word_hashes(np.frombuffer(b"uneven", np.uint8), np.asarray([0, 6]))[0]
    assert chunks.count() == 4
    for row in chunks.collect():
        vocabulary = lm._load(row.words)[0]
        order, at = lm._by_bucket(lm._bucket(vocabulary, 8), 8)
        place = int(np.flatnonzero(vocabulary == word)[0])
        b = int(lm._bucket(word, 8)[0])
        number, count, often = lm._load(counted.where((F.col("chunk_id") == row.chunk_id) & (F.col("bucket") == b)).first().blob)
        mine = order[at[b] : at[b + 1]].tolist().index(place)
        assert (count[mine], bool(often[mine])) == (8, True) and number[mine] > 0


def test_scores_do_not_depend_on_the_layout(spark):
    """The same corpus in 1 and in 16 partitions, with a chunk each."""
    rows = [(i, text(i, 40 + i % 7) + f" rare{i % 50} word{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    scores = lambda n: {r.doc_id: (r.score, r.base_score) for r in lm.score_documents(frame.repartition(n)).collect()}
    one, many = scores(1), scores(16)
    assert one.keys() == many.keys() and all(one[i] == pytest.approx(many[i], abs=1e-4) for i in one)


def plain_scores(texts: dict[int, list[str]], held_out: set[int], turns: int) -> dict[int, float]:
    """The model's scores by a sampler that unseats and seats single customers; probabilities averaged over its turns."""
    rng, s = np.random.default_rng(7), 1.0
    pairs = [(a, b) for i, w in texts.items() if i not in held_out for a, b in zip(["\0end", *w], w, strict=False)]
    counts = Counter(pairs)
    n1, n2 = (sum(c == n for c in counts.values()) for n in (1, 2))
    d, d0, v = float(np.clip(n1 / max(n1 + 2 * n2, 1), 0.3, 0.9)), 0.6, len({b for _, b in pairs})
    low: dict[str, list[int]] = {}  # sizes of the parent's tables
    high: dict[tuple[str, str], list[int]] = {}

    def parent(w: str) -> float:
        n, t = sum(map(sum, low.values())), sum(map(len, low.values()))
        return (sum(low.get(w, [])) - d0 * len(low.get(w, [])) + (1.0 + d0 * t) / (v + 1)) / (1.0 + n)

    def chance(a: str, w: str) -> float:
        rows = [x for (c, _), x in high.items() if c == a]
        n, t, own = sum(map(sum, rows)), sum(map(len, rows)), high.get((a, w), [])
        return (sum(own) - d * len(own) + (s + d * t) * parent(w)) / (s + n)

    def seat(tables: list[int], discount: float, new: float) -> bool:
        weight = np.asarray([n - discount for n in tables] + [new])
        k = int(rng.choice(len(weight), p=weight / weight.sum()))
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return tables[k] == 1

    def leave(tables: list[int]) -> bool:
        k = int(rng.choice(len(tables), p=np.asarray(tables) / sum(tables)))
        tables[k] -= 1
        if tables[k]:
            return False
        del tables[k]
        return True

    def enter(a: str, w: str) -> None:
        t = sum(len(x) for (c, _), x in high.items() if c == a)
        if seat(high.setdefault((a, w), []), d, (s + d * t) * parent(w)):
            seat(low.setdefault(w, []), d0, (1.0 + d0 * sum(map(len, low.values()))) / (v + 1))

    for pair in pairs:
        enter(*pair)
    asked = {(a, b) for w in texts.values() for a, b in zip(["\0end", *w], w, strict=False)}
    total = dict.fromkeys(asked, 0.0)
    for turn in range(2 * turns):
        for a, w in pairs:
            if leave(high[a, w]):
                leave(low[w])
            enter(a, w)
        if turn >= turns:
            for pair in asked:
                total[pair] += chance(*pair) / turns
    return {i: sum(np.log10(total[pair]) for pair in zip(["\0end", *w], w, strict=False)) for i, w in texts.items()}


@pytest.mark.parametrize("frequent", [1, 1 << 40])
def test_scores_follow_the_model(spark, frequent):
    """Every text's score against the plain sampler, with all contexts dealt by the pair and with none."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    chance = 1 / np.arange(1, 13) / (1 / np.arange(1, 13)).sum()
    texts = {i: [*rng.choice(words, rng.integers(0, 9), p=chance).tolist(), "\0end"] for i in range(1, 61)}
    texts[61], texts[62] = ["w0", "strange", "w1", "\0end"], ["\0end"]
    held_out = {i for i in texts if zlib.crc32(str(i).encode()) % 10 == 0}
    want = plain_scores(texts, held_out, 60)
    frame = spark.createDataFrame([(i, " ".join(w[:-1])) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.score_documents(frame, frequent=frequent).collect()}
    assert got.keys() == want.keys()
    off = {i: abs(got[i] - want[i]) / len(w) for i, w in texts.items()}
    assert max(off.values()) < 0.1 and np.mean(list(off.values())) < 0.03


def test_a_pair_that_is_half_of_a_corpus_leaves_no_large_group(spark):
    """Its chunks send it once each: what a bucket holds follows the distinct pairs, not the tokens."""
    rows = [(i, "again and " * 20_000 + text(i, 50)) for i in range(1, 9)]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")
    chunks = lm.tokenise(frame, "doc_id", "text", 1 << 40)
    counted = lm.count_words(lm.ask_words(chunks, 8), 8)
    got = lm.build(lm.deal(chunks, counted, 8), 8).where("state is not null").collect()
    largest = max(len(lm._load(r.refs)[2]) for r in got)
    assert sum(int(lm._load(r.state)[5].sum()) for r in got) > 300_000 and largest < 2_000


def test_seatings_match_customers_moved_one_by_one():
    """Mean tables of each dish against the plain sampler, which unseats a customer and seats it again."""
    rng, d, s = np.random.default_rng(1), 0.7, 1.0
    customers, h = [6, 3, 1, 2], np.asarray([0.4, 0.3, 0.2, 0.1])
    seats, total = [[1] * c for c in customers], np.zeros(4)
    for turn in range(4000):
        for w, tables in enumerate(seats):
            for _ in range(customers[w]):
                i = rng.choice(len(tables), p=np.asarray(tables) / sum(tables))
                tables[i] -= 1
                if not tables[i]:
                    tables.pop(i)
                weight = np.asarray([n - d for n in tables] + [(s + d * sum(map(len, seats))) * h[w]])
                j = rng.choice(len(weight), p=weight / weight.sum())
                if j == len(tables):
                    tables.append(1)
                else:
                    tables[j] += 1
        total += [len(t) for t in seats] if turn >= 200 else 0
    mine, tables = np.zeros(4), np.ones(4, np.int64)
    for _ in range(4000):
        tables = seating.sweep(np.asarray(customers), tables, h, np.zeros(4, np.int64), np.zeros(1), d, s, rng)
        mine += tables
    assert np.abs(mine / 4000 - total / 3800).max() < 0.12


def test_ways_to_part_many_customers(monkeypatch):
    """Beyond the exact table, the formulas agree with the recursion."""
    from math import lgamma

    monkeypatch.setattr(seating, "EXACT", 200)
    for d in (0.35, 0.7):
        seating.log_ways.cache_clear()
        table = seating.log_ways(d)
        for c, t in ((70, 1), (70, 8), (70, 9), (70, 30), (200, 5), (200, 60)):
            one = np.asarray([c])
            assert seating.log_ways_large(one, np.asarray([t]), d, seating.edge_error(one, d))[0] == pytest.approx(table[c, t] - lgamma(c + 1), abs=0.07)
    seating.log_ways.cache_clear()


def test_html():
    page = '<html><head><title>T</title></head><body><nav><a href="/">Menu</a></nav><article><h1>A &amp; B</h1><p><b>One\n two<br>three<p>Four &lt;5&gt;</article><script>var x="</p>"</script><footer>&copy; x</footer>'
    assert [b.text for b in blocks_of(page)] == ["Menu", "A & B", "One two", "three", "Four <5>", "© x"]
    assert html_extract.markup_labels(blocks_of(page)) == [0, 1, 1, 1, 1, 0]
    assert blocks_of("") == [] and [b.text for b in blocks_of("plain <b>te")] == ["plain te"]


def test_html_training(spark):
    pages = [f'<html><body><nav><ul><li><a href="/">{text(i, 2)}</a></li></ul></nav><div class="ad">{text(i + 70, 6)}</div><article><h1>{text(i, 5)}</h1><p>{text(i + 1, 30)}.</p></article><footer>{text(i, 4)}</footer></body></html>' for i in range(40)]
    frame = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)] + [(99, "u", None)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_main_text(frame).collect()}
    want = {i: f"{text(i, 5)} {text(i + 1, 30)}." for i in range(40)} | {99: ""}
    assert np.mean([got[i] == want[i] for i in want]) > 0.95


def test_chat(spark):
    trap = r"\### <|end|> | \l </turn> ok"
    rows = [(1, 2, "assistant", "two"), (1, 1, "user", trap), (1, 3, "assistant", trap), (2, 1, None, None), (None, 1, "assistant", "é\n")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert chat.read_turns(got[1].formatted) == [("user", trap), ("assistant", "two"), ("assistant", trap)]
    assert chat.read_loss(got[1].formatted, [s.asDict() for s in got[1].loss]) == "two" + trap
    assert chat.read_turns(got[2].formatted) == [("", "")] and got[2].loss == []
    assert chat.read_loss(got[None].formatted, [s.asDict() for s in got[None].loss]) == "é\n"


def test_one_long_conversation(spark, monkeypatch):
    """A conversation of many batches is written in parts that read back as the whole."""
    monkeypatch.setattr(chat, "PART_BYTES", 4000)
    turns = [(7, i, "assistant" if i % 2 else "user", f"turn {i} | <x> " + "y" * (i % 50)) for i in range(900)]
    rows = pa_tables([(6, 0, "user", "short"), *turns, (8, 0, "assistant", "a"), (None, 0, "user", "n")])
    made = [r for b in chat.format_batches(iter(rows)) for r in b.to_pylist()]
    assert [(r["conv_id"], r["part"]) for r in made if r["conv_id"] != 7] == [(6, 0), (8, 0), (None, 0)]
    long = [r for r in made if r["conv_id"] == 7]
    assert len(long) > 5 and [r["part"] for r in long] == list(range(len(long))) and sum(r["n_turns"] for r in long) == 900
    assert [t for r in long for t in chat.read_turns(r["formatted"])] == [(t[2], t[3]) for t in turns]
    assert "".join(chat.read_loss(r["formatted"], r["loss"]) for r in long) == "".join(t[3] for t in turns if t[2] == "assistant")


def pa_tables(rows, n=100):
    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    table = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema).select(["conv_id", "role", "text"])
    return table.to_batches(max_chunksize=n)


def test_nearest_with_levels_and_copies(spark, monkeypatch):
    """Cells are cut again, one vector has hundreds of copies, and all results are those of brute force but for few."""
    monkeypatch.setattr(ann, "CELL_POINTS", 600)
    monkeypatch.setattr(ann, "SLICE_POINTS", 200)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(8, 8))[rng.integers(0, 8, 2500)] * 3 + rng.normal(size=(2500, 8))).astype(np.float32)
    x[1000:1400] = x[1000]
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    wide, hit = x.astype(np.float64), 0
    for q in range(0, 2500, 50):
        d = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        want = np.lexsort((np.arange(2500), d))[:10].tolist()
        assert len(own) == 10 and (own == want or not 1000 <= q < 1400)
        hit += len(set(own) & set(want))
    assert hit >= 0.9 * 10 * 50


def test_nearest(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 3
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16))).astype(np.float32)
    x[500:520] = x[500]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    wide, hit = x.astype(np.float64), 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and all(r.score == d[r.vec_id] for r in own)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        hit += len({r.vec_id for r in own} & set(np.lexsort((np.arange(3000), d))[:10].tolist()))
    assert hit >= 0.9 * 300 and {r.query_id for r in got} == set(range(0, 3000, 100))
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 500), key=lambda r: r.rank)] == list(range(501, 511))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = [(i, text(i, 80) + ".") for i in range(60)]
    rows = good + [(100, good[3][1]), (101, good[4][1] + " more")] + [(200 + i, text(i).upper().replace(" ", "!! ")) for i in range(40)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(good[7][1].split()[10:24]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept == set(range(60)) - {7}


def test_digest_of_conversation_order(spark):
    from graphloom.llm.queries import ORACLES, QUERIES

    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", k)[0] for k in QUERIES}
    assert set(ORACLES) <= set(QUERIES) and hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("turned", [False, True])
def test_one_id_with_several_texts_is_one_node(spark, parts, turned):
    """Each text of an id keeps its own links, whatever the order of the rows."""
    a, b = text(101, 80), text(102, 80)
    rows = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (8, text(103, 80)), (4, "x " + b), (9, None), (9, text(103, 80) + " end"), (3, None)]
    frame = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").repartition(parts)
    found = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(frame).collect()}
    assert found == {(4, 4), (5, 4), (6, 4), (7, 4), (8, 8), (9, 8), (9, 9), (3, 3)}


@pytest.fixture(scope="module")
def network():
    """Random weights: enough to tell whether two ways of reading a page agree."""
    r, width = np.random.default_rng(0), html_extract.PATH + html_extract.WORDS + html_extract.MEASURES
    p = {"o": r.normal(0, 0.2, 64).astype(np.float32), "ob": np.zeros(1, np.float32)}
    for side in "fr":
        p |= {f"{side}x": r.normal(0, 0.1, (width, 128)).astype(np.float32), f"{side}h": r.normal(0, 0.2, (32, 128)).astype(np.float32), f"{side}b": np.zeros(128, np.float32)}
    return p


def test_pages_in_stretches_and_batches_read_alike(network, monkeypatch):
    r = np.random.default_rng(3)
    pages = ["".join(f"<div class=c{int(r.integers(3))}><p>{text(int(r.integers(99)), int(r.integers(1, 9)))}</p>" + "</div>" * int(r.integers(2)) for _ in range(int(r.integers(0, 40)))) for _ in range(30)]
    whole = html_extract.main_texts(network, pages)
    assert any(whole)
    for steps in (5, 64):
        monkeypatch.setattr(html_extract, "STEPS", steps)
        assert html_extract.main_texts(network, pages) == whole
    assert list(html_extract._shares_of(["x" * 3_000_000] * 3 + ["y"] * 300)) == [(0, 1), (1, 2), (2, 258), (258, 303)]


@pytest.mark.parametrize("page", ["".join(f"<div><p>Text number {i} with some words here.</p></div>" for i in range(100_000)), "<div>x" * 83_000, "<p><table>" + "<a href=x><div>y" * 30_000], ids=["long", "deep", "links"])
def test_long_and_deep_pages_are_linear(network, page):
    """Beside short pages: a minute and a gigabyte are far more than they take."""
    import time
    import tracemalloc

    small = ["<p>short one.</p>"] * 63
    began = time.perf_counter()
    html_extract.main_texts(network, [page, *small])
    assert time.perf_counter() - began < 60
    tracemalloc.start()
    blocks = blocks_of(page[: len(page) // 4])
    html_extract.long_scores(network, blocks)
    assert tracemalloc.get_traced_memory()[1] < 250_000_000
    tracemalloc.stop()
