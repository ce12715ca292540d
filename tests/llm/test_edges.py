"""Empty tables, nulls in any column, repeated rows, long texts and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, chat, decontam, html_extract, lm, neardup, packing, quality, repair, runs, sharding, substrings, url_filter
from graphloom.llm.queries import QUERIES, tokenizer_file

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}
#: Names that operators use for results or inside; no input column may be mixed up with them.
CLASHES = "Score verdict host path rule _row _id _key _size _crc gram ratio shard slot rank part cell route key rep hub a b comp component_id kept n_hit spans items words token chunk_id blob bucket sequence_id tokens pieces task open formatted loss n_turns _text _good x".split()
LONG = "long " * 40_000


def clashing(frame):
    """``frame`` with a column of every clashing name, and one whose name needs quoting."""
    taken = {c.lower() for c in frame.columns}
    return frame.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c.lower() not in taken], F.lit(1).alias("odd.name `x"))


def documents(spark):
    rows = [(i, f"Some plain words number {i} stand here, and more of them follow after number {i + 1}.") for i in range(12)]
    rows += [(50, None), (51, ""), (52, LONG), (52, LONG), (None, None), (None, "no id"), (60, rows[3][1]), (0, rows[0][1])]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMAS["documents"])


def labels(spark):
    return spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(None, 1, 0), (3, None, 0), (1, 1, 0), (777, 0, 0)], SCHEMAS["labels"])


def benchmark(spark):
    return spark.createDataFrame([(1, "some plain words number 5 stand here and more of them"), (2, None), (None, "x y"), (1, "")], SCHEMAS["benchmark"])


def pages(spark):
    page = "<html><body><nav><a href='/'>Menu</a></nav><article><p>Text of the page number {}.</p></article></body></html>"
    rows = [(i, f"https://a{i}.example.net/en/{i}" if i % 2 else f"http://b{i}.net/x?{i}", page.format(i)) for i in range(20)]
    return spark.createDataFrame(rows + [(None, None, None), (30, "", ""), (30, "", ""), (31, "http://" + "y" * 20_000, "<p>" + LONG)], SCHEMAS["pages"])


def conversations(spark):
    rows = [(1, 2, "assistant", "two"), (1, 1, "user", "one"), (1, 1, "user", "one"), (None, None, None, None), (2, None, "assistant", LONG), (3, 0, "", "")]
    return spark.createDataFrame(rows, SCHEMAS["conversations"])


def embeddings(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)], None) for i in range(30)]
    return spark.createDataFrame(rows + [(None, [1.0, 2.0, 3.0], 1), (100, None, 1), (200, [None, 1.0, 1.0], 1), (0, [0.0, 1.0, 0.0], 1), (300, [], 1)], SCHEMAS["embeddings"])


TABLES = {"documents": documents, "labels": labels, "benchmark": benchmark, "pages": pages, "conversations": conversations, "embeddings": embeddings}

OPERATORS = {
    "pack": lambda t: packing.piece_digests(packing.pack_documents(t["documents"], tokenizer_file(), end_id=2)).drop("sequence_id", "offset"),
    "urls": lambda t: url_filter.judge_urls(t["pages"], url_filter.DEFAULT_RULES).select("page_id", "url", "host", "path", "rule", "verdict"),
    "model": lambda t: lm.score_documents(t["documents"]).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base")),
    "near": lambda t: neardup.near_duplicates(t["documents"]),
    "quality": lambda t: quality.score_documents(t["documents"], quality.train(t["documents"], t["labels"])).select("doc_id", "text", F.round("score", 9).alias("score")),
    "shard": lambda t: sharding.assign_shards(t["documents"], 3).select("doc_id", "size", "text_crc32"),
    "html": lambda t: html_extract.extract_main_text(t["pages"]).select("page_id", "url", "text"),
    "leaks": lambda t: decontam.find_contamination(t["documents"], t["benchmark"]).select("doc_id", "n_words", "n_hit", "items"),
    "chat": lambda t: chat.format_conversations(t["conversations"]).select("conv_id", "n_turns", "formatted"),
    "nearest": lambda t: ann.search(t["embeddings"], F.col("vec_id") % 10 == 0),
    "repair": lambda t: repair.repair_conversations(t["conversations"], repair.damage(t["conversations"])),
    "substrings": lambda t: substrings.cut_repeats(t["documents"]),
    "runs": lambda t: runs.judge_runs(t["documents"], plant=True),
}


def rows_of(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, name):
    plain = rows_of(OPERATORS[name]({n: make(spark) for n, make in TABLES.items()}))
    mixed = rows_of(OPERATORS[name]({n: clashing(make(spark)) for n, make in TABLES.items()}))
    assert plain and plain == mixed


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_input_row(spark, name):
    tables = {n: make(spark) for n, make in TABLES.items()}
    n = OPERATORS[name](tables).count()
    if name in ("model", "near", "quality", "shard", "leaks", "substrings", "runs"):
        assert n == tables["documents"].count()
    elif name in ("urls", "html"):
        assert n == tables["pages"].count()
    elif name in ("chat", "repair"):
        assert n == 4


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name]({n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_only_nulls(spark, name):
    nulls = {n: spark.createDataFrame([(None,) * len(s.split(", "))] * 3, s) for n, s in SCHEMAS.items()}
    assert OPERATORS[name](nulls).count() == {"nearest": 0, "chat": 1, "repair": 1}.get(name, 3)


def test_queries_on_empty_tables(spark, tmp_path):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (1 if name == "op9_format_chat" else 0), name


@pytest.mark.parametrize("make", ["full", "clashing", "empty"])
def test_stages(spark, tmp_path, make):
    """Stages keep the columns and the rows as they are, whatever the columns are called."""
    import corpus_pipeline

    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = {"full": documents, "clashing": lambda s: clashing(documents(s)), "empty": lambda s: s.createDataFrame([], SCHEMAS["documents"])}[make](spark)
    given = set(rows_of(docs))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and set(rows_of(kept)) <= given, name
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert left == (set() if make == "empty" else {*range(12), 50, 51, 52, None})
    clean = {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert clean == (set() if make == "empty" else {*range(12), 50, 51, 52, 60, None} - {5})
    assert {r.doc_id for r in corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
