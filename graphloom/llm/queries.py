"""The operators bound to the tables of a data folder, and their SQL where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import ann, chat, decontam, html_extract, lm, neardup, packing, quality, repair, runs, sharding, substrings, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op7_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extract.extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2))


@_query
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


@_query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


ORACLES["op4_near_duplicates"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), di AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM di
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), e AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a
), comp AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""


@_query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(documents, _table(spark, sf_dir, "labels"))
    scored = quality.score_documents(documents, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op8_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bi AS (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(w[i:i+9], ' ') AS win, len(w[i:i+9]) AS n FROM bi
), lens AS (
  SELECT DISTINCT n FROM bw
), di AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS win FROM di
), hit AS (
  SELECT doc_id, i, n, item FROM dw JOIN bw USING (win, n)
), pos AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit
), hits AS (
  SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id
), its AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@_query
def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op2_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.DEFAULT_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


@_query
def op9_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        def made(rows: list[list]) -> pa.RecordBatch:
            rows = [[*r[:2], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]] for r in rows]
            return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c[0], str) else pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        rows: list[list] = []  # conversations read; the parts of one follow each other
        for batch in batches:
            for conv_id, part, formatted, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if part == 0:
                    rows.append([conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0])
                row, said, loss = rows[-1], chat.read_turns(formatted), chat.read_loss(formatted, spans)
                row[2].update("".join(f"{role}\n{text}\n" for role, text in said).encode())
                row[4].update(loss.encode())
                row[1], row[3], row[5] = row[1] + len(said), row[3] + len(loss), row[5] + len(formatted)
            if len(rows) > 1:
                yield made(rows[:-1])
                rows = rows[-1:]
        if rows:
            yield made(rows)

    out = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return chat.format_conversations(turns).select("conv_id", "part", "formatted", "loss").mapInArrow(read_back, out)


ORACLES["op9_format_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, length(role) + length(text) + 2 * (length(role) + length(text)) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '|', '')) - (length(role) + length(text)) + 13 AS n FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


@_query
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut_repeats(_table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLES["op12_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), i AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS k FROM i
), low AS (
  SELECT k, min(doc_id) AS low FROM win GROUP BY k
), hit AS (
  SELECT doc_id, i FROM win JOIN low USING (k) WHERE doc_id > low
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.judge_runs(_table(spark, sf_dir, "documents"), plant=True)


@_query
def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_conversations(turns, repair.damage(turns))


ORACLES["op11_repair_conversations"] = r"""
WITH RECURSIVE crcs AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM (SELECT unnest(range(256)) AS i)
  )
), k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
  FROM conversations
), f AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
  FROM k, crcs
), r AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM f WHERE fault <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
         regexp_replace(text, '[ 	-]+$', '') AS bare, substr(role, 1, 1) AS ini
  FROM r
), m AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS mark,
         lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM o
), dp(conv_id, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {'c': 0, 'a': '', 'r': ''}, {'c': 9999999, 'a': '', 'r': ''}, {'c': 9999999, 'a': '', 'r': ''}, {'c': 9999999, 'a': '', 'r': ''} FROM m
  UNION ALL
  SELECT conv_id, i, s0d, least(s1d, CASE WHEN free AND ini = 's' THEN {'c': s0.c + x, 'a': s0.a || 'K', 'r': s0.r || said} ELSE none END),
         least(s2d, CASE WHEN free THEN {'c': e2.c + x + 1, 'a': e2.a || 'R', 'r': e2.r || chr(10) || 'user:' || text} ELSE none END, CASE WHEN free AND ini = 'u' THEN {'c': e2.c + x, 'a': e2.a || 'K', 'r': e2.r || said} ELSE none END),
         least(s3d, CASE WHEN free THEN {'c': e3.c + x + 1, 'a': e3.a || 'R', 'r': e3.r || chr(10) || 'assistant:' || text} ELSE none END, CASE WHEN free AND ini = 'a' THEN {'c': e3.c + x, 'a': e3.a || 'K', 'r': e3.r || said} ELSE none END)
  FROM (
    SELECT conv_id, i, ini, text, said, free, x, s0, e2, e3, {'c': 9999999, 'a': '', 'r': ''} AS none,
           {'c': s0.c + 2, 'a': s0.a || 'D', 'r': s0.r} AS s0d, {'c': s1.c + 2, 'a': s1.a || 'D', 'r': s1.r} AS s1d,
           {'c': t2.c + 2, 'a': t2.a || 'D', 'r': t2.r} AS s2d, {'c': t3.c + 2, 'a': t3.a || 'D', 'r': t3.r} AS s3d
    FROM (
      SELECT *, least(s2, {'c': s0.c + 5, 'a': s0.a || 'I', 'r': s0.r || i2}, {'c': s1.c + 5, 'a': s1.a || 'I', 'r': s1.r || i2}, {'c': s3.c + 5, 'a': s3.a || 'I', 'r': s3.r || i2}) AS t2,
             least(s3, {'c': s2.c + 5, 'a': s2.a || 'I', 'r': s2.r || i3}, {'c': s0.c + 10, 'a': s0.a || 'II', 'r': s0.r || i2 || i3}, {'c': s1.c + 10, 'a': s1.a || 'II', 'r': s1.r || i2 || i3}) AS t3
      FROM (
        SELECT m.conv_id, m.i, m.ini, m.text, chr(10) || m.role || ':' || m.text AS said, m.mark NOT IN ('blank', 'duplicate') AS free,
               CASE WHEN m.mark = 'truncated' THEN 5 ELSE 0 END AS x, dp.s0, dp.s1, dp.s2, dp.s3, chr(10) || 'user:' AS i2, chr(10) || 'assistant:' AS i3,
               least(dp.s0, dp.s1, dp.s3, {'c': dp.s2.c + 5, 'a': dp.s2.a || 'I', 'r': dp.s2.r || chr(10) || 'assistant:'}) AS e2,
               least(dp.s2, {'c': dp.s0.c + 5, 'a': dp.s0.a || 'I', 'r': dp.s0.r || chr(10) || 'user:'}, {'c': dp.s1.c + 5, 'a': dp.s1.a || 'I', 'r': dp.s1.r || chr(10) || 'user:'}, {'c': dp.s3.c + 5, 'a': dp.s3.a || 'I', 'r': dp.s3.r || chr(10) || 'user:'}) AS e3
        FROM dp JOIN m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.i = dp.i + 1
      )
    )
  )
), last AS (
  SELECT conv_id, max(i) AS i FROM m GROUP BY conv_id
), done AS (
  SELECT dp.conv_id, least(s0, s3, {'c': s2.c + 5, 'a': s2.a || 'I', 'r': s2.r || chr(10) || 'assistant:'}, {'c': s1.c + 10, 'a': s1.a || 'II', 'r': s1.r || chr(10) || 'user:' || chr(10) || 'assistant:'}) AS best
  FROM dp JOIN last ON last.conv_id IS NOT DISTINCT FROM dp.conv_id AND last.i = dp.i
), counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (mark = 'blank') AS blank, count(*) FILTER (mark = 'duplicate') AS duplicate,
         count(*) FILTER (mark = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM m GROUP BY conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id
"""
