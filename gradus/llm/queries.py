"""The registered queries of this package and, where SQL can say it, the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_filter
from .common import load
from .tokens import public_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(load(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(load(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


@query("op5_token_id_files")
def op5_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import new_folder
    from .token_files import read_ids, write_ids

    docs, folder = load(spark, sf_dir, "documents"), new_folder(spark, "token-ids")
    write_ids(docs, folder, public_path("word_bpe_49k.json"), byte_level=False, end_id=1)
    return read_ids(spark, folder)


@query("op7_secret_scans")
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digests, find_secrets

    return digests(find_secrets(load(spark, sf_dir, "documents")))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op8_decontamination",
    sql=f"""
    WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
    item_window AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS words
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item WHERE len(w) > 0)
    ),
    doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
    size AS (SELECT DISTINCT n FROM item_window),
    doc_window AS (
        SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS words
        FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc JOIN size ON len(w) >= n)
    ),
    hit AS (SELECT r, i, d.n, item_id FROM doc_window d JOIN item_window USING (n, words)),
    place AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r),
    named AS (
        SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY r
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN place USING (r) LEFT JOIN named USING (r)
    """,
)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    return decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("spans", "items")


@query("op10_ngram_jaccard")
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "class_id", "links")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import remainder
    from .toxicity import toxicity

    scored = toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


#: A page is labelled by the quality of the document whose number its path ends with.
_NUMBER = r"([0-9]+)(\.html)?/?$"


@query(
    "op3_url_filter",
    sql=url_filter.sql(
        rf"""
        SELECT page_id, quality AS good FROM labels JOIN (
            SELECT page_id, TRY_CAST(regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '{_NUMBER}', 1) AS BIGINT) AS number FROM pages
        ) ON doc_id = number"""
    ),
)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    number = F.regexp_extract(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), _NUMBER, 1).try_cast("long")
    known = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    marks = pages.select("page_id", number.alias("doc_id")).join(known, "doc_id").select("page_id", "good")
    return url_filter.judge_urls(pages, marks)


@query(
    "op6_exact_top_k",
    sql="""
    WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
        FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
    """,
)
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import lm_scores

    return lm_scores(load(spark, sf_dir, "documents"))


@query("op11_chunk_bpe")
def op11_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunk_bpe import digests, encode_and_decode

    return digests(encode_and_decode(load(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json")))


@query(
    "op12_hard_negatives",
    sql="""
    WITH whole AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
        SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
        FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
    ),
    positive AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    )
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM positive JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
    """,
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)



#: Rows after damage with their faults, as CTEs.
_FAULTY = r"""
    byte_crc AS (
        SELECT list(c ORDER BY b) AS crcs FROM (
            SELECT b, list_reduce([b] || generate_series(1, 8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c
            FROM (SELECT CAST(unnest(generate_series(0, 255)) AS BIGINT) AS b))
    ),
    plain AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
        FROM conversations
    ),
    summed AS (
        SELECT plain.*, xor(list_reduce([4294967295] || list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT)),
                   lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
        FROM plain, byte_crc
    ),
    given AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM summed, (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
    ),
    ordered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial,
               rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen
        FROM given
    ),
    faulty AS (
        SELECT *, CASE WHEN seen = '' THEN 'blank'
                       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                       WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
               lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
        FROM ordered
    )"""


def _step(state: str, cost: str, letter: str, turn: str = "NULL") -> str:
    """An edit that leads on from a state's least (c, a, t): cost, audit, turns given out."""
    said = f"{state}.t" if turn == "NULL" else f"list_append({state}.t, {turn})"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {said}}} END"


def _least(*options: str) -> str:
    return f"list_min(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))"


def _conversation_sql() -> str:
    """Row by row forward: the least cost, then the ASCII-least audit, of having given out nothing (n), a system turn
    (s), a user turn (u) or an assistant turn (a). A row's edit is chosen first, then up to two insertions."""
    may = lambda states: f"fault IN ('', 'truncated') AND initial = '{states}'"
    late = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    said = "role || ':' || text"
    stays = "fault IN ('', 'truncated')"

    def edits(to: str, kept: tuple, initial: str, rerolled: tuple, role: str) -> str:
        own = [_step(to, "2", "D")]
        own += [f"CASE WHEN {may(initial)} THEN {_step(x, late, 'K', said)} END" for x in kept]
        own += [f"CASE WHEN {stays} THEN {_step(x, f'1 + {late}', 'R', f"'{role}:' || text")} END" for x in rerolled]
        return _least(*own)

    inserted = lambda x, role: _step(x, "5", "I", f"'{role}:'")
    once_u = _least("u", *[inserted(x, "user") for x in ("n", "s", "a")])
    once_a = _least("a", inserted("u", "assistant"))
    twice_u, twice_a = _least("u1", inserted("a1", "user")), _least("a1", inserted("u1", "assistant"))
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]))"
    return f"""
    WITH RECURSIVE {_FAULTY},
    total AS (
        SELECT conv_id, count(*) AS many, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
               count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM faulty GROUP BY conv_id
    ),
    path AS (
        SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} AS n, {none} AS s,
               {{'c': CAST(5 AS BIGINT), 'a': 'I', 't': ['user:']}} AS u, {{'c': CAST(10 AS BIGINT), 'a': 'II', 't': ['user:', 'assistant:']}} AS a
        FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT conv_id, i, n, s, {twice_u} AS u, {twice_a} AS a FROM (
            SELECT conv_id, i, n, s, {once_u} AS u1, {once_a} AS a1 FROM (
                SELECT f.conv_id, f.i, {_least(_step("n", "2", "D"))} AS n, {edits("s", ("n",), "s", (), "")} AS s,
                       {edits("u", ("n", "s", "a"), "u", ("n", "s", "a"), "user")} AS u, {edits("a", ("u",), "a", ("u",), "assistant")} AS a
                FROM path p JOIN faulty f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1
            )
        )
    ),
    best AS (
        SELECT p.conv_id, {_least("n", "a")} AS b, coalesce(t.gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
        FROM path p LEFT JOIN total t ON p.conv_id IS NOT DISTINCT FROM t.conv_id WHERE p.i = coalesce(t.many, 0)
    )
    SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate, CAST(truncated AS BIGINT) AS truncated,
           CAST(illegal AS BIGINT) AS illegal, b.c AS cost, b.a AS audit, sha256(array_to_string(b.t, chr(10))) AS repaired_sha256
    FROM best
    """


@query("op13_conversation_repair", sql=_conversation_sql())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turns import damaged, repair

    conversations = load(spark, sf_dir, "conversations")
    return repair(damaged(conversations), conversations)[0]


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
