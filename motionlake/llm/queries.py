"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import align, audit, bpe, chat, classify, fingerprint, linededup, mixing, neardup, rules, shard, token_count, warc
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents"))


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_by_size(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_neighbours(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("digest")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_table(table(spark, sf_dir, "conversations"), [CONTROL_CONVERSATION])


#: A conversation that says what the template's marks say: here as a record of messages, beside the table's rows by turn.
CONTROL_CONVERSATION = (-1, [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")])

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_sampled_splitters, op3_quality_rules, op4_bpe_round_trip, op5_token_counts, op6_prefix_fingerprints, op7_quality_classifier, op8_mix_sources, op9_arc_to_warc, op10_near_duplicates, op11_token_alignment, op12_filter_audit, op13_chat_formatting)
}

#: Words of a lower-cased text as a list; the six ASCII white-space characters separate them.
_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLES: dict[str, str] = {
    "op12_filter_audit": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents
        ), w AS (
            SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM t
        ), l AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
        ), f AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   (len(ws) < 200)::int AS a, (100 * list_unique(ws) < 50 * len(ws))::int AS b,
                   (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::int AS c,
                   regexp_matches(text, '[#$%&*|]')::int AS d, coalesce(w.doc_id > least, least IS NOT NULL)::int AS e
            FROM w LEFT JOIN l ON w.doc_id = l.doc_id
        ), m AS (
            SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL
        ), letter(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        o AS (
            SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM letter p, letter q, letter r, letter s, letter u
            WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5
        ), c AS (
            SELECT part, filter_order, step, n, good, toxic,
                   list_contains(failed, filter_order[step]) AS own, len(list_filter(failed, lambda x: contains(filter_order[:step - 1], x))) > 0 AS before,
                   len(failed) = 1 AS alone
            FROM (SELECT *, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i] = 1) AS failed FROM m), o, range(1, 6) AS steps(step)
        ), r AS (
            SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT own AND NOT before), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT before), 0) AS removed,
                   coalesce(sum(n) FILTER (own AND before), 0) AS redundant, coalesce(sum(n) FILTER (own AND alone), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (own AND NOT before), 0) AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT before), 0) AS toxic_lost
            FROM c GROUP BY ALL
        )
        SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
               good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
               (sum(removed) OVER (PARTITION BY part, filter_order[step]))::bigint AS shapley
        FROM r""",
    "op9_arc_to_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
        ), g AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
        SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN p.page_id < g.top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.page_id < g.top THEN g.top END AS refers_to
        FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 1000""",
    "op10_near_duplicates": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS grams FROM w
        ), t AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS g FROM s),
        l AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), r AS (
            SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
        ), c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
        SELECT s.doc_id, len(s.grams)::bigint AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
        FROM s JOIN c ON s.doc_id = c.x""",
}
