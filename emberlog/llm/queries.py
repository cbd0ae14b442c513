"""Registered queries of the operators and the SQL they are checked against.

Each reads whole tables and returns one row per row of its table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.alignment import align_tokens
from emberlog.llm.ann import nearest_neighbours
from emberlog.llm.common import fold
from emberlog.llm.decontaminate import find_benchmark, hit_words
from emberlog.llm.lines import dedup_lines
from emberlog.llm.lm import score_texts
from emberlog.llm.neardup import near_duplicates
from emberlog.llm.packing import pack_documents
from emberlog.llm.quality import score_quality, train_quality
from emberlog.llm.sitetree import extract_articles
from emberlog.llm.tokenfiles import read_token_files, write_token_files
from emberlog.llm.trie import prefix_trie, rebuilt
from emberlog.llm.urls import UrlRule, judge_urls
from emberlog.llm.warc import read_warc, write_warc
from emberlog.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    UrlRule("com/", allow=True),
    UrlRule("example.com/en/", allow=False),
    UrlRule("www.example.com/en/", allow=True),
    UrlRule("net/es/", allow=False),
    UrlRule("net/fr/", allow=False),
    UrlRule("*/login/*", allow=False, glob=True),
    UrlRule("*/cart/*", allow=False, glob=True),
    UrlRule("*/ads/*", allow=False, glob=True),
    UrlRule("*/wp-admin/*", allow=False, glob=True),
    UrlRule("*?*sessionid=*", allow=False, glob=True),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(documents, _table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        hit_words("spans").alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(documents, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return score_quality(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return pieces.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(
        _table(spark, sf_dir, "documents"), scratch_dir(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )
    return read_token_files(files).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(_table(spark, sf_dir, "pages"), scratch_dir(spark, "warc"))
    return read_warc(files, payloads=False).drop("payload", "uri")


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return prefix_trie(rebuilt(conversations), conversations).drop("id", "parent")


def aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return align_tokens(documents, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {
        "op1_neighbours": neighbours,
        "op2_decontaminate": benchmark_hits,
        "op3_near_dedup": near_dedup,
        "op4_quality": quality,
        "op5_pack": packed,
        "op6_lm_scores": lm_scores,
        "op7_line_dedup": line_dedup,
        "op8_url_filter": url_filter,
        "op9_token_files": token_files,
        "op10_warc": archived,
        "op11_conversation_trie": conversation_trie,
        "op12_token_alignment": aligned_tokens,
        "op13_page_articles": page_articles,
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '{2}')".format(
    _UPPER, _LOWER, "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
)
_BENCHMARK_HITS = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS gram FROM (
        SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (
    SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS gram FROM (
        SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs,
            (SELECT DISTINCT least(10, len(w)) AS n FROM items WHERE len(w) > 0) WHERE len(w) >= n)
), found AS (SELECT doc_id, n, i, item_id FROM grams JOIN windows USING (gram)),
hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), who AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)
"""

_NEAR_DEDUP = f"""
WITH RECURSIVE sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(list_slice(w, i, i + 3), ' ') FOR i IN range(1, len(w) - 2)]) END AS s
    FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ \\t-\\r]+') AS w FROM documents)
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON r = x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

_LINE_DEDUP = """
WITH RECURSIVE lines AS (
    SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
), full_lines AS (SELECT * FROM lines WHERE trim(line, ' ') <> ''),
classes AS (SELECT line, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM full_lines)),
sets AS (
    SELECT id, list_distinct([substr(line, i, 9) FOR i IN range(1, greatest(length(line) - 8, 1) + 1)]) AS s FROM classes
), grams AS (SELECT id, len(s) AS n, unnest(s) AS g FROM sets),
-- With shingles in one order, rare ones first, two similar sets meet in the first fifth of each.
often AS (SELECT g, row_number() OVER (ORDER BY count(*), g) AS place FROM grams GROUP BY g HAVING count(*) > 1),
firsts AS (
    SELECT id, n, g FROM (SELECT id, n, g, row_number() OVER (PARTITION BY id ORDER BY coalesce(place, 0), g) AS k FROM grams LEFT JOIN often USING (g))
    WHERE k <= n - (80 * n + 99) // 100 + 1
), candidates AS (
    SELECT DISTINCT a.id AS x, b.id AS y FROM firsts a JOIN firsts b ON a.g = b.g AND a.id < b.id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), links AS (
    SELECT x, y FROM (
        SELECT x, y, len(a.s) AS n, len(b.s) AS m, len(list_intersect(a.s, b.s)) AS common FROM candidates JOIN sets a ON a.id = x JOIN sets b ON b.id = y
    ) WHERE 100 * common >= 80 * (n + m - common)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (SELECT id, id AS r FROM classes UNION SELECT reach.id, y FROM reach JOIN both_ways ON r = x),
roots AS (SELECT id, min(r) AS component FROM reach GROUP BY id),
ranked AS (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY component ORDER BY doc_id, pos) AS k
    FROM full_lines JOIN classes USING (line) JOIN roots USING (id)
), counts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_dropped FROM ranked GROUP BY doc_id),
texts AS (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept
    FROM lines LEFT JOIN ranked USING (doc_id, pos) WHERE coalesce(k, 1) = 1 GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
    CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS text_sha256
FROM documents LEFT JOIN counts USING (doc_id) LEFT JOIN texts USING (doc_id)
"""

_SITE = f"""
    SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path, rest
    FROM (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
"""
_HOST_RULES = ", ".join(f"('{r.text}', {'TRUE' if r.allow else 'FALSE'})" for r in URL_RULES if not r.glob)
_GLOB_RULES = ", ".join(f"('{r.text}', {'TRUE' if r.allow else 'FALSE'})" for r in URL_RULES if r.glob)
_URL_FILTER = f"""
WITH site AS ({_SITE}),
hosts(text, allow) AS (VALUES {_HOST_RULES}), globs(text, allow) AS (VALUES {_GLOB_RULES}),
by_host AS (
    SELECT page_id, arg_max(text, length(text)) AS rule, arg_max(allow, length(text)) AS allow FROM site JOIN hosts
    ON (host = split_part(text, '/', 1) OR ends_with(host, '.' || split_part(text, '/', 1)))
        AND starts_with(path, substr(text, strpos(text, '/'))) GROUP BY page_id
), by_glob AS (
    SELECT page_id, max((length(text), text, allow)) AS best FROM site JOIN globs ON rest SIMILAR TO
        replace(replace(text, '?', '\\?'), '*', '(.|\\n)*') GROUP BY page_id
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN best[2] END AS pattern,
    CASE WHEN coalesce(by_host.allow, best[3], TRUE) THEN 'allow' ELSE 'block' END AS verdict
FROM site LEFT JOIN by_host USING (page_id) LEFT JOIN by_glob USING (page_id)
"""


_ARCHIVED = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
heads AS (SELECT html, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
    CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN heads USING (html)
"""


# crc32 by its table of 256 values, which the first part computes.
_CONVERSATION_TRIE = """
WITH RECURSIVE crc_table AS (
    SELECT list(c ORDER BY b) AS crc FROM (
        SELECT b, list_reduce([b::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(3988292384::UBIGINT, a >> 1) ELSE a >> 1 END) AS c
        FROM range(256) t(b))
), turns AS (
    SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), shares AS (
    SELECT conv_id, s, xor(list_reduce(list_concat([4294967295::UBIGINT], [ord(x)::UBIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
        lambda a, x: xor(crc[(xor(a, x) & 255)::BIGINT + 1], a >> 8)), 4294967295::UBIGINT) % 9 AS h
    FROM turns, crc_table
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.s[1:h], []), c.s[h + 1:]) AS s FROM shares c LEFT JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 5
), members AS (
    SELECT conv_id, d, md5(s[1:d]::VARCHAR) AS id, CASE WHEN d > 0 THEN md5(s[1:d - 1]::VARCHAR) END AS up, d = len(s) AS ended,
        CASE WHEN d > 0 THEN strlen(s[d].t) ELSE 0 END AS size
    FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT d, id, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
    FROM members GROUP BY d, id
), childs AS (SELECT d - 1 AS d, up AS id, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN childs USING (d, id)),
above AS (
    SELECT d, id, up, n_children, (n_convs - 1) * size AS saved, d AS at_d, id AS at_id FROM full_nodes
    UNION ALL SELECT a.d, a.id, n.up, a.n_children, a.saved, n.d, n.id FROM above a JOIN nodes n ON n.d = a.at_d - 1 AND n.id = a.up
), sums AS (
    SELECT at_d AS d, at_id AS id, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY 1, 2
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums USING (d, id) LEFT JOIN nodes p ON p.d = n.d - 1 AND p.id = n.up
"""

# The article element of each page as the tables write it: blocks are h1 and p.
_PAGE_ARTICLES = r"""
WITH articles AS (
    SELECT page_id, url, unnest(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h1)>')) AS block,
        generate_subscripts(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h1)>'), 1) AS place
    FROM pages
), blocks AS (
    SELECT page_id, url, place, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(block, '<br>', ' '), '<[^>]*>', '', 'g'),
        '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS line FROM articles
), texts AS (SELECT page_id, string_agg(line, chr(10) ORDER BY place) AS text FROM blocks WHERE line <> '' GROUP BY page_id)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM pages LEFT JOIN texts USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": _BENCHMARK_HITS,
        "op3_near_dedup": _NEAR_DEDUP,
        "op7_line_dedup": _LINE_DEDUP,
        "op8_url_filter": _URL_FILTER,
        "op10_warc": _ARCHIVED,
        "op11_conversation_trie": _CONVERSATION_TRIE,
        "op13_page_articles": _PAGE_ARTICLES,
    }
