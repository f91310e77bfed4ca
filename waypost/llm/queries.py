"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_text import extract_main_text
from .language import predict_languages
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .media import media_columns
from .mixing import mix_sources
from .near_dup import near_duplicates
from .packing import CAPACITY, near_items_of, pack
from .phrases import mine_phrases
from .prefix_trie import prefix_trie
from .quality import predict_quality
from .token_files import read_token_files, write_token_files
from .vector_search import top_k

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as chunked 8-bit sample streams, stored, read back and described."""
    return media_columns(_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected near-duplicate documents at a shingle similarity of 0.75."""
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line of the corpus matches."""
    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words, with at most two pieces of a source and no near copies in a bin."""
    return pack(near_items_of(_table(spark, sf_dir, "documents")))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document by a 5 : 2 : 1 mix of one and a half times the corpus."""
    return mix_sources(_table(spark, sf_dir, "documents"))


def op7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all texts, learnt from those that are not held out."""
    return predict_languages(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all texts, learnt from the labels that are not held out."""
    return predict_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best integer inner products of every fiftieth vector."""
    return top_k(_table(spark, sf_dir, "embeddings"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the token files."""
    parts = write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(parts)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of turns that conversations begin with."""
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of two to five words."""
    return mine_phrases(_table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and covered licence texts of every document."""
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op13: words and the places of the phrases."""
    return op13_license_scan(spark, sf_dir).drop("labels", "score")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op1: sizes and digests of the payloads read back."""
    return op1_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


def packed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op4: the words of every document's pieces, and the largest bin they lie in."""
    packed = op4_pack_documents(spark, sf_dir)
    return packed.groupBy("doc_id").agg(F.sum("words").alias("words"), F.coalesce(F.max("bin_words") <= CAPACITY, F.lit(True)).alias("fits"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op6: sizes and targets."""
    return op6_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


_OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE
           WHEN len(w) = 0 THEN []
           WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT links.y, reach.seen FROM reach JOIN links ON links.x = reach.doc_id),
components AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, sets.doc_id = component_id AS kept
FROM sets JOIN components USING (doc_id)
"""

_OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
sets AS (
  SELECT doc_id, line_no, line,
         list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS s
  FROM lines),
kinds AS (SELECT s, len(s) AS n, min((doc_id, line_no)) AS at, row_number() OVER () AS id FROM sets WHERE len(s) > 0 GROUP BY s),
words AS (SELECT id, n, unnest(s) AS w FROM kinds),
counts AS (SELECT w, count(*) AS c FROM words GROUP BY w),
prefixes AS (
  SELECT id, n, w FROM words JOIN counts USING (w)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY c, w) <= n - CAST(ceil(n * 9 / 10.0) AS BIGINT) + 1),
pairs AS (
  SELECT DISTINCT a.id AS x, b.id AS y FROM prefixes a JOIN prefixes b
  ON a.w = b.w AND a.id <> b.id AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 9),
matches AS (
  SELECT y.id, min(x.at) AS at FROM pairs JOIN kinds x ON x.id = pairs.x JOIN kinds y ON y.id = pairs.y
  WHERE 10 * len(list_intersect(x.s, y.s)) >= 9 * (x.n + y.n - len(list_intersect(x.s, y.s)))
  GROUP BY y.id),
decided AS (
  SELECT sets.doc_id, sets.line_no, sets.line,
         len(sets.s) > 0 AND coalesce(least(kinds.at, matches.at), kinds.at) < (sets.doc_id, sets.line_no) AS gone
  FROM sets LEFT JOIN kinds USING (s) LEFT JOIN matches ON matches.id = kinds.id)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS text,
       CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS removed_lines
FROM decided GROUP BY doc_id
UNION ALL SELECT doc_id, text, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END, 0
FROM documents WHERE text IS NULL OR doc_id IS NULL
"""

_OP9_SQL = """
WITH parts AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM parts),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_OP11_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
own AS (
  SELECT conv_id AS c, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS s,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, list(s ORDER BY pos) AS turns,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda x, b: xor(x >> 8, t[CAST(xor(x, b) & 255 AS INTEGER) + 1])), 4294967295) % 6 AS h
  FROM own, crc GROUP BY c, t),
rebuilt AS (
  SELECT x.c, list_concat(coalesce(b.turns[1:x.h], []), x.turns[x.h + 1:]) AS turns FROM convs x LEFT JOIN convs b ON b.c = x.c - x.c % 100),
steps AS (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt),
paths AS (SELECT c, d, turns[1:d] AS path, d = len(turns) AS ends FROM steps),
nodes AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY d, path),
family AS (
  SELECT n.*, u.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes u ON u.d = n.d - 1 AND u.path = n.path[1:n.d - 1]),
kids AS (SELECT conv_id, d, (SELECT count(*) FROM family k WHERE k.d = f.d + 1 AND k.parent_conv_id = f.conv_id) AS n_children, n_convs,
           CASE WHEN d > 0 THEN (n_convs - 1) * length(path[d].text) ELSE 0 END AS own_saved FROM family f),
-- every node counts for all nodes on the path of its smallest member
above AS (
  SELECT n.conv_id, n.d, k.n_children, k.own_saved FROM kids k JOIN paths p ON p.c = k.conv_id AND p.d <= k.d JOIN nodes n ON n.d = p.d AND n.path = p.path),
sums AS (SELECT conv_id, d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(own_saved) AS BIGINT) AS saved_tokens FROM above GROUP BY conv_id, d)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM family JOIN kids USING (conv_id, d, n_convs) JOIN sums USING (conv_id, d)
"""

_OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM words, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
counts AS (SELECT lang, phrase, min(m) AS m, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= 100),
split AS (SELECT lang, phrase, m, f, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM split),
cut AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n, 1000 * c.f * n // (x.f * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN sizes ON sizes.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(f) AS longer
  FROM split, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 6)) AS j) WHERE i < j AND j <= m AND j - i + 1 < m GROUP BY 1, 2),
kept AS (SELECT cut.* FROM cut LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR longer < a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""

_PLACES_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS k
  FROM documents),
spots AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
places AS (
  SELECT k, i - 1 AS i, 'cc-by' AS label FROM spots WHERE w[i] = 'cc' AND w[i + 1] = 'by'
  UNION ALL SELECT k, i - 1, 'gpl' FROM spots WHERE w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license'
  UNION ALL SELECT k, i - 1, 'reserved' FROM spots WHERE w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved')
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM words LEFT JOIN places USING (k) GROUP BY k, doc_id, w
"""

_PAYLOADS_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents),
padded AS (SELECT doc_id, n, t || repeat(' ', CASE WHEN n = 0 THEN 192 ELSE (192 - n % 192) % 192 END) AS p FROM texts)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(strlen(p) AS BIGINT) AS payload_bytes, sha256(p) AS payload_sha256, CAST(strlen(p) + 44 AS BIGINT) AS media_bytes
FROM padded
"""

_PACKED_SQL = r"""
SELECT doc_id, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS words, TRUE AS fits FROM documents GROUP BY doc_id
"""

_TARGETS_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
weighed AS (SELECT *, [5e0, 2e0, 1e0][(place - 1) % 3 + 1] AS w, source_size * 2e0 AS cap FROM sources),
-- a source is full if all with a smaller share of cap to weight are, and what is left would take it over its cap
ranked AS (
  SELECT *, sum(source_size) OVER () * 1.5e0 AS total, coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM weighed),
rates AS (SELECT max((total - filled) / weights) AS rate FROM ranked)
SELECT sized.doc_id, sized.size, source_size, round(least(w * rate, cap), 6) AS target
FROM sized JOIN ranked ON ranked.source IS NOT DISTINCT FROM sized.source, rates
"""

QUERIES: dict[str, Query] = {
    "op1_media_columns": op1_media_columns,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_dedup_lines": op3_dedup_lines,
    "op4_pack_documents": op4_pack_documents,
    "op5_main_text": op5_main_text,
    "op6_mix_sources": op6_mix_sources,
    "op7_languages": op7_languages,
    "op8_quality": op8_quality,
    "op9_top_k": op9_top_k,
    "op10_token_files": op10_token_files,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_phrases": op12_phrases,
    "op13_license_scan": op13_license_scan,
    "license_places": license_places,
    "media_payloads": media_payloads,
    "mix_targets": mix_targets,
    "packed_words": packed_words,
}

ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": _OP2_SQL,
    "op3_dedup_lines": _OP3_SQL,
    "op9_top_k": _OP9_SQL,
    "op11_prefix_trie": _OP11_SQL,
    "op12_phrases": _OP12_SQL,
    "license_places": _PLACES_SQL,
    "media_payloads": _PAYLOADS_SQL,
    "mix_targets": _TARGETS_SQL,
    "packed_words": _PACKED_SQL,
}
