"""One query for each operator of the training-data pipeline, over its whole tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlake.llm import bpe, chat, decontaminate, linededup, partenum, quality, repair, rules, secrets, tokencounts, tokenfiles, trie, vectors
from boardlake.llm.common import shared_dir, table

MULTI = "byte_bpe_multi_50k.tiktoken"
BYTES = "byte_bpe_50k.json"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI), public_tokenizers.PATTERN)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.train(documents, table(spark, sf_dir, "labels")))


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat.link(chat.as_mail(table(spark, sf_dir, "conversations")))
    return linked.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256"), "reply_to", "thread", "position"
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.report(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.links(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    tokenfiles.write(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), folder)
    return tokenfiles.digests(tokenfiles.read(spark, folder))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI), public_tokenizers.PATTERN
    )


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_decontamination, op3_quality_classifier, op4_quotation_linking, op5_quality_rules,
        op6_ngram_jaccard_join, op6_ngram_jaccard_links, op7_secret_scan, op8_token_files, op9_line_dedup, op10_token_counts,
        op11_structure_repair, op12_embedding_dedup, op13_prefix_trie,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of the ASCII text x.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) + 1), lambda i: ascii(x[i])::BIGINT)), lambda a, b:"
    " list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295::BIGINT)"
)


def _way(of: str, cost: str, edit: str, told: str = "''") -> str:
    """A way (cost, audit, text with a newline before each row) with one edit more."""
    return f"{{'c': ({of}).c + {cost}, 'a': ({of}).a || '{edit}', 'o': ({of}).o || {told}}}"


_FAR = "{'c': 1000000, 'a': '~', 'o': ''}"
_GONE = [_way(f"w[{k}]", "4", "D") for k in range(1, 5)]
_BEFORE_USER = "least(w[1], w[2], w[4])"


def _kept(initial: str, of: str) -> str:
    told = "chr(10) || role || ':' || text"
    return f"CASE WHEN NOT must AND left(role, 1) = '{initial}' THEN {_way(of, 't', 'K', told)} ELSE {_FAR} END"


def _renamed(role: str, of: str) -> str:
    return f"CASE WHEN must THEN {_FAR} ELSE {_way(of, '3 + t', 'R', f"chr(10) || '{role}:' || text")} END"


ORACLE_SQL = {
    "op2_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[i:least(i + 12, len(w))] AS x
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT len(x) AS n FROM bw),
dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS x
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (x)),
cov AS (SELECT doc_id, count(DISTINCT p) AS h
        FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS l FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h, 0)::BIGINT AS n_hit, coalesce(len(l), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256,
       coalesce(h, 0) > 0 AND 20 * coalesce(h, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN it ON d.doc_id = it.doc_id""",
    "op4_quotation_linking": r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
q AS (SELECT c.*, c.turn % 4 <> 3 AND p.turn IS NOT NULL AND regexp_matches(p.text, '\S') AS answers
      FROM c LEFT JOIN c AS p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1),
r AS (SELECT *, max(CASE WHEN answers THEN NULL ELSE turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS thread FROM q)
SELECT conv_id, turn, role, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_sha256,
       CASE WHEN answers THEN turn - 1 END AS reply_to, thread,
       row_number() OVER (PARTITION BY conv_id, thread ORDER BY turn) AS position
FROM r""",
    "op5_quality_rules": r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dup FROM lines GROUP BY doc_id),
win AS (SELECT doc_id, i, w[i:i + 7] AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS rep FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM again) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
             coalesce(rep, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, coalesce(n_lines, 0) AS n_lines
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
e AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             least(1000, 1000 * n_symbols // greatest(word_chars, 1)) AS v1, least(1000, 1000 * n_dup_lines // greatest(n_lines, 1)) AS v2,
             least(1000, 1000 * n_repeat_words // greatest(n_words, 1)) AS v3, least(1000, 1000 * n_upper // greatest(word_chars, 1)) AS v4 FROM m),
q AS (SELECT lang, source, v1, v2, v3, v4, count(*) OVER (PARTITION BY lang, source) AS n,
             count(*) OVER (PARTITION BY lang, source ORDER BY v1 RANGE UNBOUNDED PRECEDING) AS c1,
             count(*) OVER (PARTITION BY lang, source ORDER BY v2 RANGE UNBOUNDED PRECEDING) AS c2,
             count(*) OVER (PARTITION BY lang, source ORDER BY v3 RANGE UNBOUNDED PRECEDING) AS c3,
             count(*) OVER (PARTITION BY lang, source ORDER BY v4 RANGE UNBOUNDED PRECEDING) AS c4
      FROM e WHERE NOT base_failed),
f AS (SELECT lang, source,
             min(CASE WHEN 1000 * c1 >= 950 * n THEN v1 END) AS f1,
             min(CASE WHEN 1000 * c2 >= 995 * n THEN v2 END) AS f2,
             min(CASE WHEN 1000 * c3 >= 995 * n THEN v3 END) AS f3,
             min(CASE WHEN 1000 * c4 >= 995 * n THEN v4 END) AS f4
      FROM q GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(v1 <= f1 AND v2 <= f2 AND v3 <= f3 AND v4 <= f4, false) AS kept
FROM e LEFT JOIN f ON e.lang IS NOT DISTINCT FROM f.lang AND e.source IS NOT DISTINCT FROM f.source""",
    "op6_ngram_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:least(i + 4, len(w))] AS x
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON c.a = d.doc_id""",
}

#: The same join with the number of links of each document.
ORACLE_SQL["op6_ngram_jaccard_links"] = ORACLE_SQL["op6_ngram_jaccard_join"].replace(
    "AS component_id", "AS component_id, coalesce(l.n_links, 0)::BIGINT AS n_links"
) + " LEFT JOIN (SELECT a, count(*) AS n_links FROM e GROUP BY a) AS l ON l.a = d.doc_id"

ORACLE_SQL["op12_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
ok AS (SELECT * FROM v WHERE n > 0 AND isfinite(n)),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_dot_product(x.v, y.v) / (x.n * y.n) >= 0.9),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a), l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.b, vec_id)) AS kept
FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN l ON l.a = vec_id"""

ORACLE_SQL["op13_prefix_trie"] = f"""
WITH o AS (SELECT conv_id AS c, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS bytes,
                  sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, turn
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, t, bytes, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, t) AS p FROM o),
h AS (SELECT c, x, {_CRC} % 9 AS h FROM (SELECT DISTINCT c, c::VARCHAR AS x FROM o)),
r AS (SELECT h.c, 0 AS k, n.p, n.t, n.bytes FROM h JOIN n ON n.c = h.c - h.c % 5 WHERE n.p <= h.h
      UNION ALL SELECT h.c, 1, n.p, n.t, n.bytes FROM h JOIN n ON n.c = h.c WHERE n.p > h.h),
d AS (SELECT c, row_number() OVER w AS depth, string_agg(t, '') OVER w AS path, bytes FROM r WINDOW w AS (PARTITION BY c ORDER BY k, p)),
m AS (SELECT c, depth, path, bytes FROM d UNION ALL SELECT c, 0, '', 0 FROM h),
z AS (SELECT c, max(depth) AS depth FROM m GROUP BY c),
nodes AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved FROM m GROUP BY path, depth),
kids AS (SELECT left(path, 64 * (depth - 1)::INT) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT left(path, 64 * k::INT) AS path, sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved
          FROM (SELECT nodes.*, kids.n IS NULL AS leaf, unnest(generate_series(0, depth)) AS k FROM nodes LEFT JOIN kids USING (path)) GROUP BY 1),
ends AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS s FROM m JOIN z USING (c, depth) GROUP BY path)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n_convs::BIGINT AS n_convs,
       coalesce(kids.n, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, sha256(coalesce(s, '')) AS ends_sha256
FROM nodes JOIN below USING (path) LEFT JOIN kids USING (path) LEFT JOIN ends USING (path)
LEFT JOIN nodes up ON nodes.depth > 0 AND up.depth = nodes.depth - 1 AND up.path = left(nodes.path, 64 * (nodes.depth - 1)::INT)"""

ORACLE_SQL["op11_structure_repair"] = rf"""
WITH RECURSIVE k AS (SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS x FROM conversations),
m AS (SELECT *, {_CRC} % 20 AS m FROM k),
b AS (SELECT c, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN m = 1 THEN '' WHEN m = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN m = 3 THEN [1, 2] ELSE [1] END) AS copy FROM m WHERE m <> 0),
f AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z,
             row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
             row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM b),
g AS (SELECT *, z = '' AS blank, z <> '' AND again AS dup, z <> '' AND NOT again AND z NOT IN ('.', '!', '?') AS cut,
             lag(role) OVER (PARTITION BY c ORDER BY i) AS prev FROM f),
rows_ AS (SELECT c, i, role, text, blank OR dup AS must, CASE WHEN cut THEN 3 ELSE 0 END AS t FROM g),
counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
                  count(*) FILTER (cut) AS truncated, count(*) FILTER (i > 1 AND left(prev, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
           FROM g GROUP BY c),
s AS (SELECT c, 0::BIGINT AS i, [{{'c': 0, 'a': '', 'o': ''}}, {_FAR}, {{'c': 3, 'a': 'I', 'o': chr(10) || 'user:'}},
             {{'c': 6, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'}}] AS w FROM counts
      UNION ALL
      SELECT c, i, [v[1], v[2], u, least(v[4], {_way("u", "3", "I", "chr(10) || 'assistant:'")})] AS w
      FROM (SELECT c, i, v, least(v[3], {_way("least(v[1], v[2], v[4])", "3", "I", "chr(10) || 'user:'")}) AS u
            FROM (SELECT s.c, r.i, [{_GONE[0]}, least({_GONE[1]}, {_kept("s", "w[1]")}),
                         least({_GONE[2]}, {_kept("u", _BEFORE_USER)}, {_renamed("user", _BEFORE_USER)}),
                         least({_GONE[3]}, {_kept("a", "w[3]")}, {_renamed("assistant", "w[3]")})] AS v
                  FROM s JOIN rows_ r ON r.c IS NOT DISTINCT FROM s.c AND r.i = s.i + 1))),
e AS (SELECT counts.*, least(w[1], w[4]) AS w FROM counts JOIN s ON counts.c IS NOT DISTINCT FROM s.c AND counts.n = s.i)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.c, 0)::BIGINT AS cost,
       coalesce(w.a, '') AS audit, sha256(coalesce(w.o[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN e ON e.c IS NOT DISTINCT FROM conv_id"""
