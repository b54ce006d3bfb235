"""The registered queries of this subpackage: thin digests of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, linededup, ngramlm, packing, phrases, prefixtrie, quality, sentences, simhash, substring, tokens, toxicity
from .common import id_text

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_dedup(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_logistic(*quality.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return quality.quality_rules(docs, model)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score_texts(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents")).drop("removed")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_documents(table(spark, sf_dir, "documents"), tokens.vocabulary()))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_text() % 3 == 1, F.lit(False))
    model = quality.fit_embeddings(*quality.labelled_sample(docs, table(spark, sf_dir, "labels"), allowed=~held_out))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents")).drop("deleted")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_token_files(tokens.write_token_files(table(spark, sf_dir, "documents"), tokens.vocabulary()))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_text() % 4 == 2, F.lit(False))
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), allowed=~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.shared_head_trie(table(spark, sf_dir, "conversations"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_benchmark_decontamination, op3_quality_rules, op4_lm_scoring, op5_suffix_array_dedup, op6_best_fit_packing, op7_quality_classifier, op8_line_dedup, op9_token_files, op10_simhash_near_dedup, op11_toxicity, op12_conversation_prefix_trie, op13_phrase_collocations)
}
ORACLE: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH c AS (SELECT doc_id, flatten(list_transform(string_split(regexp_replace(text, '([.!?][ \t\r\n]+|\n+)', '\1' || chr(1), 'g'), chr(1)), lambda p:
             CASE WHEN len(regexp_extract_all(p, '[^\x09-\x0D\x20]+')) <= 20 THEN [p] ELSE
               flatten(list_transform(string_split(regexp_replace(p, '([,;:][ \t\r\n]+)', '\1' || chr(1), 'g'), chr(1)), lambda q:
                 CASE WHEN len(regexp_extract_all(q, '[^\x09-\x0D\x20]+')) <= 20 THEN [q] ELSE
                   string_split(array_to_string(list_transform(regexp_extract_all(q, '[\x09-\x0D\x20]*[^\x09-\x0D\x20]+[\x09-\x0D\x20]*'), lambda t:
                     t || CASE WHEN md5(regexp_extract(t, '[^\x09-\x0D\x20]+'))[1] IN ('0', '1') THEN chr(1) ELSE '' END), ''), chr(1)) END)) END)) AS ps FROM documents),
s AS (SELECT doc_id, piece, s, row_number() OVER w - 1 AS pos, len(regexp_extract_all(s, '[^\x09-\x0D\x20]+')) AS n, sum(n) OVER w AS upto
      FROM (SELECT doc_id, unnest(range(len(ps))) AS piece, trim(unnest(ps), chr(32) || chr(9) || chr(13) || chr(10)) AS s FROM c) WHERE s <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY piece)),
d AS (SELECT doc_id, list(s ORDER BY pos) AS said FROM s GROUP BY doc_id),
e AS (SELECT x.doc_id, x.pos, greatest(x.pos + 1, y.pos) AS last FROM (SELECT doc_id, pos, upto - n + 20 AS least FROM s) x ASOF JOIN s y ON x.doc_id = y.doc_id AND x.least <= y.upto),
r AS (SELECT doc_id, pos, last, array_to_string(list_slice(said, pos + 1, last + 1), chr(10)) AS k FROM e JOIN d USING (doc_id) WHERE last < len(said)),
a AS (SELECT * FROM r UNION ALL SELECT doc_id, 0, len(said) - 1, 'whole' || chr(1) || array_to_string(said, chr(10)) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM r)),
f AS (SELECT k, min({'d': doc_id, 'p': pos}) AS f FROM a GROUP BY k HAVING count(*) > 1),
later AS (SELECT a.doc_id, a.pos, a.last FROM a JOIN f USING (k) WHERE NOT (a.doc_id = f.f.d AND a.pos = f.f.p)),
covered AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM later),
gone AS (SELECT s.doc_id, list(s.piece) AS ns FROM s JOIN covered USING (doc_id, pos) GROUP BY s.doc_id)
SELECT t.doc_id, coalesce(len(d.said), 0) AS n_sentences, coalesce(len(gone.ns), 0) AS n_removed,
       CASE WHEN gone.ns IS NULL THEN t.text ELSE coalesce(array_to_string(list_filter(c.ps, lambda x, i: NOT list_contains(gone.ns, i - 1)), ''), '') END AS text
FROM documents t LEFT JOIN c ON t.doc_id = c.doc_id LEFT JOIN gone ON t.doc_id = gone.doc_id LEFT JOIN d ON t.doc_id = d.doc_id""",
    "op8_line_dedup": r"""
WITH l AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pos
           FROM (SELECT doc_id, unnest(range(len(ls))) AS line_no, trim(translate(unnest(ls), chr(9) || chr(11) || chr(12) || chr(13), '    ')) AS line
                 FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE line <> ''),
p AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM l),
g AS (SELECT line, nxt, min({'d': doc_id, 'p': pos}) AS f FROM p WHERE nxt IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
later AS (SELECT p.doc_id, p.pos FROM p JOIN g ON p.line = g.line AND p.nxt = g.nxt WHERE NOT (p.doc_id = g.f.d AND p.pos = g.f.p)),
gone AS (SELECT DISTINCT l.doc_id, l.line_no FROM l JOIN (SELECT doc_id, pos FROM later UNION SELECT doc_id, pos + 1 FROM later) x ON l.doc_id = x.doc_id AND l.pos = x.pos),
d AS (SELECT doc_id, list(line_no) AS ns FROM gone GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT t.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(len(d.ns), 0) AS n_deleted,
       CASE WHEN d.ns IS NULL THEN t.text ELSE coalesce(array_to_string(list_filter(string_split(t.text, chr(10)), lambda x, i: NOT list_contains(d.ns, i - 1)), chr(10)), '') END AS text
FROM documents t LEFT JOIN d ON t.doc_id = d.doc_id LEFT JOIN n ON t.doc_id = n.doc_id""",
    "op12_conversation_prefix_trie": r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS m, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) - 1 AS i, m, length(text) AS size FROM t),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
        xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda a, x:
          list_reduce(range(8), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END, xor(a, x)), 4294967295), 4294967295) % 6 AS h FROM t),
r AS (SELECT c.conv_id, 0 AS own, o.i, o.m, o.size FROM c JOIN o ON o.conv_id = c.base AND o.i < c.h UNION ALL SELECT c.conv_id, 1, o.i, o.m, o.size FROM c JOIN o ON o.conv_id = c.conv_id AND o.i >= c.h),
s AS (SELECT conv_id, row_number() OVER w AS depth, size, array_to_string(list(m) OVER w, '') AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
p AS (SELECT conv_id, 0 AS depth, 0 AS size, '' AS path FROM c UNION ALL SELECT * FROM s),
n AS (SELECT min(conv_id) AS conv_id, depth, path, count(*) AS n_convs, max(size) AS size FROM p GROUP BY depth, path),
e AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path),
k AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT left(path, 32 * d) AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM v) GROUP BY 1)
SELECT v.conv_id, v.depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM v JOIN u ON u.path = v.path LEFT JOIN n q ON v.depth > 0 AND q.depth = v.depth - 1 AND q.path = left(v.path, 32 * (v.depth - 1)) LEFT JOIN e ON e.path = v.path""",
    "op13_phrase_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS ph FROM w, range(1, 4) t(k)),
f AS (SELECT lang, ph, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10 OR len(ph) = 1),
n AS (SELECT lang, sum(f) AS n FROM f WHERE len(ph) = 1 GROUP BY lang),
c AS (SELECT lang, ph, f AS a FROM f WHERE len(ph) > 1),
s AS (SELECT c.lang, c.ph, c.a, k, x.f AS l, y.f AS r, (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS score
      FROM (SELECT *, ph[1:k] AS lp, ph[k + 1:] AS rp FROM c, range(1, 3) t(k) WHERE k < len(ph)) c JOIN f x ON x.lang = c.lang AND x.ph = c.lp JOIN f y ON y.lang = c.lang AND y.ph = c.rp),
b AS (SELECT lang, ph, any_value(a) AS a, min({'score': score, 'k': k, 'l': l, 'r': r}) AS s FROM s GROUP BY lang, ph),
m AS (SELECT lang, ph, max(a) AS most FROM (SELECT lang, ph[1:2] AS ph, a FROM c WHERE len(ph) = 3 UNION ALL SELECT lang, ph[2:3], a FROM c WHERE len(ph) = 3) GROUP BY lang, ph),
z AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, b.a, b.s.l AS l, b.s.r AS r, CAST(b.s.score AS BIGINT) AS score FROM b LEFT JOIN m USING (lang, ph) WHERE m.most IS NULL OR 100 * m.most < 50 * b.a),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM k JOIN n USING (lang) WHERE rank <= 2000""",
}
