"""The opN queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import collocations, exactdedup, jaccard, labelled, lexical, licenses, linededup, mixing, neardup, piecebpe, quality, tokencount, topk, toxicity
from gridloom.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, scale=256, every=50)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, words=5)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.template_table(spark), percent=80)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), ratio=1.5, max_copies=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def _scored(docs: DataFrame, score, held_out) -> DataFrame:
    scored = docs.select("doc_id", held_out.alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality.train_quality(docs, labels, labelled.fold(3) != 1)
    return _scored(docs, quality.quality_score(net, F.col("text")), labelled.fold(3) == 1)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train_toxicity(docs, labels, labelled.fold(5) != 0)
    return _scored(docs, toxicity.toxicity_score(model, F.col("text")), labelled.fold(5) == 0)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = linededup.drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecebpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), percent=90, words=3)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term's weight is floor(1000 ln((2N + 2) / (2df + 1))); a document adds weight * ((10^9 tf) div (1000 tf + 12 m)) for each
    term of the item, m being 75 + (25 n N) div L."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), min_count=30, longest=4, inside_percent=80, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_topk, op2_near_duplicates, op3_exact_dedup, op4_license_scan, op5_token_counts, op6_mix_sources, op7_quality, op8_toxicity, op9_line_dedup, op10_sentencepiece,
        op11_jaccard_join, op12_search, op13_collocations,
    ]
    return {f.__name__: f for f in found}


#: White space, as a regular expression of the SQL engine.
_WS = r"[\x20\x09-\x0D]"


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _template_values() -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in licenses.TEMPLATES.items())


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": """
            WITH i AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                       WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
                 p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
                       FROM i q JOIN i c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
                 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op3_exact_dedup": f"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}+', ' ', 'g') AS t FROM documents),
                 w AS (SELECT doc_id, t, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS pos,
                              first(doc_id) OVER (PARTITION BY t ORDER BY doc_id) AS keep_id,
                              count(*) OVER (PARTITION BY t) AS group_size FROM n)
            SELECT doc_id, keep_id, group_size, pos = 1 AS kept, sha256(t) AS text_sha256 FROM w""",
        "op4_license_scan": f"""
            WITH t(license_id, text) AS (VALUES {_template_values()}),
                 tw AS (SELECT license_id, list_filter(string_split_regex({_FOLD}, '[^0-9a-z]+'), lambda x: x <> '') AS w FROM t),
                 ts AS (SELECT DISTINCT license_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM tw)),
                 tn AS (SELECT license_id, count(*) AS n_template FROM ts GROUP BY license_id),
                 dw AS (SELECT doc_id, list_filter(string_split_regex({_FOLD}, '[^0-9a-z]+'), lambda x: x <> '') AS w FROM documents),
                 ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM dw)),
                 m AS (SELECT doc_id, license_id, count(*) AS n_matched FROM ds JOIN ts USING (s) GROUP BY ALL)
            SELECT doc_id, license_id, n_matched, n_template FROM m JOIN tn USING (license_id) WHERE n_matched * 100 >= 80 * n_template""",
        "op9_line_dedup": f"""
            WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
                 l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
                 k AS (SELECT *, translate(regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
                 f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
                 s AS (SELECT k.*, f.key IS NULL AS stays FROM k LEFT JOIN f ON k.key = f.key)
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
            FROM s GROUP BY doc_id""",
        "op12_search": rf"""
            WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_FOLD}, '{lexical.TERM}')) AS term FROM documents),
                 p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
                 d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
                 c AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM d),
                 w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(nd) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
                 m AS (SELECT doc_id, 75 + (25 * n * nd) // l AS m FROM d, c),
                 q AS (SELECT item_id, unnest(regexp_extract_all({_FOLD}, '{lexical.TERM}')) AS term FROM benchmark),
                 s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
                       FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL),
                 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
            SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
        "op13_collocations": rf"""
            WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_FOLD}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
                 w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
                 i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
                 g AS (SELECT lang, w[i:i+len-1] AS g, len FROM i, (VALUES (1), (2), (3), (4)) AS n(len) WHERE i + len - 1 <= len(w)),
                 f AS (SELECT lang, array_to_string(g, ' ') AS phrase, any_value(g) AS g, any_value(len) AS len, count(*) AS f FROM g GROUP BY ALL),
                 t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len = 1 GROUP BY lang),
                 c AS (SELECT * FROM f WHERE len >= 2 AND f >= 30),
                 k AS (SELECT *, unnest(range(1, len)) AS k FROM c),
                 s AS (SELECT k.lang, k.phrase, k.f AS a, k.k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * k.f) // (x.f + y.f) AS BIGINT) AS score
                       FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.g[1:k.k], ' ')
                              JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.g[k.k+1:], ' ')),
                 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
                 z AS (SELECT lang, g, len, f, unnest(range(1, len)) AS lo FROM c WHERE len >= 3),
                 o AS (SELECT z.lang, array_to_string(g[lo:lo+n.len-1], ' ') AS phrase, max(f) AS around FROM z, (VALUES (2), (3)) AS n(len)
                       WHERE n.len < z.len AND lo + n.len - 1 <= z.len GROUP BY ALL),
                 e AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE around IS NULL OR 100 * around < 80 * a),
                 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank FROM e)
            SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN t USING (lang) WHERE rank <= 2000""",
    }
