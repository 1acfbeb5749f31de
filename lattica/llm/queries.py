"""The queries op1 to op13 over the tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, exact_dedup, inner, jaccard, line_dedup, mixing, pii, quality, ranked, substring_dedup, trie, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in the whole text of every document."""
    found = pii.find_pii(_table(spark, sf_dir, "documents"), pii.trained())
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, pii.KINDS),
        F.sha2(pii.digest("base"), 256).alias("base_sha256"),
        pii.digest("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of those with its text."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


URL_RULES = (
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages share their ids with labels: a page is bad if its label says toxic or of low quality."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    return urls.judge(pages, pages.join(labels, "page_id"), URL_RULES)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near duplicates."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and its group."""
    return embeddings.near_dedup(_table(spark, sf_dir, "embeddings"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    import public_tokenizers

    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = bpe.encode_decode(_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        "doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows that an earlier one has, as a digest."""
    out = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of quality for every document; labels of held-out ones are not learnt from."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, machine).select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one has, as a digest."""
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for every benchmark item."""
    return ranked.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that begin with turns of another one of their five."""
    turns, convs = trie.numbered(_table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    heads = F.crc32(conv.cast("string").cast("binary")) % 9
    return trie.prefix_trie(*trie.respliced(turns, convs, conv - conv % 5, heads, 8))


def op13_top_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all others."""
    return inner.top_inner(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_urls": op3_urls,
    "op4_jaccard": op4_jaccard,
    "op5_mixing": op5_mixing,
    "op6_embeddings": op6_embeddings,
    "op7_bpe": op7_bpe,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality": op9_quality,
    "op10_line_dedup": op10_line_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_top_inner": op13_top_inner,
}

ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY t)
    """,
    "op4_jaccard": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k
            FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM t WHERE len(w) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), o AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o
            FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL
        ), l AS (
            SELECT a, b FROM o JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * o >= 80 * (p.n + q.n - o)
        ), r AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id
        FROM (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) LEFT JOIN n USING (doc_id)
    """,
    "op5_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
        ), w AS (
            SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS BIGINT) AS w
            FROM s
        ), f AS (
            SELECT *, source_size * CAST(2.0 AS DOUBLE) / w AS fill FROM w
        ), l AS (
            SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
                       - CAST(coalesce(sum(source_size) OVER up, 0) AS DOUBLE) * 2.0) / sum(w) OVER down AS level
            FROM f
            WINDOW up AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                   down AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        ), x AS (
            SELECT arg_min(level, fill) AS level FROM l WHERE fill > level
        ), a AS (
            SELECT source, source_size,
                   CASE WHEN x.level IS NULL OR fill <= x.level THEN source_size * CAST(2.0 AS DOUBLE)
                        ELSE x.level * w END AS target
            FROM f CROSS JOIN x
        ), p AS (
            SELECT d.doc_id, size, source_size, target,
                   CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id) AS BIGINT) - size AS place,
                   CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
            FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source
        )
        SELECT doc_id, size, source_size, target,
               CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - place))
                    AS BIGINT) AS taken
        FROM p
    """,
    "op6_embeddings": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), r AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
        )
        SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
        FROM (SELECT a AS vec_id, min(b) AS c FROM r GROUP BY a)
        LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
    """,
    "op8_substring_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), x AS (
            SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k
            FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM t)
        ), f AS (
            SELECT k, min(doc_id) AS first FROM x GROUP BY k
        ), g AS (
            SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM x JOIN f USING (k) WHERE first < doc_id
        ), words AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t
        ), kept AS (
            SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS kept, count(*) AS n
            FROM words ANTI JOIN g ON words.doc_id = g.doc_id AND words.p = g.p GROUP BY words.doc_id
        )
        SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM t LEFT JOIN kept USING (doc_id)
    """,
    "op10_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, pos, line,
                   translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
        ), s AS (
            SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10
            GROUP BY k HAVING count(DISTINCT doc_id) >= 2
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM (SELECT l.*, coalesce(s.first <> l.doc_id, false) AS gone FROM l LEFT JOIN s USING (k))
        GROUP BY doc_id
    """,
    "op11_ranked_search": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), b AS (
            SELECT item_id, t, count(*) AS times
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
            GROUP BY item_id, t
        ), tot AS (
            SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM w WHERE len(terms) > 0
        ), p AS (
            SELECT doc_id, t, CAST(count(*) AS BIGINT) AS tf, CAST(any_value(n) AS BIGINT) AS n
            FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS t FROM w) GROUP BY doc_id, t
        ), f AS (
            SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
            FROM p CROSS JOIN tot GROUP BY t, n_docs
        ), s AS (
            SELECT item_id, doc_id,
                   CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM b JOIN f USING (t) JOIN p USING (t) CROSS JOIN tot GROUP BY item_id, doc_id
        )
        SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        WHERE rank <= 10
    """,
    "op12_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                                      sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ), h AS (
            SELECT c, xor(4294967295, list_reduce(
                list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                                         lambda y, z: xor(y >> 1, (y & 1) * 3988292384)))) % 9 AS h
            FROM (SELECT DISTINCT c FROM t)
        ), r AS (
            SELECT h.c, t.pos AS k, role, text FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.pos <= h
            UNION ALL SELECT h.c, t.pos + 1000000, role, text FROM h JOIN t ON t.c = h.c AND t.pos > h
        ), l AS (
            SELECT h.c, list(sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text) ORDER BY k) FILTER (WHERE k IS NOT NULL) AS ds,
                   list(CAST(strlen(text) AS BIGINT) ORDER BY k) FILTER (WHERE k IS NOT NULL) AS bs
            FROM h LEFT JOIN r ON h.c = r.c GROUP BY h.c
        ), m AS (
            SELECT c, d, coalesce(len(ds), 0) AS n, array_to_string(ds[1:d], ',') AS k, array_to_string(ds[1:d - 1], ',') AS pk, bs[d] AS bytes
            FROM (SELECT *, unnest(generate_series(0, coalesce(len(ds), 0))) AS d FROM l)
        ), nodes AS (
            SELECT d, coalesce(k, '') AS k, any_value(coalesce(pk, '')) AS pk, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(bytes), 0) AS bytes,
                   sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends
            FROM m GROUP BY d, coalesce(k, '')
        ), up AS (
            SELECT x.d, x.k, y.d AS below, y.k AS below_k, CASE WHEN y.d = 0 THEN 0 ELSE (y.n_convs - 1) * y.bytes END AS saved,
                   NOT EXISTS (SELECT 1 FROM nodes z WHERE z.d = y.d + 1 AND z.pk = y.k) AS leaf
            FROM nodes x JOIN nodes y ON y.d >= x.d AND (x.d = 0 OR x.k = substr(y.k, 1, 65 * x.d - 1))
        )
        SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
               (SELECT count(*) FROM nodes z WHERE z.d = n.d + 1 AND z.pk = n.k) AS n_children,
               s.n_leaves, s.saved_tokens, n.ends AS ends_sha256
        FROM nodes n
        LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.pk
        JOIN (SELECT d, k, count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY d, k) s
            ON s.d = n.d AND s.k = n.k
    """,
    "op13_top_inner": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
            FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e)
        )
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5
    """,
}
