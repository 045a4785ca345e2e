"""The queries of the operators in this subpackage, over whole tables, and the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, conversation_trie, exact_dedup, forced_bpe, language_id, length_packing, lexical_search, media, ngram_jaccard, sharding, token_output, toxicity, url_filter

SHARDS = [f"shard-{i:02d}" for i in range(16)]
#: Fixed rules of the URL query.
RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]
BUCKETS, BUDGET = 8, 16384


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).drop("block", "pos")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents").select("doc_id"), SHARDS).select("doc_id", "slot", "shard")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.with_media(_table(spark, sf_dir, "documents"))
    return media.media_facts(stored, ["doc_id", "n_bytes"])


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_packing.packed(_table(spark, sf_dir, "documents"), BUCKETS, BUDGET)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_groups(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = _tokenizer()
    rows = bpe.decoded(bpe.encoded(_table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"), RULES)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(_table(spark, sf_dir, "documents"), "doc_id", F.col("text"), F.col("lang"), F.col("source"))


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return language_id.identified(_table(spark, sf_dir, "pages"), "page_id", language_id.html_text(html), language_id.html_language(html), url_filter.host_of(F.col("url")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learned(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.pack_digests(token_output.packed_ids(_table(spark, sf_dir, "documents"), *_tokenizer()))


def op11_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = forced_bpe.decoded(forced_bpe.encoded(_table(spark, sf_dir, "documents"), path), path)
    ids = F.col("ids")
    return rows.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), forced_bpe.decimal_sha256(ids).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_sharding, op3_media, op4_packing, op5_ngram_jaccard, op6_byte_bpe, op7_url_filter, op8_language_id, langid_pages, op9_toxicity, op10_token_output, op11_forced_bpe, op12_prefix_trie, op13_lexical_search)}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: CRC-32 of c in decimal, bit by bit: this engine has no function for it.
_CRC32 = """xor(4294967295, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda crc, byte: list_reduce(range(8), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(crc, byte)), CAST(4294967295 AS BIGINT)))"""
#: What a term of op13 is.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _op2_sql() -> str:
    size = sharding.prime_from(100 * len(SHARDS))
    slots = ", ".join(map(str, sharding.fill(SHARDS, size)))
    names = ", ".join(f"'{s}'" for s in SHARDS)
    return f"""
        WITH placed AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {sharding.DIGITS}))::BIGINT % {size} AS INTEGER) AS slot FROM documents)
        SELECT doc_id, slot, ([{names}])[([{slots}])[slot + 1] + 1] AS shard FROM placed"""


def _op4_sql() -> str:
    """The dynamic programme level by level, then batches by a running number."""
    levels = ["f1 AS (SELECT j, top * c - w AS cost, [CAST(0 AS BIGINT)] AS cuts FROM points)"]
    for k in range(2, BUCKETS + 1):
        levels.append(f"""
        f{k} AS (SELECT j, best.cost AS cost, list_append(cuts, best.i) AS cuts FROM (
            SELECT p.j, min(struct_pack(cost := f.cost + p.top * (p.c - q.c) - (p.w - q.w), i := q.j)) AS best
            FROM points p JOIN points q ON q.j < p.j OR p.j = 0 AND q.j = 0 JOIN f{k - 1} f ON f.j = q.j GROUP BY p.j) JOIN (SELECT j AS i, cuts FROM f{k - 1}) before ON before.i = best.i)""")
    return f"""
        WITH lengths AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS length FROM documents),
        counts AS (SELECT length, count(*) AS n FROM lengths GROUP BY length),
        points AS (SELECT row_number() OVER (ORDER BY length) AS j, length AS top, CAST(sum(n) OVER (ORDER BY length) AS BIGINT) AS c, CAST(sum(n * length) OVER (ORDER BY length) AS BIGINT) AS w FROM counts
            UNION ALL SELECT 0, 0, 0, 0),
        {','.join(levels)},
        cuts AS (SELECT unnest(list_append(cuts, j)) AS j FROM f{BUCKETS} WHERE j = (SELECT max(j) FROM points)),
        edges AS (SELECT top AS pad_to, CAST(row_number() OVER (ORDER BY top) - 1 AS INTEGER) AS bucket FROM (SELECT DISTINCT top FROM cuts JOIN points USING (j) WHERE j > 0)),
        placed AS (SELECT doc_id, length, pad_to, bucket FROM lengths ASOF JOIN edges ON length <= pad_to),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, length) - 1 AS place FROM placed)
        SELECT doc_id, length, bucket, pad_to, pad_to - length AS padding, place // greatest({BUDGET} // greatest(pad_to, 1), 1) AS batch FROM ordered"""


ORACLE_SQL = {
    "op1_exact_dedup": f"""
        WITH norm AS (SELECT doc_id, {_NORM} AS norm FROM documents),
        ranked AS (SELECT *, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) AS rank FROM norm)
        SELECT doc_id, keep_id, group_size, rank = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked""",
    "op2_sharding": _op2_sql(),
    "op4_packing": _op4_sql(),
    "op7_url_filter": r"""
        WITH parts AS (SELECT page_id,
            translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        rules(verdict, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        fits AS (SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
            row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC, length(r.rule_host) DESC) AS rank
            FROM parts p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE rank = 1""",
    "op12_prefix_trie": f"""
        WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT c, c - c % 5 AS first, {_CRC32} % 9 AS h FROM (SELECT DISTINCT c FROM own)),
        rebuilt AS (SELECT c, CAST(row_number() OVER (PARTITION BY c ORDER BY part, i) AS BIGINT) AS d, role, text FROM (
            SELECT convs.c, 0 AS part, i, role, text FROM convs JOIN own ON own.c = convs.first WHERE i <= h UNION ALL
            SELECT convs.c, 1, i, role, text FROM convs JOIN own ON own.c = convs.c WHERE i > h)),
        members AS (SELECT c, d, list({{'role': role, 'text': text}}) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path, strlen(text) AS n_bytes FROM rebuilt UNION ALL
            SELECT c, 0, CAST([] AS STRUCT("role" VARCHAR, "text" VARCHAR)[]), 0 FROM convs),
        lengths AS (SELECT c, max(d) AS length FROM members GROUP BY c),
        nodes AS (SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_bytes) AS saved,
            sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = length), '')) AS ends_sha256 FROM members JOIN lengths USING (c) GROUP BY path, d),
        linked AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON n.depth = p.depth + 1 AND n.path[1:p.depth] = p.path),
        children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
        full_nodes AS (SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN children USING (conv_id, depth))
        SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens, a.ends_sha256
        FROM full_nodes a JOIN full_nodes b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256""",
    "op13_lexical_search": rf"""
        WITH found AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_NORM}, '{_TERM}') AS terms FROM documents),
        totals AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM found),
        counted AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM found) GROUP BY ALL),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_NORM}, '{_TERM}')) AS term FROM benchmark),
        weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, totals GROUP BY term, n_docs),
        scored AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM asked JOIN weights USING (term) JOIN counted USING (term), totals GROUP BY item_id, row, doc_id),
        placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
        SELECT * FROM placed WHERE rank <= 10""",
}
