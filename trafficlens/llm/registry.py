"""The registered queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann_graph, bestfit, bpe, collocation, cotrain, fingerprint, maxent_lm, near_dup, packing, sharding, spelling, toxicity, url_filter
from .common import table

TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_graph.nearest(table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_documents(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The rules that op10 judges by.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op13_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_whole(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER))


def queries() -> dict:
    own = (op1_toxicity, op2_ann, op3_bpe, op4_minhash_dedup, op5_lm_scoring, op6_fingerprints, op7_sharding, op8_packing, op9_quality, op10_url_filter)
    return {f.__name__: f for f in (*own, op11_spelling, op12_collocations, op13_bestfit)}


def _url_sql() -> str:
    """The rules of op10, longest first, over the given pages, none of which is an alias of another."""
    ordered = sorted(URL_RULES, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))
    fits = lambda t: f"(host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}')"
    rule = " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in ordered)
    verdict = " ".join(f"WHEN '{t}' THEN '{v}'" for v, t in ordered)
    lower = "translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS host0, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT page_id, {lower} AS host, path FROM u), w AS (SELECT *, CASE {rule} END AS rule FROM h)
SELECT page_id, host, path, rule, CASE rule {verdict} ELSE 'allow' END AS verdict, FALSE AS propagated FROM w"""


def _crc_sql(text: str) -> str:
    """crc32 of the UTF-8 bytes of a text, with column t of crcs: the remainders of all bytes, built from the polynomial."""
    pairs = f"list_transform(range(1, CAST(length(hex(encode({text}))) / 2 AS BIGINT) + 1), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i - 1 AS INTEGER), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {pairs}), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295)"


def _fold_sql(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _spelling_sql() -> str:
    """Words by runs, near ones by the words that are left when a character goes, forms by the most frequent near word, roots by recursion."""
    step = "list_reduce([c, 1, 1, 1, 1, 1, 1, 1, 1], lambda x, one: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"""WITH RECURSIVE crcs AS (SELECT list({step} ORDER BY c) AS t FROM (SELECT unnest(range(0, 256)) AS c)),
runs AS (SELECT doc_id, unnest(regexp_extract_all({_fold_sql('text')}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {_crc_sql("concat(CAST(doc_id AS VARCHAR), ':', run)")} AS h FROM per, crcs),
edited AS (SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS INTEGER)), substr(run, CAST(h % length(run) AS INTEGER) + 2)) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
 UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.less UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.less),
best AS (SELECT word, other, n AS best_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place FROM pairs),
judged AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN other END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word AND place = 1),
way AS (SELECT word, word AS root FROM judged UNION ALL SELECT way.word, form FROM way JOIN judged j ON j.word = way.root WHERE form IS NOT NULL),
ends AS (SELECT way.word, root FROM way JOIN judged j ON j.word = way.root WHERE j.form IS NULL)
SELECT j.word, form, root, n, n_near, form_n FROM judged j JOIN ends ON ends.word = j.word"""


def _collocation_sql() -> str:
    """Phrases of 1 to 4 words listed within pieces and counted; candidates, cuts and longer phrases by joins on lists of words."""
    return f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_fold_sql("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS p FROM split),
f AS MATERIALIZED (SELECT lang, p, count(*) AS a FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE len(p) = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE len(p) > 1 AND a >= 30),
inner_ AS (SELECT lang, unnest(flatten(list_transform(range(2, len(p)), lambda k: list_transform(range(1, len(p) - k + 2), lambda i: p[i:i + k - 1])))) AS p, a FROM c WHERE len(p) > 2),
most AS (SELECT lang, p, max(a) AS longer FROM inner_ GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN most m ON m.lang = c.lang AND m.p = c.p WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(c.a AS HUGEINT)),
cuts AS (SELECT lang, p, a, k, p[1:k] AS x, p[k + 1:] AS y FROM (SELECT *, unnest(range(1, len(p))) AS k FROM kept)),
scored AS (SELECT s.lang, s.p, s.a, k, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * s.a) // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score FROM cuts s JOIN f x ON x.lang = s.lang AND x.p = s.x JOIN f y ON y.lang = s.lang AND y.p = s.y),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS place FROM scored),
ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM worst WHERE place = 1),
out AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM out o JOIN total t ON t.lang = o.lang WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op10_url_filter": _url_sql(), "op11_spelling": _spelling_sql(), "op12_collocations": _collocation_sql()}
