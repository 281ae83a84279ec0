"""The queries of the corpus operators, with the parameters they are run with, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bestfit, extract, langid, minhash, mixing, packing, passages, quality, scoring, search, spelling, tokens, vectors
from graphloom.llm.common import read


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(documents, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), k=2)


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), cut=True).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    scored = scoring.score(documents, langid.fold("doc_id", 7) != 2, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select("doc_id", (langid.fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = langid.train(documents.where(langid.fold("doc_id", 4) != 2))
    found = langid.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (langid.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.col("rejected"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return packing.pack(documents, public_tokenizers.path("byte_bpe_50k.json"), ids=False)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(read(spark, sf_dir, "documents"), slip=199))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_extract, op3_quality, op4_token_counts, op5_near_vectors, op6_passages, op7_mixing, op8_lattice_score, op9_language, op10_packing, op11_spelling, op12_search, op13_best_fit)}

WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def _near_sql(k: int, percent: int) -> str:
    """Links by counting common shingles of all pairs, components by recursion."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {k - 1}) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a), g AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, least(w.doc_id, coalesce(m, w.doc_id)) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)"""


def _vectors_sql(threshold: float) -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= {threshold}),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a), g AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept FROM v LEFT JOIN n USING (vec_id) LEFT JOIN g USING (vec_id)"""


def _quality_sql(rules: quality.Rules) -> str:
    """Every word in a row of its own; an n-gram's words are covered if its text occurs twice."""
    steps, limits = [], []
    for n in sorted({*rules.coverage, quality.WINDOW}):
        steps.append(f"""g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS x FROM words WHERE i + {n - 1} <= len(w))),
c{n} AS (SELECT doc_id, count(*) AS k, sum(length(w[j])) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS j FROM g{n} WHERE c > 1) JOIN d USING (doc_id) GROUP BY doc_id)""")
    for n, most in rules.coverage.items():
        limits.append(f"coalesce(c{n}.chars, 0) / greatest(1, word_chars)::DOUBLE > {most}")
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = m.doc_id" for n in sorted({*rules.coverage, quality.WINDOW}))
    words_of = WORDS.format("coalesce(text, '')")
    return f"""WITH d AS (SELECT doc_id, {words_of} AS w, coalesce(text, '') AS t FROM documents), words AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), {', '.join(steps)},
l AS (SELECT doc_id, x, length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars, count(*) OVER (PARTITION BY doc_id, x) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup, sum(CASE WHEN c > 1 THEN chars ELSE 0 END) / greatest(1, sum(chars))::DOUBLE AS share FROM l GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(share, 0) AS share FROM d LEFT JOIN lines USING (doc_id)),
r AS (SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(c{quality.WINDOW}.k, 0) AS n_repeat_words, share > {rules.lines} OR n_symbols > {rules.symbols}::DOUBLE * n_words OR {' OR '.join(limits)} AS bad FROM m {joins}),
f AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM f"""


def _mixing_sql(weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> str:
    words_of = WORDS.format("coalesce(text, '')")
    return f"""WITH d AS (SELECT doc_id, source, len({words_of})::BIGINT AS size, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS symbols FROM documents),
k AS (SELECT doc_id, source, size, -ln((('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)}::DOUBLE) / greatest(0.25::DOUBLE, coalesce(size::DOUBLE / nullif(size + symbols, 0), 1)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, list_extract({list(map(float, weights))}::DOUBLE[], ((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % {len(weights)} + 1)::INT) AS weight FROM k GROUP BY source),
c AS (SELECT *, {most}::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, ({share}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE cap > weight * level), 'inf'::DOUBLE)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (SELECT doc_id, k.source, size, source_size, target, epochs, target - epochs * source_size - coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, round(room))))::BIGINT AS taken, source FROM p"""


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _search_sql(k: int = 10) -> str:
    """Every document's score for every item."""
    terms_of = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, {terms_of.format(_lower("text"))} AS x FROM documents), d AS (SELECT r, doc_id, x, len(x)::BIGINT AS n FROM t WHERE len(x) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d), q AS (SELECT DISTINCT item_id, unnest({terms_of.format(_lower("text"))}) AS term FROM benchmark),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(x) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {k}"""


def _crc_table() -> list[int]:
    table = list(range(256))
    for _ in range(8):
        table = [x >> 1 ^ 0xEDB88320 * (x & 1) for x in table]
    return table


def _spelling_sql(slip: int = 199, least_length: int = 6, least_count: int = 5, ratio: int = 5) -> str:
    """CRC-32 byte by byte over the code points' bytes; near words by equal words without, or with a hole for, one letter."""
    byte = "CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END"
    return f"""WITH RECURSIVE crc AS MATERIALIZED (SELECT {_crc_table()}::BIGINT[] AS t), runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all({_lower("text")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= {least_length} GROUP BY ALL),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: {byte}))::BIGINT[]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM runs, crc),
v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % {slip} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed) WHERE length(word) >= {least_length} GROUP BY word HAVING sum(c) >= {least_count}),
cut AS (SELECT word, left(word, i) || substr(word, i + 2) AS gone, left(word, i) || '_' || substr(word, i + 2) AS hole FROM (SELECT word, unnest(range(length(word)))::INT AS i FROM v)),
pairs AS (SELECT cut.word AS a, v.word AS b FROM cut JOIN v ON gone = v.word UNION SELECT v.word, cut.word FROM cut JOIN v ON gone = v.word UNION SELECT x.word, y.word FROM cut x JOIN cut y ON x.hole = y.hole AND x.word <> y.word),
near AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-v.n, b)) AS best, max(v.n) AS best_n FROM pairs JOIN v ON b = v.word GROUP BY a),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {ratio} * v.n THEN best END AS form, CASE WHEN best_n >= {ratio} * v.n THEN best_n END AS form_n FROM v LEFT JOIN near USING (word)),
walk AS (SELECT word, form AS root, 1 AS steps FROM f WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN f ON walk.root = f.word WHERE f.form IS NOT NULL), ends AS (SELECT word, arg_max(root, steps) AS root FROM walk GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN ends USING (word)"""


#: Only what SQL expresses at a bearable cost; the rest is tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op1_near_duplicates": _near_sql(2, 80), "op3_quality": _quality_sql(quality.Rules()), "op5_near_vectors": _vectors_sql(0.95), "op7_mixing": _mixing_sql(), "op11_spelling": _spelling_sql(), "op12_search": _search_sql()}
