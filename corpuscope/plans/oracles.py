"""The registered queries as DuckDB SQL, written on their own: common table expressions, put together by name."""

from __future__ import annotations

from corpuscope.functions.text import CAPITALS, VOWELS
from corpuscope.operators.features import FEATURES
from corpuscope.operators.schedule import GAINS, OPERATORS

ORACLES: dict[str, str] = {}

BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def corpora_sql(by: str = "lang", where: str = "true", source: str = "documents") -> str:
    """corpora (corpus, doc_id, seqs), sq (a row a sequence), tk (a row a token), ty (types)."""
    return rf"""
parts AS (SELECT {by} AS corpus, doc_id, regexp_split_to_array(regexp_replace(nfc_normalize(coalesce(text, '')), '([.!?]){BLANK}+([{CAPITALS}])', '\1' || chr(10) || '\2', 'g'), '[\n\r]+') AS s FROM {source} WHERE {where}),
corpora AS (SELECT corpus, doc_id, list_filter(list_transform(s, lambda x: list_transform(list_filter(regexp_extract_all(x, '[\p{{L}}\p{{Nl}}\p{{No}}]+'), lambda w: length(w) >= 2), lambda w: lower(w))), lambda t: len(t) > 0) AS seqs FROM parts),
sq AS (SELECT corpus, doc_id, i - 1 AS seq, seqs[i] AS tokens FROM (SELECT *, unnest(range(1, len(seqs) + 1)) AS i FROM corpora)),
tk AS (SELECT corpus, doc_id, seq, j - 1 AS pos, len(tokens) AS n, tokens[j] AS token FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS j FROM sq)),
ty AS (SELECT corpus, token, count(*) AS cnt FROM tk GROUP BY ALL)"""


BASE = corpora_sql()
MOMENTS = """
len AS (SELECT corpus, CAST(len(tokens) AS DOUBLE) AS l FROM sq),
mean AS (SELECT corpus, avg(l) AS m, var_pop(l) AS v, count(*) AS k, CAST(sum(l) AS BIGINT) AS t FROM len GROUP BY corpus),
mo AS (SELECT corpus, max(k) AS sequence_count, max(t) AS total_tokens, max(m) AS mean_seq_length, max(v) AS variance,
  CASE WHEN max(v) > 0 THEN avg(power(l - m, 3)) / power(max(v), 1.5) ELSE 0.0 END AS skewness, CASE WHEN max(v) > 0 THEN avg(power(l - m, 4)) / power(max(v), 2) - 3 ELSE 0.0 END AS excess_kurtosis
  FROM len JOIN mean USING (corpus) GROUP BY corpus)"""


def grams(n: int, name: str = "") -> str:
    name = name or f"g{n}"
    return f"""
{name}c AS (SELECT corpus, array_to_string(tokens[i:i + {n - 1}], ' | ') AS gram, count(*) AS cnt FROM (SELECT corpus, tokens, unnest(range(1, len(tokens) - {n - 2})) AS i FROM sq WHERE len(tokens) >= {n}) GROUP BY ALL),
{name}r AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY cnt DESC, gram) AS rnk FROM {name}c),
{name} AS (SELECT corpus, gram, cnt, rnk, cnt / sum(cnt) OVER (PARTITION BY corpus) AS p FROM {name}r WHERE rnk <= 5000)"""


def chars(kind: str, top: int, rows: str = "ty", by: str = "corpus") -> str:
    if kind == "s3":
        each = f"SELECT {by}, right(token, 3) AS gram, cnt FROM {rows} WHERE length(token) >= 3"
    else:
        n = int(kind[1])
        each = f"SELECT {by}, substr('^' || token || '$', i, {n}) AS gram, cnt FROM (SELECT *, unnest(range(1, length(token) + {4 - n})) AS i FROM {rows})"
    return f"""
{kind}c AS (SELECT {by}, gram, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({each}) GROUP BY ALL),
{kind}r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY cnt DESC, gram) AS rnk FROM {kind}c),
{kind} AS (SELECT {by}, gram, cnt, rnk, cnt / sum(cnt) OVER (PARTITION BY {by}) AS p FROM {kind}r WHERE rnk <= {top})"""


CHARS = ",".join(chars(k, t) for k, t in (("c2", 1500), ("c3", 2500), ("s3", 800)))
PROFILES = f"{CHARS},\nprof AS (SELECT corpus, 'c2' AS kind, gram, p FROM c2 UNION ALL SELECT corpus, 'c3', gram, p FROM c3 UNION ALL SELECT corpus, 's3', gram, p FROM s3)"
VOCAB = "vo AS (SELECT * FROM (SELECT corpus, token, cnt, row_number() OVER (PARTITION BY corpus ORDER BY cnt DESC, token) AS rnk FROM ty) WHERE rnk <= {top})"
ZIPF = "zi AS (SELECT corpus, CASE WHEN max(rnk) >= 15 THEN coalesce(regr_slope(ln(cnt), ln(rnk)) FILTER (WHERE rnk >= 10), 0.0) ELSE 0.0 END AS zipf_slope FROM (SELECT corpus, cnt, row_number() OVER (PARTITION BY corpus ORDER BY cnt DESC, token) AS rnk FROM ty) WHERE rnk <= 1000 GROUP BY corpus)"
HEAPS = """
gp AS (SELECT corpus, token, row_number() OVER (PARTITION BY corpus ORDER BY doc_id, seq, pos) AS g FROM tk),
fp AS (SELECT corpus, token, min(g) AS f FROM gp GROUP BY ALL),
tot AS (SELECT corpus, count(*) AS t, greatest(50, count(*) // 24) AS lo FROM gp GROUP BY corpus),
pts AS (SELECT DISTINCT corpus, t, CASE WHEN i = 11 THEN t ELSE CAST(floor(lo + i * ((t - lo) / 11.0)) AS BIGINT) END AS n FROM tot, range(12) r(i)),
vs AS (SELECT corpus, t, n, (SELECT count(*) FROM fp WHERE fp.corpus = pts.corpus AND f <= n) AS v FROM pts),
he AS (SELECT corpus, CASE WHEN count(*) FILTER (WHERE n > 1 AND v > 1 AND t >= 100) >= 3 THEN regr_slope(ln(v), ln(n)) FILTER (WHERE n > 1 AND v > 1 AND t >= 100) ELSE 0.0 END AS heaps_beta FROM vs GROUP BY corpus)"""
TYPE_STATS = f"""
ts AS (SELECT corpus, count(*) AS unique_types, count(*) FILTER (WHERE cnt = 1) AS hapax, count(*) FILTER (WHERE cnt = 2) AS dis, CAST(sum(cnt) AS BIGINT) AS tokens,
  sum(length(token) * cnt) / sum(cnt) AS word_length_mean, sum(length(token) * length(token) * cnt) / sum(cnt) - power(sum(length(token) * cnt) / sum(cnt), 2) AS word_length_variance,
  CAST(sum((length(let) - length(con)) * cnt) AS BIGINT) AS vowels, CAST(sum(length(con) * cnt) AS BIGINT) AS consonants
  FROM (SELECT *, regexp_replace(token, '[^\\p{{L}}]', '', 'g') AS let, regexp_replace(regexp_replace(token, '[^\\p{{L}}]', '', 'g'), '[{VOWELS}]', '', 'g') AS con FROM ty) GROUP BY corpus)"""
COND = """
cp AS (SELECT corpus, substr(token, i, 1) AS a, substr(token, i + 1, 1) AS b, sum(cnt) AS c FROM (SELECT *, unnest(range(1, length(token))) AS i FROM ty) GROUP BY ALL),
ce AS (SELECT corpus, -sum(c / t * ln(c / s)) AS conditional_char_entropy FROM (SELECT *, sum(c) OVER (PARTITION BY corpus, a) AS s, sum(c) OVER (PARTITION BY corpus) AS t FROM cp) GROUP BY corpus)"""
EDGE = """
ed AS (SELECT corpus, side, ch, sum(cnt) AS c FROM (SELECT corpus, -1 AS side, left(token, 1) AS ch, cnt FROM ty UNION ALL SELECT corpus, 1, right(token, 1), cnt FROM ty) GROUP BY ALL),
ea AS (SELECT corpus, sum(-side * p * ln(p)) AS edge_asymmetry FROM (SELECT *, c / sum(c) OVER (PARTITION BY corpus, side) AS p FROM ed) GROUP BY corpus)"""
UNI = "un AS (SELECT corpus, sum(cnt) FILTER (WHERE rnk <= 1000) / sum(cnt) AS unigram_coverage FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY cnt DESC, token) AS rnk FROM ty) GROUP BY corpus)"


def put(name: str, ctes: list[str], select: str) -> None:
    ORACLES[name] = f"WITH {', '.join(c.strip() for c in ctes)} {select}" if ctes else select


put("sentence_split", [rf"parts AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?]){BLANK}+([{CAPITALS}])', '\1' || chr(10) || '\2', 'g'), '[\n\r]+'), lambda x: regexp_replace(x, '^{BLANK}+|{BLANK}+$', '', 'g')), lambda x: x <> '') AS s FROM documents)"], "SELECT doc_id, i - 1 AS sent, s[i] AS sentence FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM parts)")
put("tokenize", [BASE], "SELECT corpus, doc_id, seq, array_to_string(tokens, ' ') AS tokens FROM sq")
put("klingon_tokens", [], "SELECT lang, count(*) AS n, count(DISTINCT token) AS types, CAST(sum(length(token)) AS BIGINT) AS chars FROM (SELECT lang, unnest(regexp_extract_all(translate(text, '’‘ʼ', ''''''''), '[A-Za-z'']*[A-Za-z][A-Za-z'']*')) AS token FROM documents) GROUP BY lang")
put("corpus_stats", [BASE, MOMENTS], "SELECT corpus, sequence_count, total_tokens, unique_types, round(unique_types / total_tokens, 6) AS type_token_ratio, round(mean_seq_length, 6) AS mean_seq_length FROM mo JOIN (SELECT corpus, count(*) AS unique_types FROM ty GROUP BY corpus) USING (corpus)")
put("vocab_topn", [BASE, VOCAB.format(top=5000)], "SELECT corpus, token, cnt, rnk FROM vo")
for n, name in ((2, "bigram_profile"), (3, "trigram_profile")):
    put(name, [BASE, grams(n)], f"SELECT corpus, gram, cnt, rnk, round(p, 6) AS p FROM g{n}")
put("topk_coverage", [BASE, grams(2), grams(3)], " UNION ALL ".join(f"SELECT corpus, round(sum(p) FILTER (WHERE rnk <= {k}), 6) AS coverage, CAST({n} AS BIGINT) AS n, CAST({k} AS BIGINT) AS k FROM g{n} GROUP BY corpus" for n in (2, 3) for k in (100, 500)))
put("profile_entropy", [BASE, grams(2), grams(3)], "SELECT corpus, round(h2, 6) AS h2, round(h3, 6) AS h3 FROM (SELECT corpus, -sum(p * ln(p)) AS h2 FROM g2 GROUP BY corpus) JOIN (SELECT corpus, -sum(p * ln(p)) AS h3 FROM g3 GROUP BY corpus) USING (corpus)")
put("profile_validity", [BASE, PROFILES], "SELECT corpus, kind, round(sum(p), 6) AS total, count(*) AS grams, sum(p) BETWEEN 0.999 AND 1.001 AS valid FROM prof GROUP BY corpus, kind")
put("structural_vector", [BASE, MOMENTS, grams(2), grams(3)], "SELECT corpus, round(u / total_tokens, 6) AS ttr, round(b, 6) AS bigram_coverage, round(t, 6) AS trigram_coverage, round(ln(1 + mean_seq_length), 6) AS log_mean_seq_len FROM mo JOIN (SELECT corpus, count(*) AS u FROM ty GROUP BY corpus) USING (corpus) JOIN (SELECT corpus, sum(p) FILTER (WHERE rnk <= 100) AS b FROM g2 GROUP BY corpus) USING (corpus) JOIN (SELECT corpus, sum(p) FILTER (WHERE rnk <= 100) AS t FROM g3 GROUP BY corpus) USING (corpus)")
put("seq_len_moments", [BASE, MOMENTS], "SELECT corpus, sequence_count, total_tokens, round(mean_seq_length, 6) AS mean_seq_length, round(variance, 6) AS variance, round(skewness, 6) AS skewness, round(excess_kurtosis, 6) AS excess_kurtosis FROM mo")
put("word_length_stats", [BASE, TYPE_STATS], "SELECT corpus, round(word_length_mean, 6) AS word_length_mean, round(word_length_variance, 6) AS word_length_variance FROM ts")
put("hapax_dis", [BASE, TYPE_STATS], "SELECT corpus, unique_types, hapax, dis, round(hapax / unique_types, 6) AS hapax_ratio, round(dis / greatest(hapax, 1), 6) AS dis_ratio FROM ts")
put("unigram_coverage", [BASE, UNI], "SELECT corpus, round(unigram_coverage, 6) AS unigram_coverage FROM un")
put("zipf_slope", [BASE, ZIPF], "SELECT corpus, round(zipf_slope, 6) AS zipf_slope FROM zi")
put("heaps_beta", [BASE, HEAPS], "SELECT corpus, round(heaps_beta, 6) AS heaps_beta FROM he")
for kind, top, name in (("s3", 800, "suffix_profile"), ("c2", 1500, "char_bigram_profile"), ("c3", 2500, "char_trigram_profile")):
    put(name, [BASE, chars(kind, top)], f"SELECT corpus, gram, cnt, rnk, round(p, 6) AS p FROM {kind}")
put("cond_char_entropy", [BASE, COND], "SELECT corpus, round(conditional_char_entropy, 6) AS conditional_char_entropy FROM ce")
put("word_edge_asymmetry", [BASE, EDGE], "SELECT corpus, round(edge_asymmetry, 6) AS edge_asymmetry FROM ea")
put("cv_ratio", [BASE, TYPE_STATS], "SELECT corpus, vowels, consonants, round(consonants / greatest(vowels, 1), 6) AS ratio FROM ts")


def features_sql(base: str) -> tuple[list[str], str]:
    share = lambda g, k: f"(SELECT corpus, sum(p) FILTER (WHERE rnk <= 100) AS {g}_100, sum(p) FILTER (WHERE rnk <= 500) AS {g}_500, -sum(p * ln(p)) AS {g}_h FROM {g} GROUP BY corpus)"
    values = "unique_types / total_tokens|g2_100|g3_100|ln(1 + mean_seq_length)|g2_500|g3_500|unigram_coverage|variance|word_length_mean|word_length_variance|hapax / unique_types|zipf_slope|g2_h|g3_h|s3_h|heaps_beta|conditional_char_entropy|dis / greatest(hapax, 1)|edge_asymmetry|consonants / greatest(vowels, 1)|skewness|excess_kurtosis".split("|")
    ctes = [base, MOMENTS, TYPE_STATS, grams(2), grams(3), chars("s3", 800), UNI, ZIPF, HEAPS, COND, EDGE]
    select = "SELECT corpus, " + ", ".join(f"round(CAST(coalesce({v}, 0.0) AS DOUBLE), 6) AS {n}" for n, v in zip(FEATURES, values)) + f" FROM mo JOIN ts USING (corpus) LEFT JOIN {share('g2', 0)} USING (corpus) LEFT JOIN {share('g3', 0)} USING (corpus) LEFT JOIN (SELECT corpus, -sum(p * ln(p)) AS s3_h FROM s3 GROUP BY corpus) USING (corpus) LEFT JOIN un USING (corpus) LEFT JOIN zi USING (corpus) LEFT JOIN he USING (corpus) LEFT JOIN ce USING (corpus) LEFT JOIN ea USING (corpus)"
    return ctes, select


put("feature_vector", *features_sql(BASE))
put("diversity_bits", [BASE], "SELECT corpus, round(-sum(p * log2(p)), 6) AS entropy_bits, count(*) AS vocabulary, round(max(p), 6) AS top_share FROM (SELECT corpus, cnt / sum(cnt) OVER (PARTITION BY corpus) AS p FROM ty) GROUP BY corpus")


def cooc(top: int) -> list[str]:
    return [VOCAB.format(top=top), """
co AS (SELECT a.corpus, a.token AS row_tok, b.token AS col_tok, count(*) AS cnt FROM tk a JOIN tk b ON a.corpus = b.corpus AND a.doc_id = b.doc_id AND a.seq = b.seq AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND a.pos <> b.pos
  WHERE (a.corpus, a.token) IN (SELECT (corpus, token) FROM vo) AND (b.corpus, b.token) IN (SELECT (corpus, token) FROM vo) GROUP BY ALL)""", """
pm AS (SELECT corpus, row_tok, col_tok, cnt, greatest(0.0, log2(CAST(cnt AS DOUBLE) * t / (CAST(r AS DOUBLE) * s))) AS w FROM (SELECT *, sum(cnt) OVER (PARTITION BY corpus, row_tok) AS r, sum(cnt) OVER (PARTITION BY corpus, col_tok) AS s, sum(cnt) OVER (PARTITION BY corpus) AS t FROM co))""", """
l2 AS (SELECT corpus, row_tok, col_tok, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY corpus, row_tok)), 0) AS w FROM pm WHERE row_tok <> col_tok)"""]  # fmt: skip


put("cooccurrence_counts", [BASE, *cooc(5000)[:2]], "SELECT corpus, row_tok, col_tok, cnt FROM co")
put("ppmi", [BASE, *cooc(5000)[:3]], "SELECT corpus, row_tok, col_tok, cnt, round(w, 6) AS w FROM pm")
put("cooccurrence_l2", [BASE, *cooc(5000)], "SELECT corpus, row_tok, col_tok, round(w, 6) AS w FROM l2 WHERE w > 0")
put("cooccurrence_asymmetry", [BASE, *cooc(5000)[:2]], "SELECT count(*) AS asymmetric FROM co a FULL JOIN co b ON a.corpus = b.corpus AND a.row_tok = b.col_tok AND a.col_tok = b.row_tok WHERE a.cnt IS DISTINCT FROM b.cnt")
put("positional_features", [BASE, VOCAB.format(top=5000), """
ps AS (SELECT corpus, token, count(*) AS cnt, avg(CASE WHEN pos = 0 THEN 1.0 ELSE 0.0 END) AS i, avg(CASE WHEN pos = n - 1 AND n > 1 THEN 1.0 ELSE 0.0 END) AS f, avg(CASE WHEN pos > 0 AND pos < n - 1 THEN 1.0 ELSE 0.0 END) AS m, avg(CASE WHEN n > 1 THEN pos / (n - 1) ELSE 0.0 END) AS x, stddev_pop(CASE WHEN n > 1 THEN pos / (n - 1) ELSE 0.0 END) AS s FROM tk GROUP BY ALL)"""],
    "SELECT corpus, token, cnt, round(i + 1e-10, 6) AS initial_rate, round(f + 1e-10, 6) AS final_rate, round(m + 1e-10, 6) AS medial_rate, round(x + 1e-10, 6) AS mean_norm_pos, round(s + 1e-10, 6) AS std_norm_pos, round(ln(1 + cnt) / ln(1 + max(cnt) OVER (PARTITION BY corpus)) + 1e-10, 6) AS freq_norm, cnt < 5 AS low_frequency FROM ps WHERE (corpus, token) IN (SELECT (corpus, token) FROM vo)")

COS = """
nr AS (SELECT corpus, kind, sqrt(sum(p * p)) AS norm FROM prof GROUP BY ALL),
dt AS (SELECT a.corpus AS corpus_a, b.corpus AS corpus_b, a.kind, sum(a.p * b.p) AS dot FROM prof a JOIN prof b ON a.kind = b.kind AND a.gram = b.gram AND a.corpus < b.corpus GROUP BY ALL),
cs AS (SELECT corpus_a, corpus_b, dt.kind AS kind, dot / (x.norm * y.norm) AS c FROM dt JOIN nr x ON x.corpus = corpus_a AND x.kind = dt.kind JOIN nr y ON y.corpus = corpus_b AND y.kind = dt.kind)"""
put("form_cosine", [BASE, PROFILES, COS], "SELECT corpus_a, corpus_b, round(c2, 6) AS c2, round(c3, 6) AS c3, round(s3, 6) AS s3, round(0.4 * c2 + 0.4 * c3 + 0.2 * s3, 6) AS form FROM (SELECT corpus_a, corpus_b, " + ", ".join(f"coalesce(max(c) FILTER (WHERE kind = '{k}'), 0.0) AS {k}" for k in ("c2", "c3", "s3")) + " FROM cs GROUP BY ALL)")
SCORES = """
rf AS (SELECT kind, gram, p FROM prof WHERE corpus = 'en'),
rn AS (SELECT kind, sqrt(sum(p * p)) AS norm FROM rf GROUP BY kind),
tg AS (SELECT token, kind, gram, CAST(count(*) AS DOUBLE) AS n FROM (SELECT token, 'c2' AS kind, substr('^' || token || '$', i, 2) AS gram FROM (SELECT token, unnest(range(1, length(token) + 2)) AS i FROM want) UNION ALL SELECT token, 'c3', substr('^' || token || '$', i, 3) FROM (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM want) UNION ALL SELECT token, 's3', right(token, 3) FROM want WHERE length(token) >= 3) GROUP BY ALL),
tc AS (SELECT token, kind, sum(n * coalesce(p, 0)) / (sqrt(sum(n * n)) * max(norm)) AS c FROM tg LEFT JOIN rf USING (kind, gram) JOIN rn USING (kind) GROUP BY ALL),
sc AS (SELECT token, sum(CASE kind WHEN 's3' THEN 0.2 ELSE 0.4 END * c) AS score FROM tc GROUP BY token)"""
put("token_score", [BASE, PROFILES, "want AS (SELECT DISTINCT token FROM ty WHERE corpus <> 'en')", SCORES], "SELECT token, round(score, 6) AS score FROM sc")
put("transparency", [BASE, PROFILES, VOCAB.format(top=50), "want AS (SELECT DISTINCT token FROM vo)", SCORES], "SELECT corpus, round(least(greatest(sum(cnt * score) / sum(cnt), 0.0), 1.0), 6) AS score, round(avg(score), 6) AS mean_token_score, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS high_score_share, count(*) AS top_n FROM vo JOIN sc USING (token) GROUP BY corpus")

_ctes, _select = features_sql(corpora_sql("source"))
LONG = [*_ctes, f"fe AS ({_select})", "lo AS (" + " UNION ALL ".join(f"SELECT corpus, '{f}' AS feature, {f} AS value FROM fe" for f in FEATURES) + ")"]
Z = "z AS (SELECT corpus, feature, value, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 1.0 END AS z FROM lo WINDOW w AS (PARTITION BY feature))"
put("zscore_matrix", [*LONG, Z], "SELECT corpus, feature, value, round(z, 6) AS z FROM z")
put("pairwise_distance", [*LONG, Z], "SELECT a.corpus AS corpus_a, b.corpus AS corpus_b, round(sqrt(sum(power(a.z - b.z, 2))), 4) AS distance, round(sum(a.z * b.z) / (sqrt(sum(a.z * a.z)) * sqrt(sum(b.z * b.z))), 4) AS cosine FROM z a JOIN z b ON a.feature = b.feature AND a.corpus < b.corpus GROUP BY ALL")
put("feature_contributions", [*LONG, Z], "SELECT a.corpus AS corpus_a, b.corpus AS corpus_b, a.feature, round(a.z * b.z / (sqrt(sum(a.z * a.z) OVER w) * sqrt(sum(b.z * b.z) OVER w)), 4) AS contribution FROM z a JOIN z b ON a.feature = b.feature AND a.corpus < b.corpus WINDOW w AS (PARTITION BY a.corpus, b.corpus)")
RHO = """
rk AS (SELECT corpus, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM lo),
rh AS (SELECT a.feature AS feature_a, b.feature AS feature_b, coalesce(covar_pop(a.r, b.r) / nullif(stddev_pop(a.r) * stddev_pop(b.r), 0), 0.0) AS rho FROM rk a JOIN rk b USING (corpus) GROUP BY ALL)"""
put("spearman", [*LONG, RHO], "SELECT feature_a, feature_b, round(rho, 6) AS rho FROM rh")
NULL_TOKENS = "nulls AS (SELECT 'null' AS corpus, d AS doc_id, list_transform(range(10), lambda i: 't' || CAST(CAST('0x' || substr(sha256('0:' || CAST(d AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) % 500 AS VARCHAR)) AS tokens FROM range(10000) r(d))"
put("null_corpus", [NULL_TOKENS], "SELECT corpus, count(*) AS sequence_count, CAST(sum(len(tokens)) AS BIGINT) AS total_tokens, (SELECT count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM nulls)) AS unique_types FROM nulls GROUP BY corpus")

SIMPLE = "SELECT corpus, u / t AS ttr, m AS mean_len, wl AS word_len FROM (SELECT corpus, avg(CAST(len(tokens) AS DOUBLE)) AS m, sum(len(tokens)) AS t FROM {p}sq GROUP BY corpus) JOIN (SELECT corpus, count(*) AS u, sum(length(token) * cnt) / sum(cnt) AS wl FROM {p}ty GROUP BY corpus) USING (corpus)"


def prefixed(sql: str, prefix: str) -> str:
    import re

    return re.sub(r"\b(parts|corpora|sq|tk|ty)\b", lambda m: prefix + m[1], sql)


BANK = [BASE, prefixed(corpora_sql("'block_' || lpad(CAST(doc_id % 12 AS VARCHAR), 4, '0')", "lang = 'en'"), "b"), f"rv AS ({SIMPLE.format(p='')})", f"bv AS ({SIMPLE.format(p='b')})", "bd AS (SELECT bv.corpus, rv.corpus AS reference, bv.ttr, sqrt(power(bv.ttr - rv.ttr, 2) + power(bv.mean_len - rv.mean_len, 2) + power(bv.word_len - rv.word_len, 2)) AS distance FROM bv, rv)", "nn AS (SELECT corpus, arg_min(reference, (distance, reference)) AS reference, min(distance) AS distance FROM bd GROUP BY corpus)", "wi AS (SELECT CAST(right(corpus, 4) AS BIGINT) AS block, reference FROM nn)"]
put("bank_distances", BANK, "SELECT corpus, reference, round(distance, 6) AS distance, round(-5.0 * distance, 6) AS reward FROM bd")
put("nearest_reference", BANK, "SELECT corpus, reference, round(distance, 6) AS distance FROM nn")
put("best_block", BANK, "SELECT reference, arg_min(corpus, (distance, corpus)) AS corpus, round(min(distance), 6) AS distance FROM bd GROUP BY reference")
put("first_win", BANK, "SELECT reference, min(block) AS first_block, count(*) AS wins FROM wi GROUP BY reference")
put("dedupe_path", BANK, "SELECT block, reference FROM (SELECT *, lag(reference) OVER (ORDER BY block) AS b FROM wi) WHERE b IS NULL OR b <> reference")
put("rank_shift", BANK, "SELECT corpus, s AS rank_small, l AS rank_large, l - s AS shift FROM (SELECT corpus, row_number() OVER (ORDER BY round(ttr, 6), corpus) - 1 AS s, row_number() OVER (ORDER BY round(distance, 6), corpus) - 1 AS l FROM bd WHERE reference = 'en')")
put("checkpoint_ladder", [], "SELECT conv_id, turn, i FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) - 1 AS n FROM conversations WHERE conv_id IS NOT NULL) WHERE i IN (0, n // 4, n // 2, 3 * n // 4, greatest(n - 3, 0), n)")

FAMILIES = """
al AS (SELECT corpus, sum(cnt) AS a FROM ty GROUP BY corpus),
ks AS (SELECT corpus, 'suffix' AS kind, 'suffix:' AS label, right(token, 3) AS key, token, cnt FROM ty WHERE length(token) >= 4 UNION ALL SELECT corpus, 'prefix', 'prefix:', left(token, 3), token, cnt FROM ty WHERE length(token) > 4 UNION ALL SELECT corpus, 'short_token', 'short:', token, token, cnt FROM ty WHERE length(token) BETWEEN 2 AND 4 AND cnt >= 3),
kg AS (SELECT corpus, kind, key, row_number() OVER (PARTITION BY corpus, kind ORDER BY sum(cnt) DESC, key) AS rnk FROM ks GROUP BY corpus, kind, key HAVING count(*) >= CASE kind WHEN 'short_token' THEN 1 ELSE 2 END),
me AS (SELECT corpus, label || key AS family, kind, token, cnt FROM ks JOIN kg USING (corpus, kind, key) WHERE rnk <= 12),
iv AS (SELECT corpus, family, kind, CAST(sum(cnt) AS BIGINT) AS total_occurrences, count(*) AS member_token_count, sum(length(token) * cnt) / sum(cnt) AS mean_token_length, sum(cnt) / max(a) AS mass FROM me JOIN al USING (corpus) GROUP BY ALL)"""
put("family_inventory", [BASE, FAMILIES], "SELECT corpus, family, kind, round(mass, 6) AS mass, total_occurrences, member_token_count, round(mean_token_length, 6) AS mean_token_length FROM iv")
FAMILY_COST = [BASE, FAMILIES, "mf AS (SELECT corpus || chr(9) || family AS fam, token, cnt FROM me WHERE corpus IN ('fr', 'en'))", chars("c3", 2500, "mf", "fam"), chars("s3", 800, "mf", "fam"), """
pf AS (SELECT 'c3' AS kind, fam, gram, p FROM c3 UNION ALL SELECT 's3', fam, gram, p FROM s3),
fn AS (SELECT kind, fam, sqrt(sum(p * p)) AS norm FROM pf GROUP BY ALL),
fd AS (SELECT a.kind, a.fam AS fa, b.fam AS fb, sum(a.p * b.p) AS dot FROM pf a JOIN pf b ON a.kind = b.kind AND a.gram = b.gram WHERE a.fam LIKE 'fr%' AND b.fam LIKE 'en%' GROUP BY ALL),
fc AS (SELECT fd.kind, fa, fb, dot / (x.norm * y.norm) AS c FROM fd JOIN fn x ON x.kind = fd.kind AND x.fam = fa JOIN fn y ON y.kind = fd.kind AND y.fam = fb),
cost AS (SELECT a.family AS a_family, b.family AS b_family, least(greatest(0.2 * abs(a.mass - b.mass) + 0.45 * (1 - coalesce(x.c, 0)) + 0.25 * (1 - coalesce(y.c, 0)) + 0.1 * abs(a.mean_token_length - b.mean_token_length) / greatest(a.mean_token_length, b.mean_token_length, 1.0) + CASE WHEN a.kind <> b.kind THEN 0.2 ELSE 0.0 END, 0.0), 1.0) AS cost
  FROM iv a JOIN iv b ON a.corpus = 'fr' AND b.corpus = 'en' LEFT JOIN fc x ON x.kind = 'c3' AND x.fa = 'fr' || chr(9) || a.family AND x.fb = 'en' || chr(9) || b.family LEFT JOIN fc y ON y.kind = 's3' AND y.fa = 'fr' || chr(9) || a.family AND y.fb = 'en' || chr(9) || b.family)"""]  # fmt: skip
put("family_pair_cost", FAMILY_COST, "SELECT a_family, b_family, round(cost, 6) AS cost FROM cost")

ALIGNED = [corpora_sql(where="lang IN ('en', 'fr')"), *cooc(5000), """
an AS (SELECT token FROM vo WHERE corpus = 'fr'),
ax AS (SELECT corpus, row_tok, col_tok, w FROM l2 WHERE w > 0 AND row_tok IN (SELECT token FROM an) AND col_tok IN (SELECT token FROM an)),
ag AS (SELECT coalesce(f.row_tok, e.row_tok) AS row_tok, coalesce(f.col_tok, e.col_tok) AS col_tok, coalesce(f.w, 0.0) AS cur, coalesce(e.w, 0.0) AS ref FROM (SELECT * FROM ax WHERE corpus = 'fr') f FULL JOIN (SELECT * FROM ax WHERE corpus = 'en') e ON f.row_tok = e.row_tok AND f.col_tok = e.col_tok)"""]  # fmt: skip
put("anchor_align", ALIGNED, "SELECT row_tok, col_tok, round(cur, 6) AS cur, round(ref, 6) AS ref, round(abs(ref - cur), 6) AS distance FROM ag")
TOP = "tp AS (SELECT 'cooccurrence' AS component, row_tok, col_tok, round(ref, 6) - round(cur, 6) AS delta, round(abs(round(ref, 6) - round(cur, 6)), 6) AS distance FROM ag WHERE round(abs(round(ref, 6) - round(cur, 6)), 6) > 0 ORDER BY distance DESC, row_tok, col_tok LIMIT 512)"
put("top_adjustments", [*ALIGNED, TOP], "SELECT component, row_tok, col_tok, round(delta, 6) AS delta, distance FROM tp")
put("hotspot_tokens", [*ALIGNED, TOP], "SELECT token, round(sum(w), 4) AS weight FROM (SELECT row_tok AS token, distance AS w FROM tp UNION ALL SELECT col_tok, distance * 0.5 FROM tp) GROUP BY token ORDER BY sum(w) DESC, token LIMIT 48")
put("vocabulary_overlap", [BASE, VOCAB.format(top=5000)], "SELECT a.corpus AS a, b.corpus AS b, count(*) AS shared, round(count(*) / max(s.k), 6) AS ratio FROM vo a JOIN vo b ON a.token = b.token AND a.corpus <> b.corpus JOIN (SELECT corpus, count(*) AS k FROM vo GROUP BY corpus) s ON s.corpus = a.corpus GROUP BY a.corpus, b.corpus")

put("token_budget_sample", [BASE, "dr AS (SELECT corpus, doc_id, seq, len(tokens) AS l, CAST('0x' || substr(sha256('1729:' || corpus || ':' || CAST(doc_id AS VARCHAR) || ':' || CAST(seq AS VARCHAR)), 1, 8) AS BIGINT) AS k FROM sq)"], "SELECT corpus, doc_id, seq, least(l, 5000 - b) AS size FROM (SELECT *, sum(l) OVER (PARTITION BY corpus ORDER BY k) - l AS b FROM dr) WHERE b < 5000")
put("prefix_budget", [BASE], "SELECT corpus, doc_id, seq, least(l, 5000 - b) AS size FROM (SELECT corpus, doc_id, seq, len(tokens) AS l, sum(len(tokens)) OVER (PARTITION BY corpus ORDER BY doc_id, seq) - len(tokens) AS b FROM sq) WHERE b < 5000")
put("sample_sequences", [BASE], "SELECT corpus, doc_id, seq FROM sq ORDER BY sha256('7:' || corpus || ':' || CAST(doc_id AS VARCHAR) || ':' || CAST(seq AS VARCHAR)), corpus, doc_id, seq LIMIT 40")
JOINED = "SELECT corpus, doc_id, seq, array_to_string({x}, ' ') AS tokens FROM sq"
MAPPED = "list_transform(tokens, lambda t: CASE t WHEN 'the' THEN 'thea' WHEN 'de' THEN 'der' WHEN 'la' THEN 'las' ELSE t END)"
SPLIT = "flatten(list_transform(tokens, lambda t: CASE WHEN t = 'the' THEN ['th', 'he'] ELSE [t] END))"
put("token_rewrite", [BASE], JOINED.format(x=MAPPED) + " WHERE list_has_any(tokens, ['the', 'de', 'la'])")
put("split_rewrite", [BASE], JOINED.format(x=SPLIT) + " WHERE list_contains(tokens, 'the')")
PADDED = "' ' || array_to_string(tokens, '  ') || ' '"
for name, to in (("swap_rewrite", " the  of "), ("merge_rewrite", " ofthe ")):
    put(name, [BASE], f"SELECT corpus, doc_id, seq, trim(replace(replace({PADDED}, ' of  the ', '{to}'), '  ', ' ')) AS tokens FROM sq WHERE {PADDED} LIKE '% of  the %'")
put("overlay_rewrite", [BASE], f"SELECT corpus, count(*) AS tokens, count(DISTINCT token) AS types, count(*) FILTER (WHERE token IN ('thea', 'der', 'las')) AS rewritten FROM (SELECT corpus, unnest({MAPPED}) AS token FROM sq) GROUP BY corpus")
put("corpus_diff", [BASE], "SELECT corpus, doc_id, seq, len(tokens) AS old_size, len(tokens) + len(list_filter(tokens, lambda t: t = 'the')) AS new_size FROM sq WHERE list_contains(tokens, 'the')")
put("delta_counters", [BASE], f"SELECT corpus, token, count(*) AS cnt FROM (SELECT corpus, unnest({SPLIT}) AS token FROM sq) GROUP BY ALL")
put("bigram_deltas", [BASE, f"oldnew AS (SELECT corpus, tokens AS t, -1 AS d FROM sq UNION ALL SELECT corpus, {SPLIT}, 1 FROM sq)"], "SELECT corpus, gram, CAST(sum(d) AS BIGINT) AS delta FROM (SELECT corpus, t[i] || ' | ' || t[i + 1] AS gram, d FROM (SELECT *, unnest(range(1, len(t))) AS i FROM oldnew)) GROUP BY ALL HAVING sum(d) <> 0")

put("state_counts", [BASE, f"nt AS (SELECT {MAPPED} AS t FROM sq)"], " UNION ALL ".join((
    "SELECT 'w1' AS kind, gram, count(*) AS cnt FROM (SELECT unnest(t) AS gram FROM nt) GROUP BY gram",
    "SELECT 'w2', t[i] || ' | ' || t[i + 1] AS gram, count(*) FROM (SELECT t, unnest(range(1, len(t))) AS i FROM nt) GROUP BY gram",
    "SELECT 'w3', t[i] || ' | ' || t[i + 1] || ' | ' || t[i + 2] AS gram, count(*) FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM nt) GROUP BY gram",
    "SELECT 's3', right(x, 3) AS gram, count(*) FROM (SELECT unnest(t) AS x FROM nt) WHERE length(x) >= 3 GROUP BY gram",
)))

LM = [BASE, VOCAB.format(top=5000), """
kt AS (SELECT corpus, doc_id, seq, token AS a, lead(token) OVER (PARTITION BY corpus, doc_id, seq ORDER BY pos) AS b FROM tk WHERE (corpus, token) IN (SELECT (corpus, token) FROM vo)),
tr AS (SELECT corpus, a, b, cnt, cnt / sum(cnt) OVER (PARTITION BY corpus, a) AS p FROM (SELECT corpus, a, b, count(*) AS cnt FROM kt WHERE b IS NOT NULL GROUP BY ALL)),
vz AS (SELECT corpus, count(*) AS v FROM vo GROUP BY corpus)"""]  # fmt: skip
put("lm_transitions", LM, "SELECT corpus, a, b, cnt, round(p, 6) AS p FROM tr")
put("lm_contexts", [BASE], "SELECT corpus, count(DISTINCT c) AS contexts, CAST(sum(cnt) AS BIGINT) AS total, max(cnt) AS top FROM (SELECT corpus, tokens[i] || ' ' || tokens[i + 1] AS c, tokens[i + 2] AS x, count(*) AS cnt FROM (SELECT corpus, tokens, unnest(range(1, len(tokens) - 1)) AS i FROM sq WHERE len(tokens) >= 3) GROUP BY ALL) GROUP BY corpus")
put("lm_row_entropy", LM, "SELECT corpus, v, round((h + (v - k) * ln(v)) / v, 6) AS row_entropy FROM vz JOIN (SELECT corpus, sum(h) AS h, count(*) AS k FROM (SELECT corpus, a, -sum(p * ln(p)) AS h FROM tr GROUP BY ALL) GROUP BY corpus) USING (corpus)")
KEEP = 0.95**3
put("lm_mix_uniform", LM, f"SELECT corpus, a, b, round({KEEP!r} * p + {1 - KEEP!r} / v, 6) AS p, round({1 - KEEP!r} / v, 6) AS rest FROM tr JOIN vz USING (corpus)")
put("lm_mix_target", [*LM, """
so AS (SELECT a, b, p FROM tr WHERE corpus = 'fr'),
st AS (SELECT a AS t FROM so UNION SELECT b FROM so),
ta AS (SELECT a, b, p / sum(p) OVER (PARTITION BY a) AS q FROM tr WHERE corpus = 'es' AND a IN (SELECT t FROM st) AND b IN (SELECT t FROM st))"""], "SELECT a, b, round(CASE WHEN a IN (SELECT a FROM ta) THEN 0.8 * p + 0.2 * q ELSE p END, 6) AS p FROM (SELECT coalesce(so.a, ta.a) AS a, coalesce(so.b, ta.b) AS b, coalesce(p, 0.0) AS p, coalesce(q, 0.0) AS q FROM so FULL JOIN ta ON so.a = ta.a AND so.b = ta.b) WHERE a IN (SELECT a FROM so)")  # fmt: skip

TRAJECTORY = """
bs AS (SELECT event_type AS item, user_id % 3 AS seed, event_id % 12 AS step, avg(value) AS f1, stddev_pop(value) AS f2, sum(value) AS gain FROM events GROUP BY ALL),
sr AS (SELECT *, sum(gain) OVER (PARTITION BY item, seed ORDER BY step) AS score FROM bs),
tj AS (SELECT item, seed, step, score, 'f1' AS feature, f1 AS value FROM sr UNION ALL SELECT item, seed, step, score, 'f2', f2 FROM sr)"""
DECILES = """
pg AS (SELECT *, (score - first_value(score) OVER w) / (last_value(score) OVER w - first_value(score) OVER w) AS pr FROM tj WINDOW w AS (PARTITION BY item, seed, feature ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
lg AS (SELECT *, lag(pr) OVER w AS p0, lag(value) OVER w AS v0 FROM pg WINDOW w AS (PARTITION BY item, seed, feature ORDER BY step)),
de AS (SELECT item, seed, feature, k AS decile, arg_min(v0 + (k / 10 - p0) / (pr - p0) * (value - v0), step) AS value FROM lg, range(1, 10) r(k) WHERE p0 < k / 10 AND k / 10 <= pr GROUP BY ALL
  UNION ALL SELECT item, seed, feature, 0, arg_min(value, step) FROM tj GROUP BY item, seed, feature UNION ALL SELECT item, seed, feature, 10, arg_max(value, step) FROM tj GROUP BY item, seed, feature)"""
AREAS = """
ds AS (SELECT a.item AS "left", b.item AS "right", a.seed, a.decile, sqrt(sum(power(a.value - b.value, 2))) AS d FROM de a JOIN de b ON a.seed = b.seed AND a.decile = b.decile AND a.feature = b.feature AND a.item < b.item GROUP BY ALL),
nm AS (SELECT *, d / first_value(d) OVER (PARTITION BY "left", "right", seed ORDER BY decile) AS y FROM ds),
au AS (SELECT seed, "left", "right", sum(part) AS auc FROM (SELECT *, (y + lag(y) OVER (PARTITION BY "left", "right", seed ORDER BY decile)) / 2 * 0.1 AS part FROM nm) GROUP BY ALL)"""
PAIRS = [TRAJECTORY, DECILES, AREAS]
put("trajectory_deciles", PAIRS[:2], "SELECT item, seed, feature, CAST(decile AS BIGINT) AS decile, round(value, 6) AS value FROM de")
put("trajectory_auc", PAIRS, 'SELECT seed, "left", "right", round(auc, 6) AS auc FROM au')
WITHIN = """("left" IN ('click', 'view') AND "right" IN ('click', 'view'))"""
put("panel_contrast", PAIRS, f"SELECT seed, round(f, 6) AS focal_mean, round(o, 6) AS other_mean, round(o - f, 6) AS effect, o - f > 1e-12 AS replicates FROM (SELECT seed, avg(auc) FILTER (WHERE {WITHIN}) AS f, avg(auc) FILTER (WHERE NOT {WITHIN}) AS o FROM au GROUP BY seed)")
ALLOCATIONS = """
it AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS b FROM (SELECT DISTINCT item FROM bs)),
mk AS (SELECT m AS mask FROM range(32) r(m) WHERE bit_count(m) = 2),
aw AS (SELECT mask, seed, auc, ((mask >> x.b) & 1) = 1 AND ((mask >> y.b) & 1) = 1 AS w FROM au JOIN it x ON x.item = "left" JOIN it y ON y.item = "right", mk),
ad AS (SELECT mask, seed, avg(auc) FILTER (WHERE NOT w) - avg(auc) FILTER (WHERE w) AS delta FROM aw GROUP BY ALL),
ac AS (SELECT mask, avg(delta) AS effect, bool_and(delta > 1e-12) AS replicates FROM ad GROUP BY mask)"""
put("label_permutation", [*PAIRS, ALLOCATIONS], "SELECT mask, round(effect, 6) AS effect, replicates FROM ac")
put("label_tail", [*PAIRS, ALLOCATIONS], "SELECT round(o, 6) AS observed, count(*) FILTER (WHERE effect >= o - 1e-12 * greatest(1.0, abs(o))) AS extreme, count(*) AS allocations, round(count(*) FILTER (WHERE effect >= o - 1e-12 * greatest(1.0, abs(o))) / count(*), 6) AS upper_tail FROM ac, (SELECT effect AS o FROM ac WHERE mask = 17) GROUP BY o")
put("leave_one_out", PAIRS, f"""SELECT omitted, round(avg(e), 6) AS effect, bool_and(e > 1e-12) AS replicates FROM (SELECT omitted, seed, avg(auc) FILTER (WHERE NOT {WITHIN}) - avg(auc) FILTER (WHERE {WITHIN}) AS e FROM au, (SELECT DISTINCT item AS omitted FROM bs) WHERE "left" <> omitted AND "right" <> omitted GROUP BY ALL) GROUP BY omitted""")
put("trajectory_changes", [TRAJECTORY], 'SELECT item, seed, feature, round(arg_min(value, step), 6) AS "first", round(arg_max(value, step), 6) AS "last", round(arg_max(value, step) - arg_min(value, step), 6) AS change FROM tj GROUP BY item, seed, feature')
put("arm_differences", [], 'SELECT item, step, round(f, 6) AS "full", round(d, 6) AS disabled, round(f - d, 6) AS difference FROM (SELECT event_type AS item, event_id % 5 AS step, avg(value) FILTER (WHERE user_id % 2 = 0) AS f, avg(value) FILTER (WHERE user_id % 2 <> 0) AS d FROM events GROUP BY ALL)')
put("plateau", ["bl AS (SELECT event_id % 40 AS block, max(value) AS a, avg(value) AS b FROM events GROUP BY ALL)", "pw AS (SELECT *, row_number() OVER (ORDER BY block) AS n, max(a) OVER r AS ra, max(a) OVER q AS pa, max(b) OVER r AS rb, max(b) OVER q AS pb FROM bl WINDOW r AS (ORDER BY block ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), q AS (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 10 PRECEDING))"], "SELECT block, round(a, 6) AS a, round(b, 6) AS b, round(ra, 6) AS recent_a, round(pa, 6) AS prior_a, round(rb, 6) AS recent_b, round(pb, 6) AS prior_b, n > 10 AND NOT coalesce(ra > pa + 0.001, true) AND NOT coalesce(rb > pb + 0.001, true) AS plateau FROM pw")
put("stability", [TRAJECTORY], "SELECT run, step, round(delta, 6) AS delta, coalesce(abs(delta) < 0.5, false) AS stable FROM (SELECT item || '-' || CAST(seed AS VARCHAR) AS run, step, value - lag(value) OVER (PARTITION BY item, seed ORDER BY step) AS delta FROM tj WHERE feature = 'f1')")
put("event_operator_means", [], "SELECT event_type AS operator, round(avg(value), 6) AS mean_delta, count(*) AS n FROM events GROUP BY event_type")
put("outcome_counters", [], "SELECT event_type AS operator, count(*) FILTER (WHERE value > 50) AS accepted, count(*) FILTER (WHERE value > 10 AND value <= 50) AS evaluated, count(*) FILTER (WHERE value <= 10 OR value IS NULL) AS noop FROM events GROUP BY event_type")
put("event_filter", [], "SELECT event_id, event_type AS operator, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE value > 50")
put("stagnation", [], "SELECT event_type, event_id, w AS accepted_so_far, row_number() OVER (PARTITION BY event_type, w ORDER BY event_id) - CASE WHEN w > 0 THEN 1 ELSE 0 END AS since_accept FROM (SELECT event_type, event_id, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS w FROM events)")
put("status_rollup", [], "SELECT o_orderstatus AS status, count(*) AS jobs, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
put("next_job", [], "SELECT o_custkey AS job, count(*) AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS started FROM orders GROUP BY o_custkey ORDER BY done, started, job LIMIT 1")
put("operator_schedule", [f"op AS (SELECT * FROM (VALUES {', '.join(f'({k!r}, {w!r}, {str(o).lower()})' for k, (w, o) in OPERATORS.items())}) v(operator, base, odd))", "al AS (SELECT user_id % 10 AS run, avg(value) / 100 AS x FROM events GROUP BY ALL)", "wd AS (SELECT run, least(greatest(0.15 + 0.85 * (1 - ln(1 + 8 * least(greatest(x, 0.0), 1.0)) / ln(9)), 0.15), 1.0) AS w FROM al)", "ra AS (SELECT run, operator, w, base * CASE WHEN odd THEN 0.5 + 1.8 * w ELSE 0.5 + 1.4 * (1 - w) END AS r FROM wd, op)"], "SELECT run, operator, round(w, 6) AS weirdness, round(r / sum(r) OVER (PARTITION BY run), 6) AS weight FROM ra")
put("reward_amplification", ["st AS (SELECT event_id, (value - 20) / 100 AS struct_gain, (value - 30) / 200 AS form_gain, user_id % 7 / 100 - 0.03 AS suffix_gain, user_id % 5 / 100 - 0.02 AS trigram_gain, user_id % 11 / 100 - 0.06 AS coherence_gain, event_id % 9 / 10 AS cost FROM events)", f"bo AS (SELECT *, struct_gain > 0 AND form_gain > 0 AND coherence_gain >= -0.05 AS j, {' + '.join(f'{w} * greatest(0.0, {g})' for g, w in GAINS.items())} AS g FROM st)"], "SELECT event_id, round(g + CASE WHEN j THEN 0.01 ELSE 0.0 END, 6) AS bonus, round(CASE WHEN j THEN 0.005 * cost ELSE 0.0 END, 6) AS relief, round(-1.0 + g + CASE WHEN j THEN 0.01 ELSE 0.0 END + CASE WHEN j THEN 0.005 * cost ELSE 0.0 END, 6) AS adjusted FROM bo")
CHAIN = "WITH RECURSIVE ev AS (SELECT user_id, event_id, concat_ws('|', CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR), event_type, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), ch AS (SELECT user_id, event_id, i, sha256('|' || x) AS sha256, '' AS previous_sha256 FROM ev WHERE i = 1 UNION ALL SELECT ev.user_id, ev.event_id, ev.i, sha256(ch.sha256 || '|' || ev.x), ch.sha256 FROM ch JOIN ev ON ev.user_id = ch.user_id AND ev.i = ch.i + 1)"
ORACLES["hash_chain"] = CHAIN + " SELECT user_id, event_id, sha256, previous_sha256 FROM ch"
put("hash_chain_check", [], "SELECT user_id, count(*) AS broken FROM events JOIN (SELECT user_id, min(event_id) AS f FROM events WHERE event_id % 97 = 0 GROUP BY user_id) USING (user_id) WHERE event_id >= f GROUP BY user_id")
put("feature_vector15", [BASE, *features_sql(BASE)[0][1:], f"fe AS ({features_sql(BASE)[1]})"], f"SELECT corpus, {', '.join(FEATURES[:15])} FROM fe")
MOVEMENT = [
    "mv AS (SELECT *, event_id % 12 AS step, CASE WHEN event_id % 12 = 0 THEN 'start' WHEN event_id % 12 = 11 THEN 'final' END AS state FROM events)",
    "bw AS (SELECT event_type AS corpus, avg(value) AS mean, stddev_pop(value) AS spread, avg(CAST(value > 50 AS INT)) AS high, avg(user_id % 7) AS week FROM mv GROUP BY ALL)",
    "bk AS (UNPIVOT bw ON mean, spread, high, week INTO NAME feature VALUE value)",
    "sw AS (SELECT user_id % 50 AS run, state, avg(value) AS mean, stddev_pop(value) AS spread, avg(CAST(value > 50 AS INT)) AS high, avg(user_id % 7) AS week FROM mv WHERE state IS NOT NULL GROUP BY ALL)",
    "st AS (UNPIVOT sw ON mean, spread, high, week INTO NAME feature VALUE value)",
    "sc AS (SELECT feature, avg(value) AS m, CASE WHEN stddev_pop(value) > 1e-9 THEN stddev_pop(value) ELSE 1 END AS s FROM bk GROUP BY feature)",
    "zs AS (SELECT run, state, feature, (value - m) / s AS z FROM st JOIN sc USING (feature))",
    "zc AS (SELECT corpus AS control, feature, (value - m) / s AS y FROM bk JOIN sc USING (feature) WHERE corpus IN ('error', 'purchase', 'signup'))",
    "ds AS (SELECT run, state, control, sqrt(sum((z - y) ** 2)) AS euclidean, CASE WHEN sum(z * z) > 0 AND sum(y * y) > 0 THEN 1 - sum(z * y) / (sqrt(sum(z * z)) * sqrt(sum(y * y))) ELSE 0 END AS cosine FROM zs JOIN zc USING (feature) GROUP BY ALL)",
    "fm AS (SELECT run, control, max(CASE WHEN state = 'start' THEN euclidean END) AS start_euclidean, max(CASE WHEN state = 'final' THEN euclidean END) AS final_euclidean, max(CASE WHEN state = 'start' THEN cosine END) AS start_cosine, max(CASE WHEN state = 'final' THEN cosine END) AS final_cosine FROM ds GROUP BY ALL)",
]
put("control_movement", MOVEMENT, "SELECT run, control, round(start_euclidean, 6) AS start_euclidean, round(final_euclidean, 6) AS final_euclidean, round(start_cosine, 6) AS start_cosine, round(final_cosine, 6) AS final_cosine, round(final_euclidean - start_euclidean, 6) AS delta_euclidean, round(final_cosine - start_cosine, 6) AS delta_cosine FROM fm")
put("nearest_control", [*MOVEMENT, "rf AS (SELECT run, control, round(final_euclidean, 6) AS e, round(final_cosine, 6) AS c FROM fm)"], "SELECT run, arg_min(control, (e, control)) FILTER (e IS NOT NULL) AS nearest_euclidean, min(e) AS nearest_euclidean_distance, arg_min(control, (c, control)) FILTER (c IS NOT NULL) AS nearest_cosine, min(c) AS nearest_cosine_distance FROM rf GROUP BY run")
put("run_deltas", ["ev AS (SELECT user_id % 10 AS run, event_id % 2 AS side, avg(value) AS a, max(value) AS b FROM events GROUP BY ALL)"], "SELECT x.run, round(x.a - y.a, 6) AS delta_a, round(x.b - y.b, 6) AS delta_b FROM ev x JOIN ev y ON x.run = y.run AND x.side = 0 AND y.side = 1")
put("missing_ids", [], "SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")

RETAINED = "feature IN (" + ", ".join(f"'{f}'" for f in FEATURES if f[:3] in ("f02", "f09", "f15", "f17", "f18", "f19")) + ")"
put("frozen_reward", [*LONG, Z], f"SELECT a.corpus, round(-5.0 * sqrt(sum(power(a.z - b.z, 2))), 4) AS struct FROM z a JOIN z b USING (feature) WHERE {RETAINED} AND b.corpus = (SELECT min(corpus) FROM z) GROUP BY a.corpus")
put("frozen_distances", [*LONG, Z], f"SELECT a.corpus, b.corpus AS reference, round(sqrt(sum(CASE WHEN {RETAINED} THEN power(a.z - b.z, 2) ELSE 0.0 END)), 4) AS distance_6d, round(sqrt(sum(power(a.z - b.z, 2))), 4) AS distance_21d FROM z a JOIN z b USING (feature) WHERE feature LIKE 'f%' AND a.corpus < b.corpus GROUP BY a.corpus, b.corpus")
put("total_score", [], "SELECT event_id, round(-value / 100 + 0.75 * (user_id % 10 / 10) + 0.05 * (user_id % 7 / 10 - 0.3) - 0.005 * (event_id % 9 / 10), 6) AS total FROM events")
BLOCKS = "bk AS (SELECT event_id % 40 AS block, max(value) FILTER (WHERE value < 90) AS struct, avg(value) AS form, max(user_id % 50) FILTER (WHERE user_id > 100) AS family FROM events GROUP BY event_id % 40)"
put("block_bests", [BLOCKS], "SELECT block, round(max(struct) OVER w, 6) AS best_struct, round(last_value(struct IGNORE NULLS) OVER w, 6) AS last_struct, max(family) OVER w AS best_family, last_value(family IGNORE NULLS) OVER w AS last_family FROM bk WINDOW w AS (ORDER BY block ROWS UNBOUNDED PRECEDING)")
put("joint_hit", [BLOCKS], "SELECT block, coalesce(struct >= 80, false) AND coalesce(form >= 10, false) AND coalesce(family >= 40, false) AS joint_hit FROM bk")
put("seed_audit", ["sd AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN user_id END AS requested_seed, user_id + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS engine_seed FROM events)"], "SELECT *, requested_seed = engine_seed AS seeds_match FROM sd")
put("guided_tokens", [*ALIGNED, TOP, "ht AS (SELECT token, sum(w) AS weight FROM (SELECT row_tok AS token, distance AS w FROM tp UNION ALL SELECT col_tok, distance * 0.5 FROM tp) GROUP BY token ORDER BY round(sum(w), 9) DESC, token LIMIT 48)"], "SELECT token, round(weight, 4) AS weight, cnt FROM ht JOIN (SELECT token, cnt FROM ty WHERE corpus = 'fr') USING (token) WHERE length(token) BETWEEN 2 AND 12")
REWRITTEN = BASE.replace("\nsq AS (", "\nsq0 AS (").replace("\ntk AS (", f"\nsq AS (SELECT corpus, doc_id, seq, {SPLIT} AS tokens FROM sq0),\ntk AS (")
put("tensor_update", [REWRITTEN, *cooc(5000)[:2]], "SELECT corpus, row_tok, col_tok, cnt FROM co")
put("rewritten_features", *(lambda ctes, select: (ctes, f"SELECT * FROM ({select}) WHERE corpus = 'en'"))(*features_sql(REWRITTEN)))
VECTORS = "{n} AS (SELECT corpus, u / t AS ttr, b AS bigram_coverage, g AS trigram_coverage, ln(1 + m) AS log_mean_seq_len FROM (SELECT corpus, avg(CAST(len(tokens) AS DOUBLE)) AS m, sum(len(tokens)) AS t FROM sq GROUP BY corpus) JOIN (SELECT corpus, count(*) AS u FROM ty GROUP BY corpus) USING (corpus) JOIN (SELECT corpus, sum(p) FILTER (WHERE rnk <= 100) AS b FROM {x}2 GROUP BY corpus) USING (corpus) JOIN (SELECT corpus, sum(p) FILTER (WHERE rnk <= 100) AS g FROM {x}3 GROUP BY corpus) USING (corpus))"
STRUCT = ("ttr", "bigram_coverage", "trigram_coverage", "log_mean_seq_len")
APART = lambda a: "sqrt(" + " + ".join(f"power((v.{c} - {a}_{c}) / s_{c}, 2)" for c in STRUCT) + ")"
put("coherence", [BASE, grams(2), grams(3), VECTORS.format(n="sv", x="g"), NULL_TOKENS, "nsq AS (SELECT corpus, doc_id, tokens FROM nulls)", "nty AS (SELECT corpus, token, count(*) AS cnt FROM (SELECT corpus, unnest(tokens) AS token FROM nsq) GROUP BY ALL)", prefixed(grams(2, "h2"), "n"), prefixed(grams(3, "h3"), "n"), prefixed(VECTORS.format(n="nv", x="h"), "n"),
  "ce AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, greatest(stddev_pop({c}), 1e-9) AS s_{c}" for c in STRUCT) + " FROM sv)", "ne AS (SELECT " + ", ".join(f"{c} AS n_{c}" for c in STRUCT) + " FROM nv)", f"co AS (SELECT corpus, {APART('m')} AS r, {APART('n')} AS n FROM sv v, ce, ne)"],
  "SELECT corpus, round(r, 4) AS distance_real, round(n, 4) AS distance_null, round(n - r, 4) AS margin, CASE WHEN n - r >= 1 THEN 'coherent' WHEN n - r >= 0 THEN 'borderline' ELSE 'noise_like' END AS label FROM co")
