"""The thin queries over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.llm import ann, bytebpe, chat, filteraudit, langid, licenses, lzprint, neardup, packing, ranked, sharding, substrings, tokencount
from tipoff.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bytebpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    back = bytebpe.decode(ids, path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    turns = rows.unionByName(probe).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.digests(chat.format_chats(turns))


def op6_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.edited_likeness(table(spark, sf_dir, "documents"))


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    )
    placed = sharding.shard(docs, "size", ["text_key", "text_crc32"], ["doc_id"], 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    return kept.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learnable = langid.learnable(docs)
    filters = langid.fit(docs.where(learnable))
    predicted = langid.predict(docs.select("doc_id", "text"), filters).drop("text")
    return predicted.select("doc_id", F.coalesce(~langid.learnable(predicted), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


def op12_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", *(c.alias(name) for name, c in licenses.summary(F.col("licenses")).items()))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_lz_fingerprints": op6_lz_fingerprints,
    "op7_histogram_shards": op7_histogram_shards,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_prob_minhash": op9_prob_minhash,
    "op10_language_id": op10_language_id,
    "op11_threshold_search": op11_threshold_search,
    "op12_license_templates": op12_license_templates,
    "op13_filter_audit": op13_filter_audit,
}
#: White space as str.split() has it (fixed values).
SPACE = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

CHAT_SQL = r"""
WITH said AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
    SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) p(t, r)),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS body,
    replace(regexp_replace(coalesce(role, ''), '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|nl|>') AS head FROM said)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('<|im_start|>' || head || chr(10) || body || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

#: Every 50-byte string of every text, as hex, and the least id that holds it.
REPEATS_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(doc_id, -9223372036854775808) AS id, coalesce(hex(encode(text)), '') AS h FROM documents),
chunks AS (SELECT n, id, j, substr(h, 2048 * j + 1, 2146) AS c FROM (SELECT n, id, h, unnest(range(0, length(h) // 2048 + 1)) AS j FROM d)),
strings AS MATERIALIZED (SELECT n, id, 1024 * j + i AS place, substr(c, 2 * i + 1, 100) AS string
    FROM (SELECT n, id, j, c, unnest(range(0, least(1024, length(c) // 2 - 49))) AS i FROM chunks)),
firsts AS (SELECT string, min(id) AS least FROM strings GROUP BY string HAVING min(id) < max(id)),
gone AS (SELECT n, place, CASE WHEN place <= lag(place) OVER (PARTITION BY n ORDER BY place) + 50 THEN 0 ELSE 1 END AS fresh
    FROM strings JOIN firsts USING (string) WHERE least < id),
numbered AS (SELECT n, place, sum(fresh) OVER (PARTITION BY n ORDER BY place) AS run FROM gone),
runs AS (SELECT n, min(place) AS a, max(place) + 50 AS b FROM numbered GROUP BY n, run),
gaps AS (SELECT n, a, b, coalesce(lag(b) OVER (PARTITION BY n ORDER BY a), 0) AS since FROM runs),
held AS (SELECT n, count(*) AS spans, sum(b - a) AS removed, max(b) AS rest, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM gaps JOIN d USING (n) GROUP BY n)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN held USING (n)"""

CLASSES_SQL = f"""
WITH RECURSIVE nodes AS MATERIALIZED (SELECT row_number() OVER (ORDER BY txt) AS node, txt, least
    FROM (SELECT coalesce(text, '') AS txt, min(doc_id) AS least FROM documents GROUP BY 1)),
words AS (SELECT node, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT node, regexp_extract_all(txt, '[^{SPACE}]+') AS l FROM nodes)),
runs AS (SELECT node, i, count(*) OVER (PARTITION BY node) AS c,
    concat_ws(' ', w, lead(w) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS shingle FROM words WINDOW o AS (PARTITION BY node ORDER BY i)),
shingles AS MATERIALIZED (SELECT DISTINCT node, shingle FROM runs WHERE i <= greatest(c - 4, 1)),
sizes AS (SELECT node, count(*) AS c FROM shingles GROUP BY node),
pairs AS (SELECT a.node AS x, b.node AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.node < b.node GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN sizes p ON p.node = x JOIN sizes q ON q.node = y WHERE common >= CAST(0.8 AS DOUBLE) * (p.c + q.c - common)),
sides AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, label) AS (SELECT node, node FROM nodes UNION SELECT sides.y, reach.label FROM reach JOIN sides ON sides.x = reach.node),
labels AS (SELECT node, min(label) AS label FROM reach GROUP BY node),
lowest AS (SELECT label, min(least) AS class_id FROM labels JOIN nodes USING (node) GROUP BY label)
SELECT doc_id, lowest.class_id FROM documents JOIN nodes ON coalesce(text, '') = txt JOIN labels USING (node) JOIN lowest USING (label)"""

#: Every document against every item, by the terms they share.
SEARCH_SQL = r"""
WITH low AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM documents),
sizes AS (SELECT n, doc_id, CAST(len(l) AS BIGINT) AS c FROM low WHERE len(l) > 0),
figures AS (SELECT count(*) AS docs, CAST(sum(c) AS BIGINT) AS terms FROM sizes),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
postings AS MATERIALIZED (SELECT n, term, count(*) AS tf FROM (SELECT n, unnest(l) AS term FROM low) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY 1), figures),
impacts AS (SELECT n, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * c * docs) // terms))) AS part FROM postings JOIN weights USING (term) JOIN sizes USING (n), figures),
scores AS (SELECT item_id, n, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM asked JOIN impacts USING (term) JOIN sizes USING (n) GROUP BY ALL),
ranks AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 20"""

#: All five filters as columns, every order of them applied one after another.
AUDIT_SQL = r"""
WITH labelled AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
own AS (SELECT doc_id, coalesce(text, '') AS txt, coalesce(lang, '') AS part FROM documents),
words AS (SELECT doc_id, txt, part, regexp_extract_all(txt, '[^\x20\x09-\x0D]+') AS l, doc_id > min(doc_id) OVER (PARTITION BY txt) AS late FROM own),
failing AS (SELECT doc_id, part, {'A': len(l) < 200, 'B': 100 * len(list_distinct(l)) < 50 * len(l), 'C': 100 * length(regexp_replace(txt, '[^A-Z]', '', 'g')) > 3 * length(txt),
    'D': regexp_matches(txt, '[#$%&*|]'), 'E': coalesce(late, false)} AS f FROM words),
cells AS (SELECT part, f.A AS a, f.B AS b, f.C AS c, f.D AS d, f.E AS e, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM failing LEFT JOIN labelled USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
told AS (SELECT part, o, step, n, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: CASE y WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails FROM cells, steps),
marked AS (SELECT part, o, step, n, good, toxic, len(fails) AS k, list_contains(fails, o[step]) AS here, len(list_filter(fails, lambda y: instr(o, y) < step)) > 0 AS gone FROM told),
counted AS (SELECT part, o AS filter_order, step, o[step] AS letter, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (here AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (here AND k = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (here AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT gone), 0) AS toxic_lost FROM marked GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM counted"""


def _pattern(items: list) -> str:
    """A template as a regular expression over words that each have a blank before them."""
    return "".join(f"(?:{_pattern(x[1])})?" if x[0] == "opt" else f"(?: [^ ]+){{{x[1]},{x[2]}}}" if x[0] == "any" else " " + x.decode() for x in items)


def licenses_sql() -> str:
    """For each word of a text in which a template stands, the first place of the template in
    the words up to it that ends there."""
    rows = [(label, label_is_base, _pattern(licenses.parse(markup)), licenses.longest(licenses.parse(markup))) for label_is_base, group in ((True, licenses.BASE), (False, licenses.TEMPLATES)) for label, markup in group]
    values = ", ".join(f"('{a}', {b}, '{p}', {n})" for a, b, p, n in rows)
    return rf"""
WITH templates(label, base, pattern, longest) AS (VALUES {values}),
low AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
held AS MATERIALIZED (SELECT n, l, label, base, pattern, longest FROM low, templates WHERE regexp_matches(' ' || array_to_string(l, ' ') || ' ', pattern || ' ')),
ends AS (SELECT n, label, base, i, regexp_extract(' ' || array_to_string(l[greatest(1, i - longest + 1):i], ' '), pattern || '$') AS place FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM held)),
places AS (SELECT n, label, base, i - len(string_split(substr(place, 2), ' ')) AS first, i - 1 AS last FROM ends WHERE place <> ''),
covered AS (SELECT n, count(DISTINCT w) AS c FROM (SELECT n, unnest(range(first, last + 1)) AS w FROM places) GROUP BY n),
told AS (SELECT n, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY n)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN len(l) > 0 THEN coalesce(c, 0)::DOUBLE / len(l)::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM low LEFT JOIN told USING (n) LEFT JOIN covered USING (n)"""


#: The others depend on a tokenizer's merges, on a fitted model or on hashes.
ORACLES = {"op5_chat_formatting": CHAT_SQL, "op8_suffix_dedup": REPEATS_SQL, "op9_prob_minhash": CLASSES_SQL,
    "op11_threshold_search": SEARCH_SQL, "op12_license_templates": licenses_sql(), "op13_filter_audit": AUDIT_SQL}


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict:
    return ORACLES
