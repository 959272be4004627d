"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm import chat, decontaminate, fm_dedup, importance, jaccard, pieces, sharding, simhash, spelling, suffix_dedup, topk, toxicity, url_filter
from barlight.llm.common import ORACLES, QUERIES, query, shared_folder, table  # noqa: F401


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op6_virtual_slot_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(spark, table(spark, sf_dir, "documents"), 24, shared_folder(spark, "slot-map"))
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard")


# The rules of the query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

OP8_SQL = """
WITH rules(rh, rp, v) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + r"""),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
fits AS (SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM parts JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1"""


@query("op8_sorted_digest_url_filter", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judged(table(spark, sf_dir, "pages"), url_filter.build_index(spark, rules), "page_id", "url").withColumnRenamed("id", "page_id")


def is_held_out(doc_id) -> object:
    """Rows that nothing is learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


@query("op7_boosted_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~is_held_out("doc_id")))
    out = toxicity.scored(docs, model)
    return out.select(F.col("id").alias("doc_id"), is_held_out("id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""


@query("op1_sorted_list_top_k", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS k FROM w, LATERAL (SELECT unnest(generate_series(1, len(ws) - 34)) AS i)),
rep AS (SELECT doc_id, i AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
cut AS (SELECT doc_id, p, word, max(CASE WHEN rep.p IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM pos LEFT JOIN rep USING (doc_id, p))
SELECT w.doc_id, CAST(count(c.p) AS BIGINT) AS n_words, CAST(coalesce(sum(c.gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.p) FILTER (WHERE c.gone = 0), '')) AS kept_sha256
FROM w LEFT JOIN cut c USING (doc_id) GROUP BY w.doc_id"""


@query("op9_fm_index_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fm_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


@query("op2_suffix_array_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_earlier(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_simhash_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "n_words", F.round("similarity", 6).alias("similarity"))


# Where the model file is; a parameter, the file is never copied into the repository.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query("op5_max_plus_pieces")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.ship_model(spark, PIECE_MODEL)
    out = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return out.select(F.col("id").alias("doc_id"), F.size("pieces").alias("n_pieces"), F.sha2(F.array_join("pieces", " "), 256).alias("pieces_sha256"),
                      (F.xxhash64("decoded") == F.col("th")).alias("round_trip"))


# Parameters of the two tools that turns of a conversation stand for in the query.
TURN_TOOLS = [("ask", "prompt", "string", True), ("ask", "words", "integer", True), ("ask", "context", "string", False), ("configure", "instruction", "string", True)]

OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '-' || turn AS call_id, CASE role WHEN 'user' THEN 'ask' ELSE 'configure' END AS name, text,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE role IN ('system', 'user')),
calls AS (SELECT c.*, CASE WHEN name = 'ask' AND c.turn > 0 AND EXISTS (FROM c d WHERE d.call_id = CAST(c.conv_id AS VARCHAR) || '-0') THEN 1 ELSE 0 END AS level,
    CASE WHEN name = 'configure' THEN '{"instruction":' || to_json(text) || '}'
      ELSE '{' || CASE WHEN c.turn > 0 THEN '"context":"@' || c.conv_id || '-0",' ELSE '' END || '"prompt":' || to_json(text) || ',"words":' || words || '}' END AS args FROM c),
results AS (SELECT conv_id, turn AS result_turn, CAST(conv_id AS VARCHAR) || '-' || (turn - 1) AS call_id, CAST(to_json(text) AS VARCHAR) AS content FROM conversations WHERE role = 'assistant')
SELECT coalesce(k.conv_id, r.conv_id) AS conv_id, coalesce(k.call_id, r.call_id) AS call_id, coalesce(k.name, '') AS name, coalesce(k.turn, -1) AS turn,
  coalesce(r.result_turn, -1) AS result_turn, coalesce(k.level, -1) AS level,
  CASE WHEN k.call_id IS NULL THEN 0 ELSE 1 END AS n_calls, CASE WHEN r.call_id IS NULL THEN 0 ELSE 1 END AS n_results,
  CASE WHEN k.call_id IS NULL THEN 'no call' ELSE '' END AS errors,
  '{"arguments":' || coalesce(k.args, 'null') || ',"call_id":"' || coalesce(k.call_id, r.call_id) || '","errors":' || CASE WHEN k.call_id IS NULL THEN '["no call"]' ELSE '[]' END
    || ',"level":' || coalesce(CAST(k.level AS VARCHAR), 'null') || ',"name":' || coalesce('"' || k.name || '"', 'null') || ',"result":' || coalesce(r.content, 'null')
    || ',"result_turn":' || coalesce(CAST(r.result_turn AS VARCHAR), 'null') || ',"turn":' || coalesce(CAST(k.turn AS VARCHAR), 'null') || '}' AS json
FROM calls k FULL JOIN results r ON k.conv_id = r.conv_id AND k.call_id = r.call_id"""


def turns_as_calls(turns: DataFrame) -> DataFrame:
    """Turns in the form of tool messages: system and user turns call a tool, a user turn refers to turn 0, an assistant's turn is the result of the turn before."""
    ident = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    words = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    ask = F.struct(F.when(F.col("turn") > 0, F.concat(F.lit("@"), ident(F.lit(0)))).alias("context"), F.col("text").alias("prompt"), words.alias("words"))
    call = lambda name, args: F.to_json(F.struct(F.array(F.struct(ident(F.col("turn")).alias("id"), F.lit(name).alias("name"), args.alias("arguments"))).alias("tool_calls")))
    text = F.when(F.col("role") == "user", call("ask", ask)).when(F.col("role") == "system", call("configure", F.struct(F.col("text").alias("instruction"))))
    text = text.when(F.col("role") == "assistant", F.to_json(F.struct(ident(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content"))))
    return turns.select("conv_id", "turn", text.alias("text"))


@query("op4_linked_tool_calls", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = spark.createDataFrame(TURN_TOOLS, "name string, parameter string, kind string, required boolean")
    out = chat.link_tool_calls(turns_as_calls(table(spark, sf_dir, "conversations")), tools).withColumnRenamed("conv", "conv_id")
    return out.fillna(-1, ["turn", "result_turn", "level"]).fillna("", ["name"])


# CRC-32 in SQL: a table of 256 entries by rule, and a fold over the bytes in hexadecimal form.
CRC_TABLE_SQL = """crc_table AS (SELECT list(CAST(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS BIGINT) ORDER BY i) AS t FROM range(256) r(i))"""


def crc_sql(text: str) -> str:
    """CRC-32 of a text; the query reads ``crc_table`` too."""
    byte = f"list_transform(range(1, len(hex(encode({text}))) // 2 + 1), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295)"


def _features_sql(table_name: str, name: str, id_sql: str) -> str:
    return rf"""{name}_w AS (SELECT {id_sql} AS k, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM {table_name}),
{name} AS (SELECT k, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM {name}_w)"""


OP11_SQL = f"""
WITH {CRC_TABLE_SQL},
{_features_sql('documents', 'df', 'doc_id')},
{_features_sql('benchmark', 'bf', 'item_id')},
names AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
bucket AS (SELECT f, {crc_sql('f')} % 10000 AS b FROM names, crc_table),
s AS (SELECT b, count(*) AS n FROM df JOIN bucket USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bf JOIN bucket USING (f) GROUP BY b),
total AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS s, (SELECT coalesce(sum(n), 0) FROM t) AS t),
gain AS (SELECT r.b, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (total.s + 10000) AS DOUBLE) / CAST((coalesce(s.n, 0) + 1) * (total.t + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM range(10000) r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b), total),
w AS (SELECT k, sum(g) AS g, count(*) AS n FROM df JOIN bucket USING (f) JOIN gain USING (b) GROUP BY k),
h AS (SELECT k AS doc_id, len(ws) AS words, CAST(len(ws) + greatest(len(ws) - 1, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(w.g / w.n), 0) AS BIGINT) AS weight,
    CAST(CAST('0x' || substr(sha256('7:' || k), 1, 8) AS BIGINT) AS DOUBLE) AS h FROM df_w LEFT JOIN w USING (k)),
x AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM h),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * 25 // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)"""


@query("op11_importance_resampling", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00c0-\u00ff]+')) AS w FROM documents),
each AS (SELECT doc_id || ':' || w AS k, w, count(*) AS n FROM runs GROUP BY doc_id, w),
h AS (SELECT w, n, {crc_sql('k')} AS h FROM each, crc_table),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS d FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS p)),
pairs AS (SELECT a.word AS w, b.word AS o, b.n AS m FROM less a JOIN less b ON a.p = b.p AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.d = b.word),
best AS (SELECT w, o, m, count(*) OVER (PARTITION BY w) AS n_near, row_number() OVER (PARTITION BY w ORDER BY m DESC, o) AS k FROM pairs),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN o END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best ON w = word AND k = 1),
steps AS (SELECT word, word AS root, 0 AS depth FROM words UNION ALL SELECT s.word, f.form, depth + 1 FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, s.root FROM forms f JOIN (SELECT word, arg_max(root, depth) AS root FROM steps GROUP BY word) s USING (word)"""


@query("op13_spelling_variants", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), drop_every=97))


OP12_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS far FROM ways UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.far)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(far) AS least FROM reach GROUP BY doc_id) c USING (doc_id)"""


@query("op12_jaccard_join", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.similar_documents(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
