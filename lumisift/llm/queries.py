"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, errata, hardneg, langid, licenses, mixing, mixture, simhash, substring, tokencount, tokenstore
from .common import table

#: A conversation whose texts look like control strings, formatted beside the table's own.
TRICKY = r"\### Assistant: </turn> ok"


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), lambda i: i % 20 == 0, k=20)


def op3_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join("sentence_ids", ",").alias("sentence_ids"))


def op4_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as given

    return tokenstore.materialise_order(table(spark, sf_dir, "documents", "doc_id", "text"), given.path("byte_bpe_50k.tiktoken"), given.PATTERN)


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "passes", F.round("position", 9).alias("position"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    done = chat.format_conversations(turns.unionByName(tricky))
    back = done.select("conv_id", "formatted", "valid", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op10_substring_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_errata_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errata.spelling_variants(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.score_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", label), lambda i: i % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spaced_seeds": op1_spaced_seeds,
    "op2_kmeans_tree": op2_kmeans_tree,
    "op3_license_rules": op3_license_rules,
    "op4_language_ppm": op4_language_ppm,
    "op5_simhash_golay": op5_simhash_golay,
    "op6_token_counts": op6_token_counts,
    "op7_token_shards": op7_token_shards,
    "op8_curriculum_mix": op8_curriculum_mix,
    "op9_chat_format": op9_chat_format,
    "op10_substring_rlz": op10_substring_rlz,
    "op11_errata_trie": op11_errata_trie,
    "op12_context_mixing": op12_context_mixing,
    "op13_hard_negatives": op13_hard_negatives,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op1_sql() -> str:
    def seeds(table: str) -> str:
        found = []
        for k, mask in enumerate(decontam.SEEDS):
            look = ", ".join(f"h[p + {j + 1}]" for j in decontam.looked(mask))
            found.append(f"SELECT rn, p, {k} AS m, array_to_string([{look}], ' ') AS seed FROM (SELECT rn, h, unnest(range(0, greatest(len(h) - {len(mask) - 1}, 0))) AS p FROM {table})")
        return " UNION ALL ".join(found)

    tokens = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {tokens} AS h FROM documents),
a AS (SELECT row_number() OVER () AS rn, item_id, {tokens} AS h FROM benchmark),
t AS (SELECT * FROM a WHERE len(h) >= {decontam.SCORE}),
ds AS ({seeds("d")}), ts AS ({seeds("t")}),
hits AS (SELECT DISTINCT ds.rn AS d, ts.rn AS t, ds.p - ts.p AS shift FROM ds JOIN ts USING (m, seed)),
laid AS (
  SELECT hits.*, d.doc_id, t.item_id, d.h AS dh, t.h AS th, unnest(range(greatest(0, -shift), least(len(t.h), len(d.h) - shift))) AS i
  FROM hits JOIN d ON d.rn = hits.d JOIN t ON t.rn = hits.t),
p AS (
  SELECT d, t, shift, i, doc_id, item_id, len(th) AS item_tokens,
    sum(CASE WHEN dh[i + shift + 1] = th[i + 1] THEN 1 ELSE -{decontam.PENALTY} END) OVER (PARTITION BY d, t, shift ORDER BY i) AS p FROM laid),
b AS (
  SELECT doc_id, item_id, item_tokens, p - least(0, min(p) OVER (PARTITION BY d, t, shift ORDER BY i)) AS score FROM p
  UNION ALL
  SELECT doc_id, item_id, len(a.h), len(a.h) FROM a JOIN (SELECT doc_id, h, unnest(range(1, len(h) + 1)) AS i FROM d) AS e
    ON len(a.h) BETWEEN 1 AND {decontam.SCORE - 1} AND e.h[i] = a.h[1] AND e.h[i:i + len(a.h) - 1] = a.h)
SELECT doc_id, item_id, CAST(max(score) AS BIGINT) AS score, CAST(max(item_tokens) AS BIGINT) AS item_tokens
FROM b WHERE score >= least({decontam.SCORE}, item_tokens) GROUP BY doc_id, item_id"""


def _op3_sql() -> str:
    names = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licenses.known().items())

    def matched(column: str) -> tuple[list[str], str]:
        rest, found = f"list_aggregate(list_transform({column}, lambda x: '<' || x || '>'), 'string_agg', '')", []
        steps = [f"coalesce({rest}, '') AS r0"]
        for k, (licence, rule) in enumerate(licenses.RULES):
            steps.append(f"replace(r{k}, {_quoted(licenses.said(rule))}, '|') AS r{k + 1}")
            found.append(f"CASE WHEN contains(r{k}, {_quoted(licenses.said(rule))}) THEN {_quoted(licence)} END")
        return steps, "[" + ", ".join(found) + "]"

    steps, found = matched("ids")
    chain = "SELECT doc_id, view, ids, " + steps[0] + " FROM seqs"
    for step in steps[1:]:
        chain = f"SELECT *, {step} FROM ({chain})"
    sentence = r"trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
    cut = r"string_split(regexp_replace({}, '([.!?;:])[ \t\r\n\f]+', '\1' || chr(10), 'g'), chr(10))"
    folded = r"translate(regexp_replace(text, '\n[ \t\r\n]*\n', chr(1), 'g'), chr(10) || chr(1), ' ' || chr(10))"
    return f"""
WITH names(sentence, id) AS (VALUES {names}),
texts AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_replace(coalesce(text, ''), '({licenses.TAG}):[ \t]*', '\\1 ', 'gi') AS text FROM documents),
views AS (
  SELECT row_no, doc_id, 1 AS view, {cut.format("text")} AS ss FROM texts
  UNION ALL SELECT row_no, doc_id, 2, {cut.format(folded)} FROM texts),
said AS (SELECT row_no, view, unnest(ss) AS s, generate_subscripts(ss, 1) AS k FROM views),
hits AS (SELECT row_no, view, list(id ORDER BY k) AS ids FROM said JOIN names ON sentence = {sentence} GROUP BY ALL),
seqs AS (SELECT row_no AS doc_id, view, ids FROM hits),
ruled AS (SELECT doc_id AS row_no, view, ids, list_filter({found}, lambda x: x IS NOT NULL) AS found FROM ({chain})),
paired AS (
  SELECT t.doc_id, a.ids AS ia, b.ids AS ib, list_sort(list_distinct(list_concat(coalesce(a.found, []), coalesce(b.found, [])))) AS found
  FROM texts t LEFT JOIN ruled a ON a.row_no = t.row_no AND a.view = 1 LEFT JOIN ruled b ON b.row_no = t.row_no AND b.view = 2)
SELECT doc_id, array_to_string(found, ',') AS licences,
  coalesce(array_to_string(CASE WHEN coalesce(len(ib), 0) > coalesce(len(ia), 0) THEN ib ELSE ia END, ','), '') AS sentence_ids
FROM paired"""


def _op8_sql() -> str:
    schedules = mixing.SCHEDULES
    weights = "[" + ", ".join(str(float(mixing.integral(k))) for k in schedules) + "]"

    def at(knots, share):
        total, below, steps = mixing.integral(knots), 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            area, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
            need = f"({share} * {total!r} - {below!r})"
            got = f"{need} / {w0!r}" if slope == 0 else f"(sqrt(greatest(0.0::DOUBLE, {w0 * w0!r} + {2 * slope!r} * {need})) - {w0!r}) / {slope!r}"
            steps.append(f"WHEN {share} * {total!r} <= {below + area!r} THEN least({t1!r}::DOUBLE, {t0!r}::DOUBLE + {got})")
            below += area
        return "CASE " + " ".join(steps) + " ELSE 1.0::DOUBLE END"

    places = " ".join(f"WHEN class = {k} THEN {at(knots, 'share')}" for k, knots in enumerate(schedules))
    return rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('8|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, ((row_number() OVER (ORDER BY skey LIKE 'n%', skey)) - 1) % {len(schedules)} AS class FROM d GROUP BY skey),
w AS (SELECT *, list_extract({weights}::DOUBLE[], CAST(class + 1 AS BIGINT)) AS weight, source_size * 3.0::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY most / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, (most / weight, skey)) AS fill FROM l WHERE most / weight > level),
g AS (SELECT skey, source_size, class, CASE WHEN fill IS NULL THEN most ELSE least(most, weight * fill) END AS target FROM l, f),
c AS (SELECT d.*, g.source_size, g.class, g.target, CAST(round(target) AS BIGINT) AS goal,
    coalesce(sum(size) OVER (PARTITION BY d.skey ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at
  FROM d JOIN g USING (skey)),
e AS (SELECT *, goal // greatest(source_size, 1) AS full_passes, greatest(0, least(size, goal - (goal // greatest(source_size, 1)) * source_size - start_at)) AS cut FROM c),
t AS (SELECT *, CAST(full_passes * size + cut AS BIGINT) AS taken FROM e),
p AS (SELECT *, (start_at + least(size, taken) / 2) / CAST(greatest(goal, 1) AS DOUBLE) AS share FROM t)
SELECT doc_id, size, source_size, target, taken,
  CAST(full_passes * CAST(size > 0 AS INTEGER) + CAST(cut > 0 AS INTEGER) AS INTEGER) AS passes,
  round(CASE WHEN taken > 0 THEN CASE {places} END END, 9) AS position FROM p"""


def _op9_sql() -> str:
    t = chat.DEFAULT

    def escaped(column: str) -> str:
        for char, code in t.escapes:
            column = f"replace({column}, {_quoted(char)}, {_quoted(code)})"
        return column

    marks = len(t.open) + len(t.named) + len(t.close)
    return rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', {_quoted(TRICKY)}), (-7, 1, 'assistant', {_quoted(TRICKY)})),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'tool' THEN 't' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text) AS roles,
    sum({marks} + length({escaped("role")}) + length({escaped("text")})) AS chars
  FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, regexp_full_match(roles, 's?(ua(t+a)*)+') AS valid
FROM g"""


def _op10_sql() -> str:
    return r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT row_no, doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS k FROM d WHERE doc_id IS NOT NULL),
w AS (SELECT row_no, doc_id, k, md5(array_to_string(ws[k:k + 49], ' ')) AS h FROM k),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h),
g AS (SELECT DISTINCT row_no, unnest(range(k, k + 50)) AS at FROM w JOIN f USING (h) WHERE doc_id > first),
p AS (SELECT row_no, unnest(ws) AS word, generate_subscripts(ws, 1) AS at FROM d),
l AS (SELECT p.row_no, string_agg(word, ' ' ORDER BY p.at) AS kept, count(*) AS n FROM p ANTI JOIN g ON g.row_no = p.row_no AND g.at = p.at GROUP BY p.row_no)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l USING (row_no)"""


def _op11_sql() -> str:
    step = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"  # the polynomial of zip files, reflected
    cut = f"translate(run, '{errata.UPPER}', '{errata.LOWER}')"
    return rf"""
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda a, k: {step}, b)) AS t),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
k AS (SELECT id, {cut} AS w, count(*) AS times FROM r WHERE length(run) >= {errata.LEAST_LENGTH} GROUP BY ALL),
x AS (SELECT *, hex(encode(id || ':' || w)) AS x FROM k),
h AS (
  SELECT w, times, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
    lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1]), 4294967295), 4294967295) AS h FROM x, c),
l AS (SELECT CASE WHEN h % {errata.SLIPS} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, times FROM h),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM l WHERE length(word) >= {errata.LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {errata.LEAST_COUNT}),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS z FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT d.word AS a, v.word AS b FROM d JOIN v ON v.word = d.z
  UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.z
  UNION SELECT d.word, e.word FROM d JOIN d AS e ON d.z = e.z AND d.i = e.i AND d.word <> e.word),
b AS (SELECT a, count(*) AS n_near, min((-v.n, v.word)) AS best FROM p JOIN v ON v.word = b GROUP BY a),
f AS (
  SELECT word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN -best[1] >= {errata.TIMES} * n THEN best[2] END AS form, CASE WHEN -best[1] >= {errata.TIMES} * n THEN -best[1] END AS form_n
  FROM v LEFT JOIN b ON a = word),
w AS (SELECT word, form AS up FROM f WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.up WHERE f.form IS NOT NULL),
e AS (SELECT w.word, w.up FROM w JOIN f ON f.word = w.up WHERE f.form IS NULL)
SELECT f.word, form, coalesce(up, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN e ON e.word = f.word"""


def _op13_sql() -> str:
    return f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({hardneg.SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score
  FROM e AS a JOIN e ON a.vec_id % 50 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (
  SELECT anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, CAST(k AS INTEGER) AS positive_rank,
    CAST(row_number() OVER (PARTITION BY anchor_id, k ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE k <= {hardneg.POSITIVES} AND NOT s.same AND {hardneg.SHARES[0]} * p.score <= 100 * s.score AND 100 * s.score <= {hardneg.SHARES[1]} * p.score)
SELECT * FROM n WHERE rank <= {hardneg.NEGATIVES}"""


ORACLE_SQL: dict[str, str] = {"op1_spaced_seeds": _op1_sql(), "op3_license_rules": _op3_sql(), "op8_curriculum_mix": _op8_sql(), "op9_chat_format": _op9_sql(), "op10_substring_rlz": _op10_sql(), "op11_errata_trie": _op11_sql(), "op13_hard_negatives": _op13_sql()}
