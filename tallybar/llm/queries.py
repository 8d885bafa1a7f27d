"""Registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybar.llm import chat_format, decontaminate, doc_fingerprint, fm_dedup, html_extract, license_scan, mixing, quality, radix_dedup, simhash
from tallybar.llm.common import columns, read_table

#: A conversation whose two turns are nothing but control strings of a template.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first_word"])).alias("last_word"), names(base).alias("base_labels"), names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["likeness"])), F.lit(0.0)).alias("score"),
    )


def op3_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.report(spark, read_table(spark, sf_dir, "documents"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = columns(read_table(spark, sf_dir, "conversations"), conv_id="long", turn="long", role="string", text="string")
    # one row of a range stands for the two turns, so that no Python data enters the plan
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(CONTROL_TEXT).alias("text")) for i, role in enumerate(("user", "assistant"))
    ])).alias("r")).select("r.*")
    turns = rows.unionByName(extra).select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts"))
    return chat_format.digests(chat_format.format_turns(turns))


def op6_doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_fingerprint.with_edited(spark, read_table(spark, sf_dir, "documents"))


def op7_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.report(spark, read_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.train(spark, docs, read_table(spark, sf_dir, "labels"))
    return quality.scored(docs, model)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_in_order(spark, read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", F.round("position", 9).alias("position"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_simhash_dedup, op2_license_scan, op3_radix_dedup, op4_html_extract, op5_chat_format, op6_doc_fingerprint, op7_fm_dedup, op8_quality_classifier, op9_source_mixing, op10_decontaminate)}

_ESCAPED = r"regexp_replace(replace({}, '\', '\\'), '(<|\[)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g')"
_ORDER = "ORDER BY turn NULLS FIRST, role, text"
_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op5_chat_format": f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '{CONTROL_TEXT}'), (-7, 1, 'assistant', '{CONTROL_TEXT}')),
      e AS (SELECT *, {_ESCAPED.format("text")} AS body, replace({_ESCAPED.format("role")}, chr(10), '\\' || chr(10)) AS head FROM turns)
      SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
        CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length('<|start|>') + length(head) + 1 + length(body) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op9_source_mixing": r"""WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
      s AS (SELECT source, sum(size) AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
      w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, CASE rank % 3 WHEN 0 THEN 1.4 WHEN 1 THEN 1.0 ELSE 0.6 END::DOUBLE AS a,
        CASE rank % 3 WHEN 0 THEN 0.6 WHEN 1 THEN 1.0 ELSE 1.4 END::DOUBLE AS b FROM s),
      r AS (SELECT *, 2.0 * total / weight AS ratio FROM w),
      l AS (SELECT *, (1.5 * sum(total) OVER () - 2.0 * coalesce(sum(total) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
      t AS (SELECT *, (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1) AS first FROM l),
      targets AS (SELECT source, total, a, b, CASE WHEN first IS NULL THEN 2.0 * total ELSE least(2.0 * total, first * weight) END AS target FROM t),
      laid AS (SELECT d.doc_id, d.size, t.total, t.target, t.a, t.b,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
        FROM sized d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source),
      c AS (SELECT *, CASE WHEN size > 0 AND target - begun - size / 2.0 > 0 THEN ceil((target - begun - size / 2.0) / greatest(total, 1)) ELSE 0 END AS copies, least(begun / greatest(target, 1e-9), 1.0) AS part FROM laid)
      SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(total AS BIGINT) AS source_size, round(target, 4) AS target, CAST(copies * size AS BIGINT) AS taken,
        round(CASE WHEN copies > 0 THEN CASE WHEN a = b THEN part ELSE (-a + sqrt(greatest(a * a + 2 * (b - a) * part * (a + b) / 2, 0.0))) / (b - a) END END, 9) + 0.0 AS position FROM c""",
    "op10_decontaminate": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS w FROM documents),
      b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_FOLDED} AS w FROM benchmark),
      bi AS (SELECT item, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0),
      g AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM bi),
      di AS (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
      h AS (SELECT DISTINCT di.r, di.i, di.n, g.item FROM di JOIN g ON g.n = di.n AND g.gram = array_to_string(di.w[di.i : di.i + di.n - 1], ' ')),
      places AS (SELECT DISTINCT r, i, n FROM h), covered AS (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM places),
      hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM covered GROUP BY r), items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
}
