"""Registered queries of this package: each applies one operator to its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import (
    digests, embedding_dedup, line_dedup, mixing, packing, periodic_runs, pii, quality, sharding, simhash, spelling_variants, substring_dedup, token_counts,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality.score(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.GOOD).cast("int").alias("predicted"))


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the digest are those of the strict spans; ``n_added`` counts the accepted candidates."""
    docs = documents(spark, sf_dir)
    found = pii.find(docs, pii.learn(docs))
    base = F.filter("spans", lambda s: s["strict"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.expr(f"filter(spans, s -> s.strict AND s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    added = F.size(F.filter("spans", lambda s: ~s["strict"])).cast("long").alias("n_added")
    return found.select("doc_id", *counts, added, F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"))


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup_passages(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query(
    "op6_line_dedup",
    """WITH split AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents),
      lines AS MATERIALIZED (SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split),
      boilerplate AS (SELECT line, min(doc_id) AS first FROM lines WHERE trim(line) <> ''
        GROUP BY line HAVING count(DISTINCT source) >= 10),
      marked AS (SELECT doc_id, pos, lines.line, coalesce(doc_id <> first, false) AS gone FROM lines LEFT JOIN boilerplate USING (line))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query(
    "op7_mixing",
    r"""WITH d AS MATERIALIZED (SELECT doc_id, source,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
      totals AS MATERIALIZED (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
      weighted AS MATERIALIZED (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM totals),
      -- sources in the order in which they reach their limit: the level at which the first n of them are full
      filled AS (SELECT *, 2 * source_size / weight AS full_at,
        coalesce(sum(2 * source_size) OVER before, 0) AS full_sum,
        (SELECT sum(weight) FROM weighted) - coalesce(sum(weight) OVER before, 0) AS open_weight
        FROM weighted WINDOW before AS (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      level AS (SELECT (1.5 * (SELECT sum(source_size)::DOUBLE FROM totals) - full_sum) / open_weight AS level FROM filled
        WHERE (1.5 * (SELECT sum(source_size)::DOUBLE FROM totals) - full_sum) / open_weight <= full_at ORDER BY full_at LIMIT 1),
      aims AS (SELECT source, source_size, least(weight * level, (2 * source_size)::DOUBLE) AS target FROM weighted, level),
      placed AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, md5(doc_id::VARCHAR), doc_id) - 1 AS k FROM d),
      rated AS (SELECT doc_id, size, source_size, target, k, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        ('0x' || substr(md5(concat_ws(':', 'mix', '7', aims.source)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
        FROM placed JOIN aims ON placed.source IS NOT DISTINCT FROM aims.source)
    SELECT doc_id, size, source_size, target, (size * (floor(u + rate * (k + 1)) - floor(u + rate * k)))::BIGINT AS taken FROM rated""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.fingerprint_report(documents(spark, sf_dir))


@query("op10_embedding_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def crc32_sql(blob: str) -> str:
    """CRC-32 of a text or blob for DuckDB, which has none: the update of a byte is linear in its eight bits."""
    step, parts = 0xEDB88320, []
    for bit in reversed(range(8)):
        parts.append(f"((xor(c, b) >> {bit}) & 1) * {step}")
        step = step >> 1 ^ (0xEDB88320 if step & 1 else 0)
    update = "c >> 8"
    for part in parts:
        update = f"xor({update}, {part})"
    octets = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {update}), 4294967295::BIGINT)"


#: One run in so many loses a letter.
DAMAGE = 31


@query(
    "op11_spelling_variants",
    f"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
      counted AS MATERIALIZED (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
      hashed AS MATERIALIZED (SELECT *, {crc32_sql("(doc_id || ':' || run)")} AS h FROM counted),
      spelt AS (SELECT k, CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
      vocab AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
      places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab),
      cut AS MATERIALIZED (SELECT *, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
      shorter AS MATERIALIZED (SELECT DISTINCT c.word AS a, c.n AS n_a, v.word AS b, v.n AS n_b FROM cut c JOIN vocab v ON v.word = c.rest),
      near AS MATERIALIZED (SELECT x.word, y.word AS other, y.n AS other_n FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
        UNION ALL SELECT a, b, n_b FROM shorter UNION ALL SELECT b, a, n_a FROM shorter),
      first AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near),
      led AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form,
        CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n FROM vocab v LEFT JOIN (SELECT * FROM first WHERE place = 1) f ON f.word = v.word),
      walk AS (SELECT word, word AS at FROM led UNION ALL SELECT w.word, l.form FROM walk w JOIN led l ON l.word = w.at AND l.form IS NOT NULL)
    SELECT led.word, led.form, w.at AS root, led.n, led.n_near, led.form_n
    FROM led JOIN walk w ON w.word = led.word JOIN led e ON e.word = w.at AND e.form IS NULL""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(spelling_variants.vocabulary(documents(spark, sf_dir), damage=DAMAGE))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``: the text of one document in ten goes on periodically from some word on."""
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(mixing.WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string"))
    n = F.size("words")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g")).withColumn("n", n)
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.expr("slice(flatten(array_repeat(slice(words, cast(a + 1 as int), cast(p as int)), cast(ceil((n - a) / p) as int))), 1, cast(n - a as int))")
    edited = F.array_join(F.concat(F.expr("slice(words, 1, cast(a as int))"), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(documents(spark, sf_dir)))
    steeper = """(x, y) -> CASE WHEN x.length * y.period <> y.length * x.period THEN if(x.length * y.period > y.length * x.period, -1, 1)
      WHEN x.start <> y.start THEN if(x.start < y.start, -1, 1) ELSE cast(signum(x.period - y.period) as int) END"""
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    best = found.withColumn("best", F.expr(f"try_element_at(array_sort(runs, {steeper}), 1)"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.expr(listed), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _filled(capacity: str, search: str, shards: int) -> str:
    """Greedy filling: ``search`` with the prefix sums c1, c2, ... at which shards of ``capacity`` close."""
    for n in range(1, shards):
        search = f"SELECT *, (SELECT max(total) FROM sums WHERE total <= {f'c{n - 1} + ' if n > 1 else ''}{capacity}) AS c{n} FROM ({search})"
    return search


_SHARDS = sharding.SHARDS


@query(
    "op13_sharding",
    f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS mark FROM documents),
      sums AS MATERIALIZED (SELECT mark, sum(own) OVER (ORDER BY mark)::BIGINT AS total, own FROM (SELECT mark, sum(size) AS own FROM d GROUP BY mark)),
      bounds AS MATERIALIZED (SELECT max(total) AS whole, (max(total) + {_SHARDS - 1}) // {_SHARDS} AS mean, max(own)::BIGINT AS longest FROM sums),
      search AS (SELECT greatest(mean, longest) AS low, mean + longest AS high FROM bounds UNION ALL
        SELECT CASE WHEN fits THEN low ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE high END FROM (
          SELECT low, high, mid, (SELECT whole FROM bounds) - c{_SHARDS - 1} <= mid AS fits
          FROM ({_filled("mid", "SELECT low, high, (low + high) // 2 AS mid FROM search WHERE low < high", _SHARDS)}))),
      cuts AS MATERIALIZED ({_filled("low", "SELECT low FROM search WHERE low >= high", _SHARDS)}),
      placed AS (SELECT d.*, ({" + ".join(f"(total > c{n})::INT" for n in range(1, _SHARDS))})::INT AS shard FROM d JOIN sums USING (mark), cuts)
    SELECT doc_id, size, {crc32_sql("t")} AS text_crc32, 'bytes' AS law, shard,
      row_number() OVER (PARTITION BY shard ORDER BY mark, doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM placed""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
