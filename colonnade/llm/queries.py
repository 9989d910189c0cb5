"""The registered queries of this subpackage: one per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm import chat, curriculum, decontam, html, jaccard, lm, packing, periodic, pii, search, toxicity, variants, warc
from colonnade.llm.shared import table, written

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def model_file() -> str:
    """The tokenizer of the registered queries."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), model_file())


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.detect(documents, pii.fit(documents))
    of_kind = lambda kind: F.size(F.filter(F.split("strict_spans", ","), lambda s: s.startswith(f"{kind}:"))).cast("long")
    return found.select(
        "doc_id",
        *(of_kind(kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2("strict_spans", 256).alias("base_sha256"),
        F.col("all_spans").alias("spans"),
    )


def op4_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents")).drop("set_class")


OP4_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM texts
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Write the archives, index them, look every page's address up, and read the records."""
    pages = table(spark, folder, "pages")
    archive = warc.index(spark, warc.write(pages))
    captures = warc.lookup(archive, pages.select("url"))
    return warc.fetch(archive, captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), coded AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest
  FROM hashed
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM coded
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM firsts
"""


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, folder, "labels"))
    held_out = ~toxicity.training_fold(F.col("doc_id"))
    return toxicity.score(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_lm(spark: SparkSession, folder: str) -> DataFrame:
    training = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    return lm.score(table(spark, folder, "documents"), training, F.col("lang"))


def op9_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract_pages(table(spark, folder, "pages"))


def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP7_SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM clean q JOIN clean c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored
)
SELECT query_id, n::INT AS rank, vec_id, score FROM ranked WHERE n <= 5
"""

#: A conversation whose texts look like marks of a template.
PROBE = "\\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string"
    )
    formatted = chat.format_turns(turns.unionByName(probe))
    return chat.read_back(formatted).drop("attachment_tokens")


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn:' || role || '>' || regexp_replace(text, '([\\<>])', '\\\1', 'g') || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op11_curriculum(spark: SparkSession, folder: str) -> DataFrame:
    """All documents by the training position of their first copy, those that the mix does not take last."""
    documents = written(curriculum.sized(table(spark, folder, "documents").select("doc_id", "source", "text")).drop("text"), "mix-sizes")
    assigned = curriculum.assign(documents, curriculum.ranked_schedules(documents, (1, 2, 3)))
    first = F.get("copies", F.lit(0))["position"].alias("first_position")
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"]).alias("taken")
    made = assigned.select("doc_id", "size", "source_size", "target", taken, F.size("copies").alias("n_copies"), first, "__key")
    return made.orderBy(F.col("first_position").asc_nulls_last(), "__key").drop("__key")


OP11_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank,
    (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight
  FROM sized GROUP BY source
), queued AS (
  SELECT *, 3.0::DOUBLE * source_size AS bound, sum(source_size) OVER ()::DOUBLE AS total,
    sum(3.0::DOUBLE * source_size) OVER before AS passed, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest
  FROM sources
  WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
  SELECT *, bound * rest <= weight * (total - coalesce(passed, 0)) AS full_ FROM queued
), aimed AS (
  SELECT *, CASE WHEN full_ THEN bound ELSE weight * (total - coalesce(sum(bound) FILTER (full_) OVER (), 0))
    / sum(weight) FILTER (NOT full_) OVER () END AS target
  FROM judged
), streamed AS (
  SELECT s.*, a.source_size, a.weight, a.target, a.rank,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
), counted AS (
  SELECT *, list_transform([0, 1, 2], lambda e: greatest(0, least(size, floor(target)::BIGINT - (e * source_size + start)))) AS parts
  FROM streamed
), placed AS (
  SELECT *, list_position(list_transform(parts, lambda n: n > 0), true) AS nth, CASE WHEN target > 0 THEN start * weight / target END AS demand
  FROM counted
)
SELECT doc_id, size, source_size, target, list_sum(parts)::BIGINT AS taken, len(list_filter(parts, lambda n: n > 0))::INT AS n_copies,
  CASE WHEN nth IS NULL THEN NULL
    WHEN rank % 2 = 1 AND demand < 0.25 * weight THEN 2.0 * demand / (0.5 * weight + sqrt(0.25 * weight * weight))
    WHEN rank % 2 = 1 THEN 0.5 + 2.0 * (demand - 0.25 * weight) / (0.5 * weight + sqrt(0.25 * weight * weight + 8.0 * weight * (demand - 0.25 * weight)))
    WHEN demand < 0.75 * weight THEN 2.0 * demand / (2.5 * weight + sqrt(6.25 * weight * weight - 8.0 * weight * demand))
    ELSE 0.5 + 2.0 * (demand - 0.75 * weight) / (0.5 * weight + sqrt(0.25 * weight * weight)) END AS first_position
FROM placed
"""


def with_planted_periods(documents: DataFrame) -> DataFrame:
    """The documents of the query: in about every tenth, by its id, the end of the text repeats a stretch of words."""
    hashed = F.crc32(F.col("doc_id").cast("string"))
    own = documents.withColumns({"__h": hashed, "__words": F.when(hashed % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))})
    g, n = F.floor(F.col("__h") / 10), F.size("__words").cast("long")
    begin = F.pmod(g, n)
    period = F.lit(1) + F.floor((n - begin) / (g % 8 + 3))
    shaped = own.withColumns({"__a": F.when(F.size("__words") > 0, begin)}).withColumns({"__p": F.when(F.col("__a").isNotNull(), period)})
    a, p = F.col("__a").cast("int"), F.col("__p").cast("int")
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    again = F.transform(F.sequence(F.lit(0), F.size("__words") - 1), lambda i: F.get("__words", place(i)))
    return shaped.select("doc_id", F.when(F.col("__a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.find(with_planted_periods(table(spark, folder, "documents").select("doc_id", "text")))
    # The longest run; of equally long ones the first, then that with the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )



def with_planted_slips(occurrences: DataFrame) -> DataFrame:
    """The words of the query: of about every 31st, by its document and spelling, one letter is left out."""
    hashed = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("word")))
    at = (hashed % F.length("word")).cast("int")
    slip = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    slips = F.col("doc_id").isNotNull() & (hashed % 31 == 0)
    return occurrences.select(F.when(slips, slip).otherwise(F.col("word")).alias("word"))


def op13_variants(spark: SparkSession, folder: str) -> DataFrame:
    occurrences = variants.words(table(spark, folder, "documents"))
    vocabulary = written(variants.vocabulary(with_planted_slips(occurrences)), "vocabulary")
    return variants.group(vocabulary).select("word", "form", "root", "n", "n_near", "form_n")


_QUERIES: dict[str, Query] = {"op1_decontaminate": op1_decontaminate, "op2_packing": op2_packing, "op3_pii": op3_pii, "op4_jaccard": op4_jaccard, "op5_warc": op5_warc, "op6_toxicity": op6_toxicity, "op7_topk": op7_topk, "op8_lm": op8_lm, "op9_html": op9_html, "op10_chat": op10_chat, "op11_curriculum": op11_curriculum, "op12_periodic": op12_periodic, "op13_variants": op13_variants}
_SQL = {"op4_jaccard": OP4_SQL, "op5_warc": OP5_SQL, "op7_topk": OP7_SQL, "op10_chat": OP10_SQL, "op11_curriculum": OP11_SQL}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
