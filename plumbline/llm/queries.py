"""The operators of this subpackage as queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import alignment, bpe, conversations, decontaminate, language, licenses, near_documents, personal_data, quality, suffixes, toxicity, vectors, warc
from plumbline.llm.common import Scratch, crc32_mod, table, written


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return cleaned.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # What is left, to be read; a cut may go through a character.
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc32_mod(F.col("doc_id"), 5) == 0)
    model = language.learn(docs.where("not held_out").select("text", "lang"))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", crc32_mod(F.col("doc_id"), 3) == 1)
    model = quality.learn(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "held_out", "text"), model).drop("text")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data.find(docs, personal_data.learn(docs))
    named = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*personal_data.BASE))
    return found.select(
        "doc_id",
        *[count(kind) for kind in personal_data.BASE],
        F.sha2(named(base), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
    )


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents.near_documents(table(spark, sf_dir, "documents"), shingle=4)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, bpe.public_vocabulary())
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.record_table(warc.read_chunks(files))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark)
    found = alignment.align(docs, *alignment.public_vocabularies(), scratch)
    rows = found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"),
    )
    result = written(rows, "aligned")
    scratch.remove()
    return result


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", crc32_mod(F.col("doc_id"), 5) == 0)
    scratch = Scratch(spark)
    model = toxicity.learn(docs.where("not held_out"), table(spark, sf_dir, "labels"), docs, scratch)
    scratch.remove()
    found = toxicity.passages(docs, model).select("doc_id", "held_out", "score", F.size("passages").alias("n_passages"))
    return found.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    scratch = Scratch(spark)
    found = conversations.repair(conversations.damaged(source), scratch)
    digest = conversations.digests(found.turns).select(F.col("conv_id").alias("_digest_id"), "sha256")
    repaired = found.conversations.join(digest, F.col("conv_id").eqNullSafe(F.col("_digest_id")), "left").withColumnRenamed("conv_id", "_id")
    ids = source.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    rows = ids.join(repaired, ids["conv_id"].eqNullSafe(F.col("_id")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
    result = written(rows, "repaired")
    scratch.remove()
    return result


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_licenses": op2_licenses,
    "op3_decontaminate": op3_decontaminate,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_personal_data": op6_personal_data,
    "op7_near_vectors": op7_near_vectors,
    "op8_near_documents": op8_near_documents,
    "op9_bpe": op9_bpe,
    "op10_warc": op10_warc,
    "op11_alignment": op11_alignment,
    "op12_toxicity": op12_toxicity,
    "op13_conversations": op13_conversations,
}

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
    "lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)
_KEYED = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"


def _then(state: str, cost: str, edit: str, when: str = "true") -> str:
    """A state of the repair after an edit; without a way it costs a billion."""
    return f"CASE WHEN {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}} ELSE {{'c': 1000000000, 'a': ''}} END"


def _cheapest(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _inserted(s: str) -> tuple[str, ...]:
    return (
        f"{s}0", f"{s}1",
        _cheapest(f"{s}2", *[_then(f"{s}{p}", "3", "I") for p in (0, 1, 3)]),
        _cheapest(f"{s}3", _then(f"{s}2", "3", "I"), *[_then(f"{s}{p}", "6", "II") for p in (0, 1)]),
    )


def _written_by(state: str, who: str) -> list[str]:
    return [_then(state, "late", "K", f"alive AND who = '{who}'"), _then(state, "3 + late", "R", "alive")]


_NOTHING = "{'c': 1000000000, 'a': ''}"
_REPAIR = f"""
        WITH RECURSIVE d AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(_KEYED)} % 20 AS k FROM conversations
        ), c AS (
            SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM d WHERE k <> 0
        ), n AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, left(role, 1) AS who,
                rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
            FROM c
        ), f AS (
            SELECT *, CASE WHEN t = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
                lag(who) OVER (PARTITION BY conv_id ORDER BY i) || who AS pair
            FROM n
        ), g AS (
            SELECT *, fault NOT IN ('b', 'd') AS alive, CASE fault WHEN 't' THEN 3 ELSE 0 END AS late FROM f
        ), r AS (
            SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': ''}} AS s0, {_NOTHING} AS s1, {_NOTHING} AS s2, {_NOTHING} AS s3
            FROM (SELECT DISTINCT conv_id FROM g)
            UNION ALL
            SELECT conv_id, i, {_then("i0", "4", "D")}, {_cheapest(_then("i1", "4", "D"), _then("i0", "late", "K", "alive AND who = 's'"))},
                {_cheapest(_then("i2", "4", "D"), *[w for p in (0, 1, 3) for w in _written_by(f"i{p}", "u")])},
                {_cheapest(_then("i3", "4", "D"), *_written_by("i2", "a"))}
            FROM (
                SELECT g.conv_id, g.i, g.who, g.alive, g.late, {", ".join(f"{x} AS i{p}" for p, x in enumerate(_inserted("r.s")))}
                FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i + 1
            )
        ), e AS (
            SELECT conv_id, {_cheapest("i0", "i3")} AS best
            FROM (SELECT conv_id, {", ".join(f"{x} AS i{p}" for p, x in enumerate(_inserted("s")))}
                FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)
        ), p AS (
            SELECT conv_id, p, x, count(*) FILTER (x <> 'I') OVER w AS i, count(*) FILTER (x <> 'D') OVER w AS o
            FROM (SELECT conv_id, unnest(string_split(best.a, '')) AS x, unnest(range(1, len(best.a) + 1)) AS p FROM e WHERE best.a <> '')
            WINDOW w AS (PARTITION BY conv_id ORDER BY p)
        ), q AS (
            SELECT p.conv_id, p.p, p.x, o, CASE WHEN x = 'I' THEN '' ELSE g.text END AS text, g.role, g.who,
                bool_or(x = 'K' AND o = 1 AND g.who = 's') OVER (PARTITION BY p.conv_id) AS system
            FROM p LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.i = p.i
        ), h AS (
            SELECT conv_id, sha256(string_agg(
                CASE WHEN x = 'K' THEN role WHEN (o - system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
                chr(10) ORDER BY p)) AS repaired_sha256
            FROM q WHERE x <> 'D' GROUP BY conv_id
        ), s AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                count(*) FILTER (i > 1 AND coalesce(pair, '') NOT IN ('su', 'ua', 'au')) AS illegal
            FROM g GROUP BY conv_id
        )
        SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
            coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
            coalesce(best.a, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a
        LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
        LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
        LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM a.conv_id
    """

ORACLES: dict[str, str] = {
    "op13_conversations": _REPAIR,
    "op3_decontaminate": f"""
        WITH d AS (
            SELECT doc_id, {_WORDS} AS w FROM documents
        ), i AS (
            SELECT item_id::VARCHAR AS item, w, least(13, len(w)) AS n
            FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
        ), iw AS (
            SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS t
            FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i)
        ), lengths AS (
            SELECT DISTINCT n FROM iw
        ), dw AS (
            SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths)
        ), hits AS (
            SELECT doc_id, n, s, item FROM dw JOIN iw USING (n, t)
        ), covered AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, n, s FROM hits)) GROUP BY 1
        ), named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
            coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), d AS (
            SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p
        ), m AS (
            SELECT *, CASE WHEN payload_bytes >= 1000
                THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS original
            FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
        FROM m
    """,
}
