"""The registered queries: each applies its operator to a whole table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import codes, fingerprint, jaccard, licenses, lines, mixing, periods, pieces, quality, secrets, shards, simhash, urls
from lodestone.llm.text import BLANKS, indices, let, words


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def op1_license_scan(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_url_filter(spark: SparkSession, root: str) -> DataFrame:
    pages = _table(spark, root, "pages").select("page_id", "url")
    return urls.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op3_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents").select("doc_id", "text", "lang")
    return quality.apply_rules(docs, carry=["doc_id"])


def op4_mixing(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents").select("doc_id", "text")
    mixed = mixing.mix(docs, _table(spark, root, "labels"), carry=["doc_id"])
    shares = [F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)]
    return mixed.select("doc_id", "n_tokens", *shares, "rate", "copies")


def op5_sentencepiece(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents").select("doc_id", "text")
    encoded = pieces.encode_texts(docs, pieces.read_model(pieces.public_model()))
    return encoded.select("doc_id", "ids", "n_ids", "round_trip")


def op6_shards(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    placed = shards.shard(docs, 8, payload=["doc_id"], extra={"text_crc32": crc})
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, root, "documents").select("doc_id", "text"))


def op8_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents").select("doc_id", "text")
    found = F.col("found")
    base = F.filter(found, lambda x: x["kind"].isin([r.kind for r in secrets.BASE_RULES]))
    of = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
    return secrets.scan_secrets(docs).select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(found).alias("spans"),
    )


def op9_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents").select("doc_id", "text")
    return fingerprint.neighbour_fingerprints(docs)


def op10_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "text", "n_removed")


def op11_simhash(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents").select("doc_id", "text")
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return simhash.near_duplicates(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


def op12_vector_codes(spark: SparkSession, root: str) -> DataFrame:
    coded, books = codes.compress(_table(spark, root, "embeddings").select("vec_id", "embedding", "label"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _with_repeats(doc_id: Column, text: Column) -> Column:
    """The words of a text, joined by spaces; every tenth document, by the checksum of its id, gets a periodic end."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        source = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.when(n > 0, F.array_join(F.transform(indices(n), lambda i: F.get(w, source(i))), " ")).otherwise(F.lit(""))

    return F.when(h % 10 == 0, let(words(text, BLANKS), repeated)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents").select("doc_id", _with_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    runs = F.col("runs")
    better = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    top = F.aggregate(runs, F.get(runs, F.lit(0)), better)
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, F.lit("\n")).otherwise(F.lit("")))
    found = periods.find_runs(docs, carry=["doc_id"]).withColumn("top", top)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_url_filter,
        op3_quality_rules,
        op4_mixing,
        op5_sentencepiece,
        op6_shards,
        op7_jaccard_join,
        op8_secret_scan,
        op9_fingerprints,
        op10_line_dedup,
        op11_simhash,
        op12_vector_codes,
        op13_periodic_runs,
    )
}


def _url_sql() -> str:
    """DuckDB SQL of ``op2_url_filter``: every rule against every url, the most host labels and then the longest path first."""
    rules = ", ".join("('{}', '{}', '/{}')".format(verdict, *rule.split("/", 1)) for verdict, rule in urls.RULES)
    unwanted = ", ".join(f"'{w}'" for w in urls.UNWANTED)
    return f"""WITH u AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES {rules}) t(verdict, h, start)),
b AS (SELECT k, h || start AS rule, verdict FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) QUALIFY row_number() OVER (PARTITION BY k ORDER BY len(string_split(h, '.')) DESC, len(start) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), [{unwanted}]) THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN b USING (k)"""


def _codes_sql() -> str:
    """DuckDB SQL of ``op12_vector_codes``: every distance of every round."""
    apart = "list_sum(list_transform(list_zip(p.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    near = lambda k: f"a{k} AS MATERIALIZED (SELECT vec_id, part, min(d * 256 + e) % 256 AS e, min(d * 256 + e) // 256 AS d FROM (SELECT p.vec_id, p.part, b.e, coalesce({apart}, 0) AS d FROM p JOIN b{k} b USING (part)) GROUP BY ALL)"
    means = lambda k: f"""m{k} AS (SELECT part, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS x FROM (SELECT part, e, j, sum(p.x[j]) AS s, count(*) AS n FROM a{k} JOIN p USING (vec_id, part), range(1, len(p.x) + 1) r(j) GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(m{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN m{k} USING (part, e))"""  # noqa: E731
    rounds = ",\n".join(f"{near(k)},\n{means(k)}" for k in range(codes.ROUNDS))
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {codes.PARTS}) + 1 : (part + 1) * (len(v) // {codes.PARTS})] AS x FROM k, range({codes.PARTS}) r(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM p QUALIFY e < {codes.ENTRIES}),
{rounds},
{near(codes.ROUNDS)},
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{codes.ROUNDS}),
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{codes.ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), s"""


#: The other queries rest on hashes, trained weights, searches and divergences; tests hold them against brute force.
ORACLES: dict[str, str] = {"op2_url_filter": _url_sql(), "op12_vector_codes": _codes_sql()}
