"""The registered queries of this subpackage, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import (
    embedding_dedup,
    hard_negatives,
    html_extract,
    license_scan,
    line_dedup,
    minhash_dedup,
    packing,
    periodic_runs,
    quality_rules,
    secret_scan,
    source_mixing,
    url_filters,
    warc,
)
from spanloom.llm.common import ready, table
from spanloom.llm.sql import SQL


#: Rules of the url query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(ready(spark), sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(pages, rules)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(ready(spark), sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    return minhash_dedup.near_duplicates(docs, width=4, percent=80)


#: Shares of tokens that a mixture should hold.
TARGETS = {"clean": 0.96, "junk": 0.02, "toxic": 0.02}


def domain_labels(labels: DataFrame) -> DataFrame:
    """The labelled table's two marks as one domain per document."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    return source_mixing.document_rates(docs, domain_labels(labels), TARGETS)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(ready(spark), sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """Where the files of the public tokenizers lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=2048)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(ready(spark), sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    return line_dedup.line_digest(docs, min_docs=10, min_chars=1)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(ready(spark), sf_dir, "embeddings"), least=0.95)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(ready(spark), sf_dir, "pages"), min_bytes=0)
    records = warc.read_records(index, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The characters that words are made of, and what parts of the texts the run query makes periodic.
WORDS = r"[^\x20\x09-\x0D]+"


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` with one text in ten, chosen by the checksum of its id, periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("words"), g.alias("g"))
    rows = rows.withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    source = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.col("a") + (i - F.col("a")) % F.col("p"))
    rows = rows.withColumn("source", F.when(F.col("n") > 0, source))
    again = F.transform("source", lambda i: F.get("words", i.cast("int")))
    told = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), again), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, told).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_periods(table(ready(spark), sf_dir, "documents"))
    runs = periodic_runs.find_runs(docs, min_words=12)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return runs.select(
        "doc_id", "n_words", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("longest"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_words", "n_runs", (-F.col("longest.start")).alias("start"), "longest.length", (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(ready(spark), sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(ready(spark), sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
