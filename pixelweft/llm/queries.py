"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.llm import ann, bpe, conversations, decontam, lexical, license_scan, line_dedup, pii, quality, sharding, simhash, suffix_dedup, token_counts
from pixelweft.llm.common import row_key, table


def tokenizer_file(name: str) -> bytes:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document. Null and empty texts have fingerprint zero and are linked like any other."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in passages of 50 words which occur at another place too, and their stretches."""
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_repeated", F.size("spans").cast("long").alias("n_spans"), spans.alias("spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, and the places of those that an equal or similar line before them makes redundant."""
    marked = line_dedup.mark_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    places = F.array_join(F.col("removed_lines").cast("array<string>"), ",")
    return marked.select("doc_id", n_lines.alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"), places.alias("removed_lines"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for each twentieth vector, by inner product; ties to the smaller vec_id. Vectors that are null, zero or not finite take no part."""
    found = ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found.select("query_id", "rank", "vec_id", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, from its text alone. Null texts score like empty ones; documents without an id are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, machine, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes. A null text has size 1 and the checksum of nothing; repeated rows are placed each for itself."""
    placed = sharding.histogram_shards(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each whole text, as the library counts them. A null text has none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_counts.token_counts(docs, tokenizer_file("piece_bpe_32k.model"), keep=["doc_id", "n_bytes"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a benchmark window, and the items. Null texts have no words and are clean; items without words or id have no windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def bpe_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the ids and of the decoded text of each row of ``docs`` (doc_id, text). Null texts are empty."""
    spec = tokenizer_file("byte_bpe_50k.json").decode()
    encoded = bpe.encode(docs, spec, keep=["doc_id"])
    encoded = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    decoded = bpe.decode(encoded, spec, keep=["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again, by digests. Null texts are empty; repeated rows are encoded each for itself."""
    return bpe_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document: counts and digest of the patterns' spans, and all spans, the tagger's (``n_added`` of them) included. Null texts are empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs), keep=["doc_id"])
    place = lambda s: F.array_position(F.lit(list(pii.KINDS)), s["kind"])
    said = lambda spans: F.array_join(F.transform(F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], place(s).alias("k"), s["end"], s["kind"]))), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    is_a = lambda kind: lambda s: s["kind"] == kind
    n = [F.size(F.filter("base", is_a(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *n, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item. Null texts have no terms; repeated ids are documents of their own."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a fault in about a quarter of their rows, by the checksum of ``conv_id:turn`` modulo 20; nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("_x"))
    x = x.where("_x != 0").withColumns({
        "text": F.when(F.col("_x") == 1, "").when(F.col("_x") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("_x") == 4, "user").otherwise(F.col("role")),
    })
    times = F.when(F.col("_x") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return x.select("conv_id", "turn", "role", "text", F.explode(times)).drop("col")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of each damaged conversation. One row for each conv_id of the table, a missing one included; those that lost all rows have zeros."""
    rows = table(spark, sf_dir, "conversations")
    report, audits, faulty = conversations.repair_conversations(damaged(rows))
    a, b, c = rows.select("conv_id").distinct().alias("a"), report.alias("b"), conversations.digests(faulty, audits).alias("c")
    x = a.join(b.hint("merge"), F.col("a.conv_id").eqNullSafe(F.col("b.conv")), "left").join(c.hint("merge"), F.col("a.conv_id").eqNullSafe(F.col("c.conv")), "left")
    zero = [F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return x.select("a.conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_suffix_array": op2_suffix_array,
    "op3_neighbours": op3_neighbours,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_quality": op5_quality,
    "op6_sharding": op6_sharding,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_bpe": op10_bpe,
    "op11_pii": op11_pii,
    "op12_search": op12_search,
    "op13_repair": op13_repair,
}

OP9_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT item, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i, w FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM bw),
lens AS (SELECT DISTINCT n FROM windows),
dw AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
found AS (SELECT r, n, i, item FROM dw JOIN windows USING (n, win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

OP2_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (SELECT r, i, array_to_string(w[i + 1 : i + 50], ' ') AS win FROM (SELECT r, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY win) > 1),
marked AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM again),
numbered AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS island FROM marked),
spans AS (SELECT r, min(i) AS first, max(i) + 50 AS fin FROM numbered GROUP BY r, island),
found AS (SELECT r, sum(fin - first) AS n, count(*) AS k, string_agg(first || '-' || fin, ',' ORDER BY first) AS s FROM spans GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_repeated, CAST(coalesce(k, 0) AS BIGINT) AS n_spans, coalesce(s, '') AS spans
FROM d LEFT JOIN found USING (r)
"""

OP12_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
t AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
lengths AS (SELECT r, doc_id, 100 - 50 + ((50 * len(w) * n_docs) // n_terms) AS m FROM d, s WHERE len(w) > 0),
scores AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM i JOIN t USING (term) JOIN weights USING (term) JOIN lengths USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

ORACLES: dict[str, str] = {"op12_search": OP12_SQL, "op2_suffix_array": OP2_SQL, "op4_license_scan": license_scan.oracle(), "op9_decontamination": OP9_SQL}
