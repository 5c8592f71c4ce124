"""The registered queries of the text operators, with DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, exact, html_text, imatch, language, lines, merkle, packing, pieces, simhash, token_counts, urls
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_duplicates(read_table(spark, folder, "documents"), bits=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = language.fit(docs.where(~language.held_out()))
    out = language.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op6_piece_encoding")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    coded = pieces.encode(read_table(spark, folder, "documents").select("doc_id", "text"), path="piece_bpe_32k.model", decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"), width=1024, end=0)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_OP7 = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT h.*, r_host || r_path AS rule, r_verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST) AS k
      FROM h LEFT JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


@query("op7_url_rules", _OP7)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(read_table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


_OP10 = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)
"""


@query("op10_exact_dedup", _OP10)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return exact.duplicates(read_table(spark, folder, "documents"))


@query("op8_imatch_fingerprints")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    rows = imatch.fingerprints(read_table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        imatch.as_hex(F.col("own")).alias("fingerprint"), imatch.as_hex(F.col("changed")).alias("edited_fingerprint"),
        imatch.likeness(F.col("own"), F.col("changed")).alias("near_edited"), imatch.likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


@query("op4_line_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines.dedup_lines(read_table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "text", "n_lines", "n_kept")


@query("op3_html_main_text")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(read_table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op5_edited_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text").withColumn("edits", token_counts.sample_edits())
    return token_counts.count_edited(docs).drop("text", "edits")


_OP13 = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, replace(text, chr(10), '') AS cut,
         list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                     lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END)) & 1 AS last_bit
  FROM documents),
f AS (SELECT doc_id, source, last_bit,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(cut) || ':' || cut, '-') AS cut FROM d),
leaf AS (SELECT doc_id, source, sha256(head || body) AS h, sha256(head || CASE WHEN last_bit = 1 THEN cut ELSE body END) AS fake,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM f),
tree AS (SELECT source, 0 AS l, p, h, n FROM leaf UNION ALL
  SELECT source, l + 1, p // 3, sha256(string_agg(h, '' ORDER BY p)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, l, p // 3, n),
subs AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS l, p, subroot AS h, n FROM subs UNION ALL
  SELECT l + 1, p // 3, sha256(string_agg(h, '' ORDER BY p)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY l, p // 3, n),
nodes AS (SELECT coalesce('s' || source, '-') AS t, l, p, h FROM tree WHERE n > 1 UNION ALL SELECT '', l, p, h FROM top WHERE n > 1),
fam AS (SELECT t, l, p // 3 AS q, max(CASE WHEN p % 3 = 0 THEN h END) AS a, max(CASE WHEN p % 3 = 1 THEN h END) AS b, max(CASE WHEN p % 3 = 2 THEN h END) AS c FROM nodes GROUP BY ALL),
side AS (SELECT t, l, p, CASE p % 3 WHEN 0 THEN '' WHEN 1 THEN a ELSE a || b END AS low,
    CASE p % 3 WHEN 0 THEN coalesce(b, '') || coalesce(c, '') WHEN 1 THEN coalesce(c, '') ELSE '' END AS high
  FROM nodes JOIN fam USING (t, l) WHERE fam.q = nodes.p // 3),
up AS (SELECT doc_id, source, coalesce('s' || source, '-') AS t, 0 AS l, p, fake AS h, '' AS proof FROM leaf UNION ALL
  SELECT up.doc_id, up.source, CASE WHEN s.t IS NULL THEN '' ELSE up.t END, CASE WHEN s.t IS NULL THEN 0 ELSE up.l + 1 END,
         CASE WHEN s.t IS NULL THEN subs.p ELSE up.p // 3 END, CASE WHEN s.t IS NULL THEN up.h ELSE sha256(s.low || up.h || s.high) END, up.proof || coalesce(s.low || s.high, '')
  FROM up LEFT JOIN side s ON s.t = up.t AND s.l = up.l AND s.p = up.p JOIN subs ON subs.source IS NOT DISTINCT FROM up.source WHERE s.t IS NOT NULL OR up.t <> ''),
ends AS (SELECT doc_id, source, h, proof, row_number() OVER (PARTITION BY doc_id ORDER BY l DESC) AS k FROM up WHERE t = '')
SELECT leaf.doc_id, leaf.h AS leaf, subs.subroot, root.h AS root, sha256(ends.proof) AS proof_sha256, ends.h AS folded_root, ends.h = root.h AS verified
FROM leaf JOIN ends ON ends.doc_id = leaf.doc_id AND ends.k = 1 JOIN subs ON subs.source IS NOT DISTINCT FROM leaf.source CROSS JOIN (SELECT h FROM top WHERE n = 1) root
"""


@query("op13_merkle_manifest", _OP13)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle.manifest(docs, tampered={"text": text})
    rows = rows.withColumn("folded_root", merkle.folded("fake"))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: A conversation whose texts look like the marks and escapes of other chat templates.
_OP11_EXTRA = [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


@query("op11_chat_formatting")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(_OP11_EXTRA, "conv_id long, turn long, role string, text string"))
    out = chat.read_back(chat.format_conversations(rows))
    return out.select(F.col("id").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return align.align_documents(read_table(spark, folder, "documents").select("doc_id", "text"))
