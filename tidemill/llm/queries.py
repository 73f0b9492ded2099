"""One query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, licenses, lm, pieces, setsketch, simhash, toxicity, urls, warc

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_HOST = "translate(regexp_extract(u, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule_sql(k: int) -> str:
    ordered = sorted(urls.RULES, key=lambda r: (-len(r[1]), r[1]))
    one = lambda r: f"WHEN (host = '{r[1].partition('/')[0]}' OR ends_with(host, '.{r[1].partition('/')[0]}')) AND starts_with(path, '/{r[1].partition('/')[2]}') THEN '{r[k]}'"
    return "CASE " + " ".join(map(one, ordered)) + " END"


def blocklist(pages: DataFrame) -> DataFrame:
    """The tables hold no list of URLs, so the query lists those canonical ones of the web whose SHA-256 begins with 0."""
    return pages.select(urls.canonical(F.col("url")).alias("url")).where(F.sha2("url", 256).startswith("0"))


@query(f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS u FROM pages),
  h AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(u, '^[^/?#]*([^?#]*)', 1), '') AS path,
    array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(u, '^[^?#]*[?]([^#]*)', 1), ''), '&'), lambda p: NOT regexp_matches(p, '^(utm_[^=]*|ref)?(=|$)'))), '&') AS q FROM r),
  c AS (SELECT *, CASE WHEN regexp_replace(host, '^www[.]', '') <> '' THEN regexp_replace(host, '^www[.]', '') || regexp_replace(path, '/$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canon FROM h)
  SELECT page_id, host, path, {_rule_sql(1)} AS rule, coalesce({_rule_sql(0)}, CASE WHEN starts_with(sha256(canon), '0') THEN 'block' ELSE 'allow' END) AS verdict,
    coalesce(starts_with(sha256(canon), '0'), false) AS listed FROM c""")
def op3_url_filter(spark, sf):
    pages = table(spark, sf, "pages")
    return urls.judge(pages, blocklist(pages))


@query()
def op4_license_scan(spark, sf):
    return licenses.scan_documents(table(spark, sf, "documents"))


@query()
def op8_document_fingerprints(spark, sf):
    """Neighbours are looked for from every row whose id is divisible by 20, among all rows."""
    return simhash.fingerprint_documents(table(spark, sf, "documents"), 3, F.col("doc_id") % 20 == 0)


@query("""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
  d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
  m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to FROM m""")
def op9_warc_archives(spark, sf):
    return warc.archive_pages(table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# The one tool of the query's calls.
REPLY = {"reply": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 2000}, "turn": {"type": "integer", "minimum": 0}}}}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """The conversations hold no tool calls, so each assistant's turn becomes a call of `reply`, and the user's turn after it its result.

    A call at a turn divisible by four depends on the call two turns later, so it has to move behind that.
    """
    c = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    name = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    args = F.struct("text", "turn")
    on = F.when(F.col("turn") % 4 == 0, F.array(name(F.col("turn") + 2))).otherwise(F.array().cast("array<string>"))
    call = F.to_json(F.struct(F.array(F.struct(name(F.col("turn")).alias("id"), F.lit("reply").alias("name"), args.alias("arguments"), on.alias("depends_on"))).alias("tool_calls")))
    result = F.to_json(F.struct(name(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    user = (F.col("role") == "user") & (F.col("turn") > 0)
    return c.select("conv_id", "turn", F.when(user, "tool").otherwise(F.col("role")).alias("role"), F.when(F.col("role") == "assistant", call).when(user, result).otherwise(F.col("text")).alias("text"))


@query()
def op6_tool_call_linking(spark, sf):
    return chat.link(tool_messages(table(spark, sf, "conversations")), REPLY)


@query()
def op1_decontamination(spark, sf):
    return decontaminate.judge(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op7_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    return toxicity.score_documents(docs, toxicity.model_for(docs, table(spark, sf, "labels")))


@query()
def op5_sentencepiece(spark, sf):
    return pieces.digest_documents(table(spark, sf, "documents"), pieces.load())


@query()
def op10_minhash_near_dedup(spark, sf):
    return setsketch.group_documents(table(spark, sf, "documents"), 85)


@query()
def op2_lm_scoring(spark, sf):
    return lm.score_documents(table(spark, sf, "documents"))
