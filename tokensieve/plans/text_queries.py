"""Queries over tokenizer expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokensieve.functions import text as T
from tokensieve.plans.base import WS, read, tokens_sql
from tokensieve.sources.mail import address_tokens


def _docs(s, d):
    return read(s, d, "documents")


def _exploded(df, key, tokens):
    return df.select(key, F.posexplode(tokens).alias("pos", "token"))


def tok_words(s, d):
    return _exploded(_docs(s, d), "doc_id", T.words(F.col("text")))


def body_tokens(s, d):
    return _exploded(_docs(s, d), "doc_id", T.body_tokens(F.col("text")))


def tok_long_words(s, d):
    w = _docs(s, d).select("doc_id", F.explode(T.raw_words(F.lower("text"))).alias("w")).where(F.length("w") > 12)
    return w.select(F.explode(T.word_tokens(F.col("w"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def tok_short_runs(s, d):
    return _docs(s, d).select("doc_id", T.short_run(F.col("text")).alias("run"), T.short_run_token(F.col("text")).alias("token"))


def html_strip(s, d):
    return read(s, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


def html_summary(s, d):
    t = F.array_join(T.raw_words(T.strip_html(F.col("html"))), " ")
    return read(s, d, "pages").select("page_id", F.substring(t, 1, 200).alias("summary"))


def virus_clues(s, d):
    return read(s, d, "pages").select("page_id", F.explode(T.virus_clues(F.col("html"))).alias("token")).groupBy("page_id", "token").agg(F.count("*").alias("n"))


def url_tokens(s, d):
    return _exploded(read(s, d, "pages"), "page_id", T.url_tokens(F.col("url")))


def url_structure(s, d):
    k = F.col("c_custkey")
    url = F.concat(
        F.when(k % 3 == 0, F.lit("https://")).otherwise(F.lit("http://")), F.when(k % 4 == 1, F.lit("me@")).otherwise(F.lit("")),
        F.when(k % 5 == 2, F.concat_ws(".", *[(k % m).cast("string") for m in (251, 13, 7, 199)])).otherwise(F.lit("shop.example.com")),
        F.when(k % 6 == 0, F.concat(F.lit(":"), (k % 9000).cast("string"))).otherwise(F.lit("")), F.lit("/a"), F.repeat(F.lit("%41"), (k % 4).cast("int")),
    )
    return _exploded(read(s, d, "customer").select("c_custkey", url.alias("u")), "c_custkey", T.url_structure(F.col("u")))


def filename_tokens(s, d):
    return _exploded(read(s, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("f")), "page_id", T.filename_tokens(F.col("f")))


def _subject(c):
    return F.regexp_replace(c, "\n", " ")


def subject_tokens(s, d):
    return _exploded(_docs(s, d).select("doc_id", _subject("text").alias("x")), "doc_id", T.subject_tokens(F.col("x")))


def _nation_mail():
    return F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@nation"), F.col("c_nationkey").cast("string"), F.lit(".example.com"))


def address_tokens_(s, d):
    rows = read(s, d, "customer").select("c_custkey", F.concat(F.lit('"'), F.col("c_name"), F.lit('" <'), _nation_mail(), F.lit(">")).alias("x"))
    return address_tokens(rows, "c_custkey", "from", "x")


def recipient_buckets(s, d):
    rows = read(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))), ",").alias("h"))
    return rows.select("o_custkey", T.recipient_bucket("to", F.col("h")).alias("token"))


def x_mailer(s, d):
    return read(s, d, "part").select("p_partkey", T.x_mailer(F.concat("p_name", F.lit("  \t"), "p_brand", F.lit(" "), "p_type")).alias("token"))


def received_tokens(s, d):
    c = read(s, d, "customer")
    k = F.col("c_custkey")
    host = F.concat(F.lit("from mx"), k.cast("string"), F.lit(".Nation"), F.col("c_nationkey").cast("string"), F.lit(".example.com (helo ok) ["), (k % 256).cast("string"), F.lit("."), (k % 7).cast("string"), F.lit(".2.1] by relay"))
    return _exploded(c.select("c_custkey", host.alias("h")), "c_custkey", T.received_tokens(F.col("h")))


def message_id_token(s, d):
    c = read(s, d, "customer")
    h = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("no id "), F.col("c_name"))).otherwise(F.concat(F.lit(" <"), F.col("c_custkey").cast("string"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.org> ")))
    return c.select("c_custkey", T.message_id_token(h).alias("token"))


def dotted_quads(s, d):
    c = read(s, d, "customer")
    k = F.col("c_custkey")
    ip = F.concat_ws(".", *[(k % m).cast("string") for m in (251, 13, 7, 199)])
    return _exploded(c.select("c_custkey", ip.alias("ip")), "c_custkey", T.dotted_prefixes(F.col("ip")))


def bigram_stream(s, d):
    return _exploded(_docs(s, d), "doc_id", T.bigrams(T.words(F.col("text"))))


def base_url(s, d):
    return read(s, d, "pages").select("page_id", T.base_url(F.regexp_replace("url", "^[a-z]+://", "")).alias("base"))


def clean_body(s, d):
    return read(s, d, "pages").select("page_id", F.md5(T.clean_body(F.col("html")).cast("binary")).alias("digest"))


def non_ascii(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.non_ascii(F.col("text")).cast("binary")).alias("digest"))


def numeric_entities(s, d):
    t = F.concat(F.lit("&#72;&#105; "), F.col("c_name"), F.lit(" &#"), (F.col("c_custkey") % 500 + 33).cast("string"), F.lit("; &#99999999;"))
    return read(s, d, "customer").select("c_custkey", T.numeric_entities(t).alias("text"))


def header_block(s, d):
    c = read(s, d, "customer")
    raw = F.concat(F.lit("From: "), "c_name", F.lit("\nSubject: x\n"), F.when(F.col("c_custkey") % 2 == 0, F.lit("\nbody: here\n")).otherwise(""))
    return c.select("c_custkey", T.header_block(F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(raw)).alias("headers"))


def _e(table, key, arr, frm=None):
    return f"SELECT {key}, pos - 1 AS pos, token FROM (SELECT {key}, unnest(a) AS token, generate_subscripts(a, 1) AS pos FROM (SELECT {key}, {arr} AS a FROM {frm or table}))"


_words = f"list_filter(string_split_regex(lower(text), '{WS}'), lambda w: length(w) BETWEEN 3 AND 12)"
_strip = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(html), '(?s)<\s*style\b[^>]*>.*?</style>', '', 'g'), "
    r"'(?s)<!--.*?-->|<\s*comment\s*>.*?</comment>', '', 'g'), '(?s)<\s*noframes\s*>.*?</noframes\s*>', '', 'g'), '&nbsp;|<(?:p|br)>', ' ', 'g'), '<[^\s<>][^>]{0,255}>', '', 'g')"
)
_URLSEP = r"[;?:@&=+,$.]"
_chunks = lambda x: f"list_transform(flatten(list_transform(string_split(regexp_replace({x}, '[.:?!/]+$', ''), '/'), lambda p: string_split_regex(p, '{_URLSEP}'))), lambda c: 'url:' || c)"
_clean = (
    r"regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(lower(regexp_replace({x}, '<[^>]*>', '', 'g')), '[0-9]+', '#', 'g'), '(&nbsp;)+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\n+', chr(10), 'g'), '[ \t]+', ' ', 'g')"
)


def clean_sql(x: str) -> str:
    t = _clean.replace("{x}", x)
    return f"array_to_string(list_filter(string_split({t}, ' '), lambda w: NOT (contains(w, '@') OR starts_with(w, 'ftp:') OR starts_with(w, 'mailto:') OR starts_with(w, 'http:') OR starts_with(w, 'gopher:') OR w = 'pmguid:')), ' ')"


_name = "regexp_replace(url, '^[a-z]+://', '')"
_short = f"list_reduce(list_prepend('0|0', list_filter(string_split_regex(text, '{WS}'), lambda w: length(w) > 0)), lambda a, w: CASE WHEN length(w) < 3 THEN (string_split(a, '|')[1]::INT + 1)::VARCHAR || '|' || string_split(a, '|')[2] ELSE '0|' || greatest(string_split(a, '|')[2]::INT, string_split(a, '|')[1]::INT)::VARCHAR END)"

QUERIES = {
    "tok_words": (tok_words, _e("documents", "doc_id", _words)),
    "body_tokens": (body_tokens, _e("documents", "doc_id", tokens_sql("text"))),
    "tok_long_words": (tok_long_words, f"SELECT token, count(*) AS n FROM (SELECT unnest({tokens_sql('w')}) AS token FROM (SELECT unnest(string_split_regex(lower(text), '{WS}')) AS w FROM documents) WHERE length(w) > 12) GROUP BY token"),
    "tok_short_runs": (tok_short_runs, f"SELECT doc_id, top AS run, CASE WHEN top > 0 THEN 'short:' || floor(log2(top))::INT::VARCHAR END AS token FROM (SELECT doc_id, string_split({_short}, '|')[2]::INT AS top FROM documents)"),
    "html_strip": (html_strip, f"SELECT page_id, {_strip} AS text FROM pages"),
    "html_summary": (html_summary, f"SELECT page_id, substring(array_to_string(list_filter(string_split_regex({_strip}, '{WS}'), lambda w: length(w) > 0), ' '), 1, 200) AS summary FROM pages"),
    "virus_clues": (virus_clues, r"SELECT page_id, 'virus:' || m AS token, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '</?\s*(?:script|iframe)\b|\bsrc=[''""]?cid:|\b(?:height|width)=[''""]?0')) AS m FROM pages) GROUP BY 1, 2".replace('""', '"')),
    "url_tokens": (url_tokens, _e("pages", "page_id", "list_prepend('proto:' || regexp_extract(lower(url), '^([a-z]+)://', 1), " + _chunks("regexp_extract(lower(url), '^[a-z]+://([^\\s<>\"\\x7f]+)', 1)") + ")")),
    "url_structure": (url_structure, _e("customer", "c_custkey", "list_concat(CASE WHEN c_custkey % 4 > 0 THEN ['url:%' || (2 ** round_even(log2(c_custkey % 4), 0))::BIGINT] ELSE []::VARCHAR[] END, CASE WHEN c_custkey % 4 = 1 THEN ['url:has user'] ELSE []::VARCHAR[] END, CASE WHEN c_custkey % 6 = 0 AND NOT (c_custkey % 3 = 0 AND c_custkey % 9000 = 443) THEN ['url:non-standard port ' || (c_custkey % 9000)] ELSE []::VARCHAR[] END, CASE WHEN c_custkey % 5 = 2 THEN ['url:ip addr'] ELSE []::VARCHAR[] END)")),
    "filename_tokens": (filename_tokens, _e("pages", "page_id", f"list_prepend('fname:' || f, flatten(list_transform(string_split_regex(f, '[/\\\\:]'), lambda p: list_concat(CASE WHEN len(string_split_regex(f, '[/\\\\:]')) > 1 THEN ['fname comp:' || p] ELSE []::VARCHAR[] END, CASE WHEN len(string_split_regex(p, '{_URLSEP}')) > 1 THEN list_transform(string_split_regex(p, '{_URLSEP}'), lambda x: 'fname piece:' || x) ELSE []::VARCHAR[] END))))", f"(SELECT page_id, {_name} AS f FROM pages)")),
    "subject_tokens": (subject_tokens, None),
    "address_tokens": (address_tokens_, "SELECT c_custkey, unnest(['from:name:' || lower(c_name), 'from:addr:' || replace(lower(c_name), '#', '.'), 'from:addr:nation' || c_nationkey || '.example.com']) AS token FROM customer"),
    "recipient_buckets": (recipient_buckets, "SELECT o_custkey, 'to:2**' || round_even(log2(count(*)), 0)::BIGINT::VARCHAR AS token FROM orders GROUP BY o_custkey"),
    "x_mailer": (x_mailer, "SELECT p_partkey, 'x-mailer:' || lower(p_name || ' ' || p_brand || ' ' || p_type) AS token FROM part"),
    "received_tokens": (received_tokens, _e("customer", "c_custkey", "list_transform(['(helo ok)', 'com', 'example.com', 'nation' || c_nationkey || '.example.com', 'mx' || c_custkey || '.nation' || c_nationkey || '.example.com', (c_custkey % 256)::VARCHAR, (c_custkey % 256) || '.' || (c_custkey % 7), (c_custkey % 256) || '.' || (c_custkey % 7) || '.2', (c_custkey % 256) || '.' || (c_custkey % 7) || '.2.1'], lambda t: 'received:' || t)")),
    "message_id_token": (message_id_token, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'message-id:invalid' ELSE 'message-id:@' || lower(c_mktsegment) || '.example.org' END AS token FROM customer"),
    "dotted_quads": (dotted_quads, _e("customer", "c_custkey", "[(c_custkey % 251)::VARCHAR, (c_custkey % 251) || '.' || (c_custkey % 13), (c_custkey % 251) || '.' || (c_custkey % 13) || '.' || (c_custkey % 7), (c_custkey % 251) || '.' || (c_custkey % 13) || '.' || (c_custkey % 7) || '.' || (c_custkey % 199)]")),
    "bigram_stream": (bigram_stream, _e("documents", "doc_id", "list_concat(a[1:1], flatten(list_transform(range(2, len(a) + 1), lambda i: [a[i], 'bi:' || a[i - 1] || ' ' || a[i]])))", f"(SELECT doc_id, {_words} AS a FROM documents)")),
    "base_url": (base_url, f"SELECT page_id, CASE WHEN len(p) <= 2 THEN domain WHEN length(p[-1]) < 3 THEN p[-3] || '.' || p[-2] || '.' || p[-1] ELSE p[-2] || '.' || p[-1] END AS base FROM (SELECT page_id, split_part({_name}, '/', 1) AS domain, string_split(split_part({_name}, '/', 1), '.') AS p FROM pages)"),
    "clean_body": (clean_body, f"SELECT page_id, md5({clean_sql('html')}) AS digest FROM pages"),
    "non_ascii": (non_ascii, r"SELECT doc_id, md5(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{ff}]', '?', 'g')) AS digest FROM documents"),
    "numeric_entities": (numeric_entities, "SELECT c_custkey, 'Hi ' || c_name || ' ' || chr((c_custkey % 500 + 33)::INT) || ' ?' AS text FROM customer"),
    "header_block": (header_block, "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'From: ' || c_name || chr(10) || 'Subject: x' || chr(10) END AS headers FROM customer"),
}
