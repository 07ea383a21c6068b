"""Queries over whole messages and what surrounds their scores. Mail is made from the customer table; the twins list what the rules give for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokensieve.functions import message as MSG
from tokensieve.functions.text import body_tokens as body_tokens_of
from tokensieve.functions.text import strip_html
from tokensieve.operators import model as M
from tokensieve.operators import policy as P
from tokensieve.operators import review as V
from tokensieve.operators import score as S
from tokensieve.operators.corpus import checksum_keys
from tokensieve.plans.base import CV, LABELLED, PROBS, TOK, WORD_TOKENS, chi2q_sql, labelled, messages, read, score_sql, tokens_sql
from tokensieve.plans.model_queries import R, _clues, _probs, _rs, score_documents
from tokensieve.plans.text_queries import _exploded
from tokensieve.sources.mail import parse


def mail(s, d):
    """(msg_id, raw): a MIME message for each customer, with variations by key."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    host = F.concat(F.lit("nation"), n, F.lit(".example.com"))
    when = lambda cond, *parts: F.when(cond, F.concat(*parts)).otherwise(F.lit(""))
    text = F.concat(
        F.lit('From: "'), "c_name", F.lit('" <'), F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"), host, F.lit(">\n"),
        when(k % 7 != 0, F.lit("To: alpha"), (k % 3).cast("string"), F.lit("@"), host, F.lit(", alpha"), (k % 5).cast("string"), F.lit("@"), host, F.lit("\n")),
        when(k % 4 == 0, F.lit("Cc: other@list.example.org\n")),
        F.lit("Subject: Offer "), "c_mktsegment", F.lit(" now!\nMessage-Id: <"), k.cast("string"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.org>\nX-Mailer: Mass  Mailer "), (k % 3).cast("string"), F.lit("\n"),
        when(k % 3 == 0, F.lit("X-Habeas-SWE-1: winter into spring\n")), when(k % 3 == 1, F.lit("X-Habeas-SWE-1: winter into summer\n")),
        when(k % 5 == 0, F.lit("RECEIVED: from mx by relay\nX-Sieve-Id: 7\n")),
        F.lit('MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="=b"\n\n--=b\nContent-Type: text/html; charset="US-ASCII"\n\n<html><!-- hidden --><p>Hello '), "c_name",
        F.lit(" visit http://shop"), n, F.lit(".example.com/a?b="), "c_mktsegment", F.lit(" <b>bold</b>text<iframe src=x></iframe></p>\n--=b\n"),
        when(k % 2 == 0, F.lit('Content-Type: application/octet-stream; name="run.exe"\nContent-Disposition: ATTACHMENT; filename="dir/run'), (k % 4).cast("string"), F.lit('.exe"\nContent-Transfer-Encoding: base64\n\nTVpQQUdFMDA=\n--=b\n')),
        F.lit("Content-Type: image/gif\nContent-Transfer-Encoding: base64\n\n"), F.repeat(F.lit("R0lGODlh"), (k % 4 + 1).cast("int")), F.lit("\n--=b--\n"),
    )
    return read(s, d, "customer").select(k.alias("msg_id"), F.encode(text, "ISO-8859-1").alias("raw"))


def _parsed(s, d):
    m = mail(s, d)
    return parse(m.withColumn("msg_id", F.col("msg_id").cast("string"))).withColumn("msg_id", F.col("msg_id").cast("long"))


def _tokens(expr):
    """A query that counts the tokens of each message."""

    def run(s, d):
        return _parsed(s, d).select("msg_id", F.explode(expr()).alias("token")).groupBy("msg_id", "token").agg(F.count("*").alias("n"))

    return run


def _col(*names):
    return [F.col(c) for c in names]


def mailbox_counts(s, d):
    return V.mailbox_counts(_parsed(s, d))


def virus_attachments(s, d):
    return _parsed(s, d).select("msg_id", MSG.carries_virus(F.col("nodes")).alias("clue"))


def header_removal(s, d):
    names = lambda h: F.array_join(F.transform(h, lambda x: x["name"]), ",")
    h = F.col("headers")
    return _parsed(s, d).select("msg_id", names(MSG.without_headers(h, "x-|mime")).alias("kept"), names(V.own_headers(h)).alias("own"), F.size(V.foreign_headers(h)).alias("foreign"))


def uuencode_tokens(s, d):
    c = read(s, d, "customer")
    k = F.col("c_custkey")
    t = F.concat(F.lit("before\nbegin 644 "), F.lower("c_mktsegment"), F.lit(".txt\nM5V%\nend\nafter "), F.when(k % 2 == 0, F.lit("\nbegin 600 open.bin\nrest")).otherwise(""))
    rows = c.select("c_custkey", t.alias("t"))
    return rows.select("c_custkey", F.array_join(MSG.uuencode_tokens(F.col("t")), "|").alias("tokens"), MSG.strip_uuencode(F.col("t")).alias("text"))


def base64_repair(s, d):
    c = read(s, d, "customer")
    k = F.col("c_custkey")
    t = F.when(k % 3 == 0, F.concat(F.base64(F.encode("c_name", "UTF-8")), F.lit("\nplain text: "), "c_name")).when(k % 3 == 1, F.concat(F.lit("abcde\nand then: "), "c_name")).otherwise(F.concat(F.lit("no base64! "), "c_name"))
    return c.select("c_custkey", MSG.repair_base64(t).alias("text"))


def fancy_urls(s, d):
    c = read(s, d, "customer")
    k = F.col("c_custkey")
    lead = F.when(k % 3 == 0, "www.").when(k % 3 == 1, "ftp.").otherwise("https://")
    t = F.concat(F.lit("see "), lead, F.lower("c_mktsegment"), F.lit(".example.com/x! or wwwx nothing"))
    return _exploded(c.select("c_custkey", t.alias("t")), "c_custkey", MSG.fancy_url_tokens(F.col("t")))


def generic_strip(s, d):
    """Bracketed sections taken out of texts, and what opens them; one section in three does not end."""
    c = read(s, d, "customer")
    k = F.col("c_custkey")
    t = F.concat("c_name", F.lit(" [a1] x [end] y "), F.when(k % 3 == 0, F.lit("[b22] open")).otherwise(F.lit("[b22] z [end]")), F.lit(" tail"))
    rows = c.select("c_custkey", t.alias("t"))
    return rows.select("c_custkey", MSG.strip_between(F.col("t"), r"\[([a-z]\d+)\]", r"\[end\]").alias("text"), F.array_join(MSG.openings(F.col("t"), r"\[([a-z]\d+)\]", r"\[end\]", 1), ",").alias("opened"))


def slurp_pages(s, d):
    """Unsure messages scored again with the words of their page, marked url:, which counts only if it settles them."""
    probs, m = _probs(s, d), messages(s, d)
    words = body_tokens_of(strip_html(F.col("html")))
    more = read(s, d, "pages").select(F.col("page_id").alias("msg_id"), F.transform(words, lambda t: F.concat(F.lit("url:"), t)).alias("more"))
    first = S.score_messages(m, probs).select("msg_id", "n_clues", F.round("score", 6).alias("first"))
    open_ = first.where("first >= 0.2 AND first <= 0.9 AND n_clues < 150").select("msg_id")
    again = m.join(open_, "msg_id").join(more, "msg_id").select("msg_id", F.concat("tokens", "more").alias("tokens"))
    second = S.score_messages(again, probs).select("msg_id", F.round("score", 6).alias("second")).where("second < 0.2 OR second > 0.9")
    return first.join(second, "msg_id", "left").select("msg_id", F.coalesce("second", "first").alias("score"))


def loose_checksum(s, d):
    return checksum_keys(read(s, d, "pages"), "page_id", "html", loose=True)


def _evidence(s, d):
    m = labelled(s, d)
    found = S.clues(M.exploded(m, "msg_id"), _probs(s, d))
    return V.evidence_list(found, S.score(m.select("msg_id"), found))


def evidence_sides(s, d):
    e = _evidence(s, d)
    at = lambda i: R(F.get("clues", F.lit(i))["prob"])
    return e.select("msg_id", F.size("clues").alias("n"), at(0).alias("ham_side"), at(1).alias("spam_side"))


def evidence_header(s, d):
    """The first clues of the evidence header; its folding is tested by itself."""
    return _evidence(s, d).select("msg_id", F.array_join(F.slice(V.shown_clues(F.col("clues"), 0.3), 3, 3), "; ").alias("header"))


def unique_ids(s, d):
    return V.unique_ids(read(s, d, "events").select("event_id", "ts"), "event_id", "ts").select("event_id", "msg_name")


def bulk_report(s, d):
    return V.bulk_report(score_documents(s, d).where("msg_id % 10 = 3"), F.col("n_clues").cast("string"))


def review_sections(s, d):
    x = V.review_sections(score_documents(s, d), [F.desc("score"), F.asc("msg_id")], 20)
    return x.select("category", "position", "msg_id", V.review_action(F.col("category"), F.col("score"), 0.98, 0.02, ("train", "train", "defer")).alias("action"))


def folder_counts(s, d):
    x = score_documents(s, d).join(read(s, d, "documents").select(F.col("doc_id").alias("msg_id"), "source"), "msg_id")
    return V.folder_counts(x, "source")


def session_counters(s, d):
    x = score_documents(s, d).join(read(s, d, "labels").select(F.col("doc_id").alias("msg_id"), "toxic"), "msg_id")
    log = F.array(
        F.struct(F.lit("classify").alias("kind"), F.col("score"), F.lit(None).cast("boolean").alias("as_ham"), F.lit(None).cast("double").alias("old_score"), F.lit(None).cast("string").alias("old_class")),
        F.struct(F.lit("train").alias("kind"), F.lit(None).cast("double").alias("score"), (F.col("toxic") == 0).alias("as_ham"), F.when(F.col("msg_id") % 2 == 0, F.col("score")).alias("old_score"), F.when(F.col("msg_id") % 2 == 1, F.col("category")).alias("old_class")),
    )
    return V.session_counters(x.select(F.explode(log).alias("e")).select("e.*"))


def message_state(s, d):
    info = read(s, d, "labels").select(F.col("doc_id").alias("msg_id"), F.when(F.col("toxic") == 1, "s").otherwise("h").alias("c"), F.when(F.col("quality") == 1, F.col("toxic") == 1).alias("t"))
    return V.message_state(read(s, d, "documents").select(F.col("doc_id").alias("msg_id")), info)


def message_info(s, d):
    """The message-info table after an update: new states replace old ones by id."""
    from tokensieve.sources.store import upsert

    old = read(s, d, "labels").select(F.col("doc_id").alias("msg_id"), F.lit("u").alias("c"))
    new = read(s, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("msg_id"), F.lit("h").alias("c"))
    return upsert(old, new, "msg_id")


def train_on_filter(s, d):
    m = labelled(s, d).select("msg_id", "tokens", F.when(F.col("fold") == 0, F.when(F.col("is_spam"), "spam").otherwise("ham")).alias("trained"))
    model = M.learn(labelled(s, d).where("fold = 0"))
    return P.train_on_filter(model, m, M.token_probability(model))[1].meta


def filter_guesses(s, d):
    m = labelled(s, d).select("msg_id", "tokens", F.lit(None).cast("string").alias("trained"))
    model = M.learn(labelled(s, d).where("fold = 0"))
    return P.train_on_filter(model, m, M.token_probability(model))[0].groupBy("category", "trained").agg(F.count("*").alias("n"))


def cull_trained(s, d):
    return P.cull(read(s, d, "documents").select("doc_id", "source"), read(s, d, "labels"), "doc_id")


def size_limit(s, d):
    x = score_documents(s, d).join(read(s, d, "documents").select(F.col("doc_id").alias("msg_id"), "n_chars"), "msg_id")
    return x.select("msg_id", P.size_limited(F.col("score"), F.col("n_chars"), 500).alias("score"))


def histogram_merge(s, d):
    h = lambda rows: rows.groupBy("bucket").agg(F.count("*").alias("n"))
    e = read(s, d, "events").select(F.floor(F.pmod("value", F.lit(100.0)) / 5).alias("bucket"), "event_type")
    return V.merge_histograms(h(e.where("event_type = 'click'")), h(e.where("event_type <> 'click'")), ["bucket"])


def histogram_plot(s, d):
    return V.plotted(histogram_merge(s, d), "bucket", "n", 20)


def day_graph(s, d):
    kind = F.when(F.col("event_type") == "click", "ham").when(F.col("event_type") == "view", "spam").otherwise("unsure")
    days = read(s, d, "events").select(F.datediff(F.to_date(F.lit("2024-02-01")), F.to_date("ts")).alias("age"), kind.alias("category"))
    return V.day_graph(days.groupBy("age", "category").agg(F.count("*").alias("n")), [1, 5, 20, 100])


def lookup_cache(s, d):
    e = read(s, d, "events")
    cache = e.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("asked"), (F.col("event_id") % 1_000_000 * 10).alias("ttl"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("host"), F.col("event_id").cast("string"))).alias("answer"))
    now = e.agg(F.max(F.col("ts").cast("timestamp")).alias("now"))
    return V.live_lookups(cache.crossJoin(F.broadcast(now)).withColumnRenamed("now", "_now"), F.col("_now"))


def weak_query(name):
    def run(s, d):
        m = labelled(s, d).select("fold", "seq", "msg_id", "is_spam", "tokens")
        return P.weak_test(m, name, 20).select("fold", "msg_id", F.round("score", 6).alias("score"), "trained")

    return run


def balanced(s, d):
    m = labelled(s, d).select("fold", "seq", "grp", "msg_id", "is_spam", "tokens")
    return P.replay(m, "balanced_corrected").select("fold", "msg_id", F.round("score", 6).alias("score"), "guess", "trained")


# -- what the rules give for the mail above

_K = "(SELECT *, c_custkey AS k, c_nationkey::VARCHAR AS n, 'nation' || c_nationkey || '.example.com' AS host, lower(replace(c_name, '#', '.')) AS who, lower(c_mktsegment) AS seg FROM customer)"
_words = lambda *ws: f"flatten(list_transform([{', '.join(ws)}], lambda w: {WORD_TOKENS}))"
_mark = lambda mark, arr: f"list_transform({arr}, lambda t: '{mark}' || t)"
_if = lambda cond, arr: f"(CASE WHEN {cond} THEN {arr} ELSE []::VARCHAR[] END)"
_cat = lambda *arrs: f"flatten([{', '.join(arrs)}])"
_count = lambda arr: f"SELECT msg_id, token, count(*) AS n FROM (SELECT k AS msg_id, unnest({arr}) AS token FROM {_K}) GROUP BY 1, 2"

_file = "['filename:fname:dir/run' || (k % 4) || '.exe', 'filename:fname comp:dir', 'filename:fname comp:run' || (k % 4) || '.exe', 'filename:fname piece:run' || (k % 4), 'filename:fname piece:exe']"
_content = _cat(
    "['content-type:multipart/mixed', 'charset:us-ascii', 'content-type:text/html', 'charset:us-ascii', 'content-type:image/gif']",
    _if("k % 2 = 0", "['content-type:application/octet-stream', 'content-disposition:attachment; filename=\"dir/run' || (k % 4) || '.exe\"']"),
    _if("k % 2 = 0", _file),
)
_basic = _cat(
    _mark("from:", _words("'Customer'", "string_split(c_name, '#')[2]", "who", "host")),
    _if("k % 7 <> 0", _mark("to:", _words("'alpha' || (k % 3)", "host", "'alpha' || (k % 5)", "host"))),
    _if("k % 4 = 0", _mark("cc:", _words("'other'", "'list.example.org'"))),
    _mark("subject:", _words("'Offer'", "c_mktsegment", "'now'")),
    _mark("message-id:", _words("k::VARCHAR", "seg || '.example.org'")),
    _mark("mime-version:", _words("'1.0'")),
    _mark("content-type:", _words("'multipart'", "'mixed'", "'boundary'", "'b'")),
)
_habeas = _cat(_if("k % 3 = 0", "['x-habeas-swe-1:valid']"), _if("k % 3 = 1", "['x-habeas-swe-1:invalid']"))
_counts = _cat("['header:From:1', 'header:Subject:1', 'header:Message-Id:1', 'header:MIME-Version:1']", _if("k % 7 <> 0", "['header:To:1']"), _if("k % 5 = 0", "['header:RECEIVED:1']"))
_address = _cat(
    "['from:name:' || lower(c_name), 'from:addr:' || who, 'from:addr:' || host, 'sender:none', 'reply-to:none']",
    "(CASE WHEN k % 7 = 0 THEN ['to:none'] ELSE ['to:addr:alpha' || (k % 3), 'to:addr:' || host, 'to:addr:alpha' || (k % 5), 'to:addr:' || host, 'to:no real name:2**1', 'to:2**1'] END)",
    "(CASE WHEN k % 4 = 0 THEN ['cc:addr:other', 'cc:addr:list.example.org', 'cc:no real name:2**0', 'cc:2**0'] ELSE ['cc:none'] END)",
)
_rest = _cat(_mark("subject:", _words("'Offer'", "c_mktsegment", "'now'")), "['subject: ', 'subject: ', 'subject:!', 'x-mailer:mass mailer ' || (k % 3), 'message-id:@' || seg || '.example.org']")
_bodied = _cat("['virus:<iframe', 'virus:</iframe', 'proto:http', 'url:shop' || n, 'url:example', 'url:com', 'url:a', 'url:b', 'url:' || seg]", _words("'hello'", "lower(c_name)", "'visit'", "'boldtext'"))
_long = lambda f: f"(SELECT coalesce(max(i), 0) FROM range(1, 60) r(i) WHERE i <= list_min(list_transform(a, lambda x: length(x))) AND len(list_distinct(list_transform(a, lambda x: {f}(x, i::INT)))) = 1)"
_ADDR = f"(SELECT k, list_concat(CASE WHEN k % 7 <> 0 THEN ['alpha' || (k % 3) || '@' || host, 'alpha' || (k % 5) || '@' || host] ELSE []::VARCHAR[] END, CASE WHEN k % 4 = 0 THEN ['other@list.example.org'] ELSE []::VARCHAR[] END) AS a FROM {_K})"
_summary = (
    f"WITH x AS (SELECT k, len(a) AS c, CASE WHEN len(a) > 1 THEN (SELECT count(*) FROM range(1, 60) r(i) WHERE i <= list_min(list_transform(a, lambda x: length(x))) AND len(list_distinct(list_transform(a, lambda x: left(x, i)))) = 1) ELSE 0 END AS p, "
    f"CASE WHEN len(a) > 1 THEN (SELECT count(*) FROM range(1, 60) r(i) WHERE i <= list_min(list_transform(a, lambda x: length(x))) AND len(list_distinct(list_transform(a, lambda x: right(x, i)))) = 1) ELSE 0 END AS q FROM {_ADDR}) "
    "SELECT k AS msg_id, 'pfxlen:' || CASE WHEN p * c // 10 > 3 THEN 'big' ELSE (p * c // 10)::VARCHAR END AS token, 1 AS n FROM x WHERE p > 0 UNION ALL SELECT k, 'sfxlen:' || CASE WHEN q * c // 10 > 5 THEN 'big' ELSE (q * c // 10)::VARCHAR END, 1 FROM x WHERE q > 0"
)
_FOLD0 = (
    f"{LABELLED}, {TOK}, wi AS (SELECT token, sum(is_spam::INT)::BIGINT AS spamcount, sum((NOT is_spam)::INT)::BIGINT AS hamcount FROM tok WHERE fold = 0 GROUP BY token), me AS (SELECT sum(is_spam::INT)::BIGINT AS nspam, sum((NOT is_spam)::INT)::BIGINT AS nham FROM msgs WHERE fold = 0), "
)


def _fold0():
    from tokensieve.plans.base import prob_sql

    return f"{_FOLD0} p0 AS (SELECT token, {prob_sql()} AS prob FROM wi, me), {score_sql('(SELECT DISTINCT msg_id, token FROM tok)', 'p0', '(SELECT msg_id, is_spam, fold FROM msgs)')}"


_side = lambda m: f"CASE WHEN s.n > 0 THEN 1.0 - {chi2q_sql(m, 's.n')} ELSE 0.0 END"
_clued = f"{PROBS}, {score_sql('(SELECT DISTINCT msg_id, token FROM tok)', 'probs', '(SELECT msg_id FROM msgs)')}"
_strip_sql = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(html), '(?s)<\s*style\b[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->|<\s*comment\s*>.*?</comment>', '', 'g'), "
    r"'(?s)<\s*noframes\s*>.*?</noframes\s*>', '', 'g'), '&nbsp;|<(?:p|br)>', ' ', 'g'), '<[^\s<>][^>]{0,255}>', '', 'g')"
)
_slurp = (
    f"WITH {_rs}, open AS (SELECT msg_id FROM rs WHERE score BETWEEN 0.2 AND 0.9 AND n_clues < 150), page AS (SELECT page_id AS msg_id, unnest({tokens_sql(_strip_sql)}) AS w FROM pages JOIN open ON page_id = msg_id), "
    "own AS (SELECT d.msg_id, d.token FROM dtok d JOIN open USING (msg_id) JOIN pages ON page_id = msg_id), more AS (SELECT * FROM own UNION SELECT msg_id, 'url:' || w FROM page), "
    f"sec AS (SELECT msg_id, round(score, 6) AS second FROM (WITH {score_sql('more', 'probs', '(SELECT msg_id FROM open JOIN pages ON page_id = msg_id)')} SELECT * FROM scored)) "
    "SELECT rs.msg_id, CASE WHEN second < 0.2 OR second > 0.9 THEN second ELSE score END AS score FROM rs LEFT JOIN sec USING (msg_id)"
)
_loose = (
    r"string_split(array_to_string(list_filter(string_split(lower(regexp_replace(html, '<[^>]*>', '', 'g')), ' '), lambda w: NOT (contains(w, '@') OR starts_with(w, 'ftp:') OR starts_with(w, 'mailto:') OR starts_with(w, 'http:') OR starts_with(w, 'gopher:') OR w = 'pmguid:')), ' '), chr(10))"
)
_LK = (
    f"lk AS (SELECT page_id, list_transform(range(0, 4), lambda i: md5(array_to_string(list_slice(l, i * (len(l) // 4 + 1) + 1, (i + 1) * (len(l) // 4 + 1)), chr(10)))) AS c FROM (SELECT page_id, list_filter({_loose}, lambda x: contains(x, ' ')) AS l FROM pages))"
)
_report_mark = "CASE WHEN score >= 0.9 THEN 'S' WHEN score <= 0.2 THEN '.' ELSE 'U' END"
_GRAPH = (
    "WITH e AS (SELECT (date_diff('day', ts::DATE, DATE '2024-02-01')) AS age, CASE event_type WHEN 'click' THEN 'h' WHEN 'view' THEN 's' ELSE 'u' END AS c FROM events), "
    "per AS (SELECT age // 2 AS slot, sum((c = 's')::INT) // 2 AS s, sum((c = 'h')::INT) // 2 AS h, sum((c = 'u')::INT) // 2 AS u FROM e WHERE age >= 0 AND age < 120 GROUP BY 1), "
    "g AS (SELECT v, slot, coalesce(s, 0) AS s, coalesce(h, 0) AS h, coalesce(u, 0) AS u FROM (SELECT unnest([1, 5, 20, 100]) AS v), range(60) t(slot) LEFT JOIN per USING (slot)), "
    "c1 AS (SELECT v, slot, (s >= v)::INT + (h >= v)::INT + (u >= v)::INT AS k, CASE WHEN s >= v AND (h < v OR s <= h) AND (u < v OR s <= u) THEN 's' WHEN h >= v AND (u < v OR h <= u) THEN 'h' WHEN u >= v THEN 'u' ELSE ' ' END AS ch FROM g) "
    "SELECT v AS value, lpad(v::VARCHAR, 5, ' ') || '|' || string_agg(CASE WHEN k > 1 THEN upper(ch) ELSE ch END, '' ORDER BY slot DESC) AS line FROM c1 GROUP BY v"
)

QUERIES = {
    "message_tokens": (_tokens(lambda: MSG.message_tokens()), _count(_cat(_content, _rest, _address, _counts, _bodied))),
    "content_tokens": (_tokens(lambda: MSG.content_tokens(F.col("nodes"))), _count(_content)),
    "basic_headers": (_tokens(lambda: MSG.basic_tokens(F.col("headers"))), _count(_basic)),
    "habeas": (_tokens(lambda: MSG.habeas_tokens(F.col("headers"))), _count(_habeas)),
    "header_counts": (_tokens(lambda: MSG.header_counts(F.col("headers"))), _count(_counts)),
    "octet_prefix": (_tokens(lambda: MSG.octet_tokens(F.col("nodes"))), _count(_if("k % 2 = 0", "['octet:MZPAG']"))),
    "image_sizes": (_tokens(lambda: MSG.image_size(F.col("nodes"))), _count("['image-size:2**' || round_even(log2(6.0 * (k % 4 + 1)), 0)::INT]")),
    "recipient_summary": (_tokens(lambda: MSG.recipient_summary(F.col("recipients"))), _summary),
    "mailbox_counts": (mailbox_counts, "SELECT sum((c_custkey % 7 <> 0 OR c_custkey % 4 = 0)::INT)::BIGINT AS good, sum((c_custkey % 7 = 0 AND c_custkey % 4 <> 0)::INT)::BIGINT AS bad FROM customer"),
    "virus_attachments": (virus_attachments, "SELECT c_custkey AS msg_id, CASE WHEN c_custkey % 2 = 0 THEN 'exe' END AS clue FROM customer"),
    "header_removal": (header_removal, "SELECT c_custkey AS msg_id, 'From,' || CASE WHEN c_custkey % 7 <> 0 THEN 'To,' ELSE '' END || CASE WHEN c_custkey % 4 = 0 THEN 'Cc,' ELSE '' END || 'Subject,Message-Id,' || CASE WHEN c_custkey % 5 = 0 THEN 'RECEIVED,' ELSE '' END || 'Content-Type' AS kept, CASE WHEN c_custkey % 5 = 0 THEN 'X-Sieve-Id' ELSE '' END AS own, (6 + (c_custkey % 7 <> 0)::INT + (c_custkey % 4 = 0)::INT + (c_custkey % 3 < 2)::INT + (c_custkey % 5 = 0)::INT) AS \"foreign\" FROM customer"),
    "uuencode_tokens": (uuencode_tokens, "SELECT c_custkey, 'uuencode mode:644|uuencode:fname:' || lower(c_mktsegment) || '.txt|uuencode:fname piece:' || lower(c_mktsegment) || '|uuencode:fname piece:txt' || CASE WHEN c_custkey % 2 = 0 THEN '|uuencode mode:600|uuencode:fname:open.bin|uuencode:fname piece:open|uuencode:fname piece:bin' ELSE '' END AS tokens, 'before' || chr(10) || 'after ' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'begin 600 open.bin' || chr(10) || 'rest' ELSE '' END AS text FROM customer"),
    "base64_repair": (base64_repair, "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || 'plain text: ' || c_name WHEN 1 THEN 'and then: ' || c_name ELSE 'no base64! ' || c_name END AS text FROM customer"),
    "fancy_urls": (fancy_urls, "SELECT c_custkey, pos - 1 AS pos, token FROM (SELECT c_custkey, unnest(a) AS token, generate_subscripts(a, 1) AS pos FROM (SELECT c_custkey, list_concat(CASE c_custkey % 3 WHEN 0 THEN ['proto:http', 'url:www'] WHEN 1 THEN ['proto:ftp', 'url:ftp'] ELSE ['proto:https'] END, ['url:' || lower(c_mktsegment), 'url:example', 'url:com', 'url:x']) AS a FROM customer))"),
    "generic_strip": (generic_strip, "SELECT c_custkey, c_name || '  y ' || CASE WHEN c_custkey % 3 = 0 THEN '[b22] open tail' ELSE ' tail' END AS text, 'a1,b22' AS opened FROM customer"),
    "slurp_rescore": (slurp_pages, _slurp),
    "loose_checksum": (loose_checksum, f"WITH {_LK} SELECT page_id, unnest(['0:' || c[1] || '.' || c[2], '1:' || c[2] || '.' || c[3], '2:' || c[3] || '.' || c[4]]) AS sub FROM lk"),
    "evidence_sides": (evidence_sides, f"WITH {_clued} SELECT i.msg_id, 2 + coalesce(s.n, 0) AS n, round({_side('s.h')}, 6) AS ham_side, round({_side('s.s')}, 6) AS spam_side FROM (SELECT msg_id FROM msgs) i LEFT JOIN sums s USING (msg_id)"),
    "evidence_header": (evidence_header, f"WITH {_clued}, r AS (SELECT msg_id, token, prob, row_number() OVER (PARTITION BY msg_id ORDER BY prob, token) AS i FROM clue WHERE prob <= 0.3::DOUBLE OR prob >= 0.7::DOUBLE), q AS (SELECT msg_id, string_agg(CASE WHEN contains(token, chr(39)) AND NOT contains(token, chr(34)) THEN chr(34) || token || chr(34) ELSE chr(39) || replace(token, chr(39), chr(92) || chr(39)) || chr(39) END || ': ' || printf('%.2f', round_even(round(prob, 6) * 100, 0) / 100), '; ' ORDER BY i) AS header FROM r WHERE i <= 3 GROUP BY msg_id) SELECT m.msg_id, coalesce(header, '') AS header FROM msgs m LEFT JOIN q USING (msg_id)"),
    "unique_ids": (unique_ids, "SELECT event_id, CASE WHEN n > 1 THEN sec || '-' || (n - 1) ELSE sec END AS msg_name FROM (SELECT event_id, floor(epoch(ts))::BIGINT::VARCHAR AS sec, row_number() OVER (PARTITION BY floor(epoch(ts))::BIGINT ORDER BY event_id) AS n FROM events)"),
    "bulk_report": (bulk_report, f"WITH {_rs} SELECT msg_id, lpad(msg_id::VARCHAR, 6, ' ') || ' ' || printf('%.2f', round_even(score * 100, 0) / 100) || ' ' || {_report_mark} || ' ' || n_clues AS line FROM rs WHERE score > 0.2 AND msg_id % 10 = 3"),
    "review_sections": (review_sections, f"WITH {_rs}, c AS (SELECT msg_id, score, CASE WHEN score < 0.2 THEN 'ham' WHEN score >= 0.9 THEN 'spam' ELSE 'unsure' END AS category FROM rs), p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, msg_id) AS position FROM c) SELECT category, position, msg_id, CASE category WHEN 'spam' THEN CASE WHEN score > 0.98 THEN 'discard' ELSE 'train' END WHEN 'ham' THEN CASE WHEN score < 0.02 THEN 'discard' ELSE 'train' END ELSE 'defer' END AS action FROM p WHERE position <= 20"),
    "folder_counts": (folder_counts, f"WITH {_rs} SELECT source, sum((score < 0.2)::INT)::BIGINT AS ham, sum((score >= 0.9)::INT)::BIGINT AS spam, sum((score >= 0.2 AND score < 0.9)::INT)::BIGINT AS unsure FROM rs JOIN documents ON msg_id = doc_id GROUP BY source"),
    "session_counters": (session_counters, f"WITH {_rs}, x AS (SELECT msg_id, score, toxic = 0 AS h FROM rs JOIN labels ON msg_id = doc_id) SELECT sum((score < 0.2)::INT)::BIGINT AS num_ham, sum((score >= 0.9)::INT)::BIGINT AS num_spam, sum((score >= 0.2 AND score < 0.9)::INT)::BIGINT AS num_unsure, sum(h::INT)::BIGINT AS num_trained_ham, sum((h AND CASE WHEN msg_id % 2 = 0 THEN score > 0.9 ELSE score >= 0.9 END)::INT)::BIGINT AS num_trained_ham_fp, sum((NOT h)::INT)::BIGINT AS num_trained_spam, sum((NOT h AND score < 0.2)::INT)::BIGINT AS num_trained_spam_fn FROM x"),
    "message_state": (message_state, "SELECT d.doc_id AS msg_id, CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 's' ELSE 'h' END AS c, CASE WHEN quality = 1 THEN toxic = 1 END AS t FROM documents d LEFT JOIN labels l USING (doc_id)"),
    "message_info": (message_info, "SELECT doc_id AS msg_id, 'h' AS c FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'u' FROM labels WHERE doc_id % 3 <> 0 OR doc_id NOT IN (SELECT doc_id FROM documents)"),
    "train_on_filter": (train_on_filter, f"WITH {_fold0()} SELECT sum((round(score, 12) > 0.9)::INT)::BIGINT AS nspam, sum((round(score, 12) <= 0.9)::INT)::BIGINT AS nham FROM scored"),
    "filter_guesses": (filter_guesses, f"WITH {_fold0()} SELECT CASE WHEN score < 0.2 THEN 'ham' WHEN score > 0.9 THEN 'spam' ELSE 'unsure' END AS category, CASE WHEN score > 0.9 THEN 'spam' ELSE 'ham' END AS trained, count(*) AS n FROM scored GROUP BY 1, 2"),
    "cull_trained": (cull_trained, "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
    "size_limit": (size_limit, f"WITH {_rs} SELECT msg_id, CASE WHEN n_chars < 500 THEN score ELSE 0.0 END AS score FROM rs JOIN documents ON msg_id = doc_id"),
    "histogram_merge": (histogram_merge, "SELECT floor(((value % 100.0 + 100.0) % 100.0) / 5)::BIGINT AS bucket, count(*) AS n FROM events GROUP BY 1"),
    "histogram_plot": (histogram_plot, "SELECT 100.0::DOUBLE * floor(((value % 100.0 + 100.0) % 100.0) / 5)::BIGINT / 20 AS x, count(*) AS y FROM events GROUP BY 1"),
    "day_graph": (day_graph, _GRAPH),
    "lookup_cache": (lookup_cache, "WITH c AS (SELECT user_id::VARCHAR AS key, floor(epoch(ts))::BIGINT + CASE WHEN event_id % 3 = 0 THEN 300 ELSE greatest(86400, least(604800, event_id % 1000000 * 10)) END AS until, CASE WHEN event_id % 3 > 0 THEN 'host' || event_id END AS answer FROM events), f AS (SELECT * FROM c WHERE until > (SELECT floor(epoch(max(ts)))::BIGINT FROM events)) SELECT key, answer, until FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY until DESC, answer DESC NULLS LAST) AS r FROM f) WHERE r = 1"),
    "regime_balanced_corrected": (balanced, None),
    **{f"weaktest_{n.replace('+', '_')}": (weak_query(n), None) for n in P.DECISIONS},
}
