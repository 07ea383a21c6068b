"""Tokens of whole messages: headers, MIME nodes and text parts, native over the columns that ``sources.mail.parse`` makes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokensieve.functions import text as T

#: Headers that are safe to count whatever the collection, and patterns of those that basic tokens leave out.
SAFE_HEADERS = ["abuse-reports-to", "date", "errors-to", "from", "importance", "in-reply-to", "message-id", "mime-version", "organization", "received", "reply-to", "return-path", "subject", "to", "user-agent", "x-abuse-info", "x-complaints-to", "x-face"]
BASIC_SKIP = ["received", "date", "x-.*"]
#: The nine lines of the Habeas warrant.
HABEAS = {
    "x-habeas-swe-1": "winter into spring",
    "x-habeas-swe-2": "brightly anticipated",
    "x-habeas-swe-3": "like Habeas SWE (tm)",
    "x-habeas-swe-4": "Copyright 2002 Habeas (tm)",
    "x-habeas-swe-5": "Sender Warranted Email (SWE) (tm). The sender of this",
    "x-habeas-swe-6": "email in exchange for a license for this Habeas",
    "x-habeas-swe-7": "warrant mark warrants that this is a Habeas Compliant",
    "x-habeas-swe-8": "Message (HCM) and not spam. Please report use of this",
    "x-habeas-swe-9": "mark in spam to <http://www.habeas.com/report/>.",
}
#: Patterns of uuencoded sections and of URLs that may lack a protocol.
UU_BEGIN, UU_END = r"^begin\s+(\S+)\s+(\S+)\s*$", r"^end\s*\n"
FANCY_URL = r"""(?i)\b(?:(https?|ftp)://|(?=ftp\.[^.\s<>"'\x7f-\xff])|(?=www\.[^.\s<>"'\x7f-\xff]))([^\s<>"'\x7f-\xff]+)"""
#: File extensions and content types that carry viruses.
VIRUS_EXTENSIONS = ["bat", "com", "exe", "pif", "ref", "scr", "vbs", "wsh"]
VIRUS_TYPES = ["application/x-msdownload", "audio/x-wav", "audio/x-midi"]
#: Characters of an octet stream that make a token.
OCTETS = 5


def nothing() -> Column:
    return F.array().cast(T.NO_STRINGS)


def named(headers: Column, name: str) -> Column:
    """The values of all headers of a name, in any case."""
    return F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name), lambda h: h["value"])


def first(headers: Column, name: str) -> Column:
    return F.get(named(headers, name), F.lit(0))


def prefixed(mark: str, tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.concat(F.lit(mark), t))


def maybe(cond: Column, token: Column) -> Column:
    """A token where the condition holds, else none."""
    return F.when(cond, F.array(token)).otherwise(nothing())


# -- taking sections out


def strip_between(text: Column, begin: str, end: str, flags: str = "(?s)") -> Column:
    """The text without the sections from a match of begin to the next match of end; a section that does not end stays."""
    return F.regexp_replace(text, f"{flags}(?:{begin}).*?(?:{end})", "")


def openings(text: Column, begin: str, end: str, group: int, flags: str = "(?s)") -> Column:
    """A group of each match of begin that a stripper meets: those outside sections, and that of a section without an end, which is the last."""
    return F.regexp_extract_all(text, F.lit(f"{flags}(?:{begin})(?:.*?(?:{end})|.*)"), F.lit(group))


def strip_uuencode(text: Column) -> Column:
    return strip_between(text, UU_BEGIN, UU_END, "(?sm)")


def uuencode_tokens(text: Column) -> Column:
    """Mode and file name of each uuencoded section."""
    modes, names = (openings(text, UU_BEGIN, UU_END, g, "(?sm)") for g in (1, 2))
    return F.flatten(F.zip_with(modes, names, lambda m, f: F.concat(F.array(F.concat(F.lit("uuencode mode:"), m)), prefixed("uuencode:", T.filename_tokens(f)))))


def fancy_url_tokens(text: Column) -> Column:
    """Tokens of URLs, also of those that begin with www. or ftp. only."""
    protos, rests = (F.regexp_extract_all(text, F.lit(FANCY_URL), F.lit(i)) for i in (1, 2))
    low = lambda r: F.lower(F.substring(r, 1, 3))
    proto = lambda p, r: F.when(p != "", p).when(low(r) == "www", "http").when(low(r) == "ftp", "ftp").otherwise("unknown")
    return F.flatten(F.zip_with(protos, rests, lambda p, r: T.url_chunks(proto(p, r), r)))


def repair_base64(text: Column) -> Column:
    """Leading lines of base64 decoded (as Latin-1; dropped if they cannot be), then the rest as it is."""
    line = r"[ \t]*[a-zA-Z0-9+/]*"
    head = F.regexp_extract(text, rf"^((?:{line}[ \t]*\r?\n)*+(?:{line}=+[ \t]*\r?\n)?)", 1)
    raw = F.try_to_binary(F.regexp_replace(head, r"\s", ""), F.lit("base64"))
    rest = F.substring(text, F.length(head) + 1, F.length(text))
    return F.concat(F.coalesce(F.decode(raw, "ISO-8859-1"), F.lit("")), rest)


# -- headers


def content_tokens(nodes: Column) -> Column:
    """Type, charsets, disposition and file name of every MIME node."""

    def node(n: Column) -> Column:
        return F.concat(
            F.array(F.concat(F.lit("content-type:"), n["ctype"])),
            maybe(n["kind"].isNotNull(), F.concat(F.lit("content-type/type:"), n["kind"])),
            prefixed("charset:", n["charsets"]),
            maybe(n["disposition"].isNotNull(), F.concat(F.lit("content-disposition:"), n["disposition"])),
            F.when(n["filename"].isNotNull(), prefixed("filename:", T.filename_tokens(n["filename"]))).otherwise(nothing()),
        )

    return F.flatten(F.transform(nodes, node))


def header_counts(headers: Column, safe: list[str] | None = SAFE_HEADERS) -> Column:
    """header:Name:n for each spelling of a header's name; safe is None to count all."""
    names = F.transform(headers, lambda h: h["name"])
    if safe is not None:
        names = F.filter(names, lambda n: F.lower(n).isin(safe))
    return F.transform(F.array_distinct(names), lambda n: F.concat_ws(":", F.lit("header"), n, F.size(F.filter(names, lambda m: m == n)).cast("string")))


def basic_tokens(headers: Column, skip: list[str] = BASIC_SKIP) -> Column:
    """name:word for the words of every header that no pattern of skip begins."""
    pattern = f"^(?:{'|'.join(skip)})"
    words = lambda v: F.flatten(F.transform(F.regexp_extract_all(v, F.lit(r"(?U)[\w\x80-\xff$.%]+"), F.lit(0)), lambda w: T.word_tokens(w)))
    kept = F.filter(headers, lambda h: ~F.lower(h["name"]).rlike(pattern))
    return F.flatten(F.transform(kept, lambda h: F.transform(words(h["value"]), lambda t: F.concat(F.lower(h["name"]), F.lit(":"), t))))


def habeas_tokens(headers: Column, reduce: bool = False) -> Column:
    """Whether each line of the warrant is right; reduced, one verdict: invalid if a line is wrong, valid if all are there."""
    values = {n: first(headers, n) for n in HABEAS}
    if reduce:
        wrong, right = F.lit(False), F.lit(True)
        for n, want in HABEAS.items():
            wrong, right = wrong | F.coalesce(values[n] != want, F.lit(False)), right & F.coalesce(values[n] == want, F.lit(False))
        return F.when(wrong, F.array(F.lit("x-habeas-swe:invalid"))).when(right, F.array(F.lit("x-habeas-swe:valid"))).otherwise(nothing())
    return F.concat(*[maybe(values[n].isNotNull(), F.concat(F.lit(f"{n}:"), F.when(values[n] == want, "valid").otherwise("invalid"))) for n, want in HABEAS.items()])


def common(words: Column) -> Column:
    """Length of the longest common beginning: that of the first and the last in order."""
    a, b = F.array_min(words), F.array_max(words)
    n = F.least(F.length(a), F.length(b))
    alike = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.left(a, i) == F.left(b, i)))
    return F.size(alike)


def recipient_summary(addresses: Column) -> Column:
    """pfxlen and sfxlen: how much the recipients' addresses begin and end alike, in tens of characters; none for a single one."""
    n = F.size(addresses)

    def token(name: str, length: Column, big: int) -> Column:
        score = F.floor(length * n / 10)
        return maybe((n > 1) & (length > 0), F.concat(F.lit(f"{name}:"), F.when(score > big, "big").otherwise(score.cast("string"))))

    return F.concat(token("pfxlen", common(addresses), 3), token("sfxlen", common(F.transform(addresses, lambda a: F.reverse(a))), 5))


def recipient_counts(headers: Column) -> Column:
    """to:2**n and cc:2**n."""

    def token(field: str) -> Column:
        n = F.aggregate(named(headers, field), F.lit(0), lambda a, v: a + F.size(F.split(v, ",")))
        return maybe(n > 0, F.concat(F.lit(f"{field}:2**"), F.bround(F.log2(n.cast("double"))).cast("long").cast("string")))

    return F.concat(token("to"), token("cc"))


def header_tokens(headers: Column, nodes: Column, addresses: Column, recipients: Column, basic: bool = False, habeas: bool = False, summary: bool = False, received: bool = False, safe: list[str] | None = SAFE_HEADERS) -> Column:
    """All tokens of a message's headers; addresses are the tokens of its address headers."""
    parts = [content_tokens(nodes)]
    if basic:
        parts.append(basic_tokens(headers))
    if habeas:
        parts.append(habeas_tokens(headers))
    parts += [F.flatten(F.transform(named(headers, "subject"), lambda v: T.subject_tokens(v))), addresses]
    if summary:
        parts.append(recipient_summary(recipients))
    parts += [recipient_counts(headers), F.array(T.x_mailer(first(headers, "x-mailer")))]
    if received:
        parts.append(F.flatten(F.transform(named(headers, "received"), lambda v: T.received_tokens(v))))
    parts += [F.array(T.message_id_token(first(headers, "message-id"))), header_counts(headers, safe)]
    return F.concat(*parts)


# -- bodies


def octet_tokens(nodes: Column) -> Column:
    """octet: and the first characters of each octet stream."""
    found = F.filter(nodes, lambda n: n["leaf"] & (n["ctype"] == "application/octet-stream"))
    return F.transform(found, lambda n: F.concat(F.lit("octet:"), n["head"]))


def image_size(nodes: Column) -> Column:
    """image-size:2**n of all images of a message together; none if they are empty."""
    total = F.aggregate(F.filter(nodes, lambda n: n["leaf"] & n["ctype"].startswith("image/")), F.lit(0).cast("long"), lambda a, n: a + n["size"])
    return maybe(total > 0, F.concat(F.lit("image-size:2**"), F.bround(F.log2(total.cast("double"))).cast("long").cast("string")))


def part_tokens(part: Column, longest: int = 12, short_runs: bool = False, fancy: bool = False) -> Column:
    """Tokens of one text part: clues of what is taken out of it, then its words."""
    low = F.lower(T.numeric_entities(part))
    plain = strip_uuencode(low)
    url = FANCY_URL if fancy else T.URL
    urls = fancy_url_tokens(plain) if fancy else T.url_tokens(plain)
    bare = T.strip_html(F.regexp_replace(plain, url, ""))
    tokens = F.concat(T.virus_clues(low), uuencode_tokens(low), urls, T.body_tokens(bare, longest))
    return F.concat(tokens, F.array_compact(F.array(T.short_run_token(bare)))) if short_runs else tokens


def message_body_tokens(nodes: Column, bodies: Column, octets: bool = False, images: bool = False, **how) -> Column:
    parts = [octet_tokens(nodes)] * octets + [image_size(nodes)] * images
    return F.concat(*parts, F.flatten(F.transform(bodies, lambda b: part_tokens(b, **how))))


def message_tokens(extra: bool = False) -> Column:
    """The token stream of a parsed message, headers first; extra adds the clues that are off by default."""
    c = F.col
    return F.concat(
        header_tokens(c("headers"), c("nodes"), c("addresses"), c("recipients"), basic=extra, habeas=extra, summary=extra, received=extra),
        message_body_tokens(c("nodes"), c("bodies"), octets=extra, images=extra, short_runs=extra),
    )


# -- rules over parsed messages


def carries_virus(nodes: Column) -> Column:
    """What makes an attachment look like a virus: its extension, or its type if it has no name; null if nothing does."""
    extension = lambda n: F.lower(F.regexp_extract(n["filename"], r"[^/.][^/]*\.([^./]*)$", 1))
    clue = lambda n: F.when(n["filename"].isNull() & n["ctype"].isin(VIRUS_TYPES), n["ctype"]).when(n["filename"].isNotNull() & extension(n).isin(VIRUS_EXTENSIONS), extension(n))
    return F.get(F.array_compact(F.transform(F.filter(nodes, lambda n: n["leaf"]), clue)), F.lit(0))


def without_headers(headers: Column, pattern: str) -> Column:
    """The headers whose names do not begin like a pattern, in any case."""
    return F.filter(headers, lambda h: ~h["name"].rlike(f"(?i)^(?:{pattern})"))
