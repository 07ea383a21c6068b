"""Tokenizer expressions over text columns, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words, and the separators inside URLs and file names.
WHITE = r"[\x09-\x0d\x1c-\x20\x85\xa0  -     　]+"
URL_SEPARATORS = r"[;?:@&=+,$.]"
FILE_SEPARATORS = r"[/\\:]"
#: Patterns of HTML parts that are taken out, of virus clues and of URLs.
TAG = r"<[^\s<>][^>]{0,255}>"
BREAKING = r"&nbsp;|<(?:p|br)>"
STYLE = r"(?s)<\s*style\b[^>]*>.*?</style>"
COMMENT = r"(?s)<!--.*?-->|<\s*comment\s*>.*?</comment>"
NOFRAMES = r"(?s)<\s*noframes\s*>.*?</noframes\s*>"
VIRUS = r"</?\s*(?:script|iframe)\b|\bsrc=['\"]?cid:|\b(?:height|width)=['\"]?0"
URL = r"(https?|ftp)://([^\s<>\"'\x7f-\xff]+)"
#: What Received and Message-Id headers are searched for.
COMPLAINT, RELAY, RELAY_IP = r"\([a-z]+(?:\s+[a-z]+)+\)", r"from ([a-z0-9._-]+[a-z])[)\s]", r"[\[(]((?:\d{1,3}\.?){4})[\])]"
MESSAGE_ID = r"^\s*<[^@]+@([^>]+)>\s*"
#: What a body is cleaned of before fuzzy checksums, in turn, and words that are left out.
CLEANING = [("[0-9]+", "#"), ("(&nbsp;)+", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), (r"\n+", "\n"), (r"[ \t]+", " ")]
LINKS, LINK_WORD = ["ftp:", "mailto:", "http:", "gopher:"], "pmguid:"
NO_STRINGS = "array<string>"


def raw_words(text: Column) -> Column:
    """The words of a text in order, of any length."""
    return F.filter(F.split(text, WHITE), lambda w: F.length(w) > 0)


def words(text: Column, longest: int = 12) -> Column:
    """Words of 3 to ``longest`` characters, lower-cased."""
    return F.filter(raw_words(F.lower(text)), lambda w: F.length(w).between(3, longest))


def word_tokens(w: Column, longest: int = 12) -> Column:
    """Tokens of one word: itself, or what stands for a long one."""
    n = F.length(w)
    at = F.split(w, "@")
    mail = (n < 40) & F.contains(w, F.lit(".")) & (F.size(at) == 2)
    high = F.length(F.regexp_replace(w, r"[\x00-\x7f]", ""))
    skip = F.concat(F.lit("skip:"), F.substring(w, 1, 1), F.lit(" "), (F.floor(n / 10) * 10).cast("string"))
    eight = F.concat(F.lit("8bit%:"), F.bround(high * 100.0 / n).cast("long").cast("string"))
    none = F.array().cast(NO_STRINGS)
    return (
        F.when(n < 3, none)
        .when(n <= longest, F.array(w))
        .when(mail, F.array(F.concat(F.lit("email name:"), at[0]), F.concat(F.lit("email addr:"), at[1])))
        .when(w.rlike(r"[\x80-\xff]"), F.array(skip, eight))
        .otherwise(F.array(skip))
    )


def body_tokens(text: Column, longest: int = 12) -> Column:
    """The token stream of a text, in order and with repeats."""
    return F.flatten(F.transform(raw_words(F.lower(F.coalesce(text, F.lit("")))), lambda w: word_tokens(w, longest)))


def short_run(text: Column) -> Column:
    """The longest run of words under three characters that a longer word ends; 0 if there is none."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(a: Column, w: Column) -> Column:
        short = F.length(w) < 3
        return F.struct(F.when(short, a["run"] + 1).otherwise(0).alias("run"), F.when(short, a["top"]).otherwise(F.greatest(a["top"], a["run"])).alias("top"))

    return F.aggregate(raw_words(text), start, step, lambda a: a["top"])


def short_run_token(text: Column) -> Column:
    top = short_run(text)
    return F.when(top > 0, F.concat(F.lit("short:"), F.floor(F.log2(top.cast("double"))).cast("string")))


def strip_html(text: Column) -> Column:
    """Lower-cased text without style sheets, comments, noframes and tags; breaking tags become spaces."""
    out = F.lower(text)
    for pattern in (STYLE, COMMENT, NOFRAMES):
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(F.regexp_replace(out, BREAKING, " "), TAG, "")


def non_ascii(text: Column) -> Column:
    """Control and high-bit characters as question marks."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xff]", "?")


def numeric_entities(text: Column) -> Column:
    """Decimal character references decoded, one after another; those out of range become ``?``."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(\d+);"), F.lit(1)))
    code = lambda d: F.when(F.length(d) < 8, d.cast("int"))
    put = lambda t, d: F.replace(t, F.concat(F.lit("&#"), d, F.lit(";")), F.when(code(d).between(0, 0x10FFFF) & ~code(d).between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code(d)), 8, "0")), "UTF-32")).otherwise("?"))
    return F.aggregate(found, text, put)


def virus_clues(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(VIRUS), F.lit(0)), lambda m: F.concat(F.lit("virus:"), m))


def url_chunks(proto: Column, rest: Column) -> Column:
    """proto:, then url: for each chunk of the rest; empty chunks count."""
    trimmed = F.regexp_replace(rest, r"[.:?!/]+$", "")
    chunks = F.flatten(F.transform(F.split(trimmed, "/"), lambda p: F.split(p, URL_SEPARATORS)))
    return F.concat(F.array(F.concat(F.lit("proto:"), proto)), F.transform(chunks, lambda c: F.concat(F.lit("url:"), c)))


def url_tokens(text: Column) -> Column:
    """Tokens of all URLs in a text."""
    low = F.lower(text)
    protos, rests = (F.regexp_extract_all(low, F.lit(URL), F.lit(i)) for i in (1, 2))
    return F.flatten(F.zip_with(protos, rests, url_chunks))


def url_structure(url: Column) -> Column:
    """Clues in a URL's form: escapes, a user, an odd port, a numeric host."""
    host = F.regexp_extract(url, r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)
    port = F.regexp_extract(url, r"^[a-z]+://(?:[^/@]*@)?[^/:?#]+:(\d+)", 1)
    escapes = F.regexp_count(url, F.lit("%[0-9a-fA-F]{2}"))
    clue = lambda cond, v: F.when(cond, F.array(v)).otherwise(F.array().cast(NO_STRINGS))
    return F.concat(
        clue(escapes > 0, F.concat(F.lit("url:%"), F.pow(F.lit(2.0), F.bround(F.log2(escapes.cast("double")))).cast("long").cast("string"))),
        clue(url.rlike(r"^[a-z]+://[^/]*@"), F.lit("url:has user")),
        clue((port != "") & ~((port == "80") & url.startswith("http:")) & ~((port == "443") & url.startswith("https:")), F.concat(F.lit("url:non-standard port "), port)),
        clue(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.lit("url:ip addr")),
    )


def filename_tokens(name: Column) -> Column:
    """fname:, then components between slashes and pieces between separators, where there are several."""
    parts = F.split(name, FILE_SEPARATORS)

    def part(p: Column) -> Column:
        pieces = F.split(p, URL_SEPARATORS)
        own = F.when(F.size(parts) > 1, F.array(F.concat(F.lit("fname comp:"), p))).otherwise(F.array().cast(NO_STRINGS))
        inner = F.when(F.size(pieces) > 1, F.transform(pieces, lambda x: F.concat(F.lit("fname piece:"), x))).otherwise(F.array().cast(NO_STRINGS))
        return F.concat(own, inner)

    return F.concat(F.array(F.concat(F.lit("fname:"), name)), F.flatten(F.transform(parts, part)))


def subject_tokens(subject: Column, longest: int = 12) -> Column:
    """subject: tokens of the words, case kept, and of the runs of other characters."""
    s = F.replace(subject, F.lit("\r"), F.lit(" "))
    tokens = F.flatten(F.transform(F.regexp_extract_all(s, F.lit(r"(?U)[\w\x80-\xff$.%]+"), F.lit(0)), lambda w: word_tokens(w, longest)))
    marks = F.regexp_extract_all(s, F.lit(r"(?U)\W+"), F.lit(0))
    return F.transform(F.concat(tokens, marks), lambda t: F.concat(F.lit("subject:"), t))


def recipient_bucket(field: str, header: Column) -> Column:
    """to:2**n for the number of comma-separated recipients."""
    n = F.size(F.split(header, ",")).cast("double")
    return F.concat(F.lit(f"{field}:2**"), F.bround(F.log2(n)).cast("long").cast("string"))


def x_mailer(header: Column) -> Column:
    return F.concat(F.lit("x-mailer:"), F.array_join(raw_words(F.lower(F.coalesce(header, F.lit("none")))), " "))


def received_tokens(header: Column) -> Column:
    """Complaints, the suffixes of the sending host and the prefixes of its address."""
    h = F.lower(F.array_join(raw_words(header), " "))
    complaints = F.regexp_extract_all(h, F.lit(COMPLAINT), F.lit(0))
    host, ip = F.regexp_extract(h, RELAY, 1), F.regexp_extract(h, RELAY_IP, 1)
    none = F.array().cast(NO_STRINGS)
    tail = F.when(host == "", none).otherwise(F.transform(F.sequence(F.lit(1), F.size(F.split(host, r"\."))), lambda i: F.array_join(F.slice(F.split(host, r"\."), -i, i), ".")))
    head = F.when(ip == "", none).otherwise(dotted_prefixes(ip))
    return F.transform(F.concat(complaints, tail, head), lambda t: F.concat(F.lit("received:"), t))


def dotted_prefixes(ip: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.array_join(F.slice(F.split(ip, r"\."), F.lit(1), i), "."))


def message_id_token(header: Column) -> Column:
    host = F.regexp_extract(F.coalesce(header, F.lit("")), MESSAGE_ID, 1)
    return F.when(host != "", F.concat(F.lit("message-id:@"), host)).otherwise("message-id:invalid")


def base_url(url: Column) -> Column:
    """The last two labels of the host, three where the top one is short."""
    domain = F.split(url, "/")[0]
    p = F.split(domain, r"\.")
    last = lambda i: F.element_at(p, -i)
    two = F.concat(F.try_element_at(p, F.lit(-2)), F.lit("."), last(1))
    return F.when(F.size(p) <= 2, domain).when(F.length(last(1)) < 3, F.concat(F.try_element_at(p, F.lit(-3)), F.lit("."), two)).otherwise(two)


def bigrams(tokens: Column) -> Column:
    """Each token, then ``bi:`` with its predecessor."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))  # neighbours are zipped: an index into tokens would evaluate them anew for each element
    pairs = F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.array(b, F.concat(F.lit("bi:"), a, F.lit(" "), b)))
    return F.concat(F.slice(tokens, 1, 1), F.flatten(pairs))


def linkless(words: Column) -> Column:
    """The words that are no addresses or links."""
    link = lambda w: F.contains(w, F.lit("@")) | (w == LINK_WORD)
    for p in LINKS:
        link = lambda w, link=link, p=p: link(w) | w.startswith(p)
    return F.filter(words, lambda w: ~link(w))


def clean_body(text: Column) -> Column:
    """A body without tags, digits, repeated space, URLs and addresses, for fuzzy checksums."""
    t = F.lower(F.regexp_replace(text, "<[^>]*>", ""))
    for pattern, by in CLEANING:
        t = F.regexp_replace(t, pattern, by)
    return F.array_join(linkless(F.split(t, " ")), " ")


def loose_lines(text: Column) -> Column:
    """The lines of several words of a body without tags, URLs and addresses, for loose checksums."""
    t = F.lower(F.regexp_replace(text, "<[^>]*>", ""))
    return F.filter(F.split(F.array_join(linkless(F.split(t, " ")), " "), "\n"), lambda line: F.contains(line, F.lit(" ")))


def quarters(lines: Column) -> Column:
    """Four digests of the quarters of an array of lines. Give a column: an expression would be evaluated for each quarter."""
    size = F.floor(F.size(lines) / 4).cast("int") + 1
    return F.array(*[F.md5(F.array_join(F.slice(lines, i * size + 1, size), "\n").cast("binary")) for i in range(4)])


def header_block(raw: Column) -> Column:
    """The text up to the first blank line, or nothing if no line of it is a header."""
    flat = F.replace(raw, F.lit("\r\n"), F.lit("\n"))
    head = F.regexp_extract(flat, r"(?s)^(.*?\n)(?:\n|$)", 1)
    return F.when(F.contains(head, F.lit(":")), head).otherwise("")
