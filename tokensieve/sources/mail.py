"""Reading mail: folders, mbox files and Maildirs as binary rows, and one parser for RFC 822 messages."""

from __future__ import annotations

import email
import email.policy
import email.utils
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<ctype:string,kind:string,charsets:array<string>,disposition:string,filename:string,leaf:boolean,size:long,head:string>"
PARSED = f"msg_id string, headers array<struct<name:string,value:string>>, body string, parts array<struct<ctype:string,charset:string,disposition:string,filename:string,size:long>>, error string, nodes array<{NODE}>, bodies array<string>, addresses array<string>, recipients array<string>"
#: The headers whose addresses become tokens, and how much of a node's content is kept.
ADDRESS_HEADERS = ["from", "to", "cc", "sender", "reply-to"]
HEAD = 5


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(msg_id, raw) of every file below a folder, whatever it is: text trees, Maildir and MH folders."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("msg_id"), F.col("content").alias("raw"))


def split_mbox(files: DataFrame) -> DataFrame:
    """(msg_id, raw) of the messages in mbox files (msg_id, raw); ids get the message's number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, raw in zip(pdf["msg_id"], pdf["raw"], strict=True):
                parts = re.split(rb"(?m)^From [^\n]*\n", bytes(raw))
                rows += [(f"{name}#{i}", p) for i, p in enumerate(parts[1:])]
            yield pd.DataFrame(rows, columns=["msg_id", "raw"])

    return files.mapInPandas(run, "msg_id string, raw binary")


def kind_of(spark: SparkSession, path: str) -> str:
    """What a path holds: a folder with cur is a Maildir, one below /Mail/ an MH folder, any other a tree of files; a file is an mbox."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.getFileStatus(p).isDirectory():
        return "mbox"
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "cur")):
        return "maildir"
    return "mh" if "/Mail/" in path else "files"


def read_messages(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(msg_id, raw) of a mailbox: kind is files, mbox, maildir or mh, and found out from the path unless named. Of a tree, .emlx files are unwrapped."""
    kind = kind or kind_of(spark, path)
    if kind == "mbox":
        return split_mbox(read_files(spark, path))
    rows = read_files(spark, path, "[0-9]*" if kind == "mh" else "*")
    if kind == "maildir":
        return rows.where(F.col("msg_id").rlike("/(cur|new)/"))
    if kind == "mh":
        return rows
    wrapped = F.col("msg_id").endswith(".emlx")
    return rows.where(~wrapped).unionByName(unwrap_emlx(rows.where(wrapped)))


def labelled_messages(spark: SparkSession, ham: list[str], spam: list[str], keep: int | None = None, seed: int = 0) -> DataFrame:
    """(msg_id, raw, directory, is_spam) of the mailboxes of both classes; of each directory all messages, or ``keep`` by seeded digest."""
    from tokensieve.operators.corpus import sample_keep

    out = None
    for paths, label in ((ham, False), (spam, True)):
        for p in paths:
            rows = read_messages(spark, p).select("msg_id", "raw", F.lit(p).alias("directory"), F.lit(label).alias("is_spam"))
            out = rows if out is None else out.unionByName(rows)
    return out if keep is None else sample_keep(out, "directory", "msg_id", keep, seed)


def unwrap_emlx(files: DataFrame) -> DataFrame:
    """Length-prefixed messages without their first line and trailer."""
    at = F.expr("position(x'0A' IN raw)")
    size = F.trim(F.decode(F.expr("substring(raw, 1, position(x'0A' IN raw) - 1)"), "ISO-8859-1")).cast("int")
    return files.select("msg_id", F.substring("raw", at + 1, size).alias("raw"))


def clean_mbox(text):
    """Stray ``From `` lines inside messages escaped."""
    return F.regexp_replace(text, r"(?m)^From (?!\S+ +(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) )", ">From ")


def _node(p) -> dict:
    leaf = not p.is_multipart()
    data = (p.get_payload(decode=True) or b"") if leaf else b""
    kind, disposition = p.get_param("type"), p.get("content-disposition")
    low = lambda x: None if x is None else str(x).lower()
    return {"ctype": p.get_content_type(), "kind": low(kind), "charsets": [str(c).lower() for c in p.get_charsets(None) if c is not None], "disposition": low(disposition), "filename": p.get_filename(), "leaf": leaf, "size": len(data), "head": data[:HEAD].decode("latin-1")}


def _parse(raw: bytes) -> tuple:
    """The columns of parse but for msg_id."""
    text = raw.decode("latin-1")
    try:
        m = email.message_from_bytes(raw, policy=email.policy.compat32)
        heads = [{"name": k, "value": str(v)} for k, v in m.items()]
        if not heads:
            return [], text, [], None, [], [text], [], []
        parts, bodies = [], []
        for p in m.walk():
            if p.is_multipart():
                continue
            data = p.get_payload(decode=True) or b""
            parts.append({"ctype": p.get_content_type(), "charset": p.get_content_charset(), "disposition": p.get_content_disposition(), "filename": p.get_filename(), "size": len(data)})
            if p.get_content_maintype() == "text":
                bodies.append(data.decode("latin-1"))
        found = [t for f in ADDRESS_HEADERS for t in address_parts(f, [str(v) for v in m.get_all(f, [])])]
        to = [a.lower() for _, a in email.utils.getaddresses([str(v) for f in ("to", "cc") for v in m.get_all(f, [])])]
        return heads, "\n".join(bodies), parts, None, [_node(p) for p in m.walk()], bodies, found, to
    except Exception as e:  # the parser may fail in many ways on hostile mail: what follows the headers is its text
        rest = re.split(r"\r?\n\r?\n", text, maxsplit=1)[-1]
        return [], rest, [], f"{type(e).__name__}: {e}", [], [rest], [], []


def parse(messages: DataFrame) -> DataFrame:
    """Headers, decoded text parts, MIME nodes and address tokens of each raw message; text is decoded as Latin-1.

    A message that cannot be parsed keeps the text after its headers as body, has no headers, and says why in ``error``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(i, *_parse(bytes(r))) for i, r in zip(pdf["msg_id"], pdf["raw"], strict=True)]
            yield pd.DataFrame(rows, columns=["msg_id", "headers", "body", "parts", "error", "nodes", "bodies", "addresses", "recipients"])

    return messages.mapInPandas(run, PARSED)


def header(name: str):
    """The first header of that name, in any case, of a parsed message."""
    return F.get(F.filter("headers", lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def address_parts(field: str, values: list[str]) -> list[str]:
    """Tokens of the values of an address header: names, addresses and the number of nameless ones."""
    import math

    if not any(values):
        return [f"{field}:none"]
    out, nameless = [], 0
    for name, addr in email.utils.getaddresses(values):
        if name:
            out += [f"{field}:name:{w.lower()}" for w in name.split()]
        else:
            nameless += 1
        out += [f"{field}:addr:{w}" for w in addr.lower().split("@")] if addr else [f"{field}:addr:none"]
    return out + ([f"{field}:no real name:2**{round(math.log2(nameless))}"] if nameless else [])


def address_tokens(rows: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """key, token: the tokens of an address header."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(k, t) for k, v in zip(pdf["k"], pdf["v"], strict=True) for t in address_parts(field, [v] if v else [])], columns=[key, "token"])

    return rows.select(F.col(key).alias("k"), F.col(value).alias("v")).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, token string")


def form_message(fields: dict):
    """A MIME-like text built from named columns: a header line for each and a synthetic body."""
    return F.concat_ws("\r\n", *[F.concat(F.lit(f"X-Form-{k}: "), c.cast("string")) for k, c in fields.items()], F.lit(""), F.concat_ws("\r\n", *[c.cast("string") for c in fields.values()]))
