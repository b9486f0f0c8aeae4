"""WARC derivatives: metadata and plain-text conversion records of response records.

A response is a row ``record_id, target_uri, date, http, payload``: the record's URN, URI and date, its HTTP header
block and its HTML. Each gives one metadata record (the source's headers and digests, title and links, as JSON) and
one conversion record (the page's text), both naming the response they refer to.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
#: Pages tables have no crawl time.
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:foldwise:warc")
CRLF = "\r\n"

#: The rest of a tag: quoted values, of any length, hide their '>'.
_ATTRS = r"(?>[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+')|=)*+>"
_TOKEN = re.compile(rf"<!--|<![^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*+){_ATTRS}")
#: Elements without visible text: those of raw text run to their end tag or the page's end, the others nest.
_RAW, _NESTED = frozenset(["script", "style"]), frozenset(["noscript", "template", "svg"])
_CLOSE = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*+>", re.I) for n in (*_RAW, "title", "noframes")}
#: What a head may hold, besides those; anything else ends it.
_IN_HEAD = frozenset("base basefont bgsound head html link meta".split())
_BREAK = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()
)
_TITLE = re.compile(r"<title\b[^>]*+>", re.I)
_LINKING = frozenset("a link img script iframe area".split())
_LINK = re.compile(r"\s(href|src)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
#: A path from the root without dot segments is appended to scheme and host, as urljoin would do.
_ROOTED, _HOST = re.compile(r"/(?!/)(?:[^./?#;]|\.(?=[^./]))*\Z"), re.compile(r"https?://[^/?#]+")
#: Runs of blanks other than one plain space; runs of line ends and blanks.
_SPACE, _LINES = re.compile(r"[ \t\r\f\v\xa0]{2,}+|[\t\r\f\v\xa0]"), re.compile(r" \n[ \n]*+|\n[ \n]++")


def _last(page: str) -> int:
    """No tag ends after this place, so none is looked for there: an unclosed one would be read to the page's end each time."""
    return page.rfind(">") + 1


def to_text(page: str) -> str:
    """The page's visible text: one line a block, spaces collapsed, entities resolved."""
    page = page.replace("\n", " ")
    out, at, pairs, last = [], 0, {}, _last(page)
    while m := _TOKEN.search(page, at, last):
        name = m[2].lower() if m[2] else None
        out.append(page[at : m.start()])
        at = m.end()
        if name is None or (not m[1] and (name == "head" or name in _RAW or name in _NESTED)):
            at = _head_end(page, at, pairs) if name == "head" else _hidden_end(page, m, name, pairs)
            out.append(" ")
        elif name in _BREAK:
            out.append("\n")
    open_ = page.find("<!--", at)  # beyond the last tag: a comment to the page's end
    page = "".join(out) + (page[at:] if open_ < 0 else page[at:open_])
    if "&" in page:
        page = html.unescape(page)
    return _LINES.sub("\n", _SPACE.sub(" ", page)).strip()


def _hidden_end(page: str, m: re.Match, name: str | None, pairs: dict) -> int:
    """Where a comment, declaration or element without visible text ends; one that is never closed is its tag alone.

    ``pairs`` keeps, by name, where the elements that start at a place end.
    """
    if name is None:
        end = page.find("-->", m.end()) + 3 if m[0] == "<!--" else m.end()
        return end if end > 2 else len(page)
    if name in _RAW:
        close = _CLOSE[name].search(page, m.end(), _last(page))
        return close.end() if close else len(page)
    if name not in pairs:
        pairs[name], still_open = {}, []
        for t in _TOKEN.finditer(page, m.start(), _last(page)):
            if (t[2] or "").lower() != name:
                continue
            if not t[1]:
                if not (name == "svg" and t[0].endswith("/>")):
                    still_open.append(t.start())
            elif still_open:
                pairs[name][still_open.pop()] = t.end()
    return pairs[name].get(m.start(), m.end())


def _head_end(page: str, at: int, pairs: dict) -> int:
    """Where a head ends: after its end tag, which may be left out, or before what can only be in the body."""
    last = _last(page)
    while m := _TOKEN.search(page, at, last):
        name = m[2].lower() if m[2] else None
        if page[at : m.start()].strip():
            return at
        if m[1]:
            if name in ("body", "html", "br"):
                return m.start()
            at = m.end()
            if name == "head":
                return at
        elif name in ("title", "noframes"):
            close = _CLOSE[name].search(page, m.end(), last)
            at = close.end() if close else m.end()
        elif name is None or name in _RAW or name in ("noscript", "template"):
            at = _hidden_end(page, m, name, pairs)
        elif name in _IN_HEAD:
            at = m.end()
        else:
            return m.start()
    return at


def links(page: str, base: str | None) -> list[dict]:
    """Links in page order, resolved against the page's URI."""
    host = _HOST.match(base or "")
    out, root = [], host[0] if host else ""
    for tag in _TOKEN.finditer(page, 0, _last(page)):
        name = "" if tag[1] else (tag[2] or "").lower()
        m = _LINK.search(page, tag.end(2), tag.end()) if name in _LINKING else None
        if not m:
            continue
        url = html.unescape(m[2] or m[3] or m[4] or "").strip()
        if _ROOTED.match(url) and root:
            url = root + url
        else:
            try:
                url = urljoin(base or "", url)
            except ValueError:
                pass
        out.append({"path": f"{name.upper()}@/{m[1].lower()}", "url": url})
    return out


def title(page: str) -> str:
    last = _last(page)
    m = _TITLE.search(page, 0, last)
    close = _CLOSE["title"].search(page, m.end(), last) if m else None
    return _SPACE.sub(" ", html.unescape(page[m.end() : close.start()]).replace("\n", " ")).strip() if close else ""


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join('' if p is None else p for p in parts))}>"


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Pages as response records, ``page_id, record_id, target_uri, date, http, payload``.

    The record id is a name-based UUID of id, URI and payload, so reruns agree and rows that repeat are one record.
    """

    def run(batches):
        for b in batches:
            out = []
            for page, url, body in zip(b["page_id"], b["url"], b["html"]):
                body = body or ""
                size = len(body.encode("utf-8", "replace"))
                http = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}", "", ""])
                out.append((page, urn("response", str(page), url, body), url, date, http, body))
            yield pd.DataFrame(out, columns=["page_id", "record_id", "target_uri", "date", "http", "payload"])

    # ids go through pandas as strings: beside a null, whole numbers would be rounded to floats
    rows = pages.select(F.col(id_col).cast("long").cast("string").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInPandas(run, "page_id string, record_id string, target_uri string, date string, http string, payload string")
    return out.withColumn("page_id", F.col("page_id").cast("long"))


def _http_fields(http: str) -> tuple[str, dict]:
    status, *lines = http.split(CRLF)
    return status, {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def _derive(record_id: str, target_uri: str | None, date: str, http: str, payload: str, fields: dict | None = None) -> list[tuple]:
    """The two records of a response. Header fields and digests are the source record's own where it has them."""
    source = dict(fields or {})
    if "WARC-Block-Digest" in source and "WARC-Payload-Digest" in source:
        block_digest, payload_digest = source["WARC-Block-Digest"], source["WARC-Payload-Digest"]
    else:
        body = payload.encode("utf-8", "replace")
        block = http.encode("utf-8", "replace") + body
        block_digest, payload_digest = source.get("WARC-Block-Digest") or sha1(block), source.get("WARC-Payload-Digest") or sha1(body)
        source |= {"WARC-Block-Digest": block_digest, "WARC-Payload-Digest": payload_digest}
        source.setdefault("Content-Length", str(len(block)))
    own = {"WARC-Type": "response", "WARC-Record-ID": record_id, "WARC-Target-URI": target_uri, "WARC-Date": date, "Content-Type": "application/http; msgtype=response"}
    source = own | source
    status, headers = _http_fields(http)
    meta = {
        "Envelope": {
            "WARC-Header-Metadata": {k: v for k, v in source.items() if v is not None},
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {"Response-Message": status, "Headers": headers, "HTML-Metadata": {"Title": title(payload), "Links": links(payload, target_uri)}},
            },
        }
    }
    out = []
    for kind, mime, text in (("metadata", "application/json", json.dumps(meta, ensure_ascii=False)), ("conversion", "text/plain", to_text(payload))):
        data = text.encode("utf-8", "replace")
        own, digest = urn(kind, record_id), sha1(data)
        head = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", record_id)]
        head += [("WARC-Target-URI", target_uri), ("WARC-Date", date)] if target_uri else [("WARC-Date", date)]
        head += [("WARC-Source-Block-Digest", block_digest), ("WARC-Source-Payload-Digest", payload_digest)]
        head += [("WARC-Block-Digest", digest), ("Content-Type", mime), ("Content-Length", str(len(data)))]
        header = VERSION + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in head)
        out.append((kind, own, record_id, target_uri, date, mime, len(data), digest, payload_digest, header, text))
    return out


COLUMNS = "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_digest string, header string, block string"


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response: its metadata record and its conversion record.

    Null payloads count as empty, a null URI gives no WARC-Target-URI field, null dates and HTTP blocks take the
    default and the empty block. Rows that repeat give equal records. An empty table gives an empty result; a
    ``page_id`` is carried along, other columns are ignored. With a map ``fields`` of the source record's header, as
    :func:`from_warc` gives, all its fields go into the metadata and its digests are told as they are.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for page, record_id, uri, date, http, payload, fields in zip(b["page_id"], b["record_id"], b["target_uri"], b["date"], b["http"], b["payload"], b["fields"]):
                fields = None if fields is None else dict(fields)
                out += [(page, *x) for x in _derive(record_id or urn("response", uri, payload), uri, date or DATE, http or "", payload or "", fields)]
            yield pd.DataFrame(out, columns=["page_id", *names])

    page = F.col("page_id").cast("long").cast("string") if "page_id" in records.columns else F.lit(None).cast("string")
    fields = F.col("fields") if "fields" in records.columns else F.lit(None)
    rows = records.select(page.alias("page_id"), "record_id", "target_uri", "date", "http", "payload", fields.cast("map<string,string>").alias("fields"))
    return rows.mapInPandas(run, f"page_id string, {COLUMNS}").withColumn("page_id", F.col("page_id").cast("long"))


def response_records(records: DataFrame) -> DataFrame:
    """Response rows as ``header, block`` for :func:`write_warc`."""

    @F.pandas_udf("header string, block string")
    def built(record_id: pd.Series, uri: pd.Series, date: pd.Series, http: pd.Series, payload: pd.Series) -> pd.DataFrame:
        out = []
        for r, u, d, h, p in zip(record_id, uri, date, http, payload):
            block = (h or "") + (p or "")
            head = [("WARC-Type", "response"), ("WARC-Record-ID", r), *([("WARC-Target-URI", u)] if u else []), ("WARC-Date", d or DATE)]
            head += [("WARC-Payload-Digest", sha1((p or "").encode("utf-8", "replace"))), ("WARC-Block-Digest", sha1(block.encode("utf-8", "replace")))]
            head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block.encode("utf-8", "replace"))))]
            out.append((VERSION + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in head), block))
        return pd.DataFrame(out, columns=["header", "block"])

    return records.select(built("record_id", "target_uri", "date", "http", "payload").alias("r")).select("r.*")


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write ``header, block`` rows as WARC files, one a partition; each record ends with two line breaks."""
    out = records.select(F.concat("header", F.lit(CRLF), "block").alias("value"))
    out.write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """WARC files (1.0 or 1.1) as ``warc_type, record_id, fields, block``, streamed record by record; ``block`` is binary.

    Files are cut where a version line starts, and a piece that ends before its record's Content-Length goes on in
    the next, so payloads may hold version lines (compressed files are read by one task each; in an uncompressed one
    such a record has to lie within an input split). Bytes are kept as they are.
    """
    raw = spark.read.option("lineSep", "WARC/1.").text(path)
    raw = raw.select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("value"))

    def parsed(batches):
        file, record = None, None  # record: fields, parts of the block, bytes still to come

        def finished():
            fields, parts, left = record
            data = b"".join(parts)
            return fields.get("WARC-Type"), fields.get("WARC-Record-ID"), fields, data[:left] if left < 0 else data

        for b in batches:
            out = []
            for name, value in zip(b["file"], b["value"]):
                value = bytes(value)
                if record and name == file and record[2] > 0:
                    record[1].append(b"WARC/1." + value)
                    record[2] -= len(value) + 7
                    continue
                if record:
                    out.append(finished())
                    record = None
                file = name
                head, cut, rest = value.partition(b"\r\n\r\n")
                if not cut:  # nothing before the first version line
                    continue
                lines = head.decode("utf-8", "replace").split(CRLF)[1:]
                fields = {k.strip(): x.strip() for k, _, x in (line.partition(":") for line in lines) if k.strip()}
                record = [fields, [rest], int(fields.get("Content-Length") or 0) - len(rest)]
            yield pd.DataFrame(out, columns=["warc_type", "record_id", "fields", "block"])
        if record:
            yield pd.DataFrame([finished()], columns=["warc_type", "record_id", "fields", "block"])

    return raw.mapInPandas(parsed, "warc_type string, record_id string, fields map<string,string>, block binary")


_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


def from_warc(read: DataFrame) -> DataFrame:
    """Response rows with ``fields`` for :func:`derivatives` from :func:`read_warc`'s rows.

    Payloads are decoded by the charset of the HTTP header, else UTF-8; bytes that don't fit are replaced. The
    digests in ``fields`` remain those of the source's bytes.
    """

    @F.pandas_udf("http string, payload string")
    def split(blocks: pd.Series) -> pd.DataFrame:
        out = []
        for block in blocks:
            head, cut, body = bytes(block or b"").partition(b"\r\n\r\n")
            http = (head + cut).decode("utf-8", "replace") if cut else ""
            body = body if cut else head
            named = _CHARSET.search(_http_fields(http)[1].get("Content-Type", ""))
            try:
                out.append((http, body.decode(named[1] if named else "utf-8", "replace")))
            except LookupError:
                out.append((http, body.decode("utf-8", "replace")))
        return pd.DataFrame(out, columns=["http", "payload"])

    field = lambda k: F.col("fields")[k]
    rows = read.where("warc_type = 'response'").select("record_id", field("WARC-Target-URI").alias("target_uri"), field("WARC-Date").alias("date"), split("block").alias("r"), "fields")
    return rows.select("record_id", "target_uri", "date", "r.http", "r.payload", "fields")
