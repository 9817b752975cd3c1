"""Interleaved document sequences with media payloads.

``interleave`` parses HTML into ordered items, each a piece of text or a media
reference with its caption. ``store_payloads`` keeps bytes losslessly as 8-bit
grey samples (PNG, 64 samples a row), once for each digest. ``resolve`` joins
references to stored payloads by digest; ``assemble`` puts resolved items back
into their documents in order.

Captions: all ``figcaption``s of a figure, before or behind its media, are the caption
of the media that are in this figure and in no captioned inner one; a figure without
media gives its caption as text, and ``alt`` is the caption where no other is. Scripts,
styles, titles, templates and ``noscript`` are left out with their media; what is never
closed, scripts and styles included, is read like any other element, so no text is lost. A ``picture`` is
one reference: its image, or its first source if it has none.

Defined results: null or empty HTML has no items; null bytes are stored as the
empty payload; a reference without a stored digest stays, with null payload
columns; repeated input rows give repeated output rows, and a digest is stored
once however often it occurs. Extra columns of the inputs are not carried.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unpaired.llm.common import keep, text_or_empty

ROW = 64
ITEM = "struct<pos:int,kind:string,text:string,src:string,digest:string,caption:string>"
_ITEM_TYPE = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("src", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
MEDIA = frozenset("img audio video source embed object".split())
SKIPPED = frozenset("script style title template noscript".split())
#: Elements whose content is only set apart if they are closed further on; else it is plain text.
CLOSED = ("script", "style", "title", "template", "noscript", "figcaption", "figure", "picture")


def _sources(tag: str, given: dict[str, str | None]) -> list[str]:
    """What a media element refers to: its source, else the first candidate of a set; a video's poster comes first."""
    first = given.get("data") if tag == "object" else given.get("src") or ((given.get("srcset") or "").split(",")[0].split() or [None])[0]
    return [x for x in (given.get("poster") if tag == "video" else None, first) if x]


class _Items(HTMLParser):
    """Collects items in document order; a figure's caption goes to the media of that very figure."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        #: Where the last end tag of each of these is; A-Z may be written either way.
        self.last = {tag: max((m.start() for m in re.finditer(f"</{tag}", html, re.IGNORECASE | re.ASCII)), default=-1) for tag in CLOSED}
        self.lines = [0, *(i + 1 for i, c in enumerate(html) if c == "\n")]
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skipped: list[str] = []
        #: Open figures: their media that have no caption yet, and their captions.
        self.figures: list[tuple[list[dict], list[str]]] = []
        self.caption: list[str] | None = None
        #: Sources of an open picture, of which its image is the one that counts.
        self.picture: list[tuple[str, str | None]] | None = None

    def set_cdata_mode(self, elem: str, *more: object, **named: object) -> None:
        if elem not in self.last or self.closes(elem):  # else its content is read as that of any element
            super().set_cdata_mode(elem, *more, **named)

    def closes(self, *tags: str) -> bool:
        """Whether an end tag of one of these follows."""
        line, offset = self.getpos()
        return max(self.last[t] for t in tags) > self.lines[line - 1] + offset

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.add("text", text=text)

    def add(self, kind: str, text: str | None = None, src: str | None = None, digest: str | None = None, caption: str | None = None) -> dict:
        self.items.append({"pos": len(self.items), "kind": kind, "text": text, "src": src, "digest": digest, "caption": caption})
        return self.items[-1]

    def end_caption(self) -> None:
        if self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            if caption and self.figures:
                self.figures[-1][1].append(caption)
            elif caption:  # outside of a figure: plain text
                self.add("text", text=caption)

    def end_figure(self) -> None:
        self.end_caption()
        self.flush()
        media, captions = self.figures.pop()
        if captions:
            for item in media:
                item["caption"] = " ".join(captions)
        elif self.figures:  # the outer figure may have one; the smaller list joins the larger
            outer, its_captions = self.figures[-1]
            small, large = sorted((media, outer), key=len)
            large.extend(small)
            self.figures[-1] = (large, its_captions)
        if captions and not media:
            self.add("text", text=" ".join(captions))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipped:
            if tag in self.skipped and tag != "title":
                self.skipped.append(tag)
            return
        if tag in SKIPPED:
            if self.closes(tag):
                self.skipped.append(tag)
            return
        if tag == "picture" and self.closes(tag):
            self.end_picture()
            self.picture = []
        if tag == "figure":
            self.end_caption()
            self.flush()
            self.figures.append(([], []))
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            if self.figures and self.closes("figcaption", "figure"):
                self.caption = []
        elif tag in BLOCKS or tag == "br":
            if self.caption is None:
                self.flush()
            else:
                self.caption.append(" ")
        if tag in MEDIA:
            given = dict(attrs)
            found = [(src, given.get("alt")) for src in _sources(tag, given)]
            if tag == "source" and self.picture is not None:
                self.picture.extend(found)
                return
            if tag == "img" and found:
                self.picture = None
            for src, alt in found:
                self.add_media(src, alt)

    def add_media(self, src: str, alt: str | None) -> None:
        if self.caption is None:
            self.flush()
        digest = re.search(r"sha256[-:]([0-9a-f]{64})$", src)
        item = self.add("media", src=src, digest=digest and digest[1], caption=alt)
        if self.figures:
            self.figures[-1][0].append(item)

    def end_picture(self) -> None:
        """A picture without an image is its first source."""
        sources, self.picture = self.picture, None
        if sources:
            self.add_media(*sources[0])

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag == self.skipped[-1]:
                self.skipped.pop()
            return
        if tag == "picture":
            self.end_picture()
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            if self.figures:
                self.end_figure()
        elif tag in BLOCKS:
            if self.caption is None:
                self.flush()
            else:
                self.caption.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            (self.text if self.caption is None else self.caption).append(data)

    def finish(self) -> list[dict]:
        self.close()
        self.end_picture()
        while self.figures:
            self.end_figure()
        self.end_caption()
        self.flush()
        return self.items


def parse_items(html: str | None) -> list[dict]:
    """The ordered items of one page."""
    parser = _Items(html or "")
    parser.feed(html or "")
    return parser.finish()


def interleave(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row for each page: ``key`` and its ordered ``items``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [parse_items(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, _ITEM_TYPE)], [key, "items"])

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key), F.col(html)).mapInArrow(parse, f"`{key}` {kind}, items array<{ITEM}>")


def references(sequences: DataFrame, key: str) -> DataFrame:
    """One row for each media item; ``n_text`` and ``n_media`` describe its sequence."""
    is_text = lambda x: x["kind"] == "text"
    return sequences.select(
        F.col(key),
        F.size(F.filter("items", is_text)).alias("n_text"),
        F.size(F.filter("items", lambda x: x["kind"] == "media")).alias("n_media"),
        F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("_item"),
    ).select(key, "n_text", "n_media", "_item.pos", "_item.src", "_item.digest", "_item.caption")


def padded(text: str) -> Column:
    """UTF-8 bytes with zero bytes up to a positive multiple of 64."""
    raw = F.encode(text_or_empty(text), "UTF-8")
    short = F.when(F.octet_length(raw) == 0, ROW).otherwise((ROW - F.octet_length(raw) % ROW) % ROW)
    return F.concat(raw, F.substring(F.lit(bytes(ROW)), F.lit(1), short))


def encode_png(payload: bytes) -> bytes:
    """8-bit grey PNG of 64 samples a row; ``payload`` is a multiple of 64 long."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    rows = np.zeros((len(samples), ROW + 1), np.uint8)
    rows[:, 1:] = samples
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", ROW, len(samples), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of a PNG made by :func:`encode_png`; checks every chunk."""
    at, data, high = 8, [], 0
    while at < len(media):
        (n,), name = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(name + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"damaged chunk {name!r}")
        if name == b"IHDR":
            high = struct.unpack_from(">II", body)[1]
        elif name == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(high, ROW + 1)
    return rows[:, 1:].tobytes()


def store_payloads(payloads: DataFrame, digest: str, payload: str) -> DataFrame:
    """``digest`` and ``media`` (PNG), one row for each digest.

    Copies meet first within each map task, so a digest that a third of all rows
    carry sends one row for each task.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [encode_png(x.as_py() or bytes(ROW)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["digest", "media"])

    encoded = payloads.select(F.col(digest).alias("digest"), F.col(payload).alias("payload")).mapInArrow(encode, "digest string, media binary")
    return encoded.groupBy("digest").agg(F.first("media").alias("media"))


def read_back(store: DataFrame) -> DataFrame:
    """Decodes each stored payload and computes what the samples show."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for stored in batch.column(1):
                media = stored.as_py()
                payload = decode_png(media)
                samples = np.frombuffer(payload, np.uint8)
                counts = np.bincount(samples, minlength=256)
                share = counts[counts > 0] / len(samples)
                entropy = float(-(share * np.log2(share)).sum())
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest())
                feature = f"{ROW}x{len(payload) // ROW};mean={samples.mean():.4f};distinct={len(share)};entropy={abs(entropy):.4f}"
                for column, value in zip(out, (*row, feature), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "samples"])

    return store.select("digest", "media").mapInArrow(probe, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, samples string")


def resolve(refs: DataFrame, store: DataFrame) -> DataFrame:
    """Each reference with the columns of ``store`` that its digest finds, else nulls.

    ``store`` has one row for each digest. When both sides are scans or shuffles of
    their own, adaptive execution splits the references of a hot digest.
    """
    found = store.withColumnRenamed("digest", "_digest")
    return refs.join(found, F.col("digest") == F.col("_digest"), "left").drop("_digest")


def assemble(sequences: DataFrame, key: str, store: DataFrame) -> DataFrame:
    """Documents with their items in order, media items with the stored ``media``."""
    items = sequences.select(F.col(key), F.monotonically_increasing_id().alias("_row"), "items")
    items = keep(items, "sequences")
    flat = items.select("_row", F.explode("items").alias("_item")).select("_row", "_item.*")
    full = resolve(flat, store.select("digest", "media"))
    gathered = full.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "text", "src", "digest", "caption", "media"))).alias("items"))
    return items.select("_row", key).join(gathered, "_row", "left").drop("_row")


def document_pages(documents: DataFrame) -> DataFrame:
    """``doc_id``, the HTML page of a document, and its payload with its digest.

    Each line is a paragraph; a figure refers to the payload by digest and has the
    first line as its caption.
    """
    safe = F.replace(F.replace(F.replace("_text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.replace(safe, F.lit("\n"), F.lit("</p><p>"))
    own = documents.select("doc_id", text_or_empty("text").alias("_text"), padded("text").alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    page = F.concat(
        F.lit("<article><p>"), lines, F.lit('</p><figure><img src="media:sha256-'), F.col("digest"), F.lit('"><figcaption>'),
        F.substring_index(safe, "\n", 1), F.lit("</figcaption></figure></article>"),
    )
    return own.select("doc_id", F.octet_length("_text").cast("long").alias("n_bytes"), page.alias("html"), "payload", "digest")


def document_media(documents: DataFrame) -> DataFrame:
    """The op1 rows: every document's payload, stored, found again and read back."""
    pages = document_pages(documents)
    store = keep(read_back(store_payloads(pages, "digest", "payload")), "payload-probe")
    sized = pages.select(F.struct("doc_id", "n_bytes").alias("page"), "html")
    refs = references(interleave(sized, "page", "html"), "page")
    feature = F.concat_ws(";", "samples", F.concat(F.lit("texts="), F.col("n_text")), F.concat(F.lit("pos="), F.col("pos")), F.concat(F.lit("caption="), F.crc32(F.encode("caption", "UTF-8"))))
    return resolve(refs, store).select(
        F.col("page.doc_id").alias("doc_id"), F.col("page.n_bytes").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"),
    )
