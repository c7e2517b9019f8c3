"""Interleaved document sequences: ordered text and media references of pages, and media columns that they join by digest.

A payload is stored losslessly as an 8-bit grey PNG image of 192 samples a row, in a binary column next to its
digest. HTML parsing gives each page's texts, references and captions with their positions; a join on the
digest resolves the references.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from caseweave.llm.common import hot_rows, join_hot, stage
from caseweave.llm.html_scan import BLOCK, RAW, attributes, events

ROW = 192
TAIL = 16
ELEMENT = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
FACTS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: bytes) -> bytes:
    """The payload of a text: spaces (32) up to a positive multiple of the row."""
    return text + b" " * (max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A PNG image whose samples are the payload (a positive multiple of the row)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png made; damaged chunks raise ValueError."""
    if image[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, data, size = 8, [], None
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not read here")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, and which of 64 equal stretches lie above the mean (16 hexadecimal digits)."""
    x = np.frombuffer(payload, np.uint8)
    edges = np.arange(64) * len(x) // 64
    means = np.add.reduceat(x, edges, dtype=np.int64) / np.diff(np.append(edges, len(x)))
    bits = int.from_bytes(np.packbits(means > x.mean()).tobytes(), "big")
    return f"mean={x.mean():.3f};sd={x.std():.3f};above={bits:016x}"


def store_texts(docs: DataFrame) -> DataFrame:
    """Write every text's payload to the media store: doc_id, n_bytes, digest (sha256 of the payload), media. One row a row of docs (doc_id, text; a null text is empty)."""

    def encode(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("media", pa.binary())])
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast("binary")
            for a in range(0, len(ids), 256):
                rows = []
                for k in range(a, min(a + 256, len(ids))):
                    raw = texts[k].as_py() or b""
                    payload = padded(raw)
                    rows.append({"doc_id": ids[k], "n_bytes": len(raw), "digest": hashlib.sha256(payload).hexdigest(), "media": to_png(payload)})
                yield pa.RecordBatch.from_pylist(rows, schema)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(plain.mapInArrow(encode, "doc_id long, n_bytes long, digest string, media binary"), "media", "none")


def store_facts(store: DataFrame) -> DataFrame:
    """What reading back each stored medium (digest, media) gives; a row for each digest, with `copies`, the times it is stored."""

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        for batch in batches:
            rows = []
            for digest, image in zip(batch.column("digest").to_pylist(), batch.column("media"), strict=True):
                image = image.as_py()
                payload = from_png(image)
                found = hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"stored medium {digest} reads back as {found}")
                rows.append({"digest": digest, "payload_bytes": len(payload), "payload_sha256": found, "tail_crc32": zlib.crc32(payload[-TAIL:]), "media_bytes": len(image), "media_sha256": hashlib.sha256(image).hexdigest(), "feature": feature(payload)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    facts = store.select("digest", "media").mapInArrow(read, FACTS)
    names = [f.name for f in facts.schema if f.name != "digest"]
    return facts.groupBy("digest").agg(F.count("*").alias("copies"), *(F.min(n).alias(n) for n in names))


def page_elements(page: str | None) -> list[dict]:
    """Texts and media references of a page in order. The caption of a reference is its figure's figcaption, else its alt text, else null."""
    found: list[dict] = []
    text: list[str] = []
    figures: list[list[dict]] = []
    caption: list[str] | None = None

    def flush():
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            found.append({"kind": "text", "text": line, "ref": None, "caption": None})

    for kind, *x in events(page or ""):
        if kind == "text":
            (text if caption is None else caption).append(x[0])
        elif kind == "start" and x[0] in ("img", "video", "audio", "source", "embed"):
            a = attributes(x[1])
            if a.get("src"):
                flush()
                item = {"kind": "media", "text": None, "ref": a["src"].strip(), "caption": " ".join(a.get("alt", "").split()) or None}
                found.append(item)
                if figures:
                    figures[-1].append(item)
        elif x[0] == "br" or x[0] in RAW:
            text.append(" ")
        elif x[0] in BLOCK:
            if x[0] == "figcaption":
                if kind == "start":
                    flush()
                    caption = []
                elif caption is not None:
                    line = " ".join("".join(caption).split())
                    for item in figures[-1] if figures else []:
                        item["caption"] = line or item["caption"]
                    caption = None
            else:
                flush()
            if x[0] == "figure":
                if kind == "start":
                    figures.append([])
                elif figures:
                    figures.pop()
    flush()
    return [{"position": k, **item} for k, item in enumerate(found)]


def interleave(pages: DataFrame) -> DataFrame:
    """Replace the column html of pages by `elements`, the ordered texts and media references (none for null or empty html). Other columns are kept."""
    others = [c for c in pages.columns if c != "html"]

    def parse(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            yield batch.select(others).append_column("elements", pa.array([page_elements(x) for x in batch.column("html").to_pylist()], kind))

    return pages.mapInArrow(parse, pages.select(*others).schema.add("elements", DataType.fromDDL(ELEMENT)))


def resolve(sequences: DataFrame, facts: DataFrame, references: int) -> DataFrame:
    """A row for each element of sequences, in `position`, with the facts of its medium (null for texts and for digests not in the store).

    A reference is "sha256:" and the digest. Digests stored for a thousandth of all `references` or more are joined by broadcast.
    """
    flat = sequences.withColumn("_e", F.explode("elements")).select(*(c for c in sequences.columns if c != "elements"), "_e.*")
    flat = flat.withColumn("digest", F.when(F.col("ref").startswith("sha256:"), F.substring("ref", 8, 64)))
    return join_hot(flat, facts, "digest", F.col("copies"), hot_rows(references))


def text_media(docs: DataFrame) -> DataFrame:
    """Store every text as a medium, refer to it from a page of its own, read the pages and the store back, and join them: a row for each row of docs."""
    store = store_texts(docs)
    page = F.concat(F.lit('<article><p>Document</p><figure><img src="sha256:'), "digest", F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    pages = store.select("doc_id", "n_bytes", page.alias("html"))
    return resolve(interleave(pages), store_facts(store), store.count()).where(F.col("kind") == "media")
