"""Media columns: HTML as ordered text and media references, payloads stored once and joined by digest.

Media are grey images of 8-bit samples, 64 in a row (binary PGM), which hold any bytes losslessly;
the number of bytes before padding is a comment in the header. Stored media carry the SHA-256 of
their stored form as digest. References are resolved by joining that digest with what was read back
from the store: only measurements are shuffled, never payloads.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy, join_split, materialize, plain, texts, tune

WIDTH = 64
_HEADER = re.compile(rb"P5\n# bytes (\d+)\n64 (\d+)\n255\n")
#: Elements whose text is not read, and those that end a piece of text.
_SILENT, _BLOCK = {"script", "style", "template", "noscript"}, {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "ul", "ol", "table"}
SEQUENCE = "array<struct<position: int, kind: string, text: string, ref: string, caption: string>>"


def _ref(a: dict) -> str | None:
    """The medium that an element shows: src, else what scripts would load later, else the first of its sizes."""
    sizes = (a.get("srcset") or a.get("data-srcset") or "").split(",")[0].split()
    return next((x.strip() for x in (a.get("src"), a.get("data-src"), *sizes[:1]) if x and x.strip()), None)


class _Reader(HTMLParser):
    """Items in page order. A figure's captions, wherever in it they stand, go to its media when it ends; figures may be nested.

    A caption ends with its element, its figure or the page. Captions that no medium takes are text,
    and so is what follows the first block of a caption that only the end of the page closes.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.said: list[str] = []
        self.silent = 0
        self.figures: list[tuple[int, list[str]]] = []  # where each open one begins, and its captions
        self.caption: list[list[str]] | None = None  # blocks of the open one

    def text(self, said: str) -> None:
        if said:
            self.out.append({"kind": "text", "text": said, "ref": None, "caption": None})

    def flush(self) -> None:
        self.text(" ".join("".join(self.said).split()))
        self.said = []

    def block(self) -> None:
        if self.caption is None:
            self.flush()
        else:
            self.caption.append([])

    def medium(self, ref: str | None, alt: str | None) -> None:
        if ref:
            self.flush()
            self.out.append({"kind": "media", "text": None, "ref": ref, "caption": alt or None, "own": False})

    def end_caption(self, whole: bool = True) -> None:
        if self.caption is None:
            return
        blocks = [x for part in self.caption if (x := " ".join("".join(part).split()))]
        self.caption = None
        said = " ".join(blocks) if whole else (blocks or [""])[0]
        if self.figures and said:
            self.figures[-1][1].append(said)
        else:
            self.text(said)
        for x in () if whole else blocks[1:]:
            self.text(x)

    def end_figure(self) -> None:
        start, captions = self.figures.pop()
        said = " ".join(captions)
        takers = [x for x in self.out[start:] if x["kind"] == "media" and not x["own"]] if said else []
        for x in takers:
            x["caption"], x["own"] = said, True
        if not takers:
            self.text(said)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SILENT:
            self.silent += 1
        if tag in _BLOCK:
            self.block()
        if tag == "figure":
            self.end_caption()
            self.figures.append((len(self.out), []))
        if tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = [[]]
        if tag in ("img", "audio", "video", "source"):
            a = dict(attrs)
            self.medium(a.get("poster"), None)
            self.medium(_ref(a), a.get("alt"))

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT and self.silent:
            self.silent -= 1
        if tag == "figcaption" or tag == "figure" and self.figures:
            self.end_caption()
        if tag in _BLOCK:
            self.block()
        if tag == "figure" and self.figures:
            self.end_figure()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.said if self.caption is None else self.caption[-1]).append(data)

    def end(self) -> list[dict]:
        self.close()
        self.flush()
        self.end_caption(whole=False)
        while self.figures:
            self.end_figure()
        return [{"position": k, **{c: x[c] for c in ("kind", "text", "ref", "caption")}} for k, x in enumerate(self.out)]


def sequence(page: str | None) -> list[dict]:
    """Text and media of a page in order; a figure's captions go to its media. Null or empty: nothing."""
    reader = _Reader()
    reader.feed(page or "")
    return reader.end()


def _read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([sequence(x) for x in b.column("html").to_pylist()], kind)], names=["id", "sequence"])


def sequences(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """id and the interleaved sequence of each page."""
    tune(pages.sparkSession)
    return plain(pages, key, column).select(F.col(key).cast("long").alias("id"), F.col(column).cast("string").alias("html")).mapInArrow(_read_pages, f"id long, sequence {SEQUENCE}")


def to_media(data: bytes) -> bytes:
    """data, with zeros up to a positive multiple of WIDTH, as a grey image."""
    rows = max(1, -(-len(data) // WIDTH))
    return b"P5\n# bytes %d\n64 %d\n255\n" % (len(data), rows) + data.ljust(rows * WIDTH, b"\0")


def from_media(media: bytes) -> tuple[int, bytes]:
    """The number of bytes before padding, and the padded bytes."""
    m = _HEADER.match(media)
    if not m or len(media) - m.end() != WIDTH * int(m[2]):
        raise ValueError("not a stored medium")
    return int(m[1]), media[m.end() :]


def feature(samples: bytes) -> str:
    """Mean, deviation and a 16-bin histogram in thousandths."""
    x = np.frombuffer(samples, np.uint8)
    count = np.bincount(x, minlength=256)
    at = np.arange(256)
    mean = float((count * at).sum() / len(x))
    dev = float(np.sqrt(max(0.0, (count * at * at).sum() / len(x) - mean * mean)))
    return f"{mean:.3f};{dev:.3f};" + ",".join(str(v) for v in (count.reshape(16, 16).sum(axis=1) * 1000 // len(x)).tolist())


#: A document's page: a heading, its medium with a caption, and a closing text, in this order.
_PAGE = '<article><h1>{0}</h1><figure><img src="sha256:{1}" alt="old"><figcaption>{0}</figcaption></figure><p>end of {0}</p></article>'


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media = [to_media((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
        digest = [hashlib.sha256(m).hexdigest() for m in media]
        page = [_PAGE.format(html.escape(str(i)), d) for d, i in zip(digest, b.column("doc_id").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(page), pa.array(digest), pa.array(media, pa.binary())], names=["doc_id", "html", "digest", "media"])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for b in batches:
        out: list[list] = [[] for _ in names]
        for digest, media in zip(b.column("digest").to_pylist(), b.column("media").to_pylist()):
            n, payload = from_media(media)
            for column, v in zip(out, (digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (0, 3, 6, 7) else pa.int64()) for k, c in enumerate(out)], names=names)


_MEASURES = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}


def measurements(store: DataFrame) -> DataFrame:
    """One row per digest of a store (digest, media): what the stored bytes measure when read back, and the rows that have it as c."""
    tune(store.sparkSession)
    found = store.select("digest", "media").mapInArrow(_measure, "digest string, " + ", ".join(f"{k} {v}" for k, v in _MEASURES.items()))
    return found.groupBy("digest").agg(F.count("*").alias("c"), *[F.first(k).alias(k) for k in _MEASURES])


def resolve(found: DataFrame, store: DataFrame) -> DataFrame:
    """Every item of sequences(): id, position, kind, text, caption, and of media references the measurements; unknown digests give nulls.

    Texts stay where they are. References are joined by digest; of digests that very many share,
    fewer than common.HEAVY, the measurements are broadcast.
    """
    ref = F.when((F.col("x.kind") == "media") & F.col("x.ref").startswith("sha256:"), F.substring("x.ref", 8, 64))
    items = materialize(found.select("id", F.explode("sequence").alias("x")).select("id", "x.position", "x.kind", "x.text", "x.ref", "x.caption", ref.alias("digest")), "items")
    measured = materialize(measurements(store), "measured")
    refs = items.where("digest is not null")
    common = heavy(refs.groupBy("digest").agg(F.count("*").alias("c")), ["digest"], "c", refs.count())
    known = join_split(refs, measured.drop("c"), ["digest"], common, "left")
    return known.unionByName(items.where("digest is null"), allowMissingColumns=True).drop("digest")


def text_media(docs: DataFrame) -> DataFrame:
    """Each row's whole text as a stored medium, which a page of text, medium and text refers to, resolved by digest.

    One row for each row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, position and caption of the medium in its page. Null and
    empty texts give a medium of 64 zeros. Equal texts share a digest, and so all values but the
    caption, which is the doc_id. Repeated rows give equal rows; rows without a doc_id stay.
    """
    tune(docs.sparkSession)
    stored = materialize(texts(docs).mapInArrow(_store, "doc_id long, html string, digest string, media binary"), "media")
    found = resolve(sequences(stored, "doc_id"), stored).where("kind = 'media'")
    return found.select(F.col("id").alias("doc_id"), *_MEASURES, "position", "caption")


def page_items(pages: DataFrame) -> DataFrame:
    """page_id, position, kind, text, ref and caption of what each page shows, in order. Null and empty pages have none."""
    return sequences(pages).select(F.col("id").alias("page_id"), F.explode("sequence").alias("x")).select("page_id", "x.*")
