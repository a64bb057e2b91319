"""Media columns: documents as ordered sequences of text and media references,
whose payloads a join on digests resolves."""

from __future__ import annotations

import hashlib
import html as markup
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.llm.common import chunks, few, table, tidied, utf8
from arbor.session import ship, written

UNIT = 576
#: Bytes at the end of the payload that the tail's checksum covers.
TAIL = 32
SCHEME = "media:sha256:"
#: Digests that a task remembers.
KNOWN_DIGESTS = 500_000

_MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed", "object": "object"}
#: What may stand in a head; any other tag ends one whose end tag is left out.
_HEAD = {"html", "head", "title", "base", "link", "meta", "style", "script", "noscript", "template"}
#: Attributes of a media tag that refer to media, besides lists of candidates and a video's poster.
_REFERENCES = ("src", "data-src")
_LISTS = ("srcset", "data-srcset")
_SILENT = {"script", "style", "template", "noscript"}
_BREAK = {"p", "div", "article", "section", "li", "ul", "ol", "br", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "figure", "blockquote", "nav", "header", "footer"}


def _candidates(value: str) -> list[str]:
    """The URLs of a srcset: each up to white space, or a comma at its end."""
    out, rest = [], value.lstrip(" \t\r\n\f,")
    while rest:
        url, *rest = rest.split(None, 1)
        rest = rest[0] if rest else ""
        if url.endswith(","):
            url = url.rstrip(",")
        else:
            rest = rest.partition(",")[2]
        if url:
            out.append(url)
        rest = rest.lstrip(" \t\r\n\f,")
    return out


def _found(tag: str, attrs: dict) -> list[tuple[str, str]]:
    """Kind and reference of each medium that a tag refers to, once each."""
    out = [(_MEDIA[tag], attrs.get(a)) for a in (("data",) if tag == "object" else _REFERENCES)]
    out += [(_MEDIA[tag], url) for a in _LISTS for url in _candidates(attrs.get(a) or "")]
    if tag == "video":
        out.append(("image", attrs.get("poster")))
    return list(dict.fromkeys((kind, ref) for kind, ref in out if ref))


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.head = False
        self.caption: list[str] | None = None
        self.figure: list[int] | None = None

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"pos": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.head = True
        elif self.head and not self.silent and tag not in _HEAD:
            self.head = False
        if tag in _SILENT:
            self.silent += 1
        if tag in _BREAK or tag in _MEDIA or tag == "figcaption":
            self.flush() if self.caption is None else self.caption.append(" ")
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA:
            found = dict(attrs)
            for kind, ref in _found(tag, found):
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append({"pos": len(self.items), "kind": kind, "text": None, "ref": ref, "caption": found.get("alt")})

    def handle_endtag(self, tag):
        if tag == "head":
            self.head = False
        elif tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            for i in self.figure or []:
                self.items[i]["caption"] = said
            if not self.figure and said:
                self.words.append(said)
            self.caption = None
        elif tag == "figure":
            self.flush()
            self.figure = None
        elif tag in _BREAK and self.caption is None:
            self.flush()

    def handle_data(self, data):
        if not self.silent and not self.head:
            (self.words if self.caption is None else self.caption).append(data)


def parse(text: str | None) -> list[dict]:
    """A page's texts and media references in their order: pos, kind, text,
    ref, caption (the figcaption of the reference's figure, else its alt)."""
    p = _Sequence()
    p.feed(text or "")
    p.close()
    p.flush()
    return p.items


ITEM = "struct<pos:int,kind:string,text:string,ref:string,caption:string>"
_ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])


def sequences(pages: DataFrame, key: str, column: str, first=None, made: dict[str, str] | None = None) -> DataFrame:
    """key and items of each row. A null or empty page has no items; repeated
    rows and null keys give a row each; other columns are ignored. first, if
    given, makes the pages of batches of (key, _html) in the same task, with the
    columns made, name -> type, beside them."""
    ship(pages.sparkSession)
    columns = [key, *(made or {})]

    def run(batches):
        for b in batches if first is None else first(batches):
            for i, j in chunks(utf8(b.column("_html"))[1], 1 << 20):
                items = [parse(t) for t in b.column("_html").slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in columns), pa.array(items, pa.list_(_ITEM))], names=[*columns, "items"])

    rows = pages.select(key, F.col(column).cast("string").alias("_html"))
    kinds = {key: rows.schema[0].dataType.simpleString()} | (made or {})
    return rows.mapInArrow(tidied(run), ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + f", items array<{ITEM}>")


def references(found: DataFrame, key: str, *keep: str) -> DataFrame:
    """A row for each media reference by digest: key, the columns keep, how many
    items its row has, pos, digest, caption."""
    media = F.filter("items", lambda x: x["ref"].startswith(SCHEME))
    item = found.select(key, *keep, F.size("items").cast("long").alias("items"), F.explode(media).alias("i"))
    return item.select(key, *keep, "items", F.col("i.pos").cast("long").alias("pos"), F.substring("i.ref", len(SCHEME) + 1, 64).alias("digest"), "i.caption")


#: A digest that so many tasks have stored is frequent; its references are dealt over so many.
FREQUENT, SALTS = 8, 64


def resolve(refs: DataFrame, store: DataFrame, frequent: DataFrame | None = None) -> DataFrame:
    """References with the columns of store that are beside its digest; a
    digest that is not in store gives nulls. Copies of a digest in store count
    once, so no reference is doubled. The references of the digests in
    frequent(digest) are dealt over several tasks, each with the digest's one row."""
    once = store.dropDuplicates(["digest"])
    if frequent is None:
        return refs.join(once, "digest", "left")
    marked = few(frequent.select("digest", F.lit(True).alias("_often")))
    salt = F.pmod(F.xxhash64(*refs.columns), F.lit(SALTS)).cast("int")
    dealt = refs.join(marked, "digest", "left").withColumn("_salt", F.when(F.col("_often"), salt).otherwise(0)).drop("_often")
    salts = F.when(F.col("_often"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    once = once.join(marked, "digest", "left").withColumn("_salt", F.explode(salts)).drop("_often")
    return dealt.join(once, ["digest", "_salt"], "left").drop("_salt")


# The samples: 8-bit grey, a Netpbm image 576 wide.


def to_media(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (UNIT, len(payload) // UNIT) + payload


def from_media(media: bytes) -> np.ndarray:
    """The samples of an image that to_media() made."""
    magic, size, most, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit grey image")
    return np.frombuffer(samples, np.uint8)


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and the shares of eight levels, of all samples."""
    n = len(samples)
    count = np.bincount(samples >> 5, minlength=8)
    total = np.bincount(samples, minlength=256)
    level = np.arange(256)
    mean = int((total * level).sum()) / n
    deviation = max(0.0, int((total * level * level).sum()) / n - mean * mean) ** 0.5
    return f"{mean:.4f} {deviation:.4f} " + " ".join(f"{c / n:.4f}" for c in count.tolist())


def page(text: str, digest: str) -> str:
    """A document as a page: its lines as paragraphs, and after half of them,
    rounded up, the image of its payload, captioned with the line before."""
    lines = [x for x in text.split("\n") if x.split()]
    half = -(-len(lines) // 2)
    body = [f"<p>{markup.escape(x, False)}</p>" for x in lines]
    said = markup.escape(lines[half - 1][:80], False) if lines else "empty"
    body.insert(half, f'<figure><img src="{SCHEME}{digest}"><figcaption>{said}</figcaption></figure>')
    return "<html><head><title>page</title></head><body>" + "\n".join(body) + "</body></html>"


def page_batches(batches):
    """From batches of (doc_id, _html), _html being a text, to doc_id, n_bytes and
    _html, the text's page with the image of its payload."""
    for b in batches:
        for i, j in chunks(utf8(b.column("_html"))[1], 1 << 20):
            texts = [t or "" for t in b.column("_html").slice(i, j - i).to_pylist()]
            raw = [t.encode() for t in texts]
            digests = [hashlib.sha256(padded(r)).hexdigest() for r in raw]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array([len(r) for r in raw], pa.int64()), pa.array(map(page, texts, digests), pa.string())], names=["doc_id", "n_bytes", "_html"])


def store_texts(docs: DataFrame) -> DataFrame:
    """digest and media, the images of the texts of docs(text), in the shared
    folder. A task stores a digest once while it remembers it; copies made by
    several tasks are alike. A null text is empty, and pads to one unit."""
    ship(docs.sparkSession)

    def run(batches):
        stored = set()
        for b in batches:
            data, offsets = utf8(b.column("text"))
            raw = memoryview(data)
            for i, j in chunks(offsets, 4 << 20):
                digests, media = [], []
                for k in range(i, j):
                    payload = padded(bytes(raw[offsets[k] : offsets[k + 1]]))
                    name = hashlib.sha256(payload).digest()
                    if name not in stored:
                        if len(stored) >= KNOWN_DIGESTS:
                            stored.clear()
                        stored.add(name)
                        digests.append(name.hex())
                        media.append(to_media(payload))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    return written(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "digest string, media binary"), "media")


def features(store: DataFrame) -> DataFrame:
    """What the stored images of store(digest, n_bytes, media) hold."""
    ship(store.sparkSession)
    schema = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        for b in batches:
            out = []
            for name, media in zip(b.column("digest").to_pylist(), b.column("media")):
                media = media.as_py()
                samples = from_media(media)
                payload = samples.tobytes()
                out.append((name, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return store.where(F.col("media").isNotNull()).select("digest", "media").mapInArrow(tidied(run), "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Each row of docs(doc_id, text) through its page and its stored image:
    items is how many texts and media its page has, position the image's place
    among them, caption what stands below it.

    Repeated rows and null ids give a row each; equal texts share a payload and
    have equal values; other columns are ignored; an empty table gives none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    refs = references(sequences(rows, "doc_id", "text", page_batches, {"n_bytes": "long"}), "doc_id", "n_bytes")
    store = store_texts(docs)
    often = written(store.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).select("digest"), "often")
    found = resolve(refs, features(store), often)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "items", F.col("pos").alias("position"), "caption")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
