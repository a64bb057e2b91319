"""WARC archives, license scans and media columns."""

import base64
import hashlib
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from arbor.llm import licenses, media, warc
from arbor.session import scratch
from tests.llm.conftest import empty, frame


def test_archives_round_trip(spark):
    rows = [(i, f"http://e.com/{i}\r\nX: y", f"<p>page {i % 7}</p>" * 20) for i in range(60)] + [(60, None, None), (61, "u", ""), (62, "u", "é\r\n\r\nWARC/1.1"), (62, "u", "é\r\n\r\nWARC/1.1"), (None, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit(5)).withColumn("digest", F.lit("x"))
    files = warc.save(pages, scratch(spark, "files"))
    got = warc.read(files).toPandas()
    assert sum(r["records"] for r in files.collect()) == len(got) and all(r["file"].endswith(".warc.zst") for r in files.collect())
    assert len(got) == len(rows) and files.agg(F.sum("records")).first()[0] == len(rows)
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    for i, _, h in rows:
        raw = (h or "").encode()
        for r in got[got.page_id == i].itertuples() if i is not None else got[got.page_id.isna()].itertuples():
            assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
            if i is None or best[h or ""] == i:
                assert r.record_type == "response" and bytes(r.payload) == raw and r.refers_to != r.refers_to
            else:
                assert r.record_type == "revisit" and r.refers_to == best[h or ""] and not r.payload
    assert warc.read(warc.archived(pages.where("false"))).collect() == []
    assert {r["record_type"] for r in warc.read(warc.archived(pages, 10**6)).collect()} == {"response"}


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_archives_below_a_folder_with_or_without_a_scheme(spark, tmp_path, scheme):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, None, None)], "page_id long, url string, html string")
    files = warc.save(pages, f"{scheme}{tmp_path}/a b%20c/arbor-warc")
    assert sorted((r["page_id"], r["refers_to"]) for r in warc.read(files).collect()) == [(1, 2), (2, None), (3, None)]
    assert files.count() == len(list((tmp_path / "a b%20c" / "arbor-warc").iterdir()))


def test_records_are_frames_of_their_own_behind_a_dictionary():
    raw = [warc.record(i, "u", b"<html>" + str(i).encode() * 50, None) for i in range(200)]
    content = warc.archive(raw)
    assert content[:4] == warc.DICTIONARY_FRAME.to_bytes(4, "little") and list(warc.read_archive(content)) == raw
    assert len(content) < len(zstandard.ZstdCompressor().compress(b"".join(raw))) + 40_000
    assert list(warc.read_archive(warc.archive([b"x"]))) == [b"x"]


def test_license_scan(spark, cases):
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, cases)).collect() if r["doc_id"] is not None}
    r = got[15]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (13, 4, 3, 10, "apache,gpl,mit")
    assert r["labels"].split(",") == sorted({"apache", "gpl", "mit"}) and 0 < r["score"] <= 1
    assert got[1]["n_words"] == 0 and got[1]["first_word"] is None and got[2]["labels"] == "" and got[7]["score"] == 0
    assert licenses.scan(empty(spark)).collect() == [] and licenses.scan(frame(spark, cases)).count() == len(cases)


def test_rules_yield_to_those_they_lie_in():
    compiled = [(*rule, __import__("re").compile(p)) for *rule, p in licenses.rules()]
    assert len(compiled) > 200
    keywords = sorted({k for r in compiled for k in (*r[2], r[3])})
    assert licenses.detect("spdx-license-identifier: gpl-2.0-or-later", compiled, keywords) == [(0, 41, "gpl-2.0", 90)]
    assert licenses.detect("licensed under the apache license, version 2.0 here", compiled, keywords) == [(0, 46, "apache-2.0", 80)]
    assert licenses.detect("nothing here", compiled, keywords) == []


def test_media_columns(spark, cases):
    rows = media.media_columns(frame(spark, cases)).collect()
    want = []
    for i, t in cases:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want.append(str((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))))
    assert sorted(str((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])) for r in rows) == sorted(want)
    assert len({(r["media_sha256"], r["feature"]) for r in rows}) == len({t or "" for _, t in cases})
    assert media.media_columns(empty(spark)).collect() == []


def test_pages_as_sequences():
    page = "<html><head><title>no</title><style>p{}</style></head><body><p>one <b>two</b></p><figure><img src='a.png' alt='alt'><img src='b.png'><figcaption>said &amp; done</figcaption></figure>three<br>four<img src=c><script>var x</script><video src='v'></video></body>"
    items = media.parse(page)
    assert [(i["pos"], i["kind"], i["text"], i["ref"], i["caption"]) for i in items] == [
        (0, "text", "one two", None, None), (1, "image", None, "a.png", "said & done"), (2, "image", None, "b.png", "said & done"), (3, "text", "three", None, None), (4, "text", "four", None, None), (5, "image", None, "c", None), (6, "video", None, "v", None),
    ]
    assert media.parse(None) == [] and media.parse("<p>&lt;") == [{"pos": 0, "kind": "text", "text": "<", "ref": None, "caption": None}]


def test_references_resolve_by_digest(spark):
    pages = spark.createDataFrame([(1, f'<p>t</p><img src="{media.SCHEME}{"a" * 64}"><img src="http://x">'), (2, f'<img alt="c" src="{media.SCHEME}{"b" * 64}">'), (3, None)], "page_id long, html string")
    refs = media.references(media.sequences(pages, "page_id", "html"), "page_id")
    store = spark.createDataFrame([("a" * 64, 5), ("a" * 64, 5)], "digest string, size int")
    assert sorted((r["page_id"], r["pos"], r["size"], r["caption"]) for r in media.resolve(refs, store).collect()) == [(1, 1, 5, None), (2, 0, None, "c")]


def test_wrapped_notices(spark):
    compiled = [(*rule, __import__("re").compile(p, 16)) for *rule, p in licenses.rules()]
    keywords = sorted({k for r in compiled for k in (*r[2], r[3])})
    notices = {
        "bsd-2-clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee",
        "gpl": "GNU General\nPublic License as published by\nthe Free Software Foundation",
        "apache-2.0": "Licensed under the\nApache License, Version 2.0",
        "all-rights-reserved": "All\nrights\t reserved",
    }
    rows = []
    for label, notice in notices.items():
        for first, lead, end in (("", "", ""), ("# ", "# ", ""), (" * ", " * ", ""), ("// ", "//   ", ""), ("/* ", " ** ", " *"), ("", "  ", "  \r"), ("<!-- ", "", ""), ("dnl ", "dnl ", "")):
            rows.append((label, "é\n\n" + first, notice.replace("\n", end + "\n" + lead)))
    for label, start, notice in rows:
        text = (start + notice + "\n").lower()
        found = licenses.detect(text, compiled, keywords)
        assert (len(start), len(start + notice), label) in [f[:3] for f in found], (text, found)
    docs = spark.createDataFrame([(i, a + b) for i, (_, a, b) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert all(label in got[i]["labels"].split(",") and got[i]["score"] > 0 for i, (label, _, _) in enumerate(rows))


def example(parsed):
    """The shortest text of a parsed pattern, by its first alternatives."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            out += next((chr(a) if str(o) == "LITERAL" else chr(a[0]) if str(o) == "RANGE" else ":" for o, a in arg))
            if str(arg[0][1]) == "CATEGORY_DIGIT":
                out = out[:-1] + "1"
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += example(arg[2]) * arg[0]
        elif op == "SUBPATTERN":
            out += example(arg[3])
        elif op == "BRANCH":
            out += example(arg[1][0])
        elif op == "ANY":
            out += "x"
    return out


def test_each_rule_matches_an_example():
    import re

    compiled = [(*rule, re.compile(p, re.S)) for *rule, p in licenses.rules()]
    keywords = sorted({k for r in compiled for k in (*r[2], r[3])})
    for priority, label, keys, must, pattern in compiled:
        text = example(re._parser.parse(pattern.pattern, re.S))
        assert re.search("licen[sc]e licen", text) is None and must in text and any(k in text for k in keys), (pattern.pattern, text)
        found = licenses.detect(text, [(priority, label, keys, must, pattern)], keywords)
        assert [f[2] for f in found] == [label], (pattern.pattern, text)
    for held in (licenses.TITLES, licenses.SENTENCES):
        for label, texts in held.items():
            for text in texts:
                words = ("x " + text + ".").split()
                wrapped = "".join(w + (" " if i % 6 else "\n * ") for i, w in enumerate(words))
                assert label in {f[2] for f in licenses.detect(wrapped, compiled, keywords)}, wrapped


def test_plain_mentions():
    import re

    compiled = [(*rule, re.compile(p, re.S)) for *rule, p in licenses.rules()]
    keywords = sorted({k for r in compiled for k in (*r[2], r[3])})
    said = {
        "Boost Software License - Version 1.0": "bsl-1.0", "Eclipse Public License - v 2.0": "epl-2.0", "Mozilla Public License Version 2.0": "mpl-2.0", "Mozilla Public License, 1.1": "mpl-1.1",
        "the Business Source License": "busl-1.1", "GNU Lesser General Public License, version 3": "lgpl-3.0", "GNU General Public License v2": "gpl-2.0", "GPLv3": "gpl-3.0", "The Unlicense": "unlicense",
        "the SIL Open Font License.": "ofl-1.1", "see the Artistic License 2.0": "artistic-2.0", "X11 License": "x11",
        "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa-4.0", "see <http://www.gnu.org/licenses/gpl-3.0.html>": "gpl-3.0", "https://opensource.org/license/mit-0": "mit-0", "www.gnu.org/copyleft/gpl.html": "gpl",
    }
    for text, label in said.items():
        assert {f[2] for f in licenses.detect(text.lower(), compiled, keywords)} == {label}, text


def test_open_heads_and_other_references():
    say = lambda html: [(i["kind"], i["text"] or i["ref"]) for i in media.parse(html)]
    for page in ("<html><head><title>t</title><meta charset=x><body>said", "<head><title>t</title><style>s</style><p>said", "<head><script>x<p></script></head>said", "<head><title>t</title></head><body><p>said"):
        assert say(page) == [("text", "said")], page
    assert say('<img src=a srcset="a 1x, b,c 2x ,d"><img data-src=e>') == [("image", "a"), ("image", "b,c"), ("image", "d"), ("image", "e")]
    assert say("<video src=v poster=p></video><object data=o></object><source srcset='x, y 2x'>") == [("video", "v"), ("image", "p"), ("object", "o"), ("source", "x"), ("source", "y")]
    assert say("<object></object><img alt=x>") == []
