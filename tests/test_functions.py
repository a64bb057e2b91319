"""Globs, rule files, chunks and signatures."""

import random
import re

import pytest

from arbor.functions import chunking, globs


def match(pattern, path, whole=True):
    return re.search(globs.rule(pattern).regex(whole).replace(r"\z", r"\Z"), path.lstrip("/")) is not None


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [
        ("test/**/*.test.js", ["/test/cart.test.js", "/test/routes/cart-api.test.js", "/test/a/b/deep.test.js"], ["/other/cart.test.js", "/test/routes/cart.js", "/test/prefixcart.test.jsx"]),
        ("src/**/index.js", ["/src/index.js", "/src/web/index.js"], ["/src/webindex.js"]),
        ("**/index.js", ["/index.js"], []),
        ("**/**/index.js", ["/index.js"], []),
        ("src/**/*.js", ["/src/cart.js"], []),
        ("src/*.js", [], ["/src/web/cart.js"]),
        ("src/**/**/index.js", ["/src/index.js", "/src/web/index.js", "/src/web/ui/index.js"], ["/src/webindex.js"]),
        ("*.js", ["/a.js", "/x/a.js"], ["/a.js/b", "/a.ts"]),
        ("a?c", ["/abc", "/x/a.c"], ["/a/c", "/ac"]),
        ("!/src/", ["/src"], ["/x/src", "/src/a"]),
        ("a.b", ["/a.b"], ["/axb", "/a.b\n"]),
    ],
)
def test_whole_path_globs(pattern, yes, no):
    assert all(match(pattern, p) for p in yes) and not any(match(pattern, p) for p in no)


def test_rules_cover_what_lies_below():
    assert match("dist/**/bundle.js", "/dist/bundle.js", False) and match("node", "/a/node/x/y", False) and not match("node", "/a/nodes", False)


def test_rule_files_include_in_place_and_stop_at_cycles():
    files = {"/.lww": "# c\na\n%include more\nb\n%include  .lww\n", "/more": "x\n!y\n%include /.lww\n"}
    assert [r.pattern for r in globs.load_rules(files.get)] == ["a", "x", "!y", "b"]
    assert globs.load_rules({}.get) == []


def test_chunks_cover_a_file_and_stay_after_an_edit():
    raw = random.Random(1).randbytes(1 << 20)
    cuts = chunking.chunks(raw)
    assert b"".join(raw[o : o + n] for _, o, n, _, _ in cuts) == raw
    assert all(chunking.LEAST <= n <= chunking.MOST for _, _, n, _, _ in cuts[:-1])
    edited = chunking.chunks(raw[:500_000] + b"inserted" + raw[500_000:])
    assert len({c[3] for c in edited} - {c[3] for c in cuts}) <= 3


def test_small_empty_and_zero_files():
    assert chunking.chunks(b"") == [] and len(chunking.chunks(b"x" * 1000)) == 1
    zeros = chunking.chunks(bytes(1 << 20))
    assert sum(n * times for _, _, n, _, times in zeros) == 1 << 20 and len(zeros) <= 3


def test_signatures_of_near_copies_share_hashes():
    raw = random.Random(2).randbytes(20_000)
    a, b, c = chunking.signature(raw), chunking.signature(raw[:10_000] + b"!" + raw[10_000:]), chunking.signature(random.Random(4).randbytes(20_000))
    assert len(a) == 8 and len({*a} & {*b}) >= 6 and not {*a} & {*c} and chunking.signature(b"short") == []
