"""Markup, URLs, CSV, archives, codecs, hashes, images, layouts."""

import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.functions import encodings, hashing, images, markup, tokens_jwt, urls
from loomtext.operators import fuzzy, layout
from loomtext.sources import archives, csv, filetype

MARKDOWN = [
    ("<h1>Hello</h1>", "# Hello", {}), ("<p>a</p><p>b</p>", "a\n\nb", {}), ("<p><strong>x</strong> <em>y</em></p>", "**x** _y_", {}), ('<a href="/x">click</a>', "[click](/x)", {}),
    ('<img src="/x.png" alt="X"/>', "![X](/x.png)", {}), ("<ul><li>a</li><li>b</li></ul>", "* a\n* b", {}), ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b", {}), ("<hr/>", "* * *", {}),
    ("<del>x</del>", "~~x~~", {"gfm": True}), ("<code>a`b</code>", "`` a`b ``", {}), ("<script>x</script>y", "y", {}), ("<h2>T</h2>", "T\n---", {"heading_style": "setext"}),
    ('<pre><code class="language-py">x = 1</code></pre>', "```py\nx = 1\n```", {"code_block_style": "fenced"}), ("<blockquote>q</blockquote>", "> q", {}),
    ("<table><tr><th>a</th></tr><tr><td>1</td></tr></table>", "| a |\n| --- |\n| 1 |", {"gfm": True}), ("<p>a<u>b</u></p>", "a<u>b</u>", {"keep": ("u",)}), ("<p>a<u>b</u></p>", "a", {"remove": ("u",)}),
    ('<ul><li><input type="checkbox" checked>x</li></ul>', "* [x] x", {"gfm": True}), ("<p>a<br>b</p>", "a  \nb", {}),
]


@pytest.mark.parametrize(("source", "want", "options"), MARKDOWN)
def test_markdown(source, want, options):
    assert markup.markdown(source, markup.MarkdownOptions(**options)) == want


CLEAN = [
    ("<p>Hello</p><script>alert(1)</script>", "<p>Hello</p>"), ("", ""), ('<a href="javascript:x" onclick="y">t</a>', "<a>t</a>"), ("<x>in</x>", "in"), ("a <b>b", "a <b>b</b>"),
    ('<a href="https://x.y">t</a>', '<a href="https://x.y" rel="noopener noreferrer">t</a>'), ("<!-- c -->x", "x"), ("1 &lt; 2 &amp; 3", "1 &lt; 2 &amp; 3"), ('<img src="/a.png" onerror="x">', '<img src="/a.png">'),
]


@pytest.mark.parametrize(("source", "want"), CLEAN)
def test_sanitize(source, want):
    assert markup.clean(source) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/ab&;=\"'!- script", max_size=80))
def test_sanitize_is_idempotent_and_safe(s):
    out = markup.clean(s)
    assert markup.clean(out) == out and "<script" not in out


def test_sanitize_limits():
    assert markup.clean("<p>long</p>", markup.SanitizeOptions(max_input_bytes=5)) == ""
    assert markup.clean("<p>long</p>", markup.SanitizeOptions(max_input_bytes=0)) == "<p>long</p>"


RENDERED = [
    ("# Hi", '<h1 id="hi">Hi</h1>\n'), ("a\n\nb", "<p>a</p>\n<p>b</p>\n"), ("**x** _y_ `z`", "<p><strong>x</strong> <em>y</em> <code>z</code></p>\n"), ("- a\n- b", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n"),
    ("```py\nx < 1\n```", '<pre><code class="language-py">x &lt; 1\n</code></pre>\n'), ("[t](/u)", '<p><a href="/u">t</a></p>\n'), ("> q", "<blockquote>\n<p>q</p>\n</blockquote>\n"), ("***", "<hr />\n"),
    ("| a |\n| - |\n| 1 |", "<table>\n<thead>\n<tr>\n<th>a</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n</tr>\n</tbody>\n</table>\n"), ("T\n==", '<h1 id="t">T</h1>\n'), ("~~d~~", "<p><del>d</del></p>\n"),
]


@pytest.mark.parametrize(("source", "want"), RENDERED)
def test_render(source, want):
    assert markup.to_html(source) == want


def test_heading_ids_and_svg():
    assert markup.to_html("# A\n# A\n# é") == '<h1 id="a">A</h1>\n<h1 id="a-1">A</h1>\n<h1 id="heading">é</h1>\n'
    svg = '<svg xmlns="http://www.w3.org/2000/svg"><!-- c --><g><rect x="1.23456" y="0.50" fill="#ffcc00"/></g><g display="none"><rect/></g><defs/></svg>'
    assert markup.optimize_svg(svg) == '<svg xmlns="http://www.w3.org/2000/svg"><rect x="1.235" y=".5" fill="#fc0"/></svg>'


def test_urls(spark):
    rows = ["https://foo.bar.example.com/some/path?q=1", "http://www.example.co.uk", "http://192.168.1.1:80/x", "localhost", None, "https://u:p@Host.ORG/a@b"]
    out = [r.u for r in spark.createDataFrame([(r,) for r in rows], "x string").select(urls.parse(F.col("x")).alias("u")).collect()]
    assert (out[0].hostname, out[0].domain, out[0].subdomain, out[0].public_suffix) == ("foo.bar.example.com", "example.com", "foo.bar", "com")
    assert (out[1].domain, out[1].subdomain, out[1].public_suffix) == ("example.co.uk", "www", "co.uk")
    assert out[2].is_ip and out[2].domain is None and out[3].domain is None and out[4] is None and out[5].hostname == "host.org"


def test_csv(spark):
    rows = csv.parse_rows
    assert rows("h1,h2,h3\naaa,bbb,ccc\nxxx,yyy,zzz") == [["aaa", "bbb", "ccc"], ["xxx", "yyy", "zzz"]]
    assert rows('a,b\n"line1\nline2",x') == [["line1\nline2", "x"]] and rows('a,b\n"he said ""hi""",done') == [['he said "hi"', "done"]]
    assert rows("a,b,c\n,,\n1,,3") == [["", "", ""], ["1", "", "3"]] and rows("a,b\r\n1,2\r\n3,4") == [["1", "2"], ["3", "4"]]
    with pytest.raises(ValueError, match="delimiter must be a single byte"):
        rows("a", delimiter=256)
    with pytest.raises(ValueError, match="number of fields"):
        rows("a,b\n1")
    assert rows("a,b\n1\n1,2,3", flexible=True) == [["1"], ["1", "2", "3"]]
    df = spark.createDataFrame([("a,a,b\n1,2,3,4\n5,6,7",)], "x string")
    assert df.select(csv.parse_with_headers(F.col("x"))).first()[0] == [{"a": "2", "b": "3"}, {"a": "6", "b": "7"}]
    assert df.select(csv.count_rows(F.col("x"), flexible=True)).first()[0] == 2
    assert json.loads(df.select(csv.parse_to_json(F.col("x"), flexible=True)).first()[0]) == [["1", "2", "3", "4"], ["5", "6", "7"]]
    maps = spark.createDataFrame([([{"b": 'x"y', "a": "1"}, {"a": "p,q"}],), ([],)], "x array<map<string,string>>")
    assert [r[0] for r in maps.select(csv.stringify_objects(F.col("x"))).collect()] == ['a,b\n1,"x""y"\n"p,q",\n', ""]


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"', None), ("", "line\nbreak", "z")], "a string, b string, c string")
    csv.write(df, str(tmp_path / "c"))
    assert sorted(map(tuple, csv.read(spark, str(tmp_path / "c")).collect())) == [("", "line\nbreak", "z"), ("a,b", 'say "x"', "")]


def test_archives(spark):
    df = spark.createDataFrame([(bytearray(b"abc" * 1000),), (bytearray(b""),), (None,)], "x binary")
    for there, back in ((archives.gzip, archives.ungzip), (archives.deflate, archives.inflate), (archives.deflate_raw, archives.inflate_raw), (archives.zstd_compress, archives.zstd_decompress)):
        assert [r[0] for r in df.select(back(there(F.col("x")))).collect()] == [b"abc" * 1000, b"", None]
    with pytest.raises(Exception, match="exceeds"):
        df.select(archives.ungzip(archives.gzip(F.col("x")), 100)).collect()
    samples = spark.createDataFrame([(bytearray(f'{{"id": {i}, "name": "user {i}", "tags": ["a", "b"]}}'.encode()),) for i in range(400)], "x binary")
    d = archives.train_dictionary(samples, "x", 2000)
    assert samples.select((archives.zstd_decompress(archives.zstd_compress(F.col("x"), 3, d), d) == F.col("x")).alias("ok")).distinct().collect()[0].ok
    z = archives.zip_write(spark.createDataFrame([("z", "b/", None), ("z", "a.txt", "hey")], "a string, n string, d string"), "a", "n", "d")
    e = z.select(archives.zip_entries(F.col("data"))).first()[0]
    assert [(x.name, x.size, x.is_dir) for x in e] == [("a.txt", 3, False), ("b/", 0, True)]
    assert z.select(archives.zip_read(F.col("data"), "a.txt"), archives.zip_read(F.col("data"), "no")).first()[:] == (b"hey", None)


def test_xlsx():
    data = archives.write_sheets([("people", [["name", "age", "ok"], ["Alice", 30, True], ["<Bob>", 25.5, None]]), ("e", [])])
    sheets = archives.read_sheets(data)
    assert [s["name"] for s in sheets] == ["people", "e"]
    assert [[c["text"] if c["kind"] == "string" else c["number"] if c["kind"] == "number" else c["bool_value"] for c in r] for r in sheets[0]["rows"]] == [["name", "age", "ok"], ["Alice", 30.0, True], ["<Bob>", 25.5, None]]


def test_file_types(spark):
    rows = [("89504E470D0A1A0A00", "png"), ("FFD8FFE0", "jpg"), ("52494646000000005745425056", "webp"), ("0000000057454250", None), ("68656C6C6F", None), ("", None)]
    df = spark.createDataFrame([(bytearray.fromhex(h),) for h, _ in rows], "x binary")
    assert [r[0] for r in df.select(filetype.file_type(F.col("x"))["ext"]).collect()] == [e for _, e in rows]


def test_hashes(spark):
    df = spark.createDataFrame([(bytearray(b""),), (None,)], "x binary")
    r = df.select(hashing.xxh32(F.col("x")), hashing.xxh32(F.col("x"), 1), hashing.as_hex(hashing.xxh64(F.col("x"))), hashing.xxh3_128(F.col("x"))).collect()
    assert r[0][:3] == (0x02CC5D05, 0x0B2CB792, "ef46db3751d8e999") and len(r[0][3]) == 32 and r[1][:] == (None,) * 4
    parts = spark.createDataFrame([(1, 2, "c"), (1, 1, "ab"), (2, 1, None)], "k int, o int, d string")
    whole = spark.createDataFrame([("abc",)], "x string").select(hashing.xxh64(F.col("x"))).first()[0]
    assert {x.k: x.digest for x in hashing.hash_stream(parts, "k", "o", "d").collect()}[1] == whole
    with pytest.raises(ValueError):
        hashing.chunks(F.col("x"), 0)


def test_encodings(spark):
    df = spark.createDataFrame([("café こんにちは 😀",)], "x string")
    for label in ("utf8", "UTF-16LE"):
        assert df.select(encodings.decode(encodings.encode(F.col("x"), label), label)).first()[0] == "café こんにちは 😀"
    assert df.select(encodings.encode(F.col("x"), "latin1")).first()[0] == b"caf\xe9 ????? ??"
    assert encodings._decode(encodings._encode("こんにちは", "shift_jis"), "shift_jis") == "こんにちは"
    assert encodings._decode(b"a\xff\xfe", "utf-8") == "a��" and encodings._decode(b"a\x00b", "utf-16le") == "a"
    with pytest.raises(ValueError, match="not recognized"):
        encodings.encode(F.col("x"), "nope")


def test_tokens(spark):
    key = '{"kty":"OKP","crv":"Ed25519","x":"11qYAYKxCrfVS_7TyWQHOg7hcvPapiMlrwIaaPcHURo"}'
    assert spark.createDataFrame([(key,)], "x string").select(tokens_jwt.thumbprint(F.col("x"))).first()[0] == "kPrK_qmxVWaYVA9wwBF6Iuo3vVzz7TxHCTwXBygrS4k"
    t = tokens_jwt.sign_text('{"a":1}', "s", now=100, expires_in="10s")
    assert json.loads(tokens_jwt.verify_text(t, "s", 110)) == {"a": 1, "iat": 100, "exp": 110}
    assert tokens_jwt.verify_text(t, "s", 111) is None and tokens_jwt.verify_text(t, "s", 111, leeway=1) and tokens_jwt.verify_text(t, "x", 100) is None
    assert tokens_jwt.duration_ms("2h") == 7_200_000 and tokens_jwt.duration_ms("100") == 100


def test_images():
    g = np.random.default_rng(1)
    a = g.integers(0, 256, (5, 7, 4), np.uint8)
    assert (images.png_pixels(images.png_bytes(a)) == a).all()
    assert images.resized(a, 7, 5).tolist() == a.tolist() and images.resized(np.full((9, 9, 4), 77, np.uint8), 4, 3).tolist() == np.full((3, 4, 4), 77).tolist()
    assert not images.differing(a, a).any()
    b = a.copy()
    b[2, 3, :3] = 255 - b[2, 3, :3]
    assert images.differing(a, b, include_aa=True).sum() <= 1
    with pytest.raises(ValueError):
        images.pixels(2, 2, b"1234")
    over = images.composed(np.zeros((2, 2, 4), np.uint8), np.full((1, 1, 4), 255, np.uint8), 1, 1)
    assert over[1, 1].tolist() == [255] * 4 and over[0, 0].tolist() == [0] * 4


def test_layouts(spark):
    nodes = pd.DataFrame({"id": list("abcdx"), "width": [10.0] * 5, "height": [10.0] * 5, "rank": [None] * 5})
    edges = pd.DataFrame({"source": list("aabcz"), "target": list("bcdda"), "minlen": [None] * 5})
    out = pd.DataFrame(layout.layered(nodes, edges)).set_index("id")
    assert out.y["a"] < out.y["b"] == out.y["c"] < out.y["d"] and out["rank"].tolist() == [0, 1, 1, 2, 0]
    left = pd.DataFrame(layout.layered(nodes, edges, layout.LayerOptions(direction="LR"))).set_index("id")
    assert left.x.tolist() == out.y.tolist() and left.y.tolist() == out.x.tolist()
    cycle = layout.layered(nodes, pd.DataFrame({"source": ["a", "b"], "target": ["b", "a"], "minlen": [2, 2]}))
    assert len(cycle["id"]) == 5
    f = layout.simulate(pd.DataFrame({"id": [1, 2, 3], "x": [None, None, 5.0], "y": [None, None, 5.0], "fixed": [False, False, True]}), pd.DataFrame({"source": [1], "target": [2], "distance": [None], "strength": [None]}))
    assert (f["x"][2], f["y"][2]) == (5.0, 5.0) and not any(pd.isna(f["x"]))


def test_fuzzy(spark):
    s = fuzzy.fuzzy_score
    assert s("abc", "abcxx") > s("abc", "axbxc") > 0 and s("abc", "acb") == 0 and s("", "abc") == 0 and s("gro", "Größe") > 0
    books = [{"title": "Old Man's War", "author": "John"}, {"title": "The Lock Artist", "author": "Steve"}, {"title": "HTML5", "author": "Remy"}]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(books)], "ref_index long, record string")
    q = spark.createDataFrame([(0, "lock artist"), (1, "")], "query_id long, query string")
    out = fuzzy.search(df, q, keys=[("title", 1.0), ("author", 0.5)]).collect()
    assert [r.ref_index for r in out] == [1] and 0 <= out[0].score <= 0.6
