"""Files of a folder, parsed with failures set aside; content roots, metadata and inline markup; saved tables."""

import pytest
from pyspark.sql import functions as F

from gritstone.sources import files as X
from gritstone.sources import markup

PAGE = """<html><head><title>Ignored | Site</title><meta name="description" content=" About it "><meta property="og:type" content="article"></head>
<body><div id="side"><p>Side words</p></div><main><h1>The <b>Title</b></h1><p>Body text.</p><nav><p>Menu</p></nav><h2>Part</h2><p>More.</p></main><p>After</p></body></html>"""


def test_a_folder_of_files(spark, tmp_path):
    (tmp_path / "deep/er").mkdir(parents=True)
    (tmp_path / "a.HTML").write_text(PAGE)
    (tmp_path / "deep/b.md").write_text('---\ntitle: "Front"\nlang: en\n---\n# Head\n\nText *here*.\n')
    (tmp_path / "deep/er/c.txt").write_text("Only prose.")
    (tmp_path / "deep/er/empty.md").write_text("\n")
    (tmp_path / "deep/bad.md").write_bytes(b"\xff\xfe bad")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-")
    (tmp_path / "e.png").write_bytes(b"x")
    found = X.discover(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.select("path").collect()) == ["a.HTML", "b.md", "bad.md", "c.txt", "d.pdf", "empty.md"]
    documents, blocks, failures = X.parse_sources(found)
    got = {r.path.rsplit("/", 1)[1]: (r.parser, r.title, r.metadata, r.n_blocks) for r in documents.collect()}
    assert got == {"a.HTML": ("html", "The Title", {"description": "About it", "og_type": "article"}, 4), "b.md": ("markdown", "Front", {"title": '"Front"', "lang": "en"}, 2), "c.txt": ("markdown", "c", {}, 1), "empty.md": ("markdown", "empty", {}, 0)}
    rows = [(r.ord, r.kind, r.text, r.section_path) for r in blocks.where(F.col("path").endswith("a.HTML")).orderBy("ord").collect()]
    assert rows == [(0, "heading", "The Title", []), (1, "paragraph", "Body text.", ["The Title"]), (2, "heading", "Part", ["The Title"]), (3, "paragraph", "More.", ["The Title", "Part"])]
    assert sorted((r.path.rsplit("/", 1)[1], r.error.split(":")[0]) for r in failures.collect()) == [("bad.md", "UnicodeDecodeError"), ("d.pdf", "ValueError")]


def test_no_folder_and_null_contents(spark, tmp_path):
    assert X.discover(spark, str(tmp_path / "none")).count() == 0
    sources = spark.createDataFrame([("x.md", None), ("http://a/b", bytearray(b"<p>hi</p>"))], "path string, content binary")
    documents, blocks, failures = X.parse_sources(sources)
    assert [(r.path, r.error) for r in failures.collect()] == [("x.md", "ValueError: no content")] and [(r.title, r.n_blocks) for r in documents.collect()] == [("b", 1)]
    assert [t.count() for t in X.parse_sources(sources.limit(0))] == [0, 0, 0]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<body><p>out</p><article><p>in</p></article></body>", ["in"]),
        ("<body><article><p>first</p></article><main><p>main</p></main><main><p>second</p></main></body>", ["main"]),
        ("<body><p>out</p><section role='main'><p>in</section><p>after</p></body>", ["in"]),
        ("<body><p>out</p><div><p>a long text of many words</p></div><div><p>short</p></div></body>", ["a long text of many words"]),
        ("<body><p>a long text of many words, much longer than the div is</p><div><p>tiny</p></div></body>", ["a long text of many words, much longer than the div is", "tiny"]),
        ("<main><p>open", ["open"]),
        ("<body><div class='sidebar'><main><p>hidden</p></main></div><p>shown</p></body>", ["shown"]),
        ("<div><p>nested</p><div><p>inner</p></div></div>", ["nested", "inner"]),
        ("", []),
    ],
)
def test_content_roots(html, want):
    assert [text for _, text, _ in markup.parse_html(html)] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("a ![x](y) b", "a  b"), ("see [the *label*](http://x)", "see the label"), ("`code *kept*`", "code kept"), ("***both*** __bold__ _it_", "both bold it"),
        ("**bold _nested_**", "bold nested"), ("2 * 3 * 4", "2  3  4"), ("plain", "plain"), ("[]()", ""),
    ],
)
def test_inline_markup(spark, text, want):
    assert markup.strip_inline(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(markup.inline_stripped(F.col("t"))).first()[0] == want


def test_saved_tables_are_versions_in_order(spark, tmp_path):
    path, schema = str(tmp_path / "golden"), "id string, question string"
    assert X.load(spark, path, schema).count() == 0
    one = spark.createDataFrame([(f"q{i % 97:03d}", f"text\n{i}") for i in range(97, 0, -1)], schema)
    assert X.save(one, path, "id") == 1
    assert [r.id for r in X.load(spark, path, schema).collect()] == sorted(r.id for r in one.collect())
    assert X.save(one.where("id < 'q010'"), path, "id") == 2 and X.load(spark, path, schema).count() == 10
    lines = spark.read.text(X._newest(spark, path)[1]).collect()
    assert len(lines) == 10 and all(r.value.startswith('{"id":"q') for r in lines)
