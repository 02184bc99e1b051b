import pytest
from pyspark.sql import functions as F

from tarn.functions.hooks import estimated_tokens
from tarn.operators import chunk, embed, parse
from tarn.sources import files

MD = "# Title\n\nIntro text.\n\n## Part A\nPara one.\n\nPara two.\n### Deep\nx\n# Second\ny"


def nodes(df):
    return [(n.node_type, n.title, n.text, n.order, n.level, list(n.section_path)) for n in df.orderBy("order").collect()]


def test_markdown(spark):
    df = parse.markdown(spark.createDataFrame([("/a/Doc.md", MD)], "path string, text string")).cache()
    got = nodes(df)
    assert got[0][:2] == ("document", "Doc")
    assert [(g[0], g[1] or g[2], g[4]) for g in got[1:]] == [("section", "Title", 1), ("paragraph", "Intro text.", 2), ("section", "Part A", 2), ("paragraph", "Para one.", 3), ("paragraph", "Para two.", 3), ("section", "Deep", 3), ("paragraph", "x", 4), ("section", "Second", 1), ("paragraph", "y", 2)]
    assert got[7][5] == ["Title", "Part A", "Deep"]
    up = {n.node_id: n for n in df.collect()}
    for n in up.values():
        if n.parent_id:
            assert up[n.parent_id].level < n.level and n.ancestors[-1] == n.parent_id
    deep = next(n for n in up.values() if n.title == "Deep")
    assert up[deep.parent_id].title == "Part A"


def test_plain_text(spark):
    text = "preamble\n\n1 Scope\n\nBody of scope.\nmore\n\nNotes:\n\nlast\n\nNot heading:\nfollows"
    df = parse.plain_text(spark.createDataFrame([("/a/b.txt", text), ("/a/empty.txt", ""), ("/a/null.txt", None)], "path string, text string"))
    got = nodes(df.filter("file_name = 'b.txt'"))
    assert [(g[0], g[1] or g[2]) for g in got[1:]] == [("paragraph", "preamble"), ("section", "1 Scope"), ("paragraph", "Body of scope.\nmore"), ("section", "Notes"), ("paragraph", "last"), ("paragraph", "Not heading:\nfollows")]
    assert df.filter("file_name <> 'b.txt'").count() == 2


def test_pages(spark):
    df = parse.paged(spark.createDataFrame([("/a/b.pdf", 1, "one\n\ntwo"), ("/a/b.pdf", 2, "three")], "path string, page int, text string"))
    assert [(g[0], g[1] or g[2]) for g in nodes(df)[1:]] == [("section", "Page 1"), ("paragraph", "one"), ("paragraph", "two"), ("section", "Page 2"), ("paragraph", "three")]


def test_hydration_and_pooling(spark):
    df = parse.markdown(spark.createDataFrame([("/a/Doc.md", MD)], "path string, text string"))
    out = {n.title: n for n in embed.enriched(df, lambda t: embed.hashed(t, 8)).collect() if n.title}
    assert out["Part A"].text == "Para one.\n\nPara two.\n\nx"
    assert out["Title"].token_count == 2 + 2 + 2 + 1 and len(out["Title"].embedding) == 8
    bare = embed.enriched(df, lambda t: embed.hashed(t, 8), pooling="none").filter("node_type = 'section'")
    assert bare.filter("embedding is not null").count() == 0
    with pytest.raises(ValueError):
        embed.embedder("nope")


def test_tree_lookups(spark):
    df = parse.markdown(spark.createDataFrame([("/a/Doc.md", MD)], "path string, text string"))
    assert df.join(parse.section_paths(df), "node_id").filter(F.col("path") != F.slice("section_path", 1, F.greatest(F.lit(0), F.size("section_path") - F.when(F.col("node_type") == "section", 1).otherwise(0)))).count() == 0
    leaves = parse.leaf_documents(df)
    assert leaves.filter("text = 'x'").first().parent_title == "Deep"
    assert parse.children(df).count() == 5


def test_recursive_chunks():
    text = "One sentence here. " * 40
    got = chunk.split_recursive(text, 100, 20, chunk.SEPARATORS)
    assert len(got) > 1 and all(0 < len(x) <= 100 for x in got)
    words = text.split()
    joined = " ".join(got)
    assert all(w in joined for w in words)
    assert chunk.split_recursive("", 10, 2, chunk.SEPARATORS) == []
    assert all(len(x) <= 5 for x in chunk.split_recursive("x" * 23, 5, 1, chunk.SEPARATORS))


def test_sentence_packing():
    assert chunk.pack_sentences(["a b", "c d", "e"], 3, 0) == ["a b", "c de"]
    assert chunk.pack_sentences(["a b", "c d", "e"], 3, 3) == ["a b", "a bc d", "c de"]
    assert chunk._sentences("你好。再见！", "chinese", True) == ["你好。", "再见！"]


def test_chunked(spark):
    df = spark.createDataFrame([(1, "m", "word " * 300), (2, "m", ""), (3, "m", None)], "id int, meta string, text string")
    out = chunk.chunked(df, "token", chunk_size=100, chunk_overlap=20).collect()
    assert {x.id for x in out} == {1} and len(out) > 2 and all(x.meta == "m" and estimated_tokens(x.text) <= 100 for x in out)
    with pytest.raises(ValueError):
        chunk.chunker("nope")


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# H\n\ntext-\nhere\n")
    (tmp_path / "sub" / "b.TXT").write_text("plain\ntext")
    (tmp_path / "c.bin").write_bytes(b"1")
    assert [x.suffix for x in files.listing(spark, str(tmp_path)).collect()] == ["md", "txt"]
    assert sorted(x.text for x in files.texts(spark, str(tmp_path)).collect()) == ["# H  texthere", "plain text"]
    assert files.trees(spark, str(tmp_path)).filter("node_type = 'paragraph'").count() == 2
    with pytest.raises(ValueError):
        files.tree_parser("exe")
    with pytest.raises(NotImplementedError):
        files.pages(spark, str(tmp_path), None)
    (tmp_path / "d.pdf").write_bytes(b"p1|p2")
    assert [x.page for x in files.pages(spark, str(tmp_path), lambda b: b.decode().split("|")).orderBy("page").collect()] == [1, 2]


def test_plain_text_needs_no_exchange(spark):
    """A file's nodes are made in its own row."""
    df = parse.plain_text(spark.createDataFrame([("/a/b.txt", "Title\n\nbody\n\nmore")], "path string, text string").repartition(2).cache())
    plan = df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "Exchange" not in plan and "Window" not in plan
    rows = {r.node_type + str(r.order): r for r in df.collect()}
    assert rows["paragraph2"].parent_id == rows["section1"].node_id and rows["paragraph3"].ancestors == [rows["document0"].node_id, rows["section1"].node_id]
