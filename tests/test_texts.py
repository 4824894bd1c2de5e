import gzip
import io
import os
import random
import re
import struct
import subprocess
import sys
import tarfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperlake.functions import render
from paperlake.functions import text as T
from paperlake.operators.fulltext import read_papers
from paperlake.plans.texts import pack_archives, packed_files
from paperlake.sources import archive, atom


def apply(spark, function, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


def test_entities(spark):
    given_ = [
        "&#65;&#x2014;&#x1F600;",
        "&#X41; &copy; &AMP;",
        "&amp;lt;",
        "&#38;lt;",
        "&#12AB;x",
        "&#xZZ; &#AB;",
        "&#1114112;&#xD800;&#99999999999;",
        "a&nbsp;b&quot;&apos;&lt;&gt;",
        "none",
    ]
    want = ["A—😀", "&#X41; &copy; &AMP;", "&lt;", "<", "\x0cx", "&#xZZ; &#AB;", "&#1114112;&#xD800;&#99999999999;", "a b\"'<>", "none"]
    assert apply(spark, T.decode_entities, *given_) == want


def test_html(spark):
    got = apply(
        spark, T.html_text, "<html><SCRIPT>x</SCRIPT><style>y</style><!-- z --><p>One</p><P class=a>Two<br/>three</p>a<b>b</b>c", "<path>kept<link>", "a\r\nb\rc  \n\n\n\nd", "&lt;b&gt; stays", "<title>T</title><nav>N</nav>", None
    )
    assert got == ["One\n\nTwo\nthree\n\na b c", "kept", "a\nb\nc\n\nd", "<b> stays", "T N", None]


def test_latex(spark):
    got = apply(
        spark, T.latex_text, r"\section{ Intro }text \subsection*{Sub}", r"\textbf{b} \foo{\alpha x} \foo{} \bar", r"a \cite{x}\includegraphics[w=1]{f} 50\% left % gone", r"$ a$ $x ^2 $ $$ y $$", "p1\n\n\np2~q\\\\r", r"\title{T}\begin{itemize}\item one\items", r"\begin{document}D\end{document}"
    )
    assert got == [
        "# Intro\ntext\n## Sub",
        "b  \\alpha x",
        "a  50\\% left",
        "$ a$ $x ^2$\n$$y$$",
        "p1\np2 q\nr",
        "T\n itemize\n-  one",
        "D",
    ]


def test_gate(spark):
    long, eight, word, none = "x" * 3000, "\n\n".join("abcdefgh"), "our Method is", "a methodology"
    assert apply(spark, T.is_full_paper, long, eight, word, none, "x" * 2999) == [True, True, True, False, False]
    df = spark.createDataFrame([("x" * 3500, "a" * 600)], "t string, a string")
    assert df.select(T.is_full_paper("t", "a")).first()[0] is False


def test_cleaning(spark):
    assert apply(spark, T.clean_content, " a [link](http://x)  \tb\n") == ["a link b"]
    assert apply(spark, T.first_heading, "x\n## A [b](c)  d\n# E", "none") == ["A b d", ""]
    assert apply(spark, T.slug_title, "get-started_with API.md", "") == ["Get Started With API.Md", ""]
    assert apply(
        spark, T.is_nav, "What's new", "whats_new", "What’s-New", "somewhat newer", "what-s-new", None
    ) == [True, True, True, True, False, False]
    assert apply(spark, T.strip_version, " 2103.01231v12\n", "cs.LG/0612056", "v") == ["2103.01231", "cs.LG/0612056", "v"]


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="ab \né", max_size=40), st.integers(1, 9))
def test_windows_cover_the_text(spark, text, size):
    df = spark.createDataFrame([(text,)], "t string")
    out, at = "", 0
    for _ in range(60):
        w = df.select(T.text_window("t", at, size).alias("w")).first().w
        out += w.text
        if not w.has_more:
            break
        at = w.end
    assert out == text


def test_window_past_the_end(spark):
    w = spark.createDataFrame([("abc",)], "t string").select(T.text_window("t", 10, 5).alias("w")).first().w
    assert (w.text, w.end, w.has_more, w.total_chars) == ("", 3, False, 3)


def packed(files, **kw):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name, data in files:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
            else:
                info.size = len(data)
            tar.addfile(info, io.BytesIO(data or b""))
    return out.getvalue()


def test_tar_files():
    long = "d" * 120 + "/f.tex"
    data = packed([("dir", None), ("a.tex", b"x" * 700), ("empty", b""), (long, b"y")])
    whole = [("a.tex", 700, b"x" * 700), ("empty", 0, b""), (long, 1, b"y")]
    read = lambda raw, *more: list(archive.archive_files(lambda: io.BytesIO(raw), *more))
    zipped = gzip.compress(data)
    assert read(data) == read(zipped) == read(gzip.compress(data[:3000]) + gzip.compress(data[3000:]) + b"\0" * 9) == whole
    assert read(data[:1200]) == read(b"junk" * 10) == read(b"") == read(zipped[:-9]) == read(zipped[:60] + b"?" + zipped[61:]) == []
    assert read(data, ".tex", 100) == [("a.tex", 700, None), ("empty", 0, None), (long, 1, b"y")]
    assert read(zipped, "", 1 << 20, 1800) == whole[:1]
    assert struct.calcsize("512s") == archive.BLOCK


def test_choice_of_the_main_file(spark):
    rows = [
        (1, packed([("sub/main.tex", b"s"), ("ms.tex", b"m"), ("z.tex", b"z" * 29_000)])),
        (2, packed([("x.tex", b"first"), ("y.tex", b"later")])),
        (3, packed([("readme", b"r")])),
    ]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in rows], "id long, data binary")
    got = {r.id: (r.source_name, r.text) for r in archive.main_tex(archive.entries(df)).collect()}
    assert got[1][0] == "sub/main.tex" and got[2] == ("x.tex", "first") and 3 not in got


def test_atom(spark):
    xml = """<feed><id>http://arxiv.org/abs/feed</id><entry><id>http://arxiv.org/abs/2401.00001v2</id><title a="b">A
      &amp; B</title><summary> S  s </summary><published> 2024-01-15 </published><updated>2024</updated><author><name>X Y</name></author><author><name>Z</name></author>
      <link title="doi" rel="r" href="http://dx.doi.org/10.1/x"/><category term="cs.LG"/><category scheme="q" term="cs.CL"/></entry>
      <entry><title>no id</title></entry><entry><id>https://arxiv.org/abs/cs/01</id><link href="http://dx.doi.org/10.1/y" title="doi"/></entry></feed>"""
    got = atom.parse_feeds(spark.createDataFrame([(xml,)], "xml string"))
    rows = {r.id: r for r in got.collect()}
    assert set(rows) == {"2401.00001", "cs/01"}
    r = rows["2401.00001"]
    assert (r.title, r.abstract, r.authors, r.categories, r.doi, r.abs_url) == (
        "A &amp; B", "S s", ["X Y", "Z"], ["cs.LG", "cs.CL"], "10.1/x", "https://arxiv.org/abs/2401.00001"
    )
    assert rows["cs/01"].doi is None and rows["cs/01"].authors == []
    assert atom.lookup(got, "2401.00001v9").count() == 1 and atom.lookup(got, "9").count() == 0


def test_cascade(spark):
    papers = spark.createDataFrame([(str(i), f"abstract {i}") for i in range(5)], "id string, abstract string")
    html = spark.createDataFrame([("0", "<h2>Introduction</h2>" + "<p>x</p>"), ("1", "<p>short</p>")], "id string, html string")
    tex = spark.createDataFrame([("1", "tex", "main.tex"), ("2", "", "m.tex")], "id string, text string, source_name string")
    pdf = spark.createDataFrame([("2", "pdf"), ("3", "")], "id string, text string")
    got = {r.id: (r.source, r.source_name) for r in read_papers(papers, html, tex, pdf).collect()}
    assert got == {"0": ("html", None), "1": ("tex", "main.tex"), "2": ("pdf", None), "3": ("abstract", None), "4": ("abstract", None)}


@pytest.mark.parametrize("needle", ["a", "aa", "ab", ""])
def test_occurrences(spark, needle):
    texts = ["aaaa", "abab", "", "b"]
    assert apply(spark, lambda c: T.occurrences(c, needle), *texts) == [t.count(needle) if needle else 0 for t in texts]


def test_ids_longer_than_their_padding_stay_whole(spark, docs, saved):
    from paperlake.plans.catalog import queries

    orders = spark.createDataFrame([(7, 1), (12345678, 1), (12345679, 2)], "o_orderkey long, o_custkey long")
    folder = saved(documents=docs([(i, t, "en", "s") for i, t in ((7, "a"), (100000, "b"), (100001, "c"))]), orders=orders)
    found = {r.abstract: (r.id, r.pdf_url) for r in queries()["atom_roundtrip"](spark, folder).collect()}
    assert found == {t: (f"2001.{i}", f"https://arxiv.org/pdf/2001.{i}") for t, i in (("a", "00007"), ("b", "100000"), ("c", "100001"))}
    found = {r.o_orderkey: r.clean_id for r in queries()["id_normalize"](spark, folder).collect()}
    assert found == {7: "cs.LG/0000007", 12345678: "cs.LG/12345678", 12345679: "cs.LG/12345679"}


def test_feeds_and_archives_are_read_from_files(spark, tmp_path):
    (tmp_path / "feeds").mkdir()
    (tmp_path / "archives").mkdir()
    entry = "<entry><id>http://arxiv.org/abs/2001.1v2</id><title>A\n B</title><summary> s <x> </summary><author><name> N </name></author><author><name>M</name></author><link title=\"doi\" href=\"https://dx.doi.org/10.1/z\"/></entry>"
    (tmp_path / "feeds" / "a.xml").write_text(f"<feed>{entry}<entry><title>no id</title></entry></feed>")
    row = atom.parse_feeds(atom.read_feeds(spark, f"{tmp_path}/feeds")).collect()
    assert [(r.id, r.title, r.authors, r.abstract, r.doi) for r in row] == [("2001.1", "A B", ["N", "M"], "s <x>", "10.1/z")]
    (tmp_path / "archives" / "p.tar").write_bytes(packed_files({"main.tex": b"\\section{X} y", "b.txt": b"1"}))
    got = archive.main_tex(archive.read_archives(spark, f"{tmp_path}/archives", ".tex")).collect()
    assert [(r.id.rsplit("/", 1)[1], r.source_name, r.text.split()) for r in got] == [("p.tar", "main.tex", ["#", "X", "y"])]


HEAVY = """
import gzip, io, resource, sys, tarfile
sys.path.insert(0, {root!r})
from paperlake.sources import archive
info, tex = tarfile.TarInfo("bomb.tex"), tarfile.TarInfo("ms.tex")
info.size, tex.size = 3 << 30, 5
zeros = bytes(1 << 24)
with gzip.open({path!r}, "wb", 1) as out:
    out.write(info.tobuf(tarfile.USTAR_FORMAT))
    for _ in range(info.size >> 24):
        out.write(zeros)
    out.write(tex.tobuf(tarfile.USTAR_FORMAT) + b"hello".ljust(512, bytes(1)))
with open({path!r} + ".tar", "wb") as out:
    out.write(info.tobuf(tarfile.USTAR_FORMAT))
    out.seek(info.size, 1)
    out.write(tex.tobuf(tarfile.USTAR_FORMAT) + b"hello".ljust(512, bytes(1)))
for path in ({path!r}, {path!r} + ".tar"):
    got = list(archive.archive_files(lambda: archive.stream_of("file:" + path)))
    assert got == [("bomb.tex", 3 << 30, None), ("ms.tex", 5, b"hello")], got
assert not list(archive.archive_files(lambda: archive.stream_of({path!r}), most=1 << 30))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""


def test_archives_larger_than_memory(tmp_path):
    """A gzip that inflates to 3 GB and a plain tar of 3 GB pass through a process of less than 1 GB."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ran = subprocess.run([sys.executable, "-c", HEAVY.format(root=root, path=f"{tmp_path}/a.gz")], capture_output=True, text=True)
    assert ran.returncode == 0, ran.stderr
    assert int(ran.stdout) < 1000


SUMMARIES = {
    "<summary/>": "",
    "": "",
    "<summary>never closed": "",
    '<summary type="text"> in\n full </summary>': "in full",
    "<summary></summary>": "",
    "<summary>a</summary><summary>b</summary>": "a",
    "</summary><summary>x": "",
}


@pytest.mark.parametrize("first", [True, False])
def test_a_summary_takes_nothing_from_other_elements(spark, first):
    """Empty, missing, unclosed, doubled; before the identifier and after it."""
    rest = "<id>http://arxiv.org/abs/7.{i}v1</id><title>T</title><published>2024</published><updated>2025</updated><author><name>N</name></author><category term=\"c\"/>"
    entries = [s + rest.replace("{i}", str(i)) if first else rest.replace("{i}", str(i)) + s for i, s in enumerate(SUMMARIES)]
    xml = "<feed>" + "".join(f"<entry>{e}</entry>" for e in entries) + "</feed>"
    got = {r.id: r for r in atom.parse_feeds(spark.createDataFrame([(xml,)], "xml string")).collect()}
    assert {i: r.abstract for i, r in got.items()} == {f"7.{i}": a for i, a in enumerate(SUMMARIES.values())}
    assert all((r.title, r.published, r.updated, r.authors, r.categories) == ("T", "2024", "2025", ["N"], ["c"]) for r in got.values())


def test_white_space_at_ends_and_within(spark):
    """Every kind of it, in runs and alone, beside line ends that are none; a text's ends are trimmed without a pass over the whole of it."""
    rng = random.Random(4)
    kinds = [*T.SPACES, "a", "é", "\x85", "\u200b", "b c"]
    rows = ["", " ", "a\x85", " a \x85", "\ufeff", *("".join(rng.choices(kinds, k=rng.randint(1, 12))) for _ in range(400)), "x" + " \n" * 500 + "x"]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    got = df.select("s", T.trim_all("s").alias("t"), T.collapse("s").alias("c")).collect()
    for s, t, c in got:
        assert t == s.strip(T.SPACES) and c == re.sub(f"[{T.SPACES}]+", " ", s).strip(" ")


def test_elements_of_long_entries_take_no_union_of_classes(spark):
    """A dot that takes line breaks as well: the same texts, at a tenth of the time of a class of all characters."""
    text = "word é\r\n\u2028 < b " * 20_000
    feeds = spark.createDataFrame([(f"<entry><id>http://arxiv.org/abs/1.2v1</id><summary>{text}</summary></entry>",)], "xml string")
    assert atom.parse_feeds(feeds).first().abstract == re.sub(f"[{T.SPACES}]+", " ", text).strip()
    assert not any(r"[\s\S]" in p for p in (atom.ENTRY, atom.SUMMARY, atom.TITLE))


def test_a_full_text_is_trimmed_and_measured_once(spark):
    """One trim of the whole text in the plan, whatever the view says about it; none and blank ones get the notice."""
    rows = [(1, "  " + "abc " * 50 + "\n"), (2, " \n\ufeff"), (3, None)]
    columns = {c: F.lit("v") for c in ("id", "title", "published", "updated", "abstract", "abs_url", "pdf_url", "html_url", "doi")}
    df = spark.createDataFrame(rows, "k long, full_text string").withColumns({**columns, "authors": F.array(F.lit("a")), "categories": F.array(F.lit("c"))})
    view = df.select("k", render.full_text_view(10, 50).alias("t"))
    assert view._jdf.queryExecution().optimizedPlan().toString().count("full_text") <= 3  # read, trimmed, and in its table
    got = {r.k: r.t.split("## Full text\n\n")[1] for r in view.collect()}
    assert got[1].endswith("_Showing characters 10-60 of 199._\n_More text is available. Call this tool again with `offset=60` to continue._\n\n")
    assert got[2] == got[3] == "_No text could be extracted from the PDF._\n\n"


def test_packed_archives_leave_in_chunks():
    """A batch of 400 texts of 40 KB leaves as many small ones, with all rows in order."""
    import pyarrow as pa

    texts = [bytes([97 + i % 26] * 40_000).decode() for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1, 401), pa.int64()), pa.array(texts), pa.array(["s"] * 400)], ["doc_id", "text", "source"])
    got = list(pack_archives(iter([batch])))
    assert len(got) > 3 and all(b.nbytes < 2 * archive.CHUNK for b in got)
    assert [i for b in got for i in b.column("id").to_pylist()] == list(range(1, 401))
