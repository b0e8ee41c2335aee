"""Pages, chats, lines and token counts against plain versions of themselves."""

import hashlib
import html
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaspark.llm.chat import ChatFormat, escape, unescape
from qaspark.llm.html import WrapperExtraction, outline, parse, tree_match
from qaspark.llm.lines import RepeatedLines
from qaspark.llm.queries import QUERIES, tokenizer_path
from qaspark.llm.tokens import PRE_TOKEN, EditAwareCounts, EditedDocument, cleaning_edits, counter

SMALL = "/root/testdata/sf0.001"
BYTES = tokenizer_path("byte_bpe_50k.json")


# --- pages ----------------------------------------------------------------------------------------------


def article_by_hand(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    lines = [" ".join(html.unescape(x.replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1|b)>", inner)]
    return "\n".join(x for x in lines if x)


def test_pages_of_the_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    found = QUERIES["op1_html_extraction"](spark, SMALL).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r["text"] == article_by_hand(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


LAYOUT = """<html><head><title>T</title></head><body><header><h1>Site {s}</h1></header><nav><ul><li>Home</li><li>More</li></ul></nav>
<div id="wrap"><div class="sidebar"><p>Popular things and other long lists of links that fill the side</p></div>
<div class="x1"><h2>Head {i}</h2><p>First &amp; {i}   text
 here.</p><p>Second {t} <b>bold</b>&nbsp;word</p><div class="share-bar">Tell all your friends</div><ul><li>one {i}<li>two</ul></div></div>
<div class="comments"><p>I say {t}</p></div><form><input name=q><button>Go</button></form><script>var a = "<p>no</p>";</script>
<footer>Copyright {i}</footer></body></html>"""


def test_wrapper_without_an_article_element(spark):
    rows = [(i, f"http://h.example/{i}", LAYOUT.format(i=i, s="S", t="word " * (i + 3))) for i in range(8)]
    found = {r["page_id"]: r["text"] for r in WrapperExtraction()(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(8):
        assert found[i] == f"Head {i}\nFirst & {i} text here.\nSecond {'word ' * (i + 2)}word bold word\none {i}\ntwo"


def texts_of(spark, bodies):
    rows = [(i, f"http://same.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    found = WrapperExtraction()(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    return [r["text"] for r in sorted(found, key=lambda r: r["page_id"])]


@pytest.mark.parametrize("n", [1, 6])
def test_content_among_siblings_of_equal_key(spark, n):
    story = lambda i, part: f"<p>Story {i} {part} " + f"word{i}{part} " * 60 + "</p>"
    found = texts_of(spark, [f"<div>Home News Sport</div><hr><div>{story(i, 'a')}{story(i, 'b')}</div>" for i in range(n)])
    assert all("Home" not in t and f"Story {i} a" in t and f"Story {i} b" in t for i, t in enumerate(found))
    split = "<div>{}{}</div><aside>Buy now</aside><div>{}</div><aside>Buy more</aside>"
    found = texts_of(spark, [split.format(*(story(i, x) for x in "abc")) for i in range(n)])
    assert all([line.split()[2] for line in t.split("\n")] == ["a", "b", "c"] for t in found)


def test_wrapper_of_pages_with_own_ids(spark):
    body = '<div id="sidebar">Links</div><article id="post-{i}" class="post-{i} entry{i}"><p>Text {i}</p><div class="tip">Buy our book</div></article>'
    rows = [(i, f"http://same.example/{i}", "<html><body>" + body.format(i=i) + "</body></html>") for i in range(100, 140)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    (plan,) = WrapperExtraction().wrappers(pages).collect()
    assert len(plan["wrapper"]) < 1000
    assert {r["text"] for r in WrapperExtraction()(pages).collect()} == {f"Text {i}" for i in range(100, 140)}


def test_furniture_inside_the_article(spark):
    """Notices, adverts, forms and reader comments go wherever they stand; a page class that mentions a sidebar does not matter."""
    page = """<body class="has-sidebar"><aside>side</aside><article class="post with-comments"><header><h1>Title</h1><p>by me</p></header>
    <div class="site-notice">notice</div><p>One.</p><ins class="ad-slot">buy</ins><blockquote>Two <i>three</i></blockquote><form><p>mail</p></form>
    <table><tr><td>a</td><td>b</td></tr></table><section id="reader-comments"><p>first!</p></section><div class="newsletter-box">join</div></article></body>"""
    found = WrapperExtraction()(spark.createDataFrame([(1, "http://x.example/", page)], "page_id bigint, url string, html string")).collect()
    assert found[0]["text"] == "Title\nby me\nOne.\nTwo three\na\nb"


def test_odd_pages(spark):
    same = "<body><article><p>Same everywhere.</p></article></body>"
    rows = [
        (1, None, None, "x"), (2, "", "", "x"), (3, "http://a/1", "plain text only", "x"), (4, "http://a/2", "<p>open <b>x<p>y", "x"),
        (5, "nonsense", "<<>>< a >", "x"), (None, "http://b/", same, "x"), (None, "http://b/", same, "x"), (6, "http://b/", "<div>" * 300 + "deep" + "</div>" * 300, "x"),
        (7, "http://c/", "<article>" + "<p>w &lt;b&gt; &eacute;</p>" * 5000 + "</article>", "x"), (8, "http://d/", "<!-- never closed <p>x</p>", "x"),
        (10, "http://e/", "<div>" * 20_000 + "<p>deep</p><p>er</p>" + "</div>" * 20_000 + "<p>end</p>", "x"),
        (9, "http://d/1", "</p></div><p title='a>b'>attr</p>", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    found = Counter((r["page_id"], r["url"], r["text"]) for r in WrapperExtraction()(pages).collect())
    assert found[(1, None, "")] == 1 and found[(2, "", "")] == 1
    assert found[(None, "http://b/", "Same everywhere.")] == 2
    assert found[(4, "http://a/2", "open x\ny")] == 1 and found[(3, "http://a/1", "plain text only")] == 1
    assert found[(7, "http://c/", "\n".join(["w <b> é"] * 5000))] == 1
    assert found[(9, "http://d/1", "attr")] == 1 and found[(10, "http://e/", "deep\ner")] == 1
    assert sum(found.values()) == len(rows)
    assert WrapperExtraction()(pages.limit(0)).count() == 0


def test_simple_tree_matching():
    tree = lambda page: outline(parse(page), {})
    a, b = tree("<div><p>x</p><ul><li>1</li></ul></div>"), tree("<div><h1>t</h1><p>y</p><ul></ul></div>")
    assert tree_match(a, a) == 5 and tree_match(a, b) == 4


# --- chats ----------------------------------------------------------------------------------------------


def chats_by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chats_of_the_table(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    hard = r"\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    found = QUERIES["op5_chat_formatting"](spark, SMALL).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in found} == chats_by_hand(rows)
    assert all(r["formatted_chars"] > r["loss_chars"] for r in found)


def test_odd_chats(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, None, None, "x\\"), (2, 3, "assistant", "</turn>\n<turn user>hi</turn>\n"),
            (None, 1, "assistant", "<|image 0|> \\<|image 0|>"), (None, 0, "as>s\\is<t", "y" * 300_000), (3, 5, "assistant", "\\\\<"), (3, 5, "assistant", "\\\\<")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    chat = ChatFormat()
    found = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.segments(turns)).collect()}
    assert found == chats_by_hand(rows)
    assert chat.read_back(chat.segments(turns.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<", "\\<", "a<|image 3|>b", "</turn>\n", "\\n\\\\<>\n"])
def test_escapes_are_reversible(text):
    assert unescape(escape(text)) == text
    assert not re.search(r"(?<!\\)(?:\\\\)*[<>]", escape(text))


def test_typed_parts(spark):
    part = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    parts = [("text", "see <", None, None, None, None, None), ("image", None, "s3://a.png", 28, 15, None, None), ("audio", None, "b.wav", None, None, 1.5, None),
             ("text", "end", None, None, None, None, None), ("document", None, "c.pdf", None, None, None, 2)]
    turns = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id bigint, turn bigint, role string, content array<{part}>")
    rows = ChatFormat(parts="content").segments(turns).orderBy("turn").collect()
    assert rows[0]["formatted"] == "<turn assistant>see \\<<|image 0|><|audio 1|>end<|document 2|></turn>\n"
    assert [tuple(a) for a in rows[0]["attachments"]] == [(0, "image", "s3://a.png", 4), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 512)]
    assert rows[0]["tokens"] == 554 and rows[1]["formatted"] == "<turn user></turn>\n"
    back = ChatFormat(parts="content").read_back(ChatFormat(parts="content").segments(turns)).collect()[0]
    assert (back["n_turns"], back["loss_chars"]) == (2, 8)


# --- lines ------------------------------------------------------------------------------------------------


def lines_by_hand(rows, t):
    data = [(k, (x or "").split("\n")) for k, x in rows]
    seen, gone = {}, [set() for _ in data]
    for n, (_, lines) in enumerate(data):
        for s in range(len(lines) - t + 1):
            key = tuple(lines[s : s + t])
            if key in seen:
                gone[n].update(range(s, s + t))
            seen.setdefault(key, (n, s))
    return [(k, len(lines), [x for i, x in enumerate(lines) if i not in g]) for (k, lines), g in zip(data, gone)]


@pytest.mark.parametrize("t", [1, 2, 3])
def test_lines_against_all_runs(spark, t):
    rng = np.random.default_rng(t)
    rows = [(i, "\n".join(f"line {int(x)}" for x in rng.integers(0, 30, int(rng.integers(0, 25))))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n\n"), (203, "a\na\na\na"), (204, "é\n🙂\n"), (205, "\n".join(f"n{i}" for i in range(20_000)))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lines int")
    found = sorted((r["doc_id"], r["n_lines"], r["kept"]) for r in RepeatedLines(t)(docs).collect())
    assert found == lines_by_hand(rows, t)


def test_lines_on_odd_rows(odd, nothing):
    assert RepeatedLines()(odd).count() == odd.count()
    assert RepeatedLines()(nothing).count() == 0


# --- token counts ------------------------------------------------------------------------------------------


def count_by_tokenizer(texts):
    from tokenizers import Tokenizer

    return [len(x.ids) for x in Tokenizer.from_file(BYTES).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_of_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    found = {r["doc_id"]: r for r in QUERIES["op7_token_counts"](spark, SMALL).collect()}
    before = count_by_tokenizer([d["text"] for d in docs])
    after = []
    for d in docs:
        text = d["text"] or ""
        for e in cleaning_edits(text):
            text = text[: e["start"]] + e["text"] + text[e["end"] :]
        after.append(text)
    for d, b, a in zip(docs, before, count_by_tokenizer(after)):
        assert (found[d["doc_id"]]["before"], found[d["doc_id"]]["after"]) == (b, a)
    assert sum(r["n_edits"] for r in found.values()) > 100


def test_edits_equal_a_full_count():
    rng = np.random.default_rng(6)
    alphabet = list("ab'sl  \n\n.,!12é日🙂\t") + ["'ll", "'ve", "   ", "word", " ", "\x1c"]
    count = counter(BYTES)
    for round_ in range(60):
        text = "".join(rng.choice(alphabet, int(rng.integers(0, 900))))
        doc = EditedDocument(text, count)
        for _ in range(25):
            a, b = sorted(int(x) for x in rng.integers(0, len(doc.text) + 1, 2))
            b = min(b, a + int(rng.integers(0, 12))) if rng.random() < 0.8 else b
            new = "".join(rng.choice(alphabet, int(rng.integers(0, 9))))
            plain = doc.text[:a] + new + doc.text[b:]
            doc.edit(a, b, new)
            assert doc.text == plain
            pieces = PRE_TOKEN.findall(plain)
            assert doc.tree.flat()[0] == list(map(len, pieces))
            assert doc.tree.total == sum(count.all(pieces))
        assert doc.tree.total == count_by_tokenizer([doc.text])[0]


def test_an_edit_encodes_its_surroundings_only():
    doc = EditedDocument("some words here. " * 5000, counter(BYTES))
    doc.edit(40_000, 40_004, "other")
    assert doc.encoded <= 8


def test_odd_counts(spark, odd, nothing):
    edits = F.expr("array(named_struct('start', 1, 'end', 3, 'text', 'zz'), null, named_struct('start', 99999999, 'end', null, 'text', 'q'), named_struct('start', 0, 'end', 0, 'text', null))")
    docs = odd.withColumn("edits", F.when(F.coalesce("doc_id", F.lit(0)) != 3, edits))
    operator = EditAwareCounts(BYTES)
    plain = Counter((r["doc_id"], r["before"], r["after"], r["text"]) for r in operator.recount(docs, "edits").collect())
    kept = Counter((r["doc_id"], r["before"], r["after"], r["text"]) for r in operator.recount(docs, "edits", operator.index(odd)).collect())
    assert plain == kept and sum(plain.values()) == odd.count()
    rows = list(plain)
    assert [r[2] for r in rows] == count_by_tokenizer([r[3] for r in rows])
    assert operator.recount(nothing.withColumn("edits", edits), "edits").count() == 0
