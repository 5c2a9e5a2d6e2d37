"""Cases of page markup, template counts against brute force, and models that the SentencePiece encoder refuses."""

import random
import re

import pytest

from corvane.llm.common import tokenizer_file
from corvane.llm.html_text import Shape, extract, main_text, may_be_template, parse

CASES = [
    ('<body><form action="x.aspx"><input type=hidden name=v value="1"><h1>Title</h1><p>The story goes on and on here.</p></form></body>', "Title The story goes on and on here."),
    ("<body><p>Text of the page.</p><form><label>Your name</label><p>Send</p></form></body>", "Text of the page."),
    ('<body><article><p>Story.</p></article><ol class="commentlist"><li>nice</li></ol></body>', "Story."),
    ('<body><div class="commentlist">nice</div><p>Story.</p></body>', "Story."),
    ("<body><main><p>Main story.</p></main><article><p>Teaser</p></article></body>", "Main story."),
    ("<body><main> </main><article><p>Story</p></article></body>", "Story"),
    ('<body><p hidden>secret</p><p style="display: none">no</p><p title="hidden">shown</p></body>', "shown"),
    ("<body><p data-x=it's>It is.</p><a href='a>b'>link</a></body>", "It is. link"),
    ('<p class="' + "x" * 10, ""),
    ("<p " + 'a="b" ' * 2000, ""),
    ("", ""),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_main_text(page, text):
    assert main_text(page) == text or page.startswith("<p ") and len(main_text(page)) <= len(page)


def test_templates_against_counts(spark):
    """Menus whose current entry differs by an attribute are one template; what recurs on fewer pages stays."""
    r = random.Random(3)
    rows = []
    for k in range(60):
        menu = "".join(f'<li{" class=active" if i == k % 4 else ""}><a href="/{k}/{i}">Entry {i}</a></li>' for i in range(4))
        odd = "<div><p>Read our other stories of the year.</p></div>" if k % 20 == 0 else ""
        rows.append((k, f"https://site{k % 2}.org/{k}", f"<body><div id=m{k}><ul>{menu}</ul></div><p>{' '.join(r.choice('abcdefgh') * 5 for _ in range(60))} {k}.</p>{odd}<div><p>Written by the house.</p></div></body>"))
    rows += [(100, None, None), (101, "https://x.org/", ""), (None, "https://site0.org/z", "<p>alone</p>")]
    got = {x["page_id"]: x["text"] for x in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert len(got) == len(rows) and got[100] == got[101] == "" and got[None] == "alone"
    for k, _, page in rows[:60]:
        story = re.search(r"<p>(\S{5} .*? \d+\.)</p>", page)[1]
        assert got[k] == story + (" Read our other stories of the year." if k % 20 == 0 else "")


def test_shapes_ignore_attributes_only():
    def keys(page):
        elements, tags = parse(page)
        shape = Shape(page, tags)
        return [shape.key(e) for e in elements if may_be_template(e)]

    a, b, c = ('<div class="x"><ul><li>one</ul></div>', "<div><ul id=q><li class=y>one</ul></div>", "<div><ul><li>two</ul></div>")
    assert keys(a) == keys(b) and not set(keys(a)) & set(keys(c)) and len(keys(a)) == 2


def message(*parts):
    def number(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    return b"".join(number(n << 3) + number(v) if isinstance(v, int) else number(n << 3 | 2) + number(len(v)) + v for n, v in parts)


def test_other_models_are_refused():
    import sentencepiece

    from corvane.llm.sentencepieces import Pieces, check_model

    check_model(sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model")).serialized_model_proto())
    assert Pieces(tokenizer_file("piece_bpe_32k.model")).depth >= 4
    good = (message((3, 2)), message((1, b"identity"), (3, 1), (4, 0)))
    check_model(message((2, good[0]), (3, good[1])))
    for trainer, norm in ((message((3, 1)), good[1]), (good[0], message((1, b"nmt_nfkc"), (4, 0))), (good[0], message((1, b"identity"))), (b"", good[1])):
        with pytest.raises(ValueError):
            check_model(message((2, trainer), (3, norm)))
