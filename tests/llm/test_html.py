"""Cases that the invented pages of the training don't make: names without meaning, text that stands in for something else, other layouts."""

import pytest

from cairn.llm import html

PROSE = "The harbour was closed on Monday, as the wind had turned to the north. Nobody had been told before noon."
MORE = "Two boats lay outside until the evening, and their crews waited. A third one went on to the next town."
SHORT = "The council meets again in May."
ARTICLE = f"<h1>Harbour closed</h1><p>{PROSE}</p>%s<p>{MORE}</p>"
WHOLE = ["Harbour closed", PROSE, "%s", MORE]


def told(page):
    return html.extract([page], html.trees())[0].split("\n\n")


@pytest.mark.parametrize("inside, text", [
    (f'<div class="commentary"><p>{SHORT} It has met before.</p></div>', f"{SHORT} It has met before."),
    (f'<div class="advertiser-news"><p>{SHORT} It has met before.</p></div>', f"{SHORT} It has met before."),
    (f"<noscript><p>{SHORT}</p></noscript>", SHORT),
    (f"<p><iframe src=x>{SHORT}</iframe></p>", SHORT),
    (f"<p><video src=x>{SHORT}</video></p>", SHORT),
    ("<p>Press the <button>Green key</button> to open the gate, and wait.</p>", "Press the Green key to open the gate, and wait."),
    (f"<button>Share</button><p>{SHORT}</p>", SHORT),
])
def test_what_stands_in_an_article_stays(inside, text):
    assert told(f"<html><body><main>{ARTICLE % inside}</main></body></html>") == [w if w != "%s" else text for w in WHOLE]


def test_list_of_links_and_title_of_an_article_stay():
    links = "<ul><li><a href=/a>Report of the harbour master</a></li><li><a href=/b>Map of the bay</a></li><li><a href=/c>Tables of the tides</a></li></ul>"
    page = f"<body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><article><header><h1>Harbour closed</h1></header><p>{PROSE}</p>{links}<p>{MORE}</p></article><footer>&copy; 2024</footer></body>"
    assert told(page) == ["Harbour closed", PROSE, "Report of the harbour master", "Map of the bay", "Tables of the tides", MORE]


@pytest.mark.parametrize("name", ['class="werbung"', 'class="bandeau-temoins"', 'id="kommentare"', 'class="publicidad"'])
def test_names_of_other_languages(name):
    page = f"<body><article><h1>Harbour closed</h1><p>{PROSE}</p><p>{MORE}</p></article><div {name}><p>{SHORT} Buy two now.</p></div></body>"
    assert told(page) == ["Harbour closed", PROSE, MORE]


#: Layouts by hand: tables, nested and nameless blocks, old tags. {0} is a page's main text.
LAYOUTS = [
    "<table><tr><td><a href=/1>One</a><br><a href=/2>Two</a><br><a href=/3>Three</a></td><td>{0}</td></tr></table>",
    "<center><a href=/>Home</a> | <a href=/b>Books</a> | <a href=/c>Contact</a></center><hr>{0}<hr><a href=/>Home</a> | <a href=/top>Top</a>",
    "<div id=x1><div id=x2><div id=x3>{0}</div></div></div><div id=x4><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></div>",
    "<menu><li><a href=/1>One</a><li><a href=/2>Two</a></menu><main role=main><div><div>{0}</div></div></main><footer><p>Imprint</p></footer>",
    "<header><a href=/>The Paper</a></header><div role=navigation><a href=/1>Town</a><a href=/2>Land</a></div><div role=main>{0}</div>",
    "<body><section><article>{0}</article></section><aside><h2>Most read</h2><ol><li><a href=/1>One</a><li><a href=/2>Two</a></ol></aside>",
    "<div class=layout><div class=col-8>{0}</div><div class=col-4><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li><li><a href=/3>Three</a></li></ul></div></div>",
    "<form action=/s><input><button>Go</button></form><div>{0}</div><dialog><p>We use cookies.</p></dialog>",
]


def test_layouts_that_training_never_makes():
    blocks = right = 0
    for layout in LAYOUTS:
        for main in (ARTICLE % f"<h2>What comes next</h2><p>{SHORT}</p>", f"<h1>Harbour closed</h1><p>{PROSE}</p><blockquote>{SHORT}</blockquote><p>{MORE}</p>", f"<p>{PROSE}</p><p>{MORE}</p><p>{SHORT}</p>"):
            page = layout.format(main)
            everything, wanted, got = html.parse(page).texts, html.parse(main).texts, told(page)
            blocks += len(everything)
            right += sum((t in wanted) == (t in got) for t in everything)
    assert right / blocks >= 0.9, right / blocks
