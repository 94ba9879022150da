"""Names of elements are evidence: whole words only, and never against the only text of a page."""

import pytest

from loomdex.llm import html

LONG = "The house is on the hill and it was in the valley of the river that they had to go to for the water. " * 4
TEXT = LONG.strip()


@pytest.mark.parametrize("name", ["content has-sidebar", "post comments-open", "search-results-page", "no-menu", "navy-blue-theme"])
def test_a_name_in_part_is_no_name(name):
    assert html.main_text(f'<body><div class="{name}"><p>{LONG}</p><p>{LONG}</p></div></body>') == f"{TEXT}\n{TEXT}"


def test_inside_an_article_too():
    assert html.main_text(f'<article><div class="story share-price-report"><p>{LONG}</p></div></article>') == TEXT


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "cookie-notice", "ads2", "topNav", "main side-bar", "sponsored-links", "promo_box", "comments list"])
def test_a_whole_name_is(name):
    assert html.main_text(f'<body><article><p>{LONG}</p></article><div class="{name}"><p>{LONG * 3}</p></div></body>') == TEXT
    assert html.main_text(f'<article><p>{LONG}</p><div id="{name.split()[-1] if name == "main side-bar" else name}"><p>Short</p></div></article>') == TEXT


def test_a_name_around_the_only_text_does_not_count():
    assert html.main_text(f'<body><div class="sidebar"><p>{LONG}</p></div><p>x</p></body>').startswith(TEXT)


@pytest.mark.parametrize("inner", ["<button>x</button>", "<script>var a='<p>';</script>", "<svg><path/></svg>", "<select><option>1<option>2</select>", "<noscript><img></noscript>", '<span class="share">Share</span>'])
def test_dropped_elements_in_a_line_do_not_cut_it(inner):
    assert html.main_text(f"<article><p>A {inner} B</p><p>C</p></article>") == "A B\nC"


def test_pages_without_a_good_block_keep_what_is_no_link():
    assert html.main_text("<p>Just one line.</p>") == "Just one line."
    assert html.main_text('<p>One line.</p><div class="menu">Menu</div><p><a href=x>A link of the page</a></p><footer>F</footer>') == "One line."
    assert html.main_text("<nav>Menu</nav>") == ""


def test_languages_without_known_stop_words():
    prose = "これは日本語の文章です。川の近くの家に住んでいる人々は、毎日水を汲みに行かなければなりませんでした。とても長い道のりでした。" * 2
    page = f'<body><div><a href=1>ホーム</a> <a href=2>概要</a></div><p>{prose}</p><p>短い文。</p><p>{prose}</p><div class="footer">著作権</div></body>'
    assert html.main_text(page).split("\n") == [prose, "短い文。", prose]
    finnish = "Talo sijaitsee kukkulalla ja joki virtaa laaksossa, josta vesi haettiin joka aamu ennen auringonnousua kotiin. " * 3
    assert html.main_text(f"<body><p>{finnish}</p><div><a href=1>Etusivu</a></div></body>") == finnish.strip()


def test_very_long_pages_stay_whole():
    page = "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"
    assert html.main_text(page) == "\n".join([TEXT] * 5000)
